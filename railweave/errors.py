"""Typed errors."""


class FeedError(ValueError):
    """A feed that cannot be used: file, line and reason."""

    def __init__(self, file: str, line: int | None, reason: str):
        super().__init__(f"{file}{f':{line}' if line is not None else ''}: {reason}")
        self.file, self.line, self.reason = file, line, reason


class LimitError(FeedError):
    """An input over one of the limits."""


class RulesError(ValueError):
    """All problems of a set of rules, one a line."""


class SelectionError(ValueError):
    pass


class OverrideError(ValueError):
    pass


class NetworkError(ValueError):
    pass


class PackError(ValueError):
    pass
