"""Query parameters: what a plan may do."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field, fields
from datetime import date

from .errors import RulesError

#: FIXED VALUES: route types (inclusive ranges) of each mode.
MODES = {
    "tram": ((0, 0), (900, 999)),
    "subway": ((1, 1), (400, 499)),
    "metro": ((1, 1), (400, 499)),
    "rail": ((2, 2), (100, 199)),
    "bus": ((3, 3), (11, 11), (200, 299), (700, 799)),
    "ferry": ((4, 4), (1000, 1099), (1200, 1299)),
    "cable_tram": ((5, 5),),
    "aerial_lift": ((6, 6), (1300, 1399)),
    "funicular": ((7, 7), (1400, 1499)),
}
MAX_WINDOW = 48 * 3600
_CLOCK = re.compile(r"(\d{1,2}):(\d{2})(?::(\d{2}))?")


def parse_clock(text: str) -> int:
    """Seconds of H:MM, HH:MM or HH:MM:SS; hours may pass 24."""
    m = _CLOCK.fullmatch(text.strip())
    if not m or int(m[2]) > 59 or int(m[3] or 0) > 59:
        raise ValueError(f"not a clock time: {text!r}")
    return int(m[1]) * 3600 + int(m[2]) * 60 + int(m[3] or 0)


def mode_ranges(mode: str) -> tuple[tuple[int, int], ...]:
    return MODES[mode]


@dataclass(frozen=True)
class MinTransfer:
    same_station: int = 60
    walk_link: int = 120


@dataclass(frozen=True)
class Rules:
    mode: str = "stops"
    selection: str = "selection.toml"
    station_overrides: str | None = None
    walks: str | None = None
    date: str = "2026-11-14"
    earliest_start: str = "04:30"
    latest_end: str = "26:00"
    start: str = "any"
    end: str = "any"
    allow_walking: bool = True
    walking_speed_kmh: float = 4.5
    walk_detour_factor: float = 1.3
    max_walk_m: float = 1200.0
    connector_modes: tuple[str, ...] = ("tram", "bus")
    min_transfer_s: MinTransfer = MinTransfer()
    tight_transfer_s: int = 120
    count_pass_through: bool = False
    stay_aboard_through_terminus: bool = False

    @property
    def window(self) -> tuple[int, int]:
        return parse_clock(self.earliest_start), parse_clock(self.latest_end)

    @property
    def connector_ranges(self) -> list[tuple[int, int]]:
        return [r for m in self.connector_modes for r in MODES[m]]

    def problems(self) -> list[str]:
        """Every reason why these rules cannot be used."""
        out = []
        try:
            if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", self.date):
                raise ValueError
            date.fromisoformat(self.date)
        except ValueError:
            out.append(f"date: not YYYY-MM-DD: {self.date!r}")
        ends = {}
        for name in ("earliest_start", "latest_end"):
            try:
                ends[name] = parse_clock(getattr(self, name))
            except ValueError as e:
                out.append(f"{name}: {e}")
        if len(ends) == 2 and not 0 < ends["latest_end"] - ends["earliest_start"] <= MAX_WINDOW:
            out.append("window: must end after its start and within 48 hours")
        t = self.min_transfer_s
        for name, v, ok in (
            ("walking_speed_kmh", self.walking_speed_kmh, 0 < self.walking_speed_kmh <= 30),
            ("walk_detour_factor", self.walk_detour_factor, 1 <= self.walk_detour_factor <= 5),
            ("max_walk_m", self.max_walk_m, 0 <= self.max_walk_m <= 10_000),
            ("min_transfer_s.same_station", t.same_station, 1 <= t.same_station <= 86_400),
            ("min_transfer_s.walk_link", t.walk_link, 1 <= t.walk_link <= 86_400),
            ("tight_transfer_s", self.tight_transfer_s, 0 <= self.tight_transfer_s <= 86_400),
        ):
            if not ok:
                out.append(f"{name}: {v} is out of range")
        return out + [f"connector_modes: unknown mode {m!r}" for m in self.connector_modes if m not in MODES]

    def checked(self) -> Rules:
        if found := self.problems():
            raise RulesError("\n".join(found))
        return self


def read_rules(text: str) -> Rules:
    """Rules from TOML; unknown keys are refused."""
    data = tomllib.loads(text)
    known, known_min = {f.name for f in fields(Rules)}, {f.name for f in fields(MinTransfer)}
    minimum = data.get("min_transfer_s", {})
    if unknown := sorted(set(data) - known) + sorted(set(minimum) - known_min):
        raise RulesError("\n".join(f"{k}: unknown key" for k in unknown))
    data = {k: tuple(v) if isinstance(v, list) else v for k, v in data.items()}
    return Rules(**data | {"min_transfer_s": MinTransfer(**minimum)}).checked()


@dataclass(frozen=True)
class Include:
    """Stations served by matching trips; every filter that is set must hold."""

    route_types: tuple[int, ...] = ()
    agencies: tuple[str, ...] = ()
    routes: tuple[str, ...] = ()  # globs on the short name
    bbox: tuple[float, float, float, float] | None = None  # south, west, north, east
    stations: tuple[str, ...] = ()

    @property
    def by_trip(self) -> bool:
        return bool(self.route_types or self.agencies or self.routes)


@dataclass(frozen=True)
class Selection:
    name: str = "selection"
    include: tuple[Include, ...] = ()
    exclude_stations: tuple[str, ...] = ()
    visit_route_types: tuple[int, ...] = field(default=())


def read_selection(text: str) -> Selection:
    data = tomllib.loads(text)
    known = {f.name for f in fields(Selection)}
    rule_keys = {f.name for f in fields(Include)}
    bad = [k for k in data if k not in known] + [k for r in data.get("include", []) for k in r if k not in rule_keys]
    if bad:
        raise RulesError("\n".join(f"{k}: unknown key" for k in sorted(bad)))
    lists = lambda d: {k: tuple(v) if isinstance(v, list) else v for k, v in d.items()}
    return Selection(**lists(data) | {"include": tuple(Include(**lists(r)) for r in data.get("include", []))})
