"""Operators for preparing large training corpora.

Nothing outside this package imports it.  ``railweave.llm.catalog`` lists the
registered queries and their SQL counterparts.
"""
