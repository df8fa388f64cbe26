"""Queries over the sample tables, each with the SQL that gives the same rows.

``queries()`` and ``oracles()`` gather what the modules of this package register.
"""

from __future__ import annotations

from gridevents.catalog.registry import ORACLES, QUERIES
from gridevents.catalog import (aggregates, analyses, arrays, expressions, filtering, joining,  # noqa: F401
                                learning, ordering, scanning, setops, windows, writing)


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
