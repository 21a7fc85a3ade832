"""All registered queries."""

from __future__ import annotations

from tidegauge.plans import learned, relational, scored, timeline  # noqa: F401  (they register on import)
from tidegauge.plans.catalog import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
