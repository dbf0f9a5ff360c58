"""Registered queries of marts that are summed from parts, as an incremental refresh does it; their SQL is that of the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame

from revlake.operators import marts, refresh
from revlake.plans.registry import QUERIES as WHOLE
from revlake.plans.registry import Frames


def _mart(f: Frames, name: str) -> DataFrame:
    """The mart from the numbers of even reviews, to which those of odd ones are added."""
    found = []
    for k in (0, 1):
        r, s, x = f.r.filter(f"(id div 32) % 2 = {k}"), f.s.filter(f"(review_id div 32) % 2 = {k}"), f.x.filter(f"(review_id div 32) % 2 = {k}")
        found.append({"by_day": refresh.by_day(r, s), "by_keyword": refresh.by_keyword(x, r), "by_category": refresh.by_category(marts.review_category(f.t, x, r, s))})
    return refresh.built({n: refresh.added(n, found[0][n], found[1][n]) for n in refresh.STATES}, f.t)[name]


QUERIES: dict = {f"added_{name}": (lambda f, name=name: _mart(f, name), WHOLE[name][1]) for name in refresh.SMALL}
