"""Alarm conditions as trees, compiled to one Column."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARE = {"gt": operator.gt, "ge": operator.ge, "lt": operator.lt, "le": operator.le, "eq": operator.eq, "ne": operator.ne}
#: State guards and the modes they admit; None admits all.
GUARDS = {"any": None, "running": ("loaded", "unloaded"), "loaded": ("loaded",), "not_loaded": ("unloaded", "off"), "off": ("off",)}


def compile_condition(node: dict, settings: dict[str, float] | None = None) -> Column:
    """``{"all": [...]}``, ``{"any": [...]}`` or a leaf ``{"signal", "op", "value"}`` with an optional second signal to subtract.

    A leaf's value may name a setting. A comparison with a missing signal is false, so a tree is
    never null. An empty ``all`` holds, an empty ``any`` doesn't.
    """
    if "all" in node:
        return reduce(operator.and_, [compile_condition(n, settings) for n in node["all"]], F.lit(True))
    if "any" in node:
        return reduce(operator.or_, [compile_condition(n, settings) for n in node["any"]], F.lit(False))
    if "state" in node:
        return guard(node["state"])
    value = node["value"]
    if isinstance(value, str) and settings is not None and value in settings:
        value = settings[value]
    left = F.col(node["signal"]) - F.col(node["minus"]) if "minus" in node else F.col(node["signal"])
    return F.coalesce(COMPARE[node["op"]](left, F.lit(value)), F.lit(False))


def guard(name: str, mode: str = "mode") -> Column:
    """Whether the machine state passes a guard."""
    admitted = GUARDS[name]
    return F.lit(True) if admitted is None else F.coalesce(F.col(mode).isin(*admitted), F.lit(False))
