"""Rows of either engine in a common form."""

from __future__ import annotations

import math


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (list, tuple)):
        return tuple(value(y) for y in x)
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)):
        return round(float(x), 5)
    if hasattr(x, "isoformat"):
        return x.isoformat().replace(" ", "T").removesuffix("T00:00:00")
    if type(x).__name__ == "Decimal":
        return round(float(x), 5)
    return x


def rows(found) -> list:
    return sorted((tuple(value(x) for x in r) for r in found), key=repr)
