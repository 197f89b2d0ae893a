"""Row-level arithmetic on scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code -> name of the agency enumerations.
BIAS = {-3: "extreme_left", -2: "left", -1: "left_center", 0: "unbiased", 1: "right_center", 2: "right", 3: "extreme_right"}
CREDIBILITY = {0: "very_low", 1: "low", 2: "mixed", 3: "mostly_factual", 4: "high", 5: "very_high"}
EXEMPT_MEDIA = ["The Economist", "BBC", "The Guardian", "Financial Times", "Reuters", "The Independent"]


def named(code: Column, names: dict[int, str]) -> Column:
    """Enumeration name of a code, null if unknown."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), code)


def pretty(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def no_nan(x: Column) -> Column:
    """NaN becomes null, which aggregates skip."""
    return F.nanvl(x, F.lit(None).cast("double"))


def mean_of(a: Column, b: Column) -> Column:
    """Mean of two scores that skips a null one."""
    return F.coalesce((a + b) / 2, a, b)


def side(bias: Column) -> Column:
    return F.signum(bias).cast("int")


def aisle(bias: Column) -> Column:
    return F.when(bias < 0, "left").when(bias > 0, "right").when(bias == 0, "center")


def smiley(value: Column, bias: float) -> Column:
    """A face for scores beyond the neutral zone, else nothing."""
    return F.when(value > bias, "😊").when(value < -bias, "😭").otherwise("")


def colour(value: Column, bias: float, span: float) -> Column:
    """The colour of a score as CSS; light grey for a missing one."""
    return F.when(value.isNull(), "#f9fafb").otherwise(F.concat(F.lit("hsl("), F.format_number(hue(value, bias, span), 2), F.lit(", 100%, 50%)")))


def hue(value: Column, bias: float, span: float) -> Column:
    """Colour scale from red (0) to green (120)."""
    return F.least(F.greatest((value + bias) / (span * bias) * 120, F.lit(0.0)), F.lit(120.0))
