"""Vectors, intervals and token budgets, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 if either vector is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, 1.0).otherwise(1 - dot(a, b) / size)


def round_even(c: Column, digits: int) -> Column:
    """Rounded half to even at a decimal digit, as doubles: a value one step beside the half that a median gives counts as the half.

    ``bround`` rounds the shortest decimal text instead, for which 28.450000000000003 is more than a half.
    """
    scaled = c.cast("double") * F.lit(10.0**digits)
    return F.when(F.abs(scaled) < float("inf"), F.rint(scaled) / F.lit(10.0**digits)).otherwise(c.cast("double"))


def bucket(distance: Column, auto: float = 0.25, candidate: float = 0.55) -> Column:
    return F.when(distance <= auto, "auto").when(distance <= candidate, "grey").otherwise("miss")


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Length that [a, b] and [c, d] have in common."""
    return F.greatest(F.lit(0.0), F.least(b, d) - F.greatest(a, c))


def clamp(value: Column, low: Column, high: Column) -> Column:
    """Cut to whole numbers towards zero; the lower bound wins over the upper one."""
    return F.greatest(low.cast("double"), F.least(value.cast("double"), high.cast("double"))).cast("int")


def segment_budget(n: Column, ratio: float = 0.78, least: float = 0.65, most: float = 0.90, floor: int = 200, cap: int = 1800) -> Column:
    low = F.greatest(F.ceil(n * F.lit(least)), F.lit(floor).cast("long")).cast("int")
    high = F.least(F.floor(n * F.lit(most)), F.lit(cap).cast("long")).cast("int")
    return F.struct(clamp(n * F.lit(ratio), low, high).alias("target"), low.alias("low"), high.alias("high"))


def pack_budget(n: Column, ratio: float = 0.90, least: float = 0.80, most: float = 0.95, floor: int = 400) -> Column:
    low = F.greatest(F.ceil(n * F.lit(least)), F.lit(floor).cast("long")).cast("int")
    high = F.floor(n * F.lit(most)).cast("int")
    return F.struct(clamp(n * F.lit(ratio), low, high).alias("target"), low.alias("low"), high.alias("high"))


def final_budget(n: Column, ratio: float = 0.70, least: float = 0.60, most: float = 0.80) -> Column:
    low, high = F.ceil(n * F.lit(least)).cast("int"), F.floor(n * F.lit(most)).cast("int")
    return F.struct(clamp(n * F.lit(ratio), low, high).alias("target"), low.alias("low"), high.alias("high"))


def fits_whole(n: Column, prompt: Column, context: Column, margin: int) -> Column:
    return prompt + 2 * n + margin <= context


def whole_possible(n: Column, prompt: Column, context: Column, margin: int, least: float = 0.65) -> Column:
    return prompt + n + F.ceil(n * F.lit(least)) + margin <= context


def final_fits(n: Column, prompt: Column, context: Column, margin: int, most: float = 0.80) -> Column:
    return prompt + n + F.floor(n * F.lit(most)) + margin <= context


def window_tokens(prompt: Column, context: Column, margin: int, cap: Column, floor: int = 2000) -> Column:
    return clamp(F.floor((context - prompt - margin) / 2), F.lit(floor), F.greatest(F.lit(floor), cap))


def uncapped(n: Column, cap: Column, most: float = 0.90) -> Column:
    return F.greatest(cap.cast("long"), F.ceil(n * F.lit(most))).cast("int")


def segmentation_mode(mode: Column, fits: Column, possible: Column) -> Column:
    """whole or segmented; ``never`` with an impossible whole is an error."""
    return (
        F.when(mode == "always", "segmented")
        .when(mode == "never", F.when(possible, "whole").otherwise("error"))
        .otherwise(F.when(fits, "whole").otherwise("segmented"))
    )


def backoff_seconds(attempt: Column, base: int = 60, cap: int = 3600) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.greatest(F.lit(0), attempt - 1)), F.lit(float(cap)))


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """a / b rounded half to even; null where b isn't above 0."""
    return F.when(b > 0, F.bround(a / b, digits))


def stream_ceiling(most_tokens: Column, least_rate: float, slack: float, floor: float, cap: float) -> Column:
    return F.greatest(F.lit(floor), F.least(most_tokens / F.lit(least_rate) * F.lit(slack), F.lit(cap)))
