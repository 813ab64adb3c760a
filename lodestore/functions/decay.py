"""Time decay, reinforcement and score expressions over an age in hours."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tiers (hours, weight), half-lives and floors.
DEFAULT_TIERS = ((1.0, 1.00), (24.0, 0.75), (168.0, 0.50), (720.0, 0.20))
HUMAN_TIERS = ((1.0, 1.00), (24.0, 0.80), (168.0, 0.55), (720.0, 0.25))
PRESETS = {
    "conversation": ("exponential", 1.0, 0.02),
    "preference": ("exponential", 168.0, 0.10),
    "fact": ("linear", 720.0, 0.15),
    "human": ("step", 24.0, 0.05),
}
MAX_BOOST, SATURATION = 1.30, 10


def clamped(raw: Column, floor: float) -> Column:
    return F.greatest(F.lit(floor), F.least(F.lit(1.0), raw))


def exponential(age: Column, half_life: float = 24.0, floor: float = 0.05) -> Column:
    return clamped(F.exp(F.lit(-math.log(2) / half_life) * F.greatest(age, F.lit(0.0))), floor)


def linear(age: Column, half_life: float = 24.0, floor: float = 0.05) -> Column:
    return clamped(1 - F.greatest(age, F.lit(0.0)) / (2 * half_life), floor)


def step(age: Column, tiers=DEFAULT_TIERS, floor: float = 0.05) -> Column:
    """The weight of the first tier that the age lies under."""
    positive = F.greatest(age, F.lit(0.0))
    out = None
    for hours, weight in tiers:
        out = F.when(positive < hours, weight) if out is None else out.when(positive < hours, weight)
    return clamped(out.otherwise(floor), floor)


def preset(name: str, age: Column) -> Column:
    kind, half_life, floor = PRESETS[name]
    if kind == "step":
        return step(age, HUMAN_TIERS, floor)
    return (exponential if kind == "exponential" else linear)(age, half_life, floor)


def freq_boost(n: Column, most: float = MAX_BOOST, saturation: int = SATURATION) -> Column:
    """Grows with the logarithm of the reinforcements up to a ceiling."""
    return F.least(1 + (most - 1) * F.log(1 + F.greatest(n, F.lit(1))) / math.log(1 + saturation), F.lit(most))


def recency_boost(hours: Column, most: float = 1.15) -> Column:
    """A recent recall lifts a memory; never recalled: no lift."""
    return F.when(hours.isNull(), 1.0).otherwise(F.least(1 + (most - 1) * F.exp(-hours / 6), F.lit(most)))


def weighted(cosine: Column, decay: Column, boost: Column) -> Column:
    return 0.6 * cosine + 0.3 * decay + 0.1 * (boost - 1) / (MAX_BOOST - 1 + 1e-9)


def final(score: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)


def age_text(hours: Column) -> Column:
    return (
        F.when(hours < 1, F.format_string("%dm ago", (hours * 60).cast("int")))
        .when(hours < 24, F.format_string("%.1fh ago", hours))
        .when(hours < 168, F.format_string("%.1fd ago", hours / 24))
        .otherwise(F.format_string("%.1fw ago", hours / 168))
    )


def explained(cosine: Column, weight: Column, boost: Column, reinforcements: Column, hours: Column, score: Column) -> Column:
    """How a score came about, as text."""
    return F.format_string(
        "Score breakdown:\n  Cosine similarity : %.4f\n  Temporal decay    : %.4f  (%.1fh ago)\n  Frequency boost   : %.4f  (%d reinforcements)\n  " + "\u2500" * 29 + "\n  Final score       : %.4f",
        cosine, weight, hours, boost, reinforcements, score,
    )
