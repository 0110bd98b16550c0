"""Magnitude-scaled Laplace noise on number literals, deterministic under a key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Noise
from .crypto import TEST_KEY, uniform
from .spans import match_spans, rebuild

# Fixed value: a number, with thousands separators or plain, that is not part of a word or version.
NUMBER = r"(?<![A-Za-z0-9_.])-?[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?(?![A-Za-z0-9_])|(?<![A-Za-z0-9_.])-?[0-9]+(?:\.[0-9]+)?(?![A-Za-z0-9_])"


def numbers(text: Column) -> Column:
    return match_spans(text, NUMBER, "NUMBER", 0, 0, "NUMBER")


def number_value(literal: Column) -> Column:
    return F.regexp_replace(literal, ",", "").cast("double")


def is_eligible(literal: Column, cfg: Noise = Noise()) -> Column:
    """Large enough, and no bare year."""
    v = number_value(literal)
    year = (F.length(literal) == 4) & ~literal.rlike("[.,]") & v.between(cfg.year_floor, cfg.year_ceiling)
    return (F.abs(v) >= cfg.min_magnitude) & ~year


def laplace(u: Column, scale: Column) -> Column:
    return -scale * F.signum(u) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(u))


def noisy(literal: Column, message: Column, cfg: Noise = Noise(), key: bytes = TEST_KEY) -> Column:
    """The literal's replacement: whole numbers stay whole, others get two decimals, commas go."""
    v = number_value(literal)
    scale = F.greatest(F.lit(cfg.absolute_sensitivity), F.abs(v) * cfg.relative_sensitivity) / F.lit(cfg.epsilon)
    x = v + laplace(uniform(message, key), scale)
    return F.when(literal.contains("."), F.round(x, 2).cast("decimal(38,2)").cast("string")).otherwise(F.floor(x + 0.5).cast("string"))


def apply_noise(text: Column, row_id: Column, cfg: Noise = Noise(), key: bytes = TEST_KEY) -> Column:
    """struct(text, noised, epsilon): every eligible literal is replaced; position and literal seed the draw."""
    found = F.filter(numbers(text), lambda s: is_eligible(s["value"], cfg))

    def value(s: Column) -> Column:
        return noisy(s["value"], F.concat_ws(":", row_id.cast("string"), s["start"].cast("string"), s["value"]), cfg, key)

    changed = F.size(F.filter(found, lambda s: value(s) != s["value"]))
    return F.struct(rebuild(text, found, value).alias("text"), changed.alias("noised"), (changed * F.lit(cfg.epsilon)).alias("epsilon"))
