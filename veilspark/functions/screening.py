"""Prompt screening: ordered rules, and their fusion with a classifier's opinion."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R

# word borders of the rules in ASCII, on either side of a word
_B = R.BORDER


#: The density rule as one pattern on lower-case text: a whole word of 5 to 20 of the plain form, with two substitutions.
DENSITY = rf"{_B}(?=[a-z0-9]{{5,20}}{_B})(?=[a-z]*[0134][a-z]*[0134])[a-z]+[0134]+[a-z]+[a-z0-9]*{_B}"


def holds(text: Column, literals: tuple[str, ...]) -> Column:
    return reduce(or_, [text.contains(x) for x in literals])


def _hits(text: Column, name: str, pattern: str) -> Column:
    """Whether a rule hits; its pattern is only tried on texts that hold one of the rule's literals."""
    lower = F.lower(text)
    if name == "OBFUSCATED_LEET_DENSITY":
        hit = lower.rlike(DENSITY)
    else:
        hit = text.rlike("(?i)" + R.ascii_space(pattern).replace(r"\b", _B))
    held = holds(lower, R.SCREENING_HOLDS[name]) if name in R.SCREENING_HOLDS else lower.rlike(R.SPACED_PIECE)
    return held & hit


def first_rule(text: Column) -> Column:
    """The name of the first rule that hits, or null; later rules are not tried."""
    return F.coalesce(*[F.when(_hits(text, n, p), F.lit(n)) for n, p in R.SCREENING])


def all_rules(text: Column) -> Column:
    """The names of all rules that hit, in order."""
    return F.array_compact(F.array(*[F.when(_hits(text, n, p), F.lit(n)) for n, p in R.SCREENING]))


def verdict(rule: Column, label: Column, confidence: Column, threshold: float = 0.75, fail_closed: bool = False) -> Column:
    """struct(attack, method, confidence, rule). A null label is no opinion, which is not the same as safe."""
    ml = F.coalesce((label == "ATTACK") & (confidence >= threshold), F.lit(False))
    hit = rule.isNotNull()
    absent = label.isNull()
    pick = lambda a, b, c, d, e: F.when(ml & hit, a).when(ml, b).when(hit, c).when(absent & F.lit(fail_closed), d).otherwise(e)
    lit = F.lit
    return F.struct(
        pick(lit(True), lit(True), lit(True), lit(True), lit(False)).alias("attack"),
        pick(lit("ML+REGEX"), lit("ML"), lit("REGEX"), lit("UNAVAILABLE"), lit("NONE")).alias("method"),
        pick(confidence, confidence, lit(0.0), lit(0.0), lit(0.0)).alias("confidence"),
        pick(rule, lit("ml-classifier"), rule, lit("ml-unavailable-fail-closed"), lit("none")).alias("rule"),
    )
