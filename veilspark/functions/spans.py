"""Spans as array columns: extraction, overlap resolution, rebuilding. Native expressions, offsets in code points."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .validators import CHECKS

#: Sort keys come first, so that ``array_sort`` gives the order of resolution.
SPAN = "struct<start:int,negPriority:int,negLength:int,ord:int,end:int,type:string,value:string,detector:string>"
_EMPTY = f"cast(array() as array<{SPAN}>)"


def match_spans(text: Column, pattern: str, type_: str, priority: int, ord_: int, detector: str, keep=None, holds: tuple[str, ...] = ()) -> Column:
    """All leftmost matches of one pattern as spans, in one fold that carries the position.

    Candidates that ``keep`` turns down have still used up their text. Null text has no spans. ``holds`` are literals of
    which every match holds one: the pattern is not tried on texts without them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pieces = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    start = F.struct(F.lit(0).alias("pos"), F.expr(_EMPTY).alias("acc"))

    def step(a: Column, x: Column) -> Column:
        begin = a["pos"] + F.length(x["g"])
        size = F.length(x["m"])
        span = F.struct(begin.alias("start"), F.lit(-priority).alias("negPriority"), (-size).alias("negLength"), F.lit(ord_).alias("ord"), (begin + size).alias("end"), F.lit(type_).alias("type"), x["m"].alias("value"), F.lit(detector).alias("detector"))
        more = F.array(span).cast(f"array<{SPAN}>")
        acc = F.concat(a["acc"], F.when(keep(x["m"]), more).otherwise(F.expr(_EMPTY))) if keep else F.concat(a["acc"], more)
        return F.struct((begin + size).alias("pos"), acc.alias("acc"))

    folded = F.aggregate(pieces, start, step, lambda a: a["acc"])
    hit = text.rlike(pattern)
    if holds:
        hit = reduce(or_, [text.contains(x) for x in holds]) & hit
    return F.when(hit, folded).otherwise(F.expr(_EMPTY))


def rule_spans(text: Column, which: list[int] | None = None) -> Column:
    """Findings of the pattern rules (all, or by position), in rule order; rules do not hide each other."""
    parts = [match_spans(text, r.pattern, r.type, r.priority, i, "REGEX", CHECKS.get(r.check), r.holds) for i, r in enumerate(R.RULES) if which is None or i in which]
    return F.concat(*parts)


def name_candidates(text: Column) -> Column:
    return match_spans(text, R.NAME_PATTERN, "NAME", R.NAME_PRIORITY, R.NAME_ORD, "GAZETTEER")


def name_spans(text: Column, lexicon: list[str]) -> Column:
    """Runs of lexicon words with nothing but white space between them. Case matters; one fold per text."""
    known = F.array(*[F.lit(w) for w in sorted(lexicon)])
    start = F.struct(F.lit(-1).alias("prev"), F.lit(False).alias("open"), F.expr(_EMPTY).alias("acc"))

    def step(a: Column, x: Column) -> Column:
        is_name = F.array_contains(known, x["value"])
        gap = F.substring(text, a["prev"] + 1, x["start"] - a["prev"])
        joins = is_name & a["open"] & (x["start"] > a["prev"]) & gap.rlike(r"^\s+$")
        begin = F.element_at(a["acc"], -1)["start"]
        value = lambda b: F.substring(text, b + 1, x["end"] - b)
        span = lambda b: F.array(F.struct(b.alias("start"), F.lit(-R.NAME_PRIORITY).alias("negPriority"), (b - x["end"]).alias("negLength"), F.lit(R.NAME_ORD).alias("ord"), x["end"].alias("end"), F.lit("NAME").alias("type"), value(b).alias("value"), F.lit("GAZETTEER").alias("detector"))).cast(f"array<{SPAN}>")
        acc = F.when(joins, F.concat(F.slice(a["acc"], F.lit(1), F.size(a["acc"]) - 1), span(begin))).when(is_name, F.concat(a["acc"], span(x["start"]))).otherwise(a["acc"])
        return F.struct(x["end"].alias("prev"), is_name.alias("open"), acc.alias("acc"))

    # most texts hold no listed word at all, which plain searches tell
    any_name = reduce(or_, [text.contains(w) for w in sorted(lexicon)]) if lexicon else F.lit(False)
    return F.when(any_name, F.aggregate(name_candidates(text), start, step, lambda a: a["acc"])).otherwise(F.expr(_EMPTY))


def resolve(spans: Column) -> Column:
    """Greedy choice: earliest start, then higher priority, then longer, then detector order; touching is no overlap."""
    start = F.struct(F.lit(-1).alias("reach"), F.expr(_EMPTY).alias("acc"))

    def step(a: Column, s: Column) -> Column:
        ok = s["start"] >= a["reach"]
        return F.struct(F.when(ok, s["end"]).otherwise(a["reach"]).alias("reach"), F.when(ok, F.concat(a["acc"], F.array(s))).otherwise(a["acc"]).alias("acc"))

    return F.when(F.size(spans) < 2, spans).otherwise(F.aggregate(F.array_sort(spans), start, step, lambda a: a["acc"]))


def rebuild(text: Column, spans: Column, replacement) -> Column:
    """The text with each span replaced; all else is untouched. ``spans`` ascend and do not overlap."""
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        kept = F.substring(text, a["pos"] + 1, s["start"] - a["pos"])
        return F.struct(s["end"].alias("pos"), F.concat(a["out"], kept, replacement(s)).alias("out"))

    done = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["pos"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 < e2) & (s2 < e1)


def exploded(df, array: Column, *keep, name: str = "s"):
    """A row per element. An inner explode lets the optimizer infer a filter on the array's size and push it below the
    projection that makes the array, which would then be computed twice; nulls of the outer form go afterwards."""
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())
