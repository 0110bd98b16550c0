"""Mixing of sources to target weights by weighted fair queueing (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Ranges of virtual finish time (an eighth of a unit holds BINS / 64 of them): only the one with the cut is put in order.
BINS = 1 << 16


def word_count(text: F.Column) -> F.Column:
    """Number of maximal runs of characters that are not ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget_ratio: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """Targets by water-filling: ``min(max_epochs * source_size, level * weight)`` that sum to the whole budget.

    ``sizes`` has a row per source (source, source_size). Sources fill up in the order of capacity over weight, so the
    level follows from two running sums; it is the fixed point of resharing any excess by weight.
    """
    everywhere = Window.partitionBy()
    ranked = sizes.withColumn("__k", F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("__k"), F.lit(len(weights))).cast("int") + 1)
    r = ranked.withColumn("__w", weight).withColumn("__cap", F.col("source_size") * F.lit(max_epochs))
    order = Window.orderBy(F.col("__cap") / F.col("__w"), "__k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everywhere).cast("double") * F.lit(budget_ratio)
    level = (budget - F.coalesce(F.sum("__cap").over(before), F.lit(0)).cast("double")) / F.sum("__w").over(after)
    r = r.withColumn("__level", level)
    fits = F.when(F.col("__level") * F.col("__w") <= F.col("__cap"), F.col("__level"))
    r = r.withColumn("__first", F.max(fits).over(everywhere))  # later sources that fit would fill up less
    target = F.when(F.col("__first").isNull(), F.col("__cap").cast("double")).otherwise(F.least(F.col("__cap").cast("double"), F.col("__first") * F.col("__w")))
    return r.select("source", "source_size", target.alias("target"))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, budget_ratio: float = 1.5, max_epochs: int = 2, seed: str = "mix") -> DataFrame:
    """Weighted fair queueing over shuffled documents: one row per document.

    Columns ``id_col, size, source, source_size, target, servings, taken, finish`` (of the first serving), ``round`` (the
    time between servings) and a key of the row. Every source is shuffled by a keyed hash of
    the id; the virtual finish time of a document's e-th serving is
    ``(e * source_size + source words up to and with it) / target``. The servings of all sources, ordered by finish time,
    are taken while their running sum stays within the budget of ``budget_ratio`` times all words.

    A hot source never meets in one task: its shuffled order is cut into 4,096 hash ranges whose sums are scanned first,
    and the global order into ``BINS`` ranges of finish time of which only the one with the cut is put in full order.
    What the driver sees is that cut: one bin and one position.

    A null text has size 0, a null source is a source of its own that ranks last, a null id is hashed as the empty
    string. Ties in finish time fall to source, hash, id and serving. Rows that repeat an id each count. A source of size
    0 has target 0, and its documents take 0. A very long text is one document like others. An empty table gives an empty
    result. Other columns are ignored.
    """
    key = F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    docs = df.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__src"), word_count(F.col(text_col)).alias("size"), F.sha2(key, 256).alias("__h"), *row_key(df, id_col, text_col, source_col))
    docs = docs.withColumn("__b", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"))
    cells = docs.groupBy(F.col("__src").alias("source"), "__b").agg(F.sum("size").alias("__c"))
    targets = source_targets(cells.groupBy("source").agg(F.sum("__c").alias("source_size")), weights, budget_ratio, max_epochs).withColumnRenamed("source", "__tsrc")
    scan = Window.partitionBy("source").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__before", F.coalesce(F.sum("__c").over(scan), F.lit(0)))
    cells = cells.join(targets, F.col("source").eqNullSafe(F.col("__tsrc"))).select("source", F.col("__b").alias("__bk"), "__before", "source_size", "target")
    within = Window.partitionBy("__src", "__b").orderBy("__h", "__id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = docs.withColumn("__in", F.sum("size").over(within))
    placed = placed.join(cells, F.col("__src").eqNullSafe(F.col("source")) & (F.col("__b") == F.col("__bk")))
    placed = materialize(placed.select("__id", "source", "size", "__h", "__k1", "__k2", "source_size", "target", (F.col("__in") + F.col("__before")).alias("__cum")), "mixing")

    def finish(serving) -> F.Column:
        return F.when(F.col("target") > 0, (F.lit(serving) * F.col("source_size") + F.col("__cum")).cast("double") / F.col("target"))

    def bin_of(time: F.Column) -> F.Column:
        return F.least(F.floor(time * F.lit(BINS / 8.0)), F.lit(BINS)).cast("int")

    served = placed.select("*", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("__e"))
    served = served.withColumn("__v", F.when(F.col("target") > 0, (F.col("__e") * F.col("source_size") + F.col("__cum")).cast("double") / F.col("target")))
    served = served.withColumn("__bin", bin_of(F.col("__v"))).where(F.col("__bin").isNotNull())
    cut_bin, cut = BINS + 1, None
    sums = sorted(served.groupBy("__bin").agg(F.sum("size").alias("s")).collect())  # at most BINS + 1 rows
    budget = sum(s for _, s in sums) / max_epochs * budget_ratio
    before = 0
    for b, s in sums:
        if before + s > budget:
            cut_bin = b
            break
        before += s
    place = F.struct(F.col("__v"), F.coalesce(F.col("source"), F.lit("")).alias("s"), F.col("source").isNull().alias("n"), F.col("__h"), F.col("__id"), F.col("__e"))
    if cut_bin <= BINS:
        run = F.sum("size").over(Window.orderBy("__place").rowsBetween(Window.unboundedPreceding, 0))
        inside = served.where(F.col("__bin") == cut_bin).select("size", place.alias("__place")).withColumn("__run", run + F.lit(before))
        first_out = inside.where(F.col("__run") > F.lit(budget)).agg(F.min("__place").alias("p")).first()["p"]
        cut = F.struct(F.lit(first_out[0]), F.lit(first_out[1]), F.lit(first_out[2]), F.lit(first_out[3]), F.lit(first_out[4]).cast(dict(placed.dtypes)["__id"]), F.lit(first_out[5]))
    taken = F.lit(0)
    for e in range(max_epochs):
        v = finish(e)
        here = F.struct(v.alias("__v"), F.coalesce(F.col("source"), F.lit("")).alias("s"), F.col("source").isNull().alias("n"), F.col("__h"), F.col("__id"), F.lit(e).alias("__e"))
        inside_budget = bin_of(v) < cut_bin
        if cut is not None:
            inside_budget = inside_budget | ((bin_of(v) == cut_bin) & (here < cut))
        taken = taken + F.when(inside_budget, 1).otherwise(0)
    out = placed.withColumn("servings", taken.cast("int"))
    return out.select(F.col("__id").alias(id_col), "size", "source", "source_size", "target", "servings", (F.col("size") * F.col("servings")).alias("taken"), finish(0).alias("finish"), F.when(F.col("target") > 0, F.col("source_size") / F.col("target")).alias("round"), "__k1", "__k2")


def row_key(df: DataFrame, id_col: str, text_col: str, source_col: str) -> list[F.Column]:
    """Two hashes of a row's id, text and source, never null."""
    parts = [x for c in (id_col, source_col, text_col) for x in (F.col(c), F.col(c).isNull())]
    return [F.xxhash64(*parts).alias("__k1"), F.xxhash64(F.lit("2"), *parts).alias("__k2")]


def mixture(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``df``, all columns, each as often as it is served, range-sorted by finish time.

    Every serving has a finish time of its own, so that sources keep their shares anywhere in the mix. Rows are told apart
    by id, source and text; of rows that repeat all three one stands for all, with the servings of all.
    """
    plan = mix_sources(df, id_col, text_col, source_col, **options).where("servings > 0")
    each = F.transform(F.sequence(F.lit(0), F.col("servings") - 1), lambda e: F.col("finish") + e * F.col("round"))
    plan = plan.groupBy("__k1", "__k2").agg(F.flatten(F.collect_list(each)).alias("__f"))
    rows = df.select("*", *row_key(df, id_col, text_col, source_col)).dropDuplicates(["__k1", "__k2"]).join(plan, ["__k1", "__k2"])
    return rows.withColumn("__f", F.explode("__f")).orderBy("__f", "__k1", "__k2").drop("__k1", "__k2", "__f")
