"""Mixing sources to target weights by hash-threshold histograms.

Each document has a fixed hash. Per source, sizes are summed by hash bucket, and the bucket in
which a budget ends is cut into finer buckets until it holds one hash. The documents below that
hash make up the budget, so nothing is sorted and a larger budget keeps all that a smaller one
takes. A source whose target passes its size is taken whole as often as it fits, and the rest
by threshold. The hash covers key, size and content, so only equal documents share one; of those on
the threshold as many are taken as the target asks for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.llm.common import HASH_BITS, seeded_hash, stored

#: Bits of the hash that one histogram tells apart: at most 4096 sums per source and budget.
STEP_BITS = 12


def source_targets(sizes: DataFrame, weights: Sequence[int], limit: int) -> DataFrame:
    """`target` per row of `sizes` (source, source_size), one row per source.

    Sources in code point order, null last, take the weights in turn. All sizes are shared by
    weight; no target passes `limit` times its source's size, and what is over goes to the other
    sources by weight. Where a source is full depends only on limit * size / weight, so in that
    order the full sources come first and one pass of running sums finds them.
    """
    every = Window.partitionBy()
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_source) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), place + 1)
    fill = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    past = fill.rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("_weight", weight.cast("double"))
        .withColumn("_cap", (F.col("source_size") * limit).cast("double"))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_all", F.sum("source_size").over(every).cast("double"))
        .withColumn("_left", F.col("_all") - F.coalesce(F.sum("_cap").over(past), F.lit(0.0)))
        .withColumn("_open", F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(past), F.lit(0.0)))
        .withColumn("_full", F.col("_cap") * F.col("_open") <= F.col("_left") * F.col("_weight"))
        .withColumn("_free", F.col("_all") - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(every))
        .withColumn("_share", F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_weight"))).over(every))
        .withColumn(
            "target",
            F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_free") * F.col("_weight") / F.col("_share")),
        )
        .select("source", "source_size", "target")
    )


def thresholds(
    sizes: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    limit: int = 3,
    budgets: Sequence[float] = (1.0,),
) -> DataFrame:
    """One row per source and budget: source_size, target, whole, bound, ties.

    `sizes` holds source, size and hash, one row per document; documents of one hash are of one size. A
    document of the source is in budget b (that share of the target) `whole` times, and once more if its
    hash is under `bound` or it is one of `ties` documents whose hash is the bound. That sum is the nearest to what
    is left of the target after the whole turns (the lower one when two are as near).
    """
    totals = stored(
        source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, limit)
    )
    budget = F.explode(F.array(*[F.lit(float(b)) for b in budgets]))
    wanted = (
        totals.withColumn("budget", budget)
        .withColumn("_goal", F.col("target") * F.col("budget"))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("_goal") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("_rest", F.col("_goal") - F.col("whole") * F.col("source_size"))
    )
    state = wanted.withColumn("_prefix", F.lit(0).cast("long")).withColumn("_under", F.lit(0).cast("long"))
    keys = ["source", "budget"]
    kept = ["source_size", "target", "whole", "_rest"]
    done, bits = [], 0
    while bits < HASH_BITS:
        left, bits = HASH_BITS - bits, min(HASH_BITS, bits + STEP_BITS)
        s = state.withColumnsRenamed({"source": "_source"})
        inside = sizes.withColumn("_in", F.shiftright("hash", left)).join(
            s, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_in") == F.col("_prefix"))
        )
        histogram = inside.groupBy(*keys, *kept, "_under", F.shiftright("hash", HASH_BITS - bits).alias("_bin")).agg(
            F.sum("size").alias("_sum"), F.min("hash").alias("_low"), F.max("hash").alias("_high"), F.count(F.lit(1)).alias("_n")
        )
        run = Window.partitionBy(*keys).orderBy("_bin")
        cut = (
            histogram.withColumn("_upto", F.col("_under") + F.sum("_sum").over(run))
            .filter(F.col("_upto") > F.col("_rest"))
            .withColumn("_first", F.row_number().over(run))
            .filter("_first = 1")
        )
        state = stored(
            cut.select(*keys, *kept, "_low", "_high", "_sum", "_n", F.col("_bin").alias("_prefix"),
                       (F.col("_upto") - F.col("_sum")).alias("_under"))
        )
        done.append(state.filter("_low = _high"))
        state = state.filter("_low < _high").select(*keys, *kept, "_prefix", "_under")
        if state.isEmpty():
            break
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    one, under, rest = F.col("_sum") / F.col("_n"), F.col("_under"), F.col("_rest")
    fit = F.floor((rest - under) / one)
    fit = fit + (2 * (under + fit * one) + one < 2 * rest).cast("long")
    whole_bin = fit >= F.col("_n")
    found = found.select(
        F.col("source").alias("_source"), F.col("budget").alias("_budget"),
        F.when(whole_bin, F.col("_low") + 1).otherwise(F.col("_low")).alias("bound"),
        F.when(whole_bin, 0).otherwise(fit).cast("long").alias("ties"),
    )
    # A source without any size has no cut: its documents stay out.
    return wanted.join(
        found, F.col("source").eqNullSafe(F.col("_source")) & (F.col("budget") == F.col("_budget")), "left"
    ).select("source", "budget", "source_size", "target", "whole", F.coalesce("bound", F.lit(0)).alias("bound"),
             F.coalesce("ties", F.lit(0)).alias("ties"))


def _first_ties(edge: DataFrame) -> DataFrame:
    """`edge` (stored rows with source and ties) with `_taken`: true for `ties` rows of each source.

    Rows are numbered inside the parts of the table, and parts by their counts, so no source meets in one task.
    """
    edge = stored(edge).withColumn("_place", F.monotonically_increasing_id())
    edge = edge.withColumn("_part", F.shiftright("_place", 33))
    past = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = edge.groupBy("source", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = parts.select(
        F.col("source").alias("_source"), F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_before")
    )
    own = F.row_number().over(Window.partitionBy("source", "_part").orderBy("_place"))
    numbered = edge.withColumn("_own", own).join(before, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_of")))
    return numbered.withColumn("_taken", F.col("_before") + F.col("_own") <= F.col("ties"))


def _mixed(docs: DataFrame, size, key: str, source: str, weights, limit: int, budget: float, seed: str, mark) -> DataFrame:
    """row (all columns of `docs`), and mix_size, mix_source_size, mix_target, mix_copies beside it."""
    none = F.lit("null")
    words = F.coalesce(size.cast("long"), F.lit(0).cast("long"))
    content = none if mark is None else F.coalesce(mark.cast("string"), none)
    name = F.concat_ws(":", F.coalesce(F.col(key).cast("string"), none), words.cast("string"), content)
    measured = docs.select(
        F.struct("*").alias("row"), words.alias("mix_size"), F.col(source).alias("source"), seeded_hash(name, seed).alias("hash")
    )
    slim = stored(measured.select("source", F.col("mix_size").alias("size"), "hash"))
    plan = stored(thresholds(slim, weights, limit, (budget,))).select(
        F.col("source").alias("_source"), F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"), "whole", "bound", "ties",
    )
    out = ["row", "mix_size", "mix_source_size", "mix_target", "mix_copies"]
    joined = measured.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    under = F.col("whole") + (F.col("hash") < F.col("bound")).cast("long")
    if plan.filter("ties > 0").isEmpty():
        return joined.withColumn("mix_copies", under).select(*out)
    on_edge = (F.col("hash") == F.col("bound")) & (F.col("ties") > 0)
    edge = _first_ties(joined.filter(on_edge)).withColumn("mix_copies", F.col("whole") + F.col("_taken").cast("long"))
    return joined.filter(~on_edge).withColumn("mix_copies", under).select(*out).unionByName(edge.select(*out))


def mix(
    docs: DataFrame,
    size,
    key: str = "doc_id",
    source: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    limit: int = 3,
    budget: float = 1.0,
    seed: str = "mix",
    mark: Column | None = None,
) -> DataFrame:
    """The documents with `mix_size`, `mix_source_size`, `mix_target` and `mix_copies` added.

    `size` is a column expression of whole numbers (null counts as 0). `mix_copies` says how
    often the mix takes the document, 0 included. `mark` is a column that tells rows of one key apart, such as
    a hash of the text. Of rows alike in key, size and mark some may be taken once more than the others; a null source is a
    source of its own; an empty table gives no rows. All other columns pass through; columns of
    these four names are replaced.
    """
    added = ["mix_size", "mix_source_size", "mix_target", "mix_copies"]
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in added]
    return _mixed(docs, size, key, source, weights, limit, budget, seed, mark).select(*kept, *added)


def repeated(
    docs: DataFrame,
    size,
    key: str = "doc_id",
    source: str = "source",
    weights: Sequence[int] = (5, 2, 1),
    limit: int = 3,
    budget: float = 1.0,
    seed: str = "mix",
    mark: Column | None = None,
) -> DataFrame:
    """Each document of `docs` as often as the mix takes it, with its own columns only."""
    mixed = _mixed(docs, size, key, source, weights, limit, budget, seed, mark).filter("mix_copies > 0")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))
    return mixed.select("row", copies.alias("_copy")).select("row.*")
