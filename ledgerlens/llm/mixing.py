"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

DataFrame operations only.  Sizes are summed per source; the water level that
shares the budget by weight while no source exceeds ``max_epochs`` of its size
comes from prefix sums over the sources in the order in which they reach their
cap.  That level is the fixed point of clamping sources and resharing their
excess until none is above its cap.

A source's target is then met by ``whole`` repetitions of every document and a
fractional one that covers the documents first in a seeded order, up to the
word where the target is reached.  The place in that order where a source's
fraction ends is found by two levels of bucket sums, so that no task sorts a
source: only the documents of one bucket in 2**20 are ordered among themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import WORD_PATTERN, own_prefix, prepare, stage

BUCKETS = 1024


def weights_by_rank(cycle: tuple[float, ...] = (3, 1, 2)) -> Callable[[Column], Column]:
    """Weights that repeat over the sources in code point order, null last."""
    values = F.array(*[F.lit(float(w)) for w in cycle])
    return lambda rank: F.element_at(values, ((rank - 1) % len(cycle) + 1).cast("int"))


def water_fill(sources: DataFrame, weight: Callable[[Column], Column], share: float, max_epochs: float) -> DataFrame:
    """Targets per source: (source, source_size) -> plus weight, target.

    The targets sum to ``share`` times all sizes, or less when every source is
    at its cap of ``max_epochs`` times its size.
    """
    named = Window.orderBy(F.asc_nulls_last("source"))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.asc_nulls_last("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ordered = (
        sources.withColumn("weight", weight(F.row_number().over(named)))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                    / F.sum("weight").over(onward))
    )
    # The first source, in this order, that the level does not fill sets the level for all.
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return ordered.withColumn("water", level).select(
        "source", "source_size", "weight",
        F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("water"))).alias("target"))


def mix_sources(
    docs: DataFrame, weight: Callable[[Column], Column] | None = None, share: float = 1.5,
    max_epochs: float = 2.0, seed: int = 17,
) -> DataFrame:
    """How many words the mix takes from each document.

    Returns a row per input row: doc_id, text_hash, source, size (words of the
    text; null and empty texts have 0), source_size, target, whole (full
    repetitions), extra (words of the fractional one, counted from the text's
    start), taken.  A source without words has target 0.  Null sources form one
    source.  Rows that agree in doc_id, text and source are interchangeable.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    words = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    sized = stage(
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", words.alias("size"))
        .withColumn("place", F.xxhash64(F.lit(seed), "doc_id", "text_hash"))
        .withColumn("b1", F.shiftrightunsigned("place", 54))
        .withColumn("b2", F.shiftrightunsigned("place", 44).bitwiseAND(F.lit(BUCKETS - 1))),
        "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = water_fill(totals, weight or weights_by_rank(), share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = stage(
        targets.withColumn("whole", F.floor(epochs))
        .withColumn("left", F.rint(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")),
        "mix-targets")
    plan = _boundary(sized, plan, "b1", [])
    plan = _boundary(sized, plan, "b2", ["b1"])
    rows = sized.join(_renamed(plan), F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    at_end = (F.col("b1") == F.col("p_b1")) & (F.col("b2") == F.col("p_b2"))
    inside = (F.col("b1") < F.col("p_b1")) | ((F.col("b1") == F.col("p_b1")) & (F.col("b2") < F.col("p_b2")))
    order = Window.partitionBy("source").orderBy("place", F.asc_nulls_last("doc_id"), "text_hash")
    so_far = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = rows.filter(at_end).withColumn("extra", F.greatest(F.lit(0), F.least("size", F.col("left") - so_far)))
    clear = rows.filter(~at_end).withColumn("extra", F.when(inside, F.col("size")).otherwise(F.lit(0)))
    return clear.unionByName(ends).select(
        "doc_id", "text_hash", "source", "size", "source_size", "target", "whole", F.col("extra").cast("long").alias("extra"),
        (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"))


def _renamed(plan: DataFrame) -> DataFrame:
    return plan.withColumnsRenamed({c: f"p_{c}" for c in ("source", "b1", "b2") if c in plan.columns}).drop("weight")


def _boundary(sized: DataFrame, plan: DataFrame, bucket: str, within: list[str]) -> DataFrame:
    """Find per source the bucket in which its fraction ends; ``left`` becomes what is left for that bucket."""
    keys = F.col("source").eqNullSafe(F.col("p_source"))
    for outer in within:
        keys = keys & (F.col(outer) == F.col(f"p_{outer}"))
    sums = sized.join(_renamed(plan).select("p_source", *[f"p_{b}" for b in within]), keys)
    sums = sums.groupBy("source", bucket).agg(F.sum("size").alias("amount"))
    order = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("amount").over(order), F.lit(0)))
    sums = sums.select(F.col("source").alias("p_source"), bucket, "amount", "before")
    found = plan.join(sums, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    # The last bucket that begins before the fraction is used up (the first bucket always does).
    ends = found.filter((F.col("before") <= F.col("left"))).groupBy(*plan.columns).agg(
        F.max(F.struct(bucket, "before")).alias("at"))
    return stage(
        ends.withColumn(bucket, F.col("at")[bucket]).withColumn("left", F.col("left") - F.col("at")["before"]).drop("at"),
        f"mix-{bucket}")


def apply_mix(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """The mixed documents: each text as often as the mix repeats it, its last repetition cut to ``extra`` words.

    Columns are those of ``docs``, of any name; where there is ``n_chars``, it follows the text.
    Rows that agree in doc_id, text and source repeat alike, as the one of them that the mix takes
    most of: with such rows, more words may come out than ``taken`` adds up to.
    """
    own = own_prefix(docs)
    plan = taken.filter("taken > 0").select(
        F.col("doc_id").alias(f"{own}id"), F.col("text_hash").alias(f"{own}text"), F.col("source").alias(f"{own}source"),
        F.col("whole").alias(f"{own}whole"), F.col("extra").alias(f"{own}extra"), F.col("size").alias(f"{own}size"))
    # Rows equal in all three columns share one plan row; the repetitions of each are the same or differ by a fraction.
    plan = plan.groupBy(f"{own}id", f"{own}text", f"{own}source").agg(
        F.max(f"{own}whole").alias(f"{own}whole"), F.max(f"{own}extra").alias(f"{own}extra"), F.max(f"{own}size").alias(f"{own}size"))
    keyed = docs.withColumn(f"{own}hash", F.xxhash64("text"))
    joined = keyed.join(plan, F.col("doc_id").eqNullSafe(F.col(f"{own}id")) & (F.col(f"{own}hash") == F.col(f"{own}text"))
                        & F.col("source").eqNullSafe(F.col(f"{own}source")))
    copies = F.col(f"{own}whole").cast("int") + (F.col(f"{own}extra") > 0).cast("int")
    rows = joined.withColumn(f"{own}copy", F.explode(F.sequence(F.lit(1), copies)))
    partial = (F.col(f"{own}copy") > F.col(f"{own}whole")) & (F.col(f"{own}extra") < F.col(f"{own}size"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD_PATTERN})"), F.lit(1))
    text = F.when(partial, F.array_join(F.slice(words, 1, F.col(f"{own}extra").cast("int")), " ")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(partial, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
