"""Operator 6, mixing sources to target weights: entropy balancing, DataFrame functions only.

Each source has a word target. Of all rates r >= 0 with r <= `most` and sum(size * r) = target, entropy
balancing takes the ones nearest to 1 in relative entropy: r = min(most, exp(lam * x)) with x = size over the
source's mean size. The convex dual has one unknown `lam` a source; Newton steps (kept inside a bracket) solve
all sources at once, each step being one aggregation over the (source, size) histogram. Rates become copies by
cumulative rounding down the sizes, so a source misses its target by at most about one of its documents.

Hot sources cost nothing special: the histogram is pre-aggregated map-side, prefix sums run over blocks of
sizes, and rows are ranked inside (source, size, salt) cells, so equal copies that hold a third of all rows
are spread over every salt; a cell that rows of one id fill is cut by their places. Sources may be many: their
order and the level of the targets come from prefix sums over ranges of them.

Defined cases: a null text has size 0; a source of size 0 has target 0 and takes nothing; a null source is a
source of its own, last in order; repeated rows are separate rows; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowsmith.llm.common import SUBS, WORD, materialize, parts_of_hot, running, shuffle_partitions

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
#: Copies are summed as integers of this unit, so prefix sums don't depend on their order.
UNIT = 1 << 24
BLOCK = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, s, n_docs, source_size, target): targets stop at `most` x size, the excess is reshared by weight.

    Resharing until no target is above its stop settles where target = min(stop, level * weight); the level is
    found by a prefix sum over the sources ordered by stop / weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    per = running(per, [F.col("source").asc_nulls_last()], {"s": F.lit(1).cast("long")})
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("stop", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("stop") / F.col("w"))
    per = materialize(per.sparkSession, running(per, ["ratio", "s"], {"stops": F.col("stop"), "weights": F.col("w")}), "mix-levels")
    size, weight = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    level = (F.lit(share * size) - F.col("stops")) / (F.lit(weight) - F.col("weights"))
    level = per.filter(level <= F.col("ratio")).agg(F.min_by(level, F.struct("ratio", "s"))).first()[0]
    target = F.col("stop") if level is None else F.least(F.col("stop"), F.lit(level) * F.col("w"))
    return per.select("source", "s", "n_docs", "source_size", target.cast("double").alias("target"))


def solve(spark: SparkSession, cells: DataFrame, per: DataFrame, most: float, tolerance: float = 1e-10, steps: int = 60) -> DataFrame:
    """(s, lam) for every source: Newton on log(taken) - log(target), bisecting when a step leaves its bracket.

    cells: (s, x, size, n). lam is null where nothing is to be taken and large where everything is.
    """
    edge = math.log(most)
    full = F.col("target") >= F.col("source_size") * F.lit(most) * (1 - 1e-12)
    state = per.select(
        "s", "target", "n_docs",
        F.when(F.col("target") <= 0, F.lit(None)).when(full, F.lit(1e9)).otherwise(F.lit(0.0)).cast("double").alias("lam"),
        F.lit(-1e4).alias("lo"), F.lit(1e4).alias("hi"), ((F.col("target") <= 0) | full).alias("done"),
    )
    state = materialize(spark, state, "mix-dual")
    for _ in range(steps):
        if state.filter("not done").isEmpty():
            break
        at = cells.join(state.filter("not done").select("s", "lam"), "s")
        u = F.col("lam") * F.col("x")
        rate = F.when(u >= edge, F.lit(most)).otherwise(F.exp(u))
        words = F.col("n") * F.col("size")
        sums = at.groupBy("s").agg(
            F.sum(words * rate).alias("taken"),
            F.sum(F.when(u < edge, words * F.col("x") * rate).otherwise(0.0)).alias("slope"),
        )
        miss = F.log("taken") - F.log("target")
        lo = F.when(miss < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(miss < 0, F.col("hi")).otherwise(F.col("lam"))
        step = F.col("lam") - miss * F.col("taken") / F.col("slope")
        middle = (F.col("lo2") + F.col("hi2")) / 2
        moved = (
            state.join(sums, "s", "left")
            .withColumn("miss", miss).withColumn("lo2", lo).withColumn("hi2", hi).withColumn("step", step)
        )
        near = F.abs("miss") < tolerance
        inside = F.col("step").isNotNull() & ~F.isnan("step") & (F.col("step") > F.col("lo2")) & (F.col("step") < F.col("hi2"))
        state = materialize(spark, moved.select(
            "s", "target", "n_docs",
            F.when(F.col("done") | near, F.col("lam")).when(F.col("taken").isNull(), F.col("lam"))
            .when(inside, F.col("step")).otherwise(middle).alias("lam"),
            F.col("lo2").alias("lo"), F.col("hi2").alias("hi"),
            (F.col("done") | F.coalesce(near, F.lit(True)) | (F.col("hi2") - F.col("lo2") < 1e-13)).alias("done"),
        ), "mix-dual")
    return state.select("s", "lam")


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights=WEIGHTS, share: float = SHARE, most: float = MOST, salts: int | None = None,
) -> DataFrame:
    """One row per row of docs: id_col, source, size, source_size, target, rate, copies, taken."""
    spark = docs.sparkSession
    salts = salts or max(16, shuffle_partitions(spark))
    draw = F.xxhash64(F.lit("copies"), F.col("_id"))
    sizes = materialize(spark, docs.select(
        F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").alias("source"),
        word_count(F.col(f"`{text_col}`")).alias("size"),
    ).withColumn("draw", draw).withColumn("salt", F.pmod(F.shiftright("draw", 17), F.lit(salts)).cast("int"))
        .withColumn("position", F.monotonically_increasing_id()), "mix-sizes")
    # rows of one id and size are alike in what they get, so those of a cell that they fill may be cut anyhow
    sizes = parts_of_hot(sizes, ["source", "size", "salt"]).withColumn("salt", F.col("salt") * SUBS + F.col("sub")).drop("sub", "position")
    per = materialize(spark, targets(sizes, weights, share, most), "mix-targets")
    grain = sizes.groupBy("source", "size", "salt").agg(F.count("*").alias("n"))
    known = per.withColumn("mean", F.col("source_size") / F.col("n_docs"))
    on = grain["source"].eqNullSafe(known["source"])
    fine = materialize(spark, grain.join(known, on).select(
        "s", "size", "salt", "n", F.when(F.col("mean") > 0, F.col("size") / F.col("mean")).otherwise(0.0).alias("x"),
    ), "mix-cells")
    cells = materialize(spark, fine.groupBy("s", "size", "x").agg(F.sum("n").alias("n")), "mix-histogram")
    lam = solve(spark, cells, per, most)
    # Cumulative rounding, largest documents first: blocks of sizes, then cells inside a block.
    u = F.col("lam") * F.col("x")
    rate = F.when(F.col("lam").isNull() | (F.col("size") == 0), 0.0).when(u >= math.log(most), F.lit(most)).otherwise(F.exp(u))
    rated = fine.join(lam, "s").withColumn("rate", rate).withColumn("e", F.round(F.col("n") * F.col("rate") * UNIT).cast("long"))
    rated = rated.withColumn("block", F.floor(F.col("size") / BLOCK))
    past = Window.partitionBy("s").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rated.groupBy("s", "block").agg(F.sum("e").alias("e")).select(
        "s", "block", F.coalesce(F.sum("e").over(past), F.lit(0)).alias("before"))
    inside = Window.partitionBy("s", "block").orderBy(F.desc("size"), "salt").rowsBetween(Window.unboundedPreceding, 0)
    whole = lambda c: F.floor((c + UNIT // 2) / F.lit(UNIT))
    plan = (
        rated.join(blocks, ["s", "block"])
        .withColumn("cum", F.col("before") + F.sum("e").over(inside))
        .withColumn("c", whole(F.col("cum")) - whole(F.col("cum") - F.col("e")))
        .select("s", "size", "salt", "rate", F.floor(F.col("c") / F.col("n")).alias("base"), (F.col("c") % F.col("n")).alias("extra"))
    )
    tagged = sizes.alias("d").join(
        per.select(F.col("source").alias("source_"), "s", "source_size", "target"), F.col("source").eqNullSafe(F.col("source_"))
    ).drop("source_")
    place = F.row_number().over(Window.partitionBy("s", "size", "salt").orderBy("draw", "_id"))
    out = tagged.withColumn("place", place).join(plan, ["s", "size", "salt"])
    copies = (F.col("base") + F.when(F.col("place") <= F.col("extra"), 1).otherwise(0)).cast("int")
    return out.select(
        F.col("_id").alias(id_col), "source", "size", "source_size", "target", "rate",
        copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"),
    )


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
