"""Operator 2, exact dedup: skew-safe combining, DataFrame functions only.

1. Deduplicate locally: the map side of a grouping by (salt, digest, text).
2. Merge salted digest groups: the reduce side of that grouping; the salt comes from the row's id, so a
   group that holds a third of all rows is spread over every task.
3. Combine the salt winners globally: at most one row a salt for each text, grouped by (digest, text).
Full texts are compared at every stage: a digest alone never decides that two texts are equal.

Defined cases: a null text counts as empty; null ids lose to any id, and a group of null ids keeps null;
rows repeated with the same id are one document, so all of them carry kept = true in `assign`, and
`survivors` returns one of them, chosen by a hash of their other columns but those that hold maps; an empty table gives
an empty result; other columns of the input are never read by `assign` and are carried as they are by `survivors`,
whatever their names and types. Rows without an id share a salt for each text: combining before the shuffle leaves
one row a task of them, and the join back to rows is a plain one, whose skewed side AQE splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowsmith.llm.common import materialize, shuffle_partitions


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _salts(spark: SparkSession, salts: int | None) -> int:
    return salts or max(32, shuffle_partitions(spark))


def _keyed(docs: DataFrame, id_col: str, text_col: str, normalise, digest, salts: int) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return (
        docs.select(F.col(f"`{id_col}`").alias("_id"), (normalise(text) if normalise else text).alias("_text"))
        .withColumn("_digest", digest(F.col("_text")))
        .withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int"))
    )


def assign(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    digest: Callable[[Column], Column] = sha256,
    salts: int | None = None,
) -> DataFrame:
    """One row per row of docs: id_col, keep_id (largest id of the equal texts), group_size, kept, digest (binary)."""
    spark = docs.sparkSession
    keyed = _keyed(docs, id_col, text_col, normalise, digest, _salts(spark, salts))
    winners = keyed.groupBy("_salt", "_digest", "_text").agg(F.max("_id").alias("_top"), F.count("*").alias("_n"))
    classes = (
        winners.repartition("_digest")
        .groupBy("_digest", "_text")
        .agg(F.max("_top").alias("keep_id"), F.sum("_n").alias("group_size"), F.collect_list("_salt").alias("_at"))
        .withColumn("_same", F.count("*").over(Window.partitionBy("_digest")))
    )
    # A row of (salt, digest) per winner; the text goes along only where a digest stands for several texts.
    homes = materialize(
        spark,
        classes.select(
            F.explode("_at").alias("_salt"), "_digest", "keep_id", "group_size",
            F.when(F.col("_same") > 1, F.col("_text")).alias("_clash"),
        ),
        "dedup",
    )
    plain = homes.filter("_clash is null").drop("_clash")
    out = keyed.select("_id", "_salt", "_digest").join(plain, ["_salt", "_digest"])
    if not homes.filter("_clash is not null").isEmpty():
        clash = homes.filter("_clash is not null").withColumnRenamed("_clash", "_text")
        out = out.unionByName(keyed.join(clash, ["_salt", "_digest", "_text"]).drop("_text"))
    return out.select(
        F.col("_id").alias(id_col), "keep_id", "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_digest").alias("digest"),
    )


def survivors(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    digest: Callable[[Column], Column] = sha256,
    salts: int | None = None,
) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts, the row with the largest id.

    The same three stages, but the winner's other columns travel with it, so nothing is joined back.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rest = [f for f in docs.schema.fields if f.name != text_col]
    hashed = [F.col(f"`{f.name}`") for f in rest if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    # what survives of a group, and by which order: the id first, then as defined for rows that share it
    row = F.struct(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(rest)], F.col(f"`{text_col}`").isNotNull().alias("has"), *([text.alias("raw")] if normalise else []))
    by = F.struct(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").isNotNull().alias("has"), F.xxhash64(*hashed).alias("h"))
    keyed = docs.select(row.alias("_row"), by.alias("_by"), (normalise(text) if normalise else text).alias("_text"))
    keyed = keyed.withColumn("_digest", digest(F.col("_text"))).withColumn(
        "_salt", F.pmod(F.xxhash64("_by.id"), F.lit(_salts(spark, salts))).cast("int")
    )
    best = (F.max_by("_row", "_by").alias("_row"), F.max("_by").alias("_by"))
    winners = keyed.groupBy("_salt", "_digest", "_text").agg(*best)
    kept = winners.repartition("_digest").groupBy("_digest", "_text").agg(*best)
    of = F.col("_row").getField
    place = {f.name: i for i, f in enumerate(rest)}
    return kept.select(
        *[F.when(of("has"), of("raw") if normalise else F.col("_text")).alias(c) if c == text_col else of(f"c{place[c]}").alias(c) for c in docs.columns]
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
