"""A training-corpus pipeline over `documents`: quality, exact copies, near copies, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
stage's docs; all but the last return the columns of docs. Decisions take effect: what a stage rejects is gone,
and what the mix repeats is there that often.

Defined cases are those of the operators; rows that share an id are decided on together by the stages
`near_duplicates` and `mix`, and null ids count as one such id. The columns of docs travel in one struct, so none of
them is read or replaced by what a stage makes, whatever its name; the last stage takes four of them.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.llm import bpe, exact_dedup, mixing, ngram_join, quality
from rowsmith.llm.common import materialize, noting, release, ship

#: Models and iterations have no SQL form; tests/llm compares the stages with brute force instead.
ORACLE_SQL = None


#: Tables that the latest stage left for its result to be read from.
_left: list[DataFrame] = []


def _stage(f):
    """A stage whose tables go when the next one begins: its result was written by then, as the next one's docs."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str, **options) -> DataFrame:
        release(*_left)
        _left.clear()
        with noting(_left):
            return f(spark, docs, sf_dir, **options)

    return run


def _packed(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


@_stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose Kneser-Ney perplexity is not above their threshold."""
    ship(spark)
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.survivors(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id."""
    ship(spark)
    groups = ngram_join.similar(docs)
    stays = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stays")).distinct()
    return _unpacked(_packed(docs).join(stays, F.col("row.doc_id").eqNullSafe(F.col("stays")), "left_semi"), docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as entropy balancing towards the sources' targets takes them."""
    copies = mixing.mix(docs).groupBy(F.col("doc_id").alias("id")).agg(F.max("copies").alias("copies"))
    taken = _packed(docs).join(copies.filter("copies > 0"), F.col("row.doc_id").eqNullSafe(F.col("id")))
    return _unpacked(taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")), docs)


@_stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and the checksums of the ids and of their decoded text."""
    ship(spark)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, keep_decoded=False, keep_text=False)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(spark, stage(spark, docs, sf_dir), f"stage-{name}")
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
