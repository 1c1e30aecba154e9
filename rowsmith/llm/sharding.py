"""Operator 7, sharding: a consistent-hash ring with virtual nodes and bounded loads, DataFrame functions only.

The ring has 2**bits cells. Every shard owns `vnodes` arcs of it; a row's id falls into a cell and so an arc.
A shard holds a bounded number of rows; rows that an arc can't place in its full shard continue clockwise to
the next arc, and so on. The walk needs only the number of rows per arc: shards * vnodes numbers, fixed by the
parameters, whatever the data. Rows are then ranked cell by cell and read their shard and slot off the
resulting intervals, so no task sees more than one cell's rows at once, and a cell that rows of one id (or without one) fill is
cut by their places. A shard that joins the ring takes over
arcs of its own, and the others keep what still fits.

With `slack` 0 the loads are exact (`rows` law: counts at most one apart). With slack the bound is
ceil((1 + slack) * rows / shards).

Defined cases: a null text has size 1 and the checksum of the empty text; null ids are placed by their text's
checksum; repeated rows get slots of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowsmith.llm.common import materialize, parts_of_hot

SHARDS, VNODES, BITS = 8, 64, 16


def ring(shards: int, vnodes: int, bits: int) -> list[tuple[int, int, int]]:
    """Arcs (shard, first cell, last cell) in ring order: each ends at one of the shard's virtual nodes."""
    at: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            p = int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big") >> (64 - bits)
            while p in at:
                p = (p + 1) % (1 << bits)
            at[p] = s
    points = sorted(at)
    arcs = [(at[p], lo + 1, p) for lo, p in zip([-1, *points], points, strict=False)]
    if points[-1] < (1 << bits) - 1:  # past the last node the ring begins again
        arcs.append((at[points[0]], points[-1] + 1, (1 << bits) - 1))
    return arcs


def bounds(rows: int, shards: int, slack: float) -> list[int]:
    if slack:
        return [-int(-(1 + slack) * rows // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(owners: list[int], counts: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Intervals (arc, from rank, to rank, shard, first slot): ranks below `to` and not below `from` go there.

    Hop 0 offers each arc's rows to its own shard, hop h to the owner of the h-th arc clockwise; within a hop
    the arcs ask in ring order.
    """
    room, used, out = list(room), [0] * len(room), []
    done = [0] * len(counts)
    for hop in range(len(counts)):
        left = False
        for a, n in enumerate(counts):
            want = n - done[a]
            if not want:
                continue
            s = owners[(a + hop) % len(owners)]
            take = min(want, room[s])
            if take:
                out.append((a, done[a], done[a] + take, s, used[s]))
                room[s] -= take
                used[s] += take
                done[a] += take
            left |= done[a] < n
        if not left:
            break
    return out


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A local relation of plain integers; `rows` is bounded by the ring's parameters."""
    names = [x.split()[0] for x in schema.split(",")]
    rows = rows or [(-1,) * len(names)]
    listed = ", ".join("(" + ", ".join(f"{int(v)}L" for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {listed} AS t({', '.join(names)})")


def shard(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS,
    vnodes: int = VNODES, bits: int = BITS, slack: float = 0.0,
) -> DataFrame:
    """One row per row of docs: id_col, size (bytes + 1), text_crc32, shard, slot (gapless in a shard), arc (of the row's cell)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    # binary, so that a byte length and not a character count is meant
    keyed = docs.select(
        F.col(f"`{id_col}`").alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    point = F.xxhash64(F.lit("ring"), F.coalesce(F.col("_id").cast("string"), F.concat(F.lit("#"), F.col("text_crc32").cast("string"))))
    keyed = keyed.withColumn("point", point).withColumn("cell", F.shiftrightunsigned("point", 64 - bits))
    keyed = materialize(spark, keyed.withColumn("position", F.monotonically_increasing_id()), "shard-keys")
    keyed = parts_of_hot(keyed, ["cell"])

    arcs = ring(shards, vnodes, bits)
    cells = _values(spark, [(a, lo, hi) for a, (_, lo, hi) in enumerate(arcs)], "arc, lo, hi").select(
        "arc", F.explode(F.sequence("lo", "hi")).alias("cell"))
    filled = materialize(spark, keyed.groupBy("cell", "sub").agg(F.count("*").alias("n")).join(cells, "cell"), "shard-cells")
    per_arc = {r["arc"]: r["n"] for r in filled.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    counts = [per_arc.get(a, 0) for a in range(len(arcs))]
    owners = [s for s, _, _ in arcs]
    pieces = walk(owners, counts, bounds(sum(counts), shards, slack))
    plan = _values(spark, pieces, "arc, lo, hi, shard, first")
    before = Window.partitionBy("arc").orderBy("cell", "sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = filled.select("cell", "sub", "arc", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("cell", "sub").orderBy("point", "_id", "text_crc32", "size")) - 1
    ranked = keyed.withColumn("rank", rank).join(starts, ["cell", "sub"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = ranked.alias("r").join(
        F.broadcast(plan).alias("p"),  # at most two rows an arc and shard: bounded by the parameters
        (F.col("r.arc") == F.col("p.arc")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")),
    )
    return placed.select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
        (F.col("first") + F.col("rank") - F.col("lo")).cast("long").alias("slot"), F.col("r.arc").cast("int").alias("arc"),
    )


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
