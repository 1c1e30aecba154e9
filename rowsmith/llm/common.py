"""Helpers shared by the training-data operators: shared storage, held-out splits, components."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words everywhere in this subpackage: space, TAB, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or, on one machine, one of our own where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/checkpoints/rowsmith-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Lists that take note of the tables that are written.
_noting: list[list[DataFrame]] = []


@contextmanager
def noting(made: list[DataFrame]) -> Iterator[None]:
    """Adds the tables that `materialize` writes meanwhile to a list, for `release` when they are no longer read."""
    _noting.append(made)
    try:
        yield
    finally:
        _noting.remove(made)


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a table in the shared folder, which outlives any executor."""
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rowsmith_path = path
    for made in _noting:
        made.append(out)
    return out


def release(*tables: DataFrame | None) -> None:
    """Deletes tables that `materialize` wrote and that nothing will read again."""
    for df in tables:
        path = getattr(df, "_rowsmith_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Gives memory that large arrays have left in this process back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free is not None:
        free(0)


def from_most_frequent(counts: DataFrame, key: str, n: str, most: int) -> DataFrame:
    """Rows of the highest counts, about `most` at most: a histogram over eighths of powers of two finds where they begin.

    Of the first bin that doesn't fit whole, as many go along by their key's hash as there is room for, less a tenth.
    """
    level = F.floor(F.log2(n) * 8).cast("int")
    bins = sorted(((r["l"], r["k"]) for r in counts.groupBy(level.alias("l")).agg(F.count("*").alias("k")).collect()), reverse=True)
    total = 0
    for at, k in bins:
        if total + k > most:
            share = int(0.9 * (most - total) / k * (1 << 30))
            return counts.filter((level > at) | (level == at) & (F.pmod(F.xxhash64(F.lit("bin"), key), F.lit(1 << 30)) < share))
        total += k
    return counts


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package also where the driver found it through sys.path alone, and keeps
    the batches of texts that they get small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    # workers live on after a task: what they freed goes back to the system
    for name, value in (("ARROW_DEFAULT_MEMORY_POOL", "system"), ("MALLOC_ARENA_MAX", "2"), ("MALLOC_MMAP_THRESHOLD_", "4194304"), ("MALLOC_TRIM_THRESHOLD_", "8388608")):
        env.setdefault(name, value)
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def connected_components(spark: SparkSession, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (a, b: long): component is the smallest node reachable.

    Alternates large-star and small-star rounds until the edges are stars around each component's smallest node.
    Minima are pre-aggregated and written to the shared folder before they are joined, so both sides of a join
    are plain shuffles, which AQE splits where a hub holds many edges (or broadcasts, by their size on disk). No
    neighbourhood is ever gathered in one row; the number of rounds is logarithmic in the longest chain.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b")
    e = materialize(spark, pairs.distinct(), "cc")
    for _ in range(most_rounds):
        # done when every node is either the one end of stars or hangs on one star
        ends = e.select(F.col("a").alias("n"), F.lit(0).alias("hangs")).unionByName(e.select(F.col("b").alias("n"), F.lit(1).alias("hangs")))
        mixed = ends.groupBy("n").agg(F.sum("hangs").alias("k"), F.min("hangs").alias("low")).filter("k > 1 or k = 1 and low = 0")
        if mixed.isEmpty():
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(spark, both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "cc-low")
        # large star: a node's larger neighbours move to the smallest of its neighbours and itself
        large = materialize(spark, both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").distinct(), "cc-large")
        # small star: a node and its smaller neighbours move to the smallest of them
        least = materialize(spark, large.groupBy("b").agg(F.min("a").alias("m")), "cc-low")
        moved = large.join(least, "b")
        small = least.select(F.col("m").alias("a"), "b").unionByName(moved.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")))
        new = materialize(spark, small.filter("a < b").distinct(), "cc")
        release(e, low, large, least)
        e = new
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )


def running(rows: DataFrame, order: list, sums: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """rows with, for each name of `sums`, the sum of its column over all rows before this one in a total order.

    Rows are range-partitioned by the order and written; each range sums by itself, and one row a range goes
    through a window over the ranges.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(partitions or shuffle_partitions(spark), *order).withColumn("_range", F.spark_partition_id())
    dealt = materialize(spark, dealt, "running")
    whole = dealt.groupBy("_range").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("_range", *(F.coalesce(F.sum(f"_{n}").over(ahead), F.lit(0)).alias(f"_{n}") for n in sums))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(whole, "_range")
    return out.select(*rows.columns, *((F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_{n}")).alias(n) for n, c in sums.items()))


#: Rows of one key that a task may have to order; keys with more are cut into SUBS parts by their rows' places.
HOT, SUBS = 200_000, 64


def parts_of_hot(rows: DataFrame, keys: list[str], position: str = "position", hot: int = HOT) -> DataFrame:
    """rows with `sub`: 0, or one of SUBS parts, by the place in a written table, for keys that more than `hot` rows have."""
    big = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot).select(*(F.col(k).alias(f"_{k}") for k in keys), F.lit(True).alias("_big"))
    big = materialize(rows.sparkSession, big, "hot")  # few rows: Spark broadcasts them by their size
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    out = rows.join(big, on, "left").withColumn("sub", F.when(F.col("_big"), F.pmod(F.xxhash64(position), F.lit(SUBS))).otherwise(0).cast("int"))
    return out.select(*rows.columns, "sub")


def salted_lookup(rows: DataFrame, key: str, salt: str, table: DataFrame) -> DataFrame:
    """rows joined with the one row that `table` has for their key (other rows: nulls), whatever a key's share of them.

    The table's row first goes to each (key, salt) that occurs, at most one a salt; rows then meet it by both.
    """
    homes = rows.select(key, salt).distinct().join(table, key)
    return rows.join(homes, [key, salt], "left")


def bloom(keys: DataFrame, most_bits: int = 1 << 29) -> np.ndarray:
    """Bits of a Bloom filter of rows of hashes, 16 bits a row and at most most_bits: a superset test of bounded size."""
    n = max(keys.count(), 1)
    bits = min(1 << max(10, (16 * n - 1).bit_length()), most_bits)
    at = F.explode(F.array(*[F.pmod(F.col(c), F.lit(bits)) for c in keys.columns]))
    words = (
        keys.select(at.alias("p")).groupBy(F.shiftright("p", 5).alias("w"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(32)).cast("int"))).alias("b")).toArrow()
    )
    out = np.zeros(bits // 32, np.uint32)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().astype(np.uint32)
    return out


def bloom_keys(column: Column) -> list[Column]:
    """Two hashes of a value, for `bloom` and for what is tested against it."""
    return [F.xxhash64(F.lit(i), column).alias(f"h{i}") for i in range(2)]


def hashed_keys(key: Column) -> list[Column]:
    """The same for a column that is a hash already; in numpy, `halves`."""
    return [key.alias("h0"), F.shiftrightunsigned(key, 32).alias("h1")]


def halves(key: np.ndarray) -> list[np.ndarray]:
    return [key.view(np.int64), (key >> np.uint64(32)).view(np.int64)]


def in_bloom(bits: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    out = np.ones(len(keys[0]), bool)
    for k in keys:
        p = np.mod(k, len(bits) * 32)
        out &= (bits[p >> 5] >> (p & 31).astype(np.uint32)) & 1 == 1
    return out


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (smallest node, node) with the same components as the edges (a, b); at most one a node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(nodes):
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for old in (root[x], root[y], x, y):
            np.minimum.at(new, old, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[root[moved]], nodes[moved]


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first `keys` columns, from batches sorted by them, one table a run."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            values = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= values[1:] != values[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            key = tuple(batch.column(k)[lo].as_py() for k in range(keys))
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)
