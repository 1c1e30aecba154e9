"""Operator 10, embedding near-dedup by sorted projection passes.

1. Identical vectors of a label become one representative with a multiplicity (salted, as in exact dedup).
2. Each pass hashes every representative, less the mean direction of its label, to 64 signs of random projections, and
   orders the vectors of a label lexicographically by them, over range partitions. A label has PASSES passes, or as many
   more, up to MOST_PASSES, as its size and spread ask for to bring all but MISSES of the pairs at the threshold into a
   window (vectors that lean one way are told apart by fewer of their signs). Every vector is compared with its `window`
   followers in that order, in double precision; the edges of partitions are compared in a second step. A task reduces
   the pairs at or above the threshold to a spanning forest before it emits them.
3. The passes' forests are united into components.
4. Links are counted inside each component exactly, so a dense group isn't limited by the window: a component of
   up to BLOCK vectors all against all; a larger one by cells, the rings of RING angles around the nearest of up to LEADERS of
   its vectors. By the triangle inequality of angles, most pairs of cells hold only linked vectors or none, and count by
   their totals alone, so a group of copies around one vector takes time in proportion to its size, and nothing of it is
   gathered. Vectors of the other pairs of cells are compared, block against block.

A pair is missed only if no pass brings it, or a chain between its ends, into one window; see the tests and the
README for the recall measured against brute force. No pair below the threshold is ever linked.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and those with a null
label or null id, link with nothing and are their own component; vectors of different lengths are never compared;
repeated rows are vectors of their own, linked with each other; rows with one id and different vectors share that
id's component; labels that are no whole numbers are told apart by 64-bit hashes of their text, and ids have to be whole
numbers; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsmith.llm.common import connected_components, groups, local_forest, materialize, shuffle_partitions

THRESHOLD, PASSES, WINDOW, BLOCK = 0.98, 12, 24, 1024
MOST_PASSES, MISSES = 64, 0.01
#: Leaders of a component of more than one block, and rings to the threshold's angle.
LEADERS, RINGS = 32, 4
#: By so much do angles have to be clear of the threshold before a pair of cells counts without a look.
CLEAR = 1e-6


def packed(lists: pa.Array) -> pa.Array:
    """Each list of numbers as the bytes of its 32- or 64-bit floats; null where it can't have a direction."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    kind = np.float32 if pa.types.is_float32(lists.type.value_type) else np.float64
    n = len(lists)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    values = flat.to_numpy(zero_copy_only=False).astype(kind)  # a null component becomes NaN
    offsets = offsets - offsets[0]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    wide = values.astype(np.float64)
    finite = np.bincount(owner, weights=~np.isfinite(wide), minlength=n) == 0
    some = np.bincount(owner, weights=np.where(np.isfinite(wide), wide != 0, 0), minlength=n) > 0
    ok = finite & some & lists.is_valid().to_numpy(zero_copy_only=False)
    size = kind(0).itemsize
    raw = pa.Array.from_buffers(
        pa.large_binary(), n, [None, pa.py_buffer((offsets * size).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]
    )
    return pa.array(np.where(ok, raw.to_numpy(zero_copy_only=False), None), pa.binary())


def unit(raw: pa.Array, size: int) -> np.ndarray:
    """Rows of one length as unit vectors in double precision; `size` is the bytes of a component."""
    v = np.stack([np.frombuffer(x, np.float32 if size == 4 else np.float64) for x in raw.to_pylist()]).astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _directions(p: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, p]).normal(size=(dim, 64))


def passes_for(n: int, lean: float, threshold: float, passes: int, window: int) -> int:
    """Passes for n vectors of one label whose mean direction has the square `lean`.

    About log2(n / window) signs tell a vector's window from others; a pair at the threshold, seen from the mean, agrees in
    all of them with a known chance.
    """
    cos = 1 - (1 - threshold) / max(1 - lean, 1e-6)
    same = 1 - np.arccos(np.clip(cos, -1, 1)) / np.pi
    hit = same ** max(np.log2(max(n, 1) / window), 0)
    need = 1 if hit >= 1 - MISSES else np.ceil(np.log(MISSES) / np.log1p(-hit)) if hit > 0 else MOST_PASSES
    return int(np.clip(need, passes, max(passes, MOST_PASSES)))


def linked(v: np.ndarray, window: int, threshold: float, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j <= i + window, with cosine >= threshold; with `split`, only those on both sides of it."""
    left, right = [], []
    for k in range(1, min(window, len(v) - 1) + 1):
        a = v[:-k] if split is None else v[max(0, split - k) : split]
        b = v[k:] if split is None else v[max(0, split - k) + k : split + k]
        a = a[: len(b)]
        i = np.flatnonzero(np.einsum("ij,ij->i", a, b) >= threshold) + (0 if split is None else max(0, split - k))
        left.append(i)
        right.append(i + k)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    a, b = local_forest(a, b)
    n = len(a)
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.nulls(n, k) for k in kinds)], names=_FOUND)


_FOUND = ["a", "b", "edge", "side", "label", "dim", "pass", "vec"]


def mean_directions(vectors: DataFrame, size: int, parts: int, passes) -> DataFrame:
    """(label, dim: bytes of a vector, mean: of the unit vectors, as 32-bit floats, passes: of n and the mean's square) of
    (label, vec); one row a label and length."""
    kinds = "label long, dim int, mean binary, n long"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, raw = batch.column(0).to_numpy(), batch.column(1)
            length = np.array([len(x) for x in raw.to_pylist()])
            for dim in np.unique(length):
                at = np.flatnonzero(length == dim)
                at = at[np.argsort(label[at], kind="stable")]
                first = np.flatnonzero(np.concatenate([[True], label[at][1:] != label[at][:-1]]))
                total = np.add.reduceat(unit(raw.take(pa.array(at)), size), first, axis=0)
                yield rows(label[at][first], dim, total, np.diff(np.append(first, len(at))))

    def rows(label, dim: int, total: np.ndarray, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(label), pa.array(np.full(len(label), dim, np.int32)), pa.array([x.astype(np.float32).tobytes() for x in total], pa.binary()), pa.array(np.asarray(n, np.int64))],
            names=["label", "dim", "mean", "n"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 2):
            total = np.sum([np.frombuffer(x, np.float32).astype(np.float64) for x in table.column("mean").to_pylist()], axis=0)
            n = table.column("n").to_numpy().sum()
            many = passes(int(n), float((total / n) @ (total / n)))
            yield rows([table.column("label")[0].as_py()], table.column("dim")[0].as_py(), total[None] / n, [many])

    # a row a label, length and batch: few of a label that holds many vectors
    dealt = vectors.mapInArrow(sums, kinds).repartition(parts, "label", "dim").sortWithinPartitions("label", "dim")
    return dealt.mapInArrow(mean, kinds).select("label", "dim", "mean", F.col("n").cast("int").alias("passes"))


GROUP = ["component", "label", "dim"]


def links_inside(members: DataFrame, size: int, threshold: float, parts: int) -> DataFrame:
    """(label, vec, more): for each of `members` (component, label, dim, id, vec, n), the sum of n over all others of its component,
    label and length with cosine >= threshold."""
    spark = members.sparkSession
    sizes = members.groupBy(*GROUP).agg(F.count("*").alias("size"))
    sizes = materialize(spark, sizes.withColumn("chunks", F.ceil(F.col("size") / (4 * BLOCK)).cast("int")), "emb-sizes")
    sized = members.join(sizes, GROUP)
    whole = sized.filter(F.col("size") <= BLOCK).select(*GROUP, *(F.lit(0).alias(c) for c in ("sa", "ra", "sb", "rb", "i", "j", "side")), "id", "vec", "n")
    large = sized.filter(F.col("size") > BLOCK)

    # up to LEADERS vectors of each large group, and every vector's nearest one
    draw = F.xxhash64("id", "vec")
    leaders = large.groupBy(*GROUP, F.pmod(draw, F.lit(LEADERS)).cast("int").alias("slot")).agg(F.min_by("vec", F.struct(draw, "id")).alias("vec"))
    leaders = materialize(spark, leaders, "emb-leaders")
    ring = float(np.arccos(threshold) / RINGS)
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks").cast("long")).cast("int")
    asked = large.select(*GROUP, chunk.alias("chunk"), F.lit(-1).alias("slot"), "id", "vec", "n").unionByName(
        leaders.join(sizes, GROUP).select(*GROUP, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "slot", F.lit(0).cast("long").alias("id"), "vec", F.lit(0).cast("long").alias("n")))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 4):
            slot = table.column("slot").to_numpy()
            lead, rest = np.flatnonzero(slot >= 0), table.filter(pa.array(slot < 0))
            centres = unit(table.column("vec").take(pa.array(lead)), size)
            for lo in range(0, rest.num_rows, BLOCK):
                part = rest.slice(lo, BLOCK)
                cos = unit(part.column("vec"), size) @ centres.T
                best = cos.argmax(1)
                angle = np.arccos(np.clip(cos[np.arange(len(best)), best], -1, 1))
                out = part.drop(["chunk", "slot"]).append_column("slot", pa.array(slot[lead][best].astype(np.int32)))
                yield from out.append_column("ring", pa.array((angle / ring).astype(np.int32))).combine_chunks().to_batches()

    kinds = "component long, label long, dim int, id long, vec binary, n long, slot int, ring int"
    dealt = asked.repartition(parts, *GROUP, "chunk").sortWithinPartitions(*GROUP, "chunk", "slot")
    placed = materialize(spark, dealt.mapInArrow(nearest, kinds), "emb-cells")

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 3):
            v, slot = unit(table.column("vec"), size), table.column("slot").to_numpy()
            k = len(slot)
            angle = np.arccos(np.clip(v @ v.T, -1, 1))
            np.fill_diagonal(angle, 0.0)
            same = [pa.array([table.column(c)[0].as_py()] * (k * k), t) for c, t in zip(GROUP, (pa.int64(), pa.int64(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(np.repeat(slot, k)), pa.array(np.tile(slot, k)), pa.array(angle.ravel())], names=[*GROUP, "sa", "sb", "angle"])

    angles = leaders.select(*GROUP, "slot", "vec").repartition(parts, *GROUP).sortWithinPartitions(*GROUP).mapInArrow(
        apart, "component long, label long, dim int, sa int, sb int, angle double")
    cells = materialize(
        spark, placed.groupBy(*GROUP, "slot", "ring").agg(F.sum("n").alias("total"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "emb-rings")
    one = lambda x: cells.select(*GROUP, F.col("slot").alias(f"s{x}"), F.col("ring").alias(f"r{x}"), F.col("total").alias(f"t{x}"), F.col("blocks").alias(f"b{x}"))
    # as many pairs as a group has cells, squared, whatever its size
    a0, a1, b0, b1 = F.col("ra") * ring, (F.col("ra") + 1) * ring, F.col("rb") * ring, (F.col("rb") + 1) * ring
    d, limit = F.col("angle"), float(np.arccos(threshold))
    pairs = one("a").join(angles, [*GROUP, "sa"]).join(one("b"), [*GROUP, "sb"])
    pairs = pairs.withColumn("most", d + a1 + b1).withColumn("least", F.greatest(d - a1 - b1, a0 - d - b1, b0 - d - a1)).filter(F.col("least") <= limit + CLEAR)
    pairs = materialize(spark, pairs, "emb-pairs")
    own = (F.col("sa") == F.col("sb")) & (F.col("ra") == F.col("rb"))
    sure = pairs.filter(F.col("most") <= limit - CLEAR).groupBy(*GROUP, F.col("sa").alias("slot"), F.col("ra").alias("ring")).agg(
        F.sum("tb").alias("total"), F.max(own.cast("int")).alias("own"))
    by_total = placed.join(sure, [*GROUP, "slot", "ring"]).select("label", "vec", (F.col("total") - F.col("own") * F.col("n")).alias("more"))

    # the rest: blocks of the two cells against each other, each pair of blocks once
    rest = pairs.filter(F.col("most") > limit - CLEAR).filter((F.struct("sa", "ra") < F.struct("sb", "rb")) | own).select(*GROUP, "sa", "ra", "sb", "rb", "ba", "bb")
    mine = lambda b: F.pmod(F.xxhash64("id"), F.col(b).cast("long")).cast("int")

    def sent(side: int, x: str, y: str) -> DataFrame:
        """Members of cell x of each pair, once for each block of cell y; a cell against itself goes by one side."""
        met = placed.join(rest if side == 0 else rest.filter(~own), (placed["slot"] == rest[f"s{x}"]) & (placed["ring"] == rest[f"r{x}"]) & _same(placed, rest))
        met = met.select(*[placed[c] for c in GROUP], "sa", "ra", "sb", "rb", mine(f"b{x}").alias("mine"), F.explode(F.sequence(F.lit(0), F.col(f"b{y}") - 1)).alias("other"), placed["id"], placed["vec"], placed["n"])
        i, j = (F.when(own, F.least("mine", "other")).otherwise(F.col("mine")), F.when(own, F.greatest("mine", "other")).otherwise(F.col("other")))
        if side:
            i, j = F.col("other"), F.col("mine")
        at = F.when(own, (F.col("mine") > F.col("other")).cast("int")).otherwise(F.lit(side)) if side == 0 else F.lit(1)
        return met.select(*GROUP, "sa", "ra", "sb", "rb", i.alias("i"), j.alias("j"), at.alias("side"), "id", "vec", "n")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 9):
            n, side = table.column("n").to_numpy(), table.column("side").to_numpy()
            v = unit(table.column("vec"), size)
            alike = all(table.column(x)[0] == table.column(y)[0] for x, y in (("sa", "sb"), ("ra", "rb"), ("i", "j")))
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            total = np.zeros(len(n), np.int64)
            for lo in range(0, len(left), BLOCK):
                x = left[lo : lo + BLOCK]
                y = left if alike else right
                near = v[x] @ v[y].T >= threshold
                if alike:
                    near &= x[:, None] != y
                else:
                    total[y] += n[x] @ near
                total[x] += near @ n[y]
            hit = total > 0
            if hit.any():
                got = table.select(["label", "vec"]).filter(pa.array(hit)).append_column("more", pa.array(total[hit]))
                yield from got.combine_chunks().to_batches()

    keys = [*GROUP, "sa", "ra", "sb", "rb", "i", "j"]
    compared = whole.unionByName(sent(0, "a", "b")).unionByName(sent(1, "b", "a")).repartition(parts, *keys).sortWithinPartitions(*keys)
    counted = compared.mapInArrow(count, "label long, vec binary, more long")
    out = counted.unionByName(by_total).groupBy("label", "vec").agg(F.sum("more").alias("more"))
    return materialize(spark, out, "emb-more")


def _same(a: DataFrame, b: DataFrame) -> Column:
    return (a["component"] == b["component"]) & (a["label"] == b["label"]) & (a["dim"] == b["dim"])


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    threshold: float = THRESHOLD, passes: int = PASSES, window: int = WINDOW, seed: int = 5,
) -> DataFrame:
    """One row per row of vectors: id_col, n_links, component_id, kept."""
    spark = vectors.sparkSession
    parts = shuffle_partitions(spark)
    size = 4 if dict(vectors.dtypes)[vec_col] == "array<float>" else 8
    whole = lambda c: isinstance(vectors.schema[c].dataType, T.IntegralType)
    if not whole(id_col):
        raise ValueError(f"{id_col} must hold whole numbers")
    label = F.col(f"`{label_col}`")
    label = label.cast("long") if whole(label_col) else F.when(label.isNotNull(), F.xxhash64(label.cast("string")))
    base = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), label.alias("label"),
        F.col(f"`{vec_col}`").cast("array<float>" if size == 4 else "array<double>").alias("list"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed(batch.column(2))], names=["id", "label", "vec"])

    rows = base.mapInArrow(pack, "id long, label long, vec binary").withColumn(
        "vec", F.when(F.col("label").isNotNull() & F.col("id").isNotNull(), F.col("vec")))
    rows = materialize(spark, rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(max(32, parts))).cast("int")), "emb-rows")

    usable = rows.filter("vec is not null")
    winners = usable.groupBy("salt", "label", "vec").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    reps = materialize(
        spark,
        winners.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts")),
        "emb-reps",
    )

    means = materialize(spark, mean_directions(reps.select("label", "vec"), size, parts, lambda n, lean: passes_for(n, lean, threshold, passes, window)), "emb-means")

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2)
            length = np.array([len(x) for x in raw.to_pylist()])
            for dim in np.unique(length):
                part = batch.filter(pa.array(length == dim))
                centre = np.stack([np.frombuffer(x, np.float32) for x in part.column(3).to_pylist()])
                seen, asked = unit(part.column(2), size) - centre, part.column(4).to_numpy()
                for p in range(asked.max()):
                    some = asked > p
                    mine, of = (part, seen) if some.all() else (part.filter(pa.array(some)), seen[some])
                    key = np.packbits(of @ _directions(p, dim // size, seed) >= 0, axis=1).view(">u8")[:, 0].astype(np.uint64)
                    n = mine.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, p, np.int32)), mine.column(1), pa.array(np.full(n, dim, np.int32)),
                         pa.array((key ^ np.uint64(1 << 63)).view(np.int64)), mine.column(0), mine.column(2)],
                        names=["pass", "label", "dim", "key", "id", "vec"],
                    )

    order = ["pass", "label", "dim", "key", "id"]
    sliced = (
        reps.withColumn("dim", F.octet_length("vec")).join(means, ["label", "dim"]).select("rep", "label", "vec", "mean", "passes").mapInArrow(project, "pass int, label long, dim int, key long, id long, vec binary")
        .repartitionByRange(max(1, parts * passes // 4), *order).sortWithinPartitions(*order)
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        me = TaskContext.get().partitionId()
        carry, head = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if carry is None else [*carry.to_batches(), batch])
            if head is None:
                head = table.slice(0, window)
            elif head.num_rows < window:
                head = pa.concat_tables([head, pa.Table.from_batches([batch]).slice(0, window - head.num_rows)])
            yield within(table)
            carry = table.slice(max(0, table.num_rows - window))
        if carry is not None:
            yield border(head, me - 1, 1)
            yield border(carry, me, 0)

    def within(table: pa.Table) -> pa.RecordBatch:
        ids = table.column("id").to_numpy()
        where = np.stack([table.column(c).to_numpy() for c in ("pass", "label", "dim")], axis=1)
        cuts = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]).any(1), [True]]))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            i, j = linked(unit(table.column("vec").slice(lo, hi - lo), size), window, threshold)
            a.append(ids[lo + i])
            b.append(ids[lo + j])
        return _edges(np.concatenate(a), np.concatenate(b))

    def border(table: pa.Table, edge: int, side: int) -> pa.RecordBatch:
        n = table.num_rows
        one = lambda c: table.column(c).combine_chunks()
        return pa.RecordBatch.from_arrays(
            [one("id"), pa.nulls(n, pa.int64()), pa.array(np.full(n, edge, np.int32)), pa.array(np.full(n, side * window, np.int32) + np.arange(n, dtype=np.int32)),
             one("label"), one("dim"), one("pass"), one("vec")], names=_FOUND,
        )

    found = materialize(spark, sliced.mapInArrow(compare, "a long, b long, edge int, side int, label long, dim int, pass int, vec binary"), "emb-found")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 4):
            split = int((table.column("side").to_numpy() < window).sum())
            ids = table.column("a").to_numpy()
            if 0 < split < len(ids):
                i, j = linked(unit(table.column("vec"), size), window, threshold, split)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], names=["a", "b"])

    keys = ["edge", "label", "dim", "pass"]
    borders = found.filter("edge is not null").select(*keys, "side", "a", "vec").repartition(parts, "edge").sortWithinPartitions(*keys, "side")
    edges = found.filter("edge is null").select("a", "b").unionByName(borders.mapInArrow(across, "a long, b long"))
    member = materialize(spark, connected_components(spark, edges), "emb-components")

    inside = reps.select(F.col("rep").alias("id"), "label", F.octet_length("vec").alias("dim"), "vec", "n").join(
        member.select(F.col("node").alias("id"), "component"), "id")
    more = links_inside(materialize(spark, inside, "emb-inside"), size, threshold, parts)
    more = more.select(F.col("label").alias("l2"), F.col("vec").alias("v2"), "more")
    # Multiplicities and counts go back to each salt that holds copies of a representative.
    reps_out = (
        reps.join(more, (F.col("label") == F.col("l2")) & (F.col("vec") == F.col("v2")), "left")
        .join(member, F.col("rep") == F.col("node"), "left")
        .select(F.explode("salts").alias("salt"), "label", "vec", "rep",
                (F.col("n") - 1 + F.coalesce(F.col("more"), F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = usable.join(reps_out, ["salt", "label", "vec"]).select("id", "n_links", "component_id")
    alone = rows.filter("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
 WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
low AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN low ON vec_id = low.x LEFT JOIN n ON vec_id = n.x
"""
