"""Operator 3, n-gram Jaccard join with vertical partitioning.

A document is its set of distinct word shingles, known by 64-bit hashes; equal sets are one node, named by a
64-bit hash of the set (sets are not compared by content; two different ones among n have one name with a chance of about
n^2 / 2^65). The global n-gram order puts rare shingles first: those of the highest document frequencies come last, by
frequency, and all others before them, by hash. Frequencies are counted over all documents, combined in tasks and then by
buckets, for the first `bits` + 32 bits of the hashes; shingles that agree in these count together, which moves them in the
order, alike for every document, and changes no result.

The order is cut into fragments: ranges of the hashes, then the frequent shingles. Every set falls into its segments of
them. Overlaps are counted fragment by fragment, each (pair, fragment) by itself, and the counts are summed per pair (`verify`).
Which pairs are counted at all is settled before, by filters on the order that lose no link: two sets with Jaccard
similarity t or more share at least o = ceil(t / (1 + t) (|x| + |y|)) shingles, so one of the first |x| - o + 1 of x is
among the first |y| - o + 1 of y. Prefixes of |x| - ceil(t|x|) + 1 cover every partner; they meet in buckets of their hashes
with their places, and shingles of one node drop out there. Parity bitmaps of SKETCH bits a shingle then reject pairs whose
symmetric difference is provably too large. So candidates come from the prefixes of the segments, not from all of them.

Groups of thousands of near copies would give all their pairs, so links are found in rounds: every node is first
compared with the one pivot it shares most prefix shingles with, and what links is contracted; rounds repeat while
prefixes are contested between components. Then all pairs between different components that still share a prefix
shingle pass through the bitmaps; each node's most promising pair is verified and contracted, and at last every
pair that is still between components. So no link between components is lost, and no pair inside one is made.

The frequent shingles are at most FREQUENT, which bounds the broadcast; sets travel only for documents in candidate pairs,
found through a Bloom filter of bounded size.

Defined cases: a text with no word (null and empty texts too) has no shingle, links with nothing and is its own
component; one of fewer words than `width` has its whole sequence as one shingle; rows with equal sets are linked;
null ids take part and never name a component unless it has no other id, when its id is null; repeated rows are
rows of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.llm import textkernel as K
from rowsmith.llm.common import (
    bloom,
    bloom_keys,
    connected_components,
    from_most_frequent,
    groups,
    in_bloom,
    materialize,
    release,
    salted_lookup,
    shuffle_partitions,
    trim,
)

WIDTH, PERCENT = 5, 75
#: Of the shingles of at least LEAST documents, the most frequent ones, about FREQUENT at most (12 bytes each), come last in the order.
LEAST, FREQUENT = 3, 1 << 20
FRAGMENTS = 8
#: Star rounds end when one links fewer than this share of the nodes, or after so many.
STAR_SHARE, STAR_ROUNDS = 0.003, 2
SKETCH = 4
#: Shares (of the last number) of what pairs have in common, by a hash, that are looked at before what that links is
#: contracted: pairs with much in common come up early, and few of a large group's pairs come up at all.
DRAWS = (0, 1, 8, 64)
#: So often, at most, are only the most promising pairs of many verified.
SETTLE_ROUNDS = 3
GROUP = 1_000_000
ENTRIES = 300_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of each text's distinct shingles, ascending."""
    word, text = K.words(data, offsets)
    n = len(offsets) - 1
    return K.distinct(*K.shingles(word, text, n, width), n)


def set_names(found: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 for an empty one."""
    n = np.diff(cut)
    out = np.zeros(len(n), np.uint64)
    full = n > 0
    if full.any():
        with np.errstate(over="ignore"):
            a = np.add.reduceat(K.mix(found ^ K.BASE), cut[:-1][full])
            b = np.bitwise_xor.reduceat(K.mix(found), cut[:-1][full])
            out[full] = K.mix(a ^ K.mix(b + n[full].astype(np.uint64)))
    return out


def sketches(found: np.ndarray, cut: np.ndarray) -> list[bytes]:
    """Parity bitmaps: bit i says whether an odd number of a set's hashes fall on i. SKETCH bits a shingle or more."""
    out = []
    mixed = K.mix(found)
    for a, b in zip(cut, cut[1:], strict=False):
        bits = 1 << max(6, (SKETCH * int(b - a) - 1).bit_length()) if b > a else 64
        odd = np.bincount((mixed[a:b] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(odd.astype(bool), bitorder="little").tobytes())
    return out


def difference_bound(x: bytes, y: bytes) -> int:
    """A lower bound of the sets' symmetric difference; the longer bitmap is folded to the shorter."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    m = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(v.reshape(-1, m), axis=0) for v in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def _sets(batches: Iterator[pa.RecordBatch], at: int, width: int):
    for batch in batches:
        data, offsets = K.buffers(batch.column(at))
        for i, j in K.pieces(offsets, 2 * K.PIECE):
            yield batch, i, j, *shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)


def describe(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """From (id, k, text): a row per document (k, id, n, node, sketch), and rows (bucket, singles, repeats) of shingles.

    A bucket is the first `bits` bits of a hash. Its blobs hold the 32 bits after them: of the shingles that a group of
    documents has once, and, with their counts, of those that it has more often.
    """
    id_type = docs.schema["id"].dataType.simpleString()
    names = ["k", "id", "n", "node", "sketch", "bucket", "singles", "repeats"]

    def counted(parts: list[np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
        short, times = np.unique(np.concatenate(parts) >> np.uint64(32 - bits), return_counts=True)
        bucket, low = (short >> np.uint64(32)).astype(np.int32), short.astype(np.uint32)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        once, often = [], []
        for x, y in zip(first, [*first[1:].tolist(), len(short)], strict=True):
            many = times[x:y] > 1
            once.append(low[x:y][~many].tobytes())
            often.append(low[x:y][many].tobytes() + times[x:y][many].astype(np.uint32).tobytes())
        blank = [pa.nulls(len(first), t) for t in (pa.int64(), kind, pa.int32(), pa.int64(), pa.binary())]
        return pa.RecordBatch.from_arrays([*blank, pa.array(bucket[first]), pa.array(once, pa.binary()), pa.array(often, pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, kind = [], 0, None
        for batch, i, j, found, cut in _sets(batches, 2, width):
            kind = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).slice(i, j - i), batch.column(0).slice(i, j - i), pa.array(np.diff(cut).astype(np.int32)),
                 pa.array(set_names(found, cut).view(np.int64)), pa.array(sketches(found, cut), pa.binary()),
                 pa.nulls(j - i, pa.int32()), *(pa.nulls(j - i, pa.binary()) for _ in range(2))], names=names,
            )
            parts.append(found)
            size += len(found)
            if size > GROUP:
                yield counted(parts, kind)
                parts, size = [], 0
        if size:
            yield counted(parts, kind)

    return docs.mapInArrow(run, f"k long, id {id_type}, n int, node long, sketch binary, bucket int, singles binary, repeats binary")


def document_frequencies(blobs: DataFrame, least: int) -> DataFrame:
    """(short: first bits of a shingle's hash, times) of those that at least `least` documents have, from the blobs of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 1):
            low, times = [], []
            for once, often in zip(table.column("singles").to_pylist(), table.column("repeats").to_pylist(), strict=True):
                low += [np.frombuffer(once, np.uint32), np.frombuffer(often, np.uint32, len(often) // 8)]
                times += [np.ones(len(once) // 4, np.uint32), np.frombuffer(often, np.uint32, len(often) // 8, len(often) // 2)]
            low, times = np.concatenate(low), np.concatenate(times)
            o = np.argsort(low)
            low, times = low[o], times[o]
            first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])) if len(low) else np.zeros(0, np.int64)
            total = np.add.reduceat(times.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
            often = total >= least
            short = (np.int64(table.column("bucket")[0].as_py()) << 32) | low[first][often].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(short), pa.array(total[often])], names=["short", "times"])

    dealt = blobs.repartition(shuffle_partitions(blobs.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "short long, times long")


class Order:
    """The global n-gram order: frequent shingles last, by count; all others by hash."""

    def __init__(self, frequent: np.ndarray, times: np.ndarray, bits: int) -> None:
        o = np.argsort(frequent)
        self.frequent, self.times, self.shift = frequent[o], times[o].astype(np.int32), np.uint64(32 - bits)

    def weight(self, found: np.ndarray) -> np.ndarray:
        if not len(self.frequent):
            return np.zeros(len(found), np.int32)
        short = found >> self.shift
        at = np.searchsorted(self.frequent, short)
        at[at == len(self.frequent)] = 0
        return np.where(self.frequent[at] == short, self.times[at], 0)

    def fragment(self, found: np.ndarray, fragments: int) -> np.ndarray:
        """Fragment of each shingle: equal ranges of the hashes, and the frequent ones as the last."""
        ranges = (found >> np.uint64(32)).astype(np.int64) * (fragments - 1) >> 32
        return np.where(self.weight(found) > 0, fragments - 1, ranges)


def postings(docs: DataFrame, order, width: int, percent: int, buckets: int) -> DataFrame:
    """(shingle, node, n, pos: place in the node's order) of every prefix shingle that several nodes share."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            shingle, node, n, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            b = (shingle % np.uint64(buckets)).astype(np.int64)
            o = np.argsort(b, kind="stable")
            shingle, node, n, pos, b = shingle[o], node[o], n[o], pos[o], b[o]
            first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
            ends = [*first[1:].tolist(), len(b)]
            blobs = [b"".join(v[x:y].tobytes() for v in (shingle, node, n, pos)) for x, y in zip(first, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(b[first].astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "entries"])

        for _, i, j, found, cut in _sets(batches, 0, width):
            n = np.diff(cut)
            name = set_names(found, cut)
            _, first = np.unique(name, return_index=True)  # equal sets of a batch enter once
            once = np.zeros(j - i, bool)
            once[first] = True
            text = np.repeat(np.arange(j - i), n)
            use = once[text]
            found, text = found[use], text[use]
            o = np.lexsort((found, order.value.weight(found), text))
            found, text = found[o], text[o]
            place = np.arange(len(text)) - np.searchsorted(text, text)
            size_of = n[text]
            head = place < size_of - -(-size_of * percent // 100) + 1
            held.append((found[head], name[text[head]], size_of[head].astype(np.int32), place[head].astype(np.int32)))
            size += int(head.sum())
            if size > ENTRIES:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 1):
            parts = []
            for raw in table.column("entries").to_pylist():
                m = len(raw) // 24
                parts.append(tuple(np.frombuffer(raw, k, m, at * m) for k, at in ((np.int64, 0), (np.int64, 8), (np.int32, 16), (np.int32, 20))))
            shingle, node, n, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
            o = np.lexsort((node, shingle))
            shingle, node, n, pos = shingle[o], node[o], n[o], pos[o]
            new = np.ones(len(o), bool)
            new[1:] = (shingle[1:] != shingle[:-1]) | (node[1:] != node[:-1])
            shingle, node, n, pos = shingle[new], node[new], n[new], pos[new]
            same = shingle[1:] == shingle[:-1]
            many = np.zeros(len(shingle), bool)
            many[1:] |= same
            many[:-1] |= same
            for lo in range(0, int(many.sum()), 100_000):
                at = np.flatnonzero(many)[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(shingle[at]), pa.array(node[at]), pa.array(n[at]), pa.array(pos[at])], names=["shingle", "node", "n", "pos"])

    blobs = docs.select("text").mapInArrow(prefixes, "bucket int, entries binary")
    spark = docs.sparkSession
    dealt = blobs.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(shared, "shingle long, node long, n int, pos int")


class Join:
    """One run: the documents' sets, and what verifies pairs of them."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, frequent: int, fragments: int) -> None:
        self.spark, self.width, self.percent, self.fragments = docs.sparkSession, width, percent, fragments
        text = F.col(f"`{text_col}`").cast("string")
        key = F.xxhash64(F.col("id").cast("string"), F.octet_length("text"))
        self.docs = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).select("id", key.alias("k"), "text")
        bits = (4 * shuffle_partitions(self.spark) - 1).bit_length()
        seen = materialize(self.spark, describe(self.docs, width, bits), "join-seen")
        self.rows = seen.filter("k is not null").select("k", "id", "n", "node", "sketch")
        often = document_frequencies(seen.filter("bucket is not null").select("bucket", "singles", "repeats"), LEAST)
        often = materialize(self.spark, often, "join-often")
        top = from_most_frequent(often, "short", "times", frequent).toArrow()
        release(often)
        self.order = self.spark.sparkContext.broadcast(
            Order(top.column("short").to_numpy().view(np.uint64).copy(), np.minimum(top.column("times").to_numpy(), 2**31 - 1), bits))
        # one row a node; k finds a document that has the set
        self.nodes = materialize(
            self.spark,
            self.rows.filter("n > 0").groupBy("node").agg(F.min("k").alias("k"), F.first("n").alias("n"), F.first("sketch").alias("sketch")),
            "join-nodes",
        )

    def close_in_size(self):
        """Sets as similar as asked for differ no more in size than this."""
        return F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.percent

    def early_enough(self):
        """Whether a shingle at places pa and pb of sets of na and nb can be the first that similar sets share."""
        p = self.percent
        least = F.floor((p * (F.col("na") + F.col("nb")).cast("long") + 99 + p) / (100 + p))
        return (F.col("pa") <= F.col("na") - least) & (F.col("pb") <= F.col("nb") - least)

    def sieve(self, pairs: DataFrame) -> DataFrame:
        """(a, b, na, nb, least: bound of the symmetric difference) of the pairs (a, b, na, nb) that bitmaps admit."""
        spark, percent = self.spark, self.percent
        pairs = materialize(spark, pairs, "join-pairs")
        one = lambda s: self.nodes.select(F.col("node").alias(s), F.col("sketch").alias(f"s{s}"))
        both = pairs.join(one("a"), "a").join(one("b"), "b")

        def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b, na, nb = (batch.column(c).to_numpy() for c in ("a", "b", "na", "nb"))
                least = np.array([difference_bound(x, y) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)], np.int64)
                # overlap is (na + nb - difference) / 2, and (100 + percent) * overlap must reach percent * (na + nb)
                total = na.astype(np.int64) + nb
                ok = (100 + percent) * (total - least) >= 2 * percent * total
                yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (a, b, na, nb, least)], names=["a", "b", "na", "nb", "least"])

        met = both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(possible, "a long, b long, na int, nb int, least long")
        out = materialize(spark, met, "join-possible")
        release(pairs)
        return out

    def verify(self, left: DataFrame) -> DataFrame:
        """(a, b) of those pairs (a, b, na, nb) that are similar enough: overlaps per fragment, summed per pair."""
        spark, percent = self.spark, self.percent
        wanted = left.select(F.col("a").alias("node")).unionByName(left.select(F.col("b").alias("node"))).distinct()
        segments = materialize(spark, self._segments(wanted.join(self.nodes.select("node", "k"), "node")), "join-segments")
        mine = segments.withColumnsRenamed({"node": "a", "bytes": "x"})
        theirs = segments.withColumnsRenamed({"node": "b", "bytes": "y"})

        def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part = np.array(
                    [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                     for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)], np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "na", "nb")), pa.array(part)], names=["a", "b", "na", "nb", "part"])

        met = left.join(mine, "a").join(theirs, ["b", "fragment"]).select("a", "b", "na", "nb", "x", "y")
        sums = met.mapInArrow(overlap, "a long, b long, na int, nb int, part long").groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("overlap"))
        enough = F.col("overlap") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent
        out = materialize(spark, sums.filter(enough).select("a", "b"), "join-links")
        release(segments)
        return out

    def _segments(self, wanted: DataFrame) -> DataFrame:
        """(node, fragment, bytes: hashes ascending) of the wanted nodes (node, k)."""
        spark, width, order, fragments = self.spark, self.width, self.order, self.fragments
        bits = spark.sparkContext.broadcast(bloom(wanted.select(*bloom_keys(F.col("k")))))
        source = self.docs.select("text", *bloom_keys(F.col("k")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def chosen():
                for batch in batches:
                    hit = in_bloom(bits.value, [batch.column(i).to_numpy() for i in (1, 2)])
                    if hit.any():
                        yield batch.filter(pa.array(hit))

            for _, i, j, found, cut in _sets(chosen(), 0, width):
                name = set_names(found, cut).view(np.int64)
                text = np.repeat(np.arange(j - i), np.diff(cut))
                f = order.value.fragment(found, fragments)
                o = np.lexsort((found, f, text))
                found, f, text = found[o], f[o], text[o]
                first = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (text[1:] != text[:-1])])) if len(f) else f
                ends = [*first[1:].tolist(), len(f)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[text[first]]), pa.array(f[first].astype(np.int32)), pa.array([found[x:y].tobytes() for x, y in zip(first, ends, strict=False)], pa.binary())],
                    names=["node", "fragment", "bytes"],
                )

        found = source.mapInArrow(run, "node long, fragment int, bytes binary")
        # several documents may have a node's key or set; the segments are the same, so any of them serves
        return found.join(wanted.select("node"), "node", "left_semi").groupBy("node", "fragment").agg(F.first("bytes").alias("bytes"))


def components(join: Join, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """(node, component) of all nodes that are linked with another one."""
    spark = join.spark
    posts = postings(join.docs, join.order, join.width, join.percent, 4 * shuffle_partitions(spark))
    posts = materialize(spark, posts.withColumn("comp", F.col("node")), "join-postings")
    member = None
    n_nodes = join.nodes.count()

    def contract(new: DataFrame) -> None:
        """Unites the components that new links (a, b) join."""
        nonlocal member
        if member is None:
            member = materialize(spark, connected_components(spark, new), "join-member")
            return
        label = lambda s: member.select(F.col("node").alias(s), F.col("component").alias(f"c{s}"))
        ends = new.join(label("a"), "a", "left").join(label("b"), "b", "left")
        united = connected_components(spark, ends.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
        united = materialize(spark, united.select(F.col("node").alias("old"), F.col("component").alias("root")), "join-united")
        known = member.join(united, member["component"] == united["old"], "left").select("node", F.coalesce("root", "component").alias("component"))
        fresh = united.join(member, united["old"] == member["node"], "left_anti").select(F.col("old").alias("node"), F.col("root").alias("component"))
        old, member = member, materialize(spark, known.unionByName(fresh), "join-member")
        release(old, united)

    def contested(posts: DataFrame) -> DataFrame:
        if member is not None:
            new = posts.drop("comp").join(member, "node", "left").select(
                "shingle", "node", "n", "pos", F.coalesce("component", "node").alias("comp"))
            new = materialize(spark, new, "join-postings")
            release(posts)
            return new
        return posts

    def narrow(posts: DataFrame, shingles: DataFrame) -> DataFrame:
        new = materialize(spark, posts.join(shingles.select("shingle"), "shingle", "left_semi"), "join-postings")
        release(posts)
        return new

    def settle(rest: DataFrame) -> bool:
        """Verifies and contracts pairs; of many, first each node's most promising one, and again among what is
        still apart, then all."""
        some = False
        label = lambda s: member.select(F.col("node").alias(s), F.col("component").alias(f"c{s}"))
        for _ in range(SETTLE_ROUNDS):
            if rest.count() <= n_nodes // 16:
                break
            both = rest.select(F.col("a").alias("x"), "*").unionByName(rest.select(F.col("b").alias("x"), "*"))
            best = both.groupBy("x").agg(F.min_by(F.struct("a", "b", "na", "nb"), F.struct("least", "a", "b")).alias("p"))
            best = materialize(spark, best.select("p.*").distinct(), "join-best")
            found = join.verify(best)
            left = rest.join(best.select("a", "b"), ["a", "b"], "left_anti")
            if not found.isEmpty():
                some = True
                contract(found)
                left = left.join(label("a"), "a", "left").join(label("b"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
            left = materialize(spark, left.select("a", "b", "na", "nb", "least"), "join-rest")
            release(rest, best, found)
            rest = left
        if not rest.isEmpty():
            found = join.verify(rest)
            if not found.isEmpty():
                some = True
                contract(found)
            release(found)
        release(rest)
        return some

    for r in range(star_rounds):
        pivot = F.min_by(F.struct("node", "comp", "n", "pos"), F.xxhash64(F.lit(r), F.col("node")))
        pivots = materialize(
            spark,
            posts.groupBy("shingle").agg(pivot.alias("p"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
            .select("shingle", F.col("p.node").alias("a"), F.col("p.comp").alias("ca"), F.col("p.n").alias("na"), F.col("p.pos").alias("pa")),
            "join-pivots",
        )
        if pivots.isEmpty():
            return member if member is not None else _none(spark)
        posts = narrow(posts, pivots)
        near = posts.select("shingle", *(F.col(x).alias(y) for x, y in (("node", "b"), ("comp", "cb"), ("n", "nb"), ("pos", "pb")))).join(pivots, "shingle")
        shared = near.filter("ca <> cb").filter(join.close_in_size()).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
        best = shared.groupBy("b").agg(F.max_by(F.struct("a", "na", "nb"), F.struct("shared", F.xxhash64("a"))).alias("p"))
        found = join.verify(join.sieve(best.select("p.a", "b", "p.na", "p.nb")))
        release(pivots)
        linked = found.count()
        if linked:
            contract(found)
            posts = contested(posts)
        release(found)
        if linked < STAR_SHARE * n_nodes:
            break
    # What is left: every pair of different components that shares a prefix shingle, in growing draws, so that a node
    # near a large component is compared with few of its members before it joins.
    for lo, hi in zip(DRAWS, DRAWS[1:], strict=False):
        mixed = posts.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("shingle")
        posts = narrow(posts, mixed)
        if posts.isEmpty():
            break
        side = lambda s: posts.select("shingle", *(F.col(x).alias(f"{y}{s}") for x, y in (("node", ""), ("comp", "c"), ("n", "n"), ("pos", "p"))))  # noqa: E731, B023
        # the smaller set of a pair meets the larger early in its order, which leaves most of a long list out on one side
        inner = side("a").filter(F.col("pa") <= F.col("na") - F.ceil(F.col("na") * (2 * join.percent) / (100 + join.percent)))
        apart = "ca <> cb and (na < nb or na = nb and a < b)"
        drawn = F.pmod(F.xxhash64("a", "b", "shingle"), F.lit(DRAWS[-1]))
        pairs = inner.join(side("b"), "shingle").filter(apart).filter((drawn >= lo) & (drawn < hi)).filter(join.early_enough())
        found = settle(join.sieve(pairs.select("a", "b", "na", "nb").distinct()))
        if found:
            posts = contested(posts)
    return member if member is not None else _none(spark)


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "node long, component long")


def similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT,
    frequent: int = FREQUENT, fragments: int = FRAGMENTS, star_rounds: int = STAR_ROUNDS,
) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (smallest id reachable by links)."""
    spark = docs.sparkSession
    join = Join(docs, id_col, text_col, width, percent, frequent, fragments)
    trim()
    member = components(join, star_rounds)
    salt = F.pmod(F.xxhash64("k"), F.lit(max(32, shuffle_partitions(spark)))).cast("int")
    rows = join.rows.select("id", "n", "node", salt.alias("salt"))
    named = (
        rows.filter("n > 0").groupBy("node").agg(F.min("id").alias("low")).join(member, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    named = materialize(spark, named, "join-named")
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    lowest = materialize(spark, lowest, "join-lowest")
    # a component of many different sets has as many rows here, so it is met by salt too
    table = materialize(
        spark,
        salted_lookup(named.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(64)).cast("int")), "component", "salt", lowest)
        .select("node", "component_id"), "join-table")
    out = salted_lookup(rows.filter("n > 0"), "node", "salt", table).select("id", "n", "component_id")
    alone = rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
f AS (SELECT doc_id, unnest(s) AS g FROM s),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM f a JOIN f b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT x, y FROM shared JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * k >= 75 * (p.n + q.n - k)),
links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT n.doc_id, n.n AS n_shingles, min(y) AS component_id FROM n JOIN reach ON n.doc_id = reach.x GROUP BY ALL
"""
