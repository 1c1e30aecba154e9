"""Operator 5, quality classifier: interpolated modified Kneser-Ney perplexity against language quantiles.

A trigram model is fitted on trusted text (labelled quality 1). A hash of its id puts each trusted document on one of
two sides: three quarters of them are what the model counts, all of them, and the last quarter is what the limits come
from, all of it.

The counts are a table of shards. A trigram u v w belongs to the shard of its middle word v, which so has all that the
interpolation needs but one number a word: how many words it follows anywhere. A shard is one row: its words, their
places in the trigrams and the counts, compressed (about 8 bytes a trigram). Only the counts are stored; probabilities are
made of them when a shard is read. Shards grow in number with the counted text, so that one has about SHARD bytes of it;
a word that is in the middle of a large share of all trigrams makes its shard larger, which isn't split.

Written with back-off weights, the interpolation is a sum: ln p(w | u v) is ln p(w) + ln g(v) + ln g(u v), where g is what
a context leaves to the lower order, plus what the bigram v w and the trigram u v w gain over that where the model has
them. The words' part is summed in a first pass over the documents, from a broadcast table of the `table` most
frequent words (16 bytes each) and, for the others that a Bloom filter of bounded size admits, a join. For the rest
documents send their tokens to the shards, in groups that share a list of their words, and get sums back. That is done in
PARTS parts of the shards, one after the other, each of which reads the texts again: disk holds one part's tokens.
The shards of a part are dealt to LANES lanes, however many they are. A lane adds up what its shards say before it answers,
so a document gets PARTS * LANES sums at most and its place goes as often: neither grows with the model. A lane holds
16 bytes a document; of more than HELD documents, blocks of about so many meet the lanes in tasks of their own, for
which the model is read again. Shuffles are deleted as soon as the table behind them is written.

Words keep their case and punctuation; a word that trusted text lacks gets the uniform floor of the interpolation, so
symbol noise, shouting and markup debris are surprising.

A language's limit is the `quantile` of its trusted documents' surprise (mean negative log-probability less `z`
standard errors), taken over the quarter of them that the model has not counted. A document's threshold is the
perplexity which has that surprise at its length, and it is rejected above it: a short one only if its perplexity
is beyond what few words can show. Fewer than `enough` of them don't show the quantile: then it is the upper
prediction limit that their median and the spread above it allow for one more document (Student's t), which grows as
they get fewer, and with fewer than two every document of the language is kept. No language is judged by another's limit.

Defined cases: a null or empty text is one end token and is kept; a null language is a language of its own; null
ids are scored, and never trusted; repeated rows are rows of their own; with no trusted text every document is kept;
other columns travel in one struct, whatever their names: `keep` returns them as they are, `classify` all but those
with the names of its outputs.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsmith.llm import textkernel as K
from rowsmith.llm.common import bloom, bloom_keys, from_most_frequent, halves, hashed_keys, in_bloom, materialize, release, trim

QUANTILE, Z, ENOUGH = 0.995, 3.0, 40
TABLE = 1 << 19
#: N-grams are combined in groups of about so many before they are counted by shard; a shard has about SHARD bytes of
#: counted text; documents meet the shards in so many parts, one after the other, and in so many lanes a part; a lane
#: holds the sums of so many documents.
GROUP, SHARD, PARTS, LANES, HELD = 1_000_000, 2 << 20, 5, 6, 1 << 21
BEGIN, END = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x5851F42D4C957F2D)
F1, F2, F3 = (np.uint64(x) for x in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
UNKNOWN = np.uint64((1 << 64) - 1)
NONE = np.zeros(0, np.uint64)
OUTPUTS = ("n_tokens", "perplexity", "surprise", "threshold", "keep")


def sequence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each text's words between two begin tokens and an end token."""
    word, text = K.words(data, offsets, lower=False)
    n = len(offsets) - 1
    out, at = np.full(len(word) + 3 * n, BEGIN, np.uint64), np.empty(len(word) + 3 * n, np.int64)
    place = np.arange(len(word)) + 3 * text + 2
    out[place], at[place] = word, text
    ends = np.cumsum(np.bincount(text, minlength=n)) + 3 * np.arange(n) + 2
    out[ends] = END
    for back in range(3):
        at[ends - back] = np.arange(n)
    first = np.concatenate([[0], ends[:-1] + 1]) if n else ends
    for k in range(2):
        at[first + k] = np.arange(n)
    return out, at


def tokens(seq: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(u, v, w, text) of each predicted token w after u and v."""
    ok = (at[2:] == at[:-2]) & (seq[2:] != BEGIN)
    return seq[:-2][ok], seq[1:-1][ok], seq[2:][ok], at[2:][ok]


def home(v: np.ndarray, of: int) -> np.ndarray:
    """The shard of a trigram, by its middle word."""
    return (K.mix(v ^ F3) % np.uint64(of)).astype(np.int32)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: the bytes of one significance side by side, compressed."""
    raw = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    return len(head).to_bytes(4, "little") + head + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unsqueeze(data: bytes) -> list[np.ndarray]:
    stop = 4 + int.from_bytes(data[:4], "little")
    kinds = [(np.dtype(x), int(n)) for x, n in (x.split(",") for x in data[4:stop].decode().split(";"))]
    raw = pa.Codec("zstd", 1).decompress(data[stop:], sum(x.itemsize * n for x, n in kinds), asbytes=True)
    out, place = [], 0
    for x, n in kinds:
        size = x.itemsize * n
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, place).reshape(x.itemsize, n).T).reshape(-1).view(x))
        place += size
    return out


def spread_out(words: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, more: list[np.ndarray], of: int, hot: np.ndarray = NONE) -> Iterator[tuple[int, bytes]]:
    """(shard, squeezed words and places of u, v and w in them and what goes along); words of the ascending table `hot`
    as places in it."""
    at_hot = _find(hot, words)
    shard = home(words, of)[v]
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if lo == hi:
            continue
        mine = order[lo:hi]
        used = np.zeros(len(words), bool)
        for x in (u, v, w):
            used[x[mine]] = True
        to = (np.cumsum(used) - 1).astype(np.uint32)
        cold = np.diff(words[used & (at_hot < 0)], prepend=np.uint64(0))
        yield int(shard[lo]), squeeze(np.diff(at_hot[used & (at_hot >= 0)], prepend=0).astype(np.uint32), cold, *(to[x[mine]] for x in (u, v, w)), *(x[mine] for x in more))


def opened(data: bytes, hot: np.ndarray = NONE) -> list[np.ndarray]:
    at_hot, steps, *others = unsqueeze(data)
    words = np.cumsum(steps, dtype=np.uint64)
    if len(at_hot):
        words = np.sort(np.concatenate([hot[np.cumsum(at_hot, dtype=np.int64)], words]))
    return [words, *(x.astype(np.int64) if x.dtype == np.uint32 else x for x in others)]


def numbered(*columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Different words, ascending, and the columns as places in them."""
    found = pa.array(np.concatenate(columns).view(np.int64)).dictionary_encode()
    words = found.dictionary.to_numpy().view(np.uint64)
    order = np.argsort(words)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    return words[order], np.split(rank[found.indices.to_numpy()], np.cumsum([len(c) for c in columns])[:-1])


def combined(v: np.ndarray, u: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different (v, u, w) in order, with their counts together."""
    order = np.lexsort((w, u, v))
    v, u, w, n = v[order], u[order], w[order], n[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (u[1:] != u[:-1]) | (w[1:] != w[:-1])
    first = np.flatnonzero(new)
    return v[first], u[first], w[first], np.add.reduceat(n, first) if len(first) else n


def by_shard(rows: DataFrame, run, schema: str, *then: str) -> DataFrame:
    """`run` over rows of whole shards, in order of shard and `then`."""
    return rows.repartition("shard").sortWithinPartitions("shard", *then).mapInArrow(run, schema)


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """(shard, its rows) of rows in order of shard; rows are Python tuples, big values in them one at a time."""
    rows = (tuple(c[i].as_py() for c in batch.columns) for batch in batches for i in range(batch.num_rows))
    yield from ((k, g) for k, g in groupby(rows, key=lambda r: r[0]))


def trigram_counts(texts: DataFrame, size: int | None = None) -> DataFrame:
    """(shard, of, data) of one text column of about `size` bytes: every different trigram with its count, one row a shard
    of `of` (see `opened`)."""
    if size is None:
        size = texts.agg(F.sum(F.octet_length(texts.columns[0]))).first()[0] or 0
    of = PARTS * LANES * max(1, round(size / SHARD / PARTS / LANES))  # as many in each lane

    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, bytes]]:
        words, (u, v, w) = numbered(*(np.concatenate(x) for x in zip(*held, strict=True)))
        v, u, w, n = combined(v, u, w, np.ones(len(v), np.int64))
        yield from spread_out(words, u, v, w, [n], of)

    def batch_of(found: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        for shard, data in found:
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([data], pa.binary())], names=["shard", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            data, offsets = K.buffers(batch.column(0))
            for i, j in K.pieces(offsets, 2 * K.PIECE):
                held.append(tokens(*sequence(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))[:3])
                size += len(held[-1][0])
                if size > GROUP:
                    yield from batch_of(flush(held))
                    held, size = [], 0
        if size:
            yield from batch_of(flush(held))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in whole(batches):
            held = [opened(data) for _, data in rows]
            words, (u, v, w) = numbered(*(np.concatenate([x[0][x[k]] for x in held]) for k in (1, 2, 3)))
            v, u, w, n = combined(v, u, w, np.concatenate([x[4] for x in held]))
            data = squeeze(np.zeros(0, np.uint32), np.diff(words, prepend=np.uint64(0)), *(x.astype(np.uint32) for x in (u, v, w)), n)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([of], pa.int32()), pa.array([data], pa.binary())], names=["shard", "of", "data"])

    return by_shard(texts.mapInArrow(run, "shard int, data binary"), merge, "shard int, of int, data binary")


def discounts(times: list[int]) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more, from how many n-grams occur once to four times."""
    k = [max(x, 1) for x in times]
    y = k[0] / (k[0] + 2 * k[1])
    return [min(max(i - (i + 1) * y * k[i] / k[i - 1], 0.1), i - 0.1) for i in (1, 2, 3)]


@dataclass
class Shard:
    """A shard's trigrams with what the interpolation makes of them; u, v and w are places in `words`."""

    words: np.ndarray
    grams: list[np.ndarray]  # u, v, w, n of each trigram
    two: np.ndarray  # v * len(words) + w of each bigram, ascending
    before: np.ndarray  # u * len(words) + v of each context, ascending
    three: np.ndarray  # place in `before` * len(words) + w of each trigram, ascending
    gain1: np.ndarray  # of each word v: ln of its weight as a context, 0 if it is none here
    gain2: np.ndarray  # of each bigram as a prediction
    left2: np.ndarray  # of each context
    gain3: np.ndarray  # of each trigram, in the order of `three`
    p3: np.ndarray  # of each trigram, in the order of `grams`
    seen: np.ndarray  # occurrences of each bigram
    order: np.ndarray  # places in `grams` in the order of `three`

    @classmethod
    def of(cls, data: bytes, weights: bytes, law: dict) -> Shard:
        words, u, v, w, n = opened(data)
        size = len(words)
        follows = np.zeros(size, np.int64)
        follows[np.unique(w)] = unsqueeze(weights)[0]
        cut = lambda level, x: np.array(law["cuts"][level])[np.minimum(x, 3) - 1]
        p1 = np.where(follows > 0, (follows - cut(0, np.maximum(follows, 1))) / law["total"], 0.0) + law["floor"]
        two, at2, n2 = np.unique(v * size + w, return_inverse=True, return_counts=True)
        v2, w2 = two // size, two % size
        total1 = np.bincount(v2, n2, size)
        gamma1 = np.bincount(v2, cut(1, n2), size) / np.maximum(total1, 1)
        lower2 = gamma1[v2] * p1[w2]
        p2 = (n2 - cut(1, n2)) / total1[v2] + lower2
        before, at3 = np.unique(u * size + v, return_inverse=True)
        total2 = np.bincount(at3, n)
        gamma2 = np.bincount(at3, cut(2, n)) / total2
        lower3 = gamma2[at3] * p2[at2]
        p3 = (n - cut(2, n)) / total2[at3] + lower3
        three = at3 * size + w
        order = np.argsort(three)
        return cls(
            words, [u, v, w, n], two, before, three[order], np.log(np.where(gamma1 > 0, gamma1, 1.0)), np.log(p2 / lower2), np.log(gamma2),
            np.log(p3 / lower3)[order], p3, np.bincount(at2, n), order)

    def sums(self, words: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
        """Of each text, what its tokens after u and v of this shard gain over unigrams."""
        to = _find(self.words, words)
        u, v, w = to[u], to[v], to[w]
        size = len(self.words)
        value = np.where(v >= 0, self.gain1[v], 0.0)
        known = np.flatnonzero((v >= 0) & (w >= 0))
        at = _find(self.two, v[known] * size + w[known])
        value[known] += np.where(at >= 0, self.gain2[at], 0.0)
        known = np.flatnonzero((v >= 0) & (u >= 0))
        at = _find(self.before, u[known] * size + v[known])
        known, at = known[at >= 0], at[at >= 0]
        value[known] += self.left2[at]
        ok = w[known] >= 0
        known, at = known[ok], at[ok]
        at = _find(self.three, at * size + w[known])
        value[known] += np.where(at >= 0, self.gain3[at], 0.0)
        return np.bincount(text, value, texts)


def shards_of(batches: Iterator[pa.RecordBatch], law: dict) -> Iterator[tuple[Iterator[tuple], Shard]]:
    """(rows behind them, shard) of rows (shard, kind, data, ...) in order of shard and kind: 0 are the trigrams, 1 the weights."""
    for _, rows in whole(batches):
        data = [next(rows, (None,) * 3) for _ in range(2)]
        if [x[1] for x in data] == [0, 1]:
            yield rows, Shard.of(data[0][2], data[1][2], law)


def _find(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of each key in an ascending table, or -1."""
    at = np.searchsorted(table, key)
    at[at == len(table)] = 0
    return np.where(table[at] == key, at, -1) if len(table) else np.full(len(key), -1)


@dataclass
class KneserNey:
    """shards: (shard, of, data) of the trigrams; weights: (shard, data) of how many words each of its words follows;
    words: (one, n, times) of every word; law: discounts of each order, how many bigrams there are, and the probability of an unknown word; spread: standard
    deviation of -ln p over the tokens that it counts."""

    shards: DataFrame
    weights: DataFrame
    words: DataFrame
    law: dict
    spread: float

    @property
    def floor(self) -> float:
        return self.law["floor"]

    def gains(self) -> DataFrame:
        """(key, value, times) of every word as a prediction: what it gains over the floor."""
        cut = F.element_at(F.array(*map(F.lit, self.law["cuts"][0])), F.least(F.col("n"), F.lit(3)).cast("int"))
        p1 = (F.col("n") - cut) / F.lit(float(self.law["total"])) + F.lit(self.floor)
        return self.words.select(F.col("one").alias("key"), F.log(p1 / F.lit(self.floor)).alias("value"), "times")

    def rows(self) -> DataFrame:
        """(shard, kind, data): what `shards_of` reads."""
        return self.shards.select("shard", F.lit(0).alias("kind"), "data").unionByName(self.weights.select("shard", F.lit(1).alias("kind"), "data"))

    @property
    def values(self) -> DataFrame:
        """(key, value, times) of every word, bigram and trigram as a prediction, made when it is read."""
        law = self.law

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, s in shards_of(batches, law):
                u, v, w, n = s.grams
                size = len(s.words)
                with np.errstate(over="ignore"):
                    two = K.mix(s.words[s.two // size] * F2 + s.words[s.two % size] * F1)
                    three = K.mix(s.words[u] * F3 + s.words[v] * F2 + s.words[w] * F1)[s.order]
                columns = [(two, three), (s.gain2, s.gain3), (s.seen.astype(np.int64), n[s.order])]
                key, value, times = (np.concatenate(x) for x in columns)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(value), pa.array(times)], names=["key", "value", "times"])

        return self.gains().unionByName(by_shard(self.rows(), run, "key long, value double, times long", "kind"))


def sweep(spark: SparkSession) -> None:
    """Shuffles of what is done go: Spark deletes them when both driver processes have collected their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """`materialize`, and then the shuffles behind it go."""
    with tidy(spark):
        out = materialize(spark, df, name)
        del df
    return out


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """What is executed meanwhile deletes its shuffles when it ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
        sweep(spark)


def _followers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, one, n, times) of the words that others precede in a shard; under shards -2 and -3, how many bigrams
    and trigrams have a count of one to four."""
    for shard, rows in whole(batches):
        for _, _, data in rows:
            words, _, v, w, n = opened(data)
            two, at, n2 = np.unique(v * len(words) + w, return_inverse=True, return_counts=True)
            w2 = two % len(words)
            follows, times = np.bincount(w2, minlength=len(words)), np.bincount(w2, np.bincount(at, n), len(words)).astype(np.int64)
            at = np.flatnonzero(follows)
            law = [(-order, i, int((x == i).sum())) for order, x in ((2, n2), (3, n)) for i in range(1, 5)]
            one = np.concatenate([words[at].view(np.int64), np.array([x[1] for x in law], np.int64)])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([np.full(len(at), shard), [x[0] for x in law]]).astype(np.int32)), pa.array(one),
                pa.array(np.concatenate([follows[at], [x[2] for x in law]]).astype(np.int64)), pa.array(np.concatenate([times[at], np.zeros(len(law), np.int64)]))],
                names=["shard", "one", "n", "times"])


def _weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, data: n in the order of the words) of rows (shard, one, n) in order of shard."""
    last, held = None, []

    def row() -> pa.RecordBatch:
        one, n = (np.concatenate(x) for x in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([squeeze(n[np.argsort(one.view(np.uint64))])], pa.binary())], names=["shard", "data"])

    for batch in batches:
        shard, one, n = (c.to_numpy() for c in batch.columns)
        cuts = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo < hi:
                if held and shard[lo] != last:
                    yield row()
                    held = []
                last = int(shard[lo])
                held.append((one[lo:hi].copy(), n[lo:hi].copy()))
    if held:
        yield row()


def estimate(counts: DataFrame) -> KneserNey | None:
    """The model of a table of trigram counts; None if there are none."""
    spark = counts.sparkSession
    tri = written(spark, counts, "kn-counts")
    pairs = written(spark, tri.mapInArrow(_followers, "shard int, one long, n long, times long"), "kn-pairs")
    uni = written(spark, pairs.filter("shard >= 0").groupBy("one").agg(F.sum("n").alias("n"), F.sum("times").alias("times")), "kn-words")
    if uni.isEmpty():
        return None
    seen = {(r["shard"], r["one"]): r["n"] for r in pairs.filter("shard < 0").groupBy("shard", "one").agg(F.sum("n").alias("n")).collect()}
    ones = uni.agg(*(F.count(F.when(F.col("n") == i, 1)) for i in range(1, 5))).first()
    cuts = [discounts(list(ones)), *(discounts([seen[-order, i] for i in range(1, 5)]) for order in (2, 3))]
    cut1 = F.element_at(F.array(*map(F.lit, cuts[0])), F.least(F.col("n"), F.lit(3)).cast("int"))
    total, off, known = uni.agg(F.sum("n"), F.sum(cut1), F.count("*")).first()
    law = {"cuts": cuts, "total": total, "floor": off / total / (known + 1)}
    owned = pairs.filter("shard >= 0").select("shard", "one").join(uni.select("one", "n"), "one").select("shard", "one", "n")
    weights = written(spark, by_shard(owned, _weights, "shard int, data binary"), "kn-weights")
    release(pairs)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, s in shards_of(batches, law):
            x, n = np.log(s.p3), s.grams[3]
            yield pa.RecordBatch.from_arrays([pa.array([float(y)]) for y in (n.sum(), n @ x, n @ (x * x))], names=["n", "s", "q"])

    model = KneserNey(tri, weights, uni, law, 0.0)
    with tidy(spark):
        n, first, square = by_shard(model.rows(), moments, "n double, s double, q double", "kind").agg(F.sum("n"), F.sum("s"), F.sum("q")).first()
    model.spread = math.sqrt(max(square / n - (first / n) ** 2, 0.0))
    return model


def trusted_counted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, size: bytes) of the trusted documents that the model counts: all but the quarter that the thresholds come from."""
    trusted = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    sizes = docs.select(F.col(f"`{id_col}`").alias("_id"), F.octet_length(F.col(f"`{text_col}`").cast("string")).alias("size"))
    known = sizes.filter(F.pmod(F.xxhash64(F.lit("trusted"), "_id"), F.lit(4)) != 0).join(trusted, "_id")
    return known.groupBy("_id").agg(F.sum("size").alias("size"))


def likely(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of texts (_id, text) whose id is among ids (_id), and a few others: so that few texts go through a join."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(bloom(ids.select(*bloom_keys(F.col("_id")))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = in_bloom(sent.value, [batch.column(k).to_numpy() for k in (2, 3)])
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(ok)) for k in (0, 1)], names=["_id", "text"])

    return texts.select("_id", "text", *bloom_keys(F.col("_id"))).mapInArrow(run, texts.schema)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[KneserNey | None, DataFrame]:
    """(model or None, ids of the documents that it counts); one model for all languages, so lang_col is not read."""
    counted = materialize(docs.sparkSession, trusted_counted(docs, labels, id_col, text_col), "quality-counted")
    size = counted.agg(F.sum("size")).first()[0] or 0
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    texts = likely(texts, counted).join(counted.select("_id"), "_id")
    return estimate(trigram_counts(texts.select("text"), size)), counted


def gathered(texts: DataFrame, model: KneserNey, part: int, sent: Broadcast, blocks: int = 1) -> DataFrame:
    """(place, more) of what the tokens of (place, text) gain over unigrams in one part of the shards. `sent` has
    the most frequent words, which go as places in that table, and a Bloom filter of all words; others are as good as one.

    Groups of texts are dealt to `blocks`. A block's turn at a shard is block * of + shard, and a task has whole lanes of a block.
    """
    of = model.shards.select("of").first()[0]
    law = model.law

    def flush(group: int, block: int, held: list[tuple[np.ndarray, ...]], places: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        u, v, w, text = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        words, (u, v, w) = numbered(u, v, w)
        trim()
        known = (words == BEGIN) | in_bloom(sent.value[2], halves(words))
        to = np.where(known, np.cumsum(known) - 1, known.sum())
        words = np.append(words[known], UNKNOWN)
        ok = known[v]
        u, v, w, text = to[u[ok]], to[v[ok]], to[w[ok]], text[ok]
        place = np.concatenate(places).tobytes()
        met = set()  # shards come in order: places go along with the first of each lane
        for shard, found in spread_out(words, u, v, w, [text.astype(np.uint32)], of, sent.value[0]):
            lane = shard // PARTS % LANES
            row = [[block * of + shard], [2], [found], [group], [None if lane in met else place]]
            met.add(lane)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names=names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, groups = TaskContext.get().partitionId(), 0
        held, places, size, texts = [], [], 0, 0
        for batch in batches:
            place = batch.column(0).to_numpy()
            data, offsets = K.buffers(batch.column(1))
            for i, j in K.pieces(offsets, 2 * K.PIECE):
                u, v, w, text = tokens(*sequence(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                mine = home(v, of) % PARTS == part
                held.append((u[mine], v[mine], w[mine], text[mine] + texts))
                places.append(place[i:j].copy())
                size, texts = size + len(held[-1][0]), texts + j - i
                # what shares its words among many tokens needs the least room
                if size > GROUP // 2 or texts > GROUP // 2:
                    yield from flush((task << 32) + groups, (task + groups) % blocks, held, places)
                    held, places, size, texts, groups = [], [], 0, 0, groups + 1
        if held:
            yield from flush((task << 32) + groups, (task + groups) % blocks, held, places)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # places and sums of a block's groups
        now = None

        def summed() -> Iterator[pa.RecordBatch]:
            for place, more in held.values():
                ok = np.flatnonzero(more)
                yield pa.RecordBatch.from_arrays([pa.array(place[ok]), pa.array(more[ok])], names=["place", "more"])
            held.clear()

        for turn, rows in whole(batches):
            if turn // of != now:
                yield from summed()
                now = turn // of
            own, shard = [], None
            for _, kind, data, group, places in rows:
                if kind < 2:
                    own.append(data)
                    continue
                if places is not None and group not in held:
                    place = np.frombuffer(places, np.int64)
                    held[group] = place, np.zeros(len(place))
                if len(own) == 2:
                    shard = shard or Shard.of(*own, law)
                    more = held[group][1]
                    more += shard.sums(*opened(data, sent.value[0]), len(more))
        yield from summed()

    names, types = ["turn", "kind", "data", "group", "places"], [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary()]
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    own = model.rows().filter(F.col("shard") % PARTS == part).select(block.alias("block"), "shard", "kind", "data")
    own = own.select(
        (F.col("block") * of + F.col("shard")).alias("turn"), "kind", "data", F.lit(None).cast("long").alias("group"), F.lit(None).cast("binary").alias("places"))
    asked = texts.mapInArrow(ask, "turn long, kind int, data binary, group long, places binary").unionByName(own)
    lane = F.expr(f"turn div {of} * {LANES} + turn % {of} div {PARTS} % {LANES}")
    dealt = asked.repartition(lane).sortWithinPartitions("turn", "kind")
    return dealt.mapInArrow(answer, "place long, more double").groupBy("place").agg(F.sum("more").alias("more"))


def score(docs: DataFrame, model: KneserNey | None, carried: list[str], text_col: str = "text", table: int = TABLE) -> tuple[DataFrame, DataFrame]:
    """(place, row: struct of the carried columns) of the rows of docs, and (place, n_tokens, mean: -ln p a token), one
    row a place. A place is the hash of a text; rows of equal texts share it.

    Both are tables; nulls without a model. Whole rows stay out of all joins here.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit(""))
    source = docs.select(F.struct(*[docs[f"`{c}`"] for c in carried]).alias("row"), text.alias("text"), F.xxhash64(text).alias("place"))
    if model is None:
        rows = materialize(spark, source.select("place", "row"), "kn-parts")
        return rows, rows.select("place", F.lit(None).cast("long").alias("n_tokens"), F.lit(None).cast("double").alias("mean")).distinct()
    gains = model.gains()
    hot = from_most_frequent(gains, "key", "times", table).select("key", "value").toArrow()
    key, value = hot.column("key").to_numpy().view(np.uint64), hot.column("value").to_numpy()
    order = np.argsort(key)
    sent = spark.sparkContext.broadcast((key[order], value[order], bloom(gains.select(*hashed_keys(F.col("key"))))))
    sweep(spark)
    floor = math.log(model.floor)
    schema = T.StructType([
        T.StructField("place", T.LongType()), T.StructField("row", source.schema["row"].dataType), T.StructField("n_tokens", T.LongType()),
        T.StructField("total", T.DoubleType()), T.StructField("key", T.LongType()), T.StructField("times", T.IntegerType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, value, bits = sent.value
        for batch in batches:
            data, offsets = K.buffers(batch.column(1))
            kind = batch.schema.field(0).type
            place = batch.column(2).to_numpy()
            for i, j in K.pieces(offsets, 2 * K.PIECE):
                n = j - i
                key, at = sequence(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                key, at = key[key != BEGIN], at[key != BEGIN]
                tokens = np.bincount(at, minlength=n)
                where = _find(hot, key)
                known = where >= 0
                total = tokens * floor + np.bincount(at[known], weights=value[where[known]], minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(place[i:j]), batch.column(0).slice(i, n), pa.array(tokens.astype(np.int64)), pa.array(total), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())],
                    names=schema.fieldNames())
                key, at = key[~known], at[~known]
                maybe = in_bloom(bits, halves(key))
                key, at = key[maybe], at[maybe]
                if len(key):
                    o = np.lexsort((key, at))
                    key, at = key[o], at[o]
                    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (at[1:] != at[:-1])]))
                    m = len(new)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(place[i:j][at[new]]), pa.nulls(m, kind), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.array(key[new].view(np.int64)),
                         pa.array(np.diff(np.append(new, len(key))).astype(np.int32))], names=schema.fieldNames())

    parts = written(spark, source.mapInArrow(run, schema), "kn-parts")
    met = parts.filter("key is not null").select("place", "key", "times").join(gains.select("key", "value"), "key")
    more = met.groupBy("place").agg(F.sum(F.col("times") * F.col("value")).alias("more"))
    pieces = [written(spark, more, "kn-more")]
    rows = parts.filter("key is null")
    blocks = max(1, math.ceil(rows.count() / HELD))
    for part in range(PARTS):
        pieces.append(written(spark, gathered(source.select("place", "text"), model, part, sent, blocks), "kn-more"))
    more = reduce(DataFrame.unionByName, pieces).groupBy("place").agg(F.sum("more").alias("more"))
    # equal texts have each added their own
    base = rows.groupBy("place").agg(F.first("n_tokens").alias("n_tokens"), F.first("total").alias("total"), F.count("*").alias("copies"))
    mean = -(F.col("total") + F.coalesce(F.col("more") / F.col("copies"), F.lit(0.0))) / F.col("n_tokens")
    means = written(spark, base.join(more, "place", "left").select("place", "n_tokens", mean.alias("mean")), "kn-means")
    release(*pieces)
    sent.destroy()
    return rows.select("place", "row"), means


def student(quantile: float, df: int) -> float:
    """The quantile (0.5 or more) of Student's t with df degrees of freedom."""
    angle = np.linspace(0, np.pi / 2, 20_001)  # t = sqrt(df) * tan(angle)
    mass = np.cos(angle) ** (df - 1)
    below = np.concatenate([[0], np.cumsum(mass[1:] + mass[:-1])])
    return float(np.sqrt(df) * np.tan(np.interp(quantile, 0.5 + 0.5 * below / below[-1], angle)))


def upper_limit(values: list[float], quantile: float) -> float:
    """Where one more value lies above with a chance of about 1 - quantile, from few different ones.

    The spread is that of the values above the median: those far below it (near copies of what the model counted) don't count.
    """
    x = np.unique(values)
    if len(x) < 2:
        return float("inf")
    over = x[x > np.median(x)] - np.median(x)
    return float(max(x[-1], np.median(x) + student(quantile, len(over)) * np.sqrt((over**2).mean() * (1 + 1 / len(x)))))


def limits(scored: DataFrame, labels: DataFrame, counted: DataFrame, quantile: float = QUANTILE, enough: int = ENOUGH) -> DataFrame:
    """(_lang, limit) of every language of `scored` (_id, _lang, surprise)."""
    trusted = labels.filter("quality = 1").select(F.col("doc_id").alias("_id")).distinct().join(counted, "_id", "left_anti").withColumn("_held", F.lit(True))
    rows = scored.join(trusted, "_id", "left")
    held = F.when(F.col("_held"), F.col("surprise"))
    per = rows.groupBy("_lang").agg(F.count("_held").alias("n"), F.percentile_approx(held, quantile, 10_000).alias("held"))
    # fewer than `enough` values of each such language are gathered
    thin = per.filter(F.col("n") < enough).select(F.col("_lang").alias("_thin"))
    few = rows.filter("_held").join(thin, F.col("_lang").eqNullSafe(F.col("_thin"))).groupBy("_thin").agg(F.collect_list("surprise").alias("v"))
    bound = F.udf(lambda v: upper_limit(v, quantile), "double")
    few = few.select("_thin", bound("v").alias("bound"))
    own = F.when(F.col("n") >= enough, F.col("held")).otherwise(F.coalesce("bound", F.lit(float("inf"))))
    return per.join(few, F.col("_lang").eqNullSafe(F.col("_thin")), "left").select("_lang", own.alias("limit"))


def judge(
    docs: DataFrame, labels: DataFrame, carried: list[str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    quantile: float = QUANTILE, z: float = Z, table: int = TABLE, only: Column | None = None,
) -> DataFrame:
    """(row: struct of the carried columns, n_tokens, perplexity, surprise, threshold, keep), where `only` holds."""
    spark = docs.sparkSession
    model, counted = fit(docs, labels, id_col, text_col, lang_col)
    trim()
    rows, means = score(docs, model, carried, text_col, table)
    # the end alone says nothing about a text
    error = F.lit(z * model.spread if model else 0.0) / F.sqrt("n_tokens")
    surprise = F.when(F.col("n_tokens") > 1, F.col("mean") - error).otherwise(0.0)
    of = F.col("row").getField
    scored = rows.select("place", of(id_col).alias("_id"), of(lang_col).alias("_lang")).join(means, "place").withColumn("surprise", surprise)
    # one row a language: read back small enough that Spark itself broadcasts it, by its size
    cut = materialize(spark, limits(scored.select("_id", "_lang", "surprise"), labels, counted, quantile).withColumnRenamed("_lang", "_of"), "quality-limits")
    threshold = F.when(F.col("n_tokens") > 1, F.exp(F.col("limit") + error)).otherwise(F.lit(float("inf")))
    judged = rows.join(means, "place").join(cut, of(lang_col).eqNullSafe(F.col("_of"))).select(
        "row", "n_tokens", F.exp("mean").alias("perplexity"), surprise.alias("surprise"), threshold.alias("threshold"))
    judged = judged.withColumn("keep", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
    if model:
        release(model.shards, model.weights, model.words)
    return judged if only is None else judged.filter(only)


def classify(docs: DataFrame, labels: DataFrame, with_text: bool = True, text_col: str = "text", **options) -> DataFrame:
    """docs with n_tokens, perplexity, surprise, threshold and keep (see `judge` for the options)."""
    named = [options.get(k, k.replace("id_col", "doc_id").replace("lang_col", "lang")) for k in ("id_col", "lang_col")]
    carried = [c for c in docs.columns if c in named or c not in OUTPUTS and (with_text or c != text_col)]
    judged = judge(docs, labels, carried, text_col=text_col, **options)
    return judged.select(*[F.col("row").getField(c).alias(c) for c in carried if c not in OUTPUTS], *OUTPUTS)


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that aren't rejected, with all their columns as they are."""
    return judge(docs, labels, docs.columns, only=F.col("keep"), **options).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, labels, with_text=False).select("doc_id", "lang", "n_tokens", "perplexity", "threshold", "keep", "surprise")
