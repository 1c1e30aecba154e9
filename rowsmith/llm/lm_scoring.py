"""Operator 4, LM scoring: a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

The model predicts a token's unit from the CONTEXT tokens before it. The `words` most frequent training tokens are
units of their own; all others, known or not, share BUCKETS units by hash. Units stand in CLASSES classes of SLOTS, words
before buckets and each in order of frequency, and each has a vector as context and one as prediction. With h = sum_k C_k r(token k back), a class has
the score q_c . h + b_c, and a unit inside its class q_u . h + b_u; batched matrix products over the classes, and over
the units of one class, make both normalised. Of the probability of all buckets together, the unknown token has the share
that discounting each known token in them would leave; of the rest of its bucket's, a known token has what its training
count is of the bucket's. So probabilities sum to one over the V known tokens and one unknown token.

Training goes over every position of all training rows, in tasks: ROUNDS times every task starts from the same
parameters and takes steps on all positions of those of its rows that belong to the round. A hash of the text deals each
row to exactly one round, so all are learnt from once, whatever their order, and none is left out. The noise of the
estimation is taken in exact expectation over a class's units and over the classes. Then parameters are averaged row by row, weighted by how often a task met the row;
a task sends 2 MB of them, whatever its input. Token counts cover all training rows (combined inside each task, then by hash).

For scoring, the end and the `table` most frequent tokens are broadcast (28 bytes each, at most `table` of them whatever
the data) beside the model (6 MB); the rest of each text's tokens are joined with the counts by hash. Frequent tokens never
reach that join, so no key of it is hot.

Tokens are known by 64-bit hashes. Defined cases: a null or empty text is one end token; null ids belong to the
crc32 of the empty text; repeated rows are rows of their own, each scored and each learnt from; with no training
rows only the unknown token and the end exist; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsmith.llm import textkernel as K
from rowsmith.llm.common import crc_mod, from_most_frequent, materialize, shuffle_partitions

CLASSES, SLOTS, BUCKETS = 64, 128, 2048
UNITS = CLASSES * SLOTS
#: Classes from here on are the buckets'.
RARE = CLASSES - BUCKETS // SLOTS
CONTEXT, DIM = 3, 32
NOISE, RATE = 8, 0.15
#: Positions a step; fewer where a task has little text, down to FEWEST, so that it still takes STEPS of them.
BATCH, FEWEST, STEPS = 8192, 256, 16
ROUNDS = 2
TABLE = 1 << 18
#: Distinct tokens are combined in groups of about so many tokens.
GROUP = 4_000_000
#: Positions that a task gathers before it takes steps on them in shuffled batches.
GATHERED = 1 << 17
#: Rows of parameters that travel together.
CHUNK = 1024
END = np.uint64(0x5851F42D4C957F2D)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every token: the words of each text and then its end."""
    word, text = K.words(data, offsets)
    n = len(offsets) - 1
    out, at = np.empty(len(word) + n, np.uint64), np.empty(len(word) + n, np.int64)
    place = np.arange(len(word)) + text
    out[place], at[place] = word, text
    ends = np.cumsum(np.bincount(text, minlength=n)) + np.arange(n)
    out[ends], at[ends] = END, np.arange(n)
    return out, at


def _texts(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = K.buffers(batch.column(at))
        for i, j in K.pieces(offsets):
            yield batch, i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def token_counts(texts: DataFrame) -> DataFrame:
    """(token: hash as long, n) over one text column; each task combines its own tokens first."""

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for _, _, _, data, offsets in _texts(batches, 0):
            parts.append(tokens(data, offsets)[0])
            size += len(parts[-1])
            if size > GROUP:
                yield flush(parts)
                parts, size = [], 0
        if parts:
            yield flush(parts)

    return texts.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def of_round(texts: DataFrame, turn: int) -> DataFrame:
    """The rows that the turn-th round learns from: every row, equal texts together, belongs to one of the ROUNDS."""
    return texts.filter(F.pmod(F.xxhash64(F.lit("round"), F.col(f"`{texts.columns[0]}`")), F.lit(ROUNDS)) == turn)


def buckets_of(token: np.ndarray) -> np.ndarray:
    return (token & np.uint64(BUCKETS - 1)).astype(np.int64)


def find(token: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, found) of each token among ascending keys."""
    if not len(keys):
        return np.zeros(len(token), np.int64), np.zeros(len(token), bool)
    at = np.searchsorted(keys, token)
    at[at == len(keys)] = 0
    return at, keys[at] == token


@dataclass
class Units:
    """Which unit a token is: words (ascending hashes) have their own, the rest that of their bucket."""

    words: np.ndarray
    own: np.ndarray
    bucket: np.ndarray
    end: int

    def of(self, token: np.ndarray) -> np.ndarray:
        at, found = find(token, self.words)
        shared = self.bucket[buckets_of(token)]
        return np.where(found, self.own[at], shared) if len(self.own) else shared

    def contexts(self, unit: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The units of the CONTEXT tokens before each, nearest first; before a text stand ends."""
        out = np.full((CONTEXT, len(unit)), self.end)
        for k in range(1, CONTEXT + 1):
            same = np.flatnonzero(text[k:] == text[:-k]) + k
            out[k - 1, same] = unit[same - k]
        return out


class Model:
    """The log-bilinear parameters; prior is the training frequency of each unit, in order."""

    def __init__(self, prior: np.ndarray, seed: int = 7) -> None:
        p = (prior + 0.5) / (prior + 0.5).sum()
        self.classes = p.reshape(CLASSES, SLOTS).sum(1)
        self.inside = (p.reshape(CLASSES, SLOTS) / self.classes[:, None]).astype(np.float32)
        rng = np.random.default_rng(seed)
        width = lambda n, b: np.zeros((n, DIM + 1), np.float32) if b is None else np.concatenate([np.zeros((n, DIM)), np.log(b).reshape(n, 1)], 1).astype(np.float32)
        self.r = width(UNITS, None)
        self.r[:, :DIM] = rng.normal(0, 0.1, (UNITS, DIM))
        self.q, self.qc = width(UNITS, self.inside), width(CLASSES, self.classes)
        self.c = width(CONTEXT * DIM, None)
        self.c[:, :DIM] = np.concatenate([np.eye(DIM) * 0.8**k for k in range(CONTEXT)])

    def rows(self) -> np.ndarray:
        """All parameters; every row has a last place for a bias, which r and C leave at zero."""
        return np.concatenate([self.r, self.q, self.qc, self.c])

    def with_rows(self, rows: np.ndarray) -> Model:
        out = object.__new__(Model)
        out.classes, out.inside = self.classes, self.inside
        out.r, out.q, out.qc, out.c = (x.astype(np.float32) for x in np.split(rows, np.cumsum([UNITS, UNITS, CLASSES])))
        return out

    def projected(self) -> np.ndarray:
        """C_k r of every unit and k, and a last place that adds up to 1, for the bias."""
        out = np.zeros((CONTEXT, UNITS, DIM + 1), np.float32)
        for k, c in enumerate(np.split(self.c, CONTEXT)):
            out[k, :, :DIM] = self.r[:, :DIM] @ c[:, :DIM]
        out[0, :, DIM] = 1
        return out

    def log_probability(self, projected: np.ndarray, contexts: np.ndarray, unit: np.ndarray, batch: int = 8192) -> tuple[np.ndarray, np.ndarray]:
        """ln p(unit | contexts) and ln p(any bucket | contexts), normalised; batches whose scores stay in the processor's cache."""
        out, rare = np.empty(len(unit), np.float64), np.empty(len(unit), np.float64)
        for lo in range(0, len(unit), batch):
            order, runs = _by_class(unit[lo : lo + batch])
            order += lo
            h = projected[0].take(contexts[0, order], axis=0)
            for k in range(1, CONTEXT):
                h += projected[k].take(contexts[k, order], axis=0)
            cls, inside = np.divmod(unit[order], SLOTS)
            total, rare[order] = _log_softmax(h @ self.qc.T, cls, RARE)
            for k, rows in runs:
                total[rows] += _log_softmax(h[rows] @ self.q[k * SLOTS : (k + 1) * SLOTS].T, inside[rows])[0]
            out[order] = total
        return out, rare


def _log_softmax(scores: np.ndarray, at: np.ndarray, tail: int | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """ln of the normalised probability at one place a row, and of all places from `tail` on; scores are used up."""
    mine = scores[np.arange(len(at)), at]
    if scores.max() > 80:  # beyond what single precision can sum
        top = scores.max(1)
        scores -= top[:, None]
        mine = mine - top
    np.exp(scores, out=scores)
    total = np.log(scores.sum(1))
    return mine - total, None if tail is None else np.log(np.maximum(scores[:, tail:].sum(1), np.finfo(np.float32).tiny)) - total


def _by_class(unit: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order of some units by their classes, and each class's place in it."""
    cls = unit // SLOTS
    order = np.argsort(cls.astype(np.int16), kind="stable")  # short integers are sorted by their digits
    cuts = np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=CLASSES))]).tolist()
    return order, [(k, slice(cuts[k], cuts[k + 1])) for k in range(CLASSES) if cuts[k] < cuts[k + 1]]


def nce_gradient(scores: np.ndarray, target: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Of ln s(score - ln noise) at the targets plus, over all outcomes, noise * ln s(ln noise - score); noise: times their frequency."""
    rows = np.arange(len(target))
    with np.errstate(over="ignore"):  # an infinite denominator is a probability of 0
        s = np.log(noise) - scores
        np.exp(s, out=s)
        s += 1
        np.divide(-noise, s, out=s)
    mine = s[rows, target]
    s[rows, target] += 1 + mine / noise[target]
    return s


def steps(model: Model, squares: dict[str, np.ndarray], contexts: np.ndarray, unit: np.ndarray, rng: np.random.Generator) -> None:
    """One pass of Adagrad, in place, over positions (contexts: a row each) in shuffled batches; a step size a row of parameters."""
    order = rng.permutation(len(unit))
    batch = min(max(len(unit) // STEPS, FEWEST), BATCH)
    c, r = model.c[:, :DIM].copy(), model.r[:, :DIM].copy()  # without the place of a bias
    noise, inside_noise = (NOISE * model.classes).astype(np.float32), NOISE * model.inside

    def climb(table: np.ndarray, square: np.ndarray, grad: np.ndarray) -> None:
        square += np.einsum("ij,ij->i", grad, grad) / (DIM + 1)
        grad *= (RATE / np.sqrt(square))[:, None]
        table += grad

    for lo in range(0, len(order), batch):
        i = order[lo : lo + batch]
        at, runs = _by_class(unit[i])
        i = i[at]
        ids, u = contexts.take(i, axis=0).ravel(), unit[i]
        x = r.take(ids, axis=0).reshape(len(u), CONTEXT * DIM)
        h = np.ones((len(u), DIM + 1), np.float32)  # a last place for the bias
        h[:, :DIM] = x @ c
        cls, inside = np.divmod(u, SLOTS)
        g = nce_gradient(h @ model.qc.T, cls, noise)
        dh, dqc = g @ model.qc, g.T @ h
        for k, rows in runs:
            own = slice(k * SLOTS, (k + 1) * SLOTS)
            q, mine = model.q[own], h[rows]
            g = nce_gradient(mine @ q.T, inside[rows], inside_noise[k])
            dh[rows] += g @ q
            climb(q, squares["q"][own], g.T @ mine)
        climb(model.qc, squares["qc"], dqc)
        dh = np.ascontiguousarray(dh[:, :DIM])
        back, dc = (dh @ c.T).reshape(-1, DIM), x.T @ dh
        squares["c"] += np.einsum("ij,ij->i", dc, dc) / DIM
        c += 0.1 * RATE * dc / np.sqrt(squares["c"])[:, None]
        o = np.argsort(ids, kind="stable")
        ids = ids[o]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        at, grad = ids[first], np.add.reduceat(back.take(o, axis=0), first, axis=0)
        squares["r"][at] += np.einsum("ij,ij->i", grad, grad) / DIM
        r[at] += RATE * grad / np.sqrt(squares["r"][at])[:, None]
    model.c[:, :DIM], model.r[:, :DIM] = c, r


def trained(texts: DataFrame, units: Units, model: Model, turn: int, partitions: int) -> Model:
    """The model after one round, the turn-th, over one text column."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast((units, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, start = sent.value
        model = start.with_rows(start.rows())
        squares = {k: np.full(len(getattr(model, k)), 0.1, np.float32) for k in ("r", "q", "qc", "c")}
        met, asked, n = np.zeros(UNITS), np.zeros(CLASSES), 0
        rng, held, size = np.random.default_rng(turn), [], 0

        def climb() -> None:
            nonlocal n
            contexts, unit = np.concatenate([c for c, _ in held]), np.concatenate([u for _, u in held])
            met[:] += np.bincount(contexts.ravel(), minlength=UNITS)
            asked[:] += np.bincount(unit // SLOTS, minlength=CLASSES)
            n += len(unit)
            steps(model, squares, contexts, unit, rng)

        for _, _, _, data, offsets in _texts(batches, 0):
            token, text = tokens(data, offsets)
            unit = units.of(token)
            held.append((units.contexts(unit, text).T.astype(np.int16, order="C"), unit))  # sorted by their digits later
            size += len(unit)
            if size >= GATHERED:
                climb()
                held, size = [], 0
        if size:
            climb()
        if n:
            rows, weight = model.rows(), np.concatenate([met, np.repeat(asked, SLOTS), np.full(CLASSES + CONTEXT * DIM, float(n))]).astype(np.float32)
            at = range(0, len(rows), CHUNK)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(at), pa.int32()), pa.array([rows[i : i + CHUNK].tobytes() for i in at], pa.binary()),
                 pa.array([weight[i : i + CHUNK].tobytes() for i in at], pa.binary())], names=["chunk", "rows", "weight"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for at, rows, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = np.frombuffer(weight, np.float32).astype(np.float64)
                x = np.frombuffer(rows, np.float32).reshape(-1, DIM + 1) * w[:, None]
                if at in sums:
                    sums[at][0] += x
                    sums[at][1] += w
                else:
                    sums[at] = [x, w]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x, _ in sums.values()], pa.binary()), pa.array([w.tobytes() for _, w in sums.values()], pa.binary())],
            names=["chunk", "rows", "weight"])

    schema = "chunk int, rows binary, weight binary"
    found = of_round(texts, turn).mapInArrow(run, schema).repartition(partitions, "chunk").mapInArrow(mean, schema).toArrow()  # one row a chunk of the model
    rows = model.rows().astype(np.float64)
    for at, x, w in zip(*(c.to_pylist() for c in found.columns), strict=True):
        w = np.frombuffer(w, np.float64)
        some, at = w > 0, at + np.flatnonzero(w > 0)
        rows[at] = np.frombuffer(x, np.float64).reshape(-1, DIM + 1)[some] / w[some, None]
    sent.destroy()
    return model.with_rows(rows)


@dataclass
class Fitted:
    """counts: (token, n); the `keys` most frequent ones have their counts in `ns`; bucket_n: counts of the known tokens of
    each bucket; unknown: the unknown token's share of all buckets' probability."""

    counts: DataFrame
    total: int
    known: int
    keys: np.ndarray
    ns: np.ndarray
    units: Units
    model: Model
    bucket_n: np.ndarray
    unknown: float

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 1) / (self.total + self.known + 1))


def fit(texts: DataFrame, table: int = TABLE, words: int = UNITS - BUCKETS) -> Fitted:
    """The model of one text column; `words`, at most UNITS - BUCKETS, counts the end."""
    spark = texts.sparkSession
    counts = materialize(spark, token_counts(texts), "lm-counts")
    sizes = counts.groupBy(F.pmod("token", F.lit(BUCKETS)).alias("b")).agg(
        F.sum("n").alias("n"), F.count("*").alias("v"), F.count(F.when(F.col("n") == 1, 1)).alias("n1"), F.count(F.when(F.col("n") == 2, 1)).alias("n2")).toArrow()
    b, n, v, n1, n2 = (sizes.column(c).to_numpy() for c in ("b", "n", "v", "n1", "n2"))
    bucket_n, bucket_v = np.zeros(BUCKETS), np.zeros(BUCKETS)
    bucket_n[b], bucket_v[b] = n, v
    end = F.col("token") == F.lit(int(END.view(np.int64)))
    rows = from_most_frequent(counts.filter(~end), "token", "n", table).unionByName(counts.filter(end)).select("token", "n").toArrow()
    keys, ns = rows.column("token").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(keys)
    keys, ns = keys[order], ns[order]
    # units: the end, the most frequent words, the buckets; then by frequency
    own = [i for i in np.lexsort((keys, -ns)) if keys[i] != END][: words - 1]
    at_end, there = find(np.array([END]), keys)
    names = np.concatenate([np.array([END]), keys[own]])
    times = np.concatenate([ns[at_end] if there[0] else np.zeros(1), ns[own]]).astype(np.float64)
    np.subtract.at(bucket_n, buckets_of(names), times)
    np.subtract.at(bucket_v, buckets_of(names), (times > 0).astype(float))
    prior, place, bucket = np.zeros(UNITS), np.empty(len(times), np.int64), np.empty(BUCKETS, np.int64)
    place[np.argsort(-times, kind="stable")] = np.arange(len(times))
    bucket[np.argsort(-bucket_n, kind="stable")] = np.arange(UNITS - BUCKETS, UNITS)
    prior[place], prior[bucket] = times, bucket_n
    o = np.argsort(names)
    units = Units(names[o], place[o], bucket, int(place[0]))
    model = Model(prior)
    if len(keys):
        for turn in range(ROUNDS):
            model = trained(texts, units, model, turn, shuffle_partitions(spark))
    ones, twos = int(n1.sum()), int(n2.sum())
    cut = ones / (ones + 2 * twos) if ones and twos else 0.5
    unknown = cut * bucket_v.sum() / bucket_n.sum() if bucket_n.sum() else 1.0
    return Fitted(counts, int(n.sum()), int(v.sum()), keys, ns, units, model, bucket_n, float(unknown))


def score(docs: DataFrame, id_col: str, text_col: str, learnt: Column, fitted: Fitted) -> DataFrame:
    """One row per row of docs: id_col, learnt, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`").cast("string")
    f = fitted
    own = find(f.keys, f.units.words)[1]
    in_bucket = f.bucket_n[buckets_of(f.keys)]
    share = np.where(~own, np.log10(max(1 - f.unknown, 1e-300) * f.ns / np.maximum(in_bucket, 1)), 0.0) if len(f.keys) else np.zeros(0)
    unknown, nothing = math.log10(f.unknown), float(f.base(np.zeros(1))[0])
    key_unit = f.units.of(f.keys)
    sent = spark.sparkContext.broadcast((f.keys, key_unit, f.base(f.ns) if len(f.keys) else np.zeros(0), share, f.units, f.model))

    id_type = docs.schema[id_col].dataType
    part = T.StructType([
        T.StructField("row", T.LongType()), T.StructField("id", id_type), T.StructField("learnt", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()),
        T.StructField("score", T.DoubleType()), T.StructField("token", T.LongType()), T.StructField("times", T.IntegerType()),
        T.StructField("known", T.FloatType()),
    ])

    def batch_schema(batch: pa.RecordBatch) -> pa.Schema:
        kinds = [pa.int64(), batch.schema.field(0).type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int32(), pa.float32()]
        return pa.schema([(f.name, k) for f, k in zip(part.fields, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys, key_unit, base, share, units, model = sent.value
        projected = model.projected()
        row = TaskContext.get().partitionId() << 40  # rows are told apart by task and place; the output is written once
        for batch, i, j, data, offsets in _texts(batches, 2):
            n = j - i
            token, at = tokens(data, offsets)
            k, known = find(token, keys)
            bucket = buckets_of(token)
            unit = np.where(known, key_unit[k], units.bucket[bucket]) if len(keys) else units.of(token)
            logp, rare = (x / math.log(10) for x in model.log_probability(projected, units.contexts(unit, at), unit))
            # what the table lacks counts as unknown until the join below finds it; the end is never unknown
            if len(keys):
                score, bases = np.where(known, logp + share[k], rare + unknown), np.where(known, base[k], nothing)
            else:
                score, bases = np.where(token == END, logp, rare + unknown), np.full(len(token), nothing)
            add = lambda x: np.bincount(at, weights=x, minlength=n)  # noqa: E731, B023
            rows = np.arange(row, row + n)
            row += n
            yield pa.RecordBatch.from_arrays([
                pa.array(rows), batch.column(0).slice(i, n), batch.column(1).slice(i, n),
                pa.array(np.bincount(at, minlength=n).astype(np.int64)), pa.array(add(known.astype(float)).astype(np.int64)),
                pa.array(add(bases)), pa.array(add(score)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.float32()),
            ], schema=batch_schema(batch))
            left, where, known_as = token[~known], at[~known], (logp - rare - unknown)[~known]
            if len(left):
                o = np.lexsort((left, where))
                left, where, known_as = left[o], where[o], known_as[o]
                new = np.flatnonzero(np.concatenate([[True], (left[1:] != left[:-1]) | (where[1:] != where[:-1])]))
                m = len(new)
                times = np.diff(np.append(new, len(left))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(rows[where[new]]), pa.nulls(m, batch.schema.field(0).type), pa.nulls(m, pa.bool_()), *(pa.nulls(m, pa.int64()) for _ in range(2)),
                    *(pa.nulls(m, pa.float64()) for _ in range(2)), pa.array(left[new].view(np.int64)), pa.array(times),
                    pa.array(np.add.reduceat(known_as, new).astype(np.float32)),
                ], schema=batch_schema(batch))

    source = docs.select(F.col(f"`{id_col}`").alias("id"), learnt.alias("learnt"), text.alias("text"))
    done = materialize(spark, source.mapInArrow(run, part), "lm-parts")
    sent.destroy()
    # what a known token outside the broadcast table has of its bucket, one row a token
    left = math.log10(max(1 - f.unknown, 1e-300))
    buckets = spark.createDataFrame([(b, left - math.log10(max(n, 1))) for b, n in enumerate(f.bucket_n.tolist())], "b int, less double")
    gains = f.counts.join(buckets, F.pmod("token", F.lit(BUCKETS)).cast("int") == F.col("b")).select(
        "token", F.log10(F.col("n") + 1).alias("base_gain"), (F.log10("n") + F.col("less")).alias("gain"))
    rest = done.filter("token is not null").select("row", "token", "times", "known").join(gains, "token").groupBy("row").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.col("base_gain")).alias("base_more"), F.sum(F.col("known") + F.col("times") * F.col("gain")).alias("score_more"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return done.filter("token is null").join(rest, "row", "left").select(
        F.col("id").alias(id_col), "learnt", "n_tokens", (F.col("n_known") + zero("more")).cast("long").alias("n_known"),
        F.lit(f.total).cast("long").alias("train_tokens"), (F.col("base") + zero("base_more")).alias("base_score"),
        (F.col("score") + zero("score_more")).alias("score"),
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learnt = crc_mod(F.col("doc_id"), 7) != 2
    out = score(docs, "doc_id", "text", learnt, fit(docs.filter(learnt).select(F.col("text").cast("string").alias("text"))))
    return out.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
