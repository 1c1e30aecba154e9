"""Operator 1, toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A token is read through a hashed embedding of its word (ASCII-lowered, without ASCII punctuation at its ends) and
the mean of hashed embeddings of its byte n-grams (3 to 5 bytes, with marks at both ends), so inflected and
unseen forms are known by their parts. A text is cut into windows of WINDOW tokens, half overlapping; forward and
backward gated units read each window, attention pools their states, and the text's score is that of its
strongest window after a logistic calibration.

Only texts are labelled, so training alternates: the current model picks the strongest windows of toxic texts as
positives and the strongest and some random windows of clean texts as negatives, then back-propagation through
time fits them. It starts from embeddings that hold each feature's log odds in the labelled sample.

The labelled sample is bounded: at most `per_class` texts of each label, the first by a hash of their id, and of these
no more than have `class_bytes` bytes together (documented parameters); a fifth of it is kept for the calibration. All texts are scored whole.

Defined cases: a null or empty text is one empty window with the lowest score; null ids are scored, and
never learnt from; repeated rows are rows of their own, and one text to learn from; a document labelled both ways is
toxic; without labels of both kinds every score is 0; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowsmith.llm import textkernel as K
from rowsmith.llm.common import crc_mod, materialize

WINDOW, STRIDE = 32, 16
WORDS, GRAMS = 1 << 16, 1 << 16
DIM, HIDDEN, ATTEND = 8, 12, 8
GRAM_SIZES = (3, 4, 5)
PER_CLASS, CLASS_BYTES = 1200, 64 << 20
THRESHOLD = 0.3
#: Windows and words are handled in blocks of so many.
BLOCK = 4096

_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


class Tokens:
    """Tokens of some texts as indexes of their distinct words, with those words' features."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        data = K.LOWER[data]
        start, end, self.text = K.spans(data, offsets)
        for _ in range(3):  # a word of punctuation alone keeps its last byte
            end = end - (_PUNCT[data[end - 1]] & (end - start > 1)) if len(end) else end
            start = start + (_PUNCT[data[start]] & (end - start > 1)) if len(start) else start
        self.n_texts = len(offsets) - 1
        word, first, self.index = np.unique(K.hashes(data, start, end), return_index=True, return_inverse=True)
        self.word = (word % np.uint64(WORDS)).astype(np.int64)
        self.gram, self.cut = self._grams(data, start[first], end[first])
        self.count = np.bincount(self.text, minlength=self.n_texts)

    @staticmethod
    def _grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, offsets) of the byte n-grams of each marked word."""
        size = end - start + 2
        cut = np.concatenate([[0], np.cumsum(size)])
        flat = np.zeros(cut[-1], np.uint64)
        inner = np.arange(cut[-1]) - np.repeat(cut[:-1], size)
        body = (inner > 0) & (inner < np.repeat(size, size) - 1)
        flat[body] = data[(np.repeat(start, size) + inner - 1)[body]]
        flat[cut[:-1]], flat[cut[1:] - 1] = 1, 2
        owner = np.repeat(np.arange(len(start)), size)
        found, whose = [], []
        with np.errstate(over="ignore"):
            for n in GRAM_SIZES:
                if len(flat) < n:
                    continue
                h = np.full(len(flat) - n + 1, n, np.uint64)
                for k in range(n):
                    h = h * K.BASE + flat[k : len(flat) - n + 1 + k]
                ok = owner[: len(flat) - n + 1] == owner[n - 1 :]
                found.append((K.mix(h[ok]) % np.uint64(GRAMS)).astype(np.int32))
                whose.append(owner[: len(flat) - n + 1][ok])
        if not found:
            return np.zeros(0, np.int32), np.zeros(len(start) + 1, np.int64)
        found, whose = np.concatenate(found), np.concatenate(whose)
        o = np.argsort(whose, kind="stable")
        return found[o], np.searchsorted(whose[o], np.arange(len(start) + 1))

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first token, length, text) of every window; a text without tokens has one of length 0."""
        per = np.maximum(1, -(-(self.count - WINDOW) // STRIDE) + 1)
        text = np.repeat(np.arange(self.n_texts), per)
        k = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        begin = np.cumsum(self.count) - self.count
        return begin[text] + k * STRIDE, np.minimum(self.count[text] - k * STRIDE, WINDOW), text


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Net:
    """The network's parameters, forward pass and gradients."""

    def __init__(self, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        small = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {
            "words": rng.normal(0, 0.02, (WORDS, DIM)).astype(np.float32), "grams": rng.normal(0, 0.02, (GRAMS, DIM)).astype(np.float32),
            "wa": small(2 * HIDDEN, ATTEND), "va": small(ATTEND), "out": small(2 * HIDDEN), "b": np.full(1, -1.0, np.float32),
        }
        for d in "fb":
            self.p |= {f"x{d}": small(2 * DIM, 3 * HIDDEN), f"u{d}": small(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.calibration = (1.0, 0.0)

    def inputs(self, t: Tokens) -> np.ndarray:
        """The 2 * DIM input of each distinct word."""
        mean = np.zeros((len(t.word), DIM), np.float32)
        for lo in range(0, len(t.word), BLOCK):  # every word has grams: its marks make it three bytes at least
            cut = t.cut[lo : lo + BLOCK + 1]
            mean[lo : lo + BLOCK] = np.add.reduceat(self.p["grams"][t.gram[cut[0] : cut[-1]]], cut[:-1] - cut[0], axis=0) / np.diff(cut)[:, None]
        return np.concatenate([self.p["words"][t.word], mean], axis=1)

    def _run(self, d: str, x: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States (window, place, HIDDEN) of one direction; x: projected inputs of the distinct words."""
        n, size = index.shape
        h, u = np.zeros((n, HIDDEN), np.float32), self.p[f"u{d}"]
        states = np.empty((n, size, HIDDEN), np.float32)
        for t in range(size) if d == "f" else range(size - 1, -1, -1):
            a, v = x[index[:, t]], h @ u
            g = sigmoid(a[:, : 2 * HIDDEN] + v[:, : 2 * HIDDEN])
            z, r = g[:, :HIDDEN], g[:, HIDDEN:]
            c = np.tanh(a[:, 2 * HIDDEN :] + r * v[:, 2 * HIDDEN :])
            m = mask[:, t, None]
            new = h + m * (1 - z) * (c - h)
            if keep is not None:
                keep.append((t, h, z, r, c, v[:, 2 * HIDDEN :], m))
            states[:, t] = h = new
        return states

    def forward(self, x: dict, index: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window."""
        states = np.concatenate([self._run(d, x[d], index, mask, keep[d] if keep else None) for d in "fb"], axis=2)
        att = np.tanh(states @ self.p["wa"])
        e = np.where(mask > 0, att @ self.p["va"], -1e9)
        w = np.exp(e - e.max(1, keepdims=True)) * mask
        w /= np.maximum(w.sum(1, keepdims=True), 1e-9)
        pooled = (w[:, :, None] * states).sum(1)
        if keep is not None:
            keep |= {"states": states, "att": att, "w": w, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["b"]

    def project(self, inputs: np.ndarray) -> dict:
        return {d: inputs @ self.p[f"x{d}"] + self.p[f"c{d}"] for d in "fb"}

    def logits(self, t: Tokens, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.empty(len(first), np.float32)
        if not len(t.word):
            x, index_of = {d: np.zeros((1, 3 * HIDDEN), np.float32) for d in "fb"}, np.zeros(1, np.int64)
        else:
            x, index_of = self.project(self.inputs(t)), t.index
        for lo in range(0, len(first), BLOCK):
            index, mask = gather(index_of, first[lo : lo + BLOCK], length[lo : lo + BLOCK])
            out[lo : lo + BLOCK] = self.forward(x, index, mask)
        return out

    def gradients(self, t: Tokens, inputs: np.ndarray, first: np.ndarray, length: np.ndarray, label: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
        """(gradients of the dense parameters, distinct words used, gradient of their inputs)."""
        index, mask = gather(t.index, first, length)
        used, index = np.unique(index, return_inverse=True)
        index = index.reshape(mask.shape)
        x, p = inputs[used], self.p
        keep: dict = {"f": [], "b": []}
        logit = self.forward(self.project(x), index, mask, keep)
        g = ((sigmoid(logit) - label) / len(label)).astype(np.float32)
        grads = {"out": keep["pooled"].T @ g, "b": g.sum(keepdims=True)}
        dpool = g[:, None] * p["out"]
        states, att, w = keep["states"], keep["att"], keep["w"]
        dw = (states * dpool[:, None]).sum(2)
        de = w * (dw - (w * dw).sum(1, keepdims=True))
        datt = de[:, :, None] * p["va"] * (1 - att * att)
        grads["va"] = np.tensordot(de, att, ([0, 1], [0, 1]))
        grads["wa"] = np.tensordot(states, datt, ([0, 1], [0, 1]))
        dstates = w[:, :, None] * dpool[:, None] + datt @ p["wa"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u = p[f"u{d}"]
            da_all = np.zeros((*mask.shape, 3 * HIDDEN), np.float32)
            du, dh = np.zeros_like(u), np.zeros((len(label), HIDDEN), np.float32)
            for t_, h, z, r, c, vn, m in reversed(keep[d]):
                dh = dh + dstates[:, t_, k * HIDDEN : (k + 1) * HIDDEN]
                s = dh * m
                dc = s * (1 - z) * (1 - c * c)
                dz = -s * (c - h) * z * (1 - z)
                dr = dc * vn * r * (1 - r)
                dv = np.concatenate([dz, dr, dc * r], axis=1)
                da_all[:, t_] = np.concatenate([dz, dr, dc], axis=1)
                du += h.T @ dv
                dh = dh - s * (1 - z) + dv @ u.T
            flat, where = da_all.reshape(-1, 3 * HIDDEN), index.ravel()
            o = np.argsort(where, kind="stable")
            per = np.add.reduceat(flat[o], np.searchsorted(where[o], np.arange(len(used))), axis=0)
            grads |= {f"u{d}": du, f"x{d}": x.T @ per, f"c{d}": per.sum(0)}
            dx += per @ p[f"x{d}"].T
        return grads, used, dx


def gather(index: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word of each place of each window, 1 where there is one)."""
    mask = np.arange(WINDOW) < length[:, None]
    at = np.where(mask, first[:, None] + np.arange(WINDOW), 0)
    return index[np.minimum(at, len(index) - 1)], mask.astype(np.float32)


def presence(features, n_texts: int, size: int, label: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Log odds of each feature's presence in toxic against clean texts, nearer 0 for features of few texts.

    features(lo, hi) gives (feature, text) of the texts lo to hi; a few texts are looked at together.
    """
    one, none = np.zeros(size), np.zeros(size)
    for lo in range(0, n_texts, 64):
        ids, text = features(lo, min(lo + 64, n_texts))
        seen = used[text]
        pair = np.unique(text[seen].astype(np.int64) * size + ids[seen])
        toxic = label[pair // size] > 0
        one += np.bincount(pair[toxic] % size, minlength=size)
        none += np.bincount(pair[~toxic] % size, minlength=size)
    n1, n0 = label[used].sum(), (1 - label[used]).sum()
    lo = np.log((one + 0.5) / (n1 + 1)) - np.log((none + 0.5) / (n0 + 1))
    return (lo * (one + none) / (one + none + 4)).astype(np.float32)


def train(texts: pa.Array, label: np.ndarray, rounds: int = 4, batch: int = 128, seed: int = 11) -> Net:
    """A network fitted to labelled texts, in the order given: the same rows give the same network."""
    rng = np.random.default_rng(seed)
    data, offsets = K.buffers(texts)
    t, net = Tokens(data, offsets), Net(seed)
    first, length, text = t.windows()
    fitted = np.arange(len(label)) % 5 != 4
    n = np.diff(t.cut)

    def words_of(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(t.text, [lo, hi])
        pair = np.unique(t.text[a:b] * len(t.word) + t.index[a:b])
        return pair % max(len(t.word), 1), pair // max(len(t.word), 1)

    def grams_of(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        word, text = words_of(lo, hi)
        each = n[word]
        at = np.repeat(t.cut[word] - np.cumsum(each) + each, each) + np.arange(each.sum())
        return t.gram[at], np.repeat(text, each)

    def buckets_of(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        word, text = words_of(lo, hi)
        return t.word[word], text

    net.p["words"][:, 0] += 0.4 * presence(buckets_of, t.n_texts, WORDS, label, fitted)
    net.p["grams"][:, 0] += 0.4 * presence(grams_of, t.n_texts, GRAMS, label, fitted)
    toxic = label[text] > 0
    # before the first fit, a window is as strong as its strongest word
    start, strength = net.inputs(t)[:, [0, DIM]].sum(1), np.empty(len(first), np.float32)
    for lo in range(0, len(first), BLOCK):
        index, mask = gather(t.index, first[lo : lo + BLOCK], length[lo : lo + BLOCK])
        strength[lo : lo + BLOCK] = np.where(mask > 0, start[index], -9).max(1)
    dense = [k for k in net.p if k not in ("words", "grams")]
    m1, m2 = ({k: np.zeros_like(net.p[k]) for k in dense} for _ in range(2))
    sq_w, sq_g = np.full(WORDS, 1e-8, np.float32), np.full(GRAMS, 1e-8, np.float32)
    step = 0
    for _ in range(rounds):
        order = np.lexsort((-strength, text))
        rank = np.arange(len(order)) - np.searchsorted(text[order], text[order])
        top = order[(rank < 2) & fitted[text[order]]]
        loose = np.flatnonzero(~toxic & fitted[text])
        loose = rng.choice(loose, min(len(loose), 3 * int(label.sum()) + 64), replace=False) if len(loose) else loose
        chosen = np.concatenate([top, loose])
        # of a toxic text's two strongest windows the second counts only if the model holds it for toxic too
        weak = np.zeros(len(text), bool)
        weak[order[(rank == 1)]] = True
        chosen = chosen[~(weak[chosen] & toxic[chosen] & (strength[chosen] < 0.5))]
        for _ in range(2):
            rng.shuffle(chosen)
            for lo in range(0, len(chosen), batch):
                part = chosen[lo : lo + batch]
                inputs = _Lazy(net, t)
                grads, used, dx = net.gradients(t, inputs, first[part], length[part], label[text[part]].astype(np.float32))
                step += 1
                for k in dense:
                    m1[k] = 0.9 * m1[k] + 0.1 * grads[k]
                    m2[k] = 0.999 * m2[k] + 0.001 * grads[k] ** 2
                    net.p[k] -= 0.01 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-7)
                _sparse(net.p["words"], sq_w, t.word[used], dx[:, :DIM])
                each = n[used]
                at = np.repeat(t.cut[used] - np.cumsum(each) + each, each) + np.arange(each.sum())
                _sparse(net.p["grams"], sq_g, t.gram[at], np.repeat(dx[:, DIM:] / np.maximum(each, 1)[:, None], each, axis=0))
        strength = net.logits(t, first, length)
    best = np.full(len(label), -np.inf)
    np.maximum.at(best, text, strength)
    net.calibration = calibrate(best[~fitted], label[~fitted])
    return net


class _Lazy:
    """Inputs of the words asked for, without computing all."""

    def __init__(self, net: Net, t: Tokens) -> None:
        self.net, self.t = net, t

    def __getitem__(self, used: np.ndarray) -> np.ndarray:
        t = self.t
        n = np.diff(t.cut)[used]
        at = np.repeat(t.cut[used] - np.cumsum(n) + n, n) + np.arange(n.sum())
        mean = np.add.reduceat(self.net.p["grams"][t.gram[at]], np.cumsum(n) - n, axis=0) / n[:, None]
        return np.concatenate([self.net.p["words"][t.word[used]], mean], axis=1)


def _sparse(table: np.ndarray, squares: np.ndarray, at: np.ndarray, grad: np.ndarray, rate: float = 0.05) -> None:
    """Adagrad on the rows `at`, which may repeat; a step size a row."""
    rows, where = np.unique(at, return_inverse=True)
    o = np.argsort(where, kind="stable")
    total = np.add.reduceat(grad[o], np.searchsorted(where[o], np.arange(len(rows))), axis=0)
    squares[rows] += (total**2).mean(1)
    table[rows] -= rate * total / np.sqrt(squares[rows])[:, None]


def calibrate(best: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(a, c) of p = sigmoid(a * logit + c), by ridged Newton steps that are halved until the cost falls."""
    if not len(label) or label.min() == label.max():
        return 1.0, 0.0
    x = np.stack([np.clip(best, -20, 20), np.ones(len(best))], axis=1).astype(np.float64)
    w, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    ridge = np.diag([1.0, 0.1])
    cost = lambda w: np.logaddexp(0, -(2 * label - 1) * (x @ w)).sum() + 0.5 * (w - prior) @ ridge @ (w - prior)
    for _ in range(30):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - label) + ridge @ (w - prior))
        while cost(w - step) > cost(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> Net | None:
    """A network from at most per_class labelled texts, of at most class_bytes together, of each kind among the rows that
    `learn` (of doc_id) admits."""
    # of conflicting labels of one document, the toxic one counts
    known = labels.filter(learn & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = F.xxhash64(F.lit("toxicity"), F.col("doc_id"))
    parts = [known.filter(F.col("toxic") == k).orderBy(draw, "doc_id").limit(per_class) for k in (0, 1)]
    sample = materialize(docs.sparkSession, parts[0].unionByName(parts[1]).select(F.col("doc_id").alias("_id"), "toxic"), "toxic-sample")
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    # the sample's ids are bounded by 2 * per_class, so they are broadcast; of rows repeated with one id the last text counts
    met = texts.join(F.broadcast(sample), "_id").groupBy("_id", "toxic")
    so_far = Window.partitionBy("toxic").orderBy(F.xxhash64(F.lit("toxicity"), F.col("_id")), "_id")
    short = met.agg(F.max(F.octet_length("text")).alias("size")).withColumn("so_far", F.sum("size").over(so_far)).filter(F.coalesce("so_far", F.lit(0)) <= class_bytes)
    short = materialize(docs.sparkSession, short.select("_id", "toxic"), "toxic-sample")
    table = texts.join(F.broadcast(short), "_id").groupBy("_id", "toxic").agg(F.max("text").alias("text")).toArrow()
    label = table.column("toxic").to_numpy() if table.num_rows else np.zeros(0)
    if not len(label) or label.min() == label.max():
        return None
    order = np.argsort(K.mix(table.column("_id").to_numpy().astype(np.int64).view(np.uint64)), kind="stable")
    return train(table.column("text").combine_chunks().take(pa.array(order)), label[order])


def score(docs: DataFrame, net: Net | None, text_col: str = "text") -> DataFrame:
    """docs without its text column, with score and windows (how many the text has)."""
    carried = [f for f in docs.schema.fields if f.name not in (text_col, "score", "windows")]
    schema = T.StructType([*carried, T.StructField("score", T.DoubleType()), T.StructField("windows", T.LongType())])
    source = docs.select(*[docs[f"`{f.name}`"] for f in carried], F.col(f"`{text_col}`").cast("string").alias("_text"))
    if net is None:
        return source.drop("_text").withColumns({"score": F.lit(0.0), "windows": F.lit(1).cast("long")})
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        a, c = net.calibration
        for batch in batches:
            data, offsets = K.buffers(batch.column(batch.num_columns - 1))
            for i, j in K.pieces(offsets, 2 * K.PIECE):
                t = Tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                first, length, text = t.windows()
                best, many = np.full(j - i, -np.inf), np.bincount(text, minlength=j - i)
                np.maximum.at(best, text, net.logits(t, first, length))
                best[t.count == 0] = -20.0  # nothing said
                p = sigmoid(a * np.clip(best, -20, 20) + c)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(i, j - i) for k in range(batch.num_columns - 1)), pa.array(p), pa.array(many.astype(np.int64))],
                    names=schema.fieldNames(),
                )

    return source.mapInArrow(run, schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = crc_mod(F.col("doc_id"), 4) != 2
    out = score(docs, fit(docs, labels, learn, "doc_id", "text"))
    return out.select(
        "doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
