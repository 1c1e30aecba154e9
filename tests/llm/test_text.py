"""Toxicity, Jaccard join, LM scoring, quality and BPE: brute force, round trips and held-out accuracy on small inputs."""

import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowsmith.llm import bpe, common, lm_scoring, ngram_join, quality, toxicity
from rowsmith.llm import textkernel as K
from rowsmith.llm.common import crc_mod

SCHEMA = "doc_id long, text string, lang string, n long, score string, node string, n_tokens string, ids string, perplexity string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "s", "n", "t", "i", "p") for i, t, lang in rows], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def prose(rng, n, vocab):
    return " ".join(rng.choice(vocab) for _ in range(n))


VOCAB = [a + b for a in ("ba", "do", "ki", "lu", "mé") for b in ("na", "ro", "ti", "x", "")]


# --- the text kernel


def test_words_and_hashes():
    texts = ["A b\tC", "", "b", "  x  ", None, "é b\n" * 3, "z" * 3_000_000 + " b"]
    data, offsets = K.buffers(pa.array(texts))
    found, at = [], []
    for i, j in K.pieces(offsets):
        h, x = K.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        found += h.tolist()
        at += (x + i).tolist()
    want = [(i, w) for i, t in enumerate(texts) for w in words(t)]
    assert at == [i for i, _ in want]
    by_word = {}
    for h, (_, w) in zip(found, want, strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_long_words_hash_by_parts_within_bounds():
    long = "ab" * (K.PIECE // 2) + "c"
    data, offsets = K.buffers(pa.array([f"x {long} y", long, long[:-1] + "d", "w " * 5 + long]))
    h, at = K.words(data, offsets)
    assert at.tolist() == [0, 0, 0, 1, 2] + [3] * 6
    assert h[1] == h[3] == h[10] and h[4] != h[3] and len(set(h[5:10].tolist())) == 1
    assert len(K._powers.up) <= 2 * K.PIECE + 1


def test_slices_of_arrow_columns():
    a = pa.array(["xx", "a b", None, "c"])[1:]
    data, offsets = K.buffers(a)
    assert bytes(data) == b"a bc" and offsets.tolist() == [0, 3, 3, 4]


# --- operator 3


def brute_join(rows):
    sets = []
    for _, t, _ in rows:
        w = words(t)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = {}
    for x, (i, _, _) in enumerate(rows):
        if i is not None:
            low[find(x)] = min(low.get(find(x), i), i)
    return Counter((i, len(sets[x]), low.get(find(x)) if sets[x] else i) for x, (i, _, _) in enumerate(rows))


def near_copies(seed=1, groups=6, each=14):
    rng = random.Random(seed)
    rows, i = [], 100
    passage = prose(rng, 40, VOCAB)
    for _ in range(groups):
        base = prose(rng, rng.randint(8, 120), VOCAB).split()
        for k in range(each):
            w = list(base)
            for _ in range(k // 3):
                w[rng.randrange(len(w))] = rng.choice(VOCAB)
            rows.append((i, " ".join(w) + (" " + passage if k % 5 == 0 else ""), "en"))
            i += 1
    rng.shuffle(rows)
    return rows


EDGES = [(1, None, "en"), (2, "", "en"), (3, " \n", "en"), (4, "one two", "en"), (5, "ONE two", "en"), (6, "one", "en"), (7, "one two", "en"),
         (8, "a b c d e", "en"), (9, "a b c d e", None), (9, "a b c d e", None), (None, "a b c d e", "en"), (None, "nobody else", "en"),
         (11, "word " * 50_000, "en"), (12, "word " * 40_000, "en")]


@pytest.mark.parametrize("rows", [EDGES, near_copies(), near_copies(2, 2, 60)])
@pytest.mark.parametrize("draws", [(0, 1, 8, 64), (0, 1)])
def test_join_equals_brute_force(spark, rows, draws, monkeypatch):
    monkeypatch.setattr(ngram_join, "DRAWS", draws)
    got = Counter(tuple(r) for r in ngram_join.similar(docs(spark, rows).repartition(3), fragments=3).collect())
    assert got == brute_join(rows)


def test_join_without_star_rounds(spark):
    rows = near_copies(3, 3, 30)
    assert Counter(tuple(r) for r in ngram_join.similar(docs(spark, rows), star_rounds=0).collect()) == brute_join(rows)


def test_join_of_nothing(spark):
    assert ngram_join.similar(docs(spark, [])).count() == 0
    assert [tuple(r) for r in ngram_join.similar(docs(spark, [(1, "", "en")])).collect()] == [(1, 0, 1)]


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(50):
        x = np.unique(rng.integers(0, 1 << 62, rng.integers(1, 300)).astype(np.uint64))
        y = np.unique(np.concatenate([x[: rng.integers(0, len(x) + 1)], rng.integers(0, 1 << 62, rng.integers(0, 200)).astype(np.uint64)]))
        a, b = (ngram_join.sketches(v, np.array([0, len(v)]))[0] for v in (x, y))
        assert ngram_join.difference_bound(a, b) <= len(np.setxor1d(x, y))


# --- operator 4


def six_of_seven():
    return crc_mod(F.col("doc_id"), 7) != 2


def lm_scores(df, learn=None, **options):
    learn = six_of_seven() if learn is None else learn
    return lm_scoring.score(df, "doc_id", "text", learn, lm_scoring.fit(df.filter(learn).select("text"), **options))


@pytest.mark.parametrize("table", [1 << 18, 8, 0])
def test_lm_scores_by_brute_force(spark, table):
    """Counts, base score and score, token by token, whatever part of the tokens is broadcast."""
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(0, 60), VOCAB + [f"rare{i}"]), "en") for i in range(120)] + [(500, None, "en"), (None, "ba na", "en"), (501, "BA na " * 2_000, None), (501, "ba", None)]
    df = docs(spark, rows).repartition(3)
    fitted = lm_scoring.fit(df.filter(six_of_seven()).select("text"), table=table, words=7)
    got = lm_scoring.score(df, "doc_id", "text", six_of_seven(), fitted).collect()
    learn = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2 for i, _, _ in rows]
    count = Counter(w for (_, t, _), use in zip(rows, learn, strict=True) if use for w in [*words(t), None])
    n, v = sum(count.values()), len(count)

    # the model by its definition, in scalars
    seen = sorted({w for _, t, _ in rows for w in words(t)})
    hashes = dict(zip(seen, K.words(*K.buffers(pa.array(seen)))[0].tolist(), strict=True)) | {None: int(lm_scoring.END)}
    by_hash = {h: w for w, h in hashes.items()}
    own = {by_hash[h] for h in fitted.units.words.tolist()}
    bucket = lambda w: hashes[w] % lm_scoring.BUCKETS
    unit = dict(zip(map(by_hash.get, fitted.units.words.tolist()), fitted.units.own.tolist(), strict=True))
    unit |= {w: int(fitted.units.bucket[bucket(w)]) for w in hashes if w not in own}
    in_bucket, kinds = Counter(), Counter()
    for w, k in count.items():
        if w not in own:
            in_bucket[bucket(w)] += k
            kinds[bucket(w)] += 1
    once, twice = (sum(1 for k in count.values() if k == x) for x in (1, 2))
    cut = once / (once + 2 * twice) if once and twice else 0.5
    model, dim, slots = fitted.model, lm_scoring.DIM, lm_scoring.SLOTS

    left = cut * sum(kinds.values()) / sum(in_bucket.values())
    first_rare = lm_scoring.CLASSES - lm_scoring.BUCKETS // slots
    assert fitted.unknown == pytest.approx(left) and all((unit[w] // slots >= first_rare) == (w not in own) for w in hashes)

    def softmax(h, table):
        s = [float(x[:dim] @ h) + float(x[dim]) for x in table.astype(float)]
        e = [math.exp(x - max(s)) for x in s]
        return [x / sum(e) for x in e]

    known = {}

    def p(w, context):
        if context not in known:
            h = sum(model.r[u, :dim].astype(float) @ model.c[k * dim : (k + 1) * dim, :dim] for k, u in enumerate(context))
            known[context] = h, softmax(h, model.qc), {}
        h, classes, inside = known[context]
        if w not in own and not count[w]:  # the unknown token
            return sum(classes[first_rare:]) * left
        k, at = divmod(unit[w], slots)
        if k not in inside:
            inside[k] = softmax(h, model.q[k * slots : (k + 1) * slots])
        return classes[k] * inside[k][at] * (1.0 if w in own else (1 - left) * count[w] / in_bucket[bucket(w)])

    want = {}
    for (i, t, _), use in zip(rows, learn, strict=True):
        w = [*words(t), None]
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)
        units = [unit[None]] * lm_scoring.CONTEXT + [unit[x] for x in w]
        logp = sum(math.log10(p(x, tuple(units[k : k + 3][::-1]))) for k, x in enumerate(w))
        want.setdefault((i, use, len(w), sum(count[x] > 0 for x in w), n), []).append((base, logp))
    assert len(got) == len(rows)
    for r in got:
        found = want[r["doc_id"], r["learnt"], r["n_tokens"], r["n_known"], r["train_tokens"]]
        assert any(r["base_score"] == pytest.approx(x, rel=1e-6) and r["score"] == pytest.approx(y, rel=1e-4) for x, y in found)
    # probabilities sum to one over all units; buckets go to their known tokens and the unknown one
    h, classes, _ = next(iter(known.values()))
    assert sum(c * x for k, c in enumerate(classes) for x in softmax(h, model.q[k * slots : (k + 1) * slots])) == pytest.approx(1)
    for b in list(in_bucket)[:5]:
        assert sum((1 - left) * count[w] / in_bucket[b] for w in count if w not in own and bucket(w) == b) + left == pytest.approx(1)


def test_lm_gradient_is_right():
    rng = np.random.default_rng(1)
    scores, target, noise = rng.normal(size=(4, 6)), np.array([0, 5, 2, 2]), rng.uniform(0.1, 3, 6)
    sig = lambda x: -np.logaddexp(0, -x)

    def gain(s):
        d = s - np.log(noise)
        return sig(d)[np.arange(4), target].sum() + (noise * sig(-d)).sum()

    g = lm_scoring.nce_gradient(scores, target, noise)
    for at in np.ndindex(4, 6):
        e = np.zeros((4, 6))
        e[at] = 1e-5
        assert (gain(scores + e) - gain(scores - e)) / 2e-5 == pytest.approx(g[at], abs=1e-6)


def test_lm_learns_contexts(spark):
    """On held-out text a token that follows from the one before, or the one before that, costs less than by counts."""
    rng = random.Random(6)
    rows = [(i, " ".join(f"{x} {y} {x}then {y}then" for x, y in ((rng.choice(VOCAB), rng.choice(VOCAB)) for _ in range(60))), "en") for i in range(600)]
    got = lm_scores(docs(spark, rows).repartition(2)).filter("not learnt").collect()
    assert sum(r["score"] for r in got) > 0.9 * sum(r["base_score"] for r in got) > sum(r["base_score"] for r in got)


def test_lm_learns_from_every_position(spark):
    """Each pair stands in texts of its own, always at one place: none of them is passed over."""
    pairs = [(f"x{i}", f"y{i}") for i in range(40)]
    df = docs(spark, [(k, " ".join(pairs[k % 40]) + f" z{k}", "en") for k in range(6_000)] + [(None, None, "en")] * 2).repartition(2)
    units, model = (f := lm_scoring.fit(df.select("text"))).units, f.model
    unit = lambda words: units.of(K.words(*K.buffers(pa.array(words)))[0])
    x, y = (unit([p[k] for p in pairs]) for k in range(2))
    end, projected = np.full(len(x), units.end), model.projected()
    logp = lambda first, second: model.log_probability(projected, np.stack([first, end, end]), second)[0]
    others = np.mean([logp(np.roll(x, k), y) for k in range(1, len(x))], axis=0)
    assert (logp(x, y) > others + 1).all()  # y follows its own x more often than any other
    # and once: the rounds share all rows out
    rows = [[r["doc_id"] for r in lm_scoring.of_round(df.select("text", "doc_id"), turn).collect()] for turn in range(lm_scoring.ROUNDS)]
    assert Counter(sum(rows, [])) == Counter([*range(6_000), None, None]) and min(map(len, rows)) > 2_000


def test_lm_of_nothing(spark):
    assert lm_scores(docs(spark, []), F.lit(True)).count() == 0
    (r,) = lm_scores(docs(spark, [(1, "a b", "en")]), F.lit(False)).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (3, 0, 0, 0.0)


def test_lm_clashing_columns_and_repeats(spark):
    df = spark.createDataFrame([(1, "ba na ro", "x", 1.0, 5)] * 3 + [(2, None, "y", 2.0, 6)], "doc_id long, text string, score string, `row` double, token int")
    got = lm_scores(df, F.lit(True)).collect()
    assert len(got) == 4 and len({(r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got if r["doc_id"] == 1}) == 1


# --- operator 5


def brute_kn(texts):
    """(probability of a token after two others, spread) by the textbook's formulas."""
    split = lambda t: ["<s>", "<s>", *re.findall(r"[^\x20\x09-\x0D]+", t or ""), "</s>"]
    tri = Counter()
    for t in texts:
        s = split(t)
        tri.update(zip(s, s[1:], s[2:], strict=False))
    bi, uni = Counter(), Counter()
    for _, v, w in tri:
        bi[v, w] += 1
    for _, w in bi:
        uni[w] += 1

    def cuts(table):
        k = [max(sum(1 for n in table.values() if n == i), 1) for i in range(1, 5)]
        y = k[0] / (k[0] + 2 * k[1])
        d = [min(max(i - (i + 1) * y * k[i] / k[i - 1], 0.1), i - 0.1) for i in (1, 2, 3)]
        return lambda n: d[min(n, 3) - 1]

    d1, d2, d3 = cuts(uni), cuts(bi), cuts(tri)
    total = sum(uni.values())
    floor = sum(map(d1, uni.values())) / total / (len(uni) + 1)

    def p1(w):
        return floor + ((uni[w] - d1(uni[w])) / total if w in uni else 0)

    def interpolate(table, d, key, context, below):
        found = {k: n for k, n in table.items() if k[:-1] == context}
        if not found:
            return below
        n = sum(found.values())
        own = (found[key] - d(found[key])) / n if key in found else 0
        return own + sum(map(d, found.values())) / n * below

    def p(u, v, w):
        return interpolate(tri, d3, (u, v, w), (u, v), interpolate(bi, d2, (v, w), (v,), p1(w)))

    s = [math.log(p(*k)) for k, n in tri.items() for _ in range(n)]
    return p, split, float(np.std(s))


@pytest.mark.parametrize("table", [0, 12, 1 << 18])
def test_perplexity_is_kneser_ney(spark, table):
    """Against brute force, through the join, through the broadcast table, and through both."""
    rng = random.Random(2)
    vocab = VOCAB[:7]
    texts = [prose(rng, rng.randint(1, 30), vocab) for _ in range(14)]
    p, split, spread = brute_kn(texts)
    for u, v in (("<s>", "<s>"), ("<s>", vocab[0]), (vocab[1], vocab[2]), ("unseen", "unseen")):
        assert sum(p(u, v, w) for w in [*vocab, "neverseen", "</s>"]) == pytest.approx(1, abs=1e-9)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [*enumerate(texts), (20, ""), (21, None), (22, "never seen " + texts[0]), (22, texts[1]), (None, prose(rng, 200, [*vocab, "X%"]))]
    model = quality.estimate(quality.trigram_counts(spark.createDataFrame([(t,) for t in texts], "text string")))
    assert model.spread == pytest.approx(spread)
    df = spark.createDataFrame([(i, t, "t" if t is None else t) for i, t in rows], "doc_id long, text string, copy string")
    out_rows, means = quality.score(df, model, ["doc_id", "copy"], table=table)
    out = out_rows.join(means, "place").collect()
    assert len(out) == len(rows) and labels.count() == 0
    for r in out:
        s = split("" if r["row"]["copy"] == "t" else r["row"]["copy"])
        want = -sum(math.log(p(*k)) for k in zip(s, s[1:], s[2:], strict=False)) / (len(s) - 2)
        assert (r["n_tokens"], r["mean"]) == (len(s) - 2, pytest.approx(want, rel=1e-9))


def test_quality_leaves_clashing_columns_alone(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 40, VOCAB), "en", 7, {"a": i}, 1.5, "_") for i in range(60)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int, keep map<string,int>, threshold double, `_lang` string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)] * 2 + [(0, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.keep(df, labels)
    assert out.schema.simpleString() == df.schema.simpleString()
    assert {(r["n_tokens"], r["threshold"], r["_lang"], r["keep"]["a"] == r["doc_id"]) for r in out.collect()} == {(7, 1.5, "_", True)}
    made = quality.classify(df, labels).collect()
    assert len(made) == 120 and {type(r["keep"]) for r in made} == {bool}


def test_quality_rejects_junk_and_keeps_prose(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(20, 120), VOCAB), "en" if i % 2 else "de") for i in range(400)]
    junk = [(1000 + i, " ".join(w.upper() + "##!" for w in prose(rng, 60, VOCAB).split()), "en") for i in range(30)]
    odd = [(2000, None, "en"), (2001, "", None), (None, "ba na", "xx"), (2002, prose(rng, 60_000, VOCAB), "en")]
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in rows if i % 4] + [(i, 0, 0) for i, _, _ in junk[:5]] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    df = docs(spark, rows + junk + odd)
    out = quality.classify(df, labels)
    assert set(df.columns) - set(quality.OUTPUTS) <= set(out.columns)
    assert all(r["keep"] == (r["perplexity"] <= r["threshold"]) for r in out.collect())
    keep = {r["doc_id"]: r["keep"] for r in out.collect()}
    assert out.count() == df.count()
    assert sum(keep[i] for i, _, _ in rows) > 0.97 * len(rows)
    assert not any(keep[i] for i, _, _ in junk)
    assert keep[2000] and keep[2002]


def test_quality_without_trust(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["keep"] for r in quality.classify(docs(spark, [(1, "x", "en"), (2, None, None)]), labels).collect()] == [True, True]
    assert quality.classify(docs(spark, []), labels).count() == 0


def test_quality_of_thinly_labelled_languages(spark):
    """A language with few or no trusted texts isn't judged by the large ones' threshold; its junk goes where it can tell."""
    rng = random.Random(9)
    other = [a + b for a in ("zu", "qe", "vy", "wø", "jh") for b in ("p", "gg", "sk", "fa", "th", "o")]
    rows = [(i, prose(rng, rng.randint(20, 120), VOCAB), "en") for i in range(600)]
    thin = [(5000 + i, prose(rng, rng.randint(20, 120), other), "thin") for i in range(300)]
    none = [(6000 + i, prose(rng, rng.randint(20, 120), [w[::-1] + "r" for w in other]), "none") for i in range(100)]
    junk = [(7000 + i, " ".join(w.upper() + f"#{rng.randint(0, 10**6)}!" for w in prose(rng, 60, other).split()), "thin") for i in range(30)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in rows] + [(i, 1, 0) for i, _, _ in thin[:50]], "doc_id long, quality int, toxic int")
    keep = {r["doc_id"]: r["keep"] for r in quality.classify(docs(spark, rows + thin + none + junk), labels).collect()}
    assert sum(keep[i] for i, _, _ in thin) > 0.97 * len(thin)
    assert all(keep[i] for i, _, _ in none)
    assert not any(keep[i] for i, _, _ in junk)
    assert sum(keep[i] for i, _, _ in rows) > 0.97 * len(rows)


def test_quality_sample_has_every_language(spark):
    rows = [(100 * k + i, f"w{k} x{i}", f"l{k}") for k in range(20) for i in range(12)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    _, sample = quality.fit(docs(spark, rows), labels, "doc_id", "text", "lang")
    assert {r["_id"] // 100 for r in sample.collect()} == set(range(20))


def test_quality_counts_every_trusted_text(spark):
    """Trusted documents are counted by the model or set the limits, however many a language has."""
    rows = [(i, f"w{i % 7} x{i}", "en" if i % 10 else "de") for i in range(2_400)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in rows] * 2, "doc_id long, quality int, toxic int")
    model, counted = quality.fit(docs(spark, rows), labels, "doc_id", "text", "lang")
    ids = [r["_id"] for r in counted.collect()]
    assert len(ids) == len(set(ids)) and 0.7 * len(rows) < len(ids) < 0.8 * len(rows)
    # every one of their words, which occur once each, is in the model
    assert model.values.filter("times = 1").count() >= 3 * len(ids)


def test_quality_model_is_small(spark):
    """A trigram with all that is below it takes few bytes, in the tables that are left and in those on the way."""
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, 400) % 5_000), "en") for i in range(400)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    made = []
    with common.noting(made):
        model, _ = quality.fit(docs(spark, rows), labels, "doc_id", "text", "lang")
    left = [p for t in made for p in Path(t._rowsmith_path.removeprefix("file:")).rglob("*.parquet")]
    trigrams = model.values.count()
    assert trigrams > 50_000 and sum(p.stat().st_size for p in left) < 12 * trigrams


def test_words_and_shards_round_trip():
    """Blocks of words come back as they went, with and without a table of frequent words."""
    rng = np.random.default_rng(5)
    u, v, w = rng.integers(0, 1 << 64, (3, 500), np.uint64)
    v[:250] = v[0]
    words, places = quality.numbered(u, v, w)
    assert all((words[x] == y).all() for x, y in zip(places, (u, v, w), strict=True))
    for hot in (quality.NONE, words[::3], words):
        found = [quality.opened(data, hot) for _, data in quality.spread_out(words, *places, [np.arange(500)], 7, hot)]
        back = {int(n): (a[0][x], a[0][y], a[0][z]) for a in found for x, y, z, n in zip(*a[1:], strict=True)}
        assert back == {i: (u[i], v[i], w[i]) for i in range(500)}


def test_equal_texts_share_a_score(spark):
    rows = [(i, "ba na ba ti", "en") for i in range(5)] + [(9, "ba na", "en"), (10, None, "en"), (11, "", "en")]
    model = quality.estimate(quality.trigram_counts(spark.createDataFrame([("ba na ba ti",), ("ba ti na",)], "text string")))
    out, means = quality.score(docs(spark, rows), model, ["doc_id"])
    assert out.count() == len(rows) and means.count() == 3
    alone = quality.score(docs(spark, rows[:1]), model, ["doc_id"])[1].first()["mean"]
    assert [r["mean"] for r in means.collect() if r["n_tokens"] == 5] == [pytest.approx(alone, rel=1e-12)]


def answers(df):
    """The rows that the last mapInArrow of a plan makes."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() != "MapInArrow":
        plan = plan.children().head()
    return DataFrame(df.sparkSession._jvm.org.apache.spark.sql.classic.Dataset.ofRows(df.sparkSession._jsparkSession, plan), df.sparkSession)


def test_sums_do_not_grow_with_the_shards(spark, monkeypatch):
    """A document gets as many sums from a model of many shards, and the same ones, in one block or in several."""
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    texts = [(i, prose(rng, 300, vocab)) for i in range(24)] + [(99, "zz yy")]
    df = spark.createDataFrame(texts, "place long, text string").repartition(4)
    monkeypatch.setattr(quality, "GROUP", 600)
    found = []
    for shard, blocks in ((1 << 30, 1), (40, 1), (40, 3)):
        monkeypatch.setattr(quality, "SHARD", shard)
        if shard != 40 or blocks == 1:
            model = quality.estimate(quality.trigram_counts(spark.createDataFrame(texts[:12], "place long, text string").select("text")))
            keys = common.bloom(model.gains().select(*common.hashed_keys(F.col("key"))))
            sent = spark.sparkContext.broadcast((quality.NONE, np.zeros(0), keys))
        # the same middle words are in part 0 of either model
        got = quality.gathered(df, model, 0, sent, *([blocks] if blocks > 1 else []))
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            made, sums = answers(got).count(), {r["place"]: r["more"] for r in got.collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        found.append((model.shards.first()["of"], made, sums))
        assert found[-1][1] <= 6 * len(texts)
        assert set(sums) == set(range(24)) and sums == pytest.approx(found[0][2], rel=1e-9)
    assert found[1][0] >= 8 * found[0][0]


def test_limits_from_few_values():
    assert quality.student(0.995, 1) == pytest.approx(63.657, rel=2e-3)
    assert quality.student(0.995, 29) == pytest.approx(2.7564, rel=1e-3)
    assert quality.upper_limit([9.7], 0.995) == quality.upper_limit([9.7] * 9, 0.995) == math.inf
    x = np.random.default_rng(0).normal(9, 0.3, 30)
    assert x.max() < quality.upper_limit([*x, 2.0, 3.0], 0.995) < 10.5


# --- operator 1


def test_gradients_are_right():
    """Back-propagation against finite differences."""
    rng = np.random.default_rng(0)
    texts = pa.array(["ba na ro ti", "lu ki", "", "x y z ba lu"])
    t = toxicity.Tokens(*K.buffers(texts))
    net = toxicity.Net(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    first, length, text = t.windows()
    label = np.array([1.0, 0.0, 0.0, 1.0])
    index, mask = toxicity.gather(t.index, first, length)

    def loss():
        z = net.forward(net.project(net.inputs(t).astype(np.float64)), index, mask).astype(np.float64)
        return np.mean(np.logaddexp(0, z) - label * z)

    grads, _, _ = net.gradients(t, net.inputs(t).astype(np.float64), first, length, label)
    for name, g in grads.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in net.p[name].shape)
            old = net.p[name][at]
            net.p[name][at] = old + 1e-3
            up = loss()
            net.p[name][at] = old - 1e-3
            down = loss()
            net.p[name][at] = old
            assert (up - down) / 2e-3 == pytest.approx(g[at], abs=2e-4), name


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(4)
    bad = ["grumble", "snarlix", "vexa"]
    rows, labels = [], []
    for i in range(500):
        w = prose(rng, rng.randint(5, 150), VOCAB).split()
        toxic = i % 3 == 0
        if toxic:
            for _ in range(max(1, len(w) // 25)):
                w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", "s", "ed", ","]))
        rows.append((i, " ".join(w), "en"))
        labels.append((i, 1, int(toxic)))
    odd = [(900, None, "en"), (901, "", "en"), (None, "ba", None), (902, prose(rng, 40_000, VOCAB), "en"), (903, prose(rng, 3000, VOCAB) + " snarlixes! ", "en")]
    lab = spark.createDataFrame(labels + [(None, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    df = docs(spark, rows + odd)
    net = toxicity.fit(df, lab, crc_mod(F.col("doc_id"), 4) != 2, "doc_id", "text")
    out = {r["doc_id"]: r["score"] for r in toxicity.score(df, net).collect()}
    assert len(out) == len(rows) + len(odd) and all(0 <= s <= 1 for s in out.values())
    held = [(i, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((out[i] >= toxicity.THRESHOLD) == bool(t) for i, t in held)
    assert right > 0.95 * len(held)
    assert out[903] > out[900]


def test_toxicity_of_conflicting_labels_and_repeated_rows(spark):
    """Reruns agree, whatever the order of rows; a document labelled both ways is toxic; nothing fails on an empty table."""
    rng = random.Random(7)
    rows = [(i, prose(rng, 20, VOCAB) + (" snarlix grumble" if i % 2 else ""), "en") for i in range(80)]
    labels = [(i, 1, i % 2) for i in range(80)] + [(i, 1, 0) for i in range(80)]
    schema = "doc_id long, quality int, toxic int"

    def scores(rows, labels):
        net = toxicity.fit(docs(spark, rows).repartition(3), spark.createDataFrame(labels, schema), F.lit(True), "doc_id", "text")
        return sorted((r["doc_id"], r["score"]) for r in toxicity.score(docs(spark, rows[:80]), net).collect())

    first = scores(rows + rows, labels)
    assert first == scores((rows + rows)[::-1][:80] + rows, labels[::-1])
    assert np.mean([s for i, s in first if i % 2]) > 2 * np.mean([s for i, s in first if not i % 2])
    assert toxicity.fit(docs(spark, []), spark.createDataFrame(labels, schema), F.lit(True), "doc_id", "text") is None


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = docs(spark, [(1, "x", "en"), (2, None, "en")])
    assert [r["score"] for r in toxicity.score(df, toxicity.fit(df, labels, F.lit(True), "doc_id", "text")).collect()] == [0.0, 0.0]


def test_windows_cover_every_token():
    t = toxicity.Tokens(*K.buffers(pa.array([" ".join(["w"] * n) for n in (0, 1, 31, 32, 33, 47, 48, 49, 200)])))
    first, length, text = t.windows()
    begin = np.cumsum(t.count) - t.count
    for k, n in enumerate(t.count):
        covered = {x for f, size, x_ in zip(first, length, text, strict=True) if x_ == k for x in range(f - begin[k], f - begin[k] + size)}
        assert covered == set(range(n))


# --- operator 8


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return path, t


def test_bpe_equals_the_library(spark):
    import hashlib

    path, t = tokenizer()
    rng = random.Random(0)
    bits = ["a", "aaa", "the", "Straße", "İ", "Σ", "ς", "é", "é", "'s", "1½", "Ⅷ", " ", "\x85", "\0", "\0special\0", "日本", "😀", "<|startoftext|>", "<|endoftext|>", "<|", "\n", "!!!", "ﬁ", "한글", "​"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25))), "en") for i in range(400)]
    rows += [(900, None, "en"), (901, "", "en"), (902, "word" * 20_000, "en"), (None, "the end", "en"), (1, "twice", "en"), (1, "twice", "en")]
    out = bpe.encode(docs(spark, rows), path)
    assert "text" in out.columns and out.filter("doc_id is null").count() == 1
    want = Counter()
    for i, x, _ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        raw = np.array(ids, dtype="<u4").tobytes()
        want[(i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), tuple(ids), text)] += 1
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"]), r["decoded"]) for r in out.collect())
    assert got == want
    assert bpe.encode(docs(spark, []), path).count() == 0


def test_bpe_cache_is_bounded(monkeypatch):
    path, t = tokenizer()
    monkeypatch.setattr(bpe, "CACHE", 50)
    w = bpe.WordBpe(open(path, encoding="utf-8").read())
    texts = [f"word{i} number{i} again" for i in range(200)]
    monkeypatch.setattr(bpe, "BATCH_CHARS", 100)
    for x, ids in zip(texts, w.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    assert len(w.ids_of) <= 60


def test_bpe_of_long_texts_in_parts(monkeypatch):
    """Cut after blanks, before combining marks, special tokens and words longer than a part too."""
    path, t = tokenizer()
    w = bpe.WordBpe(open(path, encoding="utf-8").read())
    monkeypatch.setattr(bpe, "BATCH_CHARS", 40)
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice(["Word", "é", " ", "\n", "\u0301", "<|endoftext|>", "ΑΣ ", "12'll", "x" * 90, "%", "\u00a0", " \u0301a"]) for _ in range(60))
        (ids,) = w.encode([text])
        ids = np.frombuffer(ids, "<u4").tolist()
        assert ids == t.encode(text, add_special_tokens=False).ids
        assert w.decode(ids) == t.decode(ids, skip_special_tokens=False)
