"""The pipeline's stages on a small corpus, each against brute force on its own input."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from rowsmith.llm import mixing
from tests.llm.test_native import brute_targets
from tests.llm.test_text import VOCAB, brute_join, prose, tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    rows = []
    for i in range(260):
        rows.append((i, prose(rng, rng.randint(20, 90), VOCAB), "en" if i % 2 else "de"))
    rows += [(300 + i, rows[i][1], rows[i][2]) for i in range(30)]  # exact copies
    for i in range(30):  # near copies
        w = rows[40 + i][1].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((400 + i, " ".join(w), rows[40 + i][2]))
    junk = [(500 + i, " ".join(x.upper() + "%%!" for x in prose(rng, 50, VOCAB).split()), "en") for i in range(25)]
    odd = [(600, None, None), (601, "", "en"), (602, prose(rng, 20_000, VOCAB), "de")]
    folder = tmp_path_factory.mktemp("corpus")
    docs = [(i, t, lang, None if i % 13 == 0 else f"src{i % 4}", len(t or "")) for i, t, lang in rows + junk + odd]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i, _, _ in rows if i % 3] + [(i, 0, 0) for i, _, _ in junk[:9]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), docs, {i for i, _, _ in junk}


def test_stages(spark, corpus):
    folder, rows, junk = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        path = f"{folder}/{name}"
        out.write.parquet(path)
        seen[name] = before, docs = docs, spark.read.parquet(path)
        if name != "token_ids":
            assert docs.columns == COLUMNS
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_duplicates", "mix", "token_ids"]

    before, after = ([tuple(r) for r in x.collect()] for x in seen["quality"])
    kept = {r[0] for r in after}
    assert not kept & junk
    assert len(kept) > 0.95 * (len(rows) - len(junk)) and set(after) <= set(before)

    before, after = ([tuple(r) for r in x.collect()] for x in seen["exact_dedup"])
    top = defaultdict(int)
    for r in before:
        top[r[1] or ""] = max(top[r[1] or ""], r[0])
    assert Counter(after) == Counter(r for r in before if r[0] == top[r[1] or ""])

    before, after = ([tuple(r) for r in x.collect()] for x in seen["near_duplicates"])
    stays = {i for i, _, c in brute_join([(r[0], r[1], r[2]) for r in before]) if i == c}
    assert Counter(after) == Counter(r for r in before if r[0] in stays)

    before, after = ([tuple(r) for r in x.collect()] for x in seen["mix"])
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size, target = brute_targets([(r[0], r[1], r[3]) for r in before], mixing.WEIGHTS)
    taken, most = defaultdict(int), defaultdict(int)
    for r in after:
        taken[r[3]] += words(r[1])
    for r in before:
        most[r[3]] = max(most[r[3]], words(r[1]))
    assert set(after) <= set(before) and max(Counter(after).values()) <= 2
    assert all(abs(taken[s] - target[s]) <= most[s] + 1e-6 for s in size)

    before, after = seen["token_ids"]
    _, t = tokenizer()
    want = Counter((r["doc_id"], tuple(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in before.collect())
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in after.collect()) == want


def test_run(spark, corpus):
    folder, rows, junk = corpus
    out = corpus_pipeline.run(spark, folder)
    ids = {r["doc_id"] for r in out.collect()}
    assert ids and not ids & junk and ids <= {r[0] for r in rows}


def test_stages_leave_clashing_columns_alone(spark, corpus, tmp_path):
    """Columns with the names that stages use inside, a map column, and rows that repeat."""
    from pyspark.sql import functions as F

    folder, rows, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = {
        "n_tokens": F.lit(5), "keep": F.lit("k"), "threshold": F.lit(0.5), "_lang": F.lit("x"), "_copy": F.lit(7), "copies": F.lit(3), "_id": F.col("doc_id") + 1,
        "component_id": F.lit(-1), "stays": F.lit("s"), "row": F.lit("r"), "place": F.lit(2), "size": F.lit(9), "m": F.create_map(F.lit("id"), F.col("doc_id")),
    }
    docs = docs.unionByName(docs.filter("doc_id < 20")).withColumns(extra)
    want = docs.schema.simpleString()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.schema.simpleString() == want, name
        assert docs.count() and not docs.filter(
            "n_tokens <> 5 or keep <> 'k' or threshold <> 0.5 or _lang <> 'x' or _copy <> 7 or copies <> 3 or component_id <> -1 or stays <> 's'"
            " or `row` <> 'r' or place <> 2 or size <> 9 or not _id <=> doc_id + 1 or not m['id'] <=> doc_id").count(), name
    out = corpus_pipeline.token_ids(spark, docs, folder)
    assert out.filter("n_tokens <> size(ids)").count() == 0


def test_stages_of_nothing(spark, corpus):
    folder, _, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name
