"""The registered queries of the operators themselves: columns, types and what their contracts fix, over a whole test table."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from rowsmith.llm import mixing, sharding
from rowsmith.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_native import brute_targets
from tests.llm.test_text import tokenizer

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

COLUMNS = {
    "op1_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op2_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op3_ngram_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op4_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op5_quality": "doc_id bigint, lang string, n_tokens bigint, perplexity double, threshold double, keep boolean",
    "op6_mix_sources": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op7_shard": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op8_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op9_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op10_embedding_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
}


@pytest.fixture(scope="module")
def table(spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def results(spark):
    done = {}

    def of(name):
        if name not in done:
            df = QUERIES[name](spark, SF)
            done[name] = dict(df.dtypes), [r.asDict() for r in df.collect()]
        return done[name]

    return of


@pytest.fixture(scope="module")
def docs(table):
    return dict(table.sql("SELECT doc_id, text FROM documents").fetchall())


def held(i, n):
    return zlib.crc32(str(i).encode()) % n == 2


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_rows(results, table, name):
    kinds, rows = results(name)
    for column in COLUMNS[name].split(", "):
        c, kind = column.split(" ")
        assert kinds[c] == kind, column
    source, key = {"op9_warc": ("pages", "page_id"), "op10_embedding_dedup": ("embeddings", "vec_id")}.get(name, ("documents", "doc_id"))
    assert Counter(r[key] for r in rows) == Counter(x for (x,) in table.sql(f"SELECT {key} FROM {source}").fetchall())


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql(results, table, name):
    kinds, rows = results(name)
    want = table.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(kinds)
    assert Counter(tuple(r[c] for c in want.columns) for r in rows) == Counter(want.fetchall())


def test_toxicity_of_held_out_labels(results, table):
    rows = results("op1_toxicity")[1]
    assert all(r["held_out"] == held(r["doc_id"], 4) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_lm_counts(results, docs):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    tokens = {i: [*words(low(t)), None] for i, t in docs.items()}
    count = Counter(w for i, ws in tokens.items() if not held(i, 7) for w in ws)
    n, v = sum(count.values()), len(count)
    for r in results("op4_lm_scoring")[1]:
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"], 7), len(ws), sum(count[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r["score"] < 0


def test_quality_keeps_by_perplexity(results, docs, table):
    rows = {r["doc_id"]: r for r in results("op5_quality")[1]}
    assert all(r["keep"] == (r["perplexity"] <= r["threshold"]) and r["n_tokens"] == len(words(docs[i])) + 1 for i, r in rows.items())
    good = [i for (i,) in table.sql("SELECT doc_id FROM labels WHERE quality = 1").fetchall()]
    assert sum(rows[i]["keep"] for i in good) >= 0.9 * len(good)


def test_mix_comes_near_its_targets(results, table):
    rows = {r["doc_id"]: r for r in results("op6_mix_sources")[1]}
    source = table.sql("SELECT doc_id, text, source FROM documents").fetchall()
    size, target = brute_targets(source, mixing.WEIGHTS)
    taken, most = defaultdict(int), defaultdict(int)
    for i, text, s in source:
        r = rows[i]
        assert (r["size"], r["source_size"]) == (len(words(text)), size[s]) and r["target"] == pytest.approx(target[s]) and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        most[s] = max(most[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= most[s] + 1e-6 for s in size)


def test_mix_rates_are_those_of_the_dual(results, table):
    """Of each source, the rates min(2, exp(lam * size)) whose words are the target, by bisection."""
    rows = defaultdict(list)
    source = dict(table.sql("SELECT doc_id, source FROM documents").fetchall())
    for r in results("op6_mix_sources")[1]:
        rows[source[r["doc_id"]]].append(r)
    for found in rows.values():
        sizes, target = np.array([r["size"] for r in found], float), found[0]["target"]
        if not 0 < target < 2 * sizes.sum() * (1 - 1e-9):
            continue
        lo, hi = -1e4, 1e4
        rate = lambda lam: np.minimum(2.0, np.exp(np.minimum(lam * sizes / sizes.mean(), 50)))  # noqa: B023, E731
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (sizes * rate(mid)).sum() < target else (lo, mid)
        want = np.where(sizes > 0, rate(hi), 0.0)
        assert np.allclose([r["rate"] for r in found], want, rtol=1e-5)


def test_shards_by_a_walk_of_the_ring(results, docs):
    """The `rows` law, slots without gaps, and the same rows in each shard as a walk that takes rows one by one."""
    rows = results("op7_shard")[1]
    counts = Counter(r["shard"] for r in rows)
    assert {r["law"] for r in rows} == {"rows"} and set(counts) <= set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
    for r in rows:
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
    # row by row: hop 0 offers each arc's rows to its own shard, hop h to the owner of the h-th arc clockwise
    arcs = sharding.ring(sharding.SHARDS, sharding.VNODES, sharding.BITS)
    seed = xxhash.xxh64_intdigest(b"ring", seed=42)
    points = sorted((xxhash.xxh64_intdigest(str(i).encode(), seed=seed), i) for i in docs)
    queues = [[i for p, i in points if lo <= p >> (64 - sharding.BITS) <= hi] for _, lo, hi in arcs]
    room = sharding.bounds(len(docs), sharding.SHARDS, 0.0)
    used, want = [0] * sharding.SHARDS, {}
    for hop in range(len(arcs)):
        for a, queue in enumerate(queues):
            s = arcs[(a + hop) % len(arcs)][0]
            while queue and used[s] < room[s]:
                want[queue.pop(0)] = (s, used[s])
                used[s] += 1
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in rows} == want


def test_bpe_digests(results, docs):
    _, t = tokenizer()
    for r in results("op8_bpe")[1]:
        ids = t.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
