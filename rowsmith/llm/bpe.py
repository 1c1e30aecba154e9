"""Operator 8, BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks every adjacent pair up by binary search over the
sorted pair keys, takes each word's lowest rank, merges all its occurrences from left to right and closes the
gaps; words without a pair left leave the array. Words are encoded once per worker while the bounded cache
holds them, so a text costs one look-up per word.

The tokenizer file (path is a parameter; its format: NFC, white space and case folding, a letter / digit / other
split, byte-level symbols and a word-end suffix) is parsed by the driver and by each worker from a broadcast of
its JSON, whose size is the vocabulary's. Decoding gives what such a file without decoder defines: the tokens'
strings joined by one space.

Defined cases: a null or empty text has no tokens and decodes to the empty text; texts of any length are
encoded whole; special tokens' strings inside a text become their ids; repeated rows are rows of their own; other
columns are carried by `encode` unless they have the names of its outputs, which then replace them.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CACHE = 80_000
#: Texts are split and their new words encoded in groups of about so many characters; longer ones in parts of that size.
BATCH_CHARS = 400_000
#: Words that are merged at once.
MERGED = 10_000
#: The split of the files that this module reads, with `\\s` spelled out.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
_BLANK = re.compile(r"[ \t\n\r]")
NONE = np.iinfo(np.int64).max
SHIFT = np.int64(20)


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself where printable in Latin-1, else the next free one from U+0100."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [""] * 256, 256
    for b in range(256):
        if b in keep:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


class WordBpe:
    def __init__(self, spec: str | dict) -> None:
        spec = json.loads(spec) if isinstance(spec, str) else spec
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.special_re = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split = regex.compile(SPLIT)
        symbols = byte_symbols()
        none = -1
        self.inner = np.array([vocab.get(s, none) for s in symbols], dtype=np.int64)
        self.last = np.array([vocab.get(s + self.suffix, none) for s in symbols], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[a] << int(SHIFT)) | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.names = np.empty(max(self.token, default=-1) + 1, dtype=object)
        for i, t in self.token.items():
            self.names[i] = t
        self.ids_of: dict[str, bytes] = {}

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair among the sorted keys, or -1."""
        key = (left << SHIFT) | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words (their UTF-8 bytes, none empty) in a row, and where each word's end."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        sym = self.inner[raw]
        ends = np.cumsum(size) - 1
        sym[ends] = self.last[raw[ends]]
        word = np.repeat(np.arange(len(words)), size)
        known = sym >= 0
        sym, word = sym[known], word[known]
        done_sym, done_word = [], []
        while len(sym):
            same = np.zeros(len(sym), dtype=bool)  # symbol i and i + 1 are of one word
            same[:-1] = word[1:] == word[:-1]
            at = np.full(len(sym), -1)
            i = np.flatnonzero(same)
            at[i] = self._find(sym[i], sym[i + 1])
            rank = np.where(at >= 0, self.rank[at], NONE)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(sym)))
            live = np.repeat(low < NONE, length)
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
            take = (rank == np.repeat(low, length)) & live
            # Of overlapping occurrences (a a a), those at even places of their run merge.
            t = np.flatnonzero(take)
            if len(t):
                starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1] + 1]))
                place = np.arange(len(t)) - np.repeat(starts, np.diff(np.append(starts, len(t))))
                t = t[place % 2 == 0]
                sym[t] = self.made[at[t]]
                live[t + 1] = False
            sym, word = sym[live], word[live]
        if not done_sym:
            return np.zeros(0, "<u4"), np.zeros(len(words), np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order].astype("<u4"), np.searchsorted(word[order], np.arange(1, len(words) + 1))

    def fold(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        # case folding goes character by character, so a capital sigma never takes its final form
        return text.replace("Σ", "σ").lower()

    def pieces(self, text: str) -> list[str]:
        """The words of a text in order; special tokens stand as themselves, after a NUL that no word begins with."""
        if self.special_re is None or "<|" not in text and not self.special_re.search(text):
            return self.split.findall(self.fold(text))
        out: list[str] = []
        for i, part in enumerate(self.special_re.split(text)):
            if i % 2:
                out.append("\0special\0" + part)
            elif part:
                out += self.split.findall(self.fold(part))
        return out

    def learn(self, words: Iterable[str]) -> None:
        """Encodes words that the cache lacks, many at a time."""
        plain = []
        for w in words:
            if w.startswith("\0special\0"):
                self.ids_of[w] = np.uint32(self.special[w[9:]]).tobytes()
            else:
                plain.append(w)
        for lo in range(0, len(plain), MERGED):
            part = plain[lo : lo + MERGED]
            ids, ends = self.merge([w.encode("utf-8", "replace") for w in part])
            raw, a = ids.tobytes(), 0
            for w, b in zip(part, ends.tolist(), strict=True):
                self.ids_of[w] = raw[4 * a : 4 * b]
                a = b

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian uint32."""
        i = 0
        while i < len(texts):
            if len(texts[i]) > BATCH_CHARS:
                yield b"".join(x for part in self.parts(texts[i]) for x in self._group([part]))
                i += 1
                continue
            lo, size = i, 0
            while i < len(texts) and size + len(texts[i]) <= BATCH_CHARS:
                size += len(texts[i])
                i += 1
            yield from self._group(texts[lo:i])

    def parts(self, text: str) -> Iterator[str]:
        """A long text in parts of about BATCH_CHARS, cut after blanks, which no word and no composition crosses."""
        lo = 0
        while lo < len(text):
            cut = _BLANK.search(text, lo + BATCH_CHARS)
            hi = cut.end() if cut else len(text)
            yield text[lo:hi]
            lo = hi

    def _group(self, texts: list[str]) -> list[bytes]:
        split = [self.pieces(t) for t in texts]
        seen = set().union(*split)
        if missing := seen.difference(self.ids_of):
            if len(self.ids_of) + len(missing) > CACHE:
                self.ids_of.clear()
                missing = seen
            self.learn(missing)
        return [b"".join(map(self.ids_of.__getitem__, words)) for words in split]

    def decode(self, ids: np.ndarray | Iterable[int]) -> str:
        """Tokens joined by a space; ids that the vocabulary lacks are left out."""
        ids = np.asarray(ids if isinstance(ids, np.ndarray) else list(ids), dtype=np.int64)
        return " ".join(filter(None, self.names[ids[(ids >= 0) & (ids < len(self.names))]]))


_loaded: dict[int, WordBpe] = {}


def _worker(spec) -> WordBpe:
    """This worker's tokenizer; it and its cache outlive the task."""
    if spec.id not in _loaded:
        _loaded.clear()
        _loaded[spec.id] = WordBpe(spec.value)
    return _loaded[spec.id]


class _Spec:
    """A tokenizer file's text, broadcast, with its checksum as name."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        text = open(path, encoding="utf-8").read()
        self.id = hashlib.sha256(text.encode()).hexdigest()
        self.data = spark.sparkContext.broadcast(text)

    @property
    def value(self) -> str:
        return self.data.value


def encode(docs: DataFrame, path: str, text_col: str = "text", keep_ids: bool = True, keep_decoded: bool = True, keep_text: bool = True) -> DataFrame:
    """docs with n_tokens, ids_sha256, decoded_sha256 (of the decoded ids) and, if kept, ids (array<int>) and decoded."""
    spec = _Spec(docs.sparkSession, path)
    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    made += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids + [T.StructField("decoded", T.StringType())] * keep_decoded
    names = {f.name for f in made}
    carried = [f for f in docs.schema.fields if f.name not in names and (keep_text or f.name != text_col)]
    schema = T.StructType([*carried, *made])
    source = docs.select(*[docs[f"`{f.name}`"].alias(f"c{i}") for i, f in enumerate(carried)], docs[f"`{text_col}`"].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(spec)
        for batch in batches:
            for part in _slices(batch):
                n, ids_sha, text_sha, ids_out, decoded = [], [], [], [], []
                for raw in bpe.encode([x or "" for x in part.column(len(carried)).to_pylist()]):
                    ids = np.frombuffer(raw, dtype="<i4")
                    text = bpe.decode(ids)
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(raw).hexdigest())
                    text_sha.append(hashlib.sha256(text.encode()).hexdigest())
                    if keep_ids:
                        ids_out.append(ids)
                    if keep_decoded:
                        decoded.append(text)
                columns = [part.column(i) for i in range(len(carried))] + [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                columns += [pa.array(ids_out, pa.list_(pa.int32()))] * keep_ids + [pa.array(decoded, pa.string())] * keep_decoded
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return source.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, most: int = 4 * BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `most` bytes of text (its last column), or one longer text."""
    size = np.cumsum(pa.compute.binary_length(batch.column(batch.num_columns - 1)).fill_null(0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
