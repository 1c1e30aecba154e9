"""Operator 9, WARC: writing and reading archives, with an external merge of their capture index.

`write` puts a record per page into .warc.gz files (one gzip member a record) under a shared URI. Of pages with
equal payloads (by SHA-256) the one with the largest id is a response; the others are revisits of it, which keep the
HTTP header and no payload, and name its record. Payloads are digested inside Spark, and only digests and ids are
shuffled: a page learns of its equals by a join with the table of payloads that occur more than once, which Spark
broadcasts where it is small and sorts where it isn't.

A write task leaves sorted runs: its captures by URL key, timestamp and id, RUN_LINES at a time. `merge_index` joins
all runs into one globally ordered history: captures are range-partitioned by that key (a URL that holds a third of all
captures is cut by timestamp and id) into ranges of about RANGE_LINES, and each range merges its slices of the sorted
runs with a loser tree over packed columns, which decodes the heads of a run a few at a time. `read` fetches the records
that an index lists, checks them against it, and returns them with their place in that history.

File names are unique to a task attempt and only the rows of committed tasks name files, so a lost executor
leaves at most files that nobody reads. A write task holds one record and one run's lines; a merge task holds its
range of the index, packed.

Defined cases: null html counts as empty, a null url has the empty key; null ids are written as such, are never
chosen before a number, and are revisits of the largest number; repeated rows are records of their own, of which
those with the chosen id are all responses (the same capture again, under the same record id); an empty table gives no
files and an empty index; other columns are not read. Payloads of fewer than `min_bytes` bytes are always responses.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from array import array
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.llm.common import materialize, release, scratch, shuffle_partitions

#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FILE_BYTES = 64 << 20
#: Captures of a sorted run, and about how many a merge task joins.
RUN_LINES, RANGE_LINES = 50_000, 500_000
EPOCH = 1_700_000_000

RUN = "url_key string, ts string, page_id long, run string, pos long, file string, offset long, length long"
INDEX = RUN + ", part int, seq long"
RECORD = "page_id long, url string, ts string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string, position long"


def url_key(url: str | None) -> str:
    """Sortable form of a URL: host labels from the top level down, then path and query, in lower case."""
    try:
        u = urlsplit((url or "").strip())
        host, port = u.hostname or "", u.port
    except ValueError:
        return (url or "").lower()
    labels = host.removeprefix("www.").split(".")
    at = f":{port}" if port not in (None, 80, 443) else ""
    return f"{','.join(reversed(labels))}{at}){u.path or '/'}{'?' + u.query if u.query else ''}".lower() if host else (url or "").lower()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def timestamp(page_id: int | None) -> str:
    """Capture time of a page of a table that has none: a second an id."""
    return datetime.fromtimestamp(EPOCH + (page_id or 0) % 10**9, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(page_id: int | None, sha1: str, url: str | None) -> str:
    """A record's name, which those who refer to it can tell without having seen it."""
    return f"<urn:page:{page_id}:{sha1}:{zlib.crc32((url or '').encode('utf-8', 'replace')):08x}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple[int, str | None] | None) -> bytes:
    """One record: WARC header, HTTP header and, for a response, the payload; refers_to: id and url of a revisit's response."""
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    )
    block, sha1 = http if refers_to else http + payload, digest(payload)
    fields = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", record_id(page_id, sha1, url)),
        ("WARC-Date", timestamp(page_id)),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{sha1}"),
    ]
    if refers_to:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to[0], sha1, refers_to[1])), ("WARC-Refers-To-Date", timestamp(refers_to[0]))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC fields, HTTP fields, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) < int(fields["Content-Length"]):
        raise ValueError("truncated WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode("utf-8").split("\r\n")[1:]), payload


def _page(uri: str) -> int | None:
    n = uri.strip("<>").split(":")[2]
    return None if n == "None" else int(n)


#: Names that Hadoop has for stores which Arrow knows by others.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs", "wasb": "abfs"}


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The store of a URI, and the path in it; raises what Arrow says of schemes that it lacks."""
    scheme, colon, rest = uri.partition(":")
    return pa.fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + colon + rest)


class Writer:
    """Appends gzip members to numbered files of about FILE_BYTES under a shared URI."""

    def __init__(self, uri: str, level: int = 3) -> None:
        self.fs, self.dir = filesystem(uri)
        self.fs.create_dir(self.dir, recursive=True)
        self.name, self.n, self.level, self.out = uuid.uuid4().hex, 0, level, None

    def add(self, raw: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at > FILE_BYTES:
            self.close()
            self.file, self.at = f"{self.name}-{self.n:05d}.warc.gz", 0
            self.out, self.n = self.fs.open_output_stream(f"{self.dir}/{self.file}", compression=None), self.n + 1
        z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        member = z.compress(raw) + z.flush()
        self.out.write(member)
        self.at += len(member)
        return self.file, self.at - len(member), len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def write(pages: DataFrame, uri: str, min_bytes: int = 0, salts: int | None = None) -> DataFrame:
    """Writes pages (page_id, url, html) under `uri`; returns the runs, materialised (see RUN)."""
    spark = pages.sparkSession
    salts = salts or max(32, shuffle_partitions(spark))
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", body.alias("body")).withColumn("same", F.unhex(F.sha2("body", 256)))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    # Largest id of payloads that occur again: by salt first, then over the salts, then back to each salt that has some.
    top = F.struct("page_id", "url")
    winners = keyed.groupBy("salt", "same").agg(F.max(top).alias("top"), F.count("*").alias("n"))
    again = (
        winners.groupBy("same").agg(F.max("top").alias("top"), F.sum("n").alias("n"), F.collect_list("salt").alias("at"))
        .filter("n > 1").select("same", "top", F.explode("at").alias("salt"))
    )
    again = materialize(spark, again, "warc-again")
    joined = keyed.join(again, ["salt", "same"], "left").select(
        "page_id", "url", "body", F.col("top.page_id").alias("top"), F.col("top.url").alias("top_url"),
        (F.col("top").isNotNull() & (F.octet_length("body") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("top.page_id"))).alias("revisit"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, out, chunk = [], None, 0

        def flush() -> pa.RecordBatch:
            lines.sort(key=lambda x: (x[0], x[1], -1 if x[2] is None else x[2]))
            key, ts, page, file, offset, length = zip(*lines, strict=True)
            n = len(key)
            lines.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(key, pa.string()), pa.array(ts, pa.string()), pa.array(page, pa.int64()), pa.array([f"{out.name}-{chunk}"] * n, pa.string()),
                 pa.array(range(n), pa.int64()), pa.array(file, pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())],
                names=["url_key", "ts", "page_id", "run", "pos", "file", "offset", "length"],
            )

        for batch in batches:
            columns = [batch.column(i) for i in range(6)]
            for i in range(batch.num_rows):
                page, url, payload, top, top_url, revisit = (c[i].as_py() for c in columns)
                out = out or Writer(uri)
                lines.append((url_key(url), timestamp(page), page, *out.add(record(page, url, payload, (top, top_url) if revisit else None))))
                if len(lines) >= RUN_LINES:
                    yield flush()
                    chunk += 1
        if out is not None:
            out.close()
        if lines:
            yield flush()

    runs = materialize(spark, joined.mapInArrow(run, RUN), "warc-runs")
    release(again)
    return runs


class LoserTree:
    """Merges sorted runs. Inner nodes hold the run that lost there, the root the run whose head is smallest;
    taking a head replays one path, with one comparison a level."""

    def __init__(self, runs: list[Iterator]) -> None:
        self.runs = runs
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None if x is None or y is None else (x, a) < (y, b)

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            if self.tree[node] == -1:  # still building: the other side isn't there yet
                self.tree[node] = i
                return
            if self._beats(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator:
        while (head := self.heads[i := self.tree[0]]) is not None:
            yield i, head
            self.heads[i] = next(self.runs[i], None)
            self._replay(i)


class _Run:
    """The heads of a slice of a sorted run, decoded from packed columns a few at a time."""

    def __init__(self, table: pa.Table, lo: int, hi: int, step: int = 256) -> None:
        self.table, self.at, self.hi, self.step, self.held = table, lo, hi, step, iter(())

    def __iter__(self) -> _Run:
        return self

    def __next__(self) -> tuple[str, str, int, int]:
        head = next(self.held, None)
        if head is None:
            if self.at >= self.hi:
                raise StopIteration
            n = min(self.step, self.hi - self.at)
            part = self.table.slice(self.at, n)
            key, ts, page = (part.column(c).to_pylist() for c in ("url_key", "ts", "page_id"))
            self.held = iter([(k, t, -1 if p is None else p, self.at + i) for i, (k, t, p) in enumerate(zip(key, ts, page, strict=True))])
            self.at += n
            head = next(self.held)
        return head


def merge_index(runs: DataFrame, partitions: int | None = None) -> DataFrame:
    """All captures in global order of (url_key, ts, page_id): by part, then seq (see INDEX), and position in the whole."""
    spark = runs.sparkSession
    partitions = partitions or max(shuffle_partitions(spark), -(-runs.count() // RANGE_LINES))
    sliced = runs.repartitionByRange(partitions, "url_key", "ts", "page_id").sortWithinPartitions("run", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = list(batches)
        if not sum(b.num_rows for b in got):
            return
        table = pa.Table.from_batches(got)
        name = table.column("run").combine_chunks()
        cuts = [0, *(np.flatnonzero(pc.not_equal(name.slice(1), name.slice(0, len(name) - 1)).to_numpy(zero_copy_only=False)) + 1).tolist(), len(name)]
        merged = LoserTree([_Run(table, a, b) for a, b in zip(cuts, cuts[1:], strict=False)])
        part, seq, order = TaskContext.get().partitionId(), 0, array("q")
        for _, head in merged:
            order.append(head[3])
            if len(order) == 10_000 or seq + len(order) == table.num_rows:
                n = len(order)
                out = table.take(pa.array(np.frombuffer(order, np.int64))).append_column("part", pa.array(np.full(n, part, np.int32)))
                yield from out.append_column("seq", pa.array(np.arange(seq, seq + n))).combine_chunks().to_batches()
                seq, order = seq + n, array("q")

    index = materialize(spark, sliced.mapInArrow(run, INDEX), "warc-index")
    sizes = sorted((r["part"], r["n"]) for r in index.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row a range
    before = np.cumsum([0, *(n for _, n in sizes)])[:-1].tolist()
    starts = spark.createDataFrame([(part, b) for (part, _), b in zip(sizes, before, strict=True)], "part int, start long")
    return index.join(starts, "part").select(*index.columns, (F.col("start") + F.col("seq")).alias("position"))


def read(index: DataFrame, uri: str, payloads: bool = False) -> DataFrame:
    """The records that an index lists (see RECORD), with their payload if asked for; digests and index lines are verified."""
    spark = index.sparkSession
    wanted = index.select("file", "offset", "length", "url_key", "ts", "position")
    wanted = wanted.repartition(shuffle_partitions(spark), "file").sortWithinPartitions("file", "offset")
    schema = RECORD + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(uri)
        name, source = None, None
        for batch in batches:
            rows = []
            for file, offset, length, key, ts, position in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, fs.open_input_file(f"{root}/{file}")
                fields, http, payload = parse(zlib.decompress(source.read_at(length, offset), 31))
                kind, said, me = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Record-ID"]
                if kind == "response" and (digest(payload) != said or len(payload) != int(http["Content-Length"])):
                    raise ValueError(f"payload of {me} does not match its digest")
                if fields["WARC-Date"] != ts or "%0" not in fields["WARC-Target-URI"] and url_key(fields["WARC-Target-URI"]) != key:
                    raise ValueError(f"{me} is not the capture that the index has at position {position}")
                other = fields.get("WARC-Refers-To")
                rows.append((
                    _page(me), fields["WARC-Target-URI"], fields["WARC-Date"], int(http["Content-Length"]), said, kind,
                    _page(other) if other else None, me, other, position, *([payload] if payloads else []),
                ))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        if source is not None:
            source.close()

    return wanted.mapInArrow(run, schema)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a page, as read back; position is its place (from 0) in the merged capture history of all URLs."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    uri = scratch(spark, "warc")
    index = merge_index(write(pages, uri))
    return read(index, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "position")


OP9_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, coalesce(html, '') AS html,
 regexp_extract(trim(coalesce(url, '')), '^[A-Za-z]+://(?:www\\.)?([^/?#:]*)(:[0-9]+)?([^?#]*)(\\?[^#]*)?', ['host', 'port', 'path', 'query']) AS u FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS top,
 lower(concat(list_aggregate(list_reverse(string_split(u.host, '.')), 'string_agg', ','), CASE WHEN u.port IN (':80', ':443') THEN '' ELSE u.port END, ')',
  CASE WHEN u.path = '' THEN '/' ELSE u.path END, u.query)) AS url_key FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
 list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((16 * (strpos('0123456789abcdef', substr(h, 1 + 5 * i // 4, 1)) - 1)
  + strpos('0123456789abcdef', substr(h, 2 + 5 * i // 4, 1)) - 1) >> (3 - i % 4)) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
 CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to,
 row_number() OVER (ORDER BY url_key, page_id % 1000000000, page_id) - 1 AS position
FROM d
"""
