"""Physical lines of text inputs as a DataFrame, numbered without gathering a file in one task."""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowsmith.options import MAX_SNIFF, ReadOptions
from rowsmith.sources.scratch import scratch


def head(spark: SparkSession, path: str, n: int = MAX_SNIFF) -> tuple[bytes, list[str], int]:
    """(first bytes of the first file, all files in order, total bytes), through Hadoop's file systems; gzip and
    others by their suffix."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    pattern = jvm.org.apache.hadoop.fs.Path(path)
    fs = pattern.getFileSystem(conf)
    found = fs.globStatus(pattern) or []
    files = []
    for status in found:
        for s in fs.listStatus(status.getPath()) if status.isDirectory() else [status]:
            name = s.getPath().getName()
            if s.isFile() and not name.startswith(("_", ".")):
                files.append((s.getPath().toString(), s.getLen()))
    files.sort()
    if not files:
        raise FileNotFoundError(path)
    first = jvm.org.apache.hadoop.fs.Path(files[0][0])
    stream = fs.open(first)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(first)
    if codec is not None:
        stream = codec.createInputStream(stream)
    try:
        data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
    finally:
        stream.close()
    return data, [f for f, _ in files], sum(k for _, k in files)


def spool(spark: SparkSession, stream: Any, path: str) -> None:
    """Copies an open stream, seekable or not, of bytes or text, to a path of the shared folder, a piece at a time."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        while part := stream.read(1 << 20):
            out.write(bytearray(part.encode() if isinstance(part, str) else part))
    finally:
        out.close()


def decoder(options: ReadOptions):
    """bytes -> str under the options: declared encoding, invalid sequences replaced as asked for."""
    name = options.file_encoding.split(":")[0]
    codecs.lookup(name)
    handler = "rowsmith-" + options.invalid_byte_sequence.encode().hex()
    text = options.invalid_byte_sequence

    def decode(data: bytes) -> str:
        codecs.register_error(handler, lambda e: (text, e.end))
        return data.decode(name, handler)

    return decode


def is_utf8(options: ReadOptions) -> bool:
    return options.file_encoding.split(":")[0].lower().replace("_", "-") in ("utf-8", "utf8")


def read(spark: SparkSession, files: list[str], options: ReadOptions, row_sep: str, made: list[str] | None = None) -> DataFrame:
    """(file, file_line from 1, raw) of every physical line; `made` takes note of what is written for it.

    UTF-8 is split by Spark's text source wherever it likes; lines are numbered from the counts per file block and
    a line's place in its block. Other encodings, and texts to repair, are decoded a file at a time.
    """
    if is_utf8(options) and not options.force_utf8:
        text = spark.read.option("lineSep", row_sep).text(files)
        lines = text.select(
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("id"), F.col("value").alias("raw"),
        )
        blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
        before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
        # a row a file block, counted once: width, types and rows each read the lines again
        path = scratch(spark, "blocks")
        blocks.write.parquet(path)
        if made is not None:
            made.append(path)
        blocks = spark.read.schema(blocks.schema).parquet(path)
        numbered = lines.join(blocks, ["file", "block"]).withColumn("file_line", F.col("before") + F.col("id") - F.col("first") + 1)
        raw = F.when(F.col("file_line") == 1, F.regexp_replace("raw", "^\\x{FEFF}", "")).otherwise(F.col("raw"))
        return numbered.select("file", "file_line", raw.alias("raw"))
    decode = decoder(options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = decode(content).removeprefix("﻿").split(row_sep)
                if found and not found[-1]:
                    found.pop()
                for lo in range(0, len(found), 10_000):
                    part = found[lo : lo + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(part), pa.string()), pa.array(range(lo + 1, lo + 1 + len(part)), pa.int64()), pa.array(part, pa.string())],
                        names=["file", "file_line", "raw"],
                    )

    binary = spark.read.format("binaryFile").load(files).select("path", "content")
    return binary.mapInArrow(run, "file string, file_line long, raw string")
