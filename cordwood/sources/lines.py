"""Lines from text: splitting, encodings, compressed files, numbering, windows."""

from __future__ import annotations

import bz2
import gzip
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# First bytes of compressed files and of encodings, longest first.
MAGIC = {b"\x1f\x8b": "gzip", b"PK\x03\x04": "zip", b"BZh": "bzip2", b"\x28\xb5\x2f\xfd": "zstd"}
MARKS = ((b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\xef\xbb\xbf", "utf-8"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"))
SNIFF = 64 * 1024


class LineSplitter:
    """Lines from chunks of bytes: parted at \\n only, one \\r before it dropped, an unfinished last line held back."""

    def __init__(self, encoding: str = "utf-8"):
        self.encoding, self.rest = encoding, b""
        self.newline = "\n".encode(encoding if encoding[:5] != "utf-8" else "utf-8")

    def append(self, data: bytes) -> list[str]:
        self.rest += data
        if len(self.newline) == 1:
            *whole, self.rest = self.rest.split(b"\n")
            texts = [x.decode(self.encoding, "replace") for x in whole]
        else:
            step = len(self.newline)
            end = next((i for i in range(len(self.rest) // step * step - step, -1, -step) if self.rest[i : i + step] == self.newline), None)
            if end is None:
                return []
            texts = self.rest[:end].decode(self.encoding, "replace").split("\n")
            self.rest = self.rest[end + step :]
        return [t[:-1] if t.endswith("\r") else t for t in texts]

    def close(self) -> list[str]:
        """The unfinished line, if there is one."""
        rest, self.rest = self.rest, b""
        text = rest.decode(self.encoding, "replace")
        return [text[:-1] if text.endswith("\r") else text] if rest else []


def detect_encoding(head: bytes, fallback: str = "cp1252") -> tuple[str, int]:
    """(encoding, length of its mark) by mark, else UTF-8 if the first 64 KB are valid, else fallback."""
    for mark, name in MARKS:
        if head.startswith(mark):
            return name, len(mark)
    sample = head[:SNIFF]
    try:
        sample.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.end < len(sample) or len(sample) < SNIFF:
            return fallback, 0
    return "utf-8", 0


def detect_compression(head: bytes) -> str | None:
    return next((name for magic, name in MAGIC.items() if head.startswith(magic)), None)


def decompress(data: bytes, entry: str | None = None) -> bytes:
    """The bytes behind any compression its first bytes tell; of a zip the entry named, else the largest."""
    kind = detect_compression(data[:4])
    if kind == "gzip":
        return gzip.decompress(data)
    if kind == "bzip2":
        return bz2.decompress(data)
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)).read()
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = [i for i in z.infolist() if not i.is_dir()]
            return z.read(entry or max(names, key=lambda i: i.file_size))
    return data


def zip_entries(data: bytes) -> list[tuple[str, int]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return [(i.filename, i.file_size) for i in z.infolist() if not i.is_dir()]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """source, line_number, text of UTF-8 text files, large ones split over many tasks.

    Lines part at \\n only and lose one \\r; an unfinished last line counts. Line numbers are prefix sums: the lines of
    each split of a file are counted first, then numbered from where the splits before it end.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_at"),
        F.regexp_replace("value", "\r$", "").alias("text"), F.monotonically_increasing_id().alias("_id"),
    )
    sums = raw.groupBy("source", "_at").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = W.partitionBy("source").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return raw.join(sums, ["source", "_at"]).select("source", (F.col("_id") - F.col("_first") + F.col("_base") + 1).alias("line_number"), "text")


STRIDE = 1024  # lines between two entries of a line index


def line_index(spark: SparkSession, path: str, store: str) -> DataFrame:
    """source, size, changed, line_number, byte_offset: where every STRIDE-th line of UTF-8 text files begins, and with
    line_number 0 how many lines there are (in byte_offset).

    The index is kept as a table in store. A file whose size and time of change are as they were is not read again;
    others are read once, in splits, and their entries added, so that old ones of a changed file no longer match.
    """
    now = spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), F.col("length").alias("size"), F.col("modificationTime").alias("changed"))
    schema = "source string, size long, changed timestamp, line_number long, byte_offset long"
    try:
        held = spark.read.schema(schema).parquet(store)
        stale = now.join(held.where("line_number = 0"), ["source", "size", "changed"], "left_anti").select("source").collect()
    except AnalysisException:  # there is none yet
        stale = now.select("source").collect()
    if stale:
        raw = spark.read.option("lineSep", "\n").text([r.source for r in stale]).select(
            F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"), (F.octet_length("value") + 1).cast("long").alias("_b"),
        )
        before = W.partitionBy("source", "_at").orderBy("_id").rowsBetween(W.unboundedPreceding, -1)
        inner = raw.withColumns({"_n": F.row_number().over(W.partitionBy("source", "_at").orderBy("_id")), "_o": F.coalesce(F.sum("_b").over(before), F.lit(0))})
        sums = raw.groupBy("source", "_at").agg(F.count("*").alias("_lines"), F.sum("_b").alias("_bytes"))
        past = W.partitionBy("source").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
        sums = sums.withColumns({"_ln": F.coalesce(F.sum("_lines").over(past), F.lit(0)), "_bo": F.coalesce(F.sum("_bytes").over(past), F.lit(0))})
        rows = inner.join(sums, ["source", "_at"]).select("source", (F.col("_n") + F.col("_ln")).alias("line_number"), (F.col("_o") + F.col("_bo")).alias("byte_offset"))
        total = sums.groupBy("source").agg(F.lit(0).cast("long").alias("line_number"), F.sum("_lines").alias("byte_offset"))
        kept = rows.where((F.col("line_number") - 1) % STRIDE == 0).unionByName(total.select("source", "line_number", "byte_offset"))
        kept.join(now, "source").select("source", "size", "changed", "line_number", "byte_offset").coalesce(1 + len(stale) // 64).write.mode("append").parquet(store)
        held = spark.read.schema(schema).parquet(store)
    return held.join(now, ["source", "size", "changed"], "left_semi")


def read_page(index: DataFrame, source: str, first: int, count: int) -> list[tuple[int, str]]:
    """(line_number, text) of count lines of a file from first on: the index says where to begin, and no more than a
    stride and the page is read. The file has to be one that the driver can open."""
    start = index.where((F.col("source") == source) & F.col("line_number").between(1, first)).orderBy(F.desc("line_number")).limit(1).collect()
    if not start or count <= 0:
        return []
    out, number = [], start[0].line_number
    with open(source.removeprefix("file:").replace("///", "/", 1), "rb") as f:
        f.seek(start[0].byte_offset)
        for raw in f:
            if number >= first:
                out.append((number, raw.decode("utf-8", "replace").rstrip("\n").removesuffix("\r")))
            if len(out) == count:
                break
            number += 1
    return out


def read_any(spark: SparkSession, path: str, include_unterminated: bool = True, fallback: str = "cp1252", glob: str | None = None) -> DataFrame:
    """source, line_number, text of files in any encoding and compression, told by their bytes; one task a file, as
    neither can be split."""
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path_, content in zip(pdf["path"], pdf["content"]):
                data = decompress(bytes(content))
                encoding, skip = detect_encoding(data, fallback)
                splitter = LineSplitter(encoding)
                texts = splitter.append(data[skip:])
                texts += splitter.close() if include_unterminated else []
                for at in range(0, len(texts), 50_000):
                    part = texts[at : at + 50_000]
                    yield pd.DataFrame({"source": path_, "line_number": range(at + 1, at + len(part) + 1), "text": part})

    return files.mapInPandas(run, "source string, line_number long, text string")


def newest_file(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """The most recently changed file of a folder that matches a wildcard, ties by name; None without any."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    top = found.orderBy(F.desc("modificationTime"), F.desc("path")).limit(1).collect()
    return top[0].path if top else None


def line_window(lines: DataFrame, center: int, before: int, after: int) -> DataFrame:
    """Lines from center - before to center + after."""
    return lines.where(F.col("line_number").between(max(1, center - before), center + after))


def line_range(lines: DataFrame, first: int, count: int) -> DataFrame:
    return lines.where(F.col("line_number").between(first, first + count - 1))
