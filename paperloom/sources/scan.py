"""Document scan and format detection."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_FILE = 500 << 20
OVERSIZED = "oversized"
MAX_ENTRIES, MAX_UNZIPPED = 500, 100 << 20


def read_documents(spark: SparkSession, path: str | list[str], pattern: str = "*") -> DataFrame:
    """doc_id, path, length and content of the files below ``path``; larger ones than the limit are not read and have no content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    # the reader knows a file's length before it reads it, so each side reads no more than it needs
    small = files.where(F.col("length") <= MAX_FILE).select("path", "length", "content")
    large = files.where(F.col("length") > MAX_FILE).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large).select(F.xxhash64("path").alias("doc_id"), "path", "length", "content")


def coarse_format(content: Column) -> Column:
    """The format by magic bytes; ZIP files are ``hwpx`` and OLE2 files ``hwp`` until they are looked into."""
    starts = lambda raw: F.substring(content, 1, len(raw)) == F.lit(bytearray(raw))
    head = F.decode(F.substring(content, 1, 512), "ISO-8859-1")
    head = F.regexp_replace(head, r"^(\x{EF}\x{BB}\x{BF})+", "")
    hwpml = F.regexp_replace(head, r"^\s+", "").startswith("<?xml") & F.contains(head, F.lit("<HWPML"))
    return (
        F.when(F.coalesce(F.length(content), F.lit(0)) < 4, "unknown")
        .when(starts(b"HWP Document File V3.00"), "hwp3")
        .when(starts(b"PK\x03\x04"), "hwpx")
        .when(starts(b"\xd0\xcf\x11\xe0"), "hwp")
        .when(starts(b"%PDF"), "pdf")
        .when(hwpml, "hwpml")
        .otherwise("unknown")
    )


def zip_directory(content: bytes) -> tuple[int, int]:
    """(unpacked bytes, entries) as the central directory declares them; (0, 0) if there is none to read."""
    at = content.rfind(b"PK\x05\x06", max(0, len(content) - 65557))
    if at < 0 or at + 22 > len(content):
        return 0, 0
    entries, size, begin = struct.unpack_from("<HII", content, at + 10)
    if begin + size > len(content):
        return 0, entries
    total, pos = 0, begin
    for _ in range(entries):
        if pos + 46 > begin + size or content[pos : pos + 4] != b"PK\x01\x02":
            break
        total += struct.unpack_from("<I", content, pos + 24)[0]
        pos += 46 + sum(struct.unpack_from("<HHH", content, pos + 28))
    return total, entries


def zip_kind(content: bytes) -> str:
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
    except Exception:
        return "unknown"
    have = set(names)
    if "xl/workbook.xml" in have:
        return "xlsx"
    if "word/document.xml" in have:
        return "docx"
    if "Contents/content.hpf" in have or "mimetype" in have or any(n.startswith("Contents/") for n in names):
        return "hwpx"
    return "unknown"


def ole_kind(content: bytes) -> str:
    from paperloom.sources.cfb import streams

    try:
        names = {p.split("/")[0] for p in streams(content)}
    except Exception:
        return "unknown"
    if names & {"Workbook", "Book"}:
        return "xls"
    return "hwp" if "FileHeader" in names or any(n == "DocInfo" or n.startswith("Section") for n in names) else "unknown"


def refined(coarse: str, raw: bytes) -> str:
    """The format of a file of that coarse format."""
    kind = {"hwpx": zip_kind, "hwp": ole_kind}.get(coarse, lambda _: "unknown")(raw)
    return coarse if kind == "unknown" else kind


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, unpacked, entries = [], [], []
        for content, coarse in zip(batch["content"], batch["coarse"].to_pylist(), strict=True):
            raw = content.as_py() or b""
            size, n = zip_directory(raw) if coarse == "hwpx" else (0, 0)
            kinds.append(refined(coarse, raw))
            unpacked.append(size)
            entries.append(n)
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "file_type": pa.array(kinds, pa.string()), "unpacked": pa.array(unpacked, pa.int64()), "entries": pa.array(entries, pa.int32()), "content": batch["content"]})


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, content and coarse format; a file whose ``length`` is above the limit is ``oversized``."""
    coarse = coarse_format(F.col("content"))
    if "length" in docs.columns:
        coarse = F.when(F.col("content").isNull() & (F.col("length") > MAX_FILE), OVERSIZED).otherwise(coarse)
    return docs.select("doc_id", "content", coarse.alias("coarse"))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, file_type, unpacked, entries and content of documents."""
    return marked(docs).mapInArrow(_refine, "doc_id long, file_type string, unpacked long, entries int, content binary")
