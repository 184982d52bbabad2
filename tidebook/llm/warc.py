"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame for each record.

Digests and the choice between response and revisit are DataFrame work. Tasks write archives into the shared
folder under names of their own attempt; only archives that a finished task has named are read, so a lost executor
leaves unread files and nothing else. The reader takes the dictionary out of the first frame, decodes one frame at
a time, and checks header, length and digest of every record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.common import filesystem, looked_up, materialize, read_table, scratch_path

#: Magic number of the skippable frame that holds the dictionary, as the WARC-Zstandard specification fixes it.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: The dictionary is trained on at most so many payloads, each cut to so many bytes; it only helps compression.
DICTIONARY_ROWS, DICTIONARY_BYTES, SAMPLE_BYTES = 256, 64 << 10, 16 << 10
#: Records of payloads with fewer bytes are never revisits.
LEAST_REVISIT = 0
ARCHIVE_BYTES = 64 << 20
#: What is read at a time; what follows a frame in it is copied once for each frame.
READ_BYTES = 64 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArchiveError(ValueError):
    """An archive that breaks the format: bad magic, torn frame, bad header, length or digest."""


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- records --------------------------------------------------------------------------------------------------


def record(kind: str, page_id: int | None, uri: str, digest: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has no block; its payload length stands in a header of its own."""
    block = payload if kind == "response" else b""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Payload-Length", len(payload)), ("Content-Type", "application/octet-stream")]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields.append(("Content-Length", len(block)))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers (lower-case names), block; raises ArchiveError where the record is not whole."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    if not sep:
        raise ArchiveError("record without end of header")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ArchiveError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(": ")
        if not colon:
            raise ArchiveError(f"bad header line {line[:40]!r}")
        fields[name.lower()] = value
    for need in ("warc-type", "warc-record-id", "warc-payload-digest", "content-length"):
        if need not in fields:
            raise ArchiveError(f"no {need}")
    if not fields["content-length"].isdigit() or rest[-4:] != b"\r\n\r\n" or len(rest) - 4 != int(fields["content-length"]):
        raise ArchiveError("length and block differ")
    return fields | {"block": rest[:-4]}


# --- archives -------------------------------------------------------------------------------------------------


def _clean_uri(uri: str | None) -> str:
    return "".join(c if c.isprintable() and c != " " else "%{:02X}".format(ord(c)) if ord(c) < 256 else "?" for c in uri or "")


def write_archive(sink, dictionary: bytes, records: Iterator[bytes], compressor: zstandard.ZstdCompressor) -> int:
    """Writes the dictionary frame and the records to a binary sink; returns the number of records."""
    sink.write(struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary)
    n = 0
    for raw in records:
        sink.write(compressor.compress(raw))
        n += 1
    return n


def read_archive(source) -> Iterator[dict]:
    """Records of a binary source, one decoded frame at a time. The dictionary may itself be a compressed frame."""
    head = source.read(8)
    if len(head) < 8:
        raise ArchiveError("no dictionary frame")
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_MAGIC:
        raise ArchiveError(f"leading frame has magic {magic:#x}")
    dictionary = source.read(size)
    if len(dictionary) != size:
        raise ArchiveError("torn dictionary")
    if dictionary[:4] == struct.pack("<I", FRAME_MAGIC):
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary, max_output_size=1 << 27)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    rest = source.read(READ_BYTES)
    while rest:
        frame, parts = decoder.decompressobj(), []
        while not frame.eof:
            rest = rest or source.read(READ_BYTES)
            if not rest:
                raise ArchiveError("torn record")
            try:
                parts.append(frame.decompress(rest))
            except zstandard.ZstdError as e:
                raise ArchiveError(f"bad frame: {e}") from e
            rest = frame.unused_data if frame.eof else b""
        yield parse_record(b"".join(parts))
        rest = rest or source.read(READ_BYTES)


def write_archives(pages: DataFrame, folder: str, dictionary: bytes) -> DataFrame:
    """Archives of pages (page_id, url, payload binary, digest, record_type, refers_to); returns (path, records)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        packer = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)

        def rows() -> Iterator[bytes]:
            for b in batches:
                for p, u, x, d, k, r in zip(*b.columns):
                    yield record(k.as_py(), p.as_py(), _clean_uri(u.as_py()), d.as_py(), x.as_py(), r.as_py())

        todo, paths, counts = rows(), [], []
        first = next(todo, None)
        while first is not None:
            path = f"{root}/{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(path) as sink:
                def some(first=first) -> Iterator[bytes]:
                    nonlocal carried
                    size, now = 0, first
                    while now is not None:
                        yield now
                        size += len(now)
                        now = next(todo, None)
                        if size >= ARCHIVE_BYTES:
                            break
                    carried = now
                carried = None
                counts.append(write_archive(sink, dictionary, some(), packer))
            paths.append(path)
            first = carried
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], ["path", "records"])

    return pages.select("page_id", "url", "payload", "digest", "record_type", "refers_to").mapInArrow(write, "path string, records long")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Records of the archives that the manifest (path, records) names, checked against its counts.

    Columns: page_id, record_type, payload_digest, payload_bytes, refers_to. A broken archive fails the job.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(folder)
        page = lambda v: int(v[10:-1]) if v and v[10:-1] else None
        for b in batches:
            for path, count in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out, seen = [], 0
                with fs.open_input_stream(path) as source:
                    for r in read_archive(source):
                        digest, kind = r["warc-payload-digest"].removeprefix("sha1:"), r["warc-type"]
                        if kind == "response" and (digest_of(r["block"]) != digest or len(r["block"]) != int(r["warc-payload-length"])):
                            raise ArchiveError(f"{path}: digest or length of {r['warc-record-id']} is wrong")
                        out.append((page(r["warc-record-id"]), kind, digest, int(r["warc-payload-length"]), page(r.get("warc-refers-to"))))
                        seen += 1
                        if len(out) == 4096:
                            yield _batch(out)
                            out = []
                if seen != count:
                    raise ArchiveError(f"{path} has {seen} records of {count}")
                if out:
                    yield _batch(out)

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(parts).mapInArrow(read, "page_id long, record_type string, payload_digest string, payload_bytes long, refers_to long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["page_id", "record_type", "payload_digest", "payload_bytes", "refers_to"])


# --- the operator ---------------------------------------------------------------------------------------------


def _payload() -> Column:
    return F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")


def _base32(hex_sha1: Column) -> Column:
    """Base32 of a 40-digit hex string: eight groups of 20 bits, each four letters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    groups = [F.conv(F.substring(hex_sha1, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*[F.substring(letters, F.shiftright(g, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for g in groups for s in (15, 10, 5, 0)])


def dictionary_for(pages: DataFrame) -> bytes:
    """A dictionary from at most DICTIONARY_ROWS payload beginnings; empty where they are too few to train on."""
    some = [bytes(r[0]) for r in pages.where("html is not null").select(F.substring("html", 1, SAMPLE_BYTES).cast("binary")).limit(DICTIONARY_ROWS).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, some).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def archive(pages: DataFrame, least: int = LEAST_REVISIT) -> tuple[DataFrame, str]:
    """Writes pages (page_id, url, html) as archives and returns their records read back, and the folder.

    A null html is an empty payload. Of equal payloads of at least `least` bytes the smallest page_id is the
    response, all others revisit it; rows with a null page_id are responses, as nothing could refer to them, and
    so are repeated rows of the smallest page_id. Extra columns are ignored; an empty table writes no archive.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), _payload().alias("payload"), F.sha1(_payload()).alias("sha1"))
    firsts = rows.where(F.octet_length("payload") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha1", "first")
    firsts = materialize(firsts, "firsts")
    repeats = looked_up(rows.select("page_id", "sha1"), firsts, "sha1", F.col("page_id"), "inner").where("page_id <> first").select("page_id", "sha1", "first").distinct()
    known = materialize(repeats, "repeats")
    typed = rows.join(known, ["page_id", "sha1"], "left")
    typed = typed.select("page_id", "url", "payload", _base32(F.col("sha1")).alias("digest"), F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("first").alias("refers_to"))
    manifest = materialize(write_archives(typed, folder, dictionary_for(pages)), "manifest")
    return read_archives(manifest, folder), folder


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = archive(read_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
  array_to_string(flatten([[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(d, 5 * i + 1, 5) AS INTEGER) >> s) & 31) + 1, 1) FOR s IN [15, 10, 5, 0]] FOR i IN range(8)]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
