"""WARC archives compressed with a Zstandard dictionary, and their reader.

``write_archives`` turns rows into archives of bounded size: a leading skippable frame (magic 0x184D2A5D) with a
dictionary trained on the archive's own records, then one Zstandard frame for each record.  Archives are rows of a
binary column, so that any file system Spark writes to will hold them; ``export_archives`` puts them in files.
``read_archives`` gives the records back and recomputes the digest of each stored payload.

Records of equal payload (of at least ``min_bytes``): that with the largest id is the response, the others revisit
it and store no payload.  Null payloads are empty.  Ids are of any type that has an order and a text.  Rows that repeat the
winning id are responses too; rows with a null id revisit it, and with null ids only, all are responses.  A payload of
any length is one record.  No columns but the named three are read.  An empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pepspark.llm.common import map_arrow, map_batches, staged, table, text_bytes

SKIPPABLE = 0x184D2A5D
ARCHIVE_BYTES = 8 << 20
BROADCAST_ROWS = 100_000
DICTIONARY_BYTES, TRAINING_BYTES = 32 << 10, 1 << 20


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def payload_roles(df: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``_id, _url, _payload, _refers``: the id of the response for revisits, else null.

    Digests are counted with partial aggregation, so a payload that fills a third of the table is one row a task;
    only digests that occur twice meet the rows again, as a table of their own: broadcast if they are few, and else a join
    that is split where one payload has very many pages.
    """
    rows = df.withColumn("_sha1", F.sha1("_payload"))
    keys = (
        rows.where(F.length("_payload") >= min_bytes)
        .groupBy("_sha1")
        .agg(F.max("_id").alias("_last"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1 and _last is not null")
        .select("_sha1", "_last")
    )
    keys = staged(keys, "keys")
    met = rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, "_sha1", "left")
    return met.select("_id", "_url", "_payload", F.when(~F.col("_last").eqNullSafe(F.col("_id")), F.col("_last")).alias("_refers"))


def urn(ident) -> str:
    return "<urn:page:" + ("" if ident is None else "=" + quote(str(ident), safe="")) + ">"


def record(page_id, url, payload: bytes, refers) -> bytes:
    """One WARC 1.1 record; a revisit has the digest and size of its payload, but not its bytes."""
    body = b"" if refers is not None else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {urn(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + "".join((url or "").splitlines()),
        f"WARC-Payload-Digest: sha1:{_digest(payload)}",
        f"WARC-Identified-Payload-Length: {len(payload)}",
    ]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers)}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def compress(records: list[bytes], level: int = 3) -> bytes:
    """The archive of the records: dictionary frame, then a frame for each record."""
    samples, size = [], 0
    step = max(1, sum(map(len, records)) // TRAINING_BYTES)
    for x in records[::step]:
        samples += [x[i : i + 4096] for i in range(0, len(x), 4096)]
        size += len(x)
    try:
        data = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, size // 8)), samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        data = b"".join(samples)[:DICTIONARY_BYTES]
    words = zstandard.ZstdCompressionDict(data)
    words.precompute_compress(level=level)
    one = zstandard.ZstdCompressor(level=level, dict_data=words)
    return b"".join([struct.pack("<II", SKIPPABLE, len(data)), data, *(one.compress(x) for x in records)])


def frames(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one after another."""
    magic, size = struct.unpack_from("<II", archive)
    if magic != SKIPPABLE:
        raise ValueError("the archive has no dictionary frame")
    words = zstandard.ZstdCompressionDict(archive[8 : 8 + size])
    one = zstandard.ZstdDecompressor(dict_data=words)
    rest = memoryview(archive)[8 + size :]
    while len(rest):
        step = one.decompressobj()
        yield step.decompress(rest)
        rest = rest[len(rest) - len(step.unused_data) :]


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    return fields, rest[: int(fields["Content-Length"])]


def write_archives(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """``n_records long, archive binary``: archives of about ``ARCHIVE_BYTES`` of records each."""
    source = df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), text_bytes(F.col(payload_col)).alias("_payload"))
    source = payload_roles(source, min_bytes)

    def run(batches):
        waiting, size = [], 0
        for batch in batches:
            for page_id, url, payload, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                waiting.append(record(page_id, url, payload, refers))
                size += len(waiting[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_pydict({"n_records": pa.array([len(waiting)], pa.int64()), "archive": pa.array([compress(waiting)], pa.binary())})
                    waiting, size = [], 0
        if waiting:
            yield pa.RecordBatch.from_pydict({"n_records": pa.array([len(waiting)], pa.int64()), "archive": pa.array([compress(waiting)], pa.binary())})

    return map_batches(source, run, "n_records long, archive binary")


def read_archives(archives: DataFrame, id_col: str = "page_id", id_type: str = "long") -> DataFrame:
    """One row for each record: id (as ``id_type``), url, type, digest, payload size and payload (null for revisits)."""
    schema = "_id string, url string, record_type string, payload_digest string, payload_bytes long, _refers string, payload binary"
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]

    def number(text: str | None):
        return unquote(text[len("<urn:page:=") : -1]) if text and text != "<urn:page:>" else None

    def rows(batch):
        for archive in batch.column(0).to_pylist():
            out, size = [], 0
            for data in frames(archive):
                head, body = parse(data)
                digest, length = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["WARC-Identified-Payload-Length"])
                if head["WARC-Type"] == "response" and (_digest(body) != digest or len(body) != length):
                    raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
                stored = body if head["WARC-Type"] == "response" else None
                out.append((number(head["WARC-Record-ID"]), head.get("WARC-Target-URI", ""), head["WARC-Type"], digest, length, number(head.get("WARC-Refers-To")), stored))
                size += len(body)
                if size > ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    found = map_arrow(archives.select("archive"), rows, schema)
    return found.select(F.col("_id").cast(id_type).alias(id_col), "url", "record_type", "payload_digest", "payload_bytes", F.col("_refers").cast(id_type).alias("refers_to"), "payload")


def export_archives(archives: DataFrame, folder: str) -> list[str]:
    """Each archive as a file ``PART-NUMBER.warc.zst`` of a folder that all executors reach (any that pyarrow opens); the
    task that has an archive writes it, under another name until it is whole.  Only the names reach the driver."""

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        where, root = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + os.path.abspath(folder))
        where.create_dir(root, recursive=True)
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for archive in batch.column(0):
                name = f"{part:06d}-{k:06d}.warc.zst"
                open_name = f"{root}/.{name}.{uuid.uuid4().hex}"
                with where.open_output_stream(open_name) as f:
                    f.write(archive.as_buffer())
                where.move(open_name, f"{root}/{name}")
                yield pa.RecordBatch.from_pydict({"name": pa.array([f"{folder}/{name}"])})
                k += 1

    return sorted(r["name"] for r in map_batches(archives.select("archive"), run, "name string").collect())


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """Every page archived, and what the archives say of it when read back."""
    pages = table(spark, sf_dir, "pages")
    archives = staged(write_archives(pages), "archives")
    return read_archives(archives, id_type=pages.schema["page_id"].dataType.simpleString()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
