"""Media columns: texts as samples of ISO base media files, and an index of such files.

``mux`` stores a payload as fixed-size 8-bit frames of one uncompressed video track; ``index_media`` walks the
nested boxes and decodes the sample tables into codec, duration and key frame byte ranges without touching the
payload; ``read_samples`` reads the payload back by those ranges.  All three map rows to rows: no shuffle, and
memory bounded by one Arrow batch.

Null text counts as empty; an empty text becomes one padding frame.  Repeated rows give repeated rows, whatever their ids,
null ones too.  A text of any length is one file; from 4 GiB boxes and chunk offsets are of 64 bits.  Bytes that are no ISO
media file give a null codec, zero duration and no ranges; a file of several tracks is known by its first video track.
``mux`` reads no columns but the id and the text; ``index_media`` and ``read_samples`` keep all columns and replace ones
that are called ``info`` or ``payload``.  An empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pepspark.llm.common import bounded_batches, map_arrow, table, text_bytes

FRAME = 576
WIDTH = HEIGHT = 24
FRAMES_PER_CHUNK = 64
TIMESCALE, TICKS = 600, 24
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts"}

RANGES = T.ArrayType(T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())]))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    size = len(body) + 8
    if size < 1 << 32:
        return struct.pack(">I4s", size, kind) + body
    return struct.pack(">I4sQ", 1, kind, size + 8) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _moov(frames: int, first: int) -> bytes:
    """The movie box of a file whose media data start at byte ``first``."""
    ticks = frames * TICKS
    chunks = [first + i * FRAMES_PER_CHUNK * FRAME for i in range(-(-frames // FRAMES_PER_CHUNK))]
    wide = chunks[-1] >= 1 << 32
    last = frames - (len(chunks) - 1) * FRAMES_PER_CHUNK
    runs = [(1, FRAMES_PER_CHUNK, 1)] if len(chunks) > 1 else []
    runs += [(len(chunks), last, 1)] if not runs or last != FRAMES_PER_CHUNK else []
    entry = _box(
        b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", WIDTH, HEIGHT, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1)
    )
    table_box = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, frames, TICKS)),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", struct.pack(">II", FRAME, frames)),
        _full(b"co64" if wide else b"stco", struct.pack(f">I{len(chunks)}{'Q' if wide else 'I'}", len(chunks), *chunks)),
    )
    media = _box(
        b"mdia",
        _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, ticks & 0xFFFFFFFF, 0x55C4, 0)),
        _full(b"hdlr", struct.pack(">I4s", 0, b"vide"), bytes(12), b"\0"),
        _box(
            b"minf",
            _full(b"vmhd", bytes(8), flags=1),
            _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))),
            table_box,
        ),
    )
    header = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, ticks & 0xFFFFFFFF), bytes(16), _MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=3)
    movie = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, ticks & 0xFFFFFFFF, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
    return _box(b"moov", movie, _box(b"trak", header, media))


def build_file(data: bytes) -> bytes:
    """An ISO media file whose samples are ``data`` and padding bytes 255 up to a positive multiple of a frame."""
    payload = data + b"\xff" * (-len(data) % FRAME if data else FRAME)
    brand = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    frames = len(payload) // FRAME
    head = 8 if len(payload) + 8 < 1 << 32 else 16
    first = len(brand) + len(_moov(frames, 0)) + head
    moov = _moov(frames, first)
    if len(brand) + len(moov) + head != first:  # wide chunk offsets made the table longer
        first = len(brand) + len(moov) + head
        moov = _moov(frames, first)
    return b"".join((brand, moov, _box(b"mdat", payload)))


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the bodies of the boxes in data[start:end]; stops at a broken size."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                return
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield kind, start + head, start + size
        start += size


def _leaves(data: bytes, start: int, end: int, trak: int = 0) -> Iterator[tuple[int, bytes, int, int]]:
    seen = 0
    for kind, a, b in boxes(data, start, end):
        if kind == b"trak":
            seen += 1
            yield from _leaves(data, a, b, seen)
        elif kind in CONTAINERS:
            yield from _leaves(data, a, b, trak)
        else:
            yield trak, kind, a, b


def parse_file(data: bytes) -> dict | None:
    """Codec, size, duration, sample and key frame byte ranges of the first video track, or else of the first track (whose
    size is 0); None if there is none."""
    try:
        tracks: dict[int, dict[bytes, tuple[int, int]]] = {}
        for trak, kind, a, b in _leaves(data, 0, len(data)):
            tracks.setdefault(trak, {})[kind] = (a, b)
        whole = [x for _, x in sorted(tracks.items()) if {b"stsd", b"stts", b"stsc", b"stsz", b"mdhd"} <= x.keys()]
        if not whole:
            return None
        seen = [x for x in whole if b"hdlr" in x and data[x[b"hdlr"][0] + 8 : x[b"hdlr"][0] + 12] == b"vide"]
        leaf = (seen or whole)[0]
        at = leaf[b"stsd"][0] + 8
        codec = data[at + 4 : at + 8].decode("latin-1")
        width, height = struct.unpack_from(">HH", data, at + 32) if seen else (0, 0)
        at = leaf[b"mdhd"][0]
        scale = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]  # times before it are of 8 bytes or 4
        at = leaf[b"stts"][0] + 4
        deltas = struct.unpack_from(f">{2 * struct.unpack_from('>I', data, at)[0]}I", data, at + 4)
        ticks = sum(n * d for n, d in zip(deltas[::2], deltas[1::2], strict=True))
        at = leaf[b"stsz"][0] + 4
        fixed, count = struct.unpack_from(">II", data, at)
        sizes = [fixed] * count if fixed else struct.unpack_from(f">{count}I", data, at + 8)
        kind = b"co64" if b"co64" in leaf else b"stco"
        at = leaf[kind][0] + 4
        n = struct.unpack_from(">I", data, at)[0]
        chunks = struct.unpack_from(f">{n}{'Q' if kind == b'co64' else 'I'}", data, at + 4)
        at = leaf[b"stsc"][0] + 4
        n = struct.unpack_from(">I", data, at)[0]
        runs = struct.unpack_from(f">{3 * n}I", data, at + 4)
        firsts, per = runs[::3], runs[1::3]
        samples, k, r = [], 0, 0
        for c, offset in enumerate(chunks, 1):
            while r + 1 < len(firsts) and firsts[r + 1] <= c:
                r += 1
            for _ in range(per[r]):
                if k < count:
                    samples.append((offset, sizes[k]))
                    offset += sizes[k]
                    k += 1
        keys = range(1, count + 1)
        if b"stss" in leaf:
            at = leaf[b"stss"][0] + 4
            keys = struct.unpack_from(f">{struct.unpack_from('>I', data, at)[0]}I", data, at + 4)
        return {"codec": codec, "width": width, "height": height, "timescale": scale, "duration": ticks, "samples": samples, "keys": [samples[i - 1] for i in keys if i <= len(samples)]}
    except (struct.error, KeyError, IndexError):
        return None


def joined(ranges: list[tuple[int, int]]) -> list[dict]:
    """Neighbouring byte ranges made one."""
    out: list[dict] = []
    for offset, length in ranges:
        if out and out[-1]["offset"] + out[-1]["length"] == offset:
            out[-1]["length"] += length
        else:
            out.append({"offset": offset, "length": length})
    return out


def mux(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes long, media binary``: each text's bytes as an ISO media file."""
    source = df.select(F.col(id_col), text_bytes(F.col(text_col)).alias("_data"))
    kind = source.schema[0].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def rows(batch):
        ids, data = batch.column(0), batch.column(1).to_pylist()
        files = pa.array([build_file(x) for x in data], pa.binary())
        yield pa.RecordBatch.from_arrays([ids, pa.array([len(x) for x in data], pa.int64()), files], names=[id_col, "n_bytes", "media"])

    return map_arrow(source, rows, schema)


def index_media(df: DataFrame, media_col: str = "media") -> DataFrame:
    """``df`` with ``info``: codec, size, duration in ticks and seconds, samples, key frame and sample byte ranges."""
    info = T.StructType(
        [
            T.StructField("codec", T.StringType()),
            T.StructField("width", T.LongType()),
            T.StructField("height", T.LongType()),
            T.StructField("timescale", T.LongType()),
            T.StructField("duration", T.LongType()),
            T.StructField("n_samples", T.LongType()),
            T.StructField("n_keyframes", T.LongType()),
            T.StructField("keyframe_ranges", RANGES),
            T.StructField("sample_ranges", RANGES),
        ]
    )

    bounded_batches(df.sparkSession)

    @F.pandas_udf(info)
    def read(media):
        import pandas as pd

        rows = []
        for data in media:
            x = parse_file(bytes(data)) if data is not None else None
            if x is None:
                rows.append((None, 0, 0, 0, 0, 0, 0, [], []))
            else:
                rows.append((x["codec"], x["width"], x["height"], x["timescale"], x["duration"], len(x["samples"]), len(x["keys"]), joined(x["keys"]), joined(x["samples"])))
        return pd.DataFrame(rows, columns=info.fieldNames())

    return df.withColumn("info", read(F.col(media_col)))


def read_samples(df: DataFrame, media_col: str = "media") -> DataFrame:
    """``df`` (of ``index_media``) with ``payload``: the stored bytes at the sample ranges, in order."""
    part = F.transform("info.sample_ranges", lambda r: F.substring(F.col(media_col), (r["offset"] + 1).cast("int"), r["length"].cast("int")))
    return df.withColumn("payload", F.aggregate(part, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x)))


def op5_media_columns(spark, sf_dir: str) -> DataFrame:
    """The digest of every document stored as samples and read back."""
    docs = read_samples(index_media(mux(table(spark, sf_dir, "documents"))))
    info = F.col("info")
    ranges = F.array_join(F.transform(info["keyframe_ranges"], lambda r: F.concat_ws("+", r["offset"], r["length"])), ";")
    return docs.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws("|", info["codec"], F.concat_ws("x", info["width"], info["height"]), F.concat_ws("/", info["duration"], info["timescale"]), info["n_samples"], info["n_keyframes"], ranges).alias("feature"),
        F.when(info["timescale"] > 0, info["duration"] / F.when(info["timescale"] > 0, info["timescale"])).alias("seconds"),
    )
