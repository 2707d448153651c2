"""Media columns: payloads as images in tar archives, read through a data source of byte ranges.

Payloads are stored as 8-bit greyscale PNG images, ``WIDTH`` samples a row, one tar member each.  Beside every archive lies
an index of member offsets.  The data source plans byte ranges over the archives of a folder from file sizes alone, at most
``MOST_RANGES`` partitions of them; a reader loads the indexes of its archives, serves the members that start in its ranges,
and retries each of them by offset.

Edge cases: null and empty texts are one row of padding; repeated rows are repeated members; equal texts have equal values; a
very long text is one member; a null doc_id stays null; a member that still fails after ``TRIES`` reads comes back with null
media and the error's text, and the others of its range are unharmed; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ._shared import arrow, plain, scratch, ship
from .archives import Rolling, filesystem

WIDTH = 576
PAD = b"\xff"
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20  # least bytes of a partition
MOST_RANGES = 50_000
BATCH_BYTES = 4 << 20
TRIES = 3
SIGNATURE = b"\x89PNG\r\n\x1a\n"


# ---------------------------------------------------------------- images


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pad(raw: bytes) -> bytes:
    return raw + PAD * (-len(raw) % WIDTH if raw else WIDTH)


def to_png(payload: bytes) -> bytes:
    """Greyscale image of the payload's bytes; its length is a positive multiple of WIDTH."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with filter 0
    lines[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """Samples of an 8-bit greyscale image without line filters; ValueError on damage."""
    if not media.startswith(SIGNATURE):
        raise ValueError("no PNG")
    at, data, size = len(SIGNATURE), [], None
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.pack(">I", zlib.crc32(kind + body)) != media[at + 8 + n : at + 12 + n]:
            raise ValueError(f"{kind!r} is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not 8-bit greyscale")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("line filters are not supported")
    return lines[:, 1:]


def feature(image: np.ndarray) -> str:
    """Size, mean, deviation, entropy in bits, and a 64-bit average hash over an 8 x 8 grid."""
    n = image.size
    counts = np.bincount(image.reshape(-1), minlength=256)
    value = np.arange(256)
    mean = float((counts * value).sum()) / n
    deviation = (float((counts * value * value).sum()) / n - mean * mean) ** 0.5
    p = counts[counts > 0] / n
    entropy = float(-(p * np.log2(p)).sum()) + 0.0
    grid = np.array([[cell.mean() for cell in np.array_split(band, 8, 1)] if band.size else [mean] * 8 for band in np.array_split(image, 8, 0)])
    bits = "".join("1" if x > mean else "0" for x in grid.reshape(-1))
    return f"{image.shape[1]}x{image.shape[0]};mean={mean:.4f};std={deviation:.4f};entropy={entropy:.4f};ahash={int(bits, 2):016x}"


# ---------------------------------------------------------------- archives


def _member(name: str, media: bytes) -> bytes:
    info = tarfile.TarInfo(name)
    info.size = len(media)
    return info.tobuf(tarfile.USTAR_FORMAT) + media + b"\0" * (-len(media) % 512)


def write_media(documents: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Store every text of documents (doc_id, text); member names are ``<n_bytes>/<doc_id>.png``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, offsets, written = Rolling(folder, ".tar", archive_bytes), [], []

        def close() -> None:
            if out.out is not None:
                out.close(b"\0" * 1024)
                with out.fs.open_output_stream(f"{out.path}/{out.name}.idx") as index:
                    index.write(np.array(offsets, np.int64).tobytes())
                written.append(out.files[-1])
                offsets.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                offsets.append(out.add(_member(f"{len(raw)}/{doc_id.as_py()}.png", to_png(pad(raw)))))
                if out.full:
                    close()
        close()
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*written, strict=True) if written else ((), (), ()), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["uri", "bytes", "members"])

    to = f"{folder.rstrip('/')}/_manifest"
    arrow(plain(documents, "doc_id", "text"), run, "uri string, bytes long, members long").write.parquet(to)


@dataclass
class ByteRanges(InputPartition):
    parts: list[tuple[str, int, int]]  # (uri, start, end)


class TarRanges(DataSource):
    """``spark.read.format("tar_ranges").option("files", "uri:bytes ...")`` or ``.load(folder with a manifest)``."""

    @classmethod
    def name(cls) -> str:
        return "tar_ranges"

    def schema(self) -> str:
        return "uri string, offset long, name string, media binary, error string"

    def reader(self, schema) -> TarRangesReader:
        return TarRangesReader(dict(self.options))


class TarRangesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"].rstrip("/")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[ByteRanges]:
        import pyarrow.parquet as pq

        fs, path = filesystem(f"{self.folder}/_manifest")
        files = pq.read_table(path, filesystem=fs, columns=["uri", "bytes"])
        return [ByteRanges(r) for r in plan_ranges(list(zip(files["uri"].to_pylist(), files["bytes"].to_pylist(), strict=True)), self.range_bytes)] or [ByteRanges([])]

    def read(self, partition: ByteRanges) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for uri, start, end in partition.parts:
            for offset in member_offsets(uri, start, end):
                rows.append((uri, offset, *read_member(uri, offset)))
                size += len(rows[-1][3] or b"")
                if size >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        yield _batch(rows)


def plan_ranges(files: list[tuple[str, int]], least: int, most: int = MOST_RANGES) -> list[list[tuple[str, int, int]]]:
    """Partitions of byte ranges that cover all files: of ``least`` bytes, or of as many as leave about ``most`` partitions."""
    size = max(least, -(-sum(n for _, n in files) // most))
    out, held = [], 0
    for uri, n in files:
        at = 0
        while at < n:
            if not out or held >= size:
                out.append([])
                held = 0
            to = min(n, at + size - held)
            out[-1].append((uri, at, to))
            held += to - at
            at = to
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string())
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["uri", "offset", "name", "media", "error"])


def member_offsets(uri: str, start: int, end: int) -> list[int]:
    fs, path = filesystem(f"{uri}.idx")
    with fs.open_input_stream(path) as f:
        at = np.frombuffer(f.read(), np.int64)
    return at[np.searchsorted(at, start) : np.searchsorted(at, end)].tolist()


_open: dict[str, object] = {}


def read_member(uri: str, offset: int, tries: int = TRIES) -> tuple[str | None, bytes | None, str | None]:
    """(name, media, error) of the member at an offset; each try after a failure opens the archive again."""
    error = None
    for _ in range(tries):
        try:
            f = _open.get(uri)
            if f is None:
                _open.clear()
                fs, path = filesystem(uri)
                f = _open[uri] = fs.open_input_file(path)
            f.seek(offset)
            info = tarfile.TarInfo.frombuf(f.read(512), "utf-8", "surrogateescape")
            media = f.read(info.size)
            if len(media) != info.size:
                raise OSError("archive ends within the member")
            return info.name, media, None
        except (OSError, tarfile.TarError) as e:
            _open.clear()
            error = f"{type(e).__name__}: {e}"
    return None, None, error


def read_media(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(uri, offset, name, media, error) of all members of the folder's archives."""
    ship(spark)
    spark.dataSource.register(TarRanges)
    return spark.read.format("tar_ranges").option("rangeBytes", range_bytes).load(folder)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for name, media, error in zip(*(batch.column(c) for c in ("name", "media", "error")), strict=True):
            if error.as_py() is not None:
                raise OSError(error.as_py())
            stored = media.as_py()
            image = from_png(stored)
            payload = image.tobytes()
            n_bytes, _, doc = name.as_py().removesuffix(".png").partition("/")
            rows.append((None if doc == "None" else int(doc), int(n_bytes), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(image)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [f.split()[0] for f in FEATURES.split(", ")])


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(documents: DataFrame) -> DataFrame:
    """Store every text, read the stored bytes back, and describe them (columns of FEATURES)."""
    spark = documents.sparkSession
    folder = scratch(spark, "media")
    write_media(documents, folder)
    return arrow(read_media(spark, folder).select("name", "media", "error"), _features, FEATURES)
