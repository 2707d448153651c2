"""Token ids in training order: fixed-stride shards filled by a keyed permutation.

A first pass counts each input partition's sequences; prefix sums number all sequences 0 .. N-1.  A keyed Feistel network
over the smallest even power of two that is not below N, walked along its cycle until it lands below N, turns the number
into a slot.  Shard k holds slots k*R .. (k+1)*R-1 as records of one length, so a reader resumes at any slot with one seek.
A second pass makes the same sequences again and sends them, packed by shard, to the task that writes the shard: one
shuffle of compressed token ids, no sort and no sampling.

Record: doc_id int64, sequence int32, tokens int32 (little-endian), then ``length`` ids of uint16 (uint32 for vocabularies
over 65,536), padded with the end id.

Edge cases: white space of any length is cut as the vocabulary's pattern says; each text ends with the end id, so null and
empty texts are one sequence of that id; a null doc_id is stored as -2^63; repeated rows are repeated sequences; very long
texts are as many sequences as they fill; an empty table writes a manifest with N = 0 and no shard; other columns, whatever
their names, are not read.  The input must list its rows in the same order in both passes, as files do.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import arrow, plain, scratch
from ._words import U, chunks, mix
from .archives import filesystem

LENGTH = 256
SHARD = 1 << 16
ROUNDS = 4
NO_ID = -(1 << 63)
LOOK_AHEAD = r"|\s+(?!\S)|\s+"  # how the patterns of such vocabularies end
LONG_SPACE = re.compile(r"[^\S\x1c-\x1f]{4096,}")


# ---------------------------------------------------------------- permutation


def feistel(number: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """Bijection of 0..n-1 for the key (or its inverse)."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    low, rounds = U((1 << half) - 1), [mix(np.array([key * 4 + r + 1], np.int64).view(U))[0] for r in range(ROUNDS)]
    x = number.astype(U)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] >> U(half), x[todo] & low
        for k in reversed(rounds) if inverse else rounds:
            if inverse:
                left, right = right ^ (mix(left ^ k) & low), left
            else:
                left, right = right, left ^ (mix(right ^ k) & low)
        x[todo] = (left << U(half)) | right
        todo = x >= U(n)  # cycle-walking
    return x.astype(np.int64)


# ---------------------------------------------------------------- tokens


class ByteBpe:
    """Ranks file of a byte-level BPE; loaded once a worker."""

    held: dict[tuple, object] = {}

    def __init__(self, path: str, pattern: str, end: int):
        self.path, self.pattern, self.end = path, pattern, end

    def _tokens(self):
        """The library's encoder.

        Its array form searches texts for special tokens; without any it tries every position, so it gets one that is never
        allowed: texts that hold it are encoded like all others.
        """
        import tiktoken

        key = (self.path, self.pattern)
        if key not in self.held:
            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {"<|never allowed|>": max(ranks.values(), default=-1) + 1}
            self.held[key] = tiktoken.Encoding("bytes", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens=special)
        return self.held[key]

    def _ids(self, text: str) -> np.ndarray:
        try:
            return self._tokens().encode_to_numpy(text, allowed_special=set(), disallowed_special=())
        except ValueError:  # the library's look-ahead gives up on white space of some hundred thousand characters
            if not self.pattern.endswith(LOOK_AHEAD) or not LONG_SPACE.search(text):
                raise
            return np.concatenate([np.array(x, np.uint32) for x in self._pieces(text)])

    def _pieces(self, text: str) -> Iterator[np.ndarray | list[int]]:
        """Ids between and of long white space, which is one piece but for its last character before other text."""
        at = 0
        for run in LONG_SPACE.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            yield self._ids(text[at : run.start()])
            yield self._tokens()._encode_single_piece(text[run.start() : end])
            at = end
        yield self._ids(text[at:])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text and the end id."""
        return [np.append(self._ids(x), np.uint32(self.end)) for x in texts]

    def count(self, texts: list[str]) -> list[int]:
        """How many ids :meth:`encode` gives each text."""
        return [1 + len(self._ids(x)) for x in texts]


def default_tokenizer(folder: str | None = None) -> ByteBpe:
    """The 50k byte-level vocabulary; ``folder`` overrides where it lies."""
    import public_tokenizers

    return ByteBpe(f"{folder}/byte_bpe_50k.tiktoken" if folder else public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50256)


def _sequences(part: pa.RecordBatch, tokenizer, length: int, kind: np.dtype) -> np.ndarray:
    """Records of a slice of (doc_id, text), in order."""
    ids = [NO_ID if d is None else d for d in part.column("doc_id").to_pylist()]
    tokens = tokenizer.encode([t or "" for t in part.column("text").to_pylist()])
    size = np.array([len(t) for t in tokens])
    each = -(-size // length)
    out = np.zeros(each.sum(), record_type(length, kind))
    first = np.cumsum(each) - each
    owner = np.repeat(np.arange(len(tokens)), each)
    number = np.arange(len(out)) - first[owner]
    out["doc_id"], out["sequence"] = np.array(ids, np.int64)[owner], number
    out["tokens"] = np.minimum(size[owner] - number * length, length)
    flat = np.full(len(out) * length, tokenizer.end, kind)
    at = np.repeat(first * length - (np.cumsum(size) - size), size) + np.arange(size.sum())
    flat[at] = np.concatenate(tokens)
    out["ids"] = flat.reshape(-1, length)
    return out


def record_type(length: int, kind: np.dtype) -> np.dtype:
    return np.dtype([("doc_id", "<i8"), ("sequence", "<i4"), ("tokens", "<i4"), ("ids", np.dtype(kind).newbyteorder("<"), (length,))])


def write_training_order(documents: DataFrame, folder: str, tokenizer=None, key: int = 1, length: int = LENGTH, shard: int = SHARD, wide: bool = False) -> dict:
    """Write the shards and ``manifest.json`` (returned) for documents (doc_id, text).

    The folder must not hold a finished store (FileExistsError); what a job that died has left there is removed.
    """
    spark = documents.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    kind = np.dtype(np.uint32 if wide else np.uint16)
    rows = plain(documents, "doc_id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for part in chunks(batch):
                n += sum(-(-t // length) for t in tokenizer.count([t or "" for t in part.column("text").to_pylist()]))
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())], ["task", "n"])

    counts = {r[0]: r[1] for r in arrow(rows, count, "task int, n long").collect()}  # one row an input partition
    starts, total = {}, 0
    for task in sorted(counts):
        starts[task] = total
        total += counts[task]
    shards = -(-total // shard)
    record = record_type(length, kind)
    manifest = {"sequences": total, "length": length, "shard": shard, "shards": shards, "stride": record.itemsize, "key": key, "kind": kind.str, "end": tokenizer.end}
    where = spark.sparkContext.broadcast(starts)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = where.value[TaskContext.get().partitionId()]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        squeeze = zstandard.ZstdCompressor(1)

        def flush() -> Iterator[pa.RecordBatch]:
            slots, found = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(slots, kind="stable")
            slots, found = slots[order], found[order]
            cut = np.flatnonzero(np.diff(slots // shard, prepend=-1))
            packed = [squeeze.compress(slots[a:b].tobytes() + found[a:b].tobytes()) for a, b in zip(cut, [*cut[1:], len(slots)], strict=True)]
            yield pa.record_batch([pa.array((slots[cut] // shard).astype(np.int32)), pa.array(np.diff([*cut, len(slots)]).astype(np.int32)), pa.array(packed, pa.binary())], ["shard", "n", "packed"])

        for batch in batches:
            for part in chunks(batch):
                found = _sequences(part, tokenizer, length, kind)
                held.append((feistel(np.arange(at, at + len(found)), total, key), found))
                at += len(found)
                size += found.nbytes
                if size > 48 << 20:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(folder)
        open_, filled = {}, {}
        for batch in batches:
            for k, n, packed in zip(*(batch.column(c) for c in ("shard", "n", "packed")), strict=True):
                k, n, data = k.as_py(), n.as_py(), zstandard.ZstdDecompressor().decompress(packed.as_py())
                if k not in open_:
                    open_[k] = np.zeros(min(shard, total - k * shard), record)
                    filled[k] = 0
                slots = np.frombuffer(data, np.int64, n)
                open_[k][slots - k * shard] = np.frombuffer(data, record, n, offset=8 * n)
                filled[k] += n
        for k, whole in open_.items():
            if filled[k] != len(whole):
                raise ValueError(f"shard {k} has {filled[k]} of {len(whole)} sequences")
            attempt = f"{path}/.{k}-{TaskContext.get().taskAttemptId()}"
            with fs.open_output_stream(attempt) as f:
                f.write(whole.tobytes())
            commit(fs, attempt, shard_path(path, k), whole.nbytes)
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([len(whole)], pa.int64())], ["shard", "n"])

    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    left = [f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.type == pafs.FileType.File]
    if any(f.endswith("/manifest.json") for f in left):
        raise FileExistsError(f"{folder} holds a finished store")
    for f in left:
        fs.delete_file(f)
    if shards:
        packed = arrow(rows, place, "shard int, n int, packed binary").repartitionById(shards, F.col("shard"))
        done = arrow(packed, write, "shard int, n long").agg(F.sum("n"), F.count("*")).first()
        if (done[0], done[1]) != (total, shards):
            raise ValueError(f"{done} of {total} sequences in {shards} shards were written")
    with fs.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def commit(fs: pafs.FileSystem, attempt: str, to: str, size: int) -> None:
    """Give an attempt's file its name.  Attempts of a shard write the same bytes, so one that finds it written is done."""

    def there() -> bool:
        return fs.get_file_info(to).size == size

    if not there():
        try:
            fs.move(attempt, to)
        except OSError:  # another attempt was faster
            if not there():
                raise
    if fs.get_file_info(attempt).type == pafs.FileType.File:
        fs.delete_file(attempt)


def shard_path(path: str, k: int) -> str:
    return f"{path}/shard-{k:08d}.bin"


def read_slots(folder: str, start: int, stop: int) -> np.ndarray:
    """Records of slots start..stop-1, by seeking: how training resumes."""
    fs, path = filesystem(folder)
    with fs.open_input_stream(f"{path}/manifest.json") as f:
        m = json.loads(f.read())
    record, parts = record_type(m["length"], np.dtype(m["kind"])), []
    at, stop = start, min(stop, m["sequences"])
    while at < stop:
        k, inner = divmod(at, m["shard"])
        n = min(stop - at, m["shard"] - inner)
        with fs.open_input_file(shard_path(path, k)) as f:
            f.seek(inner * record.itemsize)
            parts.append(np.frombuffer(f.read(n * record.itemsize), record))
        at += n
    return np.concatenate(parts) if parts else np.zeros(0, record)


def read_training_order(spark: SparkSession, folder: str, manifest: dict, block: int = 8192) -> DataFrame:
    """(slot, shard, doc_id, sequence, n_tokens, tokens_sha256) of every stored record, read back from the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in batch.column("start").to_pylist():
                found = read_slots(folder, a, a + block)
                slots = np.arange(a, a + len(found))
                hashes = [hashlib.sha256(r["ids"][: r["tokens"]].tobytes()).hexdigest() for r in found]
                owner = pa.array(found["doc_id"], mask=found["doc_id"] == NO_ID)
                yield pa.record_batch([pa.array(slots), pa.array((slots // manifest["shard"]).astype(np.int32)), owner, pa.array(found["sequence"]), pa.array(found["tokens"]), pa.array(hashes, pa.string())], ["slot", "shard", "doc_id", "sequence", "n_tokens", "tokens_sha256"])

    starts = spark.range(0, manifest["sequences"], block).select(F.col("id").alias("start"))
    return arrow(starts, run, "slot long, shard int, doc_id long, sequence int, n_tokens int, tokens_sha256 string")


def training_order(documents: DataFrame, **options) -> DataFrame:
    """Write the shards to scratch space and read them back."""
    spark = documents.sparkSession
    folder = scratch(spark, "tokens")
    return read_training_order(spark, folder, write_training_order(documents, folder, **options))
