"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics come from one pass over the whole texts and are kept as a narrow table.  Training joins them with the labels;
every task adds up its part of the normal equations (Z'Z, Z'y), parts are added in two levels, and the driver solves one
(D+1) x (D+1) system whatever the input size.  Raw scores of a held-back fifth of the training rows, counted in
``BINS`` bins, give the isotonic map by pool-adjacent-violators.

Edge cases: null and empty texts have zero statistics and get a score like any other; labels that are null, not 0 or 1,
or without a document are ignored; several labels of one document count as their mean; without usable labels, or with
labels of one kind, every score is the share of label 1 (0.5 without labels); repeated documents are scored each; very long
texts are read whole; equal texts have equal scores, and ties in the raw score share a block; other columns are not read, or
stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import arrow, crc_bucket, delete, plain, table
from ._words import U, Words, buffers, chunks, mix, split_words

FEATURES = 256
WIDTH = 3.0
RIDGE = 1.0
BINS = 2048
SEED = 20240131
PARTS = 16

# Byte classes whose shares are statistics.
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n\r", b".,;:", b"!", b"?", b"|", b"#$%&*+<=>@^_~\\/{}[]", b"\"'()-"]
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _i, _set in enumerate(_CLASSES):
    _CLASS[np.frombuffer(_set, np.uint8)] = _i
N_STATS = 2 * (len(_CLASSES) + 1) + 9


def statistics(texts: pa.Array) -> np.ndarray:
    """[texts, N_STATS] float32: shares of byte classes and of class changes, word lengths, and repetition."""
    raw, at = buffers(texts)
    docs, kinds = len(at) - 1, len(_CLASSES) + 1
    size = np.diff(at)
    doc = np.repeat(np.arange(docs), size)
    kind = _CLASS[raw]
    counts = np.bincount(doc * kinds + kind, minlength=docs * kinds).reshape(docs, kinds)
    starts = np.ones(len(raw), bool)
    starts[1:] = (kind[1:] != kind[:-1]) | (doc[1:] != doc[:-1])
    runs = np.bincount(doc[starts] * kinds + kind[starts], minlength=docs * kinds).reshape(docs, kinds)
    words = split_words(texts)
    n = np.diff(words.first)
    some, many = np.maximum(size, 1), np.maximum(n, 1)
    same = np.zeros(docs)
    if len(words.hash) > 1:
        again = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
        same = np.bincount(words.doc[1:][again], minlength=docs)
    apart = _distinct(words, docs)
    three = _distinct(_grams(words), docs)
    letters = np.maximum(counts[:, 0] + counts[:, 1] + counts[:, -1], 1)
    out = np.concatenate(
        [
            counts / some[:, None],
            runs / some[:, None],
            np.stack(
                [np.log1p(size), np.log1p(n), size / many / 10, apart / many, three / many, same / many, counts[:, 0] / letters, counts[:, 4] / many, runs[:, 0] / many],
                1,
            ),
        ],
        1,
    )
    return out.astype(np.float32)


def _grams(words: Words) -> Words:
    h = words.hash.copy()
    with np.errstate(over="ignore"):
        for k in (1, 2):
            h[:-k] = mix(h[:-k] * U(0x9E3779B97F4A7C15) + words.hash[k:])
    return Words(h, words.doc, words.first)


def _distinct(words: Words, docs: int) -> np.ndarray:
    key = np.sort((words.doc.astype(U) << U(40)) | (words.hash >> U(24)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.bincount((key[new] >> U(40)).astype(np.int64), minlength=docs)


def describe(documents: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """The columns ``keep`` and ``stats`` (array of float) for every row."""
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text):
                flat = statistics(part.column(text))
                lists = pa.ListArray.from_arrays(pa.array((np.arange(part.num_rows + 1) * N_STATS).astype(np.int32)), pa.array(flat.reshape(-1)))
                yield pa.record_batch([*(part.column(c) for c in names), lists], [*names, "stats"])

    df = plain(documents, *names, text)
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes[:-1])
    return arrow(df, run, f"{kinds}, stats array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _features(stats: np.ndarray, model: dict) -> np.ndarray:
    z = np.sqrt(2 / len(model["shift"])) * np.cos((stats - model["mean"]) / model["scale"] @ model["direction"] + model["shift"])
    return np.concatenate([z, np.ones((len(z), 1))], 1)


def _added(df: DataFrame, width: int, what) -> np.ndarray:
    """Sum over all rows of the vectors that ``what(batch)`` gives, in two levels of partial sums."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += what(batch)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_py())
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = arrow(df, part, "part binary").repartition(PARTS)
    return sum((np.frombuffer(r[0]) for r in arrow(parts, add, "part binary").collect()), np.zeros(width))


def isotonic(x: np.ndarray, positives: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit to positives/total over ascending x (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for at, p, n in zip(x, positives, total, strict=True):
        if n:
            blocks.append([at * n, p, n])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks])


def fit(training: DataFrame, features: int = FEATURES, seed: int = SEED) -> dict:
    """Model from rows (key, stats, y); ``key`` only tells calibration rows (a fifth) from the others."""
    stats = N_STATS
    fold = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(5)) == 0

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x, y = _matrix(batch.column("stats")), np.asarray(batch.column("y"))
        return np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)])

    m = _added(training.select("stats", "y"), 2 + 2 * stats, moments)
    n, positive = m[0], m[1]
    rng = np.random.default_rng(seed)
    mean = m[2 : 2 + stats] / max(n, 1)
    scale = np.sqrt(np.maximum(m[2 + stats :] / max(n, 1) - mean**2, 0)) + 1e-3
    model = {
        "mean": mean, "scale": scale, "direction": rng.normal(size=(stats, features)) / (WIDTH * np.sqrt(stats)), "shift": rng.uniform(0, 2 * np.pi, features),
        "weights": np.zeros(features + 1), "knots": np.array([0.0]), "values": np.array([positive / n if n else 0.5]),
    }
    if not 0 < positive < n:
        return model
    size = features + 1

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        z, y = _features(_matrix(batch.column("stats")), model), np.asarray(batch.column("y"))
        # both kinds of label weigh the same
        w = np.where(y >= 0.5, 0.5 / positive, 0.5 / (n - positive)) * n
        return np.concatenate([((z * w[:, None]).T @ z).reshape(-1), z.T @ (w * (2 * y - 1))])

    e = _added(training.where(~fold).select("stats", "y"), size * size + size, equations)
    penalty = RIDGE * np.eye(size)
    penalty[-1, -1] = 0
    model["weights"] = np.linalg.solve(e[: size * size].reshape(size, size) + penalty, e[size * size :])

    def histogram(batch: pa.RecordBatch) -> np.ndarray:
        raw, y = _raw(_matrix(batch.column("stats")), model), np.asarray(batch.column("y"))
        place = np.clip(((raw + 2) / 4 * BINS).astype(np.int64), 0, BINS - 1)
        return np.concatenate([np.bincount(place, y, BINS), np.bincount(place, minlength=BINS)])

    h = _added(training.where(fold).select("stats", "y"), 2 * BINS, histogram)
    if h[BINS:].sum():
        model["knots"], model["values"] = isotonic((np.arange(BINS) + 0.5) / BINS * 4 - 2, h[:BINS], h[BINS:])
    return model


def _raw(stats: np.ndarray, model: dict) -> np.ndarray:
    return _features(stats, model) @ model["weights"]


def score(stats: np.ndarray, model: dict) -> np.ndarray:
    """Calibrated probability of label 1; linear between the isotonic blocks, plus a trace of the raw score for ties."""
    raw = _raw(stats, model)
    if len(model["knots"]) < 2:
        return np.full(len(raw), model["values"][0])
    p = np.interp(raw, model["knots"], model["values"])
    return np.clip(0.998 * p + 0.002 / (1 + np.exp(-2 * raw)), 0, 1)


def _scored(described: DataFrame, model: dict) -> DataFrame:
    held = described.sparkSession.sparkContext.broadcast(model)
    names = [c for c in described.columns if c != "stats"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = score(_matrix(batch.column("stats")), held.value) if batch.num_rows else np.zeros(0)
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(p)], [*names, "score"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in described.dtypes if c != "stats")
    return arrow(described, run, f"{kinds}, score double")


def training_rows(described: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """(key, stats, y) of labelled documents for which ``learn`` (over doc_id) holds."""
    marks = plain(labels, "doc_id", "quality").where("quality in (0, 1)").where(learn).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    return described.join(marks, "doc_id").select(F.col("doc_id").alias("key"), "stats", "y")


def score_quality(documents: DataFrame, labels: DataFrame, held_out_modulus: int = 3, held_out_rest: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; rows with the held-out crc32 remainder are never learned from."""
    out = F.coalesce(crc_bucket("doc_id", held_out_modulus) == held_out_rest, F.lit(False))
    described, _ = table(describe(documents, "text", "doc_id"), "stats")
    rows, path = table(training_rows(described, labels, ~out), "training")
    model = fit(rows)
    delete(rows.sparkSession, path)
    return _scored(described, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, source: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows of ``documents`` whose score reaches the threshold, with all columns, for a model learned on ``source``.

    The texts are scored where they are read, and only statistics meet the labels: texts are never shuffled.
    """
    out = F.coalesce(crc_bucket("doc_id", 3) == 1, F.lit(False))
    rows, path = table(training_rows(describe(plain(source, "doc_id", "text").where(~out), "text", "doc_id"), labels, ~out), "training")
    model = fit(rows)
    delete(rows.sparkSession, path)
    held = documents.sparkSession.sparkContext.broadcast(model)
    text = [c.lower() for c in documents.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in chunks(pa.record_batch([batch.column(text)], ["text"])):
                good = score(statistics(part.column(0)), held.value) >= threshold
                yield batch.slice(at, part.num_rows).filter(pa.array(good))
                at += part.num_rows

    return arrow(documents, run, documents.schema)
