"""Language identification with language-bitmask n-gram filters.

The filter is a bit-sliced Bloom filter: slots of one or more 64-bit masks, a bit a language; an n-gram belongs to the
languages whose bits are set at all of its ``PROBES`` slots, so one AND of masks answers for 64 languages at a time.  A
text's score for a language is the popcount of its n-grams, corrected for that language's false-positive rate (its fill to
the power of the probes); the best corrected share decides.

Learning counts byte 4-grams by language over all training texts (partial counts leave each task) and sets a language's bit
for the n-grams that make up at least ``RATE`` of that language's n-grams, and whose rate there is at least ``TYPICAL`` times
the mean of their rates over all languages.  So a language keeps at most 1 / RATE n-grams, however large the input is, and
related languages may share as many n-grams as they like.  The filter is sized from the most n-grams that a language keeps;
its masks are ORed by slot in Spark, and what reaches the driver is at most ``MOST_SLOTS`` masks for each 64 languages.

Edge cases: ``und`` with score 0 if the text is null or has no letter, and for every text when nothing could be learned;
a text of which no n-gram is known gets the most frequent learned language with score 0; ties go to the language that is
first in order; any number of languages is learned; very long texts are read whole; repeated rows count, and are predicted,
each; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow, crc_bucket, delete, plain, table
from ._words import U, buffers, chunks, mix

PROBES = 3
TYPICAL = 1.6
RATE = 3e-6
LEAST_SLOTS, MOST_SLOTS = 1 << 20, 1 << 22
ROOM = 4  # slots for each n-gram of the language with most of them

_LETTER = np.full(256, 32, np.uint8)  # what is no letter becomes a blank
for _c in range(256):
    if 65 <= _c <= 90:
        _LETTER[_c] = _c + 32
    elif 97 <= _c <= 122 or _c >= 128:
        _LETTER[_c] = _c


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(4-gram as uint32, text number); runs of blanks count once, n-grams of blanks alone don't count."""
    raw, at = buffers(texts)
    b = _LETTER[raw]
    # UTF-8 of capital Latin-1 letters: 0xC3 0x80..0x9E; fold them as well
    if len(b) > 1:
        up = np.flatnonzero((b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] <= 0x9E) & (b[1:] != 0x97)) + 1
        b[up] += 0x20
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    edge = np.zeros(len(b), bool)
    edge[at[:-1][at[:-1] < len(b)]] = True
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32) | edge[1:]
    b, doc = b[keep], doc[keep]
    if len(b) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    w = b.astype(np.uint32)
    g = (w[:-3] << 24) | (w[1:-2] << 16) | (w[2:-1] << 8) | w[3:]
    whole = doc[:-3] == doc[3:]
    return g[whole], doc[:-3][whole]


def probes(gram: np.ndarray, slots: int) -> list[np.ndarray]:
    """Slots of each n-gram; ``slots`` is a power of two.  The second hash steps from the first, as filters of any size need."""
    h = mix(gram.astype(U) + U(0x9E3779B97F4A7C15))
    step = (h >> U(32)) | U(1)
    with np.errstate(over="ignore"):
        return [((h + U(i) * step) & U(slots - 1)).astype(np.int64) for i in range(PROBES)]


def _counted(rows: DataFrame) -> DataFrame:
    """(lang, gram, n): partial counts of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = defaultdict(list)
        pending = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in sums.items():
                g, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                g, inverse = np.unique(g, return_inverse=True)
                yield pa.record_batch([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(np.bincount(inverse, n).astype(np.int64))], ["lang", "gram", "n"])
            sums.clear()

        for batch in batches:
            for part in chunks(batch):
                g, doc = grams(part.column("text"))
                coded = part.column("lang").dictionary_encode()
                code = coded.indices.to_numpy(zero_copy_only=False)[doc]
                for i, lang in enumerate(coded.dictionary.to_pylist()):
                    found, n = np.unique(g[code == i], return_counts=True)
                    sums[lang].append((found, n))
                    pending += len(found)
                if pending > 4_000_000:
                    yield from flush()
                    pending = 0
        yield from flush()

    return arrow(rows, run, "lang string, gram long, n long")


def learn(rows: DataFrame, typical: float = TYPICAL, rate: float = RATE) -> dict:
    """Filter from rows (text, lang)."""
    rows = rows.where("text is not null and lang is not null")
    counts, path = table(_counted(rows).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}  # one row a language
    langs = sorted(totals)
    if not langs:
        return {"langs": [], "masks": np.zeros((1, LEAST_SLOTS), U), "fill": np.zeros(0), "common": "und"}
    known = rows.sparkSession.createDataFrame([(k, i, float(totals[k])) for i, k in enumerate(langs)], "lang string, number int, total double")
    rated = counts.join(F.broadcast(known), "lang").select("number", "gram", (F.col("n") / F.col("total")).alias("r"))
    # grams go to languages where they are typical; one row a gram, so a hot language spreads over all tasks
    grouped = rated.groupBy("gram").agg(F.sum("r").alias("all"), F.collect_list(F.struct("number", "r")).alias("of"))
    share = min(1.0, typical / len(langs)) * (1 - 1e-9)
    chosen = grouped.select("gram", F.explode(F.filter("of", lambda x: (x["r"] >= share * F.col("all")) & (x["r"] >= rate))).alias("x")).select("gram", "x.number")
    chosen, chosen_path = table(chosen, "chosen")
    most = chosen.groupBy("number").count().agg(F.max("count")).first()[0] or 0
    slots = min(max(LEAST_SLOTS, 1 << (ROOM * most).bit_length()), MOST_SLOTS)
    bit = F.expr("shiftleft(1L, number % 64)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(probes(np.asarray(batch.column("gram")).astype(np.uint32), slots))
            word, mask = (np.tile(np.asarray(batch.column(c)), PROBES) for c in ("word", "mask"))
            yield pa.record_batch([pa.array(word), pa.array(at.astype(np.int32)), pa.array(mask)], ["word", "slot", "mask"])

    gram_masks = chosen.groupBy("gram", F.expr("cast(number div 64 as int)").alias("word")).agg(F.bit_or(bit).alias("mask"))
    sliced = arrow(gram_masks, run, "word int, slot int, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask"))
    masks = np.zeros((-(-len(langs) // 64), slots), U)
    got = sliced.toPandas()  # at most MOST_SLOTS rows for each 64 languages
    masks[got["word"].to_numpy(), got["slot"].to_numpy()] = got["mask"].to_numpy().astype(np.int64).view(U)
    for p in (path, chosen_path):
        delete(rows.sparkSession, p)
    fill = np.array([float(((masks[i // 64] >> U(i % 64)) & U(1)).sum()) / slots for i in range(len(langs))])
    return {"langs": langs, "masks": masks, "fill": fill, "common": max(langs, key=lambda k: (totals[k], k))}


def predict(texts: pa.Array, model: dict) -> tuple[list[str], np.ndarray]:
    docs, langs = len(texts), model["langs"]
    letters = np.array([x is not None and any(map(str.isalpha, x)) for x in texts.to_pylist()], bool)
    if not langs:
        return ["und"] * docs, np.zeros(docs)
    g, doc = grams(texts)
    at = probes(g, model["masks"].shape[1])
    n = np.bincount(doc, minlength=docs)
    share = np.zeros((docs, len(langs)))
    for word, slots in enumerate(model["masks"]):
        mask = np.full(len(g), ~U(0))
        for a in at:
            mask &= slots[a]
        for i in range(64 * word, min(64 * word + 64, len(langs))):
            false = model["fill"][i] ** PROBES
            hits = np.bincount(doc, ((mask >> U(i % 64)) & U(1)).astype(np.float64), docs)
            share[:, i] = np.maximum(hits - n * false, 0) / (np.maximum(n, 1) * max(1 - false, 1e-9))
    best, total = share.argmax(1), share.sum(1)
    score = np.where(total > 0, share[np.arange(docs), best] / np.maximum(total, 1e-12), 0)
    names = [("und" if not ok else langs[b] if t > 0 else model["common"]) for ok, b, t in zip(letters, best, total, strict=True)]
    return names, np.where(letters, np.clip(score, 0, 1), 0)


def identify(documents: DataFrame, held_out_modulus: int = 4, held_out_rest: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; held-out rows are never learned from."""
    out = F.coalesce(crc_bucket("doc_id", held_out_modulus) == held_out_rest, F.lit(False))
    model = learn(plain(documents.where(~out), "text", "lang"))
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                names, score = predict(part.column("text"), held.value)
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = plain(documents, "doc_id", "text").withColumn("held_out", out)
    return arrow(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")
