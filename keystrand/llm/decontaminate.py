"""Benchmark decontamination with suffix arrays over training shards.

Each Arrow chunk of whole documents is one shard.  Its suffix array holds the word positions at which a benchmark window
can start (first word and first word pair occur in the benchmark; any other suffix cannot match), sorted by their first
``window`` words.  Every distinct benchmark suffix of ``window`` words is binary-searched in every shard; the slots found
are the verbatim occurrences.  A document lives in one shard, so nothing is shuffled and no group meets in one task.

A chunk looks only at the benchmark windows whose first words occur in it, so its work follows the chunk and not the
benchmark.  Benchmarks are built into blocks of at most ``block_bytes`` of text by tasks of their own, written to shared
storage and loaded by the workers, which hold a bounded number of bytes of them; nothing of a benchmark passes the driver.

Edge cases: null and wordless texts have no words and are never contaminated; a benchmark item without words is ignored;
an item with fewer words than the window is one shorter window; repeated documents give repeated rows; repeated items
(same id) count once; rows without an item id are ignored; a very long text is a chunk by itself; of equally long longest
matches the first in the document counts, then the least item; other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow, plain, scratch
from ._words import CHUNK_BYTES, U, chunks, mix, split_words
from .archives import filesystem

WINDOW = 8
BLOCK_BYTES = 8 << 20
HELD_BYTES = 384 << 20  # blocks a worker keeps
HEAD = 4  # words by which windows are looked up
_FILTER_BITS = (20, 26)
_PLACES = 2_000_000  # pairs of a hit and its place in an item that are extended at once, or one document's
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items array<long>, longest_match long, items_sha256 string, match_item long, match_start long"


@dataclass
class Block:
    """Distinct windows of some benchmark items, in suffix order."""

    vocabulary: np.ndarray  # sorted word hashes; a word's id is its place + 1
    keys: np.ndarray  # [windows, window] word ids, 0 after a short window's end
    length: np.ndarray
    items_at: np.ndarray  # items of window i: items[items_at[i]:items_at[i+1]]
    items: np.ndarray
    places_at: np.ndarray  # places of window i: rows places_at[i]:places_at[i+1] of the next two
    text: np.ndarray  # number of the item's text
    offset: np.ndarray  # first word in it
    ids: np.ndarray  # item of each text
    heads: np.ndarray  # sorted hashes of the windows' first HEAD words
    head_of: np.ndarray  # the window of each
    head_words: np.ndarray  # how many words these are, of all windows
    words: np.ndarray  # filter over word hashes
    starts: np.ndarray  # filter over first words and word pairs

    @property
    def nbytes(self) -> int:
        return sum(getattr(self, f.name).nbytes for f in fields(self))


def _slot(x: np.ndarray, size: int) -> np.ndarray:
    return (x >> U(65 - size.bit_length())).astype(np.int64)


def _filter(x: np.ndarray) -> np.ndarray:
    low, high = _FILTER_BITS
    out = np.zeros(1 << min(max(low, (16 * len(x)).bit_length()), high), bool)
    out[_slot(x, len(out))] = True
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a * U(0x9E3779B97F4A7C15) + b)


def _head(ids: np.ndarray, words: int = HEAD) -> np.ndarray:
    """Hash of the first ``words`` ids of each row, as if zeros followed."""
    out = np.zeros(len(ids), U)
    for k in range(min(HEAD, ids.shape[1])):
        out = _pair(out, ids[:, k].astype(U) if k < words else np.zeros(len(ids), U))
    return out


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, and the number of each row among them."""
    order = np.lexsort(rows.T[::-1])
    ordered = rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(1)
    which = np.empty(len(rows), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], which


def build_block(item_ids: list[int], texts: list[str | None], window: int = WINDOW) -> Block:
    words = split_words(pa.array(texts, pa.string()))
    vocabulary, ids = np.unique(words.hash, return_inverse=True)
    ids = np.append(ids + 1, np.zeros(window, np.int64)).astype(np.int32)
    count = np.diff(words.first)
    each = np.where(count >= window, count - window + 1, (count > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(count)), each)
    at = words.first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    size = np.minimum(count[owner], window)
    keys, which = _distinct(ids[at[:, None] + np.arange(window)] * (np.arange(window) < size[:, None]))
    pairs, _ = _distinct(np.stack([which, np.asarray(item_ids, np.int64)[owner]], 1))
    by = np.argsort(which, kind="stable")
    hashes = np.append(words.hash, np.zeros(1, U))
    starts = np.where(size > 1, _pair(hashes[at], hashes[np.minimum(at + 1, len(words.hash))]), hashes[at])
    heads = _head(keys)
    head_of = np.argsort(heads, kind="stable")
    return Block(
        vocabulary, keys, (keys > 0).sum(1), np.searchsorted(pairs[:, 0], np.arange(len(keys) + 1)), pairs[:, 1],
        np.searchsorted(which[by], np.arange(len(keys) + 1)), owner[by], (at - words.first[owner])[by], np.asarray(item_ids, np.int64),
        heads[head_of], head_of, np.unique(np.minimum((keys > 0).sum(1), HEAD)), _filter(vocabulary), _filter(np.unique(starts)),
    )


def save_block(block: Block, folder: str) -> str:
    """Write a block under a name of its own; the URI."""
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    name, out = uuid.uuid4().hex, io.BytesIO()
    np.savez(out, **{f.name: getattr(block, f.name) for f in fields(block)})
    with fs.open_output_stream(f"{path}/{name}.npz") as f:
        f.write(out.getbuffer())
    return f"{folder.rstrip('/')}/{name}.npz"


_held: OrderedDict[str, Block] = OrderedDict()


def load_block(block: str | Block) -> Block:
    """A block by its URI; a worker keeps the last ones, up to HELD_BYTES or one."""
    if isinstance(block, Block):
        return block
    if block not in _held:
        fs, path = filesystem(block)
        with fs.open_input_stream(path) as f:
            arrays = np.load(io.BytesIO(f.read()))
            _held[block] = Block(**{f.name: arrays[f.name] for f in fields(Block)})
        while len(_held) > 1 and sum(b.nbytes for b in _held.values()) > HELD_BYTES:
            _held.popitem(last=False)
    _held.move_to_end(block)
    return _held[block]


def _bisect(sorted_keys: np.ndarray, probes: np.ndarray, right: bool) -> np.ndarray:
    """searchsorted for rows of words, for all probes at once."""
    low, high = np.zeros(len(probes), np.int64), np.full(len(probes), len(sorted_keys), np.int64)
    while (open_ := low < high).any():
        middle = np.minimum((low + high) >> 1, len(sorted_keys) - 1)
        here = sorted_keys[middle]
        differs = here != probes
        column = differs.argmax(1)
        row = np.arange(len(probes))
        less = (here[row, column] < probes[row, column]) | (~differs.any(1) if right else False)
        low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
    return low


def occurrences(hashes: np.ndarray, text_end: np.ndarray, block: Block, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(word position, window number) of every occurrence; text_end: for each word, the number of its text's last word + 1."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    known = block.words[_slot(hashes, len(block.words))]
    position = np.flatnonzero(known)
    if not len(position) or not len(block.keys):
        return none
    place = np.minimum(np.searchsorted(block.vocabulary, hashes[position]), len(block.vocabulary) - 1)
    ids = np.zeros(len(hashes) + window, np.int32)
    ids[position] = np.where(block.vocabulary[place] == hashes[position], place + 1, 0)
    following = np.append(hashes[1:], U(0))
    position = position[ids[position] > 0]
    bits = len(block.starts)
    may = block.starts[_slot(hashes[position], bits)] | block.starts[_slot(_pair(hashes[position], following[position]), bits)]
    position = position[may]
    # the suffix array of this shard: suffixes cut after `window` words, at the text's end and at the first unknown word
    offsets = np.arange(window)
    suffix = ids[position[:, None] + offsets] * ((position[:, None] + offsets) < text_end[position][:, None])
    suffix *= np.logical_and.accumulate(suffix > 0, axis=1)
    order = np.lexsort(suffix.T[::-1])
    position, suffix = position[order], suffix[order]
    if not len(position):
        return none
    # test suffixes whose first words occur in the shard; short ones end in zeros
    heads = np.unique(np.concatenate([_head(suffix, int(n)) for n in block.head_words]))
    left, right = np.searchsorted(block.heads, heads, "left"), np.searchsorted(block.heads, heads, "right")
    asked = np.sort(block.head_of[_ranges(left, right)])
    keys = block.keys[asked]
    top = np.where(keys > 0, keys, np.int32(2**31 - 1))
    low, high = _bisect(suffix, keys, False), _bisect(suffix, top, True)
    found = np.flatnonzero(high > low)
    slot = _ranges(low[found], high[found])
    return position[slot], np.repeat(asked[found], high[found] - low[found])


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """low[0] .. high[0]-1, low[1] .. high[1]-1, and so on."""
    n = high - low
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def _extend(at: np.ndarray, which: np.ndarray, doc: np.ndarray, block: Block, longest: np.ndarray, start: np.ndarray, item: np.ndarray) -> None:
    """Longest match of each document with one item's text: hits whose places in that text move on as they do, joined.

    Of equal lengths the first in the document counts, then the least item; all three results are updated in place.
    """
    order = np.argsort(at, kind="stable")
    at, which, doc = at[order], which[order], doc[order]
    n = block.places_at[which + 1] - block.places_at[which]
    ends = np.append(np.flatnonzero(doc[1:] != doc[:-1]) + 1, len(doc))
    upto = np.cumsum(n)
    low = 0
    while low < len(at):
        high = ends[max(np.searchsorted(upto[ends - 1], (upto[low - 1] if low else 0) + _PLACES, "right") - 1, np.searchsorted(ends, low, "right"))]
        size = n[low:high]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(block.places_at[which[low:high]], size)
        a, d, w = (np.repeat(x[low:high], size) for x in (at, doc, block.length[which]))
        text, shift = block.text[place], a - block.offset[place]
        order = np.lexsort((a, shift, text))
        a, d, w, text, shift = (x[order] for x in (a, d, w, text, shift))
        link = np.zeros(len(a), bool)
        link[1:] = (text[1:] == text[:-1]) & (shift[1:] == shift[:-1]) & (a[1:] == a[:-1] + 1) & (d[1:] == d[:-1])
        head = a[np.maximum.accumulate(np.where(link, 0, np.arange(len(a))))]
        length, owner = a - head + w, block.ids[text]
        order = np.lexsort((owner, head, -length, d))
        first = order[np.append(True, d[order][1:] != d[order][:-1])]
        of, length, head, owner = d[first], length[first], head[first], owner[first]
        better = (length > longest[of]) | ((length == longest[of]) & ((head < start[of]) | ((head == start[of]) & (owner < item[of]))))
        of = of[better]
        longest[of], start[of], item[of] = length[better], head[better], owner[better]
        low = high


def _search(batch: pa.RecordBatch, blocks: list, window: int) -> pa.RecordBatch:
    words = split_words(batch.column("text"))
    docs = batch.num_rows
    n_words = np.diff(words.first)
    text_end = np.repeat(words.first[1:], n_words)
    edge = np.zeros(len(words.hash) + 1, np.int64)
    owners, items = [], []
    longest, start, item = (np.zeros(docs, np.int64) for _ in range(3))
    for block in map(load_block, blocks):
        at, which = occurrences(words.hash, text_end, block, window)
        if not len(at):
            continue
        size = block.length[which]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + size, -1)
        doc = words.doc[at]
        n = block.items_at[which + 1] - block.items_at[which]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        owners.append(np.repeat(doc, n))
        items.append(block.items[np.repeat(block.items_at[which], n) + inner])
        _extend(at, which, doc, block, longest, start, item)
    hit = np.append(0, np.cumsum(np.cumsum(edge)[:-1] > 0))
    n_hit = hit[words.first[1:]] - hit[words.first[:-1]]
    pairs = np.unique(np.stack([np.concatenate(owners), np.concatenate(items)], 1), axis=0) if owners else np.zeros((0, 2), np.int64)
    at = np.searchsorted(pairs[:, 0], np.arange(docs + 1))
    found = [pairs[a:b, 1] for a, b in zip(at[:-1], at[1:], strict=True)]
    digest = [hashlib.sha256(",".join(sorted(map(str, x.tolist()))).encode()).hexdigest() for x in found]
    return pa.record_batch(
        [batch.column("doc_id"), pa.array(n_words), pa.array(n_hit), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(pairs[:, 1])), pa.array(longest), pa.array(digest, pa.string()), pa.array(item, mask=longest == 0), pa.array(start - words.first[:-1], mask=longest == 0)],
        ["doc_id", "n_words", "n_hit", "n_items", "items", "longest_match", "items_sha256", "match_item", "match_start"],
    )


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> list[str]:
    """The benchmark as blocks of at most ``block_bytes`` of text (or one longer item), built by tasks: their URIs, one for each block."""
    spark = benchmark.sparkSession
    rows = plain(benchmark, "item_id", "text").where("item_id is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes)
    rows = rows.repartition(n) if n > 1 else rows.coalesce(1)
    folder = scratch(spark, "benchmark")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def close() -> pa.RecordBatch:
            return pa.record_batch([pa.array([save_block(build_block(ids, texts, window), folder)] if ids else [], pa.string())], ["uri"])

        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and size + len(text.encode()) > block_bytes:
                    yield close()
                    ids, texts, size = [], [], 0
                ids.append(item)
                texts.append(text)
                size += len(text.encode())
        yield close()

    return [r[0] for r in arrow(rows, build, "uri string").collect()] if size else []


def _chunk_bytes(blocks: list) -> int:
    """Chunks of several blocks are larger, as blocks may have to be loaded for each."""
    return CHUNK_BYTES if len(blocks) < 2 else 8 * CHUNK_BYTES


def find_matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: words, hit words, items with occurring windows, and the longest verbatim match: its words, item and first word (from 0).

    Item and first word are null where nothing matches.
    """
    blocks = benchmark_blocks(benchmark, window, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, most=_chunk_bytes(blocks)):
                yield _search(part, blocks, window)

    return arrow(plain(documents, "doc_id", "text"), run, SCHEMA)


def decontaminate(documents: DataFrame, benchmark: DataFrame, min_items: int = 2, window: int = WINDOW) -> DataFrame:
    """Documents without contamination (fewer than ``min_items`` items with occurring windows); all columns stay.

    Runs in one pass without a shuffle: the search flags rows next to the columns it returns unchanged.
    """
    blocks = benchmark_blocks(benchmark, window)
    columns, text = documents.columns, [x.lower() for x in documents.columns].index("text")
    ids = [x.lower() for x in columns].index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = pa.record_batch([batch.column(ids), batch.column(text)], ["doc_id", "text"])
            at = 0
            for part in chunks(pair, most=_chunk_bytes(blocks)):
                clean = np.asarray(_search(part, blocks, window).column("n_items")) < min_items
                yield batch.slice(at, part.num_rows).filter(pa.array(clean))
                at += part.num_rows

    return arrow(documents, run, documents.schema)
