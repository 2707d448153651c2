"""SentencePiece encoding and decoding as a lattice over distinct words.

A text is cut into words at places no piece can cross.  For the distinct words of a chunk, all substrings up to the longest
piece are formed, joined with the piece table, and grouped by word into a lattice of edges (start, length, piece); a fold
over the lattice gives the segmentation, which is mapped back to the texts.  The fold depends on the model's kind:

* unigram: Viterbi, best path by summed scores;
* BPE: best path by merge order, i.e. the adjacent edges whose joint edge ranks first are replaced by it until none is left.
  A Viterbi path over BPE scores is another segmentation than the model's own, so it would give wrong ids.

Two forms.  :func:`encode` runs the lattice in vectorised NumPy tables inside Arrow batches, with a bounded cache of words;
texts never leave their task.  :func:`lattice_words` is the same lattice as Spark relations (explode, equi-join, group,
higher-order ``aggregate``) over a table of distinct words, for unigram models.

Edge cases: null texts give null ids and null on the way back; empty texts give no ids; characters without a piece become
byte pieces (or the unknown id if the model has none); U+2581 reads as a blank, as in the model's own library; of ties in
rank the leftmost edge goes first; very long texts and texts without blanks are encoded whole, and words over ``LONG``
characters are not kept; repeated rows are encoded each; columns named like the results are replaced.
"""

from __future__ import annotations

import heapq
import re
import struct
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow
from ._words import U, mix

BLANK = "▁"
CACHE_BYTES = 40 << 20  # words and their ids that a worker keeps
LONG = 32
BLOCK = 16_384
_NONE = np.int32(2**31 - 1)
_MULTIPLIER = U(0xD1342543DE82EF95)
_FILTER = 20

# Kinds of models and pieces in the model file.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


# ---------------------------------------------------------------- model file


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            at += n
            yield key >> 3, data[at - n : at]
        else:
            n = 8 if key & 7 == 1 else 4
            at += n
            yield key >> 3, data[at - n : at]


@dataclass
class Model:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    model_kind: int
    dummy_prefix: bool = True
    table: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path, "rb") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, data: bytes) -> Model:
        pieces, scores, kinds, model_kind, prefix, rule, extra = [], [], [], UNIGRAM, True, "identity", True
        for number, value in _fields(data):
            if number == 1:
                x = dict(_fields(value))
                pieces.append(x[1].decode())
                scores.append(struct.unpack("<f", x[2])[0] if 2 in x else 0.0)
                kinds.append(x.get(3, NORMAL))
            elif number == 2:
                model_kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                x = dict(_fields(value))
                prefix, rule, extra = bool(x.get(3, 1)), x.get(1, b"identity").decode(), bool(x.get(4, 1))
        if rule != "identity" or extra:
            raise ValueError("only models that leave texts as they are, blanks included, are supported")
        if model_kind not in (UNIGRAM, BPE):
            raise ValueError(f"model kind {model_kind} is not supported")
        if USER in kinds or UNUSED in kinds:
            raise ValueError("user-defined and unused pieces are not supported")
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("pieces that go on after a blank are not supported")
        return cls(pieces, scores, kinds, model_kind, prefix)


class Encoder:
    def __init__(self, model: Model, fold: int | None = None):
        self.model, self.fold = model, fold or model.model_kind
        normal = [i for i, k in enumerate(model.kinds) if k == NORMAL]
        self.ids = {model.pieces[i]: i for i in normal}
        self.longest = max((len(p) for p in self.ids), default=1)
        self.unknown = next((i for i, k in enumerate(model.kinds) if k == UNKNOWN), 0)
        self.byte = {int(model.pieces[i][1:-1], 16): i for i, k in enumerate(model.kinds) if k == BYTE}
        score = np.array(model.scores, np.float64)
        # rank 0 is merged first; equal scores share a rank, and then the leftmost goes first
        order = np.unique(-score[normal], return_inverse=True)[1].reshape(-1) if normal else np.zeros(0, np.int64)
        self.rank = np.full(len(score) + 1, _NONE, np.int32)
        self.rank[normal] = order
        self.score = np.append(score, -np.inf)
        self.no_piece = min((model.scores[i] for i in normal), default=0.0) - 10.0
        # the piece table of the equi-join: sorted hashes of pieces of two characters or more
        several = [i for i in normal if len(model.pieces[i]) > 1]
        hashes = np.array([_hash(model.pieces[i]) for i in several], U)
        by = np.argsort(hashes)
        self.hashes, self.hash_ids = hashes[by], np.array(several, np.int32)[by]
        self.filter = np.zeros(1 << _FILTER, bool)
        self.filter[(self.hashes >> U(64 - _FILTER)).astype(np.int64)] = True
        self.single = {ord(model.pieces[i]): i for i in normal if len(model.pieces[i]) == 1}
        inner = {c for i in several for c in model.pieces[i]}
        self.newline_alone = "\n" not in inner
        self.pairs = {p[i : i + 2] for p in (model.pieces[i] for i in several) for i in range(len(p) - 1)}
        self.cache: dict[str, bytes] = {}
        self.cached = 0
        self.raw = [bytes([int(p[1:-1], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else b"" if k == CONTROL else p.replace(BLANK, " ").encode() for p, k in zip(model.pieces, model.kinds, strict=True)]

    # ---- words

    def words(self, text: str) -> list[str]:
        """Cut where no piece can cross: before blanks, and around newlines where no piece of several characters has one.

        Keys of the cache: a plain word stands for blank + word, ``\\n`` + word for a newline and a word without a blank,
        ``\\0`` + string for exactly that string.
        """
        if self.newline_alone and self.model.dummy_prefix and BLANK not in text and "\0" not in text and "  " not in text and " \n" not in text and "\n\n" not in text and text[0] not in " \n" and text[-1] != " ":
            return text.replace("\n", " \n").split(" ")
        s = text.replace(" ", BLANK)
        if self.model.dummy_prefix:
            s = BLANK + s
        cut = r"\n|%s*[^%s\n]+|%s+" if self.newline_alone else r"%s*[^%s]+|%s+"
        return ["\0" + x for x in re.findall(cut % (BLANK, BLANK, BLANK), s)]

    def _spelled(self, key: str) -> str:
        return key[1:] if key[0] == "\0" else key if key[0] == "\n" else BLANK + key

    def _missing(self, keys: list[str]) -> None:
        """Encode words and add them to the cache, whose bytes are counted."""
        units: dict[str, int] = {}
        plan: list[list[int]] = []
        for key in keys:
            spelled = self._spelled(key)
            parts = ["\n", spelled[1:]] if key[0] == "\n" and len(key) > 1 else [spelled]
            plan.append([units.setdefault(u, len(units)) for p in parts for u in ([p] if len(p) <= LONG else self._split(p))])
        coded = self.encode_units(list(units))
        for key, parts in zip(keys, plan, strict=True):
            ids = self.cache[key] = b"".join(coded[i] for i in parts)
            self.cached += sys.getsizeof(key) + sys.getsizeof(ids) + 100

    def _split(self, word: str) -> list[str]:
        """A long word, cut between characters that never meet inside a piece."""
        out, at = [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.pairs:
                out.append(word[at:i])
                at = i
        return [*out, word[at:]]

    def encode_texts(self, texts: list[str | None]) -> list[bytes | None]:
        """Packed int32 ids of each text."""
        cut = [self.words(t) if t else [] for t in texts]
        if self.cached > CACHE_BYTES:
            self.cache.clear()
            self.cached = 0
        cache = self.cache
        missing = {w for ws in cut for w in set(ws)}.difference(cache)
        if missing:
            self._missing(list(missing))
        get = cache.__getitem__
        out = [None if t is None else b"".join(map(get, ws)) for t, ws in zip(texts, cut, strict=True)]
        for key in missing:
            if len(key) > LONG:  # a text without blanks is one word, which hardly comes again
                self.cached -= sys.getsizeof(key) + sys.getsizeof(cache.pop(key)) + 100
        return out

    # ---- lattice

    def encode_units(self, units: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(units)
        size = np.array([len(u) for u in units], np.int64)
        for low, high in ((0, 6), (6, 9), (9, 12), (12, 16), (16, 22), (22, LONG)):
            mine = np.flatnonzero((size > low) & (size <= high))
            for a in range(0, len(mine), BLOCK):
                some = mine[a : a + BLOCK]
                for i, ids in zip(some, self._block([units[i] for i in some], size[some], high), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(size > LONG):
            out[i] = self._long(units[i])
        return out

    def lattice(self, units: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
        """(code points, edges): edges[word, start, length] is the piece's id, -1 without a piece or for one character."""
        points = np.zeros((len(units), width), np.uint32)
        flat = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(u) for u in units])
        points[np.arange(width) < size[:, None]] = flat
        edges = np.full((len(units), width, self.longest + 1), -1, np.int32)
        with np.errstate(over="ignore"):
            h = points.astype(U) + U(1)
            sums = h.copy()
            for n in range(2, min(self.longest, width) + 1):
                # explode: substrings of n characters; equi-join: their hash in the piece table
                sums = sums[:, :-1] * _MULTIPLIER + h[:, n - 1 :]
                key = mix(sums)
                word, start = np.nonzero(self.filter[(key >> U(64 - _FILTER)).astype(np.int64)] & (np.arange(width - n + 1) + n <= size[:, None]))
                found = key[word, start]
                at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
                hit = self.hashes[at] == found
                edges[word[hit], start[hit], n] = self.hash_ids[at[hit]]
        return points, edges

    def _block(self, units: list[str], size: np.ndarray, width: int) -> list[bytes]:
        points, edges = self.lattice(units, width)
        end = self._merge(edges, size) if self.fold == BPE else self._viterbi(points, edges, size)
        word, start = np.nonzero(end)
        length = end[word, start] - start
        ids = edges[word, start, length]
        one = length == 1
        ids[one] = self._singles(points[word[one], start[one]])
        counts = np.bincount(word, minlength=len(units))
        at = np.append(0, np.cumsum(counts))
        if (ids >= 0).all():
            packed = ids.astype("<i4").tobytes()
            return [packed[4 * a : 4 * b] for a, b in zip(at[:-1], at[1:], strict=True)]
        out = []
        for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            mine = ids[a:b]
            if (mine < 0).any():
                mine = np.array([x for k in range(a, b) for x in ([ids[k]] if ids[k] >= 0 else self._bytes(units[i][start[k]]))])
            out.append(mine.astype("<i4").tobytes())
        return out

    def _singles(self, points: np.ndarray) -> np.ndarray:
        kinds, inverse = np.unique(points, return_inverse=True)
        return np.array([self.single.get(int(p), -1) for p in kinds], np.int32)[inverse]

    def _bytes(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]

    def _merge(self, edges: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Fold in merge order; ends[word, start] of the edges of the path, 0 where none starts."""
        n, width, _ = edges.shape
        at = np.arange(width)
        inside = at < size[:, None]
        end = np.where(inside, at + 1, 0)
        before = np.tile(at - 1, (n, 1))
        pair = np.where((at + 1 < size[:, None]), self.rank[edges[:, :, 2]] if edges.shape[2] > 2 else _NONE, _NONE).astype(np.int32)
        rows = np.arange(n)
        while len(rows):
            first = pair[rows].argmin(1)
            more = pair[rows, first] < _NONE
            rows, first = rows[more], first[more]
            if not len(rows):
                break
            second = end[rows, first]
            third = end[rows, second]
            end[rows, first], end[rows, second], pair[rows, second] = third, 0, _NONE
            self._pair(pair, edges, end, size, rows, first)
            has = third < size[rows]
            before[rows[has], third[has]] = first[has]
            has = first > 0
            r, left = rows[has], before[rows[has], first[has]]
            self._pair(pair, edges, end, size, r, left)
        return end

    def _pair(self, pair, edges, end, size, rows, start) -> None:
        """Rank of joining the symbol at ``start`` with the next one."""
        middle = end[rows, start]
        open_ = middle < size[rows]
        to = end[rows, np.where(open_, middle, 0)]
        length = to - start
        ok = open_ & (length <= self.longest)
        pair[rows, start] = np.where(ok, self.rank[edges[rows, start, np.where(ok, length, 0)]], _NONE)

    def _viterbi(self, points: np.ndarray, edges: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Fold by best summed score; for unigram models, whose segmentation this is."""
        n, width, longest = edges.shape
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, width + 1), np.int64)
        single = self._singles(points.reshape(-1)).reshape(n, width)
        alone = np.where(single >= 0, self.score[single], self.no_piece)
        for to in range(1, width + 1):
            for length in range(min(longest - 1, to), 0, -1):
                step = alone[:, to - 1] if length == 1 else self.score[edges[:, to - length, length]]
                value = best[:, to - length] + step
                better = value > best[:, to]
                best[better, to], back[better, to] = value[better], length
        end, rows, at = np.zeros((n, width), np.int64), np.arange(n), size.copy()
        while len(rows):
            start = at - back[rows, at]
            end[rows, start] = at
            rows, at = rows[start > 0], start[start > 0]
        return end

    def _long(self, unit: str) -> bytes:
        """One very long word: the same folds with a heap or a list, in O(n log n)."""
        n = len(unit)
        if self.fold == BPE:
            end, before, dead, heap = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n, []

            def push(a: int) -> None:
                if a >= 0 and end[a] < n and end[end[a]] - a <= self.longest:
                    piece = self.ids.get(unit[a : end[end[a]]])
                    if piece is not None:
                        heapq.heappush(heap, (int(self.rank[piece]), a, end[a], end[end[a]]))

            for i in range(n):
                push(i)
            while heap:
                _, a, b, c = heapq.heappop(heap)
                if dead[a] or b >= n or dead[b] or end[a] != b or end[b] != c:
                    continue
                dead[b], end[a] = True, c
                if c < n:
                    before[c] = a
                push(a)
                push(before[a])
            cuts = [(a, end[a]) for a in range(n) if not dead[a]]
        else:
            best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
            for to in range(1, n + 1):
                for length in range(min(self.longest, to), 0, -1):
                    piece = self.ids.get(unit[to - length : to])
                    if piece is None and length > 1:
                        continue
                    value = best[to - length] + (self.no_piece if piece is None else self.model.scores[piece])
                    if value > best[to]:
                        best[to], back[to] = value, length
            cuts, to = [], n
            while to:
                cuts.append((to - back[to], to))
                to -= back[to]
            cuts.reverse()
        ids = [x for a, b in cuts for x in ([self.ids[unit[a:b]]] if unit[a:b] in self.ids else self._bytes(unit[a:b]))]
        return np.array(ids, "<i4").tobytes()

    # ---- way back

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


def _hash(piece: str) -> int:
    h = U(0)
    with np.errstate(over="ignore"):
        for i, c in enumerate(piece):
            h = h * _MULTIPLIER + U(ord(c) + 1) if i else U(ord(c) + 1)
    return int(mix(np.array([h], U))[0])


_held: dict[tuple, Encoder] = {}


def encoder(path: str, fold: int | None = None) -> Encoder:
    """The encoder of a model file, kept for the worker's life."""
    if (path, fold) not in _held:
        _held[path, fold] = Encoder(Model.load(path), fold)
    return _held[path, fold]


def default_model(folder: str | None = None) -> str:
    import public_tokenizers

    return f"{folder}/piece_bpe_32k.model" if folder else public_tokenizers.path("piece_bpe_32k.model")


def _slices(texts: pa.Array, most: int = 4_000_000) -> Iterator[pa.Array]:
    at, size = 0, 0
    lengths = np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]) if len(texts) else []
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield texts.slice(at, i - at)
            at, size = i, 0
        size += n
    yield texts.slice(at)


def encode(documents: DataFrame, model: str | None = None, text: str = "text") -> DataFrame:
    """All columns of ``documents`` but the text, with ``ids`` (array of int), ``n_tokens`` and ``decoded`` (whether the ids read back as the text).

    Columns that already have these names are replaced.
    """
    path = model or default_model()
    at = [c.lower() for c in documents.columns].index(text.lower())
    own = {"ids", "n_tokens", "decoded"}
    kept = [i for i, c in enumerate(documents.columns) if i != at and c.lower() not in own]
    names = [documents.columns[i] for i in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            start = 0
            for part in _slices(batch.column(at).cast(pa.string())):
                texts = part.to_pylist()
                packed = coder.encode_texts(texts)
                ids = [None if p is None else np.frombuffer(p, "<i4") for p in packed]
                sizes = np.array([0 if x is None else len(x) for x in ids], np.int64)
                null = pa.array([x is None for x in ids], pa.bool_())
                offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(p for p in packed if p), "<i4"), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(offsets), flat, mask=null) if len(ids) else pa.array([], pa.list_(pa.int32()))
                back = [None if x is None else coder.decode(x) == t.replace(BLANK, " ") for x, t in zip(ids, texts, strict=True)]
                rest = [batch.column(i).slice(start, len(part)) for i in kept]
                yield pa.RecordBatch.from_arrays([*rest, lists, pa.array(sizes), pa.array(back, pa.bool_())], [*names, "ids", "n_tokens", "decoded"])
                start += len(part)

    kinds = "".join(f"`{documents.dtypes[i][0]}` {documents.dtypes[i][1]}, " for i in kept)
    return arrow(documents, run, f"{kinds}ids array<int>, n_tokens long, decoded boolean")


def decode(encoded: DataFrame, model: str | None = None, ids: str = "ids") -> DataFrame:
    """All columns of ``encoded``, with ``text`` read back from the ids (in place of a column of that name)."""
    path = model or default_model()

    encoded = encoded.select(*[f"`{c}`" for c in encoded.columns if c.lower() != "text"])
    names, kinds = [*encoded.columns, "text"], "".join(f"`{c}` {t}, " for c, t in encoded.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts = [None if x is None else coder.decode(np.array(x, np.int64)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)

    return arrow(encoded, run, f"{kinds}text string")


def lattice_words(words: DataFrame, pieces: DataFrame, longest: int, no_piece: float) -> DataFrame:
    """(word, path) for distinct words: the lattice as relations and Viterbi as a higher-order fold.

    ``pieces`` is (piece, id, score), a table bounded by the vocabulary; ``path`` is the array of piece ids, -1 for a
    character without a piece.  Words of any length are folded in one row; nulls and empty words are left out.
    """
    word = words.select("word").where("word <> ''").distinct()
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - i + 1)), lambda n: F.struct(i.alias("at"), n.alias("n")))))
    edges = word.select("word", F.explode(spans).alias("s")).select("word", F.col("s.at").alias("at"), F.col("s.n").alias("n"), F.substr("word", F.col("s.at"), F.col("s.n")).alias("piece"))
    edges = edges.join(F.broadcast(pieces), "piece", "left").where("id is not null or n = 1")
    edge = F.struct((F.col("at") + F.col("n")).alias("to"), F.col("at").alias("at"), F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(no_piece)).cast("double").alias("score"))
    lattice = edges.groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    # the state holds, for every place reached, the best score and the path to it; edges come in order of their end
    start = F.create_map(F.lit(1), F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("path")))

    def step(state, e):
        came = state[e["at"]]
        value = F.struct((came["score"] + e["score"]).alias("score"), F.concat(came["path"], F.array(e["id"].cast("int"))).alias("path"))
        old = F.try_element_at(state, e["to"])
        kept = F.map_filter(state, lambda k, _: k != e["to"])
        return F.when(old.isNotNull() & (old["score"] >= value["score"]), state).otherwise(F.map_concat(kept, F.create_map(e["to"], value)))

    best = F.aggregate("edges", start, step)
    return lattice.select("word", best[F.length("word") + 1]["path"].alias("path"))
