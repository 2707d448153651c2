"""Near-duplicate detection: BagMinHash signatures of word-shingle multisets, banding, exact verification, components.

Signature.  The weight axis of a shingle is cut into dyadic intervals [0,1), [1,2), [2,4), ...; each interval that reaches
below the shingle's count carries a Poisson process whose points have a time, a signature slot and a weight coordinate, all
derived from the shingle's hash.  Points above the count are thinned away; a slot keeps the earliest time of all shingles.
Two multisets then agree in a slot with probability sum(min)/sum(max), their weighted Jaccard similarity.  Processes are
followed only up to a time that leaves almost every slot filled, and further for the documents where one is left open.

Scale.  Texts with equal words collapse to one representative first (a partial aggregation).  In each band bucket every
representative is compared with two leaders; verified links give components, and only what is still in different
components of one bucket is compared further, in blocks.  Nothing is dropped: see :func:`near_duplicates`.

Verification counts shingles by 32 bits of their hashes, so it is exact up to collisions: two texts of n words share about
n * n / 2^32 shingles by chance, a thousandth of a shingle at 2,000 words and a tenth at 20,000.

Edge cases: null texts are classes of their own; texts without words are duplicates only of equal texts; texts of one to
four words are one shingle; very long texts are described whole, one at a time; rows that repeat an id count as one document
if the text is equal, however often, else as the text whose hash is smaller; null ids are left out of the result; ties in
similarity at the threshold are links; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import arrow, delete, plain, ship, table
from ._words import U, Words, buffers, chunks, mix, shingles, span, split_words, prefix

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 5
HOT = 4096  # keys that hold a 4096th of all rows or more, of which there are at most so many
_SEEN = 100_000
_STEP = U(0x9E3779B97F4A7C15)


def multiset(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, count), by text."""
    h, doc = shingles(words, k)
    key = h ^ mix(doc.astype(U) + _STEP)
    _, at, count = np.unique(key, return_index=True, return_counts=True)
    order = np.argsort(doc[at], kind="stable")
    at, count = at[order], count[order]
    return doc[at], h[at], count


def signatures(doc: np.ndarray, element: np.ndarray, count: np.ndarray, docs: int, size: int = BANDS * ROWS) -> np.ndarray:
    """[docs, size] earliest times; infinity for texts without elements."""
    out = np.full(docs * size, np.inf)
    weight = np.bincount(doc, count, docs)
    limit = np.where(weight > 0, (np.log(size) + 5) / np.maximum(weight, 1), 0)
    todo = weight > 0
    with np.errstate(over="ignore", divide="ignore"):
        while todo.any():
            mine = todo[doc]
            d, e, c = doc[mine], element[mine], count[mine].astype(np.int64)
            # one process for each dyadic interval that starts below the count
            levels = np.ceil(np.log2(c)).astype(np.int64) + 1
            which = np.repeat(np.arange(len(d)), levels)
            level = np.arange(len(which)) - np.repeat(np.cumsum(levels) - levels, levels)
            low = np.where(level > 0, np.int64(1) << np.maximum(level - 1, 0), 0)
            high = np.int64(1) << level
            d, c = d[which], c[which]
            seed = mix(mix(e)[which] + (level + 1).astype(U) * _STEP)
            rate, time = 1.0 / (size * (high - low)), np.zeros(len(d))
            step = 0
            while len(d):
                step += 1
                x = mix(seed + U(step) * _STEP)
                time = time - np.log(((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) * rate
                alive = time <= limit[d]
                d, c, low, high, seed, rate, time, x = (v[alive] for v in (d, c, low, high, seed, rate, time, x))
                y = mix(x ^ _STEP)
                kept = low + (((y & U(0xFFFFFF)).astype(np.float64) * 2.0**-24) * (high - low)).astype(np.int64) < c
                slot = ((y >> U(32)) * U(size)) >> U(32)
                np.minimum.at(out, (d * size + slot.astype(np.int64))[kept], time[kept])
            todo &= ~np.isfinite(out.reshape(docs, size)).all(1)
            limit = limit * 2
    return out.reshape(docs, size)


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """[docs, bands] bucket keys; the band's number is part of the key."""
    bits = signature.view(U).reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U), bits.shape[:2])
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = mix(key * _STEP + bits[:, :, r])
    return key.view(np.int64)


def _describe(batch: pa.RecordBatch, bands: int, rows: int) -> pa.RecordBatch:
    """Class key, weight, bands and shingle multiset (sorted 32-bit hashes, repeated by count) of each text."""
    texts = batch.column("text")
    words = split_words(texts)
    docs = batch.num_rows
    n = np.diff(words.first)
    sums = prefix(words.hash)
    one = span(sums, words.first[:-1], words.first[1:])
    two = span(prefix(mix(words.hash + _STEP)), words.first[:-1], words.first[1:])
    raw, at = buffers(texts)
    bare = np.flatnonzero(n == 0)
    for i in bare:  # no words: the bytes themselves
        value = raw[at[i] : at[i + 1]].astype(U)
        one[i], two[i] = (span(prefix(mix(value + U(s))), np.zeros(1, np.int64), np.array([len(value)]))[0] for s in (1, 2))
    two ^= n.astype(U)
    doc, element, count = multiset(words)
    keys = band_keys(signatures(doc, element, count, docs, bands * rows), bands, rows)
    weight = np.bincount(doc, count, docs).astype(np.int64)
    small = (element >> U(32)).astype(np.uint32)
    repeated = np.repeat(small, count)
    owner = np.repeat(doc, count)
    repeated = (np.sort((owner.astype(U) << U(32)) | repeated.astype(U)) & U(0xFFFFFFFF)).astype(np.uint32)
    ends = np.concatenate([[0], np.cumsum(weight)]) * 4
    return pa.record_batch(
        [
            batch.column("doc_id"),
            pa.array(one.view(np.int64)),
            pa.array(two.view(np.int64)),
            pa.array(weight),
            pa.ListArray.from_arrays(pa.array((np.arange(docs + 1) * bands).astype(np.int32)), pa.array(keys.reshape(-1))),
            pa.Array.from_buffers(pa.large_binary(), docs, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(repeated)]).cast(pa.binary()),
        ],
        ["doc_id", "key1", "key2", "weight", "bands", "shingles"],
    )


def describe(documents: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows that repeat an id and a text are described once for as long as the task remembers; what is left goes in a join
        seen: set[tuple[int, int, int]] = set()
        for batch in batches:
            for part in chunks(batch):
                found = _describe(part, bands, rows)
                new = []
                for key in zip(*(found.column(i).to_pylist() for i in range(3)), strict=True):
                    new.append(key not in seen)
                    seen.add(key)
                if len(seen) > _SEEN:
                    seen.clear()
                yield found if all(new) else found.filter(pa.array(new))

    texts = plain(documents, "doc_id", "text").where("doc_id is not null and text is not null")
    return arrow(texts, run, "doc_id long, key1 long, key2 long, weight long, bands array<long>, shingles binary")


def _overlap(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    # the k-th copy of a hash in x meets the k-th copy in y
    both = np.concatenate([x, y])
    rank = np.concatenate([np.arange(len(v)) - np.searchsorted(v, v) for v in (x, y)])
    key = np.sort((both.astype(U) << U(32)) | rank.astype(U))
    common = int((key[1:] == key[:-1]).sum())
    return common / (len(both) - common)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b), those whose multisets overlap enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("weight").alias("weight_a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("rep").alias("b"), F.col("weight").alias("weight_b"), F.col("shingles").alias("set_b"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(F.least("weight_a", "weight_b") >= threshold * F.greatest("weight_a", "weight_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_overlap(x.as_py(), y.as_py()) >= threshold for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return arrow(both.select("a", "b", "set_a", "set_b"), run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component, for nodes that have a link.

    Every round hooks each node to its least smaller neighbour, follows these pointers to their ends by doubling, and
    contracts the links to the ends; links shrink until none is left.  A hub's links only meet in partial minima.
    """
    spark = links.sparkSession

    def pairs(df: DataFrame, x: str, y: str) -> DataFrame:
        return df.select(F.least(x, y).alias("low"), F.greatest(x, y).alias("high")).where("low < high").distinct()

    edges, edge_path = table(pairs(links, "a", "b"), "edges")
    nodes = edges.select(F.explode(F.array("low", "high")).alias("node")).distinct()
    nodes, _ = table(nodes, "nodes")
    total = None
    while not edges.isEmpty():
        parent, path = table(edges.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("root")), "parents")
        while True:
            up = parent.select(F.col("node").alias("via"), F.col("root").alias("end"))
            jumped, new = table(parent.join(up, parent.root == up.via, "left").select("node", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved")), "parents")
            delete(spark, path)
            parent, path = jumped.drop("moved"), new
            if jumped.where("moved").isEmpty():
                break
        low = parent.select(F.col("node").alias("low"), F.col("root").alias("low_root"))
        high = parent.select(F.col("node").alias("high"), F.col("root").alias("high_root"))
        ends = edges.join(low, "low", "left").join(high, "high", "left").select(F.coalesce("low_root", "low").alias("x"), F.coalesce("high_root", "high").alias("y"))
        if total is None:
            total = parent
        else:
            then = parent.select(F.col("node").alias("via"), F.col("root").alias("end"))
            total, _ = table(total.join(then, total.root == then.via, "left").select("node", F.coalesce("end", "root").alias("root")).union(parent), "totals")
        edges, new = table(pairs(ends, "x", "y"), "edges")
        delete(spark, edge_path)
        edge_path = new
    if total is None:
        return nodes.select("node", F.col("node").alias("root"))
    return nodes.join(total, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _ranked(shingles: bytes) -> np.ndarray:
    """Sorted (hash, number of the copy) keys of a multiset."""
    x = np.frombuffer(shingles, np.uint32)
    return (x.astype(U) << U(32)) | (np.arange(len(x)) - np.searchsorted(x, x)).astype(U)


def _compare(probes: pa.Table, targets: pa.Table, threshold: float) -> pa.Table:
    """Links of similar rows in different components, one for each probe and component."""
    links: list[tuple[int, int]] = []
    if probes.num_rows and targets.num_rows:
        bucket = probes.column("bucket")[0].as_py()
        sets = [_ranked(x.as_py()) for x in targets.column("shingles")]
        size = np.array([len(x) for x in sets])
        keys, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        rep, root = (targets.column(c).to_numpy() for c in ("rep", "root"))
        outside = targets.column("main").to_numpy(zero_copy_only=False)
        bands = targets.column("bands").combine_chunks().flatten().to_numpy().reshape(len(sets), -1)
        for i in range(probes.num_rows):
            mine, x = (probes.column(c)[i].as_py() for c in ("rep", "root"))
            own = np.array(probes.column("bands")[i].as_py())
            probe = _ranked(probes.column("shingles")[i].as_py())
            shared = bands == own
            # a pair is looked at in the first bucket it shares, and once if both are probes
            ask = (root != x) & (own[shared.argmax(1)] == bucket) & (outside | (mine < rep))
            ask &= np.minimum(size, len(probe)) >= threshold * np.maximum(size, len(probe))
            if not ask.any():
                continue
            part = ask[owner]
            at = np.searchsorted(probe, keys[part])
            at[at == len(probe)] = 0
            common = np.bincount(owner[part], probe[at] == keys[part], len(sets))
            near = np.flatnonzero(ask & (common >= threshold * (size + len(probe) - common)))
            _, first = np.unique(root[near], return_index=True)
            links += [(min(mine, r), max(mine, r)) for r in rep[near[first]].tolist()]
    return pa.table([pa.array([k[j] for k in links], pa.int64()) for j in (0, 1)], ["a", "b"])


def _large_buckets(members: DataFrame, held: DataFrame, threshold: float, block: int = 1024) -> DataFrame:
    """Links across components within large buckets (bucket, n, rep, root).

    Members outside a bucket's largest component are compared with all its members, in blocks of about ``block`` by
    ``block`` rows, each a task's group; multisets are compared in memory and only links come out.
    """
    sizes = members.groupBy("bucket", "root").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("n"))
    largest = largest.select("bucket", F.col("top.root").alias("main_root"), F.ceil((F.col("n") - F.col("top.c")) / block).cast("int").alias("probe_blocks"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = members.join(largest, "bucket").withColumn("main", F.col("root") == F.col("main_root")).join(held.select("rep", "bands", "shingles"), "rep")
    spot = F.abs(F.xxhash64("rep"))
    columns = ("bucket", "i", "j", "rep", "root", "main", "bands", "shingles")
    probes = rows.where(~F.col("main")).withColumn("i", (spot % F.col("probe_blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*columns)
    targets = rows.withColumn("j", (spot % F.col("blocks")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("probe_blocks") - 1))).select(*columns)
    ship(members.sparkSession)

    def run(rows: pa.Table) -> pa.Table:
        probe = rows.column("probe")
        return _compare(rows.filter(probe), rows.filter(pc.invert(probe)), threshold)

    both = probes.withColumn("probe", F.lit(True)).union(targets.withColumn("probe", F.lit(False)))
    return both.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")


def _hot_join(rows: DataFrame, keys: DataFrame, on: list[str], share: int = HOT) -> DataFrame:
    """``rows`` inner-joined to ``keys`` (unique on ``on``, with the number ``n`` of their rows), whatever share of the rows one key holds.

    At most ``share`` keys can hold that part of all rows: these are broadcast, so their rows stay where they are; the others are merged.
    """
    total = keys.agg(F.sum("n")).first()[0] or 0
    hot = keys.where(F.col("n") * share >= total)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keys.where(F.col("n") * share < total).hint("merge"), on)
    return rows.join(F.broadcast(hot), on).unionByName(cold)


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, small: int = 32) -> DataFrame:
    """One row per document: ``doc_id``, ``exact_id`` (least id with the same words), ``class_id`` (least id of the class).

    Classes are connected components of links with similarity >= threshold among texts that share a band bucket.
    1. Every member of a bucket is paired with the bucket's least member and with a second one picked by hash.
    2. Components of the verified pairs are formed.  3. In buckets that still hold several components, all pairs across
    components are compared: as rows where a bucket has at most ``small`` representatives, else by :func:`_large_buckets`.
    """
    spark = documents.sparkSession
    described, path = table(describe(documents, bands, rows), "bands")
    member, member_path = table(described.groupBy("doc_id").agg(F.min(F.struct("key1", "key2")).alias("k")).select("doc_id", "k.*"), "members")
    heads, heads_path = table(member.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "heads")

    def one_row(rows: DataFrame, of: DataFrame) -> DataFrame:
        """The description of each representative, once: a repeated id may have another text too, and equal rows are described in several tasks."""
        of = of.select("rep", F.col("key1").alias("k1"), F.col("key2").alias("k2"))
        return rows.join(of, (F.col("doc_id") == F.col("rep")) & (F.col("key1") == F.col("k1")) & (F.col("key2") == F.col("k2"))).dropDuplicates(["doc_id", "key1", "key2"])

    keyed = one_row(described, heads).where("weight > 0").select("rep", F.explode("bands").alias("bucket"))
    full = keyed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("lead"), F.min(F.struct(F.xxhash64("rep", "bucket"), "rep")).alias("other")).where("n > 1").select("bucket", "n", "lead", F.col("other.rep").alias("other"))
    full, full_path = table(full, "full")
    buckets, bucket_path = table(_hot_join(keyed, full, ["bucket"]), "buckets")
    stars = buckets.select(F.explode(F.array(F.struct(F.col("lead").alias("a"), F.col("rep").alias("b")), F.struct(F.least("other", "rep").alias("a"), F.greatest("other", "rep").alias("b")))).alias("p")).select("p.*").where("a < b").distinct()
    # what could be compared is picked before the multisets move, and they move once; the ids grow with the input, so no side is broadcast
    wanted = heads.join(buckets.select("rep").distinct(), "rep").hint("merge")
    held, held_path = table(one_row(described, wanted).select("rep", "weight", "bands", "shingles"), "sets")
    delete(spark, path)
    links, links_path = table(_verified(stars, held, threshold), "links")
    roots, roots_path = table(components(links), "roots")
    placed = buckets.join(roots, buckets.rep == roots.node, "left").select("bucket", "n", "rep", F.coalesce("root", "rep").alias("root"))
    mixed, mixed_path = table(placed.groupBy("bucket").agg(F.max("n").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket", "n"), "mixed")
    open_, open_path = table(_hot_join(placed.drop("n"), mixed, ["bucket"]), "open")
    few = open_.where(F.col("n") <= small).groupBy("bucket").agg(F.collect_list(F.struct("rep", "root")).alias("m"))
    few = few.select(F.explode("m").alias("x"), "m").select(F.col("x"), F.explode("m").alias("y")).where("x.root <> y.root and x.rep < y.rep").select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    few = few.join(stars, ["a", "b"], "left_anti")
    found = _verified(few, held, threshold).union(_large_buckets(open_.where(F.col("n") > small).select("bucket", "n", "rep", "root"), held, threshold))
    found, found_path = table(found, "links")
    if not found.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found))
    classes = heads.join(roots, heads.rep == roots.node, "left").select("key1", "key2", "n", F.col("rep").alias("exact_id"), F.coalesce("root", "rep").alias("class_id"))
    classes, classes_path = table(classes, "heads")
    out = _hot_join(member, classes, ["key1", "key2"]).select("doc_id", "exact_id", "class_id")
    lone = plain(documents, "doc_id", "text").where("doc_id is not null").groupBy("doc_id").agg(F.count("text").alias("n")).where("n = 0").select("doc_id", F.col("doc_id").alias("exact_id"), F.col("doc_id").alias("class_id"))
    result, _ = table(out.union(lone), "classes")
    for p in (member_path, heads_path, full_path, bucket_path, held_path, links_path, roots_path, mixed_path, open_path, found_path, classes_path):
        delete(spark, p)
    return result
