"""The operators against plain versions, on awkward rows and on the smallest tables."""

import hashlib
import random
import time
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from keystrand.llm import bagminhash, chat, decontaminate, langid, media, pii, quality, queries, sentencepiece, tokenstore, warc
from keystrand.llm._words import split_words
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long, score double, rep long, ids string, class_id string"

rng = random.Random(11)
PROSE = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(9)) for _ in range(300))
LONG = " ".join(f"w{rng.randrange(5000)}" for _ in range(40_000))
PASSAGE = "one two three four five six seven eight nine ten"
ROWS = [
    (1, PROSE, "en"), (2, PROSE, "en"), (3, PROSE.upper() + "!", "en"), (4, PROSE.replace("alpha", "omega", 3), "en"), (5, None, "de"), (6, "", None), (7, "   ", "de"), (8, "!!!", None), (9, "!!!", "fr"),
    (10, LONG, "en"), (11, LONG + " tail", "en"), (12, "two words", "en"), (13, "Two, words", "en"), (14, PASSAGE + " x " + PASSAGE, None), (15, "é è ü 日本語 ß", "fr"), (None, PROSE, "en"), (None, None, None),
    (16, "mail a.b@c.de, 10.0.0.1, 4111 1111 1111 1111 +1 (523) 555-1055 token = \"abc12345def\"", "en"), (17, "same row", "en"), (17, "same row", "en"), (18, "a " * 500, "es"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, x, "s", None if t is None else len(t), 0.5, 1, "x", "y") for d, t, x in ROWS], KIND)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="module")
def tables(spark):
    return {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark", "labels", "pages", "conversations")}


def texts(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


# ---------------------------------------------------------------- words


def test_words_are_those_of_the_pattern():
    some = [t for _, t, _ in ROWS] + ["A_b-C9", "\x00x\x7fy", "ÀÉ É", "a\nb"]
    got = split_words(pa.array(some, pa.string()))
    spelled, seen = [w for t in some for w in brute.words(t)], {}
    assert np.diff(got.first).tolist() == [len(brute.words(t)) for t in some]
    for w, h in zip(spelled, got.hash.tolist(), strict=True):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


# ---------------------------------------------------------------- 1 quality


def test_quality_learns_and_never_sees_held_out_labels(spark, tables):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.score_quality(documents, labels).toPandas()
    assert len(out) == documents.count() and out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.5)).all()
    assert (out["held_out"] == [zlib.crc32(str(d).encode()) % 3 == 1 for d in out["doc_id"]]).all()
    marked = out.merge(labels.toPandas(), on="doc_id")
    held = marked[marked["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.9
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.score_quality(documents, flipped).toPandas()
    assert np.allclose(out.sort_values("doc_id")["score"], again.sort_values("doc_id")["score"])


def test_quality_edges(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (10, None), (99, 1), (None, 0), (12, 7)], "doc_id long, quality int")
    assert quality.score_quality(docs, labels).count() == len(ROWS)
    assert quality.score_quality(none, labels).count() == 0
    no = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score_quality(docs, no).collect()} == {0.5}
    kept = quality.keep_good(docs, docs, no)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)


def test_ridge_and_calibration_against_plain_algebra(spark):
    r = np.random.default_rng(5)
    n, width = 1500, 20
    x = r.normal(size=(n, quality.N_STATS)).astype(np.float32)
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.3 * r.normal(size=n) > 0.3).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in row], float(t)) for i, (row, t) in enumerate(zip(x, y, strict=True))], "key long, stats array<float>, y double").repartition(5)
    model = quality.fit(df, features=width, seed=3)
    fold = {q.key for q in df.where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(5)) == 0).collect()}
    learn = np.array([i not in fold for i in range(n)])
    wide = x.astype(np.float64)
    mean, scale = wide.mean(0), wide.std(0) + 1e-3
    assert np.allclose(model["mean"], mean) and np.allclose(model["scale"], scale)
    z = np.sqrt(2 / width) * np.cos(((wide - mean) / scale) @ model["direction"] + model["shift"])
    z = np.concatenate([z, np.ones((n, 1))], 1)
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (n - y.sum())) * n
    # the same minimum by least squares: rows times the root of their weight, and a row for each penalised coefficient
    rows = np.concatenate([z[learn] * np.sqrt(weight[learn])[:, None], np.sqrt(quality.RIDGE) * np.eye(width + 1)[:-1]])
    target = np.concatenate([(2 * y[learn] - 1) * np.sqrt(weight[learn]), np.zeros(width)])
    assert np.allclose(model["weights"], np.linalg.lstsq(rows, target, rcond=None)[0], atol=1e-6)
    # random features stand for the kernel exp(-|a - b|^2 / (2 w^2)) of the scaled statistics
    many = {**model, "direction": r.normal(size=(quality.N_STATS, 20_000)) / (quality.WIDTH * np.sqrt(quality.N_STATS)), "shift": r.uniform(0, 2 * np.pi, 20_000)}
    f = quality._features(wide[:40], many)[:, :-1]
    a = (wide[:40] - mean) / scale
    kernel = np.exp(-((a[:, None] - a[None]) ** 2).sum(2) / (2 * (quality.WIDTH**2 * quality.N_STATS)))
    assert np.abs(f @ f.T - kernel).max() < 0.05
    # calibration: the best non-decreasing step function over the bins, by dynamic programming on maxima of minima
    raw = z @ model["weights"]
    bins = np.clip(((raw[~learn] + 2) / 4 * quality.BINS).astype(int), 0, quality.BINS - 1)
    total, good = np.bincount(bins, minlength=quality.BINS), np.bincount(bins, y[~learn], quality.BINS)
    used = np.flatnonzero(total)
    t, g = np.cumsum(np.append(0, total[used])), np.cumsum(np.append(0, good[used]))
    step = [max(min((g[b + 1] - g[a]) / (t[b + 1] - t[a]) for b in range(i, len(used))) for a in range(i + 1)) for i in range(len(used))]
    blocks = sorted({round(v, 12) for v in step})
    assert len(blocks) == len(model["values"]) and (np.diff(model["values"]) > 0).all()
    sizes = [sum(total[used[i]] for i in range(len(used)) if round(step[i], 12) == v) for v in blocks]
    assert np.allclose(model["values"], [(v * s + 0.5) / (s + 1) for v, s in zip(blocks, sizes, strict=True)])


def test_isotonic():
    x, y = quality.isotonic(np.arange(4.0), np.array([0, 3, 1, 4]), np.array([4, 4, 4, 4]))
    assert (np.diff(y) > 0).all() and len(x) == 3


# ---------------------------------------------------------------- 2 chat


def test_chat_round_trip(spark):
    hard = [queries.HARD_TEXT, "</turn>", "<turn>", "\\l\\h\\b\\", "#### x", "<</turn>turn>", "a\nb", "", None, "é🙂", "\\\\</turn>\\n"]
    rows = [(7, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(hard)] + [(None, 0, "us\ner", "null id"), (8, None, None, "no turn"), (8, 3, "assistant", "b"), (8, 3, "assistant", "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    out = chat.format_turns(df)
    back = {r.conv_id: [(t.role, t.text) for t in r.t] for r in out.select("conv_id", chat.parse(F.col("formatted")).alias("t")).collect()}
    for c in (7, 8, None):
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0))
        assert back[c] == [(r or "", t or "") for _, _, r, t in mine]
    d = {r.conv_id: r for r in chat.digest(out).collect()}
    said = "".join(f"{r}\n{t or ''}\n" for _, _, r, t in rows[: len(hard)])
    loss = "".join(t or "" for _, _, r, t in rows[: len(hard)] if r == "assistant")
    assert d[7].turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and d[7].loss_chars == len(loss) and d[7].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_turns(df.where("false")).count() == 0


def test_chat_blocks_keep_order(spark):
    df = spark.range(1000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    t = chat.format_turns(df).select(chat.parse(F.col("formatted")).alias("t")).first().t
    assert [x.text for x in t] == [str(i) for i in range(1000)]


def test_chat_layouts(spark):
    rows = [
        ('{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', "messages"),
        ('{"conversations":[{"value":"q","from":"human"},{"from":"gpt","value":"a"}]}', "conversations"),
        ('{"prompt":"q","response":"a"}', "prompt"), ('{"instruction":"q","output":"a"}', "instruction"), ('{"output":"a","input":"","instruction":"q"}', "instruction_input"),
        ('{"prompt":"q","completion":"a"}', "completion"), ('{"id":7,"source":{"x":[1]},"prompt":"q","response":"a"}', "prompt"),
        ('{"name":"n","messages":[{"role":"user","content":"q","name":"x"},{"content":"a","role":"assistant","weight":1}]}', "messages"), ('{"messages":[]}', "no_messages"), ('{"turns":[],"id":1}', "no_turns"),
        ('{"messages":"text"}', None), ('[1]', None), ('{"messages":null}', None), ('{"other":1}', None), ("not json", None), (None, None),
    ]
    df = spark.createDataFrame([(j, "z") for j, _ in rows], "json string, layout string")
    got = chat.canonical_json(df).collect()
    assert [r.layout for r in got] == [x for _, x in rows]
    for r in got:
        assert [(t.role, t.text) for t in r.turns] == ([("user", "q"), ("assistant", "a")] if r.layout and not r.layout.startswith("no_") else [])
    whole = spark.createDataFrame([(1, "q", "a")], "id long, prompt string, response string")
    assert [tuple(r) for r in chat.turns_of(whole, "id").collect()] == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    more = spark.createDataFrame([(1, "q", "a", "web", [("z",)])], "id long, prompt string, response string, source string, tags array<struct<t string>>")
    assert [tuple(r) for r in chat.turns_of(more, "id").collect()] == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    with pytest.raises(ValueError):
        chat.turns_of(df, "json")


def test_the_fingerprint_selects_the_mapping(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 0, "user", "q", 5, "c")], "CONV_ID long, turn long, role string, text string, extra long, content string")
    assert [tuple(r) for r in chat.canonical_rows(rows).collect()] == [(1, 0, "user", "q")]
    json = spark.createDataFrame([('{"prompt":"q","response":"a"}',)], "json string")
    swapped = {**chat.LAYOUTS, "prompt": (chat.LAYOUTS["completion"][0], *chat.LAYOUTS["prompt"][1:]), "completion": (chat.LAYOUTS["prompt"][0], "response string", lambda get: chat.F.array(chat._turn("only", get("response"))))}
    monkeypatch.setattr(chat, "LAYOUTS", swapped)
    got = chat.canonical_json(json).first()
    assert got.layout == "completion" and [tuple(t) for t in got.turns] == [("only", "a")]
    monkeypatch.setattr(chat, "ROW_LAYOUTS", {"other": {"conv_id": "conv_id", "turn": "turn", "role": "role", "content": "text"}})
    assert [tuple(r) for r in chat.canonical_rows(rows).collect()] == [(1, 0, "user", "c")]


# ---------------------------------------------------------------- 3 WARC


def test_warc_segments_and_edges(spark, tmp_path):
    big = "x" * 5000 + "é" * 3000
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, None, None), (4, "u", ""), (5, "http://c/\r\n", "0\r\n\r\n"), (6, "u", "line\r\n\r\nline"), (6, "u", "line\r\n\r\nline"), (None, "u", "lonely"), (7, "u", big + "y"), (None, "v", big)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    folder = f"file://{tmp_path}/w"
    warc.write_archives(pages, folder, segment_bytes=1000, archive_bytes=4000)
    got = warc.read_archives(spark, folder).collect()
    assert len(got) == len(rows)
    heads = {}
    for p, _, h in rows:
        heads[h or ""] = max((x for x in (heads.get(h or ""), p) if x is not None), default=None)
    want = []
    for p, _, h in rows:
        raw, head = (h or "").encode(), heads[h or ""]
        first = p == head
        want.append((p, "response" if first else "revisit", None if first else head, len(raw), warc.base32(hashlib.sha1(raw).digest()), raw if first else None))
    key = lambda r: (r[0] is None, r[0] or 0, r[3], str(r[5]))
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload)) for r in got), key=key) == sorted(want, key=key)
    assert warc.archive_pages(pages.where("false")).count() == 0


def test_warc_common_payloads_are_spread(spark, tmp_path, monkeypatch):
    rows = [(i, f"u{i}", "" if i % 3 == 0 else "common" if i % 3 == 1 else f"page {i // 6}") for i in range(600)] + [(598, "u598", "common")] * 50
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    heads = {}
    for p, _, h in rows:
        heads[h] = max(heads.get(h, p), p)
    want = sorted((p, len(h), "response" if heads[h] == p else "revisit", None if heads[h] == p else heads[h], h if heads[h] == p else None) for p, _, h in rows)
    for share in (4096, 2, 1):  # all shared payloads are broadcast, the two common ones or none is
        monkeypatch.setattr(warc, "HOT", share)
        folder = f"file://{tmp_path}/w{share}"
        warc.write_archives(pages, folder)
        got = warc.read_archives(spark, folder).collect()
        assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload).decode()) for r in got) == want
        assert {r.payload_digest for r in got} == {warc.base32(hashlib.sha1(h.encode()).digest()) for _, _, h in rows}


def test_warc_damage_is_found():
    assert warc.unchunked(warc.chunked(b"a" * 20000, 7000)) == b"a" * 20000 and warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


# ---------------------------------------------------------------- 4 decontamination


def test_decontamination(spark, docs, none, tables):
    items = [(1, PASSAGE), (2, "eight nine ten"), (3, ""), (4, None), (5, "Two words"), (2, "eight nine ten"), (6, PROSE[:200]), (None, PASSAGE), (7, PASSAGE.upper()), (8, "a a a a a a a a a a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.decontaminated([r for r in texts(docs) if r[0]], [i for i in items if i[0]])
    got = {r[0]: (r[1], r[2], r[3], r[6]) for r in decontaminate.find_matches(docs.where("doc_id is not null"), bench).collect()}
    assert got == want
    blocks = {r[0]: (r[1], r[2], r[3], r[6]) for r in decontaminate.find_matches(docs.where("doc_id is not null"), bench, block_bytes=30).collect()}
    assert blocks == want
    assert decontaminate.find_matches(docs, bench).count() == len(ROWS) and decontaminate.find_matches(none, bench).count() == 0
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    bad = {d for d, v in want.items() if v[2] >= 2}
    assert bad and {r.doc_id for r in clean.collect()} == {d for d, _, _ in ROWS} - bad
    assert decontaminate.decontaminate(docs, bench.where("false")).count() == len(ROWS)
    got = {r[0]: (r[1], r[2], r[3], r[6]) for r in decontaminate.find_matches(tables["documents"], tables["benchmark"]).collect()}
    assert got == brute.decontaminated(texts(tables["documents"]), [tuple(r) for r in tables["benchmark"].select("item_id", "text").collect()])
    longest = {r.doc_id: r.longest_match for r in decontaminate.find_matches(docs, bench.where("item_id = 1")).collect()}
    assert longest[14] == 10 and longest[12] == 0


def test_decontamination_places_the_longest_match_in_its_item(spark, docs, tables, monkeypatch):
    def longest(text, items):
        w, best = brute.words(text), (0, None, None)
        for item, t in items:
            v = brute.words(t)
            for i in range(len(w)):
                for j in range(len(v)):
                    n = 0
                    while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                        n += 1
                    if n and n >= min(8, len(v)):
                        best = min(best, (-n, i, item), key=lambda x: (x[0], x[1] or 0, x[2] or 0))
        return -best[0], best[2], best[1]

    r = random.Random(8)
    some = [(100 + i, " ".join(r.choice("abc") for _ in range(r.randrange(60)))) for i in range(60)] + [(200, "x " + PASSAGE + " y"), (201, "two three four five six seven eight nine ten eleven twelve")]
    items = [(i, " ".join(r.choice("abc") for _ in range(r.randrange(1, 25)))) for i in range(1, 12)] + [(20, PASSAGE), (21, "eight nine ten"), (22, "three four five six seven eight nine ten eleven")]
    want = {d: longest(t, items) for d, t in some}
    assert want[200] == (10, 20, 1) and want[201] == (9, 20, 0)
    df, bench = spark.createDataFrame(some, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (32 << 20, 30):
        assert {x.doc_id: (x.longest_match, x.match_item, x.match_start) for x in decontaminate.find_matches(df, bench, block_bytes=block).collect()} == want
    block = decontaminate.build_block(*map(list, zip(*items, strict=True)))
    monkeypatch.setattr(decontaminate, "_PLACES", 50)
    few = decontaminate._search(pa.record_batch([pa.array([d for d, _ in some]), pa.array([t for _, t in some])], ["doc_id", "text"]), [block], 8)
    assert {x["doc_id"]: (x["longest_match"], x["match_item"], x["match_start"]) for x in few.to_pylist()} == want


def test_work_of_a_chunk_does_not_grow_with_the_benchmark():
    r = random.Random(9)
    vocabulary = [f"v{i}" for i in range(30_000)]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = " ".join(r.choices(vocabulary, weights, k=100_000))
    words = split_words(pa.array([text]))
    end = np.full(len(words.hash), len(words.hash))
    took = {}
    for items in (150, 15_000):
        block = decontaminate.build_block(list(range(items)), [" ".join(r.choices(vocabulary, weights, k=100)) for _ in range(items)])
        decontaminate.occurrences(words.hash, end, block)
        start = time.process_time()
        decontaminate.occurrences(words.hash, end, block)
        took[items] = time.process_time() - start
    assert took[15_000] < 6 * took[150] + 0.3, took


# ---------------------------------------------------------------- 5 language


def test_language(spark, docs, none):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    held = out[out["held_out"] & out["lang"].notna()]
    assert len(held) > 100 and (held["lang"] == held["lang_pred"]).mean() > 0.95 and out["score"].between(0, 1).all()
    got = [(r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs).collect()]
    assert len(got) == len(ROWS)
    for (d, pred, score), (_, text, _) in zip(sorted(got, key=str), sorted(((d, t, x) for d, t, x in ROWS), key=lambda r: str((r[0],))), strict=True):
        if d is not None:
            assert (pred == "und") == (not any(map(str.isalpha, text or ""))), (d, pred, score)
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_filter_against_plain_sets(spark):
    """What the filter returns for each n-gram and text, against counts and sets in plain Python."""
    r = random.Random(12)
    stems = ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(400)]
    names = [f"l{i:03d}" for i in range(70)]  # more than a mask holds
    # languages 0 to 2 are related: they share most of their words
    words_of = {k: (stems[:12] if i < 3 else []) + r.sample(stems, 6) for i, k in enumerate(names)}
    rows = [(" ".join(r.choices(words_of[k], k=40)), k) for k in names for _ in range(6)]
    model = langid.learn(spark.createDataFrame(rows, "text string, lang string"))
    assert model["langs"] == names and model["masks"].shape[0] == 2
    counts = {k: brute.grams(t for t, x in rows if x == k) for k in names}
    rates = {k: {g: n / sum(c.values()) for g, n in c.items()} for k, c in counts.items()}
    every = {g: sum(x.get(g, 0) for x in rates.values()) for c in counts.values() for g in c}
    kept = {k: {g for g, x in rates[k].items() if x >= min(1, langid.TYPICAL / len(names)) * every[g] * (1 - 1e-9) and x >= langid.RATE} for k in names}
    assert len(kept["l000"] & kept["l001"] & kept["l002"]) > 20
    everything = sorted(every)
    coded = np.array([int.from_bytes(g, "big") for g in everything], np.uint32)
    at = langid.probes(coded, model["masks"].shape[1])
    wrong = 0
    for i, k in enumerate(names):
        hit = np.ones(len(coded), bool)
        for a in at:
            hit &= ((model["masks"][i // 64][a] >> np.uint64(i % 64)) & np.uint64(1)) == 1
        found = {g for g, h in zip(everything, hit, strict=True) if h}
        assert kept[k] <= found
        wrong += len(found - kept[k])
    assert wrong < 0.01 * len(names) * len(everything)
    tests = [(" ".join(r.choices(words_of[k], k=30)), k) for k in names for _ in range(3)]
    got, score = langid.predict(pa.array([t for t, _ in tests]), model)
    for (t, k), g, s in zip(tests, got, score, strict=True):
        seen = brute.grams([t])
        total = sum(seen.values())
        share = {x: sum(n for q, n in seen.items() if q in kept[x]) / total for x in names}
        best = max(share.values())
        assert share[g] >= best - 0.02 and abs(s - share[g] / sum(share.values())) < 0.03, (k, g)
    assert sum(g == k for (_, k), g in zip(tests, got, strict=True)) / len(tests) > 0.9


# ---------------------------------------------------------------- 6 PII

PII_TEXTS = [
    "a@b.c@d.e x@@y.zz @handle a.b+c%d@e-f.g.h. .@a.b a@b", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.255 1.2.3 1..2.3.4 12.12.12.12.", "4111-1111 1111 1111 4111111111111111 4111 1111 1111 1112 4111  1111 1111 1111 0000000000000000000 00000000000000000000",
    "+1 (523) 555-1055 +12345678 ++123456789 +1 +1-2 +123 456 789 012 345 6 +1.5.6.7.8.9.1.2.)", "token = \"abcd1234efgh\" API_KEY: zzz99zzzz1 password hunter2 account no. 12345678", "see http://a.b/c?d=e. and ftp://x", "é@a.bc ü+4912345678 日本a@b.co", "+" * 50 + "1" * 40, "9" * 300 + "@" + "a" * 300, "",
]


def test_pii_base_spans_are_those_of_the_patterns(docs, tables):
    anchors = pii.automaton()
    many = [*PII_TEXTS, *(t for _, t, _ in ROWS), *(t for _, t in texts(tables["documents"]))]
    r = random.Random(3)
    many += ["".join(r.choice("a1.@+- ()0é4") for _ in range(r.randrange(80))) for _ in range(3000)]
    for t in many:
        got = pii.find(t, anchors)
        assert {k: got[k] for k in pii.BASE} == brute.personal(t), t


def test_pii_takes_whole_values_and_handles():
    anchors = pii.automaton()
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dBjftJeZ4CVP-mB92K27uhbUJU1p1r_wW1g"
    for value in ("a1" * 68, "k" * 5000 + "123", jwt, "YWJj1234ZGVmZ2hp==", "abcd1234"):
        for text, end in ((f"token={value}", ""), (f"token = '{value}'", "'"), (f"my token: {value}. Next", ". Next")):
            (span,) = pii.find(text, anchors)["account"]
            assert text[slice(*span)] == value and text[span[1] :] == end
    assert pii.find("@" + "h" * 40 + " x", anchors)["handle"] == [(0, 41)]
    text = "token=" + "x" * 200 + " token=abc1234 token/my-token=abcd1234"
    assert pii.find(text, anchors)["account"] == [(len(text) - 8, len(text))]
    start = time.process_time()
    assert not pii.find("tokenno/" * 200_000 + "token=" + "x/token-no=" * 100_000, anchors)["account"]
    assert time.process_time() - start < 20


def test_pii_query_and_mask(docs, none):
    got = {r.doc_id: r for r in pii.scan(docs.where("doc_id is not null")).collect()}
    r = got[16]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1) and "account:" in r.spans and r.spans.startswith("email:5:13,ip:")
    base = ",".join(x for x in r.spans.split(",") if x.split(":")[0] in pii.BASE)
    assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and got[5].base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = {r.doc_id: r for r in pii.mask(docs.where("doc_id is not null")).collect()}
    assert masked[16].text == 'mail <email>, <ip>, <card> <phone> token = "<account>"' and masked[16].n_chars == len(masked[16].text)
    assert masked[5].text is None and masked[10].text == LONG
    assert pii.scan(none).count() == 0 and pii.mask(none).columns == none.columns
    assert pii.redact("ab", {"email": [(0, 2)], "ip": [(1, 2)]}, ("email", "ip")) == "<email>"


# ---------------------------------------------------------------- 7 token store


def test_training_order(spark, docs, none, tmp_path):
    for n in (1, 2, 3, 5, 64, 1000):
        x = tokenstore.feistel(np.arange(n), n, 9)
        assert sorted(x.tolist()) == list(range(n)) and (tokenstore.feistel(x, n, 9, inverse=True) == np.arange(n)).all()
    assert (tokenstore.feistel(np.arange(1000), 1000, 1) != tokenstore.feistel(np.arange(1000), 1000, 2)).any()
    folder = f"file://{tmp_path}/t"
    t = tokenstore.default_tokenizer()
    m = tokenstore.write_training_order(docs, folder, length=16, shard=100)
    whole = tokenstore.read_slots(folder, 0, m["sequences"])
    assert len(whole) == m["sequences"] and m["shards"] == -(-m["sequences"] // 100)
    assert (tokenstore.read_slots(folder, 95, 205) == whole[95:205]).all()
    back = {}
    for r in whole:
        back.setdefault(int(r["doc_id"]), []).append((int(r["sequence"]), r["ids"][: r["tokens"]].tolist()))
    for d, text, _ in ROWS:
        if d is not None and d != 17:
            assert [x for _, s in sorted(back[d]) for x in s] == [*t._tokens().encode_ordinary(text or ""), t.end]
    assert len(back[17]) == 2
    assert tokenstore.read_training_order(spark, folder, m).count() == m["sequences"]
    assert tokenstore.training_order(none).count() == 0
    with pytest.raises(FileExistsError):
        tokenstore.write_training_order(docs, folder, length=16, shard=100)
    # attempts that come late, or after a job that died: the shard is there once and whole
    fs, path = tokenstore.filesystem(folder)
    first = tokenstore.shard_path(path, 0)
    held = open(first, "rb").read()
    open(f"{path}/.0-late", "wb").write(held)
    tokenstore.commit(fs, f"{path}/.0-late", first, len(held))
    assert open(first, "rb").read() == held and not (tmp_path / "t/.0-late").exists()
    (tmp_path / "t/manifest.json").unlink()
    open(first, "wb").write(b"x" * len(held))
    tokenstore.write_training_order(docs, folder, length=16, shard=100)
    assert open(first, "rb").read() == held
    odd = ["a  b", " a", "a ", "a \n b c", "it's 's", "x  y", "", "日 本"]
    odd += ["x <|never allowed|> y", "ab" + " " * 9000 + "c d", "x" + " \n" * 4000 + "y" + " " * 5000, "\u3000" * 5000 + "z\x1c" + " " * 4999 + "!"]
    plain = [t._tokens().encode_ordinary(x) for x in odd]
    assert t.count(odd) == [len(x) + 1 for x in plain] and [x.tolist() for x in t.encode(odd)] == [[*x, t.end] for x in plain]
    assert [[int(i) for p in t._pieces(x) for i in p] for x in odd] == plain
    # all blanks but the last, a blank with x, the end id; two million are more than the library's look-ahead can take
    assert [len(t._tokens().encode_ordinary(" " * 9000 + "x")) + 1, *t.count([" " * 2_000_000 + "x"])] == [8_999 + 2, 1_999_999 + 2]


# ---------------------------------------------------------------- 8 media


def test_media(spark, docs, none, tmp_path):
    got = media.media_features(docs).collect()
    assert len(got) == len(ROWS)
    nulls = sorted((t or "" for d, t, _ in ROWS if d is None), key=len)
    for r in sorted(got, key=lambda r: r.n_bytes):
        text = nulls.pop(0) if r.doc_id is None else next(t for d, t, _ in ROWS if d == r.doc_id)
        raw = (text or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert not nulls
    by = {r.doc_id: r for r in got}
    assert by[1].media_sha256 == by[2].media_sha256 and by[1].feature == by[2].feature and by[5].feature == by[6].feature
    assert media.media_features(none).count() == 0
    folder = f"file://{tmp_path}/m"
    media.write_media(docs, folder, archive_bytes=20_000)
    small = media.read_media(spark, folder, range_bytes=3000)
    assert small.count() == len(ROWS) and small.where("error is not null").count() == 0
    uri, offset = small.where("name like '%/1.png'").select("uri", "offset").first()
    import tarfile

    with tarfile.open(uri.removeprefix("file://")) as tar:
        assert any(x.name.endswith("/1.png") and x.offset == offset for x in tar)
    with open(uri.removeprefix("file://"), "r+b") as f:
        f.truncate(offset + 100)
    assert media.read_media(spark, folder).where("error is not null").count() >= 1
    with pytest.raises(ValueError):
        media.from_png(media.to_png(b"a" * 576)[:-20] + b"x" * 20)


def test_ranges_cover_every_byte_once():
    r = random.Random(1)
    for least, most in ((100, 50), (1, 7), (10_000, 1), (3, 10**6)):
        files = [(f"f{i}", r.randrange(0, 900)) for i in range(40)]
        parts = media.plan_ranges(files, least, most)
        assert len(parts) <= max(most, sum(n for _, n in files) // least) + 1 and all(parts)
        for uri, n in files:
            mine = sorted((a, b) for p in parts for u, a, b in p if u == uri)
            assert [a for a, _ in mine] == [0, *(b for _, b in mine[:-1])][: len(mine)] and (mine[-1][1] if mine else 0) == n
    assert media.plan_ranges([], 5) == []


# ---------------------------------------------------------------- 9 near duplicates


def test_near_duplicates(spark, docs, none, tables):
    known = docs.where("doc_id is not null")
    got = {r.doc_id: r for r in bagminhash.near_duplicates(known).collect()}
    want = brute.classes(list(dict(texts(known)).items()))
    assert {d: r.class_id for d, r in got.items()} == want
    assert got[3].exact_id == 1 and got[4].class_id == 1 and got[11].class_id == 10 and got[9].class_id == 8 and got[13].class_id == 12
    assert bagminhash.near_duplicates(docs).count() == len(got) and bagminhash.near_duplicates(none).count() == 0
    real = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(tables["documents"]).collect()}
    assert real == brute.classes(texts(tables["documents"]))
    blocks = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(tables["documents"], small=2).collect()}
    assert blocks == real


def test_repeated_rows_are_compared_once(spark):
    a = " ".join(f"w{i}" for i in range(200))
    pair = [(1, a), (2, a + " tail")]
    want = {1: (1, 1), 2: (2, 1), 3: (3, 3)}

    def classes(times):
        df = spark.createDataFrame([*pair, (3, "else " * 9)], "doc_id long, text string").join(spark.range(times).select(F.lit(1)), how="cross").repartition(4)
        start = time.process_time()
        compared = []
        real = bagminhash._verified

        def counted(pairs, sets, threshold):
            compared.append(sets.count())
            return real(pairs, sets, threshold)

        bagminhash._verified = counted
        try:
            got = {r.doc_id: (r.exact_id, r.class_id) for r in bagminhash.near_duplicates(df).collect()}
        finally:
            bagminhash._verified = real
        return got, compared, time.process_time() - start

    for times in (1, 1000):
        got, compared, _ = classes(times)
        assert got == want and max(compared) <= 3, (times, compared)


def test_classes_where_one_key_holds_most_rows(spark):
    r = random.Random(6)
    base = [f"t{i}" for i in range(120)]
    texts = [" ".join(base)] * 3000 + [" ".join([*base, f"extra{i}"]) for i in range(1500)] + [" ".join(f"u{i}x{k}" for k in range(30)) for i in range(800)]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    got = {x.doc_id: x.class_id for x in bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == {i: 0 if i < 4500 else i for i in range(len(texts))}


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(1)
    a = r.integers(0, 6, 400)
    b = np.where(r.random(400) < 0.25, r.integers(0, 9, 400), a)
    keys = np.arange(400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    doc = np.repeat([0, 1], 400)
    count = np.concatenate([a, b])
    some = count > 0
    s = bagminhash.signatures(doc[some], np.concatenate([keys, keys])[some], count[some], 2, 4096)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - true) < 0.03 and np.isfinite(s).all()


def test_components(spark):
    r = random.Random(5)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, x) for x in range(4000, 4050)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.root for r in bagminhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}


# ---------------------------------------------------------------- 10 SentencePiece


def test_sentencepiece_equals_the_library(spark, docs, none, tables):
    import sentencepiece as library

    sp = library.SentencePieceProcessor(model_file=sentencepiece.default_model())
    r = random.Random(2)
    odd = [" ", "  a", "a  b \n c\n\nd\n", "x\0y", "日本語€🙂 ▁x▁", "a" * 3000, "ab" * 900 + "." * 300, *("".join(r.choice("ab c\né▁🙂.,=1") for _ in range(r.randint(1, 150))) for _ in range(300))]
    extra = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    for df in (docs.select("doc_id", "text", "ids", "score"), extra, tables["documents"]):
        pairs = dict(texts(df))
        out = sentencepiece.encode(df)
        for x in out.where("doc_id is not null").collect():
            t = pairs[x.doc_id]
            assert x.ids == (None if t is None else sp.encode(t)) and x.n_tokens == len(x.ids or []) and x.decoded is (None if t is None else True)
        back = {x.doc_id: x.text for x in sentencepiece.decode(out).collect()}
        assert all(back[d] == (t and t.replace("▁", " ")) for d, t in pairs.items() if d is not None)
    assert sentencepiece.encode(none).columns == ["doc_id", "lang", "source", "n_chars", "score", "rep", "class_id", "ids", "n_tokens", "decoded"]


def test_sentencepiece_keeps_a_bounded_number_of_bytes(monkeypatch):
    import sentencepiece as library

    monkeypatch.setattr(sentencepiece, "CACHE_BYTES", 100_000)
    sp = library.SentencePieceProcessor(model_file=sentencepiece.default_model())
    coder = sentencepiece.Encoder(sentencepiece.Model.load(sentencepiece.default_model()))
    r = random.Random(7)
    for _ in range(20):
        texts = ["".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(1000)) for _ in range(4)] + [" ".join(f"w{r.randrange(10**6)}" for _ in range(300))]
        got = coder.encode_texts(texts)
        assert [np.frombuffer(x, "<i4").tolist() for x in got] == [sp.encode(t) for t in texts]
        assert max(map(len, coder.cache)) <= sentencepiece.LONG and coder.cached < 300_000
        import sys

        assert coder.cached == sum(sys.getsizeof(k) + sys.getsizeof(v) + 100 for k, v in coder.cache.items())


def test_viterbi_forms_agree_with_brute_force(spark):
    pieces = {"▁": -5.0, "a": -3.1, "b": -3.2, "c": -3.3, "ab": -4.05, "bc": -4.9, "abc": -8.2, "▁a": -4.4, "▁ab": -7.0, "ca": -5.7}
    model = sentencepiece.Model(["<unk>", *pieces], [0.0, *pieces.values()], [sentencepiece.UNKNOWN, *[sentencepiece.NORMAL] * len(pieces)], sentencepiece.UNIGRAM)
    e = sentencepiece.Encoder(model)
    r = random.Random(4)
    words = sorted({"▁" + "".join(r.choice("abcx") for _ in range(r.randint(0, 9))) for _ in range(60)})

    def best(w):
        if not w:
            return 0.0, []
        options = []
        for n in range(1, len(w) + 1):
            p = w[:n]
            if p in pieces or n == 1:
                s, rest = best(w[n:])
                options.append((s + pieces.get(p, e.no_piece), [model.pieces.index(p) if p in pieces else 0, *rest]))
        return max(options)

    score = lambda ids: sum(model.scores[i] if i else e.no_piece for i in ids)
    coded = e.encode_units(words)
    for w, c in zip(words, coded, strict=True):
        assert abs(score(np.frombuffer(c, "<i4").tolist()) - best(w)[0]) < 1e-9
        assert abs(score(np.frombuffer(e._long(w), "<i4").tolist()) - best(w)[0]) < 1e-9
    table = spark.createDataFrame([(p, model.pieces.index(p), s) for p, s in pieces.items()], "piece string, id int, score double")
    for row in sentencepiece.lattice_words(spark.createDataFrame([(w,) for w in [*words, "", None, words[0]]], "word string"), table, 3, e.no_piece).collect():
        assert abs(score([max(i, 0) for i in row.path]) - best(row.word)[0]) < 1e-9
