"""Each stage of the corpus pipeline against a plain version, on the smallest tables and on awkward rows."""

import brute
import corpus_pipeline as pipeline
from keystrand.llm import quality
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def pairs(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, tmp_path):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    benchmark = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs, kept = documents, {}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        before = pairs(docs)
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == COLUMNS
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        kept[name] = docs
        if name == "quality_classifier":
            got = {d for d, _ in pairs(docs)}
            right = [(d in got) == bool(q) for d, q in labels.items()]
            assert sum(right) / len(right) > 0.9
        elif name == "minhash_near_dedup":
            want = {d for d, c in brute.classes(before).items() if d == c}
            assert sorted(d for d, _ in pairs(docs)) == sorted(want)
        elif name == "benchmark_decontamination":
            found = brute.decontaminated(before, benchmark)
            leaked = {d for d, v in found.items() if v[2]}
            assert {d for d, _ in pairs(docs)} == {d for d, _ in before} - leaked
        elif name == "pii":
            after = dict(pairs(docs))
            assert len(after) == len(before)
            for d, t in before:
                assert not any(brute.personal(after[d]).values())
                if not any(brute.personal(t).values()) and "token" not in t:
                    assert after[d] == t
        else:
            assert docs.count() == len(before) and docs.where("not decoded").count() == 0
    result = pipeline.run(spark, SF)
    assert sorted(r.doc_id for r in result.collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_stages_take_awkward_rows(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long, ids int, root int, score int"
    rows = [(1, "same text here is long enough", "en", "s", 1, 0, 0, 0)] * 3 + [(None, None, None, None, None, None, None, None), (None, "x", "en", "s", 1, 0, 0, 0), (2, "", "en", "s", 0, 0, 0, 0), (3, None, "en", "s", 0, 0, 0, 0), (4, "w " * 30_000, "en", "s", 9, 0, 0, 0)]
    full = spark.createDataFrame(rows, kind)
    for df, n in ((full, 6), (full.where("false"), 0)):
        good = pipeline.STAGES[0][1](spark, df, SF)
        scored = quality.score_quality(df, spark.read.parquet(f"{SF}/labels.parquet"))
        assert good.columns == df.columns and scored.count() == df.count() and good.count() == scored.where("predicted = 1").count()
        once = pipeline.STAGES[1][1](spark, df, SF)
        assert once.columns == df.columns and once.count() == n
        for _, stage in pipeline.STAGES[2:4]:
            assert stage(spark, df, SF).count() == df.count()
        assert pipeline.STAGES[4][1](spark, df, SF).where(F.col("ids").isNull()).count() == df.where("text is null").count()


def test_each_text_of_a_repeated_id_is_judged(spark):
    texts = [" ".join(f"{w}{i}" for i in range(40)) for w in "abc"]
    rows = [(1, texts[0]), (2, texts[1]), (2, texts[0]), (2, texts[1]), (3, texts[2]), (3, texts[1]), (3, None), (4, "one of its own"), (None, texts[0])]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.near_duplicate_stage(spark, docs, SF)
    assert out.columns == docs.columns
    want = [(1, texts[0]), (2, texts[1]), (3, texts[2]), (3, None), (4, "one of its own"), (None, texts[0])]
    assert sorted(pairs(out), key=str) == sorted(want, key=str)


def test_planted_passages_go_and_clean_documents_stay(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    long = [t for _, t in items if len(brute.words(t)) >= 12][:20]
    assert long
    plain = " ".join(f"plain{i}" for i in range(60))
    planted = [(i, f"{plain} {t} {plain}") for i, t in enumerate(long)]
    part = [(100 + i, f"{plain}, {'-'.join(brute.words(t)[2:10])}; {plain}") for i, t in enumerate(long)]
    short = [(200 + i, f"{plain} {' '.join(brute.words(t)[2:9])} {plain}") for i, t in enumerate(long)]
    windows = {tuple(w[i : i + 8]) for _, t in items for w in [brute.words(t)] for i in range(max(1, len(w) - 7))}
    sizes = {len(w) for w in windows}
    def clean(text):
        w = brute.words(text)
        return not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    short = [(d, t) for d, t in short if clean(t)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in [*planted, *part, *short, (300, plain)]], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in pipeline.decontamination_stage(spark, docs, SF).collect()} == {d for d, _ in short} | {300}
