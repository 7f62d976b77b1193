"""Every stage of the pipeline against brute force on its own input."""

import re

import corpus_pipeline
from changeweave.llm import decontaminate, mixing, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    bench = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r.text or "").translate({i: i + 32 for i in range(65, 91)})) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text or "" for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        kept = [r.doc_id for r in after.collect()]
        assert (after.columns == columns) if k < 4 else (after.columns[:-1] == columns), name
        if k == 0:
            model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(kept) == {r.doc_id for r in toxicity.score(docs, model, ["doc_id"]).where("predicted = 0").collect()} and len(kept) < len(before)
        elif k == 1:
            best = {}
            for i, t in before.items():
                n = re.sub(r"[\x20\x09-\x0D]", "", t)
                best[n] = min(best.get(n, (1, 0)), (-len(t), i))
            assert sorted(kept) == sorted(i for _, i in best.values())
        elif k == 2:
            words = {i: t.translate({c: c + 32 for c in range(65, 91)}).split() for i, t in before.items()}
            sets = {i: {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set() for i, w in words.items()}
            par = {i: i for i in sets}
            ids = sorted(sets)
            for a in ids:
                for b in ids:
                    n = len(sets[a] & sets[b]) if a < b else 0
                    if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                        x, y = par[a], par[b]
                        par = {i: min(x, y) if v in (x, y) else v for i, v in par.items()}
            assert sorted(kept) == [i for i in ids if par[i] == i]
        elif k == 3:
            for i, t in before.items():
                w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)}))
                own = {n: {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} for n in {min(8, len(b)) for b in bench if b}}
                n_items = sum(any(tuple(b[j : j + 8]) in own[min(8, len(b))] for j in range(max(len(b) - 7, 1))) for b in bench if b)
                assert (i in kept) == (n_items == 0)
        else:
            plan = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
            assert {i: kept.count(i) for i in before} == plan
        docs = after


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and out.count() > 0


def test_passages_of_one_item_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    judged = decontaminate.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    quoting = {r.doc_id for r in judged if r.n_items == 1}
    kept = {r.doc_id for r in corpus_pipeline.without_benchmark(spark, docs, SF).collect()}
    assert quoting and kept == {r.doc_id for r in judged if r.n_items == 0}


def test_planted_passage_goes_with_one_item(spark, tmp_path):
    """A document that quotes one item goes; the flag of the operator itself asks for two."""
    passage = " ".join(f"q{i}" for i in range(12))
    spark.createDataFrame([(1, passage), (2, "some other item of eight words or more here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, f"before it {passage.upper()} and after"), (2, "clean words only"), (3, None), (4, ""), (None, passage)], "doc_id long, text string")
    kept = corpus_pipeline.without_benchmark(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4] and kept.columns == docs.columns


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids, texts and sources, repeated rows, clashing columns and an empty table, through every stage."""
    spark.createDataFrame([(1, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "never in any text here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, None, None, "a", 0, "x"), (2, "", "en", None, 0, "x"), (None, "a text without id", "en", "a", 0, "y"), (3, "one two", None, "b", 7, "z"), (3, "one two", None, "b", 7, "z"), (4, "w " * 30_000, "en", "b", 0, "z")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, repetition string")
    for docs in (odd, odd.limit(0)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            n = docs.count()
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == odd.columns + ["mix_repetition"] * (k == 4) and (k == 4 or docs.count() <= n)
