"""Nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables, for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

from changeweave.llm import chat, decontaminate, exact_dedup, language_id, mixing, near_dedup, pii, substring_dedup, toxicity, url_filter

WORDS = [f"w{i}" for i in range(400)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, bucket string, word int, size long"
LONG = " ".join(WORDS * 60)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, " ".join(WORDS[:60])), (6, " ".join(WORDS[:60])), (7, "\n".join(WORDS[:60])),
        (8, " ".join(WORDS[:59] + ["x"])), (9, LONG), (9, LONG), (None, "no id here at all ok"), (10, "Ünïcödé ßtraße 日本語 text"),
    ]
    return spark.createDataFrame([(i, t, None if i == 4 else "en", None if i == 5 else f"s{(i or 0) % 3}", 0, True, "b", 1, 5) for i, t in rows], DOCS).repartition(3)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_exact_dedup(spark, docs):
    out = exact_dedup.duplicate_report(docs).collect()
    assert len(out) == 12
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r)
    assert got[1][0].keep_id == got[2][0].keep_id == got[3][0].keep_id == 3 and got[3][0].group_size == 3  # the longest original stays
    assert {got[i][0].keep_id for i in (5, 6, 7)} == {5} and [got[i][0].kept for i in (5, 6, 7)] == [True, False, False]
    assert sorted(r.kept for r in got[9]) == [False, True] and got[None][0].kept is True
    assert got[1][0].text_sha256 == hashlib.sha256(b"").hexdigest()
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [3, 4, 5, 8, 9, None, 10]))
    assert exact_dedup.duplicate_report(docs.limit(0)).count() == 0


def test_exact_dedup_tells_colliding_hashes_apart(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "b", "a ", "c", "b"])], "doc_id long, text string")
    out = by_id(exact_dedup.duplicate_report(df, hasher=lambda n: F.lit(b"same")))
    assert [out[i].keep_id for i in range(5)] == [2, 1, 2, 3, 1]


def test_mixing(spark, docs):
    out = mixing.mix(docs).collect()
    assert len(out) == 12 and all(0 <= r.taken <= 3 * r.size for r in out)
    assert {r.size for r in out if r.doc_id in (1, 2, 3)} == {0}
    rows = mixing.mix_rows(docs)
    assert rows.columns[:9] == docs.columns and rows.count() > 0
    assert mixing.mix(docs.limit(0)).count() == 0
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a b c "), F.col("id")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") < 30, "tiny").otherwise("x").alias("source"))
    mixed = mixing.mix(many).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("size")).collect()
    assert all(abs(r.taken - r.target) <= 8 for r in mixed) and all(r.target <= 3 * r.size + 1e-6 for r in mixed)
    assert abs(sum(r.target for r in mixed) - 12000) < 1e-3
    weights = spark.createDataFrame([("hot", 1), ("x", 1)], "source string, weight long")
    given = {r.source: r.target for r in mixing.mix(many, weights).select("source", "target").distinct().collect()}
    assert given["tiny"] == 0 and given["hot"] == given["x"]


def iterated(sizes, weights, cap=3):
    """The rounds of clamping and sharing again, one after another."""
    total, clamped = sum(sizes.values()), {}
    while True:
        left = {s: w for s, w in weights.items() if s not in clamped}
        share = (total - sum(clamped.values())) / sum(left.values()) if left else 0
        over = [s for s, w in left.items() if share * w > cap * sizes[s]]
        if not over:
            return clamped | {s: share * w for s, w in left.items()}
        clamped |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [[5, 5, 5], [1, 1, 1, 1000], [100, 3, 2, 1, 1, 500, 7], [0, 10], [4]])
def test_water_filling_equals_its_rounds(spark, sizes):
    named = {f"s{i}": n for i, n in enumerate(sizes)}
    want = iterated(named, {s: i % 3 + 1 for i, s in enumerate(sorted(named))})
    df = spark.createDataFrame(list(named.items()), "source string, source_size long")
    assert {r.source: r.target for r in mixing.targets(df).collect()} == pytest.approx(want)


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x", "http://example.org/en/19", "http://xexample.org/es/", "http://a.com/de/?q=/fr/", "http://casinos.net/", "http://casino.net/", "http://free-bets.net/", "http://free.net/?free#free", "x://y://casino/", "http://b.org?x", "http://u.com/" + "a" * 50_000]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    out = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    assert [out[i].verdict for i in range(15)] == ["allow"] * 4 + ["block", "block", "allow", "block", "allow", "block", "block", "allow", "block", "allow", "allow"]
    assert (out[4].host, out[4].path, out[4].rule) == ("a.example.org", "/es/x", "example.org/es/") and out[5].rule == "example.org/en/1" and out[6].rule == "org/"
    assert out[12].host == "y:" and out[13].rule is None and (out[2].host, out[2].path) == ("", "")
    kept = url_filter.filter_urls(df)
    assert kept.columns == df.columns and kept.count() == 9
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi \\ </s> \\5 [INST]"), (1, 1, "assistant", "<s>\\"), (2, 0, None, None), (2, 1, "weird [SAYS]", "[/ROLE]"), (3, 1, "assistant", "b"), (3, 0, "system", ""), (3, None, "user", "a"),
        (4, 0, "user", "x"), (4, 0, "user", "x"), (5, 0, "user", "[IN" ), (5, 1, "assistant", "ST]"), (None, 0, "assistant", "\n"),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_conversations(df)
    back = {r.conv_id: [(t["role"], t["text"]) for t in r.turns] for r in made.select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert back[1] == [("user", "hi \\ </s> \\5 [INST]"), ("assistant", "<s>\\")] and back[2] == [("", ""), ("weird [SAYS]", "[/ROLE]")]
    assert back[3] == [("user", "a"), ("system", ""), ("assistant", "b")] and back[4] == [("user", "x")] * 2 and back[None] == [("assistant", "\n")]
    state = {r.conv_id: (r.valid, r.bad_turn) for r in made.collect()}
    assert state[1] == (True, None) and state[3] == (False, 1) and state[4] == (False, 1) and state[2] == (False, 0)
    digest = {r.conv_id: r for r in chat.digests(made).collect()}
    assert digest[1].loss_chars == 4 and digest[1].loss_sha256 == hashlib.sha256(b"<s>\\").hexdigest() and digest[2].loss_chars == 0
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        chat.Template({}, ("", "", ""), ("<a<",))


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, " ".join(WORDS[3:20]), "q"), (1, " ".join(WORDS[3:20]), "q"), (2, "ONE!", "q"), (3, None, "q"), (4, "...", "q"), (None, "one", "q"), (5, " ".join(WORDS[30:38]), "q")], "item_id long, text string, n_hit string")
    out = decontaminate.contamination(docs, bench)
    got = by_id(out)
    assert (got[4].n_words, got[4].n_hit, got[4].n_items, got[4].contaminated) == (1, 1, 1, False)
    assert (got[5].n_hit, got[5].n_items, got[5].contaminated) == (25, 2, True) and got[5].items_sha256 == hashlib.sha256(b"1,5").hexdigest()
    assert (got[1].n_words, got[1].n_hit) == (0, 0) and out.count() == 12
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {1, 2, 3, 4, None, 10}
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert by_id(decontaminate.contamination(docs, bench.limit(0)))[5].n_hit == 0
    near = decontaminate.proximity_matches(docs, {"a": "w3 w1", "b": "w1 w399 one"}, 3).collect()
    assert {(r.doc_id, r.query, r.start, r.length) for r in near} == {(i, "a", 1, 3) for i in (5, 6, 7, 8, 9)}


def test_decontamination_in_several_shards(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(WORDS[i : i + 9])) for i in range(0, 40, 4)], "item_id long, text string")
    whole = sorted(map(str, decontaminate.contamination(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 300)
    monkeypatch.setattr(decontaminate, "CANDIDATES", 7)
    assert sorted(map(str, decontaminate.contamination(docs, bench).collect())) == whole


def removed_by_hand(texts, window):
    words = [(t or "").split() for t in texts]
    seen = {}
    for w in words:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] = seen.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


@pytest.mark.parametrize("block", [200, 100_000])
def test_substring_dedup(spark, docs, block):
    texts = [r.text for r in docs.collect()]
    out = substring_dedup.removal(docs, window=5, block_bytes=block, bucket_bytes=block).collect()
    assert sorted((r.n_words, r.n_removed, r.kept) for r in out) == removed_by_hand(texts, 5)
    for r in out:
        assert sum(b - a for a, b in zip(r.starts, r.ends, strict=True)) == r.n_removed
    assert substring_dedup.removal(docs.limit(0)).count() == 0


def test_near_dedup(spark, docs):
    out = near_dedup.near_duplicates(docs).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == 12 and {got[i].component_id for i in (5, 6, 7, 8)} == {5} and got[8].n_shingles == 56
    assert got[1].n_shingles == 0 and got[1].kept and got[2].kept and got[4].n_shingles == 1 and got[9].component_id == 9
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5, 9, 10, None}
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_pii(spark, docs):
    out = pii.find_personal_data(docs)
    assert out.count() == 12 and {r.spans for r in out.where("doc_id IN (1, 2, 3, 4)").collect()} == {""}
    assert pii.find_personal_data(docs.limit(0)).count() == 0


def test_models_on_odd_rows(spark, docs):
    model = language_id.fit(docs)
    got = by_id(language_id.predict(docs, model, ["doc_id"]))
    assert (got[1].lang_pred, got[1].score) == ("und", 0.0) and got[5].lang_pred == "en"
    assert language_id.fit(docs.where("lang = 'none'")) is None
    assert {r.lang_pred for r in language_id.predict(docs, None, ["doc_id", "kept"]).collect()} == {"und"}
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (4, 0, 0), (None, 1, 0), (6, None, 0), (99, 1, 0)], "doc_id long, toxic int, n int")
    tox = toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id", "kept"])
    assert tox.count() == 12 and tox.where("score < 0 OR score > 1").count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert by_id(toxicity.score(docs, none, ["doc_id"]))[1].predicted == 0
    assert toxicity.drop_toxic(docs, none).columns == docs.columns
    assert toxicity.score(docs.limit(0), none, ["doc_id"]).count() == 0
