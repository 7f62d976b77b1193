"""Held-out accuracy, brute force and exact round trips where SQL can't say it."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from changeweave.llm import language_id, near_dedup, pii, substring_dedup, toxicity
from changeweave.llm.common import crc_bucket_py

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    rows = language_id.op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (crc_bucket_py(r.doc_id, 3) == 1) for r in rows) and len(rows) == 1000
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = toxicity.op4_toxicity(spark, SF).collect()
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 1000 and sum(a == b for a, b in held) >= 0.95 * len(held)


def test_fuzzy_matching():
    m = toxicity.Matcher({"stupid": 1.0, "scum": 1.0, "worthless": 2.0}, {"lowei": 3.0})
    assert m.find("stupid") == ("exact", "stupid", 1.0) and m.find("scum")[0] == "exact"
    for near in ("stupd", "stupidd", "stup1d", "atupid", "tupid"):
        assert m.find(near)[:2] == ("fuzzy", "stupid")
    assert m.find("wrthlss") == ("fuzzy", "worthless", 2.0) and m.find("loweischaft") == ("stem", "lowei", 3.0)
    assert m.find("stpd") is None and m.find("scam") is None and m.find("") is None


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=9))
def test_automaton_equals_edit_distance(token):
    words = {"abcab": 1.0, "ccc": 1.0, "abcabcabc": 1.0, "bbbbb": 1.0}
    want = {w for w in words if edits(token, w) <= toxicity.tolerance(w)}
    hit = toxicity.Matcher(words, {}).find(token)
    assert (hit is None) == (not want) and (hit is None or hit[1] in want)


def test_quotation():
    found = toxicity.Found(toxicity.Matcher({"idiot": 2.0}, {}))
    direct, quote = toxicity.features("you are an idiot", found), toxicity.features('she said the word "idiot" was unkind', found)
    assert direct[0] == 2.0 and direct[3] == 0 and quote[0] == 0 and quote[3] == 2.0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_by_hand(text):
    def fits(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        return True if kind == "email" else 16 <= len(digits) <= 19 and pii.luhn(digits) if kind == "card" else 8 <= len(digits) <= 15

    return {k: [m.span() for m in re.finditer(p, text) if fits(k, m.group())] for k, p in PATTERNS.items()}


@settings(max_examples=600, deadline=None)
@given(st.text("ab_@.-+1250 ()%", max_size=60))
def test_base_spans_equal_plain_patterns(text):
    assert pii.base_spans(text) == base_by_hand(text)


def test_base_spans_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000):
        pii.base_spans(text)


def test_pii_query_equals_brute_force(spark):
    texts = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    rows = pii.op9_pii(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = base_by_hand(texts[r.doc_id] or "")
        joined = [f"{k}:{s}:{e}" for k in PATTERNS for s, e in spans[k]]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest() and set(joined) <= set(r.spans.split(",")) | {""}
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(len(spans[k]) for k in PATTERNS)


def test_bootstrapping_finds_unseen_identifiers(spark):
    rows = [(i, f"my contact number is +1 (555) 123-{4000 + i} thanks") for i in range(30)] + [(100, "my contact number is 5551234567 thanks"), (101, "the year 2023 was 1234567 long")]
    out = {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[100] == "phone:21:31" and out[101] == "" and out[3] == "phone:21:38"


def test_window_hashes():
    r = np.random.default_rng(1)
    words = r.integers(0, 50, 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = substring_dedup.window_hashes(words, 3)
    seen = {}
    for i in range(len(words) - 2):
        assert seen.setdefault(tuple(words[i : i + 3].tolist()), h[i]) == h[i]
    assert len(set(seen.values())) == len(seen) and len(substring_dedup.window_hashes(words[:2], 3)) == 0


def test_near_dedup_equals_brute_force(spark, monkeypatch):
    r = random.Random(3)
    docs = []
    for base in range(12):
        words = [f"b{base}x{r.randrange(300)}" for _ in range(120)]
        for _ in range(15):
            w = list(words)
            for _ in range(r.randrange(5)):
                w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
            docs.append(" ".join(w))
    docs += ["common words here and there " + " ".join(f"u{i}x{j}" for j in range(40)) for i in range(40)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in docs]
    par = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k):
                a, b = par[i], par[j]
                par = [min(a, b) if p in (a, b) else p for p in par]
    monkeypatch.setattr(near_dedup, "LEAF", 8)
    monkeypatch.setattr(near_dedup, "CHUNK", 7)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(docs))] == par


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100 + r.randrange(60), 100 + r.randrange(60)) for _ in range(50)] + [(7, 7)]
    par = {n: n for e in edges for n in e}
    for a, b in edges:
        x, y = par[a], par[b]
        par = {k: min(x, y) if v in (x, y) else v for k, v in par.items()}
    alone = {n for n in par if not any(n in e and e[0] != e[1] for e in edges)}
    got = dict(near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {k: v for k, v in par.items() if k not in alone}
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", ["toxicity", "exact_dedup"])
def test_modules_document_their_cases(name):
    import importlib

    assert "Defined cases" in importlib.import_module(f"changeweave.llm.{name}").__doc__
