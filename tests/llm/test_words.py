"""Resampling, spelling variants and repetition rules against brute-force versions, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from epochal.llm import repetition, resampling, spelling
from epochal.llm.common import Scratch

from .conftest import LONG, SCHEMA

DATA = "/root/testdata/sf0.001"


def rows_of(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet").collect()


# ---- 11: resampling --------------------------------------------------------------------------------------------------


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def feature_buckets(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_resample(docs, target):
    """doc_id -> (n_features, weight, score, rank), of distinct ids."""
    own = {d: feature_buckets(t) for d, t in docs}
    s, t = Counter(x for _, f in own.values() for x in f), Counter(x for y in target for x in feature_buckets(y)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out = {}
    for d, (_, f) in own.items():
        h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out[d] = [len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((d for d, (n, _) in own.items() if n >= 20), key=lambda d: (-out[d][2], d))
    for i, d in enumerate(able[: 5 * len(able) // 100]):
        out[d][3] = i + 1
    return {d: tuple(x) for d, x in out.items()}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_resampling_matches_brute_force(spark, sf):
    docs, target = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    got = {r.doc_id: (r.n_features, r.weight, r.score, r.rank) for r in resampling.op11_resampling(spark, sf).collect()}
    assert got == want
    assert sum(x[3] is not None for x in want.values()) >= 8


def test_radix_ranks_are_those_of_a_sort(spark, monkeypatch):
    """Blocks of 16 rows, digits of 5 bits, a major key that a third of the rows share."""
    monkeypatch.setattr(resampling, "DIGIT_BITS", 5)
    monkeypatch.setattr(resampling, "LEAST_BLOCK", 4)
    monkeypatch.setattr(resampling, "MOST_BLOCK", 4)
    rng = random.Random(3)
    rows = [(0 if i % 3 == 0 else rng.randrange(1 << 17), i * 7 % 1009) for i in range(1000)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(7)
    ranked = resampling.radix_ranks(df, [("a", 17), ("b", 10)], Scratch(spark)).collect()
    assert [(r.a, r.b) for r in sorted(ranked, key=lambda r: r["__pos"])] == sorted(rows)
    assert sorted(r["__pos"] for r in ranked) == list(range(1000))


def test_radix_ranks_take_keys_of_64_bits(spark):
    ids = [-(2**63), -5, -1, 0, 3, 2**63 - 1]
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(25)), "en", "s", 0) for i in ids * 20], SCHEMA)
    out = resampling.resample(docs, docs, Scratch(spark), percent=50).collect()
    assert sorted(r.rank for r in out if r.rank) == list(range(1, 61))
    assert [(-r.score, r.doc_id) for r in sorted((r for r in out if r.rank), key=lambda r: r.rank)] == sorted((-r.score, r.doc_id) for r in out)[:60]


@pytest.mark.parametrize("n", [1, 2, 37, 400, 1000])
def test_nth_highest(spark, n):
    rng = random.Random(n)
    v = [rng.randrange(-(10**9), 10**9) if i % 4 else 5 for i in range(1000)]
    assert resampling.nth_highest(spark.createDataFrame([(x,) for x in v], "v long"), "v", n) == sorted(v, reverse=True)[n - 1]


@pytest.mark.parametrize("step", [1, 7, 64])
def test_features_are_the_same_in_steps(step):
    for t in ("", " ", "One two, THREE four. Five six", "é" * 40 + " Über-mut 12ab " * 9, "x" * 99):
        n, want = feature_buckets(t)
        parts = list(resampling.features(t.encode(), step))
        assert sum(x for x, _ in parts) == n
        assert Counter(int(b) for _, at in parts for b in at) == Counter(want)


def test_resampling_takes_odd_rows(spark, odd, none):
    out = resampling.resample(odd, odd, Scratch(spark), percent=100).collect()
    assert len(out) == 10 and sorted(r.rank for r in out if r.rank) == list(range(1, sum(r.rank is not None for r in out) + 1))
    assert {(r.n_features, r.weight, r.rank) for r in out if r.doc_id in (3, 4, 5)} == {(0, 0, None)}
    assert {r.n_features for r in out if r.doc_id == 6} == {3 * len(LONG.split()) - 3}
    assert resampling.resample(none, odd, Scratch(spark)).collect() == []
    assert all(r.rank is None for r in resampling.resample(odd, none, Scratch(spark)).collect())


# ---- 12: spelling variants -------------------------------------------------------------------------------------------


def brute_counts(docs, loses=97):
    n = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(run)
            h = zlib.crc32(f"{d}:{w}".encode())
            if h % loses == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        r = w
        while form[r] is not None:
            r = form[r]
        out[w] = (form[w], r, n[w], len(near[w]), n.get(form[w]))
    return out


def collected(df):
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}
    return out


def small_docs(spark):
    """Some documents of the table, so that the quadratic comparison ends."""
    return spark.createDataFrame([(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows_of(spark, "documents")[:60]], SCHEMA)


def test_spelling_query_matches_brute_force(spark, write):
    docs = small_docs(spark)
    n = brute_counts([(r.doc_id, r.text) for r in docs.collect()])
    want = brute_variants(n)
    assert collected(spelling.op12_spelling(spark, write(documents=docs))) == want
    assert sum(x[3] > 0 for x in want.values()) > 20 and len(want) > 500


@pytest.mark.parametrize("most,crowd", [(1, 3), (5, 50), (40, 10_000)])
def test_small_blocks_and_dealt_searchers_find_the_same(spark, monkeypatch, most, crowd):
    """Blocks of few words: the top of the trie has many levels, equal paths are cut into parts, and blocks are copied for their searchers."""
    monkeypatch.setattr(spelling, "MOST_WORDS", most)
    monkeypatch.setattr(spelling, "MOST_SEARCHERS", crowd)
    rng = random.Random(8)
    n = {}
    for _ in range(25):
        w = "".join(rng.choice("abcdeé") for _ in range(rng.randrange(5, 9)))
        n[w] = rng.randrange(3, 400)
        for _ in range(12):
            i, c = rng.randrange(len(w)), rng.choice("abcdeé")
            n.setdefault(rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[::-1], "".join(sorted(w))]), rng.randrange(3, 60))
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert collected(spelling.variants(words, Scratch(spark))) == brute_variants(n)


@pytest.mark.parametrize("bundle,pairs", [(2, 3), (64, 64)])
def test_bundles_of_any_size_find_the_same(spark, monkeypatch, bundle, pairs):
    monkeypatch.setattr(spelling, "BUNDLE", bundle)
    monkeypatch.setattr(spelling, "PAIRS", pairs)
    rng = random.Random(2)
    n = {"".join(rng.choice("abc") for _ in range(rng.randrange(5, 8))): rng.randrange(3, 90) for _ in range(90)}
    assert collected(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"), Scratch(spark))) == brute_variants(n)


def test_very_long_words_and_chains_of_forms(spark):
    n = {"a" * 4000: 900, "a" * 4001: 3, "a" * 3999: 400, "a" * 3998: 100, "b" + "a" * 3998: 7, "qqqqq": 5}
    assert collected(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"), Scratch(spark))) == brute_variants(n)


def test_one_edit_is_levenshtein_one():
    rng = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(0, 6))) for _ in range(2))
        assert spelling.one_edit(a.encode(), b.encode()) == one_apart(a, b)


@pytest.mark.parametrize("step", [1, 5, 40])
def test_runs_are_the_same_in_steps(step):
    for t in ("", "Ärger über×÷ façade naïve", "abc1def-ghi_jkl€mno" * 5, "ÿ" * 50 + " x"):
        assert [w for part in spelling.run_lists(t.encode(), step) for w in part] == [lower(w) for w in re.findall("[A-Za-zÀ-ÿ]+", t)]


def test_spelling_takes_odd_rows(spark, odd, none):
    got = {r.word: r.n for r in spelling.word_counts(odd, loses=0).collect()}
    assert got == {"alpha": 6000, "gamma": 6000, "delta": 6000, "epsilon": 6000, "endoftext": 9} | {w: n for w, n in got.items() if w in ("Ärger", "Ärger".lower())}
    assert collected(spelling.variants(spelling.word_counts(none), Scratch(spark))) == {}
    assert spelling.variants(spelling.word_counts(odd), Scratch(spark)).count() > 0


# ---- 13: repetition --------------------------------------------------------------------------------------------------

WS = " \t\n\x0b\x0c\r"


def split(t):
    return re.findall("[^\\x20\\x09-\\x0d]+", t or "")


def brute_rules(t):
    t = t or ""
    w = split(t)
    chars = sum(map(len, w))
    excess = 0.0
    lines = [x for x in t.split("\n") if split(x)]
    later = [x in lines[:i] for i, x in enumerate(lines)]
    if sum(later) > 1:
        excess = max(100 * sum(later) / len(lines) / 30, 100 * sum(len(x) for x, y in zip(lines, later) if y) / sum(map(len, lines)) / 20)
    if w:
        excess = max(excess, 100 * sum(c in "#*$%&|<>" for c in t) / len(w) / 10)
    repeat_words = 0
    for n in range(2, 11):
        grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        count, seen = Counter(grams), set()
        again, late, by = set(), set(), {}
        for i, g in enumerate(grams):
            span = range(i, i + n)
            if count[g] > 1:
                again |= set(span)
                by.setdefault(g, set()).update(span)
            if g in seen:
                late |= set(span)
            seen.add(g)
        if n == 3:
            repeat_words = len(again)
        size = lambda at: sum(len(w[i]) for i in at)
        if n in repetition.COMMONEST and by and max(map(len, by.values())) > 30:
            excess = max(excess, 100 * max(map(size, by.values())) / chars / repetition.COMMONEST[n])
        if n in repetition.REPEATED and len(late) > 30:
            excess = max(excess, 100 * size(late) / chars / repetition.REPEATED[n])
    failed = len(w) < 50 or 100 * repeat_words > 50 * len(w)
    return (len(w), chars, sum(c in "#*$%&|<>" for c in t), sum(later), repeat_words, failed, not failed and excess <= 1 + 1e-12, round(excess, 9))


def test_repetition_query_matches_brute_force(spark):
    want = {r.doc_id: brute_rules(r.text) for r in rows_of(spark, "documents")}
    out = repetition.op13_repetition(spark, DATA).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in out}
    assert got == {k: v[:7] for k, v in want.items()}
    assert {x[6] for x in want.values()} == {True, False}


@pytest.mark.parametrize("step", [16, 200])
def test_repetition_in_steps(step):
    rng = random.Random(6)
    texts = [None, "", "a", " ".join(rng.choice(["a", "bé", "c", "ddd"]) for _ in range(80)), "x y z\n" * 30 + "y" * 300, "\n".join(" ".join(rng.choice("abcdefghij") * 2 for _ in range(9)) for _ in range(20)), "$$ ## é|<\t" * 20]
    m = repetition.measure(pa.array(texts, pa.string()), step)
    for i, t in enumerate(texts):
        want = brute_rules(t)
        assert tuple(int(m[c][i]) for c in repetition.BASE) == want[:5]
        assert (bool(m["base_failed"][i]), round(float(m["excess"][i]), 9)) == (want[5], want[7])


def test_repetition_takes_odd_rows(spark, odd, none):
    out = repetition.repetition_rules(odd)
    assert out.columns[: len(odd.columns)] == odd.columns
    rows = out.collect()
    assert len(rows) == 10 and all(r["__base_failed"] and not r["__kept"] for r in rows)
    assert {tuple(r[f"__{c}"] for c in repetition.BASE) for r in rows if r.doc_id in (3, 4, 5)} == {(0, 0, 0, 0, 0)}
    assert repetition.repetition_rules(none).count() == 0


def test_clean_documents_are_kept(spark):
    """Reviewed labels are used here only: good documents stay, but for short ones; repeated junk goes."""
    sf = "/root/testdata/sf0.1"
    out = repetition.op13_repetition(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("n_words >= 50")
    kept = {r.quality: r.k for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[1] > 0.99 and kept[0] < 0.1
