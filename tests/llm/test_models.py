"""Classifiers by held-out accuracy, searches and pages against brute force, the pipeline against plain steps."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochal.llm import common, htmltext, quality, topk, toxicity

SF = "/root/testdata/sf0.01"


# ---- 2: toxicity -----------------------------------------------------------------------------------------------------


def labelled(rng, n=400):
    vocab = [f"w{'abcdefghij'[rng.randrange(10)]}{i}" for i in range(300)]
    rows = []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randrange(10, 80))]
        bad = i % 5 == 0
        if bad:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["grobian", "schuft", f"kloz{rng.choice('abcde')}{rng.choice('xyz')}"]))
        rows.append((" ".join(w), int(bad)))
    return rows


def test_lexicon_tells_held_out_rows_apart():
    rng = random.Random(1)
    lexicon = toxicity.learn(labelled(rng))
    rest = labelled(rng)
    right = sum((lexicon.score(t) >= 0.5) == bool(y) for t, y in rest)
    assert right >= 0.98 * len(rest)
    assert all(0 <= lexicon.score(t) <= 1 for t, _ in rest)


def test_automaton_finds_one_edit_and_no_more():
    lexicon = toxicity.Lexicon({("grobian", True): (0.99, 0.9, None), ("schuft", True): (0.99, 0.9, None)})
    for word in ("grobian", "grobia", "grobiann", "grxbian", "rgobian", "robian", "schfut"):
        assert lexicon.find(word), word
    for word in ("grob", "grxbxan", "schuff" + "t", "gibt", "urobia"):
        assert (lexicon.find(word) is None) == (word != "schufft"), word
    assert lexicon.find("Grobian".lower())[2] is False


@pytest.mark.parametrize("whole", [True, False])
def test_automaton_finds_every_edit_of_every_term(whole):
    terms = ["trash", "clown", "moron", "idiot", "stupid", "scum", "pathetic", "grobian"]
    lexicon = toxicity.Lexicon({(t, whole): (0.99, 0.9, None) for t in terms})
    for t in terms:
        edits = {t[:i] + t[i + 1] + t[i] + t[i + 2 :] for i in range(len(t) - 1)} | {t[:i] + t[i + 1 :] for i in range(len(t))}
        edits |= {t[:i] + "q" + t[j:] for i in range(len(t) + 1) for j in (i, i + 1) if j <= len(t)}
        for word in edits - {t}:
            assert lexicon.find(word), word
            assert whole or lexicon.find(word + "ness"), word
    for word in ("tarhs", "iidto", "qqrash", "wclnoq", "spidut"):
        assert lexicon.find(word) is None, word
    assert {lexicon.find(w) for w in ("tarsh", "colwn", "mroon", "iidot", "stpuid")} == {(t, whole, toxicity.ENDS) for t in terms[:5]}


def test_misspelt_inflected_words_are_learnt_as_sure():
    rng = random.Random(4)
    vocab = [f"w{rng.choice('abcdefghij')}{i}" for i in range(300)]
    rows = [(" ".join(rng.choice(vocab) for _ in range(30)) + (f" disgustin{rng.choice(['g', 'gly'])} scum{rng.choice(['s', ''])}" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(400)]
    lexicon = toxicity.learn(rows)
    for word in ("dsigusting", "disugstingly", "digsusting", "sucm", "scumms"):
        assert lexicon.score(f"wa1 wb2 {word} wc3") >= 0.5, word
    assert lexicon.score("wa1 wb2 dsiugsting wc3") == 0


def within_one_edit(a, b):
    """Whether a word becomes another by one letter put in, left out or exchanged, or by two neighbours swapped."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]


def test_automaton_against_brute_force():
    rng = random.Random(12)
    terms = {"".join(rng.choice("abcd") for _ in range(rng.randrange(3, 8))) for _ in range(60)}
    lexicon = toxicity.Lexicon({(t, whole): (0.99, 0.9, None) for t in terms for whole in (True, False)})
    for _ in range(3000):
        word = "".join(rng.choice("abcde") for _ in range(rng.randrange(2, 11)))
        if rng.random() < 0.5:
            t = list(rng.choice(sorted(terms)))
            i = rng.randrange(len(t))
            t[i : i + 2] = rng.choice([t[i : i + 2][::-1], t[i : i + 1], [rng.choice("abcde"), *t[i : i + 2]], []])
            word = "".join(t) + rng.choice(["", "e", "ing"])
        ends = {t for t in terms if within_one_edit(t, word)}
        starts = {t for t in terms for n in range(len(t) - 1, len(t) + 2) if 0 < n <= len(word) and within_one_edit(t, word[:n])}
        got = {x for x in lexicon.near(word) if x[0] != word}
        assert {t for t, whole, how in got if whole} == ends - {word}, word
        assert {t for t, whole, how in got if not whole} >= (starts | ends) - {word} - {t for t in terms if word.startswith(t)}, word


def test_context_is_whole_words_however_long():
    lexicon = toxicity.Lexicon({("grobian", True): (0.9, 0.8, None)})
    plain = lexicon.score("w w w grobian w w w")
    for n in range(70, 90):
        assert lexicon.score(f"w w w {'x' * n}you {'q' * n} grobian {'z' * n} w") == plain
        assert lexicon.score(f"you {'q' * n} {'q' * n} grobian") > plain > lexicon.score(f"{'q' * n} sie schrieb das wort {'q' * n} grobian") > 0
    assert lexicon.score("you " + "w " * 6 + "grobian") == plain < lexicon.score("you " + "w " * 5 + "grobian")


def test_training_rows_are_bounded_whatever_is_repeated(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 40, f"text {i % 3} grobian" if i % 2 else f"word {i % 5}") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 40, 1, i % 2) for i in range(400)] + [(i, 1, 1 - i % 2) for i in range(4)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "learn", lambda rows: seen.append(rows))
    toxicity.fit(docs, labels)
    assert len(seen[0]) <= 40
    monkeypatch.setattr(toxicity, "CLASS_BYTES", 60)
    toxicity.fit(docs, labels)
    assert 0 < len(seen[1]) < len(seen[0]) and sum(len(t) for t, y in seen[1] if y) <= 60
    model, weights = quality.fit(docs)
    assert np.isfinite(weights).all()


def test_one_very_long_text_does_not_empty_its_class(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choices(words, k=12)) + (" zorgle" if i % 2 else ""), i % 2) for i in range(300)]
    docs, labels = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    want = toxicity.fit(docs, labels)
    monkeypatch.setattr(toxicity, "TEXT_BYTES", 5_000)
    ids = [i for i in range(1000, 1400) if zlib.crc32(str(i).encode()) % 5][:40]
    more = spark.createDataFrame([(i, "word1 " * 2_000) for i in ids], "doc_id long, text string")
    got = toxicity.fit(docs.union(more), labels.union(spark.createDataFrame([(i, 1) for i in ids], "doc_id long, toxic int")))
    assert got.score("you zorgle") == want.score("you zorgle") > 0.5 > got.score("word1 word2")


def test_quotation_counts_less_than_address():
    lexicon = toxicity.Lexicon({("grobian", True): (0.9, 0.8, None)})
    plain, quoted, aimed = (lexicon.score(t) for t in ("what a grobian this is", 'they wrote "grobian" in the letter', "you grobian"))
    assert quoted < 0.5 < plain < aimed
    assert lexicon.score(None) == lexicon.score("") == 0


def test_toxicity_learns_from_rows_that_are_not_held_out(spark, odd, none, write):
    rng = random.Random(2)
    rows = [(i, t, y) for i, (t, y) in enumerate(labelled(rng))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(9999, 1, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.op2_toxicity(spark, write(documents=docs, labels=labels)).collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].predicted == rows[i][2] for i in held) >= 0.97 * len(held)
    empty = labels.limit(0)
    assert {r.score for r in toxicity.op2_toxicity(spark, write(documents=odd, labels=empty)).collect()} == {0.0}
    assert toxicity.op2_toxicity(spark, write(documents=none, labels=empty)).count() == 0
    assert set(odd.columns) <= set(toxicity.score_documents(odd, toxicity.learn([])).columns)


# ---- 3: quality ------------------------------------------------------------------------------------------------------


def test_em_recovers_labellers_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.7
    rates = np.array([0.9, 0.8, 0.75, 0.6, 0.95])
    right = rng.random((len(truth), 5)) < rates
    votes = np.where(right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.2] = -1
    patterns = {}
    for v in votes:
        k = quality.pattern_of(tuple(v))
        patterns[k] = patterns.get(k, 0) + 1
    model = quality.estimate(patterns, labellers=5)
    assert abs(model.prior - 0.7) < 0.05 and np.abs(model.accuracies() - rates).max() < 0.05


def test_quality_against_brute_force(spark):
    """EM a document at a time, in plain loops, gives the posteriors that the query gives."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    v = [quality.votes(quality.measures(r.text or "")) for r in rows]
    p = [{0: 0.95, 1: 0.45}.get(sum(x == 0 for x in y), 0.05) for y in v]
    for _ in range(quality.ROUNDS):
        prior = min(max(sum(p) / len(p), 0.02), 0.98)
        rate = [[[0.1 for _ in range(3)] for _ in quality.NAMES] for _ in (0, 1)]
        for y, q in zip(v, p):
            for j, x in enumerate(y):
                rate[0][j][x + 1] += 1 - q
                rate[1][j][x + 1] += q
        share = [[[x / sum(one) for x in one] for one in side] for side in rate]
        new = []
        for y in v:
            good = prior * math.prod(share[1][j][x + 1] for j, x in enumerate(y))
            bad = (1 - prior) * math.prod(share[0][j][x + 1] for j, x in enumerate(y))
            new.append(good / (good + bad))
        done = max(abs(a - b) for a, b in zip(new, p)) < 1e-6
        p = new
        if done:
            break
    got = {r.doc_id: r.posterior for r in quality.op3_quality(spark, "/root/testdata/sf0.001").collect()}
    assert all(abs(got[r.doc_id] - q) < 1e-6 for r, q in zip(rows, p))


def test_quality_agrees_with_reviews_it_never_saw(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.keep for r in quality.op3_quality(spark, SF).collect()}
    assert len(got) == docs.count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(got[d] == q for d, q in labels.items()) >= 0.93 * len(labels)
    good = [d for d, q in labels.items() if q == 1]
    assert sum(got[d] for d in good) >= 0.98 * len(good)


@pytest.mark.parametrize("times", [1, 20])
def test_repeated_ids_do_not_shrink_the_sample(spark, monkeypatch, times):
    monkeypatch.setattr(quality, "TRAIN_ROWS", 50)
    sizes, train = [], quality.train
    monkeypatch.setattr(quality, "train", lambda rows, target: sizes.append(len(rows)) or train(rows, target))
    quality.fit(spark.createDataFrame([(i, f"text {i} of some words, and more.") for i in range(1500) for _ in range(times)], "doc_id long, text string"))
    assert sizes == [50]


def test_quality_of_odd_rows(spark, odd, none):
    out = quality.score_documents(odd, *quality.fit(odd))
    assert out.count() == odd.count() and out.where("__score between 0 and 1 and __posterior between 0 and 1").count() == odd.count()
    assert quality.score_documents(none, *quality.fit(none)).count() == 0


# ---- 5: pages --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""), ("", ""), ("<html><body><nav><a href=x>only, a, menu</a></nav></body></html>", ""), ("plain text, without any markup", "plain text, without any markup"),
        ("<body><div class=menu><a href=1>Home</a></div><div id=main><p>First, &amp; best &eacute;\n\n text.<p>Second <b>bold</b>\tpart<br>goes on.</div><div class='comments'><p>I agree, fully, with this, yes.</p></div></body>", "First, & best é text.\nSecond bold part goes on."),
        ("<article><h1>Head</h1><p>One, two, three.</p><aside><p>Not, this, one.</p></aside><ul><li>a, b</li><li>c</li></ul></article><footer><p>foot, note</p></footer>", "Head\nOne, two, three.\na, b\nc"),
        ("<p>Unclosed, <script>var a='</p>, x';</script>text <style>p{}</style>&#8364;5 &unknown; &lt;b&gt;</p><!-- a, comment -->", "Unclosed, text €5 &unknown; <b>"),
        ("<div><p>Opening words of the story</p><hr><p>Long, long, paragraph, with, many, commas, here.</p><hr/><p>An end, too.</p></div>", "Opening words of the story\nLong, long, paragraph, with, many, commas, here.\nAn end, too."),
        ("<article><ul><li>one, a<li>two, b<ul><li>inner, c<li>inner, d</ul><li>three, e</ul><table><tr><td>x, y<td>z, w<tr><td>last, cell</table></article>", "one, a\ntwo, b\ninner, c\ninner, d\nthree, e\nx, y\nz, w\nlast, cell"),
        ("<div id=main><div><div><div><div><div><div><div><p>Far, far, down, in, a, nest.</p></div></div></div></div></div></div></div></div>", "Far, far, down, in, a, nest."),
        ("<main><section><p>Alpha, beta, gamma, delta, epsilon.</p></section><section><p>Zeta.</p></section><form><p>Your, name</p><input></form></main>", "Alpha, beta, gamma, delta, epsilon.\nZeta."),
    ],
)
def test_main_text(source, want):
    assert htmltext.extract(source) == want


def test_pages_with_odd_rows(spark, write):
    deep = "<div>" * 5000 + "<p>deep, text</p>"
    rows = [(1, "u", "<p>a, b</p>", 0), (1, "u", "<p>a, b</p>", 0), (None, None, None, 0), (3, "v", deep, 0), (4, "w", "<p>" + "long, " * 50_000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = htmltext.op5_html(spark, write(pages=pages)).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert sorted(r.text[:10] for r in got) == ["", "a, b", "a, b", "deep, text", "long, long"]
    assert htmltext.op5_html(spark, write(pages=pages.limit(0))).count() == 0


def seconds(page):
    """CPU seconds of reading a page, the least of five, without Python's own collection of garbage in between."""
    import gc
    import time

    best = 99.0
    gc.disable()
    try:
        for _ in range(5):
            start = time.process_time()
            htmltext.extract(page)
            best = min(best, time.process_time() - start)
            gc.collect()
    finally:
        gc.enable()
    return best


BAD = ["<ul>|<li><ul><li>some, words|</b></i>|<b><i>", "<b></b>|<div>|</b>", "<b><div>x</div>", "<p><i>", "<td><b>", "<li><a><dd>", "<span><p>x</p>"]


@pytest.mark.parametrize("units", BAD)
def test_bad_pages_take_time_in_proportion(units):
    page = lambda n: "".join(x * n for x in units.split("|")) + "<p>end, of it"
    assert units != BAD[0] or htmltext.extract(page(300)).endswith("end, of it")
    assert seconds(page(8_000)) < 2.5 * seconds(page(4_000)) + 0.05


@pytest.mark.parametrize("mark", ["post-comments", "comment-content", "comment-text", "article-comments", "entry-meta", "post-share", "related-content", "content-footer", "content-sidebar", "comments", "comments post", "comment post"])
def test_what_is_said_beside_an_article_is_no_part_of_it(mark):
    text = "<p>The article itself, with commas, and more.</p>"
    assert htmltext.extract(f'<article>{text}<div class="{mark}"><p>Nice, very nice, I like it, thanks.</p></div>{text}</article>') == "\n".join(["The article itself, with commas, and more."] * 2)


@pytest.mark.parametrize("mark", ["post", "post with-sidebar", "entry-content", "main-content", "content has-footer", "page story-text", "blog-post"])
def test_what_holds_the_article_stays(mark):
    assert htmltext.extract(f'<div class="{mark}"><p>The article itself, with commas, and more.</p></div><div class="sidebar"><p>Not this, here.</p></div>') == "The article itself, with commas, and more."


def test_generated_pages_keep_their_articles(spark):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in htmltext.op5_html(spark, SF).collect():
        article = re.search(r"(?s)<article>(.*)</article>", pages[r.page_id])[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split("</?(?:p|h1|br)>", article)]
        assert r.text.split("\n") == [p for p in parts if p]


# ---- 7: top-k --------------------------------------------------------------------------------------------------------


def brute_top(rows, k=10):
    vecs = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and i is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in vecs:
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vecs if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [16_384, 50])
def test_top_k_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "ROWS", block)
    monkeypatch.setattr(topk, "ROW_BYTES", block * 6 * 8)
    monkeypatch.setattr(topk, "QUERIES", max(block // 20, 2))
    rng = random.Random(block)
    rows = [(i, [rng.choice([0.0, rng.uniform(-2, 2), 0.5]) for _ in range(6)]) for i in range(700)]
    rows += [(701, None), (702, [1.0, float("nan"), 0.0, 0.0]), (703, [1.0, None, 0.0, 0.0]), (704, [float("inf")] * 6), (800, []), (900, [1.0]), (None, [1.0] * 6), (705, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit(1), "qb": F.lit(2)})
    as_float = [(r.vec_id, r.embedding) for r in df.collect()]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df).collect()) == brute_top(as_float)
    assert topk.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [65_536, 1])
def test_top_k_with_sums_beyond_64_bits(spark, monkeypatch, block):
    """Finite components of any size take part, and rank by their whole value within blocks and across them."""
    monkeypatch.setattr(topk, "ROWS", block)
    rows = [(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 0.0]), (3, [3.0, 1.0]), (4, [1.7e308, 0.0]), (5, [1e300, 3.0]), (6, [-1e301, 0.0]), (7, [-1e300, 5.0]), (8, [0.0, 2.0**62]), (9, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = {i: [int(x) * 1024 if abs(x) > 2**43 else math.floor(1024 * x) for x in v] for i, v in rows}
    want = sorted((i for i in exact if i), key=lambda i: (-sum(a * b for a, b in zip(exact[0], exact[i])), i))
    got = topk.top_k(df).orderBy("rank").collect()
    assert [r.vec_id for r in got] == want == [4, 5, 1, 3, 8, 9, 7, 2, 6]
    assert [r.score for r in got] == [max(min(sum(a * b for a, b in zip(exact[0], exact[i])), 2**63 - 1), -(2**63)) for i in want]


# ---- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline_against_plain_steps(spark, write):
    """Stages on a small corpus against brute-force versions of the middle ones; the mix and the packing by what they promise."""
    import corpus_pipeline as cp

    from .test_texts import brute_classes, brute_lines, corpus, near_copies

    rng = random.Random(8)
    texts = corpus(rng, 40) + [t for _, t in near_copies(rng, 40)] + [t for t, _ in labelled(rng, 120)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(len(texts) - 120 + i, 1, int(i % 5 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    sf = write(documents=docs, labels=labels)
    lexicon = toxicity.fit(docs, labels)
    kept = {i: t for i, t in enumerate(texts) if lexicon.score(t) < 0.5}
    assert 0 < len(texts) - len(kept) < 60
    clean = {i: t for i, _, t in brute_lines(sorted(kept.items()))}
    classes = {i: c for i, _, c in brute_classes(sorted(clean.items()), k=5, num=80)}
    want = {i: t for i, t in clean.items() if classes[i] == i}
    at, scratch = docs, common.Scratch(spark)
    for i, (name, stage) in enumerate(cp.STAGES[:3]):
        at = scratch.write(stage(spark, at, sf))
        assert at.columns == docs.columns, name
        assert {r.doc_id: r.text for r in at.collect()} == (kept, clean, want)[i], name
    mixed = scratch.write(cp.mixed(spark, at, sf))
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= set(want)
    assert len(cp.STAGES) == 5 and 4 <= len(cp.STAGES) <= 5
    pieces = cp.run(spark, sf)
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert {r.doc_id: r["count"] for r in pieces.where("piece = 0").groupBy("doc_id").count().collect()} == copies
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_pipeline_of_odd_and_no_rows(spark, odd, none, write):
    import corpus_pipeline as cp

    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert cp.run(spark, write(documents=none, labels=labels)).count() == 0
    sf = write(documents=odd, labels=labels)
    twice = odd.select(*(c for c in odd.columns)).limit(0).unionByName(odd.where("doc_id = 1").withColumn("text", F.lit("a text of its own, with many other words than before"))).unionByName(odd)
    ids = sorted(str(r.doc_id) for r in cp.near_copies_out(spark, twice, sf).collect())
    assert ids == sorted(["1", "1", "3", "4", "5", "6", "7", "None", "9"])  # rows of one id with different texts are different documents
    out = cp.near_copies_out(spark, odd, sf)
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(["1", "3", "4", "5", "6", "7", "None", "9"]) and out.columns == odd.columns
    assert cp.run(spark, sf).count() > 0
