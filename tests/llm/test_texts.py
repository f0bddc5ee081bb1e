"""Operators on texts against brute-force versions, and on odd rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from epochal.llm import common, linededup, mixing, ngramjoin, packing, substrings, winnowing

from .conftest import SCHEMA

WS = " \t\n\x0b\x0c\r"


def words(t):
    return [w for w in "".join(" " if c in WS else c for c in t or "").split(" ") if w]


def corpus(rng, n=60, vocabulary=400):
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8))) for _ in range(vocabulary)]
    passage = " ".join(rng.choice(vocab) for _ in range(40))
    lines = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(2, 14))) for _ in range(6)]
    out = []
    for i in range(n):
        t = "\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 5)))
        if i % 3 == 0:
            t += "\n" + rng.choice(lines) + "\n" + t[:20]
        if i % 4 == 0:
            t += " " + passage
        if i > 10 and i % 5 == 0:
            t = out[rng.randrange(len(out))]
        if i > 10 and i % 7 == 0:
            w = out[rng.randrange(len(out))].split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        out.append(t)
    return out


@pytest.fixture
def docs(spark):
    texts = corpus(random.Random(5))
    return spark.createDataFrame([(i * 3, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)], SCHEMA)


# ---- 1: substrings ---------------------------------------------------------------------------------------------------


def brute_substrings(rows, size=50):
    seen = {}
    for i, t in sorted(rows):
        for j in range(len(t) - size + 1):
            seen.setdefault(t[j : j + size], i)
    out = {}
    for i, t in rows:
        on = [False] * len(t)
        for j in range(len(t) - size + 1):
            if seen[t[j : j + size]] < i:
                on[j : j + size] = [True] * size
        kept = bytes(c for c, x in zip(t, on) if not x)
        out[i] = (len(t), sum(on), sum(x and not y for x, y in zip(on, [False, *on])), hashlib.sha256(kept).hexdigest())
    return out


def test_substrings_match_brute_force(spark, docs, write):
    want = brute_substrings([(r.doc_id, r.text.encode()) for r in docs.collect()])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.op1_substrings(spark, write(documents=docs)).collect()}
    assert got == want
    assert sum(v[1] for v in want.values()) > 1000


def test_hot_anchors_are_split_with_the_same_result(spark, docs, write, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 1)
    want = brute_substrings([(r.doc_id, r.text.encode()) for r in docs.collect()])
    got = {r.doc_id: r.n_removed for r in substrings.op1_substrings(spark, write(documents=docs)).collect()}
    assert got == {k: v[1] for k, v in want.items()}


@pytest.mark.parametrize("step", [64, 700])
def test_texts_longer_than_a_step_lose_the_same_bytes(spark, docs, write, monkeypatch, step):
    monkeypatch.setattr(substrings, "STEP", step)
    want = brute_substrings([(r.doc_id, r.text.encode()) for r in docs.collect()])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.op1_substrings(spark, write(documents=docs)).collect()}
    assert got == want


def test_equal_hashes_of_different_strings_are_told_apart_by_bytes(monkeypatch):
    """With prefix hashes that see three bits of each byte, suffixes collide all the time."""
    whole = substrings.Suffixes.__init__

    def blurred(self, raw, *rest):
        whole(self, raw, *rest)
        self.h = common.prefix_hashes(raw & 0xE7)

    monkeypatch.setattr(substrings.Suffixes, "__init__", blurred)
    test_suffix_sort_orders_and_measures()


def test_suffix_sort_orders_and_measures():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abi") for _ in range(rng.randrange(1, 50))) for _ in range(300)]
    group = np.array([rng.randrange(7) for _ in texts])
    size = np.array([len(t) for t in texts])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    order, lcp = substrings.Suffixes(np.frombuffer(b"".join(texts), dtype=np.uint8), start, size, group).sort()
    assert [(group[i], texts[i]) for i in order] == sorted((g, t) for g, t in zip(group, texts))
    for k in range(1, len(order)):
        x, y = texts[order[k - 1]], texts[order[k]]
        n = next((j for j in range(min(len(x), len(y))) if x[j] != y[j]), min(len(x), len(y)))
        assert lcp[k] == (n if group[order[k]] == group[order[k - 1]] else 0)


def test_substrings_of_odd_rows(spark, odd, none):
    out = substrings.substring_dedup(odd, common.Scratch(spark))
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r["__n_bytes"], r["__n_removed"]) for r in out.collect()))
    assert (3, 0, 0) in got and (4, 0, 0) in got and len(got) == 10
    assert [x[2] for x in got if x[0] == 6] == [0, 0]  # rows of one doc_id do not remove each other's strings
    assert set(odd.columns) <= set(out.columns)
    assert substrings.substring_dedup(none, common.Scratch(spark)).count() == 0


# ---- 4: mixing -------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    """Shares by weight; what is above a cap is shared again among the others, until none is."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        free = [s for s in names if s not in capped]
        w = sum(weight[s] for s in free)
        target = capped | {s: rest * weight[s] / w for s in free}
        over = [s for s in free if target[s] > 2 * sizes[s]]
        if not over:
            return target
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_mixing_targets_and_takings(spark, docs, odd, write):
    for table in (docs, odd):
        rows = mixing.op4_mixing(spark, write(documents=table)).collect()
        by = {}
        for r in table.collect():
            by[r.source] = by.get(r.source, 0) + len(words(r.text))
        want = brute_targets(by)
        source = {r.doc_id: r.source for r in table.collect()}
        assert len(rows) == table.count()
        for r in rows:
            assert r.source_size == by[source[r.doc_id]] and math.isclose(r.target, want[source[r.doc_id]], rel_tol=1e-9, abs_tol=1e-9)
            rate = r.target / r.source_size if r.source_size else 0
            assert r.taken in (math.floor(rate) * r.size, (math.floor(rate) + 1) * r.size) and r.taken <= 2 * r.size
    again = mixing.op4_mixing(spark, write(documents=odd)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_taken_words_come_near_their_targets(spark, write):
    rng = random.Random(3)
    rows = [(i, "w " * (rng.randrange(60, 140)), "en", f"s{i % 20:02d}", 0) for i in range(1000)]
    out = mixing.op4_mixing(spark, write(documents=spark.createDataFrame(rows, SCHEMA))).collect()
    taken, target = {}, {}
    for r in out:
        s = rows[r.doc_id][3]
        taken[s], target[s] = taken.get(s, 0) + r.taken, r.target
    assert len(taken) == 20 and all(abs(taken[s] / target[s] - 1) < 0.02 for s in taken)


def test_mix_emits_copies(spark, docs, none):
    scratch = common.Scratch(spark)
    out = mixing.mix_documents(docs, scratch)
    assert out.columns == docs.columns
    taken = {r.doc_id: r.copies for r in mixing.with_copies(docs, scratch).select("doc_id", F.col("__copies").alias("copies")).collect()}
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in taken.items() if v}
    assert mixing.mix_documents(none, scratch).count() == 0


# ---- 6: winnowing ----------------------------------------------------------------------------------------------------


def brute_prints(t, k=winnowing.GRAM, w=winnowing.WINDOW):
    import xxhash

    b = t.encode("utf-32-be")
    h = []
    for i in range(max(len(t) - k, 0) + 1 if t else 0):
        x = xxhash.xxh64_intdigest(b[4 * i : 4 * (i + k)], seed=42)
        x &= (1 << 64 - winnowing.PLACE_BITS) - 1  # the hash's lower bits, as a signed number
        h.append(x - (1 << 64 - winnowing.PLACE_BITS) if x >> 63 - winnowing.PLACE_BITS else x)
    out = []
    for i in range(max(len(h) - w + 1, 1) if h else 0):
        m = min(h[i : i + w])
        j = max(p for p in range(i, min(i + w, len(h))) if h[p] == m)
        if (j, m) not in out[-1:]:
            out.append((j, m))
    return out


def test_winnowing_against_brute_force(spark, docs, odd, write):
    rows = docs.unionByName(odd.select(docs.columns).where("doc_id is null or doc_id not in (3, 6, 9)")).withColumn("doc_id", F.coalesce("doc_id", F.lit(-5)) * 10 + F.length(F.coalesce("text", F.lit(""))) % 10)
    table = {r.doc_id: r.text or "" for r in rows.collect()}
    assert len(table) == rows.count()
    got = {r.doc_id: r for r in winnowing.op6_winnowing(spark, write(documents=rows)).collect()}
    ids = sorted(table)
    like = lambda a, b: 1.0 if not a and not b else len({h for _, h in a} & {h for _, h in b}) / len({h for _, h in a} | {h for _, h in b})
    for i, d in enumerate(ids):
        t, n = table[d], table[ids[(i + 1) % len(ids)]]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        r, a = got[d], brute_prints(t)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        digest = lambda p: hashlib.sha256(str([(h << winnowing.PLACE_BITS) - j for j, h in p]).encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (digest(a), digest(brute_prints(e)))
        assert math.isclose(r.near_edited, like(a, brute_prints(e))) and math.isclose(r.near_next, like(a, brute_prints(n)))


def test_fingerprint_places_and_guarantee(spark):
    t = "abcabcabcabcabcabc" * 5 + "the quick brown fox jumps over the lazy dog"
    rows = spark.createDataFrame([(t,), ("zzz" + t[20:],)], "t string")
    got = rows.select(winnowing.places(winnowing.fingerprint(F.col("t"))).alias("p")).collect()
    assert [(x.place, x.hash) for x in got[0].p] == brute_prints(t)
    assert {x.hash for x in got[0].p} & {x.hash for x in got[1].p}


def test_spliced_fingerprints_are_those_of_the_spliced_text(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ab cé😀") for _ in range(n))
    rows = []
    for n in (0, 1, 30, 44, 45, 46, 47, 60, 200, 400):
        for m in (0, 1, 44, 45, 46, 47, 61, 300):
            t, u = word(n + rng.randrange(3) * 20), rng.choice([word(m + rng.randrange(2) * 30), "ab" * m])
            rows.append((t, n, u, m))
    df = spark.createDataFrame(rows, "t string, keep int, u string, more int").withColumn("more", F.least("more", F.char_length("u")))
    df = df.withColumns({"p": winnowing.fingerprint(F.col("t")), "q": winnowing.fingerprint(F.col("u"))})
    got = df.select("t", "keep", "u", "more", winnowing.places(winnowing.spliced(*map(F.col, ("t", "p", "keep", "u", "q", "more")))).alias("x")).collect()
    for r in got:
        assert [tuple(x) for x in r.x] == brute_prints(r.t[: r.keep] + r.u[: r.more]), (r.keep, r.more)


def test_places_hold_for_texts_beyond_any_wrap(spark):
    x = F.shiftleft(F.lit(-3).cast("long"), winnowing.PLACE_BITS) - F.col("id")
    got = spark.range(2**29 - 3, 2**29).select(winnowing.place(x).alias("p"), winnowing.hash_part(x).alias("h")).collect()
    assert [tuple(r) for r in got] == [(2**29 - 3, -3), (2**29 - 2, -3), (2**29 - 1, -3)]


def test_ranges_are_found_whatever_their_number(spark):
    for n in (1, 2, 3, 10, 1000):
        cuts = sorted(random.Random(n).sample(range(5000), n))
        got = spark.range(-1, 5001).select("id", winnowing.ranges_before(F.col("id"), cuts).alias("k")).collect()
        assert all(r.k == sum(c <= r.id for c in cuts) for r in got)


def test_winnowing_of_odd_and_no_rows(spark, odd, none, write):
    assert winnowing.op6_winnowing(spark, write(documents=odd)).count() == odd.count()
    assert winnowing.op6_winnowing(spark, write(documents=none)).count() == 0
    single = odd.where("doc_id = 1")
    assert winnowing.op6_winnowing(spark, write(documents=single)).first().near_next == 1.0


# ---- 8: lines --------------------------------------------------------------------------------------------------------


def brute_lines(rows, least=40, docs=5):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(WS))
    holds = {}
    for d, t in rows:
        for x in t.split("\n"):
            if len(key(x)) >= least:
                holds.setdefault(key(x), set()).add(d)
    lost = {k: max(v) for k, v in holds.items() if len(v) >= docs}
    return sorted((d, len(t.split("\n")), "\n".join(x for x in t.split("\n") if lost.get(key(x), d) == d)) for d, t in rows)


@pytest.mark.parametrize("broadcast", [0, 1_000])
def test_lines_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(linededup, "BROADCAST_LINES", broadcast)
    rng = random.Random(9)
    lines = [f"Line NUMBER {i} is long enough to count, É {'x' * rng.randrange(20)}" for i in range(8)] + ["short"] * 2
    rows = [(i, "\n".join(rng.choice(lines) + rng.choice(["", " ", "\t"]) for _ in range(rng.randrange(1, 6)))) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    out = linededup.line_dedup(docs, common.Scratch(spark))
    assert sorted((r.doc_id, r["__n_lines"], r.text) for r in out.collect()) == brute_lines(rows)


def test_lines_of_odd_rows(spark, odd, none):
    out = linededup.line_dedup(odd, common.Scratch(spark))
    assert out.where("__n_dropped > 0").count() == 0
    before = sorted((str(r.doc_id), str(r.text), str(r.key)) for r in odd.collect())
    assert sorted((str(r.doc_id), str(r.text), str(r.key)) for r in out.collect()) == before
    assert linededup.line_dedup(none, common.Scratch(spark)).count() == 0


# ---- 9: n-gram join --------------------------------------------------------------------------------------------------


def brute_classes(rows, k=4, num=85, den=100):
    sets = {}
    for d, t in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return sorted((d, len(s), find(d)) for d, s in sets.items())


def near_copies(rng, n=120):
    vocab = [f"w{i}" for i in range(900)]
    base = [[rng.choice(vocab) for _ in range(rng.randrange(3, 150))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i * 2 + 1, " ".join(w)))
    return rows


@pytest.mark.parametrize("blocks", [2048, 4])
def test_classes_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(ngramjoin, "BLOCK_DOCS", blocks)
    monkeypatch.setattr(ngramjoin, "LEAST_BLOCK", min(blocks, 256))
    rows = near_copies(random.Random(blocks))
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    got = ngramjoin.join_classes(docs, common.Scratch(spark))
    assert sorted(map(tuple, got.collect())) == brute_classes(rows)


@pytest.mark.parametrize("blocks", [8, 2048])
def test_links_are_counted_whole(spark, monkeypatch, blocks):
    """Every pair that reaches the threshold counts, within a group of near copies too; also where an id is repeated with the same or another text."""
    monkeypatch.setattr(ngramjoin, "BLOCK_DOCS", blocks)
    monkeypatch.setattr(ngramjoin, "LEAST_BLOCK", min(blocks, 256))
    rng = random.Random(blocks)
    base = [f"v{rng.randrange(10**6)}" for _ in range(120)]
    other = [f"v{rng.randrange(10**6)}" for _ in range(60)]
    rows = [(i, " ".join(base[: 120 - i % 12])) for i in range(30)] + [(100 + i, " ".join(other[i % 3 :])) for i in range(8)] + [(7, " ".join(base[:115])), (7, " ".join(other)), (5, " ".join(base[: 120 - 5])), (200, "alone here with few words"), (201, None)]
    sets = [{tuple(w[i : i + 4]) for i in range(max(len(w) - 3, 1))} if (w := (t or "").split()) else set() for _, t in rows]
    reach = lambda a, b: bool(a and b) and 100 * len(a & b) >= 85 * len(a | b)
    want = sorted((d, len(x), sum(reach(x, y) for j, y in enumerate(sets) if j != i)) for i, ((d, _), x) in enumerate(zip(rows, sets)))
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows] + [(None, rows[0][1], "en", "s", 0)], SCHEMA)
    got = ngramjoin.join_links(docs, common.Scratch(spark)).select("doc_id", "n_shingles", "n_links").collect()
    assert sorted(map(tuple, [r for r in got if r.doc_id is not None])) == want
    assert [r.n_links for r in got if r.doc_id is None] == [0]


def test_signatures_lose_no_pair():
    """Pairs at the threshold share a signature, whatever is called frequent."""
    rng = np.random.default_rng(4)
    rule = ngramjoin.Threshold()
    for _ in range(400):
        n = int(rng.integers(1, 260))
        a = rng.choice(2**62, n, replace=False).astype(np.uint64)
        for gone in range(0, n + 1):
            if not rule.reaches(n - gone, n + n - gone):
                break
        drop = int(rng.integers(0, max(gone, 1)))
        b = a[drop:]
        add = 0
        while rule.reaches(len(b), n + len(b) + add + 1) and rng.random() < 0.9:
            add += 1
        b = np.concatenate([b, rng.choice(2**62, add, replace=False).astype(np.uint64)])
        if not rule.reaches(n - drop, n + len(b)):
            continue
        often = rng.random() * 0.9
        sigs = []
        for x in (a, b):
            x = np.sort(x)
            sigs.append(set(np.concatenate(rule.signatures(x, len(x), x[(x % np.uint64(997)).astype(float) / 997 >= often])).tolist()))
        assert sigs[0] & sigs[1]


def test_chained_candidates_are_paired_by_signature(spark, monkeypatch):
    """Texts that share passages chain into one large candidate component; its sets must not be sent once a block of it, and no link may be lost."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passages = [" ".join(word() for _ in range(20)) for _ in range(30)]
    texts = [" ".join([*rng.sample(passages, 2), word(), word(), word()]) for _ in range(240)]
    texts += [t.rsplit(" ", 1)[0] + " " + word() for t in texts[::6]]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string")
    want, sets = {}, [{" ".join(w[i : i + 4]) for i in range(len(w) - 3)} for w in map(str.split, texts)]
    for i, x in enumerate(sets):
        want[i] = sum(100 * len(x & y) >= 85 * len(x | y) for j, y in enumerate(sets) if j != i) + (sum(100 * len(x & y) >= 85 * len(x | y) for y in sets[:1]) if i else 1)
    monkeypatch.setattr(ngramjoin, "LEAST_BLOCK", 16)
    sent, old = [], ngramjoin.verified_links
    monkeypatch.setattr(ngramjoin, "verified_links", lambda d, comps, *a: sent.append(comps.agg(F.max("blocks")).first()[0] or 0) or old(d, comps, *a))
    for paired in (64, 3):  # pairs are met one by one, or by the components that signatures of four sets close
        monkeypatch.setattr(ngramjoin, "PAIRED_SETS", paired, raising=False)
        got = ngramjoin.join_links(docs, common.Scratch(spark)).distinct().collect()
        assert {r.doc_id: r.n_links for r in got} == want and sum(r.component_id < r.doc_id for r in got) > 20
        if paired == 64:
            assert sent and max(sent) <= 4


def test_signatures_to_spare_lose_no_pair_and_make_few(spark):
    """Texts that hold one of a few common passages share its signatures: those that a set can spare make no pairs, and pairs at the threshold keep one."""
    rng, rule = np.random.default_rng(5), ngramjoin.Threshold()
    some = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    common_part = some(100)
    sets = []
    for _ in range(60):
        a = np.concatenate([some(int(rng.integers(100, 130))), common_part])
        n, most = len(a), 0
        while rule.reaches(n - most - 1, n + n):
            most += 1
        sets += [np.sort(a), np.sort(np.concatenate([a[most // 2 :], some(most // 3)]))]
    rows = [(int(s.view(np.int64)), i, len(x), at, spare) for i, x in enumerate(sets) for at, (sigs, spare) in enumerate(rule.signed(x, len(x), x)) for s in sigs]
    signed = spark.createDataFrame(rows, "sig long, node long, n long, list int, spare int")
    got = {(r.a, r.b) for r in ngramjoin.signed_pairs(ngramjoin.without_spare(signed), rule).collect()}
    near = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and rule.reaches(len(np.intersect1d(x, y)), len(x) + len(y))}
    every = {(r.a, r.b) for r in ngramjoin.signed_pairs(signed, rule).collect()}
    assert len(near) >= 50 and near <= got and len(got) < 0.7 * len(every)


def test_classes_of_odd_rows(spark, odd, none):
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in ngramjoin.join_classes(odd, common.Scratch(spark)).collect())
    assert ("1", 7, "1") in got and ("2", 7, "1") in got and ("3", 0, "3") in got and ("5", 0, "5") in got and ("9", 1, "9") in got and len(got) == 10
    assert [x[2] for x in got if x[0] == "6"] == ["6", "6"] and [x[2] for x in got if x[0] == "None"] == ["None"]
    assert ngramjoin.join_classes(none, common.Scratch(spark)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)]
    roots = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark)).collect()}
    assert len({roots[i] for i in range(201)}) == 1 and len({roots[1000 + i] for i in range(50)}) == 1 and len(set(roots.values())) == 2


# ---- 10: packing -----------------------------------------------------------------------------------------------------


def test_packing_of_texts(spark, docs, odd, none, write):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for table in (docs, odd):
        rows = packing.op10_packing(spark, write(documents=table)).collect()
        want = []
        for r in table.collect():
            ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
            first = len(ids) % 1024 or 1024
            cuts = [(0, min(first, len(ids)))] + [(s, 1024) for s in range(first, len(ids), 1024)]
            want += [(str(r.doc_id), i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cuts)]
        assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
        full = {}
        for r in rows:
            full.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for parts in full.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= 1024
    assert packing.op10_packing(spark, write(documents=none)).count() == 0


def test_ranks_give_the_ids_of_the_tokenizer_file(spark):
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    fast, plain = packing.encoder(), packing.encoder(by_ranks=False)
    for t in [*texts, "<|endoftext|> x", "a" * 100_000, "\r\n \t  é\u0301\u200b😀" * 50]:
        assert (fast(t) == plain(t)).all()


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_close_to_the_bound_and_reduction_is_sound(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 1025, 3000) if seed % 2 else np.minimum(1024, rng.exponential(250, 3000).astype(int) + 1)
    lengths, n = np.unique(sizes, return_counts=True)
    fill = {}
    for x, (first, shift, offset) in packing.layout(dict(zip(lengths.tolist(), n.tolist()))).items():
        rank = np.arange(n[lengths == x][0])
        at = np.searchsorted(first, rank, side="right") - 1
        for q, o in zip((rank + shift[at]).tolist(), offset[at].tolist()):
            fill.setdefault(q, []).append((o, x))
    for parts in fill.values():
        ends = [0, *np.cumsum([x for _, x in sorted(parts)]).tolist()]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 1024
    assert sum(map(len, fill.values())) == len(sizes)
    bound = max(math.ceil(sizes.sum() / 1024), int((sizes > 512).sum()))
    assert len(fill) <= bound * 1.015 + 2


def test_reduction_never_costs_a_bin():
    """Against the best packing of small instances."""

    def best(items, capacity):
        items = sorted(items, reverse=True)
        low = [len(items)]

        def place(i, bins):
            if len(bins) >= low[0]:
                return
            if i == len(items):
                low[0] = len(bins)
                return
            for j in sorted(set(range(len(bins))), key=lambda j: bins[j]):
                if bins[j] + items[i] <= capacity:
                    bins[j] += items[i]
                    place(i + 1, bins)
                    bins[j] -= items[i]
            bins.append(items[i])
            place(i + 1, bins)
            bins.pop()

        place(0, [])
        return low[0]

    rng = random.Random(2)
    for _ in range(60):
        items = [rng.randrange(1, 20) for _ in range(8)]
        count = np.bincount(items, minlength=21)
        fixed = packing.reduce_by_dominance(count, 20)
        rest = [i for i, n in enumerate(count) for _ in range(n)]
        assert sum(n for _, n in fixed) + best(rest, 20) == best(items, 20)
