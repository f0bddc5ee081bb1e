"""Spelling variant grouping: words in a trie of letter-group counts, searched with a budget of one surplus and one deficit; leaf words are verified."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import LOWER_SQL, Scratch, crc_sql, table

RUN, GAP = re.compile("[a-zÀ-ÿ]+"), re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]")
LEAST_CHARS, LEAST_COUNT, LOSES = 5, 3, 97
#: Levels of the trie: letter groups. A word's path is its count of letters of each group, at most 255.
GROUPS = 16
#: Words of a block of the trie, and words that search it in one task; a fuller block is cut further, and more searchers are dealt over copies of it.
MOST_WORDS, MOST_SEARCHERS = 8_192, 65_536
#: Entries of a bundle of paths that are followed together, and pairs that are verified at a time.
BUNDLE, PAIRS = 1 << 17, 1 << 18
#: Distinct words that a task sums up before it gives them to the shuffle.
HELD = 200_000


# ---- counting --------------------------------------------------------------------------------------------------------


def run_lists(raw: bytes, step: int | None = None) -> Iterator[list[str]]:
    """The runs of letters of a text with A-Z in lower case, a list for every `step` bytes or so. A run is cut at ASCII other than letters only."""
    step = step or common.STEP
    at = 0
    while at < len(raw):
        gap = GAP.search(raw, at + step) if at + step < len(raw) else None
        end = gap.start() if gap else len(raw)
        yield RUN.findall(raw[at:end].lower().decode())  # of bytes: A-Z only
        at = end


def misspelt(runs: list[str], prefix: int, loses: int) -> list[str]:
    """runs, but every run whose checksum after `prefix` is divisible by `loses` is without the code point that the checksum points at."""
    sums = [zlib.crc32(w.encode(), prefix) for w in runs]
    for i in np.nonzero(np.array(sums, dtype=np.int64) % loses == 0)[0]:
        w = runs[i]
        k = sums[i] % len(w)
        runs[i] = w[:k] + w[k + 1 :]
    return runs


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, loses: int = LOSES) -> DataFrame:
    """(word, n): runs of letters of all whole texts, with one letter lost where the checksum of `<doc_id>:<run>` says so, that are long and frequent enough.

    Each task sums up what it reads, HELD words at a time, so that a frequent word shuffles as a few sums. `loses` 0 loses nothing. Null texts have no runs; a null
    doc_id is empty in the checksum.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            own = {w: n for w, n in held.items() if len(w) >= least_chars}
            return pa.record_batch([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for doc, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary())):
                prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for runs in run_lists(t.as_py() or b""):
                    held.update(misspelt(runs, prefix, loses) if loses else runs)
            if len(held) > HELD:
                yield rows()
                held.clear()
        yield rows()

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# ---- the trie --------------------------------------------------------------------------------------------------------


def letters_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All words' letters, a byte each (they are below U+0100), and where each word starts."""
    raw = [w.encode("latin-1") for w in words.to_pylist()]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in raw])]).astype(np.int64)


def letter_groups(words: DataFrame) -> np.ndarray:
    """The group of each letter: letters are dealt by their number in the words, the most frequent first, each to the group that has the fewest so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(256, dtype=np.int64)
        for b in batches:
            n += np.bincount(letters_of(b.column(0))[0], minlength=256)
        yield pa.record_batch([pa.array(np.nonzero(n)[0], pa.int64()), pa.array(n[n > 0], pa.int64())], names=["letter", "n"])

    counts = words.select("word").mapInArrow(run, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()  # at most 256
    group, load = np.zeros(256, dtype=np.uint8), [0] * GROUPS
    for n, letter in sorted(((r.n, r.letter) for r in counts), key=lambda x: (-x[0], x[1])):
        k = load.index(min(load))
        group[letter], load[k] = k, load[k] + n
    return group


def vectors(letters: np.ndarray, off: np.ndarray, group: np.ndarray) -> np.ndarray:
    """[word, group]: how many letters of each group a word has, at most 255. One edit moves a count up, another down, or one of both: by one, the cut at 255 included."""
    word = np.repeat(np.arange(len(off) - 1), np.diff(off))
    flat = np.bincount(word * GROUPS + group[letters], minlength=(len(off) - 1) * GROUPS)
    return np.minimum(flat, 255).astype(np.uint8).reshape(-1, GROUPS)


def level_keys(paths: np.ndarray) -> list[np.ndarray]:
    """For each level, parent * 256 + count of each node, rising; a node's number at its level is its place there. paths: distinct rows in order."""
    out, parent = [], np.zeros(len(paths), dtype=np.int64)
    for g in range(paths.shape[1]):
        keys, node = np.unique(parent * 256 + paths[:, g], return_inverse=True)
        out.append(keys)
        parent = node
    return out


def descend(keys: list[np.ndarray], search: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of `search`, leaf) of all paths of the trie whose counts differ from a row's by a surplus of one at most and a deficit of one at most.

    Depth first, by bundles of paths at one level: a bundle's children are followed before its neighbours, so that only the bundles beside one path are held.
    """
    everyone = np.arange(len(search), dtype=np.int64)
    both = np.ones(len(search), dtype=bool)
    stack = [(0, everyone[i : i + BUNDLE], np.zeros(min(BUNDLE, len(search) - i), dtype=np.int64), both[i : i + BUNDLE], both[i : i + BUNDLE]) for i in range(0, len(search), BUNDLE)]
    while stack:
        level, row, node, more, less = stack.pop()
        if level == len(keys):
            yield row, node
            continue
        own, have, found = search[row, level].astype(np.int64), keys[level], []
        for step, may in ((0, None), (1, more), (-1, less)):
            at = np.arange(len(row)) if may is None else np.nonzero(may & (own + step >= 0) & (own + step < 256))[0]
            want = node[at] * 256 + own[at] + step
            child = np.minimum(np.searchsorted(have, want), len(have) - 1)
            hit = have[child] == want
            at = at[hit]
            found.append((row[at], child[hit], more[at] & (step != 1), less[at] & (step != -1)))
        parts = [np.concatenate(x) for x in zip(*found)]
        for i in range(0, len(parts[0]), BUNDLE):
            stack.append((level + 1, *(x[i : i + BUNDLE] for x in parts)))


class Words:
    """Words as letters with hashes of their halves, to be compared by pairs."""

    def __init__(self, words: pa.Array, group: np.ndarray):
        self.letters, self.off = letters_of(words)
        self.size = np.diff(self.off)
        self.vectors = vectors(self.letters, self.off, group)
        h, a, e = common.prefix_hashes(self.letters), self.off[:-1], self.off[1:]
        # halves of the word, and of a word that is shorter by one: the start of half of the letters and the end of the others
        self.halves = []
        for short in (0, 1):
            size = np.maximum(self.size - short, 0)
            half = size // 2
            self.halves.append((common.range_hash(h, a, a + half), common.range_hash(h, e - (size - half), e)))

    def near(self, x: np.ndarray, other: Words, y: np.ndarray) -> np.ndarray:
        """Which words x[i] and other's y[i] differ by exactly one inserted, deleted or replaced letter. One edit leaves a half as it is: most pairs end there."""
        a, b = self.size[x], other.size[y]
        halves = [np.where(a == b, s.halves[0][i][z], np.where(mine > its, s.halves[1][i][z], s.halves[0][i][z])) for s, z, mine, its in ((self, x, a, b), (other, y, b, a)) for i in (0, 1)]
        out = (np.abs(a - b) <= 1) & ((halves[0] == halves[2]) | (halves[1] == halves[3]))
        for i in np.nonzero(out)[0]:
            p, q = self.letters[self.off[x[i]] : self.off[x[i] + 1]], other.letters[other.off[y[i]] : other.off[y[i] + 1]]
            out[i] = one_edit(p.tobytes(), q.tobytes())
        return out


def one_edit(p: bytes, q: bytes) -> bool:
    if len(p) > len(q):
        p, q = q, p
    if len(q) - len(p) > 1 or p == q:
        return False
    i = next((k for k, (s, t) in enumerate(zip(p, q)) if s != t), len(p))
    return p[i + (len(p) == len(q)) :] == q[i + 1 :]


def search_block(home: pa.Table, searchers: pa.Table, group: np.ndarray) -> pa.Table:
    """For each searching word with near words in the block: how many, and the most frequent (of equal ones the first by code points)."""
    empty = pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "best_n": pa.array([], pa.int64()), "best": pa.array([], pa.string())})
    if not home.num_rows or not searchers.num_rows:
        return empty
    home = home.sort_by([("n", "descending"), ("word", "ascending")])  # of a word's near words the best comes first
    there, here = Words(home["word"].combine_chunks(), group), Words(searchers["word"].combine_chunks(), group)
    paths, leaf = np.unique(there.vectors, axis=0, return_inverse=True)
    by_leaf = np.argsort(leaf.ravel(), kind="stable")
    start = np.concatenate([[0], np.cumsum(np.bincount(leaf.ravel(), minlength=len(paths)))])
    n_near, first = np.zeros(searchers.num_rows, dtype=np.int64), np.full(searchers.num_rows, home.num_rows, dtype=np.int64)
    for row, node in descend(level_keys(paths), here.vectors):
        upto = np.cumsum(start[node + 1] - start[node])
        a = 0
        while a < len(row):  # a leaf has MOST_WORDS words at most
            b = max(int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, side="right")), a + 1)
            size = start[node[a:b] + 1] - start[node[a:b]]
            x = np.repeat(row[a:b], size)
            y = by_leaf[np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start[node[a:b]], size)]
            hit = here.near(x, there, y)
            np.add.at(n_near, x[hit], 1)
            np.minimum.at(first, x[hit], y[hit])
            a = b
    got = np.nonzero(n_near)[0]
    best = pa.array(first[got])
    return pa.table({"word": searchers["word"].take(pa.array(got)), "n_near": pa.array(n_near[got]), "best_n": home["n"].take(best), "best": home["word"].take(best)})


# ---- blocks ----------------------------------------------------------------------------------------------------------


class Top:
    """The top of the trie: nodes that hold more than MOST_WORDS words, and how many. A block is a node below with no more, or a part of such a leaf."""

    def __init__(self, full: dict[bytes, int]):
        self.parts = {p: -(-n // MOST_WORDS) for p, n in full.items() if len(p) == GROUPS}
        inner = sorted(p for p in full if len(p) < GROUPS) or []
        self.levels = [{p for p in inner if len(p) == k} for k in range(GROUPS)]

    def home(self, path: bytes, hashed: int) -> bytes:
        """The block that holds a word."""
        k = 0
        while k < GROUPS and path[:k] in self.levels[k]:
            k += 1
        return path[:k] + (b"." + (hashed % self.parts[path]).to_bytes(4, "big") if k == GROUPS and path in self.parts else b"")

    def visited(self, path: bytes) -> Iterator[bytes]:
        """The blocks that a word's search enters: the same descent, with the same budget."""
        stack = [(b"", True, True)]
        while stack:
            p, more, less = stack.pop()
            k = len(p)
            if k == GROUPS or p not in self.levels[k]:
                parts = self.parts.get(p, 0)
                yield from (p + b"." + i.to_bytes(4, "big") for i in range(parts)) if parts else (p,)
                continue
            c = path[k]
            stack.append((p + bytes([c]), more, less))
            if more and c < 255:
                stack.append((p + bytes([c + 1]), False, less))
            if less and c:
                stack.append((p + bytes([c - 1]), more, False))


def blocks(words: DataFrame, group: np.ndarray, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(home, searchers): (block, salt, word, n) of the words that a block holds, and of those whose search enters it.

    Nodes with more than MOST_WORDS words are counted a level at a time and given to all tasks: at each level the words divided by MOST_WORDS at most. Blocks that
    more than MOST_SEARCHERS words enter are copied, and the searchers dealt over the copies.
    """
    spark = words.sparkSession

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = vectors(*letters_of(b.column(0)), group)
            yield pa.record_batch([b.column(0), b.column(1), pa.array([x.tobytes() for x in v], pa.binary())], names=["word", "n", "path"])

    words = scratch.write(words.select("word", "n").mapInArrow(paths, "word string, n long, path binary"))
    level, full = F.explode(F.sequence(F.lit(0), F.lit(GROUPS))).alias("level"), {}
    nodes = words.select("path", level).groupBy(F.expr("substring(path, 1, level)").alias("node")).count().where(F.col("count") > MOST_WORDS)
    for r in nodes.toLocalIterator():
        full[bytes(r.node)] = r["count"]
    top = spark.sparkContext.broadcast(Top(full))

    def route(home: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t, known = top.value, {}
            for b in batches:
                at, to = [], []
                for i, (w, path) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                    if home:
                        own = (t.home(path, zlib.crc32(w.encode())),)
                    elif (own := known.get(path)) is None:
                        if len(known) > HELD:
                            known.clear()
                        own = known[path] = tuple(t.visited(path))
                    at += [i] * len(own)
                    to += own
                take = pa.array(at, pa.int64())
                yield pa.record_batch([pa.array(to, pa.binary()), b.column(0).take(take), b.column(1).take(take)], names=["block", "word", "n"])

        return run

    home = words.mapInArrow(route(True), "block binary, word string, n long")
    searchers = scratch.write(words.mapInArrow(route(False), "block binary, word string, n long"))
    crowd = searchers.groupBy("block").count().where(F.col("count") > MOST_SEARCHERS).select("block", F.ceil(F.col("count") / MOST_SEARCHERS).cast("int").alias("copies"))
    crowd = scratch.write(crowd)  # as many as the words that search, divided by MOST_SEARCHERS, at most
    crowd = F.broadcast(crowd) if crowd.count() <= common.BROADCAST_IDS else crowd
    copies = F.coalesce("copies", F.lit(1))
    home = home.join(crowd, "block", "left").select("block", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"), "word", "n")
    searchers = searchers.join(crowd, "block", "left").select("block", F.pmod(F.xxhash64("word"), copies).cast("int").alias("salt"), "word", "n")
    return home, searchers


def variants(words: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of (word, n), whose words are distinct and of letters below U+0100.

    Two words are near if one inserted, deleted or replaced letter tells them apart. A word's form is its most frequent near word (the first by code points
    of equal ones) if that is at least twice as frequent; its root is the last of the chain of forms, the word itself where it has none. An empty table gives none.
    """
    words = scratch.write(words.select("word", "n"))
    group = letter_groups(words)
    home, searchers = blocks(words, group, scratch)
    found = home.groupBy("block", "salt").cogroup(searchers.groupBy("block", "salt")).applyInArrow(lambda a, b: search_block(a, b, group), "word string, n_near long, best_n long, best string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best"))
    is_form = -F.col("best.n") >= 2 * F.col("n")
    out = words.join(best, "word", "left").select(
        "word", F.when(is_form, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.n")).alias("form_n")
    )
    out = scratch.write(out)
    chain = scratch.write(out.where("form is not null").select("word", F.col("form").alias("root")))
    moved = 1
    while moved:  # a form is twice as frequent at least: chains have the logarithm of the greatest number, and half of a chain goes in a round
        last = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = scratch.write(chain.join(last, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = step.where("moved").limit(1).count()
        scratch.drop(chain)
        chain = step.drop("moved")
        chain._scratch_path = step._scratch_path
    return out.join(chain, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per word of the corpus, in which one run of 97 has lost a letter: its form, root and numbers."""
    return variants(word_counts(table(spark, sf_dir, "documents")), Scratch(spark))


SQL = f"""
WITH RECURSIVE a AS (SELECT doc_id, unnest(regexp_extract_all({LOWER_SQL.format("text")}, '[a-zÀ-ÿ]+')) AS w FROM documents),
o AS (SELECT doc_id, w, count(*) AS n, hex(encode(doc_id || ':' || w)) AS x FROM a GROUP BY ALL), h AS (SELECT *, {crc_sql("x")} AS h FROM o),
m AS (SELECT CASE WHEN h % {LOSES} = 0 THEN substr(w, 1, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
x AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM v, unnest(range(0, length(word))) u(i)),
p AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS m FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION SELECT a.word, a.n, v.word, v.n FROM x a JOIN v ON a.rest = v.word UNION SELECT v.word, v.n, a.word, a.n FROM x a JOIN v ON a.rest = v.word),
b AS (SELECT word, count(*) AS n_near, arg_min(near, (-m, near)) AS best, max(m) AS best_n FROM p GROUP BY word),
f AS (SELECT word, CASE WHEN best_n >= 2 * n THEN best END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n FROM v LEFT JOIN b USING (word)),
r AS (SELECT word, word AS root FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
l AS (SELECT r.word, r.root FROM r JOIN f ON f.word = r.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN l USING (word)
"""
