"""Quality rules by repetition: rolling hashes of several n-gram lengths and the characters that their repeats cover."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import mix, plain, prefix_hashes, range_hash, table, text_buffer, words_of

#: Most characters (of those in words) that later copies of n-grams may cover, in percent, by n; the most that copies of the n-gram that covers most may; and
#: the most lines, and characters of lines, that equal an earlier line. The published repetition rules of the MassiveText corpus.
REPEATED = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
COMMONEST = {2: 20, 3: 18, 4: 16}
LINES, LINE_CHARS, MOST_SYMBOLS = 30, 20, 10
#: What a short text may repeat whatever its share: words that copies cover, and lines. A sentence or line that is said twice is no junk.
FREE_WORDS, FREE_LINES = 30, 1
LEAST_WORDS, WINDOW, MOST_REPEAT_WORDS = 50, 3, 50
SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
_C = mix(np.arange(101, 101 + max(REPEATED), dtype=np.uint64)) | np.uint64(1)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def pieces(buf: np.ndarray, off: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, row starts, first row) of about `step` bytes each. A longer row is cut after white space, or where a word of more than a step ends."""
    for a, b in common.steps(off, step):
        lo, hi = int(off[a]), int(off[b])
        if hi - lo <= step:
            yield buf[lo:hi], off[a : b + 1] - lo, a
            continue
        while lo < hi:  # one long row
            end = min(lo + step, hi)
            while end < hi:
                part = buf[end : min(end + step, hi)]
                blank = np.nonzero((part == 32) | ((part >= 9) & (part <= 13)))[0]
                if len(blank):
                    end += int(blank[0]) + 1
                    break
                end = min(end + step, hi)
            yield buf[lo:end], np.array([0, end - lo]), a
            lo = end


def word_table(buf: np.ndarray, off: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, 64-bit hash and code points of each word, and the symbols of each row. What stays in memory is a few numbers a word, not a byte."""
    rows, hashes, chars = [], [], []
    symbols = np.zeros(len(off) - 1, dtype=np.int64)
    is_symbol = np.zeros(256, dtype=bool)
    is_symbol[SYMBOLS] = True
    for part, at, first in pieces(buf, off, step):
        start, end, row = words_of(part, at)
        lead = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        rows.append(row + first)
        hashes.append(range_hash(prefix_hashes(part), start, end))
        chars.append(lead[end] - lead[start])
        marks = np.concatenate([[0], np.cumsum(is_symbol[part])])
        n = marks[at[1:]] - marks[at[:-1]]
        symbols[first : first + len(n)] += n
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), symbols
    return np.concatenate(rows), np.concatenate(hashes), np.concatenate(chars).astype(np.int64), symbols


def repeats(row: np.ndarray, rolled: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the n-grams with these rolled hashes: which are repeated in their row, which of these are later copies, and the order in which equal ones stand together.

    Equal hashes of 64 bits are taken for equal n-grams.
    """
    m = len(row) - n + 1
    if m <= 0:
        e = np.zeros(0, dtype=bool)
        return e, e, np.zeros(0, dtype=np.int64)
    whole = row[:m] == row[n - 1 :]
    key = mix(rolled[:m] + row[:m].astype(np.uint64) * _C[-1])
    order = np.argsort(key, kind="stable")
    order = order[whole[order]]
    same = key[order][1:] == key[order][:-1]
    again, later = np.zeros(m, dtype=bool), np.zeros(m, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    later[order[1:][same]] = True
    return again, later, order[again[order]]


def covered(at: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in the n-grams that are marked."""
    edge = np.zeros(words + 1, dtype=np.int64)
    edge[: len(at)] += at
    edge[n : n + len(at)] -= at
    return np.cumsum(edge[:words]) > 0


def most_covered(row: np.ndarray, key: np.ndarray, order: np.ndarray, chars: np.ndarray, n: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters that the copies of one n-gram cover in each row, and the words, each for the n-gram with the most. Copies that overlap count once."""
    out, most = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
    if not len(order):
        return out, most
    k = key[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (row[order][1:] != row[order][:-1])])
    group = np.cumsum(new) - 1
    # the copies of a group rise; one that starts inside the one before counts for what it adds
    gap = np.concatenate([[n], np.minimum(np.diff(order), n)])
    gap[new] = n
    upto = np.concatenate([[0], np.cumsum(chars)])
    added = upto[order + n] - upto[order + n - gap]
    np.maximum.at(out, row[order[new]], np.bincount(group, weights=added).astype(np.int64))
    np.maximum.at(most, row[order[new]], np.bincount(group, weights=gap).astype(np.int64))
    return out, most


def line_repeats(raw: bytes) -> tuple[int, int, int, int]:
    """Lines with a word, those equal to an earlier one, and the code points of both, of a text."""
    seen: set[bytes] = set()
    n = dup = size = dup_size = 0
    for line in raw.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            long = len(line) if line.isascii() else len(line.decode())
            n, size = n + 1, size + long
            if line in seen:
                dup, dup_size = dup + 1, dup_size + long
            seen.add(line)
    return n, dup, size, dup_size


def measure(texts: pa.Array, step: int | None = None) -> dict[str, np.ndarray]:
    """The measures of each text: BASE, base_failed, the greatest share of repeats against its bound (`excess`, 1 at the bound) and kept."""
    buf, off = text_buffer(texts)
    n = len(off) - 1
    row, w, chars, symbols = word_table(buf, off, step or common.STEP)
    words = np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64)
    word_chars = np.bincount(row, weights=chars, minlength=n).astype(np.int64) if len(row) else np.zeros(n, np.int64)
    lines = np.array([line_repeats(buf[a:b].tobytes()) for a, b in zip(off[:-1], off[1:])], dtype=np.int64).reshape(n, 4)
    excess, over = np.zeros(n), np.zeros(n, dtype=bool)

    def judge(counts: np.ndarray, found: np.ndarray, of: np.ndarray, bound: int) -> None:
        """A share against its bound, where it counts: compared in whole numbers."""
        np.maximum(excess, counts * (100 * found / np.maximum(of, 1) / bound), out=excess)
        np.logical_or(over, counts & (100 * found > bound * of), out=over)

    some, all_ = lines[:, 1] > FREE_LINES, np.ones(n, dtype=bool)
    judge(some, lines[:, 1], lines[:, 0], LINES)
    judge(some, lines[:, 3], lines[:, 2], LINE_CHARS)
    judge(all_, symbols, words, MOST_SYMBOLS)
    repeat_words = np.zeros(n, dtype=np.int64)
    rolled = np.zeros(len(w), dtype=np.uint64)
    for k in range(1, max(REPEATED) + 1):
        m = len(w) - k + 1
        if m <= 0:
            break
        rolled = rolled[:m] + w[k - 1 :] * _C[k - 1]  # the hash of k words from that of k - 1
        if k == 1:
            continue
        again, later, order = repeats(row, rolled, k)
        if k == WINDOW:
            repeat_words = np.bincount(row, weights=covered(again, k, len(w)), minlength=n).astype(np.int64)
        if k in COMMONEST:
            size, many = most_covered(row, rolled, order, chars, k, n)
            judge(many > FREE_WORDS, size, word_chars, COMMONEST[k])
        if k in REPEATED:
            on = covered(later, k, len(w))
            judge(np.bincount(row, weights=on, minlength=n) > FREE_WORDS, np.bincount(row, weights=chars * on, minlength=n).astype(np.int64), word_chars, REPEATED[k])
    failed = (words < LEAST_WORDS) | (100 * repeat_words > MOST_REPEAT_WORDS * words)
    kept = ~failed & ~over
    return {"n_words": words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": lines[:, 1], "n_repeat_words": repeat_words, "excess": excess, "base_failed": failed, "kept": kept}


KINDS = {**{c: T.LongType() for c in BASE}, "excess": T.DoubleType(), "base_failed": T.BooleanType(), "kept": T.BooleanType()}


def repetition_rules(docs: DataFrame) -> DataFrame:
    """docs with the measures of each text, as __n_words, __word_chars, __n_symbols, __n_dup_lines, __n_repeat_words, __excess, __base_failed and __kept.

    A word is a run without ASCII white space, compared as it stands. __n_symbols counts `#*$%&|<>`; __n_dup_lines the lines with a word that equal an earlier line;
    __n_repeat_words the words in windows of three that the text has twice or more. A text fails the base rules with fewer than 50 words, or if more than half
    of its words are repeated. It is kept if, besides, no share of its characters in repeats is above its bound: later copies of n-grams of 5 to 10 words,
    the commonest n-gram of 2 to 4 words, and lines that equal an earlier one; and symbols are a tenth of its words at most. Copies of FREE_WORDS words and FREE_LINES lines are no fault in any text.

    Null and empty texts have no words and fail. Rows are judged each by itself, so repeated rows and ties come out alike; an empty table gives none. Extra columns
    pass through, but for names that start with two underscores, which are the operator's own. A long text is cut into words a step at a time.
    """
    docs = plain(docs)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = measure(b.column(at))
            cols = [*b.columns, *[pa.array(m[c], pa.float64() if c == "excess" else pa.bool_() if c in ("base_failed", "kept") else pa.int64()) for c in KINDS]]
            yield pa.record_batch(cols, names=[f"c{i}" for i in range(len(cols))])

    safe = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    kinds = [*(f.dataType for f in docs.schema.fields), *KINDS.values()]
    return safe.mapInArrow(run, T.StructType([T.StructField(f"c{i}", k) for i, k in enumerate(kinds)])).toDF(*names, *[f"__{c}" for c in KINDS])


def op13_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the base measures, whether they fail it, and whether the repetition rules keep it."""
    out = repetition_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[F.col(f"__{c}").alias(c) for c in (*BASE, "base_failed", "kept")])


def _window_sql(n: int) -> str:
    """Of windows of n words: the words and characters that later copies cover, and those that the copies of one window do at most, by document."""
    text = "a" + "".join(f" || ' ' || lead(a, {k}) OVER o" for k in range(1, n))
    return f"""g{n} AS (SELECT id, i, len, upto, {text} AS g, lead(upto, {n - 1}) OVER o AS stop FROM p WINDOW o AS (PARTITION BY id ORDER BY i)),
h{n} AS (SELECT *, g IS NOT NULL AND count(*) OVER (PARTITION BY id, g) > 1 AS again, CASE WHEN g IS NOT NULL THEN i - lag(i) OVER (PARTITION BY id, g ORDER BY i) END AS gap FROM g{n}),
k{n} AS (SELECT *, coalesce(bool_or(again) OVER w, false) AS on_any, coalesce(bool_or(gap IS NOT NULL) OVER w, false) AS on_later FROM h{n} WINDOW w AS (PARTITION BY id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)),
c{n} AS (SELECT h.id, h.g, sum(least(coalesce(h.gap, {n}), {n})) AS words, sum(h.stop - CASE WHEN h.gap < {n} THEN q.upto - q.len ELSE h.upto - h.len END) AS chars FROM h{n} h JOIN p q ON q.id = h.id AND q.i = h.i + {n} - least(coalesce(h.gap, {n}), {n}) WHERE h.again GROUP BY h.id, h.g),
m{n} AS (SELECT id, max(words) AS words, max(chars) AS chars FROM c{n} GROUP BY id),
r{n} AS (SELECT id, count(*) FILTER (WHERE on_any) AS any_words, count(*) FILTER (WHERE on_later) AS words, coalesce(sum(len) FILTER (WHERE on_later), 0) AS chars FROM k{n} GROUP BY id)"""


_EACH = sorted({*REPEATED, *COMMONEST, WINDOW})
_OVER = [f"r{n}.words > {FREE_WORDS} AND 100 * r{n}.chars > {bound} * d.word_chars" for n, bound in REPEATED.items()] + [f"m{n}.words > {FREE_WORDS} AND 100 * m{n}.chars > {bound} * d.word_chars" for n, bound in COMMONEST.items()]
SQL = f"""
WITH t AS (SELECT doc_id AS id, coalesce(text, '') AS t FROM documents), w AS (SELECT id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM t),
u AS (SELECT id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM w), p AS MATERIALIZED (SELECT *, length(a) AS len, sum(length(a)) OVER (PARTITION BY id ORDER BY i) AS upto FROM u),
l0 AS (SELECT id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM t), l1 AS (SELECT *, row_number() OVER (PARTITION BY id, line ORDER BY i) > 1 AS again FROM l0 WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
l AS (SELECT id, count(*) AS n, count(*) FILTER (WHERE again) AS dup, sum(length(line)) AS chars, coalesce(sum(length(line)) FILTER (WHERE again), 0) AS dup_chars FROM l1 GROUP BY id),
{", ".join(_window_sql(n) for n in _EACH)},
d AS (SELECT w.id, len(w) AS n_words, coalesce((SELECT sum(len) FROM p WHERE p.id = w.id), 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
f AS (SELECT d.*, coalesce(l.dup, 0) AS n_dup_lines, coalesce(r{WINDOW}.any_words, 0) AS n_repeat_words, coalesce(l.dup > {FREE_LINES} AND (100 * l.dup > {LINES} * l.n OR 100 * l.dup_chars > {LINE_CHARS} * l.chars), false) OR 100 * n_symbols > {MOST_SYMBOLS} * n_words
 OR {" OR ".join(f"coalesce({x}, false)" for x in _OVER)} AS over FROM d LEFT JOIN l USING (id) {" ".join(f"LEFT JOIN r{n} USING (id) LEFT JOIN m{n} USING (id)" for n in _EACH)})
SELECT id AS doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEAT_WORDS} * n_words AS base_failed,
NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEAT_WORDS} * n_words OR over) AS kept FROM f
"""
