"""Target-distribution importance resampling: scores from an array of hashed n-gram gains, ranks from a distributed LSD radix sort."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER_SQL, STEP, Scratch, crc_sql, table

WORD, GAP = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: Longest run of words that is a feature, and the buckets that features fall into.
RUN, BUCKETS = 3, 10_000
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
#: Bits of a digit, and the least and the most rows (powers of 2) of a block that a pass sorts at a time: what a task holds, whatever the input.
DIGIT_BITS, LEAST_BLOCK, MOST_BLOCK = 12, 10, 18
LEAST_ID = -(2**63)


def word_lists(raw: bytes, step: int | None = None) -> Iterator[list[bytes]]:
    """The words of a text with A-Z in lower case, a list for every `step` bytes or so, however long the text is."""
    step = step or STEP
    at = 0
    while at < len(raw):
        gap = GAP.search(raw, at + step) if at + step < len(raw) else None
        end = gap.start() if gap else len(raw)
        yield WORD.findall(raw[at:end].lower())  # of bytes: A-Z only
        at = end


def features(raw: bytes, step: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(number of words, buckets of all runs of 1 to RUN words that end in them), in parts of a text; runs reach across parts."""
    before: list[bytes] = []
    for words in word_lists(raw, step):
        if not words:
            continue
        have = before + words
        rest, sums, out = [b" " + w for w in have], list(map(zlib.crc32, have)), []
        for k in range(RUN):
            if k:
                sums = list(map(zlib.crc32, rest[k:], sums))
            out += sums[max(len(before) - k, 0) :]  # runs that end in a word of `before` were given with it
        yield len(words), np.array(out, dtype=np.int64) % BUCKETS
        before = have[-(RUN - 1) :]


def _texts(col) -> Iterator[bytes]:
    for t in col.cast(pa.large_binary()):
        yield t.as_py() or b""


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of all texts in each bucket. A task sums up its texts before anything shuffles; BUCKETS sums come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for t in _texts(b.column(0)):
                for _, at in features(t):
                    n += np.bincount(at, minlength=BUCKETS)
        at = np.nonzero(n)[0]
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight: a thousand times the log of how much likelier the target has it, both smoothed by one."""
    s, t = float(source.sum()), float(target.sum())
    ratio = (target + 1.0) * (s + BUCKETS) / ((source + 1.0) * (t + BUCKETS))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], dtype=np.int64)


def noise(doc: int | None) -> int:
    """A draw from the Gumbel distribution, in thousandths, that the id alone decides: the highest sums of weight and draw are a sample without replacement."""
    h = int(hashlib.sha256(f"{SEED}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score), a row for each row of docs. Null and empty texts have no words and weigh 0."""
    share = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = share.value
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            for doc, t in zip(ids, _texts(b.column(1))):
                words = size = weight = 0
                for n, at in features(t):
                    words, size, weight = words + n, size + len(at), weight + int(g[at].sum())
                rows.append((words, size, weight, weight + noise(doc)))
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.record_batch([pa.array(ids, pa.int64()), *[pa.array(c, pa.int64()) for c in cols]], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


# ---- distributed radix sort ------------------------------------------------------------------------------------------


def counting_pass(rows: DataFrame, key: str, shift: int, block_bits: int, scratch: Scratch) -> DataFrame:
    """rows with `__pos` as it is after a stable counting sort by DIGIT_BITS bits of `key` from `shift` on.

    Rows lie in blocks of 2^block_bits places, which are a task's work. Counts by block and digit shuffle; a digit's rows of a block start where all smaller
    digits and the same digit's rows of earlier blocks end; each block's rows are put in their order of place and dealt out by digit.
    """
    digit = F.shiftrightunsigned(key, shift).bitwiseAND((1 << DIGIT_BITS) - 1).cast("int")
    rows = rows.withColumns({"__block": F.shiftrightunsigned("__pos", block_bits), "__digit": digit})
    counts = scratch.write(rows.groupBy("__block", "__digit").agg(F.count("*").alias("__n")))
    totals = sorted((r[0], r[1]) for r in counts.groupBy("__digit").agg(F.sum("__n")).collect())  # at most 2^DIGIT_BITS
    first, starts = 0, []
    for d, n in totals:
        starts.append((d, first))
        first += n
    starts = F.broadcast(rows.sparkSession.createDataFrame(starts, "__digit int, __first long"))
    earlier = Window.partitionBy("__digit").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__at", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).join(starts, "__digit").select("__block", "__digit", (F.col("__at") + F.col("__first")).alias("__at"))
    names = [c for c in rows.columns if c not in ("__block", "__digit")]
    place, size = names.index("__pos"), 1 << block_bits

    def move(block: pa.Table, at: pa.Table) -> pa.Table:
        pos = block["__pos"].to_numpy() & (size - 1)
        slot = np.full(size, -1, dtype=np.int64)
        slot[pos] = np.arange(len(pos))
        by_place = slot[slot >= 0]
        digits = block["__digit"].to_numpy()[by_place].astype(np.uint16)
        order = np.argsort(digits, kind="stable")  # of 16-bit numbers: a counting sort
        to = np.zeros(1 << DIGIT_BITS, dtype=np.int64)
        to[at["__digit"].to_numpy()] = at["__at"].to_numpy()
        d = digits[order]
        run = np.arange(len(d)) - np.searchsorted(d, d, side="left")
        cols = [block[c] if i != place else None for i, c in enumerate(names)]
        order = by_place[order]
        cols = [pa.array(to[d] + run) if c is None else c.take(pa.array(order)) for c in cols]
        return pa.table(cols, names=names)

    return rows.groupBy("__block").cogroup(offsets.groupBy("__block")).applyInArrow(move, rows.select(*names).schema)


def radix_ranks(rows: DataFrame, keys: list[tuple[str, int]], scratch: Scratch) -> DataFrame:
    """rows with `__pos`: their rank from 0 by `keys`, the most significant first, each a long of so many bits without sign. Rows with all keys equal are ranked
    in any order. Every pass is a table in the shared folder, so a lost executor costs a part of one pass."""
    rows = scratch.write(rows.withColumn("__pos", F.monotonically_increasing_id()))
    n = rows.count()
    block_bits = min(max((n >> 10).bit_length(), LEAST_BLOCK), MOST_BLOCK)
    for key, bits in reversed(keys):
        for shift in range(0, bits, DIGIT_BITS):
            moved = scratch.write(counting_pass(rows, key, shift, block_bits, scratch))
            scratch.drop(rows)
            rows = moved
    return rows


def nth_highest(values: DataFrame, column: str, n: int) -> int | None:
    """The n-th highest value of a long column: counts of ever narrower cells, 2^DIGIT_BITS at most in a step, never the values themselves."""
    lo, hi = values.agg(F.min(column), F.max(column)).first()
    if lo is None or n <= 0:
        return None
    while lo < hi:
        shift = max((hi - lo).bit_length() - DIGIT_BITS, 0)
        cell = F.shiftright(F.col(column) - lo, shift).alias("cell")
        counts = values.where(F.col(column).between(lo, hi)).groupBy(cell).count().collect()
        for c, m in sorted(map(tuple, counts), reverse=True):
            if n <= m:
                lo, hi = lo + (c << shift), min(hi, lo + ((c + 1) << shift) - 1)
                break
            n -= m
    return lo


def resample(docs: DataFrame, target: DataFrame, scratch: Scratch, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), a row for each row of docs: `percent` of those of at least `least_words` words are drawn towards target's texts.

    Features are runs of 1 to RUN words, which may overlap; a weight is the sum of the gains of their buckets, and the score adds a draw that the id decides.
    Drawn are the highest scores, ties to the smaller doc_id; `rank` counts from 1 and is null for the others. A null doc_id is the smallest; rows that repeat a
    doc_id are documents of their own, and of equal ones either is drawn first. A null or empty text has no words and is never drawn; an empty table gives
    none, and an empty target a distribution that knows no feature. Extra columns are not read.

    All documents are scored; those that reach the score at which the draw ends are sorted by (score, doc_id), a digit at a time.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = scratch.write(scores(docs, gain))
    enough = scored.where(F.col("n_words") >= least_words)
    k = percent * enough.count() // 100
    last = nth_highest(enough, "score", k)
    none = F.lit(None).cast("long").alias("rank")
    cols = ["doc_id", "n_features", "weight", "score"]
    if last is None:
        return scored.select(*cols, none)
    reach = (F.col("n_words") >= least_words) & (F.col("score") >= last)
    top = scored.where(reach)
    best, lo, hi = top.agg(F.max("score"), F.min("doc_id"), F.max("doc_id")).first()
    lo, hi = (0, 0) if lo is None else (lo, hi)
    near = hi - lo < 2**62
    minor = F.coalesce(F.col("doc_id") - lo + 1, F.lit(0)) if near else F.coalesce(F.col("doc_id"), F.lit(LEAST_ID)).bitwiseXOR(F.lit(LEAST_ID))
    rows = top.select(*cols, (F.lit(best) - F.col("score")).alias("__major"), minor.alias("__minor"))
    ranked = radix_ranks(rows, [("__major", (best - last).bit_length()), ("__minor", (hi - lo + 1).bit_length() if near else 64)], scratch)
    rank = F.when(F.col("__pos") < k, F.col("__pos") + 1).alias("rank")
    return scored.where(~reach).select(*cols, none).unionAll(ranked.select(*cols, rank))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: features, weight towards the benchmark's texts, score and rank in the draw."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark))


def _features_sql(name: str, rows: str) -> str:
    words = f"regexp_extract_all({LOWER_SQL.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""{name}w AS MATERIALIZED (SELECT {rows}, {words} AS w FROM {'documents' if name == 's' else 'benchmark'}), {name}p AS (SELECT id, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM {name}w),
{name}r AS (SELECT id, a, a || ' ' || lead(a) OVER o AS b, a || ' ' || lead(a) OVER o || ' ' || lead(a, 2) OVER o AS c FROM {name}p WINDOW o AS (PARTITION BY id ORDER BY i)),
{name}f AS MATERIALIZED (SELECT id, a AS g FROM {name}r UNION ALL SELECT id, b FROM {name}r WHERE b IS NOT NULL UNION ALL SELECT id, c FROM {name}r WHERE c IS NOT NULL)"""


SQL = f"""
WITH {_features_sql("s", "doc_id AS id")}, {_features_sql("t", "item_id AS id")},
x AS MATERIALIZED (SELECT g, hex(encode(g)) AS x FROM (SELECT g FROM sf UNION SELECT g FROM tf)), c AS MATERIALIZED (SELECT g, {crc_sql("x")} % {BUCKETS} AS b FROM x),
s AS (SELECT b, count(*) AS n FROM sf JOIN c USING (g) GROUP BY b), t AS (SELECT b, count(*) AS n FROM tf JOIN c USING (g) GROUP BY b), z AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS s, coalesce((SELECT sum(n) FROM t), 0)::DOUBLE AS t),
k AS (SELECT s.b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (z.s + {BUCKETS}) / ((s.n + 1)::DOUBLE * (z.t + {BUCKETS})))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b), z),
d AS (SELECT id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM sf JOIN c USING (g) JOIN k USING (b) GROUP BY id),
e AS (SELECT w.id, len(w.w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('{SEED}:' || w.id), 1, 8) AS BIGINT) AS h FROM sw w LEFT JOIN d USING (id)),
f AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM e),
r AS (SELECT *, CASE WHEN words >= {LEAST_WORDS} THEN row_number() OVER (PARTITION BY words >= {LEAST_WORDS} ORDER BY score DESC, id) END AS place, count(*) FILTER (WHERE words >= {LEAST_WORDS}) OVER () AS able FROM f)
SELECT id AS doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * able // 100 THEN place END AS rank FROM r
"""
