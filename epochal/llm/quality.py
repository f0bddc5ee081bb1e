"""Quality classifier: overlapping heuristic labellers, their accuracies by expectation-maximisation, and a hashed linear scorer trained on the posteriors."""

from __future__ import annotations

import math
import operator
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import plain, table

#: Documents that the scorer is trained on, at most (the first by hash of their id), and its hashed features.
TRAIN_ROWS, FEATURES = 6_000, 1 << 12
ROUNDS, EPOCHS, RATE, RIDGE = 60, 12, 0.5, 1e-4
SEED = 11
_UPPER, _LOWER, _DIGITS = re.compile("[A-Z\u00c0-\u00de]+"), re.compile("[a-z\u00df-\u00ff]+"), re.compile(r"\d+")
_MAIL = re.compile(r"[\w.+-]+@[\w-]+\.\w+")
_NUMBERS = re.compile(r"\b\d{13,16}\b|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b[0-9a-f]{32,}\b")
_SYMBOLS = np.frombuffer(b"#$%&*@|~^=<>{}\\/_", dtype=np.uint8)

NAMES = ("shouting", "symbols", "marks", "tables", "repeated_words", "repeated_lines", "sentences", "short", "word_lengths", "digits", "personal")


def measures(text: str) -> tuple[float, ...]:
    """What the labellers and the scorer look at, of a whole text."""
    tokens = text.split()
    n = max(len(tokens), 1)
    byte = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
    capitals, digit = int(byte[65:91].sum()), int(byte[48:58].sum())
    letters = max(capitals + int(byte[97:123].sum() + byte[192:].sum()), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    marks = sum(text.count(x) for x in ("!!", "??", "***", "###", "%%%", "&&&", "$$$")) / n
    ends = (text.count(". ") + text.count(".\n") + text.count("? ") + text.count("! ") + text.endswith((".", "!", "?"))) / n
    personal = (len(_MAIL.findall(text)) if byte[64] else 0) + (len(_NUMBERS.findall(text)) if digit else 0)
    return (
        capitals / letters, int(byte[_SYMBOLS].sum()) / n, marks, text.count(" | ") / n, len(set(tokens)) / n, sum(map(operator.eq, tokens, tokens[1:])) / n,
        1 - len(set(lines)) / max(len(lines), 1), ends, sum(map(len, tokens)) / n, digit / max(len(text), 1), personal / n, float(len(tokens)),
    )


def votes(m: tuple[float, ...]) -> tuple[int, ...]:
    """A vote of each labeller: 1 good, 0 bad, -1 no opinion."""
    upper, symbols, marks, bars, distinct, runs, dup_lines, ends, mean, digits, personal, n = m
    say = lambda bad, good: 0 if bad else 1 if good else -1
    return (
        say(upper > 0.3, upper < 0.12), say(symbols > 0.15, symbols < 0.02), say(marks > 0.1, marks == 0), say(bars > 0.15, bars == 0),
        say(runs > 0.1 or (n > 50 and distinct < 0.2), runs < 0.03 and distinct > 0.25 or n < 20), say(dup_lines > 0.3, dup_lines < 0.1 and n > 5),
        say(ends < 0.01 and n > 30, ends > 0.03), say(n < 3, n > 12), say(mean > 14 or (mean < 2.5 and n > 5), 3 < mean < 11), say(digits > 0.15, digits < 0.03), say(personal > 0.02, personal == 0),
    )


def pattern_of(v: tuple[int, ...]) -> int:
    return sum((x + 1) * 3**i for i, x in enumerate(v))


class LabelModel:
    """Labellers vote independently given the truth; how often each votes what under either truth, and how common good texts are, are what EM estimates."""

    def __init__(self, prior: float, rates: np.ndarray):
        self.prior, self.rates = prior, rates  # rates[truth, labeller, vote + 1]

    def posterior(self, v: np.ndarray) -> np.ndarray:
        j = np.arange(v.shape[1])
        good = math.log(self.prior) + np.log(self.rates[1, j, v + 1]).sum(axis=1)
        bad = math.log(1 - self.prior) + np.log(self.rates[0, j, v + 1]).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))

    def accuracies(self) -> np.ndarray:
        """Share of each labeller's votes (abstentions left out) that are right."""
        p = np.array([1 - self.prior, self.prior])
        right = p[0] * self.rates[0, :, 1] + p[1] * self.rates[1, :, 2]
        cast = right + p[0] * self.rates[0, :, 2] + p[1] * self.rates[1, :, 1]
        return right / np.maximum(cast, 1e-12)


def estimate(patterns: dict[int, int], labellers: int = len(NAMES), rounds: int = ROUNDS) -> LabelModel:
    """EM over vote patterns and their numbers (at most 3^labellers of them), from the majority's word. Votes get a tenth of a pseudo-count."""
    codes = np.array(sorted(patterns) or [0], dtype=np.int64)
    count = np.array([patterns.get(int(c), 0) for c in codes], dtype=np.float64)
    v = np.stack([(codes // 3**j) % 3 - 1 for j in range(labellers)], axis=1)
    against = (v == 0).sum(axis=1)
    p = np.where(against == 0, 0.95, np.where(against == 1, 0.45, 0.05))
    model = None
    for _ in range(rounds):
        total = count.sum()
        prior = min(max(float((count * p).sum() / max(total, 1)), 0.02), 0.98)
        rates = np.empty((2, labellers, 3))
        for truth, weight in ((0, count * (1 - p)), (1, count * p)):
            for j in range(labellers):
                own = np.bincount(v[:, j] + 1, weights=weight, minlength=3) + 0.1
                rates[truth, j] = own / own.sum()
        model = LabelModel(prior, rates)
        new = model.posterior(v)
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return model


def features(text: str, m: tuple[float, ...]) -> np.ndarray:
    """Hashed features of a text: its measures in steps and the shapes of its words (A, a and 0 for runs of capitals, other letters and digits). Each counts once."""
    names = {f"m{i}:{round(8 * math.log1p(20 * x))}" for i, x in enumerate(m[:-1])}
    names.add(f"n:{round(math.log2(m[-1] + 1))}")
    names.update("s:" + t[:8] for t in set(_DIGITS.sub("0", _LOWER.sub("a", _UPPER.sub("A", text))).split()))
    return np.unique(np.array([zlib.crc32(x.encode("utf-8", "surrogatepass"), SEED) % FEATURES for x in names], dtype=np.int64))


def train(rows: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """Weights of a logistic model on soft targets, by gradient steps with shrinking per-weight rates (AdaGrad), in a fixed order."""
    w, squares = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-3)
    for _ in range(EPOCHS):
        for at, y in zip(rows, target):
            scale = 1 / math.sqrt(len(at) + 1)
            p = 1 / (1 + math.exp(-max(min(w[at].sum() * scale + w[-1], 30), -30)))
            g = (p - y) * scale + RIDGE * w[at]
            squares[at] += g * g
            w[at] -= RATE * g / np.sqrt(squares[at])
            squares[-1] += (p - y) ** 2
            w[-1] -= RATE * (p - y) / math.sqrt(squares[-1])
    return w


def score_of(at: np.ndarray, w: np.ndarray) -> float:
    return 1 / (1 + math.exp(-max(min(w[at].sum() / math.sqrt(len(at) + 1) + w[-1], 30), -30)))


def count_patterns(docs: DataFrame) -> dict[int, int]:
    """How many documents have each vote pattern, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array([pattern_of(votes(measures(t.as_py() or ""))) for t in b.column(0)], pa.int64())], names=["pattern"])

    found = docs.select("text").mapInArrow(run, "pattern long").groupBy("pattern").count()
    return {r.pattern: r["count"] for r in found.collect()}  # at most 3^11


def fit(docs: DataFrame) -> tuple[LabelModel, np.ndarray]:
    """The label model of all documents, and the scorer's weights from the first TRAIN_ROWS by hash of doc_id. No reviewed label is used. A doc_id that rows
    repeat is trained on once, with the least of its texts."""
    model = estimate(count_patterns(docs))
    n = docs.agg(F.approx_count_distinct("doc_id", 0.02)).first()[0]  # ids, not rows: a repeated id has one hash
    h = F.xxhash64("doc_id")
    ids = docs.select("doc_id", h.alias("h")).where("doc_id is not null")
    if n > 4 * TRAIN_ROWS:  # the TRAIN_ROWS least hashes of n ids lie far below this bound
        ids = ids.where(F.col("h") < int(-(2**63) + 2**64 * 4 * TRAIN_ROWS / n))
    ids = ids.distinct().orderBy("h", "doc_id").limit(TRAIN_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, t in zip(b.column(0).to_pylist(), b.column(1)):
                m = measures(t.as_py() or "")
                out.append((doc, list(votes(m)), features(t.as_py() or "", m).tolist()))
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int32())), pa.array([x[2] for x in out], pa.list_(pa.int32()))], names=["doc_id", "votes", "at"])

    chosen = docs.select("doc_id", "text").join(F.broadcast(ids.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    sample = chosen.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, votes array<int>, at array<int>").toArrow()
    rows = sorted(zip(sample["doc_id"].to_pylist(), sample["votes"].to_pylist(), sample["at"].to_pylist()))
    if not rows:
        return model, np.zeros(FEATURES + 1)
    target = model.posterior(np.array([r[1] for r in rows]))
    order = np.random.default_rng(SEED).permutation(len(rows))
    return model, train([np.array(rows[i][2], dtype=np.int64) for i in order], target[order])


def score_documents(docs: DataFrame, model: LabelModel, weights: np.ndarray) -> DataFrame:
    """docs with __posterior (of the label model), __score (of the linear scorer) and __votes. Null and empty texts are judged by what they are: short.
    Equal texts and repeated rows score alike; extra columns pass through, but for names that start with two underscores, which are the operators' own."""
    docs = plain(docs)
    share = docs.sparkSession.sparkContext.broadcast((model, weights))
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, w = share.value
        for b in batches:
            v, s = [], []
            for t in b.column(at):
                text = t.as_py() or ""
                x = measures(text)
                v.append(votes(x))
                s.append(score_of(features(text, x), w))
            p = m.posterior(np.array(v)) if v else np.zeros(0)
            cols = [*b.columns, pa.array(p, pa.float64()), pa.array(s, pa.float64()), pa.array([sum(y >= 0 for y in x) for x in v], pa.int32())]
            yield pa.record_batch(cols, names=[f"c{i}" for i in range(len(cols))])

    safe = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    kinds = [*(f.dataType for f in docs.schema.fields), T.DoubleType(), T.DoubleType(), T.IntegerType()]
    return safe.mapInArrow(run, T.StructType([T.StructField(f"c{i}", k) for i, k in enumerate(kinds)])).toDF(*names, "__posterior", "__score", "__votes")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the label model's posterior that it is good, the scorer's, and whether to keep it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_documents(docs, *fit(docs))
    return out.select("doc_id", F.col("__votes").alias("n_votes"), F.col("__posterior").alias("posterior"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("keep"))
