"""Toxicity: a lexicon learnt from labels, kept as a trie and met by Levenshtein automata; context windows tell quotation from abuse."""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import plain, table

#: Labelled rows that the lexicon is learnt from, at most: the first of each class by hash of their id, as good as drawn by lot; and their bytes by class, at most.
TOXIC_ROWS, CLEAN_ROWS, CLASS_BYTES, TEXT_BYTES = 2_000, 6_000, 32 << 20, 2 << 20
#: Least share of the toxic rows (and least number) that a term must explain, the most clean rows that may hold it by share, and what each of these counts against it.
LEAST_SHARE, LEAST_ROWS, CLEAN_SHARE, CLEAN_COST = 0.002, 4, 0.03, 3
#: Terms that explain a row before it counts no more, and what the next one gains by those still wanted.
COVER, GAINS = 3, (0, 0.5, 0.7, 1)
#: Misspelt hits of a term count if they are toxic at least this often.
SURE = 0.7
#: Ways to be misspelt: the whole word is one edit from the term, or only its beginning is one edit from a stem.
ENDS, GOES_ON = 1, 2
STEM_CHARS = range(4, 9)
SLOTS = 1 << 20
#: States of the automata that are kept (about a kilobyte each), and words whose term is remembered.
STATES, KNOWN = 20_000, 200_000
#: Words on either side that a hit is judged by.
WINDOW = 6
QUOTED = 0.4
# Marks and words that report another's speech, and words that address someone, in English, German, French and Spanish.
REPORTING = frozenset((
    "quote quoted quotes said says wrote writes called term word slur example cited mention mentioned zitat zitiert sagt sagte schrieb schreibt nannte wort beleidigung beispiel erwähnt "
    "citation cité cite disait écrit écrivait appelé terme mot insulte exemple mentionné cita citado dice dijo escribió escribe llamó término palabra insulto ejemplo mencionado"
).split())
ADDRESS = frozenset("you your you're u ur yours du dich dir dein deine euch toi vous votre tú usted ustedes".split())
OPENERS, CLOSERS = "\"“«„‘", "\"”»“’"
_WORD = re.compile(r"[^\W_]+")


class Lexicon:
    """Terms in a trie. A term is a whole word or a stem that any word may go on from.

    Each has the precision of its exact and of its misspelt hits, and, if clean rows hold it too, how often it stands in the toxic and the clean rows that do:
    (prior log-odds, mean and spread of the log of hits a word for toxic, the same for clean), or None. A fourth value, if given, is the precision of misspelt
    stems that the word goes on from; else these count as other misspelt hits do.
    """

    def __init__(self, terms: dict[tuple[str, bool], tuple]):
        self.terms = terms
        self.stems = {t for t, whole in terms if not whole}
        self.stem_sizes = sorted({len(t) for t in self.stems})
        self.words = {t for t, whole in terms if whole}
        self.children: list[dict[str, int]] = [{}]
        self.term_at: dict[int, str] = {}
        for t in sorted(self.words | self.stems):
            node = 0
            for c in t:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            self.term_at[node] = t
        self.letters = {c for t, _ in terms for c in t}
        self._forget()
        self.known: dict[str, tuple[str, bool, int] | None] = {}

    def __getstate__(self):
        return self.terms

    def __setstate__(self, terms):
        self.__init__(terms)

    def find(self, word: str) -> tuple[str, bool, int] | None:
        """(term, whole, misspelt) that a lower-case word stands for; misspelt is False, ENDS or GOES_ON."""
        if word not in self.known:
            if len(self.known) > KNOWN:
                self.known.clear()
            self.known[word] = self._find(word)
        return self.known[word]

    def exact(self, word: str) -> tuple[str, bool, int] | None:
        if word in self.words:
            return word, True, False
        for n in self.stem_sizes:
            if word[:n] in self.stems:
                return word[:n], False, False
        return None

    def _find(self, word: str) -> tuple[str, bool, int] | None:
        if found := self.exact(word):
            return found
        sure = [x for x in self.near(word) if self.precision(*x) >= SURE]
        return min(sure, key=lambda x: (-self.precision(*x), x[2], x)) if sure else None

    def precision(self, term: str, whole: bool, misspelt: int) -> float:
        values = self.terms[term, whole]
        return values[3] if misspelt == GOES_ON and len(values) > 3 else values[1 if misspelt else 0]

    def near(self, word: str) -> set[tuple[str, bool, int]]:
        """(term, whole, misspelt) of all terms at edit distance 1 from word, or of stems from its beginning (a swap of neighbours is one edit).

        The terms' Levenshtein automata run over the trie together, made deterministic as words ask for it; a word is left as soon as no state remains.
        """
        state, on = self.start, set()
        for c in word:
            on.update(state[2])
            key = c if c in self.letters else ""
            state = state[0].get(key) or self._step(state, key)
            if not state[1]:
                return {(t, False, GOES_ON) for t in on}
        ends = state[3]
        return {(t, whole, ENDS) for t in ends for whole in (True, False) if (t, whole) in self.terms} | {(t, False, GOES_ON) for t in on if t not in ends}

    def _forget(self) -> None:
        self.states: dict[frozenset, tuple] = {}
        self.start = self._state(frozenset({(0, 0, "")}))

    def _state(self, places: frozenset) -> tuple[dict, frozenset, frozenset, frozenset]:
        """(next states by letter, places, stems read by now, terms read by now) with one edit at most.

        A place is a node of the trie, the edits spent, and the letter that a swap still waits for.
        """
        if places not in self.states:
            ends = {self.term_at[n] for n, _, wait in places if not wait and n in self.term_at}
            ends |= {self.term_at[m] for n, e, _ in places if e == 0 for m in self.children[n].values() if m in self.term_at}
            self.states[places] = ({}, places, frozenset(ends & self.stems), frozenset(ends))
        return self.states[places]

    def _step(self, state: tuple, c: str) -> tuple:
        then = set()
        for node, e, wait in state[1]:
            if wait:
                if wait == c:
                    then.add((node, 1, ""))
                continue
            children = self.children[node]
            if c in children:
                then.add((children[c], e, ""))
            if e == 0:
                then.add((node, 1, ""))
                for x, m in children.items():
                    then.add((m, 1, ""))
                    if c in self.children[m]:
                        then.add((self.children[m][c], 1, ""))
                        then.add((self.children[m][c], 1, x))
        if len(self.states) > STATES:
            self._forget()
        state[0][c] = out = self._state(frozenset(then))
        return out

    def bad_words(self, low: str) -> set[str]:
        return {w for w in set(_WORD.findall(low)) if self.find(w)}

    def counts(self, text: str) -> tuple[Counter, int]:
        """How often each term is met as it is spelt, and the number of words."""
        low = text.lower()
        bad = self.bad_words(low)
        words = _WORD.findall(low)
        return Counter(self.find(w)[:2] for w in words if w in bad and not self.find(w)[2]), len(words)

    def score(self, text: str | None) -> float:
        """Noisy-or of the terms found: hits count less where their context, WINDOW words on either side, reports speech, more where it addresses someone."""
        if not text:
            return 0.0
        low = text.lower()
        bad = self.bad_words(low)
        if not bad:
            return 0.0
        found = list(_WORD.finditer(low))
        words = len(found)
        clean = 1.0
        often: dict[tuple[str, bool], float] = {}
        for i, m in enumerate(found):
            if m[0] not in bad:
                continue
            term, whole, misspelt = self.find(m[0])
            density, sure = self.terms[term, whole][2], self.precision(term, whole, misspelt)
            around = {x[0] for x in found[max(0, i - WINDOW) : i]} | {x[0] for x in found[i + 1 : i + 1 + WINDOW]}
            marks = low[m.start() - 1 : m.start()], low[m.end() : m.end() + 1]
            quoted = marks[0] and marks[0] in OPENERS and marks[1] and marks[1] in CLOSERS or len(around & REPORTING) >= 2
            weight = QUOTED if quoted else 1.5 if around & ADDRESS else 1.0
            if density:
                if not misspelt:
                    often[term, whole] = often.get((term, whole), 0) + weight
            else:
                clean *= (1 - sure) ** weight if weight > 1 else 1 - weight * sure
        for term, n in often.items():
            prior, m1, s1, m0, s0 = self.terms[term][2]
            x = math.log(n / words)
            odds = prior - (x - m1) ** 2 / (2 * s1 * s1) - math.log(s1) + (x - m0) ** 2 / (2 * s0 * s0) + math.log(s0)
            if x > m1:
                odds = max(odds, prior - math.log(s1) + (m1 - m0) ** 2 / (2 * s0 * s0) + math.log(s0))
            clean *= 1 / (1 + math.exp(max(-50.0, min(50.0, odds))))
        return 1 - clean


def _candidates(words: set[str]) -> set[tuple[str, bool]]:
    out = {(w, True) for w in words if len(w) >= 3}
    for w in words:
        out |= {(w[:n], False) for n in STEM_CHARS if n <= len(w)}
    return out


def _without_copies(rows: list[array], names: list[str], size: int = 16) -> list[array]:
    """Rows without those that share half of their smallest word digests with an earlier one: a word of one text and its copies is no vocabulary."""
    index: dict[int, list[int]] = {}
    kept = []
    for w in rows:
        small = sorted(zlib.crc32(names[i].encode()) for i in w)[:size]
        shared = Counter(i for x in small for i in index.get(x, ()))
        if small and max(shared.values(), default=0) * 2 < len(small):
            for x in small:
                index.setdefault(x, []).append(len(kept))
            kept.append(w)
    return kept


def learn(rows: list[tuple[str, int]]) -> Lexicon:
    """Terms that occur in toxic rows and hardly ever in clean ones, taken greedily while each still explains toxic rows that few earlier terms do.

    Rows are held as numbers of their distinct words, so that memory grows with the vocabulary and four bytes for each word of a row.
    """
    number: dict[str, int] = {}
    split = {k: [array("I", sorted({number.setdefault(w, len(number)) for w in _WORD.findall(t.lower())})) for t in dict.fromkeys(t for t, y in rows if y == k)] for k in (0, 1)}
    names = list(number)
    del number
    toxic, clean = _without_copies(split[1], names), split[0]
    candidates = lambda row: _candidates({names[i] for i in row})
    least = max(LEAST_ROWS, LEAST_SHARE * len(toxic))
    rough = [0] * SLOTS  # candidates share slots, so a slot says at most how often each of them occurs; only those that may be common are counted one by one
    for w in toxic:
        for c in candidates(w):
            rough[hash(c) % SLOTS] += 1
    count: Counter = Counter()
    for w in toxic:
        count.update(c for c in candidates(w) if rough[hash(c) % SLOTS] >= least)
    count = Counter({c: n for c, n in count.items() if n >= least})
    against: Counter = Counter()
    for w in clean:
        against.update(candidates(w) & count.keys())
    good = {c for c in count if against[c] <= CLEAN_SHARE * len(clean)}
    holds: dict[tuple[str, bool], set[int]] = {c: set() for c in good}
    for i, w in enumerate(toxic):
        for c in candidates(w) & good:
            holds[c].add(i)
    share = len(toxic) / max(len(clean), 1)
    need = [COVER] * len(toxic)
    value = lambda c: sum(GAINS[need[i]] for i in holds[c]) - CLEAN_COST * share * against[c]
    # at equal gain the longer stem, but a whole word only if no stem says more
    rank = lambda c: (-value(c), c[1], -len(c[0]), c[0])
    chosen: list[tuple[str, bool]] = []
    # a term within a chosen stem, or a shorter stem that adds little, says nothing new
    same = lambda c, b: not b[1] and c[0].startswith(b[0]) or b[0].startswith(c[0]) and len(holds[c]) <= 1.3 * len(holds[b])
    queue = sorted(good, key=rank)
    while queue:
        best = min(queue[:400], key=rank)
        if value(best) < least:
            break
        for i in holds[best]:
            need[i] = max(need[i] - 1, 0)
        chosen.append(best)
        queue = sorted((c for c in queue if c != best and value(c) >= least and not same(c, best)), key=rank)
    terms = {c: ((len(holds[c]) + 1) / (len(holds[c]) + against[c] * share + 1.05), 1.0, None) for c in chosen}
    first = Lexicon(terms)
    wrong: Counter = Counter()
    right: Counter = Counter()
    near: dict[int, tuple] = {}
    for i in sorted(range(len(names)), key=names.__getitem__):  # words that begin alike share states
        if not first.exact(names[i]) and (found := first.near(names[i])):
            near[i] = tuple(found)
    for group, tally in ((clean, wrong), (toxic, right)):
        for w in group:
            tally.update({x for i in w if i in near for x in near[i]})
    del names
    texts = {k: list(dict.fromkeys(t for t, y in rows if y == k)) for k in (0, 1)}
    logs: dict[tuple[tuple[str, bool], int], list[float]] = {}
    mixed = {c for c in terms if against[c]}
    for k, own in texts.items():
        for t in own if mixed else []:
            n, words = first.counts(t)
            for c, m in n.items():
                if c in mixed:
                    logs.setdefault((c, k), []).append(math.log(m / words))
    out = {}
    for c, (p, _, _) in terms.items():
        density = None
        if c in mixed:
            x1, x0 = logs.get((c, 1), [-5.0]), logs.get((c, 0), [-9.0])
            spread = lambda x, m: math.sqrt(sum((v - m) ** 2 for v in x) / len(x) + 0.1)
            m1, m0 = sum(x1) / len(x1), sum(x0) / len(x0)
            density = (math.log(len(x1) / len(x0)), m1, spread(x1, m1), m0, spread(x0, m0))
        sure = [0.0 if c in mixed else (right[*c, k] + 1) / (right[*c, k] + wrong[*c, k] * 2 + 1.2) for k in (ENDS, GOES_ON)]
        out[c] = (p, sure[0], density, sure[1])
    return Lexicon(out)


def fit(documents: DataFrame, labels: DataFrame) -> Lexicon:
    """Learns from at most TOXIC_ROWS and CLEAN_ROWS labelled rows, the first by hash of their id, as far as they have CLASS_BYTES; rows with null labels, texts or
    ids are left out, and so is a text of more than TEXT_BYTES, which says little of one word and would take the room of many. An id is one row, however often either table repeats it: toxic if any label says so, with the least of its texts."""
    train = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    order = train.select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct().withColumn("h", F.xxhash64("doc_id"))
    first = order.where("toxic = 1").orderBy("h", "doc_id").limit(TOXIC_ROWS).unionAll(order.where("toxic = 0").orderBy("h", "doc_id").limit(CLEAN_ROWS))
    ids = first.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("h").alias("h"))  # at most TOXIC_ROWS + CLEAN_ROWS rows
    rows = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where(F.octet_length("text") <= TEXT_BYTES).groupBy("doc_id", "toxic", "h").agg(F.min("text").alias("text"))
    so_far = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("toxic").orderBy("h", "doc_id"))
    sample = rows.withColumn("bytes", so_far).where(F.col("bytes") <= CLASS_BYTES).select("text", "toxic").toArrow()
    return learn(sorted(zip(sample["text"].to_pylist(), sample["toxic"].to_pylist())))


def score_documents(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs with __score between 0 and 1. Null and empty texts score 0; equal texts and repeated rows score alike; extra columns pass through, but for names that
    start with two underscores, which are the operators' own."""
    docs = plain(docs)
    model = docs.sparkSession.sparkContext.broadcast(lexicon)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.value.score
        for b in batches:
            yield pa.record_batch([*b.columns, pa.array([score(t.as_py()) for t in b.column(at)], pa.float64())], names=[f"c{i}" for i in range(len(names) + 1)])

    safe = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)] + [T.StructField(f"c{len(names)}", T.DoubleType())])
    return safe.mapInArrow(run, schema).toDF(*names, "__score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether it is held out from learning (as one without a doc_id is), its score and the label that it gets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    return out.select("doc_id", held.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
