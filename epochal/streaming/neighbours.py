"""Change points of a stream whose keyed state is read and written around what comes in: an observation looks at its two neighbours, however long the entity's history is.

An entity's observations lie in blocks of at most BLOCK, by time. What a batch brings is merged into the blocks that it falls in, so an entity of one block costs one
entry read and one written a batch. An entity of more keeps the times at which its further blocks begin in a tree of bitmaps: 64 bits of a time are LEVELS digits of
BITS bits, and for every prefix of digits that occurs, a bitmap of the digits that follow it. The nearest time before or after another is found by going up to a
prefix that has a lower or higher digit, and down again: some entries of state, never a scan. A new block writes itself and a bitmap a level at most.

Entities are dealt into GROUPS by their hash, as a call of the processor and its frames cost far more than the few rows that a batch brings of an entity.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

BITS, LEVELS = 8, 8
_OFFSET = 1 << 63
#: Observations of a block, and groups that entities are dealt into (for good, as the state lies by group).
BLOCK, GROUPS = 512, 4096
#: Level and prefix of an entity's first block, which its count of changes lies with.
FIRST = (-1, 0)
_NONE = object()  # the state before an entity's first

VALUE = T.StructType([T.StructField("bits", T.BinaryType()), T.StructField("state", T.StringType())])


class Times:
    """An ordered set of 64-bit times with a state each, over a mapping (level, prefix) -> (bitmap, state) that `get` and `put` reach; at the last level the
    prefix is the time itself."""

    def __init__(self, get, put):
        self.get, self.put = get, put

    def state(self, t: int) -> tuple[bool, str | None]:
        found = self.get(LEVELS, t)
        return (False, None) if found is None else (True, found[1])

    def add(self, t: int, state: str | None) -> None:
        self.put(LEVELS, t, (None, state))
        u = t + _OFFSET
        for level in range(LEVELS - 1, -1, -1):
            u, digit = u >> BITS, u & ((1 << BITS) - 1)
            found = self.get(level, u)
            bits = int.from_bytes(found[0], "little") if found else 0
            if bits >> digit & 1:
                return  # and so do all levels above
            self.put(level, u, ((bits | 1 << digit).to_bytes((1 << BITS) // 8, "little"), None))
            if bits:
                return

    def beside(self, t: int, after: bool) -> int | None:
        """The nearest time strictly before t, or after it."""
        u = t + _OFFSET
        for level in range(LEVELS - 1, -1, -1):
            up, digit = u >> BITS, u & ((1 << BITS) - 1)
            if found := self.get(level, up):
                bits = int.from_bytes(found[0], "little")
                bits = bits >> (digit + 1) << (digit + 1) if after else bits & ((1 << digit) - 1)
                if bits:
                    u = up << BITS | self._end(bits, after)
                    for below in range(level + 1, LEVELS):
                        u = u << BITS | self._end(int.from_bytes(self.get(below, u)[0], "little"), after)
                    return u - _OFFSET
            u = up
        return None

    @staticmethod
    def _end(bits: int, least: bool) -> int:
        return (bits & -bits).bit_length() - 1 if least else bits.bit_length() - 1


def insert(times: Times, t: int, state: str | None) -> list[tuple[int, str | None, bool]]:
    """(time, state, added) of the change points that come or go when an observation comes in. The first state told for a time stays."""
    if times.state(t)[0]:
        return []
    before, after = times.beside(t, False), times.beside(t, True)
    left = None if before is None else times.state(before)
    right = None if after is None else times.state(after)
    out = []
    if left is None or left[1] != state:
        out.append((t, state, True))
    if right is not None:
        was, now = left is None or left[1] != right[1], state != right[1]
        if was != now:
            out.append((after, right[1], now))
    times.add(t, state)
    return out


def merged(times: list[int], states: list, fresh: list[tuple[int, str | None]], before) -> tuple[list[int], list, list[tuple[int, str | None, bool]]]:
    """A block's times and states with fresh observations, both by time, and (time, state, added) of the change points that come or go in it.

    before is the state ahead of the block, as it was and as it is. The first state told for a time stays.
    """
    was, now = before
    at, into, changes, i = [], [], [], 0
    for t, state in [*fresh, (None, None)]:
        while i < len(times) and (t is None or times[i] <= t):
            s = states[i]
            if (stood := was is _NONE or was != s) != (stands := now is _NONE or now != s):
                changes.append((times[i], s, stands))
            at.append(times[i])
            into.append(s)
            was = now = s
            i += 1
        if t is not None and (not at or at[-1] != t):
            if now is _NONE or now != state:
                changes.append((t, state, True))
            at.append(t)
            into.append(state)
            now = state
    return at, into, changes


class Blocks:
    """An entity's observations in blocks over a mapping (level, prefix) -> (bitmap, text) that `get` and `put` reach."""

    def __init__(self, get, put):
        self.get, self.put, self.times = get, put, Times(get, put)
        found = get(*FIRST)
        self.n, self.more, *self.first = json.loads(found[1]) if found else (0, False, [], [])

    def block(self, start: int | None) -> list:
        """[times, states] of the block that begins there; None names the first."""
        return self.first if start is None else json.loads(self.get(LEVELS, start)[1])

    def start(self, t: int) -> int | None:
        """Where the block begins that t lies in."""
        if not self.more or self.get(LEVELS, t) is not None:
            return t if self.more else None
        return self.times.beside(t, False)

    def next(self, start: int | None) -> int | None:
        return self.times.beside(-_OFFSET if start is None else start, True) if self.more else None

    def insert(self, rows: list[tuple[int, str | None]]) -> list[tuple[int, str | None, bool, int]]:
        """(time, state, added, n) of the change points that come or go when rows come in, which lie by time; n counts the entity's changes."""
        out, i, behind, wrote = [], 0, None, False  # behind: the block after the one just done, and the state ahead of it as it was and is
        while i < len(rows) or behind:
            if behind:
                start, before = behind
            else:
                start = self.start(rows[i][0])
                ahead = None if start is None else self.start(start - 1)
                before = (_NONE, _NONE) if start is None else (self.block(ahead)[1][-1],) * 2
            after, mine = self.next(start), []
            while i < len(rows) and (after is None or rows[i][0] < after):
                mine.append(rows[i])
                i += 1
            times, states = self.block(start)
            at, into, changes = merged(times, states, mine, before)
            out += changes
            last = states[-1] if states else _NONE
            grown = len(at) > len(times)
            if grown:
                wrote |= start is None
                self.write(start, at, into)
            behind = (after, (last, into[-1])) if after is not None and grown else None
        out = [(*change, self.n + k) for k, change in enumerate(out, 1)]
        if out or wrote:
            self.n += len(out)
            self.put(*FIRST, (None, json.dumps([self.n, self.more, *self.first])))
        return out

    def write(self, start: int | None, at: list[int], into: list) -> None:
        """Writes a block, in pieces if it is too large; the first is written with the count of changes."""
        step = len(at) if len(at) <= BLOCK else BLOCK // 2
        for k in range(0, len(at), step):
            piece = [at[k : k + step], into[k : k + step]]
            if k == 0 and start is None:
                self.first = piece
                continue
            here = start if k == 0 else at[k]
            if k:
                self.more = True
                self.times.add(here, None)
            self.put(LEVELS, here, (None, json.dumps(piece)))


class ChangePoints(StatefulProcessor):
    """Emits (key, t, state, added, n): the change points that came or went, the n-th of the entity's changes."""

    def __init__(self, key: T.DataType):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.map = handle.getMapState("blocks", T.StructType([T.StructField("key", self.key), T.StructField("level", T.IntegerType()), T.StructField("prefix", T.LongType())]), VALUE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        for batch in rows:
            batch = batch.sort_values(["key", "t"], kind="stable")
            found = zip(batch["key"].tolist(), batch["t"].tolist(), (s if isinstance(s, str) else None for s in batch["state"].tolist()))
            out = [(entity, *change) for entity, mine in groupby(found, key=lambda r: r[0]) for change in self.changes(entity, [r[1:] for r in mine])]
            yield pd.DataFrame(out, columns=["key", "t", "state", "added", "n"])

    def changes(self, entity, rows: list[tuple[int, str | None]]) -> list[tuple[int, str | None, bool, int]]:
        seen, fresh = {}, {}  # what these rows read and write of the entity's state

        def get(level, prefix):
            if (level, prefix) not in seen:
                at = (entity, level, prefix)
                seen[level, prefix] = tuple(self.map.getValue(at)) if self.map.containsKey(at) else None
            return seen[level, prefix]

        def put(level, prefix, value):
            seen[level, prefix] = fresh[level, prefix] = value

        out = Blocks(get, put).insert(rows)
        for (level, prefix), value in fresh.items():
            self.map.updateValue((entity, level, prefix), value)
        return out

    def close(self) -> None:
        pass


def updates(stream: DataFrame, key: str = "key") -> DataFrame:
    """(key, t, state, added, n) of a stream of (key, t, state): change points that came or went, numbered by entity. Nothing is too late.

    The session keeps state in RocksDB: spark.sql.streaming.stateStore.providerClass names its provider.
    """
    kind = stream.schema[key].dataType
    rows = stream.select(F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int").alias("group"), F.col(key).alias("key"), F.col("t").cast("long"), "state")
    return rows.groupBy("group").transformWithStateInPandas(ChangePoints(kind), f"key {kind.simpleString()}, t long, state string, added boolean, n long", "Update", "None")


def batches_into(path: str):
    """For foreachBatch: a micro-batch's changes in a folder of its number, so that a batch that comes again replaces itself."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


@contextmanager
def state_store(spark: SparkSession, partitions: int):
    """Streams that start here keep their state in RocksDB, in so many partitions (which a stream keeps for good)."""
    own = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": str(partitions)}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def settled(found: DataFrame) -> DataFrame:
    """(key, t, state) of the change points that stand: of each time the entity's last word. A batch that is written again says the same."""
    last = found.groupBy("key", "t").agg(F.max_by(F.struct("state", "added"), "n").alias("u"))
    return last.where("u.added").select("key", "t", "u.state")
