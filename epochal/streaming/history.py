"""Change points of a stream: state is kept by entity, micro-batches may overlap, and late observations split or join spans exactly as in a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.changepoints import change_points


def changed(before: list[tuple[int, str | None]], new: list[tuple[int, str | None]]) -> tuple[list[tuple[int, str | None]], list[int], list[int]]:
    """(observations, times that became change points, times that no longer are) when new observations come in; the first state told for a time stays."""
    have = dict(before)
    points = _points(sorted(have.items()))
    for t, s in new:
        have.setdefault(t, s)
    rows = sorted(have.items())
    now = _points(rows)
    return rows, sorted(now - points), sorted(points - now)


def _points(rows: list[tuple[int, str | None]]) -> set[int]:
    return {t for i, (t, s) in enumerate(rows) if i == 0 or rows[i - 1][1] != s}


def updates(stream: DataFrame, key: str = "key") -> DataFrame:
    """(key, t, state, added) of a stream of (key, t, state): change points that came or went with each micro-batch.

    An entity's observations are its state, so nothing is ever too late; the state grows with an entity's observations, not with the stream's keys in memory.
    """
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, states = state.get if state.exists else ([], [])
        new = [(int(t), s) for b in batches for t, s in zip(b["t"], b["state"])]
        rows, added, gone = changed(list(zip(times, states)), new)
        state.update(([t for t, _ in rows], [s for _, s in rows]))
        known = dict(rows)
        out = [(k[0], t, known[t], True) for t in added] + [(k[0], t, known[t], False) for t in gone]
        yield pd.DataFrame(out, columns=["key", "t", "state", "added"])

    out = f"key {kind}, t long, state string, added boolean"
    kept = "times array<long>, states array<string>"
    return stream.select(F.col(key).alias("key"), F.col("t").cast("long"), "state").groupBy("key").applyInPandasWithState(step, out, kept, "update", GroupStateTimeout.NoTimeout)


def upsert_into(path: str, key: list[str], t: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: adds a micro-batch's observations to those in `path`, by batch number, so that a batch that comes again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([*key, t]).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def series(observations: DataFrame, key: list[str], t: str, state: list[str]) -> DataFrame:
    """Change points of all batches written by upsert_into."""
    return change_points(observations.dropDuplicates([*key, t]), key, t, state)


def settled(found: DataFrame, key: list[str], t: str) -> DataFrame:
    """The change points that stand after all batches written by upsert_into from updates(): the last batch that named a point says whether it is one."""
    last = found.groupBy(*key, t).agg(F.max_by(F.struct("state", "added"), "batch").alias("__u"))
    return last.where("__u.added").select(*key, t, "__u.state")
