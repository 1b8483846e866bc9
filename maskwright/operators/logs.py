"""Logs of events read as state: the states of tasks, and limits on the rate of requests."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.constants import STATUSES
from maskwright.operators.lifecycle import RESUMABLE

#: Events on a task; ``claim`` comes once for each state that the claimer may have seen.
KINDS = ("review", "complete", "restore", "cancel", "interrupted", "error", *(f"claim {s}" for s in STATUSES))
_PREVIOUS = ("", *STATUSES)
_STATES = [(s, p, c) for s in STATUSES for p in _PREVIOUS for c in (False, True)]
#: fixed values: requests and seconds of the two limits, and the methods that the limit on uploads exempts
REQUESTS, UPLOADS, READS = (180, 60), (60, 3600), ("GET", "HEAD", "OPTIONS")


def after(state: tuple[str, str, bool], kind: str) -> tuple[tuple[str, str, bool], bool]:
    """The state (status, status before processing, cancel requested) that an event leads to, and whether it is accepted."""
    status, previous, cancel = state
    busy = status == "processing"
    back = previous if previous in RESUMABLE else None
    if kind.startswith("claim "):
        return (("processing", status, False), True) if status == kind[6:] else (state, False)
    if kind == "restore":
        return (("restored", previous, cancel), True) if status in ("completed", "restored") else (state, False)
    if not busy:
        return state, False
    if kind == "cancel":
        return (status, previous, True), True
    ends = {"review": "review", "complete": "completed", "interrupted": back or "cancelled", "error": back or "failed"}
    return (ends[kind], "", False), True


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By event and state: the number of the next state, and whether the event is accepted."""
    number = {s: i for i, s in enumerate(_STATES)}
    both = [[after(s, k) for s in _STATES] for k in KINDS]
    return np.array([[number[s] for s, _ in row] for row in both], dtype=np.uint8), np.array([[ok for _, ok in row] for row in both])


def _stretches(batches, width: int):
    """(values of the first ``width`` columns, rows of the others) of the runs of equal values."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and now != row[:width]:
                yield now, held
                held = []
            now = row[:width]
            held.append(row[width:])
    if held:
        yield now, held


def fold_tasks(events: DataFrame, key: str, order: str, kind: Column, first: str = "processing", width: int = 1 << 16) -> DataFrame:
    """(key, order, kind, accepted, status, cancel_requested) of each event on a task, the state being that after it.

    A task starts as ``first``; its events come by ``order`` (a long; ties by kind). ``kind`` is one of KINDS, others and null are
    refused. Of several claims of one state the first in order wins, the others find it changed. A stretch of
    ``width`` in the order is a map from states to states, and maps compose: the stretches of a task with many events are read in
    different tasks of the job, then joined with the state that each begins with. Repeated events are events of their own; null
    keys are one task; an empty log gives an empty result.
    """
    of_key = events.schema[key].dataType.simpleString()
    code = F.coalesce(*[F.when(kind == k, i) for i, k in enumerate(KINDS)])
    rows = events.select(F.col(key).alias("k"), F.floor(F.col(order) / width).cast("long").alias("part"), F.col(order).cast("long").alias("o"), code.cast("int").alias("c"), kind.alias("kind"))

    def maps(batches):
        following, _ = _tables()
        found = []
        for (k, part), events_ in _stretches(batches, 2):
            whole = np.arange(len(_STATES), dtype=np.uint8)
            for (c,) in events_:
                if c is not None:
                    whole = following[c][whole]
            found.append((k, part, whole.tobytes()))
        yield _batch(found, ("k", "part", "map"), keys, (pa.int64(), pa.binary()))

    def starts(batches):
        found = []
        for (k,), parts in _stretches(batches, 1):
            at = _STATES.index((first, "", False))
            for part, whole in parts:
                found.append((k, part, at))
                at = whole[at]
        yield _batch(found, ("k", "part", "start"), keys, (pa.int64(), pa.int32()))

    def replay(batches):
        following, accepted = _tables()
        for (k, _), events_ in _stretches(batches, 2):
            out, at = [], events_[0][3]
            for o, c, name, _ in events_:
                ok = c is not None and bool(accepted[c, at])
                at = int(following[c, at]) if c is not None else at
                out.append((k, o, name, ok, _STATES[at][0], _STATES[at][2]))
            yield _batch(out, (key, order, "kind", "accepted", "status", "cancel_requested"), keys, (pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.bool_()))

    keys = pa.string() if of_key == "string" else pa.int32() if of_key == "int" else pa.int64()
    both = ["k", "part"]
    whole = rows.select(*both, "o", "c").repartition(*both).sortWithinPartitions(*both, "o", "c").select(*both, "c").mapInArrow(maps, f"k {of_key}, part long, map binary")
    begin = whole.repartition("k").sortWithinPartitions(*both).mapInArrow(starts, f"k {of_key}, part long, start int")
    begin = begin.select(F.col("k").alias("k2"), F.col("part").alias("p2"), "start")
    placed = rows.join(begin, F.col("k").eqNullSafe(F.col("k2")) & F.col("part").eqNullSafe(F.col("p2"))).repartition(*both).sortWithinPartitions(*both, "o", "c", "kind")
    return placed.select(*both, "o", "c", "kind", "start").mapInArrow(replay, f"`{key}` {of_key}, `{order}` long, kind string, accepted boolean, status string, cancel_requested boolean")


def _batch(rows: list[tuple], names: tuple, first: pa.DataType, kinds: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((first, *kinds))], list(names))


def rate_limit(requests: DataFrame, client: str, at: str, limit: tuple[int, int], counted: Column | None = None) -> DataFrame:
    """``requests`` with ``allowed``: fewer than ``limit[0]`` requests of the client were allowed in the ``limit[1]`` seconds before.

    Refused requests don't count, so the allowed ones decide in turn: a client's requests are read by time, and the last
    ``limit[0]`` allowed times at most are held. Requests that are not ``counted`` (reads, say) are allowed and don't count. A
    request exactly ``limit[1]`` seconds old no longer counts; of requests at one time the order doesn't matter to how many are
    allowed. A null client is not limited. Columns keep names, types and order whatever they are called; they are told
    apart by position.
    """
    most, seconds = limit
    own = {f.name: f"_c{i}" for i, f in enumerate(requests.schema.fields)}
    rows = requests.withColumn("_counts", (F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))) & F.col(client).isNotNull())
    rows = rows.select(*[F.col(c).alias(n) for c, n in own.items()], "_counts").withColumn("_at", F.unix_micros(F.col(own[at]).cast("timestamp")))
    schema = rows.drop("_counts", "_at").schema.add("allowed", "boolean")

    def run(batches):
        now, held = object(), deque()
        for batch in batches:
            which, counts, times = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (own[client], "_counts", "_at"))
            out = []
            for k, c, t in zip(which, counts, times):
                if k != now:
                    now, held = k, deque()
                if not c or t is None:
                    out.append(True)
                    continue
                while held and held[0] <= t - seconds * 1_000_000:
                    held.popleft()
                out.append(len(held) < most)
                if out[-1]:
                    held.append(t)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(out, pa.bool_())], schema=pa.schema([*list(batch.schema)[: len(own)], pa.field("allowed", pa.bool_())]))

    # reads and requests of no client are dealt anywhere
    salt = F.when(F.col("_counts"), F.lit(0)).otherwise(F.pmod(F.hash(*own.values()), F.lit(64)))
    dealt = rows.withColumn("_salt", salt).repartition(own[client], "_salt").sortWithinPartitions(own[client], "_at", *own.values())
    return dealt.drop("_salt").mapInArrow(run, schema).select(*[F.col(n).alias(c) for c, n in own.items()], "allowed")
