"""Cohorts that tasks enter one by one: a fixed number of entries, one open task at a time, and a chain of digests.

Events are rows (cohort, event_id, at, kind, task_id, eligibility, evidence_at, outcome); at and evidence_at are microseconds.
An `enrol` event is taken if the cohort has room, no task is open, the task has not entered before, and its evidence was there
at that time; an eligible task stays open until its `complete` event. When the last place is taken and nothing is open, the
cohort is finished and takes nothing more. Each entry's digest covers the one before it, so a changed, lost or reordered entry
shows.

The state of a cohort is small (it holds at most `places` task ids), and survives restarts in the stream's checkpoint. Within a
micro-batch events count in the order of time and id; one that arrives later than its successors counts as it arrives.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .events import importable

RESULT = "cohort long, event_id long, kind string, task_id string, reason string, sequence int, digest string, previous string, status string"
STATE = "presented int, active string, entry string, head string, seen string"
START = (0, "", "", "", "")
#: Rows of a sorted run, and of what is in memory of a run.
RUN, STEP = 1 << 16, 1 << 11


def digest(*parts: object) -> str:
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def advanced(events: Iterable[dict], state: tuple, places: int) -> tuple[list[tuple], tuple]:
    """What becomes of events in their order, and the state behind them. reason is `taken` or why an event is refused."""
    presented, active, entry, head, seen = state
    out = []
    for e in events:
        task, own, before = e["task_id"] or "", "", ""
        if presented >= places and not active:
            reason = "finished"
        elif e["kind"] == "complete":
            reason = "taken" if active and active == task else "not_open"
            if reason == "taken":
                before, own, active, entry = entry, digest(entry, e["outcome"]), "", ""
        elif active:
            reason = "open_task"
        elif presented >= places:
            reason = "full"
        elif not task or f",{task}," in f",{seen},":
            reason = "known_task"
        elif e["evidence_at"] > e["at"]:
            reason = "evidence_after_cutoff"
        else:
            reason, before = "taken", head
            presented += 1
            own = head = digest(e["cohort"], presented, task, e["eligibility"], e["at"], before)
            seen = f"{seen},{task}" if seen else task
            if e["eligibility"] == "eligible":
                active, entry = task, own
        status = "completed" if presented >= places and not active else "running" if presented else "open"
        out.append((e["cohort"], e["event_id"], e["kind"], e["task_id"], reason, presented, own, before, status))
    return out, (presented, active, entry, head, seen)


def _frame(frames: Iterable[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(["at", "event_id"], kind="stable", ignore_index=True)


def ordered(frames: Iterable[pd.DataFrame], run: int = RUN, step: int = STEP) -> Iterator[pd.DataFrame]:
    """The rows of many frames in the order of time and id, a few at a time.

    Runs of rows are sorted and lie in the task's own temporary files; of each run one stretch is in memory while they merge.
    """
    with tempfile.TemporaryDirectory() as folder:
        runs: list[str] = []
        held: list[pd.DataFrame] = []

        def put() -> None:
            runs.append(f"{folder}/{len(runs)}")
            table = pa.Table.from_pandas(_frame(held), preserve_index=False)
            with pa.OSFile(runs[-1], "wb") as f, pa.ipc.new_file(f, table.schema) as out:
                out.write_table(table, max_chunksize=step)
            held.clear()

        for frame in frames:
            if frame["at"].isna().any() or frame["event_id"].isna().any():
                raise ValueError("an event has no time or no id")
            for i in range(0, len(frame), step):
                held.append(frame.iloc[i : i + step])
                if sum(map(len, held)) >= run:
                    put()
        if not runs:
            if held:
                yield _frame(held)
            return
        if held:
            put()
        yield from _merged([_stretches(r) for r in runs])


def _stretches(path: str) -> Iterator[pd.DataFrame]:
    with pa.OSFile(path) as f, pa.ipc.open_file(f) as stored:
        for i in range(stored.num_record_batches):
            yield stored.get_batch(i).to_pandas()


def _merged(runs: list[Iterator[pd.DataFrame]]) -> Iterator[pd.DataFrame]:
    """Sorted rows of sorted runs: all up to the least last row of the stretches that may have successors."""
    now = {i: x for i, r in enumerate(runs) if (x := next(r, None)) is not None}
    while now:
        at, event = min((x["at"].iloc[-1], x["event_id"].iloc[-1]) for x in now.values())
        out = []
        for i, x in list(now.items()):
            times = x["at"].to_numpy()
            k, m = times.searchsorted(at, "left"), times.searchsorted(at, "right")
            k += x["event_id"].to_numpy()[k:m].searchsorted(event, "right")
            out.append(x.iloc[:k])
            rest = x.iloc[k:]
            if rest.empty and (rest := next(runs[i], None)) is None:
                del now[i]
            else:
                now[i] = rest
        yield _frame(out)


def _told(frames: Iterable[pd.DataFrame], state: tuple, places: int, keep: Callable[[tuple], None] = lambda _: None) -> Iterator[pd.DataFrame]:
    for frame in ordered(frames):
        for i in range(0, len(frame), STEP):
            rows = frame.iloc[i : i + STEP].astype(object)
            out, state = advanced(rows.where(rows.notna(), None).to_dict("records"), state, places)
            yield pd.DataFrame(out, columns=_NAMES)
    keep(state)


_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def enrolled(events: DataFrame, places: int) -> DataFrame:
    """The stream of what becomes of each event; run it in append mode."""

    def go(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from _told(frames, state.get if state.exists else START, places, state.update)

    importable(events.sparkSession)
    return events.groupBy("cohort").applyInPandasWithState(go, RESULT, STATE, "append", GroupStateTimeout.NoTimeout)


def replayed(events: DataFrame, places: int) -> DataFrame:
    """The same for a table of events, from the start."""

    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _told(frames, START, places)

    importable(events.sparkSession)
    return events.groupBy("cohort").applyInPandas(go, RESULT)


def chain_valid(entries: DataFrame) -> DataFrame:
    """(cohort, entries, broken): of taken enrolments, those whose previous digest is not that of the entry before or whose
    number does not follow it."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    order = Window.partitionBy("cohort").orderBy("sequence")
    rows = entries.where("kind = 'enrol' and reason = 'taken'").withColumns({"__before": F.coalesce(F.lag("digest").over(order), F.lit("")), "__n": F.coalesce(F.lag("sequence").over(order), F.lit(0))})
    return rows.groupBy("cohort").agg(F.count("*").alias("entries"), F.count_if((F.col("previous") != F.col("__before")) | (F.col("sequence") != F.col("__n") + 1)).alias("broken"))
