"""State machines over streams, one small state for each key: circuit breakers, stalled runs, thread memory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def advance(state: tuple[str, int, float], at: float, bad: bool, threshold: int, cooldown: float) -> tuple[str, int, float]:
    """(mode, consecutive failures, opened at) after one event."""
    mode, fails, since = state
    if mode == "open" and at - since >= cooldown:
        mode = "halfOpen"
    if not bad:
        return (mode, fails, since) if mode == "open" else ("closed", 0, since)
    fails += 1
    opens = mode == "halfOpen" or (mode == "closed" and fails >= threshold)
    return ("open", fails, at) if opens else (mode, fails, since)


def breakers(events: DataFrame, signal: str, at: str, event_id: str, failed: str, threshold: int = 3, cooldown: float = 30.0) -> DataFrame:
    """signal, event_id, state after each event of a stream; events are taken in order of time within a batch."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = tuple(held.get) if held.exists else ("closed", 0, 0.0)
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        modes = []
        for t, bad in zip(rows["at"], rows["bad"]):
            state = advance(state, t, bad, threshold, cooldown)
            modes.append(state[0])
        held.update((state[0], int(state[1]), float(state[2])))
        yield pd.DataFrame({"signal": key[0], "event_id": rows["id"], "state": modes})

    seconds = F.unix_micros(F.col(at).cast("timestamp")) / F.lit(1e6)
    plain = events.select(F.col(signal).cast("string").alias("signal"), F.col(event_id).cast("long").alias("id"), seconds.alias("at"), F.col(failed).cast("boolean").alias("bad"))
    return plain.groupBy("signal").applyInPandasWithState(run, "signal string, event_id long, state string", "mode string, fails int, since double", "append", GroupStateTimeout.NoTimeout)


def stalled(chunks: DataFrame, run: str, at: str, done: str, first_seconds: float, gap_seconds: float) -> DataFrame:
    """run, chunks, ended, reason for streamed runs: finished, or timed out waiting for the first or the next chunk.

    chunks (run, at with a watermark, done: boolean; a run's first row marks its start)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            seen, _ = held.get
            held.remove()
            yield pd.DataFrame({"run": [key[0]], "chunks": [seen], "reason": ["firstToken" if seen == 0 else "chunkGap"]})
            return
        seen, last = held.get if held.exists else (-1, 0.0)
        rows = pd.concat(list(batches)).sort_values("at")
        seen, last, over = int(seen + len(rows)), float(rows["at"].max()), bool(rows["done"].any())
        if over:
            if held.exists:
                held.remove()
            yield pd.DataFrame({"run": [key[0]], "chunks": [seen], "reason": ["finished"]})
            return
        held.update((seen, last))
        wait = first_seconds if seen == 0 else gap_seconds
        held.setTimeoutTimestamp(max(int((last + wait) * 1000), held.getCurrentWatermarkMs() + 1))

    plain = chunks.select(F.col(run).cast("string").alias("run"), F.col(at).alias("_at"), (F.unix_micros(F.col(at)) / F.lit(1e6)).alias("at"), F.col(done).cast("boolean").alias("done"))
    return plain.groupBy("run").applyInPandasWithState(step, "run string, chunks long, reason string", "seen long, last double", "append", GroupStateTimeout.EventTimeTimeout)


def thread_memory(candidates: DataFrame) -> DataFrame:
    """thread_id, slot, text, operation: each thread's slots held as state; a later claim of a slot replaces the one
    before if it starts no earlier, a retraction removes it, the same text changes nothing.

    candidates (thread_id, slot, text, valid_from, retraction)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        slots = {s: (t, f) for s, t, f in zip(*held.get)} if held.exists else {}
        rows, out = pd.concat(list(batches)).sort_values(["at", "slot", "text"]), []
        for slot, text, at, gone in zip(rows["slot"], rows["text"], rows["at"], rows["retraction"]):
            now = slots.get(slot)
            if gone:
                operation = "delete" if slots.pop(slot, None) else "noop"
            elif now and (now[0] == text or at < now[1]):
                operation = "noop"
            else:
                operation = "update" if now else "add"
                slots[slot] = (text, at)
            out.append((key[0], slot, text, operation))
        held.update(([*slots], [t for t, _ in slots.values()], [float(f) for _, f in slots.values()]))
        yield pd.DataFrame(out, columns=["thread_id", "slot", "text", "operation"])

    seconds = F.unix_micros(F.col("valid_from").cast("timestamp")) / F.lit(1e6)
    plain = candidates.select(F.col("thread_id").cast("string").alias("thread_id"), "slot", "text", seconds.alias("at"), "retraction")
    state = "slots array<string>, texts array<string>, starts array<double>"
    return plain.groupBy("thread_id").applyInPandasWithState(step, "thread_id string, slot string, text string, operation string", state, "append", GroupStateTimeout.NoTimeout)
