"""Structured Streaming over edit events (uri, ts, kind, start_line, start_char, end_line, end_char, text)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from effectflow.operators import state

EVENT = "uri string, ts timestamp, kind string, start_line int, start_char int, end_line int, end_char int, text string"


def timed(stream: DataFrame, time: str = "ts", late: str = "1 minute") -> DataFrame:
    """A watermark on an event time; times without a zone are read in the session's."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def debounced(stream: DataFrame, gap: str = "500 milliseconds", by: str | None = "uri", late: str = "1 minute") -> DataFrame:
    """One row a burst of changes: (by, started, last, n). Without ``by`` one timer serves all, as a single editor server does."""
    return state.debounce(timed(stream, late=late), "ts", gap, [by] if by else [])


def bursts(stream: DataFrame, gap_ms: int = 500) -> DataFrame:
    """(uri, started, last, n) of each burst of changes (uri, ts), when no change of its uri came for ``gap_ms`` on the clock.

    The timer is the state's own, in processing time, so the last burst comes out though no later event does, where
    ``debounced`` waits for the watermark. A change that comes before its timer fires joins the burst, whatever its ``ts``;
    one with a null ``ts`` counts without moving start or end. State is a row a uri with an open burst, and goes as the
    burst comes out. Null uris are one uri.
    """

    def hold(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            started, last, n = held.get
            held.remove()
            yield pd.DataFrame({"uri": [key[0]], "started": pd.to_datetime([started], unit="us"), "last": pd.to_datetime([last], unit="us"), "n": [n]})
            return
        started, last, n = held.get if held.exists else (None, None, 0)
        for batch in batches:
            times = batch["ts"].dropna()
            n += len(batch)
            if len(times):
                low, high = (int(t.value // 1000) for t in (times.min(), times.max()))
                started, last = low if started is None else min(started, low), high if last is None else max(last, high)
        held.update((started, last, n))
        held.setTimeoutDuration(gap_ms)

    return stream.select("uri", "ts").groupBy("uri").applyInPandasWithState(
        hold, "uri string, started timestamp, last timestamp, n long", "started long, last long, n long", "append",
        GroupStateTimeout.ProcessingTimeTimeout,
    )


def apply_edit(base: str, start: tuple[int, int] | None, end: tuple[int, int] | None, new: str) -> str:
    """A text with one edit: all of it, or a range of zero-based lines and characters, clipped to what there is."""
    if start is None or end is None:
        return new
    lines = base.split("\n")

    def at(line: int, char: int) -> int:
        if line >= len(lines):
            return len(base)
        return sum(len(x) + 1 for x in lines[:line]) + min(char, len(lines[line]))

    a, b = at(*start), at(*end)
    return base[:a] + new + base[max(a, b) :]


def folded(stream: DataFrame, ttl: str | None = None) -> DataFrame:
    """(uri, ts, text, n_edits): each open document's text after each batch of its events.

    ``open`` and ``save`` with a text set it, ``change`` edits it, ``close`` forgets it. State is one text a document;
    events of a batch are applied in order of time.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], held_state: GroupState) -> Iterator[pd.DataFrame]:
        text, n = held_state.get if held_state.exists else ("", 0)
        events = pd.concat(list(batches)).sort_values("ts", kind="stable")
        closed = False
        for e in events.itertuples():
            if e.kind == "close":
                text, n, closed = "", 0, True
                continue
            closed = False
            new = "" if pd.isna(e.text) else e.text
            if e.kind == "change":
                whole = pd.isna(e.start_line)
                text = apply_edit(
                    text, None if whole else (int(e.start_line), int(e.start_char)),
                    None if whole else (int(e.end_line), int(e.end_char)), new,
                )
                n += 1
            elif not pd.isna(e.text):
                text = new
        if closed:
            held_state.remove()
            return
        held_state.update((text, n))
        yield pd.DataFrame({"uri": [key[0]], "ts": [events["ts"].max()], "text": [text], "n_edits": [n]})

    return stream.groupBy("uri").applyInPandasWithState(
        fold, "uri string, ts timestamp, text string, n_edits int", "text string, n int", "update", GroupStateTimeout.NoTimeout,
    )


def cached(stream: DataFrame, ttl_seconds: int = 86_400, forget_ms: int | None = None) -> DataFrame:
    """(key, ts, hit) of requests (key, ts, mtime, size, sha256): whether the entry before is young enough and the same.

    A miss stores the request as the new entry; an entry older than its time to live (by ``ts``) is a miss. With ``forget_ms``
    a key without a request for so long on the clock leaves the state, so the store holds recent keys alone, and its next
    request is a miss; such a query runs a batch at each trigger, so ``processAllAvailable`` doesn't return. Without it, keys stay.
    """

    def probe(key: tuple, batches: Iterator[pd.DataFrame], held_state: GroupState) -> Iterator[pd.DataFrame]:
        if held_state.hasTimedOut:
            held_state.remove()
            return
        held = held_state.get if held_state.exists else None
        out = []
        for e in pd.concat(list(batches)).sort_values("ts", kind="stable").itertuples():
            at = e.ts.timestamp()
            same = held is not None and at - held[0] <= ttl_seconds and held[1:] == (float(e.mtime), int(e.size), e.sha256)
            out.append((key[0], e.ts, same))
            if not same:
                held = (at, float(e.mtime), int(e.size), e.sha256)
        held_state.update(held)
        if forget_ms is not None:
            held_state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame(out, columns=["key", "ts", "hit"])

    return stream.groupBy("key").applyInPandasWithState(
        probe, "key string, ts timestamp, hit boolean", "at double, mtime double, size long, sha256 string", "append",
        GroupStateTimeout.NoTimeout if forget_ms is None else GroupStateTimeout.ProcessingTimeTimeout,
    )


def publish(stream: DataFrame, check: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``check`` on the documents that each batch changed and hands the findings to ``sink``; returns the started query."""

    def each(batch: DataFrame, number: int) -> None:
        latest = state.fold_last(batch, ["uri"], ["ts"], ["text"])
        sink(check(latest.select(F.col("uri").alias("path"), "text")), number)

    return stream.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).start()
