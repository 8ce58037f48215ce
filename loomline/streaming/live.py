"""Live views of sessions that are still being written.

Events arrive in any order; what depends on order keeps state per session and sends rows behind the last position it has
acted on to a late table. Batch twins: operators.windows. State is keyed below the session, so a batch reads and writes only what its rows touch; it needs
the RocksDB provider of Spark's state store (``PROVIDER``), which the session must set before such a stream starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from loomline.functions import text as T
from loomline.operators import lifecycle

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def live_occupancy(samples: DataFrame, configured: int = 200_000) -> DataFrame:
    """(session_id, current, peak, scale) from a stream of (session_id, idx, tokens); update or complete mode."""
    out = samples.groupBy("session_id").agg(F.max_by("tokens", "idx").alias("current"), F.max("tokens").alias("peak"))
    return out.withColumn("scale", T.scale_tier("peak", configured))


def live_counters(events: DataFrame, delay: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Counts by session and hour; ``events`` (session_id, ts, kind, tokens). Rows later than ``delay`` are dropped by the watermark."""
    of = lambda k: F.count_if(F.col("kind") == k)
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy("session_id", F.window("ts", every)).agg(of("user_msg").alias("turns"), of("compaction").alias("compactions"), of("unknown").alias("unknown"), F.sum("tokens").alias("tokens"))


def activity_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Stretches of activity per session, ended by ``gap`` without events."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    out = timed.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return out.select("session_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("idle_at"), "events")


STALE = "session_id string, w string, path string, read_idx long, mutate_idx long, close_idx long, outcome string, read_tokens_est long"


class _Alarm:
    """One timer for a key, moved on with each batch."""

    def __init__(self, handle: StatefulProcessorHandle, idle_ms: int | None) -> None:
        self.handle, self.idle_ms = handle, idle_ms
        self.at = handle.getValueState("alarm", "at long")

    def move(self, now: int) -> None:
        if self.idle_ms is None:
            return
        if self.at.exists():
            self.handle.deleteTimer(self.at.get()[0])
        self.handle.registerTimer(now + self.idle_ms)
        self.at.update((now + self.idle_ms,))


class StaleCopies(StatefulProcessor):
    """Copies that a session's windows hold, by (window, path): where each was read, its tokens and, once it is stale, what made it so."""

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.copies = handle.getMapState("copies", "w string, path string", "read_idx long, tokens long, mutate_idx long")
        self.windows = handle.getMapState("windows", "w string", "there boolean")
        self.last = handle.getValueState("last", "idx long, seq long")
        self.alarm = _Alarm(handle, self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(rows).sort_values(["idx", "seq"], kind="stable")
        last = ended = tuple(self.last.get()) if self.last.exists() else (-1, -1)
        here: dict[tuple, tuple | None] = {}  # what this batch has looked at
        touched, out, whole = set(), [], False

        def get(k: tuple) -> tuple | None:
            if k not in here:
                here[k] = tuple(self.copies.getValue(k)) if not whole and self.copies.containsKey(k) else None
            return here[k]

        def put(k: tuple, v: tuple | None) -> None:
            here[k] = v
            touched.add(k)

        def close(k: tuple, at: int | None, outcome: str) -> None:
            i, t, m = here[k]
            out.append((key[0], _out(k[0]), k[1], i, m, at, outcome, t))
            put(k, None)

        known = {k[0] for k in self.windows.keys()}
        for r in frame.itertuples():
            ended = max(ended, (int(r.idx), int(r.seq)))
            if (r.idx, r.seq) <= last:
                out.append((key[0], _out(r.w), r.path, r.idx, None, None, "late", None))
            elif r.op == "read":
                k = (r.w, r.path)
                if (held := get(k)) and held[2] is not None:
                    close(k, int(r.idx), "re-read")
                put(k, (int(r.idx), int(r.tokens), None))
                if r.w not in known:
                    known.add(r.w)
                    self.windows.updateValue((r.w,), (True,))
            else:
                wild = r.op != "compact" and (r.path is None or pd.isna(r.path))
                if (r.op == "compact" or wild) and not whole:  # only these look at all copies of the session
                    for k, v in self.copies.iterator():
                        here.setdefault(tuple(k), tuple(v))
                    whole = True
                if r.op == "compact":
                    for k in [k for k, v in here.items() if v is not None and k[0] == r.w]:
                        if here[k][2] is not None:
                            close(k, int(r.idx), "compacted")
                        put(k, None)
                else:
                    for k in [k for k, v in here.items() if v is not None] if wild else [(w, r.path) for w in known]:
                        if (held := get(k)) and held[2] is None:
                            put(k, (held[0], held[1], int(r.idx)))
        for k in touched:
            if here[k] is None:
                self.copies.removeKey(k)
            else:
                self.copies.updateValue(k, here[k])
        self.last.update(ended)
        self.alarm.move(timerValues.getCurrentProcessingTimeInMs())
        yield _frame(out, STALE, ["read_idx", "mutate_idx", "close_idx", "read_tokens_est"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        gone = [(tuple(k), tuple(v)) for k, v in self.copies.iterator() if v[2] is not None]
        out = [(key[0], _out(k[0]), k[1], i, m, None, "never-re-read", t) for k, (i, t, m) in sorted(gone, key=lambda x: x[1][2])]
        for state in (self.copies, self.windows, self.last, self.alarm.at):
            state.clear()
        yield _frame(out, STALE, ["read_idx", "mutate_idx", "close_idx", "read_tokens_est"])


def _frame(rows: list[tuple], schema: str, whole: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({c: "Int64" for c in whole})


def _in(c: str) -> F.Column:
    """A window's name as part of a key, which is never null."""
    return F.coalesce(F.concat(F.lit("w"), F.col(c).cast("string")), F.lit(""))


def _out(w: str) -> str | None:
    return w[1:] if w else None


def live_stale(ops: DataFrame, idle_ms: int = 3_600_000, as_of_end: bool = True) -> DataFrame:
    """Stale windows as they close, from a stream of (session_id, w, idx, seq, op, path, tokens).

    State per session: the copies in context, by (window, path), and the last position (idx, seq) acted on. With ``as_of_end`` a session idle for
    ``idle_ms`` emits what was never read again, and its state goes. Rows at or behind the last position come out with outcome late.
    """
    rows = ops.select(F.col("session_id").cast("string").alias("session_id"), _in("w").alias("w"), "idx", "seq", "op", "path", "tokens")
    return rows.groupBy("session_id").transformWithStateInPandas(StaleCopies(idle_ms if as_of_end else None), STALE, "append", "ProcessingTime")


NEEDS = "session_id string, idx long, key string, path string, tokens long, late boolean"


def _turned_up(path: str, text: str, cwd: str | None) -> bool:
    """The path, or its form below cwd, stands in the text."""
    base = (cwd or "").rstrip("/") + "/"
    return path in text or bool(cwd) and path.startswith(base) and path[len(base) :] in text


class ChainReads(StatefulProcessor):
    """The last search of a window, and the reads of files that it turned up."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.search = handle.getValueState("search", "text string, key string")
        self.reads = handle.getListState("reads", "idx long, key string, path string, tokens long")
        self.last = handle.getValueState("last", "idx long, seq long")
        self.alarm = _Alarm(handle, self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = ended = tuple(self.last.get()) if self.last.exists() else (-1, -1)
        text, name = tuple(self.search.get()) if self.search.exists() else ("", "")
        searched, new, out = False, [], []
        for r in pd.concat(rows).sort_values(["idx", "seq"], kind="stable").itertuples():
            ended = max(ended, (int(r.idx), int(r.seq)))
            if (r.idx, r.seq) <= last:
                out.append((key[0], int(r.idx), None, r.path, None, True))
            elif r.op == "search":
                if not searched:  # what earlier batches have kept for this search
                    out += [(key[0], *x, False) for x in self.reads.get()]
                    self.reads.clear()
                out += [(key[0], *x, False) for x in new]
                new, searched, text, name = [], True, r.text or "", r.key
            elif name and r.path and _turned_up(r.path, text, r.cwd):
                new.append((int(r.idx), name, r.path if not r.root else r.path.removeprefix(r.root.rstrip("/") + "/"), int(r.tokens)))
        if searched:
            self.search.update((text, name))
        if new:
            self.reads.appendList(new)
        self.last.update(ended)
        self.alarm.move(timerValues.getCurrentProcessingTimeInMs())
        yield _frame(out, NEEDS, ["idx", "tokens"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.search, self.reads, self.last, self.alarm.at):
            state.clear()
        yield _frame([], NEEDS, ["idx", "tokens"])


def live_chain_reads(stream: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """Reads of files that the last search turned up, out as soon as the next search follows; stream as for operators.facts.chain_reads, with one window column w.

    A window idle for ``idle_ms`` gives up its state with the reads that no search followed. Rows at or behind the last position acted on
    come out as late, without a key.
    """
    root = F.col("root") if "root" in stream.columns else F.lit(None).cast("string").alias("root")
    rows = stream.select(F.col("session_id").cast("string").alias("session_id"), _in("w").alias("w"), "idx", "seq", "op", "key", "path", "text", "cwd", root, "tokens")
    return rows.groupBy("session_id", "w").transformWithStateInPandas(ChainReads(idle_ms), NEEDS, "append", "ProcessingTime")


def ingest_writer(path: str, registry: lifecycle.Registry, name: str = "live"):
    """For foreachBatch: lines (session_id, stream, file, line_no, raw) come into the archive at ``path`` as ingests in its own list, each batch once; ``name`` tells streams apart."""

    def write(batch: DataFrame, number: int) -> None:
        lifecycle.ingest_batch(batch, path, registry, f"{name}-{number}")

    return write


def archive_writer(path: str):
    """For foreachBatch: add a micro-batch's rows to the table at ``path``; a repeated batch writes over itself, so nothing is there twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def archived(spark: SparkSession, path: str, key: tuple[str, ...] = ("session_id", "idx", "seq")) -> DataFrame:
    """All rows that were written; of rows with one key, that of the latest batch."""
    order = Window.partitionBy(*key).orderBy(F.desc("batch"))
    return spark.read.parquet(path).withColumn("no", F.row_number().over(order)).where("no = 1").drop("no", "batch")
