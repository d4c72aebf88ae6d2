"""Structured Streaming forms of ingest, rolling metrics, form state and drift."""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.types import StructType

from boutline.evaluation.drift import DyadicWindow
from boutline.evaluation.metrics import log_loss_of
from boutline.operators import setops

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_table_stream(spark: SparkSession, folder: str, file: str, files_per_trigger: int = 100) -> DataFrame:
    """A parquet file or folder as a stream; the schema is taken from its footer.
    ``files_per_trigger`` bounds a micro-batch."""
    schema = spark.read.parquet(f"{folder}/{file}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", file).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def with_event_time(df: DataFrame, column: str, delay: str = "1 hour") -> DataFrame:
    """Watermarks need a zoned timestamp: NTZ columns are read as session time (UTC)."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


class _Progress(StreamingQueryListener):
    """Progress of all micro-batches of one query (a query itself keeps the last 100)."""

    def __init__(self) -> None:
        self.run_id, self.batches, self.ended = None, [], threading.Event()
        self._early: list = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        self.batches.append({"runId": p["runId"], "batchId": p["batchId"], "numInputRows": p.get("numInputRows", 0), "stateOperators": p["stateOperators"]})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.run_id:
            self.ended.set()
        self._early.append(str(event.runId))

    def of(self, run_id: str) -> list:
        self.run_id = run_id
        if run_id not in self._early and not self.ended.wait(60):
            raise TimeoutError("the end of the query was not reported: its progress may be incomplete")
        return [p for p in self.batches if p["runId"] == run_id]


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> list:
    """Run a stream over what is there into a parquet folder; returns its progress.

    Append goes to the file sink (exactly once). Complete results, which are small
    aggregates, replace the folder in every batch, so a repeated batch is harmless.
    """
    listener = _Progress()
    df.sparkSession.streams.addListener(listener)
    w = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        q = w.format("parquet").option("path", path).start()
    else:
        q = w.foreachBatch(lambda b, _i: b.write.mode("overwrite").parquet(path)).start()
    try:
        q.awaitTermination()
        return listener.of(str(q.runId))
    finally:
        df.sparkSession.streams.removeListener(listener)


def late_rows(progress: list) -> int:
    """Rows dropped because they came after the watermark."""
    return sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in progress for s in p["stateOperators"])


# -- T-1 incremental ingest --------------------------------------------------


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """First arrival per key; state is dropped once the watermark passes."""
    return with_event_time(stream, time, delay).dropDuplicatesWithinWatermark(keys)


def append_batches(path: str):
    """foreachBatch sink: each micro-batch in its own folder, overwritten if the
    batch is repeated. Nothing stored is rewritten, whatever its size."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return put


def resolved(spark: SparkSession, path: str, keys: list[str], order: list[str], keep: str = "last") -> DataFrame:
    """The table behind ``append_batches``: one row per key, of the last (or first)
    batch that holds it. A compaction job writes this once in a while."""
    d = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    pick = setops.keep_last if keep == "last" else setops.keep_first
    return pick(d, keys, ["batch", *order])


# -- T-2 rolling metrics, T-5 sessions ---------------------------------------


def rolling_metrics(df: DataFrame, keys: list[str], time: str, width: str, slide: str | None = None) -> DataFrame:
    """Rows, accuracy, Brier score and log loss per event-time window. The same
    expression for batch and stream."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    y, p = F.col("y_true"), F.col("p")
    g = df.groupBy(*keys, w.alias("w")).agg(
        F.count("*").alias("rows"), F.avg(((p >= 0.5).cast("int") == y).cast("double")).alias("accuracy"),
        F.avg((p - y) * (p - y)).alias("brier"), F.avg(log_loss_of(y, p)).alias("log_loss"),
    )
    return g.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "rows", "accuracy", "brier", "log_loss")


def sessions(df: DataFrame, keys: list[str], time: str, gap: str) -> DataFrame:
    g = df.groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("events"), F.max(time).alias("last_event"))
    return g.select(*keys, F.col("w.start").alias("session_start"), "last_event", "events")


def open_sessions(rows: DataFrame, closed: DataFrame, keys: list[str], time: str, gap: str) -> DataFrame:
    """Sessions that the watermark has not closed yet, of the rows that no closed session
    holds: those after their key's last closed session. Read-only, so it may be asked as
    often as one likes; with ``closed`` it gives the sessions of all rows."""
    last = closed.groupBy(*keys).agg(F.max("last_event").alias("__last"))
    rest = rows.join(last, keys, "left").filter(F.col("__last").isNull() | (F.col(time) > F.col("__last")))
    return sessions(rest.drop("__last"), keys, time, gap)


# -- T-3 form state ------------------------------------------------------------


class FormState(StatefulProcessor):
    """For the entities of a slot: games, wins, ranks of the last win and loss, last ten
    outcomes, and the rows that wait for the watermark. A row is given out when nothing
    before it can come any more, in the order of time and id, whatever order rows arrived
    in. A call serves a slot of entities, since calls, timers and state requests each cost
    about a millisecond whatever they carry."""

    def __init__(self, key: str, outcome: str, row: str, row_type: str):
        self.key, self.outcome, self.row, self.row_type = key, outcome, row, row_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        longs = ", ".join(f"{c} array<long>" for c in ("games", "wins", "last_win", "last_loss"))
        self.state = handle.getValueState("form", f"entity array<string>, {longs}, ring array<string>")
        self.pending = handle.getListState("pending", f"t array<long>, id array<{self.row_type}>, y array<int>, entity array<string>")

    def _wake(self, earliest: int, expired: int | None = None) -> None:
        """One timer a slot, at its earliest waiting row; an expired one is still listed."""
        at = earliest // 1000
        timers = [t for t in self.handle.listTimers() if t != expired]
        if not timers or at < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for f in rows:
            if len(f):
                t = f["at_micros"].tolist()
                self.pending.appendValue((t, f[self.row].tolist(), f[self.outcome].astype(int).tolist(), f["entity"].tolist()))
                earliest = min(t) if earliest is None else min(earliest, min(t))
        if earliest is not None:
            self._wake(earliest)
        yield self._result([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready, left = [], []
        for chunk in self.pending.get():
            for x in zip(*chunk):
                (ready if x[0] < passed else left).append(x)
        ready.sort(key=lambda x: x[:3])
        forms = {x[0]: x[1:] for x in zip(*self.state.get())} if self.state.exists() else {}
        out = []
        for _, row, y, entity in ready:
            games, wins, lw, ll, ring = forms.get(entity, (0, 0, -1, -1, ""))
            recent = ring.count("1") / len(ring) if ring else 0.5
            out.append((row, entity, games, wins / games if games else 0.5, recent, lw - ll if games else 0))
            if y:
                wins, lw = wins + 1, games
            else:
                ll = games
            forms[entity] = (games + 1, wins, lw, ll, (ring + ("1" if y else "0"))[-10:])
        if ready:
            self.state.update(tuple([list(forms), *map(list, zip(*forms.values()))]))
        if left:
            self.pending.put([tuple(map(list, zip(*left[at : at + WAITING_CHUNK]))) for at in range(0, len(left), WAITING_CHUNK)])
            self._wake(min(x[0] for x in left), expiredTimerInfo.getExpiryTimeInMs())
        else:
            self.pending.clear()
        yield self._result(out)

    def _result(self, rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[self.row, "entity", "games_played", "overall_winrate", "recent_winrate", "current_streak"])

    def close(self) -> None:
        pass


# Slots that the entities of a form stream are dealt to, and waiting rows of one state value.
FORM_SLOTS = 1024
WAITING_CHUNK = 10_000


def form_stream(stream: DataFrame, key: str = "team", time: str = "match_date", outcome: str = "result", row: str = "row_id", delay: str = "1 hour", slots: int = FORM_SLOTS) -> DataFrame:
    """Each row with its entity's form before it, once the watermark has passed the row.
    Rows may come in any order within ``delay``; later ones are dropped and counted
    (:func:`late_rows`). State is an entity's form and its rows within the delay, kept by
    ``slots`` of entities: a task holds one slot at a time, and a batch reads and writes the
    slots that it touches. A stream keeps its number of slots for as long as its checkpoint."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    t = dict(stream.dtypes)
    schema = f"{row} {t[row]}, entity string, games_played long, overall_winrate double, recent_winrate double, current_streak long"
    timed = with_event_time(stream.select(key, row, F.col(outcome).cast("int").alias(outcome), time), time, delay)
    slotted = timed.select(
        F.pmod(F.xxhash64(key), F.lit(slots)).alias("slot"), F.col(key).cast("string").alias("entity"), row, outcome, time, F.unix_micros(time).alias("at_micros")
    )
    found = slotted.groupBy("slot").transformWithStateInPandas(FormState(key, outcome, row, t[row]), StructType.fromDDL(schema), "Append", "EventTime")
    return found.select(row, F.col("entity").cast(t[key]).alias(key), "games_played", "overall_winrate", "recent_winrate", "current_streak")


# -- T-4 drift monitor ----------------------------------------------------------


# Slots that the series of a drift stream are dealt to.
DRIFT_SLOTS = 1024
_WINDOW_LISTS = ("borders", "sums", "squares", "values", "first")


class AdaptiveWindow(StatefulProcessor):
    """For each series of a slot the dyadic window: sums at some borders, about log2(n) times
    a constant. A call serves a slot of series, since calls and state requests each cost about
    a millisecond whatever they carry; numbers and lists of all its windows are kept end to end."""

    def __init__(self, keys: list[str], order: list[str], value: str, delta: float, min_window: int, exact: int):
        self.keys, self.order, self.value = keys, order, value
        self.sizes = (delta, min_window, exact)

    def init(self, handle: StatefulProcessorHandle) -> None:
        names = ", ".join(f"key_{i} array<string>" for i in range(len(self.keys)))
        lists = ", ".join(f"{c} binary" for c in _WINDOW_LISTS)
        self.state = handle.getValueState("windows", f"{names}, places binary, totals binary, lengths binary, {lists}")

    def _stored(self) -> dict[tuple, DyadicWindow]:
        if not self.state.exists():
            return {}
        kept = self.state.get()
        names, (places, totals, lengths, *lists) = list(zip(*kept[: len(self.keys)])), kept[len(self.keys) :]
        places, totals = np.frombuffer(places, np.int64).reshape(-1, 2), np.frombuffer(totals, float).reshape(-1, 4)
        lengths = np.frombuffer(lengths, np.int64).reshape(-1, len(lists))
        parts = [np.split(np.frombuffer(x, np.int64 if c == "borders" else float), np.cumsum(n)[:-1]) for c, x, n in zip(_WINDOW_LISTS, lists, lengths.T)]
        return {name: DyadicWindow(*self.sizes, *places[i].tolist(), *totals[i].tolist(), *[p[i] for p in parts]) for i, name in enumerate(names)}

    def _store(self, windows: dict[tuple, DyadicWindow]) -> None:
        states = [w.state() for w in windows.values()]
        places, totals = np.array([s[:2] for s in states], np.int64), np.array([s[2:6] for s in states], float)
        lists = list(zip(*[s[6:] for s in states]))
        lengths = np.array([[len(x) for x in c] for c in lists], np.int64).T
        flat = [np.concatenate([np.asarray(x, np.int64 if c == "borders" else float) for x in parts]) for c, parts in zip(_WINDOW_LISTS, lists)]
        names = [list(k) for k in zip(*windows)]
        self.state.update((*names, *[np.ascontiguousarray(x).tobytes() for x in (places, totals, lengths, *flat)]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        points = pd.concat(rows)
        series = points.groupby(self.keys, sort=False, dropna=False)
        points = points.assign(series_no=series.ngroup()).sort_values(["series_no", *self.order], kind="stable")
        ends = np.flatnonzero(np.diff(points["series_no"].to_numpy(), append=-1)) + 1
        values, firsts = points[self.value].to_numpy(float), points[self.keys].iloc[np.concatenate(([0], ends[:-1]))]
        names = [tuple(None if pd.isna(x) else x for x in n) for n in firsts.itertuples(index=False, name=None)]
        windows, found = self._stored(), []
        for name, i, j in zip(names, (0, *ends[:-1]), ends):
            window = windows.setdefault(name, DyadicWindow(*self.sizes))
            found += [(*name, *x) for x in window.feed(values[i:j])]
        self._store(windows)
        yield pd.DataFrame(found, columns=[*self.keys, "position", "window_size"])

    def close(self) -> None:
        pass


def drift_stream(stream: DataFrame, keys: list[str], order: list[str], value: str, delta: float = 0.002, min_window: int = 30, exact: int = 32, slots: int = DRIFT_SLOTS) -> DataFrame:
    """Drift points of series as they arrive. Points come in order between micro-batches;
    within one they are sorted. State is kept by ``slots`` of series: a task holds the rows of
    a batch and the windows of one slot at a time. A stream keeps its number of slots for as
    long as its checkpoint."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    kinds = dict(stream.dtypes)
    schema = ", ".join([*[f"{k} string" for k in keys], "position long, window_size long"])
    names = [F.col(k).cast("string").alias(k) for k in keys]
    # an order column that is a key as well would be sorted as text
    slotted = stream.select(F.pmod(F.xxhash64(*keys), F.lit(slots)).alias("slot_no"), *names, *[F.col(o).alias(f"order_{o}") for o in order], F.col(value).cast("double").alias("point"))
    found = slotted.groupBy("slot_no").transformWithStateInPandas(
        AdaptiveWindow(keys, [f"order_{o}" for o in order], "point", delta, min_window, exact), StructType.fromDDL(schema), "Append", "None"
    )
    return found.select(*[F.col(k).cast(kinds[k]).alias(k) for k in keys], "position", "window_size")
