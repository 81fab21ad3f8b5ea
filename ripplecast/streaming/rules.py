"""Rules that follow each key in the order of time: request limits, silent targets, sustained alerts. Each has a batch and a stream form.

Stream forms are stateful processors (RocksDB state store). Rows wait in the state until the watermark has passed them and are then
taken in order, so late rows count where they belong and a stream gives the rows of its batch twin.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.storage import stored

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


# Ranges: a key's rows in order of time, in parts of bounded size


def _ranged(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """events by ranges of (key, order), stored, so that a range is the same when read again; part rises with the order."""
    return stored(events.repartitionByRange(key, *order).withColumn("part", F.spark_partition_id()), "ranged")


def _handed_over(ends: DataFrame, key: str, value: str) -> DataFrame:
    """(key, part, came): ``value`` of the key's part before; ends has a row a key and part."""
    before = F.lag(value).over(W.partitionBy(key).orderBy("part"))
    return ends.withColumn("came", before).select(key, "part", "came")


# T4


def first_hit_windows(events: DataFrame, span_s: int = 60, most: int = 100, bin_s: int = 3600) -> DataFrame:
    """T4: (user_id, opened, hits, limited): windows of span_s seconds, each opened by the key's first hit at or after the end of the one before.

    Batch. Every second with a hit points to the one that would open the next window; the openers are what the first hit reaches. Pointers double from round to round, so the
    longest chain takes its logarithm of joins. A search for the next hit stays inside one bin of a key, or takes the first
    hit of the next bin that has any, so a key's history is never in one task.
    """
    seconds = stored(events.groupBy("user_id", F.col("at_s").cast("long").alias("at_s")).agg(F.count("*").alias("n")), "limit-seconds")
    bin_of = lambda c: F.floor(F.col(c) / bin_s)
    held = seconds.groupBy("user_id", bin_of("at_s").alias("bin")).agg(F.min("at_s").alias("first"))
    asked = seconds.select("user_id", F.col("at_s").alias("of"), (F.col("at_s") + span_s).alias("from_s")).withColumn("bin", bin_of("from_s"))
    rows = asked.select("user_id", "bin", F.col("from_s").alias("at"), "of", F.lit(None).cast("long").alias("hit"), F.lit(1).alias("late"))
    rows = rows.unionByName(seconds.select("user_id", bin_of("at_s").alias("bin"), F.col("at_s").alias("at"), F.lit(None).cast("long").alias("of"), F.col("at_s").cast("long").alias("hit"), F.lit(0).alias("late")))
    # from the end of a bin: the last hit seen is the first one at or after the place
    inside = F.last("hit", ignorenulls=True).over(W.partitionBy("user_id", "bin").orderBy(F.desc("at"), "late"))
    found = rows.withColumn("next", inside).where("of is not null").select("user_id", "bin", "of", "next")
    later = held.select("user_id", "bin", "first").unionByName(asked.select("user_id", "bin", F.lit(None).cast("long").alias("first")).distinct()).groupBy("user_id", "bin").agg(F.min("first").alias("first"))
    ahead = later.withColumn("ahead", F.last("first", ignorenulls=True).over(W.partitionBy("user_id").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, -1))).select("user_id", "bin", "ahead")
    jump = stored(found.join(ahead, ["user_id", "bin"]).select("user_id", F.col("of").alias("at_s"), F.coalesce("next", "ahead").alias("next")).where("next is not null"), "limit-jumps")
    reached = stored(seconds.groupBy("user_id").agg(F.min("at_s").alias("at_s")), "limit-openers")
    while not jump.isEmpty():
        more = reached.join(jump, ["user_id", "at_s"]).select("user_id", F.col("next").alias("at_s"))
        reached = stored(reached.unionByName(more).distinct(), "limit-openers", replaces=reached)
        twice = jump.withColumnRenamed("at_s", "start").withColumnRenamed("next", "at_s").join(jump, ["user_id", "at_s"])
        jump = stored(twice.select("user_id", F.col("start").alias("at_s"), "next"), "limit-jumps", replaces=jump)
    opened = reached.select("user_id", F.col("at_s").alias("opened"), F.explode(F.array(F.floor(F.col("at_s") / span_s), F.floor(F.col("at_s") / span_s) + 1)).alias("slot"))
    met = seconds.withColumn("slot", F.floor(F.col("at_s") / span_s)).join(opened, ["user_id", "slot"]).where((F.col("at_s") >= F.col("opened")) & (F.col("at_s") < F.col("opened") + span_s))
    return met.groupBy("user_id", "opened").agg(F.sum("n").alias("hits")).withColumn("limited", F.col("hits") > most)


# T5


def _log_scan(at: list[int], log: list[int], span_s: int, most: int) -> tuple[list[int], list[int]]:
    """Size of the log before each hit, and the log after the last. A hit that finds ``most`` in it is rejected and not logged."""
    kept, recent = deque(log), []
    for t in at:
        while kept and kept[0] <= t - span_s:
            kept.popleft()
        recent.append(len(kept))
        if len(kept) < most:
            kept.append(t)
    return recent, list(kept)


def sliding_log(events: DataFrame, span_s: int = 60, most: int = 100) -> DataFrame:
    """T5: (user_id, at_s, event_id, recent, limited): accepted hits of the key in the span_s seconds before each hit, which is rejected where these reach ``most``.

    Rejected hits are not logged, so a key recovers. Batch: a key's hits are scanned in order (ties by event_id) in ranges of bounded size. Ranges of one key start from the log
    that the one before ends with: all are scanned at once with the logs known so far until none changes, which
    takes a second round where a range's log does not depend on the one handed to it.
    """
    order, key = ["at_s", "event_id"], ["user_id", "part"]
    ranged = _ranged(events.select("user_id", F.col("at_s").cast("long").alias("at_s"), "event_id"), "user_id", order)

    def scan(kind: str):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(order)
            came = rows["came"].iloc[0]
            recent, log = _log_scan(rows["at_s"].tolist(), [] if came is None else list(came), span_s, most)
            if kind == "ends":
                return pd.DataFrame({"user_id": rows["user_id"].iloc[:1], "part": rows["part"].iloc[:1], "log": [log]})
            return pd.DataFrame({"user_id": rows["user_id"], "at_s": rows["at_s"], "event_id": rows["event_id"], "recent": recent, "limited": [n >= most for n in recent]})

        return run

    parts = ranged.groupBy(*key).count()
    cut = parts.join(parts.groupBy("user_id").agg(F.count("*").alias("n")).where("n > 1"), "user_id", "left_semi").select(*key)
    came = stored(cut.withColumn("came", F.lit(None).cast("array<long>")), "limit-logs")  # at most two rows a range
    while not came.isEmpty():
        ends = ranged.join(came, key).groupBy(*key).applyInPandas(scan("ends"), "user_id long, part int, log array<long>")
        now = stored(_handed_over(ends, "user_id", "log"), "limit-logs")
        same = now.alias("a").join(came.alias("b"), key).where(F.col("a.came").eqNullSafe(F.col("b.came"))).count() == now.count()
        came = now
        if same:
            break
    return ranged.join(came, key, "left").groupBy(*key).applyInPandas(scan("rows"), "user_id long, at_s long, event_id long, recent long, limited boolean")


# T9


def target_down(events: DataFrame, gap_s: int = 60, end_s: int | None = None) -> DataFrame:
    """(handler, last_s, next_s): silences of a target longer than gap_s; next_s is null if it has not come back by end_s.

    Batch. A range of a target's beats gets the last one of the range before.
    """
    ranged = _ranged(events.select("handler", F.col("at_s").cast("long").alias("at_s")).distinct(), "handler", ["at_s"])
    ends = ranged.groupBy("handler", "part").agg(F.max("at_s").alias("end"))
    came = _handed_over(ends, "handler", "end")
    before = F.coalesce(F.lag("at_s").over(W.partitionBy("handler", "part").orderBy("at_s")), F.col("came"))
    gaps = ranged.join(came, ["handler", "part"]).withColumn("last_s", before).where(F.col("at_s") - F.col("last_s") > gap_s).select("handler", "last_s", F.col("at_s").alias("next_s"))
    if end_s is None:
        return gaps
    lost = ends.groupBy("handler").agg(F.max("end").alias("last_s")).where(F.lit(end_s) - F.col("last_s") > gap_s)
    return gaps.unionByName(lost.select("handler", "last_s", F.lit(None).cast("long").alias("next_s")))


# T6, T7


def sustained(windows: DataFrame, steps: int = 5, step_s: int = 60, series: str | None = None) -> DataFrame:
    """(first_s, last_s, n), by ``series`` where given: runs of at least ``steps`` windows (start_s, over) in a row that are over their limit.

    Batch: gaps and islands over the windows, of which there is one a step, not one an event; those of one series are ranked by days.
    """
    key = [series] if series else []
    over = windows.where("over").select(*key, "start_s")
    day = F.floor(F.col("start_s") / 86400)
    local = over.withColumn("day", day).withColumn("n", F.row_number().over(W.partitionBy(*key, "day").orderBy("start_s")))
    before = over.groupBy(*key, day.alias("day")).agg(F.count("*").alias("own"))
    before = before.withColumn("before", F.sum("own").over(W.partitionBy(*(key or [F.lit(0)])).orderBy("day")) - F.col("own")).drop("own")  # a row a day
    runs = local.join(before, [*key, "day"]).withColumn("run", F.col("start_s") - (F.col("n") + F.col("before")) * step_s)
    return runs.groupBy(*key, "run").agg(F.min("start_s").alias("first_s"), F.max("start_s").alias("last_s"), F.count("*").alias("n")).where(F.col("n") >= steps).drop("run")


def latency_sketches(events: DataFrame, late: str = "10 minutes", k: int = 800) -> DataFrame:
    """(window, sketch): a quantile sketch of latency_s of every minute, merged over five minutes that slide by one."""
    minute = events.withWatermark("at", late).groupBy(F.window("at", "1 minute").alias("minute")).agg(F.kll_sketch_agg_double("latency_s", F.lit(k)).alias("sketch"))
    return minute.groupBy(F.window(F.window_time("minute"), "5 minutes", "1 minute")).agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def latency_over(sketches: DataFrame, limit_s: float = 2.0, rank: float = 0.95) -> DataFrame:
    """(window, start_s, value, over): whether a window's quantile is over the limit."""
    value = F.kll_sketch_get_quantile_double("sketch", F.lit(rank))
    return sketches.select("window", F.unix_timestamp(F.col("window.start")).alias("start_s"), value.alias("value")).withColumn("over", F.col("value") > limit_s)


def ratio_over(ratios: DataFrame, limit: float = 0.05) -> DataFrame:
    """(window, start_s, value, over) of ``events.error_ratio``."""
    return ratios.select("window", F.unix_timestamp(F.col("window.start")).alias("start_s"), F.col("ratio").alias("value"), (F.col("ratio") > limit).alias("over"))


# Stream forms


class _InOrder(StatefulProcessor):
    """Keeps rows (at_s, id) until the watermark has passed them and hands them to ``take`` in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at_s long, id long")
        self.start()

    def start(self) -> None: ...

    def take(self, key: tuple, rows: list[tuple[int, int]], now_ms: int) -> pd.DataFrame | None:
        raise NotImplementedError

    def _settle(self, key: tuple, rows: list[tuple[int, int]], now_ms: int) -> Iterator[pd.DataFrame]:
        ready = sorted(r for r in rows if r[0] * 1000 <= now_ms)
        rest = [r for r in rows if r[0] * 1000 > now_ms]
        self.waiting.put(rest) if rest else self.waiting.clear()
        if rest:
            self.handle.registerTimer(max(r[0] for r in rest) * 1000)
        out = self.take(key, ready, now_ms)
        if out is not None and len(out):
            yield out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [r for part in rows for r in zip(part["at_s"].tolist(), part["id"].tolist(), strict=True)]
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        yield from self._settle(key, held + new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        yield from self._settle(key, held, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None: ...


class _SlidingLog(_InOrder):
    def __init__(self, span_s: int, most: int):
        self.span_s, self.most = span_s, most

    def start(self) -> None:
        self.log = self.handle.getListState("log", "at_s long")

    def take(self, key, rows, now_ms):
        if not rows:
            return None
        recent, log = _log_scan([t for t, _ in rows], [r[0] for r in self.log.get()] if self.log.exists() else [], self.span_s, self.most)
        self.log.put([(t,) for t in log]) if log else self.log.clear()
        return pd.DataFrame({"user_id": key[0], "at_s": [t for t, _ in rows], "event_id": [i for _, i in rows], "recent": recent, "limited": [n >= self.most for n in recent]})


class _FirstHit(_InOrder):
    def __init__(self, span_s: int, most: int):
        self.span_s, self.most = span_s, most

    def start(self) -> None:
        self.open = self.handle.getValueState("open", "opened long, hits long")

    def take(self, key, rows, now_ms):
        if not rows:
            return None
        opened, hits = self.open.get() if self.open.exists() else (None, 0)
        out = []
        for t, i in rows:
            if opened is None or t >= opened + self.span_s:
                opened, hits = t, 0
            hits += 1
            out.append((key[0], t, i, opened, hits, hits > self.most))
        self.open.update((opened, hits))
        return pd.DataFrame(out, columns=["user_id", "at_s", "event_id", "opened", "hits", "limited"])


class _Silence(_InOrder):
    """A timer a target, which fires once the watermark has passed its last beat and the gap."""

    def __init__(self, gap_s: int):
        self.gap_s = gap_s

    def start(self) -> None:
        self.last = self.handle.getValueState("last", "at_s long, told boolean")

    def take(self, key, rows, now_ms):
        last, told = self.last.get() if self.last.exists() else (None, False)
        out = []
        for t, _ in rows:
            if last is not None and t - last > self.gap_s and not told:
                out.append((key[0], last))
            last, told = (t, False) if t != last else (last, told)
        if last is None:
            return None
        due = (last + self.gap_s) * 1000
        if not told and now_ms > due:
            out.append((key[0], last))
            told = True
        elif not told:
            self.handle.registerTimer(due + 1)
        self.last.update((last, told))
        return pd.DataFrame(out, columns=["handler", "last_s"])


class _Runs(StatefulProcessor):
    """Runs of windows over their limit, from windows that come in the order of time; a run is told when it has ended."""

    def __init__(self, steps: int, step_s: int, wait_s: int):
        self.steps, self.step_s, self.wait_s = steps, step_s, wait_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "first_s long, last_s long, n long")

    def _told(self, key, run) -> list[tuple]:
        return [(key[0], *run)] if run is not None and run[2] >= self.steps else []

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["series", "first_s", "last_s", "n"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        run, out = tuple(self.run.get()) if self.run.exists() else None, []
        for start, over in sorted(r for part in rows for r in zip(part["start_s"].tolist(), part["over"].tolist(), strict=True)):
            if over and run is not None and start == run[1] + self.step_s:
                run = (run[0], start, run[2] + 1)
            else:
                out += self._told(key, run)
                run = (start, start, 1) if over else None
        if run is None:
            self.run.clear()
        else:
            self.run.update(run)
            self.handle.registerTimer((run[1] + self.wait_s) * 1000)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        run, out = tuple(self.run.get()) if self.run.exists() else None, []
        if run is not None and (run[1] + self.wait_s) * 1000 <= timerValues.getCurrentWatermarkInMs():
            out = self._told(key, run)
            self.run.clear()
        yield self._frame(out)

    def close(self) -> None: ...


def _by_key(events: DataFrame, key: str, id_col: str | None, late: str, processor: StatefulProcessor, kind: str) -> DataFrame:
    rows = events.withWatermark("at", late).select(key, F.col("at_s").cast("long").alias("at_s"), (F.col(id_col) if id_col else F.lit(0)).cast("long").alias("id"), "at")
    return rows.groupBy(key).transformWithStateInPandas(processor, kind, "Append", "EventTime")


def sliding_log_stream(events: DataFrame, span_s: int = 60, most: int = 100, late: str = "10 minutes") -> DataFrame:
    """T5, as ``sliding_log``, of a stream of (user_id, at, at_s, event_id): rows come once the watermark has passed them."""
    return _by_key(events, "user_id", "event_id", late, _SlidingLog(span_s, most), "user_id long, at_s long, event_id long, recent long, limited boolean")


def first_hit_stream(events: DataFrame, span_s: int = 60, most: int = 100, late: str = "10 minutes") -> DataFrame:
    """T4: (user_id, at_s, event_id, opened, hits, limited), a row a hit with its number in the window."""
    return _by_key(events, "user_id", "event_id", late, _FirstHit(span_s, most), "user_id long, at_s long, event_id long, opened long, hits long, limited boolean")


def silence_stream(events: DataFrame, gap_s: int = 60, late: str = "10 minutes") -> DataFrame:
    """(handler, last_s) of each silence longer than gap_s, told when the watermark has passed it, whether the target comes back or not."""
    return _by_key(events, "handler", None, late, _Silence(gap_s), "handler string, last_s long")


def sustained_stream(windows: DataFrame, steps: int = 5, step_s: int = 60, span_s: int = 300) -> DataFrame:
    """(series, first_s, last_s, n), as ``sustained``, chained behind a windowed aggregate (``ratio_over``, ``latency_over``) of the same query."""
    rows = windows.select(F.lit("all").alias("series"), "start_s", "over", F.window_time("window").alias("at"))
    return rows.groupBy("series").transformWithStateInPandas(_Runs(steps, step_s, span_s + step_s), "series string, first_s long, last_s long, n long", "Append", "EventTime")
