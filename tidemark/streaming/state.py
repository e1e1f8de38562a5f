"""State per key on a stream: conversations that end when idle (I9), as session windows, and requests under limits
(I10), with timers.

Both keep it in the RocksDB state store, which ``stateful`` sets while a query starts; the latter needs it. Rows of a key are handled in
event time order within a batch; what is later than the watermark is dropped before it gets here.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A batch writes what it has changed; whole copies of the state are made beside it.
CHANGES = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    wanted = {PROVIDER: ROCKS, CHANGES: "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _micros(t: pd.Series) -> list[int]:
    return [x.value // 1000 for x in pd.to_datetime(t)]


def conversations(stream: DataFrame, late: str, most: int = 14, idle_minutes: int = 180) -> DataFrame:
    """One row per conversation of a ``key`` that has been idle for over ``idle_minutes``, of a stream
    (key long, ts, turn long, text): its start and last turn, number of turns, the texts of the last ``most``
    turns in order, and the sorted distinct texts of those before. State is one session window per conversation
    that goes on, with its turns; the watermark ends it."""
    window = F.session_window("ts", f"{idle_minutes} minutes")  # a turn at the very end of the gap still belongs to it
    told = stream.withWatermark("ts", late).groupBy("key", window).agg(F.min("ts").alias("started"), F.max("ts").alias("last"), F.collect_list(F.struct("ts", "turn", "text")).alias("_turns"))
    told = told.withColumn("_texts", F.array_sort("_turns")["text"]).withColumn("_old", F.greatest(F.size("_texts") - most, F.lit(0)))
    older = F.filter(F.slice("_texts", 1, F.col("_old")), lambda t: t != "")
    topics = F.array_join(F.array_sort(F.array_distinct(older)), ",")
    return told.select("key", "started", "last", F.size("_texts").cast("long").alias("n_turns"), F.slice("_texts", F.col("_old") + 1, F.lit(most)).alias("turns"), topics.alias("topics"))


class _Limits(StatefulProcessor):
    def __init__(self, seconds: int, most: int, daily: int) -> None:
        self.seconds, self.most, self.daily = seconds, most, daily

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.granted = handle.getListState("granted", "second long, n long")
        self.day = handle.getValueState("day", "day long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        batch = batch.assign(_at=[x // 1_000_000 for x in _micros(batch["ts"])]).sort_values(["ts", "request"])
        held = deque([s, n] for s, n in self.granted.get())
        total = sum(n for _, n in held)
        day, used = self.day.get() if self.day.exists() else (-1, 0)
        verdicts = []
        for second in batch["_at"].tolist():
            while held and held[0][0] <= second - self.seconds:
                total -= held.popleft()[1]
            if second // 86400 != day:
                day, used = second // 86400, 0
            verdict = "day" if used >= self.daily else "window" if total >= self.most else "granted"
            if verdict == "granted":  # only what is granted counts
                used, total = used + 1, total + 1
                if held and held[-1][0] == second:
                    held[-1][1] += 1
                else:
                    held.append([second, 1])
            verdicts.append(verdict)
        if held:
            self.granted.put([tuple(h) for h in held])
        else:
            self.granted.clear()
        self.day.update((day, used))
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        self.handle.registerTimer((day + 1) * 86_400_000 + 1000 * self.seconds)  # then nothing held counts any more
        yield pd.DataFrame({"key": key[0], "request": batch["request"], "verdict": verdicts})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.granted.clear()
        self.day.clear()
        yield pd.DataFrame({"key": pd.Series([], dtype="int64"), "request": pd.Series([], dtype="int64"), "verdict": pd.Series([], dtype="str")})

    def close(self) -> None:
        pass


def verdicts(stream: DataFrame, late: str, seconds: int = 60, most: int = 900, daily: int = 40_000) -> DataFrame:
    """A verdict for each request of a stream (key long, ts, request long): 'day' where the client has had
    its ``daily`` requests, 'window' where ``most`` have been granted in the ``seconds`` whole seconds up to
    this one, else 'granted'. State is a count per second, and goes when its day is over."""
    rows = stream.withWatermark("ts", late).select("key", "ts", "request")
    return rows.groupBy("key").transformWithStateInPandas(_Limits(seconds, most, daily), "key long, request long, verdict string", "append", "eventTime")
