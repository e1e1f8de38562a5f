"""Queries that start from a file stream and end in a versioned table: three runs, each of which goes on from the
checkpoint of the one before, and a batch that comes twice.

The first run reads the files of the events' first ten days, the second those of the rest, the third one file
of events of the first five days that come only now, which is later than any watermark allows, and an event of
the next year that ends all windows.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..session import scratch, table
from ..sources import paged, pages, versions
from ..streaming import incremental, state
from .registry import query

LATE = "event_id % 97 = 0 AND ts < TIMESTAMP '2024-01-06'"
_IN_TIME = f"events AS (SELECT * FROM main.events WHERE NOT ({LATE}))"


def _runs(spark, sf, name, build, keys, order=None, last=True):
    """The table that the stream of events, changed by ``build``, has been merged into."""
    source, goal, checkpoint = (scratch(spark, f"{name}-{x}") for x in ("in", "table", "state"))
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value").withColumn("ts", F.col("ts").cast("timestamp"))
    first = F.col("ts") < F.lit("2024-01-11").cast("timestamp")
    end = spark.createDataFrame([(-1, "2025-01-01 00:00:00", -1, "end", 0.0)], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    runs = [e.where(first & F.expr(f"NOT ({LATE})")), e.where(~first), e.where(LATE).union(end).coalesce(1)]
    for rows in runs:
        rows.write.mode("append").parquet(source)
        with state.stateful(spark):
            incremental.merge_stream(build(incremental.file_stream(spark, source, rows.schema)), goal, keys, order or [], checkpoint, name).awaitTermination()
    # a batch whose number the table has seen changes nothing, whatever it holds
    held = versions.version(spark, goal)
    again = versions.read(spark, goal).limit(1)
    incremental.merging(goal, keys, [], name)(again.withColumn(again.columns[-1], F.lit(None).cast(again.dtypes[-1][1])), 0)
    if versions.version(spark, goal).number != held.number:
        raise RuntimeError("a batch was merged twice")
    return versions.read(spark, goal)


@query(f"WITH {_IN_TIME} SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    """Windows of a stream, without the rows that come too late."""
    return _runs(spark, sf, "windows", lambda s: incremental.windowed_counts(s, "ts", "6 hours", "1 day", "event_type").select("start", "event_type", "n"), ["start", "event_type"])


@query(f"WITH {_IN_TIME}, o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '6 hours' THEN 1 ELSE 0 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS \"end\", count(*) AS n FROM s GROUP BY user_id, g")
def event_sessions(spark, sf):
    """Sessions of a stream, also those that go on over a restart."""
    return _runs(spark, sf, "sessions", lambda s: incremental.sessions(s, "ts", "6 hours", "1 day", "user_id"), ["user_id", "start"])


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def merged_stream(spark, sf):
    """The last event of each user, merged batch by batch; late ones are older than what is held."""
    newest = lambda s: s.where("user_id >= 0").select("user_id", "event_type", "ts", "event_id")
    out = _runs(spark, sf, "merged", newest, ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return out.select("user_id", "event_type", "ts")


@query(
    f"""WITH {_IN_TIME}, o AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) <= 43200000000 THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, g ORDER BY ts DESC, event_id DESC) AS n FROM s)
SELECT user_id, min(ts) AS started, max(ts) AS last, count(*) AS n_turns, array_to_string(list(event_type ORDER BY ts, event_id) FILTER (WHERE n <= 14), ' ') AS turns,
  coalesce(array_to_string(list_sort(list_distinct(list(event_type) FILTER (WHERE n > 14))), ','), '') AS topics FROM r GROUP BY user_id, g"""
)
def idle_conversations(spark, sf):
    """State per user: the last 14 turns, what older ones were about, and an end when idle for half a day."""
    turns = lambda s: state.conversations(s.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("turn"), F.col("event_type").alias("text")), "1 hour", 14, 720)
    out = _runs(spark, sf, "conversations", turns, ["key", "started"])
    return out.select(F.col("key").alias("user_id"), "started", "last", "n_turns", F.array_join("turns", " ").alias("turns"), "topics")


@query(
    f"""WITH RECURSIVE {_IN_TIME}, q AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, 0::BIGINT AS n, []::BIGINT[] AS granted, 0::BIGINT AS event_id, '' AS verdict FROM q WHERE n = 1
  UNION ALL SELECT user_id, n, CASE WHEN verdict = 'granted' THEN list_append(granted, s) ELSE granted END, event_id, verdict FROM (
    SELECT q.user_id, q.n, q.s, r.granted, q.event_id,
      CASE WHEN len([x FOR x IN r.granted IF x // 86400 = q.s // 86400]) >= 4 THEN 'day' WHEN len([x FOR x IN r.granted IF x > q.s - 7200]) >= 2 THEN 'window' ELSE 'granted' END AS verdict
    FROM r JOIN q ON q.user_id = r.user_id AND q.n = r.n + 1))
SELECT user_id, event_id, verdict FROM r WHERE n > 0"""
)
def request_verdicts(spark, sf):
    """A verdict per request: at most two are granted in two hours, and four a day."""
    asked = lambda s: state.verdicts(s.where("user_id >= 0").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("request")), "1 hour", 7200, 2, 4)
    return _runs(spark, sf, "verdicts", asked, ["request"]).select(F.col("key").alias("user_id"), F.col("request").alias("event_id"), "verdict")


class _TablePages:
    """A service that serves an ordered table's rows (``pages``), some at a time, in the order of a key; every seventh
    page fails the first time that a process asks for it. It holds one slice of the table at a time."""

    def __init__(self, path: str, key: str, size: int) -> None:
        self.path, self.key, self.size = re.sub("^file:/+", "/", path), key, size
        self.asked: set[int] = set()
        self.counts: list[tuple[int, int]] | None = None
        self.held: tuple[int | None, object] = (None, None)

    def _table(self, name: str):
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        return ds.dataset(f"{path}/{name}", filesystem=system, format="parquet").to_table()

    def _slices(self) -> list[tuple[int, int]]:
        if self.counts is None:
            t = self._table("counts")
            self.counts = sorted(zip(t.column("slice").to_pylist(), t.column("n").to_pylist()))
        return self.counts

    def _rows(self, slice_: int):
        if self.held[0] != slice_:
            self.held = slice_, self._table(f"rows/slice={slice_}").sort_by(self.key)
        return self.held[1]

    def pages(self) -> int:
        return -(-sum(n for _, n in self._slices()) // self.size)

    def fetch(self, page: int) -> list[dict]:
        if page % 7 == 3 and page not in self.asked:
            self.asked.add(page)
            raise ConnectionError("reset")
        wanted, skip = pages.slices_of(self._slices(), page * self.size, (page + 1) * self.size)
        rows: list[dict] = []
        for x in wanted:
            rows += self._rows(x).slice(skip if x == wanted[0] else 0, self.size - len(rows)).to_pylist()
        return rows


@query("SELECT (row_number() OVER (ORDER BY page_id) - 1) // 20 AS page, page_id, url, length(html) AS n FROM pages")
def paged_reads(spark, sf):
    """The pages table behind a paged service that sometimes fails."""
    path = scratch(spark, "paged")
    pages.write_ordered(table(spark, sf, "pages").select("page_id", "url", "html"), path, [F.col("page_id")], 500)
    client = _TablePages(path, "page_id", 20)
    spark.dataSource.register(paged.paged_source("paged_pages", "page_id long, url string, html string", client, paged.Patience(3, 60, 0.01)))
    return spark.read.format("paged_pages").option("pages", 3).load().select("page", "page_id", "url", F.length("html").cast("long").alias("n"))
