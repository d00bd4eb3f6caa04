"""Queries of the window operators that streams use, over the whole events table, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.streaming import events as ev

from .registry import query, read


def _strings(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return df


_fmt = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query(f"SELECT {_fmt.format('date_trunc($$day$$, ts)')} AS start, {_fmt.format('date_trunc($$day$$, ts) + INTERVAL 1 DAY')} AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL".replace("$$", "'"))
def s_tumbling_windows(spark, sf_dir):
    return _strings(ev.tumbling(ev.timed(read(spark, sf_dir, "events"))), "start", "end")


@query(f"WITH e AS (SELECT *, unnest([0, 6, 12, 18]) AS h FROM events), w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) - to_hours(h) AS s, event_type, value FROM e) SELECT {_fmt.format('s')} AS start, {_fmt.format('s + INTERVAL 1 DAY')} AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS value FROM w GROUP BY ALL")
def s_sliding_windows(spark, sf_dir):
    return _strings(ev.sliding(ev.timed(read(spark, sf_dir, "events"))), "start", "end")


@query("""WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM m)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n, round(sum(value), 4) AS value FROM i GROUP BY user_id, s""")
def s_session_windows(spark, sf_dir):
    return _strings(ev.sessions(ev.timed(read(spark, sf_dir, "events"))), "start", "end")
