"""The registered queries over the given tables, each beside its DuckDB twin.

``events`` stands for plays, clicks, card attempts, log rows and scores; ``customer`` for songs and users.
Arrival order is made up from event_id, as events come in time order.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions.time import cumulate, epoch_ms, event_time, from_ms, hop, tumble
from ..operators import watermark as W
from ..operators import windows as O
from ..sources.messages import topic_envelope, without_registry_prefix
from ..sources.shared import fresh_path
from ..streaming import forms as S
from ..streaming import stateful as K
from .tables import Statements, StreamTable, run_pipeline, run_sql, run_statements

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def scored(df: DataFrame) -> DataFrame:
    """Events with a whole-number score, cents of value, so that sums don't depend on order."""
    return df.withColumn("score", F.floor(F.col("value") * 100).cast("long"))


CENTS = "CAST(floor(value * 100) AS BIGINT)"
DAY, HOUR = "INTERVAL 1 DAY", "INTERVAL 1 HOUR"
HOUR_START = "date_trunc('hour', ts)"


# ---- windows, filters, ranking


@query(f"SELECT {HOUR_START} AS window_start, {HOUR_START} + {HOUR} AS window_end, json_extract_string(props, '$.k') AS error_code, count(*) AS error_count FROM events WHERE event_type = 'error' GROUP BY ALL")
def iot_error_count(spark, d):
    rows = events(spark, d).where("event_type = 'error'").withColumn("error_code", F.get_json_object("props", "$.k"))
    return O.window_aggregate(rows, "ts", "1 hour", ["error_code"], F.count("*").alias("error_count"))


@query(f"SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + {DAY} AS window_end, user_id, count(*) AS attempts FROM events GROUP BY ALL HAVING count(*) > 5")
def fraud_having(spark, d):
    return O.window_aggregate(events(spark, d), "ts", "1 day", ["user_id"], F.count("*").alias("attempts")).where("attempts > 5")


TOPK = f"""WITH c AS (SELECT date_trunc('hour', ts) AS window_start, c_mktsegment AS genre, user_id, count(*) AS plays FROM events JOIN customer ON user_id = c_custkey WHERE value >= 5 GROUP BY ALL)
SELECT window_start, window_start + {HOUR} AS window_end, genre, user_id, plays, row_number() OVER (PARTITION BY window_start, genre ORDER BY plays DESC, user_id) AS row_num FROM c
QUALIFY row_number() OVER (PARTITION BY window_start, genre ORDER BY plays DESC, user_id) <= 3"""


@query(TOPK)
def topk_per_window(spark, d):
    users = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("genre"))
    plays = O.enrich(events(spark, d).where("value >= 5").select("user_id", "ts"), users, "user_id", "c_custkey")
    counted = O.window_aggregate(plays, "ts", "1 hour", ["genre", "user_id"], F.count("*").alias("plays"))
    return O.top_k(counted, ["window_start", "window_end", "genre"], "plays", "user_id", 3)


@query("SELECT user_id, c_name AS name, event_type AS action, ts FROM events JOIN customer ON user_id = c_custkey WHERE c_mktsegment = 'BUILDING'")
def vip_join_filter(spark, d):
    users = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey", F.col("c_name").alias("name"))
    return O.enrich(events(spark, d), users, "user_id", "c_custkey", broadcast_rows=100_000).select("user_id", "name", F.col("event_type").alias("action"), "ts")


@query(f"SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + {DAY} AS window_end, c_nationkey AS nation, count(*) AS n, sum({CENTS})::BIGINT AS total FROM events JOIN customer ON user_id = c_custkey WHERE value >= 10 GROUP BY ALL")
def enrich_then_window(spark, d):
    users = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    rows = O.enrich(scored(events(spark, d)).where("value >= 10"), users, "user_id", "c_custkey")
    return O.window_aggregate(rows, "ts", "1 day", ["nation"], F.count("*").alias("n"), F.sum("score").alias("total"))


@query(f"SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + {HOUR} AS window_end, user_id, sum({CENTS})::BIGINT AS total_score FROM events GROUP BY ALL")
def user_score(spark, d):
    return O.window_aggregate(scored(events(spark, d)), "ts", "1 hour", ["user_id"], F.sum("score").alias("total_score"))


@query(f"SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + {HOUR} AS window_end, event_type AS team, sum({CENTS})::BIGINT AS total_score FROM events GROUP BY ALL")
def team_score(spark, d):
    rows = scored(events(spark, d)).withColumnRenamed("event_type", "team")
    return O.window_aggregate(rows, "ts", "1 hour", ["team"], F.sum("score").alias("total_score"))


TWO_LEVEL = f"""WITH u AS (SELECT time_bucket({{inner}}, ts) + {{inner}} AS fin, user_id, event_type AS team, sum({CENTS}) AS score FROM events GROUP BY ALL)
SELECT time_bucket({{outer}}, fin) AS window_start, time_bucket({{outer}}, fin) + {{outer}} AS window_end, team, sum(score)::BIGINT AS total_score, count(*) AS n_users FROM u GROUP BY ALL"""


@query(TWO_LEVEL.format(inner="INTERVAL 2 HOUR", outer="INTERVAL 8 HOUR"))
def user_then_team(spark, d):
    rows = scored(events(spark, d)).withColumnRenamed("event_type", "team")
    return O.two_level(rows, "ts", "2 hours", "8 hours", "user_id", "team", "score")


@query(f"SELECT {HOUR_START} AS window_start, {HOUR_START} + {HOUR} AS window_end, event_type, string_agg(event_id::VARCHAR || props, '|' ORDER BY event_id) AS payloads, count(*) AS n FROM events GROUP BY ALL")
def window_collect(spark, d):
    rows = events(spark, d).withColumn("payload", F.concat(F.col("event_id").cast("string"), "props"))
    out = O.collect_windows(rows, "ts", "1 hour", ["event_type"], ["event_id"], "payload")
    return out.select("window_start", "window_end", "event_type", F.array_join("payloads", "|").alias("payloads"), F.size("payloads").cast("long").alias("n"))


@query(f"""WITH r AS (SELECT {HOUR_START} AS window_start, event_type, event_id, (row_number() OVER (PARTITION BY {HOUR_START}, event_type ORDER BY event_id) - 1) // 3 AS piece FROM events)
SELECT window_start, window_start + {HOUR} AS window_end, event_type, piece, string_agg(event_id::VARCHAR, '|' ORDER BY event_id) AS payloads FROM r GROUP BY ALL""")
def window_pieces(spark, d):
    """Windows in pieces of at most three payloads."""
    out = O.collect_pieces(events(spark, d), "ts", "1 hour", ["event_type"], ["event_id"], "event_id", most=3, piece_rows=5000)
    return out.withColumn("payloads", F.array_join(F.col("payloads").cast("array<string>"), "|"))


# ---- messages and expressions


def message_rows(spark, d):
    rows = events(spark, d)
    return rows.select("event_id", F.create_map(F.lit("type"), F.col("event_type"), F.lit("eventtime"), epoch_ms("ts").cast("string")).alias("headers"), F.to_json(F.struct("user_id", epoch_ms("ts").alias("at"), F.get_json_object("props", "$.k").cast("int").alias("k"))).alias("payload"))


@query("SELECT event_id, 'code=' || json_extract_string(props, '$.k') || ';eventtime=' || (epoch_us(ts) // 1000)::VARCHAR || ';kind=' || event_type || ';type=' || event_type || ';user=' || user_id::VARCHAR AS headers FROM events")
def header_enrich(spark, d):
    out = M.enrich_headers(message_rows(spark, d), "user=payload.user_id;code=$.k;=payload.k;missing=payload.none;kind=header.type;void=")
    return out.select("event_id", M.headers_text(F.col("headers")).alias("headers"))


@query("SELECT event_id AS seq, user_id % 4 AS partition, 'kind=' || event_type || ';user=' || user_id::VARCHAR AS headers, props AS payload, ts AS event_time, user_id::VARCHAR AS the_key FROM events")
def topic_envelopes(spark, d):
    """Messages from a frame of a broker's shape: bytes, and headers as a list in which a repeated name counts last."""
    header = lambda name, value: F.struct(F.lit(name).alias("key"), value.cast("string").cast("binary").alias("value"))
    text = lambda c: F.col(c).cast("string").cast("binary")
    frame = events(spark, d).select(F.col("event_id").alias("offset"), (F.col("user_id") % 4).alias("partition"), F.array(header("kind", F.lit("old")), header("user", F.col("user_id")), header("kind", F.col("event_type"))).alias("headers"), text("props").alias("value"), F.col("ts").alias("timestamp"), text("user_id").alias("key"))
    return topic_envelope(frame).withColumn("headers", M.headers_text(F.col("headers")))


@query("SELECT event_id, upper('user ' || user_id::VARCHAR || ' did ' || event_type || ' at ' || (epoch_us(ts) // 1000)::VARCHAR) AS payload FROM events")
def inline_transform(spark, d):
    out = M.transform_payload(message_rows(spark, d), "upper(concat('user ', get_json_object(payload, '$.user_id'), ' did ', headers['type'], ' at ', get_json_object(payload, '$.at')))")
    return out.select("event_id", "payload")


@query("SELECT event_id AS id, event_type AS type, value AS amount FROM events")
def projection(spark, d):
    return events(spark, d).select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("value").alias("amount"))


@query("SELECT *, value >= 30 AS large, user_id % 4 AS part FROM events")
def computed_columns(spark, d):
    return events(spark, d).select("*", (F.col("value") >= 30).alias("large"), (F.col("user_id") % 4).alias("part"))


@query("SELECT event_id, value FROM (SELECT event_id, value FROM events WHERE value >= 30 AND value < 60)")
def range_filter(spark, d):
    return events(spark, d).where("value >= 30 and value < 60").select("event_id", "value")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TRY_CAST(event_type AS BIGINT) AS bad, strftime(ts, '%d/%m/%Y %H:%M:%S') AS shown, event_type <> 'view' AND value > 5 AS hit FROM events")
def parse_and_format(spark, d):
    return events(spark, d).select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.col("event_type").try_cast("bigint").alias("bad"), F.date_format("ts", "dd/MM/yyyy HH:mm:ss").alias("shown"), ((F.col("event_type") != "view") & (F.col("value") > 5)).alias("hit"))


@query("SELECT event_id, (epoch_us(ts) // 1000) AS by_path, (epoch_us(ts) // 1000) AS by_header, (epoch_us(ts) // 1000) AS by_default, CAST(NULL AS BIGINT) AS by_text, CAST(NULL AS BIGINT) AS by_missing, TRUE AS by_clock FROM events")
def event_time_extractors(spark, d):
    h, p = F.col("headers"), F.col("payload")
    return message_rows(spark, d).select("event_id", event_time("payload.at", h, p).alias("by_path"), event_time("header.eventtime", h, p).alias("by_header"), event_time(None, h, p).alias("by_default"), event_time("header.type", h, p).alias("by_text"), event_time("none", h, p).alias("by_missing"), (event_time("proc", h, p) > 0).alias("by_clock"))


# ---- replayed watermarks

DISORDER, LATENESS, SIZE = 2 * 3_600_000, 3_600_000, 3_600_000


def arrivals(spark, d) -> DataFrame:
    return scored(events(spark, d)).select("event_id", "user_id", "event_type", "score", epoch_ms("ts").alias("ms"), (F.col("event_id") + (F.col("event_id") * 7919) % 97).alias("seq"), (F.col("user_id") % 4).alias("part"))


def replayed(spark, d, lateness: int = LATENESS) -> DataFrame:
    return W.replay(arrivals(spark, d), "ms", ["seq", "event_id"], "part", DISORDER, lateness)


ARRIVALS = f"SELECT event_id, user_id, event_type, {CENTS} AS score, (epoch_us(ts) // 1000) AS ms, event_id + (event_id * 7919) % 97 AS seq, user_id % 4 AS part FROM events"


def replay_sql(rows: str, at: str, late: int, lateness: int, name: str) -> str:
    """CTEs up to one of this name: the rows with wm and status, by a window over all of them for each of four partitions.

    One partition after another becomes known: each time that of the earliest row that is not DISCARDED under those before.
    """
    tops = ", ".join(f"max(CASE WHEN part = {p} AND rn >= jrn THEN {at} END) OVER w AS t{p}" for p in range(4))
    out = [f"{name}_r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY seq, event_id) AS rn FROM {rows})", f"{name}_j1 AS MATERIALIZED (SELECT part AS jp, rn AS jrn FROM {name}_r WHERE {at} IS NOT NULL ORDER BY rn LIMIT 1)"]
    for k in range(1, 5):
        out.append(f"{name}_t{k} AS (SELECT {name}_r.*, {tops} FROM {name}_r LEFT JOIN {name}_j{k} ON part = jp WINDOW w AS (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
        out.append(f"{name}_m{k} AS MATERIALIZED (SELECT * EXCLUDE (t0, t1, t2, t3, rn), rn, least(t0, t1, t2, t3) - {late} AS wm FROM {name}_t{k})")
        if k < 4:
            out.append(f"{name}_j{k + 1} AS MATERIALIZED (SELECT jp, jrn FROM {name}_j{k} UNION ALL (SELECT part, rn FROM {name}_m{k} WHERE part NOT IN (SELECT jp FROM {name}_j{k}) AND {at} IS NOT NULL AND (wm IS NULL OR wm - {lateness} <= {at}) ORDER BY rn LIMIT 1))")
    out.append(f"{name} AS (SELECT * EXCLUDE (rn), CASE WHEN wm IS NULL OR wm <= {at} THEN 'VALID' WHEN wm - {lateness} <= {at} THEN 'LATE' ELSE 'DISCARDED' END AS status FROM {name}_m4)")
    return ", ".join(out)


def status_sql(lateness: int) -> str:
    return f"a AS ({ARRIVALS}), {replay_sql('a', 'ms', DISORDER + 1, lateness, 's')}"


@query(f"WITH {status_sql(LATENESS)} SELECT event_id, seq, part, ms, wm, status FROM s")
def late_status(spark, d):
    return replayed(spark, d).select("event_id", "seq", "part", "ms", "wm", "status")


@query(f"WITH {status_sql(LATENESS)} SELECT event_id, status FROM s WHERE status = 'VALID'")
def late_split_main(spark, d):
    return W.split_late(replayed(spark, d), "SIDE_CHANNEL")[0].select("event_id", "status")


@query(f"WITH {status_sql(LATENESS)} SELECT event_id, status FROM s WHERE status = 'LATE'")
def late_split_side(spark, d):
    return W.split_late(replayed(spark, d), "SIDE_CHANNEL")[1].select("event_id", "status")


@query(f"WITH {status_sql(LATENESS)} SELECT event_id, status FROM s WHERE status <> 'DISCARDED'")
def late_upsert(spark, d):
    return W.split_late(replayed(spark, d), "UPSERT")[0].select("event_id", "status")


CARRIED = f"""WITH {status_sql(LATENESS)}, c AS (SELECT event_id, seq, part, ms, coalesce(wm, ms - 1) AS carried FROM s), {replay_sql('c', 'carried', 0, LATENESS, 's2')}
SELECT event_id, carried, wm, status FROM s2"""


@query(CARRIED)
def carried_watermark(spark, d):
    """A second processor that takes the watermarks its rows carry."""
    first = replayed(spark, d).withColumn("carried", F.coalesce("wm", F.col("ms") - 1)).drop("wm", "status")
    path = fresh_path(spark, "carried")  # handed on once: the second replay counts, samples and cuts what it reads
    first.write.parquet(path)
    first = spark.read.schema(first.schema).parquet(path)
    return W.replay(first, "ms", ["seq", "event_id"], "part", 0, LATENESS, watermark="carried").select("event_id", "carried", "wm", "status")


@query(f"WITH {status_sql(0)} SELECT make_timestamp((ms - ms % {SIZE}) * 1000) AS window_start, make_timestamp((ms - ms % {SIZE} + {SIZE}) * 1000) AS window_end, event_type, count(*) AS n, sum(score)::BIGINT AS total FROM s WHERE wm IS NULL OR ms >= wm GROUP BY ALL")
def tumble_strict(spark, d):
    return W.fire_strict(replayed(spark, d, 0), "ms", SIZE, ["event_type"], n=F.count("*"), total=F.sum("score"))


@query(
    f"""WITH {status_sql(LATENESS)}, r AS (SELECT *, ms - ms % {SIZE} AS ws, coalesce(wm >= ms - ms % {SIZE} + {SIZE}, false) AS late FROM s WHERE status <> 'DISCARDED'),
    c AS (SELECT *, count(*) OVER w AS n, sum(score) OVER w AS total FROM r WINDOW w AS (PARTITION BY ws, event_type ORDER BY late, seq, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    f AS (SELECT ws, event_type, false AS late, CAST(NULL AS BIGINT) AS seq, count(*) AS n, sum(score) AS total FROM r WHERE NOT late GROUP BY ws, event_type UNION ALL SELECT ws, event_type, true, seq, n, total FROM c WHERE late)
    SELECT make_timestamp(ws * 1000) AS window_start, make_timestamp((ws + {SIZE}) * 1000) AS window_end, event_type, late, seq, n, total::BIGINT AS total FROM f"""
)
def tumble_lateness(spark, d):
    return W.fire_lateness(replayed(spark, d), "ms", SIZE, ["event_type"], ["seq", "event_id"], "score")


def firings_by_policy(policy: str, part: int):
    return lambda spark, d: W.split_firings(tumble_lateness(spark, d), policy)[part]


# late firings are dropped, go to the main output, or to the side
for _name, _policy, _part, _where in (("firings_drop", "DROP", 0, "NOT late"), ("firings_upsert", "UPSERT", 0, "true"), ("firings_main", "SIDE_CHANNEL", 0, "NOT late"), ("firings_side", "SIDE_CHANNEL", 1, "late")):
    QUERIES[_name] = firings_by_policy(_policy, _part)
    ORACLES[_name] = f"SELECT * FROM ({ORACLES['tumble_lateness']}) WHERE {_where}"


@query(
    f"""WITH a AS (SELECT * REPLACE (user_id % 100 AS part) FROM ({ARRIVALS})), t AS (SELECT *, {', '.join(f'max(CASE WHEN part = {p} THEN ms END) OVER w AS t{p}' for p in range(100))} FROM a WINDOW w AS (ORDER BY seq, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    m AS (SELECT event_id, ms, least({', '.join(f't{p}' for p in range(100))}) - {20 * DISORDER + 1} AS wm FROM t)
    SELECT event_id, wm, CASE WHEN wm IS NULL OR wm <= ms THEN 'VALID' WHEN wm - {LATENESS} <= ms THEN 'LATE' ELSE 'DISCARDED' END AS status FROM m"""
)
def late_many_partitions(spark, d):
    """A hundred source partitions, replayed in chunks of 3,000 rows. (No partition here begins with a DISCARDED row, so plain maxima do in SQL.)"""
    rows = arrivals(spark, d).withColumn("part", F.col("user_id") % 100)
    return W.replay(rows, "ms", ["seq", "event_id"], "part", 20 * DISORDER, LATENESS, chunk_rows=3000).select("event_id", "wm", "status")


@query(f"WITH {status_sql(0)} SELECT event_id, 'eventtime=' || ms::VARCHAR || ';type=' || event_type || coalesce(';watermark=' || wm::VARCHAR, '') AS headers FROM s")
def output_stamping(spark, d):
    rows = replayed(spark, d, 0).withColumn("headers", F.create_map(F.lit("type"), F.col("event_type"), F.lit("eventtime"), F.lit("0")))
    return M.stamp(rows, eventtime=F.col("ms"), watermark=F.col("wm")).select("event_id", M.headers_text(F.col("headers")).alias("headers"))


@query(f"SELECT 'eventtime=' || epoch_ms({HOUR_START} + {HOUR})::VARCHAR || ';partial=false;windowEndTime=' || epoch_ms({HOUR_START} + {HOUR})::VARCHAR || ';windowStartTime=' || epoch_ms({HOUR_START})::VARCHAR AS headers, count(*) AS n FROM events GROUP BY ALL")
def window_stamping(spark, d):
    rows = O.window_aggregate(events(spark, d), "ts", "1 hour", [], F.count("*").alias("n"))
    rows = rows.withColumn("headers", F.expr("cast(map() as map<string,string>)"))
    start, end = epoch_ms("window_start"), epoch_ms("window_end")
    return M.stamp(rows, windowStartTime=start, windowEndTime=end, partial=F.lit("false"), eventtime=end).select(M.headers_text(F.col("headers")).alias("headers"), "n")


# ---- keyed state, user functions, partitions


@query("SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark, d):
    return O.latest_per_key(events(spark, d), ["user_id"], ["ts", "event_id"])


@query("SELECT event_id, upper(event_type) AS event_type FROM events")
def udf_upper(spark, d):
    def fn(batch: pd.DataFrame) -> pd.DataFrame:
        return batch.assign(event_type=batch["event_type"].str.upper())

    return O.map_messages(events(spark, d).select("event_id", "event_type"), fn)


def _fold(record: dict, results: dict) -> None:
    row = results.setdefault(record["user_id"], {"window_start": record["window_start"], "user_id": record["user_id"], "n": 0, "total": 0})
    row["n"] += 1
    row["total"] += record["score"]


FOLD = "window_start timestamp_ntz, user_id long, n long, total long"


@query(f"SELECT date_trunc('day', ts) AS window_start, user_id, count(*) AS n, sum({CENTS})::BIGINT AS total FROM events GROUP BY ALL")
def udf_window_fold(spark, d):
    return O.fold_windows(scored(events(spark, d)).select("ts", "user_id", "score"), "ts", "1 day", ["user_id"], _fold, FOLD)


@query(f"SELECT date_trunc('day', ts) AS window_start, user_id, count(*) AS n, sum({CENTS})::BIGINT AS total FROM events GROUP BY ALL HAVING count(*) > 5")
def udf_release(spark, d):
    return O.fold_windows(scored(events(spark, d)).select("ts", "user_id", "score"), "ts", "1 day", ["user_id"], _fold, FOLD, release=lambda rows: [r for r in rows if r["n"] > 5])


@query("SELECT date_trunc('day', ts) AS window_start, user_id, count(*) AS n, 'count=' || count(*)::VARCHAR || ';kind=busy' AS headers FROM events GROUP BY date_trunc('day', ts), user_id HAVING count(*) > 5")
def udf_release_headers(spark, d):
    """What is released has headers of the user's making."""

    def fold(record: dict, results: dict) -> None:
        row = results.setdefault(record["user_id"], {"window_start": record["window_start"], "user_id": record["user_id"], "n": 0})
        row["n"] += 1

    out = O.fold_windows(events(spark, d).select("ts", "user_id"), "ts", "1 day", ["user_id"], fold, "window_start timestamp_ntz, user_id long, n long", release=lambda rows: [r for r in rows if r["n"] > 5], headers=lambda r: {"kind": "busy", "count": str(r["n"])})
    return out.withColumn("headers", M.headers_text(F.col("headers")))


@query(f"SELECT date_trunc('day', ts) AS window_start, count(*) AS n, sum({CENTS})::BIGINT AS total, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def udf_merging_fold(spark, d):
    """A user's fold of days that have all rows: folded where they are read, states merged.

    A first fold is of each day and share of the users, so that no state holds all users of a day; the second adds shares up.
    """
    plus = lambda a, b: b if a is None else a if b is None else a + b

    def add(state: list, record: dict) -> list:
        state[0] += 1
        state[1] = plus(state[1], record["score"])
        if record["user_id"] is not None:
            state[2].add(record["user_id"])
        return state

    def merge(a: list, b: list) -> list:
        a[2].update(b[2])
        return [a[0] + b[0], plus(a[1], b[1]), a[2]]

    sums = "n long, total long, users long"
    rows = scored(events(spark, d)).select("ts", "user_id", "score", F.pmod(F.xxhash64("user_id"), F.lit(64)).alias("share"))
    shares = O.fold_merging(rows, "ts", "1 day", ["share"], lambda: [0, None, set()], add, merge, lambda g, s: [{"ts": g["window_start"], "n": s[0], "total": s[1], "users": len(s[2])}], f"ts timestamp_ntz, {sums}")
    both = lambda a, b: (a[0] + b[0], plus(a[1], b[1]), a[2] + b[2])
    return O.fold_merging(shares.withColumn("key", F.lit("all")), "ts", "1 day", ["key"], lambda: (0, None, 0), lambda s, r: both(s, (r["n"], r["total"], r["users"])), both, lambda g, s: [{"window_start": g["window_start"], "n": s[0], "total": s[1], "users": s[2]}], f"window_start timestamp_ntz, {sums}")


@query("SELECT event_id, '[' || event_type || ']' AS payloads FROM events")
def single_collection(spark, d):
    """No function: rows pass as they are, each wrapped as a collection of one."""
    rows = O.map_messages(events(spark, d).select("event_id", "event_type"), None)
    return rows.select("event_id", F.concat(F.lit("["), F.array_join(F.array("event_type"), ","), F.lit("]")).alias("payloads"))


@query("SELECT user_id % 5 AS share, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def partition_rows(spark, d):
    rows = events(spark, d).withColumn("share", F.col("user_id") % 5).repartition(5, "share")
    return rows.groupBy("share").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT user_id, 1 AS tasks, count(*) AS n FROM events GROUP BY ALL")
def hashed_shares(spark, d):
    """All rows of a key are dealt to one task."""
    dealt = O.deal(events(spark, d), "user_id", 5).withColumn("task", F.spark_partition_id())
    return dealt.groupBy("user_id").agg(F.count_distinct("task").cast("int").alias("tasks"), F.count("*").alias("n"))


@query("SELECT 6 AS replicas, true AS even, count(*) AS n FROM events")
def round_robin(spark, d):
    """Rows dealt over six replicas without a key: each gets as many, but for the rest of each input partition."""
    per = events(spark, d).repartition(6).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").cast("int").alias("replicas"), (F.max("n") - F.min("n") <= 64).alias("even"), F.sum("n").alias("n"))


@query("SELECT event_id, 'kind=reply;of=' || event_type AS headers, 2.0 * CAST(json_extract_string(props, '$.k') AS DOUBLE) AS payload FROM events")
def udf_reply(spark, d):
    """A user's mapping that gives a payload of another type and headers of its own."""

    def fn(batch: pd.DataFrame) -> pd.DataFrame:
        payload = batch["payload"].map(lambda p: 2.0 * float(json.loads(json.loads(p)["props"])["k"]))
        return pd.DataFrame({"event_id": batch["event_id"], "headers": batch["headers"].map(lambda h: {"kind": "reply", "of": dict(h)["type"]}), "payload": payload})

    rows = M.envelope(events(spark, d), "props", headers={"type": F.col("event_type")}, keep=("event_id",))
    return O.map_messages(rows, fn, "event_id long, headers map<string,string>, payload double").withColumn("headers", M.headers_text(F.col("headers")))


@query("SELECT event_id, event_type AS value FROM events")
def registry_prefix(spark, d):
    """Values with and without the five bytes of a schema registry, cut off where they are."""
    value = F.when(F.col("event_id") % 2 == 0, F.concat(F.unhex(F.lit("0000000007")), F.col("event_type").cast("binary"))).otherwise(F.col("event_type").cast("binary"))
    return events(spark, d).select("event_id", without_registry_prefix(value).cast("string").alias("value"))


# ---- tables and SQL

META = {
    "name": "clicks",
    "fields": [
        {"name": "event_id", "type": "long"},
        {"name": "user", "type": "long", "metadata": "user_id"},
        {"name": "at", "type": "timestamp_ntz", "metadata": "ts", "watermark": "`at` - INTERVAL '30' SECONDS"},
        {"name": "action", "type": "string", "optional": True, "metadata": "event_type"},
        {"name": "seen", "type": "proctime"},
    ],
    "primaryKey": ["user"],
}


@query('SELECT event_id, user_id AS "user", ts AS "at", event_type AS action, true AS seen FROM events')
def meta_table(spark, d):
    """With a clock column, which is the time the query runs at."""
    rows = StreamTable.from_meta(META).apply(events(spark, d))
    return rows.withColumn("seen", F.abs(F.unix_seconds("seen") - F.unix_seconds(F.current_timestamp())) < 60)


@query("SELECT event_id, value, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events")
def ddl_table(spark, d):
    rows = events(spark, d).withColumn("day", F.to_date("ts"))
    return StreamTable.from_ddl("scores", "event_id BIGINT NOT NULL, value DOUBLE, day DATE").apply(rows).withColumn("day", F.col("day").cast("string"))


AVRO = '{"type": "record", "name": "Event", "fields": [{"name": "event_id", "type": "long"}, {"name": "event_type", "type": ["null", "string"]}, {"name": "value", "type": "double"}]}'


@query("SELECT event_id, event_type, value FROM events")
def avro_table(spark, d):
    return StreamTable.from_avro(AVRO).apply(events(spark, d))


@query("SELECT event_id, event_type, CAST(NULL AS DOUBLE) AS value FROM events")
def json_round_trip(spark, d):
    """Encoded as JSON with a key, decoded again; a missing field is null."""
    full = StreamTable.from_avro(AVRO)
    sent = full.encode(events(spark, d), ["event_id"])
    missing = sent.select("key", F.regexp_replace("value", ',"value":[-0-9.eE]+', "").alias("value"))
    return full.decode(missing)


@query("SELECT event_id::VARCHAR AS the_key, event_type, ts AS event_time FROM events")
def raw_key_and_metadata(spark, d):
    """A raw key and a broker time beside the value's own columns."""
    rows = events(spark, d).select(F.col("event_id").cast("string").cast("binary").alias("key"), "event_type", F.col("ts").alias("timestamp"))
    spec = StreamTable.from_ddl("keyed", "the_key STRING, event_type STRING, event_time TIMESTAMP_NTZ")
    spec.metadata = {"the_key": "key", "event_time": "timestamp"}
    return spec.apply(rows)


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'click' GROUP BY ALL")
def placeholder_sql(spark, d):
    text = "SELECT c_mktsegment AS segment, count(*) AS n FROM [[STREAM:Clicks]] c JOIN [[stream:users]] u ON c.user_id = u.c_custkey WHERE event_type = 'click' GROUP BY c_mktsegment"
    return run_sql(spark, text, {"clicks": events(spark, d), "users": table(spark, d, "customer")})


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' AND value > 20 GROUP BY ALL HAVING count(*) > 2")
def statement_pipeline(spark, d):
    out = run_pipeline(spark, [("large", "SELECT * FROM [[STREAM:events]] WHERE event_type = 'click' AND value > 20"), ("busy", "SELECT user_id, count(*) AS n FROM [[STREAM:large]] GROUP BY user_id HAVING count(*) > 2")], {"events": events(spark, d)})
    return out["busy"]


# ---- the rest of the SQL surface


@query(f"SELECT w AS window_start, w + INTERVAL 3 HOUR AS window_end, event_type, count(*) AS n FROM (SELECT event_type, unnest([{HOUR_START} - INTERVAL 2 HOUR, {HOUR_START} - INTERVAL 1 HOUR, {HOUR_START}]) AS w FROM events) GROUP BY ALL")
def hop_windows(spark, d):
    return hop(events(spark, d), "ts", "3 hours", "1 hour").groupBy("window_start", "window_end", "event_type").agg(F.count("*").alias("n"))


@query(
    """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k"""
)
def session_windows(spark, d):
    out = events(spark, d).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


@query(f"SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 6 HOUR * k AS window_end, count(*) AS n FROM events, range(1, 5) r(k) WHERE ts < date_trunc('day', ts) + INTERVAL 6 HOUR * k GROUP BY ALL")
def cumulate_windows(spark, d):
    return cumulate(events(spark, d), "ts", "6 hours", "1 day").groupBy("window_start", "window_end").agg(F.count("*").alias("n"))


@query("SELECT a.event_id AS click_id, b.event_id AS buy_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL 4 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def interval_join(spark, d):
    e = events(spark, d)
    a = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("at"))
    b = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("buy_id"), "ts")
    return O.within(a, b, "user_id", "at", "ts", "4 hours").select("click_id", "buy_id")


@query("SELECT c_custkey, count(event_id) AS n FROM customer LEFT JOIN events ON user_id = c_custkey AND value > 90 GROUP BY ALL")
def outer_join(spark, d):
    e = events(spark, d).where("value > 90").groupBy("user_id").agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(e, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT c_custkey, true AS active FROM customer WHERE c_custkey IN (SELECT user_id FROM events) UNION ALL SELECT c_custkey, false FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def semi_and_anti_join(spark, d):
    c, e = table(spark, d, "customer").select("c_custkey"), events(spark, d).select(F.col("user_id").alias("c_custkey"))
    return c.join(e, "c_custkey", "left_semi").withColumn("active", F.lit(True)).unionByName(c.join(e, "c_custkey", "left_anti").withColumn("active", F.lit(False)))


@query("SELECT a.event_id, a.user_id, b.event_id AS last_signup, b.value AS signup_value FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') b ON a.user_id = b.user_id AND a.ts >= b.ts")
def asof_enrich(spark, d):
    e = events(spark, d)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("last_signup"), F.col("value").alias("signup_value"))
    return O.as_of(left, right, "user_id", "ts", "since", ["last_signup", "signup_value"]).drop("ts")


@query("SELECT 'union' AS op, count(*) AS n FROM (SELECT user_id FROM events WHERE event_type = 'click' UNION SELECT o_custkey FROM orders) UNION ALL SELECT 'intersect', count(*) FROM (SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'except', count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT user_id FROM events WHERE event_type = 'click')")
def set_operations(spark, d):
    a, b = events(spark, d).where("event_type = 'click'").select("user_id"), table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"))
    count = lambda op, df: df.agg(F.lit(op).alias("op"), F.count("*").alias("n")).select("op", "n")
    return count("union", a.unionByName(b).distinct()).unionByName(count("intersect", a.intersect(b))).unionByName(count("except", b.subtract(a)))


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
def grouping_sets(spark, d):
    text = "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())"
    return spark.sql(text, orders=table(spark, d, "orders"))


@query("SELECT 'cube' AS kind, event_type, user_id % 3 AS part, count(*) AS n FROM events GROUP BY CUBE (event_type, user_id % 3) UNION ALL SELECT 'rollup', event_type, user_id % 3, count(*) FROM events GROUP BY ROLLUP (event_type, user_id % 3)")
def cube_and_rollup(spark, d):
    e = events(spark, d).select("event_type", (F.col("user_id") % 3).alias("part"))
    named = lambda kind, g: g.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "event_type", "part", "n")
    return named("cube", e.cube("event_type", "part")).unionByName(named("rollup", e.rollup("event_type", "part")))


@query(f"SELECT event_id, sum({CENTS}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS last_three, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS last_day, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
def over_frames(spark, d):
    by = Window.partitionBy("user_id")
    rows = scored(events(spark, d))
    last_day = F.expr("count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW)")
    ordered = by.orderBy("ts", "event_id")
    return rows.select("event_id", F.sum("score").over(ordered.rowsBetween(-2, 0)).alias("last_three"), last_day.alias("last_day"), F.lag("event_type").over(ordered).alias("before"))


@query("SELECT user_id, event_type, min(ts) AS first_ts, arg_min(event_id, (ts, event_id)) AS first_id, arg_max(event_id, (ts, event_id)) AS last_id FROM events GROUP BY ALL")
def deduplication(spark, d):
    at = F.struct("ts", "event_id")
    return events(spark, d).groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"), F.min_by("event_id", at).alias("first_id"), F.max_by("event_id", at).alias("last_id"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def global_top(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT c_custkey, lower(c_name) AS low, substr(c_name, 10, 5) AS part, length(c_name) AS len, replace(c_mktsegment, 'A', 'a') AS swapped, trim('  ' || c_mktsegment || ' ') AS trimmed, lpad(c_custkey::VARCHAR, 8, '0') AS padded, reverse(c_mktsegment) AS reversed, regexp_extract(c_name, '[0-9]+') AS digits, strpos(c_name, '#') AS hash_at FROM customer")
def string_functions(spark, d):
    c = F.col
    return table(spark, d, "customer").select("c_custkey", F.lower("c_name").alias("low"), F.substring("c_name", 10, 5).alias("part"), F.length("c_name").cast("long").alias("len"), F.replace(c("c_mktsegment"), F.lit("A"), F.lit("a")).alias("swapped"), F.trim(F.concat(F.lit("  "), c("c_mktsegment"), F.lit(" "))).alias("trimmed"), F.lpad(c("c_custkey").cast("string"), 8, "0").alias("padded"), F.reverse("c_mktsegment").alias("reversed"), F.regexp_extract("c_name", "[0-9]+", 0).alias("digits"), F.instr("c_name", "#").cast("long").alias("hash_at"))


@query("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS doy, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month_start, CAST(CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS VARCHAR) AS later, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days, CAST(last_day(o_orderdate) AS VARCHAR) AS month_end FROM orders")
def date_functions(spark, d):
    at = F.col("o_orderdate")
    i = lambda c: c.cast("long")
    return table(spark, d, "orders").select("o_orderkey", i(F.year(at)).alias("y"), i(F.month(at)).alias("m"), i(F.dayofmonth(at)).alias("dd"), i(F.quarter(at)).alias("q"), i(F.dayofyear(at)).alias("doy"), F.trunc(F.to_date(at), "month").cast("string").alias("month_start"), F.date_add(F.to_date(at), 30).cast("string").alias("later"), i(F.date_diff(F.to_date(at), F.lit("1995-01-01").cast("date"))).alias("days"), F.last_day(F.to_date(at)).cast("string").alias("month_end"))


@query("SELECT p_partkey, abs(p_partkey - 100) AS a, p_partkey % 7 AS m, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, greatest(p_size, 10) AS g, sign(p_size - 25) AS s, p_partkey & 12 AS bits, round(sqrt(p_size), 6) AS r, CAST(power(p_size, 2) AS BIGINT) AS p FROM part")
def math_functions(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.abs(k - 100).alias("a"), (k % 7).alias("m"), F.floor("p_retailprice").cast("long").alias("f"), F.ceil("p_retailprice").cast("long").alias("c"), F.greatest(s, F.lit(10)).alias("g"), F.signum(s - 25).cast("tinyint").alias("s"), k.bitwiseAND(F.lit(12).cast("long")).alias("bits"), F.round(F.sqrt(s), 6).alias("r"), F.pow(s, F.lit(2)).cast("long").alias("p"))


@query("WITH a AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds, list_sort(list(event_id)) AS ids FROM events GROUP BY user_id) SELECT user_id, array_to_string(kinds, ',') AS kinds, len(kinds) AS n_kinds, list_contains(kinds, 'error') AS has_error, ids[1] AS first_id, list_sum(list_transform(ids, lambda x: x % 10))::BIGINT AS digit_sum, len(list_filter(ids, lambda x: x % 2 = 0)) AS even FROM a")
def array_functions(spark, d):
    a = events(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("k"), F.array_sort(F.collect_list("event_id")).alias("ids"))
    return a.select("user_id", F.array_join("k", ",").alias("kinds"), F.size("k").cast("long").alias("n_kinds"), F.array_contains("k", "error").alias("has_error"), F.element_at("ids", 1).alias("first_id"), F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x % 10).alias("digit_sum"), F.size(F.filter("ids", lambda x: x % 2 == 0)).cast("long").alias("even"))


@query("SELECT event_id, event_type AS kind, json_extract_string(props, '$.k') AS k, '{\"id\":' || event_id::VARCHAR || ',\"kind\":\"' || event_type || '\"}' AS doc, 2 AS size FROM events")
def map_and_json_functions(spark, d):
    made = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("k"), F.get_json_object("props", "$.k"))
    return events(spark, d).withColumn("m", made).select("event_id", F.col("m")["kind"].alias("kind"), F.element_at("m", "k").alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("m")["kind"].alias("kind"))).alias("doc"), F.size("m").alias("size"))


# ---- streams, run over all that is there


def table_stream(spark, d, name: str) -> DataFrame:
    """A table's files as a stream: a folder of files, or one file beside others."""
    batch = table(spark, d, name)
    reader = spark.readStream.schema(batch.schema)
    if batch.inputFiles()[0].endswith(f"/{name}.parquet"):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)
    return reader.parquet(f"{d}/{name}.parquet")


def event_stream(spark, d) -> DataFrame:
    stream = table_stream(spark, d, "events")
    return stream.withColumn("at", F.to_timestamp(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")))


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Timestamps of these columns without zone, as in the tables."""
    return df.select(*(F.to_timestamp_ntz(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias(c) if c in names else F.col(c) for c in df.columns))


CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 60001 MILLISECOND"


@query(f"SELECT {HOUR_START} AS window_start, {HOUR_START} + {HOUR} AS window_end, event_type, count(*) AS n FROM events WHERE {HOUR_START} + {HOUR} <= {CLOSED} GROUP BY ALL")
def stream_tumble_append(spark, d):
    out = S.windowed(event_stream(spark, d).select("at", "event_type"), "at", "1 minute", "1 hour", ["event_type"], F.count("*").alias("n")).drop("w")
    return plain(S.run_available(out, "stream-tumble"), "window_start", "window_end")


@query("SELECT event_id, c_mktsegment AS segment FROM events JOIN customer ON user_id = c_custkey WHERE value >= 50")
def stream_join(spark, d):
    """Stream with stream, kept without a time bound."""
    stream = table_stream(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return S.run_available(event_stream(spark, d).where("value >= 50").join(stream, F.expr("user_id = c_custkey")).select("event_id", "segment"), "stream-join")


@query("SELECT event_id, upper(c_name) AS name FROM events JOIN customer ON user_id = c_custkey WHERE c_mktsegment = 'MACHINERY'")
def stream_enrich(spark, d):
    """Stream with a table, filtered."""
    users = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey", F.upper("c_name").alias("name"))
    return S.run_available(event_stream(spark, d).join(users, F.expr("user_id = c_custkey")).select("event_id", "name"), "stream-enrich")


@query(f"""WITH c AS (SELECT date_trunc('day', ts) AS window_start, event_type, user_id, count(*) AS n FROM events WHERE date_trunc('day', ts) + {DAY} <= {CLOSED} GROUP BY ALL)
SELECT window_start, window_start + {DAY} AS window_end, event_type, user_id, n, row_number() OVER (PARTITION BY window_start, event_type ORDER BY n DESC, user_id) AS row_num FROM c QUALIFY row_number() OVER (PARTITION BY window_start, event_type ORDER BY n DESC, user_id) <= 3""")
def stream_topk(spark, d):
    folder = fresh_path(spark, "stream-topk")
    S.write_top_k(event_stream(spark, d).select("at", "event_type", "user_id"), "at", "1 minute", "1 day", "event_type", "user_id", 3, folder, f"{folder}-state").awaitTermination()
    kinds = "window_start timestamp, window_end timestamp, event_type string, user_id long, n long, row_num long"
    return plain(spark.read.schema(kinds).parquet(folder).drop("batch"), "window_start", "window_end")


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_upsert(spark, d):
    stream = event_stream(spark, d).select("event_id", "user_id", "event_type", "at")
    folder = fresh_path(spark, "upsert")
    S.upsert(stream, ["user_id"], ["at", "event_id"], folder, f"{folder}-state").awaitTermination()
    return S.read_upserted(spark, folder, stream.schema, ["user_id"], ["at", "event_id"]).select("event_id", "user_id", "event_type")


@query("SELECT event_id, event_type FROM events")
def stream_dedup(spark, d):
    """Each event twice in the stream, once in the output."""
    stream = event_stream(spark, d).select("event_id", "event_type", "at")
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return S.run_available(S.distinct_events(twice, "at", "1 hour", ["event_id"]), "stream-dedup").select("event_id", "event_type")


CLICKS = "SELECT event_id, user_id FROM events WHERE event_type = 'click' AND value > 20"


@query(f"SELECT 'sink' AS place, event_id, c_mktsegment AS segment FROM ({CLICKS}) JOIN customer ON user_id = c_custkey UNION ALL SELECT 'side', event_id, NULL FROM ({CLICKS}) WHERE user_id < 20")
def stream_statements(spark, d):
    """Two statements, each a query of its own into a sink, the second over the first one's sink, and a side query."""
    statements = [
        ("large", "SELECT event_id, user_id FROM [[STREAM:events]] WHERE event_type = 'click' AND value > 20"),
        ("segments", "SELECT event_id, c_mktsegment AS segment FROM [[STREAM:large]] l JOIN [[STREAM:users]] u ON l.user_id = u.c_custkey"),
    ]
    streams = {"events": event_stream(spark, d), "users": table(spark, d, "customer")}
    sinks, side, _ = run_statements(spark, statements, streams, fresh_path(spark, "statements"), side="SELECT event_id FROM [[STREAM:large]] WHERE user_id < 20")
    named = lambda place, df: df.select(F.lit(place).alias("place"), "event_id", "segment")
    return named("sink", sinks["segments"]).unionByName(named("side", side.withColumn("segment", F.lit(None).cast("string"))))


@query(f"SELECT 'sink' AS place, event_id, 3 AS alive FROM ({CLICKS}) UNION ALL SELECT 'second', event_id, 3 FROM ({CLICKS}) WHERE event_id % 2 = 0 UNION ALL SELECT 'side', event_id, 3 FROM ({CLICKS}) WHERE user_id < 20")
def stream_statements_together(spark, d):
    """Two statements and a side query, all alive at once; the second and the side query read the first one's sink."""
    statements = [("large", "SELECT event_id, user_id FROM [[STREAM:events]] WHERE event_type = 'click' AND value > 20"), ("even", "SELECT event_id FROM [[STREAM:large]] WHERE event_id % 2 = 0")]
    running = Statements(spark, statements, {"events": event_stream(spark, d)}, fresh_path(spark, "together"), side="SELECT event_id FROM [[STREAM:large]] WHERE user_id < 20")
    running.settle()
    alive = running.alive()
    running.stop()
    named = lambda place, name: running.rows(name).select(F.lit(place).alias("place"), "event_id", F.lit(alive).alias("alive"))
    return named("sink", "large").unionByName(named("second", "even")).unionByName(named("side", "side"))


def arrival_stream(spark, d, pieces: int = 4) -> DataFrame:
    """Arrivals as a stream of several batches: files of successive ranges of the arrival number, written one after another."""
    rows = arrivals(spark, d)
    folder, (low, high) = fresh_path(spark, "arrivals"), rows.agg(F.min("seq"), F.max("seq")).first()
    low, step = low or 0, ((high or 0) - (low or 0)) // pieces + 1
    for n in range(pieces):
        rows.where(F.col("seq").between(low + n * step, low + (n + 1) * step - 1)).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def stream_replayed(spark, d, part: int) -> DataFrame:
    out = fresh_path(spark, "stream-late")
    places = (f"{out}/main", f"{out}/side")
    S.write_replayed(arrival_stream(spark, d), "ms", ["seq", "event_id"], "part", DISORDER, LATENESS, "SIDE_CHANNEL", *places, f"{out}/held", f"{out}/state").awaitTermination()
    return spark.read.schema("event_id long, wm long, status string").parquet(places[part]).select("event_id", "wm", "status")


@query(f"WITH {status_sql(LATENESS)} SELECT event_id, wm, status FROM s WHERE status = 'VALID'")
def stream_late_main(spark, d):
    """The main rows of arrivals in four batches, with watermarks carried from batch to batch."""
    return stream_replayed(spark, d, 0)


@query(f"WITH {status_sql(LATENESS)} SELECT event_id, wm, status FROM s WHERE status = 'LATE'")
def stream_late_side(spark, d):
    return stream_replayed(spark, d, 1)


@query(f"WITH {status_sql(LATENESS)} SELECT event_id, 'eventtime=' || ms::VARCHAR || ';type=' || event_type || coalesce(';watermark=' || wm::VARCHAR, '') AS headers FROM s WHERE status <> 'DISCARDED'")
def stream_stamped_bridge(spark, d):
    """A bridge that forwards what isn't discarded, with event time and watermark in the headers."""
    out = fresh_path(spark, "stamped")
    stamp = lambda rows: M.stamp(rows.withColumn("headers", F.create_map(F.lit("type"), F.col("event_type"))), eventtime=F.col("ms"), watermark=F.col("wm"))
    S.write_replayed(arrival_stream(spark, d), "ms", ["seq", "event_id"], "part", DISORDER, LATENESS, "UPSERT", f"{out}/main", f"{out}/side", f"{out}/held", f"{out}/state", stamp=stamp).awaitTermination()
    rows = spark.read.schema("event_id long, headers map<string,string>").parquet(f"{out}/main")
    return rows.select("event_id", M.headers_text(F.col("headers")).alias("headers"))


def two_streams(spark, d) -> tuple[DataFrame, DataFrame]:
    clicks = event_stream(spark, d).where("event_type = 'click'").select(F.col("user_id").alias("clicker"), F.col("event_id").alias("click_id"), F.col("at").alias("clicked"))
    buys = event_stream(spark, d).where("event_type = 'purchase'").select(F.col("user_id").alias("buyer"), F.col("event_id").alias("buy_id"), F.col("at").alias("bought"))
    return clicks, buys


@query("SELECT a.event_id AS click_id, b.event_id AS buy_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL 4 HOUR WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def stream_interval_join(spark, d):
    """Stream with stream within a time, state bounded by watermarks."""
    clicks, buys = two_streams(spark, d)
    return S.run_available(S.join_within_time(clicks, buys, "clicker", "buyer", "clicked", "bought", "1 hour", "4 hours").select("click_id", "buy_id"), "stream-within")


@query("""WITH m AS (SELECT least(max(ts) FILTER (event_type = 'click'), max(ts) FILTER (event_type = 'purchase')) - INTERVAL 6 HOUR AS closed FROM events)
SELECT a.event_id AS click_id, b.event_id AS buy_id FROM (SELECT * FROM events WHERE event_type = 'click') a LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL 4 HOUR WHERE a.ts < (SELECT closed FROM m)""")
def stream_outer_join(spark, d):
    """The same with clicks that nobody bought after, of the time that is closed."""
    clicks, buys = two_streams(spark, d)
    rows = S.run_available(S.join_within_time(clicks, buys, "clicker", "buyer", "clicked", "bought", "1 hour", "4 hours", "left_outer").select("click_id", "clicked", "buy_id"), "stream-outer")
    tops = events(spark, d).agg(F.least(F.max(F.when(F.col("event_type") == "click", F.col("ts"))), F.max(F.when(F.col("event_type") == "purchase", F.col("ts")))).alias("top"))
    closed = tops.select((F.col("top") - F.expr("interval 6 hours")).alias("closed"))
    return plain(rows, "clicked").join(F.broadcast(closed), F.col("clicked") < F.col("closed")).select("click_id", "buy_id")


@query("""WITH m AS (SELECT max(ts) - INTERVAL 2 HOUR AS closed FROM events WHERE event_type IN ('purchase', 'signup'))
SELECT a.event_id, a.user_id, b.event_id AS last_signup, b.value AS signup_value FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') b ON a.user_id = b.user_id AND a.ts >= b.ts WHERE a.ts < (SELECT closed FROM m)""")
def stream_asof(spark, d):
    """As-of enrichment on a stream, of the time that is closed."""
    e = event_stream(spark, d)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "at")
    right = e.where("event_type = 'signup'").select("user_id", F.col("at").alias("since"), F.col("event_id").alias("last_signup"), F.col("value").alias("signup_value"))
    rows = plain(S.run_available(K.as_of_stream(left, right, "user_id", "at", "since", ["last_signup", "signup_value"], "1 hour"), "stream-asof"), "at")
    closed = events(spark, d).where("event_type in ('purchase', 'signup')").select((F.max("ts") - F.expr("interval 2 hours")).alias("closed"))
    return rows.join(F.broadcast(closed), F.col("at") < F.col("closed")).drop("at", "closed")


@query("SELECT time_bucket(INTERVAL 10 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, event_type, count(*) AS n, true AS partial FROM events GROUP BY ALL")
def stream_idle_release(spark, d):
    """A source that falls silent: each key's windows are released one after another, the oldest first, until none is open."""
    fold = lambda s, b: ((s[0] if s else 0) + len(b),)
    stream = K.release_oldest(event_stream(spark, d).select("event_type", "at"), "at", ["event_type"], "10 days", "300 milliseconds", fold, "n long", lambda s: {"n": s[0]}, "n long")
    out = fresh_path(spark, "idle")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(processingTime="300 milliseconds").start()
    wanted, until = events(spark, d).select("event_type", F.window("ts", "10 days")).distinct().count(), time.time() + 120
    read = lambda: spark.read.schema(stream.schema).parquet(out)
    try:
        while query.isActive and time.time() < until and read().count() < wanted:
            time.sleep(0.5)
    finally:
        query.stop()
    return plain(read(), "window_start")


HEADED = {"name": "headed", "fields": [{"name": "header", "type": "struct<at:timestamp>"}, {"name": "event_type", "type": "string"}], "timeAttributes": {"header.at": "`header.at` - INTERVAL '60' SECONDS"}}


@query(f"SELECT {HOUR_START} AS window_start, event_type, count(*) AS n FROM events WHERE {HOUR_START} + {HOUR} <= (SELECT max(ts) FROM events) - INTERVAL 60 SECOND GROUP BY ALL")
def stream_table_time(spark, d):
    """A table whose declared event time is a field of a struct, on a stream."""
    rows = StreamTable.from_meta(HEADED).apply(event_stream(spark, d).select(F.struct("at").alias("header"), "event_type"))
    out = rows.groupBy(F.window("header_at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return plain(S.run_available(out.select(F.col("w.start").alias("window_start"), "event_type", "n"), "stream-table"), "window_start")


@query("SELECT event_id, event_type FROM events")
def stream_bridge(spark, d):
    """Retransmission: rows go from one place to another unchanged."""
    return S.run_available(event_stream(spark, d).select("event_id", "event_type"), "bridge")


# ---- pipelines


@query("SELECT 'SONG ' || user_id::VARCHAR || ' BY ' || genre || ' #' || row_num::VARCHAR AS line, plays FROM (" + TOPK + ")")
def pipeline_top_songs(spark, d):
    top = topk_per_window(spark, d).select(F.concat(F.lit("song "), F.col("user_id").cast("string"), F.lit(" by "), "genre", F.lit(" #"), F.col("row_num").cast("string")).alias("line"), "plays")
    return O.map_messages(top, lambda b: b.assign(line=b["line"].str.upper()))


@query("SELECT user_id, upper(c_name) AS name, event_type AS action, ts FROM events JOIN customer ON user_id = c_custkey WHERE c_mktsegment = 'BUILDING'")
def pipeline_vip_clicks(spark, d):
    return O.map_messages(vip_join_filter(spark, d), lambda b: b.assign(name=b["name"].str.upper()))


@query(f"SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + {HOUR} AS window_end, user_id AS card, count(*) AS attempts, 'ALERT ' || user_id::VARCHAR AS alert FROM events GROUP BY ALL HAVING count(*) > 1")
def pipeline_card_fraud(spark, d):
    rows = events(spark, d).withColumnRenamed("user_id", "card")
    return O.window_aggregate(rows, "ts", "1 hour", ["card"], F.count("*").alias("attempts")).where("attempts > 1").withColumn("alert", F.concat(F.lit("ALERT "), F.col("card").cast("string")))


@query(f"SELECT window_start, error_code, 'error ' || error_code || ' x' || n::VARCHAR AS note FROM (SELECT {HOUR_START} AS window_start, json_extract_string(props, '$.k') AS error_code, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL)")
def pipeline_iot_errors(spark, d):
    return iot_error_count(spark, d).select("window_start", "error_code", F.concat(F.lit("error "), "error_code", F.lit(" x"), F.col("error_count").cast("string")).alias("note"))


@query(TWO_LEVEL.format(inner="INTERVAL 1 HOUR", outer="INTERVAL 6 HOUR"))
def pipeline_game_scores(spark, d):
    """Headers from the payload, per user and then per team: dealt by user for the first level and by team for the second, partial sums before either."""
    rows = M.envelope(scored(events(spark, d)).withColumnRenamed("event_type", "team"), "team", "user_id", "score", keep=("ts",))
    rows = M.enrich_headers(rows, "team=payload.team;user=payload.user_id")
    rows = rows.select("ts", F.col("headers")["team"].alias("team"), F.col("headers")["user"].cast("long").alias("user_id"), F.get_json_object("payload", "$.score").cast("long").alias("score"))
    return O.two_level(rows, "ts", "1 hour", "6 hours", "user_id", "team", "score")


@query("SELECT date_trunc('day', ts) AS window_start, user_id::VARCHAR AS card, count(*) AS n, 'card ' || user_id::VARCHAR || ' tried ' || count(*)::VARCHAR || ' times' AS logged FROM events GROUP BY date_trunc('day', ts), user_id HAVING count(*) > 5")
def pipeline_fraud_light(spark, d):
    """Event time from a header, a user's fold per window and card, a release of frequent ones, and what is logged of them."""
    rows = M.envelope(events(spark, d).withColumn("card", F.col("user_id").cast("string")), "card", headers={"timestamp": epoch_ms("ts")})
    timed = rows.withColumn("at", from_ms(event_time("header.timestamp", F.col("headers"), F.col("payload")))).withColumn("card", F.get_json_object("payload", "$.card"))

    def fold(record: dict, results: dict) -> None:
        row = results.setdefault(record["card"], {"window_start": record["window_start"], "card": record["card"], "n": 0})
        row["n"] += 1

    found = O.fold_windows(timed.select("at", "card"), "at", "1 day", ["card"], fold, "window_start timestamp_ntz, card string, n long", release=lambda out: [r for r in out if r["n"] > 5])
    return found.withColumn("logged", F.format_string("card %s tried %d times", "card", "n"))
