"""Structured Streaming over the given files, run to the end of the data, and the batch twins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.operators import ordered, orders as od, qna_chunks as qna, turns as tn
from loreloom.plans import credit
from loreloom.plans.chunking import SEGMENTS
from loreloom.plans.registry import query, table
from loreloom.session import work_folder
from loreloom.sources import sinks
from loreloom.streaming import activity, ingest, orders as so, turns as st


ARRIVALS = 3


class Arrivals:
    """A table as files that arrive in several parts, in the order of a column; rows without an order come first.

    A part is written by as many tasks as it has partitions, and the stream runs to the end of the data after each.
    """

    def __init__(self, spark: SparkSession, d: str, name: str, by: str = "ts"):
        self.rows, self.by, self.folder = table(spark, d, name), F.col(by), work_folder(spark, f"{name}-arrivals")
        self.rows.limit(0).write.parquet(self.folder)
        self.stream = spark.readStream.schema(self.rows.schema).parquet(self.folder)

    def __iter__(self):
        ends = self.rows.agg(F.percentile_approx(self.by, [i / ARRIVALS for i in range(1, ARRIVALS)]).alias("e")).first()["e"] or []
        for low, high in zip([None, *ends], [*ends, None], strict=True):
            after = self.by.isNotNull() if low is None else self.by > F.lit(low)
            within = after if high is None else after & (self.by <= F.lit(high))
            self.rows.where(within | self.by.isNull() if low is None else within).write.mode("append").parquet(self.folder)
            yield


def run(rows: DataFrame, name: str, mode: str = "append", *, arrivals: Iterable = (None,)) -> DataFrame:
    """Drain a stream into files, once for each arrival of its input, and read them back with their micro-batch number."""
    spark = rows.sparkSession
    ingest.use_rocksdb(spark)
    path, state = work_folder(spark, name), work_folder(spark, f"{name}-state")
    for _ in arrivals:
        ingest.to_files(rows, path, state, mode=mode).awaitTermination()
    return spark.read.parquet(path)


# Turns: the events of a user on one day. view = token, click = usage, signup = model, purchase = retrieval, error = fallback or error.
def turn_events(e: DataFrame) -> DataFrame:
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("int")
    failed = (kind == "error") & (k >= 50)
    name = F.when(kind == "view", "token").when(kind == "click", "usage").when(kind == "signup", "model").when(kind == "purchase", "retrieval").when(
        failed, "error").otherwise("fallback")
    model = F.concat(F.lit("m"), k % 3)
    body = (
        F.when(name == "token", F.concat(F.lit('"'), k, F.lit('"')))
        .when(name == "usage", F.to_json(F.struct((k * 3).alias("input_tokens"), k.alias("output_tokens"), F.lit("stop").alias("finish_reason"))))
        .when(name == "model", F.to_json(F.struct(model.alias("resolved_model"), F.concat(model, F.lit("-id")).alias("resolved_model_id"))))
        .when(name == "retrieval", F.to_json(F.struct(F.when(k < 10, "partial").otherwise("ok").alias("status"), k.alias("retrieval_ms"), F.lit(2).alias("rerank_ms"))))
        .when(name == "error", F.to_json(F.struct(F.lit("model").alias("provider"), F.concat(F.lit("e"), k).alias("code"), F.lit("broken").alias("message"))))
        .otherwise(F.to_json(F.struct(model.alias("from"), F.concat(F.lit("m"), (k + 1) % 3).alias("to"), F.struct(F.lit("slow").alias("code")).alias("reason"))))
    )
    return e.select(F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("turn_id"), F.col("event_id").alias("seq"),
                    F.col("ts").cast("timestamp").alias("ts"), name.alias("event_type"), body.alias("payload"))


TURN_SQL = """
WITH v AS (SELECT CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS turn_id, event_id AS seq, ts, CAST(json_extract_string(props, '$.k') AS INT) AS k,
  CASE event_type WHEN 'view' THEN 'token' WHEN 'click' THEN 'usage' WHEN 'signup' THEN 'model' WHEN 'purchase' THEN 'retrieval' ELSE CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) >= 50 THEN 'error' ELSE 'fallback' END END AS kind FROM events),
named AS (SELECT turn_id, 'm' || CAST(k % 3 AS VARCHAR) AS model, seq * 2 AS place FROM v WHERE kind IN ('model', 'fallback') UNION ALL SELECT turn_id, 'm' || CAST((k + 1) % 3 AS VARCHAR), seq * 2 + 1 FROM v WHERE kind = 'fallback'),
tried AS (SELECT turn_id, string_agg(model, ',' ORDER BY place) AS models FROM (SELECT turn_id, model, min(place) AS place FROM named GROUP BY turn_id, model) GROUP BY turn_id),
t AS (SELECT turn_id, count(*) FILTER (kind = 'error') > 0 AS failed, count(*) FILTER (kind = 'fallback') > 0 AS fell, min(ts) AS s, max(ts) AS e,
  min(ts) FILTER (kind = 'token') AS first_token, max(ts) FILTER (kind = 'retrieval') AS gen, max(seq) FILTER (kind = 'fallback') AS fb, max(seq) FILTER (kind = 'model') AS ms,
  arg_max('m' || CAST(k % 3 AS VARCHAR), seq) FILTER (kind = 'model') AS m, arg_max(k * 3, seq) FILTER (kind = 'usage') AS input_tokens, arg_max(k, seq) FILTER (kind = 'retrieval') AS retrieval_ms,
  arg_max(CASE WHEN k < 10 THEN 'partial' ELSE 'ok' END, seq) FILTER (kind = 'retrieval') AS rs, arg_max(CASE kind WHEN 'error' THEN 'e' || CAST(k AS VARCHAR) ELSE 'slow' END, seq) FILTER (kind IN ('error', 'fallback')) AS error_code FROM v GROUP BY turn_id)
SELECT turn_id, CASE WHEN failed AND first_token IS NOT NULL THEN 'partial_error' WHEN failed THEN 'error' WHEN fell THEN 'success_fallback' ELSE 'success' END AS status, CASE WHEN ms > coalesce(fb, -1) THEN m END AS resolved_model,
  models AS attempted_models, coalesce(rs, 'pending') AS retrieval_status, error_code, CAST(input_tokens AS BIGINT) AS input_tokens, CAST(retrieval_ms AS BIGINT) AS retrieval_ms,
  CAST(round_even((epoch_us(first_token) - epoch_us(s)) / 1000.0, 0) AS BIGINT) AS first_token_ms, CAST(round_even((epoch_us(e) - epoch_us(gen)) / 1000.0, 0) AS BIGINT) AS generation_ms, CAST(round_even((epoch_us(e) - epoch_us(s)) / 1000.0, 0) AS BIGINT) AS total_ms
FROM t LEFT JOIN tried USING (turn_id)"""
TURN_COLUMNS = ["turn_id", "status", "resolved_model", "attempted_models", "retrieval_status", "error_code", "input_tokens", "retrieval_ms",
                "first_token_ms", "generation_ms", "total_ms"]


@query("STR-2", TURN_SQL)
def turn_roll_up(spark, d):
    t = tn.roll_up(turn_events(table(spark, d, "events")))
    return t.withColumn("attempted_models", F.array_join("attempted_models", ",")).select(*TURN_COLUMNS)


@query("STR-2", TURN_SQL + " WHERE e + INTERVAL 24 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE")
def turn_roll_up_stream(spark, d):
    """Turns closed by a day of silence, longer than any pause inside them; those of the last days stay open."""
    events = Arrivals(spark, d, "events")
    rows = run(st.roll_up_stream(turn_events(events.stream), stale_ms=24 * 3600 * 1000), "turns", arrivals=events)
    return rows.withColumn("attempted_models", F.array_join("attempted_models", ",")).select(*TURN_COLUMNS)


@query("STR-3 STR-4 LED-11", "WITH " + credit.ORDERS + credit.SETTLED.replace("FROM checked", "FROM (SELECT * FROM checked)") + """
SELECT order_id, CASE WHEN status = 'pending' THEN 'expired' ELSE status END AS status, CAST(granted AS BIGINT) AS granted FROM settled""")
def order_settlement_stream(spark, d):
    """Last transition of every order; the order rows themselves open the stream."""
    arrivals = Arrivals(spark, d, "events")
    events = arrivals.stream
    u, first = F.col("user_id"), F.lit(-1).cast("bigint")
    orders = credit.orders_of(spark, d)
    checked = od.check_events(credit.order_events_of(events), orders, credit.SECRET)
    moves = checked.select("order_id", "seq", F.col("ts").cast("timestamp").alias("ts"), "event", F.col("amount").try_cast("bigint").alias("amount"),
                           F.lit(None).cast("bigint").alias("quantity"), F.lit(None).cast("bigint").alias("user_id"), "rejected")
    # The first event of a user creates the order; the state ignores later ones.
    created = events.select(u.cast("string").alias("order_id"), first.alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.lit("created").alias("event"),
                            (100 * (5 + u % 7)).cast("bigint").alias("amount"), (5 + u % 7).cast("bigint").alias("quantity"),
                            F.when(u % 10 != 3, u).alias("user_id"), F.lit(None).cast("string").alias("rejected"))
    rows = run(so.settle_stream(created.unionByName(moves), delay="0 seconds"), "orders", arrivals=arrivals)
    # Within a micro-batch an order only moves forward.
    order = [F.col("batch"), F.array_position(F.array(*[F.lit(x) for x in ("pending", "expired", "paid", "failed", "cancelled")]), F.col("status"))]
    return ordered.first_per_key(rows, ["order_id"], order, last=True).select("order_id", "status", "granted")


@query("STR-5 ANA-13", """
SELECT strftime(day, '%Y-%m-%d') AS date, count(*) AS questions, count(DISTINCT user_id) AS askers
FROM (SELECT CAST(ts + INTERVAL 9 HOUR AS DATE) AS day, user_id FROM events WHERE event_type = 'view')
WHERE day + INTERVAL 1 DAY - INTERVAL 9 HOUR <= (SELECT max(ts) FROM events WHERE event_type = 'view') - INTERVAL 1 HOUR GROUP BY day""")
def daily_activity_stream(spark, d):
    """Days that the watermark has closed, with the exact number of askers."""
    events = Arrivals(spark, d, "events")
    views = events.stream.where(F.col("event_type") == "view").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = run(activity.closed_days(views, user="user_id"), "activity", arrivals=events)
    return rows.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "questions", "askers")


@query("STR-5", """
SELECT strftime(CAST(ts + INTERVAL 9 HOUR AS DATE), '%Y-%m-%d') AS date, count(*) AS questions, count(DISTINCT user_id) AS askers, true AS estimate_is_close
FROM events WHERE event_type = 'view' GROUP BY 1""")
def running_days_stream(spark, d):
    """The stream's last row of every day, days not yet closed among them; its estimate of the askers is held against their exact number."""
    events, views = Arrivals(spark, d, "events"), F.col("event_type") == "view"
    rows = run(activity.daily_activity(events.stream.where(views).withColumn("ts", F.col("ts").cast("timestamp")), user="user_id"), "running", mode="update", arrivals=events)
    last = ordered.first_per_key(rows, ["date"], [F.col("batch")], last=True)
    exact = table(spark, d, "events").where(views).groupBy(F.to_date(F.col("ts") + F.expr("interval 9 hours")).alias("date")).agg(F.countDistinct("user_id").alias("askers"))
    close = F.abs(F.col("active_users") - F.col("askers")) <= F.greatest(F.lit(1.0), 0.1 * F.col("askers"))
    return last.join(exact, "date").select(F.date_format("date", "yyyy-MM-dd").alias("date"), "questions", "askers", close.alias("estimate_is_close"))


@query("STR-1 SNK-1", "WITH " + SEGMENTS + "SELECT CAST(doc_id AS VARCHAR) AS id, CAST(chunk_index AS BIGINT) AS chunk_index, sha256(text) AS digest FROM exploded")
def ingest_stream(spark, d):
    """Document files as they arrive -> chunks -> points; the newest version of every point."""
    def to_points(batch: DataFrame) -> DataFrame:
        chunks = qna.chunk_documents(batch.select("post_id", "text"), "text")
        return sinks.payload(chunks, ["post_id"])

    path, state = work_folder(spark, "points"), work_folder(spark, "ingest-state")
    arrivals = Arrivals(spark, d, "documents", "doc_id")
    for _ in arrivals:
        ingest.ingest(arrivals.stream.withColumnRenamed("doc_id", "post_id"), path, state, to_points).awaitTermination()
    return sinks.current_documents(spark, path, "post_id").select("id", "chunk_index", F.sha2("content", 256).alias("digest"))
