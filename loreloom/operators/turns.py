"""Typed events of answer turns -> one row per turn.

Every field is a first, a last or a flag, so a turn of any length combines on the map side; only its
distinct model names are listed. Events: ``turn_id, seq, ts, event_type, payload`` (JSON).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.functions import text as tx

MESSAGE_CHARS = 1_000
FIELDS = (
    "turn_id string, status string, resolved_model string, resolved_model_id string, attempted_models array<string>, "
    "rewritten_query string, competition string, source_ids array<string>, retrieval_status string, error_provider string, "
    "error_code string, error_message string, finish_reason string, input_tokens bigint, output_tokens bigint, "
    "thinking_tokens bigint, retrieval_ms bigint, rerank_ms bigint, first_token_ms bigint, generation_ms bigint, total_ms bigint"
)


# Every field an object payload can carry, parsed once per event.
_REASON = "provider string, code string, message string"
PAYLOAD = (
    f"{_REASON}, resolved_model string, resolved_model_id string, input_tokens bigint, output_tokens bigint, "
    "thinking_tokens bigint, finish_reason string, status string, retrieval_ms bigint, rerank_ms bigint, "
    f"competition string, `from` string, `to` string, reason struct<{_REASON.replace(' string', ':string')}>"
)


def _parsed(events: DataFrame) -> DataFrame:
    is_object = F.col("payload").startswith("{")
    return events.withColumn("p", F.from_json(F.when(is_object, F.col("payload")), PAYLOAD))


def _json(name: str) -> Column:
    return F.col(f"p.{name}")


# How the contributions of a turn's events combine: the least or the greatest of each, by value or by its leading seq.
LEAST, GREATEST = ("start", "first_token"), (
    "done", "end", "generation", "fallback", "error", "model", "model_id", "usage", "rewrite", "retrieval", "competition", "sources", "problem")


def contributions(events: DataFrame) -> DataFrame:
    """What each event may add to its turn: the columns of LEAST and GREATEST, NULL where it adds nothing, and ``places``.

    Combining is associative and knows no order of arrival, so the batch aggregation and the stream's state share it.
    """
    kind, seq, at = F.col("event_type"), F.col("seq"), F.unix_micros("ts")
    is_object = F.col("payload").startswith("{")
    text = F.when(F.col("payload").startswith('"'), F.from_json(F.concat(F.lit('{"v":'), F.col("payload"), F.lit("}")), "v string")["v"])

    def given(c: Column) -> Column:
        return tx.non_empty(c)

    def noted(when: Column, **values: Column) -> Column:
        return F.when(when, F.struct(seq.alias("seq"), *[v.alias(k) for k, v in values.items()]))

    model_like = kind.isin("model", "usage") & is_object
    error, fallback = kind == "error", (kind == "fallback") & is_object
    usage, retrieval = (kind == "usage") & is_object, (kind == "retrieval") & is_object
    sources = F.when(kind == "sources", F.from_json("payload", "array<struct<source_key:string>>"))
    kept_sources = F.filter(F.transform(sources, lambda x: x["source_key"]), lambda x: x != "")
    provider = F.when(error, F.coalesce(given(_json("provider")), F.lit("application"))).otherwise(
        F.coalesce(given(_json("reason.provider")), F.lit("model")))
    code = F.when(error, F.coalesce(given(_json("code")), F.lit("stream_error"))).otherwise(
        F.coalesce(given(_json("reason.code")), F.lit("fallback")))
    message = F.when(error, F.coalesce(given(_json("message")), given(text), given(F.when(~is_object, F.col("payload"))), F.lit("unknown error"))).otherwise(
        F.coalesce(given(_json("reason.message")), F.lit("primary model failed; fallback used")))
    model, model_id, competition = given(_json("resolved_model")), given(_json("resolved_model_id")), given(_json("competition"))
    return _parsed(events).select(
        "turn_id", "ts", named_places().alias("places"), (kind == "done").cast("int").alias("done"), at.alias("start"), at.alias("end"),
        F.when((kind == "token") & text.isNotNull(), at).alias("first_token"), F.when(retrieval, at).alias("generation"),
        F.when(fallback, seq).alias("fallback"), F.when(error, seq).alias("error"),
        noted(model_like & model.isNotNull(), v=model).alias("model"), noted(model_like & model_id.isNotNull(), v=model_id).alias("model_id"),
        noted(usage, **{n: _json(n).cast("bigint") for n in ("input_tokens", "output_tokens", "thinking_tokens")}, finish_reason=_json("finish_reason")).alias("usage"),
        noted((kind == "rewrite") & text.isNotNull(), v=text).alias("rewrite"),
        noted(retrieval, status=F.coalesce(given(_json("status")), F.lit("unknown")), retrieval_ms=_json("retrieval_ms"), rerank_ms=_json("rerank_ms")).alias("retrieval"),
        noted(retrieval & competition.isNotNull(), v=competition).alias("competition"),
        noted(sources.isNotNull(), v=kept_sources).alias("sources"),
        noted(error | fallback, provider=provider, code=code, message=tx.cut(message, MESSAGE_CHARS)).alias("problem"))


def finished(turns: DataFrame) -> DataFrame:
    """One row per turn from its combined contributions and its ``attempted_models``."""
    def ms(end: str, start: str) -> Column:
        return F.bround((F.col(end) - F.col(start)) / 1000).cast("bigint")

    failed, spoke, fell = F.col("error").isNotNull(), F.col("first_token").isNotNull(), F.col("fallback").isNotNull()
    status = F.when(failed & spoke, "partial_error").when(failed, "error").when(fell, "success_fallback").otherwise("success")
    # A fallback clears the model; only what was named after the last one counts.
    after = F.coalesce("fallback", F.lit(-1).cast("bigint"))
    return turns.select(
        "turn_id", status.alias("status"), F.when(F.col("model.seq") > after, F.col("model.v")).alias("resolved_model"),
        F.when(F.col("model_id.seq") > after, F.col("model_id.v")).alias("resolved_model_id"), "attempted_models", F.col("rewrite.v").alias("rewritten_query"),
        F.col("competition.v").alias("competition"), F.col("sources.v").alias("source_ids"),
        F.coalesce("retrieval.status", F.lit("pending")).alias("retrieval_status"), F.col("problem.provider").alias("error_provider"),
        F.col("problem.code").alias("error_code"), F.col("problem.message").alias("error_message"), "usage.finish_reason", "usage.input_tokens",
        "usage.output_tokens", "usage.thinking_tokens", "retrieval.retrieval_ms", "retrieval.rerank_ms", ms("first_token", "start").alias("first_token_ms"),
        ms("end", "generation").alias("generation_ms"), ms("end", "start").alias("total_ms"))


def roll_up(events: DataFrame) -> DataFrame:
    combined = contributions(events).groupBy("turn_id").agg(*[F.min(c).alias(c) for c in LEAST], *[F.max(c).alias(c) for c in GREATEST])
    return finished(combined.join(attempted_models(events), "turn_id", "left"))


def named_places() -> Column:
    """{model: place of its first mention} of a parsed event; a place is the event's seq, then the order inside it."""
    by_kind = F.when(F.col("event_type") == "model", F.array(_json("resolved_model"))).when(F.col("event_type") == "fallback", F.array(_json("from"), _json("to")))
    named = F.filter(F.transform(F.coalesce(by_kind, F.array().cast("array<string>")), lambda m, i: F.struct(m.alias("m"), (F.col("seq") * 2 + i).alias("place"))),
                     lambda x: F.coalesce(x["m"], F.lit("")) != "")
    first = F.filter(named, lambda x: ~F.exists(named, lambda y: (y["m"] == x["m"]) & (y["place"] < x["place"])))
    return F.map_from_entries(first)


def attempted_models(events: DataFrame) -> DataFrame:
    """Distinct model names of a turn in the order of their first mention."""
    named = _parsed(events.where(F.col("event_type").isin("model", "fallback") & F.col("payload").startswith("{")))
    rows = named.select("turn_id", F.explode(named_places()).alias("model", "place"))
    first = rows.groupBy("turn_id", "model").agg(F.min("place").alias("place"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "model")))
    return first.groupBy("turn_id").agg(F.transform(ordered, lambda x: x["model"]).alias("attempted_models"))
