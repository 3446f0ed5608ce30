"""Queries that run streams over a table, to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.functions.session import importable, table, work_folder
from veilgrain.operators import spans, substitution, vault
from veilgrain.plans import exchange, text
from veilgrain.plans.analytics import SQL as ANALYTICS
from veilgrain.streaming import state, stores


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    return importable(spark).readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}.parque*")  # a pattern: a stream takes a folder or a pattern, no single file


def stream_vault(spark: SparkSession, d: str) -> DataFrame:
    found = spans.literal_spans(_stream(spark, d, "conversations"), "text", r"\b[A-Z][a-z]{4,}", "conv_id", "turn")
    values = found.select("conv_id", "turn", "start", vault.identity(F.col("text")).alias("norm"), F.when(F.length("text") % 2 == 0, "PERSON").otherwise("ORG").alias("type"))
    return state.run_available(stores.numbered(values), work_folder(spark))


def stream_limiter(spark: SparkSession, d: str) -> DataFrame:
    events = _stream(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return state.run_available(stores.admitted(events, "user_id", "ts", "event_id", 2, 43200), work_folder(spark))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts by event type; the last windows stay open, as no later event closes them."""
    events = _stream(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = state.run_available(state.windowed(events, "at", "event_type"), work_folder(spark))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_applied(spark: SparkSession, d: str) -> DataFrame:
    """`applied_turns` as a stream: a conversation's mappings are in the state."""
    turns = _stream(spark, d, "conversations").withColumns({"slot_no": F.lit(0), "in_json": F.lit(False), "rejected": F.lit(None).cast("array<string>")})
    slots = turns.select("conv_id", "turn", "slot_no", "text", "in_json", "rejected", exchange.span_array(F.col("text")).cast(substitution.SPANS).alias("spans"))
    out = state.run_available(stores.applied(slots), work_folder(spark))
    return out.select("conv_id", "turn", "text", F.size("mapped").alias("mapped"), "refused")


def stream_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Events as reviews of their users: they open, and are used once within twelve hours, or expire."""
    events = _stream(spark, d, "events").select(F.col("user_id").cast("string").alias("review_id"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_id") % 3 == 0, "open").otherwise("use").alias("kind"))
    out = state.run_available(stores.reviews(events, 43200), work_folder(spark))
    return out.select("review_id", F.unix_millis("at").alias("at_ms"), "outcome")


def stream_restored(spark: SparkSession, d: str) -> DataFrame:
    """Substituted turns, cut into chunks of eleven characters, restored across the cuts."""
    found = exchange.applied_turns_full(spark, d)
    known = found.select("conv_id", F.explode("mapped").alias("m")).where("m.action = 'mask'").groupBy("conv_id").agg(F.collect_list("m").alias("mappings"))
    n = F.ceil(F.length("text") / 11).cast("int")
    cut = found.join(known, "conv_id", "left").where("text <> ''").select(F.concat_ws("-", "conv_id", "turn").alias("stream_id"), F.col("text").alias("_t"), n.alias("_n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"), "mappings")
    chunks = cut.select("stream_id", F.col("i").cast("long").alias("chunk_no"), F.substring("_t", F.col("i") * 11 + 1, F.lit(11)).alias("text"), (F.col("i") == F.col("_n") - 1).alias("last"), F.when(F.col("i") == 0, F.col("mappings")).alias("mappings"))
    where = work_folder(spark)
    chunks.write.parquet(f"{where}/chunks")
    stream = importable(spark).readStream.schema(chunks.schema).parquet(f"{where}/chunks")
    out = state.run_available(stores.restored(stream), where)
    whole = out.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))), lambda c: c["text"]), "").alias("text"))
    return whole.select("stream_id", "text")


QUERIES = (stream_vault, stream_limiter, stream_windows, stream_applied, stream_reviews, stream_restored)
SQL = {
    "stream_vault": text.SQL["vault_numbers"],
    "stream_limiter": f"SELECT user_id, event_id, admitted FROM ({ANALYTICS['limiter_replay']})",
    "stream_applied": exchange.SQL["applied_turns"],
    "stream_reviews": """WITH e AS (SELECT user_id::VARCHAR AS review_id, epoch_us(ts) // 1000 AS t, event_id % 3 = 0 AS op FROM events),
      w AS (SELECT *, lag(op) OVER o AS before, t - lag(t) OVER o AS since, lead(t) OVER o - t AS until, max(t) OVER () AS latest FROM e WINDOW o AS (PARTITION BY review_id ORDER BY t))
      SELECT review_id, t AS at_ms, CASE WHEN op THEN 'held' WHEN before AND since < 43200000 THEN 'used' ELSE 'unknown' END AS outcome FROM w
      UNION ALL SELECT review_id, t + 43200000, 'expired' FROM w WHERE op AND (until >= 43200000 OR (until IS NULL AND t + 43200000 <= latest))""",
    "stream_restored": f"SELECT conv_id || '-' || turn AS stream_id, back AS text FROM ({exchange.RESTORED}) WHERE full_text <> ''",
}
