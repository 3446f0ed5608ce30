"""What a person reviews before a request goes out, and what their decisions change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgrain.operators.spans import BASE_CONFIDENCE, overlaps
from veilgrain.operators.vault import identity

MODELS = ("llm", "gliner")
DETERMINISTIC = ("vault", "user", "regex", "entropy", "rule")


def decided(spans: DataFrame, rejected: DataFrame, added: DataFrame, key: str = "slot_id") -> DataFrame:
    """`spans` without those whose value the user rejected, in any case or spacing, and with those that the user
    added as source `user`.  spans and added: (key, text, ...); rejected: (key, text)."""
    gone = rejected.select(key, identity(F.col("text")).alias("_norm")).distinct()
    left = spans.withColumn("_norm", identity(F.col("text"))).join(gone, [key, "_norm"], "left_anti").drop("_norm")
    return left.unionByName(added.withColumn("source", F.lit("user")).select(*left.columns))


def within_declared(spans: DataFrame, key: str = "slot_id") -> DataFrame:
    """`spans` without a model's span that strictly holds a declared term's place: the term is masked by itself."""
    declared = spans.where("source = 'vault'").select(key, F.col("start").alias("_s"), F.col("end").alias("_e"))
    model = ~F.col("source").isin(*DETERMINISTIC) & (F.col("action") != "keep")
    holds = (F.col(f"x.{key}") == F.col(f"y.{key}")) & model & (F.col("x.start") <= F.col("_s")) & (F.col("_e") <= F.col("x.end")) & (F.col("x.end") - F.col("x.start") > F.col("_e") - F.col("_s"))
    return spans.alias("x").join(declared.alias("y"), holds, "left_anti")


def is_json_key(text: Column, start: Column, end: Column) -> Column:
    """A place in JSON text is an object's key, so schema: quoted, with a colon after and `{` or `,` before, whatever
    blanks are between."""
    quoted = F.substring(text, start, F.lit(1)) == '"'
    after = F.ltrim(F.translate(F.substring(text, end + 2, F.length(text)), "\n\r\t", "   "))
    before = F.rtrim(F.translate(F.substring(text, F.lit(1), start - 1), "\n\r\t", "   "))
    return (start > 0) & quoted & (F.substring(text, end + 1, F.lit(1)) == '"') & F.startswith(after, F.lit(":")) & ((before == "") | F.rlike(before, F.lit(r"[{,]$")))


def snippet(text: Column, start: Column, end: Column, context: int = 24) -> Column:
    """A place with `context` characters on either side, and marks where more follows."""
    left, right = F.greatest(start - context, F.lit(0)), F.least(end + context, F.length(text))
    return F.concat(F.when(left > 0, "…").otherwise(""), F.substring(text, left + 1, right - left), F.when(right < F.length(text), "…").otherwise(""))


def proposals(slots: DataFrame, spans: DataFrame, strict_rules: list[str], key: str = "slot_id") -> DataFrame:
    """(key, span_no, norm, text, type, source, preview, locked): the review list of each slot, one row for each value,
    at its first place; locked if it was declared or a strict rule found it."""
    first = Window.partitionBy(key, "norm").orderBy("start", "end", "source")
    own = spans.withColumn("norm", identity(F.col("text"))).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    number = F.row_number().over(Window.partitionBy(key).orderBy("start", "end", "norm"))
    own = own.withColumn("span_no", number).join(slots.select(key, F.col("text").alias("_text")), key)
    locked = (F.col("source") == "vault") | F.coalesce(F.col("rule").isin(*strict_rules), F.lit(False))
    return own.select(key, "span_no", "norm", "text", "type", "source", snippet(F.col("_text"), F.col("start"), F.col("end")).alias("preview"), locked.alias("locked"))


def proposed(done: DataFrame, slots: DataFrame, spans: DataFrame, strict_rules: list[str], conversation: str = "conv_id", request: str = "turn", slot: str = "slot_no") -> DataFrame:
    """(conversation, request, span_no, type, action, text, replacement, preview_before, preview_after, source, sources,
    confidence, locked): what a user is asked about before a request is sent, a row for each value at its first
    place.  `done` is what `substitution.applied` gave for the slots and spans, without storing its mappings."""
    keys = [conversation, request, slot]
    held = spans.where("start is not null").groupBy(*keys).agg(F.collect_set(F.struct("start", "end", "source")).alias("_spans"))
    # A slot's texts stay in its row: what is shown of them is cut out there, and only that goes on.
    rows = done.select(*keys, F.col("text").alias("_out"), "places").join(slots.select(*keys, F.col("text").alias("_text")), keys).join(held, keys, "left")
    each = rows.select(*keys, "_text", "_out", "_spans", F.explode("places").alias("p"))
    met = F.array_distinct(F.array_compact(F.transform(F.filter(F.coalesce("_spans", F.array().cast(dict(held.dtypes)["_spans"])), lambda s: overlaps(s, F.col("p"))), lambda s: s["source"])))
    shown = (snippet(F.col("_text"), F.col("p.start"), F.col("p.end")).alias("preview_before"), snippet(F.col("_out"), F.col("p.out_start"), F.col("p.out_end")).alias("preview_after"))
    each = each.select(*keys, identity(F.col("p.original")).alias("norm"), "p", met.alias("_sources"), *shown)
    order = Window.partitionBy(conversation, request, "norm").orderBy(slot, "p.start")
    sources = each.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    every = F.array_sort(F.array_distinct(F.concat("_sources", F.array("p.source"))))
    strict = F.coalesce(F.col("p.rule").isin(*strict_rules), F.lit(False))
    base = F.coalesce(F.create_map(*[F.lit(v) for kv in BASE_CONFIDENCE.items() for v in kv])[F.col("p.source")], F.lit(0.5))
    confidence = F.when(strict, 0.99).when(F.size(every) > 1, F.round(F.least(base + 0.25, F.lit(0.95)), 2)).otherwise(base)
    number = F.row_number().over(Window.partitionBy(conversation, request).orderBy(slot, "p.start"))
    return sources.select(
        conversation, request, number.alias("span_no"), "p.type", "p.action", F.col("p.original").alias("text"), F.col("p.shown").alias("replacement"),
        "preview_before", "preview_after", "p.source", every.alias("sources"), confidence.alias("confidence"), ((F.col("p.source") == "vault") | strict).alias("locked"),
    )


def triggers(spans: DataFrame, key: str = "slot_id", request: str = "req_id") -> DataFrame:
    """(request, reasons): why a review would stop a request: a span that only a model found, discarded proposals,
    or spans with a semantic cue.  spans: (request, key, start, end, source, type, discarded)."""
    x, y = spans.where(F.col("source").isin(*MODELS)).alias("x"), spans.where(~F.col("source").isin(*MODELS)).alias("y")
    alone = x.join(y, (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.start") < F.col("y.end")) & (F.col("y.start") < F.col("x.end")), "left_anti")
    lonely = alone.select(request).distinct().withColumn("_alone", F.lit(True))
    cue = (F.col("source") == "rule") & F.col("type").isin("QUASI_IDENTIFIER", "HEALTH")
    flags = spans.groupBy(request).agg(F.bool_or("discarded").alias("_gone"), F.bool_or(cue).alias("_cue")).join(lonely, request, "left")
    said = F.array(F.when(F.col("_alone"), "llm_only_spans"), F.when(F.col("_gone"), "discarded_spans"), F.when(F.col("_cue"), "semantic_cues"))
    return flags.select(request, F.array_join(F.filter(said, lambda s: s.isNotNull()), ",").alias("reasons"))


def counters(stats: DataFrame, *keys: str, ensemble: tuple[str, ...] = ()) -> DataFrame:
    """Counters added up column by column; those of an ensemble that never ran are null."""
    names = [c for c in stats.columns if c not in keys]
    sums = stats.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in names])
    ran = F.lit(False)
    for c in ensemble:
        ran = ran | (F.col(c) > 0)
    return sums.select(*keys, *[F.when(ran, F.col(c)).alias(c) if c in ensemble else F.col(c) for c in names])
