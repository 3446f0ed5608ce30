"""What leaves, hop by hop, and what a model is shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgrain.operators import spans, vault


def hops(events: DataFrame, run: str = "run_id", order: str = "step") -> DataFrame:
    """(run, order, hop, destination, decision, payload, reasons): events (run, order, destination, original, payload,
    reasons array of strings) as a run's numbered hops.  Reasons block an event, and its payload isn't kept; one that
    differs from its original was rewritten."""
    number = F.row_number().over(Window.partitionBy(run).orderBy(order))
    blocked = F.coalesce(F.size("reasons") > 0, F.lit(False))
    decision = F.when(blocked, "block").when(~F.col("payload").eqNullSafe(F.col("original")), "rewritten").otherwise("allow")
    return events.select(run, order, number.cast("long").alias("hop"), "destination", decision.alias("decision"), F.when(~blocked, F.col("payload")).alias("payload"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def masked_for_detector(slots: DataFrame, found: DataFrame, key: str = "slot_id") -> DataFrame:
    """(key, masked): texts (key, text) as a model sees them: spans of rules, chosen without overlap, are tokens of their
    type, numbered within the text, and a value has one token."""
    chosen = spans.resolve(found, key)
    numbers = vault.numbered(chosen, key, ["start"])
    return vault.masked(slots.select(key, "text"), chosen, numbers, key, key).select(key, "masked")


def terms(vault_terms: DataFrame, kind: str | None = None) -> DataFrame:
    """Declared terms (text, kind, ...) of one kind, or all of them."""
    return vault_terms if kind is None else vault_terms.where(F.col("kind") == kind)
