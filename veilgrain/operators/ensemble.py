"""Merging a second detector's proposals with accepted spans: agreement first, then consistency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgrain.operators.spans import agreement

TOPIC_TYPES = ("ORG", "LOCATION")
AGREEMENT_ONLY = ("date", "url", "product")


def merged(proposals: DataFrame, accepted: DataFrame, personal: DataFrame, key: str = "slot_id", request: str = "req_id") -> DataFrame:
    """`proposals` with `verdict`: covered or added for those that agree with an accepted span (added, if no
    partner covers it and all partners mask), else label, topic, shape, or pending for an adjudicator.

    proposals: (request, key, proposal_id, start, end, type, label, shape_ok); accepted: (key, start, end, action);
    personal: (request, personal) says whether the request is about a person."""
    met = agreement(proposals, accepted, key).where("agrees")
    inside = (F.col("y.start") <= F.col("x.start")) & (F.col("x.end") <= F.col("y.end"))
    partners = met.groupBy(F.col("x.proposal_id").alias("proposal_id")).agg(F.bool_or(inside).alias("inside"), F.bool_and(F.col("y.action") == "mask").alias("all_mask"))
    joined = proposals.join(partners, "proposal_id", "left").join(personal, request, "left")
    verdict = (
        F.when(F.col("all_mask").isNotNull(), F.when(~F.col("inside") & F.col("all_mask"), "added").otherwise("covered"))
        .when(F.col("label").isin(*AGREEMENT_ONLY), "label")
        .when(F.col("type").isin(*TOPIC_TYPES) & ~F.coalesce("personal", F.lit(False)), "topic")
        .when(~F.col("shape_ok"), "shape")
        .otherwise("pending")
    )
    return joined.withColumn("verdict", verdict).drop("inside", "all_mask", "personal")


def counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("verdict").agg(F.count("*").alias("n"))
