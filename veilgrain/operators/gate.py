"""The gate: no protected value and no strict pattern may be in an outbound payload."""

from __future__ import annotations

import hmac
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrain.functions import normalize as norm
from veilgrain.operators import detect, scan


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC-SHA-256 as hex, from two nested digests."""
    block = (key if len(key) <= 64 else __import__("hashlib").sha256(key).digest()).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in block)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in block)), F.unhex(inner)), 256)


def reason(code: Column, kind: Column, value: Column, key: bytes) -> Column:
    return F.concat_ws(":", code, kind, F.substring(hmac_sha256(value, key), 1, 12))


def literal_gate(payloads: DataFrame, protected: DataFrame, key: bytes, request: str = "req_id") -> DataFrame:
    """(request, decision, reasons) with case-insensitive containment inside the JVM.

    payloads: (request, payload); protected: (request, text, type, code).  Each value counts once for its
    code and identity; values under two characters don't count."""
    own = protected.withColumn("text", F.trim("text")).where(F.length("text") >= 2).withColumn("_id", F.lower("text")).dropDuplicates([request, "code", "_id"])
    met = payloads.join(own, request).where(F.contains(F.lower("payload"), F.col("_id")))
    reasons = met.groupBy(request).agg(F.array_sort(F.collect_set(reason(F.col("code"), F.col("type"), F.col("text"), key))).alias("reasons"))
    out = payloads.select(request).distinct().join(reasons, request, "left").withColumn("reasons", F.coalesce("reasons", F.expr("cast(array() as array<string>)")))
    return out.select(request, F.when(F.size("reasons") > 0, "block").otherwise("allow").alias("decision"), "reasons")


def _present(value: str, texts: list[str], blob: str, folded: str) -> bool:
    return bool(norm.term_pattern(value).search(blob) or norm.term_pattern(norm.normalize(value)).search(folded)) or any(norm.fuzzy_find(t, value) for t in texts)


def checked(payload: str, protected: list[tuple[str, str, str]], key: bytes) -> list[str]:
    """Reasons to block: protected (text, type, code) values in any variant or decoded layer, and strict
    patterns as written or in disguise."""
    import json

    try:
        strings = norm.leaves(json.loads(payload))
    except ValueError:
        strings = [payload]
    texts = strings + norm.decoded_layers(strings)
    blob, folded = "\x00".join(texts), "\x00".join(norm.normalize(t) for t in texts)
    short = lambda v: hmac.new(key, v.encode(), "sha256").hexdigest()[:12]
    reasons, seen = [], set()
    for value, kind, code in protected:
        value = value.strip()
        mark = (code, norm.normalize(value))
        if len(value) >= 2 and mark not in seen:
            seen.add(mark)
            if _present(value, texts, blob, folded):
                reasons.append(f"{code}:{kind}:{short(value)}")
    for t in texts:
        view = norm.detection_view(t).text if norm.may_hide(t) else t
        for found in [*detect.rule_spans(t, strict_only=True), *(detect.rule_spans(view, strict_only=True) if view != t else [])]:
            said = f"secret_pattern:{found[6]}:{short(found[2])}"
            if said not in reasons:
                reasons.append(said)
    return reasons


def gate(payloads: DataFrame, protected: DataFrame, key: bytes, request: str = "req_id") -> DataFrame:
    """(request, decision, reasons) with all variants, decoded layers and strict patterns.

    A payload meets its request's protected values as one array, so a row holds one request's values."""
    grouped = protected.groupBy(request).agg(F.collect_list(F.struct("text", "type", "code")).alias("_values"))
    joined = payloads.join(grouped, request, "left").select(request, "payload", "_values")
    kind = dict(payloads.dtypes)[request]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [checked(p or "", [(v["text"] or "", v["type"], v["code"]) for v in values or []], key) for p, values in zip(batch.column("payload").to_pylist(), batch.column("_values").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(request), pa.array(["block" if f else "allow" for f in found], pa.string()), pa.array(found, pa.list_(pa.string()))], [request, "decision", "reasons"]
            )

    return joined.mapInArrow(run, f"{request} {kind}, decision string, reasons array<string>")


def scrubbed(text: Column, originals: Column) -> Column:
    """A text without any of `originals` of at least two characters, in any case, with any blanks, Latin ends being
    ends of words.  One pass, the longest first at each place, so what was put in is never looked at again."""
    own = F.filter(F.transform(originals, lambda v: F.trim(v)), lambda v: F.length(v) >= 2)
    longest = F.transform(F.array_sort(F.transform(own, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))), lambda x: x["v"])
    edge = lambda v, at, mark: F.when(F.rlike(v, F.lit(at)), mark).otherwise("")
    spaced = lambda v: F.regexp_replace(scan.quoted(v), r"\s+", r"\\s+")
    each = F.transform(longest, lambda v: F.concat(edge(v, "^[A-Za-z0-9_]", "(?<![A-Za-z0-9_])"), spaced(v), edge(v, "[A-Za-z0-9_]$", "(?![A-Za-z0-9_])")))
    return F.when(F.size(own) > 0, F.regexp_replace(text, F.concat(F.lit("(?iu)(?:"), F.array_join(each, "|"), F.lit(")")), F.lit("[REDACTED]"))).otherwise(text)


def latest(audit: DataFrame, key: str = "request_id", at: str = "created_at") -> DataFrame:
    """The latest record of each request."""
    from pyspark.sql import Window

    return audit.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(at).desc()))).where("_n = 1").drop("_n")
