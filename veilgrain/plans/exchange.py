"""Queries on substitution, JSON bodies, restoring and audit texts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrain.functions.session import table
from veilgrain.operators import gate, jsontext, review, spans, substitution

Spark, Frame = SparkSession, DataFrame
VALUE = r"\b[A-Z][a-z]{4,}"


def span_array(text: Column) -> Column:
    """Capitalised words as spans: of a person or an organization by their length, and each fifth length generalized."""
    found = spans.matches(text, VALUE)
    n = lambda s: F.length(s["text"])
    return F.transform(
        found,
        lambda s: F.struct(
            s["text"].alias("text"),
            F.when(n(s) % 2 == 0, "PERSON").otherwise("ORG").alias("type"),
            F.when(n(s) % 5 == 0, "generalize").otherwise("mask").alias("action"),
            F.lit("rule").alias("source"),
            F.lit("x").alias("rule"),
            F.when(n(s) % 10 == 0, F.concat(F.lit("an "), s["text"])).otherwise("a person").alias("replacement"),
            s["start"].alias("start"),
            s["end"].alias("end"),
        ),
    )


def applied_turns_full(spark: Spark, d: str) -> Frame:
    turns = table(spark, d, "conversations").withColumn("slot_no", F.lit(0))
    own = turns.select("conv_id", "turn", "slot_no", F.explode(span_array(F.col("text"))).alias("s")).select("conv_id", "turn", "slot_no", "s.*")
    return substitution.applied(turns, own)


def applied_turns(spark: Spark, d: str) -> Frame:
    """Turns with their values substituted, in order; a replacement that holds its original is refused and masked."""
    return applied_turns_full(spark, d).select("conv_id", "turn", "text", F.size("mapped").alias("mapped"), "refused")


def _bodies(spark: Spark, d: str) -> Frame:
    """Requests of two levels, with escapes: (conv_id, turn, body)."""
    escaped = F.regexp_replace(F.to_json(F.struct("role", F.col("text").alias("content"), F.array(F.struct(F.col("turn").alias("n"), F.lit("a/b~c").alias("a/b"))).alias("x"))), "a", r"\\u0061")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text", F.concat(F.lit('{ "model":"m",  "messages" : ['), F.translate(escaped, "\u0001", ""), F.lit("]\n}")).alias("body"))


def body_leaves(spark: Spark, d: str) -> Frame:
    """Strings, keys and numbers of request bodies, with their paths; a place is right if it parses to the value."""
    bodies = _bodies(spark, d)
    found = jsontext.leaves(bodies, "body", "conv_id", "turn", "body").where("kind in ('string', 'number')")
    raw = F.substring("body", F.col("start") + 1, F.col("end") - F.col("start"))
    same = F.when(F.col("kind") == "string", F.from_json(F.concat(F.lit('{"v":'), raw, F.lit("}")), "v string")["v"]).otherwise(raw) == F.col("value")
    return found.select("conv_id", "turn", "path", "kind", "value", same.alias("placed"))


def readable_bodies(spark: Spark, d: str) -> Frame:
    return jsontext.readable(_bodies(spark, d), "body", "conv_id", "turn")


def canonical_bodies(spark: Spark, d: str) -> Frame:
    """Bodies written in other ways have one form, and one hash."""
    return jsontext.canonical(_bodies(spark, d), "body", "conv_id", "turn")


def restored_bodies(spark: Spark, d: str) -> Frame:
    """A model's answers, as JSON, that repeat masked turns: contents and arguments of calls get the originals back."""
    done = applied_turns_full(spark, d)
    known = done.select("conv_id", F.explode("mapped").alias("m")).select("conv_id", "m.*")
    call = F.struct(F.struct(F.lit("<PERSON_1>").alias("name"), F.to_json(F.struct(F.col("text").alias("q"))).alias("arguments")).alias("function"))
    message = F.struct(F.concat(F.lit("\n"), "text").alias("content"), F.lit("hm").alias("reasoning"), F.array(call).alias("tool_calls"))
    answers = done.select("conv_id", "turn", F.to_json(F.struct(F.lit("<PERSON_1>").alias("id"), F.array(F.struct(message.alias("message"))).alias("choices"))).alias("body"))
    out = jsontext.restored(answers, known, "conv_id", "body", "turn", kind="response").select("conv_id", "turn", F.try_parse_json("body").alias("b"))
    get = lambda p: F.try_variant_get("b", p, "string")
    return out.select(
        "conv_id", "turn", get("$.id").alias("id"), get("$.choices[0].message.content").alias("content"), get("$.choices[0].message.tool_calls[0].function.name").alias("name"),
        F.from_json(get("$.choices[0].message.tool_calls[0].function.arguments"), "q string")["q"].alias("q"), get("$.choices[0].message.reasoning").alias("reasoning"),
    )


def scrubbed_turns(spark: Spark, d: str) -> Frame:
    """Assistant turns without the capitalised words of their conversation's first turn, some of them parts of others."""
    turns = table(spark, d, "conversations")
    first = turns.where("turn = 0").select("conv_id", F.expr(r"array_distinct(flatten(transform(regexp_extract_all(text, '([A-Z][a-z]{3,}) ([a-z]{2,})', 0), v -> array(v, split(v, ' ')[0]))))").alias("originals"))
    said = turns.where("role = 'assistant'").join(first, "conv_id")
    return said.select("conv_id", "turn", gate.scrubbed(F.col("text"), F.col("originals")).alias("text"))


def review_proposals(spark: Spark, d: str) -> Frame:
    """What reviews of turns would show: each value once, with its replacement, sources and confidence."""
    turns = table(spark, d, "conversations").withColumn("slot_no", F.lit(0))
    own = turns.select("conv_id", "turn", "slot_no", F.explode(span_array(F.col("text"))).alias("s")).select("conv_id", "turn", "slot_no", "s.*")
    beside = own.where("length(text) % 3 = 0").withColumns({"source": F.lit("llm"), "end": F.col("start") + 4, "text": F.substring("text", 1, 4)})
    every = own.unionByName(beside)
    done = substitution.applied(turns, every)
    out = review.proposed(done, turns, every, ["none"])
    return out.select("conv_id", "turn", "span_no", "type", "action", "text", "replacement", F.array_join("sources", ",").alias("sources"), "confidence", "locked")


def restored_surrogates(spark: Spark, d: str) -> Frame:
    """Turns whose names are surrogates, as far as those collide with nothing, and else placeholders: what is shown, and
    what comes back when it is restored."""
    turns = table(spark, d, "conversations").withColumn("slot_no", F.lit(0))
    own = turns.select("conv_id", "turn", "slot_no", F.explode(span_array(F.col("text"))).alias("s")).select("conv_id", "turn", "slot_no", "s.*").withColumn("action", F.lit("mask"))
    done = substitution.applied(turns, own, options=substitution.Options(surrogate_key=b"a key"))
    known = done.select("conv_id", F.explode("mapped").alias("m")).select("conv_id", "m.*")
    kept = lambda p: F.contains("text", p["original"]) | (F.substring("text", p["out_start"] + 1, p["out_end"] - p["out_start"]) != p["shown"])
    hidden = done.select("conv_id", "turn", (~F.exists("places", kept)).alias("hidden"))
    back = jsontext.restored(done.select("conv_id", "turn", "text"), known, "conv_id", "text", "turn")
    return back.join(hidden, ["conv_id", "turn"])


QUERIES = (restored_surrogates, review_proposals, applied_turns, body_leaves, readable_bodies, canonical_bodies, restored_bodies, scrubbed_turns)

#: (conv_id, turn, i, piece, w, start, full_text, ...): a turn's text in pieces, each with the value that follows it.
PIECES = rf"""SELECT conv_id, turn, full_text, i, p[i + 1] AS piece, m[i + 1] AS w, (coalesce(list_sum(list_transform(p[1:i + 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0))::INT AS start
  FROM (SELECT conv_id, turn, full_text, p, m, unnest(range(0, len(p))) AS i FROM (SELECT conv_id, turn, text AS full_text, regexp_split_to_array(text, '{VALUE}') AS p, regexp_extract_all(text, '{VALUE}') AS m FROM conversations))"""
_FIRSTS = f"""SELECT conv_id, lower(w) AS norm, turn, start, length(w) % 2 = 0 AS person, length(w) % 5 = 0 AND length(w) % 10 <> 0 AS general, length(w) % 10 = 0 AS refused FROM ({PIECES}) WHERE w IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, lower(w) ORDER BY turn, start) = 1"""
_SHOWN = f"""SELECT *, CASE WHEN general THEN 'a person' ELSE '<' || CASE WHEN person THEN 'PERSON' ELSE 'ORG' END || '_' || row_number() OVER (PARTITION BY conv_id, person, general ORDER BY turn, start) || '>' END AS shown FROM ({_FIRSTS})"""
WALK = f"SELECT s.*, v.shown, v.general, v.refused, v.turn = s.turn AND v.start = s.start AS fresh FROM ({PIECES}) s LEFT JOIN ({_SHOWN}) v ON v.conv_id = s.conv_id AND v.norm = lower(s.w)"
_DETERMINED = "regexp_matches(substr(full_text, 1, start), '(?i)(?:\\b(?:the|our|my|their|his|her|its|your|this|that)|[''’]s)\\s+$')"
_PUT = f"CASE WHEN general AND {_DETERMINED} THEN 'person' ELSE coalesce(shown, '') END"
#: What a restored text is: generalized values stay as they are, all others are back.
RESTORED = f"SELECT conv_id, turn, any_value(full_text) AS full_text, string_agg(piece || CASE WHEN general THEN {_PUT} ELSE coalesce(w, '') END, '' ORDER BY i) AS back FROM ({WALK}) GROUP BY conv_id, turn"
_PLAIN = "'{\"role\":\"' || role || '\",\"content\":' || to_json(text)::VARCHAR || ',\"x\":[{\"n\":' || turn || ',\"a/b\":\"a/b~c\"}]}'"
_SORTED = "'{\"messages\":[{\"content\":' || to_json(text)::VARCHAR || ',\"role\":\"' || role || '\",\"x\":[{\"a/b\":\"a/b~c\",\"n\":' || turn || '}]}],\"model\":\"m\"}'"

SQL = {
    "restored_surrogates": "SELECT conv_id, turn, text, true AS hidden FROM conversations",
    "review_proposals": f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, lower(w) ORDER BY start) AS k FROM ({WALK}) WHERE w IS NOT NULL)
      SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY start)::INT AS span_no, type, CASE WHEN general THEN 'generalize' ELSE 'mask' END AS action, w AS text, {_PUT} AS replacement, CASE WHEN length(w) % 3 = 0 THEN 'llm,rule' ELSE 'rule' END AS sources,
        CASE WHEN length(w) % 3 = 0 THEN 0.85::DOUBLE ELSE 0.6::DOUBLE END AS confidence, false AS locked FROM (SELECT *, CASE WHEN length(w) % 2 = 0 THEN 'PERSON' ELSE 'ORG' END AS type FROM f WHERE k = 1)""",
    "applied_turns": f"SELECT conv_id, turn, string_agg(piece || {_PUT}, '' ORDER BY i) AS text, count(*) FILTER (WHERE fresh)::INT AS mapped, count(*) FILTER (WHERE fresh AND refused)::INT AS refused FROM ({WALK}) GROUP BY conv_id, turn",
    "body_leaves": """SELECT conv_id, turn, '/model' AS path, 'string' AS kind, 'm' AS value, true AS placed FROM conversations UNION ALL SELECT conv_id, turn, '/messages/0/role', 'string', role, true FROM conversations UNION ALL SELECT conv_id, turn, '/messages/0/content', 'string', text, true FROM conversations
      UNION ALL SELECT conv_id, turn, '/messages/0/x/0/n', 'number', turn::VARCHAR, true FROM conversations UNION ALL SELECT conv_id, turn, '/messages/0/x/0/a~1b', 'string', 'a/b~c', true FROM conversations""",
    "readable_bodies": f"SELECT conv_id, turn, '{{ \"model\":\"m\",  \"messages\" : [' || {_PLAIN} || ']' || chr(10) || '}}' AS body FROM conversations",
    "canonical_bodies": f"SELECT conv_id, turn, {_SORTED} AS canonical, sha256({_SORTED}) AS hash FROM conversations",
    "restored_bodies": f"SELECT conv_id, turn, '<PERSON_1>' AS id, ltrim(back, chr(10) || chr(9) || chr(13) || ' ') AS content, '<PERSON_1>' AS name, back AS q, NULL::VARCHAR AS reasoning FROM ({RESTORED})",
    "scrubbed_turns": r"""WITH o AS (SELECT conv_id, unnest(regexp_extract_all(text, '([A-Z][a-z]{3,}) ([a-z]{2,})')) AS v FROM conversations WHERE turn = 0),
      a AS (SELECT conv_id, '(?i)\b(' || string_agg(v, '|' ORDER BY length(v) DESC, v) || ')\b' AS p FROM (SELECT conv_id, replace(v, ' ', '\s+') AS v FROM o UNION SELECT conv_id, split_part(v, ' ', 1) FROM o) GROUP BY conv_id)
      SELECT c.conv_id, turn, CASE WHEN p IS NULL THEN text ELSE regexp_replace(text, p, '[REDACTED]', 'g') END AS text FROM conversations c LEFT JOIN a ON a.conv_id = c.conv_id WHERE role = 'assistant' AND c.conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0)""",
}
