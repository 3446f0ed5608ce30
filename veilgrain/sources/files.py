"""Sources and sinks: case files, document folders, result folders, vault tables, the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CASES = (
    "id string, lang string, category string, task string, messages array<struct<role string, content string>>, query string, context string, "
    "vault_terms array<string>, canaries array<string>, must_not_leak array<string>, must_keep array<string>, quasi_group array<array<string>>, quasi_k int"
)
RECORDS = (
    "case_id string, pass int, status string, http_status int, request_id string, client_ms double, answer string, block_reasons array<string>, "
    "audit struct<outbound: array<struct<destination: string, payload: string>>, detections: array<struct<text_sha256: string, type: string, action: string, source: string>>, "
    "gate: struct<decision: string, reasons: array<string>>, timings_ms: map<string, double>, meta: map<string, string>>"
)
SCENARIO_KEYS = ("id", "lang", "topic", "question", "private_facts", "fact_classes", "answer_rubric", "docs")


def cases(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """Cases of JSON-lines files, and a digest of the files: SHA-256 over each one's name and the SHA-256 of
    its bytes, in order of names.  A path without files is an error."""
    files = spark.read.format("binaryFile").load(path)
    each = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha"))
    row = each.agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "name", "sha"))), "\n"), 256).alias("digest")).first()
    if not row.n:
        raise FileNotFoundError(path)
    return spark.read.schema(CASES).json(path), row.digest


def records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORDS).json(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def documents(spark: SparkSession, path: str, most: int = 50) -> DataFrame:
    """(doc_id, name, title, text) of the .md and .txt files under a folder, by name, `most` at most: ids are
    neutral, a title is the first line with text, without leading #, cut to 120 characters."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_path").alias("at"))
    title = F.substring(F.trim(F.regexp_replace(F.regexp_extract("text", r"(?m)^\s*(\S.*)$", 1), r"^#+\s*", "")), 1, 120)
    numbered = raw.orderBy("name", "at").limit(most).withColumn("n", F.row_number().over(Window.orderBy("name", "at")))
    return numbered.select(F.concat(F.lit("doc-"), F.col("n").cast("string")).alias("doc_id"), "name", title.alias("title"), "text")


def results(spark: SparkSession, path: str, first: list[str]) -> DataFrame:
    """Summaries found under a folder, with their folder's name: those named in `first` in that order, then
    the others by name."""
    df = spark.read.option("multiLine", True).json(f"{path}/*/summary.json").withColumn("run", F.element_at(F.split(F.input_file_name(), "/"), -2))
    place = F.array_position(F.array(*map(F.lit, first)), F.col("run")) if first else F.lit(0)
    return df.withColumn("place", F.row_number().over(Window.orderBy(F.when(place > 0, place).otherwise(1 << 30), "run")))


def append_audit(df: DataFrame, path: str) -> None:
    """Audit records, partitioned by day; reading takes the latest of each request."""
    df.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    w = Window.partitionBy("request_id").orderBy(F.col("created_at").desc())
    return spark.read.parquet(path).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "day")


def scenario_faults(scenarios: DataFrame) -> DataFrame:
    """(id, fault) of agent scenarios: a private fact that is in no document, or that the question gives away, or
    without a class."""
    fact = scenarios.select("id", "lang", "question", "fact_classes", F.array_join(F.transform("docs", lambda x: x["text"]), "\n").alias("all"), F.explode("private_facts").alias("fact"))
    checks = F.array(
        F.when(~F.col("lang").isin("ko", "en"), "language"),
        F.when(~F.contains("all", F.col("fact")), "fact not in the documents"),
        F.when(F.contains("question", F.col("fact")), "fact in the question"),
        F.when(F.try_element_at("fact_classes", F.col("fact")).isNull(), "fact without a class"),
    )
    return fact.select("id", F.explode(F.array_compact(checks)).alias("fault")).distinct()
