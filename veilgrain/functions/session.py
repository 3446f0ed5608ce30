"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver found it, if they can see that folder."""
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{ROOT}:{known}" if known else ROOT
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the tables of a data folder."""
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """A new folder for stored results: in the shared folder that the session names in spark.checkpoint.dir,
    or a temporary one where it names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='work-')}"
    return f"{base.rstrip('/')}/work-{uuid.uuid4().hex}"
