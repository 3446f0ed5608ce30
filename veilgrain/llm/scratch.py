"""Tables that cut lineage.

They lie in the shared folder that the session names in spark.checkpoint.dir, so that a lost
executor costs no recomputation and every executor can read them.  Only where that setting is
missing (tests on one machine) a temporary folder is used.  A session's tables are removed when
the Python process ends, those of a `step` when the step ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}
_steps: list[str] = []


def folder(spark: SparkSession) -> str:
    """This session's own folder in the shared one."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='shared-')}"
        _folders[app] = f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        if spark.sparkContext._jsc is not None:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def step(spark: SparkSession) -> Iterator[None]:
    """Tables kept inside are removed at the end, but for lasting ones."""
    _steps.append(f"{folder(spark)}/step-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        _remove(spark, _steps.pop())


def keep(df: DataFrame, lasting: bool = False) -> DataFrame:
    """Writes `df` as a table in the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{_steps[-1] if _steps and not lasting else folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
