"""What the jobs share: their config, tables that may not be there yet, and settings that are put back."""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

log = logging.getLogger("isohyet.jobs")


def config(path: str | Path, **more) -> dict:
    """A job's JSON config, with the values that the command line gives."""
    return json.loads(Path(path).read_text()) | {k: v for k, v in more.items() if v is not None}


def read_if_there(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A Parquet table, empty before its first write. Other errors than a missing path are raised."""
    try:
        spark.read.format("parquet").load(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for this block, restored after it. Two underscores in a name stand for a dot."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
