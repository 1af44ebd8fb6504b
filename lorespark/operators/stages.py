"""Stages run one after another, each over what the one before made, with a row of facts about each."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ARTIFACTS = "stage int, name string, status string, started_at double, seconds double, rows bigint, error string"


def run_stages(spark: SparkSession, first: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], folder: str) -> tuple[DataFrame | None, DataFrame]:
    """The last stage's result and the artifacts (ARTIFACTS).

    Every stage's result is written as Parquet under ``folder``, a place that
    all executors share, and read again by the next one. A stage that fails
    ends the run: the result is null, the stages behind it are "skipped".
    """
    rows, df = [], first
    for i, (name, stage) in enumerate(stages):
        if df is None:
            rows.append((i, name, "skipped", None, None, None, None))
            continue
        began = time.time()
        try:
            out = stage(df)
            out.write.parquet(f"{folder}/stage{i}")
            df = spark.read.schema(out.schema).parquet(f"{folder}/stage{i}")
            rows.append((i, name, "done", began, time.time() - began, df.count(), None))
        except Exception as e:  # noqa: BLE001  the artifact tells what went wrong
            rows.append((i, name, "failed", began, time.time() - began, None, str(e)[:1000]))
            df = None
    return df, spark.createDataFrame(rows, ARTIFACTS)
