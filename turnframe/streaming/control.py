"""Sentinels and failures of a run, as tables: what is ready, what is done, and what went wrong with which recording."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, StringType, StructField, StructType, TimestampType

MARKS = "stage string, state string, at timestamp"


def mark(spark: SparkSession, path: str, stage: str, state: str) -> None:
    """Adds a sentinel: a stage is `ready` or `done`. Each is a file of its own, below a folder of its stage and state, which appears whole or not at all."""
    spark.range(1).select(F.lit(stage).alias("stage"), F.lit(state).alias("state"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").partitionBy("stage", "state").parquet(path)


def states(marks: DataFrame) -> DataFrame:
    """(stage, state) after the latest of marks (stage, state, at); of two at one time, done holds."""
    return marks.groupBy("stage").agg(F.max(F.struct("at", (F.col("state") == "done").alias("last"), "state")).alias("m")).select("stage", "m.state")


def reached(spark: SparkSession, path: str, stage: str, state: str) -> bool:
    """Whether the stage has the sentinel; no table yet means no. Only the folder of the stage and state is read."""
    from pyspark.errors import AnalysisException

    try:
        marks = spark.read.schema(MARKS).parquet(path)
    except AnalysisException:
        return False
    return not marks.where((F.col("stage") == stage) & (F.col("state") == state)).isEmpty()


def isolated(rows: DataFrame, keys: list[str], job: Callable[[pd.DataFrame], pd.DataFrame], kind: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(results, errors): job(rows of a key) for every key, in one Spark job; a key whose job raises has a row in errors and leaves the others alone.

    kind is the schema of what job returns; errors are (keys, error, at). Both are read from a table below path, written once,
    whose rows are tagged as one or the other. A key is one group, as it is its job's unit.
    """
    out, of = StructType.fromDDL(kind), [rows.schema[k] for k in keys]
    made = [(f"_r{i}", f.name, f.dataType) for i, f in enumerate(out)]
    told = [(f"_k{i}", f.name, f.dataType) for i, f in enumerate(of)]
    tagged = StructType([StructField("ok", BooleanType()), *[StructField(c, t) for c, _, t in made + told], StructField("error", StringType())])

    whole, mine = to_arrow_schema(tagged), to_arrow_schema(out)

    def run(group: pa.Table) -> pa.Table:
        try:
            found = pa.Table.from_pandas(job(group.to_pandas()), mine, preserve_index=False)
            columns, n, has = {c: found.column(i) for i, (c, _, _) in enumerate(made)}, found.num_rows, True
        except Exception as e:  # whatever a key's job raises is its own
            columns, n, has = {c: group.column(k).slice(0, 1) for c, k, _ in told}, 1, False
            columns["error"] = pa.array([f"{type(e).__name__}: {e}"])
        columns["ok"] = pa.array([has] * n, pa.bool_())
        return pa.table([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in whole], schema=whole)

    rows.groupBy(*keys).applyInArrow(run, tagged).withColumn("at", F.current_timestamp()).write.partitionBy("ok").parquet(path)
    every = rows.sparkSession.read.schema(StructType([*tagged, StructField("at", TimestampType())])).parquet(path)
    return every.where("ok").select(*[F.col(c).alias(n) for c, n, _ in made]), every.where("not ok").select(*[F.col(c).alias(n) for c, n, _ in told], "error", "at")
