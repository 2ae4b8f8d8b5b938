"""Helpers that the corpus operators share: working tables in the cluster's shared folder, and word and line rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnframe.llm.shipping import ship

#: White space that separates words: space and code points 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; only where that is unset and Spark runs in one machine, a local one is made."""
    ship(spark)
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="turnframe-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/turnframe/{uuid.uuid4().hex}"


#: With this on, the shuffle files of a query go as it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str = "table", *partition_by: str, **options: str) -> DataFrame:
    """df, computed once and kept as Parquet in a shared folder: cuts the lineage, and a lost executor loses nothing of it. Its shuffle files are removed."""
    path, conf = f"{shared_folder(df.sparkSession)}/{name}", df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).partitionBy(*partition_by).parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)  # a given schema holds for an empty table too
    kept._written_at = path
    return kept


def dropped(df: DataFrame) -> None:
    """Removes a table that written() made and that nothing reads any more."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Spark's lower() is much faster, and the same where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def text_key(text: Column) -> Column:
    """Beside doc_id, tells apart rows that share an id but not a text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def whole_rows(documents: DataFrame) -> DataFrame:
    """(doc_id, _key, _row): rows with their columns in one struct, so that none clashes with what a join adds."""
    return documents.select("doc_id", text_key(F.col("text")).alias("_key"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"))


def join_rows(a: DataFrame, b: DataFrame, how: str, *more: str) -> DataFrame:
    """a joined with b on equal doc_id (nulls too), _key and further columns; of these, a's stay."""
    on = ["doc_id", "_key", *more]
    other = b.withColumnsRenamed({c: f"_of_{c}" for c in on})
    same = F.col("doc_id").eqNullSafe(F.col("_of_doc_id"))
    for c in on[1:]:
        same = same & (F.col(c) == F.col(f"_of_{c}"))
    return a.join(other, same, how).drop(*(f"_of_{c}" for c in on))


def labelled(rows: DataFrame, known: DataFrame, key: str, label: str) -> DataFrame:
    """rows with the label of their key, from known (key, label, n), n being how many rows have the key.

    Keys with a thousandth of all rows or more are at most a thousand, so they are broadcast; the others are spread by the shuffle.
    """
    total = known.agg(F.sum("n")).first()[0] or 0
    heavy = known.where(F.col("n") * 1000 >= total).select(F.col(key).alias("_heavy"), F.col(label).alias("_label"))
    marked = rows.join(F.broadcast(heavy), F.col(key) == F.col("_heavy"), "left")
    rest = marked.where("_heavy is null").drop("_heavy", "_label").join(known.where(F.col("n") * 1000 < total).select(key, label), key)
    return marked.where("_heavy is not null").drop("_heavy").withColumnRenamed("_label", label).unionByName(rest)
