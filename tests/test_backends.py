"""One protocol for both backends: streams give what tables give, over restarts, ends and idle time."""

import time

import pandas as pd
import pytest

from turnframe import fixtures as fx
from turnframe.streaming.backends import speakers

SF = "/root/testdata/sf0.001"


@pytest.fixture
def observed(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return fx.observations(spark, SF).where("uri < 2 and chunk < 6").select("uri", "chunk", "local", "vec", "duration", "allow_update")


def key(rows):
    return sorted((r.uri, r.chunk, r.local, r.global_id) for r in rows)


def feed(spark, df, pdf, tmp_path, name):
    spark.createDataFrame(pdf, df.schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))


def run(spark, df, tmp_path, backend, **how):
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = speakers(stream, backend, **how).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert not q.isActive and q.exception() is None
    return key(spark.read.schema("uri long, chunk long, local long, global_id long").parquet(str(tmp_path / "out")).collect())


def ends(*uris):
    return pd.DataFrame([(u, -1, None, None, None, None) for u in uris], columns=["uri", "chunk", "local", "vec", "duration", "allow_update"]).astype({"local": "Int64"}).astype(object).where(lambda x: x.notna(), None)


def test_deferred_answers_at_the_end_and_once(spark, observed, tmp_path):
    pdf = observed.toPandas()
    feed(spark, observed, pdf[pdf["chunk"] >= 3], tmp_path, "a")  # in any order
    assert run(spark, observed, tmp_path, "deferred") == []
    feed(spark, observed, pdf[pdf["chunk"] < 3], tmp_path, "b")
    feed(spark, observed, ends(0), tmp_path, "c")
    want = key(speakers(observed, "deferred").collect())
    assert run(spark, observed, tmp_path, "deferred") == [r for r in want if r[0] == 0]
    feed(spark, observed, ends(0, 1), tmp_path, "d")  # an end that comes twice answers nothing more
    feed(spark, observed, pdf[pdf["uri"] == 0], tmp_path, "e")  # nor do rows after it
    assert run(spark, observed, tmp_path, "deferred") == want and {r[0] for r in want} == {0, 1}


def test_idle_recordings_end(spark, observed, tmp_path):
    """Nothing tells the end; timers of processing time keep a stream going, so it runs until the rows are there."""
    pdf = observed.toPandas()
    feed(spark, observed, pdf[pdf["uri"] == 0], tmp_path, "a")
    want = [r for r in key(speakers(observed, "deferred").collect()) if r[0] == 0]
    stream = spark.readStream.schema(observed.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = speakers(stream, "deferred", idle_ms=1000).writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    until = time.time() + 60
    while q.exception() is None and time.time() < until and not spark.table("idle").count():
        time.sleep(0.5)
    q.stop()
    assert q.exception() is None and key(spark.table("idle").collect()) == want


def test_backends_by_name(spark, observed, tmp_path):
    feed(spark, observed, observed.toPandas(), tmp_path, "a")
    assert run(spark, observed, tmp_path, "online") == key(speakers(observed, "online").collect())
    with pytest.raises(ValueError):
        speakers(observed, "other")
