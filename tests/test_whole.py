"""The queries named …_all leave no row and no text out."""

from pyspark.sql import functions as F

from turnframe import fixtures as fx
from turnframe.plans import more  # noqa: F401
from turnframe.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_turn_is_mapped_and_looked_up(spark):
    want = sorted(r.id for r in fx.turns(spark, SF).select("id").collect())
    for name in ("asof_time_map_all", "word_index_range_all"):
        assert sorted(r.id for r in QUERIES[name](spark, SF).select("id").collect()) == want


def test_texts_are_stitched_to_their_end(spark):
    texts = {(r.conv_id, r.turn): r.text for r in fx.load(spark, SF, "conversations").where(F.col("text").isNotNull()).collect()}
    got = {(r.conv_id, r.turn): r.text for r in QUERIES["stitch_overlap_all"](spark, SF).collect()}
    assert got.keys() == texts.keys() and any(len(t) > 85 for t in texts.values())
    assert all(t[-1:] == texts[k][-1:] and (len(t) > 85 or len(texts[k]) <= 200) for k, t in got.items())
