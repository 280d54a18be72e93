import random

from frames import plan_of
from pyspark.sql import functions as F

from tagloom.operators import bitmaps


def members(spark, rows):
    return bitmaps.members_of_tall(spark.createDataFrame(rows, "uid string, tag_code string, tag_value string"))


def test_bitmaps_hold_the_bits_of_their_positions(spark):
    rng = random.Random(4)
    ids = {
        "few": rng.sample(range(1, 32769), 20),
        "many": rng.sample(range(1, 32769), 9000),
        "ends": [1, 64, 65, 128, 32705, 32768],
        "all": range(1, 32769),
    }
    out = bitmaps.user_bitmaps(members(spark, [(str(i), "G", v) for v in ids for i in ids[v]]))
    for row in out.collect():
        want = sum(1 << (i - 1) for i in ids[row["tag_value"]])
        assert (row["n_users"], bytes(row["bitmap"])) == (len(ids[row["tag_value"]]), want.to_bytes(4096, "little"))


def test_no_bitmap_of_a_value_is_shuffled_or_sorted(spark):
    """However many values a tag has, only the partial unions cross the network."""
    data = members(spark, [(str(i), "G", f"v{i}") for i in range(1, 400)])
    union = bitmaps.user_bitmaps(data).groupBy("tag_code", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    plan = plan_of(union)
    above = plan[: plan.index("unhex")]
    assert above.count("Exchange") == above.count("Sort [") == 1
    (row,) = union.collect()
    assert sum(b.bit_count() for b in bytes(row["bitmap"])) == 399
