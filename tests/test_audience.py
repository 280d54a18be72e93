"""Set algebra, containers and unsigned ids."""

import pytest
from frames import plan_of, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.functions.packing import SIGNED, UNSIGNED, unsigned_id, unsigned_value
from tagloom.operators import audience, bitmaps
from tagloom.operators.audience import has

IDS = {
    "a": [*range(1, 200), 32768, 32769, 40_000, *range(70_000, 70_300)],
    "b": [*range(100, 300), 40_000, 99_999, *range(70_100, 70_200)],
    "c": [150, 40_000, *range(1000, 1003)],
}


def chunks(spark, values=IDS, ids=SIGNED):
    data = [(str(i), "G", v) for v, own in values.items() for i in own]
    tall = spark.createDataFrame(data, "uid string, tag_code string, tag_value string")
    return bitmaps.user_chunks(bitmaps.members_of_tall(tall, ids=ids))


A, B, C = (has("G", v) for v in "abc")
CASES = {
    "and": (A & B, lambda a, b, c: a & b),
    "or": (A | B | C, lambda a, b, c: a | b | c),
    "minus": (A - B, lambda a, b, c: a - b),
    "and not": ((A & B) - C, lambda a, b, c: (a & b) - c),
    "nested": ((A - B) | (B - (A | C)), lambda a, b, c: (a - b) | (b - (a | c))),
    "any value": (has("G") - A, lambda a, b, c: (a | b | c) - a),
    "same twice": (A & A & B, lambda a, b, c: a & b),
    "nobody": (A & has("G", "z"), lambda a, b, c: set()),
    "not nobody": (A - has("H"), lambda a, b, c: a),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("packed", [False, True])
def test_audiences_equal_python_sets(spark, name, packed):
    expression, plain = CASES[name]
    members = audience.containers(chunks(spark)) if packed else chunks(spark)
    out = audience.audience_chunks(members, expression)
    want = plain(*(set(IDS[v]) for v in "abc"))
    assert sorted(r.uid for r in bitmaps.chunk_users(out).collect()) == sorted(want)
    assert sum(r.n_users for r in out.collect()) == len(want)


def test_an_audience_is_one_shuffle_of_packed_rows(spark, tmp_path):
    chunks(spark).write.parquet(str(tmp_path / "chunks"))
    plan = plan_of(audience.audience_chunks(spark.read.parquet(str(tmp_path / "chunks")), (A & B) - C))
    assert plan.count("Exchange hashpartitioning(bucket") == 1 and plan.count("Exchange") == 1
    assert "SortMergeJoin" not in plan and "HashJoin" not in plan and "EqualTo(tag_code,G)" in plan


def test_runs_are_kept_where_they_are_shorter(spark):
    values = {"all": range(1, 32769), "run": range(10, 90), "rare": [5, 900, 20_000], "odd": range(1, 2000, 2)}
    packed = {r.tag_value: r for r in audience.containers(chunks(spark, values)).collect()}
    assert [tuple(x) for x in packed["all"].runs] == [(0, 32767)] and not packed["all"].words
    assert [tuple(x) for x in packed["run"].runs] == [(9, 88)] and packed["run"].n_users == 80
    assert [tuple(x) for x in packed["rare"].runs] == [(4, 4), (899, 899), (19_999, 19_999)]  # a run of one is short too
    assert packed["odd"].words and not packed["odd"].runs


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 33_000), st.integers(1, 200)), min_size=1, max_size=12))
def test_containers_keep_every_user(spark, spans):
    own = sorted({i for at, n in spans for i in range(at, at + n)})
    packed = audience.containers(chunks(spark, {"v": own}))
    assert sorted(r.uid for r in audience.container_users(packed).collect()) == own
    again = audience.audience_chunks(packed, has("G", "v"))
    assert sorted(r.uid for r in bitmaps.chunk_users(again).collect()) == own


HIGH = [0, 1, 32767, 32768, 2**63 - 1, 2**63, 2**63 + 1, 2**64 - 32769, 2**64 - 2, 2**64 - 1]


def test_unsigned_ids_survive_packing(spark):
    packed = chunks(spark, {"v": [*HIGH, *HIGH]}, UNSIGNED)
    assert [int(r.uid) for r in bitmaps.chunk_users(packed, UNSIGNED).orderBy("uid").collect()] == HIGH
    assert sorted(r.bucket for r in packed.collect()) == [i >> 15 for i in (0, 32768, 2**63 - 1, 2**63, 2**64 - 32769, 2**64 - 1)]
    assert rows(bitmaps.user_counts(packed)) == [("G", "v", len(HIGH))]
    held = audience.container_users(audience.containers(packed), UNSIGNED)
    assert sorted(int(r.uid) for r in held.collect()) == HIGH
    tall = spark.createDataFrame([(str(i), "G", "v") for i in HIGH], "uid string, tag_code string, tag_value string")
    sets = bitmaps.user_sets(bitmaps.members_of_tall(tall, ids=UNSIGNED), UNSIGNED)
    assert [int(i) for r in sets.orderBy("bucket").collect() for i in r.uids] == HIGH
    wide = spark.createDataFrame([(str(i), "v") for i in HIGH], "uid string, g string")
    of_wide = bitmaps.user_chunks(bitmaps.members_of_wide(wide, ["G"], ids=UNSIGNED))
    assert rows(bitmaps.user_counts(of_wide)) == [("G", "v", len(HIGH))]


def test_what_is_no_unsigned_id(spark):
    texts = ["-1", str(2**64), "1.5", "x", "", "9" * 30, None]
    ids = spark.createDataFrame([(t,) for t in texts], "t string")
    assert ids.filter(unsigned_id(F.col("t"), strict=False).isNotNull()).count() == 0
    for text in texts[:-1]:
        with pytest.raises(Exception, match="unsigned"):
            ids.filter(F.col("t") == text).select(unsigned_id(F.col("t"))).collect()
    good = spark.createDataFrame([("007",), (" 5 ",), ("+3",), (str(2**64 - 1),)], "t string")
    assert [int(r[0]) for r in good.select(unsigned_value(unsigned_id(F.col("t")))).collect()] == [7, 5, 3, 2**64 - 1]
