"""Tags over the provided tables: stored queries, value types and value rules."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tagloom.functions.values import DATE, DECIMAL, LONG, TEXT
from tagloom.operators import merge, tags
from tagloom.sources import catalog
from workload.roles import DAY, table

SOURCES = ("customer", "orders", "lineitem", "events", "nation")


@dataclass(frozen=True)
class Tag:
    code: str
    value_type: str
    sql: str
    rules: dict[str, str] = field(default_factory=dict)


# $dt stands for the day. Sums run on decimals, whose result does not depend on the order of rows.
TAGS = [
    Tag(
        "TG_Segment",
        TEXT,
        "select c_custkey as uid, c_mktsegment as query_value from customer",
        {"BUILDING": "builder", "MACHINERY": "maker", "HOUSEHOLD": "home", "AUTOMOBILE": "driver's"},
    ),
    Tag(
        "TG_Nation",
        TEXT,
        "select c_custkey as uid, n_name as query_value from customer join nation "
        "on c_nationkey = n_nationkey",
    ),
    Tag(
        "TG_Balance",
        DECIMAL,
        "select c_custkey as uid, c_acctbal as query_value from customer",
    ),
    Tag(
        "TG_OrderCount",
        LONG,
        "select o_custkey as uid, count(*) as query_value from orders "
        "where o_orderdate < date_add(date'$dt', 1) group by o_custkey",
    ),
    Tag(
        "TG_OrderAmount",
        DECIMAL,
        "select o_custkey as uid, sum(cast(o_totalprice as decimal(16,2))) as query_value from orders "
        "where o_orderdate < date_add(date'$dt', 1) group by o_custkey",
    ),
    Tag(
        "TG_LastOrder",
        DATE,
        "select o_custkey as uid, cast(max(o_orderdate) as date) as query_value from orders "
        "where o_orderdate < date_add(date'$dt', 1) group by o_custkey",
    ),
    # Several rows per user: the wide cell joins them.
    Tag(
        "TG_Statuses",
        TEXT,
        "select distinct o_custkey as uid, o_orderstatus as query_value from orders",
        {"F": "f", "O": "o"},
    ),
    # Line items are summed by order before the join, so an order with very many lines joins as one row.
    Tag(
        "TG_Quantity",
        DECIMAL,
        "select o_custkey as uid, sum(q) as query_value from orders join "
        "(select l_orderkey, sum(cast(l_quantity as decimal(8,2))) as q from lineitem group by l_orderkey) "
        "on o_orderkey = l_orderkey group by o_custkey",
    ),
    Tag(
        "TG_Views",
        LONG,
        "select user_id as uid, count(*) as query_value from events where event_type = 'view' "
        "group by user_id",
    ),
]

CODES = [t.code for t in TAGS]
BY_CODE = {t.code: t for t in TAGS}
# Every query but this one yields a user at most once.
ONE_VALUE = [c for c in CODES if c != "TG_Statuses"]
SPECS = [catalog.TagSpec(t.code, t.value_type) for t in TAGS]


def publish_sources(spark: SparkSession, sf_dir: str) -> None:
    """Name the provided tables for the stored queries."""
    for name in SOURCES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def local_frame(spark: SparkSession, rows: list[tuple], **types: pa.DataType) -> DataFrame:
    """A small frame of literal rows; as an Arrow table it needs no job to be read."""
    columns = [pa.array(list(values), t) for values, t in zip(zip(*rows), types.values(), strict=True)]
    return spark.createDataFrame(pa.table(columns, names=list(types)))


def metadata(spark: SparkSession) -> catalog.Metadata:
    """The tag set as metadata tables. Sub-tags at level 4 name the values that rules map to."""
    tag_rows, task_rows, rule_rows = [], [], []
    for i, tag in enumerate(TAGS, start=1):
        task_rows.append((i, tag.code, "1", tag.sql))
        tag_rows.append((i, tag.code, tag.code, 3, 0, tag.value_type, i))
        for key, value in tag.rules.items():
            n = len(rule_rows) + 1
            tag_rows.append((1000 + n, f"{tag.code}_{n}", value, 4, i, tag.value_type, None))
            rule_rows.append((n, i, i, key, 1000 + n))
    number, text = pa.int64(), pa.string()
    return catalog.Metadata(
        tag_info=local_frame(
            spark,
            tag_rows,
            id=number,
            tag_code=text,
            tag_name=text,
            tag_level=number,
            parent_tag_id=number,
            tag_value_type=text,
            tag_task_id=number,
        ),
        task_info=local_frame(spark, task_rows, id=number, task_name=text, task_status=text, task_sql=text),
        rules=local_frame(
            spark, rule_rows, id=number, tag_id=number, task_id=number, query_value=text, sub_tag_id=number
        ),
    )


def tag_frame(spark: SparkSession, sf_dir: str, code: str) -> DataFrame:
    """One tag, computed from its stored query."""
    publish_sources(spark, sf_dir)
    return _compute(spark, BY_CODE[code])


def _compute(spark: SparkSession, tag: Tag) -> DataFrame:
    return tags.compute_tag(tags.task_query(spark, tag.sql, DAY), _rules(spark, tag), tag.value_type)


# Source queries that several tags share: the same rows as their own queries, in one scan and one aggregation.
SHARED = {
    ("TG_OrderCount", "TG_OrderAmount", "TG_LastOrder"): (
        "select o_custkey as uid, count(*) as tg_ordercount, "
        "sum(cast(o_totalprice as decimal(16,2))) as tg_orderamount, cast(max(o_orderdate) as date) as tg_lastorder "
        "from orders where o_orderdate < date_add(date'$dt', 1) group by o_custkey"
    ),
    ("TG_Segment", "TG_Balance"): (
        "select c_custkey as uid, c_mktsegment as tg_segment, c_acctbal as tg_balance from customer"
    ),
}


def _rules(spark: SparkSession, tag: Tag) -> DataFrame | None:
    if not tag.rules:
        return None
    rows = [(i, k, v) for i, (k, v) in enumerate(tag.rules.items())]
    return local_frame(spark, rows, id=pa.int64(), query_value=pa.string(), sub_tag_value=pa.string())


def _branches(spark: SparkSession, codes: list[str]) -> DataFrame:
    """Tall rows of these tags; tags whose source is shared are computed together."""
    shared = []
    left = list(codes)
    for group, sql in SHARED.items():
        if set(group) <= set(left):
            left = [c for c in left if c not in group]
            own = [tags.SharedTag(c, BY_CODE[c].value_type, _rules(spark, BY_CODE[c])) for c in group]
            shared.append(tags.shared_tall(tags.shared_query(spark, sql, DAY, group), own))
    return merge.tall_table({c: _compute(spark, BY_CODE[c]) for c in left}, shared)


def tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    publish_sources(spark, sf_dir)
    return _branches(spark, CODES)


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    publish_sources(spark, sf_dir)
    repeated = [c for c in CODES if c not in ONE_VALUE]
    return merge.wide_table(_branches(spark, ONE_VALUE), CODES, ONE_VALUE, _branches(spark, repeated))
