"""The same results in DuckDB SQL over the provided tables, for every query that SQL can state."""

from __future__ import annotations

# Everything is written out here, so that a wrong constant of the code under test does not stay green.
DAY = "2024-01-31"
DWELL_SETS = {"male": (3, 4, 6), "female": (8, 11, 15)}
TAG_TYPES = {
    "TG_Segment": "3",
    "TG_Nation": "3",
    "TG_Balance": "2",
    "TG_OrderCount": "1",
    "TG_OrderAmount": "2",
    "TG_LastOrder": "4",
    "TG_Statuses": "3",
    "TG_Quantity": "2",
    "TG_Views": "1",
}
LABEL_WORDS = {"F": "女"}
OTHER_WORD = "男"

# One SELECT per tag: (uid, tag_value) with the stored type.
TAG_SQL = {
    "TG_Segment": """
        select cast(c_custkey as varchar) as uid,
               case c_mktsegment when 'BUILDING' then 'builder' when 'MACHINERY' then 'maker'
                    when 'HOUSEHOLD' then 'home' when 'AUTOMOBILE' then 'driver''s' end as tag_value
        from customer""",
    "TG_Nation": """
        select cast(c_custkey as varchar) as uid, n_name as tag_value
        from customer join nation on c_nationkey = n_nationkey""",
    "TG_Balance": """
        select cast(c_custkey as varchar) as uid, cast(c_acctbal as decimal(16,2)) as tag_value
        from customer""",
    "TG_OrderCount": """
        select cast(o_custkey as varchar) as uid, cast(count(*) as bigint) as tag_value
        from orders group by o_custkey""",
    "TG_OrderAmount": """
        select cast(o_custkey as varchar) as uid,
               cast(sum(cast(o_totalprice as decimal(16,2))) as decimal(16,2)) as tag_value
        from orders group by o_custkey""",
    "TG_LastOrder": """
        select cast(o_custkey as varchar) as uid, strftime(max(o_orderdate), '%Y-%m-%d') as tag_value
        from orders group by o_custkey""",
    "TG_Statuses": """
        select distinct cast(o_custkey as varchar) as uid,
               case o_orderstatus when 'F' then 'f' when 'O' then 'o' end as tag_value
        from orders""",
    "TG_Quantity": """
        select cast(o_custkey as varchar) as uid,
               cast(sum(cast(l_quantity as decimal(16,2))) as decimal(16,2)) as tag_value
        from orders join lineitem on o_orderkey = l_orderkey group by o_custkey""",
    "TG_Views": """
        select cast(user_id as varchar) as uid, cast(count(*) as bigint) as tag_value
        from events where event_type = 'view' group by user_id""",
}

TALL = " union all ".join(
    f"select uid, cast(tag_value as varchar) as tag_value, '{code.lower()}' as tag_code from ({TAG_SQL[code]})"
    for code in TAG_TYPES
)

WIDE = (
    "select uid, "
    + ", ".join(
        f"coalesce(string_agg(tag_value, '' order by tag_value) "
        f"filter (tag_code = '{code.lower()}'), '') as {code.lower()}"
        for code in TAG_TYPES
    )
    + f" from ({TALL}) group by uid"
)

# Non-empty wide cells with the code as the catalogue writes it, and with the tag's value type.
CELLS = " union all ".join(
    f"select cast(uid as bigint) as uid, '{code}' as tag_code, {code.lower()} as tag_value, "
    f"'{kind}' as value_type from wide where {code.lower()} <> ''"
    for code, kind in TAG_TYPES.items()
)
WITH_CELLS = f"with wide as ({WIDE}), cells as ({CELLS})"

BUCKET = "case when uid > 0 then (uid - 1) // 32768 + 1 else uid // 32768 end"

# Unsigned ids: even users from 2^63 on, the others down from 2^64 - 1.
HIGH = """cast(case when uid % 2 = 0 then 9223372036854775808::ubigint + cast(uid as ubigint)
               else 18446744073709551615::ubigint - cast(uid as ubigint) + 1::ubigint end as ubigint)"""

AUDIENCE = """
    select distinct uid from cells
    where (uid in (select uid from cells where tag_code = 'TG_Segment' and tag_value in ('builder', 'maker'))
           and uid in (select uid from cells where tag_code = 'TG_Views')
           and uid not in (select uid from cells where tag_code = 'TG_Statuses' and tag_value = 'o'))
       or (uid in (select uid from cells where tag_code = 'TG_Nation' and tag_value = 'NATION_3')
           and uid not in (select uid from cells where tag_code = 'TG_Segment'))"""

VISITS = """
    select user_id, cast(p_size as varchar) as category1_id, cast(value as decimal(16,2)) as during_time,
           strftime(ts, '%Y-%m-%d') as dt
    from events join part on json_extract_string(props, '$.k') = cast(p_partkey as varchar)
    where event_type = 'view'"""


def _ranked(visits: str = VISITS) -> str:
    return f"""
    select user_id, cast(category1_id as bigint) as c1, ct, dur_time,
           cast(row_number() over (partition by user_id order by ct desc, cast(category1_id as bigint))
                as integer) as rk
    from (select user_id, category1_id, cast(count(*) as bigint) as ct,
                 cast(sum(during_time) as decimal(18,2)) as dur_time
          from ({visits}) group by user_id, category1_id)"""


def _tops(k: int) -> str:
    return "".join(
        f", cast(sum(case when rk = {r} then c1 else 0 end) as bigint) as c1_rk{r}" for r in range(1, k + 1)
    )


def _dwell(sets) -> str:
    return "".join(
        f", cast(sum(case when c1 in {tuple(members)} then dur_time else 0 end) as decimal(18,2)) "
        f"as {name}_dur"
        for name, members in sets.items()
    )


USERS = """
    select c_custkey as id,
           case when c_mktsegment in ('BUILDING', 'MACHINERY') then 'M' when c_mktsegment = 'HOUSEHOLD' then 'F'
                when c_mktsegment = 'FURNITURE' then '' end as gender
    from customer"""


def _features(condition: str, label: bool, visits: str = VISITS) -> str:
    profile = f"select user_id{_tops(3)}{_dwell(DWELL_SETS)} from ({_ranked(visits)}) group by user_id"
    columns = "user_id, c1_rk1, c1_rk2, c1_rk3, male_dur, female_dur" + (", gender" if label else "")
    return f"select {columns} from ({profile}) join ({USERS}) on user_id = id where {condition}"


# The sample table with its category codes, NULL where there is none, and the share it is trained on.
SAMPLES = """
    select cast(p_partkey as varchar) as uid,
           case p_type when 'SMALL' then 101 when 'MEDIUM' then 102 when 'LARGE' then 103 end as hair,
           case when p_size % 2 = 0 then 11 else 12 end as skirt,
           case when p_size < 15 then 100 when p_size < 30 then 90 when p_size < 45 then 80 end as age,
           case when p_size % 2 = 0 and p_type <> 'LARGE' then 'F' else 'M' end as gender,
           cast('0x' || substr(md5('7:' || p_partkey), 1, 8) as bigint) % 10000 < 8000 as trained
    from part"""

WORD = " ".join(f"when '{k}' then '{v}'" for k, v in LABEL_WORDS.items())

ORACLES: dict[str, str] = {
    "active_tag_catalog": """
        select t.* from (
            select p_partkey as id, 'TAG_' || p_partkey as tag_code, p_name as tag_name,
                   p_partkey % 2 + 3 as tag_level, p_partkey // 2 as parent_tag_id, p_type as tag_type,
                   cast(p_size % 4 + 1 as varchar) as tag_value_type, cast(p_size as bigint) as tag_task_id
            from part) t
        join supplier on tag_task_id = s_suppkey
        where s_acctbal > 0 and tag_level = 3""",
    "task_rules": """
        select l_orderkey * 10 + l_linenumber as id, l_partkey as tag_id, l_suppkey as task_id,
               l_returnflag as query_value, l_partkey as sub_tag_id, p_name as sub_tag_value
        from lineitem join part on l_partkey = p_partkey""",
    "tag_rule_mapped": TAG_SQL["TG_Segment"],
    "tag_rule_join": """
        select cast(p_partkey as varchar) as uid,
               first_value(p_brand || ' ' || p_type) over (partition by p_name order by p_partkey) as tag_value
        from part""",
    "tag_passthrough_text": TAG_SQL["TG_Nation"],
    "tag_passthrough_long": TAG_SQL["TG_OrderCount"],
    "tag_decimal": TAG_SQL["TG_OrderAmount"],
    "tag_decimal_join": TAG_SQL["TG_Quantity"],
    "tag_date": TAG_SQL["TG_LastOrder"],
    "tag_lenient_cast": """
        select cast(o_orderkey as varchar) as uid,
               case when o_orderstatus <> 'F' then o_custkey end as tag_value
        from orders""",
    "tag_text_values": f"""
        select cast(o_orderkey as varchar) as uid,
               case when o_orderkey % 11 > 0 then
                   [chr(92) || 'N', chr(92) || chr(92) || 'N', 'tab' || chr(9) || 'here', 'quo"te',
                    'back' || chr(92) || 'slash', '', ' blank ', 'plain'][o_orderkey % 8 + 1] end as tag_value,
               '{DAY}' as dt
        from orders""",
    "tag_partition_overwrite": f"""
        select uid, tag_value, dt
        from ({TAG_SQL["TG_Segment"]}), (values ('{DAY}'), ('2024-01-30')) as days(dt)""",
    "tag_partition_cleared": f"""
        select uid, tag_value, '2024-01-30' as dt from ({TAG_SQL["TG_OrderCount"]})""",
    "tall_table": TALL,
    "wide_table": WIDE,
    "duplicate_users": f"""
        select uid, tag_code, cast(count(*) as bigint) as n from ({TALL})
        group by uid, tag_code having count(*) > 1""",
    "merge_job": WIDE,
    "export_sorted_files": WIDE,
    "unpivot_tags": f"{WITH_CELLS} select cast(uid as varchar) as uid, tag_code, tag_value from cells",
    "tag_user_sets": f"""
        {WITH_CELLS}
        select tag_code, tag_value, cast({BUCKET} as bigint) as bucket, cast(count(*) as bigint) as n_users,
               string_agg(cast(uid as varchar), ',' order by uid) as uids
        from (select distinct tag_code, tag_value, uid from cells)
        group by tag_code, tag_value, {BUCKET}""",
    "tag_bitmap_counts": f"""
        {WITH_CELLS}
        select tag_code, tag_value, cast(count(distinct uid) as bigint) as n_users
        from cells group by tag_code, tag_value""",
    "tag_chunk_members": f"{WITH_CELLS} select distinct tag_code, tag_value, uid from cells",
    "tag_native_bitmaps": f"""
        {WITH_CELLS}
        select tag_code, cast({BUCKET} as bigint) as bucket, cast(count(*) as bigint) as n_memberships,
               cast(count(distinct uid) as bigint) as n_users
        from (select distinct tag_code, tag_value, uid from cells)
        group by tag_code, {BUCKET}""",
    "tag_tall_bitmap_counts": f"""
        select tag_code, tag_value, cast(count(distinct uid) as bigint) as n_users
        from ({TALL}) where tag_value <> '' group by tag_code, tag_value""",
    "bitmaps_by_type": f"""
        {WITH_CELLS}
        select value_type, tag_code, tag_value, cast(count(distinct uid) as bigint) as n_users
        from cells group by value_type, tag_code, tag_value""",
    "bitmap_job": f"""
        {WITH_CELLS}
        select '{DAY}' as dt, value_type, tag_code, cast(count(distinct tag_value) as bigint) as n_values,
               cast(count(*) as bigint) as n_users
        from (select distinct value_type, tag_code, tag_value, uid from cells)
        group by value_type, tag_code""",
    "tag_unsigned_members": f"""
        select distinct tag_code, tag_value, cast({HIGH} as varchar) as uid
        from (select tag_code, tag_value, cast(uid as bigint) as uid from ({TALL}) where tag_value <> '')""",
    "tag_unsigned_counts": f"""
        select tag_code, tag_value, cast(high // 32768 as bigint) as bucket, cast(count(*) as bigint) as n_users,
               cast(min(high) as varchar) as first, cast(max(high) as varchar) as last
        from (select distinct tag_code, tag_value, {HIGH} as high
              from (select tag_code, tag_value, cast(uid as bigint) as uid from ({TALL}) where tag_value <> ''))
        group by tag_code, tag_value, high // 32768""",
    "audience_members": f"{WITH_CELLS} {AUDIENCE}",
    "audience_count": f"""
        {WITH_CELLS}, chosen as ({AUDIENCE})
        select cast({BUCKET} as bigint) as bucket, cast(count(*) as bigint) as n_users from chosen group by {BUCKET}""",
    "tag_container_members": f"{WITH_CELLS} select distinct tag_code, tag_value, uid from cells",
    "shared_tag_job": " union all ".join(
        f"select uid, cast(tag_value as varchar) as tag_value, '{code.lower()}' as tag_code from ({TAG_SQL[code]})"
        for code in ("TG_OrderCount", "TG_OrderAmount", "TG_LastOrder")
    ),
    "item_join": f"select user_id, category1_id, during_time from ({VISITS})",
    "category_visits": f"""
        select user_id, category1_id, cast(count(*) as bigint) as ct,
               cast(sum(during_time) as decimal(18,2)) as dur_time
        from ({VISITS}) group by user_id, category1_id""",
    "category_rank": _ranked(),
    "topk_categories": f"select user_id{_tops(5)} from ({_ranked()}) group by user_id",
    "category_set_dwell": f"""
        select user_id{_dwell({**DWELL_SETS, "other": (1, 2, 5, 7, 50)})}
        from ({_ranked()}) group by user_id""",
    "behaviour_features_train": _features("gender <> ''", True),
    "behaviour_features_predict": _features("gender is null", False),
    "behaviour_features_predict_with_empty": _features("coalesce(gender, '') = ''", False),
    "behaviour_features_by_day": _features(
        "gender <> ''", True, f"select * from ({VISITS}) where dt between '2024-01-10' and '2024-01-20'"
    ),
    "category_codes": """
        select cast(p_partkey as varchar) as uid,
               case p_type when 'SMALL' then 101 when 'MEDIUM' then 102 when 'LARGE' then 103 end as hair,
               p_retailprice as height,
               case when p_size % 2 = 0 then 11 else 12 end as skirt,
               case when p_size < 15 then 100 when p_size < 30 then 90 when p_size < 45 then 80 end as age,
               case when p_size % 2 = 0 and p_type <> 'LARGE' then 'F' else 'M' end as gender
        from part""",
    "train_test_split": f"""
        select id, gender, '9999-99-99' as dt,
               case when cast('0x' || substr(md5('7:' || id), 1, 8) as bigint) % 10000 < 8000
                    then 'train' else 'test' end as part
        from ({USERS})""",
    "label_report": f"""
        with g as (select gender as actual, case when male_dur >= female_dur then 'M' else 'F' end as guess
                   from ({_features("gender <> ''", True)})),
        labels as (select distinct actual as label from g)
        select 'accuracy' as metric, cast(null as varchar) as label,
               cast(count(*) filter (actual = guess) as double) / count(*) as value from g
        union all
        select 'recall', label, cast(count(*) filter (guess = label and actual = label) as double)
                                / count(*) filter (actual = label)
        from g, labels group by label
        union all
        select 'precision', label,
               coalesce(cast(count(*) filter (guess = label and actual = label) as double)
                        / nullif(count(*) filter (guess = label), 0), 0.0)
        from g, labels group by label""",
    # The fitted tree finds the rule that the labels follow.
    "sample_model_predictions": f"select uid, gender as label from ({SAMPLES})",
    "sample_path_predictions": f"select uid, gender as label from ({SAMPLES})",
    # The exported tree in SQL says what the model says, for every user and every feature.
    "tree_path_agreement": f"""
        select user_id, cast(1 as integer) as agrees from ({_features("gender is null", False)})""",
    "tree_weight_agreement": """
        select feature, cast(1 as integer) as agrees
        from (values ('c1_rk1'), ('c1_rk2'), ('c1_rk3'), ('male_dur'), ('female_dur')) as f(feature)""",
    "label_index": f"""
        select gender as label,
               cast(row_number() over (order by count(*) desc, gender) - 1 as integer) as idx
        from ({SAMPLES}) where trained group by gender""",
    "feature_categories": f"""
        select distinct feature, cast(category as integer) as category
        from (select 'hair' as feature, coalesce(hair, -1) as category from ({SAMPLES}) where trained
              union all select 'skirt', skirt from ({SAMPLES}) where trained
              union all select 'age', coalesce(age, -1) from ({SAMPLES}) where trained)""",
    "predicted_label_users": f"""
        select uid, cast(1 as bigint) as n, cast(1 as bigint) as n_values
        from (select cast(user_id as varchar) as uid from ({_features("gender is null", False)})
              union all select cast(id as varchar) from ({USERS}) where gender is not null)""",
    "declared_label_tag": f"""
        select cast(id as varchar) as uid, case gender {WORD} else '{OTHER_WORD}' end as tag_value
        from ({USERS}) where gender is not null""",
}
