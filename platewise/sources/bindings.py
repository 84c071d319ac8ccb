"""The star-schema test tables read as the dish-discovery domain.

Every binding is one SELECT that both Spark SQL and the checking database understand, so a query and
its SQL twin start from the same rows. ``bound(spark, sf_dir, "dishes", ...)`` returns frames;
``with_sql("dishes", ...)`` the same as a WITH prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DIETS = ["vegan", "vegetarian", "gluten_free", "dairy_free", "nut_free", "halal", "kosher"]


def _flag(i: int) -> str:
    return f"case (p_partkey + {i}) % 3 when 0 then true when 1 then false end"


BINDINGS = {
    "restaurants": """
        select s_suppkey as restaurant_id, s_name as restaurant_name,
          cast(40.70 as double) + (s_suppkey * 37 % 1000) / cast(10000.0 as double) as lat,
          cast(-74.00 as double) + (s_suppkey * 61 % 1000) / cast(10000.0 as double) as lng,
          (30 + s_suppkey * 7 % 21) / cast(10.0 as double) as rating,
          case s_nationkey % 10 when 0 then 'Thai' when 1 then 'Italian' when 2 then 'Mexican' when 3 then 'Japanese' when 4 then 'Chinese'
            when 5 then 'Indian' when 6 then 'Korean' when 7 then 'Greek' when 8 then 'French' else 'American' end as cuisine,
          concat(cast(100 + s_suppkey * 3 % 400 as varchar(10)), ' Main Street, New York, NY 10001, USA') as address,
          s_suppkey % 17 <> 0 as is_active
        from supplier""",
    "dishes": f"""
        select p_partkey as dish_id, p_partkey % (select count(*) from supplier) as restaurant_id, p_name as name,
          concat(p_brand, ' ', case p_partkey % 7 when 0 then 'with peanut sauce' when 1 then 'with cheese' when 2 then 'grilled' else 'plain' end) as description,
          p_type as category, p_retailprice as price,
          cast(200 + p_partkey * 13 % 607 as int) as calories_min, cast(260 + p_partkey * 13 % 607 as int) as calories_max,
          (50 + p_partkey * 7 % 411) / cast(10.0 as double) as protein_min, (90 + p_partkey * 7 % 411) / cast(10.0 as double) as protein_max,
          (100 + p_partkey * 11 % 701) / cast(10.0 as double) as carbs_min, (150 + p_partkey * 11 % 701) / cast(10.0 as double) as carbs_max,
          (20 + p_partkey * 17 % 307) / cast(10.0 as double) as fat_min, (40 + p_partkey * 17 % 307) / cast(10.0 as double) as fat_max,
          (50 + p_partkey * 11 % 51) / cast(100.0 as double) as macro_confidence, (60 + p_partkey * 17 % 41) / cast(100.0 as double) as confidence,
          {", ".join(f"{_flag(i)} as {d}" for i, d in enumerate(DIETS))},
          p_partkey % 19 <> 0 as is_available
        from part""",
    "reviews": """
        select p_partkey as dish_id, (10 + p_partkey * 29 % 41) / cast(10.0 as double) as average_rating, cast(1 + p_partkey * 31 % 97 as int) as review_count
        from part where p_partkey % 4 <> 0""",
    "photos": """
        select l_partkey as dish_id, l_orderkey * 10 + l_linenumber as photo_id, l_shipdate as taken_at
        from lineitem where l_linenumber <= 2""",
    "grid": """
        select user_id % (select count(*) from supplier) as restaurant_id, cast(extract(dow from ts) as int) as dow, cast(extract(hour from ts) as int) as hour,
          max(least(value, 100.0)) as busyness
        from events group by 1, 2, 3""",
    "feedback": """
        select event_id as feedback_id, event_id * 7919 % (select count(*) from part) as dish_id, user_id,
          case event_type when 'click' then 'portion_bigger' when 'view' then 'portion_accurate' when 'error' then 'dish_unavailable'
            when 'signup' then 'portion_smaller' else 'photo_submission' end as feedback_type, ts as created_at
        from events""",
    "favorites": """
        select distinct o_custkey as user_id, o_orderkey % (select count(*) from part) as dish_id, o_orderdate as created_at from orders""",
    "offers": """
        select l_orderkey as offer_id, l_linenumber as line, l_partkey as dish_id, l_suppkey as restaurant_id, l_quantity as quantity,
          l_extendedprice as price, l_discount as discount, l_shipdate as seen_at from lineitem""",
    "items": """
        select l_orderkey as item_id, l_linenumber as line, l_suppkey as restaurant_id, l_returnflag as source, l_shipdate as last_seen_at,
          case when l_linestatus = 'F' and l_linenumber = 7 then l_shipdate end as archived_at, l_discount * 10 as audit_confidence
        from lineitem""",
}
BASE = {
    "restaurants": ["supplier"], "dishes": ["part", "supplier"], "reviews": ["part"], "photos": ["lineitem"], "grid": ["events", "supplier"],
    "feedback": ["events", "part"], "favorites": ["orders", "part"], "offers": ["lineitem"], "items": ["lineitem"],
}


def _spark_sql(text: str) -> str:
    # Spark counts Sunday as 1 in extract(dow ...)
    return text.replace("extract(dow from ts)", "dayofweek(ts) - 1")


def bound(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """The named bindings as frames."""
    out = []
    for name in names:
        sql, tables = _spark_sql(BINDINGS[name]), {}
        for base in BASE[name]:
            tables[base] = spark.read.parquet(f"{sf_dir}/{base}.parquet")
            sql = sql.replace(f"from {base}", f"from {{{base}}}")
        out.append(spark.sql(sql, **tables))
    return out


def with_sql(*names: str) -> str:
    return "with " + ",\n".join(f"{n} as ({BINDINGS[n]})" for n in names)


def with_flags(dishes: DataFrame) -> DataFrame:
    """The diet columns as one map of three-valued flags; every third key is missing and not null."""
    from pyspark.sql import functions as F

    pairs = [F.struct(F.lit(d).alias("k"), F.col(d).alias("v")) for d in DIETS]
    return dishes.withColumn("flags", F.map_from_entries(F.array(*pairs))).drop(*DIETS)
