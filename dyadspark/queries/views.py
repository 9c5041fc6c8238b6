"""Study tables derived from the order and supplier tables.

Each view is one SQL text valid in Spark and in ANSI SQL engines, so that a
query and its check start from the same rows. All views read whole tables and
grow in proportion to them: field periods, groups and cohorts hold a steady
number of rows while their number grows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels", "documents"]

# An order is a sample; 40 consecutive orders make a field period, 160 a cohort of 30 birds.
_ORDER_COLUMNS = """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate,
       CAST(floor(o_orderkey / 40) AS BIGINT) AS period_id,
       CAST(floor(o_orderkey / 160) AS BIGINT) AS cohort,
       o_custkey % 30 AS place,
       (o_custkey + o_orderkey) % 15 AS role_no
FROM {orders}
"""

_ROLE = """CASE role_no WHEN 0 THEN 'BrM' WHEN 1 THEN 'BrF' WHEN 2 THEN 'H' WHEN 3 THEN 'ABX' WHEN 4 THEN 'AB'
 WHEN 5 THEN 'OFL' WHEN 6 THEN 'FL' WHEN 7 THEN 'CH' WHEN 8 THEN 'BrU' WHEN 9 THEN 'B' WHEN 10 THEN 'TBRF'
 WHEN 11 THEN 'TBRM' WHEN 12 THEN 'NSA' WHEN 13 THEN 'SEEN2' ELSE 'SEEN1' END"""

VIEWS = {
    "order_rows": _ORDER_COLUMNS,
    "samples": f"""
SELECT o_orderkey AS sample_id, o_orderkey AS ord,
       cohort * 30 + place AS bird_id,
       period_id * 8 + place % 8 AS group_id,
       cohort * 8 + place % 8 AS territory_id,
       period_id,
       1995 + CAST(floor(period_id / 2) AS BIGINT) AS year,
       CASE WHEN period_id % 2 = 0 THEN 'Major' ELSE 'Minor' END AS season,
       {_ROLE} AS role,
       nullif(CAST(floor(o_totalprice) AS BIGINT) % 720, 0) AS catch_time,
       CAST(floor(o_totalprice) AS BIGINT) % 80 AS time_in_fridge,
       CAST(o_orderdate AS DATE) AS sample_date,
       CAST(floor(o_totalprice) AS BIGINT) % 4800 / 365.25E0 AS sampling_age,
       nullif(place % 3, 2) AS sex
FROM order_rows
""",
    "status": f"""
SELECT period_id * 8 + place % 8 AS group_id, cohort * 30 + place AS bird_id, {_ROLE} AS role, o_orderkey AS status_id
FROM order_rows
""",
    "groups": """
SELECT DISTINCT period_id * 8 + place % 8 AS group_id, period_id, cohort * 8 + place % 8 AS territory_id
FROM order_rows
""",
    "offspring": """
SELECT cohort * 30 + place AS off_id, nullif(cohort * 30 + o_custkey * 7 % 30, cohort * 30) AS parent,
       cohort * 30 + o_custkey * 11 % 30 AS spouse_id,
       CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 AS DOUBLE) AS confidence, o_orderkey AS file_row
FROM order_rows
""",
    "edges": """
SELECT bird_a, bird_b, (bird_a * 31 + bird_b * 17) % 1000 / 1000.0E0 AS relatedness
FROM (SELECT DISTINCT least(a.cohort * 30 + a.place, b.cohort * 30 + b.place) AS bird_a,
                      greatest(a.cohort * 30 + a.place, b.cohort * 30 + b.place) AS bird_b
      FROM order_rows a JOIN order_rows b ON b.o_orderkey = a.o_orderkey + 1) e
""",
    # order-level community: few taxa per sample; Brand#0 stands in few orders and is not core
    "order_abund": """
SELECT sample_id, taxon_id, CAST(sum(l_quantity) AS BIGINT) AS n FROM (
SELECT l_orderkey AS sample_id, CASE WHEN (l_orderkey * 7 + l_linenumber) % 200 = 3 THEN 'Brand#0' ELSE p_brand END AS taxon_id, l_quantity
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey) t GROUP BY sample_id, taxon_id
""",
    # supplier-level community: many taxa per sample, 50 consecutive suppliers to a period; one taxon of few suppliers
    "sites": """
SELECT s_suppkey AS sample_id, s_suppkey AS ord,
       CAST(floor(s_suppkey / 2) AS BIGINT) AS bird_id,
       CAST(floor(s_suppkey / 50) AS BIGINT) * 10 + s_nationkey % 10 AS group_id,
       CAST(floor(s_suppkey / 50) AS BIGINT) AS period_id,
       2015 + CAST(floor(s_suppkey / 100) AS BIGINT) AS year,
       CASE WHEN CAST(floor(s_suppkey / 50) AS BIGINT) % 2 = 0 THEN 'Major' ELSE 'Minor' END AS season,
       CASE s_suppkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'SA' WHEN 2 THEN 'OFL' WHEN 3 THEN 'CH' ELSE 'FL' END AS age_class,
       s_acctbal AS tq,
       nullif(CAST(floor(abs(s_acctbal)) AS BIGINT) % 7, 0) AS catch_time
FROM {supplier}
""",
    "abund": """
SELECT l_suppkey AS sample_id,
       CASE WHEN l_suppkey % 40 = 3 AND l_linenumber > 5 THEN 'RARE/Brand#1/0'
            ELSE p_type || '/' || p_brand || '/' || CAST(p_size % 3 AS VARCHAR(3)) END AS taxon_id,
       CAST(sum(l_quantity) AS BIGINT) AS n
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
GROUP BY l_suppkey, CASE WHEN l_suppkey % 40 = 3 AND l_linenumber > 5 THEN 'RARE/Brand#1/0'
                         ELSE p_type || '/' || p_brand || '/' || CAST(p_size % 3 AS VARCHAR(3)) END
""",
    "taxonomy": """
SELECT DISTINCT p_type || '/' || p_brand || '/' || CAST(p_size % 3 AS VARCHAR(3)) AS taxon_id,
       p_type AS family, nullif(p_brand, 'Brand#13') AS genus
FROM {part}
UNION ALL SELECT 'RARE/Brand#1/0', 'RARE', 'Brand#1'
""",
    "genus_class": """
SELECT DISTINCT CASE WHEN p_brand = 'Brand#20' THEN 'Brand#0' ELSE p_brand END AS genus,
       CASE WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5', 'Brand#6', 'Brand#7') THEN 'Aerobic'
            WHEN p_brand IN ('Brand#8', 'Brand#9', 'Brand#10') THEN 'Facultative Anaerobic'
            WHEN p_brand IN ('Brand#11', 'Brand#12', 'Brand#14', 'Brand#15', 'Brand#16') THEN 'Anaerobic'
            WHEN p_brand IN ('Brand#17', 'Brand#18') THEN 'Unknown' ELSE 'Variable' END AS class
FROM {part}
""",
    # annotation sources: a part is a genus; sources know different genera and some rows have no name
    "genera": "SELECT p_partkey AS genus FROM {part}",
    "machine1": """
SELECT CASE WHEN p_size = 50 THEN NULL ELSE p_partkey END AS genus,
       CASE (p_partkey + p_size) % 8 WHEN 0 THEN 'Aerobic' WHEN 1 THEN 'Anaerobic' WHEN 2 THEN 'Facultatively anaerobic'
            WHEN 3 THEN 'Unknown' WHEN 4 THEN 'Facultative Anaerobic' WHEN 5 THEN 'Unclear' WHEN 6 THEN 'Anaerobic' END AS label1
FROM {part}
""",
    "machine2": """
SELECT p_partkey * 2 AS genus,
       CASE (p_partkey + p_size * 2) % 7 WHEN 0 THEN 'Aerobic' WHEN 1 THEN 'Anaerobic' WHEN 2 THEN 'Facultative Anaerobic'
            WHEN 3 THEN 'Unknown' WHEN 4 THEN 'Variable' WHEN 5 THEN 'Not applicable' END AS label2
FROM {part}
""",
    "curator": """
SELECT nullif(p_partkey * 3, 0) AS genus,
       CASE p_size % 6 WHEN 0 THEN 'Aerobic' WHEN 1 THEN 'Anaerobe' WHEN 2 THEN 'facultatively anaerobic'
            WHEN 3 THEN 'mixed' WHEN 4 THEN 'unknown' END AS expert
FROM {part}
""",
    "published": """
SELECT p_partkey + CAST(floor(p_partkey / 3) AS BIGINT) AS genus,
       CASE p_size % 5 WHEN 0 THEN 'aerotolerant' WHEN 1 THEN 'anaerobic' WHEN 2 THEN 'unknown' WHEN 3 THEN 'mixed' END AS paper
FROM {part}
""",
    "genotypes": """
SELECT l_suppkey AS ind, l_linenumber AS locus,
       CASE WHEN l_linenumber < 4 THEN 'panel1' ELSE 'panel2' END AS method,
       nullif(CAST(sum(l_quantity) AS BIGINT) % 5, 4) AS a,
       nullif(CAST(sum(l_quantity) AS BIGINT) % 5, 4) * 0 + CAST(sum(l_partkey) AS BIGINT) % 4 AS b
FROM {lineitem} GROUP BY l_suppkey, l_linenumber
""",
}



def _uses(text: str, known) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"(?:FROM|JOIN)\s+(\w+)", text)) if n in known]


def _closure(names, known) -> list[str]:
    out: list[str] = []
    for n in names:
        for m in [*_closure(_uses(known[n], known), known), n]:
            if m not in out:
                out.append(m)
    return out


def with_views(sql: str, tables: dict[str, str] | None = None, more: dict[str, str] | None = None) -> str:
    """``sql`` preceded by the definitions of all views it reads, directly or not."""
    known = {**VIEWS, **(more or {})}
    tables = tables or {t: t for t in TABLES}
    names = _closure(_uses(sql, known), known)
    if not names:
        return sql
    text = ",\n".join(f"{n} AS ({known[n].strip().format(**tables)})" for n in names)
    joiner = ",\n" if sql.lstrip().startswith("WITH ") else "\n"
    return f"WITH {text}{joiner}{sql.lstrip().removeprefix('WITH ') if joiner != chr(10) else sql}"


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    tables = {t: f"parquet.`{folder}/{t}.parquet`" for t in TABLES}
    return spark.sql(with_views(f"SELECT * FROM {name}", tables))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
