"""Sources, sinks, projection, filters, joins, aggregation, windows, reshape and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadspark import functions as fx
from dyadspark.operators import community, distance, dyads, relational as rel, reshape, roster
from dyadspark.plans import pair_similarity as plan
from dyadspark.queries.registry import Study, query, quoted
from dyadspark.session import shared_folder
from dyadspark.sources import readers, writers

# ---- sources and sinks: write a table, read it back, compare with the table ----

_CUSTOMER = [("c_custkey", "id", "bigint"), ("c_name", "name", "string"), ("c_acctbal", "balance", "double")]
_CUSTOMER_SQL = "SELECT c_custkey AS id, c_name AS name, round(c_acctbal, 6) AS balance FROM customer"


def _customer(s: Study):
    return s.table("customer").select("c_custkey", "c_name", "c_acctbal")


@query("a1_csv_scan", _CUSTOMER_SQL)
def _(s: Study):
    path = shared_folder(s.spark)
    padded = _customer(s).withColumn("c_name", F.concat(F.lit(" "), "c_name"))
    writers.write_csv(padded, path)
    return readers.read_csv(s.spark, path, _CUSTOMER)


@query("a2_tsv_scan", _CUSTOMER_SQL)
def _(s: Study):
    path = shared_folder(s.spark)
    writers.write_tsv(_customer(s), path)
    return readers.read_tsv(s.spark, path, _CUSTOMER)


@query("a3_typed_date", "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day FROM orders")
def _(s: Study):
    path = shared_folder(s.spark)
    text = s.table("orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("o_orderdate"))
    writers.write_csv(text, path)
    return readers.read_csv(s.spark, path, [("o_orderkey", "id", "bigint"), ("o_orderdate", "day", "day")])


@query("a4_community_load", """
SELECT a.sample_id, a.taxon_id, a.n, t.genus, s.age_class FROM abund a JOIN taxonomy t ON a.taxon_id = t.taxon_id
JOIN sites s ON a.sample_id = s.sample_id""")
def _(s: Study):
    path = shared_folder(s.spark)
    writers.write_community(community.Community(s.view("abund"), s.view("taxonomy"), s.view("sites")), path)
    loaded = readers.read_community(s.spark, path)
    return community.melt_community(loaded).select("sample_id", "taxon_id", "n", "genus", "age_class")


# every individual at every locus; untyped loci have missing alleles
_GRID_SQL = """
FROM (SELECT DISTINCT ind FROM genotypes) i CROSS JOIN (SELECT DISTINCT locus FROM genotypes) l
LEFT JOIN genotypes g ON g.ind = i.ind AND g.locus = l.locus"""


def _values(df, column: str) -> list:
    """The distinct values of a column that names columns, in order; their number is that of the columns made."""
    return [r[0] for r in df.select(column).distinct().orderBy(column).collect()]


def _write_genotypes(s: Study):
    """The genotypes written as headerless text; the path and the loci."""
    from dyadspark.operators.genetics import genotypes_wide

    path, loci = shared_folder(s.spark), _values(s.view("genotypes"), "locus")
    writers.write_delimited(genotypes_wide(s.view("genotypes"), loci), path, " ", False)
    return path, loci


@query("a5_genotype_text_scan", f"""
SELECT i.ind, CAST(l.locus AS VARCHAR) AS locus, CAST(g.a AS INTEGER) AS a, CAST(g.b AS INTEGER) AS b {_GRID_SQL}""")
def _(s: Study):
    path, loci = _write_genotypes(s)
    return readers.read_genotype_text(s.spark, path, [str(l) for l in loci])


@query("a6_wide_counts_to_long", """
SELECT CAST(l_linenumber AS VARCHAR) AS sample_id, l_partkey AS taxon_id, CAST(sum(l_quantity) AS BIGINT) AS n
FROM lineitem GROUP BY l_linenumber, l_partkey""")
def _(s: Study):
    lines = s.table("lineitem")
    wide = lines.groupBy("l_partkey").pivot("l_linenumber", _values(lines, "l_linenumber")).agg(F.sum("l_quantity").cast("bigint"))
    return reshape.counts_from_wide(wide, "l_partkey")


@query("a7_csv_sink", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey")
def _(s: Study):
    path = shared_folder(s.spark)
    writers.write_csv(rel.count_by(s.table("orders"), "o_custkey"), path)
    return readers.read_csv(s.spark, path, [("o_custkey", "o_custkey", "bigint"), ("n", "n", "bigint")])


@query("a8_tsv_sink", "SELECT taxon_id, family, genus FROM taxonomy")
def _(s: Study):
    path = shared_folder(s.spark)
    writers.write_tsv(s.view("taxonomy"), path)
    return readers.read_tsv(s.spark, path, [(c, c, "string") for c in ("taxon_id", "family", "genus")])


@query("a9_headerless_sink", f"""
SELECT ind || ' ' || string_agg(coalesce(CAST(a AS VARCHAR), 'NA') || ' ' || coalesce(CAST(b AS VARCHAR), 'NA'), ' ' ORDER BY locus)
  AS line FROM (SELECT i.ind, l.locus, g.a, g.b {_GRID_SQL}) t GROUP BY ind""")
def _(s: Study):
    path, _ = _write_genotypes(s)
    return s.spark.read.text(path).select(F.col("value").alias("line"))


@query("a10_pair_table_store", """
SELECT year, season, pair_type, CAST(list_position(['diffGroup', 'Dominantpair', 'DomHelp', 'DomSub', 'HelpSub', 'SubSub',
  'sameTerrothers', 'sameBird'], pair_type) AS INTEGER) AS level, count(*) AS n
FROM c_typed GROUP BY year, season, pair_type""")
def _(s: Study):
    path = shared_folder(s.spark)
    writers.write_pair_table(s.pairs, path)
    back = writers.read_pair_table(s.spark, path, {"pair_type": dyads.PAIR_TYPES})
    return rel.count_by(back, F.col("year").cast("bigint").alias("year"), "season", "pair_type", F.col("pair_type_rank").alias("level"))


# ---- projection ----


@query("b1_select", "SELECT sample_id, bird_id, role FROM samples")
def _(s: Study):
    return s.view("samples").select("sample_id", "bird_id", "role")


@query("b2_drop_columns", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def _(s: Study):
    odd = s.table("orders").withColumnsRenamed({"o_totalprice": "total;price", "o_orderdate": "...1"})
    return odd.drop("total;price", "...1", "o_orderpriority")


@query("b3_select_by_prefix", "SELECT l_linenumber, l_linestatus, l_returnflag FROM lineitem")
def _(s: Study):
    lines = s.table("lineitem")
    return lines.select(*reshape.columns_starting(lines, "l_line", "l_return"))


@query("b4_select_all", "SELECT genus, label1 FROM machine1")
def _(s: Study):
    source = s.view("machine1")
    return source.select(*source.columns)


_INTERLEAVED = ", ".join(
    f"max(CASE WHEN locus = {l} THEN {p} END) AS \"{l}_{p}\"" for l in range(1, 8) for p in ("a", "b")
)


@query("b5_interleave_columns", f"SELECT ind, {_INTERLEAVED} FROM genotypes GROUP BY ind")
def _(s: Study):
    genotypes = s.view("genotypes")
    loci = _values(genotypes, "locus")
    wide = reshape.pivot_values(genotypes, ["ind"], "locus", loci, {"b": "b", "a": "a"})
    return wide.select(*reshape.interleave(["ind"], ["a", "b"], [str(l) for l in loci]))


@query("b6_rename", "SELECT genus, label1 AS machine FROM machine1")
def _(s: Study):
    return s.view("machine1").withColumnsRenamed({"label1": "machine"})


@query("b7_add_columns", """
SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 6) AS net, l_quantity > 25 AS bulky FROM lineitem""")
def _(s: Study):
    return s.table("lineitem").withColumns(
        {"net": F.col("l_extendedprice") * (1 - F.col("l_discount")), "bulky": F.col("l_quantity") > 25}
    ).select("l_orderkey", "l_linenumber", "l_partkey", "net", "bulky")


@query("b8_literal_column", "SELECT role, count(*) AS n, 0 AS value FROM samples GROUP BY role")
def _(s: Study):
    return rel.count_by(s.view("samples"), "role").withColumn("value", F.lit(0))


@query("b9_row_key", "SELECT sample_id, bird_id FROM samples")
def _(s: Study):
    return rel.assert_unique_key(s.view("samples"), ["sample_id"]).select("sample_id", "bird_id")


@query("b10_casts", """
SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS urgency, TRY_CAST(o_orderpriority AS DOUBLE) AS bad,
  CAST(o_orderdate AS DATE) AS day FROM orders""")
def _(s: Study):
    day = fx.parse_day(F.date_format("o_orderdate", "dd/MM/yyyy"))
    return s.table("orders").select(
        "o_orderkey",
        fx.to_number(F.substring("o_orderpriority", 1, 1), "int").alias("urgency"),
        fx.to_number("o_orderpriority").alias("bad"),
        day.alias("day"),
    )


_RANK_SQL = f"coalesce(list_position([{quoted(roster.ROSTER_ROLES)}], role), 999)"


@query("b11_level_order", f"SELECT sample_id, CAST({_RANK_SQL} AS INTEGER) AS level FROM samples")
def _(s: Study):
    return s.view("samples").select("sample_id", fx.level_rank("role", roster.ROSTER_ROLES).alias("level"))


_BRANDS = [f"Brand#{i}" for i in range(26)]


@query("b12_sample_matrix", "SELECT sample_id, " + ", ".join(
    f"coalesce(max(CASE WHEN taxon_id = '{b}' THEN n END), 0) AS \"{b}\"" for b in _BRANDS
) + " FROM order_abund GROUP BY sample_id")
def _(s: Study):
    counts = s.view("order_abund")
    return community.sample_matrix(counts, _values(counts, "taxon_id"))


# ---- filters ----


@query("c1_comparison", "SELECT off_id, parent FROM offspring WHERE confidence > 80")
def _(s: Study):
    return s.view("offspring").where(F.col("confidence") > 80).select("off_id", "parent")


@query("c2_in_set", "SELECT genus, label1 FROM machine1 WHERE label1 IN ('Aerobic', 'Anaerobic')")
def _(s: Study):
    return s.view("machine1").where(fx.in_set("label1", ["Aerobic", "Anaerobic"]))


@query("c3_not_in_set", "SELECT genus, label1 FROM machine1 WHERE label1 IS NULL OR label1 NOT IN ('Aerobic', 'Anaerobic')")
def _(s: Study):
    return s.view("machine1").where(fx.not_in_set("label1", ["Aerobic", "Anaerobic"]))


@query("c4_null_tests", "SELECT genus IS NULL AS unnamed, count(label1) AS labelled, count(*) AS n FROM machine1 GROUP BY 1")
def _(s: Study):
    return s.view("machine1").groupBy(F.col("genus").isNull().alias("unnamed")).agg(
        F.count("label1").alias("labelled"), F.count(F.lit(1)).alias("n")
    )


@query("c5_compound", """
SELECT sample_id FROM samples WHERE (role IN ('BrM', 'BrF') AND season = 'Major') OR (role = 'H' AND sex IS NOT NULL)""")
def _(s: Study):
    breeder = fx.in_set("role", ["BrM", "BrF"]) & (F.col("season") == "Major")
    helper = (F.col("role") == "H") & F.col("sex").isNotNull()
    return s.view("samples").where(breeder | helper).select("sample_id")


@query("c6_filter_samples", """
SELECT a.sample_id, a.taxon_id, a.n FROM abund a JOIN sites s ON a.sample_id = s.sample_id WHERE s.age_class IN ('A', 'SA', 'OFL')""")
def _(s: Study):
    kept, _ = community.filter_samples(s.view("abund"), s.view("sites"), fx.in_set("age_class", ["A", "SA", "OFL"]))
    return kept


@query("c7_keep_taxa", "SELECT sample_id, taxon_id, n FROM abund WHERE taxon_id IN (SELECT taxon_id FROM c_core)")
def _(s: Study):
    return s.core


# ---- joins ----


@query("d1_inner_merge", """
SELECT a.genus, label1, expert FROM machine1 a JOIN curator b ON a.genus IS NOT DISTINCT FROM b.genus""")
def _(s: Study):
    return rel.merge_tables(s.view("machine1"), s.view("curator"), ["genus"], "inner")


@query("d2_left_merge", "SELECT a.genus, paper, expert FROM published a LEFT JOIN curator b ON a.genus = b.genus")
def _(s: Study):
    return rel.merge_tables(s.view("published"), s.view("curator"), ["genus"], "left")


@query("d3_full_merge", """
SELECT coalesce(a.genus, b.genus) AS genus, label1, expert FROM machine1 a FULL JOIN curator b
ON a.genus IS NOT DISTINCT FROM b.genus""")
def _(s: Study):
    return rel.merge_tables(s.view("machine1"), s.view("curator"), ["genus"], "full")


@query("d4_composite_key", """
SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, t.lines FROM lineitem l LEFT JOIN
(SELECT l_partkey, l_suppkey, count(*) AS lines FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1) t
ON l.l_partkey = t.l_partkey AND l.l_suppkey = t.l_suppkey""")
def _(s: Study):
    lines = s.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    side = rel.count_by(lines, F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), name="lines")
    side = side.where(F.col("lines") > 1)
    return rel.lookup(lines, side, [("l_partkey", "pk"), ("l_suppkey", "sk")])


@query("d5_differing_key", "SELECT o_orderkey, o_custkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(s: Study):
    orders = s.table("orders").select("o_orderkey", "o_custkey")
    return rel.lookup(orders, s.table("customer"), [("o_custkey", "c_custkey")], cols=["c_mktsegment"])


@query("d6_both_ends", """
SELECT e.bird_a, e.bird_b, a.first_territory_id AS first_territory_id_x, b.first_territory_id AS first_territory_id_y
FROM edges e LEFT JOIN c_natal a ON e.bird_a = a.bird_id LEFT JOIN c_natal b ON e.bird_b = b.bird_id""")
def _(s: Study):
    ends = s.view("edges").select("bird_a", "bird_b")
    return rel.attach_both_ends(ends, s.natal_slots, "bird_id", ("bird_a", "bird_b"), ["first_territory_id"])


@query("d7_null_safe_keys", """
SELECT a.genus IS NULL AS unnamed, count(*) AS n FROM machine1 a JOIN curator b ON a.genus IS NOT DISTINCT FROM b.genus GROUP BY 1""")
def _(s: Study):
    joined = rel.merge_tables(s.view("machine1"), s.view("curator"), ["genus"], "inner")
    return rel.count_by(joined, F.col("genus").isNull().alias("unnamed"))


@query("d8_unordered_pairs", """
SELECT a.territory_id, a.sample_id AS sample_id_x, b.sample_id AS sample_id_y
FROM samples a JOIN samples b ON a.territory_id = b.territory_id AND a.sample_id < b.sample_id""")
def _(s: Study):
    rows = s.view("samples").select("territory_id", "sample_id")
    return distance.pair_within(rows, ["territory_id"], "sample_id")


@query("d9_season_pairs", """
SELECT a.year, a.season, count(*) AS pairs, count(DISTINCT a.sample_id) AS first_samples
FROM samples a JOIN samples b ON a.year = b.year AND a.season = b.season AND a.ord < b.ord GROUP BY a.year, a.season""")
def _(s: Study):
    rows = s.view("samples").select("year", "season", "sample_id")
    pairs = distance.pair_within(rows, ["year", "season"], "sample_id")
    return pairs.groupBy("year", "season").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_distinct("sample_id_x").alias("first_samples")
    )


@query("d10_semi_join", "SELECT * FROM status s WHERE EXISTS (SELECT 1 FROM c_first f WHERE f.group_id = s.group_id)")
def _(s: Study):
    first = roster.first_records(s.view("status"), s.view("groups"))
    return s.view("status").join(first.select("group_id"), "group_id", "left_semi")


@query("d11_fan_out", """
SELECT f.bird_id, s.bird_id AS member_id, s.role FROM c_first f JOIN status s ON f.group_id = s.group_id""")
def _(s: Study):
    first = roster.first_records(s.view("status"), s.view("groups")).select("group_id", "bird_id")
    members = s.view("status").select("group_id", F.col("bird_id").alias("member_id"), "role")
    return rel.merge_tables(first, members, ["group_id"], "inner", null_safe=False).drop("group_id")


@query("d12_join_chain", """
SELECT g.genus, a.label1 AS machine1, b.label2 AS machine2, c.expert AS curator, d.paper AS published FROM genera g
LEFT JOIN machine1 a ON g.genus = a.genus LEFT JOIN machine2 b ON g.genus = b.genus
LEFT JOIN curator c ON g.genus = c.genus LEFT JOIN published d ON g.genus = d.genus""")
def _(s: Study):
    return rel.attach_many(s.view("genera"), "genus", [
        (s.view("machine1"), "label1", "machine1"), (s.view("machine2"), "label2", "machine2"),
        (s.view("curator"), "expert", "curator"), (s.view("published"), "paper", "published"),
    ])


# ---- distinct and aggregation ----


@query("e1_distinct", "SELECT DISTINCT genus FROM taxonomy")
def _(s: Study):
    return s.view("taxonomy").select("genus").distinct()


@query("e2_first_per_key", """
SELECT bird_id, role, status_id FROM (SELECT *, row_number() OVER (PARTITION BY bird_id ORDER BY status_id) AS rn FROM status) r
WHERE rn = 1""")
def _(s: Study):
    return rel.first_by(s.view("status"), ["bird_id"], ["status_id"]).select("bird_id", "role", "status_id")


@query("e3_first_per_key_in_group", """
SELECT group_id, role, bird_id, status_id FROM (
SELECT *, row_number() OVER (PARTITION BY group_id, role, bird_id ORDER BY status_id) AS rn FROM status) r WHERE rn = 1""")
def _(s: Study):
    return rel.first_by(s.view("status"), ["group_id", "role", "bird_id"], ["status_id"])


@query("e4_distinct_sorted", "SELECT DISTINCT year, season FROM samples ORDER BY year, season")
def _(s: Study):
    return s.view("samples").select("year", "season").distinct().orderBy("year", "season")


@query("f1_count_per_group", "SELECT role, season, count(*) AS n FROM samples GROUP BY role, season")
def _(s: Study):
    return rel.count_by(s.view("samples"), "role", "season")


@query("f2_global_count", "SELECT count(*) AS n FROM abund")
def _(s: Study):
    return rel.count_by(s.view("abund"))


def _summary_sql(cols, policy="propagate"):
    def guard(c, e):
        return e if policy == "skip" else f"CASE WHEN count({c}) = count(*) THEN {e} END"

    parts = []
    for c in cols:
        n = f"count({c})" if policy == "skip" else "count(*)"
        for stat, e in (
            ("min", f"min({c})"), ("max", f"max({c})"), ("mean", f"round(avg({c}), 6)"),
            ("sd", f"round(stddev_samp({c}), 6)"), ("se", f"round(stddev_samp({c}) / sqrt({n}), 6)"),
        ):
            parts.append(f"{guard(c, e)} AS {c}_{stat}")
    return ", ".join(parts)


@query("f3_describe", f"SELECT role, {_summary_sql(['catch_time', 'time_in_fridge'])} FROM samples GROUP BY role")
def _(s: Study):
    return fx.summarise_columns(s.view("samples"), ["catch_time", "time_in_fridge"], ["role"])


@query("f3_describe_skip_missing", f"SELECT role, {_summary_sql(['catch_time'], 'skip')} FROM samples GROUP BY role")
def _(s: Study):
    return fx.summarise_columns(s.view("samples"), ["catch_time"], ["role"], na_policy="skip")


@query("f4_sum_per_group", "SELECT sample_id, CAST(sum(n) AS BIGINT) AS reads FROM abund GROUP BY sample_id")
def _(s: Study):
    return s.view("abund").groupBy("sample_id").agg(F.sum("n").alias("reads"))


@query("f5_mean_of_counts", """
SELECT round(avg(n), 6) AS mean, round(stddev_samp(n) / sqrt(count(*)), 6) AS se
FROM (SELECT count(*) AS n FROM samples GROUP BY group_id) c""")
def _(s: Study):
    return rel.mean_of_counts(s.view("samples"), ["group_id"])


@query("f6_entities_at_both_ends", """
SELECT relation, count(DISTINCT bird) AS n FROM (
SELECT relation, bird_id_x AS bird FROM c_typed UNION ALL SELECT relation, bird_id_y FROM c_typed) u GROUP BY relation""")
def _(s: Study):
    return rel.distinct_at_ends(s.pairs, ["bird_id_x", "bird_id_y"], ["relation"])


@query("f7_distinct_of_stack", """
SELECT count(DISTINCT b) AS n FROM (SELECT bird_a AS b FROM edges UNION ALL SELECT bird_b FROM edges) u""")
def _(s: Study):
    return rel.distinct_at_ends(s.view("edges"), ["bird_a", "bird_b"])


@query("f8_nonnull_cells", """
SELECT sample_id, CAST((catch_time IS NOT NULL) AS INTEGER) + CAST((sex IS NOT NULL) AS INTEGER) + 1 AS filled FROM samples""")
def _(s: Study):
    return s.view("samples").select("sample_id", fx.nonnull_count("catch_time", "sex", "role").alias("filled"))


@query("f9_agreement_rate", """
SELECT round(avg(CASE WHEN label1 = 'Anaerobic' AND expert = 'Anaerobe' THEN 1.0E0 ELSE 0.0E0 END), 6) AS agreement
FROM machine1 a JOIN curator b ON a.genus = b.genus""")
def _(s: Study):
    joined = rel.merge_tables(s.view("machine1"), s.view("curator"), ["genus"], null_safe=False)
    same = (F.col("label1") == "Anaerobic") & (F.col("expert") == "Anaerobe")
    return rel.agreement_rate(joined.withColumn("conflict", F.when(same, "0").otherwise("1")))


@query("f10_distinct_per_group", "SELECT method, count(DISTINCT locus) AS n FROM genotypes GROUP BY method")
def _(s: Study):
    from dyadspark.operators.genetics import loci_per_method

    return loci_per_method(s.view("genotypes"))


# ---- windows ----


@query("w1_best_role", f"""
SELECT bird_id, period_id, group_id, role FROM (
SELECT s.*, g.period_id, row_number() OVER (PARTITION BY s.bird_id, g.period_id ORDER BY
  list_position([{quoted(roster.ROLE_PRIORITY)}], s.role), s.group_id) AS rn
FROM status s JOIN groups g ON s.group_id = g.group_id) r WHERE rn = 1""")
def _(s: Study):
    best = roster.best_roles(s.view("status"), s.view("groups"), roster.ROLE_PRIORITY)
    return best.select("bird_id", "period_id", "group_id", "role")


@query("w2_running_number", """
SELECT group_id, status_id, row_number() OVER (PARTITION BY group_id ORDER BY status_id) AS nth FROM status""")
def _(s: Study):
    return rel.running_number(s.view("status"), ["group_id"], "status_id", "nth").select("group_id", "status_id", "nth")


@query("w3_distinct_over_group", """
SELECT s.bird_id, s.role, s.status_id, d.n_roles FROM status s
JOIN (SELECT bird_id, count(DISTINCT role) AS n_roles FROM status GROUP BY bird_id) d ON s.bird_id = d.bird_id""")
def _(s: Study):
    wide = rel.distinct_over(s.view("status"), ["bird_id"], "role", "n_roles")
    return wide.select("bird_id", "role", "status_id", "n_roles")


@query("w4_dense_id", "SELECT bird_a, bird_b, dense_rank() OVER (ORDER BY bird_a, bird_b) AS dyad_id FROM edges")
def _(s: Study):
    return rel.dense_id(s.view("edges").select("bird_a", "bird_b"), ("bird_a", "bird_b"), "dyad_id")


@query("w5_standardise", """
SELECT sample_id, round((catch_time - m) / (2 * d), 6) AS catch_time_scaled FROM samples,
(SELECT avg(catch_time) AS m, stddev_samp(catch_time) AS d FROM samples) t""")
def _(s: Study):
    return rel.standardise(s.view("samples"), ["catch_time"]).select("sample_id", "catch_time_scaled")


@query("w6_share_of_total", "SELECT sample_id, taxon_id, round(n / sum(n) OVER (PARTITION BY sample_id), 6) AS share FROM abund")
def _(s: Study):
    return rel.share_of_group(s.view("abund"), ["sample_id"], "n", "share").select("sample_id", "taxon_id", "share")


@query("w7_centre_on_mean", "SELECT sample_id, taxon_id, round(n - avg(n) OVER (PARTITION BY sample_id), 6) AS centred FROM abund")
def _(s: Study):
    return rel.centre_on_group(s.view("abund"), ["sample_id"], "n", "centred").select("sample_id", "taxon_id", "centred")


# ---- sort, union, reshape ----


@query("h1_sort", "SELECT year, season, sample_id FROM samples ORDER BY year, season, sample_id")
def _(s: Study):
    return s.view("samples").select("year", "season", "sample_id").orderBy("year", "season", "sample_id")


@query("h2_sort_descending", "SELECT bird_id, count(*) AS n FROM samples GROUP BY bird_id ORDER BY n DESC, bird_id")
def _(s: Study):
    return rel.count_by(s.view("samples"), "bird_id").orderBy(F.desc("n"), "bird_id")


@query("h3_sort_by_level", f"SELECT group_id, role, sample_id FROM samples ORDER BY group_id, {_RANK_SQL}, sample_id")
def _(s: Study):
    rows = s.view("samples").select("group_id", "role", "sample_id")
    return rows.orderBy("group_id", fx.level_rank("role", roster.ROSTER_ROLES), "sample_id")


@query("h4_union", "SELECT bird_a AS bird_id, relatedness FROM edges UNION ALL SELECT bird_b, relatedness FROM edges")
def _(s: Study):
    edges = s.view("edges")
    first = edges.select(F.col("bird_a").alias("bird_id"), "relatedness")
    return first.unionByName(edges.select("relatedness", F.col("bird_b").alias("bird_id")))


_ROLES3 = ["BrM", "BrF", "H"]
_LIST_SQL = ", ".join(
    f"coalesce(string_agg(CASE WHEN role = '{r}' THEN CAST(bird_id AS VARCHAR) END, ',' ORDER BY bird_id), '') AS {r}"
    for r in _ROLES3
)


@query("p1_pivot_lists", f"SELECT group_id, {_LIST_SQL} FROM c_best GROUP BY group_id")
def _(s: Study):
    lists = reshape.pivot_lists(s.best, ["group_id"], "role", "bird_id", _ROLES3)
    return lists.select("group_id", *[F.array_join(F.transform(r, lambda b: b.cast("string")), ",").alias(r) for r in _ROLES3])


@query("p2_spread_lists", f"""
SELECT group_id, role || '_' || row_number() OVER (PARTITION BY group_id, role ORDER BY bird_id) AS cell, bird_id
FROM c_best WHERE role IN ({quoted(_ROLES3)})""")
def _(s: Study):
    lists = reshape.pivot_lists(s.best, ["group_id"], "role", "bird_id", _ROLES3)
    wide = reshape.spread_lists(lists, _ROLES3)
    return reshape.melt(wide, ["group_id"], [c for c in wide.columns if c != "group_id"], "cell", "bird_id", drop_null=True)


@query("p3_wide_to_long", """
SELECT sample_id, 'catch_time' AS measure, catch_time AS value FROM samples
UNION ALL SELECT sample_id, 'time_in_fridge', time_in_fridge FROM samples""")
def _(s: Study):
    return reshape.melt(s.view("samples"), ["sample_id"], ["catch_time", "time_in_fridge"], "measure", "value")


@query("p4_pivot_two_values", f"SELECT ind, {_INTERLEAVED} FROM genotypes GROUP BY ind")
def _(s: Study):
    genotypes = s.view("genotypes")
    return reshape.pivot_values(genotypes, ["ind"], "locus", _values(genotypes, "locus"), {"a": "a", "b": "b"})


@query("p5_matrix_to_triples", """
SELECT sample_id_x, sample_id_y, round(-distance, 6) AS similarity FROM c_distance WHERE distance > 0.000000001""")
def _(s: Study):
    ratios = plan.core_log_ratios(s.counts)
    pairs = distance.distance_tiles(ratios, s.view("sites").select("period_id", "sample_id", "ord"), ["period_id"])
    return distance.similarity(pairs).select("sample_id_x", "sample_id_y", "similarity")


@query("p6_melt_community", """
SELECT a.sample_id, a.taxon_id, a.n, t.family, t.genus, s.bird_id, s.season FROM abund a
JOIN taxonomy t ON a.taxon_id = t.taxon_id JOIN sites s ON a.sample_id = s.sample_id""")
def _(s: Study):
    whole = community.assemble(s.view("abund"), s.view("taxonomy"), s.view("sites"))
    return community.melt_community(whole).select("sample_id", "taxon_id", "n", "family", "genus", "bird_id", "season")


# ---- scalar functions ----


@query("x1_case_when", """
SELECT sample_id, CASE WHEN role IN ('BrM', 'BrF') THEN 'Dom' WHEN role IN ('AB', 'ABX', 'H') THEN 'Sub' ELSE 'Other' END AS class
FROM samples""")
def _(s: Study):
    return s.view("samples").select("sample_id", dyads.role_class("role").alias("class"))


@query("x2_abs_and_minus", "SELECT s_suppkey, round(-abs(s_acctbal - 5000), 6) AS v FROM supplier")
def _(s: Study):
    return s.table("supplier").select("s_suppkey", (-F.abs(F.col("s_acctbal") - 5000)).alias("v"))


@query("x3_round_half_even", "SELECT l_orderkey, l_partkey, l_quantity, round_even(l_quantity / 2, 0) AS half FROM lineitem")
def _(s: Study):
    half = fx.round_half_even(F.col("l_quantity") / 2)
    return s.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity", half.alias("half"))


@query("x4_strict_least_greatest", """
SELECT sample_id, CASE WHEN catch_time IS NOT NULL AND sex IS NOT NULL THEN least(catch_time, sex) END AS low,
  CASE WHEN catch_time IS NOT NULL AND sex IS NOT NULL THEN greatest(catch_time, sex) END AS high FROM samples""")
def _(s: Study):
    return s.view("samples").select(
        "sample_id", fx.strict_least("catch_time", "sex").alias("low"), fx.strict_greatest("catch_time", "sex").alias("high")
    )


@query("x5_days_apart", """
SELECT l_orderkey, l_partkey, l_suppkey, CAST(abs(CAST(l_shipdate AS DATE) - CAST(o_orderdate AS DATE)) AS INTEGER) AS days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(s: Study):
    orders = s.table("orders").select("o_orderkey", F.to_date("o_orderdate").alias("ordered"))
    joined = rel.lookup(s.table("lineitem"), orders, [("l_orderkey", "o_orderkey")], "inner")
    return joined.select("l_orderkey", "l_partkey", "l_suppkey", fx.days_apart(F.to_date("l_shipdate"), "ordered").alias("days"))


@query("x6_replace_missing", "SELECT sample_id, coalesce(catch_time, 43292) AS catch_time FROM samples")
def _(s: Study):
    return s.view("samples").select("sample_id", F.coalesce("catch_time", F.lit(43292).cast("bigint")).alias("catch_time"))


@query("x7_sqrt_and_divide", "SELECT sample_id, round(sqrt(time_in_fridge) / nullif(sex, 0), 6) AS v FROM samples")
def _(s: Study):
    return s.view("samples").select("sample_id", F.try_divide(F.sqrt("time_in_fridge"), F.col("sex")).alias("v"))


@query("x8_equality", "SELECT role_x = role_y AS same_role, count(*) AS n FROM c_typed GROUP BY 1")
def _(s: Study):
    return rel.count_by(s.pairs, (F.col("role_x") == F.col("role_y")).alias("same_role"))


@query("x9_missing_in_condition", """
SELECT genus, CASE WHEN label1 IN ('Anaerobic') THEN 'Anaerobic' WHEN label1 IS NOT NULL THEN 'Unknown' ELSE 'Unassigned' END AS label
FROM machine1""")
def _(s: Study):
    label = F.when(fx.in_set("label1", ["Anaerobic"]), "Anaerobic").when(F.col("label1").isNotNull(), "Unknown")
    return s.view("machine1").select("genus", label.otherwise("Unassigned").alias("label"))


@query("x10_log", "SELECT sample_id, taxon_id, round(ln(n + 0.5E0), 6) AS v FROM abund")
def _(s: Study):
    return s.view("abund").select("sample_id", "taxon_id", F.ln(F.col("n") + 0.5).alias("v"))
