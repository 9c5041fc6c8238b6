"""Community, roster, dyad, annotation, genetics, model and figure queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadspark.functions import summarise_columns
from dyadspark.operators import annotate, community, distance, dyads, figures, genetics, mixed, mixed_fit, roster
from dyadspark.operators import relational as rel
from dyadspark.plans import models, pair_similarity as plan
from dyadspark.queries.registry import ORDER_DEPTH, Study, query, quoted
from dyadspark.queries.relational import _INTERLEAVED, _summary_sql, _values
from dyadspark.session import materialise

RANKS = ["family", "genus"]


@query("flagship_similarity_by_pair_type", """
SELECT pair_type, count(*) AS pairs, round(avg(similarity), 6) AS mean_similarity, round(stddev_samp(similarity), 6) AS sd_similarity
FROM c_similar GROUP BY pair_type""")
def _(s: Study):
    return plan.similarity_by_class(s.similar_pairs)


@query("flagship_similarity_by_relation", """
SELECT relation, count(*) AS pairs, round(avg(similarity), 6) AS mean_similarity, round(stddev_samp(similarity), 6) AS sd_similarity
FROM c_similar GROUP BY relation""")
def _(s: Study):
    return plan.similarity_by_class(s.similar_pairs, "relation")


# ---- community ----


@query("k1_assemble", """
SELECT sample_id, count(*) AS taxa, CAST(sum(n) AS BIGINT) AS reads FROM abund a
WHERE EXISTS (SELECT 1 FROM sites s WHERE s.sample_id = a.sample_id)
  AND EXISTS (SELECT 1 FROM taxonomy t WHERE t.taxon_id = a.taxon_id AND t.genus IS NOT NULL) GROUP BY sample_id""")
def _(s: Study):
    named = s.view("taxonomy").where(F.col("genus").isNotNull())
    whole = community.assemble(s.view("abund"), named, s.view("sites"))
    return whole.abundance.groupBy("sample_id").agg(F.count(F.lit(1)).alias("taxa"), F.sum("n").alias("reads"))


@query("k2_relative_abundance", "SELECT sample_id, taxon_id, round(share, 6) AS share FROM c_share")
def _(s: Study):
    return community.relative_abundance(s.view("abund")).select("sample_id", "taxon_id", "share")


@query("k3_core_taxa", """
SELECT taxon_id FROM c_share GROUP BY taxon_id HAVING count(CASE WHEN share > 0.002 THEN 1 END) / (SELECT count(DISTINCT sample_id) FROM c_share) > 0.4""")
def _(s: Study):
    return community.core_taxa(community.relative_abundance(s.view("abund")), 0.002, 0.4)


@query("k4_log_ratio", "SELECT sample_id, taxon_id, round(clr, 6) AS clr FROM c_clr WHERE n > 0")
def _(s: Study):
    return community.log_ratio(s.core).select("sample_id", "taxon_id", "clr")


@query("k4_log_ratio_absent", "SELECT sample_id, round(min(clr), 6) AS clr_absent FROM c_clr WHERE n = 0 GROUP BY sample_id")
def _(s: Study):
    ratios = community.log_ratio(s.core)
    taxa = distance.taxon_count(ratios)
    per_sample = ratios.groupBy("sample_id").agg(F.min("clr_absent").alias("clr_absent"), F.count(F.lit(1)).alias("k"))
    return per_sample.where(F.col("k") < taxa).select("sample_id", "clr_absent")


@query("k4_log_ratio_replace_zero", """
SELECT sample_id, taxon_id, round(clr, 6) AS clr FROM (
SELECT sample_id, taxon_id, n, v - avg(v) OVER (PARTITION BY sample_id) AS clr FROM (
SELECT sample_id, taxon_id, n, ln(CASE WHEN share > 0 THEN share ELSE (SELECT min(share) / 2 FROM c_gridshare WHERE share > 0) END) AS v
FROM c_gridshare) l) c WHERE n > 0""")
def _(s: Study):
    return community.log_ratio(s.core, "replace_zero").select("sample_id", "taxon_id", "clr")


@query("k5_rarefy", "SELECT sample_id, taxon_id, n FROM c_rare")
def _(s: Study):
    return community.rarefy(s.counts)


@query("k5_rarefy_deep_counts")
def _(s: Study):
    return community.rarefy_deep(s.counts)


@query("k6_alpha_diversity", """
SELECT sample_id, observed, round(shannon, 6) AS shannon, round(chao1, 6) AS chao1 FROM c_alpha""")
def _(s: Study):
    return community.alpha_diversity(s.view("abund"))


@query("k6_alpha_with_metadata", """
SELECT s.sample_id, s.bird_id, coalesce(s.catch_time, 43292) AS catch_time, a.observed, round(a.shannon, 6) AS shannon
FROM sites s JOIN c_alpha a ON s.sample_id = a.sample_id""")
def _(s: Study):
    full = community.alpha_with_metadata(s.view("abund"), s.view("sites"))
    return full.select("sample_id", "bird_id", "catch_time", "observed", "shannon")


@query("k7_aitchison_blocked", """
SELECT sample_id_x, sample_id_y, round(distance, 6) AS distance FROM c_distance""")
def _(s: Study):
    sites = s.view("sites").select("period_id", "sample_id", "ord")
    ratios = plan.core_log_ratios(s.counts)
    return distance.distance_tiles(ratios, sites, ["period_id"])


@query("k7_aitchison_array_form", """
SELECT sample_id_x, sample_id_y, round(distance, 6) AS distance FROM c_distance""")
def _(s: Study):
    sites = s.view("sites").select("period_id", "sample_id", "ord")
    pairs = distance.aitchison_pairs(plan.core_log_ratios(s.counts), sites, ["period_id"])
    return pairs.select("sample_id_x", "sample_id_y", "distance")


@query("k7_aitchison_long_form", """
SELECT sample_id_x, sample_id_y, round(-similarity, 6) AS distance FROM c_similar WHERE relation = 'sameGroup'""")
def _(s: Study):
    pairs = dyads.within_group(s.pairs).select("sample_id_x", "sample_id_y")
    return distance.distance_long(s.order_ratios, pairs).where(F.col("distance") > 0)


@query("k8_similarity", """
SELECT sample_id_x, sample_id_y, round(similarity, 6) AS similarity FROM c_similar""")
def _(s: Study):
    return s.similar_pairs.select("sample_id_x", "sample_id_y", "similarity")


@query("k9_agglomerate", "SELECT sample_id, taxon_id, n FROM c_glomcounts")
def _(s: Study):
    counts, _ = community.agglomerate(s.counts, s.view("taxonomy"), RANKS)
    return counts


@query("k9_representatives", "SELECT family, genus, taxon_id FROM c_glom")
def _(s: Study):
    _, groups = community.agglomerate(s.counts, s.view("taxonomy"), RANKS)
    return groups


def _subset(s: Study, classes, members="representative"):
    return community.functional_subset(
        s.counts, s.view("taxonomy"), s.view("genus_class"), classes, RANKS, members
    )


_AEROBIC = ["Aerobic", "Facultative Anaerobic"]
_SUBSET_SQL = """
SELECT a.sample_id, a.taxon_id, a.n FROM abund a WHERE a.taxon_id IN
(SELECT g.taxon_id FROM c_glom g JOIN genus_class c ON g.genus = c.genus WHERE c.class IN ({classes}))"""


@query("k10_functional_subset", _SUBSET_SQL.replace("{classes}", quoted(_AEROBIC)))
def _(s: Study):
    return _subset(s, _AEROBIC)


@query("k10_functional_subset_all_members", """
SELECT a.sample_id, a.taxon_id, a.n FROM abund a JOIN taxonomy t ON a.taxon_id = t.taxon_id
JOIN genus_class c ON t.genus = c.genus WHERE c.class = 'Anaerobic'""")
def _(s: Study):
    return _subset(s, ["Anaerobic"], "all")


@query("k10_subset_distances", f"""
WITH c_sub AS ({_SUBSET_SQL.replace('{classes}', "'Anaerobic'")}),
c_subshare AS (SELECT sample_id, taxon_id, n, n / sum(n) OVER (PARTITION BY sample_id) AS share FROM c_sub),
c_subcore AS (SELECT taxon_id FROM c_subshare GROUP BY taxon_id
  HAVING count(CASE WHEN share > 0.00001 THEN 1 END) / (SELECT count(DISTINCT sample_id) FROM c_subshare) > 0.01),
c_subgrid AS (SELECT s.sample_id, c.taxon_id, coalesce(a.n, 0) AS n
  FROM (SELECT DISTINCT sample_id FROM c_sub) s CROSS JOIN c_subcore c
  LEFT JOIN c_sub a ON a.sample_id = s.sample_id AND a.taxon_id = c.taxon_id),
c_subgs AS (SELECT sample_id, taxon_id, n / sum(n) OVER (PARTITION BY sample_id) AS share FROM c_subgrid),
c_sublog AS (SELECT sample_id, taxon_id, ln(share + (SELECT min(share) / 2 FROM c_subgs WHERE share > 0)) AS v FROM c_subgs),
c_subclr AS (SELECT l.sample_id, taxon_id, s.period_id, v - avg(v) OVER (PARTITION BY l.sample_id) AS clr
  FROM c_sublog l JOIN sites s ON l.sample_id = s.sample_id)
SELECT a.sample_id AS sample_id_x, b.sample_id AS sample_id_y, round(-sqrt(sum((a.clr - b.clr) * (a.clr - b.clr))), 6) AS similarity
FROM c_subclr a JOIN c_subclr b ON a.period_id = b.period_id AND a.sample_id < b.sample_id AND a.taxon_id = b.taxon_id
GROUP BY a.sample_id, b.sample_id""")
def _(s: Study):
    ratios = plan.core_log_ratios(_subset(s, ["Anaerobic"]), 1e-5, 0.01)
    sites = s.view("sites").select("period_id", "sample_id", "ord")
    pairs = distance.similarity(distance.distance_tiles(ratios, sites, ["period_id"]), drop_zero=False)
    return pairs.select("sample_id_x", "sample_id_y", "similarity")


@query("k11_functional_profile", """
WITH c_gg AS (SELECT s.sample_id, g.taxon_id, g.genus, coalesce(a.n, 0) AS n FROM (SELECT DISTINCT sample_id FROM c_glomcounts) s
  CROSS JOIN c_glom g LEFT JOIN c_glomcounts a ON a.sample_id = s.sample_id AND a.taxon_id = g.taxon_id),
c_gs AS (SELECT *, n / sum(n) OVER (PARTITION BY sample_id) AS share FROM c_gg),
c_gl AS (SELECT *, ln(share + (SELECT min(share) / 2 FROM c_gs WHERE share > 0)) AS v FROM c_gs),
c_gc AS (SELECT *, v - avg(v) OVER (PARTITION BY sample_id) AS clr FROM c_gl)
SELECT g.sample_id, c.class, round(sum(g.clr), 6) AS sum_clr FROM c_gc g LEFT JOIN genus_class c ON g.genus = c.genus
GROUP BY g.sample_id, c.class""")
def _(s: Study):
    return community.functional_profile(s.counts, s.view("taxonomy"), s.view("genus_class"), RANKS)


@query("k12_subset_alpha", """
SELECT sample_id, count(*) AS observed, round(-sum(n / total * ln(n / total)), 6) AS shannon FROM (
SELECT r.sample_id, r.n, sum(r.n) OVER (PARTITION BY r.sample_id) AS total FROM c_rare r WHERE r.taxon_id IN
(SELECT g.taxon_id FROM c_glom g JOIN genus_class c ON g.genus = c.genus WHERE c.class = 'Anaerobic')) p GROUP BY sample_id""")
def _(s: Study):
    ids = _subset(s, ["Anaerobic"]).select("taxon_id").distinct()
    rarefied = community.keep_taxa(community.rarefy(s.counts), ids)
    return community.alpha_diversity(rarefied).select("sample_id", "observed", "shannon")


@query("k13_class_catalogue", """
SELECT c.class, count(*) AS n FROM (SELECT DISTINCT genus FROM c_glom) g LEFT JOIN genus_class c ON g.genus = c.genus GROUP BY c.class""")
def _(s: Study):
    _, groups = community.agglomerate(s.counts, s.view("taxonomy"), RANKS)
    labels = community.label_catalogue(groups, "genus")
    return rel.count_by(rel.lookup(labels, s.view("genus_class"), [("genus", "genus")]), "class")


# ---- roster ----


@query("r1_best_role", "SELECT bird_id, period_id, group_id, territory_id, role FROM c_best")
def _(s: Study):
    return s.best.select("bird_id", "period_id", "group_id", "territory_id", "role")


@query("r2_group_roster", """
SELECT group_id, period_id, territory_id, role, row_number() OVER (PARTITION BY group_id, role ORDER BY bird_id) AS slot, bird_id
FROM c_best""")
def _(s: Study):
    return roster.group_slots(s.best)


@query("r3_group_size", "SELECT group_id, n_members FROM c_dim")
def _(s: Study):
    return roster.group_dimension(s.best).select("group_id", "n_members")


@query("r4_pair_tenure", "SELECT group_id, seasons_together FROM c_dim")
def _(s: Study):
    return roster.group_dimension(s.best).select("group_id", "seasons_together")


@query("r5_presence_flags", "SELECT group_id, helper_present, fledgling_present FROM c_dim")
def _(s: Study):
    return roster.group_dimension(s.best).select("group_id", "helper_present", "fledgling_present")


@query("r6_group_dimension", """
SELECT group_id, n_members, seasons_together, helper_present, fledgling_present, territory_id FROM c_dim""")
def _(s: Study):
    return roster.group_dimension(s.best)


@query("r7_first_record", "SELECT bird_id, group_id, role, status_id, territory_id FROM c_first")
def _(s: Study):
    first = roster.first_records(s.view("status"), s.view("groups"))
    return first.select("bird_id", "group_id", "role", "status_id", "territory_id")


@query("r8_natal_attendants", "SELECT * FROM c_attendants")
def _(s: Study):
    return roster.natal_attendants(roster.first_records(s.view("status"), s.view("groups")), s.view("status"))


@query("r9_natal_table", "SELECT * FROM c_natal_all")
def _(s: Study):
    return s.natal


@query("r10_genetic_parents", "SELECT parent, off_id, spouse_id FROM c_parents")
def _(s: Study):
    return s.parents


# ---- dyads ----


@query("y1_metadata_and_alpha", """
SELECT t.sample_id_x, t.sample_id_y, dx.seasons_together AS seasons_together_x, dy.seasons_together AS seasons_together_y,
  ax.observed AS observed_x, ay.observed AS observed_y FROM c_typed t
LEFT JOIN c_dim dx ON t.group_id_x = dx.group_id LEFT JOIN c_dim dy ON t.group_id_y = dy.group_id
LEFT JOIN c_oalpha ax ON t.sample_id_x = ax.sample_id LEFT JOIN c_oalpha ay ON t.sample_id_y = ay.sample_id""")
def _(s: Study):
    return s.pairs_with("group", "alpha").select(
        "sample_id_x", "sample_id_y", "seasons_together_x", "seasons_together_y", "observed_x", "observed_y"
    )


@query("y2_relation", "SELECT sample_id_x, sample_id_y, relation FROM c_pairs")
def _(s: Study):
    rows = s.view("samples").select("year", "season", "ord", "sample_id", "bird_id", "group_id")
    pairs = distance.pair_within(rows, ["year", "season"], "ord")
    return dyads.with_relations(pairs).select("sample_id_x", "sample_id_y", "relation")


_CLASH = """
SELECT a.sample_id AS sample_id_x, b.sample_id AS sample_id_y,
  CASE WHEN a.season = b.season AND a.year = b.year THEN 'sameyearsameseason' WHEN a.season = b.season THEN 'sameseasondiffyear'
       WHEN a.year = b.year THEN 'sameyeardiffseason' ELSE 'diffyeardiffseason' END AS season_relation
FROM samples a JOIN samples b ON a.bird_id = b.bird_id AND a.ord < b.ord"""


@query("y3_season_relation", f"SELECT season_relation, count(*) AS n FROM ({_CLASH}) c GROUP BY season_relation")
def _(s: Study):
    rows = s.view("samples").select("bird_id", "ord", "season", "year")
    pairs = distance.pair_within(rows, ["bird_id"], "ord")
    return rel.count_by(pairs, dyads.season_relation().alias("season_relation"))


@query("y4_shared_tenure", """
SELECT t.sample_id_x, t.sample_id_y, dx.seasons_together AS shared_tenure FROM c_typed t
JOIN c_dim dx ON t.group_id_x = dx.group_id JOIN c_dim dy ON t.group_id_y = dy.group_id
WHERE t.pair_type = 'Dominantpair' AND dx.seasons_together = dy.seasons_together""")
def _(s: Study):
    return s.pairs_with("group").where(F.col("shared_tenure").isNotNull()).select("sample_id_x", "sample_id_y", "shared_tenure")


@query("y5_both_roles", "SELECT role_x, role_y, count(*) AS n FROM c_allowed GROUP BY role_x, role_y")
def _(s: Study):
    rows = plan.pairable(s.view("samples")).select("year", "season", "ord", "role")
    pairs = distance.pair_within(rows, ["year", "season"], "ord", dyads.both_roles())
    return rel.count_by(pairs, "role_x", "role_y")


@query("y6_covariate_differences", """
SELECT sample_id_x, sample_id_y, catch_time_diff, fridge_diff, sample_date_diff, round(age_diff, 6) AS age_diff, sex_diff FROM c_typed""")
def _(s: Study):
    return s.pairs.select(
        "sample_id_x", "sample_id_y", "catch_time_diff", "fridge_diff", "sample_date_diff", "age_diff", "sex_diff"
    )


@query("y6_signed_age", "SELECT sample_id_x, sample_id_y, round(sampling_age_x - sampling_age_y, 6) AS age_diff FROM c_typed")
def _(s: Study):
    return plan.pair_table(s.view("samples"), signed_age=True).select("sample_id_x", "sample_id_y", "age_diff")


@query("y7_pair_type", "SELECT sample_id_x, sample_id_y, relation, pair_type FROM c_typed")
def _(s: Study):
    return s.pairs.select("sample_id_x", "sample_id_y", "relation", "pair_type")


@query("y8_dyad_id", """
SELECT sample_id_x, sample_id_y, bird_a, bird_b, dense_rank() OVER (ORDER BY bird_a, bird_b) AS dyad_id FROM c_typed""")
def _(s: Study):
    slim = s.pairs.select("sample_id_x", "sample_id_y", "bird_a", "bird_b")
    return rel.dense_id(slim, ("bird_a", "bird_b"), "dyad_id")


@query("y9_relatedness_lookup", "SELECT sample_id_x, sample_id_y, round(relatedness, 6) AS relatedness FROM c_related")
def _(s: Study):
    return s.pairs.select("sample_id_x", "sample_id_y", "relatedness")


@query("y10_shared_natal", "SELECT sample_id_x, sample_id_y, shared_natal FROM c_born")
def _(s: Study):
    return s.pairs_with("natal").select("sample_id_x", "sample_id_y", "shared_natal")


@query("y10_shared_natal_symmetric", """
SELECT t.sample_id_x, t.sample_id_y, CASE WHEN n.bird_a IS NOT NULL THEN 'same' ELSE 'different' END AS shared_natal
FROM c_typed t LEFT JOIN (
  SELECT DISTINCT least(bird_id, attendant) AS bird_a, greatest(bird_id, attendant) AS bird_b FROM c_natal_all
  WHERE attendant IS NOT NULL) n ON t.bird_a = n.bird_a AND t.bird_b = n.bird_b""")
def _(s: Study):
    pairs = plan.pair_table(s.view("samples"), natal=s.natal)
    return pairs.select("sample_id_x", "sample_id_y", "shared_natal")


@query("y11_parent", """
SELECT t.sample_id_x, t.sample_id_y, p.parent FROM c_typed t LEFT JOIN c_parents p ON t.bird_id_x = p.off_id""")
def _(s: Study):
    return s.pairs_with("parents").select("sample_id_x", "sample_id_y", F.col("parent_x").alias("parent"))


@query("y12_alpha_similarity", """
SELECT t.sample_id_x, t.sample_id_y, -abs(ax.observed - ay.observed) AS observed_diff,
  round(-abs(ax.shannon - ay.shannon), 6) + 0 AS shannon_diff
FROM c_typed t LEFT JOIN c_oalpha ax ON t.sample_id_x = ax.sample_id LEFT JOIN c_oalpha ay ON t.sample_id_y = ay.sample_id""")
def _(s: Study):
    return s.pairs_with("alpha").select("sample_id_x", "sample_id_y", "observed_diff", "shannon_diff")


@query("y13_within_group", "SELECT sample_id_x, sample_id_y, pair_type FROM c_born WHERE pair_type = 'DomHelp' AND shared_natal = 'different'")
def _(s: Study):
    return dyads.helpers_from_elsewhere(s.pairs_with("natal")).select("sample_id_x", "sample_id_y", "pair_type")


@query("y14_natal_by_type", """
SELECT shared_natal, pair_type, count(*) AS n FROM c_born WHERE relation = 'sameGroup' GROUP BY shared_natal, pair_type""")
def _(s: Study):
    return rel.count_by(dyads.within_group(s.pairs_with("natal")), "shared_natal", "pair_type")


@query("y15_relatedness_summary", f"SELECT relation, {_summary_sql(['relatedness'], 'skip')} FROM c_related GROUP BY relation")
def _(s: Study):
    return summarise_columns(s.pairs, ["relatedness"], ["relation"], na_policy="skip")


@query("y15_relatedness_propagate", f"SELECT {_summary_sql(['relatedness'])} FROM c_related WHERE relation = 'sameGroup'")
def _(s: Study):
    return summarise_columns(dyads.within_group(s.pairs), ["relatedness"])


_SIZES_SQL = """
SELECT pair_type, count(DISTINCT sample) AS samples, count(DISTINCT bird) AS birds FROM (
SELECT pair_type, sample_id_x AS sample, bird_id_x AS bird FROM c_typed
UNION ALL SELECT pair_type, sample_id_y, bird_id_y FROM c_typed) u GROUP BY pair_type"""


@query("y16_class_sizes", _SIZES_SQL)
def _(s: Study):
    return dyads.class_sizes(s.pairs, "pair_type")


@query("y16_sizes_overall_and_by_class", """
WITH c_ends AS (SELECT pair_type, sample_id_x AS sample, bird_id_x AS bird FROM c_typed
  UNION ALL SELECT pair_type, sample_id_y, bird_id_y FROM c_typed)
SELECT pair_type, count(*) // 2 AS pairs, count(DISTINCT sample) AS samples, count(DISTINCT bird) AS birds FROM c_ends GROUP BY pair_type
UNION ALL SELECT 'all', count(*) // 2, count(DISTINCT sample), count(DISTINCT bird) FROM c_ends""")
def _(s: Study):
    return dyads.sizes_with_total(s.pairs, "pair_type")


_DIFFS = ["age_diff", "fridge_diff"]
_COVARIATES = ["catch_time_diff", "sample_date_diff", "relatedness"]


@query("y16_pair_counts_without_pairs", """
SELECT year, season, relation, pair_type, count(*) AS n FROM c_typed GROUP BY year, season, relation, pair_type""")
def _(s: Study):
    return dyads.count_pairs(s.view("samples"), plan.BLOCK)


@query("y17_dyad_summary", f"""
SELECT {_summary_sql(_DIFFS).replace('min(age_diff)', 'round(min(age_diff), 6)').replace('max(age_diff)', 'round(max(age_diff), 6)')} FROM (
SELECT *, row_number() OVER (PARTITION BY bird_a, bird_b ORDER BY sample_id_x, sample_id_y) AS rn FROM c_typed) d WHERE rn = 1""")
def _(s: Study):
    return dyads.dyad_summary(s.pairs, _DIFFS)


@query("y17_covariate_summary", f"""
SELECT relation, {_summary_sql(_COVARIATES, 'skip')} FROM (
SELECT *, row_number() OVER (PARTITION BY relation, bird_a, bird_b ORDER BY sample_id_x, sample_id_y) AS rn FROM c_related) d
WHERE rn = 1 GROUP BY relation
UNION ALL SELECT 'all', {_summary_sql(_COVARIATES, 'skip')} FROM (
SELECT *, row_number() OVER (PARTITION BY bird_a, bird_b ORDER BY sample_id_x, sample_id_y) AS rn FROM c_related) d WHERE rn = 1""")
def _(s: Study):
    return dyads.dyad_summaries(s.pairs, _COVARIATES, "relation", na_policy="skip")


@query("y18_pairs_per_season", """
SELECT round(avg(n), 6) AS mean, round(stddev_samp(n) / sqrt(count(*)), 6) AS se
FROM (SELECT year, season, count(*) AS n FROM c_typed GROUP BY year, season) c""")
def _(s: Study):
    return rel.mean_of_counts(s.pairs, ["year", "season"])


@query("y19_seasons_per_dominant_dyad", """
SELECT bird_a, bird_b, count(*) AS n FROM (SELECT DISTINCT bird_a, bird_b, season, year FROM c_typed WHERE pair_type = 'Dominantpair') d
GROUP BY bird_a, bird_b ORDER BY n DESC""")
def _(s: Study):
    return dyads.seasons_per_dominant_dyad(s.pairs).orderBy(F.desc("n"), "bird_a", "bird_b")


@query("y20_roles_per_bird", """
SELECT d.bird_id, d.role, n.n_roles FROM (SELECT DISTINCT bird_id_x AS bird_id, role_x AS role FROM c_typed) d
JOIN (SELECT bird_id_x AS bird_id, count(DISTINCT role_x) AS n_roles FROM c_typed GROUP BY bird_id_x) n ON d.bird_id = n.bird_id""")
def _(s: Study):
    return dyads.roles_per_bird(s.pairs)


@query("y21_role_changes", """
WITH c_stack AS (SELECT bird_id, territory_id, CASE WHEN role IN ('BrM', 'BrF') THEN 'Dom' WHEN role IN ('AB', 'ABX', 'H') THEN 'Sub'
  ELSE 'Other' END AS role_class FROM (
  SELECT bird_id_x AS bird_id, role_x AS role, territory_id_x AS territory_id FROM c_typed
  UNION ALL SELECT bird_id_y, role_y, territory_id_y FROM c_typed) u)
SELECT DISTINCT c.bird_id, c.territory_id, c.role_class, n.n_classes FROM c_stack c
JOIN (SELECT bird_id, territory_id, count(DISTINCT role_class) AS n_classes FROM c_stack GROUP BY bird_id, territory_id) n
ON c.bird_id = n.bird_id AND c.territory_id = n.territory_id WHERE n.n_classes > 1""")
def _(s: Study):
    return dyads.role_changes(s.pairs)


@query("y22_marginal_counts", """
SELECT 'year' AS what, CAST(year AS VARCHAR) AS label, count(*) AS n FROM c_typed GROUP BY year
UNION ALL SELECT 'season', season, count(*) FROM c_typed GROUP BY season
UNION ALL SELECT 'sex_diff', sex_diff, count(*) FROM c_typed GROUP BY sex_diff""")
def _(s: Study):
    return dyads.marginal_counts(s.pairs, ["year", "season", "sex_diff"])


@query("y22_natal_margins", """
SELECT 'shared_natal' AS what, shared_natal AS label, count(*) AS n FROM c_born GROUP BY shared_natal
UNION ALL SELECT 'relation', relation, count(*) FROM c_born GROUP BY relation""")
def _(s: Study):
    return dyads.marginal_counts(s.pairs_with("natal"), ["shared_natal", "relation"])


@query("y23_interacting", """
SELECT CASE WHEN pair_type IN ('Dominantpair', 'DomHelp') THEN 'interacting' ELSE 'not' END AS grouping, count(*) AS n
FROM c_typed WHERE relation = 'sameGroup' GROUP BY 1""")
def _(s: Study):
    return rel.count_by(dyads.within_group(s.pairs), dyads.interacting().alias("grouping"))


# ---- annotation ----


def _sources(s: Study):
    return {
        "machine1": (s.view("machine1"), "label1"), "machine2": (s.view("machine2"), "label2"),
        "curator": (s.view("curator"), "expert"), "published": (s.view("published"), "paper"),
    }


def _tally(scored):
    return scored.groupBy("conflict").agg(F.count(F.lit(1)).alias("n"))


@query("n1_machine1_vs_curator", """
SELECT conflict, count(*) AS n FROM (SELECT CASE WHEN (label1 IN ('Aerobic', 'Facultative Anaerobic')
  AND expert IN ('Aerobic', 'facultatively anaerobic', 'mixed')) OR (label1 = 'Anaerobic' AND expert = 'Anaerobe')
  OR expert = 'unknown' THEN '0' ELSE '1' END AS conflict
FROM machine1 a FULL JOIN curator b ON a.genus IS NOT DISTINCT FROM b.genus WHERE expert IS NOT NULL AND label1 IS NOT NULL) c GROUP BY conflict""")
def _(s: Study):
    return _tally(annotate.compare_sources(
        s.view("machine1"), s.view("curator"), "genus", "label1", "expert", annotate.AGREE_MACHINE1_CURATOR,
        "full", ["label1", "expert"]))


@query("n2_machine1_vs_published", """
SELECT round(avg(ok), 6) AS agreement FROM (SELECT CASE WHEN (label1 IN ('Aerobic', 'Facultatively anaerobic') AND paper = 'aerotolerant')
  OR (label1 = 'Anaerobic' AND paper = 'anaerobic') OR (label1 = 'Unknown' AND paper = 'unknown') OR paper = 'unknown'
  THEN 1.0E0 ELSE 0.0E0 END AS ok
FROM machine1 a JOIN published b ON a.genus = b.genus) c""")
def _(s: Study):
    return rel.agreement_rate(annotate.compare_sources(
        s.view("machine1"), s.view("published"), "genus", "label1", "paper", annotate.AGREE_MACHINE1_PUBLISHED))


@query("n3_class_counts", "SELECT label2, count(*) AS n FROM machine2 GROUP BY label2")
def _(s: Study):
    return rel.count_by(s.view("machine2"), "label2")


@query("n4_machine2_vs_curator", """
SELECT coalesce(a.genus, b.genus) AS genus, label2, expert, CASE WHEN (label2 IN ('Aerobic', 'Facultative Anaerobic')
  AND expert IN ('Aerobic', 'facultatively anaerobic', 'mixed')) OR (label2 = 'Anaerobic' AND expert = 'Anaerobe') THEN '0' ELSE '1' END AS conflict
FROM machine2 a FULL JOIN curator b ON a.genus IS NOT DISTINCT FROM b.genus WHERE expert IS NOT NULL""")
def _(s: Study):
    return annotate.compare_sources(
        s.view("machine2"), s.view("curator"), "genus", "label2", "expert", annotate.AGREE_MACHINE2_CURATOR,
        "full", ["expert"])


@query("n5_machine2_vs_published", """
SELECT conflict, count(*) AS n FROM (SELECT CASE WHEN (label2 IN ('Aerobic', 'Facultative Anaerobic') AND paper IN ('aerotolerant', 'mixed'))
  OR (label2 = 'Anaerobic' AND paper = 'anaerobic') THEN '0' ELSE '1' END AS conflict
FROM machine2 a JOIN published b ON a.genus = b.genus WHERE coalesce(paper, '') <> 'unknown' AND coalesce(label2, '') <> 'Unknown') c
GROUP BY conflict""")
def _(s: Study):
    scored = annotate.compare_sources(
        s.view("machine2"), s.view("published"), "genus", "label2", "paper", annotate.AGREE_MACHINE2_PUBLISHED)
    return _tally(annotate.without_unknown(scored, {"paper": ["unknown"], "label2": ["Unknown"]}))


@query("n6_curator_vs_published", """
SELECT CASE WHEN (expert IN ('Aerobic', 'facultatively anaerobic') AND paper = 'aerotolerant')
  OR (expert = 'Anaerobe' AND paper = 'anaerobic') OR (expert = 'Unknown' AND paper = 'unknown') OR paper = 'unknown' THEN '0'
  ELSE '1' END AS conflict, paper IS NULL AS unmatched, count(*) AS n
FROM curator a LEFT JOIN published b ON a.genus IS NOT DISTINCT FROM b.genus WHERE expert IS NOT NULL GROUP BY 1, 2""")
def _(s: Study):
    scored = annotate.compare_sources(
        s.view("curator"), s.view("published"), "genus", "expert", "paper", annotate.AGREE_CURATOR_PUBLISHED,
        "left", ["expert"])
    return rel.count_by(scored, "conflict", F.col("paper").isNull().alias("unmatched"))


_MASTER_SQL = """
SELECT g.genus, a.label1 AS machine1, b.label2 AS machine2, c.expert AS curator, d.paper AS published FROM genera g
LEFT JOIN machine1 a ON g.genus = a.genus LEFT JOIN machine2 b ON g.genus = b.genus
LEFT JOIN curator c ON g.genus = c.genus LEFT JOIN published d ON g.genus = d.genus"""


@query("n7_master_table", _MASTER_SQL)
def _(s: Study):
    return annotate.master_table(s.view("genera"), "genus", _sources(s))


_HARMONISED_SQL = f"""
SELECT genus,
  CASE WHEN machine1 = 'Anaerobic' THEN 'Anaerobic' WHEN machine1 IN ('Facultatively anaerobic', 'Aerobic') THEN 'Aerotolerant'
       WHEN machine1 IS NOT NULL THEN 'Unknown' ELSE 'Unassigned' END AS machine1,
  CASE WHEN machine2 = 'Anaerobic' THEN 'Anaerobic' WHEN machine2 IN ('Facultative Anaerobic', 'Aerobic') THEN 'Aerotolerant'
       WHEN machine2 IS NOT NULL THEN 'Unknown' ELSE 'Unassigned' END AS machine2,
  CASE WHEN curator = 'Anaerobe' THEN 'Anaerobic' WHEN curator IN ('facultatively anaerobic', 'Aerobic', 'mixed') THEN 'Aerotolerant'
       WHEN curator IS NOT NULL THEN 'Unknown' ELSE 'Unassigned' END AS curator,
  CASE WHEN published = 'anaerobic' THEN 'Anaerobic' WHEN published IN ('aerotolerant', 'Aerobic', 'mixed') THEN 'Aerotolerant'
       WHEN published IS NOT NULL THEN 'Unknown' ELSE 'Unassigned' END AS published
FROM ({_MASTER_SQL}) m"""


def _harmonised(s: Study):
    return annotate.harmonise_all(annotate.master_table(s.view("genera"), "genus", _sources(s)), list(_sources(s)))


@query("n8_harmonise", _HARMONISED_SQL)
def _(s: Study):
    return _harmonised(s)


@query("n9_verdict", f"""
SELECT CASE WHEN machine2 NOT IN ('Anaerobic', 'Aerotolerant') OR curator NOT IN ('Anaerobic', 'Aerotolerant') THEN 'Not tested'
  WHEN machine2 = curator THEN 'Correct' ELSE 'Wrong' END AS verdict, count(*) AS n FROM ({_HARMONISED_SQL}) h GROUP BY 1""")
def _(s: Study):
    return rel.count_by(_harmonised(s), annotate.verdict("machine2", "curator").alias("verdict"))


# ---- genetics ----


@query("g1_loci", "SELECT method, count(DISTINCT locus) AS n FROM genotypes GROUP BY method")
def _(s: Study):
    return genetics.loci_per_method(s.view("genotypes"))


@query("g2_genotypes_wide", f"SELECT ind, {_INTERLEAVED} FROM genotypes GROUP BY ind")
def _(s: Study):
    genotypes = s.view("genotypes")
    return genetics.genotypes_wide(genotypes, _values(genotypes, "locus"))


_FREQ_SQL = """
SELECT locus, allele, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY locus) AS freq FROM (
SELECT locus, a AS allele FROM genotypes UNION ALL SELECT locus, b FROM genotypes) u WHERE allele IS NOT NULL GROUP BY locus, allele"""


@query("g3_allele_frequencies", f"SELECT locus, allele, n, round(freq, 6) AS freq FROM ({_FREQ_SQL}) f")
def _(s: Study):
    return genetics.allele_frequencies(s.view("genotypes"))


def _terms(s: Study):
    blocks = s.view("sites").select(F.col("sample_id").alias("ind"), "period_id")
    return genetics.relatedness_terms(s.view("genotypes"), blocks, ["period_id"])


_QG_SQL = f"""
WITH c_freq AS ({_FREQ_SQL}),
c_typedloci AS (SELECT g.ind, g.locus, g.a, g.b, fa.freq + fb.freq AS p, CASE WHEN g.a = g.b THEN 1 ELSE 0 END AS hom, s.period_id
  FROM genotypes g JOIN c_freq fa ON g.locus = fa.locus AND g.a = fa.allele JOIN c_freq fb ON g.locus = fb.locus AND g.b = fb.allele
  JOIN sites s ON g.ind = s.sample_id),
c_qg AS (SELECT x.ind AS ind_x, y.ind AS ind_y,
  sum(0.5E0 * (CAST(x.a = y.a AS INTEGER) + CAST(x.a = y.b AS INTEGER) + CAST(x.b = y.a AS INTEGER) + CAST(x.b = y.b AS INTEGER)) - x.p) AS nx,
  sum(0.5E0 * (CAST(x.a = y.a AS INTEGER) + CAST(x.a = y.b AS INTEGER) + CAST(x.b = y.a AS INTEGER) + CAST(x.b = y.b AS INTEGER)) - y.p) AS ny,
  sum(1 + x.hom - x.p) AS dx, sum(1 + y.hom - y.p) AS dy
  FROM c_typedloci x JOIN c_typedloci y ON x.period_id = y.period_id AND x.locus = y.locus AND x.ind < y.ind GROUP BY x.ind, y.ind)
"""


@query("g4_relatedness", _QG_SQL + "SELECT ind_x, ind_y, round((nx / nullif(dx, 0) + ny / nullif(dy, 0)) / 2, 6) AS relatedness FROM c_qg")
def _(s: Study):
    return genetics.relatedness(_terms(s).where(F.size("terms") > 0))


@query("g4_relatedness_pooled", _QG_SQL + "SELECT ind_x, ind_y, round((nx + ny) / nullif(dx + dy, 0), 6) AS relatedness FROM c_qg")
def _(s: Study):
    return genetics.relatedness(_terms(s).where(F.size("terms") > 0), "pooled")


_DRAWS_SQL = """
c_panel AS (SELECT locus, row_number() OVER (ORDER BY locus) AS number, count(*) OVER () AS size
  FROM (SELECT DISTINCT locus FROM genotypes WHERE locus IS NOT NULL) l),
c_draws AS (SELECT replicate, number, count(*) AS weight FROM (
  SELECT r.replicate, CAST('0x' || substr(md5('1|' || r.replicate || '|' || i.number), 1, 8) AS BIGINT) % i.size + 1 AS number
  FROM generate_series(1, 1000) r(replicate), c_panel i) d GROUP BY replicate, number),
c_weights AS (SELECT d.replicate, p.locus, d.weight FROM c_draws d JOIN c_panel p ON d.number = p.number)
"""


@query("g5_bootstrap_weights", f"WITH {_DRAWS_SQL} SELECT replicate, locus, weight FROM c_weights")
def _(s: Study):
    return genetics.bootstrap_weights(s.view("genotypes"))


_IDENT_SQL = "0.5E0 * (CAST(x.a = y.a AS INTEGER) + CAST(x.a = y.b AS INTEGER) + CAST(x.b = y.a AS INTEGER) + CAST(x.b = y.b AS INTEGER))"


@query("g5_relatedness_limits", _QG_SQL.rstrip() + f""", {_DRAWS_SQL},
c_locusterms AS (SELECT x.ind AS ind_x, y.ind AS ind_y, x.locus, {_IDENT_SQL} - x.p AS nx, {_IDENT_SQL} - y.p AS ny, 1 + x.hom - x.p AS dx,
  1 + y.hom - y.p AS dy FROM c_typedloci x JOIN c_typedloci y ON x.period_id = y.period_id AND x.locus = y.locus AND x.ind < y.ind),
c_sums AS (SELECT ind_x, ind_y, replicate, sum(weight * nx) AS nx, sum(weight * ny) AS ny, sum(weight * dx) AS dx, sum(weight * dy) AS dy
  FROM c_locusterms JOIN c_weights USING (locus) GROUP BY ind_x, ind_y, replicate),
c_drawn AS (SELECT ind_x, ind_y, (nx / dx + ny / dy) / 2 AS r FROM c_sums WHERE abs(dx) >= 1e-9 AND abs(dy) >= 1e-9),
c_ranked AS (SELECT *, row_number() OVER (PARTITION BY ind_x, ind_y ORDER BY r) - 1 AS rank, count(*) OVER (PARTITION BY ind_x, ind_y) AS k FROM c_drawn),
c_limits AS (SELECT ind_x, ind_y, any_value(k) AS n_replicates,
  max(CASE WHEN rank = floor((1 - 0.95E0) / 2 * (k - 1) + 0.5E0) THEN r END) AS lower,
  max(CASE WHEN rank = floor((1 - (1 - 0.95E0) / 2) * (k - 1) + 0.5E0) THEN r END) AS upper FROM c_ranked GROUP BY ind_x, ind_y)
SELECT q.ind_x, q.ind_y, round((q.nx / nullif(q.dx, 0) + q.ny / nullif(q.dy, 0)) / 2, 6) AS relatedness,
  round(lower, 6) AS lower, round(upper, 6) AS upper, coalesce(n_replicates, 0) AS n_replicates
FROM c_qg q LEFT JOIN c_limits l ON q.ind_x = l.ind_x AND q.ind_y = l.ind_y""")
def _(s: Study):
    return genetics.relatedness_limits(_terms(s), genetics.bootstrap_weights(s.view("genotypes")))


# ---- mixed models ----

MODEL = mixed.Model(
    response="age_diff",
    numeric=["catch_time_diff", "fridge_diff", "relatedness"],
    factors={"relation": ["diffGroup", "sameGroup"], "sex_diff": ["0", "1"], "season": ["Major", "Minor"]},
    members=["bird_id_x", "bird_id_y"],
    group="year",
)
TYPE_MODEL = mixed.Model(
    response="age_diff",
    numeric=["catch_time_diff", "fridge_diff", "relatedness"],
    factors={"pair_type": ["Dominantpair", "DomHelp", "DomSub", "HelpSub", "SubSub"], "sex_diff": ["0", "1"]},
    members=["bird_id_x", "bird_id_y"],
    group="year",
)
_COMPLETE_SQL = """
c_x AS (SELECT sample_id_x, sample_id_y, bird_id_x, bird_id_y, year, 1.0E0 AS x0, CASE WHEN relation = 'sameGroup' THEN 1.0E0 ELSE 0.0E0 END AS x1,
  CASE WHEN sex_diff = '1' THEN 1.0E0 ELSE 0.0E0 END AS x2, CASE WHEN season = 'Minor' THEN 1.0E0 ELSE 0.0E0 END AS x3,
  CAST(catch_time_diff AS DOUBLE) AS x4, CAST(fridge_diff AS DOUBLE) AS x5, relatedness AS x6, age_diff AS y
  FROM c_related WHERE catch_time_diff IS NOT NULL AND relatedness IS NOT NULL)"""
_TERMS = MODEL.terms + [MODEL.response]
_XCOLS = [f"x{i}" for i in range(7)] + ["y"]


@query("l1_design_rows", f"""
WITH {_COMPLETE_SQL}
SELECT term, count(*) AS rows_with_term, round(sum(v), 4) AS total FROM (
""" + " UNION ALL ".join(f"SELECT '{t}' AS term, {c} AS v FROM c_x" for t, c in zip(MODEL.terms, _XCOLS)) + """
) u WHERE v <> 0 GROUP BY term""")
def _(s: Study):
    rows = mixed.design_terms(s.pairs, MODEL, ["sample_id_x", "sample_id_y"]).select(F.inline("terms"))
    return rows.groupBy("term").agg(
        F.count(F.lit(1)).alias("rows_with_term"), F.round(F.sum("value"), 4).alias("total")
    )


@query("l2_membership_weights", """
SELECT sample_id_x, sample_id_y, bird_id_x AS member_id, 1.0E0 AS weight FROM c_typed
UNION ALL SELECT sample_id_x, sample_id_y, bird_id_y, 1.0E0 FROM c_typed""")
def _(s: Study):
    return mixed.memberships(s.pairs, ["sample_id_x", "sample_id_y"], ["bird_id_x", "bird_id_y"])


_LEVELS_SQL = """
c_l AS (SELECT sample_id_x, sample_id_y, 'member:' || bird_id_x AS level FROM c_x
  UNION ALL SELECT sample_id_x, sample_id_y, 'member:' || bird_id_y FROM c_x
  UNION ALL SELECT sample_id_x, sample_id_y, 'group:' || year FROM c_x)"""


@query("l3_gram", f"WITH {_COMPLETE_SQL}, {_LEVELS_SQL}\n" + " UNION ALL ".join(
    f"SELECT '{_TERMS[i]}' AS i, '{_TERMS[j]}' AS j, round(sum({_XCOLS[i]} * {_XCOLS[j]}), 3) AS value FROM c_x"
    for i in range(8) for j in range(i, 8)
) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT '{t}' AS i, level AS j, round(sum({c}), 3) AS value FROM c_x JOIN c_l USING (sample_id_x, sample_id_y) GROUP BY level"
    for t, c in zip(_TERMS, _XCOLS)
) + """ UNION ALL SELECT a.level AS i, b.level AS j, CAST(count(*) AS DOUBLE) AS value FROM c_l a
JOIN c_l b ON a.sample_id_x = b.sample_id_x AND a.sample_id_y = b.sample_id_y AND a.level <= b.level GROUP BY a.level, b.level""")
def _(s: Study):
    rows = mixed.design(s.pairs, MODEL)
    return mixed.gram(rows, MODEL).select("i", "j", F.round("value", 3).alias("value"))


def _fit(s: Study, model=MODEL):
    pairs = s.pairs if model is MODEL else dyads.within_group(s.pairs)
    return mixed_fit.fit(pairs, model)


@query("l4_variance_components")
def _(s: Study):
    return mixed_fit.variance_table(s.spark, _fit(s))


@query("l4_variance_components_by_type")
def _(s: Study):
    return mixed_fit.variance_table(s.spark, _fit(s, TYPE_MODEL))


@query("l5_coefficients")
def _(s: Study):
    return mixed_fit.coefficients(s.spark, _fit(s))


@query("l6_variance_inflation")
def _(s: Study):
    return mixed_fit.inflation_factors(s.spark, _fit(s, TYPE_MODEL))


@query("l7_contrasts_tukey")
def _(s: Study):
    return mixed_fit.contrasts(s.spark, _fit(s, TYPE_MODEL), "pair_type", "tukey")


@query("l7_contrasts_unadjusted")
def _(s: Study):
    return mixed_fit.contrasts(s.spark, _fit(s, TYPE_MODEL), "pair_type", "none")


@query("l7_marginal_means")
def _(s: Study):
    return mixed_fit.marginal_means(s.spark, _fit(s, TYPE_MODEL), "pair_type")


@query("l8_term_tests")
def _(s: Study):
    return mixed_fit.term_tests(s.spark, _fit(s, TYPE_MODEL))


@query("l9_predictions")
def _(s: Study):
    return mixed_fit.predictions(s.spark, _fit(s, TYPE_MODEL), "pair_type")


@query("l10_least_squares", """
SELECT 'intercept' AS term, round(regr_intercept(age_diff, fridge_diff), 6) AS estimate FROM c_typed
UNION ALL SELECT 'fridge_diff', round(regr_slope(age_diff, fridge_diff), 6) FROM c_typed""")
def _(s: Study):
    fit = mixed_fit.fit(s.pairs, mixed.Model("age_diff", ["fridge_diff"]))
    return mixed_fit.coefficients(s.spark, fit).select("term", "estimate")


# ---- figures ----


@query("v1_histogram", """
WITH c_v AS (SELECT CAST(age_diff AS DOUBLE) AS v FROM c_typed), c_span AS (SELECT min(v) AS lo, (max(v) - min(v)) / 30 AS w FROM c_v),
c_n AS (SELECT least(CAST(floor((v - lo) / w) AS BIGINT), 29) AS bin, count(*) AS n FROM c_v, c_span GROUP BY 1)
SELECT b.bin, coalesce(n, 0) AS n, round(lo + b.bin * w, 6) AS lower, round(lo + (b.bin + 1) * w, 6) AS upper
FROM (SELECT unnest(range(0, 30)) AS bin) b CROSS JOIN c_span LEFT JOIN c_n ON c_n.bin = b.bin""")
def _(s: Study):
    return figures.histogram(s.written_pairs("age_diff"), "age_diff")


@query("v2_box_stats", """
WITH c_q AS (SELECT pair_type, quantile_cont(CAST(age_diff AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(age_diff AS DOUBLE), 0.5) AS median,
  quantile_cont(CAST(age_diff AS DOUBLE), 0.75) AS q3 FROM c_typed GROUP BY pair_type)
SELECT t.pair_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(min(CASE WHEN age_diff >= q1 - (q3 - q1) * 1.5 AND age_diff <= q3 + (q3 - q1) * 1.5 THEN age_diff END), 6) AS lower_whisker,
  round(max(CASE WHEN age_diff >= q1 - (q3 - q1) * 1.5 AND age_diff <= q3 + (q3 - q1) * 1.5 THEN age_diff END), 6) AS upper_whisker,
  count(CASE WHEN age_diff < q1 - (q3 - q1) * 1.5 OR age_diff > q3 + (q3 - q1) * 1.5 THEN 1 END) AS outliers
FROM c_typed t JOIN c_q q ON t.pair_type = q.pair_type GROUP BY t.pair_type, q1, median, q3""")
def _(s: Study):
    return figures.box_stats(s.written_pairs("pair_type", "age_diff"), "age_diff", "pair_type")


@query("v3_density", """
WITH c_v AS (SELECT pair_type, CAST(age_diff AS DOUBLE) AS v FROM c_typed),
c_s AS (SELECT pair_type, min(v) AS lo, max(v) AS hi, count(*) AS n,
  0.45E0 * least(stddev_samp(v), (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) / 1.34E0) * pow(count(*), -0.2E0) AS bw
  FROM c_v GROUP BY pair_type),
c_b AS (SELECT v.pair_type, least(CAST(floor((v - lo) / ((hi - lo) / 512)) AS BIGINT), 511) AS bin, count(*) AS c
  FROM c_v v JOIN c_s s ON v.pair_type = s.pair_type GROUP BY 1, 2),
c_g AS (SELECT unnest(range(0, 64)) AS point)
SELECT b.pair_type, CAST(g.point AS INTEGER) AS point, round(min(lo + g.point * (hi - lo) / 63), 6) AS at,
  round(sum(c * exp(pow((lo + g.point * ((hi - lo) / 63) - (lo + (bin + 0.5E0) * ((hi - lo) / 512))) / bw, 2) * -0.5E0) / (n * bw * sqrt(2 * pi()))), 6) AS density
FROM c_b b JOIN c_s s ON b.pair_type = s.pair_type CROSS JOIN c_g g GROUP BY b.pair_type, g.point""")
def _(s: Study):
    return figures.density(s.written_pairs("pair_type", "age_diff"), "age_diff", "pair_type")


@query("v4_count_labels", "SELECT relation, count(*) AS count, 0 AS value FROM c_typed GROUP BY relation")
def _(s: Study):
    return figures.count_labels(s.pairs, "relation")


# ---- pair tables of functional subsets ----


def _subset_pairs_sql(classes) -> str:
    """Similarity, signed age and alpha differences of all classified pairs, over the taxa of some classes."""
    return f"""
WITH c_keep AS (SELECT genus FROM genus_class WHERE class IN ({quoted(classes)})),
c_sub AS (SELECT sample_id, taxon_id, n FROM order_abund WHERE taxon_id IN (SELECT genus FROM c_keep)),
c_subshare AS (SELECT sample_id, taxon_id, n, n / sum(n) OVER (PARTITION BY sample_id) AS share FROM c_sub),
c_subcore AS (SELECT taxon_id FROM c_subshare GROUP BY taxon_id
  HAVING count(CASE WHEN share > 0.00001 THEN 1 END) / (SELECT count(DISTINCT sample_id) FROM c_subshare) > 0.01),
c_subgrid AS (SELECT s.sample_id, c.taxon_id, coalesce(a.n, 0) AS n
  FROM (SELECT DISTINCT o.sample_id FROM c_sub o JOIN c_subcore k ON o.taxon_id = k.taxon_id) s CROSS JOIN c_subcore c
  LEFT JOIN c_sub a ON a.sample_id = s.sample_id AND a.taxon_id = c.taxon_id),
c_subgs AS (SELECT sample_id, taxon_id, n / sum(n) OVER (PARTITION BY sample_id) AS share FROM c_subgrid),
c_sublog AS (SELECT sample_id, taxon_id, ln(share + (SELECT min(share) / 2 FROM c_subgs WHERE share > 0)) AS v FROM c_subgs),
c_subclr AS (SELECT sample_id, taxon_id, v - avg(v) OVER (PARTITION BY sample_id) AS clr FROM c_sublog),
c_subalpha AS (SELECT sample_id, count(*) AS observed, -sum(n / total * ln(n / total)) AS shannon FROM (
  SELECT sample_id, n, sum(n) OVER (PARTITION BY sample_id) AS total FROM c_orare WHERE taxon_id IN (SELECT genus FROM c_keep)) p
  GROUP BY sample_id),
c_near AS (SELECT t.sample_id_x, t.sample_id_y, t.pair_type, t.sampling_age_x - t.sampling_age_y AS age_diff,
  -sqrt(sum((a.clr - b.clr) * (a.clr - b.clr))) AS similarity FROM c_typed t JOIN c_subclr a ON t.sample_id_x = a.sample_id
  JOIN c_subclr b ON t.sample_id_y = b.sample_id AND a.taxon_id = b.taxon_id
  GROUP BY t.sample_id_x, t.sample_id_y, t.pair_type, t.sampling_age_x, t.sampling_age_y)
SELECT n.sample_id_x, n.sample_id_y, n.pair_type, round(n.similarity, 6) AS similarity, round(n.age_diff, 6) AS age_diff,
  abs(ax.observed - ay.observed) AS observed_diff, round(abs(ax.shannon - ay.shannon), 6) AS shannon_diff
FROM c_near n LEFT JOIN c_subalpha ax ON n.sample_id_x = ax.sample_id LEFT JOIN c_subalpha ay ON n.sample_id_y = ay.sample_id
WHERE n.similarity < -0.000000001"""


SUBSETS = {"aerobic": _AEROBIC, "anaerobic": ["Anaerobic"]}


def subset_pairs(s: Study, name: str, samples=None, **options):
    """The pair table over the order-level taxa of one functional subset."""
    wanted = s.view("genus_class").where(F.col("class").isin(SUBSETS[name])).select(F.col("genus").alias("taxon_id"))
    counts = materialise(community.keep_taxa(s.order_counts, wanted))
    rarefied = community.keep_taxa(community.rarefy(s.order_counts, ORDER_DEPTH), wanted)
    samples = s.view("samples") if samples is None else samples
    rows = plan.enrich_samples(samples, alpha=community.alpha_diversity(rarefied))
    return plan.pair_table(rows, s.view("edges"), plan.core_log_ratios(counts, 1e-5, 0.01), **options)


def _subset_columns(pairs):
    return pairs.select(
        "sample_id_x", "sample_id_y", "pair_type", "similarity", "age_diff", "observed_diff", "shannon_diff")


@query("y24_aerobic_pairs", _subset_pairs_sql(SUBSETS["aerobic"]))
def _(s: Study):
    return _subset_columns(subset_pairs(s, "aerobic", signed_age=True, alpha_as_similarity=False))


@query("y25_anaerobic_pairs", _subset_pairs_sql(SUBSETS["anaerobic"]))
def _(s: Study):
    return _subset_columns(subset_pairs(s, "anaerobic", signed_age=True, alpha_as_similarity=False))


# ---- the study's comparisons, on pairs with similarity, alpha diversity and natal groups ----


def _pairs_of(s: Study, name: str):
    """The pair table a comparison is made on: the whole community's or a functional subset's."""
    subset = models.COMPARISONS[name].pairs
    if subset == "whole":
        return plan.pair_table(s.samples_with("natal", "alpha"), s.view("edges"), s.order_ratios)
    return subset_pairs(s, subset, plan.enrich_samples(s.view("samples"), natal=s.natal_slots))


def _register_comparison(name: str) -> None:
    @query(f"model_{name}")
    def _(s: Study):
        return mixed_fit.coefficients(s.spark, models.fit_comparison(_pairs_of(s, name), name))


for _name in models.COMPARISONS:
    _register_comparison(_name)


_MEANS_SQL = _subset_pairs_sql(SUBSETS["anaerobic"]).rsplit("SELECT n.sample_id_x", 1)[0] + """
SELECT CASE WHEN pair_type IN ('Dominantpair', 'DomHelp') THEN 'interacting' ELSE 'not' END AS grouping, count(*) AS pairs,
  round(avg(similarity), 6) AS mean FROM c_near WHERE similarity < -0.000000001 AND pair_type <> 'diffGroup' GROUP BY 1"""


@query("model_anaerobic_interaction_means", _MEANS_SQL)
def _(s: Study):
    return models.means_by_class(subset_pairs(s, "anaerobic"), "anaerobic_by_interaction")
