"""Registration of queries and the shared SQL of their checks."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from dyadspark.operators import community, dyads, roster
from dyadspark.plans import pair_similarity as plan
from dyadspark.queries import views
from dyadspark.session import materialise

#: Reads an order is rarefied to; smaller orders have no alpha diversity.
ORDER_DEPTH = 60

QUERIES: dict = {}
CHECKS: dict[str, str] = {}


class Study:
    """The study tables of one data folder and the steps several queries share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return views.table(self.spark, self.folder, name)

    def view(self, name: str) -> DataFrame:
        return views.view(self.spark, self.folder, name)

    @cached_property
    def best(self) -> DataFrame:
        return roster.best_roles(self.view("status"), self.view("groups"))

    @cached_property
    def natal(self) -> DataFrame:
        return roster.natal_table(self.view("status"), self.view("groups"))

    @cached_property
    def natal_slots(self) -> DataFrame:
        return roster.natal_slots(self.natal)

    @cached_property
    def alpha(self) -> DataFrame:
        """Alpha diversity of the rarefied order-level community."""
        return community.alpha_diversity(community.rarefy(self.order_counts, ORDER_DEPTH))

    @cached_property
    def order_counts(self) -> DataFrame:
        return materialise(self.view("order_abund"))

    @cached_property
    def parents(self) -> DataFrame:
        return roster.genetic_parents(self.view("offspring"))

    @cached_property
    def order_ratios(self) -> DataFrame:
        return plan.core_log_ratios(self.order_counts)

    @cached_property
    def counts(self) -> DataFrame:
        """The count table, written: most community steps read it more than once."""
        return materialise(self.view("abund"))

    @cached_property
    def core(self) -> DataFrame:
        counts = self.counts
        return community.keep_taxa(counts, community.core_taxa(community.relative_abundance(counts)))

    def written_pairs(self, *cols: str) -> DataFrame:
        """Some columns of the pairs as a written table, for steps that read them several times."""
        return materialise(self.pairs.select(*cols))

    def samples_with(self, *parts: str) -> DataFrame:
        """Samples with what the query reads of group, natal, alpha and parents; a written table is not pruned later."""
        known = {
            "group": ("group_dim", lambda: roster.group_dimension(self.best).select("group_id", "seasons_together")),
            "natal": ("natal", lambda: self.natal_slots),
            "alpha": ("alpha", lambda: self.alpha),
            "parents": ("parents", lambda: self.parents),
        }
        return plan.enrich_samples(self.view("samples"), **{known[p][0]: known[p][1]() for p in parts})

    @cached_property
    def pairs(self) -> DataFrame:
        """Classified pairs, no distances, with relatedness."""
        return plan.pair_table(self.view("samples"), self.view("edges"))

    def pairs_with(self, *parts: str) -> DataFrame:
        """Classified pairs with parts of ``samples_with`` at both ends, without relatedness."""
        return plan.pair_table(self.samples_with(*parts))

    @cached_property
    def similar_pairs(self) -> DataFrame:
        return plan.pair_table(self.view("samples"), ratios=self.order_ratios)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded so that two engines can be compared; adding 0 turns -0.0 into 0.0."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def query(name: str, check: str | None = None):
    """Register ``fn(study) -> DataFrame`` under a key, with the SQL that must give the same rows."""

    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(fn(Study(spark, folder)))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = views.with_views(check, more=SHARED)
        return fn

    return register


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_ALLOWED = quoted(dyads.PAIRABLE_ROLES)
_ENDS = [
    "sample_id", "bird_id", "group_id", "territory_id", "role", "catch_time", "time_in_fridge", "sample_date",
    "sampling_age", "sex",
]
_BOTH = ", ".join(f"a.{c} AS {c}_x, b.{c} AS {c}_y" for c in _ENDS)

# SQL the checks share. It follows the definitions, not the Spark plans: pairs
# are made first, classified and filtered afterwards.
SHARED = {
    "c_pairs": f"""
SELECT a.year AS year, a.season AS season, {_BOTH},
  CASE WHEN a.sample_id = b.sample_id THEN 'samesample' WHEN a.bird_id = b.bird_id THEN 'sameBird'
       WHEN a.group_id = b.group_id THEN 'sameGroup' WHEN a.group_id <> b.group_id THEN 'diffGroup' END AS relation
FROM samples a JOIN samples b ON a.year = b.year AND a.season = b.season AND a.ord < b.ord""",
    "c_allowed": f"SELECT * FROM c_pairs WHERE role_x IN ({_ALLOWED}) AND role_y IN ({_ALLOWED})",
    "c_typed": """
SELECT * FROM (
SELECT p.*, least(bird_id_x, bird_id_y) AS bird_a, greatest(bird_id_x, bird_id_y) AS bird_b,
  CASE WHEN relation <> 'sameGroup' THEN relation
       WHEN role_x IN ('BrM', 'BrF') AND role_y IN ('BrM', 'BrF') THEN 'Dominantpair'
       WHEN (role_x IN ('BrM', 'BrF') AND role_y = 'H') OR (role_y IN ('BrM', 'BrF') AND role_x = 'H') THEN 'DomHelp'
       WHEN (role_x IN ('BrM', 'BrF') AND role_y IN ('AB', 'ABX')) OR (role_y IN ('BrM', 'BrF') AND role_x IN ('AB', 'ABX')) THEN 'DomSub'
       WHEN (role_x = 'H' AND role_y IN ('AB', 'ABX')) OR (role_y = 'H' AND role_x IN ('AB', 'ABX')) THEN 'HelpSub'
       WHEN role_x IN ('H', 'AB', 'ABX') AND role_y IN ('H', 'AB', 'ABX') THEN 'SubSub'
       ELSE 'sameTerrothers' END AS pair_type,
  abs(catch_time_x - catch_time_y) AS catch_time_diff,
  abs(time_in_fridge_x - time_in_fridge_y) AS fridge_diff,
  CAST(abs(sample_date_x - sample_date_y) AS INTEGER) AS sample_date_diff,
  abs(sampling_age_x - sampling_age_y) AS age_diff,
  CASE WHEN sex_x = sex_y THEN '0' ELSE '1' END AS sex_diff
FROM c_allowed p) t WHERE pair_type NOT IN ('sameTerrothers', 'sameBird')""",
    "c_related": """
SELECT t.*, e.relatedness FROM c_typed t LEFT JOIN edges e ON t.bird_a = e.bird_a AND t.bird_b = e.bird_b""",
    "c_best": f"""
SELECT group_id, bird_id, role, period_id, territory_id FROM (
SELECT s.group_id, s.bird_id, s.role, g.period_id, g.territory_id,
  row_number() OVER (PARTITION BY s.bird_id, g.period_id ORDER BY
    list_position([{quoted(roster.ROLE_PRIORITY)}], s.role), s.group_id) AS rn
FROM status s JOIN groups g ON s.group_id = g.group_id) r
WHERE rn = 1 AND role IN ({quoted(roster.ROSTER_ROLES)})""",
    "c_dim": """
SELECT group_id, n_members,
  CASE WHEN male IS NULL OR female IS NULL OR male = 0 OR female = 0 THEN 0
       ELSE row_number() OVER (PARTITION BY male, female ORDER BY group_id) END AS seasons_together,
  CASE WHEN helpers > 0 THEN 'yes' ELSE 'no' END AS helper_present,
  CASE WHEN young > 0 THEN 'yes' ELSE 'no' END AS fledgling_present, territory_id
FROM (SELECT group_id, territory_id, count(bird_id) AS n_members,
  min(CASE WHEN role = 'BrM' THEN bird_id END) AS male, min(CASE WHEN role = 'BrF' THEN bird_id END) AS female,
  count(CASE WHEN role = 'H' THEN 1 END) AS helpers, count(CASE WHEN role IN ('FL', 'OFL') THEN 1 END) AS young
  FROM c_best GROUP BY group_id, territory_id) d""",
    "c_first": """
SELECT f.bird_id, f.group_id, f.role, f.status_id, g.period_id, g.territory_id FROM (
SELECT *, row_number() OVER (PARTITION BY bird_id ORDER BY status_id) AS rn FROM status) f
JOIN groups g ON f.group_id = g.group_id WHERE rn = 1""",
    "c_attendants": """
SELECT group_id, role, row_number() OVER (PARTITION BY group_id, role ORDER BY bird_id) AS slot, bird_id
FROM (SELECT DISTINCT s.group_id, s.role, s.bird_id FROM status s JOIN c_first f ON s.group_id = f.group_id
      WHERE s.role IN ('BrM', 'BrF', 'H')) u""",
    "c_natal_all": """
SELECT f.bird_id, f.territory_id AS first_territory_id, a.role AS attendant_role, a.slot, a.bird_id AS attendant
FROM c_first f LEFT JOIN c_attendants a ON f.group_id = a.group_id""",
    # the numbered attendants the published rule names
    "c_attend": """
SELECT group_id, """ + ", ".join(
        f"max(CASE WHEN role = '{r}' AND slot = {i} THEN bird_id END) AS {r}_{i}"
        for r, w in (("BrF", 2), ("BrM", 2), ("H", 3)) for i in range(1, w + 1)
    ) + """
FROM c_attendants GROUP BY group_id""",
    "c_natal": """
SELECT f.bird_id, f.territory_id AS first_territory_id, a.BrF_1, a.BrF_2, a.BrM_1, a.BrM_2, a.H_1, a.H_2, a.H_3
FROM c_first f LEFT JOIN c_attend a ON f.group_id = a.group_id""",
    "c_parents": """
SELECT parent, off_id, spouse_id FROM (
SELECT *, row_number() OVER (PARTITION BY off_id ORDER BY file_row) AS rn FROM offspring WHERE confidence > 80) o
WHERE rn = 1 AND parent IS NOT NULL""",
    "c_born": """
SELECT t.*, CASE WHEN bird_id_y = nx.BrF_1 OR bird_id_y = nx.BrM_1 OR bird_id_y = nx.H_1 OR bird_id_y = nx.BrF_2
   OR bird_id_y = nx.BrM_2 OR bird_id_y = nx.H_2 OR bird_id_y = nx.H_3 OR bird_id_x = ny.BrF_1 OR bird_id_x = ny.BrM_1
   OR bird_id_y = ny.H_1 OR bird_id_y = ny.BrF_2 OR bird_id_y = ny.BrM_2 OR bird_id_y = ny.H_2 OR bird_id_y = ny.H_3
  THEN 'same' ELSE 'different' END AS shared_natal
FROM c_related t LEFT JOIN c_natal nx ON t.bird_id_x = nx.bird_id LEFT JOIN c_natal ny ON t.bird_id_y = ny.bird_id""",
    "c_share": "SELECT sample_id, taxon_id, n, n / sum(n) OVER (PARTITION BY sample_id) AS share FROM abund",
    "c_core": """
SELECT taxon_id FROM c_share GROUP BY taxon_id
HAVING count(CASE WHEN share > 0.0001 THEN 1 END) / (SELECT count(DISTINCT sample_id) FROM c_share) > 0.05""",
    # all samples by all core taxa, zeros filled in
    "c_grid": """
SELECT s.sample_id, c.taxon_id, coalesce(a.n, 0) AS n
FROM (SELECT DISTINCT sample_id FROM abund) s CROSS JOIN c_core c
LEFT JOIN abund a ON a.sample_id = s.sample_id AND a.taxon_id = c.taxon_id""",
    "c_gridshare": "SELECT sample_id, taxon_id, n, n / sum(n) OVER (PARTITION BY sample_id) AS share FROM c_grid",
    "c_log": """
SELECT sample_id, taxon_id, n, ln(share + (SELECT min(share) / 2 FROM c_gridshare WHERE share > 0)) AS v FROM c_gridshare""",
    "c_clr": "SELECT sample_id, taxon_id, n, v - avg(v) OVER (PARTITION BY sample_id) AS clr FROM c_log",
    "c_distance": """
SELECT a.sample_id AS sample_id_x, b.sample_id AS sample_id_y, sqrt(sum((a.clr - b.clr) * (a.clr - b.clr))) AS distance
FROM (SELECT c.*, s.period_id FROM c_clr c JOIN sites s ON c.sample_id = s.sample_id) a
JOIN (SELECT c.*, s.period_id FROM c_clr c JOIN sites s ON c.sample_id = s.sample_id) b
  ON a.period_id = b.period_id AND a.sample_id < b.sample_id AND a.taxon_id = b.taxon_id
GROUP BY a.sample_id, b.sample_id""",
    "c_units": """
SELECT a.sample_id, a.taxon_id, unnest(range(1, a.n + 1)) AS i
FROM abund a JOIN (SELECT sample_id FROM abund GROUP BY sample_id HAVING sum(n) >= 8000) d ON a.sample_id = d.sample_id""",
    "c_rare": """
SELECT sample_id, taxon_id, count(*) AS n FROM (
SELECT sample_id, taxon_id, row_number() OVER (PARTITION BY sample_id ORDER BY
  md5('88|' || sample_id || '|' || taxon_id || '|' || i)) AS rn FROM c_units) r
WHERE rn <= 8000 GROUP BY sample_id, taxon_id""",
    # genus groups with their most abundant taxon
    "c_glom": """
SELECT family, genus, taxon_id FROM (
SELECT t.family, t.genus, t.taxon_id, row_number() OVER (PARTITION BY t.family, t.genus ORDER BY s.total DESC, t.taxon_id) AS rn
FROM taxonomy t JOIN (SELECT taxon_id, sum(n) AS total FROM abund GROUP BY taxon_id) s ON t.taxon_id = s.taxon_id
WHERE t.genus IS NOT NULL) r WHERE rn = 1""",
    "c_glomcounts": """
SELECT a.sample_id, g.taxon_id, g.genus, CAST(sum(a.n) AS BIGINT) AS n
FROM abund a JOIN taxonomy t ON a.taxon_id = t.taxon_id
JOIN c_glom g ON t.family = g.family AND t.genus = g.genus GROUP BY a.sample_id, g.taxon_id, g.genus""",
    # order-level community
    "c_oshare": "SELECT sample_id, taxon_id, n / sum(n) OVER (PARTITION BY sample_id) AS share FROM order_abund",
    "c_ocore": """
SELECT taxon_id FROM c_oshare GROUP BY taxon_id
HAVING count(CASE WHEN share > 0.0001 THEN 1 END) / (SELECT count(DISTINCT sample_id) FROM c_oshare) > 0.05""",
    "c_ogrid": """
SELECT s.sample_id, c.taxon_id, coalesce(a.n, 0) AS n
FROM (SELECT DISTINCT o.sample_id FROM order_abund o JOIN c_ocore k ON o.taxon_id = k.taxon_id) s CROSS JOIN c_ocore c
LEFT JOIN order_abund a ON a.sample_id = s.sample_id AND a.taxon_id = c.taxon_id""",
    "c_ogridshare": "SELECT sample_id, taxon_id, n / sum(n) OVER (PARTITION BY sample_id) AS share FROM c_ogrid",
    "c_oclr": """
SELECT sample_id, taxon_id, v - avg(v) OVER (PARTITION BY sample_id) AS clr FROM (
SELECT sample_id, taxon_id, ln(share + (SELECT min(share) / 2 FROM c_ogridshare WHERE share > 0)) AS v FROM c_ogridshare) l""",
    "c_similar": """
SELECT * FROM (
SELECT t.sample_id_x, t.sample_id_y, t.year, t.season, t.bird_a, t.bird_b, t.relation, t.pair_type,
  -sqrt(sum((a.clr - b.clr) * (a.clr - b.clr))) AS similarity
FROM c_typed t JOIN c_oclr a ON t.sample_id_x = a.sample_id
JOIN c_oclr b ON t.sample_id_y = b.sample_id AND a.taxon_id = b.taxon_id
GROUP BY t.sample_id_x, t.sample_id_y, t.year, t.season, t.bird_a, t.bird_b, t.relation, t.pair_type) d
WHERE similarity < -0.000000001""",
    "c_alpha": """
SELECT sample_id, count(*) AS observed, -sum(n / total * ln(n / total)) AS shannon,
  count(*) + count(CASE WHEN n = 1 THEN 1 END) * (count(CASE WHEN n = 1 THEN 1 END) - 1)
    / (2.0E0 * (count(CASE WHEN n = 2 THEN 1 END) + 1)) AS chao1
FROM (SELECT sample_id, n, sum(n) OVER (PARTITION BY sample_id) AS total FROM abund WHERE n > 0) p GROUP BY sample_id""",
    "c_oalpha": """
SELECT sample_id, count(*) AS observed, -sum(n / total * ln(n / total)) AS shannon
FROM (SELECT sample_id, n, sum(n) OVER (PARTITION BY sample_id) AS total FROM c_orare WHERE n > 0) p GROUP BY sample_id""",
    "c_ounits": f"""
SELECT a.sample_id, a.taxon_id, unnest(range(1, a.n + 1)) AS i FROM order_abund a
JOIN (SELECT sample_id FROM order_abund GROUP BY sample_id HAVING sum(n) >= {ORDER_DEPTH}) d ON a.sample_id = d.sample_id""",
    "c_orare": f"""
SELECT sample_id, taxon_id, count(*) AS n FROM (
SELECT sample_id, taxon_id, row_number() OVER (PARTITION BY sample_id ORDER BY
  md5('88|' || sample_id || '|' || taxon_id || '|' || i)) AS rn FROM c_ounits) r
WHERE rn <= {ORDER_DEPTH} GROUP BY sample_id, taxon_id""",
}
