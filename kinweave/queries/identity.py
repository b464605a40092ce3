"""Queries over identity resolution."""

from pyspark.sql import functions as F

from kinweave.functions.similarity import segment_compatible
from kinweave.operators import identity
from kinweave.operators.components import connected_components
from kinweave.queries.registry import query
from kinweave.queries.sqlviews import PERSONS, with_ctes
from kinweave.schemas import Logs
from kinweave.session import settle
from kinweave.sources import views


def person_logs(spark, sf) -> Logs:
    """Persons as senders: everybody commits, some write; a few are bots or touch no source."""
    who = views.persons(spark, sf)
    bot = (F.col("p_size") == 1).cast("int").alias("is_bot")
    tech = who.select(
        "project", F.col("name").alias("sender"), bot, (F.col("p_partkey") % 7 != 0).cast("int").alias("is_coding"))
    social = who.where("p_size > 20 AND project <> 'proj9'").select("project", F.col("name").alias("sender"), bot)
    return Logs(tech, social)


KEYS = r"""keyed AS (SELECT DISTINCT project, name,
  trim(regexp_replace(regexp_replace(split_part(name, '@', 1), '[(\[].*?[)\]]', '', 'g'), '[^a-zA-Z ]+', '', 'g')) AS key FROM persons),
keys AS (SELECT DISTINCT project, key FROM keyed WHERE key <> ''),
pairs AS (
  SELECT a.project, a.key AS a, b.key AS b, jaro_winkler_similarity(a.key, b.key) AS score
  FROM keys a JOIN keys b ON a.project = b.project AND a.key < b.key
  WHERE jaro_winkler_similarity(a.key, b.key) > 0.9
    AND (len(string_split(a.key, ' ')) <> 2 OR len(string_split(b.key, ' ')) <> 2
         OR (jaro_winkler_similarity(split_part(a.key, ' ', 1), split_part(b.key, ' ', 1)) >= 0.8
             AND jaro_winkler_similarity(split_part(a.key, ' ', 2), split_part(b.key, ' ', 2)) >= 0.8)))"""
CLUSTERS = """reach AS (
  SELECT project, key AS node, key AS label FROM keys
  UNION
  SELECT r.project, CASE WHEN p.a = r.node THEN p.b ELSE p.a END, r.label
  FROM reach r JOIN pairs p ON p.project = r.project AND (p.a = r.node OR p.b = r.node)),
comp AS (SELECT project, node AS key, min(label) AS component FROM reach GROUP BY project, node),
clusters AS (
  SELECT project, name, key, min(name) OVER (PARTITION BY project, component) AS cluster,
         count(*) OVER (PARTITION BY project, component) AS names
  FROM keyed JOIN comp USING (project, key))"""


@query("person_universe", with_ctes(PERSONS) + """
, t AS (SELECT DISTINCT project, name FROM persons WHERE p_size <> 1 AND p_partkey % 7 <> 0),
s AS (SELECT DISTINCT project, name FROM persons WHERE p_size <> 1 AND p_size > 20 AND project <> 'proj9')
SELECT project, name FROM (SELECT * FROM t UNION SELECT * FROM s)
WHERE project IN (SELECT project FROM t) AND project IN (SELECT project FROM s)""")
def person_universe(spark, sf):
    logs = person_logs(spark, sf)
    return identity.person_universe(logs.tech, logs.social)


@query("normalise_name", with_ctes(PERSONS) + r"""
SELECT p_partkey, name, trim(regexp_replace(regexp_replace(split_part(name, '@', 1), '[(\[].*?[)\]]', '', 'g'), '[^a-zA-Z ]+', '', 'g')) AS key FROM persons""")
def normalise_name(spark, sf):
    return identity.normalise(views.persons(spark, sf).select("p_partkey", "name"))


@query("segment_compatible", """
WITH p AS (SELECT p_partkey, p_name AS a, lag(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part)
SELECT p_partkey, a, b, CASE WHEN jaro_winkler_similarity(split_part(a, ' ', 1), split_part(b, ' ', 1)) >= 0.8
  AND jaro_winkler_similarity(split_part(a, ' ', 2), split_part(b, ' ', 2)) >= 0.8 THEN 1 ELSE 0 END AS compatible
FROM p WHERE b IS NOT NULL""")
def segments(spark, sf):
    from kinweave.operators.ordering import previous
    part = views.table(spark, sf, "part").select("p_brand", "p_partkey", F.col("p_name").alias("a"))
    both = previous(part, ["p_brand"], ["p_partkey"], "a", "b").where("b IS NOT NULL")
    return both.select("p_partkey", "a", "b", segment_compatible("a", "b").cast("int").alias("compatible"))


@query("similar_pairs", with_ctes(PERSONS, KEYS) + "SELECT project, a, b, round(score, 6) AS score FROM pairs")
def similar_pairs(spark, sf):
    return identity.similar_pairs(views.persons(spark, sf)).withColumn("score", F.round("score", 6))


def clusters_of(spark, sf):
    who = views.persons(spark, sf).select("project", "name")
    return identity.alias_components(who, identity.similar_pairs(who))


@query("alias_components", with_ctes(PERSONS, KEYS, CLUSTERS, recursive=True) + """
SELECT project, cluster, name, key, CAST(names AS BIGINT) AS names FROM clusters WHERE names > 1""")
def alias_components(spark, sf):
    return clusters_of(spark, sf)


REFINED = """states AS (
  SELECT project, cluster, l, list_transform(l, lambda x: (list_sum(list_transform(l, lambda y: jaro_winkler_similarity(x.k, y.k))) - 1)
    / greatest(len(l) - 1, 1)) AS m
  FROM (SELECT project, cluster, list({'n': name, 'k': key} ORDER BY name) AS l FROM clusters WHERE names > 1 GROUP BY project, cluster)
  UNION ALL
  SELECT project, cluster, l, list_transform(l, lambda x: (list_sum(list_transform(l, lambda y: jaro_winkler_similarity(x.k, y.k))) - 1)
    / greatest(len(l) - 1, 1)) AS m
  FROM (SELECT project, cluster, list_filter(l, lambda x, i: i <> list_position(m, list_min(m))) AS l
        FROM states WHERE len(l) >= 2 AND list_min(m) < 0.9 - 1e-12)),
fitting AS (
  SELECT project, cluster, list_filter(l, lambda x, i: len(list_filter(l, lambda y, j:
    len(string_split(x.k, ' ')) = 2 AND len(string_split(y.k, ' ')) = 2
    AND (jaro_winkler_similarity(split_part(x.k, ' ', 1), split_part(y.k, ' ', 1)) < 0.8
         OR jaro_winkler_similarity(split_part(x.k, ' ', 2), split_part(y.k, ' ', 2)) < 0.8)
    AND m[i] <= m[j] + 1e-12)) = 0) AS l
  FROM states WHERE len(l) < 2 OR list_min(m) >= 0.9 - 1e-12),
refined AS (SELECT project, cluster, unnest(l).n AS name, unnest(l).k AS key FROM fitting WHERE len(l) BETWEEN 2 AND 5)"""


@query("refine_clusters", with_ctes(PERSONS, KEYS, CLUSTERS, REFINED, recursive=True) + "SELECT project, cluster, name, key FROM refined")
def refine_clusters(spark, sf):
    return identity.refine_clusters(clusters_of(spark, sf))


CANONICAL = """best AS (
  SELECT project, cluster, name, row_number() OVER (PARTITION BY project, cluster
    ORDER BY CASE WHEN len(string_split(name, ' ')) = 2 THEN 1 ELSE 0 END DESC, length(name) DESC, name DESC) AS rn
  FROM refined),
canon AS (SELECT project, cluster, array_to_string(list_transform(string_split(name, ' '),
    lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS full_name FROM best WHERE rn = 1)"""


@query("canonical_name", with_ctes(PERSONS, KEYS, CLUSTERS, REFINED, CANONICAL, recursive=True) +
       "SELECT project, cluster, full_name FROM canon")
def canonical_name(spark, sf):
    return identity.canonical_name(settle(identity.refine_clusters(clusters_of(spark, sf))))


@query("apply_aliases", with_ctes(PERSONS, KEYS, CLUSTERS, REFINED, CANONICAL, recursive=True) + """
, alias AS (SELECT c.project, c.name, n.full_name FROM refined c JOIN canon n ON n.project = c.project AND n.cluster = c.cluster)
SELECT p.project, p.name AS sender, coalesce(a.full_name, array_to_string(list_transform(string_split(p.name, ' '),
    lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')) AS dev, CAST(count(*) AS BIGINT) AS n
FROM persons p LEFT JOIN alias a ON a.project = p.project AND a.name = p.name
WHERE p.p_size <> 1 AND p.p_partkey % 7 <> 0 GROUP BY ALL""")
def apply_aliases(spark, sf):
    logs = identity.apply_aliases(person_logs(spark, sf), identity.alias_map(settle(identity.refine_clusters(clusters_of(spark, sf)))))
    return logs.tech.groupBy("project", "sender", "dev").agg(F.count(F.lit(1)).alias("n"))


WIDE = """persons AS (
  SELECT CASE WHEN (c_custkey // 3) % 2 = 0 THEN 'hot' ELSE 'proj' || ((c_custkey // 3) % 11) END AS project,
    CASE c_custkey % 3 WHEN 1 THEN w || ' ' || left(v, 6) WHEN 2 THEN left(w, 1) || w || ' ' || v ELSE w || ' ' || v END AS name
  FROM (SELECT c_custkey, substr(d, 1, 6) AS w, substr(d, 7, 7) AS v
        FROM (SELECT c_custkey, translate(md5(CAST(c_custkey - c_custkey % 3 AS VARCHAR)), '0123456789', 'ghijklmnop') AS d FROM customer)))"""


@query("similar_pairs_wide", with_ctes(WIDE, KEYS) + "SELECT project, a, b, round(score, 6) AS score FROM pairs")
def similar_pairs_wide(spark, sf):
    return identity.similar_pairs(views.people_wide(spark, sf)).withColumn("score", F.round("score", 6))


CHAIN_SQL = """
WITH o AS (SELECT o_custkey, md5(CAST(o_orderkey AS VARCHAR)) AS node, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT 'g' || (o_custkey % 7) AS project, node, min(node) OVER (PARTITION BY o_custkey) AS component FROM o WHERE n > 1"""


@query("components_sparse", CHAIN_SQL)
def components_sparse(spark, sf):
    return connected_components(views.order_chains(spark, sf), ["project"])


@query("components_sparse_rounds", CHAIN_SQL)
def components_sparse_rounds(spark, sf):
    return connected_components(views.order_chains(spark, sf), ["project"], small=0)
