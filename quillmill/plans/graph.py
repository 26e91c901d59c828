"""Queries over graphs built from the star schema and the article table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions.skew import hot_join
from quillmill.functions.text import entity_key
from quillmill.operators import graph as G
from quillmill.operators.parsing import groups_json
from quillmill.plans.catalogue import query
from quillmill.session import cut_lineage, table

_KEY = "'entity_' || substr(md5(lower(trim(regexp_replace({0}, '[\\s\\p{{Z}}]+', ' ', 'g')))), 1, 16)"
_GRAPH = f"""ent AS (SELECT {_KEY.format('c_name')} AS id, c_name AS name, 'person' AS type FROM customer UNION SELECT {_KEY.format('s_name')}, s_name, 'organization' FROM supplier
  UNION SELECT {_KEY.format('n_name')}, n_name, 'geo' FROM nation UNION SELECT {_KEY.format('r_name')}, r_name, 'geo' FROM region),
rel AS (SELECT {_KEY.format('c_name')} AS src, {_KEY.format('n_name')} AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT {_KEY.format('s_name')}, {_KEY.format('n_name')} FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION SELECT {_KEY.format('n_name')}, {_KEY.format('r_name')} FROM nation JOIN region ON n_regionkey = r_regionkey),
e2 AS (SELECT src, dst FROM rel UNION SELECT dst, src FROM rel)"""


def entities(spark: SparkSession, d: str) -> DataFrame:
    parts = [("customer", "c_name", "person"), ("supplier", "s_name", "organization"), ("nation", "n_name", "geo"), ("region", "r_name", "geo")]
    names = None
    for t, c, kind in parts:
        one = table(spark, d, t).select(F.col(c).alias("name"), F.lit(kind).alias("type"))
        names = one if names is None else names.unionByName(one)
    return G.entity_table(names, "name", "type")


def relations(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    link = lambda x, a, b: x.select(entity_key(F.col(a)).alias("src"), entity_key(F.col(b)).alias("dst"))
    c = link(table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")), "c_name", "n_name")
    s = link(table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")), "s_name", "n_name")
    r = link(n.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")), "n_name", "r_name")
    return c.unionByName(s).unionByName(r).distinct()


@query(f"WITH {_GRAPH}, g AS (SELECT src, count(*) AS degree FROM e2 GROUP BY src) SELECT id, name, type, coalesce(degree, 0) AS degree FROM ent LEFT JOIN g ON id = src")
def build_graph(spark: SparkSession, d: str) -> DataFrame:
    degree = G.both_ways(relations(spark, d)).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return entities(spark, d).join(degree, "id", "left").select("id", "name", "type", F.coalesce("degree", F.lit(0)).alias("degree"))


@query(f"""WITH {_GRAPH}, s AS (SELECT id AS start FROM ent WHERE name IN (SELECT r_name FROM region)),
h1 AS (SELECT DISTINCT start, dst AS node FROM s JOIN e2 ON src = start), h2 AS (SELECT DISTINCT start, dst AS node FROM h1 JOIN e2 ON src = node)
SELECT start, node, min(hops)::INT AS hops FROM (SELECT start, start AS node, 0 AS hops FROM s UNION ALL SELECT start, node, 1 FROM h1 UNION ALL SELECT start, node, 2 FROM h2) GROUP BY start, node""")
def khop_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    starts = table(spark, d, "region").select(entity_key(F.col("r_name")).alias("start"))
    return G.k_hop(relations(spark, d), starts, 2)


_MENTION = f"men AS (SELECT DISTINCT {_KEY.format('c_name')} AS id, 'o-' || (o_orderkey % 97) AS chunk_id FROM orders JOIN customer ON o_custkey = c_custkey)"


def mentions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(entity_key(F.col("c_name")).alias("id"), F.concat(F.lit("o-"), (F.col("o_orderkey") % 97).cast("string")).alias("chunk_id")).distinct()


@query(f"""WITH {_GRAPH}, {_MENTION}, q AS (SELECT n_nationkey AS question, lower(n_name) AS name FROM nation), s AS (SELECT question, id AS start FROM q JOIN ent ON lower(ent.name) = q.name),
h AS (SELECT question, start AS node, 0 AS h FROM s UNION SELECT question, dst, 1 FROM s JOIN e2 ON src = start UNION SELECT question, b.dst, 2 FROM s JOIN e2 a ON a.src = start JOIN e2 b ON b.src = a.dst),
c AS (SELECT question, chunk_id, min(h) AS h FROM h JOIN men ON node = id GROUP BY question, chunk_id), r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY h, chunk_id) AS place FROM c)
SELECT question, chunk_id, place::INT AS place FROM r WHERE place <= 5""")
def local_search(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("question"), F.lower("n_name").alias("name"))
    ents = entities(spark, d).withColumn("cluster_id", F.col("id"))
    return G.local_search(names, ents, relations(spark, d), mentions(spark, d))


_ART = """a AS (SELECT DISTINCT article_id, lower(title) AS t, url FROM val_articles),
e AS (SELECT DISTINCT a.article_id AS x, b.article_id AS y FROM a JOIN a b ON a.t = b.t OR a.url = b.url),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), c AS (SELECT x AS article_id, min(y) AS cluster_id FROM r GROUP BY x)"""


def article_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Articles with equal title or url, also through others; linked by stars around the smallest id of each value."""
    a = table(spark, d, "val_articles").select("article_id", F.lower("title").alias("t"), "url", "words").distinct()
    star = lambda c: hot_join(a, a.groupBy(c).agg(F.min("article_id").alias("dst")), c).select(F.col("article_id").alias("src"), "dst")
    return G.alias_clusters(a, star("t").unionByName(star("url")).filter("src <> dst"), "article_id")


@query(f"""WITH RECURSIVE {_ART}, m AS (SELECT article_id, cluster_id, t, (SELECT count(*) FROM e WHERE x = article_id) AS w FROM c JOIN (SELECT article_id, min(t) AS t FROM a GROUP BY 1) USING (article_id))
SELECT article_id, cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY w DESC, length(t) DESC, article_id) = 1 AS is_canonical FROM m""")
def alias_components(spark: SparkSession, d: str) -> DataFrame:
    x = article_clusters(spark, d).groupBy("article_id", "cluster_id").agg(F.min("t").alias("t"))
    a = table(spark, d, "val_articles").select("article_id", F.lower("title").alias("t"), "url").distinct()
    n_t, n_u, n_tu = (a.groupBy(*k).agg(F.countDistinct("article_id").alias(n)) for k, n in ((["t"], "n_t"), (["url"], "n_u"), (["t", "url"], "n_tu")))
    w = a.join(n_t, "t").join(n_u, "url").join(n_tu, ["t", "url"]).select("article_id", (F.col("n_t") + F.col("n_u") - F.col("n_tu")).alias("w"))
    return G.canonical(x.join(w, "article_id"), "cluster_id", "article_id", "t", "w").select("article_id", "cluster_id", "is_canonical")


@query(f"""WITH RECURSIVE {_ART} SELECT cluster_id, list_sort(list(article_id)) AS aliases FROM c GROUP BY cluster_id HAVING count(*) > 1""")
def alias_groups(spark: SparkSession, d: str) -> DataFrame:
    """Members of each alias cluster; gathered, as the list is the result (clusters here are a handful of records)."""
    x = article_clusters(spark, d).select("article_id", "cluster_id").distinct()
    return x.groupBy("cluster_id").agg(F.array_sort(F.collect_list("article_id")).alias("aliases")).filter(F.size("aliases") > 1)


@query()
def community_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Communities of two entities or more with their size and chunks."""
    labels = G.label_communities(relations(spark, d))
    m = labels.join(mentions(spark, d), labels["node"] == F.col("id"), "left").groupBy("community").agg(F.countDistinct("node").alias("entities"), F.countDistinct("chunk_id").alias("chunks"))
    return m.filter("entities >= 2")


_NAMES = "p AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY p_name), t AS (SELECT id, name, unnest(list_distinct(string_split(lower(name), ' '))) AS w FROM p), s AS (SELECT a.id AS a, b.id AS b, a.name AS na, b.name AS nb, count(*) AS shared FROM t a JOIN t b ON a.w = b.w AND a.id < b.id GROUP BY ALL)"


def part_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id")).withColumn("type", F.lit("part"))


_CANDIDATES = f"""{_NAMES}, v AS (SELECT a, b, na, nb, (CASE WHEN contains(lower(na), lower(nb)) OR contains(lower(nb), lower(na)) THEN 3 ELSE 0 END + 2 + CASE WHEN EXISTS (SELECT 1 FROM part x JOIN part y ON x.p_brand = y.p_brand WHERE x.p_name = na AND y.p_name = nb) THEN 2 ELSE 0 END)::DOUBLE AS score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rk FROM v)"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of part names that share a word, scored by containment and by a shared brand, the best eight of each name."""
    pairs = G.shared_token_pairs(part_names(spark, d), "id", "name", "type")
    brands = table(spark, d, "part").groupBy("p_name").agg(F.collect_set("p_brand").alias("brands"))  # a name's own brands, of a few dozen
    side = lambda n: brands.select(F.col("p_name").alias(f"name_{n}"), F.col("brands").alias(f"brands_{n}"))
    part = F.contains(F.lower("name_a"), F.lower("name_b")) | F.contains(F.lower("name_b"), F.lower("name_a"))
    x = pairs.join(side("a"), "name_a").join(side("b"), "name_b")
    score = F.when(part, 3.0).otherwise(0.0) + 2.0 + F.when(F.arrays_overlap("brands_a", "brands_b"), 2.0).otherwise(0.0)
    v = x.select("a", "b", "name_a", "name_b", score.alias("score"))
    return v.withColumn("rk", F.row_number().over(Window.partitionBy("a").orderBy(F.col("score").desc(), "b"))).filter("rk <= 8")


@query(f"WITH {_CANDIDATES} SELECT a, b, score, rk::INT AS rk FROM r WHERE rk <= 8")
def candidate_blocking(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select("a", "b", "score", "rk")


_RESOLVED = f"""{_CANDIDATES}, c AS (SELECT * FROM r WHERE rk <= 8), tx AS (SELECT a AS id, na || ', còn gọi là ' || nb AS text FROM c WHERE rk = 2 AND a % 3 = 0),
k AS (SELECT a, b, rk, CASE (a + b) % 7 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'none' END AS kind, EXISTS (SELECT 1 FROM tx WHERE tx.id IN (a, b) AND (contains(lower(text), lower(na || ', còn gọi là ' || nb)) OR contains(lower(text), lower(nb || ', còn gọi là ' || na)))) AS told FROM c),
f AS (SELECT a, arg_min(b, (rk, b)) FILTER (WHERE told) AS t, arg_min(b, (rk, b)) FILTER (WHERE kind = 'yes') AS r FROM k GROUP BY a),
z AS (SELECT a, coalesce(t, r) AS match, CASE WHEN t IS NOT NULL THEN 'regex' WHEN r IS NOT NULL THEN 'relation_positive' ELSE 'keep' END AS method FROM f)"""


def resolved(spark: SparkSession, d: str) -> DataFrame:
    """Part names resolved against their candidates; a third of them have a text that names the second candidate as theirs."""
    c = cut_lineage(candidates(spark, d))
    texts = c.filter((F.col("rk") == 2) & (F.col("a") % 3 == 0)).select(F.col("a").alias("id"), F.concat("name_a", F.lit(", còn gọi là "), "name_b").alias("text"))
    k = (F.col("a") + F.col("b")) % 7
    edges = c.filter(k <= 2).select(F.col("b").alias("src"), F.col("a").alias("dst"), F.when(k == 0, "TÊN_KHÁC").when(k == 1, "CON_CỦA").otherwise("SAME_AS").alias("kind"))
    return G.resolve_safely(c, texts, edges)


@query(f"WITH {_RESOLVED} SELECT a, match, method FROM z")
def safe_resolution(spark: SparkSession, d: str) -> DataFrame:
    return resolved(spark, d)


@query(f"""WITH {_RESOLVED}, m AS (SELECT z.*, a + 1 AS guess, (a % 10) / 10.0 AS confidence, (a + 1) % 10 AS size FROM z)
SELECT a, CASE WHEN method = 'keep' AND a % 2 = 0 AND confidence >= CASE WHEN size <= 2 THEN 0.7 WHEN size <= 4 THEN 0.85 ELSE 0.95 END AND size < 8 THEN guess ELSE match END AS match,
  CASE WHEN method <> 'keep' OR a % 2 = 1 THEN method WHEN confidence >= CASE WHEN size <= 2 THEN 0.7 WHEN size <= 4 THEN 0.85 ELSE 0.95 END AND size < 8 THEN 'llm' ELSE 'below_threshold_or_cluster_full' END AS method FROM m""")
def model_resolution(spark: SparkSession, d: str) -> DataFrame:
    """What was kept apart, with a stand-in model's guess for every second name; the bar rises with the cluster's size."""
    s = cut_lineage(resolved(spark, d))
    answers = s.filter(F.col("a") % 2 == 0).select("a", (F.col("a") + 1).alias("b"), ((F.col("a") % 10) / 10.0).alias("confidence"))
    clusters = answers.select(F.col("b").alias("id"), (F.col("b") % 10).alias("size")).distinct()
    return G.resolve_with_model(s, answers, clusters)


@query("""WITH e AS (SELECT s_suppkey AS src, s_nationkey AS dst, CASE s_suppkey % 4 WHEN 0 THEN 'SAME_AS' WHEN 1 THEN 'LIES_IN' ELSE 'TRADES' END AS kind FROM supplier UNION SELECT s_nationkey, s_suppkey, 'HOLDS' FROM supplier WHERE s_suppkey % 2 = 0)
SELECT DISTINCT s_suppkey AS a, s_nationkey AS b, e.kind FROM supplier JOIN e ON (e.src = s_suppkey AND e.dst = s_nationkey) OR (e.src = s_nationkey AND e.dst = s_suppkey) WHERE e.kind <> 'SAME_AS'""")
def relation_between(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    edges = s.select(k.alias("src"), F.col("s_nationkey").alias("dst"), F.when(k % 4 == 0, "SAME_AS").when(k % 4 == 1, "LIES_IN").otherwise("TRADES").alias("kind"))
    back = s.filter(k % 2 == 0).select(F.col("s_nationkey").alias("src"), k.alias("dst"), F.lit("HOLDS").alias("kind"))
    return G.relations_between(s.select(k.alias("a"), F.col("s_nationkey").alias("b")), edges.unionByName(back))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN c_name ELSE '"' || c_name || '"' END AS src, n_name AS tgt, CASE WHEN c_custkey % 5 = 0 THEN 'own' WHEN c_custkey % 4 = 2 THEN '' ELSE 'from ' || n_name END AS description,
'search_document: ' || CASE WHEN c_custkey % 4 = 3 THEN c_name ELSE '"' || c_name || '"' END || ' -> ' || n_name || CASE WHEN c_custkey % 5 = 0 THEN ': own' WHEN c_custkey % 4 = 2 THEN '' ELSE ': from ' || n_name END AS text FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def edge_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """Relation items whose ends are quoted or bare get their description from edges that are quoted otherwise, or lack it."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    quoted = F.concat(F.lit('"'), "c_name", F.lit('"'))
    items = c.select(k, F.when(k % 4 == 3, F.col("c_name")).otherwise(quoted).alias("src"), F.col("n_name").alias("tgt"), F.when(k % 5 == 0, "own").otherwise("").alias("description"))
    edges = c.filter(k % 4 != 2).select(F.when(k % 4 == 0, quoted).when(k % 4 == 1, F.col("c_name")).otherwise(quoted).alias("src"), F.col("n_name").alias("tgt"), F.concat(F.lit("from "), "n_name").alias("description"))
    return G.edge_texts(items, edges)


@query("""SELECT r_regionkey::VARCHAR AS community_id, '[Nhóm ' || r_regionkey || '] (gồm: ' || (SELECT string_agg(n_name, ', ' ORDER BY n_name) FROM nation WHERE n_regionkey = r_regionkey) || ')' || chr(10) || 'about ' || r_name AS block FROM region""")
def global_search_blocks(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = m.groupBy(F.col("r_regionkey").cast("string").alias("community_id"), "r_name").agg(F.array_sort(F.collect_set("n_name")).alias("entities")).withColumn("summary", F.concat(F.lit("about "), "r_name"))
    return G.summary_blocks(s)


@query("""SELECT s_suppkey AS id, s_suppkey % 4 = 1 AS linked FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0""")
def pending_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that an incremental resolution still has to look at, and whether an edge is left of them once those of one type are deleted."""
    k = F.col("s_suppkey")
    nodes = table(spark, d, "supplier").select(k.alias("id"), (k % 3 != 0).alias("is_canonical"), F.when(k % 5 == 0, True).alias("resolved"), F.when(k % 7 == 0, "date").otherwise("geo").alias("type"))
    edges = table(spark, d, "supplier").filter(k % 4 <= 1).select(k.alias("src"), F.when(k % 4 == 0, "SAME_AS").otherwise("LIES_IN").alias("kind"))
    left = G.without_relations(edges, "SAME_AS").select(F.col("src").alias("id"), F.lit(True).alias("linked"))
    return G.pending(nodes, ["date"]).join(left, "id", "left").select("id", F.coalesce("linked", F.lit(False)).alias("linked"))


@query(f"WITH {_NAMES} SELECT na AS name_a, nb AS name_b, shared FROM s WHERE shared >= 2 OR contains(lower(na), lower(nb)) OR contains(lower(nb), lower(na))")
def similar_unmerged(spark: SparkSession, d: str) -> DataFrame:
    pairs = G.shared_token_pairs(part_names(spark, d), "id", "name", "type")
    part = F.contains(F.lower("name_a"), F.lower("name_b")) | F.contains(F.lower("name_b"), F.lower("name_a"))
    return pairs.filter((F.col("shared") >= 2) | part).select("name_a", "name_b", "shared")


@query()
def close_match(spark: SparkSession, d: str) -> DataFrame:
    """Questions asked of misspelt part names: the closest known name by similarity."""
    names = part_names(spark, d)
    asked = names.select(F.concat(F.substring("name", 1, 3), F.lit("e"), F.expr("substring(name, 4)")).alias("asked"))
    return G.close_matches(asked, "asked", names, "name")


@query(f"""WITH {_GRAPH}, {_MENTION}, x AS (SELECT n_name, id, src FROM nation JOIN ent ON ent.name = n_name JOIN e2 ON dst = id), y AS (SELECT n_name, e.name, m.chunk_id FROM x JOIN ent e ON e.id = x.src LEFT JOIN men m ON m.id = x.src)
SELECT n_name, string_agg(DISTINCT name, ', ' ORDER BY name) AS entities, count(DISTINCT chunk_id) AS chunks FROM y GROUP BY n_name""")
def kb_context(spark: SparkSession, d: str) -> DataFrame:
    """Context of each nation: sorted names of its neighbours, number of chunks that mention them."""
    e = entities(spark, d)
    near = G.both_ways(relations(spark, d)).join(e.select(F.col("id").alias("dst"), F.col("name").alias("n_name")), "dst").join(table(spark, d, "nation").select("n_name"), "n_name").select("n_name", F.col("src").alias("id"))
    y = near.join(e.select("id", "name"), "id").join(mentions(spark, d), "id", "left")
    return y.groupBy("n_name").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("entities"), F.countDistinct("chunk_id").alias("chunks"))


@query("""WITH t AS (SELECT n_name AS k, min('nation ' || n_nationkey) AS d FROM nation GROUP BY 1) SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN n_name || ': ' || 'nation ' || n_nationkey WHEN c_custkey % 3 = 1 THEN n_name || ': nation ' || n_nationkey ELSE 'unknown: ' END AS text
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def rejoin_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """Vector items whose key is quoted, plain or unknown get their description back by two keys and a default."""
    n = table(spark, d, "nation")
    k = F.col("c_custkey") % 3
    items = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(k == 0, F.concat(F.lit('"'), "n_name", F.lit('"'))).when(k == 1, F.col("n_name")).otherwise(F.lit("unknown")).alias("key"))
    texts = n.select("n_name", F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("description"))
    x = G.described(items, "key", texts, "n_name", "description")
    return x.select("c_custkey", F.concat(F.regexp_replace("key", '"', ""), F.lit(": "), F.col("description")).alias("text"))


@query("""WITH m AS (SELECT r_name, n_name, r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey), g AS (SELECT CASE WHEN r_regionkey < 2 THEN '0_1' ELSE r_regionkey::VARCHAR END AS community_id, n_name, r_name, r_regionkey FROM m)
SELECT community_id, list_sort(list(DISTINCT n_name)) AS members, (SELECT string_agg(DISTINCT 'about ' || h.r_name, chr(10) ORDER BY 'about ' || h.r_name) FROM g h WHERE h.community_id = g.community_id) AS summary FROM g GROUP BY community_id""")
def community_merge(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = m.groupBy(F.col("r_regionkey").cast("string").alias("community_id"), "r_name").agg(F.array_sort(F.collect_set("n_name")).alias("entities")).withColumn("summary", F.concat(F.lit("about "), "r_name"))
    reply = spark.range(1).select(F.lit('{"merged_groups": [["ID: 0", "id_1"], ["ID 7"]]}').alias("raw"))
    return G.merge_groups(s, reply.select(F.explode(groups_json(F.col("raw"))).alias("group")))


@query(f"""WITH {_MENTION}, i AS (SELECT id, count(*)::INT AS n, md5(array_to_string(list_sort(list(chunk_id)), ',')) AS chunks FROM men GROUP BY id), k AS (SELECT least(c_name, n_name) || '<SEP>' || greatest(c_name, n_name) AS pair, {_KEY.format('c_name')} AS id FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT pair, coalesce(n, 0)::INT AS mentions, chunks FROM k LEFT JOIN i USING (id)""")
def entity_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Inverted index of entities by chunk, joined to the relation keys; entities without mention stay."""
    i = G.inverted_index(mentions(spark, d), "id", "chunk_id").select(F.col("key").alias("id"), "count", F.md5(F.array_join("chunk_ids", ",")).alias("chunks"))
    k = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(G.pair_key("c_name", "n_name").alias("pair"), entity_key(F.col("c_name")).alias("id"))
    return k.join(i, "id", "left").select("pair", F.coalesce("count", F.lit(0)).alias("mentions"), "chunks")
