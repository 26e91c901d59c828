"""Vector ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions.vectors import as_double, cosine, fit_dims, l2_unit, norm
from quillmill.plans.catalogue import query
from quillmill.session import table

_SCORED = """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv, label AS q_label FROM embeddings WHERE vec_id % 50 = 0),
c AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
s AS (SELECT query_id, vec_id, q_label, label, round(list_cosine_similarity(qv, v), 6) AS score FROM q JOIN c ON query_id <> vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rnk FROM s)
"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose id is divisible by 50 against all other rows, as cosine rounded to six places.

    The queries are a stated set of a fiftieth of the rows; the vectors stay where they are read.
    """
    e = table(spark, d, "embeddings").select("vec_id", as_double(F.col("embedding")).alias("v"), "label")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), F.col("label").alias("q_label"))
    return q.join(e, F.col("query_id") != F.col("vec_id")).select("query_id", "vec_id", "q_label", "label", F.round(cosine(F.col("qv"), F.col("v")), 6).alias("score"))


def ranked(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scored(spark, d).withColumn("rnk", F.row_number().over(w))


@query(_SCORED + """SELECT query_id, min(rnk) FILTER (WHERE label = q_label)::BIGINT AS first_hit_rank,
  (coalesce(min(rnk) FILTER (WHERE label = q_label), 0) = 1)::INT AS hit_1, coalesce(min(rnk) FILTER (WHERE label = q_label) <= 5, false)::INT AS hit_5,
  round(coalesce(1.0 / min(rnk) FILTER (WHERE label = q_label), 0), 6)::DOUBLE AS rr FROM r GROUP BY query_id""")
def retrieval_rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    out = first_hits(spark, d).select("query_id", F.col("k").cast("long").alias("first_hit_rank"))
    hit = lambda k: F.coalesce(F.col("first_hit_rank") <= k, F.lit(False)).cast("int")
    return out.select("query_id", "first_hit_rank", hit(1).alias("hit_1"), hit(5).alias("hit_5"), F.round(F.coalesce(1.0 / F.col("first_hit_rank"), F.lit(0.0)), 6).alias("rr"))


@query(_SCORED + "SELECT query_id, vec_id, rnk::INT AS rnk, score FROM r WHERE rnk <= 10")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d).filter("rnk <= 10").select("query_id", "vec_id", "rnk", "score")


def hard_negatives(ranks: DataFrame, low: int = 10, high: int = 30, wide: tuple[int, int] = (6, 40), take: int = 4) -> DataFrame:
    """Negatives of other labels: up to ``take`` of the ranks low..high in md5 order if there are 3 or more, else the first of the wider ranks."""
    from quillmill.functions.text import unit_hash

    cand = ranks.filter((F.col("label") != F.col("q_label")) & F.col("rnk").between(*wide)).withColumn("inner", F.col("rnk").between(low, high))
    per = Window.partitionBy("query_id")
    cand = cand.withColumn("n_inner", F.sum(F.col("inner").cast("int")).over(per))
    use_inner = F.col("n_inner") >= 3
    key = F.when(use_inner, unit_hash(F.lit("42"), F.col("query_id").cast("string"), F.col("vec_id").cast("string"))).otherwise(F.col("rnk").cast("double"))
    cand = cand.filter(F.when(use_inner, F.col("inner")).otherwise(F.lit(True)))
    return cand.withColumn("pick", F.row_number().over(per.orderBy(key, "vec_id"))).filter(F.col("pick") <= take)


SQL_UNIT = "(('0x' || substr(md5({0}), 1, 8))::BIGINT / 4294967296.0)"


@query(_SCORED + f""", c6 AS (SELECT *, rnk BETWEEN 10 AND 30 AS inn FROM r WHERE label <> q_label AND rnk BETWEEN 6 AND 40),
n AS (SELECT *, sum(inn::INT) OVER (PARTITION BY query_id) AS k FROM c6),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN k >= 3 THEN {SQL_UNIT.format("'42|' || query_id || '|' || vec_id")} ELSE rnk::DOUBLE END, vec_id) AS pick FROM n WHERE k < 3 OR inn)
SELECT query_id, vec_id, rnk::INT AS rnk, pick::INT AS pick, score FROM p WHERE pick <= 4""")
def hard_negative_mining(spark: SparkSession, d: str) -> DataFrame:
    return hard_negatives(ranked(spark, d)).select("query_id", "vec_id", "rnk", "pick", "score")


_FIRST = _SCORED + ", f AS (SELECT query_id, min(rnk) FILTER (WHERE label = q_label) AS k FROM r GROUP BY query_id)"


def first_hits(spark: SparkSession, d: str) -> DataFrame:
    """Columns ``query_id, k``: rank of the first vector of the query's label, null if there is none.

    The best such vector is a minimum and its rank the number of better ones, two aggregates that are combined where the vectors
    are read; no query's rows are gathered or sorted.
    """
    s = scored(spark, d).withColumn("at", F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v")))
    best = s.groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("q_label"), F.col("at"))).alias("best"))
    ahead = s.join(F.broadcast(best), "query_id").groupBy("query_id").agg(F.count_if(F.col("at") < F.col("best")).alias("n"), F.max(F.col("best").isNotNull()).alias("hit"))
    return ahead.select("query_id", F.when(F.col("hit"), F.col("n") + 1).alias("k"))


@query(_FIRST + """, b AS (SELECT CASE WHEN k = 1 THEN '1' WHEN k <= 5 THEN '2-5' WHEN k <= 10 THEN '6-10' WHEN k <= 30 THEN '11-30' WHEN k > 30 THEN '>30' ELSE 'none' END AS bucket FROM f)
SELECT bucket, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS pct FROM b GROUP BY bucket""")
def rank_histogram(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    bucket = F.when(k == 1, "1").when(k <= 5, "2-5").when(k <= 10, "6-10").when(k <= 30, "11-30").when(k > 30, ">30").otherwise("none")
    n = first_hits(spark, d).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


@query(_FIRST + f"SELECT query_id, k::INT AS k FROM f WHERE k IS DISTINCT FROM 1 OR {SQL_UNIT.format('query_id::VARCHAR')} < 0.35")
def rank1_retention_35pct(spark: SparkSession, d: str) -> DataFrame:
    """Of the queries whose first result hits, a hash keeps 35 %; all others stay."""
    from quillmill.functions.text import unit_hash

    return first_hits(spark, d).filter(~F.col("k").eqNullSafe(F.lit(1)) | (unit_hash(F.col("query_id").cast("string")) < 0.35)).select("query_id", "k")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM e)
SELECT vec_id, round(n, 6) AS norm, round(sqrt(list_sum(list_transform(v, lambda x: (x / greatest(n, 1e-12)) * (x / greatest(n, 1e-12))))), 6) AS unit_norm, (len(v) = 64) AS right_size FROM n""")
def l2_normalize_check(spark: SparkSession, d: str) -> DataFrame:
    v = as_double(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(norm(v), 6).alias("norm"), F.round(norm(l2_unit(v)), 6).alias("unit_norm"), (F.size(v) == 64).alias("right_size"))


@query("""SELECT DISTINCT __id__ AS id, len(vector)::INT AS dims, vector IS NULL AS missing, coalesce(round(list_sum(list_transform(list_filter(vector[1:48], lambda x: isfinite(x)), lambda x: x::DOUBLE)), 4), 0.0)::DOUBLE AS sum_48 FROM vdb_chunks""")
def vector_pad_truncate(spark: SparkSession, d: str) -> DataFrame:
    """Vectors brought to 48 dimensions, a missing one to zeros; checked by their finite sum."""
    fitted = fit_dims(as_double(F.col("vector")), 48)
    finite = F.filter(fitted, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    total = F.round(F.aggregate(finite, F.lit(0.0), lambda s, x: s + x), 4)
    return table(spark, d, "vdb_chunks").select(F.col("__id__").alias("id"), F.when(F.col("vector").isNotNull(), F.size("vector")).alias("dims"), F.col("vector").isNull().alias("missing"), total.alias("sum_48")).distinct()


_TRIPLES = """t AS (SELECT vec_id // 12 AS batch, vec_id // 3 AS item, max(CASE WHEN vec_id % 3 = 0 THEN embedding END)::DOUBLE[] AS q, max(CASE WHEN vec_id % 3 = 1 THEN embedding END)::DOUBLE[] AS p, max(CASE WHEN vec_id % 3 = 2 THEN embedding END)::DOUBLE[] AS n FROM embeddings GROUP BY 1, 2 HAVING count(*) = 3)"""


def triples(spark: SparkSession, d: str) -> DataFrame:
    """Query, positive and hard negative of a batch's items: three vectors in a row, four items a batch."""
    e = table(spark, d, "embeddings").select("vec_id", as_double(F.col("embedding")).alias("v"))
    side = lambda i, n: F.max(F.when(F.col("vec_id") % 3 == i, F.col("v"))).alias(n)
    return e.groupBy(F.expr("vec_id div 12").alias("batch"), F.expr("vec_id div 3").alias("item")).agg(side(0, "q"), side(1, "p"), side(2, "n"), F.count("*").alias("k")).filter("k = 3").drop("k")


@query(f"""WITH {_TRIPLES}, s AS (SELECT a.batch, a.item, b.item AS other, list_cosine_similarity(a.q, b.p) / 0.05 AS logit FROM t a JOIN t b ON a.batch = b.batch UNION ALL SELECT batch, item, NULL, list_cosine_similarity(q, n) / 0.05 FROM t),
m AS (SELECT batch, item, max(CASE WHEN other = item THEN logit END) AS pos, ln(sum(exp(logit))) AS lse FROM s GROUP BY batch, item)
SELECT batch, round(avg(lse - pos), 6) AS loss FROM m GROUP BY batch""")
def infonce_loss(spark: SparkSession, d: str) -> DataFrame:
    """Contrastive loss: the positives of a batch and an item's own hard negative against its positive, temperature 0.05."""
    t = triples(spark, d)
    others = t.select("batch", F.col("item").alias("other"), "p")
    inside = t.select("batch", "item", "q").join(others, "batch").select("batch", "item", "other", (cosine(F.col("q"), F.col("p")) / 0.05).alias("logit"))  # a batch has four items
    hard = t.select("batch", "item", F.lit(None).cast("long").alias("other"), (cosine(F.col("q"), F.col("n")) / 0.05).alias("logit"))
    m = inside.unionByName(hard).groupBy("batch", "item").agg(F.max(F.when(F.col("other") == F.col("item"), F.col("logit"))).alias("pos"), F.log(F.sum(F.exp("logit"))).alias("lse"))
    return m.groupBy("batch").agg(F.round(F.avg(F.col("lse") - F.col("pos")), 6).alias("loss"))


@query(f"WITH {_TRIPLES} SELECT item, round(list_cosine_similarity(q, p), 6) AS positive, round(list_cosine_similarity(q, n), 6) AS negative, round(list_cosine_similarity(q, p) - list_cosine_similarity(q, n), 6) AS margin FROM t")
def cosine_margin(spark: SparkSession, d: str) -> DataFrame:
    """How much nearer a query is to its positive than to its hard negative."""
    p, n = cosine(F.col("q"), F.col("p")), cosine(F.col("q"), F.col("n"))
    return triples(spark, d).select("item", F.round(p, 6).alias("positive"), F.round(n, 6).alias("negative"), F.round(p - n, 6).alias("margin"))


@query(_FIRST + """SELECT q_label AS label, count(*) AS queries, round(avg((k <= 1)::INT), 4) AS hit_1, round(avg((k <= 3)::INT), 4) AS hit_3, round(avg((k <= 5)::INT), 4) AS hit_5, round(avg((k <= 10)::INT), 4) AS hit_10, round(avg(coalesce(1.0 / k, 0)), 4)::DOUBLE AS mrr
FROM f JOIN (SELECT DISTINCT query_id, q_label FROM q) USING (query_id) GROUP BY GROUPING SETS ((q_label), ())""")
def full_report(spark: SparkSession, d: str) -> DataFrame:
    """Hit rates and mean reciprocal rank by label and overall."""
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    k = F.coalesce(F.col("k"), F.lit(1 << 30))
    rate = lambda n: F.round(F.avg((k <= n).cast("int")), 4).alias(f"hit_{n}")
    mrr = F.round(F.avg(F.coalesce(1.0 / F.col("k"), F.lit(0.0))), 4).alias("mrr")
    return first_hits(spark, d).join(labels, "query_id").rollup("label").agg(F.count("*").alias("queries"), rate(1), rate(3), rate(5), rate(10), mrr)
