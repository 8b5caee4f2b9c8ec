"""Vector operators over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import vector as V
from corvane.operators import neighbour_index as N
from corvane.operators import vectors as O
from corvane.operators.studies import _cut
from corvane.registry import query, table

DOT = "list_sum(list_transform(range(1, 65), lambda k: CAST(a.embedding[k] AS DOUBLE) * CAST(b.embedding[k] AS DOUBLE)))"


@query("SELECT vec_id, label, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS norm, len(embedding) AS dims FROM embeddings")
def mth1_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.round(V.norm("embedding"), 4).alias("norm"), F.size("embedding").cast("long").alias("dims"))


_CENTRES = """u AS (SELECT label, UNNEST(embedding) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), m AS (SELECT label, k, avg(CAST(x AS DOUBLE)) AS x FROM u GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS len FROM m GROUP BY 1)"""


@query("WITH " + _CENTRES + " SELECT label, k - 1 AS at, round(x / len, 4) AS x FROM m JOIN n USING (label)")
def agg23_centroids(spark, sf_dir):
    c = O.centroids(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("at", "x")).select("label", F.col("at").cast("long").alias("at"), F.round("x", 4).alias("x"))


_KNN = f"""p AS (SELECT a.vec_id AS target, b.vec_id AS neighbour, {DOT} AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY s DESC, neighbour) AS rank FROM p)"""


@query(f"WITH {_KNN} SELECT target, neighbour, round(s, 5) AS similarity, rank FROM r WHERE rank <= 5")
def jn13_nearest_neighbours(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return N.neighbours(e, e, "vec_id", "embedding", 5).withColumn("similarity", F.round("similarity", 5))


@query(f"SELECT b.vec_id, round({DOT}, 5) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id = 7 AND b.vec_id <> 7 ORDER BY {DOT} DESC, b.vec_id LIMIT 10")
def jn14_single_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    one = e.where("vec_id = 7").select(F.col("embedding").alias("q")).limit(1)
    rows = e.where("vec_id <> 7").crossJoin(F.broadcast(one)).select("vec_id", V.dot("embedding", "q").alias("s"))
    return rows.orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", F.round("s", 5).alias("similarity"))


@query("WITH " + _CENTRES + """, c AS (SELECT label AS code, list(x / len ORDER BY k) AS embedding FROM m JOIN n USING (label) GROUP BY 1), p AS (SELECT a.vec_id, b.code, """ + DOT + """ AS s FROM embeddings a, c b), r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY s DESC, vec_id) AS rank FROM p WHERE s > 0)
SELECT vec_id, code, round(s, 4) AS similarity FROM r WHERE rank <= 3""")
def jn15_centroid_candidates(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return O.nearest_centroids(e, O.centroids(e, "label", "embedding"), "vec_id", "embedding", "label", 3).select("vec_id", "code", F.round("similarity", 4).alias("similarity"))


@query(f"""WITH {_KNN}, k AS (SELECT target, neighbour, s FROM r WHERE rank <= 9), l AS (SELECT vec_id, label, 0.95 AS c FROM embeddings WHERE vec_id % 3 <> 0),
v AS (SELECT target, label, count(*) AS votes, max(s) AS s, arg_max(c, s) AS c FROM k JOIN l ON l.vec_id = neighbour WHERE target % 3 = 0 GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY votes DESC, s DESC, label) AS n FROM v)
SELECT target AS vec_id, label, round(c * s, 4) AS confidence, votes FROM b WHERE n = 1 AND c * s >= 0.3""")
def agg25_label_vote(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    near = N.neighbours(e.where("vec_id % 3 = 0"), e, "vec_id", "embedding", 9)
    known = e.where("vec_id % 3 <> 0").select("vec_id", "label", F.lit(0.95).alias("confidence"))
    return O.propagate(near, known, "vec_id", "label", "confidence", 0.3).withColumn("confidence", F.round("confidence", 4))


_HOP = "SELECT target, label, c * s AS c, votes FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY votes DESC, s DESC, label) AS n FROM (SELECT k.target, l.label, count(*) AS votes, max(s) AS s, arg_max(c, s) AS c FROM k JOIN {known} l ON l.target = k.neighbour WHERE k.target % 10 <> 0 {only} GROUP BY ALL)) WHERE n = 1 AND c * s >= {least}"


@query(f"""WITH {_KNN}, k AS (SELECT target, neighbour, s FROM r WHERE rank <= 9 AND s >= 0.3), l AS (SELECT vec_id AS target, label, CAST(0.95 AS DOUBLE) AS c FROM embeddings WHERE vec_id % 10 = 0),
one AS ({_HOP.format(known="l", only="", least=0.25)}), two AS ({_HOP.format(known="one", only="AND k.target NOT IN (SELECT target FROM one)", least=0.1)})
SELECT target AS vec_id, label, round(c, 4) AS confidence, votes, 1 AS hop FROM one UNION ALL SELECT target, label, round(c, 4), votes, 2 FROM two""")
def gr4_two_hop_propagation(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    # read four times, so not searched for anew
    near = _cut(N.neighbours(e, e, "vec_id", "embedding", 9).where("similarity >= 0.3"))
    known = e.where("vec_id % 10 = 0").select("vec_id", "label", F.lit(0.95).alias("confidence"))
    unknown = e.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("target"))
    one = O.propagate(near.join(unknown, "target", "left_semi"), known, "vec_id", "label", "confidence", 0.25)
    two = O.propagate(near.join(unknown, "target", "left_semi").join(one.select(F.col("vec_id").alias("target")), "target", "left_anti"), one, "vec_id", "label", "confidence", 0.1)
    return one.withColumn("hop", F.lit(1)).unionByName(two.withColumn("hop", F.lit(2))).withColumn("confidence", F.round("confidence", 4))


@query(f"""WITH p AS (SELECT a.label = b.label AS same, {DOT} AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) SELECT same, count(*) AS pairs, round(avg(s), 4) AS mean FROM p GROUP BY 1""")
def agg38_label_similarity(spark, sf_dir):
    return O.label_similarity(table(spark, sf_dir, "embeddings"), "label", "embedding").select("same", "pairs", F.round("mean", 4).alias("mean"))


@query("""WITH s AS (SELECT l_orderkey AS id, l_partkey AS part, l_suppkey AS supp, l_linenumber AS line, l_discount * 10 AS e, l_tax * 10 AS k, CASE WHEN l_returnflag = 'R' THEN -1.0 ELSE l_quantity / 50 END AS j FROM lineitem),
c AS (SELECT *, round(least(1.0, greatest(0.0, CASE WHEN j < 0 THEN 0.65 * e + 0.35 * k ELSE 0.45 * e + 0.15 * k + 0.40 * j END)), 4) AS score FROM s) SELECT id, part, supp, line, score, CASE WHEN score >= 0.75 THEN 'HIGH' WHEN score >= 0.5 THEN 'REVIEW' ELSE 'LOW' END AS tier FROM c""")
def mth3_mth4_composite_and_tier(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem")
    judge = F.when(F.col("l_returnflag") == "R", -1.0).otherwise(F.col("l_quantity") / 50)
    rows = item.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_linenumber").alias("line"), V.composite(F.col("l_discount") * 10, F.col("l_tax") * 10, judge).alias("score"))
    return rows.withColumn("tier", V.tier(F.col("score")))


@query("WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256(CAST(vec_id AS VARCHAR)), vec_id) AS k FROM embeddings) SELECT vec_id, label, CASE WHEN k <= 24 THEN 'train' ELSE 'validation' END AS split FROM r WHERE k <= 30")
def gr9_class_balance(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy(F.sha2(F.col("vec_id").cast("string"), 256), "vec_id")
    rows = table(spark, sf_dir, "embeddings").withColumn("k", F.row_number().over(w)).where("k <= 30")
    return rows.select("vec_id", "label", F.when(F.col("k") <= 24, "train").otherwise("validation").alias("split"))


@query("""WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256(CAST(vec_id AS VARCHAR)), vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings), m AS (SELECT *, greatest(1, CAST(floor(n * 0.1 + 0.5) AS BIGINT)) AS v FROM r)
SELECT vec_id, label, CASE WHEN n < 3 THEN 'train' WHEN k <= v THEN 'validation' WHEN k <= 2 * v THEN 'test' ELSE 'train' END AS split FROM m""")
def gr10_stratified_split(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("label")
    v = F.greatest(F.lit(1), F.floor(F.col("n") * 0.1 + 0.5).cast("long"))
    rows = table(spark, sf_dir, "embeddings").withColumn("k", F.row_number().over(w.orderBy(F.sha2(F.col("vec_id").cast("string"), 256), "vec_id"))).withColumn("n", F.count("*").over(w))
    return rows.select("vec_id", "label", F.when(F.col("n") < 3, "train").when(F.col("k") <= v, "validation").when(F.col("k") <= 2 * v, "test").otherwise("train").alias("split"))


@query("WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings) SELECT vec_id, label FROM r WHERE k <= 3")
def gr13_first_exemplars(spark, sf_dir):
    from corvane.operators.windows import numbered

    return numbered(table(spark, sf_dir, "embeddings").select("vec_id", "label"), ["label"], ["vec_id"], "k").where("k <= 3").select("vec_id", "label")
