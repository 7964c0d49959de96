"""Queries of the mining operators over the star-schema and claims tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minespark.operators import assoc, bayes, clustering, evaluate, neighbours, pagerank, prep, recommend, svm, text, tree
from minespark.plans.claims import STATUS, _SNAP, _key, clean_claims, snapshot_rows
from minespark.scratch import materialize
from minespark.tables import load, load_spread

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# -- association rules -------------------------------------------------------

MIN_SUPPORT, MIN_CONFIDENCE = 0.02, 0.15


def brand_baskets(spark, d) -> DataFrame:
    """Distinct brands of each order."""
    j = load(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(load(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    return assoc.baskets_from_pairs(j, "l_orderkey", "p_brand")


_B = """b AS (SELECT DISTINCT l_orderkey AS t, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT count(DISTINCT t) AS n FROM b),
s1 AS (SELECT i, count(*) AS c FROM b GROUP BY 1 HAVING count(*) > 0.02 * (SELECT n FROM n)), f AS (SELECT b.* FROM b JOIN s1 USING (i)),
s2 AS (SELECT a.i AS x, b.i AS y, count(*) AS c FROM f a JOIN f b ON a.t = b.t AND a.i < b.i GROUP BY 1, 2 HAVING count(*) >= 0.02 * (SELECT n FROM n)),
s3 AS (SELECT a.i AS x, b.i AS y, c.i AS z, count(*) AS c FROM f a JOIN f b ON a.t = b.t AND a.i < b.i JOIN f c ON a.t = c.t AND b.i < c.i GROUP BY 1, 2, 3 HAVING count(*) >= 0.02 * (SELECT n FROM n)),
sets AS (SELECT [i] AS items, c FROM s1 UNION ALL SELECT [x, y], c FROM s2 UNION ALL SELECT [x, y, z], c FROM s3)"""


@query(f"WITH {_B} SELECT i AS item, c AS n, round(c / n, 8) AS support FROM s1, n")
def item_support(spark, d) -> DataFrame:
    sets, total = assoc.frequent_itemsets(brand_baskets(spark, d), MIN_SUPPORT, max_len=1)
    return sets.select(F.element_at("items", 1).alias("item"), "n", F.round(F.col("n") / F.lit(total), 8).alias("support"))


@query(f"WITH {_B} SELECT array_to_string(items, ',') AS items, c AS n FROM sets")
def frequent_itemsets(spark, d) -> DataFrame:
    sets, _ = assoc.frequent_itemsets(brand_baskets(spark, d), MIN_SUPPORT)
    return sets.select(F.array_join("items", ",").alias("items"), "n")


@query(f"WITH {_B} SELECT array_to_string(items, ',') AS items, c AS n FROM sets a WHERE NOT EXISTS (SELECT 1 FROM sets b WHERE len(b.items) = len(a.items) + 1 AND list_has_all(b.items, a.items))")
def maximal_itemsets(spark, d) -> DataFrame:
    sets, _ = assoc.frequent_itemsets(brand_baskets(spark, d), MIN_SUPPORT)
    return assoc.maximal_itemsets(sets).select(F.array_join("items", ",").alias("items"), "n")


@query(f"""WITH {_B}, r AS (SELECT list_filter(items, lambda v: v <> u.y) AS lhs, u.y AS rhs, c FROM sets, unnest(items) AS u(y) WHERE len(items) > 1)
SELECT array_to_string(lhs, ',') AS antecedent, rhs AS consequent, round(r.c / n, 8) AS support, round(r.c / s.c, 8) AS confidence FROM r JOIN sets s ON s.items = lhs, n WHERE r.c / s.c >= 0.15""")
def association_rules(spark, d) -> DataFrame:
    sets, total = assoc.frequent_itemsets(brand_baskets(spark, d), MIN_SUPPORT)
    r = assoc.rules(sets, total, MIN_CONFIDENCE)
    return r.select(F.array_join("antecedent", ",").alias("antecedent"), "consequent", F.round("support", 8).alias("support"), F.round("confidence", 8).alias("confidence"))


# -- trees, Bayes, linear classifier -----------------------------------------


def patients(spark, d) -> DataFrame:
    """One complete row per vec_id: features and class."""
    cols = ["est_age_in_days", "clm_pmt_amt", "claim_count", "bene_race_cd", "bene_sex_ident_cd", "sp_chf", "sp_copd", "sp_cncr", "cc_group"]
    t = load(spark, d, "bene_knn").select("vec_id", *cols).dropna().filter("cc_group <> '?'")
    one = t.groupBy("vec_id").agg(F.min(F.struct(*cols)).alias("x")).select("vec_id", "x.*")
    for c in ("bene_sex_ident_cd", "sp_chf", "sp_copd", "sp_cncr"):
        one = one.withColumn(c, F.col(c).cast("string"))
    return one


CATS = ["bene_race_cd", "bene_sex_ident_cd", "sp_chf", "sp_copd", "sp_cncr"]
NUMS = ["est_age_in_days", "clm_pmt_amt", "claim_count"]

_P = """p AS (SELECT DISTINCT ON (vec_id) vec_id, est_age_in_days, clm_pmt_amt, claim_count, bene_race_cd, bene_sex_ident_cd, sp_chf, sp_copd, sp_cncr, cc_group FROM bene_knn
 WHERE clm_pmt_amt IS NOT NULL AND bene_race_cd IS NOT NULL AND sp_chf IS NOT NULL AND cc_group IS NOT NULL AND cc_group <> '?' ORDER BY ALL)"""
_LONG = f"""{_P}, x AS (SELECT vec_id, cc_group AS y, 'bene_race_cd' AS attr, CAST(bene_race_cd AS VARCHAR) AS v FROM p UNION ALL SELECT vec_id, cc_group, 'bene_sex_ident_cd', CAST(bene_sex_ident_cd AS VARCHAR) FROM p
 UNION ALL SELECT vec_id, cc_group, 'sp_chf', CAST(sp_chf AS VARCHAR) FROM p UNION ALL SELECT vec_id, cc_group, 'sp_copd', CAST(sp_copd AS VARCHAR) FROM p UNION ALL SELECT vec_id, cc_group, 'sp_cncr', CAST(sp_cncr AS VARCHAR) FROM p)"""
_H = """h AS (SELECT -sum(q * log2(q)) AS h FROM (SELECT count(*) / sum(count(*)) OVER () AS q FROM p GROUP BY cc_group))"""


def _gains(spark, d, attrs) -> DataFrame:
    p = patients(spark, d).withColumn("_rid", F.col("vec_id"))
    return tree.gains(materialize(tree.value_counts(p.withColumn("g", F.lit(0)), ["g"], attrs, "cc_group")), ["g"])


@query(f"""WITH {_LONG}, {_H}, c AS (SELECT attr, v, y, count(*) AS n FROM x GROUP BY 1, 2, 3), cv AS (SELECT attr, v, n, sum(n) OVER (PARTITION BY attr, v) AS vn, sum(n) OVER (PARTITION BY attr) AS t FROM c),
e AS (SELECT attr, -sum(n * log2(n / vn)) / any_value(t) AS e FROM cv GROUP BY 1), o AS (SELECT attr, -sum(vn / t * log2(vn / t)) AS o FROM (SELECT DISTINCT attr, v, vn, t FROM cv) GROUP BY 1)
SELECT attr, round(h - e, 8) AS gain, round((h - e) / o, 7) AS ratio FROM e JOIN o USING (attr), h""")
def information_gain(spark, d) -> DataFrame:
    return _gains(spark, d, CATS).select("attr", F.round("gain", 8).alias("gain"), F.round("ratio", 7).alias("ratio"))


@query(f"""WITH {_P}, {_H}, v AS (SELECT DISTINCT claim_count AS a FROM p), c AS (SELECT a, cc_group AS y, claim_count <= a AS le, count(*) AS n FROM p, v GROUP BY 1, 2, 3),
s AS (SELECT a, -sum(n * log2(n / m)) / any_value(t) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY a, le) AS m, sum(n) OVER (PARTITION BY a) AS t FROM c) GROUP BY 1)
SELECT CAST(a AS DOUBLE) AS alpha, round(h - e, 8) AS gain FROM s, h""")
def numeric_split_gains(spark, d) -> DataFrame:
    return _gains(spark, d, ["claim_count"]).select("alpha", F.round("gain", 8).alias("gain"))


@query(f"""WITH {_LONG}, {_H}, c AS (SELECT attr, v, y, count(*) AS n FROM x GROUP BY 1, 2, 3), cv AS (SELECT *, sum(n) OVER (PARTITION BY attr, v) AS vn, sum(n) OVER (PARTITION BY attr) AS t FROM c),
e AS (SELECT attr, round(any_value(h) + sum(n * log2(n / vn)) / any_value(t), 12) AS g FROM cv, h GROUP BY 1),
w AS (SELECT attr FROM e ORDER BY g DESC, list_position(['bene_race_cd', 'bene_sex_ident_cd', 'sp_chf', 'sp_copd', 'sp_cncr'], attr) LIMIT 1),
m AS (SELECT v, y FROM (SELECT v, y, row_number() OVER (PARTITION BY v ORDER BY n DESC, y) AS r FROM c JOIN w USING (attr)) WHERE r = 1)
SELECT x.vec_id, m.y AS pred FROM x JOIN w USING (attr) JOIN m USING (v)""")
def c45_stump(spark, d) -> DataFrame:
    p = patients(spark, d)
    return tree.c45(p, CATS, "cc_group", rid="vec_id", max_depth=1).transform(p).select("vec_id", "pred")


@query(f"""WITH {_LONG}, pr AS (SELECT cc_group AS y, count(*) / sum(count(*)) OVER () AS p, count(*) AS n FROM p GROUP BY 1), cd AS (SELECT attr, v, y, count(*) / any_value(n) AS q FROM x JOIN pr USING (y) GROUP BY 1, 2, 3),
a AS (SELECT vec_id, attr, v FROM x), s AS (SELECT a.vec_id, pr.y, any_value(pr.p) * product(coalesce(cd.q, 0)) AS s FROM a CROSS JOIN pr LEFT JOIN cd ON cd.attr = a.attr AND cd.v = a.v AND cd.y = pr.y GROUP BY 1, 2)
SELECT vec_id, y AS pred FROM (SELECT vec_id, y, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 14) DESC, y) AS r FROM s) WHERE r = 1""")
def naive_bayes(spark, d) -> DataFrame:
    p = patients(spark, d)
    return bayes.predict(p, bayes.fit(p, CATS, "cc_group")).select("vec_id", "pred")


_SVM = "WITH z AS (SELECT (c_acctbal - 4500) / 3000 AS x, (c_nationkey - 12) / 7.0 AS y, CASE WHEN c_acctbal + 200 * c_nationkey > 7000 THEN 1.0 ELSE -1.0 END AS l FROM customer), w0 AS (SELECT -1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c)" + "".join(
    f", w{i + 1} AS (SELECT any_value(a) - 0.0001 * (any_value(a) + 2 * sum(CASE WHEN l * (a * x + b * y - c) <= 1 THEN -l * x ELSE 0 END)) AS a, any_value(b) - 0.0001 * (any_value(b) + 2 * sum(CASE WHEN l * (a * x + b * y - c) <= 1 THEN -l * y ELSE 0 END)) AS b, any_value(c) - 0.0001 * (any_value(c) + 2 * sum(CASE WHEN l * (a * x + b * y - c) <= 1 THEN l ELSE 0 END)) AS c FROM z, w{i})"
    for i in range(10)
)


@query(_SVM + " SELECT round(a, 6) AS w0, round(b, 6) AS w1, round(c, 6) AS bias FROM w10")
def linear_svm(spark, d) -> DataFrame:
    c = load(spark, d, "customer")
    z = c.select(((F.col("c_acctbal") - 4500) / 3000).alias("x"), ((F.col("c_nationkey") - 12) / 7.0).alias("y"), F.when(F.col("c_acctbal") + 200 * F.col("c_nationkey") > 7000, 1.0).otherwise(-1.0).alias("l"))
    w = svm.fit(z, ["x", "y"], "l", rate=0.0001, iterations=10)
    return spark.createDataFrame([tuple(round(x, 6) for x in w)], "w0 double, w1 double, bias double")


# -- nearest neighbours ------------------------------------------------------


def _near(spark, d, k: int) -> tuple[DataFrame, DataFrame]:
    e = load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    e = materialize(e.groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("x")).select("vec_id", "x.*"))
    return neighbours.nearest(e.filter("vec_id % 20 = 0"), e, "vec_id", "v", k, payload="label"), e


_NN = """e AS (SELECT vec_id, embedding::DOUBLE[64] AS v, CAST(label AS VARCHAR) AS label FROM embeddings), d AS (SELECT a.vec_id AS q, b.vec_id AS n, b.label, array_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(d, 12), n) AS rank FROM d)"""


@query(f"WITH {_NN} SELECT q AS query, n AS neighbour, round(d, 6) AS dist, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def knn_vectors(spark, d) -> DataFrame:
    near, _ = _near(spark, d, 5)
    return near.select("query", "neighbour", F.round("dist", 6).alias("dist"), "rank")


@query(f"WITH {_NN}, c AS (SELECT q, label, count(*) AS n FROM r WHERE rank <= 5 GROUP BY 1, 2) SELECT q AS query, label AS pred FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, label) AS o FROM c) WHERE o = 1")
def knn_classify(spark, d) -> DataFrame:
    near, _ = _near(spark, d, 5)
    return neighbours.classify(near, 5)


@query(f"""WITH {_NN}, k AS (SELECT unnest(range(1, 11)) AS k), c AS (SELECT k, q, label, count(*) AS n FROM r JOIN k ON rank <= k GROUP BY 1, 2, 3), p AS (SELECT k, q, label, row_number() OVER (PARTITION BY k, q ORDER BY n DESC, label) AS o FROM c)
SELECT CAST(k AS INTEGER) AS k, round(avg(CAST(p.label = e.label AS DOUBLE)), 8) AS accuracy FROM p JOIN e ON q = vec_id WHERE o = 1 GROUP BY 1""")
def knn_best_k(spark, d) -> DataFrame:
    near, e = _near(spark, d, 10)
    return neighbours.best_k(near, e, "vec_id", "label", range(1, 11)).select("k", F.round("accuracy", 8).alias("accuracy"))


# -- clustering --------------------------------------------------------------


def _customer_points(spark, d) -> DataFrame:
    return clustering.points(load(spark, d, "customer"), "c_custkey", ["c_acctbal", "c_nationkey"])


_KM = """WITH m AS (SELECT avg(c_acctbal) AS a, stddev_samp(c_acctbal) AS s, avg(c_nationkey) AS b, stddev_samp(c_nationkey) AS t FROM customer), z AS (SELECT c_custkey AS id, (c_acctbal - a) / s AS x, (c_nationkey - b) / t AS y FROM customer, m),
c0 AS (SELECT 0 AS c, -1.0::DOUBLE AS x, -1.0::DOUBLE AS y UNION ALL SELECT 1, 1.0, -1.0 UNION ALL SELECT 2, 0.0, 1.0)""" + "".join(
    f", a{i} AS (SELECT z.id, z.x, z.y, min_by(c.c, [round(sqrt((z.x - c.x)**2 + (z.y - c.y)**2), 12), c.c]) AS c FROM z, c{i} c GROUP BY 1, 2, 3), c{i + 1} AS (SELECT c, avg(x) AS x, avg(y) AS y FROM a{i} GROUP BY 1)" for i in range(3)
)


@query(_KM + " SELECT CAST(c AS INTEGER) AS cluster, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM a2 GROUP BY 1")
def kmeans_three_rounds(spark, d) -> DataFrame:
    m = clustering.kmeans(_customer_points(spark, d), 3, start=[[-1.0, -1.0], [1.0, -1.0], [0.0, 1.0]], max_iterations=3)
    return m.assigned.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg(F.col("v")[0]), 6).alias("x"), F.round(F.avg(F.col("v")[1]), 6).alias("y"))


@query(f"""WITH RECURSIVE m AS (SELECT avg(s_acctbal) AS a, stddev_samp(s_acctbal) AS s, avg(s_nationkey) AS b, stddev_samp(s_nationkey) AS t FROM supplier), z AS (SELECT s_suppkey AS id, (s_acctbal - a) / s AS x, (s_nationkey - b) / t AS y FROM supplier, m),
e AS (SELECT p.id AS u, q.id AS v FROM z p JOIN z q ON p.id <> q.id WHERE sqrt((p.x - q.x)**2 + (p.y - q.y)**2) <= 0.3 AND sqrt((p.x - q.x)**2 + (p.y - q.y)**2) > 0), core AS (SELECT u FROM e GROUP BY 1 HAVING count(*) >= 4),
l AS (SELECT u, v FROM e WHERE u IN (SELECT u FROM core) AND v IN (SELECT u FROM core)), c(u, r) AS (SELECT u, u FROM core UNION SELECT l.v, c.r FROM c JOIN l ON c.u = l.u WHERE c.r < l.v), k AS (SELECT u, min(r) AS r FROM c GROUP BY 1),
n AS (SELECT r, row_number() OVER (ORDER BY r) - 1 AS c FROM (SELECT DISTINCT r FROM k)), kc AS (SELECT u, c FROM k JOIN n USING (r)), b AS (SELECT e.u, min(c) AS c FROM e JOIN kc ON e.v = kc.u WHERE e.u NOT IN (SELECT u FROM core) GROUP BY 1)
SELECT z.id AS rid, CAST(coalesce(kc.c, b.c, -1) AS INTEGER) AS cluster, CASE WHEN kc.c IS NOT NULL THEN 'core' WHEN b.c IS NOT NULL THEN 'border' ELSE 'noise' END AS kind FROM z LEFT JOIN kc ON kc.u = z.id LEFT JOIN b ON b.u = z.id""")
def dbscan_clusters(spark, d) -> DataFrame:
    p = clustering.points(load(spark, d, "supplier"), "s_suppkey", ["s_acctbal", "s_nationkey"])
    return clustering.dbscan(p, 0.3, 4)


@query(_KM + " SELECT CAST(a.c AS INTEGER) AS cluster, round(max(sqrt((a.x - c.x)**2 + (a.y - c.y)**2)), 6) AS radius FROM a2 a JOIN c2 c ON a.c = c.c GROUP BY 1")
def cluster_radius(spark, d) -> DataFrame:
    m = clustering.kmeans(_customer_points(spark, d), 3, start=[[-1.0, -1.0], [1.0, -1.0], [0.0, 1.0]], max_iterations=3)
    return clustering.radius(m.assigned).select("cluster", F.round("radius", 6).alias("radius"))


@query("""WITH m AS (SELECT avg(s_acctbal) AS a, stddev_samp(s_acctbal) AS s, avg(s_nationkey) AS b, stddev_samp(s_nationkey) AS t FROM supplier), z AS (SELECT s_suppkey AS id, (s_acctbal - a) / s AS x, (s_nationkey - b) / t AS y FROM supplier, m)
SELECT p.id AS a, q.id AS b FROM z p JOIN z q ON p.id <> q.id WHERE sqrt((p.x - q.x)**2 + (p.y - q.y)**2) <= 0.2 AND sqrt((p.x - q.x)**2 + (p.y - q.y)**2) > 0""")
def distance_join(spark, d) -> DataFrame:
    """Pairs of suppliers within a distance, found along a grid."""
    return clustering.neighbour_pairs(clustering.points(load(spark, d, "supplier"), "s_suppkey", ["s_acctbal", "s_nationkey"]), 0.2)


@query("""SELECT bool_and(abs(a - b) <= 1e-8 + 1e-5 * abs(b)) AS all_close FROM (SELECT sum(l_extendedprice * (1 - l_discount)) AS a, sum(l_extendedprice) - sum(l_extendedprice * l_discount) AS b FROM lineitem GROUP BY l_returnflag)""")
def approximate_equality(spark, d) -> DataFrame:
    from minespark.functions.linalg import close

    g = load(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("a"), (F.sum("l_extendedprice") - F.sum(F.col("l_extendedprice") * F.col("l_discount"))).alias("b"))
    return g.agg(F.bool_and(close(F.col("a"), F.col("b"))).alias("all_close"))


# -- collaborative filtering -------------------------------------------------


def brand_ratings(spark, d) -> DataFrame:
    """Mean discount (0 to 10) that customers of a nation get on a brand, over all line items: user = nation, item = brand."""
    j = (
        load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_discount")
        .join(load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
        .join(load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
        .join(load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    )
    r = j.groupBy(F.col("c_nationkey").alias("user"), F.col("p_brand").alias("item")).agg(F.round(F.avg("l_discount") * 100, 4).alias("rating"))
    return materialize(r)


_R = """r AS (SELECT c_nationkey AS u, p_brand AS i, round(avg(l_discount) * 100, 4) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def _sims(a: str, o: str) -> str:
    return f"""c AS (SELECT {a} AS a, {o} AS o, x - avg(x) OVER (PARTITION BY {a}) AS x FROM r), nm AS (SELECT a, sqrt(sum(x * x)) AS n FROM c GROUP BY 1),
s AS (SELECT p.a, q.a AS b, sum(p.x * q.x) / (any_value(m.n) * any_value(k.n)) AS s FROM c p JOIN c q ON p.o = q.o AND p.a <> q.a JOIN nm m ON m.a = p.a JOIN nm k ON k.a = q.a GROUP BY 1, 2)"""


def _predict_sql(r: str, a: str, o: str, how: str) -> str:
    """Clipped predictions of all cells over the ratings ``r``."""
    value = {"mean-utility": "avg(x)", "weighted-sum": "CASE WHEN abs(sum(s)) > 1e-12 THEN sum(x * s) / sum(s) END", "adjusted-weighted-sum": "any_value(ma) + CASE WHEN abs(sum(s)) > 1e-12 THEN sum((x - mb) * s) / sum(s) END"}[how]
    return f"""WITH {r}, {_sims(a, o)}, mn AS (SELECT {a} AS a, avg(x) AS m FROM r GROUP BY 1), t AS (SELECT * FROM (SELECT DISTINCT u FROM r), (SELECT DISTINCT i FROM r)),
k AS (SELECT t.u, t.i, r.x, round(coalesce(s.s, 0), 12) AS s, ma.m AS ma, mb.m AS mb, row_number() OVER (PARTITION BY t.u, t.i ORDER BY round(coalesce(s.s, 0), 12) DESC, r.{a}) AS n FROM t JOIN r ON r.{o} = t.{o} AND r.{a} <> t.{a}
 LEFT JOIN s ON s.a = t.{a} AND s.b = r.{a} JOIN mn ma ON ma.a = t.{a} JOIN mn mb ON mb.a = r.{a} QUALIFY n <= 5), g AS (SELECT u, i, greatest(least({value}, 10), -10) AS pred FROM k GROUP BY 1, 2)
SELECT t.u AS user, t.i AS item, round(pred, 5) AS pred FROM t LEFT JOIN g USING (u, i)"""


for _kind, _a, _o in (("user", "u", "i"), ("item", "i", "u")):

    def _sim(spark, d, kind=_kind) -> DataFrame:
        s = recommend.similarity(brand_ratings(spark, d), kind)
        return s.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.round("sim", 6).alias("sim"))

    QUERIES[f"cf_{_kind}_similarity"] = _sim
    SQL[f"cf_{_kind}_similarity"] = f"WITH {_R}, {_sims(_a, _o)} SELECT CAST(a AS VARCHAR) AS a, CAST(b AS VARCHAR) AS b, round(s, 6) AS sim FROM s"
    for _how in ("mean-utility", "weighted-sum", "adjusted-weighted-sum"):

        def _cf(spark, d, method=f"{_kind}-{_how}") -> DataFrame:
            r = brand_ratings(spark, d)
            return recommend.recommend(r, recommend.all_cells(r), method).select("user", "item", F.round("pred", 5).alias("pred"))

        _name = f"cf_{_kind}_{_how.replace('-', '_')}"
        QUERIES[_name] = _cf
        SQL[_name] = _predict_sql(_R, _a, _o, _how)


def customer_ratings(spark, d) -> DataFrame:
    """Mean discount (0 to 10) that a customer gets on a brand, over all line items: user = customer, item = brand."""
    j = (
        load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_discount")
        .join(load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("user")), "l_orderkey")
        .join(load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("item")), "l_partkey")
    )
    return materialize(j.groupBy("user", "item").agg(F.round(F.avg("l_discount") * 100, 4).alias("rating")), tidy=True)


_CR = """r AS (SELECT o_custkey AS u, p_brand AS i, round(avg(l_discount) * 100, 4) AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def _similar_sql(r: str, a: str, o: str) -> str:
    """Similarities of all pairs that share something; NULL where a vector is constant."""
    return f"WITH {r}, {_sims(a, o).replace('sum(p.x * q.x) / (any_value(m.n) * any_value(k.n))', 'CASE WHEN round(any_value(m.n) * any_value(k.n), 12) > 0 THEN sum(p.x * q.x) / (any_value(m.n) * any_value(k.n)) END')} SELECT a, b, round(s, 6) AS sim FROM s"


@query(_similar_sql(_CR, "u", "i"))
def cf_customers_user_similarity(spark, d) -> DataFrame:
    s = recommend.similarity_in_blocks(customer_ratings(spark, d), "user")
    return s.select("a", "b", F.round("sim", 6).alias("sim"))


@query(_similar_sql(_CR, "i", "u"))
def cf_customers_item_similarity(spark, d) -> DataFrame:
    s = recommend.similarity(customer_ratings(spark, d), "item")
    return s.select("a", "b", F.round("sim", 6).alias("sim"))


for _method in recommend.METHODS:

    def _cf_customers(spark, d, method=_method) -> DataFrame:
        r = customer_ratings(spark, d)
        return recommend.recommend(r, recommend.all_cells(r), method, blocks=method.startswith("user")).select("user", "item", F.round("pred", 5).alias("pred"))

    QUERIES[f"cf_customers_{_method.replace('-', '_')}"] = _cf_customers
    SQL[f"cf_customers_{_method.replace('-', '_')}"] = _predict_sql(_CR, "ui"[_method.startswith("item")], "ui"[_method.startswith("user")], _method.split("-", 1)[1])


# -- text --------------------------------------------------------------------


def _texts(spark, d) -> DataFrame:
    return load_spread(spark, d, "documents", "doc_id", "text", "source").filter("doc_id IS NOT NULL")


def _tf(spark, d, stemmed: bool = False) -> DataFrame:
    return materialize(text.term_frequencies(_texts(spark, d), "doc_id", "text", stemmed))


_TF = r"""tok AS (SELECT doc_id AS doc, unnest(list_filter(list_transform(string_split_regex(regexp_replace(lower(text), '[^a-zA-Z''.]|^\.|\.$', ' ', 'g'), '[ \t\n\r]+'), lambda t: regexp_replace(t, '^''|''$|''s$|\.', '', 'g')), lambda t: length(t) > 0)) AS term FROM documents),
tf AS (SELECT doc, term, count(*) AS f FROM tok GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents), dfr AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
x AS (SELECT doc, term, f, f / max(f) OVER (PARTITION BY doc) AS tf, df, log2(n / df) AS idf FROM tf JOIN dfr USING (term), n)"""


@query(f"WITH {_TF} SELECT doc, term, f FROM tf")
def term_frequency(spark, d) -> DataFrame:
    return _tf(spark, d)


@query(f"WITH {_TF} SELECT term, df, round(log2(n / df), 8) AS idf FROM dfr, n")
def document_frequency(spark, d) -> DataFrame:
    x = text.tf_idf(_tf(spark, d), _texts(spark, d).agg(F.count("*").alias("n")))
    return x.groupBy("term").agg(F.first("df").alias("df"), F.round(F.first("idf"), 8).alias("idf"))


@query(f"WITH {_TF} SELECT doc, term, round(tf * idf, 7) AS w, round((0.5 + 0.5 * tf) * idf, 7) AS q FROM x")
def tf_idf_weights(spark, d) -> DataFrame:
    x = text.tf_idf(_tf(spark, d), _texts(spark, d).agg(F.count("*").alias("n")))
    return x.select("doc", "term", F.round("w", 7).alias("w"), F.round((F.lit(0.5) + 0.5 * F.col("tf")) * F.col("idf"), 7).alias("q"))


def _similar(spark, d, how: str, k: int = 5) -> DataFrame:
    docs = _texts(spark, d)
    n = docs.count()
    bag = text.bags(docs, "doc_id", "text")
    df = text.vocabulary(bag)
    x = text.bag_terms(bag.filter("doc % 20 = 0"), df, n)
    if how == "cosine":
        left = text.cosine_weights(x, F.col("idf"))
        right = text.bag_norms(bag, df, n)
    else:
        left, _ = text.okapi_weights(x, text.doc_lengths(docs, "doc_id", "text"), n)
        right = text.okapi_bags(bag)
    return text.most_similar(left, right, k, -(-n // 20), n)


_TOP = "SELECT q AS query, doc, CAST(r AS INTEGER) AS rank FROM (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY round(s, 10) DESC, doc) AS r FROM g) WHERE r <= 5"


@query(f"WITH {_TF}, w AS (SELECT doc, term, tf * idf AS w, sqrt(sum((tf * idf)**2) OVER (PARTITION BY doc)) AS l FROM x), g AS (SELECT a.doc AS q, b.doc, sum(a.w / a.l * b.w / b.l) AS s FROM w a JOIN w b ON a.term = b.term AND a.doc <> b.doc WHERE a.doc % 20 = 0 AND a.l > 0 AND b.l > 0 GROUP BY 1, 2) {_TOP}")
def cosine_neighbours(spark, d) -> DataFrame:
    return _similar(spark, d, "cosine").select("query", "doc", "rank")


@query(f"""WITH {_TF}, ln AS (SELECT doc_id AS doc, coalesce(octet_length(encode(text)), 0) AS dl FROM documents), y AS (SELECT x.*, dl, (SELECT avg(dl) FROM ln) AS av FROM x JOIN ln USING (doc)),
g AS (SELECT a.doc AS q, b.doc, sum(ln((n - a.df + 0.5) / (a.df + 0.5)) * 2.5 * a.f / (1.5 * (0.25 + 0.75 * a.dl / a.av) + a.f) * 2.5 * b.f / (1.5 + b.f)) AS s FROM y a JOIN x b ON a.term = b.term AND a.doc <> b.doc, n WHERE a.doc % 20 = 0 GROUP BY 1, 2) {_TOP}""")
def okapi_neighbours(spark, d) -> DataFrame:
    return _similar(spark, d, "okapi").select("query", "doc", "rank")


_AUTHOR = SQL["okapi_neighbours"].replace(_TOP, "") + """, k AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY round(s, 10) DESC, doc) AS r FROM g),
c AS (SELECT q, source, count(*) AS n FROM k JOIN documents ON doc = doc_id WHERE r <= 5 GROUP BY 1, 2),
a AS (SELECT q AS query, source AS pred FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, source) AS o FROM c) WHERE o = 1), j AS (SELECT query, source AS obs, pred FROM a JOIN documents ON doc_id = query)"""


@query(_AUTHOR + " SELECT query, obs, pred FROM j")
def author_knn(spark, d) -> DataFrame:
    """Each queried document's source, as most of its five most similar documents have it."""
    a = _texts(spark, d).select(F.col("doc_id").alias("doc"), F.col("source").alias("author"))
    return text.knn_authors(_similar(spark, d, "okapi"), a)


@query(_AUTHOR + """, h AS (SELECT obs AS author, CAST(sum(CAST(obs = pred AS INT)) AS BIGINT) AS hits, CAST(sum(CAST(obs <> pred AS INT)) AS BIGINT) AS misses FROM j GROUP BY 1), t AS (SELECT pred AS author, CAST(sum(CAST(obs <> pred AS INT)) AS BIGINT) AS strikes FROM j GROUP BY 1)
SELECT author, hits, strikes, misses FROM h FULL JOIN t USING (author)""")
def author_knn_report(spark, d) -> DataFrame:
    return evaluate.author_report(author_knn(spark, d)).select("author", "hits", "strikes", "misses")


@query()
def stemmed_frequency(spark, d) -> DataFrame:
    return _tf(spark, d, stemmed=True)


# -- graphs ------------------------------------------------------------------


def trade_edges(spark, d) -> DataFrame:
    """Supplier nation -> customer nation, an edge for every line."""
    l = load(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c = load(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    return l.join(o, "l_orderkey").join(c, "c_custkey").join(s, "l_suppkey").select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))


_E = """e AS (SELECT CAST(s_nationkey AS VARCHAR) AS src, CAST(c_nationkey AS VARCHAR) AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


def _pr_sql(edges: str, src: str = "e", rounds: int = 10) -> str:
    s = f"WITH {edges}, v AS (SELECT src AS id FROM {src} UNION SELECT dst FROM {src}), n AS (SELECT count(*) AS n FROM v), deg AS (SELECT src, count(*) AS deg FROM {src} GROUP BY 1), m AS (SELECT DISTINCT src, dst, 1.0 / deg AS w FROM {src} JOIN deg USING (src)), p0 AS (SELECT id, 1.0::DOUBLE / n AS p FROM v, n)"
    for i in range(rounds):
        s += f", p{i + 1} AS (SELECT v.id, 0.85 * coalesce(sum(m.w * p.p), 0) + 0.15 / any_value(n) AS p FROM v LEFT JOIN m ON m.dst = v.id LEFT JOIN p{i} p ON p.id = m.src, n GROUP BY 1)"
    return s + f" SELECT id, round(p, 8) AS pr FROM p{rounds}"


@query(_pr_sql(_E))
def pagerank_directed(spark, d) -> DataFrame:
    r, _ = pagerank.pagerank(trade_edges(spark, d), d=0.85, max_iterations=10, tolerance=False)
    return r.select("id", F.round("pr", 8).alias("pr"))


@query(_pr_sql(_E + ", u AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)", "u"))
def pagerank_undirected(spark, d) -> DataFrame:
    e = trade_edges(spark, d)
    r, _ = pagerank.pagerank(pagerank.graph(e, "dst", "src"), d=0.85, max_iterations=10, tolerance=False)
    return r.select("id", F.round("pr", 8).alias("pr"))


@query(_pr_sql(_E, rounds=40).replace("0.85 * ", "0.5 * ").replace("0.15 / ", "0.5 / ").replace("SELECT id, round(p, 8) AS pr FROM p40", "SELECT CAST(row_number() OVER (ORDER BY p DESC, id) AS INTEGER) AS rank, id, round(p, 5) AS pr FROM p40"))
def pagerank_converged(spark, d) -> DataFrame:
    r, _ = pagerank.pagerank(trade_edges(spark, d), d=0.5)
    return pagerank.report(r).withColumn("pr", F.round("pr", 5))


# -- exploration queries -----------------------------------------------------


@query("""WITH y AS (SELECT p_brand AS item, CAST(year(o_orderdate) AS INTEGER) AS year, sum(l_quantity) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT item, year, q FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY q DESC, year) AS r FROM y) WHERE r = 1""")
def best_year_per_item(spark, d) -> DataFrame:
    j = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").join(load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("year")), "l_orderkey")
    j = j.join(load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("item")), "l_partkey")
    y = j.groupBy("item", "year").agg(F.sum("l_quantity").alias("q"))
    return y.groupBy("item").agg(F.max_by("year", F.struct("q", (-F.col("year")).alias("y"))).alias("year"), F.max("q").alias("q"))


@query("""WITH g AS (SELECT c_mktsegment AS seg, p_brand AS b, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT seg, max(b) AS last_name, max(n) AS most, (SELECT b FROM g x WHERE x.seg = g.seg ORDER BY n DESC, b LIMIT 1) AS preferred FROM g GROUP BY 1""")
def preferred_item_per_segment(spark, d) -> DataFrame:
    """Both readings: each column's own maximum, and the item with the greatest count."""
    j = load(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
    j = j.join(load(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg")), "c_custkey").join(load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("b")), "l_partkey")
    g = j.groupBy("seg", "b").agg(F.count("*").alias("n"))
    return g.groupBy("seg").agg(F.max("b").alias("last_name"), F.max("n").alias("most"), F.min_by("b", F.struct((-F.col("n")).alias("m"), "b")).alias("preferred"))


@query("""WITH s AS (SELECT p_brand AS b, CAST(year(l_shipdate) AS INTEGER) AS y, count(*) FILTER (l_returnflag = 'R') / count(*) AS p FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), r AS (SELECT min(y) AS a, max(y) AS z FROM s),
d AS (SELECT b, avg(p) FILTER (y >= z - 1) - avg(p) FILTER (y <= a + 1) AS diff FROM s, r GROUP BY 1 HAVING count(*) FILTER (y >= z - 1 OR y <= a + 1) = 4)
(SELECT 'low' AS part, b, round(diff, 8) AS diff FROM d ORDER BY round(diff, 10), b LIMIT 5) UNION ALL (SELECT 'high', b, round(diff, 8) FROM d ORDER BY round(diff, 10) DESC, b LIMIT 5)""")
def share_drift(spark, d) -> DataFrame:
    """The brands whose share of returned lines fell and rose most from the first two years to the last two."""
    j = load(spark, d, "lineitem").select("l_partkey", F.year("l_shipdate").alias("y"), (F.col("l_returnflag") == "R").cast("double").alias("r")).join(load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("b")), "l_partkey")
    s = materialize(j.groupBy("b", "y").agg(F.avg("r").alias("p")))
    x = s.join(F.broadcast(s.agg(F.min("y").alias("a"), F.max("y").alias("z"))), how="inner")  # one row
    late, early = F.col("y") >= F.col("z") - 1, F.col("y") <= F.col("a") + 1
    g = x.groupBy("b").agg((F.avg(F.when(late, F.col("p"))) - F.avg(F.when(early, F.col("p")))).alias("diff"), F.count_if(late | early).alias("n")).filter("n = 4")
    low = g.orderBy(F.round("diff", 10), "b").limit(5).select(F.lit("low").alias("part"), "b", F.round("diff", 8).alias("diff"))
    return low.unionByName(g.orderBy(F.desc(F.round("diff", 10)), "b").limit(5).select(F.lit("high").alias("part"), "b", F.round("diff", 8).alias("diff")))


@query(f"""WITH {_SNAP}, ip AS (SELECT DISTINCT {_key()} AS k FROM inpatient_claim), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY y DESC) AS o FROM snap) WHERE o = 1 AND k IN (SELECT k FROM ip)),
n AS (SELECT count(*) AS n FROM l), t AS (SELECT k, unnest([{", ".join(f"CASE WHEN {c} = 1 THEN '{c}' END" for c in STATUS)}]) AS i FROM l), f AS (SELECT k, i FROM t WHERE i IS NOT NULL), s AS (SELECT i, count(*) AS c FROM f GROUP BY 1)
SELECT a.i AS antecedent, b.i AS consequent, round(count(*) / any_value(n), 8) AS support, round(count(*) / any_value(s.c), 8) AS confidence FROM f a JOIN f b ON a.k = b.k AND a.i <> b.i JOIN s ON s.i = a.i JOIN s r ON r.i = b.i, n
WHERE s.c > 0.1 * n AND r.c > 0.1 * n GROUP BY 1, 2 HAVING count(*) >= 0.1 * any_value(n) AND count(*) / any_value(s.c) >= 0.5""")
def condition_rules(spark, d) -> DataFrame:
    """Which conditions go together, among beneficiaries with inpatient claims, by their last snapshot: rules of one antecedent."""
    snap = snapshot_rows(spark, d)
    last = snap.groupBy("k").agg(F.max(F.struct("y", *STATUS)).alias("x")).select("k", "x.*")
    from minespark.functions.keys import hex_number

    seen = load(spark, d, "inpatient_claim").select(hex_number(F.col("desynpuf_id")).alias("k")).filter("k IS NOT NULL").distinct()
    items = F.filter(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in STATUS]), lambda x: x.isNotNull())
    b = last.join(seen, "k", "left_semi").select(F.col("k").alias("tid"), items.alias("items"))
    sets, total = assoc.frequent_itemsets(b, 0.1, max_len=2)
    r = assoc.rules(sets, total, 0.5)
    return r.select(F.element_at("antecedent", 1).alias("antecedent"), "consequent", F.round("support", 8).alias("support"), F.round("confidence", 8).alias("confidence"))


def beneficiary_features(spark, d) -> DataFrame:
    """Age at the end of the last snapshot's year, total payments and claims, and flags, of beneficiaries with claims."""
    last = snapshot_rows(spark, d).groupBy("k").agg(F.max(F.struct("y", "bene_birth_dt", "bene_sex_ident_cd", "bene_race_cd", *STATUS)).alias("x")).select("k", "x.*")
    c = clean_claims(spark, d).filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("claims"), F.round(F.sum("clm_pmt_amt"), 2).alias("paid"))
    from minespark.functions.keys import int_date

    j = last.join(c, "k", "right")
    age = F.date_diff(F.make_date("y", F.lit(12), F.lit(31)), int_date(F.col("bene_birth_dt")))
    code = F.lit(0)
    for i, (a, b, e) in enumerate(((1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 1, 1), (1, 0, 1), (1, 1, 0), (1, 1, 1)), 1):
        code = F.when((F.col("sp_depressn") == a) & (F.col("sp_diabetes") == b) & (F.col("sp_ischmcht") == e), i).otherwise(code)
    return j.select("k", age.alias("age"), "claims", "paid", (F.col("bene_sex_ident_cd") % 2).alias("sex"), F.col("bene_race_cd").alias("race"), code.alias("cc"))


@query(f"""WITH {_SNAP}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY y DESC) AS o FROM snap) WHERE o = 1),
c AS (SELECT k, count(*) AS claims, round(sum(amt), 2) AS paid FROM (SELECT {_key()} AS k, clm_pmt_amt AS amt, min(coalesce(claim_count, 0)) OVER (PARTITION BY clm_id) AS least, row_number() OVER (PARTITION BY clm_id ORDER BY load_ts DESC NULLS LAST, clm_pmt_amt DESC NULLS LAST) AS rn FROM inpatient_claim) WHERE least >= 0 AND rn = 1 AND k IS NOT NULL GROUP BY 1)
SELECT c.k, CAST(date_diff('day', CAST(strptime(CAST(bene_birth_dt AS VARCHAR), '%Y%m%d') AS DATE), make_date(CAST(y AS INT), 12, 31)) AS INTEGER) AS age, claims, paid, bene_sex_ident_cd % 2 AS sex, bene_race_cd AS race,
CAST(CASE WHEN sp_depressn = 1 AND sp_diabetes = 0 AND sp_ischmcht = 0 THEN 1 WHEN sp_depressn = 0 AND sp_diabetes = 1 AND sp_ischmcht = 0 THEN 2 WHEN sp_depressn = 0 AND sp_diabetes = 0 AND sp_ischmcht = 1 THEN 3 WHEN sp_depressn = 0 AND sp_diabetes = 1 AND sp_ischmcht = 1 THEN 4
 WHEN sp_depressn = 1 AND sp_diabetes = 0 AND sp_ischmcht = 1 THEN 5 WHEN sp_depressn = 1 AND sp_diabetes = 1 AND sp_ischmcht = 0 THEN 6 WHEN sp_depressn = 1 AND sp_diabetes = 1 AND sp_ischmcht = 1 THEN 7 ELSE 0 END AS INTEGER) AS cc FROM l RIGHT JOIN c ON l.k = c.k""")
def claims_feature_table(spark, d) -> DataFrame:
    from minespark.functions.keys import hex_text

    return beneficiary_features(spark, d).withColumn("k", hex_text(F.col("k")))
