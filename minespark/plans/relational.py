"""Relational queries: projections, predicates, joins, aggregates, windows, reshaping, set operations, scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minespark.operators import evaluate, prep
from minespark.operators.rows import latest_rows
from minespark.tables import load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def day(c: str):
    return F.col(c).cast("date")


# -- projections and predicates ---------------------------------------------


@query("""SELECT o_orderkey AS order_id, o_totalprice AS price, o_orderstatus AS status FROM orders
WHERE o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderpriority = '1-URGENT'""")
def filter_project(spark, d) -> DataFrame:
    o = load(spark, d, "orders").filter(F.col("o_orderstatus").isin("F", "P") & F.col("o_totalprice").between(1000, 200000) & (F.col("o_orderpriority") == "1-URGENT"))
    return o.select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem")
def restrict_columns(spark, d) -> DataFrame:
    t = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    return prep.restrict(t, [1, 0, 1], always=["l_orderkey", "l_linenumber"])


@query("""SELECT vec_id, bene_sex_ident_cd % 2 AS sex, CASE WHEN sp_chf = 1 THEN 1 ELSE 0 END + CASE WHEN sp_copd = 1 THEN 2 ELSE 0 END + CASE WHEN sp_cncr = 1 THEN 4 ELSE 0 END AS code,
 CAST(claim_count AS VARCHAR) AS claims_text, nullif(claim_count, 2) AS claims_but_2, round(est_age_in_days / 365.25, 4) AS years, coalesce(claim_count >= 3, FALSE) AS often,
 CASE WHEN clm_pmt_amt IS NOT NULL THEN greatest(least(clm_pmt_amt, 10000), 1000) END AS pay, coalesce(cc_group, 'none') AS cc FROM (SELECT DISTINCT * FROM bene_knn) WHERE bene_race_cd IS NOT NULL""")
def derived_columns(spark, d) -> DataFrame:
    t = load(spark, d, "bene_knn").distinct().dropna(subset=["bene_race_cd"])
    code = sum((F.when(F.col(c) == 1, F.lit(b)).otherwise(0) for c, b in (("sp_chf", 1), ("sp_copd", 2), ("sp_cncr", 4))), F.lit(0))
    return t.select(
        "vec_id",
        (F.col("bene_sex_ident_cd") % 2).alias("sex"),
        code.alias("code"),
        F.col("claim_count").cast("string").alias("claims_text"),
        prep.sentinel_to_null(F.col("claim_count"), 2).alias("claims_but_2"),
        F.round(F.col("est_age_in_days") / 365.25, 4).alias("years"),
        prep.at_least(F.col("claim_count"), 3).alias("often"),
        prep.clip(F.col("clm_pmt_amt"), 1000, 10000).alias("pay"),
        F.coalesce("cc_group", F.lit("none")).alias("cc"),
    )


@query("""WITH t AS (SELECT DISTINCT vec_id, clm_pmt_amt, bene_race_cd FROM bene_knn)
SELECT vec_id, coalesce(clm_pmt_amt, (SELECT quantile_cont(clm_pmt_amt, 0.5) FROM t)) AS clm_pmt_amt,
 coalesce(bene_race_cd, (SELECT bene_race_cd FROM t WHERE bene_race_cd IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS bene_race_cd FROM t""")
def impute_median_mode(spark, d) -> DataFrame:
    t = load(spark, d, "bene_knn").select("vec_id", "clm_pmt_amt", "bene_race_cd").distinct()
    return prep.impute(t, ["clm_pmt_amt", "bene_race_cd"])


# -- joins ------------------------------------------------------------------


@query("""WITH r AS (SELECT l_partkey AS p, year(l_shipdate) AS y, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
n AS (SELECT l_partkey AS p, year(l_shipdate) AS y, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2)
SELECT p, CAST(y AS INTEGER) AS y, r.q AS returned, n.q AS kept, round(r.q / (r.q + n.q), 6) AS share, round(1 - r.q / (r.q + n.q), 6) AS rest FROM r JOIN n USING (p, y)""")
def join_two_keys(spark, d) -> DataFrame:
    t = load(spark, d, "lineitem").select(F.col("l_partkey").alias("p"), F.year("l_shipdate").alias("y"), "l_quantity", "l_returnflag")
    # both sides of the join come from one grouping, so the table is read and shuffled once
    g = t.groupBy("p", "y").agg(F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("returned"), F.sum(F.when(F.col("l_returnflag") == "N", F.col("l_quantity"))).alias("kept"))
    share = F.col("returned") / (F.col("returned") + F.col("kept"))
    return g.dropna().select("p", "y", "returned", "kept", F.round(share, 6).alias("share"), F.round(1 - share, 6).alias("rest"))


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <= 2) ON c_nationkey = n_nationkey")
def left_join_dimension(spark, d) -> DataFrame:
    n = load(spark, d, "nation").filter("n_regionkey <= 2")
    return load(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(spark, d) -> DataFrame:
    o = load(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti_join(spark, d) -> DataFrame:
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("""WITH a AS (SELECT o_custkey AS k, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1)
SELECT k, c_mktsegment, n, total FROM (SELECT * FROM customer WHERE c_acctbal > 0) RIGHT JOIN a ON c_custkey = k""")
def right_join_aggregate(spark, d) -> DataFrame:
    a = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    c = load(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    return c.join(a, "k", "right").select("k", "c_mktsegment", "n", "total")


@query("""WITH a AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, customers, suppliers FROM a FULL JOIN b ON a.k = b.k""")
def full_outer_alignment(spark, d) -> DataFrame:
    a = load(spark, d, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = load(spark, d, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full_outer")


@query("""SELECT l_orderkey AS tid, string_agg(p_name, ' | ' ORDER BY l_linenumber, l_partkey) AS names FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def item_names(spark, d) -> DataFrame:
    j = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    names = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name"))), lambda x: x["p_name"])  # an order has few lines
    return j.groupBy(F.col("l_orderkey").alias("tid")).agg(F.array_join(names, " | ").alias("names"))


# -- aggregates -------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, count(*) AS n, round(avg(l_extendedprice), 4) AS mean_price, min(l_discount) AS lo, max(l_discount) AS hi,
 round(stddev_samp(l_quantity), 6) AS sd, round(sum(l_quantity * l_quantity), 1) AS sq FROM lineitem GROUP BY 1, 2""")
def group_stats(spark, d) -> DataFrame:
    return load(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("qty"), F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"), F.min("l_discount").alias("lo"), F.max("l_discount").alias("hi"),
        F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.round(F.sum(F.col("l_quantity") * F.col("l_quantity")), 1).alias("sq"),
    )


@query("""SELECT o_orderpriority AS value, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM orders GROUP BY 1""")
def value_counts(spark, d) -> DataFrame:
    g = load(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("value")).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("t"))
    return g.join(F.broadcast(total), how="inner").select("value", "n", F.round(F.col("n") / F.col("t"), 8).alias("share"))  # one row


@query("""SELECT p_brand, (SELECT p_type FROM part b WHERE b.p_brand = a.p_brand GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode_type FROM part a GROUP BY 1""")
def mode_per_group(spark, d) -> DataFrame:
    return load(spark, d, "part").groupBy("p_brand").agg(F.mode("p_type", True).alias("mode_type"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def latest_per_key(spark, d) -> DataFrame:
    o = load(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return latest_rows(o, ["o_custkey"], ["o_orderdate"], ["o_orderkey", "o_totalprice"])


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def crosstab(spark, d) -> DataFrame:
    return load(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("""SELECT o_orderstatus AS pred, CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS BIGINT) AS "1-URGENT", CAST(count(*) FILTER (o_orderpriority = '5-LOW') AS BIGINT) AS "5-LOW" FROM orders GROUP BY 1""")
def crosstab_wide(spark, d) -> DataFrame:
    o = load(spark, d, "orders").select(F.col("o_orderstatus").alias("pred"), F.col("o_orderpriority").alias("obs"))
    return evaluate.confusion_wide(o, ["1-URGENT", "5-LOW"])


@query("""SELECT round(avg(sp_chf), 8) AS sp_chf, round(avg(sp_copd), 8) AS sp_copd, round(avg(sp_cncr), 8) AS sp_cncr FROM (SELECT DISTINCT * FROM bene_knn)""")
def column_density(spark, d) -> DataFrame:
    t = load(spark, d, "bene_knn").distinct()
    return t.agg(*[F.round(F.avg(c), 8).alias(c) for c in ("sp_chf", "sp_copd", "sp_cncr")])


@query("SELECT p_brand, round(ln(product(1 + p_size / 1000.0)), 8) AS log_product FROM part GROUP BY 1")
def product_aggregate(spark, d) -> DataFrame:
    return load(spark, d, "part").groupBy("p_brand").agg(F.round(F.ln(F.product(1 + F.col("p_size") / 1000.0)), 8).alias("log_product"))


@query("SELECT event_type, count(*) FILTER (value > 50) AS high, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def conditional_counts(spark, d) -> DataFrame:
    return load(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("high"), F.count_distinct("user_id").alias("users"))


# -- windows, order, reshaping, sets ----------------------------------------


@query("""SELECT o_custkey, o_orderkey, CAST(rn AS INTEGER) AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3""")
def top_k_per_group(spark, d) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return load(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rank"), ).filter(F.col("rank") <= 3)


@query("""(SELECT 'head' AS part, c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5) UNION ALL (SELECT 'tail', c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5)""")
def head_and_tail(spark, d) -> DataFrame:
    c = load(spark, d, "customer").select("c_custkey", "c_acctbal")
    head = c.orderBy(F.desc("c_acctbal"), "c_custkey").limit(5).select(F.lit("head").alias("part"), "*")
    return head.unionByName(c.orderBy("c_acctbal", "c_custkey").limit(5).select(F.lit("tail").alias("part"), "*"))


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS BIGINT) AS ordinal FROM part")
def row_numbers(spark, d) -> DataFrame:
    p = load(spark, d, "part").select("p_partkey", (-F.col("p_retailprice")).alias("_n"))
    return prep.with_rid(p, ["_n", "p_partkey"], "ordinal").select("p_partkey", "ordinal")


@query("""SELECT c_nationkey, CAST(sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 END) AS BIGINT) AS BUILDING, CAST(sum(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 END) AS BIGINT) AS MACHINERY FROM customer GROUP BY 1""")
def pivot_wide(spark, d) -> DataFrame:
    return load(spark, d, "customer").groupBy("c_nationkey").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).agg(F.count(F.lit(1)))


@query("""SELECT p_partkey, 'p_size' AS name, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part""")
def unpivot_long(spark, d) -> DataFrame:
    p = load(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return p.unpivot(["p_partkey"], ["p_size", "p_retailprice"], "name", "v")


@query("""SELECT name, CAST(max(CASE WHEN r_regionkey = 0 THEN v END) AS BIGINT) AS "0", CAST(max(CASE WHEN r_regionkey = 1 THEN v END) AS BIGINT) AS "1" FROM
 (SELECT n_regionkey AS r_regionkey, 'nations' AS name, count(*) AS v FROM nation GROUP BY 1 UNION ALL SELECT n_regionkey, 'letters', sum(length(n_name)) FROM nation GROUP BY 1) GROUP BY 1""")
def transpose(spark, d) -> DataFrame:
    g = load(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r")).agg(F.count("*").alias("nations"), F.sum(F.length("n_name").cast("long")).alias("letters"))
    return g.unpivot(["r"], ["nations", "letters"], "name", "v").groupBy("name").pivot("r", [0, 1]).agg(F.max("v"))


@query("""SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def set_operations(spark, d) -> DataFrame:
    o = load(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    f = o.groupBy("k").agg(*[F.bool_or(F.col("o_orderstatus") == s).alias(s) for s in "FOP"])  # one grouping instead of three distincts
    return f.filter("F and O and not P").select("k")


@query("""SELECT l_orderkey AS k, 'line' AS kind FROM lineitem WHERE l_quantity >= 50 UNION ALL SELECT o_orderkey, 'order' FROM orders WHERE o_totalprice > 400000""")
def union_all(spark, d) -> DataFrame:
    a = load(spark, d, "lineitem").filter("l_quantity >= 50").select(F.col("l_orderkey").alias("k"), F.lit("line").alias("kind"))
    return a.unionByName(load(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_orderkey").alias("k"), F.lit("order").alias("kind")))


@query("""SELECT user_id, event_type, round(avg(value), 6) AS v FROM events WHERE user_id IN (SELECT user_id FROM events WHERE value > 99) AND event_type IN (SELECT event_type FROM events WHERE value > 99) GROUP BY 1, 2""")
def sub_matrix(spark, d) -> DataFrame:
    e = load(spark, d, "events").select("user_id", "event_type", "value")
    high = e.filter("value > 99")
    return e.join(high.select("user_id").distinct(), "user_id", "left_semi").join(high.select("event_type").distinct(), "event_type", "left_semi").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("v"))


# -- functions --------------------------------------------------------------


@query(r"""SELECT p_partkey, lower(p_name) AS lo, trim(p_brand) AS tr, split_part(p_type, ' ', 1) AS first, replace(p_brand, '#', '-') AS re, len(string_split(p_name, 'a')) - 1 AS n_a,
 round(sqrt(p_retailprice), 6) AS sq, round(ln(p_size), 6) AS l, round(log2(p_size), 6) AS l2, CAST(sign(p_size - 25) AS DOUBLE) AS sg, abs(p_size - 25) AS ab, greatest(p_size, 10) AS g, p_brand || '/' || p_type AS path FROM part""")
def scalar_functions(spark, d) -> DataFrame:
    p = load(spark, d, "part")
    size = F.col("p_size")
    return p.select(
        "p_partkey", F.lower("p_name").alias("lo"), F.trim("p_brand").alias("tr"), F.element_at(F.split("p_type", " "), 1).alias("first"), F.regexp_replace("p_brand", "#", "-").alias("re"),
        F.regexp_count("p_name", F.lit("a")).cast("bigint").alias("n_a"), F.round(F.sqrt("p_retailprice"), 6).alias("sq"), F.round(F.ln(size), 6).alias("l"), F.round(F.log2(size), 6).alias("l2"),
        F.signum((size - 25).cast("double")).alias("sg"), F.abs(size - 25).alias("ab"), F.greatest(size, F.lit(10)).alias("g"), F.concat_ws("/", "p_brand", "p_type").alias("path"),
    )


@query("""SELECT DISTINCT clm_from_dt, CAST(strptime(CAST(clm_from_dt AS VARCHAR), '%Y%m%d') AS DATE) AS day, CAST(date_diff('day', DATE '2008-01-01', CAST(strptime(CAST(clm_from_dt AS VARCHAR), '%Y%m%d') AS DATE)) AS INTEGER) AS days FROM inpatient_claim""")
def date_functions(spark, d) -> DataFrame:
    from minespark.functions.keys import int_date

    t = load(spark, d, "inpatient_claim").select("clm_from_dt").distinct().withColumn("day", int_date(F.col("clm_from_dt")))
    return t.select("clm_from_dt", "day", F.date_diff("day", F.lit("2008-01-01").cast("date")).alias("days"))


@query("""WITH m AS (SELECT avg(c_acctbal) AS a, stddev_samp(c_acctbal) AS s FROM customer) SELECT c_custkey, round((c_acctbal - a) / s, 8) AS z FROM customer, m""")
def z_scores(spark, d) -> DataFrame:
    c = load(spark, d, "customer").select("c_custkey", "c_acctbal")
    return prep.standardize(c, ["c_acctbal"]).select("c_custkey", F.round("c_acctbal", 8).alias("z"))


@query("""SELECT c_custkey, CAST(c_mktsegment = 'AUTOMOBILE' AS INTEGER) AS seg_AUTOMOBILE, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS seg_BUILDING, CAST(c_mktsegment = 'FURNITURE' AS INTEGER) AS seg_FURNITURE,
 CAST(c_mktsegment = 'HOUSEHOLD' AS INTEGER) AS seg_HOUSEHOLD, CAST(c_mktsegment = 'MACHINERY' AS INTEGER) AS seg_MACHINERY FROM customer""")
def one_hot_columns(spark, d) -> DataFrame:
    return prep.one_hot(load(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg")))


# -- evaluation -------------------------------------------------------------


def _judged(spark, d) -> DataFrame:
    """Observed order status and a rule's prediction of it."""
    pred = F.when(F.col("o_orderdate") < F.lit("1995-03-15").cast("timestamp_ntz"), "F").when(F.col("o_totalprice") > 300000, "P").otherwise("O")
    return load(spark, d, "orders").select(F.col("o_orderstatus").alias("obs"), pred.alias("pred"), "o_orderkey")


_J = "j AS (SELECT o_orderstatus AS obs, CASE WHEN o_orderdate < TIMESTAMP '1995-03-15' THEN 'F' WHEN o_totalprice > 300000 THEN 'P' ELSE 'O' END AS pred, o_orderkey FROM orders), l AS (SELECT DISTINCT obs FROM j)"


@query(f"WITH {_J}, n AS (SELECT pred, obs, count(*) AS n FROM j GROUP BY 1, 2) SELECT a.obs AS pred, b.obs AS obs, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN n ON n.pred = a.obs AND n.obs = b.obs")
def confusion_matrix(spark, d) -> DataFrame:
    return evaluate.confusion(_judged(spark, d))


@query(f"WITH {_J} SELECT count(*) AS n, CAST(sum(CAST(obs = pred AS INT)) AS BIGINT) AS correct, round(avg(CAST(obs = pred AS DOUBLE)), 8) AS accuracy, round(1 - avg(CAST(obs = pred AS DOUBLE)), 8) AS error FROM j")
def accuracy_report(spark, d) -> DataFrame:
    return evaluate.overall(_judged(spark, d)).select("n", "correct", F.round("accuracy", 8).alias("accuracy"), F.round("error", 8).alias("error"))


@query(f"""WITH {_J}, c AS (SELECT x.obs AS label, count(*) FILTER (j.obs = x.obs AND pred = x.obs) AS tp, count(*) FILTER (j.obs <> x.obs AND pred = x.obs) AS fp, count(*) FILTER (j.obs = x.obs AND pred <> x.obs AND pred IN (SELECT obs FROM l)) AS fn,
 count(*) FILTER (j.obs <> x.obs AND pred <> x.obs AND pred IN (SELECT obs FROM l)) AS tn FROM l x CROSS JOIN j GROUP BY 1),
r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 1.0) AS p, coalesce(tp / nullif(tp + fn, 0), 1.0) AS q, coalesce(fp / nullif(fp + tn, 0), 1.0) AS o FROM c)
SELECT label, tp, fp, fn, tn, round(p, 8) AS precision, round(q, 8) AS recall, round(o, 8) AS pf, round(2 * p * q / nullif(p + q, 0), 8) AS f FROM r""")
def class_report(spark, d) -> DataFrame:
    r = evaluate.per_class(_judged(spark, d))
    return r.select("label", "tp", "fp", "fn", "tn", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "pf", "f")])


@query(f"""WITH {_J}, f AS (SELECT o_orderkey % 5 AS fold, avg(CAST(obs = pred AS DOUBLE)) AS a, sum(CAST(obs = pred AS DOUBLE)) AS h, count(*) AS n FROM j GROUP BY 1) SELECT round(sum(h) / sum(n), 8) AS pooled_accuracy, round(avg(a), 8) AS mean_accuracy FROM f""")
def fold_accuracy(spark, d) -> DataFrame:
    r = evaluate.fold_report(_judged(spark, d).withColumn("fold", F.col("o_orderkey") % 5))
    return r.select(F.round("pooled_accuracy", 8).alias("pooled_accuracy"), F.round("mean_accuracy", 8).alias("mean_accuracy"))


@query(f"""WITH {_J}, a AS (SELECT obs AS author, CAST(sum(CAST(obs = pred AS INT)) AS BIGINT) AS hits, CAST(sum(CAST(obs <> pred AS INT)) AS BIGINT) AS misses FROM j GROUP BY 1), b AS (SELECT pred AS author, CAST(sum(CAST(obs <> pred AS INT)) AS BIGINT) AS strikes FROM j GROUP BY 1)
SELECT author, hits, strikes, misses, round(hits / nullif(hits + strikes, 0), 8) AS precision, round(hits / nullif(hits + misses, 0), 8) AS recall, round(2.0 * (hits / nullif(hits + strikes, 0)) * (hits / nullif(hits + misses, 0)) / nullif(hits / nullif(hits + strikes, 0) + hits / nullif(hits + misses, 0), 0), 8) AS f1 FROM a FULL JOIN b USING (author)""")
def author_summary(spark, d) -> DataFrame:
    r = evaluate.author_report(_judged(spark, d))
    return r.select("author", "hits", "strikes", "misses", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT CAST(f AS INTEGER) AS fold, count(*) AS n FROM (SELECT ntile(7) OVER (ORDER BY c_custkey) AS f FROM customer) GROUP BY 1")
def fold_sizes(spark, d) -> DataFrame:
    return prep.k_folds(load(spark, d, "customer").select("c_custkey"), "c_custkey", 7, seed=1).groupBy("fold").agg(F.count("*").alias("n"))
