"""Queries that write the file formats and read them again; their SQL asks the tables the files were made of."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from minespark.operators import assoc, evaluate, pagerank, text, tree
from minespark.plans import mining as M
from minespark.plans import models
from minespark.scratch import materialize, shared_dir
from minespark.sources import readers, writers
from minespark.tables import load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}/{name}"


def put_lines(spark: SparkSession, head: list[str], body: DataFrame | None = None, order: str | None = None, line: Column | None = None) -> str:
    """One text file: leading lines, then a line of every row; a format with leading lines is one file by definition."""
    path = place(spark, "lines")
    all_ = spark.createDataFrame([(i - len(head), h) for i, h in enumerate(head)], "n long, value string")
    if body is not None:
        all_ = all_.unionByName(body.select(F.col(order).cast("bigint").alias("n"), line.alias("value")))
    all_.coalesce(1).sortWithinPartitions("n").select("value").write.text(path)
    return path


def cells(*cols: str, sep: str = ", ") -> Column:
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_with_header(spark, d) -> DataFrame:
    n = load(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = place(spark, "nation")
    writers.csv(n, path)
    return readers.csv(spark, path, schema=n.schema)


@query("SELECT CAST(s_suppkey AS BIGINT) AS k, s_name AS name, s_acctbal AS bal FROM supplier")
def csv_without_header(spark, d) -> DataFrame:
    path = place(spark, "supplier")
    writers.csv(load(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path, header=False)
    got = readers.csv(spark, path, header=False, columns=["k", "name", "bal"])
    return got.select(F.col("k").cast("bigint").alias("k"), "name", F.col("bal").cast("double").alias("bal"))


@query("SELECT CAST(s_suppkey AS BIGINT) AS k, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS bal FROM supplier")
def csv_null_mark(spark, d) -> DataFrame:
    s = load(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal").cast("string")).otherwise("?").alias("bal"))
    path = place(spark, "supplier")
    writers.csv(s, path)
    return readers.csv(spark, path, schema="k bigint, bal double", null="?")


_NAMES = ["vec_id", *M.NUMS, "bene_race_cd", "sp_chf", "cc_group"]


def _classified(spark, d) -> str:
    p = M.patients(spark, d)
    sizes = ["-1", *["0" for _ in M.NUMS], "5", "2", "8"]
    return put_lines(spark, [", ".join(_NAMES), ", ".join(sizes), "cc_group"], p, "vec_id", cells(*_NAMES))


@query(f"WITH {M._P} SELECT row_number() OVER (ORDER BY vec_id) + 2 AS line, CAST(vec_id AS DOUBLE) AS vec_id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in M.NUMS)}, bene_race_cd, CAST(sp_chf AS VARCHAR) AS sp_chf, cc_group FROM p")
def classified_table(spark, d) -> DataFrame:
    """A table with domain sizes and the class's name below its header."""
    df, label = readers.classified_csv(spark, _classified(spark, d))
    assert label == "cc_group"
    return df.withColumnRenamed("_rid", "line")


@query(f"WITH {M._P} SELECT CAST(vec_id AS VARCHAR) AS vec_id, {', '.join(f'CAST(CAST({c} AS {k}) AS VARCHAR) AS {c}' for c, k in (('est_age_in_days', 'INTEGER'), ('claim_count', 'INTEGER')))}, cc_group FROM p")
def classified_table_of_categories(spark, d) -> DataFrame:
    df, _ = readers.classified_csv(spark, _classified(spark, d), categorical_only=True)
    return df.select("vec_id", "est_age_in_days", "claim_count", "cc_group")


@query("SELECT c_mktsegment AS segment, c_acctbal AS balance, CAST(c_nationkey AS DOUBLE) AS nation FROM customer")
def restricted_table(spark, d) -> DataFrame:
    """A table whose first row flags its columns; the flags and the names of the kept columns are files of their own, too."""
    flags = readers.restriction(spark, put_lines(spark, ["0,1,1"]))
    names = readers.header_names(spark, put_lines(spark, ["balance, nation"]))
    c = load(spark, d, "customer")
    path = put_lines(spark, [",".join(map(str, flags))], c, "c_custkey", cells("c_mktsegment", "c_acctbal", "c_nationkey", sep=","))
    return readers.restricted_csv(spark, path, names, keep_dropped="segment").drop("_rid")


_SETS = "SELECT n_regionkey AS r, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) AS items FROM nation"


def _regions(spark, d) -> DataFrame:
    return load(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("items"))


@query(f"SELECT items FROM ({_SETS} GROUP BY 1)")
def sparse_basket_file(spark, d) -> DataFrame:
    path = put_lines(spark, [], _regions(spark, d), "n_regionkey", F.concat_ws(", ", F.col("n_regionkey").cast("string"), F.transform("items", lambda x: x.cast("string"))))
    return readers.sparse_baskets(spark, path).select(F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query(f"SELECT CAST(r AS BIGINT) AS tid, items FROM ({_SETS} WHERE n_nationkey <> 7 GROUP BY 1)")
def dense_basket_file(spark, d) -> DataFrame:
    """Nations of regions as rows of 0 and 1, but one."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: F.array_contains("items", i).cast("int").cast("string"))
    path = put_lines(spark, [], _regions(spark, d), "n_regionkey", F.concat_ws(",", F.col("n_regionkey").cast("string"), bits))
    return readers.dense_baskets(spark, path, remove=[7]).select("tid", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query("SELECT CAST(n_nationkey AS INTEGER) AS id, n_name || ' ' || n_regionkey AS name FROM nation")
def item_dimension_file(spark, d) -> DataFrame:
    path = place(spark, "items")
    writers.csv(load(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").coalesce(1), path)
    return readers.item_names(spark, path, 0, ["n_name", "n_regionkey"])


@query("SELECT 'author=' || r_name AS author, n_name || chr(10) AS text, CAST(octet_length(encode(n_name)) + 1 AS BIGINT) AS dl FROM nation JOIN region ON n_regionkey = r_regionkey")
def text_folder(spark, d) -> DataFrame:
    """Texts in files below a folder for each author."""
    path = place(spark, "corpus")
    n = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("author"), "n_name", "n_nationkey")
    n.repartition(200, "n_nationkey").select("author", "n_name").write.option("maxRecordsPerFile", 1).partitionBy("author").text(path)
    return readers.text_files(spark, path).select("author", "text", F.col("dl").cast("bigint").alias("dl"))


@query("SELECT * FROM (VALUES ('the'), ('of'), ('and')) v(word)")
def stopword_file(spark, d) -> DataFrame:
    return readers.stopwords(spark, put_lines(spark, ["the", "", " of ", "and"]))


@query(models._WALK)
def tree_file(spark, d) -> DataFrame:
    """A tree written as JSON, read again and applied."""
    p = M.patients(spark, d)
    m = tree.c45(p, M.CATS, "cc_group", threshold=0.01, rid="vec_id")
    path = put_lines(spark, m.to_json("patients").split("\n"))
    back = tree.TreeModel.from_json("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    return back.transform(p).select("vec_id", "pred")


_PART_TF = "tok AS (SELECT p_partkey AS doc, unnest(string_split(lower(p_name), ' ')) AS term FROM part), tf AS (SELECT doc, term, count(*) AS f FROM tok GROUP BY 1, 2)"


def _part_tf(spark, d) -> DataFrame:
    return text.term_frequencies(load(spark, d, "part"), "p_partkey", "p_name", False)


@query(f"WITH {_PART_TF} SELECT CAST(doc AS VARCHAR) AS doc, term, f FROM tf")
def wide_vector_file(spark, d) -> DataFrame:
    """Term frequencies of the names of parts as a table with a column a word."""
    path = place(spark, "part_vectorized")
    writers.term_table(_part_tf(spark, d), path, wide=True)
    return readers.vectors_csv(spark, path)


@query(f"WITH {_PART_TF}, x AS (SELECT doc, term, f / max(f) OVER (PARTITION BY doc) * log2((SELECT count(*) FROM part) / count(*) OVER (PARTITION BY term)) AS w FROM tf) SELECT CAST(doc AS VARCHAR) AS doc, term, round(w, 7) AS w FROM x")
def vector_json_file(spark, d) -> DataFrame:
    path = place(spark, "vectors")
    writers.corpus_json(text.tf_idf(_part_tf(spark, d), load(spark, d, "part").count()), path)
    return readers.vectors_json(spark, path).select("doc", F.explode("terms").alias("term", "w")).withColumn("w", F.round("w", 7))


@query(f"WITH {_PART_TF.replace('FROM part)', 'FROM part WHERE p_partkey % 7 <> 0)')}, x AS (SELECT doc, term, f / max(f) OVER (PARTITION BY doc) * log2((SELECT count(DISTINCT doc) FROM tf) / count(*) OVER (PARTITION BY term)) AS w FROM tf) SELECT CAST(doc AS VARCHAR) AS doc, term, round(w, 7) AS w FROM x")
def corpus_without_documents(spark, d) -> DataFrame:
    """A corpus fitted on all names of parts, copied, every seventh taken out, written and read again."""
    whole = text.Corpus.fit(load(spark, d, "part"), "p_partkey", "p_name", stemmed=False)
    out = [r[0] for r in load(spark, d, "part").filter("p_partkey % 7 = 0").select("p_partkey").collect()]
    path = place(spark, "corpus")
    whole.copy().rm(out).to_json(path)
    return readers.vectors_json(spark, path).select("doc", F.explode("terms").alias("term", "w")).withColumn("w", F.round("w", 7))


@query("SELECT n_name AS n1, CAST(n_nationkey AS VARCHAR) AS v1, r_name AS n2, CAST(r_regionkey AS VARCHAR) AS v2 FROM nation JOIN region ON n_regionkey = r_regionkey")
def edge_file(spark, d) -> DataFrame:
    n = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.format_string('"%s" , %s, "%s" , %s', "n_name", F.col("n_nationkey").cast("string"), "r_name", F.col("r_regionkey").cast("string"))
    return readers.edge_list(spark, put_lines(spark, [], n, "n_nationkey", line))


@query("SELECT s_acctbal AS c0, CAST(s_nationkey AS DOUBLE) AS c1 FROM supplier")
def matrix_file(spark, d) -> DataFrame:
    path = put_lines(spark, [], load(spark, d, "supplier"), "s_suppkey", cells("s_acctbal", "s_nationkey", sep=" "))
    return readers.numeric_matrix(spark, path, sep=" ")


@query(f"WITH {M._R}, us AS (SELECT u, row_number() OVER (ORDER BY u) - 1 AS no FROM (SELECT DISTINCT u FROM r)), its AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS no FROM (SELECT DISTINCT i FROM r)) SELECT CAST(us.no AS INTEGER) AS user, CAST(its.no AS INTEGER) AS item, x AS rating FROM r JOIN us USING (u) JOIN its USING (i)")
def ratings_file(spark, d) -> DataFrame:
    """Ratings as a matrix whose first column is passed over and in which 99 marks a missing one."""
    r = M.brand_ratings(spark, d)
    items = [x[0] for x in r.select("item").distinct().orderBy("item").collect()]  # 25 brands
    wide = r.groupBy("user").pivot("item", items).agg(F.first("rating")).fillna(99.0).withColumn("_n", F.lit(0))
    return readers.ratings_matrix(spark, put_lines(spark, [], wide, "user", cells("_n", *items, sep=",")))


@query(M.SQL["pagerank_directed"].replace(" SELECT id, round(p, 8) AS pr FROM p10", " SELECT CAST(row_number() OVER (ORDER BY p DESC, id) AS INTEGER) AS rank, id, printf('%.4f', p) AS pr FROM p10"))
def rank_report_file(spark, d) -> DataFrame:
    """The report of ranks, written and taken apart again."""
    ranks, n = pagerank.pagerank(M.trade_edges(spark, d), d=0.85, max_iterations=10, tolerance=False)
    return _table_of(spark, writers.rank_report(ranks, n, 1.0, 2.0), ["rank", "id", "pr"]).withColumn("rank", F.col("rank").cast("int"))


def _table_of(spark, report, names: list[str]) -> DataFrame:
    """The rows of the table with the given header in a report."""
    lines = [line for part in report for line in part.split("\n")]
    at = next(i for i, line in enumerate(lines) if line.split() == names)
    rows = [tuple(line.split()) for line in lines[at + 1 :]]
    rows = rows[: next((i for i, r in enumerate(rows) if len(r) != len(names)), len(rows))]
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


@query(models._LISTED.join(["WITH ", " SELECT CAST(u AS VARCHAR) AS user, i AS item, printf('%.4f', rating) AS rating, printf('%.4f', pred) AS pred FROM j"]))
def recommender_report_file(spark, d) -> DataFrame:
    from minespark.operators import recommend

    r = M.brand_ratings(spark, d)
    e = recommend.evaluate_list(r, recommend.sample_cells(r, 60, seed=4), "user-adjusted-weighted-sum")
    return _table_of(spark, writers.recommender_report(e), ["user", "item", "rating", "pred"])


@query(M._KM + " SELECT CAST(CAST(c AS INTEGER) AS VARCHAR) AS cluster, CAST(count(*) AS VARCHAR) AS n, printf('%.4f', min(e)) AS min_err, printf('%.4f', max(e)) AS max_err FROM (SELECT a.c, sqrt((a.x - c.x)**2 + (a.y - c.y)**2) AS e FROM a2 a JOIN c2 c ON a.c = c.c) GROUP BY 1")
def cluster_report_file(spark, d) -> DataFrame:
    from minespark.operators import clustering

    m = clustering.kmeans(M._customer_points(spark, d), 3, start=[[-1.0, -1.0], [1.0, -1.0], [0.0, 1.0]], max_iterations=3)
    report = writers.cluster_report(clustering.cluster_stats(m.assigned), m.centroids)
    return _table_of(spark, [report], ["cluster", "n", "min_err", "max_err", "avg_err", "sse"]).drop("avg_err", "sse")


@query(f"WITH {models._TREE}, {models.walk_sql('one', M.CATS, len(M.CATS))}, j AS (SELECT cc_group = pred AS hit FROM judged JOIN p ON vec_id = id) SELECT count(*) AS classified, count(*) FILTER (hit) AS correct, count(*) FILTER (NOT hit) AS incorrect FROM j")
def classification_report_file(spark, d) -> DataFrame:
    p = M.patients(spark, d)
    got = tree.c45(p, M.CATS, "cc_group", threshold=0.01, rid="vec_id").transform(p)
    report = writers.classification_report(got, "cc_group", "pred", "C4.5")
    said = dict(line.split(": ") for line in report.split("\n") if ": " in line)
    return spark.createDataFrame([tuple(int(said[k]) for k in ("Records classified", "Correctly classified", "Incorrectly classified"))], "classified long, correct long, incorrect long")


@query(f"WITH {M._NN}, c AS (SELECT q, label, count(*) AS n FROM r WHERE rank <= 5 GROUP BY 1, 2) SELECT q AS doc, e.label AS obs, first(c.label ORDER BY n DESC, c.label) AS pred FROM c JOIN e ON q = vec_id GROUP BY 1, 2")
def prediction_file(spark, d) -> DataFrame:
    """Predictions as a CSV of document, observed and predicted label."""
    near, e = M._near(spark, d, 5)
    from minespark.operators import neighbours

    path = place(spark, "knn_pred")
    writers.csv(neighbours.classify(near, 5).join(e.select(F.col("vec_id").alias("query"), F.col("label").alias("obs")), "query").select(F.col("query").alias("doc"), "obs", "pred"), path)
    return readers.csv(spark, path, schema="doc bigint, obs string, pred string")


@query(f"WITH {models._NATIONS}, {models.merges_sql('average')} SELECT round(height, 7) AS height FROM ({models._MERGES})")
def dendrogram_file(spark, d) -> DataFrame:
    """The heights of the inner nodes of a dendrogram written as JSON."""
    rows, t = models.nation_tree(spark, d, "average")
    path = put_lines(spark, t.to_json([tuple(r) for r in rows]).split("\n"))
    h = spark.read.text(path, wholetext=True).select(F.explode(F.expr("""regexp_extract_all(value, '"type": "(?:root|node)",\\\\s*"height": ([0-9.eE+-]+)', 1)""")).alias("h"))
    return h.select(F.round(F.col("h").cast("double"), 7).alias("height"))


@query(models.SQL["rule_texts"])
def rule_file(spark, d) -> DataFrame:
    """Rules with names of items, as lines of a file."""
    sets, total = assoc.frequent_itemsets(M.brand_baskets(spark, d), M.MIN_SUPPORT)
    names = sets.filter(F.size("items") == 1).select(F.element_at("items", 1).alias("id"), F.element_at("items", 1).alias("name"))
    path = place(spark, "rules")
    assoc.rule_text(assoc.rules(sets, total, M.MIN_CONFIDENCE, assoc.maximal_itemsets(sets)), materialize(names)).select("text").write.text(path)
    return spark.read.text(path).withColumnRenamed("value", "text")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM customer")
def report_of_folds(spark, d) -> DataFrame:
    """The rows a report of folds counts."""
    c = load(spark, d, "customer").select((F.col("c_custkey") % 3 + 1).alias("fold"), F.col("c_mktsegment").alias("obs"), F.lit("BUILDING").alias("pred"))
    n = evaluate.overall(c).first()["n"]
    assert f"Records classified: {n}" in writers.fold_report(c)
    return spark.createDataFrame([(n,)], "n long")
