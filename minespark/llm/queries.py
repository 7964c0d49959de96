"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minespark.functions.keys import name_key
from minespark.llm import knn, langid, mcl, mixing, packing, tokens
from minespark.operators import prep
from minespark.scratch import materialize
from minespark.tables import load, load_spread


def p10_model(spark: SparkSession, sf_dir: str) -> langid.Model:
    return langid.fit(*langid.training_sample(load(spark, sf_dir, "documents"), "text", "lang"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_spread(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("said", langid.label_code(F.col("lang")))
    got = langid.languages_of(docs, "doc_id", "text", p10_model(spark, sf_dir), carry="said")
    return got.filter(~F.col("lang_code").eqNullSafe(F.col("said"))).select("doc_id", "lang_code").distinct()


def p10_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.segments_of(load_spread(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", p10_model(spark, sf_dir))


# -- nearest vectors -------------------------------------------------------

# What a feature is divided by, and the features of which only equality counts.
KNN_SCALED = {"est_age_in_days": 3650.0, "clm_pmt_amt": 10000.0, "claim_count": 2.0}
KNN_KINDS = ("bene_race_cd", "bene_sex_ident_cd", "sp_alzhdmta", "sp_chf", "sp_chrnkidn", "sp_cncr", "sp_copd", "sp_osteoprs", "sp_ra_oa", "sp_strketia")


def knn_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, v): scaled numbers, then sqrt(1/2) at the place of each kind's value, so two differing values are 1 apart in squared distance.

    One row per vec_id (of rows that differ the first by their features); rows with a NULL feature are left out.
    """
    raw = load(spark, sf_dir, "bene_knn").select("vec_id", *KNN_SCALED, *KNN_KINDS).dropna()
    rows = raw.groupBy("vec_id").agg(F.min(F.struct(*KNN_SCALED, *KNN_KINDS)).alias("x")).select("vec_id", "x.*")
    levels = prep.levels(rows.select(*[F.col(c).cast("string").alias(c) for c in KNN_KINDS]), KNN_KINDS, most=64)
    half = 0.5**0.5
    dims = [(F.col(c) / F.lit(s)).cast("double") for c, s in KNN_SCALED.items()]
    for c in KNN_KINDS:
        values = levels[c]
        dims += [F.when(F.col(c).cast("string") == v, F.lit(half)).otherwise(F.lit(0.0)) for v in values] if len(values) != 2 else [(F.col(c).cast("string") == values[1]).cast("double")]
    return rows.select("vec_id", F.array(*dims).alias("v"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = knn.knn(knn_vectors(spark, sf_dir), "vec_id", "v", k=5)  # exact: widened until the queue proves it
    pairs = near.select("id", F.explode("neighbours.id").alias("other"))
    return pairs.select(F.least("id", "other").alias("vec_id_a"), F.greatest("id", "other").alias("vec_id_b")).distinct()


def p6_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a search calibrated to a recall of 0.95 finds 0.9 of the true neighbours of every 20th vector, measured against all vectors."""
    v = materialize(knn_vectors(spark, sf_dir))
    got = knn.measured_recall(knn.knn(v, "vec_id", "v", k=5, recall=0.95), v, "vec_id", "v", F.col("vec_id") % 20 == 0)
    return got.select("n_queries", "n_true", (F.col("n_found") >= 0.9 * F.col("n_true")).alias("reached"))


_DIFF = " + ".join(f"(a.{c} <> b.{c})::INT" for c in KNN_KINDS)
P6_SQL = f"""WITH v AS (SELECT DISTINCT vec_id, {", ".join(KNN_SCALED)}, {", ".join(KNN_KINDS)} FROM bene_knn
  WHERE {" AND ".join(f"{c} IS NOT NULL" for c in (*KNN_SCALED, *KNN_KINDS))}),
d AS (SELECT a.vec_id AS x, b.vec_id AS y,
  round({" + ".join(f"power((a.{c} - b.{c}) / {s}, 2)" for c, s in KNN_SCALED.items())} + {_DIFF}, 12) AS d2
  FROM v a JOIN v b ON a.vec_id <> b.vec_id),
n AS (SELECT x, y FROM d QUALIFY row_number() OVER (PARTITION BY x ORDER BY d2, y) <= 5)
SELECT DISTINCT least(x, y) AS vec_id_a, greatest(x, y) AS vec_id_b FROM n"""

P6_RECALL_SQL = P6_SQL[: P6_SQL.index(",\nd AS")] + """, n AS (SELECT count(DISTINCT vec_id) AS n, count(DISTINCT CASE WHEN vec_id % 20 = 0 THEN vec_id END) AS q FROM v)
SELECT q AS n_queries, q * least(5, n - 1) AS n_true, TRUE AS reached FROM n"""

# -- similarity clusters ---------------------------------------------------


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, _ = mcl.link_clusters(load(spark, sf_dir, "economy"), "econ_id", "c0", "c1", eps=1.0)
    m = mcl.cluster_members(points)
    return m.filter(F.col("cluster") != F.col("id")).select(F.col("cluster").alias("econ_id_a"), F.col("id").alias("econ_id_b"))


def p7_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each cluster, named by its smallest member."""
    points, _ = mcl.link_clusters(load(spark, sf_dir, "economy"), "econ_id", "c0", "c1", eps=1.0)
    return mcl.cluster_members(points).filter("id = cluster").select("cluster", "n")


def p7_typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and the three most typical members of each cluster."""
    points, of_cell = mcl.link_clusters(load(spark, sf_dir, "economy"), "econ_id", "c0", "c1", eps=1.0)
    return mcl.typical_members(mcl.cluster_members(points), of_cell).select("cluster", "n", F.array_join(F.transform("typical", lambda x: x.cast("string")), " ").alias("typical"))


_P7 = """WITH RECURSIVE p AS (SELECT DISTINCT econ_id AS id, c0 AS x, c1 AS y, floor(c0) AS gx, floor(c1) AS gy FROM economy WHERE c0 IS NOT NULL AND c1 IS NOT NULL),
g AS (SELECT p.*, gx + dx AS hx, gy + dy AS hy FROM p, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) b(dy)),
e AS (SELECT a.id AS u, b.id AS v FROM g a JOIN p b ON a.hx = b.gx AND a.hy = b.gy WHERE a.id <> b.id AND power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 1 + 1e-9),
c(u, root) AS (SELECT id, id FROM p UNION SELECT e.v, c.root FROM c JOIN e ON c.u = e.u WHERE c.root < e.v),
m AS (SELECT u AS id, min(root) AS root FROM c GROUP BY u)
"""
P7_SQL = _P7 + "SELECT root AS econ_id_a, id AS econ_id_b FROM m WHERE id <> root AND root IN (SELECT root FROM m GROUP BY root HAVING count(*) >= 3)"

# -- containers and mixtures -----------------------------------------------


def document_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source and tokens of every document, written once."""
    return materialize(tokens.token_counts(load_spread(spark, sf_dir, "documents", "doc_id", "source", "text"), "text", ["doc_id", "source"]))


def document_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``document_tokens``, measured in bytes, which SQL can measure too."""
    return load(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("tokens"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(document_tokens(spark, sf_dir), load(spark, sf_dir, "container_kind"), "doc_id", "tokens", "kind_id", "capacity_tokens")
    return packed.withColumnRenamed("item_id", "doc_id")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p8_containers(spark, sf_dir), load(spark, sf_dir, "container_kind"), "kind_id", "capacity_tokens")


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of all containers, measured in bytes: items, pieces and bytes of each kind, containers over their capacity, and items cut although they fit."""
    kinds = materialize(load(spark, sf_dir, "container_kind").select("kind_id", (F.col("capacity_tokens") * 4).alias("room")))
    packed = materialize(packing.pack(document_bytes(spark, sf_dir), kinds, "doc_id", "tokens", "kind_id", "room"))
    bins = packed.groupBy("kind_id", "bin").agg(F.sum("n_tokens").alias("used")).join(F.broadcast(kinds), "kind_id").groupBy("kind_id").agg(F.count_if(F.col("used") > F.col("room")).alias("over"))  # four kinds
    items = packed.groupBy("kind_id", "item_id").agg(F.count("*").alias("c"), F.sum("n_tokens").alias("size"))
    items = items.join(F.broadcast(kinds), "kind_id").groupBy("kind_id").agg(F.count("*").alias("n_items"), F.sum("c").alias("n_pieces"), F.sum("size").alias("n_bytes"), F.count_if((F.col("c") > 1) & (F.col("size") <= F.col("room"))).alias("cut"))
    return items.join(bins, "kind_id").select(F.col("kind_id").cast("bigint").alias("kind_id"), "n_items", "n_pieces", "n_bytes", "over", "cut")


P8_PIECES_SQL = """WITH s AS (SELECT coalesce(octet_length(encode(text)), 0) AS size FROM documents WHERE doc_id IS NOT NULL), k AS (SELECT kind_id, capacity_tokens * 4 AS room FROM container_kind)
SELECT CAST(kind_id AS BIGINT) AS kind_id, count(*) AS n_items, CAST(sum(greatest(1, ceil(size / room))) AS BIGINT) AS n_pieces, CAST(sum(size) AS BIGINT) AS n_bytes, CAST(0 AS BIGINT) AS over, CAST(0 AS BIGINT) AS cut FROM s, k GROUP BY 1"""


def _targets(spark: SparkSession, sf_dir: str) -> dict[str, tuple[float, int]]:
    """Share and most repeats of each target source; shares of several spellings add up, and the greatest repeat holds."""
    t = load(spark, sf_dir, "mix_target").select(name_key(F.col("source")).alias("s"), "target_share", "max_repeat").dropna()
    got = t.groupBy("s").agg(F.sum("target_share").alias("share"), F.max("max_repeat").alias("most")).limit(10_001).collect()
    if len(got) > 10_000:
        raise ValueError("more than 10,000 target sources")
    return {r["s"]: (r["share"], r["most"]) for r in got}


def _mix(spark: SparkSession, sf_dir: str):
    targets = _targets(spark, sf_dir)
    docs = document_tokens(spark, sf_dir).withColumn("source", name_key(F.col("source")))
    items = materialize(mixing.of_sources(mixing.hashed(docs, "doc_id", "source", "tokens"), targets))
    return items, mixing.plan_mix(items, targets)


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the mix, measured in tokens: each source's due share, that it is not exceeded, that it is reached as nearly as can be (no document left out fits what is missing), and that no document is repeated too often."""
    items, plans = _mix(spark, sf_dir)
    got = {r["source"]: r for r in mixing.shares(mixing.mix(items, plans), plans).collect()}  # one row a target
    short = mixing.still_fitting(items, plans, {s: r["tokens"] for s, r in got.items()})
    due = sum(p.share for p in plans if p.available)
    rows = [(p.source, round(p.share / due, 9), bool(got[p.source]["tokens"] <= p.wanted + 1e-6), p.source not in short, bool(got[p.source]["max_copies"] <= p.max_repeat)) for p in plans if p.available]
    return spark.createDataFrame(rows, "source string, due_share double, not_over boolean, reached boolean, repeats_kept boolean")


_NAME = r"nullif(regexp_replace(regexp_replace(lower(source), '[\s\x{00a0}\x{feff}_\-\x{2010}-\x{2015}]+', '_', 'g'), '^_+|_+$', '', 'g'), '')"
P9_KEPT_SQL = f"""WITH t AS (SELECT {_NAME} AS s, sum(target_share) AS share FROM mix_target WHERE target_share IS NOT NULL AND max_repeat IS NOT NULL GROUP BY 1), h AS (SELECT {_NAME} AS s, sum(octet_length(encode(text))) AS b FROM documents WHERE doc_id IS NOT NULL GROUP BY 1)
SELECT s AS source, round(share / sum(share) OVER (), 9) AS due_share, TRUE AS not_over, TRUE AS reached, TRUE AS repeats_kept FROM t JOIN h USING (s) WHERE b > 0"""


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, plans = _mix(spark, sf_dir)
    return mixing.mix(items, plans).withColumnRenamed("item_id", "doc_id")


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, plans = _mix(spark, sf_dir)
    return mixing.shares(mixing.mix(items, plans), plans)


QUERIES = {
    "p6_found": p6_found,
    "p6_recall": p6_recall,
    "p7_found": p7_found,
    "p7_clusters": p7_clusters,
    "p7_typical": p7_typical,
    "p8_containers": p8_containers,
    "p8_report": p8_report,
    "p8_pieces": p8_pieces,
    "p9_mixture": p9_mixture,
    "p9_report": p9_report,
    "p9_kept": p9_kept,
    "p10_found": p10_found,
    "p10_segments": p10_segments,
}
SQL: dict[str, str] = {"p8_pieces": P8_PIECES_SQL, "p9_kept": P9_KEPT_SQL, "p6_found": P6_SQL, "p6_recall": P6_RECALL_SQL, "p7_found": P7_SQL, "p7_clusters": _P7 + "SELECT root AS cluster, count(*) AS n FROM m GROUP BY 1 HAVING count(*) >= 3"}
