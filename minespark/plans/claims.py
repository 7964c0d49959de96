"""Queries of the claims and beneficiary tables (problems 1 to 5 but the nested one) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minespark.functions import keys as K
from minespark.operators import features, history, references, snapshots
from minespark.operators.rows import latest_rows
from minespark.tables import load

STATUS = ("sp_alzhdmta", "sp_chf", "sp_chrnkidn", "sp_cncr", "sp_copd", "sp_depressn", "sp_diabetes", "sp_ischmcht", "sp_osteoprs", "sp_ra_oa", "sp_strketia")
WINDOWS = (90, 365)


def clean_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per claim that counts: clm_id, k (key number), drg, day, clm_pmt_amt."""
    raw = load(spark, sf_dir, "inpatient_claim").select(
        "clm_id",
        "load_ts",
        "claim_count",
        K.hex_number(F.col("desynpuf_id")).alias("k"),
        K.code_number(F.col("clm_drg_cd")).alias("drg"),
        K.int_date(F.col("clm_from_dt")).alias("day"),
        "clm_pmt_amt",
    )
    return features.resolve_versions(raw, "clm_id", "load_ts", "claim_count", ["k", "drg", "day", "clm_pmt_amt"])


def claim_features(spark: SparkSession, sf_dir: str, windows=WINDOWS, as_of: str | None = None) -> DataFrame:
    cum = features.cumulative_table(clean_claims(spark, sf_dir), "k", "drg", "day", "clm_pmt_amt")
    return features.as_of_features(cum, "k", "drg", as_of, windows)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = claim_features(spark, sf_dir, windows=())
    return f.filter(F.col("n") >= 2).select(K.hex_text(F.col("k")).alias("desynpuf_id"), K.code_text(F.col("drg")).alias("clm_drg_cd"))


def p1_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table in long form, as of the end of 2013."""
    f = claim_features(spark, sf_dir, as_of="2013-12-31")
    return f.select(
        K.hex_text(F.col("k")).alias("desynpuf_id"),
        K.code_text(F.col("drg")).alias("clm_drg_cd"),
        "n",
        F.col("total").cast("double").alias("total"),
        "recency_days",
        *[c for w in WINDOWS for c in (f"n_{w}d", F.col(f"total_{w}d").cast("double").alias(f"total_{w}d"))],
    )


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per beneficiary; ``by_kind`` is given as text: code, number, total and recency of each code."""
    f = claim_features(spark, sf_dir, windows=(), as_of="2013-12-31").withColumn("drg", K.code_text(F.col("drg")))
    rows = features.feature_rows(f, "k", "drg")
    kinds = F.transform(F.map_entries("by_kind"), lambda e: F.concat_ws(":", e["key"], e["value"]["n"].cast("string"), e["value"]["total"].cast("string"), e["value"]["recency_days"].cast("string")))
    return rows.select(K.hex_text(F.col("k")).alias("desynpuf_id"), "n_kinds", "n", F.col("total").cast("double").alias("total"), "last_day", F.array_join(kinds, "|").alias("by_kind"))


def p1_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per beneficiary with three columns for each of the hundreds of codes of ``drg_ref``: n_<code>, total_<code> and recency_days_<code>."""
    codes = [r[0] for r in load(spark, sf_dir, "drg_ref").select(K.code_text(K.code_number(F.col("clm_drg_cd"))).alias("c")).distinct().orderBy("c").limit(10_000).collect()]
    f = claim_features(spark, sf_dir, windows=(), as_of="2013-12-31").withColumn("drg", K.code_text(F.col("drg")))
    rows = features.feature_columns(f, "k", "drg", codes)
    return rows.select(K.hex_text(F.col("k")).alias("desynpuf_id"), *[F.col(c).cast("double").alias(c) for c in rows.columns if c != "k"])


def p1_column_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table folded again: for each code the beneficiaries that have it, their claims and payments, and the least recency."""
    wide = p1_columns(spark, sf_dir)
    codes = sorted({c[2:] for c in wide.columns if c.startswith("n_")})
    cells = F.array(*[F.struct(F.lit(c).alias("clm_drg_cd"), F.col(f"n_{c}").alias("n"), F.col(f"total_{c}").alias("total"), F.col(f"recency_days_{c}").alias("r")) for c in codes])
    long = wide.select(F.explode(F.filter(cells, lambda x: x["n"] > 0)).alias("x")).select("x.*")
    total = F.sum(F.col("total").cast("decimal(28,2)")).cast("double")
    return long.groupBy("clm_drg_cd").agg(F.count("*").alias("n_entities"), F.sum("n").cast("bigint").alias("n"), total.alias("total"), F.min("r").cast("int").alias("recency_days"))


def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per beneficiary and year, the last delivered one: k, y, birth date, sex, race and sp_ flags (odd 1, even 0)."""
    raw = load(spark, sf_dir, "bene_snapshot").select(
        K.hex_number(F.col("desynpuf_id")).alias("k"),
        K.calendar_year(F.col("bene_year")).alias("y"),
        "delivered_ts",
        "bene_birth_dt",
        "bene_sex_ident_cd",
        "bene_race_cd",
        *[K.odd_flag(F.col(c)).alias(c) for c in STATUS],
    )
    keep = ["bene_birth_dt", "bene_sex_ident_cd", "bene_race_cd", *STATUS]
    return latest_rows(raw.filter(F.col("k").isNotNull() & F.col("y").isNotNull()), ["k", "y"], ["delivered_ts"], keep)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = load(spark, sf_dir, "bene_snapshot").select(
        K.hex_number(F.col("desynpuf_id")).alias("k"), K.calendar_year(F.col("bene_year")).alias("y"), "delivered_ts", K.odd_flag(F.col("sp_diabetes")).alias("sp_diabetes")
    )
    snap = latest_rows(raw.filter(F.col("k").isNotNull() & F.col("y").isNotNull()), ["k", "y"], ["delivered_ts"], ["sp_diabetes"])
    v = history.versions(snap, "k", "y", "sp_diabetes")
    return v.filter(F.col("n_versions") >= 2).select(K.hex_text(F.col("k")).alias("desynpuf_id"), "valid_from", "valid_to")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = snapshot_rows(spark, sf_dir)
    d = snapshots.snapshot_diff(snap, "k", "y", ["bene_birth_dt", "bene_sex_ident_cd", "bene_race_cd", *STATUS])
    return d.select(K.hex_text(F.col("k")).alias("desynpuf_id"), F.col("y").alias("bene_year"), "change_kind")


def found_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = load(spark, sf_dir, "inpatient_claim").select(
        F.lit("inpatient_claim").alias("ref_table"), F.floor(F.col("clm_from_dt") / 10000).cast("bigint").alias("ref_year"), F.col("clm_id").alias("ref_key"), K.hex_number(F.col("desynpuf_id")).alias("k")
    )
    knn = load(spark, sf_dir, "bene_knn").select(
        F.lit("bene_knn").alias("ref_table"), F.col("bene_year").cast("bigint").alias("ref_year"), F.col("vec_id").alias("ref_key"), K.hex_number(F.col("desynpuf_id")).alias("k")
    )
    parents = load(spark, sf_dir, "bene_snapshot").select(K.hex_number(F.col("desynpuf_id")).alias("k"), K.calendar_year(F.col("bene_year")).cast("bigint").alias("ref_year"))
    found = references.orphans(claims.unionByName(knn), parents, "k", "ref_year")
    return found.select("ref_table", "ref_year", "ref_key", "reason").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_orphans(spark, sf_dir)


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.orphan_report(found_orphans(spark, sf_dir), "ref_table", "ref_year")


# -- SQL -------------------------------------------------------------------

_KEY = r"""CASE WHEN regexp_matches(regexp_replace({c}, '[\s"''_:-]', '', 'g'), '^0*[0-9A-Fa-f]{{1,16}}$')
 THEN lpad(upper(regexp_replace(regexp_replace({c}, '[\s"''_:-]', '', 'g'), '^0+(.)', '\1')), 16, '0') END"""
_DRG = r"""lpad(nullif(regexp_extract(upper(trim(clm_drg_cd)), '^(DRG)?\s*0*([0-9]{1,3})(\.0*)?$', 2), ''), 3, '0')"""
_YEAR = "CAST(regexp_extract(bene_year, '(20[0-9]{2})', 1) AS BIGINT)"


def _key(c: str = "desynpuf_id") -> str:
    return _KEY.format(c=c)


_CLAIMS = f"""claims AS (
  SELECT k, drg, day, amt FROM (
    SELECT {_key()} AS k, {_DRG} AS drg, strptime(CAST(clm_from_dt AS VARCHAR), '%Y%m%d')::DATE AS day, clm_pmt_amt AS amt,
           min(coalesce(claim_count, 0)) OVER (PARTITION BY clm_id) AS least,
           row_number() OVER (PARTITION BY clm_id ORDER BY load_ts DESC NULLS LAST, {_key()} DESC NULLS LAST, {_DRG} DESC NULLS LAST, clm_from_dt DESC, clm_pmt_amt DESC NULLS LAST) AS rn
    FROM inpatient_claim WHERE clm_id IS NOT NULL)
  WHERE least >= 0 AND rn = 1 AND k IS NOT NULL AND drg IS NOT NULL)"""

_SNAP = f"""snap AS (
  SELECT * FROM (
    SELECT {_key()} AS k, {_YEAR} AS y, bene_birth_dt, bene_sex_ident_cd, bene_race_cd, {", ".join(f"{c} % 2 AS {c}" for c in STATUS)},
           row_number() OVER (PARTITION BY {_key()}, {_YEAR} ORDER BY delivered_ts DESC NULLS LAST) AS rn
    FROM bene_snapshot) WHERE rn = 1 AND k IS NOT NULL)"""

_ORPHANS = f"""life AS (SELECT {_key()} AS k, min({_YEAR}) AS y0, max({_YEAR}) AS y1 FROM bene_snapshot GROUP BY 1),
refs AS (
  SELECT DISTINCT 'inpatient_claim' AS ref_table, CAST(clm_from_dt // 10000 AS BIGINT) AS ref_year, clm_id AS ref_key, {_key()} AS k FROM inpatient_claim
  UNION SELECT 'bene_knn', CAST(bene_year AS BIGINT), vec_id, {_key()} FROM bene_knn),
found AS (
  SELECT DISTINCT ref_table, ref_year, ref_key, CASE WHEN y0 IS NULL THEN 'missing' WHEN y1 < ref_year THEN 'deleted' ELSE 'later' END AS reason
  FROM refs LEFT JOIN life USING (k) WHERE k IS NOT NULL AND (y0 IS NULL OR ref_year NOT BETWEEN y0 AND y1))"""

QUERIES = {"p1_found": p1_found, "p1_features": p1_features, "p1_entities": p1_entities, "p1_columns": p1_columns, "p1_column_sums": p1_column_sums, "p2_found": p2_found, "p3_found": p3_found, "p5_found": p5_found, "p5_report": p5_report}

SQL = {
    "p1_found": f"WITH {_CLAIMS} SELECT k AS desynpuf_id, drg AS clm_drg_cd FROM claims GROUP BY 1, 2 HAVING count(*) >= 2",
    "p1_features": f"""WITH {_CLAIMS}
SELECT k AS desynpuf_id, drg AS clm_drg_cd, count(*) AS n, CAST(sum(CAST(coalesce(amt, 0) AS DECIMAL(18,2))) AS DOUBLE) AS total,
  CAST(date_diff('day', max(day), DATE '2013-12-31') AS INTEGER) AS recency_days,
  {", ".join(f"CAST(count(*) FILTER (day > DATE '2013-12-31' - {w}) AS BIGINT) AS n_{w}d, CAST(coalesce(sum(CAST(coalesce(amt, 0) AS DECIMAL(18,2))) FILTER (day > DATE '2013-12-31' - {w}), 0) AS DOUBLE) AS total_{w}d" for w in WINDOWS)}
FROM claims WHERE day IS NULL OR day <= DATE '2013-12-31' GROUP BY 1, 2""",
    "p1_entities": f"""WITH {_CLAIMS}, f AS (SELECT k, drg, count(*) AS n, sum(CAST(coalesce(amt, 0) AS DECIMAL(18,2))) AS total, max(day) AS last_day FROM claims WHERE day IS NULL OR day <= DATE '2013-12-31' GROUP BY 1, 2)
SELECT k AS desynpuf_id, count(*) AS n_kinds, CAST(sum(n) AS BIGINT) AS n, CAST(sum(total) AS DOUBLE) AS total, max(last_day) AS last_day,
  string_agg(concat_ws(':', drg, CAST(n AS VARCHAR), CAST(total AS VARCHAR), CAST(date_diff('day', last_day, DATE '2013-12-31') AS VARCHAR)), '|' ORDER BY drg) AS by_kind FROM f GROUP BY 1""",
    "p1_columns": f"""WITH {_CLAIMS}, f AS (SELECT k, drg, count(*) AS n, sum(CAST(coalesce(amt, 0) AS DECIMAL(18,2))) AS total, max(day) AS last_day FROM claims WHERE day IS NULL OR day <= DATE '2013-12-31' GROUP BY 1, 2),
ref AS (SELECT DISTINCT {_DRG} AS code FROM drg_ref), g AS (SELECT * FROM f WHERE drg IN (SELECT code FROM ref)),
long AS (SELECT k, 'n_' || drg AS c, CAST(n AS DOUBLE) AS v FROM g UNION ALL SELECT k, 'total_' || drg, CAST(total AS DOUBLE) FROM g UNION ALL SELECT k, 'recency_days_' || drg, CAST(date_diff('day', last_day, DATE '2013-12-31') AS DOUBLE) FROM g
 UNION ALL SELECT NULL, p || code, NULL FROM ref, (SELECT unnest(['n_', 'total_', 'recency_days_']) AS p) UNION ALL SELECT k, 'n_' || (SELECT min(code) FROM ref), NULL FROM f)
SELECT k AS desynpuf_id, coalesce(COLUMNS('^(n|total)_'), 0), COLUMNS('^recency') FROM (PIVOT long ON c USING max(v) GROUP BY k) WHERE k IS NOT NULL""",
    "p1_column_sums": f"""WITH {_CLAIMS} SELECT drg AS clm_drg_cd, count(DISTINCT k) AS n_entities, count(*) AS n, CAST(sum(CAST(coalesce(amt, 0) AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(date_diff('day', max(day), DATE '2013-12-31') AS INTEGER) AS recency_days
FROM claims WHERE (day IS NULL OR day <= DATE '2013-12-31') AND drg IN (SELECT {_DRG} FROM drg_ref) GROUP BY 1""",
    "p2_found": f"""WITH {_SNAP},
runs AS (SELECT k, y, sp_diabetes AS v, y - row_number() OVER (PARTITION BY k ORDER BY y) AS run FROM snap),
filled AS (SELECT k, y, run, last_value(v IGNORE NULLS) OVER (PARTITION BY k, run ORDER BY y) AS v FROM runs),
marked AS (SELECT k, y, run, v, CASE WHEN lag(v) OVER (PARTITION BY k, run ORDER BY y) = v THEN 0 ELSE 1 END AS new FROM filled WHERE v IS NOT NULL),
numbered AS (SELECT k, y, sum(new) OVER (PARTITION BY k ORDER BY y) AS ver FROM marked),
vers AS (SELECT k, ver, CAST(min(y) AS BIGINT) AS valid_from, CAST(max(y) AS BIGINT) AS valid_to FROM numbered GROUP BY k, ver)
SELECT k AS desynpuf_id, valid_from, valid_to FROM vers WHERE k IN (SELECT k FROM vers GROUP BY k HAVING count(*) >= 2)""",
    "p3_found": f"""WITH {_SNAP},
years AS (SELECT min(y) AS y0, max(y) AS y1 FROM snap)
SELECT coalesce(a.k, b.k) AS desynpuf_id, CAST(coalesce(a.y, b.y + 1) AS BIGINT) AS bene_year,
  CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM snap a FULL JOIN snap b ON a.k = b.k AND a.y = b.y + 1, years
WHERE coalesce(a.y, b.y + 1) > y0 AND coalesce(a.y, b.y + 1) <= y1
  AND (a.k IS NULL OR b.k IS NULL OR {" OR ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in ("bene_birth_dt", "bene_sex_ident_cd", "bene_race_cd", *STATUS))})""",
    "p5_found": f"WITH {_ORPHANS} SELECT * FROM found",
    "p5_report": f"WITH {_ORPHANS} SELECT ref_table, ref_year, reason, count(*) AS n_orphans FROM found GROUP BY 1, 2, 3",
}
