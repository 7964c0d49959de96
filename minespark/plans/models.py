"""Queries of whole trees, forests, folds, samples and clusterings, with SQL that grows the same models level by level."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minespark.operators import assoc, bayes, clustering, evaluate, neighbours, prep, recommend, svm, text, tree
from minespark.plans import mining as M
from minespark.plans.claims import _SNAP, _key
from minespark.scratch import materialize
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


def lot_sql(seed: int, key: str) -> str:
    """``prep.lot`` in SQL."""
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 15))::BIGINT"


# -- trees of categorical attributes, grown in SQL ------------------------------


def tree_sql(rows: str, attrs: list[str], threshold: float, chosen: dict[int, list[str]] | None = None) -> str:
    """Common tables of the trees over ``rows`` (t, y and the attributes): n0, n1, ... the nodes and w0, w1, ... the winners of each level."""
    depth = max(map(len, chosen.values())) if chosen else len(attrs)
    sql = f"g0 AS MATERIALIZED (SELECT t, '' AS path, y, {', '.join(attrs)} FROM {rows})"
    if chosen:
        sql += ", allowed AS (SELECT * FROM (VALUES " + ", ".join(f"({t}, '{a}')" for t, mine in chosen.items() for a in mine) + ") v(t, attr))"
    for i in range(depth + 1):
        sql += f""", l{i} AS MATERIALIZED (SELECT t, path, y, count(*) AS n FROM g{i} GROUP BY ALL),
n{i} AS MATERIALIZED (SELECT t, path, first(y ORDER BY n DESC, y) AS dec, max(n) / sum(n) AS p, count(*) AS k, sum(n) AS tot, -sum(n * log2(n)) / sum(n) + log2(sum(n)) AS h FROM l{i} GROUP BY t, path)"""
        if i == depth:
            break
        long = " UNION ALL ".join(f"SELECT t, path, y, '{a}' AS attr, {j} AS pos, CAST({a} AS VARCHAR) AS v FROM g{i} WHERE NOT contains(path, '/{a}=')" for j, a in enumerate(attrs))
        sql += f""", u{i} AS MATERIALIZED (SELECT x.* FROM ({long}) x JOIN n{i} n ON n.t = x.t AND n.path = x.path AND n.k > 1{" JOIN allowed o ON o.t = x.t AND o.attr = x.attr" if chosen else ""}),
e{i} AS MATERIALIZED (SELECT c.t, c.path, attr, pos, round(any_value(h) + sum(c.n * log2(c.n / vn)) / any_value(tot), 12) AS g FROM (SELECT *, sum(n) OVER (PARTITION BY t, path, attr, v) AS vn FROM (SELECT t, path, attr, pos, v, y, count(*) AS n FROM u{i} GROUP BY ALL)) c JOIN n{i} n ON n.t = c.t AND n.path = c.path GROUP BY c.t, c.path, attr, pos),
w{i} AS MATERIALIZED (SELECT t, path, attr FROM (SELECT *, row_number() OVER (PARTITION BY t, path ORDER BY g DESC, pos) AS r FROM e{i} WHERE g > {threshold}) WHERE r = 1),
g{i + 1} AS MATERIALIZED (SELECT g.t, g.path || '/' || attr || '=' || (CASE attr {" ".join(f"WHEN '{a}' THEN CAST({a} AS VARCHAR)" for a in attrs)} END) AS path, y, {', '.join(attrs)} FROM g{i} g JOIN w{i} w ON w.t = g.t AND w.path = g.path)"""
    return sql


def walk_sql(asked: str, attrs: list[str], depth: int) -> str:
    """Common table ``judged`` (t, id, pred): the rows of ``asked`` (t, id and the attributes) moved down the trees."""
    sql = f"q0 AS MATERIALIZED (SELECT a.t, a.id, n.path, n.dec, {', '.join('a.' + x for x in attrs)} FROM {asked} a JOIN n0 n ON n.t = a.t)"
    for i in range(depth):
        value = f"(CASE w.attr {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN CAST(q.{a} AS VARCHAR)' for a in attrs)} END)"
        sql += f""", q{i + 1} AS MATERIALIZED (SELECT q.t, q.id, CASE WHEN n.path IS NOT NULL THEN n.path WHEN w.attr IS NOT NULL THEN q.path || '#' ELSE q.path END AS path, coalesce(n.dec, q.dec) AS dec, {', '.join('q.' + x for x in attrs)}
 FROM q{i} q LEFT JOIN w{i} w ON w.t = q.t AND w.path = q.path LEFT JOIN n{i + 1} n ON n.t = q.t AND n.path = q.path || '/' || w.attr || '=' || {value})"""
    return sql + f", judged AS MATERIALIZED (SELECT t, id, dec AS pred FROM q{depth})"


LEVELS = 30  # deeper than any tree of the test tables; levels without rows cost nothing


def mixed_tree_sql(rows: str, cats: list[str], nums: list[str], order: list[str], threshold: float, chosen: dict[int, list[str]] | None = None, levels: int = LEVELS) -> str:
    """As ``tree_sql`` over ``rows`` (t, y, rid and the attributes) with numeric attributes, too, which split in two any number of times; w0, w1, ... have an alpha."""
    cols = ", ".join([*cats, *nums])
    sql = f"g0 AS MATERIALIZED (SELECT t, '' AS path, y, rid, {cols} FROM {rows})"
    if chosen:
        sql += ", allowed AS (SELECT * FROM (VALUES " + ", ".join(f"({t}, '{a}')" for t, mine in chosen.items() for a in mine) + ") v(t, attr))"
    only = " JOIN allowed o ON o.t = x.t AND o.attr = x.attr" if chosen else ""

    def nlogn(c: str) -> str:
        return f"CASE WHEN {c} > 0 THEN {c} * log2({c}) ELSE 0 END"

    for i in range(levels):
        sql += f""", l{i} AS MATERIALIZED (SELECT t, path, y, count(*) AS n FROM g{i} GROUP BY ALL),
n{i} AS MATERIALIZED (SELECT t, path, first(y ORDER BY n DESC, y) AS dec, max(n) / sum(n) AS p, count(*) AS k, sum(n) AS tot, -sum(n * log2(n)) / sum(n) + log2(sum(n)) AS h FROM l{i} GROUP BY t, path)"""
        if i == levels - 1:
            break
        kinds = " UNION ALL ".join(f"SELECT t, path, y, '{a}' AS attr, {order.index(a)} AS pos, CAST({a} AS VARCHAR) AS v FROM g{i} WHERE NOT contains(path, '/{a}=')" for a in cats) or "SELECT t, path, y, '' AS attr, 0 AS pos, '' AS v FROM g0 WHERE FALSE"
        numbers = " UNION ALL ".join(f"SELECT t, path, y, rid, '{a}' AS attr, {order.index(a)} AS pos, CAST({a} AS DOUBLE) AS v FROM g{i}" for a in nums)
        side = " ".join(f"WHEN '{a}' THEN CASE WHEN g.{a} <= w.alpha THEN '<=' ELSE '>' END || CAST(w.alpha AS VARCHAR)" for a in nums) + " " + " ".join(f"WHEN '{a}' THEN '=' || CAST(g.{a} AS VARCHAR)" for a in cats)
        sql += f""", u{i} AS MATERIALIZED (SELECT x.* FROM ({kinds}) x JOIN n{i} n ON n.t = x.t AND n.path = x.path AND n.k > 1{only}),
e{i} AS MATERIALIZED (SELECT c.t, c.path, attr, pos, round(any_value(h) + sum(c.n * log2(c.n / vn)) / any_value(tot), 12) AS g FROM (SELECT *, sum(n) OVER (PARTITION BY t, path, attr, v) AS vn FROM (SELECT t, path, attr, pos, v, y, count(*) AS n FROM u{i} GROUP BY ALL)) c JOIN n{i} n ON n.t = c.t AND n.path = c.path GROUP BY c.t, c.path, attr, pos),
v{i} AS MATERIALIZED (SELECT x.t, x.path, x.attr, x.pos, x.v, x.y, count(*) AS n, min(x.rid) AS fr FROM ({numbers}) x JOIN n{i} n ON n.t = x.t AND n.path = x.path AND n.k > 1{only} GROUP BY ALL),
s{i} AS MATERIALIZED (SELECT t, path, attr, pos, v, fr, {nlogn('sum(le)')} - sum({nlogn('le')}) + {nlogn('sum(ln - le)')} - sum({nlogn('(ln - le)')}) AS w FROM (SELECT a.*, b.n AS ln, sum(coalesce(c.n, 0)) OVER (PARTITION BY a.t, a.path, a.attr, b.y ORDER BY a.v) AS le
 FROM (SELECT t, path, attr, pos, v, min(fr) AS fr FROM v{i} GROUP BY ALL) a JOIN l{i} b ON b.t = a.t AND b.path = a.path LEFT JOIN v{i} c ON c.t = a.t AND c.path = a.path AND c.attr = a.attr AND c.v = a.v AND c.y = b.y) GROUP BY ALL),
b{i} AS MATERIALIZED (SELECT s.t, s.path, attr, pos, v AS alpha, round(h - w / tot, 12) AS g, row_number() OVER (PARTITION BY s.t, s.path, attr ORDER BY round(h - w / tot, 12) DESC, fr) AS r FROM s{i} s JOIN n{i} n ON n.t = s.t AND n.path = s.path WHERE round(h - w / tot, 12) > {threshold}),
w{i} AS MATERIALIZED (SELECT t, path, attr, alpha FROM (SELECT *, row_number() OVER (PARTITION BY t, path ORDER BY g DESC, pos) AS r FROM (SELECT t, path, attr, pos, g, NULL::DOUBLE AS alpha FROM e{i} WHERE g > {threshold} UNION ALL SELECT t, path, attr, pos, g, alpha FROM b{i} WHERE r = 1)) WHERE r = 1),
g{i + 1} AS MATERIALIZED (SELECT g.t, g.path || '/' || attr || (CASE attr {side} END) AS path, y, rid, {', '.join('g.' + c for c in [*cats, *nums])} FROM g{i} g JOIN w{i} w ON w.t = g.t AND w.path = g.path)"""
    return sql


def mixed_walk_sql(asked: str, cats: list[str], nums: list[str], levels: int = LEVELS) -> str:
    """As ``walk_sql``, down the trees of ``mixed_tree_sql``."""
    cols = [*cats, *nums]
    side = " ".join(f"WHEN '{a}' THEN CASE WHEN q.{a} <= w.alpha THEN '<=' ELSE '>' END || CAST(w.alpha AS VARCHAR)" for a in nums) + " " + " ".join(f"WHEN '{a}' THEN '=' || CAST(q.{a} AS VARCHAR)" for a in cats)
    sql = f"q0 AS MATERIALIZED (SELECT a.t, a.id, n.path, n.dec, {', '.join('a.' + x for x in cols)} FROM {asked} a JOIN n0 n ON n.t = a.t)"
    for i in range(levels - 1):
        sql += f""", q{i + 1} AS MATERIALIZED (SELECT q.t, q.id, CASE WHEN n.path IS NOT NULL THEN n.path WHEN w.attr IS NOT NULL THEN q.path || '#' ELSE q.path END AS path, coalesce(n.dec, q.dec) AS dec, {', '.join('q.' + x for x in cols)}
 FROM q{i} q LEFT JOIN w{i} w ON w.t = q.t AND w.path = q.path LEFT JOIN n{i + 1} n ON n.t = q.t AND n.path = q.path || '/' || w.attr || (CASE w.attr {side} END))"""
    return sql + f", judged AS MATERIALIZED (SELECT t, id, dec AS pred FROM q{levels - 1})"


_A = M.CATS
_ONE = f"one AS (SELECT 0 AS t, vec_id AS id, cc_group AS y, {', '.join(_A)} FROM p)"
_TREE = f"{M._P}, {_ONE}, {tree_sql('one', _A, 0.01)}"


def paths(m: tree.TreeModel, number: int = 0) -> list[tuple]:
    """(path, var, decision, p) of every node: the path is told by attributes and values."""
    out = []
    for t, i, parent, op, value, var, decision, p, _ in m.node_rows():
        if t == number:
            out.append((i, parent, op, value, var, decision, p))
    at = {None: ("", None)}
    rows = []
    for i, parent, op, value, var, decision, p in out:
        path, above = at[parent]
        mine = path if parent is None else f"{path}/{above}{op}{value}"
        at[i] = (mine, var)
        rows.append((mine, var, decision, round(p, 8)))
    return rows


_EMPTY = " UNION ALL ".join(
    f"SELECT w.path || '/{a}=' || d.v, NULL, n.dec, n.p FROM w{i} w JOIN n{i} n ON n.path = w.path JOIN (SELECT DISTINCT CAST({a} AS VARCHAR) AS v FROM p) d ON w.attr = '{a}' WHERE w.path || '/{a}=' || d.v NOT IN (SELECT path FROM n{i + 1})" for i in range(len(_A)) for a in _A
)


@query(f"WITH {_TREE}, every AS ({' UNION ALL '.join(f'SELECT n.path, w.attr AS var, n.dec, n.p FROM n{i} n LEFT JOIN w{i} w ON w.path = n.path' if i < len(_A) else f'SELECT path, NULL, dec, p FROM n{i}' for i in range(len(_A) + 1))} UNION ALL {_EMPTY}) SELECT path, var, dec AS decision, round(p, 8) AS p FROM every")
def c45_paths(spark, d) -> DataFrame:
    """All nodes of the tree over the categories, grown by the level loop alone (no subtree is finished in one task)."""
    m = tree.c45(M.patients(spark, d), _A, "cc_group", threshold=0.01, rid="vec_id", local_rows=0)
    return spark.createDataFrame(paths(m), "path string, var string, decision string, p double")


_WALK = f"WITH {_TREE}, {walk_sql('one', _A, len(_A))} SELECT id AS vec_id, pred FROM judged"


@query(_WALK)
def c45_levels_predict(spark, d) -> DataFrame:
    p = M.patients(spark, d)
    return tree.c45(p, _A, "cc_group", threshold=0.01, rid="vec_id", local_rows=0).transform(p).select("vec_id", "pred")


@query(_WALK)
def c45_tasks_predict(spark, d) -> DataFrame:
    """As ``c45_levels_predict``, subtrees finished in tasks, the tree applied as an Arrow function."""
    p = M.patients(spark, d)
    return tree.c45(p, _A, "cc_group", threshold=0.01, rid="vec_id").transform(p, most_nodes=0).select("vec_id", "pred")


_ALL = [*M.NUMS, *M.CATS]
_MIXED = f"{M._P}, every AS (SELECT 0 AS t, vec_id AS id, vec_id AS rid, cc_group AS y, {', '.join(_ALL)} FROM p), {mixed_tree_sql('every', M.CATS, M.NUMS, _ALL, 0.01)}"
_MIXED_NODES = " UNION ALL ".join(f"SELECT n.path, w.attr AS var, n.dec, n.p FROM n{i} n LEFT JOIN w{i} w ON w.path = n.path" for i in range(LEVELS - 1))
_MIXED_EMPTY = " UNION ALL ".join(
    f"SELECT w.path || '/{a}=' || d.v, NULL, n.dec, n.p FROM w{i} w JOIN n{i} n ON n.path = w.path JOIN d_{a} d ON w.attr = '{a}' WHERE w.path || '/{a}=' || d.v NOT IN (SELECT path FROM n{i + 1})" for i in range(LEVELS - 1) for a in _A
)
_DOMAINS = ", ".join(f"d_{a} AS MATERIALIZED (SELECT DISTINCT CAST({a} AS VARCHAR) AS v FROM p)" for a in _A)


@query(f"WITH {_MIXED}, {_DOMAINS}, nodes AS ({_MIXED_NODES} UNION ALL {_MIXED_EMPTY}) SELECT path, var, dec AS decision, round(p, 8) AS p FROM nodes")
def c45_tree(spark, d) -> DataFrame:
    """All nodes of the tree over numbers and categories."""
    m = tree.c45(M.patients(spark, d), _ALL, "cc_group", threshold=0.01, rid="vec_id")
    return spark.createDataFrame(paths(m), "path string, var string, decision string, p double")


@query(f"WITH {_MIXED}, {mixed_walk_sql('every', M.CATS, M.NUMS)} SELECT id AS vec_id, cc_group AS obs, pred FROM judged JOIN p ON vec_id = id")
def c45_predict(spark, d) -> DataFrame:
    p = M.patients(spark, d)
    m = tree.c45(p, _ALL, "cc_group", threshold=0.01, rid="vec_id")
    return m.transform(p).select("vec_id", F.col("cc_group").alias("obs"), "pred")


@query(f"WITH {M._P} SELECT count(*) AS n, count(*) AS agree FROM p")
def c45_both_ways(spark, d) -> DataFrame:
    """Numeric and categorical attributes: rows, and those judged alike by the trees of the level loop and of the tasks."""
    p = M.patients(spark, d)
    at = [tree.c45(p, [*M.NUMS, *M.CATS], "cc_group", threshold=0.01, rid="vec_id", max_depth=6, local_rows=n) for n in (0, tree.LOCAL_ROWS)]
    both = at[1].transform(at[0].transform(p, "a"), "b")
    same = sorted(paths(at[0])) == sorted(paths(at[1]))
    return both.agg(F.count("*").alias("n"), F.count_if((F.col("a") == F.col("b")) & F.lit(same)).alias("agree"))


_FOLDS = f"f AS (SELECT *, ntile(5) OVER (ORDER BY {lot_sql(1, 'vec_id')}, vec_id) AS fold FROM p)"
_CV = f"""{M._P}, {_FOLDS}, train AS (SELECT x.t, vec_id AS id, cc_group AS y, {', '.join(_A)} FROM f, (SELECT unnest(range(1, 6)) AS t) x WHERE x.t <> fold),
asked AS (SELECT fold AS t, vec_id AS id, {', '.join(_A)} FROM f), {tree_sql('train', _A, 0.01)}, {walk_sql('asked', _A, len(_A))}"""


@query(f"WITH {_CV} SELECT id AS vec_id, CAST(t AS INTEGER) AS fold, cc_group AS obs, pred FROM judged JOIN p ON vec_id = id")
def c45_fold_predictions(spark, d) -> DataFrame:
    p = M.patients(spark, d)
    return tree.cross_validate(p, _A, "cc_group", prep.k_folds(p.select("vec_id"), "vec_id", 5, seed=1), "vec_id", threshold=0.01)


@query(f"WITH {_CV}, j AS (SELECT t, CAST(cc_group = pred AS DOUBLE) AS hit FROM judged JOIN p ON vec_id = id) SELECT round(avg(hit), 8) AS pooled_accuracy, (SELECT round(avg(a), 8) FROM (SELECT avg(hit) AS a FROM j GROUP BY t)) AS mean_accuracy FROM j")
def c45_cross_validation(spark, d) -> DataFrame:
    r = evaluate.fold_report(c45_fold_predictions(spark, d))
    return r.select(F.round("pooled_accuracy", 8).alias("pooled_accuracy"), F.round("mean_accuracy", 8).alias("mean_accuracy"))


_SMALL = "small AS (SELECT * FROM p ORDER BY vec_id LIMIT 40)"


def _leave_one_out(spark, d) -> DataFrame:
    p = M.patients(spark, d).orderBy("vec_id").limit(40)  # leaving one out is for small tables
    return tree.cross_validate(p, _A, "cc_group", prep.k_folds(p.select("vec_id"), "vec_id", p.count(), seed=1), "vec_id", threshold=0.01)


@query(f"""WITH {M._P}, {_SMALL}, train AS (SELECT a.vec_id AS t, b.vec_id AS id, b.cc_group AS y, {', '.join('b.' + x for x in _A)} FROM small a JOIN small b ON a.vec_id <> b.vec_id),
asked AS (SELECT vec_id AS t, vec_id AS id, {', '.join(_A)} FROM small), {tree_sql('train', _A, 0.01)}, {walk_sql('asked', _A, len(_A))} SELECT id AS vec_id, pred FROM judged""")
def c45_leave_one_out(spark, d) -> DataFrame:
    return _leave_one_out(spark, d).select("vec_id", "pred")


_TREES, _DRAWS, _WIDTH, _SEED = 5, 1000, 3, 2
_CHOSEN = {t: sorted(random.Random(_SEED * 1000 + t).sample(_A, _WIDTH), key=_A.index) for t in range(_TREES)}
_FOREST = f"""{M._P}, numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS rid FROM p), picks AS (SELECT CAST(i // {_DRAWS} AS INTEGER) AS t, {lot_sql(_SEED, 'i')} % (SELECT count(*) FROM p) AS rid FROM range({_TREES * _DRAWS}) r(i)),
drawn AS (SELECT t, cc_group AS y, {', '.join(_A)} FROM picks JOIN numbered USING (rid)), asked AS (SELECT x.t, vec_id AS id, {', '.join(_A)} FROM p, (SELECT unnest(range({_TREES})) AS t) x),
{tree_sql('drawn', _A, 0.02, _CHOSEN)}, {walk_sql('asked', _A, _WIDTH)}, votes AS (SELECT id, pred, count(*) AS n FROM judged GROUP BY 1, 2), elected AS (SELECT id AS vec_id, first(pred ORDER BY n DESC, pred) AS pred FROM votes GROUP BY 1)"""


def _voted(spark, d) -> DataFrame:
    p = M.patients(spark, d)
    m = tree.forest(p, _A, "cc_group", n_attrs=_WIDTH, n_rows=_DRAWS, n_trees=_TREES, threshold=0.02, key=["vec_id"], seed=_SEED)
    return m.vote(p)


@query(f"WITH {_FOREST} SELECT vec_id, pred FROM elected")
def forest_votes(spark, d) -> DataFrame:
    return _voted(spark, d).select("vec_id", "pred")


@query(f"WITH {_FOREST} SELECT count(*) AS n, CAST(sum(CAST(pred = cc_group AS INT)) AS BIGINT) AS correct, round(avg(CAST(pred = cc_group AS DOUBLE)), 8) AS accuracy FROM elected JOIN p USING (vec_id)")
def forest_accuracy(spark, d) -> DataFrame:
    return evaluate.overall(_voted(spark, d), "cc_group", "pred").select("n", "correct", F.round("accuracy", 8).alias("accuracy"))


def forest_sql(base: str, key: str, label: str, cats: list[str], nums: list[str], order: list[str], n_attrs: int, draws: int, trees: int, threshold: float, seed: int, judged: str = "") -> str:
    """The forest over the table ``base`` and ``elected`` (id, pred) of the rows of ``judged``, by default the same."""
    chosen = {t: sorted(random.Random(seed * 1000 + t).sample(order, min(n_attrs, len(order))), key=order.index) for t in range(trees)}
    cols = ", ".join([*cats, *nums])
    return f"""numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS rid FROM {base}), picks AS (SELECT CAST(i // {draws} AS INTEGER) AS t, {lot_sql(seed, 'i')} % (SELECT count(*) FROM {base}) AS rid FROM range({trees * draws}) r(i)),
drawn AS MATERIALIZED (SELECT t, rid, {label} AS y, {cols} FROM picks JOIN numbered USING (rid)), asked AS (SELECT x.t, {key} AS id, {cols} FROM {judged or base}, (SELECT unnest(range({trees})) AS t) x),
{mixed_tree_sql('drawn', cats, nums, order, threshold, chosen)}, {mixed_walk_sql('asked', cats, nums)}, votes AS (SELECT id, pred, count(*) AS n FROM judged GROUP BY 1, 2), elected AS (SELECT id, first(pred ORDER BY n DESC, pred) AS pred FROM votes GROUP BY 1)"""


@query(f"WITH {M._P}, {forest_sql('p', 'vec_id', 'cc_group', M.CATS, M.NUMS, _ALL, 5, 1000, 5, 0.02, 2)} SELECT count(*) AS n, CAST(sum(CAST(pred = cc_group AS INT)) AS BIGINT) AS correct, round(avg(CAST(pred = cc_group AS DOUBLE)), 8) AS accuracy FROM elected JOIN p ON vec_id = id")
def random_forest(spark, d) -> DataFrame:
    p = M.patients(spark, d)
    m = tree.forest(p, _ALL, "cc_group", n_attrs=5, n_rows=1000, n_trees=5, threshold=0.02, key=["vec_id"], seed=2)
    return evaluate.overall(m.vote(p), "cc_group", "pred").select("n", "correct", F.round("accuracy", 8).alias("accuracy"))


_WORD_TREES, _WORD_ATTRS, _WORD_SEED = 3, 6, 3
_WS = [f"w{i}" for i in range(_WORD_TREES * _WORD_ATTRS)]
_WORD_BASE = f"""{M._TF}, wd AS MATERIALIZED (SELECT term, row_number() OVER (ORDER BY {lot_sql(_WORD_SEED, 'term')}, term) - 1 AS no FROM (SELECT DISTINCT term FROM tf) QUALIFY no < {len(_WS)}),
few AS (SELECT doc, no, f FROM tf JOIN wd USING (term)), allrows AS MATERIALIZED (SELECT doc_id AS doc, source, {', '.join(f"CAST(coalesce(max(CASE WHEN no = {i} THEN f END), 0) AS DOUBLE) AS w{i}" for i in range(len(_WS)))} FROM documents LEFT JOIN few ON doc = doc_id GROUP BY 1, 2), labelled AS (SELECT * FROM allrows WHERE source IS NOT NULL)"""


@query(f"WITH {_WORD_BASE}, {forest_sql('labelled', 'doc', 'source', [], _WS, _WS, _WORD_ATTRS, 500, _WORD_TREES, 0.01, _WORD_SEED, 'allrows')} SELECT id AS doc, source AS obs, pred FROM elected JOIN allrows ON doc = id")
def author_forest(spark, d) -> DataFrame:
    """Each document's source, as a forest over the frequencies of drawn words tells it."""
    docs = M._texts(spark, d)
    return text.forest_authors(M._tf(spark, d), docs.select(F.col("doc_id").alias("doc"), F.col("source").alias("author")), n_attrs=_WORD_ATTRS, n_rows=500, n_trees=_WORD_TREES, threshold=0.01, seed=_WORD_SEED)


# -- held-out rows and folds ----------------------------------------------------

_NB = """pr AS (SELECT cc_group AS y, count(*) / sum(count(*)) OVER () AS p, count(*) AS n FROM train GROUP BY 1), tl AS (SELECT x.* FROM x JOIN train USING (vec_id)),
cd AS (SELECT attr, v, y, count(*) / any_value(n) AS q FROM tl JOIN pr USING (y) GROUP BY 1, 2, 3), s AS (SELECT a.vec_id, pr.y, any_value(pr.p) * product(coalesce(cd.q, 0)) AS s FROM (SELECT x.* FROM x JOIN test USING (vec_id)) a CROSS JOIN pr LEFT JOIN cd ON cd.attr = a.attr AND cd.v = a.v AND cd.y = pr.y GROUP BY 1, 2),
b AS (SELECT vec_id, y AS pred FROM (SELECT vec_id, y, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 14) DESC, y) AS r FROM s) WHERE r = 1)"""
_HOLD = f"{lot_sql(1, 'vec_id')} % {1 << 30} < {int(2 / 3 * (1 << 30))}"


@query(f"WITH {M._LONG}, train AS (SELECT * FROM p WHERE {_HOLD}), test AS (SELECT * FROM p WHERE NOT {_HOLD}), {_NB} SELECT count(*) AS n, CAST(sum(CAST(pred = cc_group AS INT)) AS BIGINT) AS correct, round(avg(CAST(pred = cc_group AS DOUBLE)), 8) AS accuracy FROM b JOIN p USING (vec_id)")
def holdout_naive_bayes(spark, d) -> DataFrame:
    train, test = prep.holdout(M.patients(spark, d), "vec_id", 2 / 3, seed=1)
    return evaluate.overall(bayes.predict(test, bayes.fit(train, M.CATS, "cc_group")), "cc_group", "pred").select("n", "correct", F.round("accuracy", 8).alias("accuracy"))


_SVM_Z = "z AS (SELECT c_custkey, (c_acctbal - 4500) / 3000 AS x, (c_nationkey - 12) / 7.0 AS y, CASE WHEN c_acctbal + 200 * c_nationkey > 7000 THEN 1.0 ELSE -1.0 END AS l FROM customer)"


def _svm_rounds(rows: str, rounds: int = 10) -> str:
    s = f"w0 AS (SELECT DISTINCT t, -1.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c FROM {rows})"
    for i in range(rounds):
        bad = "l * (a * x + b * y - c) <= 1"
        s += f", w{i + 1} AS MATERIALIZED (SELECT w.t, " + ", ".join(f"any_value({k}) - 0.0001 * (any_value({k}) + 2 * sum(CASE WHEN {bad} THEN {g} ELSE 0 END)) AS {k}" for k, g in (("a", "-l * x"), ("b", "-l * y"), ("c", "l"))) + f" FROM {rows} z JOIN w{i} w ON w.t = z.t GROUP BY w.t)"
    return s


def _points(spark, d) -> DataFrame:
    c = load(spark, d, "customer")
    return c.select("c_custkey", ((F.col("c_acctbal") - 4500) / 3000).alias("x"), ((F.col("c_nationkey") - 12) / 7.0).alias("y"), F.when(F.col("c_acctbal") + 200 * F.col("c_nationkey") > 7000, 1.0).otherwise(-1.0).alias("obs"))


@query(f"WITH {_SVM_Z}, one AS (SELECT 0 AS t, * FROM z), {_svm_rounds('one')} SELECT c_custkey, CAST(sign(round(a * x + b * y - c, 9)) AS DOUBLE) AS pred FROM z, w10")
def svm_predict(spark, d) -> DataFrame:
    z = _points(spark, d)
    got = svm.predict(z, ["x", "y"], svm.fit(z, ["x", "y"], "obs", 0.0001, 10), -1)
    return got.select("c_custkey", "pred")


@query(f"""WITH {_SVM_Z}, f AS (SELECT *, ntile(5) OVER (ORDER BY {lot_sql(1, 'c_custkey')}, c_custkey) AS fold FROM z), tr AS (SELECT k.t, f.* FROM f, (SELECT unnest(range(1, 6)) AS t) k WHERE t <> fold), {_svm_rounds('tr')},
j AS (SELECT fold, CAST(sign(a * x + b * y - c) = l AS DOUBLE) AS hit FROM f JOIN w10 ON t = fold) SELECT round(avg(hit), 8) AS pooled_accuracy, (SELECT round(avg(h), 8) FROM (SELECT avg(hit) AS h FROM j GROUP BY fold)) AS mean_accuracy FROM j""")
def svm_cross_validation(spark, d) -> DataFrame:
    """Five folds: each customer judged by the weights of the others' folds."""
    z = _points(spark, d)
    rows = materialize(z.join(prep.k_folds(z.select("c_custkey"), "c_custkey", 5, seed=1), "c_custkey"))
    parts = [svm.predict(rows.filter(F.col("fold") == f), ["x", "y"], svm.fit(rows.filter(F.col("fold") != f), ["x", "y"], "obs", 0.0001, 10), -1) for f in range(1, 6)]
    got = parts[0]
    for x in parts[1:]:
        got = got.unionByName(x)
    r = evaluate.fold_report(got)
    return r.select(F.round("pooled_accuracy", 8).alias("pooled_accuracy"), F.round("mean_accuracy", 8).alias("mean_accuracy"))


# -- samples ---------------------------------------------------------------------


@query(f"SELECT o_orderkey, o_totalprice FROM orders ORDER BY {lot_sql(7, 'o_orderkey')}, o_orderkey LIMIT 100")
def sample_without_replacement(spark, d) -> DataFrame:
    return prep.sample_exact(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), 100, "o_orderkey", seed=7)


@query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE {lot_sql(7, 'o_orderkey')} % {1 << 30} < {int(0.1 * (1 << 30))}")
def sample_fraction(spark, d) -> DataFrame:
    return prep.sample_share(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), 0.1, "o_orderkey", seed=7)


@query(f"""WITH c AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS _rid FROM customer), k AS (SELECT CAST(i // 500 AS INTEGER) AS sample, {lot_sql(3, 'i')} % (SELECT count(*) FROM c) AS _rid FROM range(1000) r(i))
SELECT _rid, sample, c_custkey, c_acctbal FROM k JOIN c USING (_rid)""")
def bootstrap_rows(spark, d) -> DataFrame:
    c = prep.with_rid(load(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_custkey"])
    return prep.bootstrap(c, "_rid", c.count(), 500, seed=3, copies=2)


@query(f"SELECT c_custkey, row_number() OVER (ORDER BY {lot_sql(5, 'c_custkey')}, c_custkey) AS place FROM customer")
def shuffled_rows(spark, d) -> DataFrame:
    """All customers in a shuffled order, with their places."""
    s = prep.shuffled(load(spark, d, "customer").select("c_custkey"), "c_custkey", seed=5)
    return prep.with_rid(s.withColumn("_s", prep.lot(5, "c_custkey")), ["_s", "c_custkey"], "_no").select("c_custkey", (F.col("_no") + 1).alias("place"))


_PICKED = random.Random(9).sample(["p_name", "p_brand", "p_type", "p_size"], 2)


@query(f"SELECT p_partkey, {', '.join(_PICKED)} FROM part")
def sampled_columns(spark, d) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", *prep.sample_columns(["p_name", "p_brand", "p_type", "p_size"], 2, seed=9))


# -- itemsets ---------------------------------------------------------------------


@query(M.SQL["frequent_itemsets"])
def itemsets_by_levels(spark, d) -> DataFrame:
    sets, _ = assoc.frequent_itemsets(M.brand_baskets(spark, d), M.MIN_SUPPORT, engine="levelwise")
    return sets.select(F.array_join("items", ",").alias("items"), "n")


@query(M.SQL["frequent_itemsets"])
def itemset_containment(spark, d) -> DataFrame:
    """The frequent sets, their baskets counted anew by containment."""
    b = materialize(M.brand_baskets(spark, d))
    sets, _ = assoc.frequent_itemsets(b, M.MIN_SUPPORT)
    return assoc.support_of(b, sets.select("items")).select(F.array_join("items", ",").alias("items"), "n")


_MAXIMAL = f"{M._B}, top AS (SELECT * FROM sets a WHERE NOT EXISTS (SELECT 1 FROM sets b WHERE len(b.items) = len(a.items) + 1 AND list_has_all(b.items, a.items))), r AS (SELECT list_filter(items, lambda v: v <> u.y) AS lhs, u.y AS rhs, c FROM top, unnest(items) AS u(y) WHERE len(items) > 1), rc AS (SELECT lhs, rhs, r.c / n AS sup, r.c / s.c AS conf FROM r JOIN sets s ON s.items = lhs, n)"


@query(f"WITH {_MAXIMAL} SELECT array_to_string(lhs, ' | ') || ' ---> ' || rhs || format(' [sup = {{:.5f}}, conf = {{:.5f}}]', sup, conf) AS text FROM rc WHERE conf >= 0.15")
def rule_texts(spark, d) -> DataFrame:
    sets, total = assoc.frequent_itemsets(M.brand_baskets(spark, d), M.MIN_SUPPORT)
    return assoc.rule_text(assoc.rules(sets, total, M.MIN_CONFIDENCE, assoc.maximal_itemsets(sets))).select("text")


@query(f"WITH {_MAXIMAL} SELECT 'support' AS measure, round(sup, 8) AS value FROM (SELECT DISTINCT sup FROM rc) UNION ALL SELECT 'confidence', round(conf, 8) FROM rc")
def rule_exploration(spark, d) -> DataFrame:
    s, c = assoc.explore(M.brand_baskets(spark, d), M.MIN_SUPPORT)
    return s.select(F.lit("support").alias("measure"), F.round("support", 8).alias("value")).unionByName(c.select(F.lit("confidence").alias("measure"), F.round("confidence", 8).alias("value")))


# -- neighbours of mixed features -----------------------------------------------


def _mixed_sql(numbers: list[str], kinds: list[str], key: str, k: int, ask: str) -> str:
    z = ", ".join(f"({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0) AS {c}" for c in numbers)
    d = " + ".join([f"coalesce((a.{c} - b.{c})**2, 0)" for c in numbers] + [f"CASE WHEN a.{c} <> b.{c} THEN 2 ELSE 0 END" for c in kinds])
    return f"z AS MATERIALIZED (SELECT {key} AS id, label, {', '.join(kinds)}, {z} FROM src), d AS (SELECT a.id AS q, b.id AS n, b.label, sqrt({d}) AS d FROM z a JOIN z b ON a.id <> b.id WHERE a.{ask}), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(d, 12), n) AS rank FROM d QUALIFY rank <= {k})"


_KNN_MIXED = f"""WITH {M._P}, src AS (SELECT *, cc_group AS label FROM p), {_mixed_sql(M.NUMS, M.CATS, 'vec_id', 10, 'id % 20 = 0')}"""


@query(_KNN_MIXED + ", c AS (SELECT q, label, count(*) AS n FROM r GROUP BY 1, 2) SELECT q AS query, first(label ORDER BY n DESC, label) AS pred FROM c GROUP BY 1")
def knn_mixed_features(spark, d) -> DataFrame:
    """Leave-one-out classification of the stated query set from standardized numbers and one-hot categories."""
    return neighbours.classify(_mixed_near(spark, d), 10)


@query(_KNN_MIXED + ", c AS (SELECT q, label, count(*) AS n, min(rank) AS r FROM r GROUP BY 1, 2) SELECT q AS query, first(label ORDER BY n DESC, r) AS pred FROM c GROUP BY 1")
def knn_nearest_tie(spark, d) -> DataFrame:
    """Ties go to the nearest neighbour's label."""
    return neighbours.classify(_mixed_near(spark, d), 10, ties="nearest")


def _mixed_near(spark, d) -> DataFrame:
    f = materialize(neighbours.features(M.patients(spark, d), "vec_id", "cc_group"))
    return neighbours.nearest(f.filter("vec_id % 20 = 0"), f, "vec_id", "v", 10, payload="cc_group")


_BENE = M.SQL["claims_feature_table"].replace("WITH ", "", 1)
_BENE = _BENE[: _BENE.rindex("\nSELECT c.k")] + ", src AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS no, CAST(cc AS VARCHAR) AS label, age, claims, paid, CAST(sex AS VARCHAR) AS sex, CAST(race AS VARCHAR) AS race FROM (" + _BENE[_BENE.rindex("\nSELECT c.k") :] + ") WHERE age IS NOT NULL AND paid IS NOT NULL AND sex IS NOT NULL AND race IS NOT NULL)"


@query(f"WITH {_BENE}, {_mixed_sql(['age', 'claims', 'paid'], ['sex', 'race'], 'no', 10, 'id % 20 = 0')}, votes AS (SELECT q, label, count(*) AS n FROM r GROUP BY 1, 2) SELECT src.k, src.label AS obs, first(v.label ORDER BY v.n DESC, v.label) AS pred FROM votes v JOIN src ON q = no GROUP BY 1, 2")
def beneficiary_neighbours(spark, d) -> DataFrame:
    """Every 20th beneficiary's class of conditions, as most of its ten nearest others have it."""
    from minespark.functions.keys import hex_text

    f = M.beneficiary_features(spark, d).dropna().withColumns({"k": hex_text(F.col("k")), "sex": F.col("sex").cast("string"), "race": F.col("race").cast("string"), "label": F.col("cc").cast("string")}).drop("cc")
    f = materialize(prep.with_rid(f, ["k"], "no"))
    v = materialize(neighbours.features(f.drop("k"), "no", "label"))
    got = neighbours.classify(neighbours.nearest(v.filter("no % 20 = 0"), v, "no", "v", 10, payload="label"), 10)
    return got.join(f.select(F.col("no").alias("query"), "k", F.col("label").alias("obs")), "query").select("k", "obs", "pred")


_BENE_ATTRS = ["age", "claims", "paid", "sex", "race"]


@query(f"WITH {_BENE}, {forest_sql('src', 'k', 'label', ['sex', 'race'], ['age', 'claims', 'paid'], _BENE_ATTRS, 5, 1000, 5, 0.02, 1)} SELECT count(*) AS n, CAST(sum(CAST(pred = label AS INT)) AS BIGINT) AS correct, round(avg(CAST(pred = label AS DOUBLE)), 8) AS accuracy FROM elected JOIN src ON k = id")
def beneficiary_forest(spark, d) -> DataFrame:
    """The class of conditions of beneficiaries told by a forest over age, claims, payments, sex and race."""
    from minespark.functions.keys import hex_text

    f = M.beneficiary_features(spark, d).dropna().withColumns({"k": hex_text(F.col("k")), "sex": F.col("sex").cast("string"), "race": F.col("race").cast("string")})
    f = materialize(f)
    m = tree.forest(f, _BENE_ATTRS, "cc", n_attrs=5, n_rows=1000, n_trees=5, threshold=0.02, key=["k"], seed=1)
    return evaluate.overall(m.vote(f), "cc", "pred").select("n", "correct", F.round("accuracy", 8).alias("accuracy"))


# -- clusterings ------------------------------------------------------------------

_Z = "z AS MATERIALIZED (SELECT c_custkey AS id, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER () AS x, (c_nationkey - avg(c_nationkey) OVER ()) / stddev_samp(c_nationkey) OVER () AS y FROM customer)"
_FAR = _Z + ", f0 AS MATERIALIZED (SELECT id, x, y FROM z ORDER BY round(sqrt((x - (SELECT avg(x) FROM z))**2 + (y - (SELECT avg(y) FROM z))**2), 10) DESC, id LIMIT 1)" + "".join(
    f", f{i} AS MATERIALIZED (SELECT * FROM f{i - 1} UNION ALL (SELECT z.id, z.x, z.y FROM z, f{i - 1} f WHERE z.id NOT IN (SELECT id FROM f{i - 1}) GROUP BY ALL ORDER BY round(sum(sqrt((z.x - f.x)**2 + (z.y - f.y)**2)), 10) DESC, z.id LIMIT 1))" for i in range(1, 4)
)


@query(f"WITH {_FAR} SELECT round(x, 6) AS x, round(y, 6) AS y FROM f3")
def farthest_first_start(spark, d) -> DataFrame:
    c = clustering.farthest_first(M._customer_points(spark, d), 4)
    return spark.createDataFrame([tuple(map(float, x)) for x in c], "x double, y double").select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def lloyd_sql(k: int, dims: int, rounds: int) -> str:
    """k-means over points ``z`` (id, v) from the farthest points on: a0, a1, ... the members and c0, c1, ... the centres of each round."""

    def dist(a: str, b: str) -> str:
        return f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda t: (t[1] - t[2]) ** 2)))"

    mean = "[" + ", ".join(f"avg(v[{i + 1}])" for i in range(dims)) + "]"
    s = f"mid AS MATERIALIZED (SELECT {mean} AS m FROM z), f0 AS MATERIALIZED (SELECT id, v, 0 AS c FROM z, mid ORDER BY round({dist('v', 'm')}, 10) DESC, id LIMIT 1)"
    for i in range(1, k):
        s += f", f{i} AS MATERIALIZED (SELECT * FROM f{i - 1} UNION ALL (SELECT z.id, z.v, {i} FROM z, f{i - 1} f WHERE z.id NOT IN (SELECT id FROM f{i - 1}) GROUP BY z.id, z.v ORDER BY round(sum({dist('z.v', 'f.v')}), 10) DESC, z.id LIMIT 1))"
    s += f", c0 AS (SELECT c, v FROM f{k - 1})"
    for i in range(rounds):
        s += f", a{i} AS MATERIALIZED (SELECT z.id, z.v, min_by(c.c, [round({dist('z.v', 'c.v')}, 12), c.c]) AS c FROM z, c{i} c GROUP BY 1, 2), c{i + 1} AS MATERIALIZED (SELECT c, {mean} AS v FROM a{i} GROUP BY 1)"
    return s + f", err AS (SELECT a.c, {dist('a.v', 'c.v')} AS e FROM a{rounds - 1} a JOIN c{rounds - 1} c USING (c))"


_STATS = "SELECT CAST(c AS INTEGER) AS cluster, count(*) AS n, round(min(e), {0}) AS min_err, round(max(e), {0}) AS max_err, round(avg(e), {0}) AS avg_err, round(sum(e * e), {0}) AS sse FROM err GROUP BY 1"


@query(f"WITH zz AS (SELECT c_custkey AS id, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER () AS x, (c_nationkey - avg(c_nationkey) OVER ()) / stddev_samp(c_nationkey) OVER () AS y FROM customer), z AS MATERIALIZED (SELECT id, [x, y] AS v FROM zz), {lloyd_sql(4, 2, 60)} {_STATS.format(6)}")
def kmeans_clusters(spark, d) -> DataFrame:
    m = clustering.kmeans(M._customer_points(spark, d), 4)
    return clustering.cluster_stats(m.assigned).select("cluster", "n", *[F.round(c, 6).alias(c) for c in ("min_err", "max_err", "avg_err", "sse")])


_BASE = M.SQL["claims_feature_table"].replace("WITH ", "", 1)
_BASE = _BASE[: _BASE.rindex("\nSELECT c.k")] + ", base AS (" + _BASE[_BASE.rindex("\nSELECT c.k") :] + ")"
_HOT = [f"(CASE WHEN {c} = {v} THEN 1.0 ELSE 0.0 END)" for c, vs in (("sex", (0, 1)), ("race", range(1, 8))) for v in vs]
_BENE_Z = "z AS MATERIALIZED (SELECT k AS id, [" + ", ".join(f"coalesce(({x} - avg({x}) OVER ()) / nullif(stddev_samp({x}) OVER (), 0), 0.0)" for x in ["age", "claims", "paid", *_HOT]) + "] AS v FROM base WHERE age IS NOT NULL)"


@query(f"WITH {_BASE}, {_BENE_Z}, {lloyd_sql(6, 3 + len(_HOT), 60)} {_STATS.format(4)}")
def beneficiary_clusters(spark, d) -> DataFrame:
    f = prep.one_hot(M.beneficiary_features(spark, d).dropna(subset=["age"]).withColumns({"sex": F.col("sex").cast("string"), "race": F.col("race").cast("string")}).drop("cc"), ["sex", "race"])
    m = clustering.kmeans(clustering.points(f, "k", [c for c in f.columns if c != "k"]), 6)
    return clustering.cluster_stats(m.assigned).select("cluster", "n", *[F.round(c, 4).alias(c) for c in ("min_err", "max_err", "avg_err", "sse")])


_LLOYD = _FAR + ", c0 AS (SELECT row_number() OVER (ORDER BY ord) - 1 AS c, x, y FROM (" + " UNION ALL ".join(f"SELECT {i} AS ord, x, y FROM f{i}" + (f" WHERE id NOT IN (SELECT id FROM f{i - 1})" if i else "") for i in range(4)) + "))" + "".join(
    f", a{i} AS MATERIALIZED (SELECT z.id, z.x, z.y, min_by(c.c, [round(sqrt((z.x - c.x)**2 + (z.y - c.y)**2), 12), c.c]) AS c FROM z, c{i} c GROUP BY 1, 2, 3), c{i + 1} AS MATERIALIZED (SELECT c, avg(x) AS x, avg(y) AS y FROM a{i} GROUP BY 1)" for i in range(60)
)


@query(f"WITH {_LLOYD} SELECT CAST(a.c AS INTEGER) AS cluster, count(*) AS n, round(max(sqrt((a.x - c.x)**2 + (a.y - c.y)**2)), 3) AS max_err FROM a59 a JOIN c59 c USING (c) GROUP BY 1")
def kmeans_converged(spark, d) -> DataFrame:
    """Four clusters from the farthest points, moved until memberships repeat."""
    m = clustering.kmeans(M._customer_points(spark, d), 4)
    return clustering.cluster_stats(m.assigned).select("cluster", "n", F.round("max_err", 3).alias("max_err"))


@query(f"WITH {_Z} SELECT round(x, 6) AS x, round(y, 6) AS y FROM z ORDER BY {lot_sql(2, 'id')}, id LIMIT 3")
def random_start_points(spark, d) -> DataFrame:
    c = clustering.random_start(M._customer_points(spark, d), 3, seed=2)
    return spark.createDataFrame([tuple(map(float, x)) for x in c], "x double, y double").select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(M.SQL["dbscan_clusters"].replace("SELECT z.id AS rid, CAST(coalesce(kc.c, b.c, -1) AS INTEGER) AS cluster,", "SELECT round(100 * avg(CAST(coalesce(kc.c, b.c, -1) = -1 AS DOUBLE)), 1) AS outlier_percent, --").replace(" FROM z LEFT JOIN kc", "\nFROM z LEFT JOIN kc"))
def dbscan_outliers(spark, d) -> DataFrame:
    return clustering.noise_share(M.dbscan_clusters(spark, d))


def merges_sql(link: str, n: int = 25) -> str:
    """Agglomeration of the nations (points ``z``: id, x, y) step by step: m1, m2, ... are the merges."""
    new = {"average": "(any_value(sa) * min(da) + any_value(sb) * min(db)) / (any_value(sa) + any_value(sb))", "single": "least(min(da), min(db))", "complete": "greatest(min(da), min(db))"}[link]
    s = "d0 AS MATERIALIZED (SELECT a.id AS a, b.id AS b, a.id AS pa, b.id AS pb, 1 AS na, 1 AS nb, sqrt((a.x - b.x)**2 + (a.y - b.y)**2) AS d FROM z a JOIN z b ON a.id <> b.id)"
    for i in range(n - 1):
        s += f""", m{i + 1} AS MATERIALIZED (SELECT {i} AS step, a AS left_id, b AS right_id, (SELECT count(*) FROM z) + {i} AS new_id, d AS height, na + nb AS size, pa, pb FROM d{i} WHERE pa < pb ORDER BY round(d, 12), pa, pb LIMIT 1)"""
        if i == n - 2:
            break
        s += f""", k{i + 1} AS MATERIALIZED (SELECT x.b AS o, x.pb AS po, x.nb AS no, {new.replace("min(da)", "x.d").replace("min(db)", "y.d").replace("any_value(sa)", "x.na").replace("any_value(sb)", "y.na")} AS d, m.new_id, m.pa, m.size FROM m{i + 1} m JOIN d{i} x ON x.a = m.left_id JOIN d{i} y ON y.a = m.right_id AND y.b = x.b),
d{i + 1} AS MATERIALIZED (SELECT d.* FROM d{i} d, m{i + 1} m WHERE d.a NOT IN (m.left_id, m.right_id) AND d.b NOT IN (m.left_id, m.right_id) UNION ALL SELECT new_id, o, pa, po, size, no, d FROM k{i + 1} UNION ALL SELECT o, new_id, po, pa, no, size, d FROM k{i + 1})"""
    return s


_NATIONS = """src AS (SELECT * FROM (SELECT c_nationkey AS k, avg(c_acctbal) AS x FROM customer GROUP BY 1) JOIN (SELECT s_nationkey AS k, avg(s_acctbal) AS y FROM supplier GROUP BY 1) USING (k)),
z AS MATERIALIZED (SELECT row_number() OVER (ORDER BY src.x, src.y) - 1 AS id, (src.x - avg(src.x) OVER ()) / stddev_samp(src.x) OVER () AS x, (src.y - avg(src.y) OVER ()) / stddev_samp(src.y) OVER () AS y FROM src)"""
_MERGES = " UNION ALL ".join(f"SELECT step, left_id, right_id, new_id, height, size FROM m{i + 1}" for i in range(24))


def nation_tree(spark, d, link: str) -> tuple[list, clustering.Dendrogram]:
    a = load(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("x"))
    b = load(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("y"))
    return clustering.hclust(a.join(b, "k"), ["x", "y"], link=link)


for _link in ("average", "single", "complete"):

    def _merged(spark, d, link=_link) -> DataFrame:
        _, t = nation_tree(spark, d, link)
        return spark.createDataFrame([(i, *m[:3], round(m[3], 7), m[4]) for i, m in enumerate(t.merges)], "step int, left_id int, right_id int, new_id int, height double, size int")

    _name = "hclust_merges" if _link == "average" else f"hclust_{_link}_link"
    QUERIES[_name] = _merged
    SQL[_name] = f"WITH {_NATIONS}, {merges_sql(_link)} SELECT CAST(step AS INTEGER) AS step, CAST(left_id AS INTEGER) AS left_id, CAST(right_id AS INTEGER) AS right_id, CAST(new_id AS INTEGER) AS new_id, round(height, 7) AS height, CAST(size AS INTEGER) AS size FROM ({_MERGES})"

def centroid_merges_sql(n: int = 25) -> str:
    """As ``merges_sql``, the distance of two clusters being that of their means."""
    s = "c0 AS MATERIALIZED (SELECT id, id AS pos, 1 AS n, x, y FROM z)"
    for i in range(n - 1):
        s += f""", m{i + 1} AS MATERIALIZED (SELECT {i} AS step, a.id AS left_id, b.id AS right_id, (SELECT count(*) FROM z) + {i} AS new_id, sqrt((a.x - b.x)**2 + (a.y - b.y)**2) AS height, a.n + b.n AS size, a.pos, (a.n * a.x + b.n * b.x) / (a.n + b.n) AS x, (a.n * a.y + b.n * b.y) / (a.n + b.n) AS y FROM c{i} a JOIN c{i} b ON a.pos < b.pos ORDER BY round(height, 12), a.pos, b.pos LIMIT 1),
c{i + 1} AS MATERIALIZED (SELECT c.* FROM c{i} c WHERE c.id NOT IN (SELECT left_id FROM m{i + 1} UNION ALL SELECT right_id FROM m{i + 1}) UNION ALL SELECT new_id, pos, size, x, y FROM m{i + 1})"""
    return s


@query(f"WITH {_NATIONS}, {centroid_merges_sql()} SELECT CAST(step AS INTEGER) AS step, CAST(left_id AS INTEGER) AS left_id, CAST(right_id AS INTEGER) AS right_id, CAST(new_id AS INTEGER) AS new_id, round(height, 7) AS height, CAST(size AS INTEGER) AS size FROM ({_MERGES})")
def hclust_centroid_link(spark, d) -> DataFrame:
    _, t = nation_tree(spark, d, "centroid")
    return spark.createDataFrame([(i, *m[:3], round(m[3], 7), m[4]) for i, m in enumerate(t.merges)], "step int, left_id int, right_id int, new_id int, height double, size int")


@query(f"WITH {_NATIONS} SELECT CAST(id AS INTEGER) AS leaf FROM z")
def hclust_leaves(spark, d) -> DataFrame:
    """The leaves below the root, and no other."""
    _, t = nation_tree(spark, d, "complete")
    return spark.createDataFrame([(x,) for x in t.leaves(t.root)], "leaf int")


def _outliers_sql(k: int) -> str:
    """The tallest cluster is opened until there are ``k``; single points that split off are taken away: p0, p1, ... (id, height, size) are the states."""
    s = "p0 AS MATERIALIZED (SELECT new_id AS id, height FROM mm ORDER BY step DESC LIMIT 1)"
    for i in range(24):
        s += f""", o{i} AS MATERIALIZED (SELECT p.id, m.left_id, m.right_id FROM p{i} p JOIN mm m ON m.new_id = p.id WHERE (SELECT count(*) FROM p{i}) < {k} ORDER BY p.height DESC, p.id LIMIT 1),
p{i + 1} AS MATERIALIZED (SELECT p.* FROM p{i} p WHERE p.id NOT IN (SELECT id FROM o{i}) UNION ALL SELECT m.new_id, m.height FROM o{i} o JOIN mm m ON m.new_id IN (o.left_id, o.right_id))"""
    return s


@query(f"WITH {_NATIONS}, {merges_sql('average')}, mm AS MATERIALIZED ({_MERGES}), {_outliers_sql(3)} SELECT size AS n FROM p24 p JOIN mm m ON m.new_id = p.id")
def hclust_without_outliers(spark, d) -> DataFrame:
    """Sizes of three clusters of nations, single points that split off on the way taken away."""
    _, t = nation_tree(spark, d, "average")
    return spark.createDataFrame([(len(c),) for c in t.cut_without_outliers(3)[0]], "n int")


_CUT = f"""WITH RECURSIVE {_NATIONS}, {merges_sql("average")}, mm AS MATERIALIZED ({_MERGES}), e AS (SELECT new_id AS p, left_id AS c FROM mm WHERE step < (SELECT count(*) FROM z) - 6 UNION ALL SELECT new_id, right_id FROM mm WHERE step < (SELECT count(*) FROM z) - 6),
u(id, top) AS (SELECT id, id FROM z UNION ALL SELECT u.id, e.p FROM u JOIN e ON e.c = u.top), t AS (SELECT id, max(top) AS top FROM u GROUP BY 1)"""


@query(_CUT + " SELECT CAST(min(id) AS INTEGER) AS first_leaf, count(*) AS n FROM t GROUP BY top")
def hclust_cut(spark, d) -> DataFrame:
    """The six clusters of nations: smallest leaf and size (leaves are numbered in the order of the points)."""
    _, t = nation_tree(spark, d, "average")
    return spark.createDataFrame([(min(c), len(c)) for c in t.cut(6, "nclust")], "first_leaf int, n long")


@query(_CUT.replace("step < (SELECT count(*) FROM z) - 6", "height <= 0.8") + " SELECT CAST(min(id) AS INTEGER) AS first_leaf, count(*) AS n FROM t GROUP BY top")
def hclust_cut_height(spark, d) -> DataFrame:
    """The clusters of nations below a height."""
    _, t = nation_tree(spark, d, "average")
    return spark.createDataFrame([(min(c), len(c)) for c in t.cut(0.8)], "first_leaf int, n long")


@query(f"WITH {_NATIONS}, {merges_sql('average')} SELECT round(height, 7) AS height, row_number() OVER (ORDER BY height DESC) AS place FROM ({_MERGES})")
def hclust_heights(spark, d) -> DataFrame:
    _, t = nation_tree(spark, d, "average")
    return spark.createDataFrame([(round(h, 7), i + 1) for i, h in enumerate(t.heights())], "height double, place long")


@query()
def beneficiary_hclust(spark, d) -> DataFrame:
    """Six clusters of a sample of 1,000 beneficiaries by age, claims, payments, sex and race; merging all would be quadratic."""
    f = M.beneficiary_features(spark, d).dropna().withColumns({"sex": F.col("sex").cast("string"), "race": F.col("race").cast("string")}).drop("cc")
    s = materialize(prep.one_hot(prep.sample_exact(f, 1000, "k", seed=6), ["sex", "race"]).drop("k"))
    _, t = clustering.hclust(s, s.columns)
    return spark.createDataFrame([(i, len(c)) for i, c in enumerate(t.cut(6, "nclust"))], "cluster int, n long")


# -- recommendation lists -----------------------------------------------------------


def _listed_sql(cells: str, ratings: str = M._R) -> str:
    """Ratings among the listed users and items, and the adjusted weighted sums of the listed cells."""
    r = ratings.replace("r AS (", "whole AS (", 1)
    return f"""{r}, cells AS MATERIALIZED ({cells}), r AS MATERIALIZED (SELECT * FROM whole WHERE u IN (SELECT u FROM cells) AND i IN (SELECT i FROM cells)), {M._sims("u", "i")}, mn AS (SELECT u AS a, avg(x) AS m FROM r GROUP BY 1),
k AS (SELECT t.u, t.i, r.x, coalesce(s.s, 0) AS s, ma.m AS ma, mb.m AS mb, row_number() OVER (PARTITION BY t.u, t.i ORDER BY coalesce(s.s, 0) DESC, r.u) AS n FROM cells t JOIN r ON r.i = t.i AND r.u <> t.u LEFT JOIN s ON s.a = t.u AND s.b = r.u JOIN mn ma ON ma.a = t.u JOIN mn mb ON mb.a = r.u),
g AS (SELECT u, i, greatest(least(CASE WHEN abs(sum(s)) > 1e-12 THEN any_value(ma) + sum((x - mb) * s) / sum(s) END, 10), -10) AS pred FROM k WHERE n <= 5 GROUP BY 1, 2),
j AS (SELECT u, i, w.x AS rating, g.pred FROM cells JOIN whole w USING (u, i) LEFT JOIN g USING (u, i))"""


_CELLS = "SELECT u, i FROM whole ORDER BY {lot}, u, i LIMIT {n}"
_LISTED = _listed_sql(_CELLS.format(lot=lot_sql(4, "u || ':' || i"), n=60))


@query(f"WITH {_LISTED} SELECT u AS user, i AS item, rating, round(pred, 5) AS pred FROM j")
def cf_listed_cells(spark, d) -> DataFrame:
    r = M.brand_ratings(spark, d)
    e = recommend.evaluate_list(r, recommend.sample_cells(r, 60, seed=4), "user-adjusted-weighted-sum")
    return e.select("user", "item", "rating", F.round("pred", 5).alias("pred"))


@query(f"""WITH {_LISTED}, told AS (SELECT rating >= 5 AS o, coalesce(pred >= 5, FALSE) AS p, abs(rating - pred) AS e FROM j)
SELECT count(*) FILTER (o AND p) AS tp, count(*) FILTER (NOT o AND p) AS fp, count(*) FILTER (o AND NOT p) AS fn, count(*) FILTER (NOT o AND NOT p) AS tn, round(avg(e), 5) AS mae FROM told""")
def cf_listed_report(spark, d) -> DataFrame:
    r = M.brand_ratings(spark, d)
    e = recommend.evaluate_list(r, recommend.sample_cells(r, 60, seed=4), "user-adjusted-weighted-sum")
    return evaluate.cf_report(e).select("tp", "fp", "fn", "tn", F.round("mae", 5).alias("mae"))


_CF_REPORT = """c2 AS (SELECT rating >= 5 AS o, coalesce(pred >= 5, FALSE) AS p, abs(rating - pred) AS e FROM j), c3 AS (SELECT count(*) FILTER (o AND p) AS tp, count(*) FILTER (NOT o AND p) AS fp, count(*) FILTER (o AND NOT p) AS fn, count(*) FILTER (NOT o AND NOT p) AS tn, avg(e) AS mae FROM c2),
c4 AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 1.0) AS pr, coalesce(tp / nullif(tp + fn, 0), 1.0) AS re FROM c3)
SELECT tp, fp, fn, tn, round(mae, 5) AS mae, round(pr, 6) AS precision, round(re, 6) AS recall, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0.0), 6) AS f1 FROM c4"""


@query(f"WITH {_listed_sql(_CELLS.format(lot=lot_sql(4, chr(117) + ' || ' + chr(39) + ':' + chr(39) + ' || i'), n=100), M._CR)}, {_CF_REPORT}")
def cf_evaluation(spark, d) -> DataFrame:
    """A hundred rated cells of all customers and brands."""
    r = M.customer_ratings(spark, d)
    e = evaluate.cf_report(recommend.evaluate_list(r, recommend.sample_cells(r, 100, seed=4), "user-adjusted-weighted-sum"))
    return e.select("tp", "fp", "fn", "tn", F.round("mae", 5).alias("mae"), *[F.round(c, 6).alias(c) for c in ("precision", "recall", "accuracy", "f1")])


@query(" UNION ALL ".join(f"SELECT {i} AS repeat, * FROM (WITH {_listed_sql(_CELLS.format(lot=lot_sql(10 + i, chr(117) + ' || ' + chr(39) + ':' + chr(39) + ' || i'), n=40))} SELECT u AS user, i AS item, rating, round(pred, 5) AS pred FROM j)" for i in range(2)))
def cf_random_repeats(spark, d) -> DataFrame:
    """Two random samples of 40 rated cells, each evaluated by itself."""
    e = recommend.evaluate_random(M.brand_ratings(spark, d), 40, 2, "user-adjusted-weighted-sum", seed=10)
    return e.select("repeat", "user", "item", "rating", F.round("pred", 5).alias("pred"))


@query(f"""WITH {M._R}, us AS (SELECT u, row_number() OVER (ORDER BY u) - 1 AS no FROM (SELECT DISTINCT u FROM r)), its AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS no FROM (SELECT DISTINCT i FROM r))
SELECT u AS user, i AS item FROM range(30) g(id) JOIN us ON us.no = {lot_sql(8, 'id')} % (SELECT count(*) FROM us) JOIN its ON its.no = {lot_sql(9, 'id')} % (SELECT count(*) FROM its)""")
def cf_drawn_cells(spark, d) -> DataFrame:
    return recommend.sample_any(M.brand_ratings(spark, d), 30, seed=8)


# -- texts ---------------------------------------------------------------------------

_STOP = ["the", "and", "of", "de", "la", "der", "die", "a", "in", "to"]


@query(f"WITH {M._TF} SELECT doc, term, f FROM tf WHERE term NOT IN ({', '.join(repr(w) for w in _STOP)})")
def term_frequency_stopwords(spark, d) -> DataFrame:
    stop = spark.createDataFrame([(w,) for w in _STOP], "word string")
    return text.term_frequencies(M._texts(spark, d), "doc_id", "text", False, stop)


_WORDS = ["ar", "blue", "en", "in", "lime", "o"]


@query("SELECT p_partkey AS doc, w AS term, CAST((length(b) - length(replace(b, w, ''))) // length(w) AS BIGINT) AS f FROM (SELECT p_partkey, array_to_string(string_split(lower(p_name), ' '), ' ') AS b FROM part), (SELECT unnest([" + ", ".join(f"'{w}'" for w in _WORDS) + "]) AS w) WHERE contains(b, w)")
def substring_frequency(spark, d) -> DataFrame:
    """How often fragments occur anywhere in the names of parts."""
    return text.substring_frequencies(load(spark, d, "part"), "p_partkey", "p_name", spark.createDataFrame([(w,) for w in _WORDS], "term string"), stemmed=False)


# Words and their stems, from the published description of the algorithm.
STEMMED = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size",
    "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration",
    "triplicate": "triplic", "formative": "form", "formalize": "formal", "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust",
    "defensible": "defens", "replacement": "replac", "adjustment": "adjust", "dependent": "depend", "adoption": "adopt", "communism": "commun", "activate": "activ", "homologous": "homolog", "effective": "effect", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{s}')" for w, s in STEMMED.items()) + ") v(word, stem)")
def published_stems(spark, d) -> DataFrame:
    from minespark.functions.stem import stems

    w = spark.createDataFrame([(w,) for w in STEMMED], "word string")
    return w.select("word", F.element_at(stems(F.array("word")), 1).alias("stem"))


@query("SELECT c_custkey, array_to_string(list_transform(string_split(c_mktsegment || ' ' || lower(c_name), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM customer")
def capitalized_names(spark, d) -> DataFrame:
    return load(spark, d, "customer").select("c_custkey", F.initcap(F.concat_ws(" ", "c_mktsegment", F.lower("c_name"))).alias("title"))


@query("SELECT o_orderkey, CAST(list(CAST(l_suppkey % 3 AS INTEGER) ORDER BY l_linenumber, l_suppkey % 3) AS VARCHAR) AS numbers FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def codec_round_trip(spark, d) -> DataFrame:
    """Lists of small numbers put into the sparse form and back."""
    g = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_suppkey") % 3).cast("int").alias("x")))).alias("l"))
    back = text.dense_codec(text.sparse_codec(F.col("l.x")))
    return g.select("o_orderkey", F.concat(F.lit("["), F.array_join(F.transform(back, lambda x: x.cast("string")), ", "), F.lit("]")).alias("numbers"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_round_trip(spark, d) -> DataFrame:
    n = load(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    text_ = n.select(F.to_json(F.struct("*")).alias("j"))
    return text_.select(F.from_json("j", n.schema).alias("x")).select("x.*")
