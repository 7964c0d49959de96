"""C4.5 decision trees, forests and cross-validated trees, grown level by level.

All trees of a forest (or of all folds) grow together: one aggregate per level
counts (tree, node, attribute, value, label) for every open node, so the number
of jobs follows the depth, not the number of trees.  Only class counts per
distinct value leave the executors' partitions; the split search over them is
done by window functions, and one winner per node comes to the driver.

A tree is a flat table of nodes.  For prediction it becomes one column
expression, or, beyond a size that code generation takes, an Arrow function in
which rows move down the tree together.
"""

from __future__ import annotations

import itertools
import json
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minespark.operators.prep import bootstrap, is_numeric, levels, sample_columns, with_rid
from minespark.scratch import materialize, release


LOCAL_ROWS = 20_000  # a node of at most so many rows is finished in one task


@dataclass
class Node:
    """A node or leaf; ``edges``: (operator, value, child), the operator being =, <= or >."""

    decision: str
    p: float
    var: str | None = None
    edges: list = field(default_factory=list)


def entropy(counts: Column, total: Column) -> Column:
    """-sum p log2 p over rows, as an aggregate over label counts."""
    p = counts / total
    return -F.sum(F.when(counts > 0, p * F.log2(p)).otherwise(0.0))


def value_counts(df: DataFrame, keys: Sequence[str], attrs: Sequence[str], label: str) -> DataFrame:
    """(keys, attr, value, num, label, n, first_rid) of every attribute; ``num`` is the value of numeric attributes."""
    cols = [
        F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("value"), (F.col(a).cast("double") if is_numeric(df, a) else F.lit(None).cast("double")).alias("num"))
        for a in attrs
    ]
    long = df.select(*keys, F.col(label).alias("label"), "_rid", F.explode(F.array(*cols)).alias("x")).select(*keys, "label", "_rid", "x.*")
    nums = [a for a in attrs if is_numeric(df, a)]
    long = long.filter(~(F.col("attr").isin(nums) & F.col("num").isNull())) if nums else long
    return long.groupBy(*keys, "attr", "value", "num", "label").agg(F.count("*").alias("n"), F.min("_rid").alias("first_rid"))


def gains(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, attr, alpha, gain, ratio, first_rid): the information gain of each categorical attribute and of each numeric split ``<= alpha``.

    NULL is a value of its own of categorical attributes; rows with a NULL in a
    numeric attribute take no part in its splits.  The gain ratio divides by the
    entropy of the attribute's values, also for numeric attributes; with a zero
    divisor it is infinite unless the gain is 0.
    """
    node = [*keys, "attr"]
    lab = counts.groupBy(*node, "label").agg(F.sum("n").alias("ln"))
    tot = lab.groupBy(*node).agg(F.sum("ln").alias("t"))
    h = lab.join(tot, node).groupBy(*node).agg(entropy(F.col("ln"), F.col("t")).alias("h"), F.first("t").alias("t"))
    per = counts.groupBy(*node, "value", "num").agg(F.sum("n").alias("vn"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("nlogn"), F.min("first_rid").alias("first_rid"))
    # the entropy of a value's rows, weighted by their number: vn log2 vn - sum n log2 n
    cat = per.filter(F.col("num").isNull()).groupBy(*node).agg(
        F.sum(F.col("vn") * F.log2(F.col("vn").cast("double")) - F.col("nlogn")).alias("w"), F.sum(F.col("vn") * F.log2(F.col("vn").cast("double"))).alias("vlogv"), F.min("first_rid").alias("first_rid")
    )
    raw = per.groupBy(*node).agg(F.sum(F.col("vn") * F.log2(F.col("vn").cast("double"))).alias("vlogv"))
    cat = cat.drop("vlogv").withColumn("alpha", F.lit(None).cast("double"))
    # numeric: class counts up to each value, from a running sum per label over the values
    num = counts.filter(F.col("num").isNotNull())
    labels = num.select(*keys, "attr", "label").distinct()
    grid = num.select(*node, "num").distinct().join(labels, node)  # values x labels of a node
    full = grid.join(num.select(*node, "num", "label", "n"), [*node, "num", "label"], "left").fillna(0, ["n"])
    w = Window.partitionBy(*node, "label").orderBy("num").rowsBetween(Window.unboundedPreceding, 0)
    cum = full.select(*node, "num", "label", F.sum("n").over(w).alias("le")).join(lab, [*node, "label"])
    x = F.col("le").cast("double")
    y = (F.col("ln") - F.col("le")).cast("double")

    def part(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(c > 0, c * F.log2(c))), F.lit(0.0))

    def whole(c: Column) -> Column:
        s = F.sum(c)
        return F.when(s > 0, s * F.log2(s)).otherwise(0.0)

    spl = cum.groupBy(*node, "num").agg((whole(x) - part(x) + whole(y) - part(y)).alias("w"))
    first = per.filter(F.col("num").isNotNull()).select(*node, "num", "first_rid")
    spl = spl.join(first, [*node, "num"]).withColumnRenamed("num", "alpha")
    both = cat.unionByName(spl).join(h, node).join(raw, node)
    # compared to twelve digits, so the order of summation decides no tie
    gain = F.round(F.col("h") - F.col("w") / F.col("t"), 12)
    own = F.log2(F.col("t").cast("double")) - F.col("vlogv") / F.col("t")
    ratio = F.when(F.round(own, 12) > 0, F.round(gain / own, 12)).when(gain > 0, F.lit(float("inf"))).otherwise(0.0)
    return both.select(*keys, "attr", "alpha", gain.alias("gain"), ratio.alias("ratio"), "first_rid")


def best_splits(g: DataFrame, keys: Sequence[str], attrs: Sequence[str], threshold: float, use_ratio: bool) -> DataFrame:
    """The winner of each node: greatest gain (or ratio), which must exceed the threshold; ties go to the first attribute, then to the value seen first."""
    score = "ratio" if use_ratio else "gain"
    pos = F.element_at(F.create_map(*[F.lit(v) for i, a in enumerate(attrs) for v in (a, i)]), F.col("attr"))
    ok = g.filter((F.col(score) > threshold) & ~F.isnan(score))
    # the best split of a numeric attribute is the one with the greatest gain; then attributes compete by the score
    inner = Window.partitionBy(*keys, "attr").orderBy(F.desc("gain"), "first_rid")
    outer = Window.partitionBy(*keys).orderBy(F.desc(score), "_pos")
    one = ok.withColumn("_r", F.row_number().over(inner)).filter("_r = 1").withColumn("_pos", pos)
    return one.withColumn("_r", F.row_number().over(outer)).filter("_r = 1").select(*keys, "attr", "alpha", score)


# -- subtrees that fit into one task -----------------------------------------


def _nlogn(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log2(np.maximum(x, 1)), 0.0)


def _local_split(b: pd.DataFrame, y: np.ndarray, k: int, attrs: Sequence[str], numeric: set[str], threshold: float, use_ratio: bool):
    """(attr, alpha) as ``best_splits`` picks it, from the node's rows; None if no split exceeds the threshold."""
    best = None
    rid = b["_rid"].to_numpy()
    for a in attrs:
        col = b[a]
        if a in numeric:
            x = col.to_numpy(dtype=np.float64)
            ok = ~np.isnan(x)
            x, yy, rr = x[ok], y[ok], rid[ok]
            if not len(x):
                continue
            values, inv = np.unique(x, return_inverse=True)
        else:
            inv, values = pd.factorize(col, use_na_sentinel=False)
            yy, rr = y, rid
        n = np.bincount(inv * k + yy, minlength=len(values) * k).reshape(-1, k).astype(np.float64)
        vn, t = n.sum(1), float(len(yy))
        h = (_nlogn(np.array([t]))[0] - _nlogn(n.sum(0)).sum()) / t
        vlogv = _nlogn(vn).sum()
        if a in numeric:
            le = np.cumsum(n, axis=0)
            gt = n.sum(0) - le
            w = _nlogn(le.sum(1)) - _nlogn(le).sum(1) + _nlogn(gt.sum(1)) - _nlogn(gt).sum(1)
            first = np.full(len(values), np.iinfo(np.int64).max)
            np.minimum.at(first, inv, rr)
        else:
            w = np.array([vlogv - _nlogn(n).sum()])
            first = np.array([0])
        gain = np.round(h - w / t, 12)
        own = np.log2(t) - vlogv / t
        ratio = np.round(gain / own, 12) if round(own, 12) > 0 else np.where(gain > 0, np.inf, 0.0)
        score = ratio if use_ratio else gain
        ok = np.flatnonzero(score > threshold)
        if not len(ok):
            continue
        i = ok[np.lexsort((first[ok], -gain[ok]))[0]]
        if best is None or score[i] > best[0]:
            best = (score[i], a, float(values[i]) if a in numeric else None)
    return None if best is None else best[1:]


def grow_local(b: pd.DataFrame, attrs: Sequence[str], left: Sequence[str], numeric: set[str], domains: dict[str, list], threshold: float, use_ratio: bool, depth: int, max_depth: int | None, only_present: bool) -> list:
    """A whole subtree from the rows (_rid, attributes, _label) of its root: nodes as [decision, p, var, edges], children by position."""
    nodes: list = []

    def leaf_of(rows: pd.DataFrame) -> tuple[str, float, int]:
        c = rows["_label"].value_counts()
        top = min(c.index, key=lambda x: (-c[x], x))
        return str(top), float(c[top] / len(rows)), len(c)

    todo = [(b, list(left), depth, None)]
    nodes.append(None)
    at = 0
    while at < len(todo):
        rows, mine, dep, parent = todo[at]
        if not len(rows):
            nodes[at] = [parent[0], parent[1], None, []]
            at += 1
            continue
        top, p, labels = leaf_of(rows)
        nodes[at] = [top, p, None, []]
        if labels > 1 and mine and (max_depth is None or dep < max_depth):
            y, names = pd.factorize(rows["_label"])
            won = _local_split(rows, y, len(names), mine, numeric, threshold, use_ratio if dep == 0 or use_ratio != "root" else False)
            if won:
                a, alpha = won
                nodes[at][2] = a
                if alpha is not None:
                    x = rows[a].to_numpy(dtype=np.float64)
                    parts = [("<=", alpha, rows[x <= alpha], mine), (">", alpha, rows[x > alpha], mine)]
                else:
                    text = rows[a].astype("string")
                    rest = [m for m in mine if m != a]
                    parts = [("=", v, rows[(text == str(v)).fillna(False).to_numpy(dtype=bool)], rest) for v in domains[a]]
                    parts = [x for x in parts if len(x[2])] if only_present else parts
                for op, v, sub, rest in parts:
                    nodes[at][3].append([op, v, len(todo)])
                    todo.append((sub, rest, dep + 1, (top, p)))
                    nodes.append(None)
        todo[at] = None
        at += 1
    return nodes


@dataclass
class TreeModel:
    """Trees by number: nodes by id, the root being 0."""

    trees: dict[int, dict[int, Node]]
    numeric: set[str]

    def node_rows(self) -> list[tuple]:
        """(tree_id, node_id, parent_id, op, edge_value, var, decision, p, depth)"""
        out = []
        for t, nodes in sorted(self.trees.items()):
            todo = [(0, None, None, None, 0)]
            while todo:
                i, parent, op, value, depth = todo.pop()
                n = nodes[i]
                out.append((t, i, parent, op, value, n.var, n.decision, n.p, depth))
                todo += [(c, i, o, v, depth + 1) for o, v, c in reversed(n.edges)]
        return out

    def to_frame(self, spark) -> DataFrame:
        rows = [(*r[:4], None if r[4] is None else str(r[4]), *r[5:]) for r in self.node_rows()]
        return spark.createDataFrame(rows, "tree_id int, node_id int, parent_id int, op string, edge_value string, var string, decision string, p double, depth int")

    def to_json(self, dataset: str, tree: int = 0) -> str:
        """The nested form {dataset, node: {var, edges: [{edge: {value, node or leaf}}]}}."""
        nodes = self.trees[tree]

        def build(i: int) -> dict:
            n = nodes[i]
            if n.var is None:
                return {"leaf": {"decision": n.decision, "p": n.p}}
            return {"node": {"var": n.var, "edges": [{"edge": {"value": str(v) if o == "=" else f"{o}{v}", **build(c)}} for o, v, c in n.edges]}}

        return json.dumps({"dataset": dataset, **build(0)}, indent=1)

    @classmethod
    def from_json(cls, text: str) -> TreeModel:
        """Reads the nested form; edges ``<=a`` and ``>a`` are numeric."""
        nodes: dict[int, Node] = {}
        numeric: set[str] = set()

        def read(d: dict) -> int:
            i = len(nodes)
            if "leaf" in d:
                nodes[i] = Node(str(d["leaf"]["decision"]), float(d["leaf"].get("p", 1)))
                return i
            n = nodes[i] = Node("", 0.0, d["node"]["var"])
            for e in d["node"]["edges"]:
                e = e.get("edge", e)
                v = str(e["value"])
                op = "<=" if v.startswith("<=") else ">" if v.startswith(">") else "="
                if op != "=":
                    numeric.add(n.var)
                n.edges.append((op, v if op == "=" else float(v[len(op) :]), read(e)))
            return i

        read(json.loads(text))
        return cls({0: nodes}, numeric)

    def column(self, tree: int = 0, default: str = "majority") -> Column:
        """The tree as one expression.  A value without an edge gives the node's majority label, or NULL with ``default="null"``."""
        nodes = self.trees[tree]

        def build(i: int) -> Column:
            n = nodes[i]
            if n.var is None:
                return F.lit(n.decision)
            out = F.lit(n.decision or None).cast("string") if default == "majority" else F.lit(None).cast("string")
            for op, v, c in reversed(n.edges):
                x = F.col(n.var)
                hit = x <= v if op == "<=" else x > v if op == ">" else (x.isNull() if v is None else x.cast("string") == v)
                out = F.when(hit, build(c)).otherwise(out)
            return out

        return build(0)

    def _walk(self, tree: int, cols: dict, n: int, default: str) -> np.ndarray:
        """The decisions for ``n`` rows given as arrays: rows move down the tree together."""
        nodes = self.trees[tree]
        out = np.empty(n, dtype=object)
        todo = [(0, np.arange(n))]
        while todo:
            i, idx = todo.pop()
            if not len(idx):
                continue
            node = nodes[i]
            if node.var is None:
                out[idx] = node.decision
                continue
            x = cols[node.var][idx]
            rest = np.ones(len(idx), dtype=bool)
            for op, v, c in node.edges:
                hit = rest & ((x <= v) if op == "<=" else (x > v) if op == ">" else (x == v))
                todo.append((c, idx[hit]))
                rest &= ~hit
            out[idx[rest]] = (node.decision or None) if default == "majority" else None
        return out

    def _udf(self, df: DataFrame, trees: Sequence[int], default: str, vote: bool) -> Column:
        """The decision as an Arrow-batched function, for models too large for generated code; the model is broadcast."""
        used = sorted({n.var for t in trees for n in self.trees[t].values() if n.var is not None})
        shared = df.sparkSession.sparkContext.broadcast(self)
        nums = [v in self.numeric for v in used]

        @F.pandas_udf("string")
        def run(s: pd.DataFrame) -> pd.Series:
            m = shared.value
            cols = {v: (s.iloc[:, i].to_numpy(dtype=np.float64) if nums[i] else s.iloc[:, i].to_numpy(dtype=object)) for i, v in enumerate(used)}
            votes = [m._walk(t, cols, len(s), default) for t in trees]
            if not vote:
                return pd.Series(votes[0])
            table = np.stack(votes, axis=1)
            out = []
            for row in table:
                c: dict = {}
                for v in row:
                    if v is not None:
                        c[v] = c.get(v, 0) + 1
                out.append(min(c, key=lambda v: (-c[v], v)) if c else None)
            return pd.Series(out, dtype=object)

        cells = [F.col(f"`{v}`").cast("double" if v in self.numeric else "string").alias(f"c{i}") for i, v in enumerate(used)]
        return run(F.struct(*(cells or [F.lit(0).alias("c")])))

    def transform(self, df: DataFrame, pred: str = "pred", tree: int = 0, default: str = "majority", most_nodes: int = 100) -> DataFrame:
        """``df`` with the tree's decision: one expression in generated code up to ``most_nodes`` nodes, beyond that an Arrow function.  No join, no shuffle."""
        small = len(self.trees[tree]) <= most_nodes
        return df.withColumn(pred, self.column(tree, default) if small else self._udf(df, [tree], default, False))

    def by_number(self, df: DataFrame, number: str, pred: str = "pred") -> DataFrame:
        """Each row judged by the tree whose number it names."""
        used = sorted({n.var for nodes in self.trees.values() for n in nodes.values() if n.var is not None})
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("string")
        def run(s: pd.DataFrame) -> pd.Series:
            m, no = shared.value, s.iloc[:, 0].to_numpy()
            out = np.empty(len(s), dtype=object)
            for t in np.unique(no):
                on = no == t
                cols = {v: s.iloc[:, i + 1].to_numpy(dtype=np.float64 if v in m.numeric else object)[on] for i, v in enumerate(used)}
                out[on] = m._walk(int(t), cols, int(on.sum()), "majority")
            return pd.Series(out)

        cells = [F.col(f"`{v}`").cast("double" if v in self.numeric else "string").alias(f"c{i}") for i, v in enumerate(used)]
        return df.withColumn(pred, run(F.struct(F.col(number).alias("t"), *cells)))

    def vote(self, df: DataFrame, pred: str = "pred") -> DataFrame:
        """The label most trees decide for, the smallest on ties; no shuffle."""
        return df.withColumn(pred, self._udf(df, sorted(self.trees), "majority", True))


def grow(
    df: DataFrame,
    attrs: Sequence[str],
    label: str,
    threshold: float = 0.0,
    use_ratio: bool = False,
    ratio_scope: str = "all",
    tree_attrs: dict[int, Sequence[str]] | None = None,
    domains: dict[str, list] | None = None,
    max_depth: int | None = None,
    only_present: bool = False,
    local_rows: int = LOCAL_ROWS,
) -> TreeModel:
    """Grow the trees of ``df``, which has the columns _tree (INT), _rid (BIGINT, row order), attributes and label.

    A node is a leaf if it is pure, has no attribute left or no gain above the
    threshold, or at ``max_depth``, if that is given.  Categorical attributes split into all values of ``domains``
    (default: of the data; ``only_present``: of the node) and are used once a
    path; an empty branch gets its parent's majority.  Numeric attributes
    (numeric columns) split in two and may be used again.  Majority ties go to
    the smaller label.  ``ratio_scope="root"`` uses the ratio at the root only.
    Nodes of at most ``local_rows`` rows leave the level loop: their subtrees
    are grown by the same rules in one task each, all at once.
    """
    attrs = list(attrs)
    numeric = {a for a in attrs if is_numeric(df, a)}
    if max_depth is None and threshold < 0 and numeric:
        raise ValueError("splits that part nothing would never end: a threshold below 0 needs max_depth")
    cats = [a for a in attrs if a not in numeric]
    domains = levels(df, cats, most=10_000) if domains is None else domains
    rows = df.filter(F.col(label).isNotNull()).select("_tree", "_rid", *attrs, F.col(label).cast("string").alias("_label"))
    cur = materialize(rows.withColumn("_node", F.lit(0)))
    trees: dict[int, dict[int, Node]] = defaultdict(dict)
    left: dict[tuple[int, int], list[str]] = {}
    frontier = {(t, 0) for t in (tree_attrs or {0: attrs})}
    for t, _ in frontier:
        left[t, 0] = list((tree_attrs or {0: attrs})[t])
    for depth in itertools.count():
        labels: dict[tuple[int, int], dict[str, int]] = defaultdict(dict)
        for r in cur.groupBy("_tree", "_node", "_label").agg(F.count("*").alias("n")).collect():  # open nodes x labels
            labels[r["_tree"], r["_node"]][r["_label"]] = r["n"]
        open_nodes, small = [], []
        for key in sorted(frontier):
            c = labels.get(key)
            if not c:
                continue
            best = min(c, key=lambda x: (-c[x], x))
            trees[key[0]][key[1]] = Node(best, c[best] / sum(c.values()))
            if len(c) > 1 and left[key] and (max_depth is None or depth < max_depth):
                (small if sum(c.values()) <= local_rows else open_nodes).append(key)
        if small:
            _finish(cur, small, trees, left, attrs, numeric, domains, threshold, (ratio_scope if ratio_scope == "root" else True) if use_ratio else False, depth, max_depth, only_present)
        if not open_nodes:
            break
        spark = df.sparkSession
        keep = spark.createDataFrame([(t, n, a) for t, n in open_nodes for a in left[t, n]], "_tree int, _node int, attr string")
        nodes = F.broadcast(keep.select("_tree", "_node").distinct())  # the open nodes of a level
        used = sorted({a for k in open_nodes for a in left[k]}, key=attrs.index)
        counts = value_counts(cur.join(nodes, ["_tree", "_node"], "left_semi"), ["_tree", "_node"], used, "_label").join(F.broadcast(keep), ["_tree", "_node", "attr"], "left_semi")
        counts = materialize(counts)
        ratio = use_ratio and (ratio_scope == "all" or depth == 0)
        win = best_splits(gains(counts, ["_tree", "_node"]), ["_tree", "_node"], attrs, threshold, ratio).collect()
        release(counts)
        frontier, moves = set(), []
        ids = {t: max(nodes_) for t, nodes_ in trees.items()}
        present = None
        if only_present and any(w["alpha"] is None for w in win):
            present = defaultdict(set)
        for w in sorted(win, key=lambda w: (w["_tree"], w["_node"])):
            t, n, a = w["_tree"], w["_node"], w["attr"]
            node = trees[t][n]
            node.var = a
            branches = [("<=", w["alpha"]), (">", w["alpha"])] if w["alpha"] is not None else [("=", v) for v in domains[a]]
            for op, v in branches:
                ids[t] += 1
                node.edges.append((op, v, ids[t]))
                frontier.add((t, ids[t]))
                left[t, ids[t]] = list(left[t, n]) if a in numeric else [x for x in left[t, n] if x != a]
                moves.append((t, n, a, op, v if op == "=" else None, v if op != "=" else None, ids[t]))
                # stands unless rows arrive: the parent's majority
                trees[t][ids[t]] = Node(node.decision, node.p)
        if not moves:
            break
        steps = F.broadcast(spark.createDataFrame(moves, "_tree int, _node int, _a string, _op string, _v string, _alpha double, _child int"))
        value = F.element_at(F.create_map(*[x for a in attrs for x in (F.lit(a), F.col(a).cast("string"))]), F.col("_a"))
        number = F.element_at(F.create_map(*[x for a in attrs for x in (F.lit(a), F.col(a).cast("double") if a in numeric else F.lit(None).cast("double"))]), F.col("_a"))
        j = cur.join(steps, ["_tree", "_node"])
        hit = ((F.col("_op") == "=") & (value == F.col("_v"))) | ((F.col("_op") == "<=") & (number <= F.col("_alpha"))) | ((F.col("_op") == ">") & (number > F.col("_alpha")))
        new = materialize(j.filter(hit).select("_tree", "_rid", *attrs, "_label", F.col("_child").alias("_node")))
        release(cur)
        cur = new
        if only_present:
            got = {(r["_tree"], r["_node"]) for r in cur.select("_tree", "_node").distinct().collect()}
            for t, n, *_ in moves:
                trees[t][n].edges = [e for e in trees[t][n].edges if (t, e[2]) in got]
    release(cur)
    return TreeModel(dict(trees), numeric)


def _finish(cur: DataFrame, keys: list, trees: dict, left: dict, attrs, numeric, domains, threshold, use_ratio, depth: int, max_depth: int | None, only_present: bool) -> None:
    """Grow the subtrees of the given nodes, one task each, and hang them in."""
    spark = cur.sparkSession
    want = spark.createDataFrame([(t, n, left[t, n]) for t, n in keys], "_tree int, _node int, _left array<string>")

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        mine = list(b["_left"].iloc[0])
        nodes = grow_local(b, attrs, mine, numeric, domains, threshold, use_ratio, depth, max_depth, only_present)
        return pd.DataFrame([(key[0], key[1], json.dumps(nodes))], columns=["_tree", "_node", "nodes"])

    got = cur.join(F.broadcast(want), ["_tree", "_node"]).groupBy("_tree", "_node").applyInPandas(run, "_tree int, _node int, nodes string")
    for r in sorted(got.collect(), key=lambda r: (r["_tree"], r["_node"])):  # the model itself
        nodes, mine = json.loads(r["nodes"]), trees[r["_tree"]]
        first = max(mine) + 1
        number = [r["_node"], *range(first, first + len(nodes) - 1)]
        for i, (dec, p, var, edges) in enumerate(nodes):
            mine[number[i]] = Node(dec, p, var, [(op, v, number[c]) for op, v, c in edges])


def c45(df: DataFrame, attrs: Sequence[str], label: str, threshold: float = 0.0, use_ratio: bool = False, rid: str | None = None, **more) -> TreeModel:
    """One tree; ``rid`` is the column of the row order that breaks ties of numeric splits (default: the order of all columns)."""
    rows = df.withColumn("_rid", F.col(rid).cast("bigint")) if rid else with_rid(df.select(*attrs, label), [*attrs, label])
    return grow(rows.withColumn("_tree", F.lit(0)), attrs, label, threshold, use_ratio, **more)


def forest(df: DataFrame, attrs: Sequence[str], label: str, n_attrs: int, n_rows: int, n_trees: int, threshold: float = 0.0, use_ratio: bool = False, key: Sequence[str] | None = None, seed: int = 0) -> TreeModel:
    """A random forest: each tree has its own ``n_attrs`` attributes and ``n_rows`` rows drawn with replacement; all trees grow together."""
    order = [F.col(c).alias(f"_order{i}") for i, c in enumerate(key or [*attrs, label])]
    rows = df.filter(F.col(label).isNotNull()).select(*order, *attrs, label)
    rows = materialize(with_rid(rows, [f"_order{i}" for i in range(len(order))]))
    n = rows.count()
    drawn = bootstrap(rows, "_rid", n, n_rows, seed, n_trees).withColumnRenamed("sample", "_tree")
    chosen = {t: sorted(sample_columns(attrs, min(n_attrs, len(attrs)), seed * 1000 + t), key=list(attrs).index) for t in range(n_trees)}
    cats = [a for a in attrs if not is_numeric(df, a)]
    return grow(drawn, attrs, label, threshold, use_ratio, tree_attrs=chosen, domains=levels(rows, cats, most=10_000))


def cross_validate(df: DataFrame, attrs: Sequence[str], label: str, folds: DataFrame, key: str, threshold: float = 0.0, use_ratio: bool = False) -> DataFrame:
    """(key, fold, obs, pred): each row judged by the tree grown without its fold.  ``folds``: key and fold (from 1).

    The trees of all folds grow together, so the training rows are held k - 1
    times; leave-one-out, as many folds as rows, is meant for small tables.
    """
    rows = df.select(F.col(key).alias("_key"), *attrs, label).join(folds.select(F.col(key).alias("_key"), "fold"), "_key")
    rows = materialize(rows.withColumn("_rid", F.xxhash64("_key")))
    k = rows.agg(F.max("fold")).first()[0]
    if k is None:
        return rows.select(F.col("_key").alias(key), "fold", F.col(label).cast("string").alias("obs"), F.lit(None).cast("string").alias("pred")).limit(0)
    train = rows.withColumn("_tree", F.explode(F.sequence(F.lit(1), F.lit(int(k))))).filter(F.col("_tree") != F.col("fold")).withColumn("_tree", F.col("_tree").cast("int"))
    cats = [a for a in attrs if not is_numeric(df, a)]
    model = grow(train, attrs, label, threshold, use_ratio, tree_attrs={t: list(attrs) for t in range(1, int(k) + 1)}, domains=levels(rows, cats, most=10_000))
    return model.by_number(rows, "fold").select(F.col("_key").alias(key), "fold", F.col(label).cast("string").alias("obs"), "pred")
