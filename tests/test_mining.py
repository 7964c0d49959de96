"""Mining operators against brute force and known results."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from minespark.functions.stem import stem
from minespark.operators import assoc, bayes, clustering, components, evaluate, neighbours, pagerank, prep, recommend, svm, text, tree


def baskets(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "tid int, items array<int>")


def brute_sets(rows, s):
    n, items = len(rows), sorted({i for r in rows for i in r})
    out = {}
    for k in range(1, len(items) + 1):
        for c in itertools.combinations(items, k):
            m = sum(set(c) <= set(r) for r in rows)
            if (m / n > s) if k == 1 else (m / n >= s and all((x,) in out for x in c)):
                out[c] = m
    return out


@pytest.mark.parametrize("engine", ["fpgrowth", "levelwise"])
def test_itemsets_against_brute_force(spark, engine):
    rng = random.Random(4)
    rows = [[rng.randrange(6) for _ in range(rng.randrange(5))] for _ in range(40)]
    sets, n = assoc.frequent_itemsets(baskets(spark, rows), 0.15, engine)
    got = {tuple(r.items): r.n for r in sets.collect()}
    want = brute_sets(rows, 0.15)
    assert n == 40 and got == want
    top = {tuple(r[0]) for r in assoc.maximal_itemsets(sets).select("items").collect()}
    assert top == {a for a in want if not any(set(a) < set(b) for b in want)}
    for r in assoc.rules(sets, n, 0.5).collect():
        both = tuple(sorted([*r.antecedent, r.consequent]))
        assert r.support == pytest.approx(want[both] / 40) and r.confidence == pytest.approx(want[both] / want[tuple(r.antecedent)]) and r.confidence >= 0.5


def test_item_at_exactly_the_threshold_is_not_frequent(spark):
    sets, _ = assoc.frequent_itemsets(baskets(spark, [[1, 2], [1, 2], [1], [1]]), 0.5)
    assert [tuple(r.items) for r in sets.collect()] == [(1,)]


def test_rule_text_and_support(spark):
    b = baskets(spark, [[1, 2], [1, 2], [1], []])
    sets, n = assoc.frequent_itemsets(b, 0.1)
    names = spark.createDataFrame([(1, "tea"), (2, "bun")], "id int, name string")
    t = sorted(r.text for r in assoc.rule_text(assoc.rules(sets, n, 0.6), names).collect())
    assert t == ["bun ---> tea [sup = 0.50000, conf = 1.00000]", "tea ---> bun [sup = 0.50000, conf = 0.66667]"]
    s = assoc.support_of(b, spark.createDataFrame([([1, 2],), ([3],)], "items array<int>")).collect()
    assert {tuple(r.items): r.n for r in s} == {(1, 2): 2, (3,): 0}
    assert assoc.frequent_itemsets(b.limit(0), 0.1)[0].count() == 0


def balloons(spark):
    rows = [(c, s, a, g, "T" if a == "STRETCH" or g == "ADULT" else "F") for c in ("YELLOW", "PURPLE") for s in ("SMALL", "LARGE") for a in ("STRETCH", "DIP") for g in ("ADULT", "CHILD")]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_rid long, Color string, Size string, Act string, Age string, Inflated string")


@pytest.mark.parametrize("local_rows", [0, 1000])
def test_tree_takes_the_first_of_equal_attributes(spark, local_rows):
    m = tree.c45(balloons(spark), ["Color", "Size", "Act", "Age"], "Inflated", rid="_rid", local_rows=local_rows)
    t = m.trees[0]
    assert t[0].var == "Act"
    kids = {v: t[c] for _, v, c in t[0].edges}
    assert kids["STRETCH"].decision == "T" and kids["STRETCH"].p == 1 and kids["DIP"].var == "Age"
    assert m.transform(balloons(spark)).filter("pred <> Inflated").count() == 0
    again = tree.TreeModel.from_json(m.to_json("x"))
    assert again.transform(balloons(spark)).filter("pred <> Inflated").count() == 0
    big = m.transform(balloons(spark), most_nodes=0)
    assert big.filter("pred <> Inflated").count() == 0
    unseen = spark.createDataFrame([("YELLOW", "SMALL", "OTHER", "ADULT")], "Color string, Size string, Act string, Age string")
    assert m.transform(unseen).first().pred == "T" and m.transform(unseen, default="null").first().pred is None
    assert m.transform(unseen, default="null", most_nodes=0).first().pred is None
    assert m.to_frame(spark).count() == len(t)


def numbers(spark, n=120, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, c = rng.randrange(12), rng.choice([None, 1.5, 2.5, 7.0]), rng.choice(["u", "v", None])
        rows.append((i, x, y, c, "p" if x > 6 and c == "u" else "q" if (y or 0) > 2 else "r"))
    return spark.createDataFrame(rows, "_rid long, x int, y double, c string, label string")


@pytest.mark.parametrize("kw", [{}, {"use_ratio": True}, {"use_ratio": True, "ratio_scope": "root"}, {"only_present": True, "threshold": 0.05}])
def test_local_and_distributed_growth_agree(spark, kw):
    df = numbers(spark)
    a = tree.c45(df, ["x", "y", "c"], "label", rid="_rid", max_depth=3, **kw)
    b = tree.c45(df, ["x", "y", "c"], "label", rid="_rid", max_depth=3, local_rows=0, **kw)
    assert a.to_json("d") == b.to_json("d")


def test_forest_and_cross_validation(spark):
    df = numbers(spark).drop("_rid").withColumn("id", F.monotonically_increasing_id())
    f = tree.forest(df, ["x", "y", "c"], "label", 2, 80, 3, key=["id"], seed=1)
    got = f.vote(df)
    assert got.filter("pred IS NULL").count() == 0
    assert evaluate.overall(got, "label", "pred").first().accuracy > 0.6
    folds = prep.k_folds(df.select("id"), "id", 4)
    cv = tree.cross_validate(df, ["x", "y", "c"], "label", folds, "id")
    assert cv.count() == df.count() and cv.filter("pred IS NULL").count() == 0


def test_entropy_by_hand(spark):
    c = tree.value_counts(balloons(spark).withColumn("g", F.lit(0)), ["g"], ["Act", "Color"], "Inflated")
    g = {r.attr: r.gain for r in tree.gains(c, ["g"]).collect()}
    h = -(0.75 * math.log2(0.75) + 0.25 * math.log2(0.25))
    assert g["Color"] == 0 and g["Act"] == pytest.approx(h - 0.5, abs=1e-9)


def test_bayes(spark):
    df = spark.createDataFrame([("a", "x", "1"), ("a", "y", "1"), ("b", "x", "0"), ("b", None, "0"), ("b", "x", None)], "u string, v string, l string")
    m = bayes.fit(df, ["u", "v"], "l")
    got = [r.pred for r in bayes.predict(df, m).collect()]
    assert got[:3] == ["1", "1", "0"]
    assert bayes.predict(spark.createDataFrame([("zz", "zz")], "u string, v string"), m).first().pred == "0"  # all products are 0: smallest label


def test_svm(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    y = np.where(x[:, 0] - x[:, 1] > 0, 1.0, -1.0)
    w = np.array([-1.0, 0, 0])
    u = np.column_stack([x, -np.ones(60)])
    for _ in range(30):
        bad = y * (u @ w) <= 1
        w = w - 0.01 * (w + 2 * (-(y[bad, None] * u[bad])).sum(0))
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    assert svm.fit(df, ["a", "b"], "y", 0.01, 30) == pytest.approx(w.tolist())
    assert svm.predict(df, ["a", "b"], w, -1).filter("pred = y").count() > 55


def test_knn_ties_and_few_candidates(spark):
    df = spark.createDataFrame([(1, [0.0], "b"), (2, [1.0], "a"), (3, [-1.0], "b"), (4, [9.0], "a"), (5, None, "a")], "id long, v array<double>, l string")
    near = neighbours.nearest(df, df, "id", "v", 2, payload="l")
    got = {r["query"]: r.neighbour for r in near.filter("rank = 1").collect()}
    assert got == {1: 2, 2: 1, 3: 1, 4: 2}
    assert {r["query"]: r.pred for r in neighbours.classify(near, 2).collect()}[1] == "a"
    assert {r["query"]: r.pred for r in neighbours.classify(near, 2, "nearest").collect()}[2] == "b"
    assert neighbours.nearest(df, df, "id", "v", 50).filter("query = 1").count() == 3


def test_standardize_one_hot_impute(spark):
    df = spark.createDataFrame([(1.0, 5.0, "a"), (3.0, 5.0, "b"), (None, 5.0, None)], "x double, k double, s string")
    z = prep.standardize(df, ["x", "k"]).collect()
    assert z[0].x == pytest.approx(-math.sqrt(0.5)) and z[0].k is None and z[2].x is None
    assert prep.one_hot(df).columns == ["x", "k", "s_a", "s_b"] and [tuple(r)[2:] for r in prep.one_hot(df).collect()] == [(1, 0), (0, 1), (0, 0)]
    assert prep.impute(df, ["x", "s"]).collect()[2][:] == (2.0, 5.0, "a")
    assert prep.restrict(df, [1, 0], always=["s"]).columns == ["s", "x"]
    assert sorted(r.n for r in prep.k_folds(spark.range(10), "id", 4).groupBy("fold").agg(F.count("*").alias("n")).collect()) == [2, 2, 3, 3]
    assert [r._rid for r in prep.with_rid(spark.range(50), ["id"]).orderBy("id").collect()] == list(range(50))


def brute_kmeans(x, k):
    m = x.mean(0)
    d = np.sqrt(((x - m) ** 2).sum(1))
    chosen = [int(np.argmax(np.round(d, 10)))]
    s = np.zeros(len(x))
    while len(chosen) < k:
        s = s + np.sqrt(((x - x[chosen[-1]]) ** 2).sum(1))
        t = np.round(s, 10)
        t[chosen] = -1
        chosen.append(int(np.argmax(t)))
    c, last = x[chosen], None
    while True:
        dist = np.sqrt(((x[:, None] - c[None]) ** 2).sum(2))
        a = dist.argmin(1)
        new = np.array([x[a == j].mean(0) if (a == j).any() else np.zeros(x.shape[1]) for j in range(k)])
        if (last is not None and (a == last).all()) or np.allclose(new, c):
            return a, dist.min(1)
        last, c = a, new


def test_kmeans_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.round(np.concatenate([rng.normal(c, 0.5, (15, 2)) for c in ((0, 0), (4, 0), (0, 5))]), 3)
    p = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(x)], "rid long, v array<double>")
    m = clustering.kmeans(p, 3)
    a, e = brute_kmeans(x, 3)
    got = m.assigned.orderBy("rid").collect()
    assert [r.cluster for r in got] == a.tolist() and [r.err for r in got] == pytest.approx(e.tolist())
    assert clustering.cluster_stats(m.assigned).agg(F.sum("n")).first()[0] == 45
    assert clustering.kmeans(p.limit(0), 3).assigned.count() == 0


def brute_dbscan(x, eps, mp):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    nb = (d > 0) & (d <= eps)
    core = nb.sum(1) >= mp
    lab = np.full(len(x), -1)
    c = 0
    for i in np.flatnonzero(core):
        if lab[i] >= 0 and core[i] and any(lab[i] == lab[j] for j in range(i) if core[j]):
            continue
        todo, seen = [i], {i}
        while todo:
            j = todo.pop()
            if lab[j] < 0 or core[j]:
                lab[j] = c if lab[j] < 0 else lab[j]
            if core[j]:
                for t in np.flatnonzero(nb[j]):
                    if t not in seen:
                        seen.add(t)
                        if lab[t] < 0:
                            lab[t] = c
                        if core[t]:
                            todo.append(t)
        c += 1
    return lab, core


def test_dbscan_against_growth(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (70, 2)).astype(float)
    p = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(x)], "rid long, v array<double>")
    got = clustering.dbscan(p, 1.0, 3).orderBy("rid").collect()
    lab, core = brute_dbscan(x, 1.0, 3)
    assert [r.cluster for r in got] == lab.tolist()
    assert [r.kind == "core" for r in got] == core.tolist()
    assert clustering.dbscan(p.limit(0), 1.0, 3).count() == 0


def test_linkage_cut_and_limits(spark):
    x = np.array([[0.0], [1.0], [5.0], [6.5], [20.0]])
    t = clustering.linkage(x)
    assert [(a, b) for a, b, *_ in t.merges] == [(0, 1), (2, 3), (5, 6), (7, 4)]
    assert t.merges[2][3] == pytest.approx(np.mean([5, 6.5, 4, 5.5]))
    assert t.cut(3, "nclust") == [[0, 1], [2, 3], [4]] or sorted(map(sorted, t.cut(3, "nclust"))) == [[0, 1], [2, 3], [4]]
    assert len(t.cut(100, "nclust")) == 5 and t.cut(1e9) == [t.leaves(t.root)]
    assert t.heights() == sorted(t.heights(), reverse=True)
    parts, out = t.cut_without_outliers(2)
    assert out == [4] and sorted(map(sorted, parts)) == [[0, 1], [2, 3]]
    assert clustering.linkage(x, "single").merges[2][3] == pytest.approx(4) and clustering.linkage(x, "complete").merges[2][3] == pytest.approx(6.5) and clustering.linkage(x, "centroid").merges[2][3] == pytest.approx(5.25)
    with pytest.raises(ValueError):
        clustering.hclust(spark.range(30).select(F.col("id").cast("double").alias("x")), ["x"], max_points=20)


def test_components(spark):
    rng = random.Random(6)
    e = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1400)] + [(5000, j) for j in range(5001, 5200)] + [(7, 7), (9000, 9000)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in e:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(e + [(None, 1), (2, None)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    assert got == {n: find(n) for n in parent}
    assert components.connected_components(df.limit(0)).count() == 0


def test_recommendation_by_hand(spark):
    r = recommend.ratings_of(spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0), (2, 1, 5.0), (2, 2, 1.0), (2, 3, 3.0), (3, 1, 1.0), (3, 3, 5.0), (3, 2, 99.0)], "u int, i int, r double"), "u", "i", "r")
    assert r.count() == 7
    s = {(x.a, x.b): x.sim for x in recommend.similarity(r).collect()}
    c = {1: {1: 1.0, 2: -1.0}, 2: {1: 2.0, 2: -2.0, 3: 0.0}, 3: {1: -2.0, 3: 2.0}}
    n = {u: math.sqrt(sum(v * v for v in d.values())) for u, d in c.items()}
    assert s[1, 2] == pytest.approx(4 / (n[1] * n[2])) and s[2, 3] == pytest.approx(-4 / (n[2] * n[3]))
    t = spark.createDataFrame([(1, 3), (9, 1)], "user int, item int")
    got = {x.user: x.pred for x in recommend.recommend(r, t, "user-weighted-sum").collect()}
    assert got[1] == pytest.approx(max(-10, min(10, (3 * s[1, 2] + 5 * s[1, 3]) / (s[1, 2] + s[1, 3]))))
    adj = {x.user: x.pred for x in recommend.recommend(r, t, "user-adjusted-weighted-sum").collect()}
    assert adj[1] == pytest.approx(max(-10, min(10, 3 + (0 * s[1, 2] + 2 * s[1, 3]) / (s[1, 2] + s[1, 3]))))
    assert {x.user: x.pred for x in recommend.recommend(r, t, "item-mean-utility").collect()}[1] == pytest.approx(3.0)
    for m in recommend.METHODS:
        assert recommend.recommend(r, recommend.all_cells(r), m).count() == 9
    assert recommend.evaluate_list(r, t.limit(1), "user-mean-utility").count() == 0


def test_samples_and_splits(spark):
    r = recommend.ratings_of(spark.createDataFrame([(u, i, float(u + i)) for u in range(8) for i in range(5) if (u * i) % 3], "u int, i int, r double"), "u", "i", "r")
    assert recommend.sample_cells(r, 7, 1).count() == 7 and recommend.sample_any(r, 9, 1).count() == 9
    a, b = prep.holdout(spark.range(300), "id", seed=2)
    assert a.count() + b.count() == 300 and a.join(b, "id").count() == 0 and 150 < a.count() < 250
    ids = prep.with_rid(spark.range(10), ["id"])
    assert [x.n for x in prep.bootstrap(ids, "_rid", 10, 25, copies=2).groupBy("sample").agg(F.count("*").alias("n")).collect()] == [25, 25]
    p = spark.createDataFrame([(i, [float(i)]) for i in range(9)], "rid long, v array<double>")
    assert len(clustering.random_start(p, 3, seed=1)) == 3


def test_pagerank_rules(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("a", "c"), ("d", "a")], "src string, dst string")
    ids = "abcd"
    m = np.zeros((4, 4))
    for s in ids:
        out = [x for x in [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("a", "c"), ("d", "a")] if x[0] == s]
        for _, t in out:
            m[ids.index(t), ids.index(s)] = 0.5 / len(out)
    p, it = np.full(4, 0.25), 0
    while True:
        q, it = m @ p + 0.5 / 4, it + 1
        if np.allclose(p, q):
            break
        p = q
    got, n = pagerank.pagerank(e, 0.5)
    assert n == it and [r.pr for r in got.orderBy("id").collect()] == pytest.approx(q.tolist())
    assert pagerank.pagerank(e.limit(0))[1] == 0
    assert pagerank.graph(spark.createDataFrame([("x", "y")], "n1 string, n2 string"), "n1", "n2", directed=True).collect() == [("y", "x")]


def test_stem_examples():
    words = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "hopping": "hop", "filing": "file", "relational": "relat", "digitizer": "digit", "triplicate": "triplic", "revival": "reviv", "adoption": "adopt", "probate": "probat", "controll": "control", "sky": "sky", "happy": "happi", "": "", "as": "as"}
    assert {w: stem(w) for w in words} == words


def test_text_measures(spark):
    df = spark.createDataFrame([(1, "The U.S. cat's cats. 'cat'"), (2, "dogs and a cat"), (3, ""), (4, None), (5, "123 !!")], "id long, t string").withColumn("f", F.lit(0))
    tf = {(r.doc, r.term): r.f for r in text.term_frequencies(df, "id", "t").collect()}
    assert tf[1, "us"] == 1 and tf[1, "cat"] == 3 and (3, "") not in tf and not [k for k in tf if k[0] in (3, 4, 5)]
    stop = spark.createDataFrame([("the",), ("and",), ("a",)], "word string")
    x = {(r.doc, r.term): r for r in text.tf_idf(text.term_frequencies(df, "id", "t", stopwords=stop), 5).collect()}
    assert x[2, "cat"].w == pytest.approx(math.log2(5 / 2)) and x[1, "us"].tf == pytest.approx(1 / 3)
    sub = {(r.doc, r.term): r.f for r in text.substring_frequencies(df, "id", "t", ["at", "dog"]).collect()}
    assert sub == {(1, "at"): 3, (2, "at"): 1, (2, "dog"): 1}
    c = spark.createDataFrame([([0, 3, 3, 0, 1],), ([2, 0],)], "v array<int>").withColumn("m", text.sparse_codec(F.col("v")))
    assert c.select((text.dense_codec(F.col("m")) == F.col("v")).alias("ok")).agg(F.bool_and("ok")).first()[0]
    assert text.doc_lengths(df, "id", "t").filter("doc = 4").first().dl == 0


def test_similar_documents_in_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(int(d), f"t{t}", float(w)) for d in range(40) for t, w in zip(rng.choice(30, 6, replace=False), rng.random(6))]
    df = spark.createDataFrame(rows, "doc long, term string, w double")
    m = np.zeros((40, 30))
    for d, t, w in rows:
        m[d, int(t[1:])] = w
    s = np.round(m @ m.T, 10)
    np.fill_diagonal(s, -1)
    want = {(q, int(j)) for q in range(0, 40, 4) for j in sorted(np.flatnonzero(s[q] > 0), key=lambda j: (-s[q, j], j))[:3]}
    got = text.most_similar(df.filter("doc % 4 = 0"), df, 3, 10, 40, query_block=4, doc_block=11)
    assert {(r["query"], r.doc) for r in got.collect()} == want


def test_reports(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "zz"), ("c", "a")], "obs string, pred string")
    c = {r.label: r for r in evaluate.per_class(df).collect()}
    assert (c["a"].tp, c["a"].fp, c["a"].fn, c["a"].tn) == (1, 1, 1, 1) and c["c"].precision == 1.0 and c["c"].recall == 0.0
    assert evaluate.overall(df).first().accuracy == pytest.approx(0.4)
    assert evaluate.overall(df.limit(0)).first().n == 0
    cf = evaluate.cf_report(spark.createDataFrame([(6.0, 7.0), (1.0, None), (4.0, 4.5)], "rating double, pred double")).first()
    assert (cf.tp, cf.fp, cf.fn, cf.tn) == (1, 0, 0, 2) and cf.mae == pytest.approx(0.75)
