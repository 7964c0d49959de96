"""Command line: ``python -m minespark.cli COMMAND ...``; one command for each tool."""

from __future__ import annotations

import argparse
import time
from collections.abc import Iterable, Iterator
from itertools import chain
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minespark.operators import assoc, clustering, evaluate, neighbours, pagerank, prep, recommend, text, tree
from minespark.scratch import materialize
from minespark.session import get_spark
from minespark.sources import readers, writers


def _emit(args, content: str | Iterable[str], name: str) -> None:
    """Print the text or its lines, write them, or both; each line is made once and none is kept."""

    def shown(lines: Iterable[str]) -> Iterator[str]:
        for line in lines:
            if not args.noprint:
                print(line)
            yield line

    lines = shown([content] if isinstance(content, str) else content)
    if args.out:
        Path(args.out).mkdir(parents=True, exist_ok=True)
        writers.text(f"{args.out}/{name}", lines)
    else:
        for _ in lines:
            pass


def _classified(spark: SparkSession, args) -> tuple[DataFrame, str, list[str]]:
    df, label = readers.classified_csv(spark, args.data, numeric=args.numeric)
    attrs = [c for c in df.columns if c not in (label, "_rid")]
    if args.restrict:
        attrs = [a for a, f in zip(attrs, readers.restriction(spark, args.restrict)) if f]
    return df, label, attrs


def induce(spark, args) -> None:
    df, label, attrs = _classified(spark, args)
    m = tree.c45(df, attrs, label, args.threshold, args.gratio, rid="_rid")
    _emit(args, m.to_json(Path(args.data).name), f"{Path(args.data).stem}_tree.json")


def classify(spark, args) -> None:
    df, label = readers.classified_csv(spark, args.data, numeric=args.numeric)
    m = tree.TreeModel.from_json(Path(args.tree).read_text())
    got = m.transform(df.withColumns({v: F.col(v).cast("double") for v in m.numeric}))
    if args.out:
        writers.csv(got.drop("_rid"), f"{args.out}/{Path(args.data).stem}_predict")
    if args.test or label not in df.columns:
        _emit(args, writers.frame_text(got.groupBy("pred").agg(F.count("*").alias("n")).orderBy("pred")), f"{Path(args.data).stem}_results.out")
    else:
        _emit(args, writers.classification_report(got, label, "pred", "C4.5"), f"{Path(args.data).stem}_results.out")


def validate(spark, args) -> None:
    df, label, attrs = _classified(spark, args)
    if args.folds in (0, 1):
        got = tree.c45(df, attrs, label, args.threshold, args.gratio, rid="_rid").transform(df).select(F.lit(1).alias("fold"), F.col(label).alias("obs"), "pred")
    else:
        n = df.count() if args.folds == -1 else args.folds
        folds = prep.k_folds(df.select("_rid"), "_rid", n, args.seed)
        got = tree.cross_validate(df, attrs, label, folds, "_rid", args.threshold, args.gratio)
    _emit(args, writers.fold_report(got, title=f"C4.5, {args.folds} folds"), f"{Path(args.data).stem}_c45_results.out")


def forest(spark, args) -> None:
    df, label, attrs = _classified(spark, args)
    folds = prep.k_folds(df.select("_rid"), "_rid", args.folds, args.seed)
    rows = df.join(folds, "_rid")
    parts = []
    for f in range(1, args.folds + 1):
        m = tree.forest(rows.filter(F.col("fold") != f), attrs, label, args.attrs, args.rows, args.trees, args.threshold, args.gratio, key=["_rid"], seed=args.seed + f)
        parts.append(m.vote(rows.filter(F.col("fold") == f)).select("_rid", "fold", F.col(label).alias("obs"), "pred"))
    got = parts[0]
    for p in parts[1:]:
        got = got.unionByName(p)
    _emit(args, writers.fold_report(got, title="Random forest"), f"{Path(args.data).stem}_rf_results.out")


def knn(spark, args) -> None:
    df, label = readers.classified_csv(spark, args.data, numeric=args.numeric)
    f = neighbours.features(df, "_rid", label)
    near = neighbours.nearest(f, f, "_rid", "v", args.k, payload=label)
    got = neighbours.classify(near, args.k).join(df.select(F.col("_rid").alias("query"), F.col(label).alias("obs")), "query")
    _emit(args, writers.classification_report(got, title=f"kNN, k = {args.k}"), f"{Path(args.data).stem}_knn_results.out")


def apriori(spark, args) -> None:
    b = readers.dense_baskets(spark, args.data) if args.dense else readers.sparse_baskets(spark, args.data)
    sets, total = assoc.frequent_itemsets(b, args.min_support)
    top = assoc.maximal_itemsets(sets)
    names = readers.item_names(spark, args.items, 0, args.names.split(",")) if args.items else None
    rules = assoc.rules(sets, total, args.min_confidence, top if args.skyline else None)
    out: list[Iterable[str]] = [[f"{total} baskets, support {args.min_support}, confidence {args.min_confidence}"]]
    if args.show in ("all", "sets"):
        out.append(writers.frame_lines((top if args.skyline else sets).select(F.array_join(F.transform("items", lambda x: x.cast("string")), ", ").alias("items"), "n").orderBy(F.desc("n"), "items")))
    if args.show in ("all", "rules"):
        out.append(r["text"] for r in assoc.rule_text(rules, names).orderBy(F.desc("support"), "text").toLocalIterator())
    _emit(args, chain.from_iterable(chain(part, [""]) for part in out), f"{Path(args.data).stem}_rules.txt")


def _points(spark, args) -> tuple[DataFrame, list[str]]:
    df = readers.restricted_csv(spark, args.data, readers.header_names(spark, args.header) if args.header else None, keep_dropped="label")
    return df, [c for c in df.columns if c not in ("_rid", "label")]


def kmeans(spark, args) -> None:
    df, cols = _points(spark, args)
    m = clustering.kmeans(clustering.points(df, "_rid", cols, not args.raw), args.k)
    _emit(args, writers.cluster_report(clustering.cluster_stats(m.assigned), m.centroids), f"{Path(args.data).stem}_kmeans_results.out")


def dbscan(spark, args) -> None:
    df, cols = _points(spark, args)
    got = clustering.dbscan(clustering.points(df, "_rid", cols), args.eps, args.points)
    body = writers.frame_text(got.groupBy("cluster", "kind").agg(F.count("*").alias("n")).orderBy("cluster", "kind"))
    _emit(args, body + f"\n\nOutliers: {clustering.noise_share(got).first()[0]} %", f"{Path(args.data).stem}_dbscan_results.out")


def hclust(spark, args) -> None:
    df, cols = _points(spark, args)
    rows, t = clustering.hclust(df, cols)
    _emit(args, t.to_json([tuple(r) for r in rows]), f"{Path(args.data).stem}_dendrogram.json")
    if args.threshold >= 0:
        parts = t.cut(args.threshold, args.by)
        _emit(args, "\n".join(f"Cluster {i}: {len(p)} points\n" + "\n".join("  " + ", ".join(map(str, rows[j])) for j in p) for i, p in enumerate(parts)), f"{Path(args.data).stem}_hclust_results.out")


def recommend_cmd(spark, args) -> None:
    r = readers.ratings_matrix(spark, args.data)
    cells = readers.csv(spark, args.cells, header=False, columns=["user", "item"]) if args.cells else recommend.sample_cells(r, args.size, args.seed)
    _emit(args, writers.recommender_report(recommend.evaluate_list(r, cells, args.method, args.n)), f"{Path(args.data).stem}_cf_results.out")


def vectorize(spark, args) -> None:
    docs = readers.text_files(spark, args.data, sample=args.size)
    stop = readers.stopwords(spark, args.stopwords) if args.stopwords else None
    tf = text.term_frequencies(docs.withColumn("id", F.xxhash64("path")), "id", "text", stopwords=stop)
    writers.term_table(tf, f"{args.out or '.'}/{Path(args.data).name}_vectorized", args.wide)
    writers.csv(docs.select("name", "author"), f"{args.out or '.'}/ground_truth", header=False)


def authors(spark, args) -> None:
    docs = readers.text_files(spark, args.data).withColumn("doc", F.xxhash64("path"))
    n = docs.count()
    x = text.tf_idf(text.term_frequencies(docs, "doc", "text"), n)
    left, right = (text.cosine_weights(x),) * 2 if args.metric == "cosine" else text.okapi_weights(x, docs.select("doc", "dl"), n)
    got = materialize(text.knn_authors(text.most_similar(left, right, args.k, n, n), docs.select("doc", "author")))
    if args.out:
        writers.csv(docs.select("doc", "name").join(got.withColumnRenamed("query", "doc"), "doc").select(F.col("name").alias("doc"), "obs", "pred"), f"{args.out}/authors_knn_pred")
    _emit(args, writers.frame_text(evaluate.author_report(got).orderBy("author")) + "\n\n" + writers.frame_text(evaluate.accuracy(got)), "authors_knn_results.out")


def rank(spark, args) -> None:
    t = time.time()
    e = materialize(pagerank.graph(readers.edge_list(spark, args.data), "n1", "n2", args.directed))
    read = (time.time() - t) * 1000
    t = time.time()
    ranks, it = pagerank.pagerank(e, args.d)
    _emit(args, writers.rank_report(ranks, it, read, (time.time() - t) * 1000), f"{Path(args.data).stem}_pagerank.txt")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="minespark")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, fn, *flags):
        c = sub.add_parser(name)
        c.add_argument("data")
        c.add_argument("--out")
        c.add_argument("--noprint", action="store_true")
        c.add_argument("--seed", type=int, default=0)
        for f, kw in flags:
            c.add_argument(f, **kw)
        c.set_defaults(fn=fn)

    thr = [("--threshold", {"type": float, "default": 0.0}), ("--gratio", {"action": "store_true"}), ("--restrict", {}), ("--numeric", {"type": lambda s: s.split(",") if s else [], "default": None})]
    num = [thr[3]]
    pts = [("--header", {})]
    command("induce", induce, *thr)
    command("classify", classify, ("--tree", {"required": True}), ("--test", {"action": "store_true"}), *num)
    command("validate", validate, ("--folds", {"type": int, "default": 10}), *thr)
    command("forest", forest, ("--attrs", {"type": int, "default": 5}), ("--rows", {"type": int, "default": 100}), ("--trees", {"type": int, "default": 7}), ("--folds", {"type": int, "default": 10}), *thr)
    command("knn", knn, ("--k", {"type": int, "default": 3}), *num)
    command(
        "apriori", apriori, ("--min-support", {"type": float, "default": 0.05}), ("--min-confidence", {"type": float, "default": 0.7}), ("--dense", {"action": "store_true"}), ("--items", {}), ("--names", {"default": "name"}),
        ("--skyline", {"action": argparse.BooleanOptionalAction, "default": True}), ("--show", {"choices": ["all", "sets", "rules"], "default": "all"}),
    )
    command("kmeans", kmeans, ("--k", {"type": int, "default": 3}), ("--raw", {"action": "store_true"}), *pts)
    command("dbscan", dbscan, ("--eps", {"type": float, "default": 0.5}), ("--points", {"type": int, "default": 3}), *pts)
    command("hclust", hclust, ("--threshold", {"type": float, "default": -1.0}), ("--by", {"choices": ["height", "nclust"], "default": "height"}), *pts)
    command("recommend", recommend_cmd, ("--method", {"choices": sorted(recommend.METHODS), "default": "user-weighted-sum"}), ("--n", {"type": int, "default": 5}), ("--cells", {}), ("--size", {"type": int, "default": 100}))
    command("vectorize", vectorize, ("--stopwords", {}), ("--size", {"type": int, "default": None}), ("--wide", {"action": "store_true"}))
    command("authors", authors, ("--metric", {"choices": ["cosine", "okapi"], "default": "okapi"}), ("--k", {"type": int, "default": 5}))
    command("pagerank", rank, ("--d", {"type": float, "default": 0.5}), ("--directed", {"action": "store_true"}))
    args = p.parse_args(argv)
    args.fn(get_spark(f"minespark-{args.command}"), args)


if __name__ == "__main__":
    main()

