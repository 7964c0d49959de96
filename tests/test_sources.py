"""Readers, writers, command line and streaming on small files."""

import pytest
from pyspark.sql import functions as F

from minespark import cli
from minespark.operators import tree
from minespark.sources import readers, writers
from minespark.streaming import score


def put(tmp_path, name, content):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(p)


BALLOONS = "Color,Act,Age,Inflated\n2,2,2,2\nInflated\n" + "\n".join(f"{c},{a},{g},{'T' if a == 'S' or g == 'A' else 'F'}" for c in "YP" for a in "SD" for g in "AC")


def test_classified_csv(spark, tmp_path):
    df, label = readers.classified_csv(spark, put(tmp_path, "b.csv", BALLOONS))
    assert label == "Inflated" and df.count() == 8 and df.columns == ["_rid", "Color", "Act", "Age", "Inflated"]
    num, _ = readers.classified_csv(spark, put(tmp_path, "n.csv", "x,c,y\n0,2,2\ny\n1.5,a,1\n,b,0\n"))
    assert dict(num.dtypes) == {"_rid": "bigint", "x": "double", "c": "string", "y": "string"} and num.orderBy("_rid").collect()[1].x is None


def test_restricted_csv(spark, tmp_path):
    p = put(tmp_path, "p.csv", "0,1,1,0\na, 1.5 ,2,9\nb,3,,9\n")
    df = readers.restricted_csv(spark, p, ["x", "y"], keep_dropped="who").orderBy("_rid")
    assert [tuple(r)[1:] for r in df.collect()] == [("a", 1.5, 2.0), ("b", 3.0, None)]


def test_baskets_names_lists(spark, tmp_path):
    s = readers.sparse_baskets(spark, put(tmp_path, "s.txt", "1, 5, 7\n2, 7\n3\n"), remove=[5])
    assert [r["items"] for r in s.orderBy("tid").collect()] == [[7], [7], []]
    p = put(tmp_path, "d.csv", "1,1,0,1\n2,0,1,0\n")
    assert [r["items"] for r in readers.dense_baskets(spark, p).orderBy("tid").collect()] == [[0, 2], [1]]
    assert [r["items"] for r in readers.dense_baskets(spark, p, drop_zero_id=True).orderBy("tid").collect()] == [[2], [1]]
    n = readers.item_names(spark, put(tmp_path, "i.csv", "Id,Flavor,Food\n0, Apple ,Pie\n"), "Id", ["Flavor", "Food"])
    assert n.collect() == [(0, "Apple Pie")]
    assert readers.restriction(spark, put(tmp_path, "r.txt", "1,0, 1\n")) == [1, 0, 1]
    assert readers.header_names(spark, put(tmp_path, "h.txt", "a, b\n")) == ["a", "b"]
    assert readers.csv(spark, put(tmp_path, "q.csv", "a,b\n?,1\n"), null="?").first().a is None


def test_text_folder_and_matrices(spark, tmp_path):
    put(tmp_path, "corpus/ann/one.txt", "caf\xe9".encode("latin-1"))
    put(tmp_path, "corpus/bob/two.txt", b"hi")
    d = readers.text_files(spark, str(tmp_path / "corpus")).orderBy("author").collect()
    assert [(r.author, r.name, r.text, r.dl) for r in d] == [("ann", "one.txt", "café", 4), ("bob", "two.txt", "hi", 2)]
    assert readers.text_files(spark, str(tmp_path / "corpus"), sample=1).count() == 1
    r = readers.ratings_matrix(spark, put(tmp_path, "m.csv", "9,99,1.5\n9,2,99\n"))
    assert sorted(map(tuple, r.collect())) == [(0, 1, 1.5), (1, 0, 2.0)]
    e = readers.edge_list(spark, put(tmp_path, "e.csv", '"a b",0, "c" ,1,junk\nx,0,y\n'))
    assert e.collect() == [("a b", "0", "c", "1"), ("x", "0", "y", None)]
    assert readers.numeric_matrix(spark, put(tmp_path, "x.csv", "1,2\n3,-4e1\n")).collect() == [(1.0, 2.0), (3.0, -40.0)]
    assert readers.stopwords(spark, put(tmp_path, "w.txt", "the\n\n and \n")).collect() == [("the",), ("and",)]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "a"), ("b", "a")], "obs string, pred string")
    t = writers.classification_report(df)
    assert "Overall accuracy: 0.5" in t and "Records classified: 2" in t
    writers.csv(df, str(tmp_path / "out"))
    assert readers.csv(spark, str(tmp_path / "out")).count() == 2
    x = spark.createDataFrame([(1, "t", 0.5)], "doc long, term string, w double")
    writers.corpus_json(x, str(tmp_path / "j"))
    assert readers.vectors_json(spark, str(tmp_path / "j")).first().terms == {"t": 0.5}


@pytest.mark.parametrize(
    "argv,name",
    [
        (["induce", "b.csv"], "b_tree.json"),
        (["validate", "b.csv", "--folds", "2"], "b_c45_results.out"),
        (["knn", "b.csv", "--k", "1"], "b_knn_results.out"),
        (["apriori", "s.txt", "--min-support", "0.2", "--min-confidence", "0.5"], "s_rules.txt"),
        (["kmeans", "p.csv", "--k", "2"], "p_kmeans_results.out"),
        (["dbscan", "p.csv", "--eps", "1", "--points", "1"], "p_dbscan_results.out"),
        (["hclust", "p.csv", "--threshold", "2", "--by", "nclust"], "p_hclust_results.out"),
        (["recommend", "m.csv", "--size", "3"], "m_cf_results.out"),
        (["pagerank", "e.csv"], "e_pagerank.txt"),
    ],
)
def test_command_line(spark, tmp_path, argv, name, capsys):
    files = {"b.csv": BALLOONS, "s.txt": "1, 5, 7\n2, 5, 7\n3, 7\n", "p.csv": "1,1\n0,0\n0,1\n9,9\n9,8\n", "m.csv": "0,1,2,3\n0,2,99,4\n0,5,1,2\n", "e.csv": "a,0,b,1\nb,0,c,1\n"}
    cli.main([argv[0], put(tmp_path, argv[1], files[argv[1]]), "--out", str(tmp_path / "o"), *argv[2:]])
    assert (tmp_path / "o" / name).read_text() and capsys.readouterr().out


def test_classify_command(spark, tmp_path):
    b = put(tmp_path, "b.csv", BALLOONS)
    cli.main(["induce", b, "--out", str(tmp_path / "o"), "--noprint"])
    cli.main(["classify", b, "--tree", str(tmp_path / "o" / "b_tree.json"), "--out", str(tmp_path / "o"), "--noprint"])
    assert "Overall accuracy: 1.0" in (tmp_path / "o" / "b_results.out").read_text()


def test_forest_and_text_commands(spark, tmp_path):
    b = put(tmp_path, "b.csv", BALLOONS)
    cli.main(["forest", b, "--folds", "2", "--attrs", "2", "--rows", "6", "--trees", "3", "--out", str(tmp_path / "o"), "--noprint"])
    assert "Pooled accuracy" in (tmp_path / "o" / "b_rf_results.out").read_text()
    for author, words in (("ann", "tea cups and tea leaves"), ("bob", "iron rails and iron wheels")):
        for i in range(3):
            put(tmp_path, f"c/{author}/{i}.txt", f"{words} {'x' * i} number {i} {author}")
    cli.main(["vectorize", str(tmp_path / "c"), "--out", str(tmp_path / "v"), "--noprint"])
    assert spark.read.parquet(str(tmp_path / "v" / "c_vectorized")).filter("term = 'tea' AND f = 2").count() == 3
    cli.main(["authors", str(tmp_path / "c"), "--k", "2", "--metric", "cosine", "--out", str(tmp_path / "o"), "--noprint"])
    assert "1.0000" in (tmp_path / "o" / "authors_knn_results.out").read_text()


def test_scoring_a_stream(spark, tmp_path):
    df, label = readers.classified_csv(spark, put(tmp_path, "b.csv", BALLOONS))
    m = tree.c45(df, ["Color", "Act", "Age"], label, rid="_rid")
    src = str(tmp_path / "in")
    df.drop("_rid").withColumn("ts", F.lit("2020-01-01 00:30:00").cast("timestamp")).write.parquet(src)
    s = score.score(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src), m)
    q = score.windowed_counts(s, "ts").writeStream.format("memory").queryName("scored").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r.pred: r.n for r in spark.table("scored").collect()} == {"T": 6, "F": 2}
