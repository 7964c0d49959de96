"""Similar documents without copies of the corpus, against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from minespark.operators import text


def test_no_copies_of_the_documents(spark):
    df = spark.createDataFrame([(d, f"t{d % 7}", 1.0 + d % 3) for d in range(60)], "doc long, term string, w double")
    near = text.most_similar(df, df, 2, 60, 60, query_block=2, doc_block=3)
    assert "Generate" not in near._jdf.queryExecution().optimizedPlan().toString()  # a row of a block for each block it meets
    want = {(q, d, r) for q in range(60) for r, d in enumerate(sorted((d for d in range(60) if d != q and d % 7 == q % 7), key=lambda d: (-(1 + d % 3), d))[:2], 1)}
    assert {(r["query"], r.doc, r["rank"]) for r in near.collect()} == want


@pytest.mark.parametrize("dense", [2, 12, 512])
def test_estimates_lose_nothing(dense, monkeypatch):
    monkeypatch.setattr(text, "DENSE", dense)
    rng = np.random.default_rng(dense)
    m = np.where(rng.random((300, 40)) < 0.1, rng.integers(-1, 4, (300, 40)) / 2.0, 0)
    m[7] = m[8] = m[150] = m[3]
    on = m != 0
    lists = lambda rows: {"doc": pa.array(rows, pa.int64()), "ts": pa.array([[f"t{t}" for t in np.flatnonzero(on[d])] for d in rows], pa.list_(pa.dictionary(pa.int32(), pa.string()))), "ws": pa.array([m[d][on[d]].tolist() for d in rows], pa.list_(pa.float64())), "scale": pa.array([0.5] * len(rows))}
    plain = lists(list(range(0, 300, 3)))
    plain["ts"] = plain["ts"].cast(pa.list_(pa.string()))
    block = text._Queries(pa.table(plain), 4)
    for at in range(0, 300, 25):
        block.meet(pa.RecordBatch.from_pydict(lists(list(range(at, at + 25)))))
    got = block.best().to_pydict()
    s, shared = np.round(m @ m.T / 4, 10), on.astype(int) @ on.T.astype(int) > 0
    want = [(q, d, s[q, d]) for q in range(0, 300, 3) for d in sorted((d for d in np.flatnonzero(shared[q]) if d != q), key=lambda d: (-s[q, d], d))[:4]]
    assert list(zip(got["query"], got["doc"])) == [x[:2] for x in want] and np.allclose(got["score"], [x[2] for x in want])


def test_bags_equal_term_frequencies(spark):
    rows = [(1, "b a b"), (2, None), (3, "123 !"), (1, "a c"), (4, "it's a cat.")]
    df = spark.createDataFrame(rows, "id long, t string")
    bag = text.bags(df, "id", "t")
    got = {(r.doc, t): f for r in bag.collect() for t, f in zip(r.ts, r.fs)}
    assert got == {(r.doc, r.term): r.f for r in text.term_frequencies(df, "id", "t", False).collect()} and bag.count() == 2
    tf = text.term_frequencies(df, "id", "t", False)
    words = text.vocabulary(bag)
    cells = lambda x: {(r.doc, r.term): (r.f, round(r.w, 9)) for r in x.collect()}
    assert cells(text.bag_terms(bag, words, 5)) == cells(text.tf_idf(tf, 5))
    want = {(r.doc, r.term): r.w for r in text.cosine_weights(text.tf_idf(tf, 5)).collect()}
    idf = {r.term: np.log2(5 / r.df) for r in words.collect()}
    assert {(r.doc, t): w * r.scale * idf[t] for r in text.bag_norms(bag, words, 5).collect() for t, w in zip(r.ts, r.ws)} == pytest.approx(want)
    assert not text.bags(df.filter(F.col("id") == 3), "id", "t").count()


def test_first_documents_and_the_rest(spark):
    rows = [(d, f"t{d * i % 11}", 1.0 + (d * 7 + i) % 5) for d in range(700) for i in (1, 3)]
    df = spark.createDataFrame(sorted({(d, t): w for d, t, w in rows}.items()), "k struct<doc:long,term:string>, w double").select("k.*", "w")
    m = np.zeros((700, 11))
    for (d, t), w in {(d, t): w for d, t, w in rows}.items():
        m[d, int(t[1:])] = w
    s = np.round(m @ m.T, 10)
    got = {(r["query"], r.doc) for r in text.most_similar(df.filter("doc % 50 = 0"), df, 3, 14, 700).collect()}
    assert got == {(q, d) for q in range(0, 700, 50) for d in sorted((d for d in range(700) if d != q and s[q, d] > 0), key=lambda d: (-s[q, d], d))[:3]}
