"""Collaborative filtering of all customers, against brute force."""

import math

import duckdb
import numpy as np
import pytest

from minespark.operators import recommend
from minespark.plans import mining
from minespark.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def ratings():
    """{(user, item): rating} of every customer and brand with a line item."""
    rows = duckdb.sql(f"""SELECT o_custkey, p_brand, round(avg(l_discount) * 100, 4) FROM '{DATA}/lineitem.parquet' JOIN '{DATA}/orders.parquet' ON l_orderkey = o_orderkey
        JOIN '{DATA}/part.parquet' ON l_partkey = p_partkey GROUP BY 1, 2""").fetchall()
    return {(u, i): float(x) for u, i, x in rows}


def brute(r: dict, axis: int):
    """{(a, b): similarity} of those that share something, and the means."""
    vec: dict = {}
    for k, x in r.items():
        vec.setdefault(k[axis], {})[k[1 - axis]] = x
    mean = {a: sum(v.values()) / len(v) for a, v in vec.items()}
    norm = {a: math.sqrt(sum((x - mean[a]) ** 2 for x in v.values())) for a, v in vec.items()}
    sims = {}
    for a, v in vec.items():
        for b, w in vec.items():
            if a != b and v.keys() & w.keys():
                d = sum((v[o] - mean[a]) * (w[o] - mean[b]) for o in v.keys() & w.keys())
                sims[a, b] = d / (norm[a] * norm[b]) if round(norm[a] * norm[b], 12) > 0 else None
    return sims, mean, vec


def predicted(r: dict, axis: int, how: str, n: int = 5) -> dict:
    sims, mean, vec = brute(r, axis)
    out = {}
    for u in {k[0] for k in r}:
        for i in {k[1] for k in r}:
            a, o = ((u, i), (i, u))[axis]
            near = sorted((-round(sims.get((a, b)) or 0.0, 12), b) for b, v in vec.items() if b != a and o in v)[:n]
            w = sum(-s for s, _ in near)
            if how == "mean-utility":
                p = sum(vec[b][o] for _, b in near) / len(near) if near else None
            elif abs(w) <= 1e-12:
                p = None
            elif how == "weighted-sum":
                p = sum(-s * vec[b][o] for s, b in near) / w
            else:
                p = mean[a] + sum(-s * (vec[b][o] - mean[b]) for s, b in near) / w
            out[u, i] = None if p is None else max(-10.0, min(10.0, p))
    return out


def same(got: dict, want: dict, tol: float = 1e-5) -> None:
    assert got.keys() == want.keys()
    assert not {k: (got[k], want[k]) for k in want if (got[k] is None) != (want[k] is None) or want[k] is not None and not np.isclose(got[k], want[k], atol=tol, rtol=1e-6)}


def test_every_customer_and_brand_is_rated(spark):
    got = {(x.user, x.item): x.rating for x in mining.customer_ratings(spark, DATA).collect()}
    same(got, ratings(), 2e-4)


@pytest.mark.parametrize("kind", ["user", "item"])
def test_similarity_of_all(spark, kind):
    got = {(x.a, x.b): x.sim for x in QUERIES[f"cf_customers_{kind}_similarity"](spark, DATA).collect()}
    same(got, brute(ratings(), kind == "item")[0], 2e-6)


@pytest.mark.parametrize("method", sorted(recommend.METHODS))
def test_predictions_of_all(spark, method):
    kind, how = recommend.METHODS[method]
    got = {(x.user, x.item): x.pred for x in QUERIES[f"cf_customers_{method.replace('-', '_')}"](spark, DATA).collect()}
    same(got, predicted(ratings(), kind == "item", how), 2e-5)


def test_evaluation_is_of_all_cells(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(mining.recommend, "evaluate_list", lambda r, cells, method: seen.update(r=r) or spark.createDataFrame([(1.0, 2.0)], "rating double, pred double"))
    QUERIES["cf_evaluation"](spark, DATA).collect()
    assert seen["r"].count() == len(ratings())


@pytest.mark.parametrize("kind", ["user", "item"])
def test_blocks_equal_the_join(spark, kind, monkeypatch):
    monkeypatch.setattr(recommend, "BLOCK", 3)
    rows = [(u, f"i{i}", float((u * 7 + i * i * 3) % 11)) for u in range(40) for i in range(9) if (u * 5 + i * 3) % 4 == 0] + [(90, "i1", 4.0), (91, "alone", 4.0)]
    r = spark.createDataFrame(rows, "user int, item string, rating double")
    pairs = [{(x.a, x.b): x.sim for x in f(r, kind).collect()} for f in (recommend.similarity_in_blocks, recommend.similarity)]
    same(*pairs, 1e-9)
    for how in ("mean-utility", "weighted-sum", "adjusted-weighted-sum"):
        got = {(x.user, x.item): x.pred for x in recommend.predict(r, recommend.all_cells(r), kind, how, 3, blocks=True).collect()}
        same(got, predicted({(u, i): x for u, i, x in rows}, kind == "item", how, 3), 1e-8)
