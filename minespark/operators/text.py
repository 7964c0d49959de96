"""Term frequencies, tf-idf and similarity of documents."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minespark.functions.stem import stems
from minespark.operators import tree
from minespark.operators.prep import lot
from minespark.scratch import batches, materialize, path_of

CLEAN = r"[^a-zA-Z'. ]+|^\.|\.$"  # runs of other characters become one blank
# the token rules - drop quotes at the ends, a final 's and all periods - applied to the whole text, in which blanks end tokens
TOKEN = r"(?<!\S)'|'s?(?!\S)|\."


def tokens(text: Column) -> Column:
    """Lower-case words: other characters than letters, ' and . separate; then quotes at the ends, a final 's and all periods are removed."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(text), CLEAN, " "), TOKEN, "")
    return F.array_remove(F.split(clean, " +"), "")


def term_frequencies(docs: DataFrame, doc: str, text: str, stemmed: bool = True, stopwords: DataFrame | None = None) -> DataFrame:
    """(doc, term, f): how often each term occurs as a token.  ``stopwords``: a column ``word``; documents without a term have no row."""
    t = tokens(F.col(text))
    long = docs.select(F.col(doc).alias("doc"), t.alias("ts"))
    if stopwords is not None:  # before stemming
        words = [r[0] for r in stopwords.select("word").limit(20_001).collect()]
        if len(words) > 20_000:
            raise ValueError("more than 20,000 stopwords")
        long = long.withColumn("ts", F.filter("ts", lambda x: ~x.isin(words)))
    if stemmed:
        long = long.withColumn("ts", stems(F.col("ts")))
    # an inner explode would have the words made twice more, for a filter of empty lists
    return long.select("doc", F.explode_outer("ts").alias("term")).filter(F.col("term").isNotNull()).groupBy("doc", "term").agg(F.count("*").alias("f"))


def substring_frequencies(docs: DataFrame, doc: str, text: str, vocabulary: DataFrame | list[str], stemmed: bool = True, most_words: int = 1_000_000) -> DataFrame:
    """(doc, term, f): how often each word of a vocabulary (a list, or a column ``term``) occurs as a substring of the (stemmed) text, stopwords included; zeros have no row.

    Occurrences of one word do not overlap.  All words are looked for in one
    pass over a text, by an automaton that is broadcast; ValueError beyond
    ``most_words`` words.
    """
    if isinstance(vocabulary, DataFrame):
        vocabulary = [r[0] for r in vocabulary.select("term").filter("term <> ''").distinct().limit(most_words + 1).collect()]
    if len(vocabulary) > most_words:
        raise ValueError(f"more than {most_words} words")
    t = tokens(F.col(text))
    body = docs.select(F.col(doc).alias("doc"), F.array_join(stems(t) if stemmed else t, " ").alias("body"))
    shared = docs.sparkSession.sparkContext.broadcast(sorted(set(vocabulary) - {""}))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        words = shared.value
        find = ahocorasick.Automaton()
        for i, w in enumerate(words):
            find.add_word(w, i)
        if words:
            find.make_automaton()
        for b in batches:
            out: list = []
            for d, s in zip(b["doc"], b["body"]):
                n: dict = {}
                end: dict = {}
                for at, i in find.iter(s) if words and s else ():
                    if at - len(words[i]) >= end.get(i, -1):
                        n[i], end[i] = n.get(i, 0) + 1, at
                out += [(d, words[i], c) for i, c in n.items()]
            yield pd.DataFrame(out, columns=["doc", "term", "f"])

    return body.mapInPandas(run, f"doc {body.schema['doc'].dataType.simpleString()}, term string, f bigint")


def forest_authors(tf: DataFrame, authors: DataFrame, n_attrs: int, n_rows: int, n_trees: int, threshold: float = 0.0, use_ratio: bool = False, seed: int = 0) -> DataFrame:
    """(doc, obs, pred): each document's author (``authors``: doc, author) as a random forest over term frequencies tells it.

    Each tree has ``n_attrs`` words of the whole vocabulary, so only n_attrs *
    n_trees words, drawn by hash, become columns.
    """
    words = [r[0] for r in tf.select("term").distinct().orderBy(lot(seed, "term"), "term").limit(n_attrs * n_trees).collect()]
    name = {w: f"w{i}" for i, w in enumerate(words)}
    wide = tf.filter(F.col("term").isin(words)).groupBy("doc").agg(*[F.sum(F.when(F.col("term") == w, F.col("f"))).alias(c) for w, c in name.items()])
    rows = authors.select("doc", "author").join(wide, "doc", "left").fillna(0, list(name.values()))
    rows = materialize(rows.withColumns({c: F.col(c).cast("double") for c in name.values()}))
    m = tree.forest(rows, list(name.values()), "author", min(n_attrs, len(words)), n_rows, n_trees, threshold, use_ratio, key=["doc"], seed=seed)
    return m.vote(rows).select("doc", F.col("author").alias("obs"), "pred")


def doc_lengths(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, dl): bytes of the text; 0 for NULL."""
    return docs.select(F.col(doc).alias("doc"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("dl"))


def tf_idf(tf: DataFrame, n_docs: int | DataFrame, query: bool = False) -> DataFrame:
    """(doc, term, f, tf, df, idf, w): tf = f / greatest f of the document, idf = log2(n / df), w = tf * idf (query form: (0.5 + 0.5 tf) * idf).

    The frequencies per term are one aggregate; a term in every document has weight 0.
    """
    df = tf.filter("f > 0").groupBy("term").agg(F.count("*").alias("df"))
    if isinstance(n_docs, int):
        df = df.withColumn("idf", F.log2(F.lit(float(n_docs)) / F.col("df")))
    else:
        df = df.join(F.broadcast(n_docs), how="inner").withColumn("idf", F.log2(F.col("n").cast("double") / F.col("df"))).drop("n")  # one row
    x = tf.withColumn("tf", F.col("f") / F.max("f").over(Window.partitionBy("doc"))).join(df, "term")
    w = (F.lit(0.5) + F.lit(0.5) * F.col("tf")) * F.col("idf") if query else F.col("tf") * F.col("idf")
    return x.select("doc", "term", "f", "tf", "df", "idf", w.alias("w"))


def corpus_without(tf: DataFrame, docs: list[int]) -> DataFrame:
    """Term frequencies of the corpus without some documents, to weigh it anew as if they had not been seen."""
    return tf.filter(~F.col("doc").isin(docs))


def cosine_weights(x: DataFrame, times: Column | None = None) -> DataFrame:
    """(doc, term, w) scaled to length 1, then multiplied by ``times``; documents of length 0 drop out."""
    n = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))
    return x.withColumn("_n", n).filter(F.col("_n") > 0).select("doc", "term", (F.col("w") / F.col("_n") * (F.lit(1.0) if times is None else times)).alias("w"))


def okapi_weights(x: DataFrame, lengths: DataFrame, n_docs: int, k1: float = 1.5, k2: float = 1.5, b: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """The two sides (doc, term, w) whose product over common terms is the Okapi similarity of a document to another."""
    if not 1 <= k1 <= 2 or not 1 <= k2 <= 1000:
        raise ValueError("k1 must be in [1, 2], k2 in [1, 1000]")
    avg = lengths.agg(F.avg("dl").alias("avdl"))
    y = x.join(lengths.withColumnRenamed("doc", "_d"), F.col("doc") == F.col("_d")).join(F.broadcast(avg), how="inner")  # one row
    log = F.ln((F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    own = log * (k1 + 1) * F.col("f") / (k1 * (1 - b + b * F.col("dl") / F.col("avdl")) + F.col("f"))
    return y.select("doc", "term", own.alias("w")), x.select("doc", "term", ((k2 + 1) * F.col("f") / (k2 + F.col("f"))).alias("w"))


def bags(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, ts, fs): the terms of each document, once, with their frequencies; one row a document with terms.

    As ``term_frequencies`` without stems and stopwords, but terms are counted
    where the text is, so no row of a term is shuffled.  Rows of the same
    document, which are looked for first, are put together.
    """
    kind = docs.schema[doc].dataType.simpleString()
    rows = docs.select(F.col(doc).alias("doc"), tokens(F.col(text)).alias("ts"))
    again = materialize(docs.groupBy(F.col(doc).alias("doc")).agg(F.count("*").alias("n")).filter("n > 1").select("doc"))
    if not again.isEmpty():
        once, more = rows.join(again, "doc", "left_anti"), rows.join(again, "doc", "left_semi")
        rows = once.unionByName(more.groupBy("doc").agg(F.flatten(F.collect_list("ts")).alias("ts")))

    def count(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            ts = b.column("ts")
            coded = ts.flatten().dictionary_encode()
            row, code = np.asarray(pc.list_parent_indices(ts)).astype(np.int64), np.asarray(coded.indices).astype(np.int64)
            v = max(1, len(coded.dictionary))
            cell, n = np.unique(row * v + code, return_counts=True)
            which, at = np.unique(cell // v, return_index=True)
            ends = pa.array(np.append(at, len(cell)), pa.int32())
            words = pa.ListArray.from_arrays(ends, coded.dictionary.take(pa.array(cell % v)))
            yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(which)), words, pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int32)))], ["doc", "ts", "fs"])

    return materialize(rows.mapInArrow(count, f"doc {kind}, ts array<string>, fs array<int>"))


def vocabulary(bag: DataFrame) -> DataFrame:
    """(term, df) of bags, written."""
    return materialize(bag.select(F.explode("ts").alias("term")).groupBy("term").agg(F.count("*").alias("df")))


def bag_terms(bag: DataFrame, df: DataFrame, n_docs: int) -> DataFrame:
    """(doc, term, f, tf, df, idf, w) as ``tf_idf`` has it, of some of the bags that ``df`` was taken from."""
    x = bag.withColumn("top", F.array_max("fs")).select("doc", "top", F.explode(F.arrays_zip("ts", "fs")).alias("e")).select("doc", F.col("e.ts").alias("term"), F.col("e.fs").cast("bigint").alias("f"), (F.col("e.fs") / F.col("top")).alias("tf"))
    idf = df.withColumn("idf", F.log2(F.lit(float(n_docs)) / F.col("df")))
    return x.join(idf, "term").select("doc", "term", "f", "tf", "df", "idf", (F.col("tf") * F.col("idf")).alias("w"))


def bag_norms(bag: DataFrame, df: DataFrame, n_docs: int) -> DataFrame:
    """(doc, ts, ws, scale): tf, and what it is multiplied by to get cosine weights without the idf, which the query's side has to take twice."""
    path, kind = path_of(df), bag.schema["doc"].dataType.simpleString()

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        for b in rows:
            if words is None:
                found = pa.Table.from_batches(list(batches(path, ["term", "df"], 100_000))).combine_chunks()
                words, idf = found["term"].combine_chunks(), np.log2(n_docs / found["df"].to_numpy())
            ts, fs = b.column("ts"), b.column("fs")
            coded = ts.flatten().dictionary_encode()
            of = idf[np.asarray(pc.index_in(coded.dictionary, value_set=words))][np.asarray(coded.indices)]
            f, row = np.asarray(fs.flatten()), np.asarray(pc.list_parent_indices(ts))
            first = np.searchsorted(row, np.arange(len(b)))  # no list is empty
            tf = f / np.maximum.reduceat(f, first)[row]
            norm = np.sqrt(np.bincount(row, (tf * of) ** 2, len(b)))
            ends = pa.array(np.append(first, len(row)), pa.int32())
            with np.errstate(divide="ignore"):
                out = pa.RecordBatch.from_arrays([b.column("doc"), ts, pa.ListArray.from_arrays(ends, pa.array(tf)), pa.array(1 / norm)], ["doc", "ts", "ws", "scale"])
            yield out.filter(pa.array(norm > 0))

    return bag.mapInArrow(run, f"doc {kind}, ts array<string>, ws array<double>, scale double")


def packed(x: DataFrame) -> DataFrame:
    """(doc, ts, ws, scale) of (doc, term, w): the terms of one document in one row."""
    if "ts" in x.columns:
        return x if "scale" in x.columns else x.withColumn("scale", F.lit(1.0))
    return x.groupBy("doc").agg(F.collect_list("term").alias("ts"), F.collect_list("w").alias("ws")).withColumn("scale", F.lit(1.0))


def okapi_bags(bag: DataFrame, k2: float = 1.5) -> DataFrame:
    """(doc, ts, ws, scale): the second side of ``okapi_weights``."""
    return bag.select("doc", "ts", F.transform("fs", lambda f: (k2 + 1) * f / (k2 + f)).alias("ws"), F.lit(1.0).alias("scale"))


def most_similar(queries: DataFrame, docs: DataFrame, k: int, n_queries: int, n_docs: int, query_block: int = 2048, doc_block: int = 2048) -> DataFrame:
    """(query, doc, score, rank): the k documents with the greatest sum of products over common terms, for a stated set of queries.

    Both sides are (doc BIGINT, term, w), or a row a document (doc, ts, ws,
    scale).  Each task holds a block of queries and reads the written documents
    some at a time, so neither side is copied; it keeps each query's k best.  A
    document is not compared with itself; ties (to ten digits) go to the
    smaller id; documents without a common term are none.

    Scores are first estimated in single precision, by a matrix product over
    the block's most frequent terms and by lists of its other terms; those that
    may be among the k best are taken exactly.
    """
    path = path_of(packed(docs).select("doc", "ts", "ws", "scale"))
    q = materialize(packed(queries).select("doc", "ts", "ws", "scale"))
    n = q.count()
    cores = q.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n // query_block), min(cores, -(-n // 128)))

    def run(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in rows if len(b)]
        if own:
            block = _Queries(pa.Table.from_batches(own), k)
            for i, b in enumerate(batches(path, ["doc", "ts", "ws", "scale"], doc_block, ("ts",))):
                for x in (b.slice(0, FIRST), b.slice(FIRST)) if i == 0 else (b,):
                    if len(x):
                        block.meet(x)
            yield block.best()

    w = Window.partitionBy("query").orderBy(F.desc(F.round("score", 10)), "doc")
    part = q.repartition(parts).mapInArrow(run, "query bigint, doc bigint, score double")
    return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


FIRST = 512  # documents that fill the lists of the k best, exactly
DENSE = 512  # terms of the matrix product; the bound of its rounding is theirs


def _entries(b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows' ends, row, weight) of all entries of a batch (doc, ts, ws, scale)."""
    n = np.asarray(pc.list_value_length(b.column("ts"))).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    return np.append(0, np.cumsum(n)), row, np.asarray(b.column("ws").flatten(), dtype=np.float64) * np.asarray(b.column("scale"))[row]


class _Queries:
    """A block of queries and the k best documents of each so far."""

    def __init__(self, t: pa.Table, k: int):
        b = t.combine_chunks().to_batches()[0]
        self.k, self.ids, self.n = k, np.asarray(b.column("doc")), len(b)
        _, row, w = _entries(b)
        coded = b.column("ts").flatten().dictionary_encode()
        used = np.argsort(-np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary)), kind="stable")  # frequent terms first
        self.words = coded.dictionary.take(pa.array(used))
        back = np.empty(len(used), dtype=np.int64)
        back[used] = np.arange(len(used))
        code = back[np.asarray(coded.indices)]
        self.v = max(1, len(used))
        cell, at = np.unique(row * self.v + code, return_inverse=True)  # a term given twice adds up
        self.cell, self.w = cell, np.bincount(at, w, len(cell))
        row, code = cell // self.v, cell % self.v
        self.dense = np.zeros((min(DENSE, self.v), self.n), dtype=np.float32)
        on = code < DENSE
        self.dense[code[on], row[on]] = self.w[on]
        self.norm = np.sqrt(np.bincount(row, self.w**2, self.n))
        order = np.argsort(code, kind="stable")  # the queries of each term
        self.by, self.by_w, self.first = row[order], self.w[order], np.searchsorted(code[order], np.arange(self.v + 1))
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # query, document, score
        self.least = np.full(self.n, -np.inf)  # the k-th score

    def meet(self, b: pa.RecordBatch) -> None:
        ends, row, w = _entries(b)
        coded = b.column("ts").flatten()
        known = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.words), -1)
        code = np.asarray(known).astype(np.int64)[np.asarray(coded.indices)]
        did, on = np.asarray(b.column("doc")), code >= 0
        row, code, w = row[on], code[on], w[on]
        sure = np.flatnonzero(self.least > 1e-9)  # k are found, and what has no common term is not better
        if len(sure) < self.n:
            slow = np.ones(self.n, dtype=bool)
            slow[sure] = False
            self._exact(did, row, code, w, slow)
        if not len(sure):
            return
        size = np.sqrt(np.bincount(row, w * w, len(b)))
        few = code < DENSE
        m = len(self.dense)
        s = np.bincount(row[few] * m + code[few], w[few], len(b) * m).reshape(len(b), m).astype(np.float32) @ self.dense
        self._rest(s, row[~few], code[~few], w[~few])
        # rounding of DENSE products and sums, and of the single sums added: at most (DENSE + 64) / 2**24 of the norms
        bound = np.full(self.n, np.inf)
        bound[sure] = self.least[sure] - 1e-4 * self.norm[sure] * size.max(initial=0) - 1e-9
        di, qi = np.nonzero(s >= bound.astype(np.float32))
        other = did[di] != self.ids[qi]
        di, qi = di[other], qi[other]
        lo = np.searchsorted(row, np.arange(len(b) + 1))
        for at in range(0, len(di), 20_000):
            x, y = di[at : at + 20_000], qi[at : at + 20_000]
            n = lo[x + 1] - lo[x]
            e = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[x], n)
            cell = np.repeat(y, n) * self.v + code[e]
            i = np.minimum(np.searchsorted(self.cell, cell), len(self.cell) - 1)
            hit = self.cell[i] == cell
            pair = np.repeat(np.arange(len(x)), n)
            score = np.bincount(pair, np.where(hit, self.w[i] * w[e], 0.0), len(x))
            some = np.bincount(pair, hit, len(x)) > 0
            self._keep(y[some], did[x[some]], score[some])

    def _lists(self, row: np.ndarray, code: np.ndarray, w: np.ndarray, by: np.ndarray, by_w: np.ndarray, first: np.ndarray):
        """(row, query, product) of entries that meet a query's, some at a time; by, by_w: the queries of each term, from first on."""
        lo = 0
        width = first[code + 1] - first[code]
        total = np.append(0, np.cumsum(width))
        while lo < len(code):
            hi = max(lo + 1, int(np.searchsorted(total, total[lo] + 1_000_000, side="right")) - 1)
            n = width[lo:hi]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[code[lo:hi]], n)
            yield np.repeat(row[lo:hi], n), by[at], np.repeat(w[lo:hi], n) * by_w[at]
            lo = hi

    def _rest(self, s: np.ndarray, row: np.ndarray, code: np.ndarray, w: np.ndarray) -> None:
        """Adds the products of the terms that are not in the matrices."""
        flat = s.reshape(-1)
        for r, q, x in self._lists(row, code, w, self.by, self.by_w, self.first):
            if not len(r):
                continue
            r0, r1 = r[0], r[-1] + 1
            flat[r0 * self.n : r1 * self.n] += np.bincount((r - r0) * self.n + q, x, (r1 - r0) * self.n)

    def _exact(self, did: np.ndarray, row: np.ndarray, code: np.ndarray, w: np.ndarray, which: np.ndarray) -> None:
        """Meets the queries marked, by lists of terms alone."""
        own = which[self.by]
        lists = self.by[own], self.by_w[own], np.append(0, np.cumsum(own))[self.first]
        for lo in range(0, len(did), step := max(1, 1_000_000 // self.n)):
            on = slice(*np.searchsorted(row, [lo, lo + step]))
            rows = min(step, len(did) - lo)
            s, hits = np.zeros(rows * self.n), np.zeros(rows * self.n, dtype=bool)
            for r, q, x in self._lists(row[on] - lo, code[on], w[on], *lists):
                cell = r * self.n + q
                s += np.bincount(cell, x, len(s))
                hits[cell] = True
            di, qi = np.nonzero(hits.reshape(rows, self.n))
            other = did[lo + di] != self.ids[qi]
            di, qi = di[other], qi[other]
            self._keep(qi, did[lo + di], s[di * self.n + qi])

    def _keep(self, qi: np.ndarray, doc: np.ndarray, s: np.ndarray) -> None:
        q, d, s = self.found = _best(*(np.concatenate(x) for x in zip(self.found, (qi, doc, s))), self.k)
        n = np.bincount(q, minlength=self.n)
        last = np.cumsum(n)[n >= self.k] - 1
        self.least[n >= self.k] = s[last]

    def best(self) -> pa.RecordBatch:
        q, d, s = self.found
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]).cast(pa.int64()), pa.array(d).cast(pa.int64()), pa.array(s)], ["query", "doc", "score"])


def _best(qi: np.ndarray, doc: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k greatest of each query's scores, equal ones by document."""
    order = np.lexsort((doc, -np.round(s, 10), qi))
    qi, doc, s = qi[order], doc[order], s[order]
    on = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left") < k
    return qi[on], doc[on], s[on]


class Corpus:
    """Documents as term frequencies: fitted, copied, pulled, taken out and written.

    Weights are those of the documents held, so a document taken out counts for
    nothing in the weights of the others.
    """

    def __init__(self, tf: DataFrame):
        self.tf = tf.select("doc", "term", "f")

    @classmethod
    def fit(cls, docs: DataFrame, doc: str, text: str, stemmed: bool = True, stopwords: DataFrame | None = None) -> Corpus:
        return cls(materialize(term_frequencies(docs, doc, text, stemmed, stopwords)))

    def copy(self) -> Corpus:
        return Corpus(self.tf)

    def weights(self) -> DataFrame:
        return tf_idf(self.tf, self.tf.agg(F.count_distinct("doc").alias("n")))

    def pull(self, doc) -> DataFrame:
        """(term, w) of one document."""
        return self.weights().filter(F.col("doc") == F.lit(doc)).select("term", "w")

    def pull_all(self) -> DataFrame:
        """(doc, term, w) of all documents."""
        return self.weights().select("doc", "term", "w")

    def rm(self, docs: list) -> Corpus:
        """The corpus without some documents."""
        return Corpus(corpus_without(self.tf, docs))

    def to_json(self, path: str) -> None:
        from minespark.sources.writers import corpus_json

        corpus_json(self.pull_all(), path)


def knn_authors(near: DataFrame, authors: DataFrame) -> DataFrame:
    """(query, obs, pred): the most frequent author of each query's neighbours, the smallest on ties.  ``authors``: doc, author."""
    a = near.join(authors, "doc").groupBy("query").agg(F.mode("author", True).alias("pred"))
    return a.join(authors.select(F.col("doc").alias("query"), F.col("author").alias("obs")), "query").select("query", "obs", "pred")


def sparse_codec(values: Column) -> Column:
    """An ARRAY<INT> as map value -> positions; of the zeros only the last position is kept, so the length can be told."""
    pos = F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    last0 = F.array_max(F.transform(F.filter(pos, lambda p: p["v"] == 0), lambda p: p["i"]))
    keys = F.array_sort(F.array_distinct(values))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.when(k == 0, F.array(last0)).otherwise(F.transform(F.filter(pos, lambda p: p["v"] == k), lambda p: p["i"]))))


def dense_codec(m: Column) -> Column:
    """The inverse of :func:`sparse_codec`."""
    n = F.array_max(F.flatten(F.map_values(m)))
    entries = F.map_entries(m)
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.coalesce(F.get(F.transform(F.filter(entries, lambda e: (e["key"] != 0) & F.array_contains(e["value"], i)), lambda e: e["key"]), F.lit(0)), F.lit(0)))
