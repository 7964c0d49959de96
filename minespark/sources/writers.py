"""Writers: tables, models and text reports."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minespark.operators import evaluate


def csv(df: DataFrame, path: str, header: bool = True) -> None:
    """Part files below ``path``, written by the executors."""
    df.write.mode("overwrite").csv(path, header=header)


def text(path: str, content: str | Iterable[str]) -> None:
    """A text, or its lines as they come: a report of any length passes the driver a partition at a time."""
    with open(path, "w", encoding="utf-8") as f:
        if isinstance(content, str):
            f.write(content)
        else:
            f.writelines(f"{line}\n" for line in content)


def term_table(tf: DataFrame, path: str, wide: bool = False, most_words: int = 10_000) -> None:
    """Term frequencies: in long form as parquet or, ``wide``, as CSV with a document a line and a column a word, 0 where it does not occur.

    A wide table of more than ``most_words`` words is refused (ValueError): it
    would be as wide as the vocabulary.
    """
    if not wide:
        tf.write.mode("overwrite").parquet(path)
        return
    words = [r[0] for r in tf.select("term").distinct().orderBy("term").limit(most_words + 1).collect()]
    if len(words) > most_words:
        raise ValueError(f"more than {most_words} words")
    tf.groupBy("doc").pivot("term", words).agg(F.sum("f")).fillna(0).write.mode("overwrite").csv(path, header=True)


def corpus_json(tfidf: DataFrame, path: str) -> None:
    """One JSON line per document: its terms and weights."""
    tfidf.groupBy(F.col("doc").cast("string").alias("doc")).agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("terms")).write.mode("overwrite").json(path)


def _table(rows: list, names: list[str]) -> str:
    cells = [names] + [["" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in rows]
    width = [max(len(r[i]) for r in cells) for i in range(len(names))]
    return "\n".join("  ".join(c.rjust(w) for c, w in zip(r, width)) for r in cells)


def frame_text(df: DataFrame, most: int = 10_000) -> str:
    """A small result as text; ValueError beyond ``most`` rows, which :func:`frame_lines` is for."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write them by frame_lines")
    return _table([tuple(r) for r in rows], df.columns)


def frame_lines(df: DataFrame) -> Iterator[str]:
    """All rows of a result as aligned lines, in its order; made by the executors and passed on a partition at a time."""
    cells = {c: F.when(F.isnull(c), F.lit("")).otherwise(F.format_string("%.4f", c) if t in ("double", "float") else F.col(c).cast("string")) for c, t in df.dtypes}
    out = df.select(*[x.alias(c) for c, x in cells.items()])
    width = out.agg(*[F.greatest(F.lit(len(c)), F.coalesce(F.max(F.length(c)), F.lit(0))).alias(c) for c in out.columns]).first()
    yield "  ".join(c.rjust(width[c]) for c in out.columns)
    lines = out.select(F.concat_ws("  ", *[F.lpad(c, width[c], " ") for c in out.columns]).alias("line"))
    for r in lines.toLocalIterator():
        yield r["line"]


def classification_report(df: DataFrame, obs: str = "obs", pred: str = "pred", title: str = "Classifier") -> str:
    o = evaluate.overall(df, obs, pred).first()
    c = evaluate.confusion(df, obs, pred).orderBy("pred", "obs").collect()
    labels = sorted({r["obs"] for r in c})
    cell = {(r["pred"], r["obs"]): r["n"] for r in c}
    matrix = _table([[p, *[cell.get((p, x), 0) for x in labels]] for p in labels], ["pred\\obs", *labels])
    per = evaluate.per_class(df, obs, pred).orderBy("label")
    return (
        f"{title}\n\nConfusion matrix:\n{matrix}\n\nRecords classified: {o['n']}\nCorrectly classified: {o['correct']}\nIncorrectly classified: {o['n'] - o['correct']}\n"
        f"Overall accuracy: {o['accuracy']}\nOverall error rate: {o['error']}\n\n{frame_text(per)}\n"
    )


def fold_report(df: DataFrame, obs: str = "obs", pred: str = "pred", title: str = "Cross-validation") -> str:
    r = evaluate.fold_report(df, obs, pred).first()
    return classification_report(df, obs, pred, title) + f"\nPooled accuracy: {r['pooled_accuracy']}\nMean accuracy of the folds: {r['mean_accuracy']}\n"


def cluster_report(stats: DataFrame, centroids: list[list[float]] | None = None) -> str:
    s = frame_text(stats.orderBy("cluster"))
    if not centroids:
        return s
    from minespark.operators.clustering import centroid_distances

    return s + "\n\nCentroids:\n" + _table([[i, *map(float, c)] for i, c in enumerate(centroids)], ["cluster", *[f"x{j}" for j in range(len(centroids[0]))]]) + "\n\nDistances between centroids:\n" + _table(centroid_distances(centroids), ["a", "b", "distance"])


def recommender_report(df: DataFrame, rating: str = "rating", pred: str = "pred", show_pairs: bool = True) -> Iterator[str]:
    """All pairs, then the measures."""
    if show_pairs:
        yield from frame_lines(df.orderBy("user", "item"))
        yield ""
    yield frame_text(evaluate.cf_report(df, rating, pred))


def rank_report(ranks: DataFrame, iterations: int, read_ms: float, process_ms: float) -> Iterator[str]:
    """Times, iterations and the whole table of ranks."""
    from minespark.operators.pagerank import report

    yield f"Read time: {read_ms:.3f} ms\nProcess time: {process_ms:.3f} ms\nIterations: {iterations}\n"
    yield from frame_lines(report(ranks).orderBy("rank"))
