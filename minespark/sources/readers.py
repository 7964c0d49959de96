"""Readers of the text formats that carry metadata in their first rows.

The few leading rows are read on the driver; the data rows are split and typed
by Spark.  Leading rows are told from data by the position of their line in the
file, which is known without sorting: a file's first split holds them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minespark.operators.assoc import item_list
from minespark.operators.prep import lot


def head(spark: SparkSession, path: str, n: int) -> list[str]:
    """The first ``n`` lines of a file; ValueError for several files, of which each would have leading rows of its own."""
    if len(spark.read.text(path).inputFiles()) > 1:
        raise ValueError(f"{path} has several files")
    return [r[0] for r in spark.read.text(path).limit(n).collect()]


def _cells(line: str, sep: str = ",") -> list[str]:
    return [c.strip().strip('"') for c in line.split(sep)]


def _rows(spark: SparkSession, path: str, skip: int, names: Sequence[str], kinds: Sequence[str], sep: str = ",", null: str | None = None, ordered: str | None = None) -> DataFrame:
    """The lines after the first ``skip``, as typed columns; blanks around cells do not matter, empty cells are NULL."""
    first = head(spark, path, skip)
    lines = spark.read.text(path).withColumn("_line", F.monotonically_increasing_id()).filter(F.col("_line") >= len(first)).filter(F.length(F.trim("value")) > 0)
    parts = F.split("value", sep if len(sep) > 1 else f"[{sep}]" if sep not in "\\^]" else f"\\{sep}")

    def cell(i: int, kind: str) -> Column:
        c = F.trim(F.regexp_replace(F.trim(F.get(parts, F.lit(i))), '^"|"$', ""))
        c = F.nullif(c, F.lit("")) if null is None else F.when(~c.isin("", null), c)
        return c if kind == "string" else c.try_cast(kind)

    cols = [cell(i, k).alias(n) for i, (n, k) in enumerate(zip(names, kinds))]
    return lines.select(*([F.col("_line").alias(ordered)] if ordered else []), *cols)


def csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, header: bool = True, sep: str = ",", null: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A plain CSV; give a schema on hot paths, without one types are inferred.  Headerless columns are c0, c1, ... unless named."""
    r = spark.read.option("sep", sep).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    if null is not None:
        r = r.option("nullValue", null)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    df = r.csv(path, header=header)
    if header or schema is not None:
        return df
    return df.toDF(*(columns or [f"c{i}" for i in range(len(df.columns))]))


def classified_csv(spark: SparkSession, path: str, numeric: Sequence[str] | None = None, rid: str = "_rid", categorical_only: bool = False) -> tuple[DataFrame, str]:
    """A table with two metadata rows after the header - domain sizes, which are skipped, and the class attribute's name - and that name.

    Columns named ``numeric`` (default: those whose domain size is below 1 and
    of which every value is a number, told by one pass over the file) are
    DOUBLE, all others and the class STRING.  ``rid`` is the order of the rows.
    """
    lines = head(spark, path, 3)
    names, sizes, label = _cells(lines[0]), _cells(lines[1]), _cells(lines[2])[0]
    if numeric is None:
        maybe = [] if categorical_only else [n for n, s in zip(names, sizes) if n != label and s in ("0", "-1", "")]
        rows = _rows(spark, path, 3, names, ["string"] * len(names))
        ok = rows.agg(*[F.bool_and(F.col(f"`{n}`").isNull() | F.col(f"`{n}`").try_cast("double").isNotNull()).alias(n) for n in maybe]).first() if maybe else {}
        numeric = [n for n in maybe if ok[n]]
    kinds = ["double" if n in numeric else "string" for n in names]
    return _rows(spark, path, 3, names, kinds, ordered=rid), label


def restricted_csv(spark: SparkSession, path: str, names: Sequence[str] | None = None, rid: str = "_rid", keep_dropped: str | None = None) -> DataFrame:
    """A numeric table whose first row flags the columns to keep (1) or drop (0).

    ``names``: of the kept columns, default f0, f1, ...; ``keep_dropped`` is the
    name under which the first dropped column, a label of the rows, is kept.
    """
    flags = [c == "1" for c in _cells(head(spark, path, 1)[0])]
    kept = iter(names or [f"f{i}" for i in range(sum(flags))])
    cols = [next(kept) if f else f"_drop{i}" for i, f in enumerate(flags)]
    df = _rows(spark, path, 1, cols, ["double" if f else "string" for f in flags], ordered=rid)
    label = next((c for c in cols if c.startswith("_drop")), None)
    more = [F.col(label).alias(keep_dropped)] if keep_dropped and label else []
    return df.select(rid, *more, *[c for c in cols if not c.startswith("_drop")])


def header_names(spark: SparkSession, path: str) -> list[str]:
    """A comma-separated list of names."""
    return _cells(head(spark, path, 1)[0])


def restriction(spark: SparkSession, path: str) -> list[int]:
    """One line of comma-separated 0 and 1."""
    return [int(c) for c in _cells(head(spark, path, 1)[0])]


def sparse_baskets(spark: SparkSession, path: str, remove: list[int] | None = None) -> DataFrame:
    """(tid, items) of lines ``tid, i1, i2, ...``; the written tid is passed over, baskets are numbered in the order of the lines."""
    lines = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    return lines.select(F.monotonically_increasing_id().alias("tid"), F.filter(item_list(F.col("value"), remove), lambda x: x.isNotNull()).alias("items"))


def dense_baskets(spark: SparkSession, path: str, ids: Sequence[int] | None = None, remove: Sequence[int] = (), drop_zero_id: bool = False) -> DataFrame:
    """(tid, items) of a headerless 0/1 matrix whose first column is the tid; ``ids`` name the columns (default 0, 1, ...).

    Item 0 is kept, unless ``drop_zero_id``.
    """
    width = len(_cells(head(spark, path, 1)[0])) - 1
    ids = list(range(width)) if ids is None else list(ids)
    df = _rows(spark, path, 0, ["tid", *[f"c{i}" for i in range(width)]], ["bigint"] + ["int"] * width)
    items = F.array(*[F.when(F.col(f"c{i}") != 0, F.lit(x)) for i, x in enumerate(ids) if x not in remove and not (drop_zero_id and x == 0)])
    return df.select("tid", F.filter(items, lambda x: x.isNotNull()).alias("items"))


def item_names(spark: SparkSession, path: str, id_col: str | int, name_cols: Sequence[str], sep: str = ",") -> DataFrame:
    """(id, name) of a dimension file with a header; several name columns are joined by a blank."""
    df = csv(spark, path, sep=sep)
    c = df.columns[id_col] if isinstance(id_col, int) else id_col
    return df.select(F.col(c).cast("int").alias("id"), F.trim(F.concat_ws(" ", *[F.trim(F.col(x).cast("string")) for x in name_cols])).alias("name"))


def text_files(spark: SparkSession, folder: str, encoding: str = "ISO-8859-1", sample: int | None = None, seed: int = 0) -> DataFrame:
    """(path, author, name, text, dl) of every file below a folder: the author is the folder's name, dl the length in bytes.

    Files whose names begin with ``.`` or ``_`` are passed over, as Spark does.
    """
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    p = F.split("path", "/")
    df = b.select("path", F.element_at(p, -2).alias("author"), F.element_at(p, -1).alias("name"), F.decode("content", encoding).alias("text"), F.col("length").alias("dl"))
    return df if sample is None else df.orderBy(lot(seed, "path"), "path").limit(sample)


def stopwords(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("word")).filter(F.length("word") > 0)


def ratings_matrix(spark: SparkSession, path: str, missing: float = 99, drop_first: bool = True) -> DataFrame:
    """(user, item, rating) of a headerless matrix; the first column is dropped, users and items are numbered from 0, missing cells have no row."""
    width = len(_cells(head(spark, path, 1)[0]))
    df = _rows(spark, path, 0, [str(i) for i in range(width)], ["double"] * width, ordered="user")
    cols = [str(i) for i in range(int(drop_first), width)]
    long = df.unpivot(["user"], cols, "item", "rating").filter(F.col("rating") != missing)
    return long.select(F.col("user").cast("int").alias("user"), (F.col("item").cast("int") - int(drop_first)).alias("item"), "rating")


def edge_list(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(n1, v1, n2, v2): the first four columns of each line, quotes and blanks around names removed."""
    return _rows(spark, path, 0, ["n1", "v1", "n2", "v2"], ["string"] * 4, sep)


def numeric_matrix(spark: SparkSession, path: str, sep: str = ",", rid: str | None = None) -> DataFrame:
    width = len(_cells(head(spark, path, 1)[0], sep))
    return _rows(spark, path, 0, [f"c{i}" for i in range(width)], ["double"] * width, sep, ordered=rid)


def vectors_csv(spark: SparkSession, path: str) -> DataFrame:
    """(doc, term, f) of a wide table with a column a word, as written by :func:`minespark.sources.writers.term_table`; zeros have no row."""
    df = spark.read.csv(path, header=True)
    words = df.columns[1:]
    long = df.unpivot([df.columns[0]], [f"`{w}`" for w in words], "term", "f")
    return long.select(F.col(f"`{df.columns[0]}`").alias("doc"), "term", F.col("f").try_cast("bigint").alias("f")).filter("f <> 0")


def vectors_json(spark: SparkSession, path: str) -> DataFrame:
    """Documents with their vectors, as written by :func:`minespark.sources.writers.corpus_json`."""
    return spark.read.schema("doc string, terms map<string,double>").json(path)
