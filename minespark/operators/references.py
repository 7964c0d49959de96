"""References to records that do not exist.

A Bloom filter of the parent keys, of fixed maximal size, proves most orphans
without a shuffle; only references that pass it are verified by an exact join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minespark.operators.rows import skew_join
from minespark.scratch import materialize

#: A filter has at most 2^29 bits, so its broadcast is at most 64 MiB: ten bits a key up to 53 million keys.
MAX_BITS_LOG2 = 29
PROBES = 4


def _slots(key: Column, seed: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << bits))


def bloom_words(parents: DataFrame, key: str, bits: int) -> np.ndarray:
    """The filter as 2^bits / 64 words, or-ed together on the executors."""
    slots = parents.filter(F.col(key).isNotNull()).select(F.explode(F.array(*[_slots(F.col(key), i, bits) for i in range(PROBES)])).alias("p"))
    words = slots.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("p", F.lit(64)).cast("int"))).alias("b"))
    got = words.toPandas()  # at most 2^bits / 64 rows
    out = np.zeros(max(1, (1 << bits) // 64), dtype=np.int64)
    out[got["w"].to_numpy(dtype=np.int64)] = got["b"].to_numpy(dtype=np.int64)
    return out


def bloom_test(df: DataFrame, key: str, words: np.ndarray, bits: int) -> Column:
    """True where the key may be a parent, false where it is none; hashes are made in the JVM, only the slots go through Arrow."""
    shared = df.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def probe(slots: pd.Series) -> pd.Series:
        table, p = shared.value, np.stack(slots.to_numpy()) if len(slots) else np.zeros((0, PROBES), dtype=np.int64)
        return pd.Series(((table[p >> 6] >> (p & 63)) & 1).all(axis=1))

    return probe(F.array(*[_slots(F.coalesce(F.col(key), F.lit(0)), i, bits) for i in range(PROBES)]))


def orphans(refs: DataFrame, parents: DataFrame, key: str, period: str, expected: int | None = None) -> DataFrame:
    """The references (columns of ``refs``) without a parent in their period, and the ``reason``.

    ``refs``: BIGINT ``key``, integer ``period``, further columns; rows without
    a key are no references.  ``parents``: key and period of every parent
    record.  missing = the key is in no period, deleted = its last period is
    before the reference's, later = its first one is after it.  References
    without a period can only be ``missing``.  ``expected`` sizes the filter
    (default: the number of parent keys, counted).  Repeated references give
    repeated rows.
    """
    lives = materialize(parents.filter(F.col(key).isNotNull() & F.col(period).isNotNull()).groupBy(key).agg(F.min(period).alias("_first"), F.max(period).alias("_last")))
    refs = refs.filter(F.col(key).isNotNull())
    n = lives.count() if expected is None else expected
    bits = min(MAX_BITS_LOG2, max(10, int(np.ceil(np.log2(max(1, n) * 10)))))
    if n * PROBES > 2 << bits:  # so full that nine of ten orphans would pass: all references are verified by the join
        return _verified(refs, lives, key, period)
    words = bloom_words(lives, key, bits)
    # tested once and written, as both kinds of references and the hot keys are read from it
    tested = materialize(refs.withColumn("_maybe", bloom_test(refs, key, words, bits)))
    definite = tested.filter(~F.col("_maybe")).drop("_maybe").withColumn("reason", F.lit("missing"))
    return definite.unionByName(_verified(tested.filter("_maybe").drop("_maybe"), lives, key, period))


def _verified(refs: DataFrame, lives: DataFrame, key: str, period: str) -> DataFrame:
    checked = skew_join(refs, lives, key, "left")
    reason = F.when(F.col("_first").isNull(), "missing").when(F.col("_last") < F.col(period), "deleted").when(F.col("_first") > F.col(period), "later")
    return checked.withColumn("reason", reason).filter(F.col("reason").isNotNull()).drop("_first", "_last")


def orphan_report(found: DataFrame, table: str, period: str) -> DataFrame:
    """Orphans per referring table, period and reason."""
    return found.groupBy(table, period, "reason").agg(F.count("*").alias("n_orphans"))
