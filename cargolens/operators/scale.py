"""Building blocks that keep global orderings, ranks and splits distributed.

An unpartitioned window or a per-group list would pull all rows into one task. The helpers
below work on value counts, cut the value range into buckets of about equal weight, and carry
totals over bucket borders, so that no task holds more than its share even when one group or
one value owns a third of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargolens.session import cut, num_shuffle_partitions, sized

BUCKET = "_bucket"


# --- Summaries joined back to rows -------------------------------------------------------


def attach(df: DataFrame, summary: DataFrame, on: str | Sequence[str], how: str = "left") -> DataFrame:
    """Join a keyed summary back to its rows, broadcast only if its measured size allows it."""
    return df.join(sized(summary), on, how)


def dominant(df: DataFrame, by: str, value: str, alias: str) -> DataFrame:
    """Most frequent value per group, smallest on a tie.

    Counted by (group, value) first, so no task ever holds the values of a whole group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(by).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(alias))


def dominant_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the most frequent value of every column, smallest on a tie."""
    pairs = _melt(df, columns, "string")
    best = dominant(pairs, "_column", "_value", "_value")
    return best.groupBy().pivot("_column", list(columns)).agg(F.first("_value"))


def _melt(df: DataFrame, columns: Sequence[str], kind: str, by: Sequence[str] = ()) -> DataFrame:
    entries = F.array(*[
        F.struct(F.lit(c).alias("_column"), F.col(c).cast(kind).alias("_value")) for c in columns
    ])
    return df.select(*by, F.inline(entries))


# --- Global order ------------------------------------------------------------------------


def with_buckets(df: DataFrame, value: str, parts: int | None = None) -> DataFrame:
    """Add a bucket number that grows with ``value``; buckets hold about equally many rows.

    The cut points come from one mergeable quantile sketch; they only balance the work and
    never change a result.
    """
    parts = parts or max(2, num_shuffle_partitions(df.sparkSession))
    steps = [i / parts for i in range(1, parts)]
    if not steps:
        return df.withColumn(BUCKET, F.lit(0))
    found = df.approxQuantile(value, steps, 0.25 / parts)
    cuts = sorted({c for c in found if c == c})
    splits = [float("-inf"), *cuts, float("inf")]
    if not cuts:
        return df.withColumn(BUCKET, F.lit(0))
    return Bucketizer(splits=splits, inputCol=value, outputCol=BUCKET, handleInvalid="keep").transform(df)


def running_totals(
    df: DataFrame, value: str, totals: Mapping[str, str], by: Sequence[str] = (), descending: bool = False
) -> DataFrame:
    """Totals over all rows that come before a row's value, and over the row's ties.

    ``df`` should already hold value counts (few rows per value). For each measure ``m`` named
    ``out`` this adds ``out_before`` (strictly before in value order), ``out_ties`` (same value)
    and ``out_all``. Ties share their numbers. ``by`` restarts the totals per group.
    """
    numeric = value if dict(df.dtypes)[value] == "double" else "_order"
    if numeric != value:
        df = df.withColumn(numeric, F.col(value).cast("double"))
    # The counts are read for the cut points, for the bucket totals and for the rows: they are written
    # once, so that the scan and the joins behind them do not run again for each.
    df = with_buckets(cut(df), numeric)
    keys = [*by, BUCKET]
    sums = [F.sum(m).alias(f"{out}_in_bucket") for out, m in totals.items()]
    borders = df.groupBy(*keys).agg(*sums)
    order = F.col(BUCKET).desc() if descending else F.col(BUCKET).asc()
    # One row per bucket (and group): a few thousand at most in any window partition.
    over = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    earlier = over.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    carried = borders.select(
        *keys,
        *[F.coalesce(F.sum(f"{out}_in_bucket").over(earlier), F.lit(0)).alias(f"{out}_carried") for out in totals],
        *[F.sum(f"{out}_in_bucket").over(over).alias(f"{out}_all") for out in totals],
    )
    inside = W.partitionBy(*keys)
    # Buckets go by the number, order and ties by the value itself: large integers can share a double.
    direction = F.col(value).desc() if descending else F.col(value).asc()
    upto = inside.orderBy(direction).rangeBetween(W.unboundedPreceding, W.currentRow)
    same = W.partitionBy(*keys, value)
    local = df.select(
        "*",
        *[F.sum(m).over(upto).alias(f"{out}_upto") for out, m in totals.items()],
        *[F.sum(m).over(same).alias(f"{out}_ties") for out, m in totals.items()],
    )
    joined = local.join(carried, keys)
    before = [
        (F.col(f"{out}_carried") + F.col(f"{out}_upto") - F.col(f"{out}_ties")).alias(f"{out}_before")
        for out in totals
    ]
    keep = [c for c in df.columns if c not in (BUCKET, "_order")]
    return joined.select(
        *keep, *before,
        *[f"{out}_ties" for out in totals], *[f"{out}_all" for out in totals],
    )


#: Accuracy of the sketch behind exact quantiles: brackets hold about 4 / ACCURACY of a group's values. Groups of up to
#: SMALL_GROUP values are taken whole, because there a bracket could miss by the rounding of ranks.
ACCURACY, SMALL_GROUP = 1000, 4000


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact, linearly interpolated quantiles: one row per (group, column) that has values. Nulls and NaN don't count.

    A sketch brackets every quantile from both sides; a second pass counts what lies below a bracket and keeps the
    values inside, so that only they are shuffled and ranked. Null groups are groups.
    """
    known = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    slack = 2 / ACCURACY
    lows, highs = [[min(max(p + d, 0.0), 1.0) for p in probs.values()] for d in (-slack, slack)]
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.count(known[c]).alias(f"n{i}"), F.percentile_approx(known[c], lows, ACCURACY).alias(f"l{i}"),
                 F.percentile_approx(known[c], highs, ACCURACY).alias(f"h{i}")]
    marks = (df.groupBy(*by) if by else df).agg(*aggs)
    if by:
        keys = [f"_by{i}" for i in range(len(by))]
        side = sized(marks.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.struct(*[c for c in marks.columns if c not in by]).alias("_m")))
        same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)]
        rows, m = df.select(*by, *[c for c in columns if c not in by]).join(side, same), F.col("_m")
    else:
        # Joined as one row: a subquery would sketch all rows anew for every bracket that names it.
        rows, m = df.select(*columns).crossJoin(F.broadcast(marks.select(F.struct("*").alias("_m")))), F.col("_m")
    entries = []
    for i, c in enumerate(columns):
        n, v = m.getField(f"n{i}"), known[c]
        for j, p in enumerate(probs.values()):
            whole = n <= SMALL_GROUP
            low = F.when(whole | F.lit(p <= slack), F.lit(float("-inf"))).otherwise(F.get(m.getField(f"l{i}"), F.lit(j)))
            high = F.when(whole | F.lit(p >= 1 - slack), F.lit(float("inf"))).otherwise(F.get(m.getField(f"h{i}"), F.lit(j)))
            entries.append(F.when(v <= high, F.struct(F.lit(c).alias("_column"), F.lit(j).alias("_p"), n.alias("_all"), F.when(v >= low, v).alias("_value"))))
    each = rows.select(*by, F.array(*entries).alias("_a")).select(*by, F.explode("_a").alias("_e")).where("_e IS NOT NULL").select(*by, "_e.*")
    counts = cut(each.groupBy(*by, "_column", "_p", "_all", "_value").agg(F.count(F.lit(1)).alias("_n")))
    of = [*by, "_column", "_p"]
    below = counts.groupBy(*of, "_all").agg(F.sum(F.when(F.col("_value").isNull(), F.col("_n")).otherwise(0)).alias("_below"))
    # Groups are told apart by a hash that takes nulls for values, so that joins keep null groups.
    group = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in of])
    ranked = running_totals(counts.where("_value IS NOT NULL").select(group.alias("_g"), "_value", "_n"), "_value", {"n": "_n"}, ["_g"])
    place = F.element_at(F.array(*[F.lit(float(p)) for p in probs.values()]), F.col("_p") + 1) * (F.col("_all") - 1)
    both = ranked.join(below.withColumn("_g", group).withColumn("_place", place), "_g")
    start = F.col("_below") + F.col("n_before")

    def at(position: Column) -> Column:
        return F.max(F.when((start <= position) & (position < start + F.col("n_ties")), F.col("_value")))

    found = both.groupBy(*of).agg(at(F.floor("_place")).alias("_lo"), at(F.ceil("_place")).alias("_hi"), F.max(F.col("_place") - F.floor("_place")).alias("_w"))
    value = F.col("_lo") + F.when(F.col("_w") > 0, (F.col("_hi") - F.col("_lo")) * F.col("_w")).otherwise(0.0)
    return found.withColumn("_q", value).groupBy(*by, F.col("_column").alias("column")).agg(
        *[F.max(F.when(F.col("_p") == j, F.col("_q"))).alias(name) for j, name in enumerate(probs)])


# --- Splits ------------------------------------------------------------------------------


def row_hash(df: DataFrame, seed: int = 42) -> Column:
    """Hash of all plain columns of a row: the same on every run and for every partitioning."""
    plain = [c for c, t in df.dtypes if t in ("string", "date", "boolean", "double", "float", "int", "bigint",
                                              "smallint", "tinyint", "timestamp", "timestamp_ntz")]
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in sorted(plain)])


def hash_share(df: DataFrame, seed: int = 42) -> Column:
    """A number in [0, 1) per row, drawn from its hash."""
    return F.pmod(row_hash(df, seed), F.lit(1 << 52)) / float(1 << 52)


#: Rows that one record of equal rows is expanded to at a time.
EXPAND = 1 << 16


def numbered(df: DataFrame, seed: int = 42, alias: str = "_index") -> DataFrame:
    """All rows of ``df`` with numbers 0, 1, ... in the order of their hashes, and their count as ``<alias>_size``.

    Equal rows are counted before they are ordered, and which of them has which number makes no difference: so the result
    does not depend on how rows lie in files or partitions, and no repeated row gathers in one task.
    """
    columns = df.columns
    counts = cut(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
                 .withColumn("_u", F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 52)) / float(1 << 52)))
    placed = with_buckets(counts, "_u")
    sizes = placed.groupBy(BUCKET).agg(F.sum("_n").alias("_b"))
    over = W.partitionBy(F.lit(0))
    carried = sizes.select(BUCKET, F.coalesce(F.sum("_b").over(over.orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
                           F.sum("_b").over(over).alias(f"{alias}_size"))
    upto = W.partitionBy(BUCKET).orderBy("_u", *columns).rowsBetween(W.unboundedPreceding, -1)
    inside = placed.withColumn("_inside", F.coalesce(F.sum("_n").over(upto), F.lit(0))).join(carried, BUCKET)
    first = inside.withColumn("_first", F.col("_before") + F.col("_inside"))
    pieces = first.withColumn("_piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / EXPAND)))) \
        .withColumns({"_from": F.col("_first") + F.col("_piece") * EXPAND,
                      "_upto": F.col("_first") + F.least(F.col("_n"), (F.col("_piece") + 1) * EXPAND) - 1})
    spread = pieces.repartition(num_shuffle_partitions(df.sparkSession), "_from")
    return spread.select(*columns, F.explode(F.sequence(F.col("_from").cast("long"), F.col("_upto").cast("long"))).alias(alias), f"{alias}_size")


@F.arrow_udf(T.LongType())
def _permuted(index: pa.Array, size: pa.Array, seed: pa.Array) -> pa.Array:
    i, n, k = (np.asarray(v).astype(np.uint64) for v in (index, size, seed))
    half = np.zeros(len(i), np.uint64)
    while ((np.uint64(1) << (half * np.uint64(2))) < n).any():
        half += ((np.uint64(1) << (half * np.uint64(2))) < n).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    open_ = np.ones(len(i), bool)
    while open_.any():
        left, right = (i >> half)[open_], (i & mask)[open_]
        for turn in range(6):
            h = (right + k[open_] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn + 1)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h >> np.uint64(32)) & mask[open_])
        i[open_] = (left << half[open_]) | right
        open_ = i >= n  # walk on until the number lies in the range again
    return pa.array(i.astype(np.int64))


def permuted(index: Column, size: Column, seed: Column) -> Column:
    """Place of ``index`` in a random order of 0 .. size-1 that ``seed`` names: one-to-one, without a sort."""
    return _permuted(index.cast("long"), size.cast("long"), seed.cast("long"))


def row_index(df: DataFrame, strata: Sequence[str] = (), seed: int = 42, alias: str = "_index", key: Sequence[str] = ()) -> DataFrame:
    """Number the rows of each stratum 0, 1, ... in the order of their hashes, and add the stratum's size.

    Ordered by bucket, so a stratum with most of the rows is spread over all tasks. The hash covers ``key``, or
    else all columns; equal rows then stand side by side, and many of them in one bucket, so give a key
    where rows repeat or where the order has to be a random deal.
    """
    share = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 52)) / float(1 << 52) if key else hash_share(df, seed)
    df = with_buckets(df.withColumn("_u", share), "_u")
    keys = [*strata, BUCKET]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    over = W.partitionBy(*strata) if strata else W.partitionBy(F.lit(0))
    earlier = over.orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    carried = sizes.select(*keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
                           F.sum("_n").over(over).alias(f"{alias}_size"))
    plain = [c for c in df.columns if c not in (BUCKET, "_u") and dict(df.dtypes)[c] in ("string", "int", "bigint", "double")]
    inside = F.row_number().over(W.partitionBy(*keys).orderBy("_u", *plain)) - 1
    return df.withColumn("_inside", inside).join(carried, keys) \
        .withColumn(alias, F.col("_before") + F.col("_inside")).drop(BUCKET, "_u", "_inside", "_before")


def add_rank_share(df: DataFrame, strata: Sequence[str] = (), seed: int = 42, alias: str = "_share") -> DataFrame:
    """Hash rank of a row inside its stratum as a share in [0, 1): ``share < 0.8`` keeps 80 % of every stratum."""
    ranked = row_index(df, strata, seed)
    return ranked.withColumn(alias, F.col("_index") / F.col("_index_size")).drop("_index", "_index_size")


def stratified_folds(df: DataFrame, strata: Sequence[str], folds: int, seed: int = 42, alias: str = "fold") -> DataFrame:
    ranked = add_rank_share(df, strata, seed)
    return ranked.withColumn(alias, F.floor(F.col("_share") * folds).cast("int")).drop("_share")
