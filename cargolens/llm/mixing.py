"""Mixing sources to target weights by Pareto order sampling.

A document's expected number of copies is the rate of its source, tilted by a preference of its length
class. The whole part is certain; what is left over, the inclusion probability, is settled by order
sampling: documents are ranked by random odds over inclusion odds, and the lowest ranks fill the words
that the source still lacks. Only DataFrame functions are used. Nothing is ordered over a whole source:
ranks are first summed in bins, and only the bin in which a source's words are reached is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargolens.llm.common import need, word_count
from cargolens.session import cut

# Fixed values of the mix: weights by order of source, share of all words, most copies of a document.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
# Length classes: binary logarithm of the size; from this one on, each class halves the preference by TILT.
LONG_CLASS, TILT = 10, 0.25
#: Bins after the one in which a source's words are reached that are put in order with it.
BINS_AFTER = 6


def uniform(*columns: str, seed: int = 8) -> Column:
    """A number strictly between 0 and 1 from the row's values: the same in every run."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, take the weights in turn. No target is above ``most`` times its
    source's size; the excess goes to the others by weight. With sources ordered by the level at which
    they fill up, the level that shares everything is found from running sums: one row per source.
    """
    order = W.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("double"))
    full = F.col("source_size") * float(most)
    fills = W.partitionBy(F.lit(0)).orderBy(full / F.col("_w"), F.col("source").isNull(), F.col("source"))
    before, everything = fills.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0))
    rest = F.sum("source_size").over(everything) * share - F.coalesce(F.sum(full).over(before), F.lit(0.0))
    open_weight = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    stepped = weighed.withColumn("_level", rest / open_weight)
    # The level is right at the first source that doesn't fill up under it; without one, all are full.
    level = F.min(F.when(F.col("_level") * F.col("_w") <= full, F.struct(full / F.col("_w"), F.col("_level")))).over(everything)
    return stepped.withColumn("_at", level["_level"]).select(
        "source", "source_size", F.least(full, F.coalesce(F.col("_at") * F.col("_w"), full)).alias("target"))


def class_rates(classes: DataFrame, most: int = MOST) -> DataFrame:
    """(source, class, rate): expected copies per document, at most ``most``, that give the target words.

    ``classes``: source, class, words, preference, target. The rate is a level times the preference; classes
    that reach the limit are found as in ``source_targets``, within a source.
    """
    by_source = W.partitionBy("source")
    fills = by_source.orderBy(F.desc("preference"), F.col("class"))
    before = fills.rowsBetween(W.unboundedPreceding, -1)
    weight = F.col("words") * F.col("preference")
    rest = F.col("target") - most * F.coalesce(F.sum("words").over(before), F.lit(0))
    open_words = F.sum(weight).over(by_source) - F.coalesce(F.sum(weight).over(before), F.lit(0.0))
    stepped = classes.withColumn("_level", F.try_divide(rest, open_words))  # null where only texts without words are left
    level = F.min(F.when(F.col("_level") * F.col("preference") <= most, F.struct(F.row_number().over(fills), F.col("_level")))).over(by_source)
    return stepped.withColumn("_at", level["_level"]).select(
        "source", "class", F.least(F.lit(float(most)), F.coalesce(F.col("_at") * F.col("preference"), F.lit(float(most)))).alias("rate"))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def _measured(docs: DataFrame, text: str, key: str, source: str) -> list[Column]:
    size = word_count(text)
    return [F.col(key).alias("key"), F.col(source).cast("string").alias("source"), size.alias("size"),
            F.substring(F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))), 1, 12).alias("digest"),
            F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int").alias("class")]


def _ranked(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Rows with certain copies, inclusion probability, rank and the bin of the rank.

    A source has about as many bins as a bin has rows, so neither grows faster than the root of the rows.
    """
    rated = rows.alias("d").join(plan.alias("p"), _same("d", "p") & (F.col("d.class") == F.col("p.class"))) \
        .select("d.*", "rate", "source_size", "target", "bins")
    some = F.col("size") > 0
    odds = F.col("u") / (1 - F.col("u"))
    out = rated.withColumns({
        "sure": F.when(some, F.floor("rate")).otherwise(0).cast("long"),
        "chance": F.when(some, F.col("rate") - F.floor("rate")).otherwise(0.0), "u": uniform("key", "digest", seed=seed)})
    out = out.withColumn("rank", F.when(F.col("chance") > 0, odds / (F.col("chance") / (1 - F.col("chance")))))
    return out.withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * F.col("bins")).cast("int"))


def _settled(rows: DataFrame, weights: tuple[int, ...], share: float, most: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The mix in small tables: rates by source and length class; by source, the last rank that is in and one left out before it."""
    counted = cut(rows.groupBy("source", "class").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows")))
    targets = source_targets(counted.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    preference = F.pow(F.lit(2.0), -TILT * F.greatest(F.col("class") - LONG_CLASS, F.lit(0)))
    classes = counted.alias("a").join(targets.alias("b"), _same("a", "b")).select("a.source", "class", "words", preference.alias("preference"), "target")
    bins = counted.groupBy("source").agg(F.ceil(F.sqrt(F.sum("rows"))).alias("bins"))
    plan = class_rates(classes, most).alias("r").join(targets.alias("t"), _same("r", "t")).select("r.*", "source_size", "target")
    plan = cut(plan.alias("r").join(bins.alias("b"), _same("r", "b")).select("r.*", "bins"))
    ranked = _ranked(rows, plan, seed)
    # Words by source and bin, certain ones under the null bin: a bounded number of rows per source.
    sums = ranked.groupBy("source", "bin").agg(F.sum(F.when(F.col("bin").isNotNull(), F.col("size")).otherwise(0)).alias("words"),
                                               F.sum(F.col("sure") * F.col("size")).alias("certain"), F.first("target").alias("target"))
    by_source = W.partitionBy("source")
    upto = F.sum("words").over(by_source.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow))
    sums = sums.withColumns({"lacking": F.col("target") - F.sum("certain").over(by_source), "upto": upto})
    edge = cut(sums.groupBy("source").agg(F.min(F.when(
        F.col("bin").isNotNull() & (F.col("upto") > F.col("lacking")), F.struct("bin", (F.col("lacking") - F.col("upto") + F.col("words")).alias("left")))).alias("edge"))
        .select("source", F.col("edge.bin").alias("edge_bin"), F.col("edge.left").alias("left")))
    # Only the bins around the place where a source reaches its words are put in order. There the document
    # that goes beyond is taken, or passed over for those after it, whichever comes nearer to the target.
    near = F.col("d.bin").between(F.col("e.edge_bin"), F.col("e.edge_bin") + BINS_AFTER)
    inner = ranked.alias("d").join(edge.alias("e"), _same("d", "e") & near).select("d.*", "left")
    here = F.struct("rank", "key", "digest")
    line = W.partitionBy("source").orderBy("rank", "key", "digest").rowsBetween(W.unboundedPreceding, W.currentRow)
    inner = inner.withColumn("upto", F.sum("size").over(line)).withColumn("beyond", F.min(F.when(F.col("upto") > F.col("left"), F.struct(
        "rank", "key", "digest", "upto", "size"))).over(W.partitionBy("source")))
    skipped = F.col("upto") - F.coalesce(F.col("beyond.size"), F.lit(0))
    first = F.struct("beyond.rank", "beyond.key", "beyond.digest")
    ends = inner.groupBy("source").agg(
        F.first("beyond").alias("beyond"), F.first("left").alias("left"),
        F.max(F.when(here < first, here)).alias("before"), F.max(F.when((here > first) & (skipped <= F.col("left")), here)).alias("after"),
        F.max(F.when((here < first), F.col("upto")).when((here > first) & (skipped <= F.col("left")), skipped)).alias("reached"))
    take = F.col("beyond.upto") - F.col("left") <= F.col("left") - F.coalesce("reached", F.lit(0))
    first = F.struct("beyond.rank", "beyond.key", "beyond.digest")
    ends = ends.select("source", F.when(take, first).otherwise(F.coalesce("after", "before")).alias("last"),
                       F.when(~take, first).alias("passed"))
    return plan, cut(edge.alias("e").join(ends.alias("l"), _same("e", "l"), "left").select("e.source", "edge_bin", "last", "passed"))


def _decided(rows: DataFrame, settled: tuple[DataFrame, DataFrame], seed: int) -> DataFrame:
    """``rows`` with copies and taken: an expression of each row and the small tables, without ordering anything."""
    plan, edge = settled
    placed = _ranked(rows, plan, seed).alias("d").join(edge.alias("e"), _same("d", "e")).select("d.*", "edge_bin", "last", "passed")
    here = F.struct("rank", "key", "digest")
    listed = F.coalesce((here <= F.col("last")) & ~F.coalesce(here == F.col("passed"), F.lit(False)), F.lit(False))
    by_rank = F.col("edge_bin").isNull() | (F.col("bin") < F.col("edge_bin")) | listed
    copies = F.col("sure") + (F.col("bin").isNotNull() & by_rank).cast("long")
    return placed.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: int = 8,
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(key, size, source_size, target, copies, taken) for every row of ``docs``; other columns are left out.

    size: words of the text, 0 for null and empty. Null sources are one source. A document is taken as a whole,
    ``copies`` times, never above ``most``. A source's taken words differ from its target by less than half a
    document. Ties rank by key, then text digest, so reruns agree; rows equal in key and text are in or out
    together. A row without words is never taken. An empty table gives an empty result.
    """
    need(docs, text, key, source)
    rows = cut(docs.select(*_measured(docs, text, key, source)))
    settled = _settled(rows, weights, share, most, seed)
    return _decided(rows, settled, seed).select(F.col("key").alias(key), "size", "source_size", "target", "copies", "taken")


def repeat(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", seed: int = 8,
           weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``docs`` with every row as often as ``mix`` takes it; columns stay as they are. The texts are not shuffled."""
    need(docs, text, key, source)
    measured = _measured(docs, text, key, source)
    settled = _settled(cut(docs.select(*measured)), weights, share, most, seed)
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("whole"), *measured)
    return _decided(whole, settled, seed).where("copies > 0") \
        .select("whole", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("whole.*")
