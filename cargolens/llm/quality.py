"""Quality rules with risk-controlled thresholds.

A rule rejects a text whose ratio lies beyond a cutoff. Cutoffs are chosen on labelled rows: per stratum and
rule they are tried from lenient to strict, in an order fixed beforehand, and a cutoff is accepted while the exact
binomial (Clopper-Pearson) bound says that at most the allowed part of good texts is rejected. The first
cutoff that fails ends the sequence, so a sequence needs one test level; the levels of all sequences are
shared out by Holm's step-down correction. Of the accepted cutoffs the most lenient that rejects the most bad
texts is used, if bad texts gain clearly. With the given confidence no accepted cutoff, in any stratum, rejects more good texts than allowed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.functions.pvalues import beta_cdf
from cargolens.llm import common
from cargolens.llm.common import need
from cargolens.session import cut

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
WINDOW = 5
#: Part of a stratum's good texts that all rules together may reject, and the chance that this fails anywhere.
RISK, DELTA = 0.05, 0.05
#: Of the accepted cutoffs, one is used only if it rejects bad texts so many times as often as good ones.
GAIN = 20
_SYMBOLS = np.zeros(256, np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1


@dataclass(frozen=True)
class Rule:
    """Rejects when ``top`` / ``below`` is above the cutoff (or under it, if ``under``), in thousandths."""

    name: str
    top: str
    below: str
    under: bool
    part: float  # of the risk; the parts of all rules add up to 1
    grid: tuple[int, ...]  # from lenient to strict

    def reject(self, cutoff: Column) -> Column:
        top, below = F.col(self.top) * 1000, F.col(self.below)
        return F.coalesce(top < cutoff * below if self.under else top > cutoff * below, F.lit(False))


RULES = (
    Rule("symbols", "n_symbols", "n_words", False, 0.6, tuple(range(3000, 0, -50))),
    Rule("repeated lines", "n_dup_lines", "n_lines", False, 0.1, tuple(range(950, 0, -25))),
    Rule("repeated words", "n_repeat_words", "n_words", False, 0.1, tuple(range(200, 0, -5))),
    Rule("short words", "word_chars", "n_words", True, 0.1, tuple(range(1000, 4000, 50))),
    Rule("long words", "word_chars", "n_words", False, 0.1, tuple(range(15000, 6000, -150))),
)


def _counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    n = len(offsets) - 1
    starts, ends, rows = common.word_spans(data, offsets)
    words = common.word_hashes(data, starts, ends)
    n_words = np.bincount(rows, minlength=n)

    def total(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(x)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    chars = total(~common.IS_SPACE[data] & ((data & 0xC0) != 0x80))
    symbols = total(_SYMBOLS[data])
    # Lines, by their bytes; a line counts if a word starts in it.
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
    begin = begin[begin < len(data)]
    stop = np.append(begin[1:], len(data)) if len(begin) else begin
    stop = stop - ((stop > begin) & (data[np.maximum(stop - 1, 0)] == 10)) if len(begin) else stop
    has = np.searchsorted(starts, stop) > np.searchsorted(starts, begin)
    begin, stop = begin[has], stop[has]
    row = np.searchsorted(offsets, begin, "right") - 1
    n_lines = np.bincount(row, minlength=n)
    salt = common.mix(row.astype(np.uint64) + np.uint64(1))
    line, at = np.unique(common.word_hashes(data, begin, stop) ^ salt, return_index=True)
    n_dup = n_lines - np.bincount(row[at], minlength=n)
    # Windows of words found again in their text, and the words under them.
    left = np.cumsum(n_words)[rows] - np.arange(len(rows)) if len(rows) else rows
    first = np.flatnonzero(left >= WINDOW)
    run = common.mix(rows[first].astype(np.uint64) + np.uint64(1))
    for k in range(WINDOW):
        run = common.mix(run + words[first + k] * np.uint64(2 * k + 3))
    order = np.argsort(run)
    same = np.zeros(len(run), bool)
    if len(run) > 1:
        twin = run[order[1:]] == run[order[:-1]]
        same[order[1:]] |= twin
        same[order[:-1]] |= twin
    edge = np.zeros(len(rows) + 1, np.int64)
    np.add.at(edge, first[same], 1)
    np.add.at(edge, first[same] + WINDOW, -1)
    covered = np.cumsum(edge)[:-1] > 0
    return [n_words, chars, symbols, n_dup, np.bincount(rows[covered], minlength=n), n_lines]


def feature_column(text: Column) -> Column:
    """struct of the counts of a text; all 0 for null."""

    @F.arrow_udf(", ".join(f"{f} bigint" for f in FEATURES))
    def apply(column: pa.Array) -> pa.Array:
        parts = [_counts(data, offsets) for _, _, data, offsets in common.text_blocks(common.text_column(column))]
        whole = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(len(FEATURES))]
        return pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in whole], names=list(FEATURES))

    return apply(text.cast("string"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text but with its counts; input columns of their names are replaced."""
    need(docs, text)
    common.lean_batches(docs.sparkSession)
    made = common.own_name(docs, "_made")
    out = docs.withColumn(made, feature_column(F.col(text)))
    return out.withColumns({f: F.col(f"{made}.{f}") for f in FEATURES}).drop(made, text)


def upper_bound_holds(rejected: int, good: int, allowed: float, level: float) -> bool:
    """Whether the exact upper bound at ``level`` of the part rejected is at most ``allowed``.

    That is: so few rejections would have a probability of at most ``level`` if the part were ``allowed``.
    """
    if good <= 0 or rejected >= good:
        return False
    return 1 - beta_cdf(rejected + 1, good - rejected, allowed) <= level


@dataclass
class Cutoffs:
    """Per stratum and rule the strictest accepted cutoff, with its evidence."""

    rows: list[tuple[str | None, str, int, int, int]]  # stratum, rule, cutoff, rejected, good

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.rows, "stratum string, rule string, cutoff int, rejected long, good long")


def _accepted(counts: dict[tuple, np.ndarray], good: dict, bad: dict[tuple, np.ndarray], n_bad: dict, risk: float, delta: float) -> Cutoffs:
    """Holm over sequences: the sequence that gets farthest on the smallest level goes first, and frees its level for the rest."""
    todo = [(s, r) for s in good for r in range(len(RULES))]

    def walk(key: tuple, level: float, start: int) -> int:
        stratum, r = key
        at = start
        while at < len(RULES[r].grid) and upper_bound_holds(int(counts[key][at]), good[stratum], risk * RULES[r].part, level):
            at += 1
        return at

    # A sequence's hypotheses are tested in order at the level it has; only a finished sequence hands its level on.
    reached = {k: 0 for k in todo}
    while todo:
        level = delta / len(todo)
        for k in todo:
            reached[k] = walk(k, level, reached[k])
        done = [k for k in todo if reached[k] == len(RULES[k[1]].grid)]
        if not done:
            break
        todo = [k for k in todo if k not in done]
    rows = []
    for (stratum, r), n in reached.items():
        use = [i for i in range(n) if bad[stratum, r][i] * good[stratum] >= GAIN * (counts[stratum, r][i] + 1) * n_bad[stratum] > 0]
        if use:
            i = max(use, key=lambda i: (bad[stratum, r][i], -i))
            rows.append((stratum, RULES[r].name, RULES[r].grid[i], int(counts[stratum, r][i]), good[stratum]))
    return Cutoffs(rows)


def choose(features: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id", quality: str = "quality",
           risk: float = RISK, delta: float = DELTA) -> Cutoffs:
    """Cutoffs from the labelled rows of ``features``; good texts are those of quality 1 that pass the base rules.

    A null stratum is one of its own. Rows without a label, and labels without a row, say nothing. A key labelled
    good and bad counts as bad. What comes to the driver is a row per stratum.
    """
    need(features, key, stratum)
    need(labels, key, quality)
    marks = labels.where(F.col(quality).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(quality).alias("quality"))
    ours = features.where(~base_failed()).select(F.col(key), F.col(stratum).cast("string").alias("stratum"), *FEATURES)
    held = ours.join(marks.select(F.col(key), F.col("quality").cast("int").alias("good")), key).where("good IN (0, 1)")
    # How many of a rule's cutoffs reject a row: rejections grow along the sequence.
    first = [F.size(F.filter(F.array(*[F.lit(c) for c in r.grid]), r.reject)) for r in RULES]
    depths = held.select("stratum", "good", F.posexplode(F.array(*first)).alias("rule", "depth")) \
        .groupBy("stratum", "good", "rule", "depth").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per stratum, mark and cutoff at most
    strata = {row["stratum"] for row in depths}
    counts = [{(s, r): np.zeros(len(RULES[r].grid), np.int64) for s in strata for r in range(len(RULES))} for _ in range(2)]
    totals = [dict.fromkeys(strata, 0) for _ in range(2)]
    for row in depths:
        if row["rule"] == 0:
            totals[row["good"]][row["stratum"]] += row["n"]
        if row["depth"]:
            counts[row["good"]][row["stratum"], row["rule"]][len(RULES[row["rule"]].grid) - row["depth"]:] += row["n"]
    return _accepted(counts[1], totals[1], counts[0], totals[0], risk, delta)


def judge(features: DataFrame, cutoffs: Cutoffs, stratum: str = "lang") -> DataFrame:
    """``features`` with base_failed and kept. A stratum without an accepted cutoff rejects nothing more."""
    spark = features.sparkSession
    wide = cutoffs.table(spark).groupBy("stratum").pivot("rule", [r.name for r in RULES]).agg(F.first("cutoff"))
    s = common.own_name(features, "_stratum")
    wide = wide.select(F.col("stratum").alias(s), *[F.col(f"`{r.name}`").alias(f"{s}_{i}") for i, r in enumerate(RULES)])
    out = features.join(wide, F.col(stratum).cast("string").eqNullSafe(F.col(s)), "left")
    bad = F.lit(False)
    for i, r in enumerate(RULES):
        bad = bad | r.reject(F.col(f"{s}_{i}"))
    out = out.withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & ~bad).select(*[c for c in features.columns if c not in ("base_failed", "kept")], "base_failed", "kept")


def rate(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """key, stratum, counts, base_failed and kept for every row of ``docs``. Null and empty texts have counts of 0 and fail the base rules.

    Repeated rows are judged alike; each counts as a labelled row if its key has a label. Without rows or labels no cutoff is accepted.
    """
    features = cut(measured(docs.select(key, stratum, text), text))
    return judge(features, choose(features, labels, stratum, key), stratum)
