"""Ranked lexical search without random access: lists are read in order of impact until all is resolved.

One pass over the texts writes, per document, its length and how often it holds the terms of the queries. Document
counts per term follow from that table; then every task indexes its own documents block by block: one list per term,
sorted by impact. A query reads all its lists in step. For each document met it holds what was read so far (the lower
end of its score) and what the lists in which it has not been seen could still add (the upper end). The k-th best lower end, of this block and of those
before, is the mark to beat: reading goes on until no document outside the answer can reach it and the scores inside are
exact. So blocks without a good document are left early. The best of all tasks meet in one last ranking.

Queries are sent to the tasks in blocks of at most about TERMS terms; every block of queries meets all documents. Terms are told
apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cargolens.llm import common
from cargolens.llm.common import need
from cargolens.session import cut

TOP = 10
#: Weight of a document's length in per cent; factors of the score's whole-number form.
LENGTH, UNIT, FACTOR, SLOPE = 75, 1_000_000_000, 1000, 8
#: Terms of the queries sent at once; entries of a task's index; entries first read from each list.
TERMS, BLOCK, DEPTH = 1 << 18, 1 << 21, 64

#: Terms are made of digits, letters and all characters beyond ASCII.
OUTSIDE = np.zeros(256, bool)
OUTSIDE[:128] = [not chr(i).isalnum() for i in range(128)]


def _terms(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows of a block, row of each term, hash)."""
    for a, b, data, offsets in common.text_blocks(common.text_column(column)):
        starts, ends, rows = common.word_spans(data, offsets, OUTSIDE)
        yield b - a, rows, common.word_hashes(data, starts, ends, fold=True)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of every query, repeats included."""
    for batch in batches:
        lists = [common.list_array(h.view(np.int64), row, n, pa.int64()) for n, row, h in _terms(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("item"), pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int64()))],
                                         names=["item", "terms"])


def _held(sent):
    """Per document: number of terms, and which query terms it holds how often."""

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for batch in batches:
            size, terms, times = [], [], []
            for n, rows, h in _terms(batch.column("text")):
                size.append(np.bincount(rows, minlength=n))
                at = np.searchsorted(wanted, h)
                at[at == len(wanted)] = 0
                hit = wanted[at] == h if len(wanted) else np.zeros(len(h), bool)
                pair, count = np.unique(rows[hit].astype(np.int64) * max(1, len(wanted)) + at[hit], return_counts=True)
                row, term = pair // max(1, len(wanted)), pair % max(1, len(wanted))
                terms.append(common.list_array(term.astype(np.int32), row, n, pa.int32()))
                times.append(common.list_array(count.astype(np.int64), row, n, pa.int64()))
            if size:
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.concatenate(size), pa.int64()), pa.concat_arrays(terms), pa.concat_arrays(times)],
                                                 names=["key", "n", "terms", "times"])

    return hold


@dataclass
class Plan:
    """What a task needs for a block of queries: weights of the terms, the queries' terms and their repeats, corpus sizes."""

    weight: np.ndarray
    queries: list[tuple[np.ndarray, np.ndarray]]
    docs: int
    total: int
    top: int


def _order(pair: tuple[int, object]):
    score, key = pair
    return -score, key is None, key if key is not None else 0


class Index:
    """Lists of one block of documents, each sorted by falling impact."""

    def __init__(self, plan: Plan, keys: list, n: np.ndarray, doc: np.ndarray, term: np.ndarray, times: np.ndarray):
        self.keys = keys
        m = 100 - LENGTH + (LENGTH * n * plan.docs) // plan.total
        impact = plan.weight[term] * ((UNIT * times) // (FACTOR * times + SLOPE * m[doc]))
        order = np.lexsort((-impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.ends = np.searchsorted(term[order], np.arange(len(plan.weight) + 1))
        self.lower = np.zeros(len(keys), np.int64)

    def best(self, terms: np.ndarray, repeats: np.ndarray, before: list[tuple[int, object]], top: int) -> list[tuple[int, object]]:
        """``before`` (the best so far) and this block's documents: the ``top`` best of all, with final scores."""
        start, end = self.ends[terms], self.ends[terms + 1]
        some = end > start
        start, end, repeats = start[some].copy(), end[some], repeats[some]
        lower = self.lower
        lower[:] = 0
        seen = np.zeros((len(lower), -(-len(start) // 64)), np.uint64)
        bound = self.impact[start] * repeats  # the most that an unread entry of each list can add
        marks = [s for s, _ in before]
        depth = DEPTH
        found = np.zeros(0, np.int64)
        while True:
            lists = np.flatnonzero(start < end)
            for i in lists:
                upto = min(start[i] + depth, end[i])
                doc = self.doc[start[i]:upto]
                lower[doc] += self.impact[start[i]:upto] * repeats[i]
                seen[doc, i >> 6] |= np.uint64(1 << (int(i) & 63))
                start[i] = upto
                bound[i] = self.impact[upto] * repeats[i] if upto < end[i] else 0
            depth *= 2
            # The mark to beat: the k-th best of all lower ends.
            k = min(top, len(lower))
            ends = np.concatenate([np.partition(lower, len(lower) - k)[len(lower) - k:], np.array(marks, np.int64)])
            mark = max(1, int(np.sort(ends)[-top])) if len(ends) >= top else 1
            rest = int(bound.sum())
            if rest >= mark:
                continue  # a document not met yet could still reach it; without unread entries rest is 0
            found = np.flatnonzero(lower + rest >= mark)
            upper = lower[found].copy()
            for i in np.flatnonzero(bound):
                upper += np.where(seen[found, i >> 6] >> np.uint64(int(i) & 63) & np.uint64(1), 0, bound[i])
            use = upper >= mark
            found = found[use]
            if (upper[use] == lower[found]).all():
                break
        return sorted(before + [(int(lower[i]), self.keys[i]) for i in found], key=_order)[:top]


def _searched(sent, kind: pa.DataType):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Plan = sent.value
        best: list[list] = [[] for _ in plan.queries]
        held: list[pa.RecordBatch] = []
        entries = 0

        def take() -> None:
            table = pa.Table.from_batches(held)
            terms = table["terms"].combine_chunks()
            times = np.asarray(table["times"].combine_chunks().flatten())
            doc = np.repeat(np.arange(table.num_rows), np.diff(np.asarray(terms.offsets)))
            index = Index(plan, table["key"].to_pylist(), np.asarray(table["n"]), doc, np.asarray(terms.flatten()), times)
            for q, (who, repeats) in enumerate(plan.queries):
                best[q] = index.best(who, repeats, best[q], plan.top)

        for batch in batches:
            held.append(batch)
            entries += len(batch.column("terms").flatten())
            if entries > BLOCK:
                take()
                held, entries = [], 0
        if held:
            take()
        rows = [(q, key, score) for q, found in enumerate(best) for score, key in found]
        item, key, score = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(key, kind), pa.array(score, pa.int64())], names=["query", "key", "score"])

    return search


def rank(docs: DataFrame, queries: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text",
         top: int = TOP) -> DataFrame:
    """(item, rank, key, score): the ``top`` best documents of every query, equal scores by ascending key.

    Null texts have no terms; a query without terms, or whose terms no document holds, has no rows, and so has every
    query if no document has a term. Queries equal in id and text are one query; two texts under one id are two
    queries. Repeated documents are ranked one by one, null keys last. Texts of any length are counted whole.
    """
    need(docs, text, key)
    need(queries, item, item_text)
    spark = docs.sparkSession
    common.lean_batches(spark)
    item_kind, key_kind = queries.schema[item].dataType, docs.schema[key].dataType
    asked = queries.select(F.col(item).alias("item"), F.col(item_text).cast("string").alias("text")).distinct()
    listed = cut(asked.mapInArrow(_listed, f"item {item_kind.simpleString()}, terms array<bigint>").where(F.size("terms") > 0))
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    blocks = -(-(listed.agg(F.sum(F.size("terms"))).first()[0] or 0) // TERMS)
    out = spark.createDataFrame([], f"item {item_kind.simpleString()}, query int, block int, key {key_kind.simpleString()}, score bigint")
    for block in range(blocks):
        part = listed.where(F.pmod(F.xxhash64("terms"), F.lit(blocks)) == block).toArrow()
        if not part.num_rows:
            continue
        lists = [np.array(x, np.int64).view(np.uint64) for x in part["terms"].to_pylist()]
        wanted = np.unique(np.concatenate(lists))
        posted = cut(rows.mapInArrow(_held(spark.sparkContext.broadcast(wanted)), f"key {key_kind.simpleString()}, n bigint, terms array<int>, times array<bigint>"))
        sizes = posted.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
        if not sizes[0]:
            break
        held = posted.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()  # at most a row per query term
        df = np.zeros(len(wanted), np.int64)
        df[np.asarray(held["term"])] = np.asarray(held["count"])
        weight = np.array([math.floor(1000 * math.log((2 * sizes[0] + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        asks = []
        for terms in lists:
            term, repeats = np.unique(np.searchsorted(wanted, terms), return_counts=True)
            asks.append((term, repeats.astype(np.int64)))
        sent = spark.sparkContext.broadcast(Plan(weight, asks, sizes[0], sizes[1], top))
        found = posted.where("size(terms) > 0").mapInArrow(_searched(sent, to_arrow_type(key_kind)), f"query int, key {key_kind.simpleString()}, score bigint")
        names = spark.createDataFrame(pa.table({"query": pa.array(range(part.num_rows), pa.int32()), "item": part["item"]}))
        out = out.unionByName(cut(found).join(names, "query").withColumn("block", F.lit(block)))
    order = W.partitionBy("block", "query").orderBy(F.desc("score"), F.asc_nulls_last("key"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top) \
        .select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")
