"""Near-duplicate embeddings by NN-descent.

Equal vectors form one node. A neighbour graph starts from random-hyperplane buckets and is refined: around every
pivot its neighbours and those that list it are compared with each other, because neighbours of neighbours are
likely neighbours. A list of the best few is kept per node; one whose entries all reach the threshold is
saturated and kept longer. Every comparison also returns a spanning forest of the pairs at the threshold. An audit of fixed size, with
nodes from groups of every size, compares them with all nodes and starts rounds from more tables if nodes with few or with many partners
miss too large a part of them. If the last try falls short as well, the nodes from groups of the sizes that miss partners are compared
with all nodes exactly. Within the groups found, every pair is then compared exactly in blocks, which takes the place of ever longer lists.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargolens.llm.common import Forest, lean_batches, need, whole_groups
from cargolens.operators.density import connected_components
from cargolens.session import cut, num_shuffle_partitions

COSINE = 0.9
LIST, LONG_LIST = 10, 40
TOGETHER = 40
TABLES, ROUNDS, SETTLED = 4, 4, 0.02
#: Nodes audited per class of group sizes, part of its partners that a node has to find in the mean over the nodes of every class, tries.
AUDIT, RECALL, TRIES = 512, 0.98, 3
#: Least sizes of the classes: of groups found, for the sample, and of the number of partners, for the recall.
SIZES = (1, 2, 4, 32)
#: Nodes that are sent to all tasks at once in the exact search, and rows compared with them at once.
SENT, ROWS = 1 << 15, 256
BLOCK = 512


def _noded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Id, node (a digest of the vector), dimensions and unit vector; no node where the vector can't be compared."""
    for batch in batches:
        node, unit, dims = [], [], []
        for v in batch.column("v").to_pylist():
            x = np.array(v, np.float64) if v is not None and None not in v else np.zeros(0)
            top = np.abs(x).max() if len(x) else 0.0
            if not np.isfinite(top) or top == 0:
                node.append(None)
                unit.append(None)
                dims.append(None)
                continue
            scaled = x / top  # so that squares neither overflow nor vanish
            node.append(int.from_bytes(hashlib.blake2b((x + 0.0).tobytes(), digest_size=8).digest(), "little", signed=True))
            unit.append((scaled / np.sqrt(scaled @ scaled)).tobytes())
            dims.append(len(x))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(node, pa.int64()), pa.array(dims, pa.int32()), pa.array(unit, pa.binary())],
                                         names=["id", "node", "dims", "unit"])


def _matrix(column) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.float64).reshape(len(parts), -1)


def _buckets(tables: int, bits: int, seed: int):
    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dims"))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = _matrix(batch.column("unit").take(pa.array(at)))
                planes = np.random.default_rng([seed, int(d)]).normal(size=(d, tables * bits))
                side = (x @ planes > 0).reshape(len(at), tables, bits)
                code = (side * (1 << np.arange(bits))).sum(axis=2) * tables + np.arange(tables)
                key = code * 4099 + int(d)
                node = batch.column("node").take(pa.array(at))
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(key[:, t].astype(np.int64)), node], names=["pivot", "node"])

    return bucket


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In every small group: each member's best partners if better than what it has, and a forest of the linked pairs."""
    for table, at in whole_groups(batches, "pivot", "chunk"):
        nodes, least, units = np.asarray(table["node"]), np.asarray(table["least"]), table["unit"].combine_chunks()
        a, b, s, tree = [], [], [], []
        for i, j in zip(at[:-1], at[1:]):
            own, first = np.unique(nodes[i:j], return_index=True)
            if len(own) < 2:
                continue
            x = _matrix(units.slice(i, j - i))[first]
            cosine = x @ x.T
            np.fill_diagonal(cosine, -2)
            floor = least[i:j][first]
            best = np.argsort(-cosine, axis=1)[:, :min(LIST, len(own) - 1)]
            value = np.take_along_axis(cosine, best, axis=1)
            row, column = np.nonzero(value > floor[:, None])
            a.append(own[row])
            b.append(own[best[row, column]])
            s.append(value[row, column])
            tree.append(np.zeros(len(row), bool))
            forest = Forest(len(own))
            linked = [(p, q) for p, q in zip(*np.nonzero(np.triu(cosine >= COSINE))) if forest.join(int(p), int(q))]
            if linked:
                p, q = np.array(linked).T
                a.append(own[p])
                b.append(own[q])
                s.append(cosine[p, q])
                tree.append(np.ones(len(p), bool))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, s, tree)], names=["a", "b", "cosine", "tree"])


def _met(members: DataFrame, vectors: DataFrame, least: DataFrame | None, turn: int) -> DataFrame:
    """Compare the members (pivot, node) of every pivot, in random groups of bounded size where there are many."""
    spark = members.sparkSession
    sizes = members.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunk = F.pmod(F.xxhash64("pivot", "node", F.lit(turn)), F.ceil(F.col("n") / TOGETHER)).cast("int")
    dealt = members.join(sizes, "pivot").select("pivot", "node", chunk.alias("chunk"))
    have = vectors.select("node", "unit")
    have = have.withColumn("least", F.lit(-2.0)) if least is None else have.join(least, "node", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    return cut(dealt.join(have, "node").repartition(num_shuffle_partitions(spark), "pivot", "chunk").sortWithinPartitions("pivot", "chunk")
               .select("pivot", "chunk", "node", "least", "unit").mapInArrow(_compare, "a bigint, b bigint, cosine double, tree boolean"))


def _best(edges: DataFrame) -> DataFrame:
    """Lists of the best few; saturated ones, whose entries all reach the threshold, go on."""
    order = F.row_number().over(W.partitionBy("a").orderBy(F.desc("cosine"), "b"))
    ranked = edges.groupBy("a", "b").agg(F.max("cosine").alias("cosine")).withColumn("place", order).where(F.col("place") <= LONG_LIST)
    return ranked.where((F.col("place") <= LIST) | (F.col("cosine") >= COSINE)).drop("place")


def _near(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Which rows of ``y`` are linked with the rows of ``x``, by (first row, table) for a few rows of ``x`` at a time."""
    for i in range(0, len(x), ROWS):
        yield i, x[i:i + ROWS] @ y.T >= COSINE


def _asked(rows: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By dimensions: unit vectors, groups, nodes and row numbers."""
    dims = np.asarray(rows["dims"]) if rows.num_rows else np.zeros(0)
    out = {}
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        part = rows.take(pa.array(at))
        out[int(d)] = _matrix(part["unit"]), np.asarray(part["group"]), np.asarray(part["node"]), at
    return out


def _audited(sent, n: int):
    def audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, found = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            dims, group, node = np.asarray(batch.column("dims")), np.asarray(batch.column("group")), np.asarray(batch.column("node"))
            for d, (x, own_group, own_node, number) in sent.value.items():
                at = np.flatnonzero(dims == d)
                if len(at):
                    for i, near in _near(_matrix(batch.column("unit").take(pa.array(at))), x):
                        some = at[i:i + ROWS]
                        near &= node[some][:, None] != own_node[None, :]
                        there[number] += near.sum(axis=0)
                        found[number] += (near & (group[some][:, None] == own_group[None, :])).sum(axis=0)
        some = np.flatnonzero(there)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(there[some]), pa.array(found[some])], names=["number", "there", "found"])

    return audit


def _placed(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """Nodes with their group and the class of its size."""
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    size_class = sum((F.col("n") >= k).cast("int") for k in SIZES[1:])
    return cut(vectors.join(groups, "node").join(sizes, "group").select("node", "dims", "unit", "group", size_class.alias("size_class")))


def _recall(placed: DataFrame, turn: int) -> tuple[float, list[int]]:
    """The worst recall of nodes with few or many partners, and the classes of group sizes where partners are missing.

    Sampled nodes of every class of group sizes are compared with all nodes. A node's recall is the part of its partners that is in its own
    group; the mean over nodes counts a sampled node for as many as it stands for, so a large group has no more weight than its nodes.
    """
    spark = placed.sparkSession
    totals = {r.size_class: r.n for r in placed.groupBy("size_class").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals:
        return 1.0, []
    parts = [placed.where(F.col("size_class") == c).orderBy(F.xxhash64("node", F.lit(turn)), "node").limit(AUDIT).toArrow() for c in sorted(totals)]
    rows = pa.concat_tables(parts).combine_chunks()  # a fixed number of nodes
    sent = spark.sparkContext.broadcast(_asked(rows))
    counts = placed.mapInArrow(_audited(sent, rows.num_rows), "number bigint, there bigint, found bigint") \
        .groupBy("number").agg(F.sum("there").alias("there"), F.sum("found").alias("found")).toArrow()
    number, there, found = (np.asarray(counts[c]) for c in ("number", "there", "found"))
    own = np.asarray(rows["size_class"])
    weight = np.array([totals[c] / np.sum(own == c) for c in own])[number]
    many = np.searchsorted(SIZES, there, "right")
    means = [np.average((found / there)[many == k], weights=weight[many == k]) for k in np.unique(many)]
    return float(min(means, default=1.0)), sorted({int(c) for c in own[number][found < there]})


def _bridging(sent):
    def bridge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            dims, group, node = np.asarray(batch.column("dims")), np.asarray(batch.column("group")), np.asarray(batch.column("node"))
            a, b = [], []
            for d, (x, own_group, own_node, _) in sent.value.items():
                at = np.flatnonzero(dims == d)
                if len(at):
                    for i, near in _near(_matrix(batch.column("unit").take(pa.array(at))), x):
                        some = at[i:i + ROWS]
                        near &= group[some][:, None] != own_group[None, :]
                        for p, q in zip(*np.nonzero(near)):
                            pair = int(group[some[p]]), int(own_group[q])
                            if pair not in seen:
                                seen.add(pair)
                                a.append(int(node[some[p]]))
                                b.append(int(own_node[q]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return bridge


def _searched(placed: DataFrame, classes: list[int]) -> DataFrame | None:
    """Exact search: links (a, b) between groups, of all nodes in groups of these classes of sizes with all nodes.

    The nodes go to all tasks in parts of a fixed size; of the links between two groups a task keeps one.
    """
    rest = placed.where(F.col("size_class").isin(classes))
    parts, out = math.ceil(rest.count() / SENT), None
    for part in range(parts):
        rows = rest.where(F.pmod(F.xxhash64(F.lit("part"), "node"), F.lit(parts)) == part).toArrow().combine_chunks()
        sent = placed.sparkSession.sparkContext.broadcast(_asked(rows))
        found = cut(placed.mapInArrow(_bridging(sent), "a bigint, b bigint"))
        sent.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table, at in whole_groups(batches, "group", "i", "j"):
        for s, e in zip(at[:-1], at[1:]):
            part = table.slice(s, e - s)
            x, members, block = _matrix(part["unit"]), np.asarray(part["members"]), np.asarray(part["block"])
            link = x @ x.T >= COSINE
            np.fill_diagonal(link, False)
            if part["i"][0] != part["j"][0]:
                link &= block[:, None] != block[None, :]
            count = link @ members
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([part["node"].combine_chunks().take(pa.array(some)), pa.array(count[some])], names=["node", "links"])


def link(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", seed: int = 5) -> DataFrame:
    """(key, n_links, component_id, kept) for every row.

    n_links: other rows linked directly, equal vectors among them. component_id: the smallest key reachable by
    links, the row's own included. Vectors that are null, zero, empty or hold null or non-finite components link with nothing;
    vectors of different lengths don't link. Rows that repeat a key and a vector link with each other. A null key
    comes last in the order. An empty table gives an empty result.
    """
    need(rows, vector, key)
    spark = rows.sparkSession
    lean_batches(spark)
    kind = rows.schema[key].dataType.simpleString()
    noded = cut(rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(
        _noded, f"id {kind}, node bigint, dims int, unit binary"))
    vectors = cut(noded.where("node IS NOT NULL").groupBy("node").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("members"), F.first("dims").alias("dims"), F.first("unit").alias("unit")))
    n = vectors.count()
    bits = max(1, min(40, math.ceil(math.log2(max(2, n / 24)))))
    lists = trees = None
    for attempt in range(TRIES):
        start = vectors.select("node", "dims", "unit").mapInArrow(_buckets(TABLES << attempt, bits, seed + attempt), "pivot bigint, node bigint")
        found = _met(start, vectors, None, attempt)
        for turn in range(ROUNDS):
            fresh = found.where("NOT tree").select("a", "b", "cosine")
            lists = cut(_best(fresh if lists is None else lists.unionByName(fresh)))
            tree = found.where("tree").select("a", "b")
            trees = tree if trees is None else trees.unionByName(tree)
            if turn == ROUNDS - 1:
                break
            least = lists.groupBy(F.col("a").alias("node")).agg(F.min("cosine").alias("least"), F.count(F.lit(1)).alias("n")) \
                .where(F.col("n") >= LIST).drop("n")
            both = lists.select(F.col("a").alias("pivot"), F.col("b").alias("node")).unionByName(lists.select(F.col("b").alias("pivot"), F.col("a").alias("node")))
            itself = vectors.select(F.col("node").alias("pivot"), "node")
            found = _met(both.unionByName(itself).distinct(), vectors, least, turn + 100 * attempt)
            if found.where("NOT tree").count() <= SETTLED * LIST * n:
                break
        trees = cut(trees.unionByName(found.where("tree").select("a", "b")).distinct())
        groups = cut(connected_components(vectors.select("node"), trees).select("node", F.col("root").alias("group")))
        placed = _placed(vectors, groups)
        recall, short = _recall(placed, attempt)
        if recall >= RECALL:
            break
    else:
        more = _searched(placed, short)
        groups = cut(connected_components(vectors.select("node"), trees.unionByName(more)).select("node", F.col("root").alias("group")))
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    inside = groups.join(sizes, "group").join(vectors.select("node", "members", "unit"), "node") \
        .withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    paired = inside.select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("o")).withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")})
    links = paired.select("group", "i", "j", "block", "node", "members", "unit").repartition(num_shuffle_partitions(spark), "group", "i", "j") \
        .sortWithinPartitions("group", "i", "j").mapInArrow(_counted, "node bigint, links bigint") \
        .groupBy("node").agg(F.sum("links").alias("links"))
    order = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"))
    smallest = groups.join(vectors.select("node", "id"), "node").groupBy("group").agg(F.min(order)["id"].alias("component"))
    result = groups.join(vectors.select("node", "members"), "node").join(links, "node", "left").join(smallest, "group") \
        .select("node", "component", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("links"))
    return noded.select("id", "node").join(result, "node", "left").select(
        F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"),
        F.when(F.col("node").isNull(), F.lit(True)).otherwise(F.col("id").eqNullSafe(F.col("component"))).alias("kept"))
