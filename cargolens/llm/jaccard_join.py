"""N-gram Jaccard join by chosen paths.

Documents are sets of five-word shingles. Equal sets form one class, and the join runs over classes. A
class's set is embedded as tokens (i, its smallest shingle under hash i). In every run a class walks down a tree: a node samples one or two coordinates, and
classes with the same token there meet in a child. Small children are compared by brute force; large ones
are split again. Runs are repeated until a pair at the threshold is missed at most as often as the target
recall allows, and then until an audit, in which sampled classes meet all others, finds that recall. Pairs that a node brings together only say which classes belong to one candidate group;
within each group every pair is then compared exactly, block by block, so no link inside it is lost and no
list of pairs is ever written: a block pair returns link counts and a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargolens.llm import common
from cargolens.llm.common import Forest, drawn_together, mix, need, tidy, whole_groups
from cargolens.operators.density import connected_components
from cargolens.session import cut, num_shuffle_partitions

SHINGLE = 5
NUM, DEN = 4, 5  # a link: Jaccard similarity of at least 4/5, compared in whole numbers
TOKENS = 64
#: Tokens shared by a pair of similarity 0.8 in all but about 2 of 10,000 cases (3.5 standard deviations).
ENOUGH = 40
#: Nodes compared by brute force, with the comparisons a class may have there in the mean; what is left then is split
#: again. Classes of a larger node that are far from its first and still compared with all of it.
SMALL, COMPARED, FEW = 1 << 17, 8192, 1024
#: Coordinates sampled per node, in the mean: above 1 / 0.8, so that a pair at the threshold lives on.
BRANCH = 1.43
#: Chance that a run brings such a pair together, taken low: the survival of that branching walk.
RUN_RECALL = 0.37
DEPTH = 8
#: Classes drawn for the audit of the recall, tokens shared by a pair that counts there, batches of further runs.
AUDIT, SURE, TRIES = 256, 52, 8
#: Classes of a large node that are compared with a few others at once; classes and shingles of a block.
CHUNK, BLOCK, BLOCK_SHINGLES = 256, 1024, 1 << 21
_SEEDS = np.random.default_rng(9).integers(1, 1 << 63, (2, TOKENS), dtype=np.uint64)


def runs_for(recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - RUN_RECALL)))


def _sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows of a block, row of each distinct shingle, shingle), sorted by row."""
    for a, b, data, offsets in common.text_blocks(common.text_column(column)):
        starts, ends, rows = common.word_spans(data, offsets)
        words = common.word_hashes(data, starts, ends)
        row, h = common.shingle_hashes(words, rows, b - a, SHINGLE)
        yield b - a, row, h


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size, cls, sig, sketch = [], [], [], []
        for n, row, h in _sets(batch.column("text")):
            count = np.bincount(row, minlength=n)
            size.append(count)
            if not len(h):
                cls += [None] * n
                sig += [None] * n
                sketch += [None] * n
                continue
            first = np.cumsum(count) - count
            some = np.flatnonzero(count)
            at = first[some]
            names = np.stack([np.add.reduceat(mix(h * np.uint64(k)), at) for k in (1, 3)], axis=1)
            tokens = np.empty((len(some), TOKENS), np.uint32)
            for i in range(TOKENS):
                x = (h ^ _SEEDS[0, i]) * (_SEEDS[1, i] | np.uint64(1))
                tokens[:, i] = (np.minimum.reduceat(x, at) >> np.uint64(32)).astype(np.uint32)
            own = {int(r): k for k, r in enumerate(some)}
            cls += [names[own[r]].tobytes() if r in own else None for r in range(n)]
            sig += [tokens[own[r]].tobytes() if r in own else None for r in range(n)]
            low = tokens.astype(np.uint8)  # a byte of every token: enough to compare classes, a quarter of the size
            sketch += [low[own[r]].tobytes() if r in own else None for r in range(n)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("key"), pa.array(np.concatenate(size) if size else np.zeros(0), pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary()),
             pa.array(sketch, pa.binary())], names=["row", "key", "size", "cls", "sig", "sketch"])


def _walk(runs: range):
    """Children of the nodes at which classes stand; without a node, of the roots of all runs."""

    def children(node: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mix(node)
        first = (h & np.uint64(TOKENS - 1)).astype(np.int64)
        step = ((h >> np.uint64(8)) % np.uint64(TOKENS - 1)).astype(np.int64) + 1
        again = ((h >> np.uint64(20)) & np.uint64(1023)) < np.uint64(round((BRANCH - 1) * 1024))
        out, who = [], []
        for coordinate, use in ((first, np.ones(len(h), bool)), ((first + step) % TOKENS, again)):
            at = np.flatnonzero(use)
            token = sig[at, coordinate[at]].astype(np.uint64)
            out.append(mix(mix(h[at] + coordinate[at].astype(np.uint64) + np.uint64(1)) ^ token))
            who.append(at)
        return np.concatenate(out), np.concatenate(who)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, TOKENS)
            if "node" in batch.schema.names:
                nodes = [np.asarray(batch.column("node")).view(np.uint64)]
            else:
                nodes = [np.full(len(batch), r + 1, np.uint64) for r in runs]
            for node in nodes:
                child, who = children(node, sig)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column("cls").take(pa.array(who))], names=["node", "cls"])

    return walk


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(axis=-1) >= ENOUGH


def _reached(sig: np.ndarray, at: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """A spanning forest of the similar pairs among the rows ``at``: every class is compared with those not reached yet.

    After ``most`` comparisons it gives back, as pairs (i, -1), the classes whose comparisons are not all done.
    """
    left, queue = at[1:], [int(x) for x in at[:1]]
    done = 0
    while len(left):
        if most is not None and done > most:
            for i in [*queue, *left]:
                yield int(i), -1
            return
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        i = queue.pop()
        hit = _near(sig[i], sig[left])
        done += len(left)
        for j in left[hit]:
            yield i, int(j)
            queue.append(int(j))
        left = left[~hit]


def _brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the similar pairs of every small node; classes that are not done, with their node."""
    for table, at in whole_groups(batches, "node"):
        cls, node = table["cls"].to_pylist(), np.asarray(table["node"])
        sig = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, TOKENS)
        a, b, rest = [], [], []
        for s, e in zip(at[:-1], at[1:]):
            for i, j in _reached(sig, np.arange(s, e), COMPARED * (e - s)):
                a.append(cls[i])
                b.append(cls[j] if j >= 0 else None)
                rest.append(None if j >= 0 else int(node[i]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(rest, pa.int64())], names=["a", "b", "node"])


def _against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In every chunk of a large node: one partner near the node's first class for each class that is far from it.

    The classes near the first are one group already, so one partner among them stands for all. Far classes are
    in every chunk, none of them counts as such a partner, and the forest of their own pairs is taken in chunk 0.
    """
    for table, at in whole_groups(batches, "node", "chunk"):
        cls, far, chunk = table["cls"].to_pylist(), np.asarray(table["far"]), np.asarray(table["chunk"])
        sig = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, TOKENS)
        a, b = [], []
        for s, e in zip(at[:-1], at[1:]):
            near, few = s + np.flatnonzero(~far[s:e]), s + np.flatnonzero(far[s:e])
            for i in few:
                hit = near[_near(sig[i], sig[near])]
                if len(hit):
                    a.append(cls[i])
                    b.append(cls[hit[0]])
            if chunk[s] == 0:
                for i, j in _reached(sig, few):
                    a.append(cls[i])
                    b.append(cls[j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


@F.arrow_udf(T.BooleanType())
def _alike(x: pa.Array, y: pa.Array) -> pa.Array:
    a, b = (np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(-1, TOKENS) for v in (x, y))
    return pa.array(_near(a, b))


def candidates(classes: DataFrame, runs: range) -> DataFrame:
    """(a, b): pairs of classes that put all candidate pairs of the walks into one group.

    In a node that fits into a task every class is compared with those not reached yet; if that takes too many comparisons,
    the classes that are not done walk on. In a larger node, classes near its smallest one are in that one's group. If
    only a few others are left, those are compared with the whole node, and it is done. Else the others walk on. A large
    node that is still mixed at the greatest depth becomes one group as a whole: the exact comparison then does what
    brute force would have done there.
    """
    spark = classes.sparkSession
    parts = num_shuffle_partitions(spark)
    edges = None
    rows = classes.select("cls", "sig").mapInArrow(tidy(_walk(runs)), "node bigint, cls binary")
    for depth in range(1, DEPTH + 1):
        counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        met = cut(rows.join(counts, "node").select("node", "cls", "n"))
        small = met.where(F.col("n") <= SMALL).select("node", "cls").join(classes.select("cls", "sketch"), "cls").repartition(parts, "node") \
            .sortWithinPartitions("node", "cls").mapInArrow(tidy(_brute), "a binary, b binary, node bigint")
        found, onward = cut(small), None
        star, deeper = _large(met.where(F.col("n") > SMALL), classes, depth == DEPTH)
        more = found.where("b IS NOT NULL").select("a", "b")
        # At the greatest depth, what is not done becomes one group.
        last = found.where("b IS NULL").withColumn("first", F.min("a").over(W.partitionBy("node"))).select(F.col("first").alias("a"), F.col("a").alias("b")) \
            if depth == DEPTH else None
        for part in (star, last):
            more = more if part is None else more.unionByName(part)
        more = more.where("a != b")
        edges = more if edges is None else edges.unionByName(more)
        if depth == DEPTH:
            break
        onward = found.where("b IS NULL").select("node", F.col("a").alias("cls"))
        if deeper is not None:
            onward = onward.unionByName(deeper)
        onward = cut(onward)
        if onward.isEmpty():
            break
        rows = onward.join(classes.select("cls", "sig"), "cls").select("node", "cls", "sig").mapInArrow(tidy(_walk(runs)), "node bigint, cls binary")
    return edges.distinct()


def _large(met: DataFrame, classes: DataFrame, last: bool) -> tuple[DataFrame | None, DataFrame | None]:
    """Pairs of nodes that are too large for a task, and (node, cls) of the classes that walk on."""
    if met.isEmpty():
        return None, None
    parts = num_shuffle_partitions(met.sparkSession)
    large = met.join(classes.select("cls", "sketch"), "cls")
    lead = large.groupBy("node").agg(F.min(F.struct("cls", "sketch")).alias("lead"))
    judged = large.join(lead, "node").select("node", "cls", "sketch", "n", F.col("lead.cls").alias("a"), _alike("sketch", "lead.sketch").alias("near"))
    if last:
        return judged.select("a", F.col("cls").alias("b")), None
    judged = cut(judged)
    star = judged.where("near").select("a", F.col("cls").alias("b"))
    left = cut(judged.where("NOT near").groupBy("node").agg(F.count(F.lit(1)).alias("others")))
    few = judged.join(left.where(F.col("others") <= FEW), "node")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    whole = few.where("near").select("node", F.pmod(F.xxhash64("cls"), chunks).cast("int").alias("chunk"), "cls", "sketch", F.lit(False).alias("far"))
    sent = few.where("NOT near").select("node", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), "cls", "sketch", F.lit(True).alias("far"))
    found = whole.unionByName(sent).repartition(parts, "node", "chunk").sortWithinPartitions("node", "chunk").mapInArrow(tidy(_against), "a binary, b binary")
    return star.unionByName(cut(found)), judged.join(left.where(F.col("others") > FEW), "node").select("node", "cls")


def _partners(sent):
    """(sampled class, class): pairs that surely have to be in one group."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, some = sent.value
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, TOKENS)
            cls = batch.column("cls")
            for name, one in zip(names, some):
                at = np.flatnonzero((sig == one).sum(axis=1) >= SURE)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.binary()), cls.take(pa.array(at))], names=["one", "cls"])

    return find


def audited(classes: DataFrame, groups: DataFrame) -> float:
    """Share of a class's partners that are in its group, in the mean over the sampled classes that have partners.

    Partners are told from sketches, with all classes compared; small groups count like large ones. 1.0 without partners.
    """
    spark = classes.sparkSession
    sample = classes.orderBy(F.xxhash64("cls", F.lit(5)), "cls").limit(AUDIT).select("cls", "sketch").collect()
    sent = spark.sparkContext.broadcast(([r["cls"] for r in sample], [np.frombuffer(r["sketch"], np.uint8) for r in sample]))
    pairs = classes.select("cls", "sketch").mapInArrow(tidy(_partners(sent)), "one binary, cls binary").where("one != cls")
    root = groups.select("node", "root")
    placed = pairs.join(root.withColumnRenamed("node", "cls"), "cls", "left") \
        .join(root.select(F.col("node").alias("one"), F.col("root").alias("own")), "one", "left")
    each = placed.groupBy("one").agg(F.avg(F.coalesce(F.col("root") == F.col("own"), F.lit(False)).cast("int")).alias("share"))
    share = each.agg(F.avg("share")).first()[0]
    return 1.0 if share is None else share


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [common.list_array(h.view(np.int64), row, n, pa.int64()) for n, row, h in _sets(batch.column("text"))]
        sets = pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("group"), batch.column("n"), batch.column("members"), sets],
                                         names=["cls", "group", "n", "members", "shingles"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact comparison of a block with itself or with another: links per class, and a forest of the links."""
    for table, at in whole_groups(batches, "group", "i", "j"):
        for s, e in zip(at[:-1], at[1:]):
            part = table.slice(s, e - s)
            cls, members = part["cls"].to_pylist(), np.asarray(part["members"])
            block, same = np.asarray(part["block"]), part["i"][0] == part["j"][0]
            sets = part["shingles"].combine_chunks()
            ends = np.asarray(sets.offsets)
            values, size = np.asarray(sets.values)[ends[0]:ends[-1]], np.diff(ends)
            owner = np.repeat(np.arange(len(cls)), size)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            new = np.ones(len(values), bool)
            new[1:] = values[1:] != values[:-1]
            number = np.cumsum(new) - 1
            many = np.bincount(number)[number] > 1
            number, owner = number[many], owner[many]
            number = np.cumsum(np.concatenate([[0], (np.diff(number) != 0).astype(np.int64)])) if len(number) else number
            shared = np.zeros((len(cls), len(cls)), np.float64)
            width = 4096
            for c in range(0, int(number[-1]) + 1 if len(number) else 0, width):
                a, b = np.searchsorted(number, [c, c + width])
                m = np.zeros((len(cls), width), np.float32)
                m[owner[a:b], number[a:b] - c] = 1
                shared += m @ m.T
            link = DEN * shared >= NUM * (size[:, None] + size[None, :] - shared)
            np.fill_diagonal(link, False)
            if not same:
                link &= block[:, None] != block[None, :]
            count = link @ members
            forest, x, y = Forest(len(cls)), [], []
            for i, j in zip(*np.nonzero(np.triu(link))):
                if forest.join(int(i), int(j)):
                    x.append(cls[i])
                    y.append(cls[j])
            some = np.flatnonzero(count)
            k = len(some)
            yield pa.RecordBatch.from_arrays([
                pa.array([cls[i] for i in some] + x, pa.binary()), pa.array([None] * k + y, pa.binary()),
                pa.array(np.concatenate([count[some], np.zeros(len(x))]).astype(np.int64))], names=["a", "b", "links"])


def grouped(classes: DataFrame, recall: float) -> DataFrame:
    """(node, root): candidate groups of more than one class. Runs go on until the audit finds the target recall."""
    edges, done, more = None, 0, runs_for(recall)
    for _ in range(TRIES):
        found = cut(candidates(classes, range(done, done + more)))
        done, more = done + more, max(1, more // 2)
        edges = found if edges is None else edges.unionByName(found)
        met = edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("node"))
        groups = cut(connected_components(met, drawn_together(edges)))
        reached = audited(classes, groups)
        if reached >= recall:
            return groups
    raise RuntimeError(f"recall of {reached:.4f} after {done} runs, {recall} was asked for")


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", recall: float = 0.99) -> DataFrame:
    """One row per row of ``docs``: key, row, n_shingles, class_id, n_links, group_id, kept.

    class_id is the smallest key with the same shingle set, n_links the number of other rows with Jaccard similarity
    of at least 0.8, group_id the smallest key reachable by links, and kept marks one row content per group: the
    smallest key, then the smallest ``row`` (a hash of key and text). Texts shorter than five words are one
    shingle. Texts without words, and nulls, link with nothing and are kept. Repeated rows link with each other
    and agree in all columns, so a caller that wants one of them drops repeated ``row`` values. Null keys come
    last in the order; a group of nulls only has a null id.
    """
    need(docs, text, key)
    spark = docs.sparkSession
    common.lean_batches(spark)
    rows = docs.select(F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("row"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    signed = cut(rows.mapInArrow(tidy(_signed), f"row bigint, key {kind}, size bigint, cls binary, sig binary, sketch binary"))
    classes = cut(signed.where("cls IS NOT NULL").groupBy("cls").agg(
        F.min("row").alias("row"), F.count(F.lit(1)).alias("members"), F.first("size").alias("size"), F.first("sig").alias("sig"),
        F.first("sketch").alias("sketch")))
    groups = grouped(classes, recall)
    sized = groups.join(classes.select("cls", "row", "members", "size"), F.col("node") == F.col("cls")).select("row", "cls", "members", "size", F.col("root").alias("group"))
    sizes = sized.groupBy("group").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("n"))
    wanted = sized.join(sizes, "group").select("row", "cls", "members", "group", "n")
    one = rows.select("row", "text").join(wanted, "row").groupBy("row", "cls", "members", "group", "n").agg(F.first("text").alias("text"))
    blocks = F.col("n")
    sets = one.select("cls", "group", "n", "members", "text").mapInArrow(tidy(_shingled), "cls binary, group binary, n int, members bigint, shingles array<bigint>") \
        .withColumn("block", F.pmod(F.xxhash64("cls"), blocks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    paired = sets.select("*", other.alias("o")).withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")})
    linked = cut(paired.select("group", "i", "j", "block", "cls", "members", "shingles")
                 .repartition(num_shuffle_partitions(spark), "group", "i", "j").sortWithinPartitions("group", "i", "j")
                 .mapInArrow(tidy(_linked), "a binary, b binary, links bigint"))
    links = linked.where("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    roots = connected_components(classes.select(F.col("cls").alias("node")), drawn_together(linked.where("b IS NOT NULL"), meet=False))
    result = classes.select("cls", "members").join(roots, F.col("cls") == F.col("node")).join(links, "cls", "left") \
        .select("cls", "root", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    placed = cut(signed.select("row", "key", "size", "cls").join(result, "cls", "left"))
    order = F.struct(F.col("key").isNull().alias("n"), F.col("key").alias("key"), F.col("row").alias("row"))
    by_class = placed.where("cls IS NOT NULL").groupBy("cls").agg(F.min(order).alias("c"))
    by_root = placed.where("cls IS NOT NULL").groupBy("root").agg(F.min(order).alias("g"))
    out = placed.join(by_class, "cls", "left").join(by_root, "root", "left")
    wordless = F.col("cls").isNull()
    return out.select(
        F.col("key").alias(key), "row", F.col("size").alias("n_shingles"),
        F.when(wordless, F.col("key")).otherwise(F.col("c.key")).alias("class_id"),
        F.when(wordless, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        F.when(wordless, F.col("key")).otherwise(F.col("g.key")).alias("group_id"),
        (wordless | (F.col("row") == F.col("g.row"))).alias("kept"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", recall: float = 0.99) -> DataFrame:
    """``docs`` with one row for each group of near copies; rows without words all stay.

    Rows equal in key and text count as copies too: the ones that repeat pass through a grouping on their hash.
    """
    row = common.own_name(docs, "_row")
    found = cut(join(docs, text, key, recall).groupBy("row").agg(
        F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"), F.max("n_shingles").alias("shingles")))
    # What goes, and what repeats, is the smaller part: the texts are held against that, not against all that stays.
    again = (F.col("n") > 1) & (F.col("shingles") > 0)
    apart = cut(found.where(~F.col("kept") | again).select(F.col("row").alias(row), "kept"))
    marked = docs.withColumn(row, F.xxhash64(F.col(key).cast("string"), F.col(text)))
    once = marked.join(apart.select(row), row, "left_anti")
    one_of = marked.join(apart.where("kept").select(row), row, "left_semi").dropDuplicates([row])
    return once.unionByName(one_of).select(*docs.columns)
