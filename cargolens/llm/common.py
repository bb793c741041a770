"""Helpers shared by the text operators: whole-column word hashing, row checks, ids, splits.

Texts are handled in blocks of about a megabyte with numpy over the UTF-8 bytes of an Arrow column;
no text is cut, a text larger than a block is a block of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
KEEP_CASE = np.arange(256, dtype=np.uint8)
FOLD_CASE = KEEP_CASE.copy()
FOLD_CASE[65:91] += 32


def need(df: DataFrame, *columns: str) -> None:
    """Fail early, naming what is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}; there are {df.columns}")


def lean_batches(spark: SparkSession) -> None:
    """Send rows to Python in batches of some megabytes: texts can be long, and every batch is held several times over.

    A smaller setting of the session stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def give_back() -> None:
    """Freed memory goes back to the system: a worker process lives on, idle or not, beside those of later steps."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(task: Callable) -> Callable:
    """A batch function whose worker gives freed memory back at the end of a task."""
    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def own_name(df: DataFrame, wanted: str) -> str:
    """A helper column name that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def id_mod(column: str, parts: int) -> Column:
    """crc32 of an id written as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def word_count(column: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash multiplier and of its inverse, for positions below ``n``."""
    size = BLOCK_BYTES
    while size < n:
        size *= 2
    if size not in _powers:
        out = []
        for base in (_P, _P_INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if size == BLOCK_BYTES:
            _powers[size] = (out[0], out[1])  # kept; the rarer larger ones are made again
        else:
            return out[0], out[1]
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_column(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column with nulls as empty texts and 64-bit offsets, in one piece."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them) for runs of rows."""
    if len(column) == 0:
        return
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        upto = int(np.searchsorted(ends, ends[row] + limit, "right")) - 1
        upto = min(max(upto, row + 1), len(column))
        yield row, upto, raw[ends[row]:ends[upto]], ends[row:upto + 1] - ends[row]
        row = upto


def word_spans(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word of a block; words never cross rows. ``outside`` marks the bytes between words."""
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(outside[data], out=inside[:-1])
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    borders = offsets[(offsets < len(data)) & (offsets >= 0)]
    first[borders] = inside[borders]
    last = inside[:-1] & ~inside[1:]
    borders = offsets[offsets > 0] - 1
    last[borders] = inside[borders]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash per word; ``fold`` lower-cases A-Z first."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    table = (FOLD_CASE if fold else KEEP_CASE).astype(np.uint64) + np.uint64(1)
    np.cumsum(table[data] * power[:len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h + mix((ends - starts).astype(np.uint64)))


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of runs of ``size`` words per row, sorted by (row, hash): (rows, hashes).

    A row with fewer words, but at least one, has a single run of all its words.
    """
    count = np.bincount(rows, minlength=n_rows)
    run = np.zeros(len(words), np.uint64)
    left = np.cumsum(count)[rows] - np.arange(len(words)) if len(words) else np.zeros(0, np.int64)
    for k in range(size):
        part = mix(words[k:] + np.uint64((k + 1) * _P % (1 << 64)))
        ok = left[:len(part)] > k
        run[:len(part)] += np.where(ok, part * np.uint64(2 * k + 3), np.uint64(0))
    first = np.cumsum(count) - count
    position = np.arange(len(words)) - first[rows]
    use = (left >= size) | ((count[rows] < size) & (position == 0))
    h, r = mix(run[use]), rows[use]
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    if len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        h, r = h[keep], r[keep]
    return r, h


def runs(texts: list[str], chars: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts with about ``chars`` characters; a longer text is a run of its own."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > chars:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def list_array(values: np.ndarray, rows: np.ndarray, n_rows: int, kind: pa.DataType) -> pa.Array:
    """A list column from values sorted by row."""
    ends = np.zeros(n_rows + 1, np.int32)
    np.cumsum(np.bincount(rows, minlength=n_rows), out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of spans as a binary column."""
    size = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], size)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])


def whole_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by ``keys``: tables that hold whole groups, with the groups' first rows and the end."""
    held: list[pa.RecordBatch] = []

    def change(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        for k in keys:
            column = table[k].combine_chunks()
            new[1:] |= np.asarray(pc.not_equal(column[1:], column[:-1]).cast(pa.uint8())).astype(bool)
        return np.flatnonzero(new)

    def same(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
        return all(a.column(k)[len(a) - 1] == b.column(k)[0] for k in keys)

    for batch in batches:
        if not len(batch):
            continue
        if held and not same(held[-1], batch):
            table = pa.Table.from_batches(held)
            yield table, np.concatenate([[0], change(table), [table.num_rows]])
            held = []
        cut = change(pa.Table.from_batches([batch]))
        if len(cut):
            table = pa.Table.from_batches([*held, batch.slice(0, int(cut[-1]))])
            yield table, np.concatenate([[0], change(table), [table.num_rows]])
            held = [batch.slice(int(cut[-1]))]
        else:
            held.append(batch)
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.concatenate([[0], change(table), [table.num_rows]])


class Forest:
    """Union-find over 0 .. n-1; ``join`` tells whether two trees became one."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


#: Links that a task holds at once while it draws them together.
LINKS_HELD = 1 << 20


def _drawn_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def stars() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        ends = pa.chunked_array([*table["a"].chunks, *table["b"].chunks]).combine_chunks()
        names = ends.dictionary_encode()
        place = pc.rank(names.dictionary, sort_keys="ascending", tiebreaker="first")  # roots are the smallest names
        order = np.asarray(place).astype(np.int64) - 1
        number = order[np.asarray(names.indices)]
        by_order = np.argsort(order)
        forest = Forest(len(order))
        n = table.num_rows
        for i, j in zip(number[:n].tolist(), number[n:].tolist()):
            forest.join(i, j)
        root = np.array([forest.root(i) for i in range(len(order))], np.int64)
        some = np.flatnonzero(root != np.arange(len(order)))
        take = lambda at: names.dictionary.take(pa.array(by_order[at]))
        return pa.RecordBatch.from_arrays([take(root[some]), take(some)], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(len(b) for b in held) > LINKS_HELD:
            yield stars()
            held = []
    if held:
        yield stars()


def drawn_together(links: DataFrame, meet: bool = True) -> DataFrame:
    """(a, b): links with the same components as those of ``links``, in which every task has tied its own into stars.

    With ``meet``, stars that share a node are tied again. Components over them need fewer rounds. The smallest node of a star is its ``a``.
    """
    kind = dict(links.dtypes)
    kind = f"a {kind['a']}, b {kind['b']}"
    stars = links.select("a", "b").mapInArrow(_drawn_together, kind)
    return stars.repartition("b").mapInArrow(_drawn_together, kind) if meet else stars
