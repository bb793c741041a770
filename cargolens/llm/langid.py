"""Language identification with language-bitmask filters of character n-grams.

Every language has a Bloom filter of the n-grams that are common in it. The filters lie bit-sliced: one
table position holds a mask with a bit per language, so the AND over an n-gram's positions returns all
languages that contain it. A text's counts per language are corrected by each filter's measured
false-positive rate, and the language with the largest corrected count wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.llm.common import id_mod, lean_batches, mix, need, runs, tidy
from cargolens.session import cut

SIZE = 3
HASHES = 4
# An n-gram belongs to a language if it makes up this share of the language's n-grams, so a language has
# at most 1/MIN_RATE of them: a bound of the filter's size that does not depend on the input.
MIN_RATE = 1e-5
# ... and if it is at least this part as common as in the language that uses it most.
MIN_PART = 0.2
BITS_PER_GRAM = 12
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """For every code point its lower-case form if it is a letter, else 0."""
    if not _letters:
        table = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _letters.append(table)
    return _letters[0]


def grams(texts: list[str], size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash) of every n-gram without an inner gap, and whether each text has a letter.

    Letters are lower-cased; whatever stands between words counts as one gap, also at both ends.
    """
    padded = "".join([f" {t} " for t in texts])
    code = letter_table()[np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
    sizes = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
    text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    keep = code != 0
    lettered = np.bincount(text[keep], minlength=len(texts)) > 0
    keep[1:] |= code[:-1] != 0
    keep[np.cumsum(sizes) - sizes] = True
    code, text = code[keep], text[keep]
    n = len(code) - size + 1
    if n <= 0:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64), lettered
    h, ok = np.zeros(n, np.uint64), text[:n] == text[size - 1:]
    for k in range(size):
        part = code[k:k + n]
        h = h * np.uint64(0x110000 + 7) + part
        if 0 < k < size - 1:
            ok &= part != 0
    return text[:n][ok], mix(h[ok]), lettered


@dataclass
class Filters:
    """languages; table[plane, position]: masks of up to 64 languages; false: rate per language."""

    languages: list[str]
    table: np.ndarray
    false: np.ndarray

    def masks(self, h: np.ndarray) -> list[np.ndarray]:
        size = np.uint64(self.table.shape[1] - 1)
        step = (h >> np.uint64(32)) | np.uint64(1)
        out = [self.table[p][h & size] for p in range(self.table.shape[0])]
        for k in range(1, HASHES):
            at = (h + np.uint64(k) * step) & size
            for p in range(len(out)):
                out[p] &= self.table[p][at]
        return out

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(corrected counts per text and language, n-grams per text, has a letter)."""
        text, h, lettered = grams(texts)
        total = np.bincount(text, minlength=len(texts)).astype(np.float64)
        hits = np.zeros((len(texts), len(self.languages)))
        for p, mask in enumerate(self.masks(h)):
            for b in range(min(64, len(self.languages) - 64 * p)):
                hit = (mask >> mask.dtype.type(b)) & mask.dtype.type(1)
                hits[:, 64 * p + b] = np.bincount(text, hit, minlength=len(texts))
        return np.maximum(0, (hits - total[:, None] * self.false) / (1 - self.false)), total, lettered


def build(languages: list[str], grams_of: list[np.ndarray]) -> Filters:
    """Filters from the n-gram hashes of each language; positions for about 12 bits an n-gram."""
    most = max([1, *map(len, grams_of)])
    size = 1 << max(12, int(np.ceil(np.log2(most * BITS_PER_GRAM))))
    kind = next(t for n, t in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (1 << 40, np.uint64)) if len(languages) <= n)
    table = np.zeros((max(1, -(-len(languages) // 64)), size), kind)
    fill = np.zeros(len(languages))
    for i, h in enumerate(grams_of):
        step = (h >> np.uint64(32)) | np.uint64(1)
        used = np.zeros(size, bool)
        for k in range(HASHES):
            used[(h + np.uint64(k) * step) & np.uint64(size - 1)] = True
        table[i // 64][used] |= kind(1 << (i % 64))
        fill[i] = used.mean()
    return Filters(languages, table, fill ** HASHES)


def _counted():
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def fold(parts):
            h, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            u, at = np.unique(h, return_inverse=True)
            return u, np.bincount(at, n, minlength=len(u)).astype(np.int64)

        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by: dict[str, list[str]] = {}
            for t, name in zip(texts, langs):
                by.setdefault(name, []).append(t)
            for name, own in by.items():
                for a, b in runs(own):
                    _, h, _ = grams(own[a:b])
                    u, n = np.unique(h, return_counts=True)
                    held.setdefault(name, []).append((u, n))
                    if len(held[name]) > 16:
                        held[name] = [fold(held[name])]
        for name, parts in held.items():
            u, n = fold(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(u)), pa.array(u.view(np.int64)), pa.array(n)],
                                             names=["lang", "gram", "n"])

    return count


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Filters:
    """Filters from every labelled row. Rows without text or label teach nothing; without rows there are no languages."""
    need(docs, text, lang)
    lean_batches(docs.sparkSession)
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counted = rows.mapInArrow(tidy(_counted()), "lang string, gram bigint, n bigint") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = cut(counted)
    # A gram's languages meet in one row; the totals come along as a second aggregate over the same counts.
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counted.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total")).where(F.col("rate") >= MIN_RATE)
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"), F.collect_list(F.struct("lang", "rate")).alias("of"))
    kept = best.select("gram", F.transform(F.filter("of", lambda x: x["rate"] >= MIN_PART * F.col("best")), lambda x: x["lang"]).alias("langs"))
    found = kept.toArrow()  # at most 1/MIN_RATE n-grams per language
    gram = found["gram"].combine_chunks()
    flat = found["langs"].combine_chunks()
    names = sorted(set(flat.flatten().to_pylist()))
    h = np.asarray(gram).view(np.uint64)[np.asarray(flat.value_parent_indices())] if len(gram) else np.zeros(0, np.uint64)
    who = np.asarray(flat.flatten().to_pylist(), dtype=object)
    return build(names, [np.sort(h[who == x]) for x in names])


RESULT = "lang string, score double, share double"


def predict_column(spark: SparkSession, filters: Filters):
    """A column function text -> struct(lang, score, share).

    score: the winner's part of all languages' corrected counts; share: the part of the text's n-grams
    that the winner knows. ``und`` with 0 if the text is null or has no letter. Ties go to the first language by name;
    a lettered text that no language knows gets the first language with score 0.
    """
    sent = spark.sparkContext.broadcast(filters)
    lean_batches(spark)

    @F.arrow_udf(RESULT)
    def predict(column: pa.Array) -> pa.Array:
        f = sent.value
        texts = [t or "" for t in column.to_pylist()]
        names, score, share = [], [], []
        for a, b in runs(texts):
            if not f.languages:
                names += [UNKNOWN] * (b - a)
                score += [0.0] * (b - a)
                share += [0.0] * (b - a)
                continue
            counts, total, lettered = f.counts(texts[a:b])
            best = counts.argmax(axis=1)
            top, everything = counts.max(axis=1), counts.sum(axis=1)
            names += [f.languages[i] if ok else UNKNOWN for i, ok in zip(best, lettered)]
            score += np.where(lettered, top / np.maximum(everything, 1e-300), 0).tolist()
            share += np.where(lettered, np.minimum(1, top / np.maximum(total, 1)), 0).tolist()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(share, pa.float64())],
                                          names=["lang", "score", "share"])

    # Taken as not deterministic: else a filter on the result is moved below it, where every text is read a second time.
    return predict.asNondeterministic()


def identify(docs: DataFrame, filters: Filters, text: str = "text", prefix: str = "lang_") -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_share; an input column of such a name is replaced."""
    need(docs, text)
    out = docs.withColumn(f"{prefix}found", predict_column(docs.sparkSession, filters)(F.col(text).cast("string")))
    out = out.withColumns({f"{prefix}pred": F.col(f"{prefix}found.lang"), f"{prefix}score": F.col(f"{prefix}found.score"),
                           f"{prefix}share": F.col(f"{prefix}found.share")})
    return out.drop(f"{prefix}found")


def held_out(key: str = "doc_id", parts: int = 5):
    return id_mod(key, parts) == 0
