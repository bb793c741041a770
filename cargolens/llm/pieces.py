"""SentencePiece encoding and decoding of merge-type vocabularies.

Adjacent symbol pairs stand in an agenda ordered by the score of their merged piece, then from left to
right; the best pair is merged and its new neighbours enter. Symbols that are no piece fall back to bytes.
Texts are cut only where no piece could reach across, so the merges of a cut-out chunk are those of the
whole text. A part of every Arrow batch is encoded by the sentencepiece library too and must agree.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from cargolens.llm.common import lean_batches, need, own_name, runs, tidy

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Words whose ids a worker keeps: up to twice so many, as an older and a younger half.
CACHED, LONGEST = 32_768, 64
#: Words up to this length are merged together, so many at once.
SHORT, TOGETHER = 30, 4096
#: Characters of the texts whose words are looked up together.
RUN = 1 << 18
_NEVER = float("inf")
#: Of this many texts of a batch, one is encoded by the library as well.
CHECK_EVERY = 16
_NORMAL, _UNKNOWN, _USER, _UNUSED, _BYTE = 1, 2, 4, 5, 6
_loaded: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts under a model that merges pairs, leaves spaces as they are and falls back to bytes."""

    def __init__(self, proto: bytes):
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(proto)
        rule, how = model.normalizer_spec, model.trainer_spec
        kinds = {p.type for p in model.pieces}
        if how.model_type != how.BPE or rule.name != "identity" or rule.remove_extra_whitespaces or not rule.escape_whitespaces \
                or how.treat_whitespace_as_suffix or not how.byte_fallback or _USER in kinds or _UNUSED in kinds:
            raise ValueError("only merge-type models with identity normalisation, byte fallback and plain pieces are read")
        self.prefix = SPACE if rule.add_dummy_prefix else ""
        ordered = {p.piece: -p.score for p in model.pieces if p.type == _NORMAL}
        self.order = ordered.get
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        merged = [p for p in ordered if len(p) > 1]
        if any(SPACE in p.lstrip(SPACE) for p in merged):
            raise ValueError("a piece has a space inside, so words can't be merged one by one")
        joined = "".join(re.escape(c) for c in sorted({c for p in merged for c in p} - {SPACE}))
        # Spaces with the word after them; spaces alone; a character that no merge touches.
        self.chunks = re.compile(f"{SPACE}*[{joined}]+|{SPACE}+|[^{joined}{SPACE}]", re.S).findall
        self.known: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # Symbols as numbers: the id of a piece, or for another character the number of pieces plus its code point.
        self.pieces = len(model.pieces)
        self.pad = self.pieces + 0x110000
        self.shift = self.pad + 1
        self.kind = np.uint16 if self.pieces <= 1 << 16 else np.uint32
        self.text = [str(i) for i in range(self.pieces)]
        self.single = np.arange(self.pieces, self.pad, dtype=np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.single[ord(piece)] = i
        number = lambda p: self.ids.get(p, self.single[ord(p)] if len(p) == 1 else None)
        pairs = [(int(a) * self.shift + int(b), -score, self.ids[p]) for p in merged for score in [-ordered[p]]
                 for k in range(1, len(p)) if (a := number(p[:k])) is not None and (b := number(p[k:])) is not None]
        pairs.sort()
        self.pair_keys = np.array([x[0] for x in pairs] + [1 << 62], np.int64)
        self.pair_order = np.array([x[1] for x in pairs] + [_NEVER], np.float32)
        self.pair_piece = np.array([x[2] for x in pairs] + [0], np.int32)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)

    def merge(self, chunk: str) -> list[str]:
        """Pieces of a chunk by the agenda of adjacent pairs, kept as a heap.

        Pairs of which a symbol has been merged since are passed over."""
        order, symbol = self.order, list(chunk)
        n = len(symbol)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []

        def enter(a: int, b: int) -> None:
            got = order(symbol[a] + symbol[b])
            if got is not None:
                heapq.heappush(agenda, (got, a, b, len(symbol[a]) + len(symbol[b])))

        for i in range(n - 1):
            enter(i, i + 1)
        while agenda:
            _, a, b, size = heapq.heappop(agenda)
            if not symbol[a] or not symbol[b] or len(symbol[a]) + len(symbol[b]) != size:
                continue
            symbol[a] += symbol[b]
            symbol[b] = ""
            after[a] = c = after[b]
            if c < n:
                before[c] = a
                enter(a, c)
            if before[a] >= 0:
                enter(before[a], a)
        return [s for s in symbol if s]

    def chunk_ids(self, chunk: str) -> bytes:
        out: list[int] = []
        for piece in self.merge(chunk):
            if piece in self.ids:
                out.append(self.ids[piece])
            else:
                out += [self.bytes[b] for b in piece.encode("utf-8")]
        found = np.array(out, self.kind).tobytes()
        if len(chunk) <= LONGEST:
            if len(self.known) >= CACHED // 8:
                self.known.clear()
            self.known[chunk] = found
        return found

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair of symbols in the pair tables; the last place if nothing merges them."""
        wanted = left.astype(np.int64) * self.shift + right
        at = np.searchsorted(self.pair_keys, wanted)
        return np.where(self.pair_keys[at] == wanted, at, len(self.pair_keys) - 1).astype(np.int32)

    def merge_together(self, words: list[str]) -> list[bytes]:
        """Ids of many words, each with a space before it: their agendas are the rows of one matrix.

        In a step every word merges its best pair, the leftmost of equals, and looks up the two new pairs.
        """
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        width = int(size.max())
        code = np.frombuffer((SPACE + SPACE.join(words)).encode("utf-32-le"), np.uint32)
        symbol = np.full((len(words), width + 1), self.pad, np.int32)
        symbol[:, :width][np.arange(width) < size[:, None]] = self.single[code]
        place = self._pairs(symbol[:, :-1], symbol[:, 1:])
        last = len(self.pair_keys) - 1
        live = np.arange(len(words))
        done = np.empty((len(words), width), np.int32)
        column = np.arange(width)
        while len(live):
            order = self.pair_order[place]
            at = order.argmin(axis=1)
            more = order[np.arange(len(live)), at] < _NEVER
            row = np.flatnonzero(more)
            if len(row) <= 0.6 * len(live):
                done[live[~more]] = symbol[~more, :width]
                live, symbol, place = live[row], symbol[row], place[row]
                continue
            behind = column > np.where(more, at, width)[:, None]
            at = at[row]
            merged = self.pair_piece[place[row, at]]
            symbol[:, :width] = np.where(behind, symbol[:, 1:], symbol[:, :width])
            symbol[:, width] = self.pad
            symbol[row, at] = merged
            place[:, :-1] = np.where(behind[:, :-1], place[:, 1:], place[:, :-1])
            place[row, -1] = last
            place[row, at] = self._pairs(merged, symbol[row, at + 1])
            some = at > 0
            place[row[some], at[some] - 1] = self._pairs(symbol[row[some], at[some] - 1], merged[some])
        kept = done != self.pad
        ends = np.cumsum(kept.sum(axis=1))
        flat = done[kept]
        data, wide = flat.astype(self.kind).tobytes(), np.dtype(self.kind).itemsize
        stops = (ends * wide).tolist()
        out = [data[a:b] for a, b in zip([0, *stops], stops)]
        for i in np.flatnonzero((done >= self.pieces).any(axis=1, where=kept)):
            ids = (x for x in done[i][kept[i]].tolist())
            flat_ids = [y for x in ids for y in ([x] if x < self.pieces else [self.bytes[b] for b in chr(x - self.pieces).encode("utf-8")])]
            out[i] = np.array(flat_ids, self.kind).tobytes()
        return out

    def prepare(self, words: set[str]) -> dict[str, bytes]:
        """Ids of all ``words``: known ones, and the others merged in groups of like length."""
        old, young = self.old, self.young
        found, new = {}, []
        for w in words:
            hit = young.get(w)
            if hit is None:
                hit = old.get(w)
                if hit is None:
                    new.append(w)
                    continue
                young[w] = hit
            found[w] = hit
        new.sort(key=len)
        start = 0
        while start < len(new):
            if len(new[start]) > SHORT:
                for w in new[start:]:
                    found[w] = b"".join([self.chunk_ids(c) for c in self.chunks(SPACE + w)])
                break
            end = start
            while end < len(new) and end < start + TOGETHER and len(new[end]) <= min(SHORT, len(new[start]) + 2):
                end += 1
            group = new[start:end]
            made = dict(zip(group, self.merge_together(group)))
            found.update(made)
            young.update(made)
            start = end
        if len(young) > CACHED:
            self.old, self.young = young, {}
        return found

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of every text; words of all of them are merged together."""
        simple = [bool(self.prefix) and bool(t) and t[0] != " " and "  " not in t and SPACE not in t for t in texts]
        words = set()
        for t, ok in zip(texts, simple):
            if ok:
                words.update(t.split(" "))
        known, plain, make = self.prepare(words), self.known, self.chunk_ids
        for t, ok in zip(texts, simple):
            if ok:
                found = [known[w] for w in t.split(" ")]
            else:
                found = [plain.get(c) or make(c) for c in self.chunks(self.prefix + t.replace(" ", SPACE))] if t else []
            yield np.frombuffer(b"".join(found), self.kind).tolist()


def encoder(proto: bytes) -> Encoder:
    """One encoder per model and worker process."""
    name = hashlib.sha256(proto).hexdigest()
    if name not in _loaded:
        _loaded[name] = Encoder(proto)
    return _loaded[name]


def encode(docs: DataFrame, path: str | None = None, text: str = "text", check_every: int = CHECK_EVERY, lists: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256 (and ids, decoded if ``lists``).

    The whole text is encoded without begin or end ids and decoded by the library. Null and empty texts
    have no ids and decode to the empty text. A row on which the library disagrees ends the job. Input
    columns of the new names are replaced. ``path`` names the model file, read on the driver and sent to
    the executors. Rows are handled one by one, so repeated rows agree and an empty table stays empty.
    """
    need(docs, text)
    lean_batches(docs.sparkSession)
    with open(path or public_tokenizers.path(MODEL), "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file
    made = own_name(docs, "_made")
    kind = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if lists else "")

    @F.arrow_udf(kind)
    @tidy
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(sent.value)
        for batch in batches:
            count, digest, back, all_ids, texts = [], [], [], [], []
            values = [t or "" for t in batch.to_pylist()]
            coded = chain.from_iterable(e.encode_all(values[a:b]) for a, b in runs(values, RUN))
            text_of = e.text
            for i, (t, ids) in enumerate(zip(values, coded)):
                if check_every and i % check_every == 0 and e.library.encode(t) != ids:
                    raise ValueError(f"the library encodes this text in another way: {t[:200]!r}")
                decoded = e.library.decode(ids) if ids else ""
                count.append(len(ids))
                digest.append(hashlib.sha256(",".join([text_of[x] for x in ids]).encode()).hexdigest())
                back.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                if lists:
                    all_ids.append(ids)
                    texts.append(decoded)
            out = [pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            if lists:
                out += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.StructArray.from_arrays(out, names=names)

    columns = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * lists
    out = docs.withColumn(made, apply(F.col(text).cast("string")))
    return out.withColumns({c: F.col(f"{made}.{c}") for c in columns}).drop(made)
