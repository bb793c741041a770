"""Near copies, near vectors, archives, the mix and the pipeline against brute force."""

import gzip
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cargolens.llm import jaccard_join, langid, mixing, near_vectors, pii, warc

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORDS.findall(text or "")
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_join(rows):
    """(links, smallest key reachable) per row number."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = Counter()
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    group = {}
    for i, (k, _) in enumerate(rows):
        group.setdefault(root(i), []).append(k)
    low = {r: min((k is None, k) for k in ks)[1] for r, ks in group.items()}
    return [(k, links[i], low[root(i)]) for i, (k, _) in enumerate(rows)]


def copies(n, group, seed=1):
    """Texts of which every ``group`` are near copies, next to unlike ones with a shared passage."""
    draw = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(n):
        if i % group == 0:
            base = [f"w{draw.randrange(5000)}" for _ in range(120)]
        own = list(base)
        for _ in range(draw.randrange(4)):
            own[draw.randrange(len(own))] = f"x{draw.randrange(5000)}"
        rows.append((i, " ".join(own) + (" " + passage if i % 3 == 0 else "")))
    return rows


def same_join(frame, rows, **how):
    found = jaccard_join.join(frame(rows, "doc_id long, text string"), **how).collect()
    got = Counter((r.doc_id, r.n_links, r.group_id) for r in found)
    assert got == Counter(brute_join(rows))
    return found


@pytest.mark.parametrize("group", [2, 7, 300])
def test_join_equals_brute_force(frame, group):
    same_join(frame, copies(600, group), recall=0.999)


def test_join_of_large_mixed_nodes(frame, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 8)
    monkeypatch.setattr(jaccard_join, "FEW", 4)
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    same_join(frame, copies(400, 90), recall=0.999)
    monkeypatch.setattr(jaccard_join, "DEPTH", 1)
    same_join(frame, copies(200, 50), recall=0.999)


@pytest.mark.parametrize("compared", [0, 3])
def test_nodes_that_take_too_many_comparisons_walk_on(frame, monkeypatch, compared):
    monkeypatch.setattr(jaccard_join, "COMPARED", compared)
    same_join(frame, copies(300, 40), recall=0.999)


def test_runs_go_on_until_the_audit_is_met(spark, frame, monkeypatch):
    rows = frame(copies(300, 6), "doc_id long, text string")
    seen = []
    plain = jaccard_join.candidates
    monkeypatch.setattr(jaccard_join, "candidates", lambda classes, runs: seen.append(runs) or plain(classes, runs).limit(0 if len(seen) < 3 else 10**9))
    found = jaccard_join.join(rows)
    assert found.where("n_links > 0").count() > 0 and len(seen) >= 3
    assert seen[0].stop == seen[1].start and seen[1].stop == seen[2].start
    monkeypatch.setattr(jaccard_join, "candidates", lambda classes, runs: plain(classes, runs).limit(0))
    with pytest.raises(RuntimeError, match="recall"):
        jaccard_join.join(rows)


@pytest.mark.parametrize("held", [1 << 20, 7])
def test_links_drawn_together_keep_their_components(frame, monkeypatch, held):
    from cargolens.llm import common
    from cargolens.operators.density import connected_components

    draw = np.random.default_rng(2)
    links = [(b"%03d" % a, b"%03d" % b) for a, b in draw.integers(0, 120, (90, 2))]
    monkeypatch.setattr(common, "LINKS_HELD", held)
    batches = pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], names=["a", "b"])
    drawn = [(r["a"], r["b"]) for out in common._drawn_together(batches.slice(i, 10) for i in range(0, 90, 10)) for r in out.to_pylist()]
    assert all(a < b for a, b in drawn) and len(drawn) <= len(links)
    nodes = frame([(x,) for x in sorted({x for p in links for x in p})], "node binary")
    roots = [{bytes(r["node"]): bytes(r["root"]) for r in connected_components(nodes, frame(x, "a binary, b binary")).collect()} for x in (links, drawn)]
    assert roots[0] == roots[1]


def test_far_classes_meet_the_group_of_the_lead(spark, monkeypatch):
    """One node of 20 classes near its first and 12 far ones, of which the last is also near one class of the first's group."""
    def sig(shared, tail):
        return np.array([7] * shared + [tail] * (jaccard_join.TOKENS - shared), np.uint32).tobytes()

    def one_node(runs):
        def walk(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([1] * len(batch), pa.int64()), batch.column("cls")], names=["node", "cls"])
        return walk

    monkeypatch.setattr(jaccard_join, "SMALL", 8)
    monkeypatch.setattr(jaccard_join, "_walk", one_node)
    near = [(b"a%02d" % i, sig(64, 0)) for i in range(19)] + [(b"z99", sig(44, 9))]  # the last one holds 20 tokens of the far ones
    far = [(b"b%02d" % i, sig(10, 9)) for i in range(11)] + [(b"b99", sig(30, 9))]
    assert sum(x == y for x, y in zip(np.frombuffer(sig(44, 9), np.uint32), np.frombuffer(sig(30, 9), np.uint32))) == 50
    edges = [(bytes(r.a), bytes(r.b)) for r in jaccard_join.candidates(spark.createDataFrame(
        [(c, s, np.frombuffer(s, np.uint32).astype(np.uint8).tobytes()) for c, s in far + near], "cls binary, sig binary, sketch binary").coalesce(1), range(1)).collect()]
    group = {k: k for k, _ in near + far}
    for _ in range(len(group)):
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    assert set(group.values()) == {b"a00"}


def test_join_of_odd_rows(odd, nothing, frame):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = same_join(frame, rows)
    assert sum(r.kept for r in found if r.n_shingles == 0) == 3
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "7"]
    assert jaccard_join.join(nothing).count() == 0 and jaccard_join.keep_one(nothing).count() == 0


def near_rows(seed=3):
    draw = np.random.default_rng(seed)
    rows, k = [], 0
    for size in (1, 1, 2, 5, 30, 200):
        for _ in range(8 if size < 30 else 1):
            base = draw.normal(size=16)
            for _ in range(size):
                rows.append((k, [float(x) for x in base + draw.normal(size=16) * 0.12]))
                k += 1
    same = [float(x) for x in draw.normal(size=16)]
    return rows + [(k + i, same) for i in range(50)] + [(k + 50, [2 * x for x in same])]


def brute_vectors(rows):
    good = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, up = Counter(), list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in good}
    for a in good:
        for b in good:
            if b < a and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9:
                links[a] += 1
                links[b] += 1
                up[max(root(a), root(b))] = min(root(a), root(b))
    return [(k, links[i], rows[root(i)][0]) for i, (k, _) in enumerate(rows)]


def test_vectors_equal_brute_force(frame, monkeypatch):
    monkeypatch.setattr(near_vectors, "BLOCK", 64)
    rows = near_rows()
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [None] + [1.0] * 15), (1004, [float("nan")] * 16), (1005, [float("inf")] * 16),
           (1006, [1.0, 2.0]), (1007, [1.0, 2.0]), (1008, [1e300, 2e300])]
    found = near_vectors.link(frame(rows + odd, "vec_id long, embedding array<double>").withColumn("node", F.lit(1))).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == sorted(brute_vectors(rows + odd[:-1])[:len(rows) + 6]
                                                                               + [(1006, 2, 1006), (1007, 2, 1006), (1008, 2, 1006)])
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_pairs_beside_a_hot_group_are_found(frame, monkeypatch):
    """Weighted by pairs, a hot group meets any recall; the pairs beside it are missed by a single table of one round."""
    monkeypatch.setattr(near_vectors, "TABLES", 1)
    monkeypatch.setattr(near_vectors, "ROUNDS", 1)
    monkeypatch.setattr(near_vectors, "TRIES", 1)
    monkeypatch.setattr(near_vectors, "SENT", 300)
    draw = np.random.default_rng(11)
    hot, rows = draw.normal(size=16), []
    rows += [hot + draw.normal(size=16) * 0.01 for _ in range(300)]
    for _ in range(200):
        base = draw.normal(size=16)
        rows += [base + draw.normal(size=16) * 0.2 for _ in range(2)]
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(rows)]
    found = near_vectors.link(frame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == sorted(brute_vectors(rows))


def test_vectors_of_odd_tables(frame):
    schema = "vec_id long, embedding array<float>"
    assert near_vectors.link(frame([], schema)).count() == 0
    twice = near_vectors.link(frame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (None, None)], schema)).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in twice if r.n_links) == [("1", 2, 1), ("1", 2, 1), ("None", 2, 1)]


PAGES = [(1, "http://a/", "<p>one"), (2, "http://b/", "<p>one"), (3, None, ""), (4, "http://c/", None), (None, "http://d/", "<p>one"), (5, "http://e/\r\nX: 1", "é" * 70000),
         (6, "u", "\x1f\x8b\x08 WARC/1.1"), (2, "http://b/", "<p>one"), (-7, "n", "<p>\r\n\r\nWARC/1.1\r\n\r\n")]


@pytest.mark.parametrize("range_bytes", [37, 1000, 8 << 20])
def test_archives_come_back(spark, frame, range_bytes):
    pages = frame(PAGES, "page_id long, url string, html string").withColumn("sum", F.lit(1))
    files = warc.write(pages, warc.archive_folder(spark), file_bytes=300)
    got = warc.read(files, range_bytes).collect()
    assert len(got) == len(PAGES)
    last = {}
    for k, _, h in PAGES:
        if k is not None:
            last[h or ""] = max(last.get(h or "", k), k)
    want = Counter()
    for k, _, h in PAGES:
        data = (h or "").encode()
        to = None if k is None or k == last[h or ""] else last[h or ""]
        want[k, "response" if to is None else "revisit", len(data), warc.digest(data), to, data if to is None else None] += 1
    assert Counter((r.page, r.kind, r.payload_bytes, r.payload_digest, r.refers_to, bytes(r.payload) if r.payload is not None else None) for r in got) == want
    assert sum(gzip.open(r.path.removeprefix("file://")).read().count(b"WARC-Record-ID") for r in files.collect()) == len(PAGES)


def test_magic_inside_a_member_is_no_record(tmp_path):
    noise = bytes(random.Random(1).randrange(256) for _ in range(4000))
    inner = gzip.compress(b"WARX not a record", mtime=0)
    members = [warc.member(i, "u", noise, None) for i in range(5)]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(b"".join([members[0], inner[:10], b"\x1f\x8b\x08", *members[1:]]))
    size, step = path.stat().st_size, 501
    seen = [c for b in range(0, size, step) for c in warc.records(f"file://{path}", b, b + step)]
    assert [re.search(rb"Page-ID: (\d)", c)[1] for c in seen] == [b"0", b"1", b"2", b"3", b"4"]
    path.write_bytes(members[0][:-20])
    with pytest.raises(EOFError):
        list(warc.records(f"file://{path}", 0, size))


def test_no_archives(spark, frame):
    pages = frame([], "page_id long, url string, html string")
    assert warc.read(warc.write(pages, warc.archive_folder(spark))).count() == 0


def mix_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 2 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mix_meets_targets(docs):
    rows = docs.join(mixing.mix(docs), "doc_id").collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert r.size == len(WORDS.findall(r.text)) and r.taken == r.copies * r.size and 0 <= r.copies <= 2
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = mix_targets(sizes)
    for r in rows:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
    largest = max(r.size for r in rows)
    assert all(abs(taken[s] - want[s]) <= largest / 2 for s in sizes)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in rows)
    repeated = Counter(r.doc_id for r in mixing.repeat(docs).select("doc_id").collect())
    assert repeated == Counter({r.doc_id: r.copies for r in rows if r.copies})


def test_mix_of_a_hot_source_follows_the_inclusion_odds(frame):
    rows = [(i, "w " * (1 + i % 5), "a" if i % 10 else "b") for i in range(4000)]
    mixed = mixing.mix(frame(rows, "doc_id long, text string, source string")).collect()
    want = mix_targets(Counter({s: sum(len(t.split()) for _, t, q in rows if q == s) for s in "ab"}))
    hot = [r for r in mixed if r.doc_id % 10]
    assert abs(sum(r.taken for r in hot) - want["a"]) <= 3
    share = want["a"] / sum(r.size for r in hot)
    by_size = {n: np.mean([r.copies for r in hot if r.size == n]) for n in range(1, 6)}
    assert all(abs(v - share) < 0.08 for v in by_size.values())


def test_mix_of_odd_rows(odd, nothing):
    mixed = mixing.mix(odd).collect()
    assert len(mixed) == 9 and all(r.taken == 0 for r in mixed if r.size == 0)
    assert mixing.repeat(odd).columns == odd.columns
    assert mixing.mix(nothing).count() == 0 and mixing.repeat(nothing).count() == 0


def test_pipeline_stages(spark, folder, docs, nothing):
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, folder).persist()
        assert kept.columns == docs.columns
        if name == "language":
            odd = {r.doc_id for r in before.collect()} - {r.doc_id for r in kept.collect()}
            assert len(odd) <= 0.02 * before.count()
        if name == "near_copies":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert {r.doc_id for r in kept.collect()} == {low for _, _, low in brute_join(rows)}
        if name == "personal":
            masked = {r.doc_id: r.text for r in pii.mask(before).collect()}
            assert {r.doc_id: r.text for r in kept.collect()} == masked
        if name == "mix":
            assert Counter(r.doc_id for r in kept.collect()) == Counter({r.doc_id: r.copies for r in mixing.mix(before).collect() if r.copies})
    assert corpus_pipeline.STAGES[-1][1](spark, kept, folder).count() == kept.count()


@pytest.mark.parametrize("table", ["odd", "nothing"])
def test_pipeline_takes_odd_tables(spark, request, table):
    kept = request.getfixturevalue(table)
    for _, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, "").persist()
        kept.count()
    assert table == "odd" or kept.count() == 0
