"""Scoring, language, quality, personal data, pieces and HTML against brute force, round trips and held-out rows."""

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter
from datetime import date

import pytest
from pyspark.sql import functions as F

from cargolens.llm import html_text, langid, lm, pieces, pii, quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def crc(key):
    return zlib.crc32(str(key).encode()) if key is not None else zlib.crc32(b"")


def lm_tokens(text):
    return [*WORDS.findall((text or "").translate(FOLD)), None]


def check_base(rows, scored):
    tokens = [(k, lm_tokens(t)) for k, t in rows]
    count = Counter()
    for k, own in tokens:
        if crc(k) % 5 != 1:
            count.update(own)
    n, v = sum(count.values()), len(count)
    want = sorted((str(k), len(own), sum(count[w] > 0 for w in own), round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), 6))
                  for k, own in tokens)
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in scored)
    assert got == want
    assert all(r.train_tokens == n and r.held_out == (crc(r.doc_id) % 5 == 1) for r in scored)


def test_scores_beat_the_base_on_held_out_texts(docs):
    scored = lm.score(docs).collect()
    check_base([(r.doc_id, r.text) for r in docs.collect()], scored)
    held = [r for r in scored if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rare_words_go_through_the_shuffle(docs, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 400)
    check_base([(r.doc_id, r.text) for r in docs.collect()], lm.score(docs).collect())


def test_symbol_probabilities_are_normalised():
    import numpy as np

    v = lm.Vocabulary(np.arange(5, dtype=np.uint64), np.arange(5, dtype=np.int16), np.zeros(1 << 16, np.int16), np.full(lm.Vocabulary.size, 1 / lm.Vocabulary.size))
    model = lm.Model(v)
    context = [v.size] * lm.CONTEXT
    flat = np.array([x for s in range(v.size) for x in [*context, s]], np.int16)
    at = np.arange(v.size) * (lm.CONTEXT + 1) + lm.CONTEXT
    assert abs(sum(10 ** model.log10(flat, at)) - 1) < 1e-4


def test_scores_of_odd_rows(odd, nothing):
    check_base([(r.doc_id, r.text) for r in odd.collect()], lm.score(odd).collect())
    assert lm.score(nothing).count() == 0


def test_language_of_held_out_texts(docs):
    filters = langid.learn(docs.where(~langid.held_out()))
    found = langid.identify(docs.where(langid.held_out()), filters).where(F.length("text") > 50).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
    assert all(0 <= r.lang_score <= 1 for r in found)


def test_filters_return_every_language_of_a_gram():
    import numpy as np

    h = np.random.default_rng(1).integers(0, 1 << 63, 3000, dtype=np.uint64)
    for languages in (2, 9, 70):
        sets = [h[i * 20:i * 20 + 500] for i in range(languages)]
        f = langid.build([f"l{i:02d}" for i in range(languages)], sets)
        masks = f.masks(h)
        for i, own in enumerate(sets):
            bit = (masks[i // 64] >> masks[i // 64].dtype.type(i % 64)) & masks[i // 64].dtype.type(1)
            assert bit[np.isin(h, own)].all() and bit[~np.isin(h, own)].mean() < 0.05


def test_language_of_odd_rows(odd, nothing):
    filters = langid.learn(odd)
    found = {(r.doc_id, r.text): r for r in langid.identify(odd, filters).collect()}
    assert langid.identify(odd, filters).columns == [*odd.columns[:-1], "lang_pred", "lang_score", "lang_share"]
    assert all(r.lang_pred == "und" and r.lang_score == 0 for (k, t), r in found.items() if not any(c.isalpha() for c in t or ""))
    assert len(found) == 8 and langid.identify(odd, filters).count() == 9
    assert langid.identify(nothing, langid.learn(nothing)).count() == 0
    assert {r.lang_pred for r in langid.identify(odd, langid.learn(nothing)).collect()} == {"und"}


def brute_quality(t):
    t = t or ""
    w = WORDS.findall(t)
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    window = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if window[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(lines)


def test_quality_counts(docs, odd, frame):
    more = frame([(i, t) for i, t in enumerate(["a\n\n a\na\n", "x y z w v x y z w v x", "a\r\nb\na", "\n", "é é\n\té é\n", "a b c d e a b c d e\n" * 50])], "doc_id long, text string")
    for table in (docs, odd, more):
        rows = table.select("text", quality.feature_column(F.col("text")).alias("f")).collect()
        assert all(tuple(r.f) == brute_quality(r.text) for r in rows)


def test_exact_binomial_bound():
    for rejected, good, allowed, level in ((0, 100, 0.05, 0.01), (3, 200, 0.05, 0.01), (4, 200, 0.05, 0.05), (0, 10, 0.05, 0.05), (7, 400, 0.03, 0.1)):
        tail = sum(math.comb(good, k) * allowed ** k * (1 - allowed) ** (good - k) for k in range(rejected + 1))
        assert quality.upper_bound_holds(rejected, good, allowed, level) == (tail <= level)


def test_accepted_cutoffs_hold_and_unlabelled_strata_reject_nothing(frame, odd, nothing):
    rows = [(i, ("word% " if i % 4 == 0 else "wordy ") * 20 + str(i), "en" if i % 3 else None) for i in range(3000)]
    labels = frame([(i, int(i % 4 != 0)) for i in range(3000)], "doc_id long, quality int")
    docs = frame(rows, "doc_id long, text string, lang string")
    # Twenty equal words fail the base rules, so the words are made different.
    docs = docs.withColumn("text", F.expr("array_join(transform(sequence(1, 20), i -> concat(split(text, ' ')[0], cast(i * (doc_id % 97 + 1) as string))), ' ')"))
    rated = quality.rate(docs, labels).collect()
    assert {r.kept for r in rated if r.doc_id % 4 == 0} == {False} and all(r.kept for r in rated if r.doc_id % 4)
    without = quality.rate(docs, labels.where("false")).collect()
    assert all(r.kept for r in without)
    assert [r for r in quality.rate(odd, labels).collect() if r.doc_id in (2, 3, 4) and not r.base_failed] == []
    assert quality.rate(nothing, labels).count() == 0


CASES = ["mail bob.24@mail4.example.com now", "from 1.2.3.4 to 999.1.1.1", "+1 (017) 555-7713", "call (415) 555-1212", "4532015112830366 and 4532015112830367",
         "4532 0151 1283 0366", "2021-02-28 or 28.02.2021", "2/28/2021", "2021-02-30", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000",
         "078-05-1120", "000-12-1234", "v1.2.3.4.5", "a@b", "plain words, 3.5 kg and 2019"]


def test_pseudonyms_keep_format_checks_and_links():
    p = pii.Permutation(b"k")
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", s)))
    for t in CASES:
        new, seen = pii.pseudonymise(t, p)
        assert (new == t) == (not seen) and pii.pseudonymise(t, p)[0] == new
        if "ip" not in seen and t != "2/28/2021":
            assert shape(new) == shape(t)
        again = {k for *_, k, _ in pii.find(new, p)}
        assert again == set(seen)  # what comes out is valid again
    assert pii.pseudonymise("2021-02-30 000-12-1234 4532015112830367 v1.2.3.4.5 a@b", p)[1] == {}
    day = lambda s: pii._day(pii.pseudonymise(s, p)[0])[0]
    assert day("2021-02-28") == day("28.02.2021") == day("2/28/2021") != date(2021, 2, 28)


def test_values_side_by_side_are_all_found():
    p = pii.Permutation(b"k")
    text = "+1 (826) 555-4081 190.137.223.204 +44 20 7946 0958 10.20.30.40 a.1@mail.example.com 4532015112830366 +1 (017) 555-7713!!"
    assert [k for *_, k, _ in pii.find(text, p)] == ["phone", "ip", "phone", "ip", "email", "card", "phone"]


def test_permutation_is_one_to_one():
    p = pii.Permutation(b"k")
    for size in (1, 2, 3, 10, 97, 1000):
        assert sorted(p.of("x", i, size) for i in range(size)) == list(range(size))
    assert [pii.Permutation(b"other").of("x", i, 1000) for i in range(20)] != [p.of("x", i, 1000) for i in range(20)]


def test_pseudonyms_of_whole_texts(docs, odd, nothing):
    rows = {r.doc_id: r for r in docs.withColumn("was", F.col("text")).transform(pii.mask).collect()}
    mail = re.compile(r"[\w.]+@mail\d\.example\.com")
    mails = {m for r in rows.values() for m in mail.findall(r.was)}
    assert mails and not any(m in r.text for r in rows.values() for m in mail.findall(r.was))
    assert all((r.text == r.was) == (r.pii_total == 0) for r in rows.values())
    assert pii.mask(odd).columns[:len(odd.columns)] == odd.columns and pii.mask(odd).where("text IS NULL").count() == 1
    assert pii.mask(nothing).count() == 0


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return pieces.encoder(open(public_tokenizers.path(pieces.MODEL), "rb").read())


def test_pieces_equal_the_library(model, docs):
    draw = random.Random(7)
    alphabet = ["a", "b", " ", "  ", "▁", "\n", "\t", "<s>", "<0x0A>", "é", "日本", "😀", "the ", "ing", "|||", "...", "\x00", "　", "ß", "12"]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40))) for _ in range(2000)]
    texts += [r.text for r in docs.collect()] + ["a" * 5000, "ab" * 3000 + " x", " ", "x "]
    assert list(model.encode_all(texts)) == [model.library.encode(t) for t in texts]


def test_pieces_of_odd_rows(model, odd, nothing):
    out = pieces.encode(odd, check_every=1, lists=True)
    assert out.columns == [*[c for c in odd.columns], "ids_sha256", "decoded_sha256", "ids", "decoded"]
    for r in out.collect():
        ids = model.library.encode(r.text or "")
        back = model.library.decode(ids) if ids else ""
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), back)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert pieces.encode(nothing).count() == 0


def test_main_text_of_the_pages(spark, folder):
    rows = html_text.main_text(spark.read.parquet(f"{folder}/pages.parquet")).collect()
    for r in rows:
        article = re.sub(r"<[^>]*$", "", re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1])
        text = html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", "\n", article)))
        assert r.text == re.sub(r"\s+", " ", text).strip()


def test_main_text_without_an_article_element(frame):
    page = ('<!DOCTYPE html><body><header>Site</header><div id="menu"><a href="/">Home</a></div><div class="wrap"><h1>Head &amp; line</h1><div class="body">'
            '<p>Some long text, with points.  And\nmore of it, really.<p>Short <i>one</i>s<ul><li>First item<li>Second</ul><script>if (a < b) "</p>"</script></div></div>'
            '<div class="comments"><p>I disagree, with all of it. Really.</p></div><form>Name <input></form><footer>Foot, note.</footer></body>')
    want = "Head & line Some long text, with points. And more of it, really. Short ones First item Second"
    assert html_text.extract(page) == want
    rows = [(1, page, "x"), (1, page, "x"), (2, None, "x"), (3, "", "x"), (4, "<p", "x"), (5, "<p>Only text", "x"), (6, '<a href="', "x"), (7, "<" * 500, "x")]
    got = sorted((r.page_id, r.text) for r in html_text.main_text(frame(rows, "page_id long, html string, text string")).collect())
    assert got[:4] == [(1, want), (1, want), (2, ""), (3, "")] and got[5] == (5, "Only text") and len(got) == 8
    assert html_text.extract("<div>" * 3000 + "deep text, here." + "</div>" * 3000) == "deep text, here."


WORDY = "<h1>The head line</h1><p>Some long text, with points.  And more of it, really.</p><p>A second part, as long, with points. It goes on, too.</p>"
WORDY_TEXT = "The head line Some long text, with points. And more of it, really. A second part, as long, with points. It goes on, too."


@pytest.mark.parametrize("wrap", ['<div class="layout with-sidebar">', '<div class="no-sidebar">', '<div id="page-widget">', "<form action='/'>", "<div hidden>",
                                  '<form><div class="menu-open">'])
def test_main_text_in_marked_wrappers(wrap):
    rest = '<nav><a href="/">Home</a></nav><div class="sidebar">More, here.</div>'
    assert html_text.extract(f"<body>{rest}{wrap}<article>{WORDY}</article>") == WORDY_TEXT
    assert html_text.extract(f"<body>{wrap}{rest}<div>{WORDY}</div>") == WORDY_TEXT


def test_main_text_keeps_what_only_sounds_marked():
    page = WORDY.replace("<h1>", '<div class="entry-header"><h1>').replace("</h1>", "</h1></div>").replace("Some long", '<a href="/blog/hidden-costs">Some</a> long')
    page = page.replace("<p>A second", '<p title="a hidden gem" data-role="menu" data-class=\'ad\'>A second')
    assert html_text.extract(f"<body><nav>Home</nav><div>{page}</div>") == WORDY_TEXT
    assert html_text.extract(f'<body><div>{page}<p hidden>Not, shown.</p><p class="x ad">Buy, now.</p></div>') == WORDY_TEXT


def test_main_text_shared_by_marked_parts():
    part = "<p>Some long text, with points.</p>"
    assert html_text.extract(f'<body><div class="promo">{part}</div><div class="banner">{part}</div>') == "Some long text, with points. Some long text, with points."


def test_one_number_has_one_pseudonym_however_spaced():
    p = pii.Permutation(b"k")
    for group in (["+1 555 123 4567", "+15551234567", "+1 (555) 123-4567", "+1.555.123.4567"], ["+49 30 1234567", "+49301234567"], ["+353 1 234 5678", "+35312345678"]):
        out = {re.sub(r"[^\d+]", "", pii._phone(p, v)) for v in group}
        assert len(out) == 1 and next(iter(out))[:2] == group[0][:2]
    assert re.sub(r"\D", "", pii._phone(p, "(555) 123-4567")) == re.sub(r"\D", "", pii._phone(p, "+1 555 123 4567"))[1:]


@pytest.mark.parametrize("item", ["<b>x", "<center>y", "<p><div><b>z", "<li>q", "</b><i>w", "<a href='#'>l"])
def test_deep_and_unclosed_pages_take_linear_time(item):
    import time

    start = time.process_time()
    text = html_text.extract("<html><body><p>" + item * 60_000)
    assert time.process_time() - start < 30 and len(text) >= 50_000


def test_unmarked_menus_inside_the_container_go():
    links = "".join(f"<div><a href='/x{i}'>Item {i}</a></div>" for i in range(10))
    paragraphs = "".join(f"<p>This is, in truth, sentence number {i}, and it says <a href='#'>a good deal</a>, as one would hope; see.</p>" for i in range(8))
    want = " ".join(f"This is, in truth, sentence number {i}, and it says a good deal, as one would hope; see." for i in range(8))
    assert html_text.extract(f"<html><body><div>{links}{paragraphs}{links}</div></body></html>") == want
    assert html_text.extract(f"<html><body><div>{paragraphs}</div></body></html>") == want
