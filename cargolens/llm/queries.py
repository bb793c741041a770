"""The operators as queries, with production parameters over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.llm import html_text, jaccard_join, langid, lm, mixing, near_vectors, phrases, pieces, pii, quality, ranked_search, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_log_bilinear")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return lm.score(table(spark, folder, "documents").select("doc_id", "text"))


@query("op2_language_id")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    filters = langid.learn(docs.where(~langid.held_out()))
    found = langid.identify(docs.select("doc_id", "text"), filters)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_share").alias("share"))


@query("op3_quality_rules")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    rated = quality.rate(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: Equal payloads by SHA-1; base32 from the hexadecimal digest, five digits (20 bits) to four letters.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY sha1(html)) AS last FROM p)
SELECT page_id, payload_bytes,
  array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * g, 5))::BIGINT >> (5 * (3 - k))) & 31)::INT, 1)
    for k in range(4)], '') for g in range(8)], '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM d
"""


@query("op4_warc_round_trip", WARC_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    files = warc.write(table(spark, folder, "pages"), warc.archive_folder(spark))
    return warc.read(files).select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


@query("op6_pii_pseudonyms")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii.mask(docs)


@query("op7_pieces")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


#: The mix again, over running sums of whole sources: fine for one machine and small tables.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5(coalesce(text, '')), 1, 12) AS digest FROM documents),
rows_ AS (SELECT *, floor(log2(greatest(size, 1)))::INT AS class FROM sized),
sources AS (SELECT source, sum(size)::DOUBLE AS source_size,
  [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::DOUBLE AS w FROM rows_ GROUP BY source),
steps AS (SELECT *, 2 * source_size AS cap,
  (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(w) OVER () - coalesce(sum(w) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM sources WINDOW f AS (ORDER BY 2 * source_size / w, source IS NULL, source)),
fixed AS (SELECT arg_min(level, cap / w) AS level FROM steps WHERE level * w <= cap),
targets AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM fixed) * w, cap)) AS target FROM steps),
classes AS (SELECT r.source, r.class, sum(size)::DOUBLE AS words, pow(2.0, -0.25 * greatest(class - 10, 0)) AS pref, any_value(target) AS target
  FROM rows_ r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source GROUP BY ALL),
cstep AS (SELECT *, row_number() OVER f AS place,
  (target - 2 * coalesce(sum(words) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / nullif(sum(words * pref) OVER (PARTITION BY source) - coalesce(sum(words * pref) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS level
  FROM classes WINDOW f AS (PARTITION BY source ORDER BY pref DESC, class)),
clevel AS (SELECT source, arg_min(level, place) AS level FROM cstep WHERE level * pref <= 2 GROUP BY source),
rates AS (SELECT c.source, c.class, least(2.0, coalesce(l.level * c.pref, 2.0)) AS rate
  FROM cstep c LEFT JOIN clevel l ON c.source IS NOT DISTINCT FROM l.source),
drawn AS (SELECT r.*, t.source_size, t.target, CASE WHEN size > 0 THEN floor(rate)::BIGINT ELSE 0 END AS sure,
  CASE WHEN size > 0 THEN rate - floor(rate) ELSE 0 END AS chance,
  (('0x' || substr(md5('8|' || coalesce(doc_id::VARCHAR, '') || '|' || digest), 1, 12))::BIGINT + 0.5) / 281474976710656.0 AS u
  FROM rows_ r JOIN rates q ON r.source IS NOT DISTINCT FROM q.source AND r.class = q.class
  JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
ranked AS (SELECT *, CASE WHEN chance > 0 THEN (u / (1 - u)) / (chance / (1 - chance)) END AS rank,
  target - sum(sure * size) OVER (PARTITION BY source) AS lacking FROM drawn),
binned AS (SELECT *, floor(rank / (1 + rank) * ceil(sqrt(count(*) OVER (PARTITION BY source))))::INT AS bin FROM ranked),
reach AS (SELECT source, bin, lacking, sum(sum(size)) OVER (PARTITION BY source ORDER BY bin) AS upto, sum(size) AS words
  FROM binned WHERE chance > 0 GROUP BY source, bin, lacking),
edge AS (SELECT source, min(bin) AS edge_bin, arg_min(lacking - upto + words, bin) AS left_ FROM reach WHERE upto > lacking GROUP BY source),
line AS (SELECT b.*, left_, sum(size) OVER w AS upto, row_number() OVER w AS place FROM binned b JOIN edge e
  ON b.source IS NOT DISTINCT FROM e.source AND b.bin BETWEEN edge_bin AND edge_bin + 6
  WINDOW w AS (PARTITION BY b.source ORDER BY rank, doc_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
first_ AS (SELECT source, min(place) AS x, arg_min(upto, place) AS xu, arg_min(size, place) AS xs FROM line WHERE upto > left_ GROUP BY source),
judged AS (SELECT l.*, x, xu, xs, max(CASE WHEN place < x THEN upto WHEN place > x AND upto - xs <= left_ THEN upto - xs END)
  OVER (PARTITION BY l.source) AS reached FROM line l JOIN first_ f ON l.source IS NOT DISTINCT FROM f.source),
chosen AS (SELECT doc_id, digest, source, CASE WHEN xu - left_ <= left_ - coalesce(reached, 0) THEN place <= x
  ELSE place < x OR (place > x AND upto - xs <= left_) END AS chosen FROM judged),
taken AS (SELECT b.*, sure + CASE WHEN chance > 0 AND (e.edge_bin IS NULL OR bin < e.edge_bin OR coalesce(c.chosen, false)) THEN 1 ELSE 0 END AS copies
  FROM binned b LEFT JOIN edge e ON b.source IS NOT DISTINCT FROM e.source
  LEFT JOIN chosen c ON b.doc_id = c.doc_id AND b.digest = c.digest AND b.source IS NOT DISTINCT FROM c.source)
"""
MIX_TAIL = """SELECT doc_id, size, source_size::BIGINT AS source_size, round(target, 6) AS target, (copies * size)::BIGINT AS taken FROM taken"""


@query("op8_mix_sources", MIX_SQL + MIX_TAIL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query("op9_jaccard_join")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.join(table(spark, folder, "documents").select("doc_id", "text")).drop("row")


@query("op10_main_text")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = html_text.main_text(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op5_near_vectors")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors.link(table(spark, folder, "embeddings"))


#: Words have no space in them, so phrases are told apart by their text.
PHRASE_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest([array_to_string(ws[i:i + k - 1], ' ') for i in range(1, len(ws) - k + 2)]) AS phrase FROM w, (VALUES (1), (2), (3)) t(k)),
f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND n >= 10),
cuts AS (SELECT c.*, j, array_to_string(ws[1:j], ' ') AS x, array_to_string(ws[j + 1:], ' ') AS y FROM c, (VALUES (1), (2)) t(j) WHERE j < c.k),
scored AS (SELECT cuts.*, l.n AS l, r.n AS r, (1000000::HUGEINT * a * a) // (l.n::HUGEINT * r.n) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_ AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
most AS (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN most m ON b.lang = m.lang AND b.phrase = m.phrase WHERE longer IS NULL OR 100 * longer < 50 * b.a),
n AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n, score::BIGINT AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
"""


@query("op11_phrase_collocations", PHRASE_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.mine(table(spark, folder, "documents").select("text", "lang"))


SEARCH_SQL = r"""
WITH q AS (SELECT DISTINCT item_id, text FROM benchmark),
lists AS (SELECT item_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM q),
qt AS (SELECT item_id, text, term, count(*) AS repeats FROM (SELECT item_id, text, unnest(ts) AS term FROM lists) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS row_, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
sized AS (SELECT row_, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
c AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM sized),
tf AS (SELECT row_, term, count(*) AS tf FROM (SELECT row_, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY term),
p AS (SELECT tf.row_, doc_id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * big_n) // big_l)))) AS impact
  FROM tf JOIN sized ON tf.row_ = sized.row_ JOIN w ON tf.term = w.term, c),
s AS (SELECT item_id, text, row_, doc_id, sum(repeats * impact)::BIGINT AS score FROM qt JOIN p ON qt.term = p.term GROUP BY ALL HAVING score > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s QUALIFY rank <= 10
"""


@query("op12_ranked_search", SEARCH_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return ranked_search.rank(docs, table(spark, folder, "benchmark"))


@query("op13_toxicity")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.learn(docs.where(~toxicity.held_out()), table(spark, folder, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model)
