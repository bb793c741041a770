"""Every operator's query runs over the small tables; those with SQL give its rows."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

import check  # noqa: E402

from cargolens.llm import queries  # noqa: E402

COLUMNS = {
    "op1_log_bilinear": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op2_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op3_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op4_warc_round_trip": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op5_near_vectors": {"vec_id", "n_links", "component_id", "kept"},
    "op6_pii_pseudonyms": {"doc_id", "text"},
    "op7_pieces": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op8_mix_sources": {"doc_id", "size", "source_size", "target", "taken"},
    "op9_jaccard_join": {"doc_id", "class_id", "n_links", "group_id"},
    "op10_main_text": {"page_id", "url", "text", "n_chars"},
    "op11_phrase_collocations": {"lang", "rank", "phrase", "a", "l", "r", "n", "score"},
    "op12_ranked_search": {"item_id", "rank", "doc_id", "score"},
    "op13_toxicity": {"doc_id", "held_out", "score", "predicted"},
}
#: Their rows are not those of a table.
LISTS = {"op11_phrase_collocations", "op12_ranked_search"}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, folder, name):
    rows, _, _, difference = check.compare(spark, check.connect(folder), name, folder)
    assert difference is None
    out = queries.QUERIES[name](spark, folder)
    assert COLUMNS[name] <= set(out.columns)
    if name in LISTS:
        assert rows > 0
        return
    table = "pages" if name[:4] in ("op4_", "op10") else "embeddings" if name.startswith("op5") else "documents"
    assert rows == spark.read.parquet(f"{folder}/{table}.parquet").count()
