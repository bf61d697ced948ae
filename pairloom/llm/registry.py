"""Queries and DuckDB forms that the entry adds when this subpackage can be imported."""

from __future__ import annotations

from pairloom.llm import queries as q

QUERIES = {
    "op1_exact_dedup": q.op1_exact_dedup,
    "op2_toxicity": q.op2_toxicity,
    "op3_media": q.op3_media,
    "op4_token_store": q.op4_token_store,
    "op5_licences": q.op5_licences,
    "op6_html_text": q.op6_html_text,
    "op7_byte_bpe": q.op7_byte_bpe,
    "op8_near_dedup": q.op8_near_dedup,
    "op9_secrets": q.op9_secrets,
    "op10_packing": q.op10_packing,
}

ORACLES = {
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY h ORDER BY length(t) DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY h) AS group_size,
               doc_id = first_value(doc_id) OVER (PARTITION BY h ORDER BY length(t) DESC, doc_id) AS kept,
               h AS text_sha256
        FROM d""",
}
