"""The registered queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import exact, languages, lines, merkle, mix, near, pack, quality, search, secrets, suffix, tokens, toxic

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_exact_dedup": exact.op2_exact_dedup,
    "op3_suffix_dedup": suffix.op3_suffix_dedup,
    "op4_near_dedup": near.op4_near_dedup,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_toxicity": toxic.op6_toxicity,
    "op7_mix_sources": mix.op7_mix_sources,
    "op8_token_counts": tokens.op8_token_counts,
    "op9_pack_harmonic": pack.op9_pack_harmonic,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_language_id": languages.op12_language_id,
    "op13_ranked_search": search.op13_ranked_search,
}

SQL = {
    "op1_secret_scan": secrets.sql(),
    "op2_exact_dedup": exact.SQL,
    "op5_line_dedup": lines.SQL,
    "op7_mix_sources": mix.SQL,
    "op10_quality_rules": quality.sql(),
    "op11_merkle_manifest": merkle.SQL,
    "op13_ranked_search": search.SQL,
}
