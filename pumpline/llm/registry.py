"""The subpackage's queries and their SQL."""

from __future__ import annotations

from pumpline.llm import chunks, codes, language, minhash, neighbours, packing, pieces, pii, quality, scoring, search, toxicity, urls


def queries() -> dict:
    return {"op1_pieces": pieces.op1_pieces, "op2_scoring": scoring.op2_scoring, "op3_urls": urls.op3_urls, "op4_packing": packing.op4_packing, "op5_pseudonyms": pii.op5_pseudonyms, "op6_neighbours": neighbours.op6_neighbours, "op7_chunks": chunks.op7_chunks, "op8_language": language.op8_language, "op9_quality": quality.op9_quality, "op10_minhash": minhash.op10_minhash, "op11_search": search.op11_search, "op12_toxicity": toxicity.op12_toxicity, "op13_codes": codes.op13_codes, "url_rules": urls.url_rules, "baseline_scores": scoring.baseline_scores}


def oracle_sql() -> dict:
    return {"op9_quality": quality.ORACLE, "op10_minhash": minhash.ORACLE, "op11_search": search.ORACLE, "op13_codes": codes.ORACLE, "url_rules": urls.RULES_SQL, "baseline_scores": scoring.BASELINE_SQL}
