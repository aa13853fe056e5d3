"""Registered queries of the subpackage and the SQL that some of them are checked against."""

from __future__ import annotations

from twinrun.llm import audit, bpe, counts, licenses, lines, merkle, ngrams, packing, quality, substrings, toxicity, vectors, warc

QUERIES = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_warc_derivatives": warc.op2_warc_derivatives,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_ngram_jaccard_join": ngrams.op4_ngram_jaccard_join,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_nearest_neighbours": vectors.op6_nearest_neighbours,
    "op7_substring_dedup": substrings.op7_substring_dedup,
    "op8_token_counts": counts.op8_token_counts,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_filter_audit": audit.op13_filter_audit,
}

SQL = {
    "op2_warc_derivatives": warc.SQL,
    "op3_line_dedup": lines.SQL,
    "op5_quality_rules": quality.SQL,
    "op7_substring_dedup": substrings.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op13_filter_audit": audit.SQL,
}
