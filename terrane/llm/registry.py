"""The queries of this subpackage and their DuckDB SQL, for the driver's entry module."""

from __future__ import annotations

from terrane.llm import exact, licenses, mixing, packing, passages, secrets, simhash, toxicity, urls, vectors

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_exact_dedup": exact.op2_exact_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_embedding_near_dedup": vectors.op5_embedding_near_dedup,
    "op6_substring_dedup": passages.op6_substring_dedup,
    "op7_url_filter": urls.op7_url_filter,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_secret_scan": secrets.op10_secret_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": exact.OP2_SQL,
    "op7_url_filter": urls.OP7_SQL,
}
