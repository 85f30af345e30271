"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import knn, licenses, mixing, packing, repetition, simhash, substring, token_counts, toxicity, url_lists

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_mixing": mixing.op3_mixing,
    "op4_substring": substring.op4_substring,
    "op5_knn": knn.op5_knn,
    "op6_url_lists": url_lists.op6_url_lists,
    "op7_repetition": repetition.op7_repetition,
    "op8_licenses": licenses.op8_licenses,
    "op9_simhash": simhash.op9_simhash,
    "op10_toxicity": toxicity.op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op4_substring": substring.OP4_SQL,
    "op5_knn": knn.OP5_SQL,
    "op6_url_lists": url_lists.OP6_SQL,
    "op7_repetition": repetition.OP7_SQL,
    "op8_licenses": licenses.OP8_SQL,
}
