"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from vellum.llm import exact_dedup, html_text, mixing, near_join, ngram_lm, packing, quality, secrets, surrogates, vector_search


def queries() -> dict:
    return {
        "op1_html_extraction": html_text.op1_html_extraction,
        "op2_vector_search": vector_search.op2_vector_search,
        "op3_ngram_lm": ngram_lm.op3_ngram_lm,
        "op4_quality_classifier": quality.op4_quality_classifier,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_secret_scan": secrets.op6_secret_scan,
        "op7_mixing": mixing.op7_mixing,
        "op8_best_fit_packing": packing.op8_best_fit_packing,
        "op9_surrogates": surrogates.op9_surrogates,
        "op10_near_join": near_join.op10_near_join,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": exact_dedup.OP5_SQL, "op7_mixing": mixing.OP7_SQL}
