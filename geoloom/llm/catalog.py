"""The subpackage's queries and their SQL twins."""

from __future__ import annotations

from geoloom.llm import alignment, brown, decontaminate, exact_dedup, language, licenses, mixing, near_dedup, pii, resample, toxicity, url_filter, vector_dedup


def queries() -> dict:
    return {
        "op1_brown_lm": brown.op1_brown_lm,
        "op2_language_id": language.op2_language_id,
        "op3_near_dedup": near_dedup.op3_near_dedup,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_license_scan": licenses.op5_license_scan,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_source_mix": mixing.op8_source_mix,
        "op9_pii": pii.op9_pii,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_token_alignment": alignment.op11_token_alignment,
        "op12_resample": resample.op12_resample,
        "op13_vector_dedup": vector_dedup.op13_vector_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_url_filter": url_filter.OP7_SQL,
        "op8_source_mix": mixing.OP8_SQL,
        "op10_exact_dedup": exact_dedup.OP10_SQL,
        "op12_resample": resample.OP12_SQL,
    }
