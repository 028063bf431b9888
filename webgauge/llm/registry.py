"""The operator queries of this subpackage and their SQL."""

from __future__ import annotations

from . import crosspolytope, ctw, decontamination, jaccard, linededup, mixing, nbsvm, pii, pipeline, templates, tokencount


def queries() -> dict:
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_token_counts": tokencount.op2_token_counts,
        "op3_ngram_jaccard": jaccard.op3_ngram_jaccard,
        "op4_quality_classifier": nbsvm.op4_quality_classifier,
        "op5_decontamination": decontamination.op5_decontamination,
        "op6_main_texts": templates.op6_main_texts,
        "op7_line_dedup": linededup.op7_line_dedup,
        "op8_near_vectors": crosspolytope.op8_near_vectors,
        "op9_personal_data": pii.op9_personal_data,
        "op10_ctw_scores": ctw.op10_ctw_scores,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {
        "op1_mix_sources": mixing.OP1_SQL,
        "op2_token_counts": tokencount.op2_sql(tokencount.load_pieces()),
        "op3_ngram_jaccard": jaccard.OP3_SQL,
        "op6_main_texts": templates.OP6_SQL,
        "op7_line_dedup": linededup.OP7_SQL,
        "op8_near_vectors": crosspolytope.OP8_SQL,
        "op9_personal_data": pii.OP9_SQL,
    }
    if pipeline.ORACLE_SQL:
        found["pipeline"] = pipeline.ORACLE_SQL
    return found
