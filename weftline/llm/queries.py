"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontamination, html_text, lm_scores, neighbours, packing, resharding, secrets, simhash, token_counts, toxicity


def pipeline(spark, sf_dir):
    import corpus_pipeline  # at the repository top, beside the entry module

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_resharding": resharding.op2_resharding,
        "op3_packing": packing.op3_packing,
        "op4_html_text": html_text.op4_html_text,
        "op5_simhash": simhash.op5_simhash,
        "op6_lm_scores": lm_scores.op6_lm_scores,
        "op7_secrets": secrets.op7_secrets,
        "op8_decontamination": decontamination.op8_decontamination,
        "op9_neighbours": neighbours.op9_neighbours,
        "pipeline": pipeline,
        "op10_token_counts": token_counts.op10_token_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_decontamination": decontamination.OP8_SQL}
