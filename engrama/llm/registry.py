"""Queries and SQL of the training-data operators, for the top-level registry."""

from __future__ import annotations

from engrama.llm import decontamination, htmltext, lmscore, mixing, quality, sharding, simhash, toxicity, urlfilter, warc


def queries() -> dict:
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
        "op3_lm_scoring": lmscore.op3_lm_scoring,
        "op4_mixing": mixing.op4_mixing,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_html_extraction": htmltext.op6_html_extraction,
        "op7_warc": warc.op7_warc,
        "op8_url_filters": urlfilter.op8_url_filters,
        "op9_sharding": sharding.op9_sharding,
        "op10_decontamination": decontamination.op10_decontamination,
    }


def oracle_sql() -> dict:
    return {"op1_quality_rules": quality.OP1_SQL, "op3_lm_scoring": lmscore.OP3_SQL, "op4_mixing": mixing.OP4_SQL, "op7_warc": warc.OP7_SQL, "op8_url_filters": urlfilter.OP8_SQL}
