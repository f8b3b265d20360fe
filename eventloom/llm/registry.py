"""Queries of the corpus operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import decontaminate, langid, line_dedup, pieces, quality_pu, quality_rules, secrets, simhash, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (
        line_dedup.op1_line_dedup, pieces.op2_sentencepiece, secrets.op3_secret_scan, warc.op4_warc, langid.op5_language_id,
        quality_rules.op6_quality_rules, simhash.op7_simhash, toxicity.op8_toxicity, decontaminate.op9_decontaminate,
        quality_pu.op10_quality_classifier,
    )
}
ORACLES = {"op1_line_dedup": line_dedup.ORACLE_OP1, "op4_warc": warc.ORACLE_OP4}
