"""The queries of the corpus operators, by name."""

from __future__ import annotations

from . import bpe, decontam, html, licenses, negatives, pii, quality, repeats, resample, simhash, tokenfile, toxicity, warc

QUERIES = {
    "op1_repeats": repeats.op1_repeats,
    "op2_token_files": tokenfile.op2_token_files,
    "op3_simhash": simhash.op3_simhash,
    "op4_decontamination": decontam.op4_decontamination,
    "op5_licenses": licenses.op5_licenses,
    "op6_revisits": warc.op6_revisits,
    "op7_quality": quality.op7_quality,
    "op8_bpe_automaton": bpe.op8_bpe_automaton,
    "op9_main_text": html.op9_main_text,
    "op10_pii": pii.op10_pii,
    "op11_importance": resample.op11_importance,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_toxicity": toxicity.op13_toxicity,
}
ORACLES: dict[str, str] = {"op6_revisits": warc.ORACLE, "op12_hard_negatives": negatives.ORACLE}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
