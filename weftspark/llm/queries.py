"""The queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, collocations, decontaminate, fingerprint, fm, language, lines, lm, negatives, quality, simhash, suffix, tokens

QUERIES = {
    "op1_fingerprint": fingerprint.op1_fingerprint,
    "op2_simhash": simhash.op2_simhash,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op6_lm": lm.op6_lm,
    "op7_fm_index": fm.op7_fm_index,
    "op8_language": language.op8_language,
    "op9_quality": quality.op9_quality,
    "op10_lines": lines.op10_lines,
    "op4_suffix": suffix.op4_suffix,
    "op5_bpe": bpe.op5_bpe,
    "op11_token_counts": tokens.op11_token_counts,
    "op12_collocations": collocations.op12_collocations,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}
ORACLES = {
    "op7_fm_index": fm.ORACLE,
    "op10_lines": lines.ORACLE,
    "op3_decontaminate": decontaminate.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_hard_negatives": negatives.ORACLE,
}
