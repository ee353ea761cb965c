"""The queries of this package and their SQL, for the driver's entry module."""

from __future__ import annotations

from . import decontaminate, exact, licenses, lines, lm, packing, pii, quality, simhash, toxicity

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_lm_score": lm.op2_lm_score,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_pii": pii.op5_pii,
    "op6_simhash": simhash.op6_simhash,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_exact_dedup": exact.op9_exact_dedup,
    "op10_quality": quality.op10_quality,
}
SQL = {
    "op7_decontamination": decontaminate.OP7_SQL,
    "op8_line_dedup": lines.OP8_SQL,
    "op9_exact_dedup": exact.OP9_SQL,
}
