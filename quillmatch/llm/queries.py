"""The queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, counts, html_text, lines, mixing, nearcopies, periods, pieces, quality, repeats, toxicity, vectors, whitening

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_pieces": pieces.op2_pieces,
    "op3_nearcopies": nearcopies.op3_nearcopies,
    "op4_chat": chat.op4_chat,
    "op5_repeats": repeats.op5_repeats,
    "op6_mixing": mixing.op6_mixing,
    "op7_quality": quality.op7_quality,
    "op8_html": html_text.op8_html,
    "op9_vectors": vectors.op9_vectors,
    "op10_lines": lines.op10_lines,
    "op11_whitening": whitening.op11_whitening,
    "op12_counts": counts.op12_counts,
    "op13_periods": periods.op13_periods,
}

ORACLES = {"op4_chat": chat.ORACLE, "op6_mixing": mixing.ORACLE}
