"""The corpus pipeline: each stage works on what the one before has written."""

from __future__ import annotations

from quillmatch.llm import lines, mixing, nearcopies, pieces, quality
from quillmatch.llm.common import table, written

STAGES = [
    ("quality", quality.keep_good),
    ("lines", lines.dedup_stage),
    ("nearcopies", nearcopies.one_of_each),
    ("mixing", mixing.take_mix),
    ("pieces", pieces.encode_stage),
]

#: SQL can express neither the hashes of the first stage nor the alignment and the tokenizer of later ones.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Applies the stages to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
