"""Multi-party chats seen from every participant.

For each participant of a conversation the whole dialogue is rendered with that speaker as the assistant and the others as
users with a name. Only what the speaker says is to be learnt: its text and end mark, as spans of characters.

Defined results: turns go by (turn, role, text), nulls first; a null text is empty, a null role is `unknown`; rows repeated in
full are turns of their own; `system` is no participant and keeps its role; a conversation without participants gives no
row; a null conv_id is a conversation too. Marks inside a text or name are broken by a space, and line breaks in a name are
spaces, so that no turn can forge another. Extra columns are not read; an empty table gives no rows. A conversation is one record, and so has to fit one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

BEGIN, END = "<|im_start|>", "<|im_end|>"


def head(role: str, speaker: str) -> str:
    if role == "system":
        return f"{BEGIN}system\n"
    return f"{BEGIN}assistant\n" if role == speaker else f"{BEGIN}user name={role}\n"


def render(turns: list[tuple[str, str]], speaker: str) -> tuple[str, list[tuple[int, int]]]:
    """The dialogue for one speaker, and the spans that it learns from."""
    out, spans, at = [], [], 0
    for role, text in turns:
        start, body = head(role, speaker), f"{text}{END}"
        if role == speaker:
            spans.append((at + len(start), at + len(start) + len(body)))
        out += [start, body, "\n"]
        at += len(start) + len(body) + 1
    return "".join(out), spans


def perspectives(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) to (conv_id, speaker, n_turns, text, spans), a row for each participant."""
    safe = lambda c, null: F.replace(F.coalesce(c, F.lit(null)), F.lit("<|"), F.lit("< |"))
    name = F.translate(safe("role", "unknown"), "\n\r\u000b\u000c\u0085\u2028\u2029", " " * 7)
    rows = turns.select("conv_id", F.struct("turn", name.alias("role"), safe("text", "").alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    kind = turns.schema["conv_id"].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                said = [(t["role"], t["text"]) for t in batch.column("turns")[at].as_py()]
                speakers = sorted({role for role, _ in said if role != "system"})
                for k in range(0, len(speakers), 64):  # rows leave in small batches, however many take part
                    made = [render(said, s) for s in speakers[k : k + 64]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("conv_id").take(pa.array([at] * len(made))),
                            pa.array(speakers[k : k + 64]),
                            pa.array([len(said)] * len(made), pa.int64()),
                            pa.array([text for text, _ in made]),
                            pa.array([[{"start": a, "stop": b} for a, b in spans] for _, spans in made], pa.list_(span)),
                        ],
                        ["conv_id", "speaker", "n_turns", "text", "spans"],
                    )

    return whole.mapInArrow(run, f"conv_id {kind}, speaker string, n_turns long, text string, spans array<struct<start:bigint,stop:bigint>>")


def op4_chat(spark, sf_dir: str) -> DataFrame:
    """The rendered dialogues, with the spans written as start:stop."""
    made = perspectives(table(spark, sf_dir, "conversations"))
    learnt = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["stop"] - x["start"])
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["stop"].cast("string"))), " ")
    return made.select("conv_id", "speaker", "n_turns", "text", spans.alias("spans"), learnt.alias("n_learnt"))


ORACLE = r"""
WITH said AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM (
    SELECT conv_id, turn, translate(replace(coalesce(role, 'unknown'), '<|', '< |'), chr(10) || chr(13) || chr(11) || chr(12) || chr(133) || chr(8232) || chr(8233), '       ') AS role,
           replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations)),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM said WHERE role <> 'system'),
parts AS (
  SELECT s.conv_id, speaker, k, role = speaker AS own, text || '<|im_end|>' AS body,
         CASE WHEN role = 'system' THEN '<|im_start|>system' WHEN role = speaker THEN '<|im_start|>assistant' ELSE '<|im_start|>user name=' || role END || chr(10) AS head
  FROM said t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (
  SELECT *, (sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker ORDER BY k ROWS UNBOUNDED PRECEDING))::BIGINT - length(body) - 1 AS start FROM parts)
SELECT conv_id, speaker, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY k) AS text,
       string_agg(start::VARCHAR || ':' || (start + length(body))::VARCHAR, ' ' ORDER BY k) FILTER (WHERE own) AS spans,
       sum(CASE WHEN own THEN length(body) ELSE 0 END)::BIGINT AS n_learnt
FROM placed GROUP BY conv_id, speaker
"""
