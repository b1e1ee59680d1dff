"""Queries over pages of two columns: of each document, every second line stands in the right column."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmatch.operators import sequence

from .derived import table
from .registry import query

_LINES = r"""lines AS (SELECT doc_id AS page_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) AS line FROM documents)"""


def _lines(spark, sf_dir):
    """(page_id, pos, line) of the lines that are not blank."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " "))).where("line <> ''")


@query(rf"""WITH {_LINES},
n AS (SELECT page_id, CASE WHEN pos % 2 = 0 THEN 'l' ELSE 'r' END AS side, pos // 2 AS ord, CASE WHEN pos % 2 = 0 AND (pos // 2) % 4 <> 3 THEN (pos // 2 + 1) || '. ' || line ELSE line END AS text,
  20.0::DOUBLE * (pos // 2) + CASE WHEN pos % 2 = 1 THEN (pos % 5) * 3 - 6 ELSE 0 END AS y0 FROM lines WHERE line <> ''),
m AS (SELECT *, y0 + 12 AS y1, nullif(greatest(coalesce(try_cast(regexp_extract(text, '^\s*(?:[Qq](?:uestion)?[\s.:#-]*)?([0-9]{{1,3}})\s*[).:\-॰°]', 1) AS INT), 0), 0), 0) AS no FROM n),
pg AS (SELECT page_id, count(no) FILTER (side = 'l') AS l, count(no) FILTER (side = 'r') AS r, count(*) FILTER (side = 'l') AS n_l, count(*) FILTER (side = 'r') AS n_r FROM m GROUP BY page_id),
q AS (SELECT m.*, CASE WHEN r >= l THEN 'r' ELSE 'l' END AS main FROM m JOIN pg USING (page_id)),
b AS (SELECT *, count(no) OVER (PARTITION BY page_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS block FROM q WHERE side = main),
k AS (SELECT page_id, block, arg_min(y0, ord) AS y0, arg_max(y1, ord) AS y1, max(no) AS no, string_agg(text, ' ' ORDER BY ord) AS own FROM b GROUP BY page_id, block),
hit AS (SELECT o.page_id, o.ord, any_value(o.text) AS text, min(k.block) AS block FROM q o JOIN k ON o.page_id = k.page_id AND o.side <> o.main
  AND (o.y0 + o.y1) / 2 >= k.y0 - 12 * 0.9::DOUBLE AND (o.y0 + o.y1) / 2 <= k.y1 + 12 * 0.9::DOUBLE GROUP BY 1, 2),
bound AS (SELECT page_id, block, string_agg(text, ' ' ORDER BY ord) AS theirs, count(*) AS n FROM hit GROUP BY 1, 2),
parts AS (SELECT k.page_id, k.block, n, CASE WHEN no > 0 THEN no || '. ' ELSE '' END AS label, concat_ws(chr(10), CASE WHEN theirs IS NOT NULL THEN label || theirs END, label || own) AS part
  FROM k LEFT JOIN bound ON bound.page_id = k.page_id AND bound.block = k.block),
t AS (SELECT page_id, string_agg(part, chr(10) ORDER BY block) AS text, count(*) AS blocks, sum(coalesce(n, 0)) AS bound FROM parts GROUP BY page_id)
SELECT page_id, CASE WHEN l + r > 0 AND n_l > 0 AND n_r > 0 AND blocks >= 2 AND bound >= ceil(CASE WHEN r >= l THEN n_l ELSE n_r END * 0.25) THEN text END AS text FROM pg LEFT JOIN t USING (page_id)""")
def bound_columns(spark, sf_dir):
    """Columns bound by height: three of four lines on the left are numbered, those on the right stand up to six units off."""
    k = F.floor(F.col("pos") / 2)
    left = F.col("pos") % 2 == 0
    text = F.when(left & (k % 4 != 3), F.concat((k + 1).cast("string"), F.lit(". "), "line")).otherwise(F.col("line"))
    y0 = 20.0 * k + F.when(left, 0).otherwise((F.col("pos") % 5) * 3 - 6)
    rows = _lines(spark, sf_dir).select("page_id", F.when(left, "l").otherwise("r").alias("side"), k.cast("int").alias("ord"), text.alias("text"), y0.alias("y0"), (y0 + 12).alias("y1"))
    return sequence.bind_columns(rows)


@query(rf"""WITH {_LINES},
c AS (SELECT page_id, pos % 2 AS side, pos // 2 AS ord, CASE WHEN pos % 2 = 0 OR page_id % 3 = 0 THEN (pos // 2 + 1) || '. ' || line ELSE line END AS text FROM lines WHERE line <> ''),
w AS (SELECT page_id, coalesce(string_agg(text, chr(10) ORDER BY ord) FILTER (side = 0), '') AS left_text, coalesce(string_agg(text, chr(10) ORDER BY ord) FILTER (side = 1), '') AS right_text FROM c GROUP BY page_id),
o AS (SELECT *, regexp_extract(text, '^\s*(?:[Qq](?:uestion)?[\s.:#-]*)?([0-9]{{1,3}})\s*[).:\-]', 1) AS no FROM c),
b AS (SELECT *, sum(CASE WHEN no <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, side ORDER BY ord ROWS UNBOUNDED PRECEDING) AS block FROM o),
k AS (SELECT page_id, side, block, max(CASE WHEN no <> '' THEN no::INT END) AS no, trim(regexp_replace(string_agg(text, ' ' ORDER BY ord), '^\s*[0-9]{{1,3}}\s*[).:\-]\s*', '')) AS text FROM b GROUP BY 1, 2, 3),
s AS (SELECT page_id, list({{'no': no, 'text': text}} ORDER BY block) FILTER (side = 0) AS a, list({{'no': no, 'text': text}} ORDER BY block) FILTER (side = 1) AS b FROM k WHERE length(text) > 1 GROUP BY page_id),
f AS (SELECT *, len(list_filter(a, lambda x: x.no > 0)) AS ca, len(list_filter(b, lambda x: x.no > 0)) AS cb, CASE WHEN ca >= cb THEN a ELSE b END AS mine, CASE WHEN ca >= cb THEN b ELSE a END AS other FROM s),
z AS (SELECT page_id, array_to_string(list_transform(range(1, len(mine) + 1), lambda i: concat(CASE WHEN mine[i].no > 0 THEN mine[i].no || '. ' ELSE '' END, other[i].text, chr(10), CASE WHEN mine[i].no > 0 THEN mine[i].no || '. ' ELSE '' END, mine[i].text)), chr(10)) AS text
  FROM f WHERE len(a) = len(b) AND len(a) > 0 AND ca + cb > 0)
SELECT w.page_id, coalesce(z.text, left_text || chr(10) || right_text) AS text FROM w LEFT JOIN z ON z.page_id = w.page_id""")
def zipped_columns(spark, sf_dir):
    """Columns bound by their order: the left is numbered throughout, the right on every third page."""
    k = F.floor(F.col("pos") / 2)
    left = F.col("pos") % 2 == 0
    text = F.when(left | (F.col("page_id") % 3 == 0), F.concat((k + 1).cast("string"), F.lit(". "), "line")).otherwise(F.col("line"))
    lines = _lines(spark, sf_dir).select("page_id", left.alias("left"), F.struct(k.alias("k"), text.alias("text")).alias("l"))
    of = lambda side: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(side, F.col("l")))), lambda x: x["text"]), "\n")
    return sequence.zip_texts(lines.groupBy("page_id").agg(of(F.col("left")).alias("left"), of(~F.col("left")).alias("right")))
