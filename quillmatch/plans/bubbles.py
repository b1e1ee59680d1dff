"""Queries over bubble sheets: lines of text as printed rows, and sixteen pictures to a sheet as bubbles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmatch.operators import sheets

from .derived import table
from .registry import query

_SHIFTS = ", ".join(f"({i}, {a}::DOUBLE, {b}::DOUBLE)" for i, (a, b) in enumerate((a, b) for a in sheets.ASIDE for b in sheets.ABOVE))


@query("""WITH RECURSIVE lines AS (SELECT doc_id AS page_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT page_id, 20 * pos + length(line) % 5 AS p, (length(line) % 9)::DOUBLE AS ink FROM lines WHERE length(line) > 0),
h AS (SELECT page_id, 20 * (max(pos) + 1) AS h FROM lines GROUP BY 1),
d AS (SELECT page_id, p - lag(p) OVER (PARTITION BY page_id ORDER BY p) AS gap FROM t),
v AS (SELECT page_id, unnest(range(greatest(10, gap - 2), least(160, gap + 2) + 1)) AS pitch FROM d WHERE gap BETWEEN 8 AND 162),
m AS (SELECT page_id, pitch FROM (SELECT page_id, pitch, count(*) AS n FROM v GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, pitch) = 1 AND n >= 4),
g AS (SELECT t.*, pitch, p - lag(p) OVER (PARTITION BY t.page_id ORDER BY p) AS gap FROM t JOIN m USING (page_id)),
r AS (SELECT *, count(CASE WHEN gap > 1.45::DOUBLE * pitch THEN 1 END) OVER (PARTITION BY page_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM g),
b AS (SELECT r.page_id, run, count(*) AS n, min(p) AS first, max(p) AS last, any_value(h) AS h FROM r JOIN h USING (page_id) GROUP BY 1, 2),
big AS (SELECT page_id, run FROM b QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, abs(first + last - h), first) = 1 AND n >= 5),
c AS (SELECT r.page_id, r.p::DOUBLE AS p, ink, row_number() OVER (PARTITION BY page_id ORDER BY p) AS i, count(*) OVER (PARTITION BY page_id) AS n, p - lag(p) OVER (PARTITION BY page_id ORDER BY p) AS gap FROM r JOIN big USING (page_id, run)),
pt AS (SELECT page_id, list_sort(list(gap))[floor(count(*) / 2)::INT + 1]::DOUBLE AS pitch FROM c WHERE gap IS NOT NULL GROUP BY page_id HAVING pitch >= 8),
run AS (
  SELECT c.page_id, i, n, pitch, [{'p': p, 'ink': ink, 'made': false}] AS rows FROM c JOIN pt USING (page_id) WHERE i = 1
  UNION ALL
  SELECT page_id, i, n, pitch, CASE WHEN k < 1 THEN CASE WHEN ink > rows[-1].ink THEN list_append(rows[:-2], {'p': p, 'ink': ink, 'made': false}) ELSE rows END
    WHEN abs(p - rows[-1].p - k * pitch) > 0.32::DOUBLE * pitch THEN rows
    ELSE list_append(list_concat(rows, list_transform(range(1, k), lambda j: {'p': rows[-1].p + (p - rows[-1].p) * j / k, 'ink': 0::DOUBLE, 'made': true})), {'p': p, 'ink': ink, 'made': false}) END
  FROM (SELECT c.page_id, c.i, c.n, c.p, c.ink, u.pitch, u.rows, floor((c.p - u.rows[-1].p) / u.pitch + 0.5::DOUBLE)::BIGINT AS k FROM run u JOIN c ON c.page_id = u.page_id AND c.i = u.i + 1)),
o AS (SELECT page_id, pitch, generate_subscripts(rows, 1) AS seq, unnest(rows) AS r FROM run WHERE i = n AND len(rows) >= 5)
SELECT page_id, seq::INT AS seq, round(r.p, 6) AS "at", r.made AS made, pitch FROM o""")
def row_lattices(spark, sf_dir):
    """Lines of each document as rows printed twenty units apart, up to four units off, blank ones without ink."""
    lines = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    heights = lines.groupBy("page_id").agg((20 * (F.max("pos") + 1)).alias("h"))
    size = F.length("line")
    tops = lines.where(size > 0).select("page_id", (20 * F.col("pos") + size % 5).alias("at"), (size % 9).cast("double").alias("ink"))
    return sheets.row_lattice(tops, heights).withColumn("at", F.round("at", 6))


@query(f"""WITH cells AS (SELECT vec_id // 16 AS page_id, vec_id % 16 AS k, unnest(range(0, len(embedding))) AS c, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE vec_id IS NOT NULL),
g AS (SELECT page_id, (k // 4) * 8 + c // 8 AS y, (k % 4) * 8 + c % 8 AS x, v FROM cells),
grid AS (SELECT page_id, y, x FROM (SELECT DISTINCT page_id FROM g), (SELECT unnest(range(32)) AS y), (SELECT unnest(range(32)) AS x)),
ink AS (SELECT grid.*, coalesce(max(v) > 0.06::DOUBLE, false) AS t, coalesce(max(v) > 0, false) AS l FROM grid LEFT JOIN g USING (page_id, y, x) GROUP BY ALL),
discs AS (SELECT no, option, s, floor(8 * option + 3.5::DOUBLE + a * 8 + 0.5::DOUBLE) AS cx, floor(8 * no + 3.5::DOUBLE + b * 8 + 0.5::DOUBLE) AS cy
  FROM (SELECT unnest(range(4)) AS no), (SELECT unnest(range(4)) AS option), (VALUES {_SHIFTS}) AS q(s, a, b)),
f AS (SELECT page_id, no, option, s, count(*) FILTER (t)::DOUBLE / count(*) AS t, count(*) FILTER (l)::DOUBLE / count(*) AS l FROM discs JOIN ink ON (y - cy) * (y - cy) + (x - cx) * (x - cx) <= 16 GROUP BY 1, 2, 3, 4),
o AS (SELECT page_id, no, option, max(t) AS t, max(l) AS l FROM f GROUP BY 1, 2, 3),
b AS (SELECT page_id, no, max(t) AS tight, max(l) AS loose, first(option ORDER BY t DESC, option) AS ot, first(option ORDER BY l DESC, option) AS ol FROM o GROUP BY 1, 2)
SELECT page_id, no::INT AS no, (CASE WHEN tight >= 0.40 THEN ot WHEN loose >= 0.75 THEN ol END)::INT AS option, tight, loose FROM b""")
def sheet_marks(spark, sf_dir):
    """Sixteen pictures to a sheet, in four rows of four: each row is an item, each picture a bubble, and its brighter cells are ink."""
    rows = table(spark, sf_dir, "embeddings").where("vec_id is not null").select(F.floor(F.col("vec_id") / 16).alias("page_id"), (F.col("vec_id") % 16).alias("k"), F.posexplode("embedding").alias("c", "v"))
    place = lambda k, c: ((k * 8 + c).cast("int"))
    cells = rows.select("page_id", place(F.floor(F.col("k") / 4), F.floor(F.col("c") / 8)).alias("y"), place(F.col("k") % 4, F.col("c") % 8).alias("x"), F.col("v").cast("double").alias("v"))
    spots = F.array(*[F.struct(F.lit(no).alias("no"), F.lit(o).alias("option"), F.lit(8 * o + 3.5).alias("cx"), F.lit(8 * no + 3.5).alias("cy"), F.lit(8.0).alias("pitch")) for no in range(4) for o in range(4)])
    bubbles = cells.select("page_id").distinct().select("page_id", F.inline(spots))
    return sheets.disc_marks(cells.where("v > 0.06D"), cells.where("v > 0"), bubbles, 32, 32)
