"""Queries over pictures and places: each vector is a picture of 8 x 8 cells, each text a page of lines."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.functions import text as X
from quillmatch.operators import chains, combs, leaders, masks, regions, scans

from .derived import table
from .registry import query

SIDE, BOX = 8, 4
_HALF = SIDE // BOX
#: The cells of a picture shrunk to 4 x 4, as SQL over the vector.
_BITS = " || ".join(
    f"CASE WHEN {' + '.join(f'embedding[{(y * _HALF + j) * SIDE + x * _HALF + i + 1}]::DOUBLE' for j in range(_HALF) for i in range(_HALF))} > 0 THEN '1' ELSE '0' END" for y in range(BOX) for x in range(BOX)
)


@query(f"""WITH RECURSIVE all_glyphs AS (SELECT label AS key, vec_id AS ord, CASE WHEN len(embedding) = 64 THEN {_BITS} END AS bits FROM embeddings),
g AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord, bits) AS i FROM all_glyphs WHERE key IS NOT NULL AND ord IS NOT NULL AND bits IS NOT NULL),
run AS (
  SELECT key, i, ord, ord AS leader, 0 AS apart, [{{'o': ord, 'b': bits}}] AS known FROM g WHERE i = 1
  UNION ALL
  SELECT key, i, ord, CASE WHEN best.d <= 2 THEN best.o ELSE ord END, (CASE WHEN best.d <= 2 THEN best.d ELSE 0 END)::INT,
         CASE WHEN best.d <= 2 THEN known ELSE list_append(known, {{'o': ord, 'b': bits}}) END
  FROM (SELECT g.*, r.known, list_sort(list_transform(r.known, lambda x: {{'d': hamming(x.b, g.bits), 'o': x.o}}))[1] AS best FROM run r JOIN g ON g.key = r.key AND g.i = r.i + 1)),
n AS (SELECT key, count(DISTINCT leader)::INT AS leaders FROM run GROUP BY key)
SELECT run.key, run.ord, run.leader, run.apart, n.leaders FROM run JOIN n ON n.key = run.key
UNION ALL SELECT key, ord, NULL, NULL, NULL FROM all_glyphs WHERE key IS NULL OR ord IS NULL OR bits IS NULL""")
def glyph_clusters(spark, sf_dir):
    """Leader clusters of the pictures of each label, shrunk to 4 x 4 black and white cells, which may differ in 2 of 16."""
    rows = table(spark, sf_dir, "embeddings")
    bits = F.when(F.size("embedding") == SIDE * SIDE, leaders.shrunk(F.col("embedding"), SIDE, BOX))
    return leaders.glyph_leaders(rows.select(F.col("label").alias("key"), F.col("vec_id").alias("ord"), bits.alias("bits")), BOX * BOX, 0.15)


_DARK = "dark AS (SELECT vec_id AS page_id, unnest(range(0, len(embedding)))::INT AS c, unnest(embedding) AS v FROM embeddings WHERE vec_id IS NOT NULL)"


@query(f"""WITH RECURSIVE {_DARK},
d AS (SELECT page_id, c FROM dark WHERE v > 0),
links AS (SELECT a.page_id, a.c AS a, b.c AS b FROM d a JOIN d b ON a.page_id = b.page_id AND abs(a.c // 8 - b.c // 8) + abs(a.c % 8 - b.c % 8) = 1),
reach AS (SELECT page_id, c AS a, c AS b FROM d UNION SELECT r.page_id, r.a, l.b FROM reach r JOIN links l ON l.page_id = r.page_id AND l.a = r.b),
root AS (SELECT page_id, a AS c, min(b) AS root FROM reach GROUP BY 1, 2),
k AS (SELECT r.*, NOT EXISTS (SELECT 1 FROM d WHERE d.page_id = r.page_id AND d.c = r.c - 1 AND r.c % 8 > 0) AS opens FROM root r)
SELECT page_id, (root // 8)::INT AS y0, (root % 8)::INT AS x_at_y0, count(*) AS cells, count(*) FILTER (opens) AS runs, max(c // 8)::INT AS y1, min(c % 8)::INT AS x0,
       max(c % 8)::INT AS x1, sum(c // 8)::BIGINT AS sum_y, sum(c % 8)::BIGINT AS sum_x FROM k GROUP BY page_id, root""")
def picture_regions(spark, sf_dir):
    """Regions of cells above nought that share a side, in every picture."""
    pictures = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"), "embedding")
    return regions.regions(regions.dark_cells(pictures, "embedding", SIDE), corners=False)


@query(f"""WITH {_DARK},
discs AS (SELECT DISTINCT page_id, item, option FROM dark, (SELECT unnest([0, 0, 1, 1]) AS item, unnest([0, 1, 0, 1]) AS option)),
f AS (SELECT s.page_id, item, option, count(*) FILTER (v > 0) / 12.0::DOUBLE AS fill FROM discs s JOIN dark k ON k.page_id = s.page_id
  AND (c // 8 - (1.5 + 4 * item)) ** 2 + (c % 8 - (1.5 + 4 * option)) ** 2 <= 1.6 * 1.6 GROUP BY ALL)
SELECT page_id, item, CASE WHEN max(fill) >= 0.45 THEN arg_max(option, fill * 1000 - option) END AS option, max(fill) AS fill FROM f GROUP BY page_id, item""")
def bubble_marks(spark, sf_dir):
    """Two items to a picture, upper and lower half, with two discs each: the fuller disc, where it is filled."""
    pictures = table(spark, sf_dir, "embeddings").where("vec_id is not null").select(F.col("vec_id").alias("page_id"), "embedding")
    spots = F.array(*[F.struct(F.lit(2 * i + o).alias("disc"), F.lit(1.5 + 4 * o).alias("cx"), F.lit(1.5 + 4 * i).alias("cy"), F.lit(1.6).alias("radius")) for i in (0, 1) for o in (0, 1)])
    discs = pictures.where("size(embedding) > 0").select("page_id").distinct().select("page_id", F.inline(spots))
    fills = regions.disc_fill(regions.dark_cells(pictures, "embedding", SIDE), discs, SIDE, SIDE)
    return regions.marked_option(fills.select("page_id", F.floor(F.col("disc") / 2).cast("int").alias("item"), (F.col("disc") % 2).cast("int").alias("option"), "fill"))


@query("""WITH RECURSIVE lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
placed AS (SELECT doc_id AS key, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS "at", length(line)::DOUBLE AS w FROM lines WHERE doc_id IS NOT NULL),
c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY "at") AS i, count(*) OVER (PARTITION BY key) AS n, max(w) OVER (PARTITION BY key) AS top FROM placed WHERE w > 0),
run AS (
  SELECT key, i, n, [{'i': i, 'at': "at", 's': w, 'p': 0::BIGINT, 'k': 0}] AS dp FROM c WHERE i = 1 AND n >= 3
  UNION ALL
  SELECT key, i, n, list_append(dp, CASE WHEN best.s < -w THEN {'i': i, 'at': "at", 's': -best.s, 'p': best.i, 'k': best.k} ELSE {'i': i, 'at': "at", 's': w, 'p': 0::BIGINT, 'k': 0} END)
  FROM (SELECT c.*, r.dp, list_sort(list_transform(list_filter(r.dp, lambda x: c."at" - x."at" BETWEEN 0.62::DOUBLE * 120 AND 2.4::DOUBLE * 120),
      lambda x: {'s': -(x.s + c.w - (abs(c."at" - x."at" - greatest(1, least(2, floor((c."at" - x."at") / 120 + 0.5::DOUBLE)::INT)) * 120.0::DOUBLE) / 120
        + 0.12::DOUBLE * (greatest(1, least(2, floor((c."at" - x."at") / 120 + 0.5::DOUBLE)::INT)) - 1)) * 0.6::DOUBLE * c.top), 'i': x.i, 'k': greatest(1, least(2, floor((c."at" - x."at") / 120 + 0.5::DOUBLE)::INT))}))[1] AS best
    FROM run r JOIN c ON c.key = r.key AND c.i = r.i + 1)),
whole AS (SELECT key, dp, list_sort(list_transform(dp, lambda x: {'s': -x.s, 'i': x.i}))[1] AS e FROM run WHERE i = n),
path AS (SELECT key, dp, -e.s AS score, e.i AS i FROM whole UNION ALL SELECT key, dp, score, dp[i].p FROM path WHERE dp[i].p > 0),
spots AS (SELECT key, score, dp[i]."at" AS "at", false AS made FROM path UNION ALL SELECT key, score, (dp[i]."at" + dp[dp[i].p]."at") / 2, true FROM path WHERE dp[i].k = 2)
SELECT key, row_number() OVER (PARTITION BY key ORDER BY "at")::INT AS seq, "at", made, round(score, 6) AS score FROM spots""")
def line_chains(spark, sf_dir):
    """In each document of three lines or more, the chain of line starts about 120 characters apart with most text on its lines."""
    lines = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").alias("key"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    before = F.sum(F.length("line") + 1).over(W.partitionBy("key").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    candidates = lines.select("key", F.coalesce(before, F.lit(0)).alias("at"), F.length("line").alias("weight")).where("weight > 0")
    return chains.best_chains(candidates, "120", 3).withColumn("score", F.round("score", 6))


_GREY = """g AS (SELECT page_id, c // 8 AS y, c % 8 AS x, floor((v::DOUBLE + 1) * 128)::BIGINT AS grey FROM dark WHERE v IS NOT NULL),
r AS (SELECT *, sum(grey) OVER w AS s1, count(*) OVER w AS n1 FROM g WINDOW w AS (PARTITION BY page_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
b AS (SELECT *, sum(s1) OVER w AS s, sum(n1) OVER w AS n FROM r WINDOW w AS (PARTITION BY page_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
p AS (SELECT page_id, list_sort(list(grey))[least(count(*) - 1, floor(count(*) * 0.75)::BIGINT) + 1] AS bright FROM g GROUP BY page_id),
ink AS (SELECT page_id, y, x, grey * 100 * n < s * 72 AS tight, grey * 100 * n < s * 80 AS light, grey * 100 * n < s * 84 AS print
  FROM b JOIN p USING (page_id) WHERE s * 10 > bright * 6 * n AND grey * 100 * n < s * 84)"""


def _grey(spark, sf_dir):
    """Pictures as cells of grey: -1 is black, 1 is white."""
    pictures = table(spark, sf_dir, "embeddings").where("vec_id is not null").select(F.col("vec_id").alias("page_id"), F.posexplode("embedding").alias("c", "v")).where("v is not null")
    return pictures.select("page_id", F.floor(F.col("c") / SIDE).cast("int").alias("y"), (F.col("c") % SIDE).alias("x"), F.floor((F.col("v").cast("double") + 1) * 128).alias("grey"))


@query(f"WITH {_DARK}, {_GREY} SELECT * FROM ink")
def local_ink(spark, sf_dir):
    """Cells of every picture that are darker than those around them."""
    return masks.ink(_grey(spark, sf_dir), 1)


@query(f"""WITH {_DARK}, {_GREY},
pts AS (SELECT page_id, y, x FROM ink WHERE page_id IN (SELECT page_id FROM ink GROUP BY 1 HAVING count(*) >= 4)),
h1 AS (SELECT page_id, t, floor(y + t::DOUBLE / 1000 * (x - 4.0::DOUBLE) + 100) AS bin, count(*) AS c FROM pts, (SELECT unnest(range(-90, 91, 10)) AS t) GROUP BY ALL),
s1 AS (SELECT page_id, t, sum(c * c)::DOUBLE / count(*) - (sum(c)::DOUBLE / count(*)) * (sum(c)::DOUBLE / count(*)) AS sc FROM h1 GROUP BY 1, 2),
b1 AS (SELECT page_id, t AS t1, sc AS c1 FROM s1 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY sc DESC, t) = 1),
h2 AS (SELECT page_id, t1 + d AS t, floor(y + (t1 + d)::DOUBLE / 1000 * (x - 4.0::DOUBLE) + 100) AS bin, count(*) AS c FROM pts JOIN b1 USING (page_id), (SELECT unnest(range(-9, 10, 2)) AS d) GROUP BY ALL),
s2 AS (SELECT page_id, t, sum(c * c)::DOUBLE / count(*) - (sum(c)::DOUBLE / count(*)) * (sum(c)::DOUBLE / count(*)) AS sc FROM h2 GROUP BY 1, 2),
b2 AS (SELECT page_id, t AS t2, sc AS c2 FROM s2 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY sc DESC, t) = 1),
e AS (SELECT page_id, CASE WHEN c2 > c1 THEN t2 ELSE t1 END AS t FROM b1 JOIN b2 USING (page_id))
SELECT page_id, (CASE WHEN abs(t) < 2 THEN 0 ELSE t END)::INT AS tilt FROM e""")
def picture_tilt(spark, sf_dir):
    """The tilt of the ink of every picture with four cells of it or more."""
    points = masks.ink(_grey(spark, sf_dir), 1)
    widths = table(spark, sf_dir, "embeddings").where("vec_id is not null").select(F.col("vec_id").alias("page_id"), F.lit(SIDE).alias("w")).distinct()
    return masks.tilts(points, widths, 4)


@query("""WITH n AS (SELECT p_partkey, p_type, concat('m', p_partkey % 7, '.', p_size, CASE WHEN p_partkey % 3 = 0 THEN '.' || (p_partkey % 11) ELSE '' END, CASE WHEN p_partkey % 5 = 0 THEN '-lite' ELSE '' END) AS name FROM part),
r AS (SELECT *, list_transform(regexp_extract_all(name, '([0-9]+)', 1), lambda x: x::INT) AS v, CASE WHEN name LIKE '%-lite%' THEN 0 ELSE 1 END AS plain FROM n)
SELECT p_type, p_partkey, name, row_number() OVER (PARTITION BY p_type ORDER BY v DESC, plain DESC, p_partkey)::INT AS place FROM r""")
def version_order(spark, sf_dir):
    """Models of each kind, the newest version first, plain ones before lite ones of the same version."""
    part = lambda c: F.col(c).cast("string")
    name = F.concat(F.lit("m"), (F.col("p_partkey") % 7).cast("string"), F.lit("."), part("p_size"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("."), (F.col("p_partkey") % 11).cast("string"))).otherwise(""), F.when(F.col("p_partkey") % 5 == 0, "-lite").otherwise(""))
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_type", name.alias("name"))
    order = W.partitionBy("p_type").orderBy(F.desc(X.version_key(F.col("name"))), F.contains("name", F.lit("-lite")), "p_partkey")
    return rows.select("p_type", "p_partkey", "name", F.row_number().over(order).alias("place"))


@query(f"""WITH {_DARK},
m AS (SELECT page_id, (c % 8 // 4)::INT AS block, c % 8 AS x, c // 8 AS y FROM dark WHERE v > 0.05::DOUBLE),
t AS (SELECT page_id, block, x, lean, 20000 * x - lean * (2 * y - 7) AS p FROM m, (SELECT unnest(range(-600, 1001, 25)) AS lean)),
g AS (SELECT *, least(p - lag(p) OVER (PARTITION BY page_id, block, lean ORDER BY p), 16000) AS gap FROM t),
k AS (SELECT page_id, block, lean, sum(gap) AS cost, count(*) AS n, sum(x) AS sx FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 6)
SELECT page_id, block, n, sx::DOUBLE / n AS mean_x, lean::INT AS lean FROM k QUALIFY row_number() OVER (PARTITION BY page_id, block ORDER BY cost, lean) = 1""")
def picture_leans(spark, sf_dir):
    """How the cells of the left and right half of every picture lean."""
    marks = _marks(spark, sf_dir).withColumn("block", F.floor(F.col("x") / 4).cast("int"))
    ends = table(spark, sf_dir, "embeddings").where("vec_id is not null").select(F.col("vec_id").alias("page_id"), F.lit(0).alias("y0"), F.lit(SIDE - 1).alias("y1")).distinct()
    return combs.leans(marks, ends, 2)


def _marks(spark, sf_dir):
    pictures = table(spark, sf_dir, "embeddings").where("vec_id is not null").select(F.col("vec_id").alias("page_id"), "embedding")
    return regions.dark_cells(pictures, "embedding", SIDE, F.col("v").cast("double") > 0.05)


@query(f"""WITH {_DARK},
m AS (SELECT page_id, (c % 8)::DOUBLE AS x FROM dark WHERE v > 0.05::DOUBLE),
prof AS (SELECT page_id, c % 8 AS x, count(*) FILTER (v > 0) AS v FROM dark GROUP BY 1, 2),
s AS (SELECT page_id, list_sort(list(x)) AS xs, count(*) AS n FROM m GROUP BY 1),
sp AS (SELECT page_id, n, CASE WHEN n >= 8 THEN xs[floor(0.1::DOUBLE * (n - 1))::INT + 1] ELSE xs[1] END AS low, CASE WHEN n >= 8 THEN xs[floor(0.9::DOUBLE * (n - 1))::INT + 1] ELSE xs[n] END AS high FROM s),
e AS (SELECT page_id, n, high, i * 4 + j AS turn, (0.72::DOUBLE + 0.04::DOUBLE * i) * 2 AS pitch, low - 1.55::DOUBLE * 2 + j * 1.5::DOUBLE AS first FROM sp, (SELECT unnest(range(19)) AS i), (SELECT unnest(range(4)) AS j)),
f AS (SELECT * FROM e WHERE first + 2 * pitch >= high - 1.35::DOUBLE * 2 AND first + 2 * pitch <= high + 1.35::DOUBLE * 2),
w AS (SELECT f.page_id, turn, floor(first + k * pitch - 0.18::DOUBLE * 2 + 0.5::DOUBLE) AS lo, floor(first + k * pitch + 0.18::DOUBLE * 2 + 0.5::DOUBLE) AS hi FROM f, (SELECT unnest(range(3)) AS k)),
ink AS (SELECT w.page_id, turn, sum(coalesce(v, 0)) AS ink FROM w LEFT JOIN prof p ON p.page_id = w.page_id AND p.x BETWEEN lo AND hi GROUP BY 1, 2),
met AS (SELECT f.page_id, turn, count(*) FILTER (abs(x - (first + greatest(0, least(2, floor((x - first) / pitch + 0.5::DOUBLE))) * pitch)) <= least(0.5::DOUBLE * pitch, 0.55::DOUBLE * 2)) AS explained FROM f JOIN m USING (page_id) GROUP BY 1, 2),
every AS (SELECT f.*, ink, explained, n - explained <= greatest(2, floor(0.25::DOUBLE * n + 0.5::DOUBLE)) AS fits FROM f JOIN ink USING (page_id, turn) JOIN met USING (page_id, turn)),
best AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY fits DESC, ink DESC, turn) = 1)
SELECT page_id, 0 AS block, round(first, 6) AS first, round(pitch, 6) AS pitch, ink::BIGINT AS ink, explained, n::INT AS n FROM best WHERE ink > 0""")
def picture_combs(spark, sf_dir):
    """The comb of three columns that fits the marks of every picture."""
    pictures = table(spark, sf_dir, "embeddings").where("vec_id is not null").select(F.col("vec_id").alias("page_id"), F.posexplode("embedding").alias("c", "v"))
    profile = pictures.groupBy("page_id", (F.col("c") % SIDE).alias("x")).agg(F.count_if(F.col("v") > 0).alias("v"))
    found = combs.combs(profile, _marks(spark, sf_dir).withColumn("block", F.lit(0)), 2.0, 3)
    return found.withColumn("first", F.round("first", 6)).withColumn("pitch", F.round("pitch", 6))


@query(f"""WITH {_DARK},
g AS (SELECT page_id, c // 8 AS y, c % 8 AS x, floor((v::DOUBLE + 1) * 128)::BIGINT AS grey FROM dark WHERE v IS NOT NULL),
q AS (SELECT page_id, list_sort(list(grey)) AS s, count(*) AS n FROM g GROUP BY 1),
t AS (SELECT page_id, s[least(n - 1, floor(n * 0.02::DOUBLE)::BIGINT) + 1] AS low, s[least(n - 1, floor(n * 0.98::DOUBLE)::BIGINT) + 1] AS high FROM q),
w AS (SELECT g.page_id, y, x, least(255.0::DOUBLE, greatest(0.0::DOUBLE, ((grey - low) * 255)::DOUBLE / greatest(40, high - low))) AS v FROM g JOIN t USING (page_id)),
n AS (SELECT *, coalesce(lag(v) OVER a, v) AS l, coalesce(lead(v) OVER a, v) AS r, coalesce(lag(v) OVER d, v) AS u, coalesce(lead(v) OVER d, v) AS b FROM w
  WINDOW a AS (PARTITION BY page_id, y ORDER BY x), d AS (PARTITION BY page_id, x ORDER BY y))
SELECT page_id, y::INT AS y, x::INT AS x, floor(least(255.0::DOUBLE, greatest(0.0::DOUBLE, v + 0.8::DOUBLE * (v - (4 * v + 2 * (u + b + l + r)) / 12))))::INT AS grey FROM n""")
def enhanced_pictures(spark, sf_dir):
    """Every picture with its grey stretched and sharpened."""
    return scans.enhanced(_grey(spark, sf_dir))
