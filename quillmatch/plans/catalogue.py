"""The queries of the library, each over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmatch.functions import text as X
from quillmatch.functions.numbers import round_half_away
from quillmatch.operators import analyze, assemble, bilingual, match, parse, score, sequence

from .derived import benchmark_pair, line_items, match_benchmark, parts, scored_rows, table
from .registry import ORACLES, QUERIES, query  # noqa: F401

ITEMS = """WITH items AS (
  SELECT l_orderkey AS match_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INT AS no,
         chr((65 + l_suppkey % 4)::INT) AS key, CASE WHEN l_returnflag = 'R' THEN '' ELSE chr((65 + l_partkey % 4)::INT) END AS mine,
         NOT (l_returnflag = 'A' AND l_linestatus = 'F') AS has_key
  FROM lineitem),
rows AS (
  SELECT match_id, no AS p_idx, no, CASE WHEN has_key THEN no END AS key_no, CASE WHEN has_key THEN key ELSE '' END AS correct, mine,
         CASE WHEN NOT has_key THEN 'unmatched' WHEN mine = '' THEN 'blank' WHEN mine = key THEN 'correct' ELSE 'wrong' END AS state,
         CASE WHEN has_key THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence, CASE WHEN has_key THEN 'same-number' ELSE '' END AS method
  FROM items)"""
TOTALS = """, counts AS (
  SELECT match_id, count(*) AS total, count(*) FILTER (state = 'correct') AS correct, count(*) FILTER (state = 'wrong') AS wrong,
         count(*) FILTER (state = 'blank') AS blank, count(*) FILTER (state = 'unmatched') AS unmatched FROM rows GROUP BY match_id),
totals AS (
  SELECT match_id, total, correct, wrong, blank, unmatched, floor((correct - wrong * 0.25::DOUBLE) * 100 + 0.5) / 100 AS score, total::DOUBLE AS max,
         total - unmatched AS matched, floor((correct - wrong * 0.25::DOUBLE) / total * 100 * 10 + 0.5) / 10 AS percent FROM counts)"""
NORMAL = r"""trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\(?\s*[0-9]{{1,3}}\s*[).:]\s*', ' ', 'g'), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'))"""


def normal(column: str) -> str:
    return NORMAL.format(column)


STOP = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(X.STOP_WORDS)) + "]"


def listed(column: str) -> str:
    return f"list_filter(string_split({normal(column)}, ' '), lambda w: length(w) >= 2 AND NOT list_contains({STOP}, w))"


@query(ITEMS + TOTALS + " SELECT * FROM totals")
def score_by_paper(spark, sf_dir):
    return score.totals(scored_rows(spark, sf_dir), wrong=-0.25)


@query(ITEMS + " SELECT * FROM rows")
def result_rows(spark, sf_dir):
    return scored_rows(spark, sf_dir)


@query(ITEMS + " SELECT p.match_id, p.no AS p_idx, k.no AS k_idx, 0.5::DOUBLE AS confidence, 'offset' AS method FROM items p JOIN items k ON p.match_id = k.match_id AND p.no + 1 = k.no AND k.has_key")
def offset_match(spark, sf_dir):
    paper, keys, _ = parts(line_items(spark, sf_dir))
    return match.by_offset(paper, keys, 1)


@query("""WITH raw AS (SELECT l_orderkey AS match_id, l_linenumber AS no, chr((65 + l_partkey % 4)::INT) AS mine, chr((65 + l_suppkey % 4)::INT) AS correct,
                l_partkey * 100000 + l_suppkey AS ord, l_returnflag FROM lineitem),
m AS (SELECT match_id, no, arg_max(mine, ord) AS mine FROM raw WHERE l_returnflag <> 'R' GROUP BY ALL),
k AS (SELECT match_id, no, arg_max(correct, ord) AS correct FROM raw WHERE l_returnflag <> 'A' GROUP BY ALL),
n AS (SELECT match_id, max(no) AS n FROM (SELECT match_id, no FROM m UNION ALL SELECT match_id, no FROM k) GROUP BY match_id),
d AS (SELECT match_id, unnest(range(1, n + 1))::INT AS no FROM n)
SELECT d.match_id, d.no, m.mine, k.correct FROM d LEFT JOIN m USING (match_id, no) LEFT JOIN k USING (match_id, no)""")
def dense_result(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("match_id"), F.col("l_linenumber").alias("no"), F.char(65 + F.col("l_partkey") % 4).alias("mine"), F.char(65 + F.col("l_suppkey") % 4).alias("correct"),
        (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("ord"), "l_returnflag",
    )
    marks = rows.where("l_returnflag <> 'R'").select("match_id", "no", F.col("mine").alias("answer"), "ord")
    key = rows.where("l_returnflag <> 'A'").select("match_id", "no", F.col("correct").alias("answer"), "ord")
    return match.dense(marks, key)


OVERRIDDEN = """, overrides AS (SELECT match_id, p_idx, CASE WHEN no % 2 = 0 THEN '' ELSE chr((65 + match_id % 4)::INT) END AS override FROM rows WHERE match_id % 10 = 0),
changed AS (
  SELECT r.match_id, r.p_idx, r.no, r.key_no, coalesce(o.override, r.correct) AS correct, r.mine, r.confidence, r.method,
         CASE WHEN o.override IS NULL THEN state WHEN o.override = '' OR mine = '' THEN 'blank' WHEN o.override = mine THEN 'correct' ELSE 'wrong' END AS state
  FROM rows r LEFT JOIN overrides o USING (match_id, p_idx))"""


@query(ITEMS + OVERRIDDEN + TOTALS.replace("FROM rows", "FROM changed") + " SELECT * FROM totals")
def override_rescore(spark, sf_dir):
    rows = scored_rows(spark, sf_dir)
    anew = rows.where("match_id % 10 = 0").select("match_id", "p_idx", F.when(F.col("no") % 2 == 0, "").otherwise(F.char(65 + F.col("match_id") % 4)).alias("override"))
    return score.totals(score.overridden(rows, anew), wrong=0.25)


def _subject_sql() -> str:
    cases = " ".join(f"WHEN regexp_matches(text, '{p}', 'i') THEN '{n}'" for n, p in analyze.BUCKETS)
    return f"""SELECT source AS match_id, CASE {cases} ELSE 'Other' END AS subject, count(*) AS total, count(*) FILTER (n_chars % 2 = 0) AS correct,
        floor(100 * count(*) FILTER (n_chars % 2 = 0) / count(*) + 0.5)::DOUBLE AS percent FROM documents GROUP BY 1, 2"""


@query(_subject_sql())
def subject_rollup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("source").alias("match_id"), F.col("text").alias("question"), F.when(F.col("n_chars") % 2 == 0, "correct").otherwise("wrong").alias("state"))
    return analyze.subjects(rows).withColumn("percent", F.col("percent").cast("double"))


@query(ITEMS + TOTALS + """ SELECT match_id, CASE WHEN correct + wrong > 0 THEN floor(100 * correct / (correct + wrong) + 0.5)::DOUBLE ELSE 0.0 END AS accuracy,
  CASE WHEN max > 0 THEN floor(100 * score / max + 0.5)::DOUBLE ELSE 0.0 END AS percent FROM totals""")
def accuracy_headline(spark, sf_dir):
    out = analyze.headline(score.totals(scored_rows(spark, sf_dir), wrong=0.25))
    return out.select("match_id", F.col("accuracy").cast("double").alias("accuracy"), F.col("percent").cast("double").alias("percent"))


@query(ITEMS + " SELECT match_id, no, correct, mine, state FROM rows WHERE state IN ('wrong', 'blank')")
def wrong_list(spark, sf_dir):
    return analyze.wrong_list(scored_rows(spark, sf_dir)).select("match_id", "no", "correct", "mine", "state")


@query("""WITH k AS (SELECT source, doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k,
  count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source AS match_id, doc_id, CASE WHEN length(t) > 90 THEN substr(t, 1, 90) || '…' ELSE t END AS preview FROM k
WHERE k > (least(2, ceil(n / 25)) - 1) * 25 AND k <= least(2, ceil(n / 25)) * 25""")
def page_slice(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("match_id"), "doc_id", F.col("text").alias("question"))
    return analyze.short_list(analyze.page(rows, ["doc_id"], 2)).select("match_id", "doc_id", "preview")


@query(f"SELECT doc_id, {normal('text')} AS normal FROM documents")
def normalized_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.normalize(F.col("text")).alias("normal"))


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {listed('text')} AS t FROM documents)")
def token_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(f"""WITH t AS (SELECT item_id, replace({normal('text')}, ' ', '') AS t FROM benchmark)
SELECT item_id, len(list_distinct(list_transform(range(1, greatest(length(t), 1)), lambda i: substr(t, i, 2)))) AS n_bigrams FROM t""")
def bigram_counts(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(X.bigrams(F.col("text"))).cast("long").alias("n_bigrams"))


@query(r"""WITH c AS (SELECT doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS lat, length(regexp_replace(text, '[^\x{0900}-\x{097F}]', '', 'g')) AS dev FROM documents)
SELECT doc_id, CASE WHEN dev > lat THEN 'hi' ELSE 'en' END AS script, CASE WHEN lat + dev > 0 THEN lat::DOUBLE / (lat + dev) ELSE 0.0::DOUBLE END AS latin_share FROM c""")
def script_profile(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.script(F.col("text")).alias("script"), X.latin_share(F.col("text")).alias("latin_share"))


PAIR = f"""WITH n AS (SELECT item_id, text, count(*) OVER () AS n FROM benchmark),
p AS (SELECT item_id AS p_idx, {listed('text')} AS t, replace({normal('text')}, ' ', '') AS b FROM n),
k AS (SELECT (7 * item_id + 3) % n AS k_idx, {listed('substr(text, 1, (length(text) * 3 // 4)::INT)')} AS t, replace({normal('substr(text, 1, (length(text) * 3 // 4)::INT)')}, ' ', '') AS b FROM n),
pt AS (SELECT DISTINCT p_idx, unnest(t) AS w FROM p), kt AS (SELECT DISTINCT k_idx, unnest(t) AS w FROM k),
shared AS (SELECT p_idx, k_idx, count(*) AS c FROM pt JOIN kt USING (w) GROUP BY ALL),
pb AS (SELECT p_idx, len(t) AS len, len(list_distinct(t)) AS tok, list_distinct(list_transform(range(1, greatest(length(b), 1)), lambda i: substr(b, i, 2))) AS bg FROM p),
kb AS (SELECT k_idx, len(t) AS len, len(list_distinct(t)) AS tok, list_distinct(list_transform(range(1, greatest(length(b), 1)), lambda i: substr(b, i, 2))) AS bg FROM k),
scored AS (
  SELECT p_idx, k_idx, (0.7 * c / least(p.tok, k.tok) + 0.3 * CASE WHEN least(len(p.bg), len(k.bg)) > 0 THEN 2 * len(list_intersect(p.bg, k.bg)) / (len(p.bg) + len(k.bg)) ELSE 0 END)
    * (0.72 + 0.28 * least(p.len, k.len) / greatest(p.len, k.len, 1)) * CASE WHEN least(p.len, k.len) < 3 THEN 0.82 ELSE 1.0 END AS s
  FROM shared JOIN pb p USING (p_idx) JOIN kb k USING (k_idx))"""


@query(PAIR + " SELECT 1 AS match_id, p_idx, k_idx FROM shared")
def candidate_pairs(spark, sf_dir):
    paper, keys = benchmark_pair(spark, sf_dir)
    return match.candidate_pairs(match.signatures(paper, "p_idx"), match.signatures(keys, "k_idx"))


@query(PAIR + " SELECT 1 AS match_id, p_idx, k_idx, round(s, 6) AS s FROM scored WHERE s >= 0.42")
def content_scores(spark, sf_dir):
    paper, keys = benchmark_pair(spark, sf_dir)
    return match.content_scores(match.signatures(paper, "p_idx"), match.signatures(keys, "k_idx")).withColumn("s", F.round("s", 6))


_SHARE = "CASE WHEN least(len({0}), len({1})) > 0 THEN len(list_intersect({0}, {1})) / least(len({0}), len({1})) ELSE 0 END"
_PAIRS_OF = "list_distinct(list_transform(range(1, greatest(length(b), 1)), lambda i: substr(b, i, 2)))"


@query(f"""WITH n AS (SELECT item_id, text, count(*) OVER () AS n, (length(text) // 2)::INT AS h FROM benchmark),
v AS (SELECT item_id AS p_idx, substr(text, 1, h) AS t, substr(text, h + 1) AS o FROM n UNION ALL SELECT item_id, text, '' FROM n),
p AS (SELECT p_idx, {listed('t')} AS l, list_distinct({listed('t')}) AS tok, list_distinct(list_concat({listed('t')}, {listed('o')})) AS wide, replace({normal('t')}, ' ', '') AS b FROM v),
c AS (SELECT (7 * item_id + 3) % n AS k_idx, substr(text, 1, (length(text) * 3 // 4)::INT) AS t FROM n),
k AS (SELECT k_idx, {listed('t')} AS l, list_distinct({listed('t')}) AS tok, replace({normal('t')}, ' ', '') AS b FROM c),
pb AS (SELECT *, {_PAIRS_OF} AS bg FROM p), kb AS (SELECT *, {_PAIRS_OF} AS bg FROM k),
s AS (SELECT p_idx, k_idx, (0.46 * {_SHARE.format('p.tok', 'k.tok')} + 0.24 * {_SHARE.format('p.wide', 'k.tok')}
    + 0.3 * CASE WHEN least(len(p.bg), len(k.bg)) > 0 THEN 2 * len(list_intersect(p.bg, k.bg)) / (len(p.bg) + len(k.bg)) ELSE 0 END)
    * (0.72 + 0.28 * least(len(p.l), len(k.l)) / greatest(len(p.l), len(k.l), 1)) * CASE WHEN least(len(p.l), len(k.l)) < 3 THEN 0.82 ELSE 1.0 END AS s FROM pb p CROSS JOIN kb k)
SELECT 1 AS match_id, p_idx, k_idx, round(max(s), 6) AS s FROM s GROUP BY p_idx, k_idx HAVING max(s) >= 0.42""")
def variant_scores(spark, sf_dir):
    """Scores where a question has options and a second language variant: here the halves of an item, and the whole of it."""
    paper, keys = benchmark_pair(spark, sf_dir)
    half = (F.length("text") / 2).cast("int")
    paper = paper.select(
        "match_id", "p_idx", "no", F.substring("text", F.lit(1), half).alias("text"), F.array(F.substring("text", half + 1, F.length("text"))).alias("options"),
        F.col("text").alias("alt"), F.array().cast("array<string>").alias("alt_options"),
    )
    return match.content_scores(match.signatures(paper, "p_idx"), match.signatures(keys, "k_idx")).withColumn("s", F.round("s", 6))


def _assigned_sql(name: str, threshold: float, rounds: int = 12) -> str:
    """CTEs up to `name`: greedy assignment as rounds of pairs that come first on both sides, then what is left by position.

    What would need more rounds is missing there.
    """
    first = lambda side: f"row_number() OVER (PARTITION BY {side} ORDER BY s DESC, p_idx, k_idx)"
    r, b = (lambda i: f"{name}_r{i}"), (lambda i: f"{name}_b{i}")
    steps = [f"{r(0)} AS MATERIALIZED (SELECT p_idx, k_idx, s FROM scored WHERE s >= {threshold})"]
    for i in range(rounds):
        steps.append(f"{b(i)} AS MATERIALIZED (SELECT p_idx, k_idx, s FROM (SELECT *, {first('p_idx')} AS a, {first('k_idx')} AS b FROM {r(i)}) WHERE a = 1 AND b = 1)")
        steps.append(f"{r(i + 1)} AS MATERIALIZED (SELECT * FROM {r(i)} WHERE p_idx NOT IN (SELECT p_idx FROM {b(i)}) AND k_idx NOT IN (SELECT k_idx FROM {b(i)}))")
    steps.append(f"{name}_found AS MATERIALIZED ({' UNION ALL '.join(f'SELECT * FROM {b(i)}' for i in range(rounds))})")
    for side in ("p", "k"):
        left = f"SELECT {side}_idx FROM {side}b WHERE {side}_idx NOT IN (SELECT {side}_idx FROM {name}_found)"
        steps.append(f"{name}_{side} AS (SELECT {side}_idx, row_number() OVER (ORDER BY {side}_idx) AS r, count(*) OVER () AS n FROM ({left}))")
    steps.append(f"""{name} AS MATERIALIZED (SELECT 1 AS match_id, p_idx, k_idx, round(s, 6) AS confidence, 'content' AS method FROM {name}_found
UNION ALL SELECT 1, p_idx, k_idx, 0.3::DOUBLE, 'position' FROM {name}_p JOIN {name}_k USING (r, n) WHERE n <= greatest(3, 0.25 * (SELECT count(*) FROM pb)))""")
    return ", ".join(steps)


def _ladder_sql() -> str:
    """The rungs one after the other; here pairs without a common token are scored as well, for the lowest rung can take them."""
    every = PAIR.replace("0.7 * c /", "0.7 * coalesce(c, 0) /").replace("FROM shared JOIN pb p USING (p_idx) JOIN kb k USING (k_idx))", "FROM pb p CROSS JOIN kb k LEFT JOIN shared USING (p_idx, k_idx))")
    every = every.replace("least(p.tok, k.tok)", "greatest(least(p.tok, k.tok), 1)")
    rungs = ", ".join(_assigned_sql(f"rung{i}", t) for i, t in enumerate(match.LADDER))
    rows = " UNION ALL ".join(f"SELECT {i} AS rung, * FROM rung{i}" for i in range(len(match.LADDER)))
    return f"""{every}, {rungs}, runs AS ({rows}), counts AS (SELECT rung, count(*) FILTER (method = 'content') AS n FROM runs GROUP BY rung),
best AS (SELECT coalesce(min(CASE WHEN n >= {match.COVERED} * (SELECT count(*) FROM pb) THEN rung END), arg_min(rung, (-n, rung))) AS rung FROM counts)
SELECT match_id, p_idx, k_idx, confidence, method FROM runs WHERE rung = (SELECT rung FROM best)"""


@query(PAIR + ", " + _assigned_sql("assigned", match.THRESHOLD) + " SELECT * FROM assigned")
def greedy_match(spark, sf_dir):
    return match_benchmark(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))


@query(_ladder_sql())
def threshold_ladder(spark, sf_dir):
    return match.ladder(*benchmark_pair(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query("""WITH o AS (SELECT o_custkey AS match_id, o_orderkey AS idx, o_orderstatus AS st FROM orders),
p AS (SELECT match_id, idx, row_number() OVER (PARTITION BY match_id ORDER BY idx) AS r, count(*) OVER (PARTITION BY match_id) AS n FROM o WHERE st = 'O'),
k AS (SELECT match_id, idx, row_number() OVER (PARTITION BY match_id ORDER BY idx) AS r, count(*) OVER (PARTITION BY match_id) AS n FROM o WHERE st = 'F'),
sizes AS (SELECT match_id, count(*) AS size FROM o WHERE st <> 'F' GROUP BY 1)
SELECT match_id, p.idx AS p_idx, k.idx AS k_idx, 0.3::DOUBLE AS confidence, 'position' AS method FROM p JOIN k USING (match_id, r, n) JOIN sizes USING (match_id)
WHERE n <= greatest(3, 0.25 * size)""")
def position_fallback(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("match_id"), F.col("o_orderkey").alias("p_idx"), F.col("o_orderkey").alias("k_idx"), "o_orderstatus")
    paper, keys = rows.where("o_orderstatus <> 'F'").select("match_id", "p_idx"), rows.where("o_orderstatus = 'F'").select("match_id", "k_idx")
    taken = rows.where("o_orderstatus = 'P'").select("match_id", "p_idx", F.lit(None).cast("long").alias("k_idx"))
    return match.position_fallback(paper, keys, taken)


@query("""SELECT source AS match_id, doc_id % 7 AS no, arg_min(text, (-length(text), doc_id)) AS text, arg_min(doc_id, (-length(text), doc_id)) AS ord
FROM documents WHERE length(text) >= 12 GROUP BY 1, 2""")
def longest_text_per_no(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("match_id"), (F.col("doc_id") % 7).alias("no"), "text", F.col("doc_id").alias("ord"))
    return sequence.longest_text(rows, 12)


@query(f"SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source, substr({normal('text')}, 1, 40)")
def prefix_dedup(spark, sf_dir):
    return sequence.prefix_dedup(table(spark, sf_dir, "documents").select("source", "doc_id", "text"), ["source"], "doc_id").select("source", "doc_id")


@query(f"""WITH h AS (SELECT source, doc_id, substr({normal('text')}, 1, 60) AS h FROM documents),
l AS (SELECT *, lag(h) OVER (PARTITION BY source ORDER BY doc_id) AS before FROM h)
SELECT source, doc_id FROM l WHERE before IS NULL OR before <> h""")
def adjacent_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return sequence.adjacent_dedup(rows, "source", "doc_id", []).select("source", "doc_id")


@query("""WITH p AS (SELECT o_custkey AS match_id, o_orderkey AS p_idx, o_orderkey % 9 AS no FROM orders),
k AS (SELECT o_custkey AS match_id, o_orderkey % 9 AS no, arg_min(o_orderstatus, o_orderkey) AS answer FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2)
SELECT p.match_id, p.p_idx, p.no, coalesce(k.answer, '') AS answer FROM p LEFT JOIN k USING (match_id, no)""")
def three_way_key(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("match_id"), F.col("o_orderkey").alias("p_idx"), (F.col("o_orderkey") % 9).alias("no"), F.col("o_orderstatus").alias("answer"))
    official = rows.where("p_idx % 2 = 0").select("match_id", "no", F.col("p_idx").alias("k_idx"), "answer")
    return match.three_way(rows.select("match_id", "p_idx"), rows.select("match_id", "p_idx", "no"), official)


@query("""WITH a AS (SELECT user_id, ts, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT e.event_id, e.user_id, a.value AS as_of FROM events e ASOF LEFT JOIN a ON e.user_id = a.user_id AND e.ts >= a.ts WHERE e.event_type <> 'purchase'""")
def asof_anchor(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")
    anchors = rows.where("event_type = 'purchase'").select("user_id", "ts", "event_id", "value")
    return sequence.as_of(rows.where("event_type <> 'purchase'"), anchors, "user_id", "ts", ["event_id"], "value").select("event_id", "user_id", "as_of")


@query("""WITH r AS (SELECT o_custkey % 50 AS page_id, o_orderkey AS block, o_totalprice / 100 AS y0, o_totalprice / 100 + 40 AS y1 FROM orders WHERE o_orderkey % 5 = 0),
l AS (SELECT o_custkey % 50 AS page_id, o_orderkey AS ord, o_totalprice / 100 AS y FROM orders WHERE o_orderkey % 5 <> 0)
SELECT l.page_id, l.ord, min(block) AS block FROM l JOIN r ON l.page_id = r.page_id AND y BETWEEN y0 - 9 AND y1 + 9 GROUP BY 1, 2""")
def interval_bind(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("page_id"), F.col("o_orderkey").alias("ord"), (F.col("o_totalprice") / 100).alias("y"))
    blocks = rows.where("ord % 5 = 0").select("page_id", F.col("ord").alias("block"), F.col("y").alias("y0"), (F.col("y") + 40).alias("y1"))
    return sequence.pair_lines(rows.where("ord % 5 <> 0").withColumn("text", F.lit("")), blocks, 9.0).select("page_id", "ord", "block")


@query("""WITH g AS (SELECT event_type, value, CASE WHEN value - lag(value) OVER (PARTITION BY event_type ORDER BY value) > 0.05 THEN 1 ELSE 0 END AS o FROM events WHERE value IS NOT NULL),
c AS (SELECT event_type, value, sum(o) OVER (PARTITION BY event_type ORDER BY value ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM g)
SELECT event_type, cluster, count(*) AS n, round(avg(value), 6) AS mean FROM c GROUP BY 1, 2""")
def cluster_axis(spark, sf_dir):
    out = sequence.cluster_axis(table(spark, sf_dir, "events").select("event_type", "value"), "event_type", "value", 0.05)
    return out.withColumn("mean", F.round("mean", 6))


@query("SELECT event_type, list_sort(list(value))[least(count(value), floor(count(value) * 0.75)::BIGINT + 1)] AS p75 FROM events WHERE value IS NOT NULL GROUP BY 1")
def upper_percentiles(spark, sf_dir):
    return sequence.upper_percentiles(table(spark, sf_dir, "events").select("event_type", "value"), "event_type", "value", 0.75).withColumnRenamed("value", "p75")


@query("""WITH d AS (SELECT source AS match_id, doc_id // 3 AS no, doc_id AS p_idx, text, CASE WHEN lang = 'en' THEN 'en' ELSE 'hi' END AS script FROM documents),
f AS (SELECT *, min(CASE WHEN script = 'en' THEN p_idx END) OVER (PARTITION BY match_id, no) AS first, count(*) FILTER (script = 'en') OVER (PARTITION BY match_id, no) AS n_en FROM d),
h AS (SELECT *, row_number() OVER (PARTITION BY match_id, no ORDER BY p_idx) AS k FROM f WHERE script = 'hi' AND (first IS NULL OR p_idx < first)),
l AS (SELECT match_id, no, 1 AS k, arg_max(text, p_idx) AS alt FROM f WHERE script = 'hi' AND p_idx > first GROUP BY 1, 2),
e AS (SELECT *, row_number() OVER (PARTITION BY match_id, no ORDER BY p_idx) AS k FROM f WHERE script = 'en')
SELECT e.match_id, e.no, e.p_idx, e.text, e.script, coalesce(l.alt, h.text) AS alt FROM e LEFT JOIN h USING (match_id, no, k) LEFT JOIN l USING (match_id, no, k)
UNION ALL SELECT match_id, no, p_idx, text, script, NULL FROM h WHERE k > n_en""")
def merge_translations(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        F.col("source").alias("match_id"), F.floor(F.col("doc_id") / 3).alias("no"), F.col("doc_id").alias("p_idx"), "text", F.when(F.col("lang") == "en", "en").otherwise("hi").alias("script")
    )
    return match.merge_translations(rows)


@query("SELECT sha256(concat_ws('|', source, text)) AS k, count(*) AS requests, min(doc_id) AS first FROM documents GROUP BY 1")
def read_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", sequence.read_key(F.col("source"), F.col("text"), F.lit(None).cast("string")).alias("k"))
    return rows.groupBy("k").agg(F.count("*").alias("requests"), F.min("doc_id").alias("first"))


@query("""WITH RECURSIVE reads AS (SELECT DISTINCT concat_ws('/', user_id, event_type) AS k, ts FROM events WHERE ts IS NOT NULL),
made AS (SELECT k, min(ts) AS ts FROM reads GROUP BY k
  UNION ALL SELECT m.k, min(r.ts) FROM made m JOIN reads r ON r.k = m.k AND r.ts >= m.ts + INTERVAL 12 HOUR GROUP BY m.k, m.ts)
SELECT k, ts AS "at" FROM made""")
def cached_reads(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat_ws("/", "user_id", "event_type").alias("k"), F.col("ts").alias("at"))
    return sequence.read_dedup(rows)


@query("""WITH b AS (SELECT doc_id, source || ' (B) ✓ ' || text AS b FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, '(3) ● ' || text FROM documents WHERE doc_id % 2 = 1)
SELECT doc_id, CASE WHEN regexp_extract(b, '([A-Ha-h])\\s*[).:]\\s*[✓✔✅√●⦿⬤]', 1) <> '' THEN upper(regexp_extract(b, '([A-Ha-h])\\s*[).:]\\s*[✓✔✅√●⦿⬤]', 1))
  ELSE regexp_extract(b, '\\(\\s*([0-9]{1,2})\\s*\\)\\s*[✓✔✅√●⦿⬤]', 1) END AS answer FROM b""")
def marked_answers(spark, sf_dir):
    even = F.concat("source", F.lit(" (B) ✓ "), "text")
    blob = F.when(F.col("doc_id") % 2 == 0, even).otherwise(F.concat(F.lit("(3) ● "), "text"))
    return table(spark, sf_dir, "documents").select("doc_id", X.marked_answer(blob).alias("answer"))


SKIP = "[" + ", ".join(f"'{w}'" for w in X.STEM_SKIP) + "]"


@query(f"""WITH w AS (SELECT item_id, list_filter(string_split({normal('text')}, ' '), lambda w: length(w) > 2 AND NOT list_contains({SKIP}, w) AND NOT regexp_full_match(w, '[0-9]+')) AS w FROM benchmark)
SELECT item_id, array_to_string(list_transform(range(1, least(len(w) - 2, 10) + 1), lambda i: array_to_string(w[i:i + 2], ' ')), '|') AS stems FROM w""")
def first_stems(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(X.stems(X.normalize(F.col("text"))), "|").alias("stems"))


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents),
n AS (SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN (pos + 1)::VARCHAR || '. ' || line ELSE line END AS text FROM l),
o AS (SELECT doc_id, pos, text, regexp_extract(text, '^\s*(?:[Qq](?:uestion)?[\s.:#-]*)?([0-9]{1,3})\s*[).:\-]', 1) AS no FROM n),
b AS (SELECT *, (sum(CASE WHEN no <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))::BIGINT AS block FROM o)
SELECT doc_id, block, max(CASE WHEN no <> '' THEN no::INT END) AS no, string_agg(text, ' ' ORDER BY pos) AS text FROM b GROUP BY doc_id, block""")
def split_blocks(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    text = F.when(F.col("ord") % 3 == 0, F.concat((F.col("ord") + 1).cast("string"), F.lit(". "), "line")).otherwise(F.col("line"))
    return sequence.split_blocks(lines.select("doc_id", "ord", text.alias("text")))


@query("""WITH v AS (SELECT event_type, event_id, value FROM events WHERE value IS NOT NULL)
SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM v""")
def moving_average(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("value is not null").select("event_type", "event_id", "value")
    return sequence.moving_average(rows, "event_type", ["event_id"], "value", 2).select("event_id", F.round("smooth", 6).alias("smooth"))


@query("""WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
g AS (SELECT user_id, k, k - row_number() OVER (PARTITION BY user_id ORDER BY k) AS g FROM n WHERE value > 20),
r AS (SELECT user_id, count(*) AS n, min(k) AS first, max(k) AS last FROM g GROUP BY user_id, g)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY first) AS island, n, first, last FROM r""")
def value_islands(spark, sf_dir):
    out = sequence.islands(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", ["event_id"], F.col("value") > 20)
    return out.select("user_id", F.col("island").cast("long").alias("island"), "n", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))


@query(ITEMS + """ SELECT match_id, count(*) FILTER (state <> 'unmatched') AS matched, count(*) FILTER (correct <> '') AS with_answer, 0::BIGINT AS low FROM rows GROUP BY 1""")
def match_coverage(spark, sf_dir):
    return analyze.coverage(scored_rows(spark, sf_dir))


@query(ITEMS + " SELECT match_id, greatest(max(ascii(correct) - 64), max(CASE WHEN mine <> '' THEN ascii(mine) - 64 END), 3)::INT AS letters FROM rows GROUP BY 1")
def option_letters(spark, sf_dir):
    return analyze.letters(scored_rows(spark, sf_dir), 3).select("match_id", F.col("letters").cast("int").alias("letters"))


@query("""WITH i AS (SELECT doc_id AS page_id, generate_subscripts(string_split(text, ' '), 1) AS ord, unnest(string_split(text, ' ')) AS str FROM documents),
p AS (SELECT page_id, ord, str, CASE WHEN lag(ord) OVER w IS NULL THEN '' WHEN (ord // 10) <> (lag(ord) OVER w // 10) THEN chr(10) WHEN ord % 2 = 0 THEN ' ' ELSE '' END || str AS part FROM i WINDOW w AS (PARTITION BY page_id ORDER BY ord))
SELECT page_id, string_agg(part, '' ORDER BY ord) AS text FROM p GROUP BY page_id""")
def items_to_lines(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", " ")).alias("k", "str")).withColumn("ord", F.col("k") + 1)
    x = F.floor(F.col("ord") / 2) * 25.0 + (F.col("ord") % 2) * 10.0
    return sequence.items_to_lines(items.select("page_id", "ord", "str", x.alias("x"), (F.floor(F.col("ord") / 10) * 12.0).alias("y"), F.lit(10.0).alias("width")))


@query("SELECT doc_id, trim(regexp_replace((doc_id % 900 + 1)::VARCHAR || '. ' || text, '^\\s*[0-9]{1,3}\\s*[).:\\-]\\s*', '')) AS text FROM documents")
def without_numbers(spark, sf_dir):
    numbered = F.concat((F.col("doc_id") % 900 + 1).cast("string"), F.lit(". "), "text")
    return table(spark, sf_dir, "documents").select("doc_id", X.without_number(numbered).alias("text"))


@query("SELECT item_id, (item_id % 99 + 1)::VARCHAR || ' - ' || chr((65 + item_id % 4)::INT) || chr(10) AS text FROM benchmark")
def untabled(spark, sf_dir):
    row = F.concat(F.lit("| "), (F.col("item_id") % 99 + 1).cast("string"), F.lit(" | "), F.char(65 + F.col("item_id") % 4), F.lit(" |\n|---|---|"))
    return table(spark, sf_dir, "benchmark").select("item_id", X.untable(row).alias("text"))


@query(PAIR + """ SELECT p_idx, k_idx, CASE WHEN s >= 0.72 THEN '' ELSE 'check ~' || floor(round(s, 6) * 100 + 0.5)::BIGINT || '%' END AS tag FROM scored WHERE s >= 0.42""")
def confidence_tags(spark, sf_dir):
    paper, keys = benchmark_pair(spark, sf_dir)
    scores = match.content_scores(match.signatures(paper, "p_idx"), match.signatures(keys, "k_idx"))
    tag = F.when(F.col("s") >= 0.72, "").otherwise(analyze.confidence_tag(F.round("s", 6), F.lit("content")))
    return scores.select("p_idx", "k_idx", tag.alias("tag"))


#: Items of a printed paper at most, below every limit that a parser sets to its numbers.
PRINTED = 100


def _printed_in(booklets):
    """The printed paper that an item is in: a booklet by remainder, cut into volumes of PRINTED items."""
    return F.floor(F.col("item_id") / (booklets * PRINTED)) * booklets + F.col("item_id") % booklets


def _printed(spark, sf_dir, booklets=10):
    """The benchmark as printed papers, as many as its size asks for; paper modulo booklets is the booklet, of which each is a volume."""
    items = table(spark, sf_dir, "benchmark").select(_printed_in(booklets).alias("doc_id"), F.col("item_id").alias("i"), "text")
    items = items.withColumn("no", F.row_number().over(W.partitionBy("doc_id").orderBy("i")))
    line = F.concat(F.col("no").cast("string"), F.lit(". "), "text")
    return items.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


@query("""SELECT item_id % 10 AS doc_id, (row_number() OVER (PARTITION BY item_id % 10 ORDER BY item_id) - 1)::INT AS idx, row_number() OVER (PARTITION BY item_id % 10 ORDER BY item_id)::INT AS no, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM benchmark""")
def parse_questions(spark, sf_dir):
    rows = parse.questions(_printed(spark, sf_dir))
    items = table(spark, sf_dir, "benchmark").groupBy(_printed_in(10).alias("doc_id")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy(F.col("doc_id") % 10).orderBy("doc_id")) - F.col("n")  # one row for each volume
    rows = rows.join(items.select("doc_id", before.cast("int").alias("before")), "doc_id")
    return rows.select((F.col("doc_id") % 10).alias("doc_id"), (F.col("idx") + F.col("before")).alias("idx"), (F.col("no") + F.col("before")).alias("no"), "text")


@query("SELECT l_orderkey AS doc_id, n AS no, a AS answer FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INT AS n, chr((65 + l_suppkey % 4)::INT) AS a FROM lineitem)")
def parse_answer_key(spark, sf_dir):
    items = line_items(spark, sf_dir)
    pair = F.concat(F.col("no").cast("string"), F.lit("-"), "key")
    docs = items.groupBy(F.col("match_id").alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", pair.alias("p")))), lambda x: x["p"]), "  ").alias("text"))
    return parse.answer_key(docs).select("doc_id", "no", "answer")


@query()
def chain_segments(spark, sf_dir):
    return parse.chain_segments(_printed(spark, sf_dir, 4))


@query()
def stem_match(spark, sf_dir):
    docs = _printed(spark, sf_dir).withColumnRenamed("doc_id", "match_id")
    paper = table(spark, sf_dir, "benchmark").select(_printed_in(10).alias("match_id"), F.col("item_id").alias("p_idx"), "text")
    return parse.by_stem(paper, docs)


HINDI = "नीचे दिए गए कथन पढ़ें"

LETTERS = "'wording ' || trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'))"


def _templated(spark, sf_dir, least, most):
    """(doc_id, n, w): a number from least to most, and the item's letters."""
    words = F.concat(F.lit("wording "), F.trim(F.regexp_replace("text", "[^A-Za-z]+", " ")))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), (F.col("item_id") % (most - least + 1) + least).cast("int").alias("n"), words.alias("w"))


@query(f"""WITH d AS (SELECT item_id AS doc_id, (item_id % 400 + 1)::INT AS n, item_id % 8 AS t, trim({LETTERS}) AS w FROM benchmark)
SELECT doc_id, n AS no, CASE t WHEN 0 THEN 'B' WHEN 1 THEN '' WHEN 3 THEN 'C' WHEN 4 THEN '3' WHEN 5 THEN 'A' WHEN 6 THEN 'D' ELSE 'B' END AS answer,
  CASE WHEN t = 1 THEN '1A or 2B which vitamin' WHEN t IN (3, 6, 7) THEN w ELSE '' END AS text FROM d WHERE t <> 2
UNION ALL SELECT doc_id, n + 1, 'B', '' FROM d WHERE t = 5""")
def key_rules(spark, sf_dir):
    """Keys whose lines several rules claim."""
    docs = _templated(spark, sf_dir, 1, 400)
    n, after = F.col("n").cast("string"), (F.col("n") + 1).cast("string")
    line = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    texts = [
        line("Q", n, " B"), line(n, ". 1A or 2B which vitamin"), line(n, " - (3)\nQ", n, " - 3"), line(n, ". ", F.col("w"), "\nAnswer: c"), line(n, " - 3"),
        line(n, "-A ", after, "-B\n", after, "-C"), line(n, ". (D) ", F.col("w")), line("उत्तर - c\n", n, ") ", F.col("w"), "\nAns (b)"),
    ]
    return parse.answer_key(docs.select("doc_id", F.get(F.array(*texts), (F.col("doc_id") % 8).cast("int")).alias("text"))).select("doc_id", "no", "answer", "text")


@query(f"""WITH d AS (SELECT item_id AS doc_id, (item_id % 300 + 21)::INT AS n, trim({LETTERS}) AS w FROM benchmark)
SELECT doc_id, 0 AS idx, n AS no, w || ' Consider the following statements: 1. first item of the ' || w || ' 1. again an item of it here (a) Mars and its moons' AS text,
  '(1) Earth (2) Mars|a) one' AS options, NULL AS alt FROM d
UNION ALL SELECT doc_id, 1, n + 1, 'The list of ' || w || ' items： 1. the very first item of all', '', NULL FROM d
UNION ALL SELECT doc_id, 2, n + 2, 'which of these ' || w, '(A) one|(B) two|(C) three', '{HINDI} क्या' FROM d""")
def paper_rules(spark, sf_dir):
    """Papers with statements, numbers that jump back, options of every form and a copy in Hindi."""
    docs = _templated(spark, sf_dir, 21, 320)
    no = lambda k: (F.col("n") + k).cast("string")
    text = F.concat(
        no(0), F.lit(". "), "w", F.lit(" Consider the following statements:\n1. first item of the "), "w", F.lit("\n1. again an item of it here\n(a) Mars and its moons\n(1) Earth (2) Mars\na) one\n"),
        no(1), F.lit(". The list of "), "w", F.lit(" items：\n1. the very first item of all\n"),
        no(2), F.lit(". which of these "), "w", F.lit(" (A) one (B) two (C) three\n"), no(2), F.lit(f". {HINDI} क्या\n"),
    )
    return parse.questions(docs.select("doc_id", text.alias("text"))).select("doc_id", "idx", "no", "text", F.array_join("options", "|").alias("options"), "alt")


#: Items of a paper in the queries over pairs of papers.
PAPER = 50


def _two_papers(spark, sf_dir):
    """(match_id, text) of the benchmark printed in papers of PAPER items, and of the same items printed in falling order under other numbers."""
    unique = F.translate(F.md5(F.col("item_id").cast("string")), "0123456789", "ghijklmnop")  # so that a phrase tells one item
    text = F.concat_ws(" ", *[F.substring(unique, k, 8) for k in (1, 9, 17, 25)], "text")
    items = table(spark, sf_dir, "benchmark").select(F.floor(F.col("item_id") / PAPER).alias("match_id"), (F.col("item_id") % PAPER + 1).cast("int").alias("no"), text.alias("text"))
    sizes = items.groupBy("match_id").agg(F.max("no").alias("n"))
    both = items.join(sizes, "match_id").withColumn("other", F.col("n") + 1 - F.col("no"))

    def printed(no):
        lines = F.sort_array(F.collect_list(F.struct(F.col(no).alias("no"), F.concat(F.col(no).cast("string"), F.lit(". "), "text").alias("line"))))
        return both.groupBy("match_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))

    return printed("no"), printed("other")


def _questions(texts):
    return parse.questions(texts.withColumnRenamed("match_id", "doc_id")).withColumnRenamed("doc_id", "match_id")


@query(f"""WITH i AS (SELECT item_id // {PAPER} AS match_id, (item_id % {PAPER} + 1)::INT AS no, (count(*) OVER (PARTITION BY item_id // {PAPER}) - item_id % {PAPER})::INT AS key_no FROM benchmark)
SELECT * FROM i WHERE no % 10 <> 8 OR key_no % 25 <> 7""")
def number_map(spark, sf_dir):
    """Numbers of one paper to those of another, where each parse has lost some questions that the other text still holds."""
    texts, key_texts = _two_papers(spark, sf_dir)
    paper = _questions(texts).where("no % 10 <> 8").withColumnRenamed("idx", "p_idx")
    keys = _questions(key_texts).where("no % 25 <> 7").withColumnRenamed("idx", "k_idx")
    return assemble.number_map(paper, keys, texts, key_texts).select("match_id", "no", "key_no")


@query(f"""WITH i AS (SELECT item_id // {PAPER} AS match_id, (item_id % {PAPER} + 1)::INT AS no, count(*) OVER (PARTITION BY item_id // {PAPER}) AS n FROM benchmark)
SELECT match_id, no, (n - no)::INT AS k_idx, 0.5::DOUBLE AS confidence, 'rev' AS method FROM i WHERE no % 2 = 0""")
def reverse_recovery(spark, sf_dir):
    """Even numbers of a paper, of which its parse has only the odd ones, found by the other paper's wordings."""
    texts, key_texts = _two_papers(spark, sf_dir)
    paper, keys = _questions(texts).where("no % 2 = 1"), _questions(key_texts)
    found = parse.by_stem(keys.select("match_id", F.col("idx").alias("p_idx"), "text"), texts).withColumnRenamed("p_idx", "k_idx")
    size = keys.groupBy("match_id").agg(F.count("*").alias("n"))
    assigned = paper.select("match_id", "no").join(size, "match_id").select("match_id", (F.col("n") - F.col("no")).cast("int").alias("k_idx"))
    return match.recovered(paper, assigned, found)


@query(f"""WITH i AS (SELECT item_id // {PAPER} AS match_id, (item_id % {PAPER} + 1)::INT AS no, count(*) OVER (PARTITION BY item_id // {PAPER}) AS n FROM benchmark)
SELECT match_id, no - 1 AS p_idx, no, CASE WHEN match_id % 2 = 0 THEN n + 1 - no ELSE no END::INT AS key_no, chr((65 + CASE WHEN match_id % 2 = 0 THEN n + 1 - no ELSE no END % 4)::INT) AS correct,
  chr((65 + no % 3)::INT) AS mine, CASE WHEN CASE WHEN match_id % 2 = 0 THEN n + 1 - no ELSE no END % 4 = no % 3 THEN 'correct' ELSE 'wrong' END AS state FROM i""")
def text_results(spark, sf_dir):
    """Two texts of each match to its result: every second key has the wordings, under other numbers, the rest numbers only."""
    texts, key_texts = _two_papers(spark, sf_dir)
    letters = lambda c, k: F.char(65 + F.col(c) % k)
    numbers = _questions(key_texts).select("match_id", "no", "text")
    line = F.when(F.col("match_id") % 2 == 0, F.concat(F.col("no").cast("string"), F.lit(". "), "text", F.lit("\nAnswer: "), letters("no", 4)))
    line = F.coalesce(line, F.concat(F.col("no").cast("string"), F.lit(" - "), letters("no", 4)))
    keys = numbers.groupBy("match_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    mine = numbers.select("match_id", "no", letters("no", 3).alias("mine"))
    return assemble.results(texts, keys, mine).select("match_id", "p_idx", "no", "key_no", "correct", "mine", "state")


@query(f"""WITH l AS (SELECT item_id % 4 AS doc_id, item_id AS i, trim(regexp_replace(text, '[0-9\\s]+', ' ', 'g')) AS t FROM benchmark)
SELECT doc_id, string_agg('{HINDI}', chr(10) ORDER BY i) || chr(10) || string_agg(t, chr(10) ORDER BY i) AS text FROM l GROUP BY doc_id""")
def split_scripts(spark, sf_dir):
    lines = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 4).alias("doc_id"), F.struct("item_id", F.concat(F.lit(HINDI + " "), F.trim(F.regexp_replace("text", r"[0-9\s]+", " "))).alias("line")).alias("l"))
    docs = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l")), lambda x: x["line"]), "\n").alias("text"))
    return bilingual.split_scripts(docs)


@query(f"""WITH b AS (SELECT item_id, trim(text) AS a, '{HINDI}' AS b FROM benchmark)
SELECT item_id, CASE WHEN item_id % 2 = 0 THEN a ELSE regexp_replace(a || ' ' || b, '\\s+', ' ', 'g') END AS option FROM b""")
def folded_options(spark, sf_dir):
    again = F.when(F.col("item_id") % 2 == 0, F.concat(F.trim("text"), F.lit(" ?!"))).otherwise(F.lit(HINDI))
    body = F.concat(F.trim("text"), F.lit(" ( B ) "), again)
    return table(spark, sf_dir, "benchmark").select("item_id", bilingual.fold_option(body, F.lit("B")).alias("option"))


@query(f"SELECT item_id, trim(regexp_replace(text, '[0-9]', '', 'g')) AS text, '{HINDI}' AS alt FROM benchmark")
def twice_numbered(spark, sf_dir):
    no = F.col("item_id") % 300 + 1
    both = F.concat(F.lit(HINDI + " "), no.cast("string"), F.lit(". "), F.regexp_replace("text", "[0-9]", ""))
    return table(spark, sf_dir, "benchmark").select("item_id", bilingual.own_number_split(no, both).alias("s")).select("item_id", "s.text", "s.alt")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n, max(event_id) AS f FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2)
SELECT user_id, arg_min(event_type, (-n, f)) AS event_type, max(n) AS n FROM c GROUP BY 1""")
def modal_values(spark, sf_dir):
    return sequence.mode(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_type", "event_id")


@query("""WITH RECURSIVE p AS (SELECT l_suppkey % 100 AS page_id, dayofyear(l_shipdate)::INT AS d, count(*)::DOUBLE AS ink FROM lineitem GROUP BY 1, 2),
n AS (SELECT *, lag(ink) OVER w AS a, lead(ink) OVER w AS b, greatest(max(ink) OVER (PARTITION BY page_id) * 0.15::DOUBLE, 2) AS level FROM p WINDOW w AS (PARTITION BY page_id ORDER BY d)),
t AS (SELECT page_id, d, ink, row_number() OVER (PARTITION BY page_id ORDER BY d) AS i, count(*) OVER (PARTITION BY page_id) AS n FROM n WHERE ink >= a AND ink > b AND ink > level),
run AS (SELECT page_id, i, n, [{'d': d, 'v': ink}] AS kept FROM t WHERE i = 1
  UNION ALL SELECT page_id, i, n, CASE WHEN near = 0 THEN list_append(kept, {'d': d, 'v': ink})
    ELSE list_transform(kept, lambda k, j: CASE WHEN j = near AND ink > k.v THEN {'d': d, 'v': ink} ELSE k END) END
  FROM (SELECT t.*, r.kept, coalesce(list_position(list_transform(r.kept, lambda k: abs(t.d - k.d) < 8), true), 0) AS near FROM run r JOIN t ON t.page_id = r.page_id AND t.i = r.i + 1)),
k AS (SELECT page_id, unnest(kept) AS k FROM run WHERE i = n)
SELECT page_id, k.d AS "at", k.v AS ink FROM k""")
def profile_peaks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 100).alias("page_id"), F.dayofyear("l_shipdate").alias("at")).agg(F.count("*").cast("double").alias("ink"))
    return sequence.peaks(rows, "page_id", "at", "ink", 8)


@query("""WITH n AS (SELECT o_custkey, o_orderkey::DOUBLE AS pos, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - o_orderkey AS gap FROM orders),
s AS (SELECT *, coalesce(greatest(floor(gap / 1000.0 + 0.5), 1), 1)::INT AS n FROM n), k AS (SELECT *, unnest(range(n)) AS k FROM s)
SELECT o_custkey, round(pos + CASE WHEN k > 0 THEN gap * k::DOUBLE / n ELSE 0 END, 6) AS pos, k > 0 AS made FROM k""")
def filled_lattice(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("double").alias("pos"))
    return sequence.fill_lattice(rows, "o_custkey", "pos", 1000.0).withColumn("pos", round_half_away(F.col("pos"), 6))


@query(ITEMS + """ SELECT match_id, no, CASE WHEN no % 3 = 0 THEN '12345' WHEN no % 3 = 1 THEN 'ABCD' ELSE 'ABCDE' END AS letters FROM rows""")
def option_alphabets(spark, sf_dir):
    rows = scored_rows(spark, sf_dir)
    correct = F.when(F.col("no") % 3 == 0, "2").otherwise(F.col("correct"))
    options = F.when(F.col("no") % 3 == 1, F.array(*[F.lit(f"({k}) x") for k in range(1, 5)]))
    return rows.select("match_id", "no", F.array_join(analyze.alphabet(correct, F.col("mine"), options), "").alias("letters"))


from . import bubbles, columns, pictures, requests  # noqa: E402, F401
