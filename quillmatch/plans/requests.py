"""Queries over requests to read a page: each document is one, in order of its id."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmatch.operators import flights, sequence

from .derived import table
from .registry import query


@query("""WITH RECURSIVE reads AS (SELECT source AS k, doc_id * 10 AS "at", doc_id AS id, n_chars AS takes, doc_id % 7 <> 3 AS ok FROM documents),
s AS (SELECT *, "at" + takes AS ends, greatest("at" + takes + CASE WHEN ok THEN 2000 ELSE 0 END, "at" + 1) AS opens FROM reads WHERE k IS NOT NULL AND takes >= 0 AND "at" IS NOT NULL),
p AS MATERIALIZED (SELECT a.k, a.id, b.id AS next FROM s a ASOF JOIN s b ON a.k = b.k AND a.opens <= b."at"),
leads AS (SELECT k, min(id) AS id FROM s GROUP BY k UNION ALL SELECT l.k, p.next FROM leads l JOIN p ON p.k = l.k AND p.id = l.id),
full_leads AS (SELECT s.* FROM s JOIN leads l ON l.k = s.k AND l.id = s.id),
f AS (SELECT s.k, s."at", s.id, l.id AS lead, l.ends, l.ok AS good FROM s ASOF JOIN full_leads l ON s.k = l.k AND s."at" >= l."at")
SELECT k, "at", id, CASE WHEN id = lead THEN 'lead' WHEN "at" < ends THEN 'wait' ELSE 'hit' END AS role, lead, greatest(ends, "at") AS answered, good FROM f
UNION ALL SELECT k, "at", id, 'lead', id, CASE WHEN takes >= 0 THEN "at" + takes END, ok FROM reads WHERE NOT (k IS NOT NULL AND coalesce(takes >= 0, false) AND "at" IS NOT NULL)""")
def read_flights(spark, sf_dir):
    """Requests for the pages of a source, ten milliseconds apart, each taking as many as it has characters; one in seven fails, answers live two seconds."""
    rows = table(spark, sf_dir, "documents").select(
        F.col("source").alias("k"), (F.col("doc_id") * 10).alias("at"), F.col("doc_id").alias("id"), F.col("n_chars").alias("takes"), (F.col("doc_id") % 7 != 3).alias("ok")
    )
    return flights.flights(rows, 2000)


_PARTS = "concat(len({0}), ';', array_to_string(list_transform({0}, lambda x: concat(length(x), ':', x)), ''))"


@query(f"""WITH c AS (SELECT conv_id, coalesce(min(role), '') AS route, coalesce(list(text ORDER BY turn, text) FILTER (turn % 3 <> 2 AND text IS NOT NULL), []) AS texts,
  coalesce(list(text ORDER BY turn, text) FILTER (turn % 3 = 2 AND text IS NOT NULL), []) AS images, coalesce(string_agg(text, ' ' ORDER BY turn, text), '') AS body FROM conversations GROUP BY conv_id),
k AS (SELECT conv_id, CASE WHEN len(images) > 0 THEN concat('page|', length(route), ':', route, {_PARTS.format('texts')}, {_PARTS.format('images')})
  ELSE concat('req|', length(route), ':', route, length(conv_id::VARCHAR), ':', conv_id, length(body), ':', body) END AS k FROM c)
SELECT to_base64(unhex(sha256(k))) AS k, count(*) AS requests, min(conv_id) AS first FROM k GROUP BY 1""")
def request_keys(spark, sf_dir):
    """Requests by key: each conversation is one; every third turn stands for a picture, the others are instructions."""
    turns = table(spark, sf_dir, "conversations").where("turn is not null").select("conv_id", "role", "turn", "text")
    of = lambda when: F.transform(F.sort_array(F.collect_list(F.when(when & F.col("text").isNotNull(), F.struct("turn", "text")))), lambda x: x["text"])
    rows = turns.groupBy("conv_id").agg(F.min("role").alias("route"), of(F.col("turn") % 3 != 2).alias("texts"), of(F.col("turn") % 3 == 2).alias("images"), of(F.lit(True)).alias("all"))
    keys = rows.select("conv_id", sequence.request_key(F.col("route"), F.col("conv_id").cast("string"), F.col("texts"), F.col("images"), F.array_join("all", " ")).alias("k"))
    return keys.groupBy("k").agg(F.count("*").alias("requests"), F.min("conv_id").alias("first"))
