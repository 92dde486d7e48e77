"""The concepts of the triage data model as views over the given tables, as SQL that both Spark and the oracle run.

posts: documents as arriving posts (a post id repeats now and then); scored: a score, a gold label, a second judge and a
class per labelled document; assessed: a model's structured judgement, drawn from the hash-free digits of the id;
segments: turns of a conversation as time segments; sightings: events as reports of a link by a sender.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "posts": """SELECT doc_id AS seq, source AS channel, CASE WHEN doc_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS platform,
  CASE WHEN doc_id % 97 = 0 THEN NULL ELSE concat('p', CAST(doc_id - (CASE WHEN doc_id % 10 = 7 THEN 2 ELSE 0 END) AS STRING)) END AS post_id,
  text, lang, n_chars AS reach, CASE WHEN doc_id % 3 = 0 THEN 'east' WHEN doc_id % 3 = 1 THEN 'west' ELSE NULL END AS side,
  concat('2024-', CASE WHEN doc_id % 12 < 9 THEN '0' ELSE '' END, CAST(doc_id % 12 + 1 AS STRING)) AS month FROM documents""",
    "scored": """SELECT l.doc_id AS item_id, d.source AS part, d.lang AS class, l.toxic = 1 AS y, l.quality = 1 AS judge,
  CAST((l.doc_id * 7919 + l.toxic * 350) % 1000 AS DOUBLE) / 1000 AS score,
  CAST((l.doc_id * 104729 + l.toxic * 500) % 1000 AS DOUBLE) / 1000 AS score_b
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "assessed": """SELECT doc_id AS item_id, doc_id % 41 = 0 AS possible_minor, doc_id % 5 = 0 AS identifiable_person,
  CASE WHEN doc_id % 13 = 0 THEN concat('B2-', CAST(doc_id % 5 + 1 AS STRING)) END AS exclusion,
  CASE doc_id % 7 WHEN 0 THEN 'reports' WHEN 1 THEN 'quotes_to_condemn' WHEN 2 THEN 'mocks' WHEN 3 THEN 'endorses' ELSE 'unclear' END AS stance,
  doc_id % 14 = 0 AS source_attributed, doc_id % 3 = 0 AS quote_present,
  CASE WHEN doc_id % 4 < 3 THEN concat('SV-REL-', CAST(doc_id % 5 + 1 AS STRING)) END AS relation,
  CASE doc_id % 6 WHEN 0 THEN 'future' WHEN 1 THEN 'imperative' ELSE 'past' END AS modal,
  CASE doc_id % 8 WHEN 0 THEN 'explicit' WHEN 1 THEN 'implied' ELSE 'none' END AS cta,
  CASE doc_id % 3 WHEN 0 THEN 'individual' WHEN 1 THEN 'group' ELSE 'unspecified' END AS target,
  CASE WHEN doc_id % 4 = 1 THEN '' WHEN doc_id % 8 = 0 THEN 'HI-TYPE-02' ELSE 'HI-TYPE-04' END AS type_list,
  CASE WHEN doc_id % 6 = 5 THEN '' WHEN doc_id % 9 = 0 THEN 'HP-01,HP-03' ELSE 'HP-01' END AS pathway_list,
  CASE WHEN doc_id % 31 = 0 THEN 'SV-FORM-01' ELSE '' END AS act_list, concat('SV-REL-', CAST(doc_id % 7 + 1 AS STRING)) AS cited_list,
  CASE WHEN doc_id % 10 = 3 THEN 'SV-REL-4' ELSE '' END AS secondary_list, doc_id % 37 = 0 AS sv_signal, doc_id % 17 = 0 AS high_reach, doc_id % 9 = 0 AS exposes_identity,
  CASE WHEN doc_id % 5 = 4 THEN 'none' ELSE concat('AFF-', CAST(doc_id % 5 + 1 AS STRING)) END AS affiliation,
  doc_id % 23 = 0 AS mentions_minor, doc_id % 29 = 0 AS age_indicator, doc_id % 11 = 0 AS lead,
  CASE doc_id % 3 WHEN 0 THEN 'likely' WHEN 1 THEN 'possible' ELSE 'unclear' END AS element_a,
  CASE doc_id % 4 WHEN 0 THEN 'likely' WHEN 1 THEN 'possible' ELSE 'unclear' END AS element_b,
  CASE doc_id % 5 WHEN 0 THEN 'likely' WHEN 1 THEN 'possible' WHEN 2 THEN 'unclear' ELSE 'absent' END AS element_c,
  CAST(doc_id % 10 AS DOUBLE) / 10 AS confidence_a, CAST(doc_id % 8 AS DOUBLE) / 8 AS confidence_b,
  CASE doc_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'standard' WHEN 2 THEN 'high' ELSE 'urgent' END AS model_priority,
  CASE doc_id % 3 WHEN 0 THEN 'not_flagged' WHEN 1 THEN 'standard_review' ELSE 'priority_review' END AS model_route,
  CAST(doc_id % 101 AS INT) AS score_1, CAST(doc_id * 37 % 101 AS INT) AS score_2, doc_id % 2 = 0 AS sexual, text AS content
  FROM documents""",
    "segments": """SELECT conv_id AS video, turn AS idx, role, text, p_end - len AS start_s, p_end AS end_s, CAST(len * 7 % 100 AS DOUBLE) / 100 AS p,
  len % 3 = 0 AS positive FROM (SELECT conv_id, turn, role, text, CAST(length(text) AS DOUBLE) AS len,
  CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS DOUBLE) AS p_end FROM conversations) x""",
    "sightings": """SELECT event_id AS id, user_id AS sender, event_type AS lane, ts, value, event_id % 17 = 0 AS restricted,
  concat('https://www.site', CAST(event_id * 31 % 400 AS STRING), '.example/p?b=2&utm_x=1&a=', CAST(event_id % 3 AS STRING)) AS url,
  CASE WHEN event_id % 4 = 0 THEN concat('g', CAST(event_id * 17 % 300 AS STRING)) END AS group_key,
  CASE event_id % 5 WHEN 0 THEN 'urgent' WHEN 1 THEN 'high' WHEN 2 THEN 'standard' WHEN 3 THEN 'none' ELSE NULL END AS priority FROM events""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in view (or table) by name; Spark's parser takes the frames it reads as arguments."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text, frames = VIEWS[name], {}
    for t in TABLES:
        for word in (f"FROM {t}", f"JOIN {t}"):
            if word in text:
                text, frames[t] = text.replace(word, word.replace(t, f"{{{t}}}")), table(spark, sf_dir, t)
    return spark.sql(text, **frames)


def sql(*names: str, body: str) -> str:
    """Oracle SQL: the named views as common tables before ``body``, which may begin with further ones after a comma."""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + body
