"""Queries over texts, links and rule tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.functions import text as T
from triagelake.functions.simhash import simhash_md5, simhash_sql
from triagelake.operators import lexicon as L
from triagelake.operators import rules as R
from triagelake.operators.ranges import ranked
from triagelake.plans.standin import sql, table, view
from triagelake.registry import register

NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), 'https?://\S+|www\.\S+', ' ', 'g'), '@[\p{L}\p{N}_]+', ' ', 'g'), '[^\p{L}\p{N}_\s]+', ' ', 'g'), '\s+', ' ', 'g'))"
HOST = r"lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
KEYWORDS_SQL = """, h AS (SELECT seq, reach, text, regexp_matches(lower(text), 'idiot|moron') OR regexp_matches(lower(text), 'clown') AS h1,
  regexp_matches(lower(text), 'worthless') OR regexp_matches(lower(text), 'scum|trash') AS h2,
  regexp_matches(lower(text), 'thorst') OR regexp_matches(lower(text), 'heard (that|from)') AS h3,
  CASE WHEN regexp_matches(lower(text), 'license') OR regexp_matches(lower(text), 'reserved') THEN 'reporting' WHEN regexp_matches(lower(text), 'there was') THEN 'testimony' WHEN regexp_matches(lower(text), 'token') THEN 'awareness' END AS tone,
  regexp_matches(lower(text), 'stupid') AS v1, regexp_matches(lower(text), 'loser|pathetic') AS v2 FROM posts),
k AS (SELECT seq, reach, text, v1, v2, coalesce(tone, 'serious') AS tone, h1, h2, h3 AND NOT (tone IS NOT NULL AND NOT h1 AND NOT h2) AS h3 FROM h),
c AS (SELECT *, concat_ws(',', CASE WHEN h1 THEN 'insult' END, CASE WHEN h2 THEN 'degradation' END, CASE WHEN h3 THEN 'claim' END) AS harms,
  CASE WHEN v1 OR v2 THEN concat_ws(',', CASE WHEN v1 THEN 'group' END, CASE WHEN v2 THEN 'person' END) ELSE 'unidentifiable' END AS victims,
  CASE WHEN h2 AND (h1 OR h3) THEN 3 WHEN h2 THEN 2 WHEN h1 OR h3 THEN 1 ELSE 0 END AS potential FROM k),
d AS (SELECT *, CASE WHEN harms <> '' AND potential < 2 THEN 'low' ELSE 'medium' END AS confidence FROM c),
b AS (SELECT *, CASE WHEN v1 AND harms <> '' THEN 'escalate' WHEN potential >= 2 AND confidence <> 'low' THEN 'harmful' WHEN harms <> '' OR confidence = 'low' THEN 'potentially_harmful' ELSE 'not_harmful' END AS bucket FROM d)"""


def keyword_rows(spark, d):
    rows = L.classify(view(spark, d, "posts"))
    rows = rows.withColumn("bucket", R.bucket(F.col("harm_types"), F.col("harm_potential"), F.col("confidence"), F.array_contains("victims", "group")))
    return rows.withColumn("score", R.review_score(F.col("bucket"), F.col("harm_potential"), F.col("reach")))


@register("txt01_normalize_text", sql("posts", body=f" SELECT seq, {NORMAL} AS normalised FROM posts"))
def normalize(spark, d):
    """Texts in which a ligature stands for "fi" and wide digits for plain ones are normalised to the same."""
    text = F.translate(F.regexp_replace("text", "fi", "\ufb01"), "0123456789", "\uff10\uff11\uff12\uff13\uff14\uff15\uff16\uff17\uff18\uff19")
    return view(spark, d, "posts").select("seq", T.normalize_text(text).alias("normalised"))


@register("txt02_unmask", r"""WITH t AS (SELECT doc_id, replace(lower(replace(text, 'q', 'я')), 'ё', 'е') AS x FROM documents),
w AS (SELECT doc_id, list_transform(regexp_extract_all(x, '[^\s\x0b]+|[\s\x0b]+'), lambda w: CASE WHEN regexp_matches(w, '[а-яіїєґё]') THEN translate(w, '@03aeopcxykmtbh', 'аозаеорсхукмтвн') ELSE w END) AS l FROM t)
SELECT doc_id, array_to_string(l, '') AS unmasked FROM w""")
def unmask(spark, d):
    return table(spark, d, "documents").select("doc_id", T.unmask(F.regexp_replace("text", "q", "я")).alias("unmasked"))


SPELT = "w"
for _a, _b in T.SPELLINGS:
    SPELT = f"replace({SPELT}, '{_a}', '{_b}')"
SPELT = f"translate(regexp_replace({SPELT}, '([аеиоуяюэ])y', '\\1й', 'g'), 'y{T.SINGLE}', 'ы{T.LETTER}')"


@register("txt03_transliterate", f"""WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(replace(lower(text), 'é', 'е'), '[a-z]+|[^a-z]+'), lambda w: CASE WHEN regexp_matches(w, '^[a-z]') THEN {SPELT} ELSE w END) AS l FROM documents)
SELECT doc_id, array_to_string(l, '') AS cyrillic FROM w""")
def transliterate(spark, d):
    """A Cyrillic letter that stands beside a run already doesn't count as the vowel before its y."""
    return table(spark, d, "documents").select("doc_id", T.transliterate(F.regexp_replace(F.lower("text"), "é", "е")).alias("cyrillic"))


@register("txt04_guess_lang", r"""WITH t AS (SELECT doc_id, lower(replace(replace(text, 'è', 'ы'), 'ñ', 'ї')) AS x FROM documents),
n AS (SELECT *, length(regexp_replace(x, '[^іїєґ]', '', 'g')) AS uk, length(regexp_replace(x, '[^ыэъё]', '', 'g')) AS ru FROM t)
SELECT doc_id, CASE WHEN uk > 0 OR ru > 0 THEN CASE WHEN uk > ru THEN 'uk' ELSE 'ru' END WHEN regexp_matches(x, '[а-яіїєґё]') THEN 'ru'
  WHEN regexp_matches(x, '[a-z]') THEN 'en' ELSE 'other' END AS guess FROM n""")
def guess(spark, d):
    masked = F.regexp_replace(F.regexp_replace("text", "è", "ы"), "ñ", "ї")
    return table(spark, d, "documents").select("doc_id", T.guess_lang(masked).alias("guess"))


HOSTKEY = rf"regexp_replace({HOST}, '^(?:www\.|m\.|mobile\.|web\.)', '')"
URL_SQL = rf""" SELECT page_id, 'https://' || CASE {HOSTKEY} WHEN 'twitter.com' THEN 'x.com' WHEN 'fb.com' THEN 'facebook.com' WHEN 'telegram.me' THEN 't.me' WHEN 'vm.tiktok.com' THEN 'tiktok.com' ELSE {HOSTKEY} END
  || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(q, '&') END AS normalised
FROM (SELECT page_id, url, regexp_replace(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS p,
  list_sort(list_filter(string_split(regexp_extract(trim(url), '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_')
    AND NOT (string_split(lower(x), '=')[1] IN ('fbclid', 'igshid', 'igsh', 'si', 's', 't', 'ref', 'ref_src', 'ref_url', '_rdr', 'mibextid', 'feature')))) AS q FROM pages) x"""


@register("txt05_normalize_url", URL_SQL)
def urls(spark, d):
    return table(spark, d, "pages").select("page_id", T.normalize_url(F.col("url")).alias("normalised"))


@register("txt06_platform_of", rf"SELECT CASE {HOSTKEY} WHEN 't.me' THEN 'Telegram' WHEN 'facebook.com' THEN 'Facebook' WHEN 'x.com' THEN 'X' ELSE 'Web' END AS platform, count(*) AS n FROM pages GROUP BY 1")
def platforms(spark, d):
    return table(spark, d, "pages").groupBy(T.platform_of(F.col("url")).alias("platform")).agg(F.count("*").alias("n"))


@register("txt07_host_allow_list", rf"SELECT page_id, starts_with(lower(trim(url)), 'https://') AND ({HOST} = 'example.com' OR {HOST} LIKE '%.example.com' OR {HOST} = 'example.net' OR {HOST} LIKE '%.example.net') AS allowed FROM pages")
def allowed(spark, d):
    return table(spark, d, "pages").select("page_id", T.on_hosts(F.col("url"), ("example.com", "example.net")).alias("allowed"))


@register("txt08_media_kind", r"""SELECT page_id, CASE WHEN regexp_matches(p, '\.(?:jpg|jpeg|png|webp|gif|heic)$') THEN 'image' WHEN regexp_matches(p, '\.(?:mp4|webm|mov|m3u8)$') THEN 'video' END AS kind
FROM (SELECT page_id, lower(regexp_extract(trim(u), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) AS p FROM (SELECT page_id, regexp_replace(url, '/([0-9]+).*$', '/' || CASE page_id % 5 WHEN 0 THEN 'a.PNG' WHEN 1 THEN 'b.mp4' WHEN 2 THEN 'd.heic' WHEN 3 THEN 'e.m3u8' ELSE 'c.m4v' END) AS u FROM pages) y) x""")
def kinds(spark, d):
    ending = F.get(F.array(*map(F.lit, ("a.PNG", "b.mp4", "d.heic", "e.m3u8", "c.m4v"))), (F.col("page_id") % 5).cast("int"))
    url = F.regexp_replace(F.col("url"), F.lit("/([0-9]+).*$"), F.concat(F.lit("/"), ending))
    return table(spark, d, "pages").select("page_id", T.media_kind(url).alias("kind"))


@register("txt09_message_link", r"SELECT page_id, regexp_extract(url, '^https?://(?:m\.)?([a-z0-9.-]+)/[a-z]+/([0-9]+)', 1) AS channel, CAST(regexp_extract(url, '^https?://(?:m\.)?([a-z0-9.-]+)/[a-z]+/([0-9]+)', 2) AS BIGINT) AS message FROM pages WHERE regexp_matches(url, '^https?://(?:m\.)?([a-z0-9.-]+)/[a-z]+/([0-9]+)')")
def message_links(spark, d):
    pattern = r"^https?://(?:m\.)?([a-z0-9.-]+)/[a-z]+/([0-9]+)"
    found = table(spark, d, "pages").where(F.col("url").rlike(pattern))
    return found.select("page_id", F.regexp_extract("url", pattern, 1).alias("channel"), F.regexp_extract("url", pattern, 2).cast("bigint").alias("message"))


@register("txt09_telegram_links", r"""WITH l AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'https://t.me/s/' || source || '_ab/' WHEN 1 THEN 'http://www.telegram.me/' || lang || '_news/' WHEN 2 THEN 'https://t.me/' || lang || '/' WHEN 3 THEN 'https://t.me.example.org/abcd/' ELSE 'https://t.me/joinchat/x' END || CAST(doc_id AS VARCHAR) || '?x=1' AS url FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN regexp_extract(url, '/s/(.*)/', 1) ELSE regexp_extract(url, 'me/(.*)/', 1) END AS channel, doc_id AS message FROM l WHERE (doc_id % 5 = 0 AND regexp_full_match(regexp_extract(url, '/s/(.*)/', 1), '[A-Za-z0-9_]{4,}')) OR (doc_id % 5 = 1 AND length(regexp_extract(url, 'me/(.*)/', 1)) >= 4)""")
def telegram_links(spark, d):
    """Links of several forms made from documents' columns; short names, other hosts and invitations are no messages."""
    n, id_ = F.col("doc_id") % 5, F.col("doc_id").cast("string")
    start = F.when(n == 0, F.concat(F.lit("https://t.me/s/"), "source", F.lit("_ab/"))).when(n == 1, F.concat(F.lit("http://www.telegram.me/"), "lang", F.lit("_news/"))).when(n == 2, F.concat(F.lit("https://t.me/"), "lang", F.lit("/"))).when(n == 3, F.lit("https://t.me.example.org/abcd/")).otherwise(F.lit("https://t.me/joinchat/x"))
    links = table(spark, d, "documents").select("doc_id", T.message_link(F.concat(start, id_, F.lit("?x=1"))).alias("m"))
    return links.where("m IS NOT NULL").select("doc_id", "m.channel", "m.message")


@register("txt10_time_pairs", """SELECT doc_id, n_chars // 60 AS m1, (n_chars // 60) * 60 + n_chars % 60 AS start_s, (n_chars // 60 + 1) * 60 + n_chars % 60 AS end_s FROM documents""")
def pairs(spark, d):
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    m, s = F.floor(F.col("n_chars") / 60), F.col("n_chars") % 60
    text = F.concat(F.lit("from "), m.cast("string"), F.lit(":"), two(s), F.lit(" to "), (m + 1).cast("string"), F.lit(":"), two(s), F.lit(" and 9:99"))
    rows = table(spark, d, "documents").select("doc_id", m.alias("m1"), F.get(T.time_pairs(text), F.lit(0)).alias("p"))
    return rows.select("doc_id", "m1", F.col("p.start").alias("start_s"), F.col("p.end").alias("end_s"))


@register("txt11_sentences", r"SELECT doc_id, CAST(len(list_filter(string_split_regex(regexp_replace(text, '([.!?…])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s, ' ') <> '')) AS INTEGER) AS n_sentences FROM documents")
def sentence_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n_sentences"))


@register("txt12_duplicate_keys", sql("posts", body=rf" SELECT seq, sha256({NORMAL}) AS exact_key, substr(sha1(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))), 1, 16) AS loose_key FROM posts"))
def keys(spark, d):
    return view(spark, d, "posts").select("seq", T.exact_key(F.col("text")).alias("exact_key"), T.loose_key(F.col("text")).alias("loose_key"))


@register("txt12_token_key", sql("posts", body=r" SELECT seq, substr(sha1(array_to_string(regexp_extract_all(replace(lower(text), 'ё', 'е'), '[\p{L}\p{N}_]+'), ' ')), 1, 16) AS token_key FROM posts"))
def token_keys(spark, d):
    return view(spark, d, "posts").select("seq", T.token_key(F.col("text")).alias("token_key"))


@register("txt13_truncate", "SELECT page_id, substr(coalesce(html, ''), 1, 200) AS context, coalesce(nullif(regexp_extract(html, '<title>([^<]*)', 1), ''), 'untitled') AS title FROM pages")
def truncated(spark, d):
    return table(spark, d, "pages").select("page_id", F.left(F.coalesce("html", F.lit("")), F.lit(200)).alias("context"), F.coalesce(F.nullif(F.regexp_extract("html", "<title>([^<]*)", 1), F.lit("")), F.lit("untitled")).alias("title"))


@register("txt14_recode", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'REVIEWED' WHEN 'O' THEN 'PENDING' ELSE 'SCREENING' END AS status FROM orders")
def recoded(spark, d):
    status = R.lookup(F.col("o_orderstatus"), {"F": "REVIEWED", "O": "PENDING"}, "SCREENING")
    return table(spark, d, "orders").select("o_orderkey", status.alias("status"))


@register("txt15_reference_codes", "SELECT o_orderkey, 'SS-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS code FROM orders")
def codes(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.reference_code("SS", F.col("o_orderkey")).alias("code"))


@register("lex01_keyword_groups", sql("posts", body=KEYWORDS_SQL + " SELECT seq, harms, tone, victims FROM b"))
def keyword_groups(spark, d):
    return keyword_rows(spark, d).select("seq", F.array_join("harm_types", ",").alias("harms"), "tone", F.array_join("victims", ",").alias("victims"))


@register("lex02_keyword_classification", sql("posts", body=KEYWORDS_SQL + " SELECT seq, potential AS harm_potential, confidence FROM b"))
def keyword_classes(spark, d):
    return keyword_rows(spark, d).select("seq", "harm_potential", "confidence")


@register("lex03_region_lexicon", r"""WITH e AS (SELECT item_id, regexp_extract_all(lower(text), '[a-zà-ÿ]{7,}') AS w FROM benchmark WHERE item_id % 5 <> 0),
v AS (SELECT item_id, unnest(w[1:2]) AS w FROM e UNION ALL SELECT item_id, 'of' FROM e WHERE item_id % 7 = 1),
s AS (SELECT DISTINCT item_id, CASE WHEN w = 'of' THEN w ELSE substr(w, 1, greatest(5, length(w) - 2)) END AS stem, w = 'of' AS short FROM v),
t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM documents)
SELECT t.doc_id AS seq, array_to_string(list_sort(list(DISTINCT s.item_id)), ',') AS ids FROM t JOIN s ON CASE WHEN short THEN t.word IN ('of', 'ofs', 'ofes') ELSE starts_with(t.word, s.stem) END GROUP BY t.doc_id""")
def region_lexicon(spark, d):
    """Each benchmark item is an entry of one or two of its long words, with notes in brackets; some have a short one too."""
    n, found = F.col("item_id"), F.regexp_extract_all(F.lower("text"), F.lit("([a-zà-ÿ]{7,})"), 1)
    value = F.concat_ws(" / ", F.transform(F.slice(found, 1, 2), lambda w: F.concat(F.lit("«"), w, F.lit("» (a note)"))), F.when(n % 7 == 1, "of"))
    entries = table(spark, d, "benchmark").select(n.alias("id"), F.lit("term").alias("type"), F.when(n % 2 == 0, "en").alias("language"), F.when(n % 5 != 0, "approved").otherwise("draft").alias("status"), value.alias("value"))
    hits = L.lexicon_hits(view(spark, d, "posts"), entries, ("term",))
    return hits.select("seq", F.array_join("ids", ",").alias("ids"))


@register("lex04_term_patterns", r"""SELECT doc_id, regexp_matches(x, '(^|[^\p{L}\p{N}_])token(s|es|а|у|ом|е|и)?([^\p{L}\p{N}_]|$)') AS short_term, regexp_matches(x, '(^|[^\p{L}\p{N}_])worthle[\p{L}\p{N}_]*') AS long_term,
  regexp_matches(x, '(^|[^\p{L}\p{N}_])thor[\p{L}\p{N}_]*') AS prefix_term, regexp_matches(x, '(^|[^\p{L}\p{N}_])(child(s|es|а|у|ом|е|и)?|children)([^\p{L}\p{N}_]|$)') AS irregular,
  regexp_matches(x, '(^|[^\p{L}\p{N}_])c\+\+(s|es|а|у|ом|е|и)?([^\p{L}\p{N}_]|$)') AS signs, regexp_matches(x, '(^|[^\p{L}\p{N}_])the(s|es|а|у|ом|е|и)?\s+thoug[\p{L}\p{N}_]*') AS phrase
FROM (SELECT doc_id, lower(text) || CASE doc_id % 3 WHEN 0 THEN ' c++' WHEN 1 THEN ' c children' ELSE '' END AS x FROM documents) y""")
def term_patterns(spark, d):
    terms = {"short_term": "token", "long_term": "worthless", "prefix_term": "thor*", "irregular": "child", "signs": "c++", "phrase": "the thought"}
    added = F.when(F.col("doc_id") % 3 == 0, " c++").when(F.col("doc_id") % 3 == 1, " c children").otherwise("")
    hits = table(spark, d, "documents").select("doc_id", L.term_hits(F.concat("text", added), terms).alias("hits"))
    return hits.select("doc_id", *[F.array_contains("hits", name).alias(name) for name in terms])


@register("lex05_age_labels", r"""SELECT doc_id, array_to_string(list_filter([
  CASE WHEN doc_id % 30 BETWEEN 1 AND 17 OR doc_id % 7 = 5 THEN 'stated age' END, CASE WHEN doc_id % 7 = 1 THEN 'infant age' END, CASE WHEN doc_id % 7 = 2 THEN 'school grade' END,
  CASE WHEN regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])(newborn|pupil|toddle|orphana|kindergart|child)') OR doc_id % 7 = 3 THEN 'age term' END], lambda x: x IS NOT NULL), ',') AS labels FROM documents""")
def ages(spark, d):
    """Documents to which a number of years and, by turns, other indicators are added."""
    n = F.col("doc_id")
    other = F.get(F.array(*map(F.lit, ("", "six 3-month-old twins", "now in 7th grade", "a shkolnica won", "I'm 12 minutes late", "I’m only twelve", "top 12 items"))), (n % 7).cast("int"))
    text = F.concat(F.col("text"), F.lit(" . "), (n % 30).cast("string"), F.lit(" years old. "), other)
    return table(spark, d, "documents").select("doc_id", F.array_join(L.age_labels(text, L.age_table(spark)), ",").alias("labels"))


@register("lex06_merge_terms", f"SELECT DISTINCT lang, source AS list, value FROM (SELECT lang, source, unnest(string_split({NORMAL}, ' ')) AS value FROM documents) x WHERE value <> ''")
@register("lex06_all_terms", f"SELECT DISTINCT lang, source AS list, value FROM (SELECT lang, source, unnest(string_split({NORMAL}, ' ')) AS value FROM documents) x WHERE value <> ''")
def all_terms(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", F.col("source").alias("list"), F.explode(T.words(T.normalize_text(F.col("text")))).alias("value"))
    return L.merge_terms(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 <> 0 OR doc_id IS NULL"))


PATTERN_SQL = """, p AS (SELECT *, regexp_matches(lower(text), 'idiot|moron|scum') AS p1, regexp_matches(lower(text), 'thorst|inther') AS p2, regexp_matches(lower(text), 'licen[cs]e') AS p3, regexp_matches(lower(text), 'tionst') AS p4 FROM posts),
x AS (SELECT *, concat_ws(',', CASE WHEN p1 THEN 'pt-1' END, CASE WHEN p2 THEN 'pt-2' END, CASE WHEN p3 THEN 'pt-3' END, CASE WHEN p4 THEN 'pt-4' END) AS ids, CASE WHEN p1 OR p3 THEN 'strong' WHEN p2 OR p4 THEN 'weak' END AS strength FROM p)"""


def candidates(spark, d):
    rows = view(spark, d, "posts").withColumn("hits", L.pattern_hits(F.col("text"), L.pattern_table(spark)))
    return rows.withColumn("strength", L.strength(F.col("hits"))).where(F.col("strength").isNotNull())


@register("lex07_candidate_filter", sql("posts", body=PATTERN_SQL + " SELECT seq, ids, strength FROM x WHERE strength IS NOT NULL"))
def candidate_filter(spark, d):
    return candidates(spark, d).select("seq", F.expr("array_join(transform(hits, h -> h.id), ',')").alias("ids"), "strength")


@register("lex08_proximity", rf"""WITH t AS (SELECT doc_id, string_split({NORMAL}, ' ') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM t),
n AS (SELECT DISTINCT a.doc_id FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.i <> b.i AND abs(a.i - b.i) <= 3 WHERE a.word = 'the' AND regexp_matches(b.word, 'tion$'))
SELECT doc_id, doc_id IN (SELECT doc_id FROM n) AS near FROM documents""")
def proximity(spark, d):
    return table(spark, d, "documents").select("doc_id", L.near(F.col("text"), "^the$", "tion$", 3).alias("near"))


@register("lex09_same_sentence", r"""SELECT doc_id, coalesce(len(list_filter(string_split_regex(regexp_replace(text, '([.!?…])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: regexp_matches(lower(s), 'idiot|moron|scum') AND regexp_matches(lower(s), '\bthe\b'))) > 0, false) AS together FROM documents""")
def same_sentence(spark, d):
    hit = lambda s: L.any_match(s, ["idiot|moron|scum"]) & L.any_match(s, [r"\bthe\b"])
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.exists(T.sentences(F.col("text")), hit), F.lit(False)).alias("together"))


@register("lex09_age_beside_hit", r"""SELECT doc_id, doc_id % 2 = 0 AND doc_id % 30 BETWEEN 1 AND 17 OR coalesce(len(list_filter(string_split_regex(regexp_replace(lower(text), '([.!?…])\s+', '\1' || chr(10), 'g'), '\n+'),
  lambda s: regexp_matches(s, 'idiot|moron|scum|thorst|inther|licen[cs]e|tionst') AND regexp_matches(s, '(^|[^\p{L}\p{N}_])(newborn|pupil|toddle|orphana|kindergart|child)'))) > 0, false) AS together FROM documents""")
def age_beside(spark, d):
    """Documents to which an age is added, by turns in the sentence of a pattern's word or in the one before it."""
    n = F.col("doc_id")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" . It says "), (n % 30).cast("string"), F.when(n % 2 == 0, " years old, scum.").otherwise(" years old. Just scum."))
    return table(spark, d, "documents").select("doc_id", L.age_beside(text, L.pattern_table(spark), L.age_table(spark)).alias("together"))


@register("lex10_keyword_slices", sql("scored", body=", k AS (SELECT s.*, regexp_matches(lower(d.text), 'idiot|scum|clown') AS has FROM scored s JOIN documents d ON s.item_id = d.doc_id) SELECT y, has, count(*) AS n, avg(score) AS mean_score FROM k GROUP BY y, has"))
def keyword_slices(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), L.any_match(F.col("text"), ["idiot|scum|clown"]).alias("has"))
    return view(spark, d, "scored").join(docs, "item_id").groupBy("y", "has").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))


@register("lex11_unknown_ids", r"""WITH c AS (SELECT doc_id, 'See HI-' || CAST(doc_id % 9 AS VARCHAR) || ' and CH-' || CAST(doc_id % 5 AS VARCHAR) || '.' AS t FROM documents)
SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(t, '([A-Z]{2,6}-[0-9]+)', 1)), lambda x: NOT (x IN ('HI-1', 'HI-2', 'CH-1', 'CH-2')))), ',') AS unknown FROM c""")
def unknown(spark, d):
    text = F.concat(F.lit("See HI-"), (F.col("doc_id") % 9).cast("string"), F.lit(" and CH-"), (F.col("doc_id") % 5).cast("string"), F.lit("."))
    return table(spark, d, "documents").select("doc_id", F.array_join(L.unknown_ids(text, ["HI-1", "HI-2", "CH-1", "CH-2"]), ",").alias("unknown"))


@register("lex11_undefined_in_corpus", r"""WITH c AS (SELECT doc_id, 'See HI-' || CAST(doc_id % 9 AS VARCHAR) || ' and CH-' || CAST(doc_id % 5 AS VARCHAR) || '.' || coalesce(text, '') AS t FROM documents),
i AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(t, '\b([A-Z]{2,6}-[0-9]+)\b', 1)) AS id FROM c)
SELECT id, count(*) AS documents, min(doc_id) AS first_doc FROM i WHERE id NOT IN (SELECT 'HI-' || CAST(item_id % 6 AS VARCHAR) FROM benchmark UNION SELECT 'CH-' || CAST(item_id % 3 AS VARCHAR) FROM benchmark) GROUP BY id""")
def undefined(spark, d):
    """Ids that documents cite and no entry defines, over the whole corpus."""
    text = F.concat(F.lit("See HI-"), (F.col("doc_id") % 9).cast("string"), F.lit(" and CH-"), (F.col("doc_id") % 5).cast("string"), F.lit("."), F.coalesce("text", F.lit("")))
    n = F.col("item_id")
    defined = table(spark, d, "benchmark").select(F.explode(F.array(F.concat(F.lit("HI-"), (n % 6).cast("string")), F.concat(F.lit("CH-"), (n % 3).cast("string")))).alias("id"))
    return L.undefined_ids(table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.alias("text")), defined).withColumnRenamed("cited", "id")


@register("lex12_merge_hits", "SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 3 = 0 THEN 'a' END, CASE WHEN doc_id % 2 = 0 THEN 'b' END, CASE WHEN doc_id % 5 = 0 THEN 'c' END) AS hits, CASE WHEN lang IN ('en', 'de') THEN CAST(doc_id % 11 AS DOUBLE) / 10 ELSE least(CAST(doc_id % 11 AS DOUBLE) / 10, 0.5) END AS confidence FROM documents")
def merged_hits(spark, d):
    when = lambda c, v: F.when(c, F.lit(v))
    a = F.array_compact(F.array(when(F.col("doc_id") % 3 == 0, "a"), when(F.col("doc_id") % 2 == 0, "b")))
    b = F.array_compact(F.array(when(F.col("doc_id") % 2 == 0, "b"), when(F.col("doc_id") % 5 == 0, "c")))
    sure = (F.col("doc_id") % 11).cast("double") / 10
    capped = F.when(F.col("lang").isin("en", "de"), sure).otherwise(F.least(sure, F.lit(0.5)))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(F.array_union(a, b)), ",").alias("hits"), capped.alias("confidence"))


@register("rul05_triage_bucket", sql("posts", body=KEYWORDS_SQL + " SELECT bucket, count(*) AS n FROM b GROUP BY bucket"))
def buckets(spark, d):
    return keyword_rows(spark, d).groupBy("bucket").agg(F.count("*").alias("n"))


@register("rul06_review_score", sql("posts", body=KEYWORDS_SQL + " SELECT seq, round(CASE bucket WHEN 'escalate' THEN 3 WHEN 'harmful' THEN 2 WHEN 'potentially_harmful' THEN 1 ELSE 0 END * 100 + potential * 10 + log10(reach + 1), 6) AS score FROM b"))
def review_scores(spark, d):
    return keyword_rows(spark, d).select("seq", F.round("score", 6).alias("score"))


@register("rul10_keyword_detection", sql("posts", body=KEYWORDS_SQL + """ SELECT seq, CASE bucket WHEN 'escalate' THEN 'restricted_escalation' WHEN 'harmful' THEN 'priority_review' WHEN 'potentially_harmful' THEN 'standard_review' ELSE 'not_flagged' END AS route,
  CASE bucket WHEN 'escalate' THEN 'urgent' WHEN 'harmful' THEN 'high' WHEN 'potentially_harmful' THEN 'standard' ELSE 'none' END AS priority, bucket = 'escalate' AS restricted,
  CASE WHEN bucket = 'escalate' THEN NULL WHEN harms = '' THEN 'none' ELSE string_split(harms, ',')[1] END AS category FROM b"""))
def detections(spark, d):
    rows = keyword_rows(spark, d)
    route = lambda i: R.lookup(F.col("bucket"), {k: v[i] for k, v in R.BUCKET_ROUTES.items()})
    rows = rows.select("seq", route(0).alias("route"), route(1).alias("priority"), (F.col("bucket") == "escalate").alias("possible_minor"), F.lit(False).alias("restricted"), F.when(F.size("harm_types") > 0, F.element_at("harm_types", 1)).otherwise("none").alias("category"))
    return R.apply_restriction(rows).select("seq", "route", "priority", "restricted", "category")


FLAGSHIP = sql("posts", body=KEYWORDS_SQL + f""", g AS (SELECT seq, sha256({NORMAL}) AS key, channel FROM posts),
o AS (SELECT key, min(seq) AS owner, count(*) AS copies, count(DISTINCT channel) AS channels FROM g GROUP BY key)
SELECT o.owner AS group_id, o.copies, o.channels, CASE bucket WHEN 'escalate' THEN 'restricted_escalation' WHEN 'harmful' THEN 'priority_review' WHEN 'potentially_harmful' THEN 'standard_review' ELSE 'not_flagged' END AS route,
  CASE bucket WHEN 'escalate' THEN 'urgent' WHEN 'harmful' THEN 'high' WHEN 'potentially_harmful' THEN 'standard' ELSE 'none' END AS priority,
  CAST(row_number() OVER (ORDER BY CASE bucket WHEN 'escalate' THEN 0 WHEN 'harmful' THEN 1 WHEN 'potentially_harmful' THEN 2 ELSE 3 END, copies DESC, o.owner) AS INTEGER) AS place
FROM o JOIN b ON b.seq = o.owner WHERE bucket <> 'not_harmful'""")


@register("flagship_review_queue", FLAGSHIP)
def flagship(spark, d):
    """Exact copies grouped, one representative judged, routed, and ordered by urgency and number of copies.

    One scan and one shuffle by key; the places come from ranges of the order, so no task has the whole queue.
    """
    rows = keyword_rows(spark, d).select("seq", "channel", "bucket", T.exact_key(F.col("text")).alias("key"))
    groups = rows.groupBy("key").agg(F.min("seq").alias("group_id"), F.min_by("bucket", "seq").alias("bucket"), F.count("*").alias("copies"), F.countDistinct("channel").alias("channels"))
    route = lambda i: R.lookup(F.col("bucket"), {k: v[i] for k, v in R.BUCKET_ROUTES.items()})
    judged = groups.where("bucket <> 'not_harmful'").select("group_id", "copies", "channels", "bucket", route(0).alias("route"), route(1).alias("priority"))
    placed = ranked(judged, (-R.lookup(F.col("bucket"), R.BUCKET_RANK)).alias("_a"), (-F.col("copies")).alias("_b"), F.col("group_id").alias("_c"))
    return placed.select("group_id", "copies", "channels", "route", "priority", F.col("place").cast("int").alias("place"))


@register("grp02_simhash_md5", f"WITH {simhash_sql('documents', 'doc_id')} SELECT id, value AS simhash FROM values_documents")
def simhash(spark, d):
    return simhash_md5(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
