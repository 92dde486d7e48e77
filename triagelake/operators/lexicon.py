"""Matching of rule tables against texts. Vocabularies are data: what ships here is a neutral demonstration."""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.functions.text import normalize_text, sentences, unmask, words
from triagelake.operators.terms import SILENT, Ages, Indicators, Terms, built, conditions

#: Demonstration tables; an installation brings its own as DataFrames of the same columns. What a row says: of a kind
#: (harm, tone, subject), the group and a pattern of it; groups come in the order of ``place``.
GROUPS = (
    ("harm", 1, "insult", "idiot|moron"), ("harm", 1, "insult", "clown"), ("harm", 2, "degradation", "worthless"), ("harm", 2, "degradation", "scum|trash"),
    ("harm", 3, "claim", "thorst"), ("harm", 3, "claim", "heard (that|from)"), ("tone", 1, "reporting", "license"), ("tone", 1, "reporting", "reserved"),
    ("tone", 2, "testimony", "there was"), ("tone", 3, "awareness", "token"), ("subject", 1, "group", "stupid"), ("subject", 2, "person", "loser|pathetic"),
)
GROUP_COLUMNS = "kind string, place int, group string, pattern string"
WEAK = ("claim",)
SEVERE = ("degradation",)
#: (id, strength, pattern)
PATTERNS = (("pt-1", "strong", "idiot|moron|scum"), ("pt-2", "weak", "thorst|inther"), ("pt-3", "strong", "licen[cs]e"), ("pt-4", "weak", "tionst"))
#: A table of patterns becomes one expression a row, so it has a bound; larger vocabularies are joined (``lexicon_hits``).
MOST_PATTERNS = 2_000
LITERALS = re.compile(r"[\w ]+(?:\|[\w ]+)*")
#: Terms of one machine (some 100 MB in a worker); more take several passes.
MOST_TERMS = 200_000


def rows_of(table: DataFrame) -> list:
    """The rows of a table of patterns, on the driver; more than MOST_PATTERNS are an error."""
    rows = table.limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns: match them with lexicon_hits")
    return rows


def group_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GROUPS, GROUP_COLUMNS)


def groups_of(table: DataFrame) -> dict[str, dict[str, list[str]]]:
    """kind -> group -> patterns of a table with GROUP_COLUMNS, in order."""
    out: dict[str, dict[str, list[str]]] = {}
    for r in sorted(rows_of(table), key=lambda r: (r["kind"], r["place"])):
        out.setdefault(r["kind"], {}).setdefault(r["group"], []).append(r["pattern"])
    return out


def any_match(text: Column, patterns: list[str], lowered: bool = False) -> Column:
    """Whether one of the patterns is in the lower-cased text; plain words are searched for as they are. A caller that has
    the text in lower case already says so."""
    low = text if lowered else F.lower(text)
    one = lambda p: reduce(lambda a, b: a | b, [low.contains(w) for w in p.split("|")]) if LITERALS.fullmatch(p) else low.rlike(p)
    return reduce(lambda a, b: a | b, map(one, patterns), F.lit(False))


def groups_hit(text: Column, groups: dict[str, list[str]]) -> Column:
    """Names of the groups with a match, in the table's order; empty for null."""
    return F.coalesce(F.array_compact(F.array(*[F.when(any_match(text, p), name) for name, p in groups.items()])), F.array().cast("array<string>"))


def first_group(text: Column, groups: dict[str, list[str]]) -> Column:
    return F.coalesce(*[F.when(any_match(text, p), F.lit(name)) for name, p in groups.items()])


def classify(posts: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Adds harm_types, tone, victims, harm_potential and confidence of the keyword baseline to posts with ``text``; the
    vocabulary is a table with GROUP_COLUMNS.

    A safe tone clears weak harms when nothing else was hit. A severe harm gives potential 2, with a second harm 3; other
    harms give 1 at low confidence.
    """
    groups = groups_of(group_table(posts.sparkSession) if table is None else table)
    hits = {"harm_types": groups_hit(F.col("text"), groups["harm"]), "tone": first_group(F.col("text"), groups["tone"]), "victims": groups_hit(F.col("text"), groups["subject"])}
    out = posts.withColumns(hits)
    strong = F.exists("harm_types", lambda h: ~h.isin(*WEAK))
    out = out.withColumn("harm_types", F.when(F.col("tone").isNotNull() & ~strong, F.array().cast("array<string>")).otherwise(F.col("harm_types")))
    victims = F.col("victims")
    severe = F.exists("harm_types", lambda h: h.isin(*SEVERE))
    some = F.size("harm_types") > 0
    potential = F.when(severe & (F.size("harm_types") > 1), 3).when(severe, 2).when(some, 1).otherwise(0)
    out = out.withColumns({"tone": F.coalesce("tone", F.lit("serious")), "victims": F.when(F.size(victims) > 0, victims).otherwise(F.array(F.lit("unidentifiable"))), "harm_potential": potential})
    return out.withColumn("confidence", F.when(some & (F.col("harm_potential") < 2), "low").otherwise("medium"))


def pattern_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PATTERNS, "id string, strength string, pattern string")


def pattern_hits(text: Column, table: DataFrame | None = None, lowered: bool = False) -> Column:
    """array<struct<id,strength>> of the (id, strength, pattern) rows that match, by id."""
    table = pattern_table(SparkSession.active()) if table is None else table
    patterns = [(r["id"], r["strength"], r["pattern"]) for r in sorted(rows_of(table), key=lambda r: r["id"])]
    one = lambda i, s, p: F.when(any_match(text, [p], lowered), F.struct(F.lit(i).alias("id"), F.lit(s).alias("strength")))
    return F.array_compact(F.array(*[one(*p) for p in patterns]))


def strength(hits: Column) -> Column:
    return F.when(F.exists(hits, lambda h: h.strength == "strong"), "strong").when(F.size(hits) > 0, "weak")


def term_words(term: Column) -> Column:
    """array<struct<plain,prefix>>: the words of a term, look-alike letters read as in texts; * at the end makes a prefix."""
    return F.transform(F.filter(F.split(F.trim(term), r"\s+"), lambda w: w != ""), lambda w: F.struct(unmask(F.regexp_replace(w, r"\*$", "")).alias("plain"), w.endswith("*").alias("prefix")))


def sent(terms: DataFrame, most: int = MOST_TERMS):
    """Rows of (name, words) as broadcast lists, so many a list at most that its machine fits a worker."""
    n = terms.count()
    rounds = -(-n // most)
    dealt = terms.withColumn("_round", F.pmod(F.xxhash64("words"), F.lit(max(rounds, 1))))
    for k in range(rounds):
        rows = dealt.where(F.col("_round") == k).select("name", "words").collect()
        yield terms.sparkSession.sparkContext.broadcast([(r["name"], [(w["plain"], w["prefix"]) for w in r["words"]]) for r in rows])


def term_hits(text: Column, terms: dict[str, str]) -> Column:
    """Sorted names of the terms (name -> term, a small table) that are in a text."""
    spark = SparkSession.active()
    rows = spark.createDataFrame(list(terms.items()), "name string, term string").select("name", term_words(F.col("term")).alias("words"))
    (shared,) = sent(rows)
    return F.pandas_udf(lambda texts: texts.map(lambda t: sorted(built(shared).find(t))), "array<string>")(unmask(text))


def variants(value: Column) -> Column:
    """array of the terms that an entry names, apart by / ; what is in brackets and quotation marks are left out."""
    plain = F.regexp_replace(F.regexp_replace(value, r"\([^)]*\)", ""), "[«»\"]", "")
    return F.filter(F.transform(F.split(plain, "/"), lambda v: F.trim(v)), lambda v: v != "")


def near(text: Column, a: str, b: str, window: int) -> Column:
    """Whether a word matching ``a`` stands at most ``window`` words from another one matching ``b``; one pass over the
    words, with the place where each was seen last."""
    kinds = F.transform(words(normalize_text(text)), lambda t: t.rlike(a).cast("int") + 2 * t.rlike(b).cast("int"))
    never = F.lit(-1_000_000_000)
    start = F.struct(F.lit(0).alias("i"), never.alias("a"), never.alias("b"), F.lit(False).alias("hit"))

    def step(s: Column, k: Column) -> Column:
        is_a, is_b = k.bitwiseAND(F.lit(1)) > 0, k > 1
        hit = s.hit | (is_a & (s.i - s.b <= window)) | (is_b & (s.i - s.a <= window))
        return F.struct((s.i + 1).alias("i"), F.when(is_a, s.i).otherwise(s.a).alias("a"), F.when(is_b, s.i).otherwise(s.b).alias("b"), hit.alias("hit"))

    return F.aggregate(kinds, start, step).hit


def lexicon_hits(docs: DataFrame, entries: DataFrame, types: tuple[str, ...] | None = None, most: int = MOST_TERMS) -> DataFrame:
    """(seq, ids): sorted distinct ids of the approved entries (id, type, language, status, value) of the given types with
    a term in the text. Entries of language ``multi`` describe more than words and match nothing.

    The terms are sent around as a machine that runs in one pass over each text; texts are not shuffled, and rows that
    repeat a ``seq`` or have none are each answered. More than ``most`` terms take several passes.
    """
    usable = entries.where((F.col("status") == "approved") & (F.coalesce(F.col("language"), F.lit("")) != "multi"))
    usable = usable.where(F.col("type").isin(*types)) if types else usable
    terms = usable.select(F.col("id").alias("name"), F.explode(variants(F.col("value"))).alias("term")).select("name", term_words(F.col("term")).alias("words")).distinct()
    of_id = entries.schema["id"].dataType.simpleString()
    seq = docs.schema["seq"].dataType.simpleString()
    out = docs.select("seq", unmask(F.col("text")).alias("plain"), F.array().cast(f"array<{of_id}>").alias("ids"))
    for shared in sent(terms, most):

        def run(batches, shared=shared):
            terms = built(shared)
            for batch in batches:
                found = [[*before, *terms.find(text)] for text, before in zip(batch["plain"].to_pylist(), batch["ids"].to_pylist())]
                yield pa.record_batch([batch["seq"], batch["plain"], pa.array(found, batch["ids"].type)], ["seq", "plain", "ids"])

        out = out.mapInArrow(run, f"seq {seq}, plain string, ids array<{of_id}>")
    return out.where(F.size("ids") > 0).select("seq", F.array_sort(F.array_distinct("ids")).alias("ids"))


def merge_terms(*tables: DataFrame) -> DataFrame:
    """Union of (lang, list, value) tables without repetition; terms are only ever added."""
    return reduce(lambda a, b: a.unionByName(b), tables).select("lang", "list", "value").distinct()


#: A neutral table of age terms (language, kind, value, number); an installation adds its own languages. Kinds: ``word``
#: and ``institution`` are terms; ``unit`` (years, with a number below 18), ``infant`` (days, weeks, months, with any
#: number), ``number`` (a number written as a word), ``phrase`` and ``grade`` ({n} stands for the number), ``stop`` (what
#: makes the number of a phrase no age).
AGE_TERMS = (
    ("en", "word", "newborn", None), ("en", "word", "pupil", None), ("en", "word", "toddler", None), ("en", "word", "child", None), ("en", "institution", "orphanage", None),
    ("en", "institution", "kindergarten", None), ("en", "unit", "years old", None), ("en", "unit", "year old", None), ("en", "unit", "yr old", None), ("en", "unit", "yrs old", None),
    ("en", "infant", "month* old", None), ("en", "infant", "week* old", None), ("en", "infant", "day* old", None), ("en", "number", "one", 1), ("en", "number", "five", 5),
    ("en", "number", "twelve", 12), ("en", "number", "fifteen", 15), ("en", "number", "twenty", 20), ("en", "phrase", "i'm only {n}", None), ("en", "phrase", "she's {n}", None),
    ("en", "phrase", "i'm {n}", None), ("en", "stop", "minutes", None), ("en", "stop", "years", None), ("en", "stop", "percent", None), ("en", "grade", "{n}th grade", None), ("en", "grade", "{n}st grade", None), ("en", "grade", "{n}nd grade", None),
    ("en", "grade", "{n}rd grade", None), ("en", "grade", "grade {n}", None),
    ("ru", "word", "ученик*", None), ("ru", "word", "школьниц*", None), ("ru", "unit", "лет", None), ("ru", "unit", "года", None), ("ru", "number", "двенадцать", 12), ("ru", "phrase", "ей {n},", None),
    ("ru", "grade", "{n} класса", None),
)
AGE_COLUMNS = "lang string, kind string, value string, number int"


def age_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AGE_TERMS, AGE_COLUMNS)


def age_terms(table: DataFrame):
    """The rows of a table with AGE_COLUMNS and their terms as words, sent around."""
    rows = [r.asDict() for r in rows_of(table)]
    terms = table.where(F.col("kind").isin("word", "institution")).select(F.lit("age term").alias("name"), term_words(F.col("value")).alias("words")).collect()
    words = [("age term", [(w["plain"], w["prefix"]) for w in r["words"]]) for r in terms]
    return table.sparkSession.sparkContext.broadcast((rows, words))


def age_labels(text: Column, table: DataFrame | None = None) -> Column:
    """Kinds of age indicator in a text (never the words), by a table with AGE_COLUMNS: a stated age, an infant's age, a
    school class, a term. Terms are also found in Latin spelling; soft and hard signs do not count."""
    table = age_table(SparkSession.active()) if table is None else table
    shared = age_terms(table)

    def of(lows: pd.Series) -> pd.Series:
        return pd.Series([[label for label in LABELS if label in found] for found in map(indicators(shared).find, lows)])

    return F.pandas_udf(of, "array<string>")(F.lower(text))


def age_beside(text: Column, patterns: DataFrame | None = None, table: DataFrame | None = None) -> Column:
    """Whether an age indicator stands in the same sentence as a hit of a pattern; false for a null text. Only sentences
    with a hit are searched for ages."""
    session = SparkSession.active()
    patterns = pattern_table(session) if patterns is None else patterns
    sought = [r["pattern"] for r in rows_of(patterns)]
    hit = F.filter(sentences(text), lambda s: any_match(s, sought))
    shared = age_terms(age_table(session) if table is None else table)

    def of(lows: pd.Series) -> pd.Series:
        find = indicators(shared).find
        return pd.Series([any(map(find, low)) if low is not None else False for low in lows])

    return F.pandas_udf(of, "boolean")(F.transform(hit, F.lower))


LABELS = ("stated age", "infant age", "school grade", "age term")


@lru_cache(maxsize=4)
def indicators(shared) -> Indicators:
    """Built once in each worker. Soft and hard signs don't count, so a long word's stem is taken first."""
    rows, terms = shared.value
    beginning = lambda plain, prefix: (conditions(plain, prefix)[0].literal.translate(SILENT), prefix or len(plain) > 5)
    return Indicators(Ages(rows), Terms([(name, [beginning(*w) for w in words]) for name, words in terms]))


def unknown_ids(text: Column, defined: list[str]) -> Column:
    """Cited ids (two letters, dash, number) of a text that no table defines, sorted."""
    cited = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z]{2,6}-[0-9]+)\b"), 1))
    return F.array_sort(F.array_except(cited, F.array(*map(F.lit, defined)) if defined else F.array().cast("array<string>")))


def undefined_ids(rows: DataFrame, defined: DataFrame) -> DataFrame:
    """(cited, documents, first_doc): ids that texts of (id, text) cite and no row of ``defined`` (id) has; how many rows
    cite each, and the first of them. A row that cites an id several times counts once."""
    cited = rows.select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b([A-Z]{2,6}-[0-9]+)\b"), 1))).alias("cited"))
    counts = cited.groupBy("cited").agg(F.count("*").alias("documents"), F.min("id").alias("first_doc"))
    return counts.join(defined.select(F.col("id").alias("cited")).distinct(), "cited", "left_anti")
