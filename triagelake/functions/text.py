"""Column expressions over texts and links."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts that mean the same site, prefixes and query keys that do not change what a link shows.
HOST_ALIASES = {"twitter.com": "x.com", "fb.com": "facebook.com", "telegram.me": "t.me", "vm.tiktok.com": "tiktok.com"}
HOST_PREFIXES = ("www.", "m.", "mobile.", "web.")
TRACKING = ("fbclid", "igshid", "igsh", "si", "s", "t", "ref", "ref_src", "ref_url", "_rdr", "mibextid", "feature")
PLATFORMS = {"t.me": "Telegram", "facebook.com": "Facebook", "instagram.com": "Instagram", "tiktok.com": "TikTok", "x.com": "X"}

# Endings of media links.
IMAGES, FILMS = ("jpg", "jpeg", "png", "webp", "gif", "heic"), ("mp4", "webm", "mov", "m3u8")

# Letters that look alike, Latin or digit on the left, Cyrillic on the right.
LOOKS, MEANS = "@03aeopcxykmtbh", "аозаеорсхукмтвн"
CYRILLIC = "[а-яіїєґё]"

# Latin spellings of Cyrillic letters, longest first, then letter by letter.
SPELLINGS = (("shch", "щ"), ("sch", "щ"), ("zh", "ж"), ("kh", "х"), ("ch", "ч"), ("sh", "ш"), ("ts", "ц"), ("yu", "ю"), ("ya", "я"), ("ye", "е"), ("yo", "е"), ("ju", "ю"), ("ja", "я"))
SINGLE, LETTER = "abvgdezijklmnoprstufhcwx", "абвгдезийклмнопрстуфхцвк"

WORD = r"[\p{L}\p{N}_]"


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def composed(text: pa.Array) -> pa.Array:
    return pa.array([unicodedata.normalize("NFKC", t.as_py()) if t.is_valid else None for t in text], pa.string())


#: A sign that is none of the letters which compatibility composition leaves as they are; only texts with one are sent to
#: Python. One class of all ranges would cost several times the rest of the normalising, as most signs are plain ones.
COMPOSED = "[^\\x00-\\x7F](?<![À-ÖØ-öø-ıĴ-ľŁ-ňŊ-žЀ-ҁҊ-ӿ])"


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition, which Spark has no function for."""
    return F.coalesce(F.arrow_udf(composed, "string")(F.when(text.rlike(COMPOSED), text)), text)


def normalize_text(text: Column, compose: bool = True) -> Column:
    """Lower case without links, mentions and signs, single spaces; null becomes empty. NFKC comes first, so that wide
    letters and ligatures are the plain ones; a caller that knows its texts are composed may leave that out."""
    text = F.coalesce(nfkc(text) if compose else text, F.lit(""))
    text = F.regexp_replace(F.lower(text), r"https?://\S+|www\.\S+", " ")
    text = F.regexp_replace(text, rf"@{WORD}+", " ")
    return F.trim(F.regexp_replace(text, r"[^a-z\p{L}\p{N}_]+", " "))  # white space is no letter; a-z, asked first, are most of them


def words(normalised: Column) -> Column:
    return F.when(normalised == "", F.array().cast("array<string>")).otherwise(F.split(normalised, " "))


def runs(text: Column, pattern: str, change) -> Column:
    """The text with every run that matches ``pattern`` (a character class) changed, what stands between as it is."""
    parts = F.regexp_extract_all(text, F.lit(f"({pattern}+|(?:(?!{pattern})[\\s\\S])+)"), 1)
    return F.array_join(F.transform(parts, change), "")


def unmask(text: Column) -> Column:
    """Lower case; look-alike signs become Cyrillic letters, but only in words that have a Cyrillic letter already. A word
    is what stands between white space of any kind."""
    text = F.regexp_replace(F.lower(text), "ё", "е")
    return runs(text, r"\S", lambda w: F.when(w.rlike(CYRILLIC), F.translate(w, LOOKS, MEANS)).otherwise(w))


def transliterate(text: Column) -> Column:
    """Latin spelling of Cyrillic text back to Cyrillic letters, in every run of Latin letters; y after a vowel of the run
    is short."""

    def of(run: Column) -> Column:
        for a, b in SPELLINGS:
            run = F.regexp_replace(run, a, b)
        run = F.regexp_replace(run, "(?<=[аеиоуяюэ])y", "й")
        return F.translate(run, "y" + SINGLE, "ы" + LETTER)

    return runs(text, "[a-z]", lambda w: F.when(w.rlike("^[a-z]"), of(w)).otherwise(w))


LIKE, HAS_CYRILLIC = str.maketrans(LOOKS, MEANS), re.compile(CYRILLIC).search
LATIN, SHORT_Y, LETTERS = re.compile("[a-z]+"), re.compile("(?<=[аеиоуяюэ])y"), str.maketrans("y" + SINGLE, "ы" + LETTER)


def unmask_chunk(chunk: str) -> str:
    """``unmask`` of what stands between white space, for tasks that change each distinct chunk once; lower case is given."""
    chunk = chunk.replace("ё", "е")
    return chunk.translate(LIKE) if HAS_CYRILLIC(chunk) else chunk


def transliterate_chunk(chunk: str) -> str:
    """``transliterate`` of what stands between white space."""
    return LATIN.sub(lambda run: transliterate_run(run[0]), chunk)


def transliterate_run(run: str) -> str:
    """``transliterate`` where no Cyrillic letter stands before a Latin one, as in plain signs, be it one run or many."""
    for a, b in SPELLINGS:
        run = run.replace(a, b)
    return SHORT_Y.sub("й", run).translate(LETTERS)


def count_of(text: Column, letters: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{letters}]"))


def guess_lang(text: Column) -> Column:
    """Language by letters that one alphabet has alone; other Cyrillic is ru, any Latin letter en, the rest other."""
    uk, ru = count_of(F.lower(text), "іїєґ"), count_of(F.lower(text), "ыэъё")
    return (
        F.when(text.isNull(), "other")
        .when((uk > 0) | (ru > 0), F.when(uk > ru, "uk").otherwise("ru"))
        .when(F.lower(text).rlike(CYRILLIC), "ru")
        .when(F.lower(text).rlike("[a-z]"), "en")
        .otherwise("other")
    )


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[^?#]*\?([^#]*)", 1)


def host_key(url: Column) -> Column:
    """Lower-case host without one mobile or www prefix, aliases resolved."""
    host = F.regexp_replace(host_of(url), r"^(?:" + "|".join(p.replace(".", r"\.") for p in HOST_PREFIXES) + ")", "")
    for a, b in HOST_ALIASES.items():
        host = F.when(host == a, b).otherwise(host)
    return host


def normalize_url(url: Column) -> Column:
    """One string for every link to the same post: https, host key, path without trailing slashes, sorted query without
    tracking keys, no fragment. Null stays null."""
    pairs = F.filter(F.split(query_of(url), "&"), lambda p: p != "")
    key = lambda p: F.lower(F.element_at(F.split(p, "=", 2), 1))
    pairs = F.filter(pairs, lambda p: ~key(p).isin(*TRACKING) & ~key(p).startswith("utm_"))
    part = lambda p, i: F.url_encode(F.coalesce(F.try_url_decode(F.coalesce(F.get(F.split(p, "=", 2), F.lit(i)), F.lit(""))), F.lit("")))
    query = F.array_join(F.transform(F.array_sort(F.transform(pairs, lambda p: F.struct(part(p, 0).alias("k"), part(p, 1).alias("v")))), lambda s: F.concat(s.k, F.lit("="), s.v)), "&")
    path = F.regexp_replace(path_of(url), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    return F.concat(F.lit("https://"), host_key(url), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def platform_of(url: Column) -> Column:
    host = host_key(url)
    out = F.lit("Web")
    for h, name in PLATFORMS.items():
        out = F.when(host == h, name).otherwise(out)
    return out


def on_hosts(url: Column, hosts: tuple[str, ...]) -> Column:
    """https, and the host is one of ``hosts`` or below one."""
    own = host_of(url)
    hit = F.lit(False)
    for h in hosts:
        hit = hit | (own == h) | own.endswith("." + h)
    return F.lower(F.trim(url)).startswith("https://") & hit


def media_kind(url: Column) -> Column:
    """image or video by the ending of the path, null for anything else."""
    path = F.lower(path_of(url))
    return F.when(path.rlike(rf"\.(?:{'|'.join(IMAGES)})$"), "image").when(path.rlike(rf"\.(?:{'|'.join(FILMS)})$"), "video")


def time_pairs(text: Column) -> Column:
    """Pairs of mm:ss or hh:mm:ss in a text as array<struct<start,end>> seconds; an odd time at the end is left out."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+(?::\d{2}){1,2})"), 1)
    seconds = F.transform(found, lambda t: F.aggregate(F.split(t, ":"), F.lit(0).cast("long"), lambda a, x: a * 60 + x.cast("long")))
    pairs = F.sequence(F.lit(0), (F.size(seconds) / 2).cast("int") - 1)
    at = lambda i: F.get(seconds, i)
    return F.when(F.size(seconds) < 2, F.array().cast("array<struct<start:bigint,end:bigint>>")).otherwise(F.transform(pairs, lambda i: F.struct(at(i * 2).alias("start"), at(i * 2 + 1).alias("end"))))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?…])\s+|\n+"), lambda s: F.trim(s) != "")


def exact_key(text: Column) -> Column:
    """sha256 of the normalised text. It is never null, which the coalesce says: joins on it would else normalise each text
    once more for a null test."""
    return F.coalesce(F.sha2(normalize_text(text), 256), F.lit(""))


def token_key(text: Column) -> Column:
    """First 16 digits of sha1 over the word tokens of the unmasked text."""
    return F.substring(F.sha1(F.array_join(F.regexp_extract_all(unmask(text), F.lit(rf"({WORD}+)"), 1), " ")), 1, 16)


def loose_key(text: Column) -> Column:
    """First 16 digits of sha1 over the lower-cased text with single spaces."""
    return F.substring(F.sha1(squeeze(F.lower(text))), 1, 16)


def reference_code(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.lpad(number.cast("string"), 6, "0"))


# Fixed value: links of messages; the channel's name, then the message's number.
MESSAGE = r"^https?://(?:www\.)?(?:t\.me|telegram\.me)/(?:s/)?([A-Za-z0-9_]{4,})/([0-9]+)"


def message_link(url: Column) -> Column:
    """struct<channel,message> of a message's link; null for any other link."""
    return F.when(url.rlike(MESSAGE), F.struct(F.regexp_extract(url, MESSAGE, 1).alias("channel"), F.regexp_extract(url, MESSAGE, 2).try_cast("bigint").alias("message")))
