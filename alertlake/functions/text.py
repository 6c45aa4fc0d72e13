"""Text functions of JVM-side expressions; patterns that meet Unicode text start with (?U)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as punctuation in a message.
PUNCTUATION = r"""[«»„“”"'`…,:;.!?()\[\]{}<>|/\\–—−-]+"""


def bound(value: Column, use) -> Column:
    """use(value), with the value evaluated once: inside a lambda an outer expression is evaluated for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def normalize(text: Column) -> Column:
    """Lower case, one spelling of е, punctuation as spaces, single spaces; null stays null."""
    folded = F.translate(F.lower(text), "ё", "е")
    return F.trim(F.regexp_replace(F.regexp_replace(folded, PUNCTUATION, " "), r"(?U)\s+", " "))


def sentences(text: Column, ends: str = ".!?", newlines: bool = True) -> Column:
    """The trimmed sentences of a text; one without any is a sentence itself."""
    pattern = rf"(?U)(?<=[{ends}])\s+" + (r"|\n+" if newlines else "")
    parts = F.filter(F.transform(F.split(text, pattern), lambda s: F.trim(s)), lambda s: s != "")
    return bound(parts, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(text)))


def first_of(items: Column, kind) -> Column:
    """The first value that is not null of kind(item), in order."""
    return F.get(F.filter(F.transform(items, kind), lambda k: k.isNotNull()), 0)


def stable_id(*parts: Column) -> Column:
    """16 hex digits of the parts' SHA-1; a null part counts as empty, so places don't shift."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha1(F.concat_ws("|", *texts)), 1, 16)


# The words of a region's name that tell its kind.
ADMIN_WORDS = (
    "the", "federal city", "autonomous oblast", "autonomous okrug", "autonomous district", "republic of", "republic", "oblast", "krai", "region",
    "республика", "область", "край", "автономная область", "автономный округ", "город федерального значения",
)


def strict_name(name: Column) -> Column:
    """A region's name for comparison with its kind: Latin and Russian letters and digits, single spaces; null counts as empty."""
    folded = F.translate(F.lower(F.coalesce(name, F.lit(""))), "ё", "е")
    return F.trim(F.regexp_replace(folded, "[^a-zа-я0-9]+", " "))


def loose_name(name: Column) -> Column:
    """A region's name without the words that tell its kind."""
    bare = F.regexp_replace(strict_name(name), rf"(?U)\b(?:{'|'.join(sorted(ADMIN_WORDS, key=len, reverse=True))})\b", " ")
    return F.trim(F.regexp_replace(bare, " +", " "))


ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def strip_html(html: Column) -> Column:
    """The text of a fragment: scripts and tags out, common entities resolved, single spaces."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def channel_of(url: Column) -> Column:
    """The channel in the address of a post on a public page, else null."""
    found = F.regexp_extract(url, r"t\.me/(?:s/)?([^/?#]+)", 1)
    return F.when(found != "", found)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 units that start each character, as a long."""
    points = F.transform(F.split(text, ""), lambda c: F.expr("1") * F.ascii(c))
    units = F.transform(points, lambda p: F.when(p > 0xFFFF, F.shiftright(p - 0x10000, 10) + 0xD800).otherwise(p))
    step = lambda h, u: ((h.bitwiseXOR(u.cast("long"))) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(text == "", F.lit(2166136261)).otherwise(F.aggregate(units, F.lit(2166136261).cast("long"), step))


def phrase_hits(texts: DataFrame, keys: list[str], n: str, phrases: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Where phrases stand as whole words: the columns of `keys`, of `phrases` (its text in `phrase`), and `at`, the word it begins at.

    texts: keys and the normalised text `n`; rows whose columns `on` differ don't meet. Words
    are exploded once, each with as many that follow it as the longest phrase has (read from
    the phrases first), and met with the first words of the phrases, far fewer than phrases;
    longer runs are made only at those places, and meet the phrases themselves.
    """
    on = on or []
    words = lambda c: F.split(c, " ")
    heads = phrases.select(*on, F.substring_index("phrase", " ", 1).alias("__word"), F.size(words("phrase")).alias("__size")).distinct()
    longest = heads.agg(F.max("__size")).first()[0] or 1
    keyed = list(dict.fromkeys([*keys, *on]))
    listed = texts.where(F.col(n).isNotNull()).select(*keyed, words(n).alias("__words"))
    each = listed.select(*keyed, F.posexplode(F.transform(F.sequence(F.lit(1), F.size("__words")), lambda i: F.slice("__words", i, F.lit(longest)))).alias("at", "__next"))
    starts = each.withColumn("__word", F.col("__next")[0]).join(heads, [*on, "__word"]).where(F.col("__size") <= F.size("__next"))
    runs = starts.select(*keyed, "at", F.array_join(F.slice("__next", F.lit(1), F.col("__size")), " ").alias("phrase"))
    return runs.join(phrases, [*on, "phrase"])


def contained(texts: DataFrame, text: str, phrases: DataFrame, phrase: str, least: int) -> DataFrame:
    """Every (text, phrase) with the phrase anywhere in the text, columns of both; names must differ.

    Phrases of fewer than `least` characters are left out. A phrase is keyed by its first
    `least` characters and a text by all its distinct pieces of that length, so they meet in
    an equi-join; what shares a beginning only is told by looking.
    """
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - least + 1), lambda i: F.substr(F.col(text), i, F.lit(least))))
    keyed = texts.where(F.length(text) >= least).withColumn("__piece", F.explode(pieces))
    asked = phrases.where(F.length(phrase) >= least).withColumn("__piece", F.substring(phrase, 1, least))
    return keyed.join(asked, "__piece").where(F.col(text).contains(F.col(phrase))).drop("__piece")


def count_label(count: Column, qualifier: Column) -> Column:
    """≥n, ≈n or ×n."""
    sign = F.when(qualifier == "at_least", "≥").when(qualifier == "approx", "≈").otherwise("×")
    return F.when(count.isNotNull(), F.concat(sign, count.cast("string")))
