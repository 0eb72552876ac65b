"""Column functions on text: Unicode-aware trimming, accent folding, tolerant numbers and dates."""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accented letters of the Latin alphabet and the plain letters they fold to.
ACCENTED = "áàâäãåāăąéèêëēĕėęěíìîïĩīĭįóòôöõōŏőúùûüũūŭůűñńņňçćĉċčýÿŷśŝşšźżžťţďĺļľŕŗřğĝġģĥĵķŵ"
FOLDED = "aaaaaaaaaeeeeeeeeeiiiiiiiioooooooouuuuuuuuunnnncccccyyysssszzzttdlllrrrgggghjkw"


def utrim(c: Column) -> Column:
    """Trim any Unicode white space (``trim`` leaves no-break spaces)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def fold_accents(c: Column) -> Column:
    """Lower-case ``c`` and drop accents and combining marks."""
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, FOLDED), r"\p{Mn}+", "")


def squeeze(c: Column) -> Column:
    """Trim ``c`` and collapse runs of white space to one space."""
    return F.regexp_replace(utrim(c), r"(?U)\s+", " ")


def words(c: Column) -> Column:
    """Runs of a-z and 0-9 of the folded text."""
    return F.regexp_extract_all(fold_accents(c), F.lit("([a-z0-9]+)"), 1)


def normalise(c: Column) -> Column:
    """Base form for comparison: trimmed, lower-cased, accents dropped, white space collapsed; null stays null."""
    return squeeze(fold_accents(c))


@F.pandas_udf(T.StringType())
def compatibility_form(texts: pd.Series) -> pd.Series:
    """Unicode NFKC form; the only text step without a built-in expression."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def annotation_text(c: Column) -> Column:
    """Base form of the compatibility form. Latin-1 text without compatibility characters skips Python."""
    plain = c.rlike(r"^[\x00-\x{A7}\x{A9}\x{AB}-\x{AE}\x{B0}\x{B1}\x{B6}\x{B7}\x{BB}\x{BF}-\x{FF}]*$")
    return normalise(F.coalesce(F.when(plain, c), compatibility_form(F.when(~plain, c))))


def utm_amounts(c: Column) -> Column:
    """Drop thousands marks from numbers before the unit UTM: ``1.000 utm`` becomes ``1000 utm``."""
    return F.regexp_replace(c, r"(?i)(?<=\d)[.,](?=\d{3}(?:[.,]\d{3})*\s*utm\b)", "")


def annotation_tokens(c: Column, most: int = 128) -> Column:
    """First ``most`` runs of a-z and 0-9 of a normalised text; none for null."""
    return F.slice(F.coalesce(F.regexp_extract_all(c, F.lit("([a-z0-9]+)"), 1), F.array().cast("array<string>")), 1, most)


NGRAMS = T.ArrayType(T.StructType([T.StructField("ngram", T.StringType()), T.StructField("count", T.IntegerType())]))


def top_ngrams(tokens: Column, most: int = 24) -> Column:
    """Single tokens and adjacent pairs with their counts: most frequent first, then by text; none for null.

    Array functions can count only by comparing all with all (ten milliseconds for 128 tokens), so this
    is an Arrow function; it needs no shuffle.
    """

    @F.pandas_udf(NGRAMS)
    def count(lists: pd.Series) -> pd.Series:
        out = []
        for ws in lists:
            ws = [] if ws is None else list(ws)
            n = Counter(ws)
            n.update(f"{a} {b}" for a, b in zip(ws, ws[1:]))
            out.append([{"ngram": g, "count": k} for g, k in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:most]])
        return pd.Series(out)

    return count(tokens)


def keyword_flags(tokens: Column, patterns: dict[str, list[str]]) -> Column:
    """Map of domain to whether one of its keywords occurs in the joined tokens."""
    text = F.array_join(tokens, " ")
    return F.create_map(*[x for d, ks in patterns.items() for x in (F.lit(d), reduce(or_, [text.contains(k) for k in ks], F.lit(False)))])


def tags(flags: Column, patterns: dict[str, list[str]]) -> Column:
    """Domains whose flag is set, in the order of ``patterns``."""
    return F.filter(F.array(*[F.when(flags[d], F.lit(d)) for d in patterns]), lambda t: t.isNotNull())


def language(tokens: Column) -> Column:
    """``und`` for fewer than two tokens, else ``es``."""
    return F.when(F.size(tokens) < 2, "und").otherwise("es")


def artifact_ref(scheme: str, scope: str, version: str, *parts: Column) -> Column:
    """Reference of an artifact kept elsewhere: scheme://scope/version/sha256 of the parts."""
    return F.concat(F.lit(f"{scheme}://{scope}/{version}/"), F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256))
