"""Pages made of keywords, links or tags rather than sentences, by the shapes of their lines (problem 9).

Every line is reduced to a shape: its number of words in steps, how it is capitalised, how densely separators
and links stand among the words, whether its words are a phrase the page repeats over and over, or it stands in a row of
tags, whether it is an entry with a quantity, and its end mark. Whether a shape is a sentence's follows from the shape alone; no
word is looked up anywhere. Lines are grouped by shape, and a page that non-sentence shapes dominate is flagged.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A page is flagged if lines of non-sentence shapes hold more than this part of its text.
SHARE = 0.5
#: A phrase of two words is stuffed where a run of so many neighbouring lines holds it oftener than STUFFED times
#: each. Lines without an end are a list of keywords where so many neighbours each hold some phrase of the page.
STUFFED_RUN = 3
STUFFED = 1.25
#: So many neighbouring lines without an end, of under so many words on average, may be a row of tags.
BARE_RUN, BARE_WORDS = 6, 5
#: A phrase is looked at from so many times on in a page.
LEAST_TIMES = 5
#: Words of fewer letters join others and belong to no phrase.
LEAST_LETTERS = 3
#: Fewer words a separator make a line dense, or close; a close line needs MANY of them to be a list.
DENSE, CLOSE, MANY = 3, 6, 4
#: A link among fewer words makes a line a link entry.
LINK_WORDS = 10
#: A page of fewer words and without links is too short to be told from a greeting.
LEAST_WORDS = 5

_SPLIT = re.compile(r"(?<=[.!?])\s+(?=[A-ZÁÉÍÓÚÑ¿¡\"#<]|https?:|www\.)")
_LINK = re.compile(r"<a\b[^<>]*>[^<]*(?:</a>)?|https?://\S+|\bwww\.\S+|(?<![\w&])#\w+|(?<![\w.-])[\w-]++(?:\.[\w-]++)++/\S+", re.I)
_LINK_SIGNS = ("http", "www.", "#", "<a", "<A", "/", "HTTP", "WWW.")
# Signs that part entries and hardly stand in sentences; end marks, and what may follow them.
HARD = "|>•·*/#"
END = tuple(".!?…:")
CLOSING = " \t\r\n\"'»)]"
# A numbered or marked entry that ends in a quantity, or a name, a colon and a quantity, is an item asked for, not a tag.
_MARK = re.compile(r"\s*(?:\d+\s*[.)-]|[-•*])\s*\S")
_QUANTITY = re.compile(r"\d[.,]*\s*[^\W\d_]*\.?$")
_NAMED = re.compile(r"[^\d:]+:\s*\d[\d.,]*+\s*[^\W\d_]*\.?\s*")
#: Digits, unit and the blank between are looked for in so many last characters of an entry.
QUANTITY_CHARS = 60
_WORD = re.compile(r"[^\W_]+")
_DIGIT = re.compile(r"\d")


def _bucket(n: int) -> int:
    return n if n < 3 else 3 if n < 5 else 5 if n < 9 else 9 if n < 17 else 17


def shape(line: str, row: int = 0, words: list[str] | None = None, links: int | None = None) -> str:
    """Shape of a line, as ``w9cs2l0r0.``: words in steps, capitals, separators, links, row, quantity, end.

    Capitals: A all, 0 none, 1 one, C most, c some words. Separators: 0 none, 1 few, 2 close and many, 3 dense.
    Links: 0 none, 1 few, 2 dense. Row: 1 repeats a phrase of the page, 2 one of a row of tags.
    ``q`` marks an entry with a quantity, ``.`` an end mark.
    """
    if links is None:
        links = len(_LINK.findall(line))
    bare = _LINK.sub(" ", line) if links else line
    words = _WORD.findall(bare) if words is None else words
    n = len(words)
    capitals = 0 if bare.islower() else sum(w[0].isupper() for w in words)
    kind = "0" if not capitals else "A" if bare.isupper() else "1" if capitals == 1 else "C" if capitals * 2 > n else "c"
    sep = 0
    if not bare.isalpha():
        hard, soft = sum(map(bare.count, HARD)), bare.count(",") + bare.count(";") + bare.count(" - ") + bare.count(" – ")
        if hard or soft:
            sep = 3 if n <= DENSE * (hard + soft) and (hard or soft > 1) else 2 if hard + soft >= MANY and n < CLOSE * (hard + soft) else 1
    link = 0 if not links else 2 if links * LINK_WORDS >= n else 1
    item = not links and _item(line)
    return f"w{_bucket(n)}{kind}s{sep}l{link}r{row}{'q' if item else ''}{'.' if _ends(line) else ''}"


def _ends(line: str) -> bool:
    return line.rstrip(CLOSING)[-1:] in END


def _item(line: str) -> bool:
    if not _DIGIT.search(line):
        return False
    mark = _MARK.match(line)
    if mark and _QUANTITY.search(line[max(mark.end() - 1, 0) :].rstrip()[-QUANTITY_CHARS:]):
        return True
    return _NAMED.fullmatch(line) is not None


def sentence_shape(s: str) -> bool:
    """Whether a shape may be a sentence's, a heading's or a requested item's rather than an entry of keywords, links or tags."""
    sep, link, row = s[s.index("s") + 1], s[s.index("l") + 1], s[s.index("r") + 1]
    if row != "0" or link == "2":
        return "q" in s
    return "q" in s or sep in "01" or sep == "2" and s.endswith(".")


def _stuffed(words: list[list[str]], ends: list[bool]) -> set[int]:
    """Lines in a run of neighbours that repeat one phrase of two words."""
    if sum(map(len, words)) < 4 * STUFFED_RUN:
        return set()
    content = [[x for x in w if len(x) >= LEAST_LETTERS] for w in words]
    flat = [x for w in content for x in w]
    if not flat or max(Counter(zip(flat, flat[1:])).values(), default=0) < LEAST_TIMES:  # at least as often as within lines
        return set()
    grams = [Counter(zip(w, w[1:])) for w in content]
    total: Counter = Counter()
    for g in grams:
        total.update(g)
    often = {phrase for phrase, n in total.items() if n >= LEAST_TIMES}
    if not often:
        return set()
    out: set[int] = set()
    runs: dict[tuple[str, str], tuple[int, int]] = {}  # open runs: first line, times held
    listed: list[int] = []
    for at, g in enumerate([*grams, Counter()]):
        for phrase in [x for x in runs if x not in g]:
            start, held = runs.pop(phrase)
            if at - start >= STUFFED_RUN and held >= STUFFED * (at - start) or held >= LEAST_TIMES * (at - start):
                out.update(range(start, at))
        held_here = [phrase for phrase in g if phrase in often]
        for phrase in held_here:
            start, held = runs.get(phrase, (at, 0))
            runs[phrase] = start, held + g[phrase]
        if held_here and not ends[at]:
            listed.append(at)
        else:
            if len(listed) >= STUFFED_RUN:
                out.update(listed)
            listed.clear()
    return out


def _tag_rows(shapes: list[str], sizes: list[int]) -> set[int]:
    """Lines of a row of short ones without an end, two thirds of which have no capitals or no sentence's shape."""
    out: set[int] = set()
    row: list[int] = []
    for i, s in enumerate([*shapes, "."]):
        if not s.endswith(("q", ".")) and "s" in s and s[: s.index("s") - 1] != "w17":
            row.append(i)
            continue
        if len(row) >= BARE_RUN and sum(sizes[k] for k in row) < BARE_WORDS * len(row):
            strong = sum(shapes[k][shapes[k].index("s") - 1] == "0" or not sentence_shape(shapes[k]) for k in row)
            if strong * 3 >= len(row) * 2:
                out.update(row)
        row.clear()
    return out


def page_lines(text: str) -> list[tuple[str, int]]:
    """(shape, characters) of each line of a page; lines are cut at sentence ends, empty ones left out."""
    linked = any(x in text for x in _LINK_SIGNS) and bool(_LINK.search(text))
    parts: list[str] = []
    for line in text.splitlines():
        if line.strip():
            parts += [line] if _item(line) else [p for p in _SPLIT.split(line) if p.strip()]
    n_links = [len(_LINK.findall(p)) for p in parts] if linked else [0] * len(parts)
    words = [_WORD.findall(_LINK.sub(" ", p) if n else p) for p, n in zip(parts, n_links)]
    if not linked and sum(map(len, words)) < LEAST_WORDS:
        return [("w0", len(p)) for p in parts]
    bad = _stuffed([list(map(str.lower, w)) for w in words], [_ends(p) for p in parts])
    shapes = [shape(p, int(i in bad), w, n) for i, (p, w, n) in enumerate(zip(parts, words, n_links))]
    for i in _tag_rows(shapes, [len(w) for w in words]):
        shapes[i] = shapes[i].replace("r0", "r2")
    return list(zip(shapes, [len(p) for p in parts]))


def page_shapes(text: str) -> tuple[float, float, int, int, str]:
    """(share of the text in non-sentence shapes, in the commonest of them, lines, number of those shapes, the commonest)."""
    lines = page_lines(text)
    total = sum(n for _, n in lines)
    shapes: Counter = Counter()
    for s, n in lines:
        if s != "w0" and not sentence_shape(s):
            shapes[s] += n
    top = shapes.most_common(1)
    if not top:
        return 0.0, 0.0, len(lines), 0, ""
    return sum(shapes.values()) / total, top[0][1] / total, len(lines), len(shapes), top[0][0]


PAGE = T.StructType(
    [T.StructField("non_sentence", T.DoubleType()), T.StructField("top_share", T.DoubleType()), T.StructField("n_lines", T.IntegerType()), T.StructField("n_shapes", T.IntegerType()), T.StructField("top_shape", T.StringType())]
)


@F.pandas_udf(PAGE)
def _page(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([page_shapes(t or "") for t in texts], columns=[f.name for f in PAGE.fields])


def spam_pages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: share of the text in non-sentence shapes and in the commonest of them, number of lines
    and of such shapes, the commonest, is_spam.

    One pass without a shuffle; whole texts. Null and empty texts have no lines and are no spam. Repeated
    rows stay repeated.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    return base.select("doc_id", _page("t").alias("p")).select("doc_id", "p.*", (F.col("p.non_sentence") > SHARE).alias("is_spam"))


LINES = T.ArrayType(T.StructType([T.StructField("shape", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_chars", T.LongType())]))


@F.pandas_udf(LINES)
def _grouped(texts: pd.Series) -> pd.Series:
    out = []
    for t in texts:
        n, chars = Counter(), Counter()
        for s, c in page_lines(t or ""):
            n[s] += 1
            chars[s] += c
        out.append([(s, n[s], chars[s]) for s in n])
    return pd.Series(out)


def corpus_shapes(docs: DataFrame, text: str = "text") -> DataFrame:
    """Shapes over all documents: shape, pages, lines, characters and whether a sentence's.

    A page gives one row a shape, and rows are combined before the shuffle; there are at most some hundreds of
    shapes, whatever the corpus.
    """
    rows = docs.select(F.explode(_grouped(F.col(text))).alias("s")).select("s.*").where("shape <> 'w0'")
    sentence = F.col("shape").contains("q") | (F.substring(F.substring_index("shape", "s", -1), 1, 1).isin("0", "1") | (F.substring(F.substring_index("shape", "s", -1), 1, 1) == "2") & F.col("shape").endswith(".")) & ~F.col("shape").rlike("l2|r[12]")
    return rows.groupBy("shape").agg(F.count("*").alias("n_pages"), F.sum("n_lines").alias("n_lines"), F.sum("n_chars").alias("n_chars")).withColumn("sentence", sentence)
