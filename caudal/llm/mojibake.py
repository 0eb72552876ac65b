"""Text decoded with the wrong character set: find it and restore it (problem 1).

For all pairs of a true and a wrong encoding the sequences that letters and signs turn into are computed
beforehand and matched with one Aho-Corasick automaton. Sequences of two characters and more are never
right in themselves; single characters are judged by their neighbours. Only matched spans are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caudal.scale import broadcast_if_small, materialize

# Encodings that texts of this kind were written in and mistaken for.
MULTI = ["utf-8"]
SINGLE = ["latin-1", "cp1252", "cp850", "cp437", "mac_roman", "cp1251", "cp1250", "cp1254", "iso8859-15"]
# Signs besides the Latin letters that texts may hold.
SIGNS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ′″→≤≥≠−"
# Letters of Spanish beyond ASCII, for which single-byte confusions are looked for.
SPANISH = "áéíóúüñÁÉÍÓÚÜÑ"
SIGNS_OF_SPANISH = "º°"
# Signs that may rightly follow, or rightly precede, a letter.
AFTER = set("”’…»º°ª—–™®©²³¹‰†‡›,;:.!?)•·")
BEFORE = set("“‘’«¡¿—–•·¤£¥§$€¶#†‡‹(°º~")
# Capitals that may stand within a capitalised word of the languages met.
CAPITALS = set("ÁÉÍÓÚÜÑÇÃÂÊÔÀÄÖ")
# Signs that may rightly stand between two capitals, and are a capital letter in a wrong character set.
BETWEEN = set("–—…ºª°")


def _decode(raw: bytes, encoding: str) -> str:
    """Decode byte by byte; bytes the encoding leaves undefined become the control of the same number, as browsers do."""
    try:
        return raw.decode(encoding)
    except UnicodeDecodeError:
        return "".join(_one(b, encoding) for b in raw)


def _one(b: int, encoding: str) -> str:
    try:
        return bytes([b]).decode(encoding)
    except UnicodeDecodeError:
        return chr(b)


@lru_cache(maxsize=1)
def sequences() -> dict[str, dict[str, str]]:
    """Garbled sequence of two characters and more: {wrong encoding(s): original character}."""
    letters = [chr(i) for i in range(0xA0, 0x180)] + list(SIGNS)
    out: dict[str, dict[str, str]] = {}
    for c in letters:
        for wrong in SINGLE:
            once = _decode(c.encode("utf-8"), wrong)
            out.setdefault(once, {}).setdefault(wrong, c)
            for again in dict.fromkeys([wrong, "cp1252", "latin-1"]):
                out.setdefault(_decode(once.encode("utf-8"), again), {}).setdefault(f"{wrong}+{again}", c)
    return {k: v for k, v in out.items() if len(k) > 1}


@lru_cache(maxsize=1)
def singles() -> dict[str, dict[tuple[str, str], str]]:
    """Garbled single character: {(true, wrong) encoding: original letter}."""
    out: dict[str, dict[tuple[str, str], str]] = {}
    true = [e for e in SINGLE if e != "cp1251"]
    for c in SPANISH + SIGNS_OF_SPANISH:
        for a in true:
            try:
                raw = c.encode(a)
            except UnicodeEncodeError:
                continue
            for b in SINGLE:
                w = _decode(raw, b)
                if w != c and not w.isascii() and w != "\xa0" and (w not in SPANISH or w.isupper() and c.islower()):
                    out.setdefault(w, {}).setdefault((a, b), c)
    return out


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for k in sequences():
        a.add_word(k, (len(k), k))
    for k in singles():
        a.add_word(k, (1, k))
    a.make_automaton()
    return a


@lru_cache(maxsize=1)
def suspect() -> str:
    """Pattern that every text with a match of the automaton, a lost or a replaced character meets: no case is lost by it.

    Characters from U+0100 on all pass: one range, where a class of some hundred characters costs the regex engine
    that many steps for every character it reads.
    """

    def one(chars: set[str]) -> str:
        return "".join(f"\\x{{{ord(c):X}}}" for c in sorted(chars) if ord(c) < 256)

    return f"[{one(set(singles()) | set('ÃÂ?'))}]|[^\\x{{0}}-\\x{{FF}}]|[{one({k[0] for k in sequences()})}][^\\x{{0}}-\\x{{7F}}]"


def _accept(text: str, at: int, w: str, letters: set[str]) -> bool:
    """Whether the single character at ``at`` is out of place there and fits as one of ``letters``."""
    before, after = text[at - 1 : at], text[at + 1 : at + 2]
    left, right = before.isalpha() and before != w, after.isalpha() and after != w
    if "\x80" <= w <= "\x9f":
        return True
    if not left and not right:
        return False
    if not w.isalpha() or w in "ªº":
        if left and w in "—…" and before.isupper() and after in singles():
            return True
        if left and right:
            if w == "·":
                return not (before in "lL" and after in "lL")
            if w in "’‘'":
                return False
            return w not in BETWEEN
        if w == "…" and left and before.isupper() and text.upper() == text:
            return "É" in letters
        if w == "—":
            return right and after.islower() and not before.strip() and "Ñ" in letters
        if w == "·":
            return bool(left or after.islower())
        return (left and w not in AFTER) or (right and w not in BEFORE)
    if w.isupper():
        if left and before.islower():
            return True
        if w in SPANISH:
            return False
        if left and right and before.isupper() and after.islower() and w not in CAPITALS:
            return True
        if left and right and before.isupper() and after.isupper() or left and not right and before.isupper() or right and not left and after.isupper():
            return w not in CAPITALS and any(c.isupper() for c in letters) and not (w == "Õ" and after == "E")
        if right and not left and after.islower():
            return w in "ÐÝÞË"
        return False
    if w == "ß":
        hiatus = before in "iI" and right and after.lower() not in "aeiouáéíóúäöüy" and text[at - 2 : at - 1].lower() not in "aeo"
        return hiatus or not (left and before.lower() in "aeiouáéíóúäöüy")
    if unicodedata.name(w, "").startswith(("GREEK", "CYRILLIC")):
        near = before if left else after
        return unicodedata.name(near, "").startswith("LATIN")
    return w in "œžšµƒ" and left and right and w != "µ" or w == "ƒ"


_REPLACED = re.compile(r"\?+")


def marks(text: str) -> tuple[list[int], list[int]]:
    """Positions of question marks that stand for lost characters: those sure to, and those that end a word and may be questions."""
    sure, doubtful = [], []
    for m in _REPLACED.finditer(text):
        i = m.start()
        before, after, follow = text[i - 1 : i] if i else "", text[m.end() : m.end() + 1], text[m.end() + 1 : m.end() + 2]
        if m.end() - i > 1 and not (before.isalpha() and after.isalpha()) and not (m.end() - i == 2 and after.isalpha()):
            continue
        tail = text[i:].split(" ", 1)[0]
        if "=" in tail or "/" in text[:i].rsplit(" ", 1)[-1]:  # a web address
            continue
        if before.isalpha():
            if after.isalpha() or before in "Nn" and not text[i - 2 : i - 1].isalpha() and text[m.end() :].lstrip()[:1].isdigit():
                sure += range(i, m.end())
            elif text.rfind("¿", 0, i) < 0:
                doubtful += range(i, m.end())
        elif after.isalpha() and (not before.strip() or before in "(\"'-/.,;:"):
            sure += range(i, m.end())
        elif not before.strip() and not after.strip() and follow and i:
            sure += range(i, m.end())  # a sign by itself
    return sure, doubtful


def replaced_marks(text: str) -> list[int]:
    return sorted(sum(marks(text), []))


def _between(text: str) -> list[int]:
    """Positions of signs between capitals that may be a capital letter in a wrong character set, or rightly there."""
    return [i for i in range(1, len(text) - 1) if text[i] in BETWEEN and text[i - 1].isupper() and text[i + 1].isupper() and any(c.isupper() for c in singles().get(text[i], {}).values())]


def _word_at(text: str, at: int) -> str:
    """The word around the character at ``at``, in lower case, with ``?`` for that character and all beyond ASCII."""
    lo, hi = at, at + 1
    while lo and (text[lo - 1].isalpha() or text[lo - 1] in "?�"):
        lo -= 1
    while hi < len(text) and (text[hi].isalpha() or text[hi] in "?�"):
        hi += 1
    return "".join(c if c.isascii() else "?" for c in text[lo:hi].lower())


def examine(text: str | None) -> tuple[int, int, str | None, list[str]]:
    """``repair`` and, where nothing but doubtful signs is found, the words that hold them.

    Then spans and lost characters count those signs, and each stands as ``?`` in the text; only if the
    corpus has a word that fits are they damage.
    """
    spans, lost, out = repair(text)
    if spans or not text:
        return spans, lost, out, []
    at = marks(text)[1] + _between(text)
    held = "".join("?" if i in at else c for i, c in enumerate(text)) if at else text
    return len(at), len(at), held, list(dict.fromkeys(_word_at(text, i) for i in at))


def repair(text: str | None) -> tuple[int, int, str | None]:
    """(garbled spans, spans that can't be restored from the text alone, text with the others restored).

    Lost characters (U+FFFD, replaced by question marks) are counted as unrestorable and left in place.
    Question marks that end a word, and signs between capitals, count only beside other damage.
    """
    if not text:
        return 0, 0, text
    found: list[tuple[int, int, str]] = []
    for end, (n, key) in automaton().iter(text):
        found.append((end - n + 1, end + 1, key))
    # Longest first, then leftmost; no overlaps.
    taken = bytearray(len(text))
    spans: list[tuple[int, int, str]] = []
    seen, order = text, sorted(found, key=lambda x: (x[0] - x[1], x[0]))
    for _ in range(2):  # what the first round restored counts as a letter in the second
        for s, e, key in order:
            if any(taken[s:e]) or e - s == 1 and not _accept(seen, s, key, set(singles()[key].values())):
                continue
            taken[s:e] = b"\x01" * (e - s)
            spans.append((s, e, key))
        for s, e, key in spans:
            if e - s == 1:
                seen = seen[:s] + next(iter(singles()[key].values())) + seen[e:]
    if "Ã" in text or "Â" in text:
        for s in range(1, len(text)):
            if text[s] in "ÃÂ" and text[s - 1].islower() and not taken[s]:
                taken[s] = 1
                spans.append((s, s + 1, ""))
    sure, doubtful = marks(text) if "?" in text else ([], [])
    lost = text.count("�") + len(sure)
    if spans or lost:
        lost += len(doubtful)
    if not spans:
        return lost, lost, text
    for i in _between(text):
        if not taken[i]:
            taken[i] = 1
            spans.append((i, i + 1, text[i]))
    votes: Counter = Counter()
    for s, e, key in spans:
        votes.update(list(sequences().get(key) or singles().get(key) or {}))
    if all(e - s == 1 for s, e, _ in spans):  # a pair that explains one sign also explains doubtful ones beside letters
        best = votes.most_common(1)[0][0] if votes else None
        for i, c in enumerate(text):
            if not taken[i] and best in singles().get(c, {}) and c.isupper() and text[i - 1 : i].isalpha():
                taken[i] = 1
                spans.append((i, i + 1, c))
    out, at, failed = [], 0, 0
    for s, e, key in sorted(spans):
        options = sequences().get(key) or singles().get(key)
        out.append(text[at:s])
        if options:
            left, right = text[s - 1 : s], text[e : e + 1]
            if e - s == 1 and left.isupper() and (right.isupper() or not right.isalpha()):  # a capital among capitals
                options = {k: v for k, v in options.items() if v.isupper()} or options
            elif e - s == 1 and left.islower():
                options = {k: v for k, v in options.items() if v.islower()} or options
            pair = max(options, key=lambda k: votes[k])
            out.append(options[pair])
        else:
            failed += 1
            out.append(text[s:e])
        at = e
    out.append(text[at:])
    return len(spans) + lost, failed + lost, "".join(out)


REPAIRED = T.StructType([T.StructField("n_spans", T.IntegerType()), T.StructField("n_lost", T.IntegerType()), T.StructField("restored", T.StringType()), T.StructField("doubtful", T.ArrayType(T.StringType()))])


@F.pandas_udf(REPAIRED)
def _examine(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([examine(t) for t in texts], columns=["n_spans", "n_lost", "restored", "doubtful"])


def garbled(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per row and field of ``df`` that holds garbled text: record_key, field_name, damaged, n_spans, n_lost, restored.

    Only values that hold a first character of a garbled sequence (``suspect``) leave the JVM; that loses
    none. Signs that may be right (a question mark at a word's end, a dash between capitals) are damage if
    the value has other damage, or if the table has a word with a letter in that place that is at least as
    frequent as the word without it. Null and empty values are no cases; repeated rows give repeated cases;
    the key may be null.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").alias("damaged")) for f in fields])
    base = df.select(F.col(key).alias("record_key"), F.explode(cells).alias("c")).select("record_key", "c.*").where(F.col("damaged").rlike(suspect()))
    found = materialize(base.withColumn("r", _examine("damaged")).where("r.n_spans > 0").select("record_key", "field_name", "damaged", "r.*"))
    doubtful = F.size("doubtful") > 0
    sure, open_ = found.where(~doubtful).drop("doubtful"), found.where(doubtful)
    if open_.isEmpty():
        return sure
    asked = materialize(open_.select(F.explode("doubtful").alias("mask")).distinct())
    words = df.select(F.explode(F.array(*[F.col(f"`{f}`") for f in fields])).alias("text")).where("text IS NOT NULL")
    # Equal runs between blanks are combined before any is looked at.
    runs = words.select(F.explode(F.split("text", " ")).alias("run")).groupBy("run").agg(F.count("*").alias("n"))
    words = runs.select(F.explode(F.regexp_extract_all("run", F.lit(r"([\p{L}\p{M}]+)"), 1)).alias("word"), "n").groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n"))
    mask = _masked(F.col("word"))
    fit = F.when(F.col("word").rlike(r"[^\x00-\x7F]"), F.col("n")).otherwise(F.lit(0))
    ends = F.array(F.struct(mask.alias("mask"), fit.alias("fit"), F.lit(0).cast("long").alias("bare")), F.struct(F.concat(mask, F.lit("?")).alias("mask"), F.lit(0).cast("long").alias("fit"), F.col("n").alias("bare")))
    keys = words.select(F.explode(ends).alias("e")).select("e.*")
    held = keys.join(broadcast_if_small(asked), "mask", "left_semi").groupBy("mask").agg(F.sum("fit").alias("fit"), F.sum("bare").alias("bare"))
    fitting = broadcast_if_small(materialize(held.where("fit > 0 AND fit >= bare").select("mask")))
    judged = open_.select("damaged", F.explode("doubtful").alias("mask")).distinct().join(fitting, "mask", "left_semi").select("damaged").distinct()
    rows = open_.join(judged, "damaged", "left_semi").select(*sure.columns)
    return sure.unionByName(rows)


_TOKEN = r"[\p{L}\p{M}?\x{FFFD}]+"


def _masked(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\x00-\x7F]", "?"))


def restore_lost(cases: DataFrame, clean: DataFrame, text: str = "text") -> DataFrame:
    """``cases`` with lost characters restored where the corpus knows just one word that fits.

    A word with lost characters, written with ``?`` for each, is looked up among the words of ``clean``
    whose letters beyond ASCII are written the same way; the most frequent counts if it is at least ten
    times as frequent as the next. Counts are over all rows; both word lists are distinct before they
    meet. Adds ``complete``: nothing is left lost.
    """

    holes = F.filter(F.regexp_extract_all("restored", F.lit(f"({_TOKEN})"), 1), lambda w: w.rlike(r"[?\x{FFFD}]") & w.rlike(r"\p{L}"))
    numbered = materialize(cases.withColumn("case_id", F.expr("uuid()")).withColumn("holes", F.when(F.col("n_lost") > 0, F.array_distinct(holes)).otherwise(F.array())))
    wanted = numbered.select(F.explode("holes").alias("hole")).distinct().withColumn("mask", _masked(F.col("hole")))
    words = F.filter(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{M}]+)"), 1), lambda w: w.rlike(r"[^\x00-\x7F]"))
    known = clean.select(F.explode(words).alias("word")).groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n")).withColumn("mask", _masked(F.col("word")))
    ranked = (
        known.join(broadcast_if_small(materialize(wanted.select("mask").distinct())), "mask", "left_semi")
        .groupBy("mask")
        .agg(F.max(F.struct("n", "word")).alias("best"), F.sum("n").alias("all"))
        .where(F.col("best.n") * 11 >= F.col("all") * 10)
        .select("mask", F.col("best.word").alias("word"))
    )
    solved = materialize(wanted.join(ranked, "mask").select("hole", "word"))
    per_case = (
        numbered.select("case_id", F.explode("holes").alias("hole"))
        .join(broadcast_if_small(solved), "hole")
        .groupBy("case_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("hole", "word"))).alias("known"))
    )
    joined = numbered.join(per_case, "case_id", "left")
    filled = _fill("restored", F.to_json("known"))
    return joined.withColumn("filled", filled).select(
        "record_key", "field_name", "damaged", "n_spans", F.col("filled.text").alias("restored"),
        (F.when(F.col("n_lost") > 0, F.col("filled.left") == 0).otherwise(True)).alias("complete"),
        *[c for c in cases.columns if c not in ("record_key", "field_name", "damaged", "n_spans", "restored", "n_lost")],
    )


FILLED = T.StructType([T.StructField("text", T.StringType()), T.StructField("left", T.IntegerType())])
_HOLED = re.compile(r"[^\W\d_?]*[?�][^\W\d_]*(?:[?�][^\W\d_]*)*")


@F.pandas_udf(FILLED)
def _fill(texts: pd.Series, known: pd.Series) -> pd.DataFrame:
    import json

    rows = []
    for t, k in zip(texts, known):
        words = json.loads(k) if k else {}

        def put(m: re.Match, words: dict = words) -> str:
            w = words.get(m[0])
            if w is None:
                return m[0]
            return "".join(x if y not in "?�" else x.upper() if m[0].replace("?", "").replace("�", "").isupper() and len(m[0]) > 2 else x for x, y in zip(w, m[0])) if len(w) == len(m[0]) else m[0]

        def cased(m: re.Match) -> str:
            new = put(m)
            return "".join(y if y not in "?�" else x for x, y in zip(new, m[0]))

        out = _HOLED.sub(cased, t or "")
        rows.append((out, out.count("�") + len(replaced_marks(out))))
    return pd.DataFrame(rows, columns=["text", "left"])
