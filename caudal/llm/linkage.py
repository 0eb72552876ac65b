"""Matching records of two sources without a common key, by soft logic (problem 4).

Candidate pairs of an order line and a notice line come from blocks on what their texts share. Weighted
rules say how much each piece of evidence speaks for or against a pair; with exclusivity (an order line
has one notice line, an order one notice) and transitivity (lines of an order and lines of a notice go
together) they form a convex problem of squared hinge losses over truth values in [0, 1]. It is solved
by the alternating direction method of multipliers: local steps per order line, then a consensus step per
(order, notice), each a distributed job, until the values stand still. The values are the confidences.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caudal.functions.text import fold_accents, squeeze
from caudal.llm.blocks import may_meet, split_hot
from caudal.scale import broadcast_if_small, materialize

#: Document frequencies of words are kept in a count-min sketch of so many rows and buckets, whatever the vocabulary.
#: A word's count is too high by the mean load of a bucket (under 1/10,000 of the lines) unless it collides in every
#: row with a common word, of which there are at most (words a line / COMMON).
ROWS, BUCKET_BITS = 3, 17
BUCKETS = 1 << BUCKET_BITS
#: Words that more than this part of the notice lines, and twenty more, hold are no block keys.
COMMON, FEW = 0.01, 20
#: A block that would give more pairs than this is split by family, dimensions and model.
HOT_PAIRS = 20_000
#: Least value that the evidence alone gives to a pair. What raises a pair above it is its order's and notice's other
#: pairs, so pairs of an order and notice that have a plausible one take part from LIFTED on.
PLAUSIBLE, LIFTED = 0.4, 0.2
#: Least confidence of a link; least of one that rivals share in.
ACCEPT, SHARED = 0.5, 0.3
#: The solution stands when no value of an order moves by more than this; orders that stand leave the rounds.
TOLERANCE = 0.01
#: Rounds after which what still moves is taken as it is.
ROUNDS = 40

# Weights of the rules. First what speaks for a pair, then what speaks against it.
FOR = {"model": 5.0, "size": 3.0, "text": 4.0, "colour": 0.7, "material": 0.7, "code": 1.0, "product": 0.5, "quantity": 2.0, "part": 1.0, "about": 0.7, "unit": 0.3, "buyer": 2.0, "dates": 1.0, "review": 1.0}
AGAINST = {"prior": 2.0, "model": 6.0, "size": 5.0, "text": 4.0, "colour": 4.0, "material": 4.0, "code": 0.5, "quantity": 1.0, "buyer": 0.7, "dates": 6.0}
TOGETHER, SIBLING, NOTICE_PRIOR, RHO = 1.0, 1.0, 0.1, 1.0
#: Days from the notice's publication to the order that are usual.
DAYS = (0, 200)

# Colours and materials named in line descriptions.
COLOURS = frozenset("negro blanco rojo azul verde amarillo gris cafe transparente natural naranjo morado rosado celeste beige plateado dorado marron".split())
MATERIALS = frozenset("goma polipropileno carton acero vinilo ceramico madera aluminio lino algodon plastico vidrio cuero poliester nylon metal hierro cobre bronce pvc papel".split())
# Words that carry no meaning in a specification.
NOISE = frozenset("de del la las los el y o a en con por para p dest destino despacho entrega mod modelo ref medida marca tipo equivalente mat cm mm un una no al".split())
_SIZE = re.compile(r"(?<!\d)(\d{1,4})\s*[x*]\s*(\d{1,4})(?!\d)")
# A model reference: two letters and a number, or, after a word for it or with a sign between, up to five letters.
_MODEL = re.compile(r"\b(?:(mod|modelo|ref)\.?\s+)?(?:([a-z]{2})([\s/-]?)(\d{2,4})|((?<=mod )[a-z]{1,5}|(?<=mod\. )[a-z]{1,5}|(?<=modelo )[a-z]{1,5}|(?<=ref )[a-z]{1,5}|(?<=ref\. )[a-z]{1,5}|[a-z]{3,5}(?=[-/]))[\s/-]?(\d{2,7}))\b")
_MARKS = re.compile("[\u0300-\u036f]+")
_WORDS = re.compile(r"[a-z0-9]+")


def spec(*texts: str | None) -> tuple[list[str], list[str], list[str], str, str]:
    """Model references, dimensions, other words, colour and material of line texts."""
    models, sizes, words = set(), set(), set()

    def model(m: re.Match) -> str:
        if m[2] in NOISE and not m[1] and m[3] == " ":
            return m[0]
        models.add(m[2] + m[4] if m[2] else m[5] + m[6])
        return " "

    for t in texts:
        if not t:
            continue
        t = t.lower()
        if not t.isascii():
            t = _MARKS.sub("", unicodedata.normalize("NFD", t))
        sizes.update(f"{int(a)}x{int(b)}" for a, b in _SIZE.findall(t))
        words.update(w for w in _WORDS.findall(_MODEL.sub(model, _SIZE.sub(" ", t))) if w not in NOISE and len(w) > 1 and not w.isdigit())
    colours, materials = words & COLOURS, words & MATERIALS
    rest = words - COLOURS - MATERIALS
    return sorted(models), sorted(sizes), sorted(rest), next(iter(colours)) if len(colours) == 1 else "", next(iter(materials)) if len(materials) == 1 else ""


SPEC = T.StructType([*[T.StructField(n, T.ArrayType(T.StringType())) for n in ("models", "sizes", "words")], T.StructField("colour", T.StringType()), T.StructField("material", T.StringType())])


@F.pandas_udf(SPEC)
def _spec(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([spec(x, y) for x, y in zip(a, b)], columns=["models", "sizes", "words", "colour", "material"])


def _places(word: str) -> tuple[int, ...]:
    """Buckets of a word in the rows of the sketch; the same hash as Spark's ``xxhash64``."""
    h = xxhash.xxh64_intdigest(word, seed=42)
    return tuple(h >> BUCKET_BITS * i & BUCKETS - 1 for i in range(ROWS))


def frequencies(df: DataFrame, words: str = "words") -> np.ndarray:
    """Count-min sketch of how many rows of ``df`` hold each word: an array of fixed size."""
    h = F.xxhash64("word")
    places = F.array(*[F.shiftrightunsigned(h, BUCKET_BITS * i).bitwiseAND(BUCKETS - 1) + i * BUCKETS for i in range(ROWS)])
    counts = np.zeros(ROWS * BUCKETS, dtype=np.int64)
    for r in df.select(F.explode(words).alias("word")).select(F.explode(places).alias("b")).groupBy("b").agg(F.count("*").alias("n")).toLocalIterator():
        counts[r["b"]] = r["n"]
    return counts.reshape(ROWS, BUCKETS)


class Weights:
    """Logarithmic weights of words by their frequency among ``n`` rows."""

    def __init__(self, counts: np.ndarray, n: int) -> None:
        self.table, self.known = np.log((n + 1) / (counts + 0.5)), {}
        self.rare_from = math.log((n + 1) / (COMMON * n + FEW + 0.5))

    def __call__(self, word: str) -> float:
        x = self.known.get(word)
        if x is None:
            if len(self.known) > 500_000:
                self.known.clear()
            x = self.known[word] = max(float(self.table[i, k]) for i, k in enumerate(_places(word)))
        return x


def block_keys(models: list[str], sizes: list[str], rare: list[str], colour: str, buyer: str, family: str, quantity: float | None, either: bool) -> set[str]:
    """Keys of the blocks of a line. ``either``: also the keys of lines of unknown family (notice side)."""
    keys = {f"m|{m}" for m in models}
    families = [family, "*"] if either and family else [family or "*"]
    for s in sizes:
        keys.add(f"sb|{s}|{buyer}")
        keys.update(f"sw|{s}|{w}" for w in rare)
        keys.update(f"sf|{s}|{f}|{colour}" for f in families if f != "*")
    for f in families:
        keys.update(f"ww|{a}|{b}|{f}" for a, b in combinations(rare, 2))
        if f == "*":
            continue
        keys.update(f"wc|{w}|{f}|{colour}" for w in rare if colour)
        if quantity:
            keys.add(f"bq|{buyer}|{f}|{quantity:g}")
            keys.update(f"wq|{w}|{f}|{quantity:g}" for w in rare)
        if colour:
            keys.add(f"bc|{buyer}|{f}|{colour}")
    return keys


def near_words(a: list[str], b: list[str], weigh) -> float:  # noqa: ANN001
    """Part of the weight of words ``a`` that ``b`` holds, whole, cut short or with one letter or swap wrong."""
    held = set(b)
    total = got = 0.0
    for w in a:
        x = weigh(w)
        total += x
        if w in held:
            got += x
        elif len(w) >= 3 and any(v.startswith(w) for v in b):
            got += 0.9 * x
        elif len(w) >= 4 and any(abs(len(v) - len(w)) <= 1 and (v[0] == w[0] or v[-1] == w[-1]) and _off_by_one(w, v) for v in b):
            got += 0.8 * x
    return got / total if total else 0.5


def _off_by_one(a: str, b: str) -> bool:
    """One letter changed, left out or added, or two neighbours swapped."""
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:]


def evidence(p: str, n: str) -> tuple[Column, Column, Column]:
    """Weight of what speaks for and against a pair of lines (struct columns ``p`` and ``n``), but for the text rule, and
    whether both name one product, by code or name."""
    zero = F.lit(0.0)
    pro, con = zero, F.lit(AGAINST["prior"])

    def rule(name: str, known: Column, holds: Column) -> None:
        nonlocal pro, con
        pro = pro + F.when(known & holds, FOR.get(name, 0.0)).otherwise(zero)
        con = con + F.when(known & ~holds, AGAINST.get(name, 0.0)).otherwise(zero)

    def both(field: str) -> tuple[Column, Column]:
        return F.col(f"{p}.{field}"), F.col(f"{n}.{field}")

    for name in ("models", "sizes"):
        a, b = both(name)
        rule(name[:-1], (F.size(a) > 0) & (F.size(b) > 0), F.arrays_overlap(a, b))
    for name in ("colour", "material", "code", "product", "unit", "buyer"):
        a, b = both(name)
        rule(name, (a != "") & (b != ""), a == b)
    a, b = both("quantity")
    known = (a > 0) & (b > 0)
    half = (F.abs(2 * a - b) <= 1) | (F.abs(a - 2 * b) <= 1)
    about = (a / b).between(0.84, 1.16) | (a == 10 * b) | (b == 10 * a)
    share = F.when(~known | known.isNull(), zero).when(a == b, FOR["quantity"]).when(half, FOR["part"]).when(about, FOR["about"]).otherwise(F.lit(-AGAINST["quantity"]))
    pro, con = pro + F.greatest(share, zero), con + F.greatest(-share, zero)
    a, b = both("day")
    rule("dates", a.isNotNull() & b.isNotNull(), F.coalesce((a - b).between(*DAYS), F.lit(False)))
    (c, d), (e, f) = both("code"), both("product")
    return pro, con, (c != "") & (c == d) | (e != "") & (e == f)


#: Small columns of a line that exclude a pair where they differ: hashes of the family, of the only dimensions and of the
#: only model reference (0 where unknown or several), and the day.
SMALL = ["fam", "dim", "ref", "day"]


def small(df: DataFrame) -> DataFrame:
    only = {c: F.when(F.size(x) == 1, F.hash(F.get(x, F.lit(0)))).otherwise(0) for c, x in (("dim", "sizes"), ("ref", "models"))}
    return df.withColumn("fam", F.when(F.col("family") != "", F.hash("family")).otherwise(0)).withColumns(only)


def agree(p: str, n: str) -> Column:
    """Hard rules on the small columns: one family, dimensions and model where both are known, the order not before the notice."""
    out = F.coalesce(F.col(f"{p}.day") >= F.col(f"{n}.day") + DAYS[0], F.lit(True))
    for c in SMALL[:3]:
        out = out & ((F.col(f"{p}.{c}") == 0) | (F.col(f"{n}.{c}") == 0) | (F.col(f"{p}.{c}") == F.col(f"{n}.{c}")))
    return out


def lines(df: DataFrame, line_id: str, group: Column, texts: tuple[Column, Column], code: Column, product: Column, family: Column, quantity: Column, unit: Column, day: Column) -> DataFrame:
    """Lines in the common form; of rows with one id any one of the latest counts is chosen before.

    Kept: id, grp (order or notice), buyer (its number before the first dash), the parts of the texts, the
    digits of the product code, product and family names folded, quantity, unit, day.
    """
    base = df.select(
        F.col(line_id).cast("long").alias("id"), group.alias("grp"), F.coalesce(F.substring_index(group, "-", 1), F.lit("")).alias("buyer"), *[t.alias(f"t{i}") for i, t in enumerate(texts)],
        F.coalesce(F.regexp_replace(code, r"\D", ""), F.lit("")).alias("code"), F.coalesce(fold_accents(squeeze(product)), F.lit("")).alias("product"), F.coalesce(fold_accents(squeeze(family)), F.lit("")).alias("family"),
        quantity.cast("double").alias("quantity"), F.coalesce(F.substring(fold_accents(squeeze(unit)), 1, 2), F.lit("")).alias("unit"), day.cast("int").alias("day"),
    ).where("id IS NOT NULL AND grp IS NOT NULL")
    return base.withColumn("s", _spec("t0", "t1")).drop("t0", "t1").select("*", "s.*").drop("s")


FIELDS = ["models", "sizes", "words", "colour", "material", "code", "product", "family", "unit", "buyer", "quantity", "day"]
KEYS = T.ArrayType(T.LongType())


def candidates(orders: DataFrame, notices: DataFrame) -> DataFrame:
    """Scored candidate pairs: p, o, n, nt (order line, order, notice line, notice), pro, con, rel.

    Besides the lines of common blocks, an order line without model and dimensions meets the notice lines of
    its buyer, of its family where both are known, that share a word or the product code; and all lines of
    an order and a notice meet of which any two are a candidate. Pairs that differ in family, in their only
    dimensions or only model reference, or whose order is older than the notice are no candidates. ``rel`` is
    what a pair counts as once its order and notice belong together: 1 if both name one product.
    """
    n_notices = notices.count()
    shared = orders.sparkSession.sparkContext.broadcast(Weights(frequencies(notices), n_notices))

    def keyed(df: DataFrame, side: int) -> DataFrame:
        @F.pandas_udf(KEYS)
        def keys(models: pd.Series, sizes: pd.Series, words: pd.Series, colour: pd.Series, buyer: pd.Series, family: pd.Series, quantity: pd.Series) -> pd.Series:
            weigh = shared.value
            out = []
            for m, s, ws, c, b, f, q in zip(models, sizes, words, colour, buyer, family, quantity):
                rare = [w for w in ws if weigh(w) >= weigh.rare_from]
                out.append([xxhash.xxh3_64_intdigest(k) - (1 << 63) for k in block_keys(list(m), list(s), rare, c or "", b, f, None if q != q else q, bool(side))])
            return pd.Series(out)

        return small(df).select(F.explode(keys("models", "sizes", "words", "colour", "buyer", "family", "quantity")).alias("block"), "id", F.lit(side).cast("byte").alias("side"), *SMALL)

    def known(c: str) -> Column:
        return F.when(F.col(c) != 0, F.array(c)).otherwise(F.array().cast("array<int>"))

    live = split_hot(keyed(orders, 0).unionByName(keyed(notices, 1)), [known(c) for c in SMALL[:3]], HOT_PAIRS, "side")
    l, r = live.where("side = 0").alias("l"), live.where("side = 1").alias("r")
    pairs = l.join(r, may_meet("l", "r") & agree("l", "r")).select(F.col("l.id").alias("p"), F.col("r.id").alias("n"))
    pairs = pairs.unionByName(same_buyer(orders, notices)).distinct()

    p_side = orders.select(F.col("id").alias("p"), F.col("grp").alias("o"), F.struct(*FIELDS).alias("fp"))
    n_side = notices.select(F.col("id").alias("n"), F.col("grp").alias("nt"), F.struct(*FIELDS).alias("fn"))
    pro, con, product = evidence("fp", "fn")

    @F.pandas_udf(T.DoubleType())
    def text(wp: pd.Series, wn: pd.Series) -> pd.Series:
        weight = shared.value
        return pd.Series([near_words(list(a), list(b), lambda w: min(6.0, weight(w))) for a, b in zip(wp, wn)], dtype="float64")

    def scored(both: DataFrame, least: float) -> DataFrame:
        weighed = both.select("p", "o", "n", "nt", F.col("fp.words").alias("wp"), F.col("fn.words").alias("wn"), pro.alias("pro0"), con.alias("con0"), product.alias("product"))
        # Pairs that no text could make plausible need no look at it: this loses none.
        best = F.col("pro0") + FOR["text"]
        weighed = weighed.where(best >= least * (best + F.col("con0"))).withColumn("r", text("wp", "wn"))
        out = weighed.select("p", "o", "n", "nt", (F.col("pro0") + FOR["text"] * F.col("r")).alias("pro"), (F.col("con0") + AGAINST["text"] * (1 - F.col("r"))).alias("con"), "product")
        own = F.col("pro") / (F.col("pro") + F.col("con"))
        return out.where(F.col("pro") >= least * (F.col("pro") + F.col("con"))).withColumn("rel", F.when(F.col("product"), 1.0).otherwise(own)).drop("product")

    first = materialize(scored(pairs.join(p_side, "p").join(n_side, "n"), PLAUSIBLE))
    linked = broadcast_if_small(materialize(first.select("o", "nt").distinct()))
    beside = small(orders).select(F.col("id").alias("p"), F.col("grp").alias("o"), *SMALL).join(linked, "o").alias("l")
    others = small(notices).select(F.col("id").alias("n"), F.col("grp").alias("nt"), *SMALL).alias("r")
    met = beside.join(others, (F.col("l.nt") == F.col("r.nt")) & agree("l", "r")).select("p", "n")
    siblings = met.join(broadcast_if_small(first.select("p", "n")), ["p", "n"], "left_anti").join(p_side, "p").join(n_side, "n")
    return first.unionByName(scored(siblings, LIFTED))


def same_buyer(orders: DataFrame, notices: DataFrame) -> DataFrame:
    """Pairs p, n of order lines without model and dimensions and notice lines of their buyer that share a word or the code."""
    fields = ["buyer", "code", "words", *SMALL]
    # Lines of known family meet by family and the unknown ones; "?" is the key of unknown families, "*" of all.
    own = F.when(F.col("family") == "", F.array(F.lit("*"))).otherwise(F.array("family", F.lit("?")))
    asked = F.array(F.when(F.col("family") == "", F.lit("?")).otherwise(F.col("family")), F.lit("*"))
    plain = small(orders.where((F.size("models") == 0) & (F.size("sizes") == 0) & (F.col("buyer") != "")))
    a = broadcast_if_small(materialize(plain.select(F.col("id").alias("p"), *fields, F.explode(own).alias("key")))).alias("a")
    b = small(notices.where("buyer <> ''")).select(F.col("id").alias("n"), *fields, F.explode(asked).alias("key")).alias("b")
    shared = F.arrays_overlap("a.words", "b.words") | ((F.col("a.code") != "") & (F.col("a.code") == F.col("b.code")))
    return b.join(a, (F.col("a.buyer") == F.col("b.buyer")) & (F.col("a.key") == F.col("b.key")) & agree("a", "b") & shared).select("p", "n")


LOCAL = "p long, o string, n long, nt string, pro double, con double, rel double, z double, u double, x double, zeta double, v double, moved double"


def local_step(group: np.ndarray, pro: np.ndarray, con: np.ndarray, z: np.ndarray, u: np.ndarray, rel: np.ndarray | None = None, sweeps: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Minimise, for every order line at once, the squared hinges of its pairs with the consensus held at ``z - u``.

    Over truth values x of pairs and their copies zeta of the notices' values:
    pro (1 - x)^2 + con x^2 + TOGETHER (x - zeta)+^2 + SIBLING (zeta + rel - 1 - x)+^2 + RHO/2 (zeta - z + u)^2,
    where the x of a line add up to 1 at most. ``rel`` is what the evidence alone gives unless given: with 1, a pair
    is as true as the link of its order and notice, by the weight SIBLING.
    """
    rel = pro / np.maximum(pro + con, 1e-9) if rel is None else rel
    x, zeta = pro / np.maximum(pro + con, 1e-9), np.clip(z - u, 0, 1)
    n_groups = int(group.max()) + 1 if len(group) else 0
    for _ in range(sweeps):
        up, down = TOGETHER * (x > zeta), SIBLING * (zeta + rel - 1 > x)
        zeta = np.clip((2 * up * x + 2 * down * (x + 1 - rel) + RHO * (z - u)) / (2 * (up + down) + RHO), 0, 1)
        up, down = TOGETHER * (x > zeta), SIBLING * (zeta + rel - 1 > x)
        curve = 2 * (pro + con + up + down)
        pull = 2 * (pro + up * zeta + down * (zeta + rel - 1))
        lo, hi = np.zeros(n_groups), np.full(n_groups, float(pull.max()) if len(pull) else 0.0)
        free = np.clip(pull / curve, 0, 1)
        over = np.bincount(group, free, n_groups) > 1
        for _ in range(30 if over.any() else 0):
            mid = (lo + hi) / 2
            much = np.bincount(group, np.clip((pull - mid[group]) / curve, 0, 1), n_groups) > 1
            lo, hi = np.where(much, mid, lo), np.where(much, hi, mid)
        x = np.where(over[group], np.clip((pull - hi[group]) / curve, 0, 1), free)
    return x, zeta


def solve(pairs: DataFrame, reviews: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Truth values of the pairs: p, o, n, nt, confidence, and what their evidence gives alone.

    ``reviews`` (o, nt, w) are unverified links of orders and notices with their weights; they speak for
    the consensus value of (order, notice). All pairs of an order line are solved together, they are as
    many as its candidates; sums over an order or notice are combined before the shuffle, so neither is
    held in one task. No rule couples two orders, so an order whose residuals (copies against the consensus,
    and the consensus and values against the round before) are all within ``tolerance`` is done and leaves.
    """

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in _whole_lines(batches):
            group, before = np.unique(t["p"].to_numpy(), return_inverse=True)[1], t["x"].to_numpy()
            t["x"], t["zeta"] = local_step(group, *(t[c].to_numpy() for c in ("pro", "con", "z", "u", "rel")))
            t["moved"] = np.abs(t["x"] - before)
            yield t[["p", "o", "n", "nt", "pro", "con", "rel", "z", "u", "x", "zeta", "v", "moved"]]

    review = broadcast_if_small(materialize(reviews.groupBy("o", "nt").agg(F.max("w").alias("w"))))
    start = F.col("pro") / (F.col("pro") + F.col("con"))
    zero = F.lit(0.0)
    state = materialize(pairs.select("p", "o", "n", "nt", "pro", "con", "rel", start.alias("z"), zero.alias("u"), start.alias("x"), start.alias("zeta"), F.lit(1.0).alias("moved"), zero.alias("v")))
    done: list[DataFrame] = []
    for at in range(rounds):
        local = materialize(state.repartition("p").sortWithinPartitions("p").mapInPandas(step, LOCAL))
        sums = local.groupBy("o", "nt").agg(F.sum(F.col("zeta") + F.col("u")).alias("a"), F.count("*").alias("k"), F.max("v").alias("v"), F.max("z").alias("old"), F.max("moved").alias("moved"), F.min("zeta").alias("low"), F.max("zeta").alias("high"))
        sums = sums.join(review, ["o", "nt"], "left")
        w = F.coalesce(F.col("w"), zero)
        curve = 2 * w + 2 * NOTICE_PRIOR + RHO * F.col("k")
        z = F.greatest(zero, F.least(F.lit(1.0), (2 * w + RHO * F.col("a") - F.col("v")) / curve))
        consensus = materialize(sums.select("o", "nt", z.alias("zn"), curve.alias("curve"), "v", "old", "moved", "low", "high"))
        residual = F.max(F.greatest("moved", F.abs(F.col("zn") - F.col("old")), F.abs(F.col("zn") - F.col("low")), F.abs(F.col("zn") - F.col("high"))))
        # A Newton step for the multiplier of "the links of an order add up to 1 at most".
        slope = F.sum(F.when((F.col("zn") > 0) & (F.col("zn") < 1), 1 / F.col("curve")))
        excess = F.sum("zn") - 1
        orders = consensus.groupBy("o").agg(F.greatest(zero, F.max("v") + excess / F.coalesce(slope, F.lit(1.0))).alias("vn"), residual.alias("residual"), F.greatest(zero, excess).alias("excess"))
        orders = orders.withColumn("residual", F.greatest("residual", "excess"))
        new = local.join(consensus.select("o", "nt", "zn").join(orders.select("o", "vn", "residual"), "o"), ["o", "nt"])
        new = materialize(new.select("p", "o", "n", "nt", "pro", "con", "rel", F.col("zn").alias("z"), (F.col("u") + F.col("zeta") - F.col("zn")).alias("u"), "x", "zeta", "moved", F.col("vn").alias("v"), "residual"))
        last = at + 1 == rounds
        done.append((new if last else new.where(F.col("residual") <= tolerance)).select("p", "o", "n", "nt", "x", (F.col("pro") / (F.col("pro") + F.col("con"))).alias("alone")))
        state = new.where(F.col("residual") > tolerance).drop("residual")
        if last or state.isEmpty():
            break
    return reduce(DataFrame.unionByName, done).withColumnRenamed("x", "confidence")


def _whole_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches cut where the order line changes; the rows come sorted by it."""
    held = None
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        last = held["p"].iloc[-1]
        whole = held[held["p"] != last]
        if len(whole):
            held = held[held["p"] == last].reset_index(drop=True)
            yield whole.reset_index(drop=True).copy()
    if held is not None and len(held):
        yield held.copy()


def best_links(solved: DataFrame, accept: float = ACCEPT, shared: float = SHARED) -> DataFrame:
    """The best notice line of each order line, where its confidence is at least ``accept``, or at least ``shared`` though rivals
    take a part of it and its evidence alone gives ``accept``; ties fall to the lower id."""
    best = F.max(F.struct("confidence", (-F.col("n")).alias("m"), "n", "nt", "o", "alone")).alias("b")
    kept = (F.col("b.confidence") >= accept) | (F.col("b.confidence") >= shared) & (F.col("b.alone") >= accept)
    return solved.groupBy("p").agg(best).where(kept).select("p", "b.o", "b.n", "b.nt", "b.confidence")
