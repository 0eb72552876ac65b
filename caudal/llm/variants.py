"""Variant spellings of names: block by phonetic codes, compare, cluster (problem 6)."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import combinations
from operator import and_

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caudal.llm.blocks import may_meet, split_hot
from caudal.llm.components import components
from caudal.llm.leakage import words_of
from caudal.llm.names import Name, align, codes, edits, parse, phonetic, similarity
from caudal.scale import materialize

#: Least similarity of two names of one entity.
ACCEPT = 0.86
#: A block that would give more pairs than this is split by the attributes of its records, one after the other.
HOT_PAIRS = 2_000


@dataclass(frozen=True)
class Attributes:
    """Columns of a record set. ``names`` are compared; records that differ in ``same`` (where both are
    known) are different; ``identity`` may differ by one mistyped character; ``owner`` names what the
    record belongs to, by code (first) and by name; the first of ``same`` is the place."""

    key: str
    names: tuple[str, ...]
    same: tuple[str, ...]
    identity: str | None = None
    owner: tuple[str, str] | None = None
    units: bool = False


FEATURES = T.StructType([T.StructField("f", T.StringType()), T.StructField("known", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("codes", T.ArrayType(T.ArrayType(T.StringType())))])


def _plain(text: str | None) -> str:
    return " ".join(words_of(text or ""))


def features(names: list[str | None], same: list[str | None], identity: str | None, owner: list[str | None], units: bool) -> tuple[str, list[list[str]], list[list[str]]] | None:
    """What is compared of a record, as JSON; its place, other attributes, owner's code and given names, each none, one
    or more values; the phonetic codes of its names."""
    parsed = [n for n in dict.fromkeys(parse(t, units) for t in names) if n]
    if not parsed:
        return None
    places = [_plain(s) for s in same]
    ident = re.sub(r"[^0-9K]", "", (identity or "").upper())
    own = [re.sub(r"\W", "", (owner[0] or "").lower()), _plain(owner[1])] if owner else ["", ""]
    f = json.dumps([[[*map(list, (n.core, n.given, n.initials, sorted(n.kind))), n.suffix] for n in parsed], places, ident, own], ensure_ascii=False)
    known = [[x] if x else [] for x in [*places, own[0]]]
    return f, [*known, sorted({g for n in parsed for g in n.given})], [codes(n) + [i for i in n.initials] for n in parsed]


@lru_cache(maxsize=20_000)
def _load(f: str) -> tuple[list[Name], list[str], str, list[str]]:
    names, places, ident, own = json.loads(f)
    return [Name(tuple(c), tuple(g), tuple(i), frozenset(k), s) for c, g, i, k, s in names], places, ident, own


def _same_owner(a: list[str], b: list[str]) -> bool:
    if a[0] and b[0]:
        return a[0] == b[0]
    x, y = a[1].split(), b[1].split()
    if not x or not y:
        return True
    _, left, right = align(tuple(w for w in x if len(w) > 2), tuple(w for w in y if len(w) > 2))
    left = [w for w in left if not any(v.startswith(w[:3]) for v in right)]
    return len(left) <= 1


def match(a: str, b: str, units: bool) -> float:
    """Likeness of two records as ``features`` gives them; 0 where an attribute contradicts."""
    na, pa, ia, oa = _load(a)
    nb, pb, ib, ob = _load(b)
    if any(x and y and x != y for x, y in zip(pa, pb)) or not _same_owner(oa, ob):
        return 0.0
    known = bool(ia and ib)
    if known and ia != ib and edits(ia, ib, 1) > 1:
        return 0.0
    ga, gb = {g for n in na for g in n.given}, {g for n in nb for g in n.given}
    if ga and gb and not ga & gb:
        return 0.0
    best = max(similarity(x, y, units) for x in na for y in nb)
    if known and ia == ib and best < ACCEPT:  # the same number makes up for a name too damaged to compare
        xs, ys = {w for n in na for w in n.core + n.given}, {w for n in nb for w in n.core + n.given}
        if align(tuple(xs), tuple(ys))[0]:
            return ACCEPT
    return best


def link_members(df: DataFrame, a: Attributes) -> DataFrame:
    """Entity of every key: key, entity (a number; keys of one entity bear the same).

    Records whose compared features agree count as one class, so copies are compared once. Classes are
    blocked by phonetic codes of their sorted telling words: two codes together, or one code with the first
    or last sound of another word, or the whole name, or the identity number. No block asks for a place or
    other attribute, so a record in which they are unknown meets all of its blocks, and no code is too common
    to form one. Hot blocks are split by contradicting attributes (``split_hot``). Pairs with differing known
    attributes are dropped before their names are compared. Accepted pairs are clustered by connected
    components, over classes that share a key as well.

    Null keys and records without any name are left out; repeated rows count once; an empty table gives
    no rows.
    """

    def fields(frame: pd.DataFrame, cols: tuple[str, ...]) -> list[list[str | None]]:
        return [[None if v is None or v != v else v for v in row] for row in frame[list(cols)].itertuples(index=False, name=None)]

    wanted = list(dict.fromkeys([*a.names, *a.same, *([a.identity] if a.identity else []), *(a.owner or ())]))
    attrs, levels = a, len(a.same) + 2

    @F.pandas_udf(FEATURES)
    def extract(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.astype(object).where(frame.notna(), None)
        names, same = fields(frame, attrs.names), fields(frame, attrs.same)
        ident = fields(frame, (attrs.identity,)) if attrs.identity else [[None]] * len(frame)
        owner = fields(frame, attrs.owner) if attrs.owner else [None] * len(frame)
        rows = [features(n, s, i[0], o, attrs.units) for n, s, i, o in zip(names, same, ident, owner)]
        return pd.DataFrame([r or (None, None, None) for r in rows], columns=["f", "known", "codes"])

    records = df.select(F.col(a.key).cast("string").alias("key"), F.struct(*[F.col(c).cast("string").alias(c) for c in wanted]).alias("r")).where("key IS NOT NULL").distinct()
    records = materialize(records.select("key", extract("r").alias("x")).where("x.f IS NOT NULL").select("key", "x.*").withColumn("class", F.xxhash64("f")))
    classes = materialize(records.dropDuplicates(["class"]).drop("key"))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def blocks(codes_: pd.Series, f: pd.Series) -> pd.Series:
        out = []
        for cs, feats in zip(codes_, f):
            keys = set()
            for one in cs:
                one = sorted(set(one))
                long = [x for x in one if len(x) > 1]
                keys.update(f"2|{x}|{y}" for x, y in combinations(long, 2))
                for x in long:
                    keys.update(f"e|{x}|{e}" for y in one if y != x for e in (f"<{y[0]}", f">{y[-1]}"))
                if len(long) == 1:
                    keys.add(f"e|{long[0]}|")
            names, _, ident, _ = _load(feats)
            if ident:
                keys.add(f"i|{ident}")
            for nm in names:
                whole = "".join(nm.core)
                if len(whole) >= 6:
                    keys.add(f"w|{phonetic(whole)}")
            out.append(sorted(keys))
        return pd.Series(out)

    keyed = classes.select("class", "known", F.explode(blocks("codes", "f")).alias("block")).withColumn("block", F.xxhash64("block"))
    live = split_hot(keyed, [F.get("known", F.lit(i)) for i in range(levels)], HOT_PAIRS)
    l, r = live.alias("l"), live.alias("r")
    agree = []
    for i in range(levels):
        x, y = F.get("l.known", F.lit(i)), F.get("r.known", F.lit(i))
        agree.append((F.size(x) == 0) | (F.size(y) == 0) | F.arrays_overlap(x, y))
    met = l.join(r, reduce(and_, [may_meet("l", "r"), F.col("l.class") < F.col("r.class"), *agree]))
    pairs = materialize(met.select(F.col("l.class").alias("a"), F.col("r.class").alias("b")).distinct())
    feats = classes.select("class", "f")
    both = pairs.join(feats.select(F.col("class").alias("a"), F.col("f").alias("fa")), "a").join(feats.select(F.col("class").alias("b"), F.col("f").alias("fb")), "b")

    @F.pandas_udf(T.DoubleType())
    def score(fa: pd.Series, fb: pd.Series) -> pd.Series:
        return pd.Series([match(x, y, attrs.units) for x, y in zip(fa, fb)], dtype="float64")

    accepted = both.withColumn("score", score("fa", "fb")).where(F.col("score") >= ACCEPT).select("a", "b")
    shared = records.select("key", "class").distinct()
    own = shared.groupBy("key").agg(F.min("class").alias("a"))  # classes of one key, and each class by itself
    edges = accepted.unionByName(shared.join(own, "key").select("a", F.col("class").alias("b")))
    labels = components(edges)
    return materialize(shared.join(labels.withColumnRenamed("node", "class"), "class").select("key", F.col("component").alias("entity")).distinct())


def link_variants(df: DataFrame, a: Attributes) -> DataFrame:
    """Pairs of keys of one entity: key_a < key_b as strings, all pairs of an entity, from ``link_members``."""
    members = link_members(df, a)
    members = members.join(members.groupBy("entity").agg(F.count("*").alias("n")).where("n > 1").select("entity"), "entity", "left_semi")
    return (
        members.alias("l")
        .join(members.alias("r"), (F.col("l.entity") == F.col("r.entity")) & (F.col("l.key") < F.col("r.key")))
        .select(F.col("l.key").alias("key_a"), F.col("r.key").alias("key_b"))
    )


SUPPLIERS = Attributes("supplier_key", ("nombre_proveedor", "razon_social_proveedor"), ("comuna_proveedor", "region_proveedor", "actividad_proveedor"), identity="rut_proveedor")
BUYERS = Attributes("buyer_key", ("unidad_compra",), ("ciudad_unidad_compra", "region_unidad_compra"), owner=("codigo_organismo_publico", "organismo_publico"), units=True)
