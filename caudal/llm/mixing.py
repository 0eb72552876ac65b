"""Mixing sources to target shares of tokens (problem 8).

Documents are sized in tokens of a public tokenizer and packed, per source and shard, in seeded order into
blocks of about equal tokens. Sainte-Lague apportionment gives each source an integer number of blocks by
highest quotients, and again each shard of a source its part; a seeded choice then takes the blocks.
"""

from __future__ import annotations

import base64
import heapq
import math
import os
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caudal.llm.names import edits
from caudal.scale import broadcast_if_small, materialize

#: Rank file of the tokenizer; a path on every executor.
TOKENIZER = os.environ.get("CAUDAL_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS = 8_192
#: A shard of a source holds about so many tokens, so the tasks that pack blocks are of bounded size.
SHARD_TOKENS = 2_000_000
#: Characters tokenized at once; longer texts are cut at white space, which no token spans from the left.
PIECE = 100_000


@lru_cache(maxsize=2)
def _encoding(path: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = TOKENIZER) -> int:
    """Tokens of ``text``; 0 for null."""
    if not text:
        return 0
    e = _encoding(path)
    text = text.encode("utf-8", "replace").decode()
    n, at = 0, 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        if end < len(text):
            m = re.compile(r"(?<=\S)\s(?=\S)").search(text, end)
            end = m.start() if m else len(text)
        n += len(e.encode_ordinary(text[at:end]))
        at = end
    return n


def tokens(text: Column, path: str = TOKENIZER) -> Column:
    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([count_tokens(t, path) for t in texts], dtype="int64")

    return count(text)


def sainte_lague(weights: dict, seats: int, caps: dict | None = None) -> dict:
    """Integer seats by highest quotients weight / (2 k + 1); nobody gets more than its cap.

    Ties fall to the lower key as text. Seats that nobody may take stay empty. Weights that are null or
    not positive get none. Runs in about keys log keys however many the seats.
    """
    caps = caps or {}
    live = {k: float(w) for k, w in weights.items() if w and w > 0 and caps.get(k, seats) > 0}
    got = dict.fromkeys(weights, 0)
    if not live or seats <= 0:
        return got

    def under(d: float) -> dict:  # seats whose quotients are above 1 / (2 d)
        return {k: min(caps.get(k, seats), max(0, math.ceil(w * d - 0.5))) for k, w in live.items()}

    lo, hi = 0.0, 1.0
    while sum(under(hi).values()) <= seats and hi < 1e18:
        lo, hi = hi, hi * 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(under(mid).values()) <= seats else (lo, mid)
    got.update(under(lo))
    left = seats - sum(got.values())
    queue = [(-w / (2 * got[k] + 1), str(k), k) for k, w in live.items() if got[k] < caps.get(k, seats)]
    heapq.heapify(queue)
    while left and queue:
        _, name, k = heapq.heappop(queue)
        got[k] += 1
        left -= 1
        if got[k] < caps.get(k, seats):
            heapq.heappush(queue, (-live[k] / (2 * got[k] + 1), name, k))
    return got


def canonical(c: Column) -> Column:
    """Source name in lower case, with runs of other characters than letters and digits as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")


def sized(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", path: str = TOKENIZER) -> DataFrame:
    """doc_id, source_name (of ``targets``, else null), found_source, tokens.

    Spellings of a source that differ in case and separators, or by one edit in a name of eight letters and
    more, count as that source.
    """
    names = [r["n"] for r in targets.select(canonical(F.col("source_name")).alias("n")).distinct().collect() if r["n"]]

    @F.pandas_udf(T.StringType())
    def resolve(found: pd.Series) -> pd.Series:
        return pd.Series([next((n for n in names if n == f or len(n) >= 8 and f and edits(f, n, 1) <= 1), None) for f in found])

    base = docs.select(F.col(doc_id).alias("doc_id"), canonical(F.col(source)).alias("found_source"), tokens(F.col(text), path).alias("tokens"))
    known = materialize(base.select("found_source").distinct().select("found_source", resolve("found_source").alias("source_name")).where("source_name IS NOT NULL"))
    return base.join(broadcast_if_small(known), "found_source", "left").select("doc_id", "source_name", "found_source", "tokens")


def mix(
    docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, block_tokens: int = BLOCK_TOKENS, path: str = TOKENIZER
) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares).

    The mixture has a row per document taken: doc_id, source_name, shard, block, tokens, copies. The shares
    have a row per source of ``targets`` (source_name, target_share, max_repeats) and one (null) for
    documents of no target: available tokens and blocks, quota of blocks, mixed tokens, actual share.

    Without ``total_tokens`` the mixture is the largest at which no source with documents needs more than
    ``max_repeats`` copies; shares of sources without documents fall to the others in proportion. With a
    larger total the sources stop at their caps and the actual shares show it. A document is in one
    block, whole, so a document without tokens can be taken; blocks of a shard differ by a document at
    most. Null or non-positive shares and repeats give nothing; of several rows for a target the largest
    share counts; no documents or targets give an empty mixture.
    """
    goal = {
        r["n"]: (r["s"]["target_share"], r["s"]["max_repeats"], r["s"]["source_name"])
        for r in targets.groupBy(canonical(F.col("source_name")).alias("n")).agg(F.max(F.struct("target_share", "max_repeats", "source_name")).alias("s")).collect()
        if r["n"]
    }
    all_docs = materialize(sized(docs, targets, path=path))
    known = all_docs.where("source_name IS NOT NULL")
    have = {r["source_name"]: r["t"] for r in known.groupBy("source_name").agg(F.sum("tokens").alias("t")).collect()}

    per = F.create_map(*[F.lit(x) for k, t in have.items() for x in (k, max(1, math.ceil((t or 0) / SHARD_TOKENS)))]) if have else None
    order = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))
    shard = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id").cast("string")), F.element_at(per, F.col("source_name"))) if have else F.lit(0).cast("long")
    placed = known.withColumn("shard", shard)
    blocks = F.greatest(F.lit(1), F.round(F.sum("tokens") / block_tokens)).cast("int")
    shards = materialize(placed.groupBy("source_name", "shard").agg(F.sum("tokens").alias("shard_tokens"), blocks.alias("n_blocks")))
    # Shards with as many blocks are alike: what reaches the driver is one row a source and number of blocks.
    alike = [(r["source_name"], r["n_blocks"], r["n"]) for r in shards.groupBy("source_name", "n_blocks").agg(F.count("*").alias("n")).collect()]
    held: dict[str, int] = {}
    for s, b, n in alike:
        held[s] = held.get(s, 0) + b * n

    wanted = {s: goal[s][0] for s in held if (goal[s][0] or 0) > 0 and (goal[s][1] or 0) > 0}
    caps = {s: held[s] * int(goal[s][1]) for s in wanted}
    whole = sum(wanted.values())
    if total_tokens is None:
        seats = math.floor(min((caps[s] * whole / wanted[s] for s in wanted), default=0))
    else:
        seats = total_tokens // block_tokens
    quota = sainte_lague(wanted, seats, caps)

    rows = []
    for s in wanted:  # within a source, shards get seats by the same rule; alike ones share a base and some get one more
        base, extra = _by_kind([(b, n) for src, b, n in alike if src == s], quota[s], int(goal[s][1]))
        rows += [(s, b, base[b], extra[b]) for b in base]
    plan = docs.sparkSession.createDataFrame(rows, "source_name string, n_blocks int, base long, extra long")
    rank = F.row_number().over(Window.partitionBy("source_name", "n_blocks").orderBy(F.xxhash64(F.lit(seed + 2), "shard"), "shard"))
    shards = shards.join(F.broadcast(plan), ["source_name", "n_blocks"]).withColumn("take", F.col("base") + (rank <= F.col("extra")).cast("int"))
    shards = materialize(shards.select("source_name", "shard", "shard_tokens", "n_blocks", "take"))

    before = F.sum("tokens").over(Window.partitionBy("source_name", "shard").orderBy(order, "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1))
    block = F.least(F.col("n_blocks") - 1, F.floor(F.coalesce("before", F.lit(0)) * F.col("n_blocks") / F.greatest("shard_tokens", F.lit(1)))).cast("int")
    first = F.pmod(F.xxhash64(F.lit(seed + 3), "source_name", "shard"), F.col("n_blocks"))
    turn = F.pmod(F.col("block") - first, F.col("n_blocks"))
    copies = (F.floor(F.col("take") / F.col("n_blocks")) + (turn < F.pmod("take", "n_blocks")).cast("int")).cast("int")
    packed = placed.withColumn("before", before).join(broadcast_if_small(shards), ["source_name", "shard"]).withColumn("block", block)
    mixture = materialize(packed.withColumn("copies", copies).where("copies > 0").select("doc_id", "source_name", "shard", "block", "tokens", "copies"))

    used = mixture.groupBy("source_name").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies"))
    available = all_docs.groupBy("source_name").agg(F.sum("tokens").alias("available_tokens"), F.count("*").alias("documents"))
    listed = docs.sparkSession.createDataFrame(
        [(k, n, float(t) if t is not None else None, int(m) if m is not None else None, held.get(k, 0), quota.get(k, 0)) for k, (t, m, n) in goal.items()],
        "source_name string, name string, target_share double, max_repeats int, blocks long, quota_blocks long",
    )
    joined = listed.join(available.where("source_name IS NOT NULL"), "source_name", "left").join(used, "source_name", "left")
    none = available.where("source_name IS NULL").select(
        F.lit(None).cast("string").alias("source_name"), F.lit(None).cast("double").alias("target_share"), F.lit(None).cast("int").alias("max_repeats"), F.lit(0).cast("long").alias("blocks"), F.lit(0).cast("long").alias("quota_blocks"),
        "documents", "available_tokens", F.lit(0).cast("long").alias("mixed_tokens"), F.lit(0).alias("most_copies"),
    )
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("documents", "available_tokens", "mixed_tokens")]
    shares = joined.select(F.col("name").alias("source_name"), "target_share", "max_repeats", "blocks", "quota_blocks", *zero, F.coalesce("most_copies", F.lit(0)).alias("most_copies")).unionByName(none)
    total = used.agg(F.sum("mixed_tokens").alias("t")).first()["t"] or 0
    return mixture, shares.withColumn("actual_share", F.col("mixed_tokens") / F.lit(float(max(1, total))))


def _by_kind(kinds: list[tuple[int, int]], seats: int, repeats: int) -> tuple[dict[int, int], dict[int, int]]:
    """Seats of shards grouped by their number of blocks: seats each shard has, and how many have one more.

    By Sainte-Lague a shard of b blocks has its k-th seat at quotient b / (2 k - 1); shards of equal b tie
    and come into their k-th seats together.
    """
    base = {b: 0 for b, _ in kinds}
    extra = {b: 0 for b, _ in kinds}
    if not kinds or seats <= 0:
        return base, extra

    def at(d: float) -> dict[int, int]:
        return {b: min(b * repeats, max(0, math.ceil(b * d - 0.5))) for b, _ in kinds}

    lo, hi = 0.0, 1.0
    count = lambda x: sum(x[b] * n for b, n in kinds)
    while count(at(hi)) <= seats and hi <= 4 * repeats + 4:
        lo, hi = hi, hi * 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if count(at(mid)) <= seats else (lo, mid)
    base = at(lo)
    left = seats - count(base)
    for b, n in sorted(kinds, key=lambda k: (-k[0] / (2 * base[k[0]] + 1), k[0])):
        if left and base[b] < b * repeats:
            extra[b] = min(n, left)
            left -= extra[b]
    return base, extra
