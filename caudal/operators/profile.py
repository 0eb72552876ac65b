"""Column profiles per load and the loads that depart from the others (problem 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caudal.scale import broadcast_if_small, materialize

#: Texts longer than this are stood for by their SHA-256 in the distinct shuffle, and their range is looked up afterwards.
HEAD = 32
#: Days before and after the origin beyond which a date measures as that many, so that sentinels don't outweigh all others.
DAYS = (-400, 800)
#: Texts measure as a hash in (-HASHES, HASHES): how often each value occurs decides the mean of that.
HASHES = 1000
#: Statistics of a load and column that are set against the other loads.
DIFFERENCES = ["std_difference", "spread_difference", "null_difference", "violation_difference", "distinct_difference"]


def measure(c: Column, kind: T.DataType, origin: Column | None = None) -> Column | None:
    """Integer measure whose powers are summed exactly; None for arrays, maps and the like.

    Numbers: thousandths of the signed decimal logarithm of 1 + |x|; booleans 0 and 1; dates: whole days
    since ``origin``, within ``DAYS``, or since 1970; texts: a hash.
    """
    if isinstance(kind, T.BooleanType):
        return c.cast("long")
    if isinstance(kind, T.NumericType):
        x = c.cast("double")
        return F.when(F.isnan(x), None).otherwise(F.round(F.signum(x) * F.log10(1 + F.least(F.abs(x), F.lit(1e300))) * 1000)).cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        seconds = F.unix_seconds(c.cast("timestamp"))
        if origin is None:
            return F.floor(seconds / 86400).cast("long")
        days = F.floor((seconds - F.unix_seconds(origin.cast("timestamp"))) / 86400)
        return F.when(days.isNotNull(), F.greatest(F.lit(DAYS[0]), F.least(F.lit(DAYS[1]), days))).cast("long")
    if isinstance(kind, T.StringType):
        return F.when(c.isNotNull(), F.pmod(F.xxhash64(c), F.lit(2 * HASHES - 1)) - HASHES + 1).cast("long")
    return None


def profile(
    df: DataFrame, load: str, columns: list[str] | None = None, patterns: dict[str, str] | None = None, origin: str | None = None
) -> DataFrame:
    """Profile of each column in each load.

    Rows, nulls, exact distinct values, ranges (``number_min/max`` of numbers, ``text_min/max`` of all
    else as text), longest text, regex violations (``patterns``: column to pattern that a whole value must
    match), exact power sums 1 to 4 of ``measure``, and what ``differences`` makes of them.

    The power sums are decimals of integers: partial sums merge exactly in any order. Rows are combined
    by (load, column, value) before the shuffle, so a value or load that holds a third of the rows is no
    hot group. A null load is a load of its own; a column of nulls has null ranges and moments; an empty
    table gives no rows; arrays, maps, structs and binaries are not profiled unless named.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    patterns = patterns or {}
    columns = columns or [c for c, k in df.dtypes if c != load and not k.startswith(("array", "map", "struct", "binary"))]
    if origin:
        # One origin a load (its latest), so that all that is kept of a cell follows from load, column and value.
        loads = materialize(df.groupBy(F.col(f"`{load}`").alias("__load")).agg(F.max(origin).alias("__origin")))
        df = df.join(broadcast_if_small(loads), F.col(f"`{load}`").eqNullSafe(F.col("__load")), "left")
    cells = []
    for name in columns:
        c, text = F.col(f"`{name}`"), F.col(f"`{name}`").cast("string")
        numeric = isinstance(kinds[name], T.NumericType)
        m = measure(c, kinds[name], F.col("__origin") if origin else None)
        cells.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.when(F.length(text) > HEAD, F.sha2(text, 256)).otherwise(text).alias("value"),
                F.left(text, F.lit(HEAD)).alias("head"),
                (c.cast("double") if numeric else F.lit(None).cast("double")).alias("number"),
                (F.lit(None).cast("long") if m is None else m).alias("m"),
                (~text.rlike(f"^(?:{patterns[name]})$") if name in patterns else F.lit(None).cast("boolean")).alias("bad"),
                F.length(text).alias("chars"),
            )
        )
    grouped = (
        df.select(F.col(f"`{load}`").alias("load_id"), F.explode(F.array(*cells)).alias("c"))
        .groupBy("load_id", "c.column_name", "c.value", "c.head", "c.number", "c.m", "c.bad", "c.chars")
        .agg(F.count("*").alias("n"))
    )
    m, n = F.col("m").cast("decimal(10,0)"), F.col("n").cast("decimal(12,0)")
    powers, p = [], n
    for k in range(1, 5):
        p = (p * m).cast("decimal(38,0)") if k > 1 else (n * m).cast("decimal(38,0)")
        powers.append(F.try_sum(p).alias(f"power_sum_{k}"))
    stats = grouped.groupBy("load_id", "column_name").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_nulls"),
        F.count("value").alias("n_distinct"),
        F.min("number").alias("number_min"), F.max("number").alias("number_max"),
        F.min(F.when(F.col("number").isNull(), F.col("head"))).alias("text_min"),
        F.max(F.when(F.col("number").isNull(), F.col("head"))).alias("text_max"),
        F.max("chars").alias("max_chars"),
        F.coalesce(F.sum(F.when(F.col("bad"), F.col("n"))), F.lit(0)).alias("n_violations"),
        F.coalesce(F.sum(F.when(F.col("m").isNotNull(), F.col("n"))), F.lit(0)).alias("n_measured"),
        *powers,
    )
    return differences(_whole_ends(df, load, materialize(stats), [c for c in columns if isinstance(kinds[c], T.StringType)]))


def _whole_ends(df: DataFrame, load: str, stats: DataFrame, texts: list[str]) -> DataFrame:
    """``stats`` with the whole least and greatest texts where it has only their first ``HEAD`` characters.

    Only texts that begin like such an end are read again; they are combined before the shuffle.
    """
    cut = stats.where((F.length("text_min") == HEAD) | (F.length("text_max") == HEAD)).select("load_id", "column_name", "text_min", "text_max")
    names = sorted(r["column_name"] for r in cut.select("column_name").distinct().collect() if r["column_name"] in texts)  # columns of one table
    if not names:
        return stats
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("text")) for c in names])
    rows = df.select(F.col(f"`{load}`").alias("l"), F.explode(cells).alias("c")).select("l", "c.*").where("text IS NOT NULL").withColumn("head", F.left("text", F.lit(HEAD)))
    e, r = F.broadcast(cut).alias("e"), rows.alias("r")  # one row a load and column
    near = r.join(e, F.col("r.l").eqNullSafe(F.col("e.load_id")) & (F.col("r.column_name") == F.col("e.column_name")) & ((F.col("head") == F.col("text_min")) | (F.col("head") == F.col("text_max"))))
    ends = near.groupBy("e.load_id", "e.column_name").agg(F.min(F.when(F.col("head") == F.col("text_min"), F.col("text"))).alias("least"), F.max(F.when(F.col("head") == F.col("text_max"), F.col("text"))).alias("greatest"))
    ends = materialize(ends.select(F.col("load_id").alias("l2"), F.col("column_name").alias("c2"), "least", "greatest"))
    both = stats.join(F.broadcast(ends), F.col("load_id").eqNullSafe(F.col("l2")) & (F.col("column_name") == F.col("c2")), "left")
    return both.withColumn("text_min", F.coalesce("least", "text_min")).withColumn("text_max", F.coalesce("greatest", "text_max")).select(*stats.columns)


def differences(stats: DataFrame) -> DataFrame:
    """Add moments and standardised differences across loads to the sums of ``profile``.

    mean, sd, skewness of the measure; then how far the load stands from the median of all other loads, in
    standard deviations: ``std_difference`` of the mean, ``spread_difference`` of the mean square,
    ``null_difference``, ``violation_difference`` and ``distinct_difference`` of the shares of nulls among the
    rows, of violations and of distinct values among the others (a share p has the deviation sqrt(p (1 - p))).
    A difference of two constants counts as 10 deviations. Null where nothing is measured or no other load is.
    """
    n, s1, s2, s3, s4 = (F.col(c).cast("double") for c in ("n_measured", "power_sum_1", "power_sum_2", "power_sum_3", "power_sum_4"))
    mean, square, fourth = F.try_divide(s1, n), F.try_divide(s2, n), F.try_divide(s4, n)
    var = F.greatest(F.lit(0.0), square - mean * mean)
    third = F.try_divide(s3, n) - 3 * mean * square + 2 * mean * mean * mean
    filled = (F.col("n_rows") - F.col("n_nulls")).cast("double")
    shares = {"null": F.col("n_nulls") / F.col("n_rows"), "violation": F.try_divide(F.col("n_violations").cast("double"), filled), "distinct": F.try_divide(F.col("n_distinct").cast("double"), filled)}
    own = {"mean": (mean, var), "square": (square, F.greatest(F.lit(0.0), fourth - square * square)), **{k: (p, p * (1 - p)) for k, p in shares.items()}}
    packed = F.struct(F.coalesce("load_id", F.lit("\0")).alias("load_id"), *[x.alias(f"{k}_{i}") for k, xs in own.items() for i, x in enumerate(xs)])
    # One entry a load.
    all_loads = materialize(stats.groupBy("column_name").agg(F.collect_list(packed).alias("all")))
    d = stats.join(broadcast_if_small(all_loads), "column_name")

    def median(field: str) -> Column:
        others = F.filter("all", lambda x: (x.load_id != F.coalesce("load_id", F.lit("\0"))) & x[field].isNotNull())
        values = F.array_sort(F.transform(others, lambda x: x[field]))
        return F.when(F.size(values) > 0, F.get(values, ((F.size(values) - 1) / 2).cast("int")))

    def difference(k: str) -> Column:
        gap = own[k][0] - F.col(f"{k}_0_usual")
        sd = F.sqrt((own[k][1] + F.col(f"{k}_1_usual")) / 2)
        return F.when(F.abs(gap) < 1e-12, F.when(gap.isNotNull(), 0.0)).otherwise(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.when(sd > 0, gap / sd).otherwise(F.signum(gap) * 10))))

    d = d.select("*", *[median(f"{k}_{i}").alias(f"{k}_{i}_usual") for k in own for i in (0, 1)])
    return d.select(
        *stats.columns, mean.alias("mean"), F.sqrt(var).alias("sd"), F.try_divide(third, F.pow(var, F.lit(1.5))).alias("skewness"), *[difference(k).alias(c) for k, c in zip(own, DIFFERENCES)],
    )


def departures(df: DataFrame, load: str, features: dict[tuple[str, str], Column], least_share: float = 0.01, tails: tuple[float, ...] = (0.01, 0.05)) -> DataFrame:
    """Share of a load's rows that depart, in one way, from what a column shows in the other loads.

    ``features`` maps (column, feature name) to an expression that puts a row into a bin (null is a bin).
    For each load and bin the share is set against the median share over all other loads; bins that hold
    more than four standard errors and one percent above it are where the departing rows went. If a part
    s of the rows moved there from the usual mixture, the excess is s (1 - usual share), so
    s = excess / (1 - usual share), both summed over those bins.

    Rows that went to many bins, too few into each to exceed alone, are seen in the tails: for each limit
    in ``tails``, the bins whose usual share is under it are one bin, set against the median tail of the
    other loads in the same way (a bin that exceeds alone stands in its tail with its usual share). The
    greatest s counts.

    Result: load_id, column_name, feature, departing. Bins under ``least_share`` in every load can't
    exceed alone. One load alone has no others and gives no rows; a null load is a load.
    """
    load_id = F.coalesce(F.col(load).cast("string"), F.lit(""))
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(f).alias("feature"), b.cast("string").alias("bin")) for (c, f), b in features.items()])
    counts = df.select(load_id.alias("load_id"), F.explode(cells).alias("c")).groupBy("load_id", "c.column_name", "c.feature", "c.bin").agg(F.count("*").alias("n"))
    totals = materialize(df.groupBy(load_id.alias("load_id")).agg(F.count("*").alias("n_load")))
    n_loads = totals.count()
    if n_loads < 2:
        return counts.limit(0).select("load_id", "column_name", "feature", F.lit(0.0).alias("departing"))
    bins = (
        counts.join(broadcast_if_small(totals), "load_id")
        .withColumn("p", F.col("n") / F.col("n_load"))
        .groupBy("column_name", "feature", "bin")
        .agg(F.collect_list(F.struct("load_id", "p", "n_load")).alias("all"), F.max("p").alias("most"))
        .select("column_name", "feature", "all", "most", F.explode("all").alias("own"))
    )

    def median_of_others(field: str) -> Column:
        others = F.array_sort(F.transform(F.filter("all", lambda x: x.load_id != F.col("own.load_id")), lambda x: x[field]))
        at = F.lit((n_loads - 1) // 2) - (F.lit(n_loads - 1) - F.size(others))  # loads without the bin have none of it
        return F.when(at < 0, 0.0).otherwise(F.get(others, at))

    def exceeds(p: Column, q: Column, n: Column) -> Column:
        return p - q > 4 * F.sqrt(q * (1 - q) / n + 1 / (n * n)) + 0.01

    usual = F.when(F.col("most") < least_share, 0.0).otherwise(median_of_others("p"))
    p, q, n, over = F.col("own.p"), F.col("usual"), F.col("own.n_load"), F.col("over")
    each = bins.withColumn("usual", usual).withColumn("over", (F.col("most") >= least_share) & exceeds(p, q, n))

    def total(c: Column, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, c)), F.lit(0.0))

    parts = [total(p - q, over).alias("excess"), total(q, over).alias("usual")]
    for i, limit in enumerate(tails):
        parts += [total(F.when(over, q).otherwise(p), q < limit).alias(f"tail_{i}"), total(q, over & (q < limit)).alias(f"in_tail_{i}")]
    loads = each.groupBy(F.col("own.load_id").alias("load_id"), "column_name", "feature").agg(F.first(n).alias("n_load"), *parts)
    # At most one row a load.
    loads = loads.groupBy("column_name", "feature").agg(F.collect_list(F.struct(*[c for c in loads.columns if c not in ("column_name", "feature")])).alias("all"))
    loads = loads.select("column_name", "feature", "all", F.explode("all").alias("own"))
    share = [F.col("own.excess") / F.greatest(1 - F.col("own.usual"), F.lit(0.01))]
    for i in range(len(tails)):
        t, m = F.col(f"own.tail_{i}"), F.col(f"median_{i}")
        loads = loads.withColumn(f"median_{i}", median_of_others(f"tail_{i}"))
        rest = 1 - F.col("own.usual") - m + F.col(f"own.in_tail_{i}")
        share.append(F.when(exceeds(t, m, n), (F.col("own.excess") + t - m) / F.greatest(rest, F.lit(0.01))).otherwise(0.0))
    return loads.select(F.col("own.load_id").alias("load_id"), "column_name", "feature", F.greatest(*share).alias("departing")).where("departing > 0")
