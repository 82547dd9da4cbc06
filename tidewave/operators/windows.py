"""Window and sampling operators: top rows per group, shares, gap filling, seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each group in a total order; `rank` names a column for the position. The planner keeps n rows a group before the shuffle."""
    rn = rank or "__rn"
    out = df.withColumn(rn, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rn) <= n)
    return out if rank else out.drop(rn)


def with_group(df: DataFrame, by: list[str], **totals: Column) -> DataFrame:
    """Every row with totals of its group (nulls are a group), summed up before they are joined back: unlike a window, no group is one task."""
    t = df.groupBy(*by).agg(*[c.alias(name) for name, c in totals.items()]).select(*[F.col(b).alias(f"__of_{b}") for b in by], *totals)
    same = F.lit(True)
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"__of_{b}"))
    return df.join(t, same).drop(*[f"__of_{b}" for b in by])


def latest(df: DataFrame, by: list[str], time: str, *tie: str) -> DataFrame:
    """The newest row of each key (nulls oldest)."""
    return top_per_group(df, by, [F.col(time).desc_nulls_last(), *[F.col(t).desc_nulls_last() for t in tie]])


def drop_duplicates_keep_first(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, by, order)


def share_of_group(df: DataFrame, value: str, by: list[str], out: str) -> DataFrame:
    return with_group(df, by, __sum=F.sum(value)).withColumn(out, F.try_divide(F.col(value), F.col("__sum"))).drop("__sum")


def position(df: DataFrame, by: list[str], order: list[Column], out: str = "position") -> DataFrame:
    """0-based position in the group."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def days_since_last(df: DataFrame, by: list[str], day: str, happened: Column, default: int = 100, out: str = "days_since") -> DataFrame:
    """Days since the last row, this one included, for which `happened`; `default` if there was none."""
    w = Window.partitionBy(*by).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.coalesce(F.datediff(F.col(day), F.last(F.when(happened, F.col(day)), ignorenulls=True).over(w)), F.lit(default)))


def relative_to_group(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Add from_start, span, part (of the span; null if it is 0) and n_items of the group."""
    df = with_group(df, by, __low=F.min(value), __high=F.max(value), n_items=F.count("*"))
    df = df.withColumn("from_start", F.col(value) - F.col("__low")).withColumn("span", F.col("__high") - F.col("__low")).drop("__low", "__high")
    return df.withColumn("part", F.try_divide(F.col("from_start").cast("double"), F.col("span").cast("double")))


def gradient(df: DataFrame, by: list[str], order: str, value: str, out: str = "gradient", log: bool = False) -> DataFrame:
    """Central difference of `value` in unit steps, one-sided at the ends (null for a single row); with `log` of log10(value + 1e-6)."""
    w = Window.partitionBy(*by).orderBy(order)
    v = F.log10(F.col(value) + 1e-6) if log else F.col(value)
    df = df.withColumn("__v", v).withColumn("__b", F.lag("__v").over(w)).withColumn("__a", F.lead("__v").over(w))
    g = F.when(F.col("__b").isNull(), F.col("__a") - F.col("__v")).when(F.col("__a").isNull(), F.col("__v") - F.col("__b")).otherwise((F.col("__a") - F.col("__b")) / 2)
    return df.withColumn(out, g).drop("__v", "__a", "__b")


def hash_order(key: Column, seed: int = 0) -> Column:
    """A reproducible pseudo-random order of integer keys that other engines can compute too: a linear congruential step."""
    return F.pmod(F.pmod(key.cast("bigint"), F.lit(2147483647)) * 1103515245 + F.lit(12345 + seed), F.lit(2147483648))


def sample_per_group(df: DataFrame, by: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """n pseudo-random rows of each group, the same in every run."""
    return top_per_group(df, by, [hash_order(F.col(key), seed), F.col(key)], n)


def bernoulli(df: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """Each row with probability `fraction`, decided by its key alone."""
    return df.where(hash_order(F.col(key), seed) < int(fraction * 2147483648))


def rebalanced(df: DataFrame, by: list[str], kind: str, key: str, factors: dict[str, int], base: list[str], seed: int = 0) -> DataFrame:
    """Per group, of each kind as many rows as the smallest of the `base` kinds has, times the kind's factor."""
    sizes = df.where(F.col(kind).isin(base)).groupBy(*by, kind).count().groupBy(*by).agg(F.min("count").alias("__n"))
    factor = F.create_map(*[x for k, v in factors.items() for x in (F.lit(k), F.lit(v))])
    ranked = df.join(sizes, by).withColumn("__rn", F.row_number().over(Window.partitionBy(*by, kind).orderBy(hash_order(F.col(key), seed), key)))
    return ranked.where(F.col("__rn") <= F.col("__n") * F.coalesce(F.try_element_at(factor, F.col(kind)), F.lit(1))).drop("__rn", "__n")


def shard(key: Column, n: int) -> Column:
    """sha256(key) mod n, folded over the digest's 16-bit groups so that nothing overflows."""
    digest = F.sha2(key, 256)
    out = F.lit(0)
    for i in range(16):
        out = (out * 65536 + F.conv(F.substring(digest, 4 * i + 1, 4), 16, 10).cast("bigint")) % n
    return out


def group_split(key: Column, train: float = 0.75, seed: int = 0) -> Column:
    """True for the groups of the training side; all rows of a key fall on one side."""
    return hash_order(key, seed) < int(train * 2147483648)
