"""Tests, intervals, correlation and regression from aggregates; distributions without a statistics library."""

from __future__ import annotations


from math import erfc, exp, lgamma, log, log1p, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewave.operators.windows import with_group
from tidewave.storage import materialize


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    f = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_upper(x: float, k: float) -> float:
    """Upper tail of chi-squared: series below the mean, continued fraction above."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    scale = exp(-x + a * log(x) - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def t_quantile(p: float, df: float) -> float:
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else t_two_sided(a, b) for a, b in zip(t, df)], dtype=float)


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else erfc(abs(x) / sqrt(2)) for x in z], dtype=float)


@F.pandas_udf(T.DoubleType())
def t_half_width(se: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(s) or pd.isna(d) or d <= 0 else s * t_quantile(0.975, d) for s, d in zip(se, df)], dtype=float)


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, mean, sd, min, quartiles (linear interpolation) and max of the known values; groups without any have n 0 and nulls."""
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))
    q = exact_quantiles(df, by, value, [0.25, 0.5, 0.75]).select(*[F.col(b).alias(f"__{b}") for b in by], F.col("quantiles").alias("q"))
    same = F.lit(True)
    for b in by:
        same &= F.col(b).eqNullSafe(F.col(f"__{b}"))
    return out.join(q, same, "left").select(*by, "n", "mean", "sd", "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max")


def with_median(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Every row with its group's exact median (of two middle values their mean); null where the group has no value.

    Values are ranked as distinct values with counts, in a running sum by blocks of a range partition (see exact_quantiles), so no group is one task."""
    return df.join(exact_quantiles(df, by, value, [0.5]).select(*by, F.get("quantiles", F.lit(0)).alias(out)), by, "left")


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], weight: str | None = None) -> DataFrame:
    """by, quantiles: the exact quantiles (linear interpolation) of each group's known values, repeated by an integer `weight` if one is given (0, less and null: left out).

    Distinct values are counted before they are shuffled, range partitioned on (by, value) and summed up in each partition; a row for each group and partition
    tells what came before. So neither a group nor the whole table is ever one task, as it is for the built-in percentile."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    known = known.where(F.col(weight) > 0) if weight else known
    counts = known.groupBy(*by, F.col(value).cast("double").alias("__v")).agg((F.sum(weight).cast("bigint") if weight else F.count("*")).alias("__c"))
    parts = materialize(counts.repartitionByRange(n, *by, "__v").withColumn("__p", F.spark_partition_id()), "counts")
    keys = [*by, "__p"]
    local = parts.withColumn("__upto", F.sum("__c").over(Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)))
    sums = parts.groupBy(*keys).agg(F.sum("__c").alias("__s"))
    sums = sums.select(*[F.col(k).alias(f"{k}_") for k in keys], "__s").withColumn("__total", F.sum("__s").over(Window.partitionBy(*[f"{k}_" for k in by] or [F.lit(0)])))
    sums = sums.withColumn("__skip", F.coalesce(F.sum("__s").over(Window.partitionBy(*[f"{k}_" for k in by] or [F.lit(0)]).orderBy("__p_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"{k}_"))
    ranked = local.join(sums, same).withColumn("__last", F.col("__upto") + F.col("__skip") - 1).withColumn("__first", F.col("__last") - F.col("__c") + 1)
    # The two order statistics around each quantile are the values whose ranks cover them.
    at = [(F.col("__total") - 1) * s for s in shares]
    pick = lambda r: F.max(F.when((F.col("__first") <= r) & (r <= F.col("__last")), F.col("__v")))
    out = ranked.groupBy(*by).agg(*[pick(F.floor(a)).alias(f"__l{i}") for i, a in enumerate(at)], *[pick(F.ceil(a)).alias(f"__h{i}") for i, a in enumerate(at)], *[F.max(a - F.floor(a)).alias(f"__f{i}") for i, a in enumerate(at)])
    return out.select(*by, F.array(*[F.col(f"__l{i}") + (F.col(f"__h{i}") - F.col(f"__l{i}")) * F.col(f"__f{i}") for i in range(len(shares))]).alias("quantiles"))


def count_of_union(columns: list[DataFrame], out: str) -> DataFrame:
    """The number of different non-null values in the union of several one-column tables."""
    every = columns[0].toDF("__v")
    for c in columns[1:]:
        every = every.unionByName(c.toDF("__v"))
    return every.agg(F.countDistinct("__v").alias(out))


def standard_errors(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.try_divide(F.stddev_samp(value), F.sqrt(F.count(value))).alias("sem"))


def mean_intervals(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Means with the half width of their 95 % interval by Student's t."""
    return standard_errors(df, by, value).withColumn("half", t_half_width("sem", (F.col("n") - 1).cast("double")))


def t_test(df: DataFrame, by: list[str], side: str, a: str, b: str, value: str) -> DataFrame:
    """Independent samples, pooled variance: t, df, p."""
    m = lambda s, n: [F.count(F.when(F.col(side) == s, F.col(value))).alias(f"n_{n}"), F.avg(F.when(F.col(side) == s, F.col(value))).alias(f"mean_{n}"), F.var_samp(F.when(F.col(side) == s, F.col(value))).alias(f"var_{n}")]
    s = (df.groupBy(*by) if by else df.groupBy()).agg(*m(a, "a"), *m(b, "b"))
    s = s.withColumn("df", (F.col("n_a") + F.col("n_b") - 2).cast("double"))
    pooled = F.try_divide((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b"), F.col("df"))
    s = s.withColumn("t", F.try_divide(F.col("mean_a") - F.col("mean_b"), F.sqrt(pooled * (F.lit(1.0) / F.col("n_a") + F.lit(1.0) / F.col("n_b")))))
    return s.withColumn("p", t_p("t", "df"))


def paired_t_test(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Paired samples, pairs with a null left out: n, mean_diff, t, df, p."""
    d = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("__d", F.col(a) - F.col(b))
    s = (d.groupBy(*by) if by else d.groupBy()).agg(F.count("*").alias("n"), F.avg("__d").alias("mean_diff"), F.stddev_samp("__d").alias("__s"))
    s = s.withColumn("df", (F.col("n") - 1).cast("double")).withColumn("t", F.try_divide(F.col("mean_diff"), F.col("__s") / F.sqrt("n")))
    return s.withColumn("p", t_p("t", "df")).drop("__s")


def average_ranks(df: DataFrame, by: list[str], value: str, out: str = "rank") -> DataFrame:
    """Ranks from 1, ties at their mean; null values unranked. Ranks are counted on the distinct values, so a value many rows share
    is one row, in range partitions with what came before each, so not even a single group is one task."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c"))
    parts = materialize(counts.repartitionByRange(n, *by, value).withColumn("__p", F.spark_partition_id()), "counts")
    one = by or [F.lit(0)]
    before = parts.groupBy(*by, "__p").agg(F.sum("__c").alias("__s")).withColumn("__skip", F.coalesce(F.sum("__s").over(Window.partitionBy(*one).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy(*by, "__p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = parts.withColumn("__upto", F.sum("__c").over(w)).join(before.drop("__s"), [*by, "__p"])
    ranked = ranked.withColumn(out, F.col("__upto") + F.col("__skip") - (F.col("__c") - 1) / 2).withColumn("__tie", F.col("__c"))
    return df.join(ranked.select(*by, value, out, "__tie"), [*by, value], "left")


def mann_whitney(df: DataFrame, side: str, a: str, b: str, value: str) -> DataFrame:
    """U of side a, z and two-sided p by the normal approximation with tie and continuity corrections."""
    rows = df.where(F.col(side).isin(a, b) & F.col(value).isNotNull())
    r = average_ranks(rows, [], value)
    s = r.agg(F.sum(F.when(F.col(side) == a, F.col("rank"))).alias("ra"), F.count(F.when(F.col(side) == a, 1)).cast("double").alias("na"), F.count(F.when(F.col(side) == b, 1)).cast("double").alias("nb"), F.sum(F.col("__tie") * F.col("__tie") - 1).cast("double").alias("ties"))
    n = F.col("na") + F.col("nb")
    s = s.withColumn("u", F.col("ra") - F.col("na") * (F.col("na") + 1) / 2)
    sd = F.sqrt(F.col("na") * F.col("nb") / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    away = F.abs(F.col("u") - F.col("na") * F.col("nb") / 2)
    return s.withColumn("z", F.try_divide(F.greatest(away - 0.5, F.lit(0.0)), sd)).withColumn("p", normal_p("z")).select("na", "nb", "u", "z", "p")


def correlations(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Pearson and Spearman correlation of pairs without nulls."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    r = average_ranks(average_ranks(rows, by, a, "ra").drop("__tie"), by, b, "rb")
    return (r.groupBy(*by) if by else r.groupBy()).agg(F.count("*").alias("n"), F.corr(a, b).alias("pearson"), F.corr("ra", "rb").alias("spearman"))


def line_fit(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    return (df.groupBy(*by) if by else df.groupBy()).agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"), F.regr_r2(F.col(y), F.col(x)).alias("r2"))


def least_squares(df: DataFrame, x: list[str], y: str, cluster: str | None = None, fixed: str | None = None) -> DataFrame:
    """Linear regression: term, coef, se, t, p (and n). With `fixed`, values are taken from their group's means (no intercept); with `cluster`, errors
    are robust to correlation inside clusters. Rows with nulls are left out. Only moments of the columns reach the driver."""
    rows = df.dropna(subset=[*x, y, *([cluster] if cluster else []), *([fixed] if fixed else [])])
    if fixed:
        w = Window.partitionBy(fixed)
        rows = rows.withColumns({c: F.col(c) - F.avg(c).over(w) for c in [*x, y]})
    terms = [*x] if fixed else ["intercept", *x]
    cols = [F.col(c).cast("double") for c in x] if fixed else [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
    k = len(terms)
    aggs = [F.sum(cols[i] * cols[j]).alias(f"xx_{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(cols[i] * F.col(y)).alias(f"xy_{i}") for i in range(k)]
    groups = F.countDistinct(fixed).alias("groups") if fixed else F.lit(0).alias("groups")
    m = rows.agg(F.count("*").alias("n"), F.sum(F.col(y) * F.col(y)).alias("yy"), groups, *aggs).first()
    xx = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            xx[i, j] = xx[j, i] = m[f"xx_{i}_{j}"] or 0.0
    inv = np.linalg.pinv(xx)
    coef = inv @ np.array([m[f"xy_{i}"] or 0.0 for i in range(k)])
    dof = m["n"] - k - m["groups"]
    if cluster:
        fit = sum((cols[i] * float(coef[i]) for i in range(k)), F.lit(0.0))
        scores = rows.withColumn("__r", F.col(y) - fit).groupBy(cluster).agg(*[F.sum(cols[i] * F.col("__r")).alias(f"s_{i}") for i in range(k)])
        s = scores.agg(F.count("*").alias("g"), *[F.sum(F.col(f"s_{i}") * F.col(f"s_{j}")).alias(f"m_{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        meat = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                meat[i, j] = meat[j, i] = s[f"m_{i}_{j}"] or 0.0
        g = s["g"]
        cov = inv @ meat @ inv * (g / max(g - 1, 1)) * ((m["n"] - 1) / max(m["n"] - k, 1))
        dof = g - 1
    else:
        rss = (m["yy"] or 0.0) - float(coef @ np.array([m[f"xy_{i}"] or 0.0 for i in range(k)]))
        cov = inv * max(rss, 0.0) / max(dof, 1)
    se = np.sqrt(np.maximum(np.diag(cov), 0))
    out = [(t, float(c), float(s), float(c / s) if s else None, float(t_two_sided(float(c / s), dof)) if s and dof > 0 else None, int(m["n"])) for t, c, s in zip(terms, coef, se)]
    return df.sparkSession.createDataFrame(out, "term string, coef double, se double, t double, p double, n bigint")


def resampled_means(curves: DataFrame, by: str, n_sims: int, seed: int = 0, part_rows: int = 2000, sims_at_once: int = 250) -> DataFrame:
    """Mean curves of resampled stories: by, sim (from 0), curve (an array over the points). curves: by, story, point, value with the same points everywhere.

    A group's stories are cut into parts of about `part_rows`. How many of a resample's draws fall into each part is drawn once for the resample and group, from a seed all parts share, and
    each part then draws its own, so the parts together are an ordinary resample with replacement. A part holds its matrix (stories x points) and sends
    one sum for each resample; the sums of the parts are added up."""
    matrix = curves.groupBy(by, "story").agg(F.transform(F.sort_array(F.collect_list(F.struct("point", "value"))), lambda x: x.value).alias("curve"))
    parts = matrix.groupBy(by).agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    placed = materialize(matrix.join(parts, by).withColumn("part", F.pmod(F.xxhash64("story"), F.col("parts")).cast("int")).drop("parts"), "curves")
    # For each group the number of stories in each part, in order: stories / part_rows numbers.
    sizes = placed.groupBy(by, "part").agg(F.count("*").alias("n")).groupBy(by).agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("sizes"))
    kind = dict(curves.dtypes)[by]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("story")
        x = np.array(pdf["curve"].tolist(), float)
        order, counts = zip(*[(p["part"], p["n"]) for p in pdf["sizes"].iloc[0]])
        mine, total = order.index(int(key[1])), sum(counts)
        shares = np.array(counts) / total
        out = []
        for start in range(0, n_sims, sims_at_once):
            sims = range(start, min(start + sims_at_once, n_sims))
            weights = np.empty((len(sims), len(x)))
            for i, s in enumerate(sims):
                drawn = np.random.default_rng([seed, s]).multinomial(total, shares)[mine]
                weights[i] = np.bincount(np.random.default_rng([seed, s, mine + 1]).integers(0, len(x), drawn), minlength=len(x))
            out.append(pd.DataFrame({by: key[0], "sim": list(sims), "sums": list(weights @ x / total)}))
        return pd.concat(out)

    sums = placed.join(sizes, by).groupBy(by, "part").applyInPandas(run, f"{by} {kind}, sim int, sums array<double>")
    added = F.aggregate(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(1))), F.get("all", F.lit(0)), lambda a, c: F.zip_with(a, c, lambda p, q: p + q))
    return sums.groupBy(by, "sim").agg(F.collect_list("sums").alias("all")).select(by, "sim", added.alias("curve"))


def bootstrap_p(sims: DataFrame, by: str, a, b) -> DataFrame:
    """Per point, two-sided p of the difference between two groups' resampled curves: 2 min(p, 1 - p)."""
    x = sims.where(F.col(by) == a).select("sim", F.col("curve").alias("ca"))
    y = sims.where(F.col(by) == b).select("sim", F.col("curve").alias("cb"))
    above = x.join(y, "sim").select(F.posexplode(F.zip_with("ca", "cb", lambda p, q: (p > q).cast("int"))).alias("point", "above"))
    share = above.groupBy("point").agg(F.avg("above").alias("q"))
    return share.select("point", (2 * F.least(F.col("q"), 1 - F.col("q"))).alias("p"))


def equal_width(df: DataFrame, value: str, bins: int, out: str = "bin") -> DataFrame:
    """Bins of equal width from the least to the greatest value, closed on the right; the least value falls into bin 0."""
    edges = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    w = df.select("*", edges.select("lo").scalar().alias("__lo"), edges.select("hi").scalar().alias("__hi"))
    at = F.ceil(F.try_divide((F.col(value) - F.col("__lo")) * bins, F.col("__hi") - F.col("__lo"))) - 1
    return w.withColumn(out, F.when(F.col(value).isNotNull(), F.greatest(F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)), F.lit(0)).cast("int"))).drop("__lo", "__hi")


def equal_frequency(df: DataFrame, value: str, bins: int, out: str = "bin") -> DataFrame:
    """Bins between exact quantiles, closed on the right; equal values always share one."""
    inner = [i / bins for i in range(1, bins)]
    q = exact_quantiles(df, [], value, inner).scalar()
    return df.withColumn("__q", q).withColumn(out, F.when(F.col(value).isNotNull(), F.size(F.filter("__q", lambda e: e < F.col(value))))).drop("__q")


def crosstab(df: DataFrame, a: str, b: str, normalize: bool = False) -> DataFrame:
    """Counts (or shares of a's rows) of value pairs, in long form."""
    out = df.groupBy(a, b).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(a))) if normalize else out


def rescaled(df: DataFrame, value: str, out: str) -> DataFrame:
    """To 0..1; null if all values are equal."""
    e = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return df.select("*", e.select("lo").scalar().alias("__lo"), e.select("hi").scalar().alias("__hi")).withColumn(out, F.try_divide(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo"))).drop("__lo", "__hi")


def standardized(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Distance from the group's mean in its standard deviations; null where these are 0 or unknown."""
    df = with_group(df, by, __mean=F.avg(value), __sd=F.stddev_samp(value))
    return df.withColumn(out, F.try_divide(F.col(value) - F.col("__mean"), F.col("__sd"))).drop("__mean", "__sd")


def classical_scaling(similarity: np.ndarray, rounds: int = 300, starts: int = 8, seed: int = 0) -> np.ndarray:
    """Two-dimensional metric scaling (stress majorisation) of the distances between rows of a similarity matrix; for matrices that fit the driver."""
    n = len(similarity)
    d = np.sqrt(np.maximum(((similarity[:, None, :] - similarity[None, :, :]) ** 2).sum(-1), 0))
    best, least = np.zeros((n, 2)), np.inf
    for s in range(starts):
        x = np.random.default_rng([seed, s]).uniform(-1, 1, (n, 2))
        last = np.inf
        for _ in range(rounds):
            e = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
            stress = ((e - d) ** 2).sum() / 2
            if last - stress < 1e-9 * max(stress, 1e-12):
                break
            last = stress
            ratio = np.divide(d, e, out=np.zeros_like(d), where=e > 1e-12)
            b = -ratio
            b[np.diag_indices(n)] += ratio.sum(1)
            x = b @ x / n
        if last < least:
            best, least = x, last
    return best


