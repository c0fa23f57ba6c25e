"""Group-comparison statistics from grouped moments.

Each test is one grouped aggregate (count, mean, sample variance or counts)
followed by arithmetic on the few group rows, so the cost is one pass over
the data however large it is. SciPy is not available and PySpark has no
ANOVA test, so statistics and degrees of freedom are produced here and
p-values are left to the caller's tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moments(df: DataFrame, group: str, value: Column | str) -> DataFrame:
    v = F.col(value) if isinstance(value, str) else value
    return df.groupBy(group).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"))


def welch_t(df: DataFrame, group: str, value: Column | str, a, b) -> DataFrame:
    """Welch's two-sample t statistic of ``value`` between groups ``a`` and
    ``b`` and its Welch-Satterthwaite degrees of freedom (one row)."""
    m = moments(df.where(F.col(group).isin(a, b)), group, value)

    def pick(label, c):
        return F.max(F.when(F.col(group) == F.lit(label), F.col(c)))

    w = m.agg(pick(a, "n").alias("n1"), pick(a, "mean").alias("m1"), pick(a, "var").alias("v1"),
              pick(b, "n").alias("n2"), pick(b, "mean").alias("m2"), pick(b, "var").alias("v2"))
    s1 = F.col("v1") / F.col("n1")
    s2 = F.col("v2") / F.col("n2")
    t = (F.col("m1") - F.col("m2")) / F.sqrt(s1 + s2)
    dof = (s1 + s2) * (s1 + s2) / (s1 * s1 / (F.col("n1") - 1) + s2 * s2 / (F.col("n2") - 1))
    return w.select("n1", "n2", F.col("m1").alias("mean1"), F.col("m2").alias("mean2"),
                    t.alias("t_stat"), dof.alias("dof"))


def anova_f(df: DataFrame, group: str, value: Column | str) -> DataFrame:
    """One-way ANOVA F statistic of ``value`` across the groups of ``group``
    with its two degrees of freedom (one row)."""
    m = moments(df, group, value).where(F.col("n") > 0)
    # the grand mean of the groups' rows, as a scalar subquery (their shuffle is reused)
    m = m.withColumn("_g", m.agg(F.sum(F.col("n") * F.col("mean")) / F.sum("n")).scalar())
    grand = F.col("_g")
    parts = m.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("N"),
        F.sum(F.col("n") * (F.col("mean") - grand) * (F.col("mean") - grand)).alias("ssb"),
        F.sum((F.col("n") - 1) * F.coalesce(F.col("var"), F.lit(0.0))).alias("ssw"))
    return parts.select(
        ((F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("N") - F.col("k")))).alias("f_stat"),
        (F.col("k") - 1).cast("long").alias("df_between"), (F.col("N") - F.col("k")).cast("long").alias("df_within"))


def chi_square(counts: DataFrame, row: str, col: str, count: str = "n") -> DataFrame:
    """Pearson chi-square of independence over a ``row`` x ``col`` table of
    counts given in long form (absent cells count 0).

    The full grid is never built: an absent cell contributes its expected
    count E, so the statistic is the sum over present cells of (O-E)^2/E
    plus N minus the sum of E over present cells.
    """
    # The counts table has one row per observed cell; the margins are windows
    # over it by row and by column, the total is a scalar subquery.
    cells = counts.select(
        row, col, F.col(count).alias("_o"),
        F.sum(count).over(Window.partitionBy(row)).alias("_r"),
        F.sum(count).over(Window.partitionBy(col)).alias("_c"),
        counts.agg(F.sum(count)).scalar().alias("_t"))
    cells = cells.withColumn("_e", F.col("_r") * F.col("_c") / F.col("_t"))
    agg = cells.agg(F.sum((F.col("_o") - F.col("_e")) ** 2 / F.col("_e")).alias("_present"),
                    F.sum("_e").alias("_e_present"), F.max("_t").alias("_t"),
                    F.count_distinct(row).alias("_nr"), F.count_distinct(col).alias("_nc"),
                    F.count(F.lit(1)).alias("observed_cells"))
    return agg.select((F.col("_present") + (F.col("_t") - F.col("_e_present"))).alias("chi2"),
                      ((F.col("_nr") - 1) * (F.col("_nc") - 1)).cast("long").alias("dof"), "observed_cells")


def two_proportion_z(df: DataFrame, group: str, flag: str, a, b) -> DataFrame:
    """Two-proportion z statistic for the share of rows with ``flag`` true in
    group ``a`` against group ``b`` (pooled standard error), one row."""
    g = F.col(group)
    w = df.where(g.isin(a, b)).agg(
        F.count_if(g == F.lit(a)).alias("n1"), F.count_if((g == F.lit(a)) & F.col(flag)).alias("k1"),
        F.count_if(g == F.lit(b)).alias("n2"), F.count_if((g == F.lit(b)) & F.col(flag)).alias("k2"))
    p1 = F.col("k1").cast("double") / F.col("n1")
    p2 = F.col("k2").cast("double") / F.col("n2")
    pool = (F.col("k1") + F.col("k2")).cast("double") / (F.col("n1") + F.col("n2"))
    z = (p1 - p2) / F.sqrt(pool * (1 - pool) * (F.lit(1.0) / F.col("n1") + F.lit(1.0) / F.col("n2")))
    return w.select("n1", "k1", "n2", "k2", F.round(p1, 9).alias("share1"), F.round(p2, 9).alias("share2"),
                    F.round(z, 6).alias("z_stat"))
