"""Robust statistics and calibration of thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.config import DEFAULTS, Mining

PROBES = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.995, 0.999)


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, upper_median): the upper of the two middle elements, by ranks and without gathering a group in an array."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy(value)
    ranked = counts.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    return ranked.filter(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(*keys).agg(F.min(value).alias("upper_median"))


def mid_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.median(value).alias("mid_median"))


def linear_percentile(df: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    return df.groupBy(*keys).agg(F.percentile(value, F.lit(p)).alias("percentile"))


def histogram(df: DataFrame, keys: list[str], metrics: list[str], weight: Column | None = None) -> DataFrame:
    """(keys, metric, value, n, weight): one row a distinct value; partial aggregation does the merging."""
    w = (F.lit(1.0) if weight is None else weight).alias("__w")
    long = df.select(*keys, w, *[F.col(m).cast("long").alias(m) for m in metrics]).unpivot([*keys, "__w"], metrics, "metric", "value")
    return long.filter("value is not null").groupBy(*keys, "metric", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("__w").alias("weight"))


def quantiles(hist: DataFrame, keys: list[str], probes: tuple[float, ...] = PROBES, by: str = "n") -> DataFrame:
    """(keys, p, v): the smallest value whose cumulative mass reaches p of all, for each probe. hist: keys, value and the mass in `by`."""
    w = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    mass = hist.withColumn("upto", F.sum(by).over(w)).withColumn("all", F.sum(by).over(Window.partitionBy(*keys)))
    each = mass.withColumn("p", F.explode(F.array(*[F.lit(p) for p in probes])))
    return each.filter(F.col("upto") >= F.col("p") * F.col("all")).groupBy(*keys, "p").agg(F.min("value").alias("v"))


def interpolate(probes: DataFrame, keys: list[str], at: float) -> DataFrame:
    """(keys, value): linear between the stored probes around `at`, constant beyond the first and last. probes: keys, p, v."""
    below = F.max_by(F.struct("p", "v"), F.when(F.col("p") <= at, F.col("p")))
    above = F.min_by(F.struct("p", "v"), F.when(F.col("p") >= at, F.col("p")))
    both = probes.groupBy(*keys).agg(F.when(F.count_if(F.col("p") <= at) > 0, below).alias("lo"), F.when(F.count_if(F.col("p") >= at) > 0, above).alias("hi"))
    lo, hi = F.coalesce("lo", "hi"), F.coalesce("hi", "lo")
    share = F.when(hi["p"] == lo["p"], F.lit(0.0)).otherwise((F.lit(at) - lo["p"]) / (hi["p"] - lo["p"]))
    return both.select(*keys, (lo["v"] + share * (hi["v"] - lo["v"])).alias("value"))


def firing_rate(hist: DataFrame, keys: list[str], threshold: Column, by: str = "n") -> DataFrame:
    """(keys, cdf, firing_rate): mass at or below the threshold, and the rest."""
    out = hist.groupBy(*keys).agg((F.coalesce(F.sum(F.when(F.col("value") <= threshold, F.col(by))), F.lit(0)) / F.sum(by)).alias("cdf"))
    return out.withColumn("firing_rate", 1 - F.col("cdf"))


def estimate(corpus: DataFrame, editorial: DataFrame) -> DataFrame:
    """(metric, warning, alert): the corpus quantiles, but never below the editorial values; an alert is above its warning.

    corpus: metric, p75, p95 (may be null); editorial: metric, warning, alert.
    """
    e = editorial.withColumnsRenamed({"warning": "ew", "alert": "ea"})
    both = e.join(corpus, "metric", "left")
    warning = F.greatest(F.col("ew"), F.coalesce(F.ceil("p75"), F.col("ew"))).cast("long")
    alert = F.greatest(F.col("ea"), F.coalesce(F.ceil("p95"), F.col("ea"))).cast("long")
    return both.select("metric", warning.alias("warning"), F.greatest(alert, warning + 1).alias("alert"))


def intensity(value: Column, least: float, most: Column | float) -> Column:
    """0 to 10 between the threshold and the extreme; null below the threshold."""
    span = (most if isinstance(most, Column) else F.lit(most)) - F.lit(least)
    scaled = F.when(span <= 0, F.when(value > least, F.lit(10.0)).otherwise(F.lit(0.0))).otherwise((value - least) / span * 10)
    return F.when(value >= least, F.greatest(F.lit(0.0), F.least(F.lit(10.0), scaled)))


def rank_by_intensity(df: DataFrame, dimensions: dict[str, tuple[float, float]], tie: list[str]) -> DataFrame:
    """Rows by the mean intensity of the dimensions that they satisfy, most intense first. dimensions: column -> (least, extreme)."""
    cols = [intensity(F.col(c), *bounds) for c, bounds in dimensions.items()]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    held = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    return df.withColumn("intensity", F.when(held > 0, total / held)).filter("intensity is not null").orderBy(F.desc("intensity"), *tie)


def robust_z(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """df with z_<feature> = 0.6745 |x - median| / MAD within each key; a MAD of zero gives zero. Two aggregations, whose results have a row a key."""
    on = keys or ["__all"]
    if not keys:
        df = df.withColumn("__all", F.lit(1))
    med = df.groupBy(*on).agg(*[F.median(c).alias(f"m_{c}") for c in features])
    df = df.join(med, on)
    mad = df.groupBy(*on).agg(*[F.median(F.abs(F.col(c) - F.col(f"m_{c}"))).alias(f"d_{c}") for c in features])
    df = df.join(mad, on)
    out = df.withColumns({f"z_{c}": F.when(F.col(f"d_{c}") > 0, 0.6745 * F.abs(F.col(c) - F.col(f"m_{c}")) / F.col(f"d_{c}")).otherwise(0.0) for c in features})
    return out.drop(*[f"{x}_{c}" for c in features for x in "md"], "__all")


def kl_to_median(histograms: DataFrame) -> DataFrame:
    """(id, kl_to_median): divergence in nats of each row's kinds from the median count of each kind over all rows, with one added to each. histograms: id, kind, n."""
    ids = histograms.select("id").distinct()
    total = ids.count()
    # a kind that fewer than half of the rows have has a median of zero; zero counts are added by number, not as rows
    w = Window.partitionBy("kind").orderBy("n")
    per = histograms.groupBy("kind", "n").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(w)).withColumn("have", F.sum("c").over(Window.partitionBy("kind")))
    zero = F.lit(total) - F.col("have")
    median = per.withColumn("rank", F.col("upto") + zero).filter(F.col("rank") > F.floor(F.lit(total) / 2)).groupBy("kind").agg(F.min("n").alias("least"), F.first(zero).alias("zero"))
    median = median.withColumn("m", F.when(F.col("zero") > F.floor(F.lit(total) / 2), 0).otherwise(F.col("least"))).select("kind", "m")
    kinds = histograms.select("kind").distinct().join(median, "kind", "left").na.fill(0, ["m"])
    sums = kinds.agg(F.count(F.lit(1)).alias("k"), F.sum("m").alias("ms"))
    own = histograms.groupBy("id").agg(F.sum("n").alias("total"))
    base = F.broadcast(sums)
    seen = histograms.join(kinds, "kind").join(own, "id").join(base)
    p, q = (F.col("n") + 1) / (F.col("total") + F.col("k")), (F.col("m") + 1) / (F.col("ms") + F.col("k"))
    p0 = F.lit(1.0) / (F.col("total") + F.col("k"))
    # kinds that a row lacks all have the same p; their part is the sum over all kinds less that over its own
    log_q = kinds.join(base).agg(F.sum(F.log((F.col("m") + 1) / (F.col("ms") + F.col("k")))).alias("all_log_q"))
    part = seen.groupBy("id").agg(F.sum(p * F.log(p / q)).alias("has"), F.sum(F.log(q)).alias("own_log_q"), F.count(F.lit(1)).alias("kinds"), F.first(p0).alias("p0"), F.first("k").alias("k")).join(F.broadcast(log_q))
    lacks = F.col("p0") * ((F.col("k") - F.col("kinds")) * F.log("p0") - (F.col("all_log_q") - F.col("own_log_q")))
    return part.select("id", (F.col("has") + lacks).alias("kl_to_median"))


def vendored(features: DataFrame, names: list[str], keys: list[str], t: Mining = DEFAULTS.mining) -> DataFrame:
    """Rows of enough bytes that are outliers in several features. features: keys, bytes and the named columns."""
    z = robust_z(features.filter(F.col("bytes") >= t.min_bytes), keys, names)
    failed = sum(((F.col(f"z_{c}") >= t.zscore).cast("int") for c in names[1:]), (F.col(f"z_{names[0]}") >= t.zscore).cast("int"))
    return z.withColumn("features_failed", failed).filter(F.col("features_failed") >= t.features_failed)


def locality_entropy(df: DataFrame, key: str, place: str) -> DataFrame:
    """(key, locality_entropy): bits of the spread of a key over places."""
    own = df.groupBy(key, place).agg(F.count(F.lit(1)).alias("n"))
    total = own.groupBy(key).agg(F.sum("n").alias("all"))
    p = F.col("n") / F.col("all")
    return own.join(total, key).groupBy(key).agg(F.abs(F.sum(-p * F.log2(p))).alias("locality_entropy"))
