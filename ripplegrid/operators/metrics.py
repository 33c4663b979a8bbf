"""Error metrics, calibration, quantiles, cross tables and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplegrid.functions.scalar import weighted_log_loss
from ripplegrid.operators import order_stats


def flow_errors(df: DataFrame, keys: list[str], truth: str, guess: str, threshold: float) -> DataFrame:
    """keys, n, mae, rmse, sign_accuracy: the share of right signs where |truth| > threshold, null if there is none."""
    e = F.col(guess) - F.col(truth)
    sign = F.when(F.abs(truth) > threshold, (F.signum(F.col(truth)) == F.signum(F.col(guess))).cast("int"))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(sign), 9).alias("sign_accuracy"))


def calibration(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: slope through the origin of guess on truth, p99 of the guesses where truth <= 0, share of positives above it, and the
    medians of the positives' guesses and truths; null where there is nothing to go by."""
    slope = df.agg(F.try_divide(F.sum(F.col(guess) * F.col(truth)), F.sum(F.col(truth) * F.col(truth))).alias("slope")).first().slope
    noise = order_stats.one_quantile(df.where(F.col(truth) <= 0), guess, 0.99)
    positive = df.where(F.col(truth) > 0)
    middle = {c: order_stats.one_quantile(positive, c, 0.5) for c in (guess, truth)}
    above = positive.agg(F.avg((F.col(guess) > F.lit(noise)).cast("int")).alias("above"))
    number = lambda x, digits: F.round(F.lit(x).cast("double"), digits)
    return above.select(number(slope, 6).alias("slope"), number(noise, 6).alias("noise_p99"), F.round("above", 9).alias("above"), number(middle[guess], 6).alias("median_guess"), number(middle[truth], 6).alias("median_truth"))


def quantiles(df: DataFrame, keys: list[str], column: str, at: tuple[float, ...] = (0.0, 0.01, 0.5, 0.99, 1.0)) -> DataFrame:
    """keys and q<percent>: exact quantiles with linear interpolation, and the share of negative values."""
    found = order_stats.quantiles(df, keys, column, at)
    wide = found.groupBy(*keys).agg(*[F.round(F.max(F.when(F.abs(F.col("q") - p) < 1e-12, F.col("x"))), 6).alias(f"q{round(p * 100)}") for p in at])
    share = df.groupBy(*keys).agg(F.round(F.avg((F.col(column) < 0).cast("int")), 9).alias("negative"))
    left, right = wide.alias("w"), share.alias("s")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"w.{k}").eqNullSafe(F.col(f"s.{k}"))
    return left.join(right, same).select("w.*", "negative")


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """row, a count for each of the values (named n_<value>), and total."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"n_{v}") for v in values], F.count("*").alias("total"))


def binned_share(df: DataFrame, column: str, bounds: list[float], hit: Column) -> DataFrame:
    """bin (number of the right-closed bin between bounds, from 1), n, share of rows with hit; other rows are left out."""
    label = F.lit(None).cast("int")
    for i in range(len(bounds) - 1, 0, -1):
        label = F.when((F.col(column) > bounds[i - 1]) & (F.col(column) <= bounds[i]), F.lit(i)).otherwise(label)
    return df.withColumn("bin", label).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg(hit.cast("int")), 9).alias("share"))


def busiest(scores: DataFrame) -> DataFrame:
    """One row: the hour with most active entities, the first on ties, and how many."""
    return scores.where("active").groupBy("hour").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hour").limit(1)


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.round(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)), 6).alias("mean"))


def best_step(history: DataFrame, run: list[str]) -> DataFrame:
    """run, best (the step with the largest metric, the earlier on ties), lowest_loss (the step with the smallest loss)."""
    return history.groupBy(*run).agg(F.max_by("step", F.struct("metric", -F.col("step"))).alias("best"), F.min_by("step", F.struct("loss", "step")).alias("lowest_loss"))


def upper_median(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row in the middle of each group, the upper of two."""
    w = Window.partitionBy(*keys)
    return df.withColumn("__r", F.row_number().over(w.orderBy(*order))).withColumn("__n", F.count("*").over(w)).where(F.col("__r") == F.floor(F.col("__n") / 2) + 1).drop("__r", "__n")


def class_weights(df: DataFrame, label: Column, usable: Column) -> DataFrame:
    """One row: positives, negatives, weight (negatives / positives) and the loss of always guessing even odds."""
    one = df.where(usable).agg(F.count_if(label).alias("positives"), F.count_if(~label).alias("negatives"))
    w = F.try_divide("negatives", "positives")
    return one.select("positives", "negatives", F.round(w, 9).alias("weight"), F.round(F.try_divide(F.lit(0.6931471805599453) * (F.col("negatives") + w * F.col("positives")), F.col("negatives") + F.col("positives")), 9).alias("even_loss"))


def log_loss(df: DataFrame, z: Column, y: Column, positive: float, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.round(F.avg(weighted_log_loss(z, y, F.lit(positive))), 6).alias("loss"))


def mean_of_means(df: DataFrame, episode: str, value: str) -> DataFrame:
    """One row: scale, the root of the mean over episodes of their mean squares (each episode counts the same), and the pooled root mean square."""
    x = F.col(value) * F.col(value)
    each = df.groupBy(episode).agg(F.avg(x).alias("m"), F.sum(x).alias("s"), F.count(value).alias("n"))
    return each.agg(F.round(F.greatest(F.sqrt(F.avg("m")), F.lit(1e-6)), 6).alias("scale"), F.round(F.sqrt(F.sum("s") / F.sum("n")), 6).alias("pooled"))


def per_event(df: DataFrame, event: str, value: str) -> DataFrame:
    """One row: n events, mean of the events' own means."""
    return df.groupBy(event).agg(F.avg(value).alias("m")).agg(F.count("*").alias("n"), F.round(F.avg("m"), 9).alias("mean"))


def errors(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """One row: mae, rmse, n."""
    gap = F.col(guess) - F.col(truth)
    return rows.agg(F.round(F.avg(F.abs(gap)), 6).alias("mae"), F.round(F.sqrt(F.avg(gap * gap)), 6).alias("rmse"), F.count("*").alias("n"))


def loss_references(df: DataFrame, label: Column, usable: Column, flow: str, scale: float) -> DataFrame:
    """One row: what losses are held against: weight (negatives / positives), even_loss (weighted log loss of even odds) and flow_loss (mean square of the
    flow over its scale, the loss of predicting none). Rows without both labels or with no flow at all are an error."""
    one = df.where(usable).agg(F.count_if(label).alias("positives"), F.count_if(~label).alias("negatives"), F.avg(F.col(flow) * F.col(flow)).alias("square"))
    sound = (F.col("positives") > 0) & (F.col("negatives") > 0) & (F.col("square") > 0)
    w = F.when(sound, F.col("negatives") / F.col("positives")).otherwise(F.raise_error(F.lit("labels of both kinds and a flow are needed")))
    even = F.log(F.lit(2.0)) * 2 * F.col("negatives") / (F.col("negatives") + F.col("positives"))  # negatives and weighted positives count the same
    return one.select(F.round(w, 9).alias("weight"), F.round(even, 9).alias("even_loss"), F.round(F.col("square") / (scale * scale), 9).alias("flow_loss"))


def best_worst(df: DataFrame, candidate: str, value: str, within: list[str] | None = None) -> DataFrame:
    """The candidate whose smallest value is the largest (the smaller candidate on ties), of each group of ``within`` or of all, and that value as ``worst``."""
    keys = within or []
    worst = df.groupBy(*keys, candidate).agg(F.min(value).alias("worst"))
    pick = worst.groupBy(*keys).agg(F.max("worst").alias("worst"))
    tied = worst.withColumnRenamed("worst", "w").join(pick, keys) if keys else worst.withColumnRenamed("worst", "w").crossJoin(F.broadcast(pick))  # one row
    return tied.where("w = worst").groupBy(*keys).agg(F.min(candidate).alias(candidate), F.first("worst").alias("worst"))
