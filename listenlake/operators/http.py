"""Request metrics: counters, latency histogram, rates, quantiles, errors.

Rows are first combined into cells one slide wide; a window is a sum of cells, so a long
window with a short slide does not copy every row once per window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenlake.functions.scalars import status_class
from listenlake.operators import ordered
from listenlake.operators.ordered import OrderedRows

# The client library's public default bounds, in seconds.
DEFAULT_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]


def counter(requests: DataFrame) -> DataFrame:
    """Requests by method, endpoint and status."""
    return requests.groupBy("method", "endpoint", "status").agg(F.count(F.lit(1)).alias("requests"))


def bucket_counts(bounds: list[float], duration: Column) -> list[Column]:
    """Cumulative bucket counts ``le_0`` … and the ``total`` (+Inf)."""
    return [F.count(F.when(duration <= b, 1)).alias(f"le_{i}") for i, b in enumerate(bounds)] + [
        F.count(duration).alias("total")
    ]


def histogram(requests: DataFrame, keys: list[str], bounds: list[float] = DEFAULT_BOUNDS) -> DataFrame:
    """Cumulative latency buckets, one row per key and bound; +Inf is the count of all."""
    counts = requests.groupBy(*keys).agg(*bucket_counts(bounds, F.col("duration_s")))
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"le_{i}").alias("n")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit(float("inf")).alias("le"), F.col("total").alias("n")))
    return counts.select(*keys, F.inline(F.array(*rows)))


def bucket_quantile(q: float, bounds: list[float]) -> Column:
    """Quantile interpolated inside the bucket that holds its rank.

    The first bucket starts at 0; a rank beyond the last finite bound gives that bound; no
    observations give null.
    """
    rank = F.col("total") * q
    result = F.when(F.col("total") == 0, F.lit(None).cast("double"))
    for i, bound in enumerate(bounds):
        low, below = (0.0, F.lit(0)) if i == 0 else (bounds[i - 1], F.col(f"le_{i - 1}"))
        inside = low + (bound - low) * (rank - below) / (F.col(f"le_{i}") - below)
        result = result.when(F.col(f"le_{i}") >= rank, inside)
    return result.otherwise(F.lit(float(bounds[-1])))


def cells(requests: DataFrame, keys: list[str], slide: str, measures: list[Column]) -> DataFrame:
    return requests.groupBy(F.window("ts", slide).alias("_w"), *keys).agg(*measures)


def windows(cell_rows: DataFrame, keys: list[str], length: str, slide: str, sums: list[str]) -> DataFrame:
    """Sums of cells over windows of ``length`` starting every ``slide``."""
    if length == slide:
        return cell_rows.select(F.col("_w.start").alias("window_start"), *keys, *sums)
    placed = cell_rows.select(F.col("_w.start").alias("_at"), *keys, *sums)
    return (
        placed.groupBy(F.window("_at", length, slide).alias("_w"), *keys)
        .agg(*[F.sum(s).alias(s) for s in sums])
        .select(F.col("_w.start").alias("window_start"), *keys, *sums)
    )


def request_rate(requests: DataFrame, length: str = "1 minute", slide: str = "1 minute", seconds: int = 60) -> DataFrame:
    """Requests per second by endpoint."""
    counted = cells(requests, ["endpoint"], slide, [F.count(F.lit(1)).alias("n")])
    rows = windows(counted, ["endpoint"], length, slide, ["n"])
    return rows.select("window_start", "endpoint", F.round(F.col("n") / seconds, 6).alias("per_second"))


def status_rates(requests: DataFrame, length: str = "1 minute", slide: str = "1 minute", seconds: int = 60) -> DataFrame:
    """Requests per second by endpoint and status class."""
    kind = status_class(F.col("status"))
    measures = [F.count(F.when(kind == c, 1)).alias(f"s{c}xx") for c in (2, 4, 5)]
    rows = windows(cells(requests, ["endpoint"], slide, measures), ["endpoint"], length, slide, ["s2xx", "s4xx", "s5xx"])
    return rows.select(
        "window_start", "endpoint",
        *[F.round(F.col(f"s{c}xx") / seconds, 6).alias(f"rate_{c}xx") for c in (2, 4, 5)],
    )


def error_pct(requests: DataFrame, length: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Share of 5xx responses in percent by endpoint; no row without traffic."""
    failed = status_class(F.col("status")) == 5
    measures = [F.count(F.when(failed, 1)).alias("failed"), F.count(F.lit(1)).alias("n")]
    rows = windows(cells(requests, ["endpoint"], slide, measures), ["endpoint"], length, slide, ["failed", "n"])
    return rows.select(
        "window_start", "endpoint", F.round(100 * F.col("failed") / F.nullif("n", F.lit(0)), 6).alias("error_pct")
    )


def bucket_p(
    requests: DataFrame, q: float = 0.95, length: str = "5 minutes", slide: str = "5 minutes",
    bounds: list[float] = DEFAULT_BOUNDS,
) -> DataFrame:
    """Latency quantile by endpoint from histogram buckets."""
    names = [f"le_{i}" for i in range(len(bounds))] + ["total"]
    rows = windows(
        cells(requests, ["endpoint"], slide, bucket_counts(bounds, F.col("duration_s"))),
        ["endpoint"], length, slide, names,
    )
    return rows.select("window_start", "endpoint", F.round(bucket_quantile(q, bounds), 6).alias("latency"))


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """Exact continuous quantile per group.

    Equal values are counted first; the groups' values are then scanned in order for the two whose ranks enclose the quantile. No group is held in memory.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    up_to = OrderedRows.of(counted, keys, [value]).add(_up_to=ordered.running_sum(F.col("_n"))).frame()
    # A group's last running sum is its total.
    totals = up_to.groupBy(*keys).agg(F.max("_up_to").alias("_total"))
    at = (F.col("_total") - 1) * q
    first = F.col("_up_to") - F.col("_n")

    def holds(rank: Column) -> Column:
        return (first <= rank) & (rank < F.col("_up_to"))

    low, high = F.floor(at), F.ceil(at)
    # Null-safe, so that a null key keeps its quantile.
    named = totals.select(*[F.col(k).alias(f"_t_{k}") for k in keys], "_total")
    same = [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys]
    return (
        up_to.join(named, same)
        .where(holds(low) | holds(high))
        .groupBy(*keys)
        .agg(
            F.max(F.when(holds(low), F.col(value))).alias("_low"),
            F.max(F.when(holds(high), F.col(value))).alias("_high"),
            F.max(at - low).alias("_part"),
        )
        .select(*keys, F.round(F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part"), 9).alias("quantile"))
    )


def exact_p(requests: DataFrame, q: float = 0.95, length: str = "5 minutes") -> DataFrame:
    """Exact latency quantile by endpoint and window."""
    placed = requests.select(F.window("ts", length)["start"].alias("window_start"), "endpoint", "duration_s")
    return exact_quantile(placed, ["window_start", "endpoint"], "duration_s", q)
