"""Request-metric queries."""

from pyspark.sql import functions as F

from listenlake.operators import http
from listenlake.plans.registry import query
from listenlake.sources import files
from listenlake.sources.domain import ctes

R = ctes("requests")


@query("http_counter", R + "SELECT method, endpoint, status, count(*) AS requests FROM requests GROUP BY 1, 2, 3")
def http_counter(d):
    return http.counter(d.requests())


BOUNDS = "(VALUES (0.005), (0.01), (0.025), (0.05), (0.075), (0.1), (0.25), (0.5), (0.75), (1.0), (2.5), (5.0), (7.5), (10.0), ('Infinity'::DOUBLE)) b(le)"


@query(
    "http_histogram",
    R + f"""
    SELECT method, endpoint, CAST(CASE WHEN isinf(CAST(le AS DOUBLE)) THEN 1e9 ELSE le END AS DOUBLE) AS le,
           count(*) FILTER (duration_s <= CAST(le AS DOUBLE)) AS n
    FROM requests, {BOUNDS} GROUP BY ALL""",
)
def http_histogram(d):
    rows = http.histogram(d.requests(), ["method", "endpoint"])
    # Infinity is shown as 1e9 so that the result compares as an ordinary number.
    return rows.withColumn("le", F.when(F.col("le") == float("inf"), 1e9).otherwise(F.col("le")))


SLIDING = R + """
    , placed AS (SELECT r.*, time_bucket(INTERVAL 1 minute, ts) - CAST(i AS INTEGER) * INTERVAL 1 minute AS window_start
                 FROM requests r, range({steps}) s(i))"""


@query(
    "http_rate",
    R + """
    SELECT date_trunc('minute', ts) AS window_start, endpoint, round(count(*) / 60.0, 6) AS per_second
    FROM requests GROUP BY 1, 2""",
)
def http_rate(d):
    return http.request_rate(d.requests())


@query(
    "http_rate_sliding",
    SLIDING.format(steps=3) + """
    SELECT window_start, endpoint, round(count(*) / 180.0, 6) AS per_second FROM placed GROUP BY 1, 2""",
)
def http_rate_sliding(d):
    return http.request_rate(d.requests(), "3 minutes", "1 minute", 180)


@query(
    "http_status_split",
    R + """
    SELECT date_trunc('minute', ts) AS window_start, endpoint,
           round(count(*) FILTER (status // 100 = 2) / 60.0, 6) AS rate_2xx,
           round(count(*) FILTER (status // 100 = 4) / 60.0, 6) AS rate_4xx,
           round(count(*) FILTER (status // 100 = 5) / 60.0, 6) AS rate_5xx
    FROM requests GROUP BY 1, 2""",
)
def http_status_split(d):
    return http.status_rates(d.requests())


@query(
    "http_error_pct",
    SLIDING.format(steps=5) + """
    SELECT window_start, endpoint, round(100.0 * count(*) FILTER (status // 100 = 5) / count(*), 6) AS error_pct
    FROM placed GROUP BY 1, 2""",
)
def http_error_pct(d):
    return http.error_pct(d.requests())


P95_SQL = R + f"""
    , placed AS (SELECT time_bucket(INTERVAL 5 minute, ts) AS window_start, endpoint, duration_s FROM requests)
    , buckets AS (SELECT window_start, endpoint, CAST(le AS DOUBLE) AS le,
                         count(*) FILTER (duration_s <= CAST(le AS DOUBLE)) AS n, count(*) * 0.95 AS rank
                  FROM placed, {BOUNDS} GROUP BY ALL)
    , edges AS (SELECT *, lag(n, 1, 0) OVER w AS below, lag(le, 1, 0.0) OVER w AS low
                FROM buckets WINDOW w AS (PARTITION BY window_start, endpoint ORDER BY le))
    , hit AS (SELECT *, row_number() OVER (PARTITION BY window_start, endpoint ORDER BY le) AS rn FROM edges WHERE n >= rank)
    SELECT window_start, endpoint,
           round(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (rank - below) / (n - below) END, 6) AS latency
    FROM hit WHERE rn = 1"""


@query("http_p95_bucket", P95_SQL)
def http_p95_bucket(d):
    return http.bucket_p(d.requests())


@query(
    "http_p95_exact",
    R + """
    SELECT time_bucket(INTERVAL 5 minute, ts) AS window_start, endpoint,
           round(quantile_cont(duration_s, 0.95), 9) AS quantile FROM requests GROUP BY 1, 2""",
)
def http_p95_exact(d):
    return http.exact_p(d.requests())


@query(
    "latency_p95_by_endpoint",
    R + "SELECT endpoint, round(quantile_cont(duration_s, 0.95), 9) AS quantile FROM requests GROUP BY 1",
)
def latency_p95_by_endpoint(d):
    return http.exact_quantile(d.requests().select("endpoint", "duration_s"), ["endpoint"], "duration_s", 0.95)


# -- from log files ------------------------------------------------------------------------

# The lines of the log: what was written of each request, and why it cannot be counted.
LOG = R + """
    , log AS (SELECT ts, method, CASE WHEN status = 404 THEN '/raw/' ELSE '/api/' END || endpoint AS endpoint, status, duration_s,
                     CASE WHEN request_id % 97 = 0 THEN 'unreadable' WHEN request_id % 89 = 0 THEN 'no status' END AS problem
              FROM requests)"""


@query(
    "request_log_counter",
    LOG + "SELECT method, endpoint, status, count(*) AS requests FROM log WHERE problem IS NULL GROUP BY 1, 2, 3",
)
def request_log_counter(d):
    return http.counter(files.read_requests(d.spark, d.landed_requests()))


@query(
    "request_log_status",
    LOG + """
    SELECT date_trunc('minute', ts) AS window_start, endpoint,
           round(count(*) FILTER (status // 100 = 2) / 60.0, 6) AS rate_2xx,
           round(count(*) FILTER (status // 100 = 4) / 60.0, 6) AS rate_4xx,
           round(count(*) FILTER (status // 100 = 5) / 60.0, 6) AS rate_5xx
    FROM log WHERE problem IS NULL GROUP BY 1, 2""",
)
def request_log_status(d):
    return http.status_rates(files.read_requests(d.spark, d.landed_requests()))


@query(
    "request_log_latency",
    LOG + """
    SELECT endpoint, round(quantile_cont(duration_s, 0.95), 9) AS quantile FROM log WHERE problem IS NULL GROUP BY 1""",
)
def request_log_latency(d):
    rows = files.read_requests(d.spark, d.landed_requests())
    return http.exact_quantile(rows.select("endpoint", "duration_s"), ["endpoint"], "duration_s", 0.95)


@query("request_log_problems", LOG + "SELECT problem, count(*) AS n FROM log WHERE problem IS NOT NULL GROUP BY 1")
def request_log_problems(d):
    rows = files.read_request_log(d.spark, d.landed_requests())
    return rows.where("problem IS NOT NULL").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))
