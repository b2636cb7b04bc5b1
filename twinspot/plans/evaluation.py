"""Queries of the evaluation layer and of the service's job bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as X
from ..operators import corpus
from ..sources import table

NAN = float("nan")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a positive case if its quality is 1, and detected if it has a full count of characters and isn't toxic."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        "doc_id", "source", "lang", (F.col("quality") == 1).alias("positive"), ((F.col("toxic") == 0) & (F.col("n_chars") > 300)).alias("detected")
    )


def _metrics() -> list:
    hit, pos = F.count_if(F.col("positive") & F.col("detected")), F.count_if("positive")
    false, neg = F.count_if(~F.col("positive") & F.col("detected")), F.count_if(~F.col("positive"))
    return [
        F.count("*").alias("cases"),
        F.round(X.ratio(hit, pos, F.lit(0.0)), 6).alias("recall"),
        F.round(X.ratio(false, neg, F.lit(NAN)), 6).alias("fpr"),
        F.round(X.ratio(hit, hit + false, F.lit(NAN)), 6).alias("precision"),
    ]


def bench_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).groupBy("source").agg(*_metrics())


def recall_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outcomes(spark, sf_dir).where("positive").groupBy("lang").agg(F.count_if("detected").alias("hits"), F.count("*").alias("total"))


def correspondence_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_quantity") - 25).alias("dx"), (F.col("l_tax") * 100 - 3).alias("dy"))
    own = rows.groupBy("l_suppkey").agg(F.count("*").alias("matches"), F.count_if(F.greatest(F.abs("dx"), F.abs("dy")) < 3).alias("correct"))
    return own.select("l_suppkey", "matches", "correct", F.round(X.ratio(F.col("correct"), F.col("matches")), 6).alias("precision"))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.percentile("value", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    own = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), p.alias("p"), F.avg("value").alias("mean"))
    return own.select("event_type", "n", *[F.round(F.col("p")[k], 4).alias(f"p{q}") for k, q in enumerate((50, 90, 99))], F.round("mean", 4).alias("mean"))


def gutter_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of hours with few events: below 0.8 of the median hour, two in a row or more."""
    hours = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
    low = hours.crossJoin(hours.agg(F.median("n").alias("m"))).where("n < 0.8 * m")
    step = F.unix_timestamp("hour") / 3600 - F.row_number().over(Window.orderBy("hour"))
    runs = low.withColumn("run", step.cast("long")).groupBy("run").agg(F.min("hour").alias("first"), F.count("*").alias("hours"), F.sum("n").alias("events"))
    return runs.where("hours >= 2").select(F.unix_timestamp("first").alias("first"), "hours", "events")


def job_status_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    last = rows.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("_ts"), F.count("*").alias("updates"))
    return last.select("user_id", "status", F.unix_micros(F.col("_ts").cast("timestamp")).alias("at_us"), "updates")


def job_ttl_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose last event lies an hour or more before the newest of all and isn't a running one."""
    last = job_status_latest(spark, sf_dir)
    cutoff = last.agg((F.max("at_us") - 3_600_000_000).alias("cutoff"))
    return last.crossJoin(cutoff).where((F.col("at_us") <= F.col("cutoff")) & (F.col("status") != "click")).select("user_id", "status")


def admission_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event starts a job of its user that takes an hour: how many are open then, and whether the third is refused."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    load = corpus.open_jobs(rows, "user_id", "event_id", 3_600_000_000)
    return load.select("user_id", "event_id", "open", (F.col("open") > 2).alias("refused"))


def tumbling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in windows of ten minutes; the same aggregate runs as a stream in streaming."""
    from ..streaming import windowed

    return windowed(table(spark, sf_dir, "events")).select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        bench_metrics, recall_by_group, correspondence_precision, latency_percentiles, gutter_runs, job_status_latest, job_ttl_expiry, admission_load, tumbling_events,
    )
}

_LAST = "l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, epoch_us(max(ts)) AS at_us, count(*) AS updates FROM events GROUP BY user_id)"
ORACLE_SQL = {
    "bench_metrics": """WITH o AS (SELECT source, quality = 1 AS p, toxic = 0 AND n_chars > 300 AS d FROM labels JOIN documents USING (doc_id)),
c AS (SELECT source, count(*) AS cases, count(*) FILTER (p AND d) AS hit, count(*) FILTER (p) AS pos, count(*) FILTER (NOT p AND d) AS fp, count(*) FILTER (NOT p) AS neg FROM o GROUP BY source)
SELECT source, cases, round(CASE WHEN pos = 0 THEN 0 ELSE hit::DOUBLE / pos END, 6) AS recall, round(CASE WHEN neg = 0 THEN 'nan'::DOUBLE ELSE fp::DOUBLE / neg END, 6) AS fpr,
 round(CASE WHEN hit + fp = 0 THEN 'nan'::DOUBLE ELSE hit::DOUBLE / (hit + fp) END, 6) AS precision FROM c""",
    "recall_by_group": "SELECT lang, count(*) FILTER (toxic = 0 AND n_chars > 300) AS hits, count(*) AS total FROM labels JOIN documents USING (doc_id) WHERE quality = 1 GROUP BY lang",
    "correspondence_precision": """WITH c AS (SELECT l_suppkey, count(*) AS matches, count(*) FILTER (greatest(abs(l_quantity - 25), abs(l_tax * 100 - 3)) < 3) AS correct FROM lineitem GROUP BY l_suppkey)
SELECT *, round(correct::DOUBLE / matches, 6) AS precision FROM c""",
    "latency_percentiles": """SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.99), 4) AS p99,
 round(avg(value), 4) AS mean FROM events GROUP BY event_type""",
    "gutter_runs": """WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1), m AS (SELECT median(n) AS m FROM h), low AS (SELECT hour, n FROM h, m WHERE n < 0.8 * m),
r AS (SELECT *, epoch(hour)::BIGINT // 3600 - row_number() OVER (ORDER BY hour) AS run FROM low)
SELECT epoch(min(hour))::BIGINT AS first, count(*) AS hours, sum(n)::BIGINT AS events FROM r GROUP BY run HAVING count(*) >= 2""",
    "job_status_latest": f"WITH {_LAST} SELECT user_id, status, at_us, updates FROM l",
    "job_ttl_expiry": f"WITH {_LAST} SELECT user_id, status FROM l WHERE at_us <= (SELECT max(at_us) - 3600000000 FROM l) AND status <> 'click'",
    "admission_load": """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS due, 1 AS step FROM events UNION ALL SELECT user_id, event_id, epoch_us(ts) + 3600000000, -1 FROM events),
r AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY due, step, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS open FROM e) SELECT user_id, event_id, open, open > 2 AS refused FROM r WHERE step = 1""",
    "tumbling_events": "SELECT epoch(time_bucket(INTERVAL 10 MINUTE, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL",
}
