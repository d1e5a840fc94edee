"""Monitoring roll-ups over event tables, and upkeep of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def since(events: DataFrame, hours: float, as_of: Column | None = None) -> DataFrame:
    """Events of the last hours before as_of (the newest event). UTC throughout."""
    if as_of is None:
        newest = events.agg(F.max("ts").alias("newest"))  # one row
        return events.join(F.broadcast(newest)).where(F.col("ts") >= F.col("newest") - F.expr(f"INTERVAL {hours} HOURS")).drop("newest")
    return events.where(F.col("ts") >= as_of - F.expr(f"INTERVAL {hours} HOURS"))


def api_summary(metrics: DataFrame) -> DataFrame:
    """One row: requests, times, errors, users and error rate in percent; zeros if there are none."""
    errors = F.count(F.when(F.col("status_code") >= 400, 1))
    zero = lambda c: F.coalesce(F.round(c, 6), F.lit(0.0))
    return metrics.agg(
        F.count(F.lit(1)).alias("requests"),
        zero(F.avg("response_time_ms")).alias("avg_ms"),
        zero(F.max("response_time_ms")).alias("max_ms"),
        zero(F.min("response_time_ms")).alias("min_ms"),
        errors.alias("errors"),
        F.count_distinct("user_id").alias("users"),
        zero(F.try_divide(100.0 * errors, F.count(F.lit(1)))).alias("error_rate"),
    )


def top_endpoints(metrics: DataFrame, k: int = 10) -> DataFrame:
    return metrics.groupBy("endpoint").agg(F.count(F.lit(1)).alias("requests"), F.round(F.avg("response_time_ms"), 6).alias("avg_ms")).orderBy(F.desc("requests"), "endpoint").limit(k)


def cost_summary(costs: DataFrame) -> DataFrame:
    """Tokens and cost of each service, and of all (service null)."""
    return costs.rollup("service").agg(F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), F.round(F.sum(F.coalesce("cost", F.lit(0.0))), 4).alias("cost"))


def error_summary(errors: DataFrame) -> DataFrame:
    return errors.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_seen")).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0))))


def latest(rows: DataFrame, key: str, by: str, tie: str) -> DataFrame:
    """Upsert: of the rows of each key the newest."""
    order = Window.partitionBy(key).orderBy(F.desc(by), F.desc(tie))
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def newest(rows: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """latest for keys that may hold many rows: sums before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("__newest")).select(*keys, "__newest.*")


def dashboard(day: DataFrame, week: DataFrame, costs: DataFrame, errors: DataFrame) -> DataFrame:
    """Request metrics of a day and of a week, costs and errors as rows of part, name, amount and value."""
    parts = []
    for part, metrics in (("api 1 day", day), ("api 7 days", week)):
        named = [F.struct(F.lit(n).alias("name"), F.col(n).cast("long").alias("amount"), F.col(v).alias("value")) for n, v in (("requests", "avg_ms"), ("errors", "error_rate"), ("users", "max_ms"))]
        parts.append(api_summary(metrics).select(F.lit(part).alias("part"), F.explode(F.array(*named)).alias("x")).select("part", "x.*"))
    parts.append(cost_summary(costs).select(F.lit("cost 30 days").alias("part"), F.coalesce("service", F.lit("all")).alias("name"), F.col("tokens").cast("long").alias("amount"), F.col("cost").alias("value")))
    parts.append(error_summary(errors).select(F.lit("errors 1 day").alias("part"), F.col("error_type").alias("name"), F.col("n").alias("amount"), F.col("total").cast("double").alias("value")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def hit_rate(hits: Column, misses: Column) -> Column:
    """Percentage of a cache's hits with one decimal, N/A if it was never asked."""
    return F.coalesce(percentage(hits, hits + misses), F.lit("N/A"))


def percentage(part: Column, whole: Column) -> Column:
    """With one decimal (a half goes to the even digit); null of nothing."""
    return F.concat(F.call_function("format_number", F.try_divide(100.0 * part, whole), F.lit("0.0")), F.lit("%"))
