"""Aggregates over evaluation samples, token usage, metric points and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import tag_key
from ..workdir import materialise
from .ranges import beside, blocks_before, ranged, within

# The two price lists, per thousand input and output tokens.
MONITOR_PRICES = (0.005, 0.015)
EVALUATION_PRICES = (0.001, 0.002)
LATENCY_BUCKETS = (100, 500, 1000, 3000)


def _grouped(df: DataFrame, by: Sequence[str], *aggs: Column) -> DataFrame:
    return (df.groupBy(*by) if by else df).agg(*aggs)


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _count(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def _floor_mean(total: Column, n: Column) -> Column:
    """The integer quotient of non-negative numbers, 0 for none."""
    return F.coalesce(F.floor(F.try_divide(total, n)), F.lit(0)).cast("long")


def accuracy_aggs() -> list[Column]:
    ok, exp, pred = F.col("success"), F.col("expected_label"), F.col("predicted_label")
    tp, fp, fn = _count(ok & (exp == pred)), _count(~ok & pred.isNotNull()), _count(~ok & exp.isNotNull())
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    n, good = F.count("*"), _count(ok)
    return [
        n.alias("samples"), good.alias("successes"), _count(~ok).alias("failures"), ratio(good, n).alias("accuracy"),
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), precision.alias("precision"), recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"),
    ]


def accuracy_metrics(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and precision, recall, F1; a false positive or negative needs the failure flag, as its source has it."""
    return _grouped(samples, by, *accuracy_aggs())


def nearest_rank(value: str, p: float) -> Column:
    """The value at rank ceil(p * n): no interpolation."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def counted_quantiles(counts: DataFrame, by: Sequence[str], wanted: dict[str, float]) -> DataFrame:
    """by..., and for each name of ``wanted`` the value at rank ceil(p * n), at least 1, from (by..., value, n), a row for each value of a group.

    Values are dealt out by ranges and counted up within them; a table of blocks
    gives what stands before a range, so no task holds all values of a
    group. Null values don't count; a group of nulls only has null quantiles.
    """
    rows = ranged(counts.where("value IS NOT NULL"), by, [F.col("value")])
    run = F.sum("n").over(within(by).orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    order = blocks_before(by)
    blocks = rows.groupBy("_range", *by).agg(F.sum("n").alias("_n"))
    blocks = blocks.select("_range", *by, (F.sum("_n").over(order) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(*by)).alias("_all"))
    placed = beside(rows.withColumn("_run", run), blocks, ["_range", *by]).withColumn("_to", F.col("_before") + F.col("_run"))
    rank = lambda p: F.greatest(F.ceil(F.lit(p) * F.col("_all")), F.lit(1))
    own = [F.max(F.when((F.col("_to") >= rank(p)) & (F.col("_to") - F.col("n") < rank(p)), F.col("value"))).alias(name) for name, p in wanted.items()]
    found = placed.groupBy(*by).agg(*own) if by else placed.agg(*own)
    nulls = counts.groupBy(*by).agg(F.max("value").alias("_v")).where("_v IS NULL").drop("_v") if by else None
    return found if nulls is None else found.unionByName(nulls, allowMissingColumns=True)


def latency_metrics(samples: DataFrame, by: Sequence[str] = (), value: str = "latency", exact: bool = True) -> DataFrame:
    """min, max, floored mean, p50, p95, p99, p999, n of non-null values.

    Exact percentiles come from the count of each value, see
    counted_quantiles(); ``exact=False`` takes sketches of bounded size instead.
    """
    v, wanted = F.col(value), {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}
    aggs = [F.min(v).alias("min"), F.max(v).alias("max"), _floor_mean(F.sum(v), F.count(v)).alias("avg")]
    if not exact:
        return _grouped(samples, by, *aggs, *(F.percentile_approx(v, p, 10_000).alias(name) for name, p in wanted.items()), F.count(v).alias("n"))
    counts = materialise(samples.groupBy(*by, v.alias("value")).agg(F.count("*").alias("n")), "values")
    v, n = F.col("value"), F.when(F.col("value").isNotNull(), F.col("n"))
    sums = _grouped(counts, by, F.min(v).alias("min"), F.max(v).alias("max"), _floor_mean(F.sum(v * n), F.sum(n)).alias("avg"), F.coalesce(F.sum(n), F.lit(0)).alias("n"))
    found = counted_quantiles(counts, by, wanted)
    rows = beside(sums, found, by) if by else sums.join(F.broadcast(found))  # one row beside one row
    return rows.select(*by, "min", "max", "avg", *wanted, "n")


def latency_eval_aggs(value: str = "latency") -> list[Column]:
    held = f"CASE WHEN {value} > 0 THEN {value} END"
    v = F.expr(held)
    return [_floor_mean(F.sum(v), F.count(v)).alias("avg_latency"), F.coalesce(nearest_rank(held, 0.95), F.lit(0)).cast("long").alias("p95_latency"), F.coalesce(nearest_rank(held, 0.99), F.lit(0)).cast("long").alias("p99_latency")]


def latency_eval(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _grouped(samples, by, *latency_eval_aggs())


def latency_histogram(samples: DataFrame, by: Sequence[str] = (), value: str = "latency") -> DataFrame:
    v, ends = F.col(value), LATENCY_BUCKETS
    aggs = [_count(v < ends[0]).alias(f"lt_{ends[0]}")]
    aggs += [_count((v >= a) & (v < b)).alias(f"lt_{b}") for a, b in zip(ends, ends[1:])]
    return _grouped(samples, by, *aggs, _count(v >= ends[-1]).alias(f"ge_{ends[-1]}"))


def cost(tokens_in: Column, tokens_out: Column, prices: tuple[float, float] = MONITOR_PRICES) -> Column:
    return tokens_in * prices[0] / 1000.0 + tokens_out * prices[1] / 1000.0


def _positive(c: str) -> Column:
    return F.when(F.col(c) > 0, F.col(c))


def cost_metrics(usage: DataFrame, by: Sequence[str] = (), prices: tuple[float, float] = MONITOR_PRICES) -> DataFrame:
    """Sums of positive tokens, floored means (own ones over positive, that of the total over all), cost, cost per request."""
    i, o = _positive("input_tokens"), _positive("output_tokens")
    si, so = F.coalesce(F.sum(i), F.lit(0)), F.coalesce(F.sum(o), F.lit(0))
    n, all_cost = F.count("*"), cost(si, so, prices)
    return _grouped(
        usage, by, si.alias("input_tokens"), so.alias("output_tokens"), (si + so).alias("total_tokens"), _floor_mean(si, F.count(i)).alias("avg_input"), _floor_mean(so, F.count(o)).alias("avg_output"),
        _floor_mean(si + so, n).alias("avg_total"), n.alias("requests"), all_cost.alias("cost"), ratio(all_cost, n).alias("cost_per_request"),
    )


def cost_by_biz_stage(usage: DataFrame) -> DataFrame:
    return cost_metrics(usage, ["biz_type", "stage"]).select("biz_type", "stage", "requests", "total_tokens", "cost")


def cost_eval_aggs(prices: tuple[float, float] = EVALUATION_PRICES) -> list[Column]:
    mean = lambda c: _floor_mean(F.sum(_positive(c)), F.count(_positive(c)))
    i, o = mean("input_tokens"), mean("output_tokens")
    return [i.alias("avg_input_tokens"), o.alias("avg_output_tokens"), cost(i, o, prices).alias("cost_per_request")]


def cost_eval(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _grouped(samples, by, *cost_eval_aggs())


def safety_eval_aggs() -> list[Column]:
    return [F.coalesce(F.avg("toxicity"), F.lit(0.0)).alias("avg_toxicity"), _count(F.col("safety_violation")).alias("violations")]


def safety_eval(samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _grouped(samples, by, *safety_eval_aggs())


def comprehensive_eval(samples: DataFrame, by: Sequence[str] = ("biz_type", "stage")) -> DataFrame:
    """Accuracy, latency, cost and safety in one aggregate, so one shuffle."""
    return _grouped(samples, by, *accuracy_aggs(), *latency_eval_aggs(), *cost_eval_aggs(), *safety_eval_aggs())


def safety_stats(checked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """From the columns of safety_columns(): counts (of kinds among unsafe rows only), rate and mean score; null for no rows."""
    bad = ~F.col("safe")
    return _grouped(checked, by, F.count("*").alias("total"), _count(F.col("safe")).alias("safe_count"), _count(bad & F.col("toxic")).alias("toxic_count"), _count(bad & F.col("violence")).alias("violence_count"), _count(bad & F.col("self_harm")).alias("self_harm_count"), F.try_divide(_count(F.col("safe")).cast("double"), F.count("*")).alias("safety_rate"), F.avg("toxicity_score").alias("avg_toxicity_score"))


def evaluate_window(log: DataFrame, now: Column, hours: int = 24, version: str | None = None, least: int = 100, by: Sequence[str] = ("biz_type", "prompt_stage")) -> DataFrame:
    """Counts, rate and mean response of the log's last hours, of one version or all."""
    df = log.where((F.col("created_at") > now - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("created_at") <= now))
    df = df.where(F.col("prompt_version") == version) if version is not None else df
    ok = F.col("validation_status") == "SUCCESS"
    n = F.count("*")
    return _grouped(df, by, n.alias("total"), _count(ok).alias("success"), _count(~ok).alias("failure"), ratio(_count(ok), n).alias("success_rate"), F.avg("response_time_ms").alias("avg_response_ms"), (n >= least).alias("enough_samples"))


def metrics_rollup(points: DataFrame) -> DataFrame:
    """By metric, kind and canonical tags: counters summed, timers counted, summed and maximised, gauges at their last value."""
    kind, v = F.col("kind"), F.col("value")
    df = points.withColumn("tag_key", tag_key(F.col("tags")))
    return df.groupBy("metric", "kind", "tag_key").agg(F.sum(F.when(kind == "counter", v)).alias("total"), F.count(F.when(kind == "timer", v)).alias("count"), F.sum(F.when(kind == "timer", v)).alias("sum"), F.max(F.when(kind == "timer", v)).alias("max"), F.max_by(F.when(kind == "gauge", v), F.when(kind == "gauge", F.struct("ts", "value"))).alias("last"))


def rpc_rollup(calls: DataFrame) -> DataFrame:
    """From method, source, business, code, duration_ms: count and durations by tags; code 0 is a success, null tags are ``unknown``."""
    tag = lambda c: F.coalesce(c, F.lit("unknown")).alias(c)
    status = F.when(F.col("code") == 0, "success").otherwise("fail").alias("status")
    return calls.groupBy(tag("method"), tag("source"), tag("business"), status).agg(F.count("*").alias("calls"), F.sum("duration_ms").alias("duration_ms"), F.max("duration_ms").alias("max_ms"))


def token_usage_rollup(usage: DataFrame) -> DataFrame:
    total = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    df = usage.withColumn("total_tokens", total).unpivot(["biz_type"], ["input_tokens", "output_tokens", "total_tokens"], "counter", "tokens")
    return df.groupBy("biz_type", "counter").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


def task_status_counts(states: DataFrame) -> DataFrame:
    return states.groupBy("status").agg(F.count("*").alias("tasks"))


def step_status_counts(steps: DataFrame) -> DataFrame:
    """step x status with subtotals by step and the grand total."""
    return steps.rollup("step_name", "status").agg(F.count("*").alias("steps"))


def ocr_outcome_counts(pages: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    said = F.trim(F.coalesce("ocr_text", F.lit(""))) != ""
    return _grouped(pages, by, _count(said).alias("with_text"), _count(~said).alias("blank"))


def distinct_ids(pages: DataFrame, by: Sequence[str] = ("video_key", "page_type")) -> DataFrame:
    return pages.select(*by, F.explode("unique_ids").alias("id")).distinct()


def merge_text_lines(tokens: DataFrame, separator: str = ",") -> DataFrame:
    """From image_path, pos, text: the non-empty texts of an image in order, joined."""
    rows = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("pos", "text"))))
    return tokens.groupBy("image_path").agg(F.array_join(F.transform(rows, lambda r: r["text"]), separator).alias("merged_text"))
