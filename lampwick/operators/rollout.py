"""Canaries, comparisons, plans of rollouts and rollbacks."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.prompts import candidate_prompts
from ..functions.values import canary_share
from .metrics import evaluate_window, ratio

LEAST_RATE, WORST_DROP = 0.90, 0.05
# Weights of accuracy, cost and latency, and what cost and latency are measured against.
WEIGHTS, MOST_COST, MOST_LATENCY = (0.5, 0.3, 0.2), 0.05, 3000.0


def canary_assign(tasks: DataFrame, canaries: DataFrame) -> DataFrame:
    """Adds canary_version: the newest enabled canary of (biz_type, stage) if the task's share falls below its ratio."""
    active = canaries.where("enabled").groupBy("biz_type", "stage").agg(F.max_by(F.struct("version", "ratio"), "published_at").alias("c"))
    df = tasks.join(active, ["biz_type", "stage"], "left")
    return df.withColumn("canary_version", F.when(canary_share(F.col("task_id")) < F.col("c.ratio"), F.col("c.version"))).drop("c")


def canary_compare(log: DataFrame, drop: float = WORST_DROP) -> DataFrame:
    """Success rate of each version beside that of all versions of its biz and stage; ``rollback`` where it is lower by more than drop."""
    ok = F.col("validation_status") == "SUCCESS"
    rows = log.groupBy("biz_type", "prompt_stage", "prompt_version").agg(F.count("*").alias("n"), F.count_if(ok).alias("good"))
    own = Window.partitionBy("biz_type", "prompt_stage")
    df = rows.withColumns({"version_rate": ratio(F.col("good"), F.col("n")), "baseline_rate": ratio(F.sum("good").over(own), F.sum("n").over(own))})
    return df.withColumns({"drop": F.col("baseline_rate") - F.col("version_rate"), "rollback": F.col("baseline_rate") - F.col("version_rate") > drop}).select("biz_type", "prompt_stage", "prompt_version", "n", "version_rate", "baseline_rate", "drop", "rollback")


def rollback_plan(log: DataFrame, drop: float = WORST_DROP) -> DataFrame:
    return canary_compare(log, drop).where("rollback").select("biz_type", "prompt_stage", "prompt_version", "drop")


def recent_failures(log: DataFrame, n: int = 50) -> DataFrame:
    """The newest n failed rows of each biz and stage; the window is limited before its shuffle."""
    order = Window.partitionBy("biz_type", "prompt_stage").orderBy(F.desc("created_at"), F.desc("log_id"))
    return log.where("validation_status <> 'SUCCESS'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def filter_failure_cases(log: DataFrame, now: Column, hours: int = 24, n: int = 50) -> DataFrame:
    return recent_failures(log.where((F.col("created_at") > now - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("created_at") <= now)), n)


def rollout_plan(log: DataFrame, now: Column, hours: int = 24, least: float = LEAST_RATE) -> DataFrame:
    """biz and stage with a rate under ``least`` and a failure: they need a new version."""
    return evaluate_window(log, now, hours).where((F.col("success_rate") < least) & (F.col("failure") > 0)).select("biz_type", "prompt_stage", "total", "failure", "success_rate")


def candidate_score(accuracy: Column, cost: Column, latency: Column) -> Column:
    part = lambda v, most: 1.0 - F.least(F.lit(1.0), v / most)
    return WEIGHTS[0] * accuracy + WEIGHTS[1] * part(cost, MOST_COST) + WEIGHTS[2] * part(latency, MOST_LATENCY)


def candidate_top1(candidates: DataFrame, by: list[str]) -> DataFrame:
    """The candidate (pos, accuracy, cost, latency) with the largest score in each group, the first of equals."""
    df = candidates.withColumn("score", candidate_score(F.col("accuracy"), F.col("cost"), F.col("latency")))
    best = F.max_by(F.struct("pos", "accuracy", "cost", "latency", "score"), F.struct("score", -F.col("pos")))
    return df.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def _sweep(batches):
    """Points (_key, accuracy, cost, latency) sorted by key, accuracy down, cost and latency up: those that none before of their key dominates.

    Only a later point can be dominated, and of those before only the stairs count: costs up, latencies down.
    """
    key, costs, lates = None, [], []
    for batch in batches:
        keep = []
        for own, cost, late in zip(*(batch.column(c).to_pylist() for c in ("_key", "cost", "latency"))):
            if own != key:
                key, costs, lates = own, [], []
            at = bisect_right(costs, cost)
            keep.append(not at or lates[at - 1] > late)
            if keep[-1]:
                end = at
                while end < len(costs) and lates[end] >= late:
                    end += 1
                at -= bool(at and costs[at - 1] == cost)
                costs[at:end], lates[at:end] = [cost], [late]
        yield batch.filter(pa.array(keep, pa.bool_()))


def _swept(points: DataFrame) -> DataFrame:
    rows = points.repartition("_key").sortWithinPartitions("_key", F.desc("accuracy"), "cost", "latency")
    return rows.mapInArrow(_sweep, rows.schema)


def pareto_front(candidates: DataFrame, by: list[str], block: int = 50_000) -> DataFrame:
    """Candidates that no other of their group dominates: none is as good everywhere and better somewhere.

    Equal points are folded. Each group is dealt into blocks of about ``block``
    points, whose fronts are swept by themselves; what is left of a group
    is swept once more by a task that reads it sorted and holds only the stairs of
    costs and latencies. Rows with a null or NaN in the group or a point give none.
    """
    points = ["accuracy", "cost", "latency"]
    real = candidates.dropna(subset=[*by, *points])
    distinct = real.select(F.struct(*by).alias("_g"), *(F.col(c).cast("double").alias(c) for c in points)).distinct()
    sizes = distinct.groupBy("_g").agg(F.ceil(F.count("*") / block).alias("_blocks")).hint("merge")
    dealt = distinct.join(sizes, "_g").select(F.struct("_g", F.pmod(F.xxhash64(*points), F.col("_blocks")).alias("block")).alias("_key"), *points)
    front = _swept(_swept(dealt).select(F.col("_key._g").alias("_key"), *points))
    right = front.select("_key", *(F.col(c).alias(f"_{c}") for c in points)).hint("merge")
    return real.join(right, [F.struct(*by) == F.col("_key"), *(F.col(c).cast("double") == F.col(f"_{c}") for c in points)], "left_semi")


#: Ways to make better prompts, by name: each takes prompts (by..., prompt, failures: array<string>) and gives (by..., kind, prompt).
OPTIMIZERS: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {}


def register_optimizer(name: str, optimize: Callable[[DataFrame, list[str]], DataFrame]) -> None:
    OPTIMIZERS[name] = optimize


def optimize_prompts(prompts: DataFrame, by: list[str], names: list[str] | None = None) -> DataFrame:
    """Candidates of the named optimisers, of all by default: by..., optimizer, kind, prompt. A name that isn't registered is an error."""
    out = [OPTIMIZERS[n](prompts, by).select(*by, F.lit(n).alias("optimizer"), "kind", "prompt") for n in (names or sorted(OPTIMIZERS))]
    return reduce(DataFrame.unionByName, out)


def _templates(prompts: DataFrame, by: list[str]) -> DataFrame:
    return prompts.select(*by, F.explode(candidate_prompts(F.col("prompt"), F.col("failures"))).alias("c")).select(*by, "c.kind", "c.prompt")


register_optimizer("templates", _templates)
