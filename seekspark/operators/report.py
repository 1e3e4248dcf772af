"""Roll-ups of evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seekspark.functions.text import natural_order


def flattened(runs: DataFrame, config: str = "config") -> DataFrame:
    """Runs with experiment, name, commit ('' if missing) and agent (false) out of their config."""
    text = lambda key: F.coalesce(F.get_json_object(config, f"$.{key}"), F.lit(""))
    return runs.withColumns({"experiment": text("experiment"), "name": text("name"), "commit": text("commit"), "agent": F.coalesce(F.get_json_object(config, "$.agent") == "true", F.lit(False))})


def of_experiment(runs: DataFrame, experiment: str, config: str = "config") -> DataFrame:
    return runs.where(F.get_json_object(config, "$.experiment") == experiment)


def latest(runs: DataFrame, *keys: str, order: str = "id") -> DataFrame:
    """The latest run of each key, and how many there are."""
    rest = [c for c in runs.columns if c not in keys]
    best = runs.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_run"), F.count("*").alias("runs"))
    return best.select(*keys, "_run.*", "runs")


def groups(runs: DataFrame) -> DataFrame:
    """Latest run and count of each experiment, dataset, agent and name; E2 before E10, search before agent."""
    best = latest(runs, "experiment", "dataset_version", "agent", "name")
    return best.orderBy(*natural_order(F.col("experiment")), "dataset_version", "agent", *natural_order(F.col("name")))


def headlines(runs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The latest run for each wanted(experiment, name, dataset_version); null where there is none."""
    keys = ["experiment", "name", "dataset_version"]
    return wanted.join(latest(runs, *keys), keys, "left")


def axis_max(value: str, ratio: bool) -> Column:
    """Upper end of a chart's axis: 1 for ratios; else the largest value, 1 where that is 0 or missing."""
    return F.lit(1.0) if ratio else F.coalesce(F.nullif(F.greatest(F.lit(0.0), F.max(value).cast("double")), F.lit(0.0)), F.lit(1.0))


def failed_first(results: DataFrame) -> DataFrame:
    """Query results, the worst ranks (none last of all counts 999) first."""
    return results.orderBy(F.desc(F.coalesce("rank", F.lit(999))), F.desc("id"))


def merged_timings(rows: DataFrame, key: str, timings: str) -> DataFrame:
    """(key, timings): the maps of a key added up entry by entry."""
    parts = rows.select(key, F.explode(timings).alias("step", "ms")).groupBy(key, "step").agg(F.sum("ms").alias("ms"))
    return parts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("step", "ms")))).alias(timings))


def with_variant(runs: DataFrame, config: str = "config") -> DataFrame:
    """Runs whose config is parsed once, as a VARIANT; malformed JSON becomes null, and `malformed` says so (a null config isn't)."""
    parsed = F.try_parse_json(config)
    return runs.withColumns({config: parsed, "malformed": F.col(config).isNotNull() & parsed.isNull()})


def flattened_variant(runs: DataFrame, config: str = "config") -> DataFrame:
    """flattened() of a VARIANT config: fields of another type than text, or true and false, count as missing."""
    text = lambda key: F.coalesce(F.when(F.schema_of_variant(F.variant_get(config, f"$.{key}", "variant")) == "STRING", F.variant_get(config, f"$.{key}", "string")), F.lit(""))
    flag = F.when(F.schema_of_variant(F.variant_get(config, "$.agent", "variant")) == "BOOLEAN", F.variant_get(config, "$.agent", "boolean"))
    return runs.withColumns({"experiment": text("experiment"), "name": text("name"), "commit": text("commit"), "agent": F.coalesce(flag, F.lit(False))})


def of_experiment_variant(runs: DataFrame, experiment: str, config: str = "config") -> DataFrame:
    """Runs of one experiment; one whose config is malformed, or names none, is of none."""
    return runs.where(F.try_variant_get(config, "$.experiment", "string") == experiment)
