"""A whole run from files: read, sample, estimate, infer, write, report."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from regweave.operators.matrix import Expression
from regweave.operators.select import sub_sample
from regweave.params import RegressionParams, RunConfig
from regweave.plans.estimate import estimate_run
from regweave.plans.infer import infer_regulations
from regweave.sinks.writers import run_report, save_output, save_report
from regweave.sources.text import read_gene_major, read_names


@dataclass(frozen=True)
class RunResult:
    config: RunConfig
    params: RegressionParams
    edges: DataFrame | None


#: A stored entry: a 4-byte cell number and an 8-byte value.
ENTRY_BYTES = 12


def _measured(expr: Expression, regulators: DataFrame) -> tuple[Expression, dict[str, int]]:
    """The stored matrix, and its size and that of its regulators' part, counted while it is written."""
    entries, cells = Observation(), Observation()
    names = regulators.select("gene").distinct().withColumn("_regulator", F.lit(1))
    values = expr.values.join(names, "gene", "left").observe(
        entries, F.count(F.lit(1)).alias("entries"), F.count("_regulator").alias("regulator_entries")
    )
    seen = expr.cells.observe(cells, F.count(F.lit(1)).alias("cells"))
    stored = Expression(values.drop("_regulator"), seen, names=expr.names).store()
    items = {**entries.get, **cells.get}
    return stored, items | {"regulator_bytes": ENTRY_BYTES * items["regulator_entries"]}


def run(spark: SparkSession, config: RunConfig) -> RunResult:
    """``dry`` computes nothing, ``cfg`` estimates the rounds, ``inf`` also infers and writes."""
    started = datetime.now()
    boost = config.boost
    rounds = config.nr_boosting_rounds
    edges, measured = None, {}
    if config.run_mode != "dry":
        expr = read_gene_major(spark, config.input_path, config.skip_headers, config.delimiter)
        if config.sample_size is not None:
            expr = sub_sample(expr, config.sample_size, boost.seed)
        regulators = read_names(spark, config.regulators_path)
        expr, measured = _measured(expr, regulators)  # the text is parsed once, for estimation and inference alike
        if rounds is None:
            rounds, _ = estimate_run(
                expr,
                regulators,
                boost,
                config.nr_folds,
                config.nr_estimation_genes,
                config.estimation_genes,
                max_bin=config.max_bin,
                nr_partitions=config.nr_partitions,
            )
    params = RegressionParams(boost, rounds, config.nr_folds)
    if config.run_mode == "inf":
        if rounds is None:
            raise ValueError("no estimation gene's loss curve flattened; set nr_boosting_rounds")
        edges = infer_regulations(
            expr,
            regulators,
            params,
            config.targets,
            config.regularized,
            config.normalized,
            config.truncate,
            config.nr_partitions,
            max_bin=config.max_bin,
        )
        if config.output_path:
            save_output(edges, f"{config.output_path}.result", config.output_format, config.include_flags, config.delimiter)
    final = config.with_rounds(rounds)
    if config.report and config.output_path:
        report = run_report(spark, final, started, datetime.now(), params, measured)
        save_report(report, f"{config.output_path}.report")
    return RunResult(final, params, edges)
