"""Ordered classifications and gates over validation records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import CRASH, FAIL_MARKER, SETUP_FAILURE, markers

#: Fixed thresholds of the quality gate.
LEAST_COVERAGE = 0.80
LEAST_MUTATION = 0.50


def mutation_score_meaningful(has_workspace: Column, n_mutants: Column, baseline_failed: Column, differential_status: Column, error_runs: Column) -> Column:
    """Whether a mutation score says anything: there were mutants to run (or no workspace to run them in), the baseline held, the differential run did not fail and no run broke."""
    held = ~F.coalesce(has_workspace, F.lit(False)) | (F.coalesce(n_mutants, F.lit(0)) > 0)
    return held & ~F.coalesce(baseline_failed, F.lit(False)) & (F.coalesce(differential_status, F.lit("")) != "fail") & (F.coalesce(error_runs, F.lit(0)) == 0)


def run_outcome(status: Column, stdout: Column, stderr: Column) -> Column:
    """What a run says about its defect: undetected, detected or error, the first rule that holds."""
    out = F.coalesce(stdout, F.lit(""))
    return (
        F.when(status == "pass", "undetected")
        .when(status.isin("error", "timeout"), "error")
        .when(F.contains(out, F.lit(SETUP_FAILURE)), "error")
        .when(F.contains(F.coalesce(stderr, F.lit("")), F.lit(CRASH)), "error")
        .when(F.size(markers(out, FAIL_MARKER)) > 0, "detected")
        .otherwise("error")
    )


def quality_gate(validation: Column, analysis: Column, mapping: Column, mutation: Column, coverage: Column | None = None, least_coverage: float = LEAST_COVERAGE, least_mutation: float = LEAST_MUTATION) -> Column:
    """Validated, analysed without a failure, and both scores high enough; reports without a mapping coverage fall back on their ``coverage``."""
    covered = F.coalesce(mapping, F.lit(0.0)) if coverage is None else F.coalesce(mapping, coverage, F.lit(0.0))
    scores = (covered >= least_coverage) & (F.coalesce(mutation, F.lit(0.0)) >= least_mutation)
    return F.coalesce(validation == "pass", F.lit(False)) & F.coalesce(analysis, F.lit("fail")).isin("pass", "warning") & scores


def run_state(published: Column, failed: Column, below_quality: Column, interrupted: Column) -> Column:
    """State of a run from numbers of its cases: interrupted, then partial (some failed and some did not, or any is below quality), failed, complete; an empty run is complete."""
    return F.when(interrupted > 0, "interrupted").when(((failed > 0) & (published > 0)) | (below_quality > 0), "partial").when(failed > 0, "failed").otherwise("complete")


def stops(retained: Column, artifact: Column) -> Column:
    """Why no further round follows: retained, nothing_to_revise, or null."""
    return F.when(F.coalesce(retained, F.lit(False)), "retained").when(F.coalesce(artifact, F.lit("none")) == "none", "nothing_to_revise")


def computed_wins(reported: Column, computed: Column, slack: float = 0.01) -> Column:
    """(value, overridden): the computed score stands, flagged where the report strays."""
    return F.struct(computed.alias("value"), (F.abs(F.coalesce(reported, F.lit(0.0)) - computed) > slack).alias("overridden"))
