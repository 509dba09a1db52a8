"""Eight validators over rows of measures, one row for each project, in column expressions of one narrow stage.

A null measure counts as absent: an absent measure is no issue, but absent files,
transformations, test scripts or confidence score nothing.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The measures that validations() reads.
MEASURES = (
    "overall_confidence double, low_categories array<string>, n_weaknesses long, n_vulnerabilities long, n_high_risk long, n_security_patterns long, "
    "layer_files map<string,long>, n_circular long, n_coupled_files long, n_high_coupling long, quality_score double, average_complexity double, n_anti_patterns long, "
    "n_files long, n_parsed long, n_parsing_errors long, parse_success_rate double, n_processed long, n_transformed long, n_failed long, n_test_scripts long"
)
# Thresholds.
LEAST_CONFIDENCE, MOST_HIGH_RISK, LEAST_QUALITY, MOST_COMPLEXITY, LEAST_SHARE, ENOUGH = 0.5, 0, 0.5, 20.0, 0.7, 0.5
LAYERS, MOST_CYCLES, MOST_COUPLED = ("backend",), 3, 0.3
HEALTHY_CYCLES, HEALTHY_COUPLED = 5, 0.4
# What each validator recommends.
SAY = {
    "categories": "Review and improve analysis in: ",
    "weaknesses": "Address identified weaknesses before proceeding",
    "vulnerabilities": "Review and address high-risk security vulnerabilities",
    "patterns": "Consider implementing security best practices",
    "layers": "Implement missing architecture layers: ",
    "circular": "Resolve circular dependencies to improve architecture",
    "coupling": "Refactor highly coupled components",
    "quality": "Improve code quality through refactoring and best practices",
    "complexity": "Reduce code complexity by breaking down complex functions",
    "anti_patterns": "Address identified anti-patterns",
    "chains": "Break circular dependencies to improve maintainability",
    "modules": "Refactor tightly coupled modules into smaller, focused units",
    "parsing": "Review files with parsing errors and fix syntax issues",
    "retry": "Review transformation errors and retry failed files",
    "templates": "Check that the target framework templates are correctly applied",
    "unit": "Generate unit tests for transformed modules",
    "integration": "Add integration tests for API endpoints",
}


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _advice(*cases: tuple[Column, Column | str]) -> Column:
    """The texts whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in cases]))


def _result(rule: str, score: Column, threshold: float, passed: Column, *advice: tuple[Column, Column | str]) -> Column:
    return F.struct(
        F.lit(rule).alias("rule_type"),
        F.when(passed, F.lit("approved")).otherwise("requires_review").alias("status"),
        score.cast("double").alias("score"),
        F.lit(float(threshold)).alias("threshold"),
        passed.alias("passed"),
        _advice(*advice).alias("recommendations"),
    )


def _issues(*found: Column) -> Column:
    out = F.lit(0)
    for f in found:
        out = out + f.cast("int")
    return out


def _by_issues(rule: str, loss: Column, *advice: tuple[Column, Column | str]) -> Column:
    score = F.greatest(F.lit(0.0), F.lit(1.0) - loss)
    return _result(rule, score, ENOUGH, score >= ENOUGH, *advice)


def _confidence() -> Column:
    score, low = F.coalesce(F.col("overall_confidence"), F.lit(0.0)), F.coalesce("low_categories", F.array().cast("array<string>"))
    return _result("confidence_threshold", score, LEAST_CONFIDENCE, score >= LEAST_CONFIDENCE, (F.size(low) > 0, F.concat(F.lit(SAY["categories"]), F.array_join(low, ", "))), (_n("n_weaknesses") > 0, SAY["weaknesses"]))


def _security() -> Column:
    high = _n("n_high_risk")
    score = F.lit(1.0) - high / F.greatest(_n("n_vulnerabilities"), F.lit(1))
    return _result("security_check", score, 1.0 - MOST_HIGH_RISK, high <= MOST_HIGH_RISK, (high > 0, SAY["vulnerabilities"]), (_n("n_security_patterns") == 0, SAY["patterns"]))


def _architecture() -> Column:
    known = F.size(F.coalesce(F.map_keys("layer_files"), F.array().cast("array<string>"))) > 0
    gone = [known & (F.coalesce(F.col("layer_files")[x], F.lit(0)) <= 0) for x in LAYERS]
    names = F.array_join(_advice(*zip(gone, LAYERS, strict=True)), ", ")
    circular, coupled = _n("n_circular") > MOST_CYCLES, _n("n_high_coupling") > _n("n_coupled_files") * MOST_COUPLED
    return _by_issues("architecture_compliance", _issues(*gone, circular, coupled) / 3.0, (names != "", F.concat(F.lit(SAY["layers"]), names)), (circular, SAY["circular"]), (coupled, SAY["coupling"]))


def _quality() -> Column:
    poor, complex_, anti = F.coalesce(F.col("quality_score") < LEAST_QUALITY, F.lit(False)), F.coalesce(F.col("average_complexity") > MOST_COMPLEXITY, F.lit(False)), _n("n_anti_patterns") > 0
    return _by_issues("quality_gate", _issues(poor, complex_, anti) / 3.0, (poor, SAY["quality"]), (complex_, SAY["complexity"]), (anti, SAY["anti_patterns"]))


def _dependencies() -> Column:
    chains, coupled = _n("n_circular") > HEALTHY_CYCLES, _n("n_high_coupling") / F.greatest(_n("n_coupled_files"), F.lit(1)) > HEALTHY_COUPLED
    return _by_issues("dependency_health", _issues(chains, coupled) * 0.4, (chains, SAY["chains"]), (coupled, SAY["modules"]))


def _share(rule: str, total: Column, share: Column, *advice: tuple[Column, Column | str]) -> Column:
    """A share of a total that must not be empty; without one there is nothing to advise on either."""
    score = F.when(total > 0, share).otherwise(F.lit(0.0))
    return _result(rule, score, LEAST_SHARE, score >= LEAST_SHARE, *[((total > 0) & c, t) for c, t in advice])


def _coverage() -> Column:
    total = _n("n_files")
    share = F.coalesce(F.col("parse_success_rate") / 100.0, F.coalesce(F.col("n_parsed"), total) / F.greatest(total, F.lit(1)))
    return _share("file_coverage", total, F.least(F.lit(1.0), share), (_n("n_parsing_errors") > 0, SAY["parsing"]))


def _completeness() -> Column:
    total, failed = _n("n_processed"), _n("n_failed") > 0
    return _share("transformation_completeness", total, F.coalesce(F.col("n_transformed"), total) / F.greatest(total, F.lit(1)), (failed, SAY["retry"]), (failed, SAY["templates"]))


def _tests() -> Column:
    ready = _n("n_test_scripts") > 0
    return _result("test_coverage_readiness", ready.cast("double"), ENOUGH, ready, (~ready, SAY["unit"]), (~ready, SAY["integration"]))


def validations(projects: DataFrame, key: str) -> DataFrame:
    """(key, rule_type, status, score, threshold, passed, recommendations): eight rows for each row of MEASURES."""
    rows = F.array(_confidence(), _security(), _architecture(), _quality(), _dependencies(), _coverage(), _completeness(), _tests())
    return projects.select(key, F.inline(rows))
