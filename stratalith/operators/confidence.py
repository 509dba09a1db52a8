"""Confidence scores as column expressions over a row of counts and flags for each analysis.

Counts may be null, which counts as 0, and flags, which count as false.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def n(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def flag(c: str) -> Column:
    return F.when(F.coalesce(F.col(c).cast("boolean"), F.lit(False)), 1.0).otherwise(0.0)


def share(c: str, of: float) -> Column:
    """A count by what is enough, 1 at most."""
    return F.least(F.lit(1.0), n(c) / of)


def weighted(*parts: tuple[float, Column]) -> Column:
    out = F.lit(0.0)
    for w, c in parts:
        out = out + F.lit(w) * c
    return out


def capped(c: Column, most: float) -> Column:
    return F.least(F.lit(most), c)


def consistency() -> Column:
    """From has_complexity, cyclomatic, n_patterns, has_security."""
    sound = flag("has_complexity") * F.when(n("cyclomatic").between(1, 50), 0.3).otherwise(0.0)
    return F.least(F.lit(1.0), sound + flag("has_complexity") * F.when(n("n_patterns") > 0, 0.3).otherwise(0.0) + 0.4 * flag("has_security"))


def analysis() -> Column:
    """Completeness of four parts, depth of three, errors, consistency."""
    complete = (flag("has_complexity") + flag("has_patterns") + flag("has_security") + flag("has_dependencies")) / 4
    depth = (flag("has_metrics") + flag("has_quality_score") + flag("has_insights")) / 3
    return weighted((0.3, complete), (0.3, depth), (0.2, F.greatest(F.lit(0.0), 1 - n("n_errors") * 0.2)), (0.2, consistency()))


def patterns() -> Column:
    """Coverage, mean confidence, kinds."""
    return weighted((0.4, share("n_patterns", 5)), (0.4, F.when(n("n_patterns") > 0, n("pattern_confidence")).otherwise(0.0)), (0.2, share("n_pattern_types", 3)))


def coherence() -> Column:
    """From the largest layer's share of files, cycles and high coupling."""
    even = F.when((n("layer_files") > 0) & (n("largest_layer") / n("layer_files") < 0.8), 0.4).otherwise(0.0)
    cycles = F.when(n("n_cycles") == 0, 0.3).when(n("n_cycles") < 3, 0.1).otherwise(0.0)
    coupling = F.when((n("n_coupled") > 0) & (n("n_high_coupling") / n("n_coupled") < 0.3), 0.3).otherwise(0.0)
    return F.least(F.lit(1.0), even + flag("has_dependencies") * (cycles + coupling))


def architecture() -> Column:
    """Layers, components, completeness of dependencies, coherence."""
    known = flag("has_dependencies") * (0.3 * flag("has_imports") + 0.3 * flag("has_cycles") + 0.4 * flag("has_coupling"))
    return weighted((0.3, share("n_layers", 4)), (0.2, share("n_components", 10)), (0.3, known), (0.2, coherence()))


def security() -> Column:
    """Coverage of the scan, mean confidence of findings (0.8 if none), security patterns, completeness of the risk assessment."""
    sure = F.when(n("n_vulnerabilities") > 0, n("vulnerability_confidence")).otherwise(0.8)
    scan = (flag("has_vulnerabilities") + flag("has_security_patterns") + flag("has_risk")) / 3
    risk = flag("has_risk") * (0.5 * flag("has_overall_risk") + 0.5 * flag("has_risk_factors"))
    return weighted((0.3, scan), (0.3, sure), (0.2, share("n_security_patterns", 3)), (0.2, risk))


def dependencies() -> Column:
    """Files mapped, cycles looked for, files with coupling, outside dependencies."""
    return weighted((0.3, share("n_imports", 10)), (0.2, flag("has_cycles")), (0.3, share("n_coupled", 10)), (0.2, share("n_external", 5)))


def recommendations() -> Column:
    """Coverage, quality (mean of analysis and patterns), shares that can be acted on and that have a priority."""
    part = lambda c: F.when(n("n_recommendations") > 0, n(c) / n("n_recommendations")).otherwise(0.0)
    return weighted((0.3, share("n_recommendations", 5)), (0.3, (analysis() + patterns()) / 2), (0.2, part("n_actionable")), (0.2, part("n_prioritised")))


def graph(nodes: str, edges: str) -> Column:
    """Of a dependency graph: more of it is surer, 0.95 at most."""
    return F.round(F.least(F.lit(0.95), F.least(F.lit(0.5), n(nodes) * 0.05) + F.least(F.lit(0.45), n(edges) * 0.03)), 3)


def tools(succeeded: str, total: str, complete: str, recommends: str, finds: str) -> Column:
    """Share of tools that succeeded (0.5 without tools) with bonuses for what the output has; 1 at most."""
    base = F.when(n(total) > 0, n(succeeded) / n(total)).otherwise(0.5)
    return F.least(F.lit(1.0), base + 0.2 * flag(complete) + 0.1 * flag(recommends) + 0.1 * flag(finds))
