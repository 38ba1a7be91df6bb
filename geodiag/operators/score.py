"""Scores over findings: five weighted categories, an overall score and grades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodiag.config import Config
from geodiag.functions.text import letter_grade

# fixed values: categories, the rule-id prefixes they gather and their weights' names
CATEGORIES = (
    ("projection", "Projection", "proj", "projection_weight"),
    ("data_integrity", "Data Integrity", "data", "data_integrity_weight"),
    ("accessibility", "Accessibility", "cartography", "accessibility_weight"),
    ("cloud_readiness", "Cloud Readiness", "cloud", "cloud_readiness_weight"),
    ("classification", "Classification", "classification", "classification_weight"),
)


def categories(findings: DataFrame, config: Config | None = None) -> DataFrame:
    """``ord, category, label, score, weight, finding_count, grade``: five rows, one pass over the findings.

    100 less 15 an error (60 at most), 5 a warning (30), 1 an info (10).
    """
    w = (config or Config()).score
    total = sum(getattr(w, c[3]) for c in CATEGORIES)
    scale = 1.0 if (config or Config()).mode == "compat" or not total else 1.0 / total
    has = lambda prefix, sev: F.count_if(F.col("rule_id").startswith(prefix) & (F.col("severity") == sev))
    counts = findings.agg(*(has(c[2], sev).alias(f"{c[0]}_{sev}") for c in CATEGORIES for sev in ("error", "warning", "info")))
    rows = F.array(*(
        F.struct(F.lit(i).alias("ord"), F.lit(c[0]).alias("category"), F.lit(c[1]).alias("label"), F.lit(getattr(w, c[3]) * scale).alias("weight"), *(F.col(f"{c[0]}_{s}").alias(s) for s in ("error", "warning", "info")))
        for i, c in enumerate(CATEGORIES)))
    flat = counts.select(F.explode(rows).alias("c")).select("c.*")
    score = F.greatest(F.lit(100) - F.least(15 * F.col("error"), F.lit(60)) - F.least(5 * F.col("warning"), F.lit(30)) - F.least(F.col("info"), F.lit(10)), F.lit(0)).cast("int")
    return flat.select("ord", "category", "label", score.alias("score"), "weight", (F.col("error") + F.col("warning") + F.col("info")).alias("finding_count"), letter_grade(score).alias("grade"))


def overall(categories_: DataFrame, findings: DataFrame) -> DataFrame:
    """``overall, grade, finding_count``: the weighted sum, rounded half up. Weights that sum to more than 1 can pass 100, and grade F then."""
    total = categories_.agg(F.round(F.sum(F.col("score") * F.col("weight"))).cast("int").alias("overall"))
    return total.join(F.broadcast(findings.agg(F.count(F.lit(1)).alias("finding_count")))).select("overall", letter_grade(F.col("overall")).alias("grade"), "finding_count")


def summary(findings: DataFrame) -> DataFrame:
    """``total, errors, warnings, info``."""
    has = lambda s: F.count_if(F.col("severity") == s)
    return findings.agg(F.count(F.lit(1)).alias("total"), has("error").alias("errors"), has("warning").alias("warnings"), has("info").alias("info"))


def by_domain(findings: DataFrame) -> DataFrame:
    """Counts by the rule id's first path segment."""
    return findings.groupBy(F.split("rule_id", "/")[0].alias("domain")).agg(F.count(F.lit(1)).alias("n"))


def rolled_up(findings: DataFrame) -> DataFrame:
    """Counts by domain, rule and severity with subtotals."""
    return findings.rollup(F.split("rule_id", "/")[0].alias("domain"), "rule_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def filter_domain(findings: DataFrame, domain: str) -> DataFrame:
    """Findings whose rule id begins with the domain's name."""
    return findings.where(F.col("rule_id").startswith(domain))
