"""Scores, bands and formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the scoring rules.
SEVERITIES = ("critical", "high", "medium", "low")
PENALTY = {"critical": 15.0, "high": 8.0, "medium": 3.0, "low": 1.0}
HALF_LIFE_DAYS = 180.0
RECENT_DAYS = 90
SECURITY_HALVES_AT = 20.0
LINES_PER_DENSITY = 1000.0


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def share(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(empty))


def rounded(x: Column, places: int) -> Column:
    """x rounded as binary arithmetic has it: 39.995 times 100 falls short of 3999.5 or not, and decides. `F.round` goes
    by the decimal digits instead."""
    scale = F.lit(float(10**places))
    return F.round(x * scale) / scale


def decay(ts: Column, now: Column) -> Column:
    """Halves every HALF_LIFE_DAYS; the future counts as now."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    age = F.greatest(F.lit(0.0), (micros(now) - micros(ts)) / F.lit(86_400_000_000.0))
    return F.pow(F.lit(0.5), age / F.lit(HALF_LIFE_DAYS))


def log_norm(x: Column, most: Column) -> Column:
    return F.when(most > 0, F.log1p(x) / F.log1p(most)).otherwise(0.0)


def risk_band(risk: Column) -> Column:
    return F.when(risk >= 0.5, "critical").when(risk >= 0.25, "high").when(risk >= 0.1, "moderate").otherwise("low")


def complexity_band(c: Column) -> Column:
    return F.when(c <= 5, "low").when(c <= 10, "moderate").otherwise("high")


def complexity_score(average: Column) -> Column:
    return clamp(F.lit(100.0) - F.greatest(F.lit(0.0), average - 5) * 5)


def health(maintainability: Column, average_complexity: Column, duplication: Column) -> Column:
    return maintainability * 0.40 + complexity_score(average_complexity) * 0.30 + clamp(F.lit(100.0) - duplication) * 0.30


def grade(score: Column) -> Column:
    return F.when(score >= 80, "A").when(score >= 65, "B").when(score >= 50, "C").when(score >= 35, "D").otherwise("F")


def mi_rating(mi: Column) -> Column:
    return F.when(mi >= 80, "Excellent").when(mi >= 60, "Good").when(mi >= 40, "Fair").otherwise("Poor")


def coverage_rating(pct: Column) -> Column:
    return F.when(pct >= 90, "Excellent").when(pct >= 70, "Good").when(pct >= 40, "Fair").otherwise("Poor")


def halstead(n1: Column, n2: Column, big_n1: Column, big_n2: Column) -> dict[str, Column]:
    """Vocabulary, length, volume, difficulty and effort; 0 where a count is missing."""
    vocabulary, length = n1 + n2, big_n1 + big_n2
    volume = F.when(vocabulary > 0, length * F.log2(vocabulary.cast("double"))).otherwise(0.0)
    difficulty = F.when(n2 > 0, (n1 / F.lit(2.0)) * share(big_n2, n2)).otherwise(0.0)
    return {"vocabulary": vocabulary, "length": length, "volume": volume, "difficulty": difficulty, "effort": difficulty * volume}


def maintainability(volume: Column, complexity: Column, loc: Column) -> Column:
    raw = F.lit(171.0) - F.ln(F.greatest(volume, F.lit(1.0))) * 5.2 - complexity * 0.23 - F.ln(F.greatest(loc.cast("double"), F.lit(1.0))) * 16.2
    return clamp(raw * 100 / 171)


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity).cast("int")


def penalty(severity: Column) -> Column:
    out = F.lit(0.0)
    for name, points in PENALTY.items():
        out = F.when(severity == name, F.lit(points)).otherwise(out)
    return out


def downgrade(severity: Column) -> Column:
    return F.when(severity == "critical", "high").when(severity == "high", "medium").otherwise("low")


def security_score(code_penalty: Column, loc: Column, dependency_penalty: Column) -> Column:
    density = F.when(loc > 0, code_penalty / loc * LINES_PER_DENSITY).otherwise(0.0)
    return F.pow(F.lit(0.5), (density + dependency_penalty) / SECURITY_HALVES_AT) * 100


def direction(delta: Column, threshold: Column, higher_is_better: Column) -> Column:
    """higher_is_better is null for metrics without a direction."""
    return (
        F.when(F.abs(delta) < threshold, "unchanged")
        .when(higher_is_better.isNull(), "changed")
        .when((delta > 0) == higher_is_better, "improved")
        .otherwise("regressed")
    )


def expired(expires_at: Column, now: Column, margin_minutes: int = 10) -> Column:
    """True within the margin before expiry; a token without an expiry never expires."""
    return F.coalesce(now + F.expr(f"INTERVAL {margin_minutes} MINUTES") >= expires_at, F.lit(False))
