"""Column roles that operators expect, whatever table they are bound to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

CHANGES = ("entity", "author", "ts", "lines")
BASKETS = ("basket", "item")
FINDINGS = ("path", "line", "rule", "severity")
SNAPSHOTS = ("run", "metric", "value")


def bind(df: DataFrame, roles: tuple[str, ...], **columns: Column) -> DataFrame:
    """df with exactly the columns of the roles, given by name."""
    missing = [r for r in roles if r not in columns]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    return df.select(*[columns[r].alias(r) for r in roles])
