"""Dependencies from requirement files and TOML manifests."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Folders that hold no project's own manifests, and files that make a folder a Python project.
PRUNED = (".git", "node_modules", ".venv", "venv", "__pycache__")
MARKERS = ("pyproject.toml", "setup.py", "setup.cfg", "requirements.txt", "Pipfile")


def own_files(files: DataFrame) -> DataFrame:
    """Files (path, ...) none of whose folders is pruned."""
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    return files.where(~F.arrays_overlap(folders, F.array(*[F.lit(x) for x in PRUNED])))


def is_project(paths: DataFrame) -> DataFrame:
    """One row: whether any of the paths is a Python file or a project's marker."""
    name = F.element_at(F.split("path", "/"), -1)
    return paths.agg(F.coalesce(F.bool_or(name.endswith(".py") | name.isin(*MARKERS)), F.lit(False)).alias("is_project"))


def requirement_lines(files: DataFrame) -> DataFrame:
    """(source, line_no, line) of (path, source) whose name speaks of requirements."""
    named = files.where(F.rlike(F.lower("path"), F.lit(r"[^/]*requirements[^/]*\.txt$")))
    return named.select(F.col("path").alias("source"), F.posexplode(F.split("source", "\n")).alias("at", "line")).select("source", (F.col("at") + 1).alias("line_no"), "line")


def toml_lines(files: DataFrame) -> DataFrame:
    """(source, line_no, line): a TOML manifest's dependencies written as requirement lines."""

    def listed(text: str) -> list[str]:
        try:
            data = tomllib.loads(text)
        except (tomllib.TOMLDecodeError, TypeError):
            return []
        project = data.get("project", {})
        out = [*project.get("dependencies", [])]
        for group in project.get("optional-dependencies", {}).values():
            out += group
        for name, version in data.get("tool", {}).get("poetry", {}).get("dependencies", {}).items():
            version = version.get("version", "") if isinstance(version, dict) else version
            if name.lower() != "python" and isinstance(version, str) and version[:1].isalnum() | (version[:1] in ("^", "~", "=", ">")):
                bare = version.lstrip("^~=>")
                out.append(f"{name}=={bare}" if version[:1].isalnum() or version.startswith("==") else f"{name}>={bare}")
        return [x for x in out if isinstance(x, str)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, i + 1, line) for p, s in zip(frame["path"], frame["source"], strict=True) for i, line in enumerate(listed(s))]
            yield pd.DataFrame(rows, columns=["source", "line_no", "line"])

    return files.where(F.endswith(F.col("path"), F.lit("pyproject.toml"))).select("path", "source").mapInPandas(run, "source string, line_no int, line string")
