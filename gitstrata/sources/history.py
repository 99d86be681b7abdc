"""Run history and project lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_history(log: DataFrame, project: str | None = None) -> DataFrame:
    """Runs, newest first; optionally of one project."""
    runs = log if project is None else log.where(F.col("project") == project)
    return runs.orderBy(F.col("created_at").desc(), F.col("ord").desc())


def recent_runs(log: DataFrame, n: int = 10) -> DataFrame:
    return run_history(log).limit(n)


def project_by_code(projects: DataFrame, code: str) -> DataFrame:
    return projects.where(F.col("code") == code)


def active_projects(projects: DataFrame) -> DataFrame:
    return projects.where(F.col("active"))
