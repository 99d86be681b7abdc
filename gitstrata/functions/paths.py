"""Column expressions over file paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gitstrata.functions import dims


def normal(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def file_name(path: Column) -> Column:
    return F.substring_index(normal(path), "/", -1)


def module_of(path: Column) -> Column:
    """Rightmost directory that is no framework directory, in its own case; else ``other``."""
    parts = F.reverse(F.split(F.regexp_replace(path, r"/[^/]*$", ""), "/"))
    free = F.filter(parts, lambda p: (p != "") & ~F.lower(p).isin(dims.FRAMEWORK_DIRS))
    return F.when(F.coalesce(path, F.lit("")).contains("/"), F.coalesce(F.try_element_at(free, F.lit(1)), F.lit("other"))).otherwise("other")


def is_controller(path: Column) -> Column:
    return F.lower(path).contains("controller")


def is_service(path: Column) -> Column:
    return F.lower(path).contains("service")


def is_data_access(path: Column) -> Column:
    low = F.lower(path)
    return low.contains("dao") | low.contains("repository") | low.contains("mapper")


def node_type(path: Column) -> Column:
    return (
        F.when(is_controller(path), "controller").when(is_service(path), "service")
        .when(is_data_access(path), "dao").otherwise("class")
    )


def role(path: Column, package: Column | None = None) -> Column:
    """What a file is for, by its name ending, then by its package."""
    name = F.lower(file_name(path))
    out = None
    for what, endings in dims.ROLE_BY_ENDING:
        hit = name.endswith(endings[0])
        for e in endings[1:]:
            hit = hit | name.endswith(e)
        out = F.when(hit, what) if out is None else out.when(hit, what)
    if package is not None:
        low = F.lower(package)
        for what, marks in dims.ROLE_BY_PACKAGE:
            for m in marks:
                out = out.when(low.contains(m), what)
    return out.otherwise(dims.ROLE_DEFAULT)


def is_code(path: Column) -> Column:
    low = F.lower(normal(path))
    extensions = "|".join(dims.BINARY_EXTENSIONS + dims.CONFIG_EXTENSIONS)
    return ~(low.rlike(rf"\.({extensions})$") | low.contains("/deploy/") | low.contains("/config/"))


def _suffixes(path: Column) -> Column:
    parts = F.split(normal(path), "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/")
    )


def match_paths(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (repo_id, left_path, right_path) where one path is the other or ends it at a slash.

    Every path is spread to its suffixes (as many as it has parts) and joined on
    equality, so cost grows with the paths and not with their pairs.
    """
    a = left.select("repo_id", F.col("path").alias("left_path")).distinct()
    b = right.select("repo_id", F.col("path").alias("right_path")).distinct()
    whole_a, whole_b = a.withColumn("k", normal(F.col("left_path"))), b.withColumn("k", normal(F.col("right_path")))
    part_a = a.withColumn("k", F.explode(_suffixes(F.col("left_path"))))
    part_b = b.withColumn("k", F.explode(_suffixes(F.col("right_path"))))
    pairs = part_a.join(whole_b, ["repo_id", "k"]).unionByName(whole_a.join(part_b, ["repo_id", "k"]))
    return pairs.select("repo_id", "left_path", "right_path").distinct()
