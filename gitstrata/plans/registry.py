"""Named queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gitstrata.functions import dims
from gitstrata.plans.fixtures import BASE_TABLES, table, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Source:
    """``src.commits`` is the fixture view ``commits`` over one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        # The tables hold times without zone; one fixed zone keeps results equal everywhere.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        # The views build long texts and series from a few packed columns, so sizes guessed from the files are far too
        # small; a table is broadcast only by its size as measured at run time.
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def sql(self, text: str) -> DataFrame:
        for base in BASE_TABLES:
            table(self.spark, self.sf_dir, base).createOrReplaceTempView(base)
        return self.spark.sql(with_views(text, engine="spark"))


def query(name: str, sql: str | None = None, *, once: bool = False):
    """Register ``fn(src)`` under ``name``; ``sql`` is what DuckDB runs, with every view worked out ``once`` if asked."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Source(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, once=once)
        return fn

    return wrap


# SQL text shared by several checks ------------------------------------------------

def quoted(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def sql_groups(col: str, groups, fn: str, default: str) -> str:
    """CASE over word groups; ``fn`` is a DuckDB predicate taking (text, word)."""
    whens = " ".join(
        f"WHEN {' OR '.join(f'{fn}({col}, {quoted(w)})' for w in words)} THEN {quoted(value)}"
        for value, words in groups if words
    )
    return f"CASE {whens} ELSE {default} END"


def sql_rule_category(col: str) -> str:
    by_key = sql_groups(col, [(c, k) for c, _, _, k in dims.CATEGORY_RULES], "contains", "'other'")
    by_pre = sql_groups(col, [(c, p) for c, _, p, _ in dims.CATEGORY_RULES], "starts_with", by_key)
    return f"CASE WHEN {col} IS NULL OR {col} = '' THEN 'other' ELSE {by_pre} END"


def sql_clean(col: str) -> str:
    out = col
    for p in dims.MESSAGE_NOISE:
        out = f"regexp_replace({out}, {quoted(p)}, '', 'g')"
    return f"regexp_replace({out}, '^\\s+|\\s+$', '', 'g')"


def sql_severity(col: str) -> str:
    whens = " ".join(f"WHEN {col} = '{c}' THEN '{s}'" for c, _, s in dims.FINDING_CATEGORIES)
    return f"CASE {whens} ELSE 'P4' END"


def sql_mask(col: str) -> str:
    out = col
    for p, keep in dims.SECRET_PATTERNS:
        out = f"regexp_replace({out}, {quoted(p)}, {quoted(keep.replace('$1', chr(92) + '1'))}, 'g')"
    return out


def sql_any_match(col: str, patterns) -> str:
    return "(" + " OR ".join(f"coalesce(regexp_matches({col}, {quoted(p)}), false)" for p in patterns) + ")"
