"""Pattern matches with their places, from built-in functions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,stop:int,hit:string>>"


def find(df: DataFrame, text: str, patterns: Mapping[str, str], needs: Mapping[str, str] | None = None) -> DataFrame:
    """One column of spans per pattern: leftmost non-overlapping matches, places in code points.

    ``needs`` names a plain string without which a pattern can't match, which is looked for
    first.  The places come from the lengths of what lies between the matches, in a second
    projection, so that each text is matched once more only where there is a match.
    """
    out = df
    for name, pattern in patterns.items():
        there = F.col(text).rlike(pattern)
        if needs and name in needs:
            there = F.contains(F.col(text), F.lit(needs[name])) & there
        out = out.withColumn(
            name,
            F.when(there, F.struct(
                F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("hits"),
                F.transform(F.split(F.col(text), pattern, -1), F.length).alias("gaps"),
            )),
        )
    for name in patterns:
        out = out.withColumn(name, F.when(F.col(name).isNotNull(), _placed(F.col(name))))
    for name in patterns:
        empty = F.array().cast(SPAN)
        out = out.withColumn(name, F.coalesce(F.col(name), empty))
    return out


def _placed(found: Column) -> Column:
    hits, gaps = found["hits"], found["gaps"]
    steps = F.zip_with(gaps, F.transform(hits, F.length), lambda g, s: F.struct(g.alias("g"), F.coalesce(s, F.lit(0)).alias("s")))
    starts = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda a, x: F.struct(
            (a["at"] + x["g"] + x["s"]).alias("at"), F.concat(a["all"], F.array(a["at"] + x["g"])).alias("all")
        ),
        lambda a: a["all"],
    )
    return F.zip_with(
        F.slice(starts, 1, F.size(hits)), hits,
        lambda s, h: F.struct(s.alias("start"), (s + F.length(h)).alias("stop"), h.alias("hit")),
    )


def ordered(parts: Sequence[tuple[str, Column]]) -> Column:
    """Spans of several kinds as (start, rank, stop, kind), sorted."""
    return F.array_sort(F.concat(*[_ranked(i, k, c) for i, (k, c) in enumerate(parts)]))


def _ranked(rank: int, kind: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(
        x["start"].alias("start"), F.lit(rank).alias("rank"), x["stop"].alias("stop"), F.lit(kind).alias("kind")
    ))


def written(ordered_spans: Column) -> Column:
    """``kind:start:stop`` of each span, comma-joined."""
    return F.array_join(F.transform(ordered_spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def luhn(digits: Column) -> Column:
    """Whether a string of digits ends in its check digit."""
    each = F.transform(
        F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
    )
    doubled = F.transform(
        each, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, F.lit(9)).otherwise(F.lit(0)))
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")
