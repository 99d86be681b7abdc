"""Column expressions for commit messages and review text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gitstrata.functions import dims


def lit_or(cond: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cond)


def contains_any(text: Column, words: list[str]) -> Column:
    return lit_or([text.contains(w) for w in words])


def first_group(text: Column, groups: list[tuple[str, list[str]]], test, default) -> Column:
    """Value of the first group with a matching word."""
    out = None
    for value, words in groups:
        hit = lit_or([test(text, w) for w in words])
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def first_line(message: Column) -> Column:
    return F.trim(F.substring_index(message, "\n", 1))


def clean_message(message: Column) -> Column:
    out = message
    for pattern in dims.MESSAGE_NOISE:
        out = F.regexp_replace(out, pattern, "")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def rule_category(message: Column, rules=dims.CATEGORY_RULES) -> Column:
    """Any rule's prefix first, then any rule's keyword; rule order breaks ties."""
    prefixes = [(code, pre) for code, _, pre, _ in rules if pre]
    keywords = [(code, key) for code, _, _, key in rules if key]
    by_key = first_group(message, keywords, lambda t, w: t.contains(w), "other") if keywords else F.lit("other")
    by_pre = first_group(message, prefixes, lambda t, w: t.startswith(w), by_key) if prefixes else by_key
    return F.when(message.isNull() | (message == ""), "other").otherwise(by_pre)


def label_in_reply(reply: Column) -> Column:
    """First known label contained in a model's reply."""
    label = {code: name for code, name, _, _ in dims.CATEGORY_RULES} | {"other": dims.OTHER_LABEL}
    groups = [(code, [label[code]]) for code in dims.REPLY_ORDER]
    return F.when(is_blank(reply), "other").otherwise(first_group(reply, groups, lambda t, w: t.contains(w), "other"))


def parse_time(text: Column) -> Column:
    """First of the known formats that fits the whole text, else null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in dims.TIME_FORMATS])


def half_up2(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def shorten(text: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def preview(message: Column) -> Column:
    return F.coalesce(F.replace(shorten(message, 60), F.lit("|"), F.lit("\\|")), F.lit("-"))


def short_id(commit_id: Column) -> Column:
    return F.substring(F.coalesce(commit_id, F.lit("")), 1, 8)


def path_tail(path: Column, n: int) -> Column:
    """The last part of a long path, marked in front."""
    return F.when(F.length(path) > n, F.concat(F.lit("..."), F.right(path, F.lit(n - 3)))).otherwise(path)


def mask_secrets(text: Column) -> Column:
    out = text
    for pattern, keep in dims.SECRET_PATTERNS:
        out = F.regexp_replace(out, pattern, keep)
    return out


def mask_log(text: Column) -> Column:
    out = text
    for pattern in dims.LOG_PATTERNS:
        out = F.regexp_replace(out, pattern, "$1******")
    return out


def has_secret(*texts: Column) -> Column:
    return lit_or([F.coalesce(t.rlike(p), F.lit(False)) for t in texts for p, _ in dims.SECRET_PATTERNS])


def has_doubt(text: Column) -> Column:
    return F.coalesce(contains_any(text, dims.DOUBT_WORDS), F.lit(False))


def category_from_text(text: Column) -> Column:
    low = F.lower(text)
    return F.when(text.isNull(), "OTHER").otherwise(
        first_group(low, dims.CATEGORY_WORDS, lambda t, w: t.contains(w), "OTHER")
    )


def severity_from_text(text: Column) -> Column:
    low = F.lower(text)
    return F.when(text.isNull(), "P4").otherwise(
        first_group(low, dims.SEVERITY_WORDS, lambda t, w: t.contains(w), "P4")
    )


def category_from_code(code: Column) -> Column:
    up = F.upper(F.trim(code))
    by_name = F.when(up.isin([c for c, _, _ in dims.FINDING_CATEGORIES]), up)
    label = F.trim(code)
    out = by_name
    for name, zh, _ in dims.FINDING_CATEGORIES:
        out = out.when(label == zh, name)
    return out.otherwise("OTHER")


def severity_from_level(level: Column) -> Column:
    up = F.upper(F.trim(level))
    return F.when(up.isin("P0", "P1", "P2", "P3", "P4"), up).otherwise("P4")


def severity_from_category(category: Column) -> Column:
    out = None
    for sev in ["P0", "P1", "P2", "P3"]:
        hit = category.isin([c for c, _, s in dims.FINDING_CATEGORIES if s == sev])
        out = F.when(hit, sev) if out is None else out.when(hit, sev)
    return out.otherwise("P4")


def status_from_confidence(confidence: Column) -> Column:
    return F.when(confidence >= 0.7, "CONFIRMED").otherwise("FALSE_POSITIVE")
