"""Scalar expressions of the metrics, as Column functions that stay inside generated code."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "(unknown)"

# fixed values of the detectors
ERROR_MARKERS = (
    "traceback (most recent call last):", "error ts", "typeerror:", "referenceerror:", "syntaxerror:", "runtimeerror:",
    "cannot find module", "module not found", "build failed", "test failed", "tests failed", "compilation failed",
    "failed with exit code", "panic:", "assertionerror", "exception:", "stack trace",
)
LOOSE_MARKERS = ("error[", "error:", "traceback")
FAILED_SUBJECTS = ("test", "build", "compile", "lint")
NUMBERED_ERRORS = r"(^|\s)[^0-9\s]*[0-9]+[^0-9\s]*\s+[^a-z\s]*errors?[^a-z\s]*(\s|$)"
DEBUG_KEYWORDS = (
    " error ", "error:", "exception", "traceback", "stack trace", "undefined", "not found", "failed", "failure", "cannot", "can't",
    "panic", "crash", "typeerror", "referenceerror", "syntaxerror", "runtimeerror", "build failed", "test failed", "compile error",
)
CONTINUATIONS = (
    "same error", "same issue", "still failing", "still fails", "still broken", "not fixed", "didn't work", "didnt work",
    "doesn't work", "doesnt work", "still not working",
)
FIX_WORDS = r"(?i)\b(fix|fixes|fixed|bug|bugs|hotfix|hotfixes|patch|patches|broken|regression|regressions)\b"
BUG_LABELS = ("bug", "type:bug", "defect")
SIGNATURE_TOKENS = 18
INTEGRATION_BRANCHES = ("main", "master", "staging", "develop")  # for task matching
REPORT_INTEGRATION = (*INTEGRATION_BRANCHES, UNKNOWN)  # for the reports' task filter
METADATA_INTEGRATION = (*INTEGRATION_BRANCHES, "development", "dev")  # beside release/*
FALLBACK_ORDER = ("staging", "main", "master", "develop")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def or_unknown(c: Column) -> Column:
    return F.coalesce(blank_to_null(c), F.lit(UNKNOWN))


def normalized_model(provider: Column, model: Column) -> Column:
    """`provider/model`, whatever prefix the model's name has already; the prefix is compared without case."""
    prefix = F.concat(provider, F.lit("/"))
    return (
        F.when(blank_to_null(model).isNull(), F.concat(prefix, F.lit(UNKNOWN)))
        .when(F.startswith(F.lower(model), F.lower(prefix)), model)
        .otherwise(F.concat(prefix, model))
    )


def week_start(ts: Column) -> Column:
    """Monday of the week, as a date."""
    return F.to_date(F.date_trunc("week", ts))


def percent(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator * 100)


def minutes_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(60_000_000.0)


def rounded(c: Column) -> Column:
    """A weighted count as a whole number, halves away from zero; nothing counts as 0."""
    return F.coalesce(F.round(c, 0), F.lit(0)).cast("bigint")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")).cast("bigint")


def contains_any(text: Column, parts) -> Column:
    return reduce(or_, [F.contains(text, F.lit(p)) for p in parts])


def is_error_paste(text: Column) -> Column:
    low = F.lower(text)
    failed = F.contains(low, F.lit(" failed")) & contains_any(low, FAILED_SUBJECTS)
    return contains_any(low, ERROR_MARKERS + LOOSE_MARKERS) | failed | low.rlike(NUMBERED_ERRORS)


def has_debug_keyword(text: Column) -> Column:
    return contains_any(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), DEBUG_KEYWORDS)


def is_continuation(text: Column) -> Column:
    return contains_any(F.lower(text), CONTINUATIONS)


def normalized_signature(text: Column) -> Column:
    """Up to 18 tokens without outer punctuation, with placeholders for what varies."""
    tokens = F.transform(F.split(text, r"\s+"), lambda t: F.lower(F.regexp_replace(t, r"^[^A-Za-z0-9/\\_.:\-]+|[^A-Za-z0-9/\\_.:\-]+$", "")))

    def shape(t: Column) -> Column:
        return (
            F.when(t.startswith("http://") | t.startswith("https://"), "<url>")
            .when(F.contains(t, F.lit("/")) | F.contains(t, F.lit("\\")), "<path>")
            .when(t.rlike("^[0-9a-f]{8,64}$"), "<sha>")
            .otherwise(F.regexp_replace(t, "[0-9]+", "#"))
        )

    return F.array_join(F.slice(F.transform(F.filter(tokens, lambda t: t != ""), shape), 1, SIGNATURE_TOKENS), " ")


def error_signature(text: Column) -> Column:
    """The signature of the first line with a debug keyword, else of the whole text; null without a keyword."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: (x != "") & has_debug_keyword(x))
    first = blank_to_null(normalized_signature(F.get(lines, F.lit(0))))
    return F.when(has_debug_keyword(text), F.coalesce(first, blank_to_null(normalized_signature(text))))


def is_fix_like(message: Column) -> Column:
    return message.rlike(FIX_WORDS)


def is_revert(message: Column) -> Column:
    head = F.ltrim(message)
    return head.startswith("Revert ") | head.startswith("revert ") | F.contains(message, F.lit("This reverts commit "))


def reverted_shas(message: Column) -> Column:
    """array<string>: what the message's lines revert."""
    found = F.transform(F.split(message, "\n"), lambda x: F.lower(F.regexp_extract(x, "This reverts commit ([0-9a-fA-F]*)", 1)))
    return F.filter(found, lambda x: F.length(x) == 40)


def is_reportable_key(key: Column) -> Column:
    return key.rlike("^[A-Z]+-[0-9]+$")


def task_key(branch: Column) -> Column:
    """The first ticket in a branch's name, in upper case; else the name."""
    pattern = "(?<![A-Za-z0-9])([A-Za-z]+)[-_]([0-9]+)"
    prefix = F.regexp_extract(branch, pattern, 1)
    return F.when(prefix != "", F.concat(F.upper(prefix), F.lit("-"), F.regexp_extract(branch, pattern, 2))).otherwise(branch)


def natural_task_key(key: Column) -> Column:
    """A struct that sorts PAC-9 before PAC-10; keys of another form come last."""
    raw = F.coalesce(key, F.lit(""))
    number = F.regexp_extract(raw, "^[A-Za-z]+[-_]([0-9]+)", 1).try_cast("bigint")
    prefix = F.when(number.isNotNull(), F.upper(F.regexp_extract(raw, "^([A-Za-z]+)[-_]", 1))).otherwise("")
    return F.struct(number.isNull().alias("other"), prefix.alias("prefix"), F.coalesce(number, F.lit(0)).alias("number"), raw.alias("raw"))


def task_prefix(key: Column) -> Column:
    return F.when(is_reportable_key(key), F.split(key, "-")[0])


def task_number(key: Column) -> Column:
    return F.when(is_reportable_key(key), F.split(key, "-")[1].try_cast("bigint"))


def is_metadata_integration(branch: Column) -> Column:
    return branch.isin(*METADATA_INTEGRATION) | branch.startswith("release/")


def is_bug_issue(labels: Column) -> Column:
    return F.exists(labels, lambda x: F.lower(F.trim(x)).isin(*BUG_LABELS))


def repo_key(origin_url: Column) -> Column:
    """`git:host/path` of a remote's address, host in lower case, without user and `.git`."""
    url = F.regexp_replace(F.regexp_replace(F.trim(origin_url), "/+$", ""), r"(\.git)+$", "")
    scp = F.regexp_replace(F.regexp_replace(url, "^git@", ""), "^([^:]*):/*", "$1/")
    other = F.regexp_replace(F.regexp_replace(url, r"^[^:]*://", ""), "^.*@", "")
    whole = F.when(url.startswith("git@") & F.contains(url, F.lit(":")), scp).when(~url.startswith("git@"), other)
    host, path = F.lower(F.substring_index(whole, "/", 1)), F.trim(F.regexp_replace(whole, "^[^/]*/+", ""))
    return F.when(F.contains(whole, F.lit("/")) & (host != "") & (path != ""), F.concat(F.lit("git:"), host, F.lit("/"), path))


def status_band(value: Column, good: float, watch: float, higher_is_better: bool) -> Column:
    if higher_is_better:
        known = F.when(value >= good, "good").when(value >= watch, "watch").otherwise("risk")
    else:
        known = F.when(value < good, "good").when(value <= watch, "watch").otherwise("risk")
    return F.when(value.isNull(), "n/a").otherwise(known)
