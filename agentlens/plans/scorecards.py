"""Overall reports as scorecards: a row for each signal with its value and status."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlens.functions import columns as C

# fixed values: (signal, numerator or mean, denominator, unit, first bound, second bound, higher is better)
SESSION = (
    ("Time to first change", "avg_minutes_to_first_change", None, " min", 15, 45, False),
    ("No-output sessions", "no_output_n", "no_output_d", "", 15, 35, False),
    ("Sessions to commit", "commit_n", "commit_d", "", 50, 25, True),
    ("Error pastes", "error_n", "error_d", "", 10, 25, False),
    ("Avg prompts", "avg_prompts", None, "", 4, 7, False),
    ("Debug loops", "loop_n", "loop_d", "", 10, 25, False),
)
DELIVERY = (
    ("Mainline reach", "mainline_n", "mainline_d", "", 75, 50, True),
    ("PR reach", "pr_reach_n", "pr_ready", "", 70, 40, True),
    ("PR merge", "pr_merge_n", "pr_reach_n", "", 75, 50, True),
)
QUALITY = (
    ("Code churn", "churn_n", "churn_d", "", 15, 30, False),
    ("Bug after merge", "bug_n", "bug_d", "", 15, 30, False),
    ("Reverts", "revert_n", "revert_d", "", 2, 5, False),
)


def decimals(c: Column) -> Column:
    return F.format_string("%.2f", c.cast("double"))


def scorecard(report: DataFrame, signals: Sequence[tuple]) -> DataFrame:
    """(place, signal, value, status) of a report of one row."""

    def row(place: int, signal: tuple) -> DataFrame:
        name, number, total, unit, first, second, higher = signal
        measure = F.col(number).cast("double") if total is None else C.percent(F.col(number), F.col(total))
        shown = F.concat(decimals(measure), F.lit(unit)) if total is None else F.concat(decimals(measure), F.lit("% ("), F.col(number).cast("string"), F.lit("/"), F.col(total).cast("string"), F.lit(")"))
        return report.select(F.lit(place).alias("place"), F.lit(name).alias("signal"), F.when(measure.isNotNull(), shown).otherwise("N/A").alias("value"), C.status_band(measure, first, second, higher).alias("status"))

    return reduce(DataFrame.unionByName, [row(n, s) for n, s in enumerate(signals)]).orderBy("place")


def boxed(headers: Sequence[str], rows: Sequence[Sequence[str]]) -> str:
    """A text table of a few rows."""
    widths = [max(len(r[k]) for r in [headers, *rows]) for k in range(len(headers))]
    line = lambda a, b, c: a + b.join("─" * (w + 2) for w in widths) + c
    cells = lambda r: "│" + "│".join(f" {x:<{w}} " for x, w in zip(r, widths)) + "│"
    return "\n".join([line("┌", "┬", "┐"), cells(headers), line("├", "┼", "┤"), *map(cells, rows), line("└", "┴", "┘")])


def scorecard_text(cards: DataFrame) -> str:
    return boxed(("Signal", "Value", "Status"), [(r["signal"], r["value"], r["status"]) for r in cards.orderBy("place").collect()])
