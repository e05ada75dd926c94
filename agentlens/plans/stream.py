"""The event stream: five bases through one envelope, as newline-delimited JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlens.plans import views as V
from agentlens.plans.reports import Events, ReportArgs, filtered

#: stream -> (category under `all`, time column, columns that order rows of one time)
STREAMS = {
    "session-base": ("session", "started_at", ("provider", "session_id")),
    "task-session-base": ("session", "started_at", ("repo_root", "task_key", "provider", "session_id")),
    "change-base": ("delivery", "commit_time", ("repo_root", "commit_sha")),
    "commit-session-base": ("delivery", "commit_time", ("repo_root", "commit_sha", "provider", "session_id")),
    "task-commit-base": ("delivery", "commit_time", ("repo_root", "task_key", "commit_sha")),
}
ENVELOPE = ["stream_type", "category", "event_time", "repo_root", "provider", "model", "task_key", "branch_name", "fields"]


def base(e: Events, stream: str) -> DataFrame:
    return {
        "session-base": lambda: V.session_metrics(e.quality, e.productivity),
        "task-session-base": lambda: V.task_session_metrics(e.task_session),
        "change-base": lambda: V.change_metrics(e.outcome, e.churn, e.bug),
        "commit-session-base": lambda: V.commit_session_metrics(e.commit_session, e.outcome, e.churn, e.bug),
        "task-commit-base": lambda: V.task_commit_metrics(e.task_commit, e.outcome, e.churn, e.bug),
    }[stream]()


def selected(stream: str, category: str) -> list[str]:
    if stream != "all":
        return [stream]
    wanted = {"session": ("session",), "delivery": ("delivery",), "quality": ("delivery",), "all": ("session", "delivery")}[category]
    return [s for s, (kind, _, _) in STREAMS.items() if kind in wanted]


def text_or_null(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def envelope(df: DataFrame, stream: str, category: str) -> DataFrame:
    kind, time, identity = STREAMS[stream]
    fields = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"})
    return df.select(
        F.lit(stream).alias("stream_type"),
        F.lit(kind if category == "all" else category).alias("category"),
        F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("event_time"),
        *[text_or_null(df, n).alias(a) for n, a in (("repo_root", "repo_root"), ("provider", "provider"), ("model_name", "model"), ("task_key", "task_key"), ("branch_name", "branch_name"))],
        fields.alias("fields"),
        F.array(*[F.coalesce(F.col(c), F.lit("")) for c in identity]).alias("_identity"),
    )


def event_stream(e: Events, stream: str = "all", category: str = "all", args: ReportArgs | None = None, limit: int | None = None) -> DataFrame:
    """Envelope rows in order of time. A filter that a stream can't apply leaves the whole stream out."""
    args = args or ReportArgs()
    parts = []
    for name in selected(stream, category):
        df = base(e, name)
        needed = [c for c, v in (("provider", args.provider), ("task_key", args.task), ("model_name", args.model)) if v is not None]
        part = envelope(filtered(df, args, STREAMS[name][1]), name, category)
        parts.append(part if all(c in df.columns for c in needed) else part.filter(F.lit(False)))
    rows = reduce(DataFrame.unionByName, parts).orderBy(F.asc_nulls_last("event_time"), "stream_type", "_identity")
    return (rows if limit is None else rows.limit(limit)).select(*ENVELOPE)


def ndjson(rows: DataFrame) -> DataFrame:
    """One JSON text for each row; `fields` stays an object."""
    flat = F.to_json(F.struct(*ENVELOPE[:-1]), {"ignoreNullFields": "false"})
    return rows.select(F.concat(F.substring(flat, F.lit(1), F.length(flat) - 1), F.lit(',"fields":'), F.col("fields"), F.lit("}")).alias("value"))
