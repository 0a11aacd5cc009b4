"""The review surface over result rows: filter, sort, export, and table cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Columns of the exported table, in order.
CSV_COLUMNS = ["id", "timestamp", "start", "end", "status", "reason", "score", "audio_text", "subtitle_text", "match_source", "char", "token_sort", "partial", "token_set", "window", "length_coverage"]
SORTS = {"time": "timestamp", "speech": "audio_text", "subtitle": "subtitle_text", "score": "score", "status": "status", "reason": "reason"}
METRICS = ("char", "token_sort", "partial", "token_set", "window", "length_coverage")


def haystack() -> Column:
    """What a search looks through: a row's id, time, status, reason, texts and metrics, folded."""
    metrics = [F.col(f"metrics.{k}").cast("string") for k in ("char", "token_sort", "partial", "token_set", "length_coverage", "score", "window", "matched_window_text", "match_source")]
    return T.casefold(F.concat_ws(" ", F.col("id").cast("string"), T.clock(F.col("timestamp")), "status", "reason", "audio_text", "subtitle_text", *metrics))


def review_filter(rows: DataFrame, query: str = "", status: str = "", reason: str = "", low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows that meet all the given conditions."""
    if status:
        rows = rows.where(F.col("status") == status)
    if reason:
        rows = rows.where(F.col("reason") == reason)
    if low is not None:
        rows = rows.where(F.col("score") >= low)
    if high is not None:
        rows = rows.where(F.col("score") <= high)
    if query.strip():
        rows = rows.where(F.contains(haystack(), F.lit(query.strip().casefold())))
    return rows


def review_sort(rows: DataFrame, by: str = "time", ascending: bool = True) -> DataFrame:
    if by not in SORTS:
        raise ValueError(f"unknown sort {by!r}; one of {tuple(SORTS)}")
    c = F.col(SORTS[by])
    return rows.orderBy(c.asc() if ascending else c.desc(), "media_id", "id")


def csv_rows(rows: DataFrame) -> DataFrame:
    """media_id and the 16 exported columns."""
    inner = {"match_source", "char", "token_sort", "partial", "token_set", "window", "length_coverage"}
    return rows.select("media_id", *[F.col(f"metrics.{c}").alias(c) if c in inner else F.col(c) for c in CSV_COLUMNS])


def reasons(rows: DataFrame) -> DataFrame:
    return rows.groupBy("media_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def element(name: str, content: Column, **attributes: Column | str) -> Column:
    """An HTML element; ``content`` is markup already, attributes are escaped."""
    parts = [F.lit(f"<{name}")]
    for key, value in attributes.items():
        value = F.lit(value) if isinstance(value, str) else value
        parts += [F.lit(f' {key.strip("_").replace("_", "-")}="'), T.html_escape(F.coalesce(value.cast("string"), F.lit(""))), F.lit('"')]
    return F.concat(*parts, F.lit(">"), content, F.lit(f"</{name}>"))


def metric_list() -> Column:
    """A definition list of the metrics that are there, after the row's source."""
    pair = lambda name, value: F.concat(element("dt", F.lit(name.replace("_", " "))), element("dd", value))
    given = [F.when(F.col(f"metrics.{k}").isNotNull(), pair(k, T.percent(F.col(f"metrics.{k}")))) for k in METRICS]
    return element("dl", F.concat_ws("", pair("from", T.html_escape(F.col("metrics.match_source"))), *given))


def row_html() -> Column:
    """One item of the report page's list: a seek button, both texts side by side, verdict and metrics."""
    text = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", element("i", F.lit("none"))).otherwise(T.html_escape(F.col(c)))
    seek = element("button", T.clock(F.col("timestamp")), data_seek=F.format_string("%.3f", "timestamp"))
    meter = element("output", F.format_string("%.2f", "score"), _class=T.score_level(F.col("score")))
    verdict = F.concat(element("b", T.html_escape(F.col("status"))), F.lit(" "), T.html_escape(F.replace("reason", F.lit("_"), F.lit(" "))))
    body = F.concat(element("p", F.concat(seek, meter, verdict)), element("blockquote", text("audio_text")), element("blockquote", text("subtitle_text")), metric_list())
    return element("li", body, data_status=F.col("status"), data_reason=F.col("reason"), data_at=F.col("timestamp"), data_score=F.col("score"), data_search=haystack())


def header(summary: DataFrame) -> DataFrame:
    """media_id, ok_count, flagged_count, average as shown on top of a report."""
    return summary.select("media_id", "segment_count", "flagged_count", F.greatest(F.lit(0), F.col("segment_count") - F.col("flagged_count")).alias("ok_count"), T.percent(F.col("avg_score")).alias("average"))
