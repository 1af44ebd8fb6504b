"""WebVTT captions to segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespark.functions.text import decode_entities
from lorespark.operators.walks import walk

STAMP = r"^(\d{2}):(\d{2}):(\d{2})\.(\d{3})\s*-->\s*(\d{2}):(\d{2}):(\d{2})\.(\d{3})"


def parse(files: DataFrame, by: str, content: str) -> DataFrame:
    """(by, start, duration, text): caption lines under the time line before them.

    Header, note and blank lines go, tags are stripped and five entities
    decoded; a text counts once per whole second; an equal text less than half
    a second after the one before extends it.
    """
    lines = files.select(by, F.posexplode(F.split(content, "\n")).alias("at", "line")).withColumn("is_time", F.col("line").rlike(STAMP))
    begin = F.when(F.col("is_time"), F.coalesce(_seconds(1), F.lit(0.0)))
    end = F.when(F.col("is_time"), F.coalesce(_seconds(5), F.lit(0.0)))
    order = Window.partitionBy(by).orderBy("at")
    timed = lines.withColumns({"start": F.last(begin, ignorenulls=True).over(order), "until": F.last(end, ignorenulls=True).over(order)})
    cleaned = F.trim(decode_entities(F.regexp_replace("line", "<[^>]+>", ""), ["&amp;", "&#39;", "&quot;", "&lt;", "&gt;"]))
    skip = F.col("is_time") | (F.trim("line") == "") | F.col("line").rlike("^(?:WEBVTT|Kind:|Language:|NOTE)")
    texts = timed.filter(~skip & F.col("start").isNotNull()).withColumn("text", cleaned).filter("text <> ''")
    once = Window.partitionBy(by, F.floor("start"), "text").orderBy("at")
    kept = texts.withColumn("_n", F.row_number().over(once)).filter("_n = 1")
    timed = kept.select(by, "at", "start", (F.col("until") - F.col("start")).alias("duration"), "text")

    def step(state: tuple, row: tuple) -> tuple:
        """state: number, start and text of the run of equal texts, each less than half a second after the run's start."""
        (run, first, said), (begin, lasts, text) = state, row
        if said == text and begin - first < 0.5:
            return state, (run, first, begin + lasts - first)
        return (run + 1, begin, text), (run + 1, begin, lasts)

    runs = walk(timed, [by], ["at"], ["start", "duration", "text"], lambda: (0, 0.0, None), step, "run int, first double, lasted double")
    return runs.groupBy(by, "run", "text").agg(F.min("first").alias("start"), F.max_by("lasted", "at").alias("duration")).select(by, "start", "duration", "text")


def _seconds(first: int):
    """Seconds of the four groups of a time stamp; null where the line has none."""
    group = lambda i: F.nullif(F.regexp_extract("line", STAMP, first + i), F.lit("")).cast("double")
    return group(0) * 3600 + group(1) * 60 + group(2) + group(3) / 1000
