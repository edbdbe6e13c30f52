"""Runtime logs: lines parsed into events, and slices around what matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

_LEVEL = r"(V|D|I|W|E|F|DEBUG|INFO|WARN|WARNING|ERROR|FATAL|EXCEPTION)"
_STAMP = r"(\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?)"
_REST = r"\s+([^:]+):\s*(.*)$"
#: Forms of lines, tried in this order: pattern, and the groups of timestamp, process, level, logger and message (0: none).
FORMS = (
    (rf"^{_STAMP}\s+([\w.$:-]+)\s+{_LEVEL}{_REST}", (1, 2, 3, 4, 5)),
    (rf"^(\S+)\s+(?:(?:pid|tid)=\S+\s+)*([\w.$:-]+)\s+{_LEVEL}{_REST}", (1, 2, 3, 4, 5)),
    (rf"^{_STAMP}\s+{_LEVEL}{_REST}", (1, 0, 2, 3, 4)),
)
#: What the letters and words of levels mean. Fixed values.
LEVELS = {"V": "verbose", "D": "debug", "I": "info", "W": "warning", "WARNING": "warning", "E": "error", "F": "fatal", "DEBUG": "debug", "INFO": "info", "WARN": "warning", "ERROR": "error", "FATAL": "fatal", "EXCEPTION": "exception"}


def parsed(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines with timestamp, process, level, logger, message, fields and kind; the first form that fits tells.

    A line of no form has the word before its first colon as logger and what follows as message.
    """
    text = F.col(line)
    fits = [text.rlike(p) for p, _ in FORMS]

    def group(k: int) -> Column:
        out = None
        for fit, (pattern, groups) in reversed(list(zip(fits, FORMS, strict=True))):
            value = F.regexp_extract(text, pattern, groups[k]) if groups[k] else F.lit("")
            out = F.when(fit, value) if out is None else F.when(fit, value).otherwise(out)
        return out

    before, after = F.regexp_extract(text, r"^([^:]*):", 1), F.regexp_replace(text, r"^[^:]*:", "")
    level = group(2)
    named = F.coalesce(F.create_map(*(F.lit(x) for kv in LEVELS.items() for x in kv))[F.upper(level)], F.lower(level), F.lit(""))
    told = lines.withColumns({
        "timestamp": F.coalesce(group(0), F.lit("")), "process": F.coalesce(group(1), F.lit("")), "level": named,
        "logger": F.coalesce(F.trim(group(3)), F.regexp_extract(before, r"(\S*)\s*$", 1)), "message": F.trim(F.coalesce(group(4), after)), "fields": T.key_values(text),
    })
    return told.withColumn("kind", T.event_type(F.col("message"), F.col("fields")))


#: Severity of levels as numbers. Fixed values.
SEVERITY = {"verbose": 1, "debug": 5, "info": 9, "warning": 13, "error": 17, "exception": 17, "fatal": 21}


def severity(level: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))[level], F.lit(0))


def match_band(template: Column, said: Column) -> Column:
    """How a request (canonical) names the event of a message template: by all of it, by a telling part, or not."""
    whole = T.canonical(template)
    words = F.size(F.filter(F.split(whole, " "), lambda w: F.length(w) > 0))
    exact = ~template.rlike(T.PLACEHOLDER) & (((words >= 3) & (F.length(whole) >= 12)) | (F.length(F.replace(whole, F.lit(" "), F.lit(""))) >= 14)) & T.phrase_in(whole, said)
    telling = lambda x: (F.size(F.filter(F.split(x, " "), lambda w: F.length(w) > 2)) >= 3) & (F.length(F.replace(x, F.lit(" "), F.lit(""))) >= 14) & T.phrase_in(x, said)
    return F.when(exact, "exact_template").when(F.exists(T.literal_segments(template), telling), "distinctive_literal").otherwise("none")


def wrapped(calls: DataFrame, sinks: DataFrame, depth: int, most: int) -> DataFrame:
    """(caller, sink, depth): which callers reach a log statement's function, through at most so many calls; of a caller the
    nearest sinks. calls: source, target; sinks: sink. Each layer is written."""
    from functools import reduce

    from .graph import written
    from .tables import top_per_group

    step = calls.select("source", "target").distinct()
    front = written(step.join(sinks.withColumnRenamed("sink", "target"), "target", "left_semi").select(F.col("source").alias("caller"), F.col("target").alias("sink"), F.lit(1).alias("depth")))
    found = [front]
    for d in range(2, depth + 1):
        grown = step.withColumnRenamed("target", "caller").join(front.select("caller", "sink"), "caller").select(F.col("source").alias("caller"), "sink").where("caller <> sink").distinct()
        front = written(grown.withColumn("depth", F.lit(d)))
        found.append(front)
    least = reduce(DataFrame.union, found).groupBy("caller", "sink").agg(F.min("depth").alias("depth"))
    return top_per_group(least, ["caller"], [F.col("depth"), F.col("sink")], most)
