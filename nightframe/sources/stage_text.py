"""Stage text files to event and hypnogram rows (SRC-07, SRC-08, SRC-11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframe.functions.binding import bind
from nightframe.functions.payload import clock_seconds
from nightframe.functions.stages import lookup

# --- fixed values -----------------------------------------------------------
STAGE_EVENTS = {
    "SLEEP-S0": 0, "SLEEP-S1": 1, "SLEEP-S2": 2, "SLEEP-S3": 3, "SLEEP-S4": 3,
    "SLEEP-REM": 4, "SLEEP-UNSCORED": -1, "SLEEP-MT": -1,
}
ISRUC_STAGES = {0: 0, 1: 1, 2: 2, 3: 3, 5: 4}
CLOCK = r"(\d{1,2})[:.](\d{2})[:.](\d{2})"
HYPNOGRAM_SUFFIXES = ["txt", "tsv", "csv", "cap"]
# --- end of fixed values ----------------------------------------------------


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines of text files; one file is one night, so one row per file
    is small and keeps the line order."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.split("value", r"\r?\n").alias("lines")
    )
    return files.select("file", F.posexplode("lines").alias("line_no", "line"))


def split_tokens(line: Column) -> Column:
    """Split on tab, comma, semicolon or blanks, the first that occurs."""
    def quoted(sep: str) -> Column:
        parts = F.split(line, sep + r'(?=(?:[^"]*"[^"]*")*[^"]*$)')
        return F.transform(parts, lambda p: F.trim(F.regexp_replace(F.trim(p), '^"|"$', "")))

    return (
        F.when(line.contains("\t"), F.transform(F.split(line, "\t"), lambda p: F.trim(p)))
        .when(line.contains(","), quoted(","))
        .when(line.contains(";"), quoted(";"))
        .otherwise(F.split(line, r"\s+"))
    )


def is_number(token: Column) -> Column:
    return token.try_cast("double").isNotNull()


def stage_event(line: Column) -> Column:
    """``(event, clock, duration_sec, stage)`` of a line, null if it has none."""
    names = F.array(*[F.lit(n) for n in STAGE_EVENTS])

    def pick(tokens: Column) -> Column:
        upper = F.transform(tokens, lambda t: F.upper(t))
        event = F.get(F.filter(upper, lambda t: F.array_contains(names, t)), F.lit(0))
        clock = F.get(F.filter(tokens, lambda t: t.rlike(CLOCK)), F.lit(0))
        at = F.array_position(upper, event)
        after = F.filter(tokens, lambda t, i: (i + 1 > at) & is_number(t))
        duration = F.get(after, F.lit(0)).try_cast("double")
        ok = (F.size(tokens) >= 3) & event.isNotNull() & clock.isNotNull() & duration.isNotNull()
        return F.when(
            ok,
            F.struct(
                event.alias("event"),
                F.regexp_extract(clock, CLOCK, 0).alias("clock"),
                duration.alias("duration_sec"),
                lookup(event, STAGE_EVENTS).alias("stage"),
            ),
        )

    return bind(split_tokens(F.trim(line)), pick)


def parse_stage_events(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stage events of numbered text lines (SRC-07)."""
    return (
        lines.withColumn("_e", stage_event(F.col("line")))
        .filter(F.col("_e").isNotNull())
        .select(*keys, "line_no", "_e.*", clock_seconds(F.col("_e.clock")).alias("clock_sec"))
    )


def read_stage_events(spark: SparkSession, path: str) -> DataFrame:
    return parse_stage_events(read_lines(spark, path), ["file"])


def isruc_files(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per file: non-blank lines, those that are one number, and ``format``.

    ``stages``: every line is one number; ``mixed``: some are, which is an error
    to report; ``other``: none is.
    """
    line = F.trim("line")
    lone = ~line.rlike(r"\s") & is_number(line)
    counts = lines.filter(line != "").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(lone).alias("stage_lines")
    )
    kind = F.when(F.col("stage_lines") == F.col("lines"), "stages").when(F.col("stage_lines") > 0, "mixed").otherwise("other")
    return counts.withColumn("format", kind)


def parse_isruc(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One stage number per line to epochs (SRC-08).

    A file qualifies when each of its non-blank lines is a single number;
    :func:`isruc_files` reports the others. Unknown codes become -1 with a warning.
    """
    keys = list(keys)
    rows = lines.filter(F.trim("line") != "")
    whole = isruc_files(lines, keys).filter("format = 'stages'").select(*keys)
    code = F.trim("line").try_cast("double").cast("int")
    stage = F.coalesce(lookup(code, ISRUC_STAGES), F.lit(-1))
    return rows.join(whole, keys, "left_semi").select(
        *keys, "line_no", stage.alias("stage"), (~code.isin(*ISRUC_STAGES)).alias("unknown_code")
    )


def pair_hypnograms(files: DataFrame, preferred: int = 1) -> DataFrame:
    """The stage file of each signal file by priority (SRC-11).

    ``files`` has ``dir, name``. A ``.rec`` file prefers its scorer's text file,
    then the other scorer's; any file may use the same stem with a text suffix.
    """
    parts = files.withColumns(
        {
            "_stem": F.regexp_replace("name", r"\.[^.]*$", ""),
            "_ext": F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)),
        }
    )
    signals = parts.filter(F.col("_ext").isin("rec", "edf"))
    scorers = [preferred, 2 if preferred == 1 else 1]
    candidates = [
        *[F.when(F.col("_ext") == "rec", F.concat("_stem", F.lit(f"_{s}.txt"))) for s in scorers],
        *[F.concat("_stem", F.lit(f".{x}")) for x in HYPNOGRAM_SUFFIXES],
    ]
    wanted = signals.select("dir", "name", F.posexplode(F.array(*candidates)).alias("priority", "candidate"))
    have = files.select("dir", F.col("name").alias("candidate")).distinct()
    best = wanted.join(have, ["dir", "candidate"]).groupBy("dir", "name").agg(
        F.min_by("candidate", "priority").alias("hypnogram")
    )
    return signals.select("dir", "name").join(best, ["dir", "name"], "left")
