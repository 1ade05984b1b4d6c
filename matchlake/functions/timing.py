"""Frame and clock arithmetic, label rules and path texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coarse group of each position code.
POSITION_GROUPS = {
    "GK": "GK", "LCB": "DEF", "RCB": "DEF", "MCB": "DEF", "LB": "DEF", "RB": "DEF", "LWB": "DEF", "RWB": "DEF",
    "CM": "MID", "AM": "MID", "DM": "MID", "LM": "MID", "RM": "MID", "CF": "FWD", "LW": "FWD", "RW": "FWD",
}
#: Priority of a label among several at one position; the greater wins.
LABEL_PRIORITY = {"PASS": 0, "HIGH PASS": 1, "OUT": 2, "CROSS": 3, "SHOT": 4, "HEADER": 5, "PLAYER SUCCESSFUL TACKLE": 6, "THROW IN": 7, "FREE KICK": 8, "GOAL": 9}


def _looked_up(table: dict, key: Column, default) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key), F.lit(default))


def priority_of(label: Column) -> Column:
    """The label's priority, -1 for one that is not listed."""
    return _looked_up(LABEL_PRIORITY, label, -1)


def position_group(code: Column) -> Column:
    """The coarse group of a position code, null for one that is not listed."""
    return _looked_up(POSITION_GROUPS, code, None)


def stride(source: Column, sample: Column) -> Column:
    return F.when(sample <= 0, F.lit(1)).otherwise((source / sample).cast("int"))


def effective_stride(source: Column, target: float) -> Column:
    """At least 1, halves to even; null without a source rate."""
    return F.greatest(F.lit(1), F.bround(source / target).cast("int"))


def frame_count(frames: Column, step: Column) -> Column:
    return F.ceil(frames / step)


def frame_of_ms(position: Column, fps: Column) -> Column:
    """Truncated, and 1 instead of 0."""
    frame = (position / 1000.0 * fps).cast("long")
    return F.when(frame == 0, F.lit(1)).otherwise(frame)


def half_of(clock: Column) -> Column:
    return F.substring(clock, 1, 1).try_cast("int")


def seconds_of(clock: Column) -> Column:
    """Seconds of 'H - MM:SS'."""
    return F.substring(clock, -5, 2).try_cast("long") * 60 + F.substring(clock, -2, 2).try_cast("long")


def clock_of(period: Column, clock: Column) -> Column:
    return F.concat(F.coalesce(period.cast("string"), F.lit("1")), F.lit(" - "), F.coalesce(clock, F.lit("00:00")))


def labels_of(kind: Column, body: Column, height: Column, passing: Column, outcome: Column, winner: Column, game: Column, setpiece: Column) -> Column:
    """The labels of a raw event, none to several."""
    header = body == "HE"
    labels = [
        F.when(kind == "PA", F.when(header, "HEADER").when(height == "A", "HIGH PASS").when(passing == "H", "THROW IN").otherwise("PASS")),
        F.when(kind == "CR", "CROSS"),
        F.when((kind == "SH") & header, "HEADER"), F.when(kind == "SH", "SHOT"), F.when((kind == "SH") & (outcome == "G"), "GOAL"),
        F.when((kind == "CH") & ~F.coalesce(winner.cast("string"), F.lit("")).isin("", "0"), "PLAYER SUCCESSFUL TACKLE"), F.when((kind == "CL") & header, "HEADER"),
        F.when(game == "OUT", "OUT"), F.when(setpiece == "T", "THROW IN"), F.when(setpiece == "F", "FREE KICK"),
    ]
    return F.filter(F.array(*labels), lambda x: x.isNotNull())


def resampled_frames(n: Column, factor: float, total: int) -> Column:
    """Indexes int(i * factor), kept within the video, of so many samples."""
    return F.transform(F.sequence(F.lit(0), F.lit(total - 1)), lambda i: F.least((i * factor).cast("long"), n - 1))


def to_batch(n: Column, batch: int) -> Column:
    """How many are missing to a whole batch."""
    return F.ceil(n / batch) * batch - n


def repository_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", "")


def clean_split(name: Column) -> Column:
    """Without blanks around, slashes in front and '.json'; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.trim(name), "^/+", ""), r"\.json$", ""), F.lit(""))


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)
