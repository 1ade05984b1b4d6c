"""Records of events, frames and datasets: flattening, coercion, label projections, manifests, flips and clip enumeration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flat_frames(frames: DataFrame, ids: list[str], event: str, event_fields: list[str], other: str, other_field: str, collections: list[str]) -> DataFrame:
    """A flat row a frame: ids, the fields of its game event and of its possession event ('' where there is none), collections as JSON text."""
    inside = [F.coalesce(F.col(event)[f].cast("string"), F.lit("")).alias(f) for f in event_fields]
    texts = [F.coalesce(F.to_json(c), F.lit("[]")).alias(c) for c in collections]
    return frames.select(*ids, *inside, F.coalesce(F.col(other)[other_field].cast("string"), F.lit("")).alias(other_field), *texts)


def with_positions(frames: DataFrame, players: str, team: str | Column, positions: DataFrame) -> DataFrame:
    """``frames`` whose players (struct with jersey) carry the ``position`` of (game, team, jersey), null where it isn't known.

    ``team``: each frame's team, a column or its name; where it is null, no position is known. positions: (game, team,
    jersey, position); a game's are one map, as it has no more players than its squads.
    """
    known = positions.groupBy("game", F.col("team").alias("_team")).agg(F.map_from_entries(F.collect_list(F.struct("jersey", "position"))).alias("_known"))
    named = frames.withColumn("_own", F.col(team) if isinstance(team, str) else team)
    met = named.join(known, (named["game"] == known["game"]) & (F.col("_own") == F.col("_team")), "left").drop(known["game"])
    placed = F.transform(players, lambda p: p.withField("position", F.try_element_at("_known", p["jersey"])))
    return met.withColumn(players, placed).drop("_team", "_known", "_own")


def sided_positions(frames: DataFrame, event: str, home: str, away: str, positions: DataFrame) -> DataFrame:
    """``frames`` with the positions of the side whose team their event (struct with home_team and team_id) names: the home players of home_team, else the away players."""
    at_home = F.coalesce(F.col(event)["home_team"], F.lit(False))
    own = F.col(event)["team_id"]
    return with_positions(with_positions(frames, home, F.when(at_home, own), positions), away, F.when(~at_home, own), positions)


def coerced(rows: DataFrame, integers: list[str], floats: list[str]) -> DataFrame:
    """Integers that are no number become -1, floats 32 bits wide, everything else text: '' for null, True and False for booleans."""

    def cast(name: str, kind: str) -> Column:
        c = F.col(name)
        if name in integers:
            return F.coalesce(F.when(c.cast("string").try_cast("double").between(-(2.0**31), 2.0**31 - 1), c.cast("string").try_cast("double").cast("int")), F.lit(-1))
        if name in floats:
            return c.cast("string").try_cast("float")
        return F.coalesce(F.initcap(c.cast("string")) if kind == "boolean" else c.cast("string"), F.lit(""))

    return rows.select(*[cast(n, k).alias(n) for n, k in rows.dtypes])


def coarse_label(label: Column) -> Column:
    """0 for cards, 1 for substitutions, 2 for goals of the first label version; null is to be skipped."""
    return F.when(label.contains("card"), 0).when(label.contains("subs"), 1).when(label.contains("soccer"), 2)


def clip_labels(events: DataFrame, clips: DataFrame, frame: str, size: int) -> DataFrame:
    """(video, clip, label) of events inside a clip; those behind the last clip (``n_clips`` of clips) go."""
    placed = events.withColumn("clip", F.floor(F.col(frame) / size)).join(clips.select("video", "n_clips"), "video")
    return placed.where(F.col("clip") < F.col("n_clips")).select("video", "clip", "label").distinct()


def clips_with_events(labels: DataFrame, clips: DataFrame) -> DataFrame:
    """(video, clip, n_labels, has_event) of every clip; a video without clips has none."""
    every = clips.where("n_clips > 0").select("video", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_clips") - 1)).alias("clip"))
    counted = labels.groupBy("video", "clip").agg(F.count("*").alias("n_labels"))
    n = F.coalesce("n_labels", F.lit(0)).cast("long")
    return every.join(counted, ["video", "clip"], "left").select("video", "clip", n.alias("n_labels"), (n > 0).alias("has_event"))


def filled_clips(videos: DataFrame, frames: str, length: int, overlap: int, batch: int) -> DataFrame:
    """(video, place, start): clips from frame 1 on, the last one repeated until the batch is full."""
    step = length - overlap
    if step < 1:
        raise ValueError("clips have to be longer than their overlap")
    many = F.greatest(F.lit(1), F.ceil((F.col(frames) - overlap) / step)).cast("long")
    full = (F.ceil(many / batch) * batch).cast("long")
    rows = videos.select("video", many.alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("place"))
    return rows.select("video", "place", (1 + F.least(F.col("place"), F.col("_n") - 1) * step).alias("start"))


def videos_at_stride(videos: DataFrame, stride: int) -> DataFrame:
    """(path, frames, fps) at every ``stride``-th frame."""
    return videos.select("path", F.floor(F.col("frames") / stride).alias("frames"), (F.col("fps") / stride).alias("fps"))


def foreground(events: DataFrame, videos: DataFrame) -> DataFrame:
    """(video, frame) of the events before the end of their video."""
    return events.join(videos.select("video", "frames"), "video").where(F.col("frame") < F.col("frames")).select("video", "frame")


def split_manifests(games: DataFrame, events: DataFrame, kind: str) -> DataFrame:
    """(split, manifest): one JSON document a split that has games, each with its input and, where it has an events file, its annotations.

    A split's document is one output value; its games are in the order of their names.
    """
    known = events.select("game", F.col("path").alias("_events"))
    video = F.struct(F.col("game").alias("id"), F.array(F.struct(F.lit(kind).alias("type"), F.col("path"))).alias("inputs"), F.col("_events").alias("annotations"))  # to_json leaves null fields out
    gathered = games.join(known, "game", "left").groupBy("split").agg(F.array_sort(F.collect_list(video)).alias("videos"))
    return gathered.select("split", F.to_json(F.struct(F.lit(1).alias("version"), F.lit(kind).alias("format"), "videos")).alias("manifest"))


def stamped(header: Column, repository: Column, branch: Column, split: Column) -> Column:
    """A dataset's header (map of texts) with where it came from; blanks around go and what is missing is ''."""
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    mine = F.create_map(F.lit("hf_repo_id"), text(repository), F.lit("hf_branch"), text(branch), F.lit("hf_split"), text(split))
    names = F.array(*map(F.lit, ("hf_repo_id", "hf_branch", "hf_split")))
    return F.map_concat(F.map_filter(header, lambda k, _: ~F.array_contains(names, k)), mine)


def stamp(header: Column) -> Column:
    """Where a dataset's header says that it came from: repository, branch and split without blanks around, null where empty or missing."""
    told = lambda name: F.nullif(F.trim(F.try_element_at(header, F.lit(name))), F.lit(""))
    return F.struct(told("hf_repo_id").alias("repository"), told("hf_branch").alias("branch"), told("hf_split").alias("split"))


def says(message: Column, *alternatives: tuple[str, ...]) -> Column:
    """Whether an error text holds, whatever its case, all words of one of the alternatives."""
    low = F.lower(F.coalesce(message, F.lit("")))
    found = F.lit(False)
    for words in alternatives:
        each = F.lit(True)
        for word in words:
            each = each & low.contains(word.lower())
        found = found | each
    return found


def team_flipped(players: Column) -> Column:
    """Players (struct with home and away flags) with the sides exchanged."""
    return F.transform(players, lambda p: p.withField("home", p["away"]).withField("away", p["home"]))


def prediction_record(half: Column, position_ms: Column, label: Column, confidence: Column) -> Column:
    """A spotting record: clock with two-digit minutes and seconds, label, position and confidence as texts, half as text."""
    seconds = F.floor(position_ms / 1000)
    clock = F.format_string("%s - %02d:%02d", half.cast("string"), F.floor(seconds / 60), seconds % 60)
    return F.struct(clock.alias("gameTime"), label.alias("label"), position_ms.cast("string").alias("position"), half.cast("string").alias("half"), confidence.cast("string").alias("confidence"))


def spotting_record(frame: Column, fps: Column, label: Column, confidence: Column, half: Column | None = None, padded: bool = True) -> Column:
    """A spotting record of a frame: clock, label, position in whole milliseconds and confidence, as numbers; with a half also that, as text.

    The clock is MM:SS, with a half H - MM:SS, or H - M:S if not padded.
    """
    seconds = F.floor(frame / fps)
    clock = F.format_string("%02d:%02d" if padded else "%d:%d", F.floor(seconds / 60), seconds % 60)
    rest = [label.alias("label"), (frame / fps * 1000).cast("long").alias("position"), confidence.cast("double").alias("confidence")]
    if half is None:
        return F.struct(clock.alias("gameTime"), *rest)
    return F.struct(half.cast("string").alias("half"), F.concat(half.cast("string"), F.lit(" - "), clock).alias("gameTime"), *rest)
