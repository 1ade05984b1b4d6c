"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Tokens are the lower-cased runs of letters, marks and digits. Each mask looks at some tokens
of a short window and ignores the others, so a substituted token under an ignored place does
not break the match. The hash of what a mask sees at each token position of the documents is
joined with those of the benchmark. Around each hit the two token sequences are laid side by
side, and it counts if some ``window`` of consecutive places (or the whole item, if shorter)
agrees in at least ``share`` of them. That tolerates substitutions, also outside the seed.

The masks lose nothing: wherever the substitutions that ``share`` allows lie in an item or
window of ``tolerant`` tokens or more, some mask sees only places that agree (a test goes through
all placings). Shorter items are matched exactly, by a mask of all their tokens.

Entries of the benchmark are its distinct surroundings of a seed; the items that hold one are
looked up for what was found only. If there are at most ``broadcast_rows`` they are broadcast, and
documents are probed where they are read, without a shuffle. Otherwise positions whose seed
the benchmark has (told by its broadcast seeds, up to ``filter_rows``) are shuffled by seed, each
with the ``2 * window - 1`` tokens around it and never with the text; the entries of a seed are dealt to blocks
of ``block_rows``, so a seed that very many items share is spread over tasks.

Defined cases: null and empty texts (no token) hold nothing and are never contaminated; items
without a token never match; an item with a null id counts under null;
repeated items and repeated documents each keep their own verdict, which depends on the text
alone. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SeedRules:
    #: 1: the token counts, 0: it is ignored. With these every placing of 2 substitutions in 8 to 11 tokens, or 3 in 12 or 13, leaves a mask whole.
    masks: tuple[str, ...] = ("11111", "110111", "111101", "11010011", "10001111", "11100101", "10101011")
    window: int = 13
    share: float = 0.75
    #: Items of fewer tokens than this are matched exactly.
    tolerant: int = 8
    broadcast_rows: int = 500_000
    filter_rows: int = 5_000_000
    block_rows: int = 64
    #: Tokens are laid out in stretches of so many, with a window's margin on both sides, so that no row holds a whole text.
    stretch: int = 256


def token_hashes(text: Column) -> Column:
    """The 64-bit hashes of a text's tokens, in order."""
    tokens = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), "")
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _seed(mask: str, at: Column, tokens: Column) -> Column:
    """The hash of what a mask sees at a position; places beyond the end count as no token."""
    return F.xxhash64(F.lit(int(mask, 2)), *[F.get(tokens, at + k) for k, bit in enumerate(mask) if bit == "1"])


def _around(rules: SeedRules, at: Column, tokens: Column) -> Column:
    """The tokens from a window before a position to a window after it; null where there is none."""
    return F.slice(tokens, at - (rules.window - 2), 2 * rules.window - 1)


def _positions(rows: DataFrame, rules: SeedRules, *keep: str) -> DataFrame:
    """``keep``, near and q for each token of ``rows`` (..., h: token hashes): the stretch it lies in and its place there.

    Outer explodes, as for inner ones Catalyst adds a filter that would hash every text twice.
    """
    margin = rules.window - 1
    edge = F.array_repeat(F.lit(None).cast("long"), margin)
    starts = F.when(F.size("h") > 0, F.sequence(F.lit(0), F.size("h") - 1, F.lit(rules.stretch)))
    padded = rows.select(*keep, starts.alias("starts"), F.concat(edge, "h", edge).alias("padded"))
    stretches = padded.select(*keep, F.explode_outer(F.transform("starts", lambda s: F.slice("padded", s + 1, rules.stretch + 2 * margin))).alias("near"))
    return stretches.select(*keep, "near", F.explode_outer(F.sequence(F.lit(margin), F.size("near") - margin - 1)).alias("q"))


def _agreeing(rules: SeedRules, at: Column, tokens: Column, theirs: Column) -> Column:
    """Bits of the places around the hit where both sequences have the same token."""
    bits = F.transform(theirs, lambda t, i: F.when(t == F.get(tokens, at + i - (rules.window - 1)), 1).otherwise(0))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda mask, bit: mask * 2 + bit)


def _entries(benchmark: DataFrame, rules: SeedRules) -> tuple[DataFrame, list[str]]:
    """(seed, entry, n, theirs, item_id) of each mask that lies within an item, and the masks in use."""
    items = benchmark.select("item_id", token_hashes(F.col("text").cast("string")).alias("h")).where(F.size("h") > 0)
    short = [r.n for r in items.where(F.size("h") < rules.tolerant).select(F.size("h").alias("n")).distinct().orderBy("n").collect()]
    each = _positions(items.withColumn("n", F.size("h")), rules, "item_id", "n")
    n, q, near = F.col("n"), F.col("q"), F.col("near")
    ends = lambda m: F.get(near, q + (len(m) - 1)).isNotNull()
    spaced = [F.when((n >= rules.tolerant) & ends(m), _seed(m, q, near)) for m in rules.masks]
    whole = [F.when((n == k) & ends("1" * k) & F.get(near, q - 1).isNull(), _seed("1" * k, q, near)) for k in short]
    seeds = each.select("item_id", "n", _around(rules, q, near).alias("theirs"), F.explode(F.array(*spaced, *whole)).alias("seed")).where(F.col("seed").isNotNull())
    return seeds.withColumn("entry", F.xxhash64("theirs", "n", "seed")), [*rules.masks, *["1" * k for k in short]]


def contaminated(docs: DataFrame, benchmark: DataFrame, rules: SeedRules = SeedRules()) -> DataFrame:
    """(doc_id, text_key, item_ids, best_share): a row for each distinct text of an id that holds a benchmark passage.

    text_key: xxhash64 of the text; with it a verdict finds its rows again, whatever their ids.
    """
    found_in, masks = _entries(benchmark, rules)
    entries = found_in.select("seed", "entry", "n", "theirs").dropDuplicates(["entry"])
    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), token_hashes(F.col("text").cast("string")).alias("h"))
    each = _positions(hashed, rules, "doc_id", "text_key")
    probes = each.select("doc_id", "text_key", "near", "q", F.explode_outer(F.array(*[_seed(m, F.col("q"), F.col("near")) for m in masks])).alias("seed"))
    if entries.limit(rules.broadcast_rows + 1).count() <= rules.broadcast_rows:
        hits = probes.join(F.broadcast(entries), "seed")
        same = _agreeing(rules, F.col("q"), F.col("near"), F.col("theirs"))
    else:
        seeds = entries.select("seed").distinct()
        if seeds.limit(rules.filter_rows + 1).count() <= rules.filter_rows:
            probes = probes.join(F.broadcast(seeds), "seed", "left_semi")
        near = probes.select("doc_id", "text_key", "seed", _around(rules, F.col("q"), F.col("near")).alias("ours"))
        order = F.row_number().over(Window.partitionBy("seed").orderBy("entry"))
        blocked = entries.withColumn("block", F.floor((order - 1) / rules.block_rows).cast("int"))
        blocks = blocked.groupBy("seed").agg(F.max("block").alias("last")).where("last > 0")
        near = near.join(blocks, "seed", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("last", F.lit(0)))))
        hits = near.join(blocked, ["seed", "block"])
        same = _agreeing(rules, F.lit(rules.window - 1), F.col("ours"), F.col("theirs"))
    laid = hits.select("doc_id", "text_key", "entry", "n", same.alias("same"))
    windows = [F.bit_count(F.shiftright("same", k).bitwiseAND(F.lit((1 << rules.window) - 1))) for k in range(rules.window)]
    share = F.greatest(*windows) / F.least("n", F.lit(rules.window))
    least = F.when(F.col("n") < rules.tolerant, 1.0).otherwise(rules.share)
    # Filtered when added up: before, the filter would become a condition of the join and lay the tokens side by side once for each window.
    best = laid.select("doc_id", "text_key", "entry", "n", share.alias("share")).groupBy("doc_id", "text_key", "entry", "n").agg(F.max("share").alias("best")).where(F.col("best") >= least)
    named = best.join(found_in.select("entry", "item_id").distinct(), "entry")
    return named.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("best").alias("best_share"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, rules: SeedRules = SeedRules()) -> DataFrame:
    """The rows of ``docs`` without benchmark passages, their columns as they were."""
    found = contaminated(docs, benchmark, rules).select(F.col("doc_id").alias("_id"), "text_key")
    same = F.xxhash64(docs["text"]) == found["text_key"]
    return docs.join(found, same & docs["doc_id"].eqNullSafe(found["_id"]), "left_anti")


def contamination_report(docs: DataFrame, benchmark: DataFrame, rules: SeedRules = SeedRules()) -> DataFrame:
    """A row for each row of ``docs``: doc_id, contaminated, n_items, item_ids (sorted), best_share (0 if clean)."""
    found = contaminated(docs, benchmark, rules).withColumnRenamed("doc_id", "_id").withColumnRenamed("text_key", "_key")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"))
    joined = rows.join(found, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    ids = F.coalesce("item_ids", F.array().cast("array<bigint>"))
    return joined.select("doc_id", F.col("_key").isNotNull().alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.coalesce("best_share", F.lit(0.0)).alias("best_share"))
