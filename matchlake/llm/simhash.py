"""SimHash near-duplicates through an inverted index on positional bytes, with count filtering.

A fingerprint has eight positional bytes. Two fingerprints that differ in at most two bits
share at least six of them. A posting stands for four bytes at fixed positions: single bytes
would put a share of all fingerprints in one list, however large the corpus. The 14 sets of
positions are those whose numbers cancel out in a bitwise sum, so any three positions lie in
exactly one of them; hence two fingerprints meet in three lists or more if they share six
bytes or more, in one at most if they share fewer. So the tally of the lists that a pair meets
in tells whether it reaches six shared bytes. Pairs with fewer than three go, the rest are
verified by their Hamming distance.

Exact copies are merged before (a fingerprint is one node, whatever its count). Of a list longer
than ``dense`` only those are paired that share two of the other four bytes too: others can't
reach six. Lists so split hold 65,536 fingerprints at most, whatever the corpus.

Null and empty texts have no words and fingerprint zero, linked like any other. Rows with the
same id are nodes of one fingerprint each and keep a row each. A null id stays null and is the
component id only where no row of the component has an id.
"""

from __future__ import annotations

from functools import reduce
from itertools import batched, combinations
from operator import xor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, fresh, per_slice
from .components import components

SEED, SHINGLE, MAX_BITS = 42, 3, 2
#: The positions of each posting's bytes, and in how many lists those meet that share all bytes but one a differing bit.
BYTE_SETS = [p for p in combinations(range(8), 4) if reduce(xor, p) == 0]
MIN_LISTS = min(sum(not set(p) & set(hit) for p in BYTE_SETS) for hit in combinations(range(8), MAX_BITS))
#: Shingles of a text that are turned into bits at a time.
AT_A_TIME = 50_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _fingerprint(text: str | None) -> int:
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:], strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    for some in batched(shingles, AT_A_TIME):
        hashes = np.array([digest(s, SEED) for s in some], np.uint64)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(some)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, *keep: Column) -> DataFrame:
    """doc_id, ``fp``, the 64-bit SimHash as a signed long, and ``keep`` (longs) for each row; no shuffle."""
    rows = docs.select(docs["text"].cast("string"), docs["doc_id"].cast("long"), *keep)
    names = [*rows.columns[1:], "fp"]

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([_fingerprint(t) for t in batch.column(0).to_pylist()], pa.int64())], names=names)

    return rows.mapInArrow(per_slice(hashed), ", ".join(f"{n} long" for n in names))


def _mask(positions: tuple[int, ...]) -> int:
    mask = sum(255 << (56 - 8 * k) for k in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def _pairs(lists: DataFrame, *key: str) -> DataFrame:
    """(which, a, b) for each two fingerprints of a list."""
    other = lists.select(*key, F.col("fp").alias("b"))
    return lists.join(other, list(key)).where(F.col("fp") < F.col("b")).select("which", F.col("fp").alias("a"), "b")


def links(nodes: DataFrame, dense: int = 64) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that are within two bits of each other."""
    keys = F.array(*[F.struct(F.lit(i).alias("which"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("bytes")) for i, p in enumerate(BYTE_SETS)])
    postings = nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.which", "k.bytes")
    sizes = postings.groupBy("which", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut_lineage(postings.join(sizes, ["which", "bytes"]))
    more = [[_mask((*p, *two)) for two in combinations(sorted({*range(8)} - {*p}), 2)] for p in BYTE_SETS]
    masks = F.element_at(F.array(*[F.array(*map(F.lit, m)) for m in more]), F.col("which") + 1)
    split = shared.where(F.col("n") > dense).select("fp", "which", F.explode(masks).alias("mask")).withColumn("bytes", F.col("fp").bitwiseAND(F.col("mask")))
    met = _pairs(shared.where(F.col("n") <= dense), "which", "bytes").unionByName(_pairs(split, "which", "mask", "bytes"))
    tally = met.groupBy("a", "b").agg(F.bit_count(F.bit_or(F.expr("shiftleft(1L, which)"))).alias("lists"))
    return tally.where((F.col("lists") >= MIN_LISTS) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)).select("a", "b")


def _grouped(marked: DataFrame, first: Column) -> DataFrame:
    """(fp, component, first): the component of each fingerprint of ``marked`` and the least ``first`` of its rows."""
    nodes = marked.groupBy("fp").agg(F.min(first).alias("first"))
    found = components(links(nodes))
    return nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of ``docs``."""
    marked = cut_lineage(fingerprints(docs))
    groups = _grouped(marked, F.col("doc_id"))
    least = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    labelled = groups.join(least, "component").select("fp", "component_id")
    return marked.join(labelled, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest id (ids before none, then by a hash of the text).

    Of rows with the same id and text one is kept. Columns stay as they were.
    """
    key, copy = F.xxhash64("doc_id", "text"), fresh(docs, "_copy")
    name = fresh(docs, "_key")
    marked = cut_lineage(fingerprints(docs, key.alias(name)))
    groups = _grouped(marked, F.struct(F.col("doc_id").isNull(), "doc_id", name))
    winners = groups.groupBy("component").agg(F.min("first")[name].alias(name)).select(name)
    kept = docs.withColumn(name, key).join(winners, name, "left_semi")
    numbered = kept.withColumn(copy, F.row_number().over(Window.partitionBy(name).orderBy(name)))
    return numbered.where(F.col(copy) == 1).select(*docs.columns)
