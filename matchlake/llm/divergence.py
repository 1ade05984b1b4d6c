"""Source divergence audit: how far the words of each source stray from those of the other sources of its language.

Documents of a (lang, source) group that a task reads together become bags: the terms that occur n times
in d of them, for each n and d, so that a term is a string once for all its occurrences there. d stops at ``min_documents``, beyond
which it decides nothing. A language's vocabulary is what ``CountVectorizer`` keeps of its bags, each given d times, with ``minDF`` and a ``vocabSize``
that it doesn't fill, so nothing is cut off: d copies of a bag stand for d documents. Its model turns each bag into an exact
sparse vector, and n times the vectors of a (lang, source) group are added up entry by entry, where a summary
of dense vectors would hold the whole vocabulary for every group. Small languages share
a fit: their terms carry the language, so one fit over several languages keeps for each what a fit of
its own would (a test holds them together). A fit's
vocabulary goes through the driver, so ``vocabSize`` is what a driver can take; a fit that has more to keep than that is not used,
and its languages are counted by shuffles instead, with the same result. Which fits those are is foreseen from the terms whose hash is a
multiple of 64, so that few are made in vain.

Shares are whole numbers p = 1 + floor(10^9 (count + 1) / (N + V)), and the distance of two
sources sums floor((p - q)^2 / q) over the V terms. Only the terms that a source has are looked
at: with p0 and q0 for terms that are absent, the sum is V f(p0, q0), plus f(p, q0) - f(p0, q0) for the
terms of one side and f(p0, q) - f(p0, q0) for those of the other, for which a histogram of each
side's shares is enough, plus a correction for the terms that both sides have, found by joining on the term.

Defined cases: null text, lang and source are read as ''; documents without a term, and languages
whose terms are all too rare, still give their group, with distance 0 to each other source; repeated
rows count as documents of their own; an empty table gives no row.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import ranked
from .common import per_slice, shared_folder, utf8, written

#: Bytes of text that become bags together; bounds the memory of a worker.
TEXT_OF_BAGS = 8 << 20
BAGS = "lang string, source string, n long, d long, terms array<string>"
#: One of so many terms, by hash, is counted before the fits.
SAMPLED = 64
#: Between a term and its language; no term holds it.
MARK = "\x00"


@dataclass(frozen=True)
class DivergenceRules:
    min_documents: int = 3
    #: Terms that a fit may keep, as they pass through the driver; where it keeps more, the fit is not used.
    fit_terms: int = 250_000
    #: Languages, those with most documents, with a fit of their own; as many more as are fitted at all; and how many of those share a fit.
    own_fits: int = 16
    fit_languages: int = 1_000
    shared_fit: int = 100
    ranks: int = 200


def _counted(most: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Bags of a batch of (lang, source, text): for each group, n and d the terms that occur n times in d of its texts, with d up to ``most``."""
    import numpy as np

    # what a byte is in a term: A-Z as a-z, 0 if it is in none; letters beyond ASCII have bytes from 128 on only
    fold = np.zeros(256, np.uint8)
    fold[97:123] = fold[65:91] = np.arange(97, 123)
    fold[128:] = np.arange(128, 256)

    def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys in order, and how often each occurs."""
        keys.sort()
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[at], np.diff(at, append=len(keys))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, sources = (batch.column(k).dictionary_encode() for k in (0, 1))
        group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        data, texts = utf8(batch.column(2))
        letters = fold[data]
        inside = letters != 0
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = texts[:-1][texts[:-1] < texts[1:]]
        first[heads] = inside[heads]
        text = np.repeat(np.arange(len(group)), np.diff(np.searchsorted(np.flatnonzero(first), texts)))
        letters = letters[inside]
        starts = np.append(np.flatnonzero(first[inside]), len(letters)).astype(np.int32)
        del data, first, inside
        words = pa.Array.from_buffers(pa.string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(letters)]).dictionary_encode()
        del letters, starts
        code, size = words.indices.to_numpy(), max(1, len(words.dictionary))
        pairs, n = runs(group[text] * size + code)
        own, _ = runs(text * size + code)
        # the same pairs: a term that a group has is in a text of it
        _, d = runs(group[own // size] * size + own % size)
        d = np.minimum(d, most)
        group, code = pairs // size, pairs % size
        order = np.lexsort((d, n, group))
        group, n, d = group[order], n[order], d[order]
        at = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (n[1:] != n[:-1]) | (d[1:] != d[:-1])])) if len(order) else np.zeros(0, np.int64)
        terms = pa.ListArray.from_arrays(pa.array(np.append(at, len(order)).astype(np.int32)), words.dictionary.take(pa.array(code[order])))
        lang, source = np.divmod(group[at], len(sources.dictionary) or 1)
        return pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang)), sources.dictionary.take(pa.array(source)), pa.array(n[at]), pa.array(d[at]), terms], ["lang", "source", "n", "d", "terms"])

    return count


def bags(docs: DataFrame, rules: DivergenceRules) -> DataFrame:
    """Bags (lang, source, n, d, terms) of the documents, with A-Z of the terms lower-cased and no other letter changed; a term may be in several of a group."""
    return docs.select("lang", "source", "text").mapInArrow(per_slice(_counted(max(1, rules.min_documents)), 1 << 30, TEXT_OF_BAGS), BAGS)


def fits(docs: DataFrame, rules: DivergenceRules) -> list[list[str]]:
    """Languages to fit: those with most documents on their own, then ever so many smaller ones together. Those beyond, or without documents enough, are in no fit."""
    sizes = docs.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= rules.min_documents).orderBy(F.desc("n"), "lang").limit(rules.fit_languages)
    known = [r["lang"] for r in sizes.collect()]
    rest = known[rules.own_fits :]
    return [[lang] for lang in known[: rules.own_fits]] + [rest[k : k + rules.shared_fit] for k in range(0, len(rest), rules.shared_fit)]


def foreseen(counted: DataFrame, rules: DivergenceRules) -> dict[str, int]:
    """About how many terms each language keeps, from the sampled ones."""
    some = counted.select("lang", "d", F.explode("terms").alias("term")).where(F.pmod(F.xxhash64("term"), F.lit(SAMPLED)) == 0)
    kept = some.groupBy("lang", "term").agg(F.sum("d").alias("d")).where(F.col("d") >= rules.min_documents)
    return {r["lang"]: SAMPLED * r["n"] for r in kept.groupBy("lang").agg(F.count("*").alias("n")).collect()}


def vector_sums(docs: DataFrame, langs: list[str], rules: DivergenceRules, counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame] | None:
    """Sums (lang, source, id, n) of the vectors of one CountVectorizer over some languages, and its vocabulary (lang, id, term); None if that is too large. ``counted`` are the bags, if at hand."""
    found = F.col("terms")
    if len(langs) > 1:
        found = F.transform(found, lambda t: F.concat(t, F.lit(MARK), F.col("lang")))
    named = (bags(docs, rules) if counted is None else counted).where(F.col("lang").isin(langs)).select("lang", "source", "n", "d", found.alias("_terms"))
    # the mark alone stands in documents enough, so that no vocabulary is empty
    marked = docs.sparkSession.range(max(1, rules.min_documents)).select(F.array(F.lit(MARK)).alias("_terms"))
    each = named.select("_terms", F.explode(F.sequence(F.lit(1).cast("long"), "d"))).select("_terms").union(marked)
    model = CountVectorizer(inputCol="_terms", outputCol="_vector", minDF=float(rules.min_documents), vocabSize=min(rules.fit_terms, 2**31 - 3) + 2).fit(each)
    # the vocabulary goes from the model's own file to a table, and never through Python
    place = f"{shared_folder(docs.sparkSession)}/model-{uuid.uuid4().hex}"
    model.save(place)
    saved = docs.sparkSession.read.parquet(f"{place}/data")
    if saved.select(F.size("vocabulary")).first()[0] > rules.fit_terms + 1:
        return None
    kept = saved.select(F.posexplode("vocabulary").alias("id", "word")).select(F.col("id").cast("long"), "word")
    parts = F.split("word", MARK, 2)
    words = kept.where(F.col("word") != MARK).select((F.get(parts, 1) if len(langs) > 1 else F.lit(langs[0])).alias("lang"), "id", parts[0].alias("term"))
    # a bag has a term once, so its vector's values are 1
    entries = model.transform(named).select("lang", "source", "n", F.explode(F.unwrap_udt("_vector")["indices"]).alias("id"))
    # written at once, so that the driver lets go of the vocabulary and the model before the next fit
    return written(entries.groupBy("lang", "source", F.col("id").cast("long").alias("id")).agg(F.sum("n").alias("n"))), written(words)


def shuffled_sums(docs: DataFrame, rules: DivergenceRules, counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The same by shuffles, for vocabularies of any size."""
    each = (bags(docs, rules) if counted is None else counted).select("lang", "source", "n", "d", F.explode("terms").alias("term"))
    sums = written(each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")))
    words = sums.groupBy("lang", "term").agg(F.sum("d").alias("d")).where(F.col("d") >= rules.min_documents)
    words = written(ranked(words.select("lang", "term"), "lang", "term").select("lang", F.col("rank").alias("id"), "term"))
    return written(sums.join(words, ["lang", "term"]).select("lang", "source", "id", "n")), words


def term_sums(docs: DataFrame, rules: DivergenceRules = DivergenceRules()) -> tuple[DataFrame, DataFrame]:
    """Sums (lang, source, id, n): occurrences of each language's kept terms in each of its sources that has them; and the terms (lang, id, term)."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = written(bags(docs, rules))
    sizes = foreseen(counted, rules)
    dealt = fits(docs, rules)
    parts, done = [], []
    for langs in dealt:
        if sum(sizes.get(lang, 0) for lang in langs) <= rules.fit_terms and (found := vector_sums(docs, langs, rules, counted)):
            parts.append(found)
            done += langs
    if len(done) < sum(map(len, dealt)) or len(done) >= rules.fit_languages or not done:
        rest = ~F.col("lang").isin(done)
        parts.append(shuffled_sums(docs.where(rest), rules, counted.where(rest)))
    sums, words = zip(*parts, strict=True)
    return reduce(DataFrame.union, sums), reduce(DataFrame.union, words)


def _share(count: Column) -> Column:
    """p of a count where ``total`` is N and ``v`` is V; null where both are 0. Counts beyond nine digits are multiplied as decimals."""
    n, all_of = (count + 1).cast("long"), F.nullif(F.col("total") + F.col("v"), F.lit(0))
    wide = F.call_function("div", F.lit(10**9).cast("decimal(10,0)") * n.cast("decimal(20,0)"), all_of.cast("decimal(20,0)"))
    return 1 + F.when(n <= 9 * 10**9, F.call_function("div", F.lit(10**9).cast("long") * n, all_of)).otherwise(wide)


def _f(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def divergence(docs: DataFrame, rules: DivergenceRules = DivergenceRules()) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources of the language, and the terms that a source has more than its language.

    Part ``pair``: each other source of the language and the distance to it, all ranks. Part
    ``term``: the first ``ranks`` terms with a share p over the language's q, by floor((p - q)^2 / q).
    The pair part has as many rows as there are ordered pairs of sources in a language.
    """
    group = ["lang", "source"]
    sums, words = term_sums(docs, rules)
    totals = written(sums.groupBy("lang", "id").agg(F.sum("n").alias("in_lang")))
    langs = totals.groupBy("lang").agg(F.sum("in_lang").alias("lang_total"), F.count("*").alias("v"))
    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in group]).distinct()
    groups = named.join(sums.groupBy(*group).agg(F.sum("n").alias("total")), group, "left").join(langs, "lang", "left").fillna(0)
    groups = written(groups.withColumn("p0", _share(F.lit(0))))
    shares = sums.join(totals, ["lang", "id"]).join(groups, group).withColumn("p", _share(F.col("n"))).withColumn("total", F.col("lang_total"))
    shares = written(shares.select(*group, "id", "p", "p0", _share(F.col("in_lang")).alias("q")))

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = groups.where("v > 0").select("lang", "source", "p0", "v").join(other, "lang").where("source <> item").withColumn("f00", _f("p0", "q0"))
    histogram = shares.groupBy(*group, "p").agg(F.count("*").alias("n"))
    exact = lambda c: F.sum(c.cast("decimal(38,0)")).alias("value")
    mine = pairs.join(histogram, group).groupBy(*group, "item").agg(exact(F.col("n") * (_f("p", "q0") - F.col("f00"))))
    theirs = pairs.join(histogram.withColumnRenamed("source", "item"), ["lang", "item"]).groupBy(*group, "item").agg(exact(F.col("n") * (_f("p0", "p") - F.col("f00"))))
    left, right = shares.drop("q"), shares.select("lang", "id", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = left.join(right, ["lang", "id"]).where("source < item")
    forth, back = _f("p", "q") - _f("p", "q0") - _f("p0", "q") + _f("p0", "q0"), _f("q", "p") - _f("q", "p0") - _f("q0", "p") + _f("q0", "p0")
    shared = both.groupBy(*group, "item").agg(F.sum(forth).alias("forth"), F.sum(back).alias("back"))
    shared = shared.select("lang", F.explode(F.array(F.struct("source", "item", F.col("forth").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))).alias("_e")).select("lang", "_e.*")
    none = groups.join(other, "lang").where("source <> item").select(*group, "item", F.when(F.col("v") > 0, F.col("v").cast("decimal(20,0)") * _f("p0", "q0").cast("decimal(18,0)")).otherwise(0).cast("decimal(38,0)").alias("value"))
    summed = none.union(mine).union(theirs).union(shared.select(*group, "item", F.col("value").cast("decimal(38,0)"))).groupBy(*group, "item").agg(F.sum("value").cast("long").alias("value"))
    order = Window.partitionBy(*group).orderBy(F.desc("value"), "item")
    pair = summed.select(*group, F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    above = shares.where("p > q").select(*group, "id", _f("p", "q").alias("value"))
    # ties at the last rank stay until the terms are known
    first = above.withColumn("rank", F.rank().over(Window.partitionBy(*group).orderBy(F.desc("value")))).where(F.col("rank") <= rules.ranks)
    named = first.join(words, ["lang", "id"]).select(*group, F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    return pair.union(named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rules.ranks))


#: The same in SQL, over every pair of sources and every term.
DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
o AS (SELECT k, lang, source, unnest(t) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT k) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, kept.term, kept.n AS in_lang, coalesce(x.n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = kept.term),
s AS (SELECT *, (1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)))::BIGINT AS p,
  (1 + (1000000000::HUGEINT * (in_lang + 1)) // (sum(in_lang) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)))::BIGINT AS q FROM c),
r AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(y.value, 0)::BIGINT AS value FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source
    LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) y ON y.lang = g.lang AND y.source = g.source AND y.item = h.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM s WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r) WHERE part = 'pair' OR rank <= 200
"""
