"""Divergence of sources, WARC archives and whitening against brute force, and on odd rows."""

import collections
import gzip
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matchlake.llm import divergence, warc, whitening

SF = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# 11. source divergence


def brute_divergence(rows, ranks=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        within = collections.Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in within.items() if n >= 3)
        counts = {s: collections.Counter(t for d in own if d[1] == s for t in d[2] if within[t] >= 3) for s in {d[1] for d in own}}
        whole = sum(counts.values(), collections.Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in counts:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in counts if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found, 1) if part == "pair" or k <= ranks]
    return sorted(out)


ODD = [
    (1, "en", "a", "Über ÜBER over it it it"), (2, "en", "b", "über over it x1y"), (3, "en", "a", "over und it ÄB äb"), (4, "en", None, None), (5, "en", "c", ""), (6, None, "a", "one two"), (7, None, None, "one"),
    (8, "fr", "a", "seul"), (9, "fr", "b", "123 !?"), (10, "en", "b", "it 😀 中文 it\x00it"), (10, "en", "b", "it 😀 中文 it\x00it"), (None, "en", "d", "😀 中文 " + "word over " * 4000), (11, "xx", "a", "q " * 50), (12, "xx", "b", "q r"), (13, "xx", "b", "q r"), (14, "xx", "b", "R"),
]


def divergent(spark, rows=ODD):
    """With columns of clashing names."""
    return spark.createDataFrame([(*r, "t", 1, 2.0) for r in rows], "doc_id long, lang string, source string, text string, term string, n int, p double")


@pytest.mark.parametrize("rules", [divergence.DivergenceRules(), divergence.DivergenceRules(fit_terms=0), divergence.DivergenceRules(fit_terms=4), divergence.DivergenceRules(own_fits=1, shared_fit=3), divergence.DivergenceRules(fit_languages=1), divergence.DivergenceRules(ranks=2)])
def test_divergence_odd_rows(spark, rules):
    """In one fit, by shuffles alone, and with languages dealt to fits and shuffles."""
    docs = divergent(spark)
    assert sorted(map(tuple, divergence.divergence(docs, rules).collect())) == brute_divergence([r[1:] for r in ODD], rules.ranks)


def test_divergence_whole_table(spark):
    docs = table(spark, "documents")
    want = brute_divergence([(r.lang, r.source, r.text) for r in docs.collect()])
    assert sorted(map(tuple, divergence.divergence(docs).collect())) == want and len(want) > 1000
    assert divergence.divergence(docs.where("false")).count() == 0


def test_divergence_fits(spark):
    """One fit over several languages gives what a fit of each language gives, and what shuffles give."""
    docs = table(spark, "documents").select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    rules = divergence.DivergenceRules()
    langs = [lang for one in divergence.fits(docs, rules) for lang in one]
    assert len(langs) == docs.select("lang").distinct().count() == 4
    assert [len(one) for one in divergence.fits(docs, divergence.DivergenceRules(own_fits=1, shared_fit=2, fit_languages=4))] == [1, 2, 1]
    rows = lambda found: sorted(map(tuple, found[0].join(found[1], ["lang", "id"]).select("lang", "source", "term", "n").collect()))
    together = rows(divergence.vector_sums(docs, langs, rules))
    assert together == sorted(r for lang in langs for r in rows(divergence.vector_sums(docs, [lang], rules))) == rows(divergence.shuffled_sums(docs, rules))
    kept = len({r[:1] + r[2:3] for r in together if r[0] == "en"})
    assert divergence.vector_sums(docs, ["en"], divergence.DivergenceRules(fit_terms=kept)) is not None
    assert divergence.vector_sums(docs, ["en"], divergence.DivergenceRules(fit_terms=kept - 1)) is None


def fitted(monkeypatch):
    """Strings that each fit reads, from now on."""
    read = []

    class Counting(divergence.CountVectorizer):
        def fit(self, dataset, params=None):
            read.append(dataset.agg(F.sum(F.size(self.getInputCol()))).first()[0])
            return super().fit(dataset, params)

    monkeypatch.setattr(divergence, "CountVectorizer", Counting)
    return read


def test_divergence_fit_reads_terms_not_occurrences(spark, monkeypatch):
    """A term is one string for all its occurrences in a task's texts of a group, at most one more for each document up to three."""
    rows = [(k, "en", "ab"[k % 2], "lorem ipsum dolor sit amet " * 50 + f"once{'abcdefghij'[k % 10]}") for k in range(100)]
    docs, read = divergent(spark, rows).coalesce(1), fitted(monkeypatch)
    assert sorted(map(tuple, divergence.divergence(docs).collect())) == brute_divergence([r[1:] for r in rows])
    assert len(read) == 1 and read[0] <= 3 * 2 * 15 + 3


def test_divergence_no_fit_in_vain(spark, monkeypatch):
    """Languages with more terms than a fit may keep are counted by shuffles at once."""
    word = lambda k: "".join(chr(97 + k // 26**i % 26) for i in range(4))
    rows = [(k, "en", "ab"[k % 2], " ".join(map(word, range(4000)))) for k in range(3)] + [(9 + k, "fr", "a", "un deux") for k in range(3)]
    docs, read = divergent(spark, rows), fitted(monkeypatch)
    found = sorted(map(tuple, divergence.divergence(docs, divergence.DivergenceRules(fit_terms=2000)).collect()))
    assert found == brute_divergence([r[1:] for r in rows]) and len(read) == 1 and read[0] < 100


@pytest.mark.parametrize("size", [1, 40, 8 << 20])
@pytest.mark.parametrize("rules", [divergence.DivergenceRules(), divergence.DivergenceRules(fit_terms=0)])
def test_divergence_slices(spark, monkeypatch, size, rules):
    """However texts are dealt to bags, each term is counted in each of its documents once."""
    monkeypatch.setattr(divergence, "TEXT_OF_BAGS", size)
    docs = divergent(spark).coalesce(1)
    assert sorted(map(tuple, divergence.divergence(docs, rules).collect())) == brute_divergence([r[1:] for r in ODD])
    held = divergence.bags(docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]), rules).collect()
    want = collections.Counter(t for _, lang, source, text in ODD for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
    got = collections.Counter()
    for r in held:
        assert 1 <= r.d <= min(3, r.n) and len(set(r.terms)) == len(r.terms)
        got.update(dict.fromkeys(r.terms, r.n))
    assert got == want


# 12. WARC

PAGES = [(1, "http://a/ b\r\nX: y", "x" * 99), (2, None, "x" * 99), (3, "http://c", "y" * 100), (5, "http://e/ü", "y" * 100), (4, "http://d", "y" * 100), (4, "http://d2", "y" * 100), (6, "", None), (7, "u", ""), (None, "n", "y" * 100), (None, "n", "z" * 200), (8, "big", "\r\n\r\nä😀" * 300_000), (8, "big", "\r\n\r\nä😀" * 300_000)]


def brute_warc(rows):
    import hashlib

    kept = {}
    for page, _, html in rows:
        if page is not None and len((html or "").encode()) >= 100:
            kept[html] = min(page, kept.get(html, page))
    out = []
    for page, _, html in rows:
        raw, first = (html or "").encode(), kept.get(html)
        again = first is not None and first != page
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def read_back(records):
    return sorted(map(tuple, records.select(warc.page_of("record_id"), "payload_bytes", "payload_digest", "kind", warc.page_of("refers_to")).collect()), key=str)


def test_warc_odd_rows(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "d", 1) for p in PAGES], "page_id long, url string, html string, digest string, kept int").repartition(3)
    rules = warc.WarcRules(archive_bytes=600, span=500)
    index = warc.write_archives(pages, str(tmp_path / "a"), rules)
    records = warc.read_records(index, rules=rules)
    assert read_back(records) == brute_warc(PAGES) == read_back(warc.read_records(index, payloads=False))
    texts = sorted(((warc_id, p.decode()) for warc_id, p in warc.resolved(records).select(warc.page_of("record_id"), "payload").collect()), key=str)
    assert texts == sorted(((p, h or "") for p, _, h in PAGES), key=str)
    assert index.select("archive").distinct().count() > 3
    assert warc.read_records(warc.write_archives(pages.where("false"), str(tmp_path / "none"))).count() == 0


def test_warc_index_from_archives(spark, tmp_path):
    """Archives that are scanned give the index that was written; so do archives without compression, by their own offsets."""
    folder = tmp_path / "a"
    index = warc.write_archives(table(spark, "pages"), str(folder))
    rows = lambda df: sorted((re.sub("^file:/+", "/", r[0]), *r[1:]) for r in df.collect())
    scanned = warc.index_archives(spark, str(folder))
    assert rows(index) == rows(scanned)
    (tmp_path / "b").mkdir()
    for path in folder.glob("*.warc.gz"):
        (tmp_path / "b" / path.name[:-3]).write_bytes(gzip.decompress(path.read_bytes()))
    plain = warc.index_archives(spark, str(tmp_path / "b"))
    assert read_back(warc.read_records(plain)) == read_back(warc.read_records(index)) == brute_warc([tuple(r) for r in table(spark, "pages").collect()])


def test_warc_reads_what_is_selected(spark, tmp_path):
    """Ranges that lie close are read at once, others not; a broken payload is found; files of failed attempts go."""
    index = warc.write_archives(table(spark, "pages").coalesce(1), str(tmp_path / "a"))
    chosen = index.where(warc.page_of("record_id") % 10 == 0)
    assert warc.read_records(chosen, rules=warc.WarcRules(gap=0)).count() == warc.read_records(chosen).count() == chosen.count() == 5
    (tmp_path / "a" / "pages-dead.warc.gz").write_bytes(b"half a reco")
    assert warc.drop_unlisted(index, str(tmp_path / "a")) == 1 and warc.drop_unlisted(index, str(tmp_path / "a")) == 0
    path, offset, length = index.select("archive", "offset", "length").first()
    raw = open(path, "rb").read()
    record = zlib.decompress(raw[offset : offset + length], 31)
    broken = gzip.compress(record[:-10] + bytes([record[-10] ^ 1]) + record[-9:])
    (tmp_path / "b.warc.gz").write_bytes(broken)
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_records(warc.index_archives(spark, str(tmp_path / "b.warc.gz"))).count()


# 13. whitening


def brute_whitening(rows):
    sound = [(i, [float(c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = {i: [math.floor(64 * c) + 10**6 for c in v] for i, v in sound}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, sums = len(fit), fit.sum(axis=0)
    y = (fit * n - sums) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return n, sums, values[::-1], vectors[:, ::-1], x


def check_whitening(rows, got):
    n, sums, values, vectors, x = brute_whitening(rows)
    found = collections.defaultdict(dict)
    for r in got:
        found[r["vec_id"]][r["component"]] = r
    k = min(16, int((values > 1e-9 * values[0]).sum()))
    assert set(found) == set(x) and all(set(v) == set(range(1, k + 1)) for v in found.values())
    for i, v in x.items():
        gap = np.array([n * a - int(s) for a, s in zip(v, sums)])
        for j, r in found[i].items():
            assert r["n"] == n and r["deviation"] == int((gap * gap).sum()) and r["identity_error"] < 1e-9
            assert abs(r["explained"] - values[j - 1] / values.sum()) < 1e-9
    for j in range(1, k + 1):
        one = np.array([found[i][j]["whitened"] for i in sorted(x)])
        want = np.array([((np.array(x[i]) * n - sums) / n) @ vectors[:, j - 1] / np.sqrt(values[j - 1]) for i in sorted(x)])
        assert min(np.abs(one - want).max(), np.abs(one + want).max()) < 1e-6 * max(1, np.abs(want).max())


def test_whitening_whole_table(spark):
    vectors = table(spark, "embeddings")
    check_whitening([(r.vec_id, r.embedding) for r in vectors.collect()], whitening.whitened(vectors, whitening.WhitenRules(partition_rows=10, fan_in=3)).collect())


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (3, None), (4, []), (5, [1.0, None, 2.0]), (6, [nan, 1.0, 1.0]), (7, [inf, 1.0, 1.0]), (8, [-1.0, 0.5, 7.25]), (9, [0.0, -0.001, 2.0]), (10, [2.0, 2.0, -2.0])]
    odd = spark.createDataFrame([(i, v, 3, [1]) for i, v in rows] + [(11, [1.0, 2.0], 1, None)], "vec_id long, embedding array<float>, x int, part array<int>")
    check_whitening(rows, whitening.whitened(odd).collect())
    for few in ("vec_id < 8", "vec_id = 11", "false"):
        assert whitening.whitened(odd.where(few)).count() == 0
    assert whitening.whitened(odd).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("d", [1, 2, 3, 17])
def test_rank_one_updates(d):
    """Spectra by rank-one updates, and combined, against an eigendecomposition of all vectors, with repeated and zero eigenvalues."""
    rng = np.random.default_rng(d)
    x = rng.integers(-3, 4, (200, d)).astype(float)
    x[:, d // 2 :] *= rng.integers(0, 2)
    x[50:60] = x[49]
    parts = [whitening.Spectrum.empty(d) for _ in range(3)]
    for k, row in enumerate(x):
        parts[k * 3 // 250].add(row)
    for other in parts[1:]:
        parts[0].absorb(other)
    whole = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    got = parts[0]
    assert got.n == 200 and np.allclose(got.mean, x.mean(axis=0))
    assert np.allclose(got.values, np.linalg.eigvalsh(whole), atol=1e-10 * max(1, whole.max()))
    assert np.allclose(got.vectors @ np.diag(got.values) @ got.vectors.T, whole, atol=1e-9 * max(1, whole.max())) and np.allclose(got.vectors.T @ got.vectors, np.eye(d))


def test_secular_roots():
    rng = np.random.default_rng(1)
    for k in (1, 2, 9, 60):
        d = np.sort(rng.random(k) * 10.0 ** rng.integers(-6, 6)) + np.arange(k) * 1e-9
        z = rng.normal(size=k) * 10.0 ** rng.integers(-5, 3, k)
        roots, gaps = whitening.secular_roots(d, z)
        want = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
        assert np.allclose(roots, want, rtol=1e-9, atol=1e-11 * abs(want).max()) and (np.diff(roots) > 0).all()


def test_incremental_spectrum_is_the_basis(spark):
    """Before the refinement, combined spectra already have the eigenvalues of all vectors."""
    rows = spark.createDataFrame([(list(map(int, v)),) for v in np.random.default_rng(3).integers(0, 90, (300, 7))], "x array<long>")
    fitted = whitening.fit_whitening(rows, whitening.WhitenRules(partition_rows=5, fan_in=2, components=7))
    assert np.allclose(fitted.incremental[::-1], fitted.values, rtol=1e-10)
    assert isinstance(rows.select(whitening.whole_numbers(F.col("x"))).first()[0], list) and pa is not None


def test_sentencepiece_looks_words_up_whole(monkeypatch):
    """A word met before isn't taken apart again; words that lie across the borders of the parts a text is read in stay whole, and small memos turn over."""
    import sentencepiece

    from matchlake.llm import sentencepiece_viterbi as S

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, mine = sentencepiece.SentencePieceProcessor(model_file=path), S.Pieces(path)
    asked, inner = [], mine.stretches
    mine.stretches = lambda word: asked.append(word) or inner(word)
    text = "don't say x=f(y); twice,  ok\nthen"
    assert list(mine.encode(text)) == list(mine.encode(text)) == library.encode(text)
    assert "".join(asked) == "▁" + text.replace(" ", "▁")
    for name, size in (("WORDS_CHARS", 5), ("MEMO", 20), ("MIXED", 10)):
        monkeypatch.setattr(S, name, size)
    small, rng = S.Pieces(path), random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("   aeiouthnsrldéñ中\n.,#01▁") for _ in range(rng.randint(1, 60))) + rng.choice(["", " " * 17, "a" * 60, "the, end."])
        assert list(small.encode(text)) == library.encode(text), text
    assert small.older and small.older_mixed and len(small.memo) <= 21 and len(small.mixed) <= 11
