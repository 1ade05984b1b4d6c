"""The training-data operators against brute force, exact round trips and held-out accuracy, and on odd rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
import zstandard

from matchlake.llm import chat_format, components, decontaminate, html_extract, importance, language_id, quality_rules, sentencepiece_viterbi, simhash, token_counts, toxicity
from matchlake.llm import queries as Q
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, ids string, component_id string, decision string, _key string, spans int"
ODD = [None, "", " \n\t ", "a", "###", "x " * 3000, "z" * 20_000, "Ünïcödé 中文 😀 ▁ \x00 end", "one two three", "one two three"]


def odd_docs(spark):
    rows = [(k, t, None, None, "d", "k", 1) for k, t in enumerate(ODD)] + [(3, "a", None, None, "d", "k", 1), (None, "null id here", None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def docs(spark, n=10_000):
    return spark.read.parquet(f"{SF}/documents.parquet")


def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


# 1. compression bands


def brute_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = collections.Counter(windows)
    inside = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), failed


def brute_bands(text):
    rules, size = quality_rules.CompressionRules(), lambda x: len(zstandard.ZstdCompressor(level=3).compress(x))
    raw = (text or "").encode()
    low, high = [(a, b) for start, a, b in rules.bands if start <= len(raw)][-1]
    starts = sorted({*range(0, len(raw) - 2048, 2048), len(raw) - 2048}) if len(raw) >= 2048 else []
    wrong = [k for k in starts if not rules.chunk_low <= 2048 / size(raw[k : k + 2048]) <= rules.chunk_high]
    return low <= len(raw) / size(raw) <= high and len(wrong) <= rules.chunk_share * len(starts)


def test_quality_bands_decide(spark):
    """Of documents that the base rules pass, bands reject most of the poor ones from 1024 bytes on and next to no good one."""
    at = "/root/testdata/sf0.01"
    got = quality_rules.compression_rules(spark.read.parquet(f"{at}/documents.parquet")).where("not base_failed")
    rows = got.join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").select("quality", "kept", "n_bytes").collect()
    good, poor = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0 and r.n_bytes >= 1024]
    assert sum(good) >= 0.99 * len(good) and sum(poor) <= 0.25 * len(poor) and len(poor) >= 10
    fitted = quality_rules.fit_bands(spark.read.parquet(f"{at}/documents.parquet").join(spark.read.parquet(f"{at}/labels.parquet").where("quality = 1"), "doc_id", "left_semi"))
    assert all(abs(a[2] - b[2]) < 0.3 for a, b in zip(fitted.bands, quality_rules.CompressionRules().bands, strict=True))
    assert quality_rules.fit_bands(got.select("doc_id", F.lit(None).cast("string").alias("text"))) == quality_rules.CompressionRules()


def test_quality_rules(spark):
    got = quality_rules.compression_rules(docs(spark)).collect()
    texts = {r.doc_id: r.text for r in docs(spark).collect()}
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_rules(texts[r.doc_id])
        assert r.kept == (not r.base_failed and brute_bands(texts[r.doc_id]))
    random.seed(3)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ+/"
    junk = " ".join("".join(random.choice(letters) for _ in range(40)) for _ in range(60))
    again = " ".join(f"word{k % 7} other{k % 11}" for k in range(2000))
    rows = spark.createDataFrame([(1, junk), (2, again), (3, texts[min(texts)])], "doc_id long, text string")
    found = {r.doc_id: r for r in quality_rules.compression_rules(rows).collect()}
    assert not found[1].kept and not found[2].kept
    compress = zstandard.ZstdCompressor(level=3).compress
    assert found[1].whole_ratio == pytest.approx(len(junk) / len(compress(junk.encode())))


def test_quality_of_tails_and_short_texts(spark):
    random.seed(4)
    junk = lambda n: " ".join("".join(random.choice("abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ+/") for _ in range(12)) for _ in range(n // 13 + 1))[:n]
    prose = max((r.text for r in docs(spark).collect() if r.text and r.text.isascii()), key=len)
    words = prose.split()
    texts = [" ".join(random.sample(words, len(words)))[:2048].ljust(2048, "x") + " " + junk(2047), junk(140), junk(190), junk(250), prose[:140], prose[:250]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in quality_rules.compression_rules(rows).collect()}
    assert [found[k].kept for k in range(6)] == [False, False, False, False, True, True]
    assert (found[0].n_chunks, found[0].n_bad_chunks, found[0].base_failed) == (2, 1, False)
    cut = quality_rules._measure("a" * 2049, quality_rules.CompressionRules(), zstandard.ZstdCompressor(level=3).compress)
    assert cut[-2] == 2


# 2. reply trees


def test_chat_matches_sql_form(spark):
    rows = Q.op2_chat_format(spark, SF).collect()
    seven = next(r for r in rows if r.conv_id == -7)
    said = "\\### Assistant: </turn> ok"
    assert seven.n_turns == 2 and seven.loss_chars == len(said)
    assert seven.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert seven.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_reply_paths_against_brute_force(spark):
    random.seed(5)
    nodes = [(c, k, None if k == 0 else random.randrange(k), random.choice(["user", "assistant"]), f"t{c}.{k} ## \\ </turn>", float(random.randint(0, 3))) for c in range(4) for k in range(25)]
    nodes += [(9, 1, 2, "user", "cycle", 1.0), (9, 2, 1, "user", "cycle", 1.0), (None, 1, None, None, None, None), (8, 1, 77, "user", "orphan", 1.0), (7, None, None, "user", "x", 1.0)]
    tree = spark.createDataFrame(nodes, "conv long, node long, parent long, role string, text string, score double")
    by = {(c, k): (p, r, t, s) for c, k, p, r, t, s in nodes}
    expected = {}
    for c in range(4):
        leaves = [k for k in range(25) if not any(n[0] == c and n[2] == k for n in nodes)]
        paths = []
        for leaf in leaves:
            path, k = [], leaf
            while k is not None:
                path.append(k)
                k = by[c, k][0]
            paths.append((-sum(by[c, k][3] for k in path), leaf, path[::-1]))
        for rank, (score, leaf, path) in enumerate(sorted(paths)[:3], 1):
            expected[c, leaf] = (rank, -score, path)
    formatted = chat_format.read_back(chat_format.format_paths(chat_format.reply_paths(tree, branches=3))).collect()
    got = {(r.conv, r.leaf): r for r in formatted}
    assert set(got) == set(expected) | {(None, 1), (8, 1)}
    for (c, leaf), (rank, score, path) in expected.items():
        r = got[c, leaf]
        assert (r.rank, r.path_score) == (rank, score)
        assert [(t.role, t.text) for t in r.turns] == [(by[c, k][1], by[c, k][2]) for k in path]
        assert r.loss_text == "".join(by[c, k][2] for k in path if by[c, k][1] == "assistant")
        assert "".join(r.formatted[s.start : s.start + s.length] for s in r.loss) == "".join(x for x in map(lambda t: t.replace("\\", "\\\\").replace("## ", "#\\# ").replace("</turn>", "<\\/turn>"), (by[c, k][2] for k in path if by[c, k][1] == "assistant")))
    assert chat_format.reply_paths(tree.where("conv = 100")).count() == 0


# 3. SimHash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in ids}


def test_simhash(spark):
    texts = {r.doc_id: r.text for r in docs(spark).collect()}
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    expected = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs(spark)).collect()}
    assert got == {i: (f"{prints[i]:016x}", expected[i]) for i in texts}
    kept = simhash.keep_first(docs(spark))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(expected.values())) and kept.columns == docs(spark).columns


def test_lists_that_two_fingerprints_meet_in():
    """The tally of lists tells how many positional bytes are shared: three lists or more for six bytes or more, else one at most."""
    for many in range(9):
        for differ in itertools.combinations(range(8), many):
            lists = sum(not set(p) & set(differ) for p in simhash.BYTE_SETS)
            assert (lists >= simhash.MIN_LISTS) == (many <= 2) and (many <= 2 or lists <= 1)


def test_simhash_of_a_long_text():
    random.seed(31)
    text = " ".join(random.choice(["Ab", "c", "dE", "f"]) for _ in range(120_001))
    assert simhash._fingerprint(text) % (1 << 64) == brute_fingerprint(text)


def test_simhash_links_of_dense_groups(spark):
    random.seed(2)
    prints = [random.getrandbits(64) for _ in range(40)]
    prints += [prints[k % 4] ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for k in range(300)]
    prints = list(dict.fromkeys(prints))
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    for dense in (4, 1000):
        edges = simhash.links(nodes, dense)
        pairs = {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in edges.collect()}
        assert pairs == {frozenset(p) for p in itertools.combinations(prints, 2) if (p[0] ^ p[1]).bit_count() <= 2}
        found = {(r.node) % (1 << 64): r.component % (1 << 64) for r in components.components(edges).collect()}
        groups = brute_components({p: p for p in prints})
        same = collections.defaultdict(set)
        for p in prints:
            same[found.get(p, p)].add(p)
        assert sorted(map(sorted, same.values())) == sorted(sorted(p for p in prints if groups[p] == g) for g in set(groups.values()))


# 4. SentencePiece


def test_sentencepiece_gives_the_library_ids(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, mine = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_viterbi.pieces(path)
    random.seed(4)
    texts = ["", " ", "  two  spaces ", "tab\tline\n\nend", "ﬁ ½ 中文 😀 é́", " " * 40 + "x", "aaaa" * 300, "x = f(y); // {z}\r\n", "don't!!! ###"]
    texts += ["".join(random.choice("  aeiouthnsrldéñ中\n.,#01") for _ in range(random.randint(1, 80))) for _ in range(800)]
    for t in texts:
        assert list(mine.encode(t)) == library.encode(t), t
        assert mine.decode(mine.encode(t)) == t
    whole = "".join(mine.text.get(i, "") for i in mine.encode("thandre" * 2000))
    assert whole == "▁" + "thandre" * 2000
    rows = sentencepiece_viterbi.encoded(odd_docs(spark), path).collect()
    assert len(rows) == len(ODD) + 2 and all(r.round_trip or "▁" in r.text for r in rows)
    assert next(r for r in rows if r.doc_id == 0).ids == [] and "component_id" in rows[0].asDict()


def test_sentencepiece_streams_a_text_in_a_bounded_window(spark):
    """Searched in one go, without cuts or memo, documents give the same ids from a window of a few longest pieces, by commits."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, mine = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_viterbi.Pieces(path)
    texts = [r.text for r in docs(spark).orderBy("doc_id").limit(60).collect() if r.text]
    chars = 0
    for t in texts:
        before = mine.commits
        assert mine._stretch(sentencepiece_viterbi.SPACE + t.replace(" ", sentencepiece_viterbi.SPACE)) == library.encode(t)
        chars += len(t)
        assert len(t) < 100 or mine.commits > before
    assert mine.commits > chars / 40 and mine.widest <= 4 * mine.longest
    cut = sentencepiece_viterbi.Pieces(path)
    for t in texts:
        cut.encode(t)
    assert cut.widest <= mine.widest


def test_sentencepiece_without_an_admissible_piece():
    mine = sentencepiece_viterbi.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    mine._follows = lambda before, piece: False
    assert mine.search("▁the") == ["▁", "t", "h", "e"] and mine.decode(mine._stretch("▁the")) == "the"


# 5. importance resampling


def test_kth_greatest(spark):
    random.seed(6)
    keys = [random.randint(-(1 << 62), 1 << 62) for _ in range(500)] + [7] * 50
    rows = spark.createDataFrame([(k,) for k in keys], "key long")
    for k in (1, 2, 100, 250, 550):
        assert importance.kth_greatest(rows, k) == sorted(keys, reverse=True)[k - 1]
    assert importance.kth_greatest(rows, 551) is None and importance.kth_greatest(rows, 0) is None


def test_importance_resampling(spark):
    spark_docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = importance.resampled(spark_docs, truth)
    held = rows.join(truth, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    assert held.agg(F.avg((F.col("kept").cast("int") == F.col("quality")).cast("int"))).first()[0] > 0.9
    third = importance.resampled(spark_docs, truth, importance.ResamplingRules(share=0.3))
    best = [r.sample_key for r in third.collect()]
    assert third.where("kept").count() == round(0.3 * len(best))
    assert min(r.sample_key for r in third.where("kept").collect()) >= sorted(best, reverse=True)[round(0.3 * len(best)) - 1] - 1e-6
    assert importance.resampled(odd_docs(spark), truth.where("false")).count() == len(ODD) + 2
    assert importance.resampled(spark_docs.where("false"), truth).count() == 0


# 6. token counts


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    extra = ["a <|endoftext|>  b\x1c c　 d's  \n\n x  ", "don't   stop 123abc!!é", "<|endoftext|><|endoftext|>"]
    rows = [(k, t) for k, t in enumerate([*ODD, *extra])] + [(1, "twice"), (1, "twice"), (None, "null id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").union(docs(spark).select("doc_id", "text"))
    expected = sorted(((r.doc_id is None, r.doc_id), len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False))) for r in frame.collect())
    for hot in (0, 50, 10**6):
        got = sorted(((r.doc_id is None, r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.token_counts(frame, path, hot=hot).collect())
        assert [(x[0][0], x[0][1] or 0, *x[1:]) for x in got] == [(x[0][0], x[0][1] or 0, *x[1:]) for x in expected]
    assert token_counts.token_counts(frame.where("false"), path).count() == 0


# 7. HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header><nav>menu</nav></header><div id="cookie-notice">We use cookies</div>
<div class="wrap-3"><div class="post post-12"><h2>Title &amp; more&nbsp;x</h2><p>First, with text, and <a href="#">a link</a>.<p>Second   one<br>goes on, long enough<ul><li>one<li>two &lt;b&gt;</ul><form><p>Form</p></form><div class="share">Share</div></div>
<aside>Side</aside><section id="comments"><p>Nice post, I like it, really, a lot, so much, yes, indeed, all of it</p></section></div><footer>&copy; x</footer>"""


def test_html(spark):
    short = '<body><div class="wrap-4"><div class="post post-9"><p>Hi.</p></div><div class="links"><p>Some other, longer, text, that, is, not, the, article, at, all, but, long</p></div></div>'
    rows = [(1, "http://h.x/1", PAGE), (2, "http://h.x/2", PAGE.replace("post-12", "post-13")), (3, "http://h.x/3", "<html>" + short), (4, None, None), (5, "x", ""), (6, "http://h.x/6", "<p>cut &am"), (6, "http://h.x/6", "<p>cut &am"), (7, "http://y", "a < b & c")]
    got = collections.defaultdict(list)
    for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    article = "Title & more x\n\nFirst, with text, and a link.\n\nSecond one goes on, long enough\n\none\n\ntwo <b>"
    assert got[1] == got[2] == [article]
    assert got[3] == ["Hi."]  # by the host's path, where the page alone would choose the links
    assert got[4] == got[5] == [""] and got[6] == ["cut &am"] * 2 and got[7] == ["a < b & c"]
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html_extract.main_texts(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = r.html.split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(__import__("html").unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(filter(None, blocks))


def test_html_keeps_what_an_article_says(spark):
    """Names that only hold a telling word, and fallback content, stay in an article; what is named as a whole goes."""
    page = """<body><article><p class="share-price">Price, 5</p><div class="related-work"><p>Earlier, work</p></div><math><mi>x</mi></math><fieldset>Set, out</fieldset><canvas>drawn</canvas><object>thing</object>
<div class="share">S</div><div class="related-posts">R</div><div id="cookie-notice">C</div><div class="social-share-buttons">B</div><form>F</form></article>"""
    frame = spark.createDataFrame([(1, "http://k.x/1", page, "a", 7)], "page_id long, url string, html string, text string, path long")
    assert html_extract.main_texts(frame).first().text == "Price, 5\n\nEarlier, work\n\nx\n\nSet, out\n\ndrawn\n\nthing"
    empty = html_extract.main_texts(frame.where("false"))
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "text", "n_chars"]


def test_html_of_deep_and_stray_markup():
    import time

    deep = "<div class='w-1/2'>" * 20_000 + "<p>deep</p>"
    stray = "<body>" + "<b>" * 4000 + "</i></td>" * 20_000 + "<p>stray</p>"
    items = "<ul>" + "<span>" * 4000 + "<li>x</li>" * 5000
    began = time.time()
    for source, text in ((deep, "deep"), (stray, "stray"), (items, "\n\n".join(["x"] * 5000))):
        page = html_extract.Page(source)
        at = page.best()[0]
        assert page.text(None) == page.text(page.path(at)) == text
    assert time.time() - began < 8


# 8. languages


def test_viterbi_against_all_paths():
    random.seed(8)
    for _ in range(20):
        counts = np.array([random.randint(0, 5) for _ in range(4)])
        scores = np.random.default_rng(random.randrange(99)).normal(size=(counts.sum(), 3)) * 3
        path, at = language_id.viterbi(scores, counts, 2.0), 0
        for n in counts:
            part = scores[at : at + n]
            value = lambda p: sum(part[k, x] for k, x in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
            if n:
                assert value(path[at : at + n]) == pytest.approx(max(map(value, itertools.product(range(3), repeat=int(n)))))
            at += n


def test_languages(spark):
    spark_docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify_languages(spark_docs).join(spark_docs.select("doc_id", "lang", "text"), "doc_id")
    assert rows.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    for r in rows.limit(50).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert all(a.end <= b.start and a.lang != b.lang for a, b in zip(r.spans, r.spans[1:]))
    model = language_id.fit(spark_docs, F.lit(True), language_id.LanguageRules())
    en, de = (spark_docs.where(f"lang = '{x}' and n_chars between 300 and 2000").first().text for x in ("en", "de"))
    mixed = spark.createDataFrame([(1, f"{en}\n{de}")], "doc_id long, text string")
    spans = language_id.label_languages(mixed, model).first().spans
    assert [s.lang for s in spans] == ["en", "de"] and abs(spans[1].start - len(en)) < 20
    odd = {r.doc_id: r for r in language_id.label_languages(odd_docs(spark), model).collect()}
    assert [odd[k].lang_pred for k in (0, 1, 2, 4)] == ["und"] * 4 and odd[0].score == 0.0 and odd[7].lang_pred != "und"
    none = language_id.fit(spark_docs, F.lit(False), language_id.LanguageRules())
    assert language_id.label_languages(odd_docs(spark), none).where("lang_pred <> 'und'").count() == 0


# 9. toxicity


def brute_features(text, rules):
    """The triples of a stretch of characters and their shares, from the definition."""
    found = collections.Counter()
    for i, j, k in itertools.combinations(range(len(text)), 3):
        if k - i < rules.reach:
            found[text[i] + text[j] + text[k]] += rules.decay ** (k - i + 1)
    whole = sum(rules.decay ** (2 * (k - i + 1)) for i, _, k in itertools.combinations(range(rules.stretch), 3) if k - i < rules.reach) ** 0.5
    return {t: v / whole for t, v in found.items()}


def brute_kernel(a, b, rules):
    x, y = brute_features(a, rules), brute_features(b, rules)
    return sum(v * y.get(t, 0.0) for t, v in x.items())


def test_kernel_and_landmark_features_against_brute_force():
    rules = toxicity.ToxicityRules()
    random.seed(9)
    triples = toxicity.Triples("abcdeiostz", rules)
    stretch = lambda t: triples.codes[[ord(c) for c in t]].tobytes().ljust(rules.stretch, bytes([triples.none]))
    texts = ["".join(random.choice("abcdeiostz ") for _ in range(random.choice([16, 16, 5, 2]))) for _ in range(14)] + ["idiot", "i d i o t", "idziot aa bb cc"]
    marks, others = texts[:6], texts[6:]
    nystroem = toxicity.Nystroem(triples, [stretch(t) for t in marks])
    k_xz = np.array([[brute_kernel(x, z, rules) for z in marks] for x in others])
    k_zz = np.array([[brute_kernel(x, z, rules) for z in marks] for x in marks])
    assert np.allclose(nystroem.kernel([stretch(t) for t in others]), k_xz, atol=1e-5)
    values, vectors = np.linalg.eigh(k_zz)
    root = vectors * np.where(values > 1e-4, np.maximum(values, 1e-4) ** -0.5, 0.0) @ vectors.T
    assert np.allclose(nystroem.features([stretch(t) for t in others]), k_xz @ root, atol=1e-3)
    w = np.random.default_rng(9).normal(size=len(marks))
    weights = nystroem.weights(w)
    long = "".join(random.choice("abcdeiostz ") for _ in range(90))
    long = re.sub(" +", " ", long)
    scores, found = triples.best([*others, long, None, "", "###"], weights)
    value = lambda t: float(np.array([brute_kernel(t, z, rules) for z in marks]) @ root @ w)
    assert np.allclose(scores[: len(others)], [max(0.0, *(value(part) for k in range(1, len(t) + 1) for part in (t[:k], t[-k:]))) for t in (re.sub(" +", " ", t) for t in others)], atol=1e-3)
    assert scores[len(others)] == pytest.approx(max(0.0, *(value(long[max(0, k) : k + 16]) for k in range(-15, len(long)))), abs=1e-3)
    assert list(scores[-3:]) == [0.0, 0.0, 0.0] and all(len(x) == rules.stretch for x in found)
    parts = triples.stretch_scores(triples.read([long])[0], weights, part=7)
    assert np.allclose(parts, triples.stretch_scores(triples.read([long])[0], weights), atol=1e-5)


def test_landmarks_tell_apart():
    triples = toxicity.Triples("abcdeiostz", toxicity.ToxicityRules())
    codes = lambda t: triples.codes[[ord(c) for c in t.ljust(16)]].tobytes()
    chosen = toxicity.landmarks(triples, [codes(t) for t in ["idiot", "idiot", "stoat", "badeos", "stoat"]], 4)
    assert len(chosen) == len(set(chosen)) == 3


def test_sentences_teach_gapped_and_split_insults(spark):
    """Learnt from whole sentences of labelled documents, in any script; gaps, insertions and blanks don't hide an insult."""
    random.seed(19)
    rare = "\U00010428\U0001042a\U0001042c\U0001042e\U00010430"  # letters behind 0xFFFF
    words = ["".join(random.choice(["re", "tion", "an", "the", "er", "in", "lo", "ма", "ре"]) for _ in range(random.randint(1, 4))) for _ in range(300)]
    say = lambda *extra: " ".join(random.sample([*random.choices(words, k=9), *extra], 9 + len(extra))) + "."
    rows = []
    for k in range(900):
        toxic = k % 6 == 0
        rows.append((k, " ".join([say(), say(), say(*([random.choice(["moron", "дурак", rare])] if toxic else []))]), int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame.drop("toxic"), frame.drop("text"))
    chance = lambda t: model.slope * model.decisions([t])[0] + model.shift > 0
    for insult in ("moron", "moroxn", "mo ron", "m o r o n", "m.o.r-on", "дурак", "ду рак", "дурzак", rare, "MORON"):
        assert chance(f"{say()} {insult} {say()}"), insult
    assert sum(chance(say() + " " + say()) for _ in range(50)) <= 2
    assert list(model.decisions([None, "", "123 !"])) == [-1.0] * 3


def test_sentences():
    assert toxicity.sentences_of("You i.d-i.o.t! ok, Sir.\nok Sir! ¿") == {"you i d i o t", "ok sir"}
    assert toxicity.sentences_of(None) == set()


def test_toxicity(spark):
    spark_docs, truth = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = spark_docs.join(truth.select("doc_id"), "doc_id", "left_semi")
    rows = toxicity.toxicity(known, truth).join(truth, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    clean = toxicity.keep_clean(known, truth)
    toxic = truth.where("toxic = 1")
    assert clean.columns == known.columns and clean.join(toxic, "doc_id").count() < 0.25 * toxic.count()
    assert clean.join(truth.where("toxic = 0"), "doc_id").count() > 0.97 * truth.where("toxic = 0").count()


def test_toxicity_without_examples(spark):
    empty = labels(spark).where("false")
    rows = toxicity.toxicity(odd_docs(spark), empty).collect()
    assert len(rows) == len(ODD) + 2 and all(r.decision == -1.0 and r.predicted == 0 for r in rows)
    assert toxicity.toxicity(odd_docs(spark).where("false"), empty).count() == 0
    assert toxicity.keep_clean(odd_docs(spark), empty).count() == len(ODD) + 2


# 10. decontamination


def brute_contaminated(text, items, rules):
    """Every alignment of every item, without masks."""
    tokens = lambda t: [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    words, found = tokens(text), set()
    for i, item in items:
        theirs = tokens(item)
        size = min(rules.window, len(theirs))
        least = size if size < rules.tolerant else rules.share * size
        for shift in range(-len(theirs), len(words)):
            same = [0 <= shift + k < len(words) and words[shift + k] == w for k, w in enumerate(theirs)]
            if theirs and any(sum(same[s : s + rules.window]) >= least for s in range(len(theirs) - size + 1)):
                found.add(i)
                break
    return found


def test_masks_miss_no_placing_of_substitutions():
    rules = decontaminate.SeedRules()
    for n in range(rules.tolerant, rules.window + 1):
        wrong = n - -int(-(rules.share * n) // 1)
        placings = [set(x) for x in itertools.combinations(range(n), wrong)]
        met = [any(all(bit == "0" or at + k not in x for k, bit in enumerate(m)) for m in rules.masks for at in range(n - len(m) + 1)) for x in placings]
        assert all(met), (n, sum(met) / len(met))


def test_decontamination(spark):
    rules = decontaminate.SeedRules()
    whole = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in whole.collect()][:8]
    random.seed(10)
    filler = [w for r in docs(spark).limit(20).collect() for w in r.text.split()]
    texts = []
    for _, item in items:
        words = item.split()
        swapped = [w if j % 6 != 3 else "zzz" for j, w in enumerate(words)]
        for passage in (words, swapped, words[:14], words[:5], [w if j % 2 else "qq" for j, w in enumerate(words)]):
            texts.append(" ".join([*random.sample(filler, 30), *passage, *random.sample(filler, 10)]))
        for _ in range(4):  # a window with as many substitutions as the share allows, anywhere
            at, wrong = random.randrange(len(words) - 12), random.sample(range(13), 3)
            texts.append(" ".join([*random.sample(filler, 15), *[w if j not in wrong else "zzz" for j, w in enumerate(words[at : at + 13])], *random.sample(filler, 10)]))
    for n in (1, 2, 5, 7, 8, 9, 11, 12):  # items of few tokens, and ones that share a beginning
        words = [f"short{n}x{j}" for j in range(n)]
        items.append((1000 + n, " ".join(words)))
        texts += [" ".join(["aa", "bb", *words, "cc"]), " ".join(["aa", *words[:-1], "cc"]), " ".join(w if j not in (1, n - 2) else "zzz" for j, w in enumerate(words)), " ".join(words) * 2]
    for k in range(12):
        items.append((2000 + k, f"which of the following statements is true of {' '.join(f't{k}u{j}' for j in range(8))}"))
    texts += ["Which of the following statements is true of t3u0 t3u1 t3u2 t3u3 t3u4 no", "which of the following statements is true", "which of the following statements is true of none of them here"]
    items += [(3000, ""), (3001, None), (3002, "... !"), (3003, items[0][1])]
    texts += [None, "", "a b", *[" ".join(random.sample(filler, 60)) for _ in range(10)]]
    frame = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(0, texts[0], "y"), (None, texts[0], "z")], "doc_id long, text string, item_id string")
    few = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination_report(frame, few).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert set(r.item_ids) == brute_contaminated(texts[r.doc_id or 0], items, rules), texts[r.doc_id or 0]
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.contaminated, sorted(r.item_ids), r.best_share)
    for other in (decontaminate.SeedRules(broadcast_rows=0, block_rows=3), decontaminate.SeedRules(broadcast_rows=0, filter_rows=0, block_rows=3)):
        assert sorted(map(key, got)) == sorted(map(key, decontaminate.contamination_report(frame, few, other).collect()))
    kept = decontaminate.decontaminated(frame, few)
    assert kept.count() == sum(not r.contaminated for r in got) and kept.columns == frame.columns
    assert decontaminate.contamination_report(frame, few.where("false")).where("contaminated").count() == 0
    assert decontaminate.contamination_report(frame.where("false"), few).count() == 0


def test_decontamination_of_very_long_texts(spark):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = benchmark.orderBy("item_id").first()
    words = [f"w{j % 997}" for j in range(100_000)]
    frame = spark.createDataFrame([(0, " ".join(words)), (1, " ".join([*words, item.text])), (2, "x" * 300_000)], "doc_id long, text string")
    for rules in (decontaminate.SeedRules(), decontaminate.SeedRules(broadcast_rows=0, filter_rows=0)):
        assert {r.doc_id: item.item_id in r.item_ids for r in decontaminate.contamination_report(frame, benchmark, rules).collect()} == {0: False, 1: True, 2: False}


# all of them on odd rows, and the pipeline


def test_odd_rows(spark):
    rows = odd_docs(spark)
    n = len(ODD) + 2
    assert quality_rules.compression_rules(rows).count() == n
    found = simhash.simhash_components(rows).collect()
    assert len(found) == n and {r.component_id for r in found if r.doc_id in (0, 1, 2)} == {0} and {r.fingerprint for r in found if r.doc_id == 0} == {"0" * 16}
    first = simhash.keep_first(rows)
    assert first.columns == rows.columns and {r._key for r in first.collect()} <= {"k", None}
    assert sorted(r.doc_id for r in first.where("doc_id is not null").collect()) == sorted({r.component_id for r in found if r.component_id is not None})
    for f in (quality_rules.compression_rules, simhash.simhash_components, simhash.keep_first):
        assert f(rows.where("false")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    at = docs(spark)
    truth = labels(spark)
    steps = [at]
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF)
        steps.append(at)
        if name != "sentencepiece":
            assert at.columns == steps[0].columns
        assert at.count() <= steps[-2].count()
    kept = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert kept(steps[1]) == {r.doc_id for r in importance.resampled(steps[0], truth).where("kept").collect()}
    assert kept(steps[2]) == {r.doc_id for r in toxicity.toxicity(steps[1], truth).where("predicted = 0").collect()}
    assert kept(steps[3]) == {r.component_id for r in simhash.simhash_components(steps[2]).collect()}
    assert kept(steps[4]) == {r.doc_id for r in decontaminate.contamination_report(steps[3], spark.read.parquet(f"{SF}/benchmark.parquet")).where("not contaminated").collect()}
    assert kept(steps[5]) == kept(steps[4]) and steps[5].where("not round_trip").count() == 0
    assert kept(corpus_pipeline.run(spark, SF)) == kept(steps[5])
