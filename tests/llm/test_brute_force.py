"""Importance weights and word scores against plain loops, and the memory of slices of long texts."""

import collections
import math
import re
import subprocess
import sys

import numpy as np
import pytest

from matchlake.llm import importance, language_id

TEXTS = ["The the the cat. THE cat?", "", None, "a", "  x\ty ", "zum Beispiel über über über über über Köln", "das ist ein Text und das ist gut", "this is a text, and it is good", "un texte est ici, il est bon " * 5]


def brute_grams(text):
    """(kind, bucket) of each n-gram; a word's bucket is taken from the word alone."""
    raw, out = (text or "").encode(), []
    out += [(0, raw[k] << 8 | raw[k + 1]) for k in range(len(raw) - 1)]
    out += [(1, ((raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]) * 2654435761 % 2**32) >> 16) for k in range(len(raw) - 2)]
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    for k, w in enumerate(words):
        alone = importance._grams(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[2][0]
        run = 0
        while run < 3 and k - run - 1 >= 0 and words[k - run - 1] == w:
            run += 1
        assert len(alone) == 1
        out += [(2, int(alone[0])), (3, sum(words[k - j] == w for j in range(1, 4) if k - j >= 0))]
    return out


def test_importance_weights_by_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    good = docs.where("doc_id in (6, 7, 8)")
    starts = importance._STARTS
    counts = lambda texts: collections.Counter(int(starts[k]) + b for t in texts for k, b in brute_grams(t))
    raw, target = counts(TEXTS), counts(TEXTS[6:])
    for frame, want in ((docs, raw), (good, target)):
        got = importance.gram_counts(frame)
        assert {int(k): int(got[k]) for k in np.flatnonzero(got)} == want
    kind = lambda b: int(np.searchsorted(starts, b, "right")) - 1
    sums = lambda c: collections.Counter({k: sum(n for b, n in c.items() if kind(b) == k) for k in range(4)})
    of_raw, of_target = sums(raw), sums(target)

    def ratio(b):
        k = kind(b)
        p_raw = (raw[b] + 1 / importance.SIZES[k]) / (of_raw[k] + 1)
        weight = max(1.0, math.sqrt(of_target[k]))
        return math.log((target[b] + weight * p_raw) / (of_target[k] + weight)) - math.log(p_raw)

    ratios = importance.log_ratios(importance.gram_counts(good), importance.gram_counts(docs), 1.0)
    for r in importance.log_weights(docs, ratios).collect():
        grams = [int(starts[k]) + b for k, b in brute_grams(TEXTS[r.doc_id])]
        assert r.n_grams == len(grams) and r.log_weight == pytest.approx(sum(map(ratio, grams)), abs=1e-3)


def test_word_scores_by_brute_force(spark):
    """Scores of words from counts of letters before, here and after, and of whole forms, by language."""
    texts = [("de", TEXTS[6]), ("de", TEXTS[5]), ("en", TEXTS[7]), ("fr", TEXTS[8]), ("el", "αυτό είναι ένα κείμενο"), (None, "no label")]
    docs = spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    rules = language_id.LanguageRules()
    from pyspark.sql import functions as F

    model = language_id.fit(docs, F.lit(True), rules)
    assert model.languages == ["de", "el", "en", "fr"]
    width, hash16 = 4, lambda x: (x * 0x9E3779B97F4A7C15 % 2**64) >> 48

    def words(text):
        return re.findall(r"[A-Za-zÀ-ÖØ-öø-ʯ]+|[Ͱ-Ͽ]+", text)

    def grams(word):
        codes = [ord(c.lower()) for c in word]
        near = [0, *codes, 0]
        pairs = [hash16((a << 21 | b) % 2**64) for a, b in zip(near, codes)]
        triples = [hash16(((a * 0x100000001B3 + b) * 0x100000001B3 + c) % 2**64) for a, b, c in zip(near, codes, near[2:])]
        whole = language_id.words_of([word]).grams[2]
        assert len(whole) == 1
        return pairs, triples, [int(whole[0])]

    counts = [[collections.Counter() for _ in range(width)] for _ in range(3)]
    for lang, text in texts:
        for word in words(text) if lang else ():
            for k, found in enumerate(grams(word)):
                counts[k][model.languages.index(lang)].update(found)
    rate = lambda k, j, b: math.log((counts[k][j][b] + 0.5) / (sum(counts[k][j].values()) + 0.5 * language_id.BUCKETS))

    def score(word):
        pairs, triples, (whole,) = grams(word)
        rates = [rate(2, j, whole) for j in range(width)]
        known = any(counts[2][j][whole] for j in range(width))
        out = [(rates[j] - sum(rates) / width if known else 0.0) + sum(rate(0, j, b) for b in pairs) + sum(rate(1, j, b) for b in triples) for j in range(width)]
        allowed = [j == 1 if ord(word[0]) >= 0x370 else j != 1 for j in range(width)]
        return [x - max(out) - (0 if a else rules.off_script) for x, a in zip(out, allowed)]

    text = "das unbekannte text is bon ένα"
    found = language_id.words_of([text])
    assert [text[a : a + e - b] for a, b, e in zip(found.at, found.begin, found.end)] == words(text)
    assert np.allclose(language_id.word_scores(model, found, rules), [score(w) for w in words(text)], atol=1e-3)


def test_languages_with_few_documents_are_learnt(spark):
    rows = [(k, "das ist ein Text und das ist gut", "de") for k in range(400)] + [(1000 + k, "this is a text, and it is good", "en") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify_languages(docs, language_id.LanguageRules(train_documents=20, least_documents=6))
    assert {r.doc_id < 1000 for r in got.where("lang_pred = 'de'").collect()} == {True} and got.where("lang_pred = 'en'").count() == 12


@pytest.mark.parametrize("what", ["importance", "language"])
def test_memory_of_long_texts(what):
    """A batch of 500 texts of 130 KB takes under 500 MB beside the texts, in either operator."""
    code = f"""
import resource, numpy as np, pyarrow as pa
from matchlake.llm import common, importance, language_id
rng = np.random.default_rng(1)
words = ["".join(map(chr, rng.integers(97, 123, rng.integers(2, 12)))) for _ in range(5000)]
texts = [" ".join(words[k] for k in rng.integers(0, 5000, 17_000)) for _ in range(500)]
batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
del texts
model = language_id.LanguageModel(["a", "b", "c", "d"], [rng.random((language_id.BUCKETS, 4), np.float32)] * 3, np.ones((len(language_id.SCRIPTS), 4), bool), np.zeros(4))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for part in common.slices(batch, 500):
    importance._grams(*common.utf8(part.column(0))) if {what!r} == "importance" else language_id._label(model, language_id.LanguageRules(), part.column(0).to_pylist())
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300)
    assert int(done.stdout) < 500, done.stdout


def test_sentencepiece_decoding_is_an_operator(spark):
    """Texts come back from their ids; ids that no text gives have a defined result."""
    import public_tokenizers

    from matchlake.llm import sentencepiece_viterbi as S

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, ""), (-2, " two  blanks "), (-3, "中文 😀 ▁x"), (-4, None), (-5, "\n\t")], docs.schema)
    rows = S.encoded(docs.unionByName(odd), model)
    back = S.decoded(rows.withColumnRenamed("text", "before"), model)
    wrong = back.where("NOT (text <=> coalesce(before, '')) AND round_trip").count()
    assert back.count() == docs.count() + 5 and wrong == 0 and back.where("round_trip").count() >= docs.count() + 3
    assert S.decoded(rows, model).columns.count("text") == 1
    import sentencepiece

    real = sentencepiece.SentencePieceProcessor(model_file=model)
    ids = spark.createDataFrame([([],), (None,), ([0, 5],), (real.encode("Hello there"),)], "ids array<int>")
    got = [r.text for r in S.decoded(ids, model).collect()]
    assert got[0] == "" and got[1] is None and got[3] == "Hello there"
    with pytest.raises(Exception, match="no piece"):
        S.decoded(spark.createDataFrame([([1_000_000],)], "ids array<int>"), model).collect()
