"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

A text is read as lower-case letters, every run of other characters as one blank. Kernel: two
stretches of ``stretch`` characters are compared by the triples of characters, in order but not
necessarily next to each other, that both hold; each occurrence counts ``decay`` to the power of
the length it spans (``reach`` at most). So an insult with gaps, inserted characters or blanks
between its letters stays close to itself. A text is as toxic as the stretch that is most so.

Learning: the sentences of labelled documents, each distinct one once (copies add nothing), are
toxic if no clean document holds them. What a toxic sentence says harmless words in too isn't
known beforehand, so its most toxic stretch speaks for it: of each toxic document the best
sentence, and up to ``best_sentences`` that are toxic by the machine so far, are the positive
examples, the most toxic stretches of clean sentences the negative ones. At first stretches are ranked by how far their
triples occur more often in toxic sentences than in all; then, ``rounds`` times, by the machine
fitted last, and the ``hardest`` stretches it is wrong about are learnt too. Landmarks are
chosen among the first examples, each time the one that those before tell least about. The
machine is linear in the Nyström features K(x, Z) K(Z, Z)^-1/2; as the kernel's own features
are few (triples of characters), its decision is carried over to one weight a triple, which
gives the same scores without comparing each stretch with each landmark.

A document's score is a logistic function of its highest decision, fitted on the
labelled documents. Learning takes at most ``train_documents`` labelled rows (by a hash of the
id); every row is scored in full. Sentences are counted, scored and ranked in Spark; the driver
holds the landmarks and examples, a bounded number of stretches a labelled document.

Defined cases: null, empty and letterless texts have no triple and the least decision there is,
-1. With no toxic example learnt every decision is -1. An id with contradicting labels
counts as toxic; null labels are not used. Repeated rows and ids keep a row each; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, per_slice


@dataclass(frozen=True)
class ToxicityRules:
    #: Rows of crc32(doc_id as text) mod ``folds`` 0 are held out.
    folds: int = 5
    train_documents: int = 20_000
    decay: float = 0.7
    reach: int = 8
    stretch: int = 16
    #: Letters told apart; rarer ones share so many codes by their code points.
    letters: int = 63
    buckets: int = 8
    #: Landmarks among toxic and among clean stretches.
    landmarks: tuple[int, int] = (192, 96)
    penalty: float = 10.0
    best_sentences: int = 3
    #: Clean stretches that a round adds, and how many rounds there are.
    hardest: int = 3000
    rounds: int = 3
    #: Added to the counts of triples before they are compared.
    prior: float = 3.0


_SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)")
_LETTERS = re.compile(r"[^\W\d_]+")
#: Put between texts; one in a text counts as a blank.
_MARK = "\U0010fffe"
#: The decision on a text without triples: the machine's fixed bias.
EMPTY = -1.0


def sentences_of(text: str | None) -> set[str]:
    """The distinct sentences of a text as letters and single blanks."""
    return {" ".join(_LETTERS.findall(s)) for s in _SENTENCE.split((text or "").lower())} - {""}


class Triples:
    """The kernel's features of stretches; letters outside the alphabet share a few codes."""

    def __init__(self, alphabet: str, rules: ToxicityRules) -> None:
        self.rules, self.blank = rules, len(alphabet) + rules.buckets
        self.none, self.size = self.blank + 1, self.blank + 2  # what lies between texts is in no triple
        letters = np.fromiter((c for c in range(0x110000) if chr(c).isalpha()), np.int64)
        self.codes = np.full(0x110000, self.blank, np.uint8)
        self.codes[letters] = len(alphabet) + letters % rules.buckets
        for k, letter in enumerate(alphabet):
            self.codes[ord(letter)] = k
        self.codes[ord(_MARK)] = self.none
        n = rules.stretch
        self.places = np.array([(i, i + j, i + s) for s in range(2, rules.reach) for j in range(1, s) for i in range(n - s)])
        share = rules.decay ** (self.places[:, 2] - self.places[:, 0] + 1.0)
        self.scale = 1 / np.sqrt(np.sum(share * share))
        self.shares = (share * self.scale).astype(np.float32)

    def __len__(self) -> int:
        return self.size**3

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The characters' codes, a stretch of none before each text and behind the last, and where each text's begins."""
        gap = _MARK * self.rules.stretch
        points = np.frombuffer(gap.join(["", *[(t or "").replace(_MARK, " ") for t in texts], ""]).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.codes[points]
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != self.blank) | (codes[:-1] != self.blank)
        codes = codes[keep]
        marks = np.flatnonzero(codes == self.none)
        return codes, marks[:: self.rules.stretch][: len(texts)]

    def _spans(self, codes: np.ndarray) -> Iterator[tuple[int, float, Iterator[np.ndarray]]]:
        """(distance of a triple's ends, its share, triples at each place for each middle)."""
        first, middle, last = (codes.astype(np.int32) * self.size**k for k in (2, 1, 0))
        for s in range(2, self.rules.reach):
            if len(codes) > s:
                ends = first[:-s] + last[s:]
                yield s, self.rules.decay ** (s + 1) * self.scale, (ends + middle[j : len(codes) - s + j] for j in range(1, s))

    def totals(self, codes: np.ndarray) -> np.ndarray:
        """How much each triple counts in ``codes``."""
        found = np.zeros(len(self))
        for _, share, triples in self._spans(codes):
            for at in triples:
                found += np.bincount(at, minlength=len(self)) * share
        cube = found.reshape((self.size,) * 3)
        cube[self.none], cube[:, self.none], cube[:, :, self.none] = 0, 0, 0
        return found

    def stretch_scores(self, codes: np.ndarray, weights: np.ndarray, part: int = 500_000) -> np.ndarray:
        """weights . features of the stretch that begins at each place; a share of the places at a time."""
        n, size = self.rules.stretch, max(0, len(codes) - self.rules.stretch + 1)
        found = np.zeros(size, np.float32)
        for start in range(0, size, part):
            end = min(size, start + part)
            for s, share, triples in self._spans(codes[start : end + n - 1]):
                each = sum(weights[at] for at in triples)
                sums = np.concatenate([[0.0], np.cumsum(each, dtype=np.float64)])
                found[start:end] += share * (sums[n - s : n - s + end - start] - sums[: end - start])
        return found

    def best(self, texts: list[str | None], weights: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """The highest score of a stretch of each text, 0 if no triple speaks for it, and that stretch's codes."""
        if not texts:
            return np.zeros(0, np.float32), []
        codes, begin = self.read(texts)
        scores = self.stretch_scores(codes, weights)
        highest = np.maximum.reduceat(scores, begin)
        at = np.flatnonzero(scores == np.repeat(highest, np.diff([*begin, len(scores)])))
        where = at[np.searchsorted(at, begin)]
        return highest, [codes[k : k + self.rules.stretch].tobytes() for k in where]

    def of(self, stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The triples of each stretch and their shares."""
        codes = np.frombuffer(b"".join(stretches), np.uint8).reshape(-1, self.rules.stretch).astype(np.int32)
        i, j, k = (codes[:, p] for p in self.places.T)
        return (i * self.size + j) * self.size + k, np.where((i == self.none) | (j == self.none) | (k == self.none), np.float32(0), self.shares)


class Nystroem:
    """The features K(x, Z) K(Z, Z)^-1/2 of stretches for the landmarks Z."""

    def __init__(self, triples: Triples, landmarks: list[bytes]) -> None:
        self.triples = triples
        at, shares = triples.of(landmarks)
        self.known = np.unique(at[shares > 0])
        self.place = np.full(len(triples), len(self.known), np.int32)
        self.place[self.known] = np.arange(len(self.known), dtype=np.int32)
        self.basis = np.zeros((len(self.known) + 1, len(landmarks)), np.float32)  # the last row stands for triples of no landmark
        np.add.at(self.basis, (self.place[at], np.arange(len(landmarks))[:, None]), shares)
        self.basis[-1] = 0
        values, vectors = np.linalg.eigh((self.basis.T @ self.basis).astype(float))
        self.root = vectors * np.where(values > 1e-4, 1 / np.sqrt(np.maximum(values, 1e-4)), 0.0) @ vectors.T

    def kernel(self, stretches: list[bytes]) -> np.ndarray:
        found = np.zeros((len(stretches), self.basis.shape[1]), np.float32)
        for start in range(0, len(stretches), 64):
            at, shares = self.triples.of(stretches[start : start + 64])
            found[start : start + 64] = np.einsum("nt,ntz->nz", shares, self.basis[self.place[at]])
        return found

    def features(self, stretches: list[bytes]) -> np.ndarray:
        return self.kernel(stretches) @ self.root

    def weights(self, w: np.ndarray) -> np.ndarray:
        """One weight a triple that gives w . features."""
        found = np.zeros(len(self.triples), np.float32)
        found[self.known] = self.basis[:-1] @ (self.root @ w)
        return found


@dataclass
class ToxicityModel:
    triples: Triples
    weights: np.ndarray
    slope: float = 3.0
    shift: float = 0.0

    def decisions(self, texts: list[str | None]) -> np.ndarray:
        return self.triples.best(texts, self.weights)[0].astype(float) + EMPTY


def landmarks(triples: Triples, stretches: list[bytes], many: int) -> list[bytes]:
    """At most so many of ``stretches``, each time the one that those before tell least about (an incomplete Cholesky factorisation)."""
    if not stretches:
        return []
    at, shares = triples.of(stretches)
    left = np.zeros(len(stretches))
    for k in range(len(stretches)):
        left[k] = np.sum(np.bincount(np.unique(at[k], return_inverse=True)[1], shares[k]) ** 2)
    factor, chosen, one = np.zeros((len(stretches), min(many, len(stretches)))), [], np.zeros(len(triples), np.float32)
    for m in range(factor.shape[1]):
        k = int(np.argmax(left))
        if left[k] < 1e-3:
            break
        one[:] = 0
        np.add.at(one, at[k], shares[k])
        column = (np.einsum("nt,nt->n", one[at], shares) - factor[:, :m] @ factor[k, :m]) / np.sqrt(left[k])
        factor[:, m] = column
        left -= column * column
        left[k] = 0
        chosen.append(stretches[k])
    return chosen


def _squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float) -> np.ndarray:
    """A support vector machine w . x + EMPTY with squared hinge loss, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        active = y * (x @ w + EMPTY) < 1
        xa, wa = x[active], weight[active]
        new = np.linalg.solve(np.eye(len(w)) + penalty * (xa.T * wa) @ xa, penalty * (xa.T @ (wa * (y[active] - EMPTY))))
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def fit_stretches(nystroem: Nystroem, toxic: list[bytes], clean: list[bytes], penalty: float) -> np.ndarray:
    """The machine's weight of each triple from example stretches."""
    y = np.array([1.0] * len(toxic) + [-1.0] * len(clean))
    weight = np.where(y > 0, max(1.0, len(clean) / (4 * max(1, len(toxic)))), 1.0)
    return nystroem.weights(_squared_hinge(nystroem.features([*toxic, *clean]).astype(float), y, weight, penalty))


def _fold(rules: ToxicityRules) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % rules.folds


def _examples(docs: DataFrame, labels: DataFrame, rules: ToxicityRules) -> DataFrame:
    """(doc_id, text, toxic) of at most ``train_documents`` labelled documents of the folds that are learnt from."""
    known = labels.where(F.col("toxic").isNotNull() & (_fold(rules) != 0)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rules.train_documents)
    return docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(few), "doc_id").select(F.col("doc_id").cast("long"), "text", "toxic")


def labelled_sentences(examples: DataFrame) -> DataFrame:
    """(sentence, toxic, doc): each distinct sentence, toxic if no clean document holds it, and the least id of those that do."""
    schema = pa.schema([("sentence", pa.string()), ("toxic", pa.int32()), ("doc", pa.int64())])

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(s, x, i) for i, t, x in zip(*[c.to_pylist() for c in batch.columns], strict=True) for s in sentences_of(t)]
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    each = examples.select("doc_id", "text", "toxic").mapInArrow(per_slice(split, 300), "sentence string, toxic int, doc long")
    return each.groupBy("sentence").agg(F.min("toxic").alias("toxic"), F.min("doc").alias("doc"))


def usual_letters(sentences: DataFrame, rules: ToxicityRules) -> str:
    """The letters that most sentences hold, counted over all of them."""
    each = sentences.select(F.explode(F.array_distinct(F.split("sentence", ""))).alias("letter")).where("letter not in ('', ' ')")
    most = each.groupBy("letter").count().orderBy(F.desc("count"), "letter").limit(rules.letters)
    return "".join(sorted(r.letter for r in most.collect() if len(r.letter) == 1))


def first_weights(sentences: DataFrame, triples: Triples) -> np.ndarray:
    """By how much each triple occurs more often in toxic sentences than in all: the squared log ratio, 0 if it doesn't."""
    shared = sentences.sparkSession.sparkContext.broadcast(triples)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(shared.value)))
        for batch in batches:
            toxic = batch.column(1).to_numpy() == 1
            said = np.array(batch.column(0).to_pylist(), object)
            for k in (0, 1):
                total[k] += shared.value.totals(shared.value.read(said[toxic == k].tolist())[0])
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[0, at]), pa.array(total[1, at])], names=["triple", "clean", "toxic"])

    rows = sentences.select("sentence", "toxic").mapInArrow(add, "triple int, clean double, toxic double").groupBy("triple").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    clean, toxic = rows["clean"].to_numpy(), rows["toxic"].to_numpy()
    share = toxic.sum() / max(clean.sum() + toxic.sum(), 1e-9)
    ratio = np.log((toxic + triples.rules.prior) / ((clean + toxic) * share + triples.rules.prior))
    found = np.zeros(len(triples), np.float32)
    found[rows["triple"].to_numpy()] = np.maximum(ratio, 0.0) ** 2
    return found


def best_stretches(sentences: DataFrame, triples: Triples, weights: np.ndarray) -> DataFrame:
    """(toxic, doc, stretch, score) of each sentence's best stretch."""
    shared = sentences.sparkSession.sparkContext.broadcast((triples, weights))
    names = ["toxic", "doc", "stretch", "score"]

    def pick(batch: pa.RecordBatch) -> pa.RecordBatch:
        told, w = shared.value
        score, stretch = told.best(batch.column(0).to_pylist(), w)
        return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(stretch, pa.binary()), pa.array(score, pa.float64())], names=names)

    return sentences.select("sentence", "toxic", "doc").mapInArrow(per_slice(pick, 5000), "toxic int, doc long, stretch binary, score double")


def _spoken_for(found: DataFrame, least: float, rules: ToxicityRules) -> list[bytes]:
    """Of each toxic document the best stretch, and the next best sentences' that score more than ``least``."""
    order = Window.partitionBy("doc").orderBy(F.desc("score"), "stretch")
    ranked = found.where("toxic = 1").withColumn("rank", F.row_number().over(order))
    rows = ranked.where((F.col("rank") == 1) | ((F.col("rank") <= rules.best_sentences) & (F.col("score") > least)))
    return sorted(bytes(r.stretch) for r in rows.select("stretch").collect())


def _hardest(found: DataFrame, least: float, many: int) -> list[bytes]:
    """The clean stretches that score most, those beyond ``least`` only; each once."""
    clean = found.where((F.col("toxic") == 0) & (F.col("score") > least)).groupBy("stretch").agg(F.max("score").alias("score"))
    return [bytes(r.stretch) for r in clean.orderBy(F.desc("score"), "stretch").limit(many).select("stretch").collect()]


def fit(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules()) -> ToxicityModel:
    examples = cut_lineage(_examples(docs, labels, rules))
    sentences = cut_lineage(labelled_sentences(examples))
    triples = Triples(usual_letters(sentences, rules), rules)
    found = cut_lineage(best_stretches(sentences, triples, first_weights(sentences, triples)))
    usual = found.where("toxic = 0").agg(F.percentile_approx("score", 0.99, 10_000)).first()[0]
    toxic = _spoken_for(found, usual or 0.0, rules)
    if not toxic:
        return ToxicityModel(triples, np.zeros(len(triples), np.float32))
    hard = _hardest(found, -1.0, rules.hardest)
    drawn = found.where("toxic = 0").select("stretch").distinct().orderBy(F.xxhash64("stretch"), "stretch").limit(rules.hardest).collect()
    clean = dict.fromkeys([*hard, *[bytes(r.stretch) for r in drawn]])
    among = [toxic[k] for k in np.linspace(0, len(toxic) - 1, min(len(toxic), rules.hardest)).astype(int)]
    nystroem = Nystroem(triples, [*landmarks(triples, among, rules.landmarks[0]), *landmarks(triples, hard[: rules.hardest // 2], rules.landmarks[1])])
    weights = fit_stretches(nystroem, toxic, list(clean), rules.penalty)
    for _ in range(rules.rounds):
        found = cut_lineage(best_stretches(sentences, triples, weights))
        toxic = _spoken_for(found, -EMPTY, rules)
        more = [x for x in _hardest(found, 0.1, rules.hardest) if x not in clean]
        clean.update(dict.fromkeys(more))
        weights = fit_stretches(nystroem, toxic, list(clean), rules.penalty)
    model = ToxicityModel(triples, weights)
    rows = highest(examples, model).select("decision", "toxic").toArrow()
    x, y = rows["decision"].to_numpy(), rows["toxic"].to_numpy().astype(float)
    if len(y) and 0 < y.sum() < len(y):
        model.slope, model.shift = _logistic(x, y)
    return model


def highest(docs: DataFrame, model: ToxicityModel, least: float | None = None) -> DataFrame:
    """``docs`` with ``decision``, the highest of a stretch of text; with ``least``, only rows below it, as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, names = docs.columns.index("text"), [*docs.columns, "decision"][: len(docs.columns) + (least is None)]

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = shared.value.decisions(batch.column(at).to_pylist())
        if least is not None:
            return batch.filter(pa.array(found < least))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=names)

    schema = T.StructType([*docs.schema.fields, *([T.StructField("decision", T.DoubleType())] if least is None else [])])
    return docs.mapInArrow(per_slice(score, 200), schema)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        grad = np.array([np.sum((p - y) * x) + 1e-2 * a, np.sum(p - y)])
        hess = np.array([[np.sum(w * x * x) + 1e-2, np.sum(w * x)], [np.sum(w * x), np.sum(w) + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = np.clip(a - step[0], 0.1, 25.0), np.clip(b - step[1], -25.0, 25.0)
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def toxicity(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules()) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted and decision for each row of ``docs``."""
    model = fit(docs, labels, rules)
    scored = highest(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model)
    chance = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(model.slope) * F.col("decision") + F.lit(model.shift)))))
    held = F.coalesce(_fold(rules) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, chance.alias("score"), (chance >= 0.5).cast("int").alias("predicted"), "decision")


def keep_clean(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules()) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, their columns as they were."""
    model = fit(docs, labels, rules)
    return highest(docs, model, -model.shift / model.slope)
