"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search goes over the characters of the normalised text (spaces become ``▁``, one is put in
front). At each boundary it keeps the best segmentation that ends there: its last piece and
where that began. The vocabulary is a merge-based one, whose segmentation is not the one of
greatest total score, so what makes a step admissible is its rule: a piece may follow another
if merging their joined characters, best-scored piece first and leftmost on ties, gives back
just those two. Exactly one piece is admissible at each boundary, and following the
backpointers gives the library's ids.

Only the boundaries of the last longest-piece's length can still be extended. Every ``LOOK``
characters the backpointers of these survivors are followed; once they meet in one boundary, the
ids up to it are committed and forgotten, so a text of any length takes a window of bounded size.
Where no piece holds two neighbouring characters together (before ``▁``, around line ends,
before most marks), all paths meet for certain: the ids are committed there too, the search goes
on from an empty window, and the ids of the stretch between two such points depend
on it alone. A bounded memo therefore holds the stretches met before, and another the words (a run of
``▁`` and what follows it) that are made of several. The text is read some words at a time; searching it in one go gives the same ids (tested).

Characters without a piece become the byte pieces of their UTF-8. Should no piece be admissible
at a boundary, the last character stands alone there. Null and empty texts have
no ids. Decoding gives the text back, except that ``▁`` itself comes back as a space
(``round_trip`` is then false). Each row is encoded alone; repeated rows and ids stay. Other
columns are kept, and one called ids, n_ids or round_trip is replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

#: Stretches (of either age) and pairs that a worker remembers, words of several stretches, and the longest of all these; characters between looks for a common boundary.
MEMO, MIXED, MEMO_CHARS, LOOK = 220_000, 40_000, 48, 8
SPACE = "▁"
#: Every stretch lies in one word; and the characters whose words are looked up together.
WORD, WORDS_CHARS = re.compile(f"{SPACE}+[^{SPACE}]*"), 1 << 16


class Pieces:
    """The pieces of a model file, and the search over them."""

    def __init__(self, model_file: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        kinds = [(i, model.id_to_piece(i)) for i in range(model.get_piece_size())]
        self.bytes = {int(p[3:5], 16): i for i, p in kinds if model.is_byte(i)}
        self.ids = {p: i for i, p in kinds if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.text = {i: p for p, i in self.ids.items()}
        self.score = {p: model.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        #: What pieces end in, and whether it is a piece itself.
        self.endings = {p[k:]: p[k:] in self.ids for p in self.ids for k in range(len(p))}
        self.unknown = model.unk_id()
        self.raw = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in kinds]
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids))
        #: Marks that no piece has behind a character that is not one of them, nor ``▁``: every path has a boundary before a run of them.
        inside = {(b, c) for p in self.ids for b, c in zip(p, p[1:], strict=False) if b != SPACE}
        marks = {c for p in self.ids for c in p if not (c.isalpha() or c.isdigit() or c == SPACE)} | {b for b, _ in inside if b in "²³¹"}
        while found := {c for b, c in inside if c in marks and b not in marks}:
            marks -= found
        heads, rest = re.escape("".join(sorted(marks))), re.escape("".join(sorted(marks)) + alone) + SPACE
        either = [f"{SPACE}+[{heads}]*[^{rest}]*", f"[{heads}]+[^{rest}]*"] if marks else [f"{SPACE}+[^{rest}]*"]
        self.stretches = re.compile("|".join([*either, f"[^{rest}]+", *([f"[{alone}]"] if alone else [])])).findall
        #: The ids of stretches, as bytes, which take a third of what tuples would.
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: The same of words of several stretches.
        self.mixed: dict[str, bytes] = {}
        self.older_mixed: dict[str, bytes] = {}
        self.nodes: dict[str, dict] = {}
        self.known = 0
        self.halves: dict[str, list[str]] = {}
        #: How often survivors met inside a stretch, and the widest window so far.
        self.commits = self.widest = 0

    def _merged(self, text: str, until: int = 1) -> list[str]:
        """The characters of ``text`` merged, best-scored piece first and leftmost on ties, to no fewer than so many parts."""
        parts = list(text)
        while len(parts) > until:
            best = max(((self.score[m], -k) for k, m in enumerate(map("".join, zip(parts, parts[1:], strict=False))) if m in self.score), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _halves(self, piece: str) -> list[str]:
        """The two parts whose merge gives ``piece``; fewer or more if its characters don't merge to it."""
        known = self.halves.get(piece)
        if known is None:
            known = self.halves[piece] = self._merged(piece, 2) if len(piece) > 1 and self._merged(piece) == [piece] else []
        return known

    def _follows(self, before: str, piece: str) -> bool:
        """Whether the merges of both pieces' characters, joined, end in just these two.

        They do unless some merge across their border comes before the merges that hide it. Both
        pieces are taken apart along the border, the one merged last first, and at each step the
        merge across is compared with the merge undone last; runs of ``▁``, whose pieces tie, are
        merged out instead.
        """
        if len(piece) > 1 and not self._halves(piece):
            return False
        if not before:
            return True
        if piece[0] == SPACE and before[-1] == SPACE:
            return self._merged(before + piece) == [before, piece]
        score, least = self.score, -1e18
        left, right = before, piece
        while True:
            across = score.get(left + right)
            if across is not None and across > least:
                return False
            a = score[left] if len(left) > 1 else 1.0  # single characters are there before any merge
            b = score[right] if len(right) > 1 else 1.0
            if a == b == 1.0:
                return True
            if a < b:
                least, left = a, self._halves(left)[1]
            else:
                least, right = b - 0.5, self._halves(right)[0]  # on a tie the merge across is further left, and goes first

    def _node(self, piece: str) -> dict:
        """What may follow a piece, as far as it is known: piece to its own node, or to None; the piece itself under None."""
        if self.known > MEMO:
            self.nodes, self.known = {}, 0
        return self.nodes.setdefault(piece, {None: piece})

    def _next(self, node: dict, piece: str) -> dict | None:
        self.known += 1
        return self._node(piece) if self._follows(node[None], piece) else None

    def search(self, text: str) -> list[str]:
        """The pieces of ``text``, committed in order as soon as no later character can change them."""
        endings, done = self.endings, []
        base, nodes, start = 0, [self._node("")], [0]  # at boundary base + k: the node of the last piece, and the boundary it began at
        for end in range(1, len(text) + 1):
            begin = end - 1
            piece = text[begin]
            whole = True  # a single character can stand alone, in the vocabulary or not
            while True:
                if whole:
                    before = nodes[begin - base]
                    try:
                        node = before[piece]
                    except KeyError:
                        node = before[piece] = self._next(before, piece)
                    if node is not None:
                        nodes.append(node)
                        start.append(begin)
                        break
                begin -= 1
                piece = text[begin:end] if begin >= base else ""
                try:
                    whole = endings[piece]
                except KeyError:
                    nodes.append(self._node(text[end - 1]))
                    start.append(end - 1)
                    break
            # in a window shorter than a longest piece nothing has met, as a piece may still begin where it does
            if end % LOOK == 0 and self.longest <= end - base and end < len(text):
                self.widest = max(self.widest, end - base)
                meet = self._common(base, start, end)
                if meet > base:
                    self.commits += 1
                    done += self._path(text, base, start, meet)
                    nodes, start, base = nodes[meet - base :], start[meet - base :], meet
        self.widest = max(self.widest, len(text) - base)
        return done + self._path(text, base, start, len(text))

    def _common(self, base: int, start: list[int], end: int) -> int:
        """The last boundary on the paths of all that a later piece may still follow."""
        alive = set(range(max(base, end - self.longest + 1), end + 1))
        while len(alive) > 1:
            k = max(alive)
            alive.discard(k)
            alive.add(max(base, start[k - base]))
        return alive.pop()

    @staticmethod
    def _path(text: str, base: int, start: list[int], end: int) -> list[str]:
        found = []
        while end > base:
            begin = start[end - base]
            found.append(text[begin:end])
            end = begin
        return found[::-1]

    def _stretch(self, text: str) -> list[int]:
        found: list[int] = []
        for piece in self.search(text):
            if piece in self.ids:
                found.append(self.ids[piece])
            else:
                found += [self.bytes.get(b, self.unknown) for b in piece.encode()] if self.bytes else [self.unknown]
        return found

    def _words(self, text: str) -> Iterator[list[str]]:
        """The words of ``text``, which begins with ``▁``: each a run of ``▁`` and what follows it; so many characters' at a time."""
        start, size = 0, WORDS_CHARS
        while start + size < len(text):
            words = WORD.findall(text, start, start + size)
            last = words.pop()  # it may go on
            if words:
                yield words
                start, size = start + size - len(last), WORDS_CHARS
            else:
                size *= 2
        yield WORD.findall(text, start)

    def _remembered(self, stretch: str, ids: bytes) -> bytes:
        if len(stretch) <= MEMO_CHARS:
            if len(self.memo) > MEMO:  # what was met since the last time stays one more turn
                self.older, self.memo = self.memo, {}
            self.memo[stretch] = ids
        return ids

    def _remembered_mixed(self, word: str, ids: bytes) -> bytes:
        if len(word) <= MEMO_CHARS:
            if len(self.mixed) > MIXED:
                self.older_mixed, self.mixed = self.mixed, {}
            self.mixed[word] = ids
        return ids

    def _word(self, word: str) -> bytes:
        """The ids of a word that is no stretch met lately."""
        if (ids := self.mixed.get(word)) is not None:
            return ids
        if (ids := self.older.get(word)) is not None:
            return self._remembered(word, ids)
        if (ids := self.older_mixed.get(word)) is not None:
            return self._remembered_mixed(word, ids)
        found = []
        for stretch in self.stretches(word):
            ids = self.memo.get(stretch)
            if ids is None:
                ids = self._remembered(stretch, self.older.get(stretch) or array("i", self._stretch(stretch)).tobytes())
            found.append(ids)
        return found[0] if len(found) == 1 else self._remembered_mixed(word, b"".join(found))

    def encode(self, text: str | None) -> array:
        found = array("i")
        if not text:
            return found
        for words in self._words(SPACE + text.replace(" ", SPACE)):
            known = map(self.memo.get, words)
            found.frombytes(b"".join([self._word(word) if ids is None else ids for word, ids in zip(words, known, strict=True)]))
        return found

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


_LOADED: dict[str, Pieces] = {}


def pieces(model_file: str) -> Pieces:
    """The model of a file, loaded once a worker, so that its memo outlives a task."""
    if model_file not in _LOADED:
        _LOADED[model_file] = Pieces(model_file)
    return _LOADED[model_file]


def encoded(docs: DataFrame, model_file: str, rows: int = 500) -> DataFrame:
    """``docs`` with ids (array of int), n_ids and round_trip (decoding the ids gave the text)."""
    kept = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c not in ("ids", "n_ids", "round_trip")])
    at = kept.columns.index("text")
    schema = T.StructType([*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), T.StructField("round_trip", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_file)
        for batch in batches:
            for part in slices(batch, rows):
                flat, ends, same = [], [0], []
                for text in part.column(at).to_pylist():
                    ids = model.encode(text)
                    same.append(model.decode(ids) == (text or ""))
                    flat.append(np.array(ids, np.int32))
                    ends.append(ends[-1] + len(ids))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat)))
                yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array(np.diff(ends), pa.int64()), pa.array(same)], names=schema.names)

    return kept.mapInArrow(run, schema)


def decoded(rows: DataFrame, model_file: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with the text of their ids in the column ``text``, in place of one of that name.

    Null ids give a null text, none an empty one; an id that the model lacks, or a null one, is an error. Ids of
    unknown characters give the model's mark for them, and bytes that are no UTF-8 give replacement characters.
    """
    kept = rows.select(*[rows[f"`{c}`"] for c in rows.columns if c != text])
    schema = T.StructType([*kept.schema.fields, T.StructField(text, T.StringType())])
    at = kept.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_file)
        for batch in batches:
            texts = [None if found is None else model.decode(_checked(found, len(model.raw))) for found in (x.as_py() for x in batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return kept.mapInArrow(run, schema)


def _checked(ids: list[int | None], size: int) -> list[int]:
    for k in ids:
        if k is None or not 0 <= k < size:
            raise ValueError(f"the model has no piece {k}")
    return ids
