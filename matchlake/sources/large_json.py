"""One large JSON document read by many tasks.

A document can be cut anywhere, once it is known whether a cut lies inside a string, and how deep.
Tasks take ranges of bytes. A first pass tells of each range how many quotes it holds, odd or even, and how it changes the
depth, should it begin outside a string or inside one; adding up over the ranges in order gives each one's state. With
that, a second pass finds the members of the document, and how many elements begin in each range. The third
hands out the elements of one member, an array: each by the range it begins in, which reads on to its end.

The driver sees a few numbers for each range and each member of the document, and the members besides the array.
Structure is told by bytes, which is safe in UTF-8; a document that is no JSON gives an error where its elements are parsed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .documents import located

RANGE_BYTES = 32 << 20
#: Bytes looked at together.
PIECE = 1 << 20
QUOTE, BACKSLASH, COMMA, COLON = b'"\\,:'


def _backslashes_before(source, at: int) -> int:
    """How many backslashes stand right before a place."""
    n, step = 0, 64
    while at > n:
        source.seek(max(0, at - n - step))
        tail = source.read(min(step, at - n))
        run = len(tail) - len(tail.rstrip(b"\\"))
        n += run
        if run < len(tail):
            break
    return n


class _Scanner:
    """Goes through the bytes from a place on, a piece at a time."""

    def __init__(self, source, at: int, in_string: bool = False) -> None:
        self.source, self.at, self.in_string = source, at, in_string
        self.escapes = _backslashes_before(source, at) % 2
        source.seek(at)

    def piece(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next bytes, which of them stand in a string (an opening quote does not, a closing one does), and which are quotes."""
        data = np.frombuffer(self.source.read(size), np.uint8)
        slashes = np.flatnonzero(data == BACKSLASH)
        quotes = data == QUOTE
        if self.escapes and len(data):  # the first byte is escaped
            quotes[0] = False
            slashes = slashes[1:] if len(slashes) and slashes[0] == 0 else slashes
        self.escapes = 0
        if len(slashes):
            begins = np.append(True, np.diff(slashes) > 1)
            first = slashes[begins]
            length = np.diff(np.append(np.flatnonzero(begins), len(slashes)))
            after = (first + length)[length % 2 == 1]
            quotes[after[after < len(data)]] = False
            self.escapes = int(len(after) > 0 and after[-1] == len(data))
        before = np.cumsum(quotes, dtype=np.int32) - quotes + self.in_string
        if len(data):
            self.in_string = bool((before[-1] + quotes[-1]) & 1)
        self.at += len(data)
        return data, (before & 1).astype(bool), quotes


_STEP = np.zeros(256, np.int8)
_STEP[list(b"{[")] = 1
_STEP[list(b"}]")] = -1


def _summary(source, start: int, stop: int) -> tuple[int, int, int]:
    """Of a range: quotes modulo 2, and changes of depth, beginning outside a string and inside."""
    scan, outside, inside = _Scanner(source, start), 0, 0
    while scan.at < stop:
        data, within, _ = scan.piece(min(PIECE, stop - scan.at))
        if not len(data):
            break
        steps = _STEP[data]
        outside += int(steps[~within].sum())
        inside += int(steps[within].sum())
    return int(scan.in_string), outside, inside


def _marks(scan: _Scanner, size: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
    """Places in the next bytes of brackets, commas and colons outside strings, their bytes, the depth before each, the depth at the end, and the bytes."""
    begin = scan.at
    data, within, _ = scan.piece(size)
    at = np.flatnonzero(~within & ((_STEP[data] != 0) | (data == COMMA) | (data == COLON)))
    steps = _STEP[data[at]].astype(np.int64)
    level = depth + np.cumsum(steps) - steps
    return at + begin, data[at], level, depth + int(steps.sum()), data


def _members(source, start: int, stop: int, in_string: bool, depth: int) -> list[tuple[int, int, int]]:
    """(place, byte, commas) of what happens at the first level in a range: brackets to and from it, its commas; and the commas one level deeper since. The last has no byte."""
    scan, out, commas = _Scanner(source, start, in_string), [], 0
    while scan.at < stop:
        at, kind, level, depth, data = _marks(scan, min(PIECE, stop - scan.at), depth)
        if not len(data):
            break
        closing, comma = _STEP[kind] < 0, kind == COMMA
        first = ((level == 1) & (kind != COLON)) | ((level == 0) & (_STEP[kind] > 0)) | ((level == 2) & closing)
        deeper = np.cumsum((level == 2) & comma)
        done = 0
        for k in np.flatnonzero(first):
            out.append((int(at[k]), int(kind[k]), commas + int(deeper[k]) - done))
            commas, done = 0, int(deeper[k])
        commas += (int(deeper[-1]) if len(deeper) else 0) - done
    return [*out, (stop, 0, commas)]


@dataclass(frozen=True)
class _Found:
    ranges: list[tuple[int, int, bool, int, int]]  # start, stop, in a string, depth, elements that begin before
    first: int  # where the array's content begins and ends
    last: int
    header: str


def _located_array(spark: SparkSession, path: str, field: str, range_bytes: int) -> _Found | None:
    store, place = located(path)
    size = store.get_file_info(place).size
    cuts = [(k, min(k + range_bytes, size)) for k in range(0, size, range_bytes)]
    if not cuts:
        raise ValueError(f"{path} is empty")

    def over(f, rows: list[tuple], columns: str, schema: str) -> list:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            files, at = located(path)
            for frame in frames:
                for row in frame.itertuples(index=False):
                    with files.open_input_file(at) as source:
                        yield f(source, *row)

        return sorted(tuple(r) for r in spark.createDataFrame(rows, columns).repartition(len(rows), "start").mapInPandas(run, schema).collect())

    summaries = over(lambda s, a, b: pd.DataFrame([(a, *_summary(s, a, b))]), cuts, "start long, stop long", "start long, quotes int, outside long, inside long")
    states, in_string, depth = [], False, 0
    for (a, b), (_, quotes, outside, inside) in zip(cuts, summaries, strict=True):
        states.append((a, b, in_string, depth))
        depth += inside if in_string else outside
        in_string ^= bool(quotes)
    if in_string or depth:
        raise ValueError(f"{path} ends inside a string or a bracket")
    told = over(lambda s, a, b, q, d: pd.DataFrame([(a, *x) for x in _members(s, a, b, q, d)]), states, "start long, stop long, in_string boolean, depth long", "start long, at long, kind int, commas long")

    with store.open_input_file(place) as source:

        def text(a: int, b: int) -> str:
            source.seek(a)
            return source.read(b - a).decode("utf-8")

        def key(a: int, b: int) -> tuple[str, int]:
            """The key that begins a member, and where its value begins."""
            head, size = "", 256
            while True:
                source.seek(a)
                raw = source.read(min(size, b - a))
                head = raw.decode("utf-8", "ignore")
                try:
                    name, end = json.JSONDecoder().raw_decode(head.lstrip())
                    rest = head.lstrip()[end:]
                    if ":" in rest:
                        at = len(head) - len(rest) + rest.index(":") + 1
                        return name, a + len(head[:at].encode())
                except ValueError:
                    pass
                if size >= b - a:
                    raise ValueError(f"{path} is no JSON object")
                size *= 4

        events = [(at, chr(kind)) for _, at, kind, _ in told if kind]
        if not events or events[0][1] != "{":
            raise ValueError(f"{path} holds no JSON object")
        ends = [at for at, kind in events if kind == ","] + [events[-1][0]]
        members, begin = [], events[0][0] + 1
        for end in ends:
            if text(begin, min(end, begin + 64)).strip() or end - begin > 64:
                members.append((begin, end, *key(begin, end)))
            begin = end + 1
        chosen = [m for m in members if m[2] == field]
        others = {name: json.loads(text(value, b)) for _, b, name, value in members if name != field}
        header = json.dumps(others, ensure_ascii=False, separators=(",", ":"))
        if not chosen:
            return _Found([], 0, 0, header)
        _, end, _, value = chosen[-1]
        inner = [(at, kind) for at, kind in events if value <= at < end]
        if not inner or inner[0][1] != "[" or text(value, inner[0][0]).strip():
            raise ValueError(f"the document's {field} must be a list")
        first, last = inner[0][0] + 1, inner[-1][0]
        if last - first <= PIECE and not text(first, last).strip():
            return _Found([], 0, 0, header)

    # the first element begins with the array, the others after its commas
    ranges, before = [], 0
    commas = {a: 0 for a, *_ in states}
    opened = False
    for start, at, kind, n in told:
        if opened:
            commas[start] += n
        if kind and at == first - 1:
            opened = True
        elif kind and at == last:
            opened = False
    for a, b, q, d in states:
        own = commas[a] + (a < first <= b)
        if own:
            ranges.append((a, b, q, d, before))
        before += own
    return _Found(ranges, first, last, header)


def _elements(source, start: int, stop: int, in_string: bool, depth: int, first: int, last: int) -> Iterator[bytes]:
    """The elements that begin in a range: after the array's bracket or one of its commas there."""
    scan, held, open_now = _Scanner(source, start, in_string), [], False
    while True:
        begin = scan.at
        at, kind, level, depth, data = _marks(scan, PIECE, depth)
        raw, done = data.tobytes(), 0
        for place in at[((level == 2) & (kind == COMMA) & (at > first - 1) & (at < last)) | (at == first - 1) | (at == last)].tolist():
            if open_now:
                yield b"".join([*held, raw[done : place - begin]])
                held = []
            open_now, done = place < stop and place < last, place - begin + 1
            if place >= stop or place >= last:
                return
        if not len(raw) or (not open_now and scan.at >= stop):
            return
        if open_now:
            held.append(raw[done:])


def elements(spark: SparkSession, path: str, field: str = "data", range_bytes: int = RANGE_BYTES) -> tuple[str, DataFrame]:
    """The members of a JSON object besides ``field``, as compact JSON, and the elements of ``field`` as rows (element, value).

    ``element`` counts from 0; ``value`` is an element as it stands. Of repeated members the last counts. Without the member, or with an empty
    array, there are no rows; a member that is no array is an error, and so is a file without a whole object.
    """
    found = _located_array(spark, path, field, range_bytes)
    if not found.ranges:
        return found.header, spark.createDataFrame([], "element long, value string")
    first, last = found.first, found.last

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, place = located(path)
        for frame in frames:
            for start, stop, in_string, depth, n in frame.itertuples(index=False):
                with store.open_input_file(place) as source:
                    texts, held = [], 0
                    for value in _elements(source, start, stop, in_string, depth, first, last):
                        texts.append(value.decode("utf-8").strip())
                        held += len(value)
                        if held > 4 << 20:
                            yield pd.DataFrame({"element": range(n, n + len(texts)), "value": texts})
                            texts, held, n = [], 0, n + len(texts)
                    yield pd.DataFrame({"element": range(n, n + len(texts)), "value": texts})

    rows = spark.createDataFrame(found.ranges, "start long, stop long, in_string boolean, depth long, n long").repartition(len(found.ranges), "start")
    return found.header, rows.mapInPandas(read, "element long, value string")
