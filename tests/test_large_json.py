"""A JSON document read by ranges against json.loads, cut at every byte."""

import json
import random
import time

import pytest

from matchlake.sources import conversion, large_json

HARD = {"a": [1, {"data": [9]}], "data": [{"id": "x\\\"],[{", "k": "\\\\"}, [1, [2, {}], "],["], "a,b", None, 1.5, {"ü": "😀\\u0041", "e": {"data": [1, 2]}}, [], {}], "z": {"q": "}{\"data\":["}, "s": "\\"}


def read(spark, path, size):
    header, rows = large_json.elements(spark, str(path), range_bytes=size)
    found = sorted((r.element, json.loads(r.value)) for r in rows.collect())
    assert [k for k, _ in found] == list(range(len(found)))
    return json.loads(header), [v for _, v in found]


def in_loops(path, size):
    """The same steps without Spark, so that every cut can be tried."""
    source = open(path, "rb")
    total = path.stat().st_size
    cuts = [(a, min(a + size, total)) for a in range(0, total, size)]
    states, q, d = [], False, 0
    for a, b in cuts:
        odd, outside, inside = large_json._summary(source, a, b)
        states.append((a, b, q, d))
        d += inside if q else outside
        q ^= bool(odd)
    assert not q and not d
    return source, states


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("piece", [1, 3, 1 << 20])
def test_every_cut(tmp_path, monkeypatch, indent, piece):
    monkeypatch.setattr(large_json, "PIECE", piece)
    path = tmp_path / "d.json"
    path.write_text(json.dumps(HARD, indent=indent, ensure_ascii=False))
    raw = path.read_bytes()
    first = raw.index(b'"data"', raw.index(b'"data"') + 1)
    first = raw.index(b"[", first) + 1
    depth, last, quoted, k = 1, first, False, first
    while depth:
        c = raw[k : k + 1]
        if c == b"\\":
            k += 2
            continue
        quoted ^= c == b'"'
        depth += 0 if quoted else {b"[": 1, b"{": 1, b"]": -1, b"}": -1}.get(c, 0)
        last, k = k, k + 1
    for size in range(1, len(raw) + 1):
        source, states = in_loops(path, size)
        got = [json.loads(x) for a, b, q, d in states for x in large_json._elements(source, a, b, q, d, first, last)]
        assert got == HARD["data"], size


@pytest.mark.parametrize("size", [5, 17, 40, 1000])
def test_document(spark, tmp_path, size):
    path = tmp_path / "d.json"
    path.write_text(json.dumps(HARD, indent=2))
    header, data = read(spark, path, size)
    assert data == HARD["data"] and header == {k: v for k, v in HARD.items() if k != "data"}


def test_odd_documents(spark, tmp_path):
    path = tmp_path / "d.json"
    for text, want in (("{}", []), ('{"data": []}', []), ('{"data":[ \n ], "b": 1}', []), ('{"data":[1]}', [1]), (' {"x":1,"data":[[]],"data":[2,3]} ', [2, 3]), ('{"data":["\\\\","\\""]}', ["\\", '"'])):
        path.write_text(text)
        for size in (3, 100):
            header, data = read(spark, path, size)
            assert data == want and header == {k: v for k, v in json.loads(text).items() if k != "data"}
    for text in ("", "[1]", '{"data": {}}', '{"data": [1', '{"data": "x"}', "null"):
        path.write_text(text)
        with pytest.raises(ValueError):
            read(spark, path, 4)


def test_many_samples(spark, tmp_path):
    """By many tasks, in time that more ranges don't lengthen; and as samples."""
    rng = random.Random(1)
    data = [{"id": f"s{k}", "inputs": [{"type": "video", "path": f"v/{k}.mp4"}], "note": "".join(rng.choice('ab"\\{}[],:é') for _ in range(rng.randrange(200)))} for k in range(20_000)]
    path = tmp_path / "d.json"
    path.write_text(json.dumps({"version": "2.0", "data": data}, ensure_ascii=False))
    began = time.time()
    header, found = read(spark, path, 200_000)
    assert found == data and header == {"version": "2.0"} and time.time() - began < 60
    rows = conversion.samples(spark, str(path)).orderBy("sample_index").collect()
    assert [r.sample_id for r in rows] == [d["id"] for d in data] and json.loads(rows[7].payload) == data[7] and rows[3].inputs[0].path == "v/3.mp4"
