"""Two-half feature and label scans against numpy and plain loops."""

import json

import numpy as np
import pytest

from matchlake.sources import games


@pytest.fixture
def root(tmp_path):
    rng = np.random.default_rng(1)
    told = {}
    for game, halves in (("league a/2014 - x", (23, 7)), ("b", (1, None)), ("c", (5, 0))):
        folder = tmp_path / "in put" / game
        folder.mkdir(parents=True)
        for half, n in enumerate(halves, 1):
            if n is not None:
                x = rng.random((n, 3)).astype([np.float32, np.float64][half - 1])
                np.save(folder / f"{half}_feat.npy", x)
                np.save(folder / f"{half}_other.npy", x + 1)
                told[game.replace(" ", "_"), half] = x
        notes = [("1 - 00:03", "goal", "visible"), ("1 - 00:03", "goal", "not shown"), ("1 - 00:03", "card", None), ("2 - 59:59", "goal", "not shown"), ("2 - 00:01", "sub", "visible"), ("1 - 00:00", "kick", "visible"), ("x", "bad", "visible")]
        body = {"UrlLocal": game, "annotations": [{"gameTime": t, "label": label, **({"visibility": v} if v else {})} for t, label, v in notes]}
        (folder / "Labels-v2.json").write_text(json.dumps(body, indent=1))
    return str(tmp_path / "in put"), told


@pytest.mark.parametrize("per", [1, 4, 1000])
def test_features_by_ranges_of_rows(spark, root, per):
    path, told = root
    rows = games.half_features(spark, path, "feat.npy", per)
    assert rows.rdd.getNumPartitions() == sum(-(-len(x) // per) for x in told.values())
    got = {}
    for r in rows.collect():
        got.setdefault((r.game, r.half), {})[r.frame] = r.vector
    assert set(got) == {k for k, x in told.items() if len(x)}
    for key, x in told.items():
        assert all(np.allclose(got[key][k], row, atol=1e-6) for k, row in enumerate(x)) and len(got.get(key, {})) == len(x)


def test_labels_by_half(spark, root):
    path, told = root
    features = games.half_features(spark, path, "feat.npy")
    lengths = games.halves(features)
    assert {(r.game, r.half): r.frames for r in lengths.collect()} == {k: len(x) for k, x in told.items() if len(x)}
    labels = games.game_labels(spark, path)
    assert labels.count() == 21 and labels.where("NOT visible").count() == 6
    dense = {(r.game, r.half, r.frame, r.label): r.value for r in games.half_frame_labels(labels, lengths).collect()}
    a = "league_a/2014_-_x"
    assert dense == {
        (a, 1, 6, "goal"): -1, (a, 1, 6, "card"): 1, (a, 2, 6, "goal"): -1, (a, 2, 2, "sub"): 1, (a, 1, 0, "kick"): 1,
        ("b", 1, 0, "goal"): -1, ("b", 1, 0, "card"): 1, ("b", 1, 0, "kick"): 1, ("c", 1, 4, "goal"): -1, ("c", 1, 4, "card"): 1, ("c", 1, 0, "kick"): 1,
    }
    clips = sorted(tuple(r) for r in games.half_clip_labels(labels, lengths, 6).collect())
    assert clips == sorted([(a, 1, 0, "kick"), (a, 1, 1, "goal"), (a, 1, 1, "card"), (a, 1, 2, "background"), (a, 1, 3, "background"), (a, 2, 0, "sub"), ("c", 1, 0, "kick")])


def test_odd_matrices(spark, tmp_path):
    np.save(tmp_path / "one.npy", np.arange(4, dtype=np.int16))
    np.save(tmp_path / "three.npy", np.arange(12.0).reshape(2, 3, 2))
    got = sorted((r.path.rsplit("/", 1)[1], r.frame, r.vector) for r in games.npy_rows(spark, str(tmp_path)).collect())
    assert got[0] == ("one.npy", 0, [0, 1, 2, 3]) and len(got) == 7 and got[-1] == ("three.npy", 5, [10, 11])
    assert games.npy_rows(spark, str(tmp_path / "one.npy")).count() == 1
    (tmp_path / "bad.npy").write_bytes(b"no matrix at all")
    with pytest.raises(Exception, match="no .npy file"):
        games.npy_rows(spark, str(tmp_path)).count()
