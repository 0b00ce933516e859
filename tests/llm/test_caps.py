"""Cap filters against all pairs by brute force, also where crowded filters are cut into tiles."""

import math

import numpy as np
import pytest

from marketloom.llm import caps


def made(width=64):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, width))
    rows = [c + rng.normal(size=width) * s for c in centres for s in (0.02, 0.1, 0.15, 0.2, 0.25, 0.3)]
    rows += [centres[0] + rng.normal(size=width) * 0.05 for _ in range(150)]
    rows += [centres[1]] * 20
    rows += list(rng.normal(size=(200, width)))
    return [[float(np.float32(x)) for x in r] for r in rows]


def plain(rows):
    """(links, component) of (vec_id, embedding, label) rows."""
    fit = [e is not None and y is not None and all(x is not None and math.isfinite(x) for x in e) and any(e) for _, e, y in rows]
    parent = list(range(len(rows)))
    links = [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a, x) in enumerate(rows):
        for j, (_, b, y) in enumerate(rows[:i]):
            if fit[i] and fit[j] and x == y and len(a) == len(b):
                va, vb = np.array(a), np.array(b)
                if va @ vb / np.sqrt((va @ va) * (vb @ vb)) >= 0.93:
                    links[i] += 1
                    links[j] += 1
                    p, q = sorted((root(i), root(j)))
                    parent[q] = p
    return links, [root(i) for i in range(len(rows))]


@pytest.mark.parametrize("tile", [40, 2048])
def test_against_all_pairs(spark, tile):
    rows = [(i, e, i % 2) for i, e in enumerate(made())]
    rows = [(i, e, 0 if 180 <= i < 350 else y) for i, e, y in rows]
    rows += [(1000, None, 1), (1001, [0.0] * 64, 1), (1002, [1.0] * 63 + [None], 1), (1003, [float("nan")] * 64, 1), (1004, rows[0][1], None),
             (1005, [1.0, 2.0], 0), (1006, [2.0, 4.0], 0), (1007, [], 0), (1008, [float("inf")] + [1.0] * 63, 0)]
    frame = spark.createDataFrame([(i, e, y, 5) for i, e, y in rows], "vec_id bigint, embedding array<float>, label int, node int")
    got = {r.vec_id: r for r in caps.near_duplicates(frame, tile=tile).collect()}
    links, component = plain(rows)
    assert len(got) == len(rows)
    want = sum(links)
    mine = sum(r.n_links for r in got.values())
    assert 0.97 * want <= mine <= want
    agree = 0
    for place, (i, _, _) in enumerate(rows):
        assert got[i].n_links <= links[place]
        agree += got[i].component_id == rows[component[place]][0]
        assert got[i].kept == (got[i].component_id == i)
    assert agree >= 0.97 * len(rows)
    assert [got[i].n_links for i in range(1000, 1005)] == [0] * 5 and got[1006].component_id == 1005


def test_recall_at_the_threshold():
    rng = np.random.default_rng(6)
    for width in (8, 64):
        x = caps._unit(rng.normal(size=(400, width)))
        z = rng.normal(size=x.shape)
        z = caps._unit(z - (z * x).sum(axis=1, keepdims=True) * x)
        code = caps.Codes(width, 0.93, caps.RECALL)
        pairs = zip(code.decode(x), code.decode(0.93 * x + np.sqrt(1 - 0.93**2) * z))
        assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in pairs]) > 0.94


def test_decode_lists_all_exceeding_filters():
    code = caps.Codes(16, 0.93, 0.9)
    unit = caps._unit(np.random.default_rng(7).normal(size=(5, 16)))
    for scores, found in zip(code.halves(unit), code.decode(unit)):
        all_of = np.concatenate([(s[0][:, None] + s[1]).ravel() for s in scores])
        assert found.tolist() == np.flatnonzero(all_of >= code.height).tolist()


def test_copies_nulls_and_empty(spark):
    rows = [(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (None, [0.0, 1.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = sorted(map(str, [(r.vec_id, r.n_links, r.component_id) for r in caps.near_duplicates(frame).collect()]))
    assert got == sorted(map(str, [(None, 2, 4), (4, 2, 4), (4, 2, 4), (None, 0, None)]))
    assert caps.near_duplicates(frame.limit(0)).count() == 0
