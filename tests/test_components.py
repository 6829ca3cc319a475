"""The component kernel against a flood fill, and the boxes of three known masks."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from patchloom.operators.annotate import GroundingConfig, with_grounding
from patchloom.operators.components import CONVERTED, label, shapes, with_shapes
from patchloom.operators.stats import with_counts


def flood(mask):
    """Components by first pixel in raster order: id -> pixels."""
    h, w = mask.shape
    seen, out = set(), {}
    for r in range(h):
        for c in range(w):
            if mask[r, c] and (r, c) not in seen:
                todo, own = [(r, c)], []
                seen.add((r, c))
                while todo:
                    y, x = todo.pop()
                    own.append((y, x))
                    for v in range(max(0, y - 1), min(h, y + 2)):
                        for u in range(max(0, x - 1), min(w, x + 2)):
                            if mask[v, u] and (v, u) not in seen:
                                seen.add((v, u))
                                todo.append((v, u))
                out[r * w + c] = own
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**32 - 1))
def test_shapes_equal_flood_fill(h, w, seed):
    rng = np.random.default_rng(seed)
    cls = rng.choice([0, 1, 2, 3, 255], size=(3, h, w))
    for patch, got in zip(cls, shapes(cls), strict=True):
        for k in range(5):
            want = flood(patch == k)
            s = got[k]
            assert (s is None) == (not want)
            if s:
                assert {c["id"]: c["area"] for c in s["comps"]} == {i: len(p) for i, p in want.items()}
                for c in s["comps"]:
                    ys, xs = zip(*want[c["id"]], strict=True)
                    assert (c["x1"], c["y1"], c["x2"], c["y2"]) == (min(xs), min(ys), max(xs), max(ys))
        conv = flood((patch == 1) | (patch == 2))
        assert {c["id"]: c["area"] for c in (got[CONVERTED] or {"comps": []})["comps"]} == {i: len(p) for i, p in conv.items()}


def test_serpentine_is_one_component():
    m = np.full((1, 33, 33), -1)
    m[0, ::2] = 1
    for k, r in enumerate(range(1, 33, 2)):
        m[0, r, -1 if k % 2 == 0 else 0] = 1
    assert len(np.unique(label(m))) == 2


def blob(*boxes):
    a = np.zeros((16, 16), int)
    for cls, r0, r1, c0, c1 in boxes:
        a[r0:r1, c0:c1] = cls
    return a.ravel().tolist()


SCATTER = [1 if (i // 16) % 3 == 0 and (i % 16) % 3 == 0 else 0 for i in range(256)]


@pytest.mark.parametrize(
    ("cls", "cfg", "union", "boxes", "counts", "normal"),
    [
        (blob((1, 4, 8, 4, 8)), (3, 1, 0.0), [4, 4, 7, 7], [[4, 4, 7, 7]], (16, 1, 1), [0.25, 0.25, 0.5, 0.5]),
        (blob((1, 1, 4, 1, 4), (2, 10, 14, 10, 15)), (3, 1, 0.0), [1, 1, 14, 13], [[10, 10, 14, 13], [1, 1, 3, 3]], (29, 2, 2), [0.0625, 0.0625, 0.9375, 0.875]),
        (SCATTER, (3, 10, 0.2), [0, 0, 15, 15], [], (36, 36, 0), [0.0, 0.0, 1.0, 1.0]),
    ],
)
def test_known_masks(spark, cls, cfg, union, boxes, counts, normal):
    rows = spark.createDataFrame([("p", 16, 16, cls)], "patch_id string, h int, w int, cls array<int>")
    g = with_grounding(with_shapes(with_counts(rows)), GroundingConfig(*cfg)).first()["grounding"]
    assert g["union_px"] == union
    assert [[b["x1"], b["y1"], b["x2"], b["y2"]] for b in g["component_px"]] == boxes
    assert (g["pixel_count"], g["n_components"], g["kept_components"]) == counts
    assert g["union_bbox"] == normal
    assert len(g["component_bboxes"]) == len(boxes)


def test_empty_ignored_and_odd_sizes(spark):
    rows = spark.createDataFrame([("ignored", 2, 2, [255] * 4), ("one", 1, 1, [1]), ("null", 1, 2, [None, 0])], "patch_id string, h int, w int, cls array<int>")
    got = {r["patch_id"]: r for r in with_grounding(with_shapes(with_counts(rows)), GroundingConfig(3, 1, 0.0)).collect()}
    assert got["ignored"]["dominant_class"] == "none" and got["ignored"]["valid_frac"] == 0
    assert got["ignored"]["grounding"]["union_bbox"] is None and got["ignored"]["grounding"]["component_bboxes"] == []
    assert got["one"]["grounding"]["union_bbox"] == [0.0, 0.0, 1.0, 1.0]
    assert got["null"]["counts"] == [1, 0, 0, 0, 0]


def test_null_and_short_arrays_have_no_shapes(spark):
    p = spark.createDataFrame([("a", 1, 2, [0, 1]), ("b", 1, 2, None), ("c", 2, 2, [0]), ("d", None, 2, [0, 0])], "patch_id string, h int, w int, cls array<int>")
    got = {r["patch_id"]: r["shapes"] for r in with_shapes(p).collect()}
    assert got["b"] is None and got["c"] is None and got["d"] is None and got["a"][0]["n"] == 1
