"""Eight-connected components and shape sums of the classes of each patch.

A narrow operator: an Arrow batch of patches in, the same patches out, no shuffle; components never
cross a patch. All patches of a batch that have one size are labelled together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

N_CLASSES = 5
CONVERTED = 5  # the number under which the union of converted classes is reported
COMP = pa.struct([("id", pa.int64()), ("area", pa.int64()), ("x1", pa.int64()), ("y1", pa.int64()), ("x2", pa.int64()), ("y2", pa.int64())])
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy", "boundary", "contact")
SHAPE = pa.struct([("cls", pa.int32()), *((k, pa.int64()) for k in SUMS), ("comps", pa.list_(COMP))])
SHAPE_DDL = "array<struct<cls:int," + ",".join(f"{k}:bigint" for k in SUMS) + ",comps:array<struct<id:bigint,area:bigint,x1:bigint,y1:bigint,x2:bigint,y2:bigint>>>>"


def neighbours(a: np.ndarray, fill: int) -> Iterator[np.ndarray]:
    """a (patch, row, column) seen from its eight neighbours; fill outside."""
    p = np.pad(a, ((0, 0), (1, 1), (1, 1)), constant_values=fill)
    h, w = a.shape[1:]
    for dr in (0, 1, 2):
        for dc in (0, 1, 2):
            if (dr, dc) != (1, 1):
                yield p[:, dr : dr + h, dc : dc + w]


def label(value: np.ndarray) -> np.ndarray:
    """For each pixel with value >= 0 the smallest index of its component, whose pixels have one value
    and touch by side or corner; -1 elsewhere. Minima spread to neighbours and then jump to the label
    of their label, so rounds grow with the logarithm of a component's length in the usual case."""
    same = [(n == value) & (value >= 0) for n in neighbours(value, -1)]
    none = value.size
    at = np.where(value >= 0, np.arange(value.size).reshape(value.shape), none)
    while True:
        low = at
        for n, ok in zip(neighbours(at, none), same, strict=True):
            low = np.where(ok & (n < low), n, low)
        flat = np.append(low.ravel(), none)
        while True:
            jump = flat[flat]
            if (jump == flat).all():
                break
            flat = jump
        low = flat[:-1].reshape(at.shape)
        if (low == at).all():
            return np.where(value >= 0, low, -1)
        # the old root learns what its members have found
        np.minimum.at(flat, at.ravel(), low.ravel())
        at = flat[flat][:-1].reshape(at.shape)


def shapes(cls: np.ndarray) -> list[list[dict]]:
    """cls (patch, row, column): class ids, others ignored. For each patch six places, a record for each
    class and then one for the converted classes together; None where there is no pixel."""
    n, h, w = cls.shape
    valid = (cls >= 0) & (cls < N_CLASSES)
    value = np.where(valid, cls, -1)
    out: list[list[dict | None]] = [[None] * (CONVERTED + 1) for _ in range(n)]
    near = list(neighbours(value, -1))
    rim = np.zeros(cls.shape, bool)
    touch = np.zeros(cls.shape, bool)
    for m in near:
        rim |= m != value
        touch |= (m >= 0) & (m != value)
    rr, cc = np.meshgrid(np.arange(h), np.arange(w), indexing="ij")
    for only, first in ((value, 0), (np.where((value == 1) | (value == 2), CONVERTED, -1), CONVERTED)):
        lab = label(only)
        p, r, c = np.nonzero(only >= 0)
        if not len(p):
            continue
        key = p * (CONVERTED + 1) + only[p, r, c]
        size = n * (CONVERTED + 1)
        cols = (np.ones(len(p), np.int64), c, r, c * c, r * r, c * r, rim[p, r, c], (rim & touch)[p, r, c])
        sums = [np.bincount(key, x, size).astype(np.int64) for x in cols]
        root, back = np.unique(lab[p, r, c], return_inverse=True)
        area = np.bincount(back)
        lo = [np.full(len(root), 1 << 40) for _ in range(2)]
        hi = [np.full(len(root), -1) for _ in range(2)]
        for k, v in enumerate((c, r)):
            np.minimum.at(lo[k], back, v)
            np.maximum.at(hi[k], back, v)
        owner, place = np.divmod(root, h * w)
        of = owner * (CONVERTED + 1) + only.reshape(-1)[root]
        comps: dict[int, list] = {}
        for i in range(len(root)):
            comps.setdefault(int(of[i]), []).append({"id": int(place[i]), "area": int(area[i]), "x1": int(lo[0][i]), "y1": int(lo[1][i]), "x2": int(hi[0][i]), "y2": int(hi[1][i])})
        for k in sorted(comps):
            out[k // (CONVERTED + 1)][k % (CONVERTED + 1)] = {"cls": k % (CONVERTED + 1), **{name: int(s[k]) for name, s in zip(SUMS, sums, strict=True)}, "comps": comps[k]}
    return out


def with_shapes(patches: DataFrame) -> DataFrame:
    """patches (with h, w and cls, a row-major array of class ids) plus `shapes`, by class id and null
    for absent classes; an element has cls, sums over its pixels (n, sx, sy, sxx, syy, sxy), its boundary pixels, those of them that touch
    another class, and its components by first pixel. cls 5 is the converted classes together. An array
    that is null or does not have h * w elements has null shapes."""
    names = patches.columns
    schema = T.StructType([*patches.schema.fields, T.StructField("shapes", T._parse_datatype_string(SHAPE_DDL))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, ws = b.column("h").to_pylist(), b.column("w").to_pylist()
            data = b.column("cls")
            found: list = [None] * b.num_rows
            by_size: dict[tuple[int, int], list[int]] = {}
            length = pc.list_value_length(data).to_pylist()
            for i, (h, w) in enumerate(zip(hs, ws, strict=True)):
                if length[i] is not None and h and w and length[i] == h * w:
                    by_size.setdefault((h, w), []).append(i)
            for (h, w), rows in by_size.items():
                step = max(1, (1 << 20) // max(1, h * w))
                for a in range(0, len(rows), step):
                    own = rows[a : a + step]
                    cls = np.stack([np.asarray(data[i].values.fill_null(255)) for i in own]).reshape(len(own), h, w).astype(np.int64)
                    for i, s in zip(own, shapes(cls), strict=True):
                        found[i] = s
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(SHAPE))], [*names, "shapes"])

    return patches.mapInArrow(run, schema)


def shape_of(cls: int):  # noqa: ANN201
    """The record of one class, null if absent."""
    return F.col("shapes")[cls]
