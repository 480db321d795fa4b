"""Components over tiles against components of whole images."""

import numpy as np
import pytest

from laneatlas.operators import contours, seams


def _mask(spark, images):
    return spark.createDataFrame([(k, int(r), int(c)) for k, m in images.items() for r, c in zip(*np.nonzero(m), strict=True)], "k int, r int, c int")


def _whole(images):
    out = set()
    for k, m in images.items():
        label = contours.components(m)
        for part in range(1, label.max() + 1):
            r, c = np.nonzero(label == part)
            out.add((k, len(r), int(c.min()), int(r.min()), int(np.ptp(c)) + 1, int(np.ptp(r)) + 1))
    return out


@pytest.mark.parametrize("tile", [4, 7, 16, 64])
def test_equal_for_every_tiling(spark, tile):
    rng = np.random.default_rng(8)
    images = {k: rng.random((40, 52)) < p for k, p in enumerate((0.15, 0.35, 0.45, 0.6))}
    spiral = np.zeros((40, 52), bool)
    for k in range(0, 18, 2):
        spiral[k, k : 52 - k] = spiral[39 - k, k : 52 - k] = True
        spiral[k : 40 - k, 51 - k] = spiral[k + 2 : 40 - k, k] = True
        spiral[k + 2, k : k + 2] = True
    images[9] = spiral
    got = seams.tiled_components(_mask(spark, images), "k", tile).select("k", "n_pixels", "x", "y", "w", "h").collect()
    assert sorted(map(tuple, got)) == sorted(_whole(images)) or {tuple(r) for r in got} == _whole(images)
    assert len(got) == sum(contours.components(m).max() for m in images.values())


def test_labels_and_corners(spark):
    m = np.zeros((8, 8), bool)
    m[3, 3] = m[4, 4] = m[3, 4] = False
    m[3, 3] = m[4, 4] = True  # touch by a corner where four tiles meet
    m[0, 7] = True
    runs = seams.tiled_labels(_mask(spark, {1: m}), "k", 4).collect()
    assert len({r.root for r in runs}) == 2 and len(runs) == 3
    assert seams.tiled_components(_mask(spark, {1: m}).limit(0), "k", 4).count() == 0
