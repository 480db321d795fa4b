import numpy as np
import pytest

from laneatlas.operators import filters as X


def test_filters_leave_flat_images_alone():
    flat = np.full((16, 16), 90)
    assert (X.bilateral(flat) == 90).all() and X.smoothed(flat, 5) == pytest.approx(90)
    assert (X.adaptive_threshold(flat, c=5) == 255).all() and (X.adaptive_threshold(flat) == 0).all()
    assert X.bilinear(flat, 5, 7) == pytest.approx(90)


def test_bilateral_keeps_edges():
    step = np.repeat([[0] * 8 + [255] * 8], 16, axis=0)
    assert np.abs(X.bilateral(step, sigma_value=10) - step).max() <= 1
    assert np.abs(X.smoothed(step, 9) - step).max() > 50


def test_equalised_stretches_and_keeps_order():
    image = np.add.outer(np.arange(16), np.arange(16)) + 100
    out = X.equalized(image, clip=40, tiles=1)
    assert np.ptp(out) > np.ptp(image) and (np.diff(out, axis=1) >= 0).all()


def test_background_finds_what_moves():
    model = X.Background((8, 8))
    for _ in range(20):
        still = model.apply(np.full((8, 8), 100))
    assert not still.any()
    image = np.full((8, 8), 100)
    image[2:4, 3:6] = 220
    image[6, 6] = 70
    got = model.apply(image)
    assert (got[2:4, 3:6] == 255).all() and got[6, 6] == 127 and (got == 0).sum() == 64 - 7


def test_flow_of_a_shift():
    y, x = np.mgrid[0:24, 0:24]
    image = lambda d: 100 + 50 * np.sin((x - d) / 3) + 50 * np.cos(y / 3)
    dx, dy = X.flow(image(0), image(0.5), 9)
    assert np.median(dx) == pytest.approx(0.5, abs=0.1) and abs(np.median(dy)) < 0.1


def _texture(u=0.0, v=0.0):
    y, x = np.mgrid[0:96, 0:128].astype(float)
    return 120 + 30 * np.sin((x - u) / 4) + 25 * np.cos((y - v) / 5) + 20 * np.sin((x - u + y - v) / 7) + 15 * np.cos((x - u) / 2.7 - (y - v) / 3.1)


@pytest.mark.parametrize("u, v", [(0.0, 0.0), (0.5, -0.3), (2.3, 1.7), (6.4, -5.2)])
def test_flow_recovers_a_displaced_texture(u, v):
    dx, dy = X.flow(_texture(), _texture(u, v))
    inner = (slice(16, -16), slice(16, -16))
    assert np.abs(dx[inner] - u).max() < 0.1 and np.abs(dy[inner] - v).max() < 0.1


def test_expansion_equals_a_weighted_fit_of_each_neighbourhood():
    image = np.random.default_rng(2).integers(0, 256, (7, 9)).astype(float)
    reach, sigma = 2, 1.1
    padded = np.pad(image, reach, mode="edge")
    y, x = (v.ravel().astype(float) for v in np.mgrid[-reach : reach + 1, -reach : reach + 1])
    base = np.stack([np.ones_like(x), x, y, x * x, y * y, x * y], axis=1)
    root = np.sqrt(np.exp(-(x * x + y * y) / (2 * sigma**2)))
    got = X.expansion(image, reach, sigma)
    for r in range(7):
        for c in range(9):
            want = np.linalg.lstsq(base * root[:, None], padded[r : r + 2 * reach + 1, c : c + 2 * reach + 1].ravel() * root, rcond=None)[0]
            assert got[:, r, c] == pytest.approx(want[1:], abs=1e-8)


def test_one_flow_step_equals_loops():
    a, b = np.random.default_rng(5).uniform(0, 255, (2, 12, 11))
    window, reach, sigma = 5, 2, 1.2
    r1, r2 = X.expansion(a, reach, sigma), X.expansion(b, reach, sigma)
    dx, dy = X.flow(a, b, window, levels=1, iterations=1, reach=reach, sigma=sigma)
    h, w = a.shape
    for r in range(h):
        for c in range(w):
            g, z = np.zeros((2, 2)), np.zeros(2)
            for i in range(r - window // 2, r + window // 2 + 1):
                for j in range(c - window // 2, c + window // 2 + 1):
                    y, x = min(max(i, 0), h - 1), min(max(j, 0), w - 1)
                    form = lambda q: np.array([[q[2, y, x], q[4, y, x] / 2], [q[4, y, x] / 2, q[3, y, x]]])  # noqa: B023, E731
                    m = (form(r1) + form(r2)) / 2
                    g += m.T @ m / window**2
                    z += m.T @ (-(r2[:2, y, x] - r1[:2, y, x]) / 2) / window**2
            det = g[0, 0] * g[1, 1] - g[0, 1] ** 2 + 1e-3
            assert dx[r, c] == pytest.approx((g[1, 1] * z[0] - g[0, 1] * z[1]) / det, abs=1e-8)
            assert dy[r, c] == pytest.approx((g[0, 0] * z[1] - g[0, 1] * z[0]) / det, abs=1e-8)
