"""Denoising filters against plain loops, and tiled rasters against whole ones."""

import math

import numpy as np
import pytest
from test_rasters import back, raster

from sunlattice.operators import denoise


def noisy(n, m, seed=5):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:n, :m]
    return 50 + 3 * np.sin(y / 4) + 0.2 * x + rng.normal(0, 1.5, (n, m))


def at(z, y, x):
    return z[min(max(y, 0), z.shape[0] - 1), min(max(x, 0), z.shape[1] - 1)]


def kernel(z, r, weigh):
    out = np.zeros_like(z)
    for y, x in np.ndindex(z.shape):
        cells = [(weigh(dy, dx, at(z, y + dy, x + dx), z[y, x]), at(z, y + dy, x + dx)) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
        out[y, x] = sum(w * v for w, v in cells) / sum(w for w, _ in cells)
    return out


def plain_gaussian(z, valid):
    return kernel(z, 3, lambda dy, dx, v, c: math.exp(-(dy * dy + dx * dx) / (2 * 0.75**2)))


def plain_bilateral(z, valid):
    return kernel(z, 3, lambda dy, dx, v, c: math.exp(-(dy * dy + dx * dx) / (2 * 0.75**2) - (v - c) ** 2 / 2))


def plain_adaptive(z, valid):
    out = z.copy()
    for y, x in np.ndindex(z.shape):
        cells = [at(z, y + dy, x + dx) for dy in range(-2, 3) for dx in range(-2, 3)]
        mean = sum(cells) / 25
        std = math.sqrt(max(sum(v * v for v in cells) / 25 - mean * mean, 0))
        if abs(z[y, x] - mean) > 2.0 * std:
            out[y, x] = mean
    return out


def plain_tv(z, valid):
    n, m = z.shape
    z = z.copy()
    px, py = np.zeros_like(z), np.zeros_like(z)
    for _ in range(50):
        for y, x in np.ndindex(z.shape):
            a = px[y, x] + 0.125 / 0.15 * (z[y, (x + 1) % m] - z[y, x])
            b = py[y, x] + 0.125 / 0.15 * (z[(y + 1) % n, x] - z[y, x])
            norm = max(1.0, math.hypot(a, b))
            px[y, x], py[y, x] = a / norm, b / norm
        z = z + 0.15 * np.array([[px[y, x] - px[y, x - 1] + py[y, x] - py[y - 1, x] for x in range(m)] for y in range(n)])
    return z


def plain_anisotropic(z, valid):
    z = z.copy()
    for _ in range(20):
        new = z.copy()
        for y, x in np.ndindex(z.shape):
            for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)):
                j, i = y + dy, x + dx
                if 0 <= j < z.shape[0] and 0 <= i < z.shape[1] and valid[y, x] and valid[j, i]:
                    d = z[j, i] - z[y, x]
                    new[y, x] += 0.15 * math.exp(-((d / 30.0) ** 2)) * d
        z = new
    return z


def plain_nlm(z, valid):
    low, high = z[valid].min(), z[valid].max()
    s = np.floor((z - low) / (high - low) * 255)

    def mirrored(i, n):
        while not 0 <= i < n:
            i = -i if i < 0 else 2 * n - 2 - i
        return i

    def patch(y, x):
        return np.array([s[mirrored(y + dy, s.shape[0]), mirrored(x + dx, s.shape[1])] for dy in range(-3, 4) for dx in range(-3, 4)])

    patches = {(y, x): patch(y, x) for y in range(-10, s.shape[0] + 10) for x in range(-10, s.shape[1] + 10)}
    out = np.zeros_like(s)
    for y, x in np.ndindex(s.shape):
        total = norm = 0.0
        for dy in range(-10, 11):
            for dx in range(-10, 11):
                other = patches[y + dy, x + dx]
                w = math.exp(-((other - patches[y, x]) ** 2).mean() / 100.0)
                total, norm = total + w * other[24], norm + w
        out[y, x] = math.floor(total / norm + 0.5) / 255 * (high - low) + low
    return out


def plain_wavelet(z, valid):
    """Analysis by explicit sums, synthesis by solving for the image whose coefficients these are (least squares)."""
    h = [(1 + 3**0.5) / (4 * 2**0.5), (3 + 3**0.5) / (4 * 2**0.5), (3 - 3**0.5) / (4 * 2**0.5), (1 - 3**0.5) / (4 * 2**0.5)]
    g = [h[3], -h[2], h[1], -h[0]]

    def matrix(n, f):
        rows = np.zeros(((n + 3) // 2, n))
        for k in range(len(rows)):
            for i, c in enumerate(f):
                j = 2 * k - 2 + i
                j = -1 - j if j < 0 else 2 * n - 1 - j if j >= n else j
                rows[k, j] += c
        return rows

    def dual(n, f):
        """Value j of the signal is the sum over k of f[j - 2 k + 2] times coefficient k."""
        rows = np.zeros((n, (n + 3) // 2))
        for k in range(rows.shape[1]):
            for i, c in enumerate(f):
                if 0 <= 2 * k - 2 + i < n:
                    rows[2 * k - 2 + i, k] += c
        return rows

    n, m = z.shape
    L, H, l2, h2 = matrix(n, h), matrix(n, g), matrix(m, h), matrix(m, g)
    low, bands = L @ z @ l2.T, [L @ z @ h2.T, H @ z @ l2.T, H @ z @ h2.T]
    limit = np.median(np.abs(bands[2])) / 0.6745 * math.sqrt(2 * math.log(z.size))
    soft = lambda x: np.sign(x) * np.maximum(np.abs(x) - limit, 0)
    a, b = low.shape
    A, B, a2, b2 = matrix(a, h), matrix(a, g), matrix(b, h), matrix(b, g)
    second = [soft(A @ low @ b2.T), soft(B @ low @ a2.T), soft(B @ low @ b2.T)]
    DA, DB, da, db = dual(a, h), dual(a, g), dual(b, h), dual(b, g)
    low = DA @ (A @ low @ a2.T) @ da.T + DA @ second[0] @ db.T + DB @ second[1] @ da.T + DB @ second[2] @ db.T
    DL, DH, dl, dh = dual(n, h), dual(n, g), dual(m, h), dual(m, g)
    bands = [soft(x) for x in bands]
    return DL @ low @ dl.T + DL @ bands[0] @ dh.T + DH @ bands[1] @ dl.T + DH @ bands[2] @ dh.T


def plain_feature_preserving(z, valid):
    z, limit = z.copy(), math.cos(math.radians(15))
    for _ in range(3):
        gy, gx = np.gradient(z, 30.0)
        new = z.copy()
        for y, x in np.ndindex(z.shape):
            total = weight = 0.0
            own = (gx[y, x], gy[y, x], math.sqrt(gx[y, x] ** 2 + gy[y, x] ** 2 + 1))
            for dy in range(-2, 3):
                for dx in range(-2, 3):
                    a, b = at(gx, y + dy, x + dx), at(gy, y + dy, x + dx)
                    cosine = (a * own[0] + b * own[1] + 1) / (math.sqrt(a * a + b * b + 1) * own[2])
                    if cosine > limit:
                        w = (cosine - limit) ** 2
                        total += w * (at(z, y + dy, x + dx) - a * dx * 30 - b * dy * 30)
                        weight += w
            if weight > 0:
                new[y, x] = total / weight
        z = new
    return z


PLAIN = {
    "tv": plain_tv,
    "anisotropic": plain_anisotropic,
    "wavelet": plain_wavelet,
    "gaussian": plain_gaussian,
    "bilateral": plain_bilateral,
    "adaptive": plain_adaptive,
    "nlm": plain_nlm,
    "feature_preserving": plain_feature_preserving,
}


@pytest.mark.parametrize("method", denoise.METHODS)
def test_noisy_raster_against_loops(spark, method):
    z = noisy(17, 14)
    z[3, 4] += 20
    holes = {(0, 0), (5, 6), (16, 13), (9, 2)}
    values = [[None if (y, x) in holes else z[y, x] for x in range(14)] for y in range(17)]
    valid = np.array([[v is not None for v in row] for row in values])
    filled = np.where(valid, z, z[valid].mean())
    want = PLAIN[method](filled, valid)
    got = back(denoise.denoise(raster(spark, values), method), "elevation_denoised", z.shape)
    assert (np.isnan(got) == ~valid).all()
    assert np.abs(want - filled)[valid].max() > 1e-3  # the filter does something here
    assert np.allclose(got[valid], want[valid], atol=1e-9)


@pytest.mark.parametrize(
    ("method", "options"),
    [
        ("tv", {"iterations": 4}),
        ("anisotropic", {"iterations": 4}),
        ("wavelet", {}),
        ("gaussian", {}),
        ("bilateral", {}),
        ("adaptive", {}),
        ("nlm", {"patch": 1, "search": 3}),
        ("feature_preserving", {"iterations": 2, "r": 1}),
    ],
)
def test_tiles_are_seamless(spark, method, options):
    z = noisy(75, 133) if method == "wavelet" else noisy(53, 41)
    df = raster(spark, [[None if (y * 7 + x) % 101 == 0 else v for x, v in enumerate(row)] for y, row in enumerate(z)])
    whole = back(denoise.denoise(df, method, **options), "elevation_denoised", z.shape)
    tiled = back(denoise.denoise(df, method, tile=4, **options), "elevation_denoised", z.shape)
    assert np.allclose(whole, tiled, atol=1e-9, equal_nan=True)


def test_nodata_and_unknown_methods(spark):
    df = raster(spark, [[1.0, -9.0, 3.0], [4.0, 5.0, None]])
    got = back(denoise.denoise(df, "gaussian", nodata=-9.0), "elevation_denoised", (2, 3))
    assert got[0, 1] == -9.0 and got[1, 2] == -9.0 and 1 < got[0, 0] < 5
    with pytest.raises(ValueError):
        denoise.denoise(df, "median")
    with pytest.raises(ValueError):
        denoise.anisotropic(np.zeros((2, 2)), np.ones((2, 2), bool), gamma=0.3)
    assert denoise.denoise(df.limit(0), "tv").count() == 0


@pytest.mark.parametrize("shape", [(8, 8), (9, 13), (3, 40), (6, 3)])
def test_wavelet_without_a_limit_changes_nothing(shape):
    z = noisy(*shape)
    assert np.allclose(denoise.wavelet(z, 0.0, denoise.wavelet_levels(*shape)), z)
