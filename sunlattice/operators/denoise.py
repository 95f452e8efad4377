"""Denoising filters of elevation rasters.

A raster is dealt out in square tiles, each with a halo as wide as the filter reaches, and every tile is filtered with
numpy in applyInPandas; only its own cells are kept. So a raster of any size spreads over many tasks, and the result is
that of the whole raster at once. What a filter needs to know of the whole raster (extent, mean, range, the spread of the
finest wavelet details) is aggregated before.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

METHODS = ("tv", "anisotropic", "wavelet", "gaussian", "bilateral", "adaptive", "nlm", "feature_preserving")
TILE = 512


def total_variation(image: np.ndarray, weight: float = 0.15, iterations: int = 50, tau: float = 0.125) -> np.ndarray:
    """Dual ascent with periodic differences, the dual field held in the unit ball; the image takes up its divergence in
    each iteration (there is no data term)."""
    out = image.astype(np.float64).copy()
    dual = np.zeros((2, *out.shape))
    for _ in range(iterations):
        dual += tau / weight * np.stack([np.roll(out, -1, axis=a) - out for a in (0, 1)])
        dual /= np.maximum(1.0, np.hypot(*dual))
        out += weight * sum(dual[a] - np.roll(dual[a], 1, axis=a) for a in (0, 1))
    return out


def anisotropic(image: np.ndarray, valid: np.ndarray, iterations: int = 20, kappa: float = 30.0, gamma: float = 0.15) -> np.ndarray:
    """Perona-Malik on four neighbours; a flow needs both cells valid."""
    if not 0 < gamma <= 0.25:
        raise ValueError("gamma must lie in (0, 0.25]")
    out = np.where(valid, image, 0.0).astype(np.float64)
    for _ in range(iterations):
        change = np.zeros_like(out)
        for axis in (0, 1):
            d = np.diff(out, axis=axis)
            ok = np.take(valid, range(1, valid.shape[axis]), axis) & np.take(valid, range(valid.shape[axis] - 1), axis)
            flow = np.where(ok, np.exp(-((d / kappa) ** 2)) * d, 0.0)
            pad = [(0, 0), (0, 0)]
            pad[axis] = (0, 1)
            change += np.pad(flow, pad)
            pad[axis] = (1, 0)
            change -= np.pad(flow, pad)
        out += gamma * change
    return np.where(valid, out, image)


def kernel_filter(image: np.ndarray, r: int, weigh: Callable[[int, int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Weighted mean over the square of radius r, edges replicated; weigh(dy, dx, shifted) gives the weights."""
    padded = np.pad(image, r, mode="edge")
    total, norm = np.zeros_like(image), np.zeros_like(image)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            shifted = padded[r + dy : r + dy + image.shape[0], r + dx : r + dx + image.shape[1]]
            w = weigh(dy, dx, shifted)
            total += w * shifted
            norm += w
    return total / norm


def gaussian(image: np.ndarray, sigma: float = 0.75) -> np.ndarray:
    r = max(1, int(np.ceil(3 * sigma)))
    return kernel_filter(image, r, lambda dy, dx, s: np.full_like(s, np.exp(-(dy * dy + dx * dx) / (2 * sigma * sigma))))


def bilateral(image: np.ndarray, sigma_distance: float = 0.75, sigma_value: float = 1.0) -> np.ndarray:
    r = max(1, int(np.ceil(3 * sigma_distance)))

    def weigh(dy: int, dx: int, s: np.ndarray) -> np.ndarray:
        near = -(dy * dy + dx * dx) / (2 * sigma_distance**2)
        return np.exp(near - (s - image) ** 2 / (2 * sigma_value**2))

    return kernel_filter(image, r, weigh)


def adaptive(image: np.ndarray, r: int = 2, threshold: float = 2.0) -> np.ndarray:
    """The window mean where a cell is more than `threshold` window deviations away from it."""
    mean = kernel_filter(image, r, lambda dy, dx, s: np.ones_like(s))
    square = kernel_filter(image * image, r, lambda dy, dx, s: np.ones_like(s))
    std = np.sqrt(np.maximum(square - mean * mean, 0.0))
    return np.where(np.abs(image - mean) > threshold * std, mean, image)


def non_local_means(image: np.ndarray, low: float, high: float, h: float = 10.0, patch: int = 3, search: int = 10) -> np.ndarray:
    """Means weighted by the similarity of patches, on values scaled to 8 bits between low and high; edges mirrored."""
    if high <= low:
        return np.full_like(image, low, dtype=np.float64)
    scaled = np.floor(np.clip((image - low) / (high - low), 0.0, 1.0) * 255.0)
    n, m = scaled.shape
    margin = patch + search
    padded = scaled
    for axis in (0, 1):  # mirrored without the edge cell, again and again if the raster is small
        size = scaled.shape[axis]
        at = np.abs(np.arange(-margin, size + margin))
        period = max(2 * size - 2, 1)
        at = at % period
        padded = np.take(padded, np.where(at < size, at, period - at), axis=axis)
    total, norm = np.zeros_like(scaled), np.zeros_like(scaled)
    size = 2 * patch + 1
    own = padded[search : search + n + 2 * patch, search : search + m + 2 * patch]
    for dy in range(-search, search + 1):
        for dx in range(-search, search + 1):
            other = padded[search + dy : search + dy + n + 2 * patch, search + dx : search + dx + m + 2 * patch]
            sums = np.pad(((other - own) ** 2).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
            d = sums[size:, size:] - sums[:-size, size:] - sums[size:, :-size] + sums[:-size, :-size]
            w = np.exp(-d / size**2 / (h * h))
            total += w * other[patch : patch + n, patch : patch + m]
            norm += w
    return np.floor(total / norm + 0.5) / 255.0 * (high - low) + low


#: The Daubechies filter with two vanishing moments.
DB2 = np.array([1 + np.sqrt(3), 3 + np.sqrt(3), 3 - np.sqrt(3), 1 - np.sqrt(3)]) / (4 * np.sqrt(2))
_HIGH = DB2[::-1] * np.array([1, -1, 1, -1])


def _split(x: np.ndarray, f: np.ndarray, axis: int) -> np.ndarray:
    """Every second value of the filtered signal, ends mirrored with the edge value; value k looks at 2 k - 2 to 2 k + 1."""
    n = x.shape[axis]
    at = np.arange(-2, n + 3) % (2 * n)
    wide = np.take(x, np.where(at < n, at, 2 * n - 1 - at), axis=axis)
    count = (n + 3) // 2
    return sum(c * np.take(wide, np.arange(count) * 2 + i, axis=axis) for i, c in enumerate(f))


def _join(low: np.ndarray, high: np.ndarray, axis: int) -> np.ndarray:
    """The signal of both halves; one value more than there were if that number was odd."""
    n = 2 * low.shape[axis] - 2
    out = 0.0
    for part, f in ((low, DB2), (high, _HIGH)):
        for i, c in enumerate(f):  # value k adds to 2 k - 2 + i
            at = np.arange(n) + 2 - i
            out = out + c * np.where(
                np.expand_dims(at % 2 == 0, 1 - axis), np.take(part, at // 2 % part.shape[axis], axis=axis), 0.0
            )
    return out


def _details(image: np.ndarray, levels: int) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    low, details = image.astype(np.float64), []
    for _ in range(levels):
        a, d = _split(low, DB2, 0), _split(low, _HIGH, 0)
        details.append([_split(a, _HIGH, 1), _split(d, DB2, 1), _split(d, _HIGH, 1)])
        low = _split(a, DB2, 1)
    return low, details


def wavelet_levels(height: int, width: int, levels: int = 2) -> int:
    return max(1, min(levels, int(np.floor(np.log2(max(min(height, width), 1) / 3))))) if min(height, width) >= 3 else 1


def wavelet(image: np.ndarray, limit: float, levels: int = 2) -> np.ndarray:
    """db2 over some levels, mirrored edges; all details are soft-thresholded at `limit`."""
    low, details = _details(image, levels)
    for ad, da, dd in reversed(details):
        ad, da, dd = (np.sign(x) * np.maximum(np.abs(x) - limit, 0) for x in (ad, da, dd))
        low = low[: ad.shape[0], : ad.shape[1]]
        low = _join(_join(low, ad, 1), _join(da, dd, 1), 0)
    return low[: image.shape[0], : image.shape[1]]


def feature_preserving(image: np.ndarray, r: int = 2, max_angle: float = 15.0, iterations: int = 3, cell: float = 30.0) -> np.ndarray:
    """Smooths surface normals that differ by less than max_angle, then moves cells towards planes of neighbours."""
    out = image.astype(np.float64).copy()
    limit = np.cos(np.radians(max_angle))
    for _ in range(iterations):
        gy, gx = np.gradient(out, cell) if min(out.shape) > 1 else (np.zeros_like(out), np.zeros_like(out))
        norm = np.sqrt(gx * gx + gy * gy + 1)
        pads = [np.pad(x, r, mode="edge") for x in (out, gx, gy, norm)]
        total, weight = np.zeros_like(out), np.zeros_like(out)
        for dy in range(-r, r + 1):
            for dx in range(-r, r + 1):
                z, x, y, n = (p[r + dy : r + dy + out.shape[0], r + dx : r + dx + out.shape[1]] for p in pads)
                cosine = (x * gx + y * gy + 1) / (n * norm)
                w = np.where(cosine > limit, (cosine - limit) ** 2, 0.0)
                total += w * (z - x * dx * cell - y * dy * cell)
                weight += w
        out = np.where(weight > 0, total / np.where(weight > 0, weight, 1), out)
    return out


def reach(method: str, options: dict) -> int:
    """How far, in cells, a filter's result depends on values."""
    if method in ("gaussian", "bilateral"):
        return max(1, int(np.ceil(3 * options.get("sigma" if method == "gaussian" else "sigma_distance", 0.75))))
    if method == "tv":
        return options.get("iterations", 50)
    if method == "anisotropic":
        return options.get("iterations", 20)
    if method == "feature_preserving":
        return options.get("iterations", 3) * (options.get("r", 2) + 1)
    if method == "nlm":
        return options.get("patch", 3) + options.get("search", 10)
    return 16 if method == "wavelet" else options.get("r", 2)


def _tiles(at: Column, first: Column, last: Column, tile: int, halo: int, period: bool) -> Column:
    """The tiles of an axis that see a cell: structs (tile, place), a place being that of the cell or of a copy around."""
    n = last - first + 1
    count = F.ceil(n / F.lit(tile)).cast("int")
    copies = F.array(at - first, at - first - n, at - first + n) if period else F.array(at - first)

    def of(place: Column) -> Column:
        low = F.greatest(F.floor((place - halo) / F.lit(tile)), F.lit(0)).cast("int")
        high = F.least(F.floor((place + halo) / F.lit(tile)), count - 1).cast("int")
        near = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
        # a tile ends where the raster does
        seen = F.filter(near, lambda t: (place >= t * tile - halo) & (place < F.least((t + 1) * tile, n) + halo))
        return F.transform(seen, lambda t: F.struct(t.alias("tile"), place.cast("int").alias("place")))

    alone = F.array(F.struct(F.lit(0).alias("tile"), (at - first).cast("int").alias("place")))
    return F.when(count == 1, alone).otherwise(F.flatten(F.transform(copies, of)))


def denoise(
    df: DataFrame,
    method: str = "feature_preserving",
    value: str = "elevation",
    nodata: float | None = None,
    keys: tuple[str, ...] = ("raster_id",),
    tile: int = TILE,
    **options,
) -> DataFrame:
    """`df` with <value>_denoised. Missing cells are filled with the mean of valid ones, filtered, and missing again.

    Cells that the raster's box has but the table hasn't count as missing. The total variation filter wraps around.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    k, halo = list(keys), reach(method, options)
    tile = max(tile, 4 * halo) // 4 * 4
    z = F.col(value).cast("double")
    valid = z.isNotNull() & ~F.isnan(z) & (F.abs(z) != float("inf"))
    if nodata is not None:
        valid = valid & (z != nodata)
    boxes = df.groupBy(*k).agg(
        *[f(c).alias(f"_{n}_{c}") for c in ("yi", "xi") for n, f in (("lo", F.min), ("hi", F.max))],
        F.avg(F.when(valid, z)).alias("_mean"),
        F.min(F.when(valid, z)).alias("_low"),
        F.max(F.when(valid, z)).alias("_high"),
    )
    axes = [_tiles(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}"), tile, halo, method == "tv") for c in ("yi", "xi")]
    placed = df.select(*k, "yi", "xi", F.when(valid, z).alias("_z")).join(boxes, k)
    placed = placed.select("*", F.explode(axes[0]).alias("_y")).select("*", F.explode(axes[1]).alias("_x"))
    names = {"_ty": "_y.tile", "_tx": "_x.tile", "_py": "_y.place", "_px": "_x.place"}
    placed = placed.select("*", *[F.col(c).alias(n) for n, c in names.items()]).drop("_y", "_x")
    cells = [*k, "_ty", "_tx"]

    def dense(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int, int, tuple[int, int]]:
        """A tile and its halo: filled values, which are valid, where it begins, the raster's height and width."""
        first = pdf.iloc[0]
        shape = tuple(int(first[f"_hi_{c}"] - first[f"_lo_{c}"]) + 1 for c in ("yi", "xi"))
        begin, end = [], []
        for size, own in zip(shape, (int(first["_ty"]), int(first["_tx"])), strict=True):
            one = size <= tile
            around = method == "tv" and not one
            begin.append(0 if one else own * tile - halo if around else max(0, own * tile - halo))
            stop = min((own + 1) * tile, size)
            end.append(size if one else stop + halo if around else min(size, stop + halo))
        y, x = pdf["_py"].to_numpy() - begin[0], pdf["_px"].to_numpy() - begin[1]
        image = np.full((end[0] - begin[0], end[1] - begin[1]), np.nan)
        image[y, x] = pdf["_z"].to_numpy(dtype=float)
        known = np.isfinite(image)
        return np.where(known, image, first["_mean"]), known, begin[0], begin[1], shape

    if method == "wavelet":

        def finest(pdf: pd.DataFrame) -> pd.DataFrame:
            full, _, y0, x0, shape = dense(pdf)
            dd = np.abs(_details(full, 1)[1][0][2])
            for axis, (start, size, own) in enumerate(zip((y0, x0), shape, (int(pdf["_ty"].iloc[0]), int(pdf["_tx"].iloc[0])), strict=True)):
                number = np.arange(dd.shape[axis]) + start // 2
                last = size <= (own + 1) * tile
                mine = (2 * number >= own * tile) & (last | (2 * number < (own + 1) * tile))
                dd = dd[mine] if axis == 0 else dd[:, mine]
            first = pdf.iloc[0]
            return pd.DataFrame({c: [first[c]] * dd.size for c in k} | {"detail": dd.ravel()})

        kinds = {f.name: f.dataType for f in df.schema.fields}
        schema = T.StructType([*[T.StructField(c, kinds[c]) for c in k], T.StructField("detail", T.DoubleType())])
        spread = placed.groupBy(*cells).applyInPandas(finest, schema).groupBy(*k).agg(F.median("detail").alias("_detail"))
        placed = placed.join(spread, k)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        full, known, y0, x0, shape = dense(pdf)
        first = pdf.iloc[0]
        if method == "anisotropic":
            out = anisotropic(full, known, **options)
        elif method == "nlm":
            out = non_local_means(full, first["_low"], first["_high"], **options)
        elif method == "wavelet":
            limit = first["_detail"] / 0.6745 * np.sqrt(2 * np.log(shape[0] * shape[1]))
            out = wavelet(full, limit, wavelet_levels(*shape, **options))
        else:
            out = _FILTERS[method](full, **options)
        y, x = pdf["_py"].to_numpy(), pdf["_px"].to_numpy()
        own = np.ones(len(pdf), bool)
        for at, size, number in ((y, shape[0], int(first["_ty"])), (x, shape[1], int(first["_tx"]))):
            own &= (at // tile == number) & (at >= 0) & (at < size) if size > tile else True
        result = pdf[own][[*k, "yi", "xi"]].copy()
        result["_out"] = out[y[own] - y0, x[own] - x0]
        return result

    fields = {f.name: f for f in df.schema.fields}
    schema = T.StructType([fields[c] for c in (*k, "yi", "xi")] + [T.StructField("_out", T.DoubleType())])
    filtered = placed.groupBy(*cells).applyInPandas(run, schema)
    missing = F.lit(None if nodata is None else float(nodata)).cast("double")
    both = df.join(filtered, [*k, "yi", "xi"], "left").withColumn(f"{value}_denoised", F.when(valid, F.col("_out")).otherwise(missing))
    return both.select(*df.columns, f"{value}_denoised")


_FILTERS: dict[str, Callable[..., np.ndarray]] = {
    "tv": total_variation,
    "gaussian": gaussian,
    "bilateral": bilateral,
    "adaptive": adaptive,
    "feature_preserving": feature_preserving,
}
