"""Quality bits, spectral indices and the pixel-local part of the cloud mask."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sunlattice.functions.numeric import finite, gt, lt, safe_div

BANDS = ("b01", "b02", "b03", "b04", "b8a", "b11", "b12")
#: Fixed: bit numbers of the quality byte; bits 6 and 7 are the aerosol level.
BITS = {"cirrus": 0, "cloud": 1, "adjacent": 2, "shadow": 3, "snow": 4, "water": 5}


def qa_bits(fmask: Column) -> dict[str, Column]:
    """Flags of the quality byte (0 to 255); a missing byte has no bit set."""
    f = F.coalesce(fmask.cast("int"), F.lit(0))
    aerosol = F.shiftright(f, 6).bitwiseAND(3)
    flags = {name: F.getbit(f, F.lit(bit)) == 1 for name, bit in BITS.items()}
    return flags | {"aerosol_moderate": aerosol == 2, "aerosol_high": aerosol == 3}


def qa_mask(fmask: Column) -> Column:
    q = qa_bits(fmask)
    return (q["cloud"] | q["cirrus"] | q["shadow"] | q["adjacent"]).cast("int")


def indices() -> dict[str, Column]:
    """ndwi, hot, vis_mean, vis_std (population), whiteness, blue_nir, coastal_swir of the band columns."""
    b = {name: F.col(name).cast("double") for name in BANDS}
    visible = [b["b01"], b["b02"], b["b03"], b["b04"]]
    mean = (visible[0] + visible[1] + visible[2] + visible[3]) / 4.0
    square = sum(((v - mean) * (v - mean) for v in visible[1:]), (visible[0] - mean) * (visible[0] - mean))
    std = F.sqrt(square / 4.0)
    return {
        "ndwi": safe_div(b["b03"] - b["b8a"], b["b03"] + b["b8a"]),
        "hot": b["b02"] - 0.5 * b["b04"] - 0.08,
        "vis_mean": mean,
        "vis_std": std,
        "whiteness": safe_div(std, mean + 1e-6),
        "blue_nir": safe_div(b["b02"], b["b8a"] + 1e-6),
        "coastal_swir": safe_div(b["b01"], b["b11"] + 1e-6),
    }


def cloud_spec() -> Column:
    """Bright, blue and white; on columns made by `indices`."""
    return (
        gt(F.col("vis_mean"), 0.23)
        & gt(F.col("b02"), 0.20)
        & gt(F.col("hot"), 0.04)
        & gt(F.col("blue_nir"), 0.90)
        & lt(F.col("whiteness"), 0.28)
    )


def haze_spec() -> Column:
    coastal = gt(F.col("b01"), 0.075) & gt(F.col("b02"), 0.070) & gt(F.col("coastal_swir"), 0.55)
    hot = gt(F.col("hot"), -0.01) & gt(F.col("blue_nir"), 0.58) & lt(F.col("b11"), 0.20)
    return (coastal | hot) & lt(F.col("whiteness"), 0.40) & gt(F.col("vis_mean"), 0.07)


def hybrid_parts(mode: str = "balanced") -> dict[str, Column]:
    """cloud, shadow and haze before morphology, on columns made by `indices`; unknown modes are balanced."""
    q = qa_bits(F.col("fmask"))
    thick = q["cloud"] | q["cirrus"] | q["shadow"] | q["adjacent"] | cloud_spec()
    invalid = q["water"] | q["snow"] | gt(F.col("ndwi"), 0.12)
    level = {
        "strict": q["aerosol_high"],
        "haze_sensitive": q["aerosol_moderate"] | q["aerosol_high"],
    }.get(mode, q["aerosol_high"] | (q["aerosol_moderate"] & gt(F.col("hot"), 0.0)))
    return {
        "cloud": q["cloud"] | q["cirrus"] | cloud_spec(),
        "shadow": q["shadow"],
        "haze": haze_spec() & level & ~invalid & ~thick,
    }


def valid_observation() -> Column:
    """All seven bands finite."""
    out = finite(F.col(BANDS[0]))
    for b in BANDS[1:]:
        out = out & finite(F.col(b))
    return out
