"""Band power: by FFT over Arrow batches, and as a relational transform."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Name, from, to (excluded), in Hz.
BANDS = (("delta", 1.0, 4.0), ("theta", 4.0, 8.0), ("alpha", 8.0, 13.0), ("beta", 13.0, 30.0), ("gamma", 30.0, 45.0))


def bands_at(rate: float) -> list[tuple[str, float, float]]:
    """The bands below half the rate, or one broad band if there is none."""
    fit = [b for b in BANDS if b[2] <= rate / 2]
    return fit or [("broadband", 0.0, max(0.5, rate / 2))]


def powers(x: np.ndarray, rate: float, bands: list[tuple[str, float, float]]) -> np.ndarray:
    """[..., band]: mean squared magnitude of the bins in each band, 0 for a
    band without bins: the spectrum times a bin-by-band matrix of shares."""
    n = x.shape[-1]
    if n == 0:
        return np.zeros((*x.shape[:-1], len(bands)))
    hz = np.fft.rfftfreq(n, 1.0 / rate)
    edges = np.array([(low, high) for _, low, high in bands]).reshape(-1, 2)
    inside = (hz[:, None] >= edges[:, 0]) & (hz[:, None] < edges[:, 1])
    count = inside.sum(0)
    spectrum = np.fft.rfft(np.asarray(x, np.float64))
    return np.where(count > 0, (spectrum.real**2 + spectrum.imag**2) @ (inside / np.maximum(count, 1)), 0.0)


def band_power(samples: Column, rate: Column) -> Column:
    """array<struct<band, power>> of a series; NaN where the series has one."""

    @F.pandas_udf("array<struct<band:string,power:double>>")
    def run(x: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([[{"band": b[0], "power": float(v)} for b, v in zip(bands_at(f), powers(np.asarray(s, np.float64), f, bands_at(f)))] for s, f in zip(x, r)])

    # NaN comes back from pandas as null
    return F.transform(run(samples, rate), lambda b: F.struct(b["band"].alias("band"), F.coalesce(b["power"], F.lit(float("nan"))).alias("power")))


def relational_band_power(vectors: DataFrame, item: str, vector: str, rate: float, length: int, bands: list[tuple[str, float, float]] | None = None) -> DataFrame:
    """item, band, power as joins and sums: samples x bins of the bands. The
    bins are a literal table (length / 2 rows at most). For short series; long
    ones go through the FFT."""
    bands = bands or bands_at(rate)
    bins = [(k, name) for k in range(length // 2 + 1) for name, low, high in bands if low <= k * rate / length < high]
    if not bins:
        return vectors.select(item, F.explode(F.array(*[F.lit(b[0]) for b in bands])).alias("band"), F.lit(0.0).alias("power"))
    table = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(b).alias("band")) for k, b in bins]))
    long = vectors.select(item, table.alias("_b"), vector).select(item, "_b.k", "_b.band", F.posexplode(vector).alias("n", "x"))
    angle = F.lit(-2.0 * math.pi / length) * F.pmod(F.col("k") * F.col("n"), F.lit(length))
    parts = long.groupBy(item, "band", "k").agg(F.sum(F.col("x").cast("double") * F.cos(angle)).alias("re"), F.sum(F.col("x").cast("double") * F.sin(angle)).alias("im"))
    return parts.groupBy(item, "band").agg(F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def marginals(difference: DataFrame, group: list[str], value: str = "difference") -> DataFrame:
    """group, axis, name, score: means over the two other axes, NaN skipped;
    one pass over grouping sets."""
    good = F.when(~F.isnan(value), F.col(value))
    sets = [[*map(F.col, group), F.col(a)] for a in ("band", "channel", "phase")]
    cols = [*map(F.col, group), F.col("band"), F.col("channel"), F.col("phase")]
    out = difference.groupingSets(sets, *cols).agg(F.avg(good).alias("score"))
    axis = F.when(F.col("band").isNotNull(), "band").when(F.col("channel").isNotNull(), "channel").otherwise("phase")
    return out.select(*group, axis.alias("axis"), F.coalesce("band", "channel", "phase").alias("name"), "score")


#: The most names kept of each axis.
DOMINANT = {"band": 3, "channel": 6, "phase": 3}


def dominant(scores: DataFrame, group: list[str], order: str) -> DataFrame:
    """The strongest names of each axis: by score, then by ``order`` from the
    end; names without a score come last."""
    most = F.when(F.col("axis") == "channel", DOMINANT["channel"]).otherwise(DOMINANT["band"])
    place = Window.partitionBy(*group, "axis").orderBy(F.col("score").desc_nulls_last(), F.col(order).desc())
    return scores.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= most)
