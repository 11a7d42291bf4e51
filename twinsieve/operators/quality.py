"""Image quality: seven measures, a bonus for the file name, a weighted total; measures run over decoded images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.functions.names import basename, filename_bonus
from twinsieve.functions.vectors import clamp, half_even

# Weights of the measures.
WEIGHTS = {"resolution": 0.20, "sharpness": 0.30, "exposure": 0.15, "contrast": 0.10, "noise": 0.05, "color_richness": 0.15, "edge_integrity": 0.05}


def gray(bgr: np.ndarray) -> np.ndarray:
    """Luma of a BGR image, rounded to whole levels."""
    return np.floor(bgr[..., 0] * 0.114 + bgr[..., 1] * 0.587 + bgr[..., 2] * 0.299 + 0.5)


def _window(x: np.ndarray, r: int, mode: str = "reflect") -> np.ndarray:
    return np.pad(x, r, mode=mode if min(x.shape) > r else "edge")


def laplacian(g: np.ndarray) -> np.ndarray:
    p = _window(g, 1)
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g


def canny(g: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Edges: 3 x 3 Sobel, L1 gradient, thinning along four directions, hysteresis by 8 neighbours."""
    p = _window(g, 1, "edge")
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    m = np.abs(gx) + np.abs(gy)
    q = np.pad(m, 1)
    at = lambda dy, dx: q[1 + dy : q.shape[0] - 1 + dy, 1 + dx : q.shape[1] - 1 + dx]
    t = np.tan(np.pi / 8)
    flat, steep = np.abs(gy) <= t * np.abs(gx), np.abs(gx) <= t * np.abs(gy)
    falling = gx * gy < 0
    before = np.select([flat, steep, falling], [at(0, -1), at(-1, 0), at(-1, 1)], at(-1, -1))
    after = np.select([flat, steep, falling], [at(0, 1), at(1, 0), at(1, -1)], at(1, 1))
    thin = (m > before) & (m >= after) & (m > low)
    edge = thin & (m > high)
    while True:
        e = np.pad(edge, 1)
        near = np.zeros_like(edge)
        for dy in range(3):
            for dx in range(3):
                near |= e[dy : dy + edge.shape[0], dx : dx + edge.shape[1]]
        new = thin & near
        if (new == edge).all():
            return edge
        edge = new


def measures(bgr: np.ndarray) -> dict[str, float]:
    """The measures of one uint8 BGR image but for resolution, each 0 to 100."""
    g = gray(bgr.astype(float))
    light, ratio = g.mean(), canny(g).mean()
    # Channel differences wrap round, as whole bytes do.
    b, gr, r = bgr[..., 0], bgr[..., 1], bgr[..., 2]
    colour = np.mean([(r - gr).std(), (r - b).std(), (gr - b).std()])
    c = int(min(g.shape) * 0.1)
    h, w = g.shape
    corners = [g[:c, :c], g[:c, w - c :], g[h - c :, :c], g[h - c :, w - c :]] if c else [g]
    black = sum(bool(x.size) and x.mean() < 30 for x in corners)
    if ratio < 0.05:
        noise = ratio / 0.05 * 100
    else:
        noise = 100.0 if ratio <= 0.15 else max(0.0, 100 - (ratio - 0.15) / 0.15 * 100)
    return {
        "sharpness": min(100.0, laplacian(g).var() / 500 * 100), "exposure": max(0.0, 100 - abs(light - 127) / 127 * 100), "contrast": min(100.0, g.std() / 70 * 100), "noise": noise,
        "color_richness": 0.0 if colour < 5 else 100.0 if colour > 30 else colour / 30 * 100, "edge_integrity": (100.0, 80.0, 40.0, 0.0, 0.0)[black],
    }


def saturation(bgr: np.ndarray) -> float:
    """Mean HSV saturation, 0 to 255."""
    x = bgr.astype(float)
    top, low = x.max(axis=2), x.min(axis=2)
    return float(np.where(top > 0, (top - low) * 255 / np.where(top > 0, top, 1), 0).mean())


def bgr_of(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Pixels of Spark's image source as BGR; gray ones are repeated, alpha is dropped."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else x[..., :3]


def total(measure: dict[str, Column], bonus: Column) -> Column:
    return clamp(sum((w * measure[k] for k, w in WEIGHTS.items()), F.lit(0.0)) + bonus, 0.0, 100.0)


def score(images: DataFrame) -> DataFrame:
    """``images(filename, image)`` of the image source -> measures, bonus, total, error; one row per image.

    An image that cannot be decoded (height below 1) has zeros and an error.
    """
    names = [k for k in WEIGHTS if k != "resolution"]
    schema = "filename string, height int, width int, " + ", ".join(f"{k} double" for k in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, h, w, c, data in b.itertuples(index=False):
                m = measures(bgr_of(h, w, c, data)) if h > 0 and w > 0 else dict.fromkeys(names)
                rows.append((name, h, w, *[m[k] for k in names]))
            yield pd.DataFrame(rows, columns=["filename", "height", "width", *names])

    flat = images.select("filename", *[F.col(f"image.{c}").alias(c) for c in ("height", "width", "nChannels", "data")])
    m = flat.mapInPandas(run, schema)
    bad = F.col("height") < 1
    res = F.least(F.lit(100.0), F.col("height").cast("double") * F.col("width") / 1e6 / 12 * 100)
    cols = {"resolution": res} | {k: F.col(k) for k in names}
    safe = {k: F.when(bad, 0.0).otherwise(c) for k, c in cols.items()}
    bonus = F.when(bad, 0.0).otherwise(filename_bonus(basename(F.col("filename"))))
    return m.select("filename", *[c.alias(k) for k, c in safe.items()], bonus.alias("filename_bonus"), F.when(bad, 0.0).otherwise(total(safe, bonus)).alias("total"), F.when(bad, "cannot be read").alias("error"))


def rounded(scored: DataFrame) -> DataFrame:
    """Measures, bonus and total to two decimal digits, half to even, as they are shown."""
    return scored.select(*[half_even(F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in scored.dtypes])


def sharpness_and_saturation(images: DataFrame) -> DataFrame:
    """``images(filename, image)`` -> (filename, sharpness, saturation): variance of the Laplacian and mean saturation; 0 where nothing can be decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, h, w, c, data in b.itertuples(index=False):
                x = bgr_of(h, w, c, data) if h > 0 and w > 0 else None
                rows.append((name, 0.0, 0.0) if x is None else (name, float(laplacian(gray(x.astype(float))).var()), saturation(x)))
            yield pd.DataFrame(rows, columns=["filename", "sharpness", "saturation"])

    flat = images.select("filename", *[F.col(f"image.{c}").alias(c) for c in ("height", "width", "nChannels", "data")])
    return flat.mapInPandas(run, "filename string, sharpness double, saturation double")


def better_of(scored: DataFrame, sharp: float = 100, colour: float = 20) -> DataFrame:
    """``scored(group_id, id, sharpness, saturation)`` -> (group_id, id): good ones first, then sharper, then earlier."""
    good = ((F.col("sharpness") > sharp) & (F.col("saturation") > colour)).cast("int")
    top = scored.groupBy("group_id").agg(F.min(F.struct((-good).alias("g"), (-F.col("sharpness")).alias("s"), "id")).alias("m"))
    return top.select("group_id", "m.id")
