"""From images to vectors: augment, embed each variant, average, normalize."""

from __future__ import annotations

import zlib
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.functions import pixels
from twinsieve.operators.quality import bgr_of


class Extractor(ABC):
    """A model that turns a batch of normalized images into vectors. ``load`` runs once in each worker."""

    dim: int

    def load(self) -> None:  # noqa: B027
        """Reads weights; nothing by default."""

    @abstractmethod
    def embed(self, batch: np.ndarray) -> np.ndarray:
        """[n, height, width, 3] -> [n, dim]"""


class GridExtractor(Extractor):
    """A deterministic extractor without a network: mean, deviation and gradient energy of grid cells, not negative."""

    def __init__(self, grid: int = 8):
        self.grid, self.dim = grid, 4 * grid * grid

    def embed(self, batch: np.ndarray) -> np.ndarray:
        g, n = self.grid, len(batch)
        x = batch.mean(axis=3)
        h, w = x.shape[1] // g * g, x.shape[2] // g * g
        cells = lambda v: v[:, :h, :w].reshape(n, g, h // g, g, w // g)
        parts = [cells(x).mean(axis=(2, 4)), cells(x).std(axis=(2, 4)), cells(np.abs(np.gradient(x, axis=1))).mean(axis=(2, 4)), cells(np.abs(np.gradient(x, axis=2))).mean(axis=(2, 4))]
        return np.maximum(0, np.concatenate([p.reshape(n, -1) for p in parts], axis=1))


def extract(images: DataFrame, model: Extractor, variants: Callable = pixels.batch_set, size: int = 224, batch: int = 24, unit: bool = True, seed: int = 0, keep_bad: bool = False) -> DataFrame:
    """``images(filename, image)`` -> (filename, features): the mean over the variants of each image.

    An image that cannot be decoded gives no row, or with ``keep_bad`` the row that an
    image of zeros gives. Noise is seeded by the file name.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model.load()
        for frame in frames:
            rows = []
            for name, h, w, c, data in frame.itertuples(index=False):
                bad = h < 1 or w < 1
                if bad and not keep_bad:
                    continue
                rng = np.random.default_rng([seed, zlib.crc32(name.encode())])
                x = np.zeros((size, size, 3)) if bad else pixels.resize(pixels.grayscale(bgr_of(h, w, c, data)[..., ::-1] / 255.0), size, size)
                all_ = [pixels.channel_normalize(v) for v in variants(x, rng)]
                v = np.concatenate([model.embed(np.stack(all_[i : i + batch])) for i in range(0, len(all_), batch)]).mean(axis=0)
                n = np.linalg.norm(v)
                rows.append((name, v / n if unit and n > 0 else v))
            yield pd.DataFrame(rows, columns=["filename", "features"])

    flat = images.select("filename", *[F.col(f"image.{c}").alias(c) for c in ("height", "width", "nChannels", "data")])
    return flat.mapInPandas(run, "filename string, features array<double>")


def pool(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """Element-wise mean of all vectors of a key."""
    per = vectors.select(key, F.posexplode(vec).alias("dim", "x")).groupBy(key, "dim").agg(F.avg("x").alias("x"))
    return per.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias(vec))
