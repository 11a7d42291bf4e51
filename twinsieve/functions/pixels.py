"""Image operations on float arrays [height, width, 3] from 0 to 1, and the two augmentation sets."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

# Channel means and deviations that networks trained on the usual photo collection expect.
MEAN, STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
LUMA = np.array([0.299, 0.587, 0.114])


def grayscale(x: np.ndarray) -> np.ndarray:
    return np.repeat((x @ LUMA)[..., None], 3, axis=2)


def sample(x: np.ndarray, rows: np.ndarray, cols: np.ndarray, outside: float | None = None) -> np.ndarray:
    """Bilinear values at real positions; beyond the edge the edge, or ``outside``."""
    h, w = x.shape[:2]
    r, c = np.clip(rows, 0, h - 1), np.clip(cols, 0, w - 1)
    r0, c0 = np.floor(r).astype(int), np.floor(c).astype(int)
    r1, c1 = np.minimum(r0 + 1, h - 1), np.minimum(c0 + 1, w - 1)
    fr, fc = (r - r0)[..., None], (c - c0)[..., None]
    out = (x[r0, c0] * (1 - fc) + x[r0, c1] * fc) * (1 - fr) + (x[r1, c0] * (1 - fc) + x[r1, c1] * fc) * fr
    if outside is not None:
        out[(rows < -0.5) | (rows > h - 0.5) | (cols < -0.5) | (cols > w - 0.5)] = outside
    return out


def resize(x: np.ndarray, height: int = 224, width: int = 224) -> np.ndarray:
    rows = (np.arange(height) + 0.5) * x.shape[0] / height - 0.5
    cols = (np.arange(width) + 0.5) * x.shape[1] / width - 0.5
    return sample(x, *np.meshgrid(rows, cols, indexing="ij"))


def rotate(x: np.ndarray, degrees: float) -> np.ndarray:
    if degrees % 90 == 0 and x.shape[0] == x.shape[1]:
        return np.rot90(x, int(degrees // 90) % 4)
    t, (h, w) = np.deg2rad(degrees), x.shape[:2]
    r, c = np.meshgrid(np.arange(h) - (h - 1) / 2, np.arange(w) - (w - 1) / 2, indexing="ij")
    return sample(x, c * np.sin(t) + r * np.cos(t) + (h - 1) / 2, c * np.cos(t) - r * np.sin(t) + (w - 1) / 2, 0.0)


def crop(x: np.ndarray, share: float) -> np.ndarray:
    """The centre, of ``share`` of each side, at the old size."""
    h, w = x.shape[:2]
    a, b = max(1, int(h * share)), max(1, int(w * share))
    return resize(x[(h - a) // 2 : (h - a) // 2 + a, (w - b) // 2 : (w - b) // 2 + b], h, w)


def convolve(x: np.ndarray, k: np.ndarray, mode: str = "reflect") -> np.ndarray:
    r = k.shape[0] // 2
    p = np.pad(x, ((r, r), (r, r), (0, 0)), mode=mode if min(x.shape[:2]) > r or mode == "constant" else "edge")
    return sum(k[i, j] * p[i : i + x.shape[0], j : j + x.shape[1]] for i in range(k.shape[0]) for j in range(k.shape[1]))


def gaussian(x: np.ndarray, size: int = 3, sigma: float = 1.0, mode: str = "constant") -> np.ndarray:
    g = np.exp(-0.5 * (np.arange(size) - size // 2) ** 2 / sigma**2)
    return convolve(x, np.outer(g, g) / g.sum() ** 2, mode)


def box(x: np.ndarray, size: int = 3, mode: str = "constant") -> np.ndarray:
    return convolve(x, np.full((size, size), 1 / size**2), mode)


def median(x: np.ndarray, size: int = 3) -> np.ndarray:
    r = size // 2
    p = np.pad(x, ((r, r), (r, r), (0, 0)), mode="edge")
    return np.median(np.stack([p[i : i + x.shape[0], j : j + x.shape[1]] for i in range(size) for j in range(size)]), axis=0)


def brightness(x: np.ndarray, f: float) -> np.ndarray:
    return np.clip(x * f, 0, 1)


def contrast(x: np.ndarray, f: float) -> np.ndarray:
    mean = (x @ LUMA).mean()
    return np.clip(mean + (x - mean) * f, 0, 1)


def saturate(x: np.ndarray, f: float) -> np.ndarray:
    g = grayscale(x)
    return np.clip(g + (x - g) * f, 0, 1)


def sharpness(x: np.ndarray, f: float) -> np.ndarray:
    soft = convolve(x, np.array([[1, 1, 1], [1, 5, 1], [1, 1, 1]]) / 13)
    return np.clip(soft + (x - soft) * f, 0, 1)


def noise(x: np.ndarray, sigma: float, rng: np.random.Generator, chance: float = 1.0) -> np.ndarray:
    return np.clip(x + rng.normal(0, sigma, x.shape), 0, 1) if rng.random() < chance else x


def denoise(x: np.ndarray, variance: float = 0.03, blur: Callable = gaussian) -> np.ndarray:
    """Blurs only what varies more than that."""
    return blur(x) if x.var() > variance else x


def channel_normalize(x: np.ndarray) -> np.ndarray:
    return (x - np.array(MEAN)) / np.array(STD)


def preprocess(x: np.ndarray, rng: np.random.Generator, size: int = 224, bright: float = 1.2, contrasted: float = 1.2) -> np.ndarray:
    """Resize, brightness, contrast, a chance of noise, denoising."""
    x = contrast(brightness(resize(x, size, size), bright), contrasted)
    return denoise(noise(x, 20 / 255, rng, 0.4), 3000 / 255**2)


def random_transform(x: np.ndarray, rng: np.random.Generator, size: int = 224) -> np.ndarray:
    """A random flip, turn, jitter and crop, then noise, blur, smoothing and denoising, normalized."""
    x = resize(x, size, size)
    x = x[:, ::-1] if rng.random() < 0.5 else x
    x = rotate(x, rng.uniform(-15, 15))
    x = contrast(brightness(x, rng.uniform(0.8, 1.2)), rng.uniform(0.8, 1.2))
    x = crop(x, rng.uniform(0.8, 1.0))
    return channel_normalize(denoise(box(gaussian(noise(x, 0.05, rng)))))


def photo_set(x: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Twenty-five variants: turns, flips, crops, light, contrast, sharpness, filters and noise."""
    turns = [rotate(x, d) for d in (90, 180, 270)]
    tilts = [rotate(x, d) for d in (15, -15, 45, -45)]
    light = [brightness(x, 0.5), brightness(x, 1.5), contrast(x, 0.7), contrast(x, 1.5), sharpness(x, 0.3), sharpness(x, 2.0)]
    soft = [gaussian(x, 5, 2.0, "reflect"), median(x, 3), box(x, 3, "reflect"), denoise(x, 3000 / 255**2), box(x, 5, "reflect")]
    return [x, *turns, x[:, ::-1], x[::-1], *tilts, crop(x, 0.6), crop(x, 0.8), *light, *soft, noise(x, 5 / 255, rng), noise(x, 10 / 255, rng)]


def batch_set(x: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Twenty-five variants as a batch library makes them: turns, flips, crops, jitters, filters and noise."""
    turns = [rotate(x, d) for d in (0, 90, 180, 270, 15, -15, 45, -45)]
    jitter = [brightness(x, 0.8), brightness(x, 1.2), contrast(x, 0.8), saturate(x, 1.2)]
    soft = [gaussian(x, 3, 2.0, "reflect"), median(x, 3), box(x, 3, "reflect"), gaussian(x, 3, 0.5, "reflect"), gaussian(x, 5, 1.0, "reflect")]
    return [*turns, x[:, ::-1], x[::-1], crop(x, 0.8), crop(x, 0.9), *jitter, sharpness(x, 0.3), sharpness(x, 2.0), *soft, noise(x, 0.02, rng), noise(x, 0.05, rng)]
