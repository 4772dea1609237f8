"""Image kernels over rows: decoding of Spark's image struct, measures, preprocessing, degradations.

A row's image is an array of bytes with its height, width and channels; every kernel takes and gives
unsigned 8-bit arrays (height, width, channels) in RGB. Randomness is a pure function of seed, epoch
and the row's key, so rows may be evaluated anywhere, again or in any order. JPEG has no codec here:
its step raises unless a codec is given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Luma weights, the height sharpness is measured at, the tolerance of gray images.
LUMA = (0.299, 0.587, 0.114)
SHARPNESS_HEIGHT, GRAY_TOLERANCE = 32, 2.0


class NotSupported(RuntimeError):
    """A step needs a codec or rasteriser that is not installed."""


def rng_of(seed: int, epoch: int, key: object) -> np.random.Generator:
    """The generator of one row."""
    return np.random.default_rng(xxhash.xxh3_64_intdigest(f"{seed}:{epoch}:{key}".encode()))


def from_spark(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Spark's image rows are BGR (or one channel, or BGR with alpha)."""
    x = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else np.ascontiguousarray(x[..., 2::-1])


def to_gray(x: np.ndarray) -> np.ndarray:
    return np.rint(x[..., :3].astype(np.float64) @ np.array(LUMA)).clip(0, 255).astype(np.uint8)


def half_turn(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x[::-1, ::-1])


def _area_matrix(old: int, new: int) -> np.ndarray:
    """Weights (new, old) of area resampling: each new cell averages the old cells it covers."""
    edge = np.arange(new + 1) * old / new
    cell = np.arange(old)
    cover = np.minimum(edge[1:, None], cell[None, :] + 1) - np.maximum(edge[:-1, None], cell[None, :])
    cover = np.maximum(cover, 0)
    return cover / cover.sum(axis=1, keepdims=True)


def _point_matrix(old: int, new: int, kind: str) -> np.ndarray:
    """Weights (new, old) of sampling at cell centres."""
    at = (np.arange(new) + 0.5) * old / new - 0.5
    out, rows = np.zeros((new, old)), np.arange(new)
    if kind == "nearest":
        out[rows, np.minimum((np.arange(new) * old / new).astype(int), old - 1)] = 1
        return out
    base = np.floor(at).astype(int)
    f = at - base
    if kind == "linear":
        taps = [(0, 1 - f), (1, f)]
    else:  # cubic convolution with a = -0.75
        a = -0.75
        far = lambda d: a * d**3 - 5 * a * d**2 + 8 * a * d - 4 * a
        near = lambda d: (a + 2) * d**3 - (a + 3) * d**2 + 1
        taps = [(-1, far(1 + f)), (0, near(f)), (1, near(1 - f)), (2, far(2 - f))]
    for k, w in taps:
        np.add.at(out, (rows, np.clip(base + k, 0, old - 1)), w)
    return out


def resize(x: np.ndarray, height: int, width: int, kind: str = "area") -> np.ndarray:
    """Separable resampling. Area averages when shrinking and is linear when growing."""
    def weights(old: int, new: int) -> np.ndarray:
        return _area_matrix(old, new) if kind == "area" and new <= old else _point_matrix(old, new, "linear" if kind == "area" else kind)

    y = np.tensordot(weights(x.shape[0], height), x.astype(np.float64), axes=(1, 0))
    y = np.moveaxis(np.tensordot(weights(x.shape[1], width), y, axes=(1, 1)), 0, 1)
    return np.rint(y).clip(0, 255).astype(np.uint8)


def sample(x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Bilinear samples at float positions; the border repeats."""
    h, w = x.shape[:2]
    rows, cols = np.clip(rows, 0, h - 1), np.clip(cols, 0, w - 1)
    r0, c0 = np.floor(rows).astype(int), np.floor(cols).astype(int)
    r1, c1 = np.minimum(r0 + 1, h - 1), np.minimum(c0 + 1, w - 1)
    fr, fc = (rows - r0)[..., None], (cols - c0)[..., None]
    y = x.astype(np.float64)
    y = (y[r0, c0] * (1 - fc) + y[r0, c1] * fc) * (1 - fr) + (y[r1, c0] * (1 - fc) + y[r1, c1] * fc) * fr
    return np.rint(y).clip(0, 255).astype(np.uint8)


def convolve(x: np.ndarray, kernel: np.ndarray, mode: str = "reflect") -> np.ndarray:
    """Correlation with a small odd kernel; the border is mirrored without its edge."""
    a, b = kernel.shape[0] // 2, kernel.shape[1] // 2
    mode = mode if min(x.shape[0] - a, x.shape[1] - b) > 0 else "edge"
    padded = np.pad(x.astype(np.float64), ((a, a), (b, b)) + ((0, 0),) * (x.ndim - 2), mode=mode)
    out = np.zeros(x.shape, dtype=np.float64)
    for i, j in zip(*np.nonzero(kernel)):
        out += kernel[i, j] * padded[i : i + x.shape[0], j : j + x.shape[1]]
    return out


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.rint(x).clip(0, 255).astype(np.uint8)


def gaussian_blur(x: np.ndarray, sigma: float) -> np.ndarray:
    radius = max(1, int(round(sigma * 3)))
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    k /= k.sum()
    return _bytes(convolve(convolve(x, k[None, :]), k[:, None]))


def motion_blur(x: np.ndarray, length: int, degrees: float) -> np.ndarray:
    size = length | 1
    t = np.linspace(-(size // 2), size // 2, 8 * size)
    rows, cols = size // 2 - t * np.sin(np.radians(degrees)), size // 2 + t * np.cos(np.radians(degrees))
    kernel = np.zeros((size, size))
    np.add.at(kernel, (np.rint(rows).astype(int), np.rint(cols).astype(int)), 1.0)
    return _bytes(convolve(x, kernel / kernel.sum()))


def brightness_contrast(x: np.ndarray, contrast: float, brightness: float) -> np.ndarray:
    return (x.astype(np.float32) * contrast + brightness).clip(0, 255).astype(np.uint8)


def gaussian_noise(x: np.ndarray, sigma: float, rng: np.random.Generator) -> np.ndarray:
    return (x.astype(np.float32) + rng.normal(0.0, sigma, x.shape)).clip(0, 255).astype(np.uint8)


def perspective(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Move the four corners (clockwise from the top left) by offsets (x, y)."""
    h, w = x.shape[:2]
    corner = np.array([[0, 0], [w, 0], [w, h], [0, h]], dtype=np.float64)
    rows = []
    for (u, v), (p, q) in zip(corner + offsets, corner):  # from the result back to the source
        rows += [[u, v, 1, 0, 0, 0, -p * u, -p * v, p], [0, 0, 0, u, v, 1, -q * u, -q * v, q]]
    system = np.array(rows)
    m = np.append(np.linalg.solve(system[:, :8], system[:, 8]), 1.0).reshape(3, 3)
    c, r = np.meshgrid(np.arange(w), np.arange(h))
    p = np.einsum("ij,jhw->ihw", m, np.stack([c, r, np.ones_like(c)]))
    return sample(x, p[1] / p[2], p[0] / p[2])


def arc(x: np.ndarray, amplitude: float) -> np.ndarray:
    """Bend a line: columns move down by the amplitude at the middle, not at all at the sides."""
    h, w = x.shape[:2]
    shift = amplitude * (1 - ((np.arange(w) - w / 2) / (w / 2)) ** 2)
    return sample(x, np.arange(h)[:, None] - shift[None, :], np.broadcast_to(np.arange(w)[None, :], (h, w)))


def resolution_cap(x: np.ndarray, most: int, kind: str = "area") -> np.ndarray:
    h, w = x.shape[:2]
    return x if h <= most else resize(x, most, max(2, int(round(w * most / h))), kind)


KINDS = ("nearest", "linear", "area", "cubic")


def jpeg(x: np.ndarray, quality: int, codec: Callable[[np.ndarray, int], np.ndarray] | None) -> np.ndarray:
    if codec is None:
        raise NotSupported("re-encoding needs a JPEG codec: pass one, or leave the step out with skip_jpeg")
    return codec(x, quality)


#: The ordered steps of each stage as (step, probability, range of its parameter).
STAGES = {
    "capture": (("arc", 0.12, (0.05, 0.30)), ("perspective", 0.25, (0.0, 0.06)), ("brightness_contrast", 0.45, None), ("gaussian_blur", 0.30, (0.4, 2.2)), ("motion_blur", 0.10, (3, 11))),
    "real_codec": (("resolution_cap", 1.0, None), ("jpeg", 1.0, (94, 96))),
    "real_training": (("resolution_cap", 1.0, None), ("resolution_jitter", 0.12, (0.7, 0.95)), ("brightness_contrast", 0.25, None), ("gaussian_noise", 0.20, (1.0, 7.0)), ("jpeg", 0.70, (55, 95))),
    "codec": (("resolution_cap", 1.0, None), ("resolution_jitter", 0.30, (0.45, 0.95)), ("gaussian_blur", 0.55, (0.35, 0.85)), ("gaussian_noise", 0.35, (1.0, 14.0)), ("jpeg", 0.80, (28, 92))),
}
CONTRAST, BRIGHTNESS = (0.80, 1.40), (-28.0, 28.0)


def degrade(x: np.ndarray, stage: str, rng: np.random.Generator, work_height: int = 64, codec: Callable | None = None, skip_jpeg: bool = False) -> np.ndarray:
    """Apply a stage's steps in order, each with its probability."""
    for step, probability, span in STAGES[stage]:
        if rng.random() >= probability or step == "jpeg" and skip_jpeg:
            continue
        h, w = x.shape[:2]
        v = rng.uniform(*span) if span else 0.0
        if step == "arc":
            x = arc(x, v * h * (1 if rng.random() < 0.5 else -1)) if min(h, w) >= 2 else x
        elif step == "perspective":
            x = perspective(x, rng.uniform(-1, 1, (4, 2)) * v * h)
        elif step == "brightness_contrast":
            x = brightness_contrast(x, rng.uniform(*CONTRAST), rng.uniform(*BRIGHTNESS))
        elif step == "gaussian_blur":
            x = gaussian_blur(x, v)
        elif step == "motion_blur":
            x = motion_blur(x, int(rng.integers(span[0], span[1] + 1)), rng.uniform(0, 180))
        elif step == "gaussian_noise":
            x = gaussian_noise(x, v, rng)
        elif step == "resolution_cap":
            x = resolution_cap(x, work_height, KINDS[rng.integers(len(KINDS))])
        elif step == "resolution_jitter":
            small = resize(x, max(2, int(h * v)), max(2, int(w * v)), KINDS[rng.integers(len(KINDS))])
            x = resize(small, h, w, KINDS[rng.integers(len(KINDS))])
        else:
            x = jpeg(x, int(rng.integers(span[0], span[1] + 1)), codec)
    return x


def preprocess(x: np.ndarray, height: int, width: int, channels: int = 1, rng: np.random.Generator | None = None) -> np.ndarray:
    """Scale to a height, cut a window or repeat the border to a width, normalise to -1..1; channels come first.

    The window is centred, or drawn where a generator is given.
    """
    if channels not in (1, 3):
        raise ValueError("one or three channels")
    y = to_gray(x)[..., None] if channels == 1 else x
    y = resize(y, height, max(1, int(round(x.shape[1] * height / x.shape[0]))))
    spare = abs(y.shape[1] - width)
    at = int(rng.integers(0, spare + 1)) if rng is not None and spare else spare // 2
    y = y[:, at : at + width] if y.shape[1] > width else np.pad(y, ((0, 0), (at, spare - at), (0, 0)), mode="edge")
    return ((y.astype(np.float32) / 255.0 - 0.5) / 0.5).transpose(2, 0, 1)


def measure(x: np.ndarray) -> tuple[int, float, float, float, bool]:
    """Height, aspect, sharpness, ink spread and whether the image is gray."""
    h, w = x.shape[:2]
    gray = to_gray(x)
    small = resize(gray[..., None], SHARPNESS_HEIGHT, max(1, int(round(w * SHARPNESS_HEIGHT / h))))[..., 0].astype(np.float32) / 255.0
    laplacian = convolve(small, np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], dtype=float))
    d = x.astype(np.int16)
    apart = max(np.abs(d[..., 0] - d[..., 1]).mean(), np.abs(d[..., 1] - d[..., 2]).mean())
    return h, w / h, float(laplacian.var()), float(gray.std()) / 255.0, bool(apart < GRAY_TOLERANCE)


def measure_images(df: DataFrame, key: str, image: str = "image") -> DataFrame:
    """Rows (key, crop_height, aspect_ratio, sharpness, ink_spread, is_grayscale)."""
    rows = df.select(key, *[F.col(f"{image}.{c}").alias(c) for c in ("data", "height", "width", "nChannels")])
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [measure(from_spark(*v)) for v in zip(pdf["data"], pdf["height"], pdf["width"], pdf["nChannels"])]
            yield pd.DataFrame(out, columns=["crop_height", "aspect_ratio", "sharpness", "ink_spread", "is_grayscale"]).assign(**{key: pdf[key].to_numpy()})[[key, "crop_height", "aspect_ratio", "sharpness", "ink_spread", "is_grayscale"]]

    return rows.mapInPandas(run, f"{key} {kind}, crop_height int, aspect_ratio double, sharpness double, ink_spread double, is_grayscale boolean")


def labelled_samples(df: DataFrame, key: str, stage: str, epoch: int, height: int = 48, width: int = 192, seed: int = 0, image: str = "image", weight: str | None = None, **options: object) -> DataFrame:
    """Rows (key, label, weight, image): upright crops, half of them turned, then the codec stage, then the tensor.

    The turn comes before the codec stage, which otherwise would leave traces of it.
    """
    rows = df.select(key, *[F.col(f"{image}.{c}").alias(c) for c in ("data", "height", "width", "nChannels")], (F.col(weight) if weight else F.lit(1.0)).cast("float").alias("weight"))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, w, *v in zip(pdf[key], pdf["weight"], pdf["data"], pdf["height"], pdf["width"], pdf["nChannels"]):
                rng = rng_of(seed, epoch, k)
                x, turned = from_spark(*v), bool(rng.random() < 0.5)
                x = degrade(half_turn(x) if turned else x, stage, rng, 2 * height, **options)
                out.append((k, int(turned), w, preprocess(x, height, width, 1, rng).ravel()))
            yield pd.DataFrame(out, columns=[key, "label", "weight", "image"])

    return rows.mapInPandas(run, f"{key} {kind}, label int, weight float, image array<float>")


def by_photo(df: DataFrame, path: str) -> DataFrame:
    """Rows of one photo together, so that a task decodes it once; large photos' rows stay in their partition's order."""
    return df.repartition(path).sortWithinPartitions(path)


def turned(image: Column) -> Column:
    """Half turn of a one-channel row-major array, without leaving the JVM."""
    return F.reverse(image)
