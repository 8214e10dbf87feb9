"""Page images as 8-bit grey values (width, height, pixels binary): quality features, missing text, ink marks, simple clean-up.

Decoding of image files is injected: any function from a binary column's bytes to (width, height, pixels)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.extract import image_quality

FEATURES = "blur double, brightness double, contrast double, edges double"


def grey(width: int, height: int, pixels: bytes) -> np.ndarray:
    return np.frombuffer(pixels or b"", np.uint8)[: (width or 0) * (height or 0)].reshape(height or 0, width or 0).astype(np.float32)


def edges(image: np.ndarray, threshold: float = 40.0) -> np.ndarray:
    """Where the brightness changes strongly."""
    if min(image.shape, default=0) < 3:
        return np.zeros(image.shape, bool)
    gy, gx = np.gradient(image)
    return np.hypot(gx, gy) * 2 > threshold


def features(image: np.ndarray) -> tuple[float, float, float, float]:
    """Sharpness by the spread of the Laplacian, brightness best in the middle, contrast by deviation, all 0..1; and the share of edges."""
    if not image.size:
        return 0.0, 0.0, 0.0, 0.0
    inner = image[1:-1, 1:-1]
    lap = image[:-2, 1:-1] + image[2:, 1:-1] + image[1:-1, :-2] + image[1:-1, 2:] - 4 * inner if inner.size else np.zeros(1)
    mean = float(image.mean())
    return min(1.0, float(lap.var()) / 500), 1 - abs(mean - 170) / 170 if mean < 340 else 0.0, min(1.0, float(image.std()) / 64), float(edges(image).mean())


def measured(pages: DataFrame, width: str = "width", height: str = "height", pixels: str = "pixels") -> DataFrame:
    """pages with blur, brightness, contrast, edges and quality."""

    @F.pandas_udf(FEATURES)
    def measure(w: pd.Series, h: pd.Series, p: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([features(grey(*x)) for x in zip(w, h, p, strict=True)], columns=["blur", "brightness", "contrast", "edges"])

    got = pages.withColumn("__f", measure(width, height, pixels)).select(*pages.columns, "__f.*")
    return got.withColumn("quality", image_quality(F.col("blur"), F.col("brightness"), F.col("contrast")))


def missing_band(image: np.ndarray, boxes: list[tuple[float, float]], bands: int = 8) -> bool:
    """Whether a band of the page has ink but no recognised item (y0, y1), among three bands with ink or more."""
    h = image.shape[0] if image.ndim == 2 else 0
    if h < 80 or image.shape[1] < 80:
        return False
    ink = edges(image)
    active = [(h * b // bands, h * (b + 1) // bands) for b in range(bands)]
    active = [(a, z) for a, z in active if ink[a:z].mean() >= 0.03]
    empty = [x for x in active if not any(y0 <= x[1] and y1 >= x[0] for y0, y1 in boxes)]
    return len(active) >= 3 and bool(empty)


def incomplete(pages: DataFrame) -> DataFrame:
    """pages (width, height, pixels, items, text) with `incomplete`: text is missing where the image shows some."""

    @F.pandas_udf("boolean")
    def judge(w: pd.Series, h: pd.Series, p: pd.Series, items: pd.Series, text: pd.Series) -> pd.Series:
        out = []
        for width, height, pixels, found, said in zip(w, h, p, items, text, strict=True):
            image = grey(width, height, pixels)
            words = len((said or "").split())
            density = float(edges(image).mean()) if image.size else 0.0
            if found is None or not len(found):
                out.append(True)
            elif words < 8:
                out.append(density >= 0.08)
            else:
                expected = density * image.size / 450
                out.append(bool(image.size) and (expected > 60 and words < 0.55 * expected or missing_band(image, [(i["y0"], i["y1"]) for i in found])))
        return pd.Series(out)

    return pages.withColumn("incomplete", judge("width", "height", "pixels", "items", "text"))


def prepared(image: np.ndarray, most: int = 2000) -> np.ndarray:
    """A page made easier to read: margins without ink cut off, at most `most` pixels wide, full contrast, single specks smoothed."""
    ink = edges(image)
    if ink.any():
        rows, cols = np.flatnonzero(ink.any(1)), np.flatnonzero(ink.any(0))
        image = image[max(0, rows[0] - 8) : rows[-1] + 9, max(0, cols[0] - 8) : cols[-1] + 9]
    if image.size and image.shape[1] > most:
        step = -(-image.shape[1] // most)
        image = image[: image.shape[0] // step * step, : image.shape[1] // step * step].reshape(image.shape[0] // step, step, -1, step).mean((1, 3))
    if image.size and image.max() > image.min():
        lo, hi = np.percentile(image, (1, 99))
        image = np.clip((image - lo) / max(hi - lo, 1) * 255, 0, 255)
    if min(image.shape, default=0) >= 3:
        stack = [image[i : image.shape[0] - 2 + i, j : image.shape[1] - 2 + j] for i in range(3) for j in range(3)]
        image[1:-1, 1:-1] = np.median(stack, axis=0)
    return image


def signature_score(image: np.ndarray) -> float:
    """How much the lower third of a page has long thin ink beyond lines of print, 0..1."""
    low = image[image.shape[0] * 2 // 3 :] if image.ndim == 2 else image
    if not low.size:
        return 0.0
    ink = low < 110
    per_row = ink.mean(1)
    return float(min(1.0, 20 * np.mean((per_row > 0.005) & (per_row < 0.08)) * ink.mean() / max(ink.mean(), 0.01)))
