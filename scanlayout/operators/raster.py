"""Page statistics from pixel histograms: ink, thresholds, grey pages, row profiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp

PAGE = ["doc_id", "page_index"]


def _images(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray | None]]:
    """(row, pixels by height, width and channel) of a batch with width, height, n_channels and data, straight from its buffers; None for a broken image."""
    data = batch.column("data")
    sizes = [batch.column(c).to_pylist() for c in ("height", "width", "n_channels")]
    for row, shape in enumerate(zip(*sizes)):
        raw = data[row].as_buffer() if data[row].is_valid else None
        ok = raw is not None and raw.size and None not in shape and int(np.prod(shape)) == raw.size
        yield row, np.frombuffer(raw, dtype=np.uint8).reshape(shape) if ok else None


def _counted(batch: pa.RecordBatch, names: list[str], rows: list[int], values: list[np.ndarray]) -> pa.RecordBatch:
    """A row per counted value: the page's columns, then those of values (arrays of one row per name)."""
    at = np.repeat(np.array(rows, dtype=np.int64), [v.shape[1] for v in values])
    made = np.concatenate(values, axis=1) if values else np.zeros((len(names), 0), dtype=np.int64)
    keys = [batch.column(c).take(pa.array(at)) for c in PAGE]
    return pa.RecordBatch.from_arrays([*keys, *(pa.array(v, pa.int64() if n == "n" else pa.int32()) for n, v in zip(names, made))], names=[*PAGE, *names])


_IMAGE = [*PAGE, "width", "height", "n_channels", "data"]


def _key_types(rasters: DataFrame) -> str:
    return ", ".join(f"{c} {rasters.schema[c].dataType.simpleString()}" for c in PAGE)


def _shrunk(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Means over the areas that h by w pixels cover, whatever the ratio: prefix sums along each side, read at fractional places."""

    def along(values: np.ndarray, n: int) -> np.ndarray:
        size = values.shape[0]
        total = np.concatenate([np.zeros_like(values[:1]), np.cumsum(values, axis=0)])
        edges = np.arange(n + 1) * (size / n)
        low = np.minimum(edges.astype(np.int64), size - 1)
        upto = total[low] + (edges - low).reshape(-1, *[1] * (values.ndim - 1)) * values[low]
        return np.diff(upto, axis=0) * (n / size)

    small = along(along(image.astype(np.float64), h).swapaxes(0, 1), w).swapaxes(0, 1)
    return np.round(np.round(small, 6)).astype(np.uint8)


def _mapped(rasters: DataFrame, change: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Images changed one by one, with is_valid; broken images are null and not valid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, image in _images(batch):
                new = None if image is None else change(image)
                out.append((None, None, None, None, False) if new is None else (new.shape[1], new.shape[0], new.shape[2], new.tobytes(), True))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in PAGE), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names=[*_IMAGE, "is_valid"])

    return rasters.select(*_IMAGE).mapInArrow(run, _key_types(rasters) + ", width int, height int, n_channels int, data binary, is_valid boolean")


def thumbnail(rasters: DataFrame, max_side: int = 256) -> DataFrame:
    """Images (width, height, n_channels, data: bytes by row) whose longer side is over max_side, shrunk to it by means over areas, no pixel left out; sides are cut to whole pixels, one at least. Broken images are null and not valid."""

    def shrink(image: np.ndarray) -> np.ndarray:
        height, width, _ = image.shape
        scale = max_side / max(height, width)
        return _shrunk(image, max(1, int(height * scale)), max(1, int(width * scale))) if scale < 1 else image

    return _mapped(rasters, shrink)


def colour_sample(rasters: DataFrame, max_side: int = 256, least: int = 16, across: int = 128) -> DataFrame:
    """What grey pages are told by: larger images shrunk to max_side (sides rounded, `least` at least), others by every n-th pixel each way, n being the longer side by `across`."""

    def sample(image: np.ndarray) -> np.ndarray:
        height, width, _ = image.shape
        side = max(height, width)
        if side > max_side:
            return _shrunk(image, *(max(least, round(x * max_side / side)) for x in (height, width)))
        step = max(1, round(side / across))
        return np.ascontiguousarray(image[::step, ::step])

    return _mapped(rasters, sample)


def image_luma_hist(rasters: DataFrame) -> DataFrame:
    """bin, n: grey values of images whose data is blue, green, red (or grey) bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values = [], []
            for row, image in _images(batch):
                if image is not None:
                    px = image.reshape(-1, image.shape[2]).astype(np.float64)
                    grey = px[:, 0] if px.shape[1] < 3 else px[:, 0] * 0.114 + px[:, 1] * 0.587 + px[:, 2] * 0.299
                    n = np.bincount((grey + 0.5).astype(np.int64), minlength=256)
                    rows.append(row)
                    values.append(np.stack([np.flatnonzero(n), n[np.flatnonzero(n)]]))
            yield _counted(batch, ["bin", "n"], rows, values)

    return rasters.select(*_IMAGE).mapInArrow(count, _key_types(rasters) + ", bin int, n long")


#: Linear sRGB to XYZ by rows, its white point, and the curve of L*a*b* below and above its bend.
RGB_TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)
BEND, SLOPE, FOOT = 0.008856, 7.787, 16 / 116


def lab_chroma(bgr: np.ndarray) -> np.ndarray:
    """a and b of L*a*b* in whole numbers, of pixels (n by 3) in blue, green and red bytes."""
    c = bgr[:, ::-1] / 255.0
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)
    t = linear @ (np.array(RGB_TO_XYZ) / np.array(WHITE)[:, None]).T
    f = np.where(t > BEND, np.cbrt(t), t * SLOPE + FOOT)
    return np.floor(np.round(np.stack([500 * (f[:, 0] - f[:, 1]), 200 * (f[:, 1] - f[:, 2])], axis=1), 6) + 0.5).astype(np.int64)


def image_chroma_hist(rasters: DataFrame) -> DataFrame:
    """a, b, n: colours of L*a*b*, in the units that gray_decision's limits are in, of images whose data is blue, green, red bytes. Each different colour of an image is converted once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, values = [], []
            for row, image in _images(batch):
                if image is not None and image.shape[2] >= 3:
                    px = image.reshape(-1, image.shape[2]).astype(np.int64)
                    codes, n = np.unique((px[:, 0] << 16) | (px[:, 1] << 8) | px[:, 2], return_counts=True)
                    ab = lab_chroma(np.stack([codes >> 16, codes >> 8 & 255, codes & 255], axis=1)) + 256
                    found, which = np.unique(ab[:, 0] * 1024 + ab[:, 1], return_inverse=True)
                    rows.append(row)
                    values.append(np.stack([found // 1024 - 256, found % 1024 - 256, np.bincount(which, weights=n).astype(np.int64)]))
            yield _counted(batch, ["a", "b", "n"], rows, values)

    return rasters.select(*_IMAGE).mapInArrow(count, _key_types(rasters) + ", a int, b int, n long")


def ink_ratio(hist: DataFrame, threshold: int = 240) -> DataFrame:
    """Percent of pixels darker than the threshold."""
    dark = F.sum(F.when(F.col("bin") < threshold, F.col("n")).otherwise(0))
    return hist.groupBy(*PAGE).agg(clamp(F.when(F.sum("n") > 0, dark / F.sum("n") * 100).otherwise(F.lit(0.0)), 0.0, 100.0).alias("ink_ratio"))


def otsu_threshold(hist: DataFrame) -> DataFrame:
    """t: the first threshold (up to it dark, above it light) with the greatest variance between the two classes."""
    page = Window.partitionBy(*PAGE)
    up = page.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    mass = F.col("bin") * F.col("n")
    rows = hist.withColumns({"w0": F.sum("n").over(up), "s0": F.sum(mass).over(up), "w": F.sum("n").over(page), "s": F.sum(mass).over(page)})
    w0, w1 = F.col("w0").cast("double"), (F.col("w") - F.col("w0")).cast("double")
    gap = F.col("s0") * w1 - (F.col("s") - F.col("s0")) * w0
    variance = F.when(w1 > 0, gap * gap / (w0 * w1)).otherwise(F.lit(0.0))
    return rows.groupBy(*PAGE).agg(F.min_by("bin", F.struct(-variance, F.col("bin"))).alias("t"))


def gray_decision(chroma: DataFrame, ratio_percent: float = 0.3, p99_limit: float = 18.0, coloured: float = 10.0) -> DataFrame:
    """ratio of coloured pixels, 99th percentile of chroma about the page's medians, and is_gray where both are small."""
    centre = chroma.groupBy(*PAGE).agg(F.percentile("a", 0.5, F.col("n")).alias("ma"), F.percentile("b", 0.5, F.col("n")).alias("mb"))
    da, db = F.col("a") - F.col("ma"), F.col("b") - F.col("mb")
    rows = chroma.join(centre.hint("merge"), PAGE).withColumn("c", F.sqrt(da * da + db * db))
    out = rows.groupBy(*PAGE).agg((F.sum(F.when(F.col("c") > coloured, F.col("n")).otherwise(0)) / F.sum("n")).alias("ratio"), F.percentile("c", 0.99, F.col("n")).alias("p99"))
    return out.withColumn("is_gray", (F.col("ratio") < ratio_percent / 100) & (F.col("p99") < p99_limit))


def binarize_threshold(strength: Column, otsu: Column | None = None) -> Column:
    """The preview's threshold, 225 - 1.3 strength from 40 to 240; or, with Otsu's, that one shifted by up to 30. Null at strength 0."""
    t = clamp((F.lit(225) - strength * 1.3).cast("int"), 40, 240) if otsu is None else clamp(otsu + F.bround((strength - 50) / 50.0 * 30, 0).cast("int"), 0, 255)
    return F.when(strength > 0, t)


def binarize_coverage(hist: DataFrame, thresholds: DataFrame) -> DataFrame:
    """white_share of each page at each strength's threshold (before any morphology)."""
    rows = hist.join(thresholds.hint("merge"), PAGE)
    return rows.groupBy(*PAGE, "strength", "thr").agg((F.sum(F.when(F.col("bin") > F.col("thr"), F.col("n")).otherwise(0)) / F.sum("n")).alias("white_share"))
