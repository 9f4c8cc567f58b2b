"""Images as sparse pixels: thresholds, regions, and the kernels that need a whole frame.

Thresholds and statistics are aggregates over (image_nr, pix, v). Labels and watershed follow neighbours over a frame and take
one at a time, as one Arrow group of bounded size (a detector's pixels); filters are in operators/kernels.py.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from braggflow.operators import kernels


def noise_floor(pixels: DataFrame, k: float = 4.0) -> DataFrame:
    """(image_nr, threshold): median + k * 1.4826 * median absolute deviation of the positive pixels, 1 at least."""
    lit = pixels.where("v > 0")
    middle = lit.groupBy("image_nr").agg(F.median("v").alias("med"))
    spread = lit.join(middle, "image_nr").groupBy("image_nr", "med").agg(F.median(F.abs(F.col("v") - F.col("med"))).alias("mad"))
    found = spread.select("image_nr", F.greatest(F.col("med") + k * 1.4826 * F.col("mad"), F.lit(1.0)).alias("threshold"))
    return pixels.select("image_nr").distinct().join(found, "image_nr", "left").select("image_nr", F.coalesce("threshold", F.lit(1.0)).alias("threshold"))


def percentile(pixels: DataFrame, percent: float, n_pixels: int) -> DataFrame:
    """(image_nr, threshold): linear percentile over all n_pixels of a frame; pixels that are not listed are zero."""
    order = Window.partitionBy("image_nr").orderBy("v")
    at = percent / 100 * (n_pixels - 1)
    low, part = int(at), at - int(at)
    frames = pixels.groupBy("image_nr").agg(F.count("*").alias("n"))
    ranked = pixels.join(frames, "image_nr").withColumn("rank", F.row_number().over(order) - 1 + n_pixels - F.col("n"))
    value = lambda r: F.coalesce(F.max(F.when(F.col("rank") == r, F.col("v"))), F.lit(0.0))
    both = ranked.groupBy("image_nr").agg(value(low).alias("lo"), value(min(low + 1, n_pixels - 1)).alias("hi"))
    return both.select("image_nr", (F.col("lo") + (F.col("hi") - F.col("lo")) * part).alias("threshold"))


def fixed(pixels: DataFrame, value: float) -> DataFrame:
    return pixels.select("image_nr").distinct().withColumn("threshold", F.lit(float(value)))


def deviation(pixels: DataFrame, n_pixels: int) -> DataFrame:
    """(image_nr, threshold): 60 * (1 + floor(standard deviation / 60)) over all n_pixels of a frame."""
    sums = pixels.groupBy("image_nr").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("s2"))
    variance = F.col("s2") / n_pixels - (F.col("s") / n_pixels) * (F.col("s") / n_pixels)
    return sums.select("image_nr", (60.0 * (1 + F.floor(F.sqrt(F.greatest(variance, F.lit(0.0))) / 60))).alias("threshold"))


def otsu(pixels: DataFrame, n_pixels: int, bins: int = 256) -> DataFrame:
    """(image_nr, threshold): centre of the histogram bin that parts the pixels with the greatest variance between classes.

    The histogram spans zero to the brightest pixel; pixels that are not listed are zero.
    """
    top = pixels.groupBy("image_nr").agg(F.max("v").alias("top"), F.count("*").alias("n"))
    placed = pixels.join(top, "image_nr").select("image_nr", "top", F.least(F.floor(F.col("v") / F.col("top") * bins), F.lit(bins - 1)).cast("int").alias("bin"))
    zeros = top.select("image_nr", "top", F.lit(0).alias("bin"), (F.lit(n_pixels) - F.col("n")).alias("c"))
    counts = placed.groupBy("image_nr", "top", "bin").agg(F.count("*").alias("c")).union(zeros).groupBy("image_nr", "top", "bin").agg(F.sum("c").cast("double").alias("c"))
    centre = (F.col("bin") + 0.5) * F.col("top") / bins
    up = Window.partitionBy("image_nr").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("image_nr")
    parts = counts.withColumn("centre", centre).select(
        "image_nr", "bin", "centre", F.sum("c").over(up).alias("w1"), F.sum(F.col("c") * F.col("centre")).over(up).alias("m1"),
        F.sum("c").over(whole).alias("w"), F.sum(F.col("c") * F.col("centre")).over(whole).alias("m"),
    )
    w2, mean = F.col("w") - F.col("w1"), lambda m, w: F.try_divide(m, w)
    between = F.col("w1") * w2 * F.pow(mean(F.col("m1"), F.col("w1")) - mean(F.col("m") - F.col("m1"), w2), F.lit(2.0))
    best = parts.withColumn("between", between).groupBy("image_nr").agg(F.max(F.struct(F.coalesce("between", F.lit(-1.0)).alias("b"), (-F.col("bin")).alias("nr"), "centre")).alias("best"))
    return best.select("image_nr", F.col("best.centre").alias("threshold"))


THRESHOLDS = {"adaptive": noise_floor, "percentile": percentile, "otsu": otsu, "fixed": fixed, "deviation": deviation}


def above(pixels: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Pixels strictly above their frame's threshold, as whole numbers (truncated; what falls to zero goes)."""
    kept = pixels.join(thresholds, "image_nr").where("v > threshold")
    return kept.select("image_nr", "pix", F.pmod(F.floor("v"), F.lit(65536)).cast("double").alias("v")).where("v > 0")


def quantised(pixels: DataFrame) -> DataFrame:
    """Pixels on a scale of 1 to 255 of their frame's brightest."""
    top = pixels.groupBy("image_nr").agg(F.max("v").alias("top"))
    level = F.greatest(F.floor(F.col("v") * 255 / F.col("top")), F.lit(1)).cast("int")
    return pixels.where("v > 0").join(top, "image_nr").select("image_nr", "pix", level.alias("level"))


def log_image(pixels: DataFrame) -> DataFrame:
    """Pixels for display: natural logarithm, with what is not positive counted as one."""
    return pixels.select("image_nr", "pix", F.ln(F.when(F.col("v") <= 0, F.lit(1.0)).otherwise(F.col("v"))).alias("v"))


def components(pixels: DataFrame, width: int, *, eight: bool = True) -> DataFrame:
    """(image_nr, pix, label): regions of touching pixels, numbered by their first pixel in raster order.

    Each frame's lit pixels are merged with their right and lower neighbours by union-find over sorted pixel numbers.
    """
    steps = ((0, 1), (1, 0), (1, 1), (1, -1)) if eight else ((0, 1), (1, 0))

    def label(frame: pd.DataFrame) -> pd.DataFrame:
        pix = np.sort(frame["pix"].to_numpy())
        parent = np.arange(len(pix))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for dy, dx in steps:
            x = pix % width + dx
            other = pix + dy * width + dx
            at = np.minimum(np.searchsorted(pix, other), len(pix) - 1)
            for i in np.flatnonzero((x >= 0) & (x < width) & (pix[at] == other)):
                a, b = root(i), root(at[i])
                parent[max(a, b)] = min(a, b)
        roots = np.array([root(i) for i in range(len(pix))])
        return pd.DataFrame({"image_nr": frame["image_nr"].iloc[0], "pix": pix, "label": np.unique(roots, return_inverse=True)[1] + 1})

    kind = dict(pixels.dtypes)
    return pixels.where("v > 0").select("image_nr", "pix").groupBy("image_nr").applyInPandas(label, f"image_nr {kind['image_nr']}, pix {kind['pix']}, label int")


def region_stats(labels: DataFrame, width: int) -> DataFrame:
    """(image_nr, label, area, x, y, w, h) of each region: pixels and bounding box."""
    placed = labels.where("label > 0").select("image_nr", "label", (F.col("pix") % width).alias("px"), F.expr(f"pix div {width}").alias("py"))
    box = placed.groupBy("image_nr", "label").agg(F.count("*").alias("area"), *[f(c).alias(f"{n}_{c}") for c in ("px", "py") for f, n in ((F.min, "lo"), (F.max, "hi"))])
    return box.select("image_nr", "label", "area", F.col("lo_px").alias("x"), F.col("lo_py").alias("y"), F.expr("hi_px - lo_px + 1").alias("w"), F.expr("hi_py - lo_py + 1").alias("h"))


def centres(labels: DataFrame, pixels: DataFrame, width: int, *, min_area: int = 1, max_area: int | None = None) -> DataFrame:
    """(image_nr, label, cx, cy, area) of the regions of allowed size, weighted by intensity."""
    labels = labels.hint("merge")  # a row a pixel: never broadcast, whatever its source's size
    lit = labels.join(pixels, ["image_nr", "pix"]).select("image_nr", "label", (F.col("pix") % width).alias("x"), F.expr(f"pix div {width}").alias("y"), F.col("v").cast("decimal(18,4)").alias("v"))
    found = lit.groupBy("image_nr", "label").agg(
        (F.sum(F.col("x") * F.col("v")).cast("double") / F.sum("v").cast("double")).alias("cx"),
        (F.sum(F.col("y") * F.col("v")).cast("double") / F.sum("v").cast("double")).alias("cy"),
        F.count("*").alias("area"),
    )
    return found.where(F.col("area") >= min_area if max_area is None else F.col("area").between(min_area, max_area))


def keep_regions(labels: DataFrame, kept: DataFrame) -> DataFrame:
    """Labelled pixels of the regions that are kept."""
    return labels.join(kept.select("image_nr", "label").hint("merge"), ["image_nr", "label"], "left_semi")  # regions grow with the frames


def smoothing_width(spacing: DataFrame, distance_px: float, orientation_spacing_deg: float) -> DataFrame:
    """(image_nr, sigma): a quarter of the lesser of peak spacing and orientation spacing on the detector, 1 at least; 3 without spacing."""
    turn = float(distance_px * np.tan(np.radians(orientation_spacing_deg)))
    return spacing.select("image_nr", F.when(F.col("spacing").isNull(), F.lit(3.0)).otherwise(F.greatest(F.lit(1.0), 0.25 * F.least("spacing", F.lit(turn)))).alias("sigma"))


# Kernels over one dense frame


def dense(frame: pd.DataFrame, width: int, height: int) -> np.ndarray:
    out = np.zeros(width * height)
    out[frame["pix"].to_numpy()] = frame["v"].to_numpy()
    return out.reshape(height, width)


def gaussian(image: np.ndarray, sigma: float) -> np.ndarray:
    """Separable smoothing, edges reflected, cut off at four sigma."""
    radius = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    for axis in (0, 1):
        pad = [(radius, radius) if a == axis else (0, 0) for a in (0, 1)]
        padded = np.pad(image, pad, "symmetric")
        image = sum(w * padded.take(range(i, i + image.shape[axis]), axis) for i, w in enumerate(kernel))
    return image


def median_filter(image: np.ndarray, size: int, passes: int = 1) -> np.ndarray:
    """Median over a square of odd size, edges reflected; rows are taken one at a time to bound memory."""
    half = size // 2
    for _ in range(passes):
        padded = np.pad(image, half, "symmetric")
        windows = np.lib.stride_tricks.sliding_window_view(padded, (size, size))
        image = np.stack([np.median(windows[y].reshape(image.shape[1], -1), axis=1) for y in range(image.shape[0])])
    return image


def watershed(height_map: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Flood from the markers in order of height over the mask, eight neighbours; each pixel joins who reaches it first."""
    out = np.where(mask, markers, 0)
    heap, tick = [], 0
    for y, x in zip(*np.nonzero(out), strict=True):
        heapq.heappush(heap, (height_map[y, x], tick, y, x))
        tick += 1
    while heap:
        _, _, y, x = heapq.heappop(heap)
        for ny in range(max(0, y - 1), min(out.shape[0], y + 2)):
            for nx in range(max(0, x - 1), min(out.shape[1], x + 2)):
                if mask[ny, nx] and out[ny, nx] == 0:
                    out[ny, nx] = out[y, x]
                    heapq.heappush(heap, (height_map[ny, nx], tick, ny, nx))
                    tick += 1
    return out


def background_median(pixels: DataFrame, width: int, height: int, size: int = 101, passes: int = 1) -> DataFrame:
    return kernels.median(pixels, width, height, size, passes)


def subtract(pixels: DataFrame, background: DataFrame) -> DataFrame:
    """Pixels less the background, never below zero."""
    both = pixels.join(background.select("image_nr", "pix", F.col("v").alias("b")), ["image_nr", "pix"], "left")
    return both.select("image_nr", "pix", (F.col("v") - F.coalesce("b", F.lit(0.0))).alias("v")).where("v > 0")


def subtract_shared(pixels: DataFrame, background: DataFrame) -> DataFrame:
    """Pixels of every frame less one background (pix, v) for all, never below zero."""
    both = pixels.join(background.select("pix", F.col("v").alias("b")), "pix", "left")
    return both.select("image_nr", "pix", (F.col("v") - F.coalesce("b", F.lit(0.0))).alias("v")).where("v > 0")


def blur(pixels: DataFrame, width: int, height: int, sigma: float) -> DataFrame:
    return kernels.blur(pixels, width, height, sigma)


def split_touching(pixels: DataFrame, labels: DataFrame, width: int, height: int, sigma: float = 1.0) -> DataFrame:
    """(image_nr, pix, label): watershed of the smoothed frame from labelled regions over all lit pixels."""
    both = pixels.join(labels, ["image_nr", "pix"], "left").select("image_nr", "pix", "v", F.coalesce("label", F.lit(0)).alias("label"))
    kind = dict(pixels.dtypes)

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        image = dense(frame, width, height)
        markers = np.zeros(width * height, "i4")
        markers[frame["pix"].to_numpy()] = frame["label"].to_numpy()
        found = watershed(-gaussian(image, sigma), markers.reshape(image.shape), image > 0).reshape(-1)
        pix = np.flatnonzero(found)
        return pd.DataFrame({"image_nr": frame["image_nr"].iloc[0], "pix": pix, "label": found[pix]})

    return both.groupBy("image_nr").applyInPandas(work, f"image_nr {kind['image_nr']}, pix {kind['pix']}, label int")


def preprocess(pixels: DataFrame, width: int, height: int, *, background: DataFrame | None = None, thresholds: DataFrame | None = None, min_area: int = 5, sigma: float | None = None, distance_px: float = 2500.0, orientation_spacing_deg: float = 0.4, **enhancement) -> dict[str, DataFrame]:
    """Background, enhancement (see kernels.enhance), threshold, regions and smoothing of all frames: pixels, labels, centres and blurred."""
    clean = pixels if background is None else subtract(pixels, background)
    clean = kernels.enhance(clean, width, height, **enhancement)
    lit = above(clean, noise_floor(clean) if thresholds is None else thresholds)
    labels = components(lit, width)
    found = centres(labels, lit, width, min_area=min_area)
    labels = keep_regions(labels, found)
    lit = lit.join(labels, ["image_nr", "pix"], "left_semi")
    out = {"pixels": lit, "labels": labels, "centres": found}
    if sigma is not None:
        out["blurred"] = blur(lit, width, height, sigma)
    else:
        from braggflow.operators.relations import nearest_spacing

        spacing = nearest_spacing(found.select("image_nr", "label", "cx", "cy"), 4 * distance_px)
        out["sigma"] = smoothing_width(spacing, distance_px, orientation_spacing_deg)
    return out


def cleanup(pixels: DataFrame, background: DataFrame, width: int, n_pixels: int, *, min_area: int = 1, max_area: int = 1 << 30) -> DataFrame:
    """(image_nr, label, cx, cy, area): subtract without clamping, threshold by deviation, four-neighbour regions of allowed size."""
    both = pixels.join(background.select("image_nr", "pix", F.col("v").alias("b")), ["image_nr", "pix"], "left")
    less = both.select("image_nr", "pix", (F.col("v") - F.coalesce("b", F.lit(0.0))).alias("v"))
    limit = deviation(less, n_pixels)
    lit = less.join(limit, "image_nr").where("v >= threshold").select("image_nr", "pix", F.floor("v").cast("double").alias("v")).where("v > 0")
    return centres(components(lit, width, eight=False), lit, width, min_area=min_area, max_area=max_area)
