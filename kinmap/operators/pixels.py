"""Operators on pixel rows (image, y, x, v): histograms, entropy, mutual information, matching of histograms, masks, geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PLACES = 6
#: Fixed values of the difference decision: the share of the possible difference that counts as a change, how many such shares under the
#: largest one a pixel still is close to it, how many pixels must be, the signal's peak, and how near to the map's least a pixel counts.
CHANGED, CLOSE, LEAST_PIXELS, PEAK, NEAR = 0.06, 3.5, 36, 255.0, 1.065


def histogram(pixels: DataFrame, by: list[str]) -> DataFrame:
    """``by``, bin (0 to 255), n: only bins that occur."""
    return pixels.groupBy(*by, F.floor("v").cast("long").alias("bin")).agg(F.count("*").alias("n"))


def _entropy(counts: DataFrame, by: list[str], name: str) -> DataFrame:
    total = counts.withColumn("_t", F.sum("n").over(Window.partitionBy(*by)))
    share = F.col("n") / F.col("_t")
    return total.groupBy(*by).agg((-F.sum(share * F.log2(share))).alias(name))


def entropy(counts: DataFrame, by: list[str]) -> DataFrame:
    """Entropy in bits of counts n."""
    return _entropy(counts, by, "entropy").select(*by, F.round("entropy", PLACES).alias("entropy"))


def _bin(v: str, low: Column, high: Column, bins: int) -> Column:
    """Equal bins over the range widened by half a bin on either side; the upper edge belongs to the last."""
    half = 0.5 * (high - low) / (bins - 1)
    return F.least(F.floor((F.col(v) - (low - half)) / (high - low + 2 * half) * bins), F.lit(bins - 1)).cast("long")


def mutual_information(pairs: DataFrame, by: list[str], bins: int = 256) -> DataFrame:
    """``by``, mi: entropies of both sides less the joint entropy, for rows with values a and b; 0 if a side's (widened) range is
    at most 1."""
    all_ = Window.partitionBy(*by)
    ranged = pairs.select(*by, "a", "b", *(f(c).over(all_).alias(f"_{n}{c}") for c in "ab" for n, f in (("low", F.min), ("high", F.max))))
    flat = [(F.col(f"_high{c}") - F.col(f"_low{c}")) * (1 + 1.0 / (bins - 1)) <= 1.0 for c in "ab"]
    binned = ranged.select(*by, (flat[0] | flat[1]).alias("_flat"), _bin("a", F.col("_lowa"), F.col("_higha"), bins).alias("ba"), _bin("b", F.col("_lowb"), F.col("_highb"), bins).alias("bb"))
    joint = binned.groupBy(*by, "_flat", "ba", "bb").agg(F.count("*").alias("n"))
    out = _entropy(joint, by, "hab")
    for c in "ab":
        out = out.join(_entropy(joint.groupBy(*by, f"b{c}").agg(F.sum("n").alias("n")), by, f"h{c}"), by)
    flags = joint.groupBy(*by).agg(F.max("_flat").alias("_flat"))
    return out.join(flags, by).select(*by, F.round(F.when(F.col("_flat"), 0.0).otherwise(F.col("ha") + F.col("hb") - F.col("hab")), PLACES).alias("mi"))


def mean_squared_error(pairs: DataFrame, by: list[str]) -> DataFrame:
    return pairs.groupBy(*by).agg(F.round(F.avg(F.pow(F.col("a") - F.col("b"), 2)), PLACES).alias("mse"))


def cumulative(pixels: DataFrame, by: list[str]) -> DataFrame:
    """``by``, v, q: the share of an image's pixels with a value up to v."""
    counts = pixels.groupBy(*by, "v").agg(F.count("*").alias("n"))
    all_ = Window.partitionBy(*by)
    return counts.select(*by, "v", (F.sum("n").over(all_.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(all_)).alias("q"))


def match_histogram(pairs: DataFrame, pixels: DataFrame) -> DataFrame:
    """source, template, v, matched: each value of the source moved to the template's value at its quantile, with linear interpolation
    between the template's values and its ends beyond them."""
    own = cumulative(pixels, ["image"])
    step = Window.partitionBy("image").orderBy("v")
    steps = own.withColumn("next_q", F.lead("q").over(step)).withColumn("next_v", F.lead("v").over(step)).withColumn("first_q", F.first("q").over(step)).withColumn("first_v", F.first("v").over(step))
    s = own.select(F.col("image").alias("source"), F.col("v").alias("sv"), F.col("q").alias("sq"))
    t = steps.withColumnRenamed("image", "template")
    both = pairs.join(s, "source").join(t, "template")
    inside = (F.col("q") <= F.col("sq")) & (F.col("next_q").isNull() | (F.col("sq") < F.col("next_q")))
    below = (F.col("sq") < F.col("first_q")) & (F.col("v") == F.col("first_v"))
    slope = F.when(below | F.col("next_q").isNull(), F.col("v")).otherwise(F.col("v") + (F.col("sq") - F.col("q")) / (F.col("next_q") - F.col("q")) * (F.col("next_v") - F.col("v")))
    return both.filter(inside | below).select("source", "template", F.col("sv").alias("v"), F.round(slope, PLACES).alias("matched"))


def pair_similarity(pairs: DataFrame, pixels: DataFrame, bins: int = 256) -> DataFrame:
    """i, j, mi, mse of ``pairs(i, j)`` of images of one size: the pixels (image, y, x, v) of the first, moved to the second's values by
    ``match_histogram``, against those of the second. So the two directions of a pair differ."""
    moved = match_histogram(pairs.select(F.col("i").alias("source"), F.col("j").alias("template")), pixels)
    first = moved.join(pixels.withColumnRenamed("image", "source"), ["source", "v"]).select(F.col("source").alias("i"), F.col("template").alias("j"), "y", "x", F.col("matched").alias("a"))
    both = first.join(pixels.select(F.col("image").alias("j"), "y", "x", F.col("v").alias("b")), ["j", "y", "x"])
    return mutual_information(both, ["i", "j"], bins).join(mean_squared_error(both, ["i", "j"]), ["i", "j"])


def histogram_intersection(pairs: DataFrame, counts: DataFrame, pixels: int) -> DataFrame:
    """a, b, score: the share of pixels that two histograms have in common."""
    left, right = (counts.select(F.col("image").alias(c), "bin", F.col("n").alias(f"n{c}")) for c in "ab")
    met = pairs.join(left, "a").join(right, ["b", "bin"]).groupBy("a", "b").agg(F.sum(F.least("na", "nb")).alias("shared"))
    return pairs.join(met, ["a", "b"], "left").select("a", "b", F.round(F.coalesce("shared", F.lit(0)) / pixels, PLACES).alias("score"))


def difference_decision(pairs: DataFrame, by: list[str], threshold: float = CHANGED, least: int = LEAST_PIXELS) -> DataFrame:
    """``by``, modified, global_share: whether two images differ (their largest difference is 6 % of the possible one or more, and 36
    pixels or more come close to it), and the share of pixels near the least of the signal-to-noise map (-1 if not modified)."""
    d = F.abs(F.col("a") - F.col("b"))
    all_ = Window.partitionBy(*by)
    rows = pairs.select(*by, d.alias("d"), F.max(d).over(all_).alias("top"), F.greatest(F.abs(F.max("a").over(all_) - F.min("b").over(all_)), F.abs(F.max("b").over(all_) - F.min("a").over(all_))).alias("most"))
    near = F.sum((F.col("d") > F.col("top") - F.col("most") * threshold * CLOSE).cast("long")).over(all_)
    level = F.round(10 * F.log10(PEAK**2 / (F.pow(F.when(F.col("top") != 0, F.col("d") / F.col("top")).otherwise(F.col("d")), 2) + 1)), 9)
    rows = rows.select(*by, "top", "most", near.alias("near"), level.alias("level")).withColumn("low", F.min("level").over(all_))
    seen = rows.groupBy(*by).agg(F.first("top").alias("top"), F.first("most").alias("most"), F.first("near").alias("near"), F.avg((F.col("level") < F.col("low") * NEAR).cast("double")).alias("share"))
    modified = (F.col("top") >= F.col("most") * threshold) & (F.col("near") >= least)
    return seen.select(*by, modified.alias("modified"), F.round(F.when(modified, F.col("share")).otherwise(-1.0), PLACES).alias("global_share"))


def scale_image(pixels: DataFrame, by: list[str], top: float = 1.0, sigma: float | None = None) -> DataFrame:
    """Adds scaled: with ``sigma``, values clipped to mean and sigma deviations and stretched to 0..top; without, only the least value
    goes and nothing is divided."""
    all_ = Window.partitionBy(*by)
    low, high = F.min("v").over(all_), F.max("v").over(all_)
    if sigma is None:
        return pixels.withColumn("scaled", F.round((F.col("v") - low) * top, PLACES))
    mean, std = F.avg("v").over(all_), F.stddev_pop("v").over(all_)
    rows = pixels.withColumn("_low", F.greatest(low, mean - std * sigma)).withColumn("_high", F.least(high, mean + std * sigma))
    width = F.col("_high") - F.col("_low")
    clipped = F.greatest(F.col("_low"), F.least(F.col("_high"), F.col("v")))
    return rows.withColumn("scaled", F.round((clipped - F.col("_low")) / F.when(width == 0, 1.0).otherwise(width) * top, PLACES)).drop("_low", "_high")


def otsu(counts: DataFrame, by: list[str]) -> DataFrame:
    """``by``, threshold: the bin up to which the lower class goes so that the variance between classes is largest (ties: the first)."""
    all_ = Window.partitionBy(*by)
    upto = all_.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.select(*by, "bin", F.sum("n").over(upto).alias("w0"), F.sum(F.col("n") * F.col("bin")).over(upto).alias("s0"), F.sum("n").over(all_).alias("w"), F.sum(F.col("n") * F.col("bin")).over(all_).alias("s"))
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / F.when(F.col("w") > F.col("w0"), F.col("w") - F.col("w0"))
    rows = rows.withColumn("between", F.round(F.col("w0") * (F.col("w") - F.col("w0")) * gap * gap, PLACES)).filter("w > w0")
    return rows.groupBy(*by).agg(F.min(F.struct((-F.col("between")).alias("b"), "bin")).alias("m")).select(*by, F.col("m.bin").alias("threshold"))


def mean_mask(pixels: DataFrame, group: str) -> DataFrame:
    """group, y, x, v: pixel by pixel mean over a group's images."""
    return pixels.groupBy(group, "y", "x").agg(F.round(F.avg("v"), PLACES).alias("v"))


def flip_vertical(pixels: DataFrame, height: int) -> DataFrame:
    return pixels.withColumn("y", height - 1 - F.col("y"))


def rotate_90(pixels: DataFrame, height: int, width: int, turns: int = 1) -> DataFrame:
    """Counter-clockwise quarter turns."""
    out = pixels
    for _ in range(turns % 4):
        out = out.withColumn("_y", width - 1 - F.col("x")).withColumn("x", F.col("y")).withColumn("y", F.col("_y")).drop("_y")
        height, width = width, height
    return out


def bounding_patch(points: DataFrame, by: list[str], least: int = 9) -> DataFrame:
    """``by``, x, y, w, h of the box around points; boxes with a side under ``least`` pixels are left out."""
    box = points.groupBy(*by).agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
    return box.filter((F.col("w") >= least) & (F.col("h") >= least))
