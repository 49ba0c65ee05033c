"""Image scans, content digests, perceptual hashes and quality measures.

Images are ``struct<height,width,nChannels,data>`` rows as Spark's ``image`` source decodes them
(BGR, row by row). Arrow hands batches of them to the NumPy helpers below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxloom.functions.hashing import git_blob_sha

HASH_VERSION = "dct32-ac-median-msb"  # hashes of another definition are never compared with these


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path, size, SHA-256 and git blob id of every file; the bytes do not leave the scan."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return rows.select(
        "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), git_blob_sha(F.col("content")).alias("git_blob")
    )


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images with path and dimensions; files that do not decode are dropped by the source
    and show up as missing when joined to ``read_files``."""
    rows = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path)
    return rows.select(
        F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("nChannels"), F.col("image.data").alias("data"),
    )


def pixels(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def grey(image: np.ndarray) -> np.ndarray:
    """Integer luma of BGR pixels with 14-bit weights, rounded."""
    if image.shape[2] == 1:
        return image[:, :, 0]
    b, g, r = (image[:, :, i].astype(np.int64) for i in range(3))
    return ((b * 1868 + g * 9617 + r * 4899 + 8192) >> 14).astype(np.uint8)


def area_matrix(source: int, target: int) -> np.ndarray:
    """Weights that average ``source`` cells into ``target`` cells by covered length."""
    edge = np.arange(target + 1) * source / target
    lo = np.maximum(edge[:-1, None], np.arange(source)[None, :])
    hi = np.minimum(edge[1:, None], np.arange(source)[None, :] + 1)
    cover = np.clip(hi - lo, 0, None)
    return cover / cover.sum(1, keepdims=True)


def dct_matrix(n: int) -> np.ndarray:
    k = np.arange(n)[:, None]
    m = np.sqrt(2 / n) * np.cos(np.pi * (2 * np.arange(n)[None, :] + 1) * k / (2 * n))
    m[0] /= np.sqrt(2)
    return m


_DCT = dct_matrix(32)


def _resize(g: np.ndarray, height: int, width: int) -> np.ndarray:
    small = area_matrix(g.shape[0], height) @ g.astype(np.float64) @ area_matrix(g.shape[1], width).T
    # averages that lie on a half are told from it by nothing but the order of a sum
    return np.rint(np.round(small, 9))


def phash_of(g: np.ndarray) -> int:
    """64 low DCT terms of the 32 x 32 image against the median of the 63 without the mean term.

    Terms of equal size differ by the rounding of their sums, so a term has to be above the median by more than that.
    """
    low = (_DCT @ _resize(g, 32, 32) @ _DCT.T)[:8, :8].ravel()
    bits = low > np.median(low[1:]) + 1e-9
    return int(np.packbits(bits).view(">i8")[0])


def phash_variants_of(g: np.ndarray) -> list[int]:
    return [phash_of(np.rot90(f, k)) for f in (g, g[:, ::-1]) for k in range(4)]


def dhash_of(g: np.ndarray) -> int:
    """Left-to-right brightness steps of a 9 x 8 image taken from the 64 x 64 thumbnail."""
    v = _resize(_resize(g, 64, 64), 8, 9)
    return int(np.packbits(v[:, 1:] > v[:, :-1]).view(">i8")[0])


def _map(images: DataFrame, key: str, schema: str, measure) -> DataFrame:
    kind = images.schema[key].dataType.simpleString()

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [
                (k, *measure(pixels(h, w, c, d)))
                for k, h, w, c, d in zip(pdf[key], pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"])
            ]
            yield pd.DataFrame(rows, columns=[key, *[f.split()[0] for f in schema.split(", ")]])

    return images.select(key, "height", "width", "nChannels", "data").mapInPandas(batches, f"{key} {kind}, {schema}")


def phash(images: DataFrame, key: str = "path") -> DataFrame:
    rows = _map(images, key, "code bigint", lambda im: (phash_of(grey(im)),))
    return rows.withColumn("hash_version", F.lit(HASH_VERSION))


def phash_variants(images: DataFrame, key: str = "path") -> DataFrame:
    """Code and the codes of the 8 rotations and mirror images."""
    rows = _map(images, key, "variants array<bigint>", lambda im: (phash_variants_of(grey(im)),))
    return rows.select(key, F.get("variants", F.lit(0)).alias("code"), "variants", F.lit(HASH_VERSION).alias("hash_version"))


def same_version(a: DataFrame, b: DataFrame) -> DataFrame:
    """Versions found on either side; more than one row means the hashes must not be compared."""
    return a.select("hash_version").distinct().unionByName(b.select("hash_version").distinct()).distinct()


def dhash(images: DataFrame, key: str = "path") -> DataFrame:
    return _map(images, key, "dhash bigint", lambda im: (dhash_of(grey(im)),))


@F.pandas_udf(T.StringType())
def _pixel_digest(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
    out = []
    for h, w, c, d in zip(height, width, channels, data):
        im = pixels(h, w, c, d)
        rgb = np.repeat(im, 3, 2) if c == 1 else im[:, :, 2::-1]
        out.append(hashlib.sha256(f"{w}x{h}".encode() + np.ascontiguousarray(rgb).tobytes()).hexdigest())
    return pd.Series(out)


def pixel_digest(images: DataFrame, key: str = "path") -> DataFrame:
    """Digest of the decoded pixels: equal for one picture in two encodings."""
    return images.select(key, _pixel_digest("height", "width", "nChannels", "data").alias("pixel_sha256"))


QUALITY = (
    "laplacian_variance double, brightness_mean double, brightness_p05 double, brightness_p95 double, "
    "saturation_mean double, high_saturation_pct double, near_black_pct double, near_white_pct double, "
    "low_clip_pct double, high_clip_pct double, pixel_std double"
)


def quality_of(image: np.ndarray) -> tuple:
    """Sharpness, brightness, saturation and clipping of one uint8 image (percentages of pixels)."""
    g = grey(image).astype(np.float64)
    p = np.pad(g, 1, mode="reflect")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g
    p05, p95 = np.percentile(g, [5, 95])
    if image.shape[2] == 1:
        saturation = high = None
    else:
        top, bottom = image.max(2).astype(np.float64), image.min(2).astype(np.float64)
        s = np.rint(np.divide(255 * (top - bottom), top, out=np.zeros_like(top), where=top > 0))
        saturation, high = float(s.mean()), float((s >= 250).mean() * 100)
    return (
        float(lap.var()), float(g.mean()), float(p05), float(p95), saturation, high,
        float((g <= 5).mean() * 100), float((g >= 250).mean() * 100),
        float((image <= 0).any(2).mean() * 100), float((image >= 255).any(2).mean() * 100), float(image.std()),
    )


def image_quality(images: DataFrame, key: str = "path") -> DataFrame:
    return _map(images, key, QUALITY, quality_of)
