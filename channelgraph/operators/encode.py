"""Jobs over content itself: encoding text and images, hashing images, telling file types apart."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from channelgraph.functions.text import strip

TEXT_BATCH = 16
IMAGE_BATCH = 4


class Encoder(Protocol):
    def encode(self, items: list) -> np.ndarray: ...


class HashingEncoder:
    """A stand-in for a neural encoder: counts hashed triples of neighbouring bytes into a fixed width."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, items: list) -> np.ndarray:
        return np.stack([self._one(item.encode() if isinstance(item, str) else bytes(item)) for item in items])

    def _one(self, content: bytes) -> np.ndarray:
        # two zero bytes in front, so that one byte is enough for a count
        cells = np.frombuffer(b"\0\0" + content, dtype=np.uint8).astype(np.uint32)
        triples = (cells[:-2] << 16 | cells[1:-1] << 8 | cells[2:]) * np.uint32(2654435761)
        return np.bincount((triples >> 8) % self.dim, minlength=self.dim).astype(np.float32)


def prefix_texts(model: str, texts: Sequence[str], is_query: bool) -> list[str]:
    """Some models want their input announced."""
    # The prefixes these models were trained with.
    if model == "multilingual-e5-small":
        prefix = "query: " if is_query else "passage: "
    elif model == "bge-small-en-v1.5" and is_query:
        prefix = "Represent this sentence for searching relevant passages: "
    else:
        prefix = ""
    return [prefix + text for text in texts]


def _encoded(df: DataFrame, key: str, payload: str, factory: Callable[[], Encoder], model: str, batch: int, prepare):
    kind = df.schema[key].dataType.simpleString()

    def run(frames):
        encoder = factory()
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                vectors = np.asarray(encoder.encode(prepare(part[payload].tolist())), dtype=np.float32)
                yield pd.DataFrame(
                    {key: part[key], "model_id": model, "dim": vectors.shape[1], "embedding": list(vectors)}
                )

    rows = df.filter(F.col(payload).isNotNull()).select(key, payload)
    return rows.mapInPandas(run, f"{key} {kind}, model_id string, dim int, embedding array<float>")


def embed_text(pending: DataFrame, factory: Callable[[], Encoder], model: str) -> DataFrame:
    """Vectors of pending messages (message_id, content). The encoder is made once per task."""
    stripped = pending.withColumn("content", strip(F.col("content")))
    return _encoded(
        stripped, "message_id", "content", factory, model, TEXT_BATCH, lambda t: prefix_texts(model, t, is_query=False)
    )


def embed_images(pending: DataFrame, factory: Callable[[], Encoder], model: str) -> DataFrame:
    """Vectors of pending images (phash, content). Images without bytes are skipped."""
    present = pending.filter(F.length("content") > 0)
    return _encoded(present, "phash", "content", factory, model, IMAGE_BATCH, list)


def embed_progress(pending: DataFrame) -> DataFrame:
    """How many images a run embeds and how many it skips for want of bytes."""
    present = F.coalesce(F.length("content") > 0, F.lit(False))
    return pending.agg(
        F.count(F.when(present, 1)).alias("done"), F.count(F.when(~present, 1)).alias("skipped")
    )


# ---- perceptual hash

HASH_SIDE, SAMPLE_SIDE, LANCZOS_RADIUS = 8, 32, 3


def _resampler(length: int, target: int) -> np.ndarray:
    """Lanczos weights that take ``length`` samples to ``target``, widened when shrinking."""
    step = length / target
    widen = max(step, 1.0)
    centres = (np.arange(target) + 0.5) * step
    x = (np.arange(length)[None, :] + 0.5 - centres[:, None]) / widen
    weights = np.where(np.abs(x) < LANCZOS_RADIUS, np.sinc(x) * np.sinc(x / LANCZOS_RADIUS), 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k, n = np.arange(HASH_SIDE)[:, None], np.arange(SAMPLE_SIDE)[None, :]
    return 2 * np.cos(np.pi * k * (2 * n + 1) / (2 * SAMPLE_SIDE))


def perceptual_hash(pixels: np.ndarray) -> str:
    """64 bits: which low frequencies of the shrunk grey image lie above their median."""

    def rounded(a: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(a), 0, 255)

    if pixels.ndim == 3:
        blue, green, red = (pixels[..., i].astype(np.float64) for i in range(3))
        grey = np.floor((red * 19595 + green * 38470 + blue * 7471 + 0x8000) / 65536)
    else:
        grey = pixels.astype(np.float64)
    height, width = grey.shape
    small = rounded(grey @ _resampler(width, SAMPLE_SIDE).T)
    small = rounded(_resampler(height, SAMPLE_SIDE) @ small)
    low = _cosines() @ small @ _cosines().T
    bits = (low > np.median(low)).flatten()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def hash_pixels(images: DataFrame, key: str) -> DataFrame:
    """Hash decoded images: column ``image`` as Spark's image source gives it. Others get no row."""

    def run(frames):
        for frame in frames:
            keys, hashes = [], []
            for name, h, w, n, data in zip(frame[key], frame["height"], frame["width"], frame["nChannels"], frame["data"]):
                cells = np.frombuffer(data, dtype=np.uint8)
                shape = (h, w) if n == 1 else (h, w, n)
                keys.append(name)
                hashes.append(perceptual_hash(cells.reshape(shape)))
            yield pd.DataFrame({key: keys, "phash": hashes})

    kind = images.schema[key].dataType.simpleString()
    flat = images.select(key, *[F.col(f"image.{f}").alias(f) for f in ("height", "width", "nChannels", "data")])
    usable = flat.filter((F.col("height") > 0) & (F.col("width") > 0) & F.col("nChannels").isin(1, 3, 4))
    return usable.mapInPandas(run, f"{key} {kind}, phash string")


def hash_images(spark: SparkSession, path: str) -> DataFrame:
    """Perceptual hash of every image under a path; files that do not decode are dropped."""
    images = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path)
    return hash_pixels(images.withColumn("path", F.col("image.origin")), "path")


# ---- file types

def file_type(content: Column) -> Column:
    """Kind, content type and suffix from the first 16 bytes."""
    head = F.hex(F.substring(content, 1, 16))
    mime = (
        F.when(head.startswith("FFD8"), "image/jpeg")
        .when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("47494638"), "image/gif")
        .when(head.startswith("52494646") & head.rlike("^(..)*57454250"), "image/webp")
        .when(F.substring(head, 9, 8) == "66747970", "video/mp4")
        .when(head.startswith("1A45DFA3"), "video/webm")
    )
    suffix = F.when(mime.startswith("image/"), F.regexp_replace(F.replace(mime, F.lit("jpeg"), F.lit("jpg")), "^image/", "."))
    return F.struct(
        F.split(mime, "/")[0].alias("kind"), mime.alias("content_type"), F.coalesce(suffix, F.lit(".jpg")).alias("suffix")
    )


def classify_files(spark: SparkSession, path: str) -> DataFrame:
    """Type of every file under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", file_type(F.col("content")).alias("type")).select("path", "length", "type.*")
