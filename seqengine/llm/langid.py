"""Language identification by the nearest of several centroids for each language.

A text is a vector of its byte n-grams (one to three bytes, A-Z lower-cased, hashed), with
weights (1 + log count) * inverse document frequency, of length one. The document
frequencies are counted over all labelled rows for learning. Each language has a few
centroids, from spherical k-means over a bounded sample of its rows. The answer is the
language of the centroid of the greatest cosine; a text further from it than nearly all
of that centroid's own sample is marked as rejected.

Rows and edge cases: a null text, or one without a letter, is `und` with score 0; with no
labelled row at all every text is `und`; null languages teach nothing; repeated rows get equal
answers; a null doc_id is not held out; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import ASCII_LOWER, byte_texts, materialize, small
from .linear import fold

DIMENSIONS = 1 << 14
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_SPACES = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def gram_counts(text: bytes) -> np.ndarray:
    """How often each hashed n-gram of the letters of a text occurs. Words stand apart by one space."""
    own = np.frombuffer(b" " + _SPACES.sub(b" ", text.translate(ASCII_LOWER)) + b" ", dtype=np.uint8).astype(np.uint32)
    two = own[:-1] | (own[1:] << np.uint32(8))
    three = two[:-1] | (own[2:] << np.uint32(16))
    bits = np.uint32(32 - 14)
    with np.errstate(over="ignore"):
        at = np.concatenate([own * np.uint32(64), (two * np.uint32(2654435761)) >> bits, (three * np.uint32(2246822519)) >> bits])
    return np.bincount(at, minlength=DIMENSIONS)


def unit_vectors(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    """One row for each text, of length one; zero for a text without n-grams."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    for row, text in zip(out, texts, strict=True):
        counts = gram_counts(text)
        at = np.flatnonzero(counts)
        values = (1 + np.log(counts[at])) * idf[at]
        row[at] = values / max(np.linalg.norm(values), 1e-12)
    return out


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows of texts (text) each n-gram occurs, and the number of rows; each task sums its own."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, rows = np.zeros(DIMENSIONS + 1, dtype=np.int64), 0
        for batch in batches:
            for text in byte_texts(batch.column("text")):
                total[:DIMENSIONS] += gram_counts(text) > 0
                rows += 1
        total[DIMENSIONS] = rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["at", "n"])

    summed = texts.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # DIMENSIONS + 1 rows at most
    out = np.zeros(DIMENSIONS + 1, dtype=np.int64)
    out[summed.column("at").to_numpy()] = summed.column("n").to_numpy()
    return out[:DIMENSIONS], int(out[DIMENSIONS])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of length one, and for each the cosine that 99 of 100 of its members reach."""
    k = min(k, len(x))
    centroids = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(axis=1)
        sums = np.stack([x[own == i].sum(axis=0) if (own == i).any() else centroids[i] for i in range(k)])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    near = x @ centroids.T
    own = near.argmax(axis=1)
    return centroids, np.array([np.quantile(near[own == i, i], 0.01) if (own == i).any() else 0.0 for i in range(k)])


class Centroids:
    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray, reach: np.ndarray):
        self.idf, self.langs, self.centroids, self.reach = idf, langs, centroids.astype(np.float32), reach

    def nearest(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine, and whether the text is too far from the centroid."""
        near = unit_vectors(texts, self.idf) @ self.centroids.T
        best = near.argmax(axis=1)
        cosine = np.clip(near[np.arange(len(texts)), best].astype(np.float64), 0.0, 1.0)
        return [self.langs[i] for i in best], cosine, cosine < self.reach[best]


def train_languages(docs: DataFrame, clusters: int = 3, sample: int = 800) -> Centroids | None:
    """Fits on docs (doc_id, text, lang). sample: at most so many rows of a language, the least by hash, make its centroids."""
    ship(docs.sparkSession)
    rank = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "text")
    known = docs.select(F.col("lang").cast("string").alias("lang"), "text", rank.alias("rank")).filter("text is not null and lang is not null")
    frequencies, rows = document_frequencies(known.select("text"))
    if not rows:
        return None
    idf = np.log((1 + rows) / (1 + frequencies)) + 1
    # copies have one rank; the least are found in parts of a language, then in all of it
    least = known.select("lang", "rank").distinct()
    for by in (["lang", F.pmod("rank", F.lit(64))], ["lang"]):
        least = least.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("rank"))).filter(F.col("k") <= sample).drop("k")
    least = materialize(least, "sample")
    chosen = known.join(F.broadcast(least) if small(least, 100_000, "lang") else least, ["lang", "rank"]).groupBy("lang", "rank").agg(F.min("text").alias("text"))

    def centre(rows):
        texts = [t.encode() for t in rows["text"]]
        centroids, reach = spherical_kmeans(unit_vectors(sorted(texts), idf), clusters)
        import pandas as pd

        return pd.DataFrame({"lang": rows["lang"].iloc[0], "centroid": [c.astype(np.float32).tobytes() for c in centroids], "reach": reach})

    found = chosen.select("lang", "text").groupBy("lang").applyInPandas(centre, "lang string, centroid binary, reach double").collect()  # a few rows a language
    found.sort(key=lambda r: (r["lang"], r["centroid"]))
    return Centroids(idf, [r["lang"] for r in found], np.stack([np.frombuffer(r["centroid"], np.float32) for r in found]), np.array([r["reach"] for r in found]))


def identify_languages(docs: DataFrame, model: Centroids | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def identify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = byte_texts(batch.column("text"))
            langs, scores, far = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
            spoken = [i for i, t in enumerate(texts) if shared.value is not None and has_letter(t)]
            for i in range(0, len(spoken), 64):
                own = spoken[i : i + 64]
                names, scores[own], far[own] = shared.value.nearest([texts[j] for j in own])
                for j, name in zip(own, names, strict=True):
                    langs[j] = name
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores), pa.array(far)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(identify, "doc_id long, lang_pred string, score double, rejected boolean")


def language_report(docs: DataFrame, folds: int = 4, held: int = 2, clusters: int = 3, sample: int = 800) -> DataFrame:
    """Learns from the rows outside fold `held` and answers for every row."""
    model = train_languages(docs.filter(F.coalesce(fold("doc_id", folds) != held, F.lit(False))), clusters, sample)
    found = identify_languages(docs, model)
    held_out = F.coalesce(fold("doc_id", folds) == held, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
