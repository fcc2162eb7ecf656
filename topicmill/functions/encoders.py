"""Encoders that run a model over texts in batches, and a small model fitted on the texts themselves.

An encoder maps a DataFrame with ``text`` to one with ``embedding``, as ``plans.pipelines.encode_papers`` takes it.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import normalized

#: Terms of a text after A-Z are lower-cased, and the same before that.
TERM, ANY_CASE = r"[a-z0-9À-ÿ]+", r"[A-Za-z0-9À-ÿ]+"
A_Z = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BUCKETS = 1 << 12
#: Terms that a task remembers at once.
KNOWN = 1 << 17


def model_encoder(load: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = 50, column: str = "text", precise: bool = False) -> Callable[[DataFrame], DataFrame]:
    """An encoder from a model: ``load()`` is called once a Python worker and returns a function from texts (n) to vectors (n x d).

    ``batch_size`` texts at most go to one call, so a model's memory does not grow
    with the partition. Vectors are scaled to length one in the JVM; one of length
    zero stays so. Null texts are read as empty. Other columns stay as they are.
    Components are floats, or doubles if ``precise``.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, DoubleType, FloatType

    predict = predict_batch_udf(load, return_type=ArrayType(DoubleType() if precise else FloatType()), batch_size=batch_size)

    def encode(texts: DataFrame) -> DataFrame:
        kind = "array<double>" if precise else "array<float>"
        # The call has a column of its own, so that what scales the vector does not repeat it.
        raw = texts.select("*", predict(F.coalesce(F.col(column), F.lit(""))).cast("array<double>").alias("_raw_vector"))
        return raw.withColumn("embedding", normalized(F.col("_raw_vector")).cast(kind)).drop("_raw_vector")

    return encode


def term_digest(term: str) -> tuple[int, int]:
    """Bucket and 32 sign bits of a term, from its MD5."""
    digest = hashlib.md5(term.encode()).hexdigest()
    return int(digest[:8], 16) % BUCKETS, int(digest[8:16], 16)


def lowered(term: str) -> str:
    """``term`` with A-Z, and no other letters, lower-cased."""
    return term.lower() if term.isascii() else term.translate(str.maketrans(*A_Z))


def fit_term_weights(texts: DataFrame, column: str = "text") -> np.ndarray:
    """The inverse document frequency of each of ``BUCKETS`` term buckets over all texts, ln((1 + n) / (1 + df)) + 1.

    Buckets are counted once a text, by task and then in Spark; the driver receives ``BUCKETS`` + 1 rows at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, known, df, n = re.compile(ANY_CASE).findall, {}, np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0):
                terms = set(find(text.as_py() or ""))
                if len(known) >= KNOWN:
                    known.clear()  # a cache of bounded size
                for term in terms.difference(known):
                    known[term] = term_digest(lowered(term))[0]
                df[list({known[term] for term in terms})] += 1
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, held]), pa.array(np.r_[n, df[held]])], ["bucket", "n"])

    counts = texts.select(F.col(column).cast("string")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    df, n = np.zeros(BUCKETS), 0
    for row in counts.collect():
        if row["bucket"] < 0:
            n = row["n"]
        else:
            df[row["bucket"]] = row["n"]
    return np.log((1 + n) / (1 + df)) + 1


def term_model(weights: np.ndarray, dims: int = 32) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """A loader for ``model_encoder``: the signs of each term in ``dims`` (32 at most) directions, summed with its bucket's weight.

    A text's terms are counted first; each distinct one adds its vector times its number.
    """
    if not 1 <= dims <= 32:
        raise ValueError("dims must be from 1 to 32")

    def load() -> Callable[[np.ndarray], np.ndarray]:
        find, known, shifts = re.compile(ANY_CASE).findall, {}, np.arange(dims)

        def digest(term: str) -> tuple[int, int]:
            if term not in known:
                known[term] = term_digest(lowered(term))
            return known[term]

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dims))
            for i, text in enumerate(texts):
                if len(known) >= KNOWN:
                    known.clear()  # a cache of bounded size
                if found := Counter(find(text)):
                    buckets, bits = np.array([digest(term) for term in found]).T
                    own = weights[buckets] * np.fromiter(found.values(), np.int64, len(found))
                    out[i] = own @ (1.0 - 2.0 * ((bits[:, None] >> shifts) & 1))
            return out

        return predict

    return load
