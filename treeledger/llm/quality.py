"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

A text is cut into chunks of ``CHUNK`` bytes, all of them, and every chunk is compressed with either dictionary. The
normalised difference of the two compressed sizes says which text it is more like; with the plain ratio and the chunk
that leans most to the bad side it goes into a logistic curve, fitted on labelled texts that the dictionaries have not
seen, whose intercept is moved to the share of good labels among all labelled rows. That makes the score a probability.

The fit uses a bounded sample: of the labelled rows outside fold 0, texts of at most ``FIT_CHARS`` characters, the
``FIT_DOCS`` of each class that come first by a hash of the id. Everything else covers all rows.

Cases: a null text scores as the empty text, and the empty text gets a score like any other. A null doc_id counts as the
id '' for its fold. Labels that are null are left out; of several labels for an id the greatest counts. With one class
only, the score is the share of good labels (0.5 without labels). Repeated rows are scored each. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.common import as_text, crc_fold, materialize

FIT_DOCS = 1500
FIT_CHARS = 20_000
CHUNK = 1024
DICTIONARY_BYTES = 65_536
LEVEL = 3
THRESHOLD = 0.3


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int) -> tuple[pd.DataFrame, float]:
    """A bounded sample (doc_id, text, y) of labelled rows outside fold 0, and the share of 1 among all such rows."""
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    y = y.where(crc_fold(F.col("doc_id")) != 0)
    share = y.agg(F.avg("y")).first()[0]
    # ids first, so that no text is sorted
    short = docs.where(F.length(as_text(F.col("text"))) <= max_chars).select("doc_id").join(y, "doc_id").distinct()
    short = short.withColumn("h", F.xxhash64("doc_id", F.lit(label)))
    picked = None
    for value in (0, 1):
        part = short.where(F.col("y") == value).orderBy("h", "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    picked = materialize(picked.select("doc_id", "y", "h"), "sample")
    texts = docs.select("doc_id", as_text(F.col("text")).alias("text")).where(F.length("text") <= max_chars)
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "h", "y").agg(F.min("text").alias("text"))  # one text an id
    rows = rows.orderBy("h", "doc_id").select("doc_id", "text", "y").toPandas()
    return rows, 0.5 if share is None else float(share)


def chunks(raw: bytes, n: int = CHUNK) -> list[bytes]:
    return [raw[i : i + n] for i in range(0, len(raw), n)] or [b""]


def build_dictionary(texts: list[str], size: int = DICTIONARY_BYTES) -> bytes:
    samples = [c for t in texts for c in chunks(t.encode("utf-8", "surrogatepass"), 512)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: the texts themselves are the dictionary
        return b"".join(samples)[-size:] or b" " * 8


class Sizes:
    """Compressed sizes of a text's chunks under either dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.by = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.by.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))

    def __call__(self, text: str) -> list[float]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        parts = chunks(raw)
        g, b = (np.array([len(z.compress(c)) for c in parts], float) for z in self.by)
        d, r = (b.sum() - g.sum()) / (b.sum() + g.sum()), float(np.log(g.sum() / (len(raw) + 1)))
        return [d, r, float(((b - g) / (b + g)).min()), d * d, r * r, d * r]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Newton's method; the last weight is the intercept, which is not shrunk."""
    x = np.c_[x, np.ones(len(x))]
    pull = np.full(x.shape[1], ridge)
    pull[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        w = w + np.linalg.solve(h, x.T @ (y - p) - pull * w)
    return w


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model: dictionaries, feature scales, weights; small and of bounded size."""
    rows, share = labelled_sample(docs, labels, "quality", FIT_DOCS, FIT_CHARS)
    good, bad = (rows[rows.y == v] for v in (1, 0))
    if min(len(good), len(bad)) < 4:
        return {"constant": share}
    model = {"good": build_dictionary(list(good.text[::2])), "bad": build_dictionary(list(bad.text[::2]))}
    sizes = Sizes(model["good"], model["bad"])
    rest = pd.concat([good[1::2], bad[1::2]])
    x, y = np.array([sizes(t) for t in rest.text]), rest.y.to_numpy(float)
    mean, sd = x.mean(0), x.std(0) + 1e-9
    w = fit_logistic((x - mean) / sd, y)
    odds = lambda p: np.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))
    w[-1] += odds(share) - odds(y.mean())
    return model | {"mean": mean, "sd": sd, "w": w}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score for each row of docs."""

    def run(batches):
        if "constant" in model:
            for p in batches:
                yield pd.DataFrame({"doc_id": p["doc_id"].astype("Int64"), "score": model["constant"]})
            return
        sizes = Sizes(model["good"], model["bad"])
        for p in batches:
            x = np.array([sizes(t) for t in p["text"]]).reshape(len(p), -1)
            z = ((x - model["mean"]) / model["sd"]) @ model["w"][:-1] + model["w"][-1] if len(p) else np.empty(0)
            yield pd.DataFrame({"doc_id": p["doc_id"].astype("Int64"), "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))})

    return docs.select(F.col("doc_id").cast("long"), as_text(F.col("text")).alias("text")).mapInPandas(run, "doc_id long, score double")
