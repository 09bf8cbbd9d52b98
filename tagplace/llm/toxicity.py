"""Toxicity by compression distance: two zstandard dictionaries, windows compressed under each.

One dictionary is trained on windows of ordinary texts, the other on the words that mark toxic texts (far more
frequent in toxic than in ordinary training texts, and in several of them). Toxic texts are ordinary text with
toxic words in it, so the toxic side compresses with both dictionaries' contents and the ordinary side with its
own alone; what an ordinary window gains from the second is small, and what a toxic one gains is not. A text's
score is a logistic function of how many of its windows gain how many bytes, fitted on labelled rows that
trained neither dictionary.

The labelled sample is bounded (``sample`` rows, in the order of a hash of doc_id, and texts of at most
``sample_chars`` characters); whole texts of all rows are scored. Only text enters a score.

A very long text counts like any other: the features are logarithms and shares, so they are as defined beyond the
length of the sampled texts.

Edge cases: a null or empty text has no window and gets the model's intercept as its score. Rows without a label,
with a null label or a null doc_id train nothing; a doc_id with several labels counts as toxic if any says so.
With no toxic or no ordinary training row the model has no evidence: every score is the share of toxic rows.
Other columns pass through; those named like a new column (score, predicted) are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, with_arrow

#: Bytes a window gains at least, for the counts that make up the features.
GAINS = (2, 3, 4, 5, 6, 8)
#: Labelled rows that a model is trained on at most.
SAMPLE = 12_000


def windows(text: str, width: int) -> list[bytes]:
    """Runs of whole words of at least ``width`` bytes (the last may be shorter), a space on either side."""
    out, own, size = [], [], 0
    for w in text.encode().lower().split():
        own.append(w)
        size += len(w) + 1
        if size >= width:
            out.append(b" " + b" ".join(own) + b" ")
            own, size = [], 0
    if own:
        out.append(b" " + b" ".join(own) + b" ")
    return out


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    width: int
    level: int
    mean: list[float]
    scale: list[float]
    weights: list[float]

    def compressors(self):
        import zstandard as Z

        made = []
        for raw in (self.ordinary, self.toxic + self.ordinary):
            d = Z.ZstdCompressionDict(raw, dict_type=Z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=self.level)
            made.append(Z.ZstdCompressor(dict_data=d, level=self.level, write_content_size=False, write_checksum=False, write_dict_id=False))
        return made

    def features(self, text: str, compressors) -> np.ndarray:
        ordinary, toxic = compressors[0].compress, compressors[1].compress
        gain = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text, self.width)] or [0])
        counts = [(gain >= g).sum() for g in GAINS]
        top = np.sort(gain)[-3:]
        return np.array([math.log(len(gain)), *np.log1p(counts), *(np.sqrt(np.array(counts) / len(gain))), top.max(), top.mean()])

    def score(self, features: np.ndarray) -> np.ndarray:
        x = (np.atleast_2d(features) - self.mean) / self.scale
        z = x @ np.array(self.weights[1:]) + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    """Content of a trained dictionary; too few samples for training are taken as they are."""
    import zstandard as Z

    while size >= 256:
        try:
            return Z.train_dictionary(size, samples).as_bytes()
        except Z.ZstdError:
            size //= 2
    return b" ".join(samples)[-4096:] or b" " * 8


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Intercept and weights by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, keep = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    keep[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, text, label) of a bounded sample of labelled rows: the ids come first, so texts are not shuffled."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("own")).agg(F.max(label_col).alias("toxic"))
    h = F.md5(F.col("own").cast("string").cast("binary"))
    # a cut at a hash with room to spare comes first, so that tasks don't each send a whole sample
    share = min(1.0, 1.5 * sample / max(1, own.count()) + 1e-4)
    some = own.where(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") < F.lit(math.ceil(share * 2**32))).orderBy(h).limit(sample)
    return docs.select(id_col, text_col).join(F.broadcast(some), F.col(id_col) == F.col("own")).select(id_col, text_col, F.col("toxic").alias(label_col))


def fit(labelled: DataFrame, sample: int = SAMPLE, sample_chars: int = 30_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", width: int = 48, level: int = 9, ordinary_size: int = 1 << 15, toxic_size: int = 1 << 14, ridge: float = 1.0, repeats: int = 3, odds: float = 3.5, blocks: int = 20_000) -> Model:
    """Train on a bounded sample of ``labelled`` rows (id, text, label): ``sample`` rows of at most ``sample_chars``
    characters. A word marks toxic texts if ``repeats`` of them have it and its log odds exceed ``odds``. Ordinary
    texts give about ``blocks`` blocks of 512 bytes, evenly spread over all of them, to their dictionary."""
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (F.coalesce(F.length(text_col), F.lit(0)) <= sample_chars))
    rows = rows.select(F.md5(F.col(id_col).cast("string").cast("binary")).alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), (F.col(label_col) == 1).alias("toxic"))
    got = [tuple(r) for r in rows.orderBy("h", "text").limit(sample).collect()]
    share = (sum(t for _, _, t in got) + 0.5) / (len(got) + 10)
    train, rest = [], []
    for h, text, is_toxic in got:
        (rest if int(h[:8], 16) % 3 == 2 else train).append((text, is_toxic))
    del got
    words = lambda x: set(x.encode().lower().split())
    toxic, ordinary = [x for x, t in train if t], [x for x, t in train if not t]
    t = Counter(w for x in toxic for w in words(x))
    t = Counter({w: n for w, n in t.items() if n >= repeats})
    o = Counter(w for x in ordinary for w in words(x).intersection(t))  # only words that toxic texts repeat

    def log_odds(w: bytes) -> float:
        return math.log((t[w] + 0.1) / (len(toxic) + 0.2)) - math.log((o[w] + 0.1) / (len(ordinary) + 0.2))

    marks = {w for w in t if log_odds(w) > odds}
    marked = [b" " + b" ".join(w for w in x.encode().lower().split() if w in marks) + b" " for x in toxic]
    step = max(1, sum(-(-len(x) // 512) for x in ordinary) // blocks)
    plain, nth = [], 0
    for x in ordinary:
        raw = x.encode().lower()
        for i in range(-nth % step * 512, len(raw), step * 512):
            plain.append(raw[i : i + 512])
        nth += -(-len(raw) // 512)
    model = Model(_dictionary(ordinary_size, plain), _dictionary(toxic_size, [m for m in marked if len(m) >= 8]), width, level, [0.0], [1.0], [0.0])
    y = np.array([t for _, t in rest], float)
    if not toxic or not ordinary or not 0 < y.sum() < len(y):
        n = len(model.features("", model.compressors()))
        model.mean, model.scale, model.weights = [0.0] * n, [1.0] * n, [math.log(share / (1 - share))] + [0.0] * n
        return model
    both = model.compressors()
    x = np.array([model.features(x, both) for x, _ in rest])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    model.mean, model.scale = mean.tolist(), scale.tolist()
    model.weights = _logistic((x - mean) / scale, y, ridge).tolist()
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` with score and predicted (1 from ``threshold`` on)."""
    small_batches(docs.sparkSession)

    def run(batches):
        both = model.compressors()
        for batch in batches:
            x = np.array([model.features(t or "", both) for t in batch.column(text_col).to_pylist()])
            s = model.score(x) if len(x) else np.zeros(0)
            yield batch, {"score": pa.array(s, pa.float64()), "predicted": pa.array((s >= threshold).astype(np.int32))}

    return with_arrow(docs, run, "score double, predicted int")
