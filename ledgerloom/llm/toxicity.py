"""Toxicity by compression distance: which of two zstandard dictionaries makes a window of text shorter?

One dictionary is trained on toxic and one on ordinary text, each from the words
that its class has more often than chance allows (log-likelihood ratio), or, if there
are none, from the few that come nearest to it; both end in the same base, trained on words
of no class, so that all else compresses alike and the difference of the two lengths
is the class's own. A text is scored by the differences of all its windows; how they
become a score, and the threshold that maps to 0.5, is fitted on rows that trained
no dictionary.

Nulls and empty texts have no window and get the score of a text without a
difference. Without labelled rows of both classes every score is 0. Texts of any length are read whole; only
training takes a bounded sample (``rows`` a class, ``chars`` of each). Rows that
repeat get equal scores.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import query, table
from .storage import keyed, row_type, unpacked, windows_over

WINDOW, STEP = 12, 6  # words
FELT = 3  # bytes by which a window must be shorter to count
SURE, RATIO, FEWEST = 12, 2, 8  # log-likelihood ratio of a typical word, how much more often its class has it, words of a class at least
DICTIONARY, BASE = 2048, 16384  # bytes


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    weights: list[float] = field(default_factory=list)  # over the standardised features, the constant last
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)


def windows(text: str) -> list[bytes]:
    words = text.lower().split()
    return [" ".join(words[i : i + WINDOW]).encode() for i in range(0, len(words) - WINDOW + STEP if len(words) > WINDOW else len(words[:1]), STEP)]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    as_dict = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=as_dict, write_content_size=False, write_dict_id=False, write_checksum=False)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.pair = [_compressor(x) for x in (model.ordinary, model.toxic)] if model.toxic else None

    def features(self, texts: list[str]) -> np.ndarray:
        """For each text: greatest, three greatest and mean difference, share and number of windows that count, length."""
        out = np.zeros((len(texts), 6))
        lo = 0
        while lo < len(texts):  # groups of texts of about a megabyte share a call
            parts, total, hi = [], 0, lo
            while hi < len(texts) and (hi == lo or total + len(texts[hi]) < 1 << 20):
                parts.append(windows(texts[hi]))
                total += len(texts[hi])
                hi += 1
            flat = [w for p in parts for w in p]
            if flat:
                ordinary, toxic = (np.concatenate([[len(x) for x in c.multi_compress_to_buffer(flat[i : i + 4096])] for i in range(0, len(flat), 4096)]) for c in self.pair)
                diff, at = (ordinary - toxic).astype(float), 0
                for i, p in enumerate(parts, lo):
                    d = diff[at : at + len(p)]
                    at += len(p)
                    if len(d):
                        top = np.partition(d, max(0, len(d) - 3))[-3:]
                        felt = d >= FELT
                        out[i] = d.max(), top.mean(), d.mean(), felt.mean(), np.log1p(felt.sum()), np.log1p(len(d))
            lo = hi
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.pair:
            return np.zeros(len(texts))
        m = self.model
        x = np.clip((self.features(texts) - m.mean) / m.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(x @ m.weights[:-1] + m.weights[-1], -30, 30)))


def _content(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on the samples; the samples themselves where they are too few to train on."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(dict.fromkeys(samples))[:size]


def _surprise(a: int, m: int, b: int, n: int) -> float:
    """Log-likelihood ratio of ``a`` of ``m`` texts against ``b`` of ``n``: about the square of the standard deviations between them."""
    share = (a + b) / (m + n)
    terms = ((a, m * share), (m - a, m * (1 - share)), (b, n * share), (n - b, n * (1 - share)))
    return 2 * sum(x * log(x / e) for x, e in terms if x)


def train(texts: list[str], toxic: list[bool]) -> Model:
    """Dictionaries from the even rows of each class, weights and threshold from the odd ones."""
    own = {c: [t.lower() for t, x in zip(texts, toxic) if x == c] for c in (True, False)}
    if min(len(v) for v in own.values()) < 2:
        return Model()
    learn = {c: v[::2] for c, v in own.items()}
    seen = {c: Counter(w for t in v for w in set(t.split())) for c, v in learn.items()}

    def typical(c: bool) -> set[str]:
        here, there = len(learn[c]), len(learn[not c])
        found = {w: _surprise(n, here, seen[not c][w], there) for w, n in seen[c].items() if n / here >= RATIO * seen[not c][w] / there}
        return {w for w in found if found[w] >= SURE} | set(sorted(found, key=lambda w: (-found[w], w))[:FEWEST])

    words = {c: typical(c) for c in own}
    kept = {c: [" ".join(w for w in t.split() if w in words[c]).encode() for t in v] for c, v in learn.items()}
    base = _content([" ".join(w for w in t.split() if w not in words[True] and w not in words[False]).encode() for v in learn.values() for t in v], BASE)
    pair = [_content(kept[c], DICTIONARY) for c in (True, False)]
    size = max(map(len, pair))
    # Of one size, so that the base is equally far away in both.
    model = Model(*(b"\0" * (size - len(p)) + p + base for p in pair))
    check = [(t, c) for c, v in own.items() for t in v[1::2]]
    y = np.array([c for _, c in check], dtype=float)
    x = Scorer(model).features([t for t, _ in check])
    model.mean, model.scale = x.mean(axis=0).tolist(), (x.std(axis=0) + 1e-9).tolist()
    x = np.column_stack((np.clip((x - model.mean) / model.scale, -8, 8), np.ones(len(y))))
    w = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + np.eye(len(w)), x.T @ (p - y) + w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    # The threshold of the best F1 becomes the score 0.5.
    order = np.argsort(-(x @ w), kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][np.diff((x @ w)[order]) > -1e-9] = 0  # rows of equal score fall on one side
    w[-1] -= (x @ w)[order][int(f1.argmax())] - 1e-6
    model.weights = w.tolist()
    return model


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int, chars: int) -> tuple[list[str], list[bool]]:
    """At most ``rows`` labelled rows of each class, in the order of a hash of their ids; of a text of more than ``chars``
    characters windows over all of it. No more is brought to the driver."""
    known = labels.select(F.col(id_col).alias("_id"), (F.col(label_col) == 1).alias("_toxic")).dropna()
    picked = [known.where(F.col("_toxic") == c).orderBy(F.xxhash64("_id"), "_id").limit(rows) for c in (True, False)]
    picked = F.broadcast(picked[0].unionByName(picked[1]).distinct())  # 2 * rows ids at most
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).dropna().join(picked, "_id")
    found = texts.select("_id", windows_over(F.col("_text"), chars).alias("_text"), "_toxic").orderBy("_toxic", F.xxhash64("_id", "_text")).limit(4 * rows).collect()
    return [r["_text"] for r in found], [r["_toxic"] for r in found]


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` without the text, and score (0 to 1) and predicted (1 from 0.5 on)."""

    def score(batches):
        scorer = Scorer(model)
        for batch in batches:
            scores = scorer.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["_row", "score", "predicted"])

    rows = keyed(docs, id_col, text_col).select("_row", "_text")
    return unpacked(rows.mapInArrow(score, f"_row {row_type(rows)}, score double, predicted int"), docs.columns, text_col, ["score", "predicted"])


@query("op2_toxicity")
def op2(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out")
    labels = table(spark, sf_dir, "labels").where(~held_out)
    model = train(*sample(docs, labels, "doc_id", "text", "toxic", rows=2000, chars=20_000))
    return score_toxicity(docs, model).select("doc_id", held_out, "score", "predicted")
