"""Language of whole texts, and of the spans of mixed texts.

The script of a word narrows its candidates; each word is scored for these by
letter pairs and triples; Viterbi then labels the words of the whole text, where a
change of language costs a penalty. The language with most letters is the text's.

Models are counts in a fixed number of buckets for each language, learned from a
bounded number of texts of each (``rows``, ``chars`` of each). Nulls, empty texts and texts without a letter are
``und`` with score 0 and no spans, and so is everything when no language is
learned. Equal scores go to the language first in order. Texts of any length are
read whole; rows that repeat get equal results.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import query, table
from .rolling import U, mix
from .storage import keyed, row_type, unpacked, windows_over

BUCKETS = 1 << 15
SWITCH = 12.0  # what a change of language costs, in nats
FOREIGN = -30.0  # of a word in a script that the language does not use
PIECE = 1 << 18  # letters scored at once
GROUP = 1 << 22  # characters whose words are labelled at once, or one text

#: First letters of the blocks of scripts; a letter belongs to the last one at or before it.
SCRIPTS = (0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xA00, 0xA80, 0xB00, 0xB80, 0xC00, 0xC80, 0xD00, 0xD80, 0xE00, 0xE80, 0xF00, 0x1000, 0x10A0, 0x1100, 0x1200, 0x13A0, 0x1780, 0x1800, 0x1E00, 0x1F00, 0x2000, 0x2E80, 0x3040, 0x30A0, 0x3100, 0x3400, 0xA000, 0xA4D0, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0xFB1D, 0xFB50, 0x10000, 0x20000)


@functools.cache
def _letters() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    for c in range(0x110000):
        table[c] = unicodedata.category(chr(c))[0] in "LM"
    return table


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def words_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first letter, end) of each run of letters."""
    edge = np.zeros(len(codes) + 2, dtype=np.int8)
    edge[1:-1] = _letters()[codes]
    step = np.diff(edge)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _buckets(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letter places, bucket of the pair, bucket of the triple around each letter); other characters count as one."""
    letters = _letters()[codes]
    plain = np.where(letters, codes, 0).astype(U)
    padded = np.zeros(len(codes) + 2, dtype=U)
    padded[1:-1] = plain
    at = np.flatnonzero(letters)
    pair = mix(padded[at + 1] << U(21) | padded[at + 2]) % U(BUCKETS)
    triple = mix((padded[at] << U(42) | padded[at + 1] << U(21) | padded[at + 2]) ^ U(0x9E3779B97F4A7C15)) % U(BUCKETS)
    return at, pair.astype(np.int64), triple.astype(np.int64) + BUCKETS


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (2 * BUCKETS, languages): log probabilities
    scripts: np.ndarray  # (scripts, languages): 0 or FOREIGN


def train(texts: list[str], langs: list[str]) -> Model:
    names = sorted(set(langs))
    counts = np.zeros((2 * BUCKETS, len(names)))
    scripts = np.zeros((len(SCRIPTS), len(names)))
    for text, lang in zip(texts, langs):
        codes, j = codes_of(text.lower()), names.index(lang)
        at, pair, triple = _buckets(codes)
        counts[:, j] += np.bincount(pair, minlength=2 * BUCKETS) + np.bincount(triple, minlength=2 * BUCKETS)
        scripts[:, j] += np.bincount(np.searchsorted(SCRIPTS, codes[at], side="right") - 1, minlength=len(SCRIPTS))
    counts += 0.02
    for part in (slice(0, BUCKETS), slice(BUCKETS, None)):
        counts[part] /= counts[part].sum(axis=0)
    used = scripts >= 0.005 * np.maximum(scripts.sum(axis=0), 1)
    used[~used.any(axis=1)] = True  # a script that nobody taught narrows nothing
    return Model(names, np.log(counts).astype(np.float32), np.where(used, 0, FOREIGN).astype(np.float32))


def word_scores(codes: np.ndarray, lo: np.ndarray, model: Model) -> np.ndarray:
    """Score of each word for each language: the mean of its letters' pairs and triples, with as many letters' weight."""
    at, pair, triple = _buckets(codes)
    starts = np.searchsorted(at, lo)
    out = np.empty((len(lo), len(model.langs)), dtype=np.float32)
    step = max(1024, PIECE // len(model.langs))
    first = 0
    while first < len(lo):
        end = max(first + 1, int(np.searchsorted(starts, starts[first] + step)))
        a, b = starts[first], starts[end] if end < len(starts) else len(at)
        out[first:end] = np.add.reduceat(0.5 * (model.table[pair[a:b]] + model.table[triple[a:b]]), starts[first:end] - a, axis=0)
        first = end
    script = np.searchsorted(SCRIPTS, codes[lo], side="right") - 1
    return out + model.scripts[script]


def viterbi(scores: np.ndarray, ends: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best label of each word; ``ends`` bounds the texts, which are walked side by side."""
    labels = np.zeros(len(scores), dtype=np.int64)
    sizes = np.diff(ends)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    if not len(order):
        return labels
    lo, sizes = ends[:-1][order], sizes[order]
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # texts with more than t words
    best = scores[lo].astype(np.float64)
    stay = np.zeros(scores.shape, dtype=bool)
    top = np.zeros(len(scores), dtype=np.int32)
    for t in range(1, sizes[0]):
        k = active[t]
        at, v = lo[:k] + t, best[:k]
        lead = v.argmax(axis=1)
        moved = v[np.arange(k), lead][:, None] - penalty
        stay[at], top[at] = v >= moved, lead
        best[:k] = np.maximum(v, moved) + scores[at]
    state = best.argmax(axis=1)
    for t in range(sizes[0] - 1, 0, -1):
        k = active[t]
        at = lo[:k] + t
        labels[at] = state[:k]
        state[:k] = np.where(stay[at, state[:k]], state[:k], top[at])
    labels[lo] = state
    return labels


def identify(texts: list[str], model: Model):
    """For each text: (language, share of its letters, spans [start, end, language] in characters)."""
    if not model.langs:
        yield from (("und", 0.0, []) for _ in texts)
        return
    lo = 0
    while lo < len(texts):
        hi, total = lo, 0
        while hi < len(texts) and (hi == lo or total + len(texts[hi]) < GROUP):
            total += len(texts[hi]) + 1
            hi += 1
        texts_ends = np.cumsum([0] + [len(t) + 1 for t in texts[lo:hi]])
        codes = codes_of("\n".join(t.lower() if len(t.lower()) == len(t) else t for t in texts[lo:hi]))
        first, end = words_of(codes)
        ends = np.searchsorted(first, texts_ends)
        scores = np.empty((len(first), len(model.langs)), dtype=np.float32)
        for a in range(0, len(first), PIECE // 8):  # pieces of many words
            b = min(len(first), a + PIECE // 8)
            piece = codes[first[a] : end[b - 1]]
            scores[a:b] = word_scores(piece, first[a:b] - first[a], model)
        labels = viterbi(scores, ends)
        letters = end - first
        for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            if a == b:
                yield "und", 0.0, []
                continue
            own = labels[a:b]
            by_lang = np.bincount(own, weights=letters[a:b], minlength=len(model.langs))
            j = int(by_lang.argmax())
            cut = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [b - a]))
            spans = [(int(first[a + p] - texts_ends[i]), int(end[a + q - 1] - texts_ends[i]), model.langs[own[p]]) for p, q in zip(cut[:-1].tolist(), cut[1:].tolist())]
            yield model.langs[j], float(by_lang[j] / by_lang.sum()), spans
        lo = hi


MOST = 16_000  # texts that a model is learned from


def sample(docs: DataFrame, text_col: str, lang_col: str, rows: int, chars: int) -> tuple[list[str], list[str]]:
    """About ``rows`` texts of each language, chosen by a hash of the text; of a text of more than ``chars`` characters windows
    over all of it. At most ``MOST`` texts come to the driver, however many languages there are."""
    known = docs.select(F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).dropna()
    counts = known.groupBy("_lang").count().collect()  # a row for each language
    rows = max(1, min(rows, MOST // max(1, len(counts))))
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col("_lang") == r["_lang"], F.lit(min(1.0, rows / r["count"]))).otherwise(share)
    picked = known.where(F.pmod(F.xxhash64("_text"), F.lit(1 << 30)) < share * (1 << 30))
    found = picked.select("_lang", windows_over(F.col("_text"), chars).alias("_text")).dropDuplicates().orderBy(F.xxhash64("_text")).limit(2 * rows * max(1, len(counts))).collect()
    return [r["_text"] for r in found], [r["_lang"] for r in found]


def identify_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with the text, and lang_pred, score and spans (array of start, end, lang)."""

    def find(batches):
        for batch in batches:
            found = list(identify(batch.column(1).to_pylist(), model))
            spans = pa.array([[{"start": a, "end": b, "lang": c} for a, b, c in x[2]] for x in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), spans], names=["_row", "_text", "lang_pred", "score", "spans"])

    rows = keyed(docs, id_col, text_col).select("_row", "_text")
    kind = f"_row {row_type(rows)}, _text string, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>"
    found = rows.mapInArrow(find, kind)
    text = F.when(~F.col("_row._no_text"), F.col("_text")).alias(text_col)
    return unpacked(found.withColumn(text_col, text), docs.columns, text_col, [text_col, "lang_pred", "score", "spans"])


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = 2000, chars: int = 20_000) -> Model:
    """The model of the rows that are not held out."""
    return train(*sample(docs.where(~F.coalesce(held_out(id_col), F.lit(False))), text_col, lang_col, rows, chars))


@query("op5_language")
def op5(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify_languages(docs.select("doc_id", "text"), fitted(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
