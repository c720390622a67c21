"""Prediction by partial matching: how probable each text is under a trie of byte contexts learned from all learning texts.

A text is read as its words (runs of other than blanks), A-Z in lower case, joined by
one blank and closed by a line feed: the bytes that stand for the same tokens as the
base score's. A byte is predicted from the longest of its last ``ORDER`` bytes seen
in learning. Where it never followed that context, the model escapes to the next
shorter one (estimate D: a symbol seen c times weighs 2c - 1, the escape as much as
there are symbols) and leaves out the symbols that the longer context had; at the
end all bytes still left are equally likely. Before its first byte a text has line feeds.

Level L of the trie is a table of byte strings of length L with their counts. A row
needs the counts of its context (at most 256 rows share one) and the row without its
first byte (at most 256 rows share that): one window and one join a level, without
hot keys at any size. Texts are dealt into blocks of up to 64 MB. A block asks for
each of its distinct windows and words once, and the answers come back to it; so the
model is never sent to anyone, and what is shuffled follows the distinct windows of
blocks, not the length of the texts. Long texts are cut between words into pieces
whose sums are added up.

Nulls and odd rows: a null text is an empty one, which is its end alone. A null id or
a null condition is scored, never learned from. Rows that repeat are scored (and
learned from) each on its own. Without any learning rows every byte has probability
1/256. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .registry import query, table
from .storage import stored

ORDER = 5
BLOCK = 64 << 20  # bytes of a block
CHUNK = 4 << 20  # bytes of it held open at once
PART = 4 << 20  # bytes of a text split at once
LONG_WORD = 32
START = b"\n" * ORDER
WORD = 1 << 48  # the answer for a word has its number in the block above this, which no window reaches
_BLANK = re.compile(rb"[\x20\x09-\x0d]")

_BLOCKS = "kind int, block long, w long, n long, word binary, bytes binary, row array<long>, id array<long>, known_id array<boolean>, learn array<boolean>, size array<long>, last array<boolean>"
_SUMS = "row long, id long, known_id boolean, learn boolean, n_tokens long, n_known long, base_score double, score double"
_SCHEMA = pa.schema([
    ("kind", pa.int32()), ("block", pa.int64()), ("w", pa.int64()), ("n", pa.int64()), ("word", pa.binary()), ("bytes", pa.binary()), ("row", pa.list_(pa.int64())), ("id", pa.list_(pa.int64())),
    ("known_id", pa.list_(pa.bool_())), ("learn", pa.list_(pa.bool_())), ("size", pa.list_(pa.int64())), ("last", pa.list_(pa.bool_())),
])
PAYLOAD, WINDOWS, WORDS = range(3)


def word_key(word: bytes) -> bytes:
    return word if len(word) <= LONG_WORD else b"\xff" + hashlib.sha256(word).digest()


def pieces(text: bytes):
    """(context, bytes, last) of the pieces of a text: words joined by blanks, the end as a line feed."""
    context, lo, text = START, 0, text.lower()
    while True:
        cut = _BLANK.search(text, lo + PART) if len(text) - lo > PART else None
        piece = b" ".join(text[lo : cut.start() if cut else len(text)].split())
        if piece and context != START:
            piece = b" " + piece
        if cut is None:
            yield context, piece + b"\n", True
            return
        if piece:
            yield context, piece, False
            context = (context + piece)[-ORDER:]
        lo = cut.start()


def windows(buffer: bytes, size: np.ndarray) -> np.ndarray:
    """For each byte of the pieces (each behind ``ORDER`` bytes of context) the number made of it and the ``ORDER`` bytes before."""
    symbols = np.frombuffer(buffer, np.uint8)
    w = symbols[: len(symbols) - ORDER].astype(np.int64)
    for k in range(1, ORDER + 1):
        w <<= 8
        w |= symbols[k : len(symbols) - ORDER + k]
    if len(size) > 1:
        keep = np.ones(len(w), bool)
        ends = np.cumsum(size[:-1] + ORDER) - ORDER
        keep[(ends[:, None] + np.arange(ORDER)).ravel()] = False
        w = w[keep]
    return w


def _rows(kind: int, block: int, count: int, **columns) -> pa.RecordBatch:
    arrays = {"kind": pa.array(np.full(count, kind, np.int32)), "block": pa.array(np.full(count, block, np.int64))} | columns
    return pa.RecordBatch.from_arrays([arrays.get(f.name, pa.nulls(count, f.type)) for f in _SCHEMA], schema=_SCHEMA)


def _word_numbers(piece: bytes, numbers: dict[bytes, int]) -> list[int]:
    """The numbers of a piece's words in the order in which the block meets them."""
    number = numbers.setdefault
    return [number(x, len(numbers)) for x in piece.split()]


def _added(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows and their counts from two such lists."""
    w, n = np.concatenate([one[0], other[0]]), np.concatenate([one[1], other[1]])
    order = np.argsort(w, kind="stable")
    w, n = w[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])) if len(w) else np.empty(0, np.int64)
    return w[first], np.add.reduceat(n, first) if len(first) else n


class Block:
    """Texts that ask together: chunks of pieces go out as they fill, then the distinct windows and words with their counts in learning texts."""

    def __init__(self, number: int):
        self.number, self.chunks, self.used = number, 0, 0
        self.numbers: dict[bytes, int] = {}
        self.learned = np.zeros(1 << 16, np.int64)
        none = (np.empty(0, np.int64), np.empty(0, np.int64))
        self.windows, self.waiting = none, none

    def chunk(self, held: list[tuple]) -> pa.RecordBatch:
        """The row of one chunk; ``held``: (row, id, has an id, learn, context, piece, last)."""
        size = np.array([len(p[5]) for p in held], np.int64)
        buffer = b"".join(p[4] + p[5] for p in held)
        for p in held:
            words = _word_numbers(p[5], self.numbers)
            if len(self.numbers) > len(self.learned):
                self.learned = np.concatenate([self.learned, np.zeros(2 * len(self.numbers) - len(self.learned), np.int64)])
            if p[3] and words:
                np.add.at(self.learned, words, 1)
        w = windows(buffer, size)
        of = np.repeat(np.array([p[3] for p in held], bool), size)
        other = np.unique(w[~of])
        self.waiting = _added(self.waiting, _added(np.unique(w[of], return_counts=True), (other, np.zeros(len(other), np.int64))))
        if len(self.waiting[0]) > len(self.windows[0]):
            self.windows, self.waiting = _added(self.windows, self.waiting), (self.waiting[0][:0], self.waiting[1][:0])
        self.chunks, self.used = self.chunks + 1, self.used + len(buffer)
        names = {"row": 0, "id": 1, "known_id": 2, "learn": 3, "last": 6}
        return _rows(
            PAYLOAD, self.number, 1, n=pa.array([self.chunks]), bytes=pa.array([zstandard.ZstdCompressor(6).compress(buffer)], pa.binary()), size=pa.array([size], pa.list_(pa.int64())),
            **{name: pa.array([[p[i] for p in held]], _SCHEMA.field(name).type) for name, i in names.items()},
        )

    def asked(self):
        words = list(self.numbers)
        for lo in range(0, len(words), 1 << 16):
            some = words[lo : lo + (1 << 16)]
            numbers = np.arange(lo, lo + len(some))
            yield _rows(WORDS, self.number, len(some), w=pa.array(numbers), n=pa.array(self.learned[numbers]), word=pa.array([word_key(x) for x in some], pa.binary()))
        del words
        self.numbers = {}
        w, n = _added(self.windows, self.waiting)
        for lo in range(0, len(w), 1 << 17):
            yield _rows(WINDOWS, self.number, len(w[lo : lo + (1 << 17)]), w=pa.array(w[lo : lo + (1 << 17)]), n=pa.array(n[lo : lo + (1 << 17)], pa.int64()))


def _dealt(batches):
    """Blocks of the texts that a task reads."""
    task, row, held, used = TaskContext.get().partitionId() << 40, 0, [], 0
    block = Block(task)
    for batch in batches:
        for name, text, learn in zip(batch.column("_id"), batch.column("_text"), batch.column("_learn")):
            name, text = name.as_py(), (text.as_py() or "").encode()
            for context, piece, last in pieces(text):
                held.append((task | row, name or 0, name is not None, learn.as_py(), context, piece, last))
                used += len(piece) + ORDER
                if used >= CHUNK:
                    yield block.chunk(held)
                    held, used = [], 0
                    if block.used >= BLOCK:
                        yield from block.asked()
                        block = Block(block.number + 1)
            row += 1
    if held:
        yield block.chunk(held)
    if block.chunks:
        yield from block.asked()


def byte_levels(counted: DataFrame) -> DataFrame:
    """(w, start): log10 of the probability of the last byte of each window behind the others.

    ``counted``: window w and its count c in learning, also windows with count 0.
    """
    levels = {ORDER + 1: counted}
    for length in range(ORDER, 0, -1):
        suffix = F.col("w").bitwiseAND(F.lit((1 << 8 * length) - 1)).alias("w")
        levels[length] = stored(levels[length + 1].groupBy(suffix).agg(F.sum("c").alias("c")), "ppm-counts")
    of = W.partitionBy(F.shiftright("w", 8))
    met = (F.col("c") > 0).cast("long")
    rows = levels[1].select("w", "c", F.sum("c").over(of).alias("t"), F.sum(met).over(of).alias("d"))
    # skip: log10 probability after an escape from the row's own context
    rows = rows.withColumn("skip", -F.log10(F.greatest(F.lit(1), F.lit(256) - F.col("d"))))
    rows = rows.withColumn("start", F.when(F.col("t") == 0, -F.log10(F.lit(256.0))).otherwise(_first("skip")))
    below = stored(rows, "ppm-level")
    for length in range(2, ORDER + 2):
        shorter = below.select(F.col("w").alias("s"), *[F.col(c).alias(f"s_{c}") for c in ("c", "t", "d", "skip", "start")])
        rows = levels[length].withColumn("s", F.col("w").bitwiseAND(F.lit((1 << 8 * (length - 1)) - 1))).join(shorter, "s")
        rows = rows.select("*", F.sum("c").over(of).alias("t"), F.sum(met).over(of).alias("d"), F.sum(met * F.col("s_c")).over(of).alias("gone"))
        left, kinds = F.col("s_t") - F.col("gone"), F.col("s_d") - F.col("d")  # of the shorter context, without the symbols of this one
        skip = F.when(kinds <= 0, F.col("s_skip")).otherwise(
            -F.log10(2 * left) + F.when(F.col("s_c") > 0, F.log10(2 * F.col("s_c") - 1)).otherwise(F.log10(kinds) + F.col("s_skip"))
        )
        rows = rows.withColumn("skip", skip).withColumn("start", F.when(F.col("t") == 0, F.col("s_start")).otherwise(_first("skip")))
        below = stored(rows.select("w", "start") if length == ORDER + 1 else rows.select("w", "c", "t", "d", "skip", "start"), "ppm-level")
    return below


def _first(skip: str) -> Column:
    """The probability where the row's own context is the longest one seen."""
    return F.when(F.col("c") > 0, F.log10((2 * F.col("c") - 1) / (2 * F.col("t")))).otherwise(F.log10(F.col("d") / (2 * F.col("t"))) + F.col(skip))


class Answers:
    """Answers by window: a table of twice to four times as many places, tried from the window's hash on."""

    def __init__(self, w: np.ndarray, answer: np.ndarray):
        self.bits = max(4, int(2 * len(w)).bit_length())
        self.at = np.full(1 << self.bits, -1, np.int64)
        self.w, self.answer = np.append(w, -1), np.append(answer, 0.0)
        left, place = np.arange(len(w)), self._place(w)
        while len(left):
            free = self.at[place] < 0
            self.at[place[free]] = left[free]  # of several one stays
            lost = self.at[place] != left
            left, place = left[lost], (place[lost] + 1) & ((1 << self.bits) - 1)

    def _place(self, w: np.ndarray) -> np.ndarray:
        return ((w.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, w: np.ndarray) -> np.ndarray:
        """Every window has an answer."""
        place = self._place(w)
        found = self.at[place]
        wrong = np.flatnonzero(self.w[found] != w)
        while len(wrong):
            place[wrong] = (place[wrong] + 1) & ((1 << self.bits) - 1)
            found[wrong] = self.at[place[wrong]]
            wrong = wrong[self.w[found[wrong]] != w[wrong]]
        return self.answer[found]


def _summed(total: int, kinds: int, ends: int):
    """Sums of a block's pieces from its texts and the answers for its windows and words.

    ``total``, ``kinds`` and ``ends``: tokens, distinct tokens and ends among the learning tokens.
    """

    def base(c):
        return np.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))

    def add(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        w, answer = (answers.column(c).to_numpy() for c in ("w", "answer"))
        order = np.argsort(w, kind="stable")
        w, answer = w[order], answer[order]
        first_word = np.searchsorted(w, WORD)
        counts = answer[first_word:]  # by the number of the word
        of_word = base(counts)
        answered = Answers(w[:first_word], answer[:first_word])
        numbers: dict[bytes, int] = {}
        parts = []
        for at in np.argsort(chunks.column("n").to_numpy()).tolist():
            row, name, known_id, learn, last, size = (chunks.column(c)[at].as_py() for c in ("row", "id", "known_id", "learn", "last", "size"))
            buffer = zstandard.ZstdDecompressor().decompress(chunks.column("bytes")[at].as_py())
            score = np.add.reduceat(answered.of(windows(buffer, np.array(size))), np.concatenate([[0], np.cumsum(size[:-1])]).astype(np.int64))
            tokens, known, sums, lo = [], [], [], 0
            for length, end in zip(size, last):
                words = np.array(_word_numbers(buffer[lo + ORDER : lo + ORDER + length], numbers), np.int64)
                lo += ORDER + length
                tokens.append(len(words) + end)
                known.append(int(np.count_nonzero(counts[words])) + (end and ends > 0))
                sums.append(float(of_word[words].sum()) + (float(base(ends)) if end else 0.0))
            parts.append(pa.table({
                "row": pa.array(row, pa.int64()), "id": pa.array(name, pa.int64()), "known_id": pa.array(known_id, pa.bool_()), "learn": pa.array(learn, pa.bool_()),
                "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(known, pa.int64()), "base_score": pa.array(sums, pa.float64()), "score": pa.array(score, pa.float64()),
            }))
        return pa.concat_tables(parts)

    return add


def score_texts(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, learned, n_tokens (words and one end), n_known and train_tokens, base_score (log10 probability by the
    frequencies of tokens) and score (log10 probability by the trie) of each row; ``learn`` marks the rows to learn from."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), (F.coalesce(learn, F.lit(False)) & F.col(id_col).isNotNull()).alias("_learn"))
    blocks = stored(rows.mapInArrow(_dealt, _BLOCKS), "ppm-blocks")
    texts = blocks.where(f"kind = {PAYLOAD}").select(F.col("block").alias("of_block"), "n", "bytes", "row", "id", "known_id", "learn", "size", "last")
    asked = blocks.where(f"kind = {WINDOWS}")
    start = byte_levels(stored(asked.groupBy("w").agg(F.sum("n").alias("c")), "ppm-counts"))
    # A word has a row in each block that holds it, so its blocks can be looked at together.
    alike = W.partitionBy("word")
    words = stored(blocks.where(f"kind = {WORDS}").select("block", "w", F.sum("n").over(alike).alias("c"), F.row_number().over(alike.orderBy("block")).alias("k")), "ppm-words")
    met = words.where("k = 1 and c > 0").agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    ends = texts.select(F.explode(F.arrays_zip("learn", "last")).alias("x")).where("x.learn and x.last").count()
    total, kinds = (met["n"] or 0) + ends, met["v"] + (ends > 0)
    answers = asked.join(start, "w").select("block", "w", F.col("start").alias("answer"))
    answers = answers.unionByName(words.select("block", (F.col("w") + WORD).alias("w"), F.col("c").cast("double").alias("answer")))
    sums = texts.groupBy("of_block").cogroup(answers.groupBy("block")).applyInArrow(_summed(total, kinds, ends), _SUMS)
    whole = sums.groupBy("row").agg(
        F.first("id").alias("id"), F.first("known_id").alias("known_id"), F.first("learn").alias("learned"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    )
    return whole.select(F.when(F.col("known_id"), F.col("id")).alias(id_col), "learned", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


@query("op11_ppm")
def op11(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    found = score_texts(docs, ~held_out)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
