"""Vector bin packing: tokenised examples into sequences under limits on tokens, segments and loss-bearing tokens.

Each task packs the rows it reads, so nothing is shuffled. Whole sequences are cut
off long examples first. What is left waits in a pool; while a sequence is open, the
piece with the greatest dot product of its demand and the room left, each weighted
by how scarce it is, goes in. When none fits, the piece with the greatest product is
cut to the room, unless that is below ``min_piece`` tokens.

Nulls and empty texts are examples of the end id alone. Ties go to the piece that
came first. Rows that repeat are packed each on its own. Long texts are tokenised
in parts that meet where tokens meet, so memory is bounded by the ids of one text.
Without a prompt column every token bears loss, and the limit on loss is the one on tokens.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import query, table
from .storage import keyed, row_type, unpacked

RESULTS = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
POOL = 4096  # pieces that wait in a task
PART = 1 << 20  # characters tokenised at once
BLANKS = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_RUN = re.compile(BLANKS + "{65536,}")  # runs of blanks that the pattern's matcher is spared
END_ID = 1
END_OF_TEXT = "<|endoftext|>"  # the tokenizer's one special token


@functools.cache
def _encoding(ranks_path: str) -> tuple[tiktoken.Encoding, int]:
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), len(ranks)


def _parts(text: str):
    """The text cut before single blanks between other characters: no token crosses there."""
    lo = 0
    while len(text) - lo > PART:
        cut = text.find(" ", lo + PART)
        while 0 <= cut < len(text) - 1 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if not 0 < cut < len(text) - 1:
            break
        yield text[lo:cut]
        lo = cut
    yield text[lo:]


def _ids(text: str, encoding: tiktoken.Encoding):
    """Ids of the text part by part. A long run of blanks is cut as the tokenizer's pattern cuts it: one piece, but for its
    last character where something else follows."""
    lo = 0
    for run in LONG_RUN.finditer(text):
        cut = run.end() - (run.end() < len(text))
        for part in _parts(text[lo : run.start()]):
            yield encoding.encode_ordinary(part)
        yield encoding._encode_single_piece(text[run.start() : cut])
        lo = cut
    for part in _parts(text[lo:]):
        yield encoding.encode_ordinary(part)


def token_ids(text: str, ranks_path: str) -> np.ndarray:
    """The ids that the tokenizer file gives the text, without an end id."""
    encoding, special = _encoding(ranks_path)
    out = []
    for i, plain in enumerate(text.split(END_OF_TEXT)):
        if i:
            out.append(np.array([special], dtype="<u4"))
        out.extend(np.array(ids, dtype="<u4") for ids in _ids(plain, encoding) if ids)
    return np.concatenate(out) if len(out) > 1 else out[0] if out else np.empty(0, "<u4")


class Packer:
    """Pieces are (row, first id, end, ids, loss from); ``out`` gets (row, start, ids, sequence, offset, loss)."""

    def __init__(self, first_sequence: int, tokens: int, segments: int, loss: int, min_piece: int):
        self.limits = np.array([tokens, segments, loss], dtype=float)
        self.tokens, self.segments, self.loss, self.min_piece = tokens, segments, loss, min_piece
        self.sequence = first_sequence
        self.pool: list[list] = []
        self.out: list[tuple] = []

    def _place(self, row, start, ids, no_loss, sequence, offset):
        self.out.append((row, start, ids, sequence, offset, max(0, len(ids) - max(0, no_loss - start))))

    def add(self, row, ids: np.ndarray, no_loss: int = 0):
        """``no_loss``: so many ids at the front bear no loss."""
        at = 0
        while len(ids) - at >= self.tokens and self.loss >= self.tokens:
            self._place(row, at, ids[at : at + self.tokens], no_loss, self.sequence, 0)
            self.sequence += 1
            at += self.tokens
        if at < len(ids):
            self.pool.append([row, at, ids[at:].copy() if at else ids, no_loss])

    def full(self) -> bool:
        return len(self.pool) >= POOL

    def pack(self, keep: int = 0):
        """Pack the pool until at most ``keep`` pieces are left."""
        pool = self.pool
        size = np.array([len(p[2]) for p in pool], dtype=float)
        loss = np.array([max(0, len(p[2]) - max(0, p[3] - p[1])) for p in pool], dtype=float)
        alive = np.ones(len(pool), dtype=bool)
        scarce = np.array([size.mean(), 1.0, loss.mean()]) / self.limits if pool else self.limits
        scarce = scarce / self.limits**2
        left = len(pool)
        while left > keep:
            room, offset = self.limits.copy(), 0
            while left and room[0] > 0 and room[1] > 0:
                product = np.where(alive, size * (scarce[0] * room[0]) + scarce[1] * room[1] + loss * (scarce[2] * room[2]), -1.0)
                fits = (size <= room[0]) & (loss <= room[2])
                fitting = np.where(fits, product, -1.0)
                i = int(fitting.argmax())
                if fitting[i] < 0:  # none fits whole
                    if room[0] < self.min_piece:
                        break
                    i = int(product.argmax())
                    row, start, ids, no_loss = pool[i]
                    free = max(0, no_loss - start)
                    take = int(min(room[0], free + room[2], len(ids)))
                    if take < 1 or (take < self.min_piece and offset):
                        break
                    part, pool[i] = ids[:take], [row, start + take, ids[take:], no_loss]
                    self._place(row, start, part, no_loss, self.sequence, offset)
                    taken = np.array([take, 1, max(0, take - free)])
                    size[i], loss[i] = size[i] - take, loss[i] - taken[2]
                else:
                    row, start, ids, no_loss = pool[i]
                    self._place(row, start, ids, no_loss, self.sequence, offset)
                    taken = np.array([size[i], 1, loss[i]])
                    alive[i] = False
                    left -= 1
                room -= taken
                offset += int(taken[0])
            self.sequence += 1
        self.pool = [p for p, a in zip(pool, alive) if a]


def pack_sequences(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None,
    tokens: int = 2048, segments: int = 64, loss: int | None = None, min_piece: int = 16, ranks_path: str | None = None,
) -> DataFrame:
    """One row for each piece: the columns of ``docs`` without the text, and start, length, ids (binary, little-endian
    unsigned 32 bit), doc_tokens, sequence_id, offset, loss_tokens.

    The ids of ``prompt_col`` stand before those of the text and bear no loss. ``loss`` is the limit of loss-bearing
    tokens in a sequence (default: ``tokens``). ``ranks_path`` is the tokenizer's vocabulary as ranks.
    """
    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    loss = tokens if loss is None else loss
    if min(tokens, segments, loss) < 1:
        raise ValueError("every limit must be at least 1")

    def pack(batches):
        packer = Packer(TaskContext.get().partitionId() << 40, tokens, segments, loss, min_piece)

        def drained():
            placed, packer.out = packer.out, []
            for lo in range(0, len(placed), POOL):
                part = placed[lo : lo + POOL]
                columns = [
                    pa.array([p[0][0] for p in part], row_kind), pa.array([p[1] for p in part], pa.int64()), pa.array([len(p[2]) for p in part], pa.int64()),
                    pa.array([p[2].tobytes() for p in part], pa.binary()), pa.array([p[0][1] for p in part], pa.int64()),
                    pa.array([p[3] for p in part], pa.int64()), pa.array([p[4] for p in part], pa.int64()), pa.array([p[5] for p in part], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["_row", *RESULTS])

        row_kind = None
        for batch in batches:
            row_kind = batch.schema.field(0).type
            others, prompts, texts = batch.column(0), batch.column(1), batch.column(2)
            for i in range(batch.num_rows):
                prompt = token_ids(prompts[i].as_py(), path)
                ids = np.concatenate((prompt, token_ids(texts[i].as_py(), path), np.array([END_ID], "<u4")))
                packer.add((others[i].as_py(), len(ids)), ids, len(prompt))
                if packer.full():
                    packer.pack(POOL // 4)
                if len(packer.out) >= POOL:
                    yield from drained()
        packer.pack()
        yield from drained()

    prompt = F.lit("") if prompt_col is None else F.coalesce(F.col("_row")[prompt_col].cast("string"), F.lit(""))
    rows = keyed(docs, id_col, text_col).select("_row", prompt.alias("_prompt"), "_text")
    kind = f"_row {row_type(rows)}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, loss_tokens long"
    return unpacked(rows.mapInArrow(pack, kind), docs.columns, text_col, RESULTS)


@query("op3_packing")
def op3(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_sequences(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
