"""Substring dedup: remove every word that a window of ``width`` words covers which also starts anywhere else.

Recurring windows are confirmed by grouping hashes (``repeats``). Each shard of
documents then compiles the passages confirmed for it into Aho-Corasick automata,
and every document of the shard is streamed through them to locate all
occurrences by the passages' own characters.

Words are runs without blanks, unchanged. Nulls and empty texts have no words.
Rows that repeat id and text count as one document. Texts of any length are
hashed in bounded pieces; long passages are cut into overlapping patterns.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import query, table
from .repeats import pieces_of, repeated_runs, span_lists, unzipped, with_runs
from .rolling import SPACES, merged, word_batches
from .storage import keyed, row_type, unpacked

RESULTS = ["n_words", "n_removed", "removed", "kept"]
SHARD_BYTES = 1 << 21  # text of one shard, and of one automaton's patterns
PATTERN_WORDS = 2048  # longer passages become overlapping patterns


def remove_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, gram: int = 8, block: int = 8) -> DataFrame:
    """The columns of ``docs`` without the text, and n_words, n_removed, removed (array of word ranges [start, end)), kept."""

    def pieces(texts):
        for i, _, hashes, _, _, at in word_batches(texts, SPACES):
            for j, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                if hi - lo >= width:
                    yield from pieces_of(hashes[lo:hi], i + j, width)

    rows = keyed(docs, id_col, text_col)
    runs = repeated_runs(rows, pieces, width, gram, block, keep_first=False)
    rows = with_runs(rows, runs).select("_row", "_zip", "spans")

    def locate(batches):
        for batch in batches:
            spans = span_lists(batch.column(2), width)
            texts = [t.decode() for t in unzipped(batch.column(1))]
            found = [x for lo, hi in _shards(texts) for x in _located(texts[lo:hi], spans[lo:hi], width)]
            out = [batch.column(0), *(pa.array([x[i] for x in found], pa.int64()) for i in (0, 1))]
            out += [pa.array([x[2] for x in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([x[3] for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=["_row", *RESULTS])

    kind = f"_row {row_type(rows)}, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept string"
    return unpacked(rows.mapInArrow(locate, kind), docs.columns, text_col, RESULTS)


def _shards(texts):
    lo = 0
    while lo < len(texts):
        hi, total = lo + 1, len(texts[lo])
        while hi < len(texts) and total + len(texts[hi]) <= SHARD_BYTES:
            total += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


#: The blanks that part words, and only these.
BLANKS = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def split_words(text: str) -> list[str]:
    return [w for w in text.translate(BLANKS).split(" ") if w]


def automata(passages, size: int = SHARD_BYTES):
    """Aho-Corasick automata over the passages, each of bounded size."""
    automaton, total = ahocorasick.Automaton(ahocorasick.STORE_INTS), 0
    for p in passages:
        if total and total + len(p) > size:
            automaton.make_automaton()
            yield automaton
            automaton, total = ahocorasick.Automaton(ahocorasick.STORE_INTS), 0
        automaton.add_word(p, len(p))
        total += len(p)
    if total:
        automaton.make_automaton()
        yield automaton


def _located(texts, spans, width):
    words = [split_words(t) for t in texts]
    passages = {}
    for own, (lo, hi) in zip(words, spans):
        for a, b in zip(lo.tolist(), hi.tolist()):
            for at in range(a, max(a + 1, b - width + 1), PATTERN_WORDS - width + 1):
                passages[" ".join(own[at : min(b, at + PATTERN_WORDS)])] = None
    joined = [" ".join(own) for own in words]
    hits: list[list[tuple[int, int]]] = [[] for _ in texts]
    for automaton in automata(passages):
        for text, own in zip(joined, hits):
            for end, length in automaton.iter(text):
                lo, hi = end + 1 - length, end + 1
                if (lo == 0 or text[lo - 1] == " ") and (hi == len(text) or text[hi] == " "):
                    own.append((lo, hi))
    for own, text, found in zip(words, joined, hits):
        if not found:
            yield len(own), 0, [], text
            continue
        lo, hi = merged(*np.array(found).T)
        starts = np.cumsum([0] + [len(w) + 1 for w in own])
        lo, hi = np.searchsorted(starts, lo).tolist(), np.searchsorted(starts, hi).tolist()
        kept = [w for a, b in zip([0, *hi], [*lo, len(own)]) for w in own[a:b]]
        yield len(own), len(own) - len(kept), [{"start": a, "end": b} for a, b in zip(lo, hi)], " ".join(kept)


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t FROM documents),
w AS (SELECT doc_id, p, array_to_string(t[p + 1 : p + 35], ' ') AS s
      FROM (SELECT doc_id, t, unnest(range(0, len(t) - 34)) AS p FROM d)),
r AS (SELECT doc_id, p, count(*) OVER (PARTITION BY s) > 1 AS again FROM w),
c AS (SELECT DISTINCT doc_id, p + k AS q FROM r, unnest(range(0, 35)) AS x(k) WHERE again),
n AS (SELECT doc_id, list(q) AS gone FROM c GROUP BY doc_id),
u AS (SELECT d.doc_id, d.t, unnest(range(0, len(d.t))) AS q FROM d),
k AS (SELECT u.doc_id, string_agg(t[u.q + 1], ' ' ORDER BY u.q) AS kept FROM u ANTI JOIN c ON u.doc_id = c.doc_id AND u.q = c.q GROUP BY u.doc_id)
SELECT d.doc_id, len(d.t) AS n_words, coalesce(len(n.gone), 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""


@query("op6_phrase_dedup", SQL)
def op6(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_recurring(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
