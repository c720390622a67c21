"""Suffix-array dedup: remove every byte that a repeated window of ``width`` bytes covers, but for its first occurrence.

Suffixes are ordered only through their first ``width`` bytes, by passes over
digits from the most significant on (``repeats``); equal groups are the repeated
windows. Earlier means a smaller id, then (equal ids) the smaller hash of the text,
then the earlier start. Windows are judged on the input and never cross texts.

Nulls and empty texts have no bytes and stay as they are; a null id sorts first.
Rows that repeat id and text count as one document and get the same result.
Texts of any length are hashed in bounded pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import query, table
from .repeats import pieces_of, repeated_runs, span_lists, unzipped, with_runs
from .rolling import BYTE_CODES
from .storage import keyed, row_type, unpacked

RESULTS = ["n_bytes", "n_removed", "removed", "kept"]


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100, gram: int = 24, block: int = 16) -> DataFrame:
    """The columns of ``docs`` without the text, and n_bytes, n_removed, removed (array of [start, end)), kept (binary).

    ``gram`` is the length of an anchor, ``block`` the windows of a block; width - gram < 127, block < width.
    """

    def pieces(texts):
        for i, text in enumerate(texts):
            if len(text) >= width:
                yield from pieces_of(_Coded(text), i, width)

    rows = keyed(docs, id_col, text_col)
    runs = repeated_runs(rows, pieces, width, gram, block, keep_first=True)
    rows = with_runs(rows, runs).select("_row", "_zip", "spans")

    def cut(batches):
        for batch in batches:
            texts = unzipped(batch.column(1))
            removed, kept, gone = [], [], []
            for text, (lo, hi) in zip(texts, span_lists(batch.column(2), width)):
                at = np.stack((np.append(0, hi), np.append(lo, len(text))), axis=1)
                kept.append(b"".join([text[a:b] for a, b in at.tolist()]))
                removed.append([{"start": a, "end": b} for a, b in zip(lo.tolist(), hi.tolist())])
                gone.append(int((hi - lo).sum()))
            out = [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int64())]
            out += [pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["_row", *RESULTS])

    kind = f"_row {row_type(rows)}, n_bytes long, n_removed long, removed array<struct<start: long, end: long>>, kept binary"
    return unpacked(rows.mapInArrow(cut, kind), docs.columns, text_col, RESULTS)


class _Coded:
    """Byte codes of a text, made for the piece that is asked for."""

    def __init__(self, text: bytes):
        self.data = np.frombuffer(text, dtype=np.uint8)

    def __len__(self):
        return len(self.data)

    def __getitem__(self, part: slice) -> np.ndarray:
        return BYTE_CODES[self.data[part]]


SQL = """
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
w AS (SELECT doc_id, p, hex(t[p + 1 : p + 100]) AS s
      FROM (SELECT doc_id, t, unnest(range(0, octet_length(t) - 99)) AS p FROM b)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1 AS again FROM w),
c AS (SELECT DISTINCT doc_id, p + k AS q FROM r, unnest(range(0, 100)) AS x(k) WHERE again),
g AS (SELECT doc_id, q, q - row_number() OVER (PARTITION BY doc_id ORDER BY q) AS run FROM c),
h AS (SELECT doc_id, run, min(q) AS a, max(q) + 1 AS e FROM g GROUP BY doc_id, run),
n AS (SELECT doc_id, sum(e - a) AS n_removed, count(*) AS n_spans FROM h GROUP BY doc_id),
k AS (SELECT doc_id, a, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM h),
j AS (SELECT k.doc_id, string_agg(hex(b.t)[2 * before + 1 : 2 * a], '' ORDER BY a) AS x, max(e) AS z FROM k JOIN b USING (doc_id) GROUP BY k.doc_id)
SELECT b.doc_id, octet_length(b.t) AS n_bytes, CAST(coalesce(n.n_removed, 0) AS BIGINT) AS n_removed, coalesce(n.n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(j.x || hex(b.t)[2 * j.z + 1 :], hex(b.t)))) AS kept_sha256
FROM b LEFT JOIN n USING (doc_id) LEFT JOIN j USING (doc_id)
"""


@query("op4_suffix_dedup", SQL)
def op4(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_substrings(docs)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
