"""Very long runs of blanks, and columns named like the operators' own."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import hilbert_shards, packing
from ledgerloom.llm.storage import windows_over

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("blanks", [" ", "\n", "\t", " \n", "　"])
def test_millions_of_blanks(tokenizer, blanks):
    run = (blanks * 2_000_000)[:2_000_000]
    for text in (run, f"a{run}b", f"a {run}", f"{run}7\n{run[:70_000]}."):
        assert packing.token_ids(text, RANKS).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_column_called_prompt_is_kept(spark):
    rows = spark.createDataFrame([(1, "some text", "KEEP", "ask")], "doc_id long, text string, _prompt string, question string")
    out = packing.pack_sequences(rows, prompt_col="question").first()
    assert out["_prompt"] == "KEEP" and out["loss_tokens"] < out["doc_tokens"]
    assert packing.pack_sequences(rows).first()["_prompt"] == "KEEP"


def test_shards_keep_columns_named_like_their_own(spark):
    names = ["curve", "shard", "slot", "_h", "_part", "_n", "_rank", "_row", "_start", "_o0", "a.b"]
    rows = spark.range(200).select("id", *[F.col("id").cast("string").alias(n) for n in names])
    cells = {"id": hilbert_shards.ranged(F.col("id"), 0, 199, 4), "x": hilbert_shards.named(F.col("_h"), 4)}
    out = hilbert_shards.hilbert_shards(rows, cells, ["id"], ["id", *names], shards=4).collect()
    assert len(out) == 200 and all(str(r["id"]) == r["_h"] == r["_part"] == r["_rank"] == r["_row"] == r["a.b"] for r in out)
    assert sorted((r["shard"], r["slot"]) for r in out) == [(s, k) for s in range(4) for k in range(50)]


def test_windows_reach_over_the_whole_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(1000))
    df = spark.createDataFrame([(text,), (text[:100],), ("",), (None,)], "t string")
    long, short, empty, none = [r[0] for r in df.select(windows_over(F.col("t"), 100)).collect()]
    assert short == text[:100] and empty == "" and none is None
    parts = long.split(" ")
    assert len(parts) == 10 and all(len(p) == 10 and p in text for p in parts) and parts[0] == text[:10] and parts[-1] == text[-10:]
    assert np.all(np.diff([text.find(p[:1], 110 * k) for k, p in enumerate(parts)]) >= 0)
