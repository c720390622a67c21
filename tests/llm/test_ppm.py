"""The trie's scores against a plain one with dictionaries, the base score against counting, odd rows, and held-out texts."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import ppm

DOCS = "doc_id long, text string, learn boolean, w long, score string, _id string"


class Trie:
    def __init__(self, order):
        self.order, self.next = order, defaultdict(Counter)

    def stream(self, text):
        return b"\n" * self.order + b" ".join(text.encode().lower().split()) + b"\n"

    def learn(self, text):
        s = self.stream(text)
        for i in range(self.order, len(s)):
            for j in range(self.order + 1):
                self.next[s[i - j : i]][s[i]] += 1

    def score(self, text):
        s, out = self.stream(text), 0.0
        for i in range(self.order, len(s)):
            gone = set()
            for j in range(self.order, -1, -1):
                counts = self.next.get(s[i - j : i])
                left = {b: n for b, n in (counts or {}).items() if b not in gone}
                if left:
                    total = 2 * sum(left.values())
                    if s[i] in left:
                        out += math.log10((2 * left[s[i]] - 1) / total)
                        break
                    out += math.log10(len(left) / total)
                    gone |= set(left)
            else:
                out -= math.log10(256 - len(gone))
        return out


def made(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abé\x00Z") for _ in range(rng.randint(1, 4))) for _ in range(40)]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), rng.random() < 0.7) for i in range(n)]


ODD = [(900, None, True), (901, "", False), (902, " \t\n\x0b ", True), (None, "never learned zzz", True), (903, "q" * 5000, None), (904, "x " * 4000, True), (904, "x " * 4000, True), (904, "Mixed CASE É", False)]


@pytest.mark.parametrize("rows", [made(60, 1) + ODD, [(i, t, False) for i, t, _ in made(5, 2)], [(1, None, True)]])
def test_same_as_a_plain_trie(spark, rows):
    trie, count = Trie(ppm.ORDER), Counter()
    for i, text, learn in rows:
        if learn and i is not None:
            trie.learn(text or "")
            count.update([*(text or "").encode().lower().split(), None])
    total, kinds = sum(count.values()), len(count)
    want = []
    for i, text, learn in rows:
        tokens = [*(text or "").encode().lower().split(), None]
        base = sum(math.log10((count[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in tokens)
        want.append((i or -1, bool(learn) and i is not None, len(tokens), sum(count[t] > 0 for t in tokens), total, round(base, 6), round(trie.score(text or ""), 6)))
    df = spark.createDataFrame([(i, t, b, 1, "s", None) for i, t, b in rows], DOCS)
    got = ppm.score_texts(df, df["learn"]).collect()
    got = [(r["doc_id"] or -1, r["learned"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want)):
        assert a == pytest.approx(b, abs=2e-6)


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert ppm.score_texts(df, df["learn"]).collect() == []


def test_pieces_are_the_text_at_once(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("ab \n\té") * rng.randint(1, 9) for _ in range(4000)).encode()
    whole = b"\n" * ppm.ORDER + b" ".join(text.lower().split()) + b"\n"
    want = ppm.windows(whole, np.array([len(whole) - ppm.ORDER]))
    for part in (1, 7, 100, 10**6):
        monkeypatch.setattr(ppm, "PART", part)
        cut = list(ppm.pieces(text))
        assert b"".join(p for _, p, _ in cut) == whole[ppm.ORDER :] and [x for _, _, x in cut].count(True) == 1
        got = ppm.windows(b"".join(c + p for c, p, _ in cut), np.array([len(p) for _, p, _ in cut]))
        assert (got == want).all()
        assert sum((p.split() for _, p, _ in cut), []) == text.lower().split()


def test_probabilities_of_the_next_byte_add_up_to_at_most_one(spark):
    """Every byte behind one context: the windows' probabilities never exceed one in all."""
    rows = [(int.from_bytes(b"abcde" + bytes([b])), c) for b, c in [(1, 5), (2, 1), (3, 0), (4, 0)]] + [(int.from_bytes(b"xbcde" + bytes([b])), 2) for b in (2, 3)]
    rows += [(int.from_bytes(b"abcde" + bytes([b])), 0) for b in range(5, 256)] + [(int.from_bytes(b"abcde\0"), 0)]
    out = ppm.byte_levels(spark.createDataFrame(rows, "w long, c long")).collect()
    total = sum(10 ** r["start"] for r in out if r["w"] >> 8 == int.from_bytes(b"abcde"))
    assert total == pytest.approx(1.0)


def test_held_out_texts_cost_less_than_unlikely_ones(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 200")
    backwards = docs.selectExpr("-1 - doc_id AS doc_id", "reverse(text) AS text")
    found = ppm.score_texts(docs.select("doc_id", "text").unionByName(backwards), F.col("doc_id") % 5 > 0).where("not learned").collect()
    score = {r["doc_id"]: r["score"] for r in found}
    held = [i for i in score if i >= 0]
    assert held and sum(score[i] > score[-1 - i] for i in held) > 0.95 * len(held)
