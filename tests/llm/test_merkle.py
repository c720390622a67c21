"""The manifest against a plain tree, also on odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars int, text string, tree string, place long, item string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def shown(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def way(built, place):
    """(sibling or None, whether it stands left) of each level."""
    for level in built[:-1]:
        other = place ^ 1
        yield (level[other] if other < len(level) else None), other < place
        place >>= 1


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        leaf = h(*map(shown, r[:5]))
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
        claimed = h(*map(shown, [*r[:3], r[3] + 1, r[4]])) if changed else leaf
        groups[r[2]].append(((r[0] is not None, r[0] or 0), leaf, claimed, r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[1] for x in sorted(groups[g], key=lambda x: x[:2])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for place, (_, leaf, claimed, doc_id) in enumerate(sorted(groups[g], key=lambda x: x[:2])):
            proof, folded = "", claimed
            for sibling, left in [*way(trees[g], place), *way(top, at)]:
                proof += sibling or ""
                folded = h(sibling or "", folded) if left else h(folded, sibling or "")
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], h(proof), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def made(n, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(["en", "en", "en", "de", None, "", "/", "é"]), rng.choice([i, None]), f"text {i} ä" * rng.randint(0, 3)) for i in range(n)]
    # Repeated rows, equal and null ids, nulls everywhere.
    rows += [rows[0], rows[0], (1, "z", "en", 5, "other"), (None, None, None, None, None), (None, "a", "en", 2**31 - 1, "x"), (7, "", "", 0, "")]
    return [(*r, "t", 1, None) for r in rows]


@pytest.mark.parametrize("n, stride", [(1, 6), (70, 6), (150, 1), (150, 2)])
def test_same_as_a_plain_tree(spark, tmp_path, monkeypatch, n, stride):
    rows = made(n, n + stride)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(merkle, "merkle_manifest", lambda *a, f=merkle.merkle_manifest: f(*a, stride=stride))
    got = [tuple(r) for r in merkle.op13(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == brute(rows)
    assert {r[-1] for r in got} == {True, False} or n == 1


def test_one_row_is_its_own_root(spark, tmp_path):
    spark.createDataFrame([(1, None, None, 4, "abcd", None, None, None)], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    row = merkle.op13(spark, str(tmp_path)).first()
    assert row["leaf"] == row["subroot"] == row["root"] == h("1:1", "-", "-", "1:4", "4:abcd") and row["proof_sha256"] == h("")


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert merkle.op13(spark, str(tmp_path)).collect() == []


def test_a_forged_sibling_shows(spark, tmp_path):
    rows = spark.createDataFrame([(i, "g") for i in range(100)], "id long, g string")
    made = merkle.merkle_manifest(rows, merkle.leaf_hash([F.col("id")]), "id", "g", F.col("id"), stride=3)
    forged = made.nodes.withColumn("siblings", F.transform("siblings", lambda s: F.unhex(F.sha2(s, 256))))

    def verified(m):
        return merkle.climbed(m, F.col("hash"), ["folded"]).where(merkle.digits(F.col("folded")) == made.root).count()

    assert (verified(made), verified(merkle.Manifest(made.leaves, forged, made.root, made.steps))) == (100, 0)
