"""The corpus operators against brute force, exact round trips and held-out accuracy, and on odd rows."""

import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import chat_windows, decontamination, hilbert_shards, language, near_dedup, packing, phrase_dedup, queries, suffix_dedup, toxicity, vector_dedup
from ledgerloom.llm.components import components
from ledgerloom.llm.rolling import PLAIN_WORDS, SPACES, merged, word_batches, words

DOCS = "doc_id long, text string, lang string, source string, _id string, _row int, score string"
WORDS = [a + b for a in "ba ke lo mi nu pa re so ti vu".split() for b in "x yn zor wel dat fim gos".split()]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def odd(spark, rows=()):
    """Nulls in every column, empty and long texts, repeated rows, and columns named like the operators' own."""
    long = prose(30_000, 9)
    fixed = [
        (1, None, None, None, "x", 1, None), (2, "", "en", None, None, None, "s"), (None, prose(60, 1), "en", "a", None, None, None), (3, " \n\t", "en", "a", None, 2, ""),
        (4, prose(60, 1), None, "b", "y", None, "t"), (4, prose(60, 1), None, "b", "y", None, "t"), (5, long, "en", "c", None, None, None), (6, "!!! ???", "fr", "c", None, None, None),
    ]
    return spark.createDataFrame(fixed + list(rows), DOCS)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in "documents embeddings benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    cursor = duck.execute(queries.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(str([r[names.index(c)] for c in columns]) for r in cursor.fetchall())
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == want


def test_words_in_pieces_are_the_words_at_once():
    text = (prose(200_000, 3) + "\x0b é ß\r\n").encode()
    _, lo, hi = words(text, SPACES)
    assert [text[a:b] for a, b in zip(lo, hi)] == text.split()
    hashes = next(iter(word_batches([b"Ab cD", b"", b"ab, CD!"], PLAIN_WORDS)))[2]
    assert hashes[0] == hashes[2] and hashes[1] == hashes[3]


def test_merged():
    lo, hi = merged(np.array([5, 0, 2, 9]), np.array([7, 2, 4, 12]))
    assert lo.tolist() == [0, 5, 9] and hi.tolist() == [4, 7, 12]


# Repeats


def brute_bytes(docs, width):
    seen, gone = set(), {}
    for i, text in sorted(docs.items()):
        own = set()
        for p in range(len(text) - width + 1):
            if text[p : p + width] in seen:
                own.update(range(p, p + width))
            seen.add(text[p : p + width])
        gone[i] = bytes(c for q, c in enumerate(text) if q not in own)
    return gone


@pytest.mark.parametrize("width, gram, block", [(100, 24, 16), (20, 6, 4)])
def test_suffix_dedup_is_exact(spark, width, gram, block):
    rng = random.Random(width)
    shared = [prose(20, 100 + i) for i in range(6)]
    docs = {}
    for i in range(60):
        parts = [prose(rng.randrange(0, 12), 1000 + i)]
        for _ in range(rng.randrange(0, 4)):
            s = rng.choice(shared)
            a = rng.randrange(0, len(s) // 2)
            parts += [s[a : a + rng.randrange(10, len(s))], prose(rng.randrange(0, 5), rng.random())]
        docs[i] = "".join(parts)
    docs[60], docs[61], docs[62] = "ab" * 150, docs[3], "é" * 120
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.dedup_substrings(df, width=width, gram=gram, block=block).collect()}
    assert got == brute_bytes({i: t.encode() for i, t in docs.items()}, width)


def test_suffix_dedup_on_odd_rows(spark):
    rows = suffix_dedup.dedup_substrings(odd(spark)).collect()
    assert len(rows) == 8 and {"_id", "_row", "score", "kept"} <= set(rows[0].asDict())
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert by_id[1][0]["n_bytes"] == 0 and by_id[2][0]["n_removed"] == 0 and by_id[None][0]["n_removed"] == 0
    # The null id comes first, so both copies of the repeated row are later.
    assert [r["n_removed"] == r["n_bytes"] > 100 for r in by_id[4]] == [True, True]
    assert bytes(by_id[5][0]["kept"]).decode() == prose(30_000, 9)
    assert suffix_dedup.dedup_substrings(odd(spark).limit(0)).count() == 0


def test_repeated_row_is_one_document(spark):
    df = spark.createDataFrame([(1, prose(80, 5)), (1, prose(80, 5))], "doc_id long, text string").repartition(2)
    assert [r["n_removed"] for r in suffix_dedup.dedup_substrings(df).collect()] == [0, 0]
    assert [r["n_removed"] for r in phrase_dedup.remove_recurring(df).collect()] == [0, 0]


def test_phrase_dedup_is_exact(spark):
    rng = random.Random(4)
    shared = [prose(50, 200 + i).split() for i in range(6)]
    docs = {}
    for i in range(60):
        own = prose(rng.randrange(0, 30), 3000 + i).split()
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(0, 25)
            own += s[a : a + rng.randrange(20, 50)] + prose(rng.randrange(0, 5), rng.random()).split()
        docs[i] = "\n ".join(own)
    docs[60] = "la " * 90
    windows = Counter(tuple(t.split()[p : p + 35]) for t in docs.values() for p in range(len(t.split()) - 34))
    want = {}
    for i, t in docs.items():
        own, gone = t.split(), set()
        for p in range(len(own) - 34):
            if windows[tuple(own[p : p + 35])] > 1:
                gone.update(range(p, p + 35))
        want[i] = " ".join(w for q, w in enumerate(own) if q not in gone)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    assert {r["doc_id"]: r["kept"] for r in phrase_dedup.remove_recurring(df).collect()} == want


def test_phrase_dedup_on_odd_rows(spark):
    rows = phrase_dedup.remove_recurring(odd(spark)).collect()
    assert len(rows) == 8
    assert {r["n_words"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert all(r["n_removed"] == 60 for r in rows if r["doc_id"] in (4, None))
    assert phrase_dedup.remove_recurring(odd(spark).limit(0)).count() == 0


# Near copies


def brute_groups(docs, threshold):
    bags = {}
    for i, t in docs.items():
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", t.lower())
        bags[i] = Counter(tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))) if w else Counter()
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(docs), 2):
        same = sum((bags[a] & bags[b]).values())
        if same and same >= threshold * sum((bags[a] | bags[b]).values()) - 1e-9:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in docs}


def test_near_dedup_finds_all_links(spark):
    rng = random.Random(8)
    docs = {}
    for i in range(150):
        base = prose(90, 500 + i % 12).split()
        for _ in range(rng.randrange(0, 6)):
            base[rng.randrange(len(base))] = rng.choice(WORDS)
        docs[i] = " ".join(base)
    docs |= {150: "one two", 151: "One, two!", 152: "la " * 400, 153: "la " * 420, 154: "la " * 200, 155: "!!"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["group_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute_groups(docs, 0.8)


def test_dart_signatures_agree_like_weighted_jaccard():
    rng = np.random.default_rng(1)
    common, left, right = (rng.integers(1, 2**63, n, dtype=np.int64).view(np.uint64) for n in (300, 60, 40))
    text = np.concatenate((np.zeros(360, np.int64), np.ones(340, np.int64)))
    # 100 of the common elements come twice in the first text.
    text = np.append(text, np.zeros(100, np.int64))
    unit = np.concatenate((common, left, common, right, common[:100]))
    sig = near_dedup.signatures(*near_dedup.units(text, unit), 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - 300 / 500) < 0.04


def test_near_dedup_on_odd_rows(spark):
    rows = near_dedup.near_duplicates(odd(spark)).collect()
    assert len(rows) == 8
    kept = {r["doc_id"]: r["kept"] for r in rows}
    assert kept == {1: True, 2: True, 3: True, None: True, 4: False, 5: True, 6: True}
    assert {r["group_id"] for r in rows if r["doc_id"] == 4} == {None}
    assert near_dedup.near_duplicates(odd(spark).limit(0)).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}


# Benchmarks


def test_edited_copies_are_found_and_clean_texts_are_not(spark):
    items = [(i, prose(40, 700 + i)) for i in range(12)]
    rng = random.Random(2)
    rows, leaked = [], set()
    for i in range(200):
        text = prose(150, 9000 + i).split()
        if i % 4 == 0:
            item = items[i % 12][1].split()
            for _ in range(i % 8):
                item[rng.randrange(len(item))] = rng.choice(WORDS)
            if i % 3 == 0:
                del item[rng.randrange(len(item))]
            text[70:70] = item
            leaked.add((i, items[i % 12][0]))
        rows.append((i, " ".join(text).upper() if i % 8 == 0 else ", ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items + [(50, None), (51, ""), (52, "two words")], "item_id long, text string")
    got = decontamination.find_leaks(docs, bench).select("doc_id", F.inline("leaks")).collect()
    assert {(r["doc_id"], r["item"]) for r in got} == leaked
    assert all(65 <= r["start"] <= 75 and r["score"] > 0.5 for r in got)


def test_alignment_is_smith_waterman():
    def plain(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        return max(map(max, h))

    rng = np.random.default_rng(0)
    windows = rng.integers(1, 5, (20, 30)).astype(np.uint64)
    item = rng.integers(1, 5, 12).astype(np.uint64)
    assert decontamination.align(windows, item)[0].tolist() == [plain(item.tolist(), w.tolist()) for w in windows]


def test_common_passages_keep_seeds(spark):
    # The item is in most documents, so none of its grams is rare.
    item = prose(30, 77)
    docs = spark.createDataFrame([(i, prose(20, i) + " " + (item if i % 4 else "")) for i in range(200)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert decontamination.find_leaks(docs, bench).where(F.size("leaks") > 0).count() == 150


def test_decontamination_on_odd_rows(spark):
    bench = spark.createDataFrame([(1, prose(60, 1))], "item_id long, text string")
    rows = decontamination.find_leaks(odd(spark), bench).collect()
    assert len(rows) == 8 and sum(bool(r["leaks"]) for r in rows) == 3
    assert [r["text"] for r in rows if r["doc_id"] == 1] == [None]
    assert decontamination.find_leaks(odd(spark).limit(0), bench).count() == 0
    assert decontamination.find_leaks(odd(spark), bench.limit(0)).where(F.size("leaks") > 0).count() == 0


# Learned models


def auc(scores, y):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(len(scores))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())


def test_toxicity_on_held_out_rows(spark):
    rude = "grubnose vilesnout mudbrain".split()
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(600):
        text, bad = prose(rng.randrange(30, 120), 4000 + i).split(), i % 3 == 0
        for _ in range(rng.randrange(3, 7) if bad else 0):
            text.insert(rng.randrange(len(text)), rng.choice(rude))
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int").where("doc_id % 5 <> 0")
    model = toxicity.train(*toxicity.sample(docs, known, "doc_id", "text", "toxic", 2000, 20_000))
    got = toxicity.score_toxicity(docs.where("doc_id % 5 = 0"), model).collect()
    y = np.array([r["doc_id"] % 3 == 0 for r in got]).astype(int)
    assert auc(np.array([r["score"] for r in got]), y) > 0.97
    assert (np.array([r["predicted"] for r in got]) == y).mean() > 0.9


def test_toxicity_query_beats_chance(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = queries.QUERIES["op2_toxicity"](spark, sf_dir)
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(r["doc_id"] for r in got.where("held_out").collect()) == held
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert auc(np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows])) > 0.65


def test_toxicity_on_odd_rows(spark):
    model = toxicity.train([prose(40, i) + (" grubnose vilesnout" if i % 2 else "") for i in range(200)], [bool(i % 2) for i in range(200)])
    rows = toxicity.score_toxicity(odd(spark), model).collect()
    assert len(rows) == 8 and all(0 <= r["score"] <= 1 for r in rows)
    none = toxicity.score_toxicity(odd(spark), toxicity.train([], [])).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.score_toxicity(odd(spark).limit(0), model).count() == 0


def test_language_on_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    got = queries.QUERIES["op5_language"](spark, sf_dir).where("held_out").join(docs, "doc_id").collect()
    assert len(got) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.98


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    sizes = [1, 0, 5, 3, 6]
    scores = rng.normal(0, 2, (sum(sizes), 3)).astype(np.float32)
    ends = np.cumsum([0] + sizes)
    got = language.viterbi(scores, ends, penalty=1.5)
    for a, b in zip(ends[:-1], ends[1:]):
        value = lambda path: sum(scores[a + i, s] for i, s in enumerate(path)) - 1.5 * sum(x != y for x, y in zip(path, path[1:]))  # noqa: B023, E731
        best = max(itertools.product(range(3), repeat=int(b - a)), key=value)
        assert abs(value(best) - value(got[a:b].tolist())) < 1e-4


def test_mixed_texts_get_spans_and_scripts_narrow():
    latin, greek, cyrillic = "the house and the garden are here with a tree", "το σπίτι και ο κήπος είναι εδώ με ένα δέντρο", "дом и сад здесь с деревом и рекой около города"
    model = language.train([latin] * 5 + [greek] * 5 + [cyrillic] * 5, ["en"] * 5 + ["el"] * 5 + ["ru"] * 5)
    text = f"{latin}. {greek}! 12"
    (lang, share, spans), und, _ = language.identify([text, "12 !!", cyrillic], model)
    assert und == ("und", 0.0, [])
    assert [s[2] for s in spans] == ["en", "el"] and text[spans[1][0] : spans[1][1]] == greek
    assert lang in ("en", "el") and 0.5 <= share < 0.6


def test_language_on_odd_rows(spark):
    model = language.train([prose(50, i) for i in range(4)] + ["дом и сад"], ["en"] * 4 + ["ru"])
    rows = {r["doc_id"]: r for r in language.identify_languages(odd(spark), model).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (1, 2, 3, 6))
    assert rows[5]["lang_pred"] == "en" and rows[1]["text"] is None
    assert {r["lang_pred"] for r in language.identify_languages(odd(spark), language.train([], [])).collect()} == {"und"}
    assert language.identify_languages(odd(spark).limit(0), model).count() == 0


# Packing


def check_packing(rows, texts, limit=2048):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids = np.array(tokenizer.encode(texts[i] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        pieces.sort(key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in pieces) == ids.tobytes()
        assert np.cumsum([0] + [r["length"] for r in pieces]).tolist() == [r["start"] for r in pieces] + [len(ids)]
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        ends = np.cumsum([0] + [r["length"] for r in pieces]).tolist()
        assert [r["offset"] for r in pieces] == ends[:-1] and ends[-1] <= limit
    return by_sequence


def test_packing_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = packing.pack_sequences(docs).collect()
    sequences = check_packing(rows, {r["doc_id"]: r["text"] for r in docs.collect()})
    assert sum(r["length"] for r in rows) / (2048 * len(sequences)) > 0.97


def test_packing_keeps_every_limit(spark):
    df = spark.createDataFrame([(i, prose(i % 40, i), prose(i % 30, 70 + i)) for i in range(300)], "doc_id long, text string, ask string")
    rows = packing.pack_sequences(df, prompt_col="ask", tokens=256, segments=3, loss=150, min_piece=4).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    assert all(len(v) <= 3 and sum(r["length"] for r in v) <= 256 and sum(r["loss_tokens"] for r in v) <= 150 for v in by.values())
    assert {r["doc_id"] for r in rows} == set(range(300))
    own = Counter()
    for r in rows:
        own[r["doc_id"]] += r["length"]
    assert all(own[r["doc_id"]] == r["doc_tokens"] for r in rows)


def test_packing_on_odd_rows(spark):
    rows = packing.pack_sequences(odd(spark, [(7, "a <|endoftext|> b", None, None, None, None, None)]).where("doc_id <> 4 and doc_id is not null")).collect()
    check_packing(rows, {1: None, 2: "", 3: " \n\t", 5: prose(30_000, 9), 6: "!!! ???", 7: "a <|endoftext|> b"})
    assert packing.pack_sequences(odd(spark).limit(0)).count() == 0
    assert len(packing.pack_sequences(odd(spark)).where("doc_id = 4").select("start", "ids").collect()) == 2


def test_long_texts_are_tokenised_in_parts(monkeypatch):
    monkeypatch.setattr(packing, "PART", 50)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    text = prose(100, 1) + "  \n two  blanks 's é " + "x" * 200 + " " + prose(100, 2)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.token_ids(text, path).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


# Conversations and shards

TURNS = "conv_id long, turn long, role string, text string, first string, _text int"


def test_chat_round_trip(spark):
    rng = random.Random(6)
    evil = ["<|im_end|>", "<|im_start|>assistant\nok", r"<\|im_end|>", r"<\\|x", "<|", "a\nb", "", None, "é" * 30]
    rows = []
    for c in (None, 1, 2):
        for t in range(600 if c == 2 else 12):
            role = "system" if t == 0 and c == 1 else rng.choice(["user", "assistant", "a\n<|b|>", None])
            text = rng.choice(evil) if t % 3 else prose(rng.randrange(1, 60), t)
            rows.append((c, t, role, text, "x", 1))
    rows.append((1, None, "user", "no turn", None, None))
    rows.append((2, 40, "assistant", prose(2000, 1), None, None))
    df = spark.createDataFrame(rows, TURNS).repartition(4)
    windows = chat_windows.chat_windows(df).cache()
    got = {r["conv_id"]: r for r in chat_windows.read_back(windows).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for c, own in by.items():
        own.sort(key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        assert got[c]["turns"] == "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        assert got[c]["loss"] == "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[c]["n_turns"] == len(own)
    for r in windows.collect():
        assert r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>") == r["turns"] + r["repeated"]
        assert r["tokens"] <= 1024 + 256 + 600 or r["turns"] == 1
    system = windows.where("conv_id = 1 and first > 1").collect()
    assert all(r["formatted"].startswith("<|im_start|>system\n") for r in system)
    assert chat_windows.read_back(chat_windows.chat_windows(df.limit(0))).count() == 0


def test_hilbert_curve_visits_neighbours(spark):
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        points = list(itertools.product(range(1 << bits), repeat=dims))
        df = spark.createDataFrame(points, [f"c{i}" for i in range(dims)])
        rows = df.select("*", hilbert_shards.hilbert_index([F.col(c) for c in df.columns], bits).alias("h")).orderBy("h").collect()
        assert [r["h"] for r in rows] == list(range(len(points)))
        assert all(sum(abs(a - b) for a, b in zip(x[:-1], y[:-1])) == 1 for x, y in zip(rows, rows[1:]))


def test_shards_are_even_and_gapless(spark, sf_dir):
    rows = queries.QUERIES["op8_hilbert_shards"](spark, sf_dir).collect()
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all((r["size"], r["text_crc32"]) == (len(docs[r["doc_id"]]) + 1, zlib.crc32(docs[r["doc_id"]])) for r in rows)
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == len(docs) and set(slots) == set(range(8))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shards_on_odd_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(hilbert_shards, "PART_ROWS", 16)
    df = odd(spark, [(7, "same", "en", "z", None, None, None)] * 500 + [(8 + i, prose(i % 9, i), "en", f"s{i % 3}", None, None, None) for i in range(200)])
    cells = hilbert_shards.document_cells(df, "doc_id", "text", ["source", "lang"])
    rows = hilbert_shards.hilbert_shards(df, cells, ["text", "doc_id"], ["doc_id", "text"], shards=7).collect()
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == 708 and max(counts.values()) - min(counts.values()) <= 1
    assert sorted((r["shard"], r["slot"]) for r in rows) == sorted((s, i) for s, n in counts.items() for i in range(n))
    empty = df.limit(0)
    assert hilbert_shards.hilbert_shards(empty, hilbert_shards.document_cells(empty, "doc_id", "text", ["lang"]), ["doc_id"], ["doc_id"], shards=3).count() == 0
    few = df.where("doc_id between 8 and 30")
    placed = hilbert_shards.hilbert_shards(few, hilbert_shards.document_cells(few, "doc_id", "text", ["lang"]), ["doc_id"], ["doc_id"], shards=2)
    hilbert_shards.write_shards(few, placed, "doc_id", str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).groupBy("shard").count().count() == 2


# Vectors


@pytest.mark.parametrize("leaf", [512, 32])
def test_vector_links_are_exact(spark, leaf):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (40, 24))
    x = (centres[rng.integers(0, 40, 500)] + rng.normal(0, 0.11, (500, 24))).astype(np.float32)
    x[100:130] = x[100]
    label = rng.integers(0, 2, 500)
    rows = [(i, x[i].tolist(), int(label[i])) for i in range(500)]
    rows += [(500, None, 0), (501, [0.0] * 24, 0), (502, [float("nan")] + [1.0] * 23, 0), (503, x[100].tolist(), None), (504, [], 0), (505, [None] + [1.0] * 23, 1), (506, [1.0, 0.5], 0), (507, [1.0, 0.5], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r["vec_id"]: r for r in vector_dedup.near_vectors(df, leaf=leaf, trees=12).collect()}
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    linked = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    n = linked.sum(axis=1) - 1
    found = np.array([got[i]["n_links"] for i in range(500)])
    assert (found <= n).all() and found.sum() >= (1.0 if leaf == 512 else 0.97) * n.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in (*range(500, 506),))
    assert (got[507]["n_links"], got[507]["component_id"], got[507]["kept"]) == (1, 506, False)
    if leaf == 512:
        root = np.arange(500)
        for _ in range(500):
            new = np.array([root[linked[i]].min() for i in range(500)])
            if (new == root).all():
                break
            root = new
        assert [got[i]["component_id"] for i in range(500)] == root.tolist()
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0


def test_large_leaves_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    rng = np.random.default_rng(4)
    x = (rng.normal(0, 1, 16) + rng.normal(0, 0.02, (100, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, x[i].tolist(), 1) for i in range(100)], "vec_id long, embedding array<float>, label int")
    got = vector_dedup.near_vectors(df, leaf=200).collect()
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate(want.tolist()))
    assert {r["component_id"] for r in got} == {0}


# Pipeline


def test_pipeline_stages(spark, tmp_path):
    item = prose(40, 42)
    passage = prose(60, 43)
    own = [(i, prose(80, 6000 + i), "en", "s", 1) for i in range(20)]
    rows = own + [
        (30, None, "en", "s", 0), (31, "123 !!", "en", "s", 7), (32, own[0][1], "en", "s", 1), (33, own[1][1] + " more", None, "s", 1),
        (34, prose(50, 1) + " " + passage, "en", "s", 1), (35, prose(50, 2) + " " + passage, "en", "s", 1), (36, prose(50, 3) + " " + item, "en", "s", 1),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        kept.append({r["doc_id"]: r for r in docs.collect()})
    clean = set(range(20))
    assert set(kept[0]) == clean | {32, 33, 34, 35, 36}
    assert set(kept[1]) == clean | {34, 35, 36}
    assert kept[2][34]["text"] == prose(50, 1) and kept[2][34]["n_chars"] == len(prose(50, 1)) and kept[2][0]["text"] == own[0][1]
    assert set(kept[3]) == clean | {34, 35}
    assert set(kept[4]) == clean | {34, 35}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
