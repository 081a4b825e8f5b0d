import os
import random

import numpy as np
import pyarrow as pa
import pytest

from cellweave.llm import mixing, tokenizer

pytestmark = pytest.mark.skipif(not os.path.isfile(tokenizer.VOCABULARY), reason="no vocabulary")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TEXTS = ["", None, " ", "\n\n \t", "Hello  world's don't I'LL they'll we've", "a" * 3000, "x1²½ Ⅷ 漢字 🙂👩‍⚖️ ́é", "<|endoftext|>", "l'acte d'identité   n° 12,345.67 !!!???", "﻿​‮abc", "'s 's''s don''t 're", "word " * 2000]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=tokenizer.read_ranks(tokenizer.VOCABULARY), special_tokens={})


def noise(n, seed=0):
    rng = random.Random(seed)
    alphabet = "ab sS'tre vlmd 0½Ⅷ  \n\t\r.,’é  ́ß漢🙂'll"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_ids_equal_the_public_encoder(spark, reference):
    texts = TEXTS + noise(1500)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as ids")
    got = {r.doc_id: r.ids for r in tokenizer.encode(df).collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in enumerate(texts)}
    counts = {r.doc_id: r.n_tokens for r in tokenizer.count_tokens(df, ["doc_id"]).collect()}
    assert counts == {i: len(v) for i, v in got.items()}
    assert tokenizer.encode(df.limit(0)).collect() == []


def test_lexicon_changes_nothing(spark, reference, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    monkeypatch.setattr(tokenizer, "local_folder", lambda s: None)  # no mounted folder: tables are broadcast
    for most in (0, 3):
        lexicon = tokenizer.build_lexicon(df, most=most)
        assert {r.doc_id: r.ids for r in tokenizer.encode(df, lexicon=lexicon).collect()} == {i: reference.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}


def test_merging_by_hand(reference):
    ranks = tokenizer.read_ranks(tokenizer.VOCABULARY)
    for word in [w for t in noise(300, 1) + ["indistinguishable" * 30] for w in [t.encode()] if w]:
        assert tokenizer.merge_word(word, ranks) == reference._core_bpe.encode_single_piece(word)


def test_lexicon_is_minimal_and_complete():
    words = {w.encode(): [i, i + 1] for i, w in enumerate(["tap", "taps", "top", "tops", "stop", "stops", "a"])}
    lex = tokenizer.Lexicon.compile(words)
    assert len(lex.final) - 1 == 7  # prefixes and suffixes are shared
    probe = [*words, b"ta", b"tapss", b"", b"zz", b"x" * 99]
    raw = b"".join(probe)
    at = np.cumsum([0, *map(len, probe)])
    number = lex.look_up(np.frombuffer(raw, np.uint8), at[:-1], np.diff(at))
    for w, n in zip(probe, number.tolist()):
        assert (n >= 0) == (w in words)
        if n >= 0:
            assert lex.pool[lex.offset[n] : lex.offset[n + 1]].tolist() == words[w]


def test_long_texts_in_slices(reference, monkeypatch):
    monkeypatch.setattr(tokenizer, "SLICE_BYTES", 64)
    column = pa.array(TEXTS + noise(50, 2))
    encoder = tokenizer.Encoder(tokenizer.Lexicon.compile({b" the": [1]}), tokenizer.VOCABULARY)
    seen = 0
    for k, rows, raw, doc_at in tokenizer._slices(column):
        word_at, _, size, _ = encoder.words(raw, doc_at)
        total = np.concatenate(([0], np.cumsum(size)))
        for i in range(rows):
            assert total[word_at[i + 1]] - total[word_at[i]] == len(reference.encode_ordinary(column[k + i].as_py() or ""))
            seen += 1
    assert seen == len(column)


def sized(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


def test_mixture(spark):
    rng = np.random.default_rng(0)
    rows = [(i, ["Big ", "big", "small", None, "other"][i % 5], int(rng.integers(0, 50))) for i in range(1000)]
    targets = spark.createDataFrame([(" BIG", 1.0, 2), ("small\t", 3.0, 2), ("absent", 1.0, 9), ("zero", 0.0, 3), (None, 5.0, 1), ("nan", float("nan"), 1)], "source string, weight double, max_repeats int")
    df = sized(spark, rows)
    tokens = {s: sum(n for _, x, n in rows if x and x.strip().lower() == s) for s in ("big", "small")}
    plan = {r.source: r for r in mixing.mix_plan(df, targets).collect()}
    assert set(plan) == {"big", "small", "absent", "zero", "nan"}
    t = sum(tokens.values())
    assert {s for s, r in plan.items() if r.short} == {s for s, w, m in (("big", 1, 2), ("small", 3, 2), ("absent", 1, 9)) if m * tokens.get(s, 0) < w / 5 * t}
    taken = {}
    for r in mixing.mix(df, targets).collect():
        taken.setdefault(r.source, []).append(r)
    for s, r in plan.items():
        n = sum(x.copies for x in taken.get(s, []))
        assert abs(n - r.documents * r.copies) < 1.0 + 1e-6
        assert all(x.copies in (np.floor(r.copies), np.ceil(r.copies)) and x.copies <= r.max_repeats for x in taken.get(s, []))
    assert sorted(map(tuple, mixing.mix(df, targets).collect())) == sorted(map(tuple, mixing.mix(df.repartition(7), targets).collect()))
    shares = {r.source: r for r in mixing.mix_shares(df, targets).collect()}
    assert abs(sum(r.real_share for r in shares.values()) - 1) < 1e-9 and shares["zero"].tokens_taken == 0
    assert {r.short for r in mixing.mix_plan(df.limit(0), targets).collect()} == {False}
    assert mixing.mix(df, targets.limit(0)).collect() == []


def test_short_sources_come_from_the_sampling(spark, monkeypatch):
    sizes = {"a": [10] * 30, "b": [7] * 5, "c": [1, 2, 3], "zero": [0, 0], "fine": [50] * 20}
    docs = [(i, s, n) for i, (s, n) in enumerate((s, n) for s, ns in sizes.items() for n in ns)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 1.0, 2), ("b", 1.0, 3), (" C ", 0.5, 1), ("zero", 0.1, 5), ("fine", 1.0, 9), ("none", 0.2, 4), ("off", 0.0, 0)], "source string, weight double, max_repeats int")
    plan = {r.source: r.short for r in mixing.mix_plan(df, targets).collect()}
    want = {s for s, short in plan.items() if short}
    assert {"b", "c", "zero", "none"} <= want and "off" not in want and "fine" not in want
    for seed in range(4):
        assert {r.source for r in mixing.short_sources(df, targets, seed).collect()} == want
    real = mixing._crossings
    monkeypatch.setattr(mixing, "_crossings", lambda *a: real(*a).withColumn("crossed", tokenizer.F.lit(0)))
    assert {r.source for r in mixing.short_sources(df, targets).collect()} == {"zero", "none"}  # without the sampling only what cannot be sampled
    monkeypatch.undo()
    assert mixing.short_sources(df.limit(0), targets).count() == 0 and mixing.short_sources(df, targets.limit(0)).count() == 0
