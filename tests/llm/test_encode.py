"""Token ids against one call of two libraries, also for overlong runs and long documents."""

from __future__ import annotations

import os
import random

import pytest

from tribuna.llm import encode

PATH = f"{encode.FOLDER}/{encode.VOCABULARY}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files here")
ALPHABETS = ["ab", "aeiou", "thernsi", "  ab\n", "中文字符", "a1! ", "éã中", "the of and ", "🙂a", "ação não", "'s't", " \n\t", "=-"]


def texts(n):
    r = random.Random(1)
    return ["".join(r.choice(a) for _ in range(r.randint(1, 400))) for a in ALPHABETS for _ in range(n)]


def test_trees_are_exact():
    small, whole = encode.Coder(PATH, word=16), encode.Coder(PATH)
    for t in texts(60):
        assert small.text(t) == whole.bpe.encode_ordinary(t), t


def test_same_as_the_other_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{encode.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    some = [*texts(10), "<|endoftext|> é texto", ""]
    coder = encode.Coder(PATH)
    assert [coder.text(x) for x in some] == [e.ids for e in t.encode_batch(some, add_special_tokens=False)]


def test_overlong_run():
    coder = encode.Coder(PATH)
    run = "abracadabra" * 40_000
    ids = coder.text(run)
    assert coder.bpe.decode(ids) == run


def test_parts_are_the_text_and_cut_at_word_starts():
    coder = encode.Coder(PATH)
    for t in texts(20):
        for piece in (5, 40):
            parts = list(encode.cut_up(t, piece))
            assert "".join(p for p, _ in parts) == t
            ids, level = [], []
            for i, (p, glued) in enumerate(parts):
                if not glued and level:
                    ids, level = ids + coder.joined(level), []
                of_word = glued or i + 1 < len(parts) and parts[i + 1][1]
                level.append(coder.halves(p.encode()) if of_word else coder.text(p))
            assert ids + (coder.joined(level) if level else []) == coder.bpe.encode_ordinary(t), (t, piece)


def test_documents(spark):
    long = " ".join(texts(20))
    rows = [(1, "Olá mundo", "x"), (2, None, "x"), (3, "", "x"), (4, long, "x"), (5, "z" * 3000 + " fim", "x"), (7, "中文字符" * 700, "x"), (8, "a's " + "-" * 2000 + "'re" + "7" * 1900, "x"), (6, "  \n ", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, key string")
    got = {r.key: list(r.ids) for r in encode.encode(df, "doc_id", "text", piece=500, word=64).collect()}
    whole = encode.Coder(PATH).bpe
    assert got == {i: whole.encode_ordinary(t) if t else [] for i, t, _ in rows}
    assert encode.encode(df.limit(0), "doc_id", "text").collect() == []


def test_long_documents_at_the_default_sizes(spark):
    """Plain, without blanks, one endless word; ids that come twice, with the same text or another, short or long."""
    long = " ".join(texts(20))
    rows = [(1, long * (1 + encode.PIECE * 3 // len(long))), (2, "abracadabra" * 4000), (3, "中文字符" * 9000), (4, "x" * (encode.PIECE * 3)), (5, "oi"), (5, "oi"), (6, long * 9 + "a"), (6, long * 9 + "a"), (6, long * 9 + "b"), (5, "outro")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = encode.Coder(PATH).bpe
    want = sorted((i, whole.encode_ordinary(t)) for i, t in rows)
    assert sorted((r.key, list(r.ids)) for r in encode.encode(df, "doc_id", "text").collect()) == want
    assert sorted((r.key, r.tokens) for r in encode.encode(df, "doc_id", "text", lengths=True).collect()) == sorted((i, len(x)) for i, x in want)
