"""Pieces: limits, overlap, exact round trip."""

from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from tribuna.llm import split
from tribuna.llm.sentences import units

TEXT = st.lists(st.sampled_from(["palavra", "Fim.", "x", " ", "\n", "; ", "中", "longuíssimapalavra", ". ", "e"]), max_size=300).map("".join)


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(20, 90), st.integers(0, 15))
def test_limits_and_round_trip(text, limit, overlap):
    cuts = split.plan(text, limit, overlap)
    assert "".join(text[n:b] for _, n, b, *_ in cuts) == text
    assert all(b - a <= limit for a, _, b, *_ in cuts)
    assert all(n - a <= overlap for a, n, *_ in cuts)
    # Exactly the sentences that no piece can hold are cut whatever the plan.
    long = {b - a for a, b in units(text, lines=True) if b - a > limit}
    assert {inside for *_, inside in cuts if inside > limit} == (long if len(text) > limit else set())


def test_least_number_of_pieces_and_natural_cuts():
    text = " ".join(f"Frase número {i} deste texto." for i in range(200))
    cuts = split.plan(text, 1000, 100)
    assert len(cuts) == 1 + -(-(len(text) - 1000) // 900)
    assert all((s, inside) == (3, 0) for *_, s, inside in cuts[1:])
    assert all(60 <= n - a <= 100 for a, n, *_ in cuts[1:])


def test_one_long_word():
    cuts = split.plan("a" * 5000, 1000, 100)
    assert cuts[1][4] == 5000 and cuts[0][2] <= 1000 and cuts[-1][2] == 5000
    # A run around the target: the blank behind it is further off, but natural.
    assert split.plan("ab " * 100 + "x" * 600 + " " + "cd " * 66, 1000, 100)[1][3] == 1


def test_table(spark):
    df = spark.createDataFrame([("a", "x" * 1500, 1), ("a", "x" * 1500, 1), ("b", "Curta.", 1), ("c", None, 1), ("d", "  ", 1), (None, "x" * 1500, 1), ("e", "Uma frase. " * 300, 1)], "id string, t string, ordem int")
    assert [r.key for r in split.unavoidable(df, "id", "t").collect()] == ["a"]
    rows = split.pieces(df, "id", "t").where("key = 'b'").collect()
    assert [(r.ordem, r.texto, r.corte) for r in rows] == [(0, "Curta.", "linha")]
    assert split.pieces(df.limit(0), "id", "t").collect() == []
