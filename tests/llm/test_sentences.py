"""Sentence units: hand cases, coverage, and the prefix scan against the whole text."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tribuna.llm import sentences as S

CASES = [
    ("Disse o Prof. E. Nob: “Não! Assim não!”, mas assinou. “Sem x, nada anda.” “Sem y.”", ["Disse o Prof. E. Nob: “Não! Assim não!”, mas assinou.", "“Sem x, nada anda.”", "“Sem y.”"]),
    ('"Is that all?" she asked. The end!', ['"Is that all?" she asked.', "The end!"]),
    ("Faltam verba, etc. O índice subiu de 10.10 para 1.5 (v. quadro 1). Vi postos, etc. e vi.", ["Faltam verba, etc.", "O índice subiu de 10.10 para 1.5 (v. quadro 1).", "Vi postos, etc. e vi."]),
    ("O prazo.Senhor presidente, o (risos) povo. [risos] Fim 00:03:40 Agora", ["O prazo.", "Senhor presidente, o (risos) povo.", "[risos]", "Fim", "00:03:40", "Agora"]),
    ("「もう待てない。」と住民は言いました。次です。请公开……否则不行。好！", ["「もう待てない。」と住民は言いました。", "次です。", "请公开……否则不行。", "好！"]),
    ("Ποιος πληρώνει; Αυτό! 8,8 εκατ. ευρώ. В 2012 г. мы. По ул. Речной, д. 10.", ["Ποιος πληρώνει;", "Αυτό!", "8,8 εκατ. ευρώ.", "В 2012 г. мы.", "По ул. Речной, д. 10."]),
    ("डॉ. वर्णिका ने 6.6 बताया। यह है! هذا؟ نعم.", ["डॉ. वर्णिका ने 6.6 बताया।", "यह है!", "هذا؟", "نعم."]),
    ("Bom... a área. S. Exa. veio no séc. XX. Quem?", ["Bom... a área.", "S. Exa. veio no séc. XX.", "Quem?"]),
    ("Aberto “sem fim. Outra.", ["Aberto “sem fim.", "Outra."]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_cases(text, want):
    assert [text[a:b] for a, b in S.units(text)] == want


@pytest.mark.parametrize("text", [None, "", " \n\t "])
def test_nothing(text):
    assert S.units(text) == []


PIECES = st.lists(st.sampled_from(["a", "B", "é", ".", "!", "…", "...", " ", "\n", "“", "”", '"', "(", ")", "[x]", "00:01:02", "Dr.", "etc.", "「", "」", "。", "中", "9", ",", ";", "Ω", "»", "«", "(Riso.)"]), max_size=60)


@settings(max_examples=400, deadline=None)
@given(PIECES, st.booleans())
def test_all_text_in_one_unit(parts, lines):
    text = "".join(parts)
    at = 0
    for a, b in S.units(text, lines):
        assert at <= a < b and not text[at:a].strip()
        assert not text[a].isspace() and not text[b - 1].isspace()
        at = b
    assert not text[at:].strip()


@settings(max_examples=200, deadline=None)
@given(PIECES)
def test_functions_compose(parts):
    tokens = S.trimmed("".join(parts), S.lex("".join(parts)))
    k = len(tokens) // 2
    f, g = S.compose(tokens[:k]), S.compose(tokens[k:])
    assert [g[s] for s in f] == S.compose(tokens)


def long_text(seed):
    r = random.Random(seed)
    said = ["O Dr. A. B. citou o art. 4.", "“Não! Assim não!”, disse ele.", "Fim", "(Risos.)", "[00:01:02]", "Gastamos 1.500,00 reais.", "「もう。」と。", "Quem?!", "ora ahn... Campo", "\n\n"]
    return " ".join(r.choice(said) for _ in range(6000))


def in_chunks(text, size, lines):
    """Units from the chunks of a text, one after another."""
    state, last, points, total = S.B, -1, [], -1
    for _, window, left, later in S.chunks(text, size):
        tokens, shift = S.clip(window, left, lines, later), _ - left
        starts, stops, after = S.emit(tokens, state)
        assert after == S.compose(tokens)[state]
        points += [(x + shift, 1) for x in starts] + [(x + shift if x >= 0 else last, 0) for x in stops]
        last = max([last, *(t[2] + shift for t in tokens if t[0] != 4)])
        state = after
    points.sort(key=lambda x: (x[0], x[1]))
    return [(a, points[i + 1][0] if i + 1 < len(points) else last) for i, (a, s) in enumerate(points) if s]


RUNS = st.lists(st.sampled_from(["palavra ", "Fim. ", "B. Cê ", "[nota] ", "[00:01:02] ", "(Risos.) ", "“", "”", "(", ")", '"', "!?", " " * 40, "[x] " * 12, "\n", "中文。", "etc. ", "*ruído* ", "ora... "]), max_size=80)


@settings(max_examples=300, deadline=None)
@given(RUNS, st.integers(1, 90), st.booleans())
def test_chunks_of_any_size(parts, size, lines):
    text = "".join(parts)
    assert in_chunks(text, size, lines) == S.units(text, lines)


def test_a_long_quotation_is_one_sentence():
    text = "Disse: “" + "Não dá. " * 200 + "Fim”, e saiu. Outra."
    assert [text[a:b][-6:] for a, b in S.units(text)] == [" saiu.", "Outra."]


def test_scan_is_the_whole(spark):
    """Also where blanks, annotations and quotations are longer than a chunk and its context."""
    texts = {str(i): long_text(i) for i in range(3)} | {"blank": "a" + " " * 9000 + "B. C", "short": "Um. Dois.", "notes": "Foi. " + "[x] " * 2000 + "Depois. Fim", "gap": "Foi." + " " * 5000 + "depois. Fim", "quoted": "Disse “" + "Não dá. " * 900 + "fim” e saiu. Outra."}
    df = spark.createDataFrame(list(texts.items()), "id string, t string")
    for lines in (False, True):
        rows = S.sentences(df.union(df.limit(1)), "id", "t", chunk=2048, block=4, lines=lines).collect()
        got: dict = {}
        for r in rows:
            got.setdefault(r.key, []).append((r.inicio, r.fim))
        assert {k: sorted(v) for k, v in got.items()} == {k: S.units(t, lines) for k, t in texts.items()}


def test_two_texts_under_one_key(spark):
    """Both have their units, long or short."""
    for n in (1, 900):
        df = spark.createDataFrame([("k", "Um. " * n), ("k", "Outro dia. " * n), ("k", "Um. " * n)], "id string, t string")
        assert {(r.inicio, r.fim) for r in S.sentences(df, "id", "t", chunk=512).collect()} == {*S.units("Um. " * n), *S.units("Outro dia. " * n)}


def test_clashing_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, "Um. Dois.", "x", "y"), (1, "Um. Dois.", "x", "y"), (2, None, "x", "y"), (None, "Z.", "x", "y"), (3, " ", "x", "y")], "turno_id bigint, t string, key string, text string")
    assert sorted(tuple(r) for r in S.sentences(df, "turno_id", "t").collect()) == [("1", 0, 3), ("1", 4, 9)]
    assert S.sentences(df.limit(0), "turno_id", "t").collect() == []
