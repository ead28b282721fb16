"""Canonical values: the metric, the tree against a plain scan, readings, shards."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tribuna.llm import canon

WORD = st.text("abc", max_size=7)


@settings(max_examples=300, deadline=None)
@given(WORD, WORD, WORD)
def test_metric(a, b, c):
    d = canon.distance
    assert d(a, b) == d(b, a) and (d(a, b) == 0) == (a == b)
    assert d(a, c) <= d(a, b) + d(b, c)


def test_tree_like_a_scan():
    r = random.Random(3)
    forms = ["".join(r.choice("abcde") for _ in range(r.randint(3, 9))) for _ in range(300)]
    tree = canon.Tree((f, i) for i, f in enumerate(forms))
    for _ in range(60):
        v = "".join(r.choice("abcde") for _ in range(r.randint(3, 9)))
        for radius in (0, 1, 2):
            got = {(d, f) for d, f, _ in tree.within(v, radius)}
            assert got == {(canon.distance(v, f), f) for f in forms if canon.distance(v, f) <= radius}


OFFICES = [(1, "Deputado(a)", None), (2, "Senador(a)", None), (3, "Vereador(a)", None), (6, "Secretário(a) Estadual", None), (9, "Advogado(a)", None), (15, "Engenheiro(a) Civil", None), (18, "Presidente de Associação", None), (21, "Agricultor(a) Familiar", None)]
PARTIES = [(101, "PCAM", "Partido Campestre"), (109, "ALVO", "Aliança Voz Operária"), (112, "PONTE", "Partido da Ponte Larga"), (121, "SOCIEDADE/OUTROS", "Sociedade civil e outros")]
TYPED = [
    ("Deputada (UNALV-SE)", 1), ("parlamentar (deputado) PQUI RR", 1), ("Dep. Federal - VIRAC/MS", 1), ("senador da república/suplente - PCAM/SE", 2), ("edil de Serra Lenta", 3), ("Veraedor", 3), ("SecretÃ¡ria Estadual", 6),
    ("secretário de estado", 6), ("Advogada trabalhsta substituto", 9), ("causídico/titular", 9), ("Pres. da Asso.c", 18), ("  Presidenta  de  associação ", 18), ("apicultora amadora", -1), ("bombeiro civil , 2º mandato", -1), ("ver lista.", -1), ("avó", -1), ("xxx?", -1),
]
AFFILIATED = [("P CAM", 101), ("P.C.A.M.", 101), ("PCAM - MT", 101), ("Part. Campestre", 101), ("PARTIDO CAMPETSRE", 101), ("Bloco ALVO", 109), ("AlianÃ§a Voz OperÃ¡ria", 109), ("ponte", 112), ("da Ponte Larga", 112), ("Partido da Ponte Larga (PONTE)", 112), ("Soc./Outros", 121), ("SOCIEDDE/OUTROS", 121), ("PGHT", -1), ("-", -1), ("--RR", -1), ("FRENTE MISTA DA PESCA-PB", -1)]


def chosen(entries, forms, readings):
    hit = canon.first_hit(canon.Tree((f, i) for i, label, long in entries for f in forms(label, long)), readings)
    return hit[3][0] if hit and len(hit[3]) == 1 else -1


@pytest.mark.parametrize(("value", "want"), TYPED)
def test_offices(value, want):
    assert chosen(OFFICES, canon.office_forms, canon.office_readings(value)) == want


@pytest.mark.parametrize(("value", "want"), AFFILIATED)
def test_parties(value, want):
    assert chosen(PARTIES, canon.party_forms, canon.party_readings(value)) == want


def test_shards_agree(spark):
    forms = canon.expand(spark.createDataFrame(OFFICES, "ref_id bigint, rotulo string, descricao string"), canon.office_forms)
    df = spark.createDataFrame([(v,) for v, _ in TYPED] + [(None,), (" ",), (TYPED[0][0],)], "valor string")
    one, many = ({r.valor: r.ref_id for r in canon.match(df, "valor", forms, canon.office_readings, shard).collect()} for shard in (100_000, 400))
    assert one == many == dict(TYPED)
    assert {r.ref_id for r in canon.match(df, "valor", forms.limit(0), canon.office_readings).collect()} == {-1}
    assert canon.match(df.limit(0), "valor", forms, canon.office_readings).collect() == []


def test_shards_agree_on_ties(spark):
    """Random short forms with many ties: any number of shards and buckets gives what one tree gives; a tie is -1."""
    r = random.Random(9)
    forms = sorted({("".join(r.choice("ab") for _ in range(r.randint(6, 8))), r.randint(1, 40)) for _ in range(70)})
    values = sorted({"".join(r.choice("abc") for _ in range(r.randint(5, 9))) for _ in range(60)})
    readings = lambda v: (v, v[1:], v[:-1])
    tree = canon.Tree(forms)
    want = {v: (h[3][0] if (h := canon.first_hit(tree, readings(v))) and len(h[3]) == 1 else -1) for v in values}
    assert -1 in want.values() and len(set(want.values())) > 3
    table, df = spark.createDataFrame(forms, "forma string, ref_id bigint"), spark.createDataFrame([(v,) for v in values], "valor string")
    for shard, bucket in ((1000, 1000), (9, 7), (2, 1000)):
        assert {x.valor: x.ref_id for x in canon.match(df, "valor", table, readings, shard, bucket).collect()} == want
