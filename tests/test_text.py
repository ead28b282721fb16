"""Column functions against hand-derived cases and plain Python."""

from __future__ import annotations

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tribuna.functions import text as T


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = [
    (T.clean_text, "  a\n\tb  ", "a b"),
    (T.clean_text, None, ""),
    (T.clean_text, "a 　b\x1c", "a b"),
    (T.title_case, "d'ávila", "D'Ávila"),
    (T.title_case, "josé-maria", "José-Maria"),
    (T.title_case, "1ª turma", "1ª Turma"),
    (T.title_case, None, None),
    (T.normalize_name, "João D'Ávila", "joao d avila"),
    (T.normalize_name, "ﬁm ½ Ⅷ", "fim 1 2 viii"),
    (T.clean_marker, "O SR. JOÃO SILVA (PT-SP)", "JOÃO SILVA"),
    (T.clean_marker, "A SRA. DEPUTADA ANA LIMA", "ANA LIMA"),
    (T.affiliation, "Deputado (PT-SP)", "PT"),
    (T.affiliation, "senador ( psdb - mg )", "PSDB"),
    (T.affiliation, "Professor", T.NO_PARTY),
    (T.affiliation, "Deputado Federal (PT-SP)", T.NO_PARTY),
    (T.affiliation, "Deputada (Presidente) (PT-SP)", "PRESIDENTE) (PT"),
    (T.affiliation, None, T.NO_PARTY),
    (T.stance, "contra, não a favor", "A FAVOR"),
    (T.stance, "Contra.", "CONTRA"),
    (T.stance, "talvez", "NEUTRO"),
    (T.prefixed_lines, "PROP: a\n PROP: b\nxx\nPROP: c", ["a", "c"]),
    (T.split_list, " | ", []),
    (T.pack, "", []),
    (T.pack, None, []),
]


@pytest.mark.parametrize(("f", "x", "want"), CASES)
def test_cases(spark, f, x, want):
    assert one(spark, f, x) == [want]


def test_pack_limit(spark):
    assert one(spark, lambda c: T.pack(c, 10), "Aa. Bb! Cc ddddddddddddddd. E. F. G.") == [["Aa. Bb!", "Cc ddddddddddddddd.", "E. F. G."]]


def test_containment(spark):
    for name, marker, want in (("Maria Silva", "MARIA DA SILVA SANTOS", True), ("Maria Silva Souza", "MARIA SILVA", False), ("Zé", "ZÉ SILVA", False)):
        df = spark.createDataFrame([(name, marker)], "n string, m string")
        got = df.select(T.contains_name(T.tokens(T.normalize_name(F.col("m"))), T.tokens(T.normalize_name(F.col("n")), 3)).alias("y")).first().y
        assert got is want


TEXTS = st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=("Cs", "Cn", "Co")), max_size=40), min_size=1, max_size=20)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXTS)
def test_clean_like_python(spark, values):
    assert one(spark, T.clean_text, *values) == [re.sub(r"\s+", " ", v).strip() for v in values]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=30), min_size=1, max_size=20))
def test_normalize_like_python(spark, values):
    def plain(v):
        folded = "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c))
        return re.sub("[^a-z0-9 ]", " ", folded.lower()).strip()

    assert one(spark, T.normalize_name, *values) == [plain(v) for v in values]
