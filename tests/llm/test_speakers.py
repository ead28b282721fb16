"""Speaker turns: forms of labels, decoys, joining, the chair."""

from __future__ import annotations

from tribuna.llm import speakers

PEOPLE = ["Ana Drovupupro Lima", "Dr. Fabrício Bidranibi", None, "  ", "Zeferino Trolemugo"]


def said(text, people=PEOPLE):
    return [(text[at:].split()[0], who, what) for at, who, what in speakers.turns(text, people)]


def test_forms_and_joining():
    text = (
        "Comissão Especial - Campo Alvo, 2004.\n[00:00:17] O SR. PRESIDENTE (Fabrício Bidranibi. PLUZ - MS) - Bom dia ahn... a todos.\n(00:01) A SRA. DEPUTADA ANA DROVUPUPRO (PT - SP)- Oi. "
        "A SRA ANADROVUPUPRO LIMA-De novo.\nPres.: Obrigado.\nTROLEMUGO, ZEFERINO: Um (risos) dois.\nDep. Ana D. Lima (PT/SP): [risos]\nZeferino Trolemugo – Três. *falha no áudio*"
    )
    assert said(text) == [
        ("O", "Dr. Fabrício Bidranibi", "Bom dia a todos."),
        ("A", "Ana Drovupupro Lima", "Oi. De novo."),
        ("Pres.:", "Dr. Fabrício Bidranibi", "Obrigado."),
        ("TROLEMUGO,", "Zeferino Trolemugo", "Um dois. Três."),
    ]


def test_decoys():
    text = "A SRA. ANA DROVUPUPRO LIMA - Volto ao que perguntou Zeferino Trolemugo: quem paga? Como lembrou o Sr. Zeferino Trolemugo - e concordo -, sim. Disse o Prof. Zeferino Trolemugo: “Não!” Ela perguntou: por quê?"
    assert [w for _, w, _ in said(text)] == ["Ana Drovupupro Lima"]


def test_unknown_speakers_never_join():
    text = "O SR. ORADOR NÃO IDENTIFICADO - Um.\nParticipante da plateia: Dois.\nNão identificado – Três.\nO SR. OUTRO BLIGUFILO - Quatro.\nPRESIDENTE: Cinco."
    assert [w for _, w, _ in said(text)] == [""] * 5


def test_two_participants_stay_apart():
    people = ["Regina Baproboga", "Roberto Baproboga"]
    text = "A SRA. REGINA BAPROBOGA - Um.\nO SR. ROBERTO BAPROBOGA - Dois.\nA SRA. RÊ BAPROBOGA - Três."
    assert [w for _, w, _ in said(text, people)] == ["Regina Baproboga", "Roberto Baproboga", "Regina Baproboga"]


def test_nothing():
    assert speakers.turns(None, PEOPLE) == speakers.turns(" \n", PEOPLE) == speakers.turns("Sem rótulos.", PEOPLE) == []
    assert [w for _, w, _ in said("ANA DROVUPUPRO LIMA: Oi.", None)] == [""]


def test_table(spark):
    schema = "id string, transcricao string, metadados struct<envolvidos: array<struct<nome: string>>>, recebido_em timestamp, nome string, key string"
    row = ("h", "O SR. ZEFERINO TROLEMUGO - Oi.", ([("Zeferino Trolemugo",)],), None, "x", "y")
    df = spark.createDataFrame([row, row, ("i", None, None, None, None, None), ("j", "X", None, None, None, None), (None, "O SR. A B - c", None, None, None, None)], schema)
    for version in (None, "recebido_em"):
        assert [tuple(r) for r in speakers.speaker_turns(df, version=version).distinct().collect()] == [("h", 0, 0, "Zeferino Trolemugo", "Oi.")]
