"""Nested records: shapes, places, malformed lines, depth, empties."""

from __future__ import annotations

import json

from tribuna.operators import nested


def flat(spark, *lines):
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(lines)], "raw_id bigint, linha string, chave string")
    return nested.flatten_json(df, "raw_id", "linha")


def paths(spark, *lines):
    return sorted((r.chave, r.caminho) for r in nested.spoken_paths(flat(spark, *lines), "bruta").collect())


def record(people):
    return {"id": 1, "metadados": {"assunto": "a", "envolvidos": people}}


def test_shapes_and_places(spark):
    reply = {"nome": "r", "texto": "sim", "replicas": [{"texto": "não", "replicas": "fim"}, "  "]}
    people = [None, {"nome": "a", "opinioes": ["x", None, {"texto": None, "replicas": [reply]}, {"conteudo": "y"}, {"trecho": {"inicio": 1}}]}, {"nome": "b", "opinioes": "só uma"}]
    want = [("1.0"), ("1.2.0"), ("1.2.0.0"), ("1.2.0.0.0"), ("1.3"), ("2.0")]
    plain = json.dumps(record(people))
    wrapped = json.dumps({"audiencia": record(people), "versao": 2})
    inner = record(people)
    inner["metadados"] = json.dumps(inner["metadados"])
    single = json.dumps(record({"nome": "c", "opinioes": {"texto": "z"}}))
    assert paths(spark, plain, wrapped, json.dumps(inner), single) == sorted([(str(i), p) for i in range(3) for p in want] + [("3", "0.0")])


def test_unreadable(spark):
    assert paths(spark, None, "", "{", "[]", "3", '"x"', '{"metadados": null}', '{"metadados": {"envolvidos": [1, "nome só", []]}}') == []


def test_parents(spark):
    rows = flat(spark, json.dumps(record([{"nome": "a", "opinioes": [{"texto": "x", "replicas": ["y"]}]}]))).collect()
    by = {r.caminho: r for r in rows}
    assert by["0.0.0"].pai == "0.0" and by["0.0"].pai == "0" and by["0"].pai == "" and by[""].pai is None
    assert by["0.0"].variante == "fala(replicas:lista,texto:texto)" and by["0.0.0"].tabela == "replica"


def test_states_route(spark):
    """Table, subtype and typed columns follow from the state."""
    people = [{"nome": "a", "filiacao": {"partido": "P", "uf": "SP", "historico": [{"partido": "Q", "ano": 2001}, "x"]}, "opinioes": [{"texto": "t", "trecho": {"inicio": 1, "fim": 5}}, "solta", {"conteudo": "c"}, 7]}, "nome só", {"nome": "b"}]
    meta = {"assunto": "s", "envolvidos": people, "origem": {"comissao": {"sigla": "CE", "membros": ["m"]}}}
    f = flat(spark, json.dumps({"id": 3, "metadados": meta}))
    assert {(r.tabela, r.subtipo, r.caminho) for r in f.collect()} == {
        ("audiencia", "proveniente", ""), ("participante", "filiada", "0"), ("participante", "nome_solto", "1"), ("participante", "nomeado", "2"),
        ("opiniao", "recorte", "0.0"), ("opiniao", "texto_solto", "0.1"), ("opiniao", "fala", "0.2"), ("vinculo", "vinculo", "0/0"),
    }
    assert tuple(nested.subtype(f, "opiniao", "recorte").first()) == ("0", "0.0", "0", 0, "t", 1, 5)
    assert tuple(nested.subtype(f, "vinculo", "vinculo").first()) == ("0", "0/0", "0", 0, "Q", 2001)
    assert tuple(nested.subtype(f, "participante", "filiada").first()) == ("0", "0", "", 0, "a", None, "P", "SP")
    assert tuple(nested.subtype(f, "audiencia", "proveniente").first()) == ("0", "", None, 0, "3", "s", "CE")


def test_typed_states(spark):
    df = spark.createDataFrame([("h", ("a", [("n", None, ["x", None])])), ("e", None)], "id string, m struct<assunto: string, envolvidos: array<struct<nome: string, cargo: string, opinioes: array<string>>>>")
    got = {(r.tabela, r.subtipo, r.variante, r.caminho) for r in nested.flatten_typed(df, "id", "m").collect()}
    raw = {(r.tabela, r.subtipo, r.variante, r.caminho) for r in flat(spark, json.dumps({"metadados": {"assunto": "a", "envolvidos": [{"nome": "n", "cargo": None, "opinioes": ["x", None]}]}}), json.dumps({"metadados": None})).collect()}
    assert got == raw and ("participante", "pessoa", "pessoa(cargo:nulo,nome:texto,opinioes:lista)", "0") in got


def test_depth(spark):
    x = {"texto": "fundo"}
    for _ in range(150):
        x = {"texto": None, "replicas": [x]}
    assert paths(spark, json.dumps(record([{"opinioes": [x]}]))) == [("0", "0." + ".".join(["0"] * 151))]


def test_typed(spark):
    df = spark.createDataFrame([("h", ("a", [("n", "c", ["x", None, " "]), None, ("m", None, None)]), 1), ("h", ("a", [("n", "c", ["x", None, " "]), None, ("m", None, None)]), 2), ("e", None, 3)], "id string, m struct<assunto: string, envolvidos: array<struct<nome: string, cargo: string, opinioes: array<string>>>>, caminho int")
    t = nested.flatten_typed(df, "id", "m")
    assert [tuple(r) for r in nested.spoken_paths(t, "tipada").collect()] == [("tipada", "h", "0.0")]
    assert sorted(r.caminho for r in nested.tables(t)["participantes"].distinct().collect()) == ["0", "2"]


def test_empty(spark):
    assert paths(spark) == []
