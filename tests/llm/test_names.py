"""Name variants: parts, clusters, and that the join loses no link."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from tribuna.llm import names

SAME = [
    ("LEÔNIDAS DROVUPUPRO DE MACHADO", "LEÃ´NIDAS DROVUPUPRO MACHADO"), ("VEREVEPO, VALDIR", "VALDIR VEREVEPO"), ("MÁRCIA SUFUMECU A.", "MÁRCIA SUFUMECU ALMEIDA"), ("HORTÊNCIALUDIROGA", "HORTÊNCIA LUDIROGA"),
    ("HELENA TRATU GRIMO SILVA", "HELENA TRATUGRIMO SILVA"), ("L. VOTIDRULO FREITAS", "LUÍS VOTIDRULO FREITAS"), ("RÊ VOTIDRULO", "REGINA VOTIDRULO"), ("DRA. ESTELA PRIROGRETRU", "ESTELA PRIROGRETRU MENDES"),
    ("CAETANO VDOSIRI", "CAETANO VIDOSIRI"), ("ESTELA OLIVEIRA BRONIFICRU", "ESTELA BRONIFICRU OLIVEIRA"), ("FEDERAÇÃO DOS USUÁRIOS DE ÔNIBUS PRUVETRIVA", "FED. PRUVETRIVA DOS USUÁRIOS DE ÔNIBUS"),
    ("FGCP - FEDERAÇÃO GOFEVABRI", "FEDERAÇÃO GOFEVABRI DE CULTURA POPULAR (FGCP)"), ("MARIA SUFE DIMA BARBOSA", "MARIAZINHA SUFEDIMA BARBOSA"),
]
OTHER = [
    ("EUNICE BAPROBOGA", "MÁRCIA BAPROBOGA RIBEIRO"), ("NATÁLIA GOFEVABRI", "FEDERAÇÃO GOFEVABRI DE CULTURA POPULAR"), ("E. SIBREPRITRA OLIVEIRA", "BEATRIZ SIBREPRITRA"), ("MÁRCIA SUFUMECU", "MÁRCIO SUFUMECU"),
    ("VALDIR BANROLURE MONTEIRO", "VALDIR BRORABLIBE CARDOSO"), ("FUNDAÇÃO GOFEVABRI", "FEDERAÇÃO GOFEVABRI"), ("ANA PRUMICRI PINTO", "ANA PRUMICRI GOMES"),
]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    assert names.similarity(a, b) >= 0.5 and names.similarity(b, a) == names.similarity(a, b)


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other(a, b):
    assert names.similarity(a, b) == 0


def plain_edges(spelled):
    """All pairs of names by the definition: (x, y) -> cosine, for those that are near enough and do not contradict each other."""
    told = {n: names.words(n) for n in spelled}
    often = Counter(g for n in spelled for g in names.grams(told[n])), Counter(w for n in spelled for w in set(told[n]))
    rare = [{k: math.log(1 + len(spelled) / c) for k, c in o.items()} for o in often]
    v = {n: {g: k * rare[0][g] for g, k in names.grams(told[n]).items()} for n in spelled}
    norm = {n: math.sqrt(sum(x * x for x in v[n].values())) for n in spelled}
    out = {}
    for x, y in itertools.combinations(sorted(spelled), 2):
        s = sum(k * v[y].get(g, 0) for g, k in v[x].items()) / (norm[x] * norm[y])
        if s >= names.COSINE and names.compatible(*sorted((told[x], told[y])), rare[1]):
            out[x, y] = s
    return out


def joined_edges(spelled, **how):
    nodes = names.alike(spelled)[1]
    told = names.edges(nodes, **how).join(nodes.selectExpr("id a", "nome x"), "a").join(nodes.selectExpr("id b", "nome y"), "b").collect()
    return {tuple(sorted((r.x, r.y))): r.s for r in told}, [r.nome for r in nodes.select("nome").collect()]


def people(spark, *values):
    return names.spellings([spark.createDataFrame([(v, "x") for v in values], "nome string, id string").select("nome")])


def test_clusters(spark):
    given = [n for pair in SAME for n in pair]
    got = names.clusters(people(spark, *given, *given, None, " ", "presidente", "Orador não identificado"))
    pairs = {(r.nome_a, r.nome_b) for r in names.pairs(got).collect()}
    assert {tuple(sorted(p)) for p in SAME} <= pairs
    assert all(names.similarity(a, b) > 0 or any(names.similarity(a, c) and names.similarity(b, c) for c in given) for a, b in pairs)


@pytest.mark.parametrize("block", [2, names.BLOCK])
def test_the_join_loses_no_link(spark, data, block):
    """Against all pairs, also with features cut into blocks of two spellings."""
    got, nodes = joined_edges(names.spellings([spark.read.parquet(f"{data}/df_turnos.parquet").select("orador_marcador")]), block=block)
    want = plain_edges(nodes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_unlinked_pairs_do_not_move(spark):
    """What a pair of blocks finds is judged there: no join, aggregation or exchange above the vectors that are dealt to it."""
    nodes = names.alike(people(spark, *(f"{g} SILVA" for g in ("ANA", "RUI", "EVA", "IVO"))))[1]
    above = names.edges(nodes)._jdf.queryExecution().optimizedPlan().toString().partition("Generate")[0]
    assert above.startswith("MapInArrow") and above.count("Repartition") == 1 and "Join" not in above and "Aggregate" not in above


def _errors(word):
    """Every word one typing error away: swaps, letters left out, doubled and changed."""
    swaps = {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)}
    return sorted((swaps | {word[:i] + x + word[i + 1 :] for i in range(len(word)) for x in ("", "X", word[i] * 2)}) - {word})


def test_one_error_contradicts_nothing():
    for core in ("TETRIMU", "TETRIMUN", "TETRIMUNEBO"):
        for v in _errors(core):
            assert names.similarity(f"ANA {v} SILVA", f"ANA {core} SILVA"), v
    for v in _errors("LEANDRA"):
        assert names.similarity(f"{v} DROVUPUP", "LEANDRA DROVUPUP") and names.similarity(f"{v} DROVUPUP", "DROVUPUP, LEANDRA")


def test_nearest(spark):
    links = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.8), (2, 3, 0.8)], "a bigint, b bigint, s double")
    assert {(r.id, r.outro) for r in names.nearest(links, 1).collect()} == {(1, 2), (2, 1), (3, 1)}


def test_the_size_of_a_component_changes_nothing(spark):
    """Typing errors, initials and names left out around some cores that are near each other: the same clusters in rounds and in one task."""
    draw = random.Random(5)
    given, family = ("MARIA", "MARCIA", "MARIO", "M.", "ANA", "ANNA", "A.", "MARIA ANA", "LEANDRA", "LAENDRA", "LEANDRO", ""), ("SILVA", "SOUZA", "S.", "", "")
    cores = ["SILVA", "TETRIMUN", "TETRIMU", "TETIRMUN", "TETRIMUNO", "TETRIMANO", "TERTIMANO"]
    made = sorted({" ".join(f"{draw.choice(given)} {draw.choice(cores)} {draw.choice(family)}".split()) for _ in range(32)})
    spelled = people(spark, *made)
    pairs = [{(r.nome_a, r.nome_b) for r in names.pairs(names.clusters(spelled, most=most)).collect()} for most in (4, 3000)]
    assert pairs[0] == pairs[1] and pairs[0]
    five = people(spark, "ANA PRUMICRI PINTO", "ANNA PRUMICRI PINTO", "ANA PRUMICRY PINTO", "A. PRUMICRI PINTO", "ANA PRUMIC RI PINTO")
    assert names.pairs(names.clusters(five, most=2)).count() == names.pairs(names.clusters(five)).count() == 10


def test_merged_is_average_linkage():
    """Against the plain way: look at all pairs of clusters, merge the nearest, the first among equals."""
    draw = random.Random(3)
    for m in (1, 2, 5, 12, 30):
        s = np.zeros((m, m))
        for p, q in itertools.combinations(range(m), 2):
            s[p, q] = s[q, p] = names.units(draw.choice((0, 0, 0.3, 0.65, 0.81, 0.9, 0.95, 1)))
        groups = [[i] for i in range(m)]
        while len(groups) > 1:
            mean, p, q = max((s[np.ix_(groups[p], groups[q])].sum() / (len(groups[p]) * len(groups[q])), -p, -q) for p, q in itertools.combinations(range(len(groups)), 2))
            if mean < names.LINK * names.UNITS:
                break
            groups[-p] += groups.pop(-q)
        got = names.merged(s, np.ones(m))
        assert all(got[i] == min(g) for g in groups for i in g)


def test_empty(spark):
    assert names.pairs(names.clusters(people(spark))).collect() == []
    assert names.clusters(people(spark, "JOÃO SÓ")).count() == 1
