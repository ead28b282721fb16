"""The mix: water-filling, caps, reached shares, reports."""

from __future__ import annotations

import os
import random

import pytest

from tribuna.llm import encode, mix


def fill(weights: dict[str, float], caps: dict[str, float], total: float) -> dict[str, float]:
    """Tokens of each source: proportional to the weights, clamped at the caps, the excess shared on."""
    given: dict[str, float] = {}
    open_ = {s: w for s, w in weights.items() if w > 0}
    left = total
    while open_:
        unit = left / sum(open_.values())
        full = [s for s, w in open_.items() if w * unit >= caps[s]]
        if not full:
            given |= {s: w * unit for s, w in open_.items()}
            break
        for s in full:
            given[s] = caps[s]
            left -= caps[s]
            del open_[s]
        left = max(left, 0.0)
    return given


@pytest.mark.parametrize("seed", range(4))
def test_level(spark, seed):
    """Against clamping source by source on one machine, with limits that bind, none that do, and limits of 0."""
    r = random.Random(seed)
    sources = [(str(i), r.uniform(0.01, 1), float(r.choice((0, r.randint(1, 1000), 10**6 * (seed % 2))))) for i in range(9)]
    total = r.uniform(1, 3000)
    at = mix.level(spark.createDataFrame(sources, "fonte string, peso double, limite double"), total)
    want = fill({s: w for s, w, _ in sources}, {s: c for s, _, c in sources}, total)
    assert all(abs(min(w * at, c) - want[s]) < 1e-6 * total for s, w, c in sources)


def run(spark, docs, targets, total=None):
    sized = spark.createDataFrame(docs, "doc bigint, fonte string, tokens bigint")
    want = spark.createDataFrame(targets, "source string, peso double, maximo bigint")
    mixed, report = mix.mix(sized, want, "source", "peso", "maximo", total)
    return {r.doc: r for r in mixed.collect()}, {r.fonte: r for r in report.collect()}


def test_shares_and_report(spark):
    docs = [(i, "grande", 10) for i in range(900)] + [(1000 + i, "pequena", 10) for i in range(30)] + [(2000, "avulsa", 10), (2001, None, 10), (2002, "grande", 0)]
    mixed, report = run(spark, docs, [("grande", 0.5, 3), ("pequena", 0.5, 4), ("extinta", 0.1, 4), (None, 0.3, 1), ("avulsa", None, 2)], total=3000)
    assert report["pequena"].tokens_mistura == 1200 and report["pequena"].estado == "falta"
    assert report["grande"].tokens_mistura == 1800 and report["grande"].estado == "ok"
    assert {r.copias for r in mixed.values() if r.fonte == "pequena"} == {4}
    assert {k: report[k].estado for k in ("extinta", "avulsa", None)} == {"extinta": "sem documentos", "avulsa": "sem alvo", None: "sem alvo"}
    assert abs(sum(r.parte_real for r in report.values()) - 1) < 1e-9
    again, _ = run(spark, docs[::-1], [("grande", 0.5, 3), ("pequena", 0.5, 4)], total=3000)
    assert {d: r.copias for d, r in again.items() if r.fonte == "grande"} == {d: r.copias for d, r in mixed.items() if r.fonte == "grande"}


def test_empty_documents_stay_within_the_maximum(spark):
    docs = [(i, "a", 0) for i in range(300)] + [(1000, "a", 10)]
    mixed, _ = run(spark, docs, [("a", 1.0, 2)], total=500)
    assert {r.copias for r in mixed.values()} == {2} and len(mixed) == 301
    mixed, _ = run(spark, docs, [("a", 1.0, 2)], total=15)
    assert {r.copias for d, r in mixed.items() if d < 1000} == {1}


def test_fraction_is_near(spark):
    docs = [(i, "a", 1 + i % 7) for i in range(5000)] + [(9000 + i, "b", 50) for i in range(100)]
    _, report = run(spark, docs, [("a", 0.3, 9), ("b", 0.7, 9)])
    assert abs(report["a"].parte_real - 0.3) < 0.002 and abs(report["b"].parte_real - 0.7) < 0.002


def test_empty(spark):
    assert run(spark, [], [("a", 1.0, 1)])[1]["a"].estado == "sem documentos"
    mixed, report = run(spark, [(1, "a", 5)], [])
    assert mixed == {} and report["a"].estado == "sem alvo"


@pytest.mark.skipif(not os.path.exists(f"{encode.FOLDER}/{encode.VOCABULARY}"), reason="no vocabulary files here")
def test_sizes(spark):
    df = spark.createDataFrame([(1, "Olá mundo", "a", 7), (1, "Olá mundo", "a", 7), (2, None, None, 7)], "doc_id bigint, text string, source string, tokens int")
    got = {r.doc: r.tokens for r in mix.sizes(df, "doc_id", "text", "source").collect()}
    assert got[2] == 0 and got[1] == len(encode.Coder(f"{encode.FOLDER}/{encode.VOCABULARY}").text("Olá mundo"))
