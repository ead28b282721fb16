"""Subject areas: held-out accuracy on made texts with wrong labels, edge cases."""

from __future__ import annotations

import itertools
import random

import numpy as np

from tribuna.llm import subjects

TOPICS = {"saude": ["a fila de transplantes", "o leito de internação", "a vacinação infantil"], "esporte": ["o futebol feminino", "a pista de atletismo", "o torneio juvenil"], "energia": ["a usina eólica", "o painel solar", "o poço de petróleo"]}
FRAMES = ["Precisamos discutir {} junto com os demais.", "Recebemos 12 queixas sobre {}.", "Em resumo, {} exige resposta.", "Senhor presidente, {} não pode esperar."]
PLAIN = ["A ata foi aprovada.", "Passo a palavra ao próximo inscrito.", "Agradeço a presença de todos."]


def made(n, seed):
    r = random.Random(seed)
    for i in range(n):
        areas = r.sample(sorted(TOPICS), r.choice([1, 1, 1, 2, 0]))
        said = [r.choice(FRAMES).format(r.choice(TOPICS[a])) for a in areas for _ in range(4)] + r.sample(PLAIN, 2)
        r.shuffle(said)
        yield i, " ".join(said), set(areas)


def test_held_out(spark):
    train, held = list(made(400, 1)), list(made(200, 2))
    r = random.Random(3)
    noisy = [(subjects.parts(t), a if r.random() > 0.1 else {r.choice(sorted(TOPICS))}, "s", "k") for _, t, a in train if a]
    model = subjects.fit(sorted(TOPICS), noisy)
    found = model.areas_of([subjects.parts(t) for _, t, _ in held], ["s"] * len(held), ["k"] * len(held))
    right = sum(set(got) == a for got, (_, _, a) in zip(found, held))
    assert right >= 0.97 * len(held)


def test_noise_in_the_text():
    a = subjects.parts("O SR. ANA LIMA - A FILA DE TRANSPLANTES​ nÃ£o <br/> espera.")
    b = subjects.parts("a fila de transplantes não espera")
    assert set(b[0]) <= set().union(*map(set, a))
    assert subjects.parts(None) == subjects.parts(" ") == subjects.parts("[risos]") == []


def test_tables(spark):
    docs = [(i, t, "s", None, "k") for i, t, _ in made(300, 5)] + [(900, None, "s", "k", "x"), (901, " ", None, None, "x"), (902, "A ata foi aprovada.", "s", "k", "x")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, tipo string, key string")
    true = {i: a for i, _, a in made(300, 5)}
    labels = spark.createDataFrame([(i, a) for i in range(150) for a in true[i]] * 2 + [(1, None), (None, "saude"), (2, "astrologia")], "doc_id bigint, area string")
    ref = spark.createDataFrame([(a,) for a in TOPICS] + [(None,)], "area string")
    got: dict = {}
    for r in subjects.subject_areas(d, labels, ref).collect():
        got.setdefault(r.key, set()).add(r.area)
    assert sum(got.get(i, set()) == a for i, a in true.items()) >= 290
    assert not {900, 901, 902} & set(got)
    for a, b in ((d.limit(0), labels), (d, labels.limit(0))):
        assert subjects.subject_areas(a, b, ref).collect() == []


def test_beam_like_all_combinations():
    """With a beam as wide as all combinations, the decoded one is the most probable."""
    r = np.random.default_rng(4)
    m, k = 3, 4
    model = subjects.Model(["a", "b", "c"], chain=r.normal(size=(m, k + m)), calibration=np.stack([np.ones(m), r.normal(size=m)], axis=1))
    x = r.normal(size=(40, m, k))
    for got, xi in zip(model.decode(x), x):

        def logp(y, xi=xi):
            z = [model.chain[j, :k] @ xi[j] + model.calibration[j, 1] + sum(model.chain[j, k + i] * y[i] for i in range(j)) for j in range(m)]
            return sum(-np.log1p(np.exp(-v if on else v)) for v, on in zip(z, y))

        assert tuple(got) == max(itertools.product((0, 1), repeat=m), key=logp)
