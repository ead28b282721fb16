"""Turns, chunks, graph, inference, sources and streaming on small fixtures."""

from __future__ import annotations

import http.server
import itertools
import json
import random
import threading
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tribuna import schema
from tribuna.operators import flatten, graph, inference, rows, stats, topics, turns
from tribuna.plans import catalog
from tribuna.sources import chat
from tribuna.sources import hearings as sources
from tribuna.streaming import hearings as streaming

HEARING = "id string, transcricao string, metadados struct<assunto: string, envolvidos: array<struct<nome: string, cargo: string, opinioes: array<string>>>>"


def hearing(spark, *rows):
    return spark.createDataFrame(rows, HEARING)


def meta(*people):
    return ("Tema", [(n, c, o) for n, c, o in people])


def extracted(spark, text, *names):
    df = hearing(spark, ("h", text, meta(*[(n, None, None) for n in names])))
    people = flatten.participants(df)
    return [(r.orador_marcador, r.texto_turno, r.inicio_char, r.fim_char) for r in turns.extract(df, people).orderBy("ordem_turno").collect()], df, people


def test_turn_offsets(spark):
    assert extracted(spark, "Abre. O SR. JOÃO SILVA - Bom dia.", "joão silva")[0] == [("JOÃO SILVA", "Bom dia.", 6, 33)]


def test_empty_turn_ends_the_one_before(spark):
    got = extracted(spark, "O SR. JOÃO SILVA - Oi. A SRA. ANA LIMA - O SR. JOÃO SILVA - Fim.", "joão silva", "ana lima")[0]
    assert [g[1] for g in got] == ["Oi.", "Fim."]


def test_roles_and_unknown(spark):
    got = extracted(spark, "O SR. PRESIDENTE (Fulano) - Abro. O SR. VICE-PRESIDENTE (X) - Não. O SR. ZECA NUNES - Oi.", "joão silva")[0]
    assert [g[0] for g in got] == ["PRESIDENTE"]


@pytest.mark.parametrize("text", [None, "", "  \n"])
def test_blank_transcript(spark, text):
    assert extracted(spark, text, "joão silva")[0] == []


def test_attribution_to_several_and_gaps(spark):
    _, df, people = extracted(spark, "O SR. ANA MARIA LIMA - Um. O SR. PRESIDENTE - Dois. O SR. ANA MARIA LIMA - Três.", "Ana Lima", "Maria Lima", "Zé")
    rows = turns.attribute(turns.extract(df, people), people)
    assert Counter((r.nome, r.ordem_turno) for r in rows.collect()) == Counter([("Ana Lima", 0), ("Ana Lima", 2), ("Maria Lima", 0), ("Maria Lima", 2)])
    dense = turns.attribute(turns.extract(df, people), people, ordinal="speaker")
    assert sorted({r.ordem_turno for r in dense.collect()}) == [0, 1]


def test_opinions_drop_blanks_and_keep_order(spark):
    df = hearing(spark, ("h", None, meta(("ana", "Senadora (PL - SP)", ["  x ", "  ", None, "y"]))), ("e", None, None), ("f", None, ("t", None)))
    got = [(r.nome, r.op_ord, r.opiniao_limpa, r.filiacao_rede) for r in flatten.opinions(df).orderBy("op_ord").collect()]
    assert got == [("Ana", 0, "x", "PL"), ("Ana", 3, "y", "PL")]
    assert [r.opinioes for r in inference.mining_input(flatten.opinions(df)).collect()] == ["\n- x\n- y"]


def stances(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "linha_id bigint, proposicao_alvo string, nome string, postura_final string, filiacao_rede string")


def test_edges_by_hand(spark):
    df = stances(spark, [("p", "A", "A FAVOR", "X"), ("p", "A", "CONTRA", "X"), ("p", "B", "A FAVOR", "Y"), (None, "A", "A FAVOR", "X"), ("p", "C", "ERRO API", "X"), ("q", "D", "NEUTRO", None)])
    assert [tuple(r) for r in graph.edges(df).collect()] == [("A", "B", 1, 1, 0)]
    points = graph.nodes(graph.valid(df), "linha_id")
    assert {r.nome: r.group for r in points.collect()} == {"A": "X", "B": "Y", "D": None}
    assert {r.nome for r in graph.connected(points, graph.counts(df)).collect()} == {"A", "B"}


def test_last_affiliation_wins(spark):
    df = stances(spark, [("p", "A", "A FAVOR", "P1"), ("p", "A", "A FAVOR", "P2")])
    assert [(r.nome, r.group) for r in graph.nodes(df, "linha_id").collect()] == [("A", "P2")]


def test_edges_like_brute_force(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice(["p", "p", "p", "q", "r", None]), f"n{rnd.randint(0, 25)}", rnd.choice([*schema.VALID, schema.FAILED, None]), "X") for _ in range(400)]
    df = stances(spark, rows)
    want: Counter = Counter()
    for a, b in itertools.combinations([r for r in rows if r[0] and r[2] in schema.VALID], 2):
        if a[0] == b[0] and a[1] != b[1]:
            kind = 2 if "NEUTRO" in (a[2], b[2]) else 0 if a[2] == b[2] else 1
            want[(*sorted((a[1], b[1])), kind)] += 1
    for linked in (graph.edges(df), graph.edges_pairwise(df, "linha_id")):
        got = Counter({(r.src, r.dst, k): r[2 + k] for r in linked.collect() for k in range(3) if r[2 + k]})
        assert got == want
    # blocks of one class each give the same
    members, profile = graph.classes(graph.counts(df))
    a, b = (sorted(map(tuple, graph.class_edges(profile, block).collect())) for block in (1, 256))
    assert a == b


def _above(df):
    """The plan above what is dealt to blocks: (first operator, whether pairs are moved or joined there)."""
    above = df._jdf.queryExecution().optimizedPlan().toString().partition("Generate")[0]
    return above.count("MapInArrow"), above.count("Repartition"), "Join" in above or "Aggregate" in above


def test_edges_do_not_move(spark):
    """An edge comes whole out of the task that meets its ends: nothing is joined or summed behind it."""
    assert _above(graph.edges(stances(spark, [("p", n, "A FAVOR", "X") for n in "ABC"]))) == (1, 1, False)


def test_classified_edges_do_not_move(spark):
    """Classes, colours and titles are made where the edges are, and titles without a formatter for each edge."""
    linked = graph.classify(graph.edges(stances(spark, [("p", "A", "A FAVOR", "X"), ("p", "B", "A FAVOR", "X")])))
    assert _above(linked) == (1, 1, False) and "format_string" not in linked._jdf.queryExecution().optimizedPlan().toString()
    assert [r.title for r in linked.collect()] == ["Aliados (Concordaram: 1 | Discordaram: 0 | Neutros: 0)"]


def test_edges_between_classes_do_not_move(spark):
    df = stances(spark, [("p", n, "A FAVOR", "X") for n in "ABC"] + [("p", "D", "CONTRA", "X")])
    out = graph.edges_between(*graph.classes(graph.counts(df)))
    assert _above(out) == (1, 1, False)
    assert sorted(map(tuple, out.collect())) == [("A", "A", 3, 3, 1, 0, 0), ("A", "D", 3, 1, 0, 1, 0)]


def test_classes_are_named_without_another_join(spark):
    """Profiles know the first member, and propositions are hashed before they are moved to join them."""
    df = stances(spark, [("p", n, "A FAVOR", "X") for n in "ABC"])
    plan = graph.edges_between(*graph.classes(graph.counts(df)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "xxhash64(proposicao_alvo" in plan.partition("Join")[2]


def _said(rows):
    """A batch of (classe, n, {p: (f, c, z)})."""
    ints = lambda k: pa.array([[x[k] for x in said.values()] for _, _, said in rows], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([list(r[2]) for r in rows], pa.list_(pa.int64())), *map(ints, range(3))], ["classe", "n", *"pfcz"])


@pytest.mark.parametrize("same", [False, True])
def test_edges_of_tiles_like_brute_force(monkeypatch, same):
    monkeypatch.setattr(graph, "TILE", 3)
    monkeypatch.setattr(graph, "AT_ONCE", 4)
    rnd = random.Random(3)
    some = lambda k: [(f"{rnd.random()}", rnd.randint(1, 3), {p: (rnd.randint(0, 2), rnd.randint(0, 2), rnd.randint(1, 2)) for p in rnd.sample(range(6), rnd.randint(1, 2))}) for _ in range(k)]
    held, other = some(20), some(17)
    if same:
        other = rnd.sample(held, 20)
    want, members = [], 0
    for x, y in itertools.combinations_with_replacement(held, 2) if same else itertools.product(held, other):
        a, b = sorted((x, y), key=lambda r: r[0])
        if not (shared := set(a[2]) & set(b[2])) or (a is b and a[1] == 1):
            continue
        members += a[1] * (a[1] - 1) // 2 if a is b else a[1] * b[1]
        sums = [0, 0, 0]
        for (fa, ca, za), (fb, cb, zb) in ((a[2][p], b[2][p]) for p in shared):
            sums = [u + v for u, v in zip(sums, (fa * fb + ca * cb, fa * cb + ca * fb, za * (fb + cb + zb) + (fa + ca) * zb), strict=True)]
        want.append((a[0], b[0], a[1], b[1], *sums))
    found = [graph._cell([_said(held[:7]), _said(held[7:])], same, count) for count in (False, True)]
    edges, counted = ([r for batch in (_said(other[:9]), _said(other[9:])) for out in work(batch) for r in out.to_pylist()] for work in found)
    assert sorted(tuple(r.values()) for r in edges) == sorted(want)
    assert sum(r["arestas"] for r in counted) == members


def test_edges_between_classes_stay_small_in_files(tmp_path):
    """Names and counters of an edge repeat those written shortly before it."""
    rnd = random.Random(5)
    many = lambda: _said([(f"{rnd.random()}", 1, {0: (rnd.randint(0, 2), rnd.randint(0, 2), rnd.randint(1, 2)), k: (1, 0, 0)}) for k in range(1, 1501)])
    held, other = many(), many()
    found = pa.Table.from_batches(graph._cell([held], False, False)(other))
    pq.write_table(found, tmp_path / "edges.parquet", compression="snappy")
    assert found.num_rows == 1500 * 1500 and (tmp_path / "edges.parquet").stat().st_size < 1.25 * found.num_rows


def test_edges_are_counted_where_they_are_met(spark):
    """Only sums leave the tasks, one for each number of speakers looked at."""
    df = stances(spark, [("p", n, "A FAVOR", "X") for n in "ABCD"] + [("p", "E", "CONTRA", "X"), ("q", "F", "NEUTRO", "X"), ("q", "A", "NEUTRO", "X")])
    profile = graph.classes(graph.counts(df))[1]
    assert [[r.arestas for r in graph.count_edges(profile, block).collect()] for block in (1, 256)] == [[11], [11]]
    assert graph.count_edges(profile.limit(0)).first().arestas == 0


def test_pairwise_edges_of_a_hot_proposition(spark):
    """40,000,000 row pairs, also where the order column repeats."""
    df = spark.range(9000).selectExpr("id % 7 linha_id", "'p' proposicao_alvo", "concat('n', id % 10) nome", "if(id % 3 = 0, 'NEUTRO', 'CONTRA') postura_final", "'X' filiacao_rede")
    got = graph.edges_pairwise(df, "linha_id")
    assert _above(got) == (1, 1, False)
    rows = got.collect()
    assert len(rows) == 45 and {r.concordancia + r.discordancia + r.neutro for r in rows} == {900 * 900}


def test_the_dashboard_query_tells_the_whole_graph(spark, tmp_path, monkeypatch):
    """Also where the page shows less of it."""
    monkeypatch.setattr(sources.write_dashboard, "__defaults__", (1,))
    stances(spark, [("p", n, "A FAVOR", "PT") for n in "ABC"] + [("q", n, "CONTRA", "PT") for n in "AB"]).write.parquet(str(tmp_path / "base_posturas_classificadas.parquet"))
    assert [tuple(r) for r in catalog.graph_dashboard(spark, str(tmp_path)).collect()] == [(3, 3)]


@pytest.mark.parametrize(("c", "d", "n", "kind", "value"), [(2, 1, 2, "Aliados", 2), (1, 2, 0, "Antagonistas", 2), (1, 1, 0, "Contato", 1), (2, 1, 3, "Contato", 3)])
def test_edge_classes(spark, c, d, n, kind, value):
    r = graph.classify(spark.createDataFrame([("a", "b", c, d, n)], "src string, dst string, concordancia bigint, discordancia bigint, neutro bigint")).first()
    assert r.title.startswith(kind) and r.value == value


def test_crosstab_of_nothing(spark):
    out = stats.crosstab(stances(spark, [("p", "A", None, "X")]), "filiacao_rede", "postura_final")
    assert [tuple(r) for r in out.collect()] in ([], [("TOTAL_GERAL", 0)])


def test_mining_retries_and_sentinel():
    waits, answers = [], iter(["nada", "PROP: a"])
    assert inference.ask(lambda _: next(answers), "x", (15, 30, 60), inference.has_propositions, waits.append) == "PROP: a"
    assert waits == [15]
    waits.clear()
    assert inference.ask(lambda _: "nada", "x", (15, 30, 60), inference.has_propositions, waits.append) is None
    assert waits == [15, 30, 60]


def test_stance_failure_is_flagged(spark):
    pairs = spark.createDataFrame([("h", "o1", "p"), ("h", "o1", "p"), ("h", "o2", None)], "id_audiencia string, opiniao_limpa string, proposicao_alvo string")

    def model(prompt):
        if "o2" in prompt[1]:
            raise TimeoutError
        return "contra"

    got = Counter((r.opiniao_limpa, r.postura_final) for r in inference.detect(pairs, model, waits=()).collect())
    assert got == Counter({("o1", "CONTRA"): 2, ("o2", "ERRO API"): 1})
    mined = inference.mine(spark.createDataFrame([("h", "s", "\n- x")], "id_audiencia string, assunto_audiencia string, opinioes string"), lambda _: "nada", waits=())
    assert [tuple(r) for r in mined.collect()] == [("h", schema.MINING_FAILED, True)]


def test_pair_up_keeps_blank_propositions(spark):
    ops = spark.createDataFrame([("h", "o")], "id_audiencia string, opiniao_limpa string")
    props = spark.createDataFrame([("h", " | ")], "id_audiencia string, proposicoes_audiencia string")
    assert [r.proposicao_alvo for r in inference.pair_up(ops, props).collect()] == [None]


def test_topics(spark):
    people = spark.createDataFrame([("b", "Debate da VACINA"), ("a", "debate da vacina"), ("c", None)], "id_audiencia string, assunto_audiencia string")
    assert topics.first_hearing(people, ["debate", "vacina"], ["id_audiencia"]).first().id_audiencia == "a"
    assert topics.like_any(people, "vacina|fila").count() == 2


def test_malformed_json_fails(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "a"}\n{"id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        sources.read_hearings(spark, str(tmp_path)).collect()


def test_dashboard(spark, tmp_path):
    df = stances(spark, [("p", "A</script>", "A FAVOR", "PT"), ("p", "B", "A FAVOR", "Y")])
    sources.write_dashboard(graph.nodes(df, "linha_id"), graph.classify(graph.edges(df)), str(tmp_path / "g.html"))
    page = (tmp_path / "g.html").read_text()
    assert "#CC0000" in page and "Aliados" in page and "A</script>" not in page


def test_large_dashboard(spark, tmp_path):
    """The page shows the widest edges, the rest is written whole."""
    df = stances(spark, [("p", n, "A FAVOR", "PT") for n in "ABC"] + [("q", n, "CONTRA", "PT") for n in "AB"])
    points, lines = graph.nodes(df, "linha_id"), graph.classify(graph.edges(df))
    assert sources.write_dashboard(points, lines, str(tmp_path / "g.html"), most=1) == (2, 1)
    assert spark.read.json(str(tmp_path / "g.html.data/edges")).count() == 3 and spark.read.json(str(tmp_path / "g.html.data/nodes")).count() == 3


def test_dense_ids_and_zip(spark):
    df = spark.createDataFrame([(i,) for i in (5, 3, 9, 3)], "k bigint")
    assert [(r.k, r.linha) for r in rows.dense_id(df.repartition(3), ["k"]).orderBy("linha").collect()] == [(3, 0), (3, 1), (5, 2), (9, 3)]
    assert rows.dense_id(df.limit(0), ["k"]).columns == ["k", "linha"] and rows.dense_id(df.limit(0), ["k"]).count() == 0
    other = spark.createDataFrame([("b",), ("a",)], "x string")
    assert sorted((r.linha, r.k, r.x) for r in rows.zip_rows(df, other, ["k"], ["x"]).collect()) == [(0, 3, "a"), (1, 3, "b"), (2, 5, None), (3, 9, None)]


def test_crosstab_columns_from_the_data(spark):
    df = stances(spark, [("p", "A", "OUTRA", "X"), ("p", "A", "CONTRA", "X"), ("p", "B", "CONTRA", None)])
    out = stats.crosstab(df, "filiacao_rede", "postura_final")
    assert out.columns == ["filiacao_rede", "CONTRA", "OUTRA", "TOTAL_GERAL"] and sorted(map(tuple, out.collect())) == [("TOTAL_GERAL", 1, 1, 2), ("X", 1, 1, 2)]


def test_latest_rows_by_hash(spark):
    """Turns of the latest version only, once even if it is stored twice; other hearings and nulls beside it."""
    people = [("joão silva", None, None)]
    old, new = ("O SR. JOÃO SILVA - Velho.", ("a", people)), ("O SR. JOÃO SILVA - Novo.", ("a", people))
    stored = spark.createDataFrame([("h", *old, "2020-01-01"), ("h", *new, "2021-01-01"), ("h", *new, "2021-01-01"), ("g", *old, None), ("e", None, None, None)], HEARING + ", recebido_em string").withColumn("recebido_em", F.col("recebido_em").cast("timestamp"))
    got = turns.extract_latest(stored, *turns.latest_people(stored))
    assert sorted((r.id_audiencia, r.ordem_turno, r.texto_turno) for r in got.collect()) == [("g", 0, "Velho."), ("h", 0, "Novo.")]


def test_chat_connector(monkeypatch):
    """Against a server of its own: settings, both parts of the prompt, the key from the environment."""
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.headers["Authorization"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            body = json.dumps({"choices": [{"message": {"content": "PROP: a"}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    for k, v in (("URL", f"http://127.0.0.1:{server.server_port}/v1"), ("MODEL", "m"), ("KEY", "k")):
        monkeypatch.setenv(f"TRIBUNA_CHAT_{k}", v)
    assert inference.ask(chat.from_environment(), inference.mining_prompt("s", "\n- x"), (), inference.has_propositions) == "PROP: a"
    server.shutdown()
    told, body = seen[0]
    assert told == "Bearer k" and (body["model"], body["temperature"], body["max_tokens"]) == ("m", 0.0, 500)
    assert [m["role"] for m in body["messages"]] == ["system", "user"] and "PROP: " in body["messages"][0]["content"] and body["messages"][1]["content"].endswith("- x")


def test_stream_turns(spark, tmp_path):
    df = hearing(spark, ("h", "O SR. JOÃO SILVA - Oi.", meta(("joão silva", None, ["x"]))))
    df.write.json(str(tmp_path / "in"))
    known = turns.known_names(flatten.participants(df))
    run = streaming.turns_batch(known, lambda d, n: d.write.mode("append").parquet(str(tmp_path / "out")))
    streaming.read(spark, str(tmp_path / "in")).writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    assert [r.texto_turno for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["Oi."]


def test_latest_version(spark):
    rows = spark.createDataFrame([("a", "old", "2020-01-01"), ("a", "new", "2021-01-01"), ("b", "only", None)], "id string, x string, recebido_em string").withColumn("recebido_em", F.col("recebido_em").cast("timestamp"))
    assert {r.id: r.x for r in flatten.latest(rows).collect()} == {"a": "new", "b": "only"}
