"""Deeply nested hearing records as flat, linked tables.

Two sources carry the same tree (hearing > participant > opinion > reply > ...):

* a typed column (``struct``/``array``), flattened in the JVM with ``posexplode``;
* free-form JSON lines, where every level may be an object, a list, a single
  element in place of a list, a bare string, or an object that was serialised
  once more into a string.

For the JSON lines a bottom-up tree automaton gives every node a *state* (its
structural variant) from its labels and the states of its children. Which table a
node goes to, and as which subtype, is a transition on the table of its parent, the
label it hangs on and its state (``ROUTES``); a state without a transition there
has no row. Each row keeps the supertype key (``chave``, ``caminho``) and the link
to its parent (``pai``), and a subtype's table has the columns of that subtype
(``SUBTYPES``). The typed column passes the same transitions. Positions count over
all elements as stored, so they survive null and blank siblings.

Defined results: a null or unparsable line gives no rows; nulls, scalars of the
wrong type and empty objects count for positions but yield a row only at the
levels that exist (a null participant has no row, a null opinion has none
either); repeated rows give repeated output unless the caller makes it distinct;
columns of the input other than the key and the payload are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "chave string, tabela string, variante string, caminho string, pai string, posicao bigint, nivel int, nome string, cargo string, partido string, uf string, texto string, subtipo string, ano bigint, inicio bigint, fim bigint, sigla string"

#: Keys that hold the text of an opinion or reply, in order of preference.
TEXT_KEYS = ("texto", "conteudo")


def not_blank(c: Column) -> Column:
    """Whether a text holds anything but white space (null: false)."""
    return F.coalesce(c.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


# -- the automaton --------------------------------------------------------------------


def leaf(x: object) -> str:
    """State of a leaf."""
    if x is None:
        return "nulo"
    return "logico" if isinstance(x, bool) else "numero" if isinstance(x, (int, float)) else "texto"


def step(children: dict[str, str]) -> str:
    """Transition for an object: its kind from the labels of its children and, where these have variants, their states."""
    has, kind_of = children.keys(), lambda k: children.get(k, "").partition("(")[0]
    kind = (
        ("proveniente" if kind_of("origem") == "origem" else "metadados") if has & {"envolvidos", "assunto"}
        else ("filiada" if kind_of("filiacao") == "filiacao" else "pessoa") if has & {"opinioes", "cargo", "filiacao"}
        else ("recorte" if kind_of("trecho") == "trecho" else "fala") if has & {"texto", "conteudo", "replicas", "trecho"}
        else "vinculo" if "ano" in has
        else "filiacao" if has & {"partido", "uf", "historico"}
        else "trecho" if has & {"inicio", "fim"}
        else "origem" if "comissao" in has
        else "nomeado" if "nome" in has
        else "objeto"
    )
    return f"{kind}({','.join(f'{k}:{s.partition('(')[0]}' for k, s in sorted(children.items()))})"


def _to(table: str, *kinds: str, **named: str) -> dict[str, tuple[str, str]]:
    return {k: (table, k) for k in kinds} | {k: (table, v) for k, v in named.items()}


#: (table of the parent, label) -> state -> (table, subtype).
ROUTES = {
    ("", "metadados"): _to("audiencia", "metadados", "proveniente", "objeto"),
    ("audiencia", "envolvidos"): _to("participante", "pessoa", "filiada", "nomeado", "fala", "recorte", "objeto", "vinculo", "filiacao", "trecho", "origem", texto="nome_solto", metadados="objeto", proveniente="objeto"),
    ("participante", "opinioes"): _to("opiniao", "fala", "recorte", "nomeado", "objeto", "pessoa", "filiada", "vinculo", "filiacao", "trecho", "origem", texto="texto_solto", metadados="objeto", proveniente="objeto"),
    ("opiniao", "replicas"): _to("replica", "fala", "recorte", "nomeado", "objeto", "pessoa", "filiada", "vinculo", "filiacao", "trecho", "origem", texto="texto_solto", metadados="objeto", proveniente="objeto"),
    ("participante", "historico"): _to("vinculo", "vinculo"),
}
ROUTES["replica", "replicas"] = ROUTES["opiniao", "replicas"]
#: Columns of each subtype besides ``chave``, ``caminho``, ``pai`` and ``posicao``; a subtype not named here has those of its table.
SUBTYPES = {
    ("audiencia", None): ("nome", "texto"), ("audiencia", "proveniente"): ("nome", "texto", "sigla"),
    ("participante", None): ("nome", "cargo"), ("participante", "filiada"): ("nome", "cargo", "partido", "uf"), ("participante", "nome_solto"): ("nome",),
    ("opiniao", None): ("texto",), ("opiniao", "recorte"): ("texto", "inicio", "fim"),
    ("replica", None): ("nivel", "nome", "texto"), ("replica", "texto_solto"): ("nivel", "texto"),
    ("vinculo", None): ("partido", "ano"),
}


def states(node: object) -> dict[int, str]:
    """States of all objects and lists below ``node`` by identity, bottom-up over an explicit stack (any depth)."""
    done: dict[int, str] = {}
    of = lambda x: done.get(id(x)) or leaf(x)
    stack = [(node, False)]
    while stack:
        x, seen = stack.pop()
        if not isinstance(x, (dict, list)):
            continue
        if not seen:
            stack.append((x, True))
            stack.extend((v, False) for v in (x.values() if isinstance(x, dict) else x))
        else:
            done[id(x)] = step({k: of(v) for k, v in x.items()}) if isinstance(x, dict) else "lista(" + "|".join(sorted({of(v).partition("(")[0] for v in x})) + ")"
    return done


def elements(x: object) -> list:
    """A list as it is; a single element in place of a list at position 0; nothing for null."""
    return [] if x is None else x if isinstance(x, list) else [x]


def unfold(x: object) -> object:
    """An object that was serialised into a string once more."""
    for _ in range(3):
        if not (isinstance(x, str) and x.lstrip()[:1] in ("{", "[")):
            break
        try:
            x = json.loads(x)
        except ValueError:
            break
    return x


def _text(node: object) -> str | None:
    if isinstance(node, str):
        return node
    if isinstance(node, dict):
        for k in TEXT_KEYS:
            if isinstance(node.get(k), str):
                return node[k]
    return None


def _whole(x: object) -> int | None:
    return x if isinstance(x, int) and not isinstance(x, bool) and abs(x) < 2**63 else None


def _string(x: object) -> str | None:
    return x if isinstance(x, str) else None if x is None or isinstance(x, (dict, list)) else json.dumps(x)


def records(key: str, line: str) -> Iterator[tuple]:
    """Rows of one JSON line, parents before children."""
    try:
        root = unfold(json.loads(line))
    except (ValueError, RecursionError):
        return
    while isinstance(root, dict) and "metadados" not in root and isinstance(unfold(root.get("audiencia")), dict):
        root = unfold(root["audiencia"])
    if not isinstance(root, dict):
        return
    meta = unfold(root.get("metadados"))
    meta = meta if isinstance(meta, dict) else {}
    known = states(meta)
    state = lambda x: known.get(id(x)) or leaf(x)
    inside = lambda x, k: x[k] if isinstance(x, dict) and isinstance(x.get(k), dict) else {}
    # Every node with the table of its parent and the label it hangs on, over an explicit stack (any depth).
    todo: list[tuple] = [("", "metadados", meta, "", None, 0, 0)]
    while todo:
        above, label, x, path, parent, at, level = todo.pop()
        whole = state(x)
        table, subtype = ROUTES[above, label].get(whole.partition("(")[0], (None, None))
        if table is None:
            continue
        own = x if isinstance(x, dict) else {}
        name = root.get("id") if table == "audiencia" else x if subtype == "nome_solto" else own.get("nome")
        party = own if table == "vinculo" else {} if table != "participante" else own["filiacao"] if subtype == "filiada" else {"partido": own.get("filiacao")}
        text = own.get("assunto") if table == "audiencia" else _text(x) if table in ("opiniao", "replica") else None
        span = inside(own, "trecho") if subtype == "recorte" else {}
        yield (
            key, table, whole, path, parent, at, level, _string(name), _string(own.get("cargo")) if table == "participante" else None, _string(party.get("partido")), _string(party.get("uf")), _string(text),
            subtype, _whole(own.get("ano")) if table == "vinculo" else None, _whole(span.get("inicio")), _whole(span.get("fim")), _string(inside(inside(own, "origem"), "comissao").get("sigla")) if table == "audiencia" else None,
        )
        below: list[tuple] = []
        for name, children in (("envolvidos", unfold(own.get("envolvidos"))), ("opinioes", own.get("opinioes")), ("replicas", own.get("replicas")), ("historico", party.get("historico"))):
            if (table, name) in ROUTES:
                if name == "historico":
                    below += [(table, name, y, f"{path}/{n}", path, n, level + 1) for n, y in enumerate(elements(children))]
                else:
                    below += [(table, name, y, f"{path}.{n}" if path else str(n), path, n, level + 1) for n, y in enumerate(elements(children))]
        todo.extend(below[::-1])


def flatten_json(df: DataFrame, key: str, line: str) -> DataFrame:
    """All rows of the JSON lines in ``df[line]``, one pass, no shuffle; ``tabela`` names the table of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in ROW.split(", ")]
        for pdf in batches:
            rows = [r for k, s in zip(pdf["k"], pdf["s"]) if isinstance(s, str) for r in records(k, s)]
            yield pd.DataFrame(rows, columns=names)

    return df.select(F.col(key).cast("string").alias("k"), F.col(line).alias("s")).where("k is not null and s is not null").mapInPandas(run, ROW)


def flatten_typed(df: DataFrame, key: str, meta: str = "metadados") -> DataFrame:
    """The same rows from a typed column, by chained generators inside the JVM (no Python, no shuffle)."""
    base = df.select(F.col(key).cast("string").alias("chave"), F.col(meta).alias("m")).where(F.col("chave").isNotNull())
    none, number = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    leaf_ = lambda c: F.when(c.isNull(), "nulo").otherwise("texto")
    list_ = lambda c: F.when(c.isNull(), "nulo").otherwise("lista")

    def rows(d: DataFrame, above: str, label: str, state: Column, path: Column, parent: Column, at: Column, level: int, nome: Column, cargo: Column, texto: Column) -> DataFrame:
        """The rows of one level, by the same transitions: the state names the table and the subtype."""
        ways = ROUTES[above, label]
        kind = F.substring_index(state, "(", 1)
        table, subtype = (F.coalesce(*(F.when(kind == k, to[i]) for k, to in ways.items())) for i in (0, 1))
        return d.select(
            "chave", table.alias("tabela"), state.alias("variante"), path.alias("caminho"), parent.alias("pai"), at.cast("bigint").alias("posicao"), F.lit(level).alias("nivel"), nome.alias("nome"), cargo.alias("cargo"), none.alias("partido"), none.alias("uf"),
            texto.alias("texto"), subtype.alias("subtipo"), number.alias("ano"), number.alias("inicio"), number.alias("fim"), none.alias("sigla"),
        ).where("tabela is not null")

    people = base.select("chave", F.posexplode("m.envolvidos").alias("i", "e"))
    said = people.select("chave", "i", F.posexplode("e.opinioes").alias("j", "o"))
    i, j = F.col("i").cast("string"), F.col("j").cast("string")
    hearing = F.when(F.col("m").isNull(), "objeto()").otherwise(F.concat(F.lit("metadados(assunto:"), leaf_(F.col("m.assunto")), F.lit(",envolvidos:"), list_(F.col("m.envolvidos")), F.lit(")")))
    person = F.when(F.col("e").isNull(), "nulo").otherwise(F.concat(F.lit("pessoa(cargo:"), leaf_(F.col("e.cargo")), F.lit(",nome:"), leaf_(F.col("e.nome")), F.lit(",opinioes:"), list_(F.col("e.opinioes")), F.lit(")")))
    return (
        rows(base, "", "metadados", hearing, F.lit(""), none, F.lit(0), 0, F.col("chave"), none, F.col("m.assunto"))
        .unionByName(rows(people, "audiencia", "envolvidos", person, i, F.lit(""), F.col("i"), 1, F.col("e.nome"), F.col("e.cargo"), none))
        .unionByName(rows(said, "participante", "opinioes", leaf_(F.col("o")), F.concat(i, F.lit("."), j), i, F.col("j"), 2, none, none, F.col("o")))
    )


def tables(flat: DataFrame) -> dict[str, DataFrame]:
    """The flat tables by name; each keeps ``chave``, ``caminho`` and (but for hearings) ``pai``."""
    part = lambda name: flat.where(F.col("tabela") == name)
    return {
        "audiencias": part("audiencia").select("chave", "variante", F.col("nome").alias("id_declarado"), F.col("texto").alias("assunto")),
        "participantes": part("participante").select("chave", "caminho", "pai", "posicao", "variante", "nome", "cargo", "partido", "uf"),
        "opinioes": part("opiniao").select("chave", "caminho", "pai", "posicao", "variante", "texto"),
        "replicas": part("replica").select("chave", "caminho", "pai", "posicao", "nivel", "variante", "nome", "texto"),
        "vinculos": part("vinculo").select("chave", "caminho", "pai", "posicao", "variante", "partido", "ano"),
    }


def variants(flat: DataFrame) -> DataFrame:
    """How often each structural variant occurs in each table and subtype: (tabela, subtipo, variante, linhas)."""
    return flat.groupBy("tabela", "subtipo", "variante").agg(F.count("*").alias("linhas"))


def subtype(flat: DataFrame, tabela: str, subtipo: str) -> DataFrame:
    """The typed table of one subtype: the supertype key, the link to the parent, and the columns of this subtype."""
    columns = SUBTYPES.get((tabela, subtipo)) or SUBTYPES[tabela, None]
    return flat.where((F.col("tabela") == tabela) & (F.col("subtipo") == subtipo)).select("chave", "caminho", "pai", "posicao", *columns)


def spoken_paths(flat: DataFrame, origin: str) -> DataFrame:
    """Opinions and replies with a non-blank text, as (origem, chave, caminho), each once."""
    return flat.where(F.col("tabela").isin("opiniao", "replica") & not_blank(F.col("texto"))).select(F.lit(origin).alias("origem"), "chave", "caminho").distinct()
