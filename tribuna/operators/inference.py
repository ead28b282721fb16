"""Proposition mining and stance detection with any model, called in Arrow batches.

A model is a callable from a prompt, a pair (system, human), to a text, such as `sources.chat.Chat`. It is called once for each distinct
input, from a thread pool inside each task, with bounded retries; what fails for
good becomes a sentinel that is flagged. Results should be written before reuse,
since a lost task asks again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tribuna import schema
from tribuna.functions import text as T

Prompt = tuple[str, str]
Model = Callable[[Prompt], str]
THREADS = 10
MINING_WAITS = (15, 30, 60)
STANCE_WAITS = (4, 4)


# What a model is told. The prefix and the three answers are what the parsers below look for.
MINING_RULES = """Você analisa debates de audiências públicas.
Extraia de 1 a 3 proposições centrais: teses polêmicas sobre as quais os participantes se dividiram.

Regras:
- Uma proposição por linha, em português, direta e assertiva.
- Toda linha começa exatamente com o prefixo "PROP: ".
- Nada além dessas linhas: sem introdução, saudação ou explicação.

Exemplo:
PROP: A tarifa social deve valer para todos os bairros.
PROP: O novo prazo inviabiliza as pequenas obras."""
STANCE_RULES = """Você é um juiz imparcial de debates.
Compare a opinião com a proposição: a opinião a apoia, a ataca ou é neutra em relação a exatamente essa proposição?

Regras:
- Responda com uma só destas respostas: A FAVOR, CONTRA ou NEUTRO.
- Nada além dela: sem pontuação, explicação ou raciocínio."""


def mining_prompt(assunto: str, opinioes: str) -> tuple[str, str]:
    """(system, human) for the propositions of a hearing."""
    return MINING_RULES, f'Assunto da audiência: "{assunto}"\n\nOpiniões dos participantes:\n{opinioes}'


def stance_prompt(proposicao: str, opiniao: str) -> tuple[str, str]:
    """(system, human) for the stance of one opinion on one proposition."""
    return STANCE_RULES, f'PROPOSIÇÃO ALVO: "{proposicao}"\n\nOPINIÃO DO ORADOR: "{opiniao}"\n\nPOSTURA:'


def ask(model: Model, prompt: Prompt | str, waits: tuple[float, ...], good: Callable[[str], bool], sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The first good answer, asking again after each wait; None if there is none."""
    for wait in (*waits, None):
        try:
            answer = model(prompt)
            if good(answer):
                return answer
        except Exception:  # noqa: BLE001 - whatever a model's client raises counts as a failed attempt
            pass
        if wait is not None:
            sleep(wait)
    return None


def mining_input(opinions: DataFrame) -> DataFrame:
    """The opinions of each hearing as one bulleted text, in order."""
    listed = F.array_sort(F.collect_list(F.struct("part_ord", "op_ord", "opiniao_limpa")))
    text = F.concat(F.lit("\n- "), F.array_join(F.transform(listed, lambda x: x["opiniao_limpa"]), "\n- "))
    return opinions.groupBy("id_audiencia", "assunto_audiencia").agg(text.alias("opinioes"))


def has_propositions(answer: str) -> bool:
    return any(line.startswith("PROP:") for line in answer.strip().split("\n"))


def mine(inputs: DataFrame, model: Model, waits: tuple[float, ...] = MINING_WAITS, sleep: Callable[[float], None] = time.sleep, threads: int = THREADS) -> DataFrame:
    """Propositions of each hearing: id_audiencia, proposicoes_audiencia (joined by " | "), erro."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                prompts = [mining_prompt(a or "", o or "") for a, o in zip(pdf["assunto_audiencia"], pdf["opinioes"])]
                yield pd.DataFrame({"id_audiencia": pdf["id_audiencia"], "resposta": list(pool.map(lambda p: ask(model, p, waits, has_propositions, sleep), prompts))})

    answers = inputs.select("id_audiencia", "assunto_audiencia", "opinioes").mapInPandas(run, "id_audiencia string, resposta string")
    found = F.array_join(T.prefixed_lines(F.col("resposta")), " | ")
    return answers.select("id_audiencia", F.coalesce(found, F.lit(schema.MINING_FAILED)).alias("proposicoes_audiencia"), F.col("resposta").isNull().alias("erro"))


def pair_up(opinions: DataFrame, propositions: DataFrame) -> DataFrame:
    """Every opinion with every proposition of its hearing; a hearing with blank propositions only keeps one row with null."""
    one = propositions.groupBy("id_audiencia").agg(F.max("proposicoes_audiencia").alias("proposicoes_audiencia"))
    joined = opinions.join(one, "id_audiencia")
    return joined.withColumn("proposicao_alvo", F.explode_outer(T.split_list(F.col("proposicoes_audiencia"))))


def detect(pairs: DataFrame, model: Model, waits: tuple[float, ...] = STANCE_WAITS, sleep: Callable[[float], None] = time.sleep, threads: int = THREADS) -> DataFrame:
    """The stance of every pair; equal pairs are asked once (a deterministic model answers them alike)."""
    known = F.struct(F.coalesce("proposicao_alvo", F.lit("")).alias("p"), F.col("opiniao_limpa").alias("o"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                prompts = [stance_prompt(p, o) for p, o in zip(pdf["p"], pdf["o"])]
                yield pd.DataFrame({"p": pdf["p"], "o": pdf["o"], "resposta": list(pool.map(lambda x: ask(model, x, waits, lambda _: True, sleep), prompts))})

    asked = pairs.select(known.alias("k")).select("k.p", "k.o").distinct().mapInPandas(run, "p string, o string, resposta string")
    label = F.when(F.col("resposta").isNull(), schema.FAILED).otherwise(T.stance(F.col("resposta")))
    labels = asked.select("p", F.col("o").alias("opiniao_limpa"), label.alias("postura_final"))
    return pairs.withColumn("p", F.coalesce("proposicao_alvo", F.lit(""))).join(labels, ["p", "opiniao_limpa"]).drop("p")


# -- offline stand-ins, deterministic -------------------------------------------------


def offline_miner(prompt: Prompt) -> str:
    """The first, and if they differ the last, opinion of the prompt as propositions."""
    said = [s[2:].strip() for s in prompt[1].split("\n") if s.startswith("- ")]
    return "\n".join(f"PROP: {s.replace('|', '/')}" for s in dict.fromkeys((said[0], said[-1]))) if said else ""


def offline_judge(prompt: Prompt) -> str:
    """A keyword rule on the opinion."""
    opinion = prompt[1].rpartition('OPINIÃO DO ORADOR: "')[2].lower()
    return "A favor." if any(w in opinion for w in ("favorável", "defendo", "melhora")) else "Contra." if any(w in opinion for w in ("contra", "ninguém", "piorou")) else "Neutro."
