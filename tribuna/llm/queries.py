"""Queries of the language-model operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tribuna.llm import canon, encode, mix, names, pairs, sentences, speakers, split, subjects
from tribuna.session import table


def _spellings(spark: SparkSession, folder: str) -> DataFrame:
    people = table(spark, folder, "publichearingbr_lds").select(F.explode("metadados.envolvidos").alias("e")).select("e.nome")
    return names.clusters(names.spellings([people, table(spark, folder, "df_turnos").select("orador_marcador")]))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of spellings of the same person or organisation."""
    return names.pairs(_spellings(spark, folder))


def p2_grupos(spark: SparkSession, folder: str) -> DataFrame:
    """Every spelling with its cluster, named by its first spelling."""
    out = _spellings(spark, folder)
    first = out.groupBy("grupo").agg(F.min("nome").alias("entidade"), F.count("*").alias("grafias"))
    return out.join(first, "grupo").select("nome", "entidade", "grafias")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Texts in which a cut inside a sentence cannot be avoided."""
    both = (("df_turnos", "turno_id", "texto_turno"), ("publichearingbr_lds", "id", "transcricao"))
    turns, hearings = (split.unavoidable(table(spark, folder, t), k, x).select(F.lit(x).alias("campo"), F.col("key").alias("chave")) for t, k, x in both)
    return turns.unionByName(hearings)


def p3_pedacos(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of both columns."""
    both = (("df_turnos", "turno_id", "texto_turno"), ("publichearingbr_lds", "id", "transcricao"))
    turns, hearings = (split.pieces(table(spark, folder, t).select(k, x).dropDuplicates([k]), k, x).withColumn("campo", F.lit(x)) for t, k, x in both)
    return turns.unionByName(hearings)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Where every turn begins and who speaks."""
    return speakers.speaker_turns(table(spark, folder, "publichearingbr_lds")).select(F.col("key").alias("id_audiencia"), "inicio_char", "nome").distinct()


def p4_turnos(spark: SparkSession, folder: str) -> DataFrame:
    """The turns with their clean speech."""
    return speakers.speaker_turns(table(spark, folder, "publichearingbr_lds"), version="recebido_em").withColumnRenamed("key", "id_audiencia")


def _canonical(spark: SparkSession, folder: str) -> DataFrame:
    ref = table(spark, folder, "lista_canonica").where("ref_id is not null").select("campo", "ref_id", "rotulo", "descricao").dropDuplicates(["ref_id"])
    person = table(spark, folder, "publichearingbr_lds").select(F.col("id").alias("id_audiencia"), F.explode("metadados.envolvidos").alias("e"))
    offices = person.select("id_audiencia", F.col("e.cargo").alias("valor"))
    parties = table(spark, folder, "base_posturas_classificadas").select("id_audiencia", F.col("filiacao_rede").alias("valor"))
    out = None
    for campo, rows, forms, readings in (("cargo", offices, canon.office_forms, canon.office_readings), ("filiacao_rede", parties, canon.party_forms, canon.party_readings)):
        rows = rows.where(r"valor is not null and valor rlike '(?U)[^\\s\\x1c-\\x1f]'").distinct()
        expanded = canon.expand(ref.where(F.col("campo") == campo), forms)
        part = rows.join(canon.match(rows, "valor", expanded, readings), "valor", "left").select(F.lit(campo).alias("campo"), "id_audiencia", "valor", F.coalesce("ref_id", F.lit(-1)).cast("bigint").alias("ref_id"))
        out = part if out is None else out.unionByName(part)
    return out


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every typed office and affiliation of a hearing with its entry, or -1."""
    return _canonical(spark, folder)


def p5_sem_entrada(spark: SparkSession, folder: str) -> DataFrame:
    """Values that mean no entry, and in how many hearings."""
    return _canonical(spark, folder).where("ref_id = -1").groupBy("campo", "valor").agg(F.countDistinct("id_audiencia").alias("audiencias"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences of every turn."""
    return sentences.sentences(table(spark, folder, "df_turnos"), "turno_id", "texto_turno").select(F.col("key").cast("bigint").alias("turno_id"), "inicio", "fim")


STANCES = ("A FAVOR", "CONTRA", "NEUTRO")
FAILURE = "Erro: Falha persistente na API."


def _together(spark: SparkSession, folder: str, least: int) -> DataFrame:
    rows = table(spark, folder, "base_posturas_classificadas").select("nome", "proposicao_alvo", "postura_final")
    name = F.upper(F.trim(F.regexp_replace("nome", r"(?U)[\s\x1c-\x1f]+", " ")))
    valid = rows.where(F.col("postura_final").isin(*STANCES) & F.col("proposicao_alvo").isNotNull() & (F.trim("proposicao_alvo") != FAILURE))
    valid = valid.select(F.nullif(name, F.lit("")).alias("nome"), F.concat_ws("\x1f", "postura_final", "proposicao_alvo").alias("cesta"))
    return pairs.pairs(valid, "nome", "cesta", least)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Speakers who stand together in at least 6 baskets and 3 times as often as chance."""
    found = _together(spark, folder, 6).where("n_ab * baskets >= 3 * n_a * n_b")
    return found.select(F.col("a").alias("nome_a"), F.col("b").alias("nome_b"))


def p1_medidas(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs that stand together more than once, with their counts, lift and PMI."""
    out = _together(spark, folder, 2).select(F.col("a").alias("nome_a"), F.col("b").alias("nome_b"), "n_ab", "n_a", "n_b", "baskets", "lift", "pmi")
    return out.withColumns({c: F.round(c, 6) for c in ("lift", "pmi")})


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return encode.encode(table(spark, folder, "documents"), "doc_id", "text").select(F.col("key").alias("doc_id"), "ids")


def _mixed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sized = mix.sizes(table(spark, folder, "documents"), "doc_id", "text", "source")
    return mix.mix(sized, table(spark, folder, "pesos_fontes"), "source", "peso_alvo", "max_repeticoes")


def p9_mistura(spark: SparkSession, folder: str) -> DataFrame:
    """The mix: each document used, and how often."""
    return _mixed(spark, folder)[0].select(F.col("doc").alias("doc_id"), F.col("fonte").alias("source"), "tokens", "copias")


def p9_relatorio(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached share of every source, and which fall short, have no target or no documents."""
    out = _mixed(spark, folder)[1].withColumnRenamed("fonte", "source")
    return out.withColumns({c: F.round(c, 6) for c in ("repeticoes", "parte_real")})


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The subject areas of every document."""
    t = [table(spark, folder, n) for n in ("documents", "areas_rotulos", "areas_referencia")]
    return subjects.subject_areas(*t).withColumnRenamed("key", "doc_id")


def p10_composicao(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and characters of each area, by source: the composition of the corpus."""
    docs = table(spark, folder, "documents").select("doc_id", "source", F.length("text").cast("bigint").alias("n"))
    return p10_found(spark, folder).join(docs, "doc_id").groupBy("area", "source").agg(F.count("*").alias("documentos"), F.sum("n").alias("caracteres"))


QUERIES = {"p1_found": p1_found, "p1_medidas": p1_medidas, "p2_found": p2_found, "p2_grupos": p2_grupos, "p3_found": p3_found, "p3_pedacos": p3_pedacos, "p4_found": p4_found, "p4_turnos": p4_turnos, "p5_found": p5_found, "p5_sem_entrada": p5_sem_entrada, "p6_found": p6_found, "p8_ids": p8_ids, "p9_mistura": p9_mistura, "p9_relatorio": p9_relatorio, "p10_found": p10_found, "p10_composicao": p10_composicao}
_TOGETHER = """with m as (
  select distinct upper(trim(regexp_replace(nome, '\\s+', ' ', 'g'))) n, proposicao_alvo || chr(31) || postura_final b
  from base_posturas_classificadas
  where nome is not null and trim(regexp_replace(nome, '\\s+', ' ', 'g')) <> '' and postura_final in ('A FAVOR', 'CONTRA', 'NEUTRO')
    and proposicao_alvo is not null and trim(proposicao_alvo) <> 'Erro: Falha persistente na API.'),
c as (select n, count(*) k from m group by n),
p as (select x.n nome_a, y.n nome_b, count(*) n_ab from m x join m y on x.b = y.b and x.n < y.n group by all having count(*) >= LEAST),
w as (select p.*, ca.k n_a, cb.k n_b, (select count(distinct b) from m) baskets from p join c ca on ca.n = nome_a join c cb on cb.n = nome_b)
"""

SQL: dict[str, str] = {
    "p1_found": _TOGETHER.replace("LEAST", "6") + "select nome_a, nome_b from w where n_ab * baskets >= 3 * n_a * n_b",
    "p1_medidas": _TOGETHER.replace("LEAST", "2") + "select nome_a, nome_b, n_ab, n_a, n_b, baskets, round(n_ab * baskets / (n_a * n_b), 6) lift, round(log2(n_ab * baskets / (n_a * n_b)), 6) pmi from w",
}
