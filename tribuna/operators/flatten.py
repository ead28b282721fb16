"""Hearings to participants and opinions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tribuna.functions import text as T


def latest(df: DataFrame, key: str = "id", version: str = "recebido_em") -> DataFrame:
    """The last delivered row of each hearing; the texts pass no shuffle but this one's."""
    if version not in df.columns:
        return df.dropDuplicates([key])
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(F.coalesce(version, F.lit("1900-01-01").cast("timestamp")), F.xxhash64(*others))).alias("x")).select(key, "x.*")


def fingerprint(df: DataFrame, key: str = "id") -> Column:
    """A hash of everything in a row but its key and maps."""
    return F.xxhash64(*[c for c in df.columns if c != key])


def newest(df: DataFrame, key: str = "id", version: str = "recebido_em", row: str = "linha") -> DataFrame:
    """(key, row, n): which row of each key was delivered last, by its fingerprint, and how many rows are equal to it; no text moves."""
    seen = df.select(key, F.coalesce(version, F.lit("1900-01-01").cast("timestamp")).alias("v"), row).groupBy(key, "v", row).agg(F.count("*").alias("n"))
    return seen.groupBy(key).agg(F.max(F.struct("v", row, "n")).alias("x")).select(key, F.col(f"x.{row}").alias(row), "x.n")


def participants(df: DataFrame) -> DataFrame:
    """One row a participant, in the order stored; the transcript stays with the hearing."""
    rows = df.select(F.col("id").alias("id_audiencia"), T.clean_text(F.col("metadados.assunto")).alias("assunto_audiencia"), F.posexplode("metadados.envolvidos").alias("part_ord", "e"))
    joined = F.concat_ws(" | ", F.coalesce("e.opinioes", F.array().cast("array<string>")))
    return rows.select("id_audiencia", "assunto_audiencia", F.col("part_ord").cast("bigint").alias("part_ord"), T.title_case(T.clean_text(F.col("e.nome"))).alias("nome"), T.clean_text(F.col("e.cargo")).alias("cargo"), T.clean_text(joined).alias("opinioes_resumo"))


def opinions(df: DataFrame) -> DataFrame:
    """One row a non-blank opinion, with the affiliation taken from the office."""
    people = df.select(F.col("id").alias("id_audiencia"), T.text_or_empty(F.col("metadados.assunto")).alias("assunto_audiencia"), F.posexplode("metadados.envolvidos").alias("part_ord", "e"))
    rows = people.select("id_audiencia", "assunto_audiencia", "part_ord", T.title_case(T.strip(T.text_or_empty(F.col("e.nome")))).alias("nome"), T.strip(T.text_or_empty(F.col("e.cargo"))).alias("cargo"), F.posexplode("e.opinioes").alias("op_ord", "opiniao"))
    said = rows.withColumn("opiniao_limpa", T.strip(T.text_or_empty(F.col("opiniao")))).where("opiniao_limpa <> ''")
    return said.select("id_audiencia", "assunto_audiencia", F.col("part_ord").cast("bigint").alias("part_ord"), F.col("op_ord").cast("bigint").alias("op_ord"), "nome", "cargo", "opiniao_limpa", T.affiliation(F.col("cargo")).alias("filiacao_rede"))
