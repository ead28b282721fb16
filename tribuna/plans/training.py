"""Queries of the general (not language-model) part of the training-data pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tribuna.operators import nested
from tribuna.session import table


def _flat(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    typed = nested.flatten_typed(table(spark, folder, "publichearingbr_lds"), "id")
    return typed, nested.flatten_json(table(spark, folder, "hearings_raw"), "raw_id", "linha")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every opinion and reply with a non-blank text and its place."""
    typed, raw = _flat(spark, folder)
    return nested.spoken_paths(typed, "tipada").unionByName(nested.spoken_paths(raw, "bruta"))


def _table(name: str):  # noqa: ANN202
    def query(spark: SparkSession, folder: str) -> DataFrame:
        typed, raw = _flat(spark, folder)
        return nested.tables(typed.unionByName(raw))[name].distinct()

    query.__name__, query.__doc__ = f"p7_{name}", f"The flat table of {name} from both sources, with parent links."
    return query


def _subtype(tabela: str, subtipo: str):  # noqa: ANN202
    def query(spark: SparkSession, folder: str) -> DataFrame:
        typed, raw = _flat(spark, folder)
        return nested.subtype(typed.unionByName(raw), tabela, subtipo).distinct()

    query.__name__, query.__doc__ = f"p7_{tabela}_{subtipo}", f"The typed table of the subtype {subtipo} of {tabela}."
    return query


def p7_variantes(spark: SparkSession, folder: str) -> DataFrame:
    """The structural variants of both sources, the subtype each goes to, and how often it occurs."""
    typed, raw = _flat(spark, folder)
    return nested.variants(typed).withColumn("origem", F.lit("tipada")).unionByName(nested.variants(raw).withColumn("origem", F.lit("bruta")))


_TABLES = [_table(n) for n in ("audiencias", "participantes", "opinioes", "replicas", "vinculos")]
_SUBTYPES = [_subtype(*x) for x in (("audiencia", "proveniente"), ("participante", "pessoa"), ("participante", "filiada"), ("opiniao", "texto_solto"), ("opiniao", "fala"), ("opiniao", "recorte"), ("replica", "texto_solto"), ("replica", "fala"))]
QUERIES = {f.__name__: f for f in (p7_found, p7_variantes, *_TABLES, *_SUBTYPES)}
#: The typed half of the first query is plain unnesting; the raw half has no fixed shape for SQL to state.
SQL: dict[str, str] = {}
