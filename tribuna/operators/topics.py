"""Looking into one topic: the first hearing on it, or subjects like it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tribuna.functions import text as T


def with_all_terms(people: DataFrame, terms: list[str], column: str = "assunto_audiencia") -> DataFrame:
    """Rows whose lower-cased subject holds every term; accents count."""
    low = F.lower(T.text_or_empty(F.col(column)))
    return people.where(reduce(lambda a, b: a & b, [low.contains(t) for t in terms]))


def like_any(people: DataFrame, pattern: str, column: str = "assunto_audiencia") -> DataFrame:
    """Rows whose subject matches a pattern in any case; null matches nothing."""
    return people.where(F.coalesce(F.col(column).rlike(f"(?iu){pattern}"), F.lit(False)))


def first_hearing(people: DataFrame, terms: list[str], order: list[str]) -> DataFrame:
    """The first hearing on a topic: id and subject, or nothing."""
    return with_all_terms(people, terms).orderBy(*order).limit(1).select("id_audiencia", "assunto_audiencia")


def on_topic(stored: DataFrame, people: DataFrame, terms: list[str], order: list[str], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The first hearing on a topic and its stored rows: it is found first, so that nothing is extracted from the others."""
    found = first_hearing(people, terms, order)
    return found, stored.join(F.broadcast(found.select(F.col("id_audiencia").alias(key))), key, "left_semi")  # one row


def inspect(turned: DataFrame, found: DataFrame) -> DataFrame:
    """The turns of the hearing found, numbered from 1."""
    return turned.join(F.broadcast(found), "id_audiencia").select("id_audiencia", "assunto_audiencia", (F.col("ordem_turno") + 1).alias("numero"), "orador_marcador", "texto_turno")
