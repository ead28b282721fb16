"""Speaker turns: markers with offsets, known speakers, turns, and whose they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tribuna import schema
from tribuna.functions import text as T
from tribuna.operators import flatten
from tribuna.session import cut

#: Fixed value: a marker is a form of address, a name of 2 to 100 characters, perhaps a bracket, and a hyphen.
MARKER = r"(?iU)(\b(?:O\s+SR\.?|A\s+SRA\.?)\s+[^()\n-]{2,100}(?:\([^\n)]{1,140}\))?)\s*-\s*"


def markers(hearings: DataFrame, key: str = "id", text: str = "transcricao", by: tuple[str, ...] = ()) -> DataFrame:
    """Every marker of a transcript: start and end in code points, the marker and the name in it."""
    texts = hearings.select(F.col(key).alias("id_audiencia"), *by, F.col(text).alias("t")).where(T.strip(T.text_or_empty(F.col(text))) != "")
    gaps = F.transform(F.split("t", MARKER, -1), F.length)
    # From here on only markers and lengths move, not transcripts.
    rows = texts.select("id_audiencia", *by, F.length("t").alias("tamanho"), F.posexplode(F.arrays_zip(F.regexp_extract_all("t", F.lit(MARKER), F.lit(0)).alias("m"), gaps.alias("g"))).alias("i", "x")).where("x.m is not null")
    rows = rows.select("id_audiencia", *by, "tamanho", "i", F.col("x.m").alias("m"), F.col("x.g").alias("g"), F.length("x.m").alias("l"))
    if by:  # stored rows that are equal in all have the same markers
        rows = rows.dropDuplicates(["id_audiencia", *by, "i"])
    # A marker ends behind all gaps and markers up to and with it.
    end = F.sum(F.col("g") + F.col("l")).over(Window.partitionBy("id_audiencia", *by).orderBy("i"))
    found = rows.withColumn("fim", end).select("id_audiencia", *by, "tamanho", (F.col("fim") - F.col("l")).alias("inicio"), "fim", F.regexp_replace("m", rf"(?U){T.BLANK}*-{T.BLANK}*$", "").alias("marcador"))
    return found.withColumn("orador_marcador", T.clean_marker(F.col("marcador")))


def known_names(people: DataFrame, name: str = "nome") -> DataFrame:
    """The distinct normalised names of the corpus, with their words of three letters and more."""
    return people.select(T.normalize_name(F.col(name)).alias("conhecido")).where("conhecido <> ''").distinct().withColumn("palavras", T.tokens(F.col("conhecido"), 3)).where("size(palavras) > 0")


def accept(found: DataFrame, known: DataFrame) -> DataFrame:
    """Markers of a known role or speaker.

    Containment is an equi-join: each known name is looked up under its rarest word only, and the rest of its
    words is checked on the few pairs that meet there.
    """
    # Names are normalised once each, not once a marker.
    spelled = found.select("orador_marcador").distinct().withColumn("norma", T.normalize_name(F.col("orador_marcador")))
    seen = spelled.select("norma").distinct().withColumn("tem", T.tokens(F.col("norma")))
    words = known.select("conhecido", "palavras", F.explode("palavras").alias("w"))
    often = words.groupBy("w").agg(F.count("*").alias("n"))
    rarest = words.join(often, "w").groupBy("conhecido").agg(F.min(F.struct("n", "w")).alias("x"), F.first("palavras").alias("palavras")).select(F.col("x.w").alias("w"), "palavras")
    ours = seen.select("norma", "tem", F.explode("tem").alias("w")).join(rarest, "w").where(T.contains_name(F.col("tem"), F.col("palavras"))).select("norma").distinct()
    roles = seen.where(F.col("norma").isin(*schema.ROLES)).select("norma")
    return found.join(spelled.join(ours.union(roles).distinct(), "norma", "left_semi"), "orador_marcador")


def turns(hearings: DataFrame, accepted: DataFrame, key: str = "id", text: str = "transcricao", by: tuple[str, ...] = ()) -> DataFrame:
    """Text from an accepted marker to the next one; a marker without text is dropped but still ends the turn before it.

    The markers of a hearing become one array, so a transcript meets one row and is cut up in it. ``by``: further
    columns of both sides that a row of ``hearings`` is told by.
    """
    marks = F.sort_array(F.collect_list(F.struct("inicio", "fim", "orador_marcador")))
    spans = accepted.groupBy("id_audiencia", *by).agg(marks.alias("m"), F.first("tamanho").alias("tamanho"))
    texts = hearings.select(F.col(key).alias("id_audiencia"), *by, F.col(text).alias("t"))

    def said(x: Column, i: Column) -> Column:
        until = F.coalesce(F.get("m", i + 1)["inicio"], F.col("tamanho"))
        whole = T.clean_text(F.substring(F.col("t"), (x["fim"] + 1).cast("int"), (until - x["fim"]).cast("int")))
        return F.struct(x["orador_marcador"].alias("orador_marcador"), whole.alias("texto_turno"), x["inicio"].cast("bigint").alias("inicio_char"), until.cast("bigint").alias("fim_char"))

    rows = texts.join(spans, ["id_audiencia", *by]).select("id_audiencia", F.filter(F.transform("m", said), lambda x: x["texto_turno"] != "").alias("x"))
    return rows.select("id_audiencia", F.posexplode("x").alias("ordem_turno", "x")).select("id_audiencia", "x.*", F.col("ordem_turno").cast("bigint").alias("ordem_turno"))


def attribute(turned: DataFrame, people: DataFrame, ordinal: str = "hearing") -> DataFrame:
    """Turns of the participants whose name is contained in the marker; one turn may belong to several.

    ``ordinal="speaker"`` numbers the turns of each participant densely instead of keeping the hearing's numbers.
    """
    names = people.withColumn("palavras", T.tokens(T.normalize_name(F.col("nome")), 3))
    heard = turned.withColumn("tem", T.tokens(T.normalize_name(F.col("orador_marcador"))))
    rows = heard.join(names, "id_audiencia").where(T.contains_name(F.col("tem"), F.col("palavras"))).drop("tem", "palavras")
    if ordinal == "speaker":
        rows = rows.withColumn("ordem_turno", (F.row_number().over(Window.partitionBy("id_audiencia", "part_ord").orderBy("inicio_char")) - 1).cast("bigint"))
    return rows


def extract(hearings: DataFrame, people: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """All steps up to the turns, for one row a hearing; ``known`` overrides the names of the corpus.

    Markers are short rows made by scanning every transcript, and are used twice, so they are kept.
    """
    return turns(hearings, accept(cut(markers(hearings)), known_names(people) if known is None else known))


def latest_people(stored: DataFrame, key: str = "id", version: str = "recebido_em", text: str = "transcricao") -> tuple[DataFrame, DataFrame]:
    """Which stored row of each hearing is the latest (key, linha, n), and its participants; transcripts are hashed where they are read."""
    light = cut(stored.withColumn("linha", flatten.fingerprint(stored, key)).drop(text))
    return cut(flatten.newest(light, key, version, "linha")), flatten.participants(flatten.latest(light, key, version))


def extract_latest(stored: DataFrame, newest: DataFrame, people: DataFrame, known: DataFrame | None = None, key: str = "id") -> DataFrame:
    """The same for stored rows of which the latest of each hearing counts (see ``latest_people``): each transcript moves once at most, to its markers."""
    told = stored.withColumn("linha", flatten.fingerprint(stored, key))
    rows = newest.select(F.col(key).alias("id_audiencia"), "linha")
    found = cut(markers(told, by=("linha",)).join(rows, ["id_audiencia", "linha"], "left_semi"))
    out = turns(told, accept(found, known_names(people) if known is None else known), by=("linha",))
    # Rows that are equal in all, the version included, give equal turns.
    return out.dropDuplicates(["id_audiencia", "ordem_turno"]) if newest.where("n > 1").limit(1).count() else out
