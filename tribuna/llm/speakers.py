"""Transcripts into clean, ordered speaker turns.

1. Labels are found by form: ``O SR. NAME (PARTY - UF) -`` anywhere, and ``NAME:``,
   ``Name –``, ``Pres. (Name):`` and the like where a line or sentence begins.
2. Speakers are normalised within each transcript: the label names and the
   participants of the hearing are nodes, pairs whose initials and letters agree
   are joined by union-find from the most to the least similar, and a union that
   would put two participants into one class is refused. A class takes the name of
   its participant. A bare chair's label is the person presiding: who was last
   named as the chair before it, or else first after it.
3. The speech behind a label loses time marks, annotations, hesitations and labels;
   labels without spoken words are dropped; successive turns of one participant
   become one.

Work is per transcript in Arrow batches next to the scan, without any shuffle.

Defined results: null and blank transcripts have no turns; a hearing without
participants has turns of speakers not identified (empty name); participants with
null or blank names are never speakers; two participants of equal similarity: the
first in the list; copies of a hearing give equal rows, which a caller makes
distinct, or names the column by which the latest version wins; other columns are
ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tribuna.llm.canon import folded
from tribuna.llm.names import similarity
from tribuna.llm.sentences import NOTE, TIME, ends

LIKE = 0.5
#: How the chair is called, and speakers nobody has identified (folded).
CHAIR = re.compile(r"(?:vice[- ])?president[ea]|pres\.?")
UNKNOWN = re.compile(r"(?:um |uma )?(?:orador|oradora|voz|participante|pessoa|interlocutor|locutor|falante)?\s*(?:nao identificad[oa]|desconhecid[oa]|da plateia|do publico)|orador|oradora|participante|plateia|nao identificad[oa]")
#: Titles that may stand before a name or role.
TITLE = r"(?:Sr|Sra|Srs|Sras|Dep|Sen|Ver|Min|Dr|Dra|Prof|Profa|Eng|Enga|Cel|Gen|Des|Senhor|Senhora|Deputad[oa]|Senador|Senadora|Ministr[oa]|Vereador|Vereadora)"
#: The mark before a label, which is not part of it.
LEAD = rf"(?:{TIME}|\d{{1,2}}:\d{{2}}:\d{{2}}(?:[.,]\d{{1,3}})?|\[[^\[\]\n]{{1,80}}\])"
FORMAL = re.compile(r"(?<![\w])(?:O\s+SR|A\s+SRA)\b\.?[ \t]+(?P<name>[^\n()a-zß-öø-ÿ:;!?–—-]{2,100}?|VICE-PRESIDENTE)[ \t]*(?:\((?P<inner>[^()\n]{1,140})\))?[ \t]*[-–—][ \t]*")
PLAIN = re.compile(
    rf"(?P<name>(?:{TITLE}\.?\s+)*(?:[^\W\d_a-zß-öø-ÿ](?:[^\s()\n:–—]|(?<=[A-ZÀ-Þ])\.)*)(?:[ \t]+(?:d[aeo]s?|e|DE|DA|DO|DOS|DAS|E|[^\W\d_]\.?|[^\s():–—\n]{{2,40}})){{0,7}}?)[ \t]*(?:\((?P<inner>[^()\n]{{1,140}})\))?[ \t]*(?P<sep>:|–)[ \t]*(?=\S)"
)
START = re.compile(rf"(?:^|\n)[ \t\r\f\v\xa0]*(?:{LEAD}[ \t\xa0]*)*|(?P<end>[.!?…。！？।؟]+)[\"”»')\]]*[ \t\xa0]+(?:{LEAD}[ \t\xa0]*)*|{LEAD}[ \t\xa0]+")
SKIPPED = re.compile(rf"{TIME}|(?<![\d:.,])\d{{1,2}}:\d{{2}}:\d{{2}}(?:[.,]\d{{1,3}})?(?![\d:])|{NOTE}|\((?:risos?|pausa|palmas|aplausos|inaud[ií]vel|m[uú]sica|choro|sil[eê]ncio)\)|\[[^\[\]\n]{{1,80}}\]|\*[^*\n]{{2,60}}\*")
MARKED = re.compile(r"[\[(（<*]|[0-9](?=:[0-9]{2}:)")
#: Hesitations, with the dots or commas they bring along.
HESITATION = re.compile(r"(?<![\w])(?:ahn|uhm|hum|hãã?|ãh|éé+|eh+|tá|né|tipo|assim, ó|é(?=\.\.\.))(?:\.\.\.|…|,)\s*", re.I)
WORDS = re.compile(r"\w")


def unmarked(text: str) -> str:
    """A text with a blank in place of every time mark and annotation; most texts have none, which a plain search tells."""
    return SKIPPED.sub(" ", text) if MARKED.search(text) else text


def clean(text: str) -> str:
    """Speech without time marks, annotations and hesitations, blanks collapsed; empty if no word is left without them."""
    left = unmarked(text)
    return " ".join(HESITATION.sub("", left).split()) or left.strip() if WORDS.search(left) else ""


class Label:
    __slots__ = ("at", "end", "name", "inner", "formal", "start")

    def __init__(self, at: int, end: int, name: str, inner: str, formal: bool, start: bool) -> None:
        self.at, self.end, self.name, self.inner, self.formal, self.start = at, end, name, inner, formal, start


TITLES_BEFORE = re.compile(rf"(?i:(?:{TITLE})\b\.?\s+)*")


@lru_cache(maxsize=100_000)
def person(name: str, inner: str) -> tuple[str, str]:
    """What a label says: ("cadeira", name or "") for the chair, ("ninguem", "") or ("pessoa", name)."""
    f = folded(name).strip(" .")
    f = re.sub(r"^(?:o|a)\s+", "", f)
    bare = re.sub(r"^(?:sr|sra|senhor|senhora|dep|sen|deputad[oa]|senador|senadora|ver|vereador|vereadora)\.?\s+", "", f)
    if CHAIR.fullmatch(bare):
        return "cadeira", re.split(r"\.\s|\s-\s|/", inner)[0].strip() if inner and not re.fullmatch(r"[A-Z]{2,6}\s*[-/]\s*[A-Z]{2}", inner.strip()) else ""
    if UNKNOWN.fullmatch(bare):
        return "ninguem", ""
    return "pessoa", TITLES_BEFORE.sub("", name, count=1).strip(" .-")


def chair_name(inner: str) -> str:
    """The name in the bracket behind a chair's label: up to the party."""
    return re.sub(r"[.,]?\s+[A-ZÀ-Ý]{2,6}\s*[-/]\s*[A-Z]{2}\s*$", "", inner).strip()


@lru_cache(maxsize=200_000)
def alike(a: str, b: str) -> float:
    return similarity(a, b)


def running(name: str) -> bool:
    """Whether there is running text around a name: an article inside, or more than one word in lower case that is no particle."""
    words = [w for w in TITLES_BEFORE.sub("", name, count=1).split() if not re.fullmatch(r"d[aeo]s?|e", w)]
    return any(w in ("o", "a", "os", "as") for w in words) or sum(w[0].islower() for w in words) > 1


def looks_like_name(name: str) -> bool:
    """Whether every word is capitalised or a particle, and there are two that are no title."""
    words = [w for w in re.split(r"[\s,]+", TITLES_BEFORE.sub("", name, count=1)) if w]
    caps = [w for w in words if not re.fullmatch(r"d[aeo]s?|e", w)]
    return len(caps) >= 2 and all(w[:1].isupper() for w in caps) and len(words) <= 8


def labels(text: str, people: list[str]) -> list[Label]:
    """The labels of a transcript in order."""
    found: list[Label] = []
    for m in FORMAL.finditer(text):
        found.append(Label(m.start(), m.end(), m["name"].strip(), m["inner"] or "", True, True))
    begun, ended = [x.at for x in found], [x.end for x in found]  # both ascend: the labels do not overlap
    for s in START.finditer(text):
        m = PLAIN.match(text, s.end())
        # The last formal label that begins before this one ends must have ended before it begins.
        last = bisect_left(begun, m.end()) - 1 if m else -1
        if not m or last >= 0 and ended[last] > m.start():
            continue
        if s["end"] and not ends(text, s.start("end"), s.end("end")):
            continue
        line = not s["end"]
        kind, name = person(m["name"], m["inner"] or "")
        if kind == "pessoa":
            known = not running(m["name"]) and any(alike(name, p) >= LIKE for p in people)
            if not known and not (line and looks_like_name(m["name"]) and not text[m.end() : m.end() + 1].islower()):
                continue
        if text[m.end() : m.end() + 1].islower() and not line:
            continue
        found.append(Label(m.start(), m.end(), m["name"].strip(), m["inner"] or "", False, line))
    found.sort(key=lambda x: x.at)
    return found


def classes(names: list[str], people: list[str]) -> dict[str, int]:
    """The participant (index) of each label name, by union-find over names and participants; names without one are left out."""
    nodes = [*people, *names]
    parent = list(range(len(nodes)))
    owner = [i if i < len(people) else -1 for i in range(len(nodes))]

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    pairs = []
    for i in range(len(people), len(nodes)):
        for j in range(i):
            s = alike(nodes[i], nodes[j])
            if s >= LIKE:
                # Participants before other labels, then the first in the list.
                pairs.append((-s, j >= len(people), i, j))
    for _, _, i, j in sorted(pairs):
        a, b = root(i), root(j)
        if a == b or owner[a] >= 0 and owner[b] >= 0:
            continue
        parent[a] = b
        owner[b] = max(owner[a], owner[b])
    return {nodes[i]: owner[root(i)] for i in range(len(people), len(nodes)) if owner[root(i)] >= 0}


def turns(text: str | None, people: list[str | None] | None) -> list[tuple[int, str, str]]:
    """Turns of a transcript: (where the label begins, name of the participant as stored or "", clean speech)."""
    if not text or not text.strip():
        return []
    stored = [p for p in (people or []) if isinstance(p, str) and p.strip()]
    marks = labels(text, stored)
    said = []
    for x in marks:
        kind, name = person(x.name, x.inner)
        if kind == "cadeira":
            name = chair_name(x.inner) if x.inner and not re.fullmatch(r"[A-ZÀ-Ý]{2,6}\s*[-/]\s*[A-Z]{2}", x.inner.strip()) else ""
        said.append((kind, name))
    who = classes(sorted({n for _, n in said if n}), stored)
    chairs = [who.get(n) if k == "cadeira" and n else None for k, n in said]
    first = next((c for c in chairs if c is not None), None)
    out: list[tuple[int, int, list[str]]] = []
    presiding = first
    for i, (x, (kind, name)) in enumerate(zip(marks, said)):
        if chairs[i] is not None:
            presiding = chairs[i]
        speech = text[x.end : marks[i + 1].at if i + 1 < len(marks) else len(text)]
        speech = clean(speech)
        if not speech:
            continue
        speaker = -1
        if kind == "cadeira":
            speaker = (who.get(name, -1) if name else presiding if presiding is not None else -1)
        elif kind == "pessoa":
            speaker = who.get(name, -1)
        if speaker >= 0 and out and out[-1][1] == speaker:
            out[-1][2].append(speech)
        else:
            out.append((x.at, speaker, [speech]))
    return [(at, stored[s] if s >= 0 else "", " ".join(parts)) for at, s, parts in out]


def speaker_turns(df: DataFrame, key: str = "id", text: str = "transcricao", people: str = "metadados.envolvidos.nome", version: str | None = None) -> DataFrame:
    """(key, ordem, inicio_char, nome, fala) of every row, or of the latest row of each key if ``version`` names a column."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, n, at, who, what) for k, t, p in zip(pdf["key"], pdf["text"], pdf["people"]) for n, (at, who, what) in enumerate(turns(t, list(p) if p is not None else []))]
            yield pd.DataFrame(rows, columns=["key", "ordem", "inicio_char", "nome", "fala"])

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.col(people).alias("people"), *([F.col(version).alias("v")] if version else [])).where("key is not null and text is not null")
    if version:
        whole = rows.groupBy("key").agg(F.max_by(F.struct("text", "people"), F.struct(F.coalesce("v", F.lit("1900-01-01").cast("timestamp")), F.xxhash64("text", "people"))).alias("x"))
        rows = whole.select("key", "x.text", "x.people")
    return rows.mapInPandas(run, "key string, ordem bigint, inicio_char bigint, nome string, fala string")
