"""Free-entered values mapped to the entries of a reference list.

Reference entries are expanded into the forms people type (genders, short forms,
synonyms) and held in a BK-tree under the unrestricted Damerau-Levenshtein
distance, which is a true metric, so the triangle inequality prunes whole
branches and a search returns every form within its radius. A list longer than
``SHARD`` forms becomes several trees; each value passes every shard and the
winners merge, with the same result as one tree.

Values are matched once each (distinct), in buckets; the mapping then joins back to
the rows, so a value that holds a third of all rows is matched once.

Defined results: null and blank values are left out; a value with no form within
its radius has ref_id -1, and so has one that ties between two entries; values
are reported as stored; repeated rows count once; an empty reference list maps
everything to -1.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tribuna.session import cut

#: Forms in a tree, and values that pass it in one task.
SHARD, BUCKET = 50_000, 5_000


def distance(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance (a true metric)."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if not n or not m:
        return n + m
    far = n + m
    seen: dict[str, int] = {}
    rows = [[far] * (m + 2), [far, *range(m + 1)]]
    for i in range(1, n + 1):
        row, above, ca, match = [far, i] + [0] * m, rows[i], a[i - 1], 0
        for j in range(1, m + 1):
            k = seen.get(b[j - 1], 0)
            same = ca == b[j - 1]
            best = above[j] if same else above[j] + 1
            if row[j] + 1 < best:
                best = row[j] + 1
            if above[j + 1] + 1 < best:
                best = above[j + 1] + 1
            if k and match:
                swap = rows[k][match] + (i - k - 1) + 1 + (j - match - 1)
                if swap < best:
                    best = swap
            if same:
                match = j
            row[j + 1] = best
        seen[ca] = i
        rows.append(row)
    return rows[-1][-1]


class Tree:
    """A BK-tree from forms to entries."""

    def __init__(self, forms: Iterable[tuple[str, int]]) -> None:
        self.root: tuple[str, set[int], dict] | None = None
        self.nodes: dict[str, set[int]] = {}
        for form, entry in forms:
            self.add(form, entry)

    def add(self, form: str, entry: int) -> None:
        if form in self.nodes:
            self.nodes[form].add(entry)
            return
        self.nodes[form] = {entry}
        node = (form, self.nodes[form], {})
        if self.root is None:
            self.root = node
            return
        at = self.root
        while True:
            d = distance(form, at[0])
            nxt = at[2].get(d)
            if nxt is None:
                at[2][d] = node
                return
            at = nxt

    def within(self, value: str, radius: int) -> list[tuple[int, str, set[int]]]:
        """Every form within the radius."""
        out, todo = [], [self.root] if self.root else []
        while todo:
            form, entries, children = todo.pop()
            d = distance(value, form)
            if d <= radius:
                out.append((d, form, entries))
            todo.extend(child for edge, child in children.items() if d - radius <= edge <= d + radius)
        return out


# -- how people type ------------------------------------------------------------------


def mended(s: str) -> str:
    """UTF-8 that was read as Latin-1 or Windows-1252, read right."""
    if "Ã" in s or "Â" in s:
        for code in ("cp1252", "latin-1"):
            try:
                return s.encode(code).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
        # Mixed text: mend the pairs one by one.
        return re.sub("[ÂÃ][\x80-\xbf]", lambda m: m.group().encode("latin-1").decode("utf-8", "replace"), s)
    return s


def folded(s: str) -> str:
    """Mended, without accents, lower case, blanks collapsed."""
    s = unicodedata.normalize("NFKD", mended(s))
    return " ".join("".join(c for c in s if not unicodedata.combining(c)).lower().split())


def plain(s: str) -> str:
    """Folded, dots dropped, everything else that is no letter or digit a blank."""
    return " ".join(re.sub(r"[^a-z0-9]+", " ", folded(s).replace(".", "").replace("ª", "a").replace("º", "o")).split())


# What people call the offices besides their names and the abbreviations of those, by the canonical label.
SYNONYMS = {
    "Deputado(a)": "deputado federal|deputada federal|dep federal|parlamentar deputado|parlamentar deputada|parlamentar",
    "Senador(a)": "senador da republica|senadora da republica",
    "Vereador(a)": "vereador municipal|vereadora municipal|edil",
    "Ministro(a) de Estado": "ministro|ministra",
    "Secretário(a) Municipal": "secretario do municipio|secretaria do municipio",
    "Secretário(a) Estadual": "secretario de estado|secretaria de estado|secretario do estado|secretaria do estado",
    "Professor(a) Universitário(a)": "prof|profa|professor|professora|docente universitario|docente universitaria|docente",
    "Pesquisador(a)": "pesquisador associado|pesquisadora associada|cientista pesquisador|cientista pesquisadora|cientista",
    "Advogado(a)": "advogado trabalhista|advogada trabalhista|causidico|causidica",
    "Promotor(a) de Justiça": "promotor|promotora",
    "Defensor(a) Público(a)": "defensor|defensora|defensoria publica defensor|defensoria publica defensora|defensoria publica",
    "Juiz(a) de Direito": "juiz|juiza|magistrado|magistrada",
    "Médico(a)": "medico clinico|medica clinica|medico sanitarista|medica sanitarista",
    "Enfermeiro(a)": "enfa|enfermeiro chefe|enfermeira chefe",
    "Engenheiro(a) Civil": "enga civil|engenheiro|engenheira|eng|enga",
    "Economista": "economista chefe|economista senior",
    "Jornalista": "reporter|jornalista responsavel",
    "Presidente de Associação": "presidenta de associacao",
    "Diretor(a) de Sindicato": "dirigente sindical|diretor sindical|diretora sindical",
    "Agricultor(a) Familiar": "agricultor|agricultora|pequeno agricultor|pequena agricultora",
    "Empresário(a)": "dono de empresa|dona de empresa",
    "Estudante": "aluno|aluna|estudante de graduacao",
    "Líder Comunitário(a)": "lider da comunidade|lideranca comunitaria",
    "Delegado(a) de Polícia": "delegado|delegada",
    "Auditor(a) Fiscal": "fiscal auditor|fiscal auditora|auditor|auditora",
    "Analista de Sistemas": "analista de ti",
    "Psicólogo(a)": "psicologo clinico|psicologa clinica",
    "Motorista Profissional": "motorista|caminhoneiro|caminhoneira",
    "Técnico(a) Esportivo(a)": "treinador|treinadora",
    "Produtor(a) Cultural": "produtor de cultura|produtora de cultura",
    "Procurador(a) da Fazenda": "procurador|procuradora",
    "Nutricionista": "nutricionista escolar",
    "Geólogo(a)": "geologo de campo|geologa de campo",
}
# Other ways to write the affiliation of those without a party.
CIVIL_FORMS = "sociedade outros|sociedade|outros|sociedade civil|soc civil|soc outros|outros sociedade|sociedade e outros|sociedade civil e outros"
# The states of Brazil.
STATES = frozenset("ac al am ap ba ce df es go ma mg ms mt pa pb pe pi pr rj rn ro rr rs sc se sp to".split())
# Details behind an office that do not change it.
DETAIL = re.compile(
    r"(?:\s*/\s*(?:titular|suplente|convidad[oa])|\s*\((?:licenciad[oa]|a confirmar)\)|\s*,\s*\d+\s*[ºªo]?\s*mandato|\s+(?:substitut[oa]|aposentad[oa]|em exercicio|licenciad[oa])"
    r"|\s*\(\s*[a-z]{3,6}\s*[-/]\s*[a-z]{2}\s*\)|\s+-\s+[a-z]{3,6}\s*/\s*[a-z]{2}|\s*\?)$"
)
CUT = re.compile(r"\s*[/(,;]\s*|\s+[-–—]\s+|\s+(?=d[aeo]s?\s)")


def shortened(form: str) -> set[str]:
    """A form with each of its words whole or cut to its first 3 to 6 letters, and with its particles kept, changed or left out."""
    done = {""}
    for w in form.split():
        if w in ("de", "do", "da", "dos", "das"):
            ways = {"", "de", "do", "da"} if done != {""} else {w}
        else:
            ways = {w, *(w[:n] for n in (3, 4, 5, 6) if n < len(w) - 1)}
            if w.endswith("s"):
                ways.add(w[:-1])
            elif len(w) > 4:
                ways.add(w + "s")
        done = {f"{x} {y}".strip() for x in done for y in ways}
    return done


def office_forms(label: str, _: str | None) -> list[str]:
    """The label in either gender, its abbreviations, and what else people call it."""
    male, female = re.sub(r"\(a\)", "", label), re.sub(r"(?<=r)\(a\)|(?<=z)\(a\)", "a", label)
    female = re.sub(r"o\(a\)", "a", female)
    own = {plain(x) for x in (male, female)}
    other = {x for x in SYNONYMS.get(label, "").split("|") if x}
    # The first word alone, where that is what people say, is abbreviated too.
    own |= other & {x.split()[0] for x in own}
    return sorted({y for x in own for y in shortened(x)} | other)


def party_forms(label: str, long: str | None) -> list[str]:
    """Acronym, long name, and the long name without its first word; the civil catch-all has forms of its own."""
    if "/" in label:
        return [plain(label), *CIVIL_FORMS.split("|")]
    name = plain(long or "")
    rest = name.partition(" ")[2]
    return [x for x in (plain(label), name, rest, f"partido {rest}" if rest else "", f"partido {plain(label)}") if x]


def office_readings(value: str) -> Iterator[str]:
    """Readings of a typed office, the fullest first."""
    s = folded(value).rstrip(" .")
    yield plain(s)
    for _ in range(4):
        shorter = DETAIL.sub("", s).rstrip(" .")
        if shorter == s:
            break
        s = shorter
        yield plain(s)
    words = s.split()
    if len(words) > 2 and words[-1] in STATES and re.fullmatch(r"[a-z]{4,5}", words[-2]):
        s = " ".join(words[:-2])
        yield plain(s)
        s = DETAIL.sub("", s).rstrip(" .")
        yield plain(s)
    for m in reversed(list(CUT.finditer(s))):
        head = DETAIL.sub("", s[: m.start()]).rstrip(" .")
        yield plain(head)


def party_readings(value: str) -> Iterator[str]:
    """Readings of a typed affiliation, the fullest first."""
    s = folded(value)
    yield plain(s)
    inner = re.fullmatch(r"\(?\s*(.*?)\s*\)?", s).group(1)
    inner = re.sub(r"(?<=\w)\.(?=\w)|\.$", "", inner)
    inner = re.sub(r"^(?:bloco|lider d[aoe]|bancada d[aoe]|part)\.?\s+", "", inner).strip()
    yield plain(inner)
    m = re.fullmatch(r"(.*?)\s*[-/ ]\s*([a-z]{2})", inner)
    if m and m.group(2) in STATES:
        yield plain(m.group(1))
    m = re.fullmatch(r"(.+?)\s*\(\s*(\w+)\s*\)", s)
    if m:
        yield plain(m.group(2))
        yield plain(m.group(1))
    m = re.fullmatch(r"(\w+)\s+[-–]\s+(.{4,})", s)
    if m:
        yield plain(m.group(1))
        yield plain(m.group(2))
    if re.fullmatch(r"[a-z](?: [a-z]+)+", plain(inner)) and len(inner) < 9:
        yield plain(inner).replace(" ", "")


def radius(reading: str) -> int:
    """How far a form may be: short ones are exact."""
    return 0 if len(reading) < 6 else 1 if len(reading) < 16 else 2


def first_hit(tree: Tree, readings: Iterable[str]) -> tuple[int, int, int, list[int]] | None:
    """(0 exact or 1 near, rank of the reading, distance, entries) of the first reading with a form in the tree: exact ones first, then all within the radius."""
    listed = [x for x in dict.fromkeys(readings) if x]
    for wide in (0, 1):
        for rank, reading in enumerate(listed):
            found = tree.within(reading, radius(reading)) if wide else [(0, reading, tree.nodes[reading])] if reading in tree.nodes else []
            if found:
                least = min(d for d, _, _ in found)
                return wide, rank, least, sorted(set().union(*(e for d, _, e in found if d == least)))
    return None


def match(values: DataFrame, column: str, forms: DataFrame, readings: Callable[[str], Iterable[str]], shard: int = SHARD, bucket: int = BUCKET) -> DataFrame:
    """The entry of each distinct non-blank value: (valor, ref_id); ``forms`` are (forma, ref_id).

    Forms go to shards of about ``shard``, values to buckets of about ``bucket``, both by hash, and every bucket meets
    every shard in a task of its own, so neither side passes the driver and no task holds either whole. A shard returns
    all entries at the least distance of its first reading that hits; what ties is decided only over all shards.
    """
    distinct = cut(values.select(F.col(column).alias("valor")).where(r"valor is not null and valor rlike '(?U)[^\\s\\x1c-\\x1f]'").distinct())
    forms = cut(forms.select("forma", "ref_id").where("forma is not null and ref_id is not null").distinct())
    shards = max(1, -(-forms.count() // shard))
    buckets = max(1, -(-distinct.count() // bucket))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = distinct.withColumn("bucket", F.pmod(F.xxhash64("valor"), F.lit(buckets)).cast("int")).withColumn("shard", every(shards))
    right = forms.withColumn("shard", F.pmod(F.xxhash64("forma"), F.lit(shards)).cast("int")).withColumn("bucket", every(buckets))

    def search(vals: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(zip(part["forma"], part["ref_id"])) if len(vals) else Tree([])
        found = [(v, first_hit(tree, readings(v))) for v in vals["valor"]]
        return pd.DataFrame([(v, *h) for v, h in found if h], columns=["valor", "perto", "vez", "d", "entradas"])

    hits = left.groupBy("shard", "bucket").cogroup(right.groupBy("shard", "bucket")).applyInPandas(search, "valor string, perto int, vez int, d int, entradas array<bigint>")
    best = hits.groupBy("valor").agg(F.min(F.struct("perto", "vez", "d")).alias("b"), F.collect_list(F.struct("perto", "vez", "d", "entradas")).alias("h"))  # one hit a shard
    entries = F.array_distinct(F.flatten(F.transform(F.filter("h", lambda x: (x["perto"] == F.col("b.perto")) & (x["vez"] == F.col("b.vez")) & (x["d"] == F.col("b.d"))), lambda x: x["entradas"])))
    decided = best.select("valor", F.when(F.size(entries) == 1, entries[0]).otherwise(F.lit(-1)).cast("bigint").alias("ref_id"))
    return distinct.join(decided, "valor", "left").select("valor", F.coalesce("ref_id", F.lit(-1).cast("bigint")).alias("ref_id"))


def expand(entries: DataFrame, forms: Callable[[str, str | None], list[str]]) -> DataFrame:
    """(forma, ref_id) of all reference entries (ref_id, rotulo, descricao), made where they are; a form that two entries share keeps both and so ties."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, i) for i, label, long in zip(pdf["ref_id"], pdf["rotulo"], pdf["descricao"]) for f in forms(label, long if isinstance(long, str) else None) if f]
            yield pd.DataFrame(rows, columns=["forma", "ref_id"])

    return entries.where("ref_id is not null and rotulo is not null").select(F.col("ref_id").cast("bigint").alias("ref_id"), "rotulo", "descricao").mapInPandas(run, "forma string, ref_id bigint").distinct()
