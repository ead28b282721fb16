"""Variant spellings of people's and organisations' names, linked.

1. Every distinct spelling becomes a vector of padded character n-grams of all words
   of the name, weighted by inverse document frequency over all spellings. N-grams
   are hashed into ``SLOTS`` slots, so the table of their weights has a size bound
   and can be broadcast whatever the corpus.
2. A distributed sparse join finds all pairs with a cosine of ``COSINE`` or more.
   Features are ordered from rare to common; a spelling is indexed only under its
   *prefix*, the features before the rest has a norm below ``COSINE``: two unit
   vectors that share no prefix feature cannot reach it. Spellings are dealt to
   blocks; a task joins a pair of blocks, and candidates never leave it, so what is
   moved is each vector once a block and the links. There is no cap on partners;
   ``nearest`` is the top-n view of the same pairs.
3. An exact check of the words follows and takes away pairs that contradict each
   other: words of both names that stand on the same side of the rarest shared word
   and match nothing. Words match if equal, a typing error or two apart, an initial,
   an abbreviation, or a pet name. No list of names is used: which word is the rare
   one comes from the weights, and which side it is on from the two spellings.
4. Spellings are grouped by average linkage of their cosines down to ``LINK``, where
   pairs that are apart or contradict each other count 0. It is done inside connected
   components; a component with more than ``COMPONENT`` spellings is merged in
   distributed rounds of nearest pairs until it has come apart into smaller ones,
   with the same result, so no task holds an unbounded group. Spellings with the
   same words are one from the start.

Defined results: null and blank names and those in ``NOBODY`` are no spellings;
repeated rows count once; a spelling that could be two persons goes to the closer
cluster (ties: the one with the smaller first spelling); an empty input gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tribuna.llm.canon import distance, folded
from tribuna.operators import cells
from tribuna.session import cut

GRAM = 4
COSINE = 0.35
LINK = 0.27
#: Slots for hashed n-grams and words: the bound on the table of weights.
SLOTS = 1 << 20
#: Spellings of one block, and how far running sums may be off.
BLOCK = 100_000
SLACK = 1e-5
#: Meetings of two features, and spellings of one side, that are looked at at once.
AT_ONCE = 1_000_000
ROWS = 64
COMPONENT = 1000
#: A similarity of 1 in the whole units that are summed.
UNITS = 10**9
#: Rounds of merging between two looks whether a large component has come apart.
ROUNDS = 4
#: How much the initial of a word says, against one n-gram.
INITIAL = 0.3

# What stands in a speaker field for a role or for nobody known.
NOBODY = (
    "PRESIDENTE", "PRESIDENTA", "VICE-PRESIDENTE", "VICE PRESIDENTE", "RELATOR", "RELATORA", "SECRETÁRIO", "SECRETÁRIA", "SECRETARIO", "SECRETARIA",
    "ORADOR", "ORADORA", "ORADOR NÃO IDENTIFICADO", "ORADORA NÃO IDENTIFICADA", "NÃO IDENTIFICADO", "NÃO IDENTIFICADA", "PARTICIPANTE", "PARTICIPANTE DA PLATEIA",
    "PLATEIA", "MODERADOR", "MODERADORA", "MEDIADOR", "MEDIADORA", "COORDENADOR", "COORDENADORA", "LOCUTOR", "LOCUTORA", "VOZ", "VOZ NÃO IDENTIFICADA", "INTÉRPRETE", "DESCONHECIDO", "DESCONHECIDA",
)
# Titles before names.
TITLES = frozenset("dr dra prof profa eng enga cel sr sra srs sras dep sen min ver des gen cap maj ten frei padre dom dona deputado deputada senador senadora ministro ministra vereador vereadora doutor doutora professor professora senhor senhora secretario secretaria relator relatora".split())
PARTICLES = frozenset("de da do dos das e".split())
# Portuguese pet names whose letters do not tell whose they are; the others follow from rules.
PET_NAMES = {
    "chico": "francisco", "chica": "francisca", "chiquinho": "francisco", "chiquinha": "francisca", "ze": "jose", "zeca": "jose", "zezinho": "jose", "juca": "jose", "quincas": "joaquim", "quinzinho": "joaquim",
    "bia": "beatriz", "tonho": "antonio", "toninho": "antonio", "toninha": "antonia", "totonho": "antonio", "tonico": "antonio", "cica": "cecilia", "lulu": "luis luisa lucia", "duda": "eduardo eduarda", "dede": "andre", "guga": "gustavo",
}


def spelling(c: Column) -> Column:
    """Upper case, trimmed, runs of white space as one blank; null if nothing is left or it names nobody."""
    text = F.nullif(F.upper(F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))), F.lit(""))
    return F.when(~text.isin(*NOBODY), text)


# -- reading a name -------------------------------------------------------------------


def sounded(word: str) -> str:
    """One way to write what sounds alike: ph, th, y, w and k as in today's spelling, doubled letters once."""
    for old, new in (("ph", "f"), ("th", "t"), ("y", "i"), ("w", "v"), ("k", "c")):
        word = word.replace(old, new)
    return re.sub(r"(.)\1+", r"\1", word)


@lru_cache(maxsize=200_000)
def words(text: str) -> tuple[str, ...]:
    """The words of a name in order, without titles, particles and acronyms; ``Last, First`` turned round. Initials are one letter."""
    s = folded(text)
    s = re.sub(r"\(\s*[^()]{2,8}\s*\)", " ", s)
    s = re.sub(r"^[a-z]{3,6}\s+-\s+", " ", s)
    before, comma, after = s.partition(",")
    if comma and after.strip():
        s = f"{after} {before}"
    # "E" is a particle, "E." an initial; an initial stays a capital until those are gone.
    found = [w[0].upper() if len(w) == 2 and w[1] == "." else w.rstrip(".") for w in re.findall(r"[a-z0-9]+\.?", s)]
    if found and len(found[0]) == 1:
        found[0] = found[0].upper()
    while len(found) > 1 and found[0] in TITLES:
        found = found[1:]
    kept = [sounded(w.lower()) for w in found if w not in PARTICLES]
    return tuple(kept or re.findall(r"[^\W_]+", s) or [s.strip()])


def grams(named: tuple[str, ...]) -> dict[str, float]:
    """Padded n-grams of every word, how often, and the words' initials."""
    out: Counter[str] = Counter()
    for w in named:
        out[f"^{w[:1]}"] += INITIAL
        if len(w) > 1:
            padded = f"^{w}$"
            for i in range(max(1, len(padded) - GRAM + 1)):
                out[padded[i : i + GRAM]] += 1
    return out


# -- whether two names contradict each other ------------------------------------------


DIMINUTIVE = re.compile(r"(?:zinh|inh)[oa]$")


def pet_name(short: str, name: str) -> bool:
    """Whether ``short`` can be a pet name of ``name``: in the table, a diminutive, a doubled syllable, or a shortened form."""
    if any(t[0] == name if len(name) == 1 else agree(t, name) >= 3 for t in PET_NAMES.get(short, "").split()):
        return True
    stem = DIMINUTIVE.sub("", short) if short[-3:-1] == "nh" else short
    half = len(stem) // 2
    if len(stem) >= 4 and len(stem) % 2 == 0 and stem[:half] == stem[half:]:
        stem = stem[:half]
    if stem != short and len(stem) > 1 and (stem in name or len(stem) > 3 and name.startswith(stem[:-2])):
        return True
    if len(short) >= len(name) or len(short) < 2:
        return False
    if name.startswith(short) or 3 <= len(short) <= len(name) - 2 and name.endswith(short):
        return True
    if 3 <= len(short) <= 5 and len(short) < len(name) - 1 and short[-1] == name[-1]:
        rest = iter(name)
        if all(c in rest for c in short):
            return True
    return 3 <= len(short) <= 4 and len(name) >= 5 and name[:2] == short[:2]


@lru_cache(maxsize=400_000)
def agree(a: str, b: str) -> int:
    """How well two words agree: 4 equal, 3 typing errors apart, 2 pet name or abbreviation, 1 initial, 0 not."""
    if a == b:
        return 4
    if len(a) == 1 or len(b) == 1:
        one, whole = (a, b) if len(a) == 1 else (b, a)
        return 1 if one == whole[:1] or whole in PET_NAMES and pet_name(whole, one) else 0
    short = min(len(a), len(b))
    if a[:-1] == b[:-1] and {a[-1], b[-1]} == {"a", "o"}:  # Márcia is not Márcio
        return 0
    # An error changes at most two letters of the sets; most pairs of other words end here.
    if short > 2 and abs(len(a) - len(b)) <= 2 and len(set(a) ^ set(b)) <= 4:
        d = distance(a, b)
        if d == 1 or d == 2 and short > 7:
            return 3
    return 2 if pet_name(a, b) or pet_name(b, a) else 0


def joined(x: list[str], y: list[str]) -> list[str]:
    """``x`` with neighbours put together that are one word of ``y``, but for a typing error."""
    out, i = [], 0
    while i < len(x):
        both = x[i] + x[i + 1] if i + 1 < len(x) else ""
        if len(both) > 5 and min(len(x[i]), len(x[i + 1])) > 1 and x[i] not in y and x[i + 1] not in y and any(abs(len(w) - len(both)) <= 1 and agree(w, both) >= 3 for w in y):
            out.append(both)
            i += 2
        else:
            out.append(x[i])
            i += 1
    return out


def parted(x: list[str], y: list[str]) -> list[str]:
    """``x`` with words taken apart that begin or end with a word of ``y`` (but for an error in a long one)."""
    out = []
    for w in x:
        for t in sorted((t for t in y if 3 <= len(t) <= len(w) - 3 and not re.fullmatch(r"z?inh[oa]", w[len(t) :])), key=len, reverse=True):
            head, tail = w[: len(w) - len(t)], w[len(w) - len(t) :]
            if w.startswith(t):
                out += [t, w[len(t) :]]
                break
            if tail == t or len(t) > 5 and agree(tail, t) >= 3:
                out += [head, tail]
                break
        else:
            out.append(w)
    return out


def compatible(x: tuple[str, ...], y: tuple[str, ...], weight: dict[str, float] | None = None) -> bool:
    """Whether two names, as words, can be the same one's. ``weight``: how rare each word is (without it, the longer the rarer)."""
    a, b = "".join(x), "".join(y)
    if a == b or len(x) != len(y) and len(a) > 9 and abs(len(a) - len(b)) <= 1 and agree(a, b) >= 3 and distance(a, b) == 1:
        return True
    p, q = joined(list(x), list(y)), joined(list(y), list(x))
    p, q = parted(p, q), parted(q, p)
    at = {}
    for level, _, i, j in sorted(((agree(v, w), -abs(i - j), -i, -j) for i, v in enumerate(p) for j, w in enumerate(q)), reverse=True):
        if level and -i not in at and -j not in at.values():
            at[-i] = -j
    # Words that are joined or taken apart here have no weight of their own: as rare as can be.
    rare = lambda v, w: min((weight or {}).get(v, math.inf), (weight or {}).get(w, math.inf))
    shared = [(rare(p[i], q[j]), len(p[i]), -i, -j) for i, j in at.items() if agree(p[i], q[j]) >= 3]
    if not shared:
        return False
    most, _, i, j = max(shared)
    i, j = -i, -j
    # An initial does not stand for a first word from the other side of the rare one.
    at = {k: m for k, m in at.items() if min(len(p[k]), len(q[m])) > 1 or k and m or not i or not j or (k < i) == (m < j)}
    sides = []
    for name, core, used in ((p, i, set(at)), (q, j, set(at.values()))):
        before, after = list(range(core)), list(range(core + 1, len(name)))
        if not before and after:  # the rare word first: the name is turned round
            before, after = [after[-1]], after[:-1]
        rarer = [k for k in range(len(name)) if k not in used and len(name[k]) > 3 and (weight or {}).get(name[k], 0) > most]
        sides.append([set(before) - used, set(after) - used, rarer])
    return not any(u and v for u, v in zip(*sides))


@lru_cache(maxsize=200_000)
def similarity(x: str, y: str) -> float:
    """How alike two spellings are, without a corpus: 0 for a contradiction, else from 0.5 to 1 with the cosine of their n-grams."""
    a, b = words(x), words(y)
    # Most pairs have no word in common, nor a beginning or end of one, which a plain look tells.
    if not any(len(v) > 1 and len(w) > 1 and (v[0] == w[0] or v[-1] == w[-1]) and agree(v, w) for v in a for w in b) or not compatible(a, b):
        return 0.0
    u, v = grams(a), grams(b)
    dot = sum(n * v.get(g, 0.0) for g, n in u.items())
    return 0.5 + 0.5 * min(1.0, dot / math.sqrt(sum(n * n for n in u.values()) * sum(n * n for n in v.values())))


def units(s: float) -> int:
    """A similarity in whole units, whose sums are exact in any order."""
    return round(s * UNITS)


def merged(total: np.ndarray, size: np.ndarray, least: float = LINK) -> list[int]:
    """Average linkage of groups in order: ``total`` has the sums of similarities between them, in units. The first group of each one's cluster."""
    total, size, least = total.copy(), size.astype(float), least * UNITS
    mean = total / np.outer(size, size)
    np.fill_diagonal(mean, -1)
    best, label = mean.argmax(1), np.arange(len(size))
    top = mean[label, best]
    while len(size) > 1:
        p = int(top.argmax())
        if top[p] < least:
            break
        q = int(best[p])
        total[p] += total[q]
        total[:, p] = total[p]
        size[p] += size[q]
        label[label == q] = p
        new = total[p] / (size[p] * size)
        new[mean[p] < 0] = -1  # itself and what has gone
        mean[p], mean[:, p] = new, new
        mean[q], mean[:, q], top[q] = -1, -1, -1
        for r in np.flatnonzero(((best == p) | (best == q) | (np.arange(len(size)) == p)) & (top >= 0)):
            best[r] = mean[r].argmax()
            top[r] = mean[r, best[r]]
    return label.tolist()


# -- the distributed part -------------------------------------------------------------


def _slot(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")


def read(spellings: DataFrame) -> DataFrame:
    """(id, nome, palavras) of (id, nome)."""

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(palavras=[list(words(t)) for t in pdf["nome"]])

    return spellings.select("id", "nome").mapInPandas(told, "id bigint, nome string, palavras array<string>")


def vectors(nodes: DataFrame) -> DataFrame:
    """(id, palavras, raro, v): the words of each name, how rare each is, and its unit vector, the rarest feature first."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(i, -1, f"g{g}", n) for i, w in zip(pdf["id"], pdf["palavras"]) for g, n in grams(tuple(w)).items()]
            found += [(i, k, f"w{t}", 0.0) for i, w in zip(pdf["id"], pdf["palavras"]) for k, t in enumerate(w)]
            yield pd.DataFrame(found, columns=["id", "k", "f", "n"])

    rows = cut(nodes.select("id", "palavras").mapInPandas(cut_up, "id bigint, k int, f string, n double").withColumn("g", _slot("f")).drop("f"))
    total = F.lit(float(nodes.count()))  # one number
    often = rows.groupBy("g", "id").agg(F.lit(1).alias("one")).groupBy("g").agg(F.count("*").alias("df"))
    # At most SLOTS rows, whatever the corpus.
    rows = rows.join(F.broadcast(often.select("g", F.log(1 + total / F.col("df")).alias("rare"))), "g")
    found = rows.groupBy("id").agg(F.collect_list(F.struct("k", "g", "rare", "n")).alias("x"))
    grown = F.aggregate("x", F.lit(0.0), lambda s, e: s + F.pow(e["rare"] * e["n"], F.lit(2)), lambda s: F.sqrt(s))
    vector = F.transform(F.filter("x", lambda e: e["k"] < 0), lambda e: F.struct(e["rare"].alias("rare"), e["g"].alias("g"), (e["rare"] * e["n"] / F.col("norm")).alias("w")))
    known = F.transform(F.array_sort(F.filter("x", lambda e: e["k"] >= 0)), lambda e: e["rare"])
    found = found.withColumn("norm", grown).select("id", known.alias("raro"), F.sort_array(vector, asc=False).alias("v"))
    return nodes.select("id", "nome", "palavras").join(found, "id")


class _Side:
    """Vectors of some spellings as flat arrays: features ``g`` and weights ``w`` of ``row``, the norms from each feature on and behind it."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        t = pa.Table.from_batches(batches).combine_chunks()
        self.ids = t["id"].to_numpy()
        self.words, self.rare = t["palavras"], t["raro"]
        flat = lambda c, kind: np.concatenate([np.asarray(x.flatten(), kind) for x in t[c].chunks])
        self.g, self.w = flat("g", np.int64), flat("w", float)
        n = pc.list_value_length(t["g"]).to_numpy()
        self.row, self.end = np.repeat(np.arange(len(n)), n), n.cumsum()
        upto = (self.w * self.w).cumsum()
        last = np.concatenate([upto, [0.0]])[np.repeat(self.end, n) - 1]
        self.behind = np.sqrt(np.maximum(last - upto, 0))
        self.norm = np.sqrt(last - upto + self.w * self.w)

    def told(self, rows: np.ndarray) -> dict[int, tuple[tuple[str, ...], tuple[float, ...]]]:
        """The words and how rare they are of some rows."""
        rows = np.unique(rows)
        return dict(zip(rows.tolist(), zip(map(tuple, self.words.take(rows).to_pylist()), map(tuple, self.rare.take(rows).to_pylist()))))


def _cell(index: _Side, cosine: float, same: bool) -> Callable[[_Side], Iterator[pa.RecordBatch]]:
    """The links of the spellings of a batch to those of ``index``; ``same``: both are of one block, each pair counts once."""
    # Sums of squares are differences of running sums here; the exact cosine decides behind this.
    low = cosine - SLACK
    keep = np.flatnonzero(index.norm >= low)
    # By feature and, in it, by falling norm from it on: who reaches the bound with another norm comes first.
    keep = keep[np.argsort(2.0 * index.g[keep] + 1 - index.norm[keep])]
    place, row, w, behind = 2.0 * index.g[keep] + 1 - index.norm[keep], index.row[keep], index.w[keep], index.behind[keep]
    m = len(index.ids)
    slots = np.unique(index.g)
    wide = int(np.diff(index.end, prepend=0).max(initial=0))
    at = np.arange(len(index.g)) - np.repeat(index.end - np.diff(index.end, prepend=0), np.diff(index.end, prepend=0))
    # The vectors as a matrix, with a slot of weight 0 behind the last.
    G, W = np.full((m, wide), len(slots), np.int32), np.zeros((m, wide))
    G[index.row, at], W[index.row, at] = np.searchsorted(slots, index.g), index.w

    def links(side: _Side) -> Iterator[pa.RecordBatch]:
        use = np.flatnonzero(side.norm >= low)
        lo = np.searchsorted(place, 2.0 * side.g[use])
        hi = np.searchsorted(place, 2.0 * side.g[use] + 1 - low / side.norm[use] + SLACK, "right")
        n = np.maximum(hi - lo, 0)
        begin = 0
        # So many rows at once as meet a bounded number of others, one at least.
        met = np.concatenate([[0], np.bincount(side.row[use], weights=n, minlength=len(side.ids)).cumsum()])
        most = max(1, min(ROWS, 4_000_000 // (len(slots) + 1)))
        while begin < len(side.ids):
            stop = min(max(begin + 1, int(np.searchsorted(met, met[begin] + AT_ONCE, "right")) - 1), begin + most, len(side.ids))
            k = slice(*np.searchsorted(side.row[use], [begin, stop]))
            i = np.repeat(use[k], n[k])
            j = np.arange(len(i)) + np.repeat(lo[k] - (n[k].cumsum() - n[k]), n[k])
            if same:
                one = side.ids[side.row[i]] < index.ids[row[j]]
                i, j = i[one], j[one]
            # From their first common feature on, two vectors share no more than the product of what is left of both. Those that
            # pass are the first common features of a pair; what follows the last of them is bounded by the norms behind it.
            pair = side.row[i] * m + row[j]
            order = np.argsort(pair)
            pair, i, j = pair[order], i[order], j[order]
            first = np.flatnonzero(np.diff(pair, prepend=-1))
            if len(first):
                sure = np.add.reduceat(side.w[i] * w[j], first) + np.minimum.reduceat(side.behind[i] * behind[j], first)
                pair = pair[first][sure >= low]
                yield from checked(side, begin, stop, pair // m, pair % m)
            begin = stop

    def checked(side: _Side, begin: int, stop: int, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = np.flatnonzero((side.row >= begin) & (side.row < stop))
        to = np.searchsorted(slots, side.g[own])
        known = slots[np.minimum(to, len(slots) - 1)] == side.g[own]
        dense = np.zeros((stop - begin, len(slots) + 1))
        dense[side.row[own][known] - begin, to[known]] = side.w[own][known]
        some = [slice(c, c + 20_000) for c in range(0, len(x), 20_000)]
        s = np.concatenate([np.zeros(0), *((dense[x[c, None] - begin, G[y[c]]] * W[y[c]]).sum(1) for c in some)])
        near = s >= cosine
        x, y, s = x[near], y[near], np.minimum(s[near], 1.0)
        p, q = side.told(x), index.told(y)
        keep = []
        for a, b in zip(x.tolist(), y.tolist()):
            (u, ru), (v, rv) = sorted((p[a], q[b]))
            keep.append(compatible(u, v, dict(zip((*u, *v), (*ru, *rv)))))
        keep = np.array(keep, bool)
        a, b = side.ids[x[keep]], index.ids[y[keep]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(s[keep])], ["a", "b", "s"])

    return links


def edges(nodes: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """Pairs of names (id, nome, palavras) with at least this cosine that do not contradict each other: (a, b, s).

    Spellings are dealt to blocks, and each pair of blocks is a cell, in which all pairs are found, held against the
    exact cosine and the words, and left out again: only links leave it. A pair that is not linked is never moved.
    """
    rows = vectors(nodes).select("id", "palavras", "raro", F.col("v.g").alias("g"), F.col("v.w").alias("w"))

    def make(held: list[pa.RecordBatch], same: bool) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        links = _cell(_Side(held), cosine, same)
        return lambda batch: links(_Side([batch]))

    return cells.pairs(rows, "id", max(cells.BLOCKS, -(-nodes.count() // block)), make, "a bigint, b bigint, s double")


def nearest(links: DataFrame, n: int) -> DataFrame:
    """The ``n`` nearest of each name by cosine (ties: the smaller id): (id, outro, s)."""
    both = links.select(F.col("a").alias("id"), F.col("b").alias("outro"), "s").unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("outro"), "s"))
    return both.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("s"), "outro"))).where(F.col("n") <= n).drop("n")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, comp): connected components by the least id, with pointer jumping; every round is cut off."""
    both = _cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    now = _cut(nodes.select("id", F.col("id").alias("comp")))
    while True:
        around = both.join(now.select(F.col("id").alias("b"), F.col("comp").alias("c")), "b").groupBy(F.col("a").alias("id")).agg(F.min("c").alias("c"))
        nxt = now.join(around, "id", "left").select("id", F.least("comp", F.coalesce("c", "comp")).alias("comp"), F.col("comp").alias("old"))
        up = nxt.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        nxt = _cut(nxt.join(up, "comp").select("id", F.col("up").alias("comp"), "old"))
        changed = nxt.where("comp <> old").limit(1).count()
        now = nxt.select("id", "comp")
        if not changed:
            return now


def _cut(df: DataFrame) -> DataFrame:
    """Cut without the estimates of size that a checkpoint still carries: products of products, they take longer from round to round than the work."""
    kept = cut(df)
    spark = kept.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(kept._jdf.toJavaRDD(), kept._jdf.schema()), spark)


def _round(links: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """One round of average linkage at once everywhere: the links after it, and which group went into which.

    Two groups that are each other's nearest stay so whatever else merges, as a mean is never above the larger of
    the two it comes from; so the order of the merges, one by one or in rounds, makes no difference.
    """
    near = F.struct(-F.col("t") / (F.col("na") * F.col("nb")), F.least("xa", "xb"), F.greatest("xa", "xb")).cast("struct<far:double,lo:string,hi:string>")
    both = links.withColumn("near", near).where(F.col("near.far") <= -least * UNITS)
    # Who has no link this near cannot be the nearest of another one.
    nearest = both.select(F.explode(F.array("a", "b")).alias("id"), "near", "a", "b", "na", "nb", "xa").groupBy("id").agg(F.min_by(F.struct("near", "a", "b", "na", "nb", "xa"), "near").alias("best")).select("best.*")
    pairs = nearest.groupBy("a", "b").agg(F.count("*").alias("k"), *(F.first(c).alias(c) for c in ("near", "na", "nb", "xa"))).where("k = 2")
    first = F.col("xa") == F.col("near.lo")
    gone = pairs.select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("id"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("to"), F.col("near.lo").alias("x"), (F.col("na") + F.col("nb")).alias("n"))
    gone = _cut(gone)
    moved = gone.unionByName(gone.select(F.col("to").alias("id"), "to", "x", "n"))
    for c in "ab":
        links = links.join(moved.select(F.col("id").alias(c), "to", "x", "n"), c, "left")
        links = links.select(F.coalesce("to", c).alias(c), F.coalesce("x", f"x{c}").alias(f"x{c}"), F.coalesce("n", f"n{c}").alias(f"n{c}"), *(x for x in links.columns if x not in (c, f"x{c}", f"n{c}", "to", "x", "n")))
    turned = F.col("a") > F.col("b")
    ordered = links.where("a <> b").select("t", *(F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("xa", "xb"), ("xb", "xa"), ("na", "nb"), ("nb", "na"))))
    return _cut(ordered.groupBy("a", "b").agg(F.sum("t").alias("t"), *(F.first(c).alias(c) for c in ("xa", "xb", "na", "nb")))), gone.select("id", "to")


def linked(nodes: DataFrame, links: DataFrame, least: float = LINK, most: int = COMPONENT) -> DataFrame:
    """(id, grupo) of the groups (id, nome, n) that are linked: average linkage over their similarities (a, b, s), where those not given are 0."""
    ends = [nodes.select(F.col("id").alias(c), F.col("nome").alias(f"x{c}"), F.col("n").alias(f"n{c}")) for c in "ab"]
    links = links.join(ends[0], "a").join(ends[1], "b").withColumn("t", F.round(F.col("s") * UNITS).cast("bigint") * F.col("na") * F.col("nb")).drop("s")
    links, now, done = _cut(links), nodes.select("id", F.col("id").alias("grupo")), None

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for ids, sizes, a, b, t in pdf[["ids", "sizes", "a", "b", "t"]].itertuples(index=False):
                at = {x: i for i, x in enumerate(ids)}
                total = np.zeros((len(ids), len(ids)))
                for x, y, s in zip(a, b, t):
                    total[at[x], at[y]] = total[at[y], at[x]] = s
                out += [(x, ids[m]) for x, m in zip(ids, merged(total, np.array(sizes), least))]
            yield pd.DataFrame(out, columns=["grupo", "to"])

    while True:
        # No groups merge but along links whose mean is high enough, now or after other merges.
        live = links.where(F.col("t") / (F.col("na") * F.col("nb")) >= least * UNITS)
        ends = live.select(F.explode(F.array(*(F.struct(F.col(c).alias("id"), F.col(f"x{c}").alias("nome"), F.col(f"n{c}").alias("n")) for c in "ab"))).alias("e")).select("e.*").distinct()
        comp = components(ends, live)
        named = _cut(comp.join(comp.groupBy("comp").agg(F.count("*").alias("k")), "comp").join(ends, "id").withColumnRenamed("id", "grupo"))
        inside = links.join(named.select(F.col("grupo").alias("a"), F.col("comp").alias("ca"), "k"), "a").join(named.select(F.col("grupo").alias("b"), "comp"), "b").where("ca = comp").drop("ca")
        # One row a component, of at most ``most`` groups, spread over all tasks.
        members = named.where(F.col("k") <= most).groupBy("comp").agg(F.sort_array(F.collect_list(F.struct("nome", "grupo", "n"))).alias("m"))
        bonds = inside.where(F.col("k") <= most).groupBy("comp").agg(*(F.collect_list(c).alias(c) for c in ("a", "b", "t")))
        small = members.join(bonds, "comp").select("comp", F.col("m.grupo").alias("ids"), F.col("m.n").alias("sizes"), "a", "b", "t")
        ready = small.repartition(int(small.sparkSession.conf.get("spark.sql.shuffle.partitions")), "comp").mapInPandas(finish, "grupo bigint, to bigint")
        large = named.where(F.col("k") > most).select("grupo")
        rest = now.join(large, "grupo", "left_anti").join(ready, "grupo", "left").select("id", F.coalesce("to", "grupo").alias("grupo"))
        done = rest if done is None else done.unionByName(rest)
        if large.limit(1).count() == 0:
            return done
        links, now = _cut(inside.where(F.col("k") > most).drop("comp", "k")), now.join(large, "grupo", "left_semi")
        for _ in range(ROUNDS):
            links, gone = _round(links, least)
            now = _cut(now.join(gone.withColumnRenamed("id", "grupo"), "grupo", "left").select("id", F.coalesce("to", "grupo").alias("grupo")))


def alike(spellings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The spellings with their words as ``parts``, and one node (id, nome, palavras, n) for each distinct sequence of words."""
    rows = cut(read(spellings).withColumn("parts", F.to_json("palavras")))
    first = cut(rows.groupBy("parts").agg(F.min(F.struct("nome", "id", "palavras")).alias("first"), F.count("*").alias("n")))
    return rows, first.select("first.id", "first.nome", "first.palavras", "n", "parts")


def clusters(spellings: DataFrame, cosine: float = COSINE, least: float = LINK, most: int = COMPONENT, block: int = BLOCK) -> DataFrame:
    """(id, nome, grupo) of every spelling: ``grupo`` is the id of one member of its cluster."""
    rows, nodes = alike(spellings)
    groups = linked(nodes.select("id", "nome", "n"), cut(edges(nodes, cosine, block)), least, most)
    found = nodes.select("parts", F.col("id").alias("first")).join(groups.withColumnRenamed("id", "first"), "first")
    return rows.join(found, "parts").select("id", "nome", "grupo")


def spellings(columns: list[DataFrame]) -> DataFrame:
    """Distinct spellings of some one-column tables: (id, nome)."""
    out = None
    for df in columns:
        part = df.select(spelling(F.col(df.columns[0])).alias("nome")).where("nome is not null").distinct()
        out = part if out is None else out.unionByName(part)
    return out.distinct().select(F.xxhash64("nome").alias("id"), "nome")


def pairs(grouped: DataFrame) -> DataFrame:
    """All pairs of spellings inside each cluster, nome_a < nome_b by code points."""
    x, y = grouped.select("grupo", F.col("nome").alias("nome_a")), grouped.select("grupo", F.col("nome").alias("nome_b"))
    return x.join(y, "grupo").where("nome_a < nome_b").select("nome_a", "nome_b")
