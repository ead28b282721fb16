"""The alignment graph of speakers: nodes, edges with three counters, their classes."""

from __future__ import annotations

import bisect
import copy
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tribuna import schema
from tribuna.operators import cells

#: Speakers or classes of one block, the least number of blocks, those of one tile, and edges that are given out at once.
BLOCK = 100_000
BLOCKS = 8
TILE = 1024
AT_ONCE = 1 << 18
EDGE = ["a", "b", "n_a", "n_b", "concordancia", "discordancia", "neutro"]


def valid(df: DataFrame) -> DataFrame:
    """Rows with one of the three stances; failures and nulls are left out."""
    return df.where(F.col("postura_final").isin(*schema.VALID))


def nodes(df: DataFrame, order: str) -> DataFrame:
    """One node a speaker; the affiliation of the last row wins."""
    # Nulls do not name anybody, and the order column decides between repeated rows.
    last = df.where(F.col("nome").isNotNull()).groupBy("nome").agg(F.max_by(F.struct("filiacao_rede"), F.col(order)).alias("x")).select("nome", F.col("x.filiacao_rede").alias("group"))
    colours = F.create_map(*[F.lit(x) for pair in schema.COLOURS.items() for x in pair])
    shown = F.coalesce("group", F.lit("nan"))
    return last.select("nome", "group", F.coalesce(F.element_at(colours, F.coalesce("group", F.lit(""))), F.lit(schema.OTHER_COLOUR)).alias("color"), F.concat("nome", F.lit("\n("), shown, F.lit(")")).alias("label"), F.concat("nome", F.lit(" - "), shown).alias("title"), F.lit(15).cast("bigint").alias("size"))


def counts(df: DataFrame) -> DataFrame:
    """Rows of each speaker on each proposition by stance: proposicao_alvo, nome, f, c, z."""
    rows = valid(df).where("proposicao_alvo is not null and nome is not null")
    of = lambda s: F.count_if(F.col("postura_final") == s)
    return rows.groupBy("proposicao_alvo", "nome").agg(of(schema.FOR).alias("f"), of(schema.AGAINST).alias("c"), of(schema.NEUTRAL).alias("z"))


def classes(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Speakers who said the same on the same propositions are one class: members (nome, classe) and profiles (classe, n, first member, proposicao, f, c, z).

    Two members of a class have the same edge with everybody, so edges between classes lose nothing. On a
    proposition that a third of all rows share, those who speak nowhere else fall into a few classes.
    """
    # A profile as 128 bits that come out alike in any order, so no speaker's history is gathered in a row.
    bits = [F.bit_xor(F.xxhash64("proposicao_alvo", "f", "c", "z", F.lit(seed))) for seed in (1, 2)]
    members = counted.groupBy("nome").agg(F.concat_ws("-", F.hex(bits[0]), F.hex(bits[1]), F.count("*").cast("string")).alias("classe"))
    size = members.groupBy("classe").agg(F.count("*").alias("n"), F.min("nome").alias("primeiro"))
    # Hashed before the join, which else moves the propositions themselves.
    said = counted.select(F.col("nome").alias("primeiro"), F.xxhash64("proposicao_alvo").alias("p"), "f", "c", "z")
    return members, said.join(size, "primeiro").select("classe", "n", "primeiro", "p", "f", "c", "z")


class _Side:
    """What some speakers or classes said as flat arrays: ``p``, ``f``, ``c`` and ``z`` of ``row``."""

    def __init__(self, table: pa.Table) -> None:
        self.names, self.n = table["classe"].combine_chunks(), table["n"].to_numpy()
        self.p, self.f, self.c, self.z = (np.concatenate([x.flatten().to_numpy() for x in table[k].chunks]) for k in "pfcz")
        self.row = np.repeat(np.arange(len(self.n)), pc.list_value_length(table["p"]).to_numpy())

    def keys(self) -> list[bytes]:
        return self.names.cast(pa.binary()).to_pylist()

    def on(self, p: np.int64) -> np.ndarray:
        """What each row said on one proposition."""
        out, at = np.zeros((3, len(self.n)), np.int64), self.p == p
        out[:, self.row[at]] = self.f[at], self.c[at], self.z[at]
        return out

    def take(self, rows: np.ndarray) -> _Side:
        """Some of the rows, in the order that is told."""
        out, first = copy.copy(self), np.searchsorted(self.row, rows)
        n = np.searchsorted(self.row, rows, "right") - first
        at = np.arange(n.sum()) + np.repeat(first - n.cumsum() + n, n)
        out.names, out.n, out.row = self.names.take(pa.array(rows)), self.n[rows], np.repeat(np.arange(len(rows)), n)
        out.p, out.f, out.c, out.z = (x[at] for x in (self.p, self.f, self.c, self.z))
        return out


def _tile(index: _Side, rank: np.ndarray, same: bool, count: bool) -> Callable[[_Side, np.ndarray], Iterator[pa.RecordBatch]]:
    """Edges of a few rows to those of ``index``, row by row in the order of both; ``rank`` and ``place`` compare their names."""
    order, m = np.argsort(index.p, kind="stable"), len(index.n)
    p, row, f, c, z = (x[order] for x in (index.p, index.row, index.f, index.c, index.z))

    def met(side: _Side, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = pa.concat_arrays([index.names, side.names])
        lo, hi = np.searchsorted(p, side.p), np.searchsorted(p, side.p, "right")
        n, size = hi - lo, len(side.n) * m
        upto = np.concatenate([[0], n.cumsum()])
        sums, u = [np.zeros(size) for _ in range(1 if count else 4)], 0
        while u < len(n):  # so much of it at once as meets a bounded number of others, one at least
            v = max(u + 1, int(np.searchsorted(upto, upto[u] + 4 * AT_ONCE, "right")) - 1)
            x = np.repeat(np.arange(u, v), n[u:v])
            y = np.arange(len(x)) + np.repeat(lo[u:v] - upto[u:v] + upto[u], n[u:v])
            if same:
                up = rank[row[y]] >= place[side.row[x]]
                x, y = x[up], y[up]
            at = side.row[x] * m + row[y]
            sums[-1] += np.bincount(at, minlength=size)
            if not count:
                # Counters of row pairs on one proposition, without forming the pairs.
                fa, ca, za, fb, cb, zb = side.f[x], side.c[x], side.z[x], f[y], c[y], z[y]
                for k, w in enumerate((fa * fb + ca * cb, fa * cb + ca * fb, za * (fb + cb + zb) + (fa + ca) * zb)):
                    sums[k] += np.bincount(at, w, size)
            u = v
        hit = np.flatnonzero(sums[-1])
        r, j = hit // m, hit % m
        if same:
            some_of = (rank[j] > place[r]) | (index.n[j] > 1)
            hit, r, j = hit[some_of], r[some_of], j[some_of]
        na, nb = side.n[r], index.n[j]
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([int(np.where(same & (rank[j] == place[r]), na * (na - 1) // 2, na * nb).sum())])], ["arestas"])
            return
        less = rank[j] < place[r]
        apart = np.argsort(less, kind="stable")  # one end stays while the other passes
        for some in (apart[k : k + AT_ONCE] for k in range(0, len(apart), AT_ONCE)):
            k, at = less[some], hit[some]
            src, dst = (names.take(pa.array(np.where(side_of, j[some], m + r[some]))) for side_of in (k, ~k))
            yield pa.RecordBatch.from_arrays([src, dst, pa.array(np.where(k, nb[some], na[some])), pa.array(np.where(k, na[some], nb[some])), *(pa.array(s[at].astype(np.int64)) for s in sums[:3])], EDGE)

    return met


def _cell(held: list[pa.RecordBatch], same: bool, count: bool) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    """Edges of the rows of a batch to those of ``held``, or only how many between members.

    Both are cut up by name into tiles. In a tile those who said the same on the most common proposition follow each
    other, so names and counters of edges repeat what was written shortly before, and files of them stay small.
    """
    t = pa.Table.from_batches(held).combine_chunks()
    index = _Side(t.take(pc.sort_indices(t["classe"].cast(pa.binary()))))  # by code points, like the names of an edge
    keys, (ps, often) = index.keys(), np.unique(index.p, return_counts=True)
    common = ps[often.argmax()]
    ranks = np.split(order := np.lexsort((*index.on(common), np.arange(len(keys)) // TILE)), range(TILE, len(order), TILE))
    tiles = [(rank.max(), _tile(index.take(rank), rank, same, count)) for rank in ranks]

    def met(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        side = _Side(pa.Table.from_batches([batch]))
        place = np.array([bisect.bisect_left(keys, k) for k in side.keys()])
        order = np.lexsort((*side.on(common), place // TILE))
        for rows in np.split(order, range(TILE, len(order), TILE)):
            some, least = side.take(rows), place[rows].min()
            for last, tile in tiles:
                if not same or last >= least:
                    yield from tile(some, place[rows])

    return met


def _cells(profile: DataFrame, block: int, count: bool, schema: str) -> DataFrame:
    said = profile.groupBy("classe", "n").agg(F.collect_list(F.struct("p", "f", "c", "z")).alias("x")).select("classe", "n", *(F.col(f"x.{k}").alias(k) for k in "pfcz"))
    blocks = max(BLOCKS, -(-profile.select("classe").distinct().count() // block))
    return cells.pairs(said, "classe", blocks, lambda held, same: _cell(held, same, count), schema)


def class_edges(profile: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges between classes (a <= b; a = b: among the members of one class) with the sizes of both. Edges leave the task that finds them whole, so none is moved to be summed."""
    return _cells(profile, block, False, "a string, b string, n_a bigint, n_b bigint, concordancia bigint, discordancia bigint, neutro bigint")


def count_edges(profile: DataFrame, block: int = BLOCK) -> DataFrame:
    """(arestas): how many edges between speakers there are, of all classes."""
    return _cells(profile, block, True, "arestas bigint").agg(F.coalesce(F.sum("arestas"), F.lit(0)).alias("arestas"))


def edges(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges between speakers (src < dst) with their counters: each speaker as a class of their own."""
    alone = counts(df).select(F.col("nome").alias("classe"), F.lit(1).cast("bigint").alias("n"), F.xxhash64("proposicao_alvo").alias("p"), "f", "c", "z")
    return class_edges(alone, block).select(F.col("a").alias("src"), F.col("b").alias("dst"), "concordancia", "discordancia", "neutro")


def edges_between(_members: DataFrame, profile: DataFrame) -> DataFrame:
    """Edges between classes, each named by its first member: a <= b, n_a, n_b and the counters; a = b: among the members of one class."""
    return class_edges(profile.select(F.col("primeiro").alias("classe"), "n", "p", "f", "c", "z"))


def named(members: DataFrame) -> DataFrame:
    """(nome, classe): every speaker with the first member of their class."""
    return members.join(members.groupBy("classe").agg(F.min("nome").alias("de")), "classe").select("nome", F.col("de").alias("classe"))


def edges_pairwise(df: DataFrame, order: str) -> DataFrame:
    """The same edges by their plain definition: all pairs of rows of two speakers on one proposition, each pair once.

    The rows of one speaker on one proposition with one stance are alike, so their pairs are counted, not formed;
    ``order`` told which row of a pair comes first, which names do as well, also where it repeats.
    """
    return edges(df)


def classify(linked: DataFrame) -> DataFrame:
    """Allies, antagonists or neutral contact, with colour, width and title; ties are neutral."""
    c, d, n = F.col("concordancia"), F.col("discordancia"), F.col("neutro")
    ally, foe = (c > d) & (c >= n), (d > c) & (d >= n)
    pick = lambda a, b, z: F.when(ally, a).when(foe, b).otherwise(z)
    colours = [F.lit(schema.EDGE_COLOURS[k]) for k in ("aliados", "antagonistas", "neutro")]
    told = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    # The titles.
    title = pick(
        told("Aliados (Concordaram: ", c, " | Discordaram: ", d, " | Neutros: ", n, ")"),
        told("Antagonistas (Discordaram: ", d, " | Concordaram: ", c, " | Neutros: ", n, ")"),
        told("Contato Neutro (Neutros: ", n, " | Concordaram: ", c, " | Discordaram: ", d, ")"),
    )
    return linked.select("src", "dst", "concordancia", "discordancia", "neutro", pick(*colours).alias("color"), pick(c, d, F.greatest(n, F.lit(1))).cast("bigint").alias("value"), title.alias("title"), (c - d).alias("peso"))


def connected(points: DataFrame, counted: DataFrame) -> DataFrame:
    """Nodes with an edge: those with another speaker on one of their propositions; no edge is formed to tell."""
    company = counted.groupBy("proposicao_alvo").agg(F.count("*").alias("n")).where("n > 1").select("proposicao_alvo")
    return points.join(counted.join(company, "proposicao_alvo", "left_semi").select("nome").distinct(), "nome", "left_semi")
