"""The whole corpus as token ids of a public byte-level BPE tokenizer.

Texts up to ``piece`` characters are encoded where they are read, in Arrow
batches. A longer text is cut into pieces that are encoded in parallel. Between
two pieces lies one of two kinds of joint:

* before white space that follows other text, or behind a run of letters or
  digits, where this tokenizer's pattern always starts a new word, so nothing can
  merge across it;
* inside a word that is too long itself, where halves are encoded on their own, in
  parallel if the word is longer than a piece, and joined as a tree: around each join a window of tokens is decoded and encoded
  again, and grows on either side until its first and last token are the ones
  that were there, at the same place. Every pair of neighbours then stands in
  some encoding side by side, and a sequence of BPE tokens whose neighbours all
  do is the encoding.

Defined results: null and empty texts have an empty list; strings that look like
special tokens are ordinary text; every row gives a row, whatever its length, so an
id that comes twice gives two, each with the ids of its own text; other columns are
ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
PIECE = 8192
#: Words without white space that are longer than this are encoded as trees of halves.
WORD = 2048
#: Tokens on either side of a join that are encoded again at first.
WINDOW = 8
#: Fixed value: the public pattern that cuts text into words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
JOINT = regex.compile(r"(?<=\S)(?=\s)")
#: Where the pattern starts a new word whatever stands around: before white space, and behind a run of letters or digits.
WORD_START = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}\s])|(?<=\p{N})(?=[^\p{N}\s])")


@lru_cache(maxsize=4)
def encoding(path: str):  # noqa: ANN201
    """The encoder of one vocabulary file, once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Coder:
    """Encoding of texts of any length, exactly as in one call."""

    def __init__(self, path: str, word: int = WORD) -> None:
        self.bpe = encoding(path)
        self.word = word

    def short(self, text: str) -> list[int]:
        return self.bpe.encode_ordinary(text)

    def text(self, text: str) -> list[int]:
        """Ids of a text: ordinary stretches in one call each, runs without a joint that are too long as trees."""
        if len(text) <= self.word:
            return self.short(text)
        out: list[int] = []
        start = done = 0
        for joint in (*(m.start() for m in JOINT.finditer(text)), len(text)):
            if joint - start > self.word:
                out += self.short(text[done:start]) + self.run(text[start:joint])
                done = joint
            start = joint
        return (out + self.short(text[done:])) if done else self.short(text)

    def run(self, run: str) -> list[int]:
        """A long stretch without a joint: its words by the pattern, the overlong among them as trees of their bytes."""
        out: list[int] = []
        for m in regex.finditer(PATTERN, run):
            w = m.group().encode()
            out += self.leaf(w) if len(w) <= self.word else self.halves(w)
        return out

    def halves(self, word: bytes) -> list[int]:
        """One word as a tree: encode the leaves, then join neighbours level by level."""
        return self.joined([self.leaf(word[i : i + self.word]) for i in range(0, len(word), self.word)])

    def joined(self, level: list[list[int]]) -> list[int]:
        """Encodings of successive parts of one word, joined level by level."""
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def leaf(self, part: bytes) -> list[int]:
        return list(self.bpe._encode_single_piece(part))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Two encodings as the encoding of both: windows grow around the join until both sides agree."""
        a = b = WINDOW
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = left[len(left) - a :] + right[:b]
            again = self.leaf(b"".join(self.bpe.decode_single_token_bytes(t) for t in window))
            agrees_left = a == len(left) or again[0] == window[0]
            agrees_right = b == len(right) or again[-1] == window[-1]
            if agrees_left and agrees_right:
                return left[: len(left) - a] + again + right[b:]
            a, b = a * (1 if agrees_left else 2), b * (1 if agrees_right else 2)


def encode(df: DataFrame, key: str, text: str, folder: str = FOLDER, piece: int = PIECE, word: int = WORD, lengths: bool = False) -> DataFrame:
    """(key, ids array<int>) for every row of ``df``, or (key, tokens bigint) with ``lengths``."""
    path = f"{folder}/{VOCABULARY}"
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(path, word)
        for pdf in batches:
            ids = (coder.text(t) if isinstance(t, str) else [] for t in pdf["text"])
            yield pd.DataFrame({"key": pdf["key"], **({"tokens": [len(x) for x in ids]} if lengths else {"ids": list(ids)})})

    kind = rows.schema["key"].dataType.simpleString()
    small = rows.where(F.col("text").isNull() | (F.length("text") <= piece)).mapInPandas(run, f"key {kind}, " + ("tokens bigint" if lengths else "ids array<int>"))
    long = _long(rows.where(F.length("text") > piece), path, kind, piece, word)
    return small.unionByName(long.select("key", F.size("ids").cast("bigint").alias("tokens")) if lengths else long)


def cut_up(text: str, piece: int) -> Iterator[tuple[str, bool]]:
    """Parts of a long text, and whether a part continues the word of the one before.

    A part ends at the first joint behind ``piece`` characters. A word that alone is longer than that, which no
    joint divides, is cut anywhere; its parts are halves for the tree.
    """
    start = 0
    while start < len(text):
        m = WORD_START.search(text, start + piece) if start + piece < len(text) else None
        stop = m.start() if m else len(text)
        if stop - start <= 2 * piece:
            yield text[start:stop], False
        else:
            done, blanks = start, []
            for m in regex.finditer(PATTERN, text, pos=start, endpos=stop):
                if m.end() - m.start() > piece:
                    # White space in front of it was cut into words with this one in view: word by word, then.
                    edges = [*blanks, m.start()]
                    if edges[0] > done:
                        yield text[done : edges[0]], False
                    for i, j in zip(edges, edges[1:]):
                        yield text[i:j], False
                    for i in range(m.start(), m.end(), piece):
                        yield text[i : min(i + piece, m.end())], i > m.start()
                    done, blanks = m.end(), []
                elif m.group().isspace():
                    blanks.append(m.start())
                else:
                    blanks = []
            if stop > done:
                yield text[done:stop], False
        start = stop


def _long(rows: DataFrame, path: str, kind: str, piece: int, word: int) -> DataFrame:
    """Long texts: parts of all documents encoded in parallel, then joined per document."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, h, text in zip(pdf["key"], pdf["h"], pdf["text"]):
                yield pd.DataFrame([(key, h, n, part, glued) for n, (part, glued) in enumerate(cut_up(text, piece))], columns=["key", "h", "n", "part", "glued"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(path, word)
        for pdf in batches:
            # A part that continues a word, or is continued, is bytes of one word.
            whole = [coder.halves(t.encode()) if w else coder.text(t) for t, w in zip(pdf["part"], pdf["of_word"])]
            yield pd.DataFrame({"key": pdf["key"], "h": pdf["h"], "n": pdf["n"], "copies": pdf["copies"], "glued": pdf["glued"], "ids": whole})

    def tree(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        coder, out = Coder(path, word), []
        level: list[list[int]] = []
        for glued, ids in pdf.sort_values("n")[["glued", "ids"]].itertuples(index=False):
            if not glued and level:
                out += coder.joined(level)
                level = []
            level.append(list(ids))
        return pd.DataFrame({"key": [key[0]], "copies": [key[2]], "ids": [out + coder.joined(level)]})

    cut = rows.withColumn("h", F.xxhash64("text")).mapInPandas(parts, f"key {kind}, h bigint, n int, part string, glued boolean")
    # Copies of a row are encoded once and counted; texts that share an id are told apart by their hash.
    spread = cut.groupBy("key", "h", "n").agg(F.first("part").alias("part"), F.first("glued").alias("glued"), F.count("*").alias("copies"))
    nxt = F.lead("glued").over(Window.partitionBy("key", "h").orderBy("n"))
    marked = spread.withColumn("of_word", F.col("glued") | F.coalesce(nxt, F.lit(False))).repartition(F.xxhash64("key", "h", "n"))
    ids = marked.mapInPandas(run, f"key {kind}, h bigint, n int, copies bigint, glued boolean, ids array<int>")
    ids = ids.withColumn("trees", F.max("glued").over(Window.partitionBy("key", "h")))
    plain = ids.where("not trees").groupBy("key", "h", "copies").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "ids"))), lambda x: x["ids"])).alias("ids")).drop("h")
    trees = ids.where("trees").select("key", "h", "n", "copies", "glued", "ids").groupBy("key", "h", "copies").applyInPandas(tree, f"key {kind}, copies bigint, ids array<int>")
    return plain.unionByName(trees).select("key", "ids", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("col")
