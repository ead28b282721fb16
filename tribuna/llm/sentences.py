"""Sentence boundaries in any language or script, by a finite transducer.

The boundary rules are compiled into two layers:

1. a regular expression cuts a text into tokens, and every token gets a *class*
   from a bounded context on either side (abbreviations, decimals, initials,
   ellipses, letter case of what follows, script);
2. a finite transducer reads the classes. Its states are ``B`` (between
   sentences), ``S`` (inside one) and one state for each kind of quotation or
   bracket that is open, so nothing inside a quotation ends the sentence.

A quotation or bracket is open only if its closing mark stands anywhere behind it.

Because the classes do not depend on the state, a chunk of a long document *is*
a function from states to states. Long documents are therefore cut into chunks
that are lexed in parallel; their functions are composed by a parallel prefix
scan (within blocks, across block totals, back into blocks); and each chunk then
emits its starts and ends from the state that reaches it. A chunk ends inside
running text only, where no mark reaches over and no look-around passes, and knows
which closing marks stand behind it, so chunks of any size give the same units.

Defined results: null and blank texts have no sentences; all non-blank text
belongs to exactly one unit; offsets are code points from 0, the end exclusive;
identical copies of a row count once; a key with different texts has the units of
each; columns other than the key and the text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tribuna.session import cut

CHUNK = 4096
#: Characters of context before a chunk: more than any mark that can reach over its start, or any look-behind.
CONTEXT = 128
#: Chunks in a block of the scan.
BLOCK = 256

# Abbreviations that never end a sentence, by what follows them being their complement.
ABBREVIATIONS = frozenset(
    "dr dra drs sr sra srs sras prof profa profas enga eng av art arts inc n p pp pág págs fl fls cf v vs séc exa s dep sen "
    "mr mrs ms fig vol núm nº l'art m mme mlle jr gen cel pres proc obs "
    "i.e e.g ул д г стр им т см кв пер обл डॉ श्री प्रो एड".split()
)
# Abbreviations that end a sentence only if a new one clearly begins.
OPEN_ABBREVIATIONS = frozenset("etc p.p p.m a.m e.u u.s exas руб млн млрд тыс εκατ κ.λπ др пр".split())
# Hesitations whose dots never end a sentence.
FILLERS = frozenset("ahn é ééé éééé hum uhm hã ãh eh bom bem well bueno bon tá né tipo alors".split())
# Pairs whose content does not end the sentence around it.
PAIRS = {"“": "”", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "„": "“", "‘": "’"}

OPENERS = "".join(PAIRS) + '"'
CLOSERS = '”»›」』)）]’"'
KINDS = {o: i for i, o in enumerate([*PAIRS, '"'])}
CLOSED_BY = {}
for _o, _c in PAIRS.items():
    CLOSED_BY.setdefault(_c, []).append(KINDS[_o])
CLOSED_BY['"'] = [KINDS['"']]
B, S, Q = 0, 1, 2
N_STATES = Q + len(KINDS)

UPPER = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĪİŁŃŇŐŒŘŚŞŠŤŪŮŰŹŻŽΆ-ΫА-ЯЁЂ-Џ"
TIME = r"[\[(<]\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?[\])>]"
NOTE = rf"\[[^\[\]\n]{{1,80}}\]|(?<![\w*])\*[^*\s][^*\n]{{1,60}}\*(?![\w*])|[(（][{UPPER}][^()（）\n]{{0,100}}[.!?…][)）]"
#: Where a token can begin; one leading set, so the search skips at the speed of C.
CANDIDATE = re.compile(r"""[.!?…؟।॥。！？｡;\[(<*“«‹「『（„‘”»›」』)）\]"’\n0-9](?:(?<=[^0-9])|\d?:\d\d:)""")
TOKEN = re.compile(
    rf"""
    (?P<time>{TIME}|(?<![\d:.,])\d{{1,2}}:\d{{2}}:\d{{2}}(?:[.,]\d{{1,3}})?(?![\d:]))
  | (?P<note>{NOTE})
  | (?P<term>[.!?…؟।॥。！？｡]+|(?<=[Ͱ-Ͽἀ-῿]);)
  | (?P<open>[“«‹「『(（\[„‘])
  | (?P<close>[”»›」』)）\]])
  | (?P<plain>")
  | (?P<apos>(?<!\w)’|’(?!\w))
  | (?P<line>\n\s*)
    """,
    re.X,
)
BLANK = re.compile(r"\s*")
NONBLANK = re.compile(r"\S")
SKIP = re.compile(rf"(?:\s+|{TIME}|\d{{1,2}}:\d{{2}}:\d{{2}}(?:[.,]\d{{1,3}})?(?![\d:])|{NOTE})*")
#: What can stand before a word inside it.
BEFORE = re.compile(r"[\s“«‹「『(（\[„‘\"¿¡]")
ENDING = ".!?…؟।॥。！？｡"


def begins(text: str, at: int) -> str:
    """What stands at ``at`` after blanks, annotations and time marks: ``U`` a start, ``l`` lower case, ``d`` digit, ``c`` caseless, ``p`` punctuation that carries on, ``$`` the end."""
    at = SKIP.match(text, at).end()
    while at < len(text) and text[at] in "“«‹「『(（[„‘\"¿¡-–—•*'":
        dash = text[at] in "-–—"
        at = BLANK.match(text, at + 1).end()
        if dash and at < len(text) and text[at].islower():
            return "l"
    if at >= len(text):
        return "$"
    ch = text[at]
    if ch.isalpha():
        return "U" if ch.isupper() or ch.istitle() else "l" if ch.islower() else "c"
    return "d" if ch.isnumeric() else "p" if ch in ",;:.)/”»]%=+" else "U"


def ends(text: str, a: int, b: int) -> bool:
    """Whether the terminators text[a:b] end a sentence, were nothing open. Looks at bounded context only."""
    mark = text[a:b]
    after = b
    while after < len(text) and text[after] in CLOSERS and text[after] != '"':
        after += 1
    if after < len(text) and text[after] == '"' and (after + 1 >= len(text) or not text[after + 1].isalnum()):
        after += 1
    near = text[after] if after < len(text) else ""
    glued = bool(near) and not near.isspace()
    if set(mark) & set("。！？｡।॥؟"):
        return not (glued and near in "、，,；;：:」』）)と")
    word = BEFORE.split(text[max(0, a - 40) : a])[-1]
    bare = word.lower().strip("()[]“”\"'’,;:")
    what = begins(text, after)
    if set(mark) & set("!?"):
        if glued and near.isalnum():
            return what == "U"
        return what in "U$dc"
    if mark == ";":
        return True
    if len(mark) > 1 or mark == "…":
        if bare in FILLERS and what != "$":
            return False
        if glued and near.isalnum() and not near.isupper():
            return False
        return what in "U$" or what == "d" and not glued
    # One full stop.
    if glued:
        if near.isalpha():
            return near.isupper() and len(bare) >= 3 and bare[-1:].isalpha() and "." not in bare and bare not in ABBREVIATIONS and (word[-1:].islower() or word.isupper() and len(word) > 4)
        if near in "[(<“«*" and not near.isdigit():
            return what in "U$d" and bare not in ABBREVIATIONS
        return False
    if what == "$":
        return True
    if bare in ABBREVIATIONS or len(bare) == 1 and bare.isalpha() and word[-1:].isupper():
        return False
    if what == "l" or what == "p":
        return False
    if bare in OPEN_ABBREVIATIONS or "." in bare and not any(c.isdigit() for c in bare):
        return what == "U"
    return True


def after_close(text: str, at: int) -> bool:
    """Whether a closed quotation or bracket also closes the sentence: its content ended one and a new one begins."""
    inner = text[at - 1] if at else ""
    if inner.isspace():
        inner = text[:at].rstrip()[-1:]
    if inner not in ENDING:
        return False
    after = at + 1
    while after < len(text) and text[after] in "”»›」』)）]":
        after += 1
    if after < len(text) and text[after] in ENDING:
        return False
    near = text[after : after + 1]
    if text[at] in "」』）":
        return not near or near.isspace() or not ("぀" <= near <= "ゟ" or near in "、，,")
    return begins(text, after) in "U$dc" and not (near and near.isalnum())


def lex(text: str, lines: bool = False, later: str = "") -> list[tuple[int, int, int, int]]:
    """Tokens as (class, start, end, end of the unit if it ends here); ``later``: closing marks that stand behind the text.

    Classes: 0 word, 1 terminator that ends, 2 note or time mark, 3 the same where it splits even an unfinished
    sentence, 4 line break that ends, 10+k opener of kind k, 50+k closer of kind k, 100+k closer that also ends the
    sentence, 150+k the same right behind a terminator that ends.
    """
    out, at, n, covered = [], 0, len(text), 0
    closed: dict[str, int] = {}  # where each closing mark stands last
    for c in CANDIDATE.finditer(text):
        a = c.start()
        m = TOKEN.match(text, a) if a >= at else None
        if m is None:
            continue
        b, kind = m.end(), m.lastgroup
        word = NONBLANK.search(text, at, a)
        if word:
            out.append((0, word.start(), a, a))
        at = b
        if kind == "time" or kind == "note":
            splits = kind == "time" and begins(text, b) in "U$c" or kind == "note" and text[a] in "(（"
            out.append((3 if splits else 2, a, b, b))
        elif kind == "term":
            if ends(text, a, b):
                covered = b
                while covered < n and (text[covered] in "”»›」』)）]" or text[covered] in "\"'’" and (covered + 1 >= n or not text[covered + 1].isalnum())):
                    covered += 1
                out.append((1, a, b, covered))
            else:
                out.append((0, a, b, b))
        elif kind == "line":
            if lines and begins(text, b) in "U$c":
                out.append((4, a, b, a))
        elif kind == "open" or kind == "plain" and (a == 0 or text[a - 1].isspace() or text[a - 1] in "([“«") and b < n and not text[b].isspace():
            mark = PAIRS.get(text[a], '"')
            if mark not in closed:
                closed[mark] = n if mark in later else text.rfind(mark)
            known = closed[mark] >= b
            out.append((10 + KINDS[text[a]] if known else 0, a, b, b))
        else:
            kinds = CLOSED_BY.get(text[a])
            if not kinds:
                out.append((0, a, b, b))
            elif a < covered:
                out.append((150 + kinds[0], a, b, covered))
            elif after_close(text, a):
                stop = b
                while stop < n and text[stop] in "”»›」』)）]":
                    stop += 1
                covered = stop
                out.append((100 + kinds[0], a, b, stop))
            else:
                out.append((50 + kinds[0], a, b, b))
    word = NONBLANK.search(text, at)
    if word:
        out.append((0, word.start(), n, n))
    return out


def move(state: int, cls: int) -> int:
    """The transition table of the transducer."""
    if cls == 0:
        return S if state == B else state
    if cls in (1, 4):
        return B if state in (B, S) else state
    if cls in (2, 3):
        return B if state == B or state == S and cls == 3 else state
    if cls < 50:
        return Q + cls - 10 if state in (B, S) else state
    if cls < 100:
        return S if state in (B, Q + cls - 50) else state
    if cls < 150:
        return B if state == Q + cls - 100 else S if state == B else state
    return B if state in (B, Q + cls - 150) else state


CLASSES = [0, 1, 2, 3, 4, *(base + k for base in (10, 50, 100, 150) for k in range(len(KINDS)))]
TABLE = {c: tuple(move(s, c) for s in range(N_STATES)) for c in CLASSES}


def compose(tokens: list[tuple[int, int, int, int]]) -> list[int]:
    """The function from states to states that a run of tokens is."""
    f = list(range(N_STATES))
    for cls, *_ in tokens:
        t = TABLE[cls]
        f = [t[s] for s in f]
    return f


def emit(tokens: list[tuple[int, int, int, int]], state: int) -> tuple[list[int], list[int], int]:
    """Starts and ends of units over the tokens, from the incoming state; and the state after them."""
    starts: list[int] = []
    stops: list[int] = []
    last = -1  # the end of the last word seen, for sentences that end without a mark; -1: before this chunk
    for cls, a, b, stop in tokens:
        new = TABLE[cls][state]
        if cls in (2, 3):
            if state == S and new == B:
                stops.append(last)
            if new == B:
                starts.append(a)
                stops.append(b)
        elif state == B:
            if new != B:
                starts.append(a)
            elif cls == 1:
                starts.append(a)
                stops.append(stop)
        elif new == B:
            stops.append(last if cls == 4 else stop)
        state = new
        last = b if cls != 4 else last
    return starts, stops, state


def trimmed(text: str, tokens: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The tokens with the ends of words moved before trailing blanks."""
    out = []
    for cls, a, b, stop in tokens:
        if cls == 0:
            while b > a and not NONBLANK.match(text, b - 1, b):
                b -= 1
        out.append((cls, a, b, stop))
    return out


def units(text: str | None, lines: bool = False) -> list[tuple[int, int]]:
    """The sentences of one text as (start, end)."""
    if not text:
        return []
    tokens = trimmed(text, lex(text, lines))
    if not tokens:
        return []
    starts, stops, _ = emit(tokens, B)
    if len(stops) < len(starts):
        stops.append(max(t[2] for t in tokens if t[0] != 4))
    return list(zip(starts, stops))


# -- long documents -------------------------------------------------------------------


def clip(window: str, left: int, lines: bool, later: str) -> list[tuple[int, int, int, int]]:
    """Tokens of a window from ``left`` on, with word runs that reach in from before cut there."""
    out = []
    for cls, a, b, stop in trimmed(window, lex(window, lines, later)):
        if cls == 0 and a < left < b:
            word = NONBLANK.search(window, left, b)
            if not word:
                continue
            a = word.start()
        if a >= left:
            out.append((cls, a, b, stop))
    return out


#: What can stand in front of a chunk's end within the reach of a mark that could reach over it.
REACHING = re.compile(r"[\[(（*]")


def seams(text: str, size: int) -> list[int]:
    """Where chunks begin: at least ``size`` characters apart, behind a letter and before a letter or blank, with no mark open around."""
    out, at = [0], size
    while at < len(text):
        if text[at - 1].isalpha() and (text[at].isalpha() or text[at].isspace()):
            marks = [m.start() for m in REACHING.finditer(text, max(0, at - CONTEXT + 16), at)]
            if not marks:
                out.append(at)
                at += size
                continue
            at = marks[-1] + CONTEXT - 16
        at += 1
    return out


def chunks(text: str, size: int) -> Iterator[tuple[int, str, int, str]]:
    """(begin, window, characters of it before the chunk, closing marks behind it) of every chunk."""
    starts = seams(text, size)
    last = {m: text.rfind(m) for m in {*PAIRS.values(), '"'}}
    for a, b in zip(starts, [*starts[1:], len(text)]):
        first = max(0, a - CONTEXT)
        yield a, text[first:b], a - first, "".join(sorted(m for m, at in last.items() if at >= b))


def _windows(df: DataFrame, size: int) -> DataFrame:
    """One row a chunk: key, k, window of text, characters of it before the chunk, where the window begins, closing marks behind."""

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(key, k, w, x, a - x, later) for key, text in zip(pdf["key"], pdf["text"]) for k, (a, w, x, later) in enumerate(chunks(text, size))]
            yield pd.DataFrame(rows, columns=["key", "k", "window", "left", "shift", "later"])

    return df.mapInPandas(cut_up, "key string, k int, window string, left int, shift bigint, later string")


def _scan(functions: DataFrame, block: int) -> DataFrame:
    """Exclusive prefix scan of (key, k, f) under composition from state B: (key, k, state)."""

    def fold(pdf: pd.DataFrame) -> list[int]:
        f = list(range(N_STATES))
        for g in pdf.sort_values("k")["f"]:
            f = [g[s] for s in f]
        return f

    def totals(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "block": [key[1]], "k": [int(key[1])], "f": [fold(pdf)]})

    def walk(pdf: pd.DataFrame, state: int) -> Iterator[tuple[int, int]]:
        for k, f in sorted(zip(pdf["k"], pdf["f"]), key=lambda x: x[0]):
            yield k, state
            state = f[state]

    def across(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], k, s) for k, s in walk(pdf, B)], columns=["key", "block", "state"])

    def within(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], k, s) for k, s in walk(left, int(right["state"].iloc[0]))], columns=["key", "k", "state"])

    blocks = functions.withColumn("block", (F.col("k") / block).cast("int"))
    sums = blocks.groupBy("key", "block").applyInPandas(totals, "key string, block int, k int, f array<int>")
    entry = sums.groupBy("key").applyInPandas(across, "key string, block int, state int")
    return blocks.groupBy("key", "block").cogroup(entry.groupBy("key", "block")).applyInPandas(within, "key string, k int, state int")


def _long(df: DataFrame, size: int, block: int, lines: bool) -> DataFrame:
    def lexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["f"] = [compose(clip(w, x, lines, m)) for w, x, m in zip(pdf["window"], pdf["left"], pdf["later"])]
            yield pdf[["key", "k", "f"]]

    def emitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, k, window, left, shift, later, state in zip(*(pdf[c] for c in ("key", "k", "window", "left", "shift", "later", "state"))):
                tokens = clip(window, left, lines, later)
                starts, stops, _ = emit(tokens, int(state))
                last = max((t[2] for t in tokens if t[0] != 4), default=-1)
                rows.append((key, k, [x + shift for x in starts], [x + shift if x >= 0 else -1 for x in stops], last + shift if last >= 0 else -1))
            yield pd.DataFrame(rows, columns=["key", "k", "starts", "stops", "last"])

    windows = cut(_windows(df, size))
    states = _scan(windows.mapInPandas(lexed, "key string, k int, f array<int>"), block)
    events = windows.join(states, ["key", "k"]).mapInPandas(emitted, "key string, k int, starts array<bigint>, stops array<bigint>, last bigint")
    # An end may need the last word of an earlier chunk; a unit may end in a later chunk than it starts in.
    by = Window.partitionBy("key").orderBy("k")
    seen = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    events = events.withColumn("stops", F.transform("stops", lambda x: F.when(x < 0, seen).otherwise(x)))
    # The end of the document is known before chunks without any start or end drop out.
    events = events.withColumn("total", F.max("last").over(Window.partitionBy("key")))
    both = F.concat(F.transform("starts", lambda x: F.struct(x.alias("at"), F.lit(1).alias("s"))), F.transform("stops", lambda x: F.struct(x.alias("at"), F.lit(0).alias("s"))))
    points = events.select("key", "total", F.explode(both).alias("p"))
    points = points.select("key", "total", "p.at", "p.s")
    nxt = F.lead("at").over(Window.partitionBy("key").orderBy("at", "s"))
    return points.withColumn("stop", F.coalesce(nxt, F.col("total"))).where("s = 1").select("key", F.col("at").alias("inicio"), F.col("stop").alias("fim"))


def sentences(df: DataFrame, key: str, text: str, chunk: int = CHUNK, block: int = BLOCK, lines: bool = False) -> DataFrame:
    """Sentence units of ``df[text]`` as (key string, inicio, fim); see the module for the defined results.

    ``chunk`` characters of a longer text go to one task at a time; ``block`` chunks to one step of the scan;
    ``lines``: a line break ends a sentence if a new one begins behind it.
    """
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where(r"key is not null and text is not null and text rlike '(?U)[^\s\x1c-\x1f]'")

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(k, a, b) for k, t in zip(pdf["key"], pdf["text"]) for a, b in units(t, lines)]
            yield pd.DataFrame(found, columns=["key", "inicio", "fim"])

    small = rows.where(F.length("text") <= chunk).mapInPandas(short, "key string, inicio bigint, fim bigint")
    # Copies of a long text are told by its hash, and differing texts under one key kept apart by it.
    long = rows.where(F.length("text") > chunk).groupBy(F.concat(F.xxhash64("text").cast("string"), F.lit(":"), F.col("key")).alias("key")).agg(F.first("text").alias("text"))
    found = _long(long, chunk, block, lines).withColumn("key", F.regexp_replace("key", "^[^:]*:", ""))
    return small.unionByName(found).distinct()
