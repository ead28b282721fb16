"""Column functions on Portuguese names, markers and texts; all run inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every white space of Unicode, the separators U+001C to U+001F among them.
BLANK = r"[\s\x1c-\x1f]"
#: Fixed value: the affiliation of those without a party.
NO_PARTY = "SOCIEDADE/OUTROS"
#: One title word dropped from the front of a marker.
MARKER_TITLES = "deputado|deputada|senador|senadora|ministro|ministra|senhor|senhora|relator|relatora"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at either end, by Unicode (``trim`` drops blanks only)."""
    return F.regexp_replace(c, rf"(?U)^{BLANK}+|{BLANK}+$", "")


def clean_text(c: Column) -> Column:
    """White space collapsed and stripped; null becomes empty."""
    return strip(F.regexp_replace(text_or_empty(c), rf"(?U){BLANK}+", " "))


def title_case(c: Column) -> Column:
    """First letter of every run of letters upper case, the rest lower case."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.initcap(w)), "")


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition without combining marks makes of single characters: (from, to) of equal
    length followed in ``from`` by what vanishes, and those that become several."""
    one, gone, many = [], [], {}
    for k in (*range(0x80, 0x2500), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)):
        ch = chr(k)
        out = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if out == ch:
            continue
        if len(out) == 1:
            one.append((ch, out))
        elif out:
            many[ch] = out
        else:
            gone.append(ch)
    return "".join(a for a, _ in one) + "".join(gone), "".join(b for _, b in one), many


def fold_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks, by a generated ``translate`` table."""
    source, target, many = _folding()
    whole = F.translate(c, source, target)
    # One literal that folds into a map, instead of hundreds of expressions to analyse.
    table = F.str_to_map(F.lit("\x02".join(f"{a}\x01{b}" for a, b in many.items())), F.lit("\x02"), F.lit("\x01"))
    several = F.array_join(F.transform(F.split(whole, ""), lambda ch: F.coalesce(F.element_at(table, ch), ch)), "")
    return F.when(c.rlike("[" + "".join(many) + "]"), several).otherwise(whole)


def normalize_name(c: Column) -> Column:
    """Folded, lower case, every other character a blank, stripped; inner runs of blanks stay."""
    return F.trim(F.regexp_replace(F.lower(fold_accents(c)), "[^a-z0-9 ]", " "))


def clean_marker(c: Column) -> Column:
    """The name in a speaker's marker: article, form of address, last bracket and one title word dropped in that order."""
    s = F.regexp_replace(c, rf"(?iU)^{BLANK}*(?:o|a){BLANK}+", "")
    s = F.regexp_replace(s, rf"(?iU)^{BLANK}*(?:sr\.?|sra\.?){BLANK}+", "")
    s = F.regexp_replace(s, rf"(?U){BLANK}*\([^)]*\){BLANK}*$", "")
    s = F.regexp_replace(s, rf"(?iU)^{BLANK}*(?:{MARKER_TITLES}){BLANK}+", "")
    return F.btrim(s, F.lit(" -:"))


def tokens(c: Column, least: int = 1) -> Column:
    """Distinct blank-separated words of at least ``least`` characters."""
    return F.array_distinct(F.filter(F.split(c, " +"), lambda t: F.length(t) >= least))


def contains_name(marker_tokens: Column, name_tokens: Column) -> Column:
    """Whether a registered name (its words of three letters and more) is contained in a marker."""
    return (F.size(name_tokens) > 0) & (F.size(F.array_except(name_tokens, marker_tokens)) == 0)


def affiliation(c: Column) -> Column:
    """Party in an office such as ``Deputado (PT-SP)``; everybody else belongs to the catch-all."""
    # Fixed value: the form of an office with its party.
    party = F.nullif(F.regexp_extract(c, r"(?iU)(?:Deputad[ao]|Senador[a]?)\s*\(\s*([^-]+?)\s*-\s*[A-Za-z]{2}\s*\)", 1), F.lit(""))
    return F.coalesce(strip(F.upper(party)), F.lit(NO_PARTY))


def sentences(c: Column) -> Column:
    """Cut at white space behind a full stop, exclamation or question mark."""
    return F.split(strip(c), rf"(?U)(?<=[.!?]){BLANK}+")


def pack(c: Column, limit: int = 1000) -> Column:
    """Sentences packed in order into chunks of at most ``limit`` characters; a longer sentence stays whole."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, s: Column) -> Column:
        both = F.trim(F.concat_ws(" ", acc["now"], s))
        full = (acc["now"] != "") & (F.length(both) > limit)
        return F.struct(F.when(full, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]).alias("done"), F.when(full, s).otherwise(both).alias("now"))

    packed = F.aggregate(sentences(c), empty, step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])))
    return F.when(strip(text_or_empty(c)) == "", F.array().cast("array<string>")).otherwise(packed)


def prefixed_lines(c: Column, prefix: str = "PROP:") -> Column:
    """Lines that start exactly with the prefix, all its occurrences removed, stripped."""
    lines = F.filter(F.split(strip(c), "\n"), lambda s: F.startswith(s, F.lit(prefix)))
    return F.transform(lines, lambda s: strip(F.replace(s, F.lit(prefix), F.lit(""))))


def split_list(c: Column, separator: str = r"\|") -> Column:
    """A joined list apart again, blank parts dropped."""
    return F.filter(F.transform(F.split(c, separator), lambda s: strip(s)), lambda s: s != "")


def stance(c: Column) -> Column:
    """The stance in a free answer: for before against before neutral."""
    s = F.upper(strip(c))
    return F.when(s.contains("FAVOR"), "A FAVOR").when(s.contains("CONTRA"), "CONTRA").otherwise("NEUTRO")
