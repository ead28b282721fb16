"""Subject areas of documents by classifier chains.

1. *Terms.* Every document is cleaned (broken encodings, accents, odd characters,
   annotations, hesitations) and split into sentences; a sentence is its words and
   word pairs. From labelled documents an expectation-maximisation over sentences
   learns what each term says about each area, with a class for sentences that are
   about none. The labels name areas of documents, not of sentences, and some are
   wrong; the sentence posteriors settle both.
2. *Chain.* For each area in a fixed order a logistic classifier reads the shares of
   the document's sentences that the terms give to the areas, how often its source
   and type of text carry the area, how many sentences there are, and the decisions
   for the areas before it, so that areas that go together or exclude each other are
   modelled. Its probabilities are calibrated on the part of the labels that was not
   trained on. A beam search decodes the most probable combination, which is the
   result.

The classifier is fitted on at most ``LABELLED`` labelled documents (those with the
least hash; a documented bound that keeps the fit in one task). Everything else sees
every document, in Arrow batches next to the scan.

Defined results: null and blank texts have no area; documents without any sentence
about an area have none; a label repeated counts once, null labels and labels of
unknown areas are ignored; without labels nothing is found; ties between areas in a
sentence split it evenly.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tribuna.llm.canon import mended
from tribuna.llm.sentences import units
from tribuna.llm.speakers import FORMAL, HESITATION, unmarked

SHARE = 1 / 3
LABELLED = 10_000
SLOTS = 1 << 20
ROUNDS = 4
BEAM = 8
ODD = re.compile(r"[­​-‏‪-‮⁠︀-️﻿\U0001f000-\U0001faff☀-➿]+")
#: A private character that no pattern here takes for a letter or a blank.
SEPARATOR = "\ue000"
DIGITS = re.compile("[0-9]+")
MARKS = re.compile("[\u0300-\u036f]+")
TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,60}>")
WORD = re.compile(r"[^\W\d_]+|\ue000")


def clean(text: str) -> str:
    """A text as it can be read: encodings mended, compatibility forms folded, odd characters gone."""
    s = ODD.sub(" ", unicodedata.normalize("NFC", mended(text)))
    if "<" in s or "&" in s:
        s = unmarked(html.unescape(TAG.sub(" ", s)))
    # A speaker's label says who speaks, not what about.
    return FORMAL.sub("\n", unmarked(s))


def fold(s: str) -> str:
    return MARKS.sub("", unicodedata.normalize("NFKD", s)).lower()


class Slots(dict):
    """Hashed words, remembered: twice the slot, plus one for words of three letters and more."""

    def __missing__(self, word: str) -> int:
        value = zlib.crc32(word.encode()) % SLOTS * 2 + (len(word) > 2)
        if len(self) < 500_000:
            self[word] = value
        return value


SLOT = Slots({SEPARATOR: -1})
WIDE = 8 * SLOTS


def parts(text: str | None) -> list[np.ndarray]:
    """The terms of every sentence of a text: hashed words of three letters and more, and hashed pairs of neighbouring words.

    Digits are no part of a word, so sentences that differ in them are alike.
    """
    if not isinstance(text, str) or not text.strip():
        return []
    s = clean(text)
    whole = SEPARATOR.join(s[a:b] for a, b in units(s, lines=True))
    words = WORD.findall(DIGITS.sub("", fold(HESITATION.sub("", whole))))
    code = np.fromiter((SLOT[w] for w in words), np.int64, len(words))
    gap = code < 0
    owner, h = np.cumsum(gap), code >> 1
    one = (code & 1).astype(bool) & ~gap
    two = ~gap[:-1] & ~gap[1:]
    both = SLOTS + (h[:-1][two] * 1_000_003 + h[1:][two]) % (7 * SLOTS)
    found = np.unique(np.concatenate([owner[one] * WIDE + h[one], owner[:-1][two] * WIDE + both]))
    if not len(found):
        return []
    sentence = found // WIDE
    return np.split(found % WIDE, np.flatnonzero(np.diff(sentence)) + 1)


@dataclass
class Model:
    areas: list[str]
    slots: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # known terms, ascending
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # log-odds by term and area
    sources: dict[str, np.ndarray] = field(default_factory=dict)
    kinds: dict[str, np.ndarray] = field(default_factory=dict)
    base: np.ndarray = field(default_factory=lambda: np.zeros(0))
    chain: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    calibration: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))

    # -- sentences --

    def scores(self, sentences: list[np.ndarray]) -> np.ndarray:
        """What the terms of each sentence say about each area: sentences by areas."""
        said = np.zeros((len(sentences), len(self.areas)))
        if not len(self.slots) or not sentences:
            return said
        every = np.concatenate(sentences)
        at = np.minimum(np.searchsorted(self.slots, every), len(self.slots) - 1)
        known = self.slots[at] == every
        owner = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])[known]
        np.add.at(said, owner, self.weights[at[known]])
        return said

    def shares(self, docs: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Share of each area among the sentences of each document that have one (documents by areas), and their number.

        A sentence counts for its best area, split among ties, and for none where nothing stands out.
        """
        said = self.scores([s for d in docs for s in d])
        p = np.zeros((len(docs), len(self.areas)))
        if said.size:
            best = said.max(axis=1, keepdims=True)
            top = (said >= best - 1e-9) & (best >= THRESHOLD)
            np.add.at(p, np.repeat(np.arange(len(docs)), [len(d) for d in docs]), top / np.maximum(top.sum(axis=1, keepdims=True), 1))
        n = p.sum(axis=1)
        return p / np.where(n > 0, n, 1)[:, None], n

    # -- documents --

    def features(self, docs: list[list[np.ndarray]], sources: list[str | None], kinds: list[str | None]) -> np.ndarray:
        """What the chain reads: documents by areas by features."""
        share, n = self.shares(docs)
        prior = np.array([self.sources.get(s or "", self.base) for s in sources]).reshape(share.shape) - self.base
        form = np.array([self.kinds.get(k or "", self.base) for k in kinds]).reshape(share.shape) - self.base
        size, some = (np.repeat(x[:, None], len(self.areas), axis=1) for x in (np.log1p(n), (n > 0).astype(float)))
        return np.stack([np.ones(share.shape), share, (share >= SHARE - 1e-9).astype(float), np.clip((share - SHARE) * 6, -1, 1), np.clip((share - SHARE) * 60, -1, 1), prior, form, size, some], axis=2)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The most probable combination of areas of each document, by beam search along the chain: the ``BEAM`` best beginnings are kept."""
        n, m, k = x.shape
        own = self.calibration[:, 0] * np.einsum("nmk,mk->nm", x, self.chain[:, :k]) + self.calibration[:, 1]
        after = self.calibration[:, :1] * self.chain[:, k:]
        logp, on = np.zeros((n, 1)), np.zeros((n, 1, m))
        for j in range(m):
            z = np.clip(own[:, j, None] + on @ after[j], -30, 30)
            yes, no = on.copy(), on
            yes[:, :, j] = 1
            logp = np.concatenate([logp - np.log1p(np.exp(-z)), logp - np.log1p(np.exp(z))], axis=1)
            on = np.concatenate([yes, no], axis=1)
            best = np.argsort(-logp, axis=1, kind="stable")[:, :BEAM]
            logp, on = np.take_along_axis(logp, best, 1), np.take_along_axis(on, best[:, :, None], 1)
        return on[:, 0]

    def areas_of(self, docs: list[list[np.ndarray]], sources: list[str | None], kinds: list[str | None]) -> list[list[str]]:
        """The decoded areas of each document; one without any sentence about an area has none."""
        if not len(self.slots) or not docs:
            return [[] for _ in docs]
        x = self.features(docs, sources, kinds)
        y = self.decode(x) * x[:, :, -1]
        return [[self.areas[j] for j in np.flatnonzero(r)] for r in y]


THRESHOLD = 1.0


def fit_terms(model: Model, docs: list[tuple[list[np.ndarray], np.ndarray]], rounds: int = ROUNDS) -> None:
    """Expectation-maximisation over sentences: ``docs`` are (sentences, 0/1 labels)."""
    m = len(model.areas)
    flat = [s for sents, _ in docs for s in sents]
    if not flat:
        return
    length = np.array([len(s) for s in flat])
    owner = np.repeat(np.arange(len(flat)), length)
    every = np.concatenate(flat)
    slots, at, df = np.unique(every, return_inverse=True, return_counts=True)
    keep = df >= 3
    renumber = np.cumsum(keep) - 1
    use = keep[at]
    owner, at = owner[use], renumber[at[use]]
    slots = slots[keep]
    label = np.concatenate([np.tile(y, (len(sents), 1)) for sents, y in docs if len(sents)])
    prior = label / np.maximum(label.sum(axis=1, keepdims=True), 1)
    q = prior.copy()  # first guess: every sentence is about the areas of its document
    for r in range(rounds):
        area = q.sum(axis=0) + 1e-6
        base = area / len(flat)
        count = np.zeros((len(slots), m))
        for j in range(m):
            count[:, j] = np.bincount(at, weights=q[owner, j], minlength=len(slots))
        seen = np.bincount(at, minlength=len(slots)).astype(float)
        # A term speaks for an area if it is found with it far more often than chance: by the
        # lower bound of its rate, not the rate, so rare words do not speak by accident.
        rate = (count + 0.5) / (seen[:, None] + 1)
        low = rate - 1.64 * np.sqrt(rate * (1 - rate) / (seen[:, None] + 1))
        w = np.where(low > (0.25 if r == 0 else 0.45), np.log(np.maximum(low, 1e-9) / base), 0.0)
        w = np.maximum(w, 0.0)
        s = np.zeros((len(flat), m))
        for j in range(m):
            s[:, j] = np.bincount(owner, weights=w[at, j], minlength=len(flat))
        # Areas the document is not labelled with stay possible: some labels are missing or wrong.
        s_doc = s + np.where(label > 0, 0.0, -1.0)
        best = s_doc.max(axis=1)
        q = np.zeros_like(s)
        hit = best > THRESHOLD / 2
        q[np.flatnonzero(hit), s_doc[hit].argmax(axis=1)] = 1.0
    informative = (w > 0).any(axis=1)
    model.slots, model.weights = slots[informative], w[informative]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(areas: list[str], docs: list[tuple[list[np.ndarray], set[str], str | None, str | None]]) -> Model:
    """The whole model from labelled documents: (sentences, areas, source, type). Every fifth is kept for calibration."""
    model = Model(sorted(areas))
    index = {a: j for j, a in enumerate(model.areas)}
    m = len(index)
    docs = [d for d in docs if d[0]]
    if not docs or not m:
        return model
    label = np.zeros((len(docs), m))
    for i, d in enumerate(docs):
        for a in d[1]:
            label[i, index[a]] = 1
    fit_terms(model, [(d[0], y) for d, y in zip(docs, label)])
    model.base = label.mean(axis=0)
    for table, k in ((model.sources, 2), (model.kinds, 3)):
        for value in {d[k] for d in docs if d[k]}:
            rows = label[[i for i, d in enumerate(docs) if d[k] == value]]
            table[value] = (rows.sum(axis=0) + 20 * model.base) / (len(rows) + 20)
    x = model.features([d[0] for d in docs], [d[2] for d in docs], [d[3] for d in docs])
    held = np.arange(len(docs)) % 5 == 4
    k = x.shape[2]
    model.chain, model.calibration = np.zeros((m, k + m)), np.tile([1.0, 0.0], (m, 1))
    for j in range(m):
        before = label.copy()
        before[:, j:] = 0
        z = np.concatenate([x[:, j], before], axis=1)
        model.chain[j] = _logistic(z[~held], label[~held, j], ridge=1.0)
        if 0 < label[held, j].sum() < held.sum():
            raw = z[held] @ model.chain[j]
            b, a = _logistic(np.stack([np.ones(held.sum()), raw], axis=1), label[held, j], ridge=0.1)
            if a > 0.1:
                model.calibration[j] = (a, b)
    return model


def subject_areas(documents: DataFrame, labels: DataFrame, areas: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", kind: str = "tipo", area: str = "area", labelled: int = LABELLED) -> DataFrame:
    """(key, area) of every document: none, one or several rows."""
    names = [r[0] for r in areas.select(area).where(F.col(area).isNotNull()).distinct().collect()]
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(source).alias("source"), F.col(kind).alias("kind")).where("key is not null")
    kept = labels.select(F.col(key).alias("key"), F.col(area).alias("area")).where(F.col("key").isNotNull() & F.col("area").isin(names)).groupBy("key").agg(F.sort_array(F.collect_set("area")).alias("areas"))
    # The sample's keys are bounded by ``labelled``, so they go to the texts and not the texts to them.
    sample = rows.join(F.broadcast(kept.orderBy(F.xxhash64("key"), "key").limit(labelled)), "key").dropDuplicates(["key"]).select("key", "text", "source", "kind", "areas")

    def learn(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import pickle

        pdf = pdf.sort_values("key")
        model = fit(names, [(parts(t), set(a), s, k) for t, a, s, k in zip(pdf["text"], pdf["areas"], pdf["source"], pdf["kind"])])
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    fitted = sample.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(learn, "model binary").collect()
    held = documents.sparkSession.sparkContext.broadcast(bytes(fitted[0][0]) if fitted else b"")

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        model = pickle.loads(held.value) if held.value else Model([])  # noqa: S301
        for pdf in batches:
            found = model.areas_of([parts(t) for t in pdf["text"]], pdf["source"].tolist(), pdf["kind"].tolist())
            yield pd.DataFrame([(i, a) for i, areas_ in zip(pdf["key"], found) for a in areas_], columns=["key", "area"])

    type_ = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(classify, f"key {type_}, area string").distinct()
