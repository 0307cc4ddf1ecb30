"""Toxicity by a lexicon that forgives misspelling and looks at the words around a hit.

Terms are learned from labels: whole words and word beginnings that toxic documents hold and others do not.  They
form a trie; a Levenshtein automaton of each word of a text is run against it, so a term is found with one edit (two
in long terms) in one walk over the shared beginnings.  A window around a hit tells abuse from quotation: inside
quotation marks or after a word of reporting it counts little, next to an address it counts more.  A logistic
regression turns the summed strength of the hits into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.segments import Memory
from hearthline.storage import materialize

#: Bounds of what is learned: labelled documents that training sees, and terms that it keeps.
SAMPLE, TERMS = 10_000, 500
#: A term needs so many toxic documents, so large a share of toxic among its documents, and so many that chance would
#: hardly bring them together (natural logarithm).
SUPPORT, PURITY, CHANCE = 5, 0.95, 5.0
SHORTEST, LONGEST = 4, 12
WINDOW = 8

#: Words of reporting and of address, and quotation marks.
REPORTING = frozenset("said says called calls wrote quote quoted quotes word term sagte schrieb nannte wort dit appelle mot dijo escribió llamó palabra".split())
ADDRESS = frozenset("you your you're u ur du dich dir dein ihr euch tu te toi ton vous usted tú eres".split())
QUOTES = "\"“”„«»‹›"

EDGE = re.compile(r"^[^\w*@$]+|[^\w*@$]+$")
QUOTED, ADDRESSED, MISSPELLED = 0.35, 1.25, 0.7


def tokens(text: str) -> list[str]:
    return text.lower().split()


def core(token: str) -> str:
    """A token without the marks around it."""
    return EDGE.sub("", token)


def edits(term: str, whole: bool) -> int:
    """Edits a term forgives: a short one none, as a beginning less than as a word."""
    length = len(term) if whole else len(term) - 2
    return 0 if length < 5 else 1 if length < 9 else 2


@dataclass
class Lexicon:
    """Terms (whole word or beginning) with the trust in their misspelled forms, as a trie."""

    terms: list[tuple[str, bool]]
    trust: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.trust = self.trust or [MISSPELLED] * len(self.terms)
        self.trie: dict = {}
        starts, ends, inner = set(), set(), set()
        for i, (term, whole) in enumerate(self.terms):
            node = self.trie
            for c in term:
                node = node.setdefault(c, {})
            node.setdefault("", []).append(i)
            # With k edits one of k + 1 parts is intact: the first at the start, the last at the end, others anywhere.
            k = edits(term, whole)
            cuts = [round(len(term) * j / (k + 1)) for j in range(k + 2)]
            parts = [term[a:b] for a, b in zip(cuts, cuts[1:])]
            starts.add(parts[0])
            inner.update(parts[1:-1] if whole else parts[1:])
            if whole and k:
                ends.add(parts[-1])
        sides = [("^(?:{})", starts), ("(?:{})$", ends), ("(?:{})", inner)]
        said = "|".join(form.format("|".join(map(re.escape, sorted(some)))) for form, some in sides if some)
        self.maybe = re.compile(said or r"(?!)")

    def match(self, word: str) -> tuple[int, int] | None:
        """The closest term (its number, edits) of a word: fewest edits, then longest term, then first."""
        if not word or not self.maybe.search(word):
            return None
        found = [(e, -len(self.terms[i][0]), i) for i, e in self._walk(word)]
        if not found:
            return None
        e, _, i = min(found)
        return i, e

    def _walk(self, word: str) -> Iterator[tuple[int, int]]:
        n, most = len(word), 2

        def closed(states: dict[int, int]) -> dict[int, int]:
            """States reached by leaving out characters of the word too: position -> fewest edits."""
            for i in range(min(states), n):
                if i in states and states[i] < most:
                    states[i + 1] = min(states.get(i + 1, most + 1), states[i] + 1)
            return states

        stack = [(self.trie, closed({0: 0}))]
        while stack:
            node, states = stack.pop()
            for i in node.get("", ()):
                term, whole = self.terms[i]
                e = states.get(n, most + 1) if whole else min(states.values())
                if e <= edits(term, whole):
                    yield i, e
            for c, below in node.items():
                if c:
                    after: dict[int, int] = {}
                    for i, e in states.items():
                        if i < n:
                            cost = e + (word[i] != c)
                            if cost <= most:
                                after[i + 1] = min(after.get(i + 1, most + 1), cost)
                        if e < most:
                            after[i] = min(after.get(i, most + 1), e + 1)
                    if after:
                        stack.append((below, closed(after)))


def context(words: list[str], at: int) -> float:
    """Factor of a hit from the words around it."""
    low = max(0, at - WINDOW)
    before, after = words[low:at], words[at + 1 : at + 1 + WINDOW]
    marks = lambda some: sum(w.count(q) for w in some for q in QUOTES)
    own = words[at]
    opened = marks(before) + sum(own.rstrip(QUOTES + ".,!?;:").count(q) for q in QUOTES)
    closed = marks(after) + sum(own.lstrip(QUOTES).count(q) for q in QUOTES)
    if opened % 2 and closed or any(core(w) in REPORTING for w in words[max(0, at - 3) : at]):
        return QUOTED
    near = words[max(0, at - 3) : at] + words[at + 1 : at + 4]
    return ADDRESSED if any(core(w) in ADDRESS for w in near) else 1.0


Hit = tuple[int, int, float]


class Finder:
    """Hits of texts; each distinct word is matched once while it is remembered."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.known = lexicon, Memory(lambda w: lexicon.match(core(w)), limit=250_000)

    def hits(self, text: str | None) -> list[Hit]:
        """(term, edits, context factor) of each hit of a whole text."""
        words = tokens(text or "")
        return [(m[0], m[1], context(words, i)) for i, m in enumerate(map(self.known.__getitem__, words)) if m]


def strength(hits: list[Hit], trust: list[float]) -> float:
    return sum(f * (1.0 if e == 0 else trust[i] ** e) for i, e, f in hits)


def row_of(strengths: np.ndarray) -> np.ndarray:
    """Inputs of the regression: a constant, the strength up to one, and the logarithm of the rest."""
    return np.stack([np.ones(len(strengths)), np.minimum(strengths, 1), np.log1p(np.maximum(strengths - 1, 0))], 1)


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def scores(self, strengths: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(row_of(strengths) @ self.weights, -30, 30)))


def regress(strengths: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights by Newton steps with a small ridge; without both labels only strength speaks."""
    if len(set(labels.tolist())) < 2:
        return np.array([-3.0, 5.0, 1.0])
    x, w = row_of(strengths), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = 0.1 * np.diag([0.0, 1.0, 1.0])
        w = w + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge + 1e-6 * np.eye(3), x.T @ (labels - p) - ridge @ w)
    return w


def held_out(id_column: str) -> Column:
    """Whether a row's label may not be learned from; false for a null id, which has no label."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_texts(df: DataFrame, labels: DataFrame, id_column: str, text: str, label: str, limit: int) -> DataFrame:
    """``(text, toxic)`` of at most ``limit`` labelled documents that are not held out, those with the lowest id hash."""
    some = labels.where(~held_out(id_column) & F.col(label).isNotNull() & F.col(id_column).isNotNull())
    some = some.groupBy(F.col(id_column).alias("_id")).agg(F.max(label).alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(limit)
    texts = df.select(F.col(id_column).alias("_id"), F.col(text).alias("text"))
    # The sample has a fixed bound, so it may go to every task.
    some_texts = texts.join(F.broadcast(some), "_id").select("text", "toxic")
    # Copies share all their words, also those that do not make them toxic: of documents with one smallest hash of
    # three words, and one label, one is learned from.
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "")
    spots = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_words") - 3))
    least = F.array_min(F.transform(spots, lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))))
    marked = some_texts.withColumn("_words", words).withColumn("_least", least)
    return marked.dropDuplicates(["_least", "toxic"]).select("text", "toxic")


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of each label that hold a word or a beginning, summed per task."""
    bad, good = Counter(), Counter()
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"]):
            words = {core(w) for w in tokens(text or "")}
            held = {w + "$" for w in words if len(w) >= SHORTEST} | {w[:k] for w in words for k in range(SHORTEST, min(LONGEST, len(w)) + 1)}
            (bad if toxic else good).update(held)
    # A term that no toxic document of this task holds may be one that those of another do.
    every = list(bad.keys() | good.keys())
    for low in range(0, len(every), 100_000):
        part = every[low : low + 100_000]
        yield pd.DataFrame({"term": part, "bad": [bad[t] for t in part], "good": [good[t] for t in part]})


def choose(counts: dict[str, tuple[int, int]], limit: int = TERMS) -> list[tuple[str, bool]]:
    """Terms from ``term -> (toxic, other documents)``; a word ends in ``$``, a beginning does not.

    The shortest pure beginning of its kind is taken, then made as long as its toxic documents allow.
    """
    pure = {t: c for t, c in counts.items() if c[0] >= SUPPORT and c[0] >= PURITY * (c[0] + c[1] + 0.25)}
    out: dict[str, int] = {}
    for term in sorted(pure, key=lambda t: (len(t), t)):
        if any(term[:k] in pure for k in range(SHORTEST, len(term)) if term[:k] != term):
            continue
        best = term
        for longer in sorted((t for t in pure if t.startswith(term)), key=len):
            if pure[longer][0] >= 0.97 * pure[term][0] and longer.startswith(best):
                best = longer
        out[best] = pure[term][0]
    ranked = sorted(out, key=lambda t: (-out[t], t))[:limit]
    return [(t.removesuffix("$"), t.endswith("$")) for t in ranked]


def learn(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = SAMPLE) -> Model:
    """Lexicon, trust and weights from a bounded sample of labelled documents outside the held-out third."""
    sample = materialize(training_texts(df, labels, id_column, text, label, limit), "labelled")
    counts = sample.mapInPandas(_candidates, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    size, toxic = sample.agg(F.count("*"), F.count(F.when(F.col("toxic") > 0, 1))).first()
    rate = min(0.9, max(toxic, 1) / max(size, 1))
    # So many toxic documents in a row would come by chance to less than one term in e^CHANCE tables of this size.
    least = max(SUPPORT, (math.log(1 + size * 1000) + CHANCE) / -math.log(rate))
    counts = counts.where((F.col("bad") >= least) & (F.col("bad") >= PURITY * (F.col("bad") + F.col("good") + 0.25)))
    rows = counts.orderBy(F.desc("bad"), F.length("term"), "term").limit(40 * TERMS).collect()
    terms = choose({r["term"]: (r["bad"], r["good"]) for r in rows})
    lexicon = Lexicon(terms)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(lexicon)
        for batch in batches:
            found = [finder.hits(t) for t in batch["text"]]
            parts = {"toxic": batch["toxic"], "terms": [[h[0] for h in f] for f in found], "edits": [[h[1] for h in f] for f in found], "factors": [[h[2] for h in f] for f in found]}
            yield pd.DataFrame(parts)

    seen = sample.mapInPandas(look, "toxic int, terms array<int>, edits array<int>, factors array<double>").collect()
    bad, good = Counter(), Counter()
    for r in seen:
        (bad if r["toxic"] else good).update({i for i, e in zip(r["terms"], r["edits"]) if e})
    lexicon.trust = [MISSPELLED * (bad[i] + 1) / (bad[i] + good[i] + 1) for i in range(len(lexicon.terms))]
    strengths = np.array([strength(list(zip(r["terms"], r["edits"], r["factors"])), lexicon.trust) for r in seen])
    return Model(lexicon, regress(strengths, np.array([float(r["toxic"] > 0) for r in seen])))


def with_score(df: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """Add the toxicity score of a whole text, 0 to 1; a null text scores like an empty one."""

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(model.lexicon)
        for batch in batches:
            found = np.array([strength(finder.hits(t if isinstance(t, str) else None), model.lexicon.trust) for t in batch], float)
            yield pd.Series(model.scores(found) if len(found) else [], dtype=float)

    return df.withColumn(name, F.pandas_udf(each, "double")(F.col(text)))
