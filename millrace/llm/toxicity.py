"""Toxicity by a learned lexicon: Levenshtein automata over a trie of terms, and windows around what they catch.

Labels say which words and word beginnings stand in toxic texts only. A trie of these is intersected with automata that
allow an edit in longer words; its states are built when they are first reached, so a word costs one table look-up per
letter until it can match no more. A window around each catch tells quotation from address, and a logistic regression
on counts of catches and windows gives the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import each, hash_sample, id_of, key_of, materialize, text_of

#: Letters, and digits or symbols between letters, as in misspellings that put them for a letter.
WORD = re.compile(r"[^\W\d_]+(?:[\d@$*!|+]{1,2}[^\W\d_]+)*")
#: Fixed lists: words before a quotation, and words that speak to somebody.
SAYING = frozenset("said says say called quote quoted quotes wrote claimed dijo llamado dit appelle sagte nannte".split())
ADDRESS = frozenset("you your you're are are u ur du ihr bist dich tu vous es te eres usted".split())
#: Fixed list: marks that open a quotation, each with those that close it.
MARKS = (('"', '"'), ("“", "”"), ("„", "“”"), ("«", "»"), ("‹", "›"), ("‘", "’"))
#: Letters on either side of a catch among which a quotation's marks are looked for.
_AROUND = 40
_STEM_LEAST, _STEM_MOST, _TERM_LEAST = 4, 8, 4
_DEAD = -1


class Lexicon:
    """A lazily built automaton for the words within ``edits`` of a term, or that begin with a stem.

    A state is a set of (trie node, edits spent). Terms of five letters or more allow one edit (a letter changed, lost
    or added), shorter ones and stems none.
    """

    def __init__(self, terms: list[str], stems: list[str], clean: frozenset[str] = frozenset(), exact: list[str] = (), edits: int = 1) -> None:
        self.clean = clean
        self.child: list[dict[str, int]] = [{}]
        self.allowed: list[int] = [0]
        self.ends: dict[int, int] = {}
        self.stem: set[int] = set()
        plain = {*exact}
        for term in terms:
            k = edits if len(term) >= 5 and term not in plain else 0
            self.ends[self._add(term, k)] = k
        for stem in stems:
            self.stem.add(self._add(stem, 0))
        self.state: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.found: list[int] = []  # by state: edits of the best term that ends here, 2 for a stem, -1 for none
        self.start = self._number(self._closed({(0, 0)}))

    def _add(self, term: str, k: int) -> int:
        node = 0
        self.allowed[0] = max(self.allowed[0], k)
        for c in term:
            if c not in self.child[node]:
                self.child[node][c] = len(self.child)
                self.child.append({})
                self.allowed.append(0)
            node = self.child[node][c]
            self.allowed[node] = max(self.allowed[node], k)
        return node

    def _closed(self, items: set[tuple[int, int]]) -> frozenset:
        """With the states that skip letters of terms."""
        todo = list(items)
        while todo:
            node, e = todo.pop()
            for n in self.child[node].values():
                if e < self.allowed[n] and (n, e + 1) not in items:
                    items.add((n, e + 1))
                    todo.append((n, e + 1))
        return frozenset(items)

    def _number(self, items: frozenset) -> int:
        if not items:
            return _DEAD
        if items not in self.state:
            self.state[items] = len(self.sets)
            self.sets.append(items)
            self.step.append({})
            hits = [e for n, e in items if n in self.ends and e <= self.ends[n]]
            self.found.append(2 if any(n in self.stem and e == 0 for n, e in items) else min(hits, default=-1))
        return self.state[items]

    def _next(self, s: int, c: str) -> int:
        out = set()
        for node, e in self.sets[s]:
            if c in self.child[node]:
                out.add((self.child[node][c], e))
            if e < self.allowed[node]:
                out.add((node, e + 1))
            for n in self.child[node].values():
                if e < self.allowed[n]:
                    out.add((n, e + 1))
        t = self._number(self._closed(out))
        self.step[s][c] = t
        return t

    def match(self, word: str) -> int:
        """0: a term; 1: a term with an edit; 2: a stem's word; -1: none of them."""
        s, step, found = self.start, self.step, self.found
        for c in word:
            t = step[s].get(c)
            if t is None:
                t = self._next(s, c)
            if t < 0:
                return -1
            if found[t] == 2:
                return 2
            s = t
        kind = found[s]
        return -1 if kind == 1 and word in self.clean else kind


@dataclass
class Model:
    """What scoring needs: terms, stems, clean words near a term, terms without edits, and the regression's weights."""

    terms: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    clean: frozenset[str] = frozenset()
    exact: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.array([-4.0, 0, 0, 0, 0, 0, 0]))


def quoted(before: str, after: str) -> bool:
    """Whether a quotation is open at the end of what stands before, and closes in what follows."""
    for opens, closes in MARKS:
        if opens in before and any(c in after for c in closes):
            if opens in closes and before.count(opens) % 2 or opens not in closes and before.rfind(opens) > max(before.rfind(c) for c in closes):
                return True
    return False


def catch_features(text: str, lexicon: Lexicon) -> list[float]:
    """1, then logarithms of: terms, with an edit or without, stems, distinct catches; shares quoted and addressed; 1 if any."""
    low = text.lower()
    match = lexicon.match
    caught = {w: k for w in set(WORD.findall(low)) if (k := match(w)) >= 0}
    if not caught:
        return [1.0, 0, 0, 0, 0, 0, 0]
    kinds, in_quotes, addressed = [0, 0, 0], 0, 0
    spans = [(m.start(), m.end(), m[0]) for m in WORD.finditer(low)]
    for i, (a, b, w) in enumerate(spans):
        kind = caught.get(w)
        if kind is None:
            continue
        kinds[kind] += 1
        before = [x for _, _, x in spans[max(0, i - 5) : i]]
        in_quotes += any(x in SAYING for x in before) or quoted(low[max(0, a - _AROUND) : a], low[b : b + _AROUND])
        addressed += any(x in ADDRESS for x in before) or any(x in ADDRESS for _, _, x in spans[i + 1 : i + 4])
    n = sum(kinds)
    return [1.0, math.log1p(kinds[0] + kinds[1]), math.log1p(kinds[2]), math.log1p(len(caught)), in_quotes / n, addressed / n, 1.0]


def _sketch(text: str) -> int:
    """The least hash of the text's 5-word shingles: near copies mostly share it, so that they count once."""
    words = text.lower().split()
    return min((xxhash.xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))), default=0) - 2**63


def within_one(a: str, b: str) -> bool:
    """Whether one letter changed, lost or added makes a word of the other."""
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return len(b) - len(a) <= 1 and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :])


def neighbours(terms: list[str], words: list[str]) -> dict[str, int]:
    """How many of the words are an edit from each term. Such words become equal when each loses a letter at most."""
    shorter = lambda w: {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}
    index: dict[str, list[str]] = {}
    for t in terms:
        for x in shorter(t):
            index.setdefault(x, []).append(t)
    found = dict.fromkeys(terms, 0)
    for w in words:
        for t in {t for x in shorter(w) for t in index.get(x, ()) if t != w and within_one(t, w)}:
            found[t] += 1
    return found


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and word beginnings of each text, once each."""
    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = sorted({*WORD.findall(text.lower())})
            stems: dict[str, str] = {}
            for w in words:
                for k in range(_STEM_LEAST, min(len(w), _STEM_MOST) + 1):
                    stems.setdefault(f"{w[:k]}*", w)
            names, via = [*words, *stems], [*words, *stems.values()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(via, pa.string()), pa.array([_sketch(text)] * len(names), pa.int64()), pa.array([toxic] * len(names), pa.int32())], names=["term", "via", "sketch", "toxic"])


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1


def learn(docs: DataFrame, labels: DataFrame, *, sample: int = 6000, least: int = 6, crowd: int = 3) -> Model:
    """A model from at most ``sample`` labelled rows that are not held out, taken in the order of a hash of doc_id.

    A term needs ``least`` toxic texts that are no near copies of each other and almost no clean ones. Clean words an edit
    from a term are no misspellings of it; a term with ``crowd`` of them allows no edit. The sample alone bounds the terms
    and such words that come to the driver, and the seven numbers for each of its rows.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = hash_sample(known, ["doc_id", "toxic"], sample).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic").distinct()
    texts = materialize(texts)
    total = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not total.get(1) or not total.get(0):
        return Model(weights=np.array([math.log((total.get(1, 0) + 0.5) / (total.get(0, 0) + 0.5)), 0, 0, 0, 0, 0, 0]) if total else Model().weights)
    counts = texts.mapInArrow(_terms, "term string, via string, sketch long, toxic int").groupBy("term").agg(F.count_distinct(F.when(F.col("toxic") == 1, F.col("sketch"))).alias("bad"), F.count_distinct(F.when(F.col("toxic") == 0, F.col("sketch"))).alias("good"), F.count_distinct(F.when(F.col("toxic") == 1, F.col("via"))).alias("via"))
    odds = (F.col("bad") / F.lit(total[1])) / ((F.col("good") + 0.5) / F.lit(total[0]))
    single = ~F.col("term").endswith("*") & (F.char_length("term") >= _TERM_LEAST) & (F.col("bad") >= 2) & (F.col("good") <= 0.02 * F.col("bad"))
    family = F.col("term").endswith("*") & (F.col("bad") >= least) & (F.col("via") >= 4) & (F.col("good") <= 0.1 * F.col("bad"))
    found = counts.where((single | family) & (odds >= 20)).orderBy(F.desc("bad"), "term").collect()
    families = {r["term"][:-1]: r for r in found if r["term"].endswith("*")}
    stems: list[str] = []
    for t in sorted(families, key=lambda t: (len(t), t)):
        r = families[t]
        if r["good"] > 0.03 * r["bad"] or any(t.startswith(s) for s in stems):
            continue
        longer = [s for s in families if len(s) == len(t) + 1 and s.startswith(t) and families[s]["bad"] >= 0.97 * r["bad"]]
        if not longer:  # the longest beginning that all of these words share
            stems.append(t)
    support = {r["term"]: r["bad"] for r in found if not r["term"].endswith("*")}
    terms = [t for t, n in support.items() if (n >= least or any(t.startswith(f) for f in families)) and not any(t.startswith(s) for s in stems)]
    lexicon = Lexicon(terms, stems)
    near = [r["word"] for r in texts.where("toxic = 0").mapInArrow(_near(lexicon), "word string").distinct().orderBy("word").collect()]
    crowded = neighbours(terms, near)
    exact = [t for t in terms if support[t] < least or crowded[t] >= crowd]
    lexicon = Lexicon(terms, stems, frozenset(near), exact)
    rows = texts.mapInArrow(_train_rows(lexicon), "x array<double>, y double").collect()
    return Model(terms, stems, frozenset(near), exact, _fit(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])))


def _near(lexicon: Lexicon):
    """Words of clean texts that are an edit from a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = {w for t in each(batch.column("text")) for w in {*WORD.findall(t.lower())} if lexicon.match(w) == 1}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(words), pa.string())], names=["word"])

    return run


def _train_rows(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [catch_features(t, lexicon) for t in each(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic").cast(pa.float64())], names=["x", "y"])

    return run


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.terms, model.stems, model.clean, model.exact)
        for batch in batches:
            x = np.array([catch_features(t, lexicon) for t in each(batch.column("text"))]).reshape(-1, len(model.weights))
            score = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(score), pa.array(x[:, -1] > 0)], names=["key", "score", "caught"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, *, sample: int = 6000, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on) and caught (a term stands in the text).

    Only the text decides a score. Labels (doc_id, toxic) of documents whose crc32(doc_id as text) mod 3 is not 1 train;
    ``sample`` bounds how many of them. Rows that repeat a label count once, 1 before 0. Without toxic or without clean
    labels every text has one low score. A null or empty text is scored as one without terms. A null doc_id stays null
    and is not held out; repeated rows get a row each; other columns are ignored; an empty table gives an empty result.
    """
    model = learn(docs, labels, sample=sample)
    scored = docs.select(key_of().alias("key"), text_of().alias("text")).mapInArrow(_score(model), "key long, score double, caught boolean")
    return scored.select(id_of().alias("doc_id"), F.coalesce(held_out(id_of()), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "caught")
