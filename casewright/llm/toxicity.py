"""Toxicity scores: Levenshtein automata intersected with a lexicon trie, and context windows around each hit.

A lexicon of whole terms and of productive stems is learned from labelled rows.  Its trie is intersected with the
Levenshtein automata of its terms into one deterministic automaton, made as words meet it, which runs over all words of
a batch at once: a word ends in a state that tells the nearest term and its distance, so misspelled terms are met
without looking up any variant.  Around each hit a context window is read: quotation marks and reporting words near it speak for
quotation, address in the second person for abuse.  A misspelling counts nearly as its term unless clean rows hold it
too.  A ridge logistic over the hits' summed evidence gives the score.

Learned from labelled rows outside the held-out remainder alone, about ``learning.MAX_LABELLED`` at most; that bounds
the lexicon too, which holds every term that its evidence admits.  Whole texts are scored.

Defined results: a null text scores as the empty text; repeated rows score alike; without labelled rows of both
classes every score is the share of toxic labels (0 without any); other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.learning import fit_logistic, remainder, sigmoid, training_rows

MODULUS, HELD = 4, 2
THRESHOLD = 0.3
#: Size at which an automaton's table of transitions is begun anew.
TABLE_BYTES = 64 << 20
#: A word is a run of letters and digits, with these between them; anything else ends it.
INNER = "@$*!_'’"
WORD = re.compile(rf"[^\W_](?:[^\W_]|[{re.escape(INNER)}](?=[^\W_]))*")
STEM_LENGTHS = range(3, 9)
#: Words and marks that tell quotation from abuse.
QUOTES = frozenset("\"“”«»„‘`")
REPORTING = frozenset("said says say quote quoted quotes called calls wrote writes word words term terms slur reported".split())
ADDRESS = frozenset("you your yours yourself u ur youre".split())
WINDOW = 40  # characters on either side


def edits_for(term: str, most: int = 2) -> int:
    """Misspelling allowed in a term: none below 4 letters, one edit below 8, two from there on."""
    return min(most, 0 if len(term) < 4 else 1 if len(term) < 8 else 2)


@cache
def _letters() -> np.ndarray:
    """Which code points are letters or digits."""
    return np.array([chr(c).isalnum() for c in range(0x110000)])


class LexiconAutomaton:
    """The trie of terms and stems, intersected with the Levenshtein automata of the terms.

    States are sets of (trie node, edits so far).  They and their transitions are made as words meet them and kept in a
    table (state, class of letter), so the cost follows the words that occur, not the size of the product; a table of
    more than ``TABLE_BYTES`` is begun anew before the next text.  A class is a letter of the lexicon, or 1 for any
    other.  State 0 has no way on.  ``accepts[state]`` is -1 or index * 3 + distance of the nearest term that a word
    ending here is; a stem is met by any word that begins with it.
    """

    def __init__(self, terms: Iterable[str], stems: Iterable[str], edits=edits_for):
        self.terms, self.stems = list(terms), list(stems)
        self.names = self.terms + self.stems
        self.allowed = [edits(t) for t in self.terms] + [0] * len(self.stems)
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.reach = [0]  # edits allowed to the terms below a node
        self.loops: set[int] = set()
        for i, name in enumerate(self.names):
            at, stem = 0, i >= len(self.terms)
            for c in name + ("\0" if stem else ""):  # a stem's end is a node of its own
                self.reach[at] = max(self.reach[at], self.allowed[i])
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.reach.append(0)
                at = self.children[at][c]
            self.reach[at] = max(self.reach[at], self.allowed[i])
            self.ends[at] = i
            if stem:
                self.loops.add(at)
        self.letters = {c: k + 2 for k, c in enumerate(sorted({c for x in self.names for c in x}))}
        self.order = [None, None, *self.letters]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}  # each process makes its own states

    # --- states, made when they are met

    def _begin(self) -> None:
        first = self._closed([(0, 0)])
        self._states, self._index = [frozenset(), first], {frozenset(): 0, first: 1}
        self._table = np.full((1024, len(self.order)), -1, np.int32)
        self._table[0], self._table[:, 0] = 0, 0
        self._accepts = np.full(1024, -1, np.int32)
        self._accepts[1] = self._accept(first)

    def _closed(self, pairs: Iterable[tuple[int, int]]) -> frozenset:
        seen: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if seen.get(node, 99) <= e or (e > self.reach[node] and node not in self.loops):
                continue
            seen[node] = e
            for c, child in self.children[node].items():
                if c == "\0":
                    todo += [(child, 0)] * (e == 0)
                else:
                    todo.append((child, e + 1))  # a letter of the term is missing
        return frozenset(seen.items())

    def _onward(self, state: frozenset, c: str | None) -> frozenset:
        out = []
        for node, e in state:
            if node in self.loops:
                out.append((node, e))
                continue
            spent = e >= self.reach[node]  # nothing below allows another edit
            if not spent:
                out.append((node, e + 1))  # a letter too many
                out += [(child, e + (letter != c)) for letter, child in self.children[node].items() if letter != "\0"]
            elif c in self.children[node]:
                out.append((self.children[node][c], e))
        return self._closed(out)

    def _accept(self, state: frozenset) -> int:
        hits = [(e, self.ends[node]) for node, e in state if self.ends[node] >= 0 and (node in self.loops or e <= self.allowed[self.ends[node]])]
        if not hits:
            return -1
        e, i = min(hits)
        return i * 3 + e

    def _make(self, states: np.ndarray, classes: np.ndarray) -> None:
        """Fills in the transitions (state, class) that are not known yet."""
        width = len(self.order)
        for key in np.unique(states.astype(np.int64) * width + classes).tolist():
            k, j = divmod(key, width)
            to = self._onward(self._states[k], self.order[j])
            if to not in self._index:
                self._index[to] = n = len(self._states)
                self._states.append(to)
                if n == len(self._table):
                    self._table = np.vstack([self._table, np.full_like(self._table, -1)])
                    self._table[n:, 0] = 0
                    self._accepts = np.r_[self._accepts, np.full_like(self._accepts, -1)]
                self._accepts[n] = self._accept(to)
            self._table[k, j] = self._index[to]

    def _classes(self) -> tuple[np.ndarray, np.ndarray]:
        """The class of each code point, and of those that may stand between letters."""
        if "_held" not in self.__dict__:
            letters = _letters()
            classes, inner = letters.astype(np.int32), np.zeros(0x110000, np.int32)
            inner[[ord(c) for c in INNER]] = 1
            for c, k in self.letters.items():
                (classes if letters[ord(c)] else inner)[ord(c)] = k
            self._held = classes, inner
        return self._held

    def run(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, accept) of the words of ``text`` (lower-cased) that are a term, near one, or have a stem."""
        none = np.empty(0, np.int64)
        if not text or not self.names:
            return none, none, none
        if "_table" not in self.__dict__ or self._table.nbytes > TABLE_BYTES:
            self._begin()
        classes, inner = self._classes()
        code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        cls = classes[code]
        letter = cls > 0
        marks = inner[code]
        at = np.flatnonzero(marks)  # between letters such a mark stands for a letter
        at = at[(at > 0) & (at < len(code) - 1)]
        at = at[letter[at - 1] & letter[at + 1]]
        cls[at] = marks[at]
        letter = cls > 0
        cls = np.append(cls, 0)
        begin = np.flatnonzero(letter & ~np.r_[False, letter[:-1]])
        state = np.ones(len(begin), np.int32)
        at, word = begin.copy(), np.arange(len(begin))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(at):
            c = cls[at]
            over = c == 0
            if over.any():
                accept = self._accepts[state[over]]
                hit = accept >= 0
                found.append((begin[word[over][hit]], at[over][hit], accept[hit]))
            go = ~over
            state, c, at, word = state[go], c[go], at[go] + 1, word[go]
            to = self._table[state, c]
            new = to < 0
            if new.any():
                self._make(state[new], c[new])
                to = self._table[state, c]
            go = to > 0
            state, at, word = to[go], at[go], word[go]
        if not found:
            return none, none, none
        start, end, accept = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(start)
        return start[order], end[order], accept[order]


def quotation(text: str, start: int, end: int, low: int = 0, high: int | None = None) -> tuple[float, float]:
    """How much the window around a hit, within ``low`` to ``high``, speaks for quotation, and for abuse (each 0 to 1)."""
    high = len(text) if high is None else high
    before, after = text[max(low, start - WINDOW) : start], text[end : min(high, end + WINDOW)]
    marks = any(c in QUOTES for c in before[-12:]) and any(c in QUOTES for c in after[:12])
    words = set(WORD.findall(before)) | set(WORD.findall(after))
    return min(1.0, 0.6 * marks + 0.4 * bool(words & REPORTING)), float(bool(words & ADDRESS))


FEATURES = 7


class ToxicityModel:
    """Lexicon automaton, evidence of each name at each distance, and logistic weights over a document's evidence."""

    def __init__(self, automaton: LexiconAutomaton, evidence: np.ndarray, base: float, weights: np.ndarray | None = None):
        self.automaton, self.evidence, self.base, self.weights = automaton, evidence, base, weights

    def features(self, texts: Iterable[str | None]) -> np.ndarray:
        """For each text: summed and strongest evidence of terms and of stems, quotation, abuse, length."""
        # lower() may change a text's length; hits are only ever looked up in the lowered text.
        lowered = [(t or "").lower() for t in texts]
        x = np.zeros((len(lowered), FEATURES))
        n_terms = len(self.automaton.terms)
        for lo, hi in _chunks(lowered):
            joined = "\n".join(lowered[lo:hi])
            offset = np.cumsum([0] + [len(t) + 1 for t in lowered[lo:hi]])
            start, end, accept = self.automaton.run(joined)
            if not len(start):
                continue
            rows = np.searchsorted(offset, start, side="right") - 1 + lo
            for r, s, e, a in zip(rows.tolist(), start.tolist(), end.tolist(), accept.tolist(), strict=True):
                name, distance = divmod(a, 3)
                quoted, abusive = quotation(joined, s, e, int(offset[r - lo]), int(offset[r - lo + 1]) - 1)
                weight = self.evidence[name, distance]
                own = weight * (1 - 0.7 * quoted)
                f = x[r]
                kind = 2 if name >= n_terms else 0
                f[kind] += own
                f[kind + 1] = max(f[kind + 1], own)
                f[4] += weight * quoted
                f[5] += own * abusive
        x[:, [0, 2, 4, 5]] = np.log1p(x[:, [0, 2, 4, 5]])
        x[:, 6] = [math.log1p(len(t)) / 10 for t in lowered]
        return x

    def score(self, texts: Iterable[str | None]) -> np.ndarray:
        texts = list(texts)
        if self.weights is None:
            return np.full(len(texts), self.base)
        x = self.features(texts)
        return sigmoid(x @ self.weights[:-1] + self.weights[-1])


def _chunks(texts: list[str], size: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` characters together (a longer text is a range of its own)."""
    lo = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > size:
            yield lo, i
            lo, total = i, 0
        total += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def _names(text: str | None) -> tuple[set[str], set[str]]:
    words = set(WORD.findall((text or "").lower()))
    return words, {w[:n] for w in words for n in STEM_LENGTHS if len(w) > n}


def learn_lexicon(rows: DataFrame, base: float, toxic: int, support: int = 5) -> tuple[list[str], list[str], np.ndarray]:
    """Terms, stems and their evidence, from (text, y) rows; two passes, the first over toxic rows alone."""

    def count(wanted=None):
        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            words, stems = Counter(), Counter()
            for b in batches:
                for t in b.text:
                    w, s = _names(t)
                    words.update(w if wanted is None else w & wanted.value[0])
                    stems.update(s if wanted is None else s & wanted.value[1])
            out = [(k, False, v) for k, v in words.items()] + [(k, True, v) for k, v in stems.items()]
            yield pd.DataFrame(out, columns=["name", "stem", "n"])

        return task

    schema = "name string, stem boolean, n long"
    total = lambda df: df.groupBy("name", "stem").agg(F.sum("n").alias("n"))
    positive = total(rows.where("y = 1").mapInPandas(count(), schema)).where(F.col("n") >= support)
    positive = positive.toPandas()  # words that some of the labelled rows share: bounded by their number
    if not len(positive):
        return [], [], np.empty(0)
    wanted = rows.sparkSession.sparkContext.broadcast(
        tuple(frozenset(positive.name[positive.stem == kind]) for kind in (False, True))
    )
    negative = total(rows.where("y = 0").mapInPandas(count(wanted), schema)).toPandas()
    both = positive.merge(negative, on=["name", "stem"], how="left", suffixes=("", "_clean")).fillna({"n_clean": 0})
    p, n = both.n.to_numpy(float), both.n_clean.to_numpy(float)
    clean = toxic / max(base, 1e-9) - toxic
    both["evidence"] = np.log((p + 0.5) / (toxic + 1)) - np.log((n + 0.5) / (clean + 1))
    share = p / (p + n)
    low = share - 1.28 * np.sqrt(share * (1 - share) / (p + n)) - 1 / (p + n)
    both = both[(low > max(0.5, 2 * base)) & (both.evidence > 1)]
    return choose(both)


def choose(both: pd.DataFrame) -> tuple[list[str], list[str], np.ndarray]:
    """Of candidates (name, stem, n, evidence) the stems that more than one frequent word shares, and the other words.

    A stem stands for a word if that word alone makes up most of its rows, so the word is kept instead; a longer
    stem or a word that begins with a kept stem adds nothing.
    """
    words = both[~both.stem].set_index("name")
    stems = sorted(both[both.stem][["name", "n", "evidence"]].itertuples(index=False), key=lambda r: (len(r.name), r.name))
    heaviest: dict[str, int] = {}
    for w, n in zip(words.index, words.n, strict=True):
        for k in STEM_LENGTHS:
            if len(w) > k:
                heaviest[w[:k]] = max(heaviest.get(w[:k], 0), n)
    kept: dict[str, float] = {}
    for name, n, evidence in stems:
        if n >= 1.6 * heaviest.get(name, 0) and not any(name[:k] in kept for k in STEM_LENGTHS):
            kept[name] = evidence
    alone = words[[not any(w[:k] in kept for k in STEM_LENGTHS) for w in words.index]]
    alone = alone.reset_index().sort_values(["n", "name"], ascending=[False, True])
    best = sorted(kept.items(), key=lambda x: (-x[1], x[0]))
    return alone.name.to_list(), [x for x, _ in best], np.array([*alone.evidence, *(e for _, e in best)])


def evidence_by_distance(rows: DataFrame, automaton: LexiconAutomaton, evidence: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """evidence[name, distance]: a misspelling counts as its term, less a part, unless clean rows hold it too.

    Misspellings are rare among labelled rows, so two toxic rows are assumed for each name and distance.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(automaton)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for t, y in zip(b.text, b.y, strict=True):
                accept = shipped.value.run((t or "").lower())[2]
                seen.update((int(a), int(y)) for a in np.unique(accept[accept % 3 > 0]))
        yield pd.DataFrame([(a, y, n) for (a, y), n in seen.items()], columns=["accept", "y", "n"])

    out = np.outer(evidence, [1.0, 0.8, 0.6])
    p, n = np.zeros_like(out), np.zeros_like(out)
    for r in rows.mapInPandas(task, "accept int, y int, n long").groupBy("accept", "y").agg(F.sum("n").alias("n")).collect():
        (p if r.y else n)[divmod(r.accept, 3)] = r.n
    own = np.log((p + 2) / (toxic + 2)) - np.log((n + 0.5) / (clean + 1))
    out[:, 1:] = np.clip(own[:, 1:], 0, out[:, 1:])
    return out


def fit(documents: DataFrame, labels: DataFrame, modulus: int = MODULUS, held: int = HELD) -> ToxicityModel:
    """The model, from labelled rows outside the held-out remainder."""
    rows = training_rows(documents, labels, "toxic", modulus, held).persist()
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    toxic, total = counts.get(1, 0), sum(counts.values())
    base = toxic / total if total else 0.0
    if not 0 < toxic < total:
        rows.unpersist()
        return ToxicityModel(LexiconAutomaton([], []), np.empty(0), base)
    terms, stems, evidence = learn_lexicon(rows, base, toxic)
    automaton = LexiconAutomaton(terms, stems)
    model = ToxicityModel(automaton, evidence_by_distance(rows, automaton, evidence, toxic, total - toxic), base)
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"x": list(shipped.value.features(b.text)), "y": b.y})

    found = rows.mapInPandas(task, "x array<double>, y int").toPandas()
    rows.unpersist()
    found = found.iloc[np.lexsort((found.y, found.x.map(tuple)))]
    model.weights = fit_logistic(np.stack(found.x.to_list()), found.y.to_numpy(float))
    return model


def scorer(documents: DataFrame, model: ToxicityModel) -> Column:
    held = documents.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(held.value.score(texts))

    return score(F.col("text"))


def score_toxicity(documents: DataFrame, labels: DataFrame, modulus: int = MODULUS, held: int = HELD, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = fit(documents, labels, modulus, held)
    rows = documents.select("doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), scorer(documents, model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
