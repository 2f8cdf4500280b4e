"""Toxicity: a learned lexicon, matched through Levenshtein automata, weighed by its context.

Fitting reads a bounded sample of labelled rows (SAMPLE_PER_CLASS of each label, least hash of doc_id first).
Terms are whole words, or stems that begin words, that stand in many different surroundings in toxic texts and
hardly in clean ones; counting surroundings instead of documents keeps copies of one text from making terms.
The terms form a trie; the Levenshtein automata of all terms, intersected with it, are made deterministic once
and run over all words of a batch in step. A hit weighs its term's log-odds, less for a misspelling and less in
a quotation or next to a reporting verb, by factors estimated from the sample. A logistic curve fitted on the
sample turns the sum of a text's weights into its score.

Defined cases: null and empty texts have the score of a text without hits; a very long text is read whole;
labels with a null or repeated doc_id: null ones are not used, of repeated ones the greatest label holds; with no
toxic or no clean labels the lexicon is empty and every score is equal. Only doc_id and text are scored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightspark.functions.shared import cut
from freightspark.llm.common import blocks, lean, remainder

SAMPLE_PER_CLASS = 6000
#: Terms of the lexicon at most, candidates looked at in the sample, and code points of a stem.
MAX_TERMS, MAX_CANDIDATES, STEMS = 256, 20_000, range(4, 9)
MIN_LIFT, MIN_PLACES = 4.0, 5
THRESHOLD = 0.7
#: Pull of the fitted intercept and slope to -3 and 1. Without it a sample that hits separate wholly would
#: put the threshold beyond a single plain hit.
RIDGE = (1000.0, 20.0)
#: Code points on each side of a hit that tell quotation from abuse.
CONTEXT = 80
#: Quotation marks, verbs that report speech (English, German, French, Spanish), and prior factors.
OPENING, CLOSING, EITHER = "“„«‹‘", "”»›’", '"'
REPORTING = frozenset("said says called calls wrote writes quoted quote quotes sagte sagt nannte schrieb zitierte zitat dit appelé écrit cité citation dijo dice llamó escribió citó cita".split())
PLAIN, REPORTED, QUOTED = 0, 1, 2
PRIOR = {PLAIN: 1.0, REPORTED: 0.5, QUOTED: 0.25}

_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool
    weight: float

    @property
    def errors(self) -> int:
        """Edits that still count as this term."""
        n = len(self.text)
        return (1 if n >= 6 else 0) if self.stem else 2 if n >= 9 else 1 if n >= 5 else 0


class Matcher:
    """The deterministic product of the terms' Levenshtein automata and their trie."""

    DEAD = 0

    def __init__(self, terms: list[Term]):
        self.terms = terms
        children: list[dict[str, int]] = [{}]
        ends: dict[int, list[int]] = {}
        allowed = [0]
        for i, t in enumerate(terms):
            node = 0
            allowed[0] = max(allowed[0], t.errors)
            for c in t.text:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    allowed.append(0)
                node = children[node][c]
                allowed[node] = max(allowed[node], t.errors)
            ends.setdefault(node, []).append(i)
        self.letters = sorted({c for t in terms for c in t.text if ord(c) < 1 << 16})
        self.classes = np.zeros(1 << 16, np.int32)
        for k, c in enumerate(self.letters, 1):
            self.classes[ord(c)] = k

        def closed(states: dict[int, int]) -> frozenset:
            """Least errors of each node, with skipped letters of the term."""
            todo = list(states.items())
            while todo:
                node, e = todo.pop()
                if states.get(node, 99) < e:
                    continue
                for child in children[node].values():
                    if e + 1 <= allowed[child] and states.get(child, 99) > e + 1:
                        states[child] = e + 1
                        todo.append((child, e + 1))
            return frozenset(states.items())

        def step(state: frozenset, c: str | None) -> frozenset:
            out: dict[int, int] = {}

            def put(node: int, e: int) -> None:
                if e <= allowed[node] and out.get(node, 99) > e:
                    out[node] = e

            for node, e in state:
                put(node, e + 1)
                for letter, child in children[node].items():
                    put(child, e if letter == c else e + 1)
            return closed(out)

        start = closed({0: 0})
        number = {frozenset(): self.DEAD, start: 1}
        order, rows, at = [frozenset(), start], [], 0
        while at < len(order):
            row = []
            for c in (None, *self.letters):
                to = step(order[at], c)
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                row.append(number[to])
            rows.append(row)
            at += 1
        self.table = np.array(rows, np.int32)
        n = len(order)
        #: For each state: term and errors of the best whole word that ends there, and of the best stem reached there.
        self.word, self.stem = np.full((n, 2), -1, np.int32), np.full((n, 2), -1, np.int32)
        for s, state in enumerate(order):
            for node, e in sorted(state, key=lambda x: -x[1]):
                for i in ends.get(node, ()):
                    t = terms[i]
                    if e <= t.errors:
                        (self.stem if t.stem else self.word)[s] = (i, e)

    def find(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word number, term, errors) of the words codes[start:end] that match a term; exact matches win over others."""
        if not self.terms or not len(starts):
            return (np.zeros(0, np.int64),) * 3
        alive, state = np.arange(len(starts)), np.ones(len(starts), np.int32)
        term, errors = np.full(len(starts), -1, np.int32), np.full(len(starts), 99, np.int32)

        def keep(words: np.ndarray, found: np.ndarray) -> None:
            better = (found[:, 0] >= 0) & (found[:, 1] < errors[words])
            w = words[better]
            term[w], errors[w] = found[better, 0], found[better, 1]

        depth = 0
        while len(alive):
            letter = codes[starts[alive] + depth]
            state = self.table[state, self.classes[np.where(letter < 1 << 16, letter, 0)]]
            depth += 1
            live = state != self.DEAD
            alive, state = alive[live], state[live]
            keep(alive, self.stem[state])
            over = starts[alive] + depth == ends[alive]
            keep(alive[over], self.word[state[over]])
            alive, state = alive[~over], state[~over]
        hit = np.flatnonzero(term >= 0)
        return hit, term[hit], errors[hit]


_alnum: list[np.ndarray] = []


def _word_table() -> np.ndarray:
    if not _alnum:
        _alnum.append(np.array([chr(c).isalnum() for c in range(1 << 16)]))
    return _alnum[0]


def surroundings(text: str, a: int, b: int) -> int:
    """PLAIN, REPORTED or QUOTED: the use of text[a:b] in its context window, within its line."""
    before, after = text[max(0, a - CONTEXT) : a].rpartition("\n")[2], text[b : b + CONTEXT].partition("\n")[0]
    opened = max(before.rfind(c) for c in OPENING) > max(before.rfind(c) for c in CLOSING)
    if (opened and any(c in after for c in CLOSING)) or (before.count(EITHER) % 2 and EITHER in after):
        return QUOTED
    near = _WORD.findall(before)[-4:] + _WORD.findall(after)[:2]
    return REPORTED if not REPORTING.isdisjoint(near) else PLAIN


def hits(texts: list[str], matcher: Matcher) -> list[list[tuple[int, int, int]]]:
    """(term, errors, surroundings) of each hit of each text."""
    low = [t.lower() for t in texts]
    joined = "\x00".join(low) + "\x00"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    words = np.concatenate(([False], _word_table()[np.where(codes < 1 << 16, codes, 0)], [False]))
    edge = np.flatnonzero(words[1:] != words[:-1])
    starts, ends = edge[::2], edge[1::2]
    found, term, errors = matcher.find(codes, starts, ends)
    firsts = np.cumsum([0, *(len(t) + 1 for t in low)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    at = starts[found]
    for d, a, b, t, e in zip((np.searchsorted(firsts, at, side="right") - 1).tolist(), at.tolist(), ends[found].tolist(), term.tolist(), errors.tolist(), strict=True):
        f = int(firsts[d])
        out[d].append((t, e, surroundings(low[d], a - f, b - f)))
    return out


@dataclass
class Model:
    terms: list[Term] = field(default_factory=list)
    #: (term, errors) -> weight where it isn't the term's own, and surroundings -> factor.
    misspelt: dict[tuple[int, int], float] = field(default_factory=dict)
    factor: dict[int, float] = field(default_factory=lambda: dict(PRIOR))
    intercept: float = -3.0
    slope: float = 1.0

    def evidence(self, own: list[tuple[int, int, int]]) -> float:
        return sum((self.terms[t].weight if not e else self.misspelt.get((t, e), self.terms[t].weight * 0.5**e)) * self.factor[c] for t, e, c in own)

    def score(self, own: list[tuple[int, int, int]]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.slope * self.evidence(own), -30, 30))))


def _features(word: str) -> Iterator[tuple[str, bool]]:
    if len(word) >= 3:
        yield word, False
    for k in STEMS:
        if len(word) > k:
            yield word[:k], True


def _text_counts(rows: DataFrame, known: frozenset | None) -> DataFrame:
    """(term, stem, n): texts that hold each feature, or each of the known ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                own = {f for w in set(_WORD.findall((text or "").lower())) for f in _features(w)}
                count.update(own if known is None else own & known)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in count]), pa.array([x[1] for x in count]), pa.array(list(count.values()), pa.int64())], names=["term", "stem", "n"])

    return rows.select("text").mapInArrow(lean(run), "term string, stem boolean, n long").groupBy("term", "stem").agg(F.sum("n").alias("n"))


def _places(rows: DataFrame, known: frozenset) -> DataFrame:
    """(term, stem, toxic, n): different pairs of neighbours that each known feature has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = set()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = ["", *_WORD.findall((text or "").lower()), ""]
                for i in range(1, len(words) - 1):
                    for f in _features(words[i]):
                        if f in known:
                            seen.add((*f, toxic, f"{words[i - 1]} {words[i + 1]}"))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*seen, strict=True)], names=["term", "stem", "toxic", "place"])

    rows = rows.select("text", F.col("toxic").cast("int")).mapInArrow(lean(run), "term string, stem boolean, toxic long, place string")
    return rows.distinct().groupBy("term", "stem", "toxic").agg(F.count("*").alias("n"))


def _lexicon(sample: DataFrame, n_toxic: int, n_clean: int) -> list[Term]:
    toxic, clean = sample.where("toxic = 1"), sample.where("toxic = 0")
    least = max(MIN_PLACES, n_toxic // 400)
    top = _text_counts(toxic, None).where(F.col("n") >= least).orderBy(F.desc("n"), "term", "stem").limit(MAX_CANDIDATES).collect()
    a = {(r.term, r.stem): r.n for r in top}
    b = {(r.term, r.stem): r.n for r in _text_counts(clean, frozenset(a)).collect()}
    lift = {f: np.log((a[f] + 0.5) / (n_toxic + 1)) - np.log((b.get(f, 0) + 0.5) / (n_clean + 1)) for f in a}
    known = frozenset(f for f in a if lift[f] >= MIN_LIFT)
    if not known:
        return []
    places: dict[tuple[str, bool], list[int]] = {f: [0, 0] for f in known}
    for r in _places(sample, known).collect():
        places[r.term, r.stem][1 - r.toxic] = r.n
    weight = {f: float(np.log((x + 0.5) / (n_toxic + 1)) - np.log((y + 0.5) / (n_clean + 1))) for f, (x, y) in places.items()}
    good = {f for f in known if places[f][0] >= least and weight[f] >= MIN_LIFT}
    chosen: list[tuple[str, bool]] = []
    for f in sorted(good, key=lambda f: (len(f[0]), not f[1], f[0])):
        if any(f[0].startswith(g[0]) and (g[1] or g[0] == f[0]) for g in chosen):
            continue
        # the longest feature below a stem that keeps nearly all its places says the same more exactly
        if f[1]:
            same = [g for g in good if g[0].startswith(f[0]) and places[g][0] >= 0.95 * places[f][0]]
            f = max(same, key=lambda g: (not g[1], len(g[0]), g[0]))
        if f not in chosen:
            chosen.append(f)
    chosen.sort(key=lambda f: (-weight[f] * places[f][0], f))
    return [Term(t, stem, weight[t, stem]) for t, stem in chosen[:MAX_TERMS]]


def fit(docs: DataFrame, labels: DataFrame, fold: int = 3, held: int = 1, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Learn from labelled documents outside the held-out fold, at most `per_class` of each label."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(remainder("doc_id", fold) != held).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    ids = cut(parts[0].union(parts[1]), "toxic-ids")
    # at most 2 * per_class ids: safe to broadcast
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").repartition(8), "toxic-sample")
    n_clean, n_toxic = (sample.where(F.col("toxic") == k).count() for k in (0, 1))
    model = Model()
    if not n_clean or not n_toxic:
        return model
    model.terms = _lexicon(sample, n_toxic, n_clean)
    known_terms = docs.sparkSession.sparkContext.broadcast(Matcher(model.terms))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = known_terms.value
        for batch in blocks(batches):
            own = hits([t or "" for t in batch.column("text").to_pylist()], matcher)
            packed = [[x for h in o for x in h] for o in own]
            yield pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array(packed, pa.list_(pa.int32()))], names=["toxic", "own"])

    rows = [(r.toxic, list(zip(r.own[::3], r.own[1::3], r.own[2::3], strict=True))) for r in sample.select("text", "toxic").mapInArrow(lean(found), "toxic int, own array<int>").where("size(own) > 0").collect()]
    by_edit = Counter((toxic, t, e) for toxic, own in rows for t, e, _ in set(own) if e)
    for t, e in {x[1:] for x in by_edit}:
        b = by_edit[0, t, e]
        measured = np.log((by_edit[1, t, e] + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_clean + 1))
        own = model.terms[t].weight * 0.5**e
        model.misspelt[t, e] = float(own if not b else np.clip(measured, 0, own))
    by_use = Counter((toxic, c) for toxic, own in rows for c in {h[2] for h in own if not h[1]})
    for c, prior in PRIOR.items():
        a, b = by_use[1, c], by_use[0, c] * n_toxic / n_clean
        model.factor[c] = (a + 4 * prior) / (a + b + 4)
    # logistic curve: Newton steps on the sample, classes weighted as they stand among all labels
    share = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    x = np.array([model.evidence(own) for _, own in rows] + [0.0, 0.0])
    y = np.array([float(toxic) for toxic, _ in rows] + [1.0, 0.0])
    none = [n - sum(r[0] == k for r in rows) for k, n in ((1, n_toxic), (0, n_clean))]
    w = np.where(y == 1, share / n_toxic, (1 - share) / n_clean) * (n_toxic + n_clean)
    w[-2:] *= none
    at, prior, ridge = np.array([-3.0, 1.0]), np.array([-3.0, 1.0]), np.array(RIDGE)
    design = np.stack((np.ones(len(x)), x), 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (w * p * (1 - p))[:, None]) + np.diag(ridge), design.T @ (w * (y - p)) - ridge * (at - prior))
        at = at + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    model.intercept, model.slope = float(at[0]), max(0.05, float(at[1]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score (double), hits (int) to doc_id: one row per document."""
    known = docs.sparkSession.sparkContext.broadcast((Matcher(model.terms), model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, model = known.value
        for batch in blocks(batches):
            own = hits([t or "" for t in batch.column("text").to_pylist()], matcher)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([model.score(o) for o in own], pa.float64()), pa.array([len(o) for o in own], pa.int32())], names=["doc_id", "score", "hits"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, score double, hits int")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, all columns kept."""
    known = docs.sparkSession.sparkContext.broadcast((Matcher(model.terms), model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, model = known.value
        for batch in blocks(batches):
            own = hits([t or "" for t in batch.column("text").to_pylist()], matcher)
            yield batch.filter(pa.array([model.score(o) < threshold for o in own]))

    return docs.mapInArrow(lean(run), docs.schema)
