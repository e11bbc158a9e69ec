"""Toxicity of texts: a learned lexicon met with misspellings, weighed by context.

Learning reads a bounded sample of labelled documents. Words and beginnings of words that are far more frequent in toxic documents
make a trie. Levenshtein automata of its terms, one edit wide, run as one automaton whose states are sets of
(trie node, edits): the intersection is built as words ask for it, and most words leave it after a few letters. Each
hit counts by its context window: less inside quotation marks or after a word of reporting, more beside
an address of the reader. One with an edit counts less, by the length of its term, and not at all where its form is at home
in clean documents. A logistic regression of the counts gives the score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .tables import kept

#: Labelled documents that are learned from, about; all others still get a score.
SAMPLE = 20_000
#: Terms a lexicon holds at most.
TERMS = 2_000
#: Likelihood-ratio statistic and ratio of document frequencies that make a term.
EVIDENCE, RATIO = 25.0, 20.0
#: Lengths of beginnings that are tried as stems.
STEMS = range(4, 9)
#: Terms at least this long count in full when they are met with an edit, shorter ones in proportion. Also the shortest words that an
#: automaton of whole words alone meets with an edit.
FUZZY = 6
#: Clean documents that make an edited form an ordinary word, unless toxic ones are ``RATIO`` times as likely to have it.
ORDINARY = 2
#: Words on each side that make the context.
WINDOW = 5
THRESHOLD = 0.7
_REMEMBERED = 300_000
_HELD = 200_000

# Words that report speech, words that address the reader, marks of quotation, look-alikes of letters.
REPORTING = frozenset(
    "said says called calls word words term quote quoted quotes wrote sagte sagt nannte wort zitat dit appelle mot dijo llama "
    "llamó palabra".split()
)
ADDRESS = frozenset("you your you're youre u ur du dein deine dich ihr tu toi ton ta te vous tú usted eres".split())
OPENING, CLOSING = '"“„«‘', '"”“»’'
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})

_PIECE = re.compile(r"[^\W_]+(?:[*@$!]+[^\W_]+)*")
_WITH_ENDS = re.compile(r"([*@$!]*)([^\W_]+(?:[*@$!]+[^\W_]+)*)([*@$!]*)")
_LONG = re.compile(r"(.)\1{2,}")


def pieces(token: str) -> list[str]:
    """Words of a lower-case text between white space; symbols inside a word stay."""
    return _PIECE.findall(token)


def forms(token: str) -> Iterator[tuple[str, set[str]]]:
    """Each of the ``pieces``, and what it may stand for: symbols at its ends may be letters too."""
    for before, piece, after in _WITH_ENDS.findall(token):
        found = {piece, piece.translate(LOOKALIKES), _LONG.sub(r"\1", piece)}
        if before or after:
            found |= {part.translate(LOOKALIKES) for part in (before + piece, piece + after, before + piece + after)}
        yield piece, found


class Automaton:
    """Levenshtein automata of all terms at once, over their trie, made deterministic as far as words lead.

    ``terms`` maps a term to whether it is a stem, which any ending may follow. ``find(word)`` gives
    ``(term, edits)`` with the fewest edits, or None. ``everywhere``: an edit may be in every term and at every letter;
    else only in whole words of at least ``FUZZY`` letters, after the first.
    """

    def __init__(self, terms: dict[str, bool], everywhere: bool = False):
        self.everywhere = everywhere
        self.children: list[dict[str, int]] = [{}]
        self.term: dict[int, tuple[str, bool]] = {}
        self.fuzzy = [False]
        for term, stem in sorted(terms.items()):
            path = [0]
            for letter in term:
                if letter not in self.children[path[-1]]:
                    self.children[path[-1]][letter] = len(self.children)
                    self.children.append({})
                    self.fuzzy.append(False)
                path.append(self.children[path[-1]][letter])
            self.term[path[-1]] = (term, stem)
            if self.loose(term, stem):
                for node in path:
                    self.fuzzy[node] = True
        self.letters = frozenset("".join(terms))
        self.known: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[str, int] | None] = []
        self.stops: list[tuple[str, int] | None] = []
        self.start = self._state({(0, 0)})

    def loose(self, term: str, stem: bool) -> bool:
        """Whether an edit is allowed."""
        return self.everywhere or len(term) >= FUZZY and not stem

    def _state(self, nodes: set[tuple[int, int]]) -> int:
        """The number of a set of nodes, with what letters left out lead to; -1 for the empty one."""
        for node, edits in list(nodes):
            if not edits and (node or self.everywhere):
                nodes |= {(child, 1) for child in self.children[node].values() if self.fuzzy[child]}
        nodes = frozenset((n, e) for n, e in nodes if not e or (n, 0) not in nodes)
        if not nodes:
            return -1
        if nodes not in self.known:
            self.known[nodes] = len(self.sets)
            self.sets.append(nodes)
            self.steps.append({})
            here = [(e, *self.term[n]) for n, e in nodes if n in self.term and (not e or self.loose(*self.term[n]))]
            best = min(here, default=None)
            self.ends.append(best and (best[1], best[0]))
            stems = [h for h in here if h[2]]
            self.stops.append(min(stems)[1::-1] if stems else None)
        return self.known[nodes]

    def _step(self, state: int, letter: str) -> int:
        after = set()
        for node, edits in self.sets[state]:
            if letter in self.children[node]:
                after.add((self.children[node][letter], edits))
            if not edits and (node or self.everywhere) and self.fuzzy[node]:
                after.add((node, 1))
                after |= {(child, 1) for child in self.children[node].values() if self.fuzzy[child]}
        self.steps[state][letter] = found = self._state(after)
        return found

    def find(self, word: str) -> tuple[str, int] | None:
        state, best = self.start, None
        for letter in word:
            letter = letter if letter in self.letters else ""
            after = self.steps[state].get(letter)
            state = self._step(state, letter) if after is None else after
            if state < 0:
                return best
            stop = self.stops[state]
            if stop and (best is None or stop[1] < best[1]):
                best = stop
        end = self.ends[state]
        return end if end and (best is None or end[1] < best[1]) else best


class _Words(dict):
    """Text between white space to its hit; an edited form that is ``ordinary`` is none."""

    def __init__(self, automaton: Automaton, ordinary: frozenset[str] = frozenset()):
        self.automaton, self.ordinary = automaton, ordinary

    def hits(self, token: str) -> Iterator[tuple[str, tuple[str, int]]]:
        """Pieces with their hits, one with the fewest edits for each."""
        for piece, found in forms(token):
            best = None
            for form in sorted(found):
                hit = self.automaton.find(form)
                if hit and (best is None or hit[1] < best[1]):
                    best = hit
            if best and not (best[1] and piece in self.ordinary):
                yield piece, best

    def __missing__(self, token: str) -> tuple[str, int] | None:
        best = None
        for _, hit in self.hits(token):
            if best is None or hit[1] < best[1]:
                best = hit
        if len(self) >= _REMEMBERED:
            self.clear()
        self[token] = best
        return best


FEATURES = 6


@dataclass
class Model:
    terms: dict[str, bool] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [0.0] * (FEATURES + 1))
    ordinary: frozenset[str] = frozenset()

    def scanner(self) -> Scanner:
        return Scanner(self)


class Scanner:
    def __init__(self, model: Model):
        self.words = _Words(Automaton(model.terms, everywhere=True), model.ordinary)
        self.weights = np.array(model.weights)

    def features(self, text: str | None) -> list[float]:
        """Of a whole text; zeros where it has no hit."""
        tokens = (text or "").lower().split()
        hits = [(at, hit) for at, hit in enumerate(map(self.words.__getitem__, tokens)) if hit]
        if not hits:
            return [0.0] * FEATURES
        spans = [m.span() for m in re.finditer(r"\S+", text)]
        total = loose = quoted = most = 0.0
        for at, (term, edits) in hits:
            score, in_quotes = self.context(text, tokens, spans, at)
            score *= 0.6 * min(1.0, len(term) / FUZZY) if edits else 1.0
            quoted += in_quotes
            most = max(most, score)
            total += score
            loose += score * (edits > 0)
        rate = 100 * total / max(len(tokens), 20)
        kinds = len({term for _, (term, _) in hits})
        return [*map(math.log1p, (total, loose, rate, kinds)), most, quoted / len(hits)]

    @staticmethod
    def context(text: str, tokens: list[str], spans: list[tuple[int, int]], at: int) -> tuple[float, bool]:
        """How much a hit counts, and whether it is quoted or reported."""
        low, high = max(0, at - WINDOW), min(len(tokens), at + WINDOW + 1)
        # Lower case may differ in length, never in the number of tokens but for rare white space.
        if high > len(spans):
            return 1.0, False
        begin, end = spans[at]
        before, after = text[spans[low][0] : begin], text[end : spans[high - 1][1]]
        word = text[begin:end]
        opened = any(mark in word[:2] or before.count(mark) % 2 if mark == '"' else mark in before + word[:1] for mark in OPENING)
        closed = any(mark in word[-2:] or mark in after for mark in CLOSING)
        near = {p for token in tokens[low:high] for p in pieces(token)}
        reported = any(p in REPORTING for token in tokens[low:at] for p in pieces(token))
        in_quotes = (opened and closed) or reported
        return (0.35 if in_quotes else 1.0) * (1.3 if near & ADDRESS else 1.0), in_quotes

    def score(self, text: str | None) -> float:
        z = float(self.weights[0] + self.weights[1:] @ np.array(self.features(text)))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the label of a document may not be learned."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """A model of the ``label`` (0 or 1) that ``labels`` gives by ``doc_id`` to texts of ``docs``.

    Held-out rows, NULL labels and ids, and labels without a document teach nothing; of several labels of a
    document the highest counts. Without toxic documents there are no terms and every score is the same.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(label).alias("label"))
    part = SAMPLE / max(known.count(), SAMPLE)
    # In proportion to the bound, so the table is small enough to broadcast.
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(part * (1 << 30)))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")
    texts = kept(texts, "toxicity-sample")

    totals = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic:
        return Model(weights=[math.log(0.5 / (clean + 0.5)), *[0.0] * FEATURES])
    counts = texts.mapInArrow(_count, "term string, stem boolean, toxic bigint, clean bigint, places bigint")
    counts = counts.groupBy("term", "stem").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.bit_or("places").alias("places")
    )
    often = (F.col("toxic") + 0.5) / (toxic + 1) > RATIO * (F.col("clean") + 0.5) / (clean + 1)
    best = counts.where(often & (F.col("toxic") > 1)).orderBy(F.col("toxic").desc(), "clean", "term", "stem")
    rows = best.limit(20 * TERMS).collect()
    model = Model(terms=choose([tuple(r) for r in rows], toxic, clean))
    edited = texts.mapInArrow(_ordinary(model), "form string, toxic bigint, clean bigint")
    edited = edited.groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    at_home = edited.where(is_ordinary(F.col("toxic"), F.col("clean"), toxic, clean))
    model.ordinary = frozenset(r["form"] for r in at_home.select("form").collect())  # an edit from a term, in the sample
    seen = texts.mapInArrow(_measure(model), "label double, x array<double>").collect()
    model.weights = fit(np.array([r["x"] for r in seen]), np.array([r["label"] for r in seen]))
    return model


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each label that hold a word, or a word with a beginning; partial sums.

    ``places`` has a bit for each of 64 classes of the text before the term in toxic documents: copies of a
    document add to its counts, but not to its places.
    """

    def out() -> pa.RecordBatch:
        keys = list(held)
        rows = [held[k] for k in keys]
        columns = [
            pa.array([k[0] for k in keys], pa.string()),
            pa.array([k[1] for k in keys], pa.bool_()),
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[2] - (r[2] >> 63 << 64) for r in rows], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["term", "stem", "toxic", "clean", "places"])

    held: dict[tuple[str, bool], list[int]] = {}
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1), strict=True):
            toxic, before, found = int(label.as_py() == 1), 0, {}
            for token in (text.as_py() or "").lower().split():
                for word in pieces(token):
                    if len(word) <= 40:
                        found[word] = found.get(word, 0) | 1 << (before & 63)
                before = zlib.crc32(token.encode()) if toxic else 0
            terms: dict[tuple[str, bool], int] = {}
            for word, places in found.items():
                terms[word, False] = terms.get((word, False), 0) | places
                for n in STEMS:
                    if len(word) >= n:
                        terms[word[:n], True] = terms.get((word[:n], True), 0) | places
            for term, places in terms.items():
                row = held.setdefault(term, [0, 0, 0])
                row[toxic] += 1
                row[2] |= places * toxic
            if len(held) > _HELD:
                yield out()
                held = {}
    yield out()


def is_ordinary(toxic, clean, all_toxic: int, all_clean: int):
    """Whether clean documents make a form ordinary; of numbers or columns."""
    return (clean >= ORDINARY) & ((toxic + 0.5) / (all_toxic + 1) <= RATIO * (clean + 0.5) / (all_clean + 1))


def _ordinary(model: Model):
    """Documents of each label that hold a form with an edit from a term; partial sums."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = model.scanner().words
        known: dict[str, list[str]] = {}
        counts: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            columns = [pa.array(list(counts), pa.string()), *(pa.array([c[k] for c in counts.values()], pa.int64()) for k in (1, 0))]
            return pa.RecordBatch.from_arrays(columns, names=["form", "toxic", "clean"])

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                found = set()
                for token in (text.as_py() or "").lower().split():
                    if token not in known:
                        if len(known) >= _REMEMBERED:
                            known.clear()
                        known[token] = [piece for piece, hit in words.hits(token) if hit[1]]
                    found.update(known[token])
                for form in found:
                    counts.setdefault(form, [0, 0])[int(label.as_py() == 1)] += 1
            if len(counts) > _HELD:
                yield out()
                counts.clear()
        yield out()

    return counted


def _places(bits: int) -> float:
    """How many places are likely to have left so many bits."""
    free = 64 - (bits & (1 << 64) - 1).bit_count()
    return 64 * math.log(64 / max(free, 0.5))


def choose(rows: list[tuple[str, bool, int, int, int]], toxic: int, clean: int) -> dict[str, bool]:
    """Terms that the counts bear out: whole words, and stems where no single word makes up the stem.

    No term has more evidence than places.
    """

    def evidence(a: float, b: int) -> float:
        """Twice the log likelihood ratio of a term's documents to labels by chance."""
        p = toxic / (toxic + clean)
        part = lambda k, q: k * math.log(k / ((a + b) * q)) if k else 0.0
        return 2 * (part(a, p) + part(b, 1 - p)) if 0 < p < 1 else 2.0 * a

    sound = [(t, stem, a) for t, stem, a, b, places in rows if evidence(min(a, _places(places)), b) >= EVIDENCE]
    words = {t: a for t, stem, a in sound if not stem}
    stems = {t: a for t, stem, a in sound if stem}
    longer: dict[str, list[int]] = {}
    for stem, count in stems.items():
        longer.setdefault(stem[:-1], []).append(count)
    terms: dict[str, bool] = {}
    for stem in sorted(stems, key=lambda s: (len(s), s)):
        if any(stem[:n] in terms and terms[stem[:n]] for n in range(STEMS.start, len(stem))):
            continue
        whole = next((w for w in (stem,) if words.get(w, 0) >= 0.9 * stems[stem]), None)
        if whole:
            terms[whole] = False
        elif max(longer.get(stem, [0])) < 0.9 * stems[stem] and not _one_word(stem, words, stems[stem]):
            terms[stem] = True
    for word in sorted(words, key=lambda w: (-words[w], w)):
        if not any(terms.get(word[:n]) for n in range(STEMS.start, len(word) + 1)):
            terms.setdefault(word, False)
    # The strongest ones, should there be too many.
    strength = lambda t: -(stems if terms[t] else words).get(t, 0)
    return {t: terms[t] for t in sorted(terms, key=lambda t: (strength(t), t))[:TERMS]}


def _one_word(stem: str, words: dict[str, int], count: int) -> bool:
    return any(w.startswith(stem) and n >= 0.9 * count for w, n in words.items())


def _measure(model: Model):
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = model.scanner()
        for batch in batches:
            x = [scanner.features(t) for t in batch.column(0).to_pylist()]
            columns = [batch.column(1).cast(pa.float64()), pa.array(x, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "x"])

    return measured


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 40) -> list[float]:
    """Logistic regression by Newton steps; ``ridge`` pulls weights of standardised features to 0."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), np.where(spread > 1e-6, (x - mean) / spread, 0.0)])
    pull = np.diag([1e-6, *[ridge] * x.shape[1]])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + pull @ w
        bend = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + pull
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
    plain = np.where(spread > 1e-6, w[1:] / spread, 0.0)
    return [float(w[0] - plain @ mean), *map(float, plain)]


def scored(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with the score in ``column``, 0 to 1, from the whole text alone; NULL counts as empty."""
    at = docs.columns.index(text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = model.scanner()
        for batch in batches:
            found = [scanner.score(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, column]
            )

    return docs.mapInArrow(add, StructType([*docs.schema.fields, StructField(column, DoubleType())]))
