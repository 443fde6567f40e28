"""License scans: matching statistics of texts on a generalised suffix automaton of license templates.

The automaton holds every run of words of all templates. A text's words are fed through it one by one,
which gives at each word the longest run ending there that some template contains. Runs that cannot be
extended are traced back to their places in the templates and chained in order, template by template;
a chain that covers enough of a template is a span of the text with that license. Base phrases are
templates, too; all their places are reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import BASE_PHRASES, TEMPLATES
from .terms import Vocabulary, terms_of
from .words import slices

#: A run shared with a template counts from this number of words.
MIN_RUN = 3
#: Words of the text that may lie between two runs of a chain.
MAX_GAP = 40
#: Share of a template's words that a chain has to cover.
MIN_COVER = 0.8

_SPANS = "array<struct<label:string, start:long, stop:long, cover:double>>"
SCHEMA = f"n_words long, n_base long, first_word long, last_word long, base_labels array<string>, spans {_SPANS}, best double"


def template_words(text: str) -> list[str]:
    """Words of a template, split as those of the scanned texts."""
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


class SuffixAutomaton:
    """Generalised suffix automaton of sequences of numbers, with the places of each of its runs."""

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for i, sequence in enumerate(sequences):
            last = 0
            for at, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].append((i, at + 1))
        self.below: list[list[int]] = [[] for _ in self.link]
        for state, up in enumerate(self.link[1:], 1):
            self.below[up].append(state)
        self._places: dict[int, list[tuple[int, int]]] = {}

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(dict(moves))
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, state: int, token: int, target: int) -> int:
        """The state for runs no longer than ``state`` and ``token``, parted from ``target`` if need be."""
        if self.length[target] == self.length[state] + 1:
            return target
        twin = self._state(self.length[state] + 1, self.next[target], self.link[target])
        self.link[target] = twin
        while state >= 0 and self.next[state].get(token) == target:
            self.next[state][token] = twin
            state = self.link[state]
        return twin

    def _extend(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token, self.next[last][token])
        new, state = self._state(self.length[last] + 1, {}, 0), last
        while state >= 0 and token not in self.next[state]:
            self.next[state][token] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, token, self.next[state][token])
        return new

    def places(self, state: int) -> list[tuple[int, int]]:
        """(sequence, end) of every place of a state's runs."""
        if state not in self._places:
            found, todo = [], [state]
            while todo:
                s = todo.pop()
                found += self.ends[s]
                todo += self.below[s]
            self._places[state] = sorted(found)
        return self._places[state]

    def statistics(self, tokens: Sequence[int]) -> Iterator[tuple[int, int]]:
        """(length, state) of the longest run that ends at each token."""
        state, length = 0, 0
        for token in tokens:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            else:
                length = 0
            yield length, state


def chains(runs: list[tuple[int, int, int]], max_gap: int) -> list[tuple[int, int, int]]:
    """(start, stop, covered) of the best chains of one template's runs (start, place, length).

    Runs of a chain rise both in the text and in the template; words that two of them share count
    once. Every run extends the best chain that ends at most ``max_gap`` words before it; chains
    are taken from the widest on while their runs are free.
    """
    runs = sorted(set(runs))
    best, before, low = [], [], 0
    for i, (start, place, length) in enumerate(runs):
        while runs[low][0] + runs[low][2] + max_gap < start and low < i:
            low += 1
        top, source = length, -1
        for j in range(low, i):
            s, p, n = runs[j]
            shared = max(0, s + n - start, p + n - place)
            if p < place and s < start and shared < length and s + n + max_gap >= start and best[j] + length - shared > top:
                top, source = best[j] + length - shared, j
        best.append(top)
        before.append(source)
    out, used = [], set()
    for i in sorted(range(len(runs)), key=lambda i: (-best[i], i)):
        path, at = [], i
        while at >= 0 and at not in used:
            path.append(at)
            at = before[at]
        if at >= 0 or not path:
            continue
        used.update(path)
        out.append((runs[path[-1]][0], runs[i][0] + runs[i][2], best[i]))
    return out


class Scanner:
    """Templates, base phrases and their automaton; built once per task."""

    def __init__(self, templates: Mapping[str, Sequence[str]], phrases: Mapping[str, str], min_run: int, max_gap: int, min_cover: float):
        self.labels = [label for label, texts in templates.items() for _ in texts]
        sequences = [template_words(text) for texts in templates.values() for text in texts]
        self.base = len(sequences)
        self.labels += list(phrases.values())
        sequences += [template_words(p) for p in phrases]
        self.sizes = [len(s) for s in sequences]
        words = sorted({w for s in sequences for w in s})
        hashes = terms_of(pa.array(words, pa.string())).hash
        self.vocabulary = Vocabulary(hashes)
        number = dict(zip(words, np.searchsorted(self.vocabulary.hashes, hashes).tolist()))
        numbered = [[number[w] for w in s] for s in sequences]
        self.automaton = SuffixAutomaton(numbered)
        n = len(self.vocabulary)
        self.pairs = np.zeros((n + 1, n + 1), bool)
        for s in numbered:
            self.pairs[s[:-1], s[1:]] = True
        self.min_run, self.max_gap, self.min_cover = min_run, max_gap, min_cover
        # The phrases that end where a state's run ends, with the length the run needs to hold them.
        self.phrases: list[tuple[tuple[int, int], ...]] = [() for _ in self.automaton.link]
        for i in range(self.base, len(sequences)):
            state = 0
            for token in numbered[i]:
                state = self.automaton.next[state][token]
            todo = [state]
            while todo:
                at = todo.pop()
                self.phrases[at] += ((i, self.sizes[i]),)
                todo += self.automaton.below[at]

    def scan(self, places: np.ndarray, numbers: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[str, int, int, float]], float]:
        """(base places, spans, best cover) of one text, from the places and numbers of its known words."""
        if len(places) < 2:
            return [], [], 0.0
        joined = (np.diff(places) == 1) & self.pairs[numbers[:-1], numbers[1:]]
        # Only stretches whose neighbouring words are neighbours in some template hold runs of two words or more.
        ends = np.flatnonzero(np.append(~joined, True)) + 1
        starts = np.concatenate([[0], ends[:-1]])
        base: list[tuple[int, int]] = []
        runs: dict[int, list[tuple[int, int, int]]] = {}
        wide = ends - starts >= 2
        for a, b in zip(starts[wide].tolist(), ends[wide].tolist()):
            first, held = int(places[a]), (0, 0)
            for i, (length, state) in enumerate([*self.automaton.statistics(numbers[a:b].tolist()), (0, 0)]):
                if held[0] >= self.min_run and length != held[0] + 1:
                    for sequence, end in self.automaton.places(held[1]):
                        if sequence < self.base:
                            runs.setdefault(sequence, []).append((first + i - held[0], end - held[0], held[0]))
                base += [(p, first + i + 1 - n) for p, n in self.phrases[state] if length >= n]
                held = length, state
        found = [
            (min(1.0, covered / self.sizes[s]), start, stop, s) for s, own in runs.items() for start, stop, covered in chains(own, self.max_gap)
        ]
        best = max([1.0 if base else 0.0, *(f[0] for f in found)])
        return base, self._spans(found), best

    def _spans(self, found: list[tuple[float, int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Chains with enough cover, the best first, as long as most of their words are not taken by better ones."""
        spans, taken = [], []
        for cover, start, stop, s in sorted(found, key=lambda f: (-f[0], f[1] - f[2], f[1], f[3])):
            if cover < self.min_cover:
                break
            free = stop - start - sum(max(0, min(stop, b) - max(start, a)) for a, b in taken)
            if 2 * free > stop - start:
                spans.append((self.labels[s], start, stop, cover))
                taken.append((start, stop))
        return sorted(spans, key=lambda s: s[1:3])


def _scan(given: tuple, key: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*given)
        for batch in batches:
            for part in slices(batch, text):
                terms = terms_of(part.column(text))
                places, numbers = scanner.vocabulary.numbers(terms.hash)
                at = np.searchsorted(places, terms.first)
                rows = []
                for i in range(part.num_rows):
                    own = slice(at[i], at[i + 1])
                    base, spans, best = scanner.scan(places[own] - terms.first[i], numbers[own])
                    starts = [s for _, s in base]
                    rows.append((
                        int(terms.first[i + 1] - terms.first[i]), len(base), min(starts, default=None), max(starts, default=None),
                        sorted({scanner.labels[p] for p, _ in base}), spans, best,
                    ))
                columns = list(zip(*rows))
                kinds = [pa.int64()] * 4 + [pa.list_(pa.string())]
                span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("cover", pa.float64())])
                named = [[dict(zip(("label", "start", "stop", "cover"), s)) for s in spans] for spans in columns[5]]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), *arrays, pa.array(named, pa.list_(span)), pa.array(columns[6], pa.float64())],
                    [key, "n_words", "n_base", "first_word", "last_word", "base_labels", "spans", "best"],
                )
    return run


def license_spans(
    docs: DataFrame, key: str = "doc_id", text: str = "text", templates: Mapping[str, Sequence[str]] = TEMPLATES,
    phrases: Mapping[str, str] = BASE_PHRASES, min_run: int = MIN_RUN, max_gap: int = MAX_GAP, min_cover: float = MIN_COVER,
) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, spans, best) of every document.

    ``spans`` lists (label, start, stop, cover) of the templates found, in words from 0; ``best`` is the
    greatest share of a template that a chain covers, 1 where a base phrase stands. ``n_base`` counts
    all places of base phrases, ``first_word`` and ``last_word`` are their least and greatest starts.
    One row per row of ``docs``: a null or empty text has no words and no spans, a null key stays, repeated
    rows give repeated results. Whole texts are scanned; templates are a parameter of bounded size that
    travels with the tasks. Nothing is shuffled. Other columns are not read.
    """
    given = ({k: tuple(v) for k, v in templates.items()}, dict(phrases), min_run, max_gap, min_cover)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("words")).mapInArrow(
        _scan(given, "key", "words"), f"key {kind}, {SCHEMA}"
    ).withColumnRenamed("key", key)


def license_digest(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Labels as sorted text, and the best cover as score."""
    found = F.array_union("base_labels", F.transform("spans", lambda s: s["label"]))
    return spans.select(
        key, "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("labels"), F.col("best").alias("score"),
    )
