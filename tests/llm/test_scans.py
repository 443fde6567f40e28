"""License scans, conversation trie and ranked search against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from casewright.llm import lexical_search
from casewright.llm.conversation_trie import conversation_trie
from casewright.llm.lexical_search import ranked_search
from casewright.llm.license_texts import BASE_PHRASES, TEMPLATES
from casewright.llm.licenses import Scanner, SuffixAutomaton, chains, license_digest, license_spans

from .brute import _LOW

TERM = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def terms(text):
    return re.findall(TERM, (text or "").translate(_LOW))


# License scans ------------------------------------------------------------------------------------


def test_automaton_gives_the_longest_runs_and_their_places():
    r = random.Random(3)
    for _ in range(60):
        sequences = [[r.randrange(3) for _ in range(r.randrange(1, 12))] for _ in range(r.randrange(1, 5))]
        held = {}
        for i, s in enumerate(sequences):
            for a in range(len(s)):
                for b in range(a + 1, len(s) + 1):
                    held.setdefault(tuple(s[a:b]), []).append((i, b))
        automaton = SuffixAutomaton(sequences)
        text = [r.randrange(4) for _ in range(30)]
        for at, (length, state) in enumerate(automaton.statistics(text), 1):
            want = max((n for n in range(at + 1) if n == 0 or tuple(text[at - n: at]) in held))
            assert length == want
            if length:
                assert sorted(automaton.places(state)) == sorted(held[tuple(text[at - length: at])])


def test_chains_cover_what_rising_runs_cover():
    # Two runs in order, one out of order, one too far away.
    runs = [(0, 0, 4), (6, 5, 3), (9, 0, 3), (100, 8, 4)]
    assert chains(runs, 10)[0] == (0, 9, 7)
    assert (100, 104, 4) in chains(runs, 10)
    assert chains([(0, 0, 4), (2, 2, 4)], 10) == [(0, 6, 6)]
    assert chains([], 10) == []


def test_base_places_equal_a_plain_search(spark, awkward, prose):
    texts = [
        "CC BY cc-by. General Public License! all rights reserved", "all all rights rights reserved", "cc\nby\tcc by", "cc by" * 3,
        "xcc by cc byx é cc by", "general public\x00license", prose(3, 50) + " All Rights Reserved " + prose(4, 5), None, "", "  ", "cc",
        "word " * 20_000 + "cc by " * 3000,
    ]
    rows = [(i, t, 5, "x") for i, t in enumerate(texts)] + [(0, texts[0], 5, "x"), (None, texts[2], 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, spans string")
    got = license_digest(license_spans(docs)).collect()
    assert len(got) == len(rows)
    want = []
    for i, text, *_ in rows:
        w = terms(text)
        hits = [(a, label) for p, label in BASE_PHRASES.items() for a in range(len(w)) if w[a: a + len(p.split())] == p.split()]
        starts = [a for a, _ in hits]
        want.append((i, len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))))
    assert sorted([tuple(r)[:6] for r in got], key=repr) == sorted(want, key=repr)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert license_spans(docs.limit(0)).count() == 0
    assert license_spans(awkward).count() == awkward.count()


def test_licenses_are_found_with_changed_words_and_told_apart(spark, prose):
    mit = TEMPLATES["mit"][0].split()
    changed = mit[:40] + ["INSERTED"] + mit[40:90] + mit[92:]
    texts = {
        1: prose(1, 30) + " " + " ".join(changed) + " " + prose(2, 30), 2: " ".join(mit[:60]),
        3: "This work is licensed under the GNU General Public License, version 3", 4: "Licensed under CC BY 4.0.",
        5: "Licensed under CC BY-NC 4.0.\n" + " ".join(TEMPLATES["bsd-3-clause"][0].split()), 6: " ".join(TEMPLATES["bsd-2-clause"][0].split()),
        7: "the mit and the license of the software", 8: " ".join(reversed(mit)),
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: r for r in license_spans(docs).collect()}
    labels = {i: [s.label for s in r.spans] for i, r in rows.items()}
    assert labels == {
        1: ["mit"], 2: [], 3: ["gpl-3.0"], 4: ["cc-by-4.0"], 5: ["cc-by-nc-4.0", "bsd-3-clause"], 6: ["bsd-2-clause"], 7: [], 8: [],
    }
    span = rows[1].spans[0]
    # Chains stand where the text does; two words are gone and one has come.
    assert span.start == 30 and span.stop == 30 + len(terms(" ".join(changed))) and 0.95 < span.cover < 1
    assert rows[2].best == pytest.approx(len(terms(texts[2])) / len(terms(TEMPLATES["mit"][0])), abs=0.02)
    scanner = Scanner({"own": ["one two three four five"]}, {}, 3, 5, 0.6)
    numbers = scanner.vocabulary.numbers
    assert len(scanner.vocabulary) == 5 and len(numbers(np.zeros(0, np.uint64))[0]) == 0


# Conversation trie --------------------------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        head = [t[2:] for t in sorted(own.get(c - c % 20, []), key=lambda t: t[:2])]
        paths[c] = head[:h] + [t[2:] for t in sorted(own[c], key=lambda t: t[:2])][h:]
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", q[-1][1])) for q in below if q)
        ends = ",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), kids[p], sum(not kids[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


CONV = "conv_id long, turn long, role string, text string"


def test_trie_equals_a_plain_one(spark):
    r = random.Random(5)
    rows = []
    for c in [*range(0, 45), 61, 62, 79, 100]:
        for turn in range(r.choice([0, 1, 2, 3, 5, 8])):
            rows.append((c, turn, r.choice(["user", "assistant"]), r.choice(["hello there", "yes", "", "no no no"])))
    # One long conversation and a twin that leaves it late, so that chains have to be spliced.
    rows += [(200, t, "user", f"word {t}") for t in range(40)] + [(201, t, "user", f"word {t}" if t < 33 else "other") for t in range(37)]
    rows += [(300, None, None, None), (300, 4, None, "a b"), (301, 1, "user", None), (None, 1, "user", "lost")]
    wide = spark.createDataFrame([(*x, 1, "s") for x in rows], CONV + ", depth int, node string")
    assert trie_rows(conversation_trie(wide.repartition(3))) == plain_trie(rows)


def test_trie_of_repeated_and_missing_rows(spark):
    empty = spark.createDataFrame([], CONV)
    assert conversation_trie(empty).count() == 0
    # Repeated rows are turns of their own; turns of equal number have a fixed order.
    rows = [(7, 1, "user", "same")] * 5 + [(8, 1, "user", "same")] * 5 + [(9, 1, "user", "b"), (9, 1, "user", "a"), (9, 1, "user", "c")]
    got = trie_rows(conversation_trie(spark.createDataFrame(rows, CONV)))
    assert got == trie_rows(conversation_trie(spark.createDataFrame(list(reversed(rows)), CONV)))
    plain = [x for x in plain_trie(rows) if x[0] != 9]
    assert [x for x in got if x[0] != 9 and x[1] > 0] == [x for x in plain if x[1] > 0]


def test_tables_of_a_trie_do_not_grow_with_its_depth(spark, monkeypatch):
    from casewright.llm.scratch import Scratch

    made, plain = [], Scratch.stage
    monkeypatch.setattr(Scratch, "stage", lambda self, df, name: made.append(name) or plain(self, df, name))
    tables = []
    for depth in (2, 60):
        rows = [(c, t, "user", f"word {min(t, 7 * c)}") for c in range(400, 406) for t in range(depth + c % 3)]
        assert trie_rows(conversation_trie(spark.createDataFrame(rows, CONV))) == plain_trie(rows)
        tables.append(len(made))
        made.clear()
    assert tables[0] == tables[1]


def test_hashes_of_ends_over_several_pieces(spark, monkeypatch):
    from casewright.llm import conversation_trie as module

    monkeypatch.setattr(module, "PIECE", 3)
    rows = [(c, t, "user", "x") for c in range(1000, 1200) for t in range(4)]
    assert trie_rows(conversation_trie(spark.createDataFrame(rows, CONV))) == plain_trie(rows)


# Ranked search ------------------------------------------------------------------------------------


def plain_search(docs, items, k):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
                for t in set(terms(text)) if t in c
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


ITEMS, DOCS = "item_id long, text string, score int, key string", "doc_id long, text string, rank int, number string, terms int"


@pytest.mark.parametrize("block,run", [(lexical_search.BLOCK_DOCS, lexical_search.RUN), (40, 7)])
def test_search_equals_a_plain_one(spark, prose, monkeypatch, block, run):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", block)
    monkeypatch.setattr(lexical_search, "RUN", run)
    monkeypatch.setattr(lexical_search, "PASS_TERMS", 60)
    r = random.Random(8)
    docs = [(i, prose(i, r.randrange(1, 80))) for i in range(300)]
    docs += [(400 + i, docs[5][1]) for i in range(70)] + [(7, docs[7][1]), (None, docs[9][1]), (501, None), (502, ""), (503, " .,- ")]
    docs += [(504, prose(504, 9000)), (505, "É é ß1 A-b")]
    items = [(i, prose(1000 + i, 25)) for i in range(8)] + [(8, docs[5][1]), (9, None), (10, ""), (11, "zzz unseen"), (12, "é a a A"), (3, prose(5, 4)), (None, prose(6, 6))]
    got = ranked_search(
        spark.createDataFrame([(*d, 1, "x", 2) for d in docs], DOCS).repartition(3), spark.createDataFrame([(*i, 1, "x") for i in items], ITEMS), 20
    )
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(docs, items, 20)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", 1, "x", 2)], DOCS), spark.createDataFrame([(1, "a", 1, "x")], ITEMS)
    assert ranked_search(docs.limit(0), items).count() == 0
    assert ranked_search(docs, items.limit(0)).count() == 0
    assert ranked_search(docs.limit(0), items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
