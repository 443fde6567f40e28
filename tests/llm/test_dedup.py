"""Joins and near duplicates against brute force, on awkward rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casewright.llm import links
from casewright.llm.jaccard_join import _limit, first_of_groups, ngram_jaccard_join, schemes_of, signatures_of
from casewright.llm.line_dedup import line_repeats
from casewright.llm.links import PLAIN, SIGNATURES, Gatherer, components, linked
from casewright.llm.paragraph_dedup import paragraph_repeats, tune, without_repeats
from casewright.llm.scratch import Scratch
from casewright.llm.words import mix, words_of

from . import brute


def rows_of(df):
    return [(i, r.doc_id, r.text) for i, r in enumerate(df.select("doc_id", "text").collect())]


def test_jaccard_join_on_awkward_rows(awkward):
    rows = rows_of(awkward)
    groups = brute.similar_groups({i: set(brute.runs(t)) for i, _, t in rows}, 75)
    members = {}
    for i, d, _ in rows:
        members.setdefault(groups[i], []).append(d)
    least = {g: min((d for d in ds if d is not None), default=None) for g, ds in members.items()}
    want = sorted([(d, len(set(brute.runs(t))), least[groups[i]]) for i, d, t in rows], key=repr)
    got = sorted([tuple(r) for r in ngram_jaccard_join(awkward).collect()], key=repr)
    assert got == want


def test_jaccard_join_of_nothing(awkward):
    assert ngram_jaccard_join(awkward.limit(0)).collect() == []
    assert first_of_groups(awkward.limit(0)).columns == awkward.columns


def test_one_document_of_each_group_stays(awkward):
    kept = first_of_groups(awkward)
    assert kept.columns == awkward.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    # 2 and a document without id are near copies of 1, 4 of 3, 9 of 8; blank ones stay.
    assert ids == sorted([1, 3, 5, 6, 7, 8, 10, None, 11, 12, 13, 14, 15], key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 12, 20, 33, 50, 90, 200, 700])
def test_pigeonhole_finds_every_similar_pair(n):
    import numpy as np

    rng = np.random.default_rng(n)
    for trial in range(60):
        members = np.unique(mix(rng.integers(1, 1 << 60, n).astype(np.uint64)))
        m = int(rng.integers(n, n * 100 // 75 + 1))
        # The farthest set of size m that is still similar.
        common = -(-75 * (len(members) + m) // 175)
        if common > len(members):
            continue
        other = np.unique(np.concatenate([rng.permutation(members)[:common], mix(rng.integers(1, 1 << 60, m - common).astype(np.uint64))]))
        freq = rng.integers(0, 100, len(members)), rng.integers(0, 100, len(other))
        a, b = signatures_of(members, 75, freq[0]), signatures_of(other, 75, freq[1])
        assert len(np.intersect1d(a, b)), (n, m, trial)
    assert schemes_of(n, 75) and _limit(n, n, 75) == n * 2 * 25 // 175


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    with Scratch(spark, "test") as scratch:
        got = dict(components(scratch, spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


class Known:
    """A check that knows the links."""

    def __init__(self, spark, nodes, links):
        self.nodes = spark.createDataFrame([(n, 0) for n in nodes], "node long, tk long")
        self.links = spark.createDataFrame(links, "a long, b long")

    def near(self, left, right):
        return F.lit(True)

    def likely(self, pairs):
        return pairs

    def linked(self, likely):
        self.pairs = getattr(self, "pairs", 0) + likely.count()
        return likely.join(self.links, ["a", "b"])


def links_of(spark, flushes, links):
    """Labels of (node -> signatures) of each flush, with these links."""
    rows = []
    for flush in flushes:
        found = Gatherer()
        for node, sigs in flush.items():
            found.add(np.array(sigs, np.uint64) << np.uint64(8), np.uint64(node))
        rows += [tuple(r.values()) for batch in found.rows() for r in batch.to_pylist()]
    nodes = {n for flush in flushes for n in flush}
    with Scratch(spark, "test") as scratch:
        return dict(linked(scratch, spark.createDataFrame(rows, SIGNATURES), Known(spark, nodes, links)).collect())


def test_a_node_meets_the_companions_of_a_head(spark):
    crowd = {n: [1] for n in range(1, PLAIN + 3)}
    assert links_of(spark, [crowd, {20: [1]}], [(7, 20)]) == {7: 7, 20: 7}
    # Two signatures with the same head and the same other nodes, but different companions.
    flushes = [{1: [1, 2], **{n: [1] for n in range(2, 12)}, **{n: [2] for n in range(30, 40)}}, {20: [1, 2], 21: [1, 2]}]
    assert links_of(spark, flushes, [(5, 20), (21, 35)]) == {5: 5, 20: 5, 21: 21, 35: 21}


def test_a_group_that_its_least_node_is_not_in_needs_few_pairs(spark):
    nodes = range(1, 301)
    rows = [(8, n) for n in nodes]
    known = Known(spark, nodes, [(a, b) for a in nodes for b in nodes if 1 < a < b])
    with Scratch(spark, "test") as scratch:
        got = dict(linked(scratch, spark.createDataFrame(rows, SIGNATURES), known).collect())
    assert got == {n: 2 for n in nodes if n > 1} and known.pairs < 5 * 300


def test_no_link_of_a_shared_signature_is_lost(spark):
    rng = random.Random(4)
    flushes = [{rng.randrange(1, 90): [s for s in range(1, 9) if rng.random() < 0.25] for _ in range(60)} for _ in range(3)]
    sigs = {}
    for flush in flushes:
        for node, own in flush.items():
            sigs.setdefault(node, set()).update(own)
    pairs = [(a, b) for a in sorted(sigs) for b in sorted(sigs) if a < b and sigs[a] & sigs[b]]
    links = rng.sample(pairs, 25)
    want = {n: n for link in links for n in link}
    for _ in links:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert links_of(spark, flushes, links) == want


def repeated_runs(rows, least=50):
    """{document: places of runs of ``least`` words that another document has}, documents being distinct rows."""
    where = {}
    for d, t in sorted({(d, t) for _, d, t in rows}, key=repr):
        for at, run in enumerate(brute.runs(t, least)):
            if len(run) == least:
                where.setdefault(run, set()).add((d, t, at))
    found = {}
    for places in where.values():
        if len({p[:2] for p in places}) > 1:
            for d, t, at in places:
                found.setdefault((d, t), set()).add(at)
    return found


def check_passages(docs, found):
    """Every such run is reported around a passage, and documents that share no five words with others are left alone."""
    rows, spans = rows_of(docs), {}
    for r in found:
        spans.setdefault(r.doc_id, []).append((r.first_word, r.first_word + r.n_words))
    for (d, _), places in repeated_runs(rows).items():
        for at in places:
            assert any(max(at, a) < min(at + 50, b) for a, b in spans.get(d, [])), (d, at)
    holders = {}
    for i, (d, t) in enumerate({(d, t) for _, d, t in rows}):
        for run in set(brute.runs(t)):
            holders.setdefault(run, set()).add((d, i))
    related = {d for ds in holders.values() if len(ds) > 1 for d, _ in ds}
    assert set(spans) <= related
    assert all(r.n_words >= 50 and r.copies > 1 for r in found)


def test_passages_across_lines_and_breaks(spark, prose):
    for least in (50, 70):
        run = prose(70, least).split()
        longer, other = prose(71, 300).split(), prose(72, 200).split()
        short = prose(73, 49)
        rows = [
            (1, " ".join(run)), (2, " ".join([*longer[:150], *run, *longer[150:]])),
            (3, "\n".join([*other[:9], " ".join(run[:20]), "  ".join(run[20:33]).upper(), "\t".join(run[33:]), *other[9:20]])),
            (4, prose(74, 400)), (5, prose(75, 60) + " " + short), (6, short + " " + prose(76, 60)), (7, None), (8, ""),
        ]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        found = paragraph_repeats(docs).collect()
        check_passages(docs, found)
        assert {r.doc_id for r in found} == {1, 2, 3}
        gone = [r for r in found if r.removed]
        assert {r.doc_id for r in gone} == {2, 3} and {r.cluster_id for r in gone} == {1}
        cleaned = {r.doc_id: r.text for r in without_repeats(docs, spark.createDataFrame(found)).collect()}
        assert brute.words(cleaned[1]) == run and cleaned[7] is None and cleaned[8] == ""
        left = brute.words(cleaned[2])
        assert [w for w in left if w in longer][:150] == longer[:150] and len(left) < 300 + 40
        if least < 60:
            assert left == longer and brute.words(cleaned[3]) == other[:20] and "\n" in cleaned[3]


def test_passages_of_awkward_rows(awkward):
    found = paragraph_repeats(awkward)
    check_passages(awkward, found.collect())
    cleaned = without_repeats(awkward, found)
    assert cleaned.columns == awkward.columns and cleaned.count() == awkward.count()
    assert paragraph_repeats(awkward.limit(0)).collect() == []
    assert without_repeats(awkward.limit(0), found).collect() == []


def test_passages_of_the_small_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_passages(docs, paragraph_repeats(docs).collect())


def test_bands_reach_the_recall():
    bands, rows = tune(75)
    assert bands * rows <= 100 and rows > 1 and 1 - (1 - 0.1**rows) ** bands <= 0.1 and 1 - (1 - 0.75**rows) ** bands >= 0.999


def test_lines_with_null_keys_repeats_and_clashing_columns(spark, awkward, prose):
    text = "\n\n".join([prose(80, 9), "a b a", "B  a", " ", prose(81, 5)])
    extra = spark.createDataFrame([(None, text), (30, text), (30, text), (31, "\n" + prose(81, 5))], "doc_id long, text string")
    docs = awkward.unionByName(extra, allowMissingColumns=True)
    sets, first = {}, {}
    for d, t in sorted(((d, t) for _, d, t in rows_of(docs)), key=lambda r: (r[0] is not None, r[0] or 0)):
        for n, line in enumerate((t or "").split("\n")):
            if brute.words(line):
                here, s = (d is not None, d or 0, n), frozenset(brute.words(line))
                sets.setdefault(s, []).append(here)
                first[s] = min(first.get(s, here), here)
    want = []
    for s, places in sets.items():
        near = min(f for o, f in first.items() if 100 * len(s & o) >= 80 * len(s | o))
        want += [(h[1] if h[0] else None, h[2], near[1] if near[0] else None, near[2]) for h in places if h != near]
    assert sorted((tuple(r) for r in line_repeats(docs).collect()), key=repr) == sorted(want, key=repr)


def test_lines_against_brute_force(spark, awkward, prose):
    base = prose(3, 12).split()
    extra = [(20, "\n".join([" ".join(base), "the end", " ".join(base[:11] + ["else"]), "", "end the"])), (21, "THE END\n" + " ".join(base[:9]))]
    docs = awkward.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string")).dropDuplicates()
    sets, first = {}, {}
    for _, d, t in sorted(rows_of(docs), key=lambda r: (r[1] is not None, r[1] or 0)):
        for n, line in enumerate((t or "").split("\n")):
            if brute.words(line) and d is not None:
                sets[d, n] = frozenset(brute.words(line))
                first.setdefault(sets[d, n], (d, n))
    want = []
    for here, s in sets.items():
        near = [f for o, f in first.items() if 100 * len(s & o) >= 80 * len(s | o)]
        if min(near) < here:
            want.append((*here, *min(near)))
    got = [tuple(r) for r in line_repeats(docs.where("doc_id IS NOT NULL")).collect()]
    assert sorted(got) == sorted(want) and len(want) > 4
    assert line_repeats(docs.limit(0)).collect() == []
    assert line_repeats(docs).where("match_id IS NULL").count() >= 1  # a null key sorts first


def pairs_met(rows):
    """Pairs that rows of meetings name, all pairs of a signature included."""
    held, pairs = {}, set()
    for s, a, b in rows:
        if s is None:
            pairs.add((min(a, b), max(a, b)))
        else:
            held.setdefault(s, set()).add(a)
    return pairs | {(a, b) for v in held.values() for a in v for b in v if a < b}


@pytest.mark.parametrize("chunk", [64, 500, 3000])
def test_meetings_in_runs_equal_those_of_all_rows(monkeypatch, chunk):
    r = np.random.default_rng(0)
    sig = np.concatenate([r.integers(0, 1000, 5000) * 4, np.full(2000, 777 * 4), r.integers(0, 50, 100) * 4 + 2])
    node = r.integers(0, 200, len(sig))
    order = np.argsort(sig, kind="stable")
    sig, node = sig[order], node[order]
    want = {}
    for s, v in zip((sig & ~2).tolist(), node.tolist(), strict=True):
        want.setdefault(s, set()).add(v)
    monkeypatch.setattr(links, "CHUNK", chunk)
    batches = (pa.record_batch([pa.array(sig[i: i + 100]), pa.array(node[i: i + 100])], names=["sig", "node"]) for i in range(0, len(sig), 100))
    got = [row for batch in links._meetings(batches) for row in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)]
    assert pairs_met(got) == {(a, b) for v in want.values() for a in v for b in v if a < b}


def test_words_of_a_text_longer_than_a_slice(prose):
    text = prose(3, 150_000) + " " + "x" * 700_000 + " end"
    found = words_of(pa.array([None, text, ""])).hash
    assert len(found) == 150_002
    for i in (0, 77_777, 149_999, 150_000, 150_001):
        assert found[i] == words_of(pa.array([text.split()[i]])).hash[0]


def test_shuffle_files_go_when_a_table_is_written(spark):
    import time

    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}

    before, key = shuffled(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key)
    with Scratch(spark, "tidy") as scratch:
        table = scratch.stage(spark.range(1000).repartition(3, F.col("id") % 7), "dealt")
        assert table.count() == 1000
        for _ in range(100):
            if not (left := shuffled() - before):
                break
            time.sleep(0.1)
        assert not left
    assert spark.conf.get(key) == setting
