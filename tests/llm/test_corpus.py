"""Classifier, mix, language model, decontamination and token files on small rows."""

import math
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from casewright.llm import class_lm, curriculum, decontaminate, importance, token_files
from casewright.llm.queries import tokenizer_path
from casewright.session import scratch_path

from . import brute


def test_mix_meets_targets_and_places_documents(awkward):
    rows = curriculum.mixing_table(awkward).collect()
    assert len(rows) == awkward.count() and {r.size for r in rows if r.doc_id in (5, 6, 7)} == {0}
    by_source = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        for p in (r.position_1, r.position_2):
            assert p is None or 0 <= p <= 1
        by_source.setdefault(r.target, []).append(r)
    total = sum(r.size for r in rows)
    assert sum(by_source) == pytest.approx(1.5 * total)
    for target, own in by_source.items():
        assert sum(r.taken for r in own) == math.floor(target + 0.5)
        assert target <= 2 * own[0].source_size
    again = curriculum.mixing_table(awkward.repartition(3)).collect()
    assert sorted(rows, key=repr) == sorted(again, key=repr)
    assert curriculum.mixing_table(awkward.limit(0)).collect() == []


def test_mixed_documents_follow_the_plan(awkward):
    mixed = curriculum.mix_documents(awkward)
    assert mixed.columns == awkward.columns
    got, whole = mixed.collect(), awkward.collect()
    assert {(r.doc_id, r.source, r.text) for r in got} <= {(r.doc_id, r.source, r.text) for r in whole}
    plan = curriculum.mixing_table(awkward).collect()
    for source in {r.source for r in whole}:
        # One document of a source is rounded to all or nothing, or the source is that document.
        ids = {r.doc_id for r in whole if r.source == source}
        sizes = [len(brute.words(r.text)) for r in got if r.source == source]
        due = sum(p.taken for p in plan if p.doc_id in ids) if None not in ids else None
        if due is not None:
            assert abs(sum(sizes) - due) * 2 <= max(p.size for p in plan if p.doc_id in ids) or len(sizes) == 1
    assert curriculum.mix_documents(awkward.limit(0)).collect() == []


def test_source_of_one_long_document_is_kept(spark, prose):
    docs = spark.createDataFrame([(1, "a", prose(1, 5000)), *((i, "b", prose(i, 10)) for i in range(2, 60))], "doc_id long, source string, text string")
    mix = curriculum.Mix(weights=(1, 60), share=0.5, repeats=2)
    got = curriculum.mix_documents(docs, mix=mix).where("source = 'a'").collect()
    assert [len(r.text.split()) for r in got] == [5000]


def test_inverse_demand_inverts_a_schedule(spark):
    schedule = ((0, 0.0), (0.25, 2.0), (1, 0.5))
    us = [0.0, 0.01, 0.2, 0.5, 0.9, 1.0]
    df = spark.createDataFrame([(u,) for u in us], "u double").select("u", curriculum.inverse_demand(F.col("u"), schedule).alias("t"))
    grid = np.linspace(0, 1, 200_001)
    mass = np.concatenate([[0], np.cumsum(np.diff(grid) * (np.interp(grid, *zip(*schedule))[1:] + np.interp(grid, *zip(*schedule))[:-1]) / 2)])
    for u, t in df.collect():
        assert np.interp(t, grid, mass) / mass[-1] == pytest.approx(u, abs=1e-4)


def test_importance_sampling_keeps_good_text(spark, prose, awkward):
    good = [(i, prose(100 + i, 60)) for i in range(80)]
    bad = [(100 + i, " ".join(w + "@@" for w in prose(300 + i, 60).split())) for i in range(20)]
    docs = spark.createDataFrame([*good, *bad, (500, None), (501, " "), (None, prose(7, 60)), (0, good[0][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _ in [*good[::2], *bad[::2]]] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    sample = importance.importance_sample(docs, labels)
    kept = {r.doc_id for r in sample.where("kept").collect()}
    assert len(kept & set(range(80))) >= 76 and not kept & set(range(100, 120)) and not kept & {500, 501}
    rows = importance.kept_documents(docs, sample)
    assert rows.columns == docs.columns and rows.where("doc_id = 0").count() == 2
    assert importance.importance_sample(docs, labels.limit(0)).where("kept").count() == 0
    assert importance.importance_sample(docs.limit(0), labels).count() == 0
    assert importance.importance_sample(awkward, labels).count() == awkward.where("text RLIKE '[^ \t\n]'").count()
    fixed = importance.importance_sample(docs, labels, size=10)
    assert fixed.where("kept").count() == 10


def test_importance_weights_against_counts(spark):
    docs = spark.createDataFrame([(1, "abcdabcd"), (2, "xyz"), (3, "abcdxxxx")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")

    def grams(t):
        return [t[i: i + 4] for i in range(max(1, len(t) - 3))]

    texts = {r.doc_id: r.text for r in docs.collect()}
    raw = [g for t in texts.values() for g in grams(t)]
    share = {g: (raw.count(g) + 0.5) / (len(raw) + 0.5 * importance.BUCKETS) for g in raw}
    target = grams(texts[1])
    k = importance.PRIOR * len(target)
    want = {i: sum(math.log((target.count(g) + k * share[g]) / ((len(target) + k) * share[g])) for g in grams(t)) for i, t in texts.items()}
    got = {r.doc_id: r.log_weight for r in importance.importance_sample(docs, labels).collect()}
    assert got == {i: pytest.approx(w) for i, w in want.items()}


def test_class_model_against_counts(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    tokens = [(d, [*brute.words(t), "<end>"]) for d, t in rows]
    held = {d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0 for d, _ in rows}
    counts = {}
    for d, ws in tokens:
        for w in ws if not held[d] else ():
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = sorted((repr(d), held[d], len(ws), sum(w in counts for w in ws), n, round(sum(math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for d, ws in tokens)
    scored = class_lm.score(awkward, classes=8, rounds=2).collect()
    got = sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored)
    assert got == want
    assert all(r.score < 0 for r in scored)
    assert class_lm.score(awkward.limit(0), classes=8, rounds=1).collect() == []


def test_best_moves_is_the_exact_gain():
    rng = np.random.default_rng(3)
    size, units = 4, 12
    pairs = rng.integers(0, 9, (units, units)).astype(float)
    classes = rng.integers(0, size, units)

    def table(c):
        hot = np.eye(size)[c]
        return hot.T @ pairs @ hot

    hot = np.eye(size)[classes]
    own = np.diag(pairs)
    off = pairs - np.diag(own)
    best, gain = class_lm.best_moves(off.T @ hot, off @ hot, own, classes, table(classes))
    for u in range(units):
        values = []
        for c in range(size):
            moved = classes.copy()
            moved[u] = c
            values.append(class_lm.likelihood(table(moved)))
        assert best[u] == int(np.argmax(values)) or gain[u] == 0
        assert gain[u] == pytest.approx(max(values) - values[classes[u]], abs=1e-6)


def test_model_is_better_than_counts_on_held_out_text(spark, prose):
    # Two languages: the class of a word tells much about the next one.
    rows = [(i, " ".join(("a" if i % 2 else "b") + w for w in prose(1000 + i, 150).split())) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sums = class_lm.score(docs, classes=8, rounds=4).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > sums[1]


def test_leaks_against_brute_force(spark, prose, awkward):
    items = {1: prose(40, 30), 2: prose(41, 20), 3: "only four words here", 4: None, 5: "", 6: prose(40, 30)}
    cut = items[1].split()
    docs = {
        1: "start " + items[1].upper() + " end", 2: prose(50, 40) + " " + " ".join(cut[:27] + ["x", "y", "z"]) + " " + prose(51, 40),
        3: " ".join(cut[:18]), 4: "so Only four\twords here it is", 5: prose(52, 200), 6: items[2], 7: None, 8: "", 9: "four words here only",
        10: prose(60, 6000) + " " + items[2] + " " + prose(61, 6000),
    }
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").withColumn("item", F.lit(1)).withColumn("key", F.lit("k"))
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string").withColumn("text2", F.lit("x"))
    found = decontaminate.leaks(df, benchmark)
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found.collect()}
    assert got == {k: round(v, 9) for k, v in brute.leaks(docs, items).items()}
    assert {1, 2, 4, 6, 10} <= {d for d, _ in got} and 5 not in {d for d, _ in got}
    clean = decontaminate.without_leaks(df, found)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == set(docs) - {d for d, _ in got}
    assert decontaminate.leaks(df, benchmark.limit(0)).collect() == [] and decontaminate.leaks(df.limit(0), benchmark).collect() == []
    assert decontaminate.leaks(awkward, benchmark).columns == found.columns


def test_a_truncated_item_is_a_leak(spark, prose):
    item = prose(43, 59).split()
    docs = {1: " ".join(item[:58]), 2: " ".join(item[4:]), 3: " ".join(item[:46]), 4: " ".join(item[:45]), 5: "x " + " ".join(item[:50]), 6: " ".join(item[:3])}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = decontaminate.leaks(df, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    want = {}
    for d, text in docs.items():
        have, whole = set(brute.runs(text)), set(brute.runs(" ".join(item)))
        if 100 * len(have & whole) >= 75 * len(have | whole):
            want[d] = (round(len(have & whole) / len(have | whole), 9), 0, len(brute.words(text)))
    assert {r.doc_id: (round(r.similarity, 9), r.first_word, r.n_words) for r in found.collect()} == want
    assert set(want) == {1, 2, 3, 5} and want[1][0] == round(54 / 55, 9)
    assert [r.doc_id for r in decontaminate.without_leaks(df, found).orderBy("doc_id").collect()] == [4, 6]


def test_fingerprint_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, decontaminate.BITS // 8).astype(np.uint8)
    bits = np.unpackbits(base)
    prints = []
    for far in (0, 1, 20, decontaminate.RADIUS, decontaminate.RADIUS + 1, 120):
        other = bits.copy()
        other[rng.permutation(len(bits))[:far]] ^= 1
        prints.append(np.packbits(other))
    found = decontaminate.close_items(np.stack(prints), base[None, :])[:, 0].tolist()
    assert found == [True, True, True, True, False, False]


def test_token_files_round_trip(spark, awkward):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    more = spark.createDataFrame(
        [(70, "It's <|endoftext|> <|ENDOFTEXT|>x don't*'s 12ab-C…. É́ a\u0085b  c"), (70, "again"), (2**62, "x"), (-5, "minus")], "doc_id long, text string"
    )
    docs = awkward.select("doc_id", "text").union(more)
    path = scratch_path(spark, "test-tokens")
    token_files.write_token_files(docs, path, tokenizer_path())
    back = token_files.read_documents(spark, path, with_ids=True).collect()
    want = sorted(((repr(r.doc_id), np.array(plain.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for r in docs.collect()))
    assert sorted((repr(r.key), bytes(r.ids)) for r in back) == want
    back.sort(key=lambda r: r.start)
    start = 0
    for r in back:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(r.ids) // 4, zlib.crc32(bytes(r.ids)))
        start += r.n_tokens
    keys = [r.key for r in back]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    reader = token_files.KeyedReader(spark, path)
    for r in (back[0], back[5], back[-1]):
        assert reader.get(r.key, r.copy).astype("<u4").tobytes() == bytes(r.ids)
    assert reader.get(12345) is None and reader.get(70, 1) is not None and reader.get(70, 2) is None
    empty = scratch_path(spark, "test-tokens")
    token_files.write_token_files(docs.limit(0), empty, tokenizer_path())
    assert token_files.read_documents(spark, empty).collect() == [] and token_files.KeyedReader(spark, empty).get(1) is None


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64))
    perfect = token_files.PerfectHash.build(keys)
    assert sorted(perfect.slot(keys).tolist()) == list(range(len(keys)))
    again, _ = token_files.PerfectHash.unpack(perfect.pack())
    assert (again.slot(keys) == perfect.slot(keys)).all()
    size = 8 * len(perfect.pack()) / len(keys)
    assert size < 6  # bits a key


def test_pipeline_stages_take_effect(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.stage(stage(spark, docs, folder), "test")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        if i == 1:
            from casewright.llm.jaccard_join import ngram_jaccard_join

            assert ngram_jaccard_join(out).where("component_id <> doc_id").count() == 0
        docs = out
    assert 0 < docs.count() < 2 * before and docs.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_library_does_not_use_this_package():
    top = os.path.dirname(os.path.dirname(class_lm.__file__))
    for folder, _, names in os.walk(top):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    assert not re.search(r"\bllm\b", open(os.path.join(folder, name)).read()), name
