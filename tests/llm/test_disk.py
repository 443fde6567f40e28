"""What operators leave on disk, how many rounds links take, and how often the tokenizer is asked."""

import glob
import os

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from casewright.llm import links, paragraph_dedup, token_files
from casewright.llm.jaccard_join import first_of_groups
from casewright.llm.links import SIGNATURES, Gatherer, linked
from casewright.llm.queries import tokenizer_path
from casewright.llm.scratch import Scratch

from .test_dedup import Known


def local(spark, root):
    return spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath()


def test_linking_keeps_no_table_but_its_labels(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(links, "pivot_pairs", lambda *args: rounds.append(args))
    rows = [(8 * s, n) for s in range(1, 6) for n in range(10 * s, 10 * s + 5)]
    known = Known(spark, range(60), [(11, 12), (11, 13), (40, 44), (51, 54)])
    with Scratch(spark, "test") as scratch:
        labels = linked(scratch, spark.createDataFrame(rows, SIGNATURES), known)
        assert dict(labels.collect()) == {11: 11, 12: 11, 13: 11, 40: 40, 44: 40, 51: 51, 54: 51}
        assert len(os.listdir(local(spark, scratch.root))) == 1
    assert not rounds  # few pairs are open, so they are tried at once


def test_observed_facts_are_those_of_the_table(spark):
    with Scratch(spark, "test") as scratch:
        for n in (0, 7):
            table, facts = scratch.observed(spark.range(n), "seven", F.count("*"), F.sum("id"))
            assert table.count() == n and facts == (n, 21 if n else None)


def test_shares_of_signatures_are_all_of_them(spark, prose):
    texts = spark.createDataFrame([(prose(i, 80),) for i in range(9)], "text string")
    shape = 50, 30, 5
    whole = paragraph_dedup.unit_signatures(texts, 75, shape).collect()
    shares = [paragraph_dedup.unit_signatures(texts, 75, shape, k, 2).collect() for k in range(2)]
    assert sorted(whole) == sorted(shares[0] + shares[1]) and all(shares)
    assert not {r.sig for r in shares[0]} & {r.sig for r in shares[1]}
    found = Gatherer(1, 2)
    found.add(np.arange(0, 1 << 35, 1 << 32, dtype=np.uint64), np.uint64(5))
    assert found.n == 4


def test_first_of_groups_leaves_no_copy_of_the_texts(spark, awkward):
    root = local(spark, spark.sparkContext.getCheckpointDir()) if spark.sparkContext.getCheckpointDir() else None
    before = set(glob.glob(f"{root}/**/*.parquet", recursive=True)) if root else set()
    assert first_of_groups(awkward).count() == first_of_groups(awkward).distinct().count()
    root = local(spark, spark.sparkContext.getCheckpointDir())
    new = set(glob.glob(f"{root}/**/*.parquet", recursive=True)) - before
    assert new and not any("text" in pq.read_schema(f).names for f in new)


def test_pieces_are_encoded_together():
    path = tokenizer_path()
    ready, calls = token_files.Encoder(path), []
    plain = token_files.Encoder(path)
    encode = ready._encode
    ready._encode = lambda texts: calls.extend(texts) or encode(texts)
    pieces = [f"{a}{b}" for a in ("word", "ünï", "4711", "don't", "é", "!?", "a,b", "<x>") for b in range(40)]
    ready.learn(pieces, np.arange(len(pieces), dtype=np.uint64))
    assert len(calls) < len(pieces) / 2
    for i, piece in enumerate(pieces):
        k = ready.where[np.searchsorted(ready.known, np.uint64(i))]
        own = ready.pool[ready.begin[k]: ready.begin[k] + ready.length[k]]
        assert own.tolist() == plain._encode([piece])[0], piece


def test_a_piece_with_the_id_of_the_mark_is_encoded_alone():
    ready = token_files.Encoder(tokenizer_path())
    pieces = ["left", "a,b", "right"]
    ids, length = ready._joined(pieces)
    single = ready._single(pieces)
    assert ids.tolist() == single[0].tolist() and length.tolist() == single[1].tolist()
