"""Token ids in binary shards, with a minimal perfect hash index from document keys to places.

Layout of a folder (all numbers little-endian):

* ``data/kind=ids/shard=S/``: the raw ids of the shard's documents one after the other, 2 bytes each
  (4 if the vocabulary is larger), every document closed by the end id;
* ``data/kind=keys/shard=S/``: for each document of the shard its key and number of ids;
* ``index/bucket=B/``: a minimal perfect hash of the keys of a bucket (hash of the key modulo the
  number of buckets) with an entry for each slot: fingerprint, shard, offset in the shard, ids;
* ``manifest/``: id width, number of buckets, documents and end id as JSON.

Spark's text writer makes the binary files: rows are bytes, and the line separator is the end id
(or a fixed byte after keys and index entries). Documents are in ascending key order, and a task
begins a new shard at ``SHARD_BYTES``, so a shard never grows with the data.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordering import scan_within
from .scratch import Scratch
from .words import Words, hash_spans, keep, mix, slices, words_of

SHARD_BYTES = 16 << 20
CHUNK_BYTES = 1 << 20
#: Documents of an index bucket on average.
BUCKET_KEYS = 50_000
#: Distinct pieces whose ids a task keeps; the table is emptied when it is full.
KNOWN_PIECES = 500_000
#: Pieces that the tokenizer encodes at once, and the sign between them.
JOINED, MARK = 64, ","
#: Bytes of text encoded at once.
ENCODE_BYTES = 1 << 20
_ENTRY = np.dtype([("print", "<u4"), ("shard", "<u8"), ("offset", "<u8"), ("n", "<u8"), ("key", "<i8"), ("null", "<u1"), ("copy", "<u8")])
_KEY = np.dtype([("key", "<i8"), ("null", "<u1"), ("n", "<u8")])


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.arange(256) < 128
_MARK &= ~_LETTER
_MARK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def pieces_of(texts: pa.Array) -> Words:
    """Words cut further where an ASCII letter meets another ASCII sign; A-Z count as a-z.

    The tokenizer always cuts there, but for an apostrophe before a letter. A word with "<" may
    hold a special token, so it stays whole and keeps its case.
    """
    words = words_of(texts)
    data, start, stop = words.data, words.start, words.stop
    if len(data) < 2:
        return words
    letter, mark = _LETTER[data], _MARK[data]
    edge = letter[:-1] & mark[1:]
    edge |= mark[:-1] & letter[1:] & (data[:-1] != 0x27)
    cut = np.flatnonzero(edge) + 1
    special = np.unique(np.searchsorted(start, np.flatnonzero(data == 0x3C), "right") - 1)
    if len(special):
        cut = cut[~np.isin(np.searchsorted(start, cut, "right") - 1, special)]
    # A cut at the edge between two texts is no new piece.
    first = start[np.minimum(words.first[:-1], len(start) - 1)]
    cut = cut[~np.isin(cut, first)]
    begin, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([stop, cut]))
    hashed = hash_spans(data, begin, end)
    if len(special):
        at = np.searchsorted(begin, start[special])
        hashed[at] = hash_spans(data, begin[at], end[at], lower=False) ^ np.uint64(1)
    lasts = np.concatenate([start, [len(data)]])[words.first]
    return Words(hashed, np.searchsorted(begin, lasts), begin, end, data, words.offsets)


class Encoder:
    """Ids of whole texts from the ids of their pieces.

    For lower-casing tokenizers that drop white space and cut between letters and other signs, a
    text's ids are those of its pieces in a row, so each distinct piece of a task is encoded once.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.known, self.where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.length, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def learn(self, pieces: list[str], hashes: np.ndarray) -> None:
        alone = np.array([MARK in p or "<" in p for p in pieces], bool)
        order = np.argsort(alone, kind="stable")
        pieces, joined = [pieces[i] for i in order.tolist()], int(len(pieces) - alone.sum())
        pools, lengths = [self.pool], [self.length]
        for i in range(0, joined, 10_000):
            ids, length = self._joined(pieces[i: min(i + 10_000, joined)])
            pools.append(ids)
            lengths.append(length)
        ids, length = self._single(pieces[joined:])
        self.pool, self.length = np.concatenate([*pools, ids]), np.concatenate([*lengths, length])
        self.begin = np.cumsum(self.length) - self.length
        known = np.concatenate([self.known, hashes[order]])
        order = np.argsort(known, kind="stable")
        self.where = np.concatenate([self.where, np.arange(len(self.where), len(known))])[order]
        self.known = known[order]

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _single(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and the number of ids of each piece."""
        ids = [ids for i in range(0, len(pieces), 10_000) for ids in self._encode(pieces[i: i + 10_000])]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces without ``MARK``: some are encoded at once, and its id tells where they end."""
        mark = self._encode([MARK])[0]
        if len(mark) != 1:
            return self._single(pieces)
        groups = [pieces[i: i + JOINED] for i in range(0, len(pieces), JOINED)]
        pools, lengths = [], []
        for group, found in zip(groups, self._encode([f" {MARK} ".join(g) for g in groups]), strict=True):
            found = np.array(found, np.uint32)
            at = np.flatnonzero(found == mark[0])
            if len(at) == len(group) - 1:
                pools.append(np.delete(found, at))
                lengths.append(np.diff(at, prepend=-1, append=len(found)) - 1)
            else:  # a piece has the id, too
                ids, length = self._single(group)
                pools.append(ids)
                lengths.append(length)
        return np.concatenate(pools), np.concatenate(lengths)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and the number of ids of each text."""
        pieces = pieces_of(texts)
        distinct, first, back = np.unique(pieces.hash, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > KNOWN_PIECES:
            self.forget()
        at = np.minimum(np.searchsorted(self.known, distinct), max(len(self.known) - 1, 0))
        new = self.known[at] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            raw = pieces.data.tobytes()
            spelt = [raw[a:b].decode() for a, b in zip(pieces.start[first[new]], pieces.stop[first[new]], strict=True)]
            self.learn(spelt, distinct[new])
        own = self.where[np.searchsorted(self.known, distinct)][back] if len(distinct) else np.zeros(0, np.int64)
        length = self.length[own]
        total = np.concatenate([[0], np.cumsum(length)])
        ids = self.pool[np.repeat(self.begin[own] - total[:-1], length) + np.arange(total[-1])]
        return ids, np.diff(total[pieces.first])


def encoder(path: str) -> Encoder:
    """The encoder of this worker process, which keeps what earlier tasks of the stage have learnt."""
    return keep(f"encoder {path}", lambda: Encoder(path))


class Shards:
    """Rows (kind, shard, seq, value) of one task, in order."""

    def __init__(self, task: int, width: int, end: int):
        self.task, self.width, self.n, self.seq, self.size = task, f"<u{width}", 0, 0, 0
        self.end, self.ids, self.held, self.keys = end, [], 0, []

    def flush(self, close: bool) -> Iterator[tuple[str, int, int, bytes]]:
        shard = (self.task << 24) + self.n
        if self.ids:
            # The writer's separator supplies the last end id.
            yield "ids", shard, self.seq, np.concatenate(self.ids)[:-1].astype(self.width).tobytes()
            self.seq, self.ids, self.held = self.seq + 1, [], 0
        if close and self.keys:
            yield "keys", shard, 0, np.concatenate(self.keys).tobytes()
            self.n, self.seq, self.size, self.keys = self.n + 1, 0, 0, []

    def add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> Iterator[tuple[str, int, int, bytes]]:
        stop = np.cumsum(counts)
        entries = np.zeros(len(keys), _KEY)
        entries["key"], entries["null"] = keys["key"], keys["null"]
        entries["n"] = counts + 1
        for i, (a, b) in enumerate(zip(stop - counts, stop, strict=True)):
            self.ids += [ids[a:b], np.array([self.end], np.uint32)]
            self.keys.append(entries[i: i + 1])
            size = (int(b - a) + 1) * int(self.width[2:])
            self.held += size
            self.size += size
            if self.held >= CHUNK_BYTES:
                yield from self.flush(self.size >= SHARD_BYTES)


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 1,
) -> None:
    """Encode whole texts and write shards and index to a new folder.

    Keys are whole numbers; a null key sorts first, rows with equal keys are ordered by a hash of
    their text and told apart by their number among them. A null text is empty and has the end id
    only. Other columns are not read. The tokenizer must drop white space between words. An empty
    table gives an index without buckets.
    """
    spark = docs.sparkSession
    width = 2 if Encoder(tokenizer).tokenizer.get_vocab_size(True) <= 1 << 16 and end_id < 1 << 16 else 4
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie")
    schema = pa.schema([("kind", pa.string()), ("shard", pa.int64()), ("seq", pa.int64()), ("value", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready, out = encoder(tokenizer), Shards(TaskContext.get().partitionId(), width, end_id)

        def sent(parts):
            for part in parts:
                yield pa.record_batch([pa.array([x], f.type) for x, f in zip(part, schema, strict=True)], schema=schema)

        for batch in batches:
            for part in slices(batch, "text", ENCODE_BYTES):
                ids, counts = ready.encode(part.column("text"))
                column = part.column("key")
                keys = np.zeros(part.num_rows, _KEY)
                keys["key"] = pc.fill_null(column, 0).to_numpy()
                keys["null"] = pc.is_null(column).to_numpy(zero_copy_only=False)
                yield from sent(out.add(keys, ids, counts))
        yield from sent(out.flush(True))

    encoded = rows.select("key", "text").mapInArrow(run, "kind string, shard long, seq long, value binary")
    encoded = encoded.sortWithinPartitions("kind", "shard", "seq")
    with Scratch(spark, "token-data"):
        _write(encoded.select("kind", "shard", "value"), f"{path}/data", end_id.to_bytes(width, "little"))
    _write_index(spark, path, width, end_id, docs.isEmpty())


def _write(df: DataFrame, path: str, close: bytes) -> None:
    """One raw file for each folder and task, every row followed by ``close``."""
    parts = [c for c in df.columns if c != "value"]
    writer = df.withColumn("value", F.col("value").cast("string")).write.partitionBy(*parts)
    writer.option("encoding", "ISO-8859-1").option("lineSep", close.decode("latin-1")).text(path)


def _files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(shard, content) of the files of one kind."""
    files = spark.read.format("binaryFile").load(f"{path}/data/kind={kind}")
    shard = F.regexp_extract("path", r"shard=(\d+)/", 1).cast("long").alias("shard")
    return files.select(shard, "content")


def _places(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(shard, at, key, null, offset, n) of each document, from the key files."""
    schema = pa.schema([("shard", pa.int64()), ("at", pa.int64()), ("key", pa.int64()), ("null", pa.int64()), ("offset", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content").to_pylist(), strict=True):
                e = np.frombuffer(content[:-width], _KEY)
                n = e["n"].astype(np.int64)
                yield pa.record_batch([
                    pa.array(np.full(len(e), shard)), pa.array(np.arange(len(e))), pa.array(e["key"].astype(np.int64)),
                    pa.array(e["null"].astype(np.int64)), pa.array(np.cumsum(n) - n), pa.array(n),
                ], schema=schema)

    return _files(spark, path, "keys").mapInArrow(run, "shard long, at long, key long, null long, offset long, n long")


def key_hash(key: np.ndarray, null: np.ndarray, copy: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of (key or null, number among equal keys)."""
    key, null, copy = np.asarray(key).astype(np.int64).view(np.uint64), np.asarray(null), np.asarray(copy).astype(np.uint64)
    return mix(mix(key + np.uint64(seed)) + mix(2 * copy + null.astype(np.uint64) + np.uint64(1)))


class PerfectHash(NamedTuple):
    """Levels of bitmaps; a key's slot is the rank of its bit on the first level that holds it."""

    levels: list[np.ndarray]

    @staticmethod
    def build(keys: np.ndarray) -> "PerfectHash":
        """Keys that are alone in their cell stay on a level; the others go on to the next."""
        levels, rest = [], np.unique(keys)
        while len(rest):
            cells = max(64, 2 * len(rest))
            cell = _cell_of(rest, len(levels), cells)
            alone = np.bincount(cell, minlength=cells)
            levels.append(alone == 1)
            rest = rest[alone[cell] != 1]
        return PerfectHash(levels)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key that was built in; -1 or any slot for others, which fingerprints tell."""
        out, base, rest = np.full(len(keys), -1, np.int64), 0, np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            cell = _cell_of(keys[rest], level, len(bits))
            hit = bits[cell]
            rank = np.cumsum(bits) - 1
            out[rest[hit]] = base + rank[cell[hit]]
            base += int(bits.sum())
            rest = rest[~hit]
        return out

    def pack(self) -> bytes:
        head = np.array([len(self.levels), *(len(b) for b in self.levels)], "<u4").tobytes()
        return head + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @staticmethod
    def unpack(raw: bytes) -> tuple["PerfectHash", int]:
        """The hash and the number of bytes it takes."""
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        sizes, at, levels = np.frombuffer(raw, "<u4", n, 4), 4 + 4 * n, []
        for size in sizes.tolist():
            length = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, length, at), count=size).astype(bool))
            at += length
        return PerfectHash(levels), at


def _cell_of(keys: np.ndarray, level: int, cells: int) -> np.ndarray:
    step = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    return (mix(keys + step) % np.uint64(cells)).astype(np.int64)


def pack_bucket(e: np.ndarray) -> bytes:
    """A bucket of the index: the seed of its hashes, its perfect hash, then an entry for each slot."""
    seed = 0
    while len(np.unique(hashed := key_hash(e["key"], e["null"], e["copy"], seed))) < len(e):
        seed += 1
    perfect = PerfectHash.build(hashed)
    out = np.zeros(len(e), _ENTRY)
    e["print"] = (hashed >> np.uint64(32)).astype(np.uint32)
    out[perfect.slot(hashed)] = e
    return np.array([seed], "<u4").tobytes() + perfect.pack() + out.tobytes()


def unpack_bucket(raw: bytes) -> tuple[PerfectHash, np.ndarray]:
    perfect, at = PerfectHash.unpack(raw[4:])
    return perfect, np.frombuffer(raw, _ENTRY, (len(raw) - 4 - at) // _ENTRY.itemsize, 4 + at)


def find(raw: bytes, keys: np.ndarray, null: np.ndarray, copy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of a bucket for keys, and whether the fingerprint matches."""
    perfect, entries = unpack_bucket(raw)
    hashed = key_hash(keys, null, copy, int(np.frombuffer(raw, "<u4", 1)[0]))
    slot = perfect.slot(hashed)
    found = entries[np.maximum(slot, 0)]
    return found, (slot >= 0) & (found["print"] == (hashed >> np.uint64(32)).astype(np.uint32))


def _write_index(spark: SparkSession, path: str, width: int, end_id: int, empty: bool) -> None:
    with Scratch(spark, "token-index") as scratch:
        places = None if empty else scratch.stage(_places(spark, path, width), "places")
        documents = 0 if empty else places.count()
        buckets = -(-documents // BUCKET_KEYS)
        manifest = {"width": width, "buckets": buckets, "documents": documents, "end_id": end_id}
        spark.range(1).select(F.lit(json.dumps(manifest)).alias("value")).coalesce(1).write.text(f"{path}/manifest")
        if not buckets:
            return
        ranked = scan_within(places, ["null", "key"], ["shard", "at"], rank="copy").withColumn("copy", F.col("copy") - 1)

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hashed = key_hash(*(batch.column(c).to_numpy() for c in ("key", "null", "copy")))
                yield batch.append_column("bucket", pa.array((hashed % np.uint64(buckets)).astype(np.int64)))

        def build(table: pa.Table) -> pa.Table:
            e = np.zeros(table.num_rows, _ENTRY)
            for c in ("shard", "offset", "n", "key", "null", "copy"):
                e[c] = table.column(c).to_numpy()
            return pa.table({"bucket": table.column("bucket").slice(0, 1), "value": pa.array([pack_bucket(e)], pa.binary())})

        columns = ["key", "null", "copy", "shard", "offset", "n"]
        spread = ranked.select(columns).mapInArrow(dealt, ", ".join(f"{c} long" for c in [*columns, "bucket"]))
        _write(spread.groupBy("bucket").applyInArrow(build, "bucket long, value binary"), f"{path}/index", b"\n")


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """(key, copy, shard, offset, n) of all documents through the index; each key is looked up in it."""
    schema = pa.schema([("key", pa.int64()), *((c, pa.int64()) for c in ("copy", "shard", "offset", "n"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("content").to_pylist():
                _, keys = unpack_bucket(raw)
                e, hit = find(raw, keys["key"], keys["null"], keys["copy"])
                if not hit.all() or (e != keys).any():
                    raise ValueError("index entry not found by its key")
                yield pa.record_batch([
                    pa.array(e["key"].astype(np.int64), mask=e["null"].astype(bool)),
                    *(pa.array(e[c].astype(np.int64)) for c in ("copy", "shard", "offset", "n")),
                ], schema=schema)

    files = spark.read.format("binaryFile").load(f"{path}/index").select("content")
    return files.mapInArrow(run, "key long, copy long, shard long, offset long, n long")


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(key, copy, start, n_tokens, ids_crc32) read back from the files, and the ids if asked for.

    ``start`` counts the ids of all documents before, ``copy`` tells rows with equal keys apart. The
    checksum is over the ids as little-endian 4-byte numbers, which is also the form of ``ids``.
    """
    manifest = read_manifest(spark, path)
    columns = "key long, copy long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    if not manifest["documents"]:
        return spark.createDataFrame([], columns)
    width = manifest["width"]
    entries = read_entries(spark, path)
    sizes = entries.groupBy("shard").agg(F.sum("n").alias("n"))
    # A row per shard of up to SHARD_BYTES reaches the driver.
    bases, total = [], 0
    for shard, n in sorted(sizes.collect()):
        bases.append((shard, total))
        total += n
    bases = spark.createDataFrame(bases, "shard long, base long")
    # A shard holds at most SHARD_BYTES of ids, which bounds its list.
    lists = entries.groupBy("shard").agg(F.collect_list(F.struct("key", "copy", "offset", "n")).alias("entries"))
    schema = pa.schema([("key", pa.int64()), ("copy", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.binary())][: int(with_ids)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = np.frombuffer(batch.column("content")[row].as_buffer(), f"<u{width}")
                own, base = batch.column("entries")[row].values, batch.column("base")[row].as_py()
                offset, n = own.field("offset").to_numpy(), own.field("n").to_numpy()
                for i in range(0, len(n), 500):
                    raw = [ids[a: a + m].astype("<u4").tobytes() for a, m in zip(offset[i: i + 500], n[i: i + 500], strict=True)]
                    part = slice(i, i + 500)
                    yield pa.record_batch([
                        own.field("key").slice(i, 500), own.field("copy").slice(i, 500), pa.array(base + offset[part]),
                        pa.array(n[part]), pa.array([zlib.crc32(x) for x in raw], pa.int64()), *[pa.array(raw, pa.binary())][: int(with_ids)],
                    ], schema=schema)

    shards = _files(spark, path, "ids").join(lists, "shard").join(F.broadcast(bases), "shard")
    return shards.select("content", "entries", "base").mapInArrow(run, columns)


class KeyedReader:
    """Constant-time access to single documents: one index bucket and one range of a shard are read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.manifest = spark, path, read_manifest(spark, path)

    def _read(self, folder: str, start: int = 0, size: int | None = None) -> bytes:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        name = next(f.getPath() for f in fs.listStatus(where) if not f.getPath().getName().startswith(("_", ".")))
        stream = fs.open(name)
        try:
            stream.seek(start)
            return bytes(stream.readAllBytes() if size is None else stream.readNBytes(size))
        finally:
            stream.close()

    def get(self, key: int | None, copy: int = 0) -> np.ndarray | None:
        """Ids of a document with its end id; None if there is no such key."""
        one = (np.array([key or 0]), np.array([int(key is None)]), np.array([copy]))
        if not self.manifest["buckets"]:
            return None
        bucket = int(key_hash(*one)[0] % np.uint64(self.manifest["buckets"]))
        try:
            raw = self._read(f"{self.path}/index/bucket={bucket}")
        except Exception as error:
            if "FileNotFound" in str(error):
                return None
            raise
        entry, hit = find(raw, *one)
        # Fingerprints tell most other keys, the stored key the rest.
        if not hit[0] or (entry["key"][0], entry["null"][0], entry["copy"][0]) != (one[0][0], one[1][0], copy):
            return None
        width = self.manifest["width"]
        raw = self._read(
            f"{self.path}/data/kind=ids/shard={entry['shard'][0]}", int(entry["offset"][0]) * width, int(entry["n"][0]) * width
        )
        return np.frombuffer(raw, f"<u{width}")
