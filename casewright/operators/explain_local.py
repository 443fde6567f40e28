"""Explanations of single cases, made for many cases in one job."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import quoted, to_long
from ..functions.ordering import block_quantiles, value_blocks
from .model import SCORE, Scorer

Bins = dict[str, dict[str, list[float]]]
#: Array of rows to an object whose ``plain`` gives their scores, as the blocks of ``overlay``.
BlockScorer = Callable[[np.ndarray], Any]


def quartile_bins(train: DataFrame, features: Sequence[str]) -> Bins:
    """Per feature: quartile edges, and share, least and greatest value of each bin.

    Rows are read once, to count each feature's values; edges and bins come from the counts. At most four bins
    per feature reach the driver.
    """
    blocks = value_blocks(to_long(train, [], features), ["feature"], "value")
    quartiles = block_quantiles(blocks, ["feature"], {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    edges = quartiles.select("feature", F.array_sort(F.array_distinct(F.array("q25", "q50", "q75"))).alias("edges"))
    placed = blocks.join(F.broadcast(edges), "feature").withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("_v"))))
    stats = placed.groupBy("feature", "bin").agg(
        F.first("edges").alias("edges"), F.sum("_c").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")
    )
    out: Bins = {}
    for r in stats.orderBy("feature", "bin").collect():
        own = out.setdefault(r["feature"], {"edges": list(r["edges"]), "bins": [], "n": [], "lo": [], "hi": []})
        for key, value in (("bins", r["bin"]), ("n", r["n"]), ("lo", r["lo"]), ("hi", r["hi"])):
            own[key].append(value)
    return out


def bin_number(column: Column, edges: Sequence[float]) -> Column:
    """0-based bin of a value: the number of edges below it."""
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < column))


def rule_text(feature: str, edges: Sequence[float], bin: int) -> str:
    """Readable range of a bin."""
    if not edges:
        return feature
    if bin == 0:
        return f"{feature} <= {edges[0]:.2f}"
    if bin == len(edges):
        return f"{feature} > {edges[-1]:.2f}"
    return f"{edges[bin - 1]:.2f} < {feature} <= {edges[bin]:.2f}"


_P1, _P2, _P3, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _turned(h: np.ndarray, n: int) -> np.ndarray:
    return (h << np.uint64(n)) | (h >> np.uint64(64 - n))


def _finished(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _hashed(number: np.ndarray, before: np.ndarray) -> np.ndarray:
    """``xxhash64`` of 32-bit numbers after earlier columns that hash to ``before``."""
    return _finished(_turned((before + _P5 + np.uint64(4)) ^ (number * _P1), 23) * _P2 + _P3)


def _draws(start: int, repeat: int, samples: int, width: int, seed: int) -> list[np.ndarray]:
    """Two (samples, width) arrays in [0, 1) that follow from xxhash64(row, sample, feature, seed, repeat, tag); ``start`` is that of the row."""
    h = _hashed(np.arange(samples, dtype=np.uint64)[:, None], np.array([[start]], np.int64).view(np.uint64))
    for number in (np.arange(width), [seed], [repeat]):
        h = _hashed(np.array(number, np.uint64)[None, :], h)
    tag = h + _P5 + np.uint64(3)
    for letter in np.frombuffer(b"bin", np.uint8).astype(np.uint64):
        tag = _turned(tag ^ (letter[None] * _P5), 11) * _P1
    spot = _hashed(np.frombuffer(b"spot", np.uint32).astype(np.uint64), h)
    return [(x & np.uint64((1 << 30) - 1)) / float(1 << 30) for x in (_finished(tag), spot)]


def _drawn_blocks(features: Sequence[str], bins: Bins, samples: int, seed: int, rows: int = 8192):
    """Samples around the cases of a batch: (places of the cases, same, values) of a few cases at a time."""
    k = len(features)
    edges = [np.array(bins[f]["edges"], float) for f in features]
    cuts = [np.cumsum([n / float(sum(bins[f]["n"])) for n in bins[f]["n"]])[:-1] for f in features]
    numbers, low, high = ([np.array(bins[f][key], float) for f in features] for key in ("bins", "lo", "hi"))

    def run(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        own = np.stack([batch.column(f"_{i}").to_numpy(zero_copy_only=False).astype(float) for i in range(k)], axis=1)
        # A missing value lies below all edges.
        absent = np.stack([batch.column(f"_{i}").is_null().to_numpy(zero_copy_only=False) for i in range(k)], axis=1)
        mine = np.stack([np.searchsorted(e, own[:, i]) for i, e in enumerate(edges)], axis=1)
        mine[absent] = 0
        starts, repeats = batch.column("_start").to_numpy(), batch.column("repeat").to_numpy()
        step = max(1, rows // samples)
        for begin in range(0, batch.num_rows, step):
            at = np.arange(begin, min(batch.num_rows, begin + step))
            same, values = np.ones((len(at), samples, k)), np.empty((len(at), samples, k))
            for j, c in enumerate(at):
                u, v = _draws(starts[c], int(repeats[c]), samples, k, seed)
                for i in range(k):
                    to = np.searchsorted(cuts[i], u[:, i], side="right")
                    same[j, :, i] = numbers[i][to] == mine[c, i]
                    values[j, :, i] = low[i][to] + v[:, i] * (high[i] - low[i])[to]
                # Sample 0 is the case itself.
                same[j, 0], values[j, 0] = 1.0, own[c]
            yield at, same, values
    return run


def _repeated(cases: DataFrame, row: str, features: Sequence[str], repeats: int) -> DataFrame:
    """A row per case and repeat, dealt evenly: each stands for all its samples."""
    spark = cases.sparkSession
    tasks = max(int(spark.sparkContext.defaultParallelism), int(spark.conf.get("spark.sql.shuffle.partitions")))
    given = cases.select(
        F.col(row).alias("_row"), F.xxhash64(row).alias("_start"), *[F.col(quoted(f)).cast("double").alias(f"_{i}") for i, f in enumerate(features)]
    )
    exploded = given.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return exploded.repartition(tasks, "_row", "repeat")


def lime_samples(
    cases: DataFrame, row: str, features: Sequence[str], bins: Bins, scorer: Scorer, samples: int, seed: int, repeats: int = 1
) -> DataFrame:
    """(row, repeat, same, p): scored samples around each case; ``same`` flags features in the case's own bin.

    Sample 0 is the case itself. Draws depend on (row, repeat, sample, feature, seed) alone.
    """
    features = [f for f in features if f in bins]
    drawn, kind = _drawn_blocks(features, bins, samples, seed), cases.schema[row].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, same, values in drawn(batch):
                which = pa.array(np.repeat(at, samples))
                flags = pa.ListArray.from_arrays(pa.array(np.arange(len(which) + 1, dtype=np.int32) * len(features)), pa.array(same.ravel()))
                flat = values.reshape(len(which), len(features))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row").take(which), batch.column("repeat").take(which), flags, *[pa.array(flat[:, i], from_pandas=True) for i in range(len(features))]],
                    [row, "repeat", "same", *features],
                )

    layout = T.StructType([T.StructField(row, kind), T.StructField("repeat", T.IntegerType()), T.StructField("same", T.ArrayType(T.DoubleType()))])
    for f in features:
        layout = layout.add(f, T.DoubleType())
    varied = _repeated(cases, row, features, repeats).mapInArrow(run, layout)
    return scorer(varied).select(row, "repeat", "same", F.col(SCORE).alias("p"))


def _sums_of(same: np.ndarray, p: np.ndarray, width: float) -> np.ndarray:
    """Weighted sums of products of (1, same, p) over samples, upper triangle."""
    full = np.column_stack([np.ones(len(same)), same, p])
    w = np.sqrt(np.exp(-(same.shape[1] - same.sum(axis=1)) / width**2))
    return ((full * w[:, None]).T @ full)[np.triu_indices(full.shape[1])]


def _sum_batch(rows: pa.Array, repeats: pa.Array, sums: list[np.ndarray]) -> pa.RecordBatch:
    size = len(sums[0])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * size), pa.array(np.concatenate(sums)))
    return pa.RecordBatch.from_arrays([rows, repeats, lists], ["_row", "repeat", "sums"])


def _sample_sums(k: int, width: float):
    """``_sums_of`` each run of samples of one case and repeat."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z = batch.column("same").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, k)
            p = batch.column("p").to_numpy(zero_copy_only=False)
            row, repeat = batch.column("_row").dictionary_encode().indices.to_numpy(zero_copy_only=False), batch.column("repeat").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(repeat) != 0)]))
            ends = np.append(starts[1:], len(z))
            at = pa.array(starts)
            yield _sum_batch(batch.column("_row").take(at), batch.column("repeat").take(at), [_sums_of(z[a:b], p[a:b], width) for a, b in zip(starts, ends)])
    return run


def _block_sums(features: Sequence[str], bins: Bins, block: BlockScorer, samples: int, seed: int, width: float):
    """``_sums_of`` the samples of each case and repeat, drawn and scored in the task."""
    drawn = _drawn_blocks(features, bins, samples, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, same, values in drawn(batch):
                with np.errstate(over="ignore", invalid="ignore"):
                    p = block(values.reshape(-1, len(features))).plain()[0].reshape(len(at), samples)
                    sums = [_sums_of(z, y, width) for z, y in zip(same, p)]
                which = pa.array(at)
                yield _sum_batch(batch.column("_row").take(which), batch.column("repeat").take(which), sums)
    return run


def _ridge(sums: np.ndarray, columns: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """(coefficients, standard errors, intercept) on some features, from the sums of products."""
    n, last, at = sums[0, 0], len(sums) - 1, [c + 1 for c in columns]
    mx, my = sums[0, at] / n, sums[0, last] / n
    xx, xy = sums[np.ix_(at, at)] - n * np.outer(mx, mx), sums[at, last] - n * mx * my
    gram = xx + np.eye(len(at))
    beta = np.linalg.solve(gram, xy)
    rest = max(0.0, sums[last, last] - n * my * my - 2 * beta @ xy + beta @ xx @ beta)
    scale = rest / max(1.0, n - len(at))
    return beta, np.sqrt(np.maximum(0.0, scale * np.diag(np.linalg.inv(gram)))), my - mx @ beta


def _solve(names: list[str], top: int):
    k = len(names)
    upper = np.triu_indices(k + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i, given in enumerate(batch.column("sums")):
                sums = np.zeros((k + 2, k + 2))
                sums[upper] = given.values.to_numpy()
                sums.T[upper] = sums[upper]
                first, _, _ = _ridge(sums, list(range(k)))
                chosen = sorted(sorted(range(k), key=lambda j: (-abs(first[j]), names[j]))[:top])
                beta, se, intercept = _ridge(sums, chosen)
                for values, more in zip(out, ([i] * len(chosen), [names[j] for j in chosen], beta, se, [intercept] * len(chosen))):
                    values.extend(more)
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_row").take(at), batch.column("repeat").take(at), pa.array(out[1], pa.string()), *[pa.array(v, pa.float64()) for v in out[2:5]]],
                ["_row", "repeat", "feature", "weight", "se", "intercept"],
            )
    return run


def _kernel(names: Sequence[str], given: float | None = None) -> float:
    return float(given or 0.75 * np.sqrt(len(names)))


def lime_fit(samples: DataFrame, row: str, names: Sequence[str], top: int = 6, kernel_width: float | None = None) -> DataFrame:
    """(row, repeat, feature, weight, se, intercept): weighted ridge fit of each case's samples.

    Samples are summed to products where they are made, so one row a case and repeat is shuffled and
    not its samples; sums of parts of a case add up. Both fits (all features, then the chosen ones) are
    solved from the same sums.
    """
    names = list(names)
    kind = samples.schema[row].dataType.simpleString()
    given = samples.select(F.col(row).alias("_row"), "repeat", "same", "p")
    parts = given.mapInArrow(_sample_sums(len(names), _kernel(names, kernel_width)), f"_row {kind}, repeat int, sums array<double>")
    return _fit_sums(parts, row, names, top)


def _fit_sums(parts: DataFrame, row: str, names: list[str], top: int) -> DataFrame:
    kind = parts.schema["_row"].dataType.simpleString()
    whole = parts.groupBy("_row", "repeat").agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("sums"))
    layout = f"_row {kind}, repeat int, feature string, weight double, se double, intercept double"
    return whole.mapInArrow(_solve(names, top), layout).withColumnRenamed("_row", row)


def lime_drawn(
    cases: DataFrame, row: str, names: Sequence[str], bins: Bins, scorer: Scorer, block: BlockScorer | None, samples: int, seed: int,
    top: int, repeats: int = 1,
) -> DataFrame:
    """``lime_fit`` of samples around each case. With ``block``, a scorer of arrays, samples never leave the task that draws them."""
    names = list(names)
    if block is None:
        return lime_fit(lime_samples(cases, row, names, bins, scorer, samples, seed, repeats), row, names, top)
    kind = cases.schema[row].dataType.simpleString()
    sums = _block_sums(names, bins, block, samples, seed, _kernel(names))
    parts = _repeated(cases, row, names, repeats).mapInArrow(sums, f"_row {kind}, repeat int, sums array<double>")
    return _fit_sums(parts, row, names, top)


def lime_explain(
    train: DataFrame, cases: DataFrame, row: str, features: Sequence[str], scorer: Scorer, label: str = "encoded_label",
    samples: int = 1000, top: int = 6, seed: int = 42, bins: Bins | None = None, block: BlockScorer | None = None,
) -> DataFrame:
    """(row, actual, predicted, probability, class_type, explanation): local surrogate of each case.

    ``explanation`` lists (rule, weight), strongest first. Bin edges come from ``train``, unless ``bins`` are
    given; all samples of all cases are scored together. ``block`` scores arrays of all ``features`` as ``scorer`` does rows.
    """
    bins = quartile_bins(train, features) if bins is None else bins
    names = [f for f in features if f in bins]
    fitted = lime_drawn(cases, row, names, bins, scorer, block, samples, seed, top)
    scored = scorer(cases).select(row, label, F.col(SCORE).alias("probability"), *[F.col(quoted(f)) for f in names])
    own_bins = F.create_map(*[
        x for f in names for x in (
            F.lit(f), F.element_at(
                F.array(*[F.lit(rule_text(f, bins[f]["edges"], b)) for b in range(len(bins[f]["edges"]) + 1)]),
                bin_number(F.col(quoted(f)), bins[f]["edges"]) + 1,
            ),
        )
    ])
    ruled = scored.select(row, label, "probability", own_bins.alias("_rules"))
    joined = fitted.join(ruled, row).withColumn("rule", F.col("_rules")[F.col("feature")])
    strength = F.struct((-F.abs("weight")).alias("s"), "rule", "weight")
    listed = joined.groupBy(row, F.col(label).alias("actual"), "probability").agg(
        F.transform(F.array_sort(F.collect_list(strength)), lambda s: F.struct(s["rule"].alias("rule"), s["weight"].alias("weight"))).alias("explanation")
    )
    return listed.select(
        row, "actual", (F.col("probability") > 0.5).cast("int").alias("predicted"), "probability",
        F.when(F.col("actual") == 1, "Deviant").otherwise("Regular").alias("class_type"), "explanation",
    )


def lime_repeats(
    train: DataFrame, cases: DataFrame, row: str, features: Sequence[str], scorer: Scorer, calls: int = 10,
    samples: int = 1000, top: int = 6, seed: int = 42, bins: Bins | None = None, block: BlockScorer | None = None,
) -> DataFrame:
    """(row, repeat, feature, weight, se) of repeated explanations of the same cases, all in one job; see ``lime_explain``."""
    bins = quartile_bins(train, features) if bins is None else bins
    names = [f for f in features if f in bins]
    return lime_drawn(cases, row, names, bins, scorer, block, samples, seed, top, calls).select(row, "repeat", "feature", "weight", "se")


def lime_stability(repeats: DataFrame, row: str, z: float = 1.96) -> DataFrame:
    """(row, vsi, csi) in percent from a repeat table (row, repeat, feature, weight, se).

    Variable index: shared features of two repeats over the features of one, averaged over the
    pairs of repeats. Coefficient index: share of repeat pairs with overlapping confidence
    intervals, averaged over the features both repeats use. Counts per feature replace the
    pairs for the first; the second compares the few repeats of one case and feature.
    """
    shape = repeats.groupBy(row).agg(F.count_distinct("repeat").alias("_calls"), (F.count("*") / F.count_distinct("repeat")).alias("_size"))
    uses = repeats.groupBy(row, "feature").agg(
        F.count("*").alias("_m"),
        F.sort_array(F.collect_list(F.struct((F.col("weight") - z * F.col("se")).alias("lo"), (F.col("weight") + z * F.col("se")).alias("hi")))).alias("_spans"),
    )
    # Intervals are sorted by their lower end: i overlaps a later j when j starts before i ends.
    met = F.aggregate(
        F.sequence(F.lit(1), F.size("_spans")), F.lit(0),
        lambda acc, i: acc + F.size(F.filter(
            F.slice(F.col("_spans"), i + 1, F.size("_spans")), lambda s: s["lo"] <= F.element_at(F.col("_spans"), i)["hi"]
        )),
    )
    both = F.col("_m") * (F.col("_m") - 1) / 2
    counted = uses.select(row, both.alias("_pairs"), F.try_divide(met, both).alias("_met"))
    per_row = counted.groupBy(row).agg(F.sum("_pairs").alias("_shared"), F.avg("_met").alias("_overlap"))
    all_pairs = F.col("_calls") * (F.col("_calls") - 1) / 2
    return per_row.join(shape, row).select(
        row, (100 * F.try_divide(F.col("_shared"), all_pairs * F.col("_size"))).alias("vsi"), (100 * F.col("_overlap")).alias("csi")
    )


def split_by_class(explanations: DataFrame, label: str = "actual") -> DataFrame:
    """Class type of each explanation by the actual label."""
    return explanations.withColumn("class_type", F.when(F.col(label) == 1, "Deviant").otherwise("Regular"))


def shap_local(phi: DataFrame, base: DataFrame, row: str, cases: DataFrame) -> DataFrame:
    """(row, feature, value, phi, base, step, upto): decision path of the given cases.

    Features are added from the weakest to the strongest; ``upto`` starts at the base value.
    """
    wanted = phi.join(cases.select(row).distinct(), row, "left_semi")
    w = Window.partitionBy(row).orderBy(F.abs("phi"), "feature")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    with_base = wanted.withColumn("base", base.select("base").scalar())
    return with_base.withColumn("step", F.row_number().over(w)).withColumn("upto", F.col("base") + F.sum("phi").over(upto))
