"""Anomaly models over vectors: standard scores and an isolation forest, as Spark jobs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zscores(long: DataFrame) -> DataFrame:
    """(row, feature, value) with z: distance from the feature's mean in population deviations; 0 where it has none."""
    stats = long.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"))
    return long.join(stats, "feature").select("row", "feature", "value", F.when(F.col("deviation") > 0, (F.col("value") - F.col("mean")) / F.col("deviation")).otherwise(0.0).alias("z"))


def grow_tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """A random isolation tree as rows (feature, cut, left, right), or (-1, depth of the leaf, 0, 0)."""
    nodes: list[tuple] = []

    def add(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(())
        spread = np.ptp(rows, axis=0) if len(rows) > 1 else np.zeros(x.shape[1])
        if depth >= limit or not spread.any():
            nodes[at] = (-1, depth + normal_path(len(rows)), 0, 0)
            return at
        feature = int(rng.choice(np.flatnonzero(spread)))
        cut = float(rng.uniform(rows[:, feature].min(), rows[:, feature].max()))
        below = rows[:, feature] < cut
        nodes[at] = (feature, cut, add(rows[below], depth + 1), add(rows[~below], depth + 1))
        return at

    add(x, 0)
    return nodes


def normal_path(n: int) -> float:
    """The mean path length of a search in a random tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def path_lengths(trees: list[list[tuple]], x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for tree in trees:
        feature, cut, left, right = (np.array(c) for c in zip(*tree))
        at = np.zeros(len(x), np.int64)
        while (inner := feature[at] >= 0).any():
            go = at[inner]
            at[inner] = np.where(x[inner, feature[go]] < cut[go], left[go], right[go])
        total += cut[at]
    return total / len(trees)


def grow_forest(vectors: DataFrame, key: str, column: str, trees: int, sample: int, seed: int) -> tuple[list[list[tuple]], int]:
    """The trees, grown in tasks, and the number of rows that each is grown on.

    At most trees x sample rows, chosen by hash so that they are the same on every run, get a rank; each tree draws ranks."""
    order = [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)]
    chosen = vectors.select(key, column).filter(F.col(column).isNotNull()).orderBy(*order).limit(trees * sample)
    chosen = chosen.select(F.col(column).alias("vector"), (F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("rank"))
    found = chosen.count()
    size = min(sample, found)
    if not size:
        return [], 0
    limit = max(1, math.ceil(math.log2(max(2, size))))

    def draw(batches):
        for pdf in batches:
            for tree in pdf["id"]:
                yield pd.DataFrame({"tree": tree, "rank": np.random.default_rng([seed, tree]).choice(found, size, replace=False)})

    def grow(pdf):
        pdf = pdf.sort_values("rank")
        tree = int(pdf["tree"].iloc[0])
        nodes = grow_tree(np.array(pdf["vector"].tolist(), np.float64), np.random.default_rng([seed, tree, 1]), limit)
        return pd.DataFrame({"tree": [tree], **{name: [list(x)] for name, x in zip(("feature", "cut", "left", "right"), zip(*nodes))}})

    drawn = vectors.sparkSession.range(trees).mapInPandas(draw, "tree long, rank long").join(chosen, "rank")
    grown = drawn.groupBy("tree").applyInPandas(grow, "tree long, feature array<int>, cut array<double>, left array<int>, right array<int>").collect()
    return [list(zip(*r[1:])) for r in sorted(grown, key=lambda r: r.tree)], size


def isolation_scores(vectors: DataFrame, key: str, column: str, trees: int = 300, sample: int = 256, seed: int = 42) -> DataFrame:
    """key and score in (0, 1): the higher, the more easily a row is set apart.

    Trees grow on a bounded sample, the feature of the method; scores cover all rows, and the forest that tasks get has at
    most trees x 2 x sample nodes."""
    grown, size = grow_forest(vectors, key, column, trees, sample, seed)
    usual = normal_path(size) or 1.0

    def run(batches):
        for pdf in batches:
            x = np.array(pdf[column].tolist(), np.float64)
            yield pd.DataFrame({key: pdf[key], "score": 2.0 ** (-path_lengths(grown, x) / usual) if len(x) else []})

    return vectors.select(key, column).filter(F.col(column).isNotNull()).mapInPandas(run, f"{key} {dict(vectors.dtypes)[key]}, score double")


def contaminated(scored: DataFrame, share: float = 0.03) -> DataFrame:
    """The scored rows with is_anomaly: those above the (1 - share) quantile."""
    cut = scored.agg(F.percentile_approx("score", 1 - share, 10_000).alias("cut"))
    return scored.join(F.broadcast(cut)).withColumn("is_anomaly", F.col("score") > F.col("cut")).drop("cut")


def reduced(vectors: DataFrame, key: str, column: str, most: int = 20) -> tuple[DataFrame, list[float]]:
    """(key, vector of at most `most` principal components of the standardised vectors), and the share of variance of each.

    Means and deviations are one row a feature; the components come from the features' covariance matrix, which tasks sum up."""
    known = vectors.filter(F.col(column).isNotNull()).select(key, F.col(column).cast("array<double>").alias("_v"))
    stats = known.select(F.posexplode("_v").alias("feature", "value")).groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("deviation"), F.count(F.lit(1)).alias("n")).orderBy("feature").collect()
    if not stats:
        return known.select(key, F.col("_v").alias("vector")), []
    means, scales = F.array(*(F.lit(r.mean) for r in stats)), F.array(*(F.lit(r.deviation or 1.0) for r in stats))
    z = F.zip_with(F.zip_with("_v", means, lambda x, m: x - m), scales, lambda x, s: x / s)
    rows = known.select(key, array_to_vector(z).alias("z"))
    fitted = PCA(k=min(most, stats[0].n, len(stats)), inputCol="z", outputCol="p").fit(rows)
    return fitted.transform(rows).select(key, vector_to_array("p").alias("vector")), [float(x) for x in fitted.explainedVariance]


#: Bins of the scores that a step of the one-class machine counts by.
BINS = 64


class Fourier:
    """Random Fourier features of a Gaussian kernel: inner products of them are near the kernel, by one over the root of their number."""

    def __init__(self, width: int, gamma: float, features: int, seed: int):
        rng = np.random.default_rng(seed)
        self.w, self.b = rng.normal(scale=math.sqrt(2 * gamma), size=(width, features)), rng.uniform(0, 2 * math.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return math.sqrt(2 / len(self.b)) * np.cos(x @ self.w + self.b)


def lowest_mean(bins: np.ndarray, sums: np.ndarray, most: float) -> tuple[np.ndarray, int]:
    """The mean of what stands in the lowest bins up to `most` rows, of the last of them a share; and that bin's number."""
    before = np.concatenate([[0.0], np.cumsum(bins)])
    share = np.clip((most - before[:-1]) / np.maximum(bins, 1), 0, 1)
    return (share[:, None] * sums).sum(axis=0) / most, int(np.flatnonzero(share > 0).max(initial=0))


def one_class_scores(vectors: DataFrame, key: str, column: str, nu: float = 0.03, features: int = 512, steps: int = 25, seed: int = 42) -> DataFrame:
    """key and score of a one-class machine with a Gaussian kernel (gamma: one over width times variance): the higher, the
    further outside; a share of nu of the rows lies above 0. Null vectors have no row.

    The kernel is that of random Fourier features, and the plane is found step by step: it moves towards the mean of the rows
    that lie lowest now, a share of nu of all, which solves the dual problem by its linear parts. Every step is one pass in
    which tasks sum up their rows by bins of the score, so that BINS sums of `features` numbers come to the driver,
    however many rows there are; of the last bin a share counts."""
    known = vectors.filter(F.col(column).isNotNull()).select(key, F.col(column).cast("array<double>").alias("_v"))
    moments = known.select(F.explode("_v").alias("x"), F.size("_v").alias("d")).agg(F.var_pop("x").alias("variance"), F.max("d").alias("d")).first()
    kind = f"{key} {dict(vectors.dtypes)[key]}, score double"
    if moments.d is None:
        return known.select(key, F.lit(None).cast("double").alias("score"))
    phi = Fourier(moments.d, 1.0 / (moments.d * (moments.variance or 1.0)), features, seed)

    def summed(plane: np.ndarray, low: float, high: float):
        def run(batches):
            counts, sums, ends = np.zeros(BINS), np.zeros((BINS, features)), [math.inf, -math.inf]
            for pdf in batches:
                if len(pdf):
                    z = phi(np.array(pdf["_v"].tolist(), np.float64))
                    s = z @ plane
                    at = np.clip((s - low) / (high - low) * BINS, 0, BINS - 1).astype(int)
                    np.add.at(counts, at, 1)
                    np.add.at(sums, at, z)
                    ends = [min(ends[0], s.min()), max(ends[1], s.max())]
            if counts.any():
                used = np.flatnonzero(counts)
                yield pd.DataFrame({"bin": used, "n": counts[used], "sums": list(sums[used]), "low": ends[0], "high": ends[1]})

        parts = known.select("_v").mapInPandas(run, "bin long, n double, sums array<double>, low double, high double")
        # A row for each task and bin is summed up to a row a bin.
        add = lambda pdf: pd.DataFrame({"bin": [pdf["bin"].iloc[0]], "n": [pdf["n"].sum()], "sums": [np.sum(np.stack(pdf["sums"].to_numpy()), axis=0)], "low": [pdf["low"].min()], "high": [pdf["high"].max()]})
        rows = parts.groupBy("bin").applyInPandas(add, parts.schema).collect()
        counts, sums = np.zeros(BINS), np.zeros((BINS, features))
        for r in rows:
            counts[r.bin], sums[r.bin] = r.n, r.sums
        return counts, sums, min(r.low for r in rows), max(r.high for r in rows)

    counts, sums, _, _ = summed(np.zeros(features), -1.0, 1.0)
    rows = counts.sum()
    plane = sums.sum(axis=0) / rows
    low, high = -math.sqrt(2) * float(np.linalg.norm(plane)), math.sqrt(2) * float(np.linalg.norm(plane))
    for step in range(1, steps + 1):
        counts, sums, least, most = summed(plane, low, high)
        lowest, last = lowest_mean(counts, sums, max(nu * rows, 1.0))
        plane = plane + 2 / (step + 2) * (lowest - plane)
        # The bins go where the lowest rows are; what lies above them shares the last one.
        reach = max(most - least, 1e-9)
        low, high = least - 0.2 * reach, min(most, low + (last + 1) * (high - low) / BINS) + 0.4 * reach

    def score(batches):
        for pdf in batches:
            x = np.array(pdf["_v"].tolist(), np.float64)
            yield pd.DataFrame({key: pdf[key], "score": -(phi(x) @ plane) if len(x) else []})

    scored = known.mapInPandas(score, kind)
    offset = scored.agg(F.percentile_approx("score", 1 - nu, 10_000).alias("_offset"))
    return scored.join(F.broadcast(offset)).select(key, (F.col("score") - F.col("_offset")).alias("score"))
