"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

Statistics of each whole text are computed once, beside its id. Random Fourier features of the standardised statistics
approximate a Gaussian kernel; every partition of labelled rows sums its share of the normal equations, Spark adds the
shares entry by entry, and the driver solves a system of fixed size. Scores of a calibration fold, counted in fixed bins,
give the isotonic curve. All labelled rows of the learning folds take part; there is no sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpie.llm.common import NON_SPACE, annotate, crc_mod, materialize, slices, span_hashes, table, utf8_of, word_spans

CHUNK_BYTES = 256 << 10
FEATURES = 128
GAMMA = 0.12
RIDGE = 1e-3
BINS = 1000
STATISTICS = (
    "log_bytes", "log_words", "word_length", "long_words", "upper", "digit", "white", "newline", "comma_stop", "symbol", "bang", "bar", "quote",
    "wide", "capital_words", "repeated_words", "repeated_lines", "top_word", "line_length", "short_lines",
)
_SYMBOLS = b"*&%$#@^~<>{}[]\\|_=+/"


def _bytes_in(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of STATISTICS for each text; an empty or null text has zeros."""
    whole, offsets = utf8_of(texts)
    out = np.zeros((len(offsets) - 1, len(STATISTICS)))
    upper, digit, lines = np.arange(65, 91), np.arange(48, 58), _bytes_in(b"\n")
    symbol, white = _bytes_in(_SYMBOLS), ~NON_SPACE
    for i, j in slices(offsets, CHUNK_BYTES):
        raw, off = whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        start, end, first = word_spans(raw, off, NON_SPACE)
        h = span_hashes(raw, start, end)
        l_start, l_end, l_first = word_spans(raw, off, ~lines)
        lh = span_hashes(raw, l_start, l_end)
        size, capital = end - start, (raw[start] >= 65) & (raw[start] <= 90) if len(start) else np.zeros(0, bool)
        for r in range(j - i):
            a, b = off[r], off[r + 1]
            n = b - a
            if not n:
                continue
            c = np.bincount(raw[a:b], minlength=256) / n
            w, v = slice(first[r], first[r + 1]), slice(l_first[r], l_first[r + 1])
            words, rows = first[r + 1] - first[r], l_first[r + 1] - l_first[r]
            row = out[i + r]
            row[0] = np.log1p(n)
            row[4:14] = c[upper].sum(), c[digit].sum(), c[white].sum(), c[10], c[44] + c[46], c[symbol].sum(), c[33], c[124], c[34] + c[39], c[128:].sum()
            if words:
                _, times = np.unique(h[w], return_counts=True)
                row[1], row[2], row[3] = np.log1p(words), size[w].mean(), (size[w] > 14).mean()
                row[14], row[15], row[17] = capital[w].mean(), 1 - len(times) / words, times.max() / words
            if rows:
                length = l_end[v] - l_start[v]
                row[16], row[18], row[19] = 1 - len(np.unique(lh[v])) / rows, np.log1p(length.mean()), (length < 30).mean()
    return out


def _statistics_column(texts: pa.Array):
    s = statistics(texts)
    return [pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * s.shape[1], pa.int32()), pa.array(s.ravel()))]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(STATISTICS))


class Rff:
    """The map from statistics to random Fourier features; the last feature is 1."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, gamma: float = GAMMA, seed: int = 11):
        r = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = r.normal(0, np.sqrt(2 * gamma), (len(mean), features - 1))
        self.b = r.uniform(0, 2 * np.pi, features - 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))], 1)


def _normal_equations(rff: Rff):
    """Each partition's sums of z z' (upper triangle) and z y, as rows (place, value)."""

    def run(batches):
        d = len(rff.b) + 1
        a, b, n = np.zeros((d, d)), np.zeros(d), 0
        for batch in batches:
            if batch.num_rows:
                z, y = rff(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
                a, b, n = a + z.T @ z, b + z.T @ y, n + len(y)
        if n:
            values = np.concatenate([a[np.triu_indices(d)], b, [n]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["place", "value"])

    return run


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points in ascending order of x; knots of the increasing curve."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x.tolist(), y.tolist(), w.tolist(), strict=True):
        blocks.append([yi, wi, xi * wi])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, n, s = blocks.pop()
            blocks[-1] = [(blocks[-1][0] * blocks[-1][1] + v * n) / (blocks[-1][1] + n), blocks[-1][1] + n, blocks[-1][2] + s]
    return np.array([s / n for _, n, s in blocks]), np.array([v for v, _, _ in blocks])


def _raw_scores(rff: Rff, beta: np.ndarray):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rff(_matrix(batch.column(batch.num_columns - 1))) @ beta)], [*batch.schema.names[:-1], "raw"])

    return run


def _calibrated(rff: Rff, beta: np.ndarray, knots: tuple[np.ndarray, np.ndarray]):
    """Isotonic values with a small rising share of the raw score, which keeps its order inside flat pieces."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                raw = rff(_matrix(batch.column(batch.num_columns - 1))) @ beta
                curve = np.interp(raw, *knots) if len(knots[0]) else np.clip(raw, 0, 1)
                score = np.clip(0.999 * curve + 0.001 / (1 + np.exp(-6 * (raw - 0.5))), 0, 1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], [*batch.schema.names[:-1], "quality_score"])

    return run


def quality(docs: DataFrame, labels: DataFrame, *, may_learn: Column | None = None, calibrate: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and quality_score from 0 to 1.

    may_learn: the rows whose labels may be used; calibrate: those of them that serve the calibration instead of the fit.
    A null or empty text has zero statistics and is scored like any other; equal texts score alike. Repeated rows are each
    scored, and learnt from by each occurrence. Null labels are ignored. Without labels every score is near 0.5. Other
    columns are ignored; an empty table gives no rows.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    stats = materialize(annotate(slim, _statistics_column, "statistics array<double>", carry=["doc_id"]), "quality-statistics")
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("quality is not null")
    known = known.filter(F.lit(True) if may_learn is None else may_learn).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = materialize(stats.join(known, "doc_id").withColumn("tune", F.coalesce(calibrate, F.lit(False)) if calibrate is not None else F.lit(False)), "quality-labelled")
    each = [F.col("statistics")[k] for k in range(len(STATISTICS))]
    moments = known.agg(F.count("*"), *[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).first()
    k = len(STATISTICS)
    mean, scale = np.array([x or 0.0 for x in moments[1 : k + 1]]), np.array([max(x or 0.0, 1e-6) for x in moments[k + 1 :]])
    rff = Rff(mean, scale)
    d = FEATURES
    beta, knots = np.zeros(d), (np.zeros(0), np.zeros(0))
    beta[-1] = 0.5
    if moments[0]:
        fit_rows = known.filter("not tune").select("statistics", "quality")
        sums = fit_rows.mapInArrow(_normal_equations(rff), "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()  # d * (d + 3) / 2 + 1 rows
        if len(sums):
            v = sums.sort_values("place")["value"].to_numpy()
            upper = d * (d + 1) // 2
            a = np.zeros((d, d))
            a[np.triu_indices(d)] = v[:upper]
            a = a + a.T - np.diag(np.diag(a))
            beta = np.linalg.solve(a + RIDGE * v[-1] * np.eye(d), v[upper:-1])
        tune = known.filter("tune") if calibrate is not None and not known.filter("tune").isEmpty() else known
        raw = tune.select("quality", "statistics").mapInArrow(_raw_scores(rff, beta), "quality int, raw double")
        bins = F.least(F.greatest(F.floor((F.col("raw") + 0.5) * (BINS / 2)), F.lit(0)), F.lit(BINS)).cast("int")
        counted = raw.groupBy(bins.alias("bin")).agg(F.avg("raw").alias("x"), F.avg("quality").alias("y"), F.count("*").alias("w")).orderBy("bin").toPandas()  # at most BINS + 1 rows
        knots = isotonic(counted["x"].to_numpy(float), counted["y"].to_numpy(float), counted["w"].to_numpy(float))
    id_type = stats.schema["doc_id"].dataType.simpleString()
    return stats.mapInArrow(_calibrated(rff, beta, knots), f"doc_id {id_type}, quality_score double")


def op2_rff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = crc_mod("doc_id", 3)
    scored = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), may_learn=fold != 1, calibrate=crc_mod("doc_id", 15) == 2)
    score = F.col("quality_score")
    return scored.select("doc_id", (fold == 1).alias("held_out"), score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES = {"op2_rff_quality": op2_rff_quality}
ORACLE: dict[str, str] = {}
