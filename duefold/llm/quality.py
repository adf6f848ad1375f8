"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of a text are standardised and mapped to cosines at random frequencies, whose inner
products approximate a Gaussian kernel. Each partition of the training rows sums its normal
equations; their total, of a size set by the number of features alone, is solved on the driver. A second
part of the training rows calibrates the result: mean labels in narrow bins of the raw score are
pooled until they rise (pool adjacent violators).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duefold.llm.common import column, crc32_of_id, text_slices, written

FEATURES = 256
WIDTH = 6.0
RIDGE = 1.0
BINS = 512
#: Labelled rows that are used at most, on average, drawn by a hash of the id.
SAMPLE_ROWS = 200_000
#: Normal equations that reach the driver.
PARTS = 8
#: Raw scores are binned between these.
_LOW, _HIGH = -1.0, 2.0

_KINDS = np.zeros(256, np.int64)
_KINDS[97:123] = 1
_KINDS[65:91] = 2
_KINDS[48:58] = 3
_KINDS[128:] = 4
_KINDS[[9, 11, 12, 13, 32]] = 5
_KINDS[10] = 6
_KINDS[list(b".,;:'\"-()?")] = 7
_KINDS[list(b"!")] = 8

STATISTICS = (
    "log_bytes", "upper", "digit", "non_ascii", "blank", "newline", "punctuation", "exclamation",
    "symbol", "word_length", "distinct_words", "distinct_lines", "log_lines", "words_a_line",
    "longest_word", "lower_words", "short_words", "line_ends",
)


def statistics(text: bytes) -> list[float]:
    """The numbers a text is judged by, all finite; zeros for an empty one."""
    if not text:
        return [0.0] * len(STATISTICS)
    kinds = np.bincount(_KINDS[np.frombuffer(text, np.uint8)], minlength=9) / len(text)
    words = text.split()
    n = max(1, len(words))
    distinct = set(words)
    lines = text.split(b"\n")
    lengths = list(map(len, words)) or [0]
    return [
        np.log1p(len(text)),
        kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7], kinds[8], kinds[0],
        min(sum(lengths) / n, 50.0),
        len(distinct) / n,
        len(set(lines)) / len(lines),
        np.log1p(len(lines)),
        np.log1p(n / len(lines)),
        np.log1p(max(lengths)),
        sum(map(bytes.islower, distinct)) / max(1, len(distinct)),
        sum(1 for x in lengths if x <= 3) / n,
        sum(1 for x in lines if x[-1:] in (b".", b"?", b"!")) / len(lines),
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in text_slices(batch.column(1)):
            values = pa.array([statistics(text) for text in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(texts)), values], ["id", "x"]
            )


@dataclass(frozen=True)
class QualityModel:
    """Standardisation, frequencies, ridge weights and calibration."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def cosines(self, x: np.ndarray) -> np.ndarray:
        """Features of some rows of statistics, the last one constant."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        wave = np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([wave, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0.0, 1.0)


def _rows(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["x"].to_numpy()) if len(frame) else np.empty((0, len(STATISTICS)))


def _normal_equations(model: QualityModel):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = len(model.phases) + 2
        total = np.zeros((size, size))
        for frame in frames:
            for k in range(0, len(frame), 4096):
                part = frame.iloc[k : k + 4096]
                a = np.hstack([model.cosines(_rows(part)), part[["label"]].to_numpy(float)])
                total += a.T @ a
        yield pd.DataFrame({"sums": [total.tobytes()]})

    return run


def _binned(model: QualityModel):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            raw = np.clip(model.raw(_rows(frame)), _LOW, np.nextafter(_HIGH, 0))
            bins = ((raw - _LOW) / (_HIGH - _LOW) * BINS).astype(np.int64)
            yield pd.DataFrame({"bin": bins, "raw": raw, "label": frame["label"]})

    return run


def rising(means: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (first member, mean) of each pooled block."""
    blocks: list[list[float]] = []
    for k, (mean, size) in enumerate(zip(means, sizes)):
        blocks.append([k, mean, size])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            _, mean, size = blocks.pop()
            last = blocks[-1]
            last[1] = (last[1] * last[2] + mean * size) / (last[2] + size)
            last[2] += size
    return np.array([int(b[0]) for b in blocks]), np.array([b[1] for b in blocks])


def fit(measured: DataFrame, labels: DataFrame, seed: int = 5) -> QualityModel | None:
    """A model from (id, x) and (id, label), label 0 or 1 and never null; None without usable rows.

    Rows whose crc32(id as text) mod 3 is 0 give the weights, those with 2 the calibration, and those
    with 1 are never used. Rows with several labels take the mean of them.
    """
    labels = labels.groupBy("id").agg(F.avg("label").alias("label"))
    counted = labels.where("id IS NOT NULL").count()
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(13), F.col("id").cast("string")), 12) / float(1 << 52)
    rest = crc32_of_id(F.col("id")) % 3
    sample = labels.where(
        (rest != 1) & (draw * max(1, counted) < SAMPLE_ROWS)
    ).withColumn("rest", rest)
    rows = written(measured.join(sample, "id"), "labelled").repartition(PARTS)
    fitting = rows.where("rest = 0")
    width = len(STATISTICS)
    moments = fitting.agg(
        F.count("*").alias("n"),
        *[F.avg(F.col("x")[k]).alias(f"m{k}") for k in range(width)],
        *[F.stddev_pop(F.col("x")[k]).alias(f"s{k}") for k in range(width)],
    ).first()
    if not moments["n"]:
        return None
    random = np.random.default_rng(seed)
    scale = np.array([moments[f"s{k}"] for k in range(width)])
    model = QualityModel(
        mean=np.array([moments[f"m{k}"] for k in range(width)]),
        scale=np.where(scale > 1e-9, scale, 1.0),
        frequencies=random.normal(size=(width, FEATURES)) / WIDTH,
        phases=random.uniform(0, 2 * np.pi, FEATURES),
        weights=np.zeros(FEATURES + 1),
        knots=np.zeros(1),
        values=np.zeros(1),
    )
    size = FEATURES + 2
    sums = np.zeros((size, size))
    for row in fitting.mapInPandas(_normal_equations(model), "sums binary").collect():
        sums += np.frombuffer(row["sums"]).reshape(size, size)
    penalty = np.eye(FEATURES + 1) * RIDGE
    penalty[-1, -1] = 1e-6
    weights = np.linalg.solve(sums[:-1, :-1] + penalty, sums[:-1, -1])
    model = QualityModel(**{**model.__dict__, "weights": weights})
    bins = (
        rows.where("rest = 2")
        .mapInPandas(_binned(model), "bin long, raw double, label double")
        .groupBy("bin")
        .agg(F.avg("label").alias("label"), F.avg("raw").alias("raw"), F.count("*").alias("n"))
        .toPandas()
        .sort_values("bin")
    )
    if bins.empty:
        return QualityModel(**{**model.__dict__, "knots": np.array([0.0, 1.0]), "values": np.array([0.0, 1.0])})
    first, means = rising(bins["label"].to_numpy(), bins["n"].to_numpy())
    ends = np.append(first[1:], len(bins))
    raw, n = bins["raw"].to_numpy(), bins["n"].to_numpy()
    knots = [np.average(raw[a:b], weights=n[a:b]) for a, b in zip(first, ends)]
    return QualityModel(**{**model.__dict__, "knots": np.array(knots), "values": means})


def _judged(shared):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            score = shared.value.score(_rows(frame)) if len(frame) else np.empty(0)
            yield pd.DataFrame({"id": frame["id"], "score": score})

    return run


def score_quality(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: the id, held_out, score, predicted.

    ``labels`` has the id and ``quality``; null labels are left out. Null and empty texts are scored
    from zeros. Repeated rows are scored each; a label counts once for each. If nothing could be
    learned, every score is 0.5. A null id is not held out and teaches nothing. An empty
    table returns no rows. Other columns are ignored.
    """
    measured = written(
        docs.select(column(id_column).cast("long").alias("id"), column(text_column).alias("text"))
        .mapInArrow(_measured, "id long, x array<double>"),
        "statistics",
    )
    model = fit(
        measured,
        labels.select(column(id_column).alias("id"), F.col("quality").cast("double").alias("label"))
        .where("label IS NOT NULL AND NOT isnan(label)"),
    )
    if model is None:
        scored = measured.select("id", F.lit(0.5).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        scored = measured.mapInPandas(_judged(shared), "id long, score double")
    return scored.select(
        F.col("id").alias(id_column),
        F.coalesce(crc32_of_id(F.col("id")) % 3 == 1, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
