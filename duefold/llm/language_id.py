"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to three bytes, with counts of the bytes that followed. A
byte's code length is taken in the longest context the language knows; a byte that was not seen
there costs an escape (method C: distinct / (total + distinct)) and is coded in the next
shorter context, down to a uniform choice among 256. Statistics are frozen after fitting, so the code length of
a byte depends on four bytes only, and that of a text is exact and independent of how work is dealt out.
The shortest code wins.

Trees are fitted on a bounded sample: about SAMPLE_ROWS documents a language, none longer than
SAMPLE_BYTES. Every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duefold.llm.common import column, crc32_of_id, text_slices, written

ORDER = 3
SAMPLE_ROWS = 400
SAMPLE_BYTES = 1 << 15
#: Documents that a language of long documents alone is learned from, about.
LONG_ROWS = 20
#: Bits a byte that a text may need, against its language's samples, and bits that a short one may need more.
MOST_BITS = 2.6
SPARE_BITS = 512
#: Bytes of eight bits that count among each language's samples: what few samples need says little about others.
FLAT_BYTES = 512
UNKNOWN = "und"

#: Symbols: bytes with A-Z as a-z, and one that stands before a text's first byte.
_START = 256
_FOLD = np.arange(256, dtype=np.int64)
_FOLD[65:91] += 32
#: Classes of a fitted model: a byte never seen, the start, then the bytes seen.
_UNSEEN, _START_CLASS = 0, 1


@dataclass(frozen=True)
class PpmModel:
    """Code lengths in bits by context node, byte class and language."""

    languages: list[str]
    byte_class: np.ndarray
    node: np.ndarray
    bits: np.ndarray
    #: Bits a byte that each language needs for its own samples and ``FLAT_BYTES`` that it cannot foresee.
    own: np.ndarray

    def code_lengths(self, texts: list[bytes], step: int = 1 << 19) -> np.ndarray:
        """Bits each language needs for each text: (texts, languages)."""
        classes = len(self.bits[0])
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.concatenate(([0], np.cumsum(lengths + ORDER)))
        flat = np.frombuffer(
            b"".join(b"\0" * ORDER + text for text in texts) + b"\0", np.uint8
        )
        symbols = self.byte_class[flat].astype(np.int32)
        for k in range(ORDER):
            symbols[starts[:-1] + k] = _START_CLASS
        total = np.zeros((len(texts), len(self.languages)))
        for a in range(ORDER, int(starts[-1]), step):
            b = min(a + step, int(starts[-1]))
            context = symbols[a - 3 : b - 3] * classes
            context += symbols[a - 2 : b - 2]
            context *= classes
            context += symbols[a - 1 : b - 1]
            bits = self.bits[self.node[context], symbols[a:b]]
            first = np.searchsorted(starts, a, "right") - 1
            last = np.searchsorted(starts, b, "left")
            cuts = np.maximum(starts[first:last], a) - a
            total[first:last] += np.add.reduceat(bits, cuts, axis=0, dtype=np.float64)
        return total


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): how often four symbols follow each other; nine bits a symbol."""
    for batch in batches:
        languages = np.array(batch.column(0).to_pylist(), object)
        for first, texts in text_slices(batch.column(1)):
            for language in set(languages[first : first + len(texts)]):
                parts = []
                for k, text in enumerate(texts):
                    if languages[first + k] == language:
                        symbols = np.concatenate(
                            ([_START] * ORDER, _FOLD[np.frombuffer(text, np.uint8)])
                        )
                        gram = symbols[3:] | symbols[2:-1] << 9 | symbols[1:-2] << 18
                        parts.append(gram | symbols[:-3] << 27)
                grams, counts = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(grams), pa.string()), pa.array(grams), pa.array(counts)],
                    ["lang", "gram", "n"],
                )


def held_out(id_column: str):
    """True for documents that nothing may be learned from; false for a null id."""
    return F.coalesce(crc32_of_id(column(id_column)) % 3 == 1, F.lit(False))


def fit(
    docs: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    sample_bytes: int = SAMPLE_BYTES,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
) -> PpmModel | None:
    """Learn trees from labelled documents that are not held out; None if there are none.

    Documents of at most ``sample_bytes`` are drawn by a hash of their id, at a rate that gives
    ``sample_rows`` a language; of a language without such documents about ``LONG_ROWS`` whole ones.
    """
    rows = docs.select(
        column(id_column).alias("id"),
        column(lang_column).cast("string").alias("lang"),
        column(text_column).alias("text"),
        held_out(id_column).alias("held_out"),
    ).where("lang IS NOT NULL AND id IS NOT NULL AND NOT held_out")
    # Rates over the rows that can be drawn, so that a language of mostly long documents is learned, too;
    # one that has long documents alone is learned from them.
    short = F.octet_length("text").between(1, sample_bytes)
    some = rows.where(F.octet_length("text") >= 1)
    rates = (
        some.groupBy("lang")
        .agg(F.count_if(short).alias("short"), F.count("*").alias("all"))
        .select(
            "lang",
            (F.col("short") == 0).alias("only_long"),
            (
                F.when(F.col("short") > 0, F.lit(float(sample_rows)) / F.col("short")).otherwise(
                    F.lit(float(LONG_ROWS)) / F.col("all")
                )
            ).alias("rate"),
        )
    )
    # Stored, so that its size is known and the texts are not shuffled to a few rates.
    rates = written(rates, "language-rates")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(11), F.col("id").cast("string")), 12) / float(1 << 52)
    sample = (
        some.withColumn("draw", draw)
        .withColumn("short", short)
        .join(rates, "lang")
        .where("draw < rate AND (short OR only_long)")
        .select("lang", "text")
    )
    counts = (
        sample.mapInArrow(_grams, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    return build(counts) if counts.num_rows else None


def build(counts: pa.Table) -> PpmModel:
    """A model from (lang, gram, n)."""
    names = np.array(counts.column("lang").to_pylist(), object)
    languages = sorted(set(names))
    lang = np.searchsorted(np.array(languages), names.astype(str))
    gram = counts.column("gram").to_numpy()
    n = counts.column("n").to_numpy().astype(np.float64)
    last = gram & 511
    seen = np.unique(last)
    classes = 2 + len(seen)
    to_class = np.full(512, _UNSEEN, np.int64)
    to_class[seen] = np.arange(2, classes)
    to_class[_START] = _START_CLASS
    symbol = to_class[last]
    past = [to_class[gram >> 9 * k & 511] for k in range(1, ORDER + 1)]

    uniform = np.full((1, classes, len(languages)), 1 / 256, np.float32)
    node = np.zeros(classes**ORDER, np.int32).reshape((classes,) * ORDER)
    levels, parent_of, offset = [], None, 0
    for order in range(ORDER + 1):
        key = np.zeros(len(gram), np.int64)
        for k in range(order):
            key += past[k] * classes**k
        contexts, at = np.unique(key, return_inverse=True)
        if order == 0:
            chance = uniform.copy()
        else:
            shorter = np.searchsorted(parent_of, contexts % classes ** (order - 1))
            chance = levels[-1][shorter].copy()
        total = np.zeros((len(contexts), classes, len(languages)), np.float32)
        np.add.at(total, (at, symbol, lang), n)
        distinct = (total > 0).sum(axis=1)
        whole = total.sum(axis=1) + distinct
        known = whole > 0
        escape = np.where(known, distinct / np.maximum(whole, 1), 1.0)
        chance *= escape[:, None, :]
        chance = np.where(total > 0, total / np.maximum(whole, 1)[:, None, :], chance)
        levels.append(chance)
        ids = offset + np.arange(len(contexts))
        digits = [contexts // classes**k % classes for k in range(order)]
        where = (slice(None),) * (ORDER - order) + tuple(reversed(digits))
        node[where] = ids if order else ids[0]
        offset += len(contexts)
        parent_of = contexts
    code = -np.log2(np.concatenate(levels))
    code[:, _START_CLASS] = 0.0
    byte_class = to_class[_FOLD].astype(np.int32)
    paid = np.bincount(lang, n * code[offset - len(contexts) + at, symbol, lang], len(languages))
    own = (paid + 8 * FLAT_BYTES) / (np.bincount(lang, n, len(languages)) + FLAT_BYTES)
    return PpmModel(languages, byte_class, node.reshape(-1), code.astype(np.float32), own)


def _best(model: PpmModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the language with the shortest code, its chance, and whether the text reads like it."""
    best, score, reads = [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0, bool)]
    for _, part in text_slices(texts, 1 << 20):
        bits = model.code_lengths(part)
        best.append(bits.argmin(axis=1))
        score.append(1 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1))
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        reads.append(bits.min(axis=1) <= MOST_BITS * model.own[best[-1]] * sizes + SPARE_BITS)
    return np.concatenate(best), np.concatenate(score), np.concatenate(reads)


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(shared.value.languages, object)
        for batch in batches:
            best, score, _ = _best(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(names[best], pa.string()), pa.array(score)],
                ["id", "readable", "lang_pred", "score"],
            )

    return run


def _readable(text_column: str):
    return F.coalesce(column(text_column).rlike("\\p{L}"), F.lit(False))


def identify(
    docs: DataFrame,
    model: PpmModel | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: the id, held_out, lang_pred, score.

    score is the chance of the language among all learned ones, given equal chances before. A null text or
    one without a letter is ``und`` with score 0, and so is every text if nothing could be learned.
    Equal code lengths go to the first language by name. Repeated rows are scored
    each. An empty table returns no rows. Other columns are ignored.
    """
    model = model or fit(docs, id_column=id_column, text_column=text_column)
    rows = docs.select(
        column(id_column).cast("long").alias("id"),
        column(text_column).alias("text"),
        _readable(text_column).alias("readable"),
    )
    if model is None:
        scored = rows.select("id", "readable", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"))
        readable = F.lit(False)
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        scored = rows.mapInArrow(
            _predicted(shared), "id long, readable boolean, lang_pred string, score double"
        )
        readable = F.col("readable")
    return scored.select(
        F.col("id").alias(id_column),
        held_out("id").alias("held_out"),
        F.when(readable, F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(readable, F.col("score")).otherwise(0.0).alias("score"),
    )


def _recognised(shared, least_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, score, reads = _best(shared.value, batch.column(0).field("text"))
            yield batch.filter(pa.array(reads & (score >= least_score)))

    return run


def in_known_language(
    docs: DataFrame, model: PpmModel | None = None, least_score: float = 0.5
) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with their columns.

    Texts that are ``und`` go, and those no language explains: the code length in the likeliest language must not
    exceed ``MOST_BITS`` times what its samples need, bytes alike, and ``SPARE_BITS`` for short texts; so
    other scripts and salads of letters go. Texts whose language has a chance below ``least_score`` go, too. If
    nothing could be learned, every text with a letter stays. Repeated rows are judged each, texts of any
    length are read whole, an empty table gives no rows.
    """
    model = model or fit(docs)
    rows = docs.where(_readable("text")).select(F.struct("*").alias("doc"))
    if model is not None:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        rows = rows.mapInArrow(_recognised(shared, least_score), rows.schema)
    return rows.select("doc.*")
