"""Language identification by multinomial naive Bayes over hashed character n-grams.

Features are all 1- to 3-grams of code points that start in the whole lower-cased text or at one blank after it, where ASCII characters other than letters count as blanks; each n-gram is
hashed to one of ``BUCKETS`` columns. Training counts n-grams per label in Spark on a bounded sample: ``TRAIN_ROWS`` labelled rows per label are
expected, chosen by a hash of ``doc_id``. The matrix of log probabilities has ``BUCKETS`` x labels numbers, labels are at most ``MOST_LABELS`` (more
raise an error), so it may be broadcast. Scoring sums the matrix rows of a batch's n-grams per document in numpy.

Null texts and texts without a letter give ``und`` with score 0; so does every text if there are no labelled rows. Rows without ``doc_id`` are never
trained on; rows that repeat a ``doc_id`` are sampled together. Equal scores go to the label that sorts first.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmap.llm.arrow import arrow_schema
from rillmap.llm.tokens import pieces

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
TRAIN_ROWS = 10_000
MOST_LABELS = 64
SMOOTHING = 0.1
UNKNOWN = "und"
_MAP = np.full(128, 32, np.uint32)
_MAP[[ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]] = [ord(c) for c in "abcdefghijklmnopqrstuvwxyz"]


@dataclass(frozen=True)
class Model:
    labels: list[str]
    prior: np.ndarray            # log share of each label
    weight: np.ndarray           # BUCKETS x labels, log probabilities, and a row of zeros for places that do not count


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, ``max(ORDERS)`` blanks after each, and where each text starts."""
    parts = [(t or "").lower() + " " * max(ORDERS) for t in texts]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.where(points < 128, _MAP[np.minimum(points, 127)], points)
    return points, np.cumsum(size) - size


def _grams(points: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each place."""
    held = np.full(len(points), order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    padded = np.concatenate([points, np.full(order, 32, np.uint32)])
    for k in range(order):
        held = (held ^ padded[k:k + len(points)]) * np.uint32(0x85EBCA6B)
        held ^= held >> np.uint32(15)
    return held >> np.uint32(32 - BUCKETS.bit_length() + 1)


def _own_places(stops: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Which places of a range count: those of a text and of one blank after it, so that no n-gram reaches the next text."""
    own = np.ones(end - begin, bool)
    for k in range(1, max(ORDERS)):
        at = stops - k
        own[at[(at >= begin) & (at < end)] - begin] = False
    return own


def _sums(texts: list[str | None], weight: np.ndarray) -> np.ndarray:
    """The summed rows of ``weight`` of each text's n-grams; they depend on no other text."""
    points, start = _points(texts)
    total = np.zeros((len(texts), weight.shape[1]))
    stops = np.append(start[1:], len(points))
    block = 1 << 19
    for a in range(0, len(points), block):
        b = min(len(points), a + block)
        first, last = np.searchsorted(stops, a, "right"), np.searchsorted(start, b, "left")
        cut = np.maximum(start[first:last], a) - a
        view = points[a:min(len(points), b + max(ORDERS) - 1)]
        own = _own_places(stops, a, b)
        for order in ORDERS:
            total[first:last] += np.add.reduceat(weight[np.where(own, _grams(view, order)[:b - a], BUCKETS)], cut, axis=0)
    return total


def train(docs: DataFrame, rows_per_label: int = TRAIN_ROWS) -> Model:
    """Fit on the labelled rows of ``docs`` (doc_id, text, lang)."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    found = sorted(known.groupBy("lang").count().limit(MOST_LABELS + 1).collect())
    if len(found) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    labels, sizes = [r[0] for r in found], np.array([r[1] for r in found], np.float64)
    counts = np.zeros((BUCKETS, len(labels)))
    if labels:
        share = F.create_map(*[F.lit(x) for lab, n in zip(labels, sizes) for x in (lab, min(1.0, rows_per_label / float(n)))])
        coin = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) / F.lit(float(1 << 30))
        place = {lab: i for i, lab in enumerate(labels)}

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.zeros((len(labels), BUCKETS), np.int64)
            for batch in batches:
                langs, texts = batch.column(1).to_pylist(), batch.column(0).to_pylist()
                for lab in set(langs):
                    for _, group in pieces([t for t, x in zip(texts, langs) if x == lab]):
                        points, start = _points(group)
                        own = _own_places(np.append(start[1:], len(points)), 0, len(points))
                        for order in ORDERS:
                            held[place[lab]] += np.bincount(_grams(points, order)[own], minlength=BUCKETS)
            which, bucket = np.nonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(held[which, bucket])],
                                             names=["which", "bucket", "n"])

        sample = known.where(coin < share[F.col("lang")]).select("text", "lang")
        summed = sample.mapInArrow(count, "which int, bucket int, n long").groupBy("which", "bucket").agg(F.sum("n").alias("n")).toArrow()
        counts[summed["bucket"].to_numpy(), summed["which"].to_numpy()] = summed["n"].to_numpy()
    smooth = counts + SMOOTHING
    weight = np.log(smooth) - np.log(smooth.sum(0, keepdims=True))
    return Model(labels, np.log(sizes / sizes.sum()) if labels else np.zeros(0), np.concatenate([weight, np.zeros((1, len(labels)))]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` (posterior probability of the predicted label)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    ddl = ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), "lang_pred string, score double"])
    schema = arrow_schema(ddl)
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            clear = [i for i, t in enumerate(texts) if m.labels and has_letter(t)]
            for begin, group in pieces([texts[i] for i in clear]):
                total = _sums(group, m.weight) + m.prior
                best = total.argmax(1)
                own = clear[begin:begin + len(group)]
                scores[own] = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                for i, b in zip(own, best.tolist()):
                    langs[i] = m.labels[b]
            yield pa.RecordBatch.from_arrays([*(c.cast(t) for c, t in zip(batch.columns, schema.types)), pa.array(langs, pa.string()), pa.array(scores)], schema=schema)

    return docs.mapInArrow(score, ddl)


def held_out(doc_id: Column) -> Column:
    """True for rows that no model may learn from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def identify_language(docs: DataFrame, rows_per_label: int = TRAIN_ROWS) -> DataFrame:
    """Train on the rows of ``docs`` that are not held out and predict all of them."""
    return predict(docs, train(docs.where(~held_out(F.col("doc_id"))), rows_per_label))
