"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector x. Its logit is w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, where the double sum
is half of |sum_i v_i x_i|^2 - sum_i |v_i x_i|^2 and so costs one pass over the non-zero entries. It is fitted in numpy
on at most ``SAMPLE`` labelled documents, the ones of lowest hash; scoring broadcasts the fitted weights (4 MB).
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_texts

SAMPLE = 12_000
BUCKETS = 1 << 16
RANK = 8
CUT = 0.3
SYMBOLS = b"#*$%&|<>"
STATS = ("log_words", "word_length", "upper", "digits", "symbols", "exclamations", "stops", "spaces", "high_bytes", "distinct_words", "top_word", "repeated_lines", "log_lines", "log_chars")

_CLASS = np.zeros((8, 256))
for _row, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), SYMBOLS, b"!?", b".,;:", b" \t\n\v\f\r", range(128, 256))):
    _CLASS[_row, list(_chars)] = 1


def features(text: bytes, n_chars: float) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the distinct words, structure statistics); an empty text has no bucket and zero statistics."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(STATS), np.float32)
    count: dict[bytes, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    upper, lower, digits, symbols, loud, stops, spaces, high = _CLASS @ np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = len(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    stats = [
        np.log1p(n), (size - spaces) / n, upper / max(1, upper + lower), digits / size, symbols / size, loud / size, stops / size, spaces / size, high / size,
        len(count) / n, max(count.values()) / n, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)), np.log1p(n_chars),
    ]
    return np.array([crc32(w.lower()) % BUCKETS for w in count], np.int32), np.array(stats, np.float32)


@dataclass
class Machine:
    """Weights of buckets and, behind them, of standardised statistics."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def entries(self, buckets: list[np.ndarray], stats: np.ndarray):
        """(index, value, start of each document) of all non-zero entries."""
        z = np.clip((stats - self.mean) / self.scale, -4, 4).astype(np.float32)
        sizes = np.array([len(b) for b in buckets]) + z.shape[1]
        index = np.concatenate([x for b in buckets for x in (b, BUCKETS + np.arange(z.shape[1]))]).astype(np.int64)
        value = np.concatenate([x for b, s in zip(buckets, z, strict=True) for x in (np.full(len(b), 1 / np.sqrt(max(1, len(b))), np.float32), s)])
        return index, value, np.concatenate(([0], np.cumsum(sizes)[:-1]))

    def logits(self, index, value, start):
        v = self.factors[index] * value[:, None]
        total = np.add.reduceat(v, start)
        pairs = 0.5 * (total**2 - np.add.reduceat(v**2, start)).sum(1)
        return self.bias + np.add.reduceat(self.linear[index] * value, start) + pairs, v, total

    def scores(self, buckets, stats) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*self.entries(buckets, stats))[0], -30, 30))) if buckets else np.zeros(0)


def fit(buckets: list[np.ndarray], stats: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 200, least_steps: int = 150, rate: float = 0.02, decay: float = 1e-5, seed: int = 1) -> Machine:
    """Logistic loss by Adam over mini-batches, ``epochs`` times or ``least_steps`` steps. No labelled document: all scores near one half."""
    rng = np.random.default_rng(seed)
    n, size = len(labels), BUCKETS + len(STATS)
    mean, scale = (stats.mean(0), np.maximum(stats.std(0), 1e-3)) if n else (np.zeros(len(STATS)), np.ones(len(STATS)))
    m = Machine(0.0, np.zeros(size, np.float32), rng.normal(0, 0.02, (size, RANK)).astype(np.float32), mean, scale)
    params = np.concatenate([m.linear[:, None], m.factors], 1)
    m.linear, m.factors = params[:, 0], params[:, 1:]
    first, second, bias = np.zeros_like(params), np.zeros_like(params), np.zeros(2)
    step = 0
    for _ in range(max(epochs, -(-least_steps * batch // max(n, batch)))):
        for at in np.array_split(rng.permutation(n), max(1, -(-n // batch))) if n else []:
            step += 1
            index, value, start = m.entries([buckets[i] for i in at], stats[at])
            out, v, total = m.logits(index, value, start)
            wrong = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels[at]) / len(at)
            each = np.repeat(np.arange(len(at)), np.diff([*start, len(index)]))
            g = np.concatenate([(wrong[each] * value)[:, None], (wrong[each] * value)[:, None] * (total[each] - v)], 1)
            own, place = np.unique(index, return_inverse=True)
            grad = np.stack([np.bincount(place, g[:, k], len(own)) for k in range(g.shape[1])], 1) + decay * params[own]
            first[own] = 0.9 * first[own] + 0.1 * grad
            second[own] = 0.99 * second[own] + 0.01 * grad**2
            params[own] -= rate * (first[own] / (1 - 0.9**step)) / (np.sqrt(second[own] / (1 - 0.99**step)) + 1e-8)
            bias = np.array([0.9 * bias[0] + 0.1 * wrong.sum(), 0.99 * bias[1] + 0.01 * wrong.sum() ** 2])
            m.bias -= rate * (bias[0] / (1 - 0.9**step)) / (np.sqrt(bias[1] / (1 - 0.99**step)) + 1e-8)
    m.linear, m.factors = np.ascontiguousarray(params[:, 0]), np.ascontiguousarray(params[:, 1:])
    return m


def _inputs(docs: DataFrame, id_col: str, text_col: str, chars_col: str) -> list:
    chars = F.col(chars_col).cast("double") if chars_col in docs.columns else F.char_length(F.col(text_col).cast("string")).cast("double")
    return [F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(chars, F.lit(0.0)).alias("chars")]


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> Machine:
    """Fit on the documents of the ``sample`` labelled ids of lowest hash; an id with several labels has their rounded mean.

    Null labels and ids are left out. Labels, language, source and id are no inputs.
    """
    chosen = labels.groupBy(F.col(id_col).cast("long").alias("key")).agg(F.avg(label_col).alias("label")).where("key is not null and label is not null")
    chosen = chosen.orderBy(F.xxhash64("key"), "key").limit(sample)  # the bound that makes the broadcast safe
    rows = docs.select(*_inputs(docs, id_col, text_col, chars_col)).join(F.broadcast(chosen), F.col("id") == F.col("key"))

    def scan(batches):
        for b in batches:
            got = [features(t, c) for t, c in zip(byte_texts(b.column(1)), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0].tobytes() for g in got], pa.binary()), pa.array([g[1].tobytes() for g in got], pa.binary()), b.column(3)], ["id", "buckets", "stats", "label"])

    found = rows.select("id", "text", "chars", "label").mapInArrow(scan, "id long, buckets binary, stats binary, label double").limit(2 * sample).toArrow().to_pylist()
    found.sort(key=lambda r: (r["id"], r["stats"], r["buckets"]))
    stats = np.array([np.frombuffer(r["stats"], np.float32) for r in found]).reshape(len(found), len(STATS))
    return fit([np.frombuffer(r["buckets"], np.int32) for r in found], stats, np.array([float(r["label"] >= 0.5) for r in found]))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """(id, score): the probability of label 1 for every row of ``docs``; null text counts as empty and is scored too."""
    return _scored(docs.select(*_inputs(docs, id_col, text_col, chars_col)), machine, "id long, score double", ["id"]).withColumnRenamed("id", id_col)


def _scored(rows: DataFrame, machine: Machine, schema, carry: list[str]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(machine)

    def scan(batches):
        m = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = [features(t, c) for t, c in zip(byte_texts(part.column("text")), part.column("chars").to_pylist(), strict=True)]
                scores = m.scores([g[0] for g in got], np.array([g[1] for g in got]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(scores, pa.float64())], [*carry, "score"])

    return rows.mapInArrow(scan, schema)


def keep_good(docs: DataFrame, machine: Machine, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs``, all columns, that score ``cut`` or more; texts are scored in place and not shuffled."""
    _, text, chars = _inputs(docs, id_col, text_col, chars_col)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text, chars)
    schema = T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())])
    return _scored(rows, machine, schema, ["row"]).where(F.col("score") >= cut).select("row.*")
