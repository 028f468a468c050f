"""Language-model scoring: a log-bilinear model fitted in numpy by noise-contrastive estimation.

The context of a token is the ``BACK`` tokens before it: h = sum over j of p_j * r(t[-1-j]), p_j a vector of weights for
the distance. The vocabulary is the leaves of a tree of ``FAN`` children a node, ordered by frequency, so that a token's
probability is the product of one softmax a level: log p(child | node, context) = h . q_child + b_child, normalised by
batched matrix products over the children of its node. Leaves are the tokens seen twice or more, up to ``OWN`` of them
(the table that is broadcast), each with vectors of its own, and classes of all other tokens by their last three bytes,
whose number grows as the root of the vocabulary. Vectors of a token are its own plus its class's. Within a class of
others a token has probability (c + 1) / sum(c + 1), c being its count, with one share for unseen tokens, so that the
probabilities of all tokens sum to one and every token's depends on its context.

Counts cover every training token, and so does the fit: every position of every training text is learnt from, and a
corpus of fewer than ``LEAST`` or ``FITTED`` times its distinct tokens is gone over up to ``PASSES`` times. Each of several trainers fits a copy on its share of them:
at every level of the tree the true child is told from noise children of its node. In a node that a step meets
``CROWD`` times or more, noise is every other child once and the true one is ranked among them, which is the softmax;
elsewhere it is ``NOISE`` children drawn evenly, by the logistic of the score less log(noise / children). What trainers changed is averaged row by row, weighted by how far each moved, in
blocks of rows and two rounds, so that no task holds more than some trainers' blocks.

Scoring looks leaves up in the broadcast table. Every other token of a document joins its count by a shuffle, so no
table that grows with the corpus is ever held by one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import isqrt
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import byte_texts, cut, slices

OWN = 1 << 18
BACK, FAN, ROOT, DIMENSION, NOISE = 3, 64, 80, 16, 3
FITTED, LEAST, PASSES = 2, 100_000, 8
#: Positions of one trainer (about: as many as make its copy worth sending), of one step of its, and tokens scored at once.
SHARE, STEP, BLOCK = 4_000_000, 32768, 1 << 17
RATE = 0.1
#: Positions of a node in a step from which on its noise is every child.
CROWD = 8
#: Positions whose scores are computed at once.
PIECE = 512
ROWS, SALTS = 4096, 16
FLUSH = 400_000
#: Not words, since words have no space: the end of a text as a token, and prefix of a document's own row.
END, HEAD = b" ", b"  "


def _tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def class_number(distinct: int) -> int:
    """Classes of tokens without vectors of their own, for so many distinct tokens."""
    return 4 * isqrt(max(0, distinct)) + 1


def token_class(token: bytes, classes: int) -> int:
    return crc32(token[-3:]) % classes


def class_column(token: str, classes: int) -> Column:
    last = F.when(F.length(token) <= 3, F.col(token)).otherwise(F.substring(F.col(token), F.length(token) - 2, F.lit(3)))
    return F.crc32(last) % classes


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, n) over all texts (one binary-safe string column); tasks sum before the shuffle and hold ``FLUSH`` tokens at most."""

    def batch(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

    def scan(batches):
        counts: Counter = Counter()
        for b in slices(batches):
            for t in byte_texts(b.column(0)):
                counts.update(_tokens(t))
                if len(counts) > FLUSH:
                    yield batch(counts)
                    counts.clear()
        if counts:
            yield batch(counts)

    return texts.mapInArrow(scan, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Leaves of the tree in order of frequency: tokens with vectors of their own, and classes of the others."""

    names: list[bytes]  # tokens of their own
    leaf: np.ndarray  # leaf of each name, then of each class
    classes: int
    count: np.ndarray  # count by leaf; 0 for a class
    tail: np.ndarray  # by leaf: the sum of c + 1 over the class's tokens and one unseen; 1 for a token of its own
    kind: np.ndarray  # class by leaf, and of the start of a text
    bias: list[np.ndarray]  # by level from the root: log of a child's share of its node

    @property
    def start(self) -> int:
        return len(self.count)


def vocabulary(names: list[bytes], counts: list[int], tails: np.ndarray) -> Vocabulary:
    """``tails`` is, by class, the sum of c + 1 over tokens that aren't in ``names``, and 1."""
    mass = np.concatenate((np.array(counts, float), tails))
    order = np.argsort(-mass, kind="stable")
    leaf = np.empty(len(mass), np.int64)
    leaf[order] = np.arange(len(mass))
    known = len(names)
    own = order < known
    kind = np.array([token_class(t, len(tails)) for t in names] + list(range(len(tails))), np.int64)[order]
    shares, bias = [mass[order]], []
    while len(shares[0]) > ROOT:
        shares.insert(0, np.add.reduceat(shares[0], np.arange(0, len(shares[0]), FAN)))
    for k, x in enumerate(shares):
        bias.append(np.log(x / (np.repeat(shares[k - 1], FAN)[: len(x)] if k else x.sum())).astype(np.float32))
    return Vocabulary(names, leaf, len(tails), np.where(own, mass[order], 0), np.where(own, 1.0, mass[order]), np.append(kind, len(tails)), bias)


class _Leaves(dict):
    """Leaf by token; a token without a leaf of its own has its class's."""

    def __init__(self, v: Vocabulary):
        super().__init__(zip(v.names, v.leaf[: len(v.names)].tolist(), strict=True))
        self.classes, self.of_class, self.back = v.classes, v.leaf[len(v.names) :], [v.start] * BACK

    def __missing__(self, token: bytes) -> int:
        return -1

    def padded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(leaves after ``BACK`` starts, places in ``words`` without a leaf of their own)"""
        got = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        cold = np.flatnonzero(got < 0)
        got[cold] = self.of_class[[token_class(words[i], self.classes) for i in cold.tolist()]]
        return np.concatenate((self.back, got)), cold


class Net:
    """Parameters in numpy: rows of tokens and classes as context, weights by distance, rows by level, rows of classes."""

    def __init__(self, v: Vocabulary, seed: int = 1):
        rng, d = np.random.default_rng(seed), DIMENSION
        classes = rng.normal(0, 0.3, (v.classes + 1, d))
        start = [np.zeros((v.start + 1, d)), classes, np.repeat(1 / np.arange(1, BACK + 1), d).reshape(BACK, d), rng.normal(0, 0.1, (v.classes + 1, d))]
        self.v, self.depth = v, len(v.bias)
        self.w = [x.astype(np.float32) for x in start] + [np.column_stack((np.zeros((len(b), d), np.float32), b)) for b in v.bias]
        self.moved = [np.zeros(len(x), np.float32) for x in self.w]  # sums of squared gradients, by row

    def _step(self, table: int, rows: np.ndarray, vectors: np.ndarray, rate: float, scale: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """AdaGrad, one rate a row; slopes of a row that repeats are summed. Returns the distinct rows and those sums.

        Slopes are ``vectors``, or with ``scale`` (a row for each vector, a column for each of its ``rows``) their multiples.
        """
        order = np.argsort(rows)
        slopes = vectors.take(order if scale is None else order // scale.shape[1], axis=0)
        if scale is not None:
            slopes *= scale.ravel().take(order)[:, None]
        rows = rows.take(order)
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        if slopes.shape[1] % 2:
            total, rows = np.add.reduceat(slopes, first, axis=0), rows.take(first)
        else:  # pairs of columns as complex numbers: half the work
            total, rows = np.add.reduceat(slopes.view(np.complex64), first, axis=0).view(np.float32), rows.take(first)
        moved = self.moved[table].take(rows) + np.einsum("rd,rd->r", total, total) / np.float32(total.shape[1])
        self.moved[table][rows] = moved
        self.w[table][rows] = self.w[table].take(rows, axis=0) - total * (np.float32(rate) / np.sqrt(moved + np.float32(0.01)))[:, None]
        return rows, total

    def learn(self, positions: np.ndarray, rng, rate: float) -> None:
        """One step on positions given as rows: the leaf to predict, then those before it, nearest first.

        In rows that follow each other in a text a context is the one before, moved by one; its vectors are taken once.
        """
        r, rc, p = self.w[:3]
        kind, n = self.v.kind, len(positions)
        met = [np.concatenate((positions[0, BACK:0:-1], positions[1:, 1]))]  # the contexts of the first row, then the nearest of each
        other = [np.flatnonzero(positions[:, 1 + j] != met[0][BACK - 1 - j : BACK - 1 - j + n]) for j in range(BACK)]
        met = np.concatenate(met + [positions[rows, 1 + j] for j, rows in enumerate(other)]).astype(np.int64)
        ends = n + BACK - 1 + np.cumsum([0, *map(len, other)])
        vectors, given = r.take(met, axis=0) + rc.take(kind.take(met), axis=0), []
        for j, rows in enumerate(other):
            given.append(vectors[BACK - 1 - j : BACK - 1 - j + n])
            if len(rows):
                given[j] = given[j].copy()
                given[j][rows] = vectors[ends[j] : ends[j + 1]]
        order = np.argsort(positions[:, 0])  # positions of a node become neighbours
        target = positions[:, 0].take(order).astype(np.int64)
        one = np.ones((n, DIMENSION + 1), np.float32)
        one[:, :-1] = sum(e * p[j] for j, e in enumerate(given)).take(order, axis=0)
        back = np.zeros((n, DIMENSION), np.float32)
        for k in range(self.depth):
            child = target // FAN ** (self.depth - 1 - k)
            first = child // FAN * FAN if k else np.zeros_like(child)
            bounds = np.append(np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1]))), len(first))
            crowded = np.diff(bounds) >= CROWD
            if crowded.any():
                self._every_child(k, bounds[:-1][crowded], bounds[1:][crowded], child, first, one, back, rate)
            few = np.flatnonzero(np.repeat(~crowded, np.diff(bounds)))
            if len(few):
                back[few] += self._some_children(k, child.take(few), first.take(few), one.take(few, axis=0), rng, rate)
        slopes, sorted_back = np.zeros_like(vectors), back
        back = np.empty_like(sorted_back)
        back[order] = sorted_back
        for j, rows in enumerate(other):
            slope = back * p[j]
            slopes[ends[j] : ends[j + 1]] = slope[rows]
            slope[rows] = 0
            slopes[BACK - 1 - j : BACK - 1 - j + n] += slope
        slope = np.stack([np.einsum("bd,bd->d", back, e) for e in given])
        changed, total = self._step(0, met, slopes, rate)
        self._step(1, kind.take(changed), total, rate)
        self._step(2, np.arange(BACK), slope, rate)

    def _every_child(self, k: int, begins, ends, child, first, one, back, rate: float) -> None:
        """Positions of crowded nodes, from a begin to an end each: noise is every other child of the node, by matrix products."""
        q, leaves, d, width = self.w[4 + k], k == self.depth - 1, DIMENSION, FAN if k else len(self.w[4])
        rows = first[begins][:, None] + np.arange(width)
        inside = rows < len(q)
        held = np.minimum(rows, len(q) - 1)
        vectors = q.take(held, axis=0)
        if leaves:
            vectors[:, :, :d] += self.w[3].take(self.v.kind.take(held), axis=0)
        vectors[~inside] = [0] * d + [-1e4]
        total, lines, ones, scratch = np.zeros_like(vectors), np.arange(PIECE), np.ones(width, np.float32), np.empty((PIECE, width), np.float32)
        turned = np.ascontiguousarray(vectors.transpose(0, 2, 1))
        groups, size = [], PIECE
        for m, (a, z) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
            for at in range(a, z, PIECE):
                n = min(z - at, PIECE)
                if size + n > PIECE:
                    groups.append([])
                    size = 0
                groups[-1].append((m, at, at + n, size, size + n))
                size += n
        for pieces in groups:
            for m, a, z, x, y in pieces:
                np.matmul(one[a:z], turned[m], out=scratch[x:y])
            s = scratch[: pieces[-1][4]]
            if s.max() > 60:
                s -= s.max(1, keepdims=True)
            np.exp(s, out=s)
            norm = s @ ones
            at = np.concatenate([np.arange(a, z) for _, a, z, _, _ in pieces])
            s[lines[: len(s)], child.take(at) - first.take(at)] -= norm
            norm = (1 / norm)[:, None]  # scales what comes of the scores, which is less than the scores
            given = one.take(at, axis=0) * norm
            for m, a, z, x, y in pieces:
                back[a:z] += (s[x:y] @ vectors[m, :, :d]) * norm[x:y]
                total[m] += s[x:y].T @ given[x:y]
        rows, total = rows[inside], total[inside]
        moved = self.moved[4 + k].take(rows) + np.einsum("rd,rd->r", total, total) / np.float32(d + 1)
        self.moved[4 + k][rows] = moved
        q[rows] = q.take(rows, axis=0) - total * (np.float32(rate) / np.sqrt(moved + np.float32(0.01)))[:, None]
        if leaves:
            self._step(3, self.v.kind.take(rows), total[:, :d], rate)

    def _some_children(self, k: int, child, first, one, rng, rate: float) -> np.ndarray:
        """Positions of other nodes: noise is ``NOISE`` children drawn evenly. Returns slopes of the context."""
        q, kind, leaves, d = self.w[4 + k], self.v.kind, k == self.depth - 1, DIMENSION
        size = np.minimum(len(q) - first, FAN if k else len(q))
        rows = np.empty((len(one), 1 + NOISE), np.int64)
        rows[:, 0] = child
        rows[:, 1:] = first[:, None] + (rng.random((len(one), NOISE)) * size[:, None]).astype(np.int64)
        vectors = q.take(rows, axis=0)
        if leaves:
            vectors[:, :, :d] += self.w[3].take(kind.take(rows), axis=0)
        slope = np.einsum("bkd,bd->bk", vectors, one) - np.log(NOISE / size).astype(np.float32)[:, None]
        slope = 1 / (1 + np.exp(-np.clip(slope, -30, 30)))
        slope[:, 0] -= 1
        changed, total = self._step(4 + k, rows.ravel(), one, rate, slope)
        if leaves:
            self._step(3, kind.take(changed), total[:, :d], rate)
        return np.einsum("bk,bkd->bd", slope, vectors[:, :, :d])

    def changes(self, start: Net) -> Iterator[tuple[int, bytes]]:
        """(block, packed rows): rows that moved since ``start``, ``ROWS`` rows a block."""
        for t, (w, was, moved) in enumerate(zip(self.w, start.w, self.moved, strict=True)):
            for at in range(0, len(w), ROWS):
                rows = np.flatnonzero(moved[at : at + ROWS])
                if len(rows):
                    yield (t << 32) + at // ROWS, pack(rows, np.sqrt(moved[at + rows]), w[at + rows] - was[at + rows])

    def add(self, block: int, packed: bytes) -> None:
        rows, _, change = unpack(packed, self.w[block >> 32].shape[1])
        self.w[block >> 32][(block & 0xFFFFFFFF) * ROWS + rows] += change


def pack(rows: np.ndarray, weight: np.ndarray, change: np.ndarray) -> bytes:
    return np.int64(len(rows)).tobytes() + rows.astype(np.int32).tobytes() + weight.astype(np.float32).tobytes() + change.astype(np.float16).tobytes()


def unpack(packed: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(packed, np.int64, 1)[0])
    return np.frombuffer(packed, np.int32, n, 8), np.frombuffer(packed, np.float32, n, 8 + 4 * n), np.frombuffer(packed, np.float16, n * width, 8 + 8 * n).reshape(n, width).astype(np.float32)


def average(parts: list[bytes], width: int) -> bytes:
    """One packed block from several: by row the weighted mean of changes, and the weights' sum."""
    total, weights = np.zeros((ROWS, width), np.float32), np.zeros(ROWS, np.float32)
    for part in parts:
        rows, weight, change = unpack(part, width)
        total[rows] += weight[:, None] * change
        weights[rows] += weight
    rows = np.flatnonzero(weights)
    return pack(rows, weights[rows], total[rows] / weights[rows][:, None])


def _positions(text: bytes, leaves: _Leaves, most: int) -> Iterator[np.ndarray]:
    """All positions of a text as rows of leaves (the one to predict, then those before it), up to ``most`` at once."""
    ids = leaves.padded(_tokens(text))[0]
    rows = np.empty((len(ids) - BACK, BACK + 1), np.int32)
    for j in range(BACK + 1):
        rows[:, j] = ids[BACK - j : len(ids) - j]
    for at in range(0, len(rows), most):
        yield rows[at : at + most]


def fit(texts: DataFrame, v: Vocabulary, tokens: int, distinct: int, share: int = SHARE) -> Net:
    """The net after all trainers have fitted their texts; texts is one string column of ``tokens`` tokens."""
    spark, net = texts.sparkSession, Net(v)
    passes = min(PASSES, max(1, max(LEAST, FITTED * distinct) // max(1, tokens)))
    shared = spark.sparkContext.broadcast(v)
    trainers = max(1, round(passes * tokens / share))

    def train(batches):
        rng, leaves = np.random.default_rng(TaskContext.get().partitionId()), _Leaves(shared.value)
        own, held, size, done = Net(shared.value), [], 0, 0
        whole = max(1.0, passes * tokens / trainers)
        step = int(min(STEP, max(64, whole // 64)))

        def learn(rows):
            nonlocal done
            for _ in range(passes):
                for at in range(0, len(rows), step):
                    own.learn(rows[at : at + step], rng, RATE * (1 - 0.9 * min(1.0, done / whole)))
                    done += step

        for b in slices(batches):
            for t in byte_texts(b.column(0)):
                for rows in _positions(t, leaves, STEP):
                    held.append(rows)
                    size += len(rows)
                    if size >= 4 * STEP:
                        rng.shuffle(held)
                        learn(np.concatenate(held))
                        held, size = [], 0
        if size:
            learn(np.concatenate(held))
        salt = TaskContext.get().partitionId() % SALTS
        for block, packed in own.changes(Net(shared.value)):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([salt], pa.int64()), pa.array([packed], pa.binary())], ["block", "salt", "packed"])

    def merge(key, tab):
        block = int(key[0].as_py())
        width = DIMENSION + ((block >> 32) > 3)
        return pa.table([pa.array([block]), pa.array([average(tab.column("packed").to_pylist(), width)], pa.binary())], names=["block", "packed"])

    found = texts.coalesce(trainers).mapInArrow(train, "block long, salt long, packed binary")
    found = found.groupBy("block", "salt").applyInArrow(merge, "block long, packed binary")
    found = found.groupBy("block").applyInArrow(merge, "block long, packed binary").toArrow()
    for block, packed in zip(found["block"].to_pylist(), found["packed"].to_pylist(), strict=True):
        net.add(block, packed)
    return net


class Scorer:
    """Tables for scoring, made from a net: context rows by distance, and one row a child and level, bias last."""

    def __init__(self, net: Net, tokens: int, distinct: int):
        r, rc, p, qc, *levels = net.w
        self.v, self.tokens, self.distinct = net.v, tokens, distinct
        self.rows, self.distance = r + rc[net.v.kind], p
        self.levels = [q.copy() for q in levels]
        self.levels[-1][:, :-1] += qc[net.v.kind[:-1]]
        reach = sum(np.abs(self.rows * x).max(0) for x in p)
        most = max(float((np.abs(q[:, :-1]) @ reach).max()) for q in self.levels)
        if most > 60:  # else exp could leave the range of 32-bit floats
            self.levels = [np.column_stack((q[:, :-1] * np.float32(60 / most), q[:, -1])) for q in self.levels]

    def ready(self) -> Scorer:
        """With tables that need not travel."""
        self.given = [self.rows * x for x in self.distance]
        self.children = []
        for k, q in enumerate(self.levels):  # by level (nodes, DIMENSION + 1, children); what a last node lacks has no probability
            width = FAN if k else len(q)
            whole = np.zeros((-(-len(q) // width) * width, DIMENSION + 1), np.float32)
            whole[: len(q)], whole[len(q) :, -1] = q, -1e4
            self.children.append(np.ascontiguousarray(whole.reshape(-1, width, DIMENSION + 1).transpose(0, 2, 1)))
        self.log_count, self.log_tail = np.log10(self.v.count + 1), np.log10(self.v.tail)
        self.leaves = _Leaves(self.v)
        return self

    def log10(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 p of the leaf at each place ``at`` of ``ids``, given those before it."""
        out, d = np.zeros(len(at)), DIMENSION
        for begin in range(0, len(at), BLOCK):
            part = at[begin : begin + BLOCK]
            leaf = ids[part]
            both = np.sort((leaf << BLOCK.bit_length()) | np.arange(len(leaf)))  # leaf and place as one number: faster than argsort
            order, leaf = both & ((1 << BLOCK.bit_length()) - 1), both >> BLOCK.bit_length()
            part = part.take(order)
            h = np.empty((len(part), d + 1), np.float32)
            h[:, d] = 1
            np.take(self.given[0], ids[part - 1], axis=0, out=(near := np.empty((len(part), d), np.float32)))
            for j in range(1, BACK):
                near += self.given[j].take(ids[part - 1 - j], axis=0)
            h[:, :d] = near
            p = np.ones(len(part))
            lines = np.arange(PIECE)
            for k, tables in enumerate(self.children):
                child, width = leaf // FAN ** (len(self.children) - 1 - k), tables.shape[2]
                node = child // width if k else np.zeros_like(child)
                place = child - node * width
                scratch, ones = np.empty((PIECE, width), np.float32), np.ones(width, np.float32)
                bounds = np.union1d(np.flatnonzero(node[1:] != node[:-1]) + 1, np.arange(0, len(part) + PIECE, PIECE))
                bounds = bounds[bounds < len(part)]
                nodes, ends, a = node[bounds].tolist(), [*bounds[1:].tolist(), len(part)], 0
                for n, z in zip(nodes, ends, strict=True):
                    np.matmul(h[a:z], tables[n], out=scratch[a % PIECE : a % PIECE + z - a])
                    a = z
                    if z % PIECE == 0 or z == len(part):
                        size = (z - 1) % PIECE + 1
                        s = scratch[:size]
                        np.exp(s, out=s)
                        p[z - size : z] *= s[lines[:size], place[z - size : z]] / (s @ ones)
            out[begin + order] = np.log10(p)
        return out


@lru_cache(1)
def _ready(shared) -> Scorer:
    s = shared.value.ready()
    s.rows = s.levels = None  # in the worker's copy the tables made from them take their place
    return s


def frequent(counts: DataFrame, most: int = OWN) -> tuple[list[bytes], list[int]]:
    """(tokens, counts): the end and at most ``most`` tokens seen twice or more.

    A histogram of counts on a log scale (a few hundred cells) gives the least count, so that only their rows are sent
    on and no task sorts the vocabulary.
    """
    cell = F.floor(F.log2(F.col("n").cast("double")) * 16)
    least, total = 1 << 30, 0
    for r in sorted(counts.where("n > 1").groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("size")).collect(), key=lambda r: -r["cell"]):
        total += r["size"]
        least = r["cell"] if total <= most else least
    found = counts.where(((cell >= least) & (F.col("n") > 1)) | (F.col("token") == F.lit(END))).toArrow()
    # by count, so that tokens looked up often lie side by side in a worker's memory
    got = sorted(zip(found["token"].to_pylist(), found["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    return [t for t, _ in got], [n for _, n in got]


def train(texts: DataFrame, most: int = OWN, share: int = SHARE) -> tuple[Scorer, DataFrame]:
    """(scorer, counts of tokens without a leaf of their own) learnt from every text of one string column; null counts as empty."""
    counts = cut(token_counts(texts))
    names, seen = frequent(counts, most)
    least = min((n for t, n in zip(names, seen, strict=True) if t != END), default=None)
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    others = counts.where(F.col("token") != F.lit(END))
    others = others if least is None else others.where(F.col("n") < least)
    tails = np.ones(class_number(sums["v"]))
    for row in others.groupBy(class_column("token", len(tails)).alias("g")).agg(F.sum(F.col("n") + 1).alias("n")).collect():
        tails[row["g"]] += row["n"]
    net = fit(texts, vocabulary(names, seen, tails), sums["n"], sums["v"], share)
    return Scorer(net, sums["n"], sums["v"]), others


def score(docs: DataFrame, scorer: Scorer, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) for every row of ``docs``; null text has the end as its only token.

    base_score is the add-one unigram log10 probability, score the model's. ``counts`` holds the tokens without a leaf
    of their own. Repeated rows and null ids stay rows of their own: a document's row is keyed by its task and place,
    which a task that runs again gives anew.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["key", "id", "token", "times", "n_tokens", "n_known", "base", "model"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def made(s: Scorer, texts: list) -> pa.RecordBatch:
        """Rows of some documents (key, id, words): one of sums and one for each token without a leaf of its own."""
        ids, at, nth, base, out, end = [], [], [], [], [[] for _ in names], 0
        for k, (key, i, words) in enumerate(texts):
            leaves, cold = s.leaves.padded(words)
            ids.append(leaves)
            at.append(np.arange(end + BACK, end + len(leaves)))
            nth.append(np.full(len(words), k))
            end += len(leaves)
            base.append(float(s.log_count[leaves[BACK:]].sum()))
            rare = Counter([words[x] for x in cold.tolist()])
            n = len(rare)
            row = ([key] * (n + 1), [i] * (n + 1), [HEAD + str(key).encode(), *rare], [0, *rare.values()], [len(words)] + [0] * n, [len(words) - len(cold)] + [0] * n, [base[-1]] + [0.0] * n, [k] + [-1] * n)
            for x, more in zip(out, row, strict=True):
                x += more
        ids, at = np.concatenate(ids), np.concatenate(at)
        model = np.bincount(np.concatenate(nth), s.log10(ids, at) - s.log_tail[ids[at]], len(texts))
        heads = np.array(out[-1])
        out[-1] = np.where(heads >= 0, model[heads], 0.0)
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names)

    def scan(batches):
        s, task, nth = _ready(shared), TaskContext.get().partitionId() << 40, 0
        held, size = [], 0
        for b in slices(batches):
            for i, t in zip(b.column(0).to_pylist(), byte_texts(b.column(1)), strict=True):
                held.append((task + nth, i, _tokens(t)))
                nth, size = nth + 1, size + len(held[-1][2])
                if size >= BLOCK:
                    yield made(s, held)
                    held, size = [], 0
        if held:
            yield made(s, held)

    schema = "key long, id long, token binary, times long, n_tokens long, n_known long, base double, model double"
    cold = rows.mapInArrow(scan, schema).join(counts.withColumnRenamed("n", "c"), "token", "left")
    log_c = F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)
    whole = cold.groupBy("key").agg(
        F.max("id").alias(id_col), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + log_c).alias("base"), F.sum(F.col("model") + log_c).alias("model"),
    )
    return whole.select(
        id_col, "n_tokens", "n_known",
        (F.col("base") - F.col("n_tokens") * float(np.log10(scorer.tokens + scorer.distinct + 1.0))).alias("base_score"),
        F.col("model").alias("score"),
    )


def score_documents(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", most: int = OWN, share: int = SHARE) -> DataFrame:
    """``score`` of all rows of ``docs`` by a model of those where ``training`` holds, with the training tokens' number."""
    scorer, counts = train(docs.where(training).select(F.col(text_col).cast("string")), most, share)
    return score(docs, scorer, counts, id_col, text_col).withColumn("train_tokens", F.lit(scorer.tokens).cast("long"))
