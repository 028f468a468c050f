"""SimHash near-dedup by anchor-point covering.

Anchors are the words of the binary Golay code on 23 fingerprint bits: a perfect code, so every fingerprint has
one home anchor within 3 bits. Fingerprints at most 3 bits apart agree on those 23 bits up to 3, hence each lies
within 3 + 3 bits of the other's home. A fingerprint is replicated to every anchor in that radius (about 71) and
homes are compared with replicas per anchor. Beyond ``ONE_BLOCK`` distinct fingerprints the anchors are the words
of the product of two such codes on 46 bits, where the bits beyond 3 in the two blocks may sum to 3; the links found
are the same. Copies of one fingerprint are a single fingerprint here, so groups of copies cost nothing. An anchor of
many fingerprints is cut in a grid of parts, ``HOMES`` homes by ``NEAR`` replicas, each a group of its own: every home
still meets every replica and is linked to it in that part, wherever the home's own replica lies, so the components of
all parts' links are those of the whole.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, cut, written
from .components import connected_components

SHINGLE = 3
THRESHOLD = 3
SEED = 42
#: Distinct fingerprints up to which 4096 anchors hold 4096 homes each at most on average.
ONE_BLOCK = 1 << 24
#: Homes and replicas that one group compares, about: a task's share of an anchor.
HOMES, NEAR = 1 << 14, 1 << 19
#: Fixed values of the Golay code: length, information bits, covering radius, generator polynomial.
LENGTH, INFO, RADIUS, GENERATOR = 23, 12, 3, 0xC75

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if set in over half the XXH64 hashes of the word shingles, repeats included; no word: 0."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    if n <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    count, total = np.zeros((8, 256), np.int64), n - shingle + 1
    for at in range(0, total, 1 << 16):
        stop = min(total, at + (1 << 16))
        pairs = zip(starts[at:stop].tolist(), ends[at + shingle - 1 : stop + shingle - 1].tolist(), strict=True)
        h = np.array(list(map(digest, [joined[a:b] for a, b in pairs], repeat(SEED))), np.uint64)
        count += np.bincount((h.view(np.uint8).reshape(-1, 8) + _LANES).ravel(), minlength=2048).reshape(8, 256)
    return int(np.packbits((count @ _BITS).ravel() * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): one row per document; fp is the fingerprint's 64 bits as a long. Null text counts as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def scan(batches):
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in byte_texts(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(scan, "id long, fp long")


@lru_cache(1)
def golay():
    """(syndromes of the low and high bits, error pattern by syndrome, anchors by weight class and cost).

    The last is, for each syndrome, its row in the table of its coset leader's weight; and for each weight and
    cost 0-3 (bits beyond the covering radius) the anchor offsets of all code words at that cost, one row a coset.
    """

    def rest(x):
        x = x.copy()
        for bit in range(LENGTH - 1, LENGTH - INFO - 1, -1):
            x ^= ((x >> bit) & 1) * (GENERATOR << (bit - (LENGTH - INFO)))
        return x

    low, high = rest(np.arange(1 << INFO)), rest(np.arange(1 << (LENGTH - INFO)) << INFO)
    one = 1 << np.arange(LENGTH)
    leaders = np.unique(np.concatenate([[0], one, (one[:, None] | one).ravel(), (one[:, None, None] | one[:, None] | one).ravel()]))
    error = np.zeros(1 << (LENGTH - INFO), np.int64)
    error[rest(leaders)] = leaders
    info = np.arange(1 << INFO) << (LENGTH - INFO)
    words = info | rest(info)
    weight = np.bitwise_count(error)
    place = np.zeros(len(error), np.int64)
    near = {}
    for w in range(RADIUS + 1):
        own = np.flatnonzero(weight == w)
        place[own] = np.arange(len(own))
        far = np.bitwise_count(error[own][:, None] ^ words[None, :])
        for cost in range(THRESHOLD + 1):
            hit = far <= RADIUS if cost == 0 else far == RADIUS + cost
            near[w, cost] = np.nonzero(hit)[1].reshape(len(own), -1)
    return low, high, error, weight, place, near


def _block(fps: np.ndarray, k: int):
    low, high, error, weight, place, _ = golay()
    x = ((fps >> np.uint64(LENGTH * k)) & np.uint64((1 << LENGTH) - 1)).astype(np.int64)
    s = low[x & ((1 << INFO) - 1)] ^ high[x >> INFO]
    return (x ^ error[s]) >> (LENGTH - INFO), weight[s], place[s]


def anchors(fps: np.ndarray, blocks: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home anchor of each, row of each replica, anchor of each replica)."""
    near = golay()[-1]
    parts = [_block(fps, k) for k in range(blocks)]
    home = parts[0][0] if blocks == 1 else parts[0][0] << INFO | parts[1][0]
    rows, to = [], []
    for w in np.ndindex(*[RADIUS + 1] * blocks):
        own = np.flatnonzero(np.all([p[1] == x for p, x in zip(parts, w, strict=True)], axis=0))
        if not len(own):
            continue
        for costs in np.ndindex(*[THRESHOLD + 1] * blocks):
            if sum(costs) > THRESHOLD:
                continue
            got = np.zeros((len(own), 1), np.int64)
            for p, x, c in zip(parts, w, costs, strict=True):
                at = p[0][own][:, None] ^ near[x, c][p[2][own]]
                got = ((got << INFO)[:, :, None] | at[:, None, :]).reshape(len(own), -1)
            rows.append(np.repeat(own, got.shape[1]))
            to.append(got.ravel())
    return home, np.concatenate(rows), np.concatenate(to)


def _runs(keys: np.ndarray):
    """(order that sorts the keys, distinct keys, bounds of each in that order)"""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)])) if len(keys) else np.zeros(1, int)
    return order, keys[cuts[:-1]], cuts


def replicas(distinct: DataFrame, blocks: int) -> DataFrame:
    """(anchor, homes, near): a row per anchor and batch, with its fingerprints as packed 8-byte words."""

    def scan(batches):
        for b in batches:
            for at in range(0, b.num_rows, 10_000):
                fps = b.column(0)[at : at + 10_000].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                home, row, to = anchors(fps, blocks)
                order, keys, cuts = _runs(to)
                blob = fps[row[order]]
                horder, hkeys, hcuts = _runs(home)
                homes = {int(k): fps[horder[a:z]].tobytes() for k, a, z in zip(hkeys, hcuts[:-1], hcuts[1:], strict=True)}
                for i in range(0, len(keys), 50_000):
                    k = keys[i : i + 50_000]
                    near = [blob[a:z].tobytes() for a, z in zip(cuts[i : i + len(k)], cuts[i + 1 : i + len(k) + 1], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array([homes.get(int(x), b"") for x in k], pa.binary()), pa.array(near, pa.binary())], ["anchor", "homes", "near"])

    return distinct.select("fp").mapInArrow(scan, "anchor long, homes binary, near binary")


def forest(homes: np.ndarray, near: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, root) that join what is linked between homes and replicas: one per linked replica, not one per pair.

    A home's own replica may be in another part of a grid, so homes are put among the replicas: a home joins all it meets.
    """
    near = np.unique(np.concatenate((homes, near)))
    label = np.arange(len(near))
    for h in homes:
        hit = np.flatnonzero(np.bitwise_count(near ^ h) <= threshold)
        if len(hit) > 1:
            seen = np.unique(label[hit])
            if len(seen) > 1:
                if len(seen) == len(hit) and np.array_equal(seen, hit):  # all still alone
                    label[hit] = seen[0]
                else:
                    label[np.isin(label, seen)] = seen[0]
    moved = np.flatnonzero(label != np.arange(len(near)))
    return near[moved], near[label[moved]]


def links(distinct: DataFrame, blocks: int) -> DataFrame:
    """(a, b): links whose components are those of all pairs at ``THRESHOLD`` bits or fewer."""

    def compare(key, tab):
        join = lambda c: np.frombuffer(b"".join(tab.column(c).to_pylist()), np.uint64)
        homes = join("homes")
        a, b = forest(homes, join("near")) if len(homes) else (homes, homes)
        return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return _grid(written(replicas(distinct, blocks), "replicas")).groupBy("anchor", "part").applyInArrow(compare, "a long, b long")


def _grid(found: DataFrame) -> DataFrame:
    """(anchor, part, homes, near): rows of an anchor dealt to a grid of parts, where each home meets each replica once.

    A row's homes go to one line of the grid, its replicas to one column; small anchors are a grid of one part.
    """
    size = lambda c, most: F.ceil(F.sum(F.octet_length(c)) / (8.0 * most)).cast("int")
    hot = found.groupBy("anchor").agg(F.greatest(size("homes", HOMES), F.lit(1)).alias("lines"), F.greatest(size("near", NEAR), F.lit(1)).alias("columns")).where("lines > 1 or columns > 1")
    rows = found.join(hot, "anchor", "left").fillna(1, ["lines", "columns"])
    mixed = F.xxhash64("homes", "near")
    rows = rows.withColumns({"line": F.pmod(mixed, F.col("lines")), "column": F.pmod(F.shiftright(mixed, 20), F.col("columns"))})
    dealt = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("lines") * F.col("columns") - 1)))
    here = {"homes": F.expr("part div columns") == F.col("line"), "near": F.col("part") % F.col("columns") == F.col("column")}
    none = F.lit(b"")
    return dealt.where(here["homes"] | here["near"]).select("anchor", "part", *[F.when(x, F.col(c)).otherwise(none).alias(c) for c, x in here.items()])


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id reachable), component_rows.

    Null text counts as empty; documents without a word share fingerprint zero and are linked like any others.
    Null ids belong to components but never name one (all ids null: component_id null). Repeated rows stay.
    """
    marked = cut(fingerprints(docs, id_col, text_col))
    distinct = cut(marked.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")))
    blocks = 1 if distinct.count() <= ONE_BLOCK else 2
    roots = connected_components(links(distinct, blocks), "a", "b")
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("component_rows"))
    classes = named.join(lowest, "root").select("fp", "component_id", "component_rows")
    return marked.join(classes, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_rows")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose id names its component.

    Ids are taken as unique: of rows that share one, all stay if any of them names a component. Rows with a null id stay
    only if some component holds null ids alone; they cannot be told apart by id. Null and empty texts share fingerprint
    zero, so one of them stays.
    """
    stay = simhash_groups(docs, id_col, text_col).where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("__stay")).distinct()
    return docs.join(stay, docs[id_col].eqNullSafe(stay["__stay"]), "left_semi")
