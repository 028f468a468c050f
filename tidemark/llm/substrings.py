"""Substring dedup by level-wise doubling: 25 words, then 50.

Level 1 counts the windows of half the length, at every word of every text, by 64-bit hashes. Tasks hold the distinct
hashes of their documents, two of one hash that several of them share, and send them packed, sorted by hash and cut in
as many buckets as the input's size asks for; a bucket gives the hashes found twice, however common they are. Every full
window of a document has an aligned half window in it (one that starts at a multiple of its length), so a document asks
for its aligned half windows only, by a join that may be split. Those that repeat are extended: a window of twice the
length goes on to level 2 if all aligned half windows in it are repeated. Documents without one are finished where they
are read; a bitmap of ids of bounded size tells them apart, and where it is too full more documents go on than need to.

Level 2 compares *runs* of surviving windows first: a run is the stretch of words under neighbouring full windows whose
half window of lowest hash, the mark, is the same, so that runs don't depend on where a passage lies. A run found in a
smaller document is repeated whole; where the documents of a mark differ in their runs, full windows are sent one by
one. A common passage therefore costs one row per document and mark. Doubling stops at the window length: longer
repeats are covered by their windows.

Windows of level 2 are compared by two independent 64-bit polynomial hashes of 64-bit word hashes.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, input_bytes, slices, written

WINDOW = 50
MEMO = 200_000
#: Half windows that a task sorts at once (some 60 bytes each while it does); bytes of input a bucket; least and most bits of a bucket's number.
SORTED = 1_000_000
BUCKET_BYTES, BUCKET_BITS = 4 << 20, (8, 20)
#: Bits of the bitmap of ids, at most (16 MB).
ID_BITS = 27
#: Odd multipliers of the two polynomials (fixed values) and of the mixing step.
BASES = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
MIX = np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


@lru_cache(1)
def _memo() -> _Words:
    return _Words()


@lru_cache(4)
def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(BASES[which])
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(size, base, np.uint64)) * np.uint64(inverse)
        down = np.cumprod(np.full(size, inverse, np.uint64)) * np.uint64(base)
    return up, down


class Hashes:
    """Hashes of every stretch of words of one document, from prefix sums modulo 2^64."""

    def __init__(self, words: list[bytes]):
        self.n = n = len(words)
        w = np.fromiter(map(_memo().__getitem__, words), np.uint64, n)
        size = 1 << max(12, int(n).bit_length())
        self.parts = []
        with np.errstate(over="ignore"):
            for k in (0, 1):
                up, down = _powers(k, size)
                x = w if k == 0 else (w ^ (w >> np.uint64(29))) * MIX
                self.parts.append((np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * up[:n], dtype=np.uint64))), down))

    def of(self, which: int, start: np.ndarray, length) -> np.ndarray:
        sums, down = self.parts[which]
        with np.errstate(over="ignore"):
            x = (sums[start + length] - sums[start]) * down[start]
            x = (x ^ (x >> np.uint64(31))) * MIX
        return x ^ (x >> np.uint64(29))


def _lowest(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    out, have = a, 1
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    step = width - have
    return np.minimum(out[: len(out) - step], out[step:]) if step else out


def runs(h: Hashes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mark, first window, last window) of each run: neighbouring full windows with one mark."""
    half = window // 2
    marks = _lowest(h.of(0, np.arange(h.n - half + 1), half), window - half + 1)
    first = np.concatenate(([0], np.flatnonzero(marks[1:] != marks[:-1]) + 1))
    return marks[first], first, np.concatenate((first[1:], [len(marks)])) - 1


def _run_keys(h: Hashes, first, last, window) -> np.ndarray:
    length = last - first + window
    with np.errstate(over="ignore"):
        return (h.of(1, first, length) ^ length.astype(np.uint64)) * MIX


def _halves(window: int, bits: int):
    """(bucket, low): distinct hashes of half windows of a batch of documents, packed as their low 32 bits by bucket."""
    half = window // 2

    def packed(parts):
        docs = np.repeat(np.array([i for _, i in parts], np.int64), [len(x) for x, _ in parts])
        hashes = np.concatenate([x for x, _ in parts])
        parts.clear()
        order = np.argsort(hashes)
        hashes, docs = hashes[order], docs[order]
        del order
        first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        several = np.minimum.reduceat(docs, first) < np.maximum.reduceat(docs, first)
        del docs
        kept = np.repeat(hashes[first], 1 + several)
        del hashes, first, several
        bucket = (kept >> np.uint64(64 - bits)).astype(np.int64)
        low = ((kept >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket))
        starts = np.concatenate(([0], ends[:-1]))
        blobs = [low[f:z].tobytes() for f, z in zip(starts.tolist(), ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(blobs, pa.binary())], ["bucket", "low"])

    def scan(batches):
        parts, size = [], 0
        for b in slices(batches):
            for i, t in zip(b.column(0).to_pylist(), byte_texts(b.column(1)), strict=True):
                words = t.split()
                if i is None or len(words) < window:
                    continue
                parts.append((Hashes(words).of(0, np.arange(len(words) - half + 1), half), i))
                size += len(words)
                if size >= SORTED:
                    yield packed(parts)
                    parts, size = [], 0
        if parts:
            yield packed(parts)

    return scan


def _twice(bits: int):
    """(half): the hashes, cut to the bits that were sent, that a bucket holds twice or more."""

    def find(key, tab):
        low = np.sort(np.frombuffer(b"".join(tab.column("low").to_pylist()), np.uint32))
        again = np.unique(low[1:][low[1:] == low[:-1]]).astype(np.int64)
        return pa.table([pa.array(again | (key[0].as_py() << 32))], names=["half"])

    return find


def _aligned(window: int, bits: int):
    """(half, id, block): the aligned half windows of each document."""
    half = window // 2

    def scan(batches):
        for b in slices(batches, 5_000):
            hashes, ids, blocks, size = [], [], [], 0
            for i, t in zip(b.column(0).to_pylist(), byte_texts(b.column(1)), strict=True):
                words = t.split()
                if i is None or len(words) < window:
                    continue
                at = np.arange(0, len(words) - half + 1, half)
                hashes.append(Hashes(words).of(0, at, half) >> np.uint64(32 - bits))
                ids.append(np.full(len(at), i, np.int64))
                blocks.append(at // half)
                size += len(at)
                if size >= 100_000:
                    yield made(hashes, ids, blocks)
                    hashes, ids, blocks, size = [], [], [], 0
            if hashes:
                yield made(hashes, ids, blocks)

    def made(hashes, ids, blocks):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(blocks).astype(np.int32))], ["half", "id", "block"])

    return scan


def _bit(ids: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = ids.view(np.uint64) * MIX
    return ((x ^ (x >> np.uint64(31))) * BASES[0] >> np.uint64(64 - bits)).astype(np.int64)


def id_bitmap(ids: DataFrame, count: int) -> tuple[int, np.ndarray]:
    """(bits, bitmap) of the ids' hashes: sixteen bits an id, up to 2^``ID_BITS`` in all."""
    bits = min(ID_BITS, max(16, (16 * count).bit_length()))

    def scan(batches):
        for b in slices(batches, 2_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_bit(b.column(0).to_numpy(zero_copy_only=False), bits)))], ["bit"])

    def chunk(key, tab):
        marks = np.zeros(1 << 16, np.uint8)
        marks[tab.column("bit").to_numpy() & 0xFFFF] = 1
        return pa.table([pa.array([key[0].as_py()]), pa.array([np.packbits(marks).tobytes()], pa.binary())], names=["chunk", "marks"])

    found = ids.mapInArrow(scan, "bit long").distinct().groupBy(F.shiftright("bit", 16).alias("chunk")).applyInArrow(chunk, "chunk long, marks binary").toArrow()
    marks = np.zeros((1 << bits) // 8, np.uint8)
    for c, m in zip(found["chunk"].to_pylist(), found["marks"].to_pylist(), strict=True):
        marks[c << 13 : (c + 1) << 13] = np.frombuffer(m, np.uint8)
    return bits, marks


def _finish_clean(shared, bits: int, finish):
    """Documents whose id's bit isn't set, finished; the others with their text."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["id", "n_words", "n_removed", "kept", "text"]

    def scan(batches):
        marks = shared.value
        for part in slices(batches):
            ids = part.column(0).to_pylist()
            bit = _bit(np.array([i or 0 for i in ids], np.int64), bits)
            on = (marks[bit >> 3] >> (7 - (bit & 7)) & 1).tolist()
            out = []
            for i, t, o in zip(ids, byte_texts(part.column(1)), on, strict=True):
                if o and i is not None:
                    out.append((i, None, None, None, t))
                else:
                    words = t.split()
                    out.append((i, len(words), 0, finish(b" ".join(words)), None))
            arrays = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            arrays[4] = arrays[4].cast(pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names)

    return scan


def _survivors(blocks, windows: int, window: int) -> np.ndarray:
    """By full window: whether all aligned half windows in it are among ``blocks``."""
    half = window // 2
    alive = np.zeros(max(windows // half + 3, max(blocks) + 1), bool)  # blocks of other rows of this id may lie beyond
    alive[list(blocks)] = True
    at = np.arange(windows)
    first = -(-at // half)
    return alive[first] & (alive[first + 1] | (at + window < (first + 2) * half))


def _scan_runs(window: int):
    """(mark, run, id) of every distinct run of each document that holds a surviving window."""

    def scan(batches):
        for b in slices(batches, 2_000):
            parts, size = [], 0
            for i, t, blocks in zip(b.column("id").to_pylist(), byte_texts(b.column("text")), b.column("blocks").to_pylist(), strict=True):
                words = t.split()
                if not blocks or len(words) < window:
                    continue
                h = Hashes(words)
                alive = np.concatenate(([0], np.cumsum(_survivors(blocks, len(words) - window + 1, window))))
                mark, first, last = runs(h, window)
                on = alive[last + 1] > alive[first]
                both = np.unique(np.stack([mark[on], _run_keys(h, first[on], last[on], window)], 1), axis=0)
                parts.append((both, np.full(len(both), i, np.int64)))
                size += len(both)
                if size > 50_000:
                    yield _run_batch(parts)
                    parts, size = [], 0
            if parts:
                yield _run_batch(parts)

    return scan


def _run_batch(parts) -> pa.RecordBatch:
    both = np.concatenate([x for x, _ in parts]).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])), pa.array(np.concatenate([i for _, i in parts]))], ["mark", "run", "id"])


def _remove(words: list[bytes], starts: np.ndarray, window: int) -> tuple[int, bytes]:
    """(words covered by windows at ``starts``, the others joined by a space)"""
    if not len(starts):
        return 0, b" ".join(words)
    edge = np.bincount(starts, minlength=len(words) + 1) - np.bincount(np.minimum(starts + window, len(words)), minlength=len(words) + 1)
    gone = np.cumsum(edge[:-1]) > 0
    return int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


#: What a decided document returns, by name: the kept text itself, or its SHA-256.
FINISH = {"text": lambda kept: kept.decode("utf-8", "replace"), "sha": lambda kept: hashlib.sha256(kept).hexdigest()}
_OPEN = "id long, n_words long, n_removed long, kept string, text string, sure array<int>, starts array<int>, mark array<long>, win array<long>"


def _judge(window: int, finish):
    """Decided documents with their kept words; others with text, surely repeated windows and the windows to compare."""
    empty = np.zeros(0, np.int32)
    kinds = [pa.int64()] * 3 + [pa.string(), pa.binary(), *[pa.list_(pa.int32())] * 2, *[pa.list_(pa.int64())] * 2]
    names = [x.split()[0] for x in _OPEN.split(", ")]

    def document(i, t, hits):
        words = t.split()
        sure = empty
        if hits and len(words) >= window:
            h = Hashes(words)
            mark, first, last = runs(h, window)
            known = {(x["mark"], x["run"]): x["whole"] for x in hits}
            state = [known.get(k) for k in zip(mark.view(np.int64).tolist(), _run_keys(h, first, last, window).view(np.int64).tolist(), strict=True)]
            spread = {flag: np.concatenate([np.arange(f, z + 1) for f, z, s in zip(first, last, state, strict=True) if s is flag] or [empty]).astype(np.int64) for flag in (True, False)}
            sure, starts = spread[True], spread[False]
            if len(starts):
                marks = np.repeat(mark, last - first + 1)[starts]
                return i, len(words), None, None, t, sure, starts, marks.view(np.int64), h.of(1, starts, window).view(np.int64)
        n, kept = _remove(words, sure, window)
        return i, len(words), n, finish(kept), None, None, None, None, None

    def scan(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                got = [document(*x) for x in zip(part.column("id").to_pylist(), byte_texts(part.column("text")), part.column("hits").to_pylist(), strict=True)]
                arrays = [pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds)]
                arrays[4] = arrays[4].cast(pa.string())
                yield pa.RecordBatch.from_arrays(arrays, names)

    return scan


def _settle(window: int, finish):
    def document(i, n, t, sure, starts, marks, wins, hits):
        words = t.split()
        known = {(x["mark"], x["win"]) for x in hits or ()}
        more = [s for s, m, w in zip(starts, marks, wins, strict=True) if (m, w) in known]
        gone, kept = _remove(words, np.array(sure + more, np.int64), window)
        return i, n, gone, finish(kept)

    def scan(batches):
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                cols = [byte_texts(part.column(c)) if c == "text" else part.column(c).to_pylist() for c in ("id", "n_words", "text", "sure", "starts", "mark", "win", "hits")]
                got = [document(*x) for x in zip(*cols, strict=True)]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds)], ["id", "n_words", "n_removed", "kept"])

    return scan


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, output: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept (the words left, joined by a space; ``output="sha"``: their SHA-256).

    A word goes if a window of ``window`` words over it also starts in a document with a smaller id; windows are judged
    on the input. Null text has no words. Rows with a null id are neither compared nor changed. Rows that share an id are
    one document: they never repeat each other, but each loses what a smaller id holds.
    """
    if window < 4:
        raise ValueError("window must be 4 words or more")
    finish = FINISH[output]
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    low, high = BUCKET_BITS
    bits = min(high, max(low, (input_bytes(docs) // BUCKET_BYTES).bit_length()))
    # level 1: half windows in two documents, asked for by aligned half windows; both are tables, so that the join may split
    again = written(texts.mapInArrow(_halves(window, bits), "bucket long, low binary").groupBy("bucket").applyInArrow(_twice(bits), "half long"), "halves")
    asked = written(texts.mapInArrow(_aligned(window, bits), "half long, id long, block int"), "aligned")
    alive = written(asked.join(again, "half", "left_semi").groupBy("id").agg(F.collect_set("block").alias("blocks")), "alive")
    bits, marks = id_bitmap(alive.select("id"), alive.count())
    read = written(texts.mapInArrow(_finish_clean(spark.sparkContext.broadcast(marks), bits, finish), "id long, n_words long, n_removed long, kept string, text string"), "read")
    clean = read.where("kept is not null").drop("text")
    opened = written(read.where("kept is null").join(alive, "id", "left").select("id", "text", "blocks"), "opened")
    # level 2
    live = written(opened.mapInArrow(_scan_runs(window), "mark long, run long, id long"), "live-runs")
    by_run = live.groupBy("mark", "run").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    several = written(by_run.groupBy("mark").agg(F.count(F.lit(1)).alias("runs")).where("runs > 1"), "several-runs")
    by_run = by_run.join(several, "mark", "left").select("mark", "run", "low", "high", F.coalesce("runs", F.lit(1)).alias("runs")).where("high > low or runs > 1").drop("high")
    hits = live.join(by_run, ["mark", "run"]).where("id > low or runs > 1").select("id", F.struct("mark", "run", (F.col("id") > F.col("low")).alias("whole")).alias("hit"))
    hits = hits.groupBy("id").agg(F.collect_list("hit").alias("hits"))
    judged = written(opened.join(hits, "id", "left").select("id", "text", "hits").mapInArrow(_judge(window, finish), _OPEN), "judged")
    unsettled = judged.where("kept is null")
    wins = unsettled.select("id", F.explode(F.arrays_zip("mark", "win")).alias("w")).select("id", "w.mark", "w.win").distinct()
    seen = wins.groupBy("mark", "win").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("high > low").drop("high")
    again = wins.join(seen, ["mark", "win"]).where("id > low").groupBy("id").agg(F.collect_list(F.struct("mark", "win")).alias("hits"))
    settled = unsettled.drop("n_removed", "kept").join(again, "id", "left").select("id", "n_words", "text", "sure", "starts", "mark", "win", "hits")
    settled = settled.mapInArrow(_settle(window, finish), "id long, n_words long, n_removed long, kept string")
    return clean.unionByName(judged.where("kept is not null").select("id", "n_words", "n_removed", "kept")).unionByName(settled).withColumnRenamed("id", id_col)


def repeats_sql(window: int = WINDOW) -> str:
    """DuckDB SQL of ``remove_repeats`` over ``documents`` with the SHA-256 of the kept words; ids are taken as unique."""
    return rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    k AS (SELECT doc_id, i, md5(array_to_string(words[i:i + {window - 1}], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - {window - 2})) AS i FROM d WHERE len(words) >= {window})),
    r AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS low FROM k) WHERE low < doc_id),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS i FROM r),
    w AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT d.doc_id, len(words)::bigint AS n_words, (len(words) - coalesce(n, 0))::bigint AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""
