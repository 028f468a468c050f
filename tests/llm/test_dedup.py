import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import exact, simhash, substrings
from tidemark.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    return df.withColumns({c: F.lit(9) for c in ("kept", "fp", "id", "sha", "n")}) if extra else df


def corpus(seed=3, n=120):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 300))) for _ in range(n)]
    passage = " ".join(rnd.choice(words) for _ in range(90))
    rows = []
    for i in range(n):
        t = base[i]
        if i % 7 == 1:
            t = base[i - 1]
        elif i % 7 == 2:
            w = base[i - 1].split()
            w[len(w) // 2 : len(w) // 2 + 1] = ["changed"]
            t = " ".join(w)
        elif i % 5 == 0:
            t = f"{t[: len(t) // 2]} {passage} {t[len(t) // 2 :]}"
        rows.append((i, t))
    return rows + [(200, None), (201, ""), (202, " \n"), (203, "ONE two"), (204, "one\x85two"), (205, "same " * 130), (206, "same " * 90), (3, rows[3][1]), (7, "other text under a used id"), (None, rows[9][1]), (None, "alone")]


def bits(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def test_golay_is_perfect():
    low, high, error, weight, place, near = simhash.golay()
    assert sorted(set(weight.tolist())) == [0, 1, 2, 3] and len(set(error.tolist())) == 2048
    assert [near[3, c].shape[1] for c in range(2)] == [1, 5]


def test_half_windows_are_sorted_in_little_memory():
    import tracemalloc

    import pyarrow as pa

    rows = pa.table({"id": list(range(220)), "text": [" ".join(f"w{(k * (7 + i)) % 9973}" for k in range(10_000)) for i in range(220)]}).to_batches()
    tracemalloc.start()
    sizes = [b.num_rows for b in substrings._halves(50, 8)(rows)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) > 256 and peak < 100e6  # of 2.2 million half windows


@pytest.mark.parametrize(("one_block", "most"), [(1 << 24, 1 << 19), (0, 1 << 19), (1 << 24, 2)])
def test_simhash_matches_all_pairs(spark, monkeypatch, one_block, most):
    monkeypatch.setattr(simhash, "ONE_BLOCK", one_block)
    monkeypatch.setattr(simhash, "HOMES", min(most, simhash.HOMES))
    monkeypatch.setattr(simhash, "NEAR", most)
    rows = [*corpus(), (401, " ".join(f"w{(k * k) % 4001}" for k in range(30_000)))]
    fps = [bits(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    want = sorted((str(i), f"{f:016x}", str(low.get(find(k)))) for k, ((i, _), f) in enumerate(zip(rows, fps, strict=True)))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.simhash_groups(frame(spark, rows, True)).collect())
    assert got == want


@pytest.mark.parametrize("one_block", [1 << 24, 0])
def test_simhash_grid_keeps_every_link(spark, monkeypatch, one_block):
    """Pairs 3 bits apart, alone in their anchor's part but for each other: a grid deals their ends to different columns."""
    monkeypatch.setattr(simhash, "HOMES", 2)
    monkeypatch.setattr(simhash, "NEAR", 4)
    rnd = random.Random(5)
    # one anchor for all, as they differ in the bits that no block reads
    base = [rnd.getrandbits(16) << 47 for _ in range(60)]
    fps = sorted({f for x in base for f in (x, x ^ 1 ^ 1 << rnd.randrange(1, 46) ^ 1 << 46)})
    distinct = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(7)
    root = dict(connected_components(simhash.links(distinct, 1 if one_block else 2), "a", "b").collect())
    name = lambda f: root.get(f, f)
    want = {f: f for f in fps}
    for _ in fps:
        near = {f: min(want[g] for g in fps if (f ^ g).bit_count() <= 3) for f in fps}
        if near == want:
            break
        want = near
    assert {f: name(f) for f in fps} == want


def test_simhash_empty(spark):
    assert simhash.simhash_groups(frame(spark, [])).count() == 0
    assert simhash.drop_near_copies(frame(spark, [(2, "a b c d"), (1, "a b c d"), (3, None)])).orderBy("doc_id").select("doc_id").collect() == [(1,), (3,)]


def test_components_chain_and_hub(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(5, 5), (None, 3), (-4, 39)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {k: 100 for k in range(101, 161)} | {k: -4 for k in range(1, 40)}


def test_exact_matches_brute_force(spark):
    rows = corpus()
    keep, size = {}, {}
    for i, t in rows:
        t = t or ""
        size[t] = size.get(t, 0) + 1
        if i is not None:
            keep[t] = max(i, keep.get(t, i))
    want = sorted((str(i), str(keep.get(t or "")), size[t or ""], i == keep.get(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact.exact_dedup(frame(spark, rows, True)).collect())
    assert got == want
    kept = exact.drop_copies(frame(spark, rows, True))
    assert kept.columns == frame(spark, [], True).columns
    assert sorted((r.text or "") for r in kept.collect()) == sorted(size)
    assert exact.exact_dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize("window", [50, 8])
def test_substrings_match_brute_force(spark, window):
    long = " ".join(f"w{(k * k) % 4001}" for k in range(30_000))
    rows = [*corpus(), (301, long), (302, "other start " + long)]
    first = {}
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    grams = lambda w: (b" ".join(w[p : p + window]) for p in range(len(w) - window + 1))
    for i, w in docs:
        if i is not None:
            for g in grams(w):
                first[g] = min(i, first.get(g, i))
    want = []
    for i, w in docs:
        gone = set()
        for p, g in enumerate(grams(w)):
            if i is not None and first[g] < i:
                gone |= set(range(p, p + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
        want.append((str(i), len(w), len(gone), kept))
    got = [(str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(frame(spark, rows, True), window=window).collect()]
    assert sorted(got) == sorted(want)
    assert sum(x[2] for x in want) > 100


def test_substrings_empty(spark):
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


def test_substrings_half_windows_and_bitmap(spark, monkeypatch):
    # a full window survives if every aligned half window in it does
    got = substrings._survivors([1, 2, 7], 12, 8).tolist()
    assert got == [all(k in (1, 2, 7) for k in range(5) if p <= 4 * k and 4 * k + 4 <= p + 8) for p in range(12)]
    ids = [-5, 0, 3, 10**15]
    bits, marks = substrings.id_bitmap(spark.createDataFrame([(i,) for i in ids], "id long"), len(ids))
    on = lambda i: marks[(b := int(substrings._bit(substrings.np.array([i], "int64"), bits)[0])) >> 3] >> (7 - (b & 7)) & 1
    assert all(on(i) for i in ids) and sum(on(i) for i in range(100, 1100)) < 10
    # a bitmap without a free bit sends every document on, with the same result
    rows = corpus(n=40)
    want = sorted((r.doc_id is None, r.doc_id, r.n_removed, r.kept) for r in substrings.remove_repeats(frame(spark, rows), window=8).collect())
    monkeypatch.setattr(substrings, "id_bitmap", lambda ids, n: (16, substrings.np.full(1 << 13, 255, "uint8")))
    assert want == sorted((r.doc_id is None, r.doc_id, r.n_removed, r.kept) for r in substrings.remove_repeats(frame(spark, rows), window=8).collect())
