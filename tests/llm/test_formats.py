import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import queries, sentencepieces, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
SMALL = "/root/testdata/sf0.001"


def test_pieces_equal_the_library(spark):
    rnd = random.Random(1)
    parts = ["the", "and", "ing", " ", "  ", "\n", "\t", "▁", "é", "日本", "😀", "<s>", "0x41", "a" * 70, "\u0000", "Straße", " "]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 50)))) for i in range(300)] + [(300, None), (301, ""), (None, "a"), (5, "x"), (302, "word " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepieces.load(path).vocabulary.library
    want = sorted((str(i), sp.encode(t or ""), sp.decode(sp.encode(t or ""))) for i, t in rows)
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in sentencepieces.sentencepieces(docs, path).collect()) == want
    digests = {str(r.doc_id): r for r in sentencepieces.sentencepiece_digests(docs.where("doc_id <> 5"), path).collect()}
    for i, ids, text in want:
        if i in digests:
            assert (digests[i].n_tokens, digests[i].ids_sha256, digests[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    v = sentencepieces.load(path).vocabulary
    assert all(v.decode(ids) == text for _, ids, text in want)
    assert sentencepieces.sentencepieces(docs.limit(0), path).count() == 0


def test_warc_round_trip(spark):
    big = "<p>ü</p>" * 200
    rows = [(1, "http://a/", big), (2, "http://b/ü ", big), (9, None, big), (3, "http://c/", "small"), (4, "http://c/", "small"), (5, "x", None), (6, "y", ""), (None, "z", big), (7, "u", "WARC/1.1\r\n\r\n" * 100), (9, "again", big), (8, "long", "<p>long</p>" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("id", "kind", "sha", "top")})
    got = sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload) if r.payload is not None else None) for r in warc.round_trip(pages, payloads=True).collect()), key=str)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        again = h == big and i != 9
        want.append((str(i), len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", 9 if again else None, None if again else p))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_reader_refuses_damage():
    one, two = warc.record("response", "1", "http://a/", b"x" * 3000), warc.record("revisit", "2", "http://b/", b"y" * 3000, "1")
    got = [warc.parse(m) for m in warc.members(io.BytesIO(one + two), 7)]
    assert [(g["record_type"], g["page_id"], g["refers_to"], g["payload_bytes"]) for g in got] == [("response", "1", None, 3000), ("revisit", "2", "1", 3000)]
    assert gzip.decompress(one).startswith(b"WARC/1.1\r\n")
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(one[:-9])))
    plain = gzip.decompress(one)
    for damaged in (plain.replace(b"xxxx", b"xxxz", 1), plain[:-1], plain.replace(b"Content-Length: 30", b"Content-Length: 31", 1), b"no record"):
        with pytest.raises(ValueError):
            warc.parse(damaged)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names, before = docs.columns, docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, SMALL).cache()
        if k < 4:
            assert after.columns == names
        if k < 3:
            assert after.count() < before.count() or k
            assert after.select("doc_id").subtract(before.select("doc_id")).count() == 0
        if k == 1:
            assert after.count() == before.select("text").distinct().count()
        before = after if k < 4 else before
    assert after.count() == before.count()


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline_stages_take_nulls_and_empty_tables(spark):
    names = ["doc_id", "text", "lang", "source", "n_chars", "kept", "row"]
    rows = [(1, "a b c d e", "en", "s", 9, 1, 1), (2, "a b c d e", None, None, None, None, None), (None, None, None, None, None, None, None), (None, None, None, None, None, None, None), (3, "", "en", "s", 0, 1, 1), (4, "x " * 500, "en", "t", 1000, 1, 1), (4, "x " * 500, "en", "t", 1000, 1, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept int, row int"
    docs, one = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs, one = stage(spark, docs, SMALL), stage(spark, one, SMALL)
        assert one.count() == 0
        if k < 4:
            assert docs.columns == names
        if k == 1:
            assert sorted(str(r.doc_id) for r in docs.collect()) == ["2", "3", "4"]
    assert docs.count() >= 1
