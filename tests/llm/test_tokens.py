"""Token counts, token shards, and the pipeline."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard

from stratalog.llm import tokenbin, tokencount
from stratalog.llm.common import words

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def enc():
    return tokencount.encoder(tokencount.VOCABULARY)


ODD = ["", " ", "  ", "a  b", "a\n \nb", " x", "x ", "a \n b", "\tq  \t r", "é à  b", "a　b c\n\n d", "x\n\n y  ", "-", "the the", "don't  I'm", "日本語 テスト", "🙂 🙂", "1 22 333", "\r\n a", "a  b", " a"]


def strange(r):
    return "".join(r.choice(["a", "the", " ", " ", "  ", "\n", "\t", "é", "9", "!", "'s", "日", " ", " "]) for _ in range(r.randrange(14)))


def test_counts_and_ids_equal_the_full_encoder(enc):
    r = random.Random(1)
    texts = ODD + [strange(r) for _ in range(3000)]
    full = [enc.full.encode_ordinary(t) for t in texts]
    assert enc.counts(pa.array(texts)).tolist() == [len(x) for x in full]
    assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(pa.array(texts))] == full
    other = tokencount.Encoder(tokencount.VOCABULARY, pattern=r"\s+|\S+")
    assert other.counts(pa.array(texts[:50])).tolist() == [len(other.full.encode_ordinary(t)) for t in texts[:50]]


def test_proof(enc):
    """Proven strings encode alone as their one token; those not proven would not, or aren't one pre-token."""
    r = random.Random(2)
    for s in r.sample(sorted(enc.whole), 400):
        assert enc.full.encode_ordinary(s) == [enc.ranks[s.encode()]]
    assert tokencount.merge(b"the", {b"th": 0, b"the": 1}) == [b"the"] and tokencount.merge(b"the", {b"he": 0, b"the": 1}) == [b"the"]
    assert tokencount.prove_whole({b"t": 0, b"h": 1, b"e": 2, b"the": 3, b"th": 4, b"a b": 5}) == {"t", "h", "e", "the", "th"}
    assert tokencount.prove_whole({b"a": 0, b"b": 1, b"ab": 2, b"abab": 3, b"c": 4, b"bab": 5, b"aba": 6}) >= {"a", "ab", "abab"}
    assert "abc" not in tokencount.prove_whole({b"a": 0, b"b": 1, b"c": 2, b"abc": 3})
    for s in ("hello", "dogé", "zzxq"):
        assert len(tokencount.merge(s.encode(), enc.ranks)) == len(enc.full.encode_ordinary(s))


ROWS = [(1, None), (2, ""), (3, "the cat  sat"), (None, "dog"), (3, "the cat  sat"), (4, "word " * 60000), (5, "\n\n")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id long, text string, n_tokens string, data int").repartition(2)


def test_count_frame(spark, enc):
    got = sorted(((x.doc_id, x.n_tokens) for x in tokencount.token_counts(frame(spark)).collect()), key=repr)
    assert got == sorted(((i, None if t is None else len(enc.full.encode_ordinary(t))) for i, t in ROWS), key=repr)
    assert tokencount.token_counts(frame(spark).limit(0)).count() == 0
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    text = {x.doc_id: x.text for x in docs.collect()}
    assert all(x.n_tokens == len(enc.full.encode_ordinary(text[x.doc_id])) for x in tokencount.token_counts(docs).collect())


def unpack(shards):
    out = []
    for s in shards:
        r = tokenbin.reader(bytes(s.data))
        assert len(r) == len(s.doc_ids) == len(s.n_tokens)
        for k in random.Random(3).sample(range(len(r)), len(r)):
            ids = np.frombuffer(r.frame(k), f"<u{s.token_bytes}").tolist()
            assert len(ids) == s.n_tokens[k]
            out.append((s.doc_ids[k], ids))
    return sorted(out)


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_round_trip(spark, enc, size):
    want = sorted((i, enc.full.encode_ordinary(t)) for i, t in ROWS if i is not None and t is not None)
    assert unpack(tokenbin.token_shards(frame(spark), shard_bytes=size).collect()) == want
    assert tokenbin.token_shards(frame(spark).limit(0)).count() == 0


def test_documents_round_trip_and_files(spark, enc, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    shards = tokenbin.token_shards(docs, shard_bytes=5000)
    want = sorted((x.doc_id, enc.full.encode_ordinary(x.text)) for x in docs.collect())
    assert unpack(shards.collect()) == want
    for _ in range(2):  # a second time changes nothing
        files = tokenbin.save_shards(shards, f"file://{tmp_path}/out").collect()
    assert sorted(f.file for f in files) == sorted(p.name for p in (tmp_path / "out").iterdir())
    asked = []
    one = files[0]
    raw = (tmp_path / "out" / one.file).read_bytes()

    def fetch(at, n):
        asked.append(n)
        return raw[at : at + n]

    r = tokenbin.Reader(fetch, len(raw))
    asked.clear()
    k = len(r) // 2
    assert np.frombuffer(r.frame(k), "<u2").tolist() == dict(want)[one.doc_ids[k]]
    assert asked == [int(r.packed[k])]
    # any zstandard reader sees the frames in a row and skips the table
    with zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True) as f:
        assert f.read() == b"".join(r.frame(k) for k in range(len(r)))


def test_damage_is_seen():
    z = zstandard.ZstdCompressor(level=1)
    data = b"abcd" * 50
    packed = z.compress(data)
    good = packed + tokenbin.seek_table([(len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF)])
    assert tokenbin.reader(good).frame(0) == data
    wrong = packed + tokenbin.seek_table([(len(packed), len(data), 1)])
    with pytest.raises(ValueError, match="damaged"):
        tokenbin.reader(wrong).frame(0)
    for bad in (good[:-1] + b"\0", packed + b"x" * 40):
        with pytest.raises(ValueError):
            tokenbin.reader(bad)


def test_pipeline_stage_by_stage(spark, enc):
    import corpus_pipeline as p

    docs, at = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "/root/testdata/sf0.01"
    kept = [docs]
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, kept[-1], at).cache()
        assert out.columns == docs.columns
        kept.append(out)
    ids = [{x.doc_id for x in k.select("doc_id").collect()} for k in kept]
    assert len(ids[1]) >= 0.99 * len(ids[0]) and ids[1] > ids[2] > ids[3] >= ids[4]
    assert len(ids[4]) <= kept[4].count()
    text = {x.doc_id: x.text for x in docs.collect()}
    own = {i: set(words(text[i])) for i in ids[2]}
    seen = {}
    for i in ids[2]:  # no two with the same words are left
        assert seen.setdefault(frozenset(own[i]), i) == i or not own[i]
    bench = [x.text for x in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    assert not [i for i in ids[3] if any(b in text[i] for b in bench)]
    gone = ids[2] - ids[3]
    assert gone and sum(any(b in text[i] for b in bench) for i in gone) >= 0.9 * len(gone)
    last = p.STAGES[-1][1](spark, kept[-1], at)
    want = sorted((x.doc_id, enc.full.encode_ordinary(x.text)) for x in kept[-1].collect())
    assert unpack(last.collect()) == want
    assert unpack(p.run(spark, at).collect()) == want


def test_pipeline_of_nothing_and_of_odd_rows(spark):
    import corpus_pipeline as p

    encoder = tokencount.encoder(tokencount.VOCABULARY)

    schema = "doc_id long, text string, lang string, source string, n_chars long, keep int"
    for rows in ([], [(1, None, None, None, None, 1), (None, None, "en", "a", 0, 2), (2, "", "en", None, 0, 3), (3, "the and of", "en", "a", 10, None), (3, "the and of", "en", "a", 10, None), (4, "der die und", "de", "b", 11, 0), (None, "the of", "en", "a", 6, 1)]):
        df = spark.createDataFrame(rows, schema)
        for _, stage in p.STAGES[:-1]:
            df = stage(spark, df, DATA)
            assert df.columns == [c.split()[0] for c in schema.split(", ")]
        want = sorted((x.doc_id, encoder.full.encode_ordinary(x.text)) for x in df.collect() if x.doc_id is not None and x.text is not None)
        assert unpack(p.STAGES[-1][1](spark, df, DATA).collect()) == want and bool(want) == bool(rows)
