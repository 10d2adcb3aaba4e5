import pytest
from pyspark.sql import functions as F

from stratalog.functions import headers
from stratalog.plans.catalogue import _PEOPLE


@pytest.mark.parametrize("case", _PEOPLE, ids=[p[0] for p in _PEOPLE])
def test_author(case):
    _, header, name, email, epoch, error = case
    if error:
        with pytest.raises(headers.HeaderError) as e:
            headers.parse_author(header.encode())
        assert e.value.kind == error
    else:
        assert headers.parse_author(header.encode()) == (name, email, epoch)


def test_author_column(spark):
    df = spark.createDataFrame([(n, h) for n, h, *_ in _PEOPLE], "n string, h string").select("n", headers.author(F.col("h")).alias("a"))
    got = {r.n: tuple(r.a) for r in df.collect()}
    assert got == {n: (a, e, t, x) for n, _, a, e, t, x in _PEOPLE}


H = "0123456789abcdef0123456789abcdef01234567"


def test_commit():
    data = f"tree {H}\nparent {H}\nparent {H[::-1]}\nauthor A <a@b> 1 +0000\ncommitter C D <c@d> 77 +0100\n\nparent no\n".encode()
    assert headers.parse_commit(headers.commit_header(data)) == (H, [H, H[::-1]], 77)


@pytest.mark.parametrize("data,kind", [(f"committer A <a@b> 1 +0000", "no-tree"), (f"tree {H}", "no-committer"), ("tree xyz\n", "bad-hash"), (f"tree {H}\ncommitter A <a@b> now +0000", "bad-timestamp")])
def test_bad_commits(data, kind):
    with pytest.raises(headers.HeaderError) as e:
        headers.parse_commit(data.encode())
    assert e.value.kind == kind


def test_long_header():
    with pytest.raises(headers.HeaderError):
        headers.commit_header(b"tree " + b"x" * 5000 + b"\ncommitter A <a@b> 1 +0000\n")


def test_tags():
    assert headers.tag_target(f"object {H}\ntype commit\ntag v1\n\nx".encode()) == H
    assert headers.tag_target(f"object {H}\ntype tree\n".encode()) is None
    assert headers.tag_target(b"tag v1\n") is None
    assert headers.hash_token(f" {H.upper()} refs/heads/x".encode()) == H and headers.hash_token(b"short") is None
