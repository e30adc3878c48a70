"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import periodic_runs as R
from millrace.llm import queries as Q

from .helpers import SCHEMA, clash, odd, prose


def runs_plainly(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        same = [words[t] == words[t + q] for t in range(n - q)] + [False]
        begin = None
        for t, x in enumerate(same):
            if x and begin is None:
                begin = t
            elif not x and begin is not None:
                if t - begin >= q and t + q - begin >= least:
                    found.setdefault((begin, t + q), q)
                begin = None
    return sorted((b, e - b, q) for (b, e), q in found.items())


def runs_of(words, least=12, sizes=(10**9,)):
    catchers, at, k = R.Catchers(least), 0, 0
    while at < len(words):
        size = sizes[k % len(sizes)]
        catchers.append(np.array(words[at : at + size], np.int64))
        at, k = at + size, k + 1
    return catchers.finish()


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def shapes():
    rng = random.Random(5)
    yield [], []
    yield [0] * 11, [0] * 12
    yield [0] * 700, [0, 1] * 300
    yield fibonacci(900), [bin(k).count("1") % 2 for k in range(800)]  # many runs; no cubes
    for n, letters in ((60, 2), (200, 2), (400, 3), (300, 40)):
        for _ in range(6):
            yield [rng.randrange(letters) for _ in range(n)], [rng.randrange(letters) for _ in range(n)]
    for _ in range(12):  # repeated stretches inside other words, nested
        words = [rng.randrange(50) for _ in range(rng.randrange(200))]
        for _ in range(4):
            unit = [rng.randrange(3) for _ in range(rng.randrange(1, 40))]
            words += unit * rng.randrange(2, 7) + unit[: rng.randrange(len(unit))] + [rng.randrange(50) for _ in range(rng.randrange(5))]
        yield words, words * 2


@pytest.mark.parametrize("least", [2, 3, 5, 12, 13, 40])
def test_runs_equal_a_plain_search(least):
    for pair in shapes():
        for words in pair:
            assert runs_of(words, least) == runs_plainly(words, least)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.integers(2, 20), st.integers(1, 9))
def test_pieces_change_no_run(words, least, size):
    words = words + words[: len(words) // 2] + words
    assert runs_of(words, least, (size, 1, 3)) == runs_plainly(words, least)


def test_words_come_one_by_one():
    for words, twice in list(shapes())[:14]:
        assert runs_of(words, 12, (1,)) == runs_plainly(words) and runs_of(twice, 12, (7, 100)) == runs_plainly(twice)


def test_long_texts_in_many_pieces(monkeypatch):
    rng = random.Random(3)
    unit = [rng.randrange(9) for _ in range(7_001)]
    words = [9] + unit * 3 + [10] * 40_000 + [rng.randrange(2) for _ in range(3_000)]
    whole = runs_of(words)
    assert (1, 21_003, 7_001) in whole and (21_004, 40_000, 1) in whole
    monkeypatch.setattr(R, "PIECE", 1_000)
    assert runs_of(words) == whole


def test_every_period_has_a_size():
    for least in (2, 7, 12, 50, 101):
        for q in range(1, 3_000):
            sizes = [1 << k for k in range(14) for lo, hi in R.shifts(1 << k, least) if lo <= q <= hi]
            assert len(sizes) == 1 and 2 * sizes[0] - 1 <= max(q, least - q)


def told_plainly(rows):
    out = []
    for i, text in rows:
        words = [w for w in (text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
        h, n = zlib.crc32(str(i).encode()) if i is not None else 1, len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = runs_plainly(words)
        lost = {k for s, size, q in runs for k in range(s + q, s + size)}
        best = min(((-size, s, q) for s, size, q in runs), default=None)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        first = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        out.append((i, len(runs), *first, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in lost))))
    return sorted(out, key=repr)


def test_query_equals_a_plain_search(spark, tmp_path):
    line = "one two three four five six seven\n"
    rows = [(1000 + k, prose(60 + k, k)) for k in range(80)] + [(k, line * k) for k in range(20, 27)] + [(30, "a\x0bb\x1cc\xa0d " * 9), (31, "a " * 500)]
    rows += [(7, None), (8, ""), (9, " \t\r\n"), (None, line * 3), (30, "again " * 20), (30, "again " * 20)]
    clash(spark.createDataFrame(rows, SCHEMA), "n_runs", "runs", "start").write.parquet(str(tmp_path / "documents.parquet"))
    out = Q.QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in out.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert sorted(map(tuple, out.collect()), key=repr) == told_plainly(rows)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5


def test_spans_and_odd_documents(spark):
    out = R.find_runs(clash(odd(spark), "runs", "collapsed"))
    assert out.columns == ["doc_id", "text", "other", "n_words", "runs", "collapsed"]
    assert out.count() == odd(spark).count() and out.filter("runs is null or collapsed is null").isEmpty()
    said = R.find_runs(spark.createDataFrame([(1, "x " + "a b c " * 5 + "d")], SCHEMA)).first()
    assert [tuple(r) for r in said.runs] == [(1, 15, 3)] and said.collapsed == "x a b c d" and said.n_words == 17
    assert R.find_runs(odd(spark).limit(0)).count() == 0
