"""Lempel-Ziv fingerprints against a plain parse, plain sets and a plain order."""

import hashlib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from millrace.llm import lz_fingerprint as L
from millrace.llm import queries as Q

from .helpers import ODD, SCHEMA, clash, odd, prose


def phrases_plainly(text):
    seen, at = set(), 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in seen:
            end += 1
        if end > len(text):
            break
        seen.add(text[at:end])
        at = end
    return seen


def fold(phrase):
    node = 0
    for c in phrase:
        node = (node * L.FACTOR + ord(c) + 1) % 2**64
    node ^= node >> 31
    node = node * 0xBF58476D1CE4E5B9 % 2**64
    return node ^ node >> 29


def signature_plainly(text):
    return sorted({fold(p) for p in phrases_plainly(text)})[: L.SIZE]


def likeness_plainly(a, b):
    low = sorted(set(a) | set(b))[: L.SIZE]
    return sum(x in a and x in b for x in low) / len(low) if low else 1.0


def hexed(signature):
    return "".join(f"{x:016x}" for x in signature)


def texts():
    return ["", "a", "aaaa", "a" * 5_000, "abcabcabc" * 40, prose(300, 1), prose(3_000, 2), "中文😀é" * 30, "\x00\x00\x01"]


def test_signatures_equal_a_plain_parse():
    for t in texts():
        assert L.signature(t).tolist() == signature_plainly(t)
        for after in texts():
            parsed, k = L.Parsed(t), len(t) // 4
            for _ in range(2):  # an edit leaves the parsed text as it was
                edited, signature = parsed.edited(after)
                assert edited == t[: len(t) - k] + after[:k] and signature.tolist() == signature_plainly(edited)
            assert parsed.signature.tolist() == signature_plainly(t)
            assert L.likeness(L.signature(t), L.signature(after)) == likeness_plainly(signature_plainly(t), signature_plainly(after))


def rows_plainly(rows, hashes):
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashes[r[1]]))
    out = []
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1] or ""
        t = t or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        old, new, following = map(signature_plainly, (t, edited, after))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), hexed(old), hexed(new), likeness_plainly(old, new), likeness_plainly(old, following)))
    return sorted(out, key=repr)


def some_rows():
    rng = random.Random(4)
    rows = [*ODD, (20, None), (21, "x"), (22, "no"), (21, "y"), (21, "y"), (None, None), (None, "z"), (-5, "first " * 30)]
    rows += [(100 + k, prose(rng.randrange(1, 200), k % 30)) for k in range(90)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("range_bytes", [1 << 20, 4_000, 300])
def test_query_equals_a_plain_order(spark, tmp_path, monkeypatch, range_bytes):
    rows = some_rows()
    docs = clash(spark.createDataFrame(rows, SCHEMA), "none", "id", "hash", "part", "fingerprint").repartition(7)
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(L.beside_next, "__defaults__", ("doc_id", "text", range_bytes))
    out = Q.QUERIES["op12_lz_fingerprint"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(map(tuple, out.collect()), key=repr) == rows_plainly(rows, hashes)


def test_one_document_follows_itself_and_none_gives_none(spark):
    one = L.beside_next(spark.createDataFrame([(1, "abcd")], SCHEMA)).first()
    assert (one.edited, one.near_next) == ("abca", 1.0)
    assert L.beside_next(odd(spark).limit(0)).count() == 0


def test_ids_of_text(spark):
    docs = spark.createDataFrame([("b", "two"), ("é", "four"), ("a", "one"), ("c", "three"), (None, "last")], "k string, t string")
    out = {r.k: r.edited for r in L.beside_next(docs, "k", "t", 1).collect()}
    assert out == {"a": "one", "b": "two", "c": "thref", "é": "foul", None: "laso"}


def test_fingerprint_column_and_likeness_column(spark):
    rows = [(k, t) for k, t in enumerate([*texts(), None])]
    docs = L.fingerprint(clash(spark.createDataFrame(rows, SCHEMA), "fingerprint"), keep=["doc_id", "fingerprint"])
    assert {r.doc_id: r.fingerprint for r in docs.collect()} == {k: hexed(signature_plainly(t or "")) for k, t in rows}
    pairs = docs.alias("a").join(docs.alias("b"), F.col("a.doc_id") <= F.col("b.doc_id"))
    for r in pairs.select(F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y"), L.alike(F.col("a.fingerprint"), F.col("b.fingerprint")).alias("s")).collect():
        a, b = (signature_plainly(rows[k][1] or "") for k in (r.x, r.y))
        assert abs(r.s - likeness_plainly(a, b)) < 1e-12


def test_edited_texts_are_nearer_than_the_next(spark):
    rows = [(k, prose(400, 500 + k)) for k in range(60)]
    out = L.beside_next(spark.createDataFrame(rows, SCHEMA)).collect()
    assert min(r.near_edited for r in out) > max(r.near_next for r in out)
    exact = [len(phrases_plainly(t) & phrases_plainly(r.edited)) / len(phrases_plainly(t) | phrases_plainly(r.edited)) for r in out for t in [rows[r.doc_id][1]]]
    assert statistics.mean(abs(r.near_edited - x) for r, x in zip(out, exact, strict=True)) < 0.05
