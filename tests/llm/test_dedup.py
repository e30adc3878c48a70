"""Line dedup, near-dedup, decontamination."""

import itertools
import os
import random
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest

from millrace.llm import decontaminate, line_dedup, order_minhash

from .helpers import ODD, SCHEMA, clash, odd, prose

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
LINE = "This line is shared by many documents, more than forty characters"


# Lines.


def lines_plainly(rows, min_chars=40, min_docs=5):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                held[key(line)].add(i)
    common = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or key(x) not in common or i >= common[key(x)]]
        out[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    return out


def line_rows():
    shared = [(100 + k, f"own {k}\n  {LINE.upper()}\t\n{LINE}\nend") for k in range(6)]
    four = [(200 + k, prose(20, 1) + f"\nown line {k}") for k in range(4)]
    repeated = [(300, prose(21, 2))] * 9 + [(301 + k, prose(21, 2)) for k in range(3)]  # four ids only
    only = [(400 + k, LINE[::-1]) for k in range(7)]
    return [*ODD, *shared, *four, *repeated, *only, (None, LINE), (500, "É" * 39 + "\n" + "é" * 40)]


@pytest.mark.parametrize("batches,fanout", [(1, 2), (7, 2), (4, 3)])
def test_lines(spark, batches, fanout):
    rows = line_rows()
    random.Random(1).shuffle(rows)
    docs = clash(spark.createDataFrame(rows, SCHEMA), "n_lines", "h1", "doc")
    out = line_dedup.dedup_lines(docs, batches=batches, fanout=fanout)
    assert out.columns == ["doc_id", "text", "h1", "doc", "other", "n_lines", "n_dropped"]
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()) == lines_plainly(rows)
    assert out.filter("doc_id = 1").first().text is None  # null stays null


def test_runs_are_disjoint_and_levelled(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for k in range(5):
        runs.add(line_dedup.batch_run(spark.createDataFrame([(h, h, d) for h in range(k, k + 10) for d in (k, 10 + k)], "h1 long, h2 long, doc long")))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    held = [r.h1 for level in runs.levels for name in level for r in spark.table(name).collect()]
    assert len(held) == len(set(held)) == 14
    assert {(r.h1, r.n_docs, r.max_doc) for r in runs.counted().collect()} == {(h, 2 * len(k := [k for k in range(5) if k <= h < k + 10]), 10 + max(k)) for h in range(14)}
    runs.drop()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(runs.name)]


def test_runs_are_joined_without_a_shuffle(spark):
    runs = line_dedup.LineRuns(spark, fanout=4)
    for k in range(2):
        runs.add(line_dedup.batch_run(spark.createDataFrame([(h, h, k) for h in range(100)], "h1 long, h2 long, doc long")))
    a, b = (spark.table(n) for n in (*runs.levels[0],))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for joined in (a.join(b.select("h1", "h2"), ["h1", "h2"], "left_anti"), runs._merged([*runs.levels[0]])):
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        runs.drop()


def test_one_text_of_very_many_lines(spark):
    many = "\n".join([LINE] * 20_000 + [f"a line of its own, of more than forty characters, number {k}" for k in range(20_000)])
    rows = [(1, many), (1, "another text of the same id\n" + LINE), *[(10 + k, LINE) for k in range(5)], (None, many)]
    out = {(r.doc_id, r.n_lines, r.n_dropped, len(r.text or "")) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {(i, n, d, len(t)) for i, n, d, t in lines_plainly(rows)}


def test_lines_of_an_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_buckets_follow_the_number_of_lines(spark):
    """More lines, more buckets: always whole buckets for a task, so that no run needs a shuffle beyond its counting."""
    count = line_dedup.bucket_count
    assert [count(spark, n, 1000) for n in (0, 4000, 4001, 1_000_000)] == [4, 4, 8, 1000]
    assert count(spark, 10**18, 1) == 100_000  # Spark's own limit
    runs = line_dedup.LineRuns(spark, n_lines=60, bucket_lines=5)
    assert runs.buckets == 12
    for k in range(3):
        runs.add(line_dedup.batch_run(spark.createDataFrame([(h * 7, h, k) for h in range(20 * k, 20 * k + 40)], "h1 long, h2 long, doc long")))
    left = [name for level in [*runs.levels, *runs.again] for name in level]
    for name in left:  # each bucket in one file
        files = [f.rsplit("_", 1)[1].split(".")[0] for f in spark.table(name).inputFiles()]
        assert len(files) == len(set(files)) and len(files) <= 12
    assert "Exchange" not in runs._merged(left[:2])._jdf.queryExecution().executedPlan().toString()
    assert {(r.h2, r.n_docs, r.max_doc) for r in runs.counted().collect()} == {
        (h, sum(20 * k <= h < 20 * k + 40 for k in range(3)), max(k for k in range(3) if 20 * k <= h < 20 * k + 40)) for h in range(80)
    }
    runs.drop()


@pytest.mark.parametrize("bucket_lines", [3, 10])
def test_line_dedup_with_many_buckets(spark, bucket_lines):
    rows = line_rows()
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA), batches=3, fanout=2, bucket_lines=bucket_lines)
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()) == lines_plainly(rows)


def test_line_dedup_runs_no_python(spark):
    plan = line_dedup.dedup_lines(spark.createDataFrame(line_rows(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Near copies.


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment_equals_the_full_table():
    rng = random.Random(3)
    for _ in range(1500):
        letters = rng.choice([2, 3, 6])
        a = [rng.randrange(letters) for _ in range(rng.randrange(14))]
        b = a[:] if rng.random() < 0.6 else [rng.randrange(letters) for _ in range(rng.randrange(14))]
        for _ in range(rng.randrange(4)):
            if b and rng.random() < 0.5:
                b.pop(rng.randrange(len(b)))
            else:
                b.insert(rng.randrange(len(b) + 1), rng.randrange(letters))
        most, d = rng.randrange(12), distance(a, b)
        assert order_minhash.banded_distance(np.array(a, np.int64), np.array(b, np.int64), most) == (d if d <= most else None)


def test_sketches_know_the_order_of_words():
    s = order_minhash.Sketcher()
    a, b = s.words(prose(200, 1)), s.words(prose(200, 2))
    share = lambda x, y: (s.sketch(x)[1] == s.sketch(y)[1]).mean()  # noqa: E731  (sketches of one k-mer know no order)
    assert share(np.r_[a, b], np.r_[a, b]) == 1 and share(a, b) == 0
    assert 0 < share(np.r_[a, b], np.r_[b, a]) < 0.85  # nearly the same shingles, other order
    assert len(set(s.labelled(np.zeros(12, np.uint64), 5).tolist())) == 8  # equal k-mers are told apart


def edited(text, rng, share=0.05):
    words = text.split()
    for _ in range(int(len(words) * share)):
        words[rng.randrange(len(words))] = "edit" + str(rng.randrange(10**6))
    return " ".join(words)


def near_rows():
    rng, rows = random.Random(5), []
    for g in range(6):
        base = prose(60 + 40 * g, 100 + g)
        rows += [(1000 * g + k, t) for k, t in enumerate([base, base, *[edited(base, rng) for _ in range(5)]])]
    passage = prose(40, 999)  # shared by many texts that are not alike
    rows += [(9000 + k, f"{passage} {prose(60, 2000 + k)}") for k in range(40)]
    rows += [(9500, "two words"), (9501, "Two, words!"), (9502, "two"), (9503, "Chapter"), (9400, prose(300, 50)), (9401, edited(prose(300, 50), rng, 0.5))]
    return rows


def classes_plainly(rows):
    s = order_minhash.Sketcher()
    words = [s.words(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(range(len(rows)), 2):
        small, large = sorted((len(words[x]), len(words[y])))
        if small and small >= 0.8 * large and order_minhash.similarity(words[x], words[y]) is not None:
            a, b = find(x), find(y)
            root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for x in range(len(rows)):
        groups[find(x)].append(rows[x][0])
    return sorted(sorted(g, key=str) for g in groups.values())


def test_classes_equal_brute_force(spark):
    rows = near_rows()
    random.Random(2).shuffle(rows)
    out = order_minhash.classify(clash(spark.createDataFrame(rows, SCHEMA), "hid", "id", "k0", "n_words")).collect()
    groups = defaultdict(list)
    for r in out:
        groups[r.class_id].append(r.doc_id)
    assert sorted(sorted(g, key=str) for g in groups.values()) == classes_plainly(rows)
    assert all(min(g) == c for c, g in groups.items())


@pytest.mark.parametrize("n", [5, 6, 8, 10, 15, 20, 40, 60, 100, 300])
def test_candidates_meet(n):
    """Of random edits at a similarity of 0.8 or a little more, nine in ten share a sketch of the first size."""
    rng, sketch = np.random.default_rng(n), order_minhash.Sketcher.sketch
    for share in (0.2, 0.15, 0.1):
        shared = 0
        for _ in range(200):
            a = rng.integers(0, 2**62, n).astype(np.uint64)
            b = a.copy()
            b[rng.choice(n, int(share * n + 1e-9), replace=False)] = rng.integers(0, 2**62, int(share * n + 1e-9)).astype(np.uint64)
            shared += bool(np.isin(sketch(a)[0], sketch(b)[0]).any())
        assert shared >= 180, (share, shared)


@pytest.mark.parametrize("n,again", [(8, 1), (30, 2), (60, 6), (300, 6), (1000, 6)])
def test_windows_repeated_on_one_side_only(n, again):
    """A text against the same with its first words once more at the end: nearly all sketches are those of common windows."""
    s, met, tries = order_minhash.Sketcher(), 0, 40
    for seed in range(tries):
        words = prose(n, 900 + seed).split()
        a, b = (s.sketch(s.words(" ".join(w))) for w in (words, words + words[:again]))
        met += len(np.intersect1d(a[0], b[0])) > 0
    assert met >= 0.95 * tries


def test_lengths_that_allow_the_similarity_share_a_scheme():
    fits = lambda n: {s.k for s in order_minhash.SCHEMES if s.least <= n <= s.most}
    assert all(fits(m) & fits(n) for n in range(1, 200) for m in range(1, n + 1) if m >= 0.8 * n)


def test_recall_in_a_crowd(spark):
    """Pairs at every similarity from 0.8, chains of edits, and a passage that all share: links against all pairs."""
    rng, rows = random.Random(31), []
    for k in range(120):
        base = prose([6, 12, 30, 60, 120, 250][k % 6], 40_000 + k)
        rows += [(10 * k, base), (10 * k + 1, edited(base, rng, [0.19, 0.15, 0.1, 0.05][k % 4]))]
    text = prose(150, 41_000)
    for k in range(40):  # each is like its neighbours only
        rows.append((5000 + k, text))
        text = edited(text, rng, 0.08)
    passage = prose(60, 42_000)
    for k in range(60):  # one in three has a near copy, all share a passage
        base = f"{passage} {prose(90, 43_000 + k)}"
        rows += [(6000 + 10 * k, base)] + ([(6001 + 10 * k, edited(base, rng, 0.12))] if k % 3 == 0 else [])
    want = [g for g in classes_plainly(rows) if len(g) > 1]
    out = {r.doc_id: r for r in order_minhash.classify(spark.createDataFrame(rows, SCHEMA)).collect()}
    for lo, hi in ((0, 5000), (5000, 6000), (6000, 9000)):
        pairs = [(x, y) for g in want for x, y in itertools.pairwise(g) if lo <= x < hi]
        found = sum(out[x].class_id == out[y].class_id for x, y in pairs)
        assert found >= 0.9 * len(pairs), (lo, found, len(pairs))
    assert all((r.n_links > 0) == any(r.doc_id in g for g in want) or r.n_links == 0 for r in out.values())
    whole = {i: min(g) for g in classes_plainly(rows) for i in g}
    assert all(whole[r.doc_id] == whole[r.class_id] for r in out.values())  # nothing is linked that should not be


def one_bucket(sizes, seed):
    """Texts of random words as :func:`order_minhash.near_links` takes them, all in one bucket and alone in all finer
    ones; for each size a text and an edit of it, four words in five alike. The rows, and the words of each text."""
    rng, rows, words = np.random.default_rng(seed), [], {}
    for n in sizes:
        base = rng.integers(0, 2**32, n, dtype=np.uint32)
        other = base.copy()
        other[rng.choice(n, n // 5, replace=False)] = rng.integers(0, 2**32, n // 5, dtype=np.uint32)
        for w in (base, other):
            k = len(rows)
            hid = rng.bytes(16)
            rows.append((k, hid, len(w), w.astype("<u4").tobytes(), [7], [8 + 10 * k], [9 + 10 * k], [10 + 10 * k]))
            words[hid] = w
    return rows, words


@pytest.mark.parametrize("tile", [5, 16_384])
def test_no_pair_of_a_bucket_is_lost(spark, tile):
    """Pairs that neither of the bucket's centres is like, and that share no finer sketch."""
    rows, words = one_bucket([40, 45, 50, 55, 60, 64, 80, 100, 125, 300, 1000] * 2, 5)
    df = spark.createDataFrame(rows, "id long, hid binary, n_words int, words binary, k0 array<long>, k1 array<long>, k2 array<long>, k3 array<long>")
    links, parts = order_minhash.near_links(df, tile=tile)
    want = {tuple(sorted(p)) for p in itertools.combinations(words, 2) if order_minhash.similarity(words[p[0]], words[p[1]]) is not None}
    assert len(want) == 22 and {(bytes(r.a), bytes(r.c)) for r in links.collect()} == want
    assert {(bytes(r.a), bytes(r.c)) for r in parts.collect()} == {(c, a) for a, c in want}


def test_shared_bins_drop_no_similar_pair():
    rng, texts = np.random.default_rng(8), []
    for n in [5, 6, 8, 10, 30, 31, 40, 100, 300, 301, 2000]:
        for words in (2, 50, 2**32):  # over 255 words in a bin, too
            base = rng.integers(0, words, n, dtype=np.uint32)
            texts += [base, base[: n - n // 5], np.r_[base[n // 10 :], rng.integers(0, 2**32, n // 10, dtype=np.uint32)]]
    n, label, all_of = np.array(list(map(len, texts))), np.arange(len(texts)) // 2, np.arange(len(texts))
    bins, beyond = zip(*map(order_minhash.tally, texts), strict=True)
    bins = np.frombuffer(b"".join(bins), np.uint8).reshape(-1, order_minhash.BINS)
    assert max(beyond) > 0
    similar = {(i, j) for i, j in itertools.permutations(range(len(texts)), 2) if label[i] != label[j] and order_minhash.similarity(texts[i], texts[j]) is not None}
    found = set(zip(*(x.tolist() for x in order_minhash.can_be_similar(n, label, bins, np.array(beyond), all_of, all_of, 0.8)), strict=True))
    assert similar and similar <= found and len(found) < 3 * len(similar)
    few = set(zip(*(x.tolist() for x in order_minhash.can_be_similar(n, label, bins, np.array(beyond), all_of[:9], all_of[9:], 0.8)), strict=True))
    assert few == {(i, j) for i, j in found if i < 9 <= j}


def test_links_of_a_bucket_join_its_similar_texts():
    """Links alone make the components of all similar pairs, one link fewer than texts for each; pairs of texts that
    share words, but in another order, are not aligned."""
    rng, words = np.random.default_rng(12), []
    for n in (5, 20, 60, 200, 700):
        base = rng.integers(0, 40, n, dtype=np.uint32)
        for _ in range(12):
            other = base.copy()
            other[rng.choice(n, n // 10, replace=False)] = rng.integers(0, 40, n // 10, dtype=np.uint32)
            words += [other, rng.permutation(base)]
    n, label, all_of = np.array(list(map(len, words))), np.arange(len(words)), np.arange(len(words))
    components = lambda pairs: {frozenset(c) for c in connected(pairs, len(words))}
    similar = [(i, j) for i, j in itertools.combinations(range(len(words)), 2) if order_minhash.similarity(words[i], words[j]) is not None]
    links = list(order_minhash.links_of(n, label, words, lambda x, y: True, all_of, all_of, 0.8))
    assert all(order_minhash.similarity(words[i], words[j]) == s for i, j, s in links)
    assert components([x[:2] for x in links]) == components(similar)
    assert len(similar) > 5 * len(links) and len(links) == len(words) - len(components(similar))
    assert not list(order_minhash.links_of(n, label, words, lambda x, y: False, all_of, all_of, 0.8))
    left, right = all_of[::2], all_of[1::2]
    across = {(i, j) for i, j in similar if (i - j) % 2} | {(j, i) for i, j in similar if (i - j) % 2}
    assert {x[:2] for x in order_minhash.links_of(n, label, words, lambda x, y: True, left, right, 0.8)} <= across


def connected(pairs, n):
    """Connected components of 0 to n - 1."""
    root = list(range(n))
    for i, j in pairs:
        a, b = root[i], root[j]
        root = [a if r == b else r for r in root]
    return [[k for k in range(n) if root[k] == r] for r in set(root)]


@pytest.mark.parametrize("tile", [7, 16_384])
def test_a_bucket_gives_no_more_links_than_members(spark, tile):
    """Near copies that no centre is like: one class, not a link for each two of them."""
    rng, rows = np.random.default_rng(7), []
    base = rng.integers(0, 2**32, 200, dtype=np.uint32)
    for k in range(62):
        other = base.copy()
        other[rng.choice(200, 8, replace=False)] = rng.integers(0, 2**32, 8, dtype=np.uint32)
        hid = bytes([k]) + rng.bytes(15)
        if k in (0, 61):  # the centres
            other = rng.integers(0, 2**32, 200, dtype=np.uint32)
        rows.append((k, hid, 200, other.tobytes(), [7], [8 + 10 * k], [9 + 10 * k], [10 + 10 * k]))
    df = spark.createDataFrame(rows, "id long, hid binary, n_words int, words binary, k0 array<long>, k1 array<long>, k2 array<long>, k3 array<long>")
    links, parts = order_minhash.near_links(df, tile=tile)
    assert {(bytes(r.a), bytes(r.c)) for r in parts.collect()} == {(r[1], rows[1][1]) for r in rows[2:61]}
    tiles = -(-62 // tile)
    assert 59 <= links.count() <= 62 * tiles


def test_one_document_of_each_class_stays(spark):
    rows = near_rows()
    docs = clash(spark.createDataFrame(rows, SCHEMA), "class_id", "words")
    kept = order_minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [min(g) for g in sorted(classes_plainly(rows))]


def test_near_odd_documents(spark):
    out = order_minhash.classify(odd(spark)).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in ODD)
    assert all(r.class_id == r.doc_id for r in out)
    kept = Counter(r.doc_id for r in order_minhash.keep_one(odd(spark)).collect())
    assert kept == Counter({i for i, _ in ODD})  # the repeated row is one document
    assert order_minhash.classify(spark.createDataFrame([], SCHEMA)).collect() == []
    assert order_minhash.keep_one(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_ids_and_one_id_for_two_texts(spark):
    base, rng = prose(200, 8), random.Random(1)
    rows = [(None, base), (None, base), (None, edited(base, rng)), (7, prose(100, 9)), (7, edited(prose(100, 9), rng, 0.04)), (None, ""), (None, None)]
    assert Counter(r.doc_id for r in order_minhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()) == Counter({None: 3, 7: 1})


def test_components(spark):
    chain = [(bytes([k]), bytes([k + 1])) for k in range(40)] + [(b"x", b"y"), (b"z", b"y")]
    out = order_minhash.stars(spark.createDataFrame(chain, "a binary, c binary"))
    roots = {bytes(r.a): bytes(r.c) for r in out.collect()}
    assert {roots[bytes([k])] for k in range(1, 41)} == {bytes([0])} and roots[b"y"] == roots[b"z"] == b"x"
    with pytest.raises(RuntimeError):
        order_minhash.stars(spark.createDataFrame(chain, "a binary, c binary"), rounds=1)


def seen(monkeypatch):
    """What :func:`order_minhash.written` is called for, and the rows of the tables named ``tiles``."""
    names, tiles, write = [], [], order_minhash.written

    def noted(df, what, *more):
        out = write(df, what, *more)
        names.append(what)
        tiles.extend(out.collect() if what == "tiles" else [])
        return out

    monkeypatch.setattr(order_minhash, "written", noted)
    return names, tiles


def test_components_take_no_needless_steps(spark, monkeypatch):
    names, _ = seen(monkeypatch)
    out = order_minhash.stars(spark.createDataFrame([(b"m", b"a"), (b"n", b"a"), (b"x", b"b"), (b"x", b"b")], "a binary, c binary"))
    assert sorted((bytes(r.a), bytes(r.c)) for r in out.collect()) == [(b"m", b"a"), (b"n", b"a"), (b"x", b"b")]
    assert names == ["stars", "low"]
    assert order_minhash.stars(spark.createDataFrame([], "a binary, c binary")).collect() == []


def test_links_added_to_components(spark):
    """As if the components of all links were found anew."""
    rng = random.Random(3)
    some, more = ([(bytes([rng.randrange(200)]), bytes([rng.randrange(200)])) for _ in range(n)] for n in (90, 25))
    frame = lambda pairs: spark.createDataFrame(pairs, "a binary, c binary")
    out = order_minhash.joined(order_minhash.stars(frame(some)), frame(more))
    want = {(bytes([k]), bytes([min(c)])) for c in connected([(x[0], y[0]) for x, y in some + more], 200) for k in c if k != min(c)}
    assert out.columns == ["a", "c"] and sorted((bytes(r.a), bytes(r.c)) for r in out.collect()) == sorted(want)


def test_near_copies_just_below_the_similarity_are_dealt_to_more_tasks(spark, monkeypatch):
    """A bucket of few classes is cut into tiles by its words, with the same classes; one of many classes is not."""
    rng, rows = np.random.default_rng(17), []
    for key, often in ((7, 20), (8, 1)):
        for k in range(6 * 20 // often):
            base = rng.integers(0, 2**32, 100, dtype=np.uint32)
            for _ in range(often):
                other = base.copy()
                other[rng.choice(100, 4, replace=False)] = rng.integers(0, 2**32, 4, dtype=np.uint32)
                hid, at = rng.bytes(16), len(rows)
                rows.append((at, hid, 100, other.tobytes(), [key, 1000 + 100 * key + k], [10_000 + 10 * at] * 2, [10_001 + 10 * at] * 2, [10_002 + 10 * at] * 2))
    df = spark.createDataFrame(rows, "id long, hid binary, n_words int, words binary, k0 array<long>, k1 array<long>, k2 array<long>, k3 array<long>")
    _, tiles = seen(monkeypatch)
    parts = []
    for words in (1 << 18, 1000):
        monkeypatch.setattr(order_minhash, "SPREAD_WORDS", words)
        parts.append({(bytes(r.a), bytes(r.c)) for r in order_minhash.near_links(df)[1].collect()})
    assert parts[0] == parts[1] and len(parts[0]) == 6 * 19
    assert sorted(tuple(r) for r in tiles) == [(7, 1), (7, 4), (8, 1), (8, 1)]


# Benchmark items.

ITEMS = [(i, prose(n, 700 + i) + ".\nThe answer is " + prose(6, 800 + i)) for i, n in enumerate([12, 30, 50, 90, 200])] + [(10, "two words"), (11, ""), (12, None), (13, "!!")]


def leak_rows():
    rng = random.Random(4)
    rows = [(100 + i, f"{prose(300, 900 + i)} {t.upper()} {prose(200, 950 + i)}") for i, t in ITEMS[:5]]
    rows += [(200 + i, f"{prose(63, i)} {edited(t, rng, 0.02)}") for i, t in ITEMS[1:5]]
    rows += [(300, "some two words here"), (301, "two other words"), (400, ITEMS[1][1] + " " + ITEMS[2][1]), (401, ITEMS[3][1].rsplit("\n")[0])]
    return [*ODD, *rows, *rows[:1]]


def test_leaks(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = leak_rows()
    for part_words in (10**6, 120):
        out = decontaminate.find_leaks(clash(spark.createDataFrame(rows, SCHEMA), "hits", "item_id"), items, part_words=part_words)
        found = [(r.doc_id, [h.item_id for h in r.hits]) for r in out.collect()]
        assert len(found) == len(rows)
        want = {100 + i: [i] for i in range(5)} | {200 + i: [i] for i in range(1, 5)} | {300: [10], 400: [1, 2]}
        assert {i: sorted(h) for i, h in found if h} == want


def test_parts_change_no_result(spark):
    items = spark.createDataFrame(ITEMS + [(20 + k, prose(25 + k, 600 + k)) for k in range(8)], "item_id long, text string")
    docs = spark.createDataFrame(leak_rows(), SCHEMA)
    whole, parted = (
        Counter((r.doc_id, tuple(sorted((h.item_id, round(h.bm25, 9), h.overlap, h.first_word) for h in r.hits))) for r in decontaminate.find_leaks(docs, items, part_words=n).collect())
        for n in (10**6, 120)
    )
    assert whole == parted


def test_an_item_without_its_last_words_is_found(spark):
    body = prose(40, 61) + ". " + prose(30, 62)
    items = spark.createDataFrame([(1, body + ". Ñ."), (2, prose(60, 63) + ".\nÑ"), (3, prose(60, 64) + ". " + prose(4, 65) + ".")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{prose(50, 66)} {body} {prose(50, 67)}"), (2, prose(60, 63)), (3, prose(60, 64)), (4, prose(60, 68) + ". Ñ.")], SCHEMA)
    assert {r.doc_id: [h.item_id for h in r.hits] for r in decontaminate.find_leaks(docs, items).collect()} == {1: [1], 2: [2], 3: [3], 4: []}


def scored_plainly(index, terms):
    scores = Counter()
    for t in terms:
        for i, x in zip(index.items[t], index.impacts[t], strict=True):
            scores[i] += x
    return {i: x for i, x in scores.items() if x >= index.least}


def test_search_equals_scoring_everything(monkeypatch):
    """Live blocks and cursors find just the items that a score of all of them finds."""
    items = [(i, *decontaminate.question_answer(t or "")) for i, t in ITEMS] + [(50 + k, prose(25 + k % 50, k), "") for k in range(300)]
    rng = random.Random(6)
    for cells in (2_000_000, 50):  # all at once, and a passage or two at a time
        monkeypatch.setattr(decontaminate, "CELLS", cells)
        for index in decontaminate.ItemIndex(items, threshold=0.3).classes:
            passages = []
            for _ in range(40):
                words = prose(100, rng.randrange(10**6)).split()
                for i in rng.sample(range(len(index.numbers)), min(3, len(index.numbers))):
                    words += rng.sample(own := [t for t, k in index.term.items() if i in index.items[k]], rng.randrange(len(own) + 1))
                passages.append(sorted({index.term[w] for w in words if w in index.term}))
            places = np.repeat(np.arange(40), list(map(len, passages)))
            found = {p: dict(index.wand(terms.tolist(), live.tolist())) for p, terms, live in index.live(places, np.concatenate(passages).astype(np.int64))}
            want = {p: scored_plainly(index, terms) for p, terms in enumerate(passages)}
            assert any(want.values())
            for p in range(40):
                got = found.get(p, {})
                assert got.keys() == want[p].keys() and all(abs(x - want[p][i]) < 1e-9 for i, x in got.items())


def test_leaks_with_text_ids_and_long_items(spark):
    items = [("a", prose(30, 11)), ("long", prose(700, 12)), ("b", prose(5, 13))]
    docs = [(1, f"{prose(40, 21)} {items[0][1]} {prose(900, 22)} {items[1][1]} {prose(30, 23)}"), (2, prose(3000, 24)), (3, items[1][1][:2000])]
    for part_words in (10**6, 200):
        out = decontaminate.find_leaks(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id string, text string"), part_words=part_words)
        assert {r.doc_id: sorted(h.item_id for h in r.hits) for r in out.collect()} == {1: ["a", "long"], 2: [], 3: []}


def test_a_worker_stays_small_with_many_items():
    """Peak of one process that indexes 2,000 items and searches 4 MB of text."""
    code = """
import random, resource, sys
from millrace.llm import decontaminate as D
from tests.llm.helpers import prose
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
index = D.ItemIndex([(i, prose(40, i), "") for i in range(2000)])
texts = [prose(600, 10**6 + i) for i in range(1300)]
index.columns(texts)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    grown = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT).stdout.split()[-1])
    assert grown < 200, grown


def test_no_items_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not r.hits for r in decontaminate.find_leaks(odd(spark), none).collect())
    assert decontaminate.find_leaks(spark.createDataFrame([], SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string")).collect() == []


def test_answers_in_their_own_column(spark):
    items = spark.createDataFrame([(1, "what is the capital of the far country", "a city of gold")], "item_id long, text string, answer string")
    docs = spark.createDataFrame([(1, "what is the capital of the far country a city of gold"), (2, "what is the capital of the far country nobody knows")], SCHEMA)
    out = decontaminate.find_leaks(docs, items, answer_col="answer")
    assert {r.doc_id: len(r.hits) for r in out.collect()} == {1: 1, 2: 0}
