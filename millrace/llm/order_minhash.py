"""Near-duplicate texts by Order MinHash and banded alignment.

A text's k-mers are its windows of five words (in lower case, without punctuation), each labelled with
how many equal ones stand before it; texts of up to 60 words have windows of two words, texts of up to
12 single words. A sketch takes the k-mers of smallest hash and keeps them in text order, so texts with
the same k-mers in another order differ. Each text has ``SKETCHES`` sketches, each in four sizes.

Texts that share a sketch of the smallest size form a bucket. Every member is compared with two
centres of the bucket, if their lengths allow the similarity; pairs of a level are thus at most twice
its members, whatever the size of a bucket. A bucket whose members are all known to be of one class is
done. All members of the others meet again, with other centres, in buckets of the larger sizes. In
buckets that still hold more than one class then, all pairs of members of different classes are compared
(``rest``): first by how many words and how many pairs of neighbouring words they can share, which drops no
similar pair, then by alignment, in the same task. A pair that is similar makes its classes one there, so of
a bucket's tile come at most as many links as it has members. So two similar texts that share a sketch of the
smallest size are always of one class, whatever the size of their bucket; only pairs inside a class are not
all compared. Such buckets are cut into tiles of ``TILE`` members and ``TILE_WORDS`` words, so a task holds
two tiles at most; one of few classes is cut into some more (``SPREAD``). The comparisons by bins are quadratic in the members of like length. Which texts share a
sketch is left to chance: of pairs with random word edits at a similarity of 0.8, tests hold the share that
does to 0.9 at least, for any length from five words on.

Pairs are verified by a banded alignment of their words: edit distance in a band as wide as the
threshold allows. Linked texts (similarity 0.8 or more) form classes, their connected components,
found by star contraction. A class is known by its smallest document id.

Equal texts are one class from the start and are compared once. Null texts and texts without a word
are compared with nothing: each document stands for itself. Documents without an id belong to classes
too; a class of such documents only has no id. Repeated rows are equal texts. Very long texts are
sketched and aligned whole. Other columns may have any names. Intermediate tables are in the shared
folder and are removed, but for the last one, which results read.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import remove_tables, written
from .common import Memo, map_texts, release, ship

WORDS = re.compile(r"\w+")
SKETCHES = 24
SIMILARITY = 0.8


class Scheme(NamedTuple):
    """How texts of ``least`` to ``most`` words are sketched: words in a k-mer, and k-mers in a sketch, level by level."""

    k: int
    least: int
    most: int
    sizes: tuple[int, ...]


#: Five words; fewer for short texts, where one edit touches every five-word window. Neighbouring schemes
#: overlap so far that two texts whose lengths allow the similarity share a scheme.
SCHEMES = (Scheme(5, 48, sys.maxsize, (1, 2, 4, 6)), Scheme(2, 10, 60, (2, 3, 4, 6)), Scheme(1, 1, 12, (2, 3, 4, 6)))
LEVELS = len(SCHEMES[0].sizes)
#: Bins of words, and members and words of a tile where all pairs of a bucket are compared; pairs at a time, and
#: of those that bins leave.
BINS, TILE, TILE_WORDS, CELLS, STEP = 256, 16_384, 1 << 22, 1 << 18, 1 << 13
#: Words from which a bucket of few classes is cut into more tiles than it must be, up to so many: where a thousand near
#: copies are just below the similarity, most pairs are aligned, and tiles spread that over the tasks. Each tile sends
#: every text of the bucket once more.
SPREAD_WORDS, SPREAD = 1 << 18, 4
#: Texts whose sketches are made together.
TOGETHER = 1000
MIX = np.uint64(0xBF58476D1CE4E5B9)
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    out = x >> np.uint64(31)
    out ^= x
    out *= MIX
    out ^= out >> np.uint64(29)
    return out


def hash_word(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode())


SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * ODD)


class Sketcher:
    def __init__(self):
        self.memo = Memo(hash_word)

    def words(self, text: str | None) -> np.ndarray:
        found = WORDS.findall(text.lower()) if text else []
        return np.fromiter(map(self.memo.__getitem__, found), np.uint64, len(found))

    @staticmethod
    def labelled(words: np.ndarray, k: int) -> np.ndarray:
        """Occurrence-labelled k-mers in text order."""
        n = max(1, len(words) - k + 1)
        value = np.full(n, k, np.uint64)
        for j in range(min(k, len(words))):
            value = value * ODD + words[j : j + n]
        value = mix(value)
        order = np.argsort(value, kind="stable")
        ranked = value[order]
        first = np.r_[True, ranked[1:] != ranked[:-1]]
        if not first.all():
            at = np.arange(n)
            before = np.empty(n, np.uint64)
            before[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
            # first occurrences keep their value: they meet those of texts that repeat nothing
            value = np.where(before > 0, mix(value + before * ODD), value)
        return value

    @classmethod
    def sketch(cls, words: np.ndarray) -> np.ndarray:
        """Keys, one row for each level and one column for each sketch of each scheme that fits."""
        return cls.sketches([words])[0]

    @classmethod
    def sketches(cls, texts: list[np.ndarray]) -> list[np.ndarray | None]:
        """The sketch of each text, None for one without words. Keys of many texts are made at once."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for scheme in SCHEMES:
            same: dict[int, list] = {}  # by how many k-mers there are to take
            for at, words in enumerate(texts):
                if scheme.least <= len(words) <= scheme.most:
                    value, near = cls._nearest(words, scheme)
                    same.setdefault(near.shape[1], []).append((at, near, value[near]))
            for taken in same.values():
                owners, near, value = zip(*taken, strict=True)
                keys = cls._keys(np.concatenate(near), np.concatenate(value), scheme)
                for at, own in zip(owners, np.split(keys, len(owners), axis=1), strict=True):
                    out[at].append(own)
        return [np.concatenate(own, axis=1) if own else None for own in out]

    @classmethod
    def _nearest(cls, words: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
        """The k-mers, and for each sketch the places of those of smallest hash, smallest first."""
        value = cls.labelled(words, scheme.k)
        n, most = len(value), scheme.sizes[-1]
        hashed = mix(value[None, :] ^ SEEDS[:, None])
        if n > most:
            near = np.argpartition(hashed, most - 1, axis=1)[:, :most]
        else:
            near = np.tile(np.arange(n), (SKETCHES, 1))
        return value, np.take_along_axis(near, np.argsort(np.take_along_axis(hashed, near, 1), axis=1), 1)

    @staticmethod
    def _keys(near: np.ndarray, value: np.ndarray, scheme: Scheme) -> np.ndarray:
        """Level by level, the key of each row's k-mers."""
        seeds = np.tile(SEEDS, len(near) // SKETCHES)
        out = np.empty((LEVELS, len(near)), np.uint64)
        for level, size in enumerate(scheme.sizes):
            chosen = np.take_along_axis(value[:, :size], np.argsort(near[:, :size], axis=1), 1)  # text order
            key = seeds + np.uint64(level)
            for j in range(chosen.shape[1]):
                key = mix(key * ODD + chosen[:, j])
            out[level] = key
        return out

    def columns(self, texts: list[str | None]) -> dict[str, list]:
        sizes, packed, keys = [], [], [[] for _ in range(LEVELS)]
        for at in range(0, len(texts), TOGETHER):
            words = []
            for t in texts[at : at + TOGETHER]:
                words.append(self.words(t))
                self.memo.trim()
            sizes += map(len, words)
            packed += [w.astype("<u4").tobytes() for w in words]  # 32 bits of each word's hash: enough to align two texts
            for rows in self.sketches(words):
                rows = [None] * LEVELS if rows is None else rows.view(np.int64)
                for own, row in zip(keys, rows, strict=True):
                    own.append(row)
        return {"n_words": sizes, "words": packed} | {f"k{i}": k for i, k in enumerate(keys)}


# Alignment.


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two sequences if it is at most ``most``, else None. The band of the diagonals that so few
    edits can reach is swept as one bit vector that moves a row down with each column. The distance is kept for the
    diagonal of the last cell, where it never falls."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    head = 0
    limit = min(n, m)
    if limit:
        differs = np.flatnonzero(a[:limit] != b[:limit])
        head = int(differs[0]) if len(differs) else limit
        a, b = a[head:], b[head:]
        limit -= head
        differs = np.flatnonzero(a[len(a) - limit :] != b[len(b) - limit :])
        tail = limit - 1 - int(differs[-1]) if len(differs) else limit
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if not m:
        return n if n <= most else None
    most = min(most, n)
    apart = n - m
    spare = (most - apart) // 2  # diagonals beyond the main one and beyond that of the last cell
    # At column j, bit p stands for row j - spare + p; rows above 0 get values that keep row 0 right.
    size = apart + 2 * spare + 1
    full = (1 << size) - 1
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist(), spare):
        places[x] = places.get(x, 0) | (1 << i)
    down = (1 << (spare + 1)) - 1  # rows whose value is one less than the row above
    up = full ^ down  # rows whose value is one more
    last, bottom = 1 << (spare + apart), 1 << (size - 1)
    distance = apart
    for j, x in enumerate(b.tolist()):
        up, down = (up >> 1) | bottom, down >> 1  # the band moves a row down
        match = (places.get(x, 0) >> j) & full
        same = ((((match & up) + up) ^ up) | match | down) & full  # equal to the cell before it on its diagonal
        if not same & last:
            distance += 1
            if distance > most:
                return None
        right_up, right_down = (down | ~(same | up)) & full, same & up
        above = ((right_up << 1) | 1) & full
        up, down = ((right_down << 1) | ~(same | above)) & full, above & same
    return distance


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float | None:
    """1 - distance / length of the longer, if that is at least ``least``."""
    longer = max(len(a), len(b))
    if not longer:
        return None
    distance = banded_distance(a, b, int((1 - least) * longer + 1e-9))
    return None if distance is None else 1 - distance / longer


# All pairs of a bucket.


def tally(words: np.ndarray) -> tuple[bytes, int]:
    """How many words fall into each bin, 255 at most, and how many are beyond that in all bins."""
    counts = np.bincount(words % BINS, minlength=BINS)
    kept = np.minimum(counts, 255)
    return kept.astype(np.uint8).tobytes(), int((counts - kept).sum())


def can_be_similar(n: np.ndarray, label: np.ndarray, tallies: np.ndarray, beyond: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (of ``left`` and of ``right``) of different labels but those that share too few words: texts
    share at most the smaller count of each bin, and a distance is at least the longer one's other words."""
    found = list(blocks(n, label, tallies, beyond, left, right, least))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def blocks(n: np.ndarray, label: np.ndarray, tallies: np.ndarray, beyond: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """These pairs, some rows of ``left`` at a time, by the labels as they are then."""
    left, right = left[np.argsort(n[left], kind="stable")], right[np.argsort(n[right], kind="stable")]
    columns, lengths = None, n[right]
    step = max(1, CELLS // max(1, len(right)))
    for at in range(0, len(left), step):
        rows = left[at : at + step]
        lo, hi = np.searchsorted(lengths, [least * n[rows[0]] - 1e-6, n[rows[-1]] / least + 1e-6])
        near = right[lo:hi]
        longer = np.maximum(n[rows][:, None], n[near])
        need = longer - ((1 - least) * longer + 1e-9).astype(np.int64)
        i, j = np.nonzero((label[rows][:, None] != label[near]) & (np.minimum(n[rows][:, None], n[near]) >= need))
        if len(i) > 4 * BINS:  # bin by bin for all of them
            columns = np.ascontiguousarray(tallies[right].T) if columns is None else columns
            shared = np.zeros((len(rows), len(near)), np.uint16)  # 255 * BINS at most
            for own, other in zip(np.ascontiguousarray(tallies[rows].T), columns[:, lo:hi], strict=True):
                shared += np.minimum(own[:, None], other)
            shared = shared[i, j].astype(np.int64)
        else:
            shared = np.minimum(tallies[rows[i]], tallies[near[j]]).sum(axis=1, dtype=np.int64)
        kept = shared + np.minimum(beyond[rows[i]], beyond[near[j]]) >= need[i, j]
        yield rows[i[kept]], near[j[kept]]


def bigrams(words: np.ndarray) -> np.ndarray:
    """A hash of each two neighbouring words."""
    return (words[:-1] * np.uint32(0x9E3779B1) + words[1:]) ^ (words[1:] >> np.uint32(7))


def links_of(n: np.ndarray, label: np.ndarray, words: list[np.ndarray], first: Callable[[int, int], bool], left: np.ndarray, right: np.ndarray, least: float) -> Iterator[tuple[int, int, float]]:
    """Similar pairs (of ``left`` and of ``right``) that make all members of similar pairs one label: a pair whose
    labels are one by then is left out. So are those that ``first`` denies. An edit changes at most two pairs of
    neighbouring words, so texts at distance d share all but 2 d of the longer one's."""
    label, alone, sorted_bigrams = label.copy(), left is right, {}

    def counted(k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in sorted_bigrams:
            sorted_bigrams[k] = np.unique(bigrams(words[k]), return_counts=True)
        return sorted_bigrams[k]

    def share(x: int, y: int, need: int) -> bool:
        (own, a), (other, b) = counted(x), counted(y)
        _, i, j = np.intersect1d(own, other, assume_unique=True, return_indices=True)
        return int(np.minimum(a[i], b[j]).sum()) >= need

    def tallied(values: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        bins, beyond = zip(*map(tally, values), strict=True)
        return np.frombuffer(b"".join(bins), np.uint8).reshape(-1, BINS), np.array(beyond)

    ones, twos = tallied(iter(words)), tallied(map(bigrams, words))
    for i, j in blocks(n, label, *ones, left, right, least):
        if alone:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), STEP):
            x, y = i[at : at + STEP], j[at : at + STEP]
            x, y = x[label[x] != label[y]], y[label[x] != label[y]]
            longer = np.maximum(n[x], n[y])
            need = longer - 1 - 2 * ((1 - least) * longer + 1e-9).astype(np.int64)
            kept = np.minimum(twos[0][x], twos[0][y]).sum(axis=1, dtype=np.int64) + np.minimum(twos[1][x], twos[1][y]) >= need
            for a, b, must in zip(x[kept].tolist(), y[kept].tolist(), need[kept].tolist(), strict=True):
                if label[a] == label[b] or not first(a, b) or not share(a, b, must):
                    continue
                similar = similarity(words[a], words[b], least)
                if similar is not None:
                    yield a, b, similar
                    label[label == label[b]] = label[a]


# Spark.


def _hid(text_col: str):
    return F.unhex(F.md5(F.col(f"`{text_col}`").cast("string").cast("binary")))


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document: id, hid (128 bits of the text's hash), n_words, words (packed hashes) and each level's keys."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), _hid(text_col).alias("hid"), F.col(f"`{text_col}`").alias("text"))
    keys = ", ".join(f"k{i} array<long>" for i in range(LEVELS))
    return map_texts(rows, lambda: Sketcher().columns, f"n_words int, words binary, {keys}", "text", ["id", "hid"])


def verified(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """``pairs`` (a, c) with ``similar``: null if it is below the threshold."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[np.frombuffer(x, "<u4") for x in batch.column(k).to_pylist()] for k in (2, 3)]
            found = pa.array([similarity(x, y, least) for x, y in zip(*sides, strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], ["a", "c", "similar"])
        release()

    left = words.select(F.col("hid").alias("a"), F.col("words").alias("wa"))
    right = words.select(F.col("hid").alias("c"), F.col("words").alias("wc"))
    return pairs.join(left, "a").join(right, "c").select("a", "c", "wa", "wc").mapInArrow(align, "a binary, c binary, similar double")


def stars(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (a, c), a written table of the same columns: every node a and its component's
    smallest node c, for all nodes but the smallest. Large and small stars in turn until every node has one smaller
    neighbour or none, and none but the smallest a larger one. Every step is written to the shared folder. A node's
    smallest neighbour is written before the neighbours are joined with it, so that Spark can split a node of very many."""
    edges = written(links.select(F.least("a", "c").alias("c"), F.greatest("a", "c").alias("a")).filter("a <> c").distinct(), "stars")
    for step in range(2 * rounds):
        both = edges.select(F.col("a").alias("u"), F.col("c").alias("v")).unionAll(edges.select(F.col("c").alias("u"), F.col("a").alias("v")))
        one = F.least(F.min("v"), F.first("u")).alias("m")
        low = written(both.groupBy("u").agg(one, F.count_if(F.expr("v < u")).alias("smaller"), F.count_if(F.expr("v > u")).alias("larger")), "low")
        if low.filter("smaller > 1 or smaller > 0 and larger > 0").isEmpty():
            remove_tables(low)
            return edges
        if step % 2 == 0:  # large star: larger neighbours of each node go to its smallest neighbour (or itself)
            new = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("c"))
        else:  # small star: a node and its smaller neighbours go to the smallest of them
            new = edges.join(low, edges["a"] == low["u"]).select(F.when(F.col("c") == F.col("m"), F.col("a")).otherwise(F.col("c")).alias("a"), F.col("m").alias("c"))
        new = written(new.filter("a <> c").distinct(), "stars")
        remove_tables(edges, low)
        edges = new
    raise RuntimeError(f"the components of the links are not found after {rounds} rounds")


def joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``parts`` (as of :func:`stars`) when ``links`` (a, c) are added: only classes that these touch
    are contracted, each as its smallest node."""
    ends = links.select("a", "c")
    for side in ("a", "c"):
        root = parts.select(F.col("a").alias(side), F.col("c").alias("root"))
        ends = ends.join(root, side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
    merged = stars(ends)
    out = parts.join(merged.select(F.col("a").alias("c"), F.col("c").alias("root")), "c", "left").select("a", F.coalesce("root", "c").alias("c"))
    out = written(out.unionAll(merged.select("a", "c")), "stars")
    remove_tables(merged)
    return out


def met(members: DataFrame, who: list[str], spare: list[DataFrame]) -> DataFrame:
    """Members (key, hid, n, ...) of buckets of two or more, each with its bucket's centres ``lo`` and ``hi``:
    the least and the largest by ``who``. Centres are written first, so that Spark can split a bucket that
    very many share."""
    one = F.struct(*who)
    centres = written(members.groupBy("key").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).filter("lo.hid <> hi.hid"), "centres")
    spare.append(centres)
    return members.join(centres, "key")


def candidates(table: DataFrame, least: float, differ: str = "hid") -> DataFrame:
    """Pairs (a, c) of members and centres, but those whose lengths alone are an edit too many apart."""
    pair = table.select("hid", "n", differ, F.explode(F.array("lo", "hi")).alias("m")).filter(f"hid <> m.hid and {differ} <> m.{differ}")
    pair = pair.filter(F.least("n", "m.n") >= F.lit(least) * F.greatest("n", "m.n") - 1e-6)
    return pair.select(F.least("hid", "m.hid").alias("a"), F.greatest("hid", "m.hid").alias("c")).distinct()


def judged(pairs: DataFrame, rows: DataFrame, once: DataFrame, least: float) -> DataFrame:
    """The pairs, aligned; written."""
    pairs = written(pairs, "pairs")
    used = pairs.select(F.col("a").alias("hid")).unionAll(pairs.select(F.col("c").alias("hid"))).distinct()
    words = written(words_of(rows, once.select("hid", "rep").join(used, "hid")).dropDuplicates(["hid", "id"]).select("hid", "words"), "words")
    found = written(verified(pairs, words, least), "verified")
    remove_tables(pairs, words)
    return found


def words_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(hid, id, words) of one document of each wanted text (hid, rep): its id is in the key, so equal texts
    don't meet in one task."""
    on = rows["hid"].eqNullSafe(wanted["hid"]) & rows["id"].eqNullSafe(wanted["rep"])
    return rows.select("hid", "id", "words").join(wanted, on, "left_semi")


def rest(members: DataFrame, rows: DataFrame, once: DataFrame, least: float, spare: list[DataFrame], tile: int = TILE) -> DataFrame:
    """Links (a, c, similar) of members (key, hid, n, label) of one bucket and of different labels: so many that
    all similar pairs are of one component. Members are dealt out to tiles, and each two tiles of a bucket meet.
    Two texts that share several buckets are compared in the one of smallest key."""
    # of up to three members each has met all others as centres
    of = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("all"), F.min("label").alias("x"), F.max("label").alias("y"), F.count_distinct("label").alias("labels"))
    spread = F.when(F.col("size") >= 2 * F.col("labels"), F.least(F.ceil(F.col("all") / SPREAD_WORDS), F.lit(SPREAD))).otherwise(1)
    tiles = F.greatest(F.ceil(F.col("size") / tile), F.ceil(F.col("all") / TILE_WORDS), spread).cast("int").alias("tiles")
    sizes = written(of.filter("size > 3 and x <> y").select("key", tiles), "tiles")
    # written, so that Spark knows when these texts are few and does not shuffle the words of all others
    shared = members.join(sizes, "key").groupBy("hid").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    wanted = written(once.select("hid", "rep").join(shared, "hid"), "wanted")
    spare += [sizes, wanted]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(b: pa.RecordBatch, cuts: list[int]) -> Iterator[pa.RecordBatch]:
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = b.slice(lo, hi - lo)
                key, own = part.column(0)[0].as_py(), part.column(1)[0] == part.column(2)[0]
                label, second = part.column(5).dictionary_encode().indices.to_numpy(), part.column(6).to_numpy(zero_copy_only=False)
                words = [np.frombuffer(x, "<u4") for x in part.column(7).to_pylist()]
                keys = list(map(frozenset, part.column(8).to_pylist()))
                here = lambda x, y: min(keys[x] & keys[y]) == key  # noqa: B023, E731
                at = np.arange(hi - lo)
                left, right = (at, at) if own else (at[~second], at[second])
                if found := list(links_of(part.column(4).to_numpy().astype(np.int64), label, words, here, left, right, least)):
                    i, j, similar = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(3).take(pa.array(i)), part.column(3).take(pa.array(j)), pa.array(similar, pa.float64())], ["a", "c", "similar"])

        left: pa.RecordBatch | None = None  # the last two tiles, which may go on in the next batch
        for b in batches:
            b = pa.concat_batches([left, b]) if left is not None else b
            if b.num_rows:
                at = [b.column(k).to_numpy() for k in range(3)]
                cuts = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in at], axis=0)) + 1).tolist()]
                yield from links(b.slice(0, cuts[-1]), cuts)
                left = b.slice(cuts[-1])
        if left is not None and left.num_rows:
            yield from links(left, [0, left.num_rows])
        release()

    own = F.pmod(F.xxhash64("hid"), F.col("tiles")).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(t, own).alias("i"), F.greatest(t, own).alias("j"), (t < own).alias("second")))
    texts = words_of(rows, wanted).select("hid", "words").dropDuplicates(["hid"]).join(wanted.select("hid", "keys"), "hid")
    dealt = members.join(sizes, "key").join(texts, "hid").withColumn("t", F.explode(each))
    dealt = dealt.select("key", "t.i", "t.j", "hid", "n", "label", "t.second", "words", "keys").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = dealt.mapInArrow(compare, "a binary, c binary, similar double")
    return found.select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("c"), "similar").distinct()


def near_links(rows: DataFrame, least: float = SIMILARITY, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, c, similar) between different texts, a < c, and their components (:func:`stars`);
    written tables. Of similar texts that ``rest`` finds, the links that make them one class."""
    names, spare = [f"k{i}" for i in range(LEVELS)], []
    once = written(rows.groupBy("hid").agg(F.min("id").alias("rep"), F.first("n_words").alias("n"), *[F.first(k).alias(k) for k in names]), "texts")
    # smallest sketches: the same texts are centres in all of them, so that pairs repeat
    members = once.select("hid", "n", F.posexplode("k0").alias("p", "key"))
    first = written(met(members, ["hid", "n"], spare), "met")
    coarse = judged(candidates(first, least), rows, once, least)
    # members take the label of a centre that they are like; a bucket of one label is done
    good = coarse.filter("similar is not null").select("a", "c")
    either = good.unionAll(good.select(F.col("c").alias("a"), F.col("a").alias("c")))
    told = first.select("key", "p", "hid", "n", F.col("lo.hid").alias("lo"), F.col("hi.hid").alias("hi"))
    for side in ("lo", "hi"):
        told = told.join(either.select(F.col("a").alias("hid"), F.col("c").alias(side), F.lit(True).alias(f"like_{side}")), ["hid", side], "left")
    label = F.when(F.col("like_lo") | (F.col("hid") == F.col("lo")), F.col("lo")).when(F.col("like_hi") | (F.col("hid") == F.col("hi")), F.col("hi")).otherwise(F.col("hid"))
    told = written(told.select("key", "p", "hid", "n", label.alias("label")), "told")
    unfinished = written(told.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").select("key"), "open")
    remove_tables(first, *spare)
    spare = [coarse, told, unfinished]
    # finer sketches of all members of the other buckets, with centres of each bucket's own
    finer = F.array(*[F.element_at(k, F.col("p") + 1) for k in names[1:]])
    left = told.join(unfinished, "key").select("hid", "n", "p", "label").join(once.select("hid", *names[1:]), "hid")
    members = left.select("hid", "n", "label", F.explode(finer).alias("key"))
    members = members.withColumn("rank", F.md5(F.concat(F.col("hid"), F.col("key").cast("string").cast("binary"))))
    second = met(members, ["rank", "hid", "n", "label"], spare)
    fine = judged(candidates(second, least, "label").join(coarse, ["a", "c"], "left_anti"), rows, once, least)
    links = written(coarse.unionAll(fine).filter("similar is not null"), "links")
    parts = stars(links)
    # whom no centre has told: members of other classes in the same bucket
    classed = told.join(unfinished, "key").select("key", "hid", "n").join(parts.select(F.col("a").alias("hid"), F.col("c").alias("root")), "hid", "left")
    members = written(classed.select("key", "hid", "n", F.coalesce("root", "hid").alias("label")), "members")
    others = written(rest(members, rows, once, least, spare, tile), "others")
    spare += [fine, members, others]
    if not others.isEmpty():
        before = links, parts
        links = written(links.unionAll(others), "links")
        parts = joined(parts, others)
        remove_tables(*before)
    remove_tables(once, *spare)
    return links, parts


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """A written row for each document: id, hid, class_id, keep_hid and n_links. ``class_id`` and ``keep_hid``
    are id and text of the class's first document (null for one without words, a class of its own)."""
    ship(docs.sparkSession)
    rows = written(sketches(docs, id_col, text_col), "sketches")
    worded = rows.filter("n_words > 0")
    links, parts = near_links(worded, least)
    degree = links.select(F.explode(F.array("a", "c")).alias("hid")).groupBy("hid").agg(F.count(F.lit(1)).alias("n_links"))
    ids = worded.groupBy("hid").agg(F.min("id").alias("rep"))
    rooted = ids.join(parts.select(F.col("a").alias("hid"), F.col("c").alias("root")), "hid", "left").join(degree, "hid", "left").withColumn("root", F.coalesce("root", "hid"))
    rooted = written(rooted, "rooted")
    # written, so that the join below is its own stage, where a large class can be split
    first = written(rooted.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "hid")).alias("first")), "first")
    classes = rooted.join(first, "root").select("hid", F.col("first.rep").alias("class_id"), F.col("first.hid").alias("keep_hid"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    classes = written(classes, "text-classes")
    every = worded.select("id", "hid").join(classes, "hid").select("id", "hid", "class_id", "keep_hid", "n_links")
    wordless = rows.filter("n_words = 0").select("id", "hid", F.col("id").alias("class_id"), F.lit(None).cast("binary").alias("keep_hid"), F.lit(0).cast("long").alias("n_links"))
    out = written(every.unionAll(wordless), "classes")
    remove_tables(rows, links, parts, rooted, first, classes)
    return out


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(id, class_id, n_links) for every document: its class, and to how many other texts a link was verified."""
    return near_classes(docs, id_col, text_col, least).select(F.col("id").alias(id_col), "class_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The first document (by id) of each class, and all documents without words; columns as they were.
    Rows that repeat both id and text are one document."""
    classes = near_classes(docs, id_col, text_col, least).filter("keep_hid is not null")
    first = F.col("id").eqNullSafe(F.col("class_id")) & (F.col("hid") == F.col("keep_hid"))
    lost = classes.filter(~first).select(F.col("id").alias("__id"), F.col("hid").alias("__lost")).distinct()
    keyed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], _hid(text_col).alias("__hid"))
    # by id and text: equal texts of different documents are spread over the tasks
    left = keyed.join(lost, keyed["__hid"].eqNullSafe(lost["__lost"]) & keyed[id_col].eqNullSafe(lost["__id"]), "left_anti")
    nobody = F.col(f"`{id_col}`").isNull() & ~F.coalesce(F.col(f"`{text_col}`").rlike(r"[\p{L}\p{N}_]"), F.lit(False))
    own = F.when(nobody, F.monotonically_increasing_id())  # without id and words: nothing says it is another's repeat
    return left.withColumn("__own", own).dropDuplicates(["__hid", id_col, "__own"]).select(*[F.col(f"`{c}`") for c in docs.columns])
