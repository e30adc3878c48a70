"""Benchmark decontamination: a BM25 index of the test items, searched with every training passage.

The items are indexed once: for each term a posting of items and impacts in order of the items, and the
largest impact in every block of ``BLOCK_ITEMS`` items that holds the term. An impact is the term's BM25
share of the item's score against itself, so a passage that holds all of an item's words scores 1. Items
are kept in classes by length; texts are cut for each class into overlapping passages, long enough that
any item of the class lies whole in one of them, so one long item does not widen the passages of others.

Passages are searched by block-max WAND. First the blocks that can hold a hit are found for many
passages at once: the block maxima of a passage's terms are added up, but for the terms of least impact
(the frequent ones, in nearly all blocks); what those could add is taken off the threshold instead. The
sums are made some thousand passages at a time, so their memory depends neither on texts nor on items.
Then cursors walk over the postings in live blocks only, with a pivot where the terms' maxima could
reach the threshold and block maxima to skip by. Every item above the threshold is then verified: shares
of its five-word shingles, question words and answer words that the passage holds.

An item is a question and, behind it, an answer: a column of its own, or the last line, if it has the
words of a shingle and others stand before it. The end of a sentence says nothing of an answer: an item
without one is judged by its shingles. The index is sent to the executors in parts of about
``PART_WORDS`` words. With one part, texts are searched where they are. With more, each part is a job of
its own that writes the hits of the texts that have any, and texts meet their hits at the end; so memory
has a bound for any number of items. Counts of items and of words are those of all parts, so parts change
no result.

Null and empty texts and items without words match nothing; items of fewer than five words must stand
in the passage as they are. Long texts are searched whole, in passages; of equal passages of a text the first
is told. Repeated rows and items are each reported, items by their ids, of any type. Input columns named like the output are replaced, other
columns stay.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import remove_tables, written
from .common import map_texts, ship

WORDS = re.compile(r"\w+")
ANSWER = re.compile(r"(?s)^(.*\n)\s*(\S.*)$")
K1, B = 1.2, 0.75
THRESHOLD = 0.5
SHINGLE, OVERLAP, PART_OVERLAP = 5, 0.8, 0.5
BLOCK_ITEMS = 4
#: Words of the shortest class of items; each further class holds items up to four times as long.
SHORTEST_CLASS = 64
#: Words of the items in one part of the index.
PART_WORDS = 300_000
#: Characters of text that are searched together, and sums of block maxima that are held at a time.
GROUP_CHARS, CELLS = 1_000_000, 2_000_000
#: Share of the threshold that a passage's terms of least impact may reach together and be left out of the sums.
SPARE = 0.2


def shingles(words: list[str], width: int) -> Counter:
    return Counter(zip(*[words[k:] for k in range(width)], strict=False))


def question_answer(text: str) -> tuple[str, str]:
    """The item's text in two; without a place to cut, all of it is the question."""
    m = ANSWER.match(text.rstrip())
    return (m[1], m[2]) if m and WORDS.search(m[1]) and len(WORDS.findall(m[2])) >= SHINGLE else (text, "")


@dataclass(frozen=True)
class Totals:
    """Of all items with words: how many, their words, and the items for each word."""

    n: int
    n_words: int
    df: dict[str, int]


def totals_of(words: Sequence[list[str]]) -> Totals:
    return Totals(len(words), sum(map(len, words)), Counter(chain.from_iterable(map(set, words))))


class Postings:
    """The inverted index of the items of one length class."""

    def __init__(self, numbers: list[int], words: list[list[str]], stride: int, totals: Totals, threshold: float):
        """``numbers``: the items' places in the whole list; ``stride``: words of the longest that fits."""
        self.numbers, self.stride, self.least = numbers, stride, threshold - 1e-9
        self.term: dict[str, int] = {}
        average = totals.n_words / max(1, totals.n)
        items: list[list[int]] = []
        impacts: list[list[float]] = []
        for i, own in enumerate(words):
            norm = K1 * (1 - B + B * len(own) / average)
            raw = {t: math.log(1 + (totals.n - totals.df[t] + 0.5) / (totals.df[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in Counter(own).items()}
            whole = sum(raw.values())
            for t, x in raw.items():
                k = self.term.setdefault(t, len(self.term))
                if k == len(items):
                    items.append([])
                    impacts.append([])
                items[k].append(i)
                impacts[k].append(x / whole)
        self.items, self.impacts = items, impacts
        self.bounds = [max(x) for x in impacts]
        self.most = np.array(self.bounds)
        self.n_blocks = -(-len(words) // BLOCK_ITEMS)
        # blocks of each term, in order, with their maxima
        self.block_of: list[dict[int, float]] = []
        for own, xs in zip(items, impacts, strict=True):
            best: dict[int, float] = {}
            for i, x in zip(own, xs, strict=True):
                best[i // BLOCK_ITEMS] = max(best.get(i // BLOCK_ITEMS, 0.0), x)
            self.block_of.append(best)
        self.block_ends = np.cumsum([len(b) for b in self.block_of])
        self.blocks = np.fromiter(chain.from_iterable(self.block_of), np.int64, int(self.block_ends[-1]))
        self.maxima = np.fromiter(chain.from_iterable(b.values() for b in self.block_of), np.float64, len(self.blocks))
        self.block_starts = self.block_ends - [len(b) for b in self.block_of]

    def live(self, passage: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(passage, its terms, its live blocks) for each passage that has any. ``passage`` and ``term`` list
        the distinct terms of each passage, passages in order."""
        order = np.lexsort((self.most[term], passage))  # within a passage by impact
        passage, term = passage[order], term[order]
        first = np.flatnonzero(np.r_[True, np.diff(passage) > 0])
        sizes = np.diff(np.r_[first, len(passage)])
        running = np.cumsum(self.most[term])
        running -= np.repeat(running[first] - self.most[term[first]], sizes)
        small = running < self.least * SPARE  # left out: the frequent terms
        spare = np.maximum.reduceat(np.where(small, running, 0.0), first)
        able = np.repeat(running[first + sizes - 1] >= self.least, sizes)
        row = np.repeat(np.arange(len(first)), sizes)
        used = np.flatnonzero(~small & able)
        counts = (self.block_ends - self.block_starts)[term[used]]
        at, at_once = 0, max(1, CELLS // self.n_blocks)
        ends = np.cumsum(counts)
        while at < len(used):
            # so many passages that sums and entries stay within bounds
            last_row = row[used[at]] + at_once
            hi = int(np.searchsorted(row[used], last_row))
            done = ends[at - 1] if at else 0
            fits = int(np.searchsorted(ends, done + CELLS))
            if fits < hi:
                hi = int(np.searchsorted(row[used], row[used[fits]]))  # whole passages
                if hi <= at:
                    hi = int(np.searchsorted(row[used], row[used[at]], "right"))
            part, n = used[at:hi], counts[at:hi]
            base = int(row[part[0]])
            n_rows = int(row[part[-1]]) - base + 1
            place = np.arange(int(n.sum())) + np.repeat(self.block_starts[term[part]] - np.cumsum(n) + n, n)
            cell = np.repeat((row[part] - base) * self.n_blocks, n) + self.blocks[place]
            sums = np.bincount(cell, self.maxima[place], n_rows * self.n_blocks).reshape(n_rows, self.n_blocks)
            rows, blocks = np.nonzero(sums >= (self.least - spare[base : base + n_rows])[:, None])
            for k in np.unique(rows).tolist():
                r = base + k
                yield int(passage[first[r]]), term[first[r] : first[r] + sizes[r]], blocks[rows == k]
            at = hi

    def wand(self, terms: Sequence[int], live: Sequence[int]) -> list[tuple[int, float]]:
        """Items in live blocks (in order) whose score for these distinct terms is at least the threshold."""
        found: list[tuple[int, float]] = []
        cursors: list[list] = []  # item, place, term

        def seek(cursor: list, target: int) -> bool:
            """Move to the first posting from ``target`` on that is in a live block."""
            own = self.items[cursor[2]]
            at = bisect_left(own, target, cursor[1])
            while at < len(own):
                block = own[at] // BLOCK_ITEMS
                k = bisect_left(live, block)
                if k == len(live):
                    return False
                if live[k] == block:
                    cursor[0], cursor[1] = own[at], at
                    return True
                at = bisect_left(own, live[k] * BLOCK_ITEMS, at)
            return False

        for t in terms:
            if seek(c := [0, 0, t], 0):
                cursors.append(c)
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for c in cursors:
                bound += self.bounds[c[2]]
                if bound >= self.least:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            block = pivot // BLOCK_ITEMS
            ahead = [c for c in cursors if c[0] <= pivot]
            if sum(self.block_of[c[2]].get(block, 0.0) for c in ahead) < self.least:
                # no item up to the next cursor or the block's end can do it
                target = min([c[0] for c in cursors if c[0] > pivot] + [(block + 1) * BLOCK_ITEMS])
            elif cursors[0][0] == pivot:
                score = sum(self.impacts[c[2]][c[1]] for c in ahead)
                if score >= self.least:
                    found.append((pivot, score))
                target = pivot + 1
            else:
                target = pivot
            cursors = [c for c in cursors if c[0] >= target or seek(c, target)]
        return found


class ItemIndex:
    def __init__(self, items: Iterable[tuple[object, str, str]], threshold: float = THRESHOLD, totals: Totals | None = None):
        """``items``: (id, question, answer). ``totals``: of all items, if these are a part of them."""
        self.ids, self.words, self.parts = [], [], []
        for item_id, question, answer in items:
            q, a = WORDS.findall(question.lower()), WORDS.findall(answer.lower())
            if q or a:
                self.ids.append(item_id)
                self.words.append(q + a)
                self.parts.append((Counter(q), Counter(a)))
        totals = totals_of(self.words) if totals is None else totals
        by_class: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            stride = SHORTEST_CLASS
            while stride < len(w):
                stride *= 4
            by_class.setdefault(stride, []).append(i)
        self.classes = [Postings(own, [self.words[i] for i in own], stride, totals, threshold) for stride, own in sorted(by_class.items())]

    def verify(self, item: int, passage: list[str]) -> tuple[float, float, float]:
        """Shares of the item's shingles, question words and answer words in the passage."""
        width = min(SHINGLE, len(self.words[item]))
        own, there, held = shingles(self.words[item], width), shingles(passage, width), Counter(passage)
        share = lambda a, b: sum((a & b).values()) / sum(a.values()) if a else 1.0
        return share(own, there), share(self.parts[item][0], held), share(self.parts[item][1], held)

    def search(self, texts: list[str | None]) -> list[list[dict]]:
        """For each text its contaminating items, each with its best passage."""
        words = [WORDS.findall(t.lower()) if t else [] for t in texts]
        found: list[dict[int, dict]] = [{} for _ in texts]
        for index in self.classes:
            self._search(index, words, found)
        return [[h[i] for i in sorted(h)] for h in found]

    def _search(self, index: Postings, words: list[list[str]], found: list[dict[int, dict]]) -> None:
        stride = index.stride  # a passage is two strides long and begins at a stride
        lengths = np.array([len(w) for w in words], np.int64)
        counts = np.maximum(1, -(-lengths // stride))
        base = np.concatenate([[0], np.cumsum(counts)])
        codes = np.fromiter((c for w in words for c in map(index.term.get, w, repeat(-1))), np.int64, int(lengths.sum()))
        known = np.flatnonzero(codes >= 0)
        if not len(known):
            return
        starts = np.cumsum(lengths) - lengths
        step = (np.arange(len(codes)) - np.repeat(starts, lengths))[known] // stride
        own, codes = np.repeat(base[:-1], lengths)[known] + step, codes[known]
        again = step > 0
        n_terms = len(index.term)
        key = np.unique(np.concatenate([own * n_terms + codes, (own[again] - 1) * n_terms + codes[again]]))
        for p, terms, live in index.live(key // n_terms, key % n_terms):
            hits = index.wand(terms.tolist(), live.tolist())
            if not hits:
                continue
            d = int(np.searchsorted(base, p, "right")) - 1
            start = (p - int(base[d])) * stride
            passage = words[d][start : start + 2 * stride]
            for at, score in hits:
                item = index.numbers[at]
                overlap, question, answer = self.verify(item, passage)
                if overlap >= OVERLAP and question >= PART_OVERLAP and answer >= PART_OVERLAP and (item not in found[d] or overlap > found[d][item]["overlap"]):
                    found[d][item] = {"item_id": self.ids[item], "bm25": score, "overlap": overlap, "question_overlap": question, "answer_overlap": answer, "first_word": start}

    def columns(self, texts: list[str | None]) -> dict[str, list]:
        out, group, size = [], [], 0
        for t in texts:
            group.append(t)
            size += len(t or "")
            if size > GROUP_CHARS:
                out += self.search(group)
                group, size = [], 0
        return {"__hits": out + self.search(group)}


def _counted(listed: DataFrame) -> DataFrame:
    """The items (id, q, a) with their words, written."""
    ship(listed.sparkSession)
    id_type = listed.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cut = [(q, a) if isinstance(a, str) else question_answer(q) for q, a in zip(pdf["q"], pdf["a"], strict=True)]
            words = [WORDS.findall(q.lower()) + WORDS.findall(a.lower()) for q, a in cut]
            yield pdf.assign(q=[q for q, _ in cut], a=[a for _, a in cut], n_words=[len(w) for w in words], terms=[sorted(set(w)) for w in words])

    return written(listed.mapInPandas(count, f"id {id_type}, q string, a string, n_words int, terms array<string>"), "items")


def _indexes(items: DataFrame, parts: int, threshold: float) -> Iterator[ItemIndex]:
    """The index of each part in turn, with the counts of all items."""
    counted = items.filter("n_words > 0").withColumn("part", F.pmod(F.xxhash64("id", "q"), F.lit(parts)).cast("int"))
    size = counted.agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words")).first()
    each = counted.select("part", F.explode("terms").alias("term"))
    df = written(each.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "item-terms") if parts > 1 else None
    for k in range(parts):
        rows = counted.filter(F.col("part") == k).orderBy("id", "q").select("id", "q", "a").collect()  # about part_words words
        totals = None
        if parts > 1:
            own = each.filter(F.col("part") == k).select("term").distinct().join(df, "term").collect()  # the words of those items
            totals = Totals(size.n, size.words or 0, {r.term: r.df for r in own})
        yield ItemIndex([(r.id, r.q, r.a) for r in rows], threshold, totals)
    if parts > 1:
        remove_tables(df)


def find_leaks(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", answer_col: str | None = None,
    keep: list[str] | None = None, threshold: float = THRESHOLD, part_words: int = PART_WORDS, hits: str = "hits",
) -> DataFrame:
    """Add ``hits``, the test items that each text holds (an empty array for a clean text)."""
    kept = [c for c in (docs.columns if keep is None else keep) if c != hits]
    answer = F.col(f"`{answer_col}`") if answer_col else F.lit(None)
    listed = items.select(F.col(f"`{item_id}`").alias("id"), F.coalesce(F.col(f"`{item_text}`"), F.lit("")).alias("q"), answer.cast("string").alias("a"))
    kind = f"array<struct<item_id:{listed.schema['id'].dataType.simpleString()},bm25:double,overlap:double,question_overlap:double,answer_overlap:double,first_word:int>>"
    counted = _counted(listed)
    parts = max(1, -(-(counted.agg(F.sum("n_words").alias("w")).first().w or 0) // part_words))
    sc = docs.sparkSession.sparkContext

    def searched(df: DataFrame, index: ItemIndex, columns: list[str], text: str) -> DataFrame:
        sent = sc.broadcast(index)  # of about part_words words
        return map_texts(df, lambda: sent.value.columns, f"__hits {kind}", text, columns)

    if parts == 1:
        index = next(_indexes(counted, parts, threshold))
        remove_tables(counted)
        named = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("__text_in"))
        return searched(named, index, kept, "__text_in").withColumnRenamed("__hits", hits)
    digest = lambda c: F.unhex(F.md5(F.col(c).cast("binary")))
    texts = docs.select(F.col(f"`{text_col}`").alias("text")).filter("text is not null").withColumn("hid", digest("text"))
    found = None
    for index in _indexes(counted, parts, threshold):
        own = written(searched(texts, index, ["hid"], "text").filter(F.size("__hits") > 0).dropDuplicates(["hid"]), "hits")
        found = own if found is None else found.unionAll(own)
    remove_tables(counted)
    every = found.groupBy("hid").agg(F.flatten(F.collect_list("__hits")).alias("__hits")).withColumnRenamed("hid", "__own")  # a row for each part
    keyed = docs.select(*[F.col(f"`{c}`") for c in kept], F.unhex(F.md5(F.col(f"`{text_col}`").cast("binary"))).alias("__hid"))
    joined = keyed.join(every, F.col("__hid") == F.col("__own"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in kept], F.coalesce("__hits", F.expr(f"cast(array() as {kind})")).alias(hits))
