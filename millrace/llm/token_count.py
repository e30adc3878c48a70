"""Token counts by byte-pair merging with a heap and a linked list.

The lowest-ranked adjacent pair is popped again and again; the count is the number of initial symbols
less the merges. No token ids are made. The vocabulary is a public sentencepiece BPE model: ranks are
its scores, a character it lacks counts as its UTF-8 bytes. When no piece has a space mark after
another character, merges never cross the start of a word, so counts are made word by word and
remembered in a bounded memo.

Null text counts as empty: 0 bytes, 0 tokens. Texts of any length are counted whole; one long run
without spaces costs n log n. Repeated rows are each counted; of equal ranks the leftmost pair merges first. Columns of
the input stay, except those named like an output.
"""

from __future__ import annotations

import heapq
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_texts, tool

SPACE = "▁"
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class HeapMerger:
    def __init__(self, ranks: dict[str, float]):
        """``ranks``: pieces that a merge may make, and their rank (the lowest merges first)."""
        self.ranks = ranks
        #: no piece has a space mark behind another character: a merge never crosses a word's start
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in ranks)
        self.memo = Memo(lambda word: self.merge_count(SPACE + word))

    @classmethod
    def load(cls, path: str) -> HeapMerger:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        usable = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        return cls({model.id_to_piece(i): -model.get_score(i) for i in usable})

    def merge_count(self, symbols: str) -> int:
        """Tokens of one unit, spaces already written as marks."""
        ranks, n = self.ranks, len(symbols)
        weight = [1 if c in ranks else len(c.encode()) for c in symbols]
        total = sum(weight)
        if n < 2:
            return total
        part: list[str | None] = list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = ranks.get(symbols[i : i + 2])
            if rank is not None:
                heap.append((rank, i, symbols[i : i + 2]))
        heapq.heapify(heap)
        while heap:
            _, i, made = heapq.heappop(heap)
            if part[i] is None or (j := after[i]) >= n or part[i] + part[j] != made:  # one side has merged meanwhile
                continue
            part[i], part[j] = made, None
            total += 1 - weight[i] - weight[j]
            weight[i] = 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := ranks.get(both := made + part[k])) is not None:
                    heapq.heappush(heap, (rank, i, both))
            h = before[i]
            if h >= 0 and (rank := ranks.get(both := part[h] + made)) is not None:
                heapq.heappush(heap, (rank, h, both))
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.by_word:
            return self.merge_count(SPACE + text.replace(" ", SPACE))
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return sum(map(self.merge_count, UNIT.findall(SPACE + text.replace(" ", SPACE))))
        return sum(map(self.memo.__getitem__, text.split(" ")))

    def counts(self, texts: list[str | None]) -> dict[str, list[int]]:
        out = []
        for t in texts:
            out.append(self.count(t))
            self.memo.trim()
        return {"n_tokens": out}


def merger(path: str) -> HeapMerger:
    return tool(("merger", path), lambda: HeapMerger.load(path))


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (n_tokens > limit)."""
    sized = docs.withColumn("n_bytes", F.coalesce(F.octet_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)).cast("long"))
    kept = None if keep is None else [*keep, "n_bytes"]
    counted = map_texts(sized, lambda: merger(model_path).counts, "n_tokens long", text_col, kept)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
