import hashlib
import random
from collections import Counter

import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from millrace.llm import bpe_tree, token_count
from millrace.llm.queries import PIECES, WORD_BPE

from .helpers import ODD, SCHEMA, clash, odd, prose

PARTS = ["a", "b", "the", "ing", "'s", "'", "'re", "!", "!!", "1", "23", " ", "  ", "\n", "é", "e\u0301", "ß", "Σ", "İ", "中文", "😀", "<|endoftext|>", "\x1c", "\xa0", "H\u0331", "ﬁ", "▁", "½", "\t"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


def texts(seed):
    rng = random.Random(seed)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(60))) for _ in range(400)]
    out += ["".join(rng.choice("'sabre!1l") for _ in range(300)) for _ in range(40)]
    return out + ["".join(rng.choice(["th", "e", "r", "ing"]) for _ in range(400)) for _ in range(10)] + [prose(2000, seed)]


def test_a_word_beside_marks_is_encoded_once(library):
    """Control characters and bytes beyond ASCII have stand-ins; a word is looked up wherever it stands."""
    encoder = bpe_tree.TreeEncoder(WORD_BPE)
    odd_words = "a\x00b \x01 \x7f!\x80 ~\x85 \xad \xa1 it's we'll ABC's (the) the, ééé É!"
    assert encoder.encode(odd_words) == library.encode(odd_words, add_special_tokens=False).ids
    seen, own = [], encoder.word_ids
    encoder.word_ids = lambda word: seen.append(word) or own(word)
    encoder.encode("theing (theing) theing, theing! 'theing")
    assert seen.count("theing") == 1


def test_tree_equals_the_library_wherever_it_is_cut(library):
    encoder = bpe_tree.TreeEncoder(WORD_BPE, first_window=8)
    for text in texts(1):
        want = library.encode(text, add_special_tokens=False).ids
        for leaf in (7, 50, 10**9):
            assert encoder.encode(text, leaf) == want, (leaf, text)
        assert encoder.decode(want) == library.decode(want, skip_special_tokens=False)


def test_joins_use_windows_not_whole_texts(library):
    encoder = bpe_tree.TreeEncoder(WORD_BPE)
    spans, whole = encoder.spanned, []
    encoder.spanned = lambda text, base=0: whole.append(len(text)) or spans(text, base)
    text = prose(20_000, 3)
    encoder.encode(text, 4096)
    assert max(whole) <= 4096


def test_every_code_point_is_encoded_as_by_the_library(library):
    """Also those that are unassigned or newer than Python's tables, alone and next to letters, digits, marks."""
    encoder = bpe_tree.TreeEncoder(WORD_BPE)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x34000 or 0xE0000 <= c < 0xE0200 or c % 211 == 0)]
    texts = [" ".join(f"a{c}b {c} {c}'s 1{c}" for c in points[i : i + 16]) for i in range(0, len(points), 16)]
    for lo in range(0, len(texts), 5000):
        for text, want in zip(texts[lo : lo + 5000], library.encode_batch(texts[lo : lo + 5000], add_special_tokens=False), strict=True):
            assert encoder.encode(text) == want.ids, ascii(text)
        encoder.memo.clear()


def test_unknown_code_points_in_a_tree(library):
    encoder, rng = bpe_tree.TreeEncoder(WORD_BPE, first_window=8), random.Random(12)
    for _ in range(150):
        text = "".join(rng.choice([*PARTS, "\u0378", "\ua7cb", "\U0001c400", "\u1c89"]) for _ in range(rng.randrange(80)))
        want = library.encode(text, add_special_tokens=False).ids
        for leaf in (7, 30, 10**9):
            assert encoder.encode(text, leaf) == want, (leaf, text)


def rows_of(df):
    return Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect())


def expected(library, rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = Counter()
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        out[doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    return out


@pytest.mark.parametrize("leaf", [bpe_tree.LEAF_CHARS, 64])
def test_encode_odd_documents(spark, library, leaf):
    docs = clash(odd(spark), "ids", "decoded", "seg")
    assert rows_of(bpe_tree.digest(bpe_tree.encode(docs, WORD_BPE, leaf_chars=leaf))) == expected(library, ODD)


def test_encode_repeated_long_rows_and_empty_table(spark, library):
    rows = [(1, prose(200, 1))] * 5 + [(None, prose(300, 2))] * 2 + [(1, prose(300, 2))]
    assert rows_of(bpe_tree.digest(bpe_tree.encode(spark.createDataFrame(rows, SCHEMA), WORD_BPE, leaf_chars=100))) == expected(library, rows)
    assert bpe_tree.digest(bpe_tree.encode(spark.createDataFrame([], SCHEMA), WORD_BPE)).collect() == []


def test_counts_equal_the_library():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    merger = token_count.HeapMerger.load(PIECES)
    assert merger.by_word
    for text in texts(2):
        assert merger.count(text) == len(model.encode(text)), text
        assert text == "" or merger.merge_count(token_count.SPACE + text.replace(" ", token_count.SPACE)) == len(model.encode(text))


def test_count_odd_documents(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = token_count.count_tokens(clash(odd(spark), "n_tokens", "n_bytes"), PIECES, limit=3)
    assert sorted(out.columns) == ["doc_id", "n_bytes", "n_tokens", "other", "over_limit", "text"]
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect())
    want = Counter((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 3) for i, t in ODD)
    assert got == want
    assert token_count.count_tokens(spark.createDataFrame([], SCHEMA), PIECES).collect() == []


def test_memo_is_bounded():
    merger = token_count.HeapMerger({"ab": 1.0, "a": 2.0, "b": 3.0})
    merger.memo.entries = 10
    merger.counts([prose(50, k) for k in range(5)])
    assert len(merger.memo) <= 60


def test_paths_are_parameters():
    assert WORD_BPE == public_tokenizers.path("word_bpe_49k.json")
