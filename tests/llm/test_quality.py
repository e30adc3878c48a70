"""Fertility rules, secret scans, URL filters."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from millrace.llm import fertility, queries, secret_scan, url_filter
from millrace.llm.queries import BYTE_RANKS, PIECES

from .helpers import ODD, SCHEMA, clash, odd, prose

FILES = (PIECES, BYTE_RANKS, public_tokenizers.PATTERN)


def words_and_lines(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for w in words for c in w), len(lines) - len(set(lines)), len(hit)


TEXTS = [*ODD, (20, "a b c a b c d\nx\nx\n\nx"), (21, "# * $ % & | < > a#b"), (22, " ".join(["spam"] * 500)), (23, prose(300, 1)), (24, "\x1c\x85\xa0 a")]


def test_fertility_of_odd_documents(spark):
    docs = spark.createDataFrame(TEXTS, SCHEMA)
    out = fertility.judge(fertility.measure(clash(docs, "n_words", "script"), *FILES))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out.collect())
    assert got == Counter((i, *words_and_lines(t)) for i, t in TEXTS)
    by_id = {r.doc_id: r for r in out.collect()}
    assert by_id[23].kept and not by_id[22].kept and by_id[22].base_failed and by_id[1].base_failed
    assert fertility.judge(fertility.measure(spark.createDataFrame([], SCHEMA), *FILES)).collect() == []


def test_fertility_measures_equal_plain_ones():
    import sentencepiece

    f, model = fertility.Fertility(*FILES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    text = prose(120, 4) + " 中文 😀😀 ж"
    found = f.columns([text])
    ids = [i for w in text.encode().split() for i in model.encode(w.decode())]
    p = [n / len(ids) for n in Counter(ids).values()]
    assert math.isclose(found["entropy_share"][0], -sum(x * math.log2(x) for x in p) / math.log2(len(ids)))
    assert math.isclose(found["fallback_share"][0], sum(map(model.is_byte, ids)) / len(ids))
    assert math.isclose(found["chars_per_piece"][0], words_and_lines(text)[1] / len(ids))


def test_long_words_repeat():
    f = fertility.Fertility(*FILES)
    lines = ["中文" * 12 + "字", "https://example.com/" + "a/b" * 40, "Zm9v" * 5000]
    text = "\n".join(lines * 100)
    assert all(len(w.encode()) > 64 for w in lines)
    for _ in range(2):
        assert f.columns([text, lines[0]])["n_repeat_words"] == [300, 0]
    assert len(f.scripts) == 4  # row 0, and a row for each of the words


def test_tables_of_long_words_stay_small(monkeypatch):
    monkeypatch.setattr(fertility, "TABLE_BYTES", 1000)
    f = fertility.Fertility(*FILES)
    for k in range(5):
        word = f"{k}x" * 600
        assert f.columns([" ".join([word] * 9)])["n_repeat_words"] == [9]
        assert len(f.scripts) == 1 and not f.memo


def test_bands_reject(spark):
    noise = " ".join("\U0001d504\U0001f9ff" for _ in range(80))  # byte fallbacks only
    row = fertility.judge(fertility.measure(spark.createDataFrame([(1, noise)], SCHEMA), *FILES)).first()
    assert row.fallback_share > 0.8 and not row.in_band and not row.kept


def bands_plainly(rows, spread=2.0, least=50):
    """kept by the fitted bands alone, for rows (group, n_words, measures by name); quartiles of all values."""
    import math
    from collections import defaultdict

    size = lambda n: min(int(math.log2(max(n, 1))), 11)
    classes = defaultdict(list)
    for g, n, m in rows:
        classes[g, size(n)].append(m)
        classes[g, None].append(m)

    def inside(g, n, m):
        of = next((classes[k] for k in ((g, size(n)), (g, None)) if len(classes[k]) >= least), None)
        if of is None:
            return True
        for name, (low, high) in fertility.MEASURES.items():
            values = sorted(x[name] for x in of)
            a, b = (values[max(0, math.ceil(q * len(values)) - 1)] for q in (0.25, 0.75))
            reach = spread * max(b - a, 0.01)
            if low and m[name] < a - reach or high and m[name] > b + reach:
                return False
        return True

    return [inside(*r) for r in rows]


def test_fitted_bands_equal_plain_quartiles(spark):
    rng = random.Random(12)
    rows = []
    for k in range(700):
        g, n = rng.choice(["a", "a", "a", "b", "c"]), rng.choice([55, 60, 100, 300, 5_000])
        odd_one = rng.random() < 0.1
        rows.append((k, n, 0 if rng.random() < 0.95 else n, "latin", rng.gauss(2.2, 0.05) - 0.5 * odd_one, rng.gauss(2.0, 0.05), rng.choice([0.0, 0.0, 0.01, 0.2]), rng.gauss(0.7, 0.05) - 0.2 * odd_one, g))
    rows += [(1000 + k, 60, 0, "latin", 2.0, 2.0, 0.0, 0.7, "few") for k in range(49)] + [(2000, 60, 0, "latin", 6.9, 6.9, 0.2, 0.5, "few")]
    schema = "doc_id long, n_words long, n_repeat_words long, script string, chars_per_piece double, chars_per_byte_token double, fallback_share double, entropy_share double, g string"
    from pyspark.sql import functions as F

    out = {r.doc_id: r for r in fertility.judge_fitted(spark.createDataFrame(rows, schema).repartition(5), F.col("g")).collect()}
    passed = [r for r in rows if r[2] == 0]
    plain = bands_plainly([(r[8], r[1], dict(zip(fertility.MEASURES, r[4:8], strict=True))) for r in passed])
    assert [out[r[0]].kept for r in passed] == plain and 20 < plain.count(False) < 200
    assert len(out) == len(rows) and not any(out[r[0]].kept for r in rows if r[2])


def test_bands_reject_junk_and_keep_clean_texts(spark):
    """The labels of the table say which texts are junk; what the base rule leaves of them is for the bands."""
    sf = "/root/testdata/sf0.1"
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op5_fertility"](spark, sf).collect() if not r.base_failed and r.doc_id in good]
    rejected = lambda q: sum(not r.kept for r in rows if good[r.doc_id] == q) / sum(good[r.doc_id] == q for r in rows)
    assert rejected(0) > 0.75 and rejected(1) < 0.015, (rejected(0), rejected(1))


def test_fitted_bands_of_odd_tables(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = clash(odd(spark), "lang", "group", "size", "n_words").withColumn("lang", F.lit(None).cast("string"))
    docs.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    out = queries.QUERIES["op5_fertility"](spark, str(tmp_path / "a"))
    assert out.count() == len(ODD) and out.columns[0] == "doc_id" and out.columns[-3:] == ["base_failed", "in_band", "kept"]
    assert out.filter("kept is null or base_failed is null").isEmpty() and queries.QUERIES["op5_fertility"](spark, str(tmp_path / "b")).count() == 0


def test_repeated_words_with_large_numbers():
    import numpy as np

    words = np.array([5, 6, 7, 9, 5, 6, 7])
    assert fertility.repeated_words(words) == fertility.repeated_words(words << 40) == 6


# Secrets.

SECRET_TEXTS = [
    *ODD, (30, 'password: token: abcdefghij PASSWD="abcdefgh1" secret=short api-key=xx api_key := no API_KEY="0123456789"'), (31, "AKIA" + "A" * 12 + " AKIAshort AKIA" + "B" * 20),
    (32, "0123456789abcdef" * 2 + "g" + "f" * 31 + " " + "a" * 40), (33, "é😀 token=ééé token = 'abc/def+ghi=' ſecret=abcdefghijk"), (34, "the password is xK9#mQ2$vL7! and the pwd -> password123"),
    (35, "token=token=abcdefghijkl"),
]


def base_spans(text):
    text, out = text or "", []
    case = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join([*map(case, ["password", "passwd", "secret", "token"]), case("api") + "_?" + case("key")])
    for m in re.finditer(rf"({names})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


def test_secrets_of_odd_documents(spark):
    out = secret_scan.span_digest(secret_scan.scan_secrets(clash(spark.createDataFrame(SECRET_TEXTS, SCHEMA), "found"))).collect()
    want = Counter()
    for i, t in SECRET_TEXTS:
        spans = base_spans(t)
        n = Counter(k for k, *_ in spans)
        want[i, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in out) == want
    assert [x for x in next(r for r in out if r.doc_id == 34).spans.split(",") if x.startswith("guess")] == ["guess:16:27"]
    assert secret_scan.scan_secrets(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("value", ["password1", "qwe123", "aaaa1", "2021ab", "P@ss", "abab", "zxcv9"])
def test_guess_cost_is_the_least_of_all_cuts(value):
    g = secret_scan.GuessCost()
    begun = g.segments(value)

    def every(at, first):
        if at == len(value):
            yield 0.0
        for end, price, kind in begun[at] if at < len(value) else ():
            for rest in every(end, False):
                yield price + (0.3 if not first and kind != "brute" else 0.0) + rest

    assert math.isclose(g.cheapest(value)[0], min(every(0, True)))


def cheapest_plainly(g, value):
    """Least cost over all cuts, from each segment's definition, for values without words, walks and long runs of a character."""
    n, each, best = len(value), math.log10(g.alphabet(value)), [0.0] + [math.inf] * len(value)
    for i in range(n):
        ends = {i + 1: (each, 0.0)}
        more = lambda j, c, ends=ends: ends.__setitem__(j, min(ends.get(j, (math.inf, 0)), (c, 0.3)))
        for size in range(2, (n - i) // 2 + 1):
            block = value[i : i + size]
            if any(block == block[:d] * (size // d) for d in range(1, size) if size % d == 0):
                continue
            times = 1
            while value.startswith(block, i + times * size):
                times += 1
            for t in range(max(2, times - 3), times + 1):
                more(i + t * size, size * each + math.log10(t))
        for j in range(i + 4, min(n, i + 10) + 1):
            if secret_scan.DATE.fullmatch(value[i:j]):
                more(j, 2.1 if j - i == 4 else 4.6)
        for j, (c, extra) in ends.items():
            best[j] = min(best[j], best[i] + c + (extra if i else 0.0))
    return best[n]


def test_repeats_of_any_block_and_all_date_ends():
    g, rng = secret_scan.GuessCost(), random.Random(21)
    for _ in range(300):
        unit = "".join(rng.choice("\u00e9\u0416\u4e2d\u03a9\u05d0") for _ in range(rng.randrange(1, 12)))
        value = unit * rng.randrange(1, 5) + rng.choice(["", "19991231", "2024", "1201999", "31.12.1999"]) + unit[: rng.randrange(3)] * 2
        if not re.search(r"(.)\1\1", value):
            assert math.isclose(g.cheapest(value)[0], cheapest_plainly(g, value)), value
    chars = "".join(random.Random(1).sample("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 60)) * 20
    for size in (16, 17, 60, 1_000):
        block = "".join(random.Random(size).choice(chars) for _ in range(size))
        once, often = g.cheapest(block)[0], g.cheapest(block * 4)[0]
        assert often < once + size * 0.1 + 2, (size, once, often)


def test_any_blanks_before_a_value():
    scan = secret_scan.Scanner().scan
    for between in (":", " : ", "     =      ", "\t=\t", " \t  =>", "  is \t "):
        text = f"the password{between}xK9#mQ2$vL7!pR"
        assert [s[:3] for s in scan(text) if s[0] == "guess"] == [("guess", len(text) - 14, len(text))], between


def test_a_value_of_a_megabyte():
    import time
    import tracemalloc

    rng = random.Random(5)
    text = "token := " + "".join(rng.choice("abcdef0123456789XYZ#") for _ in range(1_000_000))
    scanner, began = secret_scan.Scanner(price_fixed=False), time.process_time()
    found = scanner.scan(text)
    assert [s[:3] for s in found if s[0] == "guess"] == [("guess", 9, len(text))] and time.process_time() - began < 60
    tracemalloc.start()
    scanner.scan(text[: 200_000])
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()
    assert all(s[3] is None for s in scanner.scan("f" * 64 + " AKIA" + "B" * 30)) and all(s[3] for s in secret_scan.Scanner().scan("f" * 64))


def test_guess_cost_equals_listing_all_segments():
    g, rng = secret_scan.GuessCost(), random.Random(8)
    for _ in range(300):
        parts = ["a" * rng.randrange(1, 9), "qwqw"[: rng.randrange(5)] * rng.randrange(9), "zxcvbnm", "asdfdsa", "pass", "assss", "P@ssw0rd", "2000", "x9K#"]
        value = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) or "a"
        cost, begun = [0.0] + [math.inf] * len(value), g.segments(value)
        for i in range(len(value)):
            for j, price, kind in begun[i]:
                cost[j] = min(cost[j], cost[i] + price + (0.3 if i and kind != "brute" else 0.0))
        found, cut = g.cheapest(value)
        assert math.isclose(found, cost[-1]) and [0, *[j for _, j, _ in cut]] == [*[i for i, _, _ in cut], len(value)]


@pytest.mark.parametrize("n", [128, 129, 5000])
def test_long_values_are_taken_whole(n):
    rng, cost = random.Random(n), secret_scan.GuessCost().cheapest
    value = "".join(rng.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(n))
    spans = secret_scan.Scanner().scan(f"the token: {value}. And more")
    assert [s[:3] for s in spans if s[0] == "guess"] == [("guess", 11, 11 + n)]
    late = "k" * n + "xK9#mQ2$vL7%"  # cheap at first
    assert cost(late)[0] > cost("k" * n)[0] + 10
    assert [s[:3] for s in secret_scan.Scanner().scan(f"the secret is {late} ")] == [("guess", 14, 14 + len(late))]
    for cheap in ("k" * n, ("qw" * n)[:n], ("xyz" * n)[: n - n % 3]):
        assert cost(cheap)[0] < 10 and not secret_scan.Scanner().scan(f"the secret is {cheap} ")


def test_words_of_a_public_vocabulary_make_a_passphrase_cheap():
    words = secret_scan.vocabulary_words(queries.BYTE_RANKS)
    assert len(words) > 10_000 and words[0] == "the" and all(w == w.lower() for w in words)
    g = secret_scan.GuessCost([*secret_scan.COMMON, *words])
    for value, cut in (("correcthorsebatterystaple", ["correct", "horse", "battery", "staple"]), ("thequickbrownhorse", ["the", "quick", "brown", "horse"])):
        assert [value[i:j] for i, j, kind in g.cheapest(value)[1] if kind == "word"] == cut
        assert g.cheapest(value)[0] < secret_scan.GuessCost().cheapest(value)[0]
    assert g.cheapest("xK9#mQ2$vL7!pR4&")[0] > 20


def test_guess_cost_orders_values():
    cost = lambda v: secret_scan.GuessCost().cheapest(v)[0]
    values = ["password", "P@ssw0rd2020", "qwertyuiop12", "xK9#mQ2$vL7!"]
    assert [cost(v) for v in values] == sorted(cost(v) for v in values)
    assert cost("aaaaaaaaaaaa") < cost("kdjfhgqmwnrt") and cost("1987-05-12") < 6


# URLs.

URLS = [
    "http://A.Example.COM/en/7x?q#f", "https://example.com/en/8", "http://x.net/de/8", "http://a.example.net/de/80", "http://notexample.net/de/8", "http://o.org/es/", "http://o.org/es",
    "http://spam-farm.example.org", "http://www.spam-farm.example.org?x=/", "http://myspam-farm.example.org/", "nothing", "", None, "x://", "http://com/en/", "http://com#/en/", "a://b://c/d",
    "http://cheap-pills.example.net/de/1", "http://É.example.com/en/é", "http://..org/es/1",
]


def judge_plainly(url, rules, blocked):
    m = re.search(r"(?s)://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = []
    for text, verdict in rules:
        h, p = text[: text.index("/")], text[text.index("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(text), text, verdict))
    rule, verdict = max(fits)[1:] if fits else (None, "block" if any(host == b or host.endswith("." + b) for b in blocked) else "allow")
    return host, path, rule, verdict


def layers():
    return [queries.URL_RULES, [(h, "block") for h in url_filter.BLOCKED_HOSTS]]


@pytest.mark.parametrize("by_join", [False, True])
def test_urls(spark, by_join):
    pages = clash(spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] * 2, "page_id long, url string"), "host", "layer")
    if by_join:
        tables = [spark.createDataFrame(list(x), "entry string, verdict string") for x in layers()]
        out = url_filter.judge_by_join(pages, tables)
    else:
        out = url_filter.judge_urls(pages, layers())
    assert out.columns == ["page_id", "url", "other", "host", "path", "fits", "said", "layer"]
    got = Counter((r.page_id, r.host, r.path, r.fits if r.layer == 0 else None, r.said) for r in out.collect())
    want = Counter()
    for i, u in enumerate(URLS):
        want[(i, *judge_plainly(u, queries.URL_RULES, url_filter.BLOCKED_HOSTS))] += 2
    assert got == want


def test_one_list_serves_many_calls(spark):
    pages = spark.createDataFrame([(1, URLS[0])], "page_id long, url string")
    for _ in range(2):
        assert url_filter.judge_urls(pages, layers()).first().said == "allow"


def test_lists_may_be_tables(spark, monkeypatch):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    tables = [spark.createDataFrame(list(x), "entry string, verdict string") for x in layers()]
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(url_filter.judge_urls(pages, layers()))
    assert rows(url_filter.judge_urls(pages, tables)) == want
    monkeypatch.setattr(url_filter, "MAX_BYTES", 100)
    assert rows(url_filter.judge_urls(pages, tables)) == want
    with pytest.raises(ValueError):
        url_filter.judge_urls(pages, [spark.createDataFrame([("a.b", "maybe")], "entry string, verdict string")])


def test_very_long_urls(spark):
    urls = ["http://" + "a." * 500_000 + "x.org/es/1", "http://x.com/en/" + "p/" * 500_000, "http://" + "h" * 1_000_000, "http://" + "." * 1_000_000 + "spam-farm.example.org"]
    assert max(len(url_filter.candidates(*url_filter.split_url(u), [0, 4], 3)) for u in urls) <= 6
    out = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), layers()).collect()
    want = [judge_plainly(u, queries.URL_RULES, url_filter.BLOCKED_HOSTS) for u in urls]
    assert [(r.host, r.path, r.fits if r.layer == 0 else None, r.said) for r in sorted(out, key=lambda r: r.page_id)] == want


def test_urls_of_an_empty_table_and_bad_entries(spark):
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), layers()).collect() == []
    with pytest.raises(ValueError):
        url_filter.judge_urls(spark.createDataFrame([], "url string"), [[("/x", "block")]])


def test_a_hit_is_confirmed_by_its_text(tmp_path, monkeypatch):
    entries = [("one.example/", "block"), ("two.example/", "allow")]
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: 7)  # all keys collide
    (tmp_path / "a").write_bytes(url_filter.digest_bytes(entries))
    array = url_filter.DigestArray(str(tmp_path / "a"))
    assert array.find(["one.example/", "two.example/", "three.example/"]) == ["b", "a", None]


def test_digest_array_finds_all_and_only_its_entries(tmp_path):
    texts = [f"h{i}.example/{i % 7}" for i in range(5000)]
    (tmp_path / "a").write_bytes(url_filter.digest_bytes((t, "block") for t in texts[::2]))
    found = url_filter.DigestArray(str(tmp_path / "a")).find(texts)
    assert found == list(itertools.islice(itertools.cycle(["b", None]), 5000))


def test_registered_queries_run(spark):
    sf = "/root/testdata/sf0.001"
    for name in ("op5_fertility", "op7_url_filter", "op10_secret_scan"):
        assert queries.QUERIES[name](spark, sf).agg(F.count(F.lit(1))).first()[0] > 0
