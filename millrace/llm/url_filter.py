"""URL filters over a sorted digest array.

A list of entries (host and path start, with a verdict) is stored as a sorted array of 64-bit xxhash
keys, an array of offsets, and the entries' full texts. The files are sent to every executor and
mapped into memory there, so they cost pages, not heap. For a URL, every suffix of its host at a dot
(of at most the labels that some entry's host has) and every start of its path that has the length of
some entry's path is hashed; all keys of a batch are found by one vectorised binary search, and a hit
counts only if the stored text is equal. Of the hits the longest wins.

Lists are given in layers, as entries or as tables (entry, verdict): the first layer with a hit decides.
A list up to ``MAX_BYTES`` is mapped; a larger one is joined with the URLs' candidates by Spark
(:func:`judge_by_join`), with the same results.

Null URLs and URLs without ``://`` have empty host and path and fit no entry: verdict allow. URLs of any
length are judged whole. Repeated rows are each judged. Other columns stay, but those named like an
output are replaced.
"""

from __future__ import annotations

import mmap
import os
import re
import tempfile
from collections.abc import Iterable, Sequence

import numpy as np
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import new_folder
from .common import map_texts, tool

MAX_BYTES = 256 << 20
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Hosts of public block lists, for advertising and tracking.
AD_HOSTS = (
    "doubleclick.net googlesyndication.com googleadservices.com adnxs.com adsrvr.org criteo.com criteo.net taboola.com outbrain.com "
    "scorecardresearch.com quantserve.com rubiconproject.com pubmatic.com openx.net casalemedia.com advertising.com adform.net "
    "amazon-adsystem.com moatads.com bluekai.com demdex.net everesttech.net mathtag.com rlcdn.com tapad.com turn.com zedo.com "
    "adroll.com smartadserver.com yieldmo.com sharethrough.com popads.net propellerads.com exoclick.com trafficjunky.net mgid.com revcontent.com"
).split()
#: Hosts known for spam, betting, adult content, tracking and pill selling; their subdomains too.
BLOCKED_HOSTS = tuple(f"{name}.example.{top}" for name in ("spam-farm", "cheap-pills", "casino-win", "adult-x", "free-bets", "ads-track") for top in ("com", "net", "org")) + tuple(AD_HOSTS)
MAGIC = b"DIGARR02"
HOST_PATH = re.compile(r"([^/?#]*)([^?#]*)")

Entry = tuple[str, str]  # host and path start ("example.com/en/"), verdict


def path_length(text: bytes) -> int:
    return len(text[text.index(b"/") :].decode()) if b"/" in text else 0


def host_labels(text: bytes) -> int:
    return text.partition(b"/")[0].count(b".") + 1


def digest_bytes(entries: Iterable[Entry]) -> bytes:
    """The array's file: counts, path lengths, sorted keys, offsets, then each entry's verdict letter and text."""
    keyed = sorted((xxhash.xxh64_intdigest(text.encode()), text.encode(), verdict) for text, verdict in entries)
    blob = [verdict[0].encode() + text for _, text, verdict in keyed]
    keys = np.array([k for k, _, _ in keyed], np.uint64)
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blob])]).astype(np.uint64)
    lengths = np.array(sorted({path_length(text) for _, text, _ in keyed}), np.uint64)
    labels = max((host_labels(text) for _, text, _ in keyed), default=0)
    head = np.array([len(keyed), len(lengths), labels], np.uint64)
    return MAGIC + head.tobytes() + lengths.tobytes() + keys.tobytes() + offsets.tobytes() + b"".join(blob)


class DigestArray:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self.map[:8] != MAGIC:
            raise ValueError("not a digest array")
        n, m, self.labels = (int(x) for x in np.frombuffer(self.map, np.uint64, 3, 8))
        self.path_lengths = np.frombuffer(self.map, np.uint64, m, 32).astype(int).tolist()
        self.keys = np.frombuffer(self.map, np.uint64, n, 32 + 8 * m)
        self.offsets = np.frombuffer(self.map, np.uint64, n + 1, 32 + 8 * (m + n))
        self.blob_at = 32 + 8 * (m + 2 * n + 1)

    def entry(self, i: int) -> bytes:
        return self.map[self.blob_at + int(self.offsets[i]) : self.blob_at + int(self.offsets[i + 1])]

    def find(self, texts: Sequence[str]) -> list[str | None]:
        """The verdict letter of each text that is an entry."""
        probes = np.fromiter((xxhash.xxh64_intdigest(t.encode()) for t in texts), np.uint64, len(texts))
        places = np.searchsorted(self.keys, probes)
        inside = np.flatnonzero(places < len(self.keys))
        hit = inside[self.keys[places[inside]] == probes[inside]]
        out: list[str | None] = [None] * len(texts)
        for k in hit.tolist():
            i, wanted = int(places[k]), texts[k].encode()
            while i < len(self.keys) and self.keys[i] == probes[k]:  # equal keys stand together
                stored = self.entry(i)
                if stored[1:] == wanted:
                    out[k] = stored[:1].decode()
                    break
                i += 1
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    m = HOST_PATH.match(url, at + 3)
    return m[1].translate(ASCII_LOWER), m[2]


def candidates(host: str, path: str, path_lengths: Sequence[int], most_labels: int) -> list[str]:
    """Texts that an entry for this URL can have, longest first. Without a host there is none."""
    if not host or not most_labels:
        return []
    labels = host.rsplit(".", most_labels)
    if len(labels) > most_labels:
        labels = labels[1:]  # what stands before the last labels
    suffixes = [".".join(labels[i:]) for i in range(len(labels))]
    starts = [path[:n] for n in path_lengths if n <= len(path)]
    return sorted((s + p for s in suffixes for p in starts if s), key=lambda t: (-len(t), t))


class UrlJudge:
    def __init__(self, arrays: Sequence[DigestArray]):
        self.arrays = arrays

    def judge(self, urls: Sequence[str | None]) -> dict[str, list]:
        parts = [split_url(u) for u in urls]
        fits: list[str | None] = [None] * len(urls)
        said, layer = ["allow"] * len(urls), [None] * len(urls)
        for number, array in enumerate(self.arrays):
            tried = [candidates(h, p, array.path_lengths, array.labels) if f is None else [] for (h, p), f in zip(parts, fits, strict=True)]
            found = array.find([t for c in tried for t in c])
            at = 0
            for i, c in enumerate(tried):
                k = next((k for k in range(len(c)) if found[at + k]), None)
                if k is not None:
                    fits[i], said[i], layer[i] = c[k], "block" if found[at + k] == "b" else "allow", number
                at += len(c)
        return {"host": [h for h, _ in parts], "path": [p for _, p in parts], "fits": fits, "said": said, "layer": layer}


NEW = "host string, path string, fits string, said string, layer int"


def _judge(paths: tuple[str, ...]) -> UrlJudge:
    return tool(("urls", paths), lambda: UrlJudge([DigestArray(p) for p in paths]))


def send(spark: SparkSession, data: bytes) -> str:
    """Send an array to all executors, once in a session; its name there."""
    name = f"digests-{xxhash.xxh64_hexdigest(data)}.bin"
    sent = spark.sparkContext.__dict__.setdefault("_millrace_files", set())
    if name in sent:
        return name
    local = os.path.join(tempfile.mkdtemp(prefix="spark-"), name)
    with open(local, "wb") as f:
        f.write(data)
    spark.sparkContext.addFile(local)
    sent.add(name)
    return name


def judge_urls(df: DataFrame, layers: Sequence[Sequence[Entry] | DataFrame], url_col: str = "url", keep: list[str] | None = None) -> DataFrame:
    """Add host, path, fits (the longest fitting entry of the first layer that has one, or null), said
    (allow or block) and the layer's number. A layer is a list of entries or a table (entry, verdict)."""
    spark = df.sparkSession
    size = 0
    for entries in layers:
        if isinstance(entries, DataFrame):
            wrong = F.col("entry").isNull() | F.col("entry").rlike("^(/|$)") | ~F.col("verdict").isin("allow", "block") | F.col("verdict").isNull()
            seen = entries.agg(F.sum(F.octet_length("entry") + 40).alias("bytes"), F.max(F.when(wrong, F.concat_ws(", ", "entry", "verdict"))).alias("wrong")).first()
            if seen.wrong is not None:
                raise ValueError(f"not an entry: {seen.wrong}")
            size += seen.bytes or 0
        else:
            checked(entries)
            size += sum(len(text) + 40 for text, _ in entries)
    if size > MAX_BYTES:
        return judge_by_join(df, [e if isinstance(e, DataFrame) else spark.createDataFrame(list(e), "entry string, verdict string") for e in layers], url_col, keep)
    lists = [[(r.entry, r.verdict) for r in e.select("entry", "verdict").collect()] if isinstance(e, DataFrame) else e for e in layers]  # MAX_BYTES at most
    names = [send(spark, digest_bytes(entries)) for entries in lists]
    return map_texts(df, lambda: _judge(tuple(map(SparkFiles.get, names))).judge, NEW, url_col, keep)


def checked(entries: Iterable[Entry]) -> None:
    for text, verdict in entries:
        if not text or text.startswith("/") or verdict not in ("allow", "block"):
            raise ValueError(f"not an entry: {text!r}, {verdict!r}")


def judge_by_join(df: DataFrame, layers: Sequence[DataFrame], url_col: str = "url", keep: list[str] | None = None) -> DataFrame:
    """The same for lists of any size, tables (entry, verdict): candidates meet entries in a shuffle."""
    size = F.when(F.instr("entry", "/") > 0, F.length("entry") - F.instr("entry", "/") + 1).otherwise(0)
    listed = None
    for number, entries in enumerate(layers):
        one = entries.select("entry", "verdict", size.alias("n"), F.lit(number).alias("layer"))
        listed = one if listed is None else listed.unionAll(one)
    lengths = sorted(r.n for r in listed.select("n").distinct().collect())  # path lengths: a few dozen
    labels = listed.agg(F.max(F.size(F.split(F.split("entry", "/")[0], r"\.")))).first()[0] or 0
    kept = [c for c in (df.columns if keep is None else keep) if c not in ("host", "path", "fits", "said", "layer")]

    def make():
        def run(urls):
            parts = [split_url(u) for u in urls]
            return {"host": [h for h, _ in parts], "path": [p for _, p in parts], "__tried": [candidates(h, p, lengths, labels) for h, p in parts]}

        return run

    # each distinct URL is looked up once, so that a URL of many rows is no hot key
    tried = map_texts(df.select(F.col(url_col).alias("__url")).distinct(), make, "host string, path string, __tried array<string>", "__url")
    path = new_folder(df.sparkSession, "urls")
    tried.write.parquet(path)
    tried = df.sparkSession.read.schema(tried.schema).parquet(path)
    best = tried.select("__url", F.explode("__tried").alias("entry")).join(listed, "entry").groupBy("__url").agg(
        F.min_by(F.struct("entry", "verdict", "layer"), F.struct("layer", -F.length("entry"), "entry")).alias("__best"))
    looked = tried.drop("__tried").join(best, "__url", "left")
    out = df.select(*kept, F.col(url_col).alias("__u")).join(looked, F.col("__u").eqNullSafe(F.col("__url")), "left")
    return out.select(*kept, "host", "path", F.col("__best.entry").alias("fits"), F.coalesce("__best.verdict", F.lit("allow")).alias("said"), F.col("__best.layer").alias("layer"))
