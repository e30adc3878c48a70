"""One registered query for each operator, over the whole of its table and whole texts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_tree, decontaminate, fertility, language_id, line_dedup, lz_fingerprint, order_minhash, periodic_runs, secret_scan, spelling, token_count, toxicity, url_filter
from .common import remainder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


@query("op1_bpe_tree")
def op1(spark, sf_dir):
    return bpe_tree.digest(bpe_tree.encode(table(spark, sf_dir, "documents", "doc_id", "text"), WORD_BPE))


@query("op2_language_id")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumn("part", remainder("doc_id", 3))
    model = language_id.learn(docs.filter("part <> 1"), PIECES)
    held_out = F.coalesce(F.col("part") == 1, F.lit(False)).alias("held_out")
    return language_id.predict(docs.select("doc_id", held_out, "text"), model, PIECES, keep=["doc_id", "held_out"])


@query("op3_token_count")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return token_count.count_tokens(docs, PIECES, keep=["doc_id"]).select("doc_id", "n_bytes", "n_tokens", "over_limit")


TOXIC = 0.3


def toxic_scores(spark: SparkSession, docs: DataFrame, sf_dir: str, keep: list[str], out: str = "score") -> DataFrame:
    """``docs`` with a score; learned from the labels outside the held-out fourth."""
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").filter(remainder("doc_id", 4) != 2)
    return toxicity.score(docs, toxicity.learn(docs.select("doc_id", "text"), labels), keep=keep, out=out)


@query("op4_toxicity")
def op4(spark, sf_dir):
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", held_out, "text")
    return toxic_scores(spark, docs, sf_dir, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= TOXIC).cast("int"))


@query("op5_fertility")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    measured = fertility.measure(docs, PIECES, BYTE_RANKS, public_tokenizers.PATTERN, keep=["doc_id", "lang"])
    return fertility.judge_fitted(measured, F.coalesce("lang", "script")).drop("lang")


_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op6_line_dedup", f"""with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
lines as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from split),
keyed as (select *, {_KEY} as k from lines),
common as (select k, max(doc_id) as last from keyed where length(k) >= 40 group by k having count(distinct doc_id) >= 5),
marked as (select keyed.*, common.k is not null and doc_id < last as lost from keyed left join common using (k))
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (lost) as bigint) as n_dropped,
 sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not lost), '')) as kept_sha256 from marked group by doc_id""")  # fmt: skip
def op6(spark, sf_dir):
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


URL_RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
_RULES = ", ".join(f"('{text.split('/')[0]}', '{text[text.index('/'):]}', '{verdict}')" for text, verdict in URL_RULES)
_HOSTS = ", ".join(f"('{h}')" for h in url_filter.BLOCKED_HOSTS)


@query("op7_url_filter", f"""with p as (select page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
 coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
r(h, s, v) as (values {_RULES}), b(h) as (values {_HOSTS}),
hits as (select page_id, h || s as rule, v, row_number() over (partition by page_id order by length(h || s) desc, h || s) as n from p join r
 on (host = h or ends_with(host, '.' || h)) and starts_with(path, s)),
listed as (select distinct page_id from p join b on host = h or ends_with(host, '.' || h))
select p.page_id, host, path, rule, coalesce(v, case when listed.page_id is not null then 'block' else 'allow' end) as verdict
from p left join hits on p.page_id = hits.page_id and n = 1 left join listed on p.page_id = listed.page_id""")  # fmt: skip
def op7(spark, sf_dir):
    layers = [URL_RULES, [(h, "block") for h in url_filter.BLOCKED_HOSTS]]
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages", "page_id", "url"), layers, keep=["page_id"])
    return judged.select("page_id", "host", "path", F.when(F.col("layer") == 0, F.col("fits")).alias("rule"), F.col("said").alias("verdict"))


@query("op8_decontaminate")
def op8(spark, sf_dir):
    """A row for each document and test item that it holds."""
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    found = decontaminate.find_leaks(docs, items, keep=["doc_id"])
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")


@query("op9_order_minhash")
def op9(spark, sf_dir):
    """A row for each document with its class."""
    return order_minhash.classify(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op10_secret_scan")
def op10(spark, sf_dir):
    return secret_scan.span_digest(secret_scan.scan_secrets(table(spark, sf_dir, "documents", "doc_id", "text"), BYTE_RANKS, keep=["doc_id"], price_fixed=False))


@query("op11_spelling_variants")
def op11(spark, sf_dir):
    words = spelling.words_of(table(spark, sf_dir, "documents", "doc_id", "text"), keep=("doc_id",))
    return spelling.variants(spelling.slips(words, "doc_id"))


@query("op12_lz_fingerprint")
def op12(spark, sf_dir):
    return lz_fingerprint.edit_digest(lz_fingerprint.beside_next(table(spark, sf_dir, "documents", "doc_id", "text")))


@query("op13_periodic_runs")
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    docs = docs.select("doc_id", periodic_runs.looped(F.col("doc_id"), F.col("text")).alias("text"))
    return periodic_runs.run_digest(periodic_runs.find_runs(docs, keep=["doc_id"]))
