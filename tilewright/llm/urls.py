"""URL filter: rules first, then naive Bayes over segmented host and path words.

Host labels such as ``cheappills`` are split into words by the most likely sequence under a unigram
model (Viterbi); the unigrams are the words of all page titles and the seed words. Multinomial naive
Bayes learns from all pages: those whose segmented host has a seed word are examples of what to block,
the others of what to allow. So words that go with the seeds count too. Rules speak of sections, not of
unwanted hosts, so they are no labels; where one fits, it decides. Counts cover all rows, and every word
and token has its own: they are looked up by joins, the most used keys by broadcast, the others by shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.common import stored

#: Keys of a lookup that travel to every task, and letters of the longest word.
LIMIT, LONGEST = 100_000, 20
#: Letters that a row of such a lookup has on average at most.
WIDTH = 100
#: Verdict, host and path prefix of each rule.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Host words of unwanted sites.
SEEDS = (
    "ad", "ads", "adult", "bet", "bets", "betting", "bingo", "casino", "click", "dating", "diet", "escort", "gambling", "hack", "jackpot", "keygen",
    "loan", "loans", "lottery", "malware", "nude", "payday", "pharma", "phish", "phishing", "pill", "pills", "poker", "porn", "replica", "scam", "sex",
    "slots", "spam", "torrent", "track", "tracker", "tracking", "viagra", "virus", "warez", "xxx",
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Both are empty where the url is null or has no ``://``."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path")


def ruled(rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits ``host`` and ``path``; null if none does."""
    rule = verdict = None
    for v, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule.alias("rule"), verdict.alias("ruled")


@dataclass
class Unigrams:
    """Log probabilities of words; an unknown string costs ten times more with each letter."""

    costs: dict[str, float] = field(default_factory=dict)
    total: float = 1.0

    def cost(self, word: str) -> float:
        known = self.costs.get(word)
        return known if known is not None else math.log(self.total + 1) + len(word) * math.log(10)

    def split(self, label: str) -> list[str]:
        """The cheapest segmentation; of equal ones that with the longest last word."""
        best, last = [0.0], [0]
        for end in range(1, len(label) + 1):
            cost, start = min((best[s] + self.cost(label[s:end]), s) for s in range(max(0, end - LONGEST), end))
            best.append(cost)
            last.append(start)
        out, end = [], len(label)
        while end:
            out.append(label[last[end] : end])
            end = last[end]
        return out[::-1]


def looked_up(rows: DataFrame, table: DataFrame, key: str, uses: str, size: Column | None = None) -> DataFrame:
    """Inner join with a table of distinct keys; whatever its size, no key that many rows use is shuffled.

    ``size``: letters of a row, where rows may be long; then ``LIMIT`` rows of ``WIDTH`` letters travel at most.
    """
    n, letters = table.agg(F.count("*"), F.sum(F.lit(0) if size is None else size)).first()
    if n <= LIMIT and (letters or 0) <= LIMIT * WIDTH:
        return rows.join(F.broadcast(table.drop(uses)), key)
    most = table if size is None else table.where(size <= WIDTH * 1000)
    hot = F.broadcast(stored(most.orderBy(F.desc(uses), key).limit(LIMIT if size is None else max(LIMIT // 1000, 1)), "hot"))
    rest = table.join(hot.select(key), key, "left_anti")
    near, far = rows.join(hot.drop(uses), key), rows.join(hot.select(key), key, "left_anti").join(rest.drop(uses), key)
    return near.unionByName(far)


def unigrams(pages: DataFrame, html: str = "html") -> tuple[DataFrame, float]:
    """``(word, count)`` over the titles of all pages, and the sum of the counts."""
    title = F.regexp_extract(F.coalesce(F.col(html), F.lit("")), r"(?is)<title[^>]*>(.*?)</title", 1)
    every = pages.select(F.explode(F.regexp_extract_all(F.lower(title), F.lit(r"\p{L}{2,20}"), F.lit(0))).alias("word"))
    counts = stored(every.groupBy("word").count(), "words")
    return counts, float(counts.agg(F.sum("count")).first()[0] or 1)


_NAME = re.compile(r"[^\W\d_]+|\d+")


def segmented(hosts: DataFrame, counts: DataFrame, total: float, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """``(host, words)`` of distinct hosts; a seed word counts as one in a thousand words at least."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for host in b.column(0).to_pylist():
                names = [x for x in _NAME.findall(host) if not x.isdigit()]
                rows += [(host, w) for w in {x[i:j] for x in names for i in range(len(x)) for j in range(i + 2, min(i + LONGEST, len(x)) + 1)}]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else ((), ()))], names=["host", "word"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = []
            for host, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                costs = {r["word"]: -math.log(r["count"] / total) for r in known or ()}
                model = Unigrams(costs | {w: min(costs.get(w, math.inf), math.log(1000)) for w in seeds}, total)
                words.append([w for label in host.split(".") for x in _NAME.findall(label) for w in (["#"] if x.isdigit() else model.split(x))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))], names=["host", "words"])

    pieces = stored(hosts.mapInArrow(cut, "host string, word string"), "pieces")
    table = stored(counts.join(pieces.groupBy("word").agg(F.count("*").alias("uses")), "word"), "known-words")
    known = looked_up(pieces, table, "word", "uses").groupBy("host").agg(F.collect_list(F.struct("word", "count")).alias("known"))
    return hosts.join(known, "host", "left").select("host", "known").mapInArrow(split, "host string, words array<string>")


def tokenized(rows: DataFrame) -> DataFrame:
    """``rows`` (with path and host words) and their ``tokens``: host and path words, each with its place; numbers are one token."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, to = b.schema.get_field_index("words"), b.schema.get_field_index("path")
            names = (_NAME.findall(p.lower()) for p in b.column(to).to_pylist())
            tokens = [["h:" + x for x in w] + ["p:#" if x.isdigit() else "p:" + x for x in n] for w, n in zip(b.column(at).to_pylist(), names)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tokens, pa.list_(pa.string()))], names=[*b.schema.names, "tokens"])

    return rows.mapInArrow(split, T.StructType([*rows.schema.fields, T.StructField("tokens", T.ArrayType(T.StringType()))]))


def fit_bayes(rows: DataFrame) -> tuple[float, DataFrame | None]:
    """From ``(tokens, label)``: the prior and ``(token, odds, uses)``, log odds of block against allow.

    With rows of one class only, or none, everything is allowed.
    """
    classes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(classes) < 2:
        return -1.0, None
    block, allow = (F.sum(F.when(F.col("label") == c, 1).otherwise(0)).alias(c) for c in ("block", "allow"))
    counts = stored(rows.select("label", F.explode("tokens").alias("token")).groupBy("token").agg(block, allow), "url-tokens")
    whole = counts.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.count("*").alias("n")).first()
    prior = math.log(classes["block"] / classes["allow"])
    if not whole.n:
        return prior, None
    odds = F.log((F.col("block") + 1) / (whole.block + whole.n)) - F.log((F.col("allow") + 1) / (whole.allow + whole.n))
    return prior, counts.select("token", odds.alias("odds"), (F.col("block") + F.col("allow")).alias("uses"))


def judge(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", rules=RULES, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` of every row.

    ``score`` is the log odds for block; the verdict is the rule's, else ``block`` above 0 and ``allow``
    otherwise. A url that is null or has no host is judged by the prior.
    """
    counts, total = unigrams(pages, html)
    parts = pages.select(F.col(id_col).alias("page_id"), *host_and_path(url)).select("page_id", "host", "path", *ruled(rules))
    hosts = stored(parts.groupBy("host").agg(F.count("*").alias("uses")), "hosts")
    split = stored(segmented(hosts.select("host"), counts, total, seeds).join(hosts, "host"), "host-words")
    rows = stored(tokenized(looked_up(parts, split, "host", "uses")).withColumn("row", F.monotonically_increasing_id()), "urls")
    seeded = F.arrays_overlap("tokens", F.array(*[F.lit("h:" + w) for w in seeds]))
    prior, odds = fit_bayes(rows.select("tokens", F.when(seeded, "block").otherwise("allow").alias("label")))
    score = F.lit(prior)
    if odds is not None:
        each = looked_up(rows.select("row", F.posexplode("tokens").alias("at", "token")), odds, "token", "uses")
        # summed in the order of the url, so that no run differs in the last bit
        summed = F.aggregate(F.array_sort(F.collect_list(F.struct("at", "odds"))), F.lit(0.0), lambda x, t: x + t["odds"])
        rows = rows.join(each.groupBy("row").agg(summed.alias("sum")), "row", "left")
        score = score + F.coalesce("sum", F.lit(0.0))
    judged = rows.withColumn("score", score)
    verdict = F.coalesce("ruled", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict")
    return judged.select("page_id", "host", "path", "rule", verdict, "score")
