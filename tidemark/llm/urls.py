"""URL filter: host and path rules, and a logistic regression on hashed character n-grams where no rule fits.

Host and path are column expressions.  A short list of rules is one column
expression as well; a longer one is met by equi-joins on a host's parent
domains and on path prefixes.  The regression is trained in numpy from a small
labelled table of URLs and scores batches of rows; its weights are one array
of fixed length, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored
from .textvec import mix, text_blocks

#: Rules of the registered query: (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Up to so many rules become one column expression; up to so many a broadcast table.
EXPRESSION_RULES, BROADCAST_RULES = 64, 100_000

# Words of the default labelled table.
UNWANTED = "casino poker roulette jackpot slots gambling bets betting bet-now win-cash lottery pills pharmacy viagra cialis weight-loss cheap-meds adult xxx porn sexcam escort hot-girls nude spam spam-mail link-farm seo-links backlinks ads adserver ad-track tracker track-click popunder banner-ads clickbait warez crack keygen torrent free-download payday-loan quick-loan crypto-win get-rich replica-watches fake-id".split()
WANTED = "news daily-times herald wiki encyclopedia library archive museum university school college science physics biology history geography weather travel cooking recipes garden health hospital clinic council city library-catalog parliament government court police football cycling chess music theatre cinema books poetry photo design software python forum mail maps bank energy farm farmers-market railway bus airport hotel tracks adelaide adaptive winter winery betty better bethany pilot pillow essex sussex".split()
SERVERS, DOMAINS, SECTIONS = ("", "www.", "blog.", "m."), ("com", "net", "org", "example.com", "example.net", "example.org"), ("/", "/en/1", "/de/23.html", "/fr/456/", "/es/7890", "/index.html", "/a/b")


def labelled_urls() -> list[tuple[str, int]]:
    """The default labelled table: every word on each of several servers, 1 for unwanted; domain and section are the same for both classes."""
    rows = []
    for label, words in ((1, UNWANTED), (0, WANTED)):
        for k, word in enumerate(words):
            other = words[(k * 7 + 3) % len(words)].split("-")[0]
            for j, server in enumerate(SERVERS):
                name = (word, f"{word}-{other}", f"{word}{k % 9}", f"the-{word}")[(k + j) % 4]
                rows.append((f"https://{server}{name}.{DOMAINS[(k + j) % len(DOMAINS)]}{SECTIONS[(k + 2 * j) % len(SECTIONS)]}", label))
    return rows


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty for a null or one without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def _by_expression(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    best = F.lit(None).cast("struct<rule:string,ruling:string>")
    for verdict, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is asked first
        best = F.when(fits(F.col("host"), F.col("path"), host, path), F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("ruling"))).otherwise(best)
    return rows.withColumn("_r", best).select("*", "_r.rule", "_r.ruling").drop("_r")


def _by_joins(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (host, path) pairs meet the rules of their parent domains; only path lengths that a domain's rules have are tried."""
    small = F.broadcast if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES else (lambda df: df)
    lengths = rules.groupBy(F.col("host").alias("domain")).agg(F.collect_set(F.length("path")).alias("sizes"))
    names = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, k, F.size(names)), "."))
    asked = rows.where("host <> ''").select("host", "path").distinct().withColumn("domain", F.explode(domains))
    asked = asked.join(small(lengths), "domain").withColumn("size", F.explode("sizes")).where("size <= length(path)").withColumn("prefix", F.expr("substring(path, 1, size)"))
    known = rules.select(F.col("host").alias("domain"), F.col("path").alias("prefix"), F.col("verdict").alias("ruling"))
    met = asked.join(small(known), ["domain", "prefix"]).withColumn("rule", F.concat("domain", "prefix"))
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "ruling")).alias("_r"))
    best = stored(best.select("host", "path", "_r.rule", "_r.ruling"), "ruled-urls")
    return rows.join(best, ["host", "path"], "left")


def _fold_table() -> np.ndarray:
    """Bytes as n-grams see them: A-Z lowered, every digit alike."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[48:58] = 48
    return table


_FOLD = _fold_table()
SIZES, BITS = (3, 4, 5), 18


def grams(column: pa.Array, space: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each character n-gram of a string column, with a mark at either end; ``space`` keeps host and path apart."""
    rows, buckets = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for first, last, data, offsets in text_blocks(column):
        sizes = np.diff(offsets)
        marked = np.zeros(len(data) + 2 * len(sizes), np.uint64)  # zeros stand for the marks
        owner = np.repeat(np.arange(len(sizes)), sizes)
        marked[np.arange(len(data)) + 2 * owner + 1] = _FOLD[data]
        whose = np.repeat(np.arange(len(sizes)), sizes + 2)
        for n in SIZES:
            if len(marked) < n:
                continue
            value = np.full(len(marked) - n + 1, space << 3 | n, np.uint64)
            for k in range(n):
                value = value << np.uint64(8) | marked[k : len(marked) - n + 1 + k]
            inside = np.flatnonzero(whose[: len(value)] == whose[n - 1 :])
            rows.append(whose[inside] + first)
            buckets.append((mix(value[inside]) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


class UrlModel:
    """Weights of n-gram buckets and a bias; a field's n-grams share unit weight."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @staticmethod
    def features(host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, bucket, value) triplets."""
        out = []
        for space, column in enumerate((host, path)):
            row, bucket = grams(column, space)
            n = np.bincount(row, minlength=len(column))
            out.append((row, bucket, 1 / np.sqrt(n[row])))
        return tuple(np.concatenate(x) for x in zip(*out))

    def probability(self, host: pa.Array, path: pa.Array) -> np.ndarray:
        row, bucket, value = self.features(host, path)
        return 1 / (1 + np.exp(-(self.bias + np.bincount(row, self.weights[bucket] * value, minlength=len(host)))))


#: Bounds of training: labelled rows that are used at most, rounds, step, and penalty of large weights.
LABELLED_ROWS, ROUNDS, STEP, PENALTY = 20_000, 400, 4.0, 1e-4


def fit(spark: SparkSession, labelled: DataFrame | Iterable[tuple[str, int]] | None = None) -> UrlModel:
    """Train on (url, label), label 1 for unwanted: whole-batch gradient steps with momentum over at most ``LABELLED_ROWS`` rows, by hash where there are more."""
    if not isinstance(labelled, DataFrame):
        labelled = spark.createDataFrame(list(labelled if labelled is not None else labelled_urls()), "url string, label int")
    host, path = parts(F.col("url"))
    rows = labelled.where("url is not null and label is not null").orderBy(F.xxhash64("url"), "label").limit(LABELLED_ROWS).select(host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label")).toArrow()
    y = rows.column("label").to_numpy()
    row, bucket, value = UrlModel.features(rows.column("host").combine_chunks(), rows.column("path").combine_chunks())
    known, place = np.unique(bucket, return_inverse=True)
    w, pace, bias, bias_pace = np.zeros(len(known)), np.zeros(len(known)), 0.0, 0.0
    for _ in range(ROUNDS if len(y) else 0):
        p = 1 / (1 + np.exp(-(bias + np.bincount(row, w[place] * value, minlength=len(y)))))
        off = (p - y) / len(y)
        pace = 0.9 * pace - STEP * (np.bincount(place, value * off[row], minlength=len(known)) + PENALTY * w)
        bias_pace = 0.9 * bias_pace - STEP * off.sum()
        w, bias = w + pace, bias + bias_pace
    weights = np.zeros(1 << BITS, np.float32)
    weights[known] = w
    return UrlModel(weights, float(bias))


def _score(shared):
    def run(batches):
        weights, bias = shared.value
        model = UrlModel(weights, bias)
        for batch in batches:
            host, path = batch.column("host"), batch.column("path")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.probability(host, path))], [*batch.schema.names, "score"])

    return run


def judged(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]] = RULES, model: UrlModel | None = None, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for each row of (page_id, url).

    ``rules`` are (verdict, host, path); a rule fits its host and every
    subdomain if the path begins with the rule's, and the longest that fits
    gives the verdict (of repeated rules the greater).  Where none fits, the
    model blocks a URL whose ``score``, its probability of being unwanted,
    reaches ``threshold``.  A null URL and one without ``://`` have empty host
    and path, which no rule fits; repeated rows and null ids stay as they are,
    other columns are ignored.  An empty table gives no rows.
    """
    spark = pages.sparkSession
    small_batches(spark)
    host, path = parts(pages["url"])
    rows = pages.select(pages["page_id"].alias("page_id"), host.alias("host"), path.alias("path"))
    if isinstance(rules, DataFrame):
        listed = rules.select("verdict", "host", "path").limit(EXPRESSION_RULES + 1).collect()
        rules = [tuple(r) for r in listed] if len(listed) <= EXPRESSION_RULES else rules
    else:
        rules = list(rules)
        if len(rules) > EXPRESSION_RULES:
            rules = spark.createDataFrame(rules, "verdict string, host string, path string")
    ruled = _by_joins(rows, rules) if isinstance(rules, DataFrame) else _by_expression(rows, rules)
    ruled = ruled.select("page_id", "host", "path", "rule", "ruling")
    model = model or fit(spark)
    shared = spark.sparkContext.broadcast((model.weights, model.bias))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ruled.schema) + ", score double"
    scored = ruled.mapInArrow(_score(shared), schema)
    verdict = F.coalesce("ruling", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
