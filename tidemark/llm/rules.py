"""Quality rules as a bitmask ledger.

Each text is measured once; each rule is one bit of ``failed_bits``.  The
ledger (measurements and bits) is what gets stored: a policy is only a named
mask over the bits, so changing policy, comparing versions or leaving one rule
out never reads a text again.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts
from .textvec import Block, mix, text_blocks

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: (name, condition that fails the text); the position is the bit.  Integer arithmetic only.
RULES = (
    ("too_few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 10 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "word_chars > 15 * n_words OR word_chars < 2 * n_words"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE_MASK = BIT["too_few_words"] | BIT["repeated_windows"]
#: Versioned policies: masks of the bits that reject.
POLICIES = {"base": BASE_MASK, "v1": BASE_MASK | BIT["symbols"], "v2": BASE_MASK | BIT["symbols"] | BIT["word_length"], "strict": (1 << len(RULES)) - 1}
DEFAULT_POLICY = "v2"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def measure_block(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of a block of texts."""
    b = Block(data, offsets, lower=False)
    letters = ~b.space & ((data & 0xC0) != 0x80)
    out = {"n_words": b.n_words, "word_chars": b.per_doc(letters), "n_symbols": b.per_doc(_SYMBOL[data])}
    # Lines: from each text's start or after a \n, up to the next \n or the text's end.
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    start = start[start < len(data)]
    stop = np.append(start[1:], len(data)) - 0
    ends_in_break = np.zeros(len(data) + 1, bool)
    ends_in_break[breaks + 1] = True
    stop = stop - ends_in_break[stop]
    has_word = np.searchsorted(b.start, start, "left") < np.searchsorted(b.start, stop, "left")
    start, stop = start[has_word], stop[has_word]
    doc = np.searchsorted(offsets, start, "right") - 1
    out["n_lines"] = np.bincount(doc, minlength=b.n_docs)
    key = np.unique(np.stack([doc.astype(np.uint64), mix(b.range_hash(start, stop) + (stop - start).astype(np.uint64))], axis=1), axis=0) if len(doc) else np.zeros((0, 2), np.uint64)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(key[:, 0].astype(np.int64), minlength=b.n_docs)
    first, value = b.windows(5)
    value = mix(value + b.doc[first].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(value, kind="stable")
    ranked = value[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(value), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(b.hash) + 1, np.int64)
    np.add.at(cover, first[twice], 1)
    np.add.at(cover, first[twice] + 5, -1)
    out["n_repeat_words"] = np.bincount(b.doc[np.cumsum(cover)[:-1] > 0], minlength=b.n_docs)
    return out


def _measure_rows(batches):
    for batch in batches:
        for a, b, data, offsets in text_blocks(batch.column("text")):
            found = measure_block(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(found[m].astype(np.int64)) for m in MEASURES)], ["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the measurements and ``failed_bits``.

    A null or empty text has no words and fails ``too_few_words``; repeated
    rows and null ids are measured like any other row; other columns are ignored.
    """
    measured = texts(docs, "doc_id").mapInArrow(_measure_rows, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = F.lit(0).cast("long")
    for k, (_, fails) in enumerate(RULES):
        bits = bits + F.when(F.expr(fails), F.lit(1 << k)).otherwise(0)
    return measured.withColumn("failed_bits", bits.cast("long"))


def passes(policy: str = DEFAULT_POLICY) -> Column:
    """Whether a ledger row passes every rule of a policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0


def apply_policies(rows: DataFrame, *policies: str) -> DataFrame:
    """A ledger with one column ``kept_<policy>`` for each policy."""
    return rows.withColumns({f"kept_{p}": passes(p) for p in policies})


def ablations(rows: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """For each rule of a policy: rows failing it, failing it alone, and kept without it.

    One aggregation by distinct bitmask (at most 2**rules groups), then bit arithmetic.
    """
    mask = POLICIES[policy]
    groups = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("bits")).count()
    rules = [(n, b) for n, b in BIT.items() if b & mask]
    each = groups.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in rules])).alias("r"))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(count(hit).alias("failing"), count(hit & rest).alias("failing_alone"), count(rest).alias("kept_without"))


def judged(docs: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The ledger with ``base_failed`` and the policy's verdict ``kept`` (false where the base fails)."""
    base = F.col("failed_bits").bitwiseAND(F.lit(BASE_MASK)) != 0
    return ledger(docs).withColumn("base_failed", base).withColumn("kept", ~base & passes(policy))


def accepted(docs: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The rows of ``docs``, all columns, that pass the base and the policy; measured as they stream by, without a join.

    Only the text goes to the measuring function and only its numbers come back; a null text has no words.
    """

    small_batches(docs.sparkSession)

    @F.arrow_udf(", ".join(f"{m} long" for m in MEASURES))
    def measured(column: pa.Array) -> pa.Array:
        found = [measure_block(data, offsets) for _, _, data, offsets in text_blocks(column)]
        whole = [np.concatenate([np.zeros(0, np.int64), *(f[m] for f in found)]).astype(np.int64) for m in MEASURES]
        return pa.StructArray.from_arrays([pa.array(x) for x in whole], list(MEASURES))

    name = "_measures"
    while name in docs.columns:
        name += "_"
    rows = docs.withColumn(name, measured(docs["text"]))
    wanted = POLICIES[policy] | BASE_MASK
    fails = [f for k, (_, f) in enumerate(RULES) if wanted >> k & 1]
    in_struct = [re.sub(r"\b(" + "|".join(MEASURES) + r")\b", rf"{name}.\1", f) for f in fails]
    return rows.where(~F.expr(" OR ".join(f"({f})" for f in in_struct))).select(*docs.columns)


def ledger_sql() -> str:
    """The same verdicts as DuckDB SQL over ``documents``."""
    bits = " + ".join(f"CASE WHEN {fails} THEN {1 << k} ELSE 0 END" for k, (_, fails) in enumerate(RULES))
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
p AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT r, i, word || chr(10) || lead(word, 1) OVER o || chr(10) || lead(word, 2) OVER o || chr(10) || lead(word, 3) OVER o || chr(10) || lead(word, 4) OVER o AS gram
      FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
d AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g WHERE gram IS NOT NULL),
c AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM d WHERE n > 1) GROUP BY r),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c USING (r) LEFT JOIN l USING (r)),
b AS (SELECT *, CAST({bits} AS BIGINT) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed_bits, (failed_bits & {BASE_MASK}) <> 0 AS base_failed, (failed_bits & {POLICIES[DEFAULT_POLICY] | BASE_MASK}) = 0 AS kept FROM b"""
