"""Personal data: exact base patterns, and spans added by a trained tagger.

The base finds e-mail addresses, IP addresses, card and phone numbers exactly.
The tagger (see ``tagger``) is trained on labelled windows of a bounded sample
of the corpus: the base spans, credentials marked by the seed patterns below,
the text around such cues (a digit, ``@`` or ``=``, a word such as token with
the value it introduces, a long run of mixed case), and text without any.  It
reads every character of every text, in overlapping windows; in an overlap,
each character takes its tag from the window in which it stands furthest from
an edge, so spans are reconciled over the whole text.
Only spans that touch no base span are added.
"""

from __future__ import annotations

import re
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tagger
from .bpe import parts
from .common import small_batches, texts

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
#: Seed labels of credentials, for training only.
SEED_SECRETS = re.compile(r"\bAKIA[0-9A-Z]{16}\b|password=[^\s]+|token = \"[0-9a-f]+\"|\bsk-[A-Za-z0-9]{16,}|\bghp_[A-Za-z0-9]{20,}")
#: Bounds of the training sample: documents, windows of 64 characters of one document, and windows in all.
SAMPLE_DOCS, DOC_WINDOWS, SAMPLE_WINDOWS = 1500, 64, 4000
#: Texts searched at first for cues, for each document of the sample.
FIRST_TRIED = 16
#: Characters kept on each side of a cue and between training windows; least length of an added span.
MARGIN, STRIDE, LEAST_SPAN = 24, 32, 8
#: Characters of a window that is read, and from one to the next.
READ_LENGTH, READ_STRIDE = 512, 480
N_TAGS = 1 + 2 * len(KINDS)
WINDOW_BATCH = 512
#: Text bytes whose windows are read together (a longer text is alone).
SLICE_BYTES = 4 << 20

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_CUE = re.compile(r"[0-9@]")
_RUN = re.compile(r"[0-9@=](?:[^0-9@=]{0,%d}[0-9@=])*" % (2 * MARGIN))
#: Cues of credentials without a digit, for Python and Java: a word that introduces one, with its value; a run of mixed case.
_NAMES = ("passw", "passphrase", "pwd", "secret", "token", "key", "credential")
_NAMED = "(?i:%s)[A-Za-z_-]{0,16}[\"']?[ \t]{0,4}[:=\"'][ \t\"']{0,4}[^\\s\"']+[\"']?" % "|".join(_NAMES)
_LONG_RUN = "(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+"
_MIXED = re.compile("[a-z][A-Z]")
_CUES_SQL = "[0-9@=]|%s|(?<![A-Za-z0-9_+/-])(?=[A-Za-z0-9_+/-]{16})[A-Za-z0-9_+/-]*[a-z][A-Z]" % _NAMED
_NAMED, _LONG_RUN = re.compile(_NAMED), re.compile(_LONG_RUN)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping spans of each base kind; failing matches are dropped, not retried."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE_KINDS}
    at, done = text.find("@"), 0
    while at >= 0:  # a match holds one @, so it starts where the run of local characters before it does
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found["email"].append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if not _CUE.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
                found["phone"].append(m.span())
    return found


def _cues(text: str) -> list[tuple[int, int]]:
    """Spans that may be personal data or hold it, by their beginning."""
    found = [m.span() for m in _RUN.finditer(text)]
    low = text.lower()
    other = [m.span() for m in _NAMED.finditer(text)] if any(n in low for n in _NAMES) else []
    other += [m.span() for m in _LONG_RUN.finditer(text) if _MIXED.search(text, *m.span())]
    return sorted(found + other) if other else found


def regions(text: str):
    """Stretches around cues, which training windows are drawn from, in order and apart."""
    end = -1
    start = 0
    for first, last in _cues(text):
        a, b = max(0, first - MARGIN), min(len(text), last + MARGIN)
        if a > end:
            if end > 0:
                yield start, end
            start = a
        end = max(end, b)
    if end > 0:
        yield start, end


def windows(start: int, end: int, length: int = tagger.LENGTH, stride: int = STRIDE):
    """Overlapping windows of a stretch."""
    at = start
    while True:
        yield at
        if at + length >= end:
            return
        at += stride


def _tags(text: str, spans: list[tuple[int, int, int]], start: int) -> np.ndarray:
    out = np.zeros(tagger.LENGTH, np.int64)
    for kind, a, b in spans:
        for p in range(max(a, start), min(b, start + tagger.LENGTH)):
            out[p - start] = 1 + 2 * kind + (p > a)
    return out


def _window_chars(chars: np.ndarray, at: int) -> np.ndarray:
    row = np.zeros(tagger.LENGTH, np.uint8)
    piece = chars[at : at + tagger.LENGTH]
    row[: len(piece)] = piece
    return row


def labelled_windows(text: str) -> list[tuple[bytes, bytes]]:
    """Training windows of a text: character classes and tags."""
    spans = [(KINDS.index(k), a, b) for k, found in base_spans(text).items() for a, b in found]
    spans += [(4, *m.span()) for m in SEED_SECRETS.finditer(text)]
    out, chars = [], tagger.classes(text)
    for a, b in regions(text):
        out += [(_window_chars(chars, at).tobytes(), _tags(text, spans, at).astype(np.uint8).tobytes()) for at in windows(a, b)]
    return out


def sampled_windows(text: str) -> list[tuple[bytes, bytes]]:
    """At most ``DOC_WINDOWS`` training windows of a text, by hash from its whole length."""
    found = labelled_windows(text)
    order = sorted(range(len(found)), key=lambda k: zlib.crc32(found[k][0] + k.to_bytes(8)))
    return [found[k] for k in sorted(order[:DOC_WINDOWS])]


def plain_windows(text: str, most: int) -> list[tuple[bytes, bytes]]:
    """At most ``most`` training windows, by hash, of what lies between the regions: nothing in them is tagged."""
    edges = [0, *(p for region in regions(text) for p in region), len(text)]
    chars, none = tagger.classes(text), bytes(tagger.LENGTH)
    found = [_window_chars(chars[:b], at).tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b for at in range(a, b, tagger.LENGTH)]
    order = sorted(range(len(found)), key=lambda k: zlib.crc32(found[k] + k.to_bytes(8)))
    return [(found[k], none) for k in sorted(order[:most])]


def training_windows(text: str) -> list[tuple[bytes, bytes]]:
    """Windows around cues, and a quarter as many of the rest of the text."""
    found = sampled_windows(text)
    return found + plain_windows(text, -(-len(found) // 4))


def _picked(source: DataFrame, most: int) -> list:
    """Ids of the ``most`` rows with cues that have the smallest id hashes.

    Only as many rows are searched for cues as it takes: those with the smallest
    hashes, ``FIRST_TRIED`` for each wanted, then eight times as many, until enough
    have cues or all were searched.
    """
    h, share = F.xxhash64("doc_id"), FIRST_TRIED * most / max(1, source.count())
    while True:
        tried = source if share >= 1 else source.where(h < int(share * 2**64) - 2**63)
        found = tried.where(F.col("text").rlike(_CUES_SQL)).select("doc_id", h.alias("h")).orderBy("h", "doc_id").limit(most).collect()
        if len(found) >= most or share >= 1:
            return sorted({r["doc_id"] for r in found if r["doc_id"] is not None})
        share *= 8


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> dict[str, np.ndarray] | None:
    """Train on a bounded sample: the ``sample_docs`` texts with cues that have the smallest id hashes,
    with ``DOC_WINDOWS`` windows around cues of each at most, and a quarter as many without.

    Returns None if no text holds a cue.
    """
    source = texts(docs, "doc_id")
    picked = docs.sparkSession.createDataFrame([(k,) for k in _picked(source, sample_docs)], source.select("doc_id").schema)

    def run(batches):
        for batch in batches:
            rows = [w for t in batch.column("text").to_pylist() for w in training_windows(t)]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.binary()), pa.array([t for _, t in rows], pa.binary())], ["chars", "tags"])

    found = source.join(F.broadcast(picked), "doc_id").mapInArrow(run, "chars binary, tags binary").orderBy(F.xxhash64("chars"), "tags").limit(sample_windows).toArrow()
    if not found.num_rows:
        return None
    chars = np.frombuffer(b"".join(found.column("chars").to_pylist()), np.uint8).reshape(-1, tagger.LENGTH)
    tags = np.frombuffer(b"".join(found.column("tags").to_pylist()), np.uint8).reshape(-1, tagger.LENGTH).astype(np.int64)
    return tagger.train(chars, tags, N_TAGS)


def _plausible(kind: str, piece: str) -> bool:
    """Whether an added span could be what its tag says: checksums and ranges hold for it as for the base."""
    digits = "".join(c for c in piece if c in "0123456789")
    if kind == "card":
        return 13 <= len(digits) <= 19 and _luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "ip":
        numbers = re.findall("[0-9]+", piece)
        return len(numbers) == 4 and all(int(n) <= 255 for n in numbers if len(n) < 9) and max(map(len, numbers)) < 9
    return kind == "secret" or "@" in piece


def _spans_of(tags: np.ndarray, text: str, start: int):
    """(kind, start, end) of the reconciled tags of a stretch."""
    tags = tags.astype(np.int64)
    kind = np.where(tags > 0, (tags - 1) // 2, -1)
    begin = (tags > 0) & ((tags - 1) % 2 == 0)
    edges = [0, *(np.flatnonzero((kind[1:] != kind[:-1]) | begin[1:]) + 1).tolist(), len(tags)]
    for a, b in pairwise(edges):
        if a < b and kind[a] >= 0:
            named = int(kind[a])
            a, b = a + start, b + start
            while a < b and text[a].isspace():
                a += 1
            while b > a and (text[b - 1].isspace() or text[b - 1] in ",;"):
                b -= 1
            if b - a >= LEAST_SPAN and _plausible(KINDS[named], text[a:b]):
                yield named, a, b


def added_spans(model, rows: list[str], base: list[dict]) -> list[list[tuple[str, int, int]]]:
    """The tagger's spans of each text that touch no base span."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in rows]
    if model is None:
        return out
    chars = [tagger.classes(text) for text in rows]
    places = [(row, at) for row, text in enumerate(rows) if text for at in windows(0, len(text), READ_LENGTH, READ_STRIDE)]
    places.sort(key=lambda p: min(READ_LENGTH, len(rows[p[0]]) - p[1]))  # windows of about one length are read together
    tags = [np.zeros(len(text), np.uint8) for text in rows]
    edge = (READ_LENGTH - READ_STRIDE) // 2
    for first in range(0, len(places), WINDOW_BATCH):
        batch = places[first : first + WINDOW_BATCH]
        stack = np.full((len(batch), min(READ_LENGTH, len(rows[batch[-1][0]]) - batch[-1][1])), tagger.PAD, np.uint8)
        for k, (row, at) in enumerate(batch):
            piece = chars[row][at : at + READ_LENGTH]
            stack[k, : len(piece)] = piece
        found = tagger.viterbi(model, stack)
        for k in np.flatnonzero(found.any(axis=1)):
            row, at = batch[k]
            a, b = at + edge if at else 0, at + READ_LENGTH - edge if at + READ_LENGTH < len(rows[row]) else len(rows[row])
            tags[row][a:b] = found[k, a - at : b - at]
    for row, text in enumerate(rows):
        if not tags[row].any():
            continue
        taken = sorted(s for found in base[row].values() for s in found)
        for kind, p, q in _spans_of(tags[row], text, 0):
            if not any(s < q and p < e for s, e in taken):
                out[row].append((KINDS[kind], p, q))
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


def _all_spans(model, rows: list[str]) -> tuple[list[dict], list[list], list[list]]:
    """Of each text: base spans by kind, base spans in a list, and the tagger's."""
    base = [base_spans(t) for t in rows]
    return base, [[(k, *s) for k in BASE_KINDS for s in b[k]] for b in base], added_spans(model, rows, base)


FOUND = "doc_id long, base string, spans string, n_found long, " + ", ".join(f"n_{k} long" for k in KINDS)


def find(docs: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """Spans of personal data of every whole text, as ``kind:start:end`` lists.

    ``base`` has the exact base spans, ``spans`` also the tagger's; ``n_<kind>``
    counts base spans for the four base kinds and added ones for ``secret``,
    ``n_found`` counts all.  A null or empty text has none; repeated rows and null
    ids stay; other columns are ignored.  Without a model one is trained on ``docs``.
    """
    model = fit(docs) if model is None else model

    def run(batches):
        names = [c.split()[0] for c in FOUND.split(", ")]
        for batch in batches:
            for part in parts(batch, "text", SLICE_BYTES):
                base, plain, added = _all_spans(model, part.column("text").to_pylist())
                every = [p + a for p, a in zip(plain, added, strict=True)]
                counts = [[len(x) for x in every], *([len(b[k]) for b in base] for k in BASE_KINDS), [sum(k == "secret" for k, _, _ in x) for x in added]]
                spans = [pa.array([_joined(x) for x in found], pa.string()) for found in (plain, every)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *spans, *(pa.array(c, pa.int64()) for c in counts)], names)

    return texts(docs, "doc_id").mapInArrow(run, FOUND)


def _replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    joined: list[list] = []
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if joined and a < joined[-1][2]:
            joined[-1][2] = max(joined[-1][2], b)
        else:
            joined.append([k, a, b])
    out, done = [], 0
    for k, a, b in joined:
        out += [text[done:a], f"[{k.upper()}]"]
        done = b
    return "".join(out) + text[done:]


def redact(docs: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """``docs`` with every found span of its text replaced by ``[KIND]`` and ``n_chars`` counted anew.

    A null text stays null.  Overlapping spans are replaced as one, under the
    kind of the first.  All other columns pass through unchanged.
    """
    model = fit(docs) if model is None else model

    small_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def clean(column: pa.Array) -> pa.Array:
        out = []
        for part in parts(pa.RecordBatch.from_arrays([column.fill_null("")], ["text"]), "text", SLICE_BYTES):
            rows = part.column("text").to_pylist()
            _, plain, added = _all_spans(model, rows)
            out += [_replaced(t, p + a) if p or a else t for t, p, a in zip(rows, plain, added, strict=True)]
        return pa.array(out, pa.string(), mask=column.is_null().to_numpy(zero_copy_only=False))

    return docs.withColumn("text", clean(docs["text"])).withColumn("n_chars", F.length("text").cast("long"))


def digests(found: DataFrame) -> DataFrame:
    """The counts, a digest of the base spans and all spans."""
    return found.select("doc_id", *[f"n_{k}" for k in BASE_KINDS], F.sha2("base", 256).alias("base_sha256"), "spans", "n_secret", "n_found")
