"""Quality scores by compression with two Zstandard dictionaries.

One dictionary is built from good labelled texts, one from bad.  A text is
compressed in short chunks with each, all of it, and the difference of the two
sizes over its length (damped for short texts) is mapped to a probability by an
isotonic curve (with a little of a logistic one, so that no two differences
tie) fitted on labelled texts that are in neither dictionary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import parts
from .common import fold, small_batches, stored, texts

#: Bounds of the training sample: labelled texts of each class (smallest hashes), and pieces of those that make
#: a dictionary (smallest hashes over the whole length of all of them).  The curve is fitted on whole texts.
SAMPLE_ROWS, SAMPLE_PIECES, PIECE_BYTES = 4000, 24_000, 512
DICTIONARY_BYTES, CHUNK_BYTES, LEVEL = 64 << 10, 1024, 3
#: Bytes added to a text's length, so that a few words are no strong evidence.
DAMPING = 150
#: Share of the logistic curve in a score.
BLEND = 0.05
FOLDS = 5
REJECT_BELOW = 0.3


def _dictionary(samples: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too little text to train on: the text itself
        return b"".join(samples)[-DICTIONARY_BYTES:] or b"\n" * 16


class Classifier:
    """Two dictionaries and a calibration curve (``knots``: differences and probabilities)."""

    def __init__(self, good: bytes, bad: bytes, slope: float = 1.0, offset: float = 0.0, knots=None):
        self.good, self.bad, self.slope, self.offset, self.knots = good, bad, slope, offset, knots
        self._presses = None

    def __getstate__(self):
        return {**self.__dict__, "_presses": None}

    def difference(self, text: bytes) -> float:
        """(size with the bad dictionary - size with the good) / (length + damping)."""
        import zstandard

        if self._presses is None:
            self._presses = []
            for d in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(d)
                d.precompute_compress(level=LEVEL)
                self._presses.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        good, bad = (p.compress for p in self._presses)
        view = memoryview(text)
        total = 0
        for k in range(0, len(text), CHUNK_BYTES):
            chunk = view[k : k + CHUNK_BYTES]
            total += len(bad(chunk)) - len(good(chunk))
        return total / (len(text) + DAMPING)

    def score(self, text: bytes) -> float:
        x = self.difference(text)
        p = float(1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -40, 40))))
        return p if self.knots is None else (1 - BLEND) * float(np.interp(x, *self.knots)) + BLEND * p


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of greatest weighted likelihood (Newton, slightly ridged)."""
    design = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -40, 40)))
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([1e-4, 1e-6])
        step = np.linalg.solve(hessian, design.T @ (weight * (y - p)) - np.array([1e-4, 1e-6]) * beta)
        beta += np.clip(step, -25, 25)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def _isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising curve nearest to the labels (pooled neighbours, joined by lines)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # weight, weighted label, weighted x
    for k in order.tolist():
        pools.append([weight[k], weight[k] * y[k], weight[k] * x[k]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """(text, quality, curve) of the sampled rows, each text once, and the number of labels of each class.

    At most ``SAMPLE_ROWS`` texts of each class, whatever number of rows a labelled id has.
    """
    marks = labels.where("doc_id is not null and quality in (0, 1)").where(fold("doc_id", FOLDS) != 0).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    shares = {int(r["quality"]): r["count"] for r in marks.groupBy("quality").count().collect()}

    def smallest(rows: DataFrame, *order: str) -> DataFrame:
        each = [rows.where(F.col("quality") == q).orderBy(*order).limit(SAMPLE_ROWS) for q in (0, 1)]
        return each[0].unionByName(each[1])

    picked = smallest(marks.withColumn("h", F.xxhash64("doc_id")), "h", "doc_id")
    rows = texts(docs, "doc_id").withColumn("key", F.xxhash64("text")).join(F.broadcast(picked), "doc_id")
    found = smallest(rows.select("doc_id", "key", "quality", "h").distinct(), "h", "doc_id", "key").collect()
    found.sort(key=lambda r: (r["h"], r["doc_id"], r["key"]))
    chosen, place = [], [0, 0]
    for r in found:  # every other text of a class makes the dictionary, the rest the curve
        chosen.append((r["doc_id"], r["key"], r["quality"], place[r["quality"]] % 2 == 1))
        place[r["quality"]] += 1
    chosen = docs.sparkSession.createDataFrame(chosen, "doc_id long, key long, quality int, curve boolean")
    source = texts(docs, "doc_id").withColumn("key", F.xxhash64("text"))
    whole = source.join(F.broadcast(chosen), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("text", "quality", "curve")
    return stored(whole, "quality-sample"), shares


def _training_pieces(sample: DataFrame, quality: int) -> list[bytes]:
    """Pieces of the class's dictionary texts, from their whole length."""
    data = F.col("text").cast("binary")
    starts = F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / PIECE_BYTES).cast("int"))
    rows = sample.where(f"quality = {quality} and not curve and text <> ''").select(data.alias("data"), F.explode(starts).alias("k"))
    pieces = rows.select(F.substring("data", F.col("k") * PIECE_BYTES + 1, F.lit(PIECE_BYTES)).alias("piece"), "k")
    return pieces.orderBy(F.xxhash64("piece", "k"), "piece").limit(SAMPLE_PIECES).toArrow().column("piece").to_pylist()


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Learn from labelled rows whose crc32(doc_id) mod 5 is not 0.

    At most ``SAMPLE_ROWS`` texts of each class are used, those with the
    smallest hashes; half of each class makes the dictionaries, the whole texts of
    the other half the curve, weighted back to the classes' shares of the labels.
    Labels that are null or not 0 or 1 are ignored; of contradicting labels of
    one document the higher counts; repeated rows of a text count once.  With
    labels of one class only, every text scores that class.
    """
    sample, shares = _sample(docs, labels)
    sizes = {(r["quality"], r["curve"]): r["count"] for r in sample.groupBy("quality", "curve").count().collect()}
    if not (sizes.get((0, False)) and sizes.get((1, False))):
        good = any(q == 1 for q, _ in sizes) or not sizes
        return Classifier(b"\n" * 16, b"\n" * 16, 0.0, 40.0 if good else -40.0)
    made = Classifier(*(_dictionary(_training_pieces(sample, q)) for q in (1, 0)))

    def run(batches):
        for batch in batches:
            for part in parts(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("quality"), pa.array([made.difference(t.encode("utf-8", "surrogatepass")) for t in part.column("text").to_pylist()], pa.float64())], ["quality", "x"])

    # A class with one text has no other for the curve than the dictionary's own.
    both = [F.col("quality") == q if not sizes.get((q, True)) else (F.col("quality") == q) & F.col("curve") for q in (0, 1)]
    rest = sample.where(both[0] | both[1]).select("text", "quality").mapInArrow(run, "quality int, x double").toArrow().to_pylist()
    rest.sort(key=lambda r: (r["x"], r["quality"]))
    x, y = np.array([r["x"] for r in rest]), np.array([float(r["quality"]) for r in rest])
    weight = np.where(y == 1, shares[1] / max(1, (y == 1).sum()), shares[0] / max(1, (y == 0).sum()))
    weight = weight * len(y) / weight.sum()
    made.slope, made.offset = _logistic(x, y, weight)
    made.knots = _isotonic(x, y, weight)
    return made


def scores(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, score) of every whole text; a null or empty text gets the curve's value at no difference.

    Repeated rows and null ids stay; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            for part in parts(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([classifier.score(t.encode("utf-8", "surrogatepass")) for t in part.column("text").to_pylist()], pa.float64())], ["doc_id", "score"])

    return texts(docs, "doc_id").mapInArrow(run, "doc_id long, score double")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted); a null doc_id is not held out."""
    found = scores(docs, fit(docs, labels))
    return found.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= REJECT_BELOW).cast("int").alias("predicted"))


def accepted(docs: DataFrame, classifier: Classifier, reject_below: float = REJECT_BELOW) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``reject_below``; a null text scores as an empty one."""

    small_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array([classifier.score(t.as_py().encode("utf-8", "surrogatepass") if t.is_valid else b"") for t in column], pa.float64())

    return docs.where(score(docs["text"]) >= reject_below)
