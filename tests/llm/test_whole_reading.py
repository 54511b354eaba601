"""The tagger reads every character, and its fast form says what the plain one does."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import personal, tagger


def test_every_position_of_a_text_is_read(monkeypatch):
    def all_secret(model, chars):
        return np.full(chars.shape, 2 + 2 * personal.KINDS.index("secret"), np.int64)

    monkeypatch.setattr(tagger, "viterbi", all_secret)
    for n in (9, 255, 256, 257, 479, 480, 481, 5000):
        text = ("plain words of a text without any cue " * (n // 30 + 1))[: n - 1] + "."
        assert not list(personal.regions(text))
        found = personal.added_spans({}, [text, "", "short", text], [personal.base_spans(t) for t in (text, "", "short", text)])
        assert found[0] == found[3] == [("secret", 0, n)] and not found[1] and not found[2]


def test_a_cue_free_secret_is_found():
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    text = lambda: (f"{word(5)} {word(7)} {word(4)} {word(6)} {word(3)} ", f"<{word(9)}:{word(9)}>", f" {word(6)} {word(5)} {word(4)}")
    secret = personal.KINDS.index("secret")
    chars, tags = [], []
    for _ in range(400):
        a, b, c = text()
        chars.append(personal._window_chars(tagger.classes(a + b + c), 0))
        tags.append(personal._tags(a + b + c, [(secret, len(a), len(a + b))], 0))
    model = tagger.train(np.stack(chars), np.stack(tags), personal.N_TAGS)
    new = [text() for _ in range(40)]
    whole = ["".join(t) for t in new]
    assert not any(list(personal.regions(t)) for t in whole)
    found = personal.added_spans(model, whole, [personal.base_spans(t) for t in whole])
    assert sum(f == [("secret", len(a), len(a + b))] for f, (a, b, _) in zip(found, new, strict=True)) >= 35


def test_fast_decoding_equals_the_plain_one():
    rng = np.random.default_rng(8)
    model = {k: v * 2 for k, v in tagger.new_model(5).items()}
    for bias in (0.0, 30.0):  # with the second, no window can hold any tag but 0
        model["bias"] = np.array([bias, 0, 0, 0, 0], np.float32)
        chars = rng.integers(0, tagger.N_CLASSES, (7, 50)).astype(np.uint8)
        x = model["embed"][chars.T]
        plain = np.concatenate([tagger._lstm(model, d, x, None) for d in "fb"], axis=2) @ model["out"] + model["bias"]
        np.testing.assert_allclose(tagger.emissions(model, chars).transpose(0, 2, 1), plain, atol=1e-4)
        for row, tags in zip(plain.transpose(1, 0, 2).astype(np.float64), tagger.viterbi(model, chars), strict=True):
            score, back = row[0] + model["begin"], []
            for e in row[1:]:
                step = score[:, None] + model["trans"]
                back.append(step.argmax(axis=0))
                score = step.max(axis=0) + e
            best = [int(score.argmax())]
            for b in reversed(back):
                best.append(int(b[best[-1]]))
            assert tags.tolist() == best[::-1]
        assert (bias == 0) == bool(tagger.viterbi(model, chars).any())


def test_training_sees_text_without_cues():
    text = "some words before the cue and then password=abcdefgh here, " + "and many more words after it " * 40
    plain = personal.plain_windows(text, 5)
    assert len(plain) == 5 and not any(any(t) for _, t in plain)
    assert len(personal.training_windows(text)) > len(personal.sampled_windows(text))


def test_spans_do_not_depend_on_the_texts_read_beside(monkeypatch):
    rng = np.random.default_rng(12)
    monkeypatch.setattr(personal, "_plausible", lambda kind, piece: True)
    model = {k: v * 2 for k, v in tagger.new_model(personal.N_TAGS).items()}
    model["trans"][0, 0] += 1
    texts = ["".join(rng.choice(list("abcdef gh.@=XY0123456789"), n)) for n in (9, 40, 41, 90, 200, 511, 512, 513, 700, 1500)]
    together = personal.added_spans(model, texts, [{} for _ in texts])
    assert together == [personal.added_spans(model, [t], [{}])[0] for t in texts]
    assert sum(map(bool, together)) >= 8


def test_padded_windows_are_decoded_as_the_plain_ones():
    rng = np.random.default_rng(9)
    decoded = 0
    for bias in (2.0, 6.0, 9.0):  # the more, the fewer stretches are open
        model = {k: v * 2 for k, v in tagger.new_model(5).items()}
        model["bias"] = np.array([bias, 0, 0, 0, 0], np.float32)
        lengths = [1, 2, 17, 49, 50, 50, 64]
        chars = np.full((len(lengths), 64), tagger.PAD, np.uint8)
        for row, n in zip(chars, lengths, strict=True):
            row[:n] = rng.integers(1, tagger.N_CLASSES, n)
        scores, tags = tagger.emissions(model, chars), tagger.viterbi(model, chars)
        for k, n in enumerate(lengths):
            x = model["embed"][chars[k : k + 1, :n].T]
            plain = (np.concatenate([tagger._lstm(model, d, x, None) for d in "fb"], axis=2) @ model["out"] + model["bias"])[:, 0]
            np.testing.assert_allclose(scores[:n, :, k], plain, atol=1e-4)
            score, back = plain[0].astype(np.float64) + model["begin"], []
            for e in plain[1:]:
                step = score[:, None] + model["trans"]
                back.append(step.argmax(axis=0))
                score = step.max(axis=0) + e
            best = [int(score.argmax())]
            for b in reversed(back):
                best.append(int(b[best[-1]]))
            assert tags[k].tolist() == best[::-1] + [0] * (64 - n)
            decoded += 0 < np.count_nonzero(tags[k]) < n
    assert decoded >= 3


def test_few_characters_are_read_twice_or_padded(monkeypatch):
    read = []

    def seen(model, chars):
        read.append(chars.size)
        return np.zeros(chars.shape, np.uint8)

    monkeypatch.setattr(tagger, "viterbi", seen)
    texts = ["x" * n for n in range(200, 5000, 4)]
    personal.added_spans({}, texts, [{} for _ in texts])
    assert sum(map(len, texts)) < sum(read) < 1.12 * sum(map(len, texts))


def test_the_sample_is_that_of_all_texts_with_cues(spark, monkeypatch):
    rows = [(k if k % 50 else None, "password=abcdefgh" if k % 7 == 0 else "just words of a text") for k in range(3000)] + [(14, "1"), (21, "2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order = docs.where(F.col("text").rlike(personal._CUES_SQL)).select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect()
    for first in (0.5, 2, 16):  # several rounds, some, one
        monkeypatch.setattr(personal, "FIRST_TRIED", first)
        for most in (1, 30, 300, 1000):
            assert personal._picked(docs, most) == sorted({r["doc_id"] for r in order[:most]} - {None})
    assert personal._picked(docs.where("doc_id % 7 <> 0"), 5) == []
