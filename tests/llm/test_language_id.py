import math
import zlib
from collections import Counter

import public_tokenizers

from wardline.llm import language_id as language_id_module
from wardline.llm.language_id import SPACE, UNKNOWN, Lattice, language_id

PATH = public_tokenizers.path("piece_bpe_32k.model")


def segmentations(word, pieces):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces or n == 1:
            for rest in segmentations(word[n:], pieces):
                yield [word[:n], *rest]


def test_forward_sums_all_segmentations():
    pieces = sorted({SPACE, "a", "b", "ab", "ba", SPACE + "a", "aba", "bb"})
    lattice = Lattice(pieces)
    p = [0.05 + 0.02 * k for k in range(len(pieces))]
    for word in ("aba", "abba", SPACE + "abab", "axb", "a" * 12):
        want = sum(math.prod(p[pieces.index(x)] if x in pieces else UNKNOWN for x in s) for s in segmentations(word, pieces))
        assert math.isclose(lattice.log_probability(word, [[*p, UNKNOWN]])[0], math.log(want), rel_tol=1e-9)
    assert math.isfinite(lattice.log_probability("ab" * 5000, [[*p, UNKNOWN]])[0])
    for word in ("ab" * 60 + "xa" * 9, "abba" * 11):  # whole words of any length, with no border between parts
        alpha = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            alpha[end] = sum(alpha[at] * (p[pieces.index(word[at:end])] if word[at:end] in pieces else UNKNOWN * (end - at == 1)) for at in range(max(0, end - 4), end))
        assert math.isclose(lattice.log_probability(word, [[*p, UNKNOWN]])[0], math.log(alpha[-1]), rel_tol=1e-9)


def test_long_words_are_trained_on_alike(monkeypatch):
    lattice, words = Lattice(sorted({"a", "b", "ab", "ba"})), Counter({"abab" * 9: 3, "abxba": 2})
    plain = lattice.train(words, 3)
    monkeypatch.setattr(language_id_module, "REACH", 3)
    assert abs(plain - lattice.train(words, 3)).max() < 1e-9


def test_training_raises_likelihood():
    words = Counter({"abab": 10, "ba": 5, "aab": 2})
    lattice = Lattice(sorted({"a", "b", "ab", "ba", "aab"}))
    likelihood = [sum(c * lattice.log_probability(w, [[*lattice.train(words, n), UNKNOWN]])[0] for w, c in words.items()) for n in (1, 2, 4)]
    assert likelihood == sorted(likelihood)


def test_held_out_accuracy_and_defined_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    out = language_id(docs.selectExpr("*", "lang AS lang_pred", "1 AS score"), PATH, 100).collect()
    assert len(out) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in out)
    odd = spark.createDataFrame([(None, "the and of", "en"), (90001, None, "en"), (90002, "", None), (90003, "123 !!", "fr"), (90004, "é" * 50000, None), (90005, "日本語 の 文", None)], "doc_id long, text string, lang string")
    both = language_id(docs.limit(150).select("doc_id", "text", "lang").unionByName(odd), PATH, 100)
    got = {r.doc_id: r for r in both.collect()}
    assert [got[k].lang_pred for k in (90001, 90002, 90003)] == ["und"] * 3 and got[90001].score == 0 and got[None].held_out is False
    assert got[90005].lang_pred != "und"
    assert language_id(docs.limit(0), PATH).count() == 0
    assert {r.lang_pred for r in language_id(odd.withColumn("lang", odd.text.substr(0, 0)).selectExpr("doc_id", "text", "cast(null as string) lang"), PATH).collect()} == {"und"}


def test_short_words_need_one_look_up_a_step(monkeypatch):
    """Words that are never rescaled: the same sums as with rescaling, by one look-up a step in the table of beginnings."""
    from wardline.llm import language_id as module

    pieces = sorted({SPACE, SPACE + "a", "a", "b", "ab", "ba", "abba"})
    lattice = Lattice(pieces)
    tables = [[0.01 * (k + 1) / (j + 1) for k in range(len(pieces))] + [UNKNOWN] for j in range(3)]
    words = [SPACE + "abbaabxab", SPACE + "b", SPACE + "ab" * 7, SPACE + "xyz"]
    lattice.index = None  # only the table of beginnings is asked
    short = [lattice.log_probability(w, tables) for w in words]
    monkeypatch.setattr(module, "STRIDE", 2)
    rescaled = [lattice.log_probability(w, tables) for w in words]
    assert all(math.isclose(x, y, rel_tol=1e-12) for a, b in zip(short, rescaled, strict=True) for x, y in zip(a, b, strict=True))
