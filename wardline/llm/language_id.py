"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability under a language is
the sum over all ways to cut it into pieces, by a forward algorithm over its characters; a text's is the product over
its words and the language's share. Piece probabilities are trained here, by expectation-maximisation over the same
segmentations (forward-backward), on a bounded sample of labelled texts: about ``SAMPLE`` documents a language, drawn by
a hash of the id, and their words; the vocabulary itself is only read. Every text is scored whole. Words are lower-cased
and scored once: workers keep a bounded table of their log-probabilities.

Defined results: a null text or one without a letter is ``und`` with score 0; without any learned language all texts are
``und``; null labels are not learned from; null ids are not held out and not learned from; repeated rows are judged
alike; an empty table gives no rows; the language, the source and the id of a row are no inputs of its prediction.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.text_arrays import utf8
from wardline.llm.units import Tokeniser

#: Labelled documents of a language that the model is fitted on at most (about), rounds of training, and distinct words of these documents, the most common first, equal ones by name.
SAMPLE, ROUNDS, TYPES = 400, 3, 12_000
SPACE = "▁"
#: Probability of a character that no piece covers, and the weight that every piece has before training.
UNKNOWN, PRIOR = 1e-7, 0.02
#: Characters between two rescalings of the sums, and up to which a word is trained on without logarithms, and kept in a worker's table.
STRIDE, REACH, KEPT = 16, 40, 256
WORD = re.compile(r"[^\W\d_]+")


def vocabulary(path: str) -> list[str]:
    """Lower-cased text pieces of a sentencepiece model, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return sorted({p.lower() for p in kept})


class Lattice:
    """Segmentations of words into the pieces of a vocabulary."""

    def __init__(self, pieces: list[str]):
        self.pieces, self.index = pieces, {p: i for i, p in enumerate(pieces)}
        #: The number of every piece, -2 for other beginnings of pieces: one look-up a step.
        self.starts = dict.fromkeys((p[:n] for p in pieces for n in range(1, len(p) + 1)), -2) | self.index
        self.longest = max(map(len, pieces), default=1)

    def arcs(self, word: str) -> Iterator[tuple[int, int, int]]:
        """(begin, end, piece) of all pieces in the word, by begin; piece -1 is a character without any piece of its own."""
        find, n = self.starts.get, len(word)
        for begin in range(n):
            if find(word[begin], -2) < 0:
                yield begin, begin + 1, -1
            for end in range(begin + 1, n + 1):
                piece = find(word[begin:end])
                if piece is None:
                    break
                if piece >= 0:
                    yield begin, end, piece

    def log_probability(self, word: str, tables: list[list[float]]) -> list[float]:
        """Log of the sum over all segmentations of the whole word, for each language. tables: piece probabilities, with UNKNOWN at the end.

        The sums that are still open are rescaled every ``STRIDE`` characters, so that they can't underflow in words of any length.
        """
        n, due = len(word), STRIDE
        if n <= STRIDE:  # nothing is rescaled: a language at a time, in the same order of sums
            arcs, out = list(self.arcs(word)), []
            for p in tables:
                alpha = [1.0] + [0.0] * n
                for begin, end, piece in arcs:
                    alpha[end] += alpha[begin] * p[piece]
                out.append(math.log(alpha[n]))
            return out
        alphas, out = [[1.0] + [0.0] * n for _ in tables], [0.0] * len(tables)
        for begin, end, piece in self.arcs(word):  # in order of their begin: a prefix is complete before it is used
            if begin >= due:
                due = begin + STRIDE
                for k, alpha in enumerate(alphas):
                    top = max(alpha[begin : begin + self.longest])
                    alpha[begin : begin + self.longest] = [x / top for x in alpha[begin : begin + self.longest]]
                    out[k] += math.log(top)
            for alpha, p in zip(alphas, tables, strict=True):
                alpha[end] += alpha[begin] * p[piece]
        return [x + math.log(alpha[n]) for x, alpha in zip(out, alphas, strict=True)]

    def _expect_long(self, word: str, c: int, probability: list[float], expected: np.ndarray) -> None:
        """Adds a long word's expected pieces, by logarithms."""
        n, arcs = len(word), list(self.arcs(word))
        logs = [math.log(probability[piece] if piece >= 0 else UNKNOWN) for _, _, piece in arcs]
        alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        alpha[0] = beta[n] = 0.0
        for (begin, end, _), p in zip(arcs, logs, strict=True):
            alpha[end] = np.logaddexp(alpha[end], alpha[begin] + p)
        for (begin, end, _), p in zip(reversed(arcs), reversed(logs), strict=True):
            beta[begin] = np.logaddexp(beta[begin], beta[end] + p)
        for (begin, end, piece), p in zip(arcs, logs, strict=True):
            if piece >= 0:
                expected[piece] += c * math.exp(alpha[begin] + p + beta[end] - alpha[n])

    def train(self, words: Counter, rounds: int = ROUNDS) -> np.ndarray:
        """Piece probabilities of one language, by expectation-maximisation."""
        p = np.full(len(self.pieces), 1 / len(self.pieces))
        lattices = [(len(w), list(self.arcs(w)), c) for w, c in words.items() if len(w) <= REACH]
        long = [(w, c) for w, c in words.items() if len(w) > REACH]
        for _ in range(rounds):
            expected = np.full(len(p), PRIOR)
            probability = p.tolist()
            for n, arcs, c in lattices:
                alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
                alpha[0] = beta[n] = 1.0
                for begin, end, piece in arcs:
                    alpha[end] += alpha[begin] * (probability[piece] if piece >= 0 else UNKNOWN)
                if alpha[n] < 1e-290:
                    continue
                for begin, end, piece in reversed(arcs):
                    beta[begin] += beta[end] * (probability[piece] if piece >= 0 else UNKNOWN)
                for begin, end, piece in arcs:
                    if piece >= 0:
                        expected[piece] += c * alpha[begin] * probability[piece] * beta[end] / alpha[n]
            for w, c in long:
                self._expect_long(w, c, probability, expected)
            p = expected / expected.sum()
        return p


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased, marked as words."""
    return [SPACE + w for w in WORD.findall(text.lower())]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, size: int) -> DataFrame:
    """(lang, text): about ``size`` labelled documents of each language that are not held out, and each language's number."""
    rows = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    return rows.join(F.broadcast(counts) if counts.count() < 10_000 else counts, "lang").filter((share * F.col("n") < size) & F.col("text").isNotNull()).select("lang", "text", "n")


class Model:
    """Languages, the logs of their shares, and piece probabilities."""

    def __init__(self, rows, path: str):
        self.path, words, shares = path, {}, {}
        for r in rows:
            shares[r["lang"]] = r["n"]
            words.setdefault(r["lang"], Counter()).update(words_of(r["text"]))
        self.langs = sorted(x for x in words if words[x])
        lattice = Lattice(vocabulary(path))
        self.p = np.stack([lattice.train(Counter(dict(sorted(words[x].items(), key=lambda i: (-i[1], i[0]))[:TYPES]))) for x in self.langs]) if self.langs else np.zeros((0, len(lattice.pieces)))
        total = sum(shares[x] for x in self.langs)
        self.prior = np.log([shares[x] / total for x in self.langs]) if self.langs else np.zeros(0)


class Scorer:
    """A worker's table of the words' log-probabilities under each language."""

    def __init__(self, model: Model):
        self.model, self.lattice = model, Lattice(vocabulary(model.path))
        self.tables = [[*row, UNKNOWN] for row in model.p.tolist()]
        self.words: dict[str, list[float]] = {}
        self.table = Tokeniser(self._scores, spaced=False, dtype=np.float32, bits=19)

    def _scores(self, units: list[str]) -> list[list[float]]:
        out = []
        for u in units:
            total = [0.0] * len(self.tables)
            for w in words_of(u):
                if (known := self.words.get(w)) is None:
                    if len(self.words) > 300_000:
                        self.words.clear()
                    known = self.lattice.log_probability(w, self.tables)
                    if len(w) <= KEPT:
                        self.words[w] = known
                total = [a + b for a, b in zip(total, known, strict=True)]
            out.append(total)
        return out

    def texts(self, column: pa.Array) -> np.ndarray:
        """Rows x languages: log of share and text together."""
        k = len(self.model.langs)
        out = np.tile(self.model.prior, (len(column), 1))
        for i, j, _, _, _, doc, rows in self.table.texts(column):
            first = self.table.table.first[rows]
            values = self.table.table.values[first[:, None] + np.arange(k)].astype(np.float64)
            for c in range(k):
                out[i:j, c] += np.bincount(doc, values[:, c], j - i)
        return out


_held: dict = {}


def _scorer(broadcast) -> Scorer:
    if _held.get("of") is not broadcast:
        _held.clear()
        _held.update(of=broadcast, scorer=Scorer(broadcast.value))
    return _held["scorer"]


def language_id(docs: DataFrame, path: str, size: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score (posterior) of each row of ``docs`` (doc_id, text, lang)."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(Model(sample(docs, size).toLocalIterator(), path))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))

    def predict(batches):
        for b in batches:
            scorer, langs = _scorer(held), held.value.langs
            data, offs = utf8(b.column(2))
            plain = pc.match_substring_regex(pc.fill_null(b.column(2), ""), r"\pL").to_numpy(zero_copy_only=False)
            known = plain & (len(langs) > 0)
            if len(langs):
                logs = scorer.texts(b.column(2))
                best = logs.argmax(axis=1)
                score = 1 / np.exp(np.maximum(logs - logs.max(axis=1, keepdims=True), -700)).sum(axis=1)
                names = np.array([*langs, "und"], object)[np.where(known, best, len(langs))]
            else:
                score, names = np.zeros(len(known)), np.full(len(known), "und", object)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names.tolist(), pa.string()), pa.array(np.where(known, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(predict, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
