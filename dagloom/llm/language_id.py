"""Language identification by unigram pieces, summed over all segmentations.

Every language has a probability for each piece of a fixed public vocabulary.
A word's probability is the sum over all its segmentations into pieces, which
a forward pass over its letters gives; a text's is the product over its words.
Piece probabilities are fitted by expectation maximisation (forward-backward
over the same lattice) on the words of a bounded sample of labelled documents.
Words of equal length are scored together as arrays, each distinct word once;
long words are scored one by one, with their probabilities rescaled on the way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

VOCABULARY = "piece_bpe_32k.model"
#: Labelled documents for each language that a fit reads at most (about).
SAMPLE_DOCS = 400
#: Letters of the longest words that are scored together (and that a fit reads), and positions of a longer one held at once.
MAX_WORD, STEP = 30, 4096
ROUNDS = 3
#: A letter that is no piece, and a piece never seen, have this probability.
FLOOR = 1e-7
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pieces(path: str | None = None) -> list[str]:
    """The vocabulary's pieces of letters, lower-cased, sorted (a leading mark: word begin)."""
    import public_tokenizers
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    out = set()
    for k in range(p.get_piece_size()):
        w = p.id_to_piece(k).replace("▁", "_").lower()
        if w and (w.removeprefix("_").isalpha() or w == "_"):
            out.add(w)
    return sorted(out)


def _codes(words: list[str], n: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), n).astype(np.uint64)


def _hash(prefix: np.ndarray, power: np.ndarray, i: int, j: int) -> np.ndarray:
    return prefix[:, j] - prefix[:, i] * power[j - i]


class Lattice:
    """Finds the pieces in words by rolling hashes."""

    def __init__(self, vocabulary: list[str]):
        self.n = len(vocabulary)
        self.most = max(map(len, vocabulary), default=1)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(self.most, _MIX))))
        self.keys, self.ids = {}, {}
        for m in range(1, self.most + 1):
            at = [k for k, w in enumerate(vocabulary) if len(w) == m]
            if at:
                key = self._prefix(_codes([vocabulary[k] for k in at], m))[:, m]
                order = np.argsort(key)
                self.keys[m], self.ids[m] = key[order], np.array(at)[order]

    def _prefix(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        if len(codes) == 1:
            h, mask, plain = 0, (1 << 64) - 1, codes[0].tolist()
            mixed = int(_MIX)
            out[0, 1:] = [h := (h * mixed + c) & mask for c in plain]
            return out
        for j in range(codes.shape[1]):
            out[:, j + 1] = out[:, j] * _MIX + codes[:, j]
        return out

    def arcs(self, words: list[str]):
        """For words of one length: (from, to, piece of every word; ``n`` where there is none)."""
        size = len(words[0])
        prefix = self._prefix(_codes(words, size))
        for j in range(1, size + 1):
            for m in range(1, min(j, self.most) + 1):
                if m in self.keys:
                    yield j - m, j, self._find(m, _hash(prefix, self.power, j - m, j))

    def _find(self, m: int, h: np.ndarray) -> np.ndarray:
        k = np.minimum(np.searchsorted(self.keys[m], h), len(self.keys[m]) - 1)
        return np.where(self.keys[m][k] == h, self.ids[m][k], self.n)

    def pieces_at(self, word: str) -> dict[int, np.ndarray]:
        """For every length m the piece at each place of one word (``n``: none)."""
        prefix = self._prefix(_codes([word], len(word)))[0]
        return {m: self._find(m, prefix[m:] - prefix[:-m] * self.power[m]) for m in self.keys if m <= len(word)}


def _by_length(words: list[str]):
    size = np.array([len(w) for w in words])
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        for lo in range(0, len(at), 8_000):
            part = at[lo : lo + 8_000]
            yield part, [words[k] for k in part]


def _forward(arcs: list, words: int, size: int, table: np.ndarray, n: int) -> np.ndarray:
    alpha = np.zeros((size + 1, words, table.shape[1]))
    alpha[0] = 1
    for i, j, piece in arcs:
        alpha[j] += alpha[i] * table[piece]
        if j - i == 1:  # a letter on its own is always possible
            alpha[j] += alpha[i] * (FLOOR * (piece == n))[:, None]
    return alpha


def _long_score(word: str, table: np.ndarray, lattice: Lattice) -> np.ndarray:
    """Log of the forward sum of one word of any length, rescaled at every letter."""
    at, n, width = lattice.pieces_at(word), len(word), table.shape[1]
    last = np.zeros((lattice.most, width))  # sums at the letters before, the nearest first
    last[0] = 1
    log = np.zeros(width)
    for lo in range(0, n, STEP):
        size = min(STEP, n - lo)
        weight = np.zeros((size, lattice.most, width))
        for m, piece in at.items():
            begin = np.arange(lo, lo + size) + 1 - m  # pieces of m letters that end there
            ok = begin >= 0
            weight[ok, m - 1] = table[piece[begin[ok]]]
            if m == 1:
                weight[ok, 0] += (FLOOR * (piece[begin[ok]] == lattice.n))[:, None]
        if 1 not in at:
            weight[:, 0] = FLOOR
        for w in weight:
            now = (last * w).sum(0)
            last[1:] = last[:-1]
            last[0] = now
            top = last.max(0)
            last /= top
            log += np.log(top)
    return log + np.log(last[0])


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    vocabulary: tuple[str, ...]
    #: pieces + 1 rows (the last is zero: no piece), a column for each language
    table: np.ndarray

    def word_scores(self, words: list[str], lattice: Lattice) -> np.ndarray:
        """Log probability of every word in every language."""
        out = np.zeros((len(words), len(self.languages)))
        for at, part in _by_length(words):
            if len(part[0]) > MAX_WORD:
                out[at] = [_long_score(w, self.table, lattice) for w in part]
            else:
                alpha = _forward(list(lattice.arcs(part)), len(part), len(part[0]), self.table, lattice.n)
                out[at] = np.log(alpha[-1])
        return out


def letter_words(text: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Lower-case letter runs of every text with a leading mark; as ``split_words``."""
    at, words, codes = C.split_words(pc.utf8_lower(pc.replace_substring_regex(text, r"\PL+", " ")), lower=False)
    return at, ["_" + w.decode() for w in words], codes


def _sample(docs: DataFrame, per_language: int) -> DataFrame:
    labelled = docs.where("lang is not null and text is not null")
    count = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0)
    for lang, n in sorted(count.items()):
        share = F.when(F.col("lang") == lang, int(1_000_000 * min(1.0, per_language / n))).otherwise(share)
    return labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < share)


def _counts(sample: DataFrame) -> list:
    """``lang, word, n`` over the sample's words."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang = np.array(batch.column("lang").to_pylist(), object)
        at, words, codes = letter_words(C.texts(batch))
        where = np.repeat(lang, np.diff(at))
        got: dict = {}
        for name in sorted(set(lang)):
            n = np.bincount(codes[where == name], minlength=len(words))
            got[name] = [(words[k], int(n[k])) for k in np.flatnonzero(n) if len(words[k]) <= MAX_WORD]
        rows = [(x, w, n) for x, v in got.items() for w, n in v]
        return pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])

    got = sample.select("lang", "text").mapInArrow(C.batches(one), "lang string, word string, n long")
    return got.groupBy("lang", "word").agg(F.sum("n").alias("n")).collect()


def learn(docs: DataFrame, per_language: int = SAMPLE_DOCS, vocabulary: list[str] | None = None) -> Model:
    """Fit on at most about ``per_language`` documents of each value of ``lang``.

    Collected are the sample's distinct words of up to ``MAX_WORD`` letters with
    their counts.  Languages count as equally likely beforehand.
    """
    vocabulary = vocabulary or pieces()
    lattice = Lattice(vocabulary)
    by: dict[str, dict[str, int]] = {}
    for r in _counts(_sample(docs, per_language)):
        by.setdefault(r.lang, {})[r.word] = r.n
    languages = sorted(by)
    columns = []
    for lang in languages:
        words = sorted(by[lang])
        n = np.array([by[lang][w] for w in words], float)
        groups = [(n[at], len(part), len(part[0]), list(lattice.arcs(part))) for at, part in _by_length(words)]
        seen = np.zeros(lattice.n + 1)
        for count, _, _, arcs in groups:
            for _, _, piece in arcs:
                seen += np.bincount(piece, count, minlength=lattice.n + 1)
        for _ in range(ROUNDS + 1):
            seen[lattice.n] = 0
            p = (seen + 0.01) / (seen.sum() + 0.01 * lattice.n)
            p[lattice.n] = 0
            if _ == ROUNDS:
                break
            seen = np.zeros(lattice.n + 1)
            for count, rows, size, arcs in groups:
                alpha = _forward(arcs, rows, size, p[:, None], lattice.n)[:, :, 0]
                beta = np.zeros_like(alpha)
                beta[size] = 1
                for i, j, piece in reversed(arcs):
                    beta[i] += beta[j] * (p[piece] + (FLOOR * (piece == lattice.n) if j - i == 1 else 0))
                for i, j, piece in arcs:
                    seen += np.bincount(piece, count * alpha[i] * p[piece] * beta[j] / alpha[size], minlength=lattice.n + 1)
        columns.append(p)
    table = np.stack(columns, axis=1) if columns else np.zeros((lattice.n + 1, 0))
    return Model(tuple(languages), tuple(vocabulary), table)


def predict(docs: DataFrame, model: Model, carry: bool = False) -> DataFrame:
    """``doc_id, lang_pred, score`` of every document, from its text alone.

    With ``carry`` all columns of ``docs`` come before the two (which replace
    columns of their names).

    ``score`` is the language's share of the summed probability.  A text that is
    null or has no letters is ``und`` with score 0, as is any text if nothing
    was learned.  Words of any length are summed over all their segmentations.
    Ties go to the first language by name; repeated rows are predicted each on
    its own; a null doc_id stays null; other columns are ignored unless carried;
    an empty table gives an empty result.
    """
    languages = np.array([*model.languages, "und"], object)

    def body(it):
        lattice = Lattice(list(model.vocabulary))
        known: dict[str, int] = {}
        kept = np.zeros((1 << 12, len(model.languages)))
        for batch in it:
            for part in C.parts(batch):
                at, words, codes = letter_words(C.texts(part))
                if len(known) > 200_000:
                    known.clear()
                new = [w for w in dict.fromkeys(words) if w not in known]
                if new:
                    need = len(known) + len(new)
                    while need > len(kept):
                        kept = np.concatenate((kept, np.zeros_like(kept)))
                    kept[len(known) : need] = model.word_scores(new, lattice)
                    known.update(zip(new, range(len(known), need), strict=True))
                where = np.fromiter((known[w] for w in words), np.int64, len(words))
                if sum(len(w) for w in new if len(w) > MAX_WORD) > 4 << 20:
                    known.clear()
                rows, n = part.num_rows, np.diff(at)
                doc = np.repeat(np.arange(rows), n)
                ids = where[codes]
                total = np.stack([np.bincount(doc, kept[ids, k], minlength=rows) for k in range(kept.shape[1])], axis=1) if kept.shape[1] else np.zeros((rows, 0))
                some = (n > 0) & (total.shape[1] > 0)
                best = np.full(rows, len(model.languages))
                score = np.zeros(rows)
                if some.any():
                    t = total[some]
                    best[some] = t.argmax(1)
                    score[some] = 1 / np.exp(t - t.max(1, keepdims=True)).sum(1)
                yield pa.record_batch([*part.columns[:kept_columns], pa.array(languages[best], pa.string()), pa.array(score)], [*part.schema.names[:kept_columns], "lang_pred", "score"])
        del known, kept, lattice
        C.release()

    docs = docs.drop("lang_pred", "score") if carry else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kept_columns = len(docs.columns) if carry else 1
    schema = T.StructType([*docs.schema.fields[:kept_columns], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(body, schema)
