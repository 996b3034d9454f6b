"""Language identification with string kernels.

A text is the set of its letter n-grams of 1 to 3 code points (presence, not
counts), after lower-casing; words are padded with a blank, other signs are
dropped. The blended-spectrum kernel of two texts is the size of the common
n-grams over the root of the product of their sizes. Landmark texts from the
labelled part span a Nystroem feature space, in which one ridge regression per
language is fitted against the others.

Scoring multiplies a batch's sparse presence matrix with one dense matrix
(n-grams by languages), the product of landmark presence and regression
weights: the kernel with all landmarks and the regression in one step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed_text, passages, prepare
from .quality_rules import held_out

#: documents per language that are fitted, documents of all languages, and characters of text of all of them, at most
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS, SAMPLE_CHARS = 400, 25_600, 8 << 20
#: longer texts than TEXT_CHARS are learned from by passages of PASSAGE code points
TEXT_CHARS, PASSAGE = 64 << 10, 2_000
#: the first of a language are found in slices of ids, so that no task ranks a whole language
SLICES = 8
LANDMARKS = 256
RIDGE = 1e-3
#: a letter is named by its code point below this, and by a hash above
LETTERS = 1 << 10
#: score of a text is the logistic of its margin times this
SLOPE = 12.0

_ids: np.ndarray | None = None


def _letter_ids() -> np.ndarray:
    """Code point -> 1 .. LETTERS - 1 for letters (lower-cased), 0 for all else."""
    global _ids
    if _ids is None:
        table = np.zeros(0x110000, dtype=np.uint16)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = ord(c.lower()[0])
                table[cp] = low if low < LETTERS // 2 else LETTERS // 2 + low % (LETTERS // 2 - 1)
        _ids = table
    return _ids


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text) if len(text) < 64 else bool(_letter_ids()[_points(text)].any())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def presence(text: str) -> np.ndarray:
    """Sorted codes of the distinct n-grams of a text; empty without a letter."""
    x = _letter_ids()[_points(text)].astype(np.uint32)
    x = np.concatenate([[0], x, [0]]).astype(np.uint32)
    x = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]     # one blank between words
    if len(x) < 3:
        return np.zeros(0, np.uint32)
    one = x[x > 0]
    two = (np.uint32(1) << np.uint32(30)) | (x[:-1] << np.uint32(10)) | x[1:]
    three = (np.uint32(2) << np.uint32(30)) | (x[:-2] << np.uint32(20)) | (x[1:-1] << np.uint32(10)) | x[2:]
    return np.unique(np.concatenate([one, two, three]))


@dataclass
class LanguageModel:
    languages: list[str]
    grams: np.ndarray                        # sorted codes of the landmarks' n-grams
    weights: np.ndarray                      # (n-grams, languages)
    bias: np.ndarray

    def margins(self, sets: list[np.ndarray]) -> np.ndarray:
        """(texts, languages): presence matrix, scaled by the root of its row sizes, times weights."""
        sizes = np.array([len(s) for s in sets])
        codes = np.concatenate(sets) if sets else np.zeros(0, np.uint32)
        row = np.repeat(np.arange(len(sets)), sizes)
        at = np.searchsorted(self.grams, codes)
        at[at == len(self.grams)] = 0
        known = self.grams[at] == codes if len(self.grams) else np.zeros(len(codes), bool)
        row, at = row[known], at[known]
        out = np.column_stack([np.bincount(row, weights=self.weights[at, j], minlength=len(sets))
                               for j in range(len(self.languages))]) if self.languages else np.zeros((len(sets), 0))
        return out / np.sqrt(np.maximum(sizes, 1))[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) per text; ``und`` and 0 without a letter."""
        sets = [presence(t or "") for t in texts]
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        m = self.margins(sets)
        top = m.argmax(axis=1)
        p = np.exp(SLOPE * (m - m.max(axis=1, keepdims=True)))
        score = 1 / p.sum(axis=1)
        empty = np.array([not len(s) for s in sets], dtype=bool)
        return (["und" if e else self.languages[j] for e, j in zip(empty, top)], np.where(empty, 0.0, score))


def fit_language(texts: list[str], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE,
                 seed: int = 3) -> LanguageModel:
    """Nystroem map of the kernel on ``landmarks`` texts and ridge regressions."""
    sets = [presence(t) for t in texts]
    use = [i for i, s in enumerate(sets) if len(s)]
    languages = sorted({langs[i] for i in use})
    if not languages:
        return LanguageModel([], np.zeros(0, np.uint32), np.zeros((0, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    chosen: list[int] = []
    for lang in languages:                   # as many landmarks of every language
        own = [i for i in use if langs[i] == lang]
        chosen += [own[k] for k in rng.permutation(len(own))[:max(1, landmarks // len(languages))]]
    grams = np.unique(np.concatenate([sets[i] for i in chosen]))
    land = np.zeros((len(chosen), len(grams)), dtype=np.float32)
    for r, i in enumerate(chosen):
        land[r, np.searchsorted(grams, sets[i])] = 1 / np.sqrt(len(sets[i]))
    k_mm = (land @ land.T).astype(float)
    value, vector = np.linalg.eigh(k_mm)
    root = vector / np.sqrt(np.maximum(value, 1e-8))      # K_mm^(-1/2)
    root = root[:, value > 1e-6 * value.max()]
    k_nm = np.zeros((len(use), len(chosen)))
    for a in range(0, len(use), 64):         # presence in batches
        part = np.zeros((len(use[a:a + 64]), len(grams)), dtype=np.float32)
        for r, i in enumerate(use[a:a + 64]):
            at = np.searchsorted(grams, sets[i])
            at[at == len(grams)] = 0
            part[r, at[grams[at] == sets[i]]] = 1 / np.sqrt(len(sets[i]))
        k_nm[a:a + 64] = part @ land.T
    z = k_nm @ root
    y = np.array([[1.0 if langs[i] == lang else -1.0 for lang in languages] for i in use])
    weight = np.array([1 / max(1, sum(langs[i] == langs[j] for j in use)) for i in use]) if len(use) < 50 else None
    if weight is None:
        count = {lang: sum(langs[i] == lang for i in use) for lang in languages}
        weight = np.array([1 / count[langs[i]] for i in use])
    weight = weight / weight.sum()           # every language weighs the same
    mean_z, mean_y = weight @ z, weight @ y
    zc, yc = z - mean_z, y - mean_y
    beta = np.linalg.solve((zc * weight[:, None]).T @ zc + ridge * np.eye(z.shape[1]), (zc * weight[:, None]).T @ yc)
    return LanguageModel(languages, grams, land.T.astype(float) @ (root @ beta), mean_y - mean_z @ beta)


def fit_languages(docs: DataFrame, modulus: int = 4, remainder: int = 2, per_language: int = SAMPLE_PER_LANGUAGE,
                  sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, text_chars: int = TEXT_CHARS) -> LanguageModel:
    """Fit on the first documents of every language by a hash of the id, at most
    ``per_language`` each, ``sample_rows`` and ``sample_chars`` in all; every language has
    its first document in before any its second. A text of more than ``text_chars``
    gives passages from all over it. Where an id has several rows, the first by
    language and hash of the text stands for it."""
    rows = (docs.filter("lang is not null and text is not null and doc_id is not null")
            .filter(~held_out(F.col("doc_id"), modulus, remainder))
            .select("doc_id", "lang", F.least(F.length("text"), F.lit(text_chars)).alias("n"), F.xxhash64("doc_id", F.lit(11)).alias("o")))
    # two steps: the first of every language in each slice of ids, then over the slices
    per_slice = Window.partitionBy("lang", "slice").orderBy("o", "doc_id")
    per_lang = Window.partitionBy("lang").orderBy("o", "doc_id")
    first = (rows.withColumn("slice", F.pmod("o", F.lit(SLICES)))
             .withColumn("r", F.row_number().over(per_slice)).filter(F.col("r") <= per_language)
             .withColumn("r", F.row_number().over(per_lang)).filter(F.col("r") <= per_language)
             .orderBy("r", "o", "doc_id", "lang").limit(sample_rows).select("doc_id", "n").collect())
    ids, total = {}, 0
    for r in first:                          # at most sample_rows ids
        if total + r["n"] <= sample_chars and r["doc_id"] not in ids:
            ids[r["doc_id"]] = None
            total += r["n"]
    spark = docs.sparkSession
    taken = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    drawn = passages(F.col("text"), F.col("doc_id"), text_chars, PASSAGE)
    sample = (docs.join(F.broadcast(taken), "doc_id").filter("lang is not null and text is not null")
              .groupBy("doc_id").agg(F.min(F.struct("lang", F.xxhash64("text").alias("o"), drawn.alias("text"))).alias("m"))
              .select("doc_id", "m.lang", "m.text").collect())
    sample.sort(key=lambda r: (r["doc_id"], r["lang"], r["text"]))
    return fit_language([r["text"] for r in sample], [r["lang"] for r in sample])


def language_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    per_language: int = SAMPLE_PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS,
                    text_chars: int = TEXT_CHARS) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    ``und`` with score 0 for a null text, one without a letter, or if nothing
    could be learned. Texts of any length are predicted whole; of languages with
    equal margins the first in order is taken. Null languages are never learned from;
    repeated rows are predicted one by one; an empty table gives an empty result; other columns
    are ignored.
    """
    spark = df.sparkSession
    prepare(spark)
    docs = keyed_text(df, id_col, text_col)
    labelled = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                         F.col(f"`{lang_col}`").alias("lang"))
    model = spark.sparkContext.broadcast(fit_languages(
        labelled, per_language=per_language, sample_rows=sample_rows, sample_chars=sample_chars, text_chars=text_chars))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            langs, scores = model.value.predict(batch.column(1).to_pylist())
            yield pa.record_batch([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                  names=["doc_id", "lang_pred", "score"])
    return (docs.mapInArrow(run, "doc_id long, lang_pred string, score double")
            .select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score"))
