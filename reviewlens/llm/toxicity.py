"""Toxicity: character n-gram embeddings averaged into a linear softmax.

A text is lower-cased (A-Z) and split into words of letters, digits and
non-ASCII code points; every byte n-gram of ``<word>`` (n = 3 to 6) falls into
one of 2^20 buckets. The vectors of the n-grams of a window of words are averaged
and a linear softmax over the two classes gives its score. Windows overlap by half,
and a text has the score of its most toxic window: what stands around a toxic
passage, and how much of it, does not matter. Vectors and softmax are
trained together by stochastic gradient steps in numpy, on the window that decides.
Misspelt words share most n-grams with the words seen in training.

Training uses a bounded sample of labelled rows (``sample_rows`` documents,
``sample_bytes`` of text, half of it for either label); a text of any length may be
drawn, and one of more than ``text_bytes`` gives passages from all over it. For
scoring, the softmax is multiplied into the vectors, which leaves one number per
bucket, 4 MB for the executors.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free, keyed_text, materialize, passages, prepare, text_hash
from .quality_rules import held_out, labelled_ids
from .shingles import mix64, row_chunks, text_buffers

SIZES = (3, 4, 5, 6)
BUCKET_BITS = 20
DIM = 4
#: words of a step; the n-grams of two neighbouring steps, a window, are averaged
STEP = 12
#: a third of the sample has label 1; longer texts than TEXT_BYTES are sampled by passages of PASSAGE code points
SAMPLE_ROWS = 6_000
SAMPLE_BYTES, TEXT_BYTES, PASSAGE = 16 << 20, 256 << 10, 2_000
#: passes over whole texts, then passes over single windows
WARM, EPOCHS = 2, 16
BATCH, RATE = 16, 0.3
#: a missed text of label 1 weighs so much more in training than a false alarm
TOXIC_WEIGHT = 5.0
#: share of the texts of label 0 that stand for their most toxic window in a pass
HARD = 0.8
#: share of the n-grams left out at random in each step, so that no single one must be present
DROPOUT = 0.4
#: n-grams of fewer training texts, or of a larger share of those of label 0, carry no evidence: their
#: vector is zero
MIN_TEXTS, MAX_SHARE = 4, 0.1
#: zero vectors that join every average: a window of a few words stays near the prior
SMOOTH = 200.0
#: the mean of the vectors is scaled by this
GAIN = 60.0
#: n-grams are hashed in chunks of this many bytes
CHUNK = 1 << 18

_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] = np.arange(97, 123)
_word = np.zeros(256, dtype=bool)
_word[48:58] = _word[97:123] = _word[65:91] = _word[0x80:] = True
_fold[~_word] = 0x20
_byte = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 63, 256, dtype=np.uint64)


def step_ngrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every n-gram, its step, steps of each row).

    Steps are ``STEP`` consecutive words; a row has one at least. A word that a
    step repeats counts once.
    """
    rows = len(offsets) - 1
    # one space before every row and one at the end: rows cannot share an n-gram
    s = np.full(len(raw) + rows + 1, 0x20, dtype=np.uint8)
    at = np.arange(len(raw)) + np.repeat(np.arange(1, rows + 1), np.diff(offsets))
    s[at] = _fold[raw]
    space = s == 0x20
    starts = ~space
    starts[1:] &= space[:-1]
    row_start = offsets[:-1] + np.arange(rows)
    words_before = np.concatenate([[0], np.cumsum(starts)])
    words = words_before[np.append(row_start[1:], len(s))] - words_before[row_start]
    steps = np.maximum(-(-words // STEP), 1)
    base = np.cumsum(steps) - steps
    local = np.arange(words.sum()) - np.repeat(np.cumsum(words) - words, words)
    step_of = np.repeat(base, words) + local // STEP
    before = np.concatenate([[0], np.cumsum(space)])
    key = _byte[s]
    buckets, owner = [], []
    for n in SIZES:
        m = len(s) - n + 1
        if m <= 0:
            continue
        # spaces only at the ends
        i = np.flatnonzero(before[n - 1:n - 1 + m] == before[1:m + 1])
        h = np.full(len(i), n, dtype=np.uint64)
        for j in range(n):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += key[i + j]
        buckets.append((mix64(h) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
        owner.append(words_before[i + 2] - 1)            # the word that covers byte i + 1
    bucket = np.concatenate(buckets) if buckets else np.zeros(0, np.int32)
    word = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    # the sum of its buckets names a word inside its step
    name = np.bincount(word, weights=bucket, minlength=len(step_of)).astype(np.int64)
    _, first = np.unique(step_of * (1 << 32) + name % (1 << 32), return_index=True)
    once = np.zeros(len(step_of), dtype=bool)
    once[first] = True
    keep = once[word]
    return bucket[keep], step_of[word[keep]], steps


@dataclass
class ToxicityModel:
    weight: np.ndarray                       # per bucket: difference of the class logits
    bias: float = 0.0

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row: that of its most toxic window."""
        out = np.empty(len(offsets) - 1)
        for a, b in row_chunks(offsets, CHUNK):
            sums, counts, rows = [], [], []
            for part, shift in _pieces(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]):
                bucket, owner, steps = step_ngrams(part, shift)
                n = int(steps.sum())
                sums.append(np.bincount(owner, weights=self.weight[bucket], minlength=n))
                counts.append(np.bincount(owner, minlength=n))
                rows.append(np.repeat(np.arange(b - a), steps) if b - a > 1 else np.zeros(n, np.int64))
            row = np.concatenate(rows)
            mean = window_means(np.concatenate(sums), np.concatenate(counts), row)
            out[a:b] = np.maximum.reduceat(mean, np.flatnonzero(np.diff(row, prepend=-1)))
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -30, 30)))


def window_means(sums: np.ndarray, counts: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Mean of every step with the next one of its row, if there is one."""
    pair = np.append(row[1:] == row[:-1], False)
    return (sums + np.where(pair, np.roll(sums, -1), 0)) / (counts + np.where(pair, np.roll(counts, -1), 0) + SMOOTH)


def _pieces(raw: np.ndarray, offsets: np.ndarray):
    """A chunk of rows as it is; a single very long text in parts cut between words."""
    if len(offsets) > 2 or len(raw) <= 2 * CHUNK:
        yield raw, offsets
        return
    at = 0
    while at < len(raw):
        end = min(at + CHUNK, len(raw))
        if end < len(raw):
            stop = np.flatnonzero(~_word[raw[end:end + CHUNK]])
            end = end + int(stop[0]) if len(stop) else min(end + CHUNK, len(raw))
        yield raw[at:end], np.array([0, end - at])
        at = end


def train(texts: list[str], y: np.ndarray, toxic_weight: float = TOXIC_WEIGHT, seed: int = 5) -> ToxicityModel:
    """Joint training of vectors and softmax on windows.

    In each pass a text stands for one window: the most toxic one under the
    current model, or a random one for some texts of label 0. In the first
    passes it stands whole.
    """
    size = 1 << BUCKET_BITS
    if not len(texts) or y.min() == y.max():
        p = np.clip(y.mean() if len(texts) else 0.0, 0.01, 0.99)
        return ToxicityModel(np.zeros(size, np.float32), float(np.log(p / (1 - p))))
    # some 3 n-grams a byte, kept in a file and read by windows: the driver holds CHUNK of them at a time
    with tempfile.TemporaryFile() as grams:
        return _descend(grams, *_write_ngrams(grams, texts, y), y, toxic_weight, seed)


def _write_ngrams(grams, texts: list[str], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-grams of every step, first step of each text and one after the last, buckets
    that carry evidence); the n-grams of all steps in order go into the file."""
    size = 1 << BUCKET_BITS
    counts, base, texts_with, clean_with = [], [0], np.zeros(size, np.int32), np.zeros(size, np.int32)
    for t, label in zip(texts, y):
        raw = np.frombuffer(t.encode("utf-8"), dtype=np.uint8)
        b, o, steps = step_ngrams(raw, np.array([0, len(raw)]))
        b[np.argsort(o, kind="stable")].tofile(grams)
        counts.append(np.bincount(o, minlength=steps[0]))
        base.append(base[-1] + int(steps[0]))
        b = np.unique(b)
        texts_with[b] += 1
        clean_with[b] += label < 0.5
    known = (texts_with >= MIN_TEXTS) & (clean_with <= max(MIN_TEXTS, MAX_SHARE * (y < 0.5).sum()))
    return np.concatenate(counts), np.array(base), known


def _read_ngrams(grams, start: int, stop: int) -> np.ndarray:
    grams.seek(4 * int(start))
    return np.fromfile(grams, np.int32, int(stop - start))


def _step_sums(grams, weight: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the weights of the n-grams of every step, in reads of some CHUNK n-grams."""
    sums = np.zeros(len(at) - 1)
    a = 0
    while a < len(sums):
        b = max(a + 1, int(np.searchsorted(at, at[a] + CHUNK, side="right")) - 1)
        filled = np.flatnonzero(np.diff(at[a:b + 1]))
        if len(filled):
            sums[a + filled] = np.add.reduceat(weight[_read_ngrams(grams, at[a], at[b])], at[a + filled] - at[a])
        a = b
    return sums


def _descend(grams, n: np.ndarray, base: np.ndarray, known: np.ndarray, y: np.ndarray, toxic_weight: float, seed: int) -> ToxicityModel:
    size = len(known)
    at = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(y)), np.diff(base))
    rng = np.random.default_rng(seed)
    e = np.empty((size, DIM), np.float32)
    for i in range(0, size, CHUNK):
        e[i:i + CHUNK] = (rng.random((min(CHUNK, size - i), DIM)) - 0.5) * 0.1
    e[~known] = 0
    w = ((rng.random((DIM, 2)) - 0.5)).astype(np.float32)
    b = np.array([0.0, np.log(y.mean() / (1 - y.mean()))], dtype=np.float32)
    for epoch in range(WARM + EPOCHS):
        rate = RATE * (1 - epoch / (WARM + EPOCHS))
        weight = e @ (w[:, 1] - w[:, 0])
        mean = window_means(_step_sums(grams, weight, at), n, row)
        order = rng.permutation(len(y))
        for start in range(0, len(order), BATCH):
            batch = order[start:start + BATCH]
            pick = []
            for i in batch:
                if epoch < WARM:
                    pick.append(slice(at[base[i]], at[base[i + 1]]))     # the whole text
                else:
                    k = base[i] + (int(mean[base[i]:base[i + 1]].argmax()) if y[i] or rng.random() < HARD
                                   else int(rng.integers(base[i + 1] - base[i])))
                    pick.append(slice(at[k], at[min(k + 2, base[i + 1])]))
            idx = np.concatenate([_read_ngrams(grams, p.start, p.stop) for p in pick])
            many = np.array([p.stop - p.start for p in pick])
            val = np.repeat(np.float32(GAIN / (1 - DROPOUT)) / (many + SMOOTH), many).astype(np.float32)
            doc = np.repeat(np.arange(len(batch)), many)
            stay = (rng.random(len(idx)) >= DROPOUT) & known[idx]
            idx, val, doc = idx[stay], val[stay], doc[stay]
            v = np.zeros((len(batch), DIM), np.float32)
            part = e[idx] * val[:, None]
            for d in range(DIM):
                v[:, d] = np.bincount(doc, weights=part[:, d], minlength=len(batch))
            logits = v @ w + b
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), y[batch].astype(int)] -= 1
            g = (p * np.where(y[batch] > 0.5, toxic_weight, 1.0)[:, None]).astype(np.float32)
            grad_w, grad_b, grad_v = v.T @ g / len(batch), g.mean(axis=0), g @ w.T
            np.add.at(e, idx, -rate * grad_v[doc] * val[:, None])
            w -= rate * grad_w
            b -= rate * grad_b
    return ToxicityModel((e @ (w[:, 1] - w[:, 0]) * np.float32(GAIN)).astype(np.float32), float(b[1] - b[0]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, remainder: int = 2,
                 sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, text_bytes: int = TEXT_BYTES) -> ToxicityModel:
    """Fit on at most ``sample_rows`` ids, the first of either label by a hash, and of
    them as many as hold ``sample_bytes / 2`` per label; one of them at least. A text
    of more than ``text_bytes / 4`` code points gives passages from all over it. Where an
    id has several texts, the first by their hash stands for it."""
    known = labelled_ids(labels, label, held_out(F.col("doc_id"), modulus, remainder))
    toxic = F.col("y") >= 0.5
    share = known.agg(F.avg(toxic.cast("double"))).first()[0] or 0.0
    first = lambda part, n: part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)     # noqa: E731
    ids = first(known.filter(toxic), sample_rows // 3).union(first(known.filter(~toxic), sample_rows - sample_rows // 3))
    drawn = passages(F.col("text"), F.col("doc_id"), text_bytes // 4, PASSAGE)
    sample = materialize(docs.join(F.broadcast(ids), "doc_id")                        # at most sample_rows ids
                         .groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("o"), drawn.alias("t"))).alias("m"))
                         .select("doc_id", "y", F.col("m.t").alias("text")))
    order = Window.partitionBy(toxic).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sample.select("doc_id", "y", F.octet_length("text").alias("n"))           # at most sample_rows rows
    taken = (sizes.withColumn("sum", F.sum("n").over(order)).filter((F.col("sum") <= sample_bytes // 2) | (F.col("sum") == F.col("n")))
             .select("doc_id"))
    rows = sample.join(F.broadcast(taken), "doc_id").select("doc_id", "y", "text").collect()   # at most sample_bytes of text
    free(sample)
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["y"] >= 0.5 for r in rows], dtype=float)
    # the sample holds more of label 1 than the table; its weight undoes that
    return train([r["text"] for r in rows], y, TOXIC_WEIGHT * share / y.mean() if y.any() else TOXIC_WEIGHT)


def _score_pass(model):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(model.value.scores(raw, offsets)), *batch.columns[2:]],
                                  names=["doc_id", "score", *batch.schema.names[2:]])
    return run


def toxicity_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES,
                    text_bytes: int = TEXT_BYTES, hashed: bool = False) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, and with
    ``hashed`` text_hash, which tells the texts of one id apart.

    A text of any length is read whole and has the score of its most toxic
    window. A null or empty text, or one without words, gets the score of the
    bias alone (the prior); a score equal to the threshold is predicted 1. Without usable labels, or with labels of one class, the
    score is that class's clipped share. Repeated rows are scored one by one;
    an empty table gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    prepare(spark)
    docs = keyed_text(df, id_col, text_col)
    model = spark.sparkContext.broadcast(fit_toxicity(
        docs, labels, sample_rows=sample_rows, sample_bytes=sample_bytes, text_bytes=text_bytes))
    keys = ["text_hash"] if hashed else []
    if hashed:
        docs = docs.withColumn("text_hash", text_hash(F.col("text")))
    return (docs.mapInArrow(_score_pass(model), ", ".join(["doc_id long, score double", *[f"{k} long" for k in keys]]))
            .select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted"), *keys))
