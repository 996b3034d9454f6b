"""Document fingerprints by consistent weighted sampling.

A document is its 5-word shingles weighted by their counts. For every sample
each term draws r and c from Gamma(2, 1) and b from U(0, 1); with weight w,
``t = floor(ln w / r + b)`` and ``ln a = ln c - r (t - b + 1)``, and the term of
the smallest a, with its t, is the sample. Two documents agree in a sample
with a probability equal to their generalised Jaccard similarity (the sum of
the smaller weights over the sum of the larger), so the share of equal samples
estimates it.

The draws of a (term, sample) are one of 65 536 fixed triples, chosen by 16
bits of a hash of the two; four samples share one 64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_text, prepare, shuffle_partitions
from .shingles import batch_shingles, mix64

SHINGLE = 5
SAMPLES = 128
#: terms of one block of the sampling matrix, which bounds its memory
BLOCK = 1 << 14

_rng = np.random.Generator(np.random.PCG64(2718))
_R = _rng.standard_gamma(2.0, 1 << 16)
_LN_C = np.log(_rng.standard_gamma(2.0, 1 << 16))
_B = _rng.random(1 << 16)
#: ln a at weight 1, where t is 0
_LN_A = (_LN_C - _R * (1 - _B)).astype(np.float32)


def _block(terms: np.ndarray, counts: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray | None]:
    """(ln a, t) as (samples, terms); t is None where every weight is 1."""
    # terms are well mixed already: an odd multiplier per four samples and one fold mix them anew
    odd = mix64(np.arange(1, samples // 4 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    word = odd[:, None] * terms[None, :]
    word ^= word >> np.uint64(32)
    draw = word.view(np.uint16).reshape(samples // 4, len(terms), 4).transpose(0, 2, 1)
    a = _LN_A.take(draw).reshape(samples, len(terms))
    heavy = np.flatnonzero(counts > 1)
    if not len(heavy):
        return a, None
    d = draw[:, :, heavy].reshape(samples, len(heavy))
    t_heavy = np.floor(np.log(counts[heavy])[None, :] / _R[d] + _B[d])
    a[:, heavy] = _LN_C[d] - _R[d] * (t_heavy - _B[d] + 1)
    t = np.zeros(a.shape, dtype=np.uint64)
    t[:, heavy] = t_heavy.astype(np.uint64)
    return a, t


def signature(hashes: np.ndarray, samples: int = SAMPLES) -> np.ndarray | None:
    """Samples of a document from its shingle hashes with repeats; None without any."""
    terms, counts = np.unique(hashes, return_counts=True)
    if not len(terms):
        return None
    best = np.full(samples, np.inf, dtype=np.float32)
    value = np.zeros(samples, dtype=np.uint64)
    row = np.arange(samples)
    for at in range(0, len(terms), BLOCK):
        part = terms[at:at + BLOCK]
        a, t = _block(part, counts[at:at + BLOCK], samples)
        low = a.argmin(axis=1)               # the smallest term hash among equals: terms are sorted
        won = a[row, low]
        name = part[low] if t is None else part[low] + t[row, low] * np.uint64(0xD6E8FEB86659FD93)
        better = won < best
        best[better], value[better] = won[better], name[better]
    # 15 bits and a one: no sample of a text looks like those of an empty one
    return (mix64(value) >> np.uint64(48)).astype(np.uint16) | np.uint16(1)


def as_text(sig: np.ndarray | None, samples: int = SAMPLES) -> str:
    return "0" * (4 * samples) if sig is None else sig.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Share of equal samples; two empty documents are alike, an empty and another are not."""
    if a is None or b is None:
        return 1.0 if a is b else 0.0
    return float((a == b).mean())


def signatures(texts: list[str], samples: int = SAMPLES) -> list[np.ndarray | None]:
    out: list[np.ndarray | None] = [None] * len(texts)
    for r, h in batch_shingles(pa.array(texts, pa.large_string()), SHINGLE):
        out[r] = signature(h, samples)
    return out


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          samples: int = SAMPLES) -> DataFrame:
    """One row per input row: doc_id, fingerprint (4 hex digits per sample).

    A null or empty text, or one without words, has all zeros; fewer words
    than a shingle make one term. Equal texts have equal fingerprints.
    """
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([as_text(s, samples) for s in signatures(texts, samples)])],
                                  names=["doc_id", "fingerprint"])
    return keyed_text(df, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the start of the next one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_ROUTED = "bucket int, extra boolean, doc_id long, tie long, text string"
_OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def _bucket_of(ids: pa.Array, splitters: np.ndarray) -> np.ndarray:
    """Range of an id; null ids come after all others in descending order."""
    known = np.array(ids.is_valid())
    bucket = np.searchsorted(splitters, np.array(ids.fill_null(0)), side="left") + 1
    return np.where(known, bucket, 0).astype(np.int32)


def _route_pass(splitters: np.ndarray, first: dict[int, tuple], before: dict[int, int]):
    """Every document to its range of ids, and the first of a range also behind the range before."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            buckets = _bucket_of(batch.column(0), splitters)
            yield pa.record_batch([pa.array(buckets), pa.array(np.zeros(len(buckets), bool)), *batch.columns],
                                  names=["bucket", "extra", "doc_id", "tie", "text"])
            ids, ties = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            heads = [i for i, b in enumerate(buckets.tolist()) if first[b] == (ids[i], ties[i])]
            if heads:
                part = batch.take(pa.array(heads))
                yield pa.record_batch([pa.array([before[int(buckets[i])] for i in heads], pa.int32()),
                                       pa.array([True] * len(heads)), *part.columns],
                                      names=["bucket", "extra", "doc_id", "tie", "text"])
    return run


def _edit_pass(samples: int):
    """Sorted ranges -> rows; a document is finished when its successor has come."""
    def run(batches: Iterator[pa.RecordBatch]):
        last = None                          # (bucket, extra, doc_id, text, signature)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(4).to_pylist()]
                rows = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(),
                                texts, signatures(texts, samples)))
                done = []
                for row in rows:
                    if last is not None and not last[1] and last[0] == row[0]:
                        done.append((last, row))
                    if last is None or not (last[1] and row[1] and last[0] == row[0]):
                        last = row
                changed = [edited(a[3], b[3]) for a, b in done]
                sigs = signatures(changed, samples)
                cols = list(zip(*[(a[2], len(a[3]), hashlib.sha256(e.encode("utf-8")).hexdigest(), as_text(a[4], samples),
                                   as_text(s, samples), likeness(a[4], s), likeness(a[4], b[4]))
                                  for (a, b), e, s in zip(done, changed, sigs)])) or [()] * 7
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (
                    pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
    return run


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every document and of its edited text.

    The edited text takes its second half from the next document in descending
    doc_id order (the first one after the last). Texts move once: documents
    are dealt out by ranges of ids, sorted, and streamed past their successor;
    the first document of a range is also sent behind the range before it.
    Rows that repeat an id are ordered by a hash of the text (the greater
    first), null ids come last; an empty table gives an empty result; other
    columns are ignored.
    """
    spark = df.sparkSession
    prepare(spark)
    docs = keyed_text(df, id_col, text_col).select("doc_id", F.xxhash64("text").alias("tie"), "text")
    parts = shuffle_partitions(spark)
    ranges = 4 * parts                       # several per partition even out the hashing of ranges
    cuts = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0]
    splitters = np.unique(np.array(cuts or [], dtype=np.int64))

    def bucket_pass(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield pa.record_batch([pa.array(_bucket_of(batch.column(0), splitters)), *batch.columns],
                                  names=["bucket", "doc_id", "tie"])
    heads = (docs.select("doc_id", "tie").mapInArrow(bucket_pass, "bucket int, doc_id long, tie long")
             .groupBy("bucket").agg(F.max(F.struct("doc_id", "tie")).alias("m"))
             .collect())                     # one row per range: a number fixed by the partitions
    first = {r["bucket"]: (r["m"]["doc_id"], r["m"]["tie"]) for r in heads}
    order = sorted(first, reverse=True)      # descending ids
    before = {b: order[i - 1] for i, b in enumerate(order)}
    routed = docs.mapInArrow(_route_pass(splitters, first, before), _ROUTED)
    return (routed.repartition(parts, "bucket")
            .sortWithinPartitions("bucket", "extra", F.desc_nulls_last("doc_id"), F.desc("tie"))
            .mapInArrow(_edit_pass(samples), _OUT))
