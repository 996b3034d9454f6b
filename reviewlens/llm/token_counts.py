"""Token counts of whole texts without materialising ids.

A token count is a sum over pre-tokens: every distinct pre-token has a fixed
number of pieces, whichever text it stands in. One pass splits the texts and
counts the pre-tokens of every document; the pieces of each distinct pre-token
are counted once; a join brings the two together and a sum per document ends
it. No list of ids is ever built for a text.

Words of natural text are skewed, so the join has two parts. The ``HEAD_WORDS``
most frequent pre-tokens of a sample of documents form a table of bounded size
that is broadcast; the pass over the documents adds up their pieces on the
spot. All other pre-tokens leave the pass as (document, pre-token, frequency)
and are joined by a shuffle, in which no key is hot. Which pre-tokens are in
the head changes where a sum is made, never the sum.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import word_bpe
from .common import free, keyed_text, large_string, materialize, prepare, shuffle_partitions

#: most entries of the broadcast table (some 2 MB)
HEAD_WORDS = 200_000
#: documents from which the head is chosen
SAMPLE_ROWS = 20_000
#: texts above this many documents are over the limit
TOKEN_LIMIT = 2048
#: pre-tokens counted in memory before a task hands on its counts
FLUSH_WORDS = 200_000

_models: dict[str, tuple] = {}


def _model(path: str):
    """The library's merge model of a vocabulary file, one per worker process."""
    if path not in _models:
        from tokenizers import Tokenizer
        _models[path] = (Tokenizer.from_file(path), word_bpe(path))
    return _models[path]


def count_pieces(word: str, path: str) -> int:
    """Number of ids of one normalised pre-token."""
    library, split = _model(path)
    return len(library.model.tokenize("".join([split.byte_chars[b] for b in word.encode("utf-8")])))


def pre_tokens(text: str, path: str) -> tuple[Counter, int]:
    """Pre-tokens of a text with their frequencies, and the number of special
    tokens in it (one id each, as the library has them inside a text)."""
    split = word_bpe(path)
    if "<|" not in text:
        return Counter(split.words(text)), 0
    found, special = Counter(), 0
    for part in split.special_split.split(text):
        if part in split.special:
            special += 1
        else:
            found.update(split.words(part))
    return found, special


def word_counts(texts: DataFrame, path: str) -> DataFrame:
    """(word, n): every pre-token of the column ``text`` and how often it occurs."""
    def run(batches: Iterator[pa.RecordBatch]):
        found: Counter = Counter()

        def out():
            return pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for text in large_string(batch, "text"):
                found.update(pre_tokens(text, path)[0])
                if len(found) >= FLUSH_WORDS:
                    yield out()
                    found.clear()
        yield out()
    return (texts.select("text").mapInArrow(run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def with_pieces(words: DataFrame, path: str) -> DataFrame:
    """The distinct pre-tokens of a column ``word`` with a column ``pieces``."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = batch.column(0).to_pylist()
            yield pa.record_batch([batch.column(0), pa.array([count_pieces(w, path) for w in found], pa.int64())],
                                  names=["word", "pieces"])
    return words.select("word").mapInArrow(run, "word string, pieces long")


def _head(docs: DataFrame, path: str, head_words: int, sample_rows: int) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens of a sample, at most ``head_words`` of them."""
    rows = docs.count()
    sample = docs if rows <= sample_rows else docs.sample(sample_rows / rows, seed=11)
    top = word_counts(sample, path).orderBy(F.desc("n"), "word").limit(head_words)
    return {r["word"]: r["pieces"] for r in with_pieces(top, path).toLocalIterator()}


def _split(docs: DataFrame, path: str, head: dict[str, int]) -> DataFrame:
    """One row per document: the ids of its head words, and its other words with
    their frequencies. ``row`` names the row within the written table."""
    table = docs.sparkSession.sparkContext.broadcast(head)
    schema = "row long, doc_id long, n_bytes long, known long, words array<string>, counts array<long>"

    def run(batches: Iterator[pa.RecordBatch]):
        row = TaskContext.get().partitionId() << 40
        pieces_of = table.value.get
        for batch in batches:
            rows, n_bytes, known, words, counts = [], [], [], [], []
            for text in large_string(batch, "text"):
                found, total = pre_tokens(text, path)
                rest = []
                for word, n in found.items():
                    pieces = pieces_of(word)
                    if pieces is None:
                        rest.append(word)
                    else:
                        total += n * pieces
                rows.append(row)
                row += 1
                n_bytes.append(len(text.encode("utf-8")))
                known.append(total)
                words.append(rest)
                counts.append([found[w] for w in rest])
            long = pa.int64()
            yield pa.record_batch([pa.array(rows, long), batch.column(0), pa.array(n_bytes, long), pa.array(known, long),
                                   pa.array(words, pa.list_(pa.string())), pa.array(counts, pa.list_(long))],
                                  names=["row", "doc_id", "n_bytes", "known", "words", "counts"])
    return docs.mapInArrow(run, schema)


def token_counts(df: DataFrame, path: str, limit: int = TOKEN_LIMIT, id_col: str = "doc_id", text_col: str = "text",
                 head_words: int = HEAD_WORDS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    A null or empty text has no bytes and no tokens. Repeated rows, rows of
    one id and rows with a null id are counted each by itself. A text of any
    length is counted whole, and so is a pre-token of any length. There is no
    order or rank, so ties do not arise, save among head words, where they
    change no result. An empty table gives an empty result; other columns,
    whatever their names, are ignored.
    """
    spark = df.sparkSession
    prepare(spark)
    docs = keyed_text(df, id_col, text_col)
    parts = materialize(_split(docs, path, _head(docs, path, head_words, sample_rows)))
    rest = parts.select("row", F.explode(F.arrays_zip("words", "counts")).alias("w")).select(
        "row", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    # dealt by word once: the distinct words and the join then need no other exchange
    rest = rest.repartition(shuffle_partitions(spark), "word")
    pieces = with_pieces(rest.select("word").distinct(), path)
    sums = materialize(rest.join(pieces, "word").groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("rest")))
    out = (parts.select("row", "doc_id", "n_bytes", "known").join(sums, "row", "left")
           .select("doc_id", "n_bytes", (F.col("known") + F.coalesce("rest", F.lit(0))).alias("n_tokens")))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


__all__ = ["HEAD_WORDS", "SAMPLE_ROWS", "TOKEN_LIMIT", "count_pieces", "pre_tokens", "token_counts", "with_pieces", "word_counts"]
