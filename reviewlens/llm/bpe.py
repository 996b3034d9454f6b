"""BPE encoding and decoding of whole texts with a word-level merge cache.

A vocabulary in the tokenizers library's JSON format supplies the merge ranks.
Texts are normalised and split as its settings say (NFC, white space to one
blank, lower case; contractions, letters, single digits, other signs). Every
word is merged by a priority queue of merge ranks over a doubly linked list
of symbols: the queue holds candidate pairs, a popped pair whose symbols have
changed since is stale and skipped. Decoding concatenates vocabulary strings.

Words repeat, so a worker keeps the results of words in two halves of a fixed
size; when one is full the older half goes. Nothing depends on it but speed.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_text, large_string, prepare
from .vocab import byte_values

CACHE_WORDS = 500_000


class WordBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.unknown = model.get("unk_token")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: pair of ids as one number -> rank and id of the merged symbol as one number
        self.merges = {self.vocab[a] << 20 | self.vocab[b]: r << 20 | self.vocab[a + b] for r, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.byte_char = {b: c for c, b in byte_values().items()}
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.space = regex.compile(r"\s+")
        # code points on which every Unicode version agrees; other texts are normalised
        # and split by the library's own rules, so that new letters count as it counts them
        self.settled = regex.compile(r"[\x00-\u052f\u2000-\u206f\u20a0-\u20bf]*+\Z")
        self.path, self.library = path, None
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}
        self.byte_chars = [self.byte_char[b] for b in range(256)]

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply merges in rank order, the leftmost first among equal ranks.

        A queue entry is one number: rank, merged symbol, position.
        """
        n = len(symbols)
        merge_of = self.merges.get
        queue = []
        for i in range(n - 1):
            m = merge_of(symbols[i] << 20 | symbols[i + 1])
            if m is not None:
                queue.append(m << 32 | i)
        if not queue:
            return symbols
        heapq.heapify(queue)
        sym, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heapq.heappop(queue)
            i, m = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if sym[i] < 0 or j >= n or merge_of(sym[i] << 20 | sym[j]) != m:
                continue                     # stale: one of the two has been merged since
            sym[i] = new = m & 0xFFFFF
            sym[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                m = merge_of(new << 20 | sym[k])
                if m is not None:
                    heapq.heappush(queue, m << 32 | i)
            h = before[i]
            if h >= 0:
                m = merge_of(sym[h] << 20 | new)
                if m is not None:
                    heapq.heappush(queue, m << 32 | h)
        return [s for s in sym if s >= 0]

    def word_ids(self, word: str) -> list[int]:
        """Ids of a normalised word, from its bytes in the vocabulary's alphabet."""
        chars = [self.byte_chars[b] for b in word.encode("utf-8")]
        chars[-1] += self.end
        return self.merge([self.vocab[c] for c in chars])

    def words(self, text: str) -> list[str]:
        """The words of a text, normalised."""
        if text.isascii() or self.settled.match(text):
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
            return self.split.findall(self.space.sub(" ", text).lower())
        if self.library is None:
            from tokenizers import Tokenizer
            self.library = Tokenizer.from_file(self.path)
        text = self.library.normalizer.normalize_str(text)
        back = {c: b for b, c in self.byte_char.items()}
        return [bytes(back[c] for c in w).decode("utf-8") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, text: str) -> Iterator[tuple[int, str, str]]:
        """(number of ids, ids as text, decoded string) of every word and special token."""
        cache = self.cache
        parts = self.special_split.split(text) if "<|" in text else (text,)
        for part in parts:
            if part in self.special:
                yield 1, str(self.special[part]), part
                continue
            for word in self.words(part):
                got = cache.get(word)
                if got is None:
                    got = self.older.get(word)
                    if got is None:
                        ids = self.word_ids(word)
                        got = (len(ids), " ".join(map(str, ids)), self.decode_strings(ids))
                    if len(cache) >= CACHE_WORDS:   # words of the older half that come again move on
                        self.older = cache
                        self.cache = cache = {}
                    if len(word) <= 64:
                        cache[word] = got
                yield got

    def decode_strings(self, ids: list[int]) -> str:
        return " ".join(self.strings[i] for i in ids)

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, s, _ in self.pieces(text) for i in s.split()]

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings of the ids, joined as the library joins them
        when a vocabulary file names no decoder: by one blank."""
        return self.decode_strings(ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the decoded text)."""
        found = list(self.pieces(text))
        ids = " ".join([p[1] for p in found])
        decoded = " ".join([p[2] for p in found])
        return (sum([p[0] for p in found]), hashlib.sha256(ids.encode()).hexdigest(),
                hashlib.sha256(decoded.encode("utf-8")).hexdigest())


_loaded: dict[str, WordBPE] = {}


def word_bpe(path: str) -> WordBPE:
    """One encoder per worker process and vocabulary."""
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and ``ids``, the token ids of the whole text."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        bpe = word_bpe(path)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([bpe.encode(t) for t in large_string(batch, "text")],
                                                             pa.list_(pa.int32()))], names=["doc_id", "ids"])
    return keyed_text(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id and ``text``; null ids give an empty text."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        bpe = word_bpe(path)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([bpe.decode(i or []) for i in batch.column(1).to_pylist()],
                                                             pa.string())], names=["doc_id", "text"])
    return (df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").cast("array<int>").alias("ids"))
            .mapInArrow(run, "doc_id long, text string"))


def encoding_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null or empty text has no ids and the digests of the empty string.
    Repeated rows, null ids and very long texts are encoded like any other;
    an empty table gives an empty result; other columns are ignored.
    """
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        bpe = word_bpe(path)
        for batch in batches:
            rows = [bpe.digest(t) for t in large_string(batch, "text")]
            n, ids, decoded = zip(*rows) if rows else ((), (), ())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                                   pa.array(decoded, pa.string())],
                                  names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return (keyed_text(df, id_col, text_col)
            .mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))
