"""Encoding a whole corpus with a public byte-level BPE vocabulary.

The words of all documents are counted in the JVM; the most frequent ones are merged once, on the driver, and compiled into a
transducer that executors memory-map (see :mod:`pointlake.llm.lexicon`). Words that are not in it are merged exactly where
they occur, so the lexicon decides speed and never the result.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm import lexicon
from pointlake.plans import scratch

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are cut into words before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Most words in the lexicon, and their most bytes; both bound what the driver holds.
LEXICON_WORDS, WORD_BYTES = 50_000, 64
#: Characters of text that are handled at a time, and words whose ids a process remembers.
SLICE_CHARS, REMEMBERED = 2_000_000, 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id of a vocabulary file with lines of base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by exact byte-pair merging: always the lowest rank, of equal ranks the leftmost pair.

    Pieces form a linked list and candidate pairs a heap, so a word of n bytes takes O(n log n).
    """
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    piece: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap: list[tuple[int, int, bytes]] = []

    def offer(at: int) -> None:
        nxt = after[at]
        if nxt < len(piece):
            pair = piece[at] + piece[nxt]
            rank = ranks.get(pair)
            if rank is not None:
                heapq.heappush(heap, (rank, at, pair))

    for i in range(len(word) - 1):
        offer(i)
    while heap:
        _, at, pair = heapq.heappop(heap)
        nxt = after[at]
        if piece[at] is None or nxt >= len(piece) or piece[at] + piece[nxt] != pair:
            continue
        piece[at], piece[nxt] = pair, None
        after[at] = after[nxt]
        if after[at] < len(piece):
            before[after[at]] = at
        offer(at)
        if before[at] >= 0:
            offer(before[at])
    return [ranks[p] for p in piece if p is not None]


def frequent_words(texts: DataFrame, column: str, most: int = LEXICON_WORDS) -> DataFrame:
    """``(word, n)`` of the words that occur at least twice in all texts, the most frequent ``most`` of them.

    Counted in the JVM with partial aggregation. Its Unicode tables may differ from Python's; that changes at most which
    words are in the lexicon.
    """
    word = F.explode(F.regexp_extract_all(F.col(column), F.lit("(?U)(" + PATTERN + ")"), F.lit(1))).alias("word")
    counted = texts.select(word).where(F.octet_length("word") <= WORD_BYTES).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where("n > 1").orderBy(F.desc("n"), "word").limit(most)


def compile_lexicon(spark: SparkSession, words: list[str], vocabulary: str) -> str:
    """A packed lexicon of the words and the vocabulary itself, as a Spark file: its name.

    It is written to the shared folder by the file system that the folder's address names; Spark hands every executor a copy,
    which its Python processes map.
    """
    ranks = read_ranks(vocabulary)
    arrays = lexicon.build({w: merge(w, ranks) for w in (w.encode() for w in words)})
    tokens = sorted(ranks, key=ranks.__getitem__)
    arrays["token_bytes"] = np.frombuffer(b"".join(tokens), dtype=np.uint8)
    arrays["token_end"] = np.cumsum([len(t) for t in tokens], dtype=np.int64)
    arrays["token_id"] = np.array([ranks[t] for t in tokens], dtype=np.int32)
    path = scratch.new_path(spark, "lexicon")
    scratch.write_bytes(spark, path, lexicon.pack(arrays))
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


class Encoder:
    """Encodes texts by a mapped lexicon, one per Python process and lexicon."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        self.lexicon = lexicon.mapped(path)
        self.ranks: dict[bytes, int] | None = None
        self.cut = regex.compile(PATTERN)
        self.known: dict[str, np.ndarray] = {}

    @classmethod
    def of(cls, name: str) -> Encoder:
        if name not in cls._made:
            cls._made[name] = cls(SparkFiles.get(name))
        return cls._made[name]

    def _merged(self, word: bytes) -> list[int]:
        if self.ranks is None:
            text, end = self.lexicon["token_bytes"].tobytes(), self.lexicon["token_end"].tolist()
            self.ranks = {text[a:b]: i for a, b, i in zip([0, *end], end, self.lexicon["token_id"].tolist())}
        return merge(word, self.ranks)

    def _learn(self, words: list[str]) -> None:
        coded = [w.encode() for w in words]
        place = lexicon.find(self.lexicon, coded)
        start, ids = self.lexicon["start"], self.lexicon["ids"]
        for w, c, p in zip(words, coded, place.tolist()):
            self.known[w] = np.array(ids[start[p] : start[p + 1]]) if p >= 0 else np.array(self._merged(c), dtype=np.int32)

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text; of an empty and of a null text the empty list."""
        cut = [self.cut.findall(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self._learn([w for w in dict.fromkeys(chain.from_iterable(cut)) if w not in self.known])
        known = self.known
        parts = [known[w] for w in chain.from_iterable(cut)]
        values = np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)
        ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))
        words = np.cumsum([0, *map(len, cut)])
        offsets = np.concatenate([[0], ends])[words]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of a bounded number of characters; a longer text has a range of its own."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > SLICE_CHARS:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def token_ids(documents: DataFrame, vocabulary: str = VOCABULARY, key: str = "doc_id", text: str = "text", most: int = LEXICON_WORDS) -> DataFrame:
    """``(key, ids ARRAY<INT>)``: every text as token ids, all of it as ordinary text, without special tokens.

    An empty and a null text both give the empty list. Rows delivered twice (equal key) count once. A text is processed
    whole, however long; an empty table gives an empty one. Other columns are not read. ``vocabulary`` is a file of base64
    tokens and ranks on the driver. The words are counted and the lexicon compiled when this is called.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(key), F.col(text).cast("string").alias("text"))
    words = [r.word for r in frequent_words(rows, "text", most).collect()]
    name = compile_lexicon(spark, words, vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(name)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), encoder.encode(texts[a:b])], names=[key, "ids"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.dropDuplicates([key]).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")
