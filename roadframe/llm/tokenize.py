"""Encoding with a public byte-level tokenizer (problem 8).

Each pre-token is merged by a rank queue: one bucket per merge rank holds the
linked-list positions where that merge applies, a two-level bitmap over the ranks
gives the next rank by find-first-set, and entries whose pair has changed since
are skipped when met. A pre-token of n bytes costs O(n) queue steps whatever its
length, so megabyte runs without a blank are no special case.

The vocabulary file is read once on the driver, sent to the executors as a
broadcast of its bytes (about half a megabyte, whatever the corpus), and turned
into tables once per Python worker. Pre-tokens repeat by Zipf's law and lines by
revisions and copies, so each worker keeps bounded memos of the short ones. A text
is cut into lines between a visible character and a line feed, where no pre-token
can lie across, so a line's ids do not depend on its neighbours.

Defined cases: empty and null texts give an empty list; strings that look like
special tokens are ordinary text; whole texts are encoded, however long.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Default folder of the public vocabulary files; a parameter everywhere.
TOKENIZER_DIR = "/opt/tokenizers"
#: The published pattern that splits a text before the merges (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

MEMO_ENTRIES = 400_000
MEMO_LENGTH = 64
#: Longest line that is remembered, and characters of lines that a worker remembers in all.
LINE_LENGTH = 4_000
LINE_CHARACTERS = 16_000_000
_LINES = re.compile(r"(?<=\S)(?=\n)")


class RankQueue:
    """Buckets of positions per rank; two bitmap levels find the lowest filled rank."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.words: dict[int, int] = {}
        self.summary = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            high = rank >> 6
            self.words[high] = self.words.get(high, 0) | 1 << (rank & 63)
            self.summary |= 1 << high
        else:
            bucket.append(position)

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank with its positions from left to right."""
        if not self.summary:
            return None
        high = (self.summary & -self.summary).bit_length() - 1
        word = self.words[high]
        rank = high << 6 | (word & -word).bit_length() - 1
        word &= word - 1
        if word:
            self.words[high] = word
        else:
            del self.words[high]
            self.summary &= self.summary - 1
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket

    def lowest_below(self, rank: int) -> bool:
        if not self.summary:
            return False
        high = (self.summary & -self.summary).bit_length() - 1
        word = self.words[high]
        return (high << 6 | (word & -word).bit_length() - 1) < rank


class BytePairEncoder:
    def __init__(self, vocabulary: bytes) -> None:
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines() if b"\n" in vocabulary else [])}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.single = [self.ranks.get(bytes([b])) for b in range(256)]
        self.pairs: dict[int, int] = {}
        self.split = regex.compile(PATTERN)
        self.memo: dict[str, bytes] = {}
        self.lines: dict[str, bytes] = {}
        self.remembered = 0

    def _pair_rank(self, left: int, right: int) -> int:
        """Rank of the token that two neighbours merge to, or -1; remembered per pair."""
        key = left << 20 | right
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            found = self.pairs[key] = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
        return found

    def merge(self, piece: bytes) -> array:
        """Ids of one pre-token: always the merge of lowest rank, leftmost first."""
        n = len(piece)
        ids = [self.single[b] for b in piece]
        if n == 1:
            return array("i", ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue, rank_of = RankQueue(), self._pair_rank
        for i in range(n - 1):
            rank = rank_of(ids[i], ids[i + 1])
            if rank >= 0:
                queue.push(rank, i)
        while (lowest := queue.pop()) is not None:
            rank, positions = lowest
            for done, i in enumerate(positions):
                if ids[i] < 0:
                    continue  # stale: this place was merged into its left neighbour
                j = after[i]
                if j >= n or rank_of(ids[i], ids[j]) != rank:
                    continue  # stale: the pair has changed
                ids[i], ids[j] = rank, -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    right = rank_of(rank, ids[k])
                    if right >= 0:
                        queue.push(right, i)
                h = before[i]
                if h >= 0:
                    left = rank_of(ids[h], rank)
                    if left >= 0:
                        queue.push(left, h)
                if queue.lowest_below(rank + 1) and done + 1 < len(positions):
                    for p in positions[done + 1:]:  # a lower (or the same) rank has appeared: it goes first
                        queue.push(rank, p)
                    break
        return array("i", [t for t in ids if t >= 0])

    def _line(self, line: str) -> bytes:
        pieces, memo = self.split.findall(line), self.memo
        parts = list(map(memo.get, pieces))
        if None in parts:
            for i, piece in enumerate(pieces):
                if parts[i] is None:
                    found = memo.get(piece)
                    if found is None:
                        found = self.merge(piece.encode("utf-8", "surrogatepass")).tobytes()
                        if len(piece) <= MEMO_LENGTH:
                            if len(memo) >= MEMO_ENTRIES:
                                memo.clear()
                            memo[piece] = found
                    parts[i] = found
        out = b"".join(parts)
        if len(line) <= LINE_LENGTH:
            if self.remembered > LINE_CHARACTERS:
                self.lines.clear()
                self.remembered = 0
            self.lines[line] = out
            self.remembered += len(line)
        return out

    def encode_bytes(self, text: str) -> bytes:
        """Ids as 32-bit integers in a row."""
        lines = _LINES.split(text)
        parts = list(map(self.lines.get, lines))
        if None in parts:
            parts = [self._line(line) if part is None else part for part, line in zip(parts, lines)]
        return b"".join(parts)

    def encode(self, text: str) -> array:
        return array("i", self.encode_bytes(text))


_ENCODERS: dict[int, BytePairEncoder] = {}


def _encoder(vocabulary: bytes) -> BytePairEncoder:
    """The worker's encoder for this vocabulary; workers are reused between tasks."""
    key = hash(vocabulary)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = BytePairEncoder(vocabulary)
    return _ENCODERS[key]


def read_vocabulary(name: str = "byte_bpe_50k", directory: str = TOKENIZER_DIR) -> bytes:
    with open(f"{directory}/{name}.tiktoken", "rb") as file:
        return file.read()


def _encoded(spark: SparkSession, documents: DataFrame, key: str, text: str, counts_only: bool, directory: str) -> DataFrame:
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(directory=directory))
    kind = "n_tokens bigint" if counts_only else "ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary.value)
        for batch in batches:
            for start in range(0, max(batch.num_rows, 1), 256):
                part = batch.slice(start, 256)
                found, ends = [], [0]
                for words in part.column(1).to_pylist():
                    ids = encoder.encode_bytes(words) if words else b""
                    found.append(ids)
                    ends.append(ends[-1] + len(ids) // 4)
                if counts_only:
                    out: pa.Array = pa.array(np.diff(ends), pa.int64())
                else:
                    out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), out], names=[key, kind.split()[0]])

    return documents.select(F.col(key).cast("bigint").alias(key), F.col(text).alias("_text")).mapInArrow(run, f"{key} bigint, {kind}")


def encode_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", directory: str = TOKENIZER_DIR) -> DataFrame:
    """``(doc_id, ids)`` of every row."""
    return _encoded(documents.sparkSession, documents, key, text, False, directory)


def count_tokens(documents: DataFrame, key: str = "doc_id", text: str = "text", directory: str = TOKENIZER_DIR) -> DataFrame:
    """``(doc_id, n_tokens)`` of every row."""
    return _encoded(documents.sparkSession, documents, key, text, True, directory)
