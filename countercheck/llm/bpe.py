"""Byte-level BPE: encoding and decoding with a published vocabulary.

A text is split into words; the merges of a word are found in a contiguous
array of part boundaries and the ranks of adjacent parts: look for the smallest
rank, delete the boundary between its parts, look up the ranks of the two new
neighbours, until no pair has a rank. Words of one length are handled side by
side as the rows of one array. That is quadratic in the length of a word, so
words of more than SHORT bytes use a heap over the same ranks instead.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from countercheck.functions.names import free_name
from countercheck.llm.support import put, small_batches

SHORT = 64
PIECE = 1 << 20  # characters that are split and looked up at a time
CACHED = 300_000  # words whose ids a task remembers
NONE = np.int64(2**40)

# White space as the published splitter takes it, and its pattern.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
# The same for texts of ASCII and accented Latin letters only, about twice as fast.
LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
BEYOND = re.compile(rf"[^\x00-\x7f{LETTER}]")
LATIN_WORDS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[0-9]+| ?[^\t-\r {LETTER}0-9]+"
    r"|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)
CUT = re.compile(rf"(?<=[^{SPACE}]) (?=[^{SPACE}])")


@dataclass(frozen=True)
class Vocabulary:
    tokens: list[bytes]  # by id
    pairs: np.ndarray  # left id * len(tokens) + right id, ascending
    ranks: np.ndarray  # of the pairs
    merged: np.ndarray  # id by rank
    special: dict[str, int] = field(default_factory=dict)

    @cached_property
    def byte_ids(self) -> np.ndarray:
        ids = {t: i for i, t in reversed(list(enumerate(self.tokens)))}
        return np.array([ids[bytes([b])] for b in range(256)], np.int64)

    @cached_property
    def rank_of(self) -> dict[int, int]:
        return dict(zip(self.pairs.tolist(), self.ranks.tolist(), strict=True))

    @cached_property
    def special_pattern(self) -> re.Pattern | None:
        names = sorted(self.special, key=lambda s: (-len(s), s))
        return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * len(self.tokens) + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NONE)


def load_vocabulary(path: str) -> Vocabulary:
    """Read a tokenizer file: byte-level BPE without normaliser, prefix or affixes."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = (
        model["type"] == "BPE"
        and split.get("type") == "ByteLevel"
        and split.get("use_regex", True)
        and not split.get("add_prefix_space")
        and not spec.get("normalizer")
        and not any(
            model.get(k)
            for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
        )
        and not any(
            t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")
        )
    )
    if not plain:
        raise ValueError(f"{path} is not plain byte-level BPE")
    # Bytes that print stand for themselves, the others for characters from 256 on.
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printed]
    byte_of = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    size = 1 + max([*model["vocab"].values(), *special.values()])
    tokens = [b""] * size
    for token, i in model["vocab"].items():
        tokens[i] = bytes(byte_of[c] for c in token)
    for token, i in special.items():
        tokens[i] = token.encode()
    rows = []
    for merge in model["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        ids = model["vocab"]
        rows.append((ids[left] * size + ids[right], ids[left + right]))
    pairs = np.array([p for p, _ in rows], np.int64)
    order = np.argsort(pairs, kind="stable")
    merged = np.array([m for _, m in rows], np.int64)
    return Vocabulary(tokens, pairs[order], order.astype(np.int64), merged, special)


def merge_words(words: list[bytes], vocabulary: Vocabulary) -> list[np.ndarray]:
    """The ids of each word."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
    by_length = defaultdict(list)
    for i, word in enumerate(words):
        by_length[len(word)].append(i)
    for length, rows in by_length.items():
        if length > SHORT:
            for i in rows:
                out[i] = _merge_long(words[i], vocabulary)
        elif length:
            text = np.frombuffer(b"".join([words[i] for i in rows]), np.uint8)
            parts = vocabulary.byte_ids[text].reshape(-1, length)
            for i, ids in zip(rows, _merge_short(parts, vocabulary), strict=True):
                out[i] = ids
    return out


def _merge_short(parts: np.ndarray, vocabulary: Vocabulary) -> list[np.ndarray]:
    out: list[np.ndarray] = [None] * len(parts)
    word = np.arange(len(parts))  # which word a row is
    ranks = vocabulary.look_up(parts[:, :-1], parts[:, 1:])
    while parts.shape[1] > 1 and len(word):
        at = ranks.argmin(axis=1)
        least = ranks[np.arange(len(word)), at]
        ended = least == NONE
        if ended.any():
            for i, ids in zip(word[ended].tolist(), parts[ended], strict=True):
                out[i] = ids
            go = ~ended
            word, parts, ranks, at, least = word[go], parts[go], ranks[go], at[go], least[go]
        row = np.arange(len(word))
        parts[row, at] = vocabulary.merged[least]
        width = parts.shape[1] - 1
        column = np.arange(width)
        parts = np.take_along_axis(parts, column + (column > at[:, None]), axis=1)
        column = column[: width - 1]
        ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), axis=1)
        r = row[at > 0]
        ranks[r, at[r] - 1] = vocabulary.look_up(parts[r, at[r] - 1], parts[r, at[r]])
        r = row[at < width - 1]
        ranks[r, at[r]] = vocabulary.look_up(parts[r, at[r]], parts[r, at[r] + 1])
    for i, ids in zip(word.tolist(), parts, strict=True):
        out[i] = ids
    return out


def _merge_long(word: bytes, vocabulary: Vocabulary) -> np.ndarray:
    n, rank_of, size = len(word), vocabulary.rank_of, len(vocabulary.tokens)
    part = vocabulary.byte_ids[np.frombuffer(word, np.uint8)].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    ranked = ((rank_of.get(part[i] * size + part[i + 1]), i) for i in range(n - 1))
    heap = [(rank, i) for rank, i in ranked if rank is not None]
    heapq.heapify(heap)
    merged = vocabulary.merged.tolist()
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if part[i] < 0 or j >= n or rank_of.get(part[i] * size + part[j]) != rank:
            continue
        part[i], part[j] = merged[rank], -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < n:
                new = rank_of.get(part[left] * size + part[right])
                if new is not None:
                    heapq.heappush(heap, (new, left))
    return np.array([p for p in part if p >= 0], np.int64)


def _pieces(text: str, vocabulary: Vocabulary) -> Iterator[list[str] | int]:
    """Words of the text, some at a time, and the ids of special tokens between them."""
    pattern = vocabulary.special_pattern
    if pattern is not None and any(s in text for s in vocabulary.special):
        spans = pattern.split(text)
    else:
        spans = [text]
    for k, span in enumerate(spans):
        if k % 2:
            yield vocabulary.special[span]
            continue
        start = 0
        while start < len(span):
            end = len(span)
            if end - start > PIECE and (cut := CUT.search(span, start + PIECE)):
                end = cut.start()
            piece = span[start:end]
            yield (WORDS if BEYOND.search(piece) else LATIN_WORDS).findall(piece)
            start = end


class Encoder:
    """Encodes texts one after the other; remembers the ids of CACHED words at most."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str] | int]] = []
        weight = 0
        for i, text in enumerate(texts):
            for piece in _pieces(text, self.vocabulary):
                waiting.append((i, piece))
                weight += 1 if isinstance(piece, int) else len(piece)
                if weight >= PIECE // 4:
                    self._flush(waiting, out)
                    waiting, weight = [], 0
        self._flush(waiting, out)
        return [np.frombuffer(b"".join(chunks), np.int32) for chunks in out]

    def _flush(self, waiting: list[tuple[int, list[str] | int]], out: list[list[bytes]]) -> None:
        words = set().union(*(p for _, p in waiting if not isinstance(p, int)))
        if len(self.known) > CACHED:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        ids = merge_words([w.encode() for w in new], self.vocabulary)
        self.known.update(zip(new, (x.astype(np.int32).tobytes() for x in ids), strict=True))
        get = self.known.__getitem__
        for i, piece in waiting:
            if isinstance(piece, int):
                out[i].append(np.int32(piece).tobytes())
            else:
                out[i].append(b"".join(map(get, piece)))


def decode_ids(ids: list[int], tokens: list[bytes]) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD, ids without a token an error."""
    if ids and min(ids) < 0:
        raise ValueError(f"no token has the id {min(ids)}")
    return b"".join(map(tokens.__getitem__, ids)).decode("utf-8", "replace")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays], dtype=np.int64)])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def _shared(df: DataFrame, path: str | None):
    """The vocabulary, read by the driver: one fixed file of a few MB."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    return df.sparkSession.sparkContext.broadcast(load_vocabulary(path))


def _encoding(df: DataFrame, text: Column, path: str | None, back: bool) -> Column:
    vocabulary = _shared(df, path)
    small_batches(df.sparkSession)

    @F.arrow_udf("struct<ids:array<int>,decoded:string>" if back else "struct<ids:array<int>>")
    def encode_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            ids = encoder.encode([x or "" for x in batch.to_pylist()])
            parts = [_lists(ids)]
            if back:
                tokens = vocabulary.value.tokens
                parts.append(pa.array([decode_ids(x.tolist(), tokens) for x in ids], pa.string()))
            yield pa.StructArray.from_arrays(parts, ["ids", "decoded"][: len(parts)])

    return encode_texts(text)


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """Add ``out``, the token ids of a text column, as array<int>.

    ``path`` names a byte-level tokenizer file of the driver (default: the
    public one of 50,257 tokens). Strings of special tokens are special tokens.
    A null text has no tokens, as an empty one. All other rows and columns
    stay, repeated ones too; a column already called ``out`` is replaced. Texts
    of any length are encoded whole.
    """
    return put(df, {out: _encoding(df, F.col(f"`{text}`"), path, False)["ids"]})


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Add ``out``, the text of an array of token ids; special tokens stay.

    A null array gives null, a null id in an array nothing, and an id that the
    vocabulary lacks ends the job. A column already called ``out`` is replaced.
    """
    vocabulary = _shared(df, path)

    @F.arrow_udf("string")
    def decode_texts(batch: pa.Array) -> pa.Array:
        tokens = vocabulary.value.tokens
        return pa.array(
            [
                None if x is None else decode_ids([i for i in x if i is not None], tokens)
                for x in batch.to_pylist()
            ],
            pa.string(),
        )

    return put(df, {out: decode_texts(F.col(f"`{ids}`").cast("array<int>"))})


def round_trip(
    df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", path: str | None = None
) -> DataFrame:
    """``encode`` and ``decode`` of its ids in one pass over the texts."""
    both = free_name(df.columns, "bpe round trip")
    out = put(df, {both: _encoding(df, F.col(f"`{text}`"), path, True)})
    out = put(out, {ids: F.col(f"`{both}`.ids"), decoded: F.col(f"`{both}`.decoded")})
    return out.drop(both)
