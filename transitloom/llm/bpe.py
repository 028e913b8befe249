"""Operator 4: byte-level BPE encoding and decoding over a contiguous rank array.

A word's bytes are its first parts. Two parallel arrays hold the parts and, for each
boundary, the rank of joining its two sides; the smallest rank is found by a scan, its
boundary deleted and the two neighbouring ranks refreshed. Words of this kind are short,
so a scan over a contiguous array beats a heap; longer words than ``LONG_WORD`` take a heap
with linked neighbours, whose merges are the same.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, text_or_empty
from .pretokens import CACHED_CHARS, WHITE, chunks, read_bytes

LONG_WORD = 256
#: A worker's cache is emptied at this size, which bounds its memory to some 80 MB.
CACHE_ENTRIES = 400_000
NO_RANK = 1 << 60
#: Bits of an id where two of them are one key.
ID_BITS = 24
#: Bytes of texts whose results leave a worker in one batch.
SLICE_BYTES = 1 << 20
#: Ids that are decoded at once; bounds a very long text's memory.
DECODED_IDS = 1 << 18
#: The pre-token pattern of the vocabulary.
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

_CODERS: dict[str, BytePairCoder] = {}


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary file.

    Bytes that print in Latin-1 stand for themselves; the others take the code points from
    256 on, in order.
    """
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@dataclass
class Vocabulary:
    """What a worker needs of a vocabulary file, as arrays: the driver parses the file once."""

    tokens: bytes  # all tokens' bytes, by id, end to end
    ends: np.ndarray
    pairs: np.ndarray  # left id << ID_BITS | right id, by rank
    joined: np.ndarray  # the id that a pair becomes, by rank
    specials: dict[str, int]

    @classmethod
    def of(cls, blob: bytes) -> Vocabulary:
        spec = json.loads(blob)
        ids, alphabet = spec["model"]["vocab"], printable_bytes()
        specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        raw = {number: bytes(alphabet[c] for c in token) for token, number in ids.items()} | {number: text.encode() for text, number in specials.items()}
        ordered = [raw.get(number, b"") for number in range(max(raw) + 1)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        pairs = np.array([ids[a] << ID_BITS | ids[b] for a, b in merges], np.int64)
        return cls(b"".join(ordered), np.cumsum([len(t) for t in ordered]), pairs, np.array([ids[a + b] for a, b in merges], np.int64), specials)


class BytePairCoder:
    """Merge ranks, ids and bytes of one vocabulary, with caches of words and chunks."""

    def __init__(self, vocabulary: Vocabulary, entries: int = CACHE_ENTRIES):
        self.entries = entries
        ends = vocabulary.ends.tolist()
        raw = [vocabulary.tokens[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        self.bytes_of = np.array(raw, object)
        self.byte_ids = [0] * 256
        for number, token in enumerate(raw):
            if len(token) == 1:
                self.byte_ids[token[0]] = number
        self.joined: list[int] = vocabulary.joined.tolist()
        self.rank_of: dict[int, int] = dict(zip(vocabulary.pairs.tolist(), range(len(self.joined)), strict=True))
        self.specials = vocabulary.specials
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one pre-token."""
        parts = [self.byte_ids[b] for b in word]
        if len(parts) > LONG_WORD:
            return self._merge_long(parts)
        rank_of, joined = self.rank_of, self.joined
        ranks = [rank_of.get(a << ID_BITS | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NO_RANK:
                break
            at = ranks.index(least)
            parts[at] = joined[least]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank_of.get(parts[at - 1] << ID_BITS | parts[at], NO_RANK)
            if at < len(ranks):
                ranks[at] = rank_of.get(parts[at] << ID_BITS | parts[at + 1], NO_RANK)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges, leftmost first among equal ranks, in n log n."""
        end = len(parts)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap = [(r, k, parts[k], parts[k + 1]) for k in range(end - 1) if (r := self.rank_of.get(parts[k] << ID_BITS | parts[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, at, left, right = heapq.heappop(heap)
            to = after[at]
            if parts[at] != left or to >= end or parts[to] != right:
                continue  # one side has been merged since
            parts[at], parts[to] = self.joined[rank], -1
            after[at] = after[to]
            if after[at] < end:
                before[after[at]] = at
            for k in (before[at], at):
                if k >= 0 and after[k] < end and (r := self.rank_of.get(parts[k] << ID_BITS | parts[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, parts[k], parts[after[k]]))
        return [p for p in parts if p >= 0]

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk as little-endian unsigned 32-bit integers, through the caches."""
        found = []
        for word in WORD.findall(chunk):
            ids = self.words.get(word)
            if ids is None:
                ids = b"".join(n.to_bytes(4, "little") for n in self.merge(word.encode()))
                if len(word) <= CACHED_CHARS:
                    if len(self.words) >= self.entries:
                        self.words.clear()
                    self.words[word] = ids
            found.append(ids)
        packed = b"".join(found)
        if len(chunk) <= CACHED_CHARS:
            if len(self.chunks) >= self.entries:
                self.chunks.clear()
            self.chunks[chunk] = packed
        return packed

    def encode_packed(self, text: str) -> bytes:
        """Ids of a whole text, packed; special strings become their own ids."""
        for special, number in self.specials.items():
            if special in text:
                return number.to_bytes(4, "little").join(self.encode_packed(part) for part in text.split(special))
        get, missing = self.chunks.get, self._chunk
        return b"".join([get(c) or missing(c) for c in chunks(text)])

    def encode(self, text: str) -> list[int]:
        return memoryview(self.encode_packed(text)).cast("I").tolist()

    def decode_packed(self, packed: bytes) -> bytes:
        """The UTF-8 text of packed ids; bytes that are not UTF-8 become U+FFFD."""
        ids = np.frombuffer(packed, "<u4")
        parts = [b"".join(self.bytes_of[ids[at : at + DECODED_IDS]].tolist()) for at in range(0, len(ids), DECODED_IDS)]
        return b"".join(parts).decode("utf-8", "replace").encode()

    def decode(self, ids: list[int]) -> str:
        return self.decode_packed(np.array(ids, "<u4").tobytes()).decode()


def coder(key: str, vocabulary: Vocabulary, entries: int = CACHE_ENTRIES) -> BytePairCoder:
    """The worker's one coder of a vocabulary."""
    if key not in _CODERS:
        _CODERS[key] = BytePairCoder(vocabulary)
    _CODERS[key].entries = entries
    return _CODERS[key]


def _lists(packs: list[bytes]) -> pa.Array:
    """Packed ids as a column of lists, without a number of Python for any of them."""
    offsets = np.cumsum([0, *(len(p) // 4 for p in packs)], dtype=np.int32)
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packs))])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def encode_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, decode: bool = True, keep_ids: bool = True, keep_decoded: bool = True, cache_entries: int = CACHE_ENTRIES) -> DataFrame:
    """Token ids of each text and the text decoded from them.

    Returns (id, n_tokens, ids_sha256, decoded_sha256), with ``keep_ids`` also token_ids
    (array<int>) and with ``keep_decoded`` decoded (string); without ``decode`` the last two
    are null. Null and empty texts have no tokens; any id may repeat or be null; an empty
    table gives none. There is no shuffle: every task encodes the texts that it reads and
    hands on its results about SLICE_BYTES of text at a time, with ids packed all the way.
    cache_entries bounds the words and the chunks that a worker remembers.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    blob = read_bytes(spark, path)
    model, key = spark.sparkContext.broadcast(Vocabulary.of(blob)), hashlib.sha256(blob).hexdigest()
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256", *["token_ids"] * keep_ids, *["decoded"] * keep_decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(key, model.value, cache_entries)

        def rows(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
            counts, digests, back, packs, decoded = [], [], [], [], []
            for text in texts.to_pylist():
                packed = own.encode_packed(text)
                again = own.decode_packed(packed) if decode else None
                counts.append(len(packed) // 4)
                digests.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(again).hexdigest() if decode else None)
                if keep_ids:
                    packs.append(packed)
                if keep_decoded:
                    decoded.append(again)
            columns = [ids, pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
            columns += [_lists(packs)] * keep_ids + [pa.array(decoded, pa.string())] * keep_decoded
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                most = SLICE_BYTES + (sizes[start - 1] if start else 0)
                end = max(start + 1, int(np.searchsorted(sizes, most, "right")))
                yield rows(batch.column(0).slice(start, end - start), batch.column(1).slice(start, end - start))
                start = end
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    out = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * keep_ids + ", decoded string" * keep_decoded
    read = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return read.mapInArrow(run, out).withColumnRenamed("id", id_col)
