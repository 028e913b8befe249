"""Operator 2: token counts by a map-side two-tier lookup.

A first pass counts chunks (a space with its word) inside each task and keeps each task's
most frequent ones; their sums name the globally frequent chunks. The driver encodes those
once and broadcasts their lengths as one compact table of fixed size. The second pass looks
each chunk up there, then in the worker's own cache, and only then encodes it. Pre-tokens
are never shuffled: what moves is at most ``per_task`` rows a task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_or_empty
from .pretokens import CACHED_CHARS, chunks, read_bytes

#: Worker-wide second tier, by tokenizer: chunk -> tokens.
_CACHES: dict[str, dict[str, int]] = {}
_TOKENIZERS: dict[str, object] = {}
#: A worker's cache is emptied at this size, which bounds its memory to some 60 MB.
CACHE_ENTRIES = 400_000


def _tokenizer(key: str, blob: bytes):
    if key not in _TOKENIZERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(blob.decode())
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _TOKENIZERS[key] = tokenizer
    return _TOKENIZERS[key]


def _lengths(tokenizer, texts: list[str]) -> list[int]:
    return [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def special_strings(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


class LengthTable:
    """Lengths of frequent chunks: their bytes end to end, with 16-bit sizes and lengths."""

    def __init__(self, lengths: dict[str, int]):
        keys = [k.encode() for k in lengths]
        self.blob = b"".join(keys)
        self.sizes = np.array([len(k) for k in keys], np.uint16)
        self.tokens = np.array(list(lengths.values()), np.uint16)

    def unpack(self) -> dict[str, int]:
        ends = np.cumsum(self.sizes, dtype=np.int64).tolist()
        starts = [0, *ends][: len(ends)]
        return {self.blob[a:b].decode(): n for a, b, n in zip(starts, ends, self.tokens.tolist(), strict=True)}


def frequent_chunks(docs: DataFrame, text_col: str, size: int, per_task: int, specials: list[str]) -> list[str]:
    """The ``size`` most frequent chunks over all texts, from each task's ``per_task`` most frequent."""

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(chunks(text))
            if len(counts) > 20 * per_task:  # lossy counting: the rare ones go
                counts = Counter(dict(counts.most_common(4 * per_task)))
        kept = [(k, n) for k, n in counts.most_common(per_task) if len(k) <= CACHED_CHARS and not any(s in k for s in specials)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["chunk", "n"])

    counted = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(top, "chunk string, n long")
    ranked = counted.groupBy("chunk").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "chunk").limit(size)
    return [row.chunk for row in ranked.collect()]


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = 1024, table_size: int = 1 << 15, per_task: int = 1 << 13) -> DataFrame:
    """Tokens of each text: (id, n_bytes, n_tokens, over_limit).

    vocabulary: path of a byte-level BPE file of the tokenizers library. A null text counts
    as empty and has no token; the id may be null or repeat; an empty table gives none. A
    text of any length is counted whole, chunk by chunk. The table's size changes the speed
    alone, never a count.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    blob = read_bytes(spark, path)
    tokenizer = _tokenizer(path, blob)
    specials = special_strings(tokenizer)
    names = frequent_chunks(docs, text_col, table_size, per_task, specials)
    table = spark.sparkContext.broadcast(LengthTable(dict(zip(names, _lengths(tokenizer, names), strict=True))))
    model = spark.sparkContext.broadcast(blob)
    key = f"{path}:{len(blob)}"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(key, model.value)
        first = table.value.unpack()
        second = _CACHES.setdefault(key, {})
        known = first | second  # one look finds a chunk in either tier
        for batch in batches:
            cut = [_parts(text, specials) for text in batch.column(1).to_pylist()]
            lists = [[c for part in parts for c in chunks(part)] if len(parts) > 1 else chunks(parts[0]) for parts, _ in cut]
            misses = list(set().union(*lists).difference(known))
            if len(second) + len(misses) > CACHE_ENTRIES:
                second.clear()
                known = dict(first)
                misses = list(set().union(*lists).difference(known))
            for at in range(0, len(misses), 4096):
                some = misses[at : at + 4096]
                known.update(zip(some, _lengths(own, some), strict=True))
            length = known.__getitem__
            tokens = [n + sum(map(length, found)) for found, (_, n) in zip(lists, cut, strict=True)]
            for c in misses:
                if len(c) > CACHED_CHARS:
                    del known[c]
                else:
                    second[c] = known[c]
            sizes = pc.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return read.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def _parts(text: str, specials: list[str]) -> tuple[list[str], int]:
    """The text between special strings, and how many of these it has (one token each)."""
    parts = [text]
    for special in specials:
        if special in text:
            parts = [x for part in parts for x in part.split(special)]
    return parts, len(parts) - 1
