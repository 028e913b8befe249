"""Operator 9: exact duplicates through mergeable counting quotient filters.

Every task builds counting quotient filters of its rows' 64-bit fingerprints, one for each
slice that their top bits name. The next bits are a fingerprint's quotient, its home slot;
the rest, its remainder, is stored in the first free slot from there on, so that a
quotient's remainders are one sorted run. Two bits for each slot say whether a quotient
occurs and whether a run ends there, which is all that is needed to read the fingerprints
back. A remainder seen more than once is followed by a slot that holds its count, marked by
a third bit. Filters of a slice merge without loss, and in sorted order, into one of more
quotients.

Fingerprints that are counted more than once are candidates only: their rows go on to a
comparison of the normalised bytes, so a collision of fingerprints never joins two texts. A
hot text is one entry with a count in each task's filter, one row of each task in the byte
comparison, and dealt over many tasks where rows meet the groups that were found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import if_small, join_dealt, partitions, text_or_empty, written

FILTER_SCHEMA = "slice int, quotient_bits int, slots binary, occupied binary, run_ends binary, counts binary"
#: Fingerprints that a task holds before it makes them a filter.
FOLD_ROWS = 1 << 20
#: Slots in use, of those that quotients name, at most.
LOAD = 0.75


@dataclass
class CountingQuotientFilter:
    """Slots of remainders and counts, and three bits for each; quotients are the first quotient_bits of ``bits`` bits."""

    bits: int
    quotient_bits: int
    slots: np.ndarray  # uint64
    occupied: np.ndarray  # bool, by quotient: it has a run
    run_ends: np.ndarray  # bool, by slot: the last one of a run
    counts: np.ndarray  # bool, by slot: the count of the remainder before it

    @classmethod
    def of(cls, prints: np.ndarray, bits: int = 64) -> CountingQuotientFilter:
        """From fingerprints of so many bits, in any order and repeated as they come."""
        return cls.placed(*np.unique(prints.astype(np.uint64), return_counts=True), bits)

    @classmethod
    def placed(cls, prints: np.ndarray, counters: np.ndarray, bits: int) -> CountingQuotientFilter:
        """From sorted distinct fingerprints and their counts: every run starts at its home slot, or after the run before."""
        wide = 1 + (counters > 1)
        quotient_bits = min(bits, max(1, int(np.ceil(np.log2(max(2, wide.sum() / LOAD))))))
        home = (prints >> np.uint64(bits - quotient_bits)).astype(np.int64) if len(prints) else np.array([], np.int64)
        first = np.flatnonzero(np.r_[True, home[1:] != home[:-1]][: len(home)])
        before = np.cumsum(wide) - wide  # slots of all that come before
        start = np.maximum.accumulate(home[first] - before[first]) + before[first] if len(first) else first
        at = before + np.repeat(start - before[first], np.diff(np.r_[first, len(home)]))
        size = max(1 << quotient_bits, int(at[-1] + wide[-1]) if len(at) else 0)
        slots, marks = np.zeros(size, np.uint64), np.zeros((3, size), bool)
        slots[at] = prints & np.uint64((1 << (bits - quotient_bits)) - 1)
        repeated = at[counters > 1] + 1
        slots[repeated] = counters[counters > 1].astype(np.uint64)
        marks[0, home] = True
        last = np.r_[first[1:], len(home)][: len(first)] - 1
        marks[1, at[last] + wide[last] - 1] = True
        marks[2, repeated] = True
        return cls(bits, quotient_bits, slots, *marks)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints in order, and their counts."""
        home, end = np.flatnonzero(self.occupied), np.flatnonzero(self.run_ends)
        start = np.maximum(home, np.r_[-1, end[:-1]][: len(end)] + 1)
        size = end - start + 1
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        quotients = np.repeat(home.astype(np.uint64), size)
        own = ~self.counts[at]
        at, quotients = at[own], quotients[own]
        follows = np.r_[self.counts, False][at + 1]
        counters = np.where(follows, np.r_[self.slots, np.uint64(0)][at + 1], np.uint64(1))
        shift = np.uint64(self.bits - self.quotient_bits)
        return (quotients << shift if self.bits > self.quotient_bits else quotients) | self.slots[at], counters

    def merged(self, *others: CountingQuotientFilter) -> CountingQuotientFilter:
        """One filter of all; the stable sort of sorted runs is a merge of them, and counts of equal fingerprints add up."""
        parts = [f.entries() for f in (self, *others)]
        prints, counters = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(prints, kind="stable")
        prints, counters = prints[order], counters[order]
        first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]][: len(prints)])
        return self.placed(prints[first], np.add.reduceat(counters, first) if len(first) else counters, self.bits)

    def packed(self) -> tuple[int, bytes, bytes, bytes, bytes]:
        return self.quotient_bits, self.slots.astype("<u8").tobytes(), *(np.packbits(x).tobytes() for x in (self.occupied, self.run_ends, self.counts))

    @classmethod
    def unpacked(cls, bits: int, quotient_bits: int, slots: bytes, *marks: bytes) -> CountingQuotientFilter:
        own = np.frombuffer(slots, "<u8")
        return cls(bits, quotient_bits, own, *(np.unpackbits(np.frombuffer(x, np.uint8), count=len(own)).astype(bool) for x in marks))


class FilterStack:
    """Filters of growing size: two of them merge once the later is as large as the earlier, so each entry moves a few times only."""

    def __init__(self) -> None:
        self.filters: list[CountingQuotientFilter] = []

    def add(self, one: CountingQuotientFilter) -> None:
        self.filters.append(one)
        while len(self.filters) > 1 and len(self.filters[-1].slots) >= len(self.filters[-2].slots):
            self._join(2)

    def whole(self) -> CountingQuotientFilter:
        self._join(len(self.filters))
        return self.filters[0] if self.filters else CountingQuotientFilter.of(np.array([], np.uint64))

    def _join(self, n: int) -> None:
        if n > 1:
            self.filters[-n:] = [self.filters[-n].merged(*self.filters[-n + 1 :])]


#: Fingerprints of a slice, which one group merges.
SLICE_ROWS = 1 << 20


def normalised(text_col: str) -> Column:
    """The text with each run of ASCII white space made one space; null is empty."""
    return F.regexp_replace(text_or_empty(text_col), r"[\x20\x09-\x0D]+", " ")


def repeated_prints(prints: DataFrame, slice_bits: int) -> DataFrame:
    """(fp, n): the fingerprints (one long column, ``fp``) that occur more than once, and how often."""
    bits = 64 - slice_bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, waiting = FilterStack(), []
        for batch in batches:
            waiting.append(batch.column(0).to_numpy().astype(np.int64).view(np.uint64))
            if sum(map(len, waiting)) >= FOLD_ROWS:
                stack.add(CountingQuotientFilter.of(np.concatenate(waiting)))
                waiting = []
        if waiting:
            stack.add(CountingQuotientFilter.of(np.concatenate(waiting)))
        found, counters = stack.whole().entries()
        names, starts = np.unique((found >> np.uint64(bits)).astype(np.int64), return_index=True)
        inside = found & np.uint64((1 << bits) - 1)
        for k, a, b in zip(names.tolist(), starts, np.r_[starts[1:], len(found)], strict=False):
            own = CountingQuotientFilter.placed(inside[a:b], counters[a:b], bits)
            yield pa.RecordBatch.from_pydict({name: [x] for name, x in zip(["slice", "quotient_bits", "slots", "occupied", "run_ends", "counts"], (k, *own.packed()), strict=True)}, schema)

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        filters = [CountingQuotientFilter.unpacked(bits, *r) for r in rows[["quotient_bits", "slots", "occupied", "run_ends", "counts"]].itertuples(index=False)]
        found, counters = filters[0].merged(*filters[1:]).entries()
        often = counters > 1
        whole = found[often] | np.uint64(int(key[0]) << bits)
        return pd.DataFrame({"fp": whole.view(np.int64), "n": counters[often].astype(np.int64)})

    schema = pa.schema([("slice", pa.int32()), ("quotient_bits", pa.int32()), *((name, pa.binary()) for name in ("slots", "occupied", "run_ends", "counts"))])
    filters = prints.mapInArrow(build, FILTER_SCHEMA)
    return filters.groupBy("slice").applyInPandas(merge, "fp long, n long")


def find_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slice_bits: int | None = None) -> DataFrame:
    """Which rows hold equal texts: (id, keep_id, group_size, kept, text_sha256), a row for each input row.

    Texts are equal if their bytes are, after each run of ASCII white space became one space.
    The smallest id of a group stays; ids are of any type that has an order. Null and empty
    texts are equal to each other. A null id loses to any other; where a group has null ids
    only, its rows count as kept. Rows that repeat an id with an equal text are counted and
    flagged alike. An empty table gives none.
    """
    spark = docs.sparkSession
    # slices of SLICE_ROWS at most, about, and several for each task
    slices = max(4 * partitions(spark), -(-docs.count() // SLICE_ROWS)) if slice_bits is None else 1 << slice_bits
    bits = max(6, min(32, (slices - 1).bit_length()))
    text = normalised(text_col)
    repeated = written(repeated_prints(docs.select(F.xxhash64(text).alias("fp")), bits), "copies-prints")
    routed = join_dealt(docs.select(F.col(id_col).alias("id"), text.alias("norm")).withColumn("fp", F.xxhash64("norm")), repeated, "fp", "n", 16, ["id"])
    # grouping by the normalised text itself is the comparison of bytes
    same = routed.groupBy("norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    groups = written(same.select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"), "copies-groups")
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("text_sha256"))
    found = join_dealt(rows, groups.withColumn("in_group", F.lit(True)), "text_sha256", "group_size", 128, ["id"], "left")
    keep = F.when(F.col("in_group"), F.col("keep_id")).otherwise(F.col("id"))
    return found.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256"
    )


FIND_COPIES_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
