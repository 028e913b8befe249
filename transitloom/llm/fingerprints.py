"""Operator 5: quartile bucket digests, a locality-sensitive fingerprint of a text's bytes.

All byte triplets within a sliding window of five are hashed to 256 buckets. Each bucket is
encoded in two bits by the quartile its count falls in, so a digest depends on the shape of
the counts and not on their scale; a checksum, the length's logarithm and two quartile
ratios come first. The difference of two digests adds up bucket steps and header steps up
to a bound, and likeness is what is left of that bound.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, partitions, text_or_empty

BUCKETS = 256
#: The triplets of a window whose first byte is in all of them.
TRIPLETS = [(0, 1, 2), (0, 1, 3), (0, 1, 4), (0, 2, 3), (0, 2, 4), (0, 3, 4)]
FACTORS = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)]
#: Differences from here on count as none alike.
BOUND = 320
#: Bytes whose triplets are hashed at once; bounds a very long text's memory.
BLOCK = 1 << 16
#: The place of rows without an id: after all others. Ids are larger; bounds pass through doubles, which hold it exactly.
NO_ID = -(1 << 62)


def _counts(data: bytes) -> np.ndarray:
    x = np.frombuffer(data.ljust(5, b"\0"), np.uint8).astype(np.uint32)
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(x) - 4, BLOCK):
        part = x[at : at + BLOCK + 4]
        scaled, n = [part * f for f in FACTORS], len(part) - 4
        hashed = np.empty((len(TRIPLETS), n), np.uint32)
        for row, (a, b, c) in enumerate(TRIPLETS):
            np.add(scaled[0][a : a + n], scaled[1][b : b + n], out=hashed[row])
            hashed[row] += scaled[2][c : c + n]
            hashed[row] += np.uint32(row * 0x27D4EB2F & 0xFFFFFFFF)
        total += np.bincount((hashed.ravel() >> np.uint32(24)).astype(np.intp), minlength=BUCKETS)
    return total


def digest(text: str) -> str:
    """Hexadecimal: checksum, length code, quartile ratios (a byte each), then two bits a bucket."""
    data = text.encode()
    if not data:
        return "00" * (3 + BUCKETS // 4)
    counts = _counts(data)
    q1, q2, q3 = np.partition(counts, (BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1))[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).astype(np.uint8).reshape(-1, 4)
    packed = codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]
    ratio = lambda q: int(16 * q / q3) % 16 if q3 else 0
    head = bytes([hashlib.blake2b(data, digest_size=1).digest()[0], min(255, 1 + int(8 * math.log2(len(data)))), ratio(q1) << 4 | ratio(q2)])
    return (head + packed.astype(np.uint8).tobytes()).hex()


def _unpacked(text: str) -> tuple[bytes, np.ndarray]:
    raw = bytes.fromhex(text)
    body = np.frombuffer(raw, np.uint8, offset=3)
    return raw[:3], np.stack([body >> 6, body >> 4 & 3, body >> 2 & 3, body & 3]).astype(np.int8)


def difference(a: str, b: str) -> int:
    """From 0 to BOUND; 0 for equal digests."""
    if a == b:
        return 0
    (head_a, body_a), (head_b, body_b) = _unpacked(a), _unpacked(b)
    steps = np.abs(body_a - body_b)
    total = int(steps.sum()) + 3 * int((steps == 3).sum())
    total += max(0, abs(head_a[1] - head_b[1]) - 1) + (head_a[0] != head_b[0])
    for shift in (0, 4):
        off = abs((head_a[2] >> shift & 15) - (head_b[2] >> shift & 15))
        total += min(off, 16 - off)
    return min(BOUND, total)


def likeness(a: str, b: str) -> float:
    return 1 - difference(a, b) / BOUND


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, copy, id, text) in which a bucket's rows, then a copy of the next bucket's first row, follow each other.

    Buckets are ranges of ids of about equal size, in descending order. Where one id repeats
    so often that it would fill several, or as many rows have none, a hash of the text parts
    its rows too. Only bounds and first rows' ids and hashes, a few for each partition, come
    to the driver. The text moves once.
    """
    spark = docs.sparkSession
    count = 4 * partitions(spark)
    place = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    cuts = docs.agg(F.percentile_approx(place, [k / count for k in range(1, count)], 10 * count)).first()[0] or []
    bounds = np.sort(-np.array(cuts, np.int64))
    repeats = len(np.unique(bounds)) < len(bounds)
    text = text_or_empty(text_col)
    far = F.xxhash64(text) if repeats else F.lit(0).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), place.alias("place"), far.alias("far"), text.alias("text"))

    def bucket_of(place: np.ndarray, far: np.ndarray) -> np.ndarray:
        """The bounds before a row, and of those at its very id the share that its hash has passed."""
        start, end = np.searchsorted(bounds, -place, "left"), np.searchsorted(bounds, -place, "right")
        passed = (far >> 32) + (1 << 31)  # from 0 to 2**32
        return (start + (passed * np.maximum(end - start, 1) >> 32)).astype(np.int32)

    @F.pandas_udf("int")
    def bucket(place: pd.Series, far: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(place.to_numpy(), far.to_numpy()))

    dealt = rows.withColumn("bucket", bucket("place", "far"))
    firsts = dealt.groupBy("bucket").agg(F.min(F.struct((-F.col("place")).alias("down"), "far")).alias("first")).orderBy("bucket").collect()
    heads = np.array([(-r.first.down, r.first.far) for r in firsts], np.int64).reshape(-1, 2)
    where = bucket_of(heads[:, 0], heads[:, 1]).tolist()
    # the first row of each bucket also ends the one before it, and the very first one the last
    ends = spark.createDataFrame([(*head, where[k - 1]) for k, head in enumerate(heads.tolist())], "place long, far long, bucket int")
    least = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least")
    copies = rows.join(F.broadcast(ends), ["place", "far"]).groupBy("bucket", "place").agg(least)  # one row a bucket
    copies = copies.select("bucket", F.lit(True).alias("copy"), F.lit(None).cast(docs.schema[id_col].dataType).alias("id"), "place", F.col("least.text").alias("text"))
    both = dealt.select("bucket", F.lit(False).alias("copy"), "id", "place", "text").union(copies)
    ordered = both.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "copy", F.desc("place"), F.xxhash64("text"), "text")
    return ordered.select("bucket", "copy", "id", "text")


def fingerprint_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_texts: bool = True) -> DataFrame:
    """Fingerprints of each text and of its edit with the next text in descending id.

    Returns (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next), and with ``keep_texts`` the edited text. A null text is empty. Rows without
    an id come last; rows of equal id follow each other by a hash of their texts, so repeated
    rows have a defined order. The last row's next is the first, and a lone row's its own.
    Ids are integers. An empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # bucket, id, text and digest of the row that waits for its next
        for batch in batches:
            out = []
            for bucket, copy, number, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                own = digest(text) if not copy or last else None
                if last and last[0] == bucket:
                    _, before, old, print_old = last
                    changed = edited(old, text)
                    print_changed = print_old if changed == old else digest(changed)
                    row = (before, len(old), hashlib.sha256(changed.encode()).hexdigest(), print_old, print_changed, likeness(print_old, print_changed), likeness(print_old, own))
                    out.append((*row, changed) if keep_texts else row)
                last = None if copy else (bucket, number, text, own)
            columns = list(zip(*out, strict=True)) or [[]] * (7 + keep_texts)
            kinds = [batch.schema.field(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]
            names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_text"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=False)], names[: len(columns)])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double" + ", edited_text string" * keep_texts
    return with_next_text(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)
