"""Operator 10: near duplicates by a chosen-path set similarity join.

Texts with equal shingle sets are first folded into one representative. Each of several
independent trees starts with all representatives. A node selects 1 / similarity of its
signature's minwise tokens on average (one, and at times a second, by a hash of the node's
path) and each document goes to a child for each selected token; so two documents of the
wanted similarity are expected to share a child at every level, while others part.

In every node all documents are compared with a few of them, the pivots; links are confirmed
on the full sets and joined to components. A node whose documents all are in one component
has nothing left to find and ends there, however many near copies it holds. Where few are
outside the node's main component, these are compared with all of the node, which is every
pair that could still join components. Any other node branches again. So no group's pairs
are ever listed and no node is cut short; a large node is dealt in pieces over many tasks,
each with its own copy of the node's few pivots or outsiders.

A deeper node is less surely shared. Documents of nodes that went below the level for which
there are trees enough get further trees of their own, until there are enough for the level
that was reached.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back, hot_keys, if_small, join_dealt, join_pieces, partitions, text_or_empty, written
from .components import components
from .shingles import MULTIPLIER, mix, multipliers, set_key, shingle_set, signature, similar

#: Minwise tokens in a signature.
TOKENS = 160
#: Documents of a node, on average, with which all of it is compared at first.
PIVOTS = 32
#: Outsiders up to this number are compared with all of their node.
FEW = 1024
#: A node's documents that one piece of it holds.
PIECE = 256
#: Standard deviations that a sketch may lie below the wanted similarity; 4.75 lose 4e-6 of the pairs that just have it.
SLACK = 4.75
#: Share of what the recall may lose that goes to the comparison of signatures, which is the same in every tree.
FILTER_LOSS = 0.1
#: Levels for which the first trees are enough.
LEVELS = 4
CACHED_SETS = 64
#: Hashes of a set in the sketch that settles doubtful pairs; a smaller set is told exactly.
SKETCH = 256
#: Levels of a tree from one comparison with pivots to the next; those between only part what differs.
LEVELS_BETWEEN = 4
#: Bytes of signatures that go to all executors; more are joined by a shuffle.
FEW_BYTES = 16 << 20
NOT_A_HASH = np.uint64(1 << 32)


def trees_for(recall: float, similarity: float, depth: int) -> int:
    """Trees until a pair of just this similarity meets at that depth in one of them, with this probability."""
    second, lost = 1 / similarity - 1, 0.0
    for _ in range(depth):
        child = 1 - similarity + similarity * lost
        lost = (1 - second) * child + second * child**2
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def fewest_equal(recall: float, similarity: float) -> int:
    """Equal tokens that a pair of just this similarity has, but for FILTER_LOSS of what the recall may lose."""
    fewer = 0.0
    for k in range(TOKENS + 1):
        fewer += math.comb(TOKENS, k) * similarity**k * (1 - similarity) ** (TOKENS - k)
        if fewer > FILTER_LOSS * (1 - recall):
            return k
    return TOKENS


def _binary_rows(column: pa.Array, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def document_sets(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, print, n, key, sig, uid): a text's hash, the size, digest and signature of 32-bit tokens of its shingle set; uid names the row."""
    by = multipliers(TOKENS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, tokens = [], [], []
            for text in batch.column(2).to_pylist():
                prints = shingle_set(text, words)
                sizes.append(len(prints))
                keys.append(set_key(prints))
                tokens.append(signature(prints, by).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(tokens, pa.binary())], ["id", "print", "n", "key", "sig"])
        give_back()

    read = documents(docs, id_col, text_col).select("id", F.xxhash64("text").alias("print"), "text")
    return read.mapInArrow(run, "id long, print long, n long, key binary, sig binary").withColumn("uid", F.monotonically_increasing_id())


def documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("text"))


def repeated_ids(sets: DataFrame) -> DataFrame:
    """(id, uid, print, key) of ids with several rows: the row that counts as the document, which is the one of the smallest key among those with words."""
    own = F.struct((F.col("n") == 0).alias("blank"), "key", "uid", "print")
    found = sets.filter("id is not null").groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1").select("id")
    found = if_small(written(found, "near-repeats"), 16)
    return sets.join(found, "id").groupBy("id").agg(F.min(own).alias("m")).select("id", F.col("m.uid").alias("best"), F.col("m.print").alias("print"), F.col("m.key").alias("best_key"))


def sketches(texts: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(rep, sketch): the high halves of the SKETCH smallest hashes of each wanted text's set, in order; of a smaller set all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [(shingle_set(t, words)[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(least, pa.binary())], ["rep", "sketch"])
        give_back()

    named = texts.withColumnRenamed("id", "rep").join(if_small(wanted, 16), "rep", "left_semi")
    return named.mapInArrow(run, "rep long, sketch binary").dropDuplicates(["rep"])  # rows of an id have one text here


def shortened(reps: DataFrame) -> DataFrame:
    """With ``short``: the low byte of each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shorts = [x[::4] for x in batch.column(2).to_pylist()]  # tokens are little-endian
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shorts, pa.binary())], ["rep", "n", "sig", "short"])

    return reps.mapInArrow(run, "rep long, n long, sig binary, short binary")


def branch(nodes: DataFrame, similarity: float, trees: range = range(0)) -> DataFrame:
    """(node, rep): the children of (node, rep, sig) rows; with ``trees``, of the roots of these numbers."""
    second = int((1 / similarity - 1) * (1 << 63)) * 2

    def children(node: np.ndarray, rep: np.ndarray, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = mix(node ^ np.uint64(11)) % np.uint64(TOKENS)
        other = (first + np.uint64(1) + mix(node ^ np.uint64(12)) % np.uint64(TOKENS - 1)) % np.uint64(TOKENS)
        also = mix(node ^ np.uint64(13)) < np.uint64(second)
        for at, some in ((first, np.ones(len(node), bool)), (other, also)):
            token = sig[np.flatnonzero(some), at[some].astype(np.int64)].astype(np.uint64)
            child = mix(mix(node[some] + at[some]) + token * MULTIPLIER)
            yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(rep[some])], ["node", "rep"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rep, sig = batch.column(1).to_numpy(), _binary_rows(batch.column(2), TOKENS, "<u4")
            if not trees:
                yield from children(batch.column(0).to_numpy().view(np.uint64), rep, sig)
            for k in trees:
                yield from children(np.full(len(rep), mix(np.array([k + 1], np.uint64))[0]), rep, sig)

    return nodes.select("node", "rep", "sig").mapInArrow(run, "node long, rep long")


class Probes:
    """A node's probes as matrices: rep, component, set size, low token bytes, and sketches where there are any."""

    def __init__(self, rows: list[tuple]):
        self.rep, self.comp, self.size = (np.array([r[k] for r in rows]) for k in range(3))
        self.short = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(-1, TOKENS)
        self.sketch = None
        if len(rows[0]) > 4:
            self.sketch = np.full((len(rows), SKETCH), NOT_A_HASH, np.uint64)
            for k, row in enumerate(rows):
                own = np.frombuffer(row[4], "<u4")
                self.sketch[k, : len(own)] = own
            self.limit = np.where(self.size <= SKETCH, NOT_A_HASH, self.sketch[:, -1])

    def likely(self, row: tuple, similarity: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Probes of other components whose sizes and tokens leave the similarity possible, and their equal tokens."""
        some = np.flatnonzero((self.comp != row[1]) & (np.minimum(self.size, row[2]) >= similarity * np.maximum(self.size, row[2]) - 1e-6))
        same = (self.short[some] == np.frombuffer(row[3], np.uint8)).sum(axis=1)
        return some[same >= least], same[same >= least]

    def settled(self, some: np.ndarray, row: tuple, similarity: float) -> np.ndarray:
        """Of these, what the sketches leave possible.

        Both sketches hold all hashes up to the smaller of their limits, so the similarity below
        it is known: exactly for small sets, else as a sample of the whole.
        """
        own = np.frombuffer(row[4], "<u4").astype(np.uint64)
        limit = np.minimum(self.limit[some], NOT_A_HASH if row[2] <= SKETCH else own[-1])
        theirs = self.sketch[some]
        inside = (theirs <= limit[:, None]) & (theirs < NOT_A_HASH)
        at = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
        both = ((own[at] == theirs) & inside).sum(axis=1)
        union = inside.sum(axis=1) + np.searchsorted(own, limit, "right") - both
        slack = np.where(limit >= NOT_A_HASH, 1.5 / union, SLACK * np.sqrt(similarity * (1 - similarity) / union))
        return some[both / union >= similarity - slack]


def met(rows: DataFrame, reps: DataFrame, similarity: float, least: int, best: bool) -> DataFrame:
    """Likely pairs (a, b) of a node's probes with its documents, across components.

    rows: (node, rep, c, size, probe); reps: (rep, n, short) and for the last look sketch;
    least: the equal tokens that a pair needs.
    With ``best``, only each document's best probe and each probe's best document of a piece;
    otherwise all pairs that may be similar.
    """
    def pairs_of(probes: Probes, docs: list[tuple]) -> Iterator[tuple[int, int]]:
        top: dict[int, tuple[int, int]] = {}
        for row in docs:
            some, same = probes.likely(row, similarity, least)
            if len(some) and probes.sketch is not None:
                kept = np.isin(some, probes.settled(some, row, similarity))
                some, same = some[kept], same[kept]
            if not len(some):
                continue
            if not best:
                yield from ((row[0], int(r)) for r in probes.rep[some])
                continue
            yield row[0], int(probes.rep[some[same.argmax()]])
            for k, n in zip(some.tolist(), same.tolist(), strict=True):
                if n > top.get(k, (0, 0))[0]:
                    top[k] = (n, row[0])
        yield from ((own, int(probes.rep[k])) for k, (_, own) in top.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, probes, docs, ready = None, [], [], None
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for node, piece, probe, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (node, piece) != at or len(docs) >= PIECE:
                    if probes and docs:
                        ready = ready or Probes(probes)
                        found.update(pairs_of(ready, docs))
                    docs = []
                    if (node, piece) != at:
                        at, probes, ready = (node, piece), [], None
                (probes if probe else docs).append(tuple(row))
            yield _pair_batch(found)
        if probes and docs:
            yield _pair_batch(set(pairs_of(ready or Probes(probes), docs)))
        give_back()

    shown = rows.join(reps, "rep").withColumn("pieces", F.ceil(F.col("size") / PIECE).cast("int"))
    docs = shown.withColumn("piece", F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int")).withColumn("probe", F.lit(False))
    probes = shown.filter("probe").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    dealt = probes.unionByName(docs).repartition(partitions(rows.sparkSession), "node", "piece").sortWithinPartitions("node", "piece", F.desc("probe"), "rep")
    return dealt.select("node", "piece", "probe", "rep", "c", *[c for c in ("n", "short", "sketch") if c in reps.columns]).mapInArrow(run, "a long, b long").distinct()


def _pair_batch(pairs: set[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.int64()), pa.array([max(p) for p in pairs], pa.int64())], ["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar on their full sets; ``pairs`` has to be a written table.

    A text with many partners is copied once for each HOT of them, and its pairs are dealt
    over as many tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        for batch in batches:
            left, right = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            kept = []
            for k, (a, text_a, text_b) in enumerate(zip(left, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if a not in sets:
                    if len(sets) >= CACHED_SETS:
                        sets.clear()
                    sets[a] = shingle_set(text_a, words)
                if similar(sets[a], shingle_set(text_b, words), percent):
                    kept.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([left[k] for k in kept], pa.int64()), pa.array([right[k] for k in kept], pa.int64())], ["a", "b"])
        give_back()

    named = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = texts.join(if_small(written(named, "near-ids"), 16), "id", "left_semi")
    found = pairs
    # first the members' own texts, then the hub's, which is never copied for each of its pairs
    for x, other in (("b", "a"), ("a", "b")):
        hubs = written(hot_keys(pairs.groupBy(x).agg(F.count("*").alias("size")), x, "size"), "near-hubs")
        found = join_pieces(found, texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")), x, hubs, [other])
    return found.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def find_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, recall: float = 0.9999) -> DataFrame:
    """Components of near-duplicate texts: (id, n_shingles, component_id, kept), a row for each input row.

    Two texts are linked if ``100 * |A and B| >= percent * |A or B|`` for their sets of
    distinct shingles of ``words`` words. ``recall`` is the probability with which a pair of
    just that similarity meets at the deepest level that its nodes reach. component_id is the
    smallest id that links reach; kept marks that id's rows. Null, empty and blank texts have
    no shingles and are linked with nothing. A row without an id is linked with nothing and
    kept. Rows that repeat an id are one document: the text of the smallest set digest among
    those with words stands for it, and the others share its component. Ids are integers. An
    empty table gives none.
    """
    bounded_batches(docs.sparkSession)
    similarity = percent / 100
    least = fewest_equal(recall, similarity)
    sets = written(document_sets(docs, id_col, text_col, words), "near-sets")
    repeats = written(repeated_ids(sets), "near-repeated")
    texts, own = documents(docs, id_col, text_col), sets.filter("n > 0 and id is not null")
    if not repeats.isEmpty():
        few = if_small(repeats, 64)
        own = own.join(few.select("id", "best"), "id", "left").filter("best is null or best = uid")
        texts = texts.join(few.select("id", "print"), "id", "left").filter("print is null or print = xxhash64(text)").select("id", "text")
    classes = own.groupBy("key").agg(F.min("id").alias("rep"), F.min_by("uid", "id").alias("uid"), F.count("*").alias("size"))
    classes = written(classes, "near-classes")
    reps = sets.join(if_small(classes.select("rep", "uid"), 32), "uid").select("rep", "n", "sig")
    reps = written(shortened(reps), "near-reps")
    shorts = if_small(reps.select("rep", "n", "short"), 2 * TOKENS, FEW_BYTES)
    compared: list[DataFrame] = []
    labels = None

    def labelled(rows: DataFrame) -> DataFrame:
        if labels is None:
            return rows.withColumn("c", F.col("rep"))
        return rows.join(labels, "rep", "left").withColumn("c", F.coalesce("c", "rep"))

    def compare(rows: DataFrame, known: DataFrame, best: bool) -> None:
        """Confirm the likely pairs not seen before, and bring the labels up to date."""
        nonlocal labels
        pairs = met(labelled(rows), known, similarity, least, best)
        for old in compared:
            pairs = pairs.join(if_small(old, 32), ["a", "b"], "left_anti")
        pairs = written(pairs, "near-pairs")
        compared.append(pairs)
        new = written(confirmed(pairs, texts, words, percent).distinct(), "near-links")
        if labels is None or not new.isEmpty():
            # what is known is a star for each component, so a look joins its own links to that and not all before
            stars = [] if labels is None else [labels.filter("rep <> c").select(F.col("rep").alias("a"), F.col("c").alias("b"))]
            labels = components(reduce(DataFrame.union, [new, *stars])).withColumnRenamed("v", "rep")
            labels = if_small(labels, 32)

    def unfinished(rows: DataFrame) -> DataFrame:
        """(node, rep, size, probe, outsiders) of the nodes with several components; probes are outside the main one."""
        own = labelled(rows.select("node", "rep", "size"))
        main = own.groupBy("node", "c").agg(F.count("*").alias("n")).groupBy("node").agg(F.max_by("c", "n").alias("main"), F.max("n").alias("most"), F.sum("n").alias("held"))
        main = written(main.filter("held > most").select("node", "main", "held", (F.col("held") - F.col("most")).alias("outsiders")), "near-main")
        return join_dealt(own, main, "node", "held", 40, ["rep"]).select("node", "rep", "size", (F.col("c") != F.col("main")).alias("probe"), "outsiders")

    few: list[DataFrame] = []
    members, trees, reached = reps, 0, LEVELS
    while (wanted := trees_for(recall, similarity, reached)) > trees:
        rows = written(branch(members.withColumn("node", F.lit(0).cast("long")), similarity, range(trees, wanted)), "near-rows")
        trees, enough, deeper = wanted, reached, []
        for level in itertools.count():
            sizes = written(rows.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1"), "near-sizes")
            held = written(join_dealt(rows, sizes, "node", "size", 24, ["rep"]), "near-nodes")
            if level % LEVELS_BETWEEN == 0:
                draw = F.pmod(F.xxhash64(F.col("rep"), F.lit(1)), F.lit(1 << 20)) / F.lit(float(1 << 20))
                compare(held.withColumn("probe", draw < PIVOTS / F.col("size")), shorts, best=True)
            left = written(unfinished(held), "near-left")
            few.append(left.filter(F.col("outsiders") <= FEW))
            many = left.filter(F.col("outsiders") > FEW)
            if many.isEmpty():
                break
            # the nodes of this level are level + 1 branchings from the root, their children one more
            reached = max(reached, level + 2)
            if level + 2 > enough:
                deeper.append(many.select("rep"))
            rows = written(branch(many.select("node", "rep").join(reps, "rep"), similarity), "near-rows")
        if deeper:
            named = written(reduce(DataFrame.union, deeper).distinct(), "near-deeper")
            members = reps.join(if_small(named, 16), "rep", "left_semi")
    last = reduce(DataFrame.union, few)
    compare(last, shorts, best=True)
    # a document without a best partner has none; the others meet all of their node once more
    ends = reduce(DataFrame.union, compared)
    partnered = written(ends.select(F.col("a").alias("rep")).union(ends.select(F.col("b").alias("rep"))).distinct(), "near-partnered")
    last = unfinished(last.join(if_small(partnered, 16), "rep", "left_semi"))
    known = reps.select("rep", "n", "short").join(written(sketches(texts, partnered, words), "near-sketches"), "rep")
    compare(last, known, best=False)
    named = written(classes.join(labels, "rep", "left").select("key", F.coalesce("c", "rep").alias("component_id"), "size"), "near-named")
    rows = sets.select("id", "n", "key", "uid")
    if not repeats.isEmpty():
        rows = rows.join(if_small(repeats, 64).select("id", "best_key"), "id", "left").withColumn("key", F.coalesce("best_key", "key"))
    out = join_dealt(rows, named, "key", "size", 56, ["uid"], "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))
