"""Corpus queries against plain versions on the small tables, round trips and held-out accuracy."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from transitloom.llm import components as comps
from transitloom.llm import exact_dedup, fingerprints, mixing, near_dedup, pii, quality, toxicity
from transitloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
MORE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts():
    table = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    return dict(zip(table.doc_id, table.text.fillna("")))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(name, spark):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{MORE}/{t}.parquet'")
    got = QUERIES[name](spark, MORE)
    made = con.execute(ORACLES[name])
    names = [c[0] for c in made.description]
    order = sorted(names)
    assert sorted(got.columns) == order
    told = lambda rows, at: sorted([repr(r[c]) for c in at] for r in rows)
    assert told(got.collect(), order) == told(made.fetchall(), [names.index(c) for c in order])


def test_tokens_and_round_trip(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {k: library.encode(t, add_special_tokens=False).ids for k, t in texts.items()}
    for row in QUERIES["op2_token_counts"](spark, SF).collect():
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(texts[row.doc_id].encode()), len(want[row.doc_id]), len(want[row.doc_id]) > 1024)
    for row in QUERIES["op4_bpe"](spark, SF).collect():
        ids = want[row.doc_id]
        back = library.decode(ids, skip_special_tokens=False)
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest() and back == texts[row.doc_id]


def test_long_words_merge_alike():
    from transitloom.llm.bpe import BytePairCoder, Vocabulary

    coder = BytePairCoder(Vocabulary.of(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read()))
    rng = np.random.default_rng(3)
    for size in (1, 2, 7, 60, 250):
        word = bytes(rng.choice(np.frombuffer(b"aeinorstthe", np.uint8), size))
        assert coder.merge(word) == coder._merge_long([coder.byte_ids[b] for b in word])


def test_fingerprints(spark, texts):
    order = sorted(texts, reverse=True)
    after = dict(zip(order, [*order[1:], order[0]]))
    rows = QUERIES["op5_fingerprints"](spark, SF).collect()
    assert len(rows) == len(texts)
    for row in rows:
        own, other = texts[row.doc_id], texts[after[row.doc_id]]
        half = len(own) // 2
        changed = own[: len(own) - half] + other[:half]
        assert row.n_chars == len(own) and row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert row.fingerprint == fingerprints.digest(own) and row.edited_fingerprint == fingerprints.digest(changed)
        assert 0 <= row.near_next <= 1 and row.near_edited == fingerprints.likeness(row.fingerprint, row.edited_fingerprint)
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.97


def test_rows_without_an_id_are_dealt_over_buckets(spark):
    rng = np.random.default_rng(11)
    made = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, " ".join(rng.choice(["sun", "moon", "sea", "wind", "stone"], 12)) + f" {k // 2}") for k in range(600)]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    sizes = collections.Counter(r.bucket for r in fingerprints.with_next_text(docs, "doc_id", "text").filter("not copy").collect())
    assert len(sizes) >= 12 and max(sizes.values()) < 120
    keyed = docs.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()
    order = sorted(keyed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h, r.text))
    want = [(r.doc_id, fingerprints.edited(r.text, n.text)) for r, n in zip(order, [*order[1:], order[0]], strict=True)]
    got = fingerprints.fingerprint_edits(docs).collect()
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.edited_text)) for r in got)


def plain_digest(text):
    """The digest by loops: every triplet of every window into its bucket, then the quartiles."""
    data = text.encode()
    if not data:
        return "00" * (3 + fingerprints.BUCKETS // 4)
    x, m = data.ljust(5, b"\0"), 1 << 32
    counts = [0] * fingerprints.BUCKETS
    for at in range(len(x) - 4):
        for row, (a, b, c) in enumerate(fingerprints.TRIPLETS):
            hashed = sum(int(f) * x[at + k] for f, k in zip(fingerprints.FACTORS, (a, b, c), strict=True)) + row * 0x27D4EB2F
            counts[hashed % m >> 24] += 1
    ranked, quarter = sorted(counts), fingerprints.BUCKETS // 4
    q1, q2, q3 = ranked[quarter - 1], ranked[2 * quarter - 1], ranked[3 * quarter - 1]
    ratio = lambda q: int(16 * q / q3) % 16 if q3 else 0
    codes = [(n > q1) + (n > q2) + (n > q3) for n in counts]
    body = [codes[k] << 6 | codes[k + 1] << 4 | codes[k + 2] << 2 | codes[k + 3] for k in range(0, len(codes), 4)]
    head = [hashlib.blake2b(data, digest_size=1).digest()[0], min(255, 1 + int(8 * math.log2(len(data)))), ratio(q1) << 4 | ratio(q2)]
    return bytes(head + body).hex()


def plain_likeness(a, b):
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    if x == y:
        return 1.0
    total = (x[0] != y[0]) + max(0, abs(x[1] - y[1]) - 1)
    for shift in (0, 4):
        off = abs((x[2] >> shift & 15) - (y[2] >> shift & 15))
        total += min(off, 16 - off)
    for p, q in zip(x[3:], y[3:], strict=True):
        for shift in (0, 2, 4, 6):
            step = abs((p >> shift & 3) - (q >> shift & 3))
            total += 6 if step == 3 else step
    return 1 - min(fingerprints.BOUND, total) / fingerprints.BOUND


def test_digests_by_a_plain_loop(texts):
    some = sorted(texts.values(), key=len)[:40] + ["", "a", "abcd", "é" * 300, "\0" * 50]
    prints = [fingerprints.digest(t) for t in some]
    assert prints == [plain_digest(t) for t in some]
    for k in range(1, len(prints)):
        assert math.isclose(fingerprints.likeness(prints[k - 1], prints[k]), plain_likeness(prints[k - 1], prints[k]))


def plain_components(texts, words, percent):
    sets = {}
    for k, t in texts.items():
        found = t.encode().lower().split()
        n = min(words, len(found))
        sets[k] = frozenset(tuple(found[i : i + n]) for i in range(len(found) - n + 1)) if found else frozenset()
    above = {k: k for k in sets}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    ids = [k for k in sorted(sets) if sets[k]]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = root(a), root(b)
                    above[max(p, q)] = min(p, q)
    return {k: (len(sets[k]), root(k)) for k in sets}


@pytest.mark.parametrize("words", [4, 5])
def test_near_copies(spark, texts, words):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.find_near_copies(docs, words=words).collect()}
    assert got == plain_components(texts, words, 80)


def test_near_copies_in_a_large_group(spark, monkeypatch):
    """Heavily edited copies of one text, many of them in nodes that have to branch."""
    monkeypatch.setattr(near_dedup, "FEW", 8)
    monkeypatch.setattr(near_dedup, "PIVOTS", 2)
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    made = {}
    for k in range(150):
        own = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 7)):
            own[at] = f"e{rng.integers(0, 10**6)}"
        made[k] = " ".join(own)
    docs = spark.createDataFrame(list(made.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.find_near_copies(docs, words=4, recall=0.99999).collect()}
    assert got == plain_components(made, 4, 80)


def test_signatures_lose_far_less_than_the_recall_allows():
    least = near_dedup.fewest_equal(0.9999, 0.8)
    lost = sum(math.comb(near_dedup.TOKENS, k) * 0.8**k * 0.2 ** (near_dedup.TOKENS - k) for k in range(least))
    assert 0 < lost <= 1e-5


def test_deep_nodes_get_trees_for_their_depth(spark, monkeypatch):
    """Pairs of just the wanted similarity among texts that share a passage, at the production recall."""
    monkeypatch.setattr(near_dedup, "FEW", 4)
    monkeypatch.setattr(near_dedup, "PIVOTS", 0)
    roots, branch = [], near_dedup.branch

    def counted(nodes, similarity, trees=range(0)):
        roots.append(trees if isinstance(trees, int) else len(trees))
        return branch(nodes, similarity, trees)

    monkeypatch.setattr(near_dedup, "branch", counted)
    passage, made = [f"w{k}" for k in range(70)], {}
    for k in range(100):
        own = [f"p{k // 2}x{i}" for i in range(20)]
        made[k] = " ".join([*passage, *own, *(f"q{k}x{i}" for i in range(10))])
    docs = spark.createDataFrame(list(made.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.find_near_copies(docs, words=1, recall=0.9999).collect()}
    assert got == plain_components(made, 1, 80)
    deepest, run = 0, 0
    for n in roots:
        run = 1 if n else run + 1
        deepest = max(deepest, run)
    assert deepest > 4 and sum(roots) >= near_dedup.trees_for(0.9999, 0.8, deepest)


def test_components_both_ways(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (250, 2))] + [(1000 + k, 1001 + k) for k in range(40)]
    table = spark.createDataFrame(links, "a long, b long")
    told = lambda df: sorted(map(tuple, df.collect()))
    assert told(comps._by_union_find(table)) == told(comps._by_labels(table))


class PlainSlots:
    """A counting quotient filter by the book: one fingerprint at a time into lists of runs."""

    def __init__(self, counter, bits, quotient_bits):
        rest = bits - quotient_bits
        runs = {}
        for p in sorted(counter):
            runs.setdefault(p >> rest, []).append((p & (1 << rest) - 1, counter[p]))
        self.slots, free = {}, 0
        for home in sorted(runs):
            at = max(home, free)
            for k, (remainder, n) in enumerate(runs[home]):
                last = k == len(runs[home]) - 1
                self.slots[at] = (remainder, last and n == 1, False)
                at += 1
                if n > 1:
                    self.slots[at] = (n, last, True)
                    at += 1
            free = at
        self.occupied = set(runs)


@pytest.mark.parametrize("spread,size", [(50, 5000), (1, 3000), (62, 800), (0, 1), (0, 0)])
def test_quotient_filters_merge_without_loss(spread, size):
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 63, size, dtype=np.uint64) >> np.uint64(spread)
    parts = [exact_dedup.CountingQuotientFilter.of(x) for x in np.array_split(prints, 7)]
    parts = [exact_dedup.CountingQuotientFilter.unpacked(64, *p.packed()) for p in parts]
    whole = parts[0].merged(*parts[1:])
    want = collections.Counter(prints.tolist())
    found, counts = whole.entries()
    assert dict(zip(found.tolist(), counts.tolist())) == want and found.tolist() == sorted(want)
    plain = PlainSlots(want, 64, whole.quotient_bits)
    assert set(np.flatnonzero(whole.occupied).tolist()) == plain.occupied
    for at in range(len(whole.slots)):
        assert (int(whole.slots[at]), bool(whole.run_ends[at]), bool(whole.counts[at])) == plain.slots.get(at, (0, False, False))


def test_filters_that_a_task_stacks_lose_nothing():
    rng = np.random.default_rng(4)
    stack, want = exact_dedup.FilterStack(), collections.Counter()
    for size in (10, 400, 3, 400, 90, 1000, 1):
        prints = rng.integers(0, 300, size, dtype=np.uint64)
        stack.add(exact_dedup.CountingQuotientFilter.of(prints))
        want.update(prints.tolist())
    found, counts = stack.whole().entries()
    assert dict(zip(found.tolist(), counts.tolist())) == want


def test_pii_base_spans(texts):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def passes(kind, text):
        digits = re.sub("[^0-9]", "", text)
        if kind == "ip":
            return all(int(p) <= 255 for p in text.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and pii.luhn(digits)
        return kind == "email" or 9 <= len(digits) <= 15

    odd = ["a@b@c.de x@y", "..@a.b-c.de@f.g", "1.2.3.4.5.6.7.8 1.2.3.256 001.02.3.4", "4111 1111-1111 1111 4111111111111111", "+1 (2) 3-4 5 6 7 8 9 +1+23456789012", "@@@ a@b. a@-.-"]
    for text in [*texts.values(), *odd]:
        want = [(kind, *m.span()) for kind, p in patterns.items() for m in re.finditer(p, text) if passes(kind, m[0])]
        assert pii.base_spans(text) == want


@pytest.fixture(scope="module")
def field(spark):
    return pii.learn_field(spark.read.parquet(f"{MORE}/documents.parquet"), "text", 1500)


def test_pii_adds_what_patterns_miss(spark, field):
    found = lambda t: [(k, t[a:b]) for r in pii.regions(t) for k, a, b in field.decode(t, *r)]
    assert found("call (705) 555-5569 now") == [("phone", "(705) 555-5569")] and found("tel 705-555-5569") == [("phone", "705-555-5569")]
    assert found("id 5927243074273351 x") == [("account", "5927243074273351")]
    assert found('a token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" b') == [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")]
    for clean in ("on 2024-01-02 at 3.4000 2024-01", "version 10.0.19041.388 of", "0" * 50, "3.14159265358979", "1 2 3 4 5 6 7 8 9 10 11", "Apache License, Version 2.0.", "in 1998-2003, page 12 of 345"):
        assert found(clean) == []
    query = QUERIES["op7_pii"](spark, SF)
    for r in query.collect():
        assert r.n_spans == len(r.spans.split(",")) * (r.spans != "") == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added


def test_pii_finds_numbers_and_secrets_that_were_never_taught(field):
    """Planted spans of a fresh seed: recall on them, and none in look-alikes."""
    import random

    rng = random.Random(99)
    made = {"account": lambda: pii._digits(rng, 16, False), "secret": lambda: "".join(rng.choices("0123456789abcdef", k=40)), "phone": lambda: "({}) {}-{}".format(*(pii._digits(rng, n) for n in (3, 3, 4)))}
    for kind, value in made.items():
        hits = 0
        for _ in range(100):
            span = value()
            text = f"some words before {span} and after"
            hits += (kind, span) in [(k, text[a:b]) for r in pii.regions(text) for k, a, b in field.decode(text, *r)]
        assert hits >= 95, (kind, hits)
    wrong = 0
    for _ in range(300):
        text = f"some words before {pii._look_alike(rng)} and after"
        wrong += any(field.decode(text, *r) for r in pii.regions(text))
    assert wrong <= 15


def test_pii_program_equals_all_segmentations(field):
    """The best score of short regions over every segmentation there is, one by one; likewise the gradient's probabilities."""
    texts = ["+1 (705) 555-5569", "a.b@c.de 4111 1111", "1.2.3.4 55512345", 'key="ab12cd34ef56ab78"', "5927 2430 7427 3351 9"]
    for text in texts:
        bounds, ending = field.candidates(text, 0, len(text))
        starting = collections.defaultdict(list)
        for j, rows in ending.items():
            for i, kind, features in rows:
                starting[i].append((j, kind, field.score(features)))

        def every(at):
            if at == len(bounds) - 1:
                yield 0.0, ()
                return
            yield from every(at + 1)
            for j, kind, own in starting[at]:
                yield from ((own + rest, ((kind, bounds[at], bounds[j]), *spans)) for rest, spans in every(j))

        ways = list(every(0))
        best = max(total for total, _ in ways)
        chosen = field.decode(text, 0, len(text))
        assert math.isclose(best, next(total for total, spans in ways if list(spans) == chosen), abs_tol=1e-9)
        whole = sum(math.exp(total) for total, _ in ways)
        steps = field._gradient(bounds, ending, set())
        at = 0
        for j in ending:
            for i, kind, _ in ending[j]:
                share = sum(math.exp(total) for total, spans in ways if (kind, bounds[i], bounds[j]) in spans) / whole
                assert math.isclose(-steps[at][1], share, abs_tol=1e-9)
                at += 1


def test_pii_sample_does_not_hang_on_partitions(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    assert pii.sampled_regions(docs.repartition(7), "text", 50) == pii.sampled_regions(docs.coalesce(1), "text", 50)


def plain_logit(model, text):
    """The network word by word: embeddings, every filter at every place, the largest of each, a logistic unit."""
    found = [1 + zlib.crc32(w.encode()) % (toxicity.BUCKETS - 1) for w in re.findall(r"\w+", text.lower())] or [0]
    vectors = [model.embeddings[k].astype(float) for k in found] + [np.zeros(toxicity.DIM)] * toxicity.PADS
    pooled = []
    for bank in model.filters:
        for f in range(toxicity.FILTERS):
            pooled.append(max(sum(float(vectors[at + j] @ bank[j][:, f]) for j in range(len(bank))) for at in range(len(found))))
    hidden = [max(0.0, p + float(s)) for p, s in zip(pooled, model.shifts, strict=True)]
    return sum(h * float(o) for h, o in zip(hidden, model.out, strict=True)) + model.bias


def test_toxicity_by_a_plain_loop(spark, texts):
    docs, labels = (spark.read.parquet(f"{MORE}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train_classifier(docs, labels, id_col="doc_id", text_col="text", label_col="toxic", sample=300)
    some = sorted(texts.values(), key=len)[:60] + ["", "!", "one"]
    got = model.logits([toxicity.word_buckets(t) for t in some])
    for text, logit in zip(some, got, strict=True):
        assert math.isclose(logit, plain_logit(model, text), rel_tol=1e-3, abs_tol=1e-3)


def test_thresholds_are_calibrated_apart(spark, monkeypatch):
    """Each text's logit for the thresholds comes from a network that did not train on it."""
    taught = []

    def train(self, texts, labels):
        self.seen = {x.tobytes() for x in texts}
        taught.append(self.seen)

    def logits(self, texts):
        assert not self.seen & {x.tobytes() for x in texts}
        return np.arange(len(texts), dtype=float)

    monkeypatch.setattr(toxicity.ConvolutionalClassifier, "train", train)
    monkeypatch.setattr(toxicity.ConvolutionalClassifier, "logits", logits)
    docs, labels = (spark.read.parquet(f"{MORE}/{t}.parquet") for t in ("documents", "labels"))
    toxicity.train_classifier(docs.dropDuplicates(["text"]), labels, id_col="doc_id", text_col="text", label_col="toxic", sample=300)
    assert len(taught) == 1 + toxicity.PARTS and max(map(len, taught)) == len(taught[0])


def test_toxicity_on_the_held_out_fold(spark):
    table = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{table}/labels.parquet").collect()}
    rows = QUERIES["op6_toxicity"](spark, table).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for r in rows)
    apart = [r for r in rows if r.held_out and r.doc_id in labels]
    truth, said, score = (np.array(x) for x in zip(*((labels[r.doc_id], r.predicted, r.score) for r in apart)))
    assert np.mean(said == truth) > max(0.94, np.mean(truth == 0))
    assert np.mean(said[truth == 1]) > 0.75 and np.mean(truth[said == 1]) > 0.7
    above = (score[truth == 1][:, None] > score[truth == 0]).mean() + (score[truth == 1][:, None] == score[truth == 0]).mean() / 2
    print("toxicity held out", np.mean(said == truth), np.mean(said[truth == 1]), np.mean(truth[said == 1]), above)
    assert above > 0.92


def test_a_cut_is_never_below_the_constant_answer():
    rng = np.random.default_rng(2)
    for n, positive in ((12, 3), (70, 6), (300, 45)):
        labels = np.arange(n) < positive
        logits = rng.normal(size=n) + 0.3 * labels
        right = np.mean((logits >= toxicity.best_cut(logits, labels)[0]) == labels)
        assert right >= 1 - positive / n
    labels = np.r_[np.ones(50), np.zeros(50)]
    cut, sound = toxicity.best_cut(np.r_[np.full(50, 2.0), np.full(50, -2.0)], labels)
    assert -2 < cut <= 2 and sound


def test_labelled_documents_that_do_not_fit_are_passed_over(spark, monkeypatch):
    taught = []
    monkeypatch.setattr(toxicity, "trained", lambda texts, labels: taught.append(texts) or toxicity.ConvolutionalClassifier.fresh())
    docs = spark.createDataFrame([(k, "word " * (5000 if k % 3 == 0 else 10)) for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 0) for k in range(60)], "doc_id long, toxic int")
    toxicity.train_classifier(docs, labels, id_col="doc_id", text_col="text", label_col="toxic", sample=100, sample_bytes=4 * 12_000)
    sizes = sorted(map(len, taught[0]))
    assert sum(sizes) <= 12_000 and sizes.count(max(sizes)) == 2 and len(sizes) > 30


def test_quality_on_documents_not_taught(spark):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    taught, apart = labels.filter("doc_id % 5 <> 0"), {r.doc_id: r.quality for r in labels.filter("doc_id % 5 = 0").collect()}
    rows = quality.classify_quality(docs, taught, host=F.col("source"), path=F.col("lang")).filter("doc_id % 5 = 0").collect()
    known = [r for r in rows if r.doc_id in apart]
    assert np.mean([r.good == (apart[r.doc_id] == 1) for r in known]) > 0.98
    assert np.mean([r.good for r in known if apart[r.doc_id] == 1]) > 0.99


def test_quality_posteriors_by_a_plain_loop(spark):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{MORE}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels, host=F.col("source"), path=F.col("lang"))
    rows = docs.select("doc_id", "source", "lang", F.coalesce("text", F.lit("")).alias("text")).collect()
    sig, logit = (lambda x: 1 / (1 + math.exp(-x))), (lambda p: math.log(p / (1 - p)))
    own = {r.doc_id: sum(a * b for a, b in zip(quality.statistics(r.text), model.weights, strict=True)) for r in rows}
    good = {k: sig(x) for k, x in own.items()}
    sites, sections = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sites[r.source].append(good[r.doc_id])
        sections[r.source, r.lang].append(good[r.doc_id])
    mean = sum(good.values()) / len(good)
    assert math.isclose(model.mean, mean, rel_tol=1e-9)

    def strength(families):
        """Of groups around the mean of their family, which a group's own family is: the corpus or a site."""
        spread = free = even = 0.0
        for groups in families:
            n = sum(map(len, groups))
            center = sum(map(sum, groups)) / n
            spread += sum(len(g) * (sum(g) / len(g) - center) ** 2 for g in groups)
            free += len(groups) - 1
            even += n - sum(len(g) ** 2 for g in groups) / n
        between = (spread - free * mean * (1 - mean)) / even
        return min(1e4, max(1.0, mean * (1 - mean) / between - 1)) if between > 0 else 1e4

    site_prior = strength([list(sites.values())])
    section_prior = strength([[g for (s, _), g in sections.items() if s == site] for site in sites])
    assert math.isclose(model.host_prior, site_prior, rel_tol=1e-6) and math.isclose(model.path_prior, section_prior, rel_tol=1e-6)
    judged = {r.doc_id: r for r in quality.judge(docs, model, host=F.col("source"), path=F.col("lang"), text=F.coalesce("text", F.lit(""))).select("row.doc_id", "host_mean", "path_mean", "score", "good").collect()}
    clip = lambda p: min(1 - 1e-6, max(1e-6, p))
    for r in rows:
        site, section, g = sites[r.source], sections[r.source, r.lang], good[r.doc_id]
        host = clip((sum(site) - g + site_prior * mean) / (len(site) - 1 + site_prior))
        path = clip((sum(section) - g + section_prior * host) / (len(section) - 1 + section_prior))
        score = sig(own[r.doc_id] + logit(path) - logit(mean))
        got = judged[r.doc_id]
        assert math.isclose(got.host_mean, host, rel_tol=1e-6) and math.isclose(got.path_mean, path, rel_tol=1e-6) and math.isclose(got.score, score, rel_tol=1e-6, abs_tol=1e-9)
        assert got.good == (got.score >= 0.5)


def test_sections_shrink_to_their_own_site(spark):
    """Sites that differ, each of sections alike: the spread of the sites is none of the sections'."""
    from pyspark.sql import functions as F

    rows = [(f"h{h}", f"p{p}", 400, 400 * share) for h, share in enumerate((0.1, 0.5, 0.9)) for p in range(5)]
    sections = spark.createDataFrame(rows, "host string, path string, n long, total double").withColumn("host_n", F.lit(2000)).withColumn("host_total", 5 * F.col("total"))
    assert quality._strength(sections, 0.5, "n", "total", F.col("host_total") / F.col("host_n"), F.col("host_n"), 3) == quality.MOST_PRIOR
    hosts = sections.select("host", "host_n", "host_total").distinct()
    assert quality._strength(hosts, 0.5, "host_n", "host_total", F.lit(0.5), F.lit(6000), 1) < 2


def test_sparse_sites_shrink_to_the_mean(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    skewed = docs.withColumn("source", F.when(F.col("doc_id") < 3, F.concat(F.lit("tiny"), F.col("doc_id"))).otherwise("big"))
    model = quality.fit_quality(skewed, labels, host=F.col("source"), path=F.col("lang"))
    judged = quality.judge(skewed, model, host=F.col("source"), path=F.col("lang"), text=F.col("text")).collect()
    lone = [r for r in judged if r.host.startswith("tiny")]
    assert all(math.isclose(r.host_mean, model.mean, rel_tol=1e-6) for r in lone)  # nothing but the document itself is known


def test_raking_meets_given_marginals(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    text = F.col("text")
    share = lambda rows: spark.createDataFrame(rows, "value string, share double")
    sources = [r.source for r in docs.select("source").distinct().collect()]
    targets = {"source": share([(s, 1 / len(sources)) for s in sources]), "lang": share([("en", 0.4), ("fr", 0.3), ("de", 0.2), ("es", 0.1)]), "topic": share([("table", 0.1), ("reference", 0.1), ("note", 0.2), ("article", 0.5), ("treatise", 0.1)])}
    mixed = mixing.mix_documents(docs, source=F.col("source"), lang=F.col("lang"), topic=mixing.topic_of(text), tokens=mixing.token_count(text), targets=targets)
    by = {r.lang: r.w for r in mixed.groupBy("lang").agg(F.sum(F.col("tokens") * F.col("probability")).alias("w")).collect()}
    total = sum(by.values())
    assert {k: round(v / total, 3) for k, v in by.items()} == {"en": 0.4, "fr": 0.3, "de": 0.2, "es": 0.1}
    assert mixed.agg(F.max("probability")).first()[0] == 1.0


def plain_raking(cells, goals, sweeps, bounded, most=None):
    most = most or cells
    w = {k: float(v) for k, v in cells.items()}
    for _ in range(sweeps):
        for d in range(3):
            have = collections.Counter()
            for k, x in w.items():
                have[k[d]] += x
            w = {k: (x * goals[d][k[d]] / have[k[d]] if have[k[d]] else 0.0) for k, x in w.items()}
            if bounded:
                w = {k: min(x, most[k]) for k, x in w.items()}
    return w


@pytest.mark.parametrize("bounded", [False, True])
def test_raking_in_a_row_and_by_tables_equals_a_plain_loop(spark, monkeypatch, bounded):
    rng = np.random.default_rng(8)
    cells = {(None if s == 0 else f"s{s}", f"l{k}", f"t{t}"): int(rng.integers(0, 500)) for s in range(4) for k in range(3) for t in range(2) if rng.random() < 0.8}
    table = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens long")
    found = mixing.marginals(table, mixing.POWERS, None)
    if bounded:
        found = {name: mixing.within_reach(x, 0.75) for name, x in found.items()}
    goals = [{r.value: r.goal for r in found[name].collect()} for name in mixing.DIMENSIONS]
    # rounds of four sweeps end by the same rule in the loop and in both forms
    want, left = {k: float(v) for k, v in cells.items()}, math.inf
    for _ in range(3):
        want, before = plain_raking(want, goals, 4, bounded, cells), left
        left = max(abs(sum(x for k, x in want.items() if k[d] == value) / goal - 1) for d in range(3) for value, goal in goals[d].items() if goal > 0)
        if left < 1e-6 or (bounded and left > mixing.SLOW * before):
            break
    monkeypatch.setattr(mixing, "MOST_ROUNDS", 3)
    for few in (mixing.ONE_ROW_CELLS, 0):
        monkeypatch.setattr(mixing, "ONE_ROW_CELLS", few)
        raked, missed = mixing.rake(table, found, sweeps=4, bounded=bounded)
        got = {(r.source, r.lang, r.topic): r.raked for r in raked.collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)
        assert math.isclose(missed, left, rel_tol=1e-6, abs_tol=1e-12)


def test_targets_that_contradict_each_other_are_told(spark):
    """Two cells cannot meet 0.9 / 0.1 by source and 0.1 / 0.9 by language at once."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id long, s string, l string")
    share = lambda rows: spark.createDataFrame(rows, "value string, share double")
    for left, clash in (([("x", 0.1), ("y", 0.9)], True), ([("x", 0.9), ("y", 0.1)], False)):
        targets = {"source": share([("a", 0.9), ("b", 0.1)]), "lang": share(left), "topic": share([("t", 1.0)])}
        mixed = mixing.mix_documents(docs, source=F.col("s"), lang=F.col("l"), topic=F.lit("t"), tokens=F.lit(10), targets=targets).collect()
        assert all((r.miss > 0.5) if clash else (r.miss < 1e-6) for r in mixed)


def test_one_stray_cell_leaves_the_mixture_alone(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string"
    rows = [(k, f"a{k} " * (20 + k % 50), ("de", "en")[k % 3 > 0], ("s", "t", "u")[k % 7 % 3]) for k in range(1500)]
    rows += [(k, f"b{k} c, 123", "en", "t") for k in range(1500, 1700)]
    clean = spark.createDataFrame(rows, schema)
    stray = clean.union(spark.createDataFrame([(9999, "two words", None, "elsewhere")], schema))
    kept, mixed = ({r.doc_id for r in corpus_pipeline.mixing(spark, d, SF).collect()} for d in (clean, stray))
    assert 9999 in mixed and len(kept - mixed) < 0.01 * len(rows) and len(mixed) > 0.6 * len(rows)
    got = mixing.mix_corpus(stray).collect()
    total = sum(r.tokens for r in got)
    assert all(0 <= r.probability <= 1 for r in got)
    assert abs(sum(r.tokens * r.probability for r in got) / total - mixing.KEEP) < 1e-3


def plain_mixture(before):
    """The ids that the mixing stage keeps, from loops over the documents and cells."""
    rows = []
    for r in before.itertuples():
        text = r.text or ""
        form = "table" if " | " in text else "reference" if re.search("[0-9]{3}|@", text) else "note" if len(text) < 800 else "article" if len(text) < 4000 else "treatise"
        rows.append((r.doc_id, (r.source, r.lang, form), len(re.findall(mixing.WORDS, text))))
    cells = collections.Counter()
    for _, cell, n in rows:
        cells[cell] += n
    total, goals = sum(cells.values()), []
    for d, name in enumerate(mixing.DIMENSIONS):
        have = collections.Counter()
        for cell, n in cells.items():
            have[cell[d]] += n
        power = {k: n ** mixing.POWERS[name] if n else 0.0 for k, n in have.items()}
        goal = {k: x / sum(power.values()) * total for k, x in power.items()}
        low, high = 0.0, 1e6  # the scale at which capped goals sum to the wanted total
        for _ in range(200):
            scale = (low + high) / 2
            low, high = (scale, high) if sum(min(goal[k] * scale, have[k]) for k in have) < mixing.KEEP * total else (low, scale)
        goals.append({k: min(goal[k] * low, have[k]) for k in have})
    raked = plain_raking(cells, goals, 3000, True)
    kept = []
    for doc_id, cell, _ in rows:
        chance = round(raked[cell] / cells[cell], 9) if cells[cell] else 1.0
        if int(hashlib.md5(f"mix{doc_id}".encode()).hexdigest()[:13], 16) / float(1 << 52) < chance:
            kept.append(doc_id)
    return sorted(kept)


def test_pipeline_stages(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{MORE}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "mixing", "encoding"] and corpus_pipeline.ORACLE_SQL is None
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        docs = stage(spark, docs, MORE).cache()
        if name == "quality":
            labels = spark.read.parquet(f"{MORE}/labels.parquet")
            judged = quality.classify_quality(spark.createDataFrame(before), labels, host=F.col("source"), path=F.col("lang")).filter("good")
            assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted(r.doc_id for r in judged.collect())
        elif name == "exact_dedup":
            first = before.assign(t=before.text.fillna("").str.replace(r"[ \t-\r]+", " ", regex=True)).groupby("t").doc_id.min()
            assert sorted(r.doc_id for r in docs.collect()) == sorted(first)
        elif name == "near_dedup":
            plain = plain_components(dict(zip(before.doc_id, before.text.fillna(""))), 5, 80)
            assert sorted(r.doc_id for r in docs.collect()) == sorted(k for k, (n, c) in plain.items() if k == c)
        elif name == "mixing":
            assert sorted(r.doc_id for r in docs.collect()) == plain_mixture(before)
        if name != "encoding":
            assert docs.columns == columns
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = dict(zip(before.doc_id, before.text.fillna("")))
    rows = docs.collect()
    assert len(rows) == len(before)
    for row in rows:
        assert row.token_ids == library.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
