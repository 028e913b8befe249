"""Every corpus operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from transitloom.llm import bpe, exact_dedup, fingerprints, mixing, near_dedup, pii, quality, token_counts, toxicity, url_filters

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n string, key string, fp string, kept boolean, score string, spans string, bucket int, row string, tokens int, size int, node int, page boolean, host string, path string, stack string"
LONG = "wörd " * 4000 + "x" * 30000
ROWS = [(1, None), (2, ""), (3, "same text here once more"), (4, "same  text\there once more"), (5, LONG), (6, "a<|endoftext|>b  \n c"), (6, "a<|endoftext|>b  \n c"), (None, "no id"), (7, "mail a.b@c.de or +49 (30) 1234567"), (8, " \t\n "), (9, "0" * 5000), (10, "@" * 2000 + "é" * 3)]


@pytest.fixture(scope="module")
def docs(spark):
    rest = [None] * 2
    rows = [(k, t, None if k == 3 else "en", None if k == 4 else "src", *rest, "9", *[None] * 14) for k, t in ROWS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 11)] + [(None, 1, 1), (3, None, None), (3, 0, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")


def runs(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


OPERATORS = {
    "count_tokens": lambda d, lb: token_counts.count_tokens(d),
    "encode_texts": lambda d, lb: bpe.encode_texts(d),
    "find_copies": lambda d, lb: exact_dedup.find_copies(d),
    "fingerprint_edits": lambda d, lb: fingerprints.fingerprint_edits(d),
    "find_near_copies": lambda d, lb: near_dedup.find_near_copies(d),
    "find_private": lambda d, lb: pii.find_private(d),
    "classify_quality": lambda d, lb: quality.classify_quality(d, lb, host=F.col("source"), path=F.col("lang")),
    "score_toxicity": lambda d, lb: toxicity.score_toxicity(d, lb),
    "mix_corpus": lambda d, lb: mixing.mix_corpus(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row_and_none_of_none(name, docs, labels):
    made = OPERATORS[name](docs, labels)
    assert made.count() == len(ROWS)
    empty = OPERATORS[name](docs.filter("false"), labels)
    assert empty.columns == made.columns and empty.count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_do_not_hang_on_partitions(name, docs, labels):
    assert runs(OPERATORS[name](docs, labels)) == runs(OPERATORS[name](docs.coalesce(1), labels))


@pytest.mark.parametrize("name", ["classify_quality", "score_toxicity"])
def test_without_labels(name, docs, labels):
    assert OPERATORS[name](docs, labels.filter("false")).count() == len(ROWS)


def test_exact_copies(docs):
    got = {(r.doc_id): r for r in exact_dedup.find_copies(docs).collect()}
    assert got[1].keep_id == got[2].keep_id == 1 and got[2].group_size == 2 and not got[2].kept and got[1].kept
    assert got[4].keep_id == 3 and got[8].keep_id == 8
    assert got[6].group_size == 2 and got[6].kept
    assert got[None].kept and got[None].group_size == 1


def test_near_copies_without_words(docs):
    got = {r.doc_id: r for r in near_dedup.find_near_copies(docs).collect()}
    assert [got[k].n_shingles for k in (1, 2, 8)] == [0, 0, 0] and all(got[k].kept for k in (1, 2, 8, None))
    assert got[3].component_id == got[4].component_id == 3 and not got[4].kept
    assert got[None].component_id is None and got[7].n_shingles == 2


def test_mixing_keeps_what_has_no_tokens(docs):
    got = {r.id: r for r in mixing.mix_corpus(docs).collect()}
    assert got[1].tokens == 0 and 0 <= got[1].probability <= 1 and got[3].lang is None and got[4].source is None


def test_url_filters(spark):
    schema = "page_id long, url string, host string, key string, page boolean, salt int, stack string"
    urls = [(1, None), (2, "no scheme"), (3, "http://A.Example.NET/en/x?q#f"), (4, "x://example.net/fr"), (5, "https://org/fr/1"), (6, "https://org"), (None, "https://b.example.com/de/"), (7, "https://example.community/de/"), (8, "http://net/http://org/fr/"), (8, "http://net/http://org/fr/")]
    pages = spark.createDataFrame([(k, u, *[None] * 5) for k, u in urls], schema)
    got = sorted(map(tuple, url_filters.filter_urls(pages, url_filters.rule_table(spark, url_filters.RULES)).collect()), key=repr)
    assert got == sorted(
        [
            (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.net", "/en/x", "example.net/en/", "allow"), (4, "example.net", "/fr", "net/", "block"),
            (5, "org", "/fr/1", "org/fr/", "allow"), (6, "org", "", None, "allow"), (None, "b.example.com", "/de/", "example.com/de/", "block"), (7, "example.community", "/de/", None, "allow"),
            (8, "net", "/http://org/fr/", "net/", "block"), (8, "net", "/http://org/fr/", "net/", "block"),
        ],
        key=repr,
    )
    none = url_filters.rule_table(spark, url_filters.RULES).filter("false")
    assert {r.verdict for r in url_filters.filter_urls(pages, none).collect()} == {"allow"}
    assert url_filters.filter_urls(pages.filter("false"), none).count() == 0
    odd = url_filters.rule_table(spark, [("block", "", "/"), ("block", "c.org", "/"), ("allow", "c.org", "/"), ("allow", "b.c.org", "/x"), ("block", "c-x.org", "/")])
    more = spark.createDataFrame([(1, "http://c.org/"), (2, "http://a.b.c.org/x"), (3, "http://a.b.c.org/y"), (4, "http://d.org/"), (5, "http://c-x.org/"), (6, "http://cc.org/")], "page_id long, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in url_filters.filter_urls(more, odd).collect()} == {1: ("c.org/", "block"), 2: ("b.c.org/x", "allow"), 3: ("c.org/", "block"), 4: (None, "allow"), 5: ("c-x.org/", "block"), 6: (None, "allow")}


@pytest.mark.parametrize("n_rules", [3, 200])
def test_url_filters_by_a_plain_loop(spark, n_rules):
    """Few rules take many salts, more rules than pages take one; the verdicts are those of a loop."""
    hosts = ["com", "a.com", "b.a.com", "c.b.a.com", "ab.com", "org", "a.org"]
    paths = ["/", "/x", "/x/y", "/x/y/z", "/q", ""]
    rules = sorted({("block" if k % 3 else "allow", hosts[k % 7], paths[k * 5 % 6]) for k in range(n_rules)})
    pages = [(k, f"http://{hosts[k * 3 % 7]}{paths[k % 6]}{k % 4}") for k in range(120)]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), url_filters.rule_table(spark, rules)).collect()}
    for number, url in pages:
        host, slash, path = url[7:].partition("/")
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and (slash + path).startswith(p)]
        assert got[number] == (max(fits)[1:] if fits else (None, "allow"))


@pytest.fixture(scope="module")
def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


STAGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pipeline_row long, doc string, id string, row int, kept boolean, place int, component_id long"


def stage_table(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", None, 7, "x", "y", 1, True, 2, 3) for k, t in rows], STAGE_SCHEMA).repartition(3)


@pytest.mark.parametrize("name", ["quality", "exact_dedup", "near_dedup", "mixing", "encoding"])
def test_stages_take_odd_rows_and_empty_tables(name, spark, stages, tmp_path):
    rows = stage_table(spark, [*ROWS, (None, None), (None, "no id"), (6, "another text of the same id")])
    spark.createDataFrame([(1, 1), (2, 0), (6, 1), (None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    made = stages[name](spark, rows, str(tmp_path))
    assert made.count() <= rows.count() and (name == "encoding" or made.columns == rows.columns)
    none = stages[name](spark, rows.filter("false"), str(tmp_path))
    assert none.count() == 0 and none.columns == made.columns


@pytest.mark.parametrize("name", ["exact_dedup", "near_dedup"])
def test_one_row_of_each_group_stays_whatever_its_id(name, spark, stages):
    """Repeated ids with other texts, repeated rows, and rows without an id."""
    one, two, three = ("alpha beta gamma delta epsilon zeta eta", "one two three four five six seven", "red orange yellow green blue indigo violet")
    rows = [(6, one), (6, two), (5, two), (7, three), (7, three), (None, one), (None, "lone words without any id at all"), (None, "lone words without any id at all"), (8, None), (9, "")]
    got = sorted(((r.doc_id, r.text) for r in stages[name](spark, stage_table(spark, rows), "").collect()), key=repr)
    want = [(6, one), (5, two), (7, three), (None, "lone words without any id at all"), (8, None)] + [(9, "")] * (name == "near_dedup")
    assert got == sorted(want, key=repr)


def test_near_copies_of_repeated_ids_share_a_component(spark):
    """Two texts of one id are one document, for which the one of the smaller set digest stands."""
    one, two = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight"
    docs = stage_table(spark, [(6, one), (6, two), (6, two), (5, one), (4, two)])
    got = {(r.doc_id, r.component_id) for r in near_dedup.find_near_copies(docs).collect()}
    assert len({c for k, c in got if k == 6}) == 1 and got - {(6, 4), (6, 5)} == {(5, 5), (4, 4)}
    assert runs(near_dedup.find_near_copies(docs)) == runs(near_dedup.find_near_copies(docs.coalesce(1)))


def test_joins_deal_a_hot_key_over_tasks(spark, monkeypatch):
    from transitloom.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "HOT", 10)
    rows = spark.range(400).select("id", F.when(F.col("id") < 300, 1).otherwise(F.col("id")).alias("k"))
    info = common.written(rows.groupBy("k").agg(F.count("*").alias("n")).filter("k <> 350"), "test-info")
    dealt = common.join_dealt(rows, info, "k", "n", 16, ["id"], "left")
    assert runs(dealt.select("id", "k", "n")) == runs(rows.join(info, "k", "left").select("id", "k", "n"))


def test_very_many_path_rules_of_one_host(spark):
    """5,000 nested and neighbouring paths of a host beside rules of the hosts around it: all pages as a plain loop judges them, and no row holds the rules."""
    import random

    rng = random.Random(12)
    rules = {("x.org", "/" + "/".join(f"d{rng.randrange(9)}" for _ in range(rng.randrange(1, 7))) + rng.choice(["", "/", "é", "~"])) for _ in range(9000)}
    rules = [(rng.choice(["block", "allow"]), h, p) for h, p in sorted(rules)[:5000]] + [("block", "org", "/d1"), ("allow", "a.x.org", "/d1/d"), ("block", "x.org", ""), ("allow", "b.a.x.org", "/")]
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    pages = [(k, f"http://{rng.choice(['x.org', 'a.x.org', 'b.a.x.org', 'c.b.a.x.org', 'y.org', 'xx.org', 'org'])}/" + "/".join(f"d{rng.randrange(9)}" for _ in range(rng.randrange(1, 8))) + rng.choice(["", "/", "é", "~z", "?q"])) for k in range(3000)]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), table).collect()}
    by_host = {}
    for verdict, host, path in rules:
        by_host.setdefault(host, {})[path] = max(verdict, by_host.get(host, {}).get(path, ""))
    for k, url in pages:
        host, path = url[7:].split("/", 1)
        path, labels = "/" + path.split("?")[0], host.split(".")
        fits = [(len(h + path[:n]), h + path[:n], by_host[h][path[:n]]) for h in (".".join(labels[i:]) for i in range(len(labels))) if h in by_host for n in range(len(path) + 1) if path[:n] in by_host[h]]
        assert got[k] == (max(fits)[1:] if fits else (None, "allow")), url
    named = table.selectExpr("host AS at", "path", "length(concat(host, path)) AS size", "concat(host, path) AS rule", "verdict")
    assert url_filters._path_events(named).schema["top"].dataType.simpleString().startswith("struct")  # one rule, not all


def test_mixing_sql_keeps_nulls_and_empty_texts(docs):
    """The twin judges null sources, languages and ids, empty and very long texts and repeated rows as the query does."""
    import duckdb

    rows = docs.select("doc_id", "text", "lang", "source").toPandas()
    con = duckdb.connect()
    con.register("given", rows)
    con.execute("CREATE VIEW documents AS SELECT CAST(doc_id AS BIGINT) AS doc_id, text, lang, source FROM given")
    made = con.execute(mixing.MIX_SQL)
    names = [c[0] for c in made.description]
    mixed = mixing.mix_corpus(docs, rounds=1).withColumn("doc_id", F.col("id")).withColumn("miss", F.round("miss", 9)).select(*names)
    assert runs(mixed) == sorted(map(tuple, made.fetchall()), key=repr)
