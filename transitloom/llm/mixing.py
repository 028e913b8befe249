"""Operator 1: mixing sources to target weights by iterative proportional fitting.

Tokens are summed by source, language and topic. The cells' weights are then raked: scaled
in turn so that their sums by source, by language and by topic meet the targets, until all
hold at once. A cell's calibrated rate is its raked weight over its tokens, and a document
is kept with the probability that its cell's rate has to the largest rate; so the kept
tokens meet every marginal in expectation and no document is repeated. The draw is a hash of
the id, hence the same in every run and for every partitioning.

That scale hangs on the one cell of the largest rate, however small. With a share of tokens
to keep, the raking is bounded instead: no cell's weight exceeds its tokens, a scarce cell is
kept whole, and the others meet what is left of the marginals of that stated total.

Everything is built-in functions. Documents are summed before they move; a cell is one row
however many documents it has, and the raking runs over cells alone: in one row of nested
arrays while source, language and topic make few cells, else by grouped sums whose ratios
are joined back. Targets that no cells can meet together leave a miss, which is returned.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import if_small, text_or_empty, written

DIMENSIONS = ("source", "lang", "topic")
#: The share of a marginal is tempered by this power, then normalised.
POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}
#: Raking sweeps between two looks at the marginals, in bounded raking, and the relative miss that ends them.
SWEEPS, BOUNDED_SWEEPS, TOLERANCE = 12, 60, 1e-6
#: Looks after which raking ends, whatever it misses.
MOST_ROUNDS = 25
#: Sources times languages times topics that are raked as one row.
ONE_ROW_CELLS = 200_000
#: The share of its tokens that the pipeline's mixture keeps.
KEEP = 0.75
#: Bounded raking ends where a round leaves more than this share of the last one's miss.
SLOW = 0.9
WORDS = r"[^\x20\x09-\x0D]+"
#: 13 hexadecimal digits of a digest, as a number in [0, 1).
DRAW_RANGE = float(1 << 52)


def token_count(text: Column) -> Column:
    """White-space words: the weight of a document before any vocabulary is chosen."""
    return F.regexp_count(text, F.lit(WORDS))


def topic_of(text: Column) -> Column:
    """A topic by rule, for corpora that name none: form first, then extent."""
    return (
        F.when(F.instr(text, " | ") > 0, "table")
        .when(text.rlike("[0-9]{3}|@"), "reference")
        .when(F.length(text) < 800, "note")
        .when(F.length(text) < 4000, "article")
        .otherwise("treatise")
    )


def draw(id_col: Column, seed: str) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(DRAW_RANGE)


def marginals(cells: DataFrame, powers: Mapping[str, float], targets: Mapping[str, DataFrame] | None) -> dict[str, DataFrame]:
    """For each dimension its values, their tokens and their target tokens: written tables (value, have, goal).

    Targets are shares to a power, normalised to all tokens, or given tables (value, share), in
    which values without a share get none.
    """
    total, found = cells.agg(F.sum("tokens").cast("double")).first()[0] or 0.0, {}
    for name in DIMENSIONS:
        sums = written(cells.groupBy(F.col(name).alias("value")).agg(F.sum("tokens").cast("double").alias("have")), "mix-sums")
        if targets:
            shares = targets[name].select(F.col("value").alias("of"), F.col("share").cast("double").alias("share"))
            goals = sums.join(shares, F.col("value").eqNullSafe(F.col("of")), "left").select("value", "have", (F.coalesce("share", F.lit(0.0)) * total).alias("goal"))
        else:
            power = F.when(F.col("have") > 0, F.pow("have", F.lit(float(powers[name])))).otherwise(0.0)
            norm = sums.agg(F.sum(power)).first()[0] or 1.0
            goals = sums.select("value", "have", (power / norm * total).alias("goal"))
        found[name] = written(goals, "mix-goals")
    return found


def within_reach(values: DataFrame, keep: float) -> DataFrame:
    """The values of a marginal with goals for ``keep`` of all tokens, none above what a value has.

    A value that has less than its goal is wanted whole; the others share what it lacks in
    proportion to their goals, so that every marginal sums to the same total.
    """
    total, scale = values.agg(F.sum("have")).first()[0] or 0.0, 0.0
    while True:
        whole = F.col("goal") * scale >= F.col("have")
        full, rest = values.agg(F.sum(F.when(whole, F.col("have"))), F.sum(F.when(~whole, F.col("goal")))).first()
        wider = (keep * total - (full or 0.0)) / rest if rest else scale
        if wider <= scale * (1 + 1e-12):
            return values.withColumn("goal", F.least(F.col("goal") * scale, F.col("have")))
        scale = wider


def rake(cells: DataFrame, goals: Mapping[str, DataFrame], *, sweeps: int = SWEEPS, tolerance: float = TOLERANCE, bounded: bool = False, rounds: int | None = None) -> tuple[DataFrame, float]:
    """(source, lang, topic, tokens, raked) of cells, and the largest relative miss of a marginal that is left.

    Rounds of sweeps go on until that miss is under the tolerance. Marginals that no cells can
    meet together stop after ``rounds`` (MOST_ROUNDS) rounds, at the best compromise; with ``bounded`` no
    cell's weight exceeds its tokens, and rounds also end once they gain little.
    """
    counts = [goals[name].count() for name in DIMENSIONS]
    made = _rake_grid if counts[0] * counts[1] * counts[2] <= ONE_ROW_CELLS else _rake_table
    return made(cells, goals, sweeps, tolerance, bounded, MOST_ROUNDS if rounds is None else rounds)


def _enough(missed: float, before: float, tolerance: float, bounded: bool) -> bool:
    return missed < tolerance or (bounded and missed > SLOW * before)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0.0), lambda t, x: t + x)


def _added(rows: Column, zeros: Column) -> Column:
    """The sum of rows of numbers, place by place."""
    return F.aggregate(rows, zeros, lambda t, row: F.zip_with(t, row, lambda a, b: a + b))


def _sums(grid: Column, zeros: Mapping[str, Column]) -> dict[str, Column]:
    lines = lambda plane: F.transform(plane, _total)
    return {
        "source": F.transform(grid, lambda plane: _total(lines(plane))),
        "lang": _added(F.transform(grid, lines), zeros["lang"]),
        "topic": _added(F.flatten(grid), zeros["topic"]),
    }


def _rescaled(grid: Column, name: str, ratios: Column) -> Column:
    if name == "source":
        return F.zip_with(grid, ratios, lambda plane, k: F.transform(plane, lambda line: F.transform(line, lambda x: x * k)))
    if name == "lang":
        return F.transform(grid, lambda plane: F.zip_with(plane, ratios, lambda line, k: F.transform(line, lambda x: x * k)))
    return F.transform(grid, lambda plane: F.transform(plane, lambda line: F.zip_with(line, ratios, lambda x, k: x * k)))


def _rake_grid(cells: DataFrame, goals: Mapping[str, DataFrame], sweeps: int, tolerance: float, bounded: bool, rounds: int) -> tuple[DataFrame, float]:
    """Raking over one row that holds a number for every source, language and topic, absent cells as zeros."""
    placed, lists = cells, {}
    for name in DIMENSIONS:
        # one row: the values in order and their goals
        lists[name] = written(goals[name].agg(F.array_sort(F.collect_list(F.struct("value", "goal"))).alias(name)), "mix-values")
        place = lists[name].select(F.posexplode(name).alias(f"at_{name}", "v")).select(f"at_{name}", F.col("v.value").alias("value"))
        placed = placed.join(F.broadcast(place), F.col(name).eqNullSafe(F.col("value"))).drop("value")  # at most ONE_ROW_CELLS values
    size = {name: goals[name].count() for name in DIMENSIONS}
    filled = lambda keyed, n, none: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.try_element_at(keyed, k), none))
    by_key = lambda key, value: F.map_from_entries(F.collect_list(F.struct(key, value)))
    lines = placed.groupBy("at_source", "at_lang").agg(by_key("at_topic", F.col("tokens").cast("double").alias("x")).alias("m"))
    lines = lines.select("at_source", "at_lang", filled(F.col("m"), size["topic"], F.lit(0.0)).alias("line")) if size["topic"] else lines
    if not all(size.values()):
        return cells.withColumn("raked", F.col("tokens").cast("double")), 0.0  # no cells
    planes = lines.groupBy("at_source").agg(by_key("at_lang", "line").alias("m"))
    planes = planes.select("at_source", filled(F.col("m"), size["lang"], F.array_repeat(F.lit(0.0), size["topic"])).alias("plane"))
    grid = planes.agg(F.transform(F.array_sort(F.collect_list(F.struct("at_source", "plane"))), lambda p: p["plane"]).alias("tokens")).withColumn("one", F.lit(1))
    for name in DIMENSIONS:  # single rows
        grid = grid.join(F.broadcast(lists[name].select(F.lit(1).alias("one"), F.transform(name, lambda v: v["goal"]).alias(name))), "one")
    grid = written(grid.withColumn("raked", F.col("tokens")), "mix-grid")

    zeros = {name: F.array_repeat(F.lit(0.0), size[name]) for name in DIMENSIONS}

    def step(grid: Column, name: str) -> Column:
        ratios = F.zip_with(F.col(name), _sums(grid, zeros)[name], lambda goal, have: F.when(have > 0, goal / have).otherwise(0.0))
        # the aggregate over one element names the ratios, so that they are computed once
        scaled = F.aggregate(F.array(ratios), grid, lambda own, r: _rescaled(own, name, r))
        if not bounded:
            return scaled
        least = lambda a, b: F.zip_with(a, b, lambda x, y: F.least(x, y))
        return F.zip_with(scaled, F.col("tokens"), lambda a, b: F.zip_with(a, b, least))

    def sweep(grid: Column, _: Column) -> Column:
        turn = lambda own, k: F.when(k == 0, step(own, "source")).when(k == 1, step(own, "lang")).otherwise(step(own, "topic"))
        return F.aggregate(F.array(F.lit(0), F.lit(1), F.lit(2)), grid, turn)

    sums = _sums(F.col("raked"), zeros)
    misses = [F.array_max(F.zip_with(F.col(name), sums[name], lambda goal, have: F.when(goal > 0, F.abs(have / goal - 1)).otherwise(0.0))) for name in DIMENSIONS]
    missed = float("inf")
    for _ in range(rounds):
        grid = written(grid.withColumn("raked", F.aggregate(F.sequence(F.lit(1), F.lit(sweeps)), F.col("raked"), sweep)), "mix-grid")
        before, missed = missed, grid.select(F.greatest(*misses)).first()[0]
        if _enough(missed, before, tolerance, bounded):
            break
    out = grid.select(F.posexplode("raked").alias("at_source", "plane")).select("at_source", F.posexplode("plane").alias("at_lang", "line")).select("at_source", "at_lang", F.posexplode("line").alias("at_topic", "raked"))
    return placed.join(F.broadcast(out), [f"at_{name}" for name in DIMENSIONS]).select(*DIMENSIONS, "tokens", "raked"), missed  # at most ONE_ROW_CELLS rows


def _rake_table(cells: DataFrame, goals: Mapping[str, DataFrame], sweeps: int, tolerance: float, bounded: bool, rounds: int) -> tuple[DataFrame, float]:
    """Raking of any number of cells: each step sums a marginal in a grouped aggregate and joins its few ratios back."""
    missed = float("inf")
    own = F.col("tokens").cast("double")
    cells = written(cells.withColumn("raked", own), "mix-cells")
    sums = lambda name: cells.groupBy(F.col(name).alias("of")).agg(F.sum("raked").alias("now")).join(if_small(goals[name], 64), F.col("of").eqNullSafe(F.col("value")))
    for _ in range(rounds):
        for _ in range(sweeps):
            for name in DIMENSIONS:
                ratio = F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(0.0)
                ratios = written(sums(name).select("of", ratio.alias("ratio")), "mix-ratios")
                raked = F.col("raked") * F.col("ratio")
                cells = cells.join(if_small(ratios, 64), F.col(name).eqNullSafe(F.col("of"))).withColumn("raked", F.least(raked, own) if bounded else raked).drop("of", "ratio")
            cells = written(cells, "mix-cells")
        miss = F.when(F.col("goal") > 0, F.abs(F.col("now") / F.col("goal") - 1))
        before, missed = missed, max(sums(name).agg(F.max(miss)).first()[0] or 0.0 for name in DIMENSIONS)
        if _enough(missed, before, tolerance, bounded):
            break
    return cells, missed


def mix_documents(docs: DataFrame, *, id_col: str = "doc_id", source: Column, lang: Column, topic: Column, tokens: Column, targets: Mapping[str, DataFrame] | None = None, powers: Mapping[str, float] = POWERS, seed: str = "mix", keep: float | None = None, tolerance: float = TOLERANCE, rounds: int | None = None) -> DataFrame:
    """(row, id, source, lang, topic, tokens, probability, kept, miss): ``row`` holds the input row as it was.

    Targets are tempered shares of the input's own tokens, or tables (value, share) for each
    of source, lang and topic. Null sources, languages and topics are values of their own.
    Documents of a cell without tokens, empty ones, are kept; those whose value has a share of
    zero are not. Rows of equal id share their draw. An empty table gives none. With ``keep`` the
    mixture holds that share of the tokens whatever the rarest cell's rate, and probabilities are
    those of bounded raking; without, the cell of the largest rate is kept whole and sets the scale.
    Raking ends under ``tolerance`` or after ``rounds``; ``miss`` is the largest relative miss of a marginal that it
    left, the same in all rows, and above the tolerance where the targets contradict each other.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(id_col).alias("id"), source.alias("source"), lang.alias("lang"), topic.alias("topic"), F.coalesce(tokens.cast("long"), F.lit(0).cast("long")).alias("tokens"))
    cells = written(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    goals = marginals(cells, powers, targets)
    if keep is None:
        raked, missed = rake(cells, goals, tolerance=tolerance, rounds=rounds)
    else:
        raked, missed = rake(cells, {name: written(within_reach(x, keep), "mix-goals") for name, x in goals.items()}, sweeps=BOUNDED_SWEEPS, tolerance=tolerance, bounded=True, rounds=rounds)
    rates = written(raked.withColumn("rate", F.when(F.col("tokens") > 0, F.col("raked") / F.col("tokens"))), "mix-rates")
    top = rates.agg(F.max("rate")).first()[0] if keep is None else 1.0
    rates = rates.select(*[F.col(d).alias(f"cell_{d}") for d in DIMENSIONS], F.when(F.col("tokens") > 0, F.round(F.col("rate") / F.lit(top), 9)).otherwise(1.0).alias("probability"))
    match = [F.col(d).eqNullSafe(F.col(f"cell_{d}")) for d in DIMENSIONS]
    found = rows.join(if_small(rates, 256), match[0] & match[1] & match[2], "left")
    return found.select("row", "id", *DIMENSIONS, "tokens", "probability", (draw(F.col("id"), seed) < F.col("probability")).alias("kept"), F.lit(missed).alias("miss"))


def mix_corpus(docs: DataFrame, keep: float | None = KEEP, rounds: int | None = None) -> DataFrame:
    """mix_documents with production parameters for tables shaped like ``documents``."""
    text = text_or_empty("text")
    return mix_documents(docs, source=F.col("source"), lang=F.col("lang"), topic=topic_of(text), tokens=token_count(text), keep=keep, rounds=rounds)


def _mix_sql() -> str:
    """One round of bounded raking over the cells, and what it misses."""
    tables = []
    for name in DIMENSIONS:
        power, by = f"pow(have, CAST({POWERS[name]} AS DOUBLE))", f"ORDER BY have / g, {name} ROWS UNBOUNDED PRECEDING"
        tables += [
            f"sum_{name} AS (SELECT {name}, CAST(sum(tokens) AS DOUBLE) AS have FROM cells GROUP BY {name})",
            f"wish_{name} AS (SELECT {name}, have, CASE WHEN have > 0 THEN {power} / sum(CASE WHEN have > 0 THEN {power} END) OVER () * sum(have) OVER () ELSE 0.0 END AS g FROM sum_{name})",
            # values before a row in the order of have / g are wanted whole, the others share what is left
            f"cut_{name} AS (SELECT have / g AS reach, ({KEEP} * sum(have) OVER () - (sum(have) OVER ({by}) - have)) / (sum(g) OVER () - (sum(g) OVER ({by}) - g)) AS scale FROM wish_{name} WHERE g > 0)",
            f"goal_{name} AS (SELECT {name}, least(g * coalesce((SELECT min_by(scale, reach) FROM cut_{name} WHERE scale <= reach), 1e300), have) AS g{name[0]} FROM wish_{name})",
        ]
    step = "SELECT * REPLACE (CASE WHEN sum(r) OVER (PARTITION BY {0}) > 0 THEN least(r * g{1} / sum(r) OVER (PARTITION BY {0}), tokens) ELSE 0.0 END AS r) FROM ({2})"
    sweep = "SELECT * FROM w WHERE k < {}".format(BOUNDED_SWEEPS)
    for name in DIMENSIONS:
        sweep = step.format(name, name[0], sweep)
    same = " AND ".join(f"rows.{d} IS NOT DISTINCT FROM rates.{d}" for d in DIMENSIONS)
    misses = ", ".join(f"coalesce((SELECT max(abs(now / g - 1)) FROM (SELECT sum(r) AS now, any_value(g{d[0]}) AS g FROM last GROUP BY {d}) WHERE g > 0), 0.0)" for d in DIMENSIONS)
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS x FROM documents),
rows AS (
  SELECT doc_id, source, lang, CAST(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens,
         CASE WHEN contains(x, ' | ') THEN 'table' WHEN regexp_matches(x, '[0-9]{{3}}|@') THEN 'reference'
              WHEN length(x) < 800 THEN 'note' WHEN length(x) < 4000 THEN 'article' ELSE 'treatise' END AS topic
  FROM d),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens) AS tokens FROM rows GROUP BY ALL),
{", ".join(tables)},
w AS (
  SELECT c.source, c.lang, c.topic, CAST(c.tokens AS DOUBLE) AS tokens, gs, gl, gt, CAST(c.tokens AS DOUBLE) AS r, 0 AS k
  FROM cells c JOIN goal_source s ON c.source IS NOT DISTINCT FROM s.source JOIN goal_lang l ON c.lang IS NOT DISTINCT FROM l.lang JOIN goal_topic t ON c.topic = t.topic
  UNION ALL SELECT * REPLACE (k + 1 AS k) FROM ({sweep})),
last AS MATERIALIZED (SELECT * FROM w WHERE k = {BOUNDED_SWEEPS}),
rates AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN round(r / tokens, 9) ELSE 1.0 END AS probability FROM last)
SELECT rows.doc_id, rows.source, rows.lang, rows.topic, rows.tokens, probability,
       CAST(CAST('0x' || substr(md5('mix' || coalesce(CAST(rows.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 < probability AS kept,
       round(greatest({misses}), 9) AS miss
FROM rows JOIN rates ON {same}
"""


MIX_SQL = _mix_sql()
