"""Mixing sources to target weights by iterative proportional fitting (raking).

Documents are measured once (tokens, topic) and summed to cells of source, language and topic. The cells'
token mass is scaled to the target share of each source, language and topic in turn, round after round,
until it settles. Where margins contradict one another it settles between them, and the largest error of a margin
is reported (margin_error). A cell's calibrated weight is its fitted mass over its own; a document is kept with
probability min(1, s * weight), where s makes the expected tokens the asked fraction of all, and the
decision is a hash of doc_id, so it is the same wherever the document lies.

The cells may be as many as sources times languages times topics, so they stay in Spark; the driver sees
scalars only. All of it is DataFrame code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import staged

MARGINS = ("source", "lang", "topic")
#: Share of all tokens that is kept, and the exponent that draws each margin's shares towards equality (1: as they are, 0: equal).
FRACTION, EXPONENT, SEED = 0.7, 0.7, "mix-1"
#: Raking stops when a round moves less than TOLERANCE of all mass, or after ROUNDS; steps of the search for s.
ROUNDS, TOLERANCE, STEPS = 200, 1e-9, 12
#: Rounds written out in the SQL, enough to settle the tables it is meant for.
SQL_ROUNDS = 24


def token_count(text: Column) -> Column:
    """Runs of characters other than [\\x20\\x09-\\x0D]; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic by markers in the whole text: legal notices, tables, settings and code, prose."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(low.contains("license") | low.contains("copyright") | low.contains("all rights reserved"), "legal")
        .when(low.contains(" | "), "tables")
        .when(low.contains(' = "') | low.contains("@") | low.contains("{"), "records")
        .otherwise("prose")
    )


def cell_keys(topic: Column | None = None) -> list[Column]:
    """Source, language and topic of a document; a null counts as empty. topic: a column of the caller's own instead of topic_of."""
    return [F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), (topic_of(F.col("text")) if topic is None else F.coalesce(topic, F.lit(""))).alias("topic")]


def tempered(cells: DataFrame, margin: str, exponent: float) -> DataFrame:
    """Target shares (margin, target) in proportion to a power of the margin's own token mass."""
    mass = cells.groupBy(margin).agg(F.sum("tokens").alias("m")).where("m > 0")
    return mass.select(margin, F.pow(F.col("m").cast("double"), F.lit(exponent)).alias("target"))


def wanted_shares(cells: DataFrame, targets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """targets (margin, target) of the values that have tokens, scaled to one, staged."""
    wanted = {}
    for margin, target in targets.items():
        there = target.join(cells.where("tokens > 0").select(margin).distinct(), margin)
        total = there.agg(F.sum("target")).first()[0] or 1.0
        wanted[margin] = staged(there.select(margin, (F.col("target") / total).alias("target")))
    return wanted


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (margins, tokens) with `mass`, whose margins have the shares of targets, as far as the cells that exist allow (see margin_error).

    targets: a table (margin, target) for each margin to be fitted; targets of values that no cell has are
    left out and the rest scaled to one. Values without a target keep no mass. Cells without tokens have mass 0.
    """
    wanted = wanted_shares(cells, targets)
    fitted = cells.withColumn("mass", F.col("tokens").cast("double"))
    for margin, target in wanted.items():
        fitted = fitted.join(target.withColumnRenamed("target", f"_{margin}"), margin, "left")
    fitted = staged(fitted)
    for _ in range(rounds):
        now = fitted.withColumn("was", F.col("mass"))
        for margin in wanted:
            # staged margin by margin, as a plan that sums what it also scales would double with every margin
            sums = now.groupBy(margin).agg(F.sum("mass").alias("_held"))
            factor = F.coalesce(F.when(F.col("_held") > 0, F.col(f"_{margin}") / F.col("_held")), F.lit(0.0))
            now = staged(now.join(sums, margin).withColumn("mass", F.col("mass") * factor).drop("_held"))
        fitted = now
        moved = fitted.agg(F.sum(F.abs(F.col("mass") - F.col("was")))).first()[0]
        if moved is None or moved < tolerance:
            break
    return fitted.select(*cells.columns, "mass")


def margin_error(fitted: DataFrame, targets: dict[str, DataFrame]) -> float:
    """The largest difference between the share of all mass that a value of a margin has and its target; 0 without cells."""
    total = fitted.agg(F.sum("mass")).first()[0] or 1.0
    sides = []
    for margin, target in wanted_shares(fitted, targets).items():
        sums = fitted.groupBy(margin).agg((F.sum("mass") / total).alias("share"))
        sides.append(sums.join(target, margin, "left").select(F.abs(F.col("share") - F.coalesce("target", F.lit(0.0))).alias("e")))
    return reduce(DataFrame.union, sides).agg(F.max("e")).first()[0] or 0.0


def probabilities(fitted: DataFrame, fraction: float = FRACTION, steps: int = STEPS) -> DataFrame:
    """fitted with `probability`: min(1, s * mass / tokens), and `fraction` where a cell has no tokens."""
    weight = F.col("mass") / F.col("tokens")
    weighed = fitted.where("tokens > 0").select("tokens", "mass", weight.alias("weight"))
    s = None
    for _ in range(steps):
        full = F.lit(False) if s is None else F.col("weight") * s >= 1
        sums = weighed.agg(F.sum("tokens").alias("all"), F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("mass"))).alias("open")).first()
        if not sums["all"] or not sums["open"]:
            break
        new = (fraction * sums["all"] - sums["full"]) / sums["open"]
        if new == s:
            break
        s = new
    return fitted.withColumn("probability", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), weight * F.lit(s or 0.0))).otherwise(F.lit(fraction)))


def chance(doc_id: Column, seed: str = SEED) -> Column:
    """A number from [0, 1) that depends on doc_id and the seed only; a null id counts as empty."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def plan_mix(measured: DataFrame, fraction: float = FRACTION, exponent: float = EXPONENT, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The cells (margins, tokens, docs, mass, probability, margin_error) of measured (margins, tokens)."""
    cells = staged(measured.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    targets = targets or {m: tempered(cells, m, exponent) for m in MARGINS}
    fitted = rake(cells, targets)
    return staged(probabilities(fitted, fraction).withColumn("margin_error", F.lit(margin_error(fitted, targets))))


def mix(docs: DataFrame, fraction: float = FRACTION, exponent: float = EXPONENT, targets: dict[str, DataFrame] | None = None, topic: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, tokens, probability, kept and margin_error (one number for all rows) a row of docs.

    Null sources and languages count as empty strings; null and empty texts have no tokens and are kept with
    probability `fraction`; rows that repeat a doc_id share the hash that decides; an empty table gives an
    empty table; other columns are ignored.
    """
    measured = staged(docs.select("doc_id", *cell_keys(topic), token_count(F.col("text")).alias("tokens")))
    cells = plan_mix(measured, fraction, exponent, targets).select(*MARGINS, "probability", "margin_error")
    return measured.join(cells, list(MARGINS)).select("doc_id", *MARGINS, "tokens", "probability", (chance(F.col("doc_id")) < F.col("probability")).alias("kept"), "margin_error")


def sampled(docs: DataFrame, fraction: float = FRACTION, exponent: float = EXPONENT, topic: Column | None = None) -> DataFrame:
    """The rows of docs that mix keeps, with docs' columns."""
    measured = staged(docs.select(*cell_keys(topic), token_count(F.col("text")).alias("tokens")))
    cells = plan_mix(measured, fraction, exponent).select(F.struct(*MARGINS).alias("cell"), F.col("probability").alias("p"))
    # docs' own columns stay in a struct, whatever their names
    marked = docs.select(F.struct(*docs.columns).alias("row"), F.struct(*cell_keys(topic)).alias("cell"), chance(F.col("doc_id")).alias("chance"))
    return marked.join(cells, "cell").where("chance < p").select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("probability", F.round("probability", 6)).drop("margin_error")


def op2_sql() -> str:
    """The same rows in SQL: the rounds of fitting and the steps of the search written out, one after another."""
    parts = [
        """m AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    CASE WHEN low LIKE '%license%' OR low LIKE '%copyright%' OR low LIKE '%all rights reserved%' THEN 'legal'
         WHEN low LIKE '% | %' THEN 'tables' WHEN low LIKE '% = "%' OR low LIKE '%@%' OR low LIKE '%{%' THEN 'records' ELSE 'prose' END AS topic,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS tokens
  FROM (SELECT *, lower(coalesce(text, '')) AS low FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents)))""",
        "w0 AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens, sum(tokens)::DOUBLE AS mass FROM m GROUP BY ALL)",
    ]
    for margin in MARGINS:
        parts.append(
            f"t_{margin} AS MATERIALIZED (SELECT {margin}, x / sum(x) OVER () AS target FROM (SELECT {margin}, power(sum(tokens), {EXPONENT}) AS x FROM w0 GROUP BY {margin} HAVING sum(tokens) > 0))"
        )
    last = "w0"
    for k in range(SQL_ROUNDS):
        for margin in MARGINS:
            name = f"w{k + 1}_{margin}"
            parts.append(
                f"{name} AS MATERIALIZED (SELECT source, lang, topic, tokens, mass * coalesce(CASE WHEN held > 0 THEN target / held END, 0) AS mass"
                f" FROM (SELECT *, sum(mass) OVER (PARTITION BY {margin}) AS held FROM {last}) LEFT JOIN t_{margin} USING ({margin}))"
            )
            last = name
    parts.append(f"s0 AS MATERIALIZED (SELECT {FRACTION} * sum(tokens) / sum(mass) AS s FROM {last} WHERE tokens > 0)")
    for k in range(1, STEPS):
        parts.append(
            f"s{k} AS MATERIALIZED (SELECT coalesce(({FRACTION} * sum(tokens) - coalesce(sum(tokens) FILTER (WHERE mass / tokens * s >= 1), 0)) / nullif(sum(mass) FILTER (WHERE mass / tokens * s < 1), 0), max(s)) AS s FROM {last}, s{k - 1} WHERE tokens > 0)"
        )
    parts.append(f"p AS MATERIALIZED (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN least(1.0, mass / tokens * s) ELSE {FRACTION} END AS probability FROM {last}, s{STEPS - 1})")
    chance_sql = f"('0x' || substr(md5('{SEED}:' || doc_id), 1, 8))::BIGINT / 4294967296.0"
    return f"WITH {', '.join(parts)} SELECT doc_id, source, lang, topic, tokens, round(probability, 6) AS probability, {chance_sql} < probability AS kept FROM m JOIN p USING (source, lang, topic)"
