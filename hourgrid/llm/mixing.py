"""Mixing to target weights by iterative proportional fitting (raking), in DataFrame operations only.

Token weights of the cells (source, language, topic) are scaled in turn to the target share of every source, language and
topic, until all marginals hold. A document of a cell is then drawn with a probability in proportion to the cell's
calibrated over its observed weight, by a hash of its id.

Bounded raking keeps every cell within what it holds: a cell that would need a probability over 1 is taken whole and the
others make up for it, so the wanted part of all tokens is reached whatever the rarest cell is. Without the bound (the
definition of the SQL counterpart) all probabilities shrink until the highest is 1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.llm.common import text_or_empty, unique_name
from hourgrid.session import staged

DIMENSIONS = ("source", "lang", "topic")
#: Rounds over all dimensions, and rounds planned at once.
ROUNDS, AT_ONCE = 24, 3
#: Target shares are observed shares to this power: below 1, large sources give way to small ones.
FLATTEN = 0.75
#: Part of all tokens that is wanted.
FRACTION = 0.6

# Topics by what a text holds, the first that fits; patterns mean the same to Spark and to SQL engines.
TOPICS = (
    ("legal", r"(?i)licen[sc]e|copyright|all rights reserved"),
    ("contact", r"[A-Za-z0-9._-]@[A-Za-z0-9-]+[.][A-Za-z]|[0-9]{3}[ -][0-9]{3,4}"),
    ("tabular", r" [|] "),
    ("technical", r"[A-Za-z0-9_]{24}|[{}<>=;]{2}"),
)
GENERAL = "general"


def topic(text: str = "text", rules: Sequence[tuple[str, str]] = TOPICS) -> Column:
    t = text_or_empty(text)
    return F.coalesce(*[F.when(F.regexp_like(t, F.lit(p)), F.lit(n)) for n, p in rules], F.lit(GENERAL))


def tokens(text: str = "text") -> Column:
    """Runs of characters other than ASCII white space; at least 1, so that every document has a weight."""
    return F.greatest(F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("long")


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) of every row; null values of a dimension are the value ''."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.coalesce(F.col(d).cast("string"), F.lit("")).alias(d) for d in ("source", "lang")], topic().alias("topic"), tokens().alias("tokens"))


def cells_of(rows: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    return rows.groupBy(*dimensions).agg(F.sum("tokens").alias("observed"))


def flattened(cells: DataFrame, dimension: str, power: float = FLATTEN) -> DataFrame:
    """Target shares (dimension, target): observed ones to a power, scaled to 1."""
    shares = cells.groupBy(dimension).agg(F.pow(F.sum("observed").cast("double"), F.lit(power)).alias("raised"))
    return shares.crossJoin(shares.agg(F.sum("raised").alias("whole"))).select(dimension, (F.col("raised") / F.col("whole")).alias("target"))  # the whole is one row


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, at_once: int = AT_ONCE) -> DataFrame:
    """Cells with their calibrated ``weight`` (shares of 1), after so many rounds over the dimensions.

    A target without a cell cannot be met, a cell without a target keeps no weight; the other targets of the dimension
    then hold in proportion. Some rounds are planned at once, then written to the shared folder.
    """
    whole = cells.agg(F.sum("observed").cast("double").alias("whole"))
    table = cells.crossJoin(whole).withColumn("weight", F.col("observed") / F.col("whole")).drop("whole")  # the whole is one row
    for d, shares in targets.items():
        table = table.join(shares.select(d, F.col("target").alias(f"to_{d}")), d, "left").fillna(0.0, [f"to_{d}"])
    table = staged(table)
    for done in range(1, rounds + 1):
        for d in targets:
            now = F.sum("weight").over(Window.partitionBy(d))
            table = table.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"to_{d}") / now).otherwise(0.0))
        if done % at_once == 0 or done == rounds:
            table = staged(table)
    return table.drop(*[f"to_{d}" for d in targets])


def rates(cells: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """Adds ``rate``, the probability to draw a document of the cell.

    It is in proportion to weight over observed tokens and gives ``fraction`` of all tokens, or fewer: no rate is cut
    off at 1, which would bend the shares.
    """
    ratio = F.col("weight") / F.col("observed")
    ends = cells.agg(F.sum("observed").cast("double").alias("whole"), F.max(ratio).alias("most"))
    scale = F.least(F.lit(fraction) * F.col("whole"), 1 / F.col("most"))
    return cells.crossJoin(ends).withColumn("rate", F.coalesce(F.least(F.lit(1.0), ratio * scale), F.lit(0.0))).drop("whole", "most")  # the ends are one row


def within(shares: DataFrame) -> DataFrame:
    """Target shares scaled to 1 with none above its ``cap``: those that would pass it are set to it, the rest make up for them."""
    scale = 0.0
    while True:
        # A row of two numbers for each pass; the scale only rises, so the rows at their cap only become more.
        at = F.lit(scale) * F.col("target") >= F.col("cap")
        full, rest = shares.agg(F.sum(F.when(at, F.col("cap")).otherwise(0.0)), F.sum(F.when(at, 0.0).otherwise(F.col("target")))).first()
        if not rest or (now := max(0.0, 1.0 - full) / rest) <= scale * (1 + 1e-12):
            break
        scale = now
    whole = F.col("cap") if not rest else F.least(F.col("cap"), F.lit(scale) * F.col("target"))
    return shares.withColumn("target", whole)


def rake_within(cells: DataFrame, targets: dict[str, DataFrame], fraction: float = FRACTION, rounds: int = ROUNDS, at_once: int = AT_ONCE) -> DataFrame:
    """Cells with ``rate``, the probability to draw a document: ``fraction`` of all tokens, no cell above what it holds.

    A cell's weight is the lesser of its ``cap`` (all its tokens) and of ``free``, its observed weight times a factor for
    each of its values. A factor is such that the weights of the value give its target, with cells at their cap counted as
    such: cells in the order of cap / free reach it one after the other. Targets above what a value holds are set to that,
    the others of the dimension make up for them. Where cells keep targets of several dimensions from holding together,
    those of the last one hold.
    """
    part = min(float(fraction), 1.0)
    whole = cells.agg(F.sum("observed").cast("double").alias("whole"))
    table = cells.crossJoin(whole).withColumn("cap", F.col("observed") / (F.lit(part) * F.col("whole"))).drop("whole")  # the whole is one row
    table = staged(table.withColumn("free", F.col("cap")))
    for d, shares in targets.items():
        held = table.groupBy(d).agg(F.sum("cap").alias("cap"))
        table = table.join(within(staged(held.join(shares, d))).select(d, F.col("target").alias(f"to_{d}")), d, "left").fillna(0.0, [f"to_{d}"])
    table = staged(table)
    for done in range(1, rounds + 1):
        for d in targets:
            group, others = Window.partitionBy(d), [c for c in targets if c != d]
            before = group.orderBy("order", *others).rowsBetween(Window.unboundedPreceding, -1)
            behind = group.orderBy(F.desc("order"), *[F.desc(c) for c in others]).rowsBetween(Window.unboundedPreceding, 0)
            to = F.col(f"to_{d}")
            table = table.withColumn("order", F.col("cap") / F.col("free"))
            table = table.withColumn("before", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("behind", F.sum("free").over(behind))
            table = table.withColumn("full", to - F.col("before") >= F.col("order") * F.col("behind") * (1 - 1e-12))
            full, rest = (F.sum(F.when(F.col("full") == x, F.col(c)).otherwise(0.0)).over(group) for x, c in ((True, "cap"), (False, "free")))
            factor = F.when(rest > 0, F.greatest(to - full, F.lit(0.0)) / rest).otherwise(F.max("order").over(group))
            table = table.withColumn("factor", factor)
            # Far from what a table holds: keeps factors of targets that exclude each other from running out of the doubles.
            table = table.withColumn("free", F.greatest(F.least(F.col("free") * F.col("factor"), F.lit(1e150)), F.lit(1e-150))).drop("order", "before", "behind", "full", "factor")
        if done % at_once == 0 or done == rounds:
            table = staged(table)
    return table.withColumn("rate", F.least(F.lit(1.0), F.col("free") / F.col("cap"))).drop("cap", "free", *[f"to_{d}" for d in targets])


def draw(key: str = "doc_id", seed: int = 11) -> Column:
    """A number in [0, 1) for each id, the same in every run: the first 52 bits of a digest."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def calibrated(rows: DataFrame, fraction: float, rounds: int, power: float, bounded: bool = True) -> DataFrame:
    """(source, lang, topic, rate) of all cells, written: below the session's bound it is broadcast, else joined by key."""
    cells = staged(cells_of(rows))
    targets = {d: flattened(cells, d, power) for d in DIMENSIONS}
    fitted = rake_within(cells, targets, fraction, rounds) if bounded else rates(rake(cells, targets, rounds), fraction)
    return staged(fitted.select(*DIMENSIONS, "rate"))


def mix(docs: DataFrame, fraction: float = FRACTION, rounds: int = ROUNDS, power: float = FLATTEN, bounded: bool = True) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, rate, chosen) of every row.

    Rows with one id, repeated or null, are drawn alike. An empty table gives no rows.
    """
    rows = staged(described(docs))  # texts are read once
    return rows.join(calibrated(rows, fraction, rounds, power, bounded), list(DIMENSIONS)).withColumn("chosen", draw() < F.col("rate"))


def sample(docs: DataFrame, fraction: float = FRACTION, rounds: int = ROUNDS, power: float = FLATTEN, bounded: bool = True) -> DataFrame:
    """The rows of ``docs`` that ``mix`` chooses, with their columns."""
    table = calibrated(described(docs), fraction, rounds, power, bounded)
    own = {d: unique_name(docs, f"_{d}") for d in (*DIMENSIONS, "rate")}
    table = table.select(*[F.col(d).alias(n) for d, n in own.items()])
    values = {own[d]: F.coalesce(F.col(d).cast("string"), F.lit("")) for d in ("source", "lang")} | {own["topic"]: topic()}
    met = docs.withColumns(values).join(table, [own[d] for d in DIMENSIONS])
    return met.where(draw() < F.col(own["rate"])).select(*docs.columns)


def oracle_ctes(fraction: float = FRACTION, rounds: int = ROUNDS, power: float = FLATTEN) -> str:
    """The same in SQL, as table expressions ``mix_rows`` and ``mix_rates`` over ``mix_docs`` (doc_id, text, source, lang)."""
    cases = " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in TOPICS)
    out = [
        f"mix_rows AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE {cases} ELSE '{GENERAL}' END AS topic, greatest(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')), 1) AS tokens FROM mix_docs)",
        "mix_cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS observed FROM mix_rows GROUP BY ALL)",
    ]
    for d in DIMENSIONS:
        out.append(f"to_{d} AS MATERIALIZED (SELECT {d}, raised / sum(raised) OVER () AS target FROM (SELECT {d}, pow(sum(observed)::DOUBLE, {power}) AS raised FROM mix_cells GROUP BY {d}))")
    out.append("w0 AS MATERIALIZED (SELECT *, observed / (sum(observed) OVER ())::DOUBLE AS weight FROM mix_cells)")
    steps = [d for _ in range(rounds) for d in DIMENSIONS]
    for n, d in enumerate(steps, 1):
        out.append(f"w{n} AS MATERIALIZED (SELECT source, lang, topic, observed, weight * target / sum(weight) OVER (PARTITION BY {d}) AS weight FROM w{n - 1} JOIN to_{d} USING ({d}))")
    out.append(f"mix_rates AS MATERIALIZED (SELECT source, lang, topic, least(1.0, weight / observed * least({fraction} * sum(observed) OVER (), 1 / max(weight / observed) OVER ())) AS rate FROM w{len(steps)})")
    return ", ".join(out)


def oracle_draw(seed: int = 11) -> str:
    return f"('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::UBIGINT / {float(1 << 52)}::DOUBLE"


