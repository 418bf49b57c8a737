"""Mixing sources to target weights by iterative proportional fitting, in DataFrame functions only.

Documents are summed up to cells (source, language, topic) of token counts. A sweep goes over
the three dimensions; an update scales the cells of each value to its target share, with
one aggregate that combines map-side and a join of its sums to the cells. The cells are
written after each update, so lineage stays short.
A document is drawn with a probability proportional to its cell's factor product; the largest
cell has probability 1 unless ``rate`` (share of all tokens) asks for fewer. The draw compares
an md5 of the id with the probability, so it does not depend on partitions or order.

Only (source, lang, topic, tokens) leaves the scan. The cell table has a row per combination
that occurs; joins with it are left to the optimizer, which broadcasts it below its
size limit and splits skewed keys otherwise.

Topic, where none is given, is the shape of the text: ``symbols``, ``list``, ``short``,
``prose``, ``long`` (see :func:`shape_topic`). Tokens, where none are given, are blanks and
line ends plus one.

Defined cases: a null dimension value is the value ``unknown``; a null or empty text has 0
tokens and topic ``empty``; a cell without tokens has multiplier 0 and is not drawn. Target
values that no document has are left out and the rest rescaled; values without a target
get 0. A null doc_id draws as the text ``null``. Repeated rows are drawn alike. An empty table gives an
empty result. Other columns are not read by :func:`mix` and are returned unchanged by
:func:`sample_mixture`.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerocal.llm.common import fresh, named
from aerocal.session import materialise

DIMENSIONS = ("source", "lang", "topic")


def words_estimate(text: Column) -> Column:
    """Blanks and line ends plus one; 0 for a null or empty text."""
    held = F.coalesce(text, F.lit(""))
    bare = F.replace(F.replace(held, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    return F.when(held == "", F.lit(0).cast("long")).otherwise(
        (F.length(held) - F.length(bare) + 1).cast("long")
    )


def shape_topic(text: Column, tokens: Column) -> Column:
    """A topic from the shape of a text.

    ``list``: a line end for each six tokens or fewer; ``symbols``: a percent, star, ampersand,
    dollar or number sign for each two tokens or fewer; else by length.
    """
    held = F.coalesce(text, F.lit(""))
    lines = F.length(held) - F.length(F.replace(held, F.lit("\n"), F.lit("")))
    bare = held
    for sign in "%*&$#":
        bare = F.replace(bare, F.lit(sign), F.lit(""))
    signs = F.length(held) - F.length(bare)
    return (
        F.when(held == "", "empty")
        .when(signs * 2 >= tokens, "symbols")
        .when((lines * 6 >= tokens) & (lines > 3), "list")
        .when(tokens < 100, "short")
        .when(tokens < 1000, "prose")
        .otherwise("long")
    )


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target shares of one dimension: (value, target) with share proportional to tokens ** power."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("n"))
    return sums.where("n > 0").select("value", F.pow(F.col("n").cast("double"), power).alias("target"))


def given(spark, shares: Mapping[str, float]) -> DataFrame:
    return spark.createDataFrame(list(shares.items()), "value string, target double")


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], sweeps: int = 6) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``multiplier`` = raked share / own share."""
    dims = list(targets)
    state = cells.where("tokens > 0").withColumn("weight", F.col("tokens").cast("double"))
    for d in dims:
        goal = targets[d].where("target > 0").select(F.col("value").alias(d), F.col("target").alias(f"share_{d}"))
        state = state.join(goal, d)
    state = materialise(state, "cells")
    wholes = state.select(*dims, *(f"share_{d}" for d in dims))
    for d in dims:  # targets of values that occur, as shares that sum to 1; one number each
        whole = wholes.groupBy(d).agg(F.max(f"share_{d}").alias("x")).agg(F.sum("x")).first()[0] or 1.0
        state = state.withColumn(f"share_{d}", F.col(f"share_{d}") / F.lit(whole))
    for _ in range(sweeps):
        for d in dims:
            sums = state.groupBy(d).agg(F.sum("weight").alias("reached")).where("reached > 0")
            raked = F.col("weight") * F.col(f"share_{d}") / F.col("reached")
            state = materialise(state.join(sums, d).withColumn("weight", raked).drop("reached"), "cells")
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()[0]  # one number
    reached = state.select(*dims, (F.col("weight") * float(total) / F.col("tokens")).alias("multiplier"))
    return cells.join(reached, dims, "left").select(
        *dims, "tokens", F.coalesce("multiplier", F.lit(0.0)).alias("multiplier")
    )


def _draw(ident: Column, seed: int) -> Column:
    """A number in [0, 1) from the id."""
    digits = F.md5(F.concat(F.coalesce(ident.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digits, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _described(
    docs: DataFrame, id_col: str, text_col: str, topic_col: str | None, tokens_col: str | None
) -> dict[str, Column]:
    text = named(text_col).cast("string")
    tokens = named(tokens_col).cast("long") if tokens_col else words_estimate(text)
    topic = named(topic_col).cast("string") if topic_col else shape_topic(text, tokens)
    unknown = F.lit("unknown")
    return {
        "ident": named(id_col).cast("long"), "tokens": F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(0)),
        "source": F.coalesce(named("source").cast("string"), unknown),
        "lang": F.coalesce(named("lang").cast("string"), unknown), "topic": F.coalesce(topic, unknown),
    }


def calibrated_cells(
    rows: DataFrame, powers: Mapping[str, float], targets: Mapping[str, DataFrame] | None = None,
    rate: float | None = None, sweeps: int = 6,
) -> DataFrame:
    """(source, lang, topic, multiplier, probability) for ``rows`` (source, lang, topic, tokens)."""
    cells = materialise(
        rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells"
    )
    goals = {
        d: targets[d] if targets and d in targets else tempered(cells, d, powers[d])
        for d in DIMENSIONS
    }
    raked = materialise(rake(cells, goals, sweeps), "raked")
    top = raked.agg(F.max("multiplier")).first()[0] or 1.0  # one number
    scale = 1 / top if rate is None else rate
    return raked.select(
        *DIMENSIONS, "multiplier", F.least(F.col("multiplier") * scale, F.lit(1.0)).alias("probability")
    )


POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.7}


def mix(
    docs: DataFrame, powers: Mapping[str, float] = POWERS,
    targets: Mapping[str, DataFrame] | None = None, rate: float | None = None, sweeps: int = 6,
    seed: int = 17, id_col: str = "doc_id", text_col: str = "text", topic_col: str | None = None,
    tokens_col: str | None = None,
) -> DataFrame:
    """One row per document: its cell, multiplier, probability and whether it is drawn."""
    parts = _described(docs, id_col, text_col, topic_col, tokens_col)
    rows = docs.select(*(c.alias(n) for n, c in parts.items()))
    cells = calibrated_cells(rows.drop("ident"), powers, targets, rate, sweeps)
    return rows.join(cells, list(DIMENSIONS)).select(
        F.col("ident").alias("doc_id"), *DIMENSIONS, "tokens", F.round("multiplier", 6).alias("multiplier"),
        F.round("probability", 6).alias("probability"),
        (_draw(F.col("ident"), seed) < F.col("probability")).alias("drawn"),
    )


def sample_mixture(
    docs: DataFrame, powers: Mapping[str, float] = POWERS,
    targets: Mapping[str, DataFrame] | None = None, rate: float | None = None, sweeps: int = 6,
    seed: int = 17, id_col: str = "doc_id", text_col: str = "text", topic_col: str | None = None,
    tokens_col: str | None = None,
) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their columns unchanged."""
    parts = _described(docs, id_col, text_col, topic_col, tokens_col)
    rows = docs.select(*(c.alias(n) for n, c in parts.items()))
    cells = calibrated_cells(rows.drop("ident"), powers, targets, rate, sweeps)
    names = {d: fresh(docs, f"row_{d}") for d in DIMENSIONS}
    chance = fresh(docs, "row_probability")
    marked = docs.withColumns({names[d]: parts[d] for d in DIMENSIONS})
    side = cells.select(*(F.col(d).alias(names[d]) for d in DIMENSIONS), F.col("probability").alias(chance))
    return (
        marked.join(side, list(names.values()))
        .where(_draw(parts["ident"], seed) < named(chance))
        .select(*(named(c) for c in docs.columns))
    )
