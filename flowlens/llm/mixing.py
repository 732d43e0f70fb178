"""Mixing sources to target weights by iterative proportional fitting.

Token counts by cell (source, language, topic) are raked: scaled to one set of
target marginals after the other until all hold. A cell's factor over its tokens
is its calibration weight; documents are drawn by probabilities proportional to it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import checkpointed

DIMS = ("source", "lang", "topic")
#: Cells that are raked on the driver; more are raked as a table.
DRIVER_CELLS = 100_000
#: Sweeps over all dimensions, at most, and the marginal error that ends them.
SWEEPS, ERROR = 100, 1e-9
MISSING = "(none)"


def n_words(text: Column) -> Column:
    """Spaces and line feeds of a text, plus one: its length in words, near enough for a weight."""
    return F.when(F.length(text) > 0, 1 + 2 * F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).otherwise(0)


def topic(text: Column) -> Column:
    """What kind of page a text is, by its layout."""
    lines = 1 + F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return F.when(bars * 40 >= F.greatest(F.length(text), F.lit(1)), "table").when(F.length(text) >= 4000, "article").when(F.length(text) < 60 * lines, "list").otherwise("prose")


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """(dim, target): each value's share of all tokens, raised to ``power`` and normalised."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("tokens")).where("tokens > 0")
    raised = sums.select(dim, F.pow("tokens", F.lit(power)).alias("target"))
    total = raised.agg(F.sum("target")).first()[0] or 1.0
    return raised.select(dim, (F.col("target") / F.lit(float(total))).alias("target"))


def rake(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], sweeps: int = SWEEPS, error: float = ERROR) -> np.ndarray:
    """``tokens`` scaled so that its sums by each of ``codes`` are ``targets``, as far as they can be."""
    x = tokens / max(tokens.sum(), 1e-300)
    for _ in range(sweeps):
        off = 0.0
        for code, target in zip(codes, targets):
            have = np.bincount(code, x, len(target))
            off = max(off, float(np.abs(have - target).max(initial=0.0)))
            x = x * np.divide(target, have, out=np.zeros_like(target), where=have > 0)[code]
        if off < error:
            break
    return x


def _rake_driver(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS) -> DataFrame:
    dims = list(targets)
    rows = sorted(cells.collect(), key=lambda r: tuple(r[d] for d in dims))  # at most DRIVER_CELLS
    wanted = {d: {r[d]: r["target"] for r in t.collect()} for d, t in targets.items()}
    values = {d: sorted({r[d] for r in rows}) for d in dims}
    codes = [_codes([r[d] for r in rows], values[d]) for d in dims]
    x = rake(np.array([float(r["tokens"]) for r in rows]), codes, [np.array([wanted[d].get(v, 0.0) for v in values[d]]) for d in dims], sweeps)
    out = [(*[r[d] for d in dims], float(v)) for r, v in zip(rows, x)]
    return cells.sparkSession.createDataFrame(out, ", ".join(f"{d} string" for d in dims) + ", raked double")


def _codes(column: list[str], values: list[str]) -> np.ndarray:
    at = {v: i for i, v in enumerate(values)}
    return np.array([at[v] for v in column], np.int64)


def _rake_table(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, error: float = ERROR) -> DataFrame:
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    now = checkpointed(cells.select(*targets, (F.col("tokens") / float(total)).alias("x"), F.lit(0.0).alias("off")))
    for _ in range(sweeps):
        now = now.withColumn("off", F.lit(0.0))
        for d, target in targets.items():
            sums = now.groupBy(d).agg(F.sum("x").alias("have")).join(target, d, "left").select(d, F.coalesce("target", F.lit(0.0)).alias("target"), "have")
            factor = F.when(F.col("have") > 0, F.col("target") / F.col("have")).otherwise(0.0)
            off = F.abs(F.col("have") - F.col("target"))
            now = now.join(sums.select(d, factor.alias("f"), off.alias("o")), d).select(*targets, (F.col("x") * F.col("f")).alias("x"), F.greatest("off", "o").alias("off"))
        now = checkpointed(now)
        if (now.agg(F.max("off")).first()[0] or 0.0) < error:
            break
    return now.select(*targets, F.col("x").alias("raked"))


def _scale(weights: DataFrame, keep: float) -> float:
    """s such that drawing by min(1, s * weight) keeps the share ``keep`` of all tokens."""
    bounds = weights.where("tokens > 0 and weight > 0").agg(F.sum("tokens"), F.min("weight"), F.max("weight")).first()
    if not bounds[0]:
        return 1.0
    lo, hi = 0.0, 1.0 / bounds[1]
    for _ in range(8):  # each narrows to a 32nd
        steps = [lo + (hi - lo) * i / 32 for i in range(33)]
        kept = weights.agg(*[F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(s) * F.col("weight"))).alias(f"k{i}") for i, s in enumerate(steps)]).first()
        at = next((i for i in range(1, 33) if (kept[i] or 0) >= keep * bounds[0]), 32)
        lo, hi = steps[at - 1], steps[at]
    return hi


def with_cells(docs: DataFrame) -> DataFrame:
    """``docs`` with its raking columns under reserved names: _tokens and one for each dimension."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = {"source": F.coalesce(F.col("source").cast("string"), F.lit(MISSING)), "lang": F.coalesce(F.col("lang").cast("string"), F.lit(MISSING)), "topic": topic(text)}
    return docs.withColumns({"_tokens": n_words(text).cast("long")} | {f"_{d}": c for d, c in named.items()})


def cell_weights(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = 0.7, keep: float = 0.8, driver_cells: int = DRIVER_CELLS, sweeps: int = SWEEPS) -> DataFrame:
    """source, lang, topic, tokens, weight and probability of every cell of ``docs``.

    ``targets`` gives shares by dimension and value (values left out get none);
    without it, they are the shares that the tokens have now, raised to ``power``
    and normalised. A weight is a cell's raked share over its share now;
    probabilities keep the share ``keep`` of the tokens in all.
    """
    cells = checkpointed(with_cells(docs).groupBy(*[F.col(f"_{d}").alias(d) for d in DIMS]).agg(F.sum("_tokens").alias("tokens")))
    spark = docs.sparkSession
    if targets is None:
        wanted = {d: checkpointed(tempered(cells, d, power)) for d in DIMS}
    else:
        wanted = {d: spark.createDataFrame([(v, float(s) / sum(targets[d].values())) for v, s in targets[d].items()], f"{d} string, target double") for d in DIMS if d in targets}
    few = cells.limit(driver_cells + 1).count() <= driver_cells
    raked = (_rake_driver if few else _rake_table)(cells.select(*wanted, "tokens").groupBy(*wanted).agg(F.sum("tokens").alias("tokens")), wanted, sweeps)
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    sums = Window.partitionBy(*wanted)
    weights = checkpointed(cells.withColumn("_sum", F.sum("tokens").over(sums)).join(raked, list(wanted)).withColumn("weight", F.when(F.col("_sum") > 0, F.col("raked") / (F.col("_sum") / float(total))).otherwise(0.0)))
    scale = _scale(weights, keep)
    return weights.select(*DIMS, "tokens", "weight", F.least(F.lit(1.0), F.lit(scale) * F.col("weight")).alias("probability"))


def draw(seed: int, text: Column) -> Column:
    """A number in [0, 1) that depends on a row's id and text alone."""
    h = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), text)
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def _sampled(docs: DataFrame, seed: int, **how) -> DataFrame:
    weights = cell_weights(docs, **how)
    cells = weights.select(*[F.col(d).alias(f"_{d}") for d in DIMS], F.col("weight").alias("_weight"), F.col("probability").alias("_probability"))
    if cells.limit(DRIVER_CELLS + 1).count() <= DRIVER_CELLS:
        cells = F.broadcast(cells)
    joined = with_cells(docs).join(cells, [f"_{d}" for d in DIMS], "left")
    keep = draw(seed, F.coalesce(F.col("text").cast("string"), F.lit(""))) < F.col("_probability")
    return joined.withColumn("_sampled", F.when(F.col("_tokens") > 0, keep).otherwise(False))


def mixture(docs: DataFrame, seed: int = 17, **how) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability and sampled of every row.

    ``how``: see ``cell_weights``. Rows with null source or language count under
    the value '(none)'; a null or empty text has no tokens and is never drawn; a
    repeated row shares its twin's fate; a null id stays null; an empty table gives
    an empty result. Other columns are ignored, whatever their names.
    """
    return _sampled(docs.select("doc_id", "text", "lang", "source"), seed, **how).select(
        F.col("doc_id").cast("long").alias("doc_id"), *[F.col(f"_{d}").alias(d) for d in DIMS], F.col("_tokens").alias("n_tokens"), F.col("_weight").alias("weight"), F.col("_probability").alias("probability"), F.col("_sampled").alias("sampled")
    )


def mix(docs: DataFrame, seed: int = 17, **how) -> DataFrame:
    """The rows of ``docs``, all columns, that ``mixture`` samples."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")  # names of other columns can't clash
    return _sampled(docs.select("doc_id", "text", "lang", "source", row), seed, **how).where("_sampled").select("_row.*")
