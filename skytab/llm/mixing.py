"""Source mixing: token weights raked to source, language and topic marginals, then calibrated sampling."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

MARGINS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Settings:
    """targets: for a margin, a map of value to share; values it lacks share what is left by their
    tokens. Without a map the target share of a value is its token share to the power of
    ``flatten`` (1 leaves the mix as it is, 0 makes all values equal). budget: share of all tokens to
    be kept in expectation. rounds: rounds of iterative proportional fitting over the margins, fewer if
    every value comes within the share ``tolerance`` of its target."""

    targets: dict[str, dict[str, float]] = field(default_factory=dict)
    flatten: tuple[tuple[str, float], ...] = (("source", 0.9), ("lang", 0.9), ("topic", 0.95))
    budget: float = 0.9
    rounds: int = 6
    tolerance: float = 1e-9
    seed: int = 23


def text_form(text: Column) -> Column:
    """The form of a text, which stands in for a topic where a table brings none: table, marked, shouted, list, brief or prose."""
    n = F.length(text)
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / n
    return (
        F.when(text.isNull() | (n == 0), F.lit("none"))
        .when(share(r" \| ") > 0.01, F.lit("table"))
        .when(share(r"[#*$%&<>]") > 0.05, F.lit("marked"))
        .when(share(r"\p{Lu}") > 0.3, F.lit("shouted"))
        .when(share("\n") > 0.02, F.lit("list"))
        .when(n < 400, F.lit("brief"))
        .otherwise(F.lit("prose"))
    )


def token_count(text: Column) -> Column:
    """Tokens of a text, as words: runs of other characters than white space, one at least."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("long")


def _target(cells: DataFrame, margin: str, s: Settings) -> DataFrame:
    """Rows (margin, target): target tokens of each value of a margin, the total being that of the cells."""
    own = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("tokens"))
    power = dict(s.flatten).get(margin, 1.0)
    given = s.targets.get(margin, {})
    share = F.lit(None).cast("double")
    for value, part in given.items():
        share = F.when(F.col(margin) == F.lit(value), F.lit(float(part))).otherwise(share)
    raw = own.withColumn("given", share).withColumn("raw", F.pow("tokens", F.lit(1.0 if given else power)))
    total = raw.agg(F.sum("tokens"), F.coalesce(F.sum("given"), F.lit(0.0)), F.sum(F.when(F.col("given").isNull(), F.col("raw")))).first()
    tokens, taken, free = total[0] or 0.0, total[1], total[2] or 1.0
    scale = 1.0 if free == 1.0 and taken == 0 else max(0.0, 1 - min(taken, 1.0)) / free
    norm = max(taken, 1.0) if total[2] is not None else (taken or 1.0)
    target = F.when(F.col("given").isNotNull(), F.col("given") / norm).otherwise(F.col("raw") * scale)
    return raw.select(margin, (target * tokens).alias("target"))


def rake(cells: DataFrame, s: Settings) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with weight: tokens scaled by turns until each margin meets
    its target, and margin_error: the largest share by which a value of any margin still misses it.

    The cells are as many as combinations of values occur. Each step is one aggregate joined back, and
    the result of a round is written: plans stay small and alike, whatever the rounds, and so does
    what the driver holds for them.
    """
    fitted = cells.withColumn("weight", F.col("tokens").cast("double"))
    for m in MARGINS:
        fitted = fitted.join(_target(cells, m, s).withColumnRenamed("target", f"target_{m}"), m)
    fitted = cut(fitted.select(*MARGINS, "tokens", "weight", *(f"target_{m}" for m in MARGINS)), "raked")
    error, columns = margin_error(fitted), fitted.columns
    for _ in range(s.rounds):
        if error <= s.tolerance:
            break
        for m in MARGINS:
            now = fitted.groupBy(m).agg(F.sum("weight").alias("now"))
            weight = F.when(F.col("now") > 0, F.col("weight") * F.col(f"target_{m}") / F.col("now")).otherwise(F.lit(0.0))
            fitted = fitted.join(now, m).select(*(weight.alias(c) if c == "weight" else F.col(c) for c in columns))
        fitted = cut(fitted, "raked")
        error = margin_error(fitted)
    return fitted.select(*MARGINS, "tokens", "weight", F.lit(error).alias("margin_error"))


def margin_error(fitted: DataFrame) -> float:
    """The largest |weight / target - 1| of all values of all margins (0 for no cells; a target of 0 is met by nothing else)."""
    off = [fitted.groupBy(m).agg((F.abs(F.sum("weight") / F.nullif(F.max(f"target_{m}"), F.lit(0.0)) - 1)).alias("off")).select("off") for m in MARGINS]
    return off[0].union(off[1]).union(off[2]).agg(F.max("off")).first()[0] or 0.0


def calibrate(fitted: DataFrame, s: Settings) -> DataFrame:
    """``fitted`` with probability: min(1, c weight / tokens), c such that budget times all tokens are expected.

    c solves a piecewise linear equation: cells sorted by ratio are certain from some point on. It
    is found by halving on aggregates of the cells.
    """
    ratio = F.col("weight") / F.col("tokens")
    top = fitted.agg(F.sum("tokens").alias("n"), F.max(ratio).alias("hi"), F.min(F.when(F.col("weight") > 0, ratio)).alias("lo")).first()
    if not top["n"] or not top["lo"]:
        return fitted.withColumn("probability", F.lit(0.0))
    lo, hi = 0.0, 1.0 / top["lo"]
    for _ in range(6):
        grid = [lo + (hi - lo) * k / 64 for k in range(65)]
        sums = fitted.agg(*(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(c) * ratio)).alias(f"c{k}") for k, c in enumerate(grid))).first()
        k = max([i for i in range(65) if sums[i] <= s.budget * top["n"]], default=0)
        lo, hi = grid[k], grid[min(k + 1, 64)]
    return fitted.withColumn("probability", F.least(F.lit(1.0), F.lit(lo) * ratio))


def mix_sources(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` (doc_id, text, source, lang, any others, topic among them or else taken from the form
    of the text) with tokens, topic, weight (target tokens for each token of its cell), probability,
    margin_error (how far the raked margins still are from their targets) and selected.

    Token counts of the cells source x language x topic are raked to the three margins; a document is
    selected when the hash of its doc_id, uniform over [0, 1), lies below the probability of its cell.
    So the choice depends on the document and the margins alone, not on partitions or retries, and a
    document stays selected when a later budget is larger. Weights and counts cover all rows.

    Null sources, languages and topics are values of their own (empty strings); null or empty texts
    count one token; repeated rows share their fate, and so do all rows with a null doc_id, which are drawn as one; an empty table gives no rows. Columns named
    tokens, weight, probability, margin_error or selected are replaced. Only DataFrame functions run.
    """
    s = settings
    kept = [c for c in docs.columns if c not in ("tokens", "topic", "weight", "probability", "margin_error", "selected")]
    topic = F.col("topic").cast("string") if "topic" in docs.columns else text_form(F.col("text"))
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(*kept, token_count(F.col("text")).alias("tokens"), F.coalesce(topic, F.lit("")).alias("topic"), value("source").alias("__source"), value("lang").alias("__lang"))
    cells = rows.groupBy(F.col("__source").alias("source"), F.col("__lang").alias("lang"), "topic").agg(F.sum("tokens").alias("tokens"))
    cells = cut(cells, "cells")
    fitted = cut(calibrate(rake(cells, s), s), "cells")
    fitted = fitted.select(F.col("source").alias("__source"), F.col("lang").alias("__lang"), "topic", (F.col("weight") / F.col("tokens")).alias("weight"), "probability", "margin_error")
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(s.seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    out = rows.join(fitted, ["__source", "__lang", "topic"])
    return out.select(*kept, "tokens", "topic", "weight", "probability", "margin_error", (draw < F.col("probability")).alias("selected"))
