"""Quality rules whose cutoffs come from labelled holdouts, with exact binomial risk bounds."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Settings:
    """risk: upper bound asked for the share of good documents of a stratum that one rule rejects. A
    holdout too small to show so little at all (under about 630 good documents) is asked for the least
    share it can show, which takes a rule that rejects none of it; never for more than most_risk. error: chance that any bound of any stratum and rule is wrong. cutoffs: fixed
    grids, from lax to strict, of (measure, side, values); a document is rejected above (or below) a
    cutoff. A grid is tested in that order until a test fails, which needs no correction; the error
    is shared out over strata times rules."""

    risk: float = 0.01
    most_risk: float = 0.05
    error: float = 0.05
    min_words: int = 50
    grids: tuple[tuple[str, str, tuple[float, ...]], ...] = (
        ("symbol_share", "above", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03)),
        ("repeat_share", "above", (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15)),
        ("dup_line_share", "above", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
        ("mean_word_chars", "above", (30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0)),
        ("mean_word_chars", "below", (1.0, 1.5, 2.0, 2.5, 3.0, 3.5)),
        ("upper_share", "above", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
        ("mark_share", "above", (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1)),
    )


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the shares the
    rules look at, by expressions on each row alone: no shuffle, whatever the length of a text.

    Words are runs of other characters than white space; a null text has none. Repeated three-word
    windows are found by sorting the hashes of a text's windows, so a long text takes n log n steps.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, f"{SPACE}+", -1), lambda w: w != "")
    codes = F.transform(words, lambda w: F.xxhash64(w))
    out = docs.withColumn("__codes", codes).withColumn("__n", F.size("__codes"))
    window = lambda i: F.xxhash64(F.get("__codes", i), F.get("__codes", i + 1), F.get("__codes", i + 2))
    starts = F.when(F.col("__n") > 2, F.sequence(F.lit(0), F.col("__n") - 3)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("__w", F.sort_array(F.transform(starts, lambda i: F.struct(window(i).alias("h"), i.alias("p")))))
    twin = lambda x, i: (x["h"] == F.get("__w", i + 1)["h"]) | (x["h"] == F.get("__w", i - 1)["h"])
    hit = F.filter("__w", lambda x, i: F.coalesce(twin(x, i), F.lit(False)))
    out = out.withColumn("__p", F.sort_array(F.transform(hit, lambda x: x["p"])))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))
    repeats = F.aggregate("__p", start, step, lambda a: a["n"])
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("__lines", lines)
    n_upper, n_marks = F.regexp_count(text, F.lit(r"\p{Lu}")), F.regexp_count(text, F.lit(r"[!?{}|]"))
    out = out.select(
        *docs.columns,
        F.col("__n").cast("long").alias("n_words"),
        (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
        F.size("__lines").alias("__n_lines"),
        n_upper.alias("__upper"),
        n_marks.alias("__marks"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return out.select(
        *docs.columns,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_dup_lines", "__n_lines").alias("dup_line_share"),
        share("word_chars", "n_words").alias("mean_word_chars"),
        share("__upper", "word_chars").alias("upper_share"),
        share("__marks", "word_chars").alias("mark_share"),
    )


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """log P(X <= k) for X binomial of n trials with chance p, by the recurrence of its terms.

    P(X <= k) <= e says that the exact (Clopper-Pearson) upper bound of the rate at error e is p or less.
    """
    q = F.log(p / (1 - p))
    first = F.struct((n * F.log(1 - p)).alias("term"), (n * F.log(1 - p)).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + q
        high, low = F.greatest(a["sum"], term), F.least(a["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("sum"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(terms, first, step, lambda a: a["sum"])


def select_cutoffs(measured: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Of measured rows with a column stratum, for each stratum and rule the strictest cutoff whose risk bound holds: (stratum, rule, cutoff, n_good, n_rejected, risk).

    The holdout is every labelled good document (quality = 1) that has min_words. A rule of a
    stratum has no row where not even its laxest cutoff holds. Counts are sums over all labels; the
    table has strata times rules rows.
    """
    good = labels.filter("quality = 1").select("doc_id").distinct()
    held = measured.filter(F.col("n_words") >= s.min_words).join(good, "doc_id", "left_semi")
    tests = []
    for rule, (measure, side, values) in enumerate(s.grids):
        for step, value in enumerate(values):
            bad = F.col(measure) > value if side == "above" else F.col(measure) < value
            tests.append((rule, step, value, F.count_if(bad).alias(f"r{rule}_{step}")))
    counts = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_good"), *(t[3] for t in tests))
    cells = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(k).alias("step"), F.lit(float(v)).alias("cutoff"), F.col(f"r{r}_{k}").alias("n_rejected")) for r, k, v, _ in tests))
    counts = cut(counts.select("stratum", "n_good", F.explode(cells).alias("c")).select("stratum", "n_good", "c.*"), "counts")
    m = max(1, counts.select("stratum").distinct().count())
    level = float(math.log(s.error / (m * len(s.grids))))
    counts = counts.withColumn("risk", F.greatest(F.lit(s.risk), 1 - F.exp(F.lit(level) / F.col("n_good"))))
    tail = binomial_tail(F.col("n_rejected"), F.col("n_good"), F.col("risk"))
    hopeless = (F.col("risk") > s.most_risk) | (F.col("n_rejected") > F.col("n_good") * F.col("risk"))
    holds = F.when(hopeless, F.lit(False)).otherwise(tail <= F.lit(level + 1e-9))
    tested = counts.withColumn("fails", F.when(holds, F.lit(len(tests))).otherwise(F.col("step")))
    stop = tested.groupBy("stratum", "rule").agg(F.min("fails").alias("stop"), F.collect_list(F.struct("step", "cutoff", "n_good", "n_rejected", "risk")).alias("all"))
    last = F.array_max(F.filter("all", lambda x: x["step"] < F.col("stop")))
    return stop.select("stratum", "rule", last.alias("x")).filter("x is not null").select("stratum", "rule", "x.cutoff", "x.n_good", "x.n_rejected", "x.risk")


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", settings: Settings = Settings(), carry: list[str] | None = None) -> DataFrame:
    """``docs`` (doc_id, text, the stratum and any others; ``carry`` names those to return, by default all)
    with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (see measures), base_failed,
    rejected_by (an array of rules) and kept.

    base_failed: under min_words words, or over half of them in repeated windows. Otherwise a document
    is kept unless a rule of its stratum rejects it. labels (doc_id, quality): rows of quality 1 are
    the holdout. With probability 1 - error every rule of every stratum rejects at most the share of
    the good documents there that ``Settings.risk`` describes; strata without enough labels keep all
    that pass the base.

    A null text has no words; a null stratum is one of its own; repeated rows are judged each; empty
    tables give no rows or no cutoffs; columns of the same names are replaced. Only expressions and
    aggregates of the DataFrame API run; texts are not shuffled.
    """
    s = settings
    added = [*COUNTS, "base_failed", "rejected_by", "kept"]
    names = [c for c in (docs.columns if carry is None else carry) if c not in added]
    renamed = {c: f"__doc_{k}" for k, c in enumerate(names)}
    rows = docs.select("doc_id", "text", F.col(stratum).cast("string").alias("stratum"), *(F.col(c).alias(n) for c, n in renamed.items() if c not in ("doc_id", "text")))
    measured = measures(rows.withColumn("stratum", F.coalesce("stratum", F.lit(""))))
    measured = cut(measured if "text" in names else measured.drop("text"), "measures")
    cutoffs = select_cutoffs(measured, labels, s)
    by_stratum = cutoffs.groupBy("stratum").agg(F.map_from_arrays(F.collect_list("rule"), F.collect_list("cutoff")).alias("__cut"))
    judged = measured.join(cut(by_stratum, "cutoffs"), "stratum", "left")
    broken = []
    for rule, (measure, side, _) in enumerate(s.grids):
        cutoff = F.try_element_at("__cut", F.lit(rule))
        broken.append(F.when(F.col(measure) > cutoff if side == "above" else F.col(measure) < cutoff, F.lit(f"{measure} {side}")))
    base = (F.col("n_words") < s.min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = judged.withColumn("rejected_by", F.array_compact(F.array(*broken))).withColumn("base_failed", base)
    judged = judged.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
    return judged.select(*(F.col(c if c in ("doc_id", "text") else renamed[c]).alias(c) for c in names), *added)
