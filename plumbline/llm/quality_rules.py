"""Quality rules: learned decision lists over document statistics, in DataFrame expressions only.

`statistics` computes per-document counts, `fit` learns an ordered list of threshold conjunctions by sequential
covering from labelled statistics, and `verdict` turns the list into one conditional expression.

Defined cases: a null text counts as empty; a text without words has zero counts and fails the base rule; repeated
rows are judged each on its own; labels with a null id or label are ignored and, of repeated labels, the lower one
counts; without labels the list is empty and every document passes it; an empty
table gives an empty result; other columns, whatever their names, are left out; work in a long text grows with n log n.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, let, one_per_key, sample_gate, split_words, text_of

#: Largest expected number of labelled documents that the list is learned from.
FIT_ROWS = 20_000
_POS_BITS = 26
_POS_MASK = (1 << _POS_BITS) - 1

#: Statistic that a condition may test -> its expression over the columns of `statistics`.
FEATURES = {
    "n_words": "cast(n_words as double)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
}


@dataclass
class Rule:
    """Rejects a document that meets every condition (feature, '>=' or '<', threshold)."""

    conditions: list[tuple[str, str, float]] = field(default_factory=list)

    def column(self) -> Column:
        out = F.lit(True)
        for name, op, cut in self.conditions:
            x = F.expr(FEATURES[name])
            out = out & ((x >= F.lit(float(cut))) if op == ">=" else (x < F.lit(float(cut))))
        return out


def _repeat_words(words: Column, n_words: Column) -> Column:
    """Words inside a 3-word window that is found at least twice. Windows are sorted by a hash that carries their position,
    so equal ones are neighbours; neighbours with equal hash bits are compared word by word. Where windows with equal bits
    differ, or positions need more bits, a text's windows are sorted by their words."""
    at = lambda i: F.get(words, i)
    packed = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), (n_words - 3).cast("int")),
            lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)).bitwiseAND(F.lit(~_POS_MASK)).bitwiseOR(i.cast("bigint")),
        )
    )

    def same(x: Column, y: Column) -> Column:
        i, j = (F.lit(_POS_MASK).bitwiseAND(v).cast("int") for v in (x, y))
        return (F.shiftright(x, _POS_BITS) == F.shiftright(y, _POS_BITS)) & (at(i) == at(j)) & (at(i + 1) == at(j + 1)) & (at(i + 2) == at(j + 2))

    def by_words() -> Column:
        windows = F.transform(F.sequence(F.lit(0), (n_words - 3).cast("int")), lambda i: F.struct(F.array(at(i), at(i + 1), at(i + 2)).alias("w"), i.cast("bigint").alias("i")))
        beside = lambda s, x, j: F.coalesce(F.get(s, j)["w"] == x["w"], F.lit(False))
        held = lambda s: F.transform(F.filter(s, lambda x, j: beside(s, x, j - 1) | beside(s, x, j + 1)), lambda x: x["i"])
        return let(F.array_sort(windows), held)

    def by_hash(s: Column) -> Column:
        hit = F.filter(s, lambda x, j: F.coalesce(same(x, F.get(s, j - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, j + 1)), F.lit(False)))
        return F.transform(hit, lambda x: x.bitwiseAND(F.lit(_POS_MASK)))

    def clash(s: Column) -> Column:
        pair = lambda x, y: (F.shiftright(x, _POS_BITS) == F.shiftright(y, _POS_BITS)) & ~same(x, y)
        return (n_words > _POS_MASK) | F.exists(F.sequence(F.lit(1), F.greatest(F.size(s) - 1, F.lit(1))), lambda j: F.coalesce(pair(F.get(s, j - 1), F.get(s, j)), F.lit(False)))

    def covered(s: Column) -> Column:
        starts = F.sort_array(F.when(clash(s), by_words()).otherwise(by_hash(s)))
        return F.aggregate(
            starts,
            F.struct(F.lit(-3).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("n")),
            lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3).cast("bigint"), p - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    held = F.transform(F.array(packed), covered)[0]
    return F.when(n_words >= 3, held).otherwise(F.lit(0).cast("bigint"))


def statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts of every whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and others that rules test."""
    t = F.col("__text")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("bigint")
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    first = docs.select(*keep, text_of(text).alias("__text"))
    split = first.withColumn("__words", split_words(t)).withColumn("__lines", lines)
    counted = split.withColumn("n_words", F.size("__words").cast("bigint"))
    return counted.select(
        *keep,
        "n_words",
        F.length(F.array_join("__words", "")).cast("bigint").alias("word_chars"),
        count(r"[#*$%&|<>]").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col("__words"), F.col("n_words")).alias("n_repeat_words"),
        F.size("__lines").cast("bigint").alias("n_lines"),
        count("[A-Z]").alias("n_upper"),
        count("[.,;:!?]").alias("n_marks"),
        count("[0-9]").alias("n_digits"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, max_rules: int = 4, max_conditions: int = 3, min_precision: float = 0.8, min_support: int = 5) -> list[Rule]:
    """Learn an ordered list that rejects documents labelled quality 0.

    At most about `fit_rows` labelled documents take part, chosen by a hash of their id; statistics are computed for those
    alone. Each growth step reads one histogram (statistic, bin, label) of the rows still open; two thirds of the rows grow
    a rule, the others prune it."""
    spark = docs.sparkSession
    good = one_per_key(labels.where(F.col("quality").isNotNull()), "doc_id", F.min("quality").alias("__good"))
    n = good.count()
    if not n:
        return []
    gate = sample_gate("doc_id", min(1.0, fit_rows / n))
    stats = statistics(docs.select("doc_id", "text").where(gate))
    rows = stats.join(good.where(gate), "doc_id").select(
        (F.col("__good") == 0).cast("int").alias("bad"),
        (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0).cast("int").alias("prune"),
        base_failed().alias("failed"),
        *[F.expr(e).cast("double").alias(k) for k, e in FEATURES.items()],
    )
    scratch = Scratch(spark, "quality-fit")
    rows = scratch.write(rows, "rows").where(~F.col("failed"))  # filtered after the write: a filter pushed below would repeat the statistics
    marks = [0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995]
    cuts = rows.agg(*[F.percentile_approx(k, marks, 10_000).alias(k) for k in FEATURES]).first().asDict()
    cuts = {k: sorted(set(v or [])) for k, v in cuts.items()}
    bins = rows.select("bad", "prune", *[sum([(F.col(k) >= F.lit(c)).cast("int") for c in v], F.lit(0)).alias(k) for k, v in cuts.items()])

    def met(conds: list[tuple[str, str, int]]) -> Column:
        out = F.lit(True)
        for k, op, b in conds:
            out = out & ((F.col(k) >= b) if op == ">=" else (F.col(k) < b))
        return out

    def histogram(open_rows: DataFrame) -> dict:
        pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("b")) for k in cuts]))
        got = open_rows.select("bad", pairs.alias("p")).groupBy("p.k", "p.b", "bad").count().collect()
        return {(r["k"], r["b"], r["bad"]): r["count"] for r in got}

    open_rows, rules = bins, []
    while len(rules) < max_rules:
        conds, grow = [], open_rows.where("prune = 0")
        while len(conds) < max_conditions:
            h = histogram(grow.where(met(conds)))
            one = next(iter(cuts))
            pos, neg = (sum(v for (k, _, y), v in h.items() if k == one and y == want) for want in (1, 0))
            if not pos or not neg:
                break
            base, best = math.log2(pos / (pos + neg)), (0.0, None)
            for k, v in cuts.items():
                for b in range(1, len(v) + 1):
                    hi = [sum(h.get((k, j, y), 0) for j in range(b, len(v) + 1)) for y in (1, 0)]
                    for op, (p, q) in ((">=", hi), ("<", (pos - hi[0], neg - hi[1]))):
                        if p >= min_support and (gain := p * (math.log2(p / (p + q)) - base)) > best[0] + 1e-9:
                            best = (gain, (k, op, b))
            if best[1] is None:
                break
            conds.append(best[1])
        if not conds:
            break
        held = open_rows.where("prune = 1")
        tallies = held.agg(*[F.coalesce(F.sum((met(conds[: i + 1]) & (F.col("bad") == y)).cast("int")), F.lit(0)).alias(f"n{i}_{y}") for i in range(len(conds)) for y in (0, 1)]).first()
        worth = lambda i: (tallies[f"n{i}_1"] - tallies[f"n{i}_0"]) / max(1, tallies[f"n{i}_1"] + tallies[f"n{i}_0"])
        best = max(range(len(conds)), key=lambda i: (round(worth(i), 6), -i))
        conds = conds[: best + 1]
        good_, bad_ = tallies[f"n{best}_0"], tallies[f"n{best}_1"]
        if bad_ < max(1, min_support // 3) or bad_ / (bad_ + good_) < min_precision:
            break
        rules.append(Rule([(k, op, cuts[k][b - 1]) for k, op, b in conds]))
        open_rows = open_rows.where(~met(conds))
    scratch.drop("rows")
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The index of the first rule that a document meets (from 1), 0 if none: an ordered conditional expression."""
    out = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(rule.column(), F.lit(i)).otherwise(out)
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, **fit_options) -> DataFrame:
    """Statistics of every document, base_failed, the rule that fired (0: none) and kept."""
    rules = fit(docs, labels, **fit_options)
    out = statistics(docs).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
