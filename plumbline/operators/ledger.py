"""Spend ledgers, review rounds and facts gathered by type."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: What a ledger needs of a request: what it may take at most, and what it took if it was admitted.
_SPEND = ["projected_tokens", "tokens", "projected_cents", "cents"]


def spend_ledger(requests: DataFrame, order: list[str], per_job: int, daily_tokens: int, daily_cents: int, day: str = "day", ledger: str = "ledger", mode: str = "enabled") -> DataFrame:
    """AGG-20, DOM-19: each request with its refusal, null if it was admitted: the adapter is disabled, the breaker is open, over
    the cap of a job, over a cap of the day. Caps hold against what a request may take, days sum what admitted ones took. A daily
    refusal opens the ledger's breaker, which stays open on later days too; `fold_ledger` takes closings.

    Nothing is admitted after a ledger's first daily refusal, so sums over all requests below the cap of a job are exact up to
    it: a window per ledger and day takes the place of a fold, and the first refusal is an aggregate."""
    if mode == "disabled":
        return requests.withColumn("refusal", F.lit("disabled"))
    small = F.col("projected_tokens") <= per_job
    before = Window.partitionBy(ledger, day).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    taken = lambda c: F.coalesce(F.sum(F.when(small, F.col(c)).otherwise(0)).over(before), F.lit(0))
    over = lambda c, cap: small & (taken(c) + F.col(f"projected_{c}") > cap)
    rows = requests.withColumn("__r", F.when(over("tokens", daily_tokens), "daily_token_cap").when(over("cents", daily_cents), "daily_cost_cap"))
    rows = rows.withColumn("__at", F.struct(day, *order))
    first = rows.where("__r IS NOT NULL").groupBy(F.col(ledger).alias("__l")).agg(F.min("__at").alias("__first"))
    rows = rows.join(first, F.col(ledger).eqNullSafe(F.col("__l")), "left")
    refusal = F.when(F.col("__at") > F.col("__first"), "breaker_open").when(~small, "job_token_cap").otherwise(F.col("__r"))
    return rows.withColumn("refusal", refusal).drop("__r", "__at", "__l", "__first")


def fold_ledger(requests: DataFrame, closings: DataFrame, order: list[str], per_job: int, daily_tokens: int, daily_cents: int, day: str = "day", ledger: str = "ledger") -> DataFrame:
    """DOM-19: the same with closings (ledger, order): one closes the breaker before what has its place or a later one.

    Each decision needs all earlier ones of its ledger, so a ledger's rows pass one task, in order, with a few numbers in memory."""
    columns, kinds = requests.columns, {f.name: f.dataType.simpleString() for f in requests.schema}
    calls = closings.select(ledger, *order, *[F.lit(None).cast(kinds[c]).alias(c) for c in columns if c not in (ledger, *order)], F.lit(0).alias("__call"))
    rows = requests.withColumn("__call", F.lit(1)).unionByName(calls).repartition(ledger).sortWithinPartitions(ledger, *order, "__call")

    def fold(batches):
        now, today, is_open, sums = object(), None, False, [0, 0]
        for rows in batches:
            said = []
            for who, date, call, may_t, t, may_c, c in zip(rows[ledger].tolist(), rows[day], rows["__call"], *(rows[x].tolist() for x in _SPEND)):
                if who != now:
                    now, today, is_open, sums = who, None, False, [0, 0]
                if not call:
                    is_open = False
                    said.append(None)
                    continue
                if date != today:
                    today, sums = date, [0, 0]
                why = "breaker_open" if is_open else "job_token_cap" if may_t > per_job else "daily_token_cap" if sums[0] + may_t > daily_tokens else "daily_cost_cap" if sums[1] + may_c > daily_cents else None
                is_open = is_open or (why or "").startswith("daily_")
                if not why:
                    sums = [sums[0] + t, sums[1] + c]
                said.append(why)
            rows["refusal"] = said
            yield rows[rows["__call"] == 1].drop(columns="__call")

    return rows.mapInPandas(fold, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "refusal string"]))


def rounds_gate(findings: DataFrame) -> DataFrame:
    """AGG-24, WIN-09: one row: rounds, confirmed findings of the last two, open ones of all, and whether the gate passes."""
    rounds = findings.groupBy("round").agg(F.count_if(F.col("status") == "confirmed").alias("c"), F.count_if(F.col("status") == "open").alias("o"))
    last = rounds.withColumn("r", F.row_number().over(Window.orderBy(F.desc("round"))))  # a row a round
    sums = last.agg(F.count(F.lit(1)).alias("n_rounds"), F.coalesce(F.sum(F.when(F.col("r") <= 2, F.col("c"))), F.lit(0)).alias("confirmed"), F.coalesce(F.sum("o"), F.lit(0)).alias("open"))
    return sums.withColumn("passed", (F.col("n_rounds") >= 2) & (F.col("confirmed") == 0) & (F.col("open") == 0))


def facts_by_type(facts: DataFrame, key: str, order: str, cap: int = 100) -> DataFrame:
    """AGG-25, DOM-23: per key and fact type the values in order, as many as `cap`, and how many there are. Facts without a
    source version or with low or no confidence are left out."""
    cited = facts.where(F.col("version_id").isNotNull() & ~F.coalesce("confidence", F.lit("none")).isin("low", "none"))
    ranked = cited.withColumn("__r", F.row_number().over(Window.partitionBy(key, "fact_type").orderBy(order, "value"))).where(F.col("__r") <= cap)
    kept = ranked.groupBy(key, "fact_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "value"))), lambda x: x["value"]).alias("values"))
    return kept.join(cited.groupBy(key, "fact_type").agg(F.count(F.lit(1)).alias("n")), [key, "fact_type"])


def repair_choice(artefacts: DataFrame, group: str) -> DataFrame:
    """DOM-24: of each group the raw file to parse again: pdf before docx before html, then the larger, then the older."""
    rank = F.when(F.col("kind") == "raw_pdf", 0).when(F.col("kind") == "raw_docx", 1).otherwise(2)
    raw = artefacts.where(F.col("kind").isin("raw_pdf", "raw_docx", "raw_html"))
    best = raw.groupBy(group).agg(F.min(F.struct(rank.alias("k"), (-F.coalesce("size", F.lit(0))).alias("s"), "created", "artefact_id")).alias("b"))
    return best.select(group, F.col("b.artefact_id").alias("artefact_id"))
