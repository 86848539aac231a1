"""Personal data: base patterns for four kinds, extended by bootstrapped contextual extraction, in DataFrame expressions only.

Every validated base match seeds a bipartite graph of lexical patterns (the word and marks to its left, and to its right) and
instances (the identifier found there); other instances have the shape of an identifier and overlap no base match. Scores run
over the graph a few times: a pattern scores by the share of its instances that are believed, an unseen instance by the mean
score of its patterns. Patterns that end above a threshold, with enough support and with identifiers at a fair share of all
places where the pattern stands in the texts, yield new spans of kind `other`.

Defined cases: a null text counts as empty; spans are code points, end exclusive; repeated rows get the same spans; ties
between patterns don't matter, as every accepted pattern yields its spans; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_of

KINDS = ("email", "ip", "card", "phone", "other")
# A match can only start where a run of its first characters starts (or where the match before it ended), so look-behinds
# keep the scan linear in long runs without changing what is found.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Shapes of identifiers: something@something; six or more digits, perhaps with + or brackets and spaced; six or more letters
#: and digits, a digit among them, perhaps joined by . _ or -. Base matches are blanked by NUL before.
MAIL_LIKE = r"(?<![^\s@<>()\[\],;:\x22\x27\x00])[^\s@<>()\[\],;:\x22\x27\x00]++@[^\s@<>()\[\],;:\x22\x27\x00]*[\p{L}\p{N}]"
NUMBER_LIKE = r"(?<![\p{L}\p{N}+(])(?:\+\(|[+(])?[0-9](?:[\x20()./-]{0,3}+[0-9]){5,30}+(?![\p{L}\p{N}]|[._-][\p{L}\p{N}])"
CODE_LIKE = r"(?<![\p{L}\p{N}])(?=[A-Za-z._-]*+[0-9])[A-Za-z0-9](?:[._-]?[A-Za-z0-9]){5,}+"
CANDIDATE = f"{MAIL_LIKE}|{NUMBER_LIKE}|{CODE_LIKE}"
#: A context: the nearest word, or its nearest 24 letters, and the marks between.
_LETTER, _GLUE = r"[\p{L}\p{M}]", r"[^\p{L}\p{M}\p{N}\x00]{1,6}"
BEFORE, AFTER = _LETTER + "{1,24}+" + _GLUE, _GLUE + _LETTER + "{1,24}"
WINDOW = 40


def _located(text: Column, pattern: str) -> Column:
    """Array of (text, start, end) of every match: the pieces between matches give the offsets."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    pair = F.struct(found.alias("f"), between.alias("b"))

    def walk(p: Column) -> Column:
        start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<m:string,s:int,e:int>>").alias("out"))

        def step(acc: Column, i: Column) -> Column:
            m, s = F.get(p["f"], i), acc["pos"] + F.length(F.get(p["b"], i))
            e = s + F.length(m)
            return F.struct(e.alias("pos"), F.concat(acc["out"], F.array(F.struct(m.alias("m"), s.alias("s"), e.alias("e")))).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(p["f"]) - 1), start, step, lambda acc: acc["out"])

    none = F.array().cast("array<struct<m:string,s:int,e:int>>")
    return F.get(F.transform(F.array(pair), lambda p: F.when(F.size(p["f"]) == 0, none).otherwise(walk(p))), F.lit(0))


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda acc, i: acc + F.get(F.transform(F.array(F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * (2 - i % 2)), lambda d: F.when(d > 9, d - 9).otherwise(d)), F.lit(0)),
    )
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _of_kind(found: Column, n: int) -> Column:
    kept = F.filter(found, lambda x: _valid(KINDS[n], x["m"]))
    return F.transform(kept, lambda x: F.struct(x["s"].alias("s"), F.lit(n).alias("k"), x["e"].alias("e"), x["m"].alias("m")))


def count_of(entities: Column, n: int) -> Column:
    return F.size(F.filter(entities, lambda x: x["k"] == n)).cast("bigint")


def base_entities(text: Column) -> Column:
    """Array of (kind number, start, end, text) of the four base kinds, by start and then kind."""
    none = F.array().cast("array<struct<m:string,s:int,e:int>>")
    digit = text.rlike("[0-9]")
    gates = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+"))}
    parts = []
    for n, (kind, pattern) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE))):
        found = F.when(gates[kind], _located(text, pattern)).otherwise(none)
        parts.append(_of_kind(found, n))
    return F.array_sort(F.concat(*parts))


def blanked(text: Column, base: Column) -> Column:
    """The text with NUL in place of every base match, so that offsets stay."""
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        clean = F.substr(text, acc["pos"] + 1, F.greatest(x["s"] - acc["pos"], F.lit(0)))
        gone = F.repeat(F.lit("\0"), F.greatest(x["e"] - F.greatest(acc["pos"], x["s"]), F.lit(0)))
        return F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), F.concat(acc["out"], clean, gone).alias("out"))

    covered = F.aggregate(base, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["pos"] + 1)))
    return F.when(F.size(base) == 0, text).otherwise(covered)


def candidates(blank: Column) -> Column:
    """Array of (text, start, end) of what has the shape of an identifier in a text without its base matches."""
    none = F.array().cast("array<struct<m:string,s:int,e:int>>")
    return F.when(blank.rlike("[0-9@]"), _located(blank, CANDIDATE)).otherwise(none)


def _in_context(blank: Column, found: Column, seed: bool) -> Column:
    """Array of (pattern, start, end, text, seed): an entry for the context on each side that has one."""

    def sides(x: Column) -> Column:
        at = F.greatest(x["s"] - WINDOW, F.lit(0))
        left = F.regexp_extract(F.substr(blank, at + 1, x["s"] - at), f"(?:{BEFORE})$", 0)
        right = F.regexp_extract(F.substr(blank, x["e"] + 1, F.lit(WINDOW)), f"^(?:{AFTER})", 0)
        entry = lambda side, c: F.struct(F.concat(F.lit(side), F.lower(c)).alias("p"), x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), F.lit(seed).alias("seed"))
        return F.filter(F.array(entry("<", left), entry(">", right)), lambda c: F.length(c["p"]) > 1)

    return F.flatten(F.transform(found, sides))


def contexts(docs: DataFrame, text: str = "text") -> DataFrame:
    """p and places: how often each pattern stands in the texts, whatever is beside it."""
    t = F.lower(text_of(text))
    all_of = lambda side, r: F.transform(F.regexp_extract_all(t, F.lit(r), F.lit(0)), lambda c: F.concat(F.lit(side), c))
    return docs.select(F.explode(F.concat(all_of("<", BEFORE), all_of(">", AFTER))).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("places"))


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document: doc_id, a hash of its text, base entities and candidates in their contexts; base entities are the seeds."""
    t, b = F.col("__t"), F.col("__b")
    rows = docs.select("doc_id", text_of(text).alias("__t"))
    rows = rows.select("doc_id", F.xxhash64(t).alias("__h"), "__t", base_entities(t).alias("base"))
    rows = rows.withColumn("__b", blanked(t, F.col("base"))).withColumn("__c", candidates(b))
    return rows.select("doc_id", "__h", "base", F.concat(_in_context(b, F.col("base"), True), _in_context(b, F.col("__c"), False)).alias("cand"))


def bootstrap(found: DataFrame, places: DataFrame, rounds: int = 3, threshold: float = 0.5, min_support: int = 3, share: float = 0.1) -> DataFrame:
    """Accepted patterns with their score, from the graph of `entities`; `places` is that of `contexts`.

    A pattern must hold believed identifiers at `share` of its places, or it is a common word that stands beside anything.

    The graph has one edge for each distinct pair, summed before it is shuffled; a round is two aggregations over it."""
    edges = found.select(F.explode("cand").alias("c")).select(F.col("c.p").alias("p"), F.xxhash64("c.m").alias("i"), F.col("c.seed").alias("seed"))
    edges = edges.groupBy("p", "i").agg(F.max(F.col("seed").cast("int")).alias("seed"), F.count(F.lit(1)).alias("times"))
    belief = F.col("seed").cast("double")
    scored = edges.withColumn("b", belief)
    for n in range(rounds):
        patterns = scored.groupBy("p").agg(F.sum("b").alias("f"), F.sum(F.col("b") * F.col("times")).alias("g"), F.count(F.lit(1)).alias("n")).select("p", "f", "g", "n", (F.col("f") / (F.col("n") + 1.0)).alias("score"))
        if n < rounds - 1:
            to_edges = edges.join(patterns.select("p", "score"), "p")
            instances = to_edges.groupBy("i").agg(F.when(F.max("seed") == 1, F.lit(1.0)).otherwise(F.avg("score")).alias("b"))
            scored = edges.join(instances, "i")
    good = patterns.where((F.col("score") >= threshold) & (F.col("f") >= min_support))
    rare = good.join(places, "p", "left").where(F.col("g") >= share * F.coalesce("places", F.lit(0)))
    return rare.select("p", "score")


def spans(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """`found` with `all`: base entities and, as kind 4, the unseen identifiers in accepted patterns."""
    fresh = found.select("doc_id", "__h", F.explode("cand").alias("c")).where(~F.col("c.seed"))
    hits = fresh.join(patterns, fresh["c.p"] == patterns["p"], "left_semi")
    new = hits.groupBy("doc_id", "__h").agg(F.collect_set(F.struct(F.col("c.s").alias("s"), F.lit(4).alias("k"), F.col("c.e").alias("e"), F.col("c.m").alias("m"))).alias("new"))
    new = new.select(F.col("doc_id").alias("__id2"), F.col("__h").alias("__h2"), "new")
    joined = found.join(new, F.col("doc_id").eqNullSafe(F.col("__id2")) & (F.col("__h") == F.col("__h2")), "left")
    none = F.array().cast("array<struct<s:int,k:int,e:int,m:string>>")
    return joined.select("doc_id", "__h", "base", F.array_sort(F.concat("base", F.coalesce("new", none))).alias("all"))


def find(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """doc_id, text hash, base and all spans of every document. The entities are written once and read for both uses."""
    found = Scratch(docs.sparkSession, "pii").write(entities(docs, text), "entities")
    return spans(found, bootstrap(found, contexts(docs, text), **options))


def listed(array: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def redact(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """`docs` with every span replaced by its kind in brackets; of overlapping spans the first is named and all are covered."""
    found = find(docs, text, **options).where(F.size("all") > 0).select(F.col("doc_id").alias("__id2"), F.col("__h").alias("__h2"), F.col("all").alias("__all")).dropDuplicates(["__id2", "__h2"])
    key = F.xxhash64(text_of(text))
    joined = docs.withColumn("__h", key).join(found, F.col("doc_id").eqNullSafe(F.col("__id2")) & (F.col("__h") == F.col("__h2")), "left")
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    t = F.col(text)
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        clean = F.substr(t, acc["pos"] + 1, F.greatest(x["s"] - acc["pos"], F.lit(0)))
        name = F.when(x["s"] >= acc["pos"], F.get(names, x["k"])).otherwise("")
        return F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), F.concat(acc["out"], clean, name).alias("out"))

    masked = F.aggregate("__all", start, step, lambda acc: F.concat(acc["out"], F.substr(t, acc["pos"] + 1)))
    return joined.withColumn(text, F.when(F.col("__all").isNull(), t).otherwise(masked)).select(*docs.columns)
