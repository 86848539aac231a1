"""Chunks of texts and reports on sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack_paragraphs(df: DataFrame, text: str = "text", limit: int = 1_200, separator: str = r"(?U)\n[\s\x1c-\x1f]*\n") -> DataFrame:
    """DOM-11: paragraphs between blank lines, packed greedily up to `limit` characters, a longer one alone; a fold over each text's paragraphs."""
    parts = F.filter(F.transform(F.split(text, separator), lambda p: F.regexp_replace(p, r"(?U)^[\s\x1c-\x1f]++|(?<![\s\x1c-\x1f])[\s\x1c-\x1f]++$", "")), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, p: Column) -> Column:
        joined = F.when(acc["now"] == "", p).otherwise(F.concat(acc["now"], F.lit("\n\n"), p))
        fits = (acc["now"] == "") | (F.length(joined) <= limit)
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))).alias("done"), F.when(fits, joined).otherwise(p).alias("now"))

    chunks = F.aggregate(parts, start, step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))))
    out = df.select(*[c for c in df.columns if c != text], F.posexplode(chunks).alias("ordinal", "chunk"))
    return out.withColumn("ordinal", F.col("ordinal").cast("bigint"))


def readiness(n_chunks: Column, n_citations: Column, low_signal: Column, approved: Column) -> Column:
    """DOM-10, PRJ-05: the first state that holds."""
    return F.when(n_chunks == 0, "needs_parsing").when(low_signal, "low_signal").when(n_citations == 0, "needs_citations").when(~F.coalesce(approved, F.lit(False)), "needs_review").otherwise("ready")


def in_state(rows: DataFrame, state: str | None, column: str = "readiness") -> DataFrame:
    """FLT-10: rows in one state; all of them where none is asked."""
    return rows if state is None else rows.where(F.col(column) == state)


def _split_long(paragraph: Column, limit: int) -> Column:
    """A paragraph as its parts of `limit` characters at most: packed words, a longer word cut hard."""
    words = F.flatten(F.transform(F.filter(F.split(paragraph, r"(?U)\s+"), lambda w: w != ""), lambda w: F.when(F.length(w) <= limit, F.array(F.struct(w.alias("w"), F.lit(False).alias("cut")))).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / limit).cast("int")), lambda i: F.struct(F.substr(w, i * limit + 1, F.lit(limit)).alias("w"), F.lit(True).alias("cut"))))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    closed = lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["now"]))

    def step(acc: Column, x: Column) -> Column:
        joined = F.when(acc["now"] == "", x["w"]).otherwise(F.concat(acc["now"], F.lit(" "), x["w"]))
        fits = (acc["now"] == "") | (F.length(joined) <= limit)
        alone = F.struct(F.array_append(closed(acc), x["w"]).alias("done"), F.lit("").alias("now"))
        return F.when(x["cut"], alone).otherwise(F.struct(F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])).alias("done"), F.when(fits, joined).otherwise(x["w"]).alias("now")))

    return F.when(F.length(paragraph) <= limit, F.array(paragraph)).otherwise(F.aggregate(words, start, step, closed))


def pack_document(df: DataFrame, text: str = "text", limit: int = 1_200) -> DataFrame:
    """DOM-11, the document packer: paragraphs between blank lines, those over `limit` split at words, packed up to `limit`."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))), lambda p: p != "")
    pieces = F.flatten(F.transform(parts, lambda p: _split_long(p, limit)))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(acc: Column, p: Column) -> Column:
        fits = (acc["now"] == "") | (F.length(acc["now"]) + F.length(p) + 2 <= limit)
        joined = F.when(acc["now"] == "", p).otherwise(F.concat(acc["now"], F.lit("\n\n"), p))
        return F.struct(F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])).alias("done"), F.when(fits, joined).otherwise(p).alias("now"))

    chunks = F.aggregate(pieces, start, step, lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["now"])))
    return df.select(*[c for c in df.columns if c != text], F.posexplode(chunks).alias("ordinal", "chunk"))


def pages(df: DataFrame, text: str = "text") -> DataFrame:
    """DOM-11, the page splitter: pages between form feeds or ---page--- lines, blank ones left out, numbered from 1."""
    parts = F.filter(F.transform(F.split(text, r"\f+|\n\s*---page---\s*\n"), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    out = df.select(*[c for c in df.columns if c != text], F.posexplode(parts).alias("page", "body"))
    return out.withColumn("page", F.col("page") + 1)
