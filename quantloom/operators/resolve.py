"""Entity resolution: company names to symbols, and which statement file stands for a symbol."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.constants import FUZZY_THRESHOLD


def without_copy_suffix(stem: str | Column) -> Column:
    """Drop a trailing " (1)" that a browser adds to a second download."""
    c = F.col(stem) if isinstance(stem, str) else stem
    return F.trim(F.regexp_replace(c, r"\s*\(\d+\)\s*$", ""))


def normalized_name(name: str | Column) -> Column:
    """Upper case, without words for a limited company and without punctuation but &."""
    c = F.upper(F.col(name) if isinstance(name, str) else name)
    c = F.regexp_replace(c, r"\b(LTD|LIMITED|LIMTED)\b", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[^A-Z0-9& ]", " "), r"\s+", " "))


def similarity(a: str, b: str) -> float:
    """Ratcliff-Obershelp: twice the matching characters over all characters."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def fuzzy_match(names: DataFrame, reference: DataFrame, least: float = FUZZY_THRESHOLD) -> DataFrame:
    """(key, matched_symbol, match_score, needs_review): for each name the most similar reference name, the first of equals.

    ``names``: (key, company_name); ``reference``: (symbol, company_name, ord), a short list (a few hundred names),
    which every task holds; names are scored where they are.
    """
    spelled = names.select("key", F.coalesce(normalized_name("company_name"), F.lit("")).alias("n"))
    # a name that a reference has just so cannot be bettered; only the others are scored
    same = reference.select("symbol", normalized_name("company_name").alias("n"), "ord").groupBy("n").agg(F.min_by("symbol", "ord").alias("matched_symbol"))
    met = spelled.join(F.broadcast(same), "n", "left")
    exact = met.where("matched_symbol IS NOT NULL").select("key", "matched_symbol", F.lit(1.0).alias("match_score"))
    known = [(r["symbol"], r["n"]) for r in reference.select("symbol", normalized_name("company_name").alias("n"), "ord").orderBy("ord").collect()]
    sent = names.sparkSession.sparkContext.broadcast(known)

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            best = []
            for n in pdf["n"]:
                symbol, top = None, 0.0
                match = difflib.SequenceMatcher(None)
                match.set_seq1(n or "")
                for s, ref in sent.value:
                    match.set_seq2(ref)
                    # the quick bounds are never below the ratio, so skipping by them loses nothing
                    if match.real_quick_ratio() > top and match.quick_ratio() > top and (r := match.ratio()) > top:
                        symbol, top = s, r
                best.append((symbol, round(top, 4)))
            yield pd.DataFrame({"key": pdf["key"], "matched_symbol": [b[0] for b in best], "match_score": [b[1] for b in best]})

    found = met.where("matched_symbol IS NULL").select("key", "n").mapInPandas(score, "key string, matched_symbol string, match_score double")
    return exact.select(F.col("key").cast("string"), "matched_symbol", "match_score").unionByName(found).withColumn("needs_review", F.col("match_score") < least)


def universe_mapping(files: DataFrame, reference: DataFrame, overrides: DataFrame, priced: DataFrame, least: float = FUZZY_THRESHOLD) -> DataFrame:
    """One row a statement file: its symbol, how it was found, whether it is included, and why not.

    ``files``: (file, mtime, company_name); ``overrides``: (dedup_key, symbol), null meaning: leave it out;
    ``priced``: (symbol) with prices. Of files of one symbol the newest stands.
    """
    keyed = files.withColumn("dedup_key", without_copy_suffix(F.regexp_replace("file", r"\.[^.]*$", ""))).withColumn("company_name", F.coalesce("company_name", "dedup_key"))
    fixed = F.broadcast(overrides.select("dedup_key", F.col("symbol").alias("_fixed"), F.lit(True).alias("_over")))
    both = keyed.join(fixed, "dedup_key", "left")
    fuzzy = fuzzy_match(both.where("_over IS NULL").select(F.col("file").alias("key"), "company_name"), reference, least).withColumnRenamed("key", "file")
    met = both.join(fuzzy, "file", "left")
    over = F.col("_over").isNotNull()
    out = met.withColumns(
        {
            "symbol": F.when(over, F.col("_fixed")).otherwise(F.col("matched_symbol")),
            "method": F.when(over & F.col("_fixed").isNotNull(), "override").when(over, "manual_exclude").otherwise("fuzzy"),
            "score": F.when(over, 1.0).otherwise(F.col("match_score")),
            "needs_review": F.coalesce(~over & F.col("needs_review"), F.lit(False)),
        }
    )
    out = out.join(F.broadcast(priced.select("symbol", F.lit(True).alias("_priced")).distinct()), "symbol", "left").withColumn("in_prices", F.col("_priced").isNotNull())
    good = F.col("symbol").isNotNull() & F.col("in_prices") & ~F.col("needs_review")
    newest = F.row_number().over(Window.partitionBy("symbol", "_good").orderBy(F.desc("mtime"), "file"))
    out = out.withColumn("_good", good).withColumn("_rank", newest)
    reason = F.when(F.col("needs_review"), "low-confidence match").when(F.col("symbol").isNull(), "no symbol").when(~F.col("in_prices"), "no prices").when(F.col("_rank") > 1, "older download").otherwise("")
    return out.select("file", "dedup_key", "company_name", "symbol", "score", "method", "in_prices", "needs_review", (F.col("_good") & (F.col("_rank") == 1)).alias("included"), reason.alias("reason"))


def locked_universe(mapping: DataFrame) -> DataFrame:
    return mapping.where("included").select("symbol").distinct()
