"""Text-quality signals of a page and the extraction route they lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Accented letters of Spanish and Portuguese; vowels, y among them.
DIACRITICS = "áéíóúüñÁÉÍÓÚÜÑàâãçêôõÀÂÃÇÊÔÕ"
VOWELS = "aeiouyAEIOUYáéíóúüÁÉÍÓÚÜàâãêôõÀÂÃÊÔÕ"
FLOOR = 400


def counters(pages: DataFrame, text: str = "text") -> DataFrame:
    """The page with letters, accented, unreadable (inside words), words, single, vowelless counted natively."""
    t = F.col(text)
    tokens = F.filter(F.split(t, "[^\\p{L}\\p{N}'’-]+"), lambda w: w.rlike("\\p{L}"))
    return pages.select(
        "*",
        F.char_length(t).alias("chars"),
        F.regexp_count(t, F.lit("\\p{L}")).alias("letters"),
        F.regexp_count(t, F.lit(f"[{DIACRITICS}]")).alias("accented"),
        F.regexp_count(t, F.lit("(?<=[\\p{L}\\p{N}])[\\x{FFFD}\\x{E000}-\\x{F8FF}]|[\\x{FFFD}\\x{E000}-\\x{F8FF}](?=[\\p{L}\\p{N}])")).alias("unreadable"),
        F.size(tokens).alias("words"),
        F.size(F.filter(tokens, lambda w: F.char_length(w) == 1)).alias("single"),
        F.size(F.filter(tokens, lambda w: (F.char_length(w) > 1) & ~w.rlike("[0-9]") & ~w.rlike(f"[{VOWELS}]"))).alias("vowelless"),
    )


def degradation(c: DataFrame, language: str = "language") -> DataFrame:
    """Adds ``degradation``: the first signal that holds, null for sound or short text."""
    lang = F.lower(F.trim(F.col(language)))
    reason = (
        F.when(F.col("letters") < FLOOR, None)
        .when(F.col("unreadable") * 500 > F.col("chars"), "unreadable")
        .when(F.col("words") == 0, None)
        .when(F.col("vowelless") * 100 > F.col("words") * 10, "impossible_words")
        .when(F.col("single") * 100 > F.col("words") * 50, "letters_not_words")
        .when(lang.isin("es", "pt") & (F.col("accented") * 1000 < F.col("letters") * 2), "missing_diacritics")
    )
    return c.withColumn("degradation", reason)


def route(pages: DataFrame) -> DataFrame:
    """Adds route and reason_code from raster, trusted and degradation, in that order."""
    reason = (
        F.when(F.col("raster"), "raster_content_detected")
        .when(~F.coalesce("trusted", F.lit(False)), "direct_text_insufficient")
        .when(F.col("degradation").isNotNull(), F.concat(F.lit("direct_text_degraded_"), "degradation"))
        .otherwise("direct_text_useful")
    )
    return pages.withColumn("reason_code", reason).withColumn("route", F.when(F.col("reason_code") == "direct_text_useful", "direct").otherwise("ocr"))


def voting_windows(docs: DataFrame, size: int = 200, letters: int = 100, most: int = 32) -> DataFrame:
    """doc_id, i, window_text: the text cut every ``size`` characters, windows of fewer than ``letters`` letters of any
    script (vowel signs too) dropped; of more than ``most`` those that are kept are spread from the first to the last. ``i`` counts all
    windows of the text."""
    cut = F.transform(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), 0), lambda w, i: F.struct(i.alias("i"), w.alias("w")))
    d = docs.select("doc_id", F.filter(cut, lambda x: F.char_length(F.regexp_replace(x["w"], "\\P{IsAlphabetic}+", "")) >= letters).alias("ws"))
    kept = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.get("ws", F.floor(F.size("ws") * k / most).cast("int")))
    d = d.select("doc_id", F.explode(F.when(F.size("ws") > most, kept).otherwise(F.col("ws"))).alias("x"))
    return d.select("doc_id", "x.i", F.col("x.w").alias("window_text"))
