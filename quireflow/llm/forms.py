"""Problem 5: one consistent form for text that looks the same in different characters."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, clean_blocks, direct_elements, spread

# Pairs of a Cyrillic, Greek, Armenian or other letter and the Latin letter of the same shape.
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝґѵгпикв" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγικνορυϲϳχτ" + "օսոհցքտքԼՕՍՏ" + "ӏӀ" + "ɡɑıʏᴠᴡᴢ",
        "ABESIJKMHOPCTYXaesijopcyxhdqwrvrпикв" + "ABEZHIKMNOPTYXaγiκvopυcjχτ" + "ounhgpտքLOUS" + "lI" + "gaıyvwz",
    )
)
LOOKALIKES = {a: b for a, b in LOOKALIKES.items() if a != b and b.isascii()}
LOOKALIKES.pop("г"), LOOKALIKES.pop("ґ")
# Latin letters that stand for Cyrillic ones when a Cyrillic word was spelt with them.
TO_CYRILLIC = dict(zip("ABEKMHOPCTYXaeopcyxSIJsij", "АВЕКМНОРСТУХаеорсухЅІЈѕіј"))
TO_GREEK = dict(zip("ABEZHIKMNOPTYXov", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον"))
_INVISIBLE = regex.compile(r"[­؜᠎​-‏‪-‮⁠-⁤⁦-⁯﻿︀-️\U000e0000-\U000e007f]")
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{Nl}]+")
_SCRIPT = {
    "latin": regex.compile(r"\p{Latin}"),
    "cyrillic": regex.compile(r"\p{Cyrillic}"),
    "greek": regex.compile(r"\p{Greek}"),
    "armenian": regex.compile(r"\p{Armenian}"),
}
_FOREIGN = regex.compile(r"[\p{Cyrillic}\p{Greek}\p{Armenian}ɡɑʏᴠᴡᴢӏӀ]")
_COMPAT = regex.compile(r"[！-～￠-￦･-ￜ　ﬀ-ﬆⅠ-ⅿ℀-⅏\U0001D400-\U0001D7FF①-⓿ᴬ-ᵪʰ-ʸǄ-ǌǱ-ǳĲĳ․-…″‴ªº⁰-ₜ²³¹]+")
_KEEP_COMPAT = set("ªº²³¹™№℃℉…")


@lru_cache(maxsize=1 << 16)
def scripts_of(token: str) -> frozenset[str]:
    """Resolved scripts: of all scripts in which the token could be spelt, letter by letter, those left after intersection.

    A letter counts for its own script and for each script that has a letter of the same shape. Empty: no
    single script spells the token.
    """
    left: set[str] | None = None
    for ch in token:
        if unicodedata.category(ch)[0] == "M":
            continue
        base = unicodedata.normalize("NFD", ch)[0]
        own = next((s for s, p in _SCRIPT.items() if p.match(ch)), "other")
        could = {own}
        latin = base if own == "latin" else LOOKALIKES.get(base)
        if latin:
            could.add("latin")
            if latin in TO_CYRILLIC:
                could.add("cyrillic")
            if latin in TO_GREEK:
                could.add("greek")
        left = could if left is None else left & could
    return frozenset(left or ())


def _spell(token: str, script: str) -> str:
    decomposed = unicodedata.normalize("NFD", token)
    latin = "".join(LOOKALIKES.get(c, c) for c in decomposed)
    if script == "cyrillic":
        latin = "".join(TO_CYRILLIC.get(c, c) for c in latin)
    elif script == "greek":
        latin = "".join(TO_GREEK.get(c, c) for c in latin)
    return unicodedata.normalize("NFC", latin)


def main_script(text: str) -> str:
    """The script of most letters, a look-alike counting only where its token has letters that no other script has."""
    best = {s: 0 for s in _SCRIPT}
    for token in _TOKEN.findall(text):
        for s in (found if len(found := scripts_of(token)) == 1 else ()):
            if s in best:
                best[s] += 1
    top = max(best, key=best.get)
    if best[top]:
        return top
    count = {s: len(p.findall(text)) for s, p in _SCRIPT.items()}
    return max(count, key=count.get)


def consistent(text: str) -> str:
    """The one form: invisible characters gone, white space single, width and ligatures resolved, accents
    composed (NFC), and every token whose letters come from several scripts, or wholly from look-alikes of the
    text's main script, spelt in one script. Case, accents, other letters and punctuation stay."""
    text = " ".join(text.split())
    if text.isascii():
        return text
    needs = 0
    for c in set(text):
        needs |= _needs(c)
    if needs & 1:
        text = " ".join(_INVISIBLE.sub("", text).split())
    if needs & 2:
        text = _COMPAT.sub(lambda m: "".join(c if c in _KEEP_COMPAT else unicodedata.normalize("NFKC", c) for c in m.group()), text)
    if needs & 4:
        text = unicodedata.normalize("NFC", text)
    if needs & 8:
        main = main_script(text)
        text = _TOKEN.sub(lambda m: _consistent_token(m.group(), main), text)
    return text


@lru_cache(maxsize=1 << 16)
def _needs(c: str) -> int:
    """Bits: 1 invisible, 2 compatibility form, 4 not composed, 8 letter of a script with look-alikes of Latin ones."""
    if c < "\x80":
        return 0
    loose = unicodedata.category(c)[0] == "M" or unicodedata.normalize("NFC", c) != c
    return (_INVISIBLE.match(c) is not None) | (_COMPAT.match(c) is not None) << 1 | loose << 2 | (_FOREIGN.match(c) is not None) << 3


@lru_cache(maxsize=1 << 16)
def _consistent_token(token: str, main: str) -> str:
    if main == "latin" and not _FOREIGN.search(token):
        return token
    possible = scripts_of(token)
    if main in possible:
        return _spell(token, main)
    if len(possible) == 1 and "other" not in possible:
        return _spell(token, next(iter(possible)))
    return token


def consistent_forms(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, text, form: the consistent form of every text; null stays null, blank becomes empty.

    Equal (key, text) rows, such as re-deliveries, are merged. Other columns of ``df`` are ignored.
    """

    def make():
        def kernel(keys, texts):
            for k, t in zip(keys, texts):
                yield k, t, None if t is None else consistent(t)

        return kernel

    return arrow_rows(df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")), ["key", "text"], "key string, text string, form string", make)


def same_looking_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """key_a, key_b: different keys, key_a the smaller, whose texts have one form but not the same characters.

    Forms and texts are compared by 128-bit hashes, so only keys and hashes are shuffled. Only forms stored in
    two or more spellings enter the self-join; copies of one spelling are never paired with each other.
    """
    h = (
        consistent_forms(df, key, text)
        .where("form IS NOT NULL AND form <> ''")
        .select("key", F.xxhash64("form").alias("f1"), F.xxhash64(F.reverse("form")).alias("f2"), F.xxhash64("text").alias("t1"))
        .distinct()
    )
    varied = h.groupBy("f1", "f2").agg(F.min("t1").alias("lo"), F.max("t1").alias("hi")).where("lo <> hi").select("f1", "f2")
    v = h.join(varied, ["f1", "f2"], "left_semi")
    a, b = v.alias("a"), v.alias("b")
    return (
        a.join(b, (F.col("a.f1") == F.col("b.f1")) & (F.col("a.f2") == F.col("b.f2")) & (F.col("a.t1") != F.col("b.t1")) & (F.col("a.key") < F.col("b.key")))
        .select(F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b"))
        .distinct()
    )


def same_looking_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, class_id, representative, n_members, n_links: one row for each key whose form is stored in several spellings.

    ``representative`` is the least key of the own spelling, ``n_members`` the keys of the class and ``n_links`` those
    of them stored in other characters than this one. Spellings are counted before they are grouped to classes, so
    copies of one spelling, however many, weigh one row there; nothing is paired.
    """
    h = consistent_forms(df, key, text).where("form IS NOT NULL AND form <> ''").select("key", F.xxhash64("form").alias("f1"), F.xxhash64(F.reverse("form")).alias("f2"), F.xxhash64("text").alias("t1")).distinct()
    spellings = h.groupBy("f1", "f2", "t1").agg(F.count("*").alias("n"), F.min("key").alias("representative"))
    classes = spellings.groupBy("f1", "f2").agg(F.count("*").alias("spellings"), F.sum("n").alias("n_members")).where("spellings > 1").drop("spellings")
    known = spellings.join(classes, ["f1", "f2"])
    return h.join(known, ["f1", "f2", "t1"]).select("key", F.concat(F.hex("f1"), F.hex("f2")).alias("class_id"), "representative", "n_members", (F.col("n_members") - F.col("n")).alias("n_links"))


def p5_input(spark, sf_dir: str) -> DataFrame:
    return spread(clean_blocks(spark, sf_dir).select("block_id", "text")).unionByName(spread(direct_elements(spark, sf_dir).select("block_id", "text")))


def p5_found(spark, sf_dir: str) -> DataFrame:
    return same_looking_pairs(p5_input(spark, sf_dir), "block_id", "text").toDF("block_id_a", "block_id_b")


def p5_forms(spark, sf_dir: str) -> DataFrame:
    return consistent_forms(p5_input(spark, sf_dir), "block_id", "text").select(F.col("key").alias("block_id"), "form").distinct()


def p5_classes(spark, sf_dir: str) -> DataFrame:
    return same_looking_classes(p5_input(spark, sf_dir), "block_id", "text").withColumnRenamed("key", "block_id")


QUERIES = {"p5_found": p5_found, "p5_forms": p5_forms, "p5_classes": p5_classes}
SQL: dict[str, str] = {}
