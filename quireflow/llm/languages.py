"""Problem 6: the language of documents and of segments in another language, by compression."""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .common import arrow_rows, spread, table
from .forms import _needs, consistent
from .garbled import Automaton, replace_spans
from .sentences import sentence_spans

# ISO 639 codes of three letters and their codes of two letters.
ISO3 = dict(
    spa="es", eng="en", por="pt", fra="fr", fre="fr", deu="de", ger="de", ita="it", rus="ru", zho="zh", chi="zh", cmn="zh", jpn="ja", ara="ar", tha="th",
    hin="hi", kor="ko", nld="nl", dut="nl", pol="pl", tur="tr", ell="el", gre="el", heb="he", ukr="uk", vie="vi", cat="ca", ces="cs", swe="sv",
)
MEANINGLESS = ("", "und", "unknown", "mis", "mul", "zxx", "xx", "n/a", "na", "none", "null", "?", "-")

# Scripts by their Unicode property; kana marks Japanese text, which is compared with Chinese.
_SCRIPTS = {
    name.lower(): regex.compile(rf"\p{{{name}}}")
    for name in (
        "Latin Han Hiragana Katakana Hangul Thai Lao Khmer Myanmar Arabic Hebrew Syriac Devanagari Bengali Gurmukhi Gujarati Oriya Tamil Telugu Kannada Malayalam Sinhala "
        "Cyrillic Greek Armenian Georgian Ethiopic Tibetan Mongolian"
    ).split()
}
_ONE = {"hiragana": "han", "katakana": "han"}
_NOT_LATIN = regex.compile(r"[Ͱ-῿Ⰰ-퟿豈-﫿ﭐ-﷿ﹰ-﻿ｦ-ￜ\U00010000-\U0001EFFF\U00020000-\U0003FFFF]")


def norm_label(col):
    """A label in any notation as a two-letter code; null where it is missing or meaningless."""
    c = F.split(F.lower(F.trim(col)), "[-_ ]")[0]
    mapping = F.create_map(*[F.lit(x) for kv in ISO3.items() for x in kv])
    two = F.coalesce(mapping[c], c)
    return F.when(~F.lower(F.trim(col)).isin(*MEANINGLESS) & two.rlike("^[a-z]{2}$"), two)


def script_of(text: str) -> str:
    """The script of most letters; Chinese characters and kana are one. Latin where there are no letters."""
    if text.isascii() or not _NOT_LATIN.search(text):
        return "latin"
    best, top = "latin", 0
    for name, p in _SCRIPTS.items():
        n = len(p.findall(text))
        if n > top:
            best, top = name, n
    return _ONE.get(best, best)


def settled(text: str) -> bool:
    """Whether the text holds nothing to restore or to bring to one form but white space."""
    return text.isascii() or not (any(map(_needs, set(text))) or Automaton.shared().spans(text))


def prepare(text: str, ready: bool = False) -> str:
    """What is compressed: wrongly decoded spans restored, one consistent form, lower case, digits as one.

    ``ready``: the text is part of one that is ``settled``."""
    if ready:
        text = " ".join(text.split())
    elif not text.isascii():
        spans = Automaton.shared().spans(text)
        if spans:
            text = replace_spans(text, spans)
        text = consistent(text)
    return _DIGITS.sub("0", text.lower())


_DIGITS = regex.compile(r"\d+")


class Profiles:
    """Zstandard compressors, each with the raw text of one language as its dictionary.

    ``known`` has for each language the share of its size to which it compresses nine in ten of its own held-out
    sentences: what it compresses less it does not know, so it is not named as the other language of a sentence.
    """

    def __init__(self, raw: dict[str, bytes], known: dict[str, float] | None = None, level: int = 1) -> None:
        import zstandard as zstd

        self.by = {}
        self.known = known or {}
        self.scripts = defaultdict(list)
        for lang, data in sorted(raw.items()):
            d = zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.by[lang] = zstd.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.scripts[script_of(data.decode("utf-8", "ignore"))].append(lang)

    def candidates(self, text: str) -> list[str]:
        """Languages written in the script of the text; all of them if no language is."""
        return self.scripts.get(script_of(text)) or sorted(self.by)

    def sizes(self, text: str) -> tuple[dict[str, int], int]:
        """Compressed size of prepared text for every language of its script, and its own size in bytes."""
        data = text.encode()
        return {c: len(self.by[c].compress(data)) for c in self.candidates(text)}, len(data)

    def best(self, text: str, prefer: str | None = None) -> tuple[str | None, float]:
        """(language, confidence) of prepared text: smallest size wins; None where the margin is too narrow.

        The margin to pass is 8 bytes and a tenth of the text over the preferred language, 4 bytes (8 if none is
        preferred) and a twentieth over any other; and a language that is not the preferred one must know the text
        (``known``), which a few bytes can never show.
        Every language of the script is tried. Confidence is 1 - smallest/second size, 1 if the script allows one language.
        """
        return self.decide(*self.sizes(text), prefer)

    def together(self, parts: list[tuple[dict[str, int], int]]) -> tuple[str | None, float]:
        """(language, confidence) of a text from the sizes of its sentences, those of its main script counting."""
        by: dict[tuple, list] = {}
        for z, n in parts:
            k = tuple(z)
            if k in by:
                by[k].append((z, n))
            else:
                by[k] = [(z, n)]
        most = max(by.values(), key=lambda v: sum(n for _, n in v)) if len(by) > 1 else next(iter(by.values()))
        if len(most) == 1:
            return self.decide(*most[0])
        return self.decide({c: sum(z[c] for z, _ in most) for c in most[0][0]}, sum(n for _, n in most))

    def decide(self, sizes: dict[str, int], n: int, prefer: str | None = None) -> tuple[str | None, float]:
        if not sizes:
            return None, 0.0
        if len(sizes) == 1:
            return next(iter(sizes)), 1.0
        (a, _, lang), (b, _, _) = sorted((s, c != prefer, c) for c, s in sizes.items())[:2]
        conf = 1 - a / max(b, 1)
        if lang == prefer:
            return lang, conf
        if a > self.known.get(lang, 1.0) * n or prefer in sizes and sizes[prefer] - a < max(8, 0.1 * n):
            return None, conf
        if b - a < max(4 if prefer else 8, 0.05 * n):
            return None, conf
        return lang, conf


def _grams(s: str) -> set:
    """Pairs of neighbouring words; of unspaced text its runs of three characters."""
    words = s.split()
    return set(zip(["", *words], words)) if len(words) > 2 or s.isascii() else {s[i : i + 3] for i in range(len(s) - 2)}


def representative(sents: list[str], limit: int) -> list[str]:
    """Sentences of at most ``limit`` bytes together that cover the commonest phrases: always the one with the most
    uncovered phrases per byte, each weighted by the number of sentences that have it. Commonest last,
    where the compressor finds them nearest."""
    unique = list(dict.fromkeys(sents))
    grams = [_grams(s) for s in unique]
    often = Counter(sents)
    weight: Counter = Counter()
    for s, gs in zip(unique, grams):
        for g in gs:
            weight[g] += often[s]
    size = [len(s.encode()) + 1 for s in unique]
    heap = [(-sum(weight[g] for g in gs) / n, i) for i, (gs, n) in enumerate(zip(grams, size))]
    heapq.heapify(heap)
    seen: set = set()
    out, total = [], 0
    while heap and total < limit:
        _, i = heapq.heappop(heap)
        now = -sum(weight[g] for g in grams[i] if g not in seen) / size[i]
        if heap and now > heap[0][0] + 1e-12:
            if now < 0:
                heapq.heappush(heap, (now, i))
        elif now < 0 and total + size[i] <= limit:
            out.append(unique[i])
            total += size[i]
            seen |= grams[i]
    return out[::-1]


def _dictionaries(by: dict[str, list[list[str]]], limit: int) -> dict[str, bytes]:
    chosen = {lang: representative([s for t in texts for s in t if len(s) >= 8], limit) for lang, texts in by.items()}
    return {lang: "\n".join(c).encode() for lang, c in chosen.items() if c}


def train(by: dict[str, list[list[str]]], folds: int = 3, judge_bytes: int = 16384, dict_bytes: int = 49152) -> tuple[dict[str, bytes], dict[str, float]]:
    """(dictionaries, known) from texts by label, each a list of prepared sentences.

    Labels may be wrong and texts mixed: each fold is judged by small dictionaries of the commonest phrases of the
    others. A text goes if another language compresses it better by a twentieth, a sentence if one that knows it
    does by a twelfth; what no language knows stays under its label.
    """
    kept: dict[str, list[str]] = defaultdict(list)
    own: dict[str, list[float]] = defaultdict(list)
    for f in range(folds):
        judge = Profiles(_dictionaries({lang: [t for i, t in enumerate(v) if i % folds != f] for lang, v in by.items()}, judge_bytes))
        for lang, texts in by.items():
            for sents in texts[f::folds]:
                if not sents:
                    continue
                if lang not in judge.by:  # a label with a single text has no other fold to judge it
                    kept[lang] += sents
                    continue
                z, n = judge.sizes(" ".join(sents))
                if lang not in z or min(z.values()) < z[lang] - 0.05 * n:
                    continue
                for s in sents:
                    z, n = judge.sizes(s)
                    if lang in z and not (z[lang] - min(z.values()) > max(4, 0.08 * n) and min(z.values()) <= 0.65 * n):
                        kept[lang].append(s)
                        own[lang].append(z[lang] / max(n, 1))
    known = {lang: min(0.8, max(0.7, sorted(v)[int(0.9 * (len(v) - 1))])) for lang, v in own.items()}
    return _dictionaries({lang: [v] for lang, v in kept.items()}, dict_bytes), known


def _sample(labelled: DataFrame, text: str, label: str, stratum: str, per_label: int, max_chars: int, seed: int) -> DataFrame:
    """l, t: at most ``per_label`` distinct texts of each label, from its strata in turn, those of a stratum by seeded hash.

    Ranking moves only hashes, and copies of a text are one before it; the texts of the few chosen are then
    looked up, so neither a hot label nor a hot text gathers in one task."""
    rows = (
        labelled.select(F.col(text).alias("t"), norm_label(F.col(label)).alias("l"), F.col(stratum).alias("s"))
        .where((F.char_length("t") <= max_chars) & (F.char_length(F.trim("t")) >= 40) & F.col("l").isNotNull())
        .withColumn("h", F.xxhash64(F.lit(seed), "t"))
    )
    within, across = Window.partitionBy("l", "s").orderBy("h"), Window.partitionBy("l").orderBy("r", "h")
    ranked = rows.groupBy("l", "s", "h").agg(F.lit(1).alias("one")).withColumn("r", F.row_number().over(within)).where(F.col("r") <= per_label)
    chosen = ranked.withColumn("n", F.row_number().over(across)).where(F.col("n") <= per_label).select("l", "h").distinct()
    return rows.join(F.broadcast(chosen), ["l", "h"]).groupBy("l", "h").agg(F.min("t").alias("t")).select("l", "h", "t")


def fit_profiles(tables: list[DataFrame], text: str, label: str, stratum: str, per_label: int = 400, max_chars: int = 4000, seed: int = 0) -> tuple[dict[str, bytes], dict[str, float]]:
    """Dictionaries and ``known`` from a bounded sample of labelled rows.

    Of each label every table gives an equal part of ``per_label`` distinct texts of 40 to ``max_chars`` characters,
    drawn from its strata in turn, so the sample is bounded by labels x per_label x max_chars whatever the size of
    the tables. Sentences are split and prepared on the executors; choosing among them is the driver's.
    """
    each = -(-per_label // len(tables))
    drawn = [_sample(t, text, label, stratum, each, max_chars, seed) for t in tables]
    rows = drawn[0]
    for d in drawn[1:]:
        rows = rows.unionByName(d)

    def make():
        def kernel(labels, hashes, texts):
            for lang, h, t in zip(labels, hashes, texts):
                yield lang, h, [prepare(t[a:b]) for a, b in sentence_spans(t)]

        return kernel

    by: dict[str, list[list[str]]] = defaultdict(list)
    for r in sorted(arrow_rows(rows.repartition(rows.sparkSession.sparkContext.defaultParallelism), ["l", "h", "t"], "l string, h long, sents array<string>", make).collect(), key=lambda r: (r.l, r.h)):
        by[r.l].append(r.sents)
    return train(by)


def segment_languages(df: DataFrame, keys: list[str], text: str, profiles: tuple[dict[str, bytes], dict[str, float]], parts: str | None = None) -> DataFrame:
    """keys, language, confidence, n_chars, segments: the language of each text and of its sentences in another one.

    ``segments`` holds (char_start, char_end, language, confidence) of the sentences whose language is surely
    not that of the whole text; ``parts`` may name a boolean column, which tells for which rows they are wanted.
    Null and blank texts have null language and no segments; so has a text whose margin is too narrow.
    Re-delivered rows give equal rows. Other columns of ``df`` are ignored.
    """

    def make():
        p = Profiles(*profiles)

        def kernel(*cols):
            for *ks, want, t in zip(*cols):
                if not t or t.isspace():
                    yield (*ks, None, 0.0, 0, [])
                    continue
                if not want:
                    whole, conf = p.best(prepare(t))
                    yield (*ks, whole, conf, len(t), [])
                    continue
                spans = sentence_spans(t)
                ready = settled(t)
                sizes = [p.sizes(prepare(t[a:b], ready)) for a, b in spans]
                whole, conf = p.together(sizes)
                other = []
                if len(spans) > 1:
                    for (a, b), (z, n) in zip(spans, sizes):
                        lang, c = p.decide(z, n, whole)
                        if lang is not None and lang != whole:
                            other.append((a, b, lang, c))
                yield (*ks, whole, conf, len(t), other)

        return kernel

    ddl = ", ".join(f"{k} {t}" for k, t in df.select(*keys).dtypes)
    wanted = (F.col(parts) if parts else F.lit(True)).alias("_parts")
    return arrow_rows(df, [*keys, wanted, text], f"{ddl}, language string, confidence double, n_chars int, segments array<struct<char_start:int,char_end:int,language:string,confidence:double>>", make)


def _fit(spark, sf_dir: str, seed: int = 0) -> tuple[dict[str, bytes], dict[str, float]]:
    docs = table(spark, sf_dir, "documents").selectExpr("text", "lang AS label", "source AS stratum")
    units = table(spark, sf_dir, "audiobook_units").selectExpr("text", "substring_index(voice_id, '-', -1) AS label", "voice_id AS stratum")
    return fit_profiles([docs, units], "text", "label", "stratum", seed=seed)


def classified_blocks(spark, sf_dir: str, parts: str = "degradation IS NULL") -> DataFrame:
    """The blocks with their language, and those for which ``parts`` holds with their segments in another one."""
    blocks = table(spark, sf_dir, "blocks").where("degradation IS NULL OR degradation = 'scanned'").selectExpr("document_id", "block_id", "degradation IS NULL AS clean", f"{parts} AS parts", "text")
    return cut(segment_languages(spread(blocks, per_core=4), ["document_id", "block_id", "clean"], "text", _fit(spark, sf_dir), "parts").dropDuplicates(["block_id"]))


def main_languages(blocks: DataFrame) -> DataFrame:
    """document_id, main, confidence: the language of most of a document's blocks, of its scanned ones if there are no others."""
    votes = blocks.where("language IS NOT NULL").groupBy("document_id", "language").agg(F.count_if("clean").alias("n_clean"), F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    per = votes.groupBy("document_id").agg(F.max_by("language", F.struct("n_clean", "n", "chars", "language")).alias("main"), F.max("n").alias("top"), F.sum("n").alias("all"))
    return per.select("document_id", "main", (F.col("top") / F.col("all")).alias("confidence"))


def document_findings(spark, sf_dir: str) -> DataFrame:
    """document_id, block_id, language, confidence: wrong or missing labels (empty block_id) and blocks in, or with a sentence in, another language."""
    blocks = classified_blocks(spark, sf_dir)
    main = main_languages(blocks)
    manifest = table(spark, sf_dir, "manifest").select("document_id", norm_label(F.col("language")).alias("label")).distinct()
    labels = main.join(manifest, "document_id").where("label IS NULL OR label <> main").selectExpr("document_id", "'' AS block_id", "main AS language", "confidence")
    per_block = blocks.where("clean").join(main.select("document_id", "main"), "document_id")
    whole = per_block.where("language IS NOT NULL AND language <> main").select("document_id", "block_id", "language", "confidence")
    parts = per_block.where("size(segments) > 0").select("document_id", "block_id", "main", F.explode("segments").alias("s")).where("s.language <> main").selectExpr("document_id", "block_id", "s.language AS language", "s.confidence AS confidence")
    return labels.unionByName(whole).unionByName(parts)


def p6_found(spark, sf_dir: str) -> DataFrame:
    return document_findings(spark, sf_dir).select("document_id", "block_id", "language").distinct()


def p6_languages(spark, sf_dir: str) -> DataFrame:
    """document_id, block_id, char_start, char_end, language, confidence.

    A row for every manifest document with its main language, null where no text could be read (null block and
    offsets); and one for every segment in another language: a whole block, or a sentence of one."""
    blocks = classified_blocks(spark, sf_dir, "true")
    main = main_languages(blocks)
    documents = table(spark, sf_dir, "manifest").select("document_id").distinct().join(main, "document_id", "left")
    documents = documents.selectExpr("document_id", "cast(null AS string) AS block_id", "cast(null AS int) AS char_start", "cast(null AS int) AS char_end", "main AS language", "confidence")
    per_block = blocks.join(main.select("document_id", "main"), "document_id")
    whole = per_block.where("language <> main").selectExpr("document_id", "block_id", "0 AS char_start", "n_chars AS char_end", "language", "confidence")
    parts = per_block.where("size(segments) > 0").select("document_id", "block_id", "main", F.explode("segments").alias("s")).where("s.language <> main").select("document_id", "block_id", "s.*")
    return documents.unionByName(whole).unionByName(parts)


QUERIES = {"p6_found": p6_found, "p6_languages": p6_languages}
SQL: dict[str, str] = {}
