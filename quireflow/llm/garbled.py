"""Problem 1: text decoded with the wrong character encoding.

Two detectors share the work. A multi-pattern automaton holds every sequence of two or more characters that
the bytes of one letter or sign turn into under a wrong decoder; such sequences are proof by themselves. When
one byte became one other character ("pßgina"), only the word can tell, so a corpus-wide count of words decides:
a word is garbled if undoing some pair of single-byte decoders gives a word the corpus knows far better.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .common import arrow_rows, clean_blocks, direct_elements, spread

# Decoders by which UTF-8 bytes are commonly misread, and single-byte encodings commonly taken for each other.
MULTI_WRONG = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1254", "cp1256", "cp437", "cp850", "cp866", "koi8-r", "mac_roman")
SINGLE = ("cp1252", "cp1250", "cp1251", "cp437", "cp850", "cp866", "koi8-r", "iso8859-5", "mac_roman")
_TYPOGRAPHIC = "‘’‚“”„†‡•…‰‹›€™–—«»¿¡ºª°·"


def _ranges(*pairs: tuple[int, int]) -> str:
    return "".join(chr(c) for a, b in pairs for c in range(a, b + 1))


def target_characters() -> str:
    """Letters and signs whose garbled forms are precomputed: those of all living scripts in wide use, CJK and Hangul included."""
    european = _ranges((0xA0, 0x24F), (0x370, 0x3FF), (0x400, 0x58F), (0x10A0, 0x10FF), (0x1E00, 0x1FFF))
    asian = _ranges((0x5D0, 0x5EA), (0x600, 0x6FF), (0x900, 0xDFF), (0xE00, 0xEFF), (0x1000, 0x109F), (0x1200, 0x137F), (0x1780, 0x17FF))
    return _TYPOGRAPHIC + european + asian + _ranges((0x2010, 0x2044), (0x3000, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFF01, 0xFF5E))


def wrong_decode(data: bytes, encoding: str) -> str:
    """Decode as lenient software does: bytes the code page leaves undefined become the C1 control of that number."""
    out = []
    for b in data:
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def garbled_sequences() -> dict[str, str]:
    """garbled sequence -> original character, over all pairs and the double application of the commonest decoder."""
    table: dict[str, str] = {}
    for enc in MULTI_WRONG:
        byte = [wrong_decode(bytes([b]), enc) for b in range(256)]
        for ch in target_characters():
            seq = "".join(byte[b] for b in ch.encode("utf-8"))
            if len(seq) > 1 and not seq.isascii():
                table.setdefault(seq, ch)
    once = [wrong_decode(bytes([b]), "cp1252") for b in range(256)]
    for ch in target_characters():
        if ch < "㐀":
            first = "".join(once[b] for b in ch.encode("utf-8"))
            table.setdefault("".join(once[b] for b in first.encode("utf-8")), ch)
    return table


_MARKS = "‘’‚“”„«»‹›…–—¿¡،؛؟\xa0\xad\u200c\u200d"
_ORDINARY = regex.compile("|".join(rf"(?=.*\p{{L}})[\p{{{s}}}{_MARKS}]+" for s in ("Latin", "Cyrillic", "Greek", "Arabic")))
_LETTER = regex.compile(r"\p{L}")
_WITHIN = regex.compile(rf"[^\W_][{_MARKS}]*[“”„«»‹›][{_MARKS}]*[^\W_]")


class Automaton:
    """Aho-Corasick over the garbled sequences, longest match from the left; built once per Python worker."""

    _shared = None

    def __init__(self) -> None:
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for seq, ch in garbled_sequences().items():
            self.machine.add_word(seq, (len(seq), ch))
        self.machine.make_automaton()
        self.quick = regex.compile("[^\x00-\x7f]{2}")

    @classmethod
    def shared(cls) -> Automaton:
        if cls._shared is None:
            cls._shared = cls()
        return cls._shared

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, original) of each garbled sequence, in order and without overlap."""
        if text.isascii() or not self.quick.search(text):
            return []
        found = [(*s, ord(s[2]) >= 0x180 and s[2].isalpha() and self._ordinary(text, s[0], s[1])) for s in self._matches(text, 0, len(text))]
        if not any(weak for *_, weak in found):
            return [s[:3] for s in found]
        # What correct text can hold counts beside another match, or as a whole word of a script that another match proves.
        proven = {self._script(ch) for _, _, ch, weak in found if not weak and ord(ch) >= 0x180}
        touching = {s[0] for s, t in zip(found[1:], found) if s[0] == t[1]} | {s[0] for s, t in zip(found, found[1:]) if s[1] == t[0]}
        out: list[tuple[int, int, str]] = []
        for k, (start, end, ch, weak) in enumerate(found):
            if not weak or start in touching or self._script(ch) in proven and (self._script(ch) == "LATIN" or not _LETTER.search(text[max(0, start - 1) : start] + text[end : end + 1])):
                out.append((start, end, ch))
            else:  # a match that this one hid may begin within it
                upto = found[k + 1][0] if k + 1 < len(found) else len(text)
                out += [s for s in self._matches(text, start + 1, upto) if s[0] < end and not self._ordinary(text, s[0], s[1])]
        return out

    def _matches(self, text: str, start: int, end: int) -> Iterator[tuple[int, int, str]]:
        for last, (n, ch) in self.machine.iter_long(text, start, end):
            if self._plausible(text, last - n + 1, last + 1, ch):
                yield last - n + 1, last + 1, ch

    @staticmethod
    def _script(ch: str) -> str:
        return unicodedata.name(ch, "").split(" ")[0].split("-")[0]

    @staticmethod
    def _ordinary(text: str, start: int, end: int) -> bool:
        """Whether the sequence can stand there in correct text: letters of one script in ordinary case and marks that
        texts set beside letters ("l’été", "صبر،", "КОСТЁЛ»"), no quotation mark within a word."""
        if not _ORDINARY.fullmatch(text, start, end):
            return False
        lo, hi = max(0, start - 1), end + 1
        return not (_WITHIN.search(text, lo, hi) or any(a.islower() and b.isupper() for a, b in zip(text[lo:hi], text[lo + 1 : hi])))

    @staticmethod
    def _plausible(text: str, start: int, end: int, original: str) -> bool:
        """Refuse sequences that correct text can hold: a capital before a no-break space or soft hyphen inside
        a capitalised word, or letters of one script that form part of a longer run of that script."""
        seq = text[start:end]
        before = text[start - 1] if start else " "
        if len(seq) == 2 and seq[1] in "\xa0\xad" and before.isupper():
            return False
        if len(seq) == 2 and seq[0].isalpha() and not original.isalpha() and seq[1] in "»«”“’…—–" and seq[0] != "Â" and seq[0] not in "ВГ":
            return False
        if len(seq) == 2 and seq[1] in "\xa0\xad" and seq[0].islower():
            return False
        if len(seq) == 2 and seq[0] in "ВГ" and "Ѐ" <= before <= "ӿ":
            return False
        if seq.isalpha() and all("Ѐ" <= c <= "ӿ" for c in seq):
            # Cyrillic letters only, which look-alike spelling of Latin words can also produce. Lead bytes of
            # Latin letters show as Г or В; those of Cyrillic as Р or С, and then never once alone.
            if seq[0] == "Г":
                return True
            if seq[0] == "В":
                return seq[1] in "їЎ"
            return seq[0] in "РС" and (text[end : end + 1] in ("Р", "С") or text[max(0, start - 2) : start - 1] in ("Р", "С")) and len(text[end : end + 2] + text[max(0, start - 2) : start]) > 1
        if seq.isalpha() and all("؀" <= c <= "ۿ" for c in seq):
            return False
        return True


def replace_spans(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, last = [], 0
    for a, b, ch in spans:
        out.append(text[last:a])
        out.append(ch)
        last = b
    out.append(text[last:])
    return "".join(out)


# Words with a character beyond ASCII; punctuation of ordinary text parts them, unusual signs do not.
_PART = r"[^\s!-/:-@\[-`{-~‘’‚“”„…–—«»¿¡‹›、。，！？：；「」『』（）《》。　‐-―]+"
_WORD = regex.compile(rf"{_PART}(?:’{_PART})*")
_NON_ASCII = regex.compile(r"[^\x00-\x7f]")
_STRIP = "‘’‚“”„…–—«»¿¡‹›!\"'(),-./:;?[]\xa0 "


def odd_words(text: str) -> set[str]:
    return {w for w in _WORD.findall(text) if not w.isascii()}


def _one_script(word: str) -> bool:
    letters = word.replace("’", "")
    return letters.isalpha() and bool(regex.fullmatch(r"\p{Latin}+|\p{Cyrillic}+|\p{Greek}+", letters))


def undone(word: str) -> dict[str, str]:
    """Every reading of the word with one wrong single-byte decoder undone: bare word to look up -> full reading."""
    out: dict[str, str] = {}
    for wrong in SINGLE:
        try:
            data = word.encode(wrong)
        except UnicodeEncodeError:
            continue
        for right in SINGLE:
            if right == wrong:
                continue
            try:
                full = data.decode(right)
            except UnicodeDecodeError:
                continue
            bare = full.strip(_STRIP)
            if full != word and _one_script(bare) and len(bare) >= len(word) - 2:
                out.setdefault(bare, full)
    return out


def find_garbled(df: DataFrame, key: str, text: str, min_known: int = 4, ratio: int = 4) -> tuple[DataFrame, DataFrame]:
    """(texts, fixes) of garbled texts.

    ``texts``: key, text, n_sequences (automaton matches), n_lost (U+FFFD), after_sequences (text with the matches
    replaced), words (its distinct words beyond ASCII) for every text that holds any character beyond ASCII.
    ``fixes``: word, fixed, proof - the single-byte cases found by corpus counts: a reading must occur in at least
    ``min_known`` records and ``ratio`` times as often as the garbled word. A single letter read as another
    letter ("а" for "à") is no proof by itself (``proof`` false); it is only repaired beside proven words.

    Null, empty and all-ASCII texts give no row. Equal (key, text) rows, such as re-deliveries, are merged.
    Counting shuffles one row per distinct word and partition, never texts; no table is broadcast by force.
    """
    src = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where(F.col("text").rlike("[^\\x00-\\x7f]"))
    src = src.dropDuplicates(["key", "text"])

    def make():
        auto = Automaton.shared()

        def kernel(keys, texts):
            for k, t in zip(keys, texts):
                spans = auto.spans(t)
                fixed = replace_spans(t, spans) if spans else t
                yield k, t, len(spans), t.count("�"), fixed if spans else None, sorted(odd_words(fixed))

        return kernel

    texts = cut(arrow_rows(src, ["key", "text"], "key string, text string, n_sequences int, n_lost int, after_sequences string, words array<string>", make))
    counts = texts.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))

    def make_readings():
        def kernel(words, ns):
            for w, n in zip(words, ns):
                for bare, full in undone(w).items():
                    yield w, n, bare, full

        return kernel

    readings = arrow_rows(counts, ["word", "n"], "word string, n long, bare string, full string", make_readings)
    known = counts.select(F.col("word").alias("bare"), F.col("n").alias("known"))
    best = (
        readings.join(known, "bare")
        .where((F.col("known") >= min_known) & (F.col("known") >= ratio * F.col("n")))
        .groupBy("word")
        .agg(F.max_by("full", F.struct("known", "full")).alias("fixed"))
        .where((F.char_length("word") > 1) | F.col("fixed").rlike("^[^\\p{L}]*\\p{IsLatin}[^\\p{L}]*$"))
        .withColumn("proof", (F.char_length("word") > 1) | ~F.col("word").rlike("^\\p{L}$"))
    )
    return texts, cut(best)


def garbled_records(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, text, repaired, recoverable: one row for each distinct garbled text of a key.

    ``repaired`` has only the matched spans replaced; it is kept, with ``recoverable`` false, where the text
    also lost characters for good (U+FFFD).
    """
    texts, fixes = find_garbled(df, key, text)
    hits = (
        texts.select("key", "text", F.explode("words").alias("word"))
        .join(fixes, "word")
        .groupBy("key", "text")
        .agg(F.map_from_entries(F.collect_list(F.struct("word", "fixed"))).alias("word_fixes"), F.bool_or("proof").alias("proof"))
    )
    bad = texts.join(hits, ["key", "text"], "left").where("n_sequences > 0 OR n_lost > 0 OR proof")

    def make():
        def kernel(keys, raws, lost, afters, maps):
            for k, t, n, after, m in zip(keys, raws, lost, afters, maps):
                fixed = after if after is not None else t
                if m:
                    table = dict(m)
                    fixed = _WORD.sub(lambda x: table.get(x.group(), x.group()), fixed)
                yield k, t, fixed, n == 0

        return kernel

    return arrow_rows(bad, ["key", "text", "n_lost", "after_sequences", "word_fixes"], "key string, text string, repaired string, recoverable boolean", make)


def p1_input(spark, sf_dir: str) -> DataFrame:
    return spread(clean_blocks(spark, sf_dir).select("block_id", "text")).unionByName(spread(direct_elements(spark, sf_dir).select("block_id", "text")))


def p1_found(spark, sf_dir: str) -> DataFrame:
    return garbled_records(p1_input(spark, sf_dir), "block_id", "text").select(F.col("key").alias("block_id")).distinct()


def p1_repaired(spark, sf_dir: str) -> DataFrame:
    return garbled_records(p1_input(spark, sf_dir), "block_id", "text").select(F.col("key").alias("block_id"), "repaired", "recoverable")


QUERIES = {"p1_found": p1_found, "p1_repaired": p1_repaired}
SQL: dict[str, str] = {}
