"""Problem 2: cutting oversized texts into balanced, overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, spread, table

# White space as the limits count it: a run is one character, none at either end.
_RUN = re.compile("[ \t\r\n ]+")
_BLANK = " \t\r\n "
PARAGRAPH, SENTENCE, CLAUSE, SPACE, HARD = 4, 3, 2, 1, 0
_TERM = set(".!?…。！？।॥؟۔")
_CLAUSE = set(",;:、，；：،؛—–")
_CLOSE = set("\"'”’»)]}」』）】›")
_JOIN = re.compile("[̀-ͯ‍️ัิ-ฺ็-๎ऺ-ॏً-ٟ]")


def collapse(text: str) -> tuple[str, list[int]]:
    """The text as it is measured, and for each of its characters the place in the stored text (with one more for the end)."""
    out, at, last = [], [], 0
    start = len(text) - len(text.lstrip(_BLANK))
    end = len(text.rstrip(_BLANK))
    last = start
    for m in _RUN.finditer(text, start, end):
        out.append(text[last : m.start()])
        at.extend(range(last, m.start()))
        run = m.group()
        out.append("\n" if run.count("\n") > 1 else " ")
        at.append(m.start())
        last = m.end()
    out.append(text[last:end])
    at.extend(range(last, end))
    at.append(end)
    return "".join(out), at


def boundary_strength(text: str, cut: int) -> int:
    """How natural a cut before ``text[cut]`` is; -1 where it would part a base character from its mark."""
    before, after = text[cut - 1], text[cut] if cut < len(text) else ""
    if before == "\n":
        return PARAGRAPH
    if after and _JOIN.match(after):
        return -1
    if before == " ":
        i = cut - 2
        while i > 0 and text[i] in _CLOSE:
            i -= 1
        if text[i] in _TERM and (not after or not after.islower()):
            return SENTENCE
        return CLAUSE if text[i] in _CLAUSE else SPACE
    if before in "。！？।" or (before in "」』”" and text[cut - 2] in "。！？"):
        return SENTENCE if after not in "」』”" else HARD
    return CLAUSE if before in "、，；：" else HARD


# Characters before which no natural boundary can lie have none of these on their left.
_MAY = re.compile("[ \n。！？।」』”、，；：]")


class Boundaries:
    """Places of the natural boundaries of a text by strength, found in one pass and looked up by bisection."""

    def __init__(self, text: str) -> None:
        self.at: dict[int, list[int]] = {s: [] for s in (PARAGRAPH, SENTENCE, CLAUSE, SPACE)}
        for m in _MAY.finditer(text):
            s = boundary_strength(text, m.end())
            if s > HARD:
                self.at[s].append(m.end())

    def best(self, aim: int, lo: int, hi: int) -> int | None:
        """The strongest boundary from ``lo`` to ``hi``, of equally strong ones the nearest to ``aim``, the earlier of two."""
        for places in self.at.values():
            k = bisect_left(places, aim)
            left = places[k - 1] if k and places[k - 1] >= lo else None
            right = places[k] if k < len(places) and places[k] <= hi else None
            if left is not None and (right is None or aim - left <= right - aim):
                return left
            if right is not None:
                return right
        return None


def cut_points(text: str, limit: int, overlap: int, reach: float = 0.5) -> list[int]:
    """Cut ends of the pieces of a text over the limit; the last is its length.

    The fewest pieces that can hold the text are tried first, with targets of equal length; each target moves
    to the strongest boundary near it (``reach`` of the free room) that keeps this piece and the rest within
    the limit. If some target finds no boundary at all, one more piece is tried, up to twice as many; only
    then is a word cut. The text is read once; a trial costs a bisection for each piece and ends at the first
    target that fails, and a text with fewer boundaries than cuts is not tried again.
    """
    n_chars = len(text)
    fewest = -(-(n_chars - overlap) // (limit - overlap))
    near = Boundaries(text)
    enough = sum(map(len, near.at.values()))
    fallback = None
    for n in range(fewest, 2 * fewest + 1):
        if fallback is not None and enough < n - 1:
            break
        cuts, natural, step = [], True, (n_chars - overlap) / n
        for i in range(1, n):
            prev = cuts[-1] if cuts else overlap
            lo = max(prev + 1, n_chars - (n - i) * (limit - overlap))
            hi = min((cuts[-1] - overlap if cuts else 0) + limit, n_chars - (n - i))
            aim = min(max(round(overlap + i * step), lo), hi)
            room = max(8, int(step * reach))
            c = near.best(aim, max(lo, aim - room), min(hi, aim + room))
            if c is None:
                natural = False
                if fallback is not None:
                    break
                c = next((c for c in range(aim, lo - 1, -1) if boundary_strength(text, c) >= 0), aim)
            cuts.append(c)
        if natural:
            return [*cuts, n_chars]
        if fallback is None:
            fallback = [*cuts, n_chars]
    return fallback


def split_text(text: str | None, limit: int, overlap: int) -> list[tuple[int, str, int, int]]:
    """(piece_no, piece, char_start, char_end) of a text over the limit, else nothing.

    Pieces are slices of the measured text: each but the first begins with the last ``overlap`` characters of
    the one before, and dropping those overlaps and joining gives the measured text again.
    """
    if not text or len(text) <= limit:
        return []
    measured, at = collapse(text)
    if len(measured) <= limit:
        return []
    out, start = [], 0
    for k, end in enumerate(cut_points(measured, limit, overlap)):
        out.append((k, measured[start:end].replace("\n", " "), at[start], at[end]))
        start = end - overlap
    return out


def split_oversized(df: DataFrame, key: str, text: str, limit: int, overlap: int) -> DataFrame:
    """Pieces (key, piece_no, piece, char_start, char_end) of each text longer than ``limit`` characters.

    Texts within the limit, null and blank texts give no row. A re-delivered record gives one set of pieces:
    equal (key, text) rows are merged, after the cheap length test has left only candidates. Needs
    ``0 <= overlap < limit``. Other columns of ``df`` are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    # The stored length is never below the measured one, so this test loses nothing and is pushed to the scan.
    over = df.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where(F.char_length("text") > limit).dropDuplicates(["key", "text"])

    def make():
        def kernel(keys, texts):
            for k, t in zip(keys, texts):
                for piece in split_text(t, limit, overlap):
                    yield (k, *piece)

        return kernel

    return arrow_rows(over, ["key", "text"], "key string, piece_no int, piece string, char_start int, char_end int", make)


FIELDS = {"audiobook_units.text": ("audiobook_units", "unit_id"), "translation_units.text": ("translation_units", "unit_id")}


def all_pieces(spark, sf_dir: str) -> DataFrame:
    """Pieces of both unit tables under the limits of ``size_limits`` (two rows, read on the driver)."""
    parts = []
    for row in table(spark, sf_dir, "size_limits").collect():
        if row.field_name in FIELDS:
            name, key = FIELDS[row.field_name]
            df = spread(table(spark, sf_dir, name).select(key, "text"))
            parts.append(split_oversized(df, key, "text", row.max_chars, row.overlap_chars).withColumn("field_name", F.lit(row.field_name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumnRenamed("key", "unit_id")


def p2_found(spark, sf_dir: str) -> DataFrame:
    return all_pieces(spark, sf_dir).where("piece_no = 0").select("unit_id").distinct()


def p2_pieces(spark, sf_dir: str) -> DataFrame:
    return all_pieces(spark, sf_dir)


P2_FOUND_SQL = """
WITH t AS (SELECT unit_id, text, 'audiobook_units.text' AS field_name FROM audiobook_units
           UNION ALL SELECT unit_id, text, 'translation_units.text' FROM translation_units)
SELECT DISTINCT unit_id FROM t JOIN size_limits USING (field_name)
WHERE length(trim(regexp_replace(text, '[ \\t\\r\\n\\x{00A0}]+', ' ', 'g'))) > max_chars
"""

QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces}
SQL = {"p2_found": P2_FOUND_SQL}
