"""Text rules that need a scan from left to right; run in Arrow batches."""

from __future__ import annotations

import unicodedata

PAUSES = ",.;:!?—"
# Fixed value: abbreviations whose full stop is no pause.
ABBREVIATIONS = frozenset("mr mrs ms dr dra prof sr sra srta art arts no núm vol fig p pp cf vs".split())


def is_pause(text: str, i: int) -> bool:
    """Whether the mark at ``i`` is spoken as a pause: not inside a number, a dotted token or an abbreviation."""
    c = text[i]
    if c not in PAUSES:
        return False
    left, right = text[i - 1 : i], text[i + 1 : i + 2]
    if c in ",.:" and left.isdigit() and right.isdigit():
        return False
    if c == ".":
        if left.isalpha() and right.isalpha():
            return False
        token = text[:i].split()[-1].lower() if text[:i].strip() and not text[i - 1].isspace() else ""
        if token in ABBREVIATIONS or "." in token and right:
            return False
    return True


def sentences(text: str) -> list[str]:
    """Split after each pause of ``. ! ?``; pieces trimmed, empty ones dropped, the rest kept."""
    out, start = [], 0
    for i, c in enumerate(text):
        if c in ".!?" and is_pause(text, i):
            out.append(text[start : i + 1].strip())
            start = i + 1
    out.append(text[start:].strip())
    return [s for s in out if s]


def parts(text: str) -> list[tuple[str, str]]:
    """Alternating ('text' | 'punctuation', value) runs."""
    out: list[tuple[str, str]] = []
    for i, c in enumerate(text):
        kind = "punctuation" if is_pause(text, i) else "text"
        if out and out[-1][0] == kind:
            out[-1] = (kind, out[-1][1] + c)
        else:
            out.append((kind, c))
    trimmed = [(k, v.strip()) for k, v in out]
    return [(k, v) for k, v in trimmed if v]


def normalize(text: str, language: str) -> str:
    text = " ".join(unicodedata.normalize("NFC", text).split())
    if language == "en":
        words = text.split(" ")
        for i in range(len(words) - 1):
            if words[i] == "CHAPTER" and words[i + 1].rstrip(PAUSES) == "I":
                words[i], words[i + 1] = "Chapter", "one" + words[i + 1][1:]
        text = " ".join(words)
    return text


def chunks(text: str, limit: int) -> list[str]:
    """Pieces of at most ``limit`` characters, cut after the last strong mark, else a medium one, a comma or a space."""
    out, rest = [], text.strip()
    while len(rest) > limit:
        window = rest[:limit]
        cut = 0
        for marks in (".?!", ";:—", ",", " "):
            cut = next((i + 1 for i in range(limit - 1, 0, -1) if window[i] in marks and (marks == " " or is_pause(rest, i))), 0)
            if cut:
                break
        cut = cut or limit
        out.append(rest[:cut].strip())
        rest = rest[cut:].strip()
    if rest:
        out.append(rest)
    return out


def balanced_chunks(text: str, words: int = 30, reach: int = 8) -> list[str]:
    """Chunks of about equal word counts, ends moved to a mark within ``reach`` words."""
    ws = text.split()
    if not ws:
        return []
    n = -(-len(ws) // words)
    out, start = [], 0
    for k in range(1, n):
        aim = round(k * len(ws) / n)
        near = [i for i in range(max(start + 1, aim - reach), min(len(ws), aim + reach + 1)) if ws[i - 1][-1] in PAUSES and i - start <= words]
        end = min(near, key=lambda i: abs(i - aim)) if near else min(aim, start + words)
        out.append(" ".join(ws[start:end]))
        start = end
    while len(ws) - start > words:
        out.append(" ".join(ws[start : start + words]))
        start += words
    out.append(" ".join(ws[start:]))
    return [c for c in out if c]


_SAME = {"’": "'", "‘": "'", "“": '"', "”": '"', "«": '"', "»": '"', "–": "-", "—": "-", "‐": "-"}


def lcs_pairs(a: str, b: str) -> list[tuple[int, int]]:
    """Index pairs of one longest common subsequence; quotation marks and dashes of a kind are equal."""
    x, y = [_SAME.get(c, c) for c in a], [_SAME.get(c, c) for c in b]
    n, m = len(x), len(y)
    table = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = table[i], table[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x[i] == y[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif table[i + 1][j] >= table[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def lcs_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, a row of the table at a time in the bits of one integer."""
    where: dict = {}
    for i, v in enumerate(a):
        where[v] = where.get(v, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance of code points, a column of the table at a time in the bits of two integers (Myers)."""
    if a == b or not a or not b:
        return 0 if a == b else len(a) or len(b)
    where: dict = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    more, less, n = full, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        v = eq | less
        h = ((eq & more) + more ^ more | eq) & full
        up, down = (less | ~(h | more)) & full, more & h
        n += bool(up & last) - bool(down & last)
        up = up << 1 | 1
        more, less = (down << 1 | ~(v | up)) & full, up & v & full
    return n


def character_error(predicted: str, expected: str) -> tuple[int, int, float, bool]:
    """(edits, code points of the expected text, error rate, at most 5 %), over the NFC forms."""
    got, ref = unicodedata.normalize("NFC", predicted), unicodedata.normalize("NFC", expected)
    n = edit_distance(ref, got)
    return n, len(ref), round(n / len(ref), 6) if ref else float(bool(got)), bool(ref) and n * 100 <= 5 * len(ref)


def repair_runs(text: str, reading: str) -> str:
    """Replace runs of ``# ! U+FFFD`` by what the other reading has between the characters around the run, if that
    is one to four letters, and a ``!`` by a space where it has one."""
    pairs = dict(lcs_pairs(text, reading))
    out, i = [], 0
    while i < len(text):
        if text[i] not in "#!�":
            out.append(text[i])
            i += 1
            continue
        j = i
        while j < len(text) and text[j] in "#!�":
            j += 1
        before, after = pairs.get(i - 1), pairs.get(j)
        gap = reading[before + 1 : after] if before is not None and after is not None else ""
        if 1 <= len(gap) <= 4 and gap.isalpha():
            out.append(gap)
        elif gap.isspace() and text[i:j] == "!":
            out.append(" ")
        else:
            out.append(text[i:j])
        i = j
    return "".join(out)
