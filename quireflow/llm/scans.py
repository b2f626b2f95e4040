"""Problem 3: text of scanned pages - divided words, misread characters, running heads and folios."""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from math import log

import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .common import arrow_rows, clean_blocks, direct_elements, spread, table

# How recognition misreads print, as (what the page has, what is read).
CONFUSIONS = (
    ("e", "c"), ("c", "e"), ("a", "@"), ("e", "€"), ("i", "ı"), ("i", "|"), ("l", "|"), ("l", "1"), ("i", "1"), ("o", "0"), ("s", "5"), ("g", "9"),
    ("b", "6"), ("ó", "6"), ("o", "6"), ("é", "6"), ("ã", "5"), ("t", "f"), ("f", "t"), ("v", "y"), ("h", "b"), ("b", "h"), ("n", "ri"), ("d", "cl"), ("u", "ii"),
    ("m", "rn"), ("rn", "m"), ("li", "h"), ("h", "li"), ("w", "vv"), ("n", "u"), ("u", "n"), ("l", "i"), ("i", "l"), ("í", "i"), ("B", "8"), ("S", "5"), ("O", "0"), ("I", "l"), ("l", "I"), ("q", "9"), ("z", "2"), ("q", "g"), ("cl", "d"), ("í", "f"), ("f", "í"),
)
_MARKS = "-‐‑¬~=­"
_MARK_END = regex.compile(r"(?<=\p{L})(?:[-‐‑¬~=­]\|?|\|(?=$))\s*$")
_MARKS_OR_BAR = set(_MARKS + "|")
_TRIM = ".,;:!?«»“”„()[]…¿¡—–\"’‘'* "
_TRIM_SET = set(_TRIM)
_DIGITS = str.maketrans({"l": "1", "I": "1", "|": "1", "O": "0", "o": "0", "S": "5", "s": "5", "B": "8", "i": "1"})
_FOLIO = regex.compile(r"^(?P<pre>\W*)(?P<word>[^\W\d_]{1,6}[.,]\s*|p[áa@][g9]\.?\s+)?(?P<num>[0-9lIO|oSsBi]{1,5}|[ivxlcdmIVXLCDM|1]{1,8})(?P<post>\W*)$")
_ROMAN = regex.compile(r"m{0,3}(?:c[md]|d?c{0,3})(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})")
_ROMAN_VALUES = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
HEADER, FOLIO, BODY = 0, 1, 2


def bare(token: str) -> str:
    return token.strip(_TRIM)


def roman(s: str) -> int | None:
    s = s.lower()
    if not s or not _ROMAN.fullmatch(s):
        return None
    total = 0
    for a, b in zip(s, s[1:] + " "):
        v = _ROMAN_VALUES[a]
        total += -v if b != " " and _ROMAN_VALUES[b] > v else v
    return total


def folio_readings(line: str) -> tuple[str, list[int]] | None:
    """(style, possible numbers) of a line that may be only a page number, else None."""
    m = _FOLIO.match(line.strip())
    if not m:
        return None
    num, out = m["num"], []
    digits = num.translate(_DIGITS)
    if digits.isdigit() and (any(c.isdigit() for c in num) or num in ("l", "I", "|", "O") or len(num) <= 4):
        out.append(int(digits))
    for form in {num, num.replace("1", "i").replace("|", "i"), num.replace("l", "i")}:
        r = roman(form)
        if r:
            out.append(r)
    if not out:
        return None
    style = "word" if m["word"] else "roman" if not any(c.isdigit() for c in num) and len(num) > 1 else "bare"
    return style + m["pre"].strip()[:1] + m["post"].strip()[:1], out


_FOLD = str.maketrans(dict(zip("€cé@1|ıl0659fyb!", "eee" + "aiiiioosgtvhi")))


def title_key(line: str) -> str:
    """A key that titles share whatever their case, spacing, page number beside them and misread letters."""
    parts = regex.split(r"\s{2,}", line.strip())
    spaced = len(parts) > 1 and all(len(w) == 1 for p in parts for w in p.split())
    if not spaced and len(parts) > 1:
        parts = [p for p in parts if not (folio_readings(p) and len(p) <= 8)] or parts
    s = "".join(c for c in unicodedata.normalize("NFD", " ".join(parts).casefold()) if not unicodedata.combining(c))
    s = "".join(c for c in s if c.isalnum() or c in "€@|!").translate(_FOLD)
    for a, b in (("ii", "u"), ("ri", "n"), ("ei", "d"), ("rn", "m"), ("ih", "h"), ("hi", "h")):
        s = s.replace(a, b)
    return s


def may_be_title(line: str) -> bool:
    """A cheap test that no running title fails: without end punctuation, not begun in lower case."""
    t = line.rstrip()
    if not t or t[-1] in ".,;:":
        return False
    first = next((c for c in t if c.isalpha()), "")
    return first == "l" or not first.islower()


def _edges(n: int) -> list[int]:
    return sorted({i for i in (0, 1, n - 2, n - 1) if 0 <= i < n})


# Hidden Markov model over the lines of a page. States: header, folio, body; and break, a body line that ends a
# paragraph, which is told from body where paragraphs are put together. What is typed in below is only where the
# estimation starts: the tables are fitted to the pages (``LineModel.fit``).
_START = (0.3, 0.1, 0.6)
_MOVE = ((0.05, 0.25, 0.7), (0.25, 0.05, 0.7), (0.03, 0.05, 0.92))
_LAYOUT = ((0.2, 0.3, 0.5), (0.2, 0.3, 0.5), (0.9, 0.07, 0.03))
PRIOR = 20.0
FIT_PAGES = 1500


def _first_guess(state: int, title: int, folio: int, edge: int) -> float:
    """How likely the text features of an edge line are in a state: it is a repeated title, how well it fits the
    document's folios (0 none, 1 shape of one, 2 the expected number), and its distance from the page edge."""
    if state == HEADER:
        return 0.9 if title else 1e-5
    if state == FOLIO:
        return (1e-7, 0.02, 0.9)[folio] * (0.5 if edge else 1.0)
    return 1e-3 if title else (0.2, 0.05, 1e-4)[folio]


class LineModel:
    """Log probabilities of states, moves and features. Layout of a line: 0 set like the others of its page, 1 smaller
    or set in, 2 both; -1 where the page has no coordinates, which says nothing."""

    def __init__(self, start=_START, move=_MOVE, text=None, layout=_LAYOUT) -> None:
        text = text or [{(t, f, e): _first_guess(s, t, f, e) for t in (0, 1) for f in (0, 1, 2) for e in (0, 1)} for s in range(3)]
        self.raw = (start, move, text, layout)
        self.start = [log(p) for p in start]
        self.move = [[log(p) for p in row] for row in move]
        self.text = [{k: log(p) for k, p in t.items()} for t in text]
        self.layout = [[log(p) for p in row] for row in layout]

    def emissions(self, title: int, folio: int, edge: int, layout: int) -> tuple[float, ...]:
        if edge > 1:
            return -50.0, -50.0, 0.0
        return tuple(self.text[s][title, folio, edge] + (self.layout[s][layout] if layout >= 0 else 0.0) for s in range(3))

    def decode(self, features: list[tuple[int, int, int, int]]) -> list[int]:
        """Most likely states (Viterbi)."""
        return viterbi(self.start, self.move, [self.emissions(*f) for f in features])

    def fit(self, pages: list[list[tuple[int, int, int, int]]], rounds: int = 2) -> LineModel:
        """The model whose tables are the counts over the most likely states of the pages, with the first guess as
        ``PRIOR`` lines of each kind."""
        start0, move0, text0, layout0 = LineModel().raw
        model = self
        for _ in range(rounds):
            start, move = [PRIOR * p for p in start0], [[PRIOR * p for p in row] for row in move0]
            text, layout = [{k: PRIOR * p for k, p in t.items()} for t in text0], [[PRIOR * p for p in row] for row in layout0]
            for page in pages:
                states = model.decode(page)
                for k, (state, (t, f, e, y)) in enumerate(zip(states, page)):
                    if k:
                        move[states[k - 1]][state] += 1
                    else:
                        start[state] += 1
                    if e <= 1:
                        text[state][t, f, e] += 1
                        if y >= 0:
                            layout[state][y] += 1
            share = lambda xs: [x / sum(xs) for x in xs]
            model = LineModel(share(start), [share(r) for r in move], [{k: v / sum(t.values()) for k, v in t.items()} for t in text], [share(r) for r in layout])
        return model


def viterbi(start: list[float], move: list[list[float]], emissions: list[tuple[float, ...]]) -> list[int]:
    if not emissions:
        return []
    n = range(len(start))
    score, back = [start[s] + emissions[0][s] for s in n], []
    for e in emissions[1:]:
        step = [max(n, key=lambda p: score[p] + move[p][s]) for s in n]  # noqa: B023
        back.append(step)
        score = [score[step[s]] + move[step[s]][s] + e[s] for s in n]
    out = [max(n, key=lambda s: score[s])]
    for step in reversed(back):
        out.append(step[out[-1]])
    return out[::-1]


PAGES = "src string, document_id string, page_index int, lines array<struct<block_id:string,line_no:int,text:string>>, layout array<int>, ys array<double>"


def _edge_layout(e: str) -> F.Column:
    """Layout of the first two and last two boxes of an array: one for a height below nine tenths of the page's median,
    one for a left edge more than a median height right of the median left edge."""
    n = F.size(e)
    middle = lambda f: F.get(F.sort_array(F.transform(e, lambda x: x[f])), F.floor(n / 2).cast("int"))
    at = F.filter(F.array(F.lit(0), F.lit(1), n - 2, n - 1), lambda i: (i >= 0) & (i < n))
    box = lambda i: F.get(e, i)
    h, left = middle("h"), middle("x")
    return F.transform(F.array_sort(F.array_distinct(at)), lambda i: F.coalesce((box(i)["h"] < 0.9 * h).cast("int") + (box(i)["x"] > left + h).cast("int"), F.lit(-1)))


def scanned_pages(spark, sf_dir: str) -> DataFrame:
    """One row per scanned page and source ('b' blocks, 'o' recognised lines), its lines in reading order.

    Re-delivered blocks are merged; a re-delivered page of recognised lines stays a second equal row, which no later
    step minds: page counts are distinct and so are results."""
    b = (
        table(spark, sf_dir, "blocks")
        .where("degradation = 'scanned' AND text IS NOT NULL")
        .groupBy("document_id", "page_index")
        .agg(F.array_sort(F.collect_set(F.struct("block_order", "block_id", "text"))).alias("b"))
        .select(F.lit("b").alias("src"), "document_id", "page_index", F.flatten(F.transform("b", lambda x: F.transform(F.split(x["text"], "\n"), lambda t, i: F.struct(x["block_id"].alias("block_id"), i.cast("int").alias("line_no"), t.alias("text"))))).alias("lines"), F.lit(None).cast("array<int>").alias("layout"), F.lit(None).cast("array<double>").alias("ys"))
    )
    o = (
        table(spark, sf_dir, "page_candidates")
        .where("size(ocr_blocks) > 0")
        .withColumn("boxes", F.filter("ocr_blocks", lambda e: e["text"].isNotNull()))
        .select(F.lit("o").alias("src"), "document_id", "page_index", F.transform("boxes", lambda e: F.struct(e["block_id"].alias("block_id"), F.lit(0).alias("line_no"), e["text"].alias("text"))).alias("lines"), _edge_layout("boxes").alias("layout"), F.transform("boxes", lambda e: e["y"]).alias("ys"))
    )
    return b.unionByName(o).where("size(lines) > 0")


def label_lines(pages: DataFrame) -> DataFrame:
    """One row per line of the pages with its label (0 header, 1 folio, 2 body) and, of body lines, its words.

    Evidence beyond the page comes from two small aggregates over the edge lines (at most four a page): on how
    many pages of its document, or of how many documents, a title stands at an edge; and which difference of
    page number and page index a document's folios share.
    """

    def make_edges():
        def kernel(docs, idx, texts):
            for d, p, ts in zip(docs, idx, texts):
                for t in ts:
                    r = folio_readings(t)
                    if r:
                        for n in set(r[1]):
                            yield d, p, None, n - p, r[0]
                    if may_be_title(t) and (key := title_key(t)):
                        yield d, p, key, None, None

        return kernel

    at_edge = F.transform(F.filter("lines", lambda x, i: (i < 2) | (i >= F.size("lines") - 2)), lambda x: x["text"]).alias("texts")
    edges = cut(arrow_rows(pages, ["document_id", "page_index", at_edge], "document_id string, page_index int, key string, shift int, style string", make_edges))
    per_doc = edges.where("key IS NOT NULL").groupBy("document_id", "key").agg(F.count_distinct("page_index").alias("n"))
    repeated = "n >= 2 AND (length(key) >= 5 OR n >= 3)"  # a key of few letters needs a third page
    well_known = per_doc.where(repeated).groupBy("key").agg(F.count("*").alias("docs")).where("docs >= 3").select("key")
    titles = per_doc.where(repeated).select("document_id", "key").unionByName(per_doc.join(well_known, "key", "left_semi").select("document_id", "key")).distinct()
    page_titles = edges.where("key IS NOT NULL").join(titles, ["document_id", "key"], "left_semi").groupBy("document_id", "page_index").agg(F.collect_set("key").alias("titles"))
    shifts = edges.where("shift IS NOT NULL").groupBy("document_id", "shift").agg(F.count_distinct("page_index").alias("n"), F.mode("style").alias("style"))
    shift = shifts.groupBy("document_id").agg(F.max_by(F.struct("shift", "style", "n"), F.struct("n", -F.abs("shift"))).alias("folios"))

    every = edges.select("document_id", "page_index").distinct().join(page_titles, ["document_id", "page_index"], "left").join(shift, "document_id", "left")
    rows = pages.join(every, ["document_id", "page_index"], "left")
    model = fit_model(pages, every)

    def make_lines():
        def kernel(srcs, docs, idx, lines, layouts, titles, folios):
            for s, d, p, ls, lay, ts, fo in zip(srcs, docs, idx, lines, layouts, titles, folios):
                for row in page_lines([x["text"] for x in ls], p, set(ts or ()), fo, lay, model):
                    i, j, *rest = row
                    x, y = ls[i], ls[j] if j is not None else None
                    yield s, d, p, x["block_id"], x["line_no"], y and y["block_id"], y and y["line_no"], *rest

        return kernel

    return arrow_rows(rows, ["src", "document_id", "page_index", "lines", "layout", "titles", "folios"], LINES, make_lines)


def fit_model(pages: DataFrame, every: DataFrame, most: int = FIT_PAGES) -> LineModel:
    """The line model fitted to at most ``most`` pages, the first by hash; only the features of their edge lines, four
    small tuples a page, come to the driver."""
    keys = pages.select("src", "document_id", "page_index").orderBy(F.xxhash64("src", "document_id", "page_index"), "src", "document_id", "page_index").limit(most).distinct()
    chosen = pages.join(F.broadcast(keys), ["src", "document_id", "page_index"], "left_semi").dropDuplicates(["src", "document_id", "page_index"])
    rows = chosen.join(every, ["document_id", "page_index"], "left")

    def make():
        def kernel(idx, lines, layouts, titles, folios):
            for p, ls, lay, ts, fo in zip(idx, lines, layouts, titles, folios):
                yield ([x for f in edge_features([x["text"] for x in ls], p, set(ts or ()), fo, lay) for x in f],)

        return kernel

    flat = arrow_rows(rows, ["page_index", "lines", "layout", "titles", "folios"], "features array<int>", make).collect()
    return LineModel().fit(sorted([tuple(r.features[i : i + 4]) for i in range(0, len(r.features), 4)] for r in flat))


LINES = "src string, document_id string, page_index int, block_id string, line_no int, next_block string, next_line int, label int, opens boolean, last boolean, mark boolean, tail string, head string, first string, words array<string>"


def page_lines(texts: list[str], page: int, titles: set[str], folios: dict | None, layout: list[int] | None = None, model: LineModel | None = None):
    """(line, next body line, label, opens, last, mark, tail, head, first, words) of every line of a page.

    For body lines: the last word without its mark (``tail``), the first word of the next body line of the page
    (``head``), the own first word; ``words`` are its last, its first (null where punctuation closes the line or it has
    but one) and all others; ``opens`` if it is the first of the page, ``last`` if no
    body line follows on the page.
    """
    labels = label_page(texts, page, titles, folios, layout, model)
    body = [i for i, lab in enumerate(labels) if lab == BODY and texts[i].strip()]
    nxt = dict(zip(body, body[1:]))
    real = set(body)
    for i, lab in enumerate(labels):
        if i not in real:
            yield i, None, lab, False, False, None, None, None, None, []
            continue
        mark, tail, inner, first = split_line(texts[i])
        j = nxt.get(i)
        yield i, j, lab, i == body[0], j is None, mark, tail, first_word(texts[j]) if j is not None else None, first, [tail, first, *inner]


def edge_features(texts: list[str], page: int, titles: set[str], folios: dict | None, layout: list[int] | None) -> list[tuple[int, int, int, int]]:
    """(title, folio, edge, layout) of the edge lines of a page, with one line standing for all further in."""
    n = len(texts)
    at = _edges(n)
    feats: list[list[int]] = []
    expected = False
    for k, i in enumerate(at):
        t = texts[i]
        folio = 0
        r = folio_readings(t)
        if r:
            folio = 1
            if folios and folios["n"] >= 2 and page + folios["shift"] in r[1] or r[0][:1] == "w" or len(r[0].strip("brewomand")) and not r[0].startswith("roman"):
                folio = 2
        title = bool(titles) and may_be_title(t) and title_key(t) in titles
        expected = expected or folio == 2
        feats.append([int(title), folio, min(i, n - 1 - i), layout[k] if layout and k < len(layout) else -1])
    if not expected and folios and folios["n"] >= 2:
        for f, i in zip(feats, at):
            r = folio_readings(texts[i]) if f[1] == 1 else None
            if r and f[2] == 0 and r[0] == folios["style"]:
                f[1] = 2
    inner = [[0, 0, 2, -1]] if n > 4 else []
    return [tuple(f) for f in ([*feats[:2], *inner, *feats[2:]] if inner else feats)]


_FIRST = LineModel()


def label_page(texts: list[str], page: int, titles: set[str], folios: dict | None, layout: list[int] | None = None, model: LineModel | None = None) -> list[int]:
    """Labels of the lines of a page. A running head or page number stands at an edge, so all lines further in are body
    or break, and one of them stands for the whole stretch."""
    n = len(texts)
    states = (model or _FIRST).decode(edge_features(texts, page, titles, folios, layout))
    return [*states[:2], *[BODY] * (n - 4), *states[3:]] if n > 4 else states


LONG = 40


def _repairs(word: str) -> set[str]:
    """Words that recognition could have turned into this one by one or two confusions."""
    once = {word[:i] + right + word[i + len(read) :] for right, read in CONFUSIONS for i in _places(word, read)}
    out = set(once)
    if any(c in "@€|ı0123456789" for c in word[:]):
        for w in once:
            out |= {w[:i] + right + w[i + len(read) :] for right, read in CONFUSIONS if read in "@€|ı0156982" for i in _places(w, read)}
    out.discard(word)
    return out


def folded(word: F.Column) -> F.Column:
    """One spelling for all words that confusions turn into each other, however many: letters that are read for two
    become those two, then each is replaced by the first of those it is taken for."""
    for one, two in (("m", "rn"), ("w", "vv"), ("d", "cl"), ("h", "li"), ("u", "n"), ("n", "ri")):
        word = F.replace(word, F.lit(one), F.lit(two))
    first: dict[str, str] = {}
    for a, b in CONFUSIONS:
        if len(a) == len(b) == 1 and not {a, b} & set("mwdhun"):
            x, y = first.setdefault(a, a), first.setdefault(b, b)
            for k, v in first.items():
                if v == y:
                    first[k] = x
    old = "".join(k for k, v in first.items() if k != v)
    word = F.translate(word, old, "".join(first[k] for k in old))
    return F.regexp_replace(word, "(?:ri|ii)", "i")


def _places(word: str, part: str):
    i = word.find(part)
    while i >= 0:
        yield i
        i = word.find(part, i + 1)


# A sign or digit among letters, a letter among digits; and tokens that are no words of a language.
_ODD_FORM = r"\p{L}[@€|0-9!]|[@€|!]\p{L}|ı|(?<![\d.,:/_-])[0-9](?=\p{L}{2})|\d[lOoI]|[lOI]\d"
_PLAIN_FORM = r"_|www\.|\p{L}{2}\.\p{L}{2}|\d\.\p{L}{2}"
_ODD, _PLAIN = regex.compile(_ODD_FORM), regex.compile(_PLAIN_FORM)


def plainly_misread(token: str) -> bool:
    """A token that no spelling holds: a sign or digit among letters, a letter among digits."""
    w = bare(token)
    return w not in ("@", "€") and bool(_ODD.search(w)) and not _PLAIN.search(w)


def raw_words(spark, sf_dir: str, lines: DataFrame) -> DataFrame:
    """token, n, printed: counts of all tokens of clean text and of the inner words of printed lines (their first and
    last words may be parts of words and count 0); ``printed`` if it occurs in a line. Tokens still carry their punctuation."""
    clean = clean_blocks(spark, sf_dir).select("text").unionByName(direct_elements(spark, sf_dir).select("text")).where("text IS NOT NULL")
    a = clean.select(F.explode(F.split("text", "\\s+")).alias("token"), F.lit(1).alias("n"), F.lit(False).alias("printed"))
    b = lines.select(F.posexplode("words").alias("pos", "token")).select("token", F.when(F.col("pos") < 2, 0).otherwise(1).alias("n"), F.lit(True).alias("printed"))
    return a.unionByName(b).where("token IS NOT NULL AND token <> ''").groupBy("token").agg(F.sum("n").alias("n"), F.bool_or("printed").alias("printed"))


def misread_words(vocab: DataFrame, words: DataFrame) -> DataFrame:
    """word, fixed: words of ``words`` (word, n) that are far rarer than a word they may be a misreading of.

    Words of up to ``LONG`` letters are changed by one or two confusions; longer ones, of which too many changes are
    possible, are looked up by a spelling that all confusions share (``folded``)."""

    def make():
        def kernel(ws, ns):
            for w, n in zip(ws, ns):
                for c in _repairs(w):
                    yield w, n, c

        return kernel

    cands = arrow_rows(words.where(F.char_length("word").between(2, LONG)), ["word", "n"], "word string, n long, cand string", make)
    cands = cands.unionByName(words.where(F.char_length("word") > LONG).select("word", "n", folded(F.col("word")).alias("cand")))
    known = vocab.select(F.col("word").alias("cand"), F.col("word").alias("whole"), F.col("n").alias("known"))
    known = known.unionByName(vocab.where(F.char_length("word") > LONG - 2).select(folded(F.col("word")).alias("cand"), F.col("word").alias("whole"), F.col("n").alias("known")))
    return (
        cands.join(known.where("known >= 2"), "cand")
        .where("whole <> word AND (known >= 3 AND known >= 20 * n OR known >= 2 AND n <= 1 AND known >= 3 * n OR known >= 6 * n AND word RLIKE '^[A-ZÁÉÍÓÚÑÀ-Þ]')")
        .groupBy("word")
        .agg(F.max_by("whole", F.struct("known", "whole")).alias("fixed"))
    )


def split_line(text: str) -> tuple[bool, str | None, list[str], str | None]:
    """(has a division mark, last word without it - null if the line ends in punctuation, other words, first word)."""
    core = text.rstrip()
    m = _MARK_END.search(text, max(0, len(core) - 4)) if core[-1:] in _MARKS_OR_BAR else None
    if m:
        core = text[: m.start()]
    ws = core.split()
    if not ws:
        return False, None, [], None
    last = ws[-1]
    tail = last.lstrip(_TRIM) if m or last[-1] not in _TRIM_SET else None
    inner = ws[1:-1] if len(ws) > 1 else []
    if tail is None or not tail:
        inner = [*inner, last] if len(ws) > 1 else inner
        tail = None
    return m is not None, tail, inner, ws[0] if len(ws) > 1 or tail is None else None


def first_word(text: str) -> str | None:
    """The first word of a line that may go on with a divided one, without the marks after it."""
    ws = text.split(None, 1)
    if not ws or ws[0][0] in "«“„(¿¡—":
        return None
    if len(ws) == 1:
        ws = _MARK_END.sub("", text).split() or [""]
    return ws[0].rstrip(_TRIM)


MOST_BROADCAST = 200_000
_TRIM_JVM = "^[.,;:!?«»“”„()\\[\\]…¿¡—–\"’‘'*\\s]+|[.,;:!?«»“”„()\\[\\]…¿¡—–\"’‘'*\\s]+$"


def analyse(spark, sf_dir: str) -> dict[str, DataFrame]:
    """The scanned pages with what is wrong on them: ``pages``, labelled ``lines``, ``divided`` line ends, ``tokens``
    of lines, and the distinct ``bad`` ones with their repair.

    Lines of a page are labelled together; all else is decided by counts of words over the whole corpus, looked up
    by joins on the word. Only the list of misread words is broadcast, if it has at most ``MOST_BROADCAST`` rows.
    """
    pages = cut(spread(scanned_pages(spark, sf_dir)))
    lines = cut(label_lines(pages))
    # Empty words are left out after the cut: before it, the filter would be pushed below the counting, to every token.
    raw = cut(raw_words(spark, sf_dir, lines).withColumn("word", F.regexp_replace("token", _TRIM_JVM, ""))).where("word <> ''")
    vocab = cut(raw.groupBy("word").agg(F.sum("n").alias("n"), F.bool_or("printed").alias("printed")))
    at = ["block_id", "line_no"]
    furniture = lines.where(F.col("label") != BODY).select(*at, F.when(F.col("label") == HEADER, "header").otherwise("folio").alias("noise_kind"))
    body = lines.where((F.col("label") == BODY) & F.col("mark").isNotNull())

    # Line ends. The next body line of a page's last one is the first of the next page, joined by page number.
    page_first = body.where("opens").select("src", "document_id", (F.col("page_index") - 1).alias("page_index"), F.col("block_id").alias("next_block"), F.col("line_no").alias("next_line"), F.regexp_replace(F.coalesce("first", "tail"), "[.,;:!?»”)…’]+$", "").alias("head"))
    columns = [*at, "mark", "tail", "head", "next_block", "next_line"]
    within = body.where("NOT last AND tail IS NOT NULL").select(*columns)
    across = body.where("last AND tail IS NOT NULL").drop("head", "next_block", "next_line").join(page_first, ["src", "document_id", "page_index"]).select(*columns)
    ends = within.unionByName(across).where("head IS NOT NULL AND head <> '' AND (mark OR head RLIKE '^\\\\p{Ll}|^[0-9@€|]')")

    # Whether words are one divided word depends on the words alone: each pair of them is decided once.
    pair = ["mark", "tail", "head"]
    pairs = ends.groupBy(*pair).agg(F.lit(0).alias("n"))
    words = {"joined": F.concat("tail", "head"), "tail": F.col("tail"), "head": F.col("head"), "own": F.concat("tail", F.lit("-"), "head")}
    keys = pairs.select(*pair, F.explode(F.array(*[F.struct(F.lit(k).alias("part"), w.alias("word")) for k, w in words.items()])).alias("k")).select(*pair, "k.part", "k.word")
    counted = keys.join(vocab.select("word", "n"), "word", "left").groupBy(*pair).agg(*[F.coalesce(F.max(F.when(F.col("part") == k, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k in words])
    counted = cut(counted.where("mark OR n_joined > 0 OR n_tail < 2").withColumn("joined", words["joined"]))
    unsure = counted.where("n_joined <= 2 AND (mark OR n_tail <= 2 AND n_head <= 2) AND n_own = 0").groupBy(F.col("joined").alias("word")).agg(F.max("n_joined").alias("n"))
    fixes = misread_words(vocab, unsure).select(F.col("word").alias("joined"), "fixed")
    marked = F.col("mark") & ~(F.col("n_own") > F.col("n_joined"))
    low, high, both = F.least("n_tail", "n_head"), F.greatest("n_tail", "n_head"), F.col("n_joined")
    silent = ~F.col("mark") & (F.col("n_own") == 0) & (
        (both >= 3) & (low * 10 < both) & (high < both * 10) | (both >= 3) & (low * 100 < both) | (both >= 1) & (high <= 1) | F.col("fixed").isNotNull() & (high <= 1)
    )
    decided = counted.join(fixes, "joined", "left").where(marked | silent).select(*pair, "joined", "fixed")
    divided = cut(ends.join(decided, pair).select(*at, "tail", "joined", "fixed", "next_block", "next_line"))

    # Misread words: all words but the parts of divided ones, which are taken out of the few that are found.
    # Patterns and joins run over distinct tokens; the lines are then searched for the few that are wrong.
    tokens = body.select(*at, F.posexplode("words").alias("pos", "token")).where("token IS NOT NULL").select(*at, F.when(F.col("pos") < 2, F.col("pos") + 1).otherwise(0).alias("place"), "token")
    letters = "printed AND word RLIKE '[\\\\p{L}@€|]'"
    printed = raw.where(letters).select("token", "word", (F.col("word").rlike(_ODD_FORM) & ~F.col("word").rlike(_PLAIN_FORM)).alias("plain"))
    repaired = printed.join(misread_words(vocab, vocab.where(letters).select("word", "n")), "word", "left").where("plain OR fixed IS NOT NULL")
    bad = cut(repaired.select("token", F.expr("replace(token, word, coalesce(fixed, word))").alias("repair")))
    return {"pages": pages, "lines": lines, "furniture": furniture, "divided": divided, "tokens": tokens, "bad": bad}


def wrong_tokens(a: dict[str, DataFrame]) -> DataFrame:
    """block_id, line_no, token, repair of every misread word; the list of them is broadcast only if it is short."""
    bad, at = a["bad"], ["block_id", "line_no"]
    hits = a["tokens"].join(F.broadcast(bad) if bad.count() <= MOST_BROADCAST else bad, "token").distinct()
    begun = a["divided"].select(*at, F.lit(1).alias("place"))
    ended = a["divided"].select(F.col("next_block").alias("block_id"), F.col("next_line").alias("line_no"), F.lit(2).alias("place"))
    return hits.join(begun.unionByName(ended).distinct(), [*at, "place"], "left_anti").select(*at, "token", "repair")


def line_noise(spark, sf_dir: str) -> DataFrame:
    """block_id, line_no, noise_kind: every kind of noise of every line of the scanned pages."""
    a = analyse(spark, sf_dir)
    at = ["block_id", "line_no"]
    divided, furniture = a["divided"], a["furniture"]
    wrong = wrong_tokens(a).select(*at)

    # A misread letter of a divided word lies in the line of its part.
    def make_parts():
        def kernel(bs, ns, nbs, nns, tails, joins, fixes):
            for b, n, nb, nn, t, j, f in zip(bs, ns, nbs, nns, tails, joins, fixes):
                h = j[len(t) :]
                if plainly_misread(t) or f and not f.startswith(t):
                    yield b, n
                if plainly_misread(h) or f and not f.endswith(h):
                    yield nb, nn

        return kernel

    parts = arrow_rows(divided, [*at, "next_block", "next_line", "tail", "joined", "fixed"], "block_id string, line_no int", make_parts)
    misread = wrong.unionByName(parts).distinct().withColumn("noise_kind", F.lit("misread"))
    return furniture.unionByName(divided.select(*at, F.lit("hyphen").alias("noise_kind"))).unionByName(misread)


PARAGRAPHS = "src string, document_id string, page_index int, paragraph_no int, text string, glued boolean, open boolean"


BREAK = 3
_ENDS = regex.compile("[.!?…。][»”’\")]*$")
_CAPITAL = regex.compile(r"[^\p{L}\p{N}]*[\p{Lu}\p{Lo}\p{N}]")
# Body and break: how a page begins, how they follow each other, and in each the likelihood of a line that ends a
# sentence, is short, is followed by a wide gap, and by a line that begins with a capital.
_BREAK_START = [log(0.9), log(0.1)]
_BREAK_MOVE = [[log(0.85), log(0.15)], [log(0.9), log(0.1)]]
_BREAK_TRUE = ((0.12, 0.08, 0.02, 0.15), (0.97, 0.92, 0.4, 0.98))


def break_lines(lines: list[str], gaps: list[float | None]) -> list[bool]:
    """Which body lines of a page end a paragraph: the most likely sequence of body and break.

    A line is short below 0.8 of the usual length (three quarters of the lines are no longer); a gap is wide above 1.3
    of the usual one, and says nothing where there are no coordinates."""
    if not lines:
        return []
    usual = sorted(map(len, lines))[(len(lines) * 3) // 4]
    known = sorted(g for g in gaps if g is not None and g > 0)
    wide = 1.3 * known[len(known) // 2] if known else None
    emissions = []
    for k, t in enumerate(lines):
        gap = gaps[k] if k < len(gaps) else None
        seen = (bool(_ENDS.search(t)), len(t) < 0.8 * usual, None if wide is None or gap is None else gap > wide, bool(_CAPITAL.match(lines[k + 1])) if k + 1 < len(lines) else None)
        emissions.append(tuple(sum(log(p if x else 1 - p) for x, p in zip(seen, ps) if x is not None) for ps in _BREAK_TRUE))
    return [s == 1 for s in viterbi(_BREAK_START, _BREAK_MOVE, emissions)]


def page_paragraphs(lines: list[tuple]) -> list[tuple[str, bool, bool]]:
    """(text, glued, open) of the paragraphs of a page from its (text, label, divided[, y]) lines.

    Headers and folios go, divided words are joined, and a line in the break state ends the paragraph; a divided
    line never does. ``open``: the last one does not end a sentence; ``glued``: it even ends within a word.
    """
    body = [(x[0], x[2], x[3] if len(x) > 3 else None) for x in lines if x[1] == BODY and x[0].strip()]
    if not body:
        return []
    gaps = [a[2] - b[2] if a[2] is not None and b[2] is not None else None for a, b in zip(body, body[1:])]
    ends = break_lines([t.strip() for t, _, _ in body], gaps)
    out: list[str] = []
    text, glue = "", True
    for (t, d, _), end in zip(body, ends):
        text += ("" if glue else " ") + (_MARK_END.sub("", t) if d else t.strip())
        glue = d or bool(_MARK_END.search(t))  # a hyphen of the word's own stays, without a space
        if end and not glue:
            out.append(text)
            text, glue = "", True
    done = [(x, False, False) for x in out]
    if text:
        done.append((text, glue, not _ENDS.search(text)))
    return done


def scanned_paragraphs(spark, sf_dir: str) -> DataFrame:
    """src, document_id, first_page, paragraph_no, text: continuous paragraphs of each document and source, repaired.

    A paragraph that is open at the end of a page goes on in the first of the next page. Which paragraphs belong
    together is a running count over the pages of a document, made in blocks of pages so that a long document is
    spread over tasks.
    """
    from .mixing import prefix_sum

    a = analyse(spark, sf_dir)
    at = ["block_id", "line_no"]
    fixes = wrong_tokens(a).where("repair <> token").groupBy(*at).agg(F.collect_set(F.struct("token", "repair")).alias("fixes"))
    text = a["pages"].select("src", "document_id", "page_index", "ys", F.posexplode("lines").alias("seq", "x")).select("src", "document_id", "page_index", "seq", F.get("ys", F.col("seq")).alias("y"), "x.*")
    rows = text.join(a["lines"].select("src", *at, "label"), ["src", *at]).join(fixes, at, "left").join(a["divided"].select(*at, F.lit(True).alias("divided")).distinct(), at, "left")
    pages = rows.groupBy("src", "document_id", "page_index").agg(F.array_sort(F.collect_list(F.struct("seq", "text", "label", F.coalesce("divided", F.lit(False)).alias("divided"), "fixes", "y"))).alias("ls"))

    def make():
        def kernel(srcs, docs, idx, pages):
            for s, d, p, ls in zip(srcs, docs, idx, pages):
                lines = []
                for x in ls:
                    t = x["text"]
                    for f in sorted(x["fixes"] or (), key=lambda f: -len(f["token"])):
                        t = t.replace(f["token"], f["repair"])
                    lines.append((t, x["label"], x["divided"], x["y"]))
                for n, (t, glued, opened) in enumerate(page_paragraphs(lines)):
                    yield s, d, p, n, t, glued, opened

        return kernel

    paras = cut(arrow_rows(pages, ["src", "document_id", "page_index", "ls"], PARAGRAPHS, make))
    page = ["src", "document_id", "page_index"]
    lasts = paras.groupBy(*page).agg(F.max_by("open", "paragraph_no").alias("before_open")).withColumn("page_index", F.col("page_index") + 1)
    started = paras.join(lasts, page, "left").withColumn("starts", F.when((F.col("paragraph_no") == 0) & F.coalesce("before_open", F.lit(False)), 0).otherwise(1))
    chained = prefix_sum(started, ["src", "document_id"], ["page_index", "paragraph_no"], "starts", F.floor(F.col("page_index") / 256), "chain")
    whole = chained.groupBy("src", "document_id", "chain").agg(F.min("page_index").alias("first_page"), F.array_sort(F.collect_list(F.struct("page_index", "paragraph_no", "text", "glued"))).alias("ps"))
    joined = F.aggregate("ps", F.struct(F.lit("").alias("t"), F.lit(True).alias("g")), lambda acc, x: F.struct(F.concat(acc["t"], F.when(acc["g"], "").otherwise(" "), x["text"]).alias("t"), x["glued"].alias("g")), lambda acc: acc["t"])
    return whole.select("src", "document_id", "first_page", (F.col("chain") - 1).alias("paragraph_no"), joined.alias("text"))


def p3_paragraphs(spark, sf_dir: str) -> DataFrame:
    return scanned_paragraphs(spark, sf_dir)


def p3_found(spark, sf_dir: str) -> DataFrame:
    return line_noise(spark, sf_dir).distinct()


QUERIES = {"p3_found": p3_found, "p3_paragraphs": p3_paragraphs}
SQL: dict[str, str] = {}
