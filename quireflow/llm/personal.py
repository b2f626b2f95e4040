"""Problem 9: personal information in free text, by bootstrapped contextual extraction.

Seeds need no context: e-mail addresses, numbers with a country code, identity numbers with check letters. They
vote for the lexical patterns they stand in (the words to the left, the word to the right, the digit grouping),
the patterns vote for further instances, and those for further patterns; three rounds over the bipartite graph
run as joins and aggregates. The patterns and name parts that reach high confidence then read every text.
"""

from __future__ import annotations

import re

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .common import arrow_rows, spread, table

_L = r"\p{L}\p{M}"
_AT = r"(?:\s?@\s?|\s?[\[\(\{<]\s?(?:at|arroba|@|a|chez|bei)\s?[\]\)\}>]\s?|\s(?:arroba|at|AT)\s)"
_DOT = r"(?:\.|\s?[\[\(\{]\s?(?:dot|punto|ponto|point|punkt|\.)\s?[\]\)\}]\s?|\s(?:punto|ponto|dot|point|punkt)\s)"
EMAIL = regex.compile(rf"(?<![\w.+\-@/])[\w][\w.+\-]*{_AT}(?!\d+x\b)[\p{{L}}\d][\p{{L}}\d\-]*(?:{_DOT}[\p{{L}}\d\-]*[\p{{L}}\d])+", regex.I)
_FILE = regex.compile(r"\.(?:png|jpe?g|gif|svg|txt|pdf|mp3|wav)$", regex.I)
# Identity numbers with check letters, and numbers grouped as only identity numbers are.
LETTER_ID = regex.compile(
    r"(?<![\p{L}\d.\-])(?:[XYZxyz][-. ]?\d{7}[-. ]?\p{L}|\d{8}[-. ]?[A-Za-z]|\d{2}\.\d{3}\.\d{3}[-. ]?[A-Za-z]|\p{Lu}{2} ?\d{2} ?\d{2} ?\d{2} ?\p{Lu})(?![\p{L}\d])"
)
SHAPED_ID = regex.compile(r"(?<![\d.\-/(+])\d{3}\.\d{3}\.\d{3}-\d{2}(?![\d\-])")
# Seed labels of identity numbers that consist of digits only.
_ID_LABEL = regex.compile(r"(?:ausweisnummer|ausweis-?nr\.?|steuer-?id\w*|steuernummer|numéro|n° de sécu\w*|codice fiscale|identity number)\s*:?\s*$", regex.I)
_CC = regex.compile(r"^(?:\+|00[1-9]|\(\+)")
_TOKEN = re.compile(r"[^\W\d_]+(?:[’'\-.][^\W\d_]+)*[.]?|\d+|[^\s\w]")

# Kinds of streets, and words for a door.
_STREET_LEAD = r"(?:calle|c/|avenida|avda?\.?|plaza|pza\.?|plza\.?|paseo|pº|camino|ronda|carretera|ctra\.?|travesía|rua|r\.|av\.|travessa|praça|largo|alameda|estrada|rodovia|rue|avenue|boulevard|bd|place|chemin|quai|impasse|allée|all\.|via|viale|corso|piazza|vicolo|largo)"
_STREET_TAIL_EN = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Close|Row|Square|Sq\.?|Way|Terrace|Drive|Dr\.?|Court|Place|Crescent|Hill|Gardens|Mews)"
_STREET_TAIL_DE = rf"(?:[{_L}\-]*(?:straße|strasse|str\.|weg|platz|gasse|allee|ring|ufer|damm|markt|hof|steig|pfad)|[\p{{Lu}}][{_L}\-]*(?:[- ][\p{{Lu}}][{_L}\-]*)*[- ](?:Straße|Strasse|Str\.|Weg|Platz|Gasse|Allee|Ring))"
_CAP = rf"\p{{Lu}}[{_L}’'\-]*"
_PART = r"(?:de|del|la|las|los|el|da|do|das|dos|du|des|le|les|di|della|dei|y|e|sur|sous|am|an|der|im|in|upon|on|of|the|d’|l’)"
_TOWN = rf"{_CAP}(?:[ \-](?:{_PART}[ \-]){{0,3}}{_CAP}){{0,3}}"
_TOWN_LOWER = rf"\p{{Lu}}\p{{Ll}}[{_L}’'\-]*(?:[ \-](?:{_PART}[ \-]){{0,3}}\p{{Lu}}\p{{Ll}}[{_L}’'\-]*){{0,3}}"
_SEP = r"(?:,|\s[–—-])"
_NUM = r"\d{1,4}(?:[ ]?(?:bis|ter|quater)\b|[ ]?[a-zA-Z]\b(?![’'])|-\d{1,3}\b)?"
_DOOR = rf"(?:,\s?(?:piso|planta|puerta|pta\.?|esc\.?|apto\.?|apt\.?|apartamento|andar|sala|bloco|flat|unit|interno|int\.|scala|étage|appt?\.?|bât\.?|Whg\.?|Wohnung|Hinterhaus|fração)\s?(?:\d+[{_L}ºª.]*|\p{{Lu}})(?:\s?\p{{Lu}}\b)?|,\s?\d{{1,2}}\.?[ºªo°]\.?(?:\s?(?:[A-Z]\b|izq\.?|dcha\.?|dta\.?|esq\.?|dto\.?|andar))?)"
_POST = r"(?:\d{5}-\d{3}|\d{4}-\d{3}|\d{4,5})"
_POST_EN = r"(?:[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}|\d{5}(?:-\d{4})?)"
_WORDS = rf"(?:{_PART}\s|l’|d’)*[\p{{Lu}}\d][{_L}’'\-.]*(?:\s(?:{_PART}\s)*\p{{Lu}}[{_L}’'\-]*){{0,4}}"
_TAIL = rf"{_DOOR}{{0,3}}(?:{_SEP}?\s{_POST}(?:{_SEP}?\s{_TOWN})?|{_SEP}\s{_TOWN}(?:\s{_POST}\b)?)?"
ADDRESS = [
    regex.compile(rf"(?<![\p{{L}}«“\"])(?i:{_STREET_LEAD})\s?{_WORDS},?\s(?:(?i:n\.?\s?[ºo°.]{{1,2}}|núm\.?|nº|número)\s?)?{_NUM}(?!\d){_TAIL}"),
    regex.compile(rf"(?<![\p{{L}}\d.,])(?:(?i:flat|apt\.?|apartment|unit|suite)\s\w{{1,4}},\s)?{_NUM}\s(?:{_CAP}\s){{1,4}}{_STREET_TAIL_EN}(?![{_L}])(?:,\s(?i:flat|apt\.?|unit)\s?\w{{1,4}})?(?:{_SEP}\s(?:{_POST_EN}\s)?{_TOWN_LOWER}(?:,?\s{_POST_EN}\b)?)?"),
    regex.compile(rf"(?<![\p{{L}}\d.])\d{{1,4}}(?:\s?(?:bis|ter|[a-zA-Z]\b))?,?\s(?i:rue|avenue|av\.|boulevard|bd|place|chemin|quai|impasse|allée|route|cours)\s{_WORDS}(?:,\s(?i:appt?\.?|bât\.?|étage|esc\.?)\s?\w{{1,4}})?(?:,?\s\d{{5}}(?:\s{_TOWN})?|,\s{_TOWN})?"),
    regex.compile(rf"(?<![\p{{L}}\-]){_STREET_TAIL_DE}\s{_NUM}(?!\d)(?:,\s(?:Whg\.?|Wohnung|App\.?|[0-9]\.\sStock|Hinterhaus)\s?\w{{0,4}})?(?:,?\s\d{{5}}(?:\s{_TOWN})?|,\s{_TOWN})?"),
    regex.compile(rf"(?<![\p{{L}}\-])(?:Am|An der|An dem|Im|In der|Zum|Zur|Auf dem|Unter den|Hinter der|Alte|Alter|Neue|Neuer|Lange|Große|Kleine)\s{_CAP}(?:[ \-]{_CAP})?\s{_NUM}(?!\d),?\s\d{{5}}\s{_TOWN}"),
]

# Names: particles within them, and titles before them that are not part of them.
_PARTICLE = set("de del la las los da do dos das di van von der den du des le y e i".split())
_TITLE = set("dr dra sr sra srta don doña d mr mrs ms miss prof profa herr frau monsieur madame m mme mlle dott".split())
_NAME_TOKEN = regex.compile(rf"[{_L}]+(?:[’'\-][{_L}]+)*\.?|,|\n|[^\s\w]|\d+")


def left_context(text: str, at: int, n: int = 2) -> str:
    """The last ``n`` tokens before ``at``: lower case, digits as 0."""
    toks = _TOKEN.findall(text[max(0, at - 48) : at])
    return " ".join("0" if t.isdigit() else t.lower() for t in toks[-n:])


def right_context(text: str, at: int, n: int = 1) -> str:
    toks = _TOKEN.findall(text[at : at + 32])
    return " ".join("0" if t.isdigit() else t.lower() for t in toks[:n])


_GROUP = re.compile(r"\d+")


def grouping(number: str) -> str:
    """The shape of a number: lengths of its digit groups and what parts them."""
    return _GROUP.sub(lambda m: str(len(m.group())), number.replace(" ", " "))


_NUMBER_AT = re.compile("(?<![A-Za-zÀ-ÿ0-9.,:/(+-])[+(]{0,2}\\d[\\d().\\-/ \u00a0\u2007\u2009\u202f]{5,28}\\d")


def _number_spans(text: str):
    """(start, end) of numbers that could be a phone or identity number: balanced brackets, 7 to 16 digits."""
    for m in _NUMBER_AT.finditer(text):
        a, b = m.span()
        s = text[a:b]
        for stop in (". ", "  ", ") (", " ("):
            k = s.find(stop, 4)
            if k > 0 and not (stop == " (" and s.startswith("+")):
                s = s[:k]
        if s.count("(") != s.count(")"):
            if ")" in s and "(" not in s:
                s = s[: s.index(")")]
            else:
                continue
        s = s.rstrip(" .-/")
        b = a + len(s)
        if text[b : b + 1].isalnum() or text[b : b + 1] == "-" and text[b + 1 : b + 2].isdigit():
            continue
        if 7 <= sum(c.isdigit() for c in s) <= 16:
            yield a, b


_DIGITS_AT = re.compile("\\d(?:[ .-]?\\d){5}")
_EN_NUMBER = re.compile("(?:(?:flat|apt\\.?|apartment|unit|suite) \\w{1,4}, )?(?<![\\w.,])\\d{1,4}(?: ?[a-zA-Z])? (?=[A-ZÀ-Þ])", re.I)
_FR_NUMBER = re.compile("(?<![\\w.])\\d{1,4}(?: ?(?:bis|ter|[a-zA-Z]))?,? $", re.I)
_DE_WORD = re.compile("[A-ZÄÖÜ][\\w -]*\\.?$")
# Literals that an item cannot lack, found in one pass over the lower-case text: what to try there.
_TRIGGERS = {
    "at": ("@", " arroba ", "(arroba)", "[arroba]", "(at)", "[at]", "{at}", "<at>", "( at )", "[ at ]", " at "),
    "lead": ("calle ", "c/", "avenida ", "avda", "avd.", "plaza ", "pza", "plza", "paseo ", "camino ", "ronda ", "carretera ", "ctra", "travesía ", "rua ", "r. ", "av. ", "travessa ", "praça ", "largo ", "alameda ", "estrada ", "rodovia ", "via ", "viale ", "corso ", "piazza ", "vicolo "),
    "tail": (" street", " st", " road", " rd", " lane", " ln", " avenue", " ave", " close", " row", " square", " sq", " way", " terrace", " drive", " dr", " court", " place", " crescent", " hill", " gardens", " mews"),
    "fr": (" rue ", " avenue ", " av. ", " boulevard ", " bd ", " place ", " chemin ", " quai ", " impasse ", " allée ", " route ", " cours "),
    "de": ("straße ", "strasse ", "str. ", "weg ", "platz ", "gasse ", "allee ", "ring ", "ufer ", "damm ", "markt ", "hof ", "steig ", "pfad "),
    "de2": ("am ", "an der ", "an dem ", "im ", "in der ", "zum ", "zur ", "auf dem ", "unter den ", "hinter der ", "alte ", "alter ", "neue ", "neuer ", "lange ", "große ", "kleine "),
}
_DE2_SHAPE = re.compile("(?:Am|An der|An dem|Im|In der|Zum|Zur|Auf dem|Unter den|Hinter der|Alte|Alter|Neue|Neuer|Lange|Große|Kleine) [A-ZÄÖÜ][\\w-]*(?:[ -][A-ZÄÖÜ][\\w-]*)? \\d")
_machine = None


def _triggers():
    global _machine
    if _machine is None:
        import ahocorasick

        by: dict[str, list] = {}
        for kind, words in _TRIGGERS.items():
            for w in words:
                by.setdefault(w, []).append(kind)
        m = ahocorasick.Automaton()
        for w, kinds in by.items():
            m.add_word(w, (len(w), tuple(kinds)))
        m.make_automaton()
        _machine = m
    return _machine


def _lower(text: str) -> str:
    """Lower case of the same length, whatever the script."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def shaped(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what its form alone proves: e-mail addresses, identity numbers with letters, addresses.

    One automaton pass finds the places where an item may be, the full patterns are only tried there.
    """
    out = []
    n = len(text)
    mail_done = 0
    for last, (k, kinds) in _triggers().iter(_lower(text)):
        a = last - k + 1
        for kind in kinds:
            e = None
            if kind == "at":
                if a >= mail_done:
                    e = EMAIL.search(text, max(mail_done, a - 64), min(n, last + 100))
                    if e and e.start() < last and e.end() > a:
                        mail_done = e.end()
                        if not _FILE.search(e.group()):
                            out.append((e.start(), e.end(), "email"))
                continue
            if kind == "lead":
                if a and (text[a - 1].isalnum() or text[a - 1] in "«“\"") or not any(map(str.isdigit, text[last : last + 60])):
                    continue
                e = ADDRESS[0].match(text, a)
            elif kind == "tail":
                if last + 1 < n and text[last + 1].isalpha() or not text[a + 1].isupper():
                    continue
                for m in _EN_NUMBER.finditer(text, max(0, a - 70), a):
                    e = ADDRESS[1].match(text, m.start())
                    if e and e.end() > a:
                        break
                    e = None
            elif kind == "fr":
                m = _FR_NUMBER.search(text, max(0, a - 12), a + 1)
                e = ADDRESS[2].match(text, m.start()) if m else None
            elif kind == "de":
                if last + 1 < n and text[last + 1].isdigit():
                    m = _DE_WORD.search(text, max(0, a - 40), last)
                    e = ADDRESS[3].search(text, m.start(), min(n, last + 80)) if m else None
            elif a == 0 or not text[a - 1].isalnum():
                if _DE2_SHAPE.match(text, a):
                    e = ADDRESS[4].match(text, a)
            if e:
                end = e.end()
                while text[end - 1] in " ,.–—-":
                    end -= 1
                out.append((e.start(), end, "address"))
    done = 0
    for m in _DIGITS_AT.finditer(text):
        if m.start() < done:
            continue
        for p in (LETTER_ID, SHAPED_ID):
            e = p.search(text, max(done, m.start() - 6), min(n, m.end() + 14))
            if e:
                done = e.end()
                out.append((e.start(), e.end(), "id_number"))
                break
    return _disjoint(out)


def _disjoint(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    for s in sorted(spans, key=lambda x: (x[0], -x[1])):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
        elif s[1] - s[0] > out[-1][1] - out[-1][0]:
            out[-1] = s
    return out


_UPPER = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĪİĶŁŃŇŌŐŒŘŚŞŠŤŪŮŰŹŻŽ"
_RUN = re.compile(
    rf"(?<![\w’'-])[{_UPPER}](?:\.|[\w’'-]+)(?:[ \u00a0]?(?<=\.)|[ \u00a0])(?:(?:(?:de|del|la|las|los|da|do|das|dos|di|van|von|der|y|e|du)[ \u00a0])*[{_UPPER}](?:\.(?!\w)|[\w’'-]+)(?:[ \u00a0](?=[{_UPPER}]|(?:de|del|la|las|los|da|do|das|dos|di|van|von|der|y|e|du)[ \u00a0](?:(?:la|las|los|de)[ \u00a0])?[{_UPPER}]))?){{1,6}}"
)
_PARTS = re.compile(r"[\w’'-]+")


def capital_runs(text: str):
    """(start, end, tokens) of runs of two to seven capitalised words, initials and particles on one line, and
    of the later parts of long runs, as a sentence may open with other capitalised words."""
    for m in _RUN.finditer(text):
        toks = list(_PARTS.finditer(text, m.start(), m.end()))
        caps = [i for i, t in enumerate(toks) if t.group()[0].isupper()]
        if len(caps) < 2 or len(caps) > 7:
            continue
        end = toks[caps[-1]].end()
        for skip in range(min(3, len(caps) - 1)):
            i = caps[skip]
            yield toks[i].start(), end, [t.group() for t in toks[i : caps[-1] + 1]], skip == 0


def fold(token: str) -> str:
    return token.lower()


_BESIDE = re.compile(r"\s?[<(,]?\s?(?:[^\W\d_][^\W\d_/ºª°.’']*\s){0,3}")


KINDS = ("email", "phone", "id_number", "address", "name")


def candidates(text: str, proven: list[tuple[int, int, str]], numbers: list[tuple[int, int, str]]):
    """(role, left, shape, right, seed, first, rest) rows for the graph.

    Numbers: role 'number', left context, grouping, right context, seed 'phone', 'id_number' or ''. Names: role
    'name', left context, 'whole' or 'part' of a run, right context, seed 'name' if proof of another kind stands beside it; with the
    run's first token as given name and the others as surnames.
    """
    at = {a: k for a, _, k in proven}
    taken = [(a, b) for a, b, _ in proven]
    for a, b, k in proven:
        if k == "id_number":
            yield "number", left_context(text, a), grouping(text[a:b]), right_context(text, b), "id_number", "", []
    for a, b, left in numbers:
        s = text[a:b]
        seed = "phone" if _CC.match(s) else "id_number" if sum(c.isdigit() for c in s) >= 11 and _ID_LABEL.search(text, max(0, a - 24), a) else ""
        yield "number", left, grouping(s), right_context(text, b), seed, "", []
    for a, b, toks, whole in capital_runs(text):
        if any(x < b and a < y for x, y in taken):
            continue
        seed = ""
        if at:
            near = text[b : b + 26]
            for gap in range(b, b + _BESIDE.match(near).end() + 2):
                if at.get(gap) in ("email", "id_number"):
                    seed = "name"
        yield "name", left_context(text, a, 2), "whole" if whole else "part", right_context(text, b, 2), seed, toks[0], [t for t in toks[1:] if t.lower() not in _PARTICLE]


READ = (
    "key {key}, text string, proven array<int>, number_at array<int>, number_left array<string>, "
    "rows array<struct<role:string,left:string,shape:string,right:string,seed:string,first:string,rest:array<string>>>"
)


def read_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """rid, key, text, proven, number_at, number_left, rows: every text with what one reading finds in it.

    ``proven`` has (start, end, kind) of what its form proves, ``number_at`` (start, end) and ``number_left`` the left
    context of the numbers that need more proof, ``rows`` the candidates for the graph. The table is written once
    and read for learning and for finding, so no pattern runs twice over a text.
    """

    def make():
        def kernel(keys, texts):
            for k, t in zip(keys, texts):
                proven, numbers = [], []
                if t and not t.isspace():
                    proven = shaped(t)
                    taken = [(a, b) for a, b, _ in proven]
                    numbers = [(a, b, left_context(t, a)) for a, b in _number_spans(t) if not any(x < b and a < y for x, y in taken)]
                yield (
                    k, t, [x for a, b, kind in proven for x in (a, b, KINDS.index(kind))], [x for a, b, _ in numbers for x in (a, b)], [c for _, _, c in numbers],
                    list(candidates(t, proven, numbers)) if t else [],
                )

        return kernel

    src = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return cut(arrow_rows(src, ["key", "text"], READ.format(key=dict(src.dtypes)["key"]), make).withColumn("rid", F.monotonically_increasing_id()))


SUPPORT = 3
MOST_SENT = 200_000


def learn(texts: DataFrame, rounds: int = 3) -> DataFrame:
    """role, key, value: the patterns and name parts of high confidence, from what ``read_texts`` found.

    Roles: ``phone`` and ``id_number`` (left context, confidence), ``given`` (name, uses), ``surname``, ``affix`` (first or last
    letters of surnames, confidence) and ``opener`` (words that only stand before names). Everything is counted over
    all texts, and an entry needs ``SUPPORT`` rows however large the input.
    """
    rows = cut(texts.select(F.explode("rows").alias("r")).select("r.*").groupBy("role", "left", "shape", "right", "seed", "first", "rest").agg(F.count("*").alias("n")))

    # Numbers: patterns (left context) and groupings vote for each other, a kind at a time.
    kinds = ("phone", "id_number")
    num = cut(rows.where("role = 'number'").groupBy("left", "shape").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("seed") == k, F.col("n")).otherwise(0)).alias(f"s_{k}") for k in kinds]))
    conf = num.select("*", *[F.least(F.lit(1.0), F.col(f"s_{k}") / F.col("n")).alias(f"c_{k}") for k in kinds])
    for _ in range(rounds):
        votes = lambda by, name: conf.groupBy(by).agg(*[(F.sum(F.col(f"c_{k}") * F.col("n")) / (F.sum("n") + 1)).alias(f"{name}_{k}") for k in kinds])  # noqa: B023, E731
        both = num.join(votes("left", "p"), "left").join(votes("shape", "q"), "shape")
        score = lambda k: F.greatest(F.col(f"s_{k}") / F.col("n"), F.when(F.col(f"p_{k}") >= 0.08, F.sqrt(f"p_{k}")).otherwise(0.0), F.when((F.col(f"p_{k}") >= 0.02) & (F.col(f"q_{k}") >= 0.5), F.col(f"q_{k}")).otherwise(0.0))
        conf = cut(both.select(*num.columns, *[score(k).alias(f"c_{k}") for k in kinds]))
    pats = conf.groupBy("left").agg(*[(F.sum(F.col(f"c_{k}") * F.col("n")) / F.sum("n")).alias(k) for k in kinds], F.sum("n").alias("n")).where(F.col("n") >= SUPPORT)
    numbers = pats.select("left", F.explode(F.array(*[F.struct(F.lit(k).alias("role"), F.col(k).alias("value")) for k in kinds])).alias("e")).where("e.value >= 0.25").select("e.role", F.col("left").alias("key"), F.round("e.value", 3).alias("value"))

    # Names: given names, surnames and contexts vote for each other.
    names = cut(rows.where("role = 'name'").withColumn("id", F.monotonically_increasing_id()))
    ends = lambda t: F.array(F.concat(F.lit("^"), F.substring(F.lower(t), 1, 4)), F.concat(F.substring(F.lower(t), -3, 3), F.lit("$")))
    nodes_of = F.concat(
        F.array(F.concat(F.lit("L:"), "left"), F.concat(F.lit("R:"), "right"), F.concat(F.lit("G:"), F.lower("first"))),
        F.transform("rest", lambda t: F.concat(F.lit("S:"), F.lower(t))),
        F.flatten(F.transform(F.filter("rest", lambda t: F.char_length(t) >= 6), lambda t: F.transform(ends(t), lambda e: F.concat(F.lit("A:"), e)))),
    )
    parts = cut(names.select("id", "n", F.explode(nodes_of).alias("node")))
    conf = names.select("id", "n", F.when(F.col("seed") == "name", 1.0).otherwise(0.0).alias("c"))
    for _ in range(rounds):
        nodes = cut(parts.join(conf.select("id", "c"), "id").groupBy("node").agg((F.sum(F.col("c") * F.col("n")) / (F.sum("n") + 1)).alias("p")))
        voted = parts.join(nodes, "node").groupBy("id").agg(*[F.coalesce(F.avg(F.when(F.col("node").startswith(k), F.col("p"))), F.lit(0.0)).alias(k[0]) for k in ("L:", "R:", "G:", "A:")])
        strong = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) - 0.05) * 4))
        context = F.greatest(strong("L"), strong("R"))
        score = 1 - (1 - context * F.greatest(strong("G"), strong("A"))) * (1 - strong("G") * strong("A"))
        conf = cut(names.select("id", "n", "seed").join(voted, "id").select("id", "n", F.when(F.col("seed") == "name", 1.0).otherwise(score).alias("c")))
    final = parts.join(conf.select("id", "c"), "id").groupBy("node").agg((F.sum(F.col("c") * F.col("n")) / (F.sum("n") + 1)).alias("p"), F.sum("n").alias("n")).where(F.col("n") >= SUPPORT)
    final = cut(final)
    # A given name seldom ends a run; and a word that stands before many different given names ("Ayer Teresa",
    # "Leserin Anke") only opens the sentence or names a role.
    seq = names.where("shape = 'whole'").select("n", F.posexplode(F.transform(F.concat(F.array("first"), "rest"), F.lower)).alias("i", "g"), F.transform(F.concat(F.array("first"), "rest"), F.lower).alias("all"))
    seq = cut(seq.select("g", "n", F.get("all", F.col("i") + 1).alias("next"), (F.col("i") == F.size("all") - 1).alias("last")))
    ends_run = seq.groupBy("g").agg(F.sum("n").alias("uses"), (F.sum(F.when(F.col("last"), F.col("n")).otherwise(0)) / F.sum("n")).alias("last_share"))
    given = final.where("node LIKE 'G:%' AND p >= 0.4 AND length(node) > 3").select(F.expr("substr(node, 3)").alias("g"))
    given = cut(given.where(~F.col("g").isin(*sorted(_PARTICLE | _TITLE))).join(ends_run.where("last_share < 0.3").select("g", "uses"), "g"))
    before = seq.where("next IS NOT NULL").join(given.select(F.col("g").alias("next"), F.lit(1).alias("hit")), "next", "left")
    opener = before.groupBy("g").agg((F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"), F.count_distinct(F.when(F.col("hit") == 1, F.col("next"))).alias("kinds")).where("share >= 0.5 AND kinds >= 4")
    # Surnames are an open class: beside the names themselves, their beginnings and ends have voted.
    sur = parts.join(conf.select("id", "c"), "id").where("node LIKE 'S:%' AND length(node) >= 5").groupBy("node").agg((F.sum(F.col("c") * F.col("n")) / F.sum("n")).alias("p"), F.sum("n").alias("n"))
    sur = sur.where((F.col("p") >= 0.6) & (F.col("n") >= SUPPORT))
    opener = cut(opener)
    entry = lambda d, role, key, value: d.select(F.lit(role).alias("role"), key.alias("key"), F.round(value, 3).alias("value"))
    node = F.expr("substr(node, 3)")
    learnt = [
        numbers,
        entry(opener, "opener", F.col("g"), F.lit(1.0)),
        entry(given.join(opener, "g", "left_anti"), "given", F.col("g"), F.col("uses").cast("double")),
        entry(final.where("node LIKE 'A:%' AND p >= 0.4"), "affix", node, F.col("p")),
        entry(sur, "surname", node, F.lit(1.0)),
    ]
    out = learnt[0]
    for d in learnt[1:]:
        out = out.unionByName(d)
    return cut(out)


_INITIAL = re.compile(rf"(?<![\w.])[{_UPPER}]\.")


class Extractor:
    """Reads a text with the learnt patterns."""

    def __init__(self, learnt: list[tuple[str, str, float]]) -> None:
        by: dict[str, dict[str, float]] = {role: {} for role in ("phone", "id_number", "opener", "given", "affix", "surname")}
        for role, key, value in learnt:
            by[role][key] = value
        self.phone, self.id = by["phone"], by["id_number"]
        surely = {a for a, p in by["affix"].items() if p >= 0.75}
        # A rare word built like the surnames is one that happened to come first.
        self.given = {g for g, uses in by["given"].items() if uses >= 12 or not (len(g) >= 6 and "^" + g[:4] in surely and g[-3:] + "$" in surely)}
        self.head = {a[1:] for a in by["affix"] if a[0] == "^"}
        self.tail = {a[:-1] for a in by["affix"] if a[-1] == "$"}
        self.opener = set(by["opener"])
        self.surname = set(by["surname"]) - self.given - self.opener
        import ahocorasick

        self.givens = ahocorasick.Automaton()
        for g in self.given or {"\0"}:
            self.givens.add_word(g, len(g))
        self.givens.make_automaton()

    def spans(self, text: str | None, proven: list[int], number_at: list[int], number_left: list[str]) -> list[tuple[int, int, str]]:
        """(start, end, kind) of the items of a text, from what ``read_texts`` found in it."""
        if not text or text.isspace():
            return []
        out = [(a, b, KINDS[k]) for a, b, k in zip(proven[::3], proven[1::3], proven[2::3])]
        for a, b, ctx in zip(number_at[::2], number_at[1::2], number_left):
            p, i = self.phone.get(ctx, 0.0), self.id.get(ctx, 0.0)
            if _CC.match(text[a:b]) and text[a] != "0":
                p = max(p, 0.5)
            if max(p, i) >= 0.25:
                out.append((a, b, "phone" if p >= i else "id_number"))
        out = _disjoint(out)
        taken = [(a, b) for a, b, _ in out]
        out += [(a, b, "name") for a, b in self._names(text) if not any(x < b and a < y for x, y in taken)]
        return sorted(out)

    def _is_surname(self, t: str) -> bool:
        w = t.lower()
        return w not in self.opener and w not in self.given and w in self.surname or w not in self.opener and len(w) >= 6 and w[:4] in self.head and w[-3:] in self.tail

    def _names(self, text: str):
        """Sequences of given name, initial, surname and particle classes that make a name, longest first."""
        done = 0
        for lo, hi in self._windows(text):
            toks = list(_NAME_TOKEN.finditer(text, lo, hi))
            i, n = 0, len(toks)
            while i < n:
                t = toks[i].group()
                if toks[i].start() < done or not t[0].isalpha() or not self._may_start(t):
                    i += 1
                    continue
                best = self._longest(text, toks, i)
                if best is None:
                    i += 1
                    continue
                last = toks[best].group()
                end = toks[best].end() - (1 if last[-1] == "." and len(last) > 2 else 0)
                yield toks[i].start(), end
                done = end
                i = best + 1

    def _windows(self, text: str):
        """Stretches of text around given names and initials, without which nothing is a name."""
        low = _lower(text)
        hits = []
        for last, n in self.givens.iter(low):
            a = last - n + 1
            if not (a and low[a - 1].isalnum()) and not low[last + 1 : last + 2].isalnum():
                hits.append(a)
        hits += [m.start() for m in _INITIAL.finditer(text)]
        lo = hi = -1
        for h in sorted(hits):
            a, b = max(0, h - 90), min(len(text), h + 120)
            while a > 0 and (text[a - 1].isalnum() or text[a].isalnum()) and h - a < 130:
                a -= 1
            while b < len(text) and text[b].isalnum() and b - h < 160:
                b += 1
            if a <= hi:
                hi = b
            else:
                if hi > 0:
                    yield lo, hi
                lo, hi = a, b
        if hi > 0:
            yield lo, hi

    def _may_start(self, t: str) -> bool:
        if len(t) == 2 and t[1] == "." and t[0].isupper():
            return True
        w = t.rstrip(".").lower()
        if w in _PARTICLE or w in self.opener:
            return False
        return w in self.given or self._is_surname(w) or len(t) == 2 and t[1] == "." and t[0].isupper()

    def _longest(self, text: str, toks: list, i: int) -> int | None:
        given = initial = sur = 0
        pending = 0
        best = None
        comma = False
        j = i
        ended = False
        while j < len(toks) and j - i < 10 and not ended:
            t = toks[j].group()
            if j > i and text[toks[j - 1].end() : toks[j].start()] not in (" ", " ", " ", " ", "") or j > i and t == "\n":
                break
            w = t.rstrip(".").lower()
            stop = t[-1] == "." and len(t) > 2
            two = toks[j + 1].group().rstrip(".").lower() if j + 1 < len(toks) and not stop else ""
            if t == ",":
                # surnames, given name: a comma is allowed once, after surnames only
                if comma or given or initial or not sur or pending:
                    break
                nxt = two
                if not (nxt in self.given or len(toks[j + 1].group()) == 2 and toks[j + 1].group()[1:] == "." if j + 1 < len(toks) else False):
                    break
                comma = True
            elif len(t) == 2 and t[1] == "." and t[0].isupper():
                if comma and given or sur and not comma:
                    break
                initial += 1
                pending = 0
                if sur and comma:
                    best = j
            elif len(t) == 2 and t[1] == "." or not t[0].isalpha():
                break
            elif comma:
                if w in self.given:
                    given += 1
                    best = j
                    ended = stop
                else:
                    break
            elif w in self.given and not (sur and given):
                if sur and not given and not initial:
                    best = j  # surname first, without a comma: the given name is the last
                    ended = True
                given += 1
                pending = 0
                ended = ended or stop
            elif self._is_surname(w) or (given or initial) and (t[0].isupper() or sur) and len(w) >= 6 and (w[:4] in self.head or w[-3:] in self.tail and t[0].isupper()):
                sur += 1
                pending = 0
                if given or initial:
                    best = j
                ended = stop
            elif w in _PARTICLE and (t.islower() or t.isupper()) and (sur or given or initial) and j + 1 < len(toks):
                k = j + 1
                while k < len(toks) and toks[k].group().lower() in _PARTICLE and k - j < 3:
                    k += 1
                if k >= len(toks) or not self._is_surname(toks[k].group().rstrip(".")):
                    break
                pending = 1
            else:
                break
            j += 1
        return best


_WORDS = regex.compile(r"\w+(?:[’'\-]\w+)*")


def entry_keys(text: str, number_left: list[str]) -> set[str]:
    """All keys under which something learnt could bear on a text: its words and their parts, their beginnings and
    ends, and the left contexts of its numbers."""
    words = set(_WORDS.findall(_lower(text)))
    words |= {p for w in words for p in regex.split("[’'\\-]", w)}
    return words | {"^" + w[:4] for w in words} | {w[-3:] + "$" for w in words} | set(number_left)


def _extract(read: DataFrame, most_sent: int, schema: str, rows) -> DataFrame:
    """Apply ``rows(key, text, spans)`` to every text. What was learnt goes to all tasks if it has at most ``most_sent``
    entries; more are joined to the texts by the keys that can bear on them, and each batch reads with its own."""
    learnt = learn(read)
    found = ["proven", "number_at", "number_left"]
    if learnt.count() <= most_sent:
        entries = [tuple(r) for r in learnt.select("role", "key", "value").collect()]

        def make():
            ex = Extractor(entries)

            def kernel(keys, texts, *parts):
                for k, t, *p in zip(keys, texts, *parts):
                    yield from rows(k, t, ex.spans(t, *p))

            return kernel

        return arrow_rows(read, ["key", "text", *found], schema, make)

    def make_keys():
        def kernel(rids, texts, lefts):
            for r, t, left in zip(rids, texts, lefts):
                for k in entry_keys(t, left) if t else ():
                    yield r, k

        return kernel

    bearing = arrow_rows(read, ["rid", "text", "number_left"], "rid long, key string", make_keys).join(learnt, "key").groupBy("rid").agg(F.collect_set(F.struct("role", "key", "value")).alias("entries"))

    def make_own():
        def kernel(keys, texts, entries, *parts):
            ex = Extractor([(e["role"], e["key"], e["value"]) for es in entries for e in es or ()])
            for k, t, *p in zip(keys, texts, *parts):
                yield from rows(k, t, ex.spans(t, *p))

        return kernel

    return arrow_rows(read.join(bearing, "rid", "left"), ["key", "text", "entries", *found], schema, make_own)


def find_personal(df: DataFrame, key: str, text: str, most_sent: int = MOST_SENT) -> DataFrame:
    """key, char_start, char_end, pii_kind, item for every item of personal information.

    Offsets are code points of the stored text. Null and blank texts give no row, a null key is kept. Other columns
    of ``df`` are ignored.
    """

    def rows(k, t, spans):
        for a, b, kind in spans:
            yield k, a, b, kind, t[a:b]

    read = read_texts(df.where(F.col(text).isNotNull()), key, text)
    return _extract(read, most_sent, f"key {dict(read.dtypes)['key']}, char_start int, char_end int, pii_kind string, item string", rows)


PLACEHOLDERS = {"email": "<EMAIL>", "phone": "<PHONE>", "id_number": "<ID>", "address": "<ADDRESS>", "name": "<NAME>"}


def redact(df: DataFrame, key: str, text: str, most_sent: int = MOST_SENT) -> DataFrame:
    """key, redacted, n_items: the text with typed placeholders for the items and otherwise unchanged.

    Null text stays null. Other columns of ``df`` are ignored.
    """

    def rows(k, t, spans):
        if t is None:
            yield k, None, 0
            return
        out, last = [], 0
        for a, b, kind in spans:
            out += (t[last:a], PLACEHOLDERS[kind])
            last = b
        yield k, "".join([*out, t[last:]]), len(spans)

    read = read_texts(df, key, text)
    return _extract(read, most_sent, f"key {dict(read.dtypes)['key']}, redacted string, n_items int", rows)


def _docs(spark, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p9_found(spark, sf_dir: str) -> DataFrame:
    return find_personal(_docs(spark, sf_dir), "doc_id", "text").select(F.col("key").alias("doc_id"), "char_start", "char_end", "pii_kind").distinct()


def p9_redacted(spark, sf_dir: str) -> DataFrame:
    return redact(_docs(spark, sf_dir), "doc_id", "text").select(F.col("key").alias("doc_id"), "redacted", "n_items")


QUERIES = {"p9_found": p9_found, "p9_redacted": p9_redacted}
SQL: dict[str, str] = {}
