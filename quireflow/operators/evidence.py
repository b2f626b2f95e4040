"""Furniture evidence of one document as its pages arrive: observe a page, then strip it with what is known so far."""

from __future__ import annotations

import json
import re

MAX_SLOTS = 6
_DIGITS = re.compile("[0-9]+")
_SPACE = re.compile("[ \t\n\x0b\f\r]+")


def page_edges(lines: list[dict]) -> list[tuple[str, str, str, bool, bool]]:
    """(block_id, template, literal, top, narrow) of the lines in the edge slots of a page: at most six and half the page
    at either edge, none beyond the second gap of more than three median line heights."""
    lines = [x for x in lines if x["text"] is not None and x["h"] is not None]
    if not lines:
        return []
    heights = sorted(x["h"] for x in lines)
    far, slots = 3 * heights[len(heights) // 2], min(MAX_SLOTS, len(lines) // 2)
    span = max(x["x"] + x["w"] for x in lines) - min(x["x"] for x in lines)
    middle = {x["block_id"]: x["y"] + x["h"] / 2 for x in lines}
    found: dict[str, bool] = {}
    for top in (True, False):
        order = sorted(lines, key=lambda x: (-middle[x["block_id"]] if top else middle[x["block_id"]], x["block_id"]))
        gaps = 0
        for k, x in enumerate(order[:slots]):
            if k and abs(middle[x["block_id"]] - middle[order[k - 1]["block_id"]]) > far:
                gaps += 1
            if gaps > 1:
                break
            found[x["block_id"]] = found.get(x["block_id"], False) or top
    out = []
    for x in lines:
        if x["block_id"] in found:
            literal = _SPACE.sub(" ", x["text"]).strip(" ")
            if literal:
                out.append((x["block_id"], _DIGITS.sub("#", literal), literal, found[x["block_id"]], x["w"] * 100 <= 75 * span))
    return out


class Evidence:
    """Tallies of a document. ``observe`` counts each page once; ``strip`` gives (block_id, rule) of a page's furniture by
    the evidence so far. Which templates qualify is decided once between two observed pages."""

    def __init__(self, saved: str | None = None) -> None:
        d = json.loads(saved) if saved else {"pages": [], "eligible": [0, 0, 0], "templates": {}, "literals": {}}
        self.pages, self.eligible, self.templates, self.literals = set(d["pages"]), d["eligible"], d["templates"], d["literals"]
        self._rules: dict[str, str | None] = {}

    def save(self) -> str:
        return json.dumps({"pages": sorted(self.pages), "eligible": self.eligible, "templates": self.templates, "literals": self.literals})

    def observe(self, page: int, edges: list[tuple]) -> None:
        if page in self.pages:
            return
        self.pages.add(page)
        self._rules = {}
        if not edges:
            return
        both = (0, 1 + page % 2)
        for k in both:
            self.eligible[k] += 1
        for t in {e[1] for e in edges}:
            for k in both:
                self.templates.setdefault(t, [0] * 7)[k] += 1
        for key in {f"{e[1]}\n{e[2]}" for e in edges}:  # neither holds a line feed
            for k in both:
                self.literals.setdefault(key, [0] * 3)[k] += 1
        for _, t, _, top, narrow in edges:
            self.templates[t][3 if top else 4] += 1
            self.templates[t][5 if narrow else 6] += 1

    def _repeats(self, seen: list[int]) -> bool:
        return seen[0] * 5 >= self.eligible[0] * 3 or any(seen[k] >= 3 and seen[k] * 5 >= self.eligible[k] * 3 for k in (1, 2))

    def _rule(self, template: str, literal: str) -> str | None:
        key = f"{template}\n{literal}"
        if key not in self._rules:
            t, same = self.templates.get(template), self.literals.get(key, [0, 0, 0])
            if not t:
                return None
            often = t[0] >= 3 and self._repeats(t)
            whole = often and len(template) <= 120 and t[5] >= t[6] if "#" in template else often or t[0] >= 2 and t[0] == self.eligible[0]
            gone = whole or same[0] >= 3 and self._repeats(same)
            self._rules[key] = ("remove_repeated_footer" if t[4] >= t[3] else "remove_repeated_header") if gone else None
        return self._rules[key]

    def strip(self, edges: list[tuple]) -> list[tuple[str, str]]:
        return [(e[0], rule) for e in edges if (rule := self._rule(e[1], e[2]))]
