"""The labelled table of the page classifier: pages put together by rule, whose wanted parts carry ``data-wanted``
and parts inside them that are not, ``data-dropped``.

Four kinds of markup: elements that name their part (``nav``, ``article``), boxes that name it by a class or id, boxes with
names that say nothing, and no names at all. In the last two only words, links and their neighbours tell the parts
apart, so such pages have no part that a reader could not tell by them either.
"""

from __future__ import annotations

import random

_SYLLABLES = ("ba", "cor", "den", "el", "fi", "gra", "hol", "im", "ka", "lu", "mo", "ner", "os", "pri", "qua", "ri", "sta", "tu", "ven", "wi")
KINDS = ("elements", "names", "hashes", "bare")
# How the second kind of page names its parts.
_NAMES = {
    "menu": ("nav", "menu", "navbar", "breadcrumbs"), "top": ("header", "masthead", "banner"), "notice": ("cookie-notice", "consent", "alert"), "ad": ("ad", "advert", "sponsored", "promo"),
    "story": ("content", "post", "entry", "story"), "side": ("sidebar", "widget", "related"), "comments": ("comments", "replies", "respond"), "bottom": ("footer", "legal", "copyright"),
    "form": ("newsletter", "search", "login"),
}
_ELEMENTS = {"menu": "nav", "top": "header", "side": "aside", "bottom": "footer", "form": "form"}


class _Writer:
    def __init__(self, rng: random.Random, kind: str):
        self.rng, self.kind, self.telling = rng, kind, kind in ("elements", "names")
        self.inside = False

    def words(self, low: int, high: int) -> str:
        n = self.rng.randint(low, high)
        return " ".join("".join(self.rng.choices(_SYLLABLES, k=self.rng.randint(1, 4))) for _ in range(n)).capitalize() + self.rng.choice((".", ".", "!", ""))

    def link(self, low: int, high: int) -> str:
        return f'<a href="/x">{self.words(low, high)}</a>'

    def box(self, part: str, inside: str, wanted: bool = False) -> str:
        mark, rng = " data-wanted" if wanted else " data-dropped" if self.inside else "", self.rng
        if self.kind == "elements":
            tag = rng.choice(("article", "main")) if part == "story" else _ELEMENTS.get(part)
            if tag:
                return f"<{tag}{mark}>{inside}</{tag}>"
        plain = self.kind == "elements" and part in ("ad", "notice", "comments") and not self.inside and rng.random() < 0.6
        if self.telling and not plain:
            return f'<div {rng.choice(("class", "id"))}="{rng.choice(_NAMES[part])}"{mark}>{inside}</div>'
        name = f' class="{"".join(rng.choices("bcdfghjk0123456789", k=7))}"' if self.kind == "hashes" else ""
        return f"<div{name}{mark}>{inside}</div>"

    def links(self, low: int, high: int) -> str:
        each = [self.link(1, 4) for _ in range(self.rng.randint(low, high))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in each) + "</ul>" if self.rng.random() < 0.7 else "".join(f"<p>{x}</p>" for x in each)

    def story(self) -> str:
        rng, out = self.rng, []
        if rng.random() < 0.85:
            out.append(f"<h{rng.randint(1, 2)}>{self.words(1, 14)}</h1>")
        for _ in range(rng.choice((1, 2, 4, 6, 9))):
            roll = rng.random()
            if roll < 0.12 and out:
                out.append(f"<p>{self.words(1, 9)}</p>")
            elif roll < 0.2:
                out.append(f"<p>{self.words(15, 40)} {self.link(2, 5)} {self.words(8, 30)}</p>")
            elif roll < 0.25:
                out.append("<ul>" + "".join(f"<li>{self.words(2, 12)}</li>" for _ in range(rng.randint(2, 4))) + "</ul>")
            elif roll < 0.3:
                out.append(f"<h3>{self.words(1, 6)}</h3><p>{self.words(20, 60)}</p>")
            elif roll < 0.33 and len(out) > 1:
                out.append(f"<p>{self.link(3, 9)}</p><p>{self.words(25, 60)}</p>")
            elif roll < 0.38 and self.telling:
                out.append(self.box("ad", f"<p>{self.words(3, 30)}</p>"))
            else:
                out.append(f"<p>{self.words(16, 140)}</p>")
        if not self.telling:
            out.append(f"<p>{self.words(25, 90)}</p>")
        return "".join(out)

    def page(self) -> str:
        rng, out = self.rng, []
        if rng.random() < 0.5 and self.telling:
            out.append(self.box("top", f"<h1>{self.words(1, 3)}</h1>" if rng.random() < 0.5 else f"<p>{self.words(3, 14)}</p>"))
        if rng.random() < 0.85:
            out.append(self.box("menu", self.links(2, 9)))
        if rng.random() < 0.3 and self.telling:
            out.append(self.box("notice", f"<p>{self.words(8, 45)} {self.link(1, 3)}</p>"))
        if rng.random() < 0.5:
            out.append(self.box("ad", self.words(3, 30) if self.telling else f"<p>{self.words(1, 4)} {self.link(2, 6)}</p>"))
        if rng.random() < 0.25:
            out.append(self.box("form", f"<label>{self.words(1, 4)}</label>"))
        self.inside = True
        inside = self.story()
        self.inside = False
        out.append(self.box("story", inside, wanted=True))
        if rng.random() < 0.4:
            side = "".join(f"<h4>{self.link(2, 6)}</h4>" + (f"<p>{self.words(6, 35)}</p>" if self.telling else "") for _ in range(rng.randint(2, 4)))
            out.append(self.box("side", side))
        if rng.random() < 0.4 and self.telling:
            out.append(self.box("comments", f"<h3>{self.words(1, 2)}</h3>" + "".join(f"<p>{self.words(2, 50)}</p>" for _ in range(rng.randint(1, 4)))))
        if rng.random() < 0.8:
            out.append(self.box("bottom", f"&copy; {self.words(1, 14)}" if self.telling else f"<p>&copy; {self.link(1, 2)} {self.link(1, 3)} {self.words(1, 3)}</p>"))
        return f"<html><head><title>t</title></head><body>{''.join(out)}</body></html>"


def sample_pages(n: int, seed: int, kinds: tuple[str, ...] = KINDS) -> list[str]:
    """``n`` pages, the kinds in turn; the same for one seed."""
    rng = random.Random(seed)
    return [_Writer(rng, kinds[k % len(kinds)]).page() for k in range(n)]
