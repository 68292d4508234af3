"""Labelled pages for the extraction model: layouts drawn at random around texts of the corpus, with their main text marked.

An element with LABEL="1" is main text with all inside it, but for what an element with LABEL="0" marks as none; all else on a page is none. Names
of tags, classes and ids vary from page to page, many layouts have none that tell, and end tags are left out as authors do.
"""

from __future__ import annotations

import html
import random
from collections.abc import Sequence

LABEL = "data-main"

#: What sites call the parts of a page, by part. Short lists of words as they are used in classes and ids.
MAIN = ("article", "content", "post", "entry", "main", "story", "body", "text", "entry-content", "post-body", "article-body", "main-content", "page-content", "articleText", "single", "prose")
NAV = ("nav", "menu", "navbar", "navigation", "topnav", "main-menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "tabs", "links", "skip")
HEADER = ("header", "masthead", "top", "site-header", "branding", "logo", "topbar", "page-header", "banner")
FOOTER = ("footer", "site-footer", "bottom", "copyright", "legal", "colophon", "credits", "foot")
SIDE = ("sidebar", "aside", "widget", "rail", "right-col", "secondary", "related", "recommended", "popular", "trending", "more", "tags", "archive", "secondary-column", "see-also")
NOTICE = ("notice", "cookie", "cookie-notice", "consent", "alert", "warning", "message", "gdpr", "popup", "modal", "overlay", "announcement", "disclaimer", "banner", "info-bar", "paywall", "privacy")
ADVERT = ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense", "ad-slot", "banner-ad", "partner", "offer")
SHARE = ("share", "social", "share-buttons", "follow", "buttons", "tools", "print", "byline-tools")
COMMENTS = ("comments", "comment", "replies", "reply", "responses", "discussion", "commentlist", "comment-list", "reactions", "feedback", "respond", "reader-comments", "thread", "reviews")
FORM = ("search", "form", "login", "signup", "subscribe", "newsletter", "contact-form", "searchbox", "register", "subscription")
PLAIN = ("row", "col", "box", "wrap", "inner", "container", "block", "item", "grid", "left", "c1", "x7", "module", "section", "clearfix", "layout", "panel", "content-wrap", "page")


class Layout:
    """One page's habits."""

    def __init__(self, rng: random.Random, prose: Sequence[str], shorts: Sequence[str]):
        self.rng, self.prose, self.shorts = rng, prose, shorts
        #: How much a page says in tags and in classes.
        self.tags, self.names = rng.choice(((0.9, 0.9), (0.9, 0.2), (0.15, 0.9), (0.5, 0.5), (0.05, 0.15)))
        self.loose = rng.random() < 0.3
        #: Some pages' main text is no prose: lists of words, one word again and again, lines of a word or two.
        self.odd = rng.choice(("joined", "again", "lines")) if rng.random() < 0.12 else ""

    def element(self, inside: str, tag: str, names: Sequence[str], other: str = "div", mark: str = "") -> str:
        rng = self.rng
        name = tag if rng.random() < self.tags else other
        words = list(names) if rng.random() < self.names else [*PLAIN, "", "", ""]
        held = rng.choice(words)
        if held and rng.random() < 0.25:
            held += rng.choice(("-", "_", " ")) + rng.choice(PLAIN)
        attrs = f' {rng.choice(("class", "class", "id", "role"))}="{held}"' if held else ""
        if mark:
            attrs += f' {LABEL}="{mark}"'
        if rng.random() < 0.2:
            inside = f'<div class="{rng.choice(PLAIN)}">{inside}</div>'
        return f"<{name}{attrs}>{inside}</{name}>"

    def ended(self, tag: str) -> str:
        return "" if self.loose and self.rng.random() < 0.6 else f"</{tag}>"

    def words(self, least: int, most: int) -> str:
        held = self.rng.choice(self.prose).split()
        n = self.rng.randint(least, most)
        at = self.rng.randrange(max(1, len(held) - n))
        return html.escape(" ".join(held[at : at + n]), quote=False)

    def short(self) -> str:
        return html.escape(self.rng.choice(self.shorts), quote=False) if self.shorts and self.rng.random() < 0.6 else self.words(1, 4)

    def link(self) -> str:
        return f'<a href="/{self.rng.randrange(999)}">{self.short()}</a>'

    def links(self, n: int) -> str:
        form = self.rng.randrange(4)
        if form == 0:
            return "<ul>" + "".join(f"<li>{self.link()}{self.ended('li')}" for _ in range(n)) + "</ul>"
        if form == 1:
            return self.rng.choice((" | ", " ", " &raquo; ", " &middot; ", "<br>", "<br>")).join(self.link() for _ in range(n))
        if form == 2:
            return "".join(f"<div>{self.link()}</div>" for _ in range(n))
        return "<ul>" + "".join(f"<li>{self.short()}</li>" for _ in range(n)) + "</ul>"

    def sentence(self) -> str:
        return self.words(4, 22).rstrip(".,") + "."

    def paragraph(self) -> str:
        rng = self.rng
        if self.odd and rng.random() < 0.9:
            held = self.words(2, 40).split() or ["a"]
            if self.odd == "joined":
                return rng.choice((" | ", " ", ", ", " - ")).join(held)
            return " ".join(held[:1] * rng.randint(1, 60) if self.odd == "again" else held[: rng.randint(1, 3)])
        if rng.random() < 0.2:
            return self.words(1, 12)
        text = html.escape(rng.choice(self.prose), quote=rng.random() < 0.2)
        words = text.split()
        if len(words) > 12 and rng.random() < 0.25:
            at = rng.randrange(len(words) - 4)
            mark = rng.choice(('<a href="#">{}</a>', "<b>{}</b>", "<em>{}</em>", "{}<br>", "<b>{}"))
            words[at : at + 3] = [mark.format(" ".join(words[at : at + 3]))]
        return " ".join(words)

    def control(self) -> str:
        ask = "".join(f'<label>{self.short()}</label> <input name="q{i}"> ' for i in range(self.rng.randint(1, 3)))
        return f"<form>{ask}<p>{self.sentence()}</p><button>{self.short()}</button></form>" if self.rng.random() < 0.6 else f"<div>{ask}<span>{self.short()}</span></div>"

    def advert(self, mark: str = "") -> str:
        text = self.rng.choice((self.sentence, self.link, lambda: f"<p>{self.sentence()}</p><p>{self.link()}</p>"))()
        return self.element(text, self.rng.choice(("aside", "ins", "div")), ADVERT, mark=mark)

    def notice(self, mark: str = "") -> str:
        text = f"<p>{self.sentence()} {self.sentence()}</p>" if self.rng.random() < 0.5 else self.sentence()
        return self.element(text + self.rng.choice(("", self.link(), "<button>OK</button>")), "div", NOTICE, mark=mark)

    def comments(self) -> str:
        rng, out = self.rng, []
        for _ in range(rng.randint(1, 6)):
            who = rng.choice(("<b>{}</b>", '<span class="author">{}</span>', "<cite>{}</cite>", "<h4>{}</h4>", "{}: ")).format(self.short())
            when = rng.choice(("", f"<time>{rng.randint(1, 28)}.{rng.randint(1, 12)}.20{rng.randint(10, 26)}</time>", f"<small>{rng.randint(2, 23)} h</small>"))
            said = " ".join(self.sentence() for _ in range(rng.randint(1, 4)))
            out.append(who + when + rng.choice((f"<p>{said}</p>", f"<div>{said}</div>", said)) + rng.choice(("", self.link())))
        each = rng.choice(("li", "div", "article", "div", "p"))
        inside = "".join(f'<{each} class="{rng.choice(COMMENTS)}">{x}</{each}>' if rng.random() < self.names else f"<{each}>{x}</{each}>" for x in out)
        head = rng.choice(("", f"<h3>{len(out)} {self.short()}</h3>", f"<h2>{self.short()}</h2>"))
        return self.element(head + inside + (self.control() if rng.random() < 0.4 else ""), "section", COMMENTS)

    def side(self) -> str:
        parts = [f"<h3>{self.short()}</h3>{self.links(self.rng.randint(2, 7))}" for _ in range(self.rng.randint(1, 3))]
        if self.rng.random() < 0.4:
            parts.append(f"<p>{self.sentence()}</p>")
        return self.element("".join(parts), "aside", SIDE)

    def aside_parts(self) -> list[str]:
        rng = self.rng
        return [part for part, odds in ((self.side, 0.45), (self.advert, 0.5), (self.comments, 0.4), (self.notice, 0.25), (self.share, 0.2), (self.form, 0.25)) if rng.random() < odds for part in (part(),)]

    def share(self, mark: str = "") -> str:
        return self.element(self.links(self.rng.randint(2, 5)), "div", SHARE, mark=mark)

    def form(self, mark: str = "") -> str:
        return self.element(self.control(), "section", FORM, mark=mark)

    def main(self) -> str:
        rng, out = self.rng, []
        if rng.random() < 0.8:
            out.append(f"<h1>{self.words(2, 10)}</h1>")
        for _ in range(max(1, int(rng.expovariate(0.03 if self.odd else 0.16)))):
            odds = rng.random()
            if odds < 0.08:
                out.append(f"<h2>{self.words(1, 8)}</h2>")
            elif odds < 0.13:
                out.append("<ul>" + "".join(f"<li>{self.words(3, 25)}{self.ended('li')}" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif odds < 0.16:
                out.append(f"<blockquote>{self.paragraph()}</blockquote>")
            elif odds < 0.18:
                out.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.words(1, 6)}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
            elif odds < 0.27:
                out.append(rng.choice((self.advert, self.share, self.notice, self.form))("0"))
            elif odds < 0.32:
                out.append(self.paragraph() + "<br><br>")
            else:
                tag = "p" if rng.random() < 0.9 else "div"
                out.append(f"<{tag}>{self.paragraph()}{self.ended('p') if tag == 'p' else '</div>'}")
        if rng.random() < 0.15:
            out.append(self.element(f"<h3>{self.short()}</h3>{self.links(rng.randint(2, 5))}", "aside", SIDE, mark="0"))
        inside = "".join(out)
        form = rng.random()
        if form < 0.08:
            return f'<table><tr><td>{self.links(4)}</td><td {LABEL}="1">{inside}</td></tr></table>'
        held = self.element(inside, rng.choice(("article", "main", "article", "section")), MAIN, mark="1")
        for _ in range(rng.choice((0, 0, 1, 2))):
            held = self.element(held, "div", PLAIN)
        return held

    def page(self) -> str:
        rng = self.rng
        before, after = [], []
        if rng.random() < 0.6:
            before.append(self.element(rng.choice(("{}", "<h1>{}</h1>", "<div>{}</div>", '<a href="/">{}</a>')).format(self.short()) + (self.links(rng.randint(2, 6)) if rng.random() < 0.5 else f"<p>{self.words(2, 9)}</p>"), "header", HEADER))
        if rng.random() < 0.75:
            before.append(self.element(self.links(rng.randint(3, 9)), "nav", NAV))
        for part in self.aside_parts():
            # Comments follow what they are about.
            (after if rng.random() < 0.6 or any(x in part for x in ("comment", "repl")) else before).append(part)
        rng.shuffle(before)
        if rng.random() < 0.85:
            foot = rng.choice((f"&copy; {self.short()} &middot; {self.words(3, 12)}", f"{self.words(3, 12)} &copy; 20{rng.randint(10, 26)}", self.links(5), f"<p>{self.sentence()}</p>{self.links(3)}"))
            after.append(self.element(foot, "footer", FOOTER))
        body = "".join(before) + self.main() + "".join(after)
        head = f"<head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{body}" + ("</body></html>" if rng.random() < 0.9 else "")


def labelled_pages(prose: Sequence[str], shorts: Sequence[str], n: int, seed: int = 13) -> list[str]:
    """n pages around prose (texts of paragraphs) and shorts (texts of links and the like)."""
    prose = [p for p in prose if p.split()] or ["A sentence of some words, as they are in a text. Another one follows it here."]
    return [Layout(random.Random(f"{seed}:{i}"), prose, shorts).page() for i in range(n)]
