"""Labelled pages to learn block costs from: layouts drawn by a seeded generator, with the texts that are content.

There are no labelled pages among the inputs. The layouts hold what extraction meets: containers with telling and with
mute names, menus, notices, adverts, related links, comments and footers around and inside articles, and in articles headings,
short lines, lists, quotes, captions and paragraphs that are mostly links. Words are invented.
"""

from __future__ import annotations

import random

#: Names that containers of content, of boilerplate, and of either have.
CONTENT = ("post-content", "article-body", "entry", "story", "main-text")
MUTE = ("x1", "c-12", "wrap", "block", "col-8", "inner")
BOILERPLATE = {
    "menu": ("navbar", "main-menu", "breadcrumbs", "topbar"),
    "notice": ("cookie-notice", "newsletter-popup", "consent", "alert"),
    "advert": ("ad", "sponsored", "promo-box", "advertisement"),
    "related": ("sidebar", "related", "widget", "recommended"),
    "comments": ("comments", "comment-list", "replies", "disqus"),
    "footer": ("footer", "copyright", "legal", "social"),
}
#: A site's own header stands before the content; an article's header holds its heading.
SITE_HEADERS = ("page-header", "site-header", "masthead", "header", "x1")


class _Page:
    def __init__(self, rnd: random.Random):
        self.rnd, self.content, self.count = rnd, set(), 0

    def words(self, low: int, high: int) -> str:
        self.count += 1
        made = ["".join(self.rnd.choice(("ka", "lo", "mi", "ten", "ra", "so")) for _ in range(self.rnd.randint(1, 3))) for _ in range(self.rnd.randint(low, high))]
        return " ".join([f"{made[0].title()}{self.count}", *made[1:]])

    def sentence(self, low: int, high: int) -> str:
        return self.words(low, high) + self.rnd.choice((".", ".", ".", "?", "!"))

    def kept(self, text: str) -> str:
        self.content.add(text)
        return text

    def piece(self) -> str:
        """A block of content."""
        kind = self.rnd.choices(("p", "short", "h2", "ul", "quote", "caption", "links", "linked", "table", "pre"), (10, 4, 2, 2, 1, 1, 2, 2, 1, 1))[0]
        if kind == "p":
            return f"<p>{self.kept(' '.join(self.sentence(6, 20) for _ in range(self.rnd.randint(1, 4))))}</p>"
        if kind == "short":
            return f"<{(tag := self.rnd.choice(('p', 'div')))}>{self.kept(self.words(1, 5))}</{tag}>"
        if kind == "h2":
            return f"<h2>{self.kept(self.words(1, 6))}</h2>"
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{self.kept(self.words(2, 12))}</li>" for _ in range(self.rnd.randint(2, 5))) + "</ul>"
        if kind == "table":
            return "<table><tr>" + "".join(f"<td>{self.kept(self.words(1, 4))}</td>" for _ in range(self.rnd.randint(2, 4))) + "</tr></table>"
        if kind == "links":
            linked, rest = self.words(4, 8), self.words(1, 4)
            return f"<p><a href='/s'>{linked}</a> {rest}.</p>" if self.kept(f"{linked} {rest}.") else ""
        if kind == "linked":
            return f"<ul>{''.join(f'<li><a href=/s>{self.kept(self.words(1, 6))}</a></li>' for _ in range(self.rnd.randint(1, 3)))}</ul>"
        tag = {"quote": "blockquote", "caption": "figcaption", "pre": "pre"}[kind]
        return f"<{tag}>{self.kept(self.words(3, 15))}</{tag}>"

    def clutter(self, kind: str, mute: int = 3) -> str:
        """A block of boilerplate in a container with a telling tag, a telling name or, as often as `mute` says, neither."""
        tags = {"menu": "nav", "related": "aside", "footer": "footer"}
        how = self.rnd.choices(("tag", "name", "mute"), (4, 5, mute))[0]
        tag = tags.get(kind, "div") if how == "tag" else "div"
        name = self.rnd.choice(BOILERPLATE[kind] if how == "name" or (how == "tag" and tag == "div") else MUTE)
        links = "<ul>" + "".join(f"<li><a href='#'>{self.words(1, 4)}</a></li>" for _ in range(self.rnd.randint(2, 6))) + "</ul>"
        if kind in ("menu", "related"):
            body = links
        elif how == "mute":  # only what it says and what stands beside it can tell it: links, short lines, a sentence
            body = f"<p>{self.sentence(2, 9)}</p><p><a href='#'>{self.words(1, 3)}</a> {self.words(1, 2)}</p>{links}<div>{self.words(1, 4)}</div>"
        elif kind == "comments":
            each = self.rnd.choice(("div", "article", "li")) if how == "name" else "div"  # a reader's comment is often an article of its own
            body = "".join(f"<{each}><b>{self.words(1, 1)}</b><p>{self.sentence(4, 20)}</p></{each}>" for _ in range(self.rnd.randint(1, 4)))
        else:
            body = "".join(f"<p>{self.sentence(3, 14)}</p>" for _ in range(self.rnd.randint(1, 2))) + (f"<a href='#'>{self.words(1, 2)}</a>" if self.rnd.random() < 0.5 else "")
        return f'<{tag} class="{name}">{body}</{tag}>'

    def site_header(self) -> str:
        """The site's name and what is often beside it."""
        tag, name = self.rnd.choice((("header", self.rnd.choice(SITE_HEADERS)), ("div", self.rnd.choice(SITE_HEADERS[:-1]))))
        title = self.rnd.choice(("h1", "h2", "p", "div", "a"))
        line = f"<p>{self.words(2, 8)}</p>" if self.rnd.random() < 0.4 else ""
        return f'<{tag} class="{name}"><{title}>{self.words(1, 4)}</{title}>{line}</{tag}>'

    def html(self) -> str:
        body = [self.piece() for _ in range(self.rnd.randint(4, 14))]
        for kind in self.rnd.sample(("advert", "related", "notice"), self.rnd.randint(0, 2)):
            body.insert(self.rnd.randint(1, len(body)), self.clutter(kind, mute=0))
        tag, name = self.rnd.choice((("article", "x1"), ("main", "wrap"), ("div", self.rnd.choice(CONTENT)), ("div", self.rnd.choice(CONTENT)), ("section", self.rnd.choice(MUTE))))
        heading = f"<h1>{self.kept(self.words(2, 8))}</h1>"
        if tag == "article" and self.rnd.random() < 0.5:
            heading = f'<header class="{self.rnd.choice(("entry-header", "x1"))}">{heading}</header>'
        story = f'<{tag} class="{name}">{heading}{"".join(body)}</{tag}>'
        # paragraphs that stand beside the element which holds the rest
        loose = "".join(f"<p>{self.kept(self.sentence(3, 20))}</p>" for _ in range(self.rnd.randint(1, 3))) if self.rnd.random() < 0.4 else ""
        before = [self.site_header()] if self.rnd.random() < 0.6 else []
        before += [self.clutter(k) for k in ("menu", "notice", "advert") if self.rnd.random() < 0.6]
        after = [self.clutter(k) for k in ("related", "comments", "footer", "advert") if self.rnd.random() < 0.6]
        return f"<html><head><title>{self.words(1, 5)}</title></head><body>{''.join(before)}<div class='wrap'>{story}{loose}</div>{''.join(after)}</body></html>"


def labelled(pages: int, seed: int) -> list[tuple[str, set[str]]]:
    """Pages and the texts of their blocks that are content; no text occurs twice in a page."""
    out = []
    for k in range(pages):
        page = _Page(random.Random(seed * 1_000_003 + k))
        out.append((page.html(), page.content))
    return out
