"""Made-up pages whose main text is known: what the trees of operator 7 learn from."""

from __future__ import annotations

import random
from collections.abc import Iterator

MARK = "⁠"  # an invisible joiner that opens each run of main text here; extraction never sees these pages
PAGES = 700
_SYLLABLES = "ba be bi bo ka ke ko la le li lo ma mi mo na ne no pa pe ra re ri ro sa se si so ta te ti to va vi za".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int) -> str:
        r = self.r
        return " ".join("".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(n))

    def prose(self, n: int) -> str:
        r, out = self.r, []
        while n > 0:
            k = min(n, r.randint(3, 16))
            n -= k
            out.append(self.words(k).capitalize().replace(" ", ", ", 1 if r.random() < 0.4 else 0) + r.choice(".....?!"))
        return " ".join(out)

    def attr(self, names: str, sure: float = 0.85) -> str:
        r = self.r
        if r.random() > sure:
            return r.choice(["", f' class="{self.words(1)}"', ' class="row"', ' class="wrap inner"'])
        name = r.choice(names.split())
        name = r.choice([name, name, f"{name}-{self.words(1)}", f"site-{name}", f"{self.words(1)}_{name}", name.capitalize()])
        return r.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {self.words(1)}"', f" class='box {name}'"])

    def links(self, n: int, words: int = 2) -> str:
        return "".join(f'<li><a href="/{self.words(1)}">{self.words(self.r.randint(1, words))}</a></li>' for _ in range(n))

    def wrap(self, tags: str, names: str, body: str) -> str:
        r = self.r
        tag = r.choice(tags.split())
        return f"<{tag}{self.attr(names, 0.5 if tag not in ('div', 'section', 'ul') else 0.93)}>{body}</{tag}>"

    def nav(self) -> str:
        r = self.r
        items = self.links(r.randint(3, 12))
        return self.wrap("nav nav div header", "nav menu navbar navigation topbar", r.choice([f"<ul>{items}</ul>", items.replace("li>", "span>"), f"<h2>{self.words(1)}</h2><ul>{items}</ul>"]))

    def header(self) -> str:
        return self.wrap("header header div", "header masthead banner topbar", f"<h1>{self.words(2)}</h1><p>{self.words(self.r.randint(3, 8))}</p>" + (self.nav() if self.r.random() < 0.4 else ""))

    def footer(self) -> str:
        r = self.r
        return self.wrap("footer footer div", "footer foot copyright legal bottom", r.choice([f"&copy; {self.words(2)} &middot; {self.prose(r.randint(3, 16))}", f"<p>&copy; 2020 {self.words(3)}</p><ul>{self.links(r.randint(2, 6))}</ul>", f"<p>{self.prose(r.randint(5, 40))}</p>"]))

    def ad(self) -> str:
        r = self.r
        return self.wrap("div div aside section", "ad ads advert advertisement sponsor promo banner", r.choice([self.prose(r.randint(3, 20)), f"<p>{self.prose(r.randint(3, 25))}</p>", f'<a href="//{self.words(1)}">{self.words(6)}</a>', f"<h3>{self.words(3)}</h3><p>{self.prose(8)}</p>"]))

    def side(self) -> str:
        r = self.r
        blocks = [f"<h3>{self.words(2)}</h3><ul>{self.links(r.randint(3, 8), 7)}</ul>", f"<h3>{self.words(2)}</h3><p>{self.prose(r.randint(6, 30))}</p>", f"<p>{self.prose(12)}</p>"]
        return self.wrap("aside aside div", "sidebar side widget related recommended more", "".join(r.sample(blocks, r.randint(1, 3))))

    def notice(self) -> str:
        return self.wrap("div div section dialog", "cookie consent notice gdpr alert popup modal", f"<p>{self.prose(self.r.randint(5, 40))}</p><button>{self.words(1)}</button>")

    def form(self) -> str:
        r = self.r
        return f"<form{self.attr('subscribe newsletter signup login search form', 0.6)}><label>{self.words(2)}</label><input name=q><p>{self.prose(r.randint(3, 20))}</p><button>{self.words(1)}</button></form>"

    def comments(self) -> str:
        r = self.r
        tag = r.choice(["div", "li", "article"])
        each = "".join(f"<{tag}{self.attr('comment reply', 0.95)}><b>{self.words(2)}</b><p>{self.prose(r.randint(4, 60))}</p></{tag}>" for _ in range(r.randint(1, 6)))
        return f"<{(outer := r.choice(['section', 'div']))}{self.attr('comments discussion respond', 0.97)}><h2>{self.words(1)}</h2>{each}</{outer}>"

    def share(self) -> str:
        return self.wrap("div ul", "share social follow tags breadcrumb pagination", self.links(self.r.randint(2, 6), 1))

    def block(self) -> str:
        r, m = self.r, MARK
        n = r.choice([2, 4, 8, 15, 30, 60, 100])
        kind = r.random()
        if kind < 0.70:
            text = self.prose(n)
            return r.choice([f"<p>{m}{text}</p>", f"<p>{m}{text}</p>", f"<p>{m}{text}", f"<p><b>{m}{text}<br>", f"<p>{m}{text} <a href='/x'>{self.words(2)}</a> {self.words(3)}.</p>", f"<p>{m}{text.upper()}</p>"])
        if kind < 0.80:
            return f"<h{(k := r.choice('234'))}>{m}{self.words(r.randint(1, 8))}</h{k}>"
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>{m}{self.prose(r.randint(2, 25))}</li>" for _ in range(r.randint(1, 6))) + "</ul>"
        if kind < 0.93:
            return f"<blockquote>{m}{self.prose(n)}</blockquote>"
        if kind < 0.96:
            return "<table>" + "".join(f"<tr><td>{m}{self.words(2)}</td><td>{m}{self.words(3)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        return f"<div>{m}{self.prose(n)}</div>"

    def article(self) -> str:
        r = self.r
        blocks = [self.block() for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14]))]
        for extra, chance in ((self.ad, 0.12), (self.share, 0.12), (self.form, 0.05), (self.side, 0.05)):
            if r.random() < chance:
                blocks.insert(r.randint(0, len(blocks)), extra())
        title = f"<h1>{MARK}{self.words(r.randint(1, 9))}</h1>" if r.random() < 0.85 else ""
        tag = r.choice(["article", "article", "main", "div", "div", "section"])
        body = title + "".join(blocks)
        if r.random() < 0.15:
            body = f"{MARK}{self.prose(r.randint(3, 80))}" if r.random() < 0.5 else f"<div>{body}</div>"
        return f"<{tag}{self.attr('article content post entry story main text body', 0.3 if tag in ('article', 'main') else 0.9)}>{body}</{tag}>"

    def page(self) -> str:
        r = self.r
        before = [f() for f, c in ((self.notice, 0.25), (self.header, 0.35), (self.nav, 0.8), (self.share, 0.2), (self.ad, 0.4), (self.form, 0.2), (self.side, 0.15)) if r.random() < c]
        after = [f() for f, c in ((self.share, 0.2), (self.side, 0.35), (self.ad, 0.2), (self.comments, 0.35), (self.form, 0.2), (self.nav, 0.15), (self.footer, 0.85), (self.notice, 0.15)) if r.random() < c]
        body = "".join(before) + (self.article() if r.random() < 0.97 else "") + "".join(after)
        if r.random() < 0.3:
            body = f'<div{self.attr("page wrapper container", 0.9)}>{body}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(4)}</title><script>var a='<p>x</p>';</script></head><body>{body}</body></html>"


def pages(n: int = PAGES, seed: int = 7) -> Iterator[str]:
    """Pages; main text is what lies in a run that MARK opens."""
    maker = _Maker(seed)
    for _ in range(n):
        yield maker.page()
