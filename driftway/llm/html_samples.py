"""Generated labelled pages: elements with data-content="1" hold main text, those with "0" do not."""

from __future__ import annotations

import numpy as np

_MAIN = (
    '<article{}>', '<main{}>', '<div class="content"{}>', '<div id="main-content"{}>', '<section class="post"{}>', '<div{}>',
    '<div class="entry story"{}>', '<section{}>', '<td{}>',
)
_NAV = ("nav", 'ul class="menu"', 'div class="nav"', 'div id="breadcrumbs"', 'div role="navigation"')
_ASIDE = ("aside", 'div class="sidebar"', 'div class="widget"', 'div class="related"', 'div class="share social"')
_AD = ('div class="ad"', 'div class="advert"', 'aside class="sponsored"', 'div id="banner"', 'section class="promo"', 'p class="ad"')
_NOTICE = ('div class="cookie-notice"', 'div class="notice"', 'div id="newsletter"', 'dialog', 'p class="notice"')
_FOOTER = ("footer", 'div class="footer"', 'div id="copyright"', 'div class="legal"')
_HEADER = ("header", 'div class="header"', 'div id="masthead"')
_COMMENTS = ('div class="comments"', 'section id="comments"', 'ol class="comment-list"', 'div id="disqus-comments"')


class _Writer:
    def __init__(self, rng):
        self.rng = rng

    def words(self, low: int, high: int) -> str:
        lengths = self.rng.integers(1, 10, int(self.rng.integers(low, high + 1)))
        return " ".join("".join(map(chr, 97 + self.rng.integers(0, 26, int(n)))) for n in lengths)

    def sentence(self, low: int = 1, high: int = 18) -> str:
        return self.words(low, high).capitalize() + "."

    def prose(self, most: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(int(self.rng.integers(1, most + 1))))

    def pick(self, options):
        return options[int(self.rng.integers(0, len(options)))]

    def chance(self, share: float) -> bool:
        return self.rng.random() < share

    def off(self, opening: str, inner: str) -> str:
        return f'<{opening} data-content="0">{inner}</{opening.split()[0]}>'

    def links(self, low: int = 2, high: int = 8) -> str:
        items = [f'<a href="/x">{self.words(1, 3)}</a>' for _ in range(int(self.rng.integers(low, high + 1)))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.chance(0.6) else " ".join(items)

    def main(self) -> str:
        blocks = [f"<h1>{self.words(2, 9).capitalize()}</h1>"] if self.chance(0.8) else []
        for _ in range(int(self.rng.integers(1, 12))):
            draw = self.rng.random()
            text = self.prose()
            if self.chance(0.15):
                text = text.replace(" ", f' <a href="/y">{self.words(1, 2)}</a> ', 1)
            if draw < 0.65:
                blocks.append(f"<p>{text}</p>" if self.chance(0.85) else f"<p><b>{text}<br>")
            elif draw < 0.72:
                blocks.append(f"<h2>{self.words(1, 6).capitalize()}</h2>")
            elif draw < 0.79:
                blocks.append("<ul>" + "".join(f"<li>{self.sentence()}</li>" for _ in range(int(self.rng.integers(2, 6)))) + "</ul>")
            elif draw < 0.84:
                blocks.append(f"<blockquote>{text}</blockquote>")
            elif draw < 0.9:
                blocks.append(f"<div>{text}</div>")
            elif draw < 0.94:
                cells = "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(3))
                blocks.append(f"<table>{cells}</table>")
            elif draw < 0.97:
                blocks.append(self.off(self.pick(_AD), self.sentence(4)))
            else:
                blocks.append(text)
        return "".join(blocks)

    def page(self) -> str:
        opening = self.pick(_MAIN)
        tag = opening[1:].split()[0].split("{")[0]
        main = opening.format(' data-content="1"') + self.main() + f"</{tag}>"
        if tag == "td":
            main = f"<table><tr>{main}</tr></table>"
        before, after = [], []
        if self.chance(0.5):
            before.append(self.off(self.pick(_HEADER), f"<h1>{self.words(1, 3)}</h1>" + self.links()))
        if self.chance(0.8):
            before.append(self.off(self.pick(_NAV), self.links()))
        for options, inner, where, share in (
            (_NOTICE, lambda: f"<p>{self.prose(3)}</p><a href='#'>{self.words(1, 2)}</a>", before, 0.3),
            (_AD, lambda: self.prose(3), before, 0.5), (_ASIDE, lambda: self.links(), before, 0.3),
            (_ASIDE, lambda: f"<h3>{self.words(1, 3)}</h3><p>{self.prose(2)}</p>" + self.links(), after, 0.4),
            (_COMMENTS, lambda: "".join(f"<div class='comment'><b>{self.words(1, 2)}</b><p>{self.prose(3)}</p></div>" for _ in range(3)), after, 0.4),
            (_AD, lambda: self.sentence(4), after, 0.3),
        ):
            if self.chance(share):
                where.append(self.off(self.pick(options), inner()))
        if self.chance(0.3):
            after.append(self.off('form action="/s"', f"<label>{self.words(1, 3)}</label><p>{self.sentence()}</p>"))
        if self.chance(0.85):
            after.append(self.off(self.pick(_FOOTER), f"&copy; {self.words(1, 2)} &middot; {self.sentence(2, 12)}"))
        body = "".join(before) + main + "".join(after)
        if self.chance(0.4):
            body = f"<div class='{self.pick(('wrap', 'page', 'container'))}'>{body}</div>"
        return f"<html><head><title>{self.words(2, 5)}</title></head><body>{body}</body></html>"


def labelled_pages(count: int, seed: int) -> list[str]:
    writer = _Writer(np.random.default_rng(seed))
    return [writer.page() for _ in range(count)]
