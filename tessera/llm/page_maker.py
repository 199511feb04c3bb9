"""Random pages with known main text, for fitting the extractor: invented words in many layouts, tidy and sloppy markup.

The layouts are drawn from what pages of many kinds do (blogs, news, manuals, shops, old table layouts), not from any table of pages.
"""

from __future__ import annotations

import html
import random

_SYLLABLES = "an be co du el fa gi ho in ka lo mé na or pa qu re si ti un va wé xi zu ö ñ thr ing tion ch sch eau über ón".split()
#: Class and id words by kind of part.
_NAMES = {
    "nav": "nav navbar navigation menu mainmenu topbar breadcrumb breadcrumbs pagination pager toc links".split(),
    "header": "header masthead site-header branding logo banner top hero title-bar".split(),
    "footer": "footer site-footer colophon copyright bottom legal credits".split(),
    "aside": "sidebar aside side widget widgets rail column-right related recommended popular trending more-stories".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promoted promotion adbox ad-slot commercial".split(),
    "notice": "cookie cookies consent notice alert popup modal overlay gdpr cookie-banner cookie-notice privacy warning paywall announcement".split(),
    "form": "search login signup subscribe newsletter contact form searchbox register feedback".split(),
    "comments": "comments comment comment-list responses discussion disqus replies reply thread reader-comments".split(),
    "social": "share social sharing follow tags tagcloud meta author-box".split(),
}
_MAIN_NAMES = "content article post entry story main body text article-body post-content entry-content main-content story-body page-content article-text site-content documentation single-post primary prose".split()
#: Words that say nothing, on parts of every kind.
_PLAIN_NAMES = "container wrapper row col inner page layout grid box block section outer site area list item info wrap region title width full home type primary secondary module component top bottom".split()
#: Names of blocks of main text.
_TEXT_NAMES = "title headline entry-title post-title article-title lead intro first text paragraph summary subtitle standfirst".split()
_ENTITIES = ["&amp;", "&lt;", "&gt;", "&quot;", "&#39;", "&eacute;", "&nbsp;", "&mdash;", "&#x2019;", "&copy;", "&middot;"]
#: Raw elements whose content looks like markup that never ends.
_SCRIPTS = ["<script>for(i=0;i<n;i++){f(i)}</script>", "<script>if(a<b){g('it')}</script >", "<script><!-- h()</script>", '<style>a<b{content:"<p>"}</style>', "<SCRIPT>var q='</scripts><!--';</SCRIPT>", "<noscript><!-- off</noscript>"]
_STYLES = ["", "", "<style>body{font:16px/1.5 serif}</style>", "<style>@media(max-width:40em){nav{display:none}}</style>", '<link rel="stylesheet" href="/s.css">', "<style>.a>.b{color:red}</style>"]
_YEARS = ["2019", "2008 - 2021", "1999", "2024"]
_SPACES = [" "] * 12 + ["\n", "  ", "&nbsp;", "<br>"]


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.main: list[str] = []
        self.words = ["".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4))) for _ in range(5000)]

    def word(self) -> str:
        return self.words[int(self.r.random() * len(self.words))]

    def plain(self, low: int, high: int) -> str:
        """Words with sentence marks, often few, sometimes none, sometimes shouted or full of symbols."""
        n, style = self.r.randint(low, high), self.r.random()
        out = []
        for k in range(n):
            w = self.word()
            if style < 0.05:
                w += self.r.choice(["###", "$$$", "***", "%%%", "&&&"])
            elif style < 0.1:
                w = w.upper() + "!!"
            elif style > 0.2 and (self.r.random() < 0.12 or k == n - 1):
                w += self.r.choice([".", ".", ",", "?"])
            out.append(w)
        text = " ".join(out)
        return text[0].upper() + text[1:]

    def marked(self, text: str) -> str:
        """The text as HTML: inline elements, references and white space that change nothing."""
        out = []
        for w in text.split(" "):
            e, x = html.escape(w, quote=False), self.r.random()
            if x < 0.04:
                t = self.r.choice(["b", "i", "em", "strong", "span", "code"])
                e = f"<{t}>{e}</{t}>"
            elif x < 0.06:
                e = f'<a href="/{self.r.randint(1, 99)}">{e}</a>'
            out.append(e)
        return "".join(e + _SPACES[int(self.r.random() * len(_SPACES))] for e in out).strip()

    def block(self, tag: str, low: int, high: int, main: bool, name: str = "") -> str:
        text = self.plain(low, high)
        if self.r.random() < 0.1:
            text += " " + html.unescape(self.r.choice(_ENTITIES)).replace("\xa0", "-")
        if main:
            self.main.append(text)
            if not name and self.r.random() < 0.12:
                name = f' class="{self.r.choice(_TEXT_NAMES)}"'
        inner = self.marked(text)
        if tag == "p" and self.r.random() < 0.1:
            return f"<p{name}>{inner}\n"  # left open
        return f"<{tag}{name}>{inner}</{tag}>"

    def attribute(self, names: list[str]) -> str:
        x = self.r.random()
        if x < 0.25:
            return ""
        n = self.word() if self.r.random() < 0.1 else self.r.choice(names)  # a name that says nothing
        if self.r.random() < 0.4:
            more = self.r.choice(_PLAIN_NAMES + _PLAIN_NAMES + names)
            n = f"{more}-{n}" if self.r.random() < 0.4 else n + self.r.choice([" ", "-"]) + more
        return f' class="{n}"' if x < 0.75 else f' id="{n.replace(" ", "-")}"' if x < 0.92 else f" class={n.split()[0]}"

    def sure(self, names: list[str]) -> str:
        while not (a := self.attribute(names)):
            pass
        return a

    def link_list(self, n: int) -> str:
        t = self.r.choice(["ul", "ul", "ol"])
        return f"<{t}>" + "".join(f'<li><a href="/{k}">{html.escape(self.plain(1, 4))}</a>' + self.r.choice(["</li>", "</li>", ""]) for k in range(n)) + f"</{t}>"

    def part(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            inner = self.link_list(r.randint(3, 9)) if r.random() < 0.7 else " | ".join(f'<a href="/{k}">{self.plain(1, 2)}</a>' for k in range(r.randint(2, 8)))
            return f"<nav{self.attribute(_NAMES['nav'])}>{inner}</nav>" if r.random() < 0.6 else f"<div{self.sure(_NAMES['nav'])}>{inner}</div>"
        if kind == "header":
            inner = r.choice([self.block("h1", 1, 4, False), self.block("div", 1, 4, False), f'<a href="/">{self.plain(1, 2)}</a>']) + (self.block("p", 2, 9, False) if r.random() < 0.4 else "")
            return f"<header{self.attribute(_NAMES['header'])}>{inner}{self.part('nav') if r.random() < 0.4 else ''}</header>" if r.random() < 0.6 else f"<div{self.sure(_NAMES['header'])}>{inner}</div>"
        if kind == "footer":
            mark = r.choice(["&copy; ", "Copyright ", "(c) ", "", "&#169;"])
            line = mark + " ".join(r.sample([r.choice(_YEARS), html.escape(self.plain(1, 3)), f'<a href="/{self.word()}">{self.word()}</a>', html.escape(self.plain(2, 25))], r.randint(1, 4)))
            inner = r.choice([lambda: line, lambda: f"<p>{line}</p>", lambda: self.block("p", 3, 30, False) + line, lambda: self.link_list(r.randint(2, 6)) + f"<div>{line}</div>", lambda: f"<address>{html.escape(self.plain(3, 12))}</address>{line}"])()
            return f"<footer{self.attribute(_NAMES['footer'])}>{inner}</footer>" if r.random() < 0.65 else f"<div{self.sure(_NAMES['footer'])}>{inner}</div>"
        if kind == "aside":
            inner = self.block(r.choice(["h2", "h3", "h4"]), 1, 4, False) + "".join(r.choice([lambda: self.link_list(r.randint(2, 6)), lambda: self.block("p", 4, 60, False), lambda: self.block("div", 4, 30, False)])() for _ in range(r.randint(1, 3)))
            return f"<aside{self.attribute(_NAMES['aside'])}>{inner}</aside>" if r.random() < 0.5 else f"<div{self.sure(_NAMES['aside'])}>{inner}</div>"
        if kind in ("ad", "notice"):
            inner = html.escape(self.plain(2, 50)) if r.random() < 0.6 else self.block("p", 3, 60, False)
            if kind == "notice" and r.random() < 0.5:
                inner += f"<button>{self.word()}</button>"
            return f"<{(t := r.choice(['div', 'div', 'div', 'section', 'aside', 'p'] if '<p' not in inner else ['div', 'section']))}{self.sure(_NAMES[kind])}>{inner}</{t}>"
        if kind == "form":
            inner = self.block("p", 2, 12, False) if r.random() < 0.5 else ""
            inner += "".join(f'<label>{self.word()}</label><input name="{self.word()}">' for _ in range(r.randint(1, 4))) + f"<button>{self.word()}</button>"
            if r.random() < 0.3:
                inner += f"<select><option>{self.word()}<option>{self.word()}</select><textarea>{self.plain(2, 8)}</textarea>"
            form = f'<form{self.attribute(_NAMES["form"])} action="/x">{inner}</form>'
            return f"<div{self.sure(_NAMES['form'])}>{form}</div>" if r.random() < 0.3 else form
        if kind == "comments":
            each = r.choice(["div", "li", "article", "div"])
            rows = "".join(f"<{each}{self.attribute(_NAMES['comments'])}>" + (self.block(r.choice(["b", "h4", "span", "cite"]), 1, 2, False) if r.random() < 0.5 else "") + "".join(self.block("p", 3, 70, False) for _ in range(r.randint(1, 2))) + f"</{each}>" for _ in range(r.randint(1, 6)))
            inner = (self.block("h3", 1, 3, False) if r.random() < 0.6 else "") + (f"<ul>{rows}</ul>" if each == "li" else rows)
            t = r.choice(["section", "div", "div", "aside"])
            return f"<{t}{self.sure(_NAMES['comments'])}>{inner}</{t}>"
        return f"<div{self.sure(_NAMES['social'])}>" + " ".join(f'<a href="#{k}">{self.plain(1, 2)}</a>' for k in range(r.randint(1, 5))) + "</div>"

    def article(self) -> str:
        r, out = self.r, []
        title = self.plain(3, 14)
        if r.random() < 0.85:
            self.main.append(title)
            t = r.choice(["h1", "h1", "h1", "h2"])
            heading = f"<{t}{self.attribute(_TEXT_NAMES) if r.random() < 0.4 else ''}>{html.escape(title)}</{t}>"
            out.append(f'<header class="{r.choice(_MAIN_NAMES)}-header">{heading}</header>' if r.random() < 0.1 else heading)
        if r.random() < 0.15:
            out.append(self.part("social"))
        for k in range(r.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            x = r.random()
            if x < 0.1:  # sloppy: elements that are never closed
                texts = [self.plain(3, 60) for _ in range(r.randint(1, 3))]
                self.main += texts
                out.append("".join(f"<p{r.choice(['', ' align=left'])}>{r.choice(['', '<b>', '<i>', '<font size=2>', '<span>'])}{self.marked(t)}{r.choice(['', '<br>', '</p>'])}" for t in texts))
            elif x < 0.78:
                out.append(self.block("p", *r.choice([(1, 6), (10, 60), (30, 150), (60, 300)]), True))
            elif x < 0.84:
                out.append(self.block(r.choice(["h2", "h3", "h4"]), 1, 8, True))
            elif x < 0.88:
                t = r.choice(["ul", "ol"])
                out.append(f"<{t}>" + "".join(self.block("li", 2, 25, True) for _ in range(r.randint(2, 6))) + f"</{t}>")
            elif x < 0.91:
                out.append(f"<blockquote>{self.block('p', 8, 60, True)}</blockquote>")
            elif x < 0.93:
                wide, rows = r.randint(2, 4), r.randint(1, 5)
                caption = self.block("caption", 1, 8, True) if r.random() < 0.5 else ""
                heads = "<tr>" + "".join(self.block("th", 1, 3, True) for _ in range(wide)) + "</tr>" if r.random() < 0.7 else ""
                cells = "".join("<tr>" + "".join(self.block("th" if c == 0 and r.random() < 0.2 else "td", 1, r.choice([4, 12]), True) for c in range(wide)) + "</tr>" for _ in range(rows))
                out.append(f"<table{r.choice(['', ' class=data', ' border=1'])}>{caption}" + (f"<thead>{heads}</thead><tbody>{cells}</tbody>" if r.random() < 0.4 else heads + cells) + "</table>")
            elif x < 0.94:
                out.append("<dl>" + "".join(self.block("dt", 1, 4, True) + self.block("dd", 3, 30, True) for _ in range(r.randint(1, 4))) + "</dl>")
            elif x < 0.945:
                out.append(self.block("pre", 5, 40, True))
            elif x < 0.95:
                out.append(f'<figure><img src="/x.png">{self.block("figcaption", 3, 15, True)}</figure>')
            elif x < 0.97:
                out.append(self.block("div", 8, 80, True))
            else:
                out.append(self.part(r.choice(["ad", "ad", "aside", "social", "form", "notice"])))
        if r.random() < 0.1:
            out.append(self.part(r.choice(["social", "form", "comments", "aside"])))
        return "".join(out)

    def page(self) -> tuple[str, list[str]]:
        r, self.main = self.r, []
        some = lambda kinds, p: [self.part(k) for k in kinds if r.random() < p]
        tops = some(["notice", "header", "nav", "ad", "form", "social"], 0.4)
        inner = self.article()
        x = r.random()
        if x < 0.45:
            inner = f"<article{self.attribute(_MAIN_NAMES) if r.random() < 0.6 else ''}>{inner}</article>"
        elif x < 0.9:
            t = r.choice(["div", "div", "section", "main"])
            inner = f"<{t}{self.sure(_MAIN_NAMES) if r.random() < 0.8 else ''}>{inner}</{t}>"
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            t = r.choice(["div", "div", "main", "section"])
            inner = f"<{t}{self.attribute(_PLAIN_NAMES + _MAIN_NAMES)}>{''.join(some(['aside', 'ad'], 0.12))}{inner}{''.join(some(['aside', 'comments', 'form', 'ad', 'social'], 0.12))}</{t}>"
        ends = some(["comments", "aside", "form", "social", "ad", "footer", "notice"], 0.35)
        r.shuffle(tops)
        title = html.escape(self.plain(2, 9))
        parts = [f"<title>{title}</title>", r.choice(_STYLES), r.choice(_SCRIPTS) if r.random() < 0.5 else "", r.choice(["", '<meta charset="utf-8">', f'<meta name="description" content="{title}">'])]
        r.shuffle(parts)
        head = f"<head>{''.join(parts)}</head>" if r.random() < 0.9 else f"<title>{title}</title>"
        noise = lambda: r.choice(["", "", "", "<!-- note -->", "<script>x('<p>')</script>", "<noscript><p>off</p></noscript>", "<hr>", r.choice(_SCRIPTS)])
        body = noise().join([*tops, inner, *ends]) + noise()
        start = r.choice(["<!DOCTYPE html><html>", '<!doctype html>\n<html lang="xx">', "<html>", ""])
        return f'{start}{head}<body{self.attribute(_PLAIN_NAMES + _MAIN_NAMES) if r.random() < 0.4 else ""}>{body}' + r.choice(["</body></html>", "</body></html>", ""]), list(self.main)


def make(pages: int, seed: int) -> list[tuple[str, list[str]]]:
    """(html, main text by block) of so many pages."""
    maker = _Maker(seed)
    return [maker.page() for _ in range(pages)]
