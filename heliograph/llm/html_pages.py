"""Labelled pages that the extraction model learns from.

Pages are put together at random, with a fixed seed, from layouts that are common
on the public web. Every text is known to be of the article or not.
"""

from __future__ import annotations

import random

SYLLABLES = "an be co da el fi ga ho in jo ka lu me no or pa qui ra so ta un ver wo xi ya zu ment tion ing ly é ñ ö ß".split()
ARTICLE = ["article", "main", "div class='content'", "div class='post-body'", "div class='entry-content'", "div id='main-content'", "section class='article-body'", "div class='story-text'", "div itemprop='articleBody'", "div class='text'", "div role='main'", "div"]
MENU = ["nav", "ul class='menu'", "div id='nav'", "div class='navbar navigation'", "div class='breadcrumb'", "div role='navigation'", "div class='top-menu'", "ol class='breadcrumbs'"]
HEADER = ["header", "div id='header'", "div class='site-header'", "div class='masthead'", "div role='banner'", "div class='topbar logo'"]
FOOTER = ["footer", "div id='footer'", "div class='site-footer'", "div class='copyright'", "div role='contentinfo'", "div class='legal bottom'"]
SIDE = ["aside", "div class='sidebar'", "div id='sidebar' class='widget'", "div class='related-posts'", "section class='recommended'", "div class='widget tags'", "div role='complementary'", "div class='share social'", "div class='author-bio'", "div class='trending popular'"]
NOTICE = ["div class='cookie-notice'", "div id='gdpr-consent'", "div class='alert'", "div class='newsletter subscribe'", "div class='modal popup'", "div class='notice'", "div role='alert'", "div class='paywall message'", "div role='dialog'", "p class='disclaimer'"]
ADVERT = ["div class='ad'", "div class='ads advert'", "div id='banner-ad'", "div class='sponsored'", "ins class='adsbygoogle'", "aside class='promo'", "div class='advertisement'", "div class='ad-slot'", "div data-ad='1' class='promotion'"]
COMMENTS = ["div class='comments'", "section id='comments'", "ol class='comment-list'", "div id='disqus' class='discussion'", "div class='replies'", "div class='reader-comments'", "section class='responses'"]
FORM = ["form", "form class='search'", "form id='login'", "div class='search-form'"]


def _sentence(r: random.Random, words: int) -> str:
    text = " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(max(1, words)))
    return text.capitalize() + r.choice([".", ".", ".", "", "?", "!"])


def _text(r: random.Random, low: int, high: int) -> str:
    return " ".join(_sentence(r, r.randint(3, 18)) for _ in range(max(1, r.randint(low, high) // 10)))


def _close(tag: str) -> str:
    return f"</{tag.split()[0]}>"


def _wrap(tag: str, inner: str) -> str:
    return f"<{tag}>{inner}{_close(tag)}"


def _links(r: random.Random) -> str:
    items = [f"<a href='/{i}'>{_sentence(r, r.randint(1, 4))}</a>" for i in range(r.randint(2, 9))]
    return r.choice([f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>", " | ".join(items), "".join(f"<p>{x}</p>" for x in items), "".join(f"<div>{x}</div>" for x in items)])


def _paragraphs(r: random.Random, n: int) -> str:
    out = []
    for _ in range(n):
        kind = r.random()
        text = _sentence(r, r.randint(1, 6)) if r.random() < 0.3 else _text(r, 3, 120)
        if r.random() < 0.15:
            text += f" <a href='/x'>{_sentence(r, 3)}</a> {_sentence(r, 6)}"
        if kind < 0.68:
            out.append(r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}<br>"]))
        elif kind < 0.76:
            out.append(f"<h{r.randint(2, 4)}>{_sentence(r, 4)}</h2>")
        elif kind < 0.84:
            out.append("<ul>" + "".join(f"<li>{_sentence(r, r.randint(2, 14))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
        elif kind < 0.9:
            out.append(f"<blockquote><p>{text}</p></blockquote>")
        elif kind < 0.94:
            out.append("<table><tr>" + "".join(f"<td>{_sentence(r, 2)}</td>" for _ in range(4)) + "</tr></table>")
        elif kind < 0.97:
            out.append(f"<figure><img src='a.png'><figcaption>{_sentence(r, 7)}</figcaption></figure>")
        else:
            out.append(f"<div>{text}</div>")
    return "".join(out)


def _other(r: random.Random, kind: str) -> str:
    if kind == "menu":
        return _wrap(r.choice(MENU), _links(r))
    if kind == "header":
        return _wrap(r.choice(HEADER), r.choice([f"<p>{_sentence(r, 3)}</p>", f"<h2>{_sentence(r, 3)}</h2>", f"<div>{_sentence(r, 4)}</div>"]) + r.choice(["", _links(r), _other(r, "menu")]))
    if kind == "footer":
        return _wrap(r.choice(FOOTER), r.choice([f"&copy; {_text(r, 4, 25)}", f"<p>&copy; {_text(r, 4, 40)}</p>", _links(r)]))
    if kind == "side":
        return _wrap(r.choice(SIDE), f"<h3>{_sentence(r, 2)}</h3>" + r.choice([_links(r), f"<p>{_text(r, 5, 60)}</p>", f"<div>{_text(r, 5, 40)}</div>"]))
    if kind == "notice":
        return _wrap(r.choice(NOTICE), r.choice([_text(r, 4, 50), f"<p>{_text(r, 4, 60)}</p><button>{_sentence(r, 1)}</button>"]))
    if kind == "advert":
        return _wrap(r.choice(ADVERT), r.choice([_text(r, 3, 30), f"<p>{_text(r, 3, 60)}</p>", f"<a href='/ad'>{_text(r, 2, 9)}</a>"]))
    if kind == "form":
        return _wrap(r.choice(FORM), f"<label>{_sentence(r, 2)}</label><input><p>{_text(r, 2, 20)}</p><button>{_sentence(r, 1)}</button>")
    one = lambda: r.choice([f"<div class='comment'><p>{_text(r, 3, 90)}</p></div>", f"<li class='comment'><div>{_text(r, 3, 60)}</div></li>", f"<p>{_text(r, 3, 90)}</p>", f"<article class='comment'><h4>{_sentence(r, 2)}</h4><p>{_text(r, 4, 70)}</p></article>"])
    return _wrap(r.choice(COMMENTS), f"<h3>{_sentence(r, 2)}</h3>" + "".join(one() for _ in range(r.randint(1, 4))))


def labelled_pages(n: int = 500, seed: int = 11) -> list[list[tuple[bool, str]]]:
    """Pages as runs of html with whether the run is of the article; containers are of what they hold."""
    r, pages = random.Random(seed), []
    for _ in range(n):
        page: list[tuple[bool, str]] = [(False, "<html><body>")]
        outer = r.choice(["", "", "<div id='page'>", "<div class='wrapper container'>"])
        page.append((False, outer))
        for kind in ("header", "menu", "notice", "advert", "side"):
            if r.random() < 0.5:
                page.append((False, _other(r, kind)))
        tag = r.choice(ARTICLE if r.random() < 0.6 else ["article", "main"])
        page.append((True, f"<{tag}>"))
        if r.random() < 0.8:
            title = f"<h1>{_sentence(r, r.randint(2, 9))}</h1>"
            page.append((True, f"<header>{title}</header>" if r.random() < 0.1 else title))
        for _ in range(r.choice([1, 1, 1, 2, 3])):
            page.append((True, _paragraphs(r, r.choice([1, 1, 2, 3, 4, 5, 6]))))
            if r.random() < 0.2:
                page.append((False, _other(r, r.choice(["advert", "side", "notice", "form"]))))
        if r.random() < 0.15:
            page.append((False, _other(r, "comments")))
        page.append((True, _close(tag)))
        for kind in ("comments", "form", "side", "advert", "menu", "footer"):
            if r.random() < 0.5:
                page.append((False, _other(r, kind)))
        page.append((False, ("</div>" if outer else "") + "</body></html>"))
        pages.append(page)
    return pages
