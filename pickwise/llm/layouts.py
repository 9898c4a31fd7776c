"""Training pages for the block labeller, laid out by rule from common page parts; every block's label is known.

Main text stands in any of the usual containers, around and inside it stand menus, headers, footers, side bars,
notices, adverts, forms and comments. Words are drawn at random for both, so the labeller learns places and names,
with the usual words of page furniture as the only words that tell.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

FURNITURE_WORDS = "home about contact login register search subscribe newsletter share tweet follow comments reply related posts popular tags categories copyright rights reserved privacy terms cookies accept advertisement sponsored menu next previous archive sitemap".split()
MAIN = ('article', 'main', 'div class="content"', 'div class="post"', 'div class="entry-content"', 'div id="main"', 'div class="article-body"', 'section class="story"', 'div class="post-body text"', 'main role="main"', 'div', 'td class="main"', 'div itemprop="articleBody"', 'section')
TOP = ('nav', 'header', 'div class="menu"', 'div id="nav"', 'ul class="navbar"', 'div class="header"', 'div class="top-bar"', 'div class="breadcrumb"', 'nav class="breadcrumbs"', 'div role="navigation"', 'div class="masthead"', 'header class="site-header"')
SIDE = ('aside', 'div class="sidebar"', 'div id="sidebar"', 'aside class="related"', 'div class="widget"', 'div class="related-posts"', 'section class="recommended"', 'div role="complementary"', 'div class="share social"', 'div class="tags"', 'div class="pagination"', 'div class="author-box"')
ADVERT = ('div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'aside class="ad"', 'div class="sponsored"', 'div id="banner-ad"', 'div class="promo"', 'section class="promo banner"', 'div class="ad-slot"')
NOTICE = ('div class="cookie-notice"', 'div id="cookie-banner"', 'div class="notice"', 'div class="consent"', 'div class="popup newsletter"', 'div class="alert"', 'div role="alert"', 'div class="subscribe"', 'div class="modal"', 'section class="gdpr"', 'div class="paywall"', 'dialog')
FORM = ('form', 'form class="search"', 'form id="login"', 'form class="newsletter-form"', 'fieldset')
COMMENTS = ('div class="comments"', 'section id="comments"', 'ol class="comment-list"', 'section class="comments"', 'div class="comment"', 'div id="disqus"', 'div class="reader-comments"', 'div class="responses"', 'aside class="comments"')
FOOT = ('footer', 'div class="footer"', 'div id="footer"', 'footer class="site-footer"', 'div class="copyright"', 'div class="legal"', 'div role="contentinfo"', 'div class="bottom-bar"')


def page(rng: np.random.Generator) -> tuple[str, Callable[[str], bool]]:
    """A page, and a function that tells of a block's text whether it is main text."""
    main: set[str] = set()
    pick = lambda options: options[int(rng.integers(len(options)))]
    chance = lambda p: rng.random() < p

    def word() -> str:
        return "".join(chr(97 + int(k)) for k in rng.integers(0, 26, int(rng.integers(2, 10))))

    def phrase(low: int, high: int, furniture: float = 0.0) -> str:
        return " ".join(pick(FURNITURE_WORDS) if chance(furniture) else word() for _ in range(int(rng.integers(low, high))))

    def sentence(low: int = 4, high: int = 60) -> str:
        return phrase(low, high).capitalize() + ("." if chance(0.9) else "")

    def wrap(opening: str, inner: str) -> str:
        return f"<{opening}>{inner}</{opening.split()[0]}>"

    def links(n: int, furniture: float = 0.4) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{phrase(1, 4, furniture)}</a></li>' for _ in range(n)) + "</ul>"

    def text() -> str:
        t = sentence(1, 8) if chance(0.25) else sentence()
        main.add(t)
        inner = t.split(" ")
        if len(inner) > 3 and chance(0.3):
            k = int(rng.integers(len(inner)))
            inner[k] = wrap(pick(("a href='/x'", "b", "em", "span")), inner[k])
        return " ".join(inner)

    def plain(furniture: float = 0.2) -> str:
        return "".join(wrap(pick(("p", "div", "span", "p", "h3")), (sentence if chance(0.5) else lambda: phrase(2, 14, furniture))()) for _ in range(int(rng.integers(1, 4))))

    def furniture(names: tuple[str, ...]) -> str:
        inner = pick((lambda: links(int(rng.integers(2, 9))), plain, lambda: sentence(), lambda: phrase(1, 10, 0.3)))()
        if names is TOP and chance(0.3):
            inner = f"<{(h := pick(('h1', 'h2', 'p', 'div')))}>{phrase(1, 4)}</{h}>" + (inner if chance(0.5) else "")
        if names is FORM and chance(0.7):
            inner = f"<label>{phrase(1, 4, 0.3)}</label><input name='q'><p>{phrase(2, 8, 0.3)}</p><button>{phrase(1, 3, 0.5)}</button>"
        if names is COMMENTS:
            inner = "".join(wrap(pick(('div class="comment"', "li", "div", "article class='comment'")), f"<p>{phrase(1, 3)}</p><p>{sentence()}</p>") for _ in range(int(rng.integers(1, 6))))
        return wrap(pick(names), inner)

    def article() -> str:
        out = []
        if chance(0.85):
            title = phrase(2, 10).capitalize() + ("." if chance(0.3) else "")
            main.add(title)
            out.append(wrap("header", f"<h1>{title}</h1>") if chance(0.1) else f"<h1>{title}</h1>")
            if chance(0.3):
                main.add(title)
                line = wrap(pick(("b", "strong", "em", "span class='lead'", "i")), title) if chance(0.5) else f"<{pick(('b', 'strong', 'em'))}>{title}"
                line += pick(("", "<br>", "<br/>"))
                out.append(wrap(pick(("p", "div", "h2")), line) if chance(0.5) else f"<p>{line}")
        for _ in range(int(rng.integers(1, 14))):
            r = rng.random()
            if r < 0.75:
                out.append(f"<p>{text()}</p>" if chance(0.9) else f"<p>{text()}")
            elif r < 0.81:
                out.append(wrap(pick(("h2", "h3", "h4")), text()))
            elif r < 0.87:
                out.append(wrap(pick(("ul", "ol")), "".join(f"<li>{text()}</li>" for _ in range(int(rng.integers(1, 5))))))
            elif r < 0.91:
                out.append(wrap("blockquote", f"<p>{text()}</p>"))
            elif r < 0.94:
                out.append("<table><tr>" + "".join(f"<td>{text()}</td>" for _ in range(2)) + "</tr></table>")
            else:
                out.append(wrap(pick(("div", "pre", "section")), text()))
            if chance(0.12):
                out.append(furniture(pick((ADVERT, ADVERT, SIDE, FORM, NOTICE, COMMENTS))))
        if chance(0.12):
            out.append(furniture(COMMENTS))
        if chance(0.06):
            out.append(wrap("footer", phrase(2, 8, 0.4)))
        return "".join(out)

    body = [furniture(pick((TOP, TOP, NOTICE, ADVERT, FORM))) for _ in range(int(rng.integers(0, 5)))]
    bare = chance(0.06)  # no container at all
    body.append(article() if bare else wrap(pick(MAIN), article()))
    body += [furniture(pick((SIDE, ADVERT, COMMENTS, FOOT, NOTICE, FORM))) for _ in range(int(rng.integers(0, 4)))]
    if chance(0.8):
        body.append(furniture(FOOT))
    inner = "".join(body)
    if chance(0.4):
        inner = wrap(pick(('div class="wrapper"', 'div id="page"', 'div class="container"', "div")), inner)
    known = frozenset(main)
    return f"<html><head><title>{phrase(2, 6)}</title></head><body>{inner}</body></html>", lambda t: t in known
