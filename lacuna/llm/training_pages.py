"""Labelled pages to train the extractor on: random layouts in which it is known which block belongs to the article."""

from __future__ import annotations

import random
import re

MAIN, OTHER = 1, 0
_SYLLABLES = "an be ca do el fi ga ho in ka lo mi no or pa qui re so ta un ver wi".split()
_COMMON = "the of and to in a is that for it der die und le la et de el los con en".split()
_WRAPPERS = ("article", "main", 'div class="content"', 'div class="post-body"', 'section class="story"', 'div id="main-content"', 'div class="entry-content"', 'div class="article-text"', 'article class="post"', "body")
_OUTER = ("main", 'div class="container"', 'div id="page"', 'div class="wrapper"', 'div id="content"', 'section class="layout"', "article")
_ASIDES = ("aside", 'div class="sidebar"', 'div id="right-sidebar"', 'div class="widget"', 'aside class="sidebar"')
_ADS = ('div class="ad"', 'div class="ads banner"', 'div class="advert"', 'div id="advertisement"', 'div class="sponsored promo"', 'section class="promo"')
_NOTICES = ('div class="cookie-notice"', 'div class="notice"', 'div id="banner" role="alert"', 'div class="newsletter subscribe"', 'div class="popup modal"', 'div class="consent"', 'div class="alert"')
_COMMENTS = ('section class="comments"', 'div id="comments"', 'ol class="comment-list"', 'div class="reader-comments"', 'div class="discussion replies"')
_MENUS = ("nav", 'div class="menu"', 'ul class="navbar"', 'div class="breadcrumbs"', 'div class="pagination"', 'div class="related links"', 'div class="share social"', 'div id="navigation"')
_MORE_COMMENTS = ('div id="disqus_thread"', 'ol class="commentlist"', 'div id="respond"', 'section id="responses"', 'div class="thread"')
_THREADS = ('ol class="commentlist"', 'ol class="comment-list"', 'ul class="replies"', 'ol class="thread"', 'ul class="comments"')
_SHARES = ('div class="social"', 'div class="share"', 'p class="sharing"', 'div class="share-bar"', 'div class="social-links"')
_HEADERS = ("header", 'div class="header"', 'div id="masthead"', 'header class="site-header"')
_FOOTERS = ("footer", 'div class="footer"', 'div id="colophon"', 'footer class="site-footer"')


def _words(r: random.Random, n: int) -> str:
    return " ".join(r.choice(_COMMON) if r.random() < 0.4 else "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


def _sentences(r: random.Random, n: int) -> str:
    return " ".join(_words(r, r.randint(4, 18)).capitalize() + "." for _ in range(n))


def _inside(opening: str, body: str) -> str:
    return f"<{opening}>{body}</{opening.split()[0]}>"


def _links(r: random.Random, n: int) -> str:
    return "<ul>" + "".join(f'<li><a href="/x">{_words(r, r.randint(1, 4))}</a></li>' for _ in range(n)) + "</ul>"


def labelled_page(seed: int, wide: bool = False) -> tuple[str, list[int]]:
    """A page and, for each of its blocks in order, whether it is main text.

    ``wide`` pages have more names of comments, bars of share links and headlines in headers of their own, and some are plain: all
    are divs without names, and have no part that only a name would tell apart.
    """
    r = random.Random(seed)
    parts: list[str] = []
    labels: list[int] = []
    plain = wide and r.random() < 0.3
    comments = _COMMENTS + _MORE_COMMENTS if wide else _COMMENTS

    def other(html: str, n: int) -> str:
        labels.extend([OTHER] * n)
        return html

    def menu() -> str:
        n = r.randint(1, 7)
        if wide and r.random() < 0.3:
            between = r.choice(("<br>", " ", " | "))
            return other(_inside(r.choice(("td", "div", "p", *_MENUS[:2])), between.join(f'<a href="/m">{_words(r, r.randint(1, 2))}</a>' for _ in range(n))), 1)
        return other(_inside(r.choice(_MENUS), _links(r, n)), n)

    def shares() -> str:
        n = r.randint(1, 4)
        bar = "".join(f'<a href="/s">{r.choice(("Share on", "Share via", "Tweet", "Send to", "Teilen auf", "Partager sur"))} {_words(r, 1).capitalize()}</a>' for _ in range(n))
        return other(_inside(r.choice(_SHARES), bar), 1)

    def note(kinds: tuple[str, ...]) -> str:
        if plain:
            return ""
        n = r.randint(1, 2)
        if wide and kinds is comments and r.random() < 0.4:
            return other(_inside(r.choice(_THREADS), "".join(f"<li>{_sentences(r, r.randint(1, 3))}</li>" for _ in range(n))), n)
        tag = r.choice(("p", "div", "span"))
        if tag == "span":
            return other(_inside(r.choice(kinds), f"<span>{_sentences(r, r.randint(1, 3))}</span>"), 1)
        return other(_inside(r.choice(kinds), "".join(f"<{tag}>{_sentences(r, r.randint(1, 3))}</{tag}>" for _ in range(n))), n)

    def form() -> str:
        return other(f"<form><p>{_words(r, 3)}</p><input type=text><button>{_words(r, 2)}</button></form>", 2)

    def paragraphs() -> str:
        out = []
        for _ in range(r.randint(1, 10)):
            kind = r.random()
            labels.append(MAIN)
            if kind < 0.1:
                out.append(f"<h2>{_words(r, r.randint(2, 8))}</h2>")
            elif kind < 0.17:
                out.append(f"<blockquote>{_sentences(r, 2)}</blockquote>")
            elif kind < 0.25:
                k = r.randint(1, 4)
                labels.extend([MAIN] * (k - 1))
                out.append("<ul>" + "".join(f"<li>{_words(r, r.randint(2, 14))}</li>" for _ in range(k)) + "</ul>")
            elif kind < 0.3:
                out.append(f"<pre>{_words(r, 8)}</pre>")
            else:
                body = _words(r, r.randint(1, 3)) + r.choice((".", "")) if r.random() < 0.12 else _sentences(r, r.randint(1, 9))
                if r.random() < 0.15:
                    body = f'<a href="/y">{_words(r, 2)}</a> {body}'
                out.append(r.choice(("<p>{}</p>", "<p><b>{}<br>", "<p>{}", "<p class='text'>{}</p>", "<div>{}</div>")).format(body))
            if r.random() < 0.12:
                out.append(r.choice((lambda: note(_ADS), lambda: note(_NOTICES), lambda: note(_ASIDES), menu, form))())
        return "".join(out)

    if r.random() < 0.5:
        parts.append(note(_NOTICES))
    if r.random() < 0.6:
        h = r.choice(("h1", "h2", "h2", "h3", "div")) if wide else "h1"
        parts.append(other(_inside(r.choice(_HEADERS), f"<{h}>{_words(r, 3)}</{h}>" + (f"<p>{_words(r, 6)}</p>" * (k := r.randint(0, 1)))), 1 + k))
    parts += [menu() for _ in range(r.randint(0, 2))]
    if r.random() < 0.5:
        parts.append(note(_ADS))
    if r.random() < 0.3:
        parts.append(note(_ASIDES))
    wrapper = r.choice(_WRAPPERS + ("section", "div") if wide else _WRAPPERS)
    title = f"<h1>{_words(r, r.randint(2, 12))}</h1>" if r.random() < 0.8 else ""
    labels += [MAIN] if title else []
    if wide and title and wrapper.startswith(("article", "main", "section")) and r.random() < 0.5:
        title = f"<header>{title}</header>"
    text = title + paragraphs()
    if wide and r.random() < 0.25:
        text += shares()
    if wrapper != "body" and r.random() < 0.25:
        text += note(comments)
    text = text if wrapper == "body" else _inside(wrapper, text)
    if wrapper != "body":
        for _ in range(r.choice((0, 0, 0, 1, 1, 2))):
            text = _inside(r.choice(_OUTER), text + (note(_ASIDES) if r.random() < 0.2 else ""))
    parts.append(text)
    if r.random() < 0.4 and not plain:
        n = r.randint(1, 4)
        parts.append(other(_inside(r.choice(comments), "".join(f"<p>{_sentences(r, r.randint(1, 4))}</p>" for _ in range(n))), n))
    for chance, make in ((0.3, lambda: note(_ASIDES)), (0.3, form), (0.4, menu), (0.3, lambda: note(_ADS)), (0.3, lambda: note(_NOTICES))):
        if r.random() < chance:
            parts.append(make())
    if r.random() < 0.8:
        parts.append(other(_inside(r.choice(_FOOTERS), r.choice(("&copy; {}", "<p>&copy; {}</p>", "<p>{}</p>", "{} &middot; x")).format(_words(r, r.randint(2, 14)))), 1))
    head = f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{_words(r, 4)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
    if plain:
        parts = [re.sub(r"(</?)(?:nav|header|footer|aside|main|article|section)\b", r"\1div", re.sub(r"<(\w+) (?:class|id|role)=[^>]*", r"<\1", p)) for p in parts]
    return head + "".join(parts) + r.choice(("</body></html>", "")), labels
