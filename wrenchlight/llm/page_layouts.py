"""Made-up page layouts to train the main-text model on: the blocks of a labelled page in other containers, under other names.

Names are drawn from lists of what sites call their parts. One container in four also has a name that misleads, so that
training cannot rely on a single word. Texts of menus and notices come from the page; comments and teasers are sentences of the article itself.
"""

from __future__ import annotations

import html
from random import Random

ARTICLE = "article content entry main post story text body articlebody news beitrag inhalt artikel contenu texte contenido articulo noticia blog page prose markdown".split()
PARTS_OF_PAGES: dict[str, list[str]] = {
    "menu": "nav navbar navigation menu topbar toolbar breadcrumb breadcrumbs pager pagination links masthead skip navegacion sitemap".split(),
    "header": "header top banner branding logo masthead kopf kopfzeile entete cabecera".split(),
    "footer": "footer bottom copyright legal colophon imprint impressum fusszeile pied pie".split(),
    "sidebar": "sidebar aside widget related recommended trending popular tags archive seitenleiste barre lateral verwandt similares more next".split(),
    "notice": "cookie cookies consent gdpr notice notification alert banner popup modal paywall privacy hinweis avis aviso dialog".split(),
    "advert": "ad ads adv advert advertisement sponsor sponsored promo promotion werbung anzeige publicite publicidad".split(),
    "form": "form newsletter subscribe subscription signup login search contact anmeldung inscription suscripcion".split(),
    "comments": "comment comments reply replies discussion disqus responses kommentare kommentar commentaires comentarios reactions thread".split(),
    "share": "share sharing social follow meta teilen partager compartir tools actions".split(),
}
TAGS = {
    "menu": ("nav", "div", "ul", "header", "nav"), "header": ("header", "div", "header"), "footer": ("footer", "div", "footer", "section"), "sidebar": ("aside", "div", "section", "aside"),
    "notice": ("div", "section", "dialog", "aside"), "advert": ("div", "aside", "section", "p"), "form": ("form", "div", "section", "form"), "comments": ("section", "div", "ol", "section"),
    "share": ("div", "ul", "section"),
}
# A private character, which pages do not hold.
MARK = "\ue000"
MISLEADING = ("wrapper", "container", "block", "inner", "item", "box", "note", "list", "col", "row")
FILLER = (
    "A short title of some words", "The first paragraph tells what happened, when it did, and who was there to see it.", "Another one goes on, with more words and a few commas, until all is said about the matter.",
    "Home", "About us", "All rights reserved, worldwide, by the owners of this page.", "Read more", "We use cookies, please accept them.",
)


def _names(dice: Random, own: list[str], others: list[str], misleading: float) -> str:
    chosen = dice.sample(own, min(len(own), dice.choice((1, 1, 2))))
    if dice.random() < 0.4:
        chosen.append(dice.choice(MISLEADING))
    if dice.random() < misleading:
        chosen.append(dice.choice(others))
    dice.shuffle(chosen)
    joined = dice.choice((" ", "-", "-", "_")).join(chosen)
    if dice.random() < 0.3:
        joined = dice.choice(("site-", "js-", "l-", "c-", "page-")) + joined
    return f'{dice.choice(("class", "class", "class", "id"))}="{joined}"'


def _paragraphs(texts: list[str], tag: str) -> str:
    return "".join(f"<{tag}>{html.escape(t)}</{tag}>" for t in texts)


def _linked(texts: list[str]) -> str:
    return "<ul>" + "".join(f'<li><a href="/x">{html.escape(t)}</a></li>' for t in texts) + "</ul>"


def _part(kind: str, inside: list[str], outside: list[str], dice: Random) -> str:
    tag = dice.choice(TAGS[kind])
    # Elements that say what they are may go without a name.
    plain = tag in ("nav", "header", "footer", "aside", "form") and dice.random() < 0.4
    names = "" if plain else " " + _names(dice, PARTS_OF_PAGES[kind], ARTICLE, 0.25)
    short = [t for t in outside if t.count(" ") < 6] or list(outside)
    sentences = [s.strip() + "." for t in inside for s in t.split(".") if s.count(" ") >= 4] or list(inside)
    some = lambda of, most: [dice.choice(of) for _ in range(dice.randint(1, most))]
    if kind == "menu":
        body = _linked(some(short, 8))
    elif kind in ("header", "footer", "notice", "form", "advert"):
        body = _paragraphs(some(outside if dice.random() < 0.6 else sentences, 3), "p")
        body += dice.choice(("", "<button>OK</button>", _linked(some(short, 4))))
    elif kind == "comments":
        body = _paragraphs([dice.choice(short)], "h2" if dice.random() < 0.5 else "h3")
        body += "".join(f"<{t}>{_paragraphs(some(sentences, 2), 'p')}</{t}>" for t in some(("div", "li", "article", "div"), 5))
    elif kind == "share":
        body = _linked(some(short, 4))
    else:
        body = _paragraphs([dice.choice(short)], "h3") + (_linked(some(outside, 5)) if dice.random() < 0.5 else _paragraphs(some(sentences, 4), "p"))
    if tag == "p":
        body = html.escape(dice.choice(sentences))
    return f"<{tag}{names}>{body}</{tag}>"


def layout(inside: list[str], outside: list[str], dice: Random) -> str:
    """A page whose article blocks begin with ``MARK``. inside: texts of an article's blocks; outside: of the rest of its page."""
    texts = [t for t in inside if t][: dice.randint(1, 20)]
    others = sum(PARTS_OF_PAGES.values(), [])
    part = lambda kind: _part(kind, inside, outside, dice)
    article = []
    for i, t in enumerate(texts):
        tag = "h1" if i == 0 and t.count(" ") < 15 else dice.choices(("p", "h2", "blockquote", "li", "div"), (12, 1 if t.count(" ") < 12 else 0, 1, 1, 1))[0]
        shown = MARK + html.escape(t)
        words = shown.split(" ")
        if len(words) > 6 and dice.random() < 0.2 and "&" not in shown:
            words[2:4] = [f'<a href="/y">{" ".join(words[2:4])}</a>']
            shown = " ".join(words)
        article.append(f"<ul><li>{shown}</li></ul>" if tag == "li" else f"<{tag}>{shown}</{tag}>")
        if dice.random() < 0.2:
            article.append(part(dice.choice(("advert", "sidebar", "share", "form"))))
    kind = dice.choice(("article", "article", "main", "div", "div", "section", "td"))
    names = " " + _names(dice, ARTICLE, others, 0.25) if kind in ("div", "section", "td") or dice.random() < 0.5 else ""
    if dice.random() < 0.15:
        # A box of the article itself, under a name that says nothing.
        at = dice.randrange(len(article) + 1)
        article[at:] = [f'<div class="{dice.choice(MISLEADING)}">', *article[at:], "</div>"]
    tail = "".join(part(k) for k in ("share", "sidebar", "comments") if dice.random() < 0.4)
    core = "".join(article)
    core = f"<table><tr><td{names}>{core}</td></tr></table>" if kind == "td" else f"<{kind}{names}>{core}{tail if dice.random() < 0.5 else ''}</{kind}>"
    if dice.random() < 0.3:
        core = f'<div {_names(dice, list(MISLEADING), others, 0.2)}>{core}</div>'
    if dice.random() < 0.2:
        core = f"<main>{core}{part('comments') if dice.random() < 0.5 else ''}</main>"
    before = [part(k) for k in ("header", "menu", "notice", "advert", "sidebar", "form") if dice.random() < 0.5]
    after = [part(k) for k in ("sidebar", "comments", "form", "advert", "notice", "menu") if dice.random() < 0.4] + [part("footer")] * (dice.random() < 0.9)
    dice.shuffle(before)
    return f"<html><head><title>{html.escape(texts[0] if texts else '')}</title></head><body>{''.join(before)}{core}{''.join(after)}</body></html>"
