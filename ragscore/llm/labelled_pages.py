"""Labelled web pages for operator 6: layouts, element names and class names drawn at random.

An element's data-label says whether its text is content (1) or not (0); elements without one have their parent's.
"""

from __future__ import annotations

import random

_SYLLABLES = "ba de ki lo mu na pe ri so tu va wen xor yil zan chi eur ost ind lem".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))


def _words(r: random.Random, low: int, high: int) -> str:
    return " ".join(_word(r) for _ in range(r.randint(low, high)))


def _prose(r: random.Random, low: int = 1, high: int = 6, ends: str = "") -> str:
    """Sentences; ``ends`` stands in the place of the last one's full stop."""
    out = []
    for _ in range(r.randint(low, high)):
        s = _words(r, 1, 22)
        if r.random() < 0.15:
            s += f' <a href="/{_word(r)}">{_words(r, 1, 3)}</a> {_words(r, 1, 6)}'
        if r.random() < 0.1:
            s = f"<b>{s}</b>"
        out.append(s.capitalize() + r.choice([".", ".", ".", "!", "?"]))
    return " ".join(out) if not ends else " ".join(out)[:-1] + ends.replace("-", "")


def _named(r: random.Random, names: str, plain: float = 0.2) -> str:
    if r.random() < plain:
        return ""
    name = r.choice(names.split())
    tail = r.choice(["", "", "-" + _word(r), " " + _word(r)])
    return f' {r.choice(["class", "class", "id"])}="{name}{tail}"'


def _links(r: random.Random, low: int = 2, high: int = 9) -> str:
    items = [f'<a href="/{_word(r)}">{_words(r, 1, 3)}</a>' for _ in range(r.randint(low, high))]
    style = r.random()
    if style < 0.6:
        return "<ul>" + "".join(f"<li>{x}</li>" if r.random() < 0.9 else f"<li>{x}" for x in items) + "</ul>"
    if style < 0.8:
        return " | ".join(items)
    return "".join(f"<div>{x}</div>" for x in items)


def _box(r: random.Random, tags: str, names: str, inner: str, plain: float = 0.2, label: int = 0) -> str:
    tag = r.choice(tags.split())
    bare = 0.5 if tag not in ("div", "section", "p", "ul") else plain
    return f'<{tag}{_named(r, names, bare)} data-label="{label}">{inner}</{tag}>'


def _untold(r: random.Random, inner: str) -> str:
    """Clutter that only its links or its shortness tell: a box without a telling name."""
    return f'<div{r.choice(["", f' class="{_word(r)}"'])} data-label="0">{inner}</div>'


def _menu(r: random.Random) -> str:
    if r.random() < 0.15:
        return _untold(r, r.choice([" ", " | ", ""]).join(f'<a href="/{_word(r)}">{_words(r, 1, 3)}</a>' for _ in range(r.randint(1, 7))))
    return _box(r, "nav nav div header", "nav navbar menu navigation breadcrumb topbar", _links(r), 0.25)


def _header(r: random.Random) -> str:
    return _box(r, "header header div", "header masthead banner topbar", f"<{(t := r.choice(['div', 'p', 'h1', 'span']))}>{_words(r, 1, 5)}</{t}>" + (_links(r) if r.random() < 0.5 else ""), 0.0)


def _footer(r: random.Random) -> str:
    if r.random() < 0.15:
        return _untold(r, f"{r.choice(['', '&copy; '])}{_words(r, 1, 3).title()} {r.randint(1990, 2040)}")
    return _box(r, "footer footer div", "footer copyright legal bottom", f"&copy; {_word(r)}.example.net &middot; {_prose(r, 1, 3)}" + (_links(r) if r.random() < 0.3 else ""), 0.0)


def _side(r: random.Random) -> str:
    inner = "".join(r.choice([lambda: _links(r), lambda: f"<h3>{_words(r, 1, 3)}</h3>{_links(r)}", lambda: f"<p>{_prose(r, 1, 2)}</p>"])() for _ in range(r.randint(1, 3)))
    return _box(r, "aside aside div", "sidebar side widget related popular trending rail", inner, 0.0)


def _advert(r: random.Random) -> str:
    return _box(r, "div div aside p section", "ad ads advert advertisement sponsored promo banner", r.choice([_prose(r, 1, 3), f"<p>{_prose(r, 1, 2)}</p>", f'<a href="//ad.example">{_words(r, 2, 8)}</a>']), 0.0)


def _notice(r: random.Random) -> str:
    return _box(r, "div div section aside dialog", "cookie consent notice alert popup modal newsletter subscribe gdpr", f"<p>{_prose(r, 1, 2)}</p>" + (f"<button>{_words(r, 1, 2)}</button>" if r.random() < 0.6 else ""), 0.0)


def _form(r: random.Random) -> str:
    return f'<form data-label="0"{_named(r, "search login signup contact form")}><label>{_words(r, 1, 3)}</label><input name="q"><p>{_words(r, 1, 6)}</p><button>{_word(r)}</button></form>'


def _comments(r: random.Random) -> str:
    one = lambda: r.choice(["<div class=\"comment\"><p>{}</p></div>", "<li><b>{}</b><p>{}</p></li>", "<div><p>{}</p></div>", "<article><p>{}</p></article>"]).replace("{}", _prose(r, 1, 3))
    return _box(r, "div div section ul ol", "comments comment-list replies disqus discussion comments", f"<h{(n := r.randint(2, 4))}>{_words(r, 1, 3)}</h{n}>" * (r.random() < 0.6) + "".join(one() for _ in range(r.randint(1, 4))), 0.0)


def _share(r: random.Random) -> str:
    return _box(r, "div ul p", "share social follow tags byline", _links(r, 2, 4), 0.0)


#: Words that sites also give to what holds an article.
_TOPICS = "more tags archive popular related featured trending side banner meta social post-tags form complementary"


def _topical(r: random.Random, names: str, plain: float) -> str:
    """Names of an article's container, now and then with a word that elsewhere names clutter, or with no telling word."""
    x = r.random()
    if x < 0.12:
        return f' class="{r.choice(names.split())} {r.choice(_TOPICS.split())}{r.choice(["", "-" + _word(r)])}"'
    if x < 0.2:
        return f' {r.choice(["class", "id"])}="{_word(r)}"'
    if x < 0.26:
        return f' data-{r.choice(["class", "id", "role", "style"])}="{r.choice(_TOPICS.split())} {_word(r)}"'
    return _named(r, names, plain)


_CLUTTER = [_advert, _advert, _notice, _share, _form, _side]


def _piece(r: random.Random, ends: str = "", block: str = "p") -> str:
    x = r.random()
    if x < 0.62:
        return f"<{block}>{_prose(r, ends=ends)}" + (f"</{block}>" if block != "p" or r.random() < 0.9 else "")
    if x < 0.72:
        n = r.randint(2, 4)
        return f"<h{n}>{_words(r, 1, 8)}</h{n}>"
    if x < 0.79:
        return "<ul>" + "".join(f"<li>{_prose(r, 1, 2, ends)}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
    if x < 0.84:
        return f"<blockquote><p>{_prose(r, 1, 3, ends)}</p></blockquote>"
    if x < 0.88:
        return f"<figure><img src='a.png'><figcaption>{_words(r, 2, 9)}</figcaption></figure>"
    if x < 0.92:
        return "<table>" + "".join(f"<tr><td>{_words(r, 1, 4)}</td><td>{_words(r, 1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
    if x < 0.95:
        return f"<pre>{_words(r, 4, 20)}</pre>"
    return f"<div>{_prose(r, 1, 4, ends)}</div>"


def _article(r: random.Random) -> str:
    parts = [f"<h1>{_words(r, 2, 9)}</h1>"] if r.random() < 0.85 else []
    if parts and r.random() < 0.15:
        parts = [f"<header data-label=\"1\">{parts[0]}</header>"]
    ends = r.choice(["", "", "", "-", " [1]", ":", ". [12]"])  # some sites end no paragraph with a full stop
    block = r.choice(["p"] * 4 + ["div"])
    for _ in range(r.choice([1, 2, 3, 5, 8, 14])):
        parts.append(_piece(r, ends, block))
        if r.random() < 0.08:
            parts.append(r.choice(_CLUTTER)(r))
    if r.random() < 0.12:
        parts += [f"<p>{_words(r, 1, 4)}.</p>" for _ in range(r.randint(10, 60))]
    if r.random() < 0.2:
        parts.append(_comments(r))
    inner = "".join(parts)
    if r.random() < 0.25:
        inner = f'<div{_topical(r, "content entry body text", 0.4)}>{inner}</div>'
    tag = r.choice(["article"] * 5 + ["main", "main", "div", "section"])
    names = _topical(r, "article content post entry main story", 0.6 if tag in ("article", "main") else 0.2)
    return f'<{tag}{names} data-label="1">{inner}</{tag}>'


def labelled_page(r: random.Random) -> str:
    before = [f(r) for f in (_header, _menu, _notice, _advert, _form, _side) if r.random() < (0.85 if f is _menu else 0.4)]
    after = [f(r) for f in (_comments, _side, _share, _advert, _form, _menu, _notice, _footer) if r.random() < (0.85 if f is _footer else 0.3)]
    middle = _article(r)
    if r.random() < 0.3:
        side = _side(r)
        middle = f'<div{_named(r, "container wrapper row page layout", 0.3)} data-label="0">' + (middle + side if r.random() < 0.5 else side + middle) + "</div>"
    if r.random() < 0.1:
        middle = f'<main data-label="0">{middle}</main>'
    body = "".join([*before, middle, *after])
    return f"<!DOCTYPE html><html><head><title>{_words(r, 2, 8)}</title><style>p{{margin:0}}</style></head><body>{body}" + ("</body></html>" if r.random() < 0.9 else "")
