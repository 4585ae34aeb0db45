"""Labelled pages to train the content model: written here, with varied frames and names.

Elements that are content, and those around content alone, carry the class word
``y1``; the model's features do not see it.
"""

from __future__ import annotations

import random

PAGES = 400


def labelled_pages(n: int = PAGES, seed: int = 3) -> list[str]:
    rng = random.Random(seed)
    return [_page(rng) for _ in range(n)]


def _words(rng: random.Random, low: int, high: int) -> str:
    text = " ".join("".join(rng.choice("aeiounrstlmd") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(low, high)))
    return text[:1].upper() + text[1:]


def _sentences(rng: random.Random, low: int, high: int) -> str:
    return " ".join(_words(rng, 1, 18) + rng.choice(["."] * 6 + ["!", "?", "", ","]) for _ in range(rng.randint(low, high)))


def _links(rng: random.Random, low: int, high: int, tag: str = "li") -> str:
    return "".join(f'<{tag}><a href="/{i}">{_words(rng, 1, 4)}</a></{tag}>' for i in range(rng.randint(low, high)))


def _named(rng: random.Random, names: str, share: float = 0.8) -> str:
    return f' {rng.choice(["class", "class", "id"])}="{rng.choice(names.split())}"' if rng.random() < share else ""


def _nav(rng: random.Random) -> str:
    tag = rng.choice(["nav", "nav", "div", "ul"])
    inner = _links(rng, 2, 9) if tag == "ul" else f"<ul>{_links(rng, 2, 9)}</ul>"
    return f"<{tag}{_named(rng, 'nav menu navbar breadcrumb topbar', 1 if tag != 'nav' else 0.4)}>{inner}</{tag}>"


def _advert(rng: random.Random) -> str:
    tag = rng.choice(["div", "div", "aside", "section"])
    body = _sentences(rng, 1, 4)
    body = rng.choice([body, f"<p>{body}</p>", f'<a href="/x">{body}</a>'])
    return f'<{tag} class="{rng.choice("ad ads advert sponsored promo banner ad-box".split())}">{body}</{tag}>'


def _notice(rng: random.Random) -> str:
    body = rng.choice(["{}", "<p>{}</p>"]).format(_sentences(rng, 1, 3))
    return f'<div class="{rng.choice("cookie-notice consent notice alert popup gdpr".split())}">{body}</div>'


def _side(rng: random.Random) -> str:
    tag = rng.choice(["aside", "aside", "div"])
    body = f"<h3>{_words(rng, 1, 4)}</h3>" + rng.choice([f"<ul>{_links(rng, 2, 7)}</ul>", f"<p>{_sentences(rng, 1, 4)}</p>"])
    return f"<{tag}{_named(rng, 'sidebar widget side rail', 1 if tag == 'div' else 0.5)}>{body}</{tag}>"


def _form(rng: random.Random) -> str:
    body = f"<label>{_words(rng, 1, 3)}</label><input name=q>" + rng.choice(["", f"<p>{_sentences(rng, 1, 2)}</p>"])
    return f"<form{_named(rng, 'search newsletter login contact-form', 0.6)}>{body}</form>"


def _comments(rng: random.Random) -> str:
    one = [f'<{t} class="{c}"><p>{_sentences(rng, 1, 4)}</p></{t}>' for t, c in [rng.choice([("div", "comment"), ("li", "comment"), ("article", "comment"), ("div", "reply")])] for _ in range(rng.randint(1, 5))]
    tag = rng.choice(["section", "div", "ol"])
    head = "" if tag == "ol" else f"<h2>{_words(rng, 1, 3)}</h2>"
    return f'<{tag} {rng.choice(["class", "id"])}="{rng.choice("comments discussion responses comments-area replies".split())}">{head}{"".join(one)}</{tag}>'


def _extra(rng: random.Random) -> str:
    """What may also stand inside an article."""
    kind = rng.randrange(5)
    if kind == 0:
        return _advert(rng)
    if kind == 1:
        return f'<div class="{rng.choice("share social related recommended tags".split())}"><ul>{_links(rng, 2, 5)}</ul></div>'
    if kind == 2:
        return _form(rng)
    if kind == 3:
        return _notice(rng)
    return f'<aside>{rng.choice(["<p>{}</p>", "{}"]).format(_sentences(rng, 1, 3))}</aside>'


def _article(rng: random.Random) -> str:
    parts = []
    if rng.random() < 0.85:
        level = rng.choice(["h1", "h1", "h2"])
        parts.append(f'<{level} class="y1">{_words(rng, 1, 12)}{rng.choice(["", ".", "!"])}</{level}>')
    for _ in range(rng.choice([1, 2, 3, 5, 8, 12])):
        kind = rng.random()
        if kind < 0.74:
            body = rng.choice([_sentences(rng, 1, 8), _sentences(rng, 1, 2), _words(rng, 1, 3) + "."])
            if rng.random() < 0.15:
                body += f' <a href="/y">{_words(rng, 1, 3)}</a>.'
            parts.append(f'<p class="y1">{body}' + rng.choice(["</p>"] * 5 + [""]))
        elif kind < 0.8:
            parts.append(f'<h2 class="y1">{_words(rng, 1, 6)}</h2>')
        elif kind < 0.86:
            parts.append('<ul class="y1">' + "".join(f'<li class="y1">{_words(rng, 1, 14)}</li>' for _ in range(rng.randint(1, 5))) + "</ul>")
        elif kind < 0.89:
            parts.append(f'<blockquote class="y1">{_sentences(rng, 1, 3)}</blockquote>')
        elif kind < 0.92:
            rows = "".join(f'<tr class="y1"><td class="y1">{_words(rng, 1, 4)}</td><td class="y1">{rng.randint(1, 999)}</td></tr>' for _ in range(rng.randint(1, 4)))
            parts.append(f'<table class="y1">{rows}</table>')
        elif kind < 0.94:
            parts.append(f'<pre class="y1">{_words(rng, 3, 20)}</pre>')
        else:
            parts.append(_extra(rng))
    if rng.random() < 0.15:
        parts.append(_comments(rng))
    body = "".join(parts)
    if rng.random() < 0.2:
        body = f'<div class="y1 {rng.choice("content entry-content post-body text x1 c9".split())}">{body}</div>'
    tag = rng.choice(["article", "article", "article", "main", "div", "div", "section"])
    name = rng.choice("content post entry article-body story main-content".split()) if tag in ("div", "section") else rng.choice(["", "", "post", "x2"])
    return f'<{tag} class="y1 {name}">{body}</{tag}>'


def _page(rng: random.Random) -> str:
    before, after = [], []
    if rng.random() < 0.5:
        tag = rng.choice(["header", "header", "div"])
        before.append(f"<{tag}{_named(rng, 'header masthead site-header', 1 if tag == 'div' else 0.4)}><h2>{_words(rng, 1, 5)}</h2>{_nav(rng) if rng.random() < 0.6 else ''}</{tag}>")
    else:
        before.append(_nav(rng))
    for make, share in ((_advert, 0.5), (_notice, 0.3), (_side, 0.25), (_form, 0.25)):
        if rng.random() < share:
            rng.choice([before, after]).append(make(rng))
    if rng.random() < 0.3:
        after.append(_comments(rng))
    if rng.random() < 0.85:
        tag = rng.choice(["footer", "footer", "div"])
        body = rng.choice(["{}", "<p>{}</p>", "<ul>{}</ul>"]).format(rng.choice([_sentences(rng, 1, 2), "&copy; " + _words(rng, 1, 5)]))
        after.append(f"<{tag}{_named(rng, 'footer legal site-footer copyright', 1 if tag == 'div' else 0.3)}>{body}</{tag}>")
    middle = _article(rng)
    if rng.random() < 0.2:
        middle = f"<div{_named(rng, 'wrapper page container', 0.7)}>{''.join(before)}{middle}{''.join(after)}</div>"
        before, after = [], []
    end = rng.choice(["</body></html>", "</body></html>", ""])
    return f"<!DOCTYPE html><html><head><title>{_words(rng, 1, 9)}</title></head><body>{''.join(before)}{middle}{''.join(after)}{end}"
