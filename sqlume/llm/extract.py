"""Main-text extraction: boosted trees over DOM blocks, decoded over the tree.

Every block element gets features of its own (tag, attribute tokens, depth, text and link characters), of its subtree
(text density, links' share, blocks), of its siblings (place, equal tags, share of the parent's text) and of its
ancestors. Boosted trees score whether it belongs to the article or leads to it. Decoding then picks the most likely
set of blocks in which a dropped block drops all below it and a kept one has kept ancestors, so that choices of
ancestors and descendants never contradict each other.

The trees are fitted on generated pages of many layouts, whose blocks are labelled; the fit is deterministic.
"""

from __future__ import annotations

import functools
import math
import random
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlume.llm import boosting
from sqlume.llm.dom import Node, parse, squeeze

TAGS = ("#root html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre figure figcaption "
        "nav header footer aside form fieldset button address details summary dialog menu").split()
TOKENS = (
    "article content post entry story body text main page container wrapper row col column inner section block prose lead title headline summary "
    "nav menu navbar navigation breadcrumb breadcrumbs pagination pager toc links topbar masthead header head logo brand branding banner hero "
    "footer foot colophon copyright legal bottom sidebar side rail widget widgets aside secondary related recommended recommendations popular trending more latest tags categories archive "
    "cookie cookies consent gdpr notice alert message popup modal overlay paywall disclaimer warning privacy toast "
    "ad ads adv advert advertisement advertising adsbygoogle sponsor sponsored sponsor promo promotion promoted dfp outbrain taboola affiliate "
    "newsletter subscribe subscription signup login register search contact form feedback survey poll "
    "comments comment commentlist commentary disqus respond reply replies discussion thread responses reviews "
    "share sharing social tools toolbar follow facebook twitter author byline meta date skip contentinfo complementary main dialog").split()
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
_TOKEN_LIST = list(dict.fromkeys(TOKENS))
_TOKEN_AT = {t: i for i, t in enumerate(_TOKEN_LIST)}
_NUMBERS = ("depth own links share_links subtree density blocks paragraphs position siblings same_tag of_parent of_page kids "
            "parent_tag in_article in_boiler heading").split()
#: Groups of tokens; ancestors count by group.
_GROUPS = {
    "good": "article content post entry story body text main prose".split(),
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager toc links topbar masthead header head logo brand branding footer foot colophon copyright legal bottom contentinfo".split(),
    "side": "sidebar side rail widget widgets aside secondary related recommended recommendations popular trending more latest tags categories archive complementary".split(),
    "note": "cookie cookies consent gdpr notice alert message popup modal overlay paywall disclaimer warning privacy toast dialog".split(),
    "ad": "ad ads adv advert advertisement advertising adsbygoogle sponsor sponsored promo promotion promoted dfp outbrain taboola affiliate banner".split(),
    "form": "newsletter subscribe subscription signup login register search contact form feedback survey poll".split(),
    "talk": "comments comment commentlist disqus respond reply replies discussion thread responses reviews".split(),
    "share": "share sharing social tools toolbar follow facebook twitter".split(),
}
_GROUP_AT = {w: i for i, ws in enumerate(_GROUPS.values()) for w in ws}
_N = len(_GROUPS)
#: Tokens that are not listed count by a hash.
_HASHED = 32
_WIDTH = len(TAGS) + len(_TOKEN_LIST) + len(_NUMBERS) + 2 * _N + _HASHED


def _log(n: float) -> int:
    return min(63, int(4 * math.log2(1 + n)))


def _part(a: float, b: float) -> int:
    return min(32, int(32 * a / b)) if b else 0


def blocks_of(root: Node) -> tuple[list[Node], np.ndarray, np.ndarray]:
    """Blocks in page order, the place of each one's parent, and their features."""
    order: list[tuple[Node, int]] = [(root, -1)]
    nodes: list[Node] = []
    parents: list[int] = []
    while order:  # preorder without recursion
        node, up = order.pop()
        own = len(nodes)
        nodes.append(node), parents.append(up)
        order += [(p, own) for p in reversed(node.parts) if not isinstance(p, str)]
    n = len(nodes)
    own = [sum(len(p) for p in x.parts if isinstance(p, str) and not p.isspace()) for x in nodes]
    subtree, links, count, paras = own[:], [x.links for x in nodes], [1] * n, [int(x.tag == "p") for x in nodes]
    kids: list[list[int]] = [[] for _ in range(n)]
    for i in range(n - 1, 0, -1):
        u = parents[i]
        subtree[u] += subtree[i]
        links[u] += links[i]
        count[u] += count[i]
        paras[u] += paras[i]
        kids[u].append(i)
    x = np.zeros((n, _WIDTH), np.uint8)
    depth, above = [0] * n, [0] * n
    total = subtree[0]
    place, same, sibs = [0] * n, [0] * n, [0] * n
    for ks in kids:
        ks.reverse()
        tags: dict[str, int] = {}
        for k in ks:
            tags[nodes[k].tag] = tags.get(nodes[k].tag, 0) + 1
        for r, k in enumerate(ks):
            place[k], same[k], sibs[k] = _part(r, max(1, len(ks) - 1)), tags[nodes[k].tag], len(ks)
    base = len(TAGS) + len(_TOKEN_LIST)
    num = base + len(_NUMBERS)
    articles, boilers = [0] * n, [0] * n
    for i, node in enumerate(nodes):
        u = parents[i]
        tag = _TAG_AT.get(node.tag)
        if tag is not None:
            x[i, tag] = 1
        mine = 0
        for t in node.tokens:
            if t in _TOKEN_AT:
                x[i, len(TAGS) + _TOKEN_AT[t]] = 1
            else:
                x[i, _WIDTH - _HASHED + zlib.crc32(t.encode()) % _HASHED] = 1
            if t in _GROUP_AT:
                mine |= 1 << _GROUP_AT[t]
        up = above[u] if u >= 0 else 0
        if u >= 0:
            depth[i] = depth[u] + 1
            articles[i] = articles[u] or nodes[u].tag in ("article", "main")
            boilers[i] = boilers[u] or nodes[u].tag in ("nav", "aside", "footer", "form", "button", "dialog")
        above[i] = up | mine
        x[i, base : num] = (
            min(depth[i], 31), _log(own[i]), _log(links[i]), _part(links[i], subtree[i]), _log(subtree[i]), _log(subtree[i] / count[i]), _log(count[i]),
            _log(paras[i]), place[i], min(sibs[i], 40), min(same[i], 40), _part(subtree[i], subtree[u]) if u >= 0 else 32, _part(subtree[i], total),
            min(len(kids[i]), 40), (_TAG_AT.get(nodes[u].tag, len(TAGS) - 1) if u >= 0 else 0), articles[i], boilers[i], int(node.tag[:1] == "h" and node.tag[1:].isdigit()))
        for g in range(_N):
            x[i, num + g] = mine >> g & 1
            x[i, num + _N + g] = up >> g & 1
    return nodes, np.array(parents), x


def decode(parents: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The best choice in which a dropped block drops all below it: which blocks are kept."""
    n = len(parents)
    all_, best = scores.copy(), scores.copy()  # keeping the whole subtree's scores; the best with this block kept
    for i in range(n - 1, 0, -1):
        all_[parents[i]] += all_[i]
        best[parents[i]] += max(best[i], -all_[i])
    keep = np.zeros(n, bool)
    for i in range(n):
        keep[i] = (i == 0 or keep[parents[i]]) and best[i] >= -all_[i]
    return keep


def text_of(root: Node, nodes: list[Node], keep: np.ndarray) -> str:
    """Texts of the kept blocks in page order, a line each."""
    kept = {id(x) for x, k in zip(nodes, keep) if k}
    lines: list[str] = []
    run: list[str] = []

    def end() -> None:
        line = squeeze("".join(run))
        if line:
            lines.append(line)
        run.clear()

    order: list = [root]
    while order:
        x = order.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        else:
            end()
            if id(x) in kept:
                order.append(None)
                order += reversed(x.parts)
    end()
    return "\n".join(lines)


# generated pages

def _page(rnd: random.Random) -> str:
    """A page whose article blocks, and what leads to them, are marked."""
    parts = "the an re tion on er st ou le ent qu ci ar se von zu ein sch ich ver de la los ción et oi eau é un a in".split()

    pool = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 4))) for _ in range(200)]
    pool += [w + rnd.choice(["", "", "", "", ".", ",", "&amp;", "***"]) for w in pool[:60]]

    def words(lo: int, hi: int) -> str:
        return " ".join(rnd.choices(pool, k=rnd.randint(lo, hi)))

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{rnd.randint(1, 999)}">{words(1, 3)}</a></li>' for _ in range(n))

    def attr(*names: str) -> str:
        k = rnd.random()
        name = rnd.choice(names)
        name = rnd.choice([name, f"site-{name}", f"{name}-{rnd.choice(['box', 'wrap', 'area', '1', 'x'])}", f"{rnd.choice(['js', 'c', 'm'])}-{name}"])
        return f' class="{name}"' if k < 0.6 else f' id="{name}"' if k < 0.85 else f' class="{name} {rnd.choice(["clearfix", "dark", "wide"])}" id="b{rnd.randint(1, 9)}"'

    def prose(n: int) -> str:
        return "".join(rnd.choice(["<p>{}</p>", "<p>{}", "<div>{}</div>", "<span>{}</span> "]).format(words(3, 40)) for _ in range(n))

    def menu() -> str:
        body = f"<ul>{links(rnd.randint(2, 10))}</ul>"
        return f"<nav{attr('nav', 'menu') if rnd.random() < 0.4 else ''}>{body}</nav>" if rnd.random() < 0.6 else f"<div{attr('menu', 'navbar', 'navigation', 'breadcrumb', 'breadcrumbs', 'pagination', 'toc', 'links', 'topbar')}>{body}</div>"

    def header() -> str:
        body = rnd.choice(["<h1>{}</h1>", "<h2>{}</h2>", "<div>{}</div>", "<p>{}</p>", "{}"]).format(words(1, 8)) + (menu() if rnd.random() < 0.4 else "")
        return f"<header{attr('header', 'masthead') if rnd.random() < 0.4 else ''}>{body}</header>" if rnd.random() < 0.6 else f"<div{attr('header', 'masthead', 'branding', 'logo', 'topbar', 'hero')}>{body}</div>"

    def footer() -> str:
        body = rnd.choice(["&copy; {}", "<p>&copy; 2024 {}</p>", "<div>{}</div>", "{} &middot; {}"]).replace("{}", words(2, 14)) + (f"<ul>{links(4)}</ul>" if rnd.random() < 0.4 else "")
        return f"<footer{attr('footer', 'colophon') if rnd.random() < 0.3 else ''}>{body}</footer>" if rnd.random() < 0.65 else f"<div{attr('footer', 'colophon', 'copyright', 'legal', 'bottom')}>{body}</div>"

    def side() -> str:
        body = rnd.choice([f"<h3>{words(1, 4)}</h3><ul>{links(rnd.randint(2, 8))}</ul>", prose(rnd.randint(1, 3)), f"<h4>{words(1, 3)}</h4>{prose(1)}"])
        return f"<aside{attr('sidebar', 'widget') if rnd.random() < 0.4 else ''}>{body}</aside>" if rnd.random() < 0.5 else f"<{(t := rnd.choice(['div', 'section']))}{attr('sidebar', 'rail', 'widget', 'related', 'recommended', 'popular', 'trending', 'secondary', 'archive')}>{body}</{t}>"

    def notice() -> str:
        return f"<div{attr('cookie', 'cookies', 'consent', 'gdpr', 'notice', 'alert', 'popup', 'modal', 'overlay', 'paywall', 'disclaimer', 'warning', 'message')}>{prose(1) if rnd.random() < 0.6 else words(4, 30)}{'<button>OK</button>' if rnd.random() < 0.5 else ''}</div>"

    def advert() -> str:
        return f"<{(t := rnd.choice(['div', 'div', 'section', 'p']))}{attr('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'sponsor', 'promo', 'adsbygoogle', 'banner', 'affiliate', 'promotion')}>{words(2, 40)}</{t}>"

    def form() -> str:
        body = f"<label>{words(1, 4)}</label><input name=q><button>{words(1, 2)}</button>{prose(1) if rnd.random() < 0.4 else ''}"
        return f"<form action='/x'{attr('search', 'newsletter', 'login') if rnd.random() < 0.5 else ''}>{body}</form>" if rnd.random() < 0.6 else f"<div{attr('newsletter', 'subscribe', 'signup', 'login', 'search', 'contact', 'survey', 'feedback')}>{body}</div>"

    def talk() -> str:
        one = lambda: rnd.choice([f"<li{attr('comment', 'reply')}><p>{words(4, 50)}</p></li>", f"<div{attr('comment', 'reply')}><b>{words(1, 2)}</b><p>{words(4, 50)}</p></div>", f"<article class='comment'><p>{words(5, 40)}</p></article>", f"<p>{words(5, 40)}</p>"])
        body = f"<h3>{words(1, 3)}</h3>" * (rnd.random() < 0.5) + "".join(one() for _ in range(rnd.randint(1, 6)))
        return f"<{(t := rnd.choice(['section', 'div', 'ol', 'ul', 'aside']))}{attr('comments', 'comment-list', 'disqus', 'discussion', 'replies', 'responses', 'user-comments', 'reviews')}>{body}</{t}>"

    def share() -> str:
        return f"<div{attr('share', 'social', 'sharing', 'toolbar', 'follow')}><a href=#>{words(1, 1)}</a> <a href=#>{words(1, 1)}</a></div>"

    k = ' data-mark="1"'

    def content(n: int, inside: list) -> str:
        out = [f"<{h}{k}>{words(2, 12)}</{h}>" for h in ["h1"] if rnd.random() < 0.75]
        if out and rnd.random() < 0.25:
            out = [f"<header{k}>{out[0]}</header>"]
        for _ in range(n):
            r = rnd.random()
            if r < 0.62:
                out.append(f"<p{k}>{words(1, 120)}</p>")
            elif r < 0.70:
                out.append(f"<p{k}><b>{words(1, 60)}<br>")
            elif r < 0.76:
                out.append(f"<{(h := rnd.choice(['h2', 'h3']))}{k}>{words(1, 8)}</{h}>")
            elif r < 0.82:
                out.append(f"<{(t := rnd.choice(['ul', 'ol']))}{k}>" + "".join(f"<li{k}>{words(1, 25) if rnd.random() < 0.8 else '<a href=/>' + words(1, 5) + '</a> ' + words(1, 9)}</li>" for _ in range(rnd.randint(1, 6))) + f"</{t}>")
            elif r < 0.86:
                out.append(f"<blockquote{k}><p{k}>{words(4, 60)}</p></blockquote>")
            elif r < 0.89:
                out.append(f"<pre{k}>{words(3, 30)}</pre>")
            elif r < 0.92:
                out.append(f"<table{k}><tbody{k}>" + "".join(f"<tr{k}>" + "".join(f"<td{k}>{words(1, 5)}</td>" for _ in range(2)) + "</tr>" for _ in range(rnd.randint(1, 4))) + "</tbody></table>")
            elif r < 0.94:
                out.append(f"<figure{k}><img src=a.png><figcaption{k}>{words(2, 14)}</figcaption></figure>")
            elif r < 0.97:
                out.append(f"<div{k}>{words(5, 80)}</div>")
            else:
                out.append(f"<section{k}><h2{k}>{words(1, 6)}</h2><p{k}>{words(10, 80)}</p></section>")
            if inside and rnd.random() < 0.12:
                out.append(rnd.choice(inside)())
        return "".join(out)

    inside = [advert, share, form, notice, side] if rnd.random() < 0.5 else []
    n = rnd.choice([1, 2, 3, 5, 8, 12, 20])
    body = content(n, inside)
    if inside and rnd.random() < 0.3:
        body += footer() if rnd.random() < 0.5 else talk()
    good = lambda: attr("content", "post", "entry", "entry-content", "article-body", "story", "text", "main-content", "post-body", "prose", "article")
    r = rnd.random()
    if r < 0.45:
        body = f"<article{good() if rnd.random() < 0.3 else ''}{k}>{body}</article>"
    elif r < 0.6:
        body = f"<main{good() if rnd.random() < 0.3 else ''}{k}>{body}</main>"
    elif r < 0.9:
        body = f"<{(t := rnd.choice(['div', 'div', 'section']))}{good()}{k}>{body}</{t}>"
    elif r < 0.95:
        body = f"<div{k}>{body}</div>"
    if r < 0.6 and rnd.random() < 0.3:
        body = f"<main{k}>{body}</main>" if r < 0.45 else f"<div{good()}{k}>{body}</div>"
    pre = [f() for f in rnd.sample([menu, header, notice, advert, form, menu, header], rnd.randint(0, 5))]
    post = [f() for f in rnd.sample([talk, side, share, footer, footer, advert, notice, form, menu], rnd.randint(0, 6))]
    around = [side()] if rnd.random() < 0.25 else []
    mid = "".join([*around, body] if rnd.random() < 0.4 else [body, *around])
    if rnd.random() < 0.35:
        mid = f"<div{attr('container', 'wrapper', 'row', 'inner', 'page')}{k}>{mid}</div>"
    page = "".join(pre) + mid + "".join(post)
    if rnd.random() < 0.25:
        page = f"<div{attr('page', 'wrapper', 'container')}{k}>{page}</div>"
    end = "</body></html>" if rnd.random() < 0.8 else ""
    return f"<!DOCTYPE html><html lang='en'{k}><head><title>{words(2, 9)}</title></head><body{k}>{page}{end}"


@functools.cache
def trained(pages: int = 500, seed: int = 17) -> boosting.Boosted:
    rnd = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        nodes, _, x = blocks_of(parse(_page(rnd)))
        xs.append(x)
        ys.append([node.mark == "1" or node.tag == "#root" for node in nodes])
    return boosting.fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def main_text(html: str | None, model: boosting.Boosted) -> str:
    return main_texts([html], model)[0]


def main_texts(pages: list[str | None], model: boosting.Boosted) -> list[str]:
    """Texts of several pages, scored together."""
    read = []
    for html in pages:
        root = parse(html)
        read.append((root, *blocks_of(root)))
    if not read:
        return []
    scores = np.clip(model.logits(np.concatenate([r[3] for r in read])), -8, 8)
    out, at = [], 0
    for root, nodes, parents, x in read:
        own = scores[at : at + len(nodes)] * np.sqrt(1 + np.array([sum(len(p) for p in n.parts if isinstance(p, str)) for n in nodes]))
        at += len(nodes)
        out.append(text_of(root, nodes, decode(parents, own)))
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", batch: int = 64) -> DataFrame:
    """One row (page_id, url, text, n_chars, n_lines) per page; n_chars counts code points.

    White space inside a block becomes one space; kept blocks follow in page order, a line each. Null and empty
    pages, and those without any text, have an empty text. Repeated rows and null ids or URLs keep their rows; an empty
    table gives none; other columns are ignored. Pages without markup are their text.
    """
    names = ["page_id", "url", "text", "n_chars", "n_lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                texts = main_texts(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())], names)

    shared = pages.sparkSession.sparkContext.broadcast(trained())
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return src.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_lines long")
