"""Random pages whose article is known, and the incremental counts of the tree against walks over all ancestors."""

import html
import random

import pytest

from quadrille.llm import html_text

WORDS = "river stone market evening letters harbour window carried quiet garden under several people, without; towards & <beyond> morning".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def inline(rng, text):
    """The text as markup: escaped, some words in inline elements, odd white space."""
    out = []
    for word in text.split(" "):
        word = html.escape(word) if rng.random() < 0.9 else html.escape(word).replace("&amp;", "&#38;")
        kind = rng.random()
        out.append(f"<b>{word}</b>" if kind < 0.05 else f"<a href='/x'>{word}</a>" if kind < 0.07 else f"<em class=k>{word}</em>" if kind < 0.1 else word)
    return rng.choice([" ", "\n  "]).join(out)


def other(rng):
    links = "".join(f"<li><a href='/{k}'>{rng.choice(WORDS[:10])} {k}</a></li>" for k in range(rng.randint(3, 9)))
    text = html.escape(prose(rng, rng.randint(5, 30)))
    return rng.choice([
        f"<nav><ul>{links}</ul></nav>", f"<div class='sidebar'>{text}<ul>{links}</ul></div>", f"<aside><p>{text}</p></aside>",
        f"<div class='ad-banner'><p>{text}</p></div>", f"<footer><p>{text}</p></footer>", f"<form><label>{text}</label><input></form>",
        f"<div id='cookie-notice'>{text}</div>", f"<script>var x = '<p>{prose(rng, 9)}</p>';</script>", f"<style>p {{ a: b }}</style><!-- {text} -->",
        f"<div class='related'><ul>{links}</ul></div>",
    ])


def page(rng):
    paragraphs = [prose(rng, rng.randint(25, 80)) for _ in range(rng.randint(3, 8))]
    title = prose(rng, 4)
    parts = [f"<h1>{inline(rng, title)}</h1>"]
    for p in paragraphs:
        parts.append(f"<p>{inline(rng, p)}" + rng.choice(["</p>", "</p>\n", ""]))
        if rng.random() < 0.25:
            parts.append(f"<div class='{rng.choice(['advert', 'share-buttons', 'newsletter'])}'>{html.escape(prose(rng, 12))}</div>")
    if rng.random() < 0.5:
        parts.append(f"<section class='comments'><p>{html.escape(prose(rng, 60))}</p><p>{html.escape(prose(rng, 60))}</p></section>")
    opening, closing = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div class='post-content'>", "</div>"), ("<div id=content>", "</div>")])
    depth = rng.randint(0, 4)
    body = "<div>" * depth + opening + "".join(parts) + closing + "</div>" * depth
    before, after = ("".join(other(rng) for _ in range(rng.randint(0, 3))) for _ in range(2))
    markup = f"<!doctype html><html><head><title>{title}</title></head><body>{before}{body}{after}</body></html>"
    return markup, " ".join([title, *paragraphs])


@pytest.mark.parametrize("seed", range(4))
def test_random_articles(seed):
    rng = random.Random(seed)
    for _ in range(100):
        markup, want = page(rng)
        assert html_text.main_text(markup) == want, markup


def test_counts_of_the_tree_equal_walks(rng=random.Random(3)):
    for _ in range(100):
        nodes, found = html_text.blocks(page(rng)[0])
        size, links = dict.fromkeys(nodes, 0), {}
        for node, text in found:
            up = node
            while up is not None:
                size[up] += len(text)
                up = up.parent
        for node in nodes:
            above = []
            up = node
            while up is not None:
                above.append(up)
                up = up.parent
            links[node] = sum(n.tag == "a" for n in above)
            assert node.inside == any(n.tag in ("article", "main") for n in above)
            assert (node.size, node.anchors) == (size[node], links[node])
            assert node.block == next(n for n in above if n.tag not in html_text._INLINE)
