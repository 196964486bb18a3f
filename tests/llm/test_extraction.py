"""Wrappers of synthetic hosts: no article tag, no telling class names, against the planted texts."""

import random
import time

import pytest

from roadspark.llm import extraction as X
from roadspark.llm._spark import Scratch

SCHEMA = "page_id long, url string, html string, text string"
WORDS = [f"{a}{b}" for a in "ka lo mi su te ra no vi".split() for b in "den lar mon tis rok".split()]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def shop(rng, i):
    """Plain boxes: a menu, a varying teaser, the text with an own class, a varying list of records, a constant foot."""
    body = [sentence(rng, rng.randint(15, 60)) for _ in range(rng.randint(2, 6))]
    menu = "".join(f"<li><a href='/{k}'>{rng.choice(WORDS)}</a></li>" for k in range(6))
    said = "".join(f"<div class='q9'><b>{rng.choice(WORDS)}</b><p>{sentence(rng, 6)}</p></div>" for _ in range(rng.randint(2, 4))) if i % 3 else ""
    page = f"<html><head><title>{i}</title></head><body><div class='z1'><ul>{menu}</ul></div><div class='z2'>{sentence(rng, 5)}</div><div class='z3'><p>We deliver to all places.</p>{''.join(f'<p>{b}</p>' for b in body)}<div class='z4'>{said}</div></div><div class='z5'>All prices in francs.</div></body></html>"
    return page, "\n".join(body)


def forum(rng, i):
    """Tables and unclosed tags; an optional picture; sections that repeat."""
    parts = [(sentence(rng, 4), sentence(rng, rng.randint(20, 50))) for _ in range(rng.randint(1, 4))]
    image = "<img src=x><br>" if i % 2 else ""
    rows = "".join(f"<h2>{a}<p>{b}" for a, b in parts)
    page = f"<body><table><tr><td><a href=/a>{rng.choice(WORDS)}</a> <a href=/b>{rng.choice(WORDS)}</a><td class=k>{image}<p>Members only see the rest{rows}</table><div>Last seen {sentence(rng, 3)}</div>"
    return page, "\n".join(t for pair in parts for t in pair)


def mixed(rng, i):
    """Two kinds of pages on one host: long reads and short cards."""
    text = sentence(rng, 80 if i % 4 else 12)
    box = f"<section class='long'><h1>{sentence(rng, 3)}</h1><p>{text}</p></section>" if i % 4 else f"<div class='card'><p>{text}</p></div>"
    side = f"<div class='right'>{sentence(rng, 4)}</div>"
    page = f"<html><body><div class='top'>Daily paper since ever</div>{box}{side}</body></html>"
    title = page.split("<h1>")[1].split("</h1>")[0] + "\n" if i % 4 else ""
    return page, title + text


def rows(n=24):
    rng, out = random.Random(4), []
    for k, (name, make) in enumerate([("shop", shop), ("forum", forum), ("mixed", mixed)]):
        for i in range(n):
            page, text = make(rng, i)
            out.append((1000 * k + i, f"http://{name}.test/{i}", page, text))
    return out


def test_planted_hosts(spark):
    want = rows()
    frame = spark.createDataFrame(want, SCHEMA)
    got = {r.page_id: r.text for r in X.extract(frame).collect()}
    assert {i: got[i] for i, _, _, t in want if got[i] != t} == {}
    # the wrapper decides: without it, most pages read differently
    alone = sum(X.main_text(page) != text for _, _, page, text in want)
    assert alone > len(want) / 2


def test_class_names_do_not_decide(spark, monkeypatch):
    want = rows()
    monkeypatch.setattr(X, "NOISY", X.re.compile("(?!)"))
    found = X.wrappers(spark.createDataFrame(want, SCHEMA), Scratch(spark, "t")).collect()
    held = {r.host: X.Wrapper({s.place: s.share for s in r.shares}, frozenset(r.out), frozenset((c.place, c.text) for c in r.constants or [])) for r in found}
    assert all(X.main_text(page, held[url.split("/")[2]]) == text for _, url, page, text in want)


def test_expression_any_order():
    pages = ["<body><h1>a</h1><p>x<p>y<i>z</i></body>", "<body><h1>b</h1><p>x<ul><li>1<li>2</ul><p>q</body>", "<body><p>only</body>"]

    def shown(order):
        nodes, after, texts = {}, set(), set()
        for k in order:
            read = X.Page(pages[k])
            for p, x in read.places.items():
                node = nodes.setdefault(p, {"place": p, "above": x[0], "label": x[1], "instances": 0, "parents": 0, "twice": False})
                node["instances"] += x[4]
                node["parents"] += x[5]
                node["twice"] |= x[6]
            after |= read.after
            texts |= {p for p, _, _ in read.blocks}
        return X.expression(list(nodes.values()), [dict(zip(("above", "a", "b"), x)) for x in after], texts)

    assert shown([0, 1, 2]) == shown([2, 1, 0]) == "body(h1(#)? (p(#)+ ul(li(#)+)?)+)"


def test_expressions(spark):
    found = {r.host: r.expression for r in X.expressions(spark.createDataFrame(rows(), SCHEMA), Scratch(spark, "t")).collect()}
    assert set(found) == {"shop.test", "forum.test", "mixed.test"} and "div.q9(# p(#))*" in found["shop.test"]


def test_copies_and_joined_wrappers(spark, monkeypatch):
    """Hosts of copies keep their text; wrappers beyond the broadcast are joined, with the same rows."""
    page = "<html><body><div class='x'><p>Read our terms first</p><p>story {0} begins</p><p>and {0} ends</p></div></body></html>"
    rows = [(i, f"http://h/{i}", page.format(i)) for i in range(20)] + [(30 + i, f"http://same/{i}", page.format(0)) for i in range(5)] + [(50, None, "plain &amp; text"), (51, "http://h/n", None), (51, "http://h/n", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as text", "3 as n")
    got = sorted((r.page_id, r.text, r.n_chars) for r in X.extract(frame).collect())
    assert got[7][1] == "story 7 begins\nand 7 ends" and len(got) == 28
    assert got[20][1] == "Read our terms first\nstory 0 begins\nand 0 ends"
    assert got[-3:] == [(50, "plain & text", 12), (51, "", 0), (51, "", 0)]
    monkeypatch.setattr(X, "BROADCAST", 0)
    monkeypatch.setattr(X, "PER_COPY", 4)
    assert sorted((r.page_id, r.text, r.n_chars) for r in X.extract(frame).collect()) == got


def test_empty_pages(spark):
    assert X.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("unit", ['<a "', "<div>", "<div class='a", "<!", "<!--", "</p>", "<p>x", "<li><ul>", "a<", "<script>", "<td>x</div>", "<p><b>"])
def test_long_broken_pages(unit):
    page = unit * (3_000_000 // len(unit))
    began = time.time()
    X.main_text(page)
    assert time.time() - began < 40


def test_comments_and_entities():
    page = '<html><body><nav><a>Menu</a></nav><div class="ad">Buy</div><article><h1>T &amp; U</h1><p>a <b>b</b>\n c<p>d<!-- x --><article>said</article></article><footer>f</footer></body></html>'
    assert X.main_text(page) == "T & U\na b c\nd" and X.main_text(None) == ""
    assert X.main_text("<body><div class='x'><p>one</p></div><div class='xy'>two</div></body>", X.Wrapper({X._place(X._place(0, "body"), "div.x"): 1.0})) == "one"
