"""Main text of generated pages whose sections have classes of their own, of pages with text outside the largest section, and of very deep pages."""

import random
import time
import tracemalloc

import pytest

from sievelake.llm import pages
from test_llm import frame

SCHEMA = "page_id long, url string, html string"
NOISE = ['<nav class="top"><a href="/">Home</a></nav>', '<div class="sidebar"><p>Elsewhere</p></div>', '<div class="comments"><p>Nice one</p></div>', '<form><p>Your name</p></form>', "<aside><p>aside</p></aside>", '<div class="cookie-notice">We use cookies</div>', "<script>var a = '<p>no</p>'</script>", '<ul class="share"><li>Share</li></ul>', '<div role="navigation">Skip</div>']


def text(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def section(rng, depth):
    """(html, texts) of a section of random boxes, with boilerplate between."""
    html, said = [], []
    for _ in range(rng.randrange(1, 4)):
        if rng.random() < 0.3:
            html.append(rng.choice(NOISE))
        if depth and rng.random() < 0.5:
            tag, name = rng.choice(["section", "div", "blockquote", "figure"]), rng.choice(["intro", "outro", "lead", "body-text", "quote", "s1", ""])
            a, b = section(rng, depth - 1)
            html.append(f'<{tag} class="{name}">{a}</{tag}>')
            said += b
        else:
            t = text(rng, rng.choice([3, 20, 120]))
            html.append(f"<p>{t}</p>")
            said.append(t)
    return "".join(html), said


def page_of(rng, wrap):
    inner, said = section(rng, 3)
    noise = lambda: "".join(rng.sample(NOISE, rng.randrange(3)))
    return f"<html><body>{noise()}{wrap[0]}{inner}{wrap[1]}{noise()}<footer>(c)</footer></body></html>", " ".join(said)


@pytest.mark.parametrize("wrap", [("<article>", "</article>"), ('<div class="wrap"><article class="post">', "</article></div>"), ("<main><article>", "</article></main>"), ("<article><div><div>", "</div></div></article>")])
def test_every_section_of_an_article_stays(spark, wrap):
    rng = random.Random(wrap[0])
    made = [page_of(rng, wrap) for _ in range(120)]
    rows = [(k, f"http://h{k % 5}.example/{k}", h) for k, (h, _) in enumerate(made)]
    got = {r.page_id: r.text for r in pages.extract(frame(spark, rows, SCHEMA)).collect()}
    assert got == {k: t for k, (_, t) in enumerate(made)}


def test_text_beside_the_largest_box_stays(spark):
    rng = random.Random(2)
    intro, body, outro, lead = (text(rng, n) for n in (60, 200, 60, 40))
    whole = f"{intro} {body} {outro}"
    article = f'<html><body><nav>Menu</nav><article><section class="intro"><p>{intro}</p></section><section class="body"><p>{body}</p></section><section class="outro"><p>{outro}</p></section></article></body></html>'
    beside = f'<html><body><nav>Menu</nav><div class="wrap"><div class="lead">{lead}</div><div class="article-body"><p>{body}</p></div></div><div class="footer">x</div></body></html>'
    # The host's other pages have no lead: theirs is another container.
    plain = f'<html><body><nav>Menu</nav><div class="wrap"><div class="article-body"><p>{body}</p></div></div></body></html>'
    loose = f"{lead}<div><p>{body}</p></div>{outro}"
    rows = [(1, "http://a.example/", article), (2, "http://b.example/", beside), *[(3 + k, f"http://b.example/{k}", plain) for k in range(9)], (20, "http://c.example/", loose)]
    got = {r.page_id: r.text for r in pages.extract(frame(spark, rows, SCHEMA)).collect()}
    assert got[1] == whole and got[2] == f"{lead} {body}" and got[20] == f"{lead} {body} {outro}"
    assert {got[3 + k] for k in range(9)} == {body}


def test_links_beside_the_box_do_not_widen_it():
    rng = random.Random(3)
    body = text(rng, 200)
    links = "".join(f'<li><a href="/{k}">{text(rng, 4)}</a></li>' for k in range(30))
    assert pages.text_at(f'<html><body><div><ul>{links}</ul></div><div class="story"><p>{body}</p></div></body></html>', []) == body


@pytest.mark.parametrize("levels", [16_000, 100_000])
def test_deep_pages_in_bounded_memory(levels):
    """Boxes nested without end: memory and time follow the length of the page."""
    page = "<html><body>" + '<div class="row col">' * levels + "<p>" + "word " * 50 + "</p>" + "</div></p></section>" * levels
    tracemalloc.start()
    began = time.time()
    assert pages.text_at(page, [p for p, _ in pages.votes(page)]) == " ".join(["word"] * 50)
    assert tracemalloc.get_traced_memory()[1] < 1000 * levels + 20e6 and time.time() - began < 60
    tracemalloc.stop()
