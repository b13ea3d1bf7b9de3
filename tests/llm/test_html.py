"""Which blocks of a page are its text: attributes, marks inside articles, and repeats on pages without an article."""

import html
import random

import pytest

from daybook.llm import html_extract


def texts(spark, pages):
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_extract.extract(spark, rows).collect()}


def kept(body):
    return " ".join(t for p, t in html_extract.blocks(f"<body><article><h1>T</h1>{body}</article></body>") if p in ("article", "doubt"))


@pytest.mark.parametrize(
    "tag",
    ['p title="the hidden harbour"', 'p class="is hidden lg:block"', 'p data-note="is hidden now"', 'div class="social-group"', 'div class="related-content"', 'p data-x="display:none"', 'p aria-hidden="false"', 'p style="display:block"', "p alt='aria-hidden=true'", 'div id="search-text"', 'p class="banner-title"', 'a title="x > y hidden"', 'p data-hidden="1"'],
)
def test_words_in_attributes_do_not_drop_a_block_of_an_article(tag):
    assert kept(f"<{tag}>Kept words.</{tag.split()[0]}><p>Last.</p>").split() == ["T", "Kept", "words.", "Last."]


@pytest.mark.parametrize(
    "tag",
    ["p hidden", 'p HIDDEN=""', "p aria-hidden='true'", 'p style="color:red; display : none"', 'div class="comments"', 'div class="comment-list"', 'div id="ad-slot-3"', 'div class="related"', 'div role="banner"', 'div class="cookieBar"', "nav", "aside", "footer", 'div class="newsletter-box"', 'div id=pagination'],
)
def test_hidden_and_marked_blocks_of_an_article_go(tag):
    assert kept(f"<{tag}>Dropped words.</{tag.split()[0]}><p>Last.</p>") == "T Last."


def test_whole_paragraphs_of_the_verdict(spark):
    page = '<article><h1>T</h1><p title="the hidden harbour">One.</p><p class="is hidden lg:block">Two.</p><p data-note="is hidden now">Three.</p><div class="social-group"><p>A social group is people.</p></div><p>Last.</p></article>'
    assert texts(spark, [(1, "http://a.b/c", page)]) == {1: "T One. Two. Three. A social group is people. Last."}


def test_repeats_decide_on_pages_without_an_article(spark):
    """Against a plain reading: a token goes if it lies in a run of MIN_TOKENS that another page of the host has."""
    draw = random.Random(7)
    words = [f"w{i}" for i in range(900)]
    lines = {h: [" ".join(draw.choices(words, k=draw.randrange(4, 20))) for _ in range(6)] for h in ("a.org", "b.org")}
    pages, streams = [], {}
    for i in range(40):
        host = draw.choice(list(lines))
        blocks = [draw.choice(lines[host]) if draw.random() < 0.5 else " ".join(draw.choices(words, k=draw.randrange(1, 30))) for _ in range(draw.randrange(1, 7))]
        pages.append((i, f"https://{host}/{i}", "<html><body>" + "".join(f"<div>{html.escape(b)}</div>" for b in blocks) + "</body></html>"))
        streams[i] = (host, [b.split() for b in blocks])
    n, runs = html_extract.MIN_TOKENS, {}
    for i, (host, blocks) in streams.items():
        tokens = [w for b in blocks for w in b]
        for k in range(len(tokens) - n + 1):
            runs.setdefault((host, tuple(tokens[k : k + n])), set()).add(pages[i][2])
    want, dropped = {}, 0
    for i, (host, blocks) in streams.items():
        tokens = [w for b in blocks for w in b]
        gone = {j for k in range(len(tokens) - n + 1) if len(runs[host, tuple(tokens[k : k + n])]) > 1 for j in range(k, k + n)}
        dropped += len(gone)
        at, left = 0, []
        for b in blocks:
            left.append(" ".join(w for j, w in enumerate(b, at) if j not in gone))
            at += len(b)
        want[i] = " ".join(x for x in left if x)
    assert dropped > 200 and texts(spark, pages) == want


def test_articles_go_through_the_suffix_array(spark):
    """Against a plain reading: outside an article, what any part of another page of the host has goes; without an article, what
    another has outside its article. Articles, quoted by others or not, stay whole."""
    draw = random.Random(5)
    words = [f"w{i}" for i in range(900)]
    lines = {h: [" ".join(draw.choices(words, k=draw.randrange(6, 20))) for _ in range(90)] for h in ("a.org", "b.org")}
    pages, read = [], {}
    for i in range(150):
        host = draw.choice(list(lines))
        blocks = [(draw.choice(["own", "own", "doubt", "nav"]) if i % 3 else "own", draw.choice(lines[host]) if draw.random() < 0.6 else " ".join(draw.choices(words, k=draw.randrange(1, 30)))) for _ in range(draw.randrange(1, 7))]
        bare = i % 3 == 0 or not any(k == "own" for k, _ in blocks)
        blocks = [("loose", b) for _, b in blocks] if bare else blocks
        tag = {"own": "<p>{}</p>", "doubt": '<div class="related-stories">{}</div>', "nav": "<nav>{}</nav>", "loose": "<div>{}</div>"}
        body = "".join(tag[k].format(b) for k, b in blocks)
        pages.append((i, f"https://{host}/{i}", f"<html><body>{body if bare else f'<article>{body}</article>'}</body></html>"))
        read[i] = (host, bare, [(k, b.split()) for k, b in blocks if k != "nav"])
    n, others, articles = html_extract.MIN_TOKENS, {}, {}
    for i, (host, _, blocks) in read.items():
        for side, held in ((others, [w for k, b in blocks if k != "own" for w in b]), (articles, [w for k, b in blocks if k == "own" for w in b])):
            for j in range(len(held) - n + 1):
                side.setdefault((host, tuple(held[j : j + n])), set()).add(i)
    want, quoted = {}, 0
    for i, (host, bare, blocks) in read.items():
        tokens = [w for k, b in blocks if k != "own" for w in b]
        gone = set()
        for j in range(len(tokens) - n + 1):
            run = (host, tuple(tokens[j : j + n]))
            elsewhere = others[run] - {i}
            quoted += not elsewhere and bool(articles.get(run, set()) - {i}) and not bare
            if elsewhere or not bare and articles.get(run, set()) - {i}:
                gone |= set(range(j, j + n))
        at, left = 0, []
        for k, b in blocks:
            left.append(" ".join(b if k == "own" else [w for j, w in enumerate(b, at) if j not in gone]))
            at += 0 if k == "own" else len(b)
        want[i] = " ".join(x for x in left if x)
    assert quoted > 20 and texts(spark, pages) == want
