import pytest

from cleanloom.llm import html as H

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t=\"</p>\";</script></head><body>"
    "<header>Site <b>name</b></header><nav><ul><li><a href='/x>y'>Menu</a></li></ul></nav><!-- a > b --><div class=\"ad\">Buy</div>"
    "<div id='cookie-notice'>We use cookies</div><main><aside class=sidebar>Related</aside><article><h1>A &amp; B</h1>"
    "<p><b>One<br>two &lt;three&gt;&nbsp; x<p>Four</p><form><input><button>Send</button></form><script>x()</script>"
    "<ul><li>five<li>six</ul><section class='comments'><article><p>First!</p></article></section></article></main><footer>&copy; me</footer></body></html>"
)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")


def parsed(spark, rows):
    return pages(spark, rows).select("page_id", "page_id", "url", "html").mapInArrow(H._parse, H.PARSED)


def test_article_only(spark):
    r = H.extract(spark, pages(spark, [(1, "http://a/1", PAGE)])).head()
    assert r["text"] == "A & B\n\nOne two <three> x\n\nFour\n\nfive\n\nsix"
    assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("plain  text\n here", "plain text here"), ("<p>a<b>b</b>c", "abc"), ("a < b &amp; c", "a < b & c"), ("<div>x</i></p>y</div>z", "x\n\ny\n\nz"),
    ("<p>open <script>never closed", "open"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"), ("<p>" + "é " * 50000, ("é " * 50000).strip()), ("<nav>only</nav>", ""),
])
def test_markup(spark, html, text):
    assert H.extract(spark, pages(spark, [(1, None, html)])).head()["text"] == text


def test_style_tree_drops_what_every_page_shows(spark):
    rows = [(k, f"http://site/{k}", f"<div class=top>Welcome to us</div><div class=body><p>Story number {k} is new</p></div><div class=end>All rights kept</div>") for k in range(20)]
    rows += [(100, "http://other/1", rows[0][2])]
    got = {r["page_id"]: r["text"] for r in H.extract(spark, pages(spark, rows)).collect()}
    assert all(got[k] == f"Story number {k} is new" for k in range(20))
    assert got[100].startswith("Welcome")  # one page shows nothing about its host


def test_marked_parts_are_judged_too(spark):
    rows = [
        (k, f"http://site/{k}", f"<main><p>Story {k} is new</p><div class=box>{'Own box' if k == 7 else 'Join our club'}</div><article><p>Teaser {k}</p></article></main><div>Out {k}</div>")
        for k in range(20)
    ]
    got = {r["page_id"]: r["text"] for r in H.extract(spark, pages(spark, rows)).collect()}
    # two texts in the box's node: one on 19 of 20 pages, one on a single page
    lone = [(k, u, h.replace("Own box", "Join our club")) for k, u, h in rows]
    same = {r["page_id"]: r["text"] for r in H.extract(spark, pages(spark, lone)).collect()}
    assert all(same[k] == f"Story {k} is new\n\nTeaser {k}" for k in range(20))
    assert "Own box" in got[7] and all(got[k].startswith(f"Story {k} is new") and got[k].endswith(f"Teaser {k}") for k in range(20))


def test_copies_of_a_page_count_once(spark):
    rows = [(k, "http://site/1", "<div>The same page</div>") for k in range(30)]
    assert {r["text"] for r in H.extract(spark, pages(spark, rows)).collect()} == {"The same page"}


def test_importance(spark):
    rows = [(k, f"http://h/{k}", f"<div class=a>same</div><div class=b>own {k}</div>") for k in range(16)]
    values = sorted(r["importance"] for r in H.node_importance(parsed(spark, rows)).collect())
    # 0 and 0.9 on 16 pages, 1 on PRIOR_PAGES more
    assert abs(values[0] - 3 / 19) < 1e-9 and abs(values[1] - (16 * 0.9 + 3) / 19) < 1e-9


def test_empty_and_repeats(spark):
    assert H.extract(spark, pages(spark, [])).count() == 0
    assert H.extract(spark, pages(spark, [(1, "u", PAGE), (1, "u", PAGE), (None, None, PAGE)])).count() == 3


def plain_importance(rows):
    """Importance of every style node of one host, page by page: entropies from counts in dictionaries."""
    import math
    from collections import Counter, defaultdict

    texts, shapes, holders, zones = defaultdict(Counter), defaultdict(Counter), Counter(), {}
    for html in sorted(set(rows)):
        found, children = H.blocks(html)
        zones |= {p: z for p, z, _ in found}
        for path, text in {(p, t) for p, _, t in found}:
            texts[path][text] += 1
        for path in {p for p, *_ in found}:
            holders[path] += 1
        for path, styles in children.items():
            shapes[path][tuple(styles)] += 1
    out = {}
    for path, m in holders.items():
        # a text on k of m pages leaves an uncertainty of log k about its page
        content = 1 - sum(math.log(k) / math.log(m) for k in texts[path].values()) / len(texts[path]) if m > 1 else 1.0
        shown = sum(shapes[path].values())
        shape = sum(-k / shown * math.log(k / shown) for k in shapes[path].values()) / math.log(shown) if shown > 1 else 0.0
        share = H.GAMMA ** max(1, len(shapes[path]))
        own = share * content + (1 - share) * shape
        out[path] = H.PRIOR[zones[path]] * (m * own + H.PRIOR_PAGES) / (m + H.PRIOR_PAGES)
    return out


def plain_texts(rows):
    """Main text of every page of one host, by the plain tree."""
    from collections import Counter

    importance = plain_importance(rows)
    on = Counter(x for html in set(rows) for x in {(p, t) for p, _, t in H.blocks(html)[0]})
    lost = lambda p, z, t: importance[p] < H.LEAST and (z < H.MAIN or on[p, t] > 1)
    return ["\n\n".join(t for p, z, t in H.blocks(html)[0] if not lost(p, z, t)) for html in rows]


def site(n):
    import random

    rng = random.Random(3)
    notes, rows = ["Join our club", "Rate us", "Read more"], []
    for k in range(n):
        parts = [f"<p>Story {k} part {j}</p>" for j in range(rng.randint(1, 3))] + [f"<div class=note>{rng.choice(notes)}</div>"] * rng.randint(0, 1)
        rng.shuffle(parts)
        open_, close = ("<article>", "</article>") if rng.random() < 0.7 else ("<div class=text>", "</div>")
        rows.append(f"<nav>Menu {k}</nav><div class=top>Welcome</div>{open_}{''.join(parts)}{close}<div class=end>Rights {k % 5}</div>")
    return rows + rows[:2]


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_whole_extraction_against_plain_dictionaries(spark, n):
    rows = site(n)
    table = [(k, "http://h/x", t) for k, t in enumerate(rows)]
    got = {r["path"]: r["importance"] for r in H.node_importance(parsed(spark, table)).collect()}
    want = plain_importance(rows)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    texts = {r["page_id"]: r["text"] for r in H.extract(spark, pages(spark, table)).collect()}
    assert [texts[k] for k in range(len(rows))] == plain_texts(rows)
    if n == 40:
        assert min(want.values()) < H.LEAST < max(want.values())  # the tree tells them apart
        assert not any("Welcome" in t or "Menu" in t for t in texts.values())


def test_the_tree_decides(spark, monkeypatch):
    rows = [(k, "http://h/x", t) for k, t in enumerate(site(12))]
    judged = {r["page_id"]: r["text"] for r in H.extract(spark, pages(spark, rows)).collect()}
    monkeypatch.setattr(H, "LEAST", 0.0)
    assert all("Menu" in r["text"] and "Welcome" in r["text"] and len(r["text"]) > len(judged[r["page_id"]]) for r in H.extract(spark, pages(spark, rows)).collect())
