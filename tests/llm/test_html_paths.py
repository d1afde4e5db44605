"""Tag-path ratios against a plain version; what they decide; odd and very long pages."""

import math
import random
import time
from html.parser import HTMLParser

import pytest

from paceline.llm import html_text
from paceline.llm.html_text import TagPaths, main_text


class Tree(HTMLParser):
    """(path of (tag, class, number of the element), text, linked characters) of each block of a well-formed page."""

    def __init__(self):
        super().__init__()
        self.path, self.n, self.out, self.link = [], 0, [("", [], 0)], False

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link = True
            return
        self.n += 1
        self.path.append((tag, dict(attrs).get("class", ""), self.n))
        self.out.append((tuple(self.path), [], [0]))

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = False
            return
        self.path.pop()
        self.out.append((tuple(self.path), [], [0]))

    def handle_data(self, data):
        self.out[-1][1].append(data)
        if self.link:
            self.out[-1][2][0] += len(data)


def plain(page, p=TagPaths()):
    """Tag-path ratios by their definition, on pages without class words or boilerplate tags."""
    t = Tree()
    t.feed(page)
    found = [(path, " ".join("".join(x).split()), k[0]) for path, x, k in t.out[1:] if "".join(x).split()]
    if not found:
        return ""
    label = [tuple((a, b) for a, b, _ in path) for path, _, _ in found]
    count = lambda x: sum(c in ".,;:!?…。，！？" for c in x)

    def ratio(value):
        of = [sum(value(f) for f, b in zip(found, label) if b == a) / label.count(a) for a in label]
        n = len(of)
        return [0.25 * of[max(i - 1, 0)] + 0.5 * of[i] + 0.25 * of[min(i + 1, n - 1)] for i in range(n)]

    length, marks = ratio(lambda f: max(len(f[1]) - f[2], 0)), ratio(lambda f: count(f[1]))
    fused = [a * (1 + b) for a, b in zip(length, marks)]
    mean = sum(fused) / len(fused)
    limit = min(p.spread * math.sqrt(sum((x - mean) ** 2 for x in fused) / len(fused)), mean)
    top = {a: max(x for x, b in zip(fused, label) if a == b) for a in label}
    taken = [top[a] >= limit and top[a] > 0 for a in label]
    unit = [next((x for x in reversed(path) if x[0] in ("article", "main")), None) for path, _, _ in found]
    keep = []
    for i, (path, text, _) in enumerate(found):
        group = [f[0] for f, y, u in zip(found, taken, unit) if y and u == unit[i]]
        whole = sum(x for x, y in zip(fused, taken) if y)
        some = sum(x for x, y, u in zip(fused, taken, unit) if y and u == unit[i])
        inside = False
        if group and (unit[i] is not None or 2 * some > whole):
            around = group[0][:-1]
            while any(g[: len(around)] != around for g in group) or (around and around[-1][0] == "p"):
                around = around[:-1]
            inside = path[: len(around)] == around
        if taken[i] or inside or (path[-1:] and path[-1][0] == "h1" and unit[i] is not None and group):
            keep.append(text)
    return "\n".join(keep)


def random_page(rng, depth=0):
    out = ""
    for _ in range(rng.randrange(1, 4)):
        kind = rng.random()
        if depth < 4 and kind < 0.4:
            tag, name = rng.choice(["div", "section", "article"]), rng.choice(["x", "y", "z"])
            out += f"<{tag} class={name}>{random_page(rng, depth + 1)}</{tag}>"
        elif kind < 0.8:
            out += f"<div class=t>{'Some text, more of it. ' * rng.randrange(1, 12)}</div>"
        elif kind < 0.95:
            out += f"<div class=m><a href=/>{'link ' * rng.randrange(1, 4)}</a></div>"
        else:
            out += f"<h1>Head {rng.randrange(9)}</h1>"
    return out


def test_ratios_as_defined():
    rng = random.Random(4)
    for _ in range(300):
        page = f"<body>{random_page(rng)}</body>"
        assert main_text(page) == plain(page), page


def test_ratios_decide(monkeypatch):
    """No tag or class tells these blocks apart; without the ratios the page would keep all of them."""
    text = "A sentence of the text, with commas, and a stop. " * 6
    page = "<body>" + "".join(f"<div class=b{i}><div class=line>item {i}</div></div>" for i in range(8)) + f"<div class=c><div class=q>{text}</div><div class=q>{text}</div></div></body>"
    want = main_text(page)
    assert want.count("A sentence") == 12 and "item" not in want
    monkeypatch.setattr(html_text, "_smooth", lambda x, kernel: [1.0] * len(x))
    assert "item" in main_text(page)


@pytest.mark.parametrize("word", ["has-sidebar", "no-sidebar", "nav-open", "page-with-sidebar", "search-enabled"])
def test_body_classes(word):
    article = "<article><h1>T</h1><p>" + "Some words, here and there. " * 9 + "<section class=related-work><p>Others did it, too.</p></section></article>"
    assert main_text(f"<body class='{word}'>{article}</body>").split("\n")[0::2] == ["T", "Others did it, too."]


@pytest.mark.parametrize("page", ["<a " * 350_000, "<script " * 130_000, '<a "' * 250_000, "<" * 1_000_000, "<!--" * 250_000, "<svg>" * 200_000])
def test_long_malformed_pages(page):
    start = time.time()
    main_text(page)
    assert time.time() - start < 1


def test_deep_pages():
    start = time.time()
    assert main_text("<div>x" * 50_000).count("x") == 50_000
    main_text("<div>" * 50_000 + "</foo>" * 50_000 + "</div>x" * 50_000)
    main_text("<div class=ad>x" * 50_000)
    assert time.time() - start < 10
    long = "<article><p>" + "word, and. " * 300_000 + "</p></article>"
    assert len(main_text(long)) == len("word, and. ") * 300_000 - 1


def test_extra_columns_nulls_and_repeats(spark):
    page = "<article><p>One, two. Three.</p></article>"
    rows = [(1, "u", page, "x"), (1, "u", page, "x"), (None, None, None, None), (2, "", "", "")]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out) == [(0, "", 0), (1, "One, two. Three.", 16), (1, "One, two. Three.", 16), (2, "", 0)]
