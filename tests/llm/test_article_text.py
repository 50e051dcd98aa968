"""The article field against brute force, and pages of kinds that the sample does not show."""

import itertools
import math
import random

import numpy as np
import pytest

from furlong.llm import html_text as H


def some_pages(n, seed=4):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        blocks = [H.Block("w", rng.sample(["a", "b", "c", "d"], rng.randint(1, 3)), frozenset()) for _ in range(rng.randint(1, 7))]
        out.append((blocks, [rng.randint(0, 1) for _ in blocks]))
    return out


def score(field, blocks, labels):
    s = field.ends[0][labels[0]] + field.ends[1][labels[-1]]
    s += sum(field.pairs[x][y] for x, y in zip(labels, labels[1:]))
    return s + sum(field.scores(b) for b, y in zip(blocks, labels) if y)


def some_field(rng):
    draw = lambda *shape: np.array([rng.gauss(0, 1) for _ in range(math.prod(shape))]).reshape(shape)
    return H.Field("abcd", draw(4), draw(2, 2), draw(2, 2))


def test_viterbi_is_the_best_of_all_labellings():
    rng = random.Random(1)
    for blocks, _ in some_pages(60):
        field = some_field(rng)
        best = max(itertools.product((0, 1), repeat=len(blocks)), key=lambda y: score(field, blocks, y))
        assert score(field, blocks, field.labels(blocks)) == pytest.approx(score(field, blocks, best))


def test_expected_counts_are_those_of_all_labellings():
    field, pages, place = some_field(random.Random(2)), some_pages(12), {f: k for k, f in enumerate("abcd")}
    want = np.zeros(12)
    for blocks, _ in pages:
        all_labels = list(itertools.product((0, 1), repeat=len(blocks)))
        weight = np.exp([score(field, blocks, y) for y in all_labels])
        for y, w in zip(all_labels, weight / weight.sum()):
            for b, label in zip(blocks, y):
                for f in b.features:
                    want[place[f]] += w * label
            for x, z in zip(y, y[1:]):
                want[4 + 2 * x + z] += w
            want[8 + y[0]] += w
            want[10 + y[-1]] += w
    theta = np.concatenate([[field.weight[f] for f in "abcd"], np.ravel(field.pairs), np.ravel(field.ends)])
    assert H.Pages(pages, place).expected(theta) == pytest.approx(want)


def test_groups_of_lengths_add_up_to_all_pages():
    pages = some_pages(30) + [(b * 12, y * 12) for b, y in some_pages(20, 5)]
    place = {f: k for k, f in enumerate("abcd")}
    theta = np.array([random.Random(k).gauss(0, 1) for k in range(12)])
    apart = H.Pages(pages[:30], place), H.Pages(pages[30:], place)
    whole = H.Pages(pages, place)
    assert sum(g.expected(theta) for g in apart) == pytest.approx(whole.expected(theta))
    assert sum(g.seen for g in apart) == pytest.approx(whole.seen)


def test_the_fit_meets_the_counts_of_the_labels():
    pages = some_pages(40)
    field = H.train(pages, rounds=400)
    theta = np.concatenate([[field.weight[f] for f in "abcd"], np.ravel(field.pairs), np.ravel(field.ends)])
    whole = H.Pages(pages, {f: k for k, f in enumerate("abcd")})

    def slope(at):
        return np.abs((whole.seen - whole.expected(at)) / len(pages) - 0.0005 * at).max()

    assert slope(theta) < 0.1 * slope(np.zeros(12))


def test_formulas_and_objects_stay_in_their_paragraph():
    page = "<p>The formula is <math><mrow><mi>a</mi><mo>+</mo><mi>b</mi></mrow></math> and <svg><g><text>x</text></g></svg>more <object>words</object> follow.</p>"
    assert [b.text for b in H.leaf_blocks(page)] == ["The formula is a+b and more words follow."]


LINES = [f"Paragraph number {i} tells at length what happened on the river and why the bridge was closed again." for i in range(150)]


def test_tables_without_an_article_element(spark):
    body = "".join(f"<p>{x}</p>" for x in LINES[:3])
    page = f'<html><body><nav><a href="/">Home</a></nav><div class="content">{body}</div><div class="footer"><p>Copyright words here</p></div></body></html>'
    schema = "page_id long, url string, html string"
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", ""), (1, "u", page)], schema)
    for field in (H.fit(df), H.fit(df, sample_chars=1)):  # own paragraphs, made-up ones
        got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in H.extract(df, field).collect())
        text = "\n".join(LINES[:3])
        assert got == [(1, text, len(text)), (1, text, len(text)), (2, "", 0), (3, "", 0)]


def test_long_articles_are_kept_whole(spark):
    page = "<html><body><header><h2>Site</h2></header><article>" + "".join(f"<p>{x}</p>" for x in LINES) + "</article><footer>end</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page, "x")], "page_id long, url string, html string, text string")
    got = H.extract(df, H.fit(df)).collect()
    assert got[0]["text"] == "\n".join(LINES)
