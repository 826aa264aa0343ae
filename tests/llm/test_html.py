"""Regions of pages chosen by text-to-tag ratios."""

from __future__ import annotations

import time

import numpy as np
import pytest

from noema.llm import html_text

LONG = "A sentence of running text that goes on for a while. " * 5
MENU = "<div>" + "".join(f"<a href='/{i}'>Link {i}</a><br>" for i in range(40)) + "</div>"
PLAIN = f"<body>{MENU}<div id=c><h1>The headline</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>{MENU}</body>"


def test_ratios_choose_the_region_of_an_unmarked_page(monkeypatch):
    wanted = " ".join(["The headline", LONG.strip(), "Short.", LONG.strip()])
    assert html_text.main_text(PLAIN) == wanted
    # without the clusters the menus stay
    monkeypatch.setattr(html_text, "running_text", lambda sizes, tags, settings: np.ones(len(sizes), dtype=bool))
    assert "Link 3" in html_text.main_text(PLAIN)


@pytest.mark.parametrize("page, wanted", [
    (f"<article><h1>One</h1><p>{LONG}</p></article><article><h2>Two</h2><p>{LONG}</p></article>", f"One {LONG}Two {LONG}"),
    (f"<article><header><h1>One</h1><span>by somebody</span></header><p>{LONG}</p></article>", f"One {LONG}"),
    (f"<article><div class='post-header'><h1>One</h1></div><p>{LONG}</p></article>", f"One {LONG}"),
    (f"<article><h1>One</h1><div class='notice-of-election'><p>{LONG}</p></div><div class='related-work'>Short.</div></article>", f"One {LONG}Short."),
    (f"<header>Site</header><main><p>{LONG}</p><div class='related-posts'><p>{LONG}</p></div></main><footer>Foot</footer>", LONG),
    (f"<article><p>{LONG}</p><div class='comment-list'><article class='comment'><p>{LONG}</p></article></div></article>", LONG),
    (f"<article><p>{LONG}</p><ul><li>first<li>second</ul></article>", f"{LONG}first second"),
])
def test_regions(page, wanted):
    assert html_text.main_text(f"<body>{page}</body>") == wanted.strip()


def test_deep_pages_take_linear_time_and_memory():
    def seconds(n):
        began = time.process_time()
        assert html_text.main_text("<div><i><b>" * n + "deep text" + "</b></a>" * n) == "deep text"
        return time.process_time() - began

    seconds(1000)
    assert seconds(100_000) < 40 * seconds(10_000) + 1


def test_smoothing_against_a_plain_sum():
    values = np.random.Generator(np.random.PCG64(1)).random(30)
    weights = {k: np.exp(-k * k / 2) for k in range(-2, 3)}
    plain = [sum(w * values[min(29, max(0, i + k))] for k, w in weights.items()) / sum(weights.values()) for i in range(30)]
    assert np.allclose(html_text.smoothed(values, 1.0), plain)


def test_threshold_is_the_border_of_two_means():
    values = np.array([1.0, 1.2, 0.8, 5.0, 5.5, 6.0])
    assert html_text.threshold(values, 20) == pytest.approx((1.0 + 5.5) / 2)
