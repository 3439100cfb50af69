"""Every place of a notice is told, however close the next one is."""

import random

import pytest

from tabml.llm import licenses


@pytest.mark.parametrize("name", ["MIT-notice", "CC-BY-NC-4.0-notice", "Apache-2.0-notice", "MIT-grant"])
@pytest.mark.parametrize("between", ["\n", " x ", " x y "])
def test_notices_that_follow_each_other(name, between):
    notice, size = licenses.TEMPLATES[name], len(licenses.TEMPLATES[name].split())
    rows = licenses._Index({name: notice}).scan(between.join([notice] * 9).encode(), licenses.BAND, licenses.COVERAGE)
    step = size + len(between.split())
    assert sorted(r[3:5] for r in rows) == [(k * step, k * step + size) for k in range(9)]


def test_a_partial_notice_before_a_whole_one():
    index = licenses._Index({"MIT-notice": licenses.TEMPLATES["MIT-notice"]})
    rows = index.scan(b"Released under the MIT Released under the MIT License.", licenses.BAND, licenses.COVERAGE)
    assert sorted(r[3:5] for r in rows) == [(0, 4), (4, 9)]


def everywhere(name, template, words, band=licenses.BAND, coverage=licenses.COVERAGE):
    """Spans of a template by aligning it around every diagonal, best first."""
    numbers: dict = {}
    t = [numbers.setdefault(licenses._plain(w), len(numbers) + 1) for w in template.encode().lower().split()]
    text = [numbers.get(licenses._plain(w), 0) for w in words]
    found = []
    for shift in range(-len(t), len(text)):
        matched, first, last = licenses._aligned(t, text, shift, band)
        if matched >= coverage * len(t):
            found.append((first, last + 1))
    return found


@pytest.mark.parametrize("name", ["MIT-notice", "Apache-2.0-notice", "GPL-3.0-notice", "CC0-1.0-name"])
def test_no_place_is_missed(name):
    """Changed, dropped and inserted words: each place that some alignment finds overlaps a row, and the other way."""
    template, dice = licenses.TEMPLATES[name], random.Random(name)
    index = licenses._Index({name: template})
    for _ in range(120):
        words = []
        for _ in range(dice.randint(1, 3)):
            words += [f"x{dice.randrange(99)}" for _ in range(dice.randint(0, 25))]
            for w in template.split():
                change = dice.random()
                words += [] if change < 0.1 else [f"y{dice.randrange(99)}"] if change < 0.2 else ["und", w] if change < 0.35 else [w]
        rows = index.scan(" ".join(words).encode(), licenses.BAND, licenses.COVERAGE)
        spans, places = [r[3:5] for r in rows], everywhere(name, template, [w.encode().lower() for w in words])
        meets = lambda p, many: any(p[0] < e and f < p[1] for f, e in many)
        assert all(meets(p, spans) for p in places) and all(meets(p, places) for p in spans)


def test_names_versions_and_identifiers(spark):
    texts = ["x SPDX-License-Identifier: MIT\n# y", "the GNU Lesser General Public License version 2.1 holds", "see Mozilla Public License Version 2.0 text",
             "Released under MIT License.", "spdx-license-identifier:", licenses.TEMPLATES["GPL-3.0-notice"], licenses.TEMPLATES["BSD-2-Clause"],
             "ok " + licenses.TEMPLATES["Unlicense"].replace("We intend", "We do intend") + " end"]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    names: dict = {}
    for r in rows:
        names.setdefault(r.id, set()).add(r.license)
        assert 0.7 <= r.coverage <= 1 and texts[r.id][r.begin:r.end].split()
    assert names == {0: {"SPDX:MIT"}, 1: {"LGPL-2.1-name"}, 2: {"MPL-2.0-name"}, 3: {"MIT-notice"}, 5: {"GPL-3.0-notice"},
                     6: {"BSD-2-Clause", "BSD-grant"}, 7: {"Unlicense"}}
