import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from latentspark.llm import licenses
from tests.llm.fixtures import documents, frame


@given(st.lists(st.sampled_from("abcdefgh"), max_size=25), st.lists(st.sampled_from("abcdefgh"), max_size=12))
@settings(max_examples=200, deadline=None)
def test_alignment_is_a_common_subsequence(text, template):
    pairs = licenses.patience(text, template)
    assert all(text[i] == template[j] for i, j in pairs)
    assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False))


@given(st.lists(st.integers(0, 20), max_size=20))
@settings(max_examples=200, deadline=None)
def test_longest_rise(values):
    best = [1] * len(values)
    for i in range(len(values)):
        best[i] = 1 + max((best[k] for k in range(i) if values[k] < values[i]), default=0)
    rise = licenses._longest_rise(values)
    assert [values[k] for k in rise] == sorted({values[k] for k in rise}) and len(rise) == max(best, default=0)


def test_every_template_is_found_alone_and_inside_a_text():
    noise = documents()[1][1]
    for name, _, text in licenses.TEMPLATES:
        for whole in (text, f"{noise}\n{text.upper()}\n{noise}", f"{text} {text}"):
            found = licenses.scan(whole)
            assert found[0].license == name and found[0].coverage == 1.0, (name, found)


def test_edited_and_reflowed_text_is_found():
    name, _, text = licenses.TEMPLATES[1]
    words = text.split()
    edited = "\n * ".join(" ".join(w for k, w in enumerate(words) if k % 12 != 5)[k : k + 40] for k in range(0, len(text), 40))
    found = licenses.scan("intro words " + edited)
    assert found and found[0].license == name and 0.8 <= found[0].coverage < 1


def test_near_wordings_are_told_apart():
    assert [m.license for m in licenses.scan("Licensed under CC BY-NC 4.0.")] == ["CC-BY-NC-4.0"]
    assert [m.license for m in licenses.scan("This work is licensed under the GNU General Public License, version 2.")] == ["GPL-2.0"]
    assert licenses.scan("Released under the new London License, and mit grace.") == []
    two = "Released under the MIT License.\nLicensed under the Apache License, Version 2.0."
    assert {m.license for m in licenses.scan(two)} == {"MIT", "Apache-2.0"}


def test_relatives_are_told_apart():
    names = {"BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "Apache-2.0", "MPL-2.0"}
    for name, _, text in licenses.TEMPLATES:
        if name in names and len(text) > 300:
            words = text.split()
            # Lightly edited, and with another holder's name, as texts in use are.
            edited = " ".join(w for k, w in enumerate(words) if k % 41 != 20).replace("the copyright holder nor", "Example Widgets Inc. nor")
            assert [m.license for m in licenses.scan(f"Copyright 2020 Some Body\n{edited}\nTHIS SOFTWARE IS PROVIDED AS IS")] == [name]


def test_files_of_licenses_and_headers_in_use():
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "BSD": "BSD-3-Clause"}
    for file, name in files.items():
        with open(f"/usr/share/common-licenses/{file}", encoding="utf-8") as f:
            found = licenses.scan(f.read())
        assert found and found[0].license == name, (file, found)
    header = "This file is part of Foo.\n\nFoo is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2, or (at your option) any later version.\n\nFoo is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."
    assert [m.license for m in licenses.scan(header)] == ["GPL-2.0"]


def common(a, b):
    """Length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def edited(rng, words, rate):
    out = []
    for w in words:
        u = rng.random()
        out += [] if u < rate / 3 else ["other"] if u < 2 * rate / 3 else [w, "more"] if u < rate else [w]
    return out


@pytest.mark.parametrize("rate", [0.0, 0.05, 0.1, 0.15])
def test_coverage_is_near_that_of_a_longest_common_subsequence(rate):
    """Anchors may miss a few words that a longest subsequence takes, never gain any."""
    rng = random.Random(3)
    for t in licenses._TEMPLATES:
        if len(t.words) < 400:
            words = edited(rng, t.words, rate)
            got, best = len(licenses.patience(words, t.words)), common(words, t.words)
            assert got <= best and best - got <= 0.04 * len(t.words) + 1, (t.name, got, best)


def scan_without_filters(text):
    """scan with every template held against every window of the text."""
    words, found = licenses.words_of(text), {}
    for t in licenses._TEMPLATES:
        step = len(t.words) // 2 + 2
        for cell in range(-2, len(words) // step + 2):
            low, high = max(0, (cell - 1) * step), min(len(words), (cell + 1) * step + len(t.words))
            pairs = licenses.patience(words[low:high], t.words) if low < high else []
            if not pairs or not t.keys <= {t.words[j] for _, j in pairs}:
                continue
            m = licenses.Match(len(pairs) / len(t.words), len(pairs), t.name, low + pairs[0][0], low + pairs[-1][0] + 1)
            clean = t.others.isdisjoint(words[m.start : m.end + t.behind])
            if clean and m.coverage >= licenses.MIN_COVERAGE and m.aligned >= licenses.MIN_DENSITY * (m.end - m.start) and (t.name not in found or m[:2] > found[t.name][:2]):
                found[t.name] = m
    ordered = sorted(found.values(), key=lambda m: (-m.coverage, -m.aligned, m.license))
    return [m for k, m in enumerate(ordered) if all(m.end <= o.start or o.end <= m.start for o in ordered[:k])]


def test_filters_lose_no_license():
    """Words and windows that are left out first change no verdict of edited templates, of parts of them and of plain texts."""
    rng, short = random.Random(5), [t for t in licenses._TEMPLATES if len(t.words) < 300]
    texts = [r[1] for r in documents()[:8]] + [None, ""]
    for t in short:
        noise = [rng.choice(("some", "words", "between", "license", "version")) for _ in range(rng.randint(0, 60))]
        for rate in (0.0, 0.08, 0.18):
            texts.append(" ".join(noise + edited(rng, t.words, rate) + noise))
        texts.append(" ".join(t.words[: len(t.words) * 3 // 4]))
    for text in texts:
        got, plain = licenses.scan(text), scan_without_filters(text)
        assert [(m.license, m.aligned) for m in got][:1] == [(m.license, m.aligned) for m in plain][:1], (text, got, plain)


def test_a_very_long_text():
    name, _, text = licenses.TEMPLATES[0]
    whole = "plain words of a book " * 300_000 + text + " and more of it" * 100_000
    assert [m.license for m in licenses.scan(whole)] == [name]


def test_awkward_rows(spark):
    rows = documents() + [(900, "Some text.\nReleased under the MIT License.\n", "en", "a", 0)]
    got = licenses.license_scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert [(r.doc_id, r.license, r.start_word, r.end_word) for r in got if r.license] == [(900, "MIT", 2, 7)]
    assert licenses.license_scan(frame(spark, rows).where("false")).count() == 0
