import random
import time

import pytest

from tessergraph.llm import licenses
from tests.llm.helpers import prose


@pytest.mark.parametrize("name", sorted({*licenses.TEMPLATES, *licenses.WHOLE, "Apache-2.0-text", "GPL-2-text", "GPL-3-text", "LGPL-3-text", "MPL-2.0-text", "CC0-1.0-text"}))
def test_every_template_is_found_as_itself(name):
    text = licenses.all_templates()[name]
    before, after = prose(random.Random(1), 40), prose(random.Random(2), 40)
    found = licenses.scan(f"{before}\n{text}\n{after}")
    own = len(licenses.words_of(text))
    if name not in ("MIT-disclaimer", "Unlicense-disclaimer"):  # they differ by three words
        assert found == [(name, 1.0, 40, 40 + own)]
    assert found[0][1:] == (1.0, 40, 40 + own) or found[0][1] > 0.9


def test_rest_of_a_license_and_notices():
    assert [f[0] for f in licenses.scan(licenses.TEMPLATES["MIT-disclaimer"])] == ["MIT-disclaimer"]
    assert [f[0] for f in licenses.scan("(c) 2020 Someone. All rights reserved. Some words.")] == ["All-rights-reserved"]
    assert [f[0] for f in licenses.scan(licenses.TEMPLATES["LGPL-2.1-header"])] == ["LGPL-2.1-header"]
    w = licenses.words_of(licenses.all_templates()["GPL-3-text"])
    assert [f[0] for f in licenses.scan(" ".join(w[: int(0.9 * len(w))]))] == ["GPL-3-text"]


def longest_common(a, b):
    """Plain dynamic programme, the most words that any alignment can have."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("name", ["MIT", "BSD", "Apache-header", "MPL-header", "ISC", "Unlicense", "MIT-disclaimer", "BSD-disclaimer"])
def test_coverage_against_the_longest_common_subsequence(name):
    draw, template = random.Random(name), licenses.words_of(licenses.TEMPLATES[name])
    for share in (0.03, 0.08, 0.12, 0.4):
        w = list(template)
        for at in draw.sample(range(len(w)), int(share * len(w))):
            w[at] = draw.choice([f"w{draw.randint(0, 99)}", "", f"{w[at]} w{draw.randint(0, 99)}"])
        text = f"{prose(draw, 60)} {' '.join(w)} {prose(draw, 60)}"
        words = licenses.words_of(text)
        best = longest_common(words, template) / len(template)
        found = [f for f in licenses.scan(text) if f[0] == name]
        assert all(0.8 <= cover <= best + 1e-9 for _, cover, _, _ in found)
        assert len(found) == (best >= 0.8) or 0.8 <= best < 0.86
        if found:
            assert found[0][1] >= best - 0.05 and 55 <= found[0][2] and found[0][3] <= len(words) - 55


def test_very_long_text():
    draw = random.Random(3)
    text = " ".join([prose(draw, 150_000), licenses.TEMPLATES["MIT"], prose(draw, 150_000), licenses.all_templates()["GPL-2-text"], prose(draw, 10)])
    assert [f[0] for f in licenses.scan(text)] == ["MIT", "GPL-2-text"]


def longest_common(a, b):
    """Words of a longest common subsequence, by the textbook table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_all_licenses_in_one_text():
    """Each template, one after another, is found whole, or inside a longer one; in time that grows with the text."""
    texts = licenses.all_templates()
    began = time.time()
    found = licenses.scan("".join(f"{text}\n{'own words ' * 150}\n" for text in texts.values()))
    assert time.time() - began < 10
    names = {name for name, *_ in found}
    assert all(cover == 1.0 for _, cover, _, _ in found)
    inside = {n for n, t in texts.items() for m in names if " ".join(licenses.words_of(t)) in " ".join(licenses.words_of(texts[m]))}
    assert set(texts) <= inside | names
    assert all(a[3] <= b[2] for a, b in zip(found, found[1:]))


def test_scrambled_and_partial_licenses_end_soon():
    draw = random.Random(4)
    text = licenses.all_templates()["GPL-3-text"]
    words = licenses.words_of(text)
    sentences = text.split(".")
    draw.shuffle(sentences)
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 3)]
    parts = [".".join(sentences), " ".join(words[: 7 * len(words) // 10] + ["other"] * 2000), " ".join(draw.choices(runs, k=2700))]
    began = time.time()
    assert [[n for n, *_ in licenses.scan(p) if n == "GPL-3-text"] for p in parts] == [[], [], []]
    assert time.time() - began < 5


def test_several_parts_against_the_longest_common_subsequence():
    """Licenses with words left out and put in, between other text: each is found, aligned almost as far as can be."""
    draw = random.Random(6)
    texts = {n: licenses.words_of(t) for n, t in licenses.all_templates().items()}
    names = ["MIT", "ISC-text", "BSD-2-text", "Apache-header", "GPL-header", "Zlib", "Unlicense-text"]
    for _ in range(6):
        said, want = [], []
        for name in draw.sample(names, 3):
            said += [f"own{draw.randrange(99)}" for _ in range(draw.randint(3, 40))]
            own = [w for w in texts[name] if draw.random() > 0.06]
            for _ in range(len(own) // 12):
                own.insert(draw.randrange(len(own)), f"new{draw.randrange(99)}")
            want.append((name, len(said), own))
            said += own
        found = licenses.scan(" ".join(said))
        for name, start, own in want:
            (cover,) = [c for n, c, s, e in found if n == name and s >= start - 3 and e <= start + len(own) + 3]
            best = longest_common(own, texts[name]) / len(texts[name])
            assert 0.95 * best <= cover <= best
        assert len(found) == 3
