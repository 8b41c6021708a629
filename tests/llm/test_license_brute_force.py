"""The windows that the scanner aligns, against the alignment of every window."""

import random

import pytest
from test_operators import prose

from tessella.llm import licenses

NAMES = ["MIT", "ISC", "BSD-3-Clause", "Apache-2.0", "GPL-2.0-or-later", "CC-BY-SA-4.0", "MIT/notice"]
SCANNER = licenses.Scanner({n: licenses.TEMPLATES[n] for n in NAMES})


def spoiled(rng, name):
    """A template with words left out and words put in, among stray words of its own."""
    words, share = SCANNER.templates[name], rng.choice([0, 0.05, 0.1, 0.15])
    stray = lambda n: [rng.choice(words) if rng.random() < 0.3 else b"noise%d" % rng.randrange(50) for _ in range(n)]
    body = []
    for w in words:
        body += [w] if rng.random() >= share else []
        body += stray(rng.randrange(1, 3)) if rng.random() < share else []
    return stray(rng.randrange(60)) + body + stray(rng.randrange(60))


def every_window(words, name):
    """The stretches that align in any window that begins at a word of the template."""
    template, out = SCANNER.templates[name], []
    for start in range(len(words)):
        if words[start] in SCANNER.wanted[name]:
            pairs = licenses.align(words[start : start + len(template) * 3 // 2 + 1], template)
            if len(pairs) >= SCANNER.need[name] and SCANNER._tells(name, pairs):
                out.append((start + pairs[0][0], start + pairs[-1][0]))
    return out


def stretches(words, name):
    return SCANNER._stretches(words, [i for i, w in enumerate(words) if w in SCANNER.wanted[name]], name)


@pytest.mark.parametrize("name", NAMES)
def test_no_stretch_is_missed(name):
    rng, held = random.Random(name), 0
    for _ in range(25):
        words = spoiled(rng, name) + (spoiled(rng, name) if rng.random() < 0.4 else [])
        want, got = every_window(words, name), stretches(words, name)
        held += bool(want)
        assert all(any(a <= y and x <= b for _, a, b in got) for x, y in want)
        assert all(any(a <= y and x <= b for x, y in want) for _, a, b in got)
        assert all(b < c for (_, _, b), (_, c, _) in zip(sorted(got, key=lambda g: g[1]), sorted(got, key=lambda g: g[1])[1:]))
    assert held


def test_copies_side_by_side_are_told_apart():
    for name in NAMES:
        spans = [s for s in SCANNER.scan(" ".join([licenses.TEMPLATES[name]] * 3)) if s[0] == name]
        assert [s[1] for s in spans] == [1.0] * 3, name


def test_many_notices_in_a_long_text():
    text = " ".join(f"{prose(i, 40)} Released under the MIT License." for i in range(300))
    assert len(SCANNER.scan(text)) == 300


def test_equal_coverage_goes_to_the_first_name():
    same = licenses.Scanner({"B": "one two three four", "A": "one two three four"})
    assert [s[0] for s in same.scan("x one two three four y")] == ["A"]
    assert same.scan("") == [] and same.scan("one two three") == []
