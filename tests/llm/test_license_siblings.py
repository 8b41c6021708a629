"""Licenses are told from their siblings, and from ordinary text about other licenses."""

import pytest
from test_operators import prose

from tessella.llm import licenses

SCANNER = licenses.Scanner(licenses.TEMPLATES)


def ids(text):
    return {name.split("/")[0] for name, *_ in SCANNER.scan(f"{prose(1, 100)} {text} {prose(2, 100)}")}


@pytest.mark.parametrize(
    "text, want",
    [
        ("Released under the BSD License.", set()),
        ("It was released under the terms of the license.", set()),
        ("Released under the terms of the MIT License.", {"MIT"}),
        ("This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0"}),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", {"LGPL-3.0"}),
        ("Licensed under the Apache License, Version 1.1.", set()),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", {"CC-BY-SA-4.0"}),
        ("Licensed under CC BY-NC-SA 4.0.", {"CC-BY-NC-SA-4.0"}),
        (licenses.TEMPLATES["GPL-3.0-or-later"].replace("version 3", "version 2"), {"GPL-2.0-or-later"}),
        ("This work is licensed under the GNU Library General Public License, version 2.", set()),
        (licenses.TEMPLATES["GPL-2.0-or-later"].replace("GNU ", "GNU Library "), set()),
        (licenses.TEMPLATES["BSD-3-Clause"], {"BSD-3-Clause"}),
        (licenses.TEMPLATES["BSD-2-Clause"], {"BSD-2-Clause"}),
        (licenses.TEMPLATES["Apache-2.0"].replace("2.0", "1.1"), set()),
    ],
)
def test_siblings(text, want):
    assert ids(text) == want


@pytest.mark.parametrize("name", licenses.TEMPLATES)
def test_every_template_is_reported_alone(name):
    assert ids(licenses.TEMPLATES[name]) == {name.split("/")[0]}
    assert len(SCANNER.telling[name]) == len(licenses.TELLING.get(name, []))
    head = licenses.TEMPLATES[name].split()
    assert name not in {s[0] for s in SCANNER.scan(" ".join(head[: len(head) // 2]))}
