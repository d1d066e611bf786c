"""License statements by identifier, by short name and by whole text, and statements taken back."""

from __future__ import annotations

import pytest

from scholarframe.llm import licenses


def scan(text):
    return licenses.scan(text.encode())[5:]


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("// SPDX-License-Identifier: Apache-2.0", {"apache-2"}),
        ("# SPDX-License-Identifier: MIT", {"mit"}),
        ("SPDX-License-Identifier: GPL-3.0-or-later", {"gpl-3"}),
        ("Licensed under the terms of the GNU General Public License version 3", {"gpl-3"}),
        ("It is licensed under the GNU GPL v3.", {"gpl-3"}),
        ("Available under the GNU LGPL, version 2", {"lgpl-2"}),
        ("Licensed under CC BY 4.0", {"cc-by"}),
        ("Released under the BSD 3-Clause license", {"bsd-3"}),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", {"mpl-2-notice"}),
        ("Distributed under the Boost Software License, Version 1.0.", {"boost-1"}),
        ("To the extent possible under law, Some Body has waived all copyright and related or neighboring rights to this work.", {"cc0-1"}),
    ],
)
def test_statements(text, labels):
    assert scan(text) == (labels, 1.0)
    assert scan("words before it, " + text + " and words behind it")[0] == labels


def test_openings_score_less_than_whole_texts():
    assert scan("This is free and unencumbered software released into the public domain.") == ({"unlicense"}, 0.75)
    zlib = next(t for label, _, t in licenses.TEMPLATES if label == "zlib-text")
    whole = licenses._MARKUP.sub(lambda m: m[3] or "", zlib)
    assert scan(whole) == ({"zlib", "zlib-text"}, 1.0) and scan(whole.replace("misrepresented", "told")) == ({"zlib"}, 0.75)


def test_negated_statements_score_less():
    assert scan("This is not licensed under the GNU General Public License, version 3.") == ({"gpl-3"}, licenses.NEGATED)
    assert scan("This is not licensed under the MIT license") == ({"mit"}, 0.5)  # the base phrase stands all the same
    assert scan("Not licensed under CC BY 4.0. But now it is licensed under CC BY 4.0.") == ({"cc-by"}, 1.0)
    assert scan("SPDX-License-Identifier: none") == (set(), 0.0)
