"""Licence headers as they stand in real files, and sentences that name a licence without giving it."""

import pytest

from decklens.llm import licenses as L

GNU = """ * {program} is free software: you can redistribute it and/or modify
 * it under the terms of the GNU {kind}General Public License as published by
 * the Free Software Foundation, either version {version} of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU {kind}General Public License for more details.
 *
 * You should have received a copy of the GNU {kind}General Public License
 * along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
AS_IS = "\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND.\n"
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that:

1. Redistributions of source code must retain the above copyright notice.
2. Redistributions in binary form must reproduce the above copyright notice.
{more}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY WARRANTIES ARE DISCLAIMED.
"""
CASES = [
    (GNU.format(program="This program", kind="", version="3"), ["GPL-3.0-or-later"]),
    (GNU.format(program="This library", kind="Lesser ", version="2.1"), ["LGPL-2.1-or-later"]),
    (GNU.format(program="This program", kind="Affero ", version="3"), ["AGPL-3.0-or-later"]),
    ("See the GNU General Public License for more details.", ["GPL"]),
    ("Licensed under the GPLv2.", ["GPL-2.0"]), ("Distributed under LGPL 2.1 terms.", ["LGPL-2.1"]), ("GPL v3 or later.", ["GPL-3.0-or-later"]),
    ("Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n"
     "http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software is distributed on an \"AS IS\" BASIS.", ["Apache-2.0"]),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software.\n\nThe above copyright notice and this permission notice shall be included in all copies." + AS_IS, ["MIT"]),
    ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software." + AS_IS, ["BSL-1.0"]),
    ("Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]),
    ("This software is provided 'as-is', without any express or implied warranty.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications.\n\n"
     "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.", ["Zlib"]),
    (BSD.format(more=""), ["BSD-2-Clause"]),
    (BSD.format(more="3. Neither the name of the holder nor its contributors may be used to endorse or promote products derived from this software.\n"), ["BSD-3-Clause"]),
    (BSD.format(more="3. All advertising materials mentioning features or use of this software must display this.\n4. The name may not be used to, or\n may be used to endorse or promote products.\n"), ["BSD-4-Clause"]),
    ("Use of this source code is governed by a BSD 3-Clause license.", ["BSD-3-Clause"]), ("Released under the BSD license.", ["BSD"]),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice appears in all copies." + AS_IS, ["ISC"]),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted." + AS_IS, ["0BSD"]),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, get one.", ["MPL-2.0"]),
    ("This program is made available under the terms of the Eclipse Public License 2.0 which is available here.", ["EPL-2.0"]),
    ("Licensed under the EUPL v1.2.", ["EUPL-1.2"]), ("under the Common Development and Distribution License, Version 1.0", ["CDDL-1.0"]),
    ("Licensed under the SIL Open Font License, Version 1.1.", ["OFL-1.1"]),
    ("CC0 1.0 Universal", ["CC0-1.0"]), ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("text under CC BY-SA", ["CC-BY-SA"]),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["CC-BY-SA-4.0"]),
    ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0", ["CC-BY-NC-ND-4.0"]),
    ("// SPDX-License-Identifier: MIT", ["MIT"]), ("/* SPDX-License-Identifier: (apache-2.0 OR mit) */", ["Apache-2.0", "MIT"]),
    ("# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", ["GPL-2.0-only WITH Classpath-exception-2.0"]),
    ("SPDX-License-Identifier: LicenseRef-Own AND BSD-3-Clause\nnext line", ["LicenseRef-Own", "BSD-3-Clause"]),
    ("This is free and unencumbered software released into the public domain.", ["Unlicense"]),
    ("This file is not under the MIT License.", []), ("It is not licensed under the GNU General Public License version 2.", []),
    ("Licensed under the MIT License, not under the GNU General Public License.", ["MIT"]),
    ("Licensed under the Foo License.", ["Unrecognised"]), ("All rights reserved.", ["All-Rights-Reserved"]),
    ("We applied for a driving licence last year and got permission.", []), ("", []),
]


@pytest.mark.parametrize("text,want", CASES, ids=[f"{i}-{w[:1]}" for i, (_, w) in enumerate(CASES)])
def test_headers(text, want):
    assert L.match_rules(L.sentence_ids(text)) == want


def test_licences_of_one_text_stay_apart():
    text = "Licensed under the MIT License.\n\n" + CASES[1][0] + "\n\n" + CASES[0][0]
    assert L.match_rules(L.sentence_ids(text)) == ["MIT", "LGPL-2.1-or-later", "GPL-3.0-or-later"]


def plain_matches(ids):
    """The ordered rules by trying every way to place a rule's identifiers from the left."""
    free, out = [True] * len(ids), []

    def place(wanted, start):
        if not wanted:
            return []
        for i in range(start, len(ids)):
            if free[i] and ids[i][0] == wanted[0] and (rest := place(wanted[1:], i + 1)) is not None:
                return [i, *rest]
        return None

    for name, wanted in L.RULES:
        while (at := place(wanted, 0)) is not None:
            for i in at:
                free[i] = False
            out.append((at[0], ids[at[0]][1] if name.startswith("{") else name))
    out += [(i, "Unrecognised") for i, (k, _) in enumerate(ids) if free[i] and k == "Unrecognised"]
    names = []
    for _, n in sorted(out):
        if n not in names:
            names.append(n)
    return [n for n in names if not any(o.startswith(n + "-") for o in names)]


def test_rules_equal_plain_search():
    import random

    rng = random.Random(4)
    pool = [*{w for _, wanted in L.RULES for w in wanted}, "Unrecognised", "OrLater", "CopyrightLine"]
    for _ in range(400):
        ids = [(k, rng.choice([k, f"{k}-1.0"]) if k in L._NAMING else k) for k in rng.choices(pool, k=rng.randrange(12))]
        assert L.match_rules(ids) == plain_matches(ids)
