"""The prefilter of the licence scan passes every sentence that a pattern knows."""

import pytest

from decklens.llm import licenses

EXAMPLES = {
    "AllRightsReserved": "All rights\n  reserved", "CopyrightLine": "(c) 2020 Foo", "SPDX": "SPDX-License-Identifier: Zlib",
    "Apache2Ref": "Apache License, Version 2.0", "Apache2Obtain": "You may obtain a copy of the License at x",
    "Apache2MayNot": "you may not use this file except in compliance with the License",
    "Apache2Unless": "Unless required by applicable law or agreed to in writing, x", "MITRef": "MIT licence",
    "MITPermission": "Permission is hereby granted, free of charge, to any person obtaining a copy of it",
    "MITNotice": "The above copyright notice and this permission notice shall be included in it",
    "AsIs": 'THE SOFTWARE IS PROVIDED "AS IS"', "NoLiability": "In no event shall we be liable",
    "ISCPermission": "Permission to use, copy, modify, and/or distribute this software for any purpose x",
    "BSDHead": "Redistribution and use in source and binary forms, x", "BSDSource": "Redistributions of source code must retain x",
    "BSDBinary": "Redistributions in binary form must reproduce x", "BSDEndorse": "may be used to endorse or promote products",
    "BSDRef": "3-clause BSD license", "AGPLRef": "Available under AGPL v3", "LGPLRef": "distributed under the LGPL 2.1 terms",
    "GPLRef": "This code is released under GPLv3", "GPLFree": "This program is free software", "OrLater": "(at your option) any later version",
    "MPLRef": "Mozilla Public License v2.0", "CCRef": "Text available under CC BY-SA 4.0",
    "ApacheBare": "the Apache license", "ISCRef": "ISC License", "0BSDPermission": "Permission to use, copy, modify, and/or distribute this software for any purpose is hereby granted",
    "PostgreSQLPermission": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose x",
    "BSDAdvertising": "3. All advertising materials mentioning features x", "BSDBare": "BSD license", "ZlibRef": "zlib/libpng license",
    "ZlibPermission": "Permission is granted to anyone to use this software for any purpose", "ZlibOrigin": "1. The origin of this software must not be misrepresented",
    "BoostPermission": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of it", "BoostRef": "Boost Software License",
    "OfVersion": "either version 3 of the License", "EPLRef": "Eclipse Public License - v 2.0", "EUPLRef": "EUPL", "CDDLRef": "CDDL 1.0", "ArtisticRef": "The Artistic License 2.0",
    "OFLRef": "SIL Open Font License", "WTFPLRef": "WTFPL", "CC0Ref": "CC0 1.0", "CCNamed": "Creative Commons Attribution 4.0",
    "Unlicense": "This is free and unencumbered software released into the public domain", "PublicDomain": "placed into the public\n domain",
}


@pytest.mark.parametrize("name", list(licenses.SENTENCES))
def test_examples_pass(name):
    assert name in [k for k, _ in licenses.sentence_ids(f"Some text.\n\n{EXAMPLES[name]}.\n\nMore text.")]


def test_licences_without_a_licence_word():
    found = lambda t: licenses.match_rules(licenses.sentence_ids(t))
    assert found("This code is released under GPLv3.") == ["GPL-3.0"]
    assert found("distributed under the LGPL 2.1 terms.") == ["LGPL-2.1"]
    assert found("Text available under CC BY-SA 4.0.") == ["CC-BY-SA-4.0"]
    assert found("Creative Commons BY 4.0") == ["CC-BY-4.0"] and found("CC-0") == ["CC0"] and found("plain text (c) of it") == []
    header = " * under the terms of the GNU General Public License version 2, or\n * (at your option) any later version.\n"
    assert found(header) == ["GPL-2.0-or-later"]
