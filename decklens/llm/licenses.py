"""License scans by sentence rules.

Sentences of a text are normalised, and those that bear a legal word mapped to known licence-sentence
identifiers, with the version that a reference names; the text's sequence of identifiers is then matched against ordered licence
rules, the longer rules first, and each identifier serves one rule. "Version 3 of the License" and "or any later version" belong to the
GNU licence named before them. A reference without a version adds nothing where its family is named with
one, and one in a sentence that says "not under" does not count. SPDX lines are read as expressions.
A sentence with a licence word that no pattern knows is ``Unrecognised``.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decklens.llm.common import as_texts, pieces

#: A normalised sentence can match a pattern below only if it holds one of these or begins with "c ".
LEGAL_WORDS = (
    "licen", "copyright", "rights reserved", "permission", "redistribut", "public domain", "spdx", "liable", "as is",
    "endorse or promote", "apache", "applicable law", "gpl", "free software", "any later version", "cc ", "cc0", "creative commons",
    "cddl", "misrepresented", "advertising materials", "wtfpl", "eupl",
)

_VERSION = r"(?:.*?\b(?:version|v|ver) ?(\d(?:\.\d)?)| (\d\.\d))?"

#: Identifier -> pattern that a whole normalised sentence is searched for. Groups hold versions.
SENTENCES = {
    "AllRightsReserved": r"\ball rights reserved\b",
    "CopyrightLine": r"^(?:copyright|c) (?:c )?(?:\d{4}|by\b)|^copyright c?\b.*\b\d{4}\b",
    "Apache2Ref": r"\bapache licen[sc]e,? (?:version )?v?2(?:\.0)?\b|\bapache (?:version )?2(?:\.0)? licen[sc]e\b",
    "ApacheBare": r"\bapache licen[sc]e\b",
    "Apache2Obtain": r"^you may obtain a copy of the licen[sc]e at\b",
    "Apache2MayNot": r"^you may not use this file except in compliance with the licen[sc]e$",
    "Apache2Unless": r"^unless required by applicable law or agreed to in writing\b",
    "MITRef": r"\bmit licen[sc]e\b|\blicen[sc]ed under (?:the )?mit\b",
    "MITPermission": r"^permission is hereby granted, free of charge, to any person obtaining a copy\b",
    "MITNotice": r"^the above copyright notice and this permission notice shall be included\b",
    "AsIs": r"^(?:the|this) software is provided (?:by .{0,120})?as is\b",
    "NoLiability": r"^in no event (?:shall|will)\b.*\bliable\b",
    "ISCRef": r"\bisc licen[sc]e\b",
    "ISCPermission": r"^permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose\b",
    "0BSDPermission": r"^permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose\b(?!.*\bprovided that\b).*\bhereby granted\b",
    "PostgreSQLPermission": r"^permission to use, copy, modify,? and distribute this software and its documentation for any purpose\b",
    "BSDHead": r"^redistribution and use in source and binary forms\b",
    "BSDSource": r"^(?:\d )?redistributions of source code must retain\b",
    "BSDBinary": r"^(?:\d )?redistributions in binary form must reproduce\b",
    "BSDAdvertising": r"^(?:\d )?all advertising materials mentioning features\b",
    "BSDEndorse": r"\bmay be used to endorse or promote products\b",
    "BSDRef": r"\b([0234]) clause bsd licen[sc]e\b|\bbsd ([0234]) clause\b",
    "BSDBare": r"\bbsd licen[sc]e\b",
    "ZlibPermission": r"^permission is granted to anyone to use this software for any purpose\b",
    "ZlibOrigin": r"^(?:\d )?the origin of this software must not be misrepresented\b",
    "ZlibRef": r"\bzlib(?:/libpng)? licen[sc]e\b",
    "BoostPermission": r"^permission is hereby granted, free of charge, to any person or organization obtaining a copy\b",
    "BoostRef": r"\bboost software licen[sc]e\b",
    "AGPLRef": rf"\bgnu affero general public licen[sc]e\b{_VERSION}|\bagpl ?v?(\d(?:\.\d)?)?\b",
    "LGPLRef": rf"\bgnu (?:lesser|library) general public licen[sc]e\b{_VERSION}|\blgpl ?v?(\d(?:\.\d)?)?\b",
    "GPLRef": rf"\bgnu general public licen[sc]e\b{_VERSION}|(?<![al])\bgpl ?v?(\d(?:\.\d)?)?\b",
    "GPLFree": r"^this (?:program|library) is free software\b",
    "OfVersion": r"\bversion (\d(?:\.\d)?) of the licen[sc]e\b",
    "OrLater": r"\bany later version\b|\bor later\b",
    "MPLRef": rf"\bmozilla public licen[sc]e\b{_VERSION}",
    "EPLRef": rf"\beclipse public licen[sc]e\b{_VERSION}",
    "EUPLRef": rf"\beuropean union public licen[sc]e\b{_VERSION}|\beupl ?v?(\d\.\d)?\b",
    "CDDLRef": rf"\bcommon development and distribution licen[sc]e\b{_VERSION}|\bcddl ?v?(\d\.\d)?\b",
    "ArtisticRef": rf"\bartistic licen[sc]e\b{_VERSION}",
    "OFLRef": rf"\bsil open font licen[sc]e\b{_VERSION}",
    "WTFPLRef": r"\bdo what the fuck you want to public licen[sc]e\b|\bwtfpl\b",
    "CC0Ref": r"\bcc ?(?:0|zero)\b(?: (\d\.\d))?|\bcreative commons (?:zero|cc0)\b(?:.*?(\d\.\d))?",
    "CCRef": r"\b(?:cc|creative commons)(?: licen[sc]e)? (by(?: (?:nc|sa|nd))*)\b(?: (\d\.\d))?",
    "CCNamed": r"\bcreative commons (attribution(?: (?:non ?commercial|share ?alike|no ?deriv(?:ative)?s))*)(?:.*?(\d\.\d))?",
    "Unlicense": r"\bfree and unencumbered software released into the public domain\b",
    "PublicDomain": r"\b(?:released|dedicated|placed) (?:in)?to the public domain\b|\bpublic domain (?:work|dedication)\b",
}

#: Licence -> identifiers in the order in which the text must hold them (others may
#: stand in between). Tried from top to bottom; a name in braces is the one that the reference gives.
RULES = (
    ("Apache-2.0", ("Apache2Ref", "Apache2MayNot", "Apache2Obtain", "Apache2Unless")),
    ("MIT", ("MITPermission", "MITNotice", "AsIs")),
    ("BSL-1.0", ("BoostPermission", "AsIs")),
    ("BSD-4-Clause", ("BSDHead", "BSDSource", "BSDBinary", "BSDAdvertising", "BSDEndorse", "AsIs")),
    ("BSD-3-Clause", ("BSDHead", "BSDSource", "BSDBinary", "BSDEndorse", "AsIs")),
    ("BSD-2-Clause", ("BSDHead", "BSDSource", "BSDBinary", "AsIs")),
    ("Zlib", ("AsIs", "ZlibPermission", "ZlibOrigin")),
    ("0BSD", ("0BSDPermission", "AsIs")),
    ("ISC", ("ISCPermission", "AsIs")),
    ("PostgreSQL", ("PostgreSQLPermission",)),
    ("Unlicense", ("Unlicense", "PublicDomain")),
    *((f"{{{ref}}}", (ref,)) for ref in (
        "AGPLRef", "LGPLRef", "GPLRef", "MPLRef", "EPLRef", "EUPLRef", "CDDLRef", "ArtisticRef", "OFLRef", "BSDRef", "CC0Ref", "CCRef", "CCNamed", "SPDX")),
    ("Apache-2.0", ("Apache2Ref",)),
    ("Apache", ("ApacheBare",)),
    ("MIT", ("MITRef",)),
    ("ISC", ("ISCRef",)),
    ("BSD", ("BSDBare",)),
    ("Zlib", ("ZlibRef",)),
    ("BSL-1.0", ("BoostRef",)),
    ("WTFPL", ("WTFPLRef",)),
    ("Unlicense", ("Unlicense",)),
    ("Public-Domain", ("PublicDomain",)),
    ("All-Rights-Reserved", ("AllRightsReserved",)),
)

#: Identifiers as SPDX writes them, found whatever the case of a text.
SPDX_NAMES = {n.lower(): n for n in (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "CC-BY-4.0",
    "CC-BY-SA-4.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "OFL-1.1", "PostgreSQL", "Unlicense", "WTFPL", "Zlib",
)}

_GNU = ("GPLRef", "LGPLRef", "AGPLRef")
#: One pattern that says "not under": the licence named after it is not the text's.
_NOT = re.compile(r"\b(?:not|never|neither|nor) (?:\w+ ){0,3}(?:under|by)\b(?! (?:\w+ ){0,3}and\b)")
_PATTERNS = {k: re.compile(v) for k, v in SENTENCES.items()}
_LEGAL = re.compile("|".join(["^c ", *map(re.escape, LEGAL_WORDS)]))
_SPDX = re.compile(r"SPDX-License-Identifier\s*:\s*([A-Za-z0-9.+()\- ]+)", re.I)
_SPDX_WORD = re.compile(r"[()]|[A-Za-z0-9.+-]+")
#: Ends of sentences: blank lines, and stops before white space that no lower-case letter or digit follows.
_END = re.compile(r"\n\s*\n|[.!?;](?=\s+(?![a-z0-9]))|[.!?;]\s*$|\n(?=[ \t]*(?:[-*\d]|[A-Z]))", re.M)
_NOISE = re.compile(r"[^\w.,:+/]+|(?<!\d)\.|\.(?!\d)|_+")
_LICENCE_WORD = re.compile(r"\blicen[sc]ed (?:under|by|to)\b|\bunder (?:the |a |an )?(?:[\w.]+ ){0,6}licen[sc]e\b|\blicen[sc]e agreement\b")


def normalise(sentence: str) -> str:
    """Lower case; comment marks, quotes, brackets and runs of white space become one blank."""
    return " ".join(_NOISE.sub(" ", sentence.lower()).split()).strip(" ,:")


def _named(identifier: str, m: re.Match) -> str:
    """The licence that a reference names, from the version or variant in its match."""
    groups = [g for g in m.groups() if g]
    if identifier in ("CCRef", "CCNamed"):
        kind = groups[0]
        for long, short in (("attribution", "by"), (r"non ?commercial", "nc"), (r"share ?alike", "sa"), (r"no ?deriv(?:ative)?s", "nd")):
            kind = re.sub(long, short, kind)
        return "-".join(["CC", *kind.upper().split(), *groups[1:]])
    if identifier == "BSDRef":
        return "0BSD" if groups[0] == "0" else f"BSD-{groups[0]}-Clause"
    stem = identifier.removesuffix("Ref")
    if not groups:
        return stem
    return f"{stem}-{groups[0]}" if "." in groups[0] else f"{stem}-{groups[0]}.0"


def spdx_names(expression: str) -> list[str]:
    """The licences of an SPDX expression, an exception with its licence; words after its end are left out."""
    names: list[str] = []
    want = True  # a licence, an opening bracket
    for word in _SPDX_WORD.findall(expression):
        if word in "()":
            continue
        if word.upper() in ("AND", "OR", "WITH"):
            if want:
                break
            want = word.upper()
        elif want == "WITH":
            names[-1] += f" WITH {word}"
            want = False
        elif want:
            names.append(SPDX_NAMES.get(word.lower(), word))
            want = False
        else:
            break
    return names


def _cut(text: str) -> list[str]:
    found, start = [], 0
    for m in _END.finditer(text):
        found.append(text[start : m.start()])
        start = m.end()
    found.append(text[start:])
    return found


def sentences(text: str) -> list[str]:
    """The normalised sentences that hold a legal word, in order."""
    return [plain for f in _cut(text) if _LEGAL.search(plain := normalise(f))]


def _sentence(raw: str) -> list[tuple[str, str]]:
    plain = normalise(raw)
    if not _LEGAL.search(plain):
        return []
    if (m := _SPDX.search(raw)) and (names := spdx_names(m.group(1))):
        return [("SPDX", n) for n in names]
    hits = sorted((m.start(), k, m.group(1) if k == "OfVersion" else _named(k, m) if k in _NAMING else k) for k, p in _PATTERNS.items() if (m := p.search(plain)))
    if (no := _NOT.search(plain)) and any(k in _REFERENCES for _, k, _ in hits):
        return [h[1:] for h in hits if k_before(h, no)]
    if not hits and _LICENCE_WORD.search(plain):
        return [("Unrecognised", "Unrecognised")]
    return [h[1:] for h in hits]


def k_before(hit: tuple[int, str, str], no: re.Match) -> bool:
    """Whether a hit stands: no reference, or one before the "not"."""
    return hit[1] not in _REFERENCES or hit[0] < no.start()


def sentence_ids(text: str) -> list[tuple[str, str]]:
    """(identifier, named licence) of the text's known and unrecognised licence sentences, in order."""
    found: list[tuple[str, str]] = []
    for raw in _cut(text):
        for identifier, name in _sentence(raw):
            if identifier == "OfVersion":
                # Of the GNU licence just named, where that is in the sentence (or line) before.
                at = next((i for i in range(len(found) - 1, -1, -1) if found[i][0] in _GNU), None)
                if at is not None and f"{found[at][1]}Ref" == found[at][0]:
                    found[at] = (found[at][0], f"{found[at][1]}-{name}" if "." in name else f"{found[at][1]}-{name}.0")
            if identifier == "OrLater":
                # It belongs to the GNU licence that was named last, if that has a version.
                at = next((i for i in range(len(found) - 1, -1, -1) if found[i][0] in _GNU and found[i][1][-1].isdigit()), None)
                if at is not None:
                    found[at] = (found[at][0], f"{found[at][1]}-or-later")
            found.append((identifier, name))
    return found


_NAMING = {wanted[0] for name, wanted in RULES if name[0] == "{"}
_REFERENCES = {k for k in SENTENCES if k.endswith(("Ref", "Bare", "Named"))}


def _same_family(bare: str, name: str) -> bool:
    return name != bare and name.startswith(f"{bare}-")


def match_rules(ids: list[tuple[str, str]]) -> list[str]:
    """Licences by the ordered rules, in the order of their first sentence, without repeats.

    A licence without a version goes where the same one is named with a version.
    """
    left = list(enumerate(ids))
    found: list[tuple[int, str]] = []
    for name, wanted in RULES:
        while True:
            used, rest = [], iter(left)
            for w in wanted:
                hit = next((x for x in rest if x[1][0] == w), None)
                if hit is None:
                    break
                used.append(hit)
            if len(used) < len(wanted):
                break
            found.append((used[0][0], used[0][1][1] if name[0] == "{" else name))
            left = [x for x in left if x not in used]
    found.extend((i, "Unrecognised") for i, (k, _) in left if k == "Unrecognised")
    names = list(dict.fromkeys(n for _, n in sorted(found)))
    return [n for n in names if not any(_same_family(n, other) for other in names)]


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with licenses (array<string>, empty if none) and license_sentences (array<string>).

    The whole text is scanned, in one pass without a shuffle. Null and empty texts have none. Rows
    are scanned each for itself; an empty table gives an empty result; input columns with these two
    names are replaced.
    """
    names = [c for c in docs.columns if c not in ("licenses", "license_sentences")]

    @F.arrow_udf("struct<licenses:array<string>,license_sentences:array<string>>")
    def find(text: pa.Array) -> pa.Array:
        rows = []
        for piece in pieces(text):
            for t in as_texts(piece):
                ids = sentence_ids(t)
                rows.append({"licenses": match_rules(ids), "license_sentences": [i for i, _ in ids]})
        kind = pa.list_(pa.string())
        return pa.array(rows, pa.struct([("licenses", kind), ("license_sentences", kind)]))

    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return row.withColumn("_found", find(F.col("_row")["text"])).select(*[F.col("_row")[c].alias(c) for c in names], "_found.*")
