"""The signature table of the licence scan: hand-written patterns over lower-case text, in order of precedence.

A licence has a label, identifiers for machine-readable tags, patterns for its full name or notice, parts of web addresses,
and short names that count only next to a licensing word. Passages of licence texts follow the names. Every rule has a keyword that must occur in a text before its
pattern is tried. Patterns use only what all common regular-expression engines read alike.
"""

from __future__ import annotations

#: White space or a line break with comment marks.
S = r"[ \t\r\n*#/]+"
V = r"[ ,]*(?:version|ver|v)?[ .]*"

#: label, tag identifiers, names, addresses, short names.
LICENCES: list[tuple[str, list[str], list[str], list[str], list[str]]] = [
    ("0bsd", ["0bsd"], ["bsd zero clause license", "zero[- ]clause bsd license"], ["opensource.org/licenses/0bsd"], ["0bsd"]),
    ("afl-3", ["afl-3.0"], [f"academic free license{V}3"], ["opensource.org/licenses/afl-3"], ["afl 3.0"]),
    ("agpl-3", ["agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later"], [f"affero general public license{V}3", "gnu affero general public license"], ["gnu.org/licenses/agpl"], ["agpl", "agplv3"]),
    ("apache-1", ["apache-1.1", "apache-1.0"], [f"apache software license{V}1"], ["apache.org/licenses/license-1"], ["apache 1.1"]),
    ("apache-2", ["apache-2.0"], [f"apache license{V}2(?:[.]0)?", "licensed under the apache license", f"apache software license{V}2"], ["apache.org/licenses/license-2"], ["apache 2.0", "apache-2.0", "apache 2"]),
    ("artistic-1", ["artistic-1.0"], [f"artistic license{V}1"], ["opensource.org/licenses/artistic-1"], ["artistic 1.0"]),
    ("artistic-2", ["artistic-2.0"], [f"artistic license{V}2"], ["opensource.org/licenses/artistic-2", "perlfoundation.org/artistic_license"], ["artistic 2.0"]),
    ("blueoak-1", ["blueoak-1.0.0"], ["blue oak model license"], ["blueoakcouncil.org/license"], ["blueoak"]),
    ("bsd-2", ["bsd-2-clause"], ["bsd 2[- ]clause", "simplified bsd license", "two[- ]clause bsd"], ["opensource.org/licenses/bsd-2"], ["freebsd", "bsd-2"]),
    ("bsd-3", ["bsd-3-clause"], ["bsd 3[- ]clause", "(?:new|revised|modified) bsd license", "three[- ]clause bsd"], ["opensource.org/licenses/bsd-3"], ["bsd-3"]),
    ("bsd-4", ["bsd-4-clause"], ["bsd 4[- ]clause", "original bsd license", "four[- ]clause bsd"], ["directory.fsf.org/wiki/license:bsd-4"], ["bsd-4"]),
    ("bsl-1", ["bsl-1.0"], [f"boost software license{V}1"], ["boost.org/license_1_0", "opensource.org/licenses/bsl-1"], ["boost"]),
    ("busl-1", ["busl-1.1"], [f"business source license{V}1"], ["mariadb.com/bsl11"], ["busl"]),
    ("cc-by", ["cc-by-4.0", "cc-by-3.0", "cc-by-2.5", "cc-by-2.0"], [f"creative commons attribution{V}[1-4][.][05]", "creative commons attribution(?: license| international| generic| unported)"], ["creativecommons.org/licenses/by/"], ["cc by", "cc-by"]),
    ("cc-by-nc", ["cc-by-nc-4.0", "cc-by-nc-3.0"], ["creative commons attribution[- ]non-?commercial(?: license|[ ,]+[1-4])", "cc[- ]by[- ]nc(?:[- ][1-4][.][05])?"], ["creativecommons.org/licenses/by-nc/"], ["cc by-nc", "cc-by-nc"]),
    ("cc-by-nc-nd", ["cc-by-nc-nd-4.0", "cc-by-nc-nd-3.0"], ["creative commons attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s", "cc[- ]by[- ]nc[- ]nd"], ["creativecommons.org/licenses/by-nc-nd/"], ["cc by-nc-nd"]),
    ("cc-by-nc-sa", ["cc-by-nc-sa-4.0", "cc-by-nc-sa-3.0"], ["creative commons attribution[- ]non-?commercial[- ]share-?alike", "cc[- ]by[- ]nc[- ]sa"], ["creativecommons.org/licenses/by-nc-sa/"], ["cc by-nc-sa"]),
    ("cc-by-nd", ["cc-by-nd-4.0", "cc-by-nd-3.0"], ["creative commons attribution[- ]no-?deriv(?:ative)?s", "cc[- ]by[- ]nd"], ["creativecommons.org/licenses/by-nd/"], ["cc by-nd"]),
    ("cc-by-sa", ["cc-by-sa-4.0", "cc-by-sa-3.0"], ["creative commons attribution[- ]share-?alike", "cc[- ]by[- ]sa"], ["creativecommons.org/licenses/by-sa/"], ["cc by-sa"]),
    ("cc0", ["cc0-1.0"], ["creative commons zero", "cc0 1[.]0 universal"], ["creativecommons.org/publicdomain/zero"], ["cc0"]),
    ("cddl-1", ["cddl-1.0", "cddl-1.1"], ["common development and distribution license"], ["opensource.org/licenses/cddl"], ["cddl"]),
    ("cecill-2", ["cecill-2.0", "cecill-2.1"], ["cecill free software license"], ["cecill.info/licences"], ["cecill"]),
    ("cpl-1", ["cpl-1.0"], [f"common public license{V}1"], ["opensource.org/licenses/cpl1"], ["cpl"]),
    ("ecl-2", ["ecl-2.0"], [f"educational community license{V}2"], ["opensource.org/licenses/ecl-2"], ["ecl 2.0"]),
    ("epl-1", ["epl-1.0"], [f"eclipse public license{V}1"], ["eclipse.org/legal/epl-v10"], ["epl 1.0", "epl-1.0"]),
    ("epl-2", ["epl-2.0"], [f"eclipse public license{V}2"], ["eclipse.org/legal/epl-2", "eclipse.org/legal/epl-v20"], ["epl 2.0", "epl-2.0"]),
    ("eupl-1", ["eupl-1.1", "eupl-1.2"], ["european union public licen[cs]e"], ["joinup.ec.europa.eu/software/page/eupl"], ["eupl"]),
    ("gfdl-1", ["gfdl-1.3", "gfdl-1.2", "gfdl-1.1"], ["gnu free documentation license"], ["gnu.org/licenses/fdl", "gnu.org/copyleft/fdl"], ["gfdl"]),
    ("gpl-1", ["gpl-1.0", "gpl-1.0-only", "gpl-1.0-or-later"], [f"(?:gnu )?general public license{V}1"], ["gnu.org/licenses/gpl-1"], ["gplv1"]),
    ("gpl-2", ["gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later"], [f"(?:gnu )?general public license{V}2"], ["gnu.org/licenses/gpl-2", "gnu.org/licenses/old-licenses/gpl-2"], ["gplv2", "gpl v2", "gpl-2"]),
    ("gpl-3", ["gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later"], [f"(?:gnu )?general public license{V}3"], ["gnu.org/licenses/gpl-3"], ["gplv3", "gpl v3", "gpl-3"]),
    ("gpl", [], ["gnu general public license", "gnu gpl license"], ["gnu.org/licenses/gpl.", "gnu.org/copyleft/gpl"], ["gpl", "gnu gpl"]),
    ("isc", ["isc"], ["isc license", "internet systems consortium license"], ["opensource.org/licenses/isc"], ["isc"]),
    ("lgpl-2", ["lgpl-2.0", "lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later"], [f"(?:lesser|library) general public license{V}2"], ["gnu.org/licenses/lgpl-2", "gnu.org/licenses/old-licenses/lgpl-2"], ["lgplv2", "lgpl 2.1"]),
    ("lgpl-3", ["lgpl-3.0", "lgpl-3.0-only", "lgpl-3.0-or-later"], [f"lesser general public license{V}3"], ["gnu.org/licenses/lgpl-3"], ["lgplv3", "lgpl 3"]),
    ("lgpl", [], ["gnu (?:lesser|library) general public license"], ["gnu.org/licenses/lgpl."], ["lgpl"]),
    ("lppl-1", ["lppl-1.3c", "lppl-1.0"], ["latex project public license"], ["latex-project.org/lppl"], ["lppl"]),
    ("mit", ["mit"], ["(?:the )?mit license", "mit/x11 license", "expat license"], ["opensource.org/licenses/mit", "mit-license.org"], ["mit", "expat"]),
    ("mit-0", ["mit-0"], ["mit no attribution license", "mit[- ]0 license"], ["opensource.org/licenses/mit-0"], ["mit-0"]),
    ("mpl-1", ["mpl-1.1", "mpl-1.0"], [f"mozilla public license{V}1"], ["mozilla.org/mpl/1", "mozilla.org/mpl/mpl-1"], ["mpl 1.1"]),
    ("mpl-2", ["mpl-2.0"], [f"mozilla public license{V}2"], ["mozilla.org/mpl/2", "mozilla.org/en-us/mpl/2"], ["mpl 2.0", "mpl-2.0", "mplv2"]),
    ("ms-pl", ["ms-pl"], ["microsoft public license"], ["opensource.org/licenses/ms-pl"], ["ms-pl"]),
    ("ms-rl", ["ms-rl"], ["microsoft reciprocal license"], ["opensource.org/licenses/ms-rl"], ["ms-rl"]),
    ("ncsa", ["ncsa"], ["university of illinois/ncsa open source license"], ["opensource.org/licenses/ncsa"], ["ncsa"]),
    ("odbl-1", ["odbl-1.0"], ["open (?:data commons open )?database license"], ["opendatacommons.org/licenses/odbl"], ["odbl"]),
    ("ofl-1", ["ofl-1.1", "ofl-1.0"], [f"sil open font license{V}1"], ["scripts.sil.org/ofl", "openfontlicense.org"], ["ofl"]),
    ("ogl-3", ["ogl-uk-3.0"], ["open government licen[cs]e"], ["nationalarchives.gov.uk/doc/open-government-licence"], ["ogl"]),
    ("osl-3", ["osl-3.0"], [f"open software license{V}3"], ["opensource.org/licenses/osl-3"], ["osl 3.0"]),
    ("pddl-1", ["pddl-1.0"], ["public domain dedication (?:and|&) license"], ["opendatacommons.org/licenses/pddl"], ["pddl"]),
    ("php-3", ["php-3.01", "php-3.0"], [f"php license{V}3"], ["php.net/license/3"], ["php license"]),
    ("postgresql", ["postgresql"], ["postgresql licen[cs]e"], ["opensource.org/licenses/postgresql"], ["postgresql"]),
    ("psf-2", ["psf-2.0", "python-2.0"], ["python software foundation license", "psf license agreement"], ["docs.python.org/license", "opensource.org/licenses/python-2"], ["psf"]),
    ("public-domain", [], [f"(?:released|placed|dedicated){S}(?:in|to|into){S}the{S}public domain", "public domain dedication"], ["creativecommons.org/publicdomain/mark"], ["public domain"]),
    ("ruby", ["ruby"], ["ruby licen[cs]e"], ["ruby-lang.org/en/about/license"], ["ruby"]),
    ("sspl-1", ["sspl-1.0"], ["server side public license"], ["mongodb.com/licensing/server-side-public-license"], ["sspl"]),
    ("unlicense", ["unlicense"], ["the unlicense", "free and unencumbered software released"], ["unlicense.org"], ["unlicense"]),
    ("upl-1", ["upl-1.0"], ["universal permissive license"], ["opensource.org/licenses/upl"], ["upl"]),
    ("w3c", ["w3c"], ["w3c software (?:notice and license|license)"], ["w3.org/consortium/legal"], ["w3c"]),
    ("wtfpl", ["wtfpl"], ["do what the f[u*]ck you want to public license"], ["wtfpl.net"], ["wtfpl"]),
    ("zlib", ["zlib"], ["zlib license", "zlib/libpng license"], ["opensource.org/licenses/zlib", "zlib.net/zlib_license"], ["zlib"]),
    ("zpl-2", ["zpl-2.1", "zpl-2.0"], [f"zope public license{V}2"], ["opensource.org/licenses/zpl"], ["zpl"]),
    ("proprietary", [], [f"all rights reserved[.,; ]{{0,3}}{S}?proprietary", f"proprietary{S}and{S}confidential", "this software is licensed, not sold"], [], ["a proprietary", "a commercial"]),
]

_GNU = "as published by the free software foundation[,;]? (?:either )?version"
#: Label and a passage of the licence's own text or of its standard notice, which need not name the licence.
TEXTS: list[tuple[str, str]] = [
    ("0bsd", "for any purpose with or without fee is hereby granted[.] the software is provided"),
    ("agpl-3", f"gnu affero general public license {_GNU} 3"),
    ("agpl-3", "the gnu affero general public license is a free, copyleft license for software"),
    ("apache-2", "each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license"),
    ("bsd", "redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd-3", "neither the name of [^.]{1,200} may be used to endorse or promote products derived from this software"),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsl-1", "any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("cc-by", "bound by the terms and conditions of this creative commons attribution [1-4][.]0 international public license"),
    ("cc-by-nc", "bound by the terms and conditions of this creative commons attribution-noncommercial [1-4][.]0 international public license"),
    ("cc-by-sa", "bound by the terms and conditions of this creative commons attribution-sharealike [1-4][.]0 international public license"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("gpl-2", f"gnu general public license {_GNU} 2"),
    ("gpl-2", "the licenses for most software are designed to take away your freedom to share and change it[.] by contrast, the gnu general public license"),
    ("gpl-3", f"gnu general public license {_GNU} 3"),
    ("gpl-3", "the gnu general public license is a free, copyleft license for software"),
    ("isc", "permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that"),
    ("lgpl-2", f"gnu (?:lesser|library) general public license {_GNU} 2"),
    ("lgpl-3", f"gnu lesser general public license {_GNU} 3"),
    ("lgpl-3", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("mit", "the above copyright notice and this permission notice (?:[(]including the next paragraph[)] )?shall be included in all copies or substantial portions of the software"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license, v[.] 2[.]0"),
    ("ofl-1", "this license becomes null and void if any of the above conditions are not met"),
    ("zlib", "altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"),
]

#: Confidence by priority: tag, name or passage of the text, address, short name next to a licensing word.
CONFIDENCE = (1.0, 0.95, 0.9, 0.7)
#: A text without any of these words, and without ``cc`` before ``by``, has no finding: every match holds one of them.
GATES = ("licen", "released", "distributed", "available", "spdx", "domain", "commons", "cc0", "clause", "bsd", "w3c", "proprietary", "unencumbered", "hereby", "redistribution", "permission", "endorse", "advertising", "misrepresented", ".org", ".net", ".com", ".gov", ".eu/")


def _plain(text: str) -> str:
    return text.replace(".", "[.]")


def _keyword(pattern: str) -> str:
    """The longest stretch of a name pattern that any match must hold."""
    best, run, depth = "", "", 0
    for i, ch in enumerate(pattern + "("):
        nxt = pattern[i + 1 : i + 2]
        if ch in "([":
            depth += 1
        if depth == 0 and (ch.isalnum() or ch == "/") and nxt not in ("?", "*", "{"):
            run += ch
            continue
        best, run = max(best, run, key=len), ""
        if ch in ")]":
            depth -= 1
    return best.strip()


def _breakable(pattern: str) -> str:
    """The pattern with every space outside a character class as white space or a line break."""
    out, inside = "", False
    for ch in pattern:
        inside = ch == "[" or (inside and ch != "]")
        out += S if ch == " " and not inside else ch
    return out


def rules() -> list[tuple[int, int, str, str, str]]:
    """``rule, priority, label, keyword, pattern``, the best first."""
    out: list[tuple[int, str, str, str]] = []
    for label, tags, _, _, _ in LICENCES:
        out += [(0, label, "spdx", rf"spdx-license-identifier:[ \t]*{_plain(t)}\b") for t in tags]
    for label, _, names, _, _ in LICENCES:
        out += [(1, label, _keyword(n), rf"\b{_breakable(n)}\b") for n in names]
    out += [(1, label, _keyword(x), rf"\b{_breakable(x)}\b") for label, x in TEXTS]
    for label, _, _, urls, _ in LICENCES:
        out += [(2, label, u, rf"(?:https?://)?(?:www[.])?{_plain(u)}[a-z0-9/._-]*") for u in urls]
    for label, _, _, _, short in LICENCES:
        out += [(3, label, "licen", rf"\b(?:licensed|released|distributed|available|licence|license){S}(?:under|as|is|:)?{S}?(?:the |a )?{_plain(n)}\b") for n in short]
    return [(i, *r) for i, r in enumerate(out)]


def keywords() -> list[str]:
    """Per rule a word that each of its matches holds. For a short name it is the longest word of the name itself:
    'released under x' need not hold the 'licen' of the table, which only the SQL still asks for."""
    own = [max(n.split(), key=len) for *_, short in LICENCES for n in short]
    return [k for _, p, _, k, _ in rules() if p < 3] + own
