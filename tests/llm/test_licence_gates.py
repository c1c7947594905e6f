"""Every match of a licence rule holds the rule's keyword and a gate word."""

from matchgrid.llm import licence_rules, licence_scan

WORDS = ("licensed", "released", "distributed", "available", "licence", "license")


def test_each_alternative_of_a_short_name_holds_its_keyword():
    short = [r for r in zip(licence_rules.rules(), licence_rules.keywords(), strict=True) if r[0][1] == 3]
    names = [n for *_, names in licence_rules.LICENCES for n in names]
    assert len(short) == len(names)
    for (*_, pattern), keyword, name in ((r, k, n) for (r, k), n in zip(short, names, strict=True)):
        assert keyword in name and pattern.replace("[.]", ".").endswith(name + r"\b")
    for w in WORDS:
        assert any(g in w for g in licence_rules.GATES)


def test_short_names_without_the_word_licence(spark):
    texts = ["Released under GPLv3", "distributed under MPL-2.0.", "It is available under the CC0", "Distributed as apache 2.0", "licensed under gplv3", "limited release, mitigated"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licence_scan.scan(d).collect()}
    assert got == {0: "gpl-3", 1: "mpl-2", 2: "cc0", 3: "apache-2", 4: "gpl-3", 5: ""}


def test_texts_of_licences_without_their_names(spark):
    texts = [
        # 0: MIT as a comment block
        "/*\n * Permission is hereby granted, free of charge, to any person obtaining a copy\n * The above copyright notice and this permission\n * notice shall be included in all\n"
        " * copies or substantial portions of the Software.\n */",
        # 1, 2: the BSD body, with and without the third clause
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that",
        "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that\n# Neither the name of the Foo Org\n# nor the names of its"
        " contributors may be used to endorse or\n# promote products derived from this software without",
        # 3, 4: ISC and its form without a condition
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above",
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED AS IS",
        # 5, 6: notices of the GNU family
        "under the terms of the GNU General Public License as published by\n the Free Software Foundation; either version 2 of the License, or",
        "the GNU Affero General Public License as published by the Free Software Foundation, either version 3",
        # 7: Mozilla, 8: Apache, 9: zlib
        "This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy",
        "each Contributor hereby grants to You a perpetual,\n worldwide, non-exclusive, no-charge, royalty-free, irrevocable\n copyright license to reproduce",
        "Altered source versions must be plainly marked as such, and must not be\n misrepresented as being the original software.",
        # 10: words of the passages alone
        "permission was granted for redistribution; they endorse the advertising, hereby misrepresented",
    ]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licence_scan.scan(d).collect()}
    want = ["mit", "bsd", "bsd,bsd-3", "isc", "0bsd", "gpl-2", "agpl-3", "mpl-2", "apache-2", "zlib", ""]
    assert got == dict(enumerate(want))


def test_every_text_holds_its_keyword_and_a_gate():
    words = dict(zip([r[4] for r in licence_rules.rules()], licence_rules.keywords(), strict=True))
    for _, passage in licence_rules.TEXTS:
        keyword = words[rf"\b{licence_rules._breakable(passage)}\b"]
        assert len(keyword) > 4 and keyword in passage and any(g in passage for g in licence_rules.GATES), passage
