"""Licence sentences and rules on texts as they are met."""

import re

import pytest

from marketloom.llm import licences

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
GPL = """This program is free software: you can redistribute it and/or modify it
under the terms of the GNU General Public License as published by the Free
Software Foundation, either version 3 of the License, or (at your option) any
later version."""
CASES = [
    ("Prose here.\nReleased under the MIT License.", "MIT"),
    ("Prose without a stop\nLicensed under CC BY-NC 4.0.\nmore prose", "CC-BY-NC-4.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("LICENSED UNDER THE APACHE LICENSE, VERSION 2.0.", "Apache-2.0"),
    (APACHE, "Apache-2.0"),
    (GPL, "GPL-3.0-or-later"),
    ("SPDX-License-Identifier: BSD-3-Clause\n", "BSD-3-Clause"),
    ("Released under the MIT License. Licensed under the Apache License, Version 2.0.", "Apache-2.0,MIT"),
    ("Licensed under a license of our own.", ""),
    ("We released the mit license plate.", ""),
    ("", ""),
    (None, ""),
    ("words " * 100_000 + ". Released under the MIT License.", "MIT"),
]


def test_cases(spark):
    rows = [(i, t, "x") for i, (t, _) in enumerate(CASES)] + [(None, CASES[0][0], None), (0, CASES[0][0], "y")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, licences string")
    got = licences.scan(frame).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.licences == CASES[r.doc_id or 0][1], CASES[r.doc_id or 0][0]
    assert licences.scan(frame.limit(0)).count() == 0


def test_longer_rules_come_first(spark):
    number = re.sub(r"^\d\. ", "", BSD, flags=re.M)
    names = number + """Neither the name of the copyright holder nor the names of its contributors may be used to endorse
or promote products derived from this software without specific prior written permission."""
    frame = spark.createDataFrame([(1, number), (2, names), (3, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:")], "doc_id bigint, text string")
    assert {r.doc_id: r.licences for r in licences.scan(frame).collect()} == {1: "BSD-2-Clause", 2: "BSD-3-Clause", 3: "BSD-style"}


def test_every_known_sentence_has_a_cue_and_a_rule():
    used = {s for rule, _ in licences.RULES for s in rule}
    for sentence, key in licences.known_sentences().items():
        assert re.search(licences.CUE, sentence), sentence
        assert key in used or key in ("mitNotice", "mitAsIs", "bsdSource", "bsdBinary", "bsdNames", "apacheComply", "gplFree")


@pytest.mark.parametrize("key", licences.NAMES)
def test_notices_of_each_name(key):
    assert licences.known_sentences()[f"licensed under the {licences.NAMES[key][0]}"] == f"named:{key}"


MIT = """MIT License
{gap}Copyright (c) 2020 Jane Doe
{gap}Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE.
"""
ISC = """ISC License

Copyright (c) 2020, Jane Doe
Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
NAMES_CLAUSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
COMMENT = "".join(f" * {line}\n" if line else " *\n" for line in ISC.splitlines())
PUBLISHED = [
    (MIT.format(gap="\n"), "MIT", "mitGrant mitNotice mitAsIs"),
    (MIT.format(gap=""), "MIT", "mitGrant"),
    (ISC, "ISC", "iscGrant"),
    (f"/*\n{COMMENT} */", "ISC", "iscGrant"),
    (f"Copyright (c) 2020, Jane Doe\nAll rights reserved.\n\n{re.sub(r'^[12][.] ', '', BSD, flags=re.M)}", "BSD-2-Clause", "bsdGrant bsdSource bsdBinary"),
    (f"BSD 3-Clause License\n\nCopyright (c) 2020, Jane Doe\n\n{re.sub(r'^[123][.] ', '', BSD + NAMES_CLAUSE, flags=re.M)}", "BSD-3-Clause", "bsdGrant bsdNames"),
    (MPL, "MPL-2.0", "mplForm"),
    (APACHE, "Apache-2.0", "apacheGrant apacheComply"),
    (GPL, "GPL-3.0-or-later", "gplFree gplModify3"),
    (GPL.replace("version 3", "version 2"), "GPL-2.0-or-later", "gplModify2"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense", "publicDomain"),
    ("It is\n\nThis program is free\nsoftware: you can redistribute it", "", "gplFree"),
]


def test_published_forms(spark):
    frame = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(PUBLISHED)], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in licences.scan(frame).collect()}
    for i, (text, licence, sentences) in enumerate(PUBLISHED):
        assert rows[i].licences == licence, (text, rows[i])
        assert set(sentences.split()) <= set(rows[i].sentences.split(",")), (text, rows[i])
    assert set(licences.SENTENCES) <= {s for r in rows.values() for s in r.sentences.split(",")}
