from __future__ import annotations

from sensorloom.llm import licenses

MIT = """Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files, to deal in the Software.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.example.org/licenses/LICENSE-2.0"""
CASES = {
    "Text.\nReleased under the MIT License.": ["MIT"], "junk***\nLicensed under CC BY-NC 4.0.": ["CC-BY-NC-4.0"], MIT: ["MIT"], APACHE: ["Apache-2.0"],
    "This work is licensed under the GNU General Public License, version 3.": ["GPL-3.0"], "This work is licensed under the GNU Lesser General Public License, version 3.": ["LGPL-3.0"],
    "Copyright 2020 X. All rights reserved.": ["All-Rights-Reserved"], "// SPDX-License-Identifier: MIT": ["MIT"],
    "Released under the MIT License. Licensed under the Apache License, Version 2.0.": ["Apache-2.0", "MIT"], "A license to drive.": [],
}


def test_rules(docs):
    texts = [*CASES, "plain text", None, "", "word " * 20_000]
    rows = {r["doc_id"]: r for r in licenses.licences(docs(texts, "extra")).collect()}
    for i, want in enumerate(CASES.values()):
        assert rows[i]["licences"] == want, texts[i]
    assert set(rows) == set(range(len(CASES)))
    assert rows[len(CASES) - 1]["unknown"] == 1


def test_rows_that_repeat_and_no_rows(docs):
    assert licenses.licences(docs([(1, "MIT"), (2, "Released under the MIT License."), (2, "Released under the MIT License."), (None, "All rights reserved.")])).count() == 3
    assert licenses.licences(docs([])).count() == 0


def test_rules_use_known_sentences():
    names = [n for n, _ in licenses.SENTENCES]
    assert len(names) == len(set(names))
    assert {x for _, ids in licenses.RULES for x in ids} <= set(names)


GPL = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License along
with this program; if not, write to the Free Software Foundation, Inc."""
BSD = """Redistribution and use in source and binary forms, with or without modification,
are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation.
{}
This software is provided by the copyright holders and contributors "as is" and no warranty is given."""
ENDORSE = """3. Neither the name of the University nor the names of its contributors
may be used to endorse or promote products derived from this software.
"""
NOTICES = {
    GPL.format(2): ["GPL-2.0"], "Copyright (C) 2001 A\n" + GPL.format(2): ["GPL-2.0"], "// " + GPL.format(3).replace("\n", "\n// "): ["GPL-3.0"],
    GPL.format("2.1").replace("This program", "This library").replace("GNU General", "GNU Lesser General"): ["LGPL"],
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one.": ["MPL-2.0"],
    BSD.format(ENDORSE): ["BSD-3-Clause"], BSD.replace("cation,\nare", "cation, are").format(ENDORSE): ["BSD-3-Clause"], BSD.format(""): ["BSD-2-Clause"],
    "Licensed under the Apache License, Version 2.0; you may not use this\nfile except in compliance with the License.": ["Apache-2.0"],
    "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that it stays.": ["ISC"],
}


def test_standard_notices(docs):
    got = {r["doc_id"]: r["licences"] for r in licenses.licences(docs(list(NOTICES))).collect()}
    assert [got[i] for i in range(len(NOTICES))] == list(NOTICES.values())
