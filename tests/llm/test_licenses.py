"""Licenses in texts that are wrapped."""

import textwrap

from docweave.llm import licenses

MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
    1. Redistributions of source code must retain the above copyright notice,
       this list of conditions and the following disclaimer.
    2. Redistributions in binary form must reproduce the above copyright notice,
       this list of conditions and the following disclaimer in the documentation
       and/or other materials provided with the distribution.
"""
ENDORSE = """    3. Neither the name of the copyright holder nor the names of its contributors
       may be used to endorse or promote products derived from this software
       without specific prior written permission.
"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
"""

APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
GRANT = """   2. Grant of Copyright License. Subject to the terms and conditions of
      this License, each Contributor hereby grants to You a perpetual,
      worldwide, non-exclusive, no-charge, royalty-free, irrevocable
      copyright license to reproduce, prepare Derivative Works of,
      publicly display, publicly perform, sublicense, and distribute the
      Work and such Derivative Works in Source or Object form.
"""
LGPL = """   This library is free software; you can redistribute it and/or
   modify it under the terms of the GNU Lesser General Public
   License as published by the Free Software Foundation; either
   version 2.1 of the License, or (at your option) any later version.
"""
ISC = """Copyright (c) 2020, Somebody

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this file.
"""
MORE = {
    APACHE: "Apache-2.0,Apache-2.0-header", GRANT: "Apache-2.0-text", LGPL: "LGPL-2.1-or-later", LGPL.replace("Lesser ", "").replace("2.1", "2").replace("library", "program"): "GPL-2.0-or-later",
    GPL.replace("GNU General", "GNU Affero General"): "AGPL-3.0-or-later", GPL.replace("GNU General", "GNU Lesser General"): "LGPL-3.0-or-later", ISC: "ISC",
    ISC.replace(", provided that the above\ncopyright notice and this permission notice appear in all copies", ""): "0BSD", MPL: "MPL-2.0",
    "This is free and unencumbered software\nreleased into the public domain.\n": "Unlicense",
}


def test_more_texts_and_their_sql(spark, tmp_path):
    import duckdb

    texts = [*MORE, *(textwrap.indent(t, "// ") for t in MORE), None, "", *(a + "\n" + b for a, b in zip(MORE, reversed(MORE)))]
    docs = spark.createDataFrame(list(enumerate([*texts, MIT, BSD, "x. " + GPL + GPL])), "doc_id long, text string")
    got = sorted(map(tuple, licenses.license_scan(docs).collect()))
    assert [r[3] for r in got[: 2 * len(MORE) + 2]] == [*MORE.values(), *MORE.values(), "", ""]
    documents = docs.toPandas()  # noqa: F841
    assert got == sorted(duckdb.sql(licenses.OP8_SQL).fetchall())


def test_rules_from_tables(spark):
    sentences = spark.createDataFrame([("Use it as you LIKE.", "own"), ("Not for sale!", "sale"), ("...", "none")], "sentence string, id string")
    rules = spark.createDataFrame([("Own", True, ["own", "sale"])], "name string, restricted boolean, ids array<string>")
    docs = spark.createDataFrame([(1, "Use it as\nyou like. Not for sale."), (2, "Not for sale. Use it as you like."), (3, MIT)], "doc_id long, text string")
    got = licenses.license_scan(docs, *licenses.load(sentences, rules)).orderBy("doc_id").collect()
    assert [(r["licenses"], r["n_sentences"], r["restricted"]) for r in got] == [("Own", 2, True), ("", 2, False), ("", 0, False)]


def test_wrapped_texts(spark):
    split = "All rights\n\nreserved"
    texts = [MIT, MIT.replace("\n", "\r\n"), textwrap.indent(MIT, " * ", lambda line: True), BSD, BSD + ENDORSE, GPL, "Released under\nthe MIT License\nAll rights reserved", split, "not all rights reserved"]
    got = licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r["licenses"] for r in sorted(got)] == ["MIT-text", "MIT-text", "MIT-text", "BSD-2-Clause", "BSD-2-Clause,BSD-3-Clause", "GPL-3.0-or-later", "MIT,Proprietary", "", ""]
