import duckdb

from causeway.llm import licenses
from causeway.llm.queries import ORACLE

MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files, to deal in it.\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.'
)


def test_sentences_and_rules(spark, empty):
    texts = [
        "Some prose. Released under the MIT License. More prose.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0.",
        "x\nLicensed under the Apache License, Version 2.0.\ny",
        MIT,
        "# " + MIT.replace("\n", "\n# "),
        "No licence is named; permission was granted.",
        None,
        "",
        "Licensed under the Apache License, Version 2.0. Released under the MIT License. All rights reserved.",
        MIT.split("\n")[0],
    ]
    rows = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = ["MIT", "GPL-3.0", "CC-BY-NC-4.0", "Apache-2.0", "MIT", "MIT", "", "", "", "Apache-2.0,MIT,All-rights-reserved", ""]
    assert [rows[k]["licenses"] for k in range(len(texts))] == want
    assert rows[4]["sentences"] == "mit_grant,mit_notice,mit_asis" and rows[4]["unmatched"] == 0
    assert rows[10]["sentences"] == "mit_grant" and rows[10]["unmatched"] == 1
    assert licenses.scan(empty).collect() == []


LINES = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "All rights reserved.": "All-rights-reserved"}


def test_planted_lines_are_found_and_nothing_else(docs):
    for r in licenses.scan(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert set(filter(None, r["licenses"].split(","))) == {v for k, v in LINES.items() if k in r["text"]} and r["unmatched"] == 0


def test_sql_gives_the_same_rows(spark, docs, odd):
    """DuckDB's own regular expressions and maps, on the documents, made-up notices and odd rows."""
    texts = [f"{a}{b}{c}" for a in ("", "Some prose.\n\n", "# ") for b in (MIT, APACHE, WRAPPED_MIT, GPL, BSD, *NOTICES) for c in ("", "\nAll rights reserved.", "; SPDX-License-Identifier: MIT OR Apache-2.0")]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for frame in (docs.select("doc_id", "text"), made, odd.where("doc_id is not null").select("doc_id", "text").distinct()):
        con = duckdb.connect()
        con.register("documents", frame.toPandas())
        want = con.execute(ORACLE["op9_licenses"]).fetchall()
        assert sorted(map(tuple, licenses.scan(frame).collect())) == sorted(want)


def test_odd_rows(odd):
    assert licenses.scan(odd).count() == odd.count()
    plan = licenses.scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
WRAPPED_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""


def test_wrapped_texts(spark):
    texts, want = [], []
    for text, name in ((APACHE, "Apache-2.0"), (WRAPPED_MIT, "MIT"), (GPL, "GPL-3.0")):
        commented = "/*\n" + "".join(f" * {x}".rstrip() + "\n" for x in text.splitlines()) + " */\nint x;"
        for form in (text, "".join(f"# {x}".rstrip() + "\n" for x in text.splitlines()), commented, text.replace("\n", "\r\n"), "Some prose without an end\n\n" + text + "\nAll rights reserved."):
            texts.append(form)
            want.append(name + (",All-rights-reserved" if form.endswith("reserved.") else ""))
    texts.append("a title\nReleased under the MIT License\nmore prose")
    want.append("MIT")
    texts.append(APACHE.replace("\n", " "))
    want.append("Apache-2.0")
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k]["licenses"] for k in range(len(texts))] == want
    assert {got[k]["unmatched"] for k in range(len(texts) - 1)} == {0}


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this
   list of conditions and the following disclaimer in the documentation.

3. Neither the name of the Example Foundation nor the names of its
   contributors may be used to endorse or promote products.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.
"""
NOTICES = {
    BSD: "BSD-3-Clause",
    BSD.replace(BSD[BSD.index("3. ") : BSD.index("THIS")], ""): "BSD-2-Clause",
    BSD.replace("3. Neither", "3. All advertising materials mentioning features or use of this software\nmust display the following acknowledgement.\n\n4. Neither"): "BSD-4-Clause",
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.": "MPL-2.0",
    "The contents of this file are subject to the Mozilla Public License Version\n1.1 (the \"License\"); you may not use it.": "MPL-1.1",
    GPL.replace("General Public", "Lesser General Public").replace("program", "library").replace("version 3", "version 2.1"): "LGPL-2.1",
    GPL.replace("General Public", "Affero General Public"): "AGPL-3.0",
    GPL.replace("version 3", "version 2"): "GPL-2.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "CC-BY-NC-SA-4.0",
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software.": "Unlicense",
    "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "/* SPDX-License-Identifier: GPL-2.0-only */": "GPL-2.0",
    "SPDX-License-Identifier: MIT OR Apache-2.0": "MIT,Apache-2.0",
    "SPDX-License-Identifier: EPL-2.0": "EPL-2.0",
    "SPDX-License-Identifier: 0BSD": "0BSD",
    "Licensed under the MIT License (see LICENSE).": "MIT",
    "Licensed under the MIT license. See LICENSE in the project root.": "MIT",
    "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is available at the site.": "EPL-2.0",
    "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.": "OFL-1.1",
    "Licensed under the EUPL, version 1.2 or later.": "EUPL-1.2",
    "Released under CC0 1.0 Universal.": "CC0-1.0",
    "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the notice appears in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.": "ISC",
    "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.": "0BSD",
    "This software is provided 'as-is', without any express or implied warranty.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications.": "Zlib",
    "This software is released under the GNU GPLv3.": "GPL-3.0",
    "This code is available under the GNU Lesser General Public License v3.0 or later.": "LGPL-3.0",
    "The software was licensed to them in May.": "",
    "He asked permission to use the road.": "",
}


def test_notices_of_many_licences(spark):
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(spark.createDataFrame(list(enumerate(NOTICES)), "doc_id long, text string")).collect()}
    assert {t: got[k] for k, t in enumerate(NOTICES)} == NOTICES
    assert len(licenses.NAMES) >= 25 and set(licenses.SINGLE.values()) >= set(licenses.NAMES)
