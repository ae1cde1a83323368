"""Licence scans: further standard notices in four wrappings, licences named in sentences, SPDX expressions, and the SQL for the latter."""

import time

import duckdb
import pyarrow as pa
import pytest

from dwellpath.llm import licenses
from tests.conftest import plain
from tests.llm.test_operators import BSD, GPL

LESSER = GPL.replace("program", "library").replace("General", "Lesser General")
NOTICES = {
    "LGPL-2.1": LESSER.format(";", ";", "2.1"),
    "LGPL-3.0": LESSER.format(":", ",", 3),
    "AGPL-3.0": GPL.replace("General", "Affero General").format(":", ",", 3),
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.",
    "Zlib": "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:",
    "EPL-2.0": "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/",
    "EPL-1.0": "All rights reserved. This program and the accompanying materials\nare made available under the terms of the Eclipse Public License v1.0\nwhich accompanies this distribution, and is available at\nhttp://www.eclipse.org/legal/epl-v10.html",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.\n(See accompanying file LICENSE_1_0.txt or copy at\nhttps://www.boost.org/LICENSE_1_0.txt)",
    "BSD-4-Clause": BSD + '\n3. All advertising materials mentioning features or use of this software must\n   display the following acknowledgement:\n   This product includes software developed by Some One.',
    "Artistic-2.0": "This program is free software, you can use it under the terms\nof the Artistic License 2.0.",
}
ALSO = {"EPL-1.0": {"All-Rights-Reserved"}, "BSD-4-Clause": {"All-Rights-Reserved", "BSD-2-Clause"}}
FORMS = [
    lambda t: t,
    lambda t: "/*\n" + "\n".join(f" * {x}".rstrip() for x in t.split("\n")) + "\n */\nint x;",
    lambda t: " ".join(t.split()),
    lambda t: "words before.\n" + t.replace("\n\n", "\n", 1) + "\n\nwords after",
]

SAID = {
    "This project is licensed under the MIT License - see the LICENSE file for details": "MIT",
    "It is licensed under Apache 2.0 and nothing else": "Apache-2.0",
    "All of it is released under the terms of the GNU Lesser General Public License v3, as ever": "LGPL-3.0",
    "Distributed under the BSD 3-Clause License": "BSD-3-Clause",
    "The library is dual licensed under the GNU AGPL v3": "AGPL-3.0",
    "Released under the Unlicense": "Unlicense",
    "licensed under the mitten license": "",
    "We talked under the MIT dome": "",
    "licensed under the GPL 23": "",
}
SPDX = {
    "// SPDX-License-Identifier: MIT": "MIT",
    "# SPDX-License-Identifier: (Apache-2.0 OR MIT) AND BSD-3-Clause": "Apache-2.0,BSD-3-Clause,MIT",
    "/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */": "GPL-2.0",
    "SPDX-License-Identifier: LGPL-2.1-or-later\nSPDX-License-Identifier: EPL-2.0": "EPL-2.0,LGPL-2.1",
    "SPDX-License-Identifier: AGPL-3.0+ AND Unknown-9": "AGPL-3.0",
    "SPDX-License-Identifier:": "",
}


def scanned(spark, texts):
    df = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("form", range(len(FORMS)))
def test_notices_in_four_wrappings(spark, form):
    got = scanned(spark, [FORMS[form](t) for t in NOTICES.values()])
    for k, name in enumerate(NOTICES):
        found = set(got[k]["licenses"].split(","))
        assert name in found and found - {name} <= ALSO.get(name, set()), (name, found, got[k]["sentence_ids"])


def test_named_licences_and_spdx(spark):
    texts = {**SAID, **SPDX, "It is licensed under the terms of the GNU\nGeneral Public License, version 3, by us": "GPL-3.0"}
    got = scanned(spark, texts)
    assert {t: got[k]["licenses"] for k, t in enumerate(texts)} == texts


def test_sql_of_named_licences_and_spdx(spark):
    texts = [*SAID, *SPDX, None, "", "released under the mit license. Licensed under the MIT License! licensed under Apache 2.0; all rights reserved", "SPDX-License-Identifier: MIT mit\nlicensed under the zlib license"]
    documents = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})  # noqa: F841
    df = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert plain(df.collect()) == plain(duckdb.connect().sql(f"SELECT {', '.join(df.columns)} FROM ({licenses.oracle()})").fetchall())


def test_repeated_sentences_count_each_time(spark):
    twice = "Redistributions of source code must retain the above copyright notice\nRedistributions of source code must retain the above copyright notice\n"
    header = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\n'
    got = scanned(spark, [twice, header * 2, "all rights reserved. " * 50_000])
    assert got[0]["n_known"] == 2 and got[1]["sentence_ids"].count("apache-notice") == 2 and got[2]["n_known"] == 50_000


def test_plain_stretches_of_patterns():
    assert licenses._sure(r"(?:a )?b c{0,3} deep x\.y(?:z| w) tail") == " deep x.y" and licenses._sure(r"non ?commercial 4\.0") == "commercial 4.0"
    assert all(len(licenses._sure(p)) > 10 for _, p in licenses.NOTICES)


def test_sentences_of_great_length_take_linear_time():
    words = "word " * 200_000
    texts = ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which " + words, "licensed under " + words, "copyright " + words + "all rights reserved", "licence\n" + "-" * 500_000 + "\n" + " *\n" * 100_000, "free software " + "; : " * 100_000 + "permission"]
    began = time.process_time()
    found = [licenses.identify(t) for t in texts]
    assert time.process_time() - began < 5
    assert found == [["says-EPL-2.0"], [], [], [], []]


def test_marks_inside_a_notice_do_not_end_it():
    text = "is free\n * software; you v. 2.0 Free Software Foundation: either. Then;; free software;; so V. x! end."
    assert [s.strip() for s in licenses.sentences(text)] == ["is free\n * software; you v. 2.0 Free Software Foundation: either", "Then", "free software;", "so V. x", "end", ""]
