import pytest

from casegate.llm import licenses
from casegate.llm.queries import SQL, op7_licenses
from tests.llm.helpers import SF, clashing, documents
from tests.oracle_check import compare, database

MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in it:

The above copyright notice and this permission notice shall be included in all copies or substantial portions.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that:
1. Redistributions of source code must retain the above copyright notice.
2. Redistributions in binary form must reproduce the above copyright notice.
3. Neither the name of X nor of its contributors may be used to endorse or promote products derived from this software.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"."""
CASES = [
    (MIT, "MIT", 0), (BSD, "BSD-3-Clause", 0), ("\n".join(x for x in BSD.split("\n") if "Neither" not in x), "BSD-2-Clause", 0),
    ("Text. Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0", 0), ("Licensed under the Apache License, Version 2.0.", "Apache-2.0", 0),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0", 0), ("Released under the MIT License.", "MIT", 0),
    ("SPDX-License-Identifier: MIT", "MIT", 0), ("// SPDX-License-Identifier:MIT\ncode", "MIT", 0), ("All rights reserved!", "proprietary", 0),
    ("A licence of some kind. Another license text.", "", 2), ("nothing to see", "", 0), ("", "", 0), (None, "", 0),
    ("Released under the MIT License.\n" * 3 + MIT, "MIT", 0), ("licensed under the apache license version 2 0 " * 20_000, "Apache-2.0", 0),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file", "MPL-2.0", 0),
    ("Texts are released under Creative Commons Attribution 4.0 International", "CC-BY-4.0", 0),
    ("under Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "CC-BY-NC-SA-4.0", 0),
    ("SPDX-License-Identifier:AGPL-3.0-only", "AGPL-3.0", 0), ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1", 0),
    ("SPDX-License-Identifier: ISC", "ISC", 0), ("SPDX-License-Identifier: CC-BY-SA-4.0", "CC-BY-SA-4.0", 0), ("SPDX-License-Identifier: EPL-2.0", "EPL-2.0", 0),
    ("SPDX-License-Identifier: (MIT OR Apache-2.0)", "MIT,Apache-2.0", 0),
    ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 AND BSD-3-Clause", "GPL-2.0,BSD-3-Clause", 0),
    ("This may not be used under the MIT License.", "", 1), ("It is not licensed under the Apache License, Version 2.0", "", 1),
    ("Licensed under the MIT License\nLicensed under the Apache License, Version 2.0\nmore text", "Apache-2.0,MIT", 0),
    ("Lines of\nprose are released\nunder the MIT\nLicense by us\n\nand then All rights\nreserved", "MIT,proprietary", 0),
    (" " * 100_000 + "*" * 100_000 + "\n" + "-" * 100_000 + " copyright", "", 1),
    ("É… « copyright » ßÜ; CC0 1.0", "CC0-1.0", 1),
]


def test_known_texts(spark):
    rows = [(i, text) for i, (text, _, _) in enumerate(CASES)]
    docs = clashing(documents(spark, rows + [(None, "x"), (0, MIT)]), "id", "ids", "s", "i", "licenses")
    got = licenses.scan(docs, docs["doc_id"], docs["text"]).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        _, wanted, unknown = CASES[r.id] if r.id is not None else ("", "", 0)
        assert (r.licenses, r.n_unknown) == (wanted, unknown), r
    assert licenses.scan(docs.limit(0), docs["doc_id"], docs["text"]).count() == 0


GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
BSD_GRANT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the documentation.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS
IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""


@pytest.mark.parametrize("mark", [("", "", ""), ("/*\n", " * ", "\n */"), ("", "# ", ""), ("", "// ", ""), ("<!--\n", "  ", "\n-->"), ("", ";; ", "")])
def test_wrapped_headers(spark, mark):
    begin, each, end = mark
    cases = [(GPL, "GPLRef3", "GPL-3.0"), (BSD_GRANT, "BSDGrant,BSDSource,BSDBinary,BSDWarranty", "BSD-2-Clause"), (ISC, "ISCGrant", "ISC")]
    cases += [("SPDX-License-Identifier: MIT", "SpdxMIT", "MIT"), ("Copyright 2020 X\nSPDX-License-Identifier: GPL-2.0-only\ncode", "Copyright,SpdxGPL2", "GPL-2.0")]
    texts = [begin + "\n".join((each + line).rstrip() for line in text.split("\n")) + end for text, _, _ in cases]
    rows = list(enumerate([*texts, *(t.replace("\n", "\r\n") for t in texts)]))
    docs = documents(spark, [*rows, (None, None)])
    got = {r.id: r for r in licenses.scan(docs, docs["doc_id"], docs["text"]).collect()}
    assert (got[None].licenses, got[None].n_unknown) == ("", 0)
    for i, _ in rows:
        _, ids, wanted = cases[i % len(cases)]
        assert ([x for x in got[i].sentence_ids.split(",") if x != "Unknown"], got[i].licenses) == (ids.split(","), wanted), rows[i]


def test_query_matches_sql(spark):
    status, ours, theirs = compare(spark, database(SF), SF, op7_licenses, SQL["op7_licenses"])
    assert status == "ok", [x for x in ours[3] if x not in set(theirs[3])][:3]


def test_sql_on_the_known_texts(spark, tmp_path):
    rows = [(i, text) for i, (text, _, _) in enumerate(CASES)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    con = database(SF)
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    status, ours, theirs = compare(spark, con, str(tmp_path), op7_licenses, SQL["op7_licenses"])
    assert status == "ok", [x for x in ours[3] if x not in set(theirs[3])][:3]


@pytest.mark.parametrize("name", {n for _, sequence in licenses.RULES for n in sequence})
def test_rules_use_known_sentences(name):
    assert name in dict(licenses.SENTENCES)
