from roomdiff.llm import licenses as li
from tests.llm.helpers import EDGES, documents, rows

APACHE = ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.\n"
          "You may obtain a copy of the License at:\n http://x.example/y\nUnless required by applicable law or agreed to in writing, software is distributed as is.")
MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software. Some words between. The above copyright notice and this "
       "permission notice shall be included in all copies. The software is provided \"as is\", without warranty of any kind.")
GOLDEN = [
    (20, APACHE, "ApacheGrant,ApacheComply,ApacheCopy,ApacheAsIs", "Apache-2.0"),
    (21, "x\nLicensed under CC BY-NC 4.0.\ny", "CCBYNC4", "CC-BY-NC-4.0"),
    (22, "This work is licensed under the GNU General Public License, version 3.", "GPL3Name", "GPL-3.0"),
    (23, MIT, "MITGrant,MITNotice,MITAsIs", "MIT"),
    (24, "Released under the MIT License. Licensed under the Apache License, Version 2.0.", "MITName,ApacheGrant", "Apache-2.0,MIT"),
    (25, "This program is free software; you can redistribute it", "", ""),
    (26, "We were not licensed under CC BY 4.0 then.", "", ""),
    (27, "Released under the MIT License.\nReleased under the MIT License!", "MITName,MITName", "MIT"),
    (28, "RELEASED UNDER THE MIT LICENSE", "MITName", "MIT"),
]


def test_golden_and_edges(spark):
    docs = documents(spark, EDGES + [(i, t, "a") for i, t, _, _ in GOLDEN])
    got = rows(li.scan(docs))
    assert len(got) == len(EDGES) + len(GOLDEN)
    by_id = {r["doc_id"]: r for r in got}
    for i, _, ids, names in GOLDEN:
        assert (by_id[i]["sentence_ids"], by_id[i]["licenses"]) == (ids, names), i
    assert all(r["n_known"] == 0 and r["licenses"] == "" for r in got if r["doc_id"] is None or r["doc_id"] < 20)
    assert li.scan(docs.limit(0)).count() == 0


def test_every_rule_can_match(spark):
    by_name = {v: k for k, v in reversed(li.SENTENCES.items())}
    docs = documents(spark, [(k, ". ".join(by_name[i] for i in ids) + ".", "a") for k, (ids, _) in enumerate(li.RULES)])
    got = {r["doc_id"]: r["licenses"] for r in rows(li.scan(docs))}
    assert got == {k: name for k, (_, name) in enumerate(li.RULES)}


def test_earlier_rules_take_their_identifiers(spark):
    rules = [(("A", "B"), "ab"), (("B",), "b"), (("A",), "a")]
    df = spark.createDataFrame([(["A", "B", "A"],), (["B", "A"],), (["A", "A", "B", "B"],), ([],)], "s array<string>")
    assert [r[0] for r in df.select(li.matched(df.s, rules)[0]).collect()] == [["ab", "a"], ["b", "a"], ["ab", "b", "a"], []]


# Notices as projects carry them, wrapped.
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
MIT_NOTICE = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY."""
BSD2_NOTICE = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
GPL_NOTICE = """This program is free software{} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{} either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY."""
LGPL_NOTICE = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
NOTICES = [
    (APACHE_NOTICE, "ApacheGrant,ApacheComply,ApacheCopy,ApacheAsIs", "Apache-2.0"), (MIT_NOTICE, "MITGrant,MITNotice,MITAsIs", "MIT"),
    (BSD2_NOTICE.format(""), "BSDGrant,BSDSource,BSDBinary,BSDAsIs", "BSD-2-Clause"),
    (BSD2_NOTICE.format("3. Neither the name of the copyright holder nor the names of its\n   contributors may be used.\n"), "BSDGrant,BSDSource,BSDBinary,BSDEndorse,BSDAsIs", "BSD-3-Clause"),
    (GPL_NOTICE.format(":", ",", 3), "GPLGrant,GPL3Later", "GPL-3.0-or-later"), (GPL_NOTICE.format(";", ";", 2), "GPLGrant,GPL2Later", "GPL-2.0-or-later"),
    (LGPL_NOTICE, "LGPLGrant", "LGPL"), (MPL_NOTICE, "MPL2", "MPL-2.0"),
    ("Our project is licensed under the\nMIT License", "MITName", "MIT"), ("It is no longer licensed under the MIT License.", "", ""),
    ("This is unlicensed under the MIT License", "", ""), ("released under\n\nthe MIT License", "", ""), ("Released under. The MIT License", "", ""),
]


def test_wrapped_notices(spark):
    shapes = [lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: "/*\n" + "\n".join(f" * {x}".rstrip() for x in t.split("\n")) + "\n */\nint x;",
              lambda t: "\n".join(f"# {x}".rstrip() for x in t.split("\n"))]
    docs = documents(spark, [(10 * k + j, shape(t), "a") for k, (t, _, _) in enumerate(NOTICES) for j, shape in enumerate(shapes)])
    got = {r["doc_id"]: (r["sentence_ids"], r["licenses"]) for r in rows(li.scan(docs))}
    assert got == {10 * k + j: (ids, names) for k, (_, ids, names) in enumerate(NOTICES) for j in range(len(shapes))}


def test_notices_on_one_line(spark):
    docs = documents(spark, [(k, GPL_NOTICE.format(*marks).replace("\n", " "), "a") for k, marks in enumerate([(":", ",", 3), (";", ";", 2)])])
    assert [r["licenses"] for r in rows(li.scan(docs))] == ["GPL-3.0-or-later", "GPL-2.0-or-later"]
