import textwrap

import pytest
from mnemora.llm import licenses
from mnemora.llm.license_texts import HELD_OUT_DENIALS, HELD_OUT_FRAMES, HELD_OUT_NOTICES, NAMES, SPDX

DOCS = "doc_id long, text string, paragraphs string, probability int"


def texts():
    prose = "the rain in the town was heavy and the people of the place stayed in"
    return {
        1: f"{prose}\nReleased under the MIT License.\n{prose}", 2: f"{prose} Licensed under CC BY-NC 3.0. {prose}", 3: "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.",
        4: "This work is licensed under the GNU General Public License, version 2.", 5: prose, 6: None, 7: "", 8: "\n\n \n", 9: "Licensed under the Eclipse Public License, version 2.0.", 10: "The license of the MIT License test was a license",
        11: "mit dem Hund und mit der Katze " * 3000, 12: "licensed " * 30_000, 13: "ALL RIGHTS RESERVED.", 14: "- SPDX-License-Identifier: BSD-3-Clause", 15: "He lost his license and the copyright of the book at MIT.",
    }


def test_families(spark):
    rows = [(i, t, "c", 1) for i, t in texts().items()] + [(1, texts()[1], "c", 1), (None, "Released under the MIT License.", None, None)]
    got = licenses.summarise(licenses.scan(spark.createDataFrame(rows, DOCS))).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.license_family for r in got}
    want = {1: "mit", 2: "cc-by-nc", 3: "apache", 4: "gpl", 13: "proprietary", 14: "bsd", None: "mit"}
    assert by == {i: want.get(i, "unknown") for i in [*texts(), None]}
    three = next(r for r in got if r.doc_id == 3)
    assert three.families == ["apache", "mit"] and three.n_notices == 2


def test_plan_agrees_with_the_model(spark):
    held = licenses._labelled(HELD_OUT_FRAMES)
    df = spark.createDataFrame([(i, t, "", 0) for i, (_, t) in enumerate(held)], DOCS)
    rules = licenses.LicenseRules(similarity=0.0)
    got = {r.doc_id: r.paragraphs for r in licenses.scan(df, rules).collect()}
    model = licenses.train(rules)
    for i, (_, t) in enumerate(held):
        family, probability = model.predict(t)
        if family == "unknown":
            assert got[i] == []
        else:
            assert got[i][0].family == family and abs(got[i][0].probability - probability) < 1e-6


def test_held_out_accuracy():
    model = licenses.train()
    held = licenses._labelled(HELD_OUT_FRAMES)
    right = sum(model.predict(t)[0] == f for f, t in held)
    assert right / len(held) >= 0.98
    assert all(model.predict(t)[0] == "unknown" for f, t in held if f == "unknown")


def test_native_and_narrow(spark):
    df = licenses.summarise(licenses.scan(spark.createDataFrame([(1, "x", "", 0)], DOCS)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Python", "Arrow", "Pandas"))
    assert licenses.scan(spark.createDataFrame([], DOCS)).count() == 0


WRAPPED = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
}


def test_wrapped_notices(spark):
    wrap = lambda t, width, mark: "\n".join((mark + x).rstrip() for part in t.split("\n\n") for x in [*textwrap.wrap(part, width), ""])
    prose = "The rain in the town was heavy and the people\nof the place stayed in for the whole of the day"
    cases = [(f, f"{before}{wrap(t, width, mark)}{after}") for f, t in WRAPPED.items() for width in (40, 60, 72, 100) for mark in ("", "# ", " * ") for before, after in (("", ""), (f"{prose}\n", prose), (f"{prose}\n" * 20, f"{prose}\n" * 20))]
    got = {r.doc_id: r for r in licenses.summarise(licenses.scan(spark.createDataFrame([(i, t, "", 0) for i, (_, t) in enumerate(cases)], DOCS))).collect()}
    wrong = [(f, got[i].license_family, t) for i, (f, t) in enumerate(cases) if got[i].families != [f]]
    assert not wrong
    both = wrap(WRAPPED["mit"], 60, "") + "\n" + wrap(WRAPPED["bsd"], 60, "")
    assert licenses.summarise(licenses.scan(spark.createDataFrame([(1, both, "", 0)], DOCS))).first().families == ["bsd", "mit"]
    split = "Released under the\nMIT License.\n\nAll rights\nreserved."
    found = licenses.scan(spark.createDataFrame([(1, split, "", 0)], DOCS)).first().paragraphs
    assert [(p.paragraph, p.lines, p.family, p.text) for p in found] == [(1, 1, "mit", "MIT License."), (3, 2, "proprietary", "All rights\nreserved.")]


def families(spark, texts):
    got = licenses.summarise(licenses.scan(spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], DOCS)))
    return [r.license_family for r in sorted(got.collect(), key=lambda r: r.doc_id)]


def test_plain_notices(spark):
    plain = {
        "mit": ["MIT License", "License: MIT", "Licensed under MIT."], "apache": ["Licensed under Apache 2.0", "Apache License", "License: Apache-2.0"], "bsd": ["BSD 3-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
        "gpl": ["SPDX-License-Identifier: GPL-2.0-only", "Licensed under GPLv3", "License: GPL-3.0"], "unknown": ["License: EPL-2.0", "SPDX-License-Identifier: ISC", "ISC License", "Licensed under contract.", "GNU Free Documentation License"],
    }
    cases = [(f, t) for f, ts in plain.items() for t in ts] + [(f, f"SPDX-License-Identifier: {x}") for f, xs in SPDX.items() for x in xs]
    assert [(f, t) for (_, t), f in zip(cases, families(spark, [t for _, t in cases]), strict=True)] == [(f, t) for f, t in cases]


def test_recall_on_held_out_notices(spark):
    cases = [(f, form.replace("{}", n)) for f in NAMES for n in (*NAMES[f], *SPDX[f]) for form in HELD_OUT_NOTICES]
    got = families(spark, [t for _, t in cases])
    assert sum(g == f for (f, _), g in zip(cases, got, strict=True)) >= 0.97 * len(cases)
    assert all(g in (f, "unknown") for (f, _), g in zip(cases, got, strict=True))


def test_a_grant_outweighs_reserved_rights(spark):
    text = "Copyright (c) 2001, The Authors\nAll rights reserved.\n\n" + "\n".join(textwrap.wrap(WRAPPED["bsd"], 60))
    assert families(spark, [text, "Copyright (c) 2001. All rights reserved."]) == ["bsd", "proprietary"]


DENIED = [
    "This article is not licensed under the MIT License.", "He wrote about the GPL version 3 license in his thesis.", "All rights reserved by the king in the treaty of 1815.",
    "We compared the MIT license with the Apache 2.0 license and chose neither.", "The license of the MIT License test was a license",
    "The rain was heavy.\nHe wrote about the GPL version 3 license in his thesis.\nThe people stayed in.",
]


def confirmed_by_hand(text, model, rules, use_model=True):
    """One line: the model's family and its best share of a template's word pairs, restated without Spark."""
    words = licenses.tokens(text)
    pairs = {" ".join(words[i : i + 2]) for i in range(len(words) - 1)}
    alike = {f: max(len(pairs & set(t)) / len(t) for t in ts) for f, ts in licenses._template_pairs().items()}
    family = model.predict(text)[0] if use_model else max(alike, key=alike.get)
    return family if family != "unknown" and alike[family] >= rules.similarity else "unknown"


def test_denials_and_citations_are_unknown(spark):
    assert families(spark, DENIED) == ["unknown"] * len(DENIED)
    cases = [t for _, t in licenses.filled(HELD_OUT_DENIALS)]
    got = families(spark, cases)
    assert sum(g == "unknown" for g in got) >= 0.97 * len(cases)
    model, rules = licenses.train(), licenses.LicenseRules()
    # templates alone take nearly all of them for notices: it is the classifier that decides
    assert sum(confirmed_by_hand(t, model, rules, use_model=False) == "unknown" for t in cases) < 0.1 * len(cases)


def test_lines_equal_their_restatement(spark):
    rules, model = licenses.LicenseRules(), licenses.train()
    cases = [t for _, t in licenses._labelled(HELD_OUT_FRAMES)] + [t for _, t in licenses.filled(HELD_OUT_NOTICES)[::3]] + [t for _, t in licenses.filled(HELD_OUT_DENIALS)[::5]]
    want = [confirmed_by_hand(t, model, rules) for t in cases]
    assert families(spark, cases) == want and len(set(want)) == 13


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_every_planted_line_is_found(spark, sf):
    """The documents' own notices, none of which is a template for its family in these words."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = {r.doc_id: r.license_family for r in licenses.summarise(licenses.scan(docs)).collect()}
    lines = {"MIT License.": "mit", "Apache License, Version 2.0.": "apache", "General Public License, version": "gpl", "CC BY-NC": "cc-by-nc", "All rights reserved.": "proprietary"}
    seen = 0
    for r in docs.collect():
        held = {f for words, f in lines.items() if any(words in x for x in (r.text or "").split("\n"))}
        assert got[r.doc_id] in (held or {"unknown"})
        seen += bool(held)
    assert seen >= 20
