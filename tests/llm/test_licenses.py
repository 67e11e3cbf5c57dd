import math
import textwrap

from helpers import documents, sentence

from corpusloom.llm import licenses


def verdict(model, paragraph):
    own = licenses.grams(paragraph)
    p = model.probabilities(own)
    k = max(range(len(p)), key=lambda i: (p[i], -i))
    family = model.classes[k] if p[k] >= model.threshold else licenses.UNKNOWN
    return family, p[k], max((len(own & licenses.grams(t)) / len(licenses.grams(t)) for t in licenses.TEMPLATES.get(family, ())), default=0.0)


def brute(model, text):
    """Every line, and every stretch of lines that speak for a licence, by the whole classifier."""
    lines = (text or "").lower().split("\n")
    own = [(i, i, verdict(model, x)) for i, x in enumerate(lines)]
    alone = [model.bound(licenses.grams(x)) > 0 for x in lines]
    speaks = [a or (0 < i < len(lines) - 1 and alone[i - 1] and alone[i + 1] and bool(licenses.words_of(lines[i]))) for i, a in enumerate(alone)]
    out = [x for x in own if x[2][0] != licenses.UNKNOWN]
    at = 0
    while at < len(lines):
        end = at
        while end < len(lines) and speaks[end]:
            end += 1
        if end > at + 1:
            found = verdict(model, " ".join(lines[at:end]))
            said = any(f == found[0] and share >= licenses.OVERLAP for _, _, (f, _, share) in own[at:end])
            if found[0] != licenses.UNKNOWN and found[2] >= licenses.OVERLAP and not said:
                out.append((at, end - 1, found))
        at = max(end, at + 1)
    return [(n, *found) for n, _, found in sorted(out)]


#: Notices in words that neither training nor calibration has, wrapped and commented as files have them.
NOTICES = [
    ("apache", "Copyright 2016 Example Ltd. Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Copyright (c) 2020 Someone. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("gpl", "foo is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Copyright 2011 Someone. Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("boost", "Copyright 2007 Someone. Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("public-domain", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software."),
    ("cc-by", "The text of this page is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC-SA 3.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("all-rights-reserved", "Copyright 1999-2004 Example Inc. All rights reserved."),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1-only"),
]
FORMS = [lambda t: t, *(lambda t, w=w, p=p: "\n".join(p + x for x in textwrap.wrap(t, w, break_on_hyphens=False)) for w, p in ((70, ""), (72, "# "), (60, " * "), (50, "// ")))]
NO_NOTICES = [
    "This work is not licensed under the MIT License.",
    "The program was never released under the GNU General Public License.",
    "Nobody was granted a license to fish in the lake.",
    "The general public is free to use the library, and to copy any software there.",
    "Apache is a town; MIT is a school; Mozilla makes a browser.",
    "He copied the files to the public domain of the company network.",
]


def test_rows_equal_the_plain_python_model(spark):
    model = licenses.trained()
    texts = [None, "", "\n\n", "nothing here", "MIT", sentence(1, 40), *NO_NOTICES]
    texts += [f"intro\n{t}\nmore" for ts in licenses.TEMPLATES.values() for t in ts[:3]] + licenses.COUNTEREXAMPLES
    texts += ["Licensed under CC BY-NC 4.0.\nAll rights reserved.\nReleased under the MIT License."] * 2
    texts += ["license " * 3000, "license\n" * 300, "\n".join(licenses.COUNTEREXAMPLES)]
    texts += [f"Some words\n{form(t)}\n\n{sentence(3, 9)}" for _, t in NOTICES for form in FORMS]
    docs = documents(spark, list(enumerate(texts)))
    rows = docs.select("doc_id", licenses.license_paragraphs(docs.text, model).alias("p")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        wanted = brute(model, texts[r.doc_id])
        found = [x for x in r.p if x.family != licenses.UNKNOWN]
        assert [(x.n, x.family) for x in found] == [w[:2] for w in wanted], texts[r.doc_id]
        for x, w in zip(found, wanted, strict=True):
            assert math.isclose(x.probability, w[2], abs_tol=2e-3)
            assert math.isclose(x.overlap, w[3], abs_tol=1e-3) and x.confirmed == (w[3] >= licenses.OVERLAP)


def confirmed(model, text):
    return {f for _, f, _, share in brute(model, text) if share >= licenses.OVERLAP}


def test_recall_and_precision_on_other_notices():
    model = licenses.trained()
    cases = [(name, form(t)) for name, t in NOTICES for form in FORMS]
    hits = sum(name in confirmed(model, f"{sentence(2, 12)}\n{t}\n{sentence(4, 30)}") for name, t in cases)
    extra = sum(len(confirmed(model, t) - {name, "all-rights-reserved"}) for name, t in cases)
    assert hits >= 0.95 * len(cases) and extra <= 0.05 * len(cases), (hits, extra, len(cases))
    assert [t for t in [*NO_NOTICES, *licenses.COUNTEREXAMPLES] if confirmed(model, t)] == []


def test_templates_and_bound():
    model = licenses.trained()
    for name, ts in licenses.TEMPLATES.items():
        for t in ts:
            assert verdict(model, t)[0] == name, t
            assert model.bound(licenses.grams(t)) >= model.least
    for t in [*licenses.COUNTEREXAMPLES, *NO_NOTICES]:
        assert verdict(model, t)[0] == licenses.UNKNOWN, t


def test_plan_has_no_python(spark, sf_dir):
    from corpusloom.llm.queries import QUERIES

    df = QUERIES["op3_license_scans"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert df.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_a_blank_line_ends_a_notice():
    model = licenses.trained()
    gpl = FORMS[1](NOTICES[2][1])
    assert confirmed(model, gpl) == {"gpl"} and confirmed(model, gpl.replace("\n", "\n\n")) == set()


def test_empty_table(spark):
    docs = documents(spark, [(1, "x")]).limit(0)
    assert docs.select(licenses.license_paragraphs(docs.text, licenses.trained())).count() == 0
