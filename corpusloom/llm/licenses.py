"""License scans: a trained paragraph classifier, run with DataFrame functions alone.

A paragraph is a line, or a stretch of neighbouring lines that all speak for some licence, as those of a notice that
is wrapped do. It's described by the set of its words and word pairs; a multinomial logistic regression over these
sparse features gives the probability of each licence family and of ``unknown``. Every line of every text is
classified: a line's features add up to a bound on its odds for any family against ``unknown``, and where that bound
stays below the threshold the line is unknown, which costs no more than a look at each word. Temperature and
threshold are calibrated on notices that training hasn't seen. A prediction is confirmed by template comparison: so
large a share of some template of the family has to be in the paragraph. A stretch counts where it confirms a family
that none of its lines confirms.

Training is on the templates, fragments and negations of them, and counterexamples below, on the driver; scoring is
one projection without Python, shuffle or broadcast. Words are found in a table by their hash and then compared, pairs
by the numbers of their words, so features are exact.

Defined results: a null or empty text has no paragraph and no family; equal paragraphs count each; repeated
rows get equal results; other columns play no part.
"""

import json
import math
import random

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
_GNU_REST = "This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details."
_COMMONS = "Creative Commons Attribution{0} {1} International License"


def _commons(kinds: dict[str, str]) -> list[str]:
    out = [f"Licensed under CC {k.upper()} {v}." for k in kinds for v in ("2.0", "3.0", "4.0")] + [f"This work is licensed under CC {k.upper()} 4.0." for k in kinds]
    out += [f"This work is licensed under a {_COMMONS.format(long, '4.0')}." for long in kinds.values()] + [f"Licensed under a Creative Commons Attribution{long} License." for long in kinds.values()]
    return out + [f"SPDX-License-Identifier: CC-{k.upper()}-4.0" for k in kinds]


# How licence families are named or worded, and wording that resembles it but grants nothing.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        _GNU.format("program", "", "3"),
        _GNU_REST.format("program", ""),
        "Licensed under the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        _GNU.format("library", "Lesser ", "2.1"),
        _GNU_REST.format("library", "Lesser "),
        "Licensed under the LGPL version 3 or later.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        _GNU.format("program", "Affero ", "3"),
        _GNU_REST.format("program", "Affero "),
        "Licensed under the AGPL version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "isc": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
        "Licensed under the Eclipse Public License 1.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "zlib": [
        "Licensed under the zlib license.",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "SPDX-License-Identifier: Zlib",
    ],
    "cc-by": _commons({"by": "", "by-sa": "-ShareAlike", "by-nd": "-NoDerivatives"}),
    "cc-by-nc": _commons({"by-nc": "-NonCommercial", "by-nc-sa": "-NonCommercial-ShareAlike", "by-nc-nd": "-NonCommercial-NoDerivatives"}),
    "public-domain": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "This work is in the public domain.",
        "Released under the Unlicense.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without permission.",
        "Unauthorized copying of this file is strictly prohibited. Proprietary and confidential.",
    ],
}
#: Notices that training doesn't see: for temperature and threshold.
CALIBRATION = {
    "apache": "The code is available under the Apache License 2.0.",
    "mit": "This package is distributed under the MIT license.",
    "gpl": "You can redistribute this under the terms of the GNU General Public License version 2.",
    "lgpl": "It is released under the GNU Lesser General Public License.",
    "agpl": "The server is licensed under the GNU Affero General Public License v3.",
    "bsd": "This code is licensed under the BSD license.",
    "isc": "Released under the ISC license.",
    "mpl": "The files are subject to the Mozilla Public License Version 2.0.",
    "epl": "Made available under the Eclipse Public License v1.0.",
    "boost": "Use, modification and distribution are subject to the Boost Software License.",
    "zlib": "Released under the zlib license.",
    "cc-by": "Text is available under the Creative Commons Attribution-ShareAlike License 3.0.",
    "cc-by-nc": "Photos are licensed under a Creative Commons Attribution-NonCommercial License.",
    "public-domain": "This document is released into the public domain.",
    "all-rights-reserved": "Copyright 2019 Example. All rights reserved.",
    "unknown": "The license of the driver was granted by the public office, version 2 of the form.",
}
COUNTEREXAMPLES = [
    "The driver lost the license after the accident.",
    "A fishing license costs ten dollars and is valid for a year.",
    "The restaurant was granted a liquor license last month.",
    "Researchers at MIT released a study of the city.",
    "The Apache helicopters flew over the valley.",
    "Human rights were discussed at the meeting.",
    "Copyright law is taught in the second year.",
    "The public library is open on Sundays.",
    "The domain of the function is the set of real numbers.",
    "You need permission to enter the building.",
    "The warranty of the car covers the engine.",
    "Our software version 2.0 was released in June.",
    "All seats are reserved for members of the club.",
    "Creative people in the commons of the college.",
    "The general public may attend, free of charge.",
    "Version 3 of this work was published in the journal.",
    "The license plate was found under the bridge.",
    "They all reserved the rights to the film and the copyright was sold.",
    "You may redistribute the leaflets in the park if you have the permission of the owner.",
    "The software is provided by the school and the files are on the shared disk.",
    "It was published by the foundation in the third version of the report.",
    "He said that the terms of the agreement were as follows.",
    "The source of the river is in the mountains, and its form is subject to change.",
    "Boost the signal and release the button; the eclipse was public and free for everyone.",
    "She was free to use, copy and modify the recipe without any fee.",
    "There is no warranty on used cars, express or implied, in this state.",
    "The university of the city has a department of general studies.",
    "In the end the work was not in the library, and this program was on the air.",
    "Click here to read more about the history of the license debate.",
    "See the file for details of how the data was made.",
    "The zlib of the old days and the isc of the new ones were talked about.",
    "the and of to in is it you that was for on are with as his they at be this have from or had by not but what all were when we there can",
]
GRANTS = ("licensed", "released", "distributed", "available", "dedicated", "granted", "permitted", "provided")
NEGATIONS = ("not", "never", "no longer", "neither")
WORD = r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"
UNKNOWN = "unknown"
#: A confirmed paragraph has so large a share of the words and pairs of one of the family's templates.
OVERLAP = 0.6


def words_of(paragraph: str) -> list[str]:
    import regex

    return regex.findall(WORD, paragraph.lower())


def grams(paragraph: str) -> set[str]:
    """Words and word pairs, as the SQL expression below gives them."""
    words = words_of(paragraph)
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


def _perturbed(text: str, rng: random.Random) -> str:
    words = [w for w in text.split() if rng.random() > 0.1] or text.split()
    before = rng.sample(["copyright", "2021", "acme", "notice", "code", "and", "content"], rng.randrange(3))
    return " ".join([*before, *words, *rng.sample(["please", "see", "file", "details", "contact", "us"], rng.randrange(3))])


def _negated(text: str, rng: random.Random) -> list[str]:
    words = text.split()
    return [" ".join([*words[:i], rng.choice(NEGATIONS), *words[i:]]) for i, w in enumerate(words) if w.lower().strip(".,;") in GRANTS]


class Classifier:
    """Weights by gram and class, class order, intercepts, temperature and threshold."""

    def __init__(self, classes, weights, bias, temperature, threshold):
        self.classes, self.weights, self.bias, self.temperature, self.threshold = classes, weights, bias, temperature, threshold

    def logits(self, features: set[str]) -> list[float]:
        out = list(self.bias)
        for g in sorted(features):
            for k, w in enumerate(self.weights.get(g, ())):
                out[k] += w
        return out

    def probabilities(self, features: set[str]) -> list[float]:
        x = [v / self.temperature for v in self.logits(features)]
        e = [math.exp(v - max(x)) for v in x]
        return [v / sum(e) for v in e]

    def bound(self, features: set[str]) -> float:
        """At least the log odds, times the temperature, of the best family against unknown."""
        return self.bias_bound + sum(max(self.weights[g][:-1]) - self.weights[g][-1] for g in features if g in self.weights)

    @property
    def bias_bound(self) -> float:
        return max(self.bias[:-1]) - self.bias[-1]

    @property
    def least(self) -> float:
        """A paragraph whose bound is lower is unknown."""
        return self.temperature * math.log(self.threshold / (1 - self.threshold))


def trained(copies: int = 5, rounds: int = 400, rate: float = 0.6, ridge: float = 2e-4, seed: int = 11) -> Classifier:
    """The classifier: logistic regression by gradient steps over all rows, then temperature and threshold."""
    rng = random.Random(seed)
    classes = [*TEMPLATES, UNKNOWN]
    last = len(classes) - 1
    rows = [(t, k) for k, family in enumerate(TEMPLATES) for t in TEMPLATES[family]]
    fragments = [(" ".join(w[i : i + n]), k) for t, k in rows for w in [t.split()] if len(w) > 14 for i, n in ((rng.randrange(len(w) - 6), rng.randrange(7, 12)) for _ in range(4))]
    halves = [(" ".join(x), k) for t, k in rows for w in [t.split()] if 7 < len(w) < 30 for at in range(3, len(w) - 2, 2) for x in (w[:at], w[at:])]
    negated = [(x, last) for t, _ in rows for x in _negated(t, rng)]
    plain = [(x, last) for t in COUNTEREXAMPLES for x in [t, *(" ".join(t.split()[i : i + 6]) for i in range(0, len(t.split()), 6))]]
    rows = [(t if i == 0 else _perturbed(t, rng), k) for t, k in rows for i in range(copies)] + fragments + halves + negated + [(t if i == 0 else _perturbed(t, rng), k) for t, k in plain for i in range(2)]
    vocabulary = sorted(set().union(*(grams(t) for t, _ in rows)))
    loose = [w for w in vocabulary if " " not in w]
    rows += [(" ".join(rng.sample(loose, n)), last) for n in (0, 1, 1, 2, 2, 3, 4, 6) for _ in range(30)]  # loose words grant nothing
    number = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary) + 1))
    for i, (t, _) in enumerate(rows):
        x[i, [number[g] for g in grams(t) if g in number]] = 1
    x[:, -1] = 1
    y = np.eye(len(classes))[[k for _, k in rows]]
    share = 1 / y.sum(axis=0)
    weight = (y @ share)[:, None] / (y @ share).sum() * len(rows)
    weight[y[:, -1] == 1] *= 6  # most text is no notice
    w = np.zeros((x.shape[1], len(classes)))
    pace = np.zeros_like(w)
    for _ in range(rounds):
        e = np.exp((z := x @ w) - z.max(axis=1, keepdims=True))
        slope = x.T @ (weight * (e / e.sum(axis=1, keepdims=True) - y)) / len(rows) + ridge * w
        pace = 0.9 * pace + slope
        w -= rate * pace
    w = np.round(w, 4)
    model = Classifier(classes, {g: w[i].tolist() for g, i in number.items() if np.ptp(w[i]) > 0.02}, w[-1].tolist(), 1.0, 0.5)
    held = [(grams(t), classes.index(name)) for name, t in CALIBRATION.items()] + [(grams(x), last) for t in CALIBRATION.values() for x in _negated(t, rng)[:1]]

    def loss(temperature: float) -> float:
        model.temperature = temperature
        return -sum(math.log(max(1e-12, model.probabilities(f)[k])) for f, k in held)

    model.temperature = min((0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
    wrong = [max(p[:-1]) for f, k in held if k == last for p in [model.probabilities(f)]]
    model.threshold = min(0.9, max(0.7, round(max(wrong, default=0.7), 2)))
    return model


class Tables:
    """What the expression looks features up in: words by hash, pairs by their words' numbers, weights by feature."""

    def __init__(self, model: Classifier):
        from xxhash import xxh64_intdigest

        self.words = [None, *sorted({w for g in model.weights for w in g.split(" ")})]
        hashes = [xxh64_intdigest(w.encode(), 42) for w in self.words[1:]]
        signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
        self.slots = next(m for m in range(1 << 17, 1 << 20) if len({h % m for h in signed}) == len(signed))
        number = {w: i for i, w in enumerate(self.words) if w}
        self.by_slot = [0] * self.slots
        for w, h in zip(self.words[1:], signed, strict=True):
            self.by_slot[h % self.slots] = number[w]
        self.base = len(self.words)
        pairs = {g: number[a] * self.base + number[b] for g in model.weights if " " in g for a, b in [g.split(" ")]}
        self.pair_slots = next(m for m in range(1 << 17, 1 << 22) if len({p % m for p in pairs.values()}) == len(pairs))
        self.by_pair = [0] * self.pair_slots
        self.features, self.pair_keys = [None], [0]
        self.by_word = [0] * self.base
        for g in sorted(model.weights):
            self.features.append(g)
            self.pair_keys.append(pairs.get(g, 0))
            if g in pairs:
                self.by_pair[pairs[g] % self.pair_slots] = len(self.features) - 1
            else:
                self.by_word[number[g]] = len(self.features) - 1
        self.weights = [[0.0] * len(model.classes), *(model.weights[g] for g in self.features[1:])]
        self.bounds = [max(w[:-1]) - w[-1] for w in self.weights]


def _literal(value, kind: str) -> Column:
    """A constant, folded into the plan once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _bound(x: Column, f) -> Column:
    """f(x), with x evaluated once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def license_paragraphs(text: Column, model: Classifier) -> Column:
    """An array with a struct for each paragraph that may be a notice: n (its line, a stretch's first), family, probability, overlap, confirmed.

    The family is ``unknown`` where the classifier says so or its probability is below the threshold.
    """
    t = Tables(model)
    slots, words, pairs, by_word, pair_keys = (_literal(v, k) for v, k in ((t.by_slot, "array<int>"), (t.words, "array<string>"), (t.by_pair, "array<int>"), (t.by_word, "array<int>"), (t.pair_keys, "array<int>")))
    weights, bounds = _literal(t.weights, "array<array<double>>"), _literal(t.bounds, "array<double>")
    bias = F.array(*map(F.lit, model.bias))
    classes = F.array(*map(F.lit, model.classes))
    templates = _literal({f: [sorted(grams(x)) for x in ts] for f, ts in TEMPLATES.items()}, "map<string,array<array<string>>>")

    def found(line: Column) -> Column:
        return F.regexp_extract_all(line, F.lit(WORD), F.lit(0))

    def features(line: Column) -> Column:
        """Numbers of the line's distinct known words and pairs."""

        def number(w: Column) -> Column:
            i = F.get(slots, F.pmod(F.xxhash64(w), F.lit(t.slots)).cast("int"))
            return F.when((i > 0) & (F.get(words, i) == w), i).otherwise(0)

        def both(ids: Column) -> Column:
            def pair(a: Column, b: Column) -> Column:
                key = a * t.base + b
                at = F.get(pairs, key % t.pair_slots)
                return F.when((a > 0) & (b > 0) & (F.get(pair_keys, at) == key), at).otherwise(0)

            beside = F.when(F.size(ids) > 1, F.zip_with(F.slice(ids, F.lit(1), F.size(ids) - 1), F.slice(ids, F.lit(2), F.size(ids) - 1), pair)).otherwise(F.array().cast("array<int>"))
            own = F.transform(F.filter(ids, lambda i: i > 0), lambda i: F.get(by_word, i))
            return F.array_distinct(F.filter(F.concat(own, beside), lambda i: i > 0))

        return _bound(F.transform(found(line), number), both)

    def own_grams(line: Column) -> Column:
        def made(ws: Column) -> Column:
            beside = F.when(F.size(ws) > 1, F.zip_with(F.slice(ws, F.lit(1), F.size(ws) - 1), F.slice(ws, F.lit(2), F.size(ws) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
            return F.concat(ws, beside)

        return _bound(found(line), made)

    def odds(own: Column) -> Column:
        return F.aggregate(own, F.lit(model.bias_bound), lambda a, i: a + F.get(bounds, i))

    def classified(x: Column) -> Column:
        """n, last, line and own (features), to n, last, line, family and probability."""
        logits = F.aggregate(x["own"], bias, lambda a, i: F.zip_with(a, F.get(weights, i), lambda p, q: p + q))
        chances = lambda z: F.transform(z, lambda v: F.exp((v - F.array_max(z)) / model.temperature))
        best = lambda e: F.struct((F.array_max(e) / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)).alias("p"), F.element_at(classes, F.array_position(e, F.array_max(e)).cast("int")).alias("family"))
        named = lambda b: F.struct(x["n"].alias("n"), x["last"].alias("last"), x["line"].alias("line"), F.when(b["p"] >= model.threshold, b["family"]).otherwise(F.lit(UNKNOWN)).alias("family"), b["p"].alias("p"))
        return _bound(logits, lambda z: _bound(chances(z), lambda e: _bound(best(e), named)))

    def compared(x: Column) -> Column:
        shares = F.transform(F.try_element_at(templates, x["family"]), lambda ts: F.size(F.array_intersect(ts, own_grams(x["line"]))) / F.size(ts))
        overlap = F.when(x["family"] != UNKNOWN, F.coalesce(F.array_max(shares), F.lit(0.0))).otherwise(F.lit(0.0))
        return _bound(overlap, lambda o: F.struct(x["n"].alias("n"), x["last"].alias("last"), x["family"].alias("family"), F.round(x["p"], 4).alias("probability"), F.round(o, 4).alias("overlap"), (o >= OVERLAP).alias("confirmed")))

    lines = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n"), lambda x, i: F.struct(i.alias("n"), i.alias("last"), x.alias("line"), features(x).alias("own")))
    scored = F.transform(lines, lambda x: F.struct(x["n"].alias("n"), x["last"].alias("last"), x["line"].alias("line"), x["own"].alias("own"), odds(x["own"]).alias("odds")))

    def paragraphs(all_lines: Column) -> Column:
        """Lines that may be notices, and stretches of lines of which each speaks for some licence, or both around it do."""
        speaks = lambda x: x["odds"] > 0
        beside = lambda x, by: F.coalesce(speaks(F.get(all_lines, x["n"] + by)), F.lit(False))
        inside = lambda x: speaks(x) | (beside(x, -1) & beside(x, 1) & x["line"].rlike(WORD))
        singles = F.transform(F.filter(all_lines, lambda x: x["odds"] >= model.least), lambda x: F.struct(*(x[c].alias(c) for c in ("n", "last", "line", "own"))))
        silent = F.transform(F.filter(all_lines, lambda x: ~inside(x)), lambda x: x["n"])
        starts = F.filter(all_lines, lambda x: speaks(x) & ~F.array_contains(F.concat(silent, F.array(F.size(all_lines))), x["n"] + 1) & ((x["n"] == 0) | F.array_contains(silent, x["n"] - 1)))

        def stretch(x: Column) -> Column:
            end = F.coalesce(F.array_min(F.filter(silent, lambda i: i > x["n"])), F.size(all_lines))
            whole = F.array_join(F.transform(F.slice(all_lines, x["n"] + 1, end - x["n"]), lambda y: y["line"]), " ")
            return _bound(F.struct((end - 1).alias("last"), whole.alias("line")), lambda y: F.struct(x["n"].alias("n"), y["last"].alias("last"), y["line"].alias("line"), features(y["line"]).alias("own")))

        return F.concat(singles, F.transform(starts, stretch))

    def standing(all_found: Column) -> Column:
        """Lines, and confirmed stretches whose family none of their lines confirms."""

        def stays(x: Column) -> Column:
            said = F.exists(all_found, lambda o: (o["n"] == o["last"]) & o["confirmed"] & (o["family"] == x["family"]) & (o["n"] >= x["n"]) & (o["last"] <= x["last"]))
            return (x["n"] == x["last"]) | (x["confirmed"] & (x["family"] != UNKNOWN) & ~said)

        return F.transform(F.array_sort(F.filter(all_found, stays)), lambda x: F.struct(*(x[c].alias(c) for c in ("n", "family", "probability", "overlap", "confirmed"))))

    return _bound(_bound(scored, paragraphs), lambda ps: _bound(F.transform(F.transform(ps, classified), compared), standing))
