"""Licence scans by a trained paragraph classifier, in DataFrame functions only.

A paragraph is a run of lines that aren't blank. Its sentences (cut at line ends too) are pieces; a unit is a run of pieces of one paragraph, and from each
piece on, units grow until they hold more words than the longest template, so a notice is found whole however it is wrapped and whatever stands around it.
A unit's features are the presence of word 1-, 2- and 3-grams (lower case, words of ASCII letters,
digits and characters beyond ASCII). A multinomial logistic regression over the n-grams of the small table ``LABELLED`` gives each family's
probability, and that of ``unknown`` (prose, code and notices without a licence); its temperature is fitted by leaving each
fold of the table out in turn. A family is reported when its calibrated probability reaches ``THRESHOLD`` and the unit holds at least
``CONFIRM`` of the words of one of the family's templates; else the unit is unknown. Of units that overlap, the one with the largest share of a template counts,
then the shortest, the most probable, the first. Only texts with one of the ``cues``, and in them units with two of ``cues(2)``, are scored: these are so many
words of every template that the others (with one of them) are less than ``CONFIRM`` of it, so what has fewer can't be confirmed.

The model is fitted from the fixed table when the plan is built and sent as literals, so nothing grows with the corpus. Null and empty texts
have no paragraphs. Repeated rows are scanned each; extra columns are ignored. Whole texts are scanned.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD, CONFIRM, FOLDS = 0.5, 0.6, 8
UNKNOWN = "unknown"
#: Fixed values: (family, paragraph).
LABELLED = [
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("apache", "This project is released under the Apache License 2.0."),
    ("mit", "Released under the MIT License."),
    ("mit", "This software is licensed under the MIT License."),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("gpl", "Licensed under the GNU GPL version 2."),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    ("agpl", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("bsd", "SPDX-License-Identifier: BSD-3-Clause"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl", "SPDX-License-Identifier: MPL-2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "Text is available under the Creative Commons Attribution-ShareAlike License."),
    ("cc0", "This work is dedicated to the public domain under CC0 1.0."),
    ("cc0", "SPDX-License-Identifier: CC0-1.0"),
    ("proprietary", "Copyright. All rights reserved. No part of this work may be reproduced without written permission."),
    ("proprietary", "Confidential and proprietary. All rights reserved."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Unauthorized copying of this file, via any medium, is strictly prohibited."),
    ("apache", "Apache License Version 2.0, January 2004"),
    ("apache", "License: Apache-2.0"),
    ("mit", "License: MIT"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("gpl", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("gpl", "Distributed under the terms of the GNU General Public License v2 or later."),
    ("gpl", "License: GPL-3.0"),
    ("lgpl", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."),
    ("agpl", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."),
    ("bsd", "BSD 3-Clause License"),
    ("bsd", "BSD 2-Clause License"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "Released under the ISC License."),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("unlicense", "Released under the Unlicense."),
    ("unlicense", "SPDX-License-Identifier: Unlicense"),
    ("mpl", "Mozilla Public License Version 2.0"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("epl", "SPDX-License-Identifier: EPL-2.0"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib", "SPDX-License-Identifier: Zlib"),
    ("boost", "Distributed under the Boost Software License, Version 1.0."),
    ("boost", "SPDX-License-Identifier: BSL-1.0"),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    (UNKNOWN, "The driver must carry a valid license and the version of the form that was released under the rules."),
    (UNKNOWN, "He was licensed to practise law and published the general terms of the contract."),
    (UNKNOWN, "The public library is free and the software was released in version 2.0 with new conditions."),
    (UNKNOWN, "Students at MIT built a robot and the apache helicopter flew over the field."),
    (UNKNOWN, "Please contact the foundation for permission to use the documentation files."),
    (UNKNOWN, "This is the source code of the following program, in binary and other forms."),
    (UNKNOWN, "See the license for details of the work and the attribution of the images."),
    (UNKNOWN, "A fishing licence costs ten dollars and the rights are reserved for members."),
    (UNKNOWN, "Der Führerschein und die Lizenz sind im Amt erhältlich."),
    (UNKNOWN, "La licence de pêche est disponible à la mairie."),
    (UNKNOWN, "He got a driving license while he was a student at MIT."),
    (UNKNOWN, "The clause of the second bill has three parts and the license of the pub was lost."),
    (UNKNOWN, "The general public may use the library in June, as the version of 2007 says."),
    (UNKNOWN, "A notice shall be included with all copies of the letter, and the above holds for any purpose."),
    (UNKNOWN, "The foundation has published a free program of the concert, and you can buy it at the door."),
    (UNKNOWN, "The names of its contributors and the holder of the record were read, and prior permission was given."),
    (UNKNOWN, "The software is provided by the firm, and the authors will be at the event in January 2004."),
    (UNKNOWN, "All members have the rights that were reserved, and copying of files is part of the work."),
    (UNKNOWN, "An eclipse of the sun is to be seen by the public, with a mozilla on the boost of the rocket."),
    (UNKNOWN, "The creative team met in the commons to talk about the domain and its public image."),
]
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: What a line that isn't blank has, and where a sentence ends.
INK, SENTENCE = r"[^ \t\n\x0B\f\r]", r"(?<=[.;:!?])[ \t]+"


def grams(text: str) -> list[str]:
    words = _WORD.findall(text.lower())
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def _fit(rows, vocabulary: dict[str, int], families: list[str], steps: int = 300):
    x, y = np.zeros((len(rows), len(vocabulary) + 1)), np.zeros((len(rows), len(families)))
    for k, (family, text) in enumerate(rows):
        x[k, [vocabulary[g] for g in grams(text) if g in vocabulary]] = 1
        x[k, -1] = 1
        y[k, families.index(family)] = 1
    w = np.zeros((x.shape[1], y.shape[1]))
    for _ in range(steps):
        p = _softmax(x @ w)
        w -= 0.5 * (x.T @ (p - y) / len(rows) + 0.001 * w)
    return w


def _softmax(z):
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@lru_cache(maxsize=1)
def model() -> tuple[dict[str, int], list[str], np.ndarray, float]:
    """Vocabulary, families (unknown last), weights with the bias last, and temperature."""
    families = sorted({f for f, _ in LABELLED} - {UNKNOWN}) + [UNKNOWN]
    vocabulary = {g: k for k, g in enumerate(sorted({g for _, t in LABELLED for g in grams(t)}))}
    held = []
    for fold in range(FOLDS):
        w = _fit([row for k, row in enumerate(LABELLED) if k % FOLDS != fold], vocabulary, families, 60)
        for family, text in LABELLED[fold::FOLDS]:
            x = np.zeros(len(vocabulary) + 1)
            x[[vocabulary[g] for g in grams(text)]] = 1
            x[-1] = 1
            held.append((x @ w, families.index(family)))
    losses = {t: -np.mean([np.log(_softmax(z / t)[i] + 1e-12) for z, i in held]) for t in np.geomspace(0.25, 4, 17)}
    return vocabulary, families, _fit(LABELLED, vocabulary, families), float(min(losses, key=losses.get))


def _templates() -> dict[str, list[list[str]]]:
    """Sorted distinct words of each template of each family."""
    families = model()[1]
    return {f: [sorted(set(_WORD.findall(t.lower()))) for g, t in LABELLED if g == f] for f in families[:-1]}


#: Words that any prose has; as cues they come last.
COMMON = frozenset("a an and any are as at be by can for from in is it may not of on or that the this to with you".split())


def cues(least: int = 1) -> list[str]:
    """Words of which every share of ``CONFIRM`` or more of any template has ``least``: as few of each template as that takes, those of other templates, long and rare ones first."""
    found: set[str] = set()
    for t in sorted((t for lists in _templates().values() for t in lists), key=len):
        rest = max(k for k in range(len(t)) if k / len(t) < CONFIRM)  # so many words alone never confirm
        order = sorted(t, key=lambda v: (v not in COMMON, v in found and len(v) > 1, len(v), v), reverse=True)
        found.update(order[: len(t) - rest + least - 1])
    return sorted(found)


#: A unit takes in pieces until those after its first hold so many words.
LONGEST = max(len(_WORD.findall(t.lower())) for f, t in LABELLED if f != UNKNOWN)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_paragraphs, n_license, families (sorted, comma-joined), paragraphs (line where it starts:family of each notice, comma-joined), score (largest)."""
    vocabulary, families, w, temperature = model()
    names = F.split(F.lit(" ".join(families)), " ")
    numbers = lambda row: [round(float(v), 6) for v in row]
    weights = F.from_json(F.lit(json.dumps({g: numbers(w[k]) for g, k in vocabulary.items()}, ensure_ascii=False)), "map<string,array<double>>")
    bias = F.from_json(F.lit(json.dumps(numbers(w[-1]))), "array<double>")
    templates = {f: [F.split(F.lit(" ".join(t)), " ") for t in lists] for f, lists in _templates().items()}
    pair, gate = F.split(F.lit(" ".join(cues(2))), " "), r"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])(?:" + "|".join(cues(2)) + r")(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])"
    known = F.split(F.lit(" ".join(sorted({v for lists in _templates().values() for t in lists for v in t}))), " ")
    cued = r"(?<![^\x00-\x2F\x3A-\x60\x7B-\x7F])(?:" + "|".join(cues()) + r")(?![^\x00-\x2F\x3A-\x60\x7B-\x7F])"

    def pieces(line, at):
        def piece(t):
            words = F.regexp_extract_all(F.lower(t), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"))
            return F.struct(at.alias("at"), words.alias("words"), F.lit(False).alias("blank"), F.when(F.lower(t).rlike(gate), F.size(F.array_intersect(words, pair))).otherwise(F.lit(0)).alias("cued"))

        gap = F.array(F.struct(at.alias("at"), F.array().cast("array<string>").alias("words"), F.lit(True).alias("blank"), F.lit(0).alias("cued")))
        return F.when(line.rlike(INK), F.transform(F.split(line, SENTENCE), piece)).otherwise(gap)

    def enough(pieces):
        return F.aggregate(pieces, F.lit(0), lambda acc, x: acc + x["cued"]) >= 2

    def units(i):
        """The units that start at piece i."""
        state = lambda n, k, more: F.struct(n.cast("int").alias("n"), k.cast("int").alias("k"), more.alias("more"))

        def take(acc, x):
            ok = acc["more"] & ~x["blank"] & (acc["n"] < LONGEST)
            return F.when(ok, state(acc["n"] + F.when(acc["k"] == 0, 0).otherwise(F.size(x["words"])), acc["k"] + 1, F.lit(True))).otherwise(state(acc["n"], acc["k"], F.lit(False)))

        most = F.aggregate(F.slice("s", i, LONGEST + 1), state(F.lit(0), F.lit(0), F.lit(True)), take, lambda acc: acc["k"])
        return F.transform(F.filter(F.sequence(F.lit(0), most), lambda k: (k > 0) & enough(F.slice("s", i, k))), lambda k: F.struct(F.element_at("s", i)["at"].alias("at"), i.alias("first"), (i + k - 1).alias("last"), F.flatten(F.transform(F.slice("s", i, k), lambda x: x["words"])).alias("words")))

    def place(p):
        return [p[c].alias(c) for c in ("at", "first", "last")]

    def told(p):
        return F.struct(*place(p), p["words"].alias("words"), F.array_intersect(p["words"], known).alias("known"))

    def confirm(p):
        words = p["known"]
        share = F.array(*[F.greatest(*[F.size(F.array_intersect(words, t)) / F.size(t) for t in lists], F.lit(0.0)) for lists in templates.values()], F.lit(0.0))
        return F.struct(*place(p), p["words"].alias("words"), share.alias("share"))

    def features(p):
        words = p["words"]
        n = F.size(words)

        def of(k):
            return F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))

        found = F.array_distinct(F.concat(*[F.when(n >= k, of(k)).otherwise(F.array().cast("array<string>")) for k in (1, 2, 3)]))
        return F.struct(*place(p), p["share"].alias("share"), F.filter(F.transform(found, lambda g: F.try_element_at(weights, g)), lambda v: v.isNotNull()).alias("rows"))

    def logits(p):
        total = F.aggregate(p["rows"], bias, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
        return F.struct(*place(p), p["share"].alias("share"), F.transform(total, lambda z: F.exp(z / temperature)).alias("e"))

    def decide(p):
        top = F.array_max(p["e"])
        best = F.array_position(p["e"], top).cast("int")
        score = top / F.aggregate(p["e"], F.lit(0.0), lambda a, b: a + b)
        return F.struct((-F.element_at(p["share"], best)).alias("less"), (p["last"] - p["first"]).alias("length"), F.round(-score, 4).alias("doubt"), *[p[c].alias(c) for c in ("first", "last", "at")], F.element_at(names, best).alias("family"), score.alias("score"))

    def apart(kept, p):
        return F.when(F.exists(kept, lambda q: (q["first"] <= p["last"]) & (p["first"] <= q["last"])), kept).otherwise(F.concat(kept, F.array(p)))

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("lines", F.split("text", "\n", -1))
    starts = F.size(F.filter("lines", lambda t, i: t.rlike(INK) & ((i == 0) | ~F.get("lines", i - 1).rlike(INK))))
    none = F.array().cast("array<struct<at:int,words:array<string>,blank:boolean,cued:int>>")
    out = out.select("doc_id", starts.cast("long").alias("n_paragraphs"), F.when(F.lower("text").rlike(cued), F.flatten(F.transform("lines", pieces))).otherwise(none).alias("s"))
    out = out.withColumn("s", F.filter("s", lambda x: x["blank"] | (F.size(x["words"]) > 0)))
    out = out.withColumn("p", F.flatten(F.transform(F.filter(F.sequence(F.lit(0), F.size("s")), lambda i: (i > 0) & enough(F.slice("s", F.greatest(i, F.lit(1)), LONGEST + 1))), units))).drop("s")
    out = out.withColumn("p", F.filter(F.transform(F.filter(F.transform("p", told), lambda p: F.size(p["known"]) >= 2), confirm), lambda p: F.array_max(p["share"]) >= CONFIRM))
    for step in (features, logits, decide):
        out = out.withColumn("p", F.transform("p", step))
    out = out.withColumn("p", F.array_sort(F.filter("p", lambda p: (p["family"] != UNKNOWN) & (p["score"] >= THRESHOLD) & (-p["less"] >= CONFIRM))))
    out = out.withColumn("p", F.aggregate("p", F.filter("p", lambda p: F.lit(False)), apart))
    out = out.withColumn("p", F.array_sort(F.transform("p", lambda p: F.struct(*[p[c].alias(c) for c in ("first", "at", "family", "score")]))))
    return out.select(
        "doc_id", "n_paragraphs", F.size("p").cast("long").alias("n_license"), F.array_join(F.array_sort(F.array_distinct(F.transform("p", lambda p: p["family"]))), ",").alias("families"),
        F.array_join(F.transform("p", lambda p: F.concat_ws(":", p["at"].cast("string"), p["family"])), ",").alias("paragraphs"), F.coalesce(F.array_max(F.transform("p", lambda p: p["score"])), F.lit(0.0)).alias("score"),
    )


def scan_text(text: str | None) -> tuple[int, str, str]:
    """The same decisions in plain Python, for tests: n_license, families, paragraphs."""
    vocabulary, families, w, temperature = model()
    templates, text = _templates(), text or ""
    pieces = []
    for at, line in enumerate(text.split("\n")):
        if not re.search(INK, line):
            pieces.append((at, None))
        else:
            pieces += [(at, words) for t in re.split(SENTENCE, line) if (words := _WORD.findall(t.lower()))]
    hits = []
    for first in range(len(pieces)):
        words, after = [], 0
        for last in range(first, len(pieces)):
            if pieces[last][1] is None or after >= LONGEST:
                break
            words = words + pieces[last][1]
            after += len(pieces[last][1]) if last > first else 0
            share = {f: max(len(set(words) & set(t)) / len(t) for t in lists) for f, lists in templates.items()}
            if max(share.values()) < CONFIRM:
                continue
            z = w[-1].copy()
            for g in {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}:
                if g in vocabulary:
                    z = z + w[vocabulary[g]]
            p = _softmax(z / temperature)
            family = families[int(p.argmax())]
            if family != UNKNOWN and p.max() >= THRESHOLD and share[family] >= CONFIRM:
                hits.append((-share[family], last - first, round(-float(p.max()), 4), first, last, pieces[first][0], family))
    kept = []
    for h in sorted(hits):
        if not any(k[3] <= h[4] and h[3] <= k[4] for k in kept):
            kept.append(h)
    kept.sort(key=lambda h: h[3])
    return len(kept), ",".join(sorted({h[6] for h in kept})), ",".join(f"{h[5]}:{h[6]}" for h in kept)
