"""License scans by conditional compression.

A block is a paragraph, cut at empty lines, or a part of it where it is long, with overlap. The blocks of paragraphs
that hold a cue word are candidates. A candidate is compressed alone and with each template as a zstandard raw dictionary,
and templates are ranked by what they save; those that save nothing are out. The ranked ones are confirmed by exact
differences in wording: the stretch that fits best, the words that it adds and misses, and what it saves by itself.
A difference in a word that decides (a version, a clause, a negation) refuses the template, whatever else agrees.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm import common as C

#: Names and notices of common licenses.
TEMPLATES = {
    "All-rights-reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "GPL-3.0-notice": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-notice": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-notice": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-notice": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-notice": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-3.0": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX-GPL-2.0-only": "SPDX-License-Identifier: GPL-2.0-only",
    "SPDX-GPL-3.0-only": "SPDX-License-Identifier: GPL-3.0-only",
    "SPDX-BSD-3-Clause": "SPDX-License-Identifier: BSD-3-Clause",
}
#: Words that tell licenses apart, besides numbers; and what turns a notice into its opposite.
DECIDING = frozenset(
    "lesser library affero noncommercial nc noderivatives noderivs nd sharealike sa only mit apache bsd isc mozilla gnu creative commons "
    "attribution unported unencumbered gpl lgpl agpl mpl cc".split()
)
NEGATIONS = frozenset("not never no without isn aren".split())
_NUMBER = re.compile(r"v?[0-9]+(?:\.[0-9]+)*$")
#: Words before a stretch that may turn it around.
BEFORE = 3
#: Between words of a cue there may be a line's end and a comment's marks.
CUE = r"(?i)licen[sc]e|all[\W_]+rights[\W_]+reserved|permission[\W_]+(?:is[\W_]+hereby|to[\W_]+use)|redistribution[\W_]+and[\W_]+use|creative[\W_]+commons|public[\W_]+domain|cc[\W_]+by|copyright|spdx"
BLOCK_CHARS, OVERLAP, LEAST_SAVING, LEAST_WORDS = 2000, 400, 0.25, 0.8
_WORD = re.compile(r"(?ai)[a-z0-9]+(?:\.[a-z0-9]+)*")  # hyphens part words, as lines may end after one
_CUE = re.compile(CUE)
_EMPTY = re.compile(r"\n[^\S\n]*(?=\n)")


def blocks(text: str, longest: int = 0) -> list[tuple[int, str]]:
    """(start, block) of every candidate: paragraphs with a cue, cut so that a stretch of twice ``longest`` is in one block."""
    overlap = max(OVERLAP, 2 * longest)
    size = max(BLOCK_CHARS, 2 * overlap)
    out, at = [], 0
    for end in [*(m.start() for m in _EMPTY.finditer(text)), len(text)]:
        if _CUE.search(text, at, end):
            out += [(i, text[i : min(i + size, end)]) for i in range(at, max(at + 1, end - overlap), size - overlap)]
        at = end
    return out


def aligned(have: list[str], want: list[str], price: float, miss: float) -> list[tuple[int, int]]:
    """Local alignment: (place in ``have``, place in ``want``) of the words matched; a match counts 1, an added word ``-price``, a missing one ``-miss``."""
    width = len(want) + 1
    score, back, best = [0.0] * width, [], (0.0, -1, -1)
    for i, h in enumerate(have):
        row, steps = [0.0] * width, bytearray(width)
        for j in range(1, width):
            x, step = 0.0, 0
            if h == want[j - 1]:
                x, step = score[j - 1] + 1, 1
            if score[j] - price > x:
                x, step = score[j] - price, 2
            if row[j - 1] - miss > x:
                x, step = row[j - 1] - miss, 3
            row[j], steps[j] = x, step
            if step == 1 and x > best[0]:
                best = (x, i, j)
        score = row
        back.append(steps)
    out, (_, i, j) = [], best
    while i >= 0 and j > 0 and (step := back[i][j]):
        if step == 1:
            out.append((i, j - 1))
        i, j = i - (step < 3), j - (step != 2)
    return out[::-1]


def decided(added: list[str], missing: list[str], before: list[str]) -> bool:
    """Whether the wording differs where it decides: another number or license word, or a negation."""
    words = [*added, *missing]
    if any(w in DECIDING or _NUMBER.match(w) for w in words):
        return True
    return bool(NEGATIONS.intersection(words)) or bool(NEGATIONS.intersection(before))


class Scanner:
    def __init__(self, templates: dict[str, str], level: int = 3) -> None:
        import zstandard as z

        self.words = {name: _WORD.findall(t.lower()) for name, t in templates.items()}
        self.longest = max(map(len, templates.values()), default=0)
        self.plain = z.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)
        # A raw-content dictionary: matches may reach back into the template's bytes.
        self.primed = {n: z.ZstdCompressor(level=level, write_content_size=False, write_checksum=False, dict_data=z.ZstdCompressionDict(t.lower().encode(), dict_type=z.DICT_TYPE_RAWCONTENT)) for n, t in templates.items()}

    def saving(self, stretch: str, name: str) -> float:
        """Share of the template's bytes that the stretch no longer needs."""
        raw = " ".join(stretch.lower().split()).encode()
        alone = len(self.plain.compress(raw))
        return (alone - len(self.primed[name].compress(raw))) / max(1, min(alone, sum(map(len, self.words[name]))))

    def differences(self, have: list[str], name: str) -> tuple[int, int, list[str], list[str]] | None:
        """The stretch of ``have`` (first and end) that the template fits best, words it adds and words it misses; None where none fits."""
        want = self.words[name]
        # No stretch can have more of the template's words than the block.
        if sum((Counter(have) & Counter(want)).values()) < LEAST_WORDS * len(want):
            return None
        for price, miss in ((0.5, 0.5), (0.25, 0.0)):  # the closest stretch; else one with more between its parts
            match = aligned(have, want, price, miss)
            if match and len(match) >= LEAST_WORDS * len(want):
                first, end = match[0][0], match[-1][0] + 1
                inside, found = {i for i, _ in match}, {j for _, j in match}
                added = [have[i] for i in range(first, end) if i not in inside]
                missing = [w for j, w in enumerate(want) if j not in found]
                if len(added) <= len(want) and not decided(added, missing, have[max(0, first - BEFORE) : first]):
                    return first, end, added, missing
        return None

    def ranked(self, block: str) -> list[str]:
        """The templates that save bytes of the whole block, the most first."""
        raw = " ".join(block.lower().split()).encode()
        alone = len(self.plain.compress(raw))
        saved = {n: alone - len(self.primed[n].compress(raw)) for n in self.words}
        return sorted((n for n in saved if saved[n] > 0), key=lambda n: (-saved[n], n))

    def best(self, block: str) -> tuple | None:
        """(start, end, license, saving, added, missing) of the template that fits the block best; ties by saving, then name."""
        at = [m.span() for m in _WORD.finditer(block)]
        have = [block[i:j].lower() for i, j in at]
        found = []
        for name in self.ranked(block):
            want = self.words[name]
            if fit := self.differences(have, name):
                start, end, added, missing = at[fit[0]][0], at[fit[1] - 1][1], *fit[2:]
                if (saving := self.saving(block[start:end], name)) >= LEAST_SAVING:
                    found.append((len(added) + 2 * len(missing) - len(want), -saving, name, start, end, added, missing))
        if not found:
            return None
        _, saving, name, start, end, added, missing = min(found)
        return start, end, name, -saving, added, missing

    def scan(self, text: str) -> list[dict]:
        """All stretches that are confirmed and do not overlap, by place: what stands before and after one is searched again."""
        out, done = [], 0
        found = blocks(text, self.longest)
        for (start, block), (after, _) in zip(found, [*found[1:], (len(text), "")], strict=True):
            # What the last block has given is not searched again in the overlap; what begins there is left to the next block.
            todo = [(max(start, done), block[max(0, done - start) :])]
            while todo:
                start, block = todo.pop()
                if fit := self.best(block):
                    first, end, name, saving, added, missing = fit
                    if start + first < after:
                        out.append({"license": name, "start": start + first, "length": end - first, "saving": round(saving, 4), "exact": not added and not missing, "added": added, "missing": missing})
                        done = max(done, start + end)
                    todo += [(start, block[:first]), (start + end, block[end:])]
        return sorted(out, key=lambda x: x["start"])


FOUND = "array<struct<license: string, start: long, length: long, saving: double, exact: boolean, added: array<string>, missing: array<string>>>"
_ARROW = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("saving", pa.float64()), ("exact", pa.bool_()), ("added", pa.list_(pa.string())), ("missing", pa.list_(pa.string()))]))


def _scan(templates: dict[str, str]):
    def run(batches):
        scanner = Scanner(templates)
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                out.append(scanner.scan(t) if t and _CUE.search(t) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _ARROW)], names=["doc_id", "found"])

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id and found, the confirmed licenses with place, saving and wording differences.

    Null and empty texts and texts without cue words have an empty array. Very long texts are read whole, block by block.
    Repeated rows each give their row; an empty table gives none; other columns do not matter. Ties in savings go to the
    smaller name.
    """
    C.small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan(dict(templates or TEMPLATES)), f"doc_id long, found {FOUND}")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(C.load(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.size("found").cast("long").alias("n_licenses"), F.array_join(F.array_sort(F.array_distinct("found.license")), ",").alias("licenses"),
        F.aggregate("found", F.lit(0).cast("long"), lambda s, x: s + x["exact"].cast("long")).alias("n_exact"),
        F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["length"].cast("string"))), ",").alias("spans"),
    )
