"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance from ancestor directories.

Inverse document frequencies of the templates' words are counted over all files; a word no template has gets their mean.
The whole text is compared with full licence texts (``license_texts``) and with notices, every line and paragraph that
names a licence with notices, by sparse vectors. A full text is a licence file; a notice is one in a file named like a
licence file or without a path, and a header elsewhere. A file without a licence of its own inherits that of the nearest directory
above it that holds a licence file: distinct directories are joined with the ancestors of their paths, then files with
their directory, so a directory with many files is resolved once.

Defined cases: null and empty texts have no licence of their own; a null path is a file outside every directory; equal
cosines go to the template first by name; rows with the same path are rows of their own; other columns pass through;
an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.lineage import cut
from tidemark.llm.common import set_aside

HEADER_LEAST, FILE_LEAST = 0.6, 0.6
# A full text in a file of another name must come closer, as short code below a long header is no licence file.
FULL_LEAST, FULL_LEAST_ELSEWHERE = 0.8, 0.9
SPREAD = 64
WORD = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")
CUE = re.compile(r"licen[sc]|copyright|spdx|public domain|redistribut|permission is hereby|all rights reserved", re.I)

# Public notices and the opening words of public licence texts.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
                   "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
                   "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "BSD-2-Clause": ["SPDX-License-Identifier: BSD-2-Clause", "Licensed under the BSD 2-Clause License.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BSD-3-Clause": ["SPDX-License-Identifier: BSD-3-Clause", "Licensed under the BSD 3-Clause License.",
                     "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["SPDX-License-Identifier: CC0-1.0", "Released into the public domain under CC0 1.0 Universal."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "Proprietary": ["Copyright. All rights reserved.", "All rights reserved. Unauthorised copying of this file is strictly prohibited."],
}
NAMED = re.compile(r"(?:^|/)(?:[^/]*[._-])?(?:(?:un)?licen[sc]es?|copying)(?:[._-][^/]*)?$", re.I)
PARAGRAPH = re.compile(r"\n(?:[^\w\n]*\n)+")
OWN = [T.StructField("own_license", T.StringType()), T.StructField("own_score", T.DoubleType()),
       T.StructField("own_kind", T.StringType())]


def full_texts() -> dict[str, list[str]]:
    """Full texts of public licences by name."""
    return {p.stem: [p.read_text("utf-8")] for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Templates:
    """Weighted unit vectors of all templates over their own vocabulary."""

    def __init__(self, frequencies: dict[str, int], n_files: int, templates: dict[str, list[str]]):
        self.rows = sorted((name, text) for name, texts in templates.items() for text in texts)
        self.number = {w: i for i, w in enumerate(sorted({w for _, text in self.rows for w in words(text)}))}
        self.idf = np.array([math.log((n_files + 1) / (frequencies.get(w, 0) + 1)) + 1 for w in self.number])
        self.other = float(self.idf.mean()) if len(self.idf) else 1.0
        self.matrix = np.array([self._inside(words(text)) for _, text in self.rows]).reshape(len(self.rows), len(self.number))
        self.matrix /= np.maximum(np.linalg.norm(self.matrix, axis=1, keepdims=True), 1e-12)

    def _inside(self, found: list[str]) -> np.ndarray:
        known = [self.number[w] for w in found if w in self.number]
        return np.bincount(known, minlength=len(self.number)) * self.idf if known else np.zeros(len(self.number))

    def best(self, found: list[str], least: float) -> tuple[str, float] | None:
        """The closest template and its cosine, if it is at least ``least``."""
        inside = self._inside(found)
        square = float(inside @ inside)
        strangers = [w for w in found if w not in self.number]
        # A stranger occurring n times adds n squared, at least n: often enough to rule a text out without counting.
        if not square or square < least * least * (square + self.other ** 2 * len(strangers)):
            return None
        square += self.other ** 2 * sum(n * n for n in Counter(strangers).values())
        cosines = self.matrix @ inside / math.sqrt(square)
        at = int(cosines.argmax())
        return (self.rows[at][0], float(cosines[at])) if cosines[at] >= least else None


class Matcher:
    """Notices and full texts."""

    def __init__(self, frequencies: dict[str, int], n_files: int, notices: dict[str, list[str]], full: dict[str, list[str]]):
        self.notices, self.full = Templates(frequencies, n_files, notices), Templates(frequencies, n_files, full)

    def own(self, text: str, path: str | None = None) -> tuple[str, float, str] | None:
        """Licence of a file's own text: the whole text if it is one, else its best header line or paragraph."""
        if not CUE.search(text):
            return None
        found, named = words(text), path is None or bool(NAMED.search(path))
        whole = self.full.best(found, FULL_LEAST)
        if whole:
            return (*whole, "file" if named or whole[1] >= FULL_LEAST_ELSEWHERE else "header")
        whole = self.notices.best(found, FILE_LEAST)
        if whole:
            return (*whole, "file" if named else "header")
        pieces = [p for p in text.split("\n") if CUE.search(p)] + [p for p in PARAGRAPH.split(text) if "\n" in p and CUE.search(p)]
        scored = [x for x in (self.notices.best(words(p), HEADER_LEAST) for p in pieces) if x]
        kind = "file" if path is not None and named else "header"
        return max(((*x, kind) for x in scored), key=lambda x: (x[1], [-ord(c) for c in x[0]]), default=None)


def frequencies(files: DataFrame, vocabulary: set[str], text: str = "text") -> tuple[dict[str, int], int]:
    """In how many of all files each word of the templates occurs, and how many files there are."""
    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            counts[""] += batch.num_rows
            for value in batch.column("text").to_pylist():
                counts.update(vocabulary.intersection(words(value or "")))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    table = (files.select(F.col(text).alias("text")).mapInArrow(run, "word string, n bigint")
             .groupBy("word").agg(F.sum("n").alias("n")))
    found = {r["word"]: r["n"] for r in table.collect()}  # at most one row for each word of the templates
    return found, found.pop("", 0)


def own_licenses(files: DataFrame, text: str = "text", templates: dict[str, list[str]] = TEMPLATES,
                 path: str | None = None) -> DataFrame:
    """``files`` with own_license, own_score and own_kind (file, header or null)."""
    full = full_texts()
    vocabulary = {w for texts in (*templates.values(), *full.values()) for t in texts for w in words(t)}
    shared = files.sparkSession.sparkContext.broadcast(Matcher(*frequencies(files, vocabulary, text), templates, full))

    def run(batches):
        for batch in batches:
            paths = batch.column(path).to_pylist() if path else [None] * batch.num_rows
            found = [shared.value.own(t or "", p) or (None, None, None) for t, p in zip(batch.column(text).to_pylist(), paths)]
            names, scores, kinds = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(kinds, pa.string())],
                [*batch.schema.names, *(f.name for f in OWN)])

    return files.mapInArrow(run, T.StructType(files.schema.fields + OWN))


def directory(path: Column) -> Column:
    """What stands before the last slash; empty for a file at the top, null for a null path."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors(folder: Column) -> Column:
    """A directory and all above it, the top included, with their depths."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(
        i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("above")))


RESULTS = ["own_license", "own_score", "own_kind", "license", "inherited_from"]


def scan(files: DataFrame, path: str = "path", text: str = "text", templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """``files`` without their text, with their own licence, the licence that holds, and where it comes from. Columns of the same
    names as results are returned as ``source_…``."""
    files = set_aside(files, RESULTS)
    # Texts are read once; what is left of a file is a few short columns, written out because three steps read it.
    folder = F.col("__folder")
    own = cut(own_licenses(files, text, templates, path).drop(text).withColumn("__folder", directory(F.col(path))))
    holders = own.where((F.col("own_kind") == "file") & folder.isNotNull()).groupBy(folder.alias("above")).agg(
        F.max_by("own_license", F.struct("own_score", "own_license")).alias("dir_license"))
    folders = own.select("__folder").where(folder.isNotNull()).distinct()
    each = folders.select("__folder", F.inline(ancestors(folder)))
    nearest = each.join(holders, "above").groupBy("__folder").agg(
        F.max_by(F.struct("dir_license", "above"), "depth").alias("__nearest"))
    own_first = F.coalesce("own_license", F.col("__nearest")["dir_license"])
    origin = F.when(F.col("own_license").isNull(), F.col("__nearest")["above"])
    # A directory may hold a third of all files: its one row is copied for each of SPREAD keys, among which its files are dealt.
    # Files without a path inherit nothing and take no part.
    copies = nearest.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    dealt = own.where(folder.isNotNull()).withColumn("__part", F.pmod(F.xxhash64(path), F.lit(SPREAD)).cast("int"))
    alone = own.where(folder.isNull()).withColumn("__nearest", F.lit(None).cast(nearest.schema["__nearest"].dataType))
    joined = dealt.join(copies, ["__folder", "__part"], "left").drop("__part")
    return joined.unionByName(alone).select(
        *[c for c in files.columns if c != text], "own_license", "own_score", "own_kind", own_first.alias("license"),
        origin.alias("inherited_from"))
