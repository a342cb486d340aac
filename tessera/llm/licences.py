"""Licence scan: TF-IDF cosine to licence templates, then inheritance from the
nearest ancestor directory.

Every line of every file, and every window of a template's length, is compared
with the templates by the cosine of sparse TF-IDF vectors; document frequencies
come from the whole corpus. A file whose best line or window reaches its
threshold carries that licence itself. A file that is near a licence's full
text, is named LICENSE or the like, or whose words are in large part notices, is
a licence file, and what it says holds for its directory and all below it, unless a nearer directory says
otherwise: directories are joined by path.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public "
        "License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any "
        "later version.")
_ONLY = "This work is licensed under the GNU {0}General Public License, version {1}."
_CC = ("Licensed under CC {0} {1}.", "This work is licensed under a Creative Commons {2} {1} International License.",
       "creativecommons.org/licenses/{3}/{1}", "Creative Commons {2} {1} International Public License")


def _notices(name: str, *lines: str) -> tuple[str, ...]:
    return (*lines, f"SPDX-License-Identifier: {name}")


def _gnu(name: str, kind: str, version: str, *lines: str) -> tuple[str, ...]:
    spdx = (f"SPDX-License-Identifier: {name}{end}" for end in ("", "-only", "-or-later"))
    return (*lines, _ONLY.format(kind, version), _GNU.format(kind, version), f"GNU {kind}General Public License version {version}",
            f"GNU {kind.upper()}GENERAL PUBLIC LICENSE Version {version}", *spdx)


def _cc(short: str, long: str, version: str = "4.0") -> tuple[str, ...]:
    return _notices(f"CC-{short}-{version}", *(x.format(short, version, long, short.lower()) for x in _CC))


_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted",)
_NAMED = "Use of this source code is governed by a {0} license that can be found in the LICENSE file."

# notices, standard headers and SPDX lines in common use; versions of a licence are rivals
TEMPLATES = {
    "MIT": _notices("MIT", "Released under the MIT License.",
                    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
                    "MIT License Copyright (c)", "Licensed under the MIT license.", _NAMED.format("MIT-style")),
    "Apache-2.0": _notices(
        "Apache-2.0", "Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0, January 2004",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "GPL-3.0": _gnu("GPL-3.0", "", "3"),
    "GPL-2.0": _gnu("GPL-2.0", "", "2"),
    "LGPL-3.0": _gnu("LGPL-3.0", "Lesser ", "3"),
    "LGPL-2.1": _gnu("LGPL-2.1", "Lesser ", "2.1",
                     "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    "AGPL-3.0": _gnu("AGPL-3.0", "Affero ", "3"),
    "BSD-3-Clause": _notices(
        "BSD-3-Clause", *_BSD, "Licensed under the BSD 3-Clause License.", _NAMED.format("BSD-style"),
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."),
    "BSD-2-Clause": _notices("BSD-2-Clause", "Licensed under the BSD 2-Clause License.", "Simplified BSD License"),
    "ISC": _notices("ISC", "Licensed under the ISC License.",
                    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
                    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "Unlicense": _notices("Unlicense", "This is free and unencumbered software released into the public domain.",
                          "Released under the Unlicense."),
    "MPL-2.0": _notices(
        "MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0"),
    "CC0-1.0": _notices("CC0-1.0", "Released under CC0 1.0 Universal.", "CC0 1.0 Universal Public Domain Dedication",
                        "creativecommons.org/publicdomain/zero/1.0"),
    "CC-BY-4.0": _cc("BY", "Attribution"),
    "CC-BY-SA-4.0": _cc("BY-SA", "Attribution-ShareAlike"),
    "CC-BY-NC-4.0": _cc("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-ND-4.0": _cc("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-NC-SA-4.0": _cc("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-4.0": _cc("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    "Proprietary": ("All rights reserved. No part may be reproduced without written permission.", "All rights reserved."),
}
FILE = 0.75  # a file with this cosine to a full text is that licence; one named so needs only the threshold of lines
NAMED_FILE = regex.compile(
    r"(?i)(?!.*\.(?:py|js|ts|java|go|rs|c|h|cc|cpp|rb|php|sh|cs|json|ya?ml|xml)$)(?:(?:un)?licen[cs]es?|copying|copyright)"
    r"(?:[-_][\w.\-]+|\.(?:txt|md|rst|html?|mit|apache|bsd|l?gpl|agpl|mpl|isc|lesser))?|[\w.]+[-_.]licen[cs]e(?:\.(?:txt|md|rst))?")


def full_texts() -> dict[str, tuple[str, ...]]:
    """The licences' full texts, read on the driver. The text of AGPL-3.0 is
    that of GPL-3.0 under its own name, with the section on networks."""
    folder = resources.files(__package__) / "licence_texts"
    texts = {f.name[:-4]: f.read_text(encoding="utf-8") for f in folder.iterdir() if f.name.endswith(".txt")}
    gpl = texts["GPL-3.0"].replace("GNU GENERAL PUBLIC", "GNU AFFERO GENERAL PUBLIC").replace("GNU General", "GNU Affero General")
    texts["AGPL-3.0"] = gpl + """
13. Remote Network Interaction; Use with the GNU General Public License. If you modify the Program, your modified version
must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the
Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge."""
    return {name: (texts[name],) for name in sorted(texts)}


WEAK = frozenset({"Proprietary"})  # "All rights reserved." also stands above the text of open licences
_TERM = regex.compile(r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*")


WINDOW = 0.85  # a window is cut to a template's length: what lies around does not dilute it


def terms(line: str) -> list[str]:
    return _TERM.findall(line.lower())


class Scanner:
    """Templates as unit vectors, and a test that no line below the threshold
    needs to be scored: one whose terms are all common has a cosine of at most
    the norm of the template's common part."""

    def __init__(self, df: dict[str, int], n: int, templates: dict, least: float) -> None:
        self.least, self.n = least, n
        self.rows = [(name, terms(line)) for name, lines in templates.items() for line in lines]
        self.idf = {t: float(np.log((1 + n) / (1 + df.get(t, 0))) + 1) for _, ts in self.rows for t in ts}
        self.other = float(np.log(1 + n) + 1)  # a term of no template: as rare as can be
        self.of_term: dict[str, list[tuple[int, float]]] = {}
        self.vectors = []
        for name, ts in self.rows:
            v = {t: c * self.idf[t] for t, c in Counter(ts).items()}
            norm = float(np.sqrt(sum(x * x for x in v.values())))
            for t, x in v.items():
                self.of_term.setdefault(t, []).append((len(self.vectors), x / norm))
            self.vectors.append((name, {t: x / norm for t, x in v.items()}))
        self.place = {t: i for i, t in enumerate(self.idf)}
        self.weights = np.array([*self.idf.values(), self.other])
        self.length = [len(ts) for _, ts in self.rows]
        self.dense = np.zeros((len(self.vectors), len(self.idf) + 1))
        self.squares = np.zeros((len(self.vectors), len(self.idf)))
        for j, (_, v) in enumerate(self.vectors):
            self.squares[j, [self.place[t] for t in v]] = [x * x for x in v.values()]
            self.dense[j, [self.place[t] for t in v]] = [x * self.idf[t] for t, x in v.items()]
        # the most common terms, as long as they alone reach the threshold in no template
        self.rare = set(self.idf)
        for t in sorted(self.idf, key=self.idf.get):
            common = (set(self.idf) - self.rare) | {t}
            if max(sum(x * x for u, x in v.items() if u in common) for _, v in self.vectors) >= least * least * 0.999:
                break
            self.rare.discard(t)

    def best(self, line: str) -> tuple[str, float, int] | None:
        """(licence, cosine, terms) of the nearest template that reaches the threshold."""
        return self._best(terms(line))

    def _best(self, found: list[str]) -> tuple[str, float, int] | None:
        if self.rare.isdisjoint(found):
            return None
        norm, dot = 0.0, [0.0] * len(self.vectors)
        for t, c in Counter(found).items():
            x = c * self.idf.get(t, self.other)
            norm += x * x
            for j, w in self.of_term.get(t, ()):
                dot[j] += x * w
        at = max(range(len(dot)), key=lambda j: (dot[j], [-ord(c) for c in self.vectors[j][0]]))
        top = dot[at] / float(np.sqrt(norm))
        return (self.vectors[at][0], top, len(found)) if top >= self.least else None

    def windows(self, found: list[str], least: float) -> Iterator[tuple[str, float, int, int]]:
        """(licence, cosine, first, last) of each template's best window of its
        own length, if it reaches ``least``: a notice within a long line, or one
        that runs over several lines."""
        at = np.fromiter((self.place.get(t, -1) for t in found), dtype=np.int64, count=len(found))
        weight = self.weights[at]
        sums = np.r_[0.0, np.cumsum(weight * weight)]
        # as no template reaches the threshold with its common terms alone, those without a rare one here are out
        for j in sorted({j for t in self.rare.intersection(found) for j, _ in self.of_term[t]}):
            name, m = self.vectors[j][0], self.length[j]
            if m > len(found):
                continue
            c = np.r_[0.0, np.cumsum(self.dense[j][at])]
            dot = c[m:] - c[:-m]
            # terms that repeat make the norm larger than the sum of squares, so this is the most it can be
            if not (dot >= least * 0.999999 * np.sqrt(sums[m:] - sums[:-m])).any():
                continue
            norm, seen, squares = 0.0, Counter(), np.empty(len(dot))
            for i, t in enumerate(found):
                if i >= m:
                    seen[found[i - m]] -= 1
                    norm -= weight[i - m] ** 2 * (2 * seen[found[i - m]] + 1)
                norm += weight[i] ** 2 * (2 * seen[t] + 1)
                seen[t] += 1
                if i >= m - 1:
                    squares[i - m + 1] = norm
            cosine = dot / np.sqrt(squares)
            i = int(cosine.argmax())
            if cosine[i] >= least:
                yield name, float(cosine[i]), i, i + m

    def whole(self, found: list[str], least: float) -> tuple[str, float] | None:
        """(licence, cosine) of the full text nearest to a whole file."""
        shared = [self.place[t] for t in self.idf.keys() & set(found)]
        # the terms that a text shares with the file bound the cosine
        if not shared or (self.squares[:, shared].sum(axis=1) < least * least * 0.999).all():
            return None
        count = Counter(found)
        v = {t: c * self.idf.get(t, self.other) for t, c in count.items()}
        norm = float(np.sqrt(sum(x * x for x in v.values())))
        top, name = max(((sum(x * u.get(t, 0) for t, x in v.items()) / norm, name) for name, u in self.vectors))
        return (name, top) if top >= least else None

    def scan(self, text: str) -> tuple[str | None, float, float]:
        """(licence, cosine, share of the file's terms in licence lines). The
        best line or window counts; of equals the first. A weak licence counts
        only where there is no other."""
        lines = [terms(line) for line in text.split("\n")]
        found = [t for line in lines for t in line]
        if self.rare.isdisjoint(found):
            return None, 0.0, 0.0
        inside, at, got = np.zeros(len(found), dtype=bool), 0, []
        for line in lines:
            best = self._best(line) if len(self.idf.keys() & set(line)) > 1 else None  # one word is a name, not a notice
            if best:
                inside[at:at + len(line)] = True
                got.append((best[0], best[1]))
            at += len(line)
        for name, cosine, a, z in self.windows(found, WINDOW):
            inside[a:z] = True
            got.append((name, cosine))
        if not got:
            return None, 0.0, 0.0
        name, top = max(got, key=lambda x: (x[0] not in WEAK, round(x[1], 9)))
        return name, top, float(inside.mean())


def _frequencies(batches: Iterator[pa.RecordBatch], vocabulary: frozenset) -> Iterator[pa.RecordBatch]:
    df, n = Counter(), 0
    for b in batches:
        for t in b.column("_text"):
            for line in t.as_py().lower().split("\n"):
                n += 1
                df.update(vocabulary.intersection(_TERM.findall(line)))
    if n:
        yield pa.RecordBatch.from_pydict({"term": ["", *df], "n": pa.array([n, *df.values()], pa.int64())})


def scan_file(path: str | None, text: str, scanner: Scanner, full: Scanner) -> tuple[str | None, float, float, bool]:
    """(licence, cosine, share of licence lines, whether the full text or the
    file's name says that it is a licence file)."""
    named = path is not None and NAMED_FILE.fullmatch(path.rsplit("/", 1)[-1]) is not None
    got = full.whole(terms(text), scanner.least if named else full.least)
    if got:
        return *got, 1.0, True
    name, cosine, share = scanner.scan(text)
    return name, cosine, share, named and name is not None


def _scan(batches: Iterator[pa.RecordBatch], scanner: Scanner, full: Scanner) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [scan_file(p.as_py(), t.as_py(), scanner, full) for p, t in zip(b.column("_path"), b.column("_text"))]
        if got:
            name, cosine, share, file = zip(*got, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_path"), pa.array(name, pa.string()),
                                              pa.array(cosine, pa.float64()), pa.array(share, pa.float64()),
                                              pa.array(file, pa.bool_())],
                                             names=["_id", "_path", "own", "cosine", "share", "file"])


def directory(path: Column) -> Column:
    """All before the last slash; the top is the empty string."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def ancestors(path: Column) -> Column:
    """A path's directory and all above it, nearest first: the top last."""
    parts = F.split(directory(path), "/")
    n = F.size(parts)
    return F.when(directory(path) == "", F.array(F.lit(""))).otherwise(F.concat(
        F.transform(F.sequence(n, F.lit(1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")),
        F.array(F.lit(""))))


def scan_licences(files: DataFrame, id_col: str, path_col: str, text_col: str, least: float = 0.6,
                  file_share: float = 0.5, templates: dict = TEMPLATES, texts: dict | None = None) -> DataFrame:
    """Per row of ``files``: id, path, own (the licence its text carries, or
    null), cosine, licence_file, licence (its own, else the nearest
    directory's), licence_from (the directory, null if its own or none).
    A licence file is one near a full text (``texts``, by default
    :func:`full_texts`), one that is named so and carries a licence, or one of
    whose terms ``file_share`` lie in notices.

    Null and empty texts carry none. A null path has no directory and inherits
    nothing. Of several licence files in one directory that with the highest
    cosine speaks for it, of equals the smallest path, then name. Rows that
    repeat are scanned alike. An empty table gives an empty table."""
    rows = files.select(F.col(id_col).alias("_id"), F.col(path_col).alias("_path"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    vocabulary = frozenset(t for lines in templates.values() for line in lines for t in terms(line))
    texts = full_texts() if texts is None else texts
    vocabulary |= frozenset(t for lines in texts.values() for text in lines for t in terms(text))
    counts = rows.select("_text").mapInArrow(lambda b: _frequencies(b, vocabulary), "term string, n long")
    df = {r["term"]: r["n"] for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # the vocabulary at most
    scanner = Scanner(df, df.get("", 0), templates, least)
    full = Scanner(df, df.get("", 0), texts, FILE)
    id_type = files.schema[id_col].dataType.simpleString()
    own = saved(rows.mapInArrow(lambda b: _scan(b, scanner, full),
                                f"_id {id_type}, _path string, own string, cosine double, share double, file boolean"), "licences")
    own = own.withColumn("licence_file", F.col("own").isNotNull() & (F.col("file") | (F.col("share") >= file_share)))
    speaks = own.where("licence_file and _path is not null").groupBy(directory(F.col("_path")).alias("_dir")).agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), F.col("_path").alias("p"), F.col("own").alias("o"))).alias("_b"))
    speaks = speaks.select("_dir", F.col("_b.o").alias("_said"))
    # directories, not files, are joined with the directories above them
    below = own.where("own is null and _path is not null").select(directory(F.col("_path")).alias("_at")).distinct()
    up = below.select("_at", F.posexplode(ancestors(F.concat("_at", F.lit("/x")))).alias("_far", "_dir"))
    nearest = up.join(speaks, "_dir").groupBy("_at").agg(F.min(F.struct("_far", "_dir", "_said")).alias("_n"))
    nearest = nearest.select("_at", F.col("_n._said").alias("_said"), F.col("_n._dir").alias("_from"))
    own = own.withColumn("_in", F.when(F.col("own").isNull(), directory(F.col("_path"))))
    out = own.join(nearest, F.col("_in") == F.col("_at"), "left")
    return out.select(F.col("_id").alias(id_col), F.col("_path").alias("path"), "own", "cosine", "licence_file",
                      F.coalesce("own", "_said").alias("licence"), F.col("_from").alias("licence_from"))
