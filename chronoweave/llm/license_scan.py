"""License scans of files, with inheritance down directories.

Blocks that hold a licence cue (lines, sentences and paragraphs), and every window of a
template's own length in the passages around cues, across line breaks, are compared with
templates by sparse TF-IDF cosine, so a notice is found wherever it stands.  Document
frequencies are counted over all blocks and passages of all files; only those of template
words are kept, so their number has a bound, and other words take the weight of a word seen
once.  A notice that names its licence must hold the name's words: short windows that
differ in the name alone come near each other.  Tags of source files are templates too.
A file's licence is that of its best block or window.  A file without one takes that of the
nearest ancestor directory, its own first, that holds a licence file: one named like a
licence, or of whose words at least a fifth stand in a block or window of that licence.

Ancestors are joined by path once per directory, not per file.

Defined results: null or empty texts have no licence of their own; a null path has no
directory; equal scores go to the template that comes first by name; a directory's several
licences to the best score, then the name; repeated rows give repeated rows;
columns named like those added are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._rows import extend
from ._store import join_small, save

_COPIES = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_HEADER = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_CC = "By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons {} 4.0 International Public License"

#: Notices, the passages of standard headers, and those that licence files begin with or hold.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-2-Clause": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "BSD header": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released under CC0 1.0 Universal public domain dedication.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "MPL-2.0": "Licensed under the Mozilla Public License, version 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "AGPL-3.0 header": _HEADER.format("program", "Affero General Public License", "3"),
    "AGPL-3.0 text": f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_COPIES}",
    "Apache-2.0 text": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "CC-BY-4.0 header": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0 text": _CC.format("Attribution"),
    "CC-BY-NC-4.0 header": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-4.0 text": _CC.format("Attribution-NonCommercial"),
    "CC-BY-SA-4.0 header": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0 text": _CC.format("Attribution-ShareAlike"),
    "CC0-1.0 text": "CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP.",
    "GPL-2.0 header": _HEADER.format("program", "General Public License", "2"),
    "GPL-2.0 text": f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA {_COPIES}",
    "GPL-3.0 header": _HEADER.format("program", "General Public License", "3"),
    "GPL-3.0 text": f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_COPIES}",
    "ISC text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1 header": _HEADER.format("library", "Lesser General Public License", "2.1"),
    "LGPL-2.1 text": f"GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA {_COPIES}",
    "LGPL-3.0 header": _HEADER.format("library", "Lesser General Public License", "3"),
    "LGPL-3.0 text": f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> {_COPIES}",
    "MIT text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "MPL-2.0 text": "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
}
TEMPLATES["BSD-3-Clause text"] = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
#: Tags of source files, for each licence and the forms of its name.
TAGS = {f"{name}{form} tag": f"SPDX-License-Identifier: {name}{form}" for name in dict.fromkeys(n.partition(" ")[0] for n in TEMPLATES if n.partition(" ")[0] != "BSD") for form in (("", "-only", "-or-later") if "GPL" in name else ("",))}
#: What a licence block holds, and how licence files are named.
CUE = re.compile(r"licen[sc]e|neither\W+the\W+name|permission\W+is\W+hereby\W+granted|permission\W+to\W+use|redistribution\W+and\W+use|public\W+domain|creative\W+commons")
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|unlicense)([._-].*)?$"
#: A dot inside a word stands before a digit, so that a word glued to the end of a sentence is its own.
_WORD = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+|\.[0-9]+)*")
_BREAK = re.compile(r"(?<=[.!?])\s+|\n\s*\n")
#: Words of a template's licence that a block or window must hold.
NAMES = {
    "AGPL-3.0": ("affero",), "Apache-2.0": ("apache",), "Apache-2.0 header": ("apache",), "BSD-2-Clause": ("bsd",), "BSD-3-Clause": ("bsd",),
    "CC-BY-4.0": ("cc", "by"), "CC-BY-NC-4.0": ("by-nc",), "CC-BY-SA-4.0": ("by-sa",), "CC0-1.0": ("cc0",), "GPL-2.0": ("general",), "GPL-3.0": ("general",),
    "ISC": ("isc",), "LGPL-3.0": ("lesser",), "MIT": ("mit",), "MPL-2.0": ("mozilla",), "MPL-2.0 header": ("mozilla",), "MPL-2.0 text": ("mozilla",), "Apache-2.0 text": ("apache",), "CC0-1.0 text": ("cc0",),
    "AGPL-3.0 header": ("affero",), "AGPL-3.0 text": ("affero",), "GPL-2.0 header": ("general",), "GPL-2.0 text": ("general",), "GPL-3.0 header": ("general",), "GPL-3.0 text": ("general",),
    "LGPL-2.1 header": ("lesser",), "LGPL-2.1 text": ("lesser",), "LGPL-3.0 header": ("lesser",), "LGPL-3.0 text": ("lesser",),
    "CC-BY-4.0 header": ("attribution",), "CC-BY-4.0 text": ("attribution",), "CC-BY-NC-4.0 header": ("attribution-noncommercial",), "CC-BY-NC-4.0 text": ("attribution-noncommercial",),
    "CC-BY-SA-4.0 header": ("attribution-sharealike",), "CC-BY-SA-4.0 text": ("attribution-sharealike",),
}
NAMES |= {name: tuple(t.lower().split()[1:]) for name, t in TAGS.items()}
#: Words of another licence's name, which a block or window must not hold.
OTHERS = {name: ("lesser", "affero") for name in TEMPLATES if name.startswith("GPL")}
#: Longer blocks than any template are not compared as wholes; their windows are.
BLOCK_WORDS = 400
THRESHOLD = 0.8


def license_of(template: str) -> str:
    """The licence of a template; the conditions that both BSD licences begin with are the shorter one's."""
    if template.endswith(" tag"):
        return template.removesuffix(" tag").removesuffix("-only").removesuffix("-or-later")
    return "BSD-2-Clause" if template == "BSD header" else template.removesuffix(" header").removesuffix(" text")


def terms(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def blocks(text: str) -> list[str]:
    """Lines, sentences and paragraphs with a cue, each once, up to BLOCK_WORDS words."""
    low = text.lower()
    if not CUE.search(low):
        return []
    cut = [*low.split("\n"), *_BREAK.split(low), *re.split(r"\n\s*\n", low)]
    return list(dict.fromkeys(x for x in cut if CUE.search(x) and len(x.split()) <= BLOCK_WORDS))


def passages(text: str) -> list[str]:
    """The words around cues, as far as a template that holds the cue can reach; those that overlap are one."""
    low = text.lower()
    cues = [m.span() for m in CUE.finditer(low)]
    if not cues:
        return []
    spans = [m.span() for m in _WORD.finditer(low)]
    starts, ends = np.array([a for a, _ in spans]), np.array([b for _, b in spans])
    reach, out = max(LENGTHS.values()), []
    for a, b in cues:
        i, j = max(0, int(np.searchsorted(ends, a, "right")) - reach), int(np.searchsorted(starts, b)) + reach
        if out and i <= out[-1][1]:
            out[-1][1] = j
        else:
            out.append([i, j])
    return [" ".join(low[x:y] for x, y in spans[i:j]) for i, j in out]


def best_windows(words: list[str], vectors: dict[str, dict[str, float]], idf: dict[str, float], rare: float, threshold: float) -> list[tuple[float, str, int]]:
    """(score, template, words) of each template's best window of its own length, where that reaches ``threshold``.

    A window's norm is least where no word repeats, which bounds its cosine from above; only
    windows whose bound reaches the threshold and the best so far are compared exactly.
    """
    out, n = [], len(words)
    there = set(words)
    each = np.array([idf.get(w, rare) for w in words])
    norms = np.concatenate([[0.0], np.cumsum(each * each)])
    for name, t in vectors.items():
        if not all(w in there for w in NAMES.get(name, ())):
            continue
        size = min(n, LENGTHS[name])
        dots = np.concatenate([[0.0], np.cumsum([t.get(w, 0.0) for w in words] * each)])
        bound = (dots[size:] - dots[: n - size + 1]) / np.sqrt(np.maximum(norms[size:] - norms[: n - size + 1], 1e-12))
        likely = np.flatnonzero(bound >= threshold - 1e-6)
        best = 0.0
        for i in likely[np.argsort(-bound[likely], kind="stable")]:
            if best >= bound[i] + 1e-6:
                break
            best = max(best, cosine(words[i : i + size], name, t, idf, rare))
        if best >= threshold:
            out.append((best, name, size))
    return out


def weights(words: list[str], idf: dict[str, float], rare: float) -> dict[str, float]:
    v = {w: n * idf.get(w, rare) for w, n in Counter(words).items()}
    norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
    return {w: x / norm for w, x in v.items()}


def inverse_frequencies(df: dict[str, int], n: int) -> tuple[dict[str, float], float]:
    """Smoothed idf of template words, and that of any other word."""
    of = lambda k: math.log((1 + n) / (1 + k)) + 1
    return {w: of(df.get(w, 0)) for t in (*TEMPLATES.values(), *TAGS.values()) for w in terms(t)}, of(1)


def cosine(words: list[str], name: str, template: dict[str, float], idf: dict[str, float], rare: float) -> float:
    """Zero where a word of the licence's name is missing, or one of another's is there."""
    return _cosine(weights(words, idf, rare), name, template)


def _cosine(v: dict[str, float], name: str, template: dict[str, float]) -> float:
    return round(sum(x * v.get(w, 0.0) for w, x in template.items()), 9) if all(w in v for w in NAMES.get(name, ())) and not any(w in v for w in OTHERS.get(name, ())) else 0.0


def best_template(words: list[str], vectors: dict[str, dict[str, float]], idf: dict[str, float], rare: float) -> tuple[float, str]:
    v = weights(words, idf, rare)
    return min(((_cosine(v, name, t), name) for name, t in vectors.items()), key=lambda s: (-s[0], s[1]))


LENGTHS = {name: len(terms(t)) for name, t in (TEMPLATES | TAGS).items()}


def license_scan(files: DataFrame, path_col: str = "path", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``files`` without its text: all other columns, then license, score, inherited_from (a directory, or null)."""
    spark = files.sparkSession
    keep = [c for c in files.columns if c not in (text_col, "license", "score", "inherited_from")]

    def extract(texts):
        around = [passages(t or "") for t in texts]
        return {"__lic_blocks": [blocks(t or "") for t in texts], "__lic_passages": around, "__lic_words": [len(t.split()) if b else 0 for t, b in zip(texts, around)]}

    slim = files.select(*[f"`{c}`" for c in keep], F.col(text_col).alias("__lic_text"))
    rows = save(extend(slim, ["__lic_text"], extract, "__lic_blocks array<string>, __lic_passages array<string>, __lic_words int", keep))

    vocabulary = sorted({w for t in (*TEMPLATES.values(), *TAGS.values()) for w in terms(t)})
    each = rows.select(F.explode(F.concat("__lic_blocks", "__lic_passages")).alias("b"))
    seen = each.select(F.explode(F.array_distinct(F.regexp_extract_all("b", F.lit(_WORD.pattern), F.lit(0)))).alias("w"))
    counted = seen.where(F.col("w").isin(vocabulary)).groupBy("w").count().collect()  # as many rows as template words
    idf, rare = inverse_frequencies({r.w: r["count"] for r in counted}, each.count())
    vectors = {name: weights(terms(t), idf, rare) for name, t in (TEMPLATES | TAGS).items()}

    def judge(blocks_of, passages_of, words_of):
        best = []
        for found, around, n in zip(blocks_of, passages_of, words_of):
            hits = [(*best_template(terms(b), vectors, idf, rare), len(b.split())) for b in found]
            hits += [h for p in around for h in best_windows(p.split(), vectors, idf, rare, threshold)]
            top = min((h for h in hits if h[0] >= threshold), key=lambda s: (-s[0], s[1]), default=None)
            most = max((h[2] for h in hits if top and h[0] >= threshold and license_of(h[1]) == license_of(top[1])), default=0)
            name = license_of(top[1]) if top else None
            if name == "BSD-2-Clause" and any(h[1] == "BSD-3-Clause text" and h[0] >= threshold for h in hits):
                name = "BSD-3-Clause"
            best.append((name, top[0], 5 * most >= n) if top else (None, None, False))
        return dict(zip(("license", "score", "__lic_notice"), zip(*best)))

    own = save(extend(rows, ["__lic_blocks", "__lic_passages", "__lic_words"], judge, "license string, score double, __lic_notice boolean", keep))
    own = own.withColumn("__lic_dir", F.regexp_extract(path_col, r"(?s)^(.*)/[^/]*$", 1)).withColumn("__lic_dir", F.when(F.col(path_col).isNull(), F.lit(None)).otherwise(F.col("__lic_dir")))
    named = F.regexp_extract(path_col, r"([^/]*)$", 1).rlike(LICENCE_FILE)
    held = own.where(F.col("license").isNotNull() & F.col("__lic_dir").isNotNull() & (F.col("__lic_notice") | named)).groupBy("__lic_dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("h"))
    held = save(held.select(F.col("__lic_dir").alias("__lic_up"), F.col("h.license").alias("__lic_held")))

    # every directory with its ancestors: itself, then each prefix that ends before a slash, then the root
    dirs = own.where(F.col("license").isNull() & F.col("__lic_dir").isNotNull()).select("__lic_dir").distinct()
    labels = F.split("__lic_dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(labels)), lambda k: F.array_join(F.slice(labels, 1, k), "/"))
    up = dirs.select("__lic_dir", F.explode(F.array_distinct(ancestors)).alias("__lic_up"))
    nearest = join_small(up, held, ["__lic_up"]).groupBy("__lic_dir").agg(F.max(F.struct(F.length("__lic_up").alias("d"), "__lic_up", "__lic_held")).alias("n"))
    nearest = save(nearest.select("__lic_dir", F.col("n.__lic_up").alias("__lic_up"), F.col("n.__lic_held").alias("__lic_held")))
    out = join_small(own, nearest, ["__lic_dir"], "left")
    mine = F.col("license").isNotNull()
    return out.select(*keep, F.coalesce("license", "__lic_held").alias("license"), "score", F.when(~mine, F.col("__lic_up")).alias("inherited_from"))
