"""Mixing, sharding, URL filters, licences and surrogates, against brute force on awkward rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("chronoweave.llm")

from chronoweave.llm import license_scan as lic  # noqa: E402
from chronoweave.llm import pii_surrogates as pii  # noqa: E402
from chronoweave.llm.mixing import mix_sources, mixed  # noqa: E402
from chronoweave.llm.sharding import Tree, best_fit_decreasing, pack, shard_documents  # noqa: E402
from chronoweave.llm.url_filters import url_verdicts  # noqa: E402


def fill(sizes, weights, share, epochs):
    """Water-filling round by round."""
    target, open_, left = {}, set(range(len(sizes))), share * sum(sizes)
    while open_:
        level = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if level * weights[i] > epochs * sizes[i]]
        if not over:
            target |= {i: level * weights[i] for i in open_}
            break
        for i in over:
            target[i] = epochs * sizes[i]
            left -= target[i]
            open_.remove(i)
    return target


@pytest.fixture(scope="module")
def mix_rows():
    rng = random.Random(5)
    names = ["b", "a", "", None, "\U0001f600", "é", "a"]
    return [(i, " ".join(["w"] * rng.randint(0, 60)) if i % 17 else None, names[i % 7] if i % 3 else "a", 1) for i in range(900)]


def test_mix_meets_targets(spark, mix_rows):
    docs = spark.createDataFrame(mix_rows, "doc_id long, text string, source string, size int")
    got = mix_sources(docs).collect()
    size = lambda t: len((t or "").split())
    sources = sorted({r[2] for r in mix_rows}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(size(r[1]) for r in mix_rows if r[2] == s) for s in sources]
    want = fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(sources))], 1.5, 2)
    source = {r[0]: sources.index(r[2]) for r in mix_rows}
    taken = dict.fromkeys(want, 0)
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]]) and r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    assert len(got) == 900 and all(abs(taken[i] - want[i]) <= 60 for i in want)
    assert sorted(map(tuple, mix_sources(docs.repartition(5)).collect())) == sorted(map(tuple, got))
    out = mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.repeats for r in got)


def test_mix_of_few_and_none(spark):
    schema = "doc_id long, text string, source string"
    assert mix_sources(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r)[1:5] for r in mix_sources(spark.createDataFrame([(1, None, None), (2, "", "x")], schema)).collect()] == [(0, 0, 0.0, 0)] * 2
    one = mix_sources(spark.createDataFrame([(1, "a b c", None)] * 2, schema)).collect()
    assert [r.target for r in one] == [9.0, 9.0] and sum(r.taken for r in one) in (6, 9, 12)


def classes(sizes):
    return sorted(Counter(sizes).items(), reverse=True)


def bins_of(runs):
    return [b for _, first, last, b in runs for _ in range(last - first)]


def test_best_fit_takes_the_tightest_bin():
    assert bins_of(best_fit_decreasing(classes([6, 5, 4, 3, 2]), 10)) == [0, 1, 0, 1, 1]
    rng = random.Random(6)
    for n, most in ((0, 9), (1, 9), (5, 1000), (300, 1000), (3000, 40)):
        sizes = sorted((rng.randint(1, most) for _ in range(n)), reverse=True)
        runs, cap = best_fit_decreasing(classes(sizes), 1500), 1500
        assert all(first < last for _, first, last, _ in runs)
        free = {}
        for s, b in zip(sizes, bins_of(runs)):  # brute force, group by group: the least remaining room that holds it
            fits = [(room, k) for k, room in free.items() if room >= s]
            assert b == (min(fits)[1] if fits else len(free))
            free[b] = free.get(b, cap) - s
    loads = np.bincount(bins_of(pack(classes(sizes), 24)), sizes)
    assert len(loads) == 24 and loads.max() == -(-sum(sizes) // 24)  # no packing does better
    assert best_fit_decreasing(classes(sizes), 1500, 3) is None


def test_tree_is_a_sorted_set():
    rng, tree, want = random.Random(1), Tree(), []
    for _ in range(3000):
        if rng.random() < 0.6:
            key = (rng.randint(0, 500), len(want) + rng.random())
            tree.add(key)
            want.append(key)
        else:
            low = (rng.randint(0, 500), -1)
            key = min((k for k in want if k >= low), default=None)
            assert tree.pop_least(low) == key
            want = [k for k in want if k != key]
    assert [k for leaf in tree.leaves for k in leaf] == sorted(want) and all(len(leaf) <= 64 for leaf in tree.leaves)


def test_shards_are_those_of_brute_force(spark):
    """Every group goes where best-fit-decreasing, group by group, puts one of its size."""
    rng = random.Random(18)
    texts = ["x" * rng.randint(0, 40) + str(i % 700) for i in range(1500)]
    got = shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), shards=7).collect()
    size = Counter()
    for t in texts:
        size[t] += len(t) + 8
    want = Counter((s, b) for (s, first, last, b) in pack(classes(size.values()), 7) for _ in range(last - first))
    home = {texts[r.doc_id]: r.shard for r in got}
    assert Counter((size[t], b) for t, b in home.items()) == want


def test_shards(spark):
    rng = random.Random(8)
    texts = [None, "", "", "é" * 10] + ["same text"] * 150 + ["".join(rng.choice("abc é") for _ in range(rng.randint(1, 300))) for _ in range(2000)]
    docs = spark.createDataFrame([(i if i != 5 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, shard string").repartition(4)
    got = shard_documents(docs).collect()
    raw = lambda t: (t or "").encode()
    for r in got:
        if r.doc_id is not None:
            assert r.size == len(raw(texts[r.doc_id])) + 8 and r.text_crc32 == zlib.crc32(raw(texts[r.doc_id]))
    load, home = {}, {}
    for r in got:
        load.setdefault(r.shard, []).append(r)
        home.setdefault(r.text_crc32, set()).add(r.shard)
    assert set(load) == set(range(24)) and all(len(s) == 1 for s in home.values())
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in load.values())
    sizes = [sum(r.size for r in rows) for rows in load.values()]
    assert max(sizes) < 1.01 * min(sizes)
    assert shard_documents(docs.limit(0)).count() == 0
    assert len({r.shard for r in shard_documents(docs.where("text = 'same text'")).collect()}) == 1


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("", "/q", "block"), ("a.b.com", "/x", "block")]


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    bare = rest.split("?")[0].split("#")[0]
    host = bare.split("/")[0]
    path = bare[len(host) :]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


def test_url_verdicts(spark):
    rng = random.Random(9)
    hosts = ["com", "EXAMPLE.com", "www.example.com", "x.www.example.com", "badexample.com", "a.b.com", "z.a.b.com", "n.net", "net", "", "com.", "a..com", "üx.COM", "example.com:80"]
    urls = [None, "", "no scheme", "://", "a://b://c", "http://com?x#y", "http://com#/en/", "HTTP://example.com"]
    urls += [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en', '/en/1', '/es/2?q=/en/', '/x/y#z', '/q', chr(10) + '/en/'])}" for _ in range(300)] + ["https://www.example.com/en/hot"] * 200
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string").repartition(3)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_verdicts(pages, rules).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(urls)}
    assert url_verdicts(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_verdicts(pages, rules.limit(0)).collect()} == {"allow"}


def test_license_scan(spark):
    apache, mit = lic.TEMPLATES["Apache-2.0"], lic.TEMPLATES["MIT header"]
    prose = "word " * 300
    files = [
        ("p/LICENSE", mit + "\n" + prose), ("p/a.txt", prose), ("p/q/b.txt", prose), ("p/q/r/c.txt", prose + "\n" + apache), ("p/q/s/N", apache), ("p/q/s/t/d.txt", None),
        ("z/e.txt", ""), ("pp/f.txt", prose), ("top.txt", prose), (None, apache), (None, prose), ("p/a.txt", prose), ("w/long.txt", prose + apache + prose), ("w/x.txt", "a license is a licence, said the lawyer of the licensed plumber"),
    ]
    df = spark.createDataFrame([(p, t, i) for i, (p, t) in enumerate(files)], "path string, text string, license_id int").repartition(3)
    got = {r.license_id: (r.license, r.inherited_from) for r in lic.license_scan(df).collect()}
    none = (None, None)
    assert got == {0: ("MIT", None), 1: ("MIT", "p"), 2: ("MIT", "p"), 3: ("Apache-2.0", None), 4: ("Apache-2.0", None), 5: ("Apache-2.0", "p/q/s"), 6: none, 7: none, 8: none, 9: ("Apache-2.0", None), 10: none, 11: ("MIT", "p"), 12: ("Apache-2.0", None), 13: none}  # a notice is found wherever it stands
    assert lic.license_scan(df.limit(0)).count() == 0


def test_notices_inside_prose_are_found(spark):
    words = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore".split()
    prose = lambda n: " ".join(words[i * 7 % 15] for i in range(n))
    notices = {n: t for n, t in lic.TEMPLATES.items()}
    files, want = [], {}
    for name, t in notices.items():
        half = t.split()
        for text in (f"{prose(20)} {t} {prose(90)}", f"{prose(700)} {t} {prose(700)}", prose(5) + " " + " ".join(half[:3]) + "\n# " + " ".join(half[3:]) + " " + prose(30), f"{prose(99)} {t}{prose(99)}"):
            want[len(files)] = lic.license_of(name)
            files.append((f"f{len(files)}/x.txt", text, len(files)))
    for text in (prose(900) + " license " + prose(900), f"{prose(50)} Released under the Foo License. {prose(50)}", "license " * 500):
        want[len(files)] = None
        files.append((f"f{len(files)}/x.txt", text, len(files)))
    df = spark.createDataFrame(files, "path string, text string, license_id int").repartition(3)
    assert {r.license_id: r.license for r in lic.license_scan(df).collect()} == want


GPL_HEADER = """
/* This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. */
"""
MIT_FILE = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
ISC_FILE = """Copyright 2020 Someone

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""


def test_headers_and_licence_files(spark):
    gpl2 = GPL_HEADER.replace("version 3", "version 2")
    agpl, lgpl = (GPL_HEADER.replace("General", f"{w} General") for w in ("Affero", "Lesser"))
    title = "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n" + "word " * 5000
    mpl = "# This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy of the MPL was not distributed with this\n# file, You can obtain one at http://mozilla.org/MPL/2.0/."
    cc = "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."
    texts = {GPL_HEADER: "GPL-3.0", gpl2: "GPL-2.0", agpl: "AGPL-3.0", lgpl: "LGPL-3.0", title: "GPL-3.0", MIT_FILE: "MIT", ISC_FILE: "ISC", mpl: "MPL-2.0", cc: "CC-BY-SA-4.0", cc.replace("ShareAlike", "NoDerivatives"): None}
    files = [(f"d{i}/COPYING", t, i) for i, t in enumerate(texts)] + [(f"d{i}/sub/x.txt", "plain words", 100 + i) for i in range(len(texts))] + [(f"mit{i}/LICENSE", MIT_FILE, 1000 + i) for i in range(50)]
    got = {r.license_id: r.license for r in lic.license_scan(spark.createDataFrame(files, "path string, text string, license_id int").repartition(3)).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values()) == [got[100 + i] for i in range(len(texts))]
    assert all(got[1000 + i] == "MIT" for i in range(50))


def test_tags_and_both_bsd_files(spark):
    conditions = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n1. Keep the notice.\n"
    third = "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
    texts = {"# SPDX-License-Identifier: MIT\nimport os\n": "MIT", "// SPDX-License-Identifier: GPL-3.0-or-later\n" + "word " * 900: "GPL-3.0", "/* SPDX-License-Identifier: Apache-2.0 */": "Apache-2.0", "# SPDX-License-Identifier: Foo-1.0": None, "Copyright 2020\n" + conditions: "BSD-2-Clause", "Copyright 2020\n" + conditions + third: "BSD-3-Clause"}
    files = [(f"d{i}/x.c", t, i) for i, t in enumerate(texts)]
    got = {r.license_id: r.license for r in lic.license_scan(spark.createDataFrame(files, "path string, text string, license_id int").repartition(3)).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_best_windows_are_those_of_brute_force():
    rng = random.Random(3)
    idf, rare = lic.inverse_frequencies({"license": 50, "the": 40, "under": 20}, 60)
    vectors = {n: lic.weights(lic.terms(t), idf, rare) for n, t in lic.TEMPLATES.items()}
    pool = [w for t in lic.TEMPLATES.values() for w in lic.terms(t)]
    for _ in range(20):
        words = [rng.choice(pool) for _ in range(rng.randint(1, 60))] + lic.terms(rng.choice(list(lic.TEMPLATES.values()))) + ["the"] * rng.randint(0, 9)
        want = {}
        for name, t in vectors.items():
            size = min(len(words), len(lic.terms(lic.TEMPLATES[name])))
            score = max(lic.cosine(words[i : i + size], name, t, idf, rare) for i in range(len(words) - size + 1))
            want |= {name: score} if score >= 0.5 else {}
        assert {n: s for s, n, _ in lic.best_windows(words, vectors, idf, rare, 0.5)} == pytest.approx(want)


def test_license_scores_are_cosines():
    idf, rare = lic.inverse_frequencies({"license": 5}, 9)
    vectors = {n: lic.weights(lic.terms(t), idf, rare) for n, t in lic.TEMPLATES.items()}
    for name, t in lic.TEMPLATES.items():
        score, best = lic.best_template(lic.terms(t), vectors, idf, rare)
        assert best == name and score == pytest.approx(1.0)


TEXTS = [
    "Mail Ana.Lee7@Mail.example.com or ANA.LEE7@mail.example.com, call +1 (017) 555-7713 or +1-017-555-7713.",
    "Card 4111 1111 1111 1111 and 4111111111111111, ip 10.0.0.1, ssn 123-45-6789. Mrs. Meier met Mr Иванов and Frau MEIER.",
    "nothing here but 3.14 and 2024 and a @ sign", None, "", "10.0.0.1", "é.ü9@x.org é.ü9@x.org",
]


def test_surrogates(spark):
    docs = spark.createDataFrame([(i, t, "m") for i, t in enumerate(TEXTS)] + [(None, TEXTS[5], "m")], "doc_id long, text string, _map string").repartition(3)
    out = pii.replace_pii(docs, "k1")
    assert out.columns == [*docs.columns, "n_pii"]
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].text for i in (2, 3, 4)] == TEXTS[2:5] and got[2].n_pii == 0
    find = lambda t: [r[0] for r in spark.createDataFrame([(t,)], "text string").select(F.explode(pii.entities())).collect()]
    a, b = find(TEXTS[0]), find(got[0].text)
    assert got[0].n_pii == 4 == len(a) == len(b) and not set(a) & set(b)
    assert b[0].lower() == b[1].lower() and b[1].split("@")[0].isupper() and b[0].endswith(".com")
    assert b[2].startswith("+1 (") and b[2].replace(" (", "-").replace(") ", "-") == b[3]
    c = find(got[1].text)
    digits = c[0].replace(" ", "")
    assert digits == c[1] and digits[0] == "4" and luhn(digits) and c[0].count(" ") == 3
    names = [x for x in c if x[:2] in ("Mr", "Fr")]
    assert names[0].startswith("Mrs. ") and names[2].startswith("Frau ") and names[2].isupper() is False and names[2][5:] == names[0][5:].upper()
    assert all("а" <= ch.lower() <= "я" for ch in names[1][3:])
    assert got[5].text == got[None].text != "10.0.0.1" and got[5].text in got[1].text  # one ip, one surrogate
    first, second = got[6].text.split()
    assert first == second and first.endswith(".org") and first[1] == "."
    again = {r.doc_id: r.text for r in pii.replace_pii(docs, "k1").collect()}
    other = {r.doc_id: r.text for r in pii.replace_pii(docs, "k2").collect()}
    assert again == {k: r.text for k, r in got.items()} and other[0] != again[0]
    assert pii.replace_pii(docs.limit(0)).count() == 0


def luhn(s):
    d = [int(c) for c in s[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_colliding_surrogates_are_drawn_again(spark):
    """Forty of the hundred two-digit forms: first draws collide, with each other and with originals."""
    found = spark.createDataFrame([("other", f"{i:02d}", "n") for i in range(40)], "kind string, canon string, gender string")
    rows = pii.surrogates(found, "k").collect()
    originals = {f"{i:02d}" for i in range(40)}
    assert len(rows) == 40 and len({r.made for r in rows}) == 40 and not {r.made for r in rows} & originals


def test_a_full_format_is_widened(spark):
    """All ten one-digit forms are originals, so none is free."""
    found = spark.createDataFrame([("other", str(i), "n") for i in range(10)], "kind string, canon string, gender string")
    made = {r.canon: r.made for r in pii.surrogates(found, "k").collect()}
    assert set(made) == set("0123456789") and len(set(made.values())) == 10 and all(len(m) > 1 and m.isdigit() for m in made.values())


def test_names_keep_coreference(spark):
    texts = ["Mr John Smith met. Mr Smith left. Dr Smith came. Herr SMITH!", "Mrs Jane Doe and Dr Jane Doe and Prof Doe", "Mr Jane-Paul Doe", "Dr Ольга Иванова и Frau Ольга Петрова"]
    texts += [" ".join(f"Mr {chr(65 + i)}{chr(97 + j)}" for j in range(26)) for i in range(26)]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(3)
    got = {r.text.split()[0] + str(len(r.text.split())): r.text for r in pii.replace_pii(docs).collect()}
    one = next(t for t in got.values() if t.endswith("!"))
    words = one.replace(".", "").replace("!", "").split()
    first, family = words[1], words[2]
    assert words == ["Mr", first, family, "met", "Mr", family, "left", "Dr", family, "came", "Herr", family.upper()] and first in pii.GIVEN[("latin", "m")]
    two = next(t for t in got.values() if t.startswith("Mrs")).split()
    assert two[1:3] == two[5:7] and two[9] == two[2] and two[1] in pii.GIVEN[("latin", "f")]
    russian = next(t for t in got.values() if "Frau" in t).split()
    assert russian[1] == russian[5] and all("а" <= c.lower() <= "я" for c in russian[1] + russian[2])
    short = [w for t in got.values() if len(t.split()) == 52 for w in t.split() if w != "Mr"]
    assert len(short) == 676 == len(set(short))


def test_ipv6_and_very_long_names(spark):
    texts = ["from 2001:db8::17 to 2001:DB8:0:1:2:3:4:9 at 10:20 std::string a::b", "Mr " + "Zy" * 3000 + " came"]
    got = [r.text for r in pii.replace_pii(spark.createDataFrame([(1, texts[0]), (2, texts[1])], "doc_id long, text string")).orderBy("doc_id").collect()]
    words, old = got[0].split(), texts[0].split()
    assert words[1] != old[1] and words[1].count(":") == 3 and words[3] != old[3] and words[3].count(":") == 7 and words[4:] == old[4:]
    assert "ZyZy" not in got[1] and got[1].endswith(" came")


def test_no_python_runs_in_surrogates(spark):
    plan = pii.replace_pii(spark.createDataFrame([(1, TEXTS[0])], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
