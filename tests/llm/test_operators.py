import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rillgraph.llm import bpe, chat, html, language, license, ogg, packing, quality_fm, quality_rules, simhash
from rillgraph.llm.queries import ORACLES, QUERIES, vocabulary
from tests.conftest import SF, duck, same_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    same_rows(QUERIES[name](spark, SF), duck(SF), ORACLES[name])


# 1: main text


def test_main_text_of_a_page():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>menu</a></li></ul></nav>"
        "<div class='cookie-notice'>We use cookies</div><div class=ad>buy</div><article><h1>Title &amp; more</h1><p>One\n two<b>bold<br><p>Three&nbsp;4"
        "<script>if (a<b) x('</p>')</script></p><form><input>send</form></article><aside>side</aside><div id='comments'><p>I say</p></div><footer>foot</footer></body></html>"
    )
    assert html.extract(page, "html>body>article") == "Title & more One twobold Three 4"
    assert html.extract(page, None) == html.extract(page, "html>body>nowhere") == "Title & more One twobold Three 4"
    assert html.extract("", "x") == html.extract(None, None) == ""
    assert html.extract("just text &lt;b", None) == "just text <b"


def test_consensus_path_beats_a_long_comment_box(spark):
    page = lambda body, more: f"<html><body><div class='post-{len(body)}'><p>{body}</p></div><div class='x1'><p>{more}</p></div></body></html>"
    rows = [(k, f"http://h/{k}", page("text " * (20 + k), "s")) for k in range(10)] + [(10, "http://h/10", page("short text", "other " * 40)), (11, None, None), (12, "http://h/0", "")]
    got = {r["page_id"]: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[10]["text"] == "short text" and got[11]["text"] == got[12]["text"] == "" and got[11]["n_chars"] == 0


def test_pages_match_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = regex.search(r"<article>(.*)</article>", r["html"], regex.S)[1]
        parts = regex.split(r"</?(?:p|h1|br)>", inner.replace("<b>", "").replace("</b>", ""))
        want[r["page_id"]] = " ".join(" ".join(html.unescape(p).split()) for p in parts if p.split())
    got = {r["page_id"]: r["text"] for r in html.main_text(pages).collect()}
    assert got == want


LONG = "Some words of the article go on and on here. " * 8
LAYOUTS = {
    "form around the page": (f"<html><body><form id='aspnetForm'><div class='nav'>x</div><div class=c><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div></form></body></html>", f"T {LONG}{LONG}"),
    "search words inside an article": (f"<body><article><div class='content search'><h1>T</h1><p>{LONG}</p></div></article></body>", f"T {LONG}"),
    "quotes in bare values": (f"<body><article><p><a href=x title=don't>a</a> one</p><p>{LONG}</p><p>it's two</p></article></body>", f"a one {LONG}it's two"),
    "lead in a header": (f"<body><header><p>Site</p></header><article><header class=entry-header><h1>T</h1><p>Lead</p></header><p>{LONG}</p></article></body>", f"T Lead {LONG}"),
    "heading and lead beside the content": (f"<body><div id=wrap><div class=menu>m</div><div class=post><h1>T</h1><div class=lead>Lead</div><div class=content><p>{LONG}</p><p>{LONG}</p></div></div></div></body>", f"T Lead {LONG}{LONG}"),
    "content in an article": (f"<body><article><h1>T</h1><div class=content><p>{LONG * 5}</p></div></article></body>", f"T {LONG * 5}"),
    "comments longer than the article": (f"<body><article><h1>T</h1><p>{LONG}</p></article><div class=comments><p>{LONG * 4}</p></div></body>", f"T {LONG}"),
    "a layout's class": (f"<body><div class='page has-sidebar'><div class=text><h1>T</h1><p>{LONG}</p></div><div class=sidebar><p>s</p></div></div></body>", f"T {LONG}"),
    "content with-sidebar, h2 only": (f"<body><div class='content with-sidebar'><h2>T</h2><p>{LONG * 4}</p></div></body>", f"T {LONG * 4}"),
    "page has-sidebar": (f"<body><div id=page class='has-sidebar'><div class=story><h2>T</h2><p>{LONG}</p></div></div></body>", f"T {LONG}"),
    "post no-comments": (f"<body><div class='post no-comments'><h2>T</h2><p>{LONG}</p></div></body>", f"T {LONG}"),
    "ad-free-layout": (f"<body><div class='ad-free-layout'><p>{LONG}</p></div></body>", LONG),
    "h1 before the wrapper": (f"<body><div class=top><h1>Title</h1><div class='wrap has-sidebar'><p>{LONG}</p><p>{LONG}</p></div></div></body>", f"Title {LONG}{LONG}"),
    "sidebar theme, word alone": (f"<body><div class=sidebar><div class=entry><h2>T</h2><p>{LONG}</p></div></div></body>", f"T {LONG}"),
    "blog theme": (f"<body class='single nav-fixed'><div id=page class='site no-sidebar'><nav>n</nav><div id=content class=site-content><article class='post comments-closed'><h1>T</h1><div class=entry-content><p>{LONG}</p></div></article><div class=comments-area><p>{LONG * 5}</p></div></div><div class=site-footer>f</div></div></body>", f"T {LONG}"),
    "grid theme": (f"<body><div class='container menu-open'><div class=row><div class='col-8 with-nav'><h2>T</h2><p>{LONG}</p><p>{LONG}</p></div><div class='col-4 sidebar'><p>s</p></div></div></div></body>", f"T {LONG}{LONG}"),
    "documentation site": (f"<body><div class='wy-grid nav-layout'><div class=wy-nav-side><p>toc</p></div><div class='document has-related'><h1>T</h1><p>{LONG}</p></div></div></body>", f"T {LONG}"),
    "camel case": (f"<body><div class=mainContent><h1>T</h1><p>{LONG}</p></div><div class=relatedPosts><p>r</p></div></body>", f"T {LONG}"),
    "remarks in an article": (f"<body><article><h1>T</h1><p>{LONG}</p><section class=user-remarks><p>I say</p></section></article></body>", f"T {LONG}"),
    "a list of one shape": (f"<body><article><h1>T</h1><p>{LONG}</p></article><ol class=thread><li><b class=name>A</b><time>1</time><p>{LONG}</p></li><li><b class=name>B</b><time>2</time><p>{LONG}</p><p>more</p></li></ol></body>", f"T {LONG}"),
    "a list of one shape in an article": (f"<body><article><h1>T</h1><p>{LONG}</p><div class=x><div class=e><span class=author>A</span><span class=date>1</span><p>a</p></div><div class=e><span class=author>B</span><span class=date>2</span><p>b</p></div></div></article></body>", f"T {LONG}"),
    "an article with its writer and day": (f"<body><article><h1>T</h1><div class=meta><span class=author>A</span><time>1</time></div><p>{LONG}</p></article></body>", f"T A1 {LONG}"),
    "dated entries are the page": (f"<body><div class=log><div class=e><span class=author>A</span><time>1</time><p>{LONG}</p></div><div class=e><span class=author>B</span><time>2</time><p>{LONG}</p></div></div></body>", f"A1 {LONG}B2 {LONG}"),
    "only a notice": (f"<body><div class=notice><p>short</p></div><div class=menu><a href=x>m</a></div></body>", "short"),
    "only comments": (f"<body><div class=menu><a href=x>m</a></div><div class=footer><div class=comments><p>{LONG}</p></div></div></body>", LONG),
    "bare less-than and slashes": (f"<body><article><p>1 < 2 <br/>and <a href=/x/>b</a> {LONG}</p></article></body>", f"1 < 2 and b {LONG}"),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    page, want = LAYOUTS[name]
    best = html.ranked(html.Page(page), 1)
    assert html.extract(page, best[0][0] if best else None) == " ".join(want.split())


def test_long_and_deep_pages_cost_their_length():
    import time

    began = time.time()
    for page in ('<a "' * 250_000, "<a x='" * 200_000, '<p title="' * 100_001, "<div class=a>" * 100_000 + "text", "</b>" * 200_000 + "<i>" * 50_000, "<!--" * 200_000, "<script>" * 50_000, "< " * 300_000):
        html.extract(page, None)
    assert time.time() - began < 40
    assert html.extract("<div class=a>" * 100_000 + "text", None) == "text"


def test_votes_and_joins_match_brute_force(spark, monkeypatch):
    """Votes counted by a loop, and the same texts when the winners are joined by salt."""
    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{SF}/pages.parquet").unionByName(spark.createDataFrame([(-1, None, None), (-2, "example.com:8080/x", LAYOUTS["content in an article"][0]), (-2, "example.com:8080/x", "")], "page_id long, url string, html string"))
    pages = pages.withColumn("path", F.lit("other")).withColumn("host", F.lit("other")).withColumn("salt", F.lit(1))
    hosts = {r["url"]: r["h"] for r in pages.select("url", html.host_column("url").alias("h")).collect()}
    assert hosts[None] == "" and hosts["example.com:8080/x"] == "example.com:8080"
    votes = defaultdict(Counter)
    for r in pages.collect():
        for place, (path, _) in enumerate(html.ranked(html.Page(r["html"] or ""), html.VOTES)):
            votes[hosts[r["url"]]][path] += html.VOTES - place + (place == 0)
    want = {h: min(v, key=lambda p: (-v[p], p)) for h, v in votes.items()}
    assert {r["host"]: r["path"] for r in html.winners(pages).collect()} == want
    key = lambda r: (r["page_id"], r["url"] or "", r["text"])
    first = sorted(map(key, html.main_text(pages).collect()))
    monkeypatch.setattr(html, "BROADCAST_HOSTS", 0)
    assert sorted(map(key, html.main_text(pages).collect())) == first and len(first) == pages.count()


# 2: licences


def test_licence_rules(spark):
    texts = [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "some text.\nLicensed under CC BY-NC 4.0.", "not all rights reserved here", None,
    ]
    got = license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["licenses"] for r in got] == ["MIT", "CC-BY-NC-4.0", "", ""]


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
http://www.eclipse.org/legal/epl-2.0"""
CC0 = """To the extent possible under law, the author(s) have dedicated all copyright
and related and neighboring rights to this software to the public domain
worldwide. This software is distributed without any warranty."""
BOOST = """Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute"""


def gnu(name, version, thing="program"):
    return f"""This {thing} is free software: you can redistribute it and/or modify
it under the terms of the GNU {name} as published by
the Free Software Foundation, either version {version} of the License, or
(at your option) any later version."""


NOTICES = {
    "Apache-2.0": APACHE, "BSD-3-Clause": BSD, "BSD-2-Clause": BSD[: BSD.index("3. Neither")] + BSD[BSD.index("THIS SOFTWARE") :], "MIT": MIT, "Zlib": ZLIB, "ISC": ISC,
    "MPL-2.0": MPL, "EPL-2.0": EPL, "CC0-1.0": CC0, "BSL-1.0": BOOST, "GPL-3.0": gnu("General Public License", 3), "GPL-2.0": gnu("General Public License", 2),
    "LGPL-2.1": gnu("Lesser General Public License", 2.1, "library"), "LGPL-3.0": gnu("Lesser General Public License", 3), "AGPL-3.0": gnu("Affero General Public License", 3),
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons\nAttribution 4.0 International License.", "0BSD": ISC[: ISC.index(", provided")] + ".",
    "Unlicense": "This is free and unencumbered software released\ninto the public domain.",
}


def test_wrapped_notices(spark):
    """One text for each licence: plain, and wrapped behind three comment marks; no licence shows a shorter one beside it."""
    texts, want = [], []
    for name, notice in NOTICES.items():
        for mark in ("", "# ", " * ", "// "):
            texts.append("Some words before\n\n" + mark + notice.replace("\n", "\n" + mark) + "\n\nAnd words after it.")
            want.append(name)
    texts += [NOTICES["BSD-3-Clause"] + "\n\n" + NOTICES["BSD-2-Clause"], APACHE.upper(), "# SPDX-License-Identifier: BSD-3-Clause\nint x;", BSD.replace("the copyright holder nor", "Acme nor")]
    want += ["BSD-3-Clause,BSD-2-Clause", "Apache-2.0", "BSD-3-Clause", "BSD-3-Clause"]
    got = license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert {(k, r["licenses"]) for k, r in enumerate(got)} == set(enumerate(want))


def brute_licences(text):
    """By loops over words: longest known phrases first, then sentences, then rules that consume."""
    whole = regex.sub(license.GOES_ON, r"\1 \2", text or "")
    parts = [regex.sub(license.OTHER, " ", p.lower()).split() for p in regex.split(license.ENDS, whole)]
    words = [(w, k) for k, p in enumerate(parts) for w in p]
    owner, found = [None] * len(words), []
    known = {s: i for i, s in license.MORE_SENTENCES.items()}
    for s in license._spread():
        need = s.split()
        for at in range(len(words) - len(need) + 1):
            if all(owner[at + j] is None and words[at + j][0] == need[j] for j in range(len(need))):
                owner[at : at + len(need)] = [s] * len(need)
                found.append((at, known[s]))
    at = 0
    while at < len(words):  # what phrases leave of a sentence is a sentence of its own
        end = at + 1
        while owner[at] is None and end < len(words) and owner[end] is None and words[end][1] == words[at][1]:
            end += 1
        if owner[at] is None and (i := known.get(" ".join(w for w, _ in words[at:end]))) and len(words[at:end]) < license.LONG and i not in license.ANYWHERE:
            found.append((at, i))
        at = end
    ids = [i for _, i in sorted(found)]
    left, names = list(ids), []
    for name, places in sorted(license.MORE_RULES, key=lambda r: -len(r[1])):
        at, used = 0, []
        while True:
            for place in places:
                nxt = next((k for k in range(at, len(left)) if left[k] in (place if isinstance(place, tuple) else (place,))), None)
                if nxt is None:
                    break
                used.append(nxt)
                at = nxt + 1
            else:
                names.append(name)
                continue
            break
        whole_matches = len(used) // len(places) * len(places)
        left = [x for k, x in enumerate(left) if k not in used[:whole_matches]]
    return ids, [n for n in dict.fromkeys(n for n, _ in license.MORE_RULES) if n in names]


def test_licences_match_brute_force(spark):
    rng = random.Random(5)
    pieces = [*NOTICES.values(), "All rights reserved.", "Released under the MIT License.", "some other words", "license", "Licensed under CC BY-NC 4.0!", "\n\n", "not all rights reserved here"]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", "\n", ". ", "\n# "]) for _ in range(rng.randint(1, 6))) for _ in range(150)]
    got = license.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    for text, r in zip(texts, got):
        ids, names = brute_licences(text)
        assert (r["sentence_ids"], r["licenses"], r["n_sentences"]) == (",".join(map(str, ids)), ",".join(names), len(ids))



def taken_by_loop(ids: list[int]) -> str:
    """Licences by one left-to-right walk a rule, longest rules first."""
    left, names = list(ids), set()
    for name, places in sorted(license.MORE_RULES, key=lambda r: -len(r[1])):
        wanted, took, own = [set(p) if isinstance(p, tuple) else {p} for p in places], set(), []
        for k, i in enumerate(left):
            if i in wanted[len(own)]:
                own.append(k)
                if len(own) == len(wanted):
                    took.update(own)
                    names.add(name)
                    own = []
        left = [i for k, i in enumerate(left) if k not in took]
    return ",".join(n for n in dict.fromkeys(n for n, _ in license.MORE_RULES) if n in names)


def test_rules_match_a_walk_over_identifiers(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(9)
    often = [i for _, places in license.MORE_RULES if len(places) > 1 for p in places for i in (p if isinstance(p, tuple) else (p,))]
    rows = [(k, [rnd.choice(often) if rnd.random() < 0.8 else rnd.randint(1, 70) for _ in range(rnd.choice([0, 1, 3, 8, 20, 60]))]) for k in range(300)]
    got = {r["k"]: r["names"] for r in spark.createDataFrame(rows, "k int, ids array<int>").select("k", license.licenses(F.col("ids")).alias("names")).collect()}
    assert got == {k: taken_by_loop(ids) for k, ids in rows}


def test_repeated_partial_notices_cost_their_length(spark):
    """100,000 identifiers of two of a rule's three sentences, and 1 MB of such text: no backtracking over them."""
    import time

    from pyspark.sql import functions as F

    ids = F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: (8 + i % 2).cast("int"))
    text = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nUnless required by applicable law or agreed to in writing.\n' * 6000
    began = time.time()
    assert spark.range(1).select(license.licenses(ids).alias("names")).first()["names"] == ""
    assert license.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["licenses"] == ""
    assert time.time() - began < 30


# 3: SimHash


def brute_components(fps: dict) -> dict:
    ids, label = list(fps), {i: i for i in fps}
    find = lambda i: i if label[i] == i else find(label[i])
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicates_match_brute_force(spark, documents):
    rows = {r["doc_id"]: r["text"] for r in documents.collect()}
    fps = {i: simhash.fingerprint(t) & (2**64 - 1) for i, t in rows.items()}
    want = {i: (f"{fps[i]:016x}", c) for i, c in brute_components(fps).items()}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(documents).collect()} == want


def test_fingerprint_is_the_majority_of_shingle_hashes():
    import xxhash

    text = "The the THE é cat\tsat on\nthe mat the the the"
    words = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) & (2**64 - 1) == want and simhash.fingerprint(" ") == 0


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
@settings(max_examples=300, deadline=None)
def test_every_pair_within_the_radius_collides(x, flips):
    y = x
    for b in flips:
        y ^= 1 << b
    assert any(x & m == y & m for m in simhash.covering_masks(list(range(64))))


def test_large_buckets_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CAP", 4)
    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(4)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(63), rng.randint(0, 2))) for b in base for _ in range(60)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r["node"]: r["label"] for r in simhash.components(simhash.links(df)).collect()}
    want = brute_components({f: f for f in fps})
    assert {f: got.get(f, f) for f in fps} == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 200)], "a long, b long")
    got = {r["node"]: r["label"] for r in simhash.components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 200: 100}


def test_one_of_each_group_stays(spark, odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "5", "6", "7", "8", "9", "None"])


def test_rows_of_one_id_or_none_are_told_apart_by_text(spark):
    text = ["ten green bottles hang on the wall", "a wholly other text about rivers and lakes", "nothing here looks like either of the two"]
    rows = [(5, text[0], 1), (5, text[1], 2), (5, text[1], 3), (None, text[2], 4), (7, text[2], 5), (None, text[0] + " now and then", 6), (None, None, 7), (None, "", 8)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, kept_id int")).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept) == sorted([("5", text[0]), ("5", text[1]), ("7", text[2]), ("None", text[0] + " now and then"), ("None", "")])


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_near_copies_of_many_edits_go(spark):
    rng, texts = random.Random(7), []
    for n in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        for edits in (0, 4, 6, 30):
            at = set(rng.sample(range(300), edits))
            texts.append(" ".join("x%d" % rng.randrange(5000) if i in at else w for i, w in enumerate(words)))
    fps = [simhash.fingerprint(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    assert sum((fps[i] ^ fps[j]).bit_count() > simhash.RADIUS for i, j in near) > 10
    label = list(range(len(texts)))
    for _ in label:
        for i, j in near + [(i, j) for i in label for j in range(i) if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= simhash.RADIUS]:
            label[i] = label[j] = min(label[i], label[j])
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label)) and len(set(label)) > 12


def test_leaders_join_groups_without_a_hub(spark, monkeypatch):
    """Variants of which no one is near all others, several groups, all in common buckets: rounds of leaders and blocks lose no link."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    monkeypatch.setattr(simhash, "LEADERS", 2)
    monkeypatch.setattr(simhash, "PART", 5)
    monkeypatch.setattr(simhash, "HOT", 6)
    monkeypatch.setattr(simhash, "signature", lambda own: bytes(2 * simhash.BANDS * simhash.ROWS) if len(own) else None)
    rng, texts = random.Random(9), []
    for _ in range(4):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for _ in range(15):
            at = set(rng.sample(range(200), rng.choice((1, 3, 4, 9))))
            texts.append(" ".join("x%d" % rng.randrange(5000) if i in at else w for i, w in enumerate(words)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [simhash.set_of(simhash.words_of(t)) for t in texts]
    nodes = spark.createDataFrame([(simhash.fingerprint(t), k, k, simhash.signature(s)) for k, (t, s) in enumerate(zip(texts, sets))], "fp long, shingles long, doc_id long, sig binary")
    nodes = nodes.join(df, "doc_id").select("fp", "shingles", "doc_id", F.xxhash64("text").alias("text_hash"), "sig")
    fps = [simhash.fingerprint(t) for t in texts]
    assert len(set(fps)) == len(fps)
    pairs = [(fps[i], fps[j]) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    calls = []
    leaders = simhash._links_to_leaders
    monkeypatch.setattr(simhash, "_links_to_leaders", lambda *a: calls.append(1) or leaders(*a))
    got = {r["node"]: r["label"] for r in simhash.set_labels(df, nodes, spark.createDataFrame([], "a long, b long")).collect()}
    assert calls and {frozenset(g) for g in groups_of(fps, pairs)} == {frozenset(f for f in fps if got.get(f, f) == label) for label in {got.get(f, f) for f in fps}}


def test_files_of_a_scope_go_and_results_stay(spark):
    from pathlib import Path

    from rillgraph.llm.common import cut, scratch

    with scratch(spark):
        inner = cut(spark.range(3))
        stays = cut(spark.range(4), outlives=True)
        with scratch(spark):
            up = cut(inner, outlives=True)
        assert up.count() == 3
    assert stays.count() == 4
    assert not any(Path(f.removeprefix("file://")).exists() for f in inner.inputFiles() + up.inputFiles())


def test_common_counts_and_joining_pairs_match_brute_force(monkeypatch):
    rng = np.random.default_rng(1)
    base = [rng.integers(0, 10**6, 50).astype(np.uint64) for _ in range(5)]
    sets = [np.unique(np.concatenate([rng.permutation(b)[:45], rng.integers(0, 10**6, k).astype(np.uint64)])) for b in base for k in (0, 1, 2, 5, 9, 20)]
    got = simhash.common_counts(sets, sets[:20])
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[:20]] for a in sets]).all() and simhash.common_counts(sets[:1], []).shape == (1, 0)
    labels = np.array([k // 2 for k in range(len(sets))])
    near = simhash.alike(got, np.array(list(map(len, sets)))[:, None], np.array(list(map(len, sets[:20])))[None, :])
    pairs = simhash.joining(near, labels, labels[:20])
    merge = lambda found: {frozenset(g) for g in groups_of(range(15), [(labels[i], labels[j]) for i, j in found])}
    assert merge(pairs) == merge(np.argwhere(near).tolist()) and len(pairs) < 15


def groups_of(nodes, pairs):
    label = {n: n for n in nodes}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return [[n for n in nodes if label[n] == r] for r in set(label.values())]


@pytest.mark.parametrize("sizes", [(512, 4096, 2000), (3, 4, 5)])
def test_groups_with_and_without_a_hub_match_brute_force(spark, monkeypatch, sizes):
    """Copies of one text, near it but not each other; copies of a text that is not there; chains; and blocks, parts and hot keys of a few rows."""
    for name, size in zip(("BLOCK", "PART", "HOT"), sizes):
        monkeypatch.setattr(simhash, name, size)
    rng, texts = random.Random(11), []
    edit = lambda words, n: [f"y{rng.randrange(9999)}" if i in set(rng.sample(range(len(words)), n)) else w for i, w in enumerate(words)]
    for kind in ("hub", "no hub", "chain", "alone"):
        for _ in range(3):
            words = [f"w{rng.randrange(5000)}" for _ in range(220)]
            family = [words] if kind in ("hub", "alone") else []
            for _ in range({"alone": 0}.get(kind, 14)):
                near = edit(family[-1] if kind == "chain" and family else words, 4)
                family.append(near)
            texts += [" ".join(f) for f in family]
    sets = [simhash.shingle_set(t) for t in texts]
    fps = [simhash.fingerprint(t) for t in texts]
    share = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if share(i, j) >= 0.8 or ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 3]
    want = {min(g) for g in groups_of(range(len(texts)), pairs)}
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == want and len(want) < len(texts) / 2


def test_the_join_of_kept_rows_shuffles_at_every_size(documents):
    plan = simhash.keep_one(documents)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


# 4: packing


def test_pieces_hold_every_id_once(spark, odd):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = packing.pack(odd.filter("doc_id is not null").dropDuplicates(["doc_id"]), path, emit_ids=True).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
    for doc_id, pieces in docs.items():
        pieces.sort(key=lambda r: r["start"])
        ids = t.encode(texts[doc_id] or "", add_special_tokens=False).ids + [1]
        assert [i for p in pieces for i in p["ids"]] == ids and pieces[0]["doc_tokens"] == len(ids)
        assert [p["start"] for p in pieces] == [sum(q["length"] for q in pieces[:k]) for k in range(len(pieces))]
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in pieces] == [sum(q["length"] for q in pieces[:k]) for k in range(len(pieces))]
        assert sum(p["length"] for p in pieces) <= pieces[0]["tier"] <= 2048


def test_padding_is_little_and_steps_are_even(spark, documents):
    rows = packing.pack(documents.coalesce(1), vocabulary("word_bpe_49k.json")).collect()
    lengths, groups = Counter(), defaultdict(set)
    for r in rows:
        lengths[r["sequence_id"]] += r["length"]
        groups[r["step_group"]].add((r["sequence_id"], r["tier"]))
    padding = sum(2048 - n for n in lengths.values() if n & (n - 1))
    assert padding < 2048
    totals = Counter(sum(t for _, t in g) for g in groups.values())
    assert totals.most_common(1)[0][0] == packing.STEP_TOKENS and max(totals) == packing.STEP_TOKENS


def test_chunks_encode_as_whole_texts(monkeypatch):
    """Chunk by chunk, with small buffers and a small memory, gives the ids of the tokenizer on whole texts."""
    from tokenizers import Tokenizer

    rng = random.Random(3)
    letters = "aAbZz\u00e9 \u00c9\u00df\u0130\u0131\u03a3\u03c2\u01c5\u212b\u0958\u0928\u093c\u0338\u0301=<>'.,-19\u0663\u00b2 \t\n\r\x0b\x0c\x1c\x85\u00a0\u2028\u3000\x00\U0001f600\ud55c\u4e2d\ufb01|$_`s t re ll d m"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["don't we'll 'std a'b ''s .'s x's1 I'M", "<|endoftext|> a <|x", "", " ", "ab " * 5000, "a" * 5000]
    monkeypatch.setattr(packing, "BUFFER", 2000)
    path = vocabulary("word_bpe_49k.json")
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]
    got = packing.Chunks(path, 500).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want


# 5: quality rules


def brute_counts(text):
    text = text or ""
    words = regex.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if regex.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), len(regex.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


@given(st.text("ab #*\n\t.é", max_size=120))
@settings(max_examples=200, deadline=None)
def test_counts_match_brute_force(text):
    assert quality_rules.statistics(text)[0] == brute_counts(text)


def test_counts_of_documents(spark, documents):
    for r in documents.collect():
        assert quality_rules.statistics(r["text"])[0] == brute_counts(r["text"])


def test_flat_trees_score_as_recursion_and_stay_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((800, len(quality_rules.FEATURES)))
    y = ((x[:, 2] < 0.4) & (x[:, 5] < 0.7) | (rng.random(800) < 0.1)).astype(float)
    model = quality_rules.fit(x, y)

    def walk(node, row):
        while model.feature[node] >= 0:
            node = model.left[node] if row[model.feature[node]] <= model.threshold[node] else model.right[node]
        return model.value[node]

    want = [model.bias + sum(walk(r, row) for r in model.roots) for row in x[:50]]
    assert np.allclose(model.margin(x[:50]), want)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.85
    for f in np.flatnonzero(quality_rules.MONOTONE):
        grid = np.repeat(x[:40], 20, axis=0)
        grid[:, f] = np.tile(np.linspace(0, 1, 20), 40)
        assert (np.diff(model.margin(grid).reshape(40, 20), axis=1) * quality_rules.MONOTONE[f] >= -1e-9).all()


def labels_of(spark, sf="/root/testdata/sf0.01"):
    return {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}


def test_clean_documents_are_kept(spark):
    labels = labels_of(spark)
    rows = [r for r in QUERIES["op5_quality_rules"](spark, "/root/testdata/sf0.01").collect() if r["doc_id"] in labels and not r["base_failed"]]
    agree = [r["kept"] == bool(labels[r["doc_id"]]) for r in rows]
    assert sum(agree) / len(agree) > 0.97


def test_held_out_labels_of_the_trees(spark):
    """The verdict on labelled documents that the fit never saw."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    from rillgraph.llm.common import held_out

    model, want = quality_rules.train(docs, labels, allowed=~held_out("doc_id", 3, 1)), labels_of(spark)
    rows = [r for r in quality_rules.judge(docs, model).collect() if r["doc_id"] in want and not r["base_failed"] and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert len(rows) > 50 and sum(r["kept"] == bool(want[r["doc_id"]]) for r in rows) / len(rows) > 0.95


# 6: factorisation machine


def test_pair_sum_identity():
    m = quality_fm.Machine()
    places, values = quality_fm.inputs("Some words, some more!")
    m.w[:] = np.linspace(-1, 1, len(m.w))
    pairs = sum(float(m.v[a] @ m.v[b]) * values[i] * values[j] for i, a in enumerate(places) for j, b in enumerate(places) if i < j)
    z = m.w[places] @ values + pairs
    assert abs(m.score(places, values) - 1 / (1 + np.exp(-z))) < 1e-9


def test_held_out_quality(spark):
    labels = labels_of(spark)
    rows = [r for r in QUERIES["op6_quality_score"](spark, "/root/testdata/sf0.01").collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in rows) / len(rows) > 0.95


# 7: byte-level BPE


@pytest.fixture(scope="module")
def pair():
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    return bpe.load(path), Tokenizer.from_file(path)


@given(st.text(st.sampled_from("abtheinr  .,'s1é日\n\t🙂<|>"), max_size=60))
@settings(max_examples=200, deadline=None)
def test_ids_match_the_library(pair, text):
    own, library = pair
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_documents_match_the_library(spark, odd, documents, pair):
    for df in (odd.filter("doc_id <> 1"), documents):
        texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        for r in bpe.round_trip(df, vocabulary("byte_bpe_50k.json")).collect():
            ids = pair[1].encode(texts[r["doc_id"]], add_special_tokens=False).ids
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
        encoded = bpe.encode(df, vocabulary("byte_bpe_50k.json"))
        assert {r["doc_id"]: r["text"] for r in bpe.decode(encoded, vocabulary("byte_bpe_50k.json")).collect()} == texts


# 8: Ogg


def slow_crc(data: bytes) -> int:
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return crc


@given(st.binary(max_size=300))
@settings(max_examples=60, deadline=None)
def test_page_checksum(data):
    assert ogg.checksum(data) == slow_crc(data)


@given(st.lists(st.integers(0, 70000), min_size=1, max_size=5), st.lists(st.integers(0, 600), min_size=1, max_size=5))
@settings(max_examples=30, deadline=None)
def test_streams_come_apart_again(a, b):
    make = lambda sizes, byte: [(bytes([byte]) * n, k) for k, n in enumerate(sizes)]
    got = ogg.demux(ogg.mux([ogg.stream_pages(1, make(a, 7)), ogg.stream_pages(2, make(b, 9))]))
    assert [p for p, _ in got[1]] == [p for p, _ in make(a, 7)] and [p for p, _ in got[2]] == [p for p, _ in make(b, 9)]
    assert got[1][-1][1] == len(a) - 1


def test_broken_pages_are_told(spark):
    media = bytearray(ogg.store(*ogg.padded("some text " * 1000)))
    media[-3] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        ogg.demux(bytes(media))
    with pytest.raises(ValueError, match="cut off"):
        ogg.demux(bytes(media[:-10]))
    rows = ogg.demux_column(spark.createDataFrame([(1, bytes(media)), (2, ogg.store(*ogg.padded("x")))], "doc_id long, media binary")).collect()
    assert [r["error"] is None for r in rows if r["doc_id"] == 1] == [False] and len([r for r in rows if r["doc_id"] == 2]) == 4


def test_media_columns(spark, odd):
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in ogg.media_digests(odd).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


# 9: language


def test_forward_backward_matches_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    emit, move, lengths = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), np.array([3, 0, 4])
    gamma, pair, total = language.forward_backward(emit, lengths, move)
    want, pairs, logs = np.zeros((7, 3)), np.zeros((3, 3)), 0.0
    for start, n in ((0, 3), (3, 4)):
        paths = {p: np.exp(sum(emit[start + i, k] for i, k in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:]))) for p in product(range(3), repeat=n)}
        z = sum(paths.values())
        logs += np.log(z)
        for p, w in paths.items():
            for i, k in enumerate(p):
                want[start + i, k] += w / z
            for a, b in zip(p, p[1:]):
                pairs[a, b] += w / z
    assert np.allclose(gamma, want) and np.allclose(pair, pairs) and abs(total - logs) < 1e-9
    assert np.allclose(language.marginals(emit, lengths, move), want)


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op9_language"](spark, sf).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) / len(held) > 0.97


def test_code_switched_words(spark, documents):
    model = language.train(documents)
    text = "the thing and that with under eau les quelle pour une avec mentaux"
    row = language.label_words(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert row["langs"][0] == "en" and row["langs"][-1] == "fr"
    assert model.predict([None, "", "12 !", "the and that"])[:3] == [("und", 0.0)] * 3


def test_words_of_held_out_splices(spark):
    """Word by word, over chains that switch language, of documents that training never saw; and switches are learned."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    held = [(language.words_of(r["text"]), model.languages.index(r["lang"])) for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and r["lang"]]
    right = total = 0
    for pieces, golds in language.spliced([h for h in held if h[0]], seed=99):
        gamma = model.label([" ".join(w for p in pieces for w in p)])[0]
        gold = np.concatenate(golds)
        right, total = right + int((gamma.argmax(axis=1) == gold).sum()), total + len(gold)
    assert total > 5000 and right / total > 0.97
    stay = np.diag(model.move).mean() - model.move[~np.eye(len(model.move), dtype=bool)].mean()
    assert 0.5 < stay < 10


@pytest.mark.parametrize("longest", [95, 96, 97, 500, 1000])
def test_blocks_of_long_chains_are_joined_exactly(longest):
    rng = np.random.default_rng(longest)
    lengths = np.array([longest, 1, 40, 193, longest - 3])
    emit, move = rng.normal(size=(lengths.sum(), 4)), rng.normal(size=(4, 4))
    assert np.allclose(language.marginals(emit, lengths, move), language.forward_backward(emit, lengths, move)[0], atol=1e-12)


def test_every_language_is_learned(spark):
    rows = [(k, f"q{k % 90}x{k % 90} zz{k % 90}", f"l{k % 90:02d}", "s", 3) for k in range(900)]
    assert len(language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")).languages) == 90


def test_a_fit_of_many_languages_needs_little_memory(monkeypatch):
    """100 languages of 15 passages of 600 words: the peak is far below words times languages, which alone would be 1.4 GB each time."""
    import tracemalloc

    monkeypatch.setattr(language, "ROUNDS", 1)
    rnd = random.Random(4)
    own = lambda k: ["".join(chr(97 + (k * 7 + rnd.randrange(9)) % 26) for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    names = [f"l{k:03}" for k in range(100)]
    sample = [(" ".join(rnd.choice(words) for _ in range(600)), name) for k, name in enumerate(names) for words in [own(k)] for _ in range(15)]
    tracemalloc.start()
    field = language.Field(names).fit(sample)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 600 << 20 and field.weights.any() and field.move.any()


def test_batches_of_a_fit_change_nothing(documents, monkeypatch):
    """Gradients are sums over chains, so one batch and many learn the same."""
    sample = [(r["text"][:3000], r["lang"]) for r in documents.filter("length(text) > 300 and lang is not null").orderBy("doc_id").limit(24).collect()]
    names = sorted({y for _, y in sample})
    fits = []
    for cells in (1 << 30, 700):
        monkeypatch.setattr(language, "FIT_CELLS", cells)
        fits.append(language.Field(names).fit(sample))
    assert np.allclose(fits[0].move, fits[1].move, atol=1e-6) and np.allclose(fits[0].weights, fits[1].weights, atol=1e-4) and fits[0].lexicon == fits[1].lexicon


def test_short_texts_need_a_smaller_share():
    model = language.Field(["a", "b"])
    assert model.sure("one two", 0.3) and not model.sure("word " * 200, 0.45) and model.sure("word " * 200, 0.5)


# 10: chat


def test_chat_windows(spark):
    turns = [(1, 0, "system", "be <kind>~1"), *((1, k, "user" if k % 2 else "assistant", f"t{k} </s>[INST] " + "w " * (150 * (k % 5))) for k in range(1, 12)), (2, 0, "assistant", None), (2, 0, "assistant", None), (3, None, None, "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    windows = chat.windows(df).collect()
    own = sorted((w for w in windows if w["conv_id"] == 1), key=lambda w: w["window"])
    assert len(own) > 1 and all(w["text"].startswith("<s>[system]be ~1kind>~01</s>") for w in own) and own[1]["n_repeated"] >= 1
    got = {r["conv_id"]: r for r in chat.digests(chat.windows(df)).collect()}
    plain = "".join(f"{r}\n{t}\n" for _, _, r, t in turns[:12])
    loss = "".join(t for c, _, r, t in turns if c == 1 and r == "assistant")
    assert got[1]["turns_sha256"] == hashlib.sha256(plain.encode()).hexdigest() and got[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[2]["n_turns"], got[2]["loss_chars"], got[3]["n_turns"]) == (12, len(loss), 2, 0, 1)


def plain_windows(turns, budget, history, history_budget):
    """By a loop: [(members, n_repeated)] of one conversation's ordered (role, text) turns."""
    cost = [chat.TURN_TOKENS + -(-len(t) // 4) for _, t in turns]
    lead = bool(turns) and turns[0][0] == "system"
    room = max(budget - (cost[0] if lead else 0), 0)
    aside = min(history_budget, room // 4)
    stride = max((room - aside) // 2, 1)
    spans, before, last = [], 0, None
    for k in range(lead, len(turns)):
        alone = cost[k] > stride
        key = ("alone", k) if alone else ("bin", before // stride, last[2] if last and last[0] == "bin" else k)
        if last is None or alone or last[0] == "alone" or key[1] != last[1]:
            spans.append([])
            key = key[:2] + (k,)
        spans[-1].append(k)
        last, before = key, before + cost[k]
    out = []
    for n, span in enumerate(spans or [[]]):
        fits = max(room - cost[span[0]], 0) if span and cost[span[0]] > stride else aside
        again = []
        for k in range(span[0] - 1 if span else -1, -1, -1):
            if k < lead or len(again) == history or sum(cost[j] for j in [k, *again]) > min(fits, aside):
                break
            again.insert(0, k)
        if lead and n == 0:
            out.append(([0, *span], 0))
        else:
            out.append(([0] * lead + again + span, lead + len(again)))
    return out


def test_windows_match_a_loop(spark):
    rng, rows, want = random.Random(2), [], {}
    budgets = (200, 3, 48)
    for conv in range(60):
        size = rng.choice([5, 40, 200, 900])
        turns = [("system" if k == 0 and conv % 3 == 0 else "user" if k % 2 else "assistant", "<a> " + "é" * rng.randrange(size)) for k in range(rng.randint(1, 25))]
        if conv == 6:
            turns[0] = ("system", "x" * 3000)
        rows += [(conv, k, r, t) for k, (r, t) in enumerate(turns)]
        for n, (members, repeated) in enumerate(plain_windows(turns, *budgets)):
            text, loss = "", []
            for place, k in enumerate(members):
                role, body = turns[k]
                head = f"<s>[{role}]"
                marked = body.replace("~", "~0").replace("<", "~1").replace("[", "~2").replace("]", "~3")
                if place >= repeated and role == "assistant":
                    loss.append((len(text) + len(head), len(marked)))
                text += head + marked + "</s>"
            want[conv, n] = (text, repeated, loss)
            tokens = sum(chat.TURN_TOKENS + -(-len(turns[k][1]) // 4) for k in members)
            assert tokens <= budgets[0] or len(members) <= 1 + (turns[0][0] == "system")
    got = chat.windows(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), *budgets).collect()
    assert {(r["conv_id"], r["window"]): (r["text"], r["n_repeated"], [tuple(x) for x in r["loss"]]) for r in got} == want


def test_odd_conversations(spark):
    """Null ids, roles and turns, repeated rows, and columns whose names are those of the steps."""
    from pyspark.sql import functions as F

    rows = [(None, None, None, None), (None, 1, "assistant", "a~1b"), (1, 1, "assistant", "same"), (1, 1, "assistant", "same"), (2, 0, "system", "only"), (3, 0, "system", "s" * 9000), (3, 1, "assistant", "x" * 9000), (3, 2, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    for name in ("k", "window", "before", "t", "c", "start", "loss", "body"):
        df = df.withColumn(name, F.lit("other"))
    got = {r["conv_id"]: r for r in chat.digests(chat.windows(df)).collect()}
    assert {i: (r["n_turns"], r["loss_chars"]) for i, r in got.items()} == {None: (2, 4), 1: (2, 8), 2: (1, 0), 3: (3, 9000)}
    assert got[None]["turns_sha256"] == hashlib.sha256(b"\n\nassistant\na~1b\n").hexdigest()


def test_one_long_conversation(spark):
    """Thousands of turns in one conversation: rows and windows grow in proportion, and no window is over its budget."""
    from pyspark.sql import functions as F

    turns = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.repeat(F.lit("word "), 100).alias("text"))
    windows = chat.windows(turns)
    assert windows.filter("over_budget").isEmpty()
    got = chat.digests(windows).first()
    assert (got["n_turns"], got["loss_chars"]) == (20_000, 5_000_000)


# all of them


RUNS = {
    "op2": lambda d, s: license.scan(d),
    "op3": lambda d, s: simhash.near_duplicates(d),
    "op4": lambda d, s: packing.pack(d, vocabulary("word_bpe_49k.json")),
    "op5": lambda d, s: quality_rules.judge(d, quality_rules.train(d, s)),
    "op6": lambda d, s: quality_fm.score(d, quality_fm.train(d, s)),
    "op7": lambda d, s: bpe.round_trip(d, vocabulary("byte_bpe_50k.json")),
    "op8": lambda d, s: ogg.media_digests(d),
    "op9": lambda d, s: language.identify(d, language.train(d)),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_odd_and_empty_tables(spark, odd, name):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 1), (6, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    rows = RUNS[name](odd, labels).collect()
    ids = Counter(str(r["doc_id"]) for r in rows)
    assert set(ids) == {str(r["doc_id"]) for r in odd.collect()}
    if name != "op4":
        assert len(rows) == odd.count() and ids["1"] == 2
    assert RUNS[name](odd.limit(0), labels.limit(0)).collect() == []


def test_empty_pages_and_conversations(spark):
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string, host string, path string")).collect() == []
    assert chat.digests(chat.windows(spark.createDataFrame([], "conv_id long, turn int, role string, text string, k int"))).collect() == []


def test_pipeline_matches_brute_force_on_200_documents(spark, documents, tmp_path):
    """All four stages by plain loops over 200 documents (trained parts judge one document at a time), and nothing of the stages stays on disk."""
    from pathlib import Path

    import corpus_pipeline

    docs = documents.orderBy("doc_id").limit(200)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    shared = Path(simhash.place(spark)).parent
    there = {p.name for p in shared.iterdir()} if shared.exists() else set()
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len({p.name for p in shared.iterdir()} - there) <= 2

    tongue = language.train(docs)
    known = [r["doc_id"] for r in language.keep(docs, tongue).select("doc_id").collect()]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(any(c.isalpha() for c in texts[i]) for i in known)
    first = docs.filter(docs["doc_id"].isin(known))
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules.judge(first, quality_rules.train(first, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    good = sorted(i for i in known if verdict[i])
    fps = {i: simhash.fingerprint(texts[i]) for i in good}
    near = [(i, j) for i in good for j in good if j < i and (((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 3 or jaccard(texts[i], texts[j]) >= 0.8)]
    label = {i: i for i in good}
    for _ in good:
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    kept = set(label.values())
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == kept and len(kept) < len(good)
    for i, own in pieces.items():
        ids, at = [*library.encode(texts[i], add_special_tokens=False).ids, 1], 0
        for r in sorted(own, key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r["length"]
        assert at == len(ids)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = corpus_pipeline.run(spark, SF).collect()
    kept = {r["doc_id"] for r in rows}
    all_ids = {r["doc_id"] for r in docs.collect()}
    assert kept < all_ids and len(kept) > len(all_ids) / 3
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd):
    """Every stage takes nulls, repeated rows, long texts and other columns, and an empty table."""
    import corpus_pipeline

    docs = odd.filter("doc_id is null or doc_id <> 7")
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, SF)
            n = out.count()
            assert n == 0 if rows is not docs else name == "packing" or out.columns == docs.columns and n <= docs.count()
