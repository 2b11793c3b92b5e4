"""Operators 4 and 9."""

import hashlib
import os
import random
import re
import unicodedata

import pytest

from pulsewatch.llm import html, licenses

from .helpers import docs, empty_docs

COMMON = "/usr/share/common-licenses"


def brute_canonical(text):
    t = (text or "").lower()
    t = "\n".join(" " if re.match(r"[\W_]*(copyright|\(c\)|©)", x) else x for x in t.split("\n"))
    t = re.sub(r"(?<=\S)-\s*\n\s*(?=\S)|\bnon-(?=commercial)|\bsub-(?=licen)", "", t)
    w = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in t).split()
    return " ".join(licenses.EQUIVALENT.get(x, x) for x in w)


def brute_scan(texts):
    known = {brute_canonical(t): name for name, t in sorted(licenses.known_texts(), reverse=True)}
    out = {}
    for i, t in texts:
        t = t or ""
        lines, paragraphs = t.split("\n"), re.split(r"\n[ \t\r]*\n\s*", t)
        units = [("text", t)] + [("p", x) for x in paragraphs if len(paragraphs) > 1] + [
            ("line", x) for x in lines if len(lines) > 1]
        for kind, x in units:
            name = known.get(brute_canonical(x))
            if name and brute_canonical(x):
                whole, n = out.get((i, name), (False, 0))
                out[i, name] = (whole or kind == "text", n + 1)
    return sorted((i, name, w, n) for (i, name), (w, n) in out.items())


def test_scan_matches_brute_force(spark):
    full = dict(licenses.known_texts()[:7])
    texts = [
        (0, None), (1, ""), (2, "Released under the MIT License."), (3, "prose here\nRELEASED UNDER THE MIT LICENCE!!\nmore"),
        (4, "Copyright (c) 2020 Somebody\n\n" + full["BSD-3-Clause"]), (5, "x y\n\n" + full["ISC"].upper() + "\n\nz"),
        (6, "this is not licensed under the MIT License."), (7, "word " * 100_000 + "\nLicensed under CC BY-NC 4.0."),
        (8, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."), (9, full["MIT-0"].replace(" ", "  ")),
        (10, "### Licensed under the Apache License, Version 2.0. ***"), (11, "© x\n(c) y"),
    ]
    got = licenses.scan(docs(spark, texts))
    assert sorted(map(tuple, got.collect())) == brute_scan(texts)
    assert {r[0] for r in brute_scan(texts)} == {2, 3, 4, 5, 7, 8, 9, 10}
    assert licenses.scan(empty_docs(spark)).count() == 0


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no licence files here")
def test_long_licences_are_known_whole(spark):
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0",
             "CC0-1.0": "CC0-1.0", "LGPL-2.1": "LGPL-2.1", "LGPL-2": "LGPL-2.0", "GPL-1": "GPL-1.0", "GFDL-1.2": "GFDL-1.2",
             "GFDL-1.3": "GFDL-1.3", "Artistic": "Artistic-1.0-Perl", "MPL-1.1": "MPL-1.1", "BSD": "BSD-3-Clause"}
    texts, want = [], {}
    for file, licence in names.items():
        with open(f"{COMMON}/{file}") as f:
            t = f.read()
        for x in (t, "Copyright 2020 A\n\n" + t.upper(), *licenses.forms(t)):
            want[len(texts)] = licence
            texts.append((len(texts), x))
    got = {r.doc_id: r.licence for r in licenses.scan(docs(spark, texts)).where("whole").collect()}
    assert got == want


def test_file_headers_are_known(spark):
    gpl = ("/* f.c\n\n   This program is free software: you can redistribute it and/or modify\n   it under the terms of the GNU "
           "General Public License as published by\n   the Free Software Foundation, either version 3 of the License, or\n"
           "   (at your option) any later version.\n\n   This program is distributed */\n")
    apache = ("# Copyright 2020 A\n#\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this "
              "file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n"
              "#     http://www.apache.org/licenses/LICENSE-2.0\n#\n# Unless required by applicable law or agreed to in writing, "
              "software\n# distributed under the License is distributed on an \"AS IS\" BASIS,\n# WITHOUT WARRANTIES OR CONDITIONS "
              "OF ANY KIND, either express or implied.\n# See the License for the specific language governing permissions and\n"
              "# limitations under the License.\n\nimport os\n")
    mpl = ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was "
           "not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */\n\nint x;\n")
    agpl = gpl.replace("General", "Affero General")
    free = dict(t for t in licenses.known_texts() if t[0] == "Unlicense" and len(t[1]) > 500)["Unlicense"]
    texts = list(enumerate([gpl, apache, mpl, agpl, free]))
    got = {r.doc_id: r.licence for r in licenses.scan(docs(spark, texts)).collect()}
    assert got == {0: "GPL-3.0", 1: "Apache-2.0", 2: "MPL-2.0", 3: "AGPL-3.0", 4: "Unlicense"}
    assert sorted(map(tuple, licenses.scan(docs(spark, texts)).collect())) == brute_scan(texts)


def test_texts_told_apart_early_are_not_known():
    begins = licenses.beginnings([t for _, t in licenses.known_texts()])
    for _, t in licenses.known_texts():
        for x in (t, t.upper(), "(c) 2020 A\nCopyright B\n" + t, "© c\n\n ** " + t, "...\n" + t, t.replace("License", "Licence")):
            assert licenses.may_be_known(x, begins) and licenses.digest(x) == licenses.digest(t), x
    for x in ("", "...", "Thon the", "copyright only", "unlicensed", "(c) 2020"):
        assert not licenses.may_be_known(x, begins)


def test_no_known_text_is_told_apart_below_any_copyright_line():
    begins = licenses.beginnings([t for _, t in licenses.known_texts()])
    known = {licenses.digest(t) for _, t in licenses.known_texts()}
    marks = ["Copyright 2020 Acme", "Copyrights 2020 Acme", "Copyrighted by Acme", "COPYRIGHT2020", "copyrightholder: a", "(C)2020 A",
             "( c ) A", "©2020", "C 2020", "Copy right A", "The copyright A", "_copyright_ A", "copyrıght A", "...", "é (c)"]
    bodies = [t for _, t in licenses.known_texts()[:12]] + ["prose", ""]
    for a in marks:
        for b in ("", *marks):
            for before in ("", " * ", "\n\n# ", "/*"):
                for body in bodies:
                    x = f"{before}{a}\n{before}{b}\n{body}"
                    assert licenses.may_be_known(x, begins) or licenses.digest(x) not in known, x


def test_own_list_of_texts(spark):
    got = licenses.scan(docs(spark, [(1, "Do What You Favour")]), texts=[("own", "do what you favor!"), ("none", "...")])
    assert list(map(tuple, got.collect())) == [(1, "own", True, 1)]


PROSE = ("This is a paragraph of the article that has many of the words which are found in a text, and it goes on and "
         "on for a while so that it is long enough to be sure about, as all of the others on this page are. ")


def test_article_without_page_furniture():
    page = f"""<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body>
      <nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">{PROSE}</div><!-- <p>hidden</p> -->
      <article><header><h1>The  Title &amp; more</h1></header><p>{PROSE}<br>Tom&nbsp;&lt;tag&gt;</p><p>Short.</p>
      <div class="share-buttons">Share this</div><p><b>{PROSE}<p>Last <a href=x>one</a> with &eacute; and a few words</p>
      <aside>{PROSE}</aside><footer>By me</footer></article>
      <section id="comments"><p>{PROSE}</p></section><form><p>{PROSE}</p></form><footer>&copy; us</footer></body></html>"""
    p = PROSE.strip()
    assert html.main_text(page) == "\n\n".join(
        ["The Title & more", p + " Tom <tag>", "Short.", p, "Last one with é and a few words"])


def test_page_without_article_goes_by_block_rules():
    page = f"""<body class="has-sidebar"><header>Site</header><ul><li><a href=/x>Some link</a></li></ul>
      <div class="cookie-notice">{PROSE}</div><div><h1>Title</h1><p>{PROSE}</p><p>Short one.</p><p>{PROSE}</p></div>
      <div role="complementary">{PROSE}</div><p><a href=y>{PROSE}</a></p><footer>{PROSE}</footer>"""
    p = PROSE.strip()
    assert html.main_text(page) == "\n\n".join(["Title", p, "Short one.", p])


def test_names_of_what_holds_the_article_do_not_count():
    p = PROSE.strip()
    inside = f"<article class='post category-social comments-open'><h1>Title</h1><p>{PROSE}</p><div class=share>x</div></article>"
    after = f"<div id=comments><article class=comment><p>{PROSE * 9}</p></article></div>"
    want = f"Title\n\n{p}"
    assert html.main_text(inside) == html.main_text(inside + after) == want
    assert html.main_text(f"<div id=page class='site has-sidebar'>{inside}{after}<div class=sidebar>{PROSE}</div></div>") == want
    assert html.main_text(f"<div class=has-sidebar><div><p>{PROSE}</p></div><div class=ad>{PROSE}</div></div>") == p
    assert html.main_text(f"<div class=has-sidebar><main><p>{PROSE}</p></main></div><div class=comments>{PROSE * 3}</div>") == p
    assert html.main_text(f"<div style='display:none'>{inside}</div>") == html.main_text(f"<form>{inside}</form>") == ""


def test_a_name_in_an_article_does_not_drop_its_text():
    p = PROSE.strip()
    for name in ("entry-content social-ready", "has-share", "reply-to-critics", "no-ads", "share", "post-share"):
        assert html.main_text(f'<article><div class="{name}"><p>{PROSE}</p><p>{PROSE}</p></div></article>') == f"{p}\n\n{p}", name
    for name in ("reply-to-critics", "no-ads", "socialist", "is-hidden-gem"):
        assert html.main_text(f'<article><p>{PROSE * 3}</p><section class="{name}">{PROSE}</section></article>').endswith(f"\n\n{p}")
    for name in ("share", "share-buttons", "post-share", "widget area", "relatedPosts", "newsletter-signup", "ad-300x250", "comment-list"):
        assert html.main_text(f'<article><p>{PROSE * 3}</p><section class="{name}">{PROSE}</section></article>') == " ".join([p] * 3), name
    readers = f"<div class=comments><p>{PROSE * 9}</p></div>"
    assert html.main_text(f"<article><p>{PROSE}</p>{readers}</article>") == p


def test_region_goes_by_its_text():
    p = PROSE.strip()
    teaser = "<article><p>A teaser of another page that is long enough to be taken for the text of this one</p></article>"
    main = f"<main><h1>Title</h1><p>{PROSE}</p><p>{PROSE}</p></main>"
    want = f"Title\n\n{p}\n\n{p}"
    assert html.main_text(teaser + main) == html.main_text(main + teaser) == want
    assert html.main_text(f"<main><p>{PROSE}</p><article><p>{PROSE}</p></article></main>") == p


def test_density_decides_in_an_article_too():
    listed = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my ny xi omikron pi rho sigma tau"
    links = "<p><a href=x>Another page of this site about something else</a></p>"
    p = PROSE.strip()
    page = f"<article><p>{PROSE}</p><p>{listed}</p><p>{PROSE}</p>{links}<p>{listed}</p>{links}<p>{PROSE}</p></article>"
    assert html.main_text(page) == "\n\n".join([p, listed, p, p])


def plain_passes(given, known):
    """The two passes as they are stated: (label) of (text, link characters, furniture, region)."""
    def first(text, links, out, region):
        if out or links > 0.3 * len(text) or ("©" in text and region != "article" and len(text) < 200):
            return "bad"
        words = re.findall(r"[^\W\d_]+", text.lower())
        density = sum(w in html.STOP_WORDS for w in words) / max(1, len(words))
        if len(text) < 70:
            return "bad" if links and region == "page" else "ambiguous"
        if region != "page":
            return "good" if not known or density >= 0.12 else "near"
        if known and density < 0.12:
            return "bad"
        return "good" if len(text) > 200 and (not known or density >= 0.2) else "near"

    labels = [first(*b) for b in given]
    for kind in ("near", "ambiguous"):
        before = list(labels)
        fixed = [i for i, b in enumerate(given) if before[i] in ("good", "bad") and not b[2]]
        for i, label in enumerate(before):
            if label == kind:
                up = max((j for j in fixed if j < i), default=None)
                down = min((j for j in fixed if j > i), default=None)
                near = [(abs(i - j), before[j]) for j in (up, down) if j is not None]
                if not near:
                    labels[i] = "good" if given[i][3] != "page" or kind == "near" else "bad"
                elif kind == "near":
                    labels[i] = "bad" if [x for _, x in near] == ["bad", "bad"] else "good"
                else:
                    least = min(d for d, _ in near)
                    labels[i] = "good" if (least, "good") in near else "bad"
    return labels


@pytest.mark.parametrize("region", ["article", "main", "page"])
def test_passes_match_their_plain_statement(region):
    r = random.Random(4)
    words = "the of and in that house tree river stone window garden paper market".split()
    for _ in range(400):
        given = []
        for _ in range(r.randint(1, 12)):
            bias = r.choice([0, 3, 8, 13])
            text = " ".join(r.choice(words[:5]) if r.randint(0, 12) < bias else r.choice(words[5:]) for _ in range(r.choice([2, 14, 60])))
            text += r.choice(["", "", "", " ©"])
            given.append((text, r.choice([0, 0, 0, len(text), len(text) // 5]), r.random() < 0.1, region))
        known = r.random() < 0.8
        found = [html.Block(*b) for b in given]
        for b in found:
            b.label = html.decide(b, known)
        html.settle(found)
        assert [b.label for b in found] == plain_passes(given, known)


def test_head_without_an_end():
    p = PROSE.strip()
    for head in ("<head><title>T</title><meta charset=utf-8><script>x()</script>", "<head><title>T", "<head><link rel=x><style>p{}</style>",
                 "<title>T</title>", "<head><title>T</title></head>"):
        assert html.main_text(f"<!DOCTYPE html><html>{head}<body><article><p>{PROSE}</p></article>") == p, head
    assert html.main_text(f"<html><head><title>T</title><article><p>{PROSE}</p></article>") == p


def test_copyright_sign_in_long_or_article_blocks():
    p = PROSE.strip()
    assert html.main_text(f"<article><p>{PROSE} Photo © A.</p><p>{PROSE}</p></article>") == f"{p} Photo © A.\n\n{p}"
    assert html.main_text(f"<p>{PROSE * 2}© A</p><p>{PROSE * 2}</p><p>© 2020 Somebody and all that they have made here for us</p>"
                          ) == f"{p} {p} © A\n\n{p} {p}"


def test_language_without_known_stop_words():
    polish = ("Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw, są obdarzeni rozumem i sumieniem "
              "i powinni postępować wobec innych w duchu braterstwa, niezależnie od jakichkolwiek różnic między nimi samymi.")
    page = f"<ul><li><a href=/x>Jeden</a></li></ul><h1>Tytuł</h1><p>{polish}</p><p>Krótko.</p><p>{polish}</p><p><a href=y>{polish}</a></p>"
    assert html.main_text(page) == f"Tytuł\n\n{polish}\n\nKrótko.\n\n{polish}"
    listed = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my ny xi omikron pi rho sigma tau"
    assert html.main_text(f"<p>{PROSE * 2}</p><p>{PROSE * 2}</p><p>{listed}</p>").count("Alpha") == 0


def test_broken_pages():
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p>") == ""
    assert html.main_text("<article><p>Cut off in a ta<b cla") == "Cut off in a ta"
    assert html.main_text("<article><p>x &am") == "x &am"
    assert html.main_text('<article><p title="a>b">kept</p><p title="never closed>also</p></article>').startswith("kept")
    assert html.main_text("<nav><a href=/>x</a><article><p>in</p></article>") == "in"
    long = "<article>" + f"<p>{PROSE}</p>" * 5000
    assert html.main_text(long).count("\n\n") == 4999


def test_extract_keeps_every_row(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>a</p></article>", "x"), (2, None, None, "x"), (2, None, None, "x"),
                                (None, "v", "", "x")], "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html.extract(df).collect()), key=repr)
    assert got == sorted([(1, "u", "a"), (2, None, ""), (2, None, ""), (None, "v", "")], key=repr)
    assert html.extract(df.limit(0)).count() == 0
    assert hashlib.sha256(b"").digest_size == 32
