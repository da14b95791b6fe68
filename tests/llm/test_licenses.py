import random
import re

from histoloom.llm import licenses

WORDS = re.compile(r"[a-z0-9\x80-\U0010ffff]+")


def plain(texts, templates, containment):
    """Every place by trying all of them."""
    out = []
    for i, text in enumerate(texts):
        w = WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        have = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        for name, template in templates.items():
            t = WORDS.findall(template.lower())
            own = [tuple(t[k : k + 3]) for k in range(len(t) - 2)]
            if any(sum(s in set(have[max(0, k) : k + len(own) + len(own) // 4]) for s in own) >= containment * len(own) for k in range(-(len(own) // 4), len(have))):
                out.append((i, name))
    return set(out)


def test_scan_against_all_places():
    r = random.Random(2)
    texts = []
    names = sorted(licenses.TEMPLATES)
    for i in range(150):
        w = [r.choice("alpha beta the of license version and under".split()) for _ in range(r.randrange(0, 60))]
        if i % 3:
            t = licenses.TEMPLATES[r.choice(names)].split()
            for _ in range(i % 2):
                t[r.randrange(len(t))] = "changed"
            w[len(w) // 2 : len(w) // 2] = t
        texts.append(" ".join(w).upper() if i % 5 == 0 else "\n".join(w))
    texts += [None, "", "all rights", "All Rights  RESERVED", "rés all rights reserved"]
    index = licenses.Index.of(licenses.TEMPLATES)
    got = {(i, name) for i, name, _, _ in licenses.scan(texts, index, 0.8)}
    assert got == plain(texts, licenses.TEMPLATES, 0.8)


def test_matches_do_not_cross_documents():
    index = licenses.Index.of(licenses.TEMPLATES)
    assert licenses.scan(["all rights", "reserved"], index, 0.8) == []
    two = "All rights reserved. x y z all rights reserved"
    assert [(i, w) for i, _, w, _ in licenses.scan(["a b", two], index, 0.8)] == [(1, 0), (1, 6)]


def test_find(spark, docs, no_docs):
    rows = [(1, "text. Licensed under CC BY-NC 4.0."), (2, None), (3, ""), (None, "Released under the MIT License."), (1, "text. Licensed under CC BY-NC 4.0.")]
    got = licenses.find(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r.doc_id), r.license, r.word, r.share) for r in got.collect()) == [("1", "CC-BY-NC-4.0 (line)", 1, 1.0)] * 2 + [("None", "MIT (line)", 0, 1.0)]
    assert licenses.find(docs).count() == 0 and licenses.find(no_docs).count() == 0


def test_texts_that_begin_or_end_inside_a_notice():
    index = licenses.Index.of(licenses.TEMPLATES)
    for name in ("MIT", "GPL-3.0", "ISC", "Apache-2.0"):
        w = licenses.TEMPLATES[name].split()
        for n in range(10):
            texts = ["some words of another text", " ".join(w[n:]), "and of one more", " ".join(w[: len(w) - n])]
            got = {(i, x) for i, x, *_ in licenses.scan(texts, index, 0.8)}
            assert got == plain(texts, licenses.TEMPLATES, 0.8), (name, n)
            if name == "MIT":
                assert (1, name) in got


def test_whole_texts_notices_and_variants():
    texts = {
        "GPL-2.0": licenses.KNOWN["GPL-2.0 (whole)"],
        "LGPL-2.1": licenses.KNOWN["LGPL-2.1 (whole)"],
        "CC-BY-SA-4.0": licenses.KNOWN["CC-BY-SA-4.0 (whole)"],
        "BSD-2-Clause": licenses.KNOWN["BSD-2-Clause (whole)"],
        "MIT": "x Licensed under the MIT License. y",
        "Apache-2.0": "x Licensed under the Apache License 2.0 y",
        "GPL-3.0": "Distributed under the terms of the GNU GPLv3.",
        "AGPL-3.0": "This is free software under the GNU Affero General Public License v3.0",
        "EPL-2.0": "Available under the Eclipse Public License 2.0",
        "CC-BY-NC-4.0": "under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "CC-BY-ND-4.0": "Shared under CC BY-ND 4.0",
        "Unlicense": "SPDX-License-Identifier: Unlicense",
    }
    got = licenses.scan(list(texts.values()), licenses.Index.of(licenses.KNOWN), 0.8)
    for i, spdx in enumerate(texts):
        assert spdx in {name.split(" (")[0] for k, name, *_ in got if k == i}, spdx


def test_siblings_are_told_apart():
    known = licenses.KNOWN
    agpl = known["GPL-3.0"].replace("GNU General", "GNU Affero General")
    cc = "This work is licensed under a Creative Commons {} 4.0 International License."
    texts = [
        (known["GPL-3.0"].replace("version 3", "version 2"), ["GPL-2.0"]),
        (known["GPL-3.0"], ["GPL-3.0"]),
        (agpl, ["AGPL-3.0"]),
        ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        (known["MPL-1.1"], ["MPL-1.1"]),
        *((cc.format(kind), [f"CC-{k}-4.0"]) for k, kind in licenses._CC.items()),
        *((known[f"{k} (whole)"], [k]) for k in licenses.WHOLE),
        (known["BSD-3-Clause (whole)"].replace("University", "Company"), ["BSD-3-Clause"]),
        (known["MIT-0 (whole)"], ["MIT-0"]),
        (known["0BSD (whole)"], ["0BSD"]),
        (known["BSD"], ["BSD"]),
        ("Under the MIT License. " + known["MIT (whole)"] + " Code under the Apache License 2.0.", ["MIT", "MIT", "Apache-2.0"]),
    ]
    got = licenses.quoted([t for t, _ in texts], licenses.Index.of(known), 0.8)
    for i, (text, want) in enumerate(texts):
        assert [licenses.license_of(name) for k, name, *_ in got if k == i] == want, text[:200]
