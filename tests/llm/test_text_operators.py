"""Operators on documents against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import collections
import hashlib
import random
import re

import pyarrow as pa
import pytest

from wayleave.llm import near_dedup, textops
from wayleave.llm.decontaminate import decontaminate, without_contaminated
from wayleave.llm.exact_dedup import exact_dedup, without_copies
from wayleave.llm.licenses import BLANKS, BREAK, license_scan, rules, suppressed
from wayleave.llm.mixing import mix_sources, mixed
from wayleave.llm.near_dedup import near_duplicates, without_near_duplicates
from wayleave.llm.pii import personal_data, sanitised

SCHEMA = "doc_id long, text string, source string, score double, k string, n int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts):
    """Documents with columns that operators use for themselves."""
    return spark.createDataFrame([(i, t, f"s{(i or 0) % 4}" if (i or 0) % 9 else None, 0.5, "k", 1) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(80)]
    base = [rng.choice(words) for _ in range(150)]
    for i in range(100, 160):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append((i, "  ".join(w[: rng.choice([150, 150, 150, 125])])))
    out += [(i, " ".join(base) + "\n") for i in range(200, 260)]
    out += [(300, None), (301, ""), (302, "A b"), (303, "a  b"), (304, " \t"), (305, "x" * 100_000), (306, "y z " * 20_000), (None, "lost"), (307, "é ß 😀 é ß 😀")]
    return out + [(302, "A b"), (302, "A b")]


def test_exact_dedup(spark, texts):
    groups = collections.defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for i, t in texts:
        groups[norm(t)].append(i)
    rows = exact_dedup(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    kept = collections.Counter()
    for r in rows:
        t = next(norm(t) for i, t in texts if i == r.doc_id and hashlib.sha256(norm(t).encode()).hexdigest() == r.text_sha256)
        known = [i for i in groups[t] if i is not None]
        assert (r.keep_id, r.group_size) == (min(known) if known else None, len(groups[t]))
        kept[t] += r.kept
    assert set(kept.values()) == {1}
    assert without_copies(frame(spark, texts)).count() == len(groups)
    assert without_copies(frame(spark, texts)).columns == frame(spark, texts).columns


def components(sets, percent=80):
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("width,block", [(4, 30_000), (5, 3_000)])
def test_near_duplicates(spark, texts, width, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    sets = {}
    for i, t in texts:
        w = SPACED.findall((t or "").translate(LOWER))
        if i is not None:
            sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    want = components(sets)
    rows = near_duplicates(frame(spark, texts), width).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    left = without_near_duplicates(frame(spark, texts), width)
    assert left.columns == frame(spark, texts).columns
    assert sorted(r.doc_id for r in left.where("doc_id is not null").collect()) == sorted(i for i, _ in texts if i is not None and want[i] == i)


def test_decontaminate(spark, texts):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((30, 13, 12, 5, 4, 2, 1, 40))] + [(50, None), (51, " - "), (7, "w1"), (60, "É ß 😀")]
    docs = texts + [(400 + n, f"w3 {t.upper().replace(' ', '-') if t else ''} w4 {t}") for n, (_, t) in enumerate(items)] + [(500, " ".join(t or "" for _, t in items))]
    windows = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        size = min(13, len(w))
        for j in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[j : j + size])].add(str(i))
    rows = decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(rows) == len(docs)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, t in docs:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, named = set(), set()
        for win, ids in windows.items():
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j : j + len(win)]) == win:
                    hit |= set(range(j, j + len(win)))
                    named |= ids
        for r in by[i]:
            assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(named)), i
            assert r.items_sha256 == hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
            assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    clean = without_contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert clean.count() == sum(not r.contaminated for r in rows)
    assert decontaminate(frame(spark, docs), spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0").count() == 0


def test_mixing(spark, texts):
    rows = mix_sources(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    again = mix_sources(frame(spark, texts).repartition(7)).collect()
    assert collections.Counter(rows) == collections.Counter(again)
    size = {i: len(SPACED.findall(t or "")) for i, t in texts}
    source = {i: f"s{(i or 0) % 4}" if (i or 0) % 9 else None for i, t in texts}
    total = collections.Counter()
    for i, _ in texts:
        total[source[i]] += size[i]
    names = sorted(s for s in total if s is not None) + [None]
    weight = {s: 1 + n % 3 for n, s in enumerate(names)}
    target, free = {}, set(names)
    while True:  # targets stop at 3 times the source, the rest is shared again
        rest = sum(total.values()) - sum(target.values())
        over = [s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 3 * total[s]]
        if not over:
            target |= {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        target |= {s: 3 * total[s] for s in over}
        free -= set(over)
    taken = collections.Counter()
    for r in rows:
        assert (r.size, r.source_size) == (size[r.doc_id], total[source[r.doc_id]])
        assert r.target == pytest.approx(target[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    largest = max(size.values())
    for s in names:
        assert abs(taken[s] - target[s]) <= max(0.5 * largest, 0.05 * target[s])
    out = mixed(frame(spark, texts)).collect()
    assert len(out) == sum(r.copies > 0 for r in rows)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


KINDS = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def test_personal_data(spark, texts):
    rng = random.Random(2)
    parts = ["a@b.cc", "_x@d.ee", "é😀 ", "1.2.3.4", ".5.6.7.8", "256.1.1.1", "4111 1111-1111 1111", "4111111111111112", "+1 (555) 123-4567", "+12", " ", "@", ".", "-", "+", "007", "z%y@h-1.co.uk"]
    docs = texts + [(1000 + i, "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))) for i in range(150)]
    docs += [(2000 + i, f"note {i * 7919} {'abc' * i} Zorblatt at j.q@corp.example daily") for i in range(5)]
    rows = personal_data(frame(spark, docs)).collect()
    assert len(rows) == len(docs)
    by = {r.doc_id: r for r in rows}
    for i, t in docs:
        found = [f"{k}:{m.start()}:{m.end()}" for k, p, ok in KINDS for m in p.finditer(t or "") if ok(m[0])]
        assert by[i].base_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest(), t
        assert [s for s in by[i].spans.split(",") if s and not s.startswith("term")] == found
    assert by[2000].n_term > 0
    assert "term:" in by[2003].spans
    clean = {r.doc_id: r.sanitised for r in sanitised(frame(spark, docs)).collect()}
    assert "Zorblatt" not in clean[2001] and "[EMAIL]" in clean[2001]
    assert clean[300] == "" and clean[302] == "A b"


def test_license_scan(spark, texts):
    docs = texts + [(600, "The MIT  license, and apache\nLicense general-public license; smit license mit licenses"), (601, "MIT License " * 300), (602, "SPDX-License-Identifier: GPL-3.0-or-later. GNU Lesser General Public License v2.1"), (603, "licensed under the GNU General Public License, version 3.")]
    rows = license_scan(frame(spark, docs)).collect()
    assert len(rows) == len(docs) and len(rules()) > 200
    by = {r.doc_id: r for r in rows}
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for i, t in docs:
        w = ALNUM.findall((t or "").translate(LOWER))
        at = [(j, la) for p, la in phrases.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        want = (len(w), len(at), min((j for j, _ in at), default=None), max((j for j, _ in at), default=None), ",".join(sorted({la for _, la in at})))
        r = by[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want, t
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    assert "gpl-3.0" in by[602].labels and "lgpl-2.1" in by[602].labels and "gpl-3.0" in by[603].labels


def labels_of(spark, texts):
    rows = license_scan(frame(spark, list(enumerate(texts)))).collect()
    return [set(r.labels.split(",")) for r in sorted(rows, key=lambda r: r.doc_id)]


def test_license_scan_over_lines(spark):
    cases = [
        ("Apache License\n                           Version 2.0, January 2004", "apache-2.0"),
        ("GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007", "gpl-3.0"),
        ("// GNU General Public\n// License as published, version 2", "gpl"),
        (" * GNU General Public\r\n * License v2", "gpl-2.0"),
        ("Permission is hereby granted, free of\ncharge, to any person obtaining a  copy of this", "mit"),
        ("# Permission to use, copy, modify,\n#\n# and/or distribute this software", "isc"),
        ("Redistribution  and use in source and\n   binary forms", "bsd"),
        ("released into the public\ndomain", "public-domain"),
        ("This is free and unencumbered software\nreleased into the public\n domain.", "unlicense"),
        ("Creative\nCommons Attribution-Share\nAlike", "cc-by-sa"),
        ("All rights\n reserved.", "proprietary"),
        ("do what the fork you want to public\nlicense", "wtfpl"),
        ("GPL v3, CC BY 4.0", "gpl-3.0"),
        ("CC BY 4.0", "cc-by-4.0"),
        ("Mozilla Public License\n2.0.", "mpl-2.0"),
    ]
    for (text, want), got in zip(cases, labels_of(spark, [t for t, _ in cases]), strict=True):
        assert want in got, (text, got)
    for got in labels_of(spark, ["under the GPL\n2. Next item", "Apache License\n1. Definitions", "CC BY\n4) Next item", "MIT\nis a place. License"]):
        assert not got & {"gpl-2.0", "apache-1.0", "cc-by-4.0", "mit"}, got


def test_license_scan_longer_detections(spark):
    texts = ["GNU Lesser General Public License version 3", "Affero General Public License v3", "GNU Library General Public\nLicense, version 2", "GNU General Public License version 3 and GNU Lesser General Public License version 3", "GPL 3 GPL 3"]
    got = labels_of(spark, texts)
    assert "lgpl-3.0" in got[0] and "gpl-3.0" not in got[0]
    assert "agpl-3.0" in got[1] and "gpl-3.0" not in got[1]
    assert "lgpl-2.0" in got[2] and "gpl-2.0" not in got[2]
    assert {"gpl-3.0", "lgpl-3.0"} <= got[3] and "gpl-3.0" in got[4]
    found = spark.createDataFrame([(1, 1, "a", 0, 9), (1, 1, "b", 0, 9), (1, 1, "c", 0, 8), (1, 1, "d", 1, 9), (1, 2, "e", 0, 9), (1, 1, "f", 5, 12), (2, 1, "g", 1, 9)], "k int, priority int, label string, start int, end int")
    assert {r.label for r in suppressed(found, ["k"]).collect()} == {"a", "b", "f", "g"}


def test_license_heads_and_tags(spark):
    texts = ["Boost Software License - Version 1.0 - August 17th, 2003", "Eclipse Public License - v 2.0", "SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0)", "Redistributions of source code must retain the above copyright notice"]
    got = labels_of(spark, texts)
    assert "bsl-1.0" in got[0] and "epl-2.0" in got[1] and {x for x in got[2] if x.startswith("gpl-2.0")} and "bsd" in got[3]


def test_license_rules_against_brute_force(spark):
    """Texts drawn from the rules' own expressions, alone, glued, wrapped and nested: labels and scores as all rules give them one by one."""
    rng = random.Random(12)
    own = []
    for n, (_, _, keyword, expression, _) in enumerate(rules()):
        text = exrex(expression, rng)
        assert re.search(expression, text, re.ASCII) and keyword in text, (expression, text)
        own.append(text)
    texts = own + [f"x {rng.choice(own)}, {rng.choice(own)}\n * {rng.choice(own)} {rng.choice(own)}." for _ in range(150)] + [rng.choice(own).title().replace(" ", rng.choice(["  ", " \n# ", "\r\n * "])) for _ in range(150)]
    texts += ["gnu lesser general public license version 3", "the affero general public license v3", "simplified bsd license", "license", "mit licenses", None, "", "gpl " * 2000]
    base = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    want = []
    for t in texts:
        e = re.sub(BLANKS, " ", re.sub(BREAK, "\n", (t or "").lower()))
        found = {}
        for n, (p, label, _, expression, c) in enumerate(rules()):
            for m in re.finditer(expression, e, re.ASCII):
                found[m.span()] = min(found.get(m.span(), (10**6,)), (n, p, label, c))
        left = [x for (s, f), x in found.items() if not any(s2 <= s and f <= f2 and (y[1] < x[1] or (y[1] == x[1] and (s2, f2) != (s, f))) for (s2, f2), y in found.items())]
        w = " ".join(ALNUM.findall((t or "").translate(LOWER)))
        labels = {la for ph, la in base.items() if re.search(rf"(?<!\S){ph}(?!\S)", w)}
        want.append((",".join(sorted(labels | {x[2] for x in left})), max([x[3] for x in left] + [0.7] * bool(labels), default=0.0)))
    rows = sorted(license_scan(frame(spark, list(enumerate(texts)))).collect(), key=lambda r: r.doc_id)
    for r, t, w in zip(rows, texts, want, strict=True):
        assert (r.labels, r.score) == w, t
    assert rows[len(texts) - 8].labels == "gpl,lgpl-3.0" and rows[len(texts) - 7].labels == "agpl-3.0,gpl" and rows[len(texts) - 6].labels == "bsd-2-clause"


def exrex(expression, rng):
    """A text that the expression matches: one way through its groups, choices and repetitions."""
    import re._constants as c
    import re._parser as parser

    def one(nodes):
        out = ""
        for op, av in nodes:
            if op is c.LITERAL:
                out += chr(av)
            elif op is c.IN:
                kinds = [x for x in av if x[0] is not c.NEGATE]
                what, v = rng.choice(kinds)
                out += chr(v) if what is c.LITERAL else chr(v[0]) if what is c.RANGE else {c.CATEGORY_SPACE: " ", c.CATEGORY_WORD: "w"}[v]
            elif op is c.BRANCH:
                out += one(rng.choice(av[1]))
            elif op is c.SUBPATTERN:
                out += one(av[3])
            elif op in (c.MAX_REPEAT, c.POSSESSIVE_REPEAT):
                out += "".join(one(av[2]) for _ in range(rng.randint(av[0], min(av[1], av[0] + 1))))
        return out

    return next(t for t in (one(parser.parse(expression)) for _ in range(200)) if re.search(expression, t, re.ASCII))


def test_long_words_differ_by_the_order_of_their_tails(spark):
    head = "x" * 4096
    words = [head + "ab" * 3000, head + "ba" * 3000, head + "a" * 3000 + "b" * 3000, "b" * 4096 + "a" * 4096, "a" * 4096 + "b" * 4096, head + "ab" * 3000]
    chinese = ["天" * 1400 + "地玄黄" * 900, "天" * 1400 + "玄地黄" * 900]
    for classes in (textops.SPACED, textops.ALNUM):
        h = textops.Words(pa.array(words + chinese, pa.large_string()), classes).hash
        assert len(set(h.tolist())) == 7 and h[0] == h[5]
        assert textops.Words(pa.array([" y " + words[1]], pa.large_string()), classes).hash[1] == h[1]
    docs = list(enumerate(words[:2] + chinese))
    assert all(r.kept for r in near_duplicates(frame(spark, docs)).collect())
    assert without_near_duplicates(frame(spark, docs)).count() == 4


@pytest.mark.parametrize("operator", [exact_dedup, near_duplicates, mix_sources, personal_data, license_scan, without_copies, without_near_duplicates, mixed])
def test_empty_table(spark, operator):
    assert operator(frame(spark, [])).count() == 0


def test_empty_documents_with_items(spark):
    assert decontaminate(frame(spark, []), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0
