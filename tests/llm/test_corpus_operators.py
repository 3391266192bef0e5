"""Collocations, substring dedup and the Merkle manifest against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from wayleave.llm import collocations as co
from wayleave.llm.merkle import lower_cased, merkle_manifest, one_in_five
from wayleave.llm.substring_dedup import difference_cover, substring_dedup

LOWER = {i: i + 32 for i in range(65, 91)}


def phrases(docs, least, longest, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {q[i : i + k] for q, b in found.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if b >= c[q[i : i + k]]}
        rows = []
        for p in found.keys() - inside:
            score, k = min((1000 * c[p] * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -c[p], " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def talk():
    rnd = random.Random(11)
    words = ["the", "The", "of", "é", "x", "New", "York", "City", "in", "a", "b", *(f"w{i}" for i in range(60))]
    docs = []
    for _ in range(200):
        said = [rnd.choice(["New York City", "in the", "a b a b", "x x x", "of the New York"]) if rnd.random() < 0.3 else rnd.choice(words) for _ in range(rnd.randint(0, 200))]
        docs.append((rnd.choice(["en", "en", "de", None]), "".join(x + rnd.choice([" "] * 12 + ["  ", "\t", ", ", ". ", "\n", "!?", " "]) for x in said)))
    return [*docs, *docs[:3], ("en", None), ("fr", ""), ("fr", " \n"), ("de", "no end " * 20_000)]


@pytest.mark.parametrize(("least", "longest", "top", "ranked"), [(5, 5, 2000, co.RANKED), (4, 4, 50, 7), (100, 5, 2000, 0)])
def test_collocations(spark, talk, least, longest, top, ranked):
    """Few or no units with ranks of their own: the others go by their hashes."""
    df = spark.createDataFrame([(lang, text, "x", 1) for lang, text in talk], "lang string, text string, `a.b` string, score int")
    got = co.collocations(df, least, longest, top, ranked=ranked)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == phrases(talk, least, longest, top)


def test_collocations_of_nothing(spark):
    assert co.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


@pytest.mark.parametrize("share", [0.00001, 0.25, 2])
def test_tally(monkeypatch, share):
    """Dense tiles, sorted coordinates and hashes give the same counts."""
    monkeypatch.setattr(co, "DENSE", share)
    a, b = np.random.default_rng(5).choice([0, 1, 2, 511, 512, 600, 5000, co.RANKED - 1, 1 << 62, (1 << 62) + 3], (2, 20_000))
    got = co.tally(a, b)
    assert collections.Counter(dict(zip(zip(got[0].tolist(), got[1].tolist(), strict=True), got[2].tolist(), strict=True))) == collections.Counter(zip(a.tolist(), b.tolist(), strict=True))
    assert [x.size for x in co.tally(a[:0], b[:0])] == [0, 0, 0]


def test_difference_cover():
    assert difference_cover(13) == [0, 1, 3, 9]
    for period in (1, 2, 7, 20, 33):
        cover = set(difference_cover(period))
        assert all(any((i + k) % period in cover and (j + k) % period in cover for k in range(period)) for i in range(period) for j in range(period))


def without_repeats(docs, window):
    rows = [(1 << 63 if i is None else i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in docs]
    least = {}
    for i, w in rows:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            least[k] = min(least.get(k, i), i)
    out = []
    for i, w in rows:
        gone, seen = set(), set()
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if least[k] < i or k in seen:
                gone |= set(range(s, s + window))
            seen.add(k)
        text = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((None if i == 1 << 63 else i, len(w), len(gone), hashlib.sha256(text.encode()).hexdigest(), text))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [20, 5, 1])
def test_substring_dedup(spark, window):
    rnd = random.Random(window)
    pool = [[rnd.choice(["a", "B", "b", "é", "lorem", " "]) for _ in range(rnd.randint(1, 60))] for _ in range(20)]
    docs = []
    for i in range(200):
        w = []
        for _ in range(rnd.randint(0, 5)):
            q = rnd.choice(pool)
            at = rnd.randint(0, len(q))
            w += q[at : at + rnd.randint(1, 40)] + [str(rnd.random())] * rnd.randint(0, 1)
        docs.append((rnd.choice([i, i, i, i, 7, None]), rnd.choice(["", "  "]) + "".join(x + rnd.choice([" ", "  ", "\n", "\t\x0b"]) for x in w) + rnd.choice(["", "end"])))
    docs += [*docs[:3], (1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "again and " * 30_000)]
    df = spark.createDataFrame([(i, t, 1, "") for i, t in docs], "doc_id long, text string, doc int, `h.s` string")
    got = substring_dedup(df, window, texts=True)
    assert sorted(map(tuple, got.collect()), key=str) == without_repeats(docs, window)


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def manifest(rows, fanout):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(field, r)))

    def tree(level):
        out = [level]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
        return out

    def way(levels, i):
        for level in levels[:-1]:
            b = i // fanout * fanout
            yield "".join(level[b:i]), "".join(level[i + 1 : b + fanout])
            i //= fanout

    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    keys = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    for k in keys:
        by[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {k: tree([leaf(r) for r in by[k]]) for k in keys}
    top = tree([trees[k][-1][0] for k in keys])
    root, out = top[-1][0], []
    for j, k in enumerate(keys):
        for i, r in enumerate(by[k]):
            steps = [*way(trees[k], i), *way(top, j)]
            h = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                h = leaf((*r[:4], r[4].translate(LOWER)))
            for a, b in steps:
                h = sha(a + h + b)
            out.append((r[0], leaf(r), trees[k][-1][0], root, sha("".join(a + b for a, b in steps)), h, h == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("fanout", [16, 2])
def test_merkle_manifest(spark, fanout):
    rnd = random.Random(fanout)
    sources = ["hot"] * 6 + [None, "", "é", "z", "-", "=", *(f"s{j}" for j in range(25))]
    rows = [(rnd.choice([i, i, i, 5, None]), rnd.choice(sources), rnd.choice(["en", None]), rnd.choice([None, 4]), rnd.choice([None, "", "Ab é", "low", "X" * 300])) for i in range(350)]
    rows += [*rows[:5], (9999, "long", "en", 3, "Long " * 100_000)]
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], f"{SCHEMA}, g int, `s0.h` string")
    got = list(map(tuple, merkle_manifest(df, tampered=lower_cased(one_in_five()), fanout=fanout).collect()))
    assert sorted(got, key=str) == manifest(rows, fanout)
    assert {r[6] for r in got} == {True, False}


def test_merkle_manifest_of_one_row_and_of_nothing(spark):
    row = (1, None, None, None, None)
    (only,) = merkle_manifest(spark.createDataFrame([row], SCHEMA)).collect()
    assert only.root == only.subroot == only.leaf == only.folded_root == sha("1:1----") and only.proof_sha256 == sha("") and only.verified
    assert merkle_manifest(spark.createDataFrame([], SCHEMA)).count() == 0
