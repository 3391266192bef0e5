"""Odd inputs: columns with the operators' own names, long words and runs, repeated rows, ties, nulls, empty tables."""

import collections
import importlib.util
import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayleave.llm import quality, textops
from wayleave.llm.decontaminate import without_contaminated
from wayleave.llm.exact_dedup import without_copies
from wayleave.llm.html_text import extract
from wayleave.llm.licenses import license_scan
from wayleave.llm.mixing import mix_sources, mixed
from wayleave.llm.near_dedup import near_duplicates, without_near_duplicates
from wayleave.llm.pii import CONTEXT, personal_data, sanitised
from wayleave.llm.quality import good_documents, quality_scores
from wayleave.llm.shared import join_hot, numbered
from wayleave.llm.warc import round_trip

CLASHING = ["_id", "_th", "_hash", "_nth", "_row", "_text", "_t", "_s", "_k", "_part", "_source", "_copies", "h", "k", "n", "id", "th", "sizes", "a.b"]


def clashing(spark, rows):
    """Documents with columns that operators use for themselves."""
    return spark.createDataFrame([(i, t, s, *(f"mine {c} {n}" for c in CLASHING)) for n, (i, t, s) in enumerate(rows)], "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING))


def checked(docs, out, more=()):
    """The rows of out by what their clashing columns say, which must be as they came in."""
    assert out.columns == [*docs.columns, *more]
    came = {r["_id"]: r for r in docs.collect()}
    rows = out.collect()
    for r in rows:
        assert tuple(r)[: len(docs.columns)] == tuple(came[r["_id"]])
    return sorted(int(r["_id"].split()[-1]) for r in rows)


LONG = "word " * 60_000
ROWS = [(1, "a b c d e f g", "s"), (2, "a b  c d e f g", "s"), (3, None, None), (4, "", "t"), (None, "lost text here", "s"), (5, "x" * 200_000, "t"), (6, LONG, "s"), (7, LONG + "end", "s"), (1, "a b c d e f g", "s"), (8, "one two three four five six seven eight nine ten eleven twelve thirteen", None)]


def test_stages_leave_other_columns_alone(spark):
    docs = clashing(spark, ROWS)
    assert checked(docs, without_near_duplicates(docs)) == [0, 2, 3, 4, 5, 6, 7, 8, 9]
    exact = checked(docs, without_copies(docs))
    assert len(exact) == 7 and len({0, 8} & set(exact)) == 1
    items = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven twelve thirteen"), (2, None)], "item_id long, text string")
    assert checked(docs, without_contaminated(docs, items)) == list(range(9))
    mix = mixed(docs)
    got = checked(docs, mix, ["size", "source_size", "target", "taken", "copies"])
    assert {3, 2} - set(got) == set() and mix.where("taken <> size * copies").count() == 0
    assert sum(r.copies for r in mix.collect()) == sum(r.copies for r in mix_sources(docs).collect())
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert len(checked(docs, good_documents(docs, labels))) == quality_scores(docs, labels).where("predicted = 1").count()
    clean = sanitised(docs)
    assert len(checked(docs, clean, ["sanitised"])) == len(ROWS)
    assert {r.sanitised == (r.text or "") for r in clean.collect()} == {True}
    for one in (license_scan(docs), personal_data(docs), near_duplicates(docs), mix_sources(docs)):
        assert one.count() == len(ROWS)


def test_stages_on_an_empty_table(spark):
    docs = clashing(spark, ROWS).limit(0)
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for out in (without_near_duplicates(docs), without_copies(docs), without_contaminated(docs, items), mixed(docs), good_documents(docs, labels), sanitised(docs)):
        assert out.count() == 0


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")
def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    docs = clashing(spark, ROWS)
    spark.createDataFrame([(1, 1), (2, 1), (5, 0), (4, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for some in (docs, docs.limit(0)):
        for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, some, str(tmp_path))
            kept = checked(some, out, ["size", "source_size", "target", "taken", "copies"] if n == 4 else ())
            assert set(kept) <= set(range(len(ROWS))), name
    only = next(stage for name, stage in corpus_pipeline.STAGES if name == "decontamination")(spark, docs, str(tmp_path))
    assert 9 not in checked(docs, only)


def test_words_of_one_set_of_bytes(spark):
    """Words that differ in the order of their bytes only: permuted tails, and pairs on which polynomial hashes modulo 2^64 agree."""
    thue = ["".join("ab"[(bin(i).count("1") + f) % 2] for i in range(2048)) for f in (0, 1)]
    rng = random.Random(3)
    tail = list("abcdefghij" * 500)
    permuted = []
    for _ in range(4):
        rng.shuffle(tail)
        permuted.append("q" * 4095 + "".join(tail))
    words = [*thue, *permuted, "a\x00b", "a\x01b", "ab"]
    for kind in (textops.SPACED, textops.ALNUM):
        hashes = [textops.Words(pa.array([w], pa.large_string()), kind).hash[-1] for w in words[:6]]
        assert len(set(hashes)) == 6
    assert len({textops.Words(pa.array([w], pa.large_string()), textops.SPACED).hash[0] for w in words}) == len(words)
    docs = spark.createDataFrame([(i, f"x y z {w}") for i, w in enumerate(words)], "doc_id long, text string")
    assert all(r.kept and r.component_id == r.doc_id for r in near_duplicates(docs, 4).collect())


def test_an_address_of_very_many_labels(spark):
    texts = ["a@" + "b." * 200_000 + "c", "a@" + "b." * 200_000, "1" * 200_000, "+1" + " 2" * 100_000, "1.2.3." * 50_000, "a" * 300_000 + "@", "4 " * 100_000]
    rows = personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert rows[0].spans == f"email:0:{len(texts[0])}" and rows[1].spans == f"email:0:{len(texts[1]) - 1}"
    ips = [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", texts[4])]
    assert [r.spans for r in rows[2:]] == ["", "", ",".join(ips), "", ""]


def test_disclosing_terms_are_those_of_brute_force(spark):
    rng = random.Random(6)
    names, common = ["Zorblatt", "Quimby", "Oduya"], ["the", "memo", "sent", "by", "about", "daily", "plan"]
    docs = []
    for i in range(90):
        words = [rng.choice(common) for _ in range(rng.randint(3, 12))]
        if rng.random() < 0.5:
            n = rng.randrange(3)
            words.insert(rng.randrange(len(words)), f"u{n}@corp.example")
            if rng.random() < 0.9:
                words.insert(rng.randrange(len(words)), names[n])
        elif rng.random() < 0.1:
            words.append(rng.choice(names))
        docs.append((i, " ".join(words) + f" {i}"))
    docs += docs[:5] + [(200, None)]
    texts = sorted({t or "" for _, t in docs})
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    term = re.compile(r"[^\W\d_](?:[^\W_]|['-])+")
    n, ne, nt, net, places = len(texts), collections.Counter(), collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for t in texts:
        nt.update(set(term.findall(t.lower())))
        ne.update({m[0].lower() for m in email.finditer(t)})
        pairs = set()
        for m in email.finditer(t):
            before, after = t[max(0, m.start() - CONTEXT) : m.start()], t[m.end() : m.end() + CONTEXT]
            for w in set(term.findall(f"{before}\n{after}".lower())):
                pairs.add((m[0].lower(), w))
                places[m[0].lower(), w].add((before, after))
        net.update(pairs)
    want = {w for (e, w), c in net.items() if len(places[e, w]) >= 3 and ne[e] < n and math.log(n * c / (ne[e] * nt[w])) >= 0.8 * math.log(n / ne[e])}
    assert want
    for r in personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        t = dict(docs)[r.doc_id] or ""
        assert [s for s in r.spans.split(",") if s.startswith("term")] == [f"term:{m.start()}:{m.end()}" for m in term.finditer(t) if m[0].lower() in want]


def test_labels_without_documents_do_not_use_up_the_sample(spark):
    rng = random.Random(2)
    good, bad = ["fine", "clear", "sound", "well"], ["junk", "spam", "buy", "now"]
    docs = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(20))) for i in range(200)]
    df = spark.createDataFrame(docs + docs[:3], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, quality int")
    more = labels.unionByName(spark.range(1000, 1_001_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality")))
    model, same = quality.fit(df, more, sample=150), quality.fit(df, labels, sample=150)
    assert (model[1] == same[1]).all() and model[2] == same[2] and model[1].any()
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in quality.score(df, model).collect())


def test_hinge_model_is_that_of_a_plain_fit(spark):
    """The fitted model against dense features, counted and descended in plain Python over all rows."""
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice(["ab", "ba", "cab", "abba"][: 2 + i % 3]) for _ in range(6))) for i in range(60)]
    y = {i: int(i % 3 == 2) for i, _ in docs}
    ratio, weight, bias = quality.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(y.items()), "doc_id long, quality int"))

    def features(t):
        b, f = t.encode(), set()
        for i in range(len(b) - 2):
            f.add(((b[i] * 0x9E3779B1 + b[i + 1] * 0x85EBCA6B + b[i + 2] * 0xC2B2AE35) % 2**32) >> 16)
        w = t.split()
        for j in range(1, 4):
            if any(len(set(w[i : i + j + 1])) == 1 for i in range(len(w) - j)):
                f.add(quality.TRIGRAMS + j - 1)
        return f

    rows = {i: features(t) for i, t in docs}
    seen = set().union(*rows.values())
    count = {c: {f: 1 + sum(f in rows[i] for i in rows if y[i] == c) for f in seen} for c in (0, 1)}
    total = {c: sum(count[c].values()) + quality.FEATURES - len(seen) for c in (0, 1)}
    for f in range(quality.FEATURES):
        want = math.log(count[1][f] / total[1]) - math.log(count[0][f] / total[0]) if f in seen else 0.0
        assert ratio[f] == pytest.approx(want, abs=1e-12)
    x = {i: {f: ratio[f] / math.sqrt(sum(ratio[g] ** 2 for g in rows[i])) for f in rows[i]} for i in rows}
    margin = {i: sum(weight[f] * v for f, v in x[i].items()) + bias for i in rows}
    share = {c: sum(v == c for v in y.values()) / len(y) for c in (0, 1)}
    hinge = lambda m, c: 1 / (2 * share[c]) * max(0.0, 1 - (2 * c - 1) * m)
    primal = 0.5 * (sum(w * w for w in weight) + bias * bias) + sum(hinge(margin[i], y[i]) for i in rows)
    # A plain subgradient descent of the same objective finds nothing better.
    w, b, best = collections.Counter(), 0.0, float("inf")
    for step in range(1, 1500):
        m = {i: sum(w[f] * v for f, v in x[i].items()) + b for i in rows}
        best = min(best, 0.5 * (sum(v * v for v in w.values()) + b * b) + sum(hinge(m[i], y[i]) for i in rows))
        g, gb = collections.Counter(w), b
        for i in rows:
            s = 2 * y[i] - 1
            if s * m[i] < 1:
                c = s / (2 * share[y[i]])
                gb -= c
                for f, v in x[i].items():
                    g[f] -= c * v
        for f in g:
            w[f] -= g[f] / step
        b -= gb / step
    assert primal <= 1.02 * best + 1e-6


def test_scores_of_equal_texts_are_equal(spark):
    docs = clashing(spark, ROWS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int")
    by = collections.defaultdict(set)
    for r, (_, t, _) in zip(quality.score(docs.coalesce(1), quality.fit(docs, labels)).collect(), ROWS, strict=True):
        by[t or ""].add(r.score)
    assert all(len(s) == 1 and 0 <= min(s) <= 1 for s in by.values())


def test_hot_keys_and_numbers(spark):
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("key"))
    table = spark.range(0, 3000, 2).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        want = collections.Counter(map(tuple, rows.join(table, "key", how).select("id", "key").collect()))
        assert collections.Counter(map(tuple, join_hot(rows, table, ["key"], ["id"], how).select("id", "key").collect())) == want
    got = numbered(rows, [F.col("key").desc(), F.col("id")], "no").orderBy("no").collect()
    assert [(r.key, r.id) for r in got] == sorted(((r.key, r.id) for r in got), key=lambda x: (-x[0], x[1])) and [r.no for r in got] == list(range(1, 3001))


def test_pages_with_clashing_columns(spark):
    names = ["text", "payload", "d", "l", "last", "n_chars", "refers_to", "a.b"]
    df = spark.createDataFrame([(i, f"u{i % 2}", h, *names) for i, h in enumerate(["<p>same page</p>"] * 3 + [None, "", "<p>x</p>"])], "page_id long, url string, html string, " + ", ".join(f"`{n}` string" for n in names))
    assert sorted(r.text for r in extract(df).collect()) == ["", "", "same page", "same page", "same page", "x"]
    rows = {r.page_id: r for r in round_trip(df).collect()}
    assert [rows[i].refers_to for i in range(6)] == [2, 2, None, 4, None, None]
