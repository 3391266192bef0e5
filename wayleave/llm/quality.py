"""Quality classifier: naive Bayes support vectors (Wang and Manning, 2012).

Features are indicators of byte trigrams (hashed to TRIGRAMS buckets) and of a word that follows itself once, twice or
three times. Each is scaled by its class log-count ratio, which comes from all training rows; a linear hinge-loss model
is fitted by dual coordinate descent (Hsieh et al., 2008) on a sample of at most `sample` training rows, chosen by a
hash of the identifier. Scores of all documents are computed in the tasks that read them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayleave.llm.shared import as_row, bit_words, small_batches, text_or_empty, whole_rows, with_bit
from wayleave.llm.textops import SPACED, Words, pieces, raw

TRIGRAMS = 1 << 16
FEATURES = TRIGRAMS + 3
#: Rows that are scored and given back together.
ROWS = 1000


def _indicators(a: pa.Array) -> Iterator[np.ndarray]:
    """The features of each text, in ascending order."""
    data, offsets = raw(a)
    codes = np.zeros(0, np.int64)
    if data.size > 2:
        d = data.astype(np.uint32)
        codes = ((d[:-2] * np.uint32(0x9E3779B1) + d[1:-1] * np.uint32(0x85EBCA6B) + d[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(16)).astype(np.int64)
    words = Words(a, SPACED)
    h, doc = words.hash, words.doc
    again = np.zeros(h.size, bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    extra = np.zeros((len(a), 3), bool)
    for j in range(3):
        extra[doc[again], j] = True
        again[1:] &= again[:-1].copy()
        again[:1] = False
    mark = np.zeros(FEATURES, bool)
    for i in range(len(a)):
        own = codes[offsets[i] : max(offsets[i], offsets[i + 1] - 2)]
        mark[own] = True
        mark[TRIGRAMS:] = extra[i]
        yield np.flatnonzero(mark)
        mark[own] = False


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, documents of label 0, of label 1) of a task's rows (text, label)."""
    n = np.zeros((2, FEATURES), np.int64)
    for batch in batches:
        labels = batch.column(1).to_numpy(zero_copy_only=False)
        for at, a in pieces(batch.column(0)):
            for i, f in enumerate(_indicators(a)):
                n[int(labels[at + i] == 1), f] += 1
    f = np.flatnonzero(n.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(f), pa.array(n[0, f]), pa.array(n[1, f])], ["f", "bad", "good"])


def _packed(f: np.ndarray) -> bytes:
    """A feature list as 4 bytes a feature, or as a bit for each of all features where that is shorter: 8 kB at most, whatever the text."""
    if 4 * f.size < FEATURES // 8:
        return f.astype("<u4").tobytes()
    bits = np.zeros(FEATURES, bool)
    bits[f] = True
    return np.packbits(bits).tobytes()


def _unpacked(b: bytes | pa.Buffer) -> np.ndarray:
    return np.frombuffer(b, "<u4").astype(np.int64) if len(b) < FEATURES // 8 else np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8), count=FEATURES))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, a in pieces(batch.column(0)):
            lists = pa.array([_packed(f) for f in _indicators(a)], pa.binary())
            yield pa.RecordBatch.from_arrays([lists, batch.column(1).slice(at, len(a))], ["fs", "label"])


def descend(rows: list[bytes] | list[pa.Buffer], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 5) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss over unit-length rows ratio[features]; returns weights by feature, and the bias."""
    w, bias = np.zeros(ratio.size), 0.0
    alpha = np.zeros(len(rows))
    share = np.array([(y < 0).mean(), (y > 0).mean()])
    limit = np.where(y > 0, cost / max(2 * share[1], 1e-9), cost / max(2 * share[0], 1e-9))
    order, rng = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(rounds):
        rng.shuffle(order)
        for i in order:
            f = _unpacked(rows[i])  # one row at a time: all of them would not be bounded by their packed size
            x = ratio[f]
            x = x / max(np.sqrt((x * x).sum()), 1e-12)
            slope = y[i] * (w[f] @ x + bias) - 1
            new = min(max(alpha[i] - slope / (x @ x + 1.0), 0.0), limit[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[f] += step * x
                bias += step
                alpha[i] = new
    return w, bias


def _scores(model, text: int):
    """(_row, score): the text is the row's field of that number; a batch's rows go through as they are, some ROWS at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, weight, bias = model.value
        power = ratio * ratio
        product = ratio * weight
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows, out = batch.column(0).slice(at, ROWS), []
                for _, a in pieces(pc.struct_field(rows, [text])):
                    for f in _indicators(a):
                        out.append(product[f].sum() / max(np.sqrt(power[f].sum()), 1e-12) + bias)
                score = 1 / (1 + np.exp(-3 * np.clip(np.array(out, float), -200, 200)))
                yield pa.RecordBatch.from_arrays([rows, pa.array(score)], ["_row", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, np.ndarray, float]:
    """(log-count ratios, weights, bias) from documents whose identifier has a label 0 or 1 in `labels`.

    Rows without label, and labels without a row, are left out before the sample is taken; of repeated labels the least
    counts. Ratios come from all labelled rows, repeated ones each. The sample has at most `sample` identifiers, those with the
    least hashes, and one text of each (of several with one identifier that with the least hash), packed to 8 kB at most. Without
    rows of both labels the model is all zeros and every score 0.5.
    """
    small_batches(docs.sparkSession)
    marks = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    docs = docs.where(F.col(id_col).isNotNull())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long")).alias("h"), text_or_empty(text_col).alias("t"))
    rows = with_bit(rows, "h", bit_words(marks.select(F.xxhash64("id").alias("h"))), "labelled").where("labelled").select("id", "t")
    train = rows.join(marks, "id")
    counts = train.select("t", "label").mapInArrow(_counts, "f long, bad long, good long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas()  # FEATURES rows at most
    ratio = np.zeros(FEATURES)
    f = counts["f"].to_numpy(np.int64)
    good, bad = np.ones(FEATURES), np.ones(FEATURES)
    good[f] += counts["good"].to_numpy(float)
    bad[f] += counts["bad"].to_numpy(float)
    if (good > 1).any() and (bad > 1).any():
        ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
        ratio[(good == 1) & (bad == 1)] = 0
    there = docs.select(F.col(id_col).cast("long").alias("id")).join(marks, "id").dropDuplicates(["id"])
    chosen = there.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(sample)
    one = rows.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min_by("t", F.struct(F.xxhash64("t"), F.col("t"))).alias("t"))
    kept = one.select("t", "label").mapInArrow(_listed, "fs binary, label int").toArrow()
    y = np.where(kept["label"].to_numpy() == 1, 1.0, -1.0)
    if len(y) and ratio.any() and (y > 0).any() and (y < 0).any():
        keyed = kept.append_column("n", pc.binary_length(kept["fs"]))
        order = pc.sort_indices(keyed, sort_keys=[(c, "ascending") for c in ("n", "fs", "label")])  # the same from run to run
        fs = kept["fs"].take(order).combine_chunks()
        weight, bias = descend([x.as_buffer() for x in fs], y[order.to_numpy()], ratio)  # pieces of one buffer, not copies
    else:
        weight, bias = np.zeros(FEATURES), 0.0
    return ratio, weight, bias


def score(docs: DataFrame, model: tuple, text_col: str = "text") -> DataFrame:
    """All columns of docs and `score`, 0 to 1; a null text scores as an empty one.

    A column that is called score is replaced, others stay, whatever their names. Repeated rows and equal texts have equal
    scores; texts may have any length; an empty table gives an empty result.
    """
    return whole_rows(_with_score(docs, model, text_col), docs, score="score")


def _with_score(docs: DataFrame, model: tuple, text_col: str) -> DataFrame:
    """(_row, score): the columns of docs as one struct, in which the text goes to Python once."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(as_row(docs).alias("_row"))
    return rows.mapInArrow(_scores(sent, docs.columns.index(text_col)), rows.select("_row", F.lit(0.5).alias("score")).schema)


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, held_out, score, predicted. Labels of rows that are held out are never read.

    held_out: crc32 of the identifier's text modulo 3 is `held_out`. The score depends on the text alone. A null
    identifier counts as an empty text here and is not trained on. Repeated rows each get their result, and equal texts
    equal scores; texts may have any length. An empty table gives an empty result. Only the named columns are read.
    """
    out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == held_out
    model = fit(docs.where(~out), labels.where(~out), id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).alias("_id"), out.alias("held_out"), F.col(text_col).alias("_text"))
    scored = score(rows, model, "_text").select(F.col("_id").alias(id_col), "held_out", "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that quality_scores() predicts as 1, with all their columns, whatever their names; what it says of odd input holds here."""
    out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == held_out
    model = fit(docs.where(~out), labels.where(~out), id_col=id_col, text_col=text_col)
    return whole_rows(_with_score(docs, model, text_col).where("score >= 0.5"), docs)
