"""Substring dedup: words that stand in a long passage which starts earlier as well are removed.

A difference cover is a set of residues modulo a period such that any two places, moved on by one and the same number
of words below the period, both come to lie on it. So when a window of `window` words occurs at two places, the two
occurrences have an anchor in common: `window - period + 1` words at the same offset, both on cover places. Hence

1. only anchors on cover places are hashed (4 of 13 places for windows of 20 words) and counted;
2. a window is open if it holds an anchor that occurs more than once. Open anchors are extended to all windows that hold
   them, and these are compared by hashes of the whole window; of equal ones the least document has the first;
3. a second look at the texts drops the words of all open windows that are not the first.

Neither step joins on a hash, so a passage that very many documents share costs one row a task in an aggregation: what goes
back to a document is which of its anchors are the only one of their kind, and of which windows it is the first document. Both
lists are no longer than the document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayleave.llm.shared import save, text_or_empty
from wayleave.llm.textops import AS_IS, SPACED, U, Words, mix, pieces, raw

#: Stands for a null identifier: such rows come after all others.
LAST = (1 << 63) - 1
_PLACE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)


def difference_cover(period: int) -> list[int]:
    """Residues whose differences are all residues modulo `period`: each time the one that adds the most new differences."""
    cover, met = [0], {0}
    while len(met) < period:
        new = [{(r - c) % period for c in cover} | {(c - r) % period for c in cover} for r in range(period)]
        best = max(range(period), key=lambda r: len(new[r] - met))
        cover.append(best)
        met |= new[best]
    return sorted(cover)


class Passages:
    """Words, anchors and windows of a slice of texts. The hashes of `length` words from each place add up products."""

    def __init__(self, a: pa.Array, window: int):
        self.window, self.period = window, max(1, 2 * window // 3)
        self.words = w = Words(a, SPACED, AS_IS)
        place = np.arange(w.hash.size) - w.first[w.doc]
        left = w.count[w.doc] - place
        on = np.zeros(self.period, bool)
        on[difference_cover(self.period)] = True
        self.length = window - self.period + 1
        self.anchor = np.flatnonzero(on[place % self.period] & (left >= self.length))
        self.anchors = np.bincount(w.doc[self.anchor], minlength=len(a))
        self.begins = left >= window

    def hashed(self, at: np.ndarray, length: int, hashes: np.ndarray) -> np.ndarray:
        total = np.zeros(at.size, np.uint64)
        for j in range(length):
            total += hashes[at + j] * _PLACE[j % 256]
            if j % 256 == 255:
                total = mix(total)
        return mix(total + U(length))

    def open_windows(self, unique: pa.Array) -> np.ndarray:
        """First words of the windows that hold an anchor which is not listed (by its number in its text) as the only one of its kind."""
        once = np.ones(self.anchor.size, bool)
        first = np.cumsum(self.anchors) - self.anchors
        sizes = np.diff(unique.offsets.to_numpy())
        once[np.repeat(first, sizes) + unique.flatten().to_numpy()] = False
        before = np.zeros(self.words.hash.size + 1, np.int64)
        before[self.anchor[once] + 1] = 1
        before = np.cumsum(before)
        at = np.flatnonzero(self.begins)
        return at[before[at + self.period] > before[at]]


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, a in pieces(batch.column(1)):
                p = Passages(a, window)
                h = p.hashed(p.anchor, p.length, p.words.hash).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(p.anchors)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(a)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(h))], ["doc", "hs"])

    return run


def _open(window: int):
    """(h, more, doc): of each open window 96 bits of hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, a in pieces(batch.column(1)):
                p = Passages(a, window)
                s = p.open_windows(batch.column(2).slice(at, len(a)))
                if s.size:
                    more = p.hashed(s, window, mix(p.words.hash ^ U(0x5851F42D4C957F2D))) >> U(32)
                    doc = batch.column(0).slice(at, len(a)).to_numpy()[p.words.doc[s]]
                    yield pa.RecordBatch.from_arrays([pa.array(p.hashed(s, window, p.words.hash).astype(np.int64)), pa.array(more.astype(np.uint32).astype(np.int32)), pa.array(doc)], ["h", "more", "doc"])

    return run


def _later(p: Passages, unique: pa.Array, firsts: pa.Array) -> np.ndarray:
    """Whether each word stands in an open window that is not the first of its kind."""
    s = p.open_windows(unique)
    h = p.hashed(s, p.window, p.words.hash).astype(np.int64)
    later = np.ones(s.size, bool)
    ends = np.searchsorted(p.words.doc[s], np.arange(len(firsts) + 1))
    own, mine = firsts.flatten().to_numpy(), firsts.offsets.to_numpy() - firsts.offsets[0].as_py()
    for r in np.flatnonzero(np.diff(ends)):
        known, first = np.unique(h[ends[r] : ends[r + 1]], return_index=True)
        later[ends[r] + first[np.isin(known, own[mine[r] : mine[r + 1]])]] = False
    change = np.zeros(p.words.hash.size + 1, np.int64)
    np.add.at(change, s[later], 1)
    np.add.at(change, s[later] + p.window, -1)
    return np.cumsum(change)[:-1] > 0


def _kept(window: int, texts: bool):
    """(id, n_words, n_removed, kept_sha256[, kept_text]): the kept words with a space between them, cut out of the bytes in one step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, a in pieces(batch.column(1)):
                p = Passages(a, window)
                w, n = p.words, len(a)
                gone = _later(p, batch.column(2).slice(at, n), batch.column(3).slice(at, n))
                removed = np.bincount(w.doc[gone], minlength=n)
                data, offsets = raw(a)
                word = SPACED[data]
                stay = np.flatnonzero(~gone)
                last = np.zeros(stay.size, bool)
                last[:-1] = w.doc[stay[1:]] != w.doc[stay[:-1]]
                last[-1:] = True
                # A byte stays with its word, and so does the white space behind it unless it is the text's last word that stays.
                sign = np.zeros(data.size + 1, np.int8)
                sign[w.starts[stay]] = 1
                sign[w.starts[gone]] = -1
                number = np.cumsum(sign != 0)[:-1]
                of = np.concatenate([[False], ~gone])[number]
                keep = word & of
                edge = np.flatnonzero(~word[1:] & word[:-1]) + 1
                ending = np.ones(w.hash.size, bool)
                ending[stay] = last
                edge = edge[~ending[number[edge] - 1] & of[edge]]
                keep[edge] = True
                out = np.where(word, data, np.uint8(0x20))[keep]
                cut = np.concatenate([[0], np.cumsum(keep)])[offsets]
                bytes_ = out.tobytes()
                sha = [hashlib.sha256(bytes_[i:j]).hexdigest() for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                cols = [batch.column(0).slice(at, n), pa.array(w.count.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(sha)]
                names = ["doc", "n_words", "n_removed", "kept_sha256"]
                if texts:
                    cols.append(pa.LargeStringArray.from_buffers(n, pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(bytes_)).cast(pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def substring_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """One row for each input row: id, n_words, n_removed, kept_sha256, and the kept words as kept_text if `texts`.

    Words are runs of other than ASCII white space, taken as they are. Removed is each word that is covered by a window of
    `window` words of one text whose words also start earlier: in a document with a smaller identifier, or before in the same
    text. Windows are judged on the input. A null text has no words, nor has one of white space; texts with fewer words than a window stay
    as they are. Rows without identifier come after all others. Rows that share an identifier (or have none) count as
    one document that begins at each of them: they remove nothing from each other. Texts may have any length: a text is worked on
    whole, in some 60 times its bytes. An empty table gives an empty result. Only the two named columns are read, so others may have any name.
    """
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("doc"), text_or_empty(f"`{text_col}`").alias("t"))
    anchors = rows.mapInArrow(_anchors(window), "doc long, hs array<long>").select("doc", F.posexplode("hs").alias("at", "h"))
    once = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("doc"), F.min("at").alias("at")).where("n = 1")
    # Numbers of anchors say nothing where several rows share an identifier: all their anchors count as open.
    several = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc")
    unique = save(once.groupBy("doc").agg(F.collect_list("at").alias("unique")).join(several, "doc", "left_anti"), "unique")

    told = rows.join(unique, "doc", "left").select("doc", "t", F.coalesce("unique", F.array().cast("array<int>")).alias("unique"))
    firsts = told.mapInArrow(_open(window), "h long, more int, doc long").groupBy("h", "more").agg(F.min("doc").alias("doc"))
    firsts = save(firsts.groupBy("doc").agg(F.collect_list("h").alias("firsts")), "firsts")

    told = told.join(firsts, "doc", "left").select("doc", "t", "unique", F.coalesce("firsts", F.array().cast("array<long>")).alias("firsts"))
    out = told.mapInArrow(_kept(window, texts), "doc long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts)
    return out.select(F.when(F.col("doc") != LAST, F.col("doc")).alias(id_col), *out.columns[1:])
