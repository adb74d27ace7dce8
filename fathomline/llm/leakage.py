"""Evaluation texts leaking into training text: a distributed positional inverted index.

Documents are gathered into segments; a segment's postings (each of its terms with all its positions) are stored as rows of
one table. A search reads the lists of the test terms only and puts those of one segment together. A leak of at least
`least` consecutive words must hold an aligned block of `block` words of the item, so each
block is a phrase query: its terms' lists are intersected, shifted by their offsets, from the rarest term on. Hits are
extended to the longest common run in both directions. Proximity matches are chains of shorter runs whose offsets drift
by at most a slack between one run and the next, so words may be put in, left out or changed. Test sets of any size are
searched in blocks of a proven bound, the only thing that is broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from functools import reduce

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.session import stored

WORD = regex.compile(rb"[0-9a-z]+")
#: Characters of documents that form one segment of the index.
SEGMENT_CHARS = 6_000_000
#: Words in a row that each link of a proximity match has at least.
LINK_WORDS = 3


def words_of(text: str) -> list[bytes]:
    """The longest runs of ASCII letters and digits in lower case; other characters separate, also those whose lower case is ASCII."""
    return WORD.findall(text.encode("utf-8").lower())  # bytes.lower() maps ASCII only


class Phrases:
    """Items as term ids with their aligned blocks."""

    def __init__(self, items: list[tuple[int, str]], block: int):
        self.vocab: dict[bytes, int] = {}
        self.ids = [i for i, _ in items]
        self.terms = [np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words_of(t or "")], np.int32) for _, t in items]
        self.block = block
        seen: dict[bytes, list[tuple[int, int]]] = {}
        for n, t in enumerate(self.terms):
            for at in range(0, len(t) - block + 1, block):
                seen.setdefault(t[at : at + block].tobytes(), []).append((n, at))
        self.blocks = [(np.frombuffer(k, np.int32), v) for k, v in seen.items()]


class _Numbers(dict):
    """Term -> number in order of first sight."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


def segment_postings(texts: list[str]) -> tuple[list[str], list[bytes], np.ndarray]:
    """(terms, their positions as differences of 32 bits, lengths) of one segment; a text takes one position more than it has words."""
    numbers = _Numbers()
    per = [list(map(numbers.__getitem__, words_of(t))) if t else [] for t in texts]
    lengths = np.array([len(x) + 1 for x in per], np.int64)
    seq = np.concatenate([np.asarray(x, np.int32) for x in per]) if per else np.zeros(0, np.int32)
    at = np.arange(len(seq)) + np.repeat(np.arange(len(per)), lengths - 1) if len(per) else np.zeros(0, np.int64)
    order = np.argsort(seq, kind="stable")
    at = at[order].astype(np.int64)
    bounds = np.searchsorted(seq[order], np.arange(len(numbers) + 1))
    step = np.diff(at, prepend=0)
    step[bounds[:-1]] = at[bounds[:-1]] if len(at) else 0
    raw = step.astype("<u4").tobytes()
    ends = (bounds * 4).tolist()
    return [t.decode() for t in numbers], [raw[a:b] for a, b in zip(ends, ends[1:])], lengths


def positional_index(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(segment long, term, positions binary, docs array, lengths binary): every word of every text of non-null id, stored.

    One row for each term of a segment, and one without a term that lists the segment's documents and their lengths. Null
    and empty texts have no words.
    """
    kind = dict(docs.dtypes)[doc_id]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, n = TaskContext.get().partitionId() << 24, 0
        keys: list = []
        texts: list[str] = []
        size = 0

        def flush() -> pd.DataFrame:
            terms, lists, lengths = segment_postings(texts)
            rest = [None] * len(terms)
            return pd.DataFrame({"segment": base + n, "term": [None, *terms], "positions": [None, *lists], "docs": [keys, *rest], "lengths": [lengths.astype("<u4").tobytes(), *rest]})

        for pdf in batches:
            for key, t in zip(pdf["d"], pdf["t"]):
                keys.append(key)
                texts.append(t or "")
                size += len(texts[-1])
                if size >= SEGMENT_CHARS:
                    yield flush()
                    n += 1
                    keys, texts, size = [], [], 0
        if texts:
            yield flush()

    rows = docs.where(F.col(f"`{doc_id}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("d"), F.col(f"`{text}`").alias("t"))
    return stored(rows.mapInPandas(build, f"segment long, term string, positions binary, docs array<{kind}>, lengths binary"))


class Segment:
    """The postings of the test terms in one segment: `terms` (term of every position, -1 for other words, -2 between texts), the text of
    each position, and all positions sorted by term with the bounds of each term's list."""

    def __init__(self, vocab: dict[bytes, int], lengths: np.ndarray, lists: dict[int, np.ndarray]):
        lengths = lengths.astype(np.int64)
        self.owner = np.repeat(np.arange(len(lengths)), lengths)
        self.starts = np.cumsum(lengths) - lengths
        self.terms = np.full(int(lengths.sum()), -1, np.int32)
        self.terms[self.starts + lengths - 1] = -2
        none = np.zeros(0, np.int64)
        own = [lists.get(k, none) for k in range(len(vocab))]
        for k, at in enumerate(own):
            self.terms[at] = k
        self.at = np.concatenate(own) if own else none
        self.bounds = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)

    @classmethod
    def of(cls, test: Phrases, texts: list[str]) -> Segment:
        """The segment of these texts, without a stored index."""
        terms, lists, lengths = segment_postings(texts)
        got = {test.vocab[t.encode()]: np.cumsum(np.frombuffer(x, "<u4").astype(np.int64)) for t, x in zip(terms, lists) if t.encode() in test.vocab}
        return cls(test.vocab, lengths, got)


def phrase_hits(test: Phrases, seg: Segment, least: int) -> list[tuple[int, int, int, int, int]]:
    """(text number, item number, words in a row, word offset in the text, in the item): the maximal runs of `least` words or more."""
    terms, owner, at, bounds, starts = seg.terms, seg.owner, seg.at, seg.bounds, seg.starts
    df = np.diff(bounds)
    out: set[tuple[int, int, int, int, int]] = set()
    for block, places in test.blocks:
        rarity = df[block]
        order = np.argsort(rarity, kind="stable")
        if not rarity[order[0]]:
            continue
        cand = at[bounds[block[order[0]]] : bounds[block[order[0]] + 1]] - order[0]
        cand = cand[(cand >= 0) & (cand + len(block) <= len(terms))]
        for k in order[1:]:
            if not len(cand):
                break
            if len(cand) * 16 < df[block[k]]:  # a probe into the text is the intersection with one long list
                cand = cand[terms[cand + k] == block[k]]
            else:
                cand = np.intersect1d(cand, at[bounds[block[k]] : bounds[block[k] + 1]] - k, assume_unique=True)
        for p in cand.tolist():
            for n, b in places:
                item = test.terms[n]
                lo = 0
                while b - lo > 0 and p - lo > 0 and terms[p - lo - 1] == item[b - lo - 1]:
                    lo += 1
                hi = test.block
                while b + hi < len(item) and p + hi < len(terms) and terms[p + hi] == item[b + hi]:
                    hi += 1
                if lo + hi >= least:
                    d = int(owner[p])
                    out.add((d, n, lo + hi, int(p - lo - starts[d]), b - lo))
    return sorted(out)


def shared_runs(test: Phrases, terms: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place in `terms`, item number, word offset in the item, words in a row) of all maximal runs of `least` words or more."""
    lengths = np.array([len(t) for t in test.terms], np.int64)
    items = np.concatenate([np.r_[t, np.int32(-3)] for t in test.terms]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
    begins = np.cumsum(lengths + 1) - lengths - 1
    words = terms.astype(np.int64)

    def grams(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = max(0, len(x) - least + 1)
        key, fit = np.zeros(n, np.int64), np.ones(n, bool)
        for j in range(least):  # may wrap around; equal keys are compared below
            key = key * np.int64(len(test.vocab) + 1) + x[j : n + j]
            fit &= x[j : n + j] >= 0
        at = np.flatnonzero(fit)
        return key[at], at

    key, k = grams(items)
    order = np.argsort(key, kind="stable")
    key, k = key[order], k[order]
    mine, p = grams(words)
    lo, hi = np.searchsorted(key, mine, "left"), np.searchsorted(key, mine, "right")
    n = hi - lo
    p, k = np.repeat(p, n), k[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())] if n.sum() else np.zeros(0, np.int64)
    same = np.ones(len(p), bool)
    for j in range(least):
        same &= words[p + j] == items[k + j]
    p, k = p[same], k[same]
    order = np.lexsort((p, p - k))
    p, k = p[order], k[order]
    first = np.flatnonzero(np.r_[True, (np.diff(p) != 1) | (np.diff(p - k) != 0)]) if len(p) else np.zeros(0, np.int64)
    item = np.searchsorted(begins, k[first], "right") - 1
    return p[first], item, k[first] - begins[item] if len(first) else k[first], np.diff(np.r_[first, len(p)]) + least - 1


def chains(runs: list[tuple[int, int, int]], least: int, slack: int) -> list[tuple[int, int, int]]:
    """(words, start in the text, in the item) of the longest chain up to each run that none follows, with two runs and `least` words or more.

    `runs` is (start in the text, in the item, words) in order. A run follows another if at most `slack` words lie between
    them in either text; words that both hold count once.
    """
    best: list[tuple[int, int, int, int]] = []
    followed, live = set(), []
    for j, (p, k, n) in enumerate(runs):
        live = [i for i in live if runs[i][0] + runs[i][2] + slack >= p]
        mine = (n, 1, p, k)
        for i in live:
            pe, ke = runs[i][0] + runs[i][2], runs[i][1] + runs[i][2]
            cut = max(0, pe - p, ke - k)
            if cut < n and p + cut - pe <= slack and k + cut - ke <= slack:
                followed.add(i)
                mine = max(mine, (best[i][0] + n - cut, best[i][1] + 1, best[i][2], best[i][3]))
        best.append(mine)
        live.append(j)
    out: dict[tuple[int, int], int] = {}
    for i, (n, links, p, k) in enumerate(best):
        if i not in followed and links > 1 and n >= least:
            out[p, k] = max(n, out.get((p, k), 0))
    return [(n, p, k) for (p, k), n in out.items()]


def near_hits(test: Phrases, seg: Segment, least: int, slack: int) -> list[tuple[int, int, int, int, int]]:
    """As phrase_hits, for chains of runs of LINK_WORDS words or more that together have `least` shared words or more."""
    starts = seg.starts
    p, item, k, n = shared_runs(test, seg.terms, min(LINK_WORDS, least))
    doc = seg.owner[p]
    order = np.lexsort((k, p, item, doc))
    p, item, k, n, doc = p[order], item[order], k[order], n[order], doc[order]
    first = np.flatnonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(item) != 0)]) if len(p) else np.zeros(0, int)
    ends = np.r_[first[1:], len(p)]
    words = np.add.reduceat(n, first) if len(first) else first
    out = []
    for g in np.flatnonzero((ends - first > 1) & (words >= least)):  # no other can hold a chain
        a, b = first[g], ends[g]
        d = int(doc[a])
        runs = list(zip((p[a:b] - starts[d]).tolist(), k[a:b].tolist(), n[a:b].tolist()))
        out += [(d, int(item[a]), w, x, y) for w, x, y in chains(runs, least, slack)]
    return sorted(out)


_tests: dict[str, Phrases] = {}


def _search_block(index: DataFrame, items: list[tuple], least: int, slack: int | None, doc_kind: str, item_kind: str) -> DataFrame:
    spark = index.sparkSession
    block = (least + 1) // 2
    shared, mark = spark.sparkContext.broadcast(items), uuid.uuid4().hex
    words = sorted({w for _, t in items for w in words_of(t or "")})
    vocab = spark.createDataFrame([(w.decode(),) for w in words], "term string")
    asked = index.where("term IS NOT NULL").join(F.broadcast(vocab), "term", "left_semi").unionByName(index.where("term IS NULL"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        test = _tests.get(mark)
        if test is None:  # one for each process
            _tests.clear()
            _tests[mark] = test = Phrases(shared.value, block)
        head = pdf["term"].isna().to_numpy()
        first = pdf[head].iloc[0]
        lists = {test.vocab[w.encode()]: np.cumsum(np.frombuffer(p, "<u4").astype(np.int64)) for w, p in zip(pdf["term"][~head], pdf["positions"][~head])}
        seg = Segment(test.vocab, np.frombuffer(first["lengths"], "<u4"), lists)
        rows = [(*r, "exact") for r in phrase_hits(test, seg, least)]
        if slack is not None:
            rows += [(*r, "proximity") for r in near_hits(test, seg, least, slack)]
        docs = first["docs"]
        return pd.DataFrame([(docs[d], test.ids[n], w, a, b, m) for d, n, w, a, b, m in rows], columns=["d", "i", "n_words", "doc_word", "item_word", "match_type"])

    return asked.groupBy("segment").applyInPandas(search, f"d {doc_kind}, i {item_kind}, n_words int, doc_word int, item_word int, match_type string")


def leaks(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, least: int = 15, block_chars: int = 10_000_000, slack: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """(doc_id, item_id, n_words int, doc_word int, item_word int, match_type): every maximal run of `least` or more shared words, 'exact'.

    With `slack` also 'proximity' matches: two or more runs of LINK_WORDS words or more in the same order in both texts,
    at most `slack` words apart in either, with `least` or more shared words together (n_words).

    Null and empty texts hold nothing; repeated items count once. `index` is a stored positional_index of `docs` (built if not
    given). The test set is searched in blocks of about `block_chars` characters, each collected and broadcast by itself;
    an item lies in one block, and every block is held against the whole index.
    """
    least = max(least, 3)
    kinds = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    small = items.where(F.col(f"`{item_id}`").isNotNull() & F.col(f"`{item_text}`").isNotNull()).select(F.col(f"`{item_id}`").alias("i"), F.col(f"`{item_text}`").alias("t")).distinct()
    chars = small.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    index = positional_index(docs, doc_id, text) if index is None else index
    if blocks > 1:
        small = stored(small.withColumn("b", F.pmod(F.xxhash64("i"), F.lit(blocks))))
    parts = []
    for b in range(blocks):
        mine = small if blocks == 1 else small.where(F.col("b") == b)
        parts.append(_search_block(index, sorted((r.i, r.t) for r in mine.collect()), least, slack, *kinds))
    return reduce(DataFrame.unionByName, parts).withColumnRenamed("d", doc_id).withColumnRenamed("i", item_id)
