"""Long exact spans shared between records, by recompression (see recompression.py).

Every text is parsed once. At each anchor the half window from the first character that decided it becomes a probe; a
window of `least` characters that contains no such probe becomes a row of its own. Which windows these are follows from
their characters alone, so two equal windows share a probe or are rows both: no span of `least` characters can be
missed. Probes that stand in several texts leave few candidates. Windows that begin at a shared probe are compared first,
which settles long spans; only around probes that some text still needs are all windows compared. Hashes compare windows
until each found text has one partner; then the two windows' texts themselves are compared.

A key that more than one text of a batch holds is known to be shared, and its rows need not meet those of other batches:
a hot key (a notice in a third of all texts) reaches no task as rows, only as one smallest and one greatest id a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.recompression import Windows, anchors, code_points, mix
from fathomline.session import stored

BATCH_CHARS = 150_000
SHARD_CHARS = 4_000_000
#: Tells keys of whole windows from keys of probes.
_WHOLE = np.uint64(0x2545F4914F6CDD1D)


def anchor_size(least: int) -> int:
    """Characters at which a symbol becomes an anchor: a tenth of a span leaves room for the characters that decide it."""
    return max(2, least // 10)


def known_shared(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether the key of each row stands in rows of another doc, too."""
    if not len(key):
        return np.zeros(0, bool)
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    last = np.r_[first[1:], len(k)] - 1
    out = np.zeros(len(k), bool)
    out[order] = np.repeat(d[first] != d[last], last - first + 1)
    return out


def probes(x: np.ndarray, begins: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, hash of the window from there on or 0, place, whether a probe) of the texts in `x`; see the module's head."""
    half = least // 2
    ends = begins[1:] - 1
    names, lo, hi = anchors(x, anchor_size(least))
    lo, hi = lo.astype(np.int64), hi.astype(np.int64)
    order = np.lexsort((hi, lo))
    order = order[np.r_[True, np.diff(lo[order]) != 0]] if len(order) else order
    names, lo, hi = names[order], lo[order], hi[order]
    own = np.clip(np.searchsorted(begins, lo, "right") - 1, 0, max(0, len(ends) - 1))
    from_ = np.maximum(np.maximum(lo + half, hi) - least, begins[own]) if len(lo) else lo  # first window that holds anchor and probe
    ok = (lo >= begins[own]) & (np.maximum(lo + half, hi) <= ends[own]) & (from_ <= lo) & (from_ + least <= ends[own]) if len(lo) else np.zeros(0, bool)
    names, lo, own, from_ = names[ok], lo[ok], own[ok], from_[ok]
    w = Windows(x)
    bare = np.zeros(len(x) + 1, np.int32)  # windows that begin here and hold no probe
    room = ends - begins[:-1] >= least
    np.add.at(bare, begins[:-1][room], 1)
    np.add.at(bare, ends[room] - least + 1, -1)
    held = np.zeros(len(x) + 1, np.int32)
    np.add.at(held, from_, 1)
    np.add.at(held, np.minimum(lo, ends[own] - least) + 1 if len(lo) else lo, -1)
    alone = np.flatnonzero((np.cumsum(bare) > 0) & (np.cumsum(held) == 0))
    whole = np.zeros(len(lo), np.uint64)
    fits = lo + least <= ends[own] if len(lo) else np.zeros(0, bool)
    whole[fits] = w.of(lo[fits], lo[fits] + least)
    one = w.of(alone, alone + least)
    return np.concatenate([mix(w.of(lo, lo + half) ^ names), mix(one ^ _WHOLE)]), np.concatenate([whole, one]), np.concatenate([lo, alone]), np.r_[np.ones(len(lo), bool), np.zeros(len(alone), bool)]


def probe_rows(texts: DataFrame, least: int, places: bool = False) -> DataFrame:
    """(key long, whole long, doc long, pos int, probe boolean, known boolean) of texts(doc, text).

    Without `places` a window that a text repeats and that holds no probe comes once.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[tuple[np.ndarray, ...]] = []
        chars = 0

        def flush() -> pd.DataFrame:
            k, w, d, p, is_probe = (np.concatenate(c) for c in zip(*parts))
            return pd.DataFrame({"key": k.view(np.int64), "whole": w.view(np.int64), "doc": d, "pos": p.astype(np.int32), "probe": is_probe, "known": known_shared(k, d)})

        for pdf in batches:
            ids, bodies = pdf["doc"].to_numpy(), pdf["text"].tolist()
            at = 0
            while at < len(bodies):
                end, size = at, 0
                while end < len(bodies) and (size == 0 or size + len(bodies[end]) <= BATCH_CHARS):
                    size += len(bodies[end])
                    end += 1
                x, begins = code_points(bodies[at:end])
                k, w, p, is_probe = probes(x, begins, least)
                own = np.searchsorted(begins, p, "right") - 1
                d = ids[at:end][own]
                if not places and not is_probe.all():
                    once = np.unique(np.stack([k[~is_probe], d[~is_probe].astype(np.uint64)]), axis=1, return_index=True)[1]
                    keep = np.r_[np.flatnonzero(is_probe), np.flatnonzero(~is_probe)[once]]
                    k, w, p, is_probe, own, d = k[keep], w[keep], p[keep], is_probe[keep], own[keep], d[keep]
                parts.append((k, w, d, p - begins[own], is_probe))
                chars += size
                at = end
                if chars >= SHARD_CHARS:
                    yield flush()
                    parts, chars = [], 0
        if parts:
            yield flush()

    return texts.mapInPandas(emit, "key long, whole long, doc long, pos int, probe boolean, known boolean")


def shared_rows(rows: DataFrame) -> DataFrame:
    """The rows (key, doc, known, ...) whose key more than one doc holds; `rows` must be stored, it is read several times.

    Only rows whose key is not known to be shared are shuffled, once for both the count of their docs and the choice.
    """
    single = rows.where("NOT known").repartition("key")
    several = single.groupBy("key").agg((F.min("doc") != F.max("doc")).alias("_many"))
    known = rows.where("known").select("key").distinct().withColumn("_known", F.lit(True))
    met = single.join(several, "key").join(known, "key", "left").where("_many OR _known").select(*rows.columns)
    return rows.where("known").unionByName(met)


def _texts(docs: DataFrame, doc_id: str, text: str, least: int) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text")).where((F.length("text") >= least) & F.col("doc").isNotNull())


def window_rows(rows: DataFrame, least: int, places: bool) -> DataFrame:
    """(whole long, doc long, pos int, known boolean) of all windows that hold a probe: rows(doc, text, at array<int>).

    Without `places` each window of a text comes once.
    """
    half = least // 2

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text, at in zip(pdf["doc"], pdf["text"], pdf["at"]):
                x = np.frombuffer(text.replace("\0", "\x01").encode("utf-32-le", "surrogatepass"), np.uint32)
                lo = np.asarray(at, np.int64)
                lo = lo[lo + half <= len(x)]  # rows that repeat an id with another text
                mark = np.zeros(len(x) + 2, np.int32)
                np.add.at(mark, np.maximum(lo + half - least, 0), 1)
                np.add.at(mark, lo + 1, -1)
                starts = np.flatnonzero(np.cumsum(mark)[: max(0, len(x) - least + 1)] > 0)
                k = Windows(x).of(starts, starts + least)
                if not places:
                    k, first = np.unique(k, return_index=True)
                    starts = starts[first]
                out.append((k, np.full(len(k), doc, np.int64), starts))
            if out:
                k, d, p = (np.concatenate(c) for c in zip(*out))
                yield pd.DataFrame({"whole": k.view(np.int64), "doc": d, "pos": p.astype(np.int32), "known": known_shared(k, d)})

    return rows.mapInPandas(emit, "whole long, doc long, pos int, known boolean")


def _meeting(rows: DataFrame) -> DataFrame:
    """rows(whole, doc, pos) with the place of an equal window in another doc: other, other_pos; rows without one are left out."""
    place = F.struct("doc", "pos")
    ends = rows.groupBy("whole").agg(F.min(place).alias("_a"), F.max(place).alias("_b")).where("_a.doc <> _b.doc")
    other = F.when(F.col("_a.doc") != F.col("doc"), F.col("_a")).otherwise(F.col("_b"))
    return rows.join(ends, "whole").select("whole", "doc", "pos", other["doc"].alias("other"), other["pos"].alias("other_pos"))


def _same_text(pairs: DataFrame, texts: DataFrame, least: int) -> DataFrame:
    """The pairs (whole, doc, pos, other, other_pos) whose windows are equal character by character in some row of both ids."""
    window = lambda at: F.substring("text", F.col(at) + 1, F.lit(least))
    mine = pairs.join(texts, "doc").select(*pairs.columns, window("pos").alias("_own"))
    both = mine.join(texts.withColumnRenamed("doc", "other"), "other").where(window("other_pos") == F.col("_own"))
    return both.select(*pairs.columns)


def docs_with_shared_spans(docs: DataFrame, doc_id: str, text: str, least: int = 200) -> DataFrame:
    """(doc_id long): the texts that hold a span of `least` or more characters which occurs in another row's text.

    Rows with a null id or text, and texts shorter than `least`, share nothing. Repeated ids count as one document.
    Every document of the result has a window whose text was compared with its partner's.
    """
    texts = _texts(docs, doc_id, text, least)
    shared = stored(shared_rows(stored(probe_rows(texts, least))))
    sure = _meeting(shared.where("whole <> 0").select("whole", "doc", "pos"))
    pairs = stored(sure.groupBy("doc").agg(F.min(F.struct("whole", "pos", "other", "other_pos")).alias("p")).select("doc", "p.*"))
    open_ = shared.where("probe").join(pairs.select("doc"), "doc", "left_anti")
    needed = open_.select("key").distinct()
    wanted = shared.where("probe").join(needed, "key", "left_semi").groupBy("doc").agg(F.collect_set("pos").alias("at"))
    rest = stored(window_rows(wanted.join(texts, "doc").select("doc", "text", "at"), least, False))
    more = _meeting(rest).join(pairs.select("doc"), "doc", "left_anti")
    more = more.groupBy("doc").agg(F.min(F.struct("whole", "pos", "other", "other_pos")).alias("p")).select("doc", "p.*")
    pairs = stored(pairs.unionByName(more))
    found = stored(_same_text(pairs, texts, least).select("doc").distinct())
    left = pairs.join(found, "doc", "left_anti")
    if not left.isEmpty():  # equal hashes of different windows: all windows of these documents, each pair by its text
        every = shared.where("whole <> 0").select("whole", "doc", "pos").unionByName(rest.select("whole", "doc", "pos"))
        mine = every.join(left.select("doc"), "doc", "left_semi")
        all_pairs = mine.join(every.select("whole", F.col("doc").alias("other"), F.col("pos").alias("other_pos")), "whole").where("doc <> other")
        found = found.unionByName(_same_text(all_pairs, texts, least).select("doc")).distinct()
    return found.withColumnRenamed("doc", doc_id)


def _needed_probes(shared: DataFrame, sure: DataFrame, least: int) -> DataFrame:
    """(key): probes with a window that the windows known to be shared do not cover in some text."""
    half = least // 2

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for at, starts in zip(pdf["at"], pdf["starts"]):
                pos = np.array([r["pos"] for r in at], np.int64)
                key = np.array([r["key"] for r in at], np.int64)
                s = np.sort(np.asarray(starts if starts is not None else [], np.int64))
                first = np.maximum(pos + half - least, 0)
                # covered if one stretch of known windows reaches from the first to the last character of all its windows
                cut_ = np.flatnonzero(np.r_[True, np.diff(s) > least]) if len(s) else np.zeros(0, np.int64)
                begins = s[cut_]
                ends = np.r_[s[cut_[1:] - 1], s[-1]] + least if len(s) else begins
                k = np.searchsorted(begins, first, "right") - 1
                inside = (k >= 0) & (ends[np.maximum(k, 0)] >= pos + least) if len(s) else np.zeros(len(pos), bool)
                out.append(key[~inside])
            yield pd.DataFrame({"key": np.concatenate(out) if out else np.zeros(0, np.int64)})

    at = shared.where("probe").groupBy("doc").agg(F.collect_set(F.struct("key", "pos")).alias("at"))
    return at.join(sure.groupBy("doc").agg(F.collect_set("pos").alias("starts")), "doc", "left").select("at", "starts").mapInPandas(find, "key long").distinct()


def shared_shares(docs: DataFrame, doc_id: str, text: str, least: int = 200) -> DataFrame:
    """(doc_id, n_chars long, shared_chars long, share double, n_spans int, longest int) of every row.

    A character is shared if it lies in a span of `least` characters that also stands in another document; spans are maximal
    runs of such characters. Rows with a null text have n_chars 0 and share 0; rows with a null id are left out. Windows are
    compared by 64-bit hashes.
    """
    texts = _texts(docs, doc_id, text, least)
    shared = stored(shared_rows(stored(probe_rows(texts, least, True))))
    sure = stored(_meeting(shared.where("whole <> 0").select("whole", "doc", "pos")).select("doc", "pos"))
    needed = _needed_probes(shared, sure, least)
    wanted = shared.where("probe").join(needed, "key", "left_semi").groupBy("doc").agg(F.collect_set("pos").alias("at"))
    windows = stored(window_rows(wanted.join(texts, "doc").select("doc", "text", "at"), least, True))
    hits = shared_rows(windows.withColumnRenamed("whole", "key")).select("doc", "pos").unionByName(sure)

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, starts in zip(pdf["doc"], pdf["starts"]):
                s = np.sort(np.asarray(starts, np.int64))
                begin = np.r_[True, s[1:] > s[:-1] + least]
                heads = s[begin]
                ends = np.append(s[:-1][begin[1:]], s[-1]) + least
                out.append((doc, int((ends - heads).sum()), len(heads), int((ends - heads).max())))
            yield pd.DataFrame(out, columns=["doc", "shared_chars", "n_spans", "longest"])

    covered = hits.groupBy("doc").agg(F.collect_set("pos").alias("starts")).mapInPandas(cover, "doc long, shared_chars long, n_spans int, longest int")
    every = docs.where(F.col(f"`{doc_id}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").cast("long").alias("doc")).agg(F.max(F.coalesce(F.length(f"`{text}`"), F.lit(0))).cast("long").alias("n_chars"))
    out = every.join(covered, "doc", "left")
    chars = F.coalesce("shared_chars", F.lit(0))
    return out.select(F.col("doc").alias(doc_id), "n_chars", chars.alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(chars / F.col("n_chars"), 6)).otherwise(0.0).alias("share"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("longest", F.lit(0)).alias("longest"))
