"""Retrieval: vector, keyword and hybrid top-k, reranking, diversity, and the filters before them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.ranking import RRF_K, bm25, bm25_idf, bm25_norm, cosine_similarity
from fathomline.functions.text import expand_query, glob_match, index_tokens
from fathomline.session import stored

#: Rows of one side of a cell in which many seeds are held against many rows.
CELL_ROWS = 20_000
#: Chunks and queries of a cell of the keyword search, and cells it is dealt to where these would give fewer.
KEYWORD_CHUNKS, KEYWORD_QUERIES, KEYWORD_CELLS = 250_000, 200_000, 8
#: What a sum may lack and still tie once rounded to six digits.
SLACK = 2e-6


def chunk_filter(file_pattern: list[str] | str | None = None, chunk_type: str | None = None, folder_structure: list[str] | None = None, tags: list[str] | None = None, project_name: str | None = None, **_: object) -> Column:
    """Conjunction of the given filters; alternatives within one are OR-ed; unknown keys count for nothing."""
    parts = [F.lit(True)]
    if file_pattern:
        parts.append(glob_match(F.col("relative_path"), [file_pattern] if isinstance(file_pattern, str) else list(file_pattern)))
    if chunk_type:
        parts.append(F.col("chunk_type") == chunk_type)
    for name, wanted in (("folder_structure", folder_structure), ("tags", tags)):
        if wanted:
            parts.append(F.arrays_overlap(name, F.array(*[F.lit(w) for w in wanted])))
    if project_name:
        parts.append(F.col("project_name") == project_name)
    return reduce(lambda a, b: a & b, parts)


def vector_topk(vectors: DataFrame, query: Column, k: int, extra: Column | None = None) -> DataFrame:
    """The k chunks most similar to one query vector: (chunk_id, similarity). Exact; a filter goes below the limit."""
    rows = vectors if extra is None else vectors.where(extra)
    rows = rows.withColumn("_q", query)  # a scalar subquery may not stand inside the vector functions
    scored = rows.select("chunk_id", F.round(cosine_similarity(F.col("embedding"), F.col("_q")), 6).alias("similarity")).where("similarity IS NOT NULL")
    return scored.orderBy(F.desc("similarity"), "chunk_id").limit(k)


def postings(chunks: DataFrame, text_col: str = "content_preview") -> DataFrame:
    """Keyword index: (term, chunk_id, tf, length) with one row per term and chunk."""
    toks = chunks.select("chunk_id", index_tokens(F.col(text_col)).alias("t")).where(F.size("t") > 0)
    return toks.select("chunk_id", F.size("t").alias("length"), F.explode("t").alias("term")).groupBy("term", "chunk_id", "length").agg(F.count("*").alias("tf"))


def corpus_stats(chunks: DataFrame, text_col: str = "content_preview") -> DataFrame:
    """One row: chunks with a token, and their mean number of tokens. Read from the chunks, not from their postings."""
    n = F.size(index_tokens(F.col(text_col)))
    return chunks.select(n.alias("n")).where("n > 0").agg(F.avg("n").alias("mean_length"), F.count("*").alias("total"))


def _first(docs: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by rounded score, then by number."""
    r = scores.round(6)
    if len(r) > k:
        best = r >= np.partition(r, -k)[-k]
        docs, r = docs[best], r[best]
    by = np.lexsort((docs, -r))[:k]
    return docs[by], r[by]


def _best_chunks(lists: list[tuple[np.ndarray, np.ndarray, float, float]], k: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k chunks of greatest sum over several lists (chunks ascending, weights, greatest weight, k-th greatest or 0). Exact.

    Lists that together stay below what k chunks surely have can't bring in a chunk and are only looked up. `sums` is all zero,
    before and after.
    """
    down = sorted(lists, key=lambda x: -x[2])  # all weights are above 0
    floor = max(x[3] for x in lists) - SLACK
    rest = 0.0
    while len(down) > 1 and rest + down[-1][2] < floor:
        rest += down.pop()[2]
    for docs, w, *_ in down:
        sums[docs] += w
    docs, part = [], []
    for d, *_ in down:
        s = sums[d]
        sums[d] = 0.0  # counted once
        may = (s > 0) & (s >= floor - rest)
        docs.append(d[may])
        part.append(s[may])
    d, s = np.concatenate(docs), np.concatenate(part)
    if len(s) > k:
        d = d[s >= max(floor, np.partition(s, -k)[-k] - SLACK) - rest]
    total = np.zeros(len(d))
    for docs, w, *_ in lists:  # in the order of the terms, whatever the cell
        at = np.minimum(np.searchsorted(docs, d), len(docs) - 1)
        total += np.where(docs[at] == d, w[at], 0.0)
    return _first(d, total, k)


def _keyword_cell(asked: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k best of `rows` (chunk_id, norm, terms, tfs) for each of `asked` (query_id, terms, idfs)."""
    rows = rows.sort_by("chunk_id")
    words = asked["terms"].combine_chunks()
    coded, each = words.flatten().dictionary_encode(), np.r_[0, np.cumsum(pc.list_value_length(words).to_numpy())]
    wanted, idf = coded.indices.to_numpy(), np.zeros(len(coded.dictionary))
    idf[wanted] = asked["idfs"].combine_chunks().flatten().to_numpy()
    terms = rows["terms"].combine_chunks()
    code = pc.fill_null(pc.index_in(terms.flatten(), value_set=coded.dictionary), -1).to_numpy()
    here = np.flatnonzero(code >= 0)  # other blocks of queries ask for more
    here = here[np.argsort(code[here], kind="stable")]
    code, doc = code[here], np.repeat(np.arange(len(rows), dtype=np.int32), pc.list_value_length(terms).to_numpy())[here]
    weight = bm25(idf[code], rows["tfs"].combine_chunks().flatten().to_numpy()[here], rows["norm"].to_numpy()[doc])
    ends = np.searchsorted(code, np.arange(len(idf) + 1))
    lists = []
    for i, j in zip(ends[:-1], ends[1:], strict=True):
        w = weight[i:j]
        lists.append((doc[i:j], w, w.max(initial=0.0), np.partition(w, -k)[-k] if j - i >= k else 0.0))
    sums, alone, of, docs, scores = np.zeros(len(rows)), {}, [], [], []
    for q in range(len(asked)):
        held = [t for t in wanted[each[q] : each[q + 1]] if len(lists[t][0])]
        if len(held) > 1:
            d, s = _best_chunks([lists[t] for t in held], k, sums)
        elif held:
            if held[0] not in alone:
                alone[held[0]] = _first(*lists[held[0]][:2], k)
            d, s = alone[held[0]]
        else:
            continue
        of.append(np.full(len(d), q))
        docs.append(d)
        scores.append(s)
    flat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return pa.table({"query_id": asked["query_id"].take(pa.array(flat(of, np.int64))), "chunk_id": rows["chunk_id"].take(pa.array(flat(docs, np.int64))), "score": flat(scores, np.float64)})


def bm25_topk(index: DataFrame, corpus: DataFrame, queries: DataFrame, k: int, cell: tuple[int, int, int] = (KEYWORD_CHUNKS, KEYWORD_QUERIES, KEYWORD_CELLS)) -> DataFrame:
    """(query_id, chunk_id, score, rank) of the k best chunks per row of queries(query_id, query).

    Query terms are expanded and taken once each. The index (postings) is cut down to the terms asked for before anything
    else and kept, a row a chunk; document frequencies come from that part, and no chunk is seen that shares no term.
    `corpus` is a row of corpus_stats.

    Chunks and queries are dealt to a grid of cells; a cell sums weights in memory and gives k rows a query, so the pairs of
    a query and a chunk that shares a term are never rows. `cell` is (chunks, queries) of one and the least number of cells.
    Exact.
    """
    terms = queries.select("query_id", F.explode(F.array_distinct(index_tokens(expand_query(F.col("query"))))).alias("term"))
    held = index.join(terms.select("term").distinct(), "term", "left_semi").groupBy("chunk_id", "length").agg(F.collect_list(F.struct("term", F.col("tf").cast("int").alias("tf"))).alias("p"))
    chunks = stored(held.select("chunk_id", bm25_norm(F.col("length"), corpus.select("mean_length").scalar()).alias("norm"), F.col("p.term").alias("terms"), F.col("p.tf").alias("tfs")))
    df = chunks.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weighed = terms.join(df, "term").select("query_id", F.struct("term", bm25_idf(F.col("df"), corpus.select("total").scalar()).alias("idf")).alias("p"))
    asked = stored(weighed.groupBy("query_id").agg(F.sort_array(F.collect_list("p")).alias("p")).select("query_id", F.col("p.term").alias("terms"), F.col("p.idf").alias("idfs")))

    n_chunks, n_asked = chunks.count(), asked.count()
    n = max(1, -(-n_chunks // cell[0]))
    m = max(1, -(-n_asked // cell[1]), min(-(-cell[2] // n), -(-n_asked // 500)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = chunks.select("*", block("chunk_id", n).alias("_r"), every(m).alias("_s"))
    ask = asked.select("*", block("query_id", m).alias("_t"), every(n).alias("_u"))
    kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "chunk_id": index.schema["chunk_id"].dataType.simpleString(), "score": "double"}
    best = ask.groupBy("_t", "_u").cogroup(rows.groupBy("_s", "_r")).applyInArrow(lambda a, b: _keyword_cell(a, b, k), ", ".join(f"{c} {t}" for c, t in kinds.items()))
    return ranked(best, "score", ["query_id"], k)


def ranked(hits: DataFrame, score: str, keys: list[str], k: int) -> DataFrame:
    """`rank` 1..k within keys by score descending, then chunk_id."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rrf(lists: list[DataFrame], keys: list[str], k: int) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (keys, chunk_id, rank): (keys, chunk_id, score, rank)."""
    both = reduce(DataFrame.unionByName, [x.select(*keys, "chunk_id", (1.0 / (RRF_K + F.col("rank"))).alias("s")) for x in lists])
    fused = both.groupBy(*keys, "chunk_id").agg(F.round(F.sum("s"), 9).alias("score"))
    return ranked(fused, "score", keys, k)


def similar_to_many(vectors: DataFrame, seeds: DataFrame, k: int, cell: int = CELL_ROWS) -> DataFrame:
    """(seed_id, chunk_id, similarity, rank): the k chunks most similar to each stored seed vector, itself left out.

    Seeds may grow with the rows: both sides are dealt to a grid of cells of about `cell` seeds by `cell` rows.

    Nothing is broadcast or collected; rows are shuffled once per block of seeds, seeds once per block of rows. All
    vectors have one width. Exact.
    """
    n_rows, n_seeds = (max(1, -(-x.count() // cell)) for x in (vectors, seeds))
    block = lambda n: F.pmod(F.xxhash64("chunk_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = vectors.select("chunk_id", "embedding", block(n_rows).alias("_r"), every(n_seeds).alias("_s"))
    ask = seeds.select(F.col("chunk_id").alias("seed_id"), F.col("embedding").alias("seed_vector"), block(n_seeds).alias("_t"), every(n_rows).alias("_u"))

    def score(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(x):
            a, b = (np.array(side.tolist(), np.float64) for side in (q["seed_vector"], x["embedding"]))
            a, b = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (a, b))
            own, other = q["seed_id"].to_numpy(), x["chunk_id"].to_numpy()
            at = pd.Series(np.arange(len(x)), index=other)
            for i in range(0, len(a), 256):
                s = np.maximum(a[i : i + 256] @ b.T, 0.0)
                mine = at.reindex(own[i : i + 256]).to_numpy()
                there = np.flatnonzero(~np.isnan(mine))
                s[there, mine[there].astype(int)] = -1.0  # itself
                least = np.partition(s, -k, axis=1)[:, -k][:, None] if s.shape[1] > k else 0.0
                r, c = np.nonzero((s >= least - 2e-6) & (s >= 0))  # what may tie once rounded stays
                if len(r):
                    part = pd.DataFrame({"seed_id": own[i + r], "chunk_id": other[c], "similarity": s[r, c].round(6)})
                    out.append(part.sort_values(["seed_id", "similarity", "chunk_id"], ascending=[True, False, True]).groupby("seed_id").head(k))
        return pd.concat(out) if out else pd.DataFrame({"seed_id": [], "chunk_id": [], "similarity": []}).astype({"seed_id": str, "chunk_id": str, "similarity": float})

    pairs = ask.groupBy("_t", "_u").cogroup(rows.groupBy("_s", "_r")).applyInPandas(score, "seed_id string, chunk_id string, similarity double")
    order = Window.partitionBy("seed_id").orderBy(F.desc("similarity"), "chunk_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rerank(hits: DataFrame, keys: list[str], score: str, recall_k: int, top_k: int, min_score: Column | float = 0.0, recall_by: str = "similarity_score") -> DataFrame:
    """The top_k of the recall_k best hits by a reranker's score at or above min_score: adds `vector_similarity`, `rank`, `reranked`."""
    floor = F.when(F.isnan(F.lit(min_score).cast("double") if not isinstance(min_score, Column) else min_score), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(min_score if isinstance(min_score, Column) else F.lit(min_score), F.lit(0.0)))))
    recalled = ranked(hits, recall_by, keys, recall_k).drop("rank")
    kept = recalled.where(F.col(score).isNotNull() & ~F.isnan(score) & ((floor == 0) | (F.col(score) >= floor)))
    return ranked(kept, score, keys, top_k).withColumn("vector_similarity", F.col(recall_by)).withColumn("reranked", F.lit(True))


def dedup_best(hits: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each (keys, chunk_id) in the given order."""
    w = Window.partitionBy(*keys, "chunk_id").orderBy(*order)
    return hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def per_file_cap(hits: DataFrame, keys: list[str], path: str, score: str, cap: int) -> DataFrame:
    """Adds `position`: by score, but hits beyond `cap` of one file come after all others; none is dropped."""
    in_file = Window.partitionBy(*keys, path).orderBy(F.desc(score), "chunk_id")
    capped = hits.withColumn("_over", (F.row_number().over(in_file) > cap).cast("int"))
    return capped.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("_over", F.desc(score), "chunk_id"))).drop("_over")


def with_context(results: DataFrame, similar: DataFrame, per_result: int = 2) -> DataFrame:
    """`results` with `context`: the ids of at most `per_result` chunks most similar to each one, itself left out.

    `similar` is (seed_id, chunk_id, rank), as similar_to_many gives it for all results at once.
    """
    near = similar.where(F.col("rank") <= per_result).groupBy(F.col("seed_id").alias("chunk_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("context"))
    return results.join(near, "chunk_id", "left").withColumn("context", F.coalesce("context", F.array().cast("array<string>")))
