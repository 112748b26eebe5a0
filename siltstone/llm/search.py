"""Exact top-k search with BM25: an inverted index for each shard, block-max WAND pruning, exact merge.

Global statistics (number of documents, mean length, document frequencies of the queries' terms) are
computed first, so that scores of different shards agree.  A shard is a piece of a partition of the documents.
In it documents that are alike are neighbours, in blocks of 16 and tiles of 256.  Queries come in batches:

* the lists of rare terms are read into partial scores; lists of frequent terms are not read, but bounded by
  their maxima in each block of documents (block-max), for a batch of queries by one matrix product;
* for a query without a threshold, the tiles with the highest bounds are scored, which gives one that at least k
  documents reach;
* WAND: all tiles whose bounds stay below the threshold are skipped, with the frequent lists for them;
  the test runs for all tiles at once instead of moving a pivot from list to list;
* what is left is scored in single precision, tile by tile for all queries that need the tile, and the best of it again in
  double precision.

A sixteenth of the documents, chosen by a hash of the id, is searched first; its k-th best score is a
threshold for the search in all others.  Pruning drops only documents that cannot be among the k best, ties included; so the result is exact.
Queries go to the shards in blocks of at most ``BLOCK_TERMS`` terms or one query (a broadcast with that bound).  A shard is
indexed once and asked all blocks, one after the other, so that more queries are not more passes over the documents.
Shards' results are merged in two levels, k per query and shard.

Defined results: ties go to the smaller id; only documents that share a term with the query are found;
a query without words finds nothing; documents with a null id count in the statistics but are not found;
a query id on several rows is one query (the smallest by its terms); repeated documents are found each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import bounded_batches, read_table, steps, text_bytes, written
from siltstone.llm.words import Words

K1, B = 1.2, 0.75
#: Documents of a block, and blocks of a tile.
BLOCK_DOCS, TILE_BLOCKS = 16, 16
#: Terms of at least one in so many documents of a shard count as frequent, the most frequent so many at most, in a table of
#: at most so many cells; all other lists are read.
FREQUENT, MOST_DENSE, DENSE_CELLS = 40, 1024, 24_000_000
#: At most so many queries are asked together, with at most so many scores; postings that are read in one step, and cells of
#: the table of weights of exact scores.
QUERIES, SCORE_CELLS, STEP_POSTINGS, TABLE_CELLS = 512, 1 << 22, 1 << 17, 1 << 21
#: Sums of single precision are this close to the exact ones, and far closer.
SLACK = 1e-4
BLOCK_TERMS = 2_000_000
#: Terms of the documents that are indexed at once, which bounds the memory of a task.
PIECE_TERMS = 2_400_000


def _lists(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of several stretches, one after the other."""
    total = int(sizes.sum())
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(total)


def bags(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms (64-bit hashes, in order) of each text, their counts, and how many each text has."""
    n = len(words.first) - 1
    row = np.repeat(np.arange(n), np.diff(words.first))
    order = np.argsort(words.hash)
    order = order[np.argsort(row[order].astype(np.uint16 if n < 1 << 16 else np.int64), kind="stable")]
    h, r = words.hash[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.concatenate([at, [len(h)]])).astype(np.uint32)
    return h[at], counts, np.bincount(r[at], minlength=n)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Words]]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for i, j in steps(offsets):
            yield batch.column("id").slice(i, j - i), Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text: its distinct terms and their counts, as bytes."""
    for ids, words in _each(batches):
        terms, counts, size = bags(words)
        cut = np.concatenate([[0], np.cumsum(size)])
        columns = [pa.array([x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary()) for x in (terms, counts)]
        yield pa.RecordBatch.from_arrays([ids, *columns], names=["id", "terms", "counts"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms and in how many texts of the task they are; and the number of all words (without a term)."""

    def out(terms: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(terms), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(terms[k : k + (1 << 16)].view(np.int64)), pa.array(counts[k : k + (1 << 16)])], names=["term", "n"])

    terms, counts, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    held = [(terms, counts)]
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        t, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(t)
        t, n = t[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
        return t[at], np.add.reduceat(n, at) if len(at) else n

    for _, words in _each(batches):
        total += len(words)
        t, _, _ = bags(words)
        t = np.sort(t)
        at = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
        held.append((t[at], np.diff(np.concatenate([at, [len(t)]])).astype(np.int64)))
        size += len(at)
        if size > 1 << 21:
            held = [merged()]
            size = len(held[0][0])
            if size > 1 << 20:
                yield from out(*held[0])
                held, size = [(terms, counts)], 0
    yield from out(*merged())
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], names=["term", "n"])


class Index:
    """Inverted and forward lists of one shard, with the BM25 term weights without the idf.

    Documents that are alike (in their frequent terms, then in length) are neighbours, in blocks of ``BLOCK_DOCS`` and tiles
    of ``TILE_BLOCKS`` blocks, so that the maxima of a block are close to what its documents have.  The document of rank r is the
    (r % BLOCK_DOCS)-th of block r // BLOCK_DOCS; scores of all documents are laid out by that number first, then by block.  A term
    that a document has once weighs the same for any term (``once``), so lists give only places, and what more occurrences add.
    """

    def __init__(self, ids: np.ndarray, length: np.ndarray, terms: np.ndarray, counts: np.ndarray, size: np.ndarray, mean: float):
        self.ids = ids
        n = len(ids)
        self.norm = K1 * (1 - B + B * length / mean) if mean else np.ones(n)
        self.doc_first = np.concatenate([[0], np.cumsum(size)])
        self.doc_count = counts
        order = np.argsort(terms)
        by_term = terms[order]
        new = np.ones(len(terms), bool)
        new[1:] = by_term[1:] != by_term[:-1]
        self.vocabulary = by_term[new]
        self.first = np.concatenate([np.flatnonzero(new), [len(terms)]])
        del by_term
        self.doc_term = np.empty(len(terms), np.int32)
        self.doc_term[order] = np.cumsum(new, dtype=np.int32) - 1
        docs = np.repeat(np.arange(n, dtype=np.int32), size)[order]
        c = counts[order].astype(np.float32)
        weights = c * np.float32(K1 + 1) / (c + self.norm[docs].astype(np.float32))
        once = ((K1 + 1) / (1 + self.norm)).astype(np.float32)
        more = counts[order] > 1
        self.more_first = np.concatenate([[0], np.cumsum(more)])[self.first]
        self.more_value = weights[more] / once[docs[more]] - 1
        del order, c, new
        # frequent terms have dense rows, and their maxima in each block of documents
        df = np.diff(self.first)
        chosen = np.flatnonzero(df >= max(2, n // FREQUENT))
        chosen = chosen[np.argsort(-df[chosen], kind="stable")[: min(MOST_DENSE, DENSE_CELLS // max(n, 1))]]
        self.row = np.full(len(df), -1, np.int32)
        self.row[chosen] = np.arange(len(chosen))
        width = BLOCK_DOCS * TILE_BLOCKS
        self.tiles = -(-n // width)
        self.blocks = self.tiles * TILE_BLOCKS
        dense = np.zeros((n, len(chosen)), np.float32)
        for r, t in enumerate(chosen):
            part = slice(self.first[t], self.first[t + 1])
            dense[docs[part], r] = weights[part]
        rank = np.empty(n, np.int64)
        rank[np.lexsort((length, _alike(dense[:, :256])))] = np.arange(n)
        at = (rank % BLOCK_DOCS) * self.blocks + rank // BLOCK_DOCS
        self.place = at.astype(np.int32)[docs]  # of each posting
        self.more_place = self.place[more]
        self.doc_at = np.full(self.blocks * BLOCK_DOCS, -1, np.int64)
        self.doc_at[at] = np.arange(n)
        self.once = np.zeros(len(self.doc_at), np.float32)
        self.once[at] = once
        # in a tile, documents are in the order of their scores: by their number in the block first
        block, tile = rank // BLOCK_DOCS, rank // width
        self.dense = np.zeros((self.tiles * width, len(chosen)), np.float32)
        self.dense[tile * width + (rank % BLOCK_DOCS) * TILE_BLOCKS + block % TILE_BLOCKS] = dense
        del dense
        self.dense = self.dense.reshape(self.tiles, width, len(chosen))
        most = self.dense.reshape(self.tiles, BLOCK_DOCS, TILE_BLOCKS, len(chosen)).max(axis=1) if n else self.dense
        self.most = np.ascontiguousarray(most.reshape(self.blocks, len(chosen)).T)

    def exact(self, docs: np.ndarray, which: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Scores in double precision, in the order of the documents' terms; ``table``: the weight of each term of the
        shard in each query, ``which``: the query of each document."""
        size = self.doc_first[docs + 1] - self.doc_first[docs]
        at = _lists(self.doc_first[docs], size)
        count = self.doc_count[at].astype(np.float64)
        weight = count * (K1 + 1) / (count + np.repeat(self.norm[docs], size))
        weight *= table.ravel()[self.doc_term[at] + np.repeat(which * table.shape[1], size)]
        return np.bincount(np.repeat(np.arange(len(docs)), size), weight, len(docs))

    def rare(self, query: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """What the lists of rare terms give each document, for ``n`` queries; few postings are looked at in one step."""
        size = self.first[terms + 1] - self.first[terms]
        more = self.more_first[terms + 1] - self.more_first[terms]
        out = np.empty((n, len(self.doc_at)), np.float32)
        ends = np.cumsum(np.bincount(query, size, n)).astype(np.int64)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STEP_POSTINGS, "right")))
            own = slice(*np.searchsorted(query, (i, j)))
            row = (query[own] - i) * out.shape[1]
            place = self.place.take(_lists(self.first[terms[own]], size[own])) + row.repeat(size[own])
            score = np.bincount(place, weights[own].repeat(size[own]), (j - i) * out.shape[1])
            at = _lists(self.more_first[terms[own]], more[own])
            score += np.bincount(self.more_place.take(at) + row.repeat(more[own]), self.more_value.take(at) * weights[own].repeat(more[own]), len(score))
            np.multiply(score.reshape(j - i, -1), self.once, out=out[i:j], casting="same_kind")
            i = j
        return out

    def search(self, query: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best documents of each of ``n`` queries: queries, documents and scores, in order; documents with less than
        ``least`` (of the query) may be missing.  ``query`` (in order) has the places ``terms`` of the vocabulary."""
        rows = self.row[terms]
        often = rows >= 0
        own = np.zeros((n, self.most.shape[0]), np.float32)
        own[query[often], rows[often]] = weights[often]
        score = self.rare(query[~often], terms[~often], weights[~often], n).reshape(n, BLOCK_DOCS, self.blocks)
        bound = (own @ self.most + score.max(axis=1)).reshape(n, self.tiles, TILE_BLOCKS).max(axis=2)
        low = least * (1 - SLACK)
        found = []
        done = np.zeros(bound.shape, bool)
        if (fresh := np.flatnonzero(low <= 0)).size:
            # the tiles with the best bounds give a threshold that k documents reach
            first = np.argsort(-bound[fresh], axis=1, kind="stable")[:, : 1 + 2 * k // (BLOCK_DOCS * TILE_BLOCKS)]
            done[fresh[:, None], first] = True
            done &= bound > 0
            found.append(self._near(own, score, done, np.zeros(n)))
            q, _, near = found[0]
            order = np.lexsort((-near, q))
            q, near = q[order], near[order]
            kth = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == k - 1)
            low[q[kth]] = near[kth] * (1 - SLACK)
        # all others are looked at only if a block of their tile could lift them over it
        found.append(self._near(own, score, (bound * (1 + SLACK) >= low[:, None]) & (bound > 0) & ~done, low))
        q, docs, near = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((-near, q))
        q, docs, near = q[order], docs[order], near[order]
        start = np.searchsorted(q, q)
        kth = np.flatnonzero(np.arange(len(q)) - start == k - 1)
        low[q[kth]] = np.maximum(low[q[kth]], near[kth] * (1 - SLACK))
        close = near * (1 + SLACK) >= low[q]
        q, docs = q[close], docs[close]
        score = np.zeros(len(q))
        asked, which = np.unique(q, return_inverse=True)
        together = max(1, TABLE_CELLS // max(1, len(self.vocabulary)))
        table = np.zeros((min(together, len(asked)), len(self.vocabulary)))
        for i in range(0, len(asked), together):
            a, b = np.searchsorted(which, (i, i + together))
            parts = [slice(*np.searchsorted(query, (x, x + 1))) for x in asked[i : i + together]]
            for r, part in enumerate(parts):
                table[r, terms[part]] = weights[part]
            for x in range(a, b, 4096):
                score[x : min(b, x + 4096)] = self.exact(docs[x : min(b, x + 4096)], which[x : min(b, x + 4096)] - i, table)
            for r, part in enumerate(parts):
                table[r, terms[part]] = 0
        order = np.lexsort((self.ids[docs], -score, q))
        q, docs, score = q[order], docs[order], score[order]
        top = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[top], docs[top], score[top]

    def _near(self, own: np.ndarray, score: np.ndarray, need: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, documents and scores in single precision of the needed tiles, as far as they reach ``low``."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        low = np.maximum(low / (1 + SLACK), np.finfo(np.float32).tiny).astype(np.float32)[:, None]
        places = self.doc_at.reshape(BLOCK_DOCS, self.blocks)
        for t in np.flatnonzero(need.any(axis=0)):
            asked = np.flatnonzero(need[:, t])
            part = slice(t * TILE_BLOCKS, (t + 1) * TILE_BLOCKS)
            near = own[asked] @ self.dense[t].T
            near += score[asked, :, part].reshape(near.shape)
            q, d = np.divmod(np.flatnonzero(near >= low[asked]), near.shape[1])
            if len(q):
                out.append((asked[q], places[:, part].ravel()[d], near[q, d]))
        return tuple(np.concatenate(x) for x in zip(*out))


def _alike(dense: np.ndarray, groups: int = 8, rounds: int = 3) -> np.ndarray:
    """A group for each document (a row) by its frequent terms: spherical k-means, from documents that are far apart."""
    if len(dense) <= groups or not dense.shape[1]:
        return np.zeros(len(dense), np.int64)
    norm = np.sqrt(np.einsum("ij,ij->i", dense, dense))
    unit = dense / np.maximum(norm, 1e-9)[:, None]
    far = norm < np.median(norm)  # documents with few of the terms are no centres
    centre = [unit.mean(axis=0)]
    nearest = unit @ centre[0] + 2 * far
    for _ in range(groups - 1):
        centre.append(unit[np.argmin(nearest)])
        nearest = np.maximum(nearest, unit @ centre[-1])
    for _ in range(rounds):
        group = np.argmax(unit @ np.array(centre).T, axis=1)
        centre = [unit[own].sum(axis=0) if (own := group == g).any() else centre[g] for g in range(groups)]
        centre = [c / max(float(np.sqrt(c @ c)), 1e-9) for c in centre]
    return np.argmax(unit @ np.array(centre).T, axis=1)


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[np.ndarray]]:
    """Documents with ids in pieces of about ``most`` terms: ids, lengths, terms, counts, terms of each."""
    held: list[tuple] = []
    total = 0
    for ids, words in _each(batches):
        terms, counts, size = bags(words)
        has = np.asarray(ids.is_valid())
        length = np.diff(words.first).astype(np.float64)
        if not has.all():
            keep = np.repeat(has, size)
            terms, counts, size, length = terms[keep], counts[keep], size[has], length[has]
        held.append((ids.drop_null().to_numpy(), length, terms, counts, size))
        total += len(terms)
        if total >= most:
            yield [np.concatenate(x) for x in zip(*held)]
            held, total = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _search(batches: Iterator[pa.RecordBatch], blocks: list, k: int, mean: float) -> Iterator[pa.RecordBatch]:
    """For each query that finds something in a shard of the task: its k best.  A shard is indexed once, for all blocks of
    queries; a block is held only while it is asked."""
    reached: list[np.ndarray | None] = [None] * len(blocks)  # thresholds, which rise from shard to shard
    for rows in _gathered(batches, PIECE_TERMS):
        index = Index(*rows, mean)
        del rows
        for b, (shared, least) in enumerate(blocks):
            query_ids, q_terms, q_term, q_weights, q_first = shared.value
            if reached[b] is None:
                reached[b] = least.value.copy() if least else np.zeros(len(query_ids))
            place = np.searchsorted(index.vocabulary, q_terms)
            here = place < len(index.vocabulary)
            here[here] = index.vocabulary[place[here]] == q_terms[here]
            place[~here] = -1
            batch = max(1, min(QUERIES, SCORE_CELLS // max(1, len(index.doc_at))))
            for i in range(0, len(query_ids), batch):
                n = min(batch, len(query_ids) - i)
                part = slice(q_first[i], q_first[i + n])
                terms = place[q_term[part]]
                own = terms >= 0
                query = np.repeat(np.arange(n), np.diff(q_first[i : i + n + 1]))[own]
                low = reached[b][i : i + n]
                q, docs, score = index.search(query, terms[own], q_weights[part][own], n, k, low)
                if not len(q):
                    continue
                asked, start, size = np.unique(q, return_index=True, return_counts=True)
                full = size == k
                low[asked[full]] = np.maximum(low[asked[full]], score[start[full] + k - 1])
                hits = pa.StructArray.from_arrays([pa.array(score), pa.array(index.ids[docs])], names=["score", "id"])
                found = pa.ListArray.from_arrays(pa.array(np.append(start, len(q)).astype(np.int32)), hits)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[i + asked]), found], names=["query_id", "found"])
            if len(blocks) > 1 and "_path" in vars(shared):  # it is loaded from there again
                del query_ids, q_terms, q_term, q_weights, q_first, place, here
                vars(shared).pop("_value", None)
        del index


def _best_of(found: Column, k: int) -> Column:
    """The k best of lists of (score, id), by score and then the smaller id."""
    return F.slice(
        F.array_sort(F.flatten(found), lambda x, y: F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).when(x["id"] < y["id"], -1).when(x["id"] > y["id"], 1).otherwise(0)), 1, k
    )


def search(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_id: str = "doc_id", query_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(``query_id``, ``rank``, ``doc_id``, ``score``): the k documents of ``df`` that fit each query best."""
    spark = df.sparkSession
    bounded_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    asked = queries.select(F.col(query_id).cast("long").alias("id"), F.col(query_text).alias("text")).where(F.col("id").isNotNull())
    one = asked.mapInArrow(_terms, "id long, terms binary, counts binary").where(F.octet_length("terms") > 0)
    asked = written(one.groupBy("id").agg(F.min(F.struct("terms", "counts")).alias("q")).select("id", "q.*"), "queries")
    words = written(docs.mapInArrow(_frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("df")), "frequencies")
    count = docs.count()
    total = words.where("term is null").agg(F.sum("df")).first()[0] or 0
    mean = total / count if count else 0.0
    terms = asked.mapInArrow(_exploded, "id long, term long, tf long")
    idf = F.log1p((F.lit(float(count)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = written(terms.join(words, "term").select("id", "term", (F.col("tf") * idf).alias("weight")), "weighted")
    blocks = max(1, -(-weighted.count() // block_terms))
    # a sixteenth of the documents is searched first: the k-th best score there is a threshold for all others
    ahead = F.pmod(F.xxhash64("id"), F.lit(16)) == 0
    named = docs.where("id is not null")
    shards = max(1, -(-total // (16 * PIECE_TERMS)))
    spark.sparkContext.environment.setdefault("OPENBLAS_NUM_THREADS", "1")  # tasks run beside each other
    shared, ids = [], []
    for b in range(blocks):
        value = _block(weighted.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)) == b))
        shared.append(spark.sparkContext.broadcast(value))
        ids.append(value[0])
        del value
    early = written(_best_of_shards(_found(named.where(ahead).repartition(max(4, shards)), [(x, None) for x in shared], k, mean), k), "early")
    reached = early.where(F.size("found") >= k).select("query_id", F.element_at("found", k)["score"].alias("least")).toArrow()
    least = _thresholds(ids, reached.column("query_id").to_numpy(), reached.column("least").to_numpy())
    rest = _found(named.where(~ahead), [(x, spark.sparkContext.broadcast(y)) for x, y in zip(shared, least)], k, mean)
    merged = early.unionByName(_best_of_shards(rest, k)).groupBy("query_id").agg(_best_of(F.collect_list("found"), k).alias("found"))
    ranked = merged.select("query_id", F.posexplode("found").alias("place", "hit"))
    return ranked.select("query_id", (F.col("place") + 1).alias("rank"), F.col("hit.id").alias("doc_id"), F.round("hit.score", 6).alias("score"))


def _block(weighted: DataFrame) -> tuple:
    """Queries as arrays: ids, their different terms, the places of each query's terms in these, the terms' weights, and where
    each query starts.  The caller keeps their number of terms bounded."""
    table = weighted.toArrow()
    ids, terms, weights = (table.column(c).to_numpy() for c in ("id", "term", "weight"))
    del table
    order = np.lexsort((terms, ids))
    queries, first = np.unique(ids[order], return_index=True)
    different, place = np.unique(terms.view(np.uint64), return_inverse=True)
    return queries, different, place[order].astype(np.int32), weights[order], np.concatenate([first, [len(ids)]]).astype(np.int64)


def _thresholds(ids: list[np.ndarray], query: np.ndarray, least: np.ndarray) -> list[np.ndarray]:
    """The threshold of each query of each block, 0 where there is none."""
    order = np.argsort(query)
    query, least = np.append(query[order], 0), np.append(least[order], 0.0)
    at = [np.searchsorted(query[:-1], own) for own in ids]
    return [np.where((x < len(query) - 1) & (query[x] == own), least[x], 0.0) for x, own in zip(at, ids)]


def _found(docs: DataFrame, blocks: list, k: int, mean: float) -> DataFrame:
    found = docs.mapInArrow(lambda it: _search(it, blocks, k, mean), "query_id long, found array<struct<score:double,id:long>>")
    return found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))


def _best_of_shards(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, in two steps, so that no list is longer than those of a 64th of the shards."""
    merged = found.groupBy("query_id", "part").agg(_best_of(F.collect_list("found"), k).alias("found"))
    return merged.groupBy("query_id").agg(_best_of(F.collect_list("found"), k).alias("found"))


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), 64):
            part = batch.slice(i, 64)
            terms = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("terms")]
            counts = [np.frombuffer(x.as_buffer(), np.uint32).astype(np.int64) for x in part.column("counts")]
            ids = np.repeat(part.column("id").to_numpy(), [len(t) for t in terms])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(terms)), pa.array(np.concatenate(counts))], names=["id", "term", "tf"])


QUERY_EVERY = 50


def op10_bm25_wand(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs, docs.where(F.col("doc_id") % QUERY_EVERY == 0))
