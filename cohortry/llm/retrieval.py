"""Ranked lexical search of a table of items in a table of documents, by a dual-tree search.

Both sides are trees whose nodes hold, for each term, the largest value below them: an item's value of a term is the
term's weight times its repeats, a document's is the term's impact. The product of two nodes' maxima bounds the score of
every item and document below them, so a pair of nodes whose bound stays below the weakest kth score of the node's items
is left out with all its documents; what is left descends on both sides, and leaves are scored exactly. All numbers are
integers, so bounds and scores are exact.

Spark does the work in passes: one reads the whole texts and keeps each document's length and counts of the items' terms;
aggregates give the corpus figures; a search of some documents gives each item a first kth score, which holds for the
whole table as theirs are real scores; then each task builds trees over blocks of its documents and searches them,
keeping ten documents an item; last, the tasks' tens are ranked. No text is shuffled, and what a task sends does not grow
with its documents. Items are taken in parts of about ``PART`` different terms of each, so that a part's tree can be held
by every task; more items take more passes in the same way.

Edge cases: a null text has no terms; an item without terms, or whose terms no document holds, has no rows; rows of one
item_id and text are one item, other rows of the id are ranked on their own; every row of a repeated document has its own
rank, next to its copies; a null doc_id ranks after ids of the same score; empty tables give an empty table; a document or
item of any length is read whole. Only item_id, doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.llm.common import PLAIN_BYTES, plain_words, spread, table, written

TOP = 10
#: Terms of items (repeats not counted) that are searched in one pass.
PART = 200_000
#: Documents of the first search, about.
FIRST = 4_096
#: Documents and items of a leaf, and nodes below a node.
LEAF, ITEMS, FAN = 8, 1, 4
#: Leaves of a block at most, and numbers of their maxima at most.
LEAVES, CELLS = 512, 8_000_000
NO_ID = (1 << 63) - 1


def term_counts(text: str, terms: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """The text's number of terms with repeats, those of ``terms`` that it holds, and how often."""
    words = text.encode().translate(PLAIN_BYTES).split(b" ")
    known = [t for t in map(terms.get, words) if t is not None]
    ids, counts = np.unique(np.array(known, np.int32), return_counts=True)
    return len(words) - words.count(b""), ids, counts


def forward_index(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n (terms with repeats), ids and tfs of the given terms, for each row of ``docs`` that has a term."""
    numbers = {t.encode(): i for i, t in enumerate(terms)}
    names = ["doc_id", "n", "ids", "tfs"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [term_counts(t.as_py() or "", numbers) for t in batch.column("text")]
            ends = np.cumsum([0, *[len(r[1]) for r in rows]], dtype=np.int32)
            lists = [
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *[r[k] for r in rows]]), kind))
                for k, kind in ((1, pa.int32()), (2, pa.int64()))
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), *lists], names=names)

    read = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return read.mapInArrow(count, "doc_id long, n long, ids array<int>, tfs array<long>").filter("n > 0")


class ItemTree:
    """Items as rows of (terms, values), in an order that puts items of one strongest term side by side; levels of nodes
    from a few roots down to leaves of ``ITEMS`` items."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray):
        self.weight, n_terms = weight, len(weight)
        strongest = [(t[v.argmax()], k) if len(t) else (-1, k) for k, (t, v) in enumerate(items)]
        self.order = np.array([k for _, k in sorted(strongest)], np.int64)
        self.n_terms = n_terms
        most = max((int(v.sum()) for _, v in items), default=0) * 1_000_000  # no impact reaches a million
        self.kind = np.float64 if most < 1 << 53 else np.int64  # doubles are exact below 2**53
        spans = [(lo, min(lo + ITEMS, len(items))) for lo in range(0, len(items), ITEMS)]
        self.levels = []
        while spans:
            self.levels.insert(0, spans)
            if len(spans) <= FAN:
                break
            spans = [(spans[k][0], spans[min(k + FAN, len(spans)) - 1][1]) for k in range(0, len(spans), FAN)]
        self.maxima = [[self._maxima(items, *span) for span in level] for level in self.levels]
        self.leaves = []
        for (lo, hi), (terms, _) in zip(self.levels[-1] if spans else [], self.maxima[-1] if spans else [], strict=True):
            values = np.zeros((len(terms), hi - lo), self.kind)
            for k in range(lo, hi):
                t, v = items[self.order[k]]
                values[np.searchsorted(terms, t), k - lo] = v
            self.leaves.append((terms, values))

    def _maxima(self, items, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        mine = [items[k] for k in self.order[lo:hi]]
        terms, at = np.unique(np.concatenate([t for t, _ in mine]), return_inverse=True)
        most = np.zeros(len(terms), self.kind)
        np.maximum.at(most, at, np.concatenate([v for _, v in mine]).astype(self.kind))
        return terms, most


class Search:
    """The best documents of each item among the blocks seen so far; ``least`` has a kth score that is known to be
    reached (0 if none is). Counts pairs of documents and items, and those that were scored."""

    def __init__(self, tree: ItemTree, least: np.ndarray, top: int = TOP):
        self.tree, self.top = tree, top
        self.least = least[tree.order].astype(np.int64)  # by place in the tree
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in tree.order]
        self.pairs = self.scored = 0

    def block(self, ids: np.ndarray, ends: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> None:
        """Documents ids[k] with terms[ends[k]:ends[k + 1]] and their impacts."""
        tree, n = self.tree, len(ids)
        self.pairs += n * len(tree.order)
        sizes = np.diff(ends)
        owner = np.repeat(np.arange(n), sizes)
        strongest = np.full(n, -1, np.int64)
        by = np.lexsort((impacts * tree.weight[terms], owner))
        last = by[ends[1:][sizes > 0] - 1]
        strongest[sizes > 0] = terms[last]
        order = np.lexsort((ids, strongest))  # documents of one strongest term side by side
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        depth = len(tree.levels)
        while depth > 1 and LEAF * FAN ** (depth - 1) > n:
            depth -= 1
        n_leaves = -(-n // (LEAF * FAN ** (depth - 1))) * FAN ** (depth - 1)
        low = np.zeros((n_leaves, tree.n_terms), tree.kind)
        np.maximum.at(low, (place[owner] // LEAF, terms), impacts)
        maxima = [low]
        for _ in range(depth - 1):
            maxima.insert(0, maxima[0].reshape(-1, FAN, tree.n_terms).max(1))
        alive = np.ones((len(tree.levels[0]), len(maxima[0])), bool)
        wait = len(tree.levels) - depth  # levels that a deeper item tree descends alone
        for level, (spans, nodes) in enumerate(zip(tree.levels, tree.maxima, strict=True)):
            if level:
                alive = np.repeat(alive, FAN, 0)[: len(spans)]
            if level > wait:
                alive = np.repeat(alive, FAN, 1)
            for q, ((lo, hi), (held, most)) in enumerate(zip(spans, nodes, strict=True)):
                docs = np.flatnonzero(alive[q])
                bound = maxima[max(0, level - wait)][np.ix_(docs, held)] @ most
                alive[q, docs] = (bound >= self.least[lo:hi].min()) & (bound > 0)
        self._leaves(alive, ids, ends, terms, impacts, order)

    def _leaves(self, alive, ids, ends, terms, impacts, order) -> None:
        tree, n = self.tree, len(ids)
        scratch = np.zeros((LEAF, tree.n_terms), tree.kind)
        found: dict[int, list] = {}
        for leaf in np.flatnonzero(alive.any(0)):
            docs = order[leaf * LEAF : min((leaf + 1) * LEAF, n)]
            for row, d in enumerate(docs):
                scratch[row, terms[ends[d] : ends[d + 1]]] = impacts[ends[d] : ends[d + 1]]
            for q in np.flatnonzero(alive[:, leaf]):
                lo, hi = tree.levels[-1][q]
                held, values = tree.leaves[q]
                scores = (scratch[: len(docs), held] @ values).astype(np.int64)
                self.scored += scores.size
                row, item = np.nonzero((scores >= np.maximum(self.least[lo:hi], 1)))
                for k in np.unique(item):
                    mine = row[item == k]
                    found.setdefault(lo + k, []).append((scores[mine, k], ids[docs[mine]]))
            for row, d in enumerate(docs):
                scratch[row, terms[ends[d] : ends[d + 1]]] = 0
        for k, parts in found.items():
            scores = np.concatenate([self.best[k][0], *[p[0] for p in parts]])
            names = np.concatenate([self.best[k][1], *[p[1] for p in parts]])
            keep = np.lexsort((names, -scores))[: self.top]
            self.best[k] = scores[keep], names[keep]
            if len(keep) == self.top:
                self.least[k] = max(self.least[k], scores[keep[-1]])


def best_documents(index: DataFrame, tree: ItemTree, least: np.ndarray, n_docs: int, n_all: int, top: int = TOP) -> DataFrame:
    """item (its number), doc_id, score: the best ``top`` documents of each item in each task, above or at ``least``."""
    leaves = max(1, min(LEAVES, CELLS // max(tree.n_terms, 1)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Search(tree, least, top)
        for whole in batches:
            for lo in range(0, whole.num_rows, leaves * LEAF):
                batch = whole.slice(lo, leaves * LEAF)
                ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
                n = batch.column("n").to_numpy(zero_copy_only=False)
                terms = batch.column("ids").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False)
                sizes = batch.column("ids").value_lengths().to_numpy(zero_copy_only=False)
                m = np.repeat(100 - 75 + (75 * n * n_docs) // n_all, sizes)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                found.block(ids, ends, terms, (1_000_000_000 * tf) // (1000 * tf + 8 * m))
        for k, (scores, ids) in enumerate(found.best):
            if len(ids):
                names = pa.array(ids, pa.int64(), mask=ids == NO_ID)
                item = pa.array(np.full(len(ids), tree.order[k], np.int32))
                yield pa.RecordBatch.from_arrays([item, names, pa.array(scores)], names=["item", "doc_id", "score"])

    return index.select("doc_id", "n", "ids", "tfs").mapInArrow(search, "item int, doc_id long, score long")


def _search_part(items: DataFrame, docs: DataFrame, top: int) -> DataFrame:
    """The ranks of one part of the items (item_id, print, term, repeats)."""
    spark = docs.sparkSession
    rows = items.collect()  # about PART rows
    kind = items.schema["item_id"].dataType.simpleString()
    if not rows:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    keys = sorted({(str(r["item_id"]), r["print"]) for r in rows})
    number = {k: i for i, k in enumerate(keys)}
    names = {number[str(r["item_id"]), r["print"]]: r["item_id"] for r in rows}
    terms = sorted({r["term"] for r in rows})
    at = {t: i for i, t in enumerate(terms)}
    index = written(forward_index(docs, terms), "search-index")
    n_docs, n_all = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = index.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df"))
    df = {r["id"]: r["df"] for r in held.collect()}  # a row for each term of the part
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(terms))], np.int64)
    each: list[dict[int, int]] = [{} for _ in keys]
    for r in rows:
        each[number[str(r["item_id"]), r["print"]]][at[r["term"]]] = r["repeats"]
    vectors = []
    for own in each:
        t = np.array(sorted(own), np.int64)
        vectors.append((t, weight[t] * np.array([own[x] for x in t.tolist()], np.int64)))
    tree = ItemTree(vectors, weight)
    none = np.zeros(len(keys), np.int64)
    share = min(1.0, FIRST / max(n_docs, 1))
    some = index.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    first = best_documents(some, tree, none, n_docs, n_all, top).withColumn("rank", F.row_number().over(best))
    for r in first.filter(F.col("rank") == top).collect():  # a row for each item at most
        none[r["item"]] = r["score"]
    found = best_documents(index, tree, none, n_docs, n_all, top).withColumn("rank", F.row_number().over(best))
    named = spark.createDataFrame(sorted(names.items()), f"number int, item_id {kind}")
    return found.filter(F.col("rank") <= top).join(F.broadcast(named), F.col("item") == F.col("number")).select(
        "item_id", "rank", "doc_id", "score"
    )


def ranked_documents(docs: DataFrame, items: DataFrame, top: int = TOP, part: int = PART) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``top`` documents of each item with a score above 0."""
    words = items.select("item_id", F.coalesce(F.sha2("text", 256), F.lit("")).alias("print"), plain_words(F.col("text")).alias("words"))
    counted = words.distinct().select("item_id", "print", F.explode("words").alias("term"))
    counted = written(counted.groupBy("item_id", "print", "term").agg(F.count("*").alias("repeats")), "search-items")
    parts = max(1, -(-counted.count() // part))
    key = F.pmod(F.xxhash64("item_id", "print"), F.lit(parts))
    return reduce(DataFrame.union, [_search_part(counted.filter(key == k), docs, top) for k in range(parts)])


def op12_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = """
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, sha256(coalesce(text, '')) AS print, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
i AS (SELECT item_id, print, t, count(*) AS c FROM (SELECT item_id, print, unnest(w) AS t FROM iw) GROUP BY ALL),
a AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_all FROM dw WHERE len(w) > 0),
d AS (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM dw) WHERE t IN (SELECT t FROM i) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM d GROUP BY t), a),
p AS (SELECT r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_all))) AS s FROM d JOIN f USING (t), a),
s AS (SELECT item_id, print, r, doc_id, sum(c * s)::BIGINT AS score FROM p JOIN i USING (t) GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id, print ORDER BY score DESC, doc_id NULLS LAST, r)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""
