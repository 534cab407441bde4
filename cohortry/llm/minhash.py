"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Signatures: one permutation scatters shingles over a circle of ``UNIVERSE`` places, a second one gives values to these
places, and coordinate k is the smallest value k places further on. So all coordinates of a shingle are one slice of
the value table. ``BANDS`` bands of ``ROWS`` coordinates make candidate keys; the low bits of all coordinates and the
set sizes screen candidates; what passes is confirmed on the full sets of word shingles.

Work per group of copies stays near linear: texts of one word sequence (by SHA-256, cut to 128 bits) are one class;
each class first asks for a few links, to the nearest by bits among its keys' leads and its neighbours in them; links
make components; then only classes outside a key's largest component are compared with the key's others, by a prefix
join on their rarest shingles. A screen on bits leaves out classes that nothing in their key comes near; where a key
would need more than ``MOST_SCREENED`` comparisons for it, all its classes go to the prefix join instead. Every link is
confirmed on full sets; different sequences with equal sets are linked that way as well.

Chance: a pair of Jaccard 0.75 shares no band with probability (1 - 0.75^4)^32 = 5e-6, and fails the screen on bits
with about 1e-6.

Edge cases: a null text, or one without words, has an empty set and stays alone; a text of fewer than five words is one
shingle; rows with a null doc_id stay alone with a null component and are kept; an empty table gives an empty table;
repeated rows are copies of each other; the longest text's shingles are held in one task. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.llm.common import counted, spread, table, written
from cohortry.llm.graph import components

SHINGLE = 5
PERCENT = 75
UNIVERSE = 1 << 20
COORDINATES = 256
BANDS, ROWS = 32, 4
#: Bits of two sets of Jaccard 0.75 differ in 32 of 256 places on average, with a deviation of 5.3.
MOST_BITS = 62
#: Tokens at the start of a prefix that later ones carry, so that a pair is met at its first common token only.
HEAD = 48
#: Documents whose shingles are held at a time.
SOME = 256
#: Links that a class asks for before components are made.
ASKS = 3
#: Bit comparisons inside one key at most.
MOST_SCREENED = 10_000_000
#: Members of a key that one task links to their neighbours.
CHUNK = 512
#: Ids of documents with candidates that are broadcast at most (8 bytes each).
MOST_IDS = 1_000_000
_LONGS = [f"bits{k}" for k in range(COORDINATES // 64)]
_KEYS = [f"key{k}" for k in range(BANDS)]


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode().lower().split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(words: list[bytes], hashes: dict[bytes, int]) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles."""
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for j in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - size + 1 + j]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return np.unique(h)


class Circulant:
    """Signatures from two permutations of the same circle."""

    def __init__(self, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.place = rng.permutation(UNIVERSE).astype(np.int32)
        value = rng.permutation(UNIVERSE).astype(np.int32)
        round_ = np.concatenate([value, value[: COORDINATES - 1]])
        self.slices = np.lib.stride_tricks.sliding_window_view(round_, COORDINATES)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        at = self.place[(hashes % np.uint64(UNIVERSE)).astype(np.int64)]
        least = self.slices[at[:1024]].min(0)
        for lo in range(1024, len(at), 1024):
            np.minimum(least, self.slices[at[lo : lo + 1024]].min(0), out=least)
        return least


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, 128 bits of the word sequence's SHA-256, bits of the coordinates, and a key for each band."""
    fields = ["doc_id", "n_shingles", "print1", "print2", *_LONGS, *_KEYS]
    schema = ", ".join(f"{f} long" for f in fields)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        circle, hashes = Circulant(), _Hashes()
        salt = np.random.default_rng(23).integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            n = batch.num_rows
            out = np.zeros((n, len(fields) - 1), np.int64)
            for k, text in enumerate(batch.column("text")):
                t = text.as_py()
                words = words_of(t) if t else []
                if not words:
                    continue
                h = shingle_hashes(words, hashes)
                s = circle.signature(h)
                keys = (s[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS) + np.uint64(1)) * salt
                keys = np.bitwise_xor.reduce(keys ^ (keys >> np.uint64(29)), axis=1) * np.uint64(0x94D049BB133111EB)
                keys ^= keys >> np.uint64(31)
                row = out[k]
                row[0] = len(h)
                row[1:3] = np.frombuffer(hashlib.sha256(b" ".join(words)).digest()[:16], np.int64)
                row[3 : 3 + len(_LONGS)] = np.packbits((s & 1).astype(np.uint8)).view(np.int64)
                row[3 + len(_LONGS) :] = keys.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(np.ascontiguousarray(out[:, c])) for c in range(out.shape[1])]],
                names=fields,
            )

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(sign, schema)


def _differ(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in _LONGS), F.lit(0))


def _screen(a: str, b: str) -> Column:
    """Sizes and bits allow the Jaccard threshold."""
    x, y = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (_differ(a, b) <= MOST_BITS) & (100 * F.least(x, y) >= PERCENT * F.greatest(x, y))


def _left_over(rest: DataFrame, docs: DataFrame) -> DataFrame | None:
    """Pairs (a, b) of classes in different components that may still be linked; None if no class is left for it.

    ``rest`` has the members (key, own, main, many, m) of keys that hold more than one component. Classes outside the
    largest component that have a screened partner, and those partners, are compared by a prefix join (of keys that are
    too large to be screened, all classes are): with a class's shingles
    in order of rarity, linked sets share one among the first n - ceil(0.75 n) + 1 of both, at places that leave
    enough others. So a near copy whose own edits fill its prefix meets only what shares these edits.
    """
    few, many = rest.filter("not many"), rest.filter("many")
    x = few.filter("own <> main").select(F.col("key").alias("kx"), F.col("own").alias("xo"), F.col("m").alias("x"))
    y = few.select(F.col("key").alias("ky"), F.col("own").alias("yo"), F.col("m").alias("y"))
    fits = (F.col("kx") == F.col("ky")) & (F.col("xo") != F.col("yo")) & _screen("x", "y")
    x = written(x.join(y, fits, "left_semi"), "near-apart")
    others = x.select(F.col("x.doc").alias("doc"), F.col("xo").alias("own"), F.lit(1).alias("apart"))
    near = y.join(x, fits, "left_semi").select(F.col("y.doc").alias("doc"), F.col("yo").alias("own"), F.lit(0).alias("apart"))
    unscreened = many.select(F.col("m.doc").alias("doc"), "own", (F.col("own") != F.col("main")).cast("int").alias("apart"))
    every = others.union(near).union(unscreened)
    some, n = counted(every.groupBy("doc", "own").agg(F.max("apart").alias("apart")), "near-some")
    if not n:  # no key has a class that comes near another component
        return None
    ids = F.broadcast(some) if n <= MOST_IDS else some
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("doc")).select("doc", "own", "apart", "text")

    def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for whole in batches:
            for lo in range(0, whole.num_rows, SOME):
                batch = whole.slice(lo, SOME)
                words = [words_of(t.as_py() or "") for t in batch.column("text")]
                sets = [shingle_hashes(w, hashes) if w else np.zeros(0, np.uint64) for w in words]
                n = np.array([len(h) for h in sets], np.int64)
                held = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "own", "apart")]
                columns = [pa.array(np.repeat(c, n)) for c in (*held, n)]
                token = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays([*columns, token], names=["doc", "own", "apart", "n", "token"])

    tokens = texts.mapInArrow(tokens_of, "doc long, own long, apart int, n long, token long")
    tokens = written(tokens.distinct(), "near-tokens")
    counts = tokens.groupBy("token").agg(F.count("*").alias("f"))
    rare = Window.partitionBy("doc").orderBy("f", "token")
    prefix = tokens.join(counts, "token").withColumn("i", F.row_number().over(rare))
    prefix = prefix.filter(100 * (F.col("n") - F.col("i") + 1) >= PERCENT * F.col("n"))
    head = F.collect_list(F.when(F.col("i") <= HEAD, F.struct("i", "token"))).over(Window.partitionBy("doc"))
    prefix = prefix.withColumn("head", F.array_sort(head)["token"])
    before = F.slice("head", 1, F.least(F.col("i") - 1, F.lit(HEAD))).alias("before")
    prefix = written(prefix.select("token", F.struct("doc", "own", "apart", "n", "i", before).alias("t")), "near-prefix")
    a = prefix.filter("t.apart = 1").select(F.col("token").alias("ta"), F.col("t").alias("a"))
    b = prefix.select(F.col("token").alias("tb"), F.col("t").alias("b"))
    left = 1 + F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i"))
    enough = (100 + PERCENT) * left >= PERCENT * (F.col("a.n") + F.col("b.n"))
    sizes = 100 * F.least("a.n", "b.n") >= PERCENT * F.greatest("a.n", "b.n")
    once = (F.col("b.apart") == 0) | (F.col("a.doc") < F.col("b.doc"))
    met = ~F.arrays_overlap("a.before", "b.before")
    pairs = a.join(b, (F.col("ta") == F.col("tb")) & (F.col("a.own") != F.col("b.own")) & once & sizes & enough & met)
    return pairs.select(F.col("a.doc").alias("a"), F.col("b.doc").alias("b")).distinct()


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those pairs (a, b) of doc_ids whose full shingle sets reach the threshold.

    Texts of documents without a candidate are dropped before any shuffle: their ids are broadcast while they are no
    more than ``MOST_IDS``, beyond that joined.
    """
    ids, n = counted(
        pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "near-ids"
    )
    few = F.broadcast(ids) if n <= MOST_IDS else ids
    texts = docs.select("doc_id", "text").join(few, F.col("doc_id") == F.col("id"), "left_semi")
    ta = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    tb = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def shingles(text: str) -> set:
        w = words_of(text)
        return set(zip(*[w[j:] for j in range(SHINGLE)], strict=False)) if len(w) >= SHINGLE else {tuple(w)}

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            last, held = None, set()
            for a, b, x, y in zip(*[batch.column(c) for c in ("a", "b", "text_a", "text_b")], strict=True):
                left = x.as_py()
                if left != last:
                    last, held = left, shingles(left)
                other = shingles(y.as_py())
                both = len(held & other)
                if 100 * both >= PERCENT * (len(held) + len(other) - both):
                    rows.append((a.as_py(), b.as_py()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["a", "b"]
            )

    joined = pairs.join(ta, "a").join(tb, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(signatures(docs), "near-signed")
    own = [F.first(c).alias(c) for c in (*_LONGS, *_KEYS)]  # equal in all rows of a class
    classes = written(
        signed.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("print1", "print2", "n_shingles")
        .agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"), *own),
        "near-classes",
    )
    keyed = classes.select("doc", F.explode(F.array(*_KEYS)).alias("key"))
    keys = keyed.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    held = keyed.join(keys, "key")
    parts = F.ceil(F.col("members") / CHUNK)
    held = held.withColumn("part", F.pmod(F.xxhash64("doc"), parts).cast("int"))
    bits = classes.select("doc", "n_shingles", *_LONGS)
    members = written(held.join(bits, "doc"), "near-members")

    mine = F.struct("doc", "n_shingles", *_LONGS)
    # a key's lead is the member whose keys have the most members, so the middle of a group of near copies
    degree = members.groupBy("doc").agg(F.sum("members").alias("degree"))
    ranked = members.select("key", "doc").join(degree, "doc")
    lead = ranked.groupBy("key").agg(F.max_by("doc", F.struct("degree", -F.col("doc"))).alias("lead"))
    mine = F.struct("doc", "n_shingles", *_LONGS)
    marked = members.join(lead, "key")
    leads = marked.filter("doc = lead").select("key", mine.alias("y"))
    to_lead = marked.filter("doc <> lead").select("key", mine.alias("x")).join(leads, "key")
    in_part = Window.partitionBy("key", "part").orderBy("n_shingles", "doc")
    chain = members.withColumn("y", F.lag(mine).over(in_part)).withColumn("at", F.row_number().over(in_part))
    heads = chain.filter("at = 1").select("key", "part", mine.alias("x"))
    to_head = heads.withColumn("y", F.lag("x").over(Window.partitionBy("key").orderBy("part"))).select("key", "x", "y")
    to_next = chain.filter("at > 1").select("key", mine.alias("x"), "y")

    asked = to_lead.select("x", "y").union(to_next.select("x", "y")).union(to_head.select("x", "y"))
    asked = asked.filter(F.col("y").isNotNull()).filter(_screen("x", "y"))
    asked = asked.select(F.col("x.doc").alias("b"), F.col("y.doc").alias("a"), _differ("x", "y").alias("d")).distinct()
    nearest = Window.partitionBy("b").orderBy("d", "a")  # a class has a few candidates for each of its keys
    first = asked.withColumn("k", F.row_number().over(nearest)).filter(F.col("k") <= ASKS).select("a", "b")
    links = written(confirmed(written(first, "near-asked"), docs), "near-links")
    labels = written(components(links), "near-labels")

    known = members.join(labels, F.col("doc") == F.col("node"), "left").withColumn(
        "own", F.coalesce("component", "doc")
    )
    sizes = known.groupBy("key", "own").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("n", "own")).alias("top"), F.count("*").alias("c"), F.sum("n").alias("all"))
    many = (F.col("all") - F.col("top.n")) * F.col("all") > MOST_SCREENED
    mixed = mixed.filter("c > 1").select("key", F.col("top.own").alias("main"), many.alias("many"))
    rest, n_rest = counted(known.join(mixed, "key").select("key", "own", "main", "many", mine.alias("m")), "near-rest")
    pairs = _left_over(rest, docs) if n_rest else None
    second, n_second = (None, 0) if pairs is None else counted(pairs, "near-second")
    if not n_second:
        final = labels
    else:
        found = written(confirmed(second, docs), "near-more")
        la, lb = (labels.select(F.col("node").alias(n), F.col("component").alias(c)) for n, c in (("na", "ca"), ("nb", "cb")))
        between = found.join(la, F.col("a") == F.col("na"), "left").join(lb, F.col("b") == F.col("nb"), "left")
        between = between.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        merged = written(components(between), "near-merged")
        merged = merged.select(F.col("node").alias("old"), F.col("component").alias("new"))
        every = labels.union(
            found.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti")
            .select("node", F.col("node").alias("component"))
        )
        final = every.join(merged, F.col("component") == F.col("old"), "left").select(
            "node", F.coalesce("new", "component").alias("component")
        )
    moved = (
        classes.select("print1", "print2", F.col("n_shingles").alias("ns"), "doc", "copies")
        .join(final, F.col("doc") == F.col("node"), "left")
        .filter("copies > 1 or node is not null")
        .select(F.col("print1").alias("p1"), F.col("print2").alias("p2"), "ns", F.coalesce("component", "doc").alias("to"))
    )
    out = signed.select("doc_id", "n_shingles", "print1", "print2").join(
        moved, (F.col("print1") == F.col("p1")) & (F.col("print2") == F.col("p2")) & (F.col("n_shingles") == F.col("ns")), "left"
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("to", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def op9_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
