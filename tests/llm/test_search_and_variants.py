"""Near fingerprints, ranked search and spelling variants on awkward rows, against plain versions."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortry.llm import common, retrieval, simhash, spelling
from tests.llm.cases import BASE, documents, lowered, plain, spaced

# fingerprints


def plain_print(text):
    w = spaced(lowered(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_similar(rows):
    prints = [plain_print(t) for _, t, *_ in rows]
    near = {k: {j for j in range(len(rows)) if (prints[k] ^ prints[j]).bit_count() <= 2} for k in range(len(rows))}
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[k][0], f"{prints[k]:016x}", min(ids) if ids else None))
    return Counter(out)


def similar(spark, rows):
    return Counter(map(tuple, simhash.similar(documents(spark, rows)).select("doc_id", "fingerprint", "component_id").collect()))


def test_similar_on_awkward_rows(spark):
    rng = random.Random(4)
    words = "alpha beta gamma delta eta theta iota kappa lambda mu nu xi pi rho sigma tau".split()
    rows = list(BASE)
    for g in range(6):
        base = [rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.randrange(60, 400))]
        for k in range(6):
            w = list(base)
            w[rng.randrange(len(w))] = f"edit{k}"
            rows.append((100 + 10 * g + k, " \t"[k % 2].join(w) + "\n" * k, "en", "a"))
    want = plain_similar(rows)
    assert similar(spark, rows) == want
    assert any(c is not None and d != c for d, _, c in want)


def test_rows_without_ids_or_text_are_linked(spark):
    rows = [(None, "a b c d", None, None), (None, "a b c d", "en", "x"), (None, "q r s t u", None, None), (7, "q r s t u", None, None), (9, None, None, None), (3, "", None, None)]
    assert similar(spark, rows) == plain_similar(rows)


def test_long_text_is_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 7)
    text = " ".join(f"w{k % 89}" for k in range(500))
    counts, n = simhash.bit_counts(text.encode().split())
    assert n == 498 and sum(1 << b for b in range(64) if 2 * counts[b] > n) == plain_print(text)


@pytest.mark.parametrize("many", [0, 1, 3, 1000])
def test_links_connect_what_two_bits_part(spark, many):
    """Dense groups of fingerprints, whatever size of variant is paired by the join; all pairs are compared here."""
    rng = random.Random(many)
    prints = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        prints |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3]))) for _ in range(30)}
    prints |= {0, 1, 3, 7, (1 << 64) - 1, (1 << 63) | 1, 1 << 63, 1 << 31, 1 << 32, (1 << 31) | (1 << 32)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "bits long")
    got = {tuple(sorted((r.a & (1 << 64) - 1, r.b & (1 << 64) - 1))) for r in simhash.links(df, many).collect()}
    order = sorted(prints)
    true = {(a, b) for k, a in enumerate(order) for b in order[k + 1 :] if (a ^ b).bit_count() <= 2}
    assert got <= true

    def classes(pairs):
        up = {p: p for p in order}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[max(top(a), top(b))] = min(top(a), top(b))
        return [top(p) for p in order]

    assert classes(got) == classes(true)


def test_variants_share_a_key_if_a_segment_differs_by_one_bit(spark):
    rng = random.Random(1)
    for distance in (0, 1, 2):
        x = rng.getrandbits(63)
        y = x ^ sum(1 << b for b in rng.sample(range(63), distance))
        rows = simhash.segment_variants(spark.createDataFrame([(x,), (y,)], "bits long")).collect()
        keys = [{r.variant for r in rows if r.bits == p} for p in (x, y)]
        assert len(keys[0]) == 64 and keys[0] & keys[1]


# search

def plain_ranks(rows, items, top=10):
    docs = [(d, plain(t)) for d, t, *_ in rows]
    docs = [(d, w, Counter(w)) for d, w in docs if w]
    n_docs, n_all = len(docs), sum(len(w) for _, w, _ in docs)
    df = Counter(t for _, _, c in docs for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for d, w, c in docs:
            m = 100 - 75 + 75 * len(w) * n_docs // n_all
            s = 0
            for t in plain(text):
                if t in c:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += weight * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
            if s > 0:
                scored.append((-s, d is None, d or 0, d, s))
        out += [(item, k, d, s) for k, (_, _, _, d, s) in enumerate(sorted(scored)[:top], 1)]
    return Counter(out)


def ranks(spark, rows, items, **kwargs):
    bench = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, score int, rank string")
    got = retrieval.ranked_documents(documents(spark, rows), bench, **kwargs).select("item_id", "rank", "doc_id", "score")
    return Counter(map(tuple, got.collect()))


ITEMS = [
    (1, "the cat sat on the MAT"), (2, "eins zwei"), (3, None), (4, "..."), (5, "nowhere tobefound"), (6, "Straße ÉA naïve éa éa"),
    (6, "the moon"), (1, "the cat sat on the MAT"), (None, "time today"), (8, " ".join(f"w{k % 977}x{k % 13}" for k in range(3000))),
]


def test_ranks_on_awkward_rows(spark):
    assert ranks(spark, BASE, ITEMS) == plain_ranks(BASE, ITEMS)
    assert ranks(spark, BASE, ITEMS, part=1000) == plain_ranks(BASE, ITEMS)  # a few parts
    assert ranks(spark, [], ITEMS) == ranks(spark, BASE, []) == Counter()


def test_ranks_of_many_documents(spark, monkeypatch):
    """Several blocks, deep trees, ties and copies."""
    monkeypatch.setattr(retrieval, "LEAVES", 8)
    monkeypatch.setattr(retrieval, "FIRST", 50)
    rng = random.Random(8)
    words = [f"t{int(rng.paretovariate(0.6)) % 400}" for _ in range(4000)]
    rows = [(k, " ".join(rng.sample(words, rng.randrange(1, 60))), "en", "a") for k in range(700)]
    rows += [(1000 + k, rows[k % 5][1], "en", "b") for k in range(40)] + [(3, "t1 t1", None, None)] * 15
    items = [(k, " ".join(rng.sample(words, rng.randrange(1, 12)))) for k in range(90)]
    got = ranks(spark, rows, items)
    assert got == plain_ranks(rows, items)


def test_bounds_prune_whole_batches():
    """Documents of other topics than an item's aren't scored for it, and results stay those of all pairs."""
    rng = np.random.default_rng(0)
    n_terms, topics = 400, 20
    items = []
    for k in range(40):
        t = np.unique(rng.integers(0, 20, 5)) + 20 * (k % topics)
        items.append((t.astype(np.int64), rng.integers(1, 50, len(t)) * 100))
    weight = np.ones(n_terms, np.int64)
    search = retrieval.Search(retrieval.ItemTree(items, weight), np.zeros(len(items), np.int64))
    plain_scores = {k: [] for k in range(len(items))}
    for block in range(5):
        docs = [np.unique(rng.integers(0, 20, 8)) + 20 * rng.integers(0, topics) for _ in range(1000)]
        impacts = [rng.integers(1, 900_000, len(d)) for d in docs]
        ends = np.cumsum([0, *map(len, docs)])
        ids = np.arange(1000) + 1000 * block
        search.block(ids, ends, np.concatenate(docs), np.concatenate(impacts))
        for i, d, v in zip(ids, docs, impacts):
            held = dict(zip(d.tolist(), v.tolist()))
            for k, (t, w) in enumerate(items):
                s = sum(int(x) * held.get(y, 0) for x, y in zip(w, t.tolist()))
                if s:
                    plain_scores[k].append((-s, int(i)))
    for place, k in enumerate(search.tree.order):
        scores, ids = search.best[place]
        assert list(zip((-scores).tolist(), ids.tolist())) == sorted(plain_scores[int(k)])[:10]
    assert search.scored < 0.2 * search.pairs


def test_node_maxima_bound_every_pair():
    rng = np.random.default_rng(1)
    items = [(np.sort(rng.choice(50, 6, replace=False)), rng.integers(1, 9, 6)) for _ in range(70)]
    tree = retrieval.ItemTree(items, np.ones(50, np.int64))
    assert sorted(tree.order.tolist()) == list(range(70)) and len(tree.levels) > 2
    for spans, nodes in zip(tree.levels, tree.maxima):
        assert spans[0][0] == 0 and spans[-1][1] == 70 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        for (lo, hi), (terms, most) in zip(spans, nodes):
            held = dict(zip(terms.tolist(), most.tolist()))
            assert all(held[t] >= v for k in tree.order[lo:hi] for t, v in zip(*map(np.ndarray.tolist, items[k])))


def test_scores_beyond_doubles_stay_exact():
    items = [(np.array([0, 1]), np.array([9_007_199_255, 1]))]
    tree = retrieval.ItemTree(items, np.ones(2, np.int64))
    assert tree.kind is np.int64
    search = retrieval.Search(tree, np.zeros(1, np.int64))
    search.block(np.array([5, 6]), np.array([0, 2, 3]), np.array([0, 1, 0]), np.array([999_999, 1, 999_999]))
    assert search.best[0][0].tolist() == [9_007_199_255 * 999_999 + 1, 9_007_199_255 * 999_999]


# spelling

def plain_words_of(rows):
    n = Counter()
    for d, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    near = {a: [b for b in n if one_edit(a, b)] for a in n}
    form = {}
    for a, others in near.items():
        if others:
            best = min(others, key=lambda b: (-n[b], b))
            if n[best] >= 2 * n[a]:
                form[a] = best
    out = set()
    for a in n:
        root = a
        while root in form:
            root = form[root]
        out.add((a, form.get(a), root, n[a], len(near[a]), n[form[a]] if a in form else None))
    return out


def variants(spark, rows):
    got = spelling.variants(documents(spark, rows)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r.word for r in got}) == len(got)
    return {tuple(r) for r in got}


def _misspelt(rng, words, letters):
    out = []
    for w in words:
        out += [w] * rng.randrange(1, 40)
        for _ in range(rng.randrange(6)):
            i, c = rng.randrange(len(w)), rng.choice(letters)
            v = rng.choice([w[:i] + c + w[i + 1 :], w[:i] + c + w[i:], w[:i] + w[i + 1 :], w + c])
            out += [v] * rng.randrange(1, 9)
            words = [*words, v]
    return out


def test_variants_on_awkward_rows(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abéèÿ") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    runs = _misspelt(rng, words, "abcéÀ")
    rng.shuffle(runs)
    rows = [*BASE, *[(1000 + k, " ,.\n7ß–"[k % 7].join(runs[k::40]), "en", "a") for k in range(40)]]
    rows += [(None, "hello Hello HELLO hallo hallo hallo Ābcdefg", None, None)] * 2
    rows += [(k, "aaaaa aaaaaa aaaaaaa aaaab baaaa aaaaaaaa", None, None) for k in range(4)]
    rows += [(2000 + k, "chainword " * 8 + "chainwort " * 3 + "chainwortt" * (k < 4), None, None) for k in range(6)]
    want = plain_variants(plain_words_of(rows))
    assert variants(spark, rows) == want
    assert any(f and f != r for _, f, r, *_ in want) and len(want) > 60  # chains of forms


def test_edges_beyond_the_bound_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(spelling, "MOST_EDGES", 0)
    monkeypatch.setattr(spelling, "HELD", 5)
    rng = random.Random(6)
    words = ["pre" + "".join(rng.choice("xyz") for _ in range(rng.randrange(3, 7))) for _ in range(80)]
    rows = [(k, " ".join(words), None, None) for k in range(3)]
    assert variants(spark, rows) == plain_variants(plain_words_of(rows))


def test_very_long_words(spark):
    long = "".join(chr(97 + (k * k) % 23) for k in range(3000))
    forms = [long, long[:1500] + long[1501:], long[:2999] + "ß", "ß" + long, long + "b", long[:7] + "ÿ" + long[8:]]
    rows = [(k, " ".join([forms[0]] * 5 + forms), None, None) for k in range(5)]
    n = plain_words_of(rows)
    assert len(n) >= 6 and variants(spark, rows) == plain_variants(n)


def test_empty_tables(spark):
    docs = documents(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (simhash.similar(docs), retrieval.ranked_documents(docs, bench), spelling.variants(docs)):
        assert df.collect() == []
    assert spelling.variants(documents(spark, [(1, "one two", None, None)])).collect() == []


def test_bands_cover_every_level():
    for longest in (1, 5, 24, 3000):
        cut = spelling.bands(longest)
        assert cut[0][0] == 0 and cut[-1][1] >= longest + 1 and all(a[1] == b[0] for a, b in zip(cut, cut[1:]))
        assert len(cut) <= math.log2(longest + 1) + 2


def test_frontier_meets_a_neighbour_once(spark):
    words = ["aaaaa", "aaaaaa", "aabaa", "aaaba", "baaaa", "aaaac", "caaaac"]
    got = spelling.neighbours(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    pairs = [tuple(sorted((r.a, r.b))) for r in got]
    assert len(set(pairs)) == len(pairs)
    assert set(pairs) == {(a, b) for a in words for b in words if a < b and one_edit(a, b)}


def test_only_tables_in_few_pieces_are_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    assert common.spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == cores
    many = spark.range(100, numPartitions=cores)
    assert common.spread(many) is many


def test_rows_are_counted_as_they_are_written(spark):
    for n in (0, 7):
        out, found = common.counted(spark.range(n), "counted")
        assert found == n == out.count()
    out, found = common.measured(spark.range(5), "measured", most=F.max("id"), n=F.count("*"))
    assert found == {"most": 4, "n": 5} and out.columns == ["id"]
