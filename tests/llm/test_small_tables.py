"""Each operator on awkward rows and on the empty table, against brute force."""

import base64
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortry.llm import chat, common, decontamination, graph, language, licenses, minhash, mixing, quality, secrets, sharding, toxicity
from tests.llm.cases import BASE, documents, lowered, plain, spaced



def test_empty_tables(spark):
    docs = documents(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for df in (
        chat.preference_pairs(chat.drawn_pairs(turns)), sharding.document_shards(docs), licenses.scan_licenses(docs),
        language.document_languages(docs), toxicity.document_toxicity(docs, labels), decontamination.contamination(docs, bench),
        mixing.mix_counts(docs), mixing.mixed_documents(docs), quality.quality_verdicts(docs), minhash.near_duplicates(docs),
        secrets.secret_digests(docs),
    ):
        assert df.collect() == []


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_shards(spark, shards):
    docs = documents(spark)
    got = sharding.document_shards(docs, shards).collect()
    want = sorted(((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in BASE), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == want
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    counts = [len(by.get(k, [])) for k in range(shards)]
    assert max(counts) - min(counts) <= 1
    again = sharding.document_shards(docs.repartition(3), shards).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_many_equal_rows_are_dealt_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 7)
    rows = [(5, "the same", "en", "a")] * 100 + [(None, None, None, None)] * 50 + [(k, f"text {k}", "en", "a") for k in range(40)]
    keyed = documents(spark, rows).select("doc_id", F.octet_length("text").alias("size"))
    numbered = sharding.numbered_copies(keyed, ["doc_id", "size"]).collect()
    assert sorted(r._row for r in numbered) == list(range(190)) and {r._n for r in numbered} == {190}
    assert Counter((r.doc_id, r.size) for r in numbered) == Counter((d, len(t) if t else None) for d, t, *_ in rows)
    same = sorted(r._row for r in numbered if r.doc_id == 5 and r.size == 8)
    assert sum(b - a > 1 for a, b in zip(same, same[1:])) >= 5  # pieces lie in different buckets
    got = sharding.document_shards(documents(spark, rows), 9).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, *_ in rows)
    assert sorted(r.slot * 9 + r.shard for r in got) == list(range(190))


def test_row_numbers_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(k % 5, k, "x", k, k, k) for k in range(100)], "k int, _bucket int, `a.b` string, _at int, _offset int, _row int")
    got = sharding.row_numbers(df, ["k", "_bucket"])
    assert set(got.columns) == {"k", "_bucket", "a.b", "_at", "_offset", "_row", "_n"}
    rows = got.collect()
    assert sorted(r._row for r in rows) == list(range(100)) and all(r._at == r._bucket == r._offset for r in rows)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 1000, 4099])
def test_feistel_is_a_permutation(spark, n):
    df = spark.range(n).select(sharding.feistel(F.col("id"), F.lit(n).cast("long"), 7).alias("p"))
    got = [r.p for r in df.collect()]
    assert sorted(got) == list(range(n))
    assert n < 100 or got != sorted(got)


def targets(sizes):
    """Shares by weight; what is above a limit is shared again until nothing is."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: float(mixing.WEIGHTS[k % 3]) for k, s in enumerate(names)}
    out, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def near_targets(drawn, want):
    words = Counter()
    for text, source in drawn:
        words[source] += len(spaced(text))
    assert all(abs(words[s] - want[s]) <= 2 for s in want), (words, want)


@pytest.mark.parametrize("left", [0.0, 0.4, 7.5, 100.0, 1e9])
def test_what_is_left_is_filled(left):
    sizes = np.array([5, 0, 30, 2, 2, 60, 1, 40])
    takes = mixing.filled(sizes, left)
    simple, free = 0, left
    for size in sizes:
        if 0 < size <= free:
            simple, free = simple + size, free - size
    assert not takes[1] and abs(sizes[takes].sum() - left) <= abs(simple - left)
    assert takes.sum() == 7 or left < 1e9


def test_mixing(spark):
    rows = [(k, "x " * (1 + k * 7 % 50), "en", ["a", "b", "c", None, "e"][min(4, k % 9)]) for k in range(900)]
    rows += [r for r in BASE if r[0] not in (7, 8)]
    docs = documents(spark, rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(spaced(t))
    got = mixing.mix_counts(docs).collect()
    want = targets(dict(sizes))
    assert len(got) == len(rows) and sum(r.size for r in got) == sum(sizes.values())
    assert all(r.taken <= 3 * r.size for r in got)
    assert sorted({round(r.target, 6) for r in got}) == sorted({round(v, 6) for v in want.values()})
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix_counts(docs.repartition(5)).collect()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == [*docs.columns, "mix_shard", "mix_piece", "mix_order"]
    out = mixed.collect()
    assert sum(len(spaced(r.text)) for r in out) == sum(r.taken for r in got)
    near_targets([(r.text, r.source) for r in out], {s: want[s] for s in ("a", "b", "c", None, "e")})


def test_mixing_without_ids_and_with_repeated_ids(spark, monkeypatch):
    """Rows without an id, or of one id, are drawn each by themselves; a long document leaves no gap at the boundary;
    the caller's column names don't matter."""
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 400)
    big = (1 << 62) + 1
    rows = [(None if k % 2 else big, " ".join(f"w{k}x{j}" for j in range(1 + k * 11 % 90)), "en", "ab"[k % 3 == 0]) for k in range(600)]
    rows += [(7, "y " * 3000, "en", "a"), (8, "z " * 3000, "en", "b")]
    docs = documents(spark, rows)
    names = ["_s", "_b", "_d", "_us", "_block", "row", "unit", "draw", "mix_shard", "a.b"]
    wide = docs.withColumns({n: F.lit(n) for n in names})
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(spaced(t))
    want = targets(dict(sizes))
    mixed = mixing.mixed_documents(wide)
    assert mixed.columns == [c for c in wide.columns if c != "mix_shard"] + ["mix_shard", "mix_piece", "mix_order"]
    out, times = mixed.collect(), Counter()
    for r in out:
        times[(r.doc_id, r.text)] += 1
        assert all(r[n] == n for n in names if n != "mix_shard")
    near_targets([(r.text, r.source) for r in out], want)
    assert {d for d, _ in times} <= {None, big, 7, 8} and max(times.values()) <= 3
    assert len({times[(d, t)] for d, t, _, s in rows if s == "a" and d is None}) > 1
    assert sum(r.taken for r in mixing.mix_counts(docs).collect()) == sum(len(spaced(r.text)) for r in out)
    assert max(Counter(r.mix_shard for r in out).values()) < len(out) / 4


def test_a_large_shard_is_cut_into_pieces_of_its_order(spark, monkeypatch):
    docs = documents(spark, [(k, "x " * (1 + k * 7 % 50), "en", "abc"[k % 3]) for k in range(900)])
    (whole,) = {r.mix_piece for r in mixing.mixed_documents(docs).collect()}
    monkeypatch.setattr(mixing, "PIECE_WORDS", 300)
    rows = sorted((r.mix_shard, r.mix_order, r.mix_piece) for r in mixing.mixed_documents(docs).collect())
    assert whole == 0 and {p for *_, p in rows} == set(range(5))
    assert all(a[2] <= b[2] for a, b in zip(rows, rows[1:]) if a[0] == b[0])


def test_every_draw_lies_in_a_leaf_of_the_tree(spark, monkeypatch):
    """Without draws in the tree's leaves nothing is taken, so the leaves decide."""
    rows = [(k, "x " * (1 + k % 9), "en", "abc"[k % 3]) for k in range(300)]
    docs = documents(spark, rows)
    real = mixing.split_tree
    assert sum(r.taken for r in mixing.mix_counts(docs).collect()) > 0
    monkeypatch.setattr(mixing, "split_tree", lambda quotas, shards, seed: 0 * real(quotas, shards, seed))
    assert sum(r.taken for r in mixing.mix_counts(docs).collect()) == 0


def test_split_tree_is_exact():
    quotas = [5, 0, 17, 1000, 3]
    counts = mixing.split_tree(quotas, 7, 1)
    assert counts.sum(0).tolist() == quotas and counts.min() >= 0
    assert counts.sum(1).max() - counts.sum(1).min() <= 3


def measures(t):
    t = t or ""
    ws, lines = spaced(t), [x for x in t.split("\n") if spaced(x)]
    seen = Counter(zip(ws, ws[1:], ws[2:]))
    places = {i + o for i, g in enumerate(zip(ws, ws[1:], ws[2:])) if seen[g] > 1 for o in range(3)}
    bad = len(ws) < 50 or 100 * len(places) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(places), bad


def test_quality(spark):
    extra = [(20, "a b c a b c d a b c\nx\nx\n\nx |", "en", "a"), (21, " ".join(f"u{k}" for k in range(80)), "en", "a")]
    got = quality.quality_verdicts(documents(spark, BASE + extra)).collect()
    want = sorted(((d, *measures(t)) for d, t, *_ in BASE + extra), key=str)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=str) == want
    assert not any(r.kept and r.base_failed for r in got)


def test_bad_host_loses_its_good_document(spark):
    good = " ".join(f"u{k}" for k in range(80))
    rows = [(k, "short", "en", "bad") for k in range(200)] + [(900, good, "en", "bad")] + [(1000 + k, good, "en", f"h{k % 5}") for k in range(100)]
    got = {r.doc_id: r.kept for r in quality.quality_verdicts(documents(spark, rows)).collect()}
    assert not got[900] and got[1000]


def test_host_is_rejected_for_one_rule(spark):
    """A host of many symbols goes as a whole; one with as high a rate in a few documents stays; so does what all hosts do."""
    good, marks = " ".join(f"unit{k}" for k in range(80)), " ".join(f"unit{k} $$" for k in range(80))
    lines = "\n".join([f"only{k} line{k} of{k} words{k}" for k in range(30)] + ["the same line"] * 30)
    rows = [(k, marks if k % 2 else good, "en", "bad") for k in range(200)]
    rows += [(1000 + k, good if k % 4 else lines, "en", f"h{k % 10}") for k in range(1000)]
    rows += [(5000 + k, marks, "en", "few") for k in range(2)]
    got = quality.quality_verdicts(documents(spark, rows)).collect()
    assert not any(r.base_failed for r in got)
    assert {r.doc_id for r in got if r.host_failed} == {r.doc_id for r in got if not r.kept} == set(range(200))
    assert {r.host_broken for r in got} == {"", "symbols"}


def test_host_rates_are_shrunk(spark):
    rows = [(k, "short" if k < 30 else " ".join(f"unit{j}" for j in range(60)), "en", f"h{k % 7 % 3}") for k in range(90)]
    got = {r.host: r for r in quality.host_rates(quality.document_rules(documents(spark, rows))).collect()}
    held = {h: [k < 30 for k, *_ in rows if f"h{k % 7 % 3}" == h] for h in got}
    own = {h: sum(v) / len(v) for h, v in held.items()}
    m = sum(own.values()) / len(own)
    v = sum((x - m) ** 2 for x in own.values()) / len(own)
    weight = max(1.0, min(1e6, m * (1 - m) / v - 1))
    for h, r in got.items():
        mean = (sum(held[h]) + m * weight) / (len(held[h]) + weight)
        assert r.few_words_mean == pytest.approx(mean) and r.n_docs == len(held[h])
        assert r.few_words_low == pytest.approx(mean - 3 * (mean * (1 - mean) / (len(held[h]) + weight + 1)) ** 0.5)
        assert min(own[h], m) <= r.few_words_mean <= max(own[h], m) and r.broken == ""


def contaminated(docs, bench):
    windows = {}
    for item, t in bench:
        w = plain(t)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(item)
    for d, t, *_ in docs:
        w, hit, items = plain(t), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if owner := windows.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    items |= owner
        ids = ",".join(sorted(str(i) for i in items if i is not None))
        yield d, len(w), len(hit), sum(i is not None for i in items), hashlib.sha256(ids.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"
    bench = [(1, passage), (2, passage + " sigma"), (10, "Short ITEM"), (3, None), (4, "..."), (5, "word"), (1, passage), (6, "a b c d e f g h")]
    docs = BASE + [
        (30, f"before {passage.upper()} after", "en", "a"), (31, passage.replace("eta", "ETA "), "en", "a"), (32, "a short, item here; word", "en", "a"),
        (33, "x " * 400 + passage, "en", "a"), (34, passage[:70], "en", "a"), (35, f"{passage} {passage}", "en", "a"), (35, "other words", "en", "a"),
        (36, "a b c d e f g h i", "en", "b"), (None, passage, "en", "b"),
    ]
    got = decontamination.contamination(documents(spark, docs), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(contaminated(docs, bench), key=str)


@pytest.mark.parametrize("part", [1, 7, 10**6])
def test_decontamination_in_parts(spark, part):
    """Windows looked up in many passes, items that share windows and shingles, and a text of 20,000 words."""
    item = [" ".join(f"v{(k * k + j) % 41}" for k in range(40)) for j in range(3)]
    bench = [(1, item[0]), (2, item[1] + " " + item[0]), (None, item[2]), (3, "a b c a b c a b c a b c a b c a b c"), (4, "v1 v2 v3")]
    long = [f"f{k % 997}" for k in range(20_000)]
    long[5000:5040], long[19_970:] = item[1].split(), item[2].split()[:30]
    docs = [
        (1, " ".join(long), "en", "a"), (2, item[0] + " x", "en", "a"), (3, "a b c " * 50, "en", "a"), (4, item[2], "en", "b"),
        (5, " ".join(item[1].split()[5:17]), "en", "a"), (6, "v1 v2 v3 v1 v2 v3", "en", "a"), (7, None, None, None), (2, item[0] + " x", "en", "a"),
    ]
    df = spark.createDataFrame(bench, "item_id long, text string")
    got = decontamination.row_contamination(documents(spark, docs), df, part=part).drop("print").collect()
    assert sorted(map(tuple, got), key=str) == sorted(contaminated(docs, bench), key=str)


def linked(docs):
    sets = {}
    for d, t, *_ in docs:
        w = (t or "").encode().lower().split()
        sets[d] = set(zip(w, w[1:], w[2:], w[3:], w[4:])) if len(w) >= 5 else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                lo, hi = sorted((top(a), top(b)))
                up[hi] = lo
    return {d: (len(sets[d]), top(d)) for d in sets}


@pytest.mark.parametrize("screened", [minhash.MOST_SCREENED, 0])
def test_near_duplicates(spark, monkeypatch, screened):
    monkeypatch.setattr(minhash, "MOST_SCREENED", screened)
    rng = random.Random(3)
    base = [f"b{k}" for k in range(120)]
    docs = list(BASE)
    for k in range(150):  # a group of near copies of which not all are linked
        w = list(base)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(120)] = f"e{rng.random()}"
        docs.append((100 + k, " ".join(w), "en", "a"))
    docs += [(400 + k, " ".join(f"r{rng.randrange(50)}" for _ in range(rng.randrange(1, 60))), "en", "b") for k in range(60)]
    docs += [(500 + k, "one line that repeats again and " * (2 + k), "en", "b") for k in range(5)]  # equal sets, not texts
    docs += [(520 + k, " ".join(base[:75] + [f"own{k}x{j}" for j in range(45)]), "en", "b") for k in range(40)]  # a shared part
    got = minhash.near_duplicates(documents(spark, docs)).collect()
    want = linked([d for d in docs if d[0] is not None])
    assert len(got) == len(docs)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)


def test_long_chain_is_one_component(spark):
    chain = [(k, k + 1) for k in range(200)] + [(500, 500), (None, 3), (600, 601)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(201)} | {600: 600, 601: 600}


ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(t):
    t = t or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_secrets(spark):
    h = "0123456789abcdef" * 3
    body = "a" * 30
    crc, digits = zlib.crc32(body.encode()), ""
    while crc:
        crc, d = divmod(crc, 62)
        digits = secrets.BASE62[d] + digits
    good = f"ghp_{body}{digits.rjust(6, '0')}"
    texts = [
        f'é token = "{h}" x', "Password:abcdef APIKEY='zz' api_key=secret=token=abcdefgh", "AKIA" + "A" * 16 + " akia" + "A" * 20 + "AKIAAKIA" + "B" * 20,
        "f" * 23 + " " + "f" * 24, "F" * 30 + h[:24] + "g" + h, f"{good} ghp_{'a' * 36} é{good}", "token=abc token=abcdef", "ſecret=abcdefg toKen=abcdefgh",
        "x" * 1000 + h + "é" * 100 + "secret: " + h, None, "",
    ]
    docs = [(k, t, "en", "a") for k, t in enumerate(texts)] + BASE
    got = secrets.secret_digests(documents(spark, docs)).collect()
    want = sorted(((d, hashlib.sha256(base_spans(t).encode()).hexdigest()) for d, t, *_ in docs), key=str)
    assert sorted(((r.doc_id, r.base_sha256) for r in got), key=str) == want
    five = next(r for r in got if r.doc_id == 5)
    assert five.n_checked == 2 and f"signed:{len(good) + 43}:{2 * len(good) + 43}" in five.spans


def part(value):
    return base64.urlsafe_b64encode(json.dumps(value).encode()).decode().rstrip("=")


def pem(raw, name="PRIVATE KEY"):
    body = base64.b64encode(raw).decode()
    return f"-----BEGIN {name}-----\n" + "\n".join(body[k : k + 64] for k in range(0, len(body), 64)) + f"\n-----END {name}-----"


DER = b"\x30\x82\x01\x00" + bytes(range(256))
GOOD = {
    "card": ["4111111111111111", "4111 1111 1111 1111", "5555-5555-5555-4444", "378282246310005", "3782 822463 10005", "6011111111111117", "36227206271667"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "FR14 2004 1010 0505 0001 3M02 606", "nl91abna0417164300"],
    "jwt": [f"{part({'alg': 'HS256'})}.{part({'sub': 'é', 'n': 1})}.c2lnbmF0dXJl"],
    "key": [pem(DER), pem(DER, "RSA PRIVATE KEY"), pem(b"\x30\x03abc", "EC PRIVATE KEY"), pem(b"openssh-key-v1\0rest", "OPENSSH PRIVATE KEY")],
}
NEAR = {
    "card": ["4111111111111112", "4111 1111-1111 1111", "41111111111111111", "x4111111111111111", "4111111111111111y", "9111111111111111", "411111111111111"],
    "iban": ["DE88370400440532013000", "DE8937040044053201300", "DE893704004405320130001", "XX89370400440532013000", "GB82 WEST  1234 5698 7654 32"],
    "jwt": [f"{part({'typ': 'x'})}.{part({'a': 1})}.x", f"{part([1])}.{part({'a': 1})}.x", f"{part({'alg': 'x'})}.eyJub3Q.x", f"x{part({'alg': 'x'})}.{part({})}.x"],
    "key": [pem(DER[:-1]), pem(DER + b"x"), pem(b"text"), pem(DER, "CERTIFICATE"), pem(DER).replace("\n", "\n!", 2), "-----BEGIN PRIVATE KEY-----"],
}


def test_checked_secrets(spark):
    """Planted secrets of each kind are found at their places, near misses of them aren't."""
    docs, want = [], {}
    for good, cases in ((True, GOOD), (False, NEAR)):
        for kind, values in cases.items():
            for v in values:
                before = "é straße IBAN no: " if kind == "iban" else "é straße: "
                want[len(docs)] = [(kind, len(before), len(before) + len(v))] if good else []
                docs.append((len(docs), f"{before}{v} –", "en", "a"))
    docs.append((len(docs), "x".join(["é 4111111111111111"] * 3000) + " " * 9, "en", "a"))
    docs.append((len(docs), "iban" + " " * 50_000 + "-eyJ" * 20_000 + "-----BEGIN PRIVATE KEY-----" * 2000 + "4" * 50_000, "en", "a"))
    got = {r.doc_id: r for r in secrets.secret_digests(documents(spark, docs)).collect()}
    for d, spans in want.items():
        found = [x.rsplit(":", 2) for x in got[d].spans.split(",") if x]
        assert [(k, int(a), int(b)) for k, a, b in found if k not in secrets.BASE_KINDS] == spans, docs[d]
        assert got[d].n_checked == len(spans)
    assert got[len(docs) - 2].n_checked == 1 and got[len(docs) - 1].n_checked == 0
    for r in got.values():
        assert r.base_sha256 == hashlib.sha256(base_spans(docs[r.doc_id][1]).encode()).hexdigest()


def test_planted_secrets_equal_sql(spark, tmp_path):
    def token(body):
        crc, digits = zlib.crc32(body.encode()), ""
        while crc:
            crc, d = divmod(crc, 62)
            digits = secrets.BASE62[d] + digits
        return f"ghp_{body}{digits.rjust(6, '0')}"

    texts = [f"é straße IBAN no: {v} – {v}" for cases in (GOOD, NEAR) for values in cases.values() for v in values]
    texts += [
        f"{token('a' * 30)} x {token('b1C' * 10)}_ {token('Z9' * 15)}x ghp_{'a' * 33}{token('q' * 30)}", None, "",
        "Password:abcdef ſecret=abcdefg APIKEY='zz' api_key=secret=token=abcdefgh", "1234 4111 1111 1111 1111 4111-1111-1111-1111",
        "AKIA" + "A" * 16 + " akia" + "A" * 20 + "AKIAAKIA" + "B" * 20, f"-{GOOD['jwt'][0]} .{GOOD['jwt'][0]}é{GOOD['jwt'][0]}",
    ]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    df = secrets.secret_digests(spark.read.parquet(path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({secrets.ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and sum(r[-1] for r in want) > 20


def license_base(t):
    w, found = plain(t), []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_licenses(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0.", "released under the MIT-License. mit license MIT LICENSE", "CC BY-NC 4.0 and cc.by",
        "GNU General Public License, version 3; gnu general public gnu general public license", "mit licenses, apache", "license mit",
    ]
    docs = [(k, t, "en", "a") for k, t in enumerate(texts)] + BASE
    got = licenses.scan_licenses(documents(spark, docs)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(
        ((d, *license_base(t)) for d, t, *_ in docs), key=str
    )
    labels = {r.doc_id: r.labels for r in got if r.doc_id is not None and r.doc_id < 6 and r.labels}
    assert labels == {0: "apache,apache-2.0", 1: "mit,mit-notice", 2: "cc-by,cc-by-nc-4.0", 3: "gpl,gpl-3.0"}
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)


def license_labels(texts):
    """Labels and scores by plain search: every word of a key phrase, every pair of starts."""
    docs = [plain(t) for t in texts]
    n = Counter(w for d in docs for w in set(d))
    for words in docs:
        labels, score = {x for p, x in licenses.BASE.items() if holds(words, p.split())}, 0.0
        score = 0.5 if labels else 0.0
        for label, (text, keys) in licenses.TEMPLATES.items():
            template, phrases = plain(text), [plain(k) for k in keys]
            idf = {w: math.log((1 + len(docs)) / (1 + n[w])) + 1 for w in [*template, *(w for p in phrases for w in p)]}
            rare = sorted({w for p in phrases for w in p}, key=lambda w: (-idf[w], w.encode()))[: licenses.RARE]
            starts = [(i - j, w) for i, w in enumerate(words) if w in rare for j, x in enumerate(template) if x == w]
            if any(a[1] != b[1] and abs(a[0] - b[0]) <= licenses.SHIFT for a in starts for b in starts) and all(holds(words, p) for p in phrases):
                labels.add(label)
                near = agreed(starts)
                stands = sum(idf[w] for j, w in enumerate(template) if any(0 <= s + j < len(words) and words[s + j] == w for s in near))
                score = max(score, stands / sum(idf[w] for w in template))
        yield ",".join(sorted(labels)), score


def agreed(starts):
    starts, near = sorted((s, w.encode()) for s, w in starts), set()
    for (a, x), (b, y) in zip(starts, starts[1:]):
        if x != y and b - a <= licenses.SHIFT:
            near |= {a, b}
    return near


def holds(words, phrase):
    return any(words[i : i + len(phrase)] == phrase for i in range(len(words) - len(phrase) + 1))


def test_license_templates(spark, tmp_path):
    """Whole texts, texts with words put in, texts that lack a key phrase, and mixtures of pieces, against plain search."""
    rng = random.Random(5)
    filler = " ".join(f"w{k}" for k in range(300))
    texts, full = [], {}
    for label, (text, keys) in licenses.TEMPLATES.items():
        full[len(texts)] = label
        texts.append(f"{filler} Copyright 2020 Someone. {text} {filler}")
        words = text.split()
        half = len(words) // 2
        texts.append(" ".join([*words[:half], *["put in"] * 6, *words[half:]]))
        texts.append(re.sub(keys[0].split()[0], "changed", text, flags=re.I))
    pieces = [" ".join(t.split()[k : k + 15]) for t, _ in licenses.TEMPLATES.values() for k in range(0, len(t.split()), 10)]
    texts += [" ".join(rng.choice([*pieces, filler[:40]]) for _ in range(rng.randrange(1, 60))) for _ in range(60)]
    path = str(tmp_path / "documents.parquet")
    documents(spark, [(k, t, "en", "a") for k, t in enumerate(texts)]).write.parquet(path)
    df = licenses.scan_licenses(spark.read.parquet(path))
    got = {r.doc_id: r for r in df.collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({licenses.ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, got.values())) == sorted(want)
    for k, (labels, score) in enumerate(license_labels(texts)):
        assert got[k].labels == labels and got[k].score == pytest.approx(score, abs=1e-6)
    for k, label in full.items():
        assert label in got[k].labels.split(",") and got[k].score == pytest.approx(1.0)
        assert label not in got[k + 2].labels.split(",")


def test_languages_without_labels(spark):
    docs = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.document_languages(docs).collect()} == {"und"}


def test_languages_edges(spark):
    got = language.document_languages(documents(spark)).collect()
    assert len(got) == len(BASE)
    for r in got:
        text = dict((d, t) for d, t, *_ in BASE if d is not None).get(r.doc_id, "x")
        none = r.doc_id is not None and not any(c.isalpha() for c in text or "")
        assert (r.lang_pred == "und") == none or r.doc_id is None
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_toxicity_folding_and_exceptions():
    lexicon = toxicity.Lexicon(toxicity.base_terms())
    plain_score = lexicon.features("you are an idiot")
    assert plain_score[0] > 0
    assert lexicon.features("you are an 1D10T") == lexicon.features("you are an іdіоt") == plain_score
    assert lexicon.features("put it in the trash can")[0] == 0 < lexicon.features("it is trash")[0]
    assert lexicon.features("")[0] == lexicon.features("idiotic")[0] == 0
    assert lexicon.features("an idiot " + "and more words " * 50)[1] < plain_score[1]


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(0, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    got = toxicity.document_toxicity(documents(spark), labels).collect()
    assert len(got) == len(BASE) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_chat(spark):
    turns = [
        (1, "chosen", 0, "user", "hi"), (1, "chosen", 1, "assistant", "good"), (1, "rejected", 0, "user", "hi"), (1, "rejected", 1, "assistant", "bad"),
        (1, "rejected", 2, "user", "why"), (2, "chosen", 0, "user", "same"), (2, "rejected", 5, "user", "same"), (3, "chosen", 0, None, None),
        (None, "chosen", 0, "user", "x"), (4, None, 0, "user", "x"),
    ]
    df = spark.createDataFrame(turns, "pair_id long, side string, turn long, role string, text string")
    got = {r.pair_id: r for r in chat.preference_pairs(df).collect()}
    assert set(got) == {1, 2, 3}
    one = got[1]
    assert one.n_prompt_turns == 1 and one.prompt == "<|turn|>user\nhi<|end|>\n"
    a, b = map(int, one.chosen_mask.split(":"))
    assert one.chosen[a:b] == "good<|end|>\n"
    a, b = map(int, one.rejected_mask.split(":"))
    assert one.rejected[a:b] == "bad<|end|>\n" and one.rejected.endswith("why<|end|>\n")
    assert (got[2].prompt != "", got[2].chosen, got[2].rejected, got[2].chosen_mask) == (True, "", "", "")
    assert got[3].prompt == "" and got[3].rejected == "" and got[3].chosen == "<|turn|>\n<|end|>\n"


def plain_pairs(turns):
    sides = {}
    for pair, side, turn, role, text in turns:
        if pair is not None and side in ("chosen", "rejected"):
            sides.setdefault(pair, {"chosen": [], "rejected": []})[side].append((turn is not None, turn or 0, role or "", text or ""))
    for pair, both in sides.items():
        a, b = ([(r, t) for *_, r, t in sorted(both[s])] for s in ("chosen", "rejected"))
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        text = [f"<|turn|>{r}\n{t}<|end|>\n" for r, t in a[:n]]
        out = [pair, n, "".join(text)]
        for rest in (a[n:], b[n:]):
            done, spans = "", []
            for r, t in rest:
                start = len(done) + len("<|turn|>") + len(r) + 1
                done += f"<|turn|>{r}\n{t}<|end|>\n"
                if r == "assistant":
                    spans.append(f"{start}:{len(done)}")
            out += [done, ",".join(spans)]
        yield tuple(out)


def test_chat_equals_a_plain_one(spark):
    """Tied turn numbers, repeated rows, null turns, a conversation of 3,000 turns, and columns of our own names."""
    rng = random.Random(11)
    turns = []
    for pair in range(60):
        shared = [(rng.choice([k, k, 3, None]), rng.choice(["user", "assistant", None]), rng.choice(["é", "hi", None, "long " * 9])) for k in range(rng.randrange(6))]
        for side in ("chosen", "rejected"):
            own = [(k + 6, rng.choice(["user", "assistant"]), f"t{rng.randrange(4)}") for k in range(rng.randrange(5))]
            turns += [(pair, side, *t) for t in [*shared, *own, *own[:1]]]
    for side in ("chosen", "rejected"):
        turns += [(1000, side, k, ["user", "assistant"][k % 2], f"turn {k}" if k < 1500 or side == "chosen" else f"other {k}") for k in range(3000)]
    rng.shuffle(turns)
    df = spark.createDataFrame(turns, "pair_id long, side string, turn long, role string, text string")
    df = df.withColumns({n: F.lit("x") for n in ("upto", "chosen", "rejected", "n_prompt_turns", "prompt", "_upto")})
    assert sorted(map(tuple, chat.preference_pairs(df).collect())) == sorted(plain_pairs(turns))


def test_pipeline_stages(spark, tmp_path):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"
    rows = BASE + [(40, f"before {passage} after", "en", "a")]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "sharding":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = Counter(r.doc_id for r in docs.collect())
    assert not {3, 4, 5, 10} & set(kept["language"])
    assert 1 not in kept["near_duplicates"] and 2 not in kept["near_duplicates"] and 0 in kept["near_duplicates"]
    assert 40 in kept["near_duplicates"] and 40 not in kept["decontamination"]
    assert sum(kept["mixing"].values()) == sum(kept["sharding"].values())
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(map(tuple, whole)) == Counter(map(tuple, docs.collect()))
    assert all(lowered(t) is not None for _, t, *_ in rows)


def kept_rows(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_pipeline_drops_rows_not_ids(spark, tmp_path):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [(None, "a clean row that has no id", "en", "a"), (6, "a clean row of a repeated id", "en", "a"), (7, None, "en", "a"), (None, None, "en", "a")]
    dirty = [(None, f"one {passage}", "en", "a"), (6, f"two {passage}", "en", "b")]
    docs = documents(spark, clean + dirty)
    assert kept_rows(corpus_pipeline.without_benchmark(spark, docs, str(tmp_path))) == Counter((d, t) for d, t, *_ in clean)


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    names = ["_id", "_s", "_block", "row", "id", "print", "least", "own", "number", "gone_print", "lang_pred", "score", "_hash", "_row", "_n", "a.b"]
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(1, text, "en", "a"), (2, text + " end", "en", "a"), (2, "other words here", "en", "b"), (None, f"x {passage}", "en", "a"), (None, "no id", "de", "b")]
    docs = documents(spark, rows).withColumns({n: F.lit(f"value of {n}") for n in names})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert all(r[n] == f"value of {n}" for r in docs.collect() for n in names)
    assert {(r.doc_id, r.text) for r in docs.collect()} <= {(1, text), (2, "other words here"), (None, "no id")}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


@pytest.mark.parametrize("most", [50, (1 << 63) - 1])
def test_pipeline_keeps_one_of_each_group_of_rows(spark, most):
    text = " ".join(f"word{k}" for k in range(60))
    near, other, third = text + " end", " ".join(f"else{k}" for k in range(60)), " ".join(f"more{k}" for k in range(60))
    rows = [
        (2, text, "en", "a"), (6, near, "en", "a"), (6, other, "en", "a"), (6, other, "de", "b"), (6, other, "en", "a"), (6, third, "en", "a"),
        (None, text, "en", "a"), (None, third, "en", "c"), (None, "only here", "en", "a"), (None, "only here", "en", "b"), (None, None, "en", "a"),
        (None, None, "en", "a"), (most, "the last id", "en", "a"), (9, "", "en", "a"), (9, "", "en", "a"),
    ]
    got = corpus_pipeline.without_near_copies(spark, documents(spark, rows), "")
    kept = kept_rows(got)
    groups = [
        [(2, text), (6, near), (None, text)], [(6, third), (None, third)], [(6, other)], [(None, "only here")], [(None, None)],
        [(most, "the last id")], [(9, "")],
    ]
    assert [sum(kept[k] for k in g) for g in groups] == [1] * len(groups) and sum(kept.values()) == len(groups)
    assert most > 50 or kept[(2, text)] == 1
    again = corpus_pipeline.without_near_copies(spark, documents(spark, rows[::-1]).repartition(3), "")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, again.collect()))


def test_pipeline_writes_the_mix_in_shards_and_order(spark):
    docs = documents(spark, [(k, "x " * (1 + k * 7 % 50), "en", "abc"[k % 3]) for k in range(900)])
    shards = {}
    for r in mixing.mixed_documents(docs).orderBy("mix_order").collect():
        shards.setdefault(r.mix_shard, []).append(r.doc_id)
    parts = {}
    for r in corpus_pipeline.mixed_to_weights(spark, docs, "").withColumn("part", F.spark_partition_id()).collect():
        parts.setdefault(r.part, []).append(r.doc_id)
    for held in parts.values():
        while held:
            (shard,) = [k for k, ids in shards.items() if held[: len(ids)] == ids]
            held = held[len(shards.pop(shard)) :]
    assert not shards


def test_written_tables_are_deleted(spark):
    from pathlib import Path

    one, two = (common.written(spark.range(5), name) for name in ("one", "two"))
    here = [Path(df.written_path.removeprefix("file://")) for df in (one, two)]
    assert all(p.exists() for p in here) and one.count() == two.count() == 5
    common.discard(one)
    assert [p.exists() for p in here] == [False, True]
    common.sweep(spark)
    assert not here[1].exists() and not here[1].parent.exists()


@pytest.mark.parametrize("limit", [1, 50, 5000])
def test_hash_sample_is_bounded_and_stable(spark, limit):
    df = spark.range(2000).withColumnRenamed("id", "k")
    got = sorted(r.k for r in common.hash_sample(df, "k", 2000, limit, 3).collect())
    assert len(got) == min(limit, 2000)
    assert got == sorted(r.k for r in common.hash_sample(df.repartition(7), "k", 2000, limit, 3).collect())
