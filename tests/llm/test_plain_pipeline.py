"""The mix and the pipeline's stages against plain Python on small tables."""

import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from cohortry.llm import language, mixing
from tests.llm.cases import documents, spaced
from tests.llm.test_models import plain_logits
from tests.llm.test_small_tables import contaminated, linked, targets


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def hashed(*values):
    """Spark's xxhash64 of the columns: nulls are skipped; np.int32 stands for int, int for long."""
    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else struct.pack("<i" if isinstance(v, np.int32) else "<q", v)
            h = xxhash.xxh64(raw, seed=h).intdigest()
    return signed(h)


def plain_mix(rows, shards=16, seed=11):
    """(doc_id, text, source) -> sorted list of (pass, shard)."""
    size, unit = {r: len(spaced(r[1])) for r in rows}, {r: hashed(r[0], r[1]) for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += size[r]
    want, plan, quotas = targets(dict(sizes)), {}, {}
    for s in sorted(sizes, key=lambda s: (s is None, s or "")):
        n = max(1, min(mixing.MAX_BLOCKS, -(-sizes[s] // mixing.BLOCK_WORDS)))
        blocks = defaultdict(list)
        for r in rows:
            if r[2] == s:
                blocks[hashed(np.int32(seed), unit[r]) % n].append(r)
        ranked = sorted(blocks, key=lambda b: (hashed(np.int32(seed + 1), s, np.int32(b)), b))
        passes = int(want[s] // sizes[s]) if sizes[s] else 0
        rest, done, whole = want[s] - passes * sizes[s], 0, 0
        for b in ranked:
            words = sum(size[r] for r in blocks[b])
            if not (rest > 0 and done + words <= rest):
                break
            done, whole = done + words, whole + 1
        left = rest - done
        part = left > 0 and whole < len(ranked)
        quotas[s] = passes * len(ranked) + whole + part
        plan[s] = (blocks, ranked, passes, whole, left, part)
    counts = mixing.split_tree(list(quotas.values()), shards, seed)
    out = {r: [] for r in rows}
    for k, (s, (blocks, ranked, passes, whole, left, part)) in enumerate(plan.items()):
        shard_of = [shard for shard in range(shards) for _ in range(counts[shard][k])]
        for draw, shard in enumerate(shard_of):
            at = (draw // len(ranked), shard)
            if part and draw == passes * len(ranked) + whole:
                near = [(rank, b) for rank, b in enumerate(ranked) if whole <= rank <= whole + mixing.SPREAD]
                units = Counter()
                for rank, b in near:
                    for r in blocks[b]:
                        units[(rank, hashed(np.int32(seed + 2), unit[r]), unit[r])] += size[r]
                order = sorted(units)
                takes = mixing.filled(np.array([units[u] for u in order]), left)
                taken = {u[2] for u, t in zip(order, takes, strict=True) if t}
                for _, b in near:
                    for r in blocks[b]:
                        if unit[r] in taken:
                            out[r].append(at)
            else:
                for r in blocks[ranked[draw % len(ranked)]]:
                    out[r].append(at)
    return {r: sorted(v) for r, v in out.items()}


@pytest.mark.parametrize("words", [50_000, 300, 40])
def test_mix_equals_a_plain_one(spark, monkeypatch, words):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", words)
    rows = [(k if k % 3 else None, " ".join(f"w{k}x{j}" for j in range(k * 7 % 60)), ["a", "b", None, "d", "e"][k * k % 5]) for k in range(400)]
    rows += [(9, "same row", "b")] * 3 + [(11, None, "a"), (None, "", None), (12, "z " * 500, "d")]
    docs = documents(spark, [(d, t, "en", s) for d, t, s in rows])
    copies = Counter(rows)
    got = Counter((r.doc_id, r.text, r.source, r.mix_shard) for r in mixing.mixed_documents(docs).collect())
    want = Counter()
    for (d, t, s), draws in plain_mix(rows).items():
        for _, shard in draws:
            want[(d, t, s, shard)] += 1
    # plain_mix meets an equal row once for each copy already, as its blocks hold all rows
    assert got == want and max(copies.values()) >= 3


def test_stages_equal_plain_ones(spark, tmp_path):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"
    base = [f"word{k}" for k in range(60)]
    texts = [" ".join([*base[:k], f"new{k}", *base[k + 1 :]]) for k in range(0, 60, 6)] + [" ".join(base)] * 3
    texts += [f"{passage} and its rest {k}" for k in range(4)] + ["½ ① 12", "", None, "one", "One", "…"]
    texts += [" ".join(f"u{k}v{j}" for j in range(5 + k)) for k in range(25)] + [f"long {'w ' * 400}{passage}"]
    rows = [(100 + 3 * k, t, ["en", "de"][k % 2], "abc"[k % 3]) for k, t in enumerate(texts)]
    rows += [(100, texts[0], "en", "a"), (None, texts[30], "de", "b"), (None, "without an id", "en", "a")]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    net = language.fit_network(docs)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()

    def told(text):
        if not any(map(str.isalpha, text or "")):
            return False
        raw = text.lower().encode()
        cuts = [raw[k : k + 256] for k in range(0, len(raw), 256)]
        z = sum(len(c) * np.array(plain_logits(net, list(c) + [0] * (256 - len(c)))) for c in cuts) / len(raw)
        return np.exp(z - z.max()).max() / np.exp(z - z.max()).sum() >= corpus_pipeline.LEAST_SCORE

    known = {t: told(t) for _, t, *_ in rows}
    now = Counter((d, t) for d, t, *_ in rows if known[t])
    assert Counter((r.doc_id, r.text) for r in kept["language"]) == now

    numbers = {key: key[0] if key[0] is not None else 10**6 + k for k, key in enumerate(now)}
    groups = linked([(n, key[1]) for key, n in numbers.items()])
    now = Counter(key for key, n in numbers.items() if groups[n][1] == n)
    got = Counter((r.doc_id, r.text) for r in kept["near_duplicates"])
    assert got == now

    bad = {(d, t) for (d, t) in now for *_, dirty in contaminated([(d, t)], [(1, passage)]) if dirty}
    now = Counter(key for key in now if key not in bad)
    assert bad and Counter((r.doc_id, r.text) for r in kept["decontamination"]) == now

    source = {(d, t): s for d, t, _, s in rows}
    mix = plain_mix([(d, t, source[(d, t)]) for d, t in now])
    now = Counter({(d, t): len(draws) for (d, t, _), draws in mix.items() if draws})
    assert Counter((r.doc_id, r.text) for r in kept["mixing"]) == now

    out = kept["sharding"]
    assert Counter((r.doc_id, r.size) for r in out) == sum((Counter({(d, len(t.encode()) + 16): n}) for (d, t), n in now.items()), Counter())
    assert sorted(r.slot * 40 + r.shard for r in out) == list(range(sum(now.values())))
