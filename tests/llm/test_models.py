"""The two learned operators against plain versions of what they compute."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.llm import common, language, toxicity
from tests.llm.cases import documents


def plain_logits(net, window):
    features = []
    for w, f in net.filters.items():
        for k in range(language.FILTERS):
            features.append(max(sum(float(f[j][window[p + j]][k]) for j in range(w)) for p in range(language.WINDOW - w + 1)))
    h = [max(0.0, x + float(b)) for x, b in zip(features, net.bias, strict=True)]
    return [sum(h[i] * float(net.out[i][c]) for i in range(len(h))) + float(net.out_bias[c]) for c in range(len(net.classes))]


@pytest.fixture(scope="module")
def net():
    net = language.ByteNetwork(["a", "b", "c"], seed=1)
    rng = np.random.default_rng(2)
    net.bias = rng.normal(0, 0.1, net.bias.shape).astype(np.float32)
    net.out_bias = rng.normal(0, 0.1, 3).astype(np.float32)
    return net


def test_logits_are_plain_convolutions(net):
    x = np.random.default_rng(3).integers(0, 256, (4, language.WINDOW)).astype(np.uint8)
    x[1, 40:] = 0
    got = net.reader().logits(x)
    assert np.allclose(got, [plain_logits(net, w) for w in x], atol=1e-4)


def test_predictions_weigh_windows_by_their_bytes(net):
    texts = ["é" * 300, "one window only", "x" * 256, "y" * 257, " ".join(f"w{k}" for k in range(20_000))[: 256 * 9 + 3]]
    raw = [t.encode() for t in texts]
    langs, scores = net.reader().documents(raw)
    for t, lang, score in zip(raw, langs, scores, strict=True):
        cuts = [t[k : k + 256] for k in range(0, len(t), 256)]
        each = [plain_logits(net, list(c) + [0] * (256 - len(c))) for c in cuts]
        mean = [sum(len(c) * e[k] for c, e in zip(cuts, each, strict=True)) / len(t) for k in range(3)]
        p = [math.exp(v) / sum(math.exp(u) for u in mean) for v in mean]
        assert lang == net.classes[p.index(max(p))] and score == pytest.approx(max(p), abs=1e-4)


def test_gradients_are_differences_of_the_loss():
    net = language.ByteNetwork(["a", "b", "c"], seed=4)
    net.filters = {w: f.astype(float) for w, f in net.filters.items()}
    net.bias, net.out, net.out_bias = net.bias.astype(float) + 0.05, net.out.astype(float), net.out_bias.astype(float)
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 256, (3, language.WINDOW)).astype(np.uint8), np.array([0, 2, 1])
    params = [*net.filters.values(), net.bias, net.out, net.out_bias]

    def loss():
        z = np.array([plain_logits(net, w) for w in x])
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(3), y]))

    checked = 0
    for p, g in zip(params, net._gradients(x, y), strict=True):
        for at in np.argwhere(np.abs(g) > 1e-4)[:: max(1, np.count_nonzero(g) // 3)][:3]:
            at = tuple(at)
            old = p[at]
            p[at] = old + 1e-6
            above = loss()
            p[at] = old - 1e-6
            below = loss()
            p[at] = old
            assert (above - below) / 2e-6 == pytest.approx(g[at], rel=1e-3, abs=1e-6)
            checked += 1
    assert checked >= 12


def test_numerals_are_no_letters(spark):
    words = {"en": "the cat sat on the mat with a hat", "de": "der hund lag auf der matte am abend"}
    rows = [(k, words[lang], lang, "a") for k in range(80) for lang in [("en", "de")[k % 2]]]
    odd = [(1000, "½ ² ① Ⅷ 123 _ –"), (1001, "́̀"), (1002, "中"), (1003, "ª"), (1004, "½ a")]
    got = {r.doc_id: r for r in language.document_languages(documents(spark, rows + [(*o, None, "a") for o in odd])).collect()}
    assert [got[k].lang_pred == "und" for k, _ in odd] == [True, True, False, False, False]
    assert all(got[d].lang_pred == lang for d, _, lang, _ in rows)


def test_rare_languages_are_sampled(spark):
    rows = [(k, "text", "en" if k % 50 else "fr", "a") for k in range(3000)]
    df = documents(spark, rows)
    got = common.group_sample(df, "doc_id", "lang", {"en": 2940, "fr": 60}, 50, 3).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in got} == {"en": 50, "fr": 50}
    x, langs = language.training_sample(df, 100)
    assert len(x) == len(langs) and 35 <= langs.count("fr") <= 50 and 40 <= langs.count("en") <= 50
    again = language.training_sample(df.repartition(7), 100)
    assert langs == again[1] and (x == again[0]).all()


def naive_features(terms, text):
    letters = {**toxicity.styled_letters(), **toxicity.LOOKALIKES}
    out = ""
    for c in text:
        c = letters.get(c, c)
        c = toxicity.DIGITS.get(c, c.lower() if "A" <= c <= "Z" else c)
        out += c if not c.isascii() or c.isalpha() else " "
    words, total = [w.encode() for w in out.split(" ") if w], 0.0
    spared = set()
    for phrase in toxicity.EXCEPTIONS:
        p = [w.encode() for w in phrase.split()]
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                spared.update(range(i, i + len(p)))
    for i, w in enumerate(words):
        if i not in spared:
            fits = [v for t, v in terms.items() if (t[1:-1].encode("latin-1") == w if t.endswith(" ") else w.startswith(t[1:].encode("latin-1")))]
            total += max(fits, default=0.0)
    return math.log1p(total), math.log1p(100 * total / (len(words) + 10))


def test_lexicon_equals_a_plain_scan():
    rng = random.Random(7)
    terms = toxicity.base_terms() | {" idio": 1.5, " scumm": 2.0, " trash": 0.5, toxicity.folded("ça"): 4.0, " wor": 1.0}
    lexicon = toxicity.Lexicon(terms)
    back = {v: [k for k, x in (toxicity.LOOKALIKES | toxicity.DIGITS).items() if x == v] for v in "abcdeghiklmoprstuvxyz"}
    styled = {chr(0xFF21 + k): chr(97 + k) for k in range(26)}
    pool = [*toxicity.INSULTS, *(w for p in toxicity.EXCEPTIONS for w in p.split()), *toxicity.EXCEPTIONS, "idiotic", "scummy", "word", "ça", "été", "x-y", "can"]

    def written(word):
        out = ""
        for c in word:
            kinds = [c, c.upper(), *back.get(c, []), *[k for k, v in styled.items() if v == c]]
            out += rng.choice(kinds) if rng.random() < 0.3 else c
        return out

    for n in [0, 1, 2, 5, 30, 30, 300, 20_000]:
        text = "".join(written(rng.choice(pool)) + rng.choice([" ", "  ", "\n", ", ", "-", "! "]) for _ in range(n))
        assert lexicon.features(text) == pytest.approx(naive_features(terms, text))
    assert lexicon.features("ＩＤＩＯＴ")[0] == lexicon.features("ΙDΙΟΤ")[0] == lexicon.features("an idiot")[0] > 0


def test_one_text_of_each_sampled_id(spark):
    """An id that repeats, with equal or different texts and labels, sends one row; every term above the bounds is kept."""
    rows = [(k, f"plain words {k % 7} of no kind", "en", "a") for k in range(300)]
    rows += [(1000 + k, f"you vile{k % 40:02d}zz and nasty{k % 3}qq thing", "en", "a") for k in range(300)]
    rows += [(1001, "you vile01zz and nasty1qq thing", "en", "a")] * 500 + [(2, "another text", "en", "b")] * 500
    labels = [(k, 0) for k in range(300)] + [(1000 + k, 1) for k in range(300)] + [(1001, 1)] * 50 + [(2, 1)]
    df = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = documents(spark, rows)
    terms, curve = toxicity.fit_toxicity(docs, df)
    assert any(t.startswith(" nasty") for t in terms) and curve != toxicity.CURVE
    assert (terms, curve) == toxicity.fit_toxicity(docs.repartition(9), df.repartition(3))
    got = {r.doc_id: r for r in toxicity.document_toxicity(docs.filter(F.col("doc_id") != 2), df).collect()}
    right = [got[d].predicted == int(d >= 1000) for d in got]
    assert sum(right) >= 0.95 * len(right)


def test_curve_is_the_weighted_optimum():
    rng = np.random.default_rng(1)
    x, y, weight = rng.random((200, 2)), (rng.random(200) < 0.4).astype(float), rng.random(200) + 0.5
    b = np.array(toxicity.fit_curve(x, y, weight))

    def loss(b):
        z = b[0] + x @ b[1:]
        return float((weight * (np.log1p(np.exp(z)) - y * z)).sum() + 0.05 * (b * b).sum())

    assert all(loss(b) <= loss(b + d) for k in range(3) for d in (np.eye(3)[k] * 1e-3, -np.eye(3)[k] * 1e-3))
