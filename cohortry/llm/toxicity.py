"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding maps look-alike letters of other scripts and styled letters (full width, mathematical and the like: whatever
Unicode's compatibility form makes one ASCII letter) to ASCII, lower-cases A-Z, maps digits written for letters, and
turns every other ASCII character into a blank. The lexicon is a short list of insults plus words and word beginnings learned from
labelled rows; a word's weight is the largest of its entries, words inside an exception phrase weigh nothing, and the
sum is set against the length of the text. A logistic curve over the sum and its density gives the score.

It learns from a bounded sample: at most ``PER_CLASS`` labelled ids of either label outside the held-out fold; one half
of them gives the lexicon, the other half the curve, weighted to the true share of labels. Every term that passes the
thresholds is in the lexicon.

Edge cases: a text of any length is scanned whole; a null or empty text scores as one without hits; without labelled rows of both classes the short list and a
fixed curve are used; rows whose label or doc_id is null aren't learned from; an id with both labels counts for each, an
equal label of one id once; of several texts of one id the one of the smallest hash is learned from; repeated rows get
equal scores; other columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import hash_sample, table, written
from cohortry.llm.language import held_out

#: Insults, phrases that are no insult, look-alikes of Latin letters, digits for letters.
INSULTS = (
    "arsehole asshole bastard bitch bonehead buffoon clown cockroach coward creep cretin dimwit disgusting dolt dumb "
    "dumbass dunce fool freak fuck fucking garbage halfwit idiot imbecile jackass jerk lardass leech liar loser lowlife "
    "lunatic maggot moron nitwit numbskull parasite pathetic pig pinhead prick psycho rat retard scum scumbag shit "
    "shithead simpleton slob stupid swine trash twit vermin weasel wimp worthless"
).split()
EXCEPTIONS = (
    "clown fish", "class clown", "circus clown", "trash can", "trash bin", "trash bag", "garbage collection",
    "garbage collector", "garbage can", "garbage truck", "guinea pig", "pig iron", "april fool", "fool s gold",
    "dumb bell", "dumb waiter", "pond scum", "rat race", "lab rat", "pack rat", "cockroach trap", "host parasite",
    "leech therapy", "swine flu", "freak accident", "freak wave", "control freak", "prick test", "worthless check",
)
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "н": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l",
    "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "a", "В": "b", "С": "c", "Е": "e", "Н": "h", "І": "i", "Ј": "j", "К": "k", "М": "m", "О": "o", "Р": "p",
    "Ѕ": "s", "Т": "t", "Х": "x", "У": "y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "a", "Β": "b", "Ε": "e", "Ζ": "z", "Η": "h", "Ι": "i", "Κ": "k", "Μ": "m", "Ν": "n", "Ο": "o", "Ρ": "p",
    "Τ": "t", "Υ": "y", "Χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ո": "n", "օ": "o", "ս": "u",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}

BASE_WEIGHT = 3.0
PER_CLASS = 4000
PREFIXES = range(4, 9)
LEAST_ROWS, LEAST_WEIGHT, LEAST_Z = 8, 0.8, 4.0
#: Score is 1 / (1 + exp(-(a + b log(1 + sum) + c log(1 + 100 density)))) where nothing could be learned.
CURVE = (-3.0, 1.0, 1.0)
THRESHOLD = 0.3

_ASCII = bytes(
    ord(DIGITS[chr(c)]) if chr(c) in DIGITS else c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def styled_letters() -> dict[str, str]:
    """Characters whose compatibility form is one ASCII letter, up to the end of the styled alphabets."""
    forms = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x80, 0x1F200)}
    return {k: v.lower() for k, v in forms.items() if len(v) == 1 and v.isascii() and v.isalpha()}


_LOOKS = styled_letters() | LOOKALIKES


def folded(text: str) -> str:
    """The text in folded bytes, one character for each, between blanks."""
    if not text.isascii():
        for look in _LOOKS.keys() & set(text):
            text = text.replace(look, _LOOKS[look])
    return " " + " ".join(text.encode().translate(_ASCII).decode("latin-1").split()) + " "


class Lexicon:
    """terms: pattern -> weight; a pattern starts with a blank, and ends with one if it is a whole word."""

    def __init__(self, terms: dict[str, float]):
        self.found = ahocorasick.Automaton()
        for t, w in terms.items():
            self.found.add_word(t, (len(t), w))
        for phrase in EXCEPTIONS:
            self.found.add_word(f" {phrase} ", (len(phrase) + 2, None))
        self.found.make_automaton()

    def features(self, text: str) -> tuple[float, float]:
        """log(1 + sum of weights), log(1 + 100 sum / (words + 10))."""
        fold = folded(text)
        by_word: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (n, w) in self.found.iter(fold):
            at = end + 1 - n
            if w is None:
                spared.append((at, end))
            elif w > by_word.get(at, 0.0):
                by_word[at] = w
        for lo, hi in spared:
            for at in [a for a in by_word if lo <= a < hi]:
                del by_word[at]
        total = sum(by_word.values())
        return math.log1p(total), math.log1p(100 * total / (fold.count(" ") - 1 + 10))


def base_terms() -> dict[str, float]:
    return {f" {w} ": BASE_WEIGHT for w in INSULTS}


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Weighted logistic regression by Newton steps with a small ridge."""
    z, b = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (weight * (p - y)) + 0.1 * b
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(3)
        b -= np.linalg.solve(h, g)
    return tuple(float(v) for v in b)


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[dict[str, float], tuple]:
    """(terms, curve) from labelled rows outside the held-out fold."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y")).distinct()
    shares = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        return base_terms(), CURVE
    pick = [hash_sample(known.filter(F.col("_y") == y), "_id", shares[y], per_class, 29) for y in (0, 1)]
    picked = written(pick[0].union(pick[1]), "toxic-sample")
    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")  # one row of an id, however often it repeats
    rows = rows.groupBy("_id", "_y", "_hash").agg(one)
    rows = written(rows.select("text", "_y", (F.col("_hash") % 2 == 0).alias("_words")), "toxic-rows")

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, y in zip(batch.column("text"), batch.column("_y"), strict=True):
                words = set(folded(text.as_py()).split())
                seen = {f" {w} " for w in words if len(w) > 2}
                seen.update(f" {w[:k]}" for w in words for k in PREFIXES if len(w) > k)
                for t in seen:
                    counts.setdefault(t, [0, 0])[y.as_py()] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(counts.keys(), pa.string()), *[pa.array([v[y] for v in counts.values()], pa.int64()) for y in (0, 1)]],
                names=["term", "clean", "toxic"],
            )

    half = rows.filter("_words")
    n = {r["_y"]: r["n"] for r in half.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    a, b = n.get(1, 0) + 1.0, n.get(0, 0) + 1.0
    p, q = (F.col("toxic") + 0.5) / a, (F.col("clean") + 0.5) / b
    mid = (F.col("toxic") + F.col("clean") + 1) / (a + b)
    z = (p - q) / F.sqrt(mid * (1 - F.least(mid, F.lit(0.999))) * (1 / a + 1 / b))
    found = (
        half.mapInArrow(terms_of, "term string, clean long, toxic long")
        .groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .select("term", F.log(p / q).alias("w"), z.alias("z"), "toxic")
        .filter((F.col("toxic") >= LEAST_ROWS) & (F.col("w") >= LEAST_WEIGHT) & (F.col("z") >= LEAST_Z))
        .collect()
    )  # as many rows as terms that stand in LEAST_ROWS of the sample's rows; fmt: skip
    terms = base_terms()
    for r in found:
        terms[r["term"]] = max(terms.get(r["term"], 0.0), float(r["w"]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms)
        for batch in batches:
            x = [lexicon.features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v[k] for v in x], pa.float64()) for k in (0, 1)] + [batch.column("_y").cast(pa.int32())],
                names=["s", "d", "y"],
            )

    x = rows.filter("not _words").select("text", "_y").mapInArrow(measure, "s double, d double, y int").collect()
    y = np.array([r["y"] for r in x], float)
    if not 0 < y.sum() < len(y):
        return terms, CURVE
    share = shares[1] / (shares[0] + shares[1])
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return terms, fit_curve(np.array([[r["s"], r["d"]] for r in x]), y, weight)


def toxicity_scores(docs: DataFrame, terms: dict[str, float], curve: tuple[float, float, float]) -> DataFrame:
    """doc_id and score for each row of ``docs``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms)
        for batch in batches:
            x = np.array([lexicon.features(t.as_py() or "") for t in batch.column("text")]).reshape(-1, 2)
            s = 1 / (1 + np.exp(-np.clip(curve[0] + x @ np.array(curve[1:]), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")


def document_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    scored = toxicity_scores(docs, *fit_toxicity(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op5_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
