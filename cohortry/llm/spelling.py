"""Spelling variants: words that differ by one edit, found by walking a trie of all words with one edit allowed.

The trie is a table of edges (node, letter, the letters that follow), one row for each letter of each different prefix,
and the walk is a table of states (word, position, node, edits). It goes down level by level, in bands of levels that
double, so that a word of thousands of letters takes few rounds. In each round, states without an edit stand at their own
word's nodes and are joined with the edges there, which spends the edit: another letter instead of the word's, or one
more letter. An edge must continue by the word's next ``AHEAD`` letters, so few states are made that die at once. States
with the edit spent go on by their word's letters, and are joined with the trie's nodes at the end of the band: one that
has used up its word at a word's end is a neighbour, others at a node stay for the next round.

A node's number is the polynomial hash of its letters by two primes below 2**31, so that the number of an edited path
follows from its parts by plain arithmetic. Equal numbers of different paths could only add candidates: neighbours are
confirmed letter by letter. One more letter is put in only before a different one, a deletion is an insertion seen from
the other word, and a replacement is looked for from the smaller letter, so each pair is found once.

Edges of a round are broadcast while they are at most ``MOST_EDGES``, as in the first levels, where many words stand at one
node; beyond that they are joined by shuffle, and Spark splits what is skewed.

Edge cases: a null text has no words; a null doc_id counts as the empty string in the checksum; a run left empty by its
deletion is no word; runs of any length are read whole; repeated rows count again; ties of form go to the first word in
code-point order; empty tables give an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import discard, spread, table, written

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A run whose checksum this number divides loses a letter.
DIVISOR = 97
#: Letters after an edit that an edge must share with the word.
AHEAD = 4
#: A form has at least so many times the word's occurrences.
TIMES = 2
#: Edges that are broadcast at most.
MOST_EDGES = 200_000
#: Different words that a task counts before it hands them on.
HELD = 200_000
PRIMES, BASES = ((1 << 31) - 1, (1 << 31) - 19), (1_000_003, 69_069)
#: Letters of the runs in Latin-1, A-Z in lower case; all else is a blank.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: Ends a word in the trie; no letter.
END = "."


def run_counts(docs: DataFrame) -> DataFrame:
    """word, n: runs of letters, some less a letter, of at least ``LEAST_LENGTH``, with their occurrences in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: Counter = Counter()
        wide = _Wide()
        for batch in batches:
            for name, text in zip(batch.column("name"), batch.column("text"), strict=True):
                start = zlib.crc32((name.as_py() + ":").encode())
                runs = (text.as_py() or "").encode("latin-1", "replace").translate(_LETTERS).split()
                # a shorter run is no word, with or without a letter less
                for run, n in Counter([r for r in runs if len(r) >= LEAST_LENGTH]).items():
                    h = zlib.crc32(wide[run], start)
                    if h % DIVISOR == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                    if len(run) >= LEAST_LENGTH:
                        totals[run] += n
                if len(totals) > HELD:
                    yield _rows(totals)
                    totals = Counter()
        yield _rows(totals)

    read = spread(docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("name"), "text"))
    return read.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Wide(dict):
    """Latin-1 bytes to UTF-8 bytes; ASCII stays as it is."""

    def __missing__(self, run: bytes) -> bytes:
        if len(self) > HELD:
            self.clear()
        self[run] = out = run if run.isascii() else run.decode("latin-1").encode()
        return out


def _rows(totals: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([w.decode("latin-1") for w in totals], pa.string()), pa.array(list(totals.values()), pa.int64())], names=["word", "n"]
    )


def _hashed(letters: str, prime: int, base: int) -> list[int]:
    """Hashes of all prefixes, the empty one first."""
    out = [0]
    for c in letters:
        out.append((out[-1] * base + ord(c)) % prime)
    return out


def bands(longest: int) -> list[tuple[int, int]]:
    """Levels 0, 1 to 2, 3 to 6 and so on, until words of ``longest`` letters and their end are walked."""
    out = [(0, 1)]
    while out[-1][1] < longest + 1:
        low, high = out[-1]
        out.append((high, high + 2 * (high - low)))
    return out


def trie_walks(words: DataFrame, longest: int) -> DataFrame:
    """What each word has at each of its positions i, its end included: id (the number of its whole path), the word itself
    at the first one, band, i, letter, node (before the letter), the letters ahead from i (``here``) and from i + 1
    (``next``); and how a state goes on from i + 1 to the end of i's band, or of the word: ``piece`` (hash of these
    letters) and ``power`` (what a hash is multiplied by before it is added); ``over`` if the word ends there. Hashes are
    pairs of numbers, held as one long."""
    cut = bands(longest)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = [1], [1]  # powers of the bases
        for batch in batches:
            rows: list[tuple] = []
            for word in batch.column("word").to_pylist():
                w = word + END
                (one, two), size = (_hashed(w, p, b) for p, b in zip(PRIMES, BASES, strict=True)), len(w)
                while len(first) <= size:
                    first.append(first[-1] * BASES[0] % PRIMES[0])
                    second.append(second[-1] * BASES[1] % PRIMES[1])
                own = one[size] << 31 | two[size]
                for number, (low, high) in enumerate(cut):
                    if low >= size:
                        break
                    end = min(high, size)
                    a, b, over = one[end], two[end], end == size
                    rows += [
                        (own, None if i else word, number, i, ord(w[i]), one[i] << 31 | two[i], w[i : i + AHEAD], w[i + 1 : i + 1 + AHEAD],
                         ((a - one[i + 1] * first[end - i - 1]) % PRIMES[0]) << 31 | (b - two[i + 1] * second[end - i - 1]) % PRIMES[1],
                         first[end - i - 1] << 31 | second[end - i - 1], over)
                        for i in range(low, end)
                    ]
                    if len(rows) > 20_000:
                        yield _table(rows)
                        rows = []
            yield _table(rows)

    return spread(words.select("word")).mapInArrow(walk, ", ".join(f"{f.name} {_KINDS[str(f.type)]}" for f in _WALK))


_WALK = pa.schema([
    ("id", pa.int64()), ("word", pa.string()), ("band", pa.int32()), ("i", pa.int32()), ("letter", pa.int32()), ("node", pa.int64()),
    ("here", pa.string()), ("next", pa.string()), ("piece", pa.int64()), ("power", pa.int64()), ("over", pa.bool_()),
])
_KINDS = {"int64": "long", "int32": "int", "string": "string", "bool": "boolean"}


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_WALK)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _WALK, strict=True)], schema=_WALK)


def _pair(make: Callable[[int, Callable[[Column], Column]], Column]) -> Column:
    """A number from both of its parts: ``make(k, part)`` is part k, where ``part`` takes part k of a held number."""
    high = make(0, lambda x: F.shiftright(x, 31)) % PRIMES[0]
    low = make(1, lambda x: x.bitwiseAND(F.lit((1 << 31) - 1))) % PRIMES[1]
    return F.shiftleft(high, 31).bitwiseOR(low)


def _after(node: Column, piece: Column, power: Column) -> Column:
    """The number of the node reached from ``node`` by the letters of ``piece``."""
    return _pair(lambda k, part: part(node) * part(power) + part(piece))


def neighbours(words: DataFrame) -> DataFrame:
    """Pairs (a, b) of the different ``word`` s that differ by exactly one edit, each pair once."""
    longest = words.agg(F.max(F.length("word"))).first()[0]
    if longest is None:
        return words.select(F.col("word").alias("a"), F.col("word").alias("b"))
    walks = written(trie_walks(words, longest), "trie-walks")
    letter, node, piece, power = (F.col(c) for c in ("letter", "node", "piece", "power"))
    child = _pair(lambda k, part: part(node) * BASES[k] + letter).alias("child")
    steps = walks.filter(letter != ord(END)).select("band", F.xxhash64("node", "next").alias("key"), "letter", child)
    edges = written(steps.distinct(), "trie-edges")
    sizes = {r["band"]: r["n"] for r in edges.groupBy("band").agg(F.count("*").alias("n")).collect()}  # a row for each band
    ends = walks.filter("word is not null").select(F.col("id").alias("stop")).distinct()
    last, found = None, []
    for band, (low, high) in enumerate(bands(longest)):
        own = walks.filter(F.col("band") == band)
        here = edges.filter(F.col("band") == band).select(F.col("key").alias("at"), F.col("letter").alias("other"), "child")
        here = F.broadcast(here) if sizes.get(band, 0) <= MOST_EDGES else here
        # the edit: a larger letter, after which the word goes on behind its own, or one more letter before it
        whole = _pair(lambda k, part: letter * part(power) + part(piece))
        more = _pair(lambda k, part: part(power) * BASES[k])
        kinds = F.explode(F.array(
            F.struct(F.xxhash64("node", "next").alias("key"), letter.alias("above"), F.lit(0).alias("than"), piece.alias("p"), power.alias("q")),
            F.struct(F.xxhash64("node", "here").alias("key"), F.lit(0).alias("above"), letter.alias("than"), whole.alias("p"), more.alias("q")),
        ))
        state = own.select("id", "over", "letter", kinds.alias("x")).select("id", "over", "x.*")
        state = state.filter(F.col("above") != ord(END))
        fits = (F.col("key") == F.col("at")) & (F.col("other") > F.col("above")) & (F.col("other") != F.col("than"))
        moved = state.join(here, fits).select("id", _after(F.col("child"), F.col("p"), F.col("q")).alias("node"), "over")
        if last is not None:  # states with the edit spent go on by their word's letters
            on = own.filter(F.col("i") == low).select(F.col("id").alias("word_id"), whole.alias("p"), more.alias("q"), "over")
            went = last.join(on, F.col("id") == F.col("word_id"))
            moved = moved.union(went.select("id", _after(F.col("node"), F.col("p"), F.col("q")).alias("node"), "over"))
        moved = written(moved, f"trie-frontier-{band}")
        done = moved.filter("over").join(ends, F.col("node") == F.col("stop"))
        found.append(done.select("id", F.col("stop").alias("other_id")))
        # a path of a word's first letters, with one replaced or one more
        nodes = walks.filter(F.col("i").isin(high, high + 1)).select(F.col("node").alias("there")).distinct()
        last = moved.filter("not over").join(nodes, F.col("node") == F.col("there"), "left_semi").select("id", "node")
    names = walks.filter("word is not null").select("id", "word")
    left = names.select("id", F.col("word").alias("a"))
    right = names.select(F.col("id").alias("other_id"), F.col("word").alias("b"))
    pairs = reduce(DataFrame.union, found).distinct().join(left, "id").join(right, "other_id")
    return pairs.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b")  # beyond 1 it is -1


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms that starts at each word with a form. Each step doubles what it skips;
    a chain's counts double at least, so it has no circle and few words."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("via"), F.col("root").alias("further"))
        after = now.join(on, F.col("root") == F.col("via"), "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("went")
        )
        after = written(after, "roots")
        discard(now)
        now = after.select("word", "root")
        now.written_path = after.written_path
        if after.filter("went").isEmpty():
            return now


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the texts."""
    words = written(run_counts(docs).filter(F.col("n") >= LEAST_COUNT), "words")
    pairs = written(neighbours(words), "near-words")
    both = pairs.union(pairs.select("b", "a")).select(F.col("a").alias("of"), F.col("b").alias("near"))
    counts = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = both.join(counts, "near").groupBy("of").agg(F.count("*").alias("n_near"), best)
    enough = -F.col("best.less") >= TIMES * F.col("n")
    known = words.join(near, F.col("word") == F.col("of"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"),
    )
    known = written(known, "forms")
    roots = _roots(known.filter("form is not null")).withColumnRenamed("word", "from")
    out = known.join(roots, F.col("word") == F.col("from"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_trie_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: The checksum is taken byte by byte over the table of 256 remainders. Words are near if one is the other less a letter,
#: or both are equal less a letter at the same place.
ORACLE_SQL = """
WITH RECURSIVE bits AS (SELECT list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c, i FROM range(256) AS t(i)),
remainders AS (SELECT list(c ORDER BY i) AS rem FROM bits),
runs AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r
         FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+')) AS r FROM documents)),
d AS (SELECT r, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS x FROM runs GROUP BY doc_id, r),
h AS (SELECT r, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [('0x' || x[2 * i - 1:2 * i])::BIGINT FOR i IN range(1, length(x) // 2 + 1)]),
                  lambda c, b: xor(c >> 8, rem[(xor(c, b) & 255) + 1]))) AS h FROM d, remainders),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, sum(n)::BIGINT AS n FROM h GROUP BY ALL),
words AS (SELECT word, n FROM w WHERE length(word) >= 5 AND n >= 3),
less AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS l FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT x.word AS a, y.word AS b FROM less x JOIN less y ON x.i = y.i AND x.l = y.l AND x.word <> y.word
         UNION SELECT less.word, words.word FROM less JOIN words ON l = words.word
         UNION SELECT words.word, less.word FROM less JOIN words ON l = words.word),
best AS (SELECT a, count(*) AS n_near, max(n) AS m FROM near JOIN words ON b = word GROUP BY a),
form AS (SELECT best.a AS word, min(b) AS form, any_value(m) AS form_n FROM best JOIN near ON near.a = best.a JOIN words x ON b = x.word AND x.n = m
         JOIN words y ON y.word = best.a WHERE m >= 2 * y.n GROUP BY best.a),
chain AS (SELECT word, word AS root FROM words UNION ALL SELECT chain.word, form.form FROM chain JOIN form ON chain.root = form.word),
ends AS (SELECT word, root FROM chain WHERE root NOT IN (SELECT word FROM form))
SELECT word, form, root, n, coalesce(n_near, 0)::BIGINT AS n_near, form_n::BIGINT AS form_n
FROM words LEFT JOIN best ON a = word LEFT JOIN form USING (word) JOIN ends USING (word)
"""
