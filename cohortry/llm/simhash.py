"""Near-duplicates by SimHash: fingerprints of 64 bits that differ in two places at most are linked.

A fingerprint is cut into two segments of 32 bits, so that of two linked fingerprints one segment differs by at most one
bit. Each segment is indexed under its 32 one-wildcard variants (one bit left out), and fingerprints that share a variant
are candidates, whose distance is then verified. Work is done on different fingerprints only, whatever the number of
their documents:

- a variant of two fingerprints is a pair as it stands;
- the members of a variant of up to ``MANY`` fingerprints are paired by an equality join;
- fingerprints in a larger variant are each put under themselves and their 64 neighbours at one bit. Two differ in two
  places at most if and only if they have such a point in common, and a point has 65 members at most, so a group of any
  size costs 65 rows a fingerprint and loses no link.

Links make components; a component's id is the smallest doc_id of its documents.

Edge cases: a null text, or one without words, has fingerprint zero and is linked like any other; a text of one or two
words is one shingle; a text of any length is hashed in pieces of ``PIECE`` shingles; rows with a null doc_id take part,
and their component_id is null only where no linked row has an id; repeated rows and ties are copies of one
fingerprint; an empty table gives an empty table. Only doc_id and text are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import counted, spread, table, written
from cohortry.llm.graph import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: Shingles that are hashed at a time.
PIECE = 65_536
#: Shared variants that are broadcast at most (16 bytes each); more are joined by shuffle.
MOST_SHARED = 1_000_000
#: Fingerprints of a variant that are paired by a join at most.
MANY = 8


def bit_counts(words: list[bytes]) -> tuple[np.ndarray, int]:
    """How many shingles have each of the 64 bits set, and the number of shingles, repeats included."""
    counts = np.zeros(64, np.int64)
    if not words:
        return counts, 0
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    shingles = map(b" ".join, zip(*[islice(words, j, None) for j in range(size)], strict=False))
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    for lo in range(0, n, PIECE):
        some = min(PIECE, n - lo)
        h = np.fromiter(islice(hashes, some), np.uint64, some)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return counts, n


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the 64 bits of the fingerprint as a long, for each row."""
    powers = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for k, text in enumerate(batch.column("text")):
                counts, n = bit_counts((text.as_py() or "").encode().lower().split())
                out[k] = powers[2 * counts > n].sum(dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], names=["doc_id", "bits"])

    read = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return read.mapInArrow(sign, "doc_id long, bits long")


def segment_variants(prints: DataFrame) -> DataFrame:
    """bits and its 64 variants: a long of segment, wildcard and the segment without the wildcard's bit."""
    place = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("place")
    whole = F.when(F.col("place") < 32, F.col("bits").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("bits", 32))
    without = F.expr("~shiftleft(1L, place % 32)")
    variant = F.shiftleft(F.col("place").cast("long"), 32).bitwiseOR(whole.bitwiseAND(without))
    return prints.select("bits", place).select("bits", variant.alias("variant"))


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= DISTANCE


def links(prints: DataFrame, many: int = MANY) -> DataFrame:
    """Links (a, b) that connect all of the different fingerprints ``bits`` that differ in ``DISTANCE`` places at most."""
    index = segment_variants(prints)
    sums = index.groupBy("variant").agg(F.count("*").alias("n"), F.min("bits").alias("a"), F.max("bits").alias("b"))
    shared, n_shared = counted(sums.filter("n > 1"), "sim-shared")
    twos = shared.filter("n = 2").select("a", "b")
    large = shared.filter("n > 2").select("variant", "n")
    large = F.broadcast(large) if n_shared <= MOST_SHARED else large
    members = written(index.join(large, "variant"), "sim-members")

    few = members.filter(F.col("n") <= many).select("variant", "bits")
    x, y = few.withColumnRenamed("bits", "a"), few.select(F.col("variant").alias("other"), F.col("bits").alias("b"))
    pairs = x.join(y, (F.col("variant") == F.col("other")) & (F.col("a") < F.col("b"))).select("a", "b")

    rest = members.filter(F.col("n") > many).select("bits").distinct()
    place = F.explode(F.sequence(F.lit(0), F.lit(64))).alias("place")
    point = F.expr("CASE WHEN place = 64 THEN bits ELSE bits ^ shiftleft(1L, place) END")
    points = rest.select("bits", place).groupBy(point.alias("point")).agg(F.sort_array(F.collect_set("bits")).alias("near"))
    tied = points.filter(F.size("near") > 1).select(
        F.col("near")[0].alias("a"), F.explode(F.slice("near", 2, 64)).alias("b")
    )
    return twos.union(pairs).union(tied).filter(_near("a", "b")).distinct()


def similar(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    signed = written(fingerprints(docs), "sim-signed")
    classes = written(signed.groupBy("bits").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies")), "sim-classes")
    groups = written(components(links(classes.select("bits"))), "sim-groups")
    known = classes.join(groups, F.col("bits") == F.col("node"), "left")
    known = known.withColumn("own", F.coalesce("component", "bits"))
    ids = known.filter("node is not null").groupBy("own").agg(F.min("doc").alias("least")).withColumnRenamed("own", "of")
    moved = (
        known.join(ids, F.col("own") == F.col("of"), "left")
        .filter("copies > 1 or node is not null")
        .select(F.col("bits").alias("mine"), F.coalesce("least", "doc").alias("to"))
    )
    out = signed.join(moved, F.col("bits") == F.col("mine"), "left")
    digits = F.lower(F.lpad(F.hex("bits"), 16, "0"))
    return out.select("doc_id", digits.alias("fingerprint"), F.coalesce("to", "doc_id").alias("component_id"))


def op11_deletion_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))


#: XXH64's constants.
_P = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
_ALL = "18446744073709551616::UHUGEINT"


def _mul(x: str, y: str | int) -> str:
    return f"((({x})::UHUGEINT * ({y})::UHUGEINT) % {_ALL})::UBIGINT"


def _add(*terms: str | int) -> str:
    return f"(({' + '.join(f'({t})::UHUGEINT' for t in terms)}) % {_ALL})::UBIGINT"


def _let(x: str, name: str, body: str) -> str:
    return f"list_transform([{x}], lambda {name}: {body})[1]"


def _turned(x: str, by: int) -> str:
    return _let(x, "t", f"(((t::UHUGEINT * {1 << by}) % {_ALL}) + t // {1 << (64 - by)})::UBIGINT")


def _round(acc: str, lane: str) -> str:
    return _mul(_turned(_add(acc, _mul(lane, _P[1])), 31), _P[0])


def _little(at: str, n: int) -> str:
    """The number in n bytes from byte ``at`` of the hexadecimal text x, the last byte first."""
    return "('0x' || " + " || ".join(f"x[2 * ({at}) + {2 * k + 1}:2 * ({at}) + {2 * k + 2}]" for k in reversed(range(n))) + ")::UBIGINT"


def _stripes(start: int, at: int) -> str:
    lanes = f"[{_little(f'32 * s + {8 * at}', 8)} FOR s IN range(n // 32)]"
    return f"list_reduce(list_prepend({start % (1 << 64)}::UBIGINT, {lanes}), lambda a, l: {_round('a', 'l')})"


def _mixed(h: str, shift: int, by: int | None) -> str:
    out = _let(h, "m", f"xor(m, m >> {shift})")
    return _mul(out, by) if by else out


def _merged() -> str:
    h = _add(*[_turned(f"v{k}", by) for k, by in zip("1234", (1, 7, 12, 18), strict=True)])
    for k in "1234":
        h = _add(_mul(f"xor({h}, {_round('0', f'v{k}')})", _P[0]), _P[3])
    return h


_BITS = ", ".join(f"sum((h >> {b}) & 1)::BIGINT AS b{b}" for b in range(64))
_VALUE = " + ".join(f"(2 * coalesce(b{b}, 0) > n)::UHUGEINT * {1 << b}" for b in range(64))
#: The hash is written out by its definition: four lanes for each 32 bytes, then the rest by 8, 4 and 1 bytes.
ORACLE_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
x AS (SELECT g, hex(encode(g)) AS x, length(hex(encode(g))) // 2 AS n FROM (SELECT DISTINCT g FROM s)),
v AS (SELECT *, {", ".join(f"{_stripes(start, k)} AS v{k + 1}" for k, start in enumerate((SEED + _P[0] + _P[1], SEED + _P[1], SEED, SEED - _P[0])))} FROM x),
h1 AS (SELECT g, x, n, {_add(f"CASE WHEN n >= 32 THEN {_merged()} ELSE {SEED + _P[4]} END", "n")} AS h FROM v),
h2 AS (SELECT g, x, n, list_reduce(list_prepend(h, [{_little('32 * (n // 32) + 8 * j', 8)} FOR j IN range((n % 32) // 8)]),
       lambda h, l: {_add(_mul(_turned(f"xor(h, {_round('0', 'l')})", 27), _P[0]), _P[3])}) AS h FROM h1),
h3 AS (SELECT g, x, n, CASE WHEN n % 8 >= 4 THEN {_add(_mul(_turned(f"xor(h, {_mul(_little('8 * (n // 8)', 4), _P[0])})", 23), _P[1]), _P[2])} ELSE h END AS h FROM h2),
h4 AS (SELECT g, list_reduce(list_prepend(h, [{_little('4 * (n // 4) + j', 1)} FOR j IN range(n % 4)]),
       lambda h, l: {_mul(_turned(f"xor(h, {_mul('l', _P[4])})", 11), _P[0])}) AS h FROM h3),
h5 AS (SELECT g, {_mixed(_mixed(_mixed("h", 33, _P[1]), 29, _P[2]), 32, None)} AS h FROM h4),
b AS (SELECT doc_id, count(*) AS n, {_BITS} FROM s JOIN h5 USING (g) GROUP BY doc_id),
f AS (SELECT w.doc_id, coalesce(({_VALUE})::UBIGINT, 0::UBIGINT) AS f FROM w LEFT JOIN b USING (doc_id)),
c AS (SELECT f, min(doc_id) AS doc FROM f GROUP BY f),
e AS (SELECT p.doc AS a, q.doc AS b FROM c p JOIN c q ON p.f <> q.f AND bit_count(xor(p.f, q.f)::HUGEINT) <= 2),
r(a, b) AS (SELECT doc, doc FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT f.doc_id, lpad(lower(hex(f.f)), 16, '0') AS fingerprint, component_id FROM f JOIN c USING (f) JOIN m ON a = c.doc
"""
