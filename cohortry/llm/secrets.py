"""Secret scan: Aho-Corasick keyword prefilter, anchored expressions near hits, embedded checksums.

A text is scanned once for keywords in any case; an expression is tried only at the place of its keyword. Long hex
strings have no keyword: a run of 24 characters covers every 24th place, so only these places are probed. What carries a
check of itself is reported only if that holds:

``signed``  tokens of code hosts, whose last six characters are the CRC-32 of the others in base 62
``card``    payment card numbers of a known issuer and length, by Luhn's sum; issuers' first digits are the keywords
``iban``    account numbers after the word IBAN, of their country's length, by the remainder of 97
``jwt``     web tokens whose first two parts are JSON objects, the first with ``alg``
``key``     private keys in PEM whose bytes are as long as their own outer length says, or start as OpenSSH keys do

Offsets are code points, ends exclusive; spans of one kind don't overlap. Edge cases: a text of any length is scanned whole; a null or empty text has no span;
repeated rows each get theirs; an empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import table

#: Base kinds first; spans that start together come in this order.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "card", "iban", "jwt", "key", "signed")
#: Keywords, expressions, least lengths, issuers' first digits with lengths, lengths by country.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
SIGNED_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
SIGNED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})\b", re.ASCII)
ISSUERS = {
    "4": (13, 16, 19), "51": (16,), "52": (16,), "53": (16,), "54": (16,), "55": (16,), "22": (16,), "23": (16,), "24": (16,),
    "25": (16,), "26": (16,), "27": (16,), "34": (15,), "37": (15,), "6011": (16, 19), "64": (16, 19), "65": (16, 19),
    "35": (16, 19), "36": (14,), "38": (14,),
}
_FOUR = "(?:4[0-9]{3}|5[1-5][0-9]{2}|2[2-7][0-9]{2}|3[4-8][0-9]{2}|6011|6[45][0-9]{2})"
_REST = "(?:" + "|".join(
    rf"{b}[0-9]{{4}}{b}[0-9]{{4}}{b}[0-9]{{1,7}}|{b}[0-9]{{6}}{b}[0-9]{{4,5}}" for b in (r"\x20", "-")
) + "|[0-9]{9,15})"
CARD = re.compile(rf"\b{_FOUR}{_REST}\b", re.ASCII)
COUNTRIES = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24,
    "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "RS": 22, "SA": 24, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "TR": 26, "UA": 29,
}
_NUMBERS = "|".join(rf"{c}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for c, n in COUNTRIES.items())
IBAN = re.compile(rf"iban(?:\x20{{0,4}}(?:no|nr|number))?\.?\x20{{0,4}}[:=]?\x20{{0,4}}({_NUMBERS})\b", re.IGNORECASE | re.ASCII)
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
_NAME = "(?:[A-Z0-9]+ )*PRIVATE KEY"
KEY = re.compile(rf"-----BEGIN ({_NAME})-----([A-Za-z0-9+/=\x09-\x0D\x20]*)-----END ({_NAME})-----", re.ASCII)
HEX_RUN = re.compile(r"[0-9a-f]*")
HEX_BYTE = np.array([chr(c) in "0123456789abcdef" for c in range(256)])
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_holds(body: str, check: str) -> bool:
    """The check is the CRC-32 of the body in base 62, six digits long."""
    crc, digits = zlib.crc32(body.encode()), ""
    while crc:
        crc, d = divmod(crc, 62)
        digits = BASE62[d] + digits
    return digits.rjust(6, "0") == check


def card_holds(number: str) -> bool:
    """Luhn's sum of an issuer's number: every second digit from the right counts twice, the digits of it summed."""
    digits = [int(c) for c in number if c.isdigit()]
    lengths = next((n for k in (4, 2, 1) if (n := ISSUERS.get("".join(map(str, digits[:k]))))), ())
    doubled = sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])
    return len(digits) in lengths and (sum(digits[-1::-2]) + doubled) % 10 == 0


def iban_holds(number: str) -> bool:
    """The number with its first four characters last, letters as 10 to 35, leaves 1 when divided by 97."""
    bare = number.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def jwt_holds(head: str, body: str) -> bool:
    try:
        parts = [json.loads(base64.urlsafe_b64decode(p + "=" * (-len(p) % 4))) for p in (head, body)]
    except (ValueError, RecursionError):
        return False
    return all(isinstance(p, dict) for p in parts) and "alg" in parts[0]


def key_holds(body: str) -> bool:
    bare = "".join(body.split())
    try:
        raw = base64.b64decode(bare, validate=True)
    except binascii.Error:
        return False
    if raw.startswith(b"openssh-key-v1\0"):
        return True
    if len(raw) < 2 or raw[0] != 0x30:
        return False
    n = raw[1] & 0x7F if raw[1] & 0x80 else 0  # bytes that hold the length, else it is the byte itself
    length = int.from_bytes(raw[2 : 2 + n]) if n else raw[1]
    return n <= 4 and len(raw) == 2 + n + length


#: Kind -> its keywords in lower case, its expression, the group that is the span, and the check.
SCANS: dict[str, tuple[tuple[str, ...], re.Pattern, int, Callable[[re.Match], bool]]] = {
    "assign": (ASSIGN_WORDS, ASSIGN, 0, lambda m: len(m[2]) >= LEAST_VALUE),
    "access": (("akia",), ACCESS, 0, lambda m: len(m[0]) >= LEAST_ACCESS),
    "card": (tuple(ISSUERS), CARD, 0, lambda m: card_holds(m[0])),
    "iban": (("iban",), IBAN, 1, lambda m: iban_holds(m[1])),
    "jwt": (("eyj",), JWT, 0, lambda m: jwt_holds(m[1], m[2])),
    "key": (("-----begin ",), KEY, 0, lambda m: m[1] == m[3] and key_holds(m[2])),
    "signed": (SIGNED_WORDS, SIGNED, 0, lambda m: crc_holds(m[1], m[2])),
}
#: Characters that a web token doesn't start after, so that parts of longer runs aren't tried.
TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_")


def keyword_automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, (words, *_) in SCANS.items():
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def byte_spans(raw: bytes, keywords: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) in bytes, sorted. One character stands for each byte, as all patterns are ASCII."""
    text, spans = raw.decode("latin-1"), []
    after = dict.fromkeys(KINDS, 0)
    hits = sorted((end + 1 - n, kind) for end, (kind, n) in keywords.iter(raw.lower().decode("latin-1")))
    for at, kind in hits:
        if at < after[kind] or (at and kind == "jwt" and text[at - 1] in TOKEN):
            continue
        _, pattern, group, holds = SCANS[kind]
        m = pattern.match(text, at)
        if not m:
            continue
        after[kind] = m.end()
        if holds(m):
            spans.append((m.start(group), KINDS.index(kind), m.end(group)))
    end = 0
    probes = np.flatnonzero(HEX_BYTE[np.frombuffer(raw, np.uint8)[LEAST_HEX - 1 :: LEAST_HEX]])
    for at in (probes * LEAST_HEX + LEAST_HEX - 1).tolist():
        if at < end:
            continue
        start = at
        while start > end and HEX_BYTE[raw[start - 1]]:
            start -= 1
        end = HEX_RUN.match(text, at).end()
        if end - start >= LEAST_HEX:
            spans.append((start, KINDS.index("hex"), end))
    return sorted(spans)


def code_points(raw: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) with byte offsets turned into code points."""
    if not spans or raw.isascii():
        return [(KINDS[k], a, b) for a, k, b in spans]
    more = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80)])
    return [(KINDS[k], int(a - more[a]), int(b - more[b])) for a, k, b in spans]


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and found: array of (kind, start, end), for each row of ``docs``."""
    schema = "doc_id long, found array<struct<kind: string, start: long, end: long>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = keyword_automaton()
        for batch in batches:
            found = []
            for text in batch.column("text"):
                raw = (text.as_py() or "").encode()
                found.append(
                    [{"kind": k, "start": a, "end": b} for k, a, b in code_points(raw, byte_spans(raw, keywords))]
                )
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, schema)


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, and the number of checked spans for each row of ``docs``."""
    found = find_secrets(docs)

    def count(*kinds: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"].isin(*kinds))).cast("long")

    def joined(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))

    base = F.filter("found", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"), count(*KINDS[len(BASE_KINDS) :]).alias("n_checked"),
    )


def op10_keyword_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digests(table(spark, sf_dir, "documents"))


def _either(pattern: str) -> str:
    """The expression with each letter in either case, letters of classes and escapes left out."""
    return re.sub(r"\\x[0-9A-F]{2}|\\.|\[[^]]*\]|[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]" if m[0].isalpha() else m[0], pattern)


def _found(kind: str, pattern: str, group: int = 0) -> str:
    """SQL: doc_id, kind, g (the group, which ends where the match ends) and its start, for each match in a text."""
    p = pattern.replace("'", "''")
    before = "coalesce(list_sum([length(x) FOR x IN b[1:k]]), 0) + coalesce(list_sum([length(x) FOR x IN m[1:k]]), 0)"
    return f"""SELECT doc_id, '{kind}' AS kind, g[k] AS g, ({before} - length(g[k]))::BIGINT AS start
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS g,
          regexp_split_to_array(text, '{p}') AS b FROM docs WHERE regexp_matches(text, '{p}')))"""


def _crc(text: str) -> str:
    """SQL: CRC-32 of an ASCII text, bit by bit."""
    byte = "xor(c, x)"
    for _ in range(8):
        byte = f"list_transform([{byte}], lambda b: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END)[1]"
    values = f"[ascii(x)::BIGINT FOR x IN string_split({text}, '')]"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {values}), lambda c, x: {byte}))"


_SPACES, _TOKEN, _NUMBER = r"\x09-\x0D\x20", "[A-Za-z0-9_-]", _NUMBERS.replace("[A-Z0-9]", "[A-Za-z0-9]")
_NUMBER = re.sub("[A-Z]{2}(?=\\[)", lambda m: "".join(f"[{c}{c.lower()}]" for c in m[0]), _NUMBER)
_WORDS = _either("(?:password|passwd|secret|token|api_?key)")
_VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_BASE64 = "from_base64(translate({0}, '-_', '+/') || repeat('=', (4 - length({0}) % 4) % 4))"
_OBJECT = f"CASE WHEN json_valid(try(decode({_BASE64}))) THEN json_type(decode({_BASE64})) = 'OBJECT' ELSE false END"
_PARTS = "string_split(g, '.')"
_ISSUERS = ", ".join(f"('{k}', {list(v)})" for k, v in ISSUERS.items())
_LETTERS = "[CASE WHEN x BETWEEN '0' AND '9' THEN x::BIGINT ELSE ascii(x) - 55 END FOR x IN string_split(n[5:] || n[1:4], '')]"
_KEY_PATTERN = f"-----BEGIN ({_NAME})-----([A-Za-z0-9+/={_SPACES}]*)-----END ({_NAME})-----"
#: Each kind's expression over the whole text, then its check. Places come from the lengths of what stands between.
ORACLE_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
issuers(digits, lengths) AS (VALUES {_ISSUERS}),
assign AS ({_found("assign", _WORDS + _VALUE)}),
access AS ({_found("access", "AKIA[A-Z0-9]+")}),
hexes AS ({_found("hex", "[0-9a-f]{24,}")}),
cards AS (SELECT *, regexp_replace(g, '[^0-9]', '', 'g') AS n FROM ({_found("card", CARD.pattern)})),
ibans AS (SELECT *, upper(replace(g, ' ', '')) AS n FROM ({_found("iban", _either("iban(?:{S}(?:no|nr|number))?").replace("{S}", chr(92) + "x20{0,4}") + f"[.]?{chr(92)}x20{{0,4}}[:=]?{chr(92)}x20{{0,4}}({_NUMBER}){chr(92)}b", 1)})),
tokens AS ({_found("jwt", f"(?:^|[^A-Za-z0-9_-])(eyJ{_TOKEN}+[.]eyJ{_TOKEN}+[.]{_TOKEN}+)", 1)}),
pems AS (SELECT *, try(hex(from_base64(regexp_replace(regexp_extract(g, '{_KEY_PATTERN}', 2), '[{_SPACES}]+', '', 'g')))) AS h
         FROM ({_found("key", _KEY_PATTERN)}) WHERE regexp_extract(g, '{_KEY_PATTERN}', 1) = regexp_extract(g, '{_KEY_PATTERN}', 3)),
lengths AS (SELECT *, ('0x' || h[3:4])::BIGINT AS b, CASE WHEN ('0x' || h[3:4])::BIGINT > 127 THEN ('0x' || h[3:4])::BIGINT - 128 ELSE 0 END AS n FROM pems WHERE length(h) >= 4),
signs AS (SELECT *, g[5:34] AS body, g[35:40] AS tail FROM ({_found("signed", f"(?:gh[pousr]|npm)_[A-Za-z0-9]{{36}}{chr(92)}b")})),
sums AS (SELECT *, {_crc("body")} AS c FROM signs),
found AS (
    SELECT doc_id, kind, g, start FROM assign WHERE length(regexp_extract(g, '{(_WORDS + _VALUE).replace("'", "''")}', 1)) >= {LEAST_VALUE}
    UNION ALL SELECT doc_id, kind, g, start FROM access WHERE length(g) >= {LEAST_ACCESS}
    UNION ALL SELECT doc_id, kind, g, start FROM hexes
    UNION ALL SELECT doc_id, kind, g, start FROM cards JOIN issuers ON starts_with(n, digits) AND list_contains(lengths, length(n))
        WHERE list_sum([CASE WHEN k % 2 = 0 THEN n[length(n) - k]::BIGINT ELSE 2 * n[length(n) - k]::BIGINT // 10 + 2 * n[length(n) - k]::BIGINT % 10 END FOR k IN range(0, length(n))]) % 10 = 0
    UNION ALL SELECT doc_id, kind, g, start FROM ibans
        WHERE list_reduce(list_prepend(0::BIGINT, {_LETTERS}), lambda r, x: (r * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1
    UNION ALL SELECT doc_id, kind, g, start FROM tokens WHERE {_OBJECT.format(_PARTS + "[2]")}
        AND CASE WHEN {_OBJECT.format(_PARTS + "[1]")} THEN list_contains(json_keys(decode({_BASE64.format(_PARTS + "[1]")})), 'alg') ELSE false END
    UNION ALL SELECT doc_id, kind, g, start FROM pems WHERE starts_with(h, '{b"openssh-key-v1".hex().upper()}00')
    UNION ALL SELECT doc_id, kind, g, start FROM lengths WHERE starts_with(h, '30') AND n <= 4 AND length(h) >= 4 + 2 * n
        AND length(h) // 2 = 2 + n + CASE WHEN n = 0 THEN b ELSE ('0x' || h[5:4 + 2 * n])::BIGINT END
    UNION ALL SELECT doc_id, kind, g, start FROM sums WHERE tail = {" || ".join(f"'{BASE62}'[(c // {62**k}) % 62 + 1]" for k in range(5, -1, -1))}),
spans AS (SELECT doc_id, kind, list_position({list(KINDS)}, kind) AS k, start, kind || ':' || start || ':' || (start + length(g)) AS span FROM found),
byid AS (SELECT doc_id, count(*) FILTER (k = 1) AS n_assign, count(*) FILTER (k = 2) AS n_access, count(*) FILTER (k = 3) AS n_hex, count(*) FILTER (k > 3) AS n_checked,
                string_agg(span, ',' ORDER BY start, k) FILTER (k <= 3) AS base, string_agg(span, ',' ORDER BY start, k) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_checked, 0) AS n_checked FROM docs LEFT JOIN byid USING (doc_id)
"""
