"""License scan by a positional rare-token index.

Templates are the public texts or notices of common licences, each with key phrases that must stand in the file. A
template is indexed under the places of its ``RARE`` rarest words alone, those of its key phrases that have the highest
inverse document frequency over the whole corpus; more common words have no postings. A file's words that have postings
are looked up from the highest IDF down, and each posting says where the template would start. A template is a
candidate where two of its rare words put its start within ``SHIFT`` words of each other (relative position); then its
key phrases are looked for, word by word. Its score is the part of its words, by IDF, that stand where one of the
agreeing starts puts them (six digits), so a template with words put in between is still met in pieces.

Base phrases are indexed under their rarest word in the same way and compared at each of its places, so all of their
places are found.

Edge cases: a null or empty text has no words and no labels; a text of any length is scanned whole; overlapping places all count; repeated rows each get
their result; an empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import PLAIN_BYTES, table
from cohortry.llm.license_texts import BASE, TEMPLATES

#: Words that a template is indexed under, starts that count as agreeing, and the score of a base label alone.
RARE, SHIFT, BASE_SCORE = 4, 8, 0.5


def plain_words(text: str) -> list[bytes]:
    """Words of ASCII letters, digits and non-ASCII code points, A-Z in lower case."""
    return text.encode().translate(PLAIN_BYTES).split()


def licence_words() -> list[bytes]:
    texts = [*BASE, *(t for text, keys in TEMPLATES.values() for t in (text, *keys))]
    return sorted({w for t in texts for w in plain_words(t)})


def document_frequencies(docs: DataFrame) -> tuple[dict[bytes, int], int]:
    """In how many of all documents each licence word stands, and the number of documents; a fixed list of words."""
    vocabulary = set(licence_words())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: dict[bytes, int] = dict.fromkeys(vocabulary, 0)
            for text in batch.column("text"):
                for w in vocabulary.intersection(plain_words(text.as_py() or "")):
                    n[w] += 1
            n[b""] = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in n]), pa.array(n.values(), pa.int64())], names=["word", "n"]
            )

    rows = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"].encode(): r["n"] for r in rows.collect()}  # as many rows as licence words
    return found, found.pop(b"", 0)


class RareTokenIndex:
    """Postings of the rarest words of phrases and templates, and the words' IDF."""

    def __init__(self, frequencies: dict[bytes, int], n_docs: int):
        self.idf = {w: math.log((1 + n_docs) / (1 + frequencies.get(w, 0))) + 1 for w in licence_words()}
        self.base = [(tuple(plain_words(p)), label) for p, label in BASE.items()]
        self.by_base: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, (p, _) in enumerate(self.base):
            j = self._rarest(p)
            self.by_base[p[j]].append((k, j))
        self.templates: list[tuple[str, list[bytes], list[tuple[bytes, ...]]]] = []
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, (label, (text, keys)) in enumerate(TEMPLATES.items()):
            words, phrases = plain_words(text), [tuple(plain_words(p)) for p in keys]
            self.templates.append((label, words, phrases))
            rare = sorted({w for p in phrases for w in p}, key=lambda w: (-self.idf[w], w))[:RARE]
            for w in rare:
                self.postings[w] += [(k, j) for j, x in enumerate(words) if x == w]
        self.order = sorted(self.postings, key=lambda w: (-self.idf[w], w))
        self.vocabulary = frozenset(self.idf)

    def _rarest(self, phrase: tuple[bytes, ...]) -> int:
        return max(range(len(phrase)), key=lambda j: (self.idf[phrase[j]], -j))

    def _places(self, phrase: tuple[bytes, ...], words: list[bytes], at: dict[bytes, list[int]]) -> list[int]:
        """Starts of the phrase, by its rarest word."""
        j, n = self._rarest(phrase), len(phrase)
        return [i - j for i in at.get(phrase[j], ()) if i >= j and tuple(words[i - j : i - j + n]) == phrase]

    def scan(self, words: list[bytes]) -> dict:
        """Starts and labels of base phrases, labels of all kinds and the best score of a file."""
        present = self.vocabulary.intersection(words)
        at: dict[bytes, list[int]] = defaultdict(list)
        if any(w in present for w in self.by_base) or any(w in present for w in self.postings):
            for i, w in enumerate(words):
                if w in present:
                    at[w].append(i)
        base = []
        for w in (w for w in self.by_base if w in at):
            for k, _ in self.by_base[w]:
                phrase, label = self.base[k]
                base += [(s, label) for s in self._places(phrase, words, at)]
        labels = {label for _, label in base}
        score = BASE_SCORE if base else 0.0
        starts: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for w in (w for w in self.order if w in at):
            for k, j in self.postings[w]:
                starts[k] += [(i - j, w) for i in at[w]]
        for k, found in starts.items():
            label, template, phrases = self.templates[k]
            agreed = agreeing(found)
            if agreed and all(self._places(p, words, at) for p in phrases):
                labels.add(label)
                score = max(score, self._score(template, words, agreed))
        return {"base": base, "labels": labels, "score": round(score, 6)}

    def _score(self, template: list[bytes], words: list[bytes], starts: list[int]) -> float:
        stands = [any(0 <= s + j < len(words) and words[s + j] == w for s in starts) for j, w in enumerate(template)]
        held = sum(self.idf[w] for w, x in zip(template, stands, strict=True) if x)
        return min(1.0, held / sum(self.idf[w] for w in template))


def agreeing(found: list[tuple[int, bytes]]) -> list[int]:
    """Starts that another word's start is near to (within ``SHIFT``)."""
    found = sorted(found)
    agreed = set()
    for a, b in zip(found, found[1:], strict=False):  # of a run of starts, neighbours of different words are enough
        if a[1] != b[1] and b[0] - a[0] <= SHIFT:
            agreed.update((a[0], b[0]))
    return sorted(agreed)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of ``docs``."""
    frequencies, n_docs = document_frequencies(docs)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RareTokenIndex(frequencies, n_docs)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                words = plain_words(text.as_py() or "")
                found = index.scan(words)
                starts = [s for s, _ in found["base"]]
                rows.append(
                    (
                        len(words), len(starts), min(starts, default=None), max(starts, default=None),
                        ",".join(sorted({label for _, label in found["base"]})), ",".join(sorted(found["labels"])),
                        found["score"],
                    )
                )
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        scan,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double",
    )


def op3_rare_token_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _list_sql(words: list[bytes]) -> str:
    return "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"


_BASE_ROWS = ", ".join(f"('{label}', {_list_sql(plain_words(p))})" for p, label in BASE.items())
_TEMPLATE_ROWS = ", ".join(f"('{label}', {_list_sql(plain_words(text))})" for label, (text, _) in TEMPLATES.items())
_PHRASE_ROWS = ", ".join(f"('{label}', {_list_sql(plain_words(p))})" for label, (_, keys) in TEMPLATES.items() for p in keys)
ORACLE_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
d AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS line FROM w),
base(label, p) AS (VALUES {_BASE_ROWS}),
templates(label, t) AS (VALUES {_TEMPLATE_ROWS}),
phrases(label, p) AS (VALUES {_PHRASE_ROWS}),
found AS (SELECT doc_id, label, i - 1 AS start FROM (SELECT doc_id, label, w, p, unnest(range(1, len(w) - len(p) + 2)) AS i FROM d, base
          WHERE contains(line, ' ' || array_to_string(p, ' ') || ' ')) WHERE w[i:i + len(p) - 1] = p),
bases AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word FROM found GROUP BY doc_id),
vocabulary AS (SELECT DISTINCT word FROM (SELECT unnest(t) AS word FROM templates UNION ALL SELECT unnest(p) FROM phrases)),
df AS (SELECT word, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(w) AS word FROM d) GROUP BY word),
idf AS (SELECT v.word, ln((1 + (SELECT count(*) FROM d)) / (1 + coalesce(n, 0))) + 1 AS idf FROM vocabulary v LEFT JOIN df ON df.word = v.word),
rare AS (SELECT label, word FROM (SELECT DISTINCT label, unnest(p) AS word FROM phrases) JOIN idf USING (word)
         QUALIFY row_number() OVER (PARTITION BY label ORDER BY idf DESC, word) <= {RARE}),
tpos AS (SELECT label, unnest(t) AS word, unnest(range(0, len(t))) AS j FROM templates),
dpos AS (SELECT doc_id, word, i FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d) WHERE word IN (SELECT word FROM rare)),
starts AS (SELECT DISTINCT doc_id, label, i - j AS start, word FROM dpos JOIN rare USING (word) JOIN tpos USING (label, word)),
pairs AS (SELECT *, lead(start) OVER o AS next, lead(word) OVER o AS other FROM starts WINDOW o AS (PARTITION BY doc_id, label ORDER BY start, word)),
near AS (SELECT doc_id, label, start, next FROM pairs WHERE other <> word AND next - start <= {SHIFT}),
agreed AS (SELECT doc_id, label, start FROM near UNION SELECT doc_id, label, next FROM near),
lacking AS (SELECT DISTINCT doc_id, label FROM d, phrases WHERE NOT contains(line, ' ' || array_to_string(p, ' ') || ' ')),
held AS (SELECT doc_id, label, start FROM agreed ANTI JOIN lacking USING (doc_id, label)),
stands AS (SELECT DISTINCT doc_id, label, j, tpos.word FROM held JOIN tpos USING (label) JOIN d USING (doc_id)
           WHERE start + j BETWEEN 0 AND len(w) - 1 AND w[start + j + 1] = tpos.word),
whole AS (SELECT label, sum(idf) AS idf FROM tpos JOIN idf USING (word) GROUP BY label),
scores AS (SELECT doc_id, label, sum(idf.idf) / any_value(whole.idf) AS score FROM stands JOIN idf USING (word) JOIN whole USING (label) GROUP BY doc_id, label),
every AS (SELECT DISTINCT doc_id, label, {BASE_SCORE} AS score FROM found UNION ALL SELECT doc_id, label, least(1.0, score) FROM scores),
labels AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels, max(score) AS score FROM every GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM found WHERE found.doc_id = d.doc_id), '') AS base_labels,
       coalesce(labels, '') AS labels, round(coalesce(score, 0.0)::DOUBLE, 6) AS score
FROM d LEFT JOIN bases USING (doc_id) LEFT JOIN labels USING (doc_id)
"""
