"""Fill-in-middle transformation (operator 13), by bit-parallel integers.

A text of m code points becomes one byte a code point (what latin-1 lacks is no letter either), and
``bytes.translate`` makes these the digits of an m-bit integer whose bit i tells whether code point i is an ASCII letter.
A unit is a run of letters or any other single code point, so it starts wherever a letter doesn't follow a letter:
``full & ~(letters & letters << 1)``. ``bit_count`` of that is the number of units, and the place of
the k-th start is found by halving the integer and counting the bits of its lower half. Every step is
linear in the text, and nothing is built per unit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import arrow_rows

# Fixed values of the format: marks of prefix, suffix and middle, shares of plain and of suffix-first texts (percent).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20
#: Byte to binary digit: 1 for A-Z and a-z.
DIGITS = bytes(0x31 if chr(b).isalpha() and b < 128 else 0x30 for b in range(256))
BATCH = 4 << 20


def unit_starts(text: str) -> int:
    """An integer whose bit i is set where a unit starts at code point i."""
    if not text:
        return 0
    letters = int(text.encode("latin-1", "replace").translate(DIGITS)[::-1], 2)
    return ((1 << len(text)) - 1) & ~(letters & (letters << 1))


def select(bits: int, rank: int) -> int:
    """The place of the set bit before which ``rank`` others are set."""
    at, size = 0, bits.bit_length()
    while size > 1:
        half = size // 2
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            bits, size = low, half
        else:
            bits, size, rank, at = bits >> half, size - half, rank - below, at + half
    return at


def cut(text: str, name: str, seed: int) -> tuple[int, str, int | None, int | None]:
    """Units, form, and the code points before the middle and in it (None: plain)."""
    starts = unit_starts(text)
    n = starts.bit_count()
    digest = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    one, two, plain, order = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or plain % 100 >= PLAIN_FROM:
        return n, "plain", None, None
    ends = sorted((one % (n + 1), two % (n + 1)))
    a, b = (select(starts, k) if k < n else len(text) for k in ends)
    return n, "spm" if order % 100 < SPM_BELOW else "psm", a, b - a


def arranged(text: str, form: str, a: int | None, size: int | None) -> str:
    if form == "plain":
        return text
    prefix, middle, suffix = text[:a], text[a : a + size], text[a + size :]
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone: a text that holds a mark is plain, so the marks found are the format's."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    text = F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1]))
    return F.coalesce(text, output)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output per row of ``docs``.

    A null or empty text is plain and stays empty. Texts of any length are cut as a whole. Cuts and form
    depend on ``seed`` and the key alone (a null key: an empty one), so repeated rows come out alike; each has its row.
    A text that holds a mark is plain. No rows: no rows. Other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("doc_id"), F.coalesce(docs[key].cast("string"), F.lit("")).alias("name"), docs[text].alias("text"))
    out = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in arrow_rows(whole, BATCH):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                cuts = [cut(t, k, seed) for t, k in zip(texts, batch.column("name").to_pylist(), strict=True)]
                n, form, a, size = zip(*cuts, strict=True)
                outputs = [arranged(t, *c[1:]) for t, c in zip(texts, cuts, strict=True)]
                columns = [pa.array(n, pa.int64()), pa.array(form), pa.array(a, pa.int64()), pa.array(size, pa.int64()), pa.array(outputs, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, out)


#: DuckDB's form of the query, by lists of units.
SQL = r"""
WITH given AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), hashed AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM given
), cuts AS (
  SELECT doc_id, t, units, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM hashed
), parts AS (
  SELECT doc_id, t, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM cuts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
