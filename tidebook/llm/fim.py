"""Fill-in-middle transformation: texts cut at unit boundaries that are found in run-length encoded character classes.

A text is stored as its maximal runs of one character class: where each run starts, and how many units have ended
once it is over. The run that holds a cut is found by binary search among those counts, and the cut's offset inside it
by arithmetic, so a text of many equal characters costs a few runs and no unit is ever listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.common import bounded_batches, read_table

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: What the draws of a text start with, percent of texts that are transformed, and percent of those with the suffix first.
SEED, RATE, SPM = 7, 100, 50

#: How a class of characters ends units: with each of its characters, with its last one, or not by itself.
EACH, LAST, NONE = 0, 1, 2
#: For each kind of unit, the class of other characters and the class of the listed ones. The end of a text ends a unit.
UNITS = {"line": (NONE, EACH, (0x0A,)), "char": (EACH, EACH, ()), "word": (LAST, NONE, (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D))}


@dataclass
class Runs:
    """Maximal runs of one class in a text: first code point, how each ends units, and the units over once it is over."""

    start: np.ndarray
    ends: np.ndarray
    units: np.ndarray  # cumulative
    length: int  # code points of the text

    @property
    def total(self) -> int:
        return int(self.units[-1]) if len(self.units) else 0

    def offset(self, cut: int) -> int:
        """Code points before the cut that leaves `cut` units, at most the total, on its left."""
        if cut <= 0:
            return 0
        run = int(np.searchsorted(self.units, cut))  # the first run by whose end so many units are over
        if self.ends[run] == EACH:
            before = int(self.units[run - 1]) if run else 0
            return int(self.start[run]) + cut - before
        return int(self.start[run + 1]) if run + 1 < len(self.start) else self.length


def runs(text: str, unit: str = "line") -> Runs:
    """The run-length encoding of a text. Units of the kinds of UNITS: lines with their line feeds, code points, words
    with the white space before them (what follows the last word is a unit of its own)."""
    other, own, listed = UNITS[unit]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    n = len(points)
    if not n:
        empty = np.empty(0, np.int64)
        return Runs(empty, empty, empty, 0)
    member = np.zeros(n, bool)
    for c in listed:
        member |= points == c
    start = np.flatnonzero(np.r_[True, member[1:] != member[:-1]])
    ends = np.where(member[start], own, other)
    size = np.diff(np.r_[start, n])
    units = np.where(ends == EACH, size, np.where(ends == LAST, 1, 0))
    units[-1] += ends[-1] == NONE
    return Runs(start, ends, np.cumsum(units), n)


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers below 2**32 that depend on the seed and doc_id alone; a null id draws as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transformed_text(doc_id: int | None, text: str, unit: str = "line", rate: int = RATE, spm: int = SPM, seed: int = SEED, marks: tuple[str, str, str] = MARKS) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    found, (h1, h2, h3, h4) = runs(text, unit), draws(doc_id, seed)
    n = found.total
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted(found.offset(h % (n + 1)) for h in (h1, h2))
    p, s, m = marks
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def transformed(docs: DataFrame, unit: str = "line", rate: int = RATE, spm: int = SPM, seed: int = SEED, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of docs.

    A share of `rate` percent of the texts is cut at two unit boundaries drawn from doc_id and put together as psm or
    spm. Null texts are empty. Texts that are empty or hold a mark stay plain, with null lengths. A null doc_id draws as
    the empty string. Repeated rows each get a row, extra columns are ignored, texts of any length are cut whole, an
    empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [transformed_text(i, t or "", unit, rate, spm, seed, marks) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            columns = list(zip(*made)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of. No part holds a mark, and no mark ends as another starts, so the first of each is it."""
    p, s, m = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(rest, second, 1)
        rest = F.substr(rest, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, m, 1)
        return one, two, F.substr(rest, F.length(two) + len(m) + 1)

    prefix, suffix, middle = parts(p, s)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


#: The same cuts by splitting at line feeds.
ORACLE_SQL = f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents
), drawn AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS parts,
    CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2, CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM base
), counted AS (
  SELECT *, CASE WHEN text = '' THEN 0 WHEN parts[-1] = '' THEN len(parts) - 1 ELSE len(parts) END AS n FROM drawn
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form
  FROM counted
), pieces AS (
  SELECT *, least(length(array_to_string(parts[1:a], chr(10))) + (a > 0)::INT, length(text)) AS pa, least(length(array_to_string(parts[1:b], chr(10))) + (b > 0)::INT, length(text)) AS pb FROM cut
), put AS (
  SELECT *, CASE form WHEN 'plain' THEN text
    WHEN 'psm' THEN '<P>' || text[1:pa] || '<S>' || text[pb + 1:] || '<M>' || text[pa + 1:pb]
    ELSE '<S>' || text[pb + 1:] || '<P>' || text[1:pa] || '<M>' || text[pa + 1:pb] END AS output
  FROM pieces
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(pa AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(pb - pa AS BIGINT) END AS middle_chars, sha256(output) AS output_sha256, sha256(text) AS restored_sha256
FROM put
"""


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transformed(read_table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
