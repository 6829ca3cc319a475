"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too
much of its text is rejected.

A line fails when it has no word, repeats an earlier line of its document, does not end in
terminal punctuation, looks like navigation (bars, arrows or short link lists), holds a
boilerplate phrase or code, is dense in symbols, or shouts (nearly all letters are capitals).

One pass over the rows, no shuffle: each Arrow batch is scored where it is read.

Defined cases: null text counts as empty: no words, base_failed, not kept; a text of any length
is scored whole; repeated rows have equal results; an empty table gives no rows; other columns
are not read. White space is ASCII 0x09-0x0D and 0x20; other separators are word characters.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read

SYMBOLS = "#*$%&|<>"
SPACE = "\t\n\x0b\x0c\r "
TERMINAL = tuple(".!?…。！？؟।:;\"'”’»)")
#: Phrases of site furniture, lower case.
BOILERPLATE = ("cookie", "javascript", "terms of use", "terms of service", "privacy policy", "all rights reserved", "lorem ipsum", "copyright", "subscribe", "sign up", "log in", "click here", "read more", "permission is hereby granted", "licensed under", "powered by")
BOILER_RE = re.compile("|".join(map(re.escape, BOILERPLATE)) + r"|[{}]")
NAV_RE = re.compile(r"[\t-\r ][|»›>•·/][\t-\r ]")
MIN_WORDS, MAX_REPEAT_SHARE, MAX_LOST_SHARE = 50, 0.5, 0.5
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines long, n_lines_removed long, n_words_left long, kept boolean"


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three words that the text has twice or more, first included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    v = len(number)
    if v < 2_000_000:
        key = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:  # v cubed would not fit: number the pairs first
        _, pair = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)
        key = pair[:-1] * v + ids[2:]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[:-1][same]] = True
    twice[order[1:][same]] = True
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= twice
    return int(hit.sum())


def line_fails(line: str) -> bool:
    """The rules for one line that has a word and is not a repeat."""
    line = line.strip(SPACE)
    if not line.endswith(TERMINAL):
        return True
    size = len(line)
    if len(NAV_RE.findall(line)) * 12 > size:
        return True
    if sum(map(line.count, SYMBOLS)) * 20 > size:
        return True
    if size >= 8 and line.upper() == line and line.lower() != line:
        return True
    return BOILER_RE.search(line.lower()) is not None


def score(text: str | None) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACE))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dup = lines = removed = left = 0
    for line in text.split("\n"):
        own = len(line.encode("utf-8", "surrogatepass").split())
        if not own:
            continue
        lines += 1
        if line in seen:
            dup += 1
            removed += 1
            continue
        seen.add(line)
        if line_fails(line):
            removed += 1
        else:
            left += own
    repeat = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeat > 100 * MAX_REPEAT_SHARE * n
    return n, chars, symbols, dup, repeat, failed, lines, removed, left, not failed and left >= (1 - MAX_LOST_SHARE) * n


def clean_text(text: str | None) -> str:
    """The lines that stay, in order."""
    seen: set[str] = set()
    out = []
    for line in (text or "").split("\n"):
        if line.strip(SPACE) and line not in seen and not line_fails(line):
            out.append(line)
        seen.add(line)
    return "\n".join(out)


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document with its counts and verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(zip(*(score(x.as_py()) for x in b.column(1)), strict=True)) or [()] * 10
            kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.int64()] * 3 + [pa.bool_()]
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return rows.mapInArrow(run, SCHEMA)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(read(spark, sf_dir, "documents"))


_PHRASES = "|".join(BOILERPLATE)
_ENDS = " OR ".join("ends_with(s, '{}')".format(c.replace("'", "''")) for c in TERMINAL)
_MARKS = " + ".join(f"(length({{0}}) - length(replace({{0}}, '{c}', '')))" for c in SYMBOLS)
OP6_SQL = (
    r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rk, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT rk, ws[i : i + 2] AS k, i FROM (SELECT rk, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
h AS (SELECT rk, i FROM g QUALIFY count(*) OVER (PARTITION BY rk, k) > 1),
r AS (SELECT rk, count(DISTINCT p) AS n FROM (SELECT rk, unnest([i, i + 1, i + 2]) AS p FROM h) GROUP BY rk),
l0 AS (SELECT rk, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
l1 AS (SELECT rk, line, i, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS s, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS own FROM l0),
l2 AS (SELECT *, row_number() OVER (PARTITION BY rk, line ORDER BY i) > 1 AS dup FROM l1 WHERE own > 0),
l3 AS (SELECT *, dup OR NOT ("""
    + _ENDS
    + r""") OR len(regexp_extract_all(s, '[\t-\r ][|»›>•·/][\t-\r ]')) * 12 > length(s) OR ("""
    + _MARKS.replace("{0}", "s")
    + r""") * 20 > length(s)
  OR (length(s) >= 8 AND upper(s) = s AND lower(s) <> s) OR regexp_matches(lower(s), '"""
    + _PHRASES
    + r"""|[{}]') AS bad FROM l2),
l AS (SELECT rk, count(*) AS n_lines, count(*) FILTER (dup) AS dups, count(*) FILTER (bad) AS gone, coalesce(sum(own) FILTER (NOT bad), 0) AS words_left FROM l3 GROUP BY rk),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, ("""
    + _MARKS.replace("{0}", "t")
    + r""")::BIGINT AS n_symbols,
  coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(gone, 0)::BIGINT AS n_lines_removed, coalesce(words_left, 0)::BIGINT AS n_words_left
  FROM w LEFT JOIN r USING (rk) LEFT JOIN l USING (rk))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * n_words_left >= n_words AS kept FROM b
"""
)
