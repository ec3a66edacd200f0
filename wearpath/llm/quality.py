"""Line-first cleaning: rules for each line, then a verdict on what is left of the document."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearpath.llm.common import as_bytes, map_batches

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&|<>"
_ENDS = ".!?:;…。！？\"'”’»)]"
_BULLET = re.compile(r"\s*(?:[-*•·]|\d{1,3}[.)])\s")
_LETTER = regex.compile(r"\p{L}")

#: Phrases of page furniture, lower case. A line of at most ``boilerplate_words`` words that holds one fails.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "accept cookies", "we use cookies", "privacy policy", "terms of use",
    "terms of service", "terms and conditions", "sign up for our newsletter", "subscribe to our", "click here",
    "read more", "log in to", "share this", "follow us on", "back to top", "powered by", "enable javascript",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "impressum", "mehr lesen",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "lire la suite",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "leer más",
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the loss a document may have."""

    #: A line of at most this many words and without sentence end is navigation, if the nearest line with words before or after is one too or it has a separator.
    navigation_words: int = 6
    #: Shares of a line's words that are menu separators, or that hold a symbol, from which it fails.
    separator_share: float = 0.2
    symbol_share: float = 0.3
    #: Share of lines' letters in capitals, of lines with at least ``capital_words`` words.
    capital_share: float = 0.7
    capital_words: int = 8
    #: A line of at least ``repeat_words`` words fails with fewer different words than this share.
    distinct_share: float = 0.1
    repeat_words: int = 20
    boilerplate_words: int = 25
    #: Share of its word characters that a document may lose to failed lines.
    lost_share: float = 0.5


def line_failure(line: str, words: list[str], rules: LineRules) -> str | None:
    """Name of the first rule that a line with at least one word breaks."""
    n = len(words)
    if n <= rules.boilerplate_words:
        low = line.lower()
        if any(p in low for p in BOILERPLATE):
            return "boilerplate"
    separators = sum(w in ("|", "»", ">", "›", "/", "·", "•") for w in words)
    if separators >= max(1, rules.separator_share * n) and n > 1:
        return "navigation"
    if sum(any(c in _SYMBOLS for c in w) for w in words) > rules.symbol_share * n:
        return "symbols"
    if n >= rules.capital_words:
        letters = [c for c in line if c.isalpha()]
        if letters and sum(map(str.isupper, letters)) > rules.capital_share * len(letters):
            return "capitals"
    if n >= rules.repeat_words and len(set(words)) < rules.distinct_share * n:
        return "repetition"
    if not _LETTER.search(line):
        return "no letters"
    return None


def clean_lines(text: str, rules: LineRules) -> tuple[list[str], Counter]:
    """The lines that pass, blank lines included, and how many lines each rule failed."""
    lines = text.split("\n")
    split = [_WORD.findall(line) for line in lines]
    short = [
        0 < len(w) <= rules.navigation_words and line.rstrip()[-1:] not in _ENDS and not _BULLET.match(line)
        for line, w in zip(lines, split)
    ]
    worded = [i for i, w in enumerate(split) if w]
    beside = {i for i, j in zip(worded, worded[1:]) if short[i] and short[j]}
    beside |= {j for i, j in zip(worded, worded[1:]) if i in beside and short[j]}
    kept, failed = [], Counter()
    for i, (line, words) in enumerate(zip(lines, split)):
        why = line_failure(line, words, rules) if words else None
        if not why and i in beside:
            why = "punctuation"
        if why:
            failed[why] += 1
        else:
            kept.append(line)
    return kept, failed


def repeated_words(words: list[str], width: int = 3) -> int:
    """Words within windows of ``width`` words that the text has twice or more, the first time included."""
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    count, covered, until = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered += i + width - max(i, until)
            until = i + width
    return covered


_SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,"
    " base_failed boolean, kept boolean, lines_failed bigint, lost_share double, cleaned string"
)


def judge(text: str | None, rules: LineRules) -> tuple:
    """The values of ``_SCHEMA`` for one text; null is a text without words and cleans to null."""
    words = _WORD.findall(text or "")
    n_words, chars = len(words), sum(map(len, words))
    seen: set[str] = set()
    dups = 0
    for line in (text or "").split("\n"):
        if line in seen:
            dups += bool(_WORD.search(line))
        else:
            seen.add(line)
    repeats = repeated_words(words)
    base_failed = n_words < 50 or 100 * repeats > 50 * n_words
    kept_lines, failed = clean_lines(text, rules) if text else ([], Counter())
    left = sum(len(w) for line in kept_lines for w in _WORD.findall(line)) if failed else chars
    lost = 1 - left / chars if chars else 0.0
    return (
        n_words, chars, sum(map((text or "").count, _SYMBOLS)), dups, repeats, base_failed,
        not base_failed and lost <= rules.lost_share, sum(failed.values()), lost, None if text is None else "\n".join(kept_lines),
    )


def line_quality(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: LineRules = LineRules(), cleaned: bool = True
) -> DataFrame:
    """One row for each row of ``docs``: counts, verdicts and the text without its failed lines.

    A null or wordless text has no words, fails the base rule and is not kept. Null ids and
    repeated rows are kept as they are; other columns are not read; an empty table gives no
    rows. ``cleaned=False`` leaves the column ``cleaned`` out.
    """
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.float64(), pa.string()]
    if not cleaned:
        names, kinds = names[:-1], kinds[:-1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [judge(t.as_buffer().to_pybytes().decode("utf-8", "replace") if t.is_valid else None, rules) for t in b.column("text")]
            columns = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.record_batch([b.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["id", *names])

    kind = docs.schema[id_column].dataType.simpleString()
    schema = ", ".join([f"id {kind}", *_SCHEMA.split(", ")[: len(names)]])
    return map_batches(as_bytes(docs, id_column, text_column), work, schema).withColumnRenamed("id", id_column)


def kept_documents(docs: DataFrame, text_column: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """``docs`` without the rejected documents; the others have their failed lines removed. Same columns.

    ``n_chars``, where it exists, follows the new text. Null, empty and wordless texts are
    rejected; repeated rows are judged each; an empty table gives no rows.
    """
    names, types = docs.columns, docs.schema
    at = names.index(text_column)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(at)
            rows = [judge(t.as_py() if t.is_valid else None, rules) for t in column]
            keep = pa.array([r[6] for r in rows], pa.bool_())
            columns = list(b.columns)
            columns[at] = pa.array([r[9] for r in rows], column.type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema).filter(keep)

    out = map_batches(docs, work, types)
    return out.withColumn("n_chars", F.char_length(text_column).cast(types["n_chars"].dataType)) if "n_chars" in names else out


_SPACE = r"[^\x20\x09-\x0D]+"
#: The base columns in SQL; the verdict of the line rules has no SQL form.
BASE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_SPACE}') AS ws FROM d),
tri AS (
  SELECT doc_id, i, ws[i] || chr(1) || ws[i + 1] || chr(1) || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
rep AS (
  SELECT doc_id, count(DISTINCT i + o) AS n
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri), (SELECT unnest([0, 1, 2]) AS o)
  WHERE c > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
dup AS (
  SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, l, count(*) AS n FROM lines
  WHERE regexp_matches(l, '{_SPACE}') GROUP BY doc_id, l) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words,
  coalesce(list_sum([length(x) for x in ws]), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  (len(ws) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(ws)) AS base_failed
FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)
"""
