"""Fill-in-middle examples, cut between the units (lines) of a text by one match with repeated captures.

``(unit)*`` is matched once against the whole text by the ``regex`` library, which keeps every
repetition of a group: ``match.ends(1)`` holds the end of every unit, so their number and both
cuts are read from it. A unit is matched as it comes, left to right, and is never given back.

A document's four numbers come from the SHA-256 of ``seed:id``: two pick the cuts (any border
between units, both ends included), one whether the text is rearranged at all, one the order of
its parts. ``psm`` puts the prefix first, ``spm`` the suffix; the middle is always last. A text that
holds one of the marks is left plain, so the marks of an output tell where its parts begin.

Results: every row with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` (code points; null if
plain) and ``output``. A null or empty text has no units and is plain, its output empty. A null id
reads as an empty one, so it gets one fixed cut. A text that is no row of units (other unit
patterns may leave gaps) is plain with ``n`` null. Long texts are cut whole; repeated rows get equal
results. Columns of these names are replaced, all others pass through. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm.frames import add_columns, text_of

PLAIN, PSM, SPM = "plain", "psm", "spm"
_COLUMNS = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


@dataclass(frozen=True)
class Settings:
    """``rate`` of 100 texts are rearranged, ``spm_rate`` of 100 of those with the suffix first.

    The marks start with the same character, which they hold once: none can then begin in the
    end of a part that goes before it.
    """

    unit: str = r"[^\n]*\n|[^\n]+"
    seed: int = 7
    rate: int = 100
    spm_rate: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def __post_init__(self) -> None:
        if len(set(self.marks)) < 3 or len({m[:1] for m in self.marks}) > 1:
            raise ValueError("marks must differ and start with the same character")
        if any(m.count(m[:1]) != 1 for m in self.marks):
            raise ValueError("a mark holds its first character once")


def _cutter(settings: Settings) -> Callable[..., list[pa.Array]]:
    row_of_units = regex.compile(f"((?>{settings.unit}))*+")
    p, s, m = settings.marks

    def one(text: str, numbers: list[int]) -> tuple:
        match = row_of_units.fullmatch(text)
        if match is None:
            return None, PLAIN, None, None, text
        ends = match.ends(1)
        n = len(ends)
        if not n or numbers[2] % 100 >= settings.rate or any(x in text for x in settings.marks):
            return n, PLAIN, None, None, text
        first, second = sorted((numbers[0] % (n + 1), numbers[1] % (n + 1)))
        a = ends[first - 1] if first else 0
        b = ends[second - 1] if second else 0
        if numbers[3] % 100 < settings.spm_rate:
            return n, SPM, a, b - a, "".join((s, text[b:], p, text[:a], m, text[a:b]))
        return n, PSM, a, b - a, "".join((p, text[:a], s, text[b:], m, text[a:b]))

    def cut(texts: pa.Array, digests: pa.Array) -> list[pa.Array]:
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        columns: list[list] = [[] for _ in types]
        for text, digest in zip(texts, digests):
            numbers = [int(digest.as_py()[i : i + 8], 16) for i in (0, 8, 16, 24)]
            for column, value in zip(columns, one(text.as_py(), numbers)):
                column.append(value)
        return [pa.array(c, t) for c, t in zip(columns, types)]

    return cut


def rearrange(
    docs: DataFrame, settings: Settings = Settings(), id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Documents with the columns named above."""
    label = F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col(id).cast("string"), F.lit("")))
    given = docs.withColumns({"_fim_text": text_of(text), "_fim_digest": F.sha2(label, 256)})
    inputs = ["_fim_text", "_fim_digest"]
    return add_columns(given, _cutter(settings), inputs, _COLUMNS, tuple(inputs))


def restore(
    output: str | Column = "output", form: str | Column = "form", settings: Settings = Settings()
) -> Column:
    """The text that an output was made of, found by its marks."""
    output = F.col(output) if isinstance(output, str) else output
    form = F.col(form) if isinstance(form, str) else form

    def after(part: Column, n: Column | int) -> Column:
        return part.substr(F.lit(1) + n, F.length(part))

    def parts(one: str, two: str, three: str) -> tuple[Column, Column, Column]:
        rest = after(output, len(one))
        first = F.substring_index(rest, two, 1)
        rest = after(rest, F.length(first) + len(two))
        second = F.substring_index(rest, three, 1)
        return first, second, after(rest, F.length(second) + len(three))

    p, s, m = settings.marks
    prefix, suffix, middle = parts(p, s, m)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(s, p, m)
    return F.when(form == PSM, psm).when(form == SPM, F.concat(prefix, middle, suffix)).otherwise(output)


# The registered query in DuckDB: lines by a list of all matches, cuts by list slices.
SQL = r"""
WITH lines AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
           sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
), numbers AS (
    SELECT doc_id, text, u, len(u) AS n,
           CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
           CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
    FROM lines
), cuts AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>')
                     OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM numbers
), parts AS (
    SELECT doc_id, n, form, text, array_to_string(u[1:a], '') AS p,
           array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s
    FROM cuts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
