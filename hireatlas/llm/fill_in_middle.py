"""Fill-in-middle: each text is cut at two units into prefix, middle and suffix, and written in a training order.

Units are the repetitions of one capture: a `regex` match of `(unit)*` keeps the end of every repetition, so `match.ends(1)` holds the
number of units and both cut offsets, and no unit is walked over in Python. A match keeps about 110 bytes a unit; a text of more than
`UNITS` units is matched by runs of that many, each beginning where the one before it ended, which gives the same ends in bounded memory.

The cut positions and the form come from the SHA-256 of `<seed>:<id>`, so a row that is worked out again gives the same output. Texts that
hold one of the marks, empty and null texts, and texts that units do not cover (not possible with code points) stay plain. A null id is
hashed as an empty one; rows that repeat an id are cut at the same draws of their own text. An empty table gives an empty result; columns
other than the id and the text are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CODE_POINT = r"(?s:.)"
SEED = 1
PLAIN_PERCENT = 10
SPM_PERCENT = 20

UNITS = 1 << 18
#: Rows of an output batch hold about this many characters.
BATCH_CHARS = 1 << 22


def draws(doc_id: str, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of a row, from its id."""
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(sha, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    unit: str = CODE_POINT,
    seed: int = SEED,
    plain_percent: int = PLAIN_PERCENT,
    spm_percent: int = SPM_PERCENT,
    units: int = UNITS,
) -> DataFrame:
    """`doc_id, n, form, prefix_chars, middle_chars, output` of every row: n counts units, the two lengths count code points."""

    def run(batches):
        import regex

        unit_run = regex.compile(f"({unit}){{0,{units}}}")
        all_units = regex.compile(f"({unit})*")

        def ends_of(text: str) -> list[int] | None:
            """The end of every unit; None if units do not cover the text."""
            if len(text) <= units:
                match = all_units.fullmatch(text)
                return match and match.ends(1)
            ends: list[int] = []
            at = 0
            while at < len(text):
                more = unit_run.match(text, at).ends(1)
                if not more or more[-1] == at:
                    return None
                ends += more
                at = more[-1]
            return ends

        def cut(text: str, h1: int, h2: int, h3: int, h4: int):
            ends = ends_of(text)
            n = len(ends or ())
            if not n or h3 % 100 >= 100 - plain_percent or PREFIX in text or SUFFIX in text or MIDDLE in text:
                return n, "plain", None, None, text
            low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
            a, b = (ends[k - 1] if k else 0 for k in (low, high))
            if h4 % 100 < spm_percent:
                return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
            return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"

        for batch in batches:
            first, size, rows = 0, 0, []
            columns = [batch.column(f"h{k}") for k in (1, 2, 3, 4)]
            for i, value in enumerate(batch.column("text")):
                whole = value.as_py()
                rows.append(cut(whole, *(c[i].as_py() for c in columns)))
                size += len(whole)
                if size >= BATCH_CHARS or i + 1 == batch.num_rows:
                    ids = batch.column("doc_id").slice(first, len(rows))
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                    found = [pa.array(v, k) for v, k in zip(zip(*rows), kinds)]
                    yield pa.record_batch([ids, *found], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
                    first, size, rows = i + 1, 0, []

    whole = F.coalesce(F.col(text), F.lit("")).alias("text")
    rows = docs.select(F.col(doc_id).alias("doc_id"), whole, *(h.alias(f"h{k + 1}") for k, h in enumerate(draws(doc_id, seed))))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text an output was made of. No mark can begin inside a part, so the marks of a cut form are its only ones."""
    parts = F.split(F.col(output), f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return (
        F.when(F.col(form) == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(F.col(form) == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(F.col(output))
    )


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored().cast("binary"), 256).alias("restored_sha256"),
    )


QUERIES = {"op13_fill_in_middle": op13_fill_in_middle}

ORACLES = {
    "op13_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (
  SELECT doc_id, t, length(t) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2,
         ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4
  FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (
  SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1, n - b) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
}
