"""Fill-in-middle transformation: documents are cut into units and their parts reordered, so that a model learns to fill gaps.

One Arrow-batched pandas UDF does a document: the regex library's ``finditer`` yields the units, whose end offsets go to a compact
array; two look-ups there slice the text into prefix, middle and suffix; the cut points and the form come from a hash of the
document's id, so a repeated or retried run gives the same rows. A second UDF rebuilds the text from output and form alone.

Forms: ``psm`` is ``<P>``prefix``<S>``suffix``<M>``middle, ``spm`` is ``<S>``suffix``<P>``prefix``<M>``middle, ``plain`` is the text
itself: for empty texts, texts that hold a sentinel, and the share of documents beyond ``rate``.

Defined results: null text counts as empty; a null id is hashed as the empty text; equal ids are cut by equal hashes; a unit is a line
with its end, so a text without line ends is one unit, and no length is too long (8 bytes a unit beside the text); offsets count code
points; no rows give no rows. The result's columns are the operator's own: others of the input can't clash.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from docloom.llm.common import read_table, release

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
UNIT = r"[^\n]*\n|[^\n]+"


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """End offsets of the units of a text, after a leading 0: unit k is ``text[ends[k]:ends[k + 1]]``."""
    ends = array("q", [0])
    ends.extend(m.end() for m in unit.finditer(text))
    return ends


def draws(key: str, seed: str) -> tuple[int, ...]:
    """Four numbers of 32 bits that depend on seed and key alone."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in range(0, 32, 8))


def arrange(text: str, key: str, seed: str, rate: int, spm: int, unit: regex.Pattern) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix length, middle length, output) of one text; the lengths are None in plain form."""
    ends = unit_ends(text, unit)
    n = len(ends) - 1
    h1, h2, h3, h4 = draws(key, seed)
    if not text or h3 % 100 >= rate or any(s in text for s in SENTINELS):
        return n, "plain", None, None, text
    low, high = sorted((ends[h1 % (n + 1)], ends[h2 % (n + 1)]))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < spm:
        return n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def rebuilt(output: str, form: str) -> str:
    """The text that ``arrange`` made ``output`` of. Sentinels begin with a sign that is nowhere else in them, so the first match is the mark itself."""
    if form == "plain":
        return output
    (head, a), (then, b) = ((SUFFIX, 2), (PREFIX, 0)) if form == "spm" else ((PREFIX, 0), (SUFFIX, 2))
    first, _, rest = output[len(head) :].partition(then)
    second, _, middle = rest.partition(MIDDLE)
    parts = {a: first, b: second, 1: middle}
    return parts[0] + parts[1] + parts[2]


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def transform(seed: int = 7, rate: int = 100, spm: int = 50, unit: str = UNIT):
    """The UDF (id as text, text) -> struct; a document's text is held once beside its output."""

    @pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string")
    def run(key: pd.Series, text: pd.Series) -> pd.DataFrame:
        cut, rows = regex.compile(unit), []
        for k, t in zip(key, text, strict=True):
            row = arrange(t or "", k or "", str(seed), rate, spm, cut)
            rows.append((*row, _hex(row[-1])))
        n, form, prefix, middle, output, digest = zip(*rows, strict=True) if rows else ((),) * 6
        del rows
        release()  # the batch before this one left its texts
        long = lambda x: pd.array(x, "Int64")
        return pd.DataFrame({"n": long(n), "form": form, "prefix_chars": long(prefix), "middle_chars": long(middle), "output": output, "output_sha256": digest})

    return run


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, output_sha256), a row for each of ``docs``.

    ``rate`` of 100 documents are transformed, ``spm`` of 100 of those with the suffix first; ``n`` counts units.
    """
    made = transform(seed, rate, spm)(F.col(id_col).cast("string"), F.col(text_col))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), made.alias("made")).select("doc_id", "made.*")


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """struct<text, text_sha256> of the original text."""

    @pandas_udf("text string, text_sha256 string")
    def run(output: pd.Series, form: pd.Series) -> pd.DataFrame:
        texts = [rebuilt(o or "", f) for o, f in zip(output, form, strict=True)]
        release()
        return pd.DataFrame({"text": texts, "text_sha256": [_hex(t) for t in texts]}, dtype="object")

    return run(output, form)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read_table(spark, sf_dir, "documents")).withColumn("back", restored())
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.col("back.text_sha256").alias("restored_sha256"))


OP12_SQL = r"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
    FROM documents
), drawn AS (
    SELECT doc_id, t, units, len(units) AS n, ('0x' || h[1:8])::UBIGINT % (len(units) + 1) AS a, ('0x' || h[9:16])::UBIGINT % (len(units) + 1) AS b,
        t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::UBIGINT % 100 >= 100 AS plain,
        ('0x' || h[25:32])::UBIGINT % 100 < 50 AS spm
    FROM cut
), parts AS (
    SELECT *, array_to_string(units[1:least(a, b)::BIGINT], '') AS p, array_to_string(units[least(a, b)::BIGINT + 1:greatest(a, b)::BIGINT], '') AS m,
        array_to_string(units[greatest(a, b)::BIGINT + 1:], '') AS s
    FROM drawn
)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
    CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
    sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts
"""
