"""Fill-in-the-middle transformation of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coterie.llm import words
from coterie.llm.arrow import appended, flat_text, steps
from coterie.llm.boundaries import BoundarySet

#: What marks prefix, suffix and middle; a text that holds one stays as it is.
MARKS = ("<P>", "<S>", "<M>")
UNITS = ("word", "character")


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2**32 from the SHA-256 of ``seed:doc_id``; a null id is empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def unit_bounds(data: np.ndarray, offsets: np.ndarray, unit: str = "word"):
    """Per text the set of places, in code points, at which it may be cut: 0 and the
    end of every unit.  A unit is a word with the white space before it, or white space
    at the end of the text; or a single character."""
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    at = lead[offsets]
    if unit == "character":
        for k in range(len(offsets) - 1):
            yield BoundarySet(np.arange(at[k + 1] - at[k] + 1))
        return
    _, ends, first = words.spans(data, offsets, words.WHITE)
    ends = lead[ends]
    for k in range(len(offsets) - 1):
        lo, hi = offsets[k], offsets[k + 1]
        rest = at[k + 1:k + 2] if hi > lo and words.WHITE[data[hi - 1]] else at[:0]
        yield BoundarySet(np.concatenate([at[k:k + 1], ends[first[k]:first[k + 1]], rest]) - at[k])


def fill_in_middle(docs: DataFrame, seed: int = 42, unit: str = "word", rate: int = 50, spm: int = 80) -> DataFrame:
    """``docs`` with n (units of the text, long), form, prefix_chars, middle_chars (code
    points) and output.

    The text is cut after h1 % (n + 1) and h2 % (n + 1) units, where h1 to h4 are the
    ``draws`` of doc_id; the part between the cuts is the middle.  It stays whole (form
    ``plain``) if it is empty, holds one of MARKS, or h3 % 100 >= ``rate``; else its
    form is ``spm`` if h4 % 100 < ``spm`` and ``psm`` if not:

        psm  <P>prefix<S>suffix<M>middle
        spm  <S>suffix<P>prefix<M>middle

    The places at which a text may be cut are a set in containers; a search over the
    members before each container and a select inside one find each cut.  Every row is
    transformed on its own: repeated rows alike, rows of one doc_id with equal draws.
    A null text is empty and its output an empty string; a plain text has null counts.
    Columns named like the results, or ``cut``, are replaced.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    names = ("n", "form", "prefix_chars", "middle_chars", "output", "cut")
    docs = docs.drop(*names)

    def cuts(batch: pa.RecordBatch) -> dict:
        data, offsets = flat_text(batch.column(batch.schema.get_field_index("text")))
        drawn = batch.column(batch.schema.get_field_index("cut"))
        one, two = (drawn.field(k).to_numpy(zero_copy_only=False) for k in range(2))
        out = np.zeros((3, len(batch)), np.int64)
        for lo, hi in steps(offsets):
            part = data[offsets[lo]:offsets[hi]]
            for k, bounds in enumerate(unit_bounds(part, offsets[lo:hi + 1] - offsets[lo], unit), lo):
                n = len(bounds) - 1
                a, b = sorted((int(one[k]) % (n + 1), int(two[k]) % (n + 1)))
                out[:, k] = n, bounds.select(a), bounds.select(b)
        return {"n": pa.array(out[0]), "prefix_chars": pa.array(out[1]), "middle_chars": pa.array(out[2] - out[1])}

    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    found = appended(docs.withColumn("cut", F.struct(h1.alias("h1"), h2.alias("h2"))),
                     "n long, prefix_chars long, middle_chars long", cuts, without=("cut",))
    text = F.coalesce("text", F.lit(""))
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains(text, F.lit(mark))
    form = F.when((text == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    start, length = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix, middle = F.substr(text, F.lit(1), start), F.substr(text, start + 1, length)
    suffix = F.substr(text, start + length + 1)
    p, s, m = map(F.lit, MARKS)
    found = found.withColumn("form", form)
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(
        F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text)
    cut = F.col("form") != "plain"
    return found.select(*docs.columns, "n", "form", F.when(cut, F.col("prefix_chars")).alias("prefix_chars"),
                        F.when(cut, F.col("middle_chars")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` made ``output`` from."""
    parts = F.split(output, f"<[{''.join(mark[1] for mark in MARKS)}]>", -1)
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    out = output
    for name, places in order.items():
        out = F.when(form == name, F.concat(*(F.get(parts, F.lit(k)) for k in places))).otherwise(out)
    return out
