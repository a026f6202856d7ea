"""Fill-in-middle transformation: texts cut into prefix, middle and suffix by code points, found in UTF-8 by runs of characters of one width."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_texts, prepare

#: Marks of the parts; a text that holds one stays plain.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Per cent of texts that stay plain, of the others that get their suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: Bytes that are classed together.
BLOCK = 1 << 20

#: The class of a character by its first byte: its bytes in UTF-8; 0 inside a character.
_WIDTH = np.zeros(256, dtype=np.uint8)
_WIDTH[:0x80], _WIDTH[0xC0:0xE0], _WIDTH[0xE0:0xF0], _WIDTH[0xF0:] = 1, 2, 3, 4


class Runs:
    """A text's maximal runs of characters of one class, the bytes of a character in UTF-8.

    Each has the code points before it (``units``, and the total last), its first byte (``starts``) and its width, so that a
    cut is found by binary search and its byte by one multiplication.
    """

    def __init__(self, data: bytes):
        if data.isascii():
            heads, units, widths, total = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.ones(1, np.int64)], len(data)
        else:
            heads, units, widths, total = [], [], [], 0
            last = 0
            for at in range(0, len(data), BLOCK):
                width = _WIDTH[np.frombuffer(data, np.uint8, min(BLOCK, len(data) - at), at)]
                lead = np.flatnonzero(width)
                width = width[lead]
                new = np.flatnonzero(np.diff(width, prepend=last))  # a run goes on over the border of a block
                heads.append(at + lead[new])
                units.append(total + new)
                widths.append(width[new].astype(np.int64))
                total += len(lead)
                last = width[-1] if len(width) else last
        self.starts, self.widths = np.concatenate(heads), np.concatenate(widths)
        self.units = np.append(np.concatenate(units), total)
        self.n = int(total)

    def offset(self, cut: int) -> int:
        """The byte before which ``cut`` code points stand."""
        run = min(int(np.searchsorted(self.units, cut, side="right")), len(self.starts)) - 1
        return int(self.starts[run] + (cut - self.units[run]) * self.widths[run])


def transform(doc_id: int | None, data: bytes, seed: str = "1") -> tuple[int, str, int | None, int | None, bytes]:
    """(code points, form, those of the prefix, of the middle, output) of one text; ``seed:doc_id`` draws cuts and form."""
    runs = Runs(data)
    drawn = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[i : i + 8], 16) for i in range(0, 32, 8))
    if not data or h3 % 100 >= 100 - PLAIN_PERCENT or PREFIX in data or SUFFIX in data or MIDDLE in data:
        return runs.n, "plain", None, None, data
    first, second = sorted((h1 % (runs.n + 1), h2 % (runs.n + 1)))
    a, b = runs.offset(first), runs.offset(second)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < SPM_PERCENT:
        form, parts = "spm", (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    else:
        form, parts = "psm", (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    return runs.n, form, first, second - first, b"".join(parts)


def fill_in_middle(docs: DataFrame, seed: str = "1") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every text.

    Null texts count as empty; empty texts and those that hold a mark stay plain. A row without doc_id draws from
    ``seed:`` alone; rows of one doc_id draw alike and stay rows of their own, so repeated rows give repeated results;
    an empty table gives no rows; further columns are not read. A text needs memory for itself and its output.
    """
    prepare(docs.sparkSession)

    def each(doc_ids, texts):
        return list(zip(*(transform(i, t or b"", seed) for i, t in zip(doc_ids, texts))))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"
    mapped = map_texts(rows, schema, lambda: lambda doc_ids, texts: (doc_ids, *each(doc_ids, texts)), ["doc_id", "text"])
    return mapped.withColumn("output", F.col("output").cast("string"))


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text of an output, from it and its form alone: marks cannot stand in a part, nor overlap one, so each is found once."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    p, s, m = (x.decode() for x in (PREFIX, SUFFIX, MIDDLE))
    before = lambda text, mark: F.substring_index(text, mark, 1)
    after = lambda text, mark: F.substring_index(text, mark, -1)
    middle = after(output, m)
    psm = F.concat(before(after(output, p), s), middle, before(after(output, s), m))
    spm = F.concat(before(after(output, p), m), middle, before(after(output, s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
