"""Fill-in-middle transformation by overlapping chunks.

Where a token ends shows in two adjacent characters, so chunks that overlap by one count their token ends apart from one
another. Prefix sums of the counts give a text's number of tokens and route the ranks of both cuts to the chunks that
own them; only those are scanned again. White space is ASCII, so adjacent bytes of UTF-8 say the same as adjacent code
points, and a chunk may begin inside a character."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import slices, texts_of

#: Bytes of a chunk: all that counting or scanning holds beside the text itself.
CHUNK = 1 << 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


class TokenEnds:
    """The token ends of one text: ``n`` of them, and where each is.

    A token is white space and the run of other characters after it, or white space at the end of the text. So one ends
    after each character that isn't white before one that is, and after the last character."""

    def __init__(self, text: bytes, chunk: int = CHUNK):
        self.data, self.chunk = np.frombuffer(text, np.uint8), chunk
        counts = [np.count_nonzero(self._ends(k)) for k in range(-(-len(self.data) // chunk))]
        self.upto = np.cumsum([0, *counts])
        self.n = int(self.upto[-1])

    def _ends(self, k: int) -> np.ndarray:
        """Whether a token ends after each byte of chunk ``k``, which looks one byte beyond itself."""
        start, stop = k * self.chunk, min((k + 1) * self.chunk, len(self.data))
        white = _WHITE[self.data[start : stop + 1]]
        if stop == len(self.data):
            return np.append(~white[:-1] & white[1:], True)
        return ~white[:-1] & white[1:]

    def after(self, rank: int) -> int:
        """Bytes of the first ``rank`` tokens; scans the chunk that owns the last of them."""
        if not rank:
            return 0
        k = int(np.searchsorted(self.upto, rank)) - 1
        return k * self.chunk + int(np.flatnonzero(self._ends(k))[rank - self.upto[k] - 1]) + 1


def code_points(text: bytes) -> int:
    return sum(int(np.count_nonzero(np.frombuffer(text[k : k + CHUNK], np.uint8) & 0xC0 != 0x80)) for k in range(0, len(text), CHUNK))


def draws(id: Column, seed: int) -> list[Column]:
    """Four 32-bit numbers of a document: the first groups of 8 digits of sha256("<seed>:<id>"); a null id is empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, share: int = 50, spm_share: int = 80, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row: ``share`` percent of the texts are cut in three at
    token ends that are drawn from their id, and ``spm_share`` percent of these have the suffix first.

    Null texts count as empty. Empty texts, those that hold a mark and those that aren't drawn are plain: output is the
    text, both lengths are null. Rows of one id and text have equal results; a null id draws like an empty one. An empty
    table gives an empty table; other columns of any name are left alone. One Arrow-batched map without a shuffle."""
    h1, h2, h3, h4 = draws(F.col("id"), seed)
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (h3 % 100 >= share), "plain").when(h4 % 100 < spm_share, "spm").otherwise("psm")
    base = texts_of(docs, id_col, text_col).select("id", F.col("text").cast("binary").alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def one(text: bytes, form: str, h1: int, h2: int) -> tuple:
        found = TokenEnds(text)
        if form == "plain":
            return found.n, None, None, text
        first, last = sorted((h1 % (found.n + 1), h2 % (found.n + 1)))
        i, j = found.after(first), found.after(last)
        a, b, c = text[:i], text[i:j], text[j:]
        return found.n, code_points(a), code_points(b), b"".join((s, c, p, a, m, b) if form == "spm" else (p, a, s, c, m, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                cells = [part.column(k).to_pylist() for k in ("text", "form", "h1", "h2")]
                n, before, inside, output = zip(*map(one, *cells), strict=True)
                made = [pa.array(n, pa.int64()), part.column("form"), pa.array(before, pa.int64()), pa.array(inside, pa.int64()), pa.array(output, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("id"), *made], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    found = base.mapInArrow(run, f"id {base.schema['id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return found.select(F.col("id").alias(id_col), "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text of a transformed one. No part holds a mark, and none arises where two parts meet, as marks begin with
    their only ``<`` and end with their only ``>``."""
    parts = F.split(output, "<[PSM]>", -1)
    joined = F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
    return F.when(form == "plain", output).otherwise(joined)
