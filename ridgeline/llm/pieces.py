"""SentencePiece encoding and decoding over a table of distinct chunks.

No piece of the model holds a white-space marker after another character, so merges can't cross the start of a
run of markers: each distinct marked word is segmented once and its ids are joined back by position."""

from __future__ import annotations

import hashlib
import re
import sys
from functools import lru_cache

from pyspark.sql import DataFrame

from ridgeline.llm.common import Remembered, map_texts

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")
#: Stands before each chunk while a text is split; texts that hold it are split by the expression above.
SPLIT = f"\0{MARK}"
#: Bytes of distinct chunks remembered per worker; the table starts anew when full.
REMEMBERED = 128 << 20


class ChunkTable(Remembered):
    """chunk -> (its ids as decimal text, its decoded text) by the ``sentencepiece`` model at ``path``.

    A chunk starts with markers or with one line break; neither stands after another character in any piece, so
    chunks are independent, and each distinct one is segmented once."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__(REMEMBERED)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        crossing = [p for p in names if MARK in p.lstrip(MARK) or "\n" in p]
        if crossing or "".join(self.model.encode("ﬁ  b", out_type=str)) != f"{MARK}ﬁ{MARK}{MARK}b":
            raise ValueError("pieces of this model cross white-space markers, or it rewrites texts: chunks would not be independent")
        #: text of each id, None for bytes, which only decode together
        bare = (self.model.is_byte, self.model.is_control, self.model.is_unknown)
        self.text = [None if any(f(i) for f in bare) else p.replace(MARK, " ") for i, p in enumerate(names)]
        self.head = self.model.encode("a")
        self.mark = self.model.piece_to_id(MARK)

    def __missing__(self, chunk: str) -> tuple[str, str]:
        if (found := self.again(chunk)) is not None:
            return found
        if chunk == MARK:  # the model gives nothing for an empty text
            ids = [self.mark]
        elif chunk[0] == MARK:  # the model puts a marker of its own in front of any text
            ids = self.model.encode(chunk[1:])
        else:
            ids = self.model.encode(chunk)[1:]
        said = [self.text[i] for i in ids]
        found = (",".join(map(str, ids)), self.model.decode([*self.head, *ids])[1:] if None in said else "".join(said))
        return self.keep(chunk, found, self.size_of(found))

    def size_of(self, found: tuple[str, str]) -> int:
        return 64 + sys.getsizeof(found[0]) + sys.getsizeof(found[1])

    def chunks(self, text: str) -> list[str]:
        """Chunks of a text, in order; joined they are the text with a marker put in front."""
        if not text:
            return []
        if "  " in text or text[0] == " " or "\0" in text or MARK in text:
            return CHUNK.findall(MARK + text.replace(" ", MARK))
        return (MARK + text.replace(" ", SPLIT).replace("\n", "\0\n")).split("\0")

    def rows(self, text: str) -> list[tuple[str, str]]:
        return list(map(self.__getitem__, self.chunks(text)))

    def encode(self, text: str) -> list[int]:
        return [int(i) for row in self.rows(text) for i in row[0].split(",")]

    def decode(self, rows: list[tuple[str, str]]) -> str:
        return "".join([row[1] for row in rows])[1:]


@lru_cache(maxsize=4)
def table(path: str) -> ChunkTable:
    return ChunkTable(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array, decoded) of every row: the model's ids of the whole text without begin, end or sampling, and
    their decoded text. Null texts count as empty: no ids, empty text. Repeated rows give repeated rows; an empty
    table gives an empty table. One Arrow-batched map, no shuffle; ``path`` must be readable on each executor."""

    def work():
        chunks = table(path)

        def each(texts: list[str]) -> list:
            found = [chunks.rows(t) for t in texts]
            return [[[int(i) for row in rows for i in row[0].split(",")] for rows in found], [chunks.decode(rows) for rows in found]]

        return each

    return map_texts(docs, [("ids", "array<int>"), ("decoded", "string")], work, id_col, text_col)


def encode_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of what ``encode_decode`` returns, taken in its workers
    so that ids and texts aren't carried back."""

    def work():
        chunks = table(path)

        def each(texts: list[str]) -> list:
            n, ids, said = [], [], []
            for t in texts:
                rows = chunks.rows(t)
                joined = ",".join([row[0] for row in rows])
                n.append(joined.count(",") + 1 if joined else 0)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                said.append(hashlib.sha256(chunks.decode(rows).encode()).hexdigest())
            return [n, ids, said]

        return each

    return map_texts(docs, [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], work, id_col, text_col)
