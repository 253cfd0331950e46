"""SimHash near-duplicates linked by anchor-point covering.

Two fingerprints of 64 bits that differ in at most 4 agree, but for one bit at most, on one of three parts of 21,
21 and 22 bits. The anchors of a part form a covering code: a Hamming code of 15 bits (covering radius 1) times
all words of the other bits. Each fingerprint has one home anchor per part, the nearest; it is replicated to every
anchor that is the home of a word within one bit, all of them within covering radius plus threshold. So a linked
pair meets at the home of either, where members are compared on all 64 bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import Stored, map_texts, named, positions, row_hashes
from ridgeline.llm.components import connected_components

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: (first bit, bits) of each part; DISTANCE // len(PARTS) bits at most differ in one of them.
PARTS = ((0, 21), (21, 21), (42, 22))
HAMMING = 15
#: Shingles hashed at once, and members of an anchor that are compared as one matrix.
STEP, MATRIX = 1 << 16, 48
#: Members of an anchor that meet in one task; larger anchors are dealt out as pairs of blocks.
BLOCK = 8192
#: Rows of one fingerprint beyond which it is joined back by broadcast.
HOT = 1_000_000


def fingerprint(text: str) -> int:
    """Bit majority of the XXH64 hashes of all shingles, repeats included; no words: 0."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only space and U+0009 to U+000D split
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - SHINGLE + 1]
    ends, ones, digest = ends[SHINGLE - 1 :], np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), STEP):
        spans = zip(starts[at : at + STEP].tolist(), ends[at : at + STEP].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.dtype("<u8"))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def home(words: np.ndarray) -> np.ndarray:
    """Nearest anchor: the low 15 bits are corrected to a Hamming code word (the syndrome names the wrong bit)."""
    syndrome = np.zeros_like(words)
    for bit in range(HAMMING):
        syndrome ^= np.where(words >> bit & 1, bit + 1, 0)
    return np.where(syndrome, words ^ (1 << np.maximum(syndrome - 1, 0)), words)


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor with its part, index of the fingerprint, whether it is its home), each anchor of a fingerprint once."""
    cells, rows, homes = [], [], []
    bits = prints.view(np.uint64)
    for k, (first, width) in enumerate(PARTS):
        part = (bits >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64)
        own = home(part)
        near = np.sort(np.stack([own, *(home(part ^ (1 << b)) for b in range(width))], axis=1), axis=1)
        first_of = np.concatenate([np.ones((len(part), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
        at, _ = np.nonzero(first_of)
        cells.append(near[first_of] | k << 32)
        rows.append(at)
        homes.append(near[first_of] == own[at])
    return np.concatenate(cells), np.concatenate(rows), np.concatenate(homes)


def replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("fp").to_numpy()
        for at in range(0, len(prints), 4096):
            cell, row, own = anchors(prints[at : at + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(prints[at : at + 4096][row]), pa.array(own)], ["cell", "fp", "home"])


def forest(members: np.ndarray, own: np.ndarray, most: int = DISTANCE) -> tuple[list, list]:
    """Links that span what pairs of one anchor's distinct members connect, fewer than its members. Pairs of which
    neither is at home here meet at another anchor, so they aren't compared.

    Few members: one comparison of homes with all. Many: a breadth-first walk that compares a reached member with
    the unreached only, so a dense group costs about one comparison a member, not one a pair."""
    if len(members) <= MATRIX:
        a, b = np.nonzero(np.bitwise_count(members[own][:, None] ^ members[None, :]) <= most)
        left, right = members[own][a], members[b]
        differ = left != right
        return left[differ].tolist(), right[differ].tolist()
    return _walk([[members[own], members[~own]]], most)


def bridges(left: np.ndarray, right: np.ndarray, own_left: np.ndarray | None = None, own_right: np.ndarray | None = None, most: int = DISTANCE) -> tuple[list, list]:
    """Links between two blocks of one anchor's members that span what these links connect; see ``forest``."""
    sides = ((left, own_left), (right, own_right))
    return _walk([[x, x[:0]] if own is None else [x[own], x[~own]] for x, own in sides], most)


def _walk(rest: list[list[np.ndarray]], most: int) -> tuple[list, list]:
    """Breadth-first over one block, or between two; ``rest`` holds the unreached of each, at home here or not."""
    a, b = [], []
    for start in range(len(rest)):
        while len(rest[start][0]):
            queue, rest[start][0] = [(start, rest[start][0][0], True)], rest[start][0][1:]
            while queue:
                side, now, home_here = queue.pop()
                other = len(rest) - 1 - side
                for away in (0, 1) if home_here else (0,):
                    close = np.bitwise_count(rest[other][away] ^ now) <= most
                    if close.any():
                        found = rest[other][away][close]
                        a += [now] * len(found)
                        b += found.tolist()
                        queue += [(other, x, not away) for x in found]
                        rest[other][away] = rest[other][away][~close]
    return a, b


#: Columns of a member at an anchor: the pair of blocks (i, j) that meet, and whether the member is of block j only.
MEMBER = ("cell", "i", "j", "side", "fp", "home")


def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of each run of rows with one (cell, i, j); small runs of a batch are compared together. Runs are
    two blocks at most, so what waits for the next batch is bounded."""

    def done(cuts: np.ndarray, side: np.ndarray, fp: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        bits = fp.view(np.uint64)
        sizes = np.diff(np.append(cuts, len(fp)))
        left, right = [], []
        for at, n in zip(cuts[sizes > MATRIX].tolist(), sizes[sizes > MATRIX].tolist(), strict=True):
            run, second, at_home = bits[at : at + n], side[at : at + n], own[at : at + n]
            a, b = bridges(run[~second], run[second], at_home[~second], at_home[second]) if second.any() else forest(run, at_home)
            left.append(np.array(a, np.uint64))
            right.append(np.array(b, np.uint64))
        small = np.repeat((sizes > 1) & (sizes <= MATRIX), sizes)
        starts, lengths = np.repeat(cuts, sizes), np.repeat(sizes, sizes)
        homes = np.flatnonzero(small & own)
        for block in np.array_split(homes, max(1, len(homes) * MATRIX // 4_000_000)):
            n = lengths[block]
            i = np.repeat(block, n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[block], n)
            close = (np.bitwise_count(bits[i] ^ bits[j]) <= DISTANCE) & (i != j)
            left.append(bits[i[close]])
            right.append(bits[j[close]])
        a, b = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (left, right))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    held: list[np.ndarray] = []
    for batch in batches:
        rows = [batch.column(k).to_numpy(zero_copy_only=False) for k in MEMBER]
        rows = [np.concatenate(x) for x in zip(held, rows, strict=True)] if held else rows
        if not len(rows[0]):
            continue
        change = np.ones(len(rows[0]), bool)
        change[1:] = np.any([x[1:] != x[:-1] for x in rows[:3]], axis=0)
        cuts = np.flatnonzero(change)
        yield from done(cuts[:-1], *(x[: cuts[-1]] for x in rows[3:]))
        held = [x[cuts[-1] :] for x in rows]  # the last run may go on in the next batch
    if held:
        yield from done(np.zeros(1, np.int64), *held[3:])


def meetings(nodes: DataFrame) -> DataFrame:
    """A row ``MEMBER`` for each anchor of each distinct fingerprint ``fp``, sorted so that those that meet are runs.

    Anchors over ``BLOCK`` members are dealt out: each member gets a block by its hash, and each pair of blocks, a
    block with itself included, is a run of its own. All members still meet, at most about two blocks in a task.
    Fingerprints, 8 bytes each, are dealt out evenly before they are replicated, some 42 times each.
    There are 2**19 anchors at any size of the corpus, so the table of large ones (12 bytes each) may be broadcast
    and counting members is combined before its shuffle."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = nodes.select("fp").repartition(parts).mapInArrow(replicas, "cell long, fp long, home boolean")
    large = cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = cells.join(F.broadcast(large), "cell", "left").withColumn("own", F.coalesce(F.pmod(F.xxhash64("fp"), F.col("blocks")), F.lit(0)).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    runs = dealt.withColumn("pair", F.explode(pairs)).select("cell", "pair.i", "pair.j", (F.col("own") != F.col("pair.i")).alias("side"), "fp", "home")
    return runs.repartition(parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row, fp the fingerprint as a signed long. One Arrow-batched map, no shuffle."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return map_texts(docs, [("fp", "long")], lambda: lambda texts: [[signed(fingerprint(t)) for t in texts]], id_col, text_col)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint hex, component_id) of every row; component_id is the smallest id that links reach.

    Null texts count as empty; texts without words have fingerprint 0 and link like any other. Equal fingerprints
    are one node from the start, so copies never meet as pairs; repeated rows and ids give repeated rows, null ids
    take part but name a component only if it has no other id. An empty table gives an empty table. Anchors get
    distinct fingerprints only, about 45 short rows each, large anchors as pairs of blocks (see ``meetings``); each
    run returns fewer links than members once it is large. Links and components stay distributed and are stored in
    the shared folder. Fingerprints of over ``HOT`` rows, ``rows / HOT`` of them at most, are broadcast with their
    component, so that no task joins one fingerprint's rows alone."""
    store = Stored(docs.sparkSession, "simhash")
    prints, _ = store.put(fingerprints(docs, id_col, text_col).withColumnRenamed(id_col, "id"))
    nodes, _ = store.put(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("rows")))
    labels = connected_components(meetings(nodes).mapInArrow(links, "a long, b long"), store)
    labelled = nodes.join(labels, nodes["fp"] == labels["node"], "left").select("fp", "first", "rows", F.coalesce("component", "fp").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    named_prints, _ = store.put(labelled.join(smallest, "component").select("fp", "rows", "component_id"))
    hot, rest = named_prints.where(F.col("rows") > HOT).drop("rows"), named_prints.where(F.col("rows") <= HOT).drop("rows")
    joined = prints.join(F.broadcast(hot), "fp").union(prints.join(F.broadcast(hot), "fp", "left_anti").join(rest, "fp"))
    return joined.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, in the columns of ``docs``: one of its smallest id, null last.

    A row is known by two hashes of all its columns, not by its id: ids may be null or repeat over other texts. Wholly
    equal rows are of one group and one of them stands for all. Equal rows are combined before the one shuffle of
    the texts, which the selection of groups' first rows then shares."""
    rows, at = positions(docs), docs.columns.index
    h1, h2 = row_hashes(rows)
    rows = rows.withColumns({"h1": h1, "h2": h2})
    own = F.col(f"c{at(id_col)}")
    key = F.struct(own.isNull().alias("none"), own.alias("id"), "h1", "h2").alias("key")
    groups = near_duplicates(rows.select(key, F.col(f"c{at(text_col)}").alias("text")), "key")
    first = groups.select("component_id.h1", "component_id.h2").distinct()
    return named(rows.dropDuplicates(["h1", "h2"]).join(first, ["h1", "h2"], "left_semi"), docs.columns)
