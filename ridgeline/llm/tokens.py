"""Exact token counts at every prefix of a text, by dynamic programming over a BPE vocabulary with word ends.

A sequence of tokens is what greedy merging gives exactly when each neighbouring pair merges to itself. So the
last token of each prefix of a word, and with it the number of tokens, follows from shorter prefixes: the table
answers truncation and budget questions without encoding again."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from itertools import accumulate, islice, takewhile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import Remembered, map_texts

END = "</w>"
#: Bytes that a worker remembers of runs between white space, of words and of words' prefix tables.
CHUNKS, WORDS, PREFIXES = 96 << 20, 96 << 20, 32 << 20
#: Pairs of tokens whose meeting is remembered.
PAIRS = 400_000
#: Fixed values of the vocabulary's pre-tokeniser, for characters below U+0180 after lower-casing.
LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ſ"
NUMBERS = "0-9²³¹¼-¾"
#: Texts of these characters only need no library to normalise and split (without the two that lower-case unevenly).
PLAIN = re.compile(r"[\t-\r\x20-įı-ſ]*")
WHITE = re.compile("([\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+)")
RUNS = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
PIECE = re.compile(rf"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]


@lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """Characters that may compose with one before them: marks, second parts of canonical compositions, Hangul vowels and
    finals. Characters whose decomposition begins with one are among them."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    second = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")} | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    return frozenset(c for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if (d := unicodedata.normalize("NFD", c)[0]) in second or unicodedata.combining(d))


def segments_of(chunk: str) -> list[str]:
    """The text cut before each character that can't compose with what stands before it."""
    joining = _joining()
    at = [0, *(i for i in range(1, len(chunk)) if chunk[i] not in joining), len(chunk)]
    return [chunk[a:b] for a, b in zip(at, at[1:], strict=False)]


class Chunks(Remembered):
    """Run between white space -> its tokens; bounded."""

    def __init__(self, counter: PrefixCounter):
        super().__init__(CHUNKS)
        self.counter = counter

    def __missing__(self, chunk: str) -> int:
        if (found := self.again(chunk)) is not None:
            return found
        own = chunk.lower()
        return self.keep(chunk, self.counter.word(own) if own.isascii() and own.isalpha() else sum(map(self.counter.word, map(self.counter.mapped, PIECE.findall(own)))))


class Tables(Remembered):
    """Word -> its prefix table; bounded."""

    def size_of(self, table: list[int]) -> int:
        return 64 + 8 * len(table)


class PrefixCounter:
    """Token counts by the ``tokenizers`` file at ``path`` (BPE with word ends), without added special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab = spec["model"]["vocab"]
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(spec["model"]["merges"])}
        self.longest = max(map(len, self.vocab))
        self.special = re.compile("(" + "|".join(re.escape(x["content"]) for x in spec["added_tokens"]) + ")")
        self.letters = byte_letters()
        #: Tokens inside and at the end of words (without the mark of the end) -> whether they are whole, None: unknown.
        self.inside = dict.fromkeys(t for t in self.vocab if not t.endswith(END))
        self.ends = dict.fromkeys(t[: -len(END)] for t in self.vocab if t.endswith(END) and t != END)
        #: left token -> right token -> whether they stand side by side
        self.after: dict[str, dict[str, bool]] = {}
        self.after_end: dict[str, dict[str, bool]] = {}
        self.pairs = 0
        self.words, self.tables = Remembered(WORDS), Tables(PREFIXES)
        self.chunks = Chunks(self)

    def merged(self, parts: list[str]) -> list[str]:
        """The parts after greedy merging, lowest rank and then leftmost first."""
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 40))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts = [*parts[:best], parts[best] + parts[best + 1], *parts[best + 2 :]]
        return parts

    def symbols(self, token: str) -> list[str]:
        return [*token[: -len(END) - 1], token[-len(END) - 1 :]] if token.endswith(END) and len(token) > len(END) else [*token]

    def fits(self, left: str, right: str, suffix: str = "") -> bool:
        """Whether merging leaves the two tokens side by side; remembered, ``PAIRS`` of them at most."""
        self.pairs += 1
        if self.pairs > PAIRS:
            self.after.clear()
            self.after_end.clear()
            self.pairs = 1
        known = self.merged([*self.symbols(left), *self.symbols(right + suffix)]) == [left, right + suffix]
        (self.after_end if suffix else self.after).setdefault(left, {})[right] = known
        return known

    def whole(self, token: str, suffix: str = "") -> bool:
        """Whether a token of the vocabulary is what its own letters merge to."""
        known = self.merged(self.symbols(token + suffix)) == [token + suffix]
        (self.ends if suffix else self.inside)[token] = known
        return known

    def _inner(self, mapped: str) -> tuple[list[str], list[int]]:
        """Last token and number of tokens of each proper prefix, as the beginning of a longer word."""
        last, inner, inside, after = [""], [0], self.inside, self.after
        for j in range(1, len(mapped)):
            for i in range(j - 1, max(-1, j - self.longest - 1), -1):
                token = mapped[i:j]
                if token in inside:
                    if not (inside[token] or inside[token] is None and self.whole(token)):
                        continue
                    if i:
                        left = last[i]
                        good = after[left].get(token) if left in after else None
                        if not (self.fits(left, token) if good is None else good):
                            continue
                    last.append(token)
                    inner.append(inner[i] + 1)
                    break
            else:
                raise ValueError(f"the vocabulary can't spell {mapped[:j]!r}")
        return last, inner

    def _end(self, mapped: str, j: int, last: list[str], inner: list[int]) -> int:
        """Tokens of ``mapped[:j]`` as a word, given the tables of its proper prefixes."""
        ends, after = self.ends, self.after_end
        for i in range(j - 1, max(-1, j - self.longest - 1), -1):
            token = mapped[i:j]
            if token in ends:
                if not (ends[token] or ends[token] is None and self.whole(token, END)):
                    continue
                if i:
                    left = last[i]
                    good = after[left].get(token) if left in after else None
                    if not (self.fits(left, token, END) if good is None else good):
                        continue
                return inner[i] + 1
        raise ValueError(f"the vocabulary can't spell {mapped[:j]!r}")

    def word(self, mapped: str) -> int:
        """Tokens of a word in byte letters: the last entry of its prefix table."""
        if (known := self.words.get(mapped)) is not None or (known := self.words.again(mapped)) is not None:
            return known
        return self.words.keep(mapped, self._end(mapped, len(mapped), *self._inner(mapped)))

    def word_prefixes(self, mapped: str) -> list[int]:
        """Tokens of each prefix of a word as a word of its own."""
        if (known := self.tables.get(mapped)) is not None or (known := self.tables.again(mapped)) is not None:
            return known
        last, inner = self._inner(mapped)
        return self.tables.keep(mapped, [self._end(mapped, j, last, inner) for j in range(1, len(mapped) + 1)], 64 + 8 * len(mapped))

    def mapped(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isprintable() and " " not in piece else "".join(self.letters[b] for b in piece.encode())

    def pieces(self, text: str) -> list[str]:
        """The words of a text without special strings, in byte letters."""
        if PLAIN.fullmatch(text):
            return [self.mapped(p) for p in PIECE.findall(text.lower())]
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def count(self, text: str) -> int:
        """Tokens of the whole text: the last entry of its prefix table. Words don't cross white space, so plain
        texts look up each distinct run between white space once."""
        if "<|" in text and self.special.search(text):
            return sum(k % 2 or self.count(part) for k, part in enumerate(self.special.split(text)))
        if PLAIN.fullmatch(text):
            return sum(map(self.chunks.__getitem__, text.split()))
        return sum(map(self.word, self.pieces(text)))

    def prefixes(self, text: str) -> np.ndarray:
        """Exact token count of ``text[:i]`` for i = 0 ... len(text), in code points of the text itself.

        Until its last character a special string is ordinary text, joined to what stands before it."""
        out, parts = [0], self.special.split(text)
        for k in range(0, len(parts), 2):
            special = parts[k + 1] if k + 1 < len(parts) else ""
            own = self._ordinary(parts[k] + special[:-1])
            base, end = out[-1], own[len(parts[k]) - 1] if parts[k] else 0
            out += [base + n for n in own]
            if special:
                out.append(base + end + 1)
        return np.array(out, np.int64)

    def _ordinary(self, text: str) -> list[int]:
        """Tokens of each prefix of a text without special strings. Runs between white space don't touch."""
        out: list[int] = []
        for chunk in WHITE.split(text):
            base = out[-1] if out else 0
            if WHITE.fullmatch(chunk):
                out += [base] * len(chunk)
            elif chunk:
                out += [base + n for n in self._run(chunk)]
        return out

    def _run(self, chunk: str) -> list[int]:
        """Tokens of each prefix of a run between white space. Prefixes of a composed (NFC) run are composed, and each
        character is lower-cased on its own, so all follow from one table of the normalised run."""
        if PLAIN.fullmatch(chunk):
            own = chunk.lower()
            return self._table(own, [m.span() for m in PIECE.finditer(own)])
        lowered = [c.lower() for c in chunk]
        own = "".join(lowered)
        if not unicodedata.is_normalized("NFC", chunk) or self.library.normalizer.normalize_str(chunk) != own:
            return self._decomposed(chunk)
        table, at, out = self._table(own, [span for _, span in self.library.pre_tokenizer.pre_tokenize_str(own)]), 0, []
        for c in lowered:
            at += len(c)
            out.append(table[at - 1])
        return out

    def _decomposed(self, chunk: str) -> list[int]:
        """Tokens of each prefix of a run that isn't composed. It is normalised in segments that don't compose with one
        another; a prefix is whole segments and the beginning of one. Where that beginning normalises to a prefix of its
        segment, the table of the whole run has its count; else the word that it touches is continued from the state of
        the table. Only within a segment, a letter and its marks, does the cost rise with the square of the length."""
        normal = lru_cache(maxsize=4096)(self.library.normalizer.normalize_str)
        segments, own = segments_of(chunk), []
        own = [normal(x) for x in segments]
        text = "".join(own)
        spans = [span for _, span in self.library.pre_tokenizer.pre_tokenize_str(text)]
        table, out, at, k = self._table(text, spans), [], 0, 0
        state: dict[int, tuple] = {}
        for segment, full in zip(segments, own, strict=True):
            while k + 1 < len(spans) and spans[k + 1][0] < at:
                k += 1  # the word that holds the character before this segment
            for m in range(1, len(segment) + 1):
                part = full if m == len(segment) else normal(segment[:m])
                out.append(table[at + len(part) - 1] if text.startswith(part, at) else self._branch(text, at, part, table, spans[k], k > 0 and spans[k - 1][1] - spans[k - 1][0] == 1, state))
            at += len(full)
        return out

    def _branch(self, text: str, at: int, part: str, table: list[int], span: tuple[int, int], quoted: bool, state: dict[int, tuple]) -> int:
        """Tokens of ``text[:at] + part``; ``span`` is the word of ``text`` with the character before ``at``. ``quoted``: the
        word before it is a single character."""
        if not at:
            return self.count(part)
        begin = span[0]
        if at - begin < 4:  # "'s" and its like split unlike their parts: from the quote on, if one stands there
            begin -= begin > 0 and text[begin - 1] == "'" and quoted
            base = table[begin - 1] if begin else 0
            return base + sum(self.word(p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text[begin:at] + part))
        start = at - 1
        while start > span[0] and text[start] == "'":  # a quote inside a word must not look like the beginning of one
            start -= 1
        pieces = self.library.pre_tokenizer.pre_tokenize_str(text[start:at] + part)
        joined = pieces[0][1][1] - (at - start)  # characters of ``part`` that continue the word
        rest = sum(self.word(p) for p, _ in pieces[1:])
        if joined <= 0:
            return table[at - 1] + sum(self.word(p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(part))
        if begin not in state:
            state.clear()  # words come in order
            mapped = self.mapped(text[slice(*span)])
            last, inner = self._inner(mapped)
            state[begin] = mapped, last, inner, [0, *accumulate(len(c.encode()) for c in text[slice(*span)])]
        mapped, last, inner, sizes = state[begin]
        k = sizes[at - begin]
        low = max(0, k - self.longest)
        return (table[begin - 1] if begin else 0) + self._continued(mapped[low:k], last[low : k + 1], inner[low : k + 1], self.mapped(part[:joined]), low == 0) + rest

    def _continued(self, before: str, last: list[str], inner: list[int], tail: str, whole: bool) -> int:
        """Tokens of a word that ends in ``before + tail``, from the last tokens and counts of its prefixes up to
        ``before`` (the last one may be missing where the word ended there). ``whole``: ``before`` is all before it."""
        text = before + tail

        def first(j: int, tokens: dict, known: dict, suffix: str) -> tuple[str, int]:
            for i in range(j - 1, max(-1, j - self.longest - 1), -1):
                token = text[i:j]
                if token in tokens and (tokens[token] or tokens[token] is None and self.whole(token, suffix)):
                    if i or not whole:
                        good = known.get(last[i], {}).get(token)
                        if not (self.fits(last[i], token, suffix) if good is None else good):
                            continue
                    return token, inner[i] + 1
            raise ValueError(f"the vocabulary can't spell {text[:j]!r}")

        for j in range(len(last), len(text)):
            token, n = first(j, self.inside, self.after, "")
            last.append(token)
            inner.append(n)
        return first(len(text), self.ends, self.after_end, END)[1]

    def _table(self, text: str, spans: list[tuple[int, int]]) -> list[int]:
        """Tokens of each prefix of a normalised run that is cut into words at ``spans``."""
        out, total = [], 0
        for start, stop in spans:
            piece = text[start:stop]
            counts = self.word_prefixes(self.mapped(piece))
            out += [total] * (start - len(out))
            if piece.isascii():
                out += [total + n for n in counts]
            else:
                at = 0
                for c in piece:
                    at += len(c.encode())
                    out.append(total + counts[at - 1])
            if piece[0] == "'" and len(piece) > 2:  # a cut "'r" or "'v" or "'l" splits as quote and letter
                out[start + 1] = total + self.count(piece[:2])
            total += counts[-1]
        return out + [total] * (len(text) - len(out))

    def within(self, text: str, tokens: int, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens, given the whole text's ``tokens``. Counts only
        rise from one run between white space to the next, so the prefix ends in the first run that goes beyond the
        budget, and that run's prefix table alone is needed."""
        if tokens <= budget:
            return len(text)
        total, best, at, parts = 0, 0, 0, self.special.split(text) if "<|" in text else [text]
        for k in range(0, len(parts), 2):
            before, first = total, 0  # tokens before the last run of this part, and where that begins
            each = map(self.chunks.__getitem__, parts[k].split()) if PLAIN.fullmatch(parts[k]) else (self.count(m[0]) for m in RUNS.finditer(parts[k]))
            counts = list(takewhile(lambda n: n <= budget, accumulate(each, initial=total)))
            fit = len(counts) - 1  # runs that fit
            last = next(islice(RUNS.finditer(parts[k]), fit, None), None)
            if last is not None:
                # a token spells ``longest`` bytes at most, and four characters compose to one at most: no more can fit
                most = 4 * (budget - counts[fit] + 1) * self.longest
                inside = [i for i, c in enumerate(self._run(last[0][:most]), 1) if counts[fit] + c <= budget]
                return max(best, at + last.start() + (inside[-1] if inside else 0))
            if fit:
                before, first, total = counts[fit - 1], next(islice(RUNS.finditer(parts[k]), fit - 1, None)).start(), counts[fit]
            best = at + len(parts[k])
            if k + 1 == len(parts):
                return best
            tail = parts[k][first:]
            own = self._ordinary(tail + parts[k + 1][:-1])[len(tail) :]  # a special string that is cut is ordinary text
            best = max([best, *(best + i for i, c in enumerate(own, 1) if (before if tail else total) + c <= budget)])
            at, total = at + len(parts[k]) + len(parts[k + 1]), total + 1
            if total > budget:
                return best
            best = at
        return best


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, limit_chars) of every row: the last entry of its text's prefix table, and
    the longest prefix, in characters, of ``limit`` tokens at most (the whole text where that fits).

    Null texts count as empty: 0 bytes, 0 tokens, 0 characters. Repeated rows give repeated rows; an empty table gives
    an empty table. One Arrow-batched map, no shuffle; a worker keeps tables of distinct words, bounded in bytes.
    ``path`` must be readable on each executor (a package file of the environment)."""

    def work():
        own = counter(path)

        def each(texts: list[str]) -> list:
            n = list(map(own.count, texts))
            return [[len(t.encode()) for t in texts], n, [own.within(t, k, limit) for t, k in zip(texts, n, strict=True)]]

        return each

    counted = map_texts(docs, [("n_bytes", "long"), ("n_tokens", "long"), ("limit_chars", "long")], work, id_col, text_col)
    return counted.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "limit_chars")


def prefix_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts): counts[i] is the exact token count of the first i characters; see ``PrefixCounter.prefixes``."""

    def work():
        prefixes = counter(path).prefixes
        return lambda texts: [[prefixes(t).tolist() for t in texts]]

    return map_texts(docs, [("counts", "array<long>")], work, id_col, text_col)


def within_budget(table: DataFrame, budget: int) -> DataFrame:
    """``table`` with ``n_chars``: the longest prefix, in characters, whose token count is at most ``budget``."""
    last = F.aggregate(F.transform("counts", lambda c, i: F.when(c <= budget, i).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    return table.withColumn("n_chars", last.cast("long"))
