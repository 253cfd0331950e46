"""Format-preserving pseudonyms of personal data by keyed Feistel permutations.

Validated numbers (cards by their check digit, account numbers by theirs, addresses by their octets ...), dates,
e-mail addresses and hexadecimal secrets are permuted within the set of values of their own format, so equal values
get equal pseudonyms in all documents and different values different ones."""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import secrets
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import map_rows, map_texts, named

ROUNDS = 8
#: Digits and letters that are permuted as one value; longer strings take several.
BLOCK = 64
KINDS = ("email", "iban", "secret", "ip", "card", "phone", "ssn", "date")
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

EMAIL = re.compile(r"(?<![\w.%+-])([\w.%+-]+)@((?:[\w-]+\.)+)([^\W\d_]{2,})(?![\w-])")
PATTERNS = {
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)",
    "secret": r"(?<!\w)(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?!\w)",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w(])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.+-])\d{3}(?P<s1>[.-])\d{3}(?P=s1)\d{4}(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "date": r"(?<![\w./-])(?:\d{4}(?P<s2>[./-])\d{1,2}(?P=s2)\d{1,2}|\d{1,2}(?P<s3>[./-])\d{1,2}(?P=s3)\d{4})(?!\w|[./-]\d)",
    "card": r"(?<!\w)(?<!\d\.)(?:\d{13,19}|\d{4}(?P<s4>[ -])\d{4}(?P=s4)\d{4}(?P=s4)\d{4}|\d{4}(?P<s5>[ -])\d{6}(?P=s5)\d{5})(?!\w)",
}
NUMBER = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS.items()))
ONE = {kind: re.compile(pattern) for kind, pattern in PATTERNS.items()}
#: Characters of an account number by country; others are tried from the longest end.
IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, EG=29,
    ES=24, FI=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20,
    LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, LY=25, MC=27, MD=24, ME=22, MK=19, MR=27, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25,
    QA=29, RO=24, RS=22, SA=24, SC=31, SD=18, SE=24, SI=19, SK=24, SM=27, ST=25, SV=28, TL=23, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20,
)
HINT = re.compile("[0-9@]")


class Pseudonyms:
    """Keyed permutations without fixed points: equal inputs give equal outputs, no input gives itself."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _f(self, tag: str, turn: int, value: int, size: int) -> int:
        wide = (size.bit_length() + 128 + 7) // 8
        out = b""
        while len(out) < wide:
            said = value.to_bytes((value.bit_length() + 8) // 8, "big")
            out += hashlib.blake2b(f"{tag}|{turn}|{len(out)}|".encode() + said, key=self.key).digest()
        return int.from_bytes(out[:wide], "big") % size

    def _feistel(self, x: int, a: int, b: int, tag: str, back: bool) -> int:
        left, right = divmod(x, b)
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if turn % 2:
                right = (right + sign * self._f(tag, turn, left, b)) % b
            else:
                left = (left + sign * self._f(tag, turn, right, a)) % a
        return left * b + right

    def _walk(self, x: int, size: int, tag: str, back: bool) -> int:
        a = math.isqrt(size - 1) + 1
        b = -(-size // a)
        while True:  # values outside the format are permuted on until one is inside
            x = self._feistel(x, a, b, tag, back)
            if x < size:
                return x

    def permute(self, x: int, size: int, tag: str) -> int:
        """A keyed permutation of range(size) that is one cycle, so that nothing stays itself (size 2 or more)."""
        if size < 2:
            return x
        tag = f"{tag}|{size}"
        return self._walk((self._walk(x, size, tag, False) + 1) % size, size, tag, True)

    def inverse(self, y: int, size: int, tag: str) -> int:
        """The value that ``permute`` turned into ``y``: whoever holds the key can undo a pseudonym."""
        if size < 2:
            return y
        tag = f"{tag}|{size}"
        return self._walk((self._walk(y, size, tag, False) - 1) % size, size, tag, True)

    def letters(self, text: str, tag: str, hexadecimal: str = "") -> str:
        """Each digit stays a digit and each ASCII letter a letter of its case; other characters stay.

        A run of ``BLOCK`` such characters is one value. Longer texts are permuted run by run, each under the key and
        all that stands before it, so work grows with the length and equal texts still get equal pseudonyms."""
        out, at, before = list(text), [], b""
        for k, c in enumerate(text):
            if _set(c, hexadecimal):
                at.append(k)
                if len(at) == BLOCK:
                    before = self._run(text, out, at, f"{tag}{before.hex()}", hexadecimal, before)
                    at = []
        if at:
            self._run(text, out, at, f"{tag}{before.hex()}", hexadecimal, before)
        return "".join(out)

    def _run(self, text: str, out: list[str], at: list[int], tag: str, hexadecimal: str, before: bytes) -> bytes:
        """Replaces the characters ``at`` these places as one value; returns a digest of all plain ones so far."""
        sets, value, size = [_set(text[k], hexadecimal) for k in at], 0, 1
        for k, s in zip(at, sets, strict=True):
            value, size = value * len(s) + s.index(text[k]), size * len(s)
        value = self.permute(value, size, tag)
        for k, s in zip(reversed(at), reversed(sets), strict=True):
            value, digit = divmod(value, len(s))
            out[k] = s[digit]
        return hashlib.blake2b(before + "".join(text[k] for k in at).encode(), digest_size=16).digest()


def _set(c: str, hexadecimal: str) -> str:
    if hexadecimal and c in "0123456789abcdefABCDEF":
        return "0123456789ABCDEF" if hexadecimal == "upper" else "0123456789abcdef"
    if c in "0123456789":
        return "0123456789"
    if "a" <= c <= "z":
        return "abcdefghijklmnopqrstuvwxyz"
    return "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if "A" <= c <= "Z" else ""


def luhn_digit(payload: str) -> str:
    total = sum(d if k % 2 else d // 5 + 2 * d % 10 for k, d in enumerate(map(int, reversed(payload))))
    return str(-total % 10)


def digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def refill(shape: str, new: str) -> str:
    """``shape`` with its digits replaced by those of ``new``, in order."""
    it = iter(new)
    return "".join(next(it) if c in "0123456789" else c for c in shape)


def card(text: str, p: Pseudonyms) -> str | None:
    own = digits(text)
    if luhn_digit(own[:-1]) != own[-1] or len(set(own)) == 1:
        return None
    payload = str(p.permute(int(own[:-1]), 10 ** (len(own) - 1), "card")).zfill(len(own) - 1)
    return refill(text, payload + luhn_digit(payload))


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def iban(text: str, p: Pseudonyms) -> str | None:
    own = text.replace(" ", "")
    if not 15 <= len(own) <= 34 or iban_check(own[:2], own[4:]) != own[2:4]:
        return None
    rest = p.letters(own[4:], "iban")
    new = iter(own[:2] + iban_check(own[:2], rest) + rest)
    return "".join(c if c == " " else next(new) for c in text)


def ip(text: str, p: Pseudonyms) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255:
        return None
    value = p.permute(int.from_bytes(bytes(octets), "big"), 1 << 32, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


#: Country calling codes of one and two digits; all others have three.
SHORT_CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}


def phone(text: str, p: Pseudonyms) -> str | None:
    """The country code stays; all further digits are permuted, whatever separates them."""
    own = digits(text)
    if not 8 <= len(own) <= 15:
        return None
    code = next((own[:k] for k in (1, 2) if own[:k] in SHORT_CODES), own[:3]) if text[0] == "+" else ""
    rest = own[len(code) :]
    return refill(text, code + str(p.permute(int(rest), 10 ** len(rest), "phone")).zfill(len(rest)))


def ssn(text: str, p: Pseudonyms) -> str | None:
    area, group, serial = text.split("-")
    if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
        return None
    areas = 898  # 001 to 899 but for 666
    k = int(area) - 1 - (int(area) > 666)
    v = p.permute((k * 99 + int(group) - 1) * 9999 + int(serial) - 1, areas * 99 * 9999, "ssn")
    k, group, serial = v // 9999 // 99, v // 9999 % 99 + 1, v % 9999 + 1
    return f"{k + 1 + (k >= 665):03d}-{group:02d}-{serial:04d}"


def date(text: str, p: Pseudonyms) -> str | None:
    """Valid days from 1900 to 2099: year first; day first between points or hyphens; else month first if it can be."""
    a, b, c = re.split(r"[./-]", text)
    first = len(a) == 4
    orders = [(0, 1, 2)] if first else [(2, 0, 1), (2, 1, 0)] if "/" in text else [(2, 1, 0)]
    parts = (a, b, c)
    for order in orders:
        try:
            day = datetime.date(*(int(parts[k]) for k in order)).toordinal()
        except ValueError:
            continue
        if FIRST_DAY <= day <= LAST_DAY:
            new = datetime.date.fromordinal(FIRST_DAY + p.permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date"))
            values = dict(zip(order, (new.year, new.month, new.day), strict=True))
            padded = all(len(x) > 1 for x in parts)
            shown = [str(values[k]).zfill(2) if padded else str(values[k]) for k in range(3)]
            sep = text[len(a)]
            return sep.join(shown)
    return None


def secret(text: str, p: Pseudonyms) -> str | None:
    """Hexadecimal keys: at least one digit and one letter, so that long plain numbers stay."""
    if text.isdigit() or text.isalpha():
        return None
    return p.letters(text, "secret", "upper" if text.upper() == text else "lower")


RULES: dict[str, Callable[[str, Pseudonyms], str | None]] = {"iban": iban, "secret": secret, "ip": ip, "card": card, "phone": phone, "ssn": ssn, "date": date}


def email(m: re.Match, p: Pseudonyms) -> str:
    """Local part and each label of the host but the last are permuted on their own, so hosts stay linked too."""
    hosts = ".".join(p.letters(x, "host") if any(_set(c, '') for c in x) else x for x in m[2][:-1].split("."))
    return f"{p.letters(m[1], 'local')}@{hosts}.{m[3]}"


def ends(kind: str, m: re.Match, p: Pseudonyms, stop: int) -> list[int]:
    """Where the value that begins at ``m`` may end, best first: a match may run on into the value after it.

    Account numbers: at the length of their country, else from the longest end. Phones: +1 after 11 digits, then
    before a valid value of another kind (or a phone without +) that begins inside, then from the longest end."""
    text, start, end = m.string, m.start(), m.end()
    if kind == "iban":
        found = [k for k in range(end, start, -1) if k == end or text[k] == " "]
        return sorted(found, key=lambda k: len(text[start:k].replace(" ", "")) != IBAN_LENGTHS.get(text[start : start + 2]))
    if kind != "phone" or text[start] != "+":
        return [end]
    found = [k for k in range(end, start, -1) if text[k - 1].isdigit() and (k == end or text[k] in " .-")]
    size = {k: len(digits(text[start:k])) for k in found}
    if text[start + 1] == "1":
        found.sort(key=lambda k: size[k] != 11)
        if size[found[0]] == 11:
            return found
    before = [k for k in reversed(found) if 8 <= size[k] <= 15 and text[k : k + 1] == " " and k < end and any((x := ONE[o].match(text, k + 1, stop)) and any(RULES[o](text[k + 1 : e], p) is not None for e in ends(o, x, p, stop)) for o in ONE)]
    return sorted(before, key=lambda k: size[k] < 10) + found


def numbers(text: str, p: Pseudonyms, start: int, stop: int) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the valid values from ``start`` to ``stop``. A match that fails its check at
    all of its ends, and as any other kind, hides nothing: the search goes on after its first character."""
    while m := NUMBER.search(text, start, stop):
        start = m.start() + 1
        for kind in list(ONE)[list(ONE).index(m.lastgroup) :]:
            own = ONE[kind].match(text, m.start(), stop)
            hit = next(((e, new) for e in ends(kind, own, p, stop) if (new := RULES[kind](text[m.start() : e], p)) is not None), None) if own else None
            if hit:
                start = hit[0]
                yield m.start(), start, kind, hit[1]
                break


def pseudonymise(text: str, p: Pseudonyms) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms and what was replaced: (kind, start, end) in the returned text, in order."""
    if not HINT.search(text):
        return text, []
    hits: list[tuple[int, int, str, str]] = []
    if "@" in text:
        hits = [(m.start(), m.end(), "email", email(m, p)) for m in EMAIL.finditer(text)]
    after = 0
    for block in [*hits, (len(text), len(text), "", "")]:  # numbers lie between e-mail addresses
        hits += numbers(text, p, after, block[0])
        after = block[1]
    if not hits:
        return text, []
    out, spans, at, done = [], [], 0, 0
    for start, end, kind, new in sorted(hits):
        out += [text[at:start], new]
        done += start - at
        spans.append((kind, done, done + len(new)))
        done, at = done + len(new), end
    return "".join([*out, text[at:]]), spans


def _each(key: bytes) -> Callable[[list[str]], list]:
    p = Pseudonyms(key)

    def each(texts: list[str]) -> list:
        found = [pseudonymise(t, p) for t in texts]
        counts = [[sum(s[0] == kind for s in spans) for _, spans in found] for kind in KINDS]
        return [[t for t, _ in found], [len(s) for _, s in found], *counts, *([[s[k] for s in spans] for _, spans in found] for k in range(3))]

    return each


def pseudonyms(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_found, n_<kind> ..., kinds, starts, ends) of every row; text carries the pseudonyms and the last
    three arrays say where they stand, in characters.

    A null text stays null with nothing found, and texts without personal data come back unchanged. Numbers that
    fail their check (a wrong check digit, an octet over 255, no such day) are left alone, but not the values beside
    or inside them; a plain number after a phone of unknown length may be taken as its end. Equal values get equal
    pseudonyms under one key, in any separators; no value keeps its own. Long values are permuted in runs of ``BLOCK``
    characters. ``key`` has no default: whoever holds it can undo every pseudonym. Repeated rows give repeated rows; an empty
    table gives an empty table. One Arrow-batched map, no shuffle, no state: a lost task is simply run again."""

    marked = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    counted = [("n_found", "int"), *((f"n_{k}", "int") for k in KINDS), ("kinds", "array<string>"), ("starts", "array<int>"), ("ends", "array<int>")]
    whole = marked.select(F.struct("id", F.col("text").isNull().alias("none")).alias("id"), "text")
    out = map_texts(whole, [("text", "string"), *counted], lambda: _each(key), "id", "text")
    return out.select(F.col("id.id").alias(id_col), F.when(~F.col("id.none"), F.col("text")).alias(text_col), *(n for n, _ in counted))


def replaced(docs: DataFrame, key: bytes, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` in its columns with pseudonyms in the text; ``length_col``, where there is one, says its characters.
    Null texts stay null, and their length as it was."""
    at = docs.columns.index(text_col)
    out = map_rows(docs.withColumn("\0none", F.col(text_col).isNull()), text_col, [("new", "string")], lambda: lambda texts, each=_each(key): each(texts)[:1], text=False)
    none = F.col(f"c{len(docs.columns)}")
    instead = {f"c{at}": F.when(~none, F.col("new"))}
    if length_col in docs.columns:
        own = f"c{docs.columns.index(length_col)}"
        instead[own] = F.when(none, F.col(own)).otherwise(F.length("new").cast(docs.schema[length_col].dataType))
    return named(out, docs.columns, **instead)


_DRAWN: dict[str, bytes] = {}


def corpus_key(docs: DataFrame, text_col: str = "text") -> bytes:
    """A key that follows from all texts together: runs over the same corpus agree, and who doesn't hold the corpus can't
    derive it. One pass of native hashes; order and partitions don't matter."""
    parts = [F.xxhash64(F.lit(k), F.coalesce(docs[text_col].cast("string"), F.lit(""))).cast("decimal(38,0)") for k in range(4)]
    found = docs.agg(F.count("*"), *(F.sum(p) for p in parts)).first()
    return hashlib.sha256(repr([int(x or 0) for x in found]).encode()).digest()


def session_key(spark: SparkSession) -> bytes:
    """The key in ``spark.ridgeline.pii.key``. Where it is unset, one is drawn for the application and kept in the
    driver alone: values stay linked within it and nobody can undo them; name a key to link several runs."""
    named_key = spark.conf.get("spark.ridgeline.pii.key", None)
    return named_key.encode() if named_key else _DRAWN.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))
