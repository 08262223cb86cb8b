"""Secret scans with structural confirmation.

Three plain patterns (assigned values, access ids, long hex) are always reported. Beside them, base64 and hex
candidates are decoded step by step, as far as their next length, and those are reported whose bytes parse as a private
key (nested DER lengths that fit to the last byte, also of an encrypted key, or the length-prefixed fields of an OpenSSH
key), also if they are wrapped over lines or stand behind other characters of the alphabet. No length is asked for but what
the structure has. Signed tokens are reported whose header and payload are JSON objects and whose header names an algorithm.
Every line is looked at once, so the work grows with the text's length, whatever it holds.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

#: Kinds in the order in which spans of one start are listed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "key", "signed")
REDACTED = "[SECRET]"

# Fixed values of the three plain patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run, so the same as [0-9a-f]+ of 16 and more

# Where a key may begin: a DER sequence or the magic of an OpenSSH key, at any place of a run of the encoding's characters.
BEGINS = re.compile(r"M(?=[A-P\s\\])")
BEGINS_SSH = re.compile("b3BlbnNz")
BEGINS_HEX = re.compile(r"30(?=[0-9A-Fa-f]{2})|6f70656e737368", re.I)
#: A line of base64 or hex, and what may stand between two lines of it.
LINE, HEX_LINE = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"[0-9A-Fa-f]+")
BREAK = re.compile(r"[\x20\t]*(?:\r\n|\n|\r|\\r\\n|\\n)[\x20\t]*")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----([A-Za-z0-9+/=\s\\]+)-----END \1-----")
SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{10,})\.(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")

#: Algorithms whose sequence with bytes is a digest and no encrypted key: SHA-1, SHA-2 and SHA-3, MD2 to MD5.
DIGESTS = (bytes.fromhex("2b0e03021a"), bytes.fromhex("6086480165030402"), bytes.fromhex("2a864886f70d02"))

INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30
SSH_MAGIC = b"openssh-key-v1\0"
#: A private key's sequence has no more items than this: nine numbers and one list of further primes.
MOST_ITEMS = 10

#: read(at, n): n bytes of what may be a key, or None if it ends before.
Read = Callable[[int, int], bytes | None]


def der_item(read: Read, at: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the content of the item at a byte."""
    head = read(at, 2)
    if head is None:
        return None
    length, at = head[1], at + 2
    if length >= 0x80:
        n = length & 0x7F
        size = read(at, n) if 1 <= n <= 4 else None
        if size is None:
            return None
        length, at = int.from_bytes(size, "big"), at + n
    return head[0], at, at + length


def der_items(read: Read, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The items that fill the bytes from ``at`` to ``end``, or None; also if a key can't begin so or has fewer."""
    out: list[tuple[int, int, int]] = []
    while at < end:
        item = der_item(read, at)
        if item is None or item[2] > end or len(out) == MOST_ITEMS:
            return None
        if not out and not (item[0] in (SEQUENCE, OID) or item[0] == INTEGER and item[2] - item[1] == 1 and read(item[1], 1) in (b"\0", b"\1")):
            return None
        out.append(item)
        at = item[2]
    return out


def der_size(read: Read) -> int | None:
    """The size of a private key in DER that begins with the first byte, or None."""
    outer = der_item(read, 0)
    if outer is None or outer[0] != SEQUENCE or not (items := der_items(read, *outer[1:])):
        return None
    tags = [t for t, _, _ in items]
    sizes = [b - a for _, a, b in items]
    names = lambda k: inner if (inner := der_items(read, *items[k][1:])) and inner[0][0] == OID else None
    if tags == [SEQUENCE, OCTETS]:  # encrypted: an algorithm and the bytes
        inner = names(0)
        found = bool(inner) and not (read(inner[0][1], min(inner[0][2] - inner[0][1], 16)) or b"").startswith(DIGESTS) and sizes[1] >= 16
    elif tags[0] != INTEGER:
        found = False
    elif set(tags) == {INTEGER}:
        found = len(tags) >= 6
    elif tags[1] == OCTETS:
        found = sizes[1] in range(16, 80)
    else:
        found = set(tags[:9]) == {INTEGER} and len(tags) == 10 and tags[9] == SEQUENCE or len(tags) >= 3 and tags[1:3] == [SEQUENCE, OCTETS] and bool(names(1))
    return outer[2] if found and read(outer[2] - 1, 1) is not None else None


class Walks:
    """Fields with a length before them, one after the other. What an earlier walk has passed is not walked again."""

    def __init__(self):
        self.passed: dict[int, tuple[list[int], int]] = {}

    def after(self, read: Read, at: int, fields: int, base: int) -> int | None:
        """The byte behind so many fields, or None; ``base`` is the bit at which the first byte stands."""
        own = [base + 8 * at]
        while fields and own[-1] not in self.passed:
            size = read((own[-1] - base) // 8, 4)
            if size is None:
                break
            own.append(own[-1] + 32 + 8 * int.from_bytes(size, "big"))
            fields -= 1
        last = own[-1]
        while fields and last in self.passed:
            steps, k = self.passed[last]
            far = min(fields, len(steps) - 1 - k)
            last, fields = steps[k + far], fields - far
            if not far:
                break
        for k, place in enumerate(own[:-1]):
            self.passed[place] = (own, k)
        return None if fields else (last - base) // 8


def ssh_size(read: Read, walks: Walks, base: int) -> int | None:
    """The size of an OpenSSH key: its magic, three fields, a number, so many public keys, and the private ones."""
    if read(0, len(SSH_MAGIC)) != SSH_MAGIC:
        return None
    at = walks.after(read, len(SSH_MAGIC), 3, base)
    count = None if at is None else read(at, 4)
    end = None if count is None else walks.after(read, at + 4, int.from_bytes(count, "big") + 1, base)
    return end if end is not None and read(end - 1, 1) is not None else None


def key_size(read: Read, walks: Walks, base: int = 0) -> int | None:
    return der_size(read) if read(0, 1) == b"\x30" else ssh_size(read, walks, base)


def is_key(data: bytes) -> bool:
    return key_size(lambda at, n: data[at : at + n] if at + n <= len(data) else None, Walks()) == len(data)


def decoded(text: str) -> bytes | None:
    """The bytes of a base64 text in either alphabet, with or without its padding."""
    core = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(core) % 4 == 1:
        return None
    try:
        return base64.b64decode(core + "=" * (-len(core) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


class Stretch:
    """The characters of an encoding from a place of a text on, over ends of lines. Each line is looked for once."""

    def __init__(self, text: str, start: int, line: re.Pattern):
        self.text, self.line, self.next, self.open = text, line, start, True
        self.places: list[int] = []
        self.offsets: list[int] = []
        self.size, self.walks = 0, Walks()

    def reach(self, size: int) -> bool:
        """Whether it has so many characters."""
        while self.open and self.size < size:
            m = self.line.match(self.text, self.next)
            if m is None:
                self.open = False
                break
            self.places.append(m.start())
            self.offsets.append(self.size)
            self.size += m.end() - m.start()
            gap = BREAK.match(self.text, m.end())
            self.open, self.next = gap is not None, gap.end() if gap else m.end()
        return self.size >= size

    def offset(self, place: int) -> int | None:
        """Which of its characters stands at a place of the text."""
        while self.open and self.next <= place:
            self.reach(self.size + 1)
        k = bisect_right(self.places, place) - 1
        at = self.offsets[k] + place - self.places[k]
        return at if at < (self.offsets[k + 1] if k + 1 < len(self.offsets) else self.size) else None

    def place(self, offset: int) -> int:
        k = bisect_right(self.offsets, offset) - 1
        return self.places[k] + offset - self.offsets[k]

    def characters(self, a: int, b: int) -> str:
        """Those from a to b; at the end fewer."""
        self.reach(b)
        parts, k = [], bisect_right(self.offsets, a) - 1
        while k < len(self.offsets) and self.offsets[k] < min(b, self.size):
            end = self.offsets[k + 1] if k + 1 < len(self.offsets) else self.size
            x, y = max(a, self.offsets[k]), min(b, end)
            parts.append(self.text[self.places[k] + x - self.offsets[k] : self.places[k] + y - self.offsets[k]])
            k += 1
        return "".join(parts)


def base64_reader(stretch: Stretch, start: int) -> Read:
    def read(at: int, n: int) -> bytes | None:
        first = at // 3
        if not stretch.reach(start + -(-(at + n) * 4 // 3)):
            return None
        found = decoded(stretch.characters(start + 4 * first, start + -(-(at + n) // 3) * 4))
        return found[at - 3 * first :][:n] if found is not None and len(found) >= at - 3 * first + n else None

    return read


def hex_reader(stretch: Stretch, start: int) -> Read:
    return lambda at, n: bytes.fromhex(stretch.characters(start + 2 * at, start + 2 * (at + n))) if stretch.reach(start + 2 * (at + n)) else None


def keys(text: str, starts: list[int], line: re.Pattern, reader: Callable[[Stretch, int], Read], bits: int) -> list[tuple[int, int]]:
    """(start, end) of the keys that begin at some of the places ``starts``: what a key says of its lengths tells where it
    ends, and there its run of characters must end, too. The first of overlapping keys is taken."""
    out, done, stretch = [], 0, None
    for start in starts:
        if start < done:
            continue
        offset = stretch.offset(start) if stretch else None
        if offset is None:
            stretch, offset = Stretch(text, start, line), 0
        size = key_size(reader(stretch, offset), stretch.walks, bits * offset)
        if size is None:
            continue
        long = -(-size * 8 // bits)
        end = stretch.place(offset + long - 1) + 1
        if line.match(text, end):
            continue
        pad = 0
        while bits == 6 and pad < -long % 4 and text[end : end + 1] == "=":
            end, pad = end + 1, pad + 1
        out.append((start, end))
        done = end
    return out


def json_object(segment: str) -> dict | None:
    try:
        found = json.loads(decoded(segment) or b"")
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_signed(head: str, body: str, signature: str) -> bool:
    header = json_object(head)
    if header is None or not isinstance(header.get("alg"), str) or json_object(body) is None:
        return False
    return header["alg"].lower() == "none" or len(decoded(signature) or b"") >= 16


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a text's secrets in code points, end exclusive, by start and then kind."""
    if not text:
        return []
    out = []
    if "=" in text or ":" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        out += [("pem", *m.span()) for m in PEM.finditer(text) if is_key(decoded(re.sub(r"\\n|\\r|\s", "", m[2])) or b"")]
    pems = [(a, b) for k, a, b in out if k == "pem"]
    starts = [m.start() for m in BEGINS.finditer(text)]
    if "b3BlbnNz" in text:
        starts = sorted(starts + [m.start() for m in BEGINS_SSH.finditer(text)])
    found = keys(text, starts, LINE, base64_reader, 6)
    found += keys(text, [m.start() for m in BEGINS_HEX.finditer(text)], HEX_LINE, hex_reader, 4)
    for a, b in found:
        k = bisect_right(pems, (a, len(text))) - 1
        if k < 0 or b > pems[k][1]:
            out.append(("key", a, b))
    if "eyJ" in text:
        out += [("signed", *m.span()) for m in SIGNED.finditer(text) if is_signed(*m.groups())]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


@F.pandas_udf(T.ArrayType(SPAN))
def scan(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in spans(t)] for t in texts])


@F.pandas_udf(T.StringType())
def redact(texts: pd.Series) -> pd.Series:
    """Texts with each group of overlapping spans replaced by REDACTED; a null text stays null."""
    out = []
    for text in texts:
        found = spans(text)
        if found:
            parts, at = [], 0
            for _, start, end in found:
                if start >= at:
                    parts += [text[at:start], REDACTED]
                at = max(at, end)
            text = "".join(parts) + text[at:]
        out.append(text)
    return pd.Series(out, dtype=object)


def find_secrets(docs: DataFrame, into: str = "secrets") -> DataFrame:
    """``docs`` with the array column ``into`` of (kind, start, end); a column of that name is replaced.

    Null and empty texts have no secrets; very long ones are looked at whole, in one piece. Rows are looked at one by
    one, so repeated rows, ties and other columns make no difference; an empty table stays one. Nothing is shuffled.
    """
    return docs.withColumn(into, scan(F.col("text")))


def listed(found: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret replaced by REDACTED; a column n_chars is counted anew.

    Null and empty texts stay as they are, very long ones are looked at whole, an empty table stays one, and repeated
    rows and other columns are kept.
    """
    out = docs.withColumn("text", redact(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
