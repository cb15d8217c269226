"""Secret scans: keyword automaton first, anchored expressions near its hits, then checksums.

One pass of an Aho-Corasick automaton over the lower-cased bytes finds every keyword at once; an
expression is tried only at the place of its keyword. Kinds with a self-check (the CRC-32 in
GitHub and npm tokens, the header of a JSON web token, the length field of a PEM key) are reported
only if it holds. A keyword-free kind, long runs of lower-case hex digits, is anchored on the byte
classes of the text in the same way. Documents are independent, so nothing is shuffled.

Defined results: a NULL or empty text has no spans; texts are searched whole, whatever their
length; repeated rows and NULL ids are rows like any other; other columns are ignored by ``scan``
and kept by ``redact``.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varstrip.llm.text import raw

# The kinds and expressions of the contract, then those with embedded checks.
KINDS = ["assign", "access", "hex", "github", "npm", "jwt", "pem"]
BASE_KINDS = 3
ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
GITHUB = re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
JWT = re.compile(rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
PEM = re.compile(rb"-----BEGIN ([A-Z ]{0,20})PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----")
KEYWORDS = {
    "password": 0, "passwd": 0, "secret": 0, "token": 0, "apikey": 0, "api_key": 0, "akia": 1,
    "ghp_": 3, "gho_": 3, "ghu_": 3, "ghs_": 3, "ghr_": 3, "npm_": 4, "eyj": 5, "-----begin ": 6,
}
# A token's first part; whether the rest follows does not depend on where in it the token starts.
JWT_RUN = re.compile(rb"[A-Za-z0-9_-]+")
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24


def base62(number: int, width: int) -> bytes:
    digits = []
    for _ in range(width):
        number, r = divmod(number, 62)
        digits.append(BASE62[r])
    return bytes(reversed(digits))


def _crc_holds(m: re.Match) -> bool:
    """The last six characters are the CRC-32 of the thirty before them, in base 62."""
    body = m[0][4:]
    return base62(zlib.crc32(body[:-6]), 6) == body[-6:]


def _header_holds(m: re.Match) -> bool:
    head = m[0].split(b".", 1)[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except (ValueError, TypeError):
        return False


def _length_holds(m: re.Match) -> bool:
    """The DER sequence inside says how long it is."""
    try:
        der = base64.b64decode(b"".join(m[2].split()), validate=True)
    except ValueError:
        return False
    if len(der) < 4 or der[0] != 0x30:
        return False
    if der[1] < 0x80:
        return len(der) == 2 + der[1]
    n = der[1] & 0x7F
    return len(der) == 2 + n + int.from_bytes(der[2 : 2 + n], "big")


# Expression and test of every kind that a keyword announces.
RULES = {
    0: (ASSIGN, lambda m: len(m[1]) >= MIN_ASSIGN),
    1: (ACCESS, lambda m: len(m[0]) >= MIN_ACCESS),
    3: (GITHUB, _crc_holds),
    4: (NPM, _crc_holds),
    5: (JWT, _header_holds),
    6: (PEM, _length_holds),
}
_HEX_CLASS = bytes(0x68 if c in b"0123456789abcdef" else 0x2E for c in range(256))
_HEX_RUN = b"h" * MIN_HEX
_automaton: list = []


def automaton() -> ahocorasick.Automaton:
    """The keyword automaton, built once per worker."""
    if not _automaton:
        a = ahocorasick.Automaton()
        for word, kind in KEYWORDS.items():
            a.add_word(word, (kind, len(word)))
        a.make_automaton()
        _automaton.append(a)
    return _automaton[0]


def scan_bytes(data: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every secret in bytes of UTF-8, sorted; offsets in bytes."""
    found = []
    free = [0] * len(KINDS)  # where the next match of a kind may start
    for end, (kind, size) in automaton().iter(data.lower().decode("latin-1")):
        start = end - size + 1
        if start < free[kind]:
            continue
        expression, holds = RULES[kind]
        m = expression.match(data, start)
        if m:
            free[kind] = m.end()
            if holds(m):
                found.append((start, kind, m.end()))
        elif expression is JWT:
            free[kind] = JWT_RUN.match(data, start).end()
    classes = data.translate(_HEX_CLASS)
    start = classes.find(_HEX_RUN)
    while start >= 0:
        end = HEX.match(data, start).end()
        found.append((start, 2, end))
        start = classes.find(_HEX_RUN, end)
    return sorted(found)


def in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans with offsets in code points."""
    if not spans or data.isascii():
        return spans
    marks = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [(int(marks[s]), k, int(marks[e])) for s, k, e in spans]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, at = raw(column)
    whole = data.tobytes()
    for i in range(len(at) - 1):
        yield whole[at[i] : at[i + 1]]


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for data in _texts(batch.column(1)):
            spans = in_code_points(data, scan_bytes(data))
            rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(_SPAN))], names=["doc_id", "spans"])


def scan(documents: DataFrame) -> DataFrame:
    """Secrets of every document: doc_id and spans (kind, start, end in code points) in order."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_scan_batches, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def masked(data: bytes) -> bytes:
    """The text with every secret replaced by its kind in brackets; overlapping ones become one."""
    out, at = [], 0
    for start, kind, end in scan_bytes(data):
        if start >= at:
            out += [data[at:start], b"[", KINDS[kind].encode(), b"]"]
        at = max(at, end)
    return b"".join([*out, data[at:]])


def redact(documents: DataFrame) -> DataFrame:
    """All rows and columns of ``documents`` with the secrets in ``text`` masked; NULL stays NULL."""
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            texts = pa.array([masked(d) for d in _texts(column)], pa.binary()).cast(pa.string())
            texts = pc.if_else(column.is_null(), pa.scalar(None, pa.string()), texts)
            columns = [texts if i == at else batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return documents.mapInArrow(run, documents.schema)


def joined(spans: Column) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3(documents: DataFrame) -> DataFrame:
    """The contract's digest of ``scan``."""
    spans = F.col("spans")

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter(spans, lambda s: s["kind"].isin(*KINDS[:BASE_KINDS]))
    return scan(documents).select("doc_id", *[count(k) for k in KINDS[:BASE_KINDS]], F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))
