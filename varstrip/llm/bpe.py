"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last ``SPAN`` bytes cuts every text where its low bits are zero, so equal
passages are cut alike wherever they stand, and passages shared by documents give equal chunks. A
task encodes a chunk once and keeps its ids in a bounded two-generation cache. What a cut may have
changed is repaired: the words around every join are encoded again, together with one guard word on
either side, and the join is accepted when the guard words come out exactly as they did inside
their chunks. Where they do not, or where a chunk is too short to hold them, the two chunks are
encoded as one. White space separates the tokenizer's words, so agreement on a whole word on both
sides means that the rest of either chunk is untouched.

The vocabulary is read by every task from a path that all executors have (a parameter). The cache
never changes a result, only the time; it is local to a task, because moving chunks through a
shuffle costs more than encoding them again. Nothing is shuffled.

A fresh chunk of a tokenizer that drops white space is put together from the ids of its words,
which are kept in a second bounded cache and encoded in batches; other tokenizers encode it whole.

Defined results: a NULL or empty text has no ids and decodes to the empty text; texts of any length
are encoded whole; repeated rows and NULL ids are rows like any other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varstrip.llm import text as tx

SPAN, CUT_BITS, LONGEST = 16, 10, 1 << 14
# Entries of each of the two generations of a cache.
CACHED, CACHED_WORDS = 15_000, 300_000
BLANK = re.compile(rb"[\x20\x09-\x0D]+")
SOLID = re.compile(rb"[^\x20\x09-\x0D]+")
# Words encoded as one line.
LINE = 400
# The mark of a piece's last token, and a split pattern whose pieces never contain or look at white space.
END = "</w>"
BLANK_FREE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Chunk(NamedTuple):
    """Ids of a chunk, and how many belong to the words at its ends (cut word, guard word).

    ``head`` and ``tail`` hold the bytes of those two words; None where the chunk is too short.
    """

    ids: np.ndarray
    head: bytes | None
    tail: bytes | None
    head_cut: int
    head_all: int
    tail_cut: int
    tail_all: int


def cut_points(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Chunk boundaries of every text of a slice, its two ends included."""
    sums = tx.prefix_sums(tx.VALUES[data])
    places = np.arange(SPAN, len(data))
    hashed = tx.range_hashes(sums, places - SPAN, places)
    cuts = places[(hashed & np.uint64((1 << CUT_BITS) - 1)) == 0]
    cuts = cuts[(data[cuts] & 0xC0) != 0x80]  # never inside a character
    row = np.searchsorted(offsets, cuts, "right") - 1
    # A hash that reaches into the text before would make equal texts differ.
    keep = (cuts - SPAN >= offsets[row]) if len(cuts) else np.zeros(0, bool)
    cuts, row = cuts[keep], row[keep]
    out = []
    for i in range(len(offsets) - 1):
        low, high = np.searchsorted(row, [i, i + 1])
        ends = [int(offsets[i])]
        for stop in [*cuts[low:high].tolist(), int(offsets[i + 1])]:
            while stop - ends[-1] > LONGEST:
                at = ends[-1] + LONGEST
                while at > ends[-1] + 1 and (data[at] & 0xC0) == 0x80:
                    at -= 1
                ends.append(at)
            if stop > ends[-1]:
                ends.append(stop)
        out.append(np.array(ends))
    return out


def edge_words(data: bytes) -> tuple[tuple[int, int] | None, tuple[int, int] | None]:
    """Ends of the cut word and of the guard word behind it at the head, and the same at the tail.

    The head's guard word ends before a blank, the tail's begins after one; cut and guard word are
    looked for from their own end only.
    """
    ahead = BLANK.finditer(data)
    first, second = next(ahead, None), next(ahead, None)
    head = (first.start(), second.start()) if second else None
    for reach in (256, len(data)):
        base = max(0, len(data) - reach)
        # A blank at the very end leaves an empty cut word, which is as good as any.
        blanks = [m.end() for m in BLANK.finditer(data, base) if m.start() > base or base == 0]
        if len(blanks) >= 2 or base == 0:
            break
    tail = (blanks[-1], blanks[-2]) if len(blanks) >= 2 else None
    return head, tail


class Generations:
    """A dictionary that forgets what was not used for a generation of ``size`` entries."""

    def __init__(self, size: int):
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


def _separable(tokenizer) -> bool:
    """Whether words between blanks are encoded independently of each other."""
    stated = json.loads(tokenizer.to_str())
    steps = (stated.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = steps[0]
    normal = (stated.get("normalizer") or {}).get("normalizers") or []
    return (
        stated["model"].get("end_of_word_suffix") == END
        and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True
        and split["pattern"].get("Regex") == BLANK_FREE and {n["type"] for n in normal} <= {"NFC", "Lowercase", "Replace"}
        and all(n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in normal if n["type"] == "Replace")
    )


class Encoder:
    """The tokenizer of a worker with its chunk cache."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.numbers = [str(i) for i in range(size)]
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        self.separable = _separable(self.tokenizer)
        self.ends_piece = np.array([t.endswith(END) for t in self.tokens])
        self.kept = Generations(CACHED)
        self.words = Generations(CACHED_WORDS)
        self.joins = Generations(CACHED)
        self.encoded = self.reused = self.merged = 0
        self._batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of byte strings, each for itself."""
        return self.encode_text([t.decode("utf-8", "replace") for t in texts])

    def encode_text(self, texts: list[str]) -> list[np.ndarray]:
        out = self._batch(texts, add_special_tokens=False) if texts else []
        return [np.array(e.ids, self.kind) for e in out]

    def _word_ids(self, fresh: list[bytes]) -> list[bytes]:
        """Ids of words. Plain ones are encoded in lines and cut again where their pieces end.

        A word of letters is one piece, with a mark of punctuation behind it two; never fewer, so
        a line with just the expected number of pieces has each word's share right.
        """
        texts = [w.decode("utf-8", "replace") for w in fresh]
        pieces = np.array([1 if t.isalpha() else 2 * (len(t) > 1 and t[-1] in ".,;:!?" and t[:-1].isalpha()) for t in texts], np.int64)
        out: list[bytes] = [b""] * len(fresh)
        plain = np.flatnonzero(pieces)
        alone = np.flatnonzero(pieces == 0).tolist()
        lines = [plain[i : i + LINE] for i in range(0, len(plain), LINE)]
        for line, ids in zip(lines, self.encode_text([" ".join([texts[i] for i in line.tolist()]) for line in lines]), strict=True):
            ends = np.flatnonzero(self.ends_piece[ids]) + 1
            if len(ends) != pieces[line].sum():
                alone += line.tolist()
                continue
            stops = ends[np.cumsum(pieces[line]) - 1] * ids.itemsize
            whole, at = ids.tobytes(), 0
            for i, stop in zip(line.tolist(), stops.tolist(), strict=True):
                out[i] = whole[at:stop]
                at = stop
        for i, ids in zip(alone, self.encode_text([texts[i] for i in alone]), strict=True):
            out[i] = ids.tobytes()
        return out

    def _by_words(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts from those of their words."""
        split = [SOLID.findall(t) for t in texts]
        known = {}
        fresh = []
        for word in set().union(*split):
            ids = self.words.get(word)
            if ids is None:
                fresh.append(word)
            else:
                known[word] = ids
        for word, ids in zip(fresh, self._word_ids(fresh), strict=True):
            known[word] = ids
            self.words.put(word, ids)
        return [np.frombuffer(b"".join([known[w] for w in ws]), self.kind) for ws in split]

    def _fresh(self, keys: list[bytes]) -> Iterator[Chunk]:
        """Chunks encoded now. The words at their ends must come out alone as they do inside."""
        edges = [edge_words(k) for k in keys]
        pieces = []
        for key, (head, tail) in zip(keys, edges, strict=True):
            pieces += [key[: head[0]], key[: head[1]]] if head else []
            pieces += [key[tail[0] :], key[tail[1] :]] if tail else []
        whole = (self._by_words if self.separable else self.encode)(keys + pieces)
        ends = iter(whole[len(keys) :])
        for key, ids, (head, tail) in zip(keys, whole, edges, strict=False):
            h = [next(ends), next(ends)] if head else None
            t = [next(ends), next(ends)] if tail else None
            if h is not None and not np.array_equal(ids[: len(h[1])], h[1]):
                h = None
            if t is not None and not np.array_equal(ids[len(ids) - len(t[1]) :], t[1]):
                t = None
            yield Chunk(
                ids, key[: head[1]] if h else None, key[tail[1] :] if t else None,
                len(h[0]) if h else 0, len(h[1]) if h else 0, len(t[0]) if t else 0, len(t[1]) if t else 0,
            )

    def chunks(self, keys: list[bytes]) -> list[Chunk]:
        """The chunks of ``keys``, encoding those that are not at hand."""
        known = {key: self.kept.get(key) for key in dict.fromkeys(keys)}
        fresh = [key for key, chunk in known.items() if chunk is None]
        self.encoded += len(fresh)
        self.reused += len(keys) - len(fresh)
        for key, chunk in zip(fresh, self._fresh(fresh), strict=True):
            known[key] = chunk
            self.kept.put(key, chunk)
        return [known[k] for k in keys]

    def _join(self, left: Chunk, right: Chunk) -> np.ndarray | None:
        """Ids of the words around a join, without the guard words; None without agreement."""
        if left.tail is None or right.head is None:
            return None
        key = (left.tail, right.head)
        ids = self.joins.get(key)
        if ids is None:
            ids = self.encode([left.tail + right.head])[0]
            self.joins.put(key, ids)
        guard, after = left.tail_all - left.tail_cut, right.head_all - right.head_cut
        agrees = (
            guard > 0 and after > 0 and len(ids) >= guard + after
            and np.array_equal(ids[:guard], left.ids[len(left.ids) - left.tail_all : len(left.ids) - left.tail_cut])
            and np.array_equal(ids[len(ids) - after :], right.ids[right.head_cut : right.head_all])
        )
        return ids[guard : len(ids) - after] if agrees else None

    def text_ids(self, data: bytes, ends: np.ndarray, chunks: list[Chunk]) -> np.ndarray:
        """Ids of one text from its chunks, every join repaired."""
        if not chunks:
            return np.zeros(0, self.kind)
        parts: list[np.ndarray] = []
        start, low, current = int(ends[0]), 0, chunks[0]
        for k in range(1, len(chunks)):
            joint = self._join(current, chunks[k])
            # The words at both ends of a chunk must not be the same ones.
            if joint is None or low + current.tail_all > len(current.ids) or current.head_all + current.tail_all > len(current.ids):
                self.merged += 1
                key = data[start : int(ends[k + 1])]
                current = self.chunks([key])[0]
                continue
            parts += [current.ids[low : len(current.ids) - current.tail_cut], joint]
            start, low, current = int(ends[k]), chunks[k].head_cut, chunks[k]
        parts.append(current.ids[low:])
        return np.concatenate(parts)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_texts(coder: Encoder, column: pa.Array) -> Iterator[np.ndarray]:
    """Ids of every text of a column, in order."""
    for s in tx.slices(column, tx.SLICE_BYTES // 2):
        whole = s.data.tobytes()
        bounds = cut_points(s.data, s.offsets)
        keys = [whole[a:b] for e in bounds for a, b in zip(e[:-1].tolist(), e[1:].tolist(), strict=True)]
        chunks = coder.chunks(keys)
        at = 0
        for e in bounds:
            yield coder.text_ids(whole, e, chunks[at : at + len(e) - 1])
            at += len(e) - 1


ENCODED = "doc_id long, ids array<int>"


def encode(documents: DataFrame, path: str) -> DataFrame:
    """Token ids of every document: doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            at, held, size = 0, [], 0
            for ids in encode_texts(coder, batch.column(1)):
                held.append(ids.astype(np.int32))
                size += len(ids)
                if size > 1 << 20:
                    yield _id_batch(batch.column(0)[at : at + len(held)], held)
                    at, held, size = at + len(held), [], 0
            if held:
                yield _id_batch(batch.column(0)[at:], held)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ENCODED)


def _id_batch(doc_ids: pa.Array, rows: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows)))
    return pa.RecordBatch.from_arrays([doc_ids, ids], names=["doc_id", "ids"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Text of every row of ids, as the library decodes them: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            rows = batch.column(1).to_pylist()
            texts = coder.tokenizer.decode_batch([r or [] for r in rows], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.mapInArrow(run, "doc_id long, text string")


def digests(documents: DataFrame, path: str) -> DataFrame:
    """Per document: n_tokens, and digests of its ids and of the text that they decode to.

    A tokenizer file without a decoder decodes to its tokens joined by blanks, which is done here
    with the same table as the ids; otherwise the library decodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        plain = coder.tokenizer.decoder is None
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for ids in encode_texts(coder, batch.column(1)):
                listed = ids.tolist()
                counts.append(len(listed))
                of_ids.append(hashlib.sha256(" ".join([coder.numbers[i] for i in listed]).encode()).hexdigest())
                text = " ".join([coder.tokens[i] for i in listed]) if plain else coder.tokenizer.decode(listed, skip_special_tokens=False)
                of_text.append(hashlib.sha256(text.encode()).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6(documents: DataFrame, path: str) -> DataFrame:
    """The contract's digest: ``path`` is a tokenizer file of the ``tokenizers`` library."""
    return digests(documents, path)
