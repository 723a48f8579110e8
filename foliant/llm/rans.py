"""Static range asymmetric numeral system for token ids.

A file has one frequency table, shared by all its blocks. A block is coded on its own by LANES interleaved coders that
advance together, one token each a step, with 64-bit states that shed and take 32-bit words. Every CHECK steps the
states and the place in the words are kept as a checkpoint, so that the parts of a block between checkpoints are decoded side by
side; each block ends with a checksum of its bytes. Blocks need the file's head and nothing else.

Defined results: no tokens make a file without blocks; a document without an id has the id 0 and the mark has_id 0; a document isn't
cut, so a very long one is a block of its own; what is damaged raises a ValueError.

    file     MAGIC, size of the table part (u32), number of blocks (u32), table part (zlib: symbols u32*, frequencies u32*),
             then for each block its size (u32), the block, and its crc32 (u32)
    block    tokens (u32), documents (u32), words (u32), checkpoints (u32), doc_ids (i64*), lengths (u32*), has_id (u8*),
             places (u32*), states (u64*, LANES a checkpoint), words (u32*)
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"RANSTOK1"
BITS = 20  # frequencies sum to 2**BITS
TOTAL = 1 << BITS
LOW = 1 << 31  # states lie in [LOW, LOW << 32)
LANES = 1024
CHECK = 128  # steps between checkpoints
BLOCK = 1 << 18  # tokens of a block
U = np.uint64


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that sum to TOTAL."""
    if len(counts) > TOTAL:
        raise ValueError("more symbols than frequencies")
    f = np.maximum(1, counts.astype(np.int64) * TOTAL // max(1, int(counts.sum())))
    off = TOTAL - int(f.sum())
    for i in np.argsort(-f, kind="stable"):  # the most frequent ones give or take the difference
        if off == 0:
            break
        step = max(off, 1 - int(f[i]))
        f[i] += step
        off -= step
    return f


class Coder:
    """A frequency table: symbols ascending, and their frequencies."""

    def __init__(self, symbols: np.ndarray, frequencies: np.ndarray):
        self.symbols, self.f = symbols.astype(np.uint32), frequencies.astype(U)
        self.c = np.concatenate([[0], np.cumsum(frequencies)[:-1]]).astype(U)
        self.slots = None

    @classmethod
    def of(cls, tokens: np.ndarray) -> Coder:
        counts = np.bincount(tokens)
        symbols = np.flatnonzero(counts)
        return cls(symbols, scaled(counts[symbols]))

    def numbers(self, tokens: np.ndarray) -> np.ndarray:
        place = np.zeros(int(self.symbols[-1]) + 1, np.int32)
        place[self.symbols] = np.arange(len(self.symbols), dtype=np.int32)
        return place[tokens]

    def encode(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and states of the checkpoints, the first at the start, and the words."""
        steps = -(-len(numbers) // LANES)
        grid = np.zeros(steps * LANES, np.int32)
        grid[: len(numbers)] = numbers
        grid = grid.reshape(steps, LANES)
        x = np.full(LANES, LOW, U)
        shed, sizes, states = [], np.zeros(steps, np.int64), {}
        for i in range(steps - 1, -1, -1):
            f = self.f[grid[i]]
            over = x >= (f << U(63 - BITS))
            out = x[over]
            shed.append(out.astype(np.uint32))
            sizes[i] = len(out)
            x[over] = out >> U(32)
            q = x // f
            x = (q << U(BITS)) + (x - q * f) + self.c[grid[i]]
            if i % CHECK == 0:
                states[i] = x.copy()
        before = np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint32)
        marks = range(0, steps, CHECK)
        words = np.concatenate(shed[::-1]) if shed else np.empty(0, np.uint32)
        return before[list(marks)], np.array([states[i] for i in marks], U).reshape(-1, LANES), words

    def decode(self, n: int, places: np.ndarray, states: np.ndarray, words: np.ndarray, part: int | None = None) -> np.ndarray:
        """The tokens; with part, only those from that checkpoint to the next. All parts advance together, a step at a time."""
        if self.slots is None:
            self.slots = np.repeat(np.arange(len(self.f), dtype=np.int32), self.f.astype(np.int64))
        steps = -(-n // LANES)
        chosen = np.arange(len(places)) if part is None else np.arange(part, min(part + 1, len(places)))
        chosen = chosen[chosen * CHECK < steps]
        if not len(chosen):
            return np.empty(0, np.uint32)
        x, at = states[chosen].astype(U), places[chosen].astype(np.int64)
        length = np.minimum(CHECK, steps - chosen * CHECK)  # only the last part may be shorter
        out = np.empty((len(chosen), int(length[0]), LANES), np.int32)
        for i in range(int(length[0])):
            k = len(chosen) if i < length[-1] else len(chosen) - 1
            now = x[:k]
            slot = now & U(TOTAL - 1)
            s = self.slots[slot]
            out[:k, i] = s
            now = self.f[s] * (now >> U(BITS)) + slot - self.c[s]
            under = now < U(LOW)
            if under.any():
                upto = np.cumsum(under, 1)
                now[under] = (now[under] << U(32)) | words[(at[:k, None] + upto - 1)[under]]
                at[:k] += upto[:, -1]
            x[:k] = now
        flat = out.reshape(-1)[: int(length.sum()) * LANES]
        return self.symbols[flat[: n - int(chosen[0]) * CHECK * LANES]]


def pack_block(coder: Coder, tokens: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    places, states, words = coder.encode(coder.numbers(tokens))
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    has = np.array([d is not None for d in doc_ids], np.uint8)
    head = struct.pack("<IIII", len(tokens), len(doc_ids), len(words), len(places))
    return b"".join([head, ids.tobytes(), np.array(lengths, "<u4").tobytes(), has.tobytes(), places.astype("<u4").tobytes(), states.astype("<u8").tobytes(), words.astype("<u4").tobytes()])


def unpack_block(coder: Coder, data: bytes, part: int | None = None) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and tokens."""
    n, docs, n_words, marks = struct.unpack_from("<IIII", data)
    at, got = 16, []
    for kind, count in (("<i8", docs), ("<u4", docs), ("u1", docs), ("<u4", marks), ("<u8", marks * LANES), ("<u4", n_words)):
        got.append(np.frombuffer(data, kind, count, at))
        at += got[-1].nbytes
    ids, lengths, has, places, states, words = got
    tokens = coder.decode(n, places, states.reshape(-1, LANES), words, part)
    return [i if h else None for i, h in zip(ids.tolist(), has.tolist(), strict=True)], lengths, tokens


def pack_file(docs: list[tuple[int | None, np.ndarray]], most: int = BLOCK) -> bytes:
    """A file of documents in the given order; a block ends with the document that brings it to so many tokens."""
    lengths = [len(t) for _, t in docs]
    tokens = np.concatenate([t for _, t in docs]) if docs else np.empty(0, np.int64)
    coder = Coder.of(tokens) if len(tokens) else Coder(np.zeros(1, np.int64), np.array([TOTAL]))
    table = zlib.compress(coder.symbols.astype("<u4").tobytes() + coder.f.astype("<u4").tobytes(), 6)
    blocks, start, first, at = [], 0, 0, 0
    for i, n in enumerate(lengths):
        at += n
        if at - start >= most or i == len(lengths) - 1:
            blocks.append(pack_block(coder, tokens[start:at], [d for d, _ in docs[first : i + 1]], lengths[first : i + 1]))
            start, first = at, i + 1
    parts = [MAGIC, struct.pack("<II", len(table), len(blocks)), table]
    for b in blocks:
        parts += [struct.pack("<I", len(b)), b, struct.pack("<I", zlib.crc32(b))]
    return b"".join(parts)


def layout(data: bytes) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Of a file: the bytes of its head, and of each block its place, its bytes with size and checksum, tokens and documents."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    size, blocks = struct.unpack_from("<II", data, 8)
    at, out = 16 + size, []
    for _ in range(blocks):
        (n,) = struct.unpack_from("<I", data, at)
        tokens, docs = struct.unpack_from("<II", data, at + 4)
        out.append((at, n + 8, tokens, docs))
        at += n + 8
    return 16 + size, out


def head(data: bytes) -> Coder:
    """The coder of a file, from its head."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    (size,) = struct.unpack_from("<I", data, 8)
    table = np.frombuffer(zlib.decompress(data[16 : 16 + size]), "<u4")
    return Coder(table[: len(table) // 2], table[len(table) // 2 :].astype(np.int64))


def checked(data: bytes) -> bytes:
    """A block without its size and checksum."""
    (n,) = struct.unpack_from("<I", data)
    block = data[4 : 4 + n]
    if zlib.crc32(block) != struct.unpack_from("<I", data, 4 + n)[0]:
        raise ValueError("a block is damaged")
    return block


def unpack_file(data: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """doc_ids, lengths and tokens of each block."""
    coder = head(data)
    for at, size, _, _ in layout(data)[1]:
        yield unpack_block(coder, checked(data[at : at + size]))
