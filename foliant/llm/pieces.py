r"""SentencePiece BPE by a prefix table.

Each prefix of a word has exactly one last token: the token that ends there and is compatible with the last token of
the prefix before it. Two tokens are compatible if no merge across their border would come before the merges
that made them, which is found by taking both apart in the order in which they were made. So the table is filled
from left to right, trying the tokens that end at each position, and the ids are recovered from the end backwards.

The tokens that end at a position are matched by rolling hashes of its substrings, for many words at once: tables
are numpy arrays over all words that a batch of texts has for the first time. No piece of the vocabulary has a mark
of a space (U+2581) after another character, so words don't influence each other and are kept in a bounded
cache (word_ids.py), from which Arrow and numpy put texts together. Runs of spaces have pieces of equal rank and very long words would widen the arrays: the former go through
the merges themselves, the latter through a table of their own, filled from the matches of an automaton.

Defined results: a very long text or word is encoded as a whole; a null text counts as empty and has the end id only; repeated rows are handled alike; a null doc_id
is passed on; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, slices, spread, table, text_of
from .word_ids import WordIds

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
CUT = "\ud800"  # can't be part of a text
CUT_BYTES = CUT.encode("utf-8", "surrogatepass")
RUN = re.compile(f"{SPACE}+")
WIDE = 48  # characters of words that share arrays
HELD = 1 << 20  # bytes of text that are encoded together
NEVER = np.int32(1 << 30)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


class Table:
    """Open addressing from 64-bit keys to 32-bit values, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int):
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        for k, v, at in zip(keys.tolist(), values.tolist(), self.home(keys).tolist(), strict=True):
            while self.values[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.values[at] = k, v

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, or -1."""
        at = self.home(keys)
        got = self.values[at]
        rest = np.flatnonzero((got >= 0) & (self.keys[at] != keys))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            found = self.values[at[rest]]
            got[rest] = found
            rest = rest[(found >= 0) & (self.keys[at[rest]] != keys[rest])]
        return got


class Pieces(WordIds):
    """A vocabulary with the tables that encoding needs. Ids grow as ranks fall."""

    LIMIT = 200_000
    EMPTY = b""

    def __init__(self, path: str):
        super().__init__()
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.vocab_size()
        self.end, self.unknown = self.sp.eos_id(), n
        self.bytes = [self.sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        normal = [i for i in range(n) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))]
        self.text = {i: self.sp.id_to_piece(i) for i in normal}
        self.id = {p: i for i, p in self.text.items()}
        self.score = {i: self.sp.get_score(i) for i in normal}
        if any(SPACE in p[1:] and p.strip(SPACE) or "\n" in p for p in self.id):
            raise ValueError("pieces go across words")
        plain = [i for i in normal if SPACE * 2 not in self.text[i]]
        made = [i for i in plain if len(self.text[i]) > 1]
        if sorted(made, key=lambda i: -self.score[i]) != made:
            raise ValueError("ids aren't in the order of ranks")
        self.left, self.right = np.arange(n + 1, dtype=np.int32), np.arange(n + 1, dtype=np.int32)
        whole = []  # tokens that encode to themselves
        for i in plain:
            if len(self.text[i]) == 1:
                whole.append(i)
            elif (halves := self.merged(self.text[i], last=True)) is not None:
                self.left[i], self.right[i] = halves
                whole.append(i)
        self.atom = self.left == np.arange(n + 1)
        self.length = np.ones(n + 1, np.int32)
        for i in plain:
            self.length[i] = len(self.text[i])
        self.longest = int(self.length.max())
        self.power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(WIDE + 1, BASE)]), dtype=np.uint64)
        self.matches = Table(np.array([self.hash(self.text[i]) for i in whole], np.uint64), np.array(whole, np.int32), 18)
        self.lengths = sorted({len(self.text[i]) for i in whole})
        joined = [(self.id[p[:k]], self.id[p[k:]], i) for p, i in self.id.items() if SPACE * 2 not in p for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id]
        self.merges = [(a << 32 | b, c) for a, b, c in joined]
        self.automaton = None
        self.pairs = Table(np.array([a << 32 | b for a, b, _ in joined], np.uint64), np.array([c for _, _, c in joined], np.int32), 20)
        self.whole = {self.text[i]: i for i in whole}
        self.digits = pa.array([str(i) for i in range(n)], pa.large_string())
        self.numbers = np.array(list(range(n)), object)  # shared by all lists of ids

    def clear(self) -> None:
        super().clear()
        self.fitting: dict[int, bool] = {}

    @staticmethod
    def hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    # The merges themselves: for taking tokens apart, and for runs of spaces.
    def merged(self, text: str, last: bool = False):
        """The ids after all merges; with last, the two tokens of the last merge, or None if the whole isn't one token."""
        part: list[str | None] = list(text)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap: list[tuple[float, int, str]] = []
        pair = None

        def offer(a: int) -> None:
            b = after[a]
            if b < len(part) and (i := self.id.get(part[a] + part[b])) is not None:
                heapq.heappush(heap, (-self.score[i], a, part[a] + part[b]))

        for a in range(len(part) - 1):
            offer(a)
        while heap:
            _, a, want = heapq.heappop(heap)
            if part[a] is None or (b := after[a]) >= len(part) or part[a] + part[b] != want:
                continue
            pair = (part[a], part[b])
            part[a], part[b], after[a] = want, None, after[b]
            if after[a] < len(part):
                before[after[a]] = a
            if before[a] >= 0:
                offer(before[a])
            offer(a)
        rest = [p for p in part if p is not None]
        if last:
            return (self.id[pair[0]], self.id[pair[1]]) if len(rest) == 1 and pair else None
        return list(chain.from_iterable([self.id[p]] if p in self.id else self.fallback(p) for p in rest))

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()]

    def compatible(self, l: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Whether no merge across the border of l and r comes before the merges that made them."""
        ok = np.ones(len(l), bool)
        at = np.arange(len(l))
        limit = np.full(len(l), NEVER)
        while len(at):
            over = self.pairs.get(l.astype(np.uint64) << np.uint64(32) | r.astype(np.uint64))
            cut = (over >= 0) & (over < limit)
            ok[at[cut]] = False
            done = cut | (self.atom[l] & self.atom[r])
            if done.any():
                go = ~done
                at, l, r = at[go], l[go], r[go]
            # the token made later comes apart first; of equal ones that is the right one
            first = ~self.atom[l] & ((l > r) | self.atom[r])
            limit = np.where(first, l, r + 1)
            l, r = np.where(first, self.right[l], l), np.where(first, r, self.left[r])
        return ok

    def table_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of at most WIDE characters, each with a space mark at its start at most, and how many each has. Characters without a token are `unknown`."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        width, n = int(size.max()), len(words)
        code = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(n, width).T
        prefix = np.zeros((width + 1, n), np.uint64)
        for i in range(width):
            prefix[i + 1] = prefix[i] * BASE + code[i].astype(np.uint64) + np.uint64(1)
        last = np.full((width + 1, n), -1, np.int32)
        for i in range(1, width + 1):
            open_ = np.flatnonzero(size >= i)
            for k in reversed([x for x in self.lengths if x <= i]):  # long tokens first: the most likely
                token = self.matches.get(prefix[i, open_] - prefix[i - k, open_] * self.power[k])
                hit = np.flatnonzero(token >= 0)
                if not len(hit):
                    continue
                at, token = open_[hit], token[hit]
                if k < i:
                    good = self.compatible(last[i - k, at], token)
                    at, token, hit = at[good], token[good], hit[good]
                last[i, at] = token
                open_ = np.delete(open_, hit)
                if not len(open_):
                    break
            last[i, open_] = self.unknown  # a character without a token
        # backwards: the last token of the whole, then of what is before it
        place, column, steps = size.copy(), np.arange(n), []
        while len(column):
            token = last[place, column]
            steps.append((column, token, place))
            place = place - self.length[token]
            column, place = column[place > 0], place[place > 0]
        who = np.concatenate([s[0] for s in steps])
        got = np.concatenate([s[1] for s in steps])
        back = np.lexsort((-np.repeat(np.arange(len(steps)), [len(s[0]) for s in steps]), who))
        return got[back], np.bincount(who, minlength=n)

    def _filled(self, word: str, ids: list[int]) -> list[int]:
        """Bytes in place of characters without a token."""
        out, at = [], 0
        for i in ids:
            if i == self.unknown:
                out += self.fallback(word[at])
                at += 1
            else:
                out.append(i)
                at += int(self.length[i])
        return out

    def _fits(self, l: int, r: int) -> bool:
        """compatible() of two tokens, remembered."""
        if (found := self.fitting.get(l << 32 | r)) is None:
            if len(self.fitting) >= self.LIMIT:
                self.fitting.clear()
            found = self.fitting[l << 32 | r] = self._part(l, r)
        return found

    def _part(self, l: int, r: int) -> bool:
        limit = int(NEVER)
        while True:
            over = self.over.get(l << 32 | r)
            if over is not None and over < limit:
                return False
            whole_l, whole_r = self.atoms[l], self.atoms[r]
            if whole_l and whole_r:
                return True
            if not whole_l and (l > r or whole_r):
                limit, l = l, self.rights[l]
            else:
                limit, r = r + 1, self.lefts[r]

    def long_ids(self, word: str) -> list[int]:
        """The same table for one word of any length, by the matches of an automaton: at each place the longest first."""
        if self.automaton is None:
            self._prepare()
        last = [self.unknown] * (len(word) + 1)
        done, length = 0, self.sizes
        for end, token in self.automaton.iter(word):
            if end < done:
                continue  # this place has its token
            start = end + 1 - length[token]
            if start == 0 or self._fits(last[start], token):
                last[end + 1] = token
                done = end + 1
        ids, at = [], len(word)
        while at:
            ids.append(last[at])
            at -= length[last[at]]
        return self._filled(word, ids[::-1])

    def _prepare(self) -> None:
        """What long words need: an automaton of the tokens, and plain lists."""
        self.automaton = ahocorasick.Automaton()
        for text, token in self.whole.items():
            self.automaton.add_word(text, token)
        self.automaton.make_automaton()
        self.over = dict(self.merges)
        self.lefts, self.rights, self.atoms, self.sizes = self.left.tolist(), self.right.tolist(), self.atom.tolist(), self.length.tolist()

    @property
    def known(self) -> dict[bytes, int]:
        """The words in the cache."""
        return self.number

    def split(self, texts: list[str]) -> pa.Array:
        """Lists of words in UTF-8, each with the space marks before it, and of line breaks, which no piece has; some are empty."""
        return pc.split_pattern(pa.array(map(self._marked, texts), pa.large_binary()), pattern=CUT_BYTES)

    def _marked(self, text: str) -> bytes:
        if not text:
            return b""
        text = SPACE + text.replace(" ", SPACE)
        text = RUN.sub(rf"{CUT}\g<0>", text) if SPACE * 2 in text else text.replace(SPACE, CUT + SPACE)
        return text.replace("\n", f"{CUT}\n{CUT}").encode("utf-8", "surrogatepass")

    def learn(self, words: list[bytes]) -> None:
        plain, rest = [], []
        for w in words:
            word = w.decode()
            (plain if len(word) <= WIDE and SPACE * 2 not in word else rest).append((word, w))
        plain.sort(key=lambda x: len(x[0]))  # words of one length fill an array best
        for a in range(0, len(plain), 1 << 14):
            some = plain[a : a + (1 << 14)]
            flat, sizes = self.table_ids([word for word, _ in some])
            ends = np.cumsum(sizes)
            bad = np.zeros(len(some), bool)
            bad[np.searchsorted(ends, np.flatnonzero(flat == self.unknown), "right")] = True
            for i in np.flatnonzero(bad).tolist():
                self._put_one(some[i][1], self._filled(some[i][0], flat[ends[i] - sizes[i] : ends[i]].tolist()))
            self.put([w for (_, w), b in zip(some, bad.tolist(), strict=True) if not b], flat[~np.repeat(bad, sizes)], sizes[~bad])
        for word, w in rest:
            self._put_one(w, self.merged(word) if SPACE * 2 in word else self.long_ids(word))

    def _put_one(self, word: bytes, ids: list[int]) -> None:
        self.put([word], np.array(ids, np.uint32), np.array([len(ids)]))

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """Ids with the end id, and the same in decimal joined by spaces."""
        flat, cuts = self.joined(self.split(texts))
        flat, cuts = np.insert(flat, cuts[1:], self.end), [c + i for i, c in enumerate(cuts)]
        said = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), self.digits.take(pa.array(flat))), pa.scalar(" ", pa.large_string()))
        for a, b, s in zip(cuts[:-1], cuts[1:], said.to_pylist(), strict=True):
            yield self.numbers[flat[a:b]].tolist(), s

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids)


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """One vocabulary a process."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encoded(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = model or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        only(p)
        for batch in slices(batches, size=HELD):
            n, ids_sha, text_sha = [], [], []
            for ids, said in p.encode(batch.column(1).to_pylist()):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(said.encode()).hexdigest())
                text_sha.append(hashlib.sha256(p.decode(ids).encode()).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return spread(docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and its ids as an array."""
    path = model or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        only(p)
        for batch in slices(batches, size=HELD):
            yield pa.record_batch([batch.column(0), pa.array([ids for ids, _ in p.encode(batch.column(1).to_pylist())], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return spread(docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))).mapInArrow(run, "doc_id long, ids array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
