"""SentencePiece encoding and decoding by suffix-array matching.

The vocabulary is read from a SentencePiece model file (BPE with byte
fallback; the path is a parameter). No piece of such a model goes on past the
start of a word, so a text is the sequence of its words (a run of word marks
and what follows it), and each distinct word of a batch is encoded once. The
batch's words are concatenated and a suffix array, ordered as far as the
longest piece reaches, is built by prefix doubling. All pieces are found in it by
binary search at once; their ranges are all their occurrences. Sorted by where they
end, the occurrences are the edges of every word's lattice, which is relaxed
from left to right.

A BPE encoding isn't a best path by scores but has this property: the encoding
of each prefix extends that of a shorter prefix by one piece, and the last
piece is the one edge whose pair with the piece before it is what BPE itself
makes of these two pieces. So the relaxation keeps the one edge whose pair is
compatible; pairs are tested by undoing their merges, the latest first, and
remembered. This gives the library's ids exactly.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: What stands between words; no piece has it.
BETWEEN = 0x110000
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Characters of a batch of texts and of a batch of new words, and words remembered by a task: what one worker holds.
CHUNK, WORD_CHARS, REMEMBERED = 1 << 20, 1 << 17, 150_000
#: Words beyond this length are relaxed by themselves, in parts of PART characters.
LONG, PART = 1024, 1 << 16


class Vocabulary:
    """Pieces of a model: ids, ranks (a lower rank merges first), bytes and control ids."""

    def __init__(self, path: str = MODEL_PATH) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(self.size)]
        self.bytes = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.control = {i for i in range(self.size) if model.is_control(i)}
        self.unknown = model.unk_id()
        normal = [i for i in range(self.size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.rank = {self.pieces[i]: -model.get_score(i) for i in normal}
        self.id = {self.pieces[i]: i for i in normal}
        if len(self.bytes) != 256 or any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("the model isn't BPE with byte fallback whose pieces begin words")
        self.longest = max(map(len, self.id))
        # Pieces that BPE never makes of their own characters aren't reachable as a whole.
        whole = {p: self.merge(list(p)) for p in self.id}
        self.usable = [p for p, (symbols, _) in whole.items() if symbols == [p]]
        self.usable_ids = np.array([self.id[p] for p in self.usable], np.int64)
        self.codes = np.zeros((len(self.usable), self.longest), np.uint32)
        self.lengths = np.array([len(p) for p in self.usable], np.int64)
        for row, p in zip(self.codes, self.usable):
            row[: len(p)] = [ord(c) for c in p]
        # When each piece is merged (single characters: 0), and the two pieces that its last merge joins.
        self.when, self.left, self.right = np.zeros(self.size, np.int64), np.arange(self.size), np.arange(self.size)
        self.when[list(self.id.values())] = np.argsort(np.argsort([self.rank[p] for p in self.id], kind="stable")) + 1
        for p in self.usable:
            if len(p) == 1:
                self.when[self.id[p]] = 0
            else:
                at = whole[p][1]
                self.left[self.id[p]], self.right[self.id[p]] = self.id.get(p[:at], -1), self.id.get(p[at:], -1)
        # Polynomial hashes, so that the hash of two joined pieces follows from theirs; all pieces' differ.
        self.hash, self.power = np.zeros(self.size, np.uint64), np.ones(self.size, np.uint64)
        for p, i in self.id.items():
            h = 0
            for c in p:
                h = (h * _BASE + ord(c) + 1) & _MASK
            self.hash[i], self.power[i] = h, pow(_BASE, len(p), 1 << 64)
        ids = np.array(list(self.id.values()))
        self.by_hash = ids[np.argsort(self.hash[ids])]
        self.hashes = self.hash[self.by_hash]
        if len(np.unique(self.hashes)) < len(self.hashes):
            raise ValueError("two pieces have one hash")
        self.pairs = PairTable(self)
        self._lists = [x.tolist() for x in (self.when, self.left, self.right)]
        self.one_pair = lru_cache(1 << 17)(self._one_pair)
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.control else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]

    def merge(self, symbols: list[str]) -> tuple[list[str], int]:
        """BPE of a sequence of symbols: the pair of the least rank merges first, the leftmost of equals; and the length of the left side of the last merge."""
        last = 0
        after = list(range(1, len(symbols))) + [-1]
        before = [-1, *range(len(symbols) - 1)]
        heap: list[tuple[float, int, int, str]] = []

        def push(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if j >= 0 and (r := self.rank.get(symbols[i] + symbols[j])) is not None:
                heapq.heappush(heap, (r, i, j, symbols[i] + symbols[j]))

        for i in range(len(symbols) - 1):
            push(i)
        while heap:
            _, i, j, merged = heapq.heappop(heap)
            if not symbols[i] or after[i] != j or symbols[i] + symbols[j] != merged:
                continue
            last = len(symbols[i])
            symbols[i], symbols[j] = merged, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(before[i])
            push(i)
        return [s for s in symbols if s], last

    def string(self, i: int) -> str:
        """What an id spells; characters outside the vocabulary stand as ids beyond it until they become bytes."""
        return self.pieces[i] if i < self.size else chr(i - self.size)

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Whether BPE splits the characters of two pieces, packed as first * 2^21 + second, into just these pieces.

        The later of the two sides' last merges is undone again and again. The split
        stands unless two symbols that then meet at the border are a piece that
        would have been merged before the merge that was undone (or, as it is further
        left, at the same time as one of the second side).
        """
        good = np.ones(len(pairs), bool)
        # A character outside the vocabulary merges with nothing.
        at = np.flatnonzero((pairs >> 21 < self.size) & ((pairs & 0x1FFFFF) < self.size))
        x, y = pairs[at] >> 21, pairs[at] & 0x1FFFFF
        limit = np.full(len(at), np.iinfo(np.int64).max)
        while len(at):
            joined = self.hash[x] * self.power[y] + self.hash[y]
            found = np.minimum(np.searchsorted(self.hashes, joined), len(self.hashes) - 1)
            broken = (self.hashes[found] == joined) & (self.when[self.by_hash[found]] < limit)
            good[at[broken]] = False
            first, second = self.when[x], self.when[y]
            go = ~broken & ((first > 0) | (second > 0))
            one = first > second
            limit = np.where(one, first, second + 1)[go]
            x, y, at = np.where(one, self.right[x], x)[go], np.where(one, y, self.left[y])[go], at[go]
        return good


    def _one_pair(self, pair: int) -> bool:
        """``compatible`` of one pair."""
        x, y = pair >> 21, pair & 0x1FFFFF
        if x >= self.size or y >= self.size:
            return True
        (when, left, right), limit = self._lists, self.size + 1
        while True:
            joined = self.id.get(self.pieces[x] + self.pieces[y])
            if joined is not None and when[joined] < limit:
                return False
            if when[x] > when[y]:
                limit, x = when[x], right[x]
            elif when[y]:
                limit, y = when[y] + 1, left[y]
            else:
                return True


class PairTable:
    """Known answers of ``compatible`` in an open hash table that is read for many pairs at once."""

    def __init__(self, vocab: Vocabulary, bits: int = 19) -> None:
        self.vocab, self.shift = vocab, np.uint64(64 - bits)
        self.keys, self.good = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, bool)
        self.held = 0

    def _places(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each pair, or the free place where it belongs, and whether it is there."""
        mask = len(self.keys) - 1
        at = ((pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        there = self.keys[at]
        todo = np.flatnonzero((there != pairs) & (there >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            there = self.keys[at[todo]]
            todo = todo[(there != pairs[todo]) & (there >= 0)]
        return at, self.keys[at] == pairs

    def __call__(self, pairs: np.ndarray) -> np.ndarray:
        at, known = self._places(pairs)
        if known.all():
            return self.good[at]
        new = np.unique(pairs[~known])
        good = self.good[at]
        good[~known] = self.vocab.compatible(new)[np.searchsorted(new, pairs[~known])]
        if self.held + len(new) > len(self.keys) // 2:  # start over rather than fill up
            self.keys[:], self.held = -1, 0
            new = new[: len(self.keys) // 2]
        self.held += len(new)
        answers = self.vocab.compatible(new)
        while len(new):
            at, known = self._places(new)
            _, first = np.unique(at, return_index=True)  # of pairs that belong to one place, one takes it now
            self.keys[at[first]], self.good[at[first]] = new[first], answers[first]
            left = np.ones(len(new), bool)
            left[first] = False
            new, answers = new[left], answers[left]
        return good


@lru_cache(4)
def vocabulary(path: str = MODEL_PATH) -> Vocabulary:
    return Vocabulary(path)


def _numbers(codes: np.ndarray) -> np.ndarray:
    """For each code its number among those that occur, from 1 on in their order; -1 for the others."""
    number = np.full(int(codes.max()) + 1, -1, np.int64)
    number[codes] = 0
    there = np.flatnonzero(number == 0)
    number[there] = np.arange(1, len(there) + 1)
    return number


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions ordered by their first ``depth`` codes at least; a code beyond the end counts as less than any other.

    As many codes as fit are packed into the first key; then prefix doubling.
    """
    n = len(codes)
    code = _numbers(codes)[codes]
    bits = int(code.max()).bit_length()
    width = max(1, min(62 // bits, depth))
    padded = np.zeros(n + width, np.int64)
    padded[:n] = code
    key = padded[:n].copy()
    for k in range(1, width):
        key = key << bits | padded[k : k + n]
    while True:
        order = np.argsort(key)
        if width >= depth:
            return order
        ordered = key[order]
        rank = np.zeros(n + width, np.int64)
        rank[order] = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]])
        key = rank[:n] * (n + 2) + rank[width:]
        width *= 2


def find(pieces: np.ndarray, lengths: np.ndarray, codes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the range [low, high) of the suffix array whose suffixes begin with it: one binary search for all pieces at once.

    The first codes of the suffixes, as many as fit into a key, are searched for
    as one number; longer pieces that occur so far go on with their next codes within the range found.
    """
    n, width = len(order), pieces.shape[1]
    number = _numbers(codes)
    bits = int(number.max()).bit_length()
    packed = max(1, min(62 // bits, width))
    text = np.zeros(n + width + packed, np.int64)
    text[:n] = number[codes]
    inside = np.arange(width) < lengths[:, None]
    spelt = np.where(inside, np.where(pieces < len(number), number[np.minimum(pieces, len(number) - 1)], -1), 0)
    some = np.flatnonzero((spelt >= 0).all(1))
    low, high = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
    done = 0
    while len(some):
        keys, parts = np.zeros(n, np.int64), np.zeros(len(some), np.int64)
        for k in range(done, done + packed):
            keys = keys << bits | text[k : k + n]
            parts = parts << bits | (spelt[some, k] if k < width else 0)
        keys = keys[order]
        free = np.int64(1) << (bits * np.maximum(done + packed - lengths[some], 0))  # how many keys begin with the part
        if not done:
            low[some], high[some] = np.searchsorted(keys, parts), np.searchsorted(keys, parts + free)
        else:
            low[some], high[some] = _within(keys, parts, low[some], high[some]), _within(keys, parts + free, low[some], high[some])
        done += packed
        some = some[(low[some] < high[some]) & (lengths[some] > done)]
    return low, high


def _within(keys: np.ndarray, parts: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The first place in [low, high), where the keys are in order, whose key is not less than the part; else high."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        less = open_ & (keys[np.minimum(mid, len(keys) - 1)] < parts)
        low, high = np.where(less, mid + 1, low), np.where(open_ & ~less, mid, high)
    return low


def edges(words: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, start, piece id) of every occurrence of a piece within a word of the concatenated words.

    Words are joined by a character that no piece has, so no edge leaves its word.
    """
    text = "\x00".join(words) + "\x00"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes[np.cumsum([len(w) + 1 for w in words]) - 1] = BETWEEN
    order = suffix_array(codes, vocab.longest)
    low, high = find(vocab.codes, vocab.lengths, codes, order)
    count = high - low
    at = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start, length, piece = order[at], np.repeat(vocab.lengths, count), np.repeat(vocab.usable_ids, count)
    # A character that isn't a piece is an edge of its own.
    single = np.zeros(len(codes), bool)
    single[start[length == 1]] = True
    alone = np.flatnonzero(~single & (codes != BETWEEN))
    start, piece = np.r_[start, alone], np.r_[piece, codes[alone] + vocab.size]
    return start + np.r_[length, np.ones(len(alone), np.int64)], start, piece


def _relax(end: np.ndarray, start: np.ndarray, piece: np.ndarray, first: np.ndarray, total: int, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The last piece of the encoding up to each place, and where it starts; -1 at the starts of words.

    All words go on by one character at a time together: the edges that end at
    the n-th character of a word need only what was found for fewer characters.
    """
    last, origin = np.full(total + 1, -1, np.int64), np.full(total + 1, -1, np.int64)
    word = np.zeros(total + 1, np.int64)
    word[first] = first
    step = end - np.maximum.accumulate(word)[start]
    # The edges in the order of where they end in their words.
    by = np.argsort(step.astype(np.uint16) if step.max() < 1 << 16 else step, kind="stable")
    bounds = np.r_[0, np.cumsum(np.bincount(step))]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if a == b:
            continue
        e, s, p = end[by[a:b]], start[by[a:b]], piece[by[a:b]]
        before = last[s]
        ok = before < 0
        later = np.flatnonzero(~ok)
        if len(later):
            ok[later] = vocab.pairs(before[later] << 21 | p[later])
        last[e[ok]], origin[e[ok]] = p[ok], s[ok]
    return last, origin


def _encode_short(words: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Last pieces of some words, one after another, and the number of each word's."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(lengths + 1) - lengths - 1
    end, start, piece = edges(words, vocab)
    total = int(lengths.sum()) + len(words)
    last, origin = _relax(end, start, piece, first, total, vocab)
    # Walk back from all words' ends at once; what is met are the ends of the pieces.
    met, at, stop = np.zeros(total + 1, bool), first + lengths, first
    while len(at):
        met[at] = True
        at = origin[at]
        open_ = at > stop
        at, stop = at[open_], stop[open_]
    ends = np.flatnonzero(met)
    return last[ends], np.diff(np.searchsorted(ends, np.r_[first + 1, total + 1]))


def _encode_long(word: str, vocab: Vocabulary) -> np.ndarray:
    """Pieces of one long word: the edges of one part of it at a time, relaxed one after another; 8 bytes a character are held."""
    last, origin = array("i", [-1]) * (len(word) + 1), array("i", [0]) * (len(word) + 1)
    good = vocab.one_pair
    for a in range(0, len(word), PART):
        begin = max(0, a - vocab.longest)
        end, start, piece = edges([word[begin : a + PART]], vocab)
        order = np.argsort(end, kind="stable")
        order = order[end[order] > a - begin]
        for e, s, p in zip((end[order] + begin).tolist(), (start[order] + begin).tolist(), piece[order].tolist()):
            if s == 0 or good(last[s] << 21 | p):
                last[e], origin[e] = p, s
    out, at = array("i"), len(word)
    while at:
        out.append(last[at])
        at = origin[at]
    return np.frombuffer(out, np.int32)[::-1].astype(np.int64)


def _spelt(flat: np.ndarray, count: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts with the bytes of the characters outside the vocabulary in place of these."""
    outside = np.flatnonzero(flat >= vocab.size)
    if len(outside):
        spelt = [[vocab.bytes[b] for b in chr(i).encode("utf-8", "surrogatepass")] for i in (flat[outside] - vocab.size).tolist()]
        size = np.ones(len(flat), np.int64)
        size[outside] = [len(x) for x in spelt]
        owner = np.repeat(np.arange(len(count)), count)
        wide = np.repeat(flat, size)
        wide[np.repeat(flat >= vocab.size, size)] = list(chain.from_iterable(spelt))
        flat, count = wide, np.bincount(owner, size, len(count)).astype(np.int64)
    return flat.astype(np.int32), count


def encode_words(words: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some non-empty words, one after another, and the number of each word's."""
    flat, count = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    lengths = [len(w) for w in words]
    for a, b in common.slices([n if n <= LONG else WORD_CHARS for n in lengths], WORD_CHARS):
        if lengths[a] > LONG:  # a slice of its own
            pieces = _encode_long(words[a], vocab)
            found = _spelt(pieces, np.array([len(pieces)]), vocab)
        else:
            found = _spelt(*_encode_short(words[a:b], vocab), vocab)
        flat.append(found[0]), count.append(found[1])
    return np.concatenate(flat), np.concatenate(count)


def words_of(text: str) -> list[str]:
    """A text as the model sees it: a mark before it and for each space; cut before each run of marks."""
    return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []


class _Index(dict):
    """Numbers words as they are looked up; ``new`` has those that came since it was emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class Encoder:
    """Encodes batches of texts; remembers words between batches."""

    def __init__(self, path: str = MODEL_PATH) -> None:
        self.vocab = vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self.index, self.flat, self.count = _Index(), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for a, b in common.slices([len(t) for t in texts], CHUNK):
            if len(self.index) > REMEMBERED:
                self._forget()
            index = self.index
            numbers = [np.fromiter(map(index.__getitem__, words_of(t)), np.int64) for t in texts[a:b]]
            if index.new:
                flat, count = encode_words(index.new, self.vocab)
                self.flat, self.count = np.concatenate([self.flat, flat]), np.concatenate([self.count, count])
                index.new = []
            begin = np.cumsum(self.count) - self.count
            for words in numbers:
                n = self.count[words]
                ends = np.cumsum(n)
                at = np.repeat(begin[words] - ends + n, n)
                out.append(self.flat[at + np.arange(len(at))])
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids: bytes joined to characters (broken ones replaced), marks as spaces, without the mark before the text."""
        text = b"".join(map(self.vocab.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@lru_cache(1)
def encoder(path: str = MODEL_PATH) -> Encoder:
    """One encoder a Python worker, so that what it remembers serves all its tasks."""
    return Encoder(path)


def encode(df: DataFrame, text: str = "text", path: str = MODEL_PATH) -> DataFrame:
    """All columns and ``ids``, ``n_tokens`` and ``decoded`` (the text read back from the ids). Null and empty texts have no id and decode to the empty text.

    Columns of these names are replaced. Decoding gives the text back, but for
    word marks (U+2581) in it, which become spaces.
    """
    kept = [c for c in df.columns if c not in ("ids", "n_tokens", "decoded")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            body = common.strings(batch.column(len(kept)))
            for a, b in common.slices([len(t) for t in body], CHUNK):
                ids = own.encode(body[a:b])
                offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                flat = pa.array(np.concatenate(ids))
                columns = [c.slice(a, b - a) for c in batch.columns[: len(kept)]]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, flat), pa.array([len(x) for x in ids], pa.int64()), pa.array([own.decode(x) for x in ids], pa.string())], names=[*kept, "ids", "n_tokens", "decoded"])

    head = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in kept)
    return df.select(*kept, F.col(text).cast("string").alias("__text")).mapInArrow(run, head + "ids array<int>, n_tokens bigint, decoded string")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    done = encode(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), MARK, " ")).alias("exact"))
