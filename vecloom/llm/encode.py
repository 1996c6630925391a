"""Byte-level BPE over whole columns: every distinct piece of text is encoded once and gathered by number.

A segment is a run of white space with the run of other bytes behind it, cut further where a letter ends. The pattern of byte-level BPE never matches
across the border of two segments, so the ids of a text are the ids of its segments in order. Two kinds of rows break
this: white space outside ASCII, and none at all. The first are encoded whole, the second are one segment.
"""

from __future__ import annotations

import base64
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa

from vecloom.llm import textkit as K

ENCODE_BYTES = 2 << 20
CACHE_ENTRIES = 1_500_000
# White space outside space and 0x09-0x0D, as UTF-8.
ODD_SPACES = ["\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", " ", *map(chr, range(0x2000, 0x200B)), " ", " ", " ", " ", "　"]
_ODD_CODES = np.array([int.from_bytes(c.encode(), "little") for c in ODD_SPACES])
_ODD_FIRST = np.zeros(256, bool)
_ODD_FIRST[[c.encode()[0] for c in ODD_SPACES]] = True
_ODD_ENDS = tuple(c.encode() for c in ODD_SPACES)
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 2
_KIND[65:91] = _KIND[97:123] = 1


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks in a tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class RankQueue:
    """Linked-list positions by merge rank. Three levels of 64-way bitmaps say which buckets hold any; the first set bit
    of each level leads to the lowest rank. Positions come in arrays, and a bucket is a list of arrays."""

    def __init__(self, size: int):
        self.low, self.mid, self.top = [0] * ((size >> 6) + 1), [0] * ((size >> 12) + 1), 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, list[np.ndarray]] | None:
        """Empties the bucket of the lowest rank."""
        top = self.top
        if not top:
            return None
        a = (top & -top).bit_length() - 1
        m = self.mid[a]
        b = a << 6 | ((m & -m).bit_length() - 1)
        w = self.low[b]
        rank = b << 6 | ((w & -w).bit_length() - 1)
        self.low[b] &= ~(1 << (rank & 63))
        if not self.low[b]:
            self.mid[a] &= ~(1 << (b & 63))
            if not self.mid[a]:
                self.top &= ~(1 << a)
        return rank, self.buckets.pop(rank)


class RankBpe:
    """Encodes many pre-tokens at once: one linked list of parts through all of them, and one RankQueue of the pairs
    that the ranks can merge. The lowest bucket is swept from the left; an entry whose part has gone, or whose pair has
    another rank by now, is stale and skipped. A sweep stops where a merge makes a pair of lower rank, which ranks in
    the order of their making hardly ever allow; but for that every part is looked at once per merge around it."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values(), default=0) + 1
        self.byte = np.array([ranks.get(bytes([b]), 0) for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = rank
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the bytes of both tokens together; -1: none."""
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)

    def _sweep(self, at, rank, ids, after, before, owner, bounds, limit) -> tuple[np.ndarray, np.ndarray]:
        """(entries of a bucket to merge now, those to put back), from sorted entries. A sweep from the left takes every
        entry whose part is still there: in a run of entries, each of which is the next one's left part, every second. Each
        pre-token's sweep ends with the first merge that makes a pair of lower rank, which goes before the others."""
        run = np.ones(len(at), bool)
        run[1:] = after[at[:-1]] != at[1:]
        number = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        take = at[number % 2 == 0]
        right, left = after[take], before[take]
        behind = after[right]
        merged = np.zeros(len(take), bool)  # the part on the left has been taken just before
        merged[1:] = right[:-1] == left[1:]
        made = np.full((2, len(take)), -1)
        some = left >= bounds[owner[take]]
        made[0, some] = self._rank(np.where(merged, rank, ids[left])[some], np.full(int(some.sum()), rank))
        some = behind < limit[take]
        made[1, some] = self._rank(np.full(int(some.sum()), rank), ids[behind[some]])
        lower = ((made >= 0) & (made < rank)).any(axis=0)
        if not lower.any():
            return take, at[:0]
        who = owner[take]
        first = np.full(int(who[-1]) + 1, len(ids))
        np.minimum.at(first, who[lower], take[lower])
        return take[take <= first[who]], at[at > first[owner[at]]]

    def encode(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all tokens, and the bounds of each token's."""
        lengths = np.array([len(x) for x in tokens], np.int64)
        bounds = np.zeros(len(tokens) + 1, np.int64)
        np.cumsum(lengths, out=bounds[1:])
        n = int(bounds[-1])
        ids = self.byte[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), lengths)
        after = np.arange(1, n + 2)  # the next part; n: none
        before = np.arange(-1, n)
        limit = bounds[1:][owner] if n else bounds[:0]
        pair = np.full(n + 1, -1)
        queue = RankQueue(self.size)

        def look(at: np.ndarray) -> None:
            to = after[at]
            inside = to < limit[at]
            pair[at[~inside]] = -1
            at, to = at[inside], to[inside]
            rank = self._rank(ids[at], ids[to])
            pair[at] = rank
            good = rank >= 0
            at, rank = at[good], rank[good]
            if len(at) < 4:
                for r, i in zip(rank.tolist(), at, strict=True):
                    queue.push(r, np.array([i]))
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
                queue.push(r, part)

        if n:
            look(np.arange(n))
        gone = np.zeros(n + 1, bool)
        while (entry := queue.pop()) is not None:
            rank, parts = entry
            at = parts[0] if len(parts) == 1 else np.concatenate(parts)
            at = at[pair[at] == rank]  # a part that has gone has no pair
            if not len(at):
                continue
            if len(at) > 1:
                at, rest = self._sweep(np.unique(at), rank, ids, after, before, owner, bounds, limit)
                if len(rest):
                    queue.push(rank, rest)
            right = after[at]
            behind = after[right]
            ids[at] = rank
            gone[right] = True
            pair[right] = -1
            after[at] = behind
            ok = behind < n
            before[behind[ok]] = at[ok]
            prior = before[at]
            prior = prior[(prior >= bounds[owner[at]])]
            look(np.unique(np.concatenate([at, prior])))
        stay = np.flatnonzero(~gone[:n])
        return ids[stay], np.searchsorted(stay, bounds)


Ragged = tuple[np.ndarray, np.ndarray]  # ids of all pieces, and the bounds of each piece's


def rank_encoder(ranks: dict[bytes, int], pattern: str) -> Callable[[list[bytes]], Ragged]:
    """Encodes pieces by the ranks, each match of the pattern separately; special tokens are ordinary text."""
    import regex

    find, bpe = regex.compile(pattern).findall, RankBpe(ranks)

    def encode(pieces: list[bytes]) -> Ragged:
        number: dict[str, int] = {}
        which: list[int] = []
        counts = []
        for piece in pieces:
            found = find(piece.decode())
            counts.append(len(found))
            which += [number.setdefault(x, len(number)) for x in found]
        ids, bounds = bpe.encode([x.encode() for x in number])
        index = np.array(which, np.int64)
        out, at = ragged_take(ids, bounds[:-1][index], np.diff(bounds)[index])
        return out.astype(np.uint32), at[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]

    return encode


def library_encoder(path: str) -> tuple[Callable[[list[bytes]], Ragged], list[bytes]]:
    """(encoder, the special tokens' strings). Encodes pieces by the tokenizers library. Pieces that begin with white space and end with something else are
    encoded in one call, and told apart by the bytes that each token stands for; not so behind white space outside ASCII, with which the
    next piece's could be one token."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    widths = np.array([len(b) for b in token_bytes(t)], np.int64)

    def encode(pieces: list[bytes]) -> Ragged:
        joined = [p[0] in b" \t\n\v\f\r" and p[-1] not in b" \t\n\v\f\r" and not p.endswith(_ODD_ENDS) for p in pieces]
        got, n = [], np.zeros(len(pieces), np.int64)
        at = np.flatnonzero(joined)
        for k in range(0, len(at), 4096):
            part = at[k : k + 4096]
            ids = np.array(t.encode(b"".join([pieces[i] for i in part]).decode(), add_special_tokens=False).ids, np.uint32)
            last = np.searchsorted(np.cumsum(widths[ids]), np.cumsum([len(pieces[i]) for i in part])) + 1
            n[part] = np.diff(last, prepend=0)
            got.append(ids)
        alone = np.flatnonzero(~np.array(joined, bool))
        for i in alone:
            got.append(np.array(t.encode(pieces[i].decode(), add_special_tokens=False).ids, np.uint32))
            n[i] = len(got[-1])
        order = np.concatenate([at, alone])
        begin = np.empty(len(pieces), np.int64)
        begin[order] = np.cumsum(n[order]) - n[order]
        return ragged_take(np.concatenate(got) if got else np.zeros(0, np.uint32), begin, n)

    return encode, [str(x.content).encode() for x in t.get_added_tokens_decoder().values()]


def token_bytes(t) -> list[bytes]:
    """The bytes each id of a byte-level vocabulary stands for. Its printable alphabet: bytes that print stand for
    themselves, the others for code points from 256 on, in order."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    byte = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(rest)}
    added = t.get_added_tokens_decoder()
    size = t.get_vocab_size(with_added_tokens=True)
    return [str(added[i].content).encode() if i in added else bytes(byte[c] for c in t.id_to_token(i)) for i in range(size)]


class PieceCache:
    """Ids by piece, kept by the worker from batch to batch as sorted arrays. It starts anew when it is full."""

    def __init__(self, encode: Callable[[list[bytes]], Ragged], specials: list[bytes] = (), most: int = CACHE_ENTRIES):
        self.encode, self.specials, self.most = encode, list(specials), most
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of each piece data[starts:ends], of the given hash, among the distinct ones; where in `ids` those of each
        distinct one begin, and how many they are). These places hold until the next call."""
        if len(self.keys) > self.most:
            self.clear()
        inverse, unique = pd.factorize(hashes)
        order = np.argsort(unique)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        unique, inverse = unique[order], rank[inverse]
        place = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == unique[inside]
        if not known.all():
            first = np.empty(len(unique), np.int64)
            first[inverse[::-1]] = np.arange(len(hashes) - 1, -1, -1)
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            ids, bounds = self.encode([raw[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            self.keys = np.insert(self.keys, place[new], unique[new])
            self.at = np.insert(self.at, place[new], bounds[:-1] + len(self.ids))
            self.n = np.insert(self.n, place[new], np.diff(bounds))
            self.ids = np.concatenate([self.ids, ids])
            place += np.cumsum(~known) - ~known
        return inverse, self.at[place], self.n[place]

    def gather(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> Ragged:
        """The ids of the pieces data[starts:ends] whose hashes are given."""
        inverse, at, n = self.find(data, starts, ends, hashes)
        return ragged_take(self.ids, at[inverse], n[inverse])


def ragged_take(values: np.ndarray, at: np.ndarray, n: np.ndarray) -> Ragged:
    """values[at[i] : at[i] + n[i]] for all i, concatenated, and their bounds."""
    bounds = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=bounds[1:])
    return values[np.repeat(at - bounds[:-1], n) + np.arange(bounds[-1])], bounds


def _odd_rows(data: np.ndarray, offsets: np.ndarray, specials: list[bytes]) -> np.ndarray:
    """Which rows hold white space outside ASCII, or a special token's string."""
    found = []
    raw = data.tobytes() if specials else b""
    for special in specials:
        at = raw.find(special)
        while at >= 0:
            found.append(at)
            at = raw.find(special, at + 1)
    at = np.flatnonzero(_ODD_FIRST[data])
    padded = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.int64)
    first, second, third = padded[at], padded[at + 1], padded[at + 2]
    width = np.where(first < 0x80, 1, np.where(first < 0xE0, 2, 3))
    code = first | np.where(width > 1, second << 8, 0) | np.where(width > 2, third << 16, 0)
    found = np.concatenate([np.array(found, np.int64), at[np.isin(code, _ODD_CODES)]])
    return np.unique(np.searchsorted(offsets, found, "right") - 1)


def _cut_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray):
    """Cuts words where an ASCII letter stands before an ASCII byte that is neither letter nor white space: no match of the
    pattern goes across. Far fewer distinct pieces are left."""
    kind = _KIND[data]
    cut = np.flatnonzero((kind[:-1] == 1) & (kind[1:] == 2)) + 1
    word = np.searchsorted(starts, cut, "right") - 1
    inside = (cut > starts[word]) & (cut < ends[word]) if len(starts) else np.zeros(0, bool)
    cut, word = cut[inside], word[inside]
    place = np.searchsorted(starts, cut)
    return np.insert(starts, place, cut), np.insert(ends, word, cut), np.insert(owner, place, owner[word])


def encode_texts(text: pa.Array, cache: PieceCache):
    """(ids of all texts, bounds) for runs of rows in order."""
    for _, _, data, offsets in K.chunks(text, ENCODE_BYTES):
        starts, ends, bounds = K.words(data, offsets)
        last = offsets[:-1].copy()  # where the row's last word ends
        some = np.diff(bounds) > 0
        last[some] = ends[bounds[1:][some] - 1]
        starts, ends, owner = _cut_words(data, starts, ends, K.repeat_rows(bounds))
        begin = np.empty_like(starts)
        begin[1:] = ends[:-1]
        heads = np.flatnonzero(np.diff(owner, prepend=-1))
        begin[heads] = offsets[owner[heads]]
        tail = np.flatnonzero(last < offsets[1:])
        odd = _odd_rows(data, offsets, cache.specials)
        if len(odd):
            strange = np.zeros(len(offsets) - 1, bool)
            strange[odd] = True
            keep = ~strange[owner]
            begin, ends, owner = begin[keep], ends[keep], owner[keep]
            tail = tail[~strange[tail]]
        row = np.concatenate([owner, tail, odd])
        begin, ends = np.concatenate([begin, last[tail], offsets[odd]]), np.concatenate([ends, offsets[tail + 1], offsets[odd + 1]])
        if len(tail) or len(odd):
            order = np.lexsort((begin, row))
            row, begin, ends = row[order], begin[order], ends[order]
        ids, pieces = cache.gather(data, begin, ends, K.Spans(data).hash(begin, ends))
        yield ids, pieces[np.searchsorted(row, np.arange(len(offsets)))]


class Decoder:
    """Bytes of many ids at once."""

    def __init__(self, table: list[bytes]):
        self.n = np.array([len(b) for b in table], np.int64)
        self.at = np.cumsum(self.n) - self.n
        self.data = np.frombuffer(b"".join(table), np.uint8)

    def decode(self, ids: np.ndarray) -> Ragged:
        return ragged_take(self.data, self.at[ids], self.n[ids])
