"""BPE encoding and decoding by speculate and verify.

The vocabulary is a JSON file of the ``tokenizers`` library (byte-level BPE with a list of
merges). Words are encoded in three steps, many at a time:

1. *Speculate*: from its start, each word is cut greedily into the longest tokens there are;
   the prefix tree of the tokens is walked for all bytes of all words at once.
2. *Verify*: a sequence is what the merges make if, and only if, each pair of neighbours is
   left alone when its own bytes are merged. That holds for a pair if no merge across its
   border comes before the merges that build the tokens at that border. All distinct pairs
   are tested together, following the right edge of the one token and the left edge of the
   other back through their merges.
3. Only words with a failing pair are merged exactly: short ones many at a time, one merge of
   each word in a round, long ones each with a heap of its possible merges.

Words are the matches of the byte-level pattern in the text between special tokens; each
distinct run of white space and word is handled once, and a bounded memory of the worker
keeps the ids of frequent ones.

Defined cases: a null text is an empty one and has no ids; the string of a special token
gives its id, as in the library, and what is before and after it is split on its own; every
byte has a token, so any characters are encoded; decoding joins bytes before it reads
characters, bytes that are no character become U+FFFD, and ids outside the vocabulary are
left out. Rows are independent: ties, repeated rows and extra columns don't matter, an empty
table gives an empty one. Texts are worked on in pieces of about 64 KB, cut where white space
follows another character (the pattern never matches across such a place).
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from orderlens.llm.bpe import byte_characters
from orderlens.llm.common import in_arrow, text_or_empty
from orderlens.llm.textbytes import slices

VOCABULARY = "byte_bpe_50k.json"
#: Distinct units after which a worker puts its memory aside (and forgets what it put aside before), and the longest one worth it.
REMEMBERED, LONGEST = 200_000, 64
#: Bytes of a word that is merged together with others; a longer one has a heap of its own.
SHORT = 48
#: Characters of one piece of a text, and of the pieces whose new units are learnt together.
PIECE, TOGETHER = 1 << 16, 1 << 18
#: White space as the pattern's engine reads it: a fixed class of Unicode.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: No match holds a white-space character after another one, so these units hold whole matches.
_UNITS = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
#: A unit of Latin letters with one sign behind them at most: its matches are these two, as is most often so.
_PLAIN = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?]?)")
_CUT = re.compile(f"(?<=[^{_WHITE}])(?=[{_WHITE}])")
_NEVER = np.iinfo(np.int64).max


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted value in the ascending ``keys``, -1 where it is none of them."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class SpeculativeBpe:
    """Encoder and decoder over one vocabulary file."""

    def __init__(self, file: str):
        with open(public_tokenizers.path(file), encoding="utf-8") as source:
            spec = json.load(source)
        self._specials(spec.get("added_tokens") or [])
        self._merges(spec["model"])
        self._tree()
        self.matches = regex.compile(public_tokenizers.PATTERN).findall
        self.known: dict[str, bytes] = {}  # ids as unsigned 32-bit integers
        self.older: dict[str, bytes] = {}
        self.decimal = [str(i) for i in range(self.size)]
        self.exact = 0  # words that needed exact merging

    def _specials(self, added: list[dict]) -> None:
        for token in added:
            if token.get("lstrip") or token.get("rstrip") or token.get("single_word"):
                raise ValueError(f"special token {token['content']!r} takes characters around it: not supported")
        self.special = {t["content"]: t["id"] for t in added}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_split = re.compile(f"({'|'.join(map(re.escape, longest_first))})").split if added else None

    def _merges(self, model: dict) -> None:
        """Bytes of the tokens; for each token the rank of the merge that makes it and its two parts."""
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        vocabulary = model["vocab"]
        self.size = max([*vocabulary.values(), *self.special.values()], default=-1) + 1
        self.table: list[bytes] = [b""] * self.size
        for shown, i in [*vocabulary.items(), *self.special.items()]:
            plain = all(c in byte_of for c in shown)
            self.table[i] = bytes(byte_of[c] for c in shown) if plain else shown.encode()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = np.array([vocabulary[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocabulary[b] for _, b in pairs], np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        if len(np.unique(made)) != len(made):
            raise ValueError("a token is made by two merges: not supported")
        self.made = made
        self.byte_ids = [vocabulary[c] for c in byte_characters()]
        self.rank = np.full(self.size, -1, np.int64)  # -1: a single byte
        self.rank[made] = np.arange(len(made))
        self.first, self.second = np.full(self.size, -1, np.int64), np.full(self.size, -1, np.int64)
        self.first[made], self.second[made] = self.left, self.right
        order = np.argsort(self.left * self.size + self.right)
        self.pair_keys, self.pair_ranks = (self.left * self.size + self.right)[order], order
        if (np.maximum(self.rank[self.left], self.rank[self.right]) >= np.arange(len(made))).any():
            raise ValueError("a merge comes before its parts are made: not supported")
        self.merge = {(a, b): (r, c) for r, (a, b, c) in enumerate(zip(self.left.tolist(), self.right.tolist(), made.tolist(), strict=True))}
        # a token whose own parts would have merged otherwise never comes out of the merges
        sound = self.compatible(self.left, self.right, inner=True)
        self.usable = {*self.byte_ids}
        for a, b, c, good in zip(self.left.tolist(), self.right.tolist(), made.tolist(), sound.tolist(), strict=True):
            if good and a in self.usable and b in self.usable:
                self.usable.add(c)

    def _tree(self) -> None:
        """Prefix tree of the usable tokens: edges (node, byte) in ascending order, and the token that ends at a node."""
        nodes: dict[bytes, int] = {b"": 0}
        edges, ends = [], [-1]
        for i in sorted(self.usable):
            token = self.table[i]
            for k in range(1, len(token) + 1):
                if token[:k] not in nodes:
                    nodes[token[:k]] = len(nodes)
                    edges.append((nodes[token[: k - 1]] * 256 + token[k - 1], nodes[token[:k]]))
                    ends.append(-1)
            ends[nodes[token]] = i
        edges.sort()
        self.edge_keys, self.edge_nodes = np.array(edges, np.int64).T
        self.ends = np.array(ends, np.int64)

    def compatible(self, a: np.ndarray, b: np.ndarray, inner: bool = False) -> np.ndarray:
        """Whether the merges leave each pair of neighbours (a, b) apart.

        ``inner`` ignores the merge of a and b themselves. In the order of the merges, a border
        is seen by ever larger tokens on both sides; going back, the younger of the two is
        taken apart. A merge of the two tokens at the border wins if it comes before both are
        swallowed by the next larger token; of equal merges the one further left comes first.
        """
        good = np.ones(len(a), bool)
        row = np.arange(len(a))
        x, y = np.array(a, np.int64), np.array(b, np.int64)
        stop_x = np.full(len(a), _NEVER)  # rank of the merge that swallows x, y
        stop_y = np.full(len(a), _NEVER)
        top = inner
        while len(row):
            at = _find(self.pair_keys, x * self.size + y)
            rank = np.where(at >= 0, self.pair_ranks[at], _NEVER)
            bad = (rank < stop_x) & (rank <= stop_y) & (rank < _NEVER)
            if top:
                bad[:], top = False, False
            good[row[bad]] = False
            rank_x, rank_y = self.rank[x], self.rank[y]
            go = ~bad & ((rank_x >= 0) | (rank_y >= 0))
            split_x = rank_x > rank_y
            stop_x, stop_y = np.where(split_x, rank_x, stop_x)[go], np.where(split_x, stop_y, rank_y)[go]
            x, y = np.where(split_x, self.second[x], x)[go], np.where(split_x, y, self.first[y])[go]
            row = row[go]
        return good

    def propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest tokens of all words, and the words' offsets among them."""
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        end = np.cumsum([len(w) for w in words])
        stop = np.repeat(end, [len(w) for w in words])  # the end of each byte's word
        longest, size = np.zeros(len(data), np.int64), np.ones(len(data), np.int64)
        here, node, depth = np.arange(len(data)), np.zeros(len(data), np.int64), 0
        while len(here):
            at = _find(self.edge_keys, node * 256 + data[here + depth])
            here, node, depth = here[at >= 0], self.edge_nodes[at[at >= 0]], depth + 1
            token = self.ends[node]
            longest[here[token >= 0]], size[here[token >= 0]] = token[token >= 0], depth
            more = here + depth < stop[here]
            here, node = here[more], node[more]
        starts = np.zeros(len(data), bool)
        at = end - [len(w) for w in words]
        while len(at):
            starts[at] = True
            at, limit = at + size[at], stop[at]
            at = at[at < limit]
        chosen = np.flatnonzero(starts)
        return longest[chosen], np.concatenate(([0], np.searchsorted(chosen, end)))

    def merged(self, word: bytes) -> tuple[int, ...]:
        """The ids of one word by its merges in their order, leftmost first."""
        ids = [self.byte_ids[b] for b in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        merge = self.merge
        heap = [(*merge[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in merge]
        heap = [(rank, i, made) for rank, made, i in heap]
        heapq.heapify(heap)
        while heap:
            rank, i, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= len(ids) or merge.get((ids[i], ids[j])) != (rank, made):
                continue  # one of the two is gone or has changed
            ids[i], ids[j], k = made, -1, after[j]
            after[i] = k
            if k < len(ids):
                before[k] = i
                if new := merge.get((made, ids[k])):
                    heapq.heappush(heap, (new[0], i, new[1]))
            h = before[i]
            if h >= 0 and (new := merge.get((ids[h], made))):
                heapq.heappush(heap, (new[0], h, new[1]))
        return tuple(i for i in ids if i >= 0)

    def _ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = _find(self.pair_keys, x * self.size + y)
        return np.where(at >= 0, self.pair_ranks[at], _NEVER)

    def merged_together(self, words: list[bytes]) -> list[bytes]:
        """The ids of many short words: in each round the merge that is next in each word, wherever it fits."""
        size = np.array([len(w) for w in words], np.int64)
        ids = np.array(self.byte_ids, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
        word, row = np.repeat(np.arange(len(words)), size), np.arange(len(words))
        rank = np.full(len(ids), _NEVER)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self._ranks(ids[inner], ids[inner + 1])
        out = [b""] * len(words)
        while len(ids):
            begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(rank, begin)
            length = np.diff(np.append(begin, len(ids)))
            over = least == _NEVER
            if over.any():
                flat = ids.astype("<u4").tobytes()
                for w, a, n in zip(row[over].tolist(), begin[over].tolist(), length[over].tolist(), strict=True):
                    out[w] = flat[4 * a : 4 * (a + n)]
                stay = np.repeat(~over, length)
                ids, word, rank, row, least, length = ids[stay], word[stay], rank[stay], row[~over], least[~over], length[~over]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, length))
            # of hits that overlap (equal tokens in a row) every other one, from the left
            fresh = np.concatenate(([True], np.diff(hit) > 1))
            at = np.flatnonzero(fresh)
            hit = hit[(np.arange(len(hit)) - np.repeat(at, np.diff(np.append(at, len(hit))))) % 2 == 0]
            ids[hit] = self.made[rank[hit]]
            stay = np.ones(len(ids), bool)
            stay[hit + 1] = False
            place = np.cumsum(stay)[hit] - 1
            ids, word, rank = ids[stay], word[stay], rank[stay]
            rank[place] = _NEVER
            again = np.unique(np.concatenate((place, place[place > 0] - 1)))
            again = again[again + 1 < len(ids)]
            rank[again] = np.where(word[again] == word[again + 1], self._ranks(ids[again], ids[again + 1]), _NEVER)
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of words (none empty): speculate, verify, and merge exactly where the check fails."""
        if not words:
            return []
        ids, at = self.propose(words)
        last = np.zeros(len(ids), bool)
        last[at[1:] - 1] = True
        border = np.flatnonzero(~last)  # a token with a neighbour to its right in the same word
        keys, back = np.unique(ids[border] * self.size + ids[border + 1] if len(border) else np.zeros(0, np.int64), return_inverse=True)
        wrong = border[~self.compatible(keys // self.size, keys % self.size)[back]]
        failing = np.zeros(len(words), bool)
        failing[np.searchsorted(at, wrong, "right") - 1] = True
        flat, cut = ids.astype("<u4").tobytes(), (4 * at).tolist()
        out = [flat[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        fails = np.flatnonzero(failing).tolist()
        short = [w for w in fails if len(words[w]) <= SHORT]
        for w, found in zip(short, self.merged_together([words[w] for w in short]), strict=True):
            out[w] = found
        for w in fails:
            if len(words[w]) > SHORT:
                out[w] = np.array(self.merged(words[w]), "<u4").tobytes()
        self.exact += len(fails)
        return out

    def _learn(self, units: Iterable[str]) -> dict[str, bytes]:
        split = {u: (m[1], m[2]) if (m := _PLAIN.fullmatch(u)) else self.matches(u) for u in units}
        words = list(set(chain.from_iterable(split.values())) - {""})
        ids = dict(zip(words, self.encode_words([w.encode() for w in words]), strict=True))
        ids[""] = b""
        return {u: b"".join(map(ids.__getitem__, found)) for u, found in split.items()}

    def _pieces(self, text: str) -> Iterator[str | int]:
        """The text in pieces that can be encoded apart; special tokens as their ids."""
        parts = self.special_split(text) if self.special_split else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield self.special[part]
                continue
            at = 0
            while at < len(part):
                end = len(part)
                if end - at > PIECE and (cut := _CUT.search(part, at + PIECE)):
                    end = cut.start()
                yield part[at:end]
                at = end

    def encode_all(self, texts: Iterable[str]) -> Iterator[tuple[int, list[int]]]:
        """(number of the text, ids of one of its pieces), in order; new units of many pieces are learnt together."""
        held: list[tuple[int, str | int]] = []
        size = 0
        for number, text in enumerate(texts):
            for piece in self._pieces(text):
                held.append((number, piece))
                size += len(piece) if isinstance(piece, str) else 1
                if size >= TOGETHER:
                    yield from self._encode(held)
                    held, size = [], 0
        yield from self._encode(held)

    def _encode(self, pieces: list[tuple[int, str | int]]) -> Iterator[tuple[int, list[int]]]:
        units = [_UNITS.findall(p) if isinstance(p, str) else [] for _, p in pieces]
        known, older = self.known, self.older
        fresh = set(chain.from_iterable(units)).difference(known)
        known |= {u: older[u] for u in fresh if u in older}
        learnt = self._learn(fresh.difference(older))
        known |= {u: x for u, x in learnt.items() if len(u) <= LONGEST}
        long = {u: x for u, x in learnt.items() if len(u) > LONGEST}
        find = known.__getitem__ if not long else (known | long).__getitem__
        for (number, piece), found in zip(pieces, units, strict=True):
            yield number, np.frombuffer(b"".join(map(find, found)), "<u4").tolist() if isinstance(piece, str) else [piece]
        if len(known) > REMEMBERED:  # what isn't met again before the next time is forgotten then
            self.known, self.older = {}, known

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        return [i for _, ids in self.encode_all([text]) for i in ids]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """The bytes of the ids' tokens, joined; ids outside the vocabulary have none."""
        table, size = self.table, self.size
        return b"".join([table[i] for i in ids if 0 <= i < size])

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids, special tokens included."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@cache
def coder(file: str = VOCABULARY) -> SpeculativeBpe:
    """One encoder for each worker process."""
    return SpeculativeBpe(file)


class _Digests:
    """Number of ids, SHA-256 of their decimals and of the decoded text, piece by piece."""

    def __init__(self, bpe: SpeculativeBpe):
        self.table, self.decimal, self.n = bpe.table, bpe.decimal, 0
        self.ids, self.text = hashlib.sha256(), hashlib.sha256()
        self.reader = codecs.getincrementaldecoder("utf-8")("replace")

    def add(self, ids: list[int]) -> None:
        if ids:
            self.ids.update(("," * bool(self.n) + ",".join(map(self.decimal.__getitem__, ids))).encode())
            self.n += len(ids)
            self.text.update(self.reader.decode(b"".join(map(self.table.__getitem__, ids))).encode())

    def done(self) -> tuple[int, str, str]:
        self.text.update(self.reader.decode(b"", True).encode())
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


def encode_decode(df: DataFrame, column: str = "text", file: str = VOCABULARY, ids: bool = False, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` (integers or strings) and the encoding of every text.

    Adds n_tokens, ids_sha256 (over the decimal ids joined by commas), decoded_sha256 (over the
    decoded text in UTF-8) and, if asked for, the ids themselves as ``token_ids``.
    """
    chosen = df.select(*keep, text_or_empty(column).alias("_bpe_text"))
    schema = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(file)
        for whole in batches:
            for batch in slices(whole, "_bpe_text"):
                digests = [_Digests(bpe) for _ in range(batch.num_rows)]
                flat: list[list[int]] = [[] for _ in digests] if ids else []
                for number, piece in bpe.encode_all(batch.column("_bpe_text").to_pylist()):
                    digests[number].add(piece)
                    if ids:
                        flat[number] += piece
                n, by_ids, by_text = zip(*(d.done() for d in digests), strict=True)
                columns = [batch.column(c) for c in keep] + [pa.array(n, pa.int64()), pa.array(by_ids, pa.string()), pa.array(by_text, pa.string())]
                names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns.append(pa.array(flat, pa.list_(pa.int32())))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return in_arrow(chosen, work, f"{schema}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * ids)


def decode_frame(df: DataFrame, column: str = "token_ids", file: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``text``, decoded from a column of ids; null ids give an empty text."""
    chosen = df.select(*keep, df[column].alias("_bpe_ids"))
    schema = ", ".join(f"`{c}` {chosen.schema[c].dataType.simpleString()}" for c in keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(file)
        for batch in batches:
            texts = [bpe.decode(i for i in x or [] if i is not None) for x in batch.column("_bpe_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    return in_arrow(chosen, work, f"{schema}, text string")
