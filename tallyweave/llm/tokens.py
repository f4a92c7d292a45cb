"""Token counts from compiled finite-state transducers.

A byte-level BPE vocabulary counts the tokens of a text in two machines, both
compiled from the vocabulary's file on the driver and sent out once:

* a deterministic automaton over character classes finds the pre-tokens.  A
  text is cut in chunks; each chunk's map from entry state to exit state is
  computed for all states at once, a parallel prefix scan composes the maps,
  and a second pass runs every chunk from its now known entry state;
* a deterministic transducer over the bytes of a pre-token, compiled from the
  merges (``Merges``).  Its state is the longest suffix read that begins a
  token, with the last token and the token count at each place where a token
  may yet begin; a transition carries the change of the token count.  States
  are added when first met.  A block's distinct pre-tokens, which Arrow's
  dictionary compares byte by byte, run through it side by side.

Other vocabularies (.model, or .json with another pre-tokenizer) have no such
machines and are counted by their library text by text.

Null text counts as empty: 0 bytes, 0 tokens.  Null and repeated ids pass
through; one row out for each row in.  An empty table gives an empty result;
extra columns are ignored.  Texts of any length are counted whole: a text
beyond a block is read block by block, and both machines go on from the state
they had.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

LIMIT = 512
#: Characters handled at once; characters in a chunk; states of the transducer that a worker holds; pre-tokens run side by side.
BLOCK, CHUNK, MOST_STATES, ABREAST = 1 << 19, 64, 1 << 18, 8

# Classes of characters.  The contraction letters have classes of their own.
LETTER, STMD, R, V, LL, E_, NUMBER, OTHER, APOSTROPHE, SPACE, BLANK, CUT = range(12)
# States: what the last character was part of.
START, IN_LETTERS, IN_NUMBER, IN_OTHER, AFTER_SPACE, AFTER_BLANK, QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, CONTRACTED = range(11)
N_STATES, N_CLASSES = 11, 12
#: A code point past Unicode's end that stands for the end of a text.
END_OF_TEXT = 0x110000
#: Unicode White_Space (fixed values).
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def class_table(tokenizer) -> np.ndarray:
    """Letters and numbers as the tokenizer's library takes them.  Its Unicode
    version need not be Python's: where Python and ``regex`` don't agree on a
    code point, the library is asked."""
    import regex

    kinds = {"L": LETTER, "N": NUMBER}
    out, other = np.full(0x110001, OTHER, np.uint8), np.full(0x110000, OTHER, np.uint8)
    out[:0x110000] = [kinds.get(unicodedata.category(chr(cp))[0], OTHER) for cp in range(0x110000)]
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    every = "".join(map(chr, points.tolist()))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, every):
            other[points[m.start() : m.end()]] = kind
    unsure = np.flatnonzero(out[:0x110000] != other).tolist()
    if unsure:
        probe = "".join(f"a{chr(cp)}\n1{chr(cp)}\n" for cp in unsure)
        cut = {span[0] for _, span in tokenizer.pre_tokenizer.pre_tokenize_str(probe)}
        out[unsure] = [LETTER if 6 * i + 1 not in cut else NUMBER if 6 * i + 4 not in cut else OTHER for i in range(len(unsure))]
    out[WHITE] = BLANK
    for chars, kind in (("stmd", STMD), ("r", R), ("v", V), ("l", LL), ("e", E_), ("'", APOSTROPHE), (" ", SPACE)):
        out[[ord(c) for c in chars]] = kind
    out[END_OF_TEXT] = CUT
    return out


def transitions() -> np.ndarray:
    t = np.zeros((N_STATES, N_CLASSES), np.uint8)
    t[:, [LETTER, STMD, R, V, LL, E_]] = IN_LETTERS
    t[:, NUMBER], t[:, OTHER], t[:, APOSTROPHE], t[:, SPACE], t[:, BLANK], t[:, CUT] = IN_NUMBER, IN_OTHER, QUOTE, AFTER_SPACE, AFTER_BLANK, START
    t[[AFTER_SPACE, IN_OTHER, QUOTE], APOSTROPHE] = IN_OTHER  # part of a run of signs
    t[QUOTE, STMD], t[QUOTE, R], t[QUOTE, V], t[QUOTE, LL] = CONTRACTED, QUOTE_R, QUOTE_V, QUOTE_L
    t[QUOTE_R, E_] = t[QUOTE_V, E_] = t[QUOTE_L, LL] = CONTRACTED
    return t


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps, (n, states), by doubling."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step], axis=1)
        step *= 2
    return out


def run_states(classes: np.ndarray, t: np.ndarray, entry: int = START) -> np.ndarray:
    """The state after each character."""
    n = len(classes)
    m = -(-n // CHUNK)
    grid = np.full(m * CHUNK, CUT, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(m, CHUNK).T)
    flat = t.ravel()
    maps = np.broadcast_to(np.arange(N_STATES, dtype=np.uint8), (m, N_STATES)).copy()
    for col in grid:
        maps = flat[maps * np.uint8(N_CLASSES) + col[:, None]]
    at = np.concatenate(([entry], compose_scan(maps)[:-1, entry])).astype(np.uint8)
    out = np.empty_like(grid)
    for i, col in enumerate(grid):
        at = out[i] = flat[at * np.uint8(N_CLASSES) + col]
    return out.T.ravel()[:n]


def starts(classes: np.ndarray, states: np.ndarray, entry: int = START) -> np.ndarray:
    """Whether a pre-token starts at each character (cuts count as starts);
    that of the last character holds only where the text ends there."""
    before, after = np.empty_like(states), np.empty_like(states)
    before[0], before[1:], after[-1], after[:-1] = entry, states[:-1], START, states[1:]
    next_class = np.append(classes[1:], np.uint8(CUT))
    letter = classes <= E_
    pending = (before == QUOTE_R) | (before == QUOTE_V) | (before == QUOTE_L)
    waiting = (states == QUOTE_R) | (states == QUOTE_V) | (states == QUOTE_L)
    joined = (before == AFTER_SPACE) | (letter & ((before == IN_LETTERS) | pending | (states == CONTRACTED) | (waiting & (after == CONTRACTED))))
    joined |= (classes == NUMBER) & (before == IN_NUMBER)
    joined |= ((classes == OTHER) | (classes == APOSTROPHE)) & ((before == IN_OTHER) | (before == QUOTE))
    white, next_white = (classes == SPACE) | (classes == BLANK), (next_class == SPACE) | (next_class == BLANK) | (next_class == CUT)
    was_white = (before == AFTER_SPACE) | (before == AFTER_BLANK)
    joined = np.where(white, was_white & next_white, joined)
    return ~joined | (classes == CUT)


class Merges:
    """The transducer of a byte pair vocabulary.

    Token ids: 0 to 255 the bytes, from 256 on the merges in their order.  Of
    the tokens that end a prefix, the one that stands last in its encoding is
    the one whose left neighbour (the last token of what is before it) it can
    stand beside; so the last token of each prefix follows from those of
    shorter prefixes, and a finite window of them is the state."""

    NONE, SINCE = -1, 1 << 16

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        ids = {bytes([b]): b for b in range(256)}
        self.pair: dict[tuple[int, int], int] = {}
        self.parts = [(b, b) for b in range(256)]
        for left, right in merges:
            a, b = ids[left], ids[right]
            self.pair[a, b] = ids[left + right] = len(self.parts)
            self.parts.append((a, b))
        if len(ids) != len(self.parts):
            raise ValueError("a token of two merges")
        # A trie of the tokens; each node's longest proper suffix that is a node.
        self.child: dict[int, int] = {}
        self.depth, self.token, parent = [0], [self.NONE], [(0, 0)]
        for token, i in ids.items():
            at = 0
            for byte in token:
                step = at << 8 | byte
                if step not in self.child:
                    self.child[step] = len(self.depth)
                    parent.append((at, byte))
                    self.depth.append(self.depth[at] + 1)
                    self.token.append(self.NONE)
                at = self.child[step]
            if self.whole(i):
                self.token[at] = i
        self.suffix = [0] * len(self.depth)
        for node in sorted(range(1, len(self.depth)), key=self.depth.__getitem__):
            above, byte = parent[node]
            self.suffix[node] = self._follow(self.suffix[above], byte) if above else 0
        self.beside: dict[tuple[int, int], bool] = {}
        self._clear()

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stood at one end of ``token`` while it was built, and the merge that ended each."""
        out, end = [], float("inf")
        while True:
            out.append((token, end))
            if token < 256:
                return out
            end, token = token, self.parts[token][side]

    def _apart(self, a: int, b: int, own: int = -1) -> bool:
        """Whether no merge goes across the border of ``a`` and ``b`` before the merges that end its sides.
        Of equal merges the leftmost comes first."""
        left, right = self._spine(a, 1), self._spine(b, 0)
        return not any((m := self.pair.get((x, y))) is not None and m != own and m < x_end and m <= y_end for x, x_end in left for y, y_end in right)

    def whole(self, token: int) -> bool:
        """Whether the token's bytes alone become it: its halves meet only in its own merge."""
        return token < 256 or self._apart(*self.parts[token], own=token)

    def _follow(self, node: int, byte: int) -> int:
        while (to := self.child.get(node << 8 | byte)) is None:
            if not node:
                return 0
            node = self.suffix[node]
        return to

    def _clear(self) -> None:
        #: Each state's node, and for each suffix of it that is a node, by its length: the last token before that suffix (times
        #: SINCE) plus the tokens since (plus half of SINCE).
        self.states: list[tuple[int, dict[int, int]]] = []
        self.known: dict[tuple, int] = {}
        self._enter(0, {0: self.NONE * self.SINCE + self.SINCE // 2})
        self.one: dict[int, tuple[int, int]] = {}
        self.bits = 12
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.to, self.emits = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int32)
        self.held = 0

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """The state after a byte, and the change of the token count."""
        key = state << 8 | byte
        if (done := self.one.get(key)) is not None:
            return done
        node, window = self.states[state]
        new = end = self._follow(node, byte)
        depth, tokens, suffix, beside = self.depth, self.token, self.suffix, self.beside
        while True:
            token = tokens[end]
            if token >= 0:
                last, since = divmod(window[depth[end] - 1], self.SINCE)
                if last < 0:
                    break
                if (fits := beside.get((last, token))) is None:
                    fits = beside[last, token] = self._apart(last, token)
                if fits:
                    break
            end = suffix[end]
        emit = 1 - since + self.SINCE // 2
        after = {0: token * self.SINCE + self.SINCE // 2}
        at = new
        while at:
            after[depth[at]] = window[depth[at] - 1] + emit
            at = suffix[at]
        done = self.one[key] = self._enter(new, after), emit
        return done

    def run(self, state: int, data: bytes) -> tuple[int, int]:
        """The state after ``data``, and the change of the token count."""
        total = 0
        for byte in data:
            if len(self.states) > MOST_STATES:
                window = self.states[state]
                self._clear()
                state = self._enter(*window)
            state, emit = self.step(state, byte)
            total += emit
        return state, total

    def _enter(self, node: int, window: dict) -> int:
        name = (node, *window.values())  # the node tells the lengths
        if (state := self.known.get(name)) is None:
            state = self.known[name] = len(self.states)
            self.states.append((node, window))
        return state

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key in the table of transitions, or -1."""
        at, mask = self._slot(keys), (1 << self.bits) - 1
        there = self.keys[at]
        open_ = np.flatnonzero(there != keys)
        while len(open_):
            gone = there[open_] == -1
            at[open_[gone]] = -1
            open_ = open_[~gone]
            at[open_] = (at[open_] + 1) & mask
            there[open_] = self.keys[at[open_]]
            open_ = open_[there[open_] != keys[open_]]
        return at

    def _hold(self, keys: np.ndarray, to: np.ndarray, emits: np.ndarray) -> None:
        if 3 * (self.held + len(keys)) > 1 << self.bits:
            old = self.keys >= 0
            keys, to, emits = (np.concatenate(x) for x in ((self.keys[old], keys), (self.to[old], to), (self.emits[old], emits)))
            while 4 * len(keys) > 1 << self.bits:
                self.bits += 1
            self.keys = np.full(1 << self.bits, -1, np.int64)
            self.to, self.emits = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int32)
            self.held = 0
        self.held += len(keys)
        at, mask = self._slot(keys), (1 << self.bits) - 1
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.to[at[mine]], self.emits[at[mine]] = to[mine], emits[mine]
            keys, to, emits, at = keys[~mine], to[~mine], emits[~mine], (at[~mine] + 1) & mask

    def counts(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token data[begin:end], all a byte at a time."""
        if len(self.states) > MOST_STATES:
            self._clear()
        out, state = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        live = np.arange(len(begin))
        at = 0
        while len(live := live[begin[live] + at < end[live]]) > ABREAST:
            keys = state[live] << 8 | data[begin[live] + at]
            place = self._find(keys)
            if (place < 0).any():
                new = np.unique(keys[place < 0])
                self._hold(new, *(np.array(x, np.int32) for x in zip(*(self.step(k >> 8, k & 255) for k in new.tolist()), strict=True)))
                place = self._find(keys)
            state[live] = self.to[place]
            out[live] += self.emits[place]
            at += 1
        full = len(self.states) > MOST_STATES
        for i in live.tolist():  # few long ones
            if full:
                window = [self.states[s] for s in state[live].tolist()]
                self._clear()
                state[live], full = [self._enter(*w) for w in window], False
            out[i] += self.run_apart(int(state[i]), data[begin[i] + at : end[i]].tobytes())
        return out

    def run_apart(self, state: int, data: bytes) -> int:
        """``run`` that leaves the numbers of other states as they are."""
        total = 0
        for byte in data:
            state, emit = self.step(state, byte)
            total += emit
        return total


def byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the
    others as the characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


class ByteLevelCounter:
    """Both machines of a vocabulary; the library is asked for its classes of
    characters when they are compiled and plays no part in counting."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = sorted((a["content"] for a in spec["added_tokens"]), key=len, reverse=True)
        #: Leftmost, the longest first.
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.classes, self.table = class_table(Tokenizer.from_file(path)), transitions()
        symbol = byte_of_symbol()
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merges = Merges([tuple(bytes(symbol[c] for c in x) for x in p) for p in pairs])

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        held: list[str] = []
        ids: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            parts = [text]
            if self.special and self.special.search(text):
                parts = self.special.split(text)
                out[i] += len(parts) - 1
            for part in parts:
                if len(part) > BLOCK:
                    out[i] += self._long(part)
                elif part:
                    held.append(part)
                    ids.append(i)
                    size += len(part)
                    if size > BLOCK:
                        np.add.at(out, ids, self._block(held))
                        held, ids, size = [], [], 0
        if held:
            np.add.at(out, ids, self._block(held))
        return out

    @staticmethod
    def _codes(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le"), np.uint32)

    def _words(self, data: bytes, offsets: np.ndarray) -> np.ndarray:
        """Tokens of the pre-tokens between ``offsets`` of ``data``."""
        words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        distinct = words.dictionary
        edges = np.frombuffer(distinct.buffers()[1], np.int32)[distinct.offset : distinct.offset + len(distinct) + 1].astype(np.int64)
        return self.merges.counts(np.frombuffer(distinct.buffers()[2], np.uint8), edges[:-1], edges[1:])[words.indices.to_numpy()]

    def _block(self, parts: list[str]) -> np.ndarray:
        """Tokens of each of several texts, none of them empty."""
        lengths = np.array([len(p) for p in parts])
        codes = np.full(int(lengths.sum()) + len(parts), END_OF_TEXT, np.uint32)
        firsts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        for p, a in zip(parts, firsts.tolist(), strict=True):
            codes[a : a + len(p)] = self._codes(p)
        classes = self.classes[codes]
        begin = np.flatnonzero(starts(classes, run_states(classes, self.table)) & (classes != CUT))
        place = _places(codes)
        emits = self._words("".join(parts).encode(), np.append(place[begin], place[-1]))
        return np.add.reduceat(emits, np.searchsorted(begin, firsts))

    def _long(self, text: str) -> int:
        """Tokens of a text beyond a block; a pre-token may go on from block to block."""
        total, state, entry, carry = 0, 0, START, np.empty(0, np.uint32)
        for s in range(0, len(text), BLOCK):
            codes = np.concatenate((carry, self._codes(text[s : s + BLOCK])))
            n = len(codes) - (s + BLOCK < len(text))  # what comes after decides on the last character
            classes = self.classes[codes]
            states = run_states(classes, self.table, entry)
            begin = np.flatnonzero(starts(classes, states, entry)[:n])
            place = _places(codes[:n])
            data = codes[:n].tobytes().decode("utf-32-le").encode()
            at = np.append(place[begin], place[-1])
            state, emit = self.merges.run(state, data[: at[0]])
            total += emit
            if len(begin):
                total += int(self._words(data, at[:-1]).sum())
                state, emit = self.merges.run(0, data[at[-2] :])
                total += emit
            if n:
                entry = int(states[n - 1])
            carry = codes[n:]
        return total


def _places(codes: np.ndarray) -> np.ndarray:
    """The place of each character in UTF-8, and the end."""
    sizes = (codes < END_OF_TEXT).astype(np.int64) + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000) - 3 * (codes == END_OF_TEXT)
    return np.concatenate(([0], np.cumsum(sizes)))


class LibraryCounter:
    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self._encode = lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> np.ndarray:
        return np.array([n for i in range(0, len(texts), 64) for n in self._encode(texts[i : i + 64])], np.int64)


def counter(path: str) -> ByteLevelCounter | LibraryCounter:
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"]):
            return ByteLevelCounter(path)
    return LibraryCounter(path)


#: The machine of each vocabulary that this worker has met, with the states it has found.
_COUNTERS: dict[str, ByteLevelCounter | LibraryCounter] = {}


def count_tokens(df: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row.  ``tokenizer`` is a
    path, or a name that ``public_tokenizers.path`` knows.  A compiled machine
    is broadcast; its size is the vocabulary's."""
    id_type = df.schema[id_col].dataType.simpleString()
    path = tokenizer
    if "/" not in path:
        import public_tokenizers

        path = str(public_tokenizers.path(path))
    machine = counter(path)
    sent = df.sparkSession.sparkContext.broadcast(machine) if isinstance(machine, ByteLevelCounter) else None

    def count(batches):
        if path not in _COUNTERS:
            _COUNTERS[path] = sent.value if sent else counter(path)
        for b in batches:
            text = pc.fill_null(b.column(1), "")
            n = _COUNTERS[path].counts(text.to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_length(text).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(count, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"))
