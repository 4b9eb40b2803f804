"""Byte-pair token ids for whole texts, split and cached by block.

The vocabulary file is a parameter (a ``tokenizers`` JSON of a byte-level BPE such as ``byte_bpe_50k.json``).  Its pre-token
pattern is evaluated for a whole block of documents with numpy over code points; every pre-token is hashed, looked up in a
direct-mapped cache, and only pre-tokens that miss go through the merges.  Documents with a code point outside the classes
known here (unassigned, or from U+3000 on) are split by the pattern itself.  The ids equal
``Tokenizer.from_file(path).encode(text, add_special_tokens=False)`` (``tests/llm/test_bpe.py``): with ``added`` as the library has
it by default, so that the strings of the file's added tokens get those tokens' ids; without it, as with
``encode_special_tokens = True``, where they are ordinary text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

from .textblocks import BLOCK_BYTES, U64, _Powers, mix64, spans_of

#: The pre-token pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Contraction endings of that pattern, longest first does not matter as none is a prefix of another.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

_OTHER, _LETTER, _NUMBER, _WHITE, _UNKNOWN = range(5)
_LIMIT = 0x3000
_SLOTS = 1 << 20
#: The cache starts anew beyond so many ids, some 25 MB of them and their entries.
_MAX_IDS = 1 << 21


def _class_of(c: int) -> int:
    kind = unicodedata.category(chr(c))
    if kind in ("Cn", "Cs", "Co"):
        return _UNKNOWN
    if kind[0] in "LN":
        return _LETTER if kind[0] == "L" else _NUMBER
    # the regex property White_Space: separators and U+0009-000D, U+0085
    return _WHITE if kind[0] == "Z" or 9 <= c <= 13 or c == 0x85 else _OTHER


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """One per Python worker: ``ids(texts)`` yields (ids, bounds) by block of documents."""

    _made: dict[tuple[str, bool], Bpe] = {}

    @classmethod
    def of(cls, path: str, added: bool = False) -> Bpe:
        if (path, added) not in cls._made:
            cls._made[path, added] = cls(path, added)
        return cls._made[path, added]

    def __init__(self, path: str, added: bool = False):
        import tiktoken

        alphabet = byte_alphabet()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab = file["model"]["vocab"]
        tokens = {t["content"]: t["id"] for t in file.get("added_tokens") or []} if added else {}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in file.get("added_tokens") or [] if added):
            raise ValueError(f"{path}: an added token has options that are not supported")
        self.tokens = tokens
        self.token_pattern = re.compile("(" + "|".join(map(re.escape, sorted(tokens, key=len, reverse=True))) + ")") if tokens else None
        ranks = {bytes(alphabet[c] for c in token): n for token, n in vocab.items() if all(c in alphabet for c in token) and not token.startswith("<|")}
        self.core = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.classes = np.array([_class_of(c) for c in range(_LIMIT)], np.uint8)
        self.codes = mix64(np.arange(1, _LIMIT + 1, dtype=U64) * U64(0xD6E8FEB86659FD93))
        self.clear()

    def clear(self) -> None:
        self.slot_hash = np.zeros(_SLOTS, U64)
        self.slot_entry = np.zeros(_SLOTS, np.int64)
        self.entry_start = np.zeros(1 << 16, np.int64)
        self.entry_len = np.zeros(1 << 16, np.int64)
        self.n_entries = 0
        self.store = np.zeros(1 << 18, np.uint32)
        self.n_store = 0

    def _add(self, pieces: list[list[int]]) -> np.ndarray:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.fromiter((i for p in pieces for i in p), np.uint32, int(lengths.sum()))
        while self.n_store + len(ids) > len(self.store):
            self.store = np.concatenate((self.store, np.zeros_like(self.store)))
        while self.n_entries + len(pieces) > len(self.entry_start):
            self.entry_start = np.concatenate((self.entry_start, np.zeros_like(self.entry_start)))
            self.entry_len = np.concatenate((self.entry_len, np.zeros_like(self.entry_len)))
        new = np.arange(self.n_entries, self.n_entries + len(pieces))
        self.entry_start[new] = self.n_store + np.cumsum(lengths) - lengths
        self.entry_len[new] = lengths
        self.store[self.n_store : self.n_store + len(ids)] = ids
        self.n_store += len(ids)
        self.n_entries += len(pieces)
        return new

    def split(self, code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Starts of pre-tokens in code points of documents whose classes are all known."""
        n = len(code)
        kind = self.classes[code]
        first = np.zeros(n + 1, bool)
        first[bounds] = True
        white = kind == _WHITE
        changes = np.ones(n, bool)
        changes[1:] = kind[1:] != kind[:-1]
        start = changes | first[:n]
        # a space directly before a word is the first character of its pre-token
        after_space = np.zeros(n, bool)
        after_space[1:] = (code[:-1] == 32) & ~white[1:]
        start &= ~after_space | first[:n]
        # the last white character before a word starts a pre-token of its own (or, a space, that of the word)
        before_word = np.zeros(n, bool)
        before_word[:-1] = white[:-1] & ~white[1:] & ~first[1:n]
        start |= before_word
        quote = np.flatnonzero((code == 39) & start)
        quote = quote[quote + 1 < n]
        for end in ENDINGS:
            at = quote[quote + len(end) < n]
            for k, c in enumerate(end, 1):
                at = at[(code[at + k] == ord(c)) & ~first[at + k]]
            start[at + 1] = False
            past = at + len(end) + 1
            start[past[past < n]] = True
        return np.flatnonzero(start)

    def block(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents of a block, and their bounds by document."""
        if self.token_pattern is None or not any(self.token_pattern.search(d) for d in docs):
            return self._plain(docs)
        # texts are cut at added tokens; what lies between is split and merged as a text of its own
        pieces = [self.token_pattern.split(d) for d in docs]
        ids, bounds = self._plain([x for p in pieces for x in p[::2]])
        out, k, ends = [], 0, [0]
        for p in pieces:
            n = 0
            for j, x in enumerate(p):
                if j % 2:
                    out.append(np.array([self.tokens[x]], np.uint32))
                else:
                    out.append(ids[bounds[k] : bounds[k + 1]])
                    k += 1
                n += len(out[-1])
            ends.append(ends[-1] + n)
        return np.concatenate(out), np.array(ends, np.int64)

    def _plain(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        code = np.frombuffer("".join(docs).encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, docs), np.int64, len(docs)))))
        strange = code >= _LIMIT
        strange |= self.classes[np.minimum(code, _LIMIT - 1)] == _UNKNOWN
        if strange.any():
            return self._mixed(docs, np.diff(np.concatenate(([0], np.cumsum(strange)))[bounds]) > 0)
        if not len(code):
            return np.zeros(0, np.uint32), np.zeros(len(docs) + 1, np.int64)
        starts = self.split(code, bounds)
        ends = np.append(starts[1:], len(code))
        hashes = np.zeros(len(starts), U64)
        for first, last in spans_of(np.append(starts, len(code)), BLOCK_BYTES):  # runs of whole pre-tokens
            base, n = int(starts[first]), int(ends[last - 1] - starts[first])
            up, down = _Powers.upto(n + 1)
            total = np.zeros(n + 1, U64)
            np.cumsum(self.codes[code[base : base + n]] * up[:n], out=total[1:])
            hashes[first:last] = mix64((total[ends[first:last] - base] - total[starts[first:last] - base]) * down[starts[first:last] - base]) | U64(1)
        if self.n_store > _MAX_IDS:
            self.clear()
        slots = (hashes >> U64(20)).astype(np.int64) & (_SLOTS - 1)
        entries = self.slot_entry[slots]
        missed = np.flatnonzero(self.slot_hash[slots] != hashes)
        if len(missed):
            fresh, where, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            at = missed[where]
            text = code.tobytes()
            new = self._add([self.core._encode_single_piece(text[4 * a : 4 * b].decode("utf-32-le")) for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            entries[missed] = new[back]
            self.slot_hash[slots[at]] = fresh
            self.slot_entry[slots[at]] = new
        lengths = self.entry_len[entries]
        stops = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.store[np.repeat(self.entry_start[entries] - stops[:-1], lengths) + np.arange(stops[-1])]
        return ids, stops[np.searchsorted(starts, bounds)]

    def _mixed(self, docs: list[str], strange: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        plain_ids, plain = self._plain([d for d, s in zip(docs, strange) if not s])
        parts, k = [], 0
        for doc, odd in zip(docs, strange):
            if odd:
                parts.append(np.array(self.core.encode_ordinary(doc), np.uint32))
            else:
                parts.append(plain_ids[plain[k] : plain[k + 1]])
                k += 1
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def ids(self, docs: Iterable[str | None], block_chars: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first document, ids, bounds) for runs of whole documents, of which one is held at a time; null counts as empty."""
        first, chars, run = 0, 0, []
        for k, doc in enumerate(docs):
            doc = doc or ""
            if run and chars + len(doc) > block_chars:
                yield first, *self.block(run)
                first, chars, run = k, 0, []
            run.append(doc)
            chars += len(doc)
        if run:
            yield first, *self.block(run)
