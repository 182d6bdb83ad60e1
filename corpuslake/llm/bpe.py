"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

Encoding. An Aho-Corasick automaton over the vocabulary finds the longest token that starts at
each byte of a piece (a piece is what the vocabulary's splitting pattern yields). The encoder
takes longest matches from the left, keeps a token only if it is compatible with its left
neighbour (the merges would not have joined across the boundary) and otherwise falls back to the
token's next shorter prefix or steps back one token. Each byte position is given up at most once,
so time is linear in the piece. The result equals that of applying merges in order of rank.

Decoding gathers the tokens' bytes from one array through a table of offsets.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import Memo, by_text, held

#: The pattern that byte-level vocabularies split text with before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Unicode's White_Space; Python's own \s also holds U+001C to U+001F.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Runs between spaces: every border of these is a border of PIECES too.
RUNS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabulary files."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairCodec:
    """Encoder and decoder for a byte-level BPE file in the tokenizers library's JSON format.

    Inside, tokens are numbered by rank: bytes first, then one number per merge.
    """

    def __init__(self, path: str, cache: int = 250_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, letters = spec["model"], byte_letters()
        to_bytes = lambda token: bytes(letters[c] for c in token)
        base = [t for t in model["vocab"] if len(t) == 1]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        names = base + [a + b for a, b in merges]
        number = {t: i for i, t in enumerate(names)}
        if len(number) != len(names):
            raise ValueError(f"{path}: two merges make the same token")
        self.ids = np.array([model["vocab"][t] for t in names], np.uint32)
        self.bytes_of = [to_bytes(t) for t in names]
        self.lengths = [len(b) for b in self.bytes_of]
        self.halves = [(i, i) for i in range(len(base))] + [(number[a], number[b]) for a, b in merges]
        self.joined = {half: i for i, half in enumerate(self.halves) if i >= len(base)}
        self.table: dict[int, bool] = {}  # pair -> compatible
        usable = [i < len(base) or self._apart(*self.halves[i], i) for i in range(len(names))]
        at = {b: i for i, b in enumerate(self.bytes_of) if usable[i]}
        self.shorter = [next((at[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in at), -1) for b in self.bytes_of]
        self.automaton = ahocorasick.Automaton()
        for b, i in at.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()

        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = regex.compile(PIECES)
        self.runs = Memo(self._encode_run, cache)
        self.words = Memo(self._encode_piece, cache // 2)

        spelled = dict(zip(self.ids.tolist(), self.bytes_of)) | {i: t.encode() for t, i in self.special.items()}
        blob = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.blob = np.frombuffer(b"".join(blob), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in blob])])
        self.decimal = [str(i) for i in range(len(blob))]

    # -- the pair-compatibility table ------------------------------------------------
    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` may stand side by side in an encoding."""
        key = left << 20 | right
        known = self.table.get(key)
        if known is None:
            if len(self.table) > 2_000_000:
                self.table.clear()
            known = self.table[key] = self._apart(left, right, len(self.halves))
        return known

    def _apart(self, left: int, right: int, limit: int) -> bool:
        """No merge of a rank under ``limit`` joins across the boundary before both sides are whole.

        The later of the two tokens to be made is undone, again and again: at each step the
        tokens at the boundary are those that existed before ``limit``, and if a merge of them
        has a lower rank it would have been applied.
        """
        while True:
            if self.joined.get((left, right), limit) < limit:
                return False
            if left > right:
                limit, left = left, self.halves[left][1]
                if left == limit:
                    limit, right = right + 1, self.halves[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit, right = right + 1, self.halves[right][0]
                if right + 1 == limit:
                    limit, left = left, self.halves[left][1]
                    if left == limit:
                        return True

    # -- encoding --------------------------------------------------------------------
    def _encode_piece(self, piece: str) -> bytes:
        text = piece.encode("utf-8").decode("latin-1")
        size, lengths = len(text), self.lengths
        longest = [0] * size
        for end, token in self.automaton.iter(text):  # ends rise, so the last one is the longest
            longest[end + 1 - lengths[token]] = token
        open_at, out, at, token = [True] * (size + 1), [], 0, longest[0]
        while at < size:
            while True:
                end = at + lengths[token]
                if open_at[end] and (not out or self.compatible(out[-1], token)):
                    out.append(token)
                    at, token = end, longest[end] if end < size else -1
                    break
                if self.shorter[token] >= 0:
                    token = self.shorter[token]
                    continue
                open_at[at] = False
                token = out.pop()
                at -= lengths[token]
                break
        return self.ids[out].tobytes()

    def _encode_run(self, run: str) -> bytes:
        return b"".join([self.words[p] for p in self.pieces.findall(run)])

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; strings of special tokens become their ids."""
        if self.special_at is None or not self.special_at.search(text):
            return self._plain(text)
        parts, at = [], 0
        for m in self.special_at.finditer(text):
            parts += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], np.uint32)]
            at = m.end()
        return np.concatenate([*parts, self._plain(text[at:])])

    def _plain(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.runs.__getitem__, RUNS.findall(text))), np.uint32)

    # -- decoding --------------------------------------------------------------------
    def decode(self, ids: np.ndarray) -> bytes:
        starts = self.offsets[ids]
        sizes = self.offsets[ids + np.uint32(1)] - starts
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        return self.blob[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes()


def valid(data: bytes) -> bytes:
    """UTF-8 with what is not UTF-8 replaced by U+FFFD."""
    try:
        data.decode("utf-8")
        return data
    except UnicodeDecodeError:
        return data.decode("utf-8", "replace").encode("utf-8")


def codec(path: str) -> BytePairCodec:
    """One codec per vocabulary file and Python worker."""
    return held("bytes", path, lambda: BytePairCodec(path))


def encode_decode(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts and decodes them again: one row per document, no shuffle.

    Result: ``id_col``, ``ids`` (array<int>), ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by
    commas), ``decoded`` and ``decoded_sha256``. Null and empty texts give no ids and an empty text; very
    long texts are encoded whole, in time linear in them. Repeated rows and ids give repeated rows, null
    ids stay null, an empty table gives an empty table; other columns of ``docs`` are not read, so names
    cannot clash.
    """
    return _run(docs, vocab, id_col, text_col, keep=True)


def digests(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_decode``, without the ids and the text themselves."""
    return _run(docs, vocab, id_col, text_col, keep=False)


def _run(docs: DataFrame, vocab: str, id_col: str, text_col: str, keep: bool) -> DataFrame:
    kept = ", ids array<int>, decoded string" if keep else ""

    def rows(batches) -> Iterator[list]:
        own = codec(vocab)
        for doc_ids, texts in batches:
            out = []
            for text in texts:
                ids = own.encode(text)
                back = valid(own.decode(ids))
                spelled = ",".join(map(own.decimal.__getitem__, ids.tolist()))
                row = (len(ids), hashlib.sha256(spelled.encode()).hexdigest(), hashlib.sha256(back).hexdigest())
                out.append((*row, ids.astype(np.int32), back.decode()) if keep else row)
            yield [doc_ids, *(list(c) for c in zip(*out))]

    return by_text(docs, rows, f"id long, n_tokens long, ids_sha256 string, decoded_sha256 string{kept}", id_col, text_col).withColumnRenamed("id", id_col)
