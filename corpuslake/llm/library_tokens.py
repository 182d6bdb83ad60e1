"""Ids as the tokenizers library gives them, with repeated words encoded once.

Texts are cut at white space that is a border for the vocabulary's own pre-tokeniser; the library
encodes each distinct part once per worker. Texts that hold a special token's string go to the
library whole. For vocabularies of one known shape Arrow cuts the texts and puts the ids in place, so
Python sees only the distinct words of many texts.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

from .bpe import RUNS
from .common import held

#: Latin letters before an ASCII character that is no letter: both kinds of vocabulary have a border there, so
#: "word", "word," and "word." share one entry of the cache.
LETTERS = r"[A-Za-zÀ-ÖØ-öø-ÿ]++(?![^\x00-@\[-`{-\x7f])"
#: Vocabularies that keep white space.
BYTE_PARTS = re.compile(f" ?{LETTERS}|{RUNS.pattern}")
#: Vocabularies that drop white space: any ASCII white space is a border.
WORDS = re.compile(LETTERS + r"|[^ \t\n\r]+")
#: Normaliser and pre-tokeniser of vocabularies whose texts Arrow cuts: letters are a piece up to what is no letter.
SHAPE = (
    r'''Sequence(normalizers=[NFC(), Replace(pattern=Regex("\s+"), content=" "), Lowercase()])''',
    r'''Sequence(pretokenizers=[Split(pattern=Regex("'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), behavior=Removed, invert=True), '''
    r'''ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])''',
)
#: The border of ``LETTERS``, as Arrow finds it.
BORDER = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-/:-@\[-`{-\x7f])"
#: Words that are one piece in any case; the model alone gives their ids.
PIECE = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: The letters that stand for bytes in byte-level vocabularies; printable ones stand for themselves.
BYTES = dict(zip([*range(0x21), *range(0x7F, 0xA1), 0xAD], range(0x100, 0x144)))


class LibraryTokens:
    def __init__(self, path: str, cache: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        byte_level = isinstance(self.library.pre_tokenizer, pre_tokenizers.ByteLevel)
        self.parts = BYTE_PARTS if byte_level else WORDS
        self.lower = not byte_level and "Lowercase" in repr(self.library.normalizer)
        self.model = self.library.model if (repr(self.library.normalizer), repr(self.library.pre_tokenizer)) == SHAPE else None
        self.memo, self.old, self.limit = {}, {}, cache

    def _ids(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain(self, text: str) -> str | None:
        """A text, with A-Z small where that changes no id; None if it holds a special token's string."""
        if any(s in text for s in self.special):
            return None
        if self.lower:
            low = text.encode().lower().decode()  # A-Z only
            # The library composes letters first and makes them small then. With A-Z small beforehand that
            # gives the same where there is nothing to compose, before or after.
            plain = text.isascii() or unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)
            if plain and not any(s in low for s in self.special):
                text = low
        return text

    def _learn(self, words: Iterable[str]) -> None:
        memo, old, fresh = self.memo, self.old, []
        for w in words:
            if w not in memo:
                if w in old:
                    memo[w] = old[w]
                elif self.model and PIECE.fullmatch(w):
                    memo[w] = array("I", [t.id for t in self.model.tokenize(w.lower().encode().decode("latin-1").translate(BYTES))]).tobytes()
                else:
                    fresh.append(w)
        for w, found in zip(fresh, self.library.encode_batch_fast(fresh, add_special_tokens=False)):
            memo[w] = array("I", found.ids).tobytes()

    def encode_all(self, texts: Iterable[str], at_once: int = 500_000) -> Iterator[bytes]:
        """Ids of each text as unsigned 32-bit integers; new words of about ``at_once`` letters go to the library together."""
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= at_once:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        plain = [self._plain(t) for t in texts]
        found = (self._by_words if self.model else self._by_parts)([t or "" for t in plain])
        for text, known, ids in zip(texts, plain, found):
            yield self._ids(text) if known is None else ids
        if len(self.memo) > self.limit:
            self.memo, self.old = {}, self.memo

    def _by_parts(self, texts: list[str]) -> Iterator[bytes]:
        split = [self.parts.findall(t) for t in texts]
        self._learn(set().union(*split))
        for parts in split:
            yield b"".join(map(self.memo.__getitem__, parts))

    def _by_words(self, texts: list[str]) -> Iterator[bytes]:
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(pa.array(texts, pa.large_string()), BORDER, r"\1 \2"))
        words = cut.flatten().dictionary_encode()
        known = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn(known)
        ids = pa.array(map(self.memo.__getitem__, known), pa.large_binary()).take(words.indices)
        _, starts, data = ids.buffers()
        at, ends = memoryview(starts).cast("q"), cut.offsets.to_pylist()
        for a, b in zip(ends, ends[1:]):
            yield data[at[a] : at[b]].to_pybytes() if at[a] < at[b] else b""


def library_tokens(path: str, cache: int = 500_000) -> LibraryTokens:
    """One per vocabulary file and Python worker; up to twice ``cache`` parts are kept with their ids."""
    return held("tokens", (path, cache), lambda: LibraryTokens(path, cache))
