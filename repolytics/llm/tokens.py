"""Token ids of whole texts by a public byte-level BPE, with words encoded once each."""

from __future__ import annotations

import json
import re
from array import array

import regex

from repolytics.llm.common import worker_object

#: A space is kept before the word that follows it, so a text may be cut before every
#: space followed by something else without changing its ids; texts with other runs of
#: white space are encoded in one piece.
_RUN = re.compile(r" (?=\s|\Z)")

#: Fixed value: how byte-level BPE cuts a text before its merges.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, int]:
    """The letter by which a byte-level vocabulary writes each byte: printable Latin-1
    characters are themselves, the others follow from U+0100 in order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 0x100 + i for i, b in enumerate(rest)}


def plain_bytes(cutter) -> bool:
    """Whether a pre-tokenizer is the byte-level one that _PIECES describes."""
    setting = json.loads(cutter.__getstate__()) if cutter is not None else {}
    return setting.get("type") == "ByteLevel" and not setting.get("add_prefix_space") and setting.get("use_regex", True)


class Recent(dict):
    """A table that makes what it misses and keeps the last one to two times most keys."""

    def __init__(self, make, most: int):
        super().__init__()
        self._make, self._most, self._old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self._most:
            self._old = dict(self)
            self.clear()
        value = self._old.get(key)
        if value is None:
            value = self._make(key)
        self[key] = value
        return value


class Encoder:
    """ids(text): the ids as little-endian unsigned 32-bit integers.

    The ids are those of the library at its default setting without special tokens of its
    own: the string of an added token (such as <|endoftext|>) that stands in a text gets
    that token's id.  With special=False such a string of a special token is ordinary text.

    Words between spaces, and below them the pieces the tokenizer cuts before it merges,
    are looked up in tables of bounded size, so each is encoded about once.  Texts that
    hold an added token, and all texts of vocabularies that are not plain byte-level ones,
    go through the library as they are.
    """

    def __init__(self, name: str = TOKENIZER, path: str | None = None, words: int = 150_000, pieces: int = 300_000, special: bool = True):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path or vocabulary(name))
        tokenizer.encode_special_tokens = not special
        self.size = tokenizer.get_vocab_size()
        self._library = lambda text: array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        self._marks = [t.content for t in tokenizer.get_added_tokens_decoder().values() if special or not t.special]
        self._by_table = tokenizer.normalizer is None and plain_bytes(tokenizer.pre_tokenizer)
        if not self._by_table:
            return
        merge, letters = tokenizer.model.tokenize, byte_letters()
        space = chr(letters[32])
        self._cut = tokenizer.pre_tokenizer.pre_tokenize_str

        def piece_ids(piece: str) -> bytes:
            plain = piece[0] == " " and piece.isascii() and piece[1:].isalpha()
            written = space + piece[1:] if plain else piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters)
            return array("I", [t.id for t in merge(written)]).tobytes()

        self._pieces = Recent(piece_ids, pieces)
        found = self._pieces

        def word_ids(word: str) -> bytes:
            if word.isalpha():  # most words: one piece, or one and a mark after it
                return found[" " + word]
            if word[-1] in ",." and word[:-1].isalpha():
                return found[" " + word[:-1]] + found[word[-1]]
            return self.whole(" " + word)

        self._after = Recent(word_ids, words)

    def whole(self, text: str) -> bytes:
        """The ids of any text: cut into pieces as the tokenizer does, each piece merged.

        Beyond Latin letters the tokenizer itself cuts, so that it alone decides what
        newer characters are.
        """
        if text.isascii() or max(text) < "\u0250":
            return b"".join(map(self._pieces.__getitem__, _PIECES.findall(text)))
        spans = [span for _, span in self._cut(text)]
        return b"".join([self._pieces[text[a:b]] for a, b in spans])

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self._by_table or any(mark in text for mark in self._marks):
            return self._library(text)
        if _RUN.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self.whole(first) + b"".join(map(self._after.__getitem__, rest))


def encoder(name: str = TOKENIZER, path: str | None = None) -> Encoder:
    """This worker's encoder; its tables serve the tasks until another operator's object."""
    return worker_object(f"encoder {name} {path}", lambda: Encoder(name, path))
