"""Token ids of whole texts with the word_bpe vocabulary, through the tokenizers library.

White space separates pre-tokens in this vocabulary and nothing in it joins across white space, so the ids of a text are
the ids of its blank-separated chunks in a row. A task keeps the ids of the chunks it has met, in bounded memory. Tests hold
this against encoding whole texts with the library, whatever was met before.
"""

from __future__ import annotations

import struct
import unicodedata

import regex

from kelpie.llm.common import quiet_threads

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
_FORMATS = [struct.Struct(f"<{n}I") for n in range(64)]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return (_FORMATS[len(ids)] if len(ids) < len(_FORMATS) else struct.Struct(f"<{len(ids)}I")).pack(*ids)


#: The split of the vocabulary's own pre-tokenizer (fixed value of the file).
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
#: What remembering a chunk or a piece takes beside its characters and ids, in bytes.
ENTRY = 140


class ChunkEncoder:
    """encode(text) gives the ids as little-endian unsigned 32-bit integers.

    A chunk is normalised and split into pieces as the vocabulary's file says; each new piece goes through the library's
    model, and a chunk that holds a special token goes through the library whole. At most twice `most` bytes
    of chunks and pieces are remembered, beside those of the text at hand; what is remembered never changes a result.
    """

    def __init__(self, path: str, most: int = 64 << 20):
        quiet_threads()
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.held = most, 0
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.chars: dict[str, bool] = {}
        self.word = self.tokenizer.model.tokenize
        self.normal = self.tokenizer.normalizer.normalize_str
        self.special = regex.compile("|".join(regex.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        #: A letter for each byte, as the vocabulary writes them; those that stand for themselves come first.
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        self.letters = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in own)}
        assert set(self.letters.values()) == set(ByteLevel.alphabet())

    def _settled(self, char: str) -> bool:
        """Is the character's class the same in an old and in the present version of Unicode? Others are left to the library."""
        old = unicodedata.ucd_3_2_0.category(char)[0]
        self.chars[char] = out = old != "C" and old == unicodedata.category(char)[0]
        return out

    def _piece(self, piece: str) -> bytes:
        if (ids := self.pieces.get(piece)) is None:
            self.pieces[piece] = ids = self._spelt(piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters))
            self.held += ENTRY + len(piece) + len(ids)
        return ids

    def _spelt(self, piece: str) -> bytes:
        return packed([t.id for t in self.word(piece)])

    def _ids(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if chunk.isascii():
            plain = chunk.lower()
            if plain.isalpha():
                return self._spelt(plain)
            if "<" in chunk and self.special.search(chunk):
                return self._whole(chunk)
            if plain[:-1].isalpha() and plain[-1].isprintable():
                head = self.known.get(plain[:-1]) or self.old.get(plain[:-1])
                return (head or self._spelt(plain[:-1])) + self._piece(plain[-1])
        else:
            if "<" in chunk and self.special.search(chunk):
                return self._whole(chunk)
            if max(chunk) < "\u0180" and "\u0130" not in chunk:  # Latin letters that stand composed and fold one by one
                plain = chunk.lower()
            else:
                plain, chars = self.normal(chunk), self.chars
                for c in plain:
                    if not (chars[c] if c in chars else self._settled(c)):
                        return self._whole(chunk)
            if plain.isalpha():
                return self._spelt(plain.encode().decode("latin-1").translate(self.letters))
        return b"".join(map(self._piece, PIECE.findall(plain)))

    def _whole(self, chunk: str) -> bytes:
        return packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        chunks = text.replace("\n", " ").split(" ")
        if self.held > self.most:  # what was used since the last time stays one time longer
            self.old, self.known, self.pieces, self.held = self.known, {}, {}, 0
        known, old = self.known, self.old
        for c in set(chunks).difference(known):
            known[c] = ids = old[c] if c in old else self._ids(c)
            self.held += ENTRY + len(c) + len(ids)
        return b"".join(map(known.__getitem__, chunks))


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The task process's encoder; Spark keeps worker processes, so chunks stay known from task to task."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
