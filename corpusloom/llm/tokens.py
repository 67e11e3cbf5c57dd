"""Token ids of whole texts under a public tokenizer, fast enough for a corpus.

``word_bpe_49k.json`` never lets a token span white space, so a text is cut at spaces and line feeds and
each piece is encoded once a task and kept in a bounded cache. The ids equal those of the whole text. Under any
other tokenizer texts are encoded whole.
Vocabularies are read where the tokenizer package has them; their path is a parameter.
"""

import os
import re
import struct

#: Tokenizer whose tokens never span a space or a line feed.
WORD_BPE = "word_bpe_49k.json"
#: Pieces that a task keeps; beyond them the cache starts anew, so memory stays bounded.
CACHE = 400_000

#: A word and signs after it.
_TAIL = re.compile(r"([^\W_]+)([!-/:-@\[-`{-~]+)\Z")


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet by its rule: printable bytes stand for themselves, the others for 256 and up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: b if b in plain else 256 + sum(x not in plain for x in range(b)) for b in range(256)}


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Pieces(dict):
    """Ids of pieces without space or line feed, as little-endian unsigned 32-bit values, in two generations."""

    def __init__(self, tokenizer, most: int):
        super().__init__({"": b""})
        self.tokenizer, self.most, self.older, self.letters = tokenizer, most, {}, _byte_letters()
        self.word = tokenizer.model.tokenize

    def _fresh(self, piece: str) -> bytes:
        if piece.isalpha() and max(piece) < "\u0250":  # one word of letters that normalisation only lower-cases
            low = piece.lower()
            if low != piece and len(low) == len(piece):
                return self[low]
            if low == piece:
                spelt = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
                return struct.pack(f"<{len(found := self.word(spelt))}I", *[t.id for t in found])
        elif (cut := _TAIL.match(piece)) and max(cut[1]) < "\u0250" and len(cut[1].lower()) == len(cut[1]):
            # letters or digits that stay such when lower-cased, then signs: no token has both
            return self[cut[1]] + self[cut[2]]
        return struct.pack(f"<{len(found := self.tokenizer.encode(piece, add_special_tokens=False).ids)}I", *found)

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self._fresh(piece)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


def encoder(path: str | None = None, cache: int = CACHE):
    """Makes a function of one text (null: empty) that gives its ids as bytes of ``<u4``. Call it once a task.

    Tasks that follow one another in a Python worker share tokenizer and cache, which hang on the tokenizer
    package because functions pickled by value have no module state of their own.
    """
    import tokenizers

    held = tokenizers.__dict__.setdefault("_corpusloom_pieces", {})
    path = path or tokenizer_path()
    if path not in held:
        held[path] = _Pieces(tokenizers.Tokenizer.from_file(path), cache)
    pieces = held[path]

    def encode(text: str | None) -> bytes:
        return b"".join(map(pieces.__getitem__, (text or "").replace("\n", " ").split(" ")))

    def whole(text: str | None) -> bytes:
        found = pieces.tokenizer.encode(text or "", add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)

    return encode if os.path.basename(path) == WORD_BPE else whole
