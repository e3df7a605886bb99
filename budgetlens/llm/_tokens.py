"""Public tokenizers with worker-wide memos.  The path of a vocabulary file is always a parameter."""

from __future__ import annotations

import base64
import struct

from . import _spark

#: Entries that a memo may hold; beyond, it starts anew.  It changes speed only.
MEMO = 300_000
#: Longer pieces are not kept.
MEMO_CHARS = 64
#: Controls that str.split() takes for white space and the tokenizers do not.
ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Memo(dict):
    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, piece: str):
        value = self.make(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = value
        return value


class WordEncoder:
    """Ids of a tokenizer that drops white space and never merges across it: each word is encoded once.

    encode() gives little-endian unsigned 32-bit ids, as ``Tokenizer.encode(text, add_special_tokens=False)`` has them.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = _Memo(self._word)
        # byte-level symbols: printable bytes stand for themselves, the others for the code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.symbols = {b: b for b in plain} | {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(plain)))}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        cache = _spark.worker_cache()
        if ("words", path) not in cache:
            cache["words", path] = cls(path)
        return cache["words", path]

    def _plain(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        """Ids of a word: one of Latin letters is one pre-token for the model, a stop at its end one of its own."""
        if max(word) <= "\xff":
            if word[-1] in ",." and word[-2:-1].isalpha():
                return self.memo[word[:-1]] + self.memo[word[-1]]
            if word.isalpha():
                if (low := word.lower()) != word:
                    return self.memo[low]
                ids = [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.symbols))]
                return struct.pack(f"<{len(ids)}I", *ids)
        return self._plain(word)

    def encode(self, text: str) -> bytes:
        if any(c in text for c in ODD_SPACE):
            return self._plain(text)
        return b"".join(map(self.memo.__getitem__, text.split()))


class PieceCounter:
    """Pre-tokens and their token counts for a byte-level vocabulary in rank form."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.memo = _Memo(lambda piece: len(self.encoding.encode_ordinary(piece)))

    @classmethod
    def of(cls, path: str) -> PieceCounter:
        cache = _spark.worker_cache()
        if ("pieces", path) not in cache:
            cache["pieces", path] = cls(path)
        return cache["pieces", path]
