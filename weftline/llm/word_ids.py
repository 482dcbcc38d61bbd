"""Token ids of texts under a word-level BPE vocabulary, word by word.

Blanks and newlines part words for such a tokenizer, so a text's ids are its
words' ids one after another, and a word's ids are remembered. Plain Latin
words are merged by rank over bytes (the vocabulary's ids follow its merges,
which is checked when it is loaded), everything else is given to the
tokenizers library; both give the library's ids.
"""

from __future__ import annotations

import array
import json
import re

import tiktoken
from tokenizers import Tokenizer

REMEMBERED = 600_000
#: Letters whose lower case is one letter and that no normalisation joins to a neighbour.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#%&*$|]*)").fullmatch
END = b"\xff"  # marks a word's end; no UTF-8 text holds this byte


def _byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself if visible, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordIds(dict):
    """word -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, data: bytes):
        super().__init__()
        text = data.decode()
        self.library = Tokenizer.from_str(text)
        model = json.loads(text)["model"]
        self.core = self._ranks(model)
        self.tails: dict[str, bytes] = {"": b""}

    @staticmethod
    def _ranks(model: dict):
        """A rank merger, if ids grow along the merges and word ends are marked as expected; else None."""
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if not suffix or model.get("unk_token") or model.get("continuing_subword_prefix"):
            return None
        merged = [vocab[a + b] for a, b in merges]
        if any(x >= y for x, y in zip(merged, merged[1:])):
            return None
        letters = _byte_letters()
        ranks = {}
        for piece, i in vocab.items():
            end = piece.endswith(suffix)
            core = piece[: -len(suffix)] if end else piece
            if any(c not in letters for c in core):
                return None
            ranks[bytes(letters[c] for c in core) + (END if end else b"")] = i
        first = min(merged, default=0)
        if any(ranks.get(bytes([b]) + END, first) >= first for b in range(255)):
            return None
        return tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def _library(self, word: str) -> bytes:
        return array.array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        m = PLAIN(word) if self.core is not None else None
        if m:
            tail = self.tails.get(m[2])
            if tail is None:
                tail = self.tails[m[2]] = self._library(m[2])
                if len(self.tails) > 10_000:
                    self.tails = {"": b""}
            out = array.array("I", self.core.encode_single_piece(m[1].lower().encode() + END)).tobytes() + tail
        else:
            out = self._library(word)
        if len(word) < 64:
            self[word] = out
        return out

    def ids(self, text: str) -> bytes:
        """All ids of a text, 4 bytes each."""
        out = b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))
        if len(self) > REMEMBERED:
            self.clear()
        return out
