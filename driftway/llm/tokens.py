"""Token ids of whole texts, by the tokenizers library, with a memory of the words met before."""

from __future__ import annotations

import os
import re

import numpy as np

#: Words with their ids that a worker keeps in each of two generations, and the longest word kept. When the younger one is
#: full it becomes the older one, and words of the older that come again move up; so words in use are never learnt twice.
KEPT_WORDS = 600_000
LONGEST_KEPT = 48

# Byte-level BPE never joins characters over certain borders, so pieces between them can be encoded apart from their
# text, many new ones in one call: before a blank or a line end that stands alone between two other characters, after
# such a line end, and before a full stop or comma that follows a letter or digit. Texts with white space of other forms
# are encoded whole; where a full stop or comma follows something else, it stays with its word.
_LOOSE = re.compile(r"[.,](?<![^\W_][.,])")
_CUT = "\x01"
#: Pieces that go into one text, and texts that go into one call.
_JOINED, _TOGETHER = 64, 512


def pieces_of(text: str) -> list[str] | None:
    """The text in pieces that can be encoded apart, or None."""
    if text[0] in " \n" or text[-1] in " \n" or not text.replace("\n", "").isprintable():
        return None  # isprintable() also rules out all white space but the blank
    cut = text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01")
    if "\x01 \x01" in cut or "\n\x01\x01" in cut:
        return None
    if not _LOOSE.search(text):
        cut = cut.replace(".", "\x01.").replace(",", "\x01,")
    return cut.split(_CUT)


def vocabulary() -> str:
    """The place of the public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids as little-endian unsigned 32-bit integers, none added; special tokens named in a text as the library has them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Texts with a special token's name are encoded whole, so that the library decides where it stands.
        self.named = tuple(token.content for token in self.tokenizer.get_added_tokens_decoder().values())
        self.size = self.tokenizer.get_vocab_size()
        self.line_end = int(self.whole("\n")[0])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        made = {"\n": self.whole("\n").tobytes()} if "\n" in pieces else {}
        pieces = [piece for piece in pieces if piece != "\n"]
        groups = [pieces[start : start + _JOINED] for start in range(0, len(pieces), _JOINED)]
        for start in range(0, len(groups), _TOGETHER):
            some = groups[start : start + _TOGETHER]
            encoded = self.tokenizer.encode_batch_fast(["\n".join(group) for group in some], add_special_tokens=False)
            for group, found in zip(some, encoded):
                ids = np.array(found.ids, "<u4")
                ends = [*(4 * np.flatnonzero(ids == self.line_end)).tolist(), 4 * len(ids)]
                if len(ends) != len(group):
                    raise ValueError("the vocabulary joins line ends with other characters.")
                data, begin = ids.tobytes(), 0
                for piece, end in zip(group, ends):
                    made[piece] = data[begin:end]
                    begin = end + 4
        return made

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; nothing for null and empty ones."""
        if len(self.known) > KEPT_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        split = [pieces_of(text) if text and not any(name in text for name in self.named) else None for text in texts]
        parts = [list(map(known.get, pieces)) if pieces else None for pieces in split]
        new = {p for pieces, found in zip(split, parts) if pieces and None in found for p, part in zip(pieces, found) if part is None}
        back = {piece: older[piece] for piece in new if piece in older}
        made = self._learn([piece for piece in new if piece not in back])
        made.update(back)
        known.update((piece, part) for piece, part in made.items() if len(piece) <= LONGEST_KEPT)
        out = []
        for text, pieces, found in zip(texts, split, parts):
            if pieces is None:
                out.append(self.whole(text).tobytes() if text else b"")
            else:
                out.append(b"".join([made[p] if part is None else part for p, part in zip(pieces, found)] if None in found else found))
        return out


    def forget(self) -> None:
        """Drop the remembered pieces; they are learned again when they are met again."""
        self.known, self.older = {}, {}


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
