"""Cutting a text into the pieces whose byte-level BPE encodings just add up.

The tokenizer's pre-tokens never hold white space except for one leading space,
so two places are always pre-token borders: between a visible character and
white space, and before a space that a visible character follows. Cutting only
there leaves pieces (a word with its leading space and its punctuation) that the
tokenizer encodes alone exactly as it does in the text, whatever it takes for a
letter or a digit. A piece is thus a safe key for a lookup table.
"""

from __future__ import annotations

import os
import re

import public_tokenizers

#: White space that the plain split below doesn't cover: runs, and kinds other than space and line feed.
_UNUSUAL = re.compile(r"\s\s|[^\S \n]")
_CUT = re.compile(r"(?= \S)|(?<=\S)(?=\s)")
#: The same for ASCII texts, as plain strings, which are found much faster.
_UNUSUAL_ASCII = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c")
#: Keys longer than this are rare: they are encoded where they are met and kept by no cache.
MOST_KEPT = 256
#: Python counts these four as white space, Unicode's White_Space doesn't: such a text is one piece.
_SEPARATORS = re.compile("[\x1c-\x1f]")

DEFAULT_TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    """The ``tokenizers`` encoder of a file, on one thread, as Spark runs a task on each core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special_strings(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


class Cutter:
    """Cuts texts into keys; ``piece(key)`` gives the string that a key stands for.

    Most keys are a piece without its leading space, so that ``str.split`` makes
    them; a key that begins with a line feed is the piece itself, and one that
    begins with NUL stands for what follows the NUL.
    """

    def __init__(self, specials: list[str]):
        self.specials = specials
        self.marker = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None

    def keys(self, text: str) -> list[str]:
        if self.marker is not None and any(s in text for s in self.specials):
            return [k for part in self.marker.split(text) for k in (["\0" + part] if part in self.specials else self._plain(part))]
        return self._plain(text)

    @staticmethod
    def _plain(text: str) -> list[str]:
        if not text:
            return []
        if "\0" in text or _SEPARATORS.search(text):
            return ["\0" + text]
        if any(s in text for s in _UNUSUAL_ASCII) if text.isascii() else _UNUSUAL.search(text):
            return ["\0" + p for p in _CUT.split(text) if p]
        keys = text.replace("\n", " \n").split(" ")
        keys[0] = "\0" + keys[0]
        return keys

    @staticmethod
    def piece(key: str) -> str:
        if key.startswith("\0"):
            return key[1:]
        return key if key.startswith("\n") else " " + key
