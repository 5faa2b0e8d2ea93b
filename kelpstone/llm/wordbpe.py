"""Ids of a word-end BPE tokenizer, word by word.

For tokenizers that lower-case, drop white space, split words into pieces and
mark a piece's end inside its last symbol. Such an encoding never joins across
a space, so the ids of a text are those of its parts, one after the other.
Parts seen before are looked up; new ones of Latin letters, digits and signs
are merged in bulk by a byte-pair engine that takes ranks; all others go to the
tokenizer itself. A text that holds an added token goes to the tokenizer whole,
so its ids are the tokenizer's there, too.

The rank engine merges any neighbours whose union is a token, the tokenizer
only the pair from which the token was made. Both agree if every token is what
its own bytes are merged to: a union that lies between two neighbours has been
merged without its surroundings, so as it would be alone, and alone it goes
through the token's own pair. ``unreachable`` finds the tokens for which this
isn't so; they can never be produced, and are left out.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterable

import numpy as np

#: Words whose ids a worker remembers, and the longest word that it remembers.
CACHED_WORDS, CACHED_CHARS = 300_000, 64
#: Stand for the end of a piece and of a word; no word of the fast kind holds them.
END, NEXT = "\x1f", "\x1e"

_FAST = re.compile("[\x21-\x7e\xa1-įı-ſ]+")
_CHARS = [chr(c) for c in range(0x21, 0x180)]
_LETTERS = re.escape("".join(c for c in _CHARS if unicodedata.category(c)[0] == "L"))
_NUMBERS = re.escape("".join(c for c in _CHARS if unicodedata.category(c)[0] == "N"))
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{NEXT}{_LETTERS}{_NUMBERS}]+")
#: The split that _PIECE reproduces for its letters.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _byte_of() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, the other bytes for the letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _bytes_of(token: str, suffix: str, alphabet: dict[str, int]) -> bytes:
    end = bool(suffix) and token.endswith(suffix)
    return bytes(alphabet[c] for c in (token[: -len(suffix)] if end else token)) + END.encode() * end


def unreachable(definition: str) -> list[str]:
    """Tokens that their own symbols aren't merged to."""
    model = json.loads(definition)["model"]
    suffix = model.get("end_of_word_suffix") or ""
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ranks = {p: i for i, p in enumerate(pairs)}
    out = []
    for pair in pairs:
        token = "".join(pair)
        end = bool(suffix) and token.endswith(suffix)
        symbols = list(token[: -len(suffix)] if end else token)
        if end:
            symbols[-1] += suffix
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: (ranks.get((symbols[i], symbols[i + 1]), len(ranks)), i))
            if (symbols[best], symbols[best + 1]) not in ranks:
                break
            symbols[best : best + 2] = ["".join(symbols[best : best + 2])]
        if symbols != [token]:
            out.append(token)
    return out


class WordEncoder:
    """``encode`` gives the ids of a text, four bytes each, little-endian."""

    def __init__(self, definition: str, left_out: Iterable[str] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        #: A text that holds one of these goes to the tokenizer as a whole, which gives them ids of their own.
        self.added = [x["content"].lower() for x in json.loads(definition)["added_tokens"]]
        self.known: dict[str, bytes] = {"": b""}
        self.engine = None if left_out is None else self._engine(json.loads(definition), set(left_out))

    def _engine(self, parsed: dict, left_out: set[str]):
        import tiktoken

        model, split = parsed["model"], parsed["pre_tokenizer"]["pretokenizers"][0]
        suffix = model.get("end_of_word_suffix")
        if split.get("pattern") != {"Regex": _SPLIT} or not suffix or model.get("ignore_merges"):
            return None  # not of the kind that this engine knows
        alphabet, special = _byte_of(), {x["content"] for x in parsed["added_tokens"]}
        ids = {_bytes_of(t, suffix, alphabet): i for t, i in model["vocab"].items() if t not in left_out and t not in special}
        single = [bytes([b]) for b in range(256)]
        marked = [b + END.encode() for b in single]
        if any(b not in ids for b in single) or any(b not in ids for b in marked):
            return None
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        merged = [b for b in dict.fromkeys(_bytes_of(t, suffix, alphabet) for t in made if t not in left_out)]
        # The end mark joins its letter before anything else is merged.
        order = single + marked + merged
        self.ids = np.array([ids[b] for b in order], "<u4")
        self.stop = ord(NEXT)
        return tiktoken.Encoding("words", pat_str=f"{NEXT}|[^{END}{NEXT}]+{END}", mergeable_ranks={b: r for r, b in enumerate(order)}, special_tokens={})

    def _learn(self, words: list[str], into: dict[str, bytes]) -> None:
        fast = [w for w in words if _FAST.fullmatch(w)] if self.engine else []
        if fast:
            ranks = self.engine.encode_to_numpy(_PIECE.sub(rf"\g<0>{END}", NEXT.join(fast).lower()), disallowed_special=())
            stops = np.flatnonzero(ranks == self.stop)
            data = self.ids[ranks].tobytes()
            ends = (4 * stops).tolist()
            for word, low, high in zip(fast, [0, *(e + 4 for e in ends)], [*ends, len(data)], strict=True):
                into[word] = data[low:high]
        slow = [w for w in words if w not in into]
        for word, found in zip(slow, self.tokenizer.encode_batch(slow, add_special_tokens=False) if slow else (), strict=True):
            into[word] = np.array(found.ids, "<u4").tobytes()

    def _holds_added(self, text: str) -> bool:
        # Few texts hold their first sign. Letters may differ in case where a token is sought in normalised text.
        if not any(x[0] in text or x[0].upper() in text for x in self.added):
            return False
        low = text.lower()
        return any(x in low for x in self.added)

    def encode(self, text: str) -> bytes:
        if self._holds_added(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = text.replace("\n", " ").split(" ")
        try:
            return b"".join(map(self.known.__getitem__, parts))
        except KeyError:
            pass
        if len(self.known) > CACHED_WORDS:
            self.known = {"": b""}
        missing = list({p for p in parts if p not in self.known})
        self._learn([p for p in missing if len(p) <= CACHED_CHARS], self.known)
        long: dict[str, bytes] = {}
        self._learn([p for p in missing if len(p) > CACHED_CHARS], long)
        return b"".join([self.known[p] if p in self.known else long[p] for p in parts])


_encoders: dict[int, WordEncoder] = {}


def encoder_of(definition: str, left_out: list[str]) -> WordEncoder:
    """The worker's encoder for a definition; it outlives a task, and with it the words that it knows."""
    key = zlib.crc32(definition.encode())
    if key not in _encoders:
        _encoders[key] = WordEncoder(definition, left_out)
    return _encoders[key]
