"""Exact token ids of long texts, word by word.

The vocabulary used here drops white space and never joins characters across
it, so the ids of a text are the ids of its white-space-separated words in
order. Words repeat, so each worker process keeps the ids of short words. New
words are encoded together: those of letters only are one token run each, so
they are joined into one string and cut apart at the tokens that end a word;
punctuation behind such a word is a run of its own. A text that holds one of the
vocabulary's own control strings is encoded as a whole.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

from quarry.llm._shared import only

#: Words kept per worker process in each of two generations, and the longest one
#: kept. When the younger generation is full the older one is dropped, so memory
#: is bounded and words in use stay.
CACHED_WORDS, CACHED_BYTES = 450_000, 48
#: Bytes of text whose words are looked up together, and new words per encoded string.
_TOGETHER, _JOINED = 1 << 18, 400
#: Punctuation that never belongs to a word before it (the apostrophe may).
_TAIL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")

_encoders: dict[tuple, "WordEncoder"] = {}


def _ends_in_letter(word: str) -> bool:
    """A word of letters that is still one when it is normalised: some letters become
    a letter and a mark there, and a mark joins the punctuation behind it."""
    return word.isalpha() and unicodedata.normalize("NFC", word).lower()[-1].isalpha()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    def __init__(self, path: str, cached_words: int | None = None):
        self._most = CACHED_WORDS if cached_words is None else cached_words
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        control = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._control = re.compile(b"|".join(re.escape(c.encode()) for c in control)) if control else None
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._known: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}

    def encode_all(self, texts: Iterable[bytes | None]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers; null: none."""
        held, size = [], 0
        for text in texts:
            held.append(text or b"")
            size += len(held[-1])
            if size > _TOGETHER:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)

    def encode(self, text: bytes) -> bytes:
        return next(self.encode_all([text]))

    def _encode(self, texts: list[bytes]) -> Iterator[bytes]:
        # the vocabulary is lower case; A-Z need no rows of their own
        whole = {i for i, t in enumerate(texts) if self._control and self._control.search(t)}
        words = [[] if i in whole else t.lower().split() for i, t in enumerate(texts)]
        known = self._known
        found = [list(map(known.get, w)) for w in words]
        new = {w: None for some, ids in zip(words, found) if None in ids for w, p in zip(some, ids) if p is None}
        if new:
            fresh = self._learn(list(new))
            found = [[fresh[w] if p is None else p for w, p in zip(some, ids)] if None in ids else ids for some, ids in zip(words, found)]
        for i, ids in enumerate(found):
            yield self._whole(texts[i]) if i in whole else b"".join(ids)

    def _learn(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that the younger generation does not hold, which keeps them."""
        known, older = self._known, self._older
        made: dict[bytes, bytes] = {}
        plain, letters, rest, split, long = {}, {}, {}, [], []
        for word in new:
            if (ids := older.get(word)) is not None:
                made[word] = ids
                continue
            if len(word) > CACHED_BYTES:
                long.append(word)
            core = word.rstrip(_TAIL)
            if core.isalpha():
                held = plain
            elif core and _ends_in_letter(core.decode("utf-8", "replace")):
                held = letters
            else:
                rest[word] = None
                continue
            if len(core) == len(word):
                held[word] = None
                continue
            tail = word[len(core) :]
            split.append((word, core, tail))
            for part, to in ((core, held), (tail, rest)):
                if (ids := known.get(part) or older.get(part)) is not None:
                    made[part] = ids
                else:
                    to[part] = None
        self._letters(list(plain), made, True)
        self._letters(list(letters), made, False)
        self._singly(list(rest), made)
        for word, core, tail in split:
            made[word] = made[core] + made[tail]
        if len(known) + len(made) > self._most:
            self._older, self._known = known, {}
        if len(made) <= self._most:
            self._known.update(made)
            for word in long:
                self._known.pop(word, None)
                self._known.pop(word.rstrip(_TAIL), None)
        return made

    def _letters(self, words: list[bytes], into: dict[bytes, bytes], ascii_only: bool) -> None:
        """Ids of words of letters, many in one string. Lower-case ASCII needs neither
        normalisation nor a pattern to be split by."""
        if not words:
            return
        from tokenizers import normalizers, pre_tokenizers

        tokenizer = self._tokenizer
        groups = [words[i : i + _JOINED] for i in range(0, len(words), _JOINED)]
        joined = [b" ".join(g).decode("utf-8", "replace") for g in groups]
        usual = tokenizer.normalizer, tokenizer.pre_tokenizer
        tokenizer.encode_special_tokens = True
        try:
            if ascii_only:
                tokenizer.normalizer = normalizers.Sequence([])
                tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
                    [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
                )
            encoded = tokenizer.encode_batch_fast(joined, add_special_tokens=False)
        finally:
            if ascii_only:
                tokenizer.normalizer, tokenizer.pre_tokenizer = usual
        for group, found in zip(groups, encoded):
            ids = np.array(found.ids, dtype="<u4")
            stops = (np.flatnonzero(self._ends[ids]) + 1) * 4
            if stops.size != len(group):  # normalisation gave a word more than one run
                self._singly(group, into)
                continue
            flat, start = ids.tobytes(), 0
            for word, stop in zip(group, stops.tolist()):
                into[word] = flat[start:stop]
                start = stop

    def _singly(self, words: list[bytes], into: dict[bytes, bytes]) -> None:
        if not words:
            return
        self._tokenizer.encode_special_tokens = True
        texts = [w.decode("utf-8", "replace") for w in words]
        for word, found in zip(words, self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            into[word] = np.array(found.ids, dtype="<u4").tobytes()

    def _whole(self, text: bytes) -> bytes:
        self._tokenizer.encode_special_tokens = False
        ids = self._tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()


def encoder(path: str, cached_words: int | None = None) -> WordEncoder:
    """One encoder per worker process, vocabulary and number of words kept."""
    only("tokens", _encoders.clear)
    key = path, cached_words
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(path, cached_words)
    return _encoders[key]
