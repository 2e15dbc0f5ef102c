"""Token ids of whole texts with a public tokenizer file, by distinct word and, within words, by distinct stem."""

from __future__ import annotations

import json
import os
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kinmap.llm.words import LOWER, Words, listed, translated, words_of

TOKENIZER = "word_bpe_49k.json"
#: Strings whose ids a worker keeps (some 200 bytes each); when full, all go.
CACHE_WORDS = 300_000
#: New strings that are encoded as one, with a separator between them.
JOINED = 64
#: The split that ``LOWER_WORDS`` files make: contractions, runs of letters, single digits, runs of anything else.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A run of lower-case letters that composition leaves alone, then ASCII punctuation but apostrophes: two pieces of that split.
_STEM = r"^(?P<stem>[a-zß-öø-ÿ]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def gathered(ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each range one after the other, and where each begins (with the end)."""
    upto = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    at = np.arange(upto[-1], dtype=np.int32) + np.repeat((begins - upto[:-1]).astype(np.int32), sizes)
    return ids[at], upto


class Encoder:
    """Encodes strings with the tokenizers library and keeps their ids.

    Only for tokenizers that drop white space before they merge and have no special token that holds any, such as
    ``word_bpe_49k.json``: there the ids of a text are the ids of its words, one after the other. Where the file lower-cases and
    splits as that one does, the ids of a word of plain letters and punctuation are those of its lower-case stem, then of its tail; a
    stem goes through none of the file's rules but its merges, so it is encoded without them.
    """

    def __init__(self, path: str, cache_words: int | None = None) -> None:
        self.cache_words = cache_words or CACHE_WORDS
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        alone = {c: self.tokenizer.encode(c, add_special_tokens=False).ids for c in "|~^`"}
        self.separator, self.separator_id = next(((c, ids[0]) for c, ids in alone.items() if len(ids) == 1), ("", -1))
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        steps = [n["type"] for n in (rules["normalizer"] or {}).get("normalizers", ())]
        splits = [p.get("pattern", {}).get("Regex") for p in (rules["pre_tokenizer"] or {}).get("pretokenizers", ())]
        self.stems = None
        if steps == ["NFC", "Replace", "Lowercase"] and splits == [_SPLIT, None] and self.separator:
            self.stems = Tokenizer.from_file(path)
            self.stems.normalizer = normalizers.Sequence([])
            self.stems.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.begins, self.sizes, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def learn(self, strings: list[str], stems: bool) -> np.ndarray:
        """Encodes new strings, appends their ids and returns their places. Strings are joined by a separator of one id that none of
        them holds, so the ids between two separators are those of a string."""
        tokenizer = self.stems if stems else self.tokenizer
        odd = [not self.separator or self.separator in w for w in strings]
        plain, rest = [w for w, o in zip(strings, odd) if not o], [w for w, o in zip(strings, odd) if o]
        lines = [f" {self.separator} ".join([*plain[i : i + JOINED], ""]) for i in range(0, len(plain), JOINED)]
        out = np.zeros(len(strings), np.int64)
        for texts, names, mine in ((lines, plain, False), (rest, rest, True)):
            if not texts:
                continue
            got = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            flat = np.fromiter(chain.from_iterable(e.ids for e in got), np.uint32)
            if texts is lines:
                marks = np.flatnonzero(flat == self.separator_id)
                sizes = np.diff(marks, prepend=-1) - 1
                flat = np.delete(flat, marks)
            else:
                sizes = np.fromiter(map(len, got), np.int64, len(got))
            places = range(len(self.sizes), len(self.sizes) + len(names))
            self.known.update(zip(names, places, strict=True))
            out[np.fromiter((o is mine for o in odd), bool, len(odd))] = places
            self.begins = np.concatenate((self.begins, (len(self.ids) + np.cumsum(sizes) - sizes).astype(np.int32)))
            self.sizes = np.concatenate((self.sizes, sizes.astype(np.int32)))
            self.ids = np.concatenate((self.ids, flat))
        return out

    def places(self, column: pa.Array, stems: bool = False) -> np.ndarray:
        """Where the ids of each string are."""
        coded = column.dictionary_encode()
        strings = listed(coded.dictionary)
        found = np.fromiter(map(self.known.get, strings, repeat(-1)), np.int64, len(strings))
        absent = np.flatnonzero(found < 0)
        if len(absent):
            found[absent] = self.learn([strings[i] for i in absent.tolist()], stems)
        return found[coded.indices.to_numpy(zero_copy_only=False)]

    def of_words(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, begins and sizes of distinct words."""
        if self.stems is None:
            place = self.places(vocabulary)
            return self.ids, self.begins[place], self.sizes[place]
        parts = pc.extract_regex(translated(vocabulary, LOWER), _STEM)
        cut = parts.is_valid().to_numpy(zero_copy_only=False)
        own = parts.filter(pa.array(cut))
        place = np.zeros((len(vocabulary), 2), np.int64)
        place[cut, 0] = self.places(own.field("stem"), stems=True)
        place[cut, 1] = self.places(own.field("tail"))
        place[~cut, 0] = self.places(vocabulary.filter(pa.array(~cut)))
        sizes = self.sizes[place]
        sizes[~cut, 1] = 0
        ids, upto = gathered(self.ids, self.begins[place].ravel(), sizes.ravel())
        return ids, upto[:-1:2], sizes.sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) and ids (uint32) of all texts."""
        if len(self.known) > self.cache_words:
            self.clear()
        words: Words = words_of(texts)
        if not len(words.codes):
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint32)
        pool, begins, sizes = self.of_words(words.vocabulary)
        ids, upto = gathered(pool, begins[words.codes], sizes[words.codes])
        return upto[words.offsets], ids


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].cache_words = CACHE_WORDS
    return _encoders[path]
