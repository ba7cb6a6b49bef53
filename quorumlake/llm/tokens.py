"""Cached encoders over public vocabularies, used by token counts, token files and fertility rules.

Both caches rest on boundaries that the vocabularies prove stable: no token
crosses them, so the parts of a text are encoded apart and results joined.
Caches are bounded; a part that is not cached is encoded by the library.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

CACHE_ENTRIES = 1_500_000
#: Parts of words, words of other characters, and words with the spaces before them whose ids are kept: about 200
#: bytes each in every worker.
PART_ENTRIES, WORD_ENTRIES, UNIT_ENTRIES = 400_000, 100_000, 400_000
LONGEST_CACHED = 200


class Recent:
    """Ids of strings, in two halves: a full one replaces the older, of which only what is asked for again stays."""

    def __init__(self, entries: int):
        self.most = entries // 2
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def all(self, keys: list[str], make: Callable[[str], bytes]) -> list[bytes]:
        """The ids of each key, made where they are not kept."""
        got = list(map(self.new.get, keys))
        for i, g in enumerate(got):
            if g is None:
                key = keys[i]
                got[i] = g = self.old[key] if key in self.old else make(key)
                if len(key) <= LONGEST_CACHED:
                    if len(self.new) >= self.most:
                        self.old, self.new = self.new, {}
                    self.new[key] = g
        return got

    def many(self, keys: list[str], make: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The ids of each key; those that are not kept are made in one call."""
        got, old = list(map(self.new.get, keys)), self.old
        absent = [i for i, g in enumerate(got) if g is None]
        unknown = [i for i in absent if keys[i] not in old]
        for i, g in zip(unknown, make([keys[i] for i in unknown])):
            got[i] = g
        for i in absent:
            key = keys[i]
            if got[i] is None:
                got[i] = old[key]
            if len(key) <= LONGEST_CACHED:
                if len(self.new) >= self.most:
                    self.old, self.new = self.new, {}
                self.new[key] = got[i]
        return got


def runs(pool: np.ndarray, n: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """pool holds runs of n[0], n[1], ... values: those numbered in which, one after another, and where each of them ends."""
    sizes = n[which]
    ends = np.cumsum(sizes)
    places = np.repeat(((np.cumsum(n) - n)[which] - (ends - sizes)).astype(np.int32), sizes)
    places += np.arange(len(places), dtype=np.int32)
    return pool[places], ends


class SpacePieces:
    """A sentencepiece BPE model cut before every run of spaces.

    No piece of the vocabulary has U+2581 after another character (checked on
    load), and normalisation only maps spaces to U+2581, so a token boundary
    stands before each run of spaces whatever surrounds it.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        probe = "ﬁ①Å  x "
        plain = sentencepiece.SentencePieceNormalizer(model_file=path).normalize(probe) == "▁" + probe.replace(" ", "▁")
        self.splits = plain and not any("▁" in x.lstrip("▁") for x in names)
        #: Characters that stand side by side in some piece; no token joins two others.
        self.pairs = {x[i : i + 2] for x in names for i in range(len(x) - 1)}
        self.byte = {i for i in range(len(names)) if self.model.is_byte(i)}
        self.space = self.model.piece_to_id("▁")
        self.known = Recent(UNIT_ENTRIES)
        self.counts: dict[str, int] = {}

    def units(self, text: str) -> list[str]:
        """Parts whose tokens make up the text's: each is a word with the spaces before it, the first space left out."""
        if not text:
            return []
        if "▁" in text:
            text = text.replace("▁", " ")
        if not self.splits:
            return [text]
        parts = text.split(" ")
        if "" not in parts:
            return parts
        return [x[1:] for x in re.findall(r" +[^ ]*", " " + text)]

    def _encode(self, unit: str) -> list[int]:
        """An empty unit is one lone space: the library's dummy prefix."""
        return self.model.encode(unit) if unit else [self.space]

    def count_all(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text; new units of all of them are encoded in one call."""
        split = [self.units(t) for t in texts]
        counts = self.counts
        if len(counts) > CACHE_ENTRIES:
            counts.clear()
        new = {u for units in split for u in units if u not in counts}
        short = [u for u in new if u and len(u) <= LONGEST_CACHED]
        counts.update(zip(short, map(len, self.model.encode(short, num_threads=1))))
        counts[""] = 1
        long = {u: len(self._encode(u)) for u in new if len(u) > LONGEST_CACHED}
        get = counts.__getitem__ if not long else lambda u: long[u] if u in long else counts[u]
        return [sum(map(get, units)) for units in split]

    def count(self, text: str) -> int:
        return self.count_all([text])[0]

    def begins(self, text: str) -> list[int]:
        """Where each token begins, in bytes, by the library's offsets."""
        return [p.begin for p in self.model.encode(text, return_type="proto").pieces] if text else []

    def parts_at(self, before: str, after: str) -> bool:
        """Whether the vocabulary proves that a token ends between the two characters."""
        return (before + after).replace(" ", "▁") not in self.pairs

    def _pack(self, units: list[str]) -> list[bytes]:
        return [array("I", ids if u else [self.space]).tobytes() for u, ids in zip(units, self.model.encode(units, num_threads=1))]

    def learn(self, texts: list[str]) -> None:
        """Make the ids of the units of texts known."""
        self.arrays(texts)

    def arrays(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; new units of all of them are encoded in one call."""
        split = [self.units(t) for t in texts]
        keys = list({u for units in split for u in units})
        of = dict(zip(keys, self.known.many(keys, self._pack)))
        return [np.frombuffer(b"".join(map(of.__getitem__, units)), "<u4") for units in split]

    def ids(self, text: str) -> list[int]:
        return self.arrays([text])[0].tolist()


class AnyJson:
    """A vocabulary of the tokenizers library, encoded as it stands."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        #: The byte-level pre-tokenizer begins a word at a space after another character; texts of other vocabularies are not cut.
        self.splits = not spec["normalizer"] and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.special = [x["content"] for x in spec["added_tokens"]]

    def begins(self, text: str) -> list[int]:
        """Where each token begins, in bytes, by the library's offsets; tokens within a character begin with it."""
        at = [0, *accumulate(len(c.encode()) for c in text)] if not text.isascii() else range(len(text) + 1)
        spans = self.model.encode(text, add_special_tokens=False).offsets
        # Offsets leave a leading space out.
        return [at[a - 1] if 0 < a and text[a - 1] == " " and (k == 0 or spans[k - 1][1] < a) else at[a] for k, (a, _) in enumerate(spans)]

    def parts_at(self, before: str, after: str) -> bool:
        """A space after a letter or digit begins a word, whatever follows it."""
        return after == " " and before.isalnum() and before.isascii() and not any(" " in x for x in self.special)

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def count(self, text: str) -> int:
        return len(self.ids(text))

    def count_all(self, texts: list[str]) -> list[int]:
        return list(map(self.count, texts))

    def arrays(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.ids(t), np.uint32) for t in texts]


class WhiteSpaceWords:
    """A tokenizers-library BPE vocabulary whose pre-tokenizer drops white space.

    Such a pre-tokenizer ends a token at all white space, so texts are cut at
    ASCII white space and each different word of many texts is encoded once.
    Words with characters that Python and the library may class differently
    (other white space too), or with special strings, go to the library.
    """

    #: Letters whose class and case agree everywhere, then marks: two parts and no further look.
    LETTERS, MARKS = "".join(map(chr, (*range(65, 91), *range(97, 123), *range(192, 215), *range(216, 247), *range(248, 256)))), ".,;:!?"
    PLAIN = f"^[{LETTERS}]+[{MARKS}]*$"
    #: A fixed value: the pattern that the vocabulary file states.
    PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    EASY = re.compile(r"[!-~¡-¬®-ž]+")

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.bpe = self.whole.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        #: Words stand alone for this normalizer and pre-tokenizer only; texts of other vocabularies go to the library whole.
        split = {"type": "Split", "pattern": {"Regex": self.PARTS.pattern}, "behavior": "Removed", "invert": True}
        blank = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
        self.quick = (spec["normalizer"] or {}).get("normalizers") == [{"type": "NFC"}, blank, {"type": "Lowercase"}] and (spec["pre_tokenizer"] or {}).get("pretokenizers", [])[:1] == [split]
        self.special = [x["content"] for x in spec["added_tokens"]]
        #: The byte-level alphabet: printable bytes stand for themselves, others for code points from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.alphabet = {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}
        self.parts, self.words = Recent(PART_ENTRIES), Recent(WORD_ENTRIES)

    def _pack(self, ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def _part(self, part: str) -> bytes:
        mapped = part if part.isascii() else "".join(map(self.alphabet.__getitem__, part.encode()))
        return self._pack([t.id for t in self.bpe.tokenize(mapped)])

    def _word(self, word: str) -> bytes:
        if self.quick and self.EASY.fullmatch(word) and not any(s in word for s in self.special):
            return b"".join(self.parts.all(self.PARTS.findall(word.lower()), self._part))
        return self._pack(self.whole.encode(word, add_special_tokens=False).ids)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different words, one after another, and how many each has."""
        plain = pc.match_substring_regex(words, self.PLAIN) if self.quick else pa.array(np.zeros(len(words), bool))
        two, other = words.filter(plain), words.filter(pc.invert(plain)).to_pylist()
        letters = pc.utf8_lower(pc.utf8_rtrim(two, self.MARKS)).dictionary_encode()
        marks = pc.utf8_ltrim(two, self.LETTERS).dictionary_encode()
        known = [b"", *self.parts.all(letters.dictionary.to_pylist(), self._part)]
        after_letters = len(known)
        known += self.parts.all(marks.dictionary.to_pylist(), self._part)
        after_marks = len(known)
        known += self.words.all(other, self._word)
        # Each word is two of the known; other words are one and the empty one.
        which = np.zeros((len(words), 2), np.int64)
        plain = plain.to_numpy(zero_copy_only=False)
        which[plain, 0] = 1 + letters.indices.to_numpy()
        which[plain, 1] = after_letters + marks.indices.to_numpy()
        which[~plain, 0] = after_marks + np.arange(len(other))
        n = np.fromiter(map(len, known), np.int64, len(known)) // 4
        pool, _ = runs(np.frombuffer(b"".join(known), "<u4").astype(np.int32), n, which.ravel())
        return pool, n[which].sum(1)

    def lists(self, texts: pa.Array, end_id: int) -> pa.ListArray:
        """The ids of each text and then end_id; null is empty."""
        words = pc.fill_null(texts, "")
        stops = np.arange(1, len(words) + 1)
        if self.quick:
            split = pc.ascii_split_whitespace(words)
            words, stops = split.flatten(), np.cumsum(split.value_lengths().to_numpy())
        coded = words.dictionary_encode()
        pool, n = self._words(coded.dictionary)
        # After each text's words comes one word more: its end.
        which = np.insert(coded.indices.to_numpy(), stops, len(n))
        tokens, ends = runs(np.append(pool, np.int32(end_id)), np.append(n, 1), which)
        offsets = np.concatenate([[0], ends[stops + np.arange(len(stops))]])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens))

    def packed(self, text: str) -> bytes:
        """The ids of the text as little-endian unsigned 32-bit integers."""
        return self.lists(pa.array([text], pa.string()), 0).values.to_numpy()[:-1].astype("<u4").tobytes()


def load(path: str):
    """sentencepiece for .model, the tokenizers library for .json."""
    return SpacePieces(path) if path.endswith(".model") else AnyJson(path)
