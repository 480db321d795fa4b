"""Token ids of whole texts by the tokenizers library, with a bounded cache of the ids of words."""

from __future__ import annotations

import codecs
import json
import os
import re
import sys
from array import array
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_LETTERS = "a-z\xdf-\xf6\xf8-\xff"
#: Texts of these characters alone, lower-cased, are parted before closing marks (which the tokenizer parts from letters, digits and
#: white space anyway), so that there are fewer words to know; texts with a mark behind another sign are looked up as they stand.
_PLAIN = re.compile(r"[\n\x20-\x7e\xa1-\xff]*\Z")
_MARK_BEHIND_SIGN = rf"[^{_LETTERS}0-9\n !][.,!]|![.,]|!!!|<\|"  # for Arrow, in such texts
_WORD = rf"\A[{_LETTERS}]+\z"  # for Arrow
#: A word and the signs behind it, which the tokenizer parts; an apostrophe or < may begin more than signs.
_SIGNED = re.compile(rf"([{_LETTERS}]+)([!-&(-/:;=-@\[-`{{-~]+)")
#: Longer words are not kept.
LONG = 64


def _byte_letters() -> str:
    """The letter that byte-level tokenizers have for each byte, but the space for the space."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    at = dict(zip(own, own, strict=True)) | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in own)}
    return "".join(chr(at[b]) if b != 32 else " " for b in range(256))


_BYTE_LETTERS = _byte_letters()


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordTokenizer:
    """Encodes word by word, each new word once, where that is exact: for the word-wise BPE with NFC, white space and lower-case
    normalisation whose tokens never span a space or newline. Whole texts go to the library for any other tokenizer.

    Arrow parts the texts at their spaces, gives each different word a number and gathers the ids of all words by it. New words of
    lower-case Latin letters, which that normalisation leaves alone, skip it and go to the library many at a time, in the letters of
    their bytes and with spaces between them: a word's last token, and no other, ends with the model's mark for it. New words with signs
    behind them are such a word and the signs. The cache has two generations of max_words words each, of LONG characters at most, so
    some 50 MB; a full one becomes the old one, and words that come again move up.
    """

    def __init__(self, path: str, end_id: int | None = 1, max_words: int = 100_000) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.max_words = Tokenizer.from_file(path), max_words
        self.end = b"" if end_id is None else _bytes([end_id])
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        kinds = lambda part, key: [x.get("type") for x in ((made.get(part) or {}).get(key) or [])]
        self.by_words = kinds("normalizer", "normalizers") == ["NFC", "Replace", "Lowercase"] and kinds("pre_tokenizer", "pretokenizers") == ["Split", "ByteLevel"]
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer, self.bare.pre_tokenizer = None, pre_tokenizers.CharDelimiterSplit(" ")
        vocabulary, mark = self.tokenizer.get_vocab(), made["model"].get("end_of_word_suffix")
        self.by_words = self.by_words and bool(mark) and all(c in vocabulary and c + mark in vocabulary for c in _BYTE_LETTERS if c != " ")
        self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if mark and t.endswith(mark)]] = True
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _spaced(texts: list[str]) -> list[str]:
        """The texts with single spaces or runs of them between their words, and nowhere else white space that parts words."""
        low = [t.lower() if _PLAIN.match(t) else None for t in texts]
        marked = pc.match_substring_regex(pa.array(low, pa.large_string()), _MARK_BEHIND_SIGN).to_pylist()  # null, where the text is
        spaced = lambda s: s.replace(".", " .").replace(",", " ,").replace("!!", " !!").replace("\n", " ")
        return [spaced(s) if m is False else t.replace("\n", " ") for t, s, m in zip(texts, low, marked, strict=True)]

    def _learn(self, words: list[str]) -> None:
        for i in range(0, len(words), 4096):
            part = words[i : i + 4096]
            self.known.update(zip(part, [_bytes(e.ids) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)], strict=True))

    def _learn_plain(self, words: list[str], together: int = 512) -> None:
        """Words of letters alone, without normalisation, so many in one text."""
        for i in range(0, len(words), together):
            part = words[i : i + together]
            text = codecs.charmap_decode(" ".join(part).encode(), "strict", _BYTE_LETTERS)[0]
            ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends, data = ((np.flatnonzero(self.last.take(ids)) + 1) * 4).tolist(), ids.tobytes()
            self.known.update(zip(part, [data[a:b] for a, b in zip([0, *ends], ends)], strict=True))

    def _learn_all(self, words: list[str]) -> None:
        """New words of any kind."""
        plain = pc.match_substring_regex(pa.array(words, pa.large_string()), _WORD).to_numpy(zero_copy_only=False)
        self._learn_plain(list(compress(words, plain)))
        signed, others = {}, []
        for w in compress(words, ~plain):
            parts = _SIGNED.fullmatch(w.lower()) if len(w) <= LONG and _PLAIN.match(w) else None
            if parts:
                signed[w] = parts.groups()
            else:
                others.append(w)
        self._learn_plain([s for s in {a for a, _ in signed.values()} if s not in self.known])
        self._learn(others + [s for s in {b for _, b in signed.values()}.difference(others) if s not in self.known])
        self.known.update([(w, self.known[a] + self.known[b]) for w, (a, b) in signed.items()])

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of different words."""
        if len(self.known) > self.max_words:
            self.old, self.known = self.known, {}
        out = list(map(self.known.get, words))
        lacking = [i for i, x in enumerate(out) if x is None]
        new = []
        for i in lacking:
            w = words[i]
            x = self.old.get(w)
            if x is None:
                new.append(w)
            else:
                out[i] = self.known[w] = x
        self._learn_all(new)
        for i in lacking:
            if out[i] is None:
                out[i] = self.known[words[i]]
        for w in [w for w in new if len(w) > LONG]:
            del self.known[w]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Per text its ids as little-endian unsigned 32-bit integers, with the end id; null counts as empty."""
        texts = [t or "" for t in texts]
        if not self.by_words:
            return [_bytes(e.ids) + self.end for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        parts = pc.split_pattern(pa.array(self._spaced(texts), pa.large_string()), " ")
        words = parts.values.dictionary_encode()
        ids = self._known(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        at, sizes = words.indices.to_numpy(), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes))), pa.array(np.frombuffer(b"".join(ids), np.uint32)))
        data = table.take(words.indices).flatten().to_numpy().tobytes()
        ends = (4 * np.append(0, np.cumsum(sizes.take(at))))[parts.offsets.to_numpy()].tolist()
        return [data[a:b] + self.end for a, b in zip(ends, ends[1:])]


_made: dict[tuple, WordTokenizer] = {}


def tokenizer(path: str | None = None, **how) -> WordTokenizer:
    """The worker's own tokenizer, kept between tasks. No path: word_bpe_49k.json of public_tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    key = (path, *sorted(how.items()))
    if key not in _made:
        _made[key] = WordTokenizer(path, **how)
    return _made[key]


def slices(texts, most: int = 500_000):
    """(from, to) of consecutive rows with about `most` characters together."""
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= most:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
