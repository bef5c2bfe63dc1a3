"""Token ids of texts, through the public tokenizers. The library encodes; a bounded per-worker cache keeps what it gave for a word."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillspark.llm.common import slices, split_words

#: What normalises a text piece by piece.
_SAFE_NORMALIZERS = {"NFC", "Lowercase"}


def default_path(name: str) -> str:
    """Where the public tokenizers of this machine are; any other path may be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _drops_blanks(config: dict) -> bool:
    """Whether encode(text) is the concatenation of encode(word) for the words between blanks.

    So it is when normalisation is local, runs of blanks become one blank, the pre-tokenizer keeps only matches that
    hold no blank, and nothing is added before or after."""
    norms = (config.get("normalizer") or {}).get("normalizers", [])
    local = all(n["type"] in _SAFE_NORMALIZERS or n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " " for n in norms)
    steps = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = bool(steps) and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and steps[0]["pattern"] == {"Regex": _PATTERN}
    added = all(" " not in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in config.get("added_tokens") or [])
    return local and split and added and not config.get("post_processor") and not config["model"].get("dropout")


#: The pre-tokenizer's pattern for which words can be taken apart here; with any other, whole texts go to the library.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same in RE2's writing, for words without apostrophes and special strings: it counts a word's pre-tokens.
_RUNS = r"\pL+|\pN|[^\s\pL\pN]+"


class WordIds(dict):
    """word -> its ids as little-endian unsigned 32-bit integers, filled by the library on demand.

    The first most_words stay, which holds whatever is frequent; once there are so many, what a batch adds goes after it."""

    def __init__(self, path: str, most_words: int = 450_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most_words = Tokenizer.from_file(path), most_words
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.by_word = _drops_blanks(config)
        #: Which ids end a word, where the vocabulary marks word ends.
        self.suffix = config["model"].get("end_of_word_suffix")
        vocab = self.tokenizer.get_vocab() if self.suffix else {}
        self.ends = np.zeros(1 + max(vocab.values(), default=0), dtype=bool)
        self.ends[[i for w, i in vocab.items() if w.endswith(self.suffix)]] = True

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.whole(word)
        return ids

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        """Encodes new words in one call for many. Each pre-token ends with the only id that marks a word's end, so counts
        of pre-tokens, taken from the words as the normaliser leaves them, tell whose an id is. Words with an apostrophe or
        a special string go alone, and so does each of some where the counts of ends differ."""
        if not self.suffix:
            return
        plain = [w for w in new if "'" not in w and "<|" not in w]
        for i in range(0, len(plain), 20_000):
            some = plain[i : i + 20_000]
            text = " ".join(some)
            lowered = (text if text.isascii() else unicodedata.normalize("NFC", text)).lower().split(" ")
            if len(lowered) != len(some) or len(text.split()) != len(some):  # blanks beyond ASCII
                continue
            counts = pc.count_substring_regex(pa.array(lowered, pa.large_string()), _RUNS).to_numpy()
            ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = 4 * (np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1)
            if counts.min() < 1 or counts.sum() != len(ends):
                continue
            raw, at = ids.tobytes(), 0
            for w, end in zip(some, ends[np.cumsum(counts) - 1].tolist(), strict=True):
                self[w] = raw[at:end]
                at = end

    def encode_many(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each whole text, as the library gives them without special tokens added; null counts as empty.

        Words are split, numbered and put together again in bulk; only the distinct ones of a slice are looked up."""
        for some in slices(texts, 8 << 20):
            if not self.by_word:
                yield from (np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast([x or "" for x in some.to_pylist()], add_special_tokens=False))
                continue
            starts, numbers, words = split_words(some)
            self._learn([w for w in words if w and w not in self])
            raw = [self[w] if w else b"" for w in words]
            sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
            ids, at = np.frombuffer(b"".join(raw), "<u4"), np.cumsum(sizes) - sizes
            counts = sizes[numbers]
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)  # a slice has far fewer than 2^31 ids
            out = ids[np.repeat(at[numbers].astype(np.int32) - ends[:-1], counts) + np.arange(ends[-1], dtype=np.int32)].tobytes()
            edges = (4 * ends[starts].astype(np.int64)).tolist()
            for lo, hi in zip(edges, edges[1:], strict=False):
                yield out[lo:hi]
            for _ in range(len(self) - self.most_words):
                self.popitem()  # the last that came


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str, most_words: int = 450_000) -> WordIds:
    """One cache for each Python worker; workers are kept between tasks. most_words: about a quarter of a KB each."""
    if path not in _LOADED:
        pa.set_memory_pool(pa.system_memory_pool())  # texts come and go in large arrays, and this one gives memory back
        _LOADED[path] = WordIds(path)
    _LOADED[path].most_words = most_words
    return _LOADED[path]
