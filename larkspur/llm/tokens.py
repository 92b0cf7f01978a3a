"""Token ids of whole texts by a public word-level BPE, with tables of words and pieces.

The vocabulary's pre-tokenizer never joins characters across white space, so the
ids of a text are those of its white-space separated words one after another, and
those of a word are those of the pieces (letters, one digit, signs) that the
pre-tokenizer cuts it into.  Each worker numbers the words it has met; a block of
texts is split and numbered by Arrow and its ids are gathered by numpy, so that
Python sees a word once and the tokenizer a piece once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words and pieces kept by a worker, which starts anew when full; characters whose words are numbered together.
CACHE_WORDS, CACHE_PIECES, BLOCK_CHARS = 500_000, 500_000, 6_000_000
#: Texts with these go to the tokenizer whole: its special tokens, and controls that not everything splits at.
_WHOLE = r"<\|(?:startoftext|endoftext)\|>|[\x1c-\x1f]"
#: Marks may join with the letter before them, in one case and not in the other: such texts keep their case.
_MARKS = r"\p{M}"
#: Words with characters beyond Latin, or whose lower case is two of them, go to the tokenizer as they are.
_ODD = r"[^\x21-\x{12f}\x{131}-\x{24f}]"
# The normalizer, pre-tokenizer and word end that the rules above hold for, as the vocabulary's file states them.
NORMALIZER = ("NFC", "Replace", "Lowercase")
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def splits_at_spaces(path: str) -> bool:
    """Whether the file's normalizer and pre-tokenizer are those that the tables rely on."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    normal = [n.get("type") for n in (told.get("normalizer") or {}).get("normalizers", [])]
    cut = ((told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return tuple(normal) == NORMALIZER and cut.get("pattern", {}).get("Regex") == PIECE and bool(cut.get("invert"))


class WordIds:
    """block(texts): each text's token ids as an array of little-endian unsigned 32-bit numbers.

    A vocabulary that cuts words in another way gets every text whole."""

    def __init__(self, path: str, room: int = CACHE_WORDS, pieces: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer, self.by_words = Tokenizer.from_file(path), splits_at_spaces(path)
        self.words, self.pieces = _Table(room, self._of_words), _Table(pieces, self._of_pieces)

    def ids(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Each text's ids as bytes."""
        block: list[str] = []
        size = 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size >= BLOCK_CHARS:
                yield from (own.tobytes() for own in self.block(pa.array(block, pa.large_string())))
                block, size = [], 0
        yield from (own.tobytes() for own in self.block(pa.array(block, pa.large_string())))

    def block(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of an array without nulls."""
        texts = texts.cast(pa.large_string())
        whole = pc.match_substring_regex(texts, _WHOLE) if self.by_words else pa.array(np.ones(len(texts), bool))
        kept = pc.if_else(whole, "", texts)
        words = pc.utf8_split_whitespace(pc.if_else(pc.match_substring_regex(kept, _MARKS), kept, pc.ascii_lower(kept)))
        found, bounds = self.words.gather(words)
        for i, odd in enumerate(whole.to_pylist()):
            yield self._whole(texts[i].as_py()) if odd else found[bounds[i] : bounds[i + 1]]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words, one after another, and how many each has: by their pieces where these are plain."""
        column = pa.array(words, pa.large_string())
        odd = pc.match_substring_regex(column, _ODD)
        plain = pc.utf8_lower(pc.if_else(odd, "", column))
        found, bounds = self.pieces.gather(pc.utf8_split_whitespace(pc.replace_substring_regex(plain, PIECE, r"\0 ")))
        sizes = np.diff(bounds)
        strange = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        if len(strange):
            more, more_sizes = self._encode([words[i] for i in strange.tolist()])
            parts, ends = np.split(found, bounds[1:-1]), np.cumsum(more_sizes)
            for i, a, b in zip(strange.tolist(), (ends - more_sizes).tolist(), ends.tolist(), strict=True):
                parts[i] = more[a:b]
            found = np.concatenate(parts)
            sizes[strange] = more_sizes
        return found, sizes

    def _of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [], []
        for at in range(0, len(pieces), 20_000):
            part = pieces[at : at + 20_000]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids.append(np.array(found.ids, "<u4"))
            sizes.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(part)))  # a piece is a word here
        return np.concatenate(ids), np.concatenate(sizes)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [], []
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0, *(len(w) + 1 for w in part[:-1])])
            word = np.searchsorted(starts, np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids)), side="right") - 1
            ids.append(np.array(found.ids, "<u4"))
            sizes.append(np.bincount(word, minlength=len(part)))
        return np.concatenate(ids), np.concatenate(sizes)


class _Table:
    """Ids of texts met before: at most ``room``, then it starts anew."""

    def __init__(self, room: int, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.room, self.learn = room, learn
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.ends, self.ids = np.zeros(1024, np.int64), np.zeros(1 << 14, "<u4")  # 4 bytes an id

    def gather(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all members of lists of texts, and where each list's begin."""
        flat = lists.flatten().dictionary_encode()
        numbers = pa.array(self._numbers(flat.dictionary.to_pylist()))
        n = len(self.number)
        held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(self.ends[: n + 1]), pa.py_buffer(self.ids)])
        taken = held.take(numbers.take(flat.indices))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] >> 2
        ids = np.frombuffer(taken.buffers()[2] or b"", "<u4")
        return ids, ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]

    def _numbers(self, texts: list[str]) -> np.ndarray:
        """The number of each of some distinct texts."""
        number = self.number
        new = [x for x in texts if x not in number]
        if len(number) + len(new) > self.room:
            self._clear()
            number = self.number
            new = [x for x in texts if x]
        if new:
            ids, sizes = self.learn(new)
            first = len(number)
            number.update(zip(new, range(first, first + len(new)), strict=True))
            used = int(self.ends[first]) >> 2
            self.ends = _grown(self.ends, first + len(new) + 1)
            self.ends[first + 1 : first + len(new) + 1] = 4 * (used + np.cumsum(sizes))
            self.ids = _grown(self.ids, used + len(ids))
            self.ids[used : used + len(ids)] = ids
        return np.fromiter(map(number.__getitem__, texts), np.int32, len(texts))


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array with room for so many values, at least twice what it had."""
    return array if size <= len(array) else np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])


@lru_cache(maxsize=1)
def word_ids(path: str, room: int = CACHE_WORDS) -> WordIds:
    """The encoder of this process: tasks of one worker share its tables."""
    return WordIds(path, room, min(room, CACHE_PIECES))
