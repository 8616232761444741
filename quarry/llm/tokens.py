"""Exact byte-level BPE encoding of whole texts with the tokenizers library, a word at a time.

The pre-tokenizer of the byte-level vocabularies always breaks before a space that follows a
non-space, around a lone line break, and between a letter or digit and the comma or full stop after
it. Texts are cut there by Arrow's string kernels, and each different cut is encoded once and remembered.
A cut could differ from encoding in one go only beside runs of white space (three, or two at the
end) and at a comma or stop that follows neither letter nor digit: such texts are encoded whole.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

_SPACES = re.compile(r"\s\s(?:\s|\Z)|\0")
_BARE_STOP = re.compile(r"[,.](?<=[\W_].)|\A[,.]", re.S)
_OTHER_SPACE = re.compile(r"(?!\A[ \n])[\s\0]")
#: The alphabet of byte-level vocabularies: printable Latin-1 stands for itself, the other bytes for U+0100 onwards.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _OWN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_OWN)))}
_LOADED: dict[tuple[str, int], ChunkEncoder] = {}


class ChunkEncoder:
    """Text -> ids as little-endian unsigned 32-bit bytes. About ``entries`` words are remembered."""

    def __init__(self, path: str, entries: int = 300_000) -> None:
        import os

        import numpy as np
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, and each thread would keep memory of its own
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.words = Tokenizer.from_file(path)  # for lists of words, already in the alphabet that stands for bytes
        self.words.encode_special_tokens = True
        self.words.pre_tokenizer = CharDelimiterSplit(_BYTES[10])
        self.words.model._resize_cache(0)  # no word comes twice
        self.entries = entries
        self.cache: dict[str, bytes] = {}
        self.special: set[str] = set()  # those remembered that are not plain words
        sizes = {i: len(t) for t, i in self.tokenizer.get_vocab().items()}  # one character stands for a byte
        self.bytes_of = np.array([sizes.get(i, 0) for i in range(max(sizes) + 1)], dtype=np.int64)

    @classmethod
    def of(cls, path: str, entries: int = 300_000) -> ChunkEncoder:
        """One per worker process and vocabulary."""
        key = (path, entries)
        if key not in _LOADED:
            _LOADED[key] = cls(path, entries)
        return _LOADED[key]

    def __enter__(self) -> ChunkEncoder:
        return self

    def __exit__(self, *_: object) -> None:
        """A worker outlives its task: give back what was remembered, for the work that comes next."""
        self.cache.clear()
        self.special.clear()
        give_back()

    def _whole(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in got]

    def _learn(self, words: set[str]) -> None:
        """Remember these words. Plain ones go through the library many at a time."""
        import numpy as np

        plain = sorted(w for w in words if _is_word(w))
        other = list(words.difference(plain))
        self.special.update(other)
        self.cache.update(zip(other, self._whole(other), strict=True))
        runs = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        mapped = ["\n".join(r).encode().decode("latin-1").translate(_BYTES) for r in runs]
        for run, got in zip(runs, self.words.encode_batch_fast(mapped, add_special_tokens=False), strict=True):
            ids = array("I", got.ids).tobytes()
            ends = np.cumsum([len(w.encode()) for w in run])
            at = np.searchsorted(np.cumsum(self.bytes_of[np.frombuffer(ids, "<u4")]), ends) + 1
            cuts = [0, *(4 * at).tolist()]
            self.cache.update(zip(run, [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.cache) > self.entries:
            self.cache.clear()
            self.special.clear()
        marks = (("\n", "\0\n\0"), (" ", "\0 "), (",", "\0,"), (".", "\0."))
        words, code, offsets, dictionary = cut_and_code(texts, marks)
        self.cache[""] = b""
        self._learn(set(words).difference(self.cache))
        # where cutting may not be exact; plain words are never the reason
        rare = list(self.special.intersection(words)) + [""]
        place = pc.index_in(pa.array(rare, pa.large_string()), dictionary)
        flags = np.zeros((3, len(words)), dtype=bool)
        for w, i in zip(rare, place.to_pylist(), strict=True):
            if i is not None:
                flags[:, i] = w[:1] in (",", ".") and w != "", not w[-1:].isalnum(), bool(_OTHER_SPACE.search(w))
        stop, bare, odd = flags
        doubt = odd[code]
        doubt[1:] |= stop[code[1:]] & bare[code[:-1]]
        at = np.flatnonzero(doubt)
        doubtful = set((np.searchsorted(offsets, at, side="right") - 1).tolist())
        for i, t in enumerate(texts):
            if "  " in t or "\n\n" in t or " \n" in t or "\n " in t or "\0" in t or t[:1] in (",", "."):
                doubtful.add(i)
        spaced = {i for i in doubtful if _SPACES.search(texts[i]) or _BARE_STOP.search(texts[i])}
        whole = dict(zip(spaced, self._whole([texts[i] for i in spaced]), strict=True))
        out = gather([self.cache[w] for w in words], code, offsets)
        return [whole.get(i, ids) for i, ids in enumerate(out)]


def cut_and_code(texts: list[str], marks: tuple[tuple[str, str], ...]):
    """Cut texts at the zero bytes that ``marks`` put in -> (different cuts, cut numbers, cuts of each text by offsets, Arrow cuts)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    marked = pa.array(texts, pa.large_string())
    for old, new in marks:
        marked = pc.replace_substring(marked, old, new)
    cuts = pc.split_pattern(marked, "\0")
    coded = cuts.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), cuts.offsets.to_numpy(), coded.dictionary


def gather(own: list[bytes], code, offsets, unit: int = 4) -> list[bytes]:
    """Join, for each text, the bytes ``own`` of its cuts; every length is a multiple of ``unit``."""
    import numpy as np

    size = np.fromiter(map(len, own), np.int64, len(own)) // unit
    start = np.cumsum(size) - size
    items = np.frombuffer(b"".join(own), f"V{unit}" if unit not in (1, 4) else f"<u{unit}")
    n = size[code]
    end = np.cumsum(n)
    out = items[np.repeat(start[code] - end + n, n) + np.arange(end[-1] if len(end) else 0)].tobytes()
    edge = (unit * np.concatenate([[0], end])[offsets]).tolist()
    return [out[a:b] for a, b in zip(edge, edge[1:], strict=False)]


def _is_word(w: str) -> bool:
    """Letters, with a space before at most."""
    return w[w[:1] == " " :].isalpha()


def give_back() -> None:
    """Return freed memory to the system, so that an idle worker is small."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public vocabulary file lies (the same on driver and executors)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def in_batches(texts: list[str], most: int = 1_200_000) -> list[range]:
    """Index ranges of at most about ``most`` characters, one text at least."""
    return _ranges([len(t) for t in texts], most)


def text_batches(column, most: int = 1_200_000) -> Iterator[tuple[range, list[str]]]:
    """The same ranges of an Arrow column of texts, each with its texts; null is empty. No more of them are Python's at a time."""
    import pyarrow.compute as pc

    for span in _ranges([n or 0 for n in pc.utf8_length(column).to_pylist()], most):
        yield span, [t or "" for t in column.slice(span.start, len(span)).to_pylist()]


def _ranges(sizes: list[int], most: int) -> list[range]:
    out, start, size = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and size + n > most:
            out.append(range(start, i))
            start, size = i, 0
        size += n
    if start < len(sizes):
        out.append(range(start, len(sizes)))
    return out
