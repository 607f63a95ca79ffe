"""Token ids of whole texts: a worker encodes every distinct word once and gathers the rest.

A block of texts is cut into words at places where no token of the vocabulary can cross, on its bytes and all
places at once. Arrow numbers the words; their ids lie behind one another in one array, so the ids
of a block of texts are a gather over that array.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import chain
from unicodedata import category

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

END_ID = 0
ID_BYTES = 4
BYTE_BPE = "byte_bpe_50k.json"

SPECIAL = "<|endoftext|>"
MAX_WORDS = 200_000
LEARNT = 2_000  # words that the library is given at a time


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of runs that begin at ``starts``, one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - ends + lengths, lengths) + np.arange(total)


class WordTable:
    """Ids of words; ``learn`` gives those of new ones behind one another, and how many each has.

    When more than ``max_words`` words are known, the third of them that was used most is kept.
    """

    def __init__(self, learn: Callable[..., tuple[np.ndarray, np.ndarray]], max_words: int = MAX_WORDS):
        self._learn, self._max_words = learn, max_words
        self._words = None  # an Arrow array; the number of a word is its place
        self._flat = np.empty(0, "<u4")
        self._lengths = np.empty(0, np.int64)
        self._uses = np.empty(0, np.int64)

    def _forget(self) -> None:
        kept = np.argsort(-self._uses, kind="stable")[:self._max_words // 3]
        self._words = self._words.take(kept)
        starts = np.cumsum(self._lengths) - self._lengths
        self._flat = self._flat[gather(starts[kept], self._lengths[kept])]
        self._lengths = self._lengths[kept]
        self._uses = self._uses[kept] // 2  # words that are no longer used go in time

    def _add(self, words) -> None:
        import pyarrow as pa

        flat, lengths = self._learn(words)
        self._words = pa.concat_arrays([self._words, words])
        self._flat = np.concatenate([self._flat, flat])
        self._lengths = np.concatenate([self._lengths, lengths])
        self._uses = np.concatenate([self._uses, np.zeros(len(words), np.int64)])

    def encode(self, words, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind one another, and where each text's ids end.

        ``words`` is an Arrow array of the texts' words behind one another, ``counts`` says how many each has.
        """
        import pyarrow.compute as pc

        if self._words is None:
            self._words = words[:0]
        if len(self._words) > self._max_words:
            self._forget()
        coded = words.dictionary_encode()
        distinct, at = coded.dictionary, coded.indices.to_numpy()
        known = pc.index_in(distinct, value_set=self._words)
        numbers = known.fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            numbers[new] = len(self._words) + np.arange(len(new))
            self._add(distinct.take(new))
        self._uses[numbers] += np.bincount(at, minlength=len(numbers))
        starts = (np.cumsum(self._lengths) - self._lengths)[numbers]
        lengths = self._lengths[numbers][at]
        ends = np.append(0, np.cumsum(lengths))[np.cumsum(counts)]
        return self._flat[gather(starts[at], lengths)], ends


def cut_each(cut: Callable[[str], list[str]], texts: list[str]) -> tuple:
    """The words of all texts behind one another, as an Arrow array, and how many each text has."""
    import pyarrow as pa

    words = [cut(t) for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    return pa.array(chain.from_iterable(words), pa.large_string()), counts


OTHER, LETTER, NUMBER, SPACE, UNASSIGNED = range(5)
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def _kinds(top: int) -> np.ndarray:
    """What each code point below ``top`` is to the pre-tokeniser. Python's Unicode tables do not know
    the unassigned ones; newer tables may."""
    of = {"L": LETTER, "N": NUMBER}
    kinds = np.array([UNASSIGNED if k == "Cn" else of.get(k[0], OTHER)
                      for k in map(category, map(chr, range(top)))], np.uint8)
    kinds[_SPACES] = SPACE
    return kinds


def _byte_kinds(data: np.ndarray) -> np.ndarray:
    """For each byte of UTF-8 texts, what its character is; three zero bytes stand behind the texts."""
    ascii_kinds = np.zeros(256, np.uint8)
    ascii_kinds[:128] = _kinds(0x10000)[:128]
    kinds = ascii_kinds[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int32)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = first & (0x7F >> size)
        for i in range(1, 4):
            code = np.where(size > i, code << 6 | data[lead + i] & 0x3F, code)
        of = _kinds(0x10000 if size.max() < 4 else 0x110000)[code]
        for i in range(4):
            long = size > i
            kinds[lead[long] + i] = of[long]
    return kinds


def _cut(column) -> tuple:
    """The byte-level pre-tokeniser: contractions, letters, numbers, signs, white space.

    Of texts (an Arrow array of strings without nulls), gives the words' bytes behind one another as an Arrow
    array, how many each text has, and which texts have unassigned characters. That is, texts are cut by
    `` ?\\p{L}+| ?\\p{N}+|'(?:s|t|re|ve|m|ll|d)| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``, at all places at once.
    """
    import pyarrow as pa

    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    n = int(offsets[-1] - offsets[0])
    text = np.zeros(n + 3, np.uint8)
    if n:
        text[:n] = np.frombuffer(data, np.uint8, n, int(offsets[0]))
    offsets = offsets - offsets[0]
    kinds = _byte_kinds(text)
    first = np.zeros(n + 3, bool)  # of a text
    first[offsets] = True
    first[n:] = True
    start = first.copy()
    start[1:] |= kinds[1:] != kinds[:-1]
    # white space before anything else: its last character is a word, a blank belongs to what follows
    space = kinds == SPACE
    last = space[:-1] & ~space[1:] & ~first[1:]
    blank = last & (text[:-1] == 0x20)
    start[1:] &= ~blank
    long = np.flatnonzero(last & (text[:-1] >= 0x80))
    last[long] = False
    start[:-1] |= last
    for _ in range(2):
        long = long - ((text[long] & 0xC0) == 0x80)
    start[long] = True
    # contractions, where no word has the apostrophe already
    quote = np.flatnonzero((text[:n] == 0x27) & start[:n])
    a, b = text[quote + 1], text[quote + 2]
    size = np.isin(a, np.frombuffer(b"stmd", np.uint8)).astype(np.int64)
    size[((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))] = 2
    size[first[quote + 1] | (size == 2) & first[quote + 2]] = 0
    quote, size = quote[size > 0], size[size > 0]
    start[quote + 1] = False
    start[quote + 1 + size] = True
    start = np.flatnonzero(start[:n])
    odd = np.flatnonzero(kinds[:n] == UNASSIGNED)
    odd = np.unique(np.searchsorted(offsets, odd, side="right") - 1)
    counts = np.diff(np.searchsorted(start, offsets))
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, n)), pa.py_buffer(text)])
    return words, counts, odd


@cache
def byte_alphabet() -> str:
    """The characters that byte-level vocabularies write for bytes 0 to 255: printable ones stand for
    themselves, the others are numbered from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(other)) for b in range(256))


class Encoder:
    """Encode texts with a byte-level BPE file of the tokenizers library.

    Ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``: the pre-tokeniser's words are
    given to the model one by one, each distinct word once. Texts with unassigned characters go to
    the library whole; so do those with the special token's string, unless ``plain_specials`` says
    that it is ordinary text.
    """

    def __init__(self, path: str, plain_specials: bool = False, max_words: int = MAX_WORDS):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = plain_specials
        self._model = Tokenizer(self._tokenizer.model)  # of words between blanks, without special tokens
        self._model.pre_tokenizer = WhitespaceSplit()
        vocabulary = self._model.get_vocab()
        if not vocabulary.keys() >= set(byte_alphabet()):
            raise ValueError(f"{path} has no token for some bytes")
        self._token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self._token_bytes[number] = len(token)
        self._special = None if plain_specials else SPECIAL
        self._table = WordTable(self._learn, max_words)

    def _learn(self, words) -> tuple[np.ndarray, np.ndarray]:
        """A token has as many bytes as its string has characters, so the bytes tell the words apart."""
        written = np.array([ord(c) for c in byte_alphabet()] + [ord(" ")], "<u2")
        _, offsets, data = words.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(words) + 1, 8 * words.offset)
        n = int(offsets[-1] - offsets[0])
        ends = offsets[1:] - offsets[0]
        data = np.frombuffer(data, np.uint8, n, int(offsets[0])).astype(np.int64)
        text = written[np.insert(data, ends, 256)].tobytes().decode("utf-16-le")
        ids = []
        for i in range(0, len(words), LEARNT):
            stop = min(i + LEARNT, len(words)) - 1
            # each word before had a blank behind it
            part = text[ends[i - 1] + i if i else 0:ends[stop] + stop]
            ids.append(np.array(self._model.encode_batch_fast([part], add_special_tokens=False)[0].ids, "<u4"))
        flat = np.concatenate(ids)
        token_ends = np.cumsum(self._token_bytes[flat])
        return flat, np.diff(np.searchsorted(token_ends, ends, side="right"), prepend=0)

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind one another, and where each text's ids end.

        Texts are a list, or an Arrow array, without nulls.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        cut, whole = column, []
        if self._special:
            special = pc.match_substring(column, self._special)
            whole = np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist()
            cut = pc.if_else(special, "", column) if whole else column
        words, counts, odd = _cut(cut)
        ids, ends = self._table.encode(words, counts)
        whole += odd.tolist()
        if not whole:
            return ids, ends
        parts = np.split(ids, ends[:-1])
        for i in whole:
            parts[i] = np.array(self._tokenizer.encode(column[i].as_py(), add_special_tokens=False).ids, "<u4")
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])


@cache
def encoder(path: str, plain_specials: bool = False, max_words: int = MAX_WORDS) -> Encoder:
    """One word table for all tasks that a Python worker runs."""
    return Encoder(path, plain_specials, max_words)


def blocks(texts: Iterable[str], chars: int) -> Iterator[list[str]]:
    """Texts in their order, cut into lists of at least ``chars`` characters but for the last."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_batches(rows: Iterable, path: str, block_bytes: int = 2_000_000) -> Iterator[tuple]:
    """(doc_id, ids with the end id) of Arrow batches with columns doc_id, text, in their order."""
    import pyarrow as pa
    import pyarrow.compute as pc

    words, end = encoder(path), np.array([END_ID], "<u4").tobytes()
    for batch in rows:
        doc_ids = iter(batch.column(0).to_pylist())
        column = batch.column(1).fill_null("")
        column.validate(full=True)  # texts that are not UTF-8 have no ids
        size = np.cumsum(pc.binary_length(column).to_numpy().astype(np.int64))
        at = 0
        while at < len(column):
            taken = size[at - 1] if at else 0
            to = min(len(column), int(np.searchsorted(size, taken + block_bytes)) + 1)
            ids, ends = words.encode(column[at:to])
            data, start, at = ids.tobytes(), 0, to
            for stop in (ends * ID_BYTES).tolist():
                yield next(doc_ids), data[start:stop] + end
                start = stop
    pa.default_memory_pool().release_unused()  # the worker stays, beside stages that do without it


def tokenizer_path(name: str = BYTE_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
