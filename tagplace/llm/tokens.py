"""Exact use of a byte-level BPE tokenizer over batches of texts: each distinct word is encoded once and remembered.

The tokenizer's pattern always breaks before a space that has a non-space on either side, and merges never cross
a break. So a text is cut there into pieces; the distinct pieces of a batch are found by a dictionary encoding,
and their ids are looked up or made by the tokenizers library, many at a time. A piece that ends in ASCII
punctuation after a letter or digit breaks there too, so its word is what is remembered. A text's first piece
(no space before it), a last one that ends in white space, and texts that hold an added token are encoded on
their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import sized, trim

_CUT = re.compile(r"(?<=\S) (?=\S)")
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space that forbids cutting at every space, a piece's last white space, and a last letter or digit (RE2
#: syntax; the classes of characters below U+0250 are the same in all libraries).
_SPACES = r"\t\n\r\v\f\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD = r"  | \n|\n |^ | $|[" + _SPACES.replace(r"\n", "") + "]"
_SPACE_LAST, _LETTER_LAST = rf"[ {_SPACES}]\z", r"[0-9A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]\z"
#: Bytes of the longest word that is remembered for long; bytes of text, and new words, that are encoded together (the
#: tokenizers library takes some hundred bytes for each of text).
MAX_WORD, BATCH_BYTES, NEW_WORDS = 64, 2 << 20, 2000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``start`` and hold ``size`` numbers, one after the other."""
    stop = np.cumsum(size)
    return flat[np.repeat(start - (stop - size), size) + np.arange(stop[-1])] if len(stop) else flat[:0]


class Words:
    """Ids by word, as columns: the words, where their ids begin in ``flat``, and when each was last used."""

    def __init__(self, most: int):
        self.most, self.turn = most, 0
        self.known, self.flat, self.size, self.used = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def look_up(self, words: pa.Array, learn) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, start, size) with the ids of these distinct words; ``learn`` gives (ids, sizes) of new ones."""
        self.turn += 1
        at = pc.index_in(words, value_set=self.known)
        new = words.filter(pc.is_null(at))
        if len(new):
            ids, size = learn(new)
            self.known, self.flat = pa.concat_arrays([self.known, new]), np.concatenate([self.flat, ids])
            self.size, self.used = np.concatenate([self.size, size]), np.concatenate([self.used, np.zeros(len(new), np.int64)])
        at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        at[at < 0] = np.arange(len(self.known) - len(new), len(self.known))
        self.used[at] = self.turn
        flat, start, size = self.flat, (np.cumsum(self.size) - self.size)[at], self.size[at]
        if len(self.known) > self.most:
            self._forget()
        return flat, start, size

    def _forget(self) -> None:
        """Keep the half that was used last, without very long words."""
        keep = np.argsort(-self.used, kind="stable")[: self.most // 2]
        keep = np.sort(keep[pc.binary_length(self.known).to_numpy()[keep] <= MAX_WORD])
        self.flat = _gather(self.flat, (np.cumsum(self.size) - self.size)[keep], self.size[keep])
        self.known, self.size, self.used = self.known.take(pa.array(keep)), self.size[keep], self.used[keep]


class PieceEncoder:
    """Ids of whole texts. ``max_words`` bounds the memory, about 50 bytes a word."""

    def __init__(self, path: str, max_words: int = 200_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.starts = np.zeros(max(vocab.values()) + 1, bool)
        self.starts[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True  # a token that begins with a space
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.words, self.tails = Words(max_words), Words(10_000)

    def plain(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of texts that are encoded one by one."""
        ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], "<u4"), np.fromiter(map(len, ids), np.int64, len(ids))

    def _spaced(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words with a space before each, ``NEW_WORDS`` at a time."""
        made = [self._joined(words.slice(a, NEW_WORDS).to_pylist()) for a in range(0, len(words), NEW_WORDS)]
        return np.concatenate([ids for ids, _ in made]), np.concatenate([size for _, size in made])

    def _joined(self, own: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words with a space before each, encoded as one text where no word holds a space."""
        if not any(" " in w for w in own):
            ids = np.array(self.tok.encode_batch_fast([" " + " ".join(own)], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(self.starts[ids])
            if len(at) == len(own):
                return ids, np.diff(np.append(at, len(ids)))
        return self._alone([" " + w for w in own])

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of distinct pieces that stand between spaces."""
        core = pc.utf8_rtrim(pieces, characters=_PUNCTUATION)
        core = pc.if_else(pc.match_substring_regex(core, _LETTER_LAST), core, pieces)
        found = core.dictionary_encode()
        flat, start, size = self.words.look_up(found.dictionary, self._spaced)
        code = found.indices.to_numpy()
        start, size = start[code], size[code]
        tailed = pc.not_equal(pc.binary_length(core), pc.binary_length(pieces))
        at = np.flatnonzero(tailed.to_numpy(zero_copy_only=False))
        if not len(at):
            return _gather(flat, start, size), size
        whole, short = (x.filter(tailed).to_numpy(zero_copy_only=False).tolist() for x in (pieces, core))
        tails = pa.array([p[len(c) :] for p, c in zip(whole, short, strict=True)], pa.string()).dictionary_encode()
        more, from_, long = self.tails.look_up(tails.dictionary, lambda new: self._alone(new.to_pylist()))
        starts, sizes = np.zeros((len(pieces), 2), np.int64), np.zeros((len(pieces), 2), np.int64)
        starts[:, 0], sizes[:, 0] = start, size
        code = tails.indices.to_numpy()
        starts[at, 1], sizes[at, 1] = from_[code] + len(flat), long[code]
        return _gather(np.concatenate([flat, more]), starts.ravel(), sizes.ravel()), sizes.sum(1)

    def _cut(self, text: str) -> list[str]:
        return [text] if self.added and self.added.search(text) else _CUT.split(text)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; number of ids of each text). A null counts as empty."""
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        odd = pc.match_substring_regex(texts, _ODD)
        if self.added:
            odd = pc.or_(odd, pc.match_substring_regex(texts, self.added.pattern))
        cut = pa.array([self._cut(t) for t in texts.to_pylist()], pa.list_(pa.string())) if pc.any(odd).as_py() else pc.split_pattern(texts, " ")
        offsets, found = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
        offsets = offsets - offsets[0]
        codes, distinct = found.indices.to_numpy().astype(np.int64), found.dictionary
        first, last = offsets[:-1], offsets[1:] - 1
        # first pieces, and last ones that end in white space, have ids of their own
        own = last[(last > first) & pc.match_substring_regex(distinct.take(pa.array(codes[last])), _SPACE_LAST).to_numpy(zero_copy_only=False)]
        alone = distinct.take(pa.array(codes[first])).to_pylist() + [" " + p for p in distinct.take(pa.array(codes[own])).to_pylist()]
        apart = np.concatenate([first, own])
        inner = np.ones(len(codes), bool)
        inner[apart] = False
        used = np.zeros(len(distinct), bool)
        used[codes[inner]] = True
        ids, size = self._pieces(distinct.filter(pa.array(used)))
        more, long = self._alone(alone)
        place = np.cumsum(used) - 1
        codes = place[codes]
        codes[apart] = len(size) + np.arange(len(apart))
        size = np.concatenate([size, long])
        length = size[codes]
        total = np.concatenate([[0], np.cumsum(length)])
        return _gather(np.concatenate([ids, more]), (np.cumsum(size) - size)[codes], length), total[offsets[1:]] - total[offsets[:-1]]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encoded(path: str, batches: Iterator[pa.RecordBatch], column: str, end_id: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows without the text, ids of all with ``end_id`` after each, number of ids of each), some MB of text at a time."""
    enc = encoder(path)
    for rows in sized(batches, column, BATCH_BYTES):
        ids, counts = enc.encode(rows.column(column).combine_chunks())
        trim()  # before the rows go on, and so after the last ones too
        yield rows.drop_columns([column]), np.insert(ids, np.cumsum(counts), end_id).astype("<u4"), counts + 1
