"""Bounded tables from a text chunk to what a public tokenizer makes of it.

Both tokenizers here never let a token cross certain places (white space for
the word tokenizer, the point before a run of white-space markers for the
piece tokenizer), so a text is the sequence of its chunks and each distinct
chunk is segmented once per worker.  A table that reaches ``MOST_BYTES`` is
emptied, chunks of more than ``LONG`` characters are not kept, and long texts
are worked on in segments, so memory stays bounded whatever the vocabulary.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of a table, about; what an entry takes beside its characters; characters of the longest chunk that is kept.
MOST_BYTES, ENTRY_BYTES, LONG = 64 << 20, 190, 1000
#: Characters of a segment.
SEGMENT = 1 << 20
MARK = "▁"

_tables: dict[tuple[str, str], object] = {}


def word_table(path: str) -> WordTable:
    """The worker's table for the tokenizers file ``path``; kept between tasks."""
    if (key := ("word", path)) not in _tables:
        _tables[key] = WordTable(path)
    return _tables[key]


def piece_table(path: str) -> PieceTable:
    if (key := ("piece", path)) not in _tables:
        _tables[key] = PieceTable(path)
    return _tables[key]


def segments(text: str, least: int | None = None) -> Iterator[str]:
    """A text cut in front of words, without the one space there, into segments of ``SEGMENT`` characters or, where no space is near, more."""
    low, step = 0, SEGMENT if least is None else least
    while len(text) - low > step:
        at = BEFORE_WORD.search(text, low + step)
        if at is None:
            break
        yield text[low : at.start()]
        low = at.end()
    yield text[low:] if low else text


BEFORE_WORD = re.compile("(?<=[^ ]) ")


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte: itself if printable, else the next free one from 256 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return {b: chr(b if b in keep else next(free)) for b in range(256)}


class WordTable:
    """Ids of white-space separated words, as little-endian unsigned 32-bit bytes."""

    #: Printable ASCII and the Latin-1 letters: NFC leaves these alone and lower-casing maps letter to letter.
    PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+").fullmatch
    PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall
    #: str.split() also splits here, where the tokenizer sees no white space.
    ODD = re.compile("[\x1c-\x1f]").search
    BLANK = re.compile("[ \t\n\r]+").split

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        specials = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(specials) or "(?!)").search
        self.known: dict[str, bytes] = {}  # words, and their lower-case parts, which are words themselves
        self.held = 0

    def _part(self, part: str) -> bytes:
        spelled = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(spelled)]
        return self._kept(part, struct.pack(f"<{len(ids)}I", *ids))

    def _kept(self, chunk: str, ids: bytes) -> bytes:
        if len(chunk) <= LONG:
            self.known[chunk] = ids
            self.held += len(chunk) + len(ids) + ENTRY_BYTES
        return ids

    def _word(self, word: str) -> bytes:
        if not self.PLAIN(word) or self.special(word):
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            return self._kept(word, struct.pack(f"<{len(ids)}I", *ids))
        parts = self.PIECES(word.lower())
        if parts == [word]:
            return self._part(word)
        known = self.known
        return self._kept(word, b"".join([known.get(p) or self._part(p) for p in parts]))

    def ids(self, text: str) -> bytes:
        return b"".join([self._segment(s) for s in segments(text)])

    def _segment(self, text: str) -> bytes:
        words = text.split() if not self.ODD(text) else [w for w in self.BLANK(text) if w]
        known = self.known
        new = set(words).difference(known)
        if not new:
            return b"".join([known[w] for w in words])
        if self.held > MOST_BYTES:
            known.clear()
            self.held = 0
            new = set(words)
        long = {}
        for w in new:
            ids = self._word(w)
            if len(w) > LONG:
                long[w] = ids
        return b"".join([known[w] if w in known else long[w] for w in words]) if long else b"".join([known[w] for w in words])


class PieceTable:
    """Ids and decoded text of marked words for a sentencepiece model whose pieces hold markers only in front.

    A key is the chunk without its first marker, the one that the library
    itself puts in front of what it encodes.
    """

    CHUNKS = re.compile(" *[^ ]+| +").findall

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("pieces of this model cross white-space markers")
        self.end = self.sp.eos_id()
        self.mark = self.sp.piece_to_id(MARK)
        n = self.sp.get_piece_size()
        self.spelled = [self.sp.id_to_piece(i).replace(MARK, " ") for i in range(n)]
        #: Ids that do not simply spell their piece.
        self.odd = {i for i in range(n) if self.sp.is_unknown(i) or self.sp.is_control(i) or self.sp.is_byte(i) or self.sp.is_unused(i)}
        self.ids: dict[str, str] = {}
        self.back: dict[str, str] = {}  # where decoding gives another text
        self.held = 0

    def _decoded(self, chunks: list[str], found: list[list[int]]) -> Iterator[str]:
        for c, ids in zip(chunks, found, strict=True):
            if c and " " not in c and self.odd.isdisjoint(ids):
                yield "".join([self.spelled[i] for i in ids])[1:]
            else:
                yield self.sp.decode(ids)

    def _learn(self, chunks: list[str]) -> tuple[dict[str, str], dict[str, str]]:
        """Entries of unknown chunks; those too long to keep are returned."""
        if self.held > MOST_BYTES:
            self.ids.clear()
            self.back.clear()
            self.held = 0
        new = list(set(chunks).difference(self.ids))
        found = [ids if c else [self.mark] for c, ids in zip(new, self.sp.encode(new, num_threads=1), strict=True)]
        here: tuple[dict[str, str], dict[str, str]] = {}, {}
        for c, ids, back in zip(new, found, self._decoded(new, found), strict=True):
            of_ids, of_back = here if len(c) > LONG else (self.ids, self.back)
            text = of_ids[c] = " ".join(map(str, ids))
            if back != c:
                of_back[c] = back
            if len(c) <= LONG:
                self.held += 2 * len(c) + len(text) + ENTRY_BYTES
        return here

    def encode(self, text: str) -> tuple[str, int, str]:
        """Decimal ids joined by a space with the end id, their number, and the decoded text."""
        if not text:
            return str(self.end), 1, ""
        if MARK in text:
            text = text.replace(MARK, " ")
        parts = [self._segment(s) for s in segments(text)]
        ids = " ".join([x for x, _ in parts])
        return f"{ids} {self.end}", ids.count(" ") + 2, " ".join([back for _, back in parts])

    def _segment(self, text: str) -> tuple[str, str]:
        if not text or "  " in text or text[0] == " " or text[-1] == " ":
            chunks = [c[1:] for c in self.CHUNKS(" " + text)]
        else:
            chunks = text.split(" ")
        known, back = self.ids, self.back
        try:
            ids = " ".join([known[c] for c in chunks])
        except KeyError:
            long_ids, long_back = self._learn(chunks)
            if long_ids:
                known, back = known | long_ids, back | long_back
            ids = " ".join([known[c] for c in chunks])
        return ids, " ".join([back.get(c, c) for c in chunks]) if back else " ".join(chunks)
