"""Token ids of whole texts by their distinct words.

Texts are joined into blocks, cut into words where no token and no rule of the tokenizer reaches across, and the words
of a block are numbered by Arrow; only words not seen lately go to the tokenizer, many at a time, and one gather writes
the ids of the block. The ids equal those of the tokenizer on the whole text (tested).

A word is a run of white space with the run of other signs behind it; a single line end before a word stands alone, and
a full stop or comma behind a letter begins a word.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.common import LOWER

# Bytes of text whose words are numbered together.
BLOCK = 8 << 20
# Bytes of words kept per generation; a Python dictionary takes about fifteen times as much.
KEEP = 4 << 20
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LINE_ENDS = SPACES & (np.arange(256) != 32)
LETTERS = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
STOPS = np.isin(np.arange(256), [44, 46])
# White space beyond ASCII, as UTF-8.
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
SAFE_CUT = re.compile(rb"(?<=[!-~])(?= [!-~])")
# From U+0300 on, lower-casing before normalisation could change what is composed.
COMPOSING = re.compile(rb"[\xcc-\xff]")


def _before(mask: np.ndarray, by: int = 1) -> np.ndarray:
    moved = np.zeros(len(mask), bool)
    moved[by:] = mask[:-by]
    return moved


class Tokens:
    """Words and their ids; a subclass says how new words are encoded."""

    def __init__(self, path: str, keep: int = KEEP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.encode, self.encode_many = self.tokenizer.encode, self.tokenizer.encode_batch_fast
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0

    def forget(self) -> None:
        """The words kept go; the next ones go to the tokenizer again."""
        self.known, self.older, self.held = {}, {}, 0

    def joins(self, texts: list[str]) -> list[bool]:
        """Which words may be encoded together with others."""
        raise NotImplementedError

    def together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words and where those of each word end, from one text."""
        raise NotImplementedError

    def apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same, each word encoded on its own."""
        raise NotImplementedError

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.encode_many([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        joins = self.joins(texts)
        plain, others = [i for i, j in enumerate(joins) if j], [i for i, j in enumerate(joins) if not j]

        def keep(part, ids, ends):
            data, ends = ids.tobytes(), (4 * ends).tolist()
            self.known.update((words[i], data[a:b]) for i, a, b in zip(part, [0, *ends], ends))

        for at in range(0, len(plain), 5_000):
            part = plain[at:at + 5_000]
            ids, ends = self.together([texts[i] for i in part])
            if len(ends) == len(part) and ends[-1] == len(ids):
                keep(part, ids, ends)
            else:
                others += part
        for at in range(0, len(others), 2_000):
            part = others[at:at + 2_000]
            keep(part, *self.apart([texts[i] for i in part]))

    def prepared(self, text: bytes) -> bytes:
        """A text with the same ids and fewer different words."""
        return text

    def starts(self, data: bytes) -> np.ndarray:
        """Where in ``data`` a word begins."""
        signs = np.frombuffer(data, np.uint8)
        space = SPACES[signs]
        for wide in WIDE_SPACE.finditer(data):
            space[wide.start():wide.end()] = True
        alone = _before(LINE_ENDS[signs]) & ~_before(space, 2)
        return (space & ~_before(space)) | (alone & ~space) | (STOPS[signs] & _before(LETTERS[signs]))

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        if self.held > self.keep:
            self.older, self.known, self.held = self.known, {}, 0
        fresh = [w for w in words if w not in self.known]
        again = {w: self.older[w] for w in fresh if w in self.older}
        self.known.update(again)
        self._learn([w for w in fresh if w not in again])
        self.held += sum(map(len, fresh))
        return list(map(self.known.__getitem__, words))

    def _block(self, pieces: list[bytes]) -> list[np.ndarray]:
        data = b"".join(pieces)
        begins = np.cumsum([0, *map(len, pieces)])[:-1]
        mask = self.starts(data)
        mask[begins] = True
        at = np.flatnonzero(mask)
        offsets = np.append(at, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        coded = words.dictionary_encode()
        found = self._ids_of(coded.dictionary.to_pylist())
        ends = np.cumsum([0, *map(len, found)]) // 4
        lists = pa.LargeListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(found), "<u4")))
        taken = lists.take(coded.indices)
        cuts = taken.offsets.to_numpy()[np.searchsorted(at, begins)]
        return np.split(taken.flatten().to_numpy(), cuts[1:] - cuts[0])

    def ids(self, texts: list[bytes], block: int = BLOCK) -> list[np.ndarray]:
        """Ids of each text. Long texts are cut into blocks and short ones joined, so that memory beyond the texts and
        their ids is that of one block; a text without a space between other signs is one block."""
        parts: list[list] = [[] for _ in texts]
        owners, pieces, size = [], [], 0

        def done():
            for owner, found in zip(owners, self._block(pieces) if pieces else []):
                parts[owner].append(found)
            owners.clear()
            pieces.clear()

        for i, text in enumerate(texts):
            for piece in _cut(self.prepared(text), block):
                owners.append(i)
                pieces.append(piece)
                size += len(piece)
                if size >= block:
                    done()
                    size = 0
        done()
        return [p[0] if len(p) == 1 else np.concatenate([np.zeros(0, np.uint32), *p]) for p in parts]

    def rows(self, batches: Iterable[pa.RecordBatch], end_id: int) -> Iterator[tuple]:
        """(doc_id, ids with the end id) of the rows (doc_id, text) of Arrow batches; a null text is an empty one."""
        end = np.array([end_id], "<u4")
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").cast("binary")
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            for part in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(sizes // BLOCK)) + 1):
                if len(part):
                    some = texts.slice(part[0], len(part))
                    for i, ids in zip(part, self.ids([t.as_py() or b"" for t in some])):
                        yield keys[i], np.concatenate([ids, end])


def _cut(text: bytes, size: int) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        cut = SAFE_CUT.search(text, at + size) if at + size < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


class WordTokens(Tokens):
    """For a tokenizer that lower-cases, drops white space and never joins over it."""

    def __init__(self, path: str, keep: int = KEEP):
        super().__init__(path, keep)
        # A word of letters alone is one unit of the tokenizer, and only its last token carries the end mark.
        ends = [i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[ends] = True

    def prepared(self, text: bytes) -> bytes:
        # Lower-casing must not make a special token of what is none.
        return text if b"<|" in text or COMPOSING.search(text) else text.translate(LOWER)

    def joins(self, texts: list[str]) -> list[bool]:
        return [t.strip().isalpha() for t in texts]

    def together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._whole(" ".join(texts))
        return ids, np.flatnonzero(self.ends[ids]) + 1

    def apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.encode(texts, is_pretokenized=True, add_special_tokens=False)
        return (np.array(found.ids, "<u4"),
                np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(texts)), "right"))


class ByteTokens(Tokens):
    """For a byte-level tokenizer whose words may begin with one space and otherwise hold no white space."""

    def __init__(self, path: str, keep: int = KEEP):
        super().__init__(path, keep)
        (self.line_end,) = self.encode("\n", add_special_tokens=False).ids

    def joins(self, texts: list[str]) -> list[bool]:
        return [t.removeprefix(" ").isalnum() for t in texts]

    def together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self._whole("\n".join(texts) + "\n")
        between = ids == self.line_end
        ends = np.flatnonzero(between)
        return ids[~between], ends - np.arange(len(ends))

    def apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [f.ids for f in self.encode_many(texts, add_special_tokens=False)]
        return np.array([i for ids in found for i in ids], "<u4"), np.cumsum(list(map(len, found)))


@lru_cache(1)
def tokens(kind: type[Tokens], path: str) -> Tokens:
    """One per worker process: tasks that follow each other share the words."""
    return kind(path)
