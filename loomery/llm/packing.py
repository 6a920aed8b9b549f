"""Vector bin packing of token pieces into training sequences.

An example has three demands: tokens, one segment, and loss-bearing tokens. A
sequence is a bin with a limit on each. Bins are filled one at a time; the next
piece is the one with the greatest dot product of its demands (as shares of the
limits) with what is left of the bin. A document longer than a bin fills whole
bins first. When no pending piece fits, one is cut to fill the bin exactly; what
is left at the end of a task's input goes to sequences whose lengths are powers
of two, which need no padding.

Every task packs the texts of its own partition in one pass, holding at most
``pool`` pieces, so nothing is shuffled and memory doesn't grow with the input.

Results for odd input: a null or empty text is a document of its end id alone;
a null or empty prompt has no ids; repeated rows are packed one by one; an empty table gives no rows. Ids are
carried, never inspected, so null and repeated doc_ids are fine.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import SPACE, spread, text_windows, texts_of

LENGTH = 2048
SEGMENTS = 64
POOL = 512
END_ID = 1
CACHE_WORDS = 400_000
TEXT_BYTES = 4 << 20  # of text whose words are looked up together

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, segment long, loss_tokens long"


@dataclass
class Limits:
    tokens: int = LENGTH
    segments: int = SEGMENTS
    loss: int = LENGTH


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable
    bytes for themselves, the others in order from U+0100."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


_LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u024f]+")


MARKS = b".,!%$&*#|?"
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[0x61:0x7B] = True
_MARK[list(MARKS)] = True


class WordTokens(dict):
    """ids of words as little-endian unsigned 32-bit bytes, worked out when first met.

    The vocabulary never joins over white space, so a text's ids are those of its
    words in order, and upper case is lowered anyway. A Latin word is a single
    piece, so the merges alone give its ids; marks behind it are a piece of their
    own; any other word takes the tokenizer's whole way. Words are kept, to a bound,
    those in use longest.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        # found by the tokenizer in the raw text, in just this case, before anything is lowered
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.most = most
        self.older: dict[bytes, bytes] = {}
        self.end = np.array([END_ID], np.dtype("<u4")).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is not None:
            return self.keep(word, ids)
        core = word.rstrip(MARKS)
        if core and len(core) < len(word) and self.latin(core):
            return self.keep(word, self[core] + self[word[len(core) :]])
        piece = self.latin(word)
        if piece:
            return self.keep(word, b"".join([self.bytes_of[t.id] for t in self.model.tokenize(piece)]))
        got = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        return self.keep(word, np.array(got, np.dtype("<u4")).tobytes())

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """``self[w]`` of each word, the plainest of the new ones without a call for each."""
        found = list(map(self.get, words))
        older, bytes_of, tokenize = self.older, self.bytes_of, self.model.tokenize
        for i, word in enumerate(words):
            if found[i] is None:
                if word.isalpha() and word.islower() and word not in older and len(self) < self.most:
                    found[i] = self[word] = b"".join([bytes_of[t.id] for t in tokenize(word.decode())])
                else:
                    found[i] = self[word]
                    older = self.older
        return found

    def latin(self, word: bytes) -> str | None:
        """A lower-case Latin word as the merges take it; None for any other."""
        if word.isalpha():  # of bytes: A-Z and a-z only
            return word.decode() if word.islower() else None
        if word.isascii():
            return None
        try:
            text = word.decode()
        except UnicodeDecodeError:
            return None
        plain = _LATIN.fullmatch(text) and unicodedata.is_normalized("NFC", text) and text.lower() == text
        return "".join([self.letters[b] for b in word]) if plain else None

    def keep(self, word: bytes, ids: bytes) -> bytes:
        """When full, what is there becomes the older half and the half before it goes."""
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: bytes | None) -> bytes:
        """ids of a text, its end id last."""
        return self.ids(text) + self.end if text else self.end

    def ids(self, text: bytes) -> bytes:
        """ids of a text; words that hold a special token go through the tokenizer as they are."""
        if not any(s in text for s in self.special):
            lowered = text.lower()
            if not any(s in lowered for s in self.special):
                return b"".join(map(self.__getitem__, lowered.split()))
        out = []
        for word in text.split():
            if any(s in word.lower() for s in self.special):
                got = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
                out.append(np.array(got, np.dtype("<u4")).tobytes())
            else:
                out.append(self[word.lower()])
        return b"".join(out)

    def encode_all(self, texts: list[bytes | None]) -> list[bytes]:
        """``encode`` of each text; a word is looked up once, however often the texts have it.

        Marks that follow a letter begin a piece of their own, so they are split off
        first, and a word is one entry whatever stands behind it.
        """
        whole = b"\n".join(t or b"" for t in texts).lower() + b"\n"
        if any(s.lower() in whole for s in self.special):
            return [self.encode(t) for t in texts]
        data = np.frombuffer(whole, np.uint8)
        cut = np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]]) + 1
        data = np.insert(data, cut, 0x20)
        space = SPACE[data]
        edge = np.flatnonzero(np.diff(space, prepend=True)).astype(np.int32)
        starts, ends = edge[::2], edge[1::2]
        # Arrow's layout: the words without what lies between them
        offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~space])])
        coded = words.dictionary_encode()
        found = self.ids_of(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        index = coded.indices.to_numpy()
        n = size[index]
        done = np.concatenate(([0], np.cumsum(n)))
        place = np.repeat((np.cumsum(size) - size)[index] - done[:-1], n)
        ids = np.frombuffer(b"".join(found), np.dtype("<u4"))[place + np.arange(done[-1])]
        stops = np.cumsum([len(t or b"") + 1 for t in texts])
        stops = done[np.searchsorted(starts, stops + np.searchsorted(cut, stops))]
        return [ids[i:j].tobytes() + self.end for i, j in zip([0, *stops[:-1].tolist()], stops.tolist())]


_tokens: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One per Python worker, kept between its tasks."""
    if path not in _tokens:
        _tokens.clear()
        _tokens[path] = WordTokens(path)
    return _tokens[path]


def place(pieces: Iterator[tuple], limits: Limits, pool: int = POOL) -> Iterator[list[tuple]]:
    """Sequences as lists of (payload, start, length, loss).

    ``pieces`` gives (payload, start, length, loss flags or None); a piece without
    flags bears loss on all tokens but its segment's first.
    """

    def loss_of(payload, start, length):
        flags = payload[-1] if payload is not None else None
        return int(flags[start : start + length].sum()) if flags is not None else max(length - 1, 0)

    full = np.array([limits.tokens, limits.segments, limits.loss], np.float64)
    items: list[tuple] = []  # payload, start, length
    need = np.zeros((3, 0))
    source = iter(pieces)
    done = False
    while True:
        while not done and len(items) < pool:
            fresh = []
            for payload, length in source:
                fresh.append((payload, 0, length))
                if len(items) + len(fresh) >= pool:
                    break
            else:
                done = True
            items += fresh
            need = np.concatenate([need, np.array([(n, 1, loss_of(p, s, n)) for p, s, n in fresh], np.float64).reshape(-1, 3).T], axis=1)
        if not items:
            return
        left, bin_ = full.copy(), []
        alive = np.ones(len(items), bool)
        while left[0] > 0 and left[1] > 0:
            fits = alive & (need[0] <= left[0]) & (need[2] <= left[2])  # a segment is left, see above
            if fits.any():
                weight = left / full / full
                score = np.where(fits, need[0] * weight[0] + need[2] * weight[2] + weight[1], -1.0)
                pick = int(score.argmax())
                # the last segment, or a small gap, is better closed by a cut
                if left[1] > 1 or need[0, pick] == left[0]:
                    payload, start, n = items[pick]
                    bin_.append((payload, start, n, int(need[2, pick])))
                    left -= need[:, pick]
                    alive[pick] = False
                    continue
            longer = alive & (need[0] > left[0])
            if not longer.any():
                if fits.any() and left[1] == 1:
                    pick = int(np.argmax(np.where(fits, need[0], -1)))
                    payload, start, n = items[pick]
                    bin_.append((payload, start, n, int(need[2, pick])))
                    left -= need[:, pick]
                    alive[pick] = False
                break
            pick = int(np.argmax(np.where(longer, need[0], -1)))
            payload, start, n = items[pick]
            take = int(left[0])
            if loss_of(payload, start, take) > left[2]:
                steps = np.cumsum(payload[-1][start : start + take]) if payload is not None and payload[-1] is not None else np.arange(take)
                take = int(np.searchsorted(steps, left[2], side="right"))
            if take <= 0:
                break
            got = loss_of(payload, start, take)
            bin_.append((payload, start, take, got))
            left -= (take, 1, got)
            items[pick] = (payload, start + take, n - take)
            need[:, pick] = (n - take, 1, loss_of(payload, start + take, n - take))
            if left[2] <= 0:
                break
        if not bin_:  # one token alone breaks a limit: it stands alone
            payload, start, n = items[0]
            bin_ = [(payload, start, 1, loss_of(payload, start, 1))]
            items[0] = (payload, start + 1, n - 1)
            need[:, 0] = (n - 1, 1, loss_of(payload, start + 1, n - 1))
            alive[0] = n > 1
        items = [x for x, a in zip(items, alive) if a]
        need = need[:, alive]
        yield from powers(bin_, limits, loss_of)


def powers(bin_: list[tuple], limits: Limits, loss_of) -> Iterator[list[tuple]]:
    """A bin that isn't full as sequences whose lengths are powers of two."""
    total = sum(x[2] for x in bin_)
    if total == limits.tokens:
        yield bin_
        return
    queue = list(bin_)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        out = []
        while room:
            payload, start, n, _ = queue[0]
            take = min(n, room)
            out.append((payload, start, take, loss_of(payload, start, take)))
            room -= take
            if take == n:
                queue.pop(0)
            else:
                queue[0] = (payload, start + take, n - take, 0)
        yield out


def pack_documents(
    docs: DataFrame, tokenizer: str, limits: Limits | None = None, pool: int = POOL, doc_id: str = "doc_id", text: str = "text", prompt: str | None = None
) -> DataFrame:
    """One row per piece of a document in a sequence; see SCHEMA.

    With ``prompt``, the name of a column, a row is an instruction example: the ids of
    its prompt come before those of its text and bear no loss, those of the text and
    the end id do, and ``limits.loss`` bounds them in every sequence.
    """
    limits = limits or Limits()
    before = F.col(prompt) if prompt else F.lit(None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_tokens(tokenizer)
        base = TaskContext.get().partitionId() << 33
        names = [f.split()[0] for f in SCHEMA.split(", ")]

        def pieces():
            for batch in text_windows(batches, limit=TEXT_BYTES):
                asked = texts_of(batch, "prompt") if prompt else [None] * batch.num_rows
                texts = words.encode_all(texts_of(batch))
                for key, ids, question in zip(batch.column(0).to_pylist(), texts, asked):
                    flags = None
                    if prompt:
                        first = words.ids(question) if question else b""
                        flags = np.repeat(np.array([0, 1], np.int64), [len(first) // 4, len(ids) // 4])
                        ids = first + ids
                    yield (key, ids, len(ids) // 4, flags), len(ids) // 4

        rows: list[tuple] = []

        def flush():
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for number, sequence in enumerate(place(pieces(), limits, pool)):
            offset = 0
            for segment, (payload, start, n, loss) in enumerate(sequence):
                key, ids, total, _ = payload
                rows.append((key, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), total, base + number, offset, segment, loss))
                offset += n
            if len(rows) >= 8192:
                yield flush()
                rows = []
        if rows:
            yield flush()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), before.cast("string").alias("prompt"))
    return spread(rows if prompt else rows.drop("prompt")).mapInArrow(run, SCHEMA)
