"""SentencePiece encoding and decoding by batched Viterbi search.

A text gets a blank in front, like the public encoder's dummy prefix, and is cut
before every blank and around every line feed; no piece crosses those places
(runs of blanks are spelt blank by blank), so a text's best segmentation is that
of its parts. The distinct parts of a batch are grouped by length, and those of
one length advance together: rolling hashes of all substrings of each piece
length are looked up in the sorted piece hashes, and for every end position the
best last piece is a vectorised maximum, kept as backpointer. Characters without
a piece are spelt in bytes, so every text comes back unchanged.

Parts of over ``LONG`` characters, as in scripts without blanks, are cut wherever
no piece holds the two characters that meet, which changes no segmentation. What
is still long is cut into stretches that advance together from every place where
a piece could have ended near their start; as one of any ``longest`` places in a
row is the end of a piece, joining the stretches' best paths is exact as well.

BPE models store merge ranks instead of log probabilities. A rank r is taken to
have the probability 1 / (r + 2) of Zipf's law, divided by the sum of these, so
that the sum over pieces is a log likelihood. Where segmentations tie, the longer
last piece wins within a part, or within a stretch of one.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
PARTS = re.compile(r" [^ \n]*|\n|[^ \n]+")
BASE = 0x9E3779B97F4A7C15 | 1
BYTE_SCORE = -25.0
CACHE, CACHED_CHARS, CELLS = 200_000, 1 << 24, 1 << 16
#: Longer parts are cut; stretches have STRETCH characters and advance GROUP at a time.
LONG, STRETCH, GROUP = 1024, 256, 64
#: Stands before and after a text's characters in stretches: no character at all.
NONE = 0x110000


def read_model(path: str = MODEL) -> list[tuple[str, float, int]]:
    """Piece, score and byte value (-1 for none) of every id; control pieces are empty. A blank stands for the model's mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = []
    for i in range(model.get_piece_size()):
        piece, special = model.id_to_piece(i), model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        value = int(piece[3:5], 16) if model.is_byte(i) else -1
        text = "" if special or value >= 0 else piece.replace("▁", " ")
        out.append(("" if text.count(" ") > 1 else text, model.get_score(i), value))
    return out


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class Vocabulary:
    """Hash tables of the pieces, of a fixed size, and the parts encoded so far."""

    def __init__(self, model: list[tuple[str, float, int]]):
        self.bytes = {b: i for i, (_, _, b) in enumerate(model) if b >= 0}
        self.spelt = [bytes([b]) if b >= 0 else p.encode() for p, _, b in model]
        kept = [(i, p) for i, (p, _, _) in enumerate(model) if p]
        self.longest = max(len(p) for _, p in kept)
        ranks = all(model[i][1] == int(model[i][1]) for i, _ in kept)
        values = np.array([model[i][1] for i, _ in kept])
        if ranks:
            values = -np.log((2 - values) * (1 / (2 - values)).sum())
        self.powers = np.array([pow(BASE, k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        keys = np.array([self._key(p) for _, p in kept], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids, self.scores = keys[order], np.array([i for i, _ in kept])[order], values[order]
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash")
        pairs = {p[i : i + 2] for _, p in kept for i in range(len(p) - 1)}
        self.pairs = np.array(sorted(ord(p[0]) << 32 | ord(p[1]) for p in pairs), np.uint64)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _key(self, text: str) -> int:
        h = 0
        for c in text:
            h = (h * BASE + self._char(ord(c))) & (1 << 64) - 1
        return h

    @staticmethod
    def _char(c: int) -> int:
        return (c + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1

    def matches(self, chars: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length the scores and ids of the pieces that begin at each place of the rows."""
        n, size = chars.shape
        found = []
        with np.errstate(over="ignore"):
            coded = (chars + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            prefix = np.zeros((n, size + 1), np.uint64)
            for t in range(size):
                prefix[:, t + 1] = prefix[:, t] * np.uint64(BASE) + coded[:, t]
            for length in range(1, min(self.longest, size) + 1):
                key = prefix[:, length:] - prefix[:, : size + 1 - length] * self.powers[length]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                match = self.keys[at] == key
                score = np.where(match, self.scores[at], -np.inf)
                ids = np.where(match, self.ids[at], -1)
                if length == 1:
                    width = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
                    score = np.where(match, score, np.where(chars == NONE, -np.inf, BYTE_SCORE * width))
                found.append((score, ids))
        return found

    def trace(self, words: list[str], found: list[tuple[np.ndarray, np.ndarray]], back: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of each word, read back from place ``end`` of its row to ``begin``."""
        rows, place, out = np.arange(len(words)), end.copy(), []
        while (place > begin).any():
            length = np.where(place > begin, back[rows, place], 0)
            start = place - length
            step = np.full(len(words), -2)
            for k in np.unique(length[length > 0]):
                own = length == k
                step[own] = found[k - 1][1][own, start[own]]
            out.append(np.where(place > begin, step, -3))
            place = start
        table = np.stack(out[::-1], axis=1).astype(np.int32) if out else np.zeros((len(words), 0), np.int32)
        used = table != -3
        ends = np.cumsum(used.sum(axis=1))
        flat, spell = table[used], (table == -1).any(axis=1)
        for word, stop, start, by_bytes in zip(words, ends.tolist(), [0, *ends.tolist()], spell.tolist(), strict=False):
            ids = flat[start:stop]
            if by_bytes:
                spelt, at = [], 0
                for i in ids.tolist():
                    if i >= 0:
                        spelt.append(i)
                        at += len(self.spelt[i].decode())
                    else:
                        spelt += [self.bytes[b] for b in word[at].encode("utf-8", "surrogatepass")]
                        at += 1
                ids = np.array(spelt, np.int32)
            yield ids

    def segment(self, words: list[str]) -> None:
        """Encode words of one length."""
        n, size = len(words), len(words[0])
        found = self.matches(points("".join(words)).reshape(n, size))
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, size + 1), np.int32)
        rows = np.arange(n)
        for end in range(1, size + 1):
            # From the longest piece on, so that ties go to the longer last piece.
            lengths = range(min(self.longest, end), 0, -1)
            options = np.stack([best[:, end - k] + found[k - 1][0][:, end - k] for k in lengths])
            pick = options.argmax(axis=0)
            best[:, end] = options[pick, rows]
            back[:, end] = lengths[0] - pick
        for word, ids in zip(words, self.trace(words, found, back, np.zeros(n, int), np.full(n, size)), strict=True):
            self.known[word] = ids.tobytes()

    def cut(self, part: str) -> list[str]:
        """A long part cut where no piece holds the two characters that meet."""
        chars = points(part)
        pairs = chars[:-1] << np.uint64(32) | chars[1:]
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        ends = (np.flatnonzero(self.pairs[at] != pairs) + 1).tolist() if len(self.pairs) else list(range(1, len(part)))
        return [part[i:j] for i, j in zip([0, *ends], [*ends, len(part)], strict=True)]

    def advance(self, found: list[tuple[np.ndarray, np.ndarray]], best: np.ndarray) -> np.ndarray:
        """Fill ``best`` (places, rows, starts), which has a 0 at each start; the lengths of the last pieces."""
        back = np.zeros(best.shape, np.int16)
        for end in range(1, len(best)):
            lengths = range(min(self.longest, end), 0, -1)
            options = np.stack([best[end - k] + found[k - 1][0][:, end - k, None] for k in lengths])
            back[end] = lengths[0] - options.argmax(axis=0)
            np.maximum(best[end], options.max(axis=0), out=best[end])
        return back

    def join(self, word: str) -> None:
        """Encode one long word by stretches: their best paths from each start to each end, then the best of their chains."""
        size, wide = len(word), self.longest
        step = max(STRETCH, wide)
        n, width = -(-size // step), step + wide - 1
        chars = np.full(n * step + wide - 1, NONE, np.uint64)
        chars[wide - 1 : wide - 1 + size] = points(word)
        windows = np.lib.stride_tricks.sliding_window_view(chars, width)[::step]
        last = size - (n - 1) * step + wide - 1
        value, chosen = np.full(wide, -np.inf), np.zeros((n, wide), np.int32)
        value[-1] = 0
        for at in range(0, n, GROUP):
            own = windows[at : at + GROUP]
            best = np.full((width + 1, len(own), wide), -np.inf)
            best[np.arange(wide), :, np.arange(wide)] = 0
            self.advance(self.matches(own), best)
            for k in range(len(own)):
                stops = [last] * wide if at + k == n - 1 else range(step, step + wide)
                sums = value + best[stops, k]
                chosen[at + k] = sums.argmax(axis=1)
                value = sums.max(axis=1)
                value = value - value.max()
        begin, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
        end[-1] = last
        for k in range(n - 1, -1, -1):
            begin[k] = chosen[k][end[k] - step if k < n - 1 else 0]
            if k:
                end[k - 1] = step + begin[k]
        out = []
        for at in range(0, n, GROUP):
            own, starts, stops = windows[at : at + GROUP], begin[at : at + GROUP], end[at : at + GROUP]
            found = self.matches(own)
            best = np.full((width + 1, len(own), 1), -np.inf)
            best[starts, np.arange(len(own)), 0] = 0
            back = self.advance(found, best)[:, :, 0].T
            shift = (np.arange(len(own)) + at) * step - (wide - 1)
            texts = [word[i:j] for i, j in zip((shift + starts).tolist(), (shift + stops).tolist(), strict=True)]
            out += [ids.tobytes() for ids in self.trace(texts, found, back, starts, stops)]
        self.known[word] = b"".join(out)

    def learn(self, words: set[str]) -> None:
        """Encode ``words``, those of one length together, in steps of bounded memory."""
        by_size = defaultdict(list)
        for w in words:
            self.held += len(w)
            if len(w) > LONG:
                self.join(w)
            else:
                by_size[len(w)].append(w)
        for size, own in by_size.items():
            step = max(1, CELLS // (size + 1))
            for at in range(0, len(own), step):
                self.segment(own[at : at + step])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [[q for p in PARTS.findall(" " + t) for q in (self.cut(p) if len(p) > LONG else (p,))] if t else [] for t in texts]
        if len(self.known) > CACHE or self.held > CACHED_CHARS:
            self.known.clear()
            self.held = 0
        self.learn({w for parts in cut for w in parts}.difference(self.known))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, parts)), np.int32) for parts in cut]

    def decode(self, ids: list[int] | np.ndarray | None) -> str:
        data = b"".join(map(self.spelt.__getitem__, ids if ids is not None else ()))
        return data[1:].decode("utf-8", "replace")


def batches_of(texts: list, size: int = 1 << 20) -> Iterator[list]:
    """Runs of texts of about ``size`` characters; a longer text is a run of its own."""
    own, volume = [], 0
    for t in texts:
        own.append(t)
        volume += len(t or "")
        if volume >= size:
            yield own
            own, volume = [], 0
    if own:
        yield own


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id``, ``token_ids`` and ``n_tokens`` of each row; null and empty texts have no tokens.

    Rows are encoded one by one, so repeated rows agree; other columns are not read.
    """
    pieces = read_model(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(pieces)
        for batch in small_batches(batches):
            at = 0
            for texts in batches_of(batch.column(1).to_pylist()):
                found = vocabulary.encode(texts)
                sizes = np.array([len(f) for f in found], np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), ids, pa.array(sizes)], ["doc_id", "token_ids", "n_tokens"])
                at += len(texts)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, token_ids array<int>, n_tokens long")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` with ``token_ids`` turned back to ``text``, other columns as they are; null is the empty text."""
    pieces = read_model(model)
    at = encoded.columns.index("token_ids")
    fields = [("text" if f.name == "token_ids" else f.name, "string" if f.name == "token_ids" else f.dataType.simpleString()) for f in encoded.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(pieces)
        for batch in small_batches(batches):
            columns = list(batch.columns)
            columns[at] = pa.array([vocabulary.decode(x.values.to_numpy() if x.is_valid else None) for x in columns[at]], pa.string())
            yield pa.RecordBatch.from_arrays(columns, [n for n, _ in fields])

    return encoded.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in fields))


def round_trips(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id``, ``n_tokens``, a digest of the token ids, and the SHA-256 of the text decoded from them."""
    told = encode(docs, model).withColumn("ids_xxhash64", F.xxhash64("token_ids"))
    back = decode(told, model)
    return back.select("doc_id", "n_tokens", "ids_xxhash64", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
