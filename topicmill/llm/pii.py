"""Personal data: patterns, and a character-level BiLSTM with a CRF that adds what they miss.

The patterns give the base spans. The tagger is trained from labelled spans: of
a bounded sample of windows, the spans that the patterns found there, each also
in rewritten form (other separators, no country code, other case), so that it
learns surroundings and shapes rather than the patterns themselves.

Decoding is of whole texts. They are read in overlapping windows; emissions are
averaged, central positions counting more, and Viterbi reconciles them. An added
span must be plausible for its kind (such as the check digit of a card) and may
not touch a base span. Windows to train on are taken around digits, at signs and
the word "dot".

Every plausible span holds a digit or some of an address as ``SPELT`` has it, so
what else the tagger marks is never added, and only the tags around these matter.
Where a position's emissions put it outside of all spans whatever stands around
it, the best path of the whole text is known to pass there. So windows are scored
from each digit or address outwards until such a position is met on both sides,
or the text's end, and the path is searched between them: the spans are those of
decoding each position (``decode_all``), at whatever distance they begin and end.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")
LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL_TAIL = LOCAL + r"+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
#: A run of local characters matches from its first or not at all, hence the look behind.
EMAIL, EMAIL_NEXT = re.compile(rf"(?<!{LOCAL})" + EMAIL_TAIL), re.compile(EMAIL_TAIL)
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE_TRIGGER = re.compile(r"[0-9@]")
#: Addresses may also be spelt out, as in "name at host dot org" or "name [at] host [dot] org".
AT, DOT = r"(?:@|\s*[(\[{]\s*at\s*[)\]}]\s*|\s+at\s+)", r"(?:\.|\s*[(\[{]\s*dot\s*[)\]}]\s*|\s+dot\s+)"
SPELT = re.compile(rf"[^\s@()\[\]{{}}]+{AT}[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)+", re.I)
TRIGGER = re.compile(r"[0-9@]|\bdot\b|\bDOT\b")
WINDOW, STEP, AROUND, STRETCH = 64, 32, 40, 8192
SAMPLE = 1500
#: "at" as in ``SPELT``, or a little more than that; the rest of an address after it, and the characters before it.
AT_NEAR, TAIL = re.compile(r"@|(?<=[\s(\[{])at(?=[\s)\]}])", re.I), re.compile(rf"[\s)\]}}]*[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)+", re.I)
BEFORE, NAMED = re.compile(r"[\s(\[{]"), re.compile(r"[^\s@()\[\]{}]")
#: What a tag that a path can't take there loses.
SURE = np.float32(1e6)
Span = tuple[int, int, int]  # start, kind, end


def digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def luhn(number: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(number)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost matches that do not overlap, for each kind; a failing match is dropped and not tried again."""
    out: list[Span] = []
    if not BASE_TRIGGER.search(text):
        return out
    at = 0
    while "@" in text and at <= len(text):
        m = (EMAIL_NEXT.match(text, at) if at else None) or EMAIL.search(text, at)
        if not m:
            break
        out.append((m.start(), 0, m.end()))
        at = m.end()
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and not p[:-3].strip("0") for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# --- the tagger -------------------------------------------------------------------------------

TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
SPACE_ID, LETTER_ID, OTHER_ID, PAD_ID = 95, 96, 97, 98


def char_ids(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ids = codes.astype(np.int64) - 32
    wide = np.flatnonzero((codes < 32) | (codes > 126))
    if len(wide):
        found, places = np.unique(codes[wide], return_inverse=True)
        ids[wide] = np.array([SPACE_ID if (c := chr(k)).isspace() else LETTER_ID if c.isalpha() else OTHER_ID for k in found.tolist()])[places]
    return ids


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def settled(weak: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Positions from one that is surely outside on, while outside follows on outside."""
    at = np.arange(len(weak))
    return np.maximum.accumulate(np.where(sure, at, -1)) > np.maximum.accumulate(np.where(weak, -1, at))


class Tagger:
    """Character embeddings, one LSTM each way, emissions, and CRF transitions."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, size: int = 12, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = weights or {
            "E": make(PAD_ID + 1, size) * 3, "O": make(2 * hidden, TAGS), "o": np.zeros(TAGS, np.float32),
            "A": np.zeros((TAGS, TAGS), np.float32), "s": np.zeros(TAGS, np.float32),
            **{f"{d}{n}": m for d in "fb" for n, m in (("x", make(size, 4 * hidden)), ("h", make(hidden, 4 * hidden)), ("c", np.zeros(4 * hidden, np.float32)))},
        }

    def _lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        h = self.w[d + "h"].shape[0]
        pre = x @ self.w[d + "x"] + self.w[d + "c"]
        state, cell, out, kept = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32), [], []
        for t in range(len(x)):
            z = pre[t] + state @ self.w[d + "h"]
            i, f, o = sigmoid(z[:, :h]), sigmoid(z[:, h : 2 * h] + 1), sigmoid(z[:, 2 * h : 3 * h])
            g, before, last = np.tanh(z[:, 3 * h :]), cell, state
            cell = f * cell + i * g
            squashed = np.tanh(cell)
            state = o * squashed
            out.append(state)
            kept.append((i, f, o, g, before, last, squashed))
        return np.stack(out), kept

    def emissions(self, ids: np.ndarray) -> tuple[np.ndarray, tuple]:
        """For (windows, length) ids: (length, windows, TAGS) scores."""
        x = self.w["E"][ids.T]
        ahead, kf = self._lstm(x, "f")
        back, kb = self._lstm(x[::-1], "b")
        h = np.concatenate([ahead, back[::-1]], axis=2)
        return h @ self.w["O"] + self.w["o"], (x, kf, kb, h)

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """``emissions`` without what training keeps: in place, both directions side by side, the gates by one exp."""
        h, (n, size) = self.w["fh"].shape[0], ids.shape
        turn = np.r_[np.full(3 * h, -1), np.full(h, -2)].astype(np.float32)  # tanh(x) is 2 sigmoid(2 x) - 1
        lead = np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)].astype(np.float32)
        tables = np.stack([(self.w["E"] @ self.w[d + "x"] + self.w[d + "c"] + lead) * turn for d in "fb"]).astype(np.float32)
        inner = np.stack([self.w[d + "h"] * turn for d in "fb"]).astype(np.float32)
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        z, taken, out = np.empty((2, n, 4 * h), np.float32), np.empty((n, 4 * h), np.float32), np.empty((2, size, n, h), np.float32)
        turned = np.ascontiguousarray(ids.T)
        for t in range(size):
            np.matmul(state, inner, out=z)
            z[0] += np.take(tables[0], turned[t], axis=0, out=taken, mode="clip")
            z[1] += np.take(tables[1], turned[size - 1 - t], axis=0, out=taken, mode="clip")
            with np.errstate(over="ignore"):  # the reciprocal of infinity is the right 0
                np.exp(z, out=z)
            z += 1
            np.reciprocal(z, out=z)
            z[:, :, 3 * h :] *= 2
            z[:, :, 3 * h :] -= 1
            cell *= z[:, :, h : 2 * h]
            cell += z[:, :, :h] * z[:, :, 3 * h :]
            state = np.tanh(cell) * z[:, :, 2 * h : 3 * h]
            out[0, t], out[1, size - 1 - t] = state[0], state[1]
        found = (out.reshape(2, -1, h) @ self.w["O"].reshape(2, h, TAGS)).sum(axis=0) + self.w["o"]
        return found.reshape(size, n, TAGS)

    def leads(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where being outside is best: if the tag before is outside, whatever it is, and as a text's first.

        Getting to another tag gains at most ``into`` over getting to outside, and what
        follows it at most the row's greatest lead; emissions that tell more than both settle it.
        """
        a, s = self.w["A"].astype(np.float64), self.w["s"].astype(np.float64)
        into, first, after = (a - a[:, :1]).max(axis=0)[1:], (s - s[0])[1:], (a[0] - a[0, 0])[1:]
        lead = e[:, :1] - e[:, 1:] - np.maximum((a - a[:1]).max(axis=1)[1:], 0) - 1e-3
        return (lead >= after).all(axis=1), (lead >= into).all(axis=1), (lead >= first).all(axis=1)

    def outside(self, e: np.ndarray) -> np.ndarray:
        """The positions of emissions that are outside on a best path, whatever the others are."""
        weak, sure, first = self.leads(e)
        weak[:1] = sure[:1] = first[:1]
        return settled(weak, sure)

    def between(self, e: np.ndarray, begins: bool, ends: bool) -> np.ndarray:
        """Emissions of a stretch whose path is outside at its first and last position, but where the text begins and ends."""
        part = e.copy()
        if not begins:
            part[0] = -self.w["s"]
            part[0, 1:] -= SURE
        if not ends:
            part[-1, 1:] -= SURE
        return part

    def best(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """As ``viterbi``; between two positions that are surely outside the path is found alone."""
        tags, spans, parts = [np.zeros(len(e), np.int64) for e in scores], [], []
        for k, e in enumerate(scores):
            open_ = np.flatnonzero(np.diff(np.r_[0, ~self.outside(e), 0]))
            for low, high in open_.reshape(-1, 2):
                low, high = max(0, low - 1), min(len(e), high + 1)  # with the outside positions around
                spans.append((k, low, high))
                parts.append(self.between(e[low:high], low == 0, high == len(e)))
        for (k, low, high), own in zip(spans, self.viterbi(parts), strict=True):
            tags[k][low:high] = own
        return tags

    def _lstm_back(self, x: np.ndarray, d: str, kept: list, grad: np.ndarray, out: dict) -> np.ndarray:
        h = self.w[d + "h"].shape[0]
        dx, dstate, dcell = np.zeros_like(x), np.zeros_like(grad[0]), np.zeros_like(grad[0])
        for t in range(len(x) - 1, -1, -1):
            i, f, o, g, before, last, squashed = kept[t]
            dh = grad[t] + dstate
            dc = dcell + dh * o * (1 - squashed**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=1)
            out[d + "x"] += x[t].T @ dz
            out[d + "h"] += last.T @ dz
            out[d + "c"] += dz.sum(axis=0)
            dx[t], dstate, dcell = dz @ self.w[d + "x"].T, dz @ self.w[d + "h"].T, dc * f
        return dx

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the CRF, and its gradient."""
        e, (x, kf, kb, h) = self.emissions(ids)
        n, size = ids.shape
        gold, a = tags.T, self.w["A"]
        alpha = [self.w["s"] + e[0]]
        for t in range(1, size):
            alpha.append(log_sum(alpha[-1][:, :, None] + a, 1) + e[t])
        total = log_sum(alpha[-1], 1)
        beta = [np.zeros_like(e[0])]
        for t in range(size - 1, 0, -1):
            beta.append(log_sum(a[None] + (e[t] + beta[-1])[:, None, :], 2))
        beta.reverse()
        de = np.stack([np.exp(alpha[t] + beta[t] - total[:, None]) for t in range(size)])
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        rows = np.arange(n)
        score = self.w["s"][gold[0]] + e[0][rows, gold[0]]
        for t in range(1, size):
            g["A"] += np.exp(alpha[t - 1][:, :, None] + a[None] + (e[t] + beta[t])[:, None, :] - total[:, None, None]).sum(axis=0)
            np.add.at(g["A"], (gold[t - 1], gold[t]), -1)
            score = score + a[gold[t - 1], gold[t]] + e[t][rows, gold[t]]
        g["s"] = de[0].sum(axis=0)
        np.add.at(g["s"], gold[0], -1)
        for t in range(size):
            de[t][rows, gold[t]] -= 1
        g["O"], g["o"] = np.einsum("tbh,tbk->hk", h, de), de.sum(axis=(0, 1))
        dh = de @ self.w["O"].T
        half = dh.shape[2] // 2
        dx = self._lstm_back(x, "f", kf, dh[:, :, :half], g) + self._lstm_back(x[::-1], "b", kb, dh[::-1, :, half:], g)[::-1]
        np.add.at(g["E"], ids.T, dx)
        return float((total - score).mean()), {k: (v / n).astype(np.float32) for k, v in g.items()}

    def train(self, ids: np.ndarray, tags: np.ndarray, steps: int = 700, batch: int = 64, rate: float = 0.01, seed: int = 7) -> list[float]:
        """Adam, in whole epochs until ``steps`` batches are done; returns the mean loss of each epoch."""
        epochs = -(-steps // -(-len(ids) // batch))
        rng, step, history = np.random.default_rng(seed), 0, []
        m, v = ({k: np.zeros_like(w) for k, w in self.w.items()} for _ in range(2))
        for _ in range(epochs):
            order, losses = rng.permutation(len(ids)), []
            for at in range(0, len(ids), batch):
                own = order[at : at + batch]
                value, grad = self.loss(ids[own], tags[own])
                step += 1
                losses.append(value)
                for k, gk in grad.items():
                    gk = np.clip(gk, -1, 1)
                    m[k] = 0.9 * m[k] + 0.1 * gk
                    v[k] = 0.999 * v[k] + 0.001 * gk**2
                    self.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            history.append(float(np.mean(losses)))
        return history

    def viterbi(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of each stretch of emissions; stretches advance together, the long ones on alone."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(scores)
        order = sorted(range(len(scores)), key=lambda k: len(scores[k]))
        for begin in range(0, len(order), 256):
            own = order[begin : begin + 256]
            longest = len(scores[own[-1]])
            e = np.zeros((longest, len(own), TAGS), np.float32)
            for k, r in enumerate(own):
                e[: len(scores[r]), k] = scores[r]
            best, back = self.w["s"] + e[0], np.zeros((longest, len(own), TAGS), np.int8)
            lengths = np.array([len(scores[r]) for r in own])
            for t in range(1, longest):
                path = best[:, :, None] + self.w["A"]
                back[t] = path.argmax(axis=1)
                best = np.where((t < lengths)[:, None], path.max(axis=1) + e[t], best)
            for k, r in enumerate(own):
                tags = np.zeros(lengths[k], np.int64)
                tags[-1] = best[k].argmax()
                for t in range(lengths[k] - 1, 0, -1):
                    tags[t - 1] = back[t, k, tags[t]]
                out[r] = tags
        return out


def pieces_of(text: str) -> list[tuple[int, int, bool, bool]]:
    """The whole text, a long one cut with an overlap. Whether a part begins, and ends, it."""
    n = len(text)
    return [(s, min(n, s + STRETCH), s == 0, s + STRETCH >= n) for s in range(0, max(1, n - 2 * WINDOW), STRETCH - 2 * WINDOW)] if n else []


def stretches(text: str) -> list[tuple[int, int, bool, bool]]:
    """To train on: the parts around digits, at signs and "dot"; long ones are cut with an overlap. Whether a part begins, and ends, one."""
    merged: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        low, high = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if merged and low <= merged[-1][1]:
            merged[-1][1] = high
        else:
            merged.append([low, high])
    return [(s, min(high, s + STRETCH), s == low, s + STRETCH >= high) for low, high in merged for s in range(low, max(low + 1, high - 2 * WINDOW), STRETCH - 2 * WINDOW)]


def deciding(text: str, ids: np.ndarray) -> np.ndarray:
    """The positions of which every plausible span holds one: digits, and all of each address as ``SPELT`` has it."""
    out = (ids >= ord("0") - 32) & (ids <= ord("9") - 32)
    for m in AT_NEAR.finditer(text):
        tail = TAIL.match(text, m.end())
        if tail:
            low = m.start()
            while low and BEFORE.match(text, low - 1):
                low -= 1
            while low and NAMED.match(text, low - 1):
                low -= 1
            out[low : tail.end()] = True
    return out


class Emissions:
    """Averaged emissions of texts, scored by windows every STEP characters where they are asked for.

    All texts are in one row, each padded to whole blocks of STEP positions and one window.
    """

    NEARNESS = 1 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])[:, None].astype(np.float32)

    def __init__(self, tagger: Tagger, ids: list[np.ndarray], batch: int = 256):
        counts = np.array([max(1, -(-(len(own) - STEP) // STEP)) for own in ids], np.int64)
        self.tagger, self.batch = tagger, batch
        #: The block that each text begins with, and the positions where it begins and ends.
        self.firsts = np.r_[0, np.cumsum(counts + 1)]
        self.begins = self.firsts * STEP
        self.ends = self.begins[:-1] + np.array([len(own) for own in ids], np.int64)
        blocks = int(self.firsts[-1])
        self.row = np.full(blocks * STEP, PAD_ID, np.int64)
        for own, low, high in zip(ids, self.begins, self.ends, strict=False):
            self.row[low:high] = own
        self.means, self.weights = np.zeros((blocks, STEP, TAGS), np.float32), np.zeros((blocks, STEP, 1), np.float32)
        self.known = np.zeros(blocks, bool)
        # A window begins in every block but the last of each text.
        self.due = np.ones(blocks, bool)
        self.due[self.firsts[1:] - 1] = False
        self.sums = np.zeros((blocks, STEP, TAGS), np.float32)

    def ask(self, blocks: np.ndarray) -> np.ndarray:
        """Score all windows on ``blocks``; those of them that were not known."""
        asked = np.zeros(len(self.known), bool)
        asked[blocks] = True
        fresh = np.flatnonzero(asked & ~self.known)
        self.known |= asked
        asked[:-1] |= asked[1:]
        places = np.flatnonzero(asked & self.due)
        self.due[places] = False
        for at in range(0, len(places), self.batch):
            own = places[at : at + self.batch]
            scores = self.tagger.scores(self.row[own[:, None] * STEP + np.arange(WINDOW)]) * self.NEARNESS[:, None]
            # No two windows begin at one place, so neither their first nor their second halves overlap.
            for k in (0, 1):
                half = slice(k * STEP, (k + 1) * STEP)
                self.sums[own + k] += scores[half].swapaxes(0, 1)
                self.weights[own + k] += self.NEARNESS[half]
        self.means[fresh] = self.sums[fresh] / np.maximum(self.weights[fresh], 1)
        return fresh

    def of(self, low: int, high: int) -> np.ndarray:
        return self.means.reshape(-1, TAGS)[low:high]


def decode_all(tagger: Tagger, parts: list[str], batch: int = 256) -> list[np.ndarray]:
    """Tags of each part: the best path over all its emissions."""
    read = Emissions(tagger, [char_ids(p) for p in parts], batch)
    read.ask(np.arange(len(read.known)))
    return tagger.best([read.of(low, high) for low, high in zip(read.begins, read.ends, strict=False)])


def decode(tagger: Tagger, parts: list[str], batch: int = 256) -> list[np.ndarray]:
    """As ``decode_all``, but that spans without ``deciding`` positions are left out.

    At first the blocks of deciding positions are scored. Where a stretch that may
    hold a span and does hold such a position reaches unscored blocks, these follow,
    twice as many each time, until it ends in positions that are surely outside.
    """
    ids = [char_ids(p) for p in parts]
    read = Emissions(tagger, ids, batch)
    asked, inside, first = (np.zeros(len(read.row), bool) for _ in range(3))
    for p, own, low, high in zip(parts, ids, read.begins, read.ends, strict=False):
        asked[low:high], inside[low:high] = deciding(p, own), True
    first[read.begins[:-1]] = True
    before = np.r_[0, np.cumsum(asked)]
    weak, sure, reach = np.zeros(len(asked), bool), np.zeros(len(asked), bool), 1
    blocks = np.flatnonzero(asked.reshape(-1, STEP).any(axis=1))
    while True:
        fresh = read.ask(blocks)
        at = (fresh[:, None] * STEP + np.arange(STEP)).ravel()
        w, s, f = tagger.leads(read.means[fresh].reshape(-1, TAGS))
        weak[at], sure[at] = np.where(first[at], f, w), np.where(first[at], f, s)
        known = np.repeat(read.known, STEP) & inside
        open_ = known & ~settled(weak, sure)
        starts = np.flatnonzero(open_ & (~np.r_[False, open_[:-1]] | first))
        ends = np.flatnonzero(open_ & np.r_[~open_[1:] | first[1:], True][: len(open_)]) + 1
        held = before[ends] > before[starts]
        starts, ends = starts[held], ends[held]
        text = np.searchsorted(read.begins, starts, side="right") - 1
        lefts = np.flatnonzero((starts > read.begins[text]) & ~known[starts - 1])
        rights = np.flatnonzero((ends < read.ends[text]) & ~np.r_[known, False][ends])
        wider = [np.arange(max(read.firsts[text[k]], starts[k] // STEP - reach), starts[k] // STEP) for k in lefts]
        wider += [np.arange(ends[k] // STEP, min(read.firsts[text[k] + 1], ends[k] // STEP + reach)) for k in rights]
        if not wider:
            break
        blocks, reach = np.concatenate(wider), 2 * reach
    # With the outside positions around.
    lows, highs = np.maximum(starts - 1, read.begins[text]), np.minimum(ends + 1, read.ends[text])
    paths = tagger.viterbi([tagger.between(read.of(a, b), a == read.begins[k], b == read.ends[k]) for a, b, k in zip(lows, highs, text, strict=True)])
    tags = np.zeros(len(read.row), np.int64)
    for a, b, own in zip(lows, highs, paths, strict=True):
        tags[a:b] = own
    return [tags[low:high] for low, high in zip(read.begins, read.ends, strict=False)]


def tagged(tags: np.ndarray) -> list[Span]:
    """Spans of a tag sequence: a begin, or an inside after another kind, opens one."""
    out, kind, start, at = [], -1, 0, -1
    for t in np.flatnonzero(tags).tolist():
        tag = int(tags[t])
        own = (tag - 1) // 2
        if kind >= 0 and (t > at + 1 or own != kind or tag % 2):
            out.append((start, kind, at + 1))
            start = t
        elif kind < 0:
            start = t
        kind, at = own, t
    return [*out, (start, kind, at + 1)] if kind >= 0 else out


def plausible(kind: int, text: str) -> bool:
    n = digits(text)
    if kind == 0:
        return SPELT.fullmatch(text) is not None
    if kind == 1:
        parts = re.split(r"[^0-9]+", text)
        return len(parts) == 4 and all(p and len(p) <= 3 and int(p) <= 255 for p in parts)
    if re.search(r"[^0-9\s().+/_-]", text):
        return False
    return 12 <= len(n) <= 19 and luhn(n) if kind == 2 else 7 <= len(n) <= 15 and len(n) < len(text)


def added_spans(tagger: Tagger, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """What the tagger adds to the base spans of each text."""
    places = [(row, *part) for row, text in enumerate(texts) for part in pieces_of(text)]
    out: list[list[Span]] = [[] for _ in texts]
    for at in range(0, len(places), 64):
        own = places[at : at + 64]
        for (row, low, high, first, last), tags in zip(own, decode(tagger, [texts[r][s:e] for r, s, e, _, _ in own]), strict=True):
            for s, kind, e in tagged(tags):
                # Inner edges of a cut stretch belong to the part beside it, which sees more there.
                if (s < WINDOW and not first) or (e > high - low - WINDOW and not last):
                    continue
                # A boundary may be off by a few characters: the edges that a kind can't have are trimmed,
                # and an address is taken from end to end.
                if kind == 0:
                    around = max(0, low + s - AROUND)
                    near = [m for m in SPELT.finditer(texts[row], around, low + e + AROUND) if m.start() < low + e and m.end() > low + s]
                    shape, begin = (near[0] if near else None), 0
                else:
                    shape, begin = re.search(r"[+(]?[0-9](?:.*[0-9])?", texts[row][low + s : low + e], re.S), low + s
                if not shape:
                    continue
                start, end = begin + shape.start(), begin + shape.end()
                if plausible(kind, texts[row][start:end]) and all(end <= a or start >= b for a, _, b in base[row] + out[row]):
                    out[row].append((start, kind, end))
    return [sorted(o) for o in out]


# --- training data ----------------------------------------------------------------------------


def windows_of(text: str) -> Iterator[tuple[str, list[Span]]]:
    """Windows that start a little before a stretch's first trigger, with the base spans that lie inside."""
    spans = base_spans(text)
    for low, *_ in stretches(text):
        end = min(len(text), low + WINDOW)
        if all(e <= low or s >= end or (s >= low and e <= end) for s, _, e in spans):
            yield text[low:end], [(s - low, k, e - low) for s, k, e in spans if low <= s and e <= end]


def rewrite(kind: int, text: str, rng: np.random.Generator) -> str:
    """Another way to write the same kind of data, with other digits."""
    fresh = re.sub(r"[0-9]", lambda m: str(rng.integers(0, 10)), text)
    mark = str(rng.choice(["-", ".", " ", "/"]))
    if kind == 0:
        shape = rng.integers(0, 4)
        at, dot = ((" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"))[rng.integers(0, 3)]
        name, host = text.split("@", 1)
        return text.upper() if shape == 0 else (name.replace(".", dot) if shape == 1 else name) + at + host.replace(".", dot)
    if kind == 1:
        return mark.join(str(rng.integers(0, 256)) for _ in range(4)) if rng.random() < 0.5 else ".".join(str(rng.integers(0, 256)) for _ in range(4))
    if kind == 2:
        n = digits(fresh)
        return mark.join(n[k : k + 4] for k in range(0, len(n), 4))
    body = digits(fresh)[-10:]
    shapes = (f"({body[:3]}) {body[3:6]}-{body[6:]}", mark.join((body[:3], body[3:6], body[6:])), f"00{body}", f"+{body[0]}{mark}{body[1:4]}{mark}{body[4:]}")
    return shapes[rng.integers(0, len(shapes))]


def examples(rows: list[tuple[str, list[Span]]], seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Ids and tags of the windows, and of each window with spans in rewritten form, twice or until there are 40."""
    rng, ids, tags = np.random.default_rng(seed), [], []
    rewritten = max(2, -(-40 // max(1, sum(bool(spans) for _, spans in rows))))
    for text, spans in rows:
        for fresh in (False, *[True] * rewritten) if spans else (False,):
            body, own, at = "", [], 0
            for s, k, e in spans:
                if s < at:
                    continue
                new = rewrite(k, text[s:e], rng) if fresh else text[s:e]
                body += text[at:s]
                own.append((len(body), k, len(body) + len(new)))
                body, at = body + new, e
            body = (body + text[at:])[:WINDOW]
            row, tag = np.full(WINDOW, PAD_ID, np.int64), np.zeros(WINDOW, np.int64)
            row[: len(body)] = char_ids(body)
            for s, k, e in own:
                tag[s:e] = 2 + 2 * k
                tag[s : min(e, s + 1)] = 1 + 2 * k
            ids.append(row)
            tags.append(tag)
    return np.array(ids), np.array(tags)


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray] | None:
    """Weights trained on at most ``sample`` windows, the least by hash; None where no window has spans."""
    given = docs.select("text").where(F.col("text").rlike("[0-9@]"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [w for t in batch.column(0).to_pylist() for w in windows_of(t)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([joined(s) for _, s in found], pa.string())], ["piece", "spans"])

    # distinct() drops windows of copied texts, so the sample shows each once
    rows = given.mapInArrow(cut, "piece string, spans string").distinct().orderBy(F.xxhash64("piece"), "piece").limit(sample).collect()
    read = [(r["piece"], [(int(s), KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)]) for r in rows]
    if not any(s for _, s in read):
        return None
    tagger = Tagger()
    tagger.train(*examples(read))
    return tagger.w


def searched(texts: list[str | None], weights: dict[str, np.ndarray] | None) -> list[tuple[list[Span], list[Span]]]:
    """Base and added spans of each text."""
    bodies = [t or "" for t in texts]
    base = [base_spans(t) for t in bodies]
    extra = added_spans(Tagger(weights), bodies, base) if weights else [[] for _ in bodies]
    return list(zip(base, extra, strict=True))


def find(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Each row's base counts, digest of its base spans, all spans, and the number of added ones.

    Null texts count as empty and have none. Rows are searched one by one, so
    repeated rows agree; other columns are not read. No labelled span to
    train on: base spans only. Texts are never cut short.
    """
    weights = fit(docs, sample)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = searched(batch.column(1).to_pylist(), weights)
            counts = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in found], pa.int64()) for kind in range(len(KINDS))]
            digest = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            spans = pa.array([joined(sorted(base + extra)) for base, extra in found], pa.string())
            added = pa.array([len(extra) for _, extra in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, spans, added], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(search, f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_added long")


def redacted(text: str, spans: list[Span]) -> str:
    """``text`` with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with personal data replaced in ``text``, and ``n_chars`` set anew where a text changed; null texts stay null."""
    weights = fit(docs, sample)
    at, size = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = batch.column(at).to_pylist()
            spans = [base + extra for base, extra in searched(texts, weights)]
            clean = [redacted(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(clean, batch.schema.field(at).type)
            if size is not None:
                columns[size] = pa.array([len(c) if s else n for c, s, n in zip(clean, spans, batch.column(size).to_pylist(), strict=True)], batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(replace, docs.schema)
