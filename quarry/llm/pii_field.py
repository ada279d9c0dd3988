"""A linear-chain conditional random field over word shapes, for whole texts in numpy batches.

Every word of a text is a place of one chain; white space and common punctuation
part words. Features of a word are its shape, counts, checks and identity, and
the shapes beside it; their weights are learned by maximum likelihood from the
small labelled table of ``labelled_table``. Decoding is Viterbi over the whole
chain and exact: where the score of "no personal data" leads every other tag by
more than any two moves could make up, the best path has that tag, whatever
stands beside it, so the chain may be cut there; what lies between two cuts is
decoded together with all stretches of the same length.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pandas as pd

from quarry.llm.textkernel import PAD, Chunk, byte_set, mix, span_hashes, words

KINDS = ("email", "ip", "card", "phone", "secret")
TAGS = ("O", *KINDS)

#: A feature is learned if so many places of the table have it.
LEAST_SEEN = 4

#: What parts words: white space and , ; : ! ? " ' * $ % & # | = < >
_PARTS = byte_set((0x20, 0x20), (0x09, 0x0D), (0x21, 0x22), (0x23, 0x27), (0x2A, 0x2A), (0x2C, 0x2C), (0x3A, 0x3A), (0x3B, 0x3F), (0x7C, 0x7C))
_CLASS = np.arange(256, dtype=np.uint8)  # of a byte in a shape: x, X, 9 or itself
for _set, _sign in (((0x61, 0x7A), "x"), ((0x80, 0xFF), "x"), ((0x41, 0x5A), "X"), ((0x30, 0x39), "9")):
    _CLASS[_set[0] : _set[1] + 1] = ord(_sign)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_HEX_LETTER = byte_set((0x61, 0x66), (0x41, 0x46))


def luhn_digits(digits: np.ndarray) -> bool:
    """Whether digits (0 to 9) pass the checksum."""
    d = digits[::-1].astype(np.int64)
    d[1::2] = d[1::2] * 2 - 9 * (d[1::2] > 4)
    return int(d.sum()) % 10 == 0


def _bins(x: np.ndarray) -> np.ndarray:
    """Small numbers as they are, larger ones by powers of the square root of two."""
    return np.where(x < 20, x, 20 + np.floor(2 * np.log2(np.maximum(x, 20) / 20))).astype(np.int64)


def own_features(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (words, kinds of features) of words that are byte spans of ``buf``, their shapes, and their lower-cased selves."""
    n = len(starts)
    total = int(lengths.sum())
    word = np.repeat(np.arange(n), lengths)
    first = np.cumsum(lengths) - lengths
    raw = np.zeros(total + PAD, np.uint8)
    raw[:total] = buf[np.repeat(starts - first, lengths) + np.arange(total)]
    kind = _CLASS[raw[:total]]
    same = np.zeros(total, bool)
    same[1:] = (kind[1:] == kind[:-1]) & (word[1:] == word[:-1])
    long = same.copy()
    long[1:] &= same[:-1]
    shapes = []
    for left_out in (long, same):  # runs of one class shortened to two, and to one
        short = np.zeros(total + PAD, np.uint8)
        keep = np.flatnonzero(~left_out)
        short[: len(keep)] = kind[keep]
        size = np.bincount(word[keep], minlength=n)
        shapes.append(span_hashes(short, np.cumsum(size) - size, size))
    shape, outline = shapes
    low = np.zeros_like(raw)
    low[:total] = _LOWER[raw[:total]]
    itself = span_hashes(low, first, lengths)
    count = lambda hit: np.bincount(word[hit], minlength=n)
    digit, letter = kind == ord("9"), (kind == ord("x")) | (kind == ord("X"))
    digits = count(digit)
    change = np.zeros(total, bool)
    change[1:] = ((digit[1:] & letter[:-1]) | (letter[1:] & digit[:-1])) & (word[1:] == word[:-1])
    checked = np.zeros(n, np.int64)
    for i in np.flatnonzero(digits >= 12):
        at = slice(first[i], first[i] + lengths[i])
        checked[i] = 1 + luhn_digits(raw[at][digit[at]] - 48)
    small = [_bins(digits), count(raw[:total] == ord(".")), count(raw[:total] == ord("@")), _bins(count(change)), _bins(lengths), checked, (count(letter & ~_HEX_LETTER[raw[:total]]) == 0) * 1 + (count(letter) > 0) * 2 + (digits > 0) * 4, raw[first] if n else first, (digits > 0) * 1 + (count(~digit & ~letter) > 0) * 2 + (count(letter) > 0) * 4]
    cols = [shape, itself, *(np.minimum(s, 255).astype(np.uint64) for s in small), outline]
    # a feature of each kind has its own hashes
    named = [mix(c.astype(np.uint64) * np.uint64(31) + np.uint64(1000 + i)) for i, c in enumerate(cols)]
    # checksum and digits, changes and length together
    for a, b in ((2, 7), (5, 6), (5, 8), (2, 6)):
        named.append(mix(named[a] * np.uint64(3) ^ named[b]))
    return np.stack(named, 1) if n else np.zeros((0, 16), np.uint64), shape, itself


def _hashed(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x.astype(np.uint64) * np.uint64(31) + np.uint64(salt))


class Field:
    """Weights of features by tag, and of tag pairs."""

    def __init__(self, names: np.ndarray, emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move
        # what another tag can gain over "O" by its two moves, at most
        self.gain = (move - move[:, :1]).max(axis=0) + (move - move[:1]).max(axis=1)

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        """Weights by tag of features; none for features never learned."""
        at = np.searchsorted(self.names, hashes)
        at[at == len(self.names)] = 0
        return np.where((self.names[at] == hashes)[..., None], self.emit[at], 0.0)

    def scores(self, codes: np.ndarray, own: np.ndarray, shape: np.ndarray, itself: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Scores (words, tags) of chains of words, given as codes of distinct words and the features of those."""
        alone = self.weights(own).sum(axis=1)
        before = self.weights(_hashed(shape, 2001)) + self.weights(_hashed(itself, 2002))
        after = self.weights(_hashed(shape, 2003)) + self.weights(_hashed(itself, 2004))
        out = alone[codes]
        edge = np.zeros(len(codes) + 1, bool)
        edge[bounds] = True
        inner = ~edge[1:-1]  # words i and i + 1 are of one chain
        out[1:][inner] += before[codes[:-1][inner]]
        out[:-1][inner] += after[codes[1:][inner]]
        out[:, 0] += 1.0  # a word of features never learned is no personal data
        return out

    def decode(self, scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The best tags of all chains: words bounds[i] to bounds[i + 1] are one."""
        tags = np.zeros(len(scores), np.int8)
        open_ = np.flatnonzero(((scores[:, :1] - scores[:, 1:]) <= self.gain[1:]).any(axis=1))
        if not len(open_):
            return tags
        chain = np.searchsorted(bounds, open_, side="right")
        new = np.ones(len(open_), bool)
        new[1:] = (np.diff(open_) > 1) | (np.diff(chain) > 0)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(open_)))
        start = open_[first]
        inside, ends = start > bounds[chain[first] - 1], start + size < bounds[chain[first]]
        for length in np.unique(size):
            pick = np.flatnonzero(size == length)
            at = start[pick][:, None] + np.arange(length)
            e = scores[at]
            e[:, 0] += np.where(inside[pick][:, None], self.move[0], 0.0)
            e[:, -1] += np.where(ends[pick][:, None], self.move[:, 0], 0.0)
            tags[at] = self.viterbi(e)
        return tags

    def viterbi(self, batch: np.ndarray) -> np.ndarray:
        """Scores (chains, words, tags) to the best tags (chains, words)."""
        n, length, k = batch.shape
        best, back = batch[:, 0], np.zeros((n, length, k), np.int8)
        for t in range(1, length):
            through = best[:, :, None] + self.move[None]
            back[:, t] = through.argmax(axis=1)
            best = through.max(axis=1) + batch[:, t]
        tags = np.zeros((n, length), np.int8)
        tags[:, -1] = best.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = np.take_along_axis(back[:, t], tags[:, t, None].astype(np.int64), 1)[:, 0]
        return tags

    def spans(self, chunk: Chunk) -> list[tuple[int, int, int, str]]:
        """(row, start, end, kind) of what is found in the texts of a chunk; places count code points of the text."""
        starts, lengths, bounds = words(chunk, _PARTS)
        codes = pd.factorize(span_hashes(chunk.buf, starts, lengths))[0]
        place = np.zeros(int(codes.max()) + 1 if len(codes) else 0, np.int64)
        place[codes[::-1]] = np.arange(len(codes))[::-1]
        scores = self.scores(codes, *own_features(chunk.buf, starts[place], lengths[place]), bounds)
        tags = self.decode(scores, bounds)
        found = np.flatnonzero(tags)
        if not len(found):
            return []
        row = np.searchsorted(bounds, found, side="right") - 1
        new = np.ones(len(found), bool)
        new[1:] = (np.diff(found) > 1) | (np.diff(row) > 0) | (np.diff(tags[found].astype(int)) != 0)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(found)) - 1
        points = np.concatenate([[0], np.cumsum((chunk.buf & 0xC0) != 0x80)])
        out = []
        for i, j in zip(first.tolist(), last.tolist()):
            a, b = _trimmed(chunk.buf, int(starts[found[i]]), int(starts[found[j]] + lengths[found[j]]))
            if a < b:
                base = points[chunk.offsets[row[i]]]
                out.append((int(row[i]), int(points[a] - base), int(points[b] - base), TAGS[tags[found[i]]]))
        return out


_OPEN, _CLOSE, _ENDS = b"([{", b")]}", b".-_/\\~"


def _trimmed(buf: np.ndarray, a: int, b: int) -> tuple[int, int]:
    """Without dots and dashes at its ends, nor a bracket there whose partner is missing."""
    while True:
        raw = buf[a:b].tobytes()
        if raw and (raw[-1] in _ENDS or (raw[-1] in _CLOSE and raw.count(raw[-1:]) > raw.count(_OPEN[_CLOSE.index(raw[-1]) :][:1]))):
            b -= 1
        elif raw and (raw[0] in b".-/\\~" or (raw[0] in _OPEN and raw.count(raw[:1]) > raw.count(_CLOSE[_OPEN.index(raw[0]) :][:1]))):
            a += 1
        else:
            return a, b


def labelled_table() -> list[tuple[list[str], list[int]]]:
    """Sentences of words with tags, from templates: the small labelled table."""
    rng = np.random.default_rng(7)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    code = lambda k, signs="0123456789abcdef": "".join(pick(signs) for _ in range(k))
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    names = ["anna", "j.doe", "sales", "b_smith", "info22", "Peter", "x", "the.office", "ana-maria", "nt.26"]
    hosts, ends = ["example", "mail", "host", "corp-net", "mail7"], ["com", "org", "net", "de", "co.uk"]
    host = lambda: pick(hosts) + "." + pick(ends)

    def card(valid: bool) -> str:
        body = pick("456") + n(14)
        right = next(d for d in range(10) if luhn_digits(np.array([*map(int, body), d])))
        return body + str(right if valid else (right + int(rng.integers(1, 10))) % 10)

    parts = ["a", "es", "tion", "ch", "er", "ß", "ñdo", "ción", "the", "ou", "ä", "ing", "ein", "lo", "é", "heit", "qu", "st"]

    def word() -> str:
        w = "".join(pick(parts) for _ in range(int(rng.integers(1, 9))))
        return pick([w, w, w, w.capitalize(), w.upper()]) + pick(["", "", "", ".", "-" + w])

    octet = lambda: str(int(rng.integers(0, 256 if rng.random() < 0.7 else 12)))
    key = lambda: pick(["token", "key", "api_key", "secret", "password", "apikey", "TOKEN", "Token", "access_token"])
    email, ip, card_, phone, secret = (TAGS.index(k) for k in KINDS)
    makers = [
        (lambda: [pick(names) + "@" + host()], email),
        (lambda: [pick(names) + pick(["(at)", "[at]", "{at}", "(AT)", "[AT]"]) + host()], email),
        (lambda: [pick(names) + "(at)" + pick(hosts) + "(dot)" + pick(["com", "org", "de"])], email),
        (lambda: [pick(names) + "[at]" + pick(hosts) + "[dot]" + pick(["com", "org", "net"])], email),
        (lambda: [pick(names), pick(["(at)", "[at]", "{at}", "(AT)"]), host()], email),
        (lambda: [pick(names), pick(["(at)", "[at]", "@"]), pick(hosts), pick(["(dot)", "[dot]"]), pick(["com", "org", "net", "de"])], email),
        (lambda: [pick(names), "@", host()], email),
        (lambda: [".".join(octet() for _ in range(4))], ip),
        (lambda: ["[.]".join(octet() for _ in range(4))], ip),
        (lambda: ["(.)".join(octet() for _ in range(4))], ip),
        (lambda: [octet() + pick([".", "[.]"]) + octet() + pick([".", "[.]"]) + octet() + "[.]" + octet()], ip),
        (lambda: [octet() + "[.]" + octet() + pick([".", "[.]"]) + octet() + "." + octet()], ip),
        (lambda: [card(True)], card_),
        (lambda: [c[i : i + 4] for c in [card(True)] for i in range(0, 16, 4)], card_),
        (lambda: ["-".join(c[i : i + 4] for i in range(0, 16, 4)) for c in [card(True)]], card_),
        (lambda: [".".join(c[i : i + 4] for i in range(0, 16, 4)) for c in [card(True)]], card_),
        (lambda: ["+" + n(1), "(" + n(3) + ")", n(3) + "-" + n(4)], phone),
        (lambda: ["+" + n(2), n(3), n(3), n(4)], phone),
        (lambda: ["+" + n(2), n(3), n(7)], phone),
        (lambda: ["+" + n(1) + "-" + n(3) + "-" + n(3) + "-" + n(4)], phone),
        (lambda: ["(" + n(3) + ")", n(3) + "-" + n(4)], phone),
        (lambda: ["(" + n(3) + ")" + n(3) + "-" + n(4)], phone),
        (lambda: [n(3) + "-" + n(3) + "-" + n(4)], phone),
        (lambda: [n(3) + "." + n(3) + "." + n(4)], phone),
        (lambda: ["(0" + n(int(rng.integers(2, 5))) + ")", n(int(rng.integers(6, 8)))], phone),
        (lambda: ["0" + n(int(rng.integers(2, 5))) + "/" + n(int(rng.integers(6, 8)))], phone),
        (lambda: ["00" + n(2), n(3), n(3), n(4)], phone),
        (lambda: [n(3), n(3), n(4)], phone),
        (lambda: [code(40)], secret),
        (lambda: [code(40, "0123456789ABCDEF")], secret),
        (lambda: [code(32)], secret),
        (lambda: [code(64)], secret),
        (lambda: [code(int(rng.integers(24, 48)), alnum)], secret),
        (lambda: ["sk-" + code(40, alnum)], secret),
        (lambda: ["ghp_" + code(36, alnum)], secret),
        (lambda: ["AKIA" + code(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")], secret),
    ]
    told = {email: ["mail", "write", "email", "contact", "to", "at"], ip: ["host", "address", "server", "from", "ip"], card_: ["card", "visa", "number", "paid"], phone: ["call", "phone", "tel", "fax", "mobile", "dial"]}
    number = lambda: pick([n(1), n(2), n(3), n(5), "1" + n(3), "20" + n(2), "19" + n(2), n(6), n(8), n(9), n(10), n(11), n(12), n(14)])
    plain = [
        lambda: ["in", "19" + n(2)], lambda: ["page", n(2)], lambda: ["pages", n(2) + "-" + n(3)], lambda: ["costs", n(2) + "." + n(2)], lambda: ["version", "v" + n(1) + "." + n(1)], lambda: ["version", n(1)],
        lambda: ["version", n(1) + "." + n(1) + "." + n(1)], lambda: ["License", n(1) + "." + n(1)], lambda: ["id", n(8)], lambda: ["number", number()], lambda: ["the", "1" + n(2), "items"], lambda: [card(False)], lambda: ["order", card(False)],
        lambda: [pick(["Pf.", "No.", "Dr.", "A.", "St."])] * int(rng.integers(1, 5)), lambda: ["at"] * int(rng.integers(2, 5)), lambda: [word(), "at", word()], lambda: [word(), "dot", word()], lambda: [word(), "com"], lambda: ["a", "@", "sign"], lambda: ["look", "at", "the", "dot"], lambda: ["meet", "at", "host"], lambda: ["chapter", n(1) + "." + n(1) + "." + n(1)], lambda: ["section", n(1) + "." + n(1) + "." + n(1) + "." + n(1)],
        lambda: ["on", "20" + n(2) + "-0" + n(1) + "-1" + n(1)], lambda: [n(2) + "/" + n(2) + "/20" + n(2)], lambda: [n(1) + "." + n(1) + ".20" + n(2)], lambda: ["total", n(5), "of", n(6)], lambda: [n(3), "and", n(3)], lambda: [number(), number()],
        lambda: ["(" + n(4) + ")"], lambda: ["(" + n(1) + ")"], lambda: ["ISBN", n(3) + "-" + n(1) + "-" + n(3) + "-" + n(5) + "-" + n(1)], lambda: ["at", n(2), n(2)], lambda: [n(3) + "." + n(3) + "." + n(3)], lambda: ["commit", code(7)],
        lambda: ["file", code(8)], lambda: ["www." + host()], lambda: ["http", "//" + host() + "/page" + n(2) + ".html"], lambda: ["x" + n(2) + "y" + n(1)], lambda: [pick(["B2B", "MP3", "H2O", "R2D2", "3rd", "2nd", "4x4"])], lambda: [pick(names)], lambda: ["e.g.", "this"],
        lambda: ["the", "token", "of", "love"], lambda: [key(), "was", "lost"], lambda: ["words" + pick(["-", "_", "/"]) + "joined"], lambda: ["a" * 30], lambda: ["antidisestablishmentarianism"], lambda: ["ABCDEFGHIJKLMNOPQRSTUV"], lambda: [n(1) + "." + n(1)], lambda: [n(3) + "." + n(3)], lambda: [n(4) + "-" + n(4)], lambda: ["{x}"], lambda: ["(see", "above)"], lambda: ["[" + n(1) + "]"], lambda: ["+" + n(1)], lambda: ["+"], lambda: ["-"],
    ]
    fill = ["the", "an", "and", "reach", "call", "from", "at", "see", "Was", "of", "mail", "it", "was", "here.", "los", "ñdoja", "über", "êai.", "A.", "DE", "to", "in", "that", "Licensed"]
    table = []
    around = lambda k: [pick(fill) if rng.random() < 0.4 else word() for _ in range(int(rng.integers(0, k)))]
    for (make, tag), i in itertools.product(makers, range(16)):
        left, right = around(4), around(4)
        if tag == secret:
            left.append(key())
        elif i % 3 == 0:
            left.append(pick(told[tag]))
        if i % 4 == 1:
            right = [*right, number(), pick(fill)]
        own = make()
        table.append((left + own + right, [0] * len(left) + [tag] * len(own) + [0] * len(right)))
    for _ in range(120):  # nothing but words, and one word over and over
        table.append((own := [word() for _ in range(int(rng.integers(2, 9)))], [0] * len(own)))
        table.append((own := [word()] * int(rng.integers(1, 6)), [0] * len(own)))
    for make, _ in itertools.product(plain, range(12)):
        left, own, right = around(3), make(), around(3)
        table.append((left + own + right, [0] * (len(left) + len(own) + len(right))))
    return table


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@lru_cache(maxsize=1)
def trained_field(rounds: int = 150, rate: float = 0.2, decay: float = 2e-4) -> Field:
    """Maximum likelihood on the labelled table by full gradients (AdaGrad), all chains of a length at once; the same everywhere."""
    table = labelled_table()
    text = "\n".join(" ".join(w) for w, _ in table).encode()
    buf = np.concatenate([np.frombuffer(text, np.uint8), np.zeros(PAD, np.uint8)])
    starts, lengths, _ = words(Chunk(0, 1, buf, np.array([0, len(text)])), _PARTS)
    # all makers' words are free of what parts words
    bounds = np.concatenate([[0], np.cumsum([len(w) for w, _ in table])])
    if len(starts) != bounds[-1]:
        raise AssertionError("a word of the labelled table is parted")
    tags = np.concatenate([t for _, t in table])
    own, shape, itself = own_features(buf, starts, lengths)
    inner = np.ones(len(starts), bool)
    inner[bounds[:-1]] = False
    cols = [own[:, i] for i in range(own.shape[1])]
    for salt, what, back in ((2001, shape, True), (2002, itself, True), (2003, shape, False), (2004, itself, False)):
        h = np.zeros(len(starts), np.uint64)  # 0: no word there
        if back:
            h[1:][inner[1:]] = _hashed(what, salt)[:-1][inner[1:]]
        else:
            h[:-1][inner[1:]] = _hashed(what, salt)[1:][inner[1:]]
        cols.append(h)
    names, index, seen = np.unique(np.stack(cols, 1), return_inverse=True, return_counts=True)
    index = index.reshape(len(starts), -1)
    k = len(TAGS)
    emit, move = np.zeros((len(names), k)), np.zeros((k, k))
    ge2, gm2 = np.full_like(emit, 1e-6), np.full_like(move, 1e-6)
    size = np.diff(bounds)
    groups = [bounds[:-1][size == s][:, None] + np.arange(s) for s in np.unique(size)]
    none = (names == 0) | (seen < LEAST_SEEN)
    for _ in range(rounds):
        e_all = emit[index].sum(axis=1)
        e_all[:, 0] += 1.0
        left = np.zeros_like(e_all)  # what the tags have over what the model expects
        left[np.arange(len(tags)), tags] = 1
        gm = -decay * len(table) * move
        for at in groups:
            e = e_all[at]
            m, n = at.shape
            alpha, beta = np.zeros((m, n, k)), np.zeros((m, n, k))
            alpha[:, 0] = e[:, 0]
            for t in range(1, n):
                alpha[:, t] = _log_sum(alpha[:, t - 1, :, None] + move[None], 1) + e[:, t]
            for t in range(n - 2, -1, -1):
                beta[:, t] = _log_sum(move[None] + (e[:, t + 1] + beta[:, t + 1])[:, None], 2)
            z = _log_sum(alpha[:, -1], 1)
            left[at] -= np.exp(alpha + beta - z[:, None, None])
            for t in range(1, n):
                gm -= np.exp(alpha[:, t - 1, :, None] + move[None] + (e[:, t] + beta[:, t])[:, None] - z[:, None, None]).sum(axis=0)
                np.add.at(gm, (tags[at[:, t - 1]], tags[at[:, t]]), 1)
        ge = -decay * len(table) * emit
        np.add.at(ge, index.ravel(), np.repeat(left, index.shape[1], axis=0))
        ge[none] = 0
        ge2 += ge**2
        gm2 += gm**2
        emit += rate * ge / np.sqrt(ge2)
        move += rate * gm / np.sqrt(gm2)
    return Field(names[~none], emit[~none], move)
