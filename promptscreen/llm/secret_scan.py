"""Secret scans: fixed patterns, and a linear-chain conditional random field beside them.

The patterns' spans are the base. The field tags the tokens of a text, words, runs of
key characters, marks and line ends alike, as the beginning of a secret, inside one, or
outside. Features are a token's shape, the words and marks around it, how these
go together, and what kind of file the text is. The best path is found by Viterbi; a secret
may have several tokens (parts joined by dots, the lines of a key), and what is found
beyond the base is added.

Every token of a text may get any tag, wherever it stands. The best path of the whole text is
found in two steps, exactly: for each token a bound, from sums over the text in arrays, says
what a path that leaves OUTSIDE around it can gain at most. Where that is nothing the token
is outside on the best path, and Viterbi decodes the stretches between such tokens.

What of a secret a base span leaves over (a tail behind a mark that its pattern does not
know) is a span of the field beside it.

The field is trained here: on texts made by a seeded generator (assignments, headers,
connection strings, keys of common forms, keys of several lines, passwords with marks inside, of letters alone
or on a line of their own; prose, values that are none, numbers, dates, paths, addresses without secrets) by gradient steps on the exact likelihood.

Defined results. A null text is an empty one: no spans. Offsets are code points, the
end exclusive. Base spans may overlap those of another kind; a span of the field
(kind crf) overlaps none, and is what base spans leave of it. Rows that repeat are scanned each; a null doc_id is kept.
An empty table gives no rows. Columns not named are not read.
"""

from __future__ import annotations

import collections
import functools
import random
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: The base patterns, in the order in which kinds of the same start are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones need no match of their own
KINDS = ("assign", "access", "hex", "crf")

#: A token: a run of word and key characters with its padding, a line end, or a mark, repeated or not. The second group is the mark.
TOKEN = re.compile(r"(\w[\w+/~\-]*(?:==?(?![\w=]))?|\n|([^\w\s])\2*)")
#: Words that speak of secrets, in lower case.
CUES = ("pass", "pwd", "secret", "token", "key", "auth", "cred", "bearer", "login", "private", "cookie", "signature", "pin:")
CUE = re.compile("|".join(map(re.escape, CUES)))
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
#: Hashed features, and those of how a token's class goes together with the mark before it and a cue nearby, and with what it touches, quotes around it and a cue.
BITS, CLASSES, BEFORE = 15, 17, 6
MARKED, TOUCHING = CLASSES * BEFORE * 2, CLASSES * 16
FEATURES = (1 << BITS) + MARKED + TOUCHING
#: Places of words around a token that are features, and in how many tokens before it a cue is near.
PLACES, NEAR = (-3, -2, -1, 1, 2), 6
EDGE, NEVER, RARE = "", -1e6, "<rare>"
#: Tokens that are scored at once.
BLOCK = 1 << 15
DIGIT, DATE = re.compile("[0-9]"), re.compile(r"(19|20)[0-9][0-9][-_/]?[01][0-9]")
NO_QUOTE, QUOTES = 0, {'"': 1, "'": 2, "`": 3}
#: Place of a token's head among its features, where it has one, and its length. Tokens and rows that are kept.
HEAD, HEADED, KEPT = 5, 4, 200_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if "=" in text or ":" in text else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


@functools.lru_cache(1 << 16)
def index(feature: str) -> int:
    return (zlib.crc32(feature.encode("utf-8", "surrogatepass")) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - BITS)


def file_features(text: str) -> list[int]:
    """What kind of file it is: how much of it is assignments, marks of code, and lines."""
    n = len(text) / 1000 + 1
    rate = lambda c: min(3, int(2 * text.count(c) / n))
    return [index(x) for x in (f"file:assign{rate('=')}", f"file:brace{rate('{')}", f"file:colon{rate(': ')}", f"file:line{rate(chr(10))}")]


def shape(token: str, vocabulary: frozenset[str] | None = None) -> list[str]:
    """Features of a token by itself; as a word only if it is in the vocabulary."""
    n, low = len(token), token.lower()
    if not (token[:1].isalnum() or "_" in token[:1]):
        return [f"mark:{token[:3]}", "bias"]
    plain = token.isalpha() and token.islower()
    digits, upper, letters = (0, 0, n) if plain else tuple(sum(map(f, token)) for f in (str.isdigit, str.isupper, str.isalpha))
    kinds = "".join(k for k, has in zip("luds", (letters > upper, upper, digits, letters + digits < n)) if has)
    out = [f"ascii:{token.isascii()}", f"len:{min(n, 8) if n < 9 else 9 + min(n // 4, 12)}", f"kinds:{kinds}", f"kinds:{kinds}:{min(n // 6, 5)}", "bias"]
    if not plain:
        out.append(f"head:{DIGIT.sub('9', token[:HEADED])}")
    if letters and n <= 16 and (vocabulary is None or low in vocabulary):
        out.append(f"word:{low}")
    if n >= 6:
        turns = 0 if plain else sum(a.isdigit() != b.isdigit() or a.isupper() != b.isupper() for a, b in zip(token, token[1:])) / n
        vowels = sum(map(low.count, "aeiouy")) / max(1, letters)
        out += [f"digit:{int(5 * digits / n)}", f"upper:{int(5 * upper / n)}", f"distinct:{int(5 * len(set(token)) / n)}", f"turns:{int(8 * turns)}", f"vowels:{int(8 * vowels)}"]
        out += [f"hex:{not low.strip('0123456789abcdef')}", f"slash:{min(token.count('/'), 3)}", f"dash:{min(token.count('-'), 5)}", f"under:{min(token.count('_'), 3)}"]
        if not plain and DATE.match(token):
            out.append("date")
    return out


def word(token: str, vocabulary: frozenset[str] | None = None) -> str:
    """What a token is to its neighbours."""
    if token.isalpha() and len(token) <= 16 or not token[:1].isalnum():
        low = token.lower()[:16]
        return low if vocabulary is None or low in vocabulary else RARE
    return f"<{'9' if token.isdigit() else 'x'}{min(len(token) // 8, 4)}>"


def kind(token: str) -> int:
    """Class of a token, below CLASSES: its length and what it is made of, or that it is a mark."""
    if not (token[:1].isalnum() or token[:1] == "_"):
        return CLASSES - 1
    size = min(3, len(token) // 6)
    made = 0 if token.islower() and token.isalpha() else 1 if token.isdigit() else 2 if token.isalpha() else 3
    return 4 * size + made


def mark(token: str) -> int:
    """What stands before a token, below BEFORE."""
    return {EDGE: 0, "\n": 0, "=": 1, ":": 2, '"': 3, "'": 3}.get(token, 5 if token[:1].isalnum() else 4)


class Ids(dict):
    """Ids by token; one that is missing is made."""

    def __init__(self, make: Callable[[str], int]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, token: str) -> int:
        self[token] = made = self.make(token)
        return made


class Tokens:
    """What is known of tokens: their features' indices, class, mark and whether they are a cue. Tokens that agree in all of it have one id."""

    def __init__(self, vocabulary: frozenset[str] | None = None) -> None:
        self.vocabulary = vocabulary
        self.known = Ids(self.add)
        self.alike: dict[tuple, int] = {}
        self.shapes: list[list[int]] = []
        self.around: list[list[int]] = []  # index for each of PLACES
        self.facts: list[tuple[int, int, bool]] = []

    def add(self, token: str) -> int:
        """Id of a token. Unknown words in lower case differ by a few numbers only, those with a capital by their head beside; so what is made for one serves all that agree in them."""
        n, low, key = len(token), token.lower(), None
        if self.vocabulary is not None and token.isalpha() and low not in self.vocabulary and len(low) == n and ((plain := token.islower()) or token[0].isupper() and token[1:].islower()):
            key = (n, token.isascii(), plain, CUE.search(f"{low}:") is not None)
            if n >= 6:
                key += (len(set(token)), sum(map(low.count, "aeiouy")), not low.strip("abcdef"))
            own = key if plain else (*key, token[:HEADED])
            if (same := self.alike.get(own)) is not None:
                return same
        new = len(self.shapes)
        if key is not None and (like := self.alike.setdefault(key, new)) != new:
            shapes, around, facts = self.shapes[like].copy(), self.around[like], self.facts[like]
            shapes[HEAD] = index(f"head:{token[:HEADED]}")
        else:
            shapes = [index(f) for f in shape(token, self.vocabulary)] if token else []
            name = word(token, self.vocabulary)
            around = [index(f"at{p}:{name}") for p in PLACES]
            facts = (kind(token), mark(token), bool(CUE.search(f"{low}:")))
        if key is not None:
            self.alike[own] = new
        self.shapes.append(shapes)
        self.around.append(around)
        self.facts.append(facts)
        return new

    def ids(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))

    def together(self, ids: np.ndarray, facts: np.ndarray, touch: np.ndarray, quoted: np.ndarray) -> np.ndarray:
        """For each token of a text the indices of the two features that join its class with what is around it."""
        own = facts.take(ids, axis=0)
        places = np.arange(len(ids))
        last = np.maximum.accumulate(np.where(own[:, 2] > 0, places, -NEAR - 1))
        near = np.concatenate([[False], places[1:] - last[:-1] <= NEAR])
        before = np.concatenate([[0], own[:-1, 1]])
        after = np.concatenate([touch[1:], [False]])
        first = (1 << BITS) + (own[:, 0] * BEFORE + before) * 2 + near
        return np.stack([first, (1 << BITS) + MARKED + own[:, 0] * 16 + touch * 8 + after * 4 + quoted * 2 + near], axis=1)


def cut(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Tokens, their starts and ends."""
    parts = TOKEN.split(text)  # what is before a token, the token, its mark, and so on
    tokens = parts[1::3]
    n = len(tokens)
    own = np.fromiter(map(len, tokens), np.int64, n)
    ends = np.cumsum(np.fromiter(map(len, parts[:-1:3]), np.int64, n) + own)
    return tokens, ends - own, ends


def surroundings(tokens: list[str], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token whether it touches the one before, and whether it stands in quotes that its line opens.

    A quote opens where no word touches it from the left; the next one of its kind closes it, and a line's end does.
    """
    touch = np.concatenate([[False], starts[1:] == ends[:-1]]) if len(tokens) else np.zeros(0, bool)
    quoted, now, since = np.zeros(len(tokens), bool), NO_QUOTE, 0
    if QUOTES.keys().isdisjoint(tokens):
        return touch, quoted
    for i, token in enumerate(tokens):
        if token == "\n":
            now = NO_QUOTE
        elif token in QUOTES:
            if now == QUOTES[token]:
                quoted[since:i], now = True, NO_QUOTE
            elif now == NO_QUOTE and not (touch[i] and tokens[i - 1][:1].isalnum()):
                now, since = QUOTES[token], i + 1
    return touch, quoted


def barred(classes: np.ndarray, touch: np.ndarray) -> np.ndarray:
    """What no secret does: it has no white space inside but line ends, and no mark that stands off what follows begins it."""
    out = np.zeros((len(classes), 3))
    out[~touch, INSIDE] = NEVER
    out[(classes == CLASSES - 1) & ~np.concatenate([touch[1:], [False]]), BEGIN] = NEVER
    return out


class Field:
    """Weights of a linear-chain field over three tags. A secret cannot begin by going on; a chain begins as after OUTSIDE."""

    def __init__(self) -> None:
        self.emit = np.zeros((FEATURES, 3))
        self.move = np.zeros((3, 3))
        self.vocabulary: frozenset[str] = frozenset()
        self.reset()

    def reset(self) -> None:
        """Forgets what was derived from the weights."""
        self.tokens, self.size = Tokens(self.vocabulary), 0
        self.table, self.facts = np.zeros((4096, 3 + 3 * len(PLACES))), np.zeros((4096, 3), np.int64)

    def __getstate__(self) -> dict:
        return {"emit": self.emit, "move": self.move, "vocabulary": self.vocabulary}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.reset()

    def legal(self) -> np.ndarray:
        move = self.move.copy()
        move[OUTSIDE, INSIDE] = -1e9
        return move

    def scores(self, tokens: list[str], file: list[int], touch: np.ndarray, quoted: np.ndarray) -> np.ndarray:
        """Score of each tag at each token of a text. Sums over distinct tokens are made once and looked up."""
        if len(self.tokens.shapes) > KEPT:
            self.reset()
        if len(self.tokens.known) > KEPT:
            self.tokens.known.clear()  # rows stay, and are found again by what tokens agree in
        own = self.tokens
        ids = own.ids([EDGE, *tokens])
        if (size := len(own.shapes)) > self.size:
            if size > len(self.table):  # twice the room, so that rows are copied a few times only
                room = np.zeros(2 * size - self.size, np.int64)
                self.table, self.facts = np.concatenate([self.table[: self.size], np.zeros((len(room), self.table.shape[1]))]), np.concatenate([self.facts[: self.size], np.stack([room] * 3, axis=1)])
            new = slice(self.size, size)
            counts = np.array([len(x) for x in own.shapes[new]])
            flat = self.emit[np.array([i for x in own.shapes[new] for i in x], np.int64)]
            sums = np.concatenate([np.zeros((1, 3)), np.cumsum(flat, axis=0)])
            ends = np.cumsum(counts)
            self.table[new, :3] = sums[ends] - sums[ends - counts]
            self.table[new, 3:] = self.emit[np.array(own.around[new], np.int64)].reshape(size - self.size, -1)
            self.facts[self.size : size] = own.facts[self.size :]
            self.size = size
        edge, ids = ids[0], ids[1:]
        both = own.together(ids, self.facts, touch, quoted)
        out = self.emit[file].sum(axis=0) + self.emit.take(both[:, 0], axis=0)
        out += self.emit.take(both[:, 1], axis=0)
        wide = np.concatenate([np.full(3, edge), ids, np.full(2, edge)])
        for lo in range(0, len(ids), BLOCK):
            # A token's own sums and those of its neighbours lie in one row each, so rows are looked up once.
            rows = self.table.take(wide[lo : lo + BLOCK + 5], axis=0)
            part = out[lo : lo + BLOCK]
            part += rows[3 : 3 + len(part), :3]
            for k, p in enumerate(PLACES):
                part += rows[3 + p : 3 + p + len(part), 3 + 3 * k : 6 + 3 * k]
        return out + barred(self.facts[ids, 0], touch)

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The best path. Plain numbers: for three tags that is faster than arrays."""
        move = self.legal().tolist()
        (oo, ob, _), (bo, bb, bi), (io, ib, ii) = move
        o, b, i = 0.0, -1e18, -1e18
        back: list[tuple[int, int, int]] = []
        for so, sb, si in scores.tolist():
            po = 0 if (x := o + oo) >= (y := b + bo) and x >= i + io else 1 if y >= i + io else 2
            no = (x, y, i + io)[po]
            pb = 0 if (x := o + ob) >= (y := b + bb) and x >= i + ib else 1 if y >= i + ib else 2
            nb = (x, y, i + ib)[pb]
            pi = 1 if (x := b + bi) >= i + ii else 2
            ni = x if pi == 1 else i + ii
            back.append((po, pb, pi))
            o, b, i = no + so, nb + sb, ni + si
        last = max((o, 0), (b, -1), (i, -2))[1]
        path = [-last]
        for step in reversed(back[1:]):
            path.append(step[path[-1]])
        return path[::-1]

    def stretches(self, scores: np.ndarray) -> list[tuple[int, int]]:
        """Where the best path may leave OUTSIDE; everywhere else it does not.

        Against a path that stays outside, one that leaves gains at each token what its tag scores more and its move costs less.
        From below, gains are summed up to a token from the best beginning (so_far) and from it to the best end (to_come).
        """
        move, n = self.legal(), len(scores)
        gain = scores[:, 1:] - scores[:, :1] - move[OUTSIDE, OUTSIDE]
        begin = gain[:, 0] + move[OUTSIDE, BEGIN]
        going = np.maximum(gain[:, 0] + max(move[BEGIN, BEGIN], move[INSIDE, BEGIN]), gain[:, 1] + max(move[BEGIN, INSIDE], move[INSIDE, INSIDE]))
        leave = np.full(n, max(move[BEGIN, OUTSIDE], move[INSIDE, OUTSIDE]) - move[OUTSIDE, OUTSIDE])
        leave[-1] = 0.0
        total = np.cumsum(going)
        so_far = total + np.maximum.accumulate(begin - total)
        to_come = np.maximum.accumulate((total + leave)[::-1])[::-1] - total
        maybe = np.concatenate([[False], so_far + to_come > -1e-6, [False]])
        edges = np.flatnonzero(maybe[1:] != maybe[:-1])
        return list(zip(edges[::2].tolist(), edges[1::2].tolist()))

    def decode(self, scores: np.ndarray) -> list[tuple[int, int]]:
        """The best path of a text as its secrets: first and last token of each."""
        out: list[list[int]] = []
        end = np.array([[0.0, -1e18, -1e18]])
        for a, b in self.stretches(scores) if len(scores) else ():
            # A stretch inside the text is followed by a token that is outside.
            path = self.viterbi(scores[a:b] if b == len(scores) else np.concatenate([scores[a:b], end]))
            for i, tag in enumerate(path, a):
                if tag == BEGIN:
                    out.append([i, i])
                elif tag == INSIDE:
                    out[-1][1] = i
        return [(a, b) for a, b in out]

    def gradient(self, scores: np.ndarray, tags: np.ndarray, length: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, and expected less observed of each place's tags and of moves, by forward and backward sums over chains side by side.

        scores: chains x places x 3, tags: chains x places, length: of each chain.
        """
        move, (n, t, _) = self.legal(), scores.shape
        step, top = np.exp(move), scores.max(axis=2)
        odds = np.exp(scores - top[..., None])
        # Sums are kept as shares of each place's whole, so that they neither grow nor vanish along a chain.
        alive = np.arange(t)[None] < length[:, None]
        a, b, whole = np.zeros((n, t, 3)), np.ones((n, t, 3)), np.ones((n, t))
        for k in range(t):
            on = np.flatnonzero(alive[:, k])
            now = (a[on, k - 1] @ step if k else step[OUTSIDE]) * odds[on, k]
            whole[on, k] = now.sum(axis=1)
            a[on, k] = now / whole[on, k, None]
        for k in range(t - 2, -1, -1):
            on = np.flatnonzero(alive[:, k + 1])
            b[on, k] = (odds[on, k + 1] * b[on, k + 1] / whole[on, k + 1, None]) @ step.T
        z = (np.where(alive, np.log(whole) + top, 0.0)).sum(axis=1)
        at = np.where(alive[..., None], a * b, 0.0)
        came = np.where(alive[..., None], odds * b / whole[..., None], 0.0)
        moves = step * (a[:, :-1].reshape(-1, 3).T @ came[:, 1:].reshape(-1, 3))
        moves[OUTSIDE] += at[:, 0].sum(axis=0)
        before = np.concatenate([np.zeros((n, 1), np.int64), tags[:, :-1]], axis=1)
        np.subtract.at(moves, (before[alive], tags[alive]), 1)
        true = np.where(alive, np.take_along_axis(scores, tags[..., None], 2)[..., 0] + move[before, tags], 0.0).sum()
        chain, place = np.nonzero(alive)
        at[chain, place, tags[alive]] -= 1
        return float(z.sum() - true), at, moves

    def fit(self, data: list[tuple[list[str], list[int], list[int], tuple[np.ndarray, np.ndarray]]], steps: int = 50, rate: float = 0.25, ridge: float = 0.02) -> "Field":
        """data: tokens, tags, file features and surroundings of each chain. Steps along the gradient, scaled by its running size in each weight."""
        # Words of one text only are as good as unknown.
        often = collections.Counter(w for x in data for w in {y for t in x[0] for y in (t.lower(), word(t))})
        self.vocabulary = frozenset(w for w, k in often.items() if k > 1)
        own = Tokens(self.vocabulary)
        length = np.array([len(x[0]) for x in data])
        n, t = len(data), int(length.max())
        tags, never = np.zeros((n, t), np.int64), np.zeros((n, t, 3))
        features, place = [], []
        for k, (tokens, tag, file, around) in enumerate(data):
            tags[k, : len(tag)] = tag
            ids = own.ids([EDGE, *tokens])
            edge, ids = int(ids[0]), ids[1:]
            both = own.together(ids, np.array(own.facts, np.int64), *around).tolist()
            wide = [edge] * 3 + ids.tolist() + [edge] * 2
            for j, i in enumerate(ids.tolist()):
                f = own.shapes[i] + [own.around[wide[3 + j + p]][q] for q, p in enumerate(PLACES)] + file + both[j]
                features += f
                place += [k * t + j] * len(f)
            never[k, : len(tokens)] = barred(np.array([own.facts[i][0] for i in ids.tolist()]), around[0])
        features, place = np.array(features), np.array(place)
        first, second = np.zeros((2, FEATURES, 3)), np.zeros((2, FEATURES, 3))
        first, second = first[0], second[0]
        m1, m2 = np.zeros((3, 3)), np.zeros((3, 3))
        for step in range(1, steps + 1):
            s = np.stack([np.bincount(place, self.emit[features, c], n * t) for c in range(3)], axis=1).reshape(n, t, 3) + never
            _, at, moves = self.gradient(s, tags, length)
            flat = at.reshape(n * t, 3)
            g = np.stack([np.bincount(features, flat[place, c], FEATURES) for c in range(3)], axis=1) + ridge * self.emit
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            m1, m2 = 0.9 * m1 + 0.1 * (moves + ridge * self.move), 0.99 * m2 + 0.01 * moves**2
            fade = rate * (1 - 0.9 * step / steps)
            self.emit -= fade * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-3)
            self.move -= fade * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-3)
        self.emit -= self.emit.mean(axis=1, keepdims=True)
        self.reset()
        return self


def examples(n: int = 2000, seed: int = 11) -> list[tuple[str, list[tuple[int, int]]]]:
    """Made texts and the spans of their secrets."""
    rng = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    chars = {"hex": digits + "abcdef", "b62": lower + upper + digits, "b64": lower + upper + digits + "+/", "url": lower + upper + digits + "-_", "up": upper + digits}
    syllables = "the er on an re he in ed nd ha que ung sch cion ment eux la en st ar ti ou lo ri me".split()
    one = rng.choice

    def run(kind: str, size: int) -> str:
        return one(lower) + "".join(one(chars[kind]) for _ in range(size - 3)) + one(digits) + one(chars[kind].replace("+/", "").replace("-_", ""))

    def word() -> str:
        return "".join(one(syllables) for _ in range(rng.randint(1, 4)))

    def spoken() -> str:
        """A word of running text."""
        return word() if rng.random() < 0.75 else one([
            lambda: word().capitalize(), lambda: word().upper(), lambda: "".join(one(syllables) for _ in range(rng.randint(5, 9))), lambda: f"{word()}-{word()}", lambda: str(rng.randint(0, 10 ** rng.randint(1, 6))), lambda: f"{word()}/{word()}",
            lambda: word() + one("éüñßçа語の한") + word(), lambda: "".join(chr(rng.randint(0x4E00, 0x5FFF)) for _ in range(rng.randint(3, 40))), lambda: f'"{word()} {word()}"', lambda: f"{word()}'{one('stm')} {word()}", lambda: f"({word()}, {word()})", lambda: word().capitalize() + word().capitalize(), lambda: f"{rng.randint(1, 99)}.{rng.randint(1, 99)}%", lambda: word() + one(["!", "?", ";", ":", "..."]), lambda: f"{word()}{rng.randint(1, 99)}",
        ])()

    def prose(k: int) -> str:
        return " ".join(w + one(["", "", "", ",", "."]) for w in (spoken() for _ in range(k)))

    def told(k: int) -> str:
        """Running text with marks between its words, in capitals or not."""
        between, last = one(["!! ", "! ", "?! ", " - ", "... ", ", ", " ** ", " | ", "? ", "; ", "!!! ", " & ", "\n", ".\n- "]), one(["", "!!", ".", "?", "..."])
        text = between.join(" ".join(word() + one(["", "", one("éüñß") + word()]) for _ in range(one([1, 1, 1, 2, 5]))) for _ in range(k)) + last
        return one([text, text.upper(), text.upper(), text.title()])

    def marked() -> str:
        """A password with marks inside; the last is no mark that ends a sentence or a string."""
        body = [one(lower + upper + digits) for _ in range(rng.randint(2, 8))]
        for _ in range(rng.randint(1, 5)):
            body += [one("!@#$%^&*?+-_~:.") * one([1, 1, 1, 2]), *(one(lower + upper + digits) for _ in range(rng.randint(1, 6)))]
        return "".join(body) + one(["", "", "", "!", "#", "&", "$", "*"])

    def letters(size: int) -> str:
        return "".join(one(lower) for _ in range(size))

    def short() -> str:
        """Passwords as people choose them."""
        return one([
            lambda: word() + str(rng.randint(1, 9999)), lambda: word().capitalize() + str(rng.randint(1, 99)) + one("xyz"), lambda: word() + one(["-", "_"]) + word() + str(rng.randint(1, 99)),
            lambda: marked(), lambda: marked(), lambda: "".join(word() for _ in range(rng.randint(3, 5))), lambda: word().capitalize() + str(rng.randint(1990, 2030)), lambda: run("b62", rng.randint(7, 12)), lambda: str(rng.randint(10**5, 10**8)), lambda: word() + word().upper() + one(digits), lambda: "".join(one(lower) for _ in range(rng.randint(7, 12))),
        ])()

    def key() -> str:
        kind = one(["b62", "b64", "hex", "up", "url", "pre"])
        if kind == "pre":
            return one(["ghp_", "gho_", "sk-", "sk_live_", "xoxb-", "xoxp-", "glpat-", "AIza", "npm_", "hf_", "SG_"]) + run("b62", rng.randint(20, 40))
        return run(kind, rng.randint(16, 48)) + (one(["", "=", "=="]) if kind == "b64" else "")

    def harmless() -> str:
        return one([
            lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}:{rng.randint(10, 59)}", lambda: f"item-{rng.randint(1000, 99999)}-{word()}-{word()}", lambda: f"/{word()}/{word()}/{rng.randint(1, 999)}/{word()}",
            lambda: f"{word()}_{word()}_{rng.randint(1, 99)}", lambda: f"v{rng.randint(1, 9)}-{word()}-release{rng.randint(1, 9)}", lambda: f"{rng.randint(10**13, 10**16)}id", lambda: f"{word()}{word()}{word()}{rng.randint(1, 2030)}",
            lambda: f"{rng.randint(100, 999)}-{rng.randint(100, 999)}-{rng.randint(1000, 9999)}", lambda: f"{word()}.{word()}{rng.randint(1, 99)}@{word()}.example", lambda: f"{rng.randint(1, 255)}.{rng.randint(1, 255)}.{rng.randint(1, 255)}.{rng.randint(1, 255)}",
            lambda: " ".join(str(rng.randint(1000, 9999)) for _ in range(4)), lambda: str(rng.randint(10**13, 10**16)), lambda: f"https://{word()}.example/{word()}/{word()}-{rng.randint(1, 9999)}", lambda: f"+{rng.randint(1, 99)} ({rng.randint(100, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)}",
        ])()

    names = "key auth credential private_key access_key client_secret pwd pass passphrase token bearer SIGNING_KEY webhook_secret db_password apiKey secretKey DB_PASS login_pass auth_token pin PASSWORD secret".split()
    nothing = "required none null true false optional missing expired empty changed unknown string value name field disabled".split()

    def secret() -> list[tuple[str, bool]]:
        """Parts of a line, and which are the secret."""
        name, value = one(names), key() if rng.random() < 0.5 else short()
        a, z = one([("", ""), ("", ""), ('"', '"'), ("'", "'")])
        return one([
            lambda: [(f"{name} = {a}", False), (value, True), (z, False)], lambda: [(f"{name}: {a}", False), (value, True), (z, False)], lambda: [(f"{name}={a}", False), (value, True), (z, False)],
            lambda: [(f"export {name.upper()}={a}", False), (value, True), (z, False)], lambda: [(f'"{name}": "', False), (value, True), (one(['",', '"']), False)], lambda: [(f"{name} => '", False), (value, True), ("'", False)],
            lambda: [(f"{one(['the', 'my', 'your', 'our', ''])} {name} is {a}", False), (value, True), (z, False)], lambda: [(f"{one(['Authorization: Bearer', 'Authorization: Basic', 'bearer', 'Authorization: token'])} ", False), (key(), True)],
            lambda: [(f"{one(['https', 'postgres', 'mysql', 'amqp', 'redis', 'mongodb'])}://{word()}:", False), (value, True), (f"@{word()}.example/{word()}", False)], lambda: [(f"curl -H 'X-Auth-Token: ", False), (key(), True), ("' host", False)],
            lambda: [(f"{name}{one([':', ' =', ':', ' is:'])}{one([chr(10), chr(10), chr(10) * 2 + '  '])}", False), (value, True)],
            lambda: [(f"{one(['my', 'the', 'das', 'mein', 'su', 'le', ''])} {one([*names, 'passwort', 'Passwort', 'kennwort Passwort', 'passe', 'password', 'passwd', 'passcode'])} {one(['is', 'lautet', 'ist', 'est', 'es', 'was', 'now is', 'changed to'])} ", False), (one([short, marked])(), True)],
            lambda: [(f"{one(['Authorization: Bearer', 'Authorization: Basic', 'bearer', 'Bearer', 'token:'])} ", False), (one([letters, letters, lambda n: run("b62", n)])(rng.choice([24, 40, 80, 200, 400])), True)],
            lambda: [(f"{one(['db_pass', 'pwd', 'DB_PASSWORD', 'smtp_pass', name])}{one([' = ', '=', ': '])}{(q := one(chr(34) + chr(39)))}", False), (marked(), True), (q, False)],
            lambda: [(f"curl -u {word()}:", False), (value, True), (" host", False)], lambda: [(one(["", "see ", "use ", one(names) + " "]), False), (one(["ghp_", "gho_", "sk-", "sk_live_", "xoxb-", "glpat-", "AIza", "npm_"]) + run("b62", rng.randint(20, 40)), True)],
            lambda: [(f"{one(['Authorization: Bearer ', 'token: ', 'id_token=', 'cookie: session=', ''])}", False), (".".join(["eyJ" + run("url", rng.randint(17, 30)), "eyJ" + run("url", rng.randint(20, 50)), run("url", rng.randint(20, 43))]), True)],
            lambda: [(f"{name}{one(['=', ': '])}", False), (".".join(run(one(["b62", "url"]), rng.randint(8, 24)) for _ in range(rng.randint(2, 3))), True)],
            lambda: [(f"-----BEGIN {one(['RSA ', 'EC ', ''])}PRIVATE KEY-----\n", False), ("\n".join(run("b64", rng.choice([40, 64])) for _ in range(rng.randint(2, 4))) + one(["", "="]), True), ("\n-----END PRIVATE KEY-----", False)],
        ])()

    def clean() -> list[tuple[str, bool]]:
        name = one(names)
        return [(one([
            lambda: f"{one(['', 'see ', 'page = ', 'ref: ', 'id: ', 'call ', 'card ', 'from '])}{harmless()}", lambda: f"{name}{one([': ', ' = ', '='])}{one(nothing)}", lambda: f"the {name} {one(['is', 'was', 'must be', 'can be'])} {one(nothing)} {prose(3)}",
            lambda: f"{one(['a key', 'the author', 'passing', 'keyboard', 'a token of', 'secretary', 'authority', 'private', 'the password', 'monkey', 'login'])} {prose(5)}", lambda: f"{one(['key', 'keywords', 'author', 'passage'])}: {prose(4)}",
            lambda: run(one(["b62", "b64", "up"]), rng.randint(16, 40)) if rng.random() < 0.3 else harmless(), lambda: f"-----BEGIN {one(['CERTIFICATE', 'PUBLIC KEY'])}-----\n" + "\n".join(run("b64", 64) for _ in range(2)) + "\n-----END", lambda: f"{name} {prose(4)} {harmless()}", lambda: prose(rng.randint(20, 40)), lambda: told(rng.randint(5, 30)), lambda: told(rng.randint(5, 30)),
            lambda: f"{one(['commit', 'build', 'version', 'uuid', 'sha1', 'etag'])} {run('hex', rng.choice([12, 16, 20]))}", lambda: f"def {word()}_{one(['key', 'token', 'auth'])}({word()}, {word()}=None): return {word()}",
        ])(), False)]

    out = []
    for _ in range(n):
        parts: list[tuple[str, bool]] = [(prose(rng.randint(0, 8)) + one([" ", " ", "\n"]), False)]
        for _ in range(one([1, 1, 2])):
            parts += [*(secret() if rng.random() < 0.5 else clean()), (one([" ", "\n", " " + prose(rng.randint(1, 6)) + " "]), False)]
        text, spans = "", []
        for part, hidden in parts:
            if hidden:
                spans.append((len(text), len(text) + len(part)))
            text += part
        out.append((text, spans))
    return out


def tagged(text: str, spans: list[tuple[int, int]]) -> tuple[list[str], list[int], list[int], tuple[np.ndarray, np.ndarray]]:
    """Tokens, tags, file features and surroundings of a text with known secrets."""
    tokens, starts, ends = cut(text)
    tags: list[int] = []
    for s, e in zip(starts.tolist(), ends.tolist()):
        hit = next((x for x in spans if x[0] < e and s < x[1]), None)
        tags.append(OUTSIDE if hit is None else BEGIN if s <= hit[0] or tags[-1:] in ([], [OUTSIDE]) else INSIDE)
    return tokens, tags, file_features(text), surroundings(tokens, starts, ends)


@functools.cache
def trained() -> Field:
    """The field, fit on made texts; the same wherever it is made."""
    return Field().fit([x for x in (tagged(text, spans) for text, spans in examples()) if x[0]])


def field_spans(text: str, field: Field) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the field tags."""
    tokens, starts, ends = cut(text)
    if not tokens:
        return []
    found = field.decode(field.scores(tokens, file_features(text), *surroundings(tokens, starts, ends)))
    return [(int(starts[a]), 3, int(ends[b])) for a, b in found]


def spans_of(text: str | None, field: Field) -> list[tuple[int, int, int]]:
    """All spans, base ones first to stay; by start, then by kind."""
    text = text or ""
    base, new = base_spans(text), []
    # Both lists are in order of their starts, so one sweep finds the base spans that meet one of the field; what these leave of it stays.
    at = reach = 0
    for s, kind, e in field_spans(text, field):
        while at < len(base) and base[at][0] < e:
            if base[at][0] > max(s, reach):
                new.append((max(s, reach), kind, base[at][0]))
            reach = max(reach, base[at][2])
            at += 1
        if max(s, reach) < e:
            new.append((max(s, reach), kind, e))
    return sorted(base + new) if new else base


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """text with each span, or run of overlapping spans, replaced."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """keys, spans array<struct<start, end, kind>>, redacted text (null for null) of each row."""
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys) + ", spans array<struct<start: int, end: int, kind: string>>, redacted string"
    field = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                spans, texts = [], []
                known: dict[str | None, list[tuple[int, int, int]]] = {}  # copies within a slice are scanned once
                for t in part.column(len(keys)):
                    text = t.as_py()
                    if (found := known.get(text)) is None:
                        found = known[text] = spans_of(text, field.value)
                    spans.append([{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in found])
                    texts.append(None if text is None else redacted(text, found))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.array(spans, kind), pa.array(texts, pa.string())], names=[*keys, "spans", "redacted"])

    return small_batches(docs).select(*keys, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def op6_secrets(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "crf")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
