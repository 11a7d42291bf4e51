"""Secrets in texts: fixed patterns, and a linear-chain conditional random field.

The field labels tokens as begin, inside or outside of a secret from their shape,
their neighbours and features of the file, and is decoded by Viterbi. It is trained
here by maximum likelihood on generated lines: secrets of many kinds in many
contexts, and look-alikes that are none.

All tokens of the whole text have features. A token is *certain* if its own margin for
*outside* exceeds all that the learnt transitions to and from any neighbours can give
another label; replacing another label there would always gain, so the best path is
outside there. Only the tokens between certain ones are decoded, and the result is that
of decoding the whole text. Long texts are read in segments, with the neighbours across
a segment's ends.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Fixed patterns: kind, pattern, least length and the group it holds for.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "crf")

O, B, I = 0, 1, 2
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}={1,2}(?![A-Za-z0-9])|[\w+/-]+(?:\.[\w+/-]+)*|[^\s\w+/-]")
SPACE = re.compile(r"\s")
NAMES = re.compile(r"(?i)pass(?:word|wd|phrase)?$|pwd$|secret|token|api.?key|credential|auth|bearer|private|signature|access.?key|accountkey|client.?key")
RUNS = re.compile(r"[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]")
NOT_HEX = re.compile(r"[^0-9a-f]")
PREFIX = re.compile(r"(ghp|gho|sk|pk|rk|xox[abp]|glpat|npm|AKIA|ASIA|AIza|eyJ|SG)[._-]?")
NUMERIC = re.compile(r"\d[\d./-]*")
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
#: Shortest span that the field may add.
LEAST = 12
#: Code points of a text that are read at a time, and words that are remembered.
SEGMENT, REMEMBERED = 1 << 18, 1 << 19
#: Code points of texts, about, whose results leave a task at once; a text is never parted.
PART = 1 << 20
#: Tokens before one in which a name counts.
NAMED = 4


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches of the fixed patterns, leftmost and not overlapping within a kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def join_spans(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _shape(w: str) -> list[str]:
    """Shape features of a token; the first one is its kind."""
    n = len(w)
    if n == 1:
        return [f"p={w}"]
    length = "s" if n < 8 else "m" if n < 12 else "l" if n < 20 else "x" if n < 40 else "xx"
    varied = f"u={len(set(w)) // 3},{length}"
    if w.isalpha() and (w.islower() or w[1:].islower()):
        kind, runs = ("low", 1) if w.islower() else ("word", 2)
        out = [f"k={kind}", f"n={length}", f"kn={kind},{length}", f"r={runs}", f"kr={kind},{runs}", varied, "sym="]
    else:
        digits, upper, lower = sum(c.isdigit() for c in w), sum(c.isupper() for c in w), sum(c.islower() for c in w)
        runs = min(12, len(RUNS.findall(w)))
        kind = "hex" if digits and lower and not NOT_HEX.search(w) else "num" if digits == n else "up" if upper == n else "UP9" if upper + digits == n else "mix" if upper and lower and digits else "Aa" if upper + lower == n else "a9" if lower + digits == n else "sym"
        out = [f"k={kind}", f"n={length}", f"kn={kind},{length}", f"r={runs}", f"kr={kind},{runs}", varied, f"sym={''.join(sorted({c for c in w if not c.isalnum()}))}"]
        if n >= LEAST and PREFIX.match(w):
            out.append("prefix")
        if NUMERIC.fullmatch(w):
            out.append("numeric")
        if UUID.fullmatch(w):
            out.append("uuid")
    if NAMES.search(w):
        out.append("name")
    return out


def _as_neighbour(w: str, shape: Sequence[str]) -> str:
    """The class of a token as a neighbour; it depends on nothing but its shape."""
    if len(w) == 1:
        return w
    kind = shape[0][2:]
    return "NAME" if shape[-1] == "name" else kind if kind in ("num", "low") else "alpha" if kind in ("word", "up", "Aa") else "other"


def file_features(text: str) -> list[str]:
    """Features of the whole file that do not depend on where a token stands."""
    n = max(1, len(text))
    pairs, lines = text.count("=") + text.count(": "), text.count("\n") + 1
    return [f"file:pairs={min(3, int(200 * pairs / n))}", f"file:line={min(4, int(math.log10(n / lines + 1)))}", f"file:code={'{' in text and ';' in text}"]


def token_features(tokens: list[str], of_file: list[str]) -> list[list[str]]:
    """All features of all tokens of a text, by name."""
    out = []
    shapes = [_shape(w) for w in tokens]
    side = [_as_neighbour(w, f) for w, f in zip(tokens, shapes, strict=True)]
    for i, f in enumerate(shapes):
        a, b = side[i - 1] if i else "^", side[i - 2] if i > 1 else "^"
        c = side[i + 1] if i + 1 < len(tokens) else "$"
        named = any(x == "NAME" for x in side[max(0, i - NAMED) : i])
        out.append([*f, f"-1={a}", f"-2={b}", f"+1={c}", f"-2-1={b},{a}", f"named={named}", f"named,{f[0]}={named}", *of_file, "bias"])
    return out


def segments(text: str, size: int) -> Iterator[tuple[int, int]]:
    """Cuts a text at white space, after about ``size`` code points each."""
    at, n = 0, len(text)
    while at < n:
        m = SPACE.search(text, at + size) if at + size < n else None
        end = m.start() if m else n
        yield at, end
        at = end


class _Remembered(dict):
    def __init__(self, make: Callable[[str], int]):
        self.make = make

    def __missing__(self, w: str) -> int:
        i = self[w] = self.make(w)
        return i


class Field:
    """Weights of the features by label, and of transitions; scores all tokens of a segment at once."""

    def __init__(self, weights: dict[str, np.ndarray], moves: np.ndarray):
        self.weights, self.moves = weights, moves
        zero = np.zeros(3)
        get = lambda name: weights.get(name, zero)
        sides = sorted({x for f in weights for x in (f[3:] if f.startswith(("-1=", "-2=", "+1=")) else "",) if x} | {"^", "$"})
        self.side = {x: i for i, x in enumerate(sides)}
        self.no_side = len(sides)
        sides.append("")
        # A neighbour that training never had is the last class, whose weights are 0.
        self.before = np.array([[get(f"-2={b}") + get(f"-1={a}") + get(f"-2-1={b},{a}") for a in sides] for b in sides]).reshape(-1, 3)
        self.after = np.array([get(f"+1={c}") for c in sides])
        kinds = sorted({f[6 : f.rindex("=")] for f in weights if f.startswith("named,")})
        self.kind = {x: i for i, x in enumerate(kinds)}
        self.named = np.array([[get(f"named={v}") + get(f"named,{k}={v}") for v in (False, True)] for k in [*kinds, ""]]).reshape(-1, 3)
        # What another label than outside can gain by its transitions, whatever its neighbours are.
        self.reach = np.array([max(moves[p, y] + moves[y, n] - moves[p, O] - moves[O, n] for p in (O, B, I) for n in (O, B, I)) for y in (B, I)]) + 1e-6
        self._forget()

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "moves": self.moves}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def _forget(self) -> None:
        self.ids = _Remembered(self._learn)
        self.own, self.of = np.zeros((1024, 3)), np.zeros((1024, 3), np.int64)
        self.by_shape: dict[tuple, tuple] = {}

    def _learn(self, w: str) -> int:
        """Remembers a word: the weights of its shape; its class as a neighbour, kind, and whether it is a name."""
        i = len(self.ids)
        if i == len(self.own):
            self.own, self.of = np.concatenate([self.own, np.zeros_like(self.own)]), np.concatenate([self.of, np.zeros_like(self.of)])
        shape = tuple(_shape(w))
        known = self.by_shape.get(shape)
        if known is None:
            side = _as_neighbour(w, shape)
            of = self.side.get(side, self.no_side), self.kind.get(shape[0], len(self.kind)), side == "NAME"
            known = self.by_shape[shape] = sum((self.weights[f] for f in (*shape, "bias") if f in self.weights), np.zeros(3)), of
        self.own[i], self.of[i] = known
        return i

    def scores(self, tokens: list[str], left: list[str], right: list[str], of_file: list[str]) -> np.ndarray:
        """Scores of the labels of each token; left: the four tokens before, right: the one after, as far as there are any."""
        if len(self.ids) > REMEMBERED:
            self._forget()
        words = [*left, *tokens, *right]
        every = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        side, kind, name = self.of[every].T
        k, n = len(left), len(tokens)
        edge = self.side["^"]
        lag = lambda d: np.concatenate([np.full(d, edge), side])[k : k + n]
        follow = np.append(side, self.side["$"])[k + 1 : k + 1 + n]
        names = np.cumsum(np.concatenate([np.zeros(NAMED + 1, np.int64), name]))
        named = names[k + NAMED : k + NAMED + n] > names[k : k + n]
        e = self.own[every[k : k + n]] + self.before[lag(2) * (self.no_side + 1) + lag(1)] + self.after[follow] + self.named[2 * kind[k : k + n] + named]
        return e + sum((self.weights[f] for f in of_file if f in self.weights), np.zeros(3))

    def decode(self, scores: np.ndarray) -> list[int]:
        """Viterbi, with an outside token before and after."""
        (oo, ob, oi), (bo, bb, bi), (io, ib, ii) = self.moves.tolist()
        o, b, i, back = 0.0, -1e9, -1e9, []
        for eo, eb, ei in scores.tolist():
            x, y, z = o + oo, b + bo, i + io
            to = (x, O) if x >= y and x >= z else (y, B) if y >= z else (z, I)
            x, y, z = o + ob, b + bb, i + ib
            tb = (x, O) if x >= y and x >= z else (y, B) if y >= z else (z, I)
            x, y, z = o + oi, b + bi, i + ii
            ti = (x, O) if x >= y and x >= z else (y, B) if y >= z else (z, I)
            o, b, i = to[0] + eo, tb[0] + eb, ti[0] + ei
            back.append((to[1], tb[1], ti[1]))
        x, y, z = o + oo, b + bo, i + io
        label = O if x >= y and x >= z else B if y >= z else I
        path = []
        for step in reversed(back):
            path.append(label)
            label = step[label]
        return path[::-1]

    def labelled(self, text: str, segment: int = SEGMENT) -> Iterator[tuple[int, int, int]]:
        """(start, end, label) of all tokens of a text whose label is not outside, in order."""
        of_file, left = file_features(text), []
        open_scores: list[np.ndarray] = []
        open_places: list[tuple[int, int]] = []

        def close() -> Iterator[tuple[int, int, int]]:
            if open_places:
                for (a, b), y in zip(open_places, self.decode(np.concatenate(open_scores)), strict=True):
                    if y != O:
                        yield a, b, y
                open_scores.clear()
                open_places.clear()

        for start, end in segments(text, segment):
            tokens = TOKEN.findall(text, start, end)
            if not tokens:
                continue
            m = TOKEN.search(text, end)
            e = self.scores(tokens, left, [m[0]] if m else [], of_file)
            left = (left + tokens[-NAMED:])[-NAMED:]
            doubt = (e[:, 1:] + self.reach >= e[:, :1]).any(axis=1)
            if not doubt.any():
                yield from close()
                continue
            if not doubt[0]:
                yield from close()
            runs = np.flatnonzero(np.diff(np.concatenate([[False], doubt, [False]]).astype(np.int8))).reshape(-1, 2)
            places, at = TOKEN.finditer(text, start, end), 0
            for a, z in runs.tolist():
                open_scores.append(e[a:z])
                open_places.extend(m.span() for m in islice(places, a - at, z - at))
                at = z
                if z < len(tokens):
                    yield from close()
        yield from close()

    def spans(self, text: str, segment: int = SEGMENT) -> list[tuple[int, int]]:
        """Spans labelled as secrets, of ``LEAST`` code points at least."""
        out: list[tuple[int, int]] = []
        last = -1
        for a, b, y in self.labelled(text, segment):
            # Inside goes on only with the token before; tokens are apart by white space at most.
            if y == I and last >= 0 and not TOKEN.search(text, last, a):
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
            last = b
        return [s for s in out if s[1] - s[0] >= LEAST]


_UP, _LOW, _NUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _text(rng: random.Random, letters: str, a: int, b: int) -> str:
    return "".join(rng.choice(letters) for _ in range(rng.randint(a, b)))


def _word(rng: random.Random) -> str:
    w = _text(rng, _LOW if rng.random() < 0.7 else _LOW + "éèêçöäüßñóí", *((2, 11) if rng.random() < 0.85 else (8, 26)))
    return w.capitalize() if rng.random() < 0.12 else w


def _secret(rng: random.Random) -> str:
    full = _UP + _LOW + _NUM
    return rng.choice((
        lambda: _text(rng, "0123456789abcdef", 16, 64), lambda: _text(rng, full, 16, 44), lambda: "AKIA" + _text(rng, _UP + _NUM, 16, 16),
        lambda: "ghp_" + _text(rng, full, 36, 36), lambda: rng.choice(("sk_live_", "sk-", "pk_test_")) + _text(rng, full, 24, 40),
        lambda: "xoxb-" + _text(rng, _NUM, 10, 12) + "-" + _text(rng, full, 20, 26), lambda: "eyJ" + _text(rng, full, 18, 40) + "." + _text(rng, full + "_-", 30, 60) + "." + _text(rng, full + "_-", 30, 44),
        lambda: _text(rng, _UP + _LOW, 16, 44), lambda: _text(rng, full + "+/", 40, 60) + "=" * rng.randint(0, 2), lambda: "AIza" + _text(rng, full + "_-", 35, 35), lambda: "glpat-" + _text(rng, full, 20, 20),
    ))()


def _phrase(rng: random.Random) -> str:
    """A secret that only its name gives away."""
    return rng.choice((lambda: "-".join(_text(rng, _LOW, 3, 9) for _ in range(4)), lambda: _text(rng, _LOW, 14, 30)))()


def _escaped(rng: random.Random) -> str:
    """A secret of several tokens, as in a query string."""
    return "".join(_text(rng, _UP + _LOW + _NUM, 4, 12) + "%" + rng.choice(("2B", "2F", "3D")) for _ in range(rng.randint(3, 5)))


def _lookalike(rng: random.Random) -> str:
    num = lambda a, b: _text(rng, _NUM, a, b)
    return rng.choice((
        lambda: f"{_text(rng, _LOW, 3, 9)}.{num(1, 3)}@{_text(rng, _LOW, 3, 8)}{num(0, 1)}.example.com", lambda: f"+{num(1, 2)} ({num(3, 3)}) {num(3, 3)}-{num(4, 4)}",
        lambda: ".".join(num(1, 3) for _ in range(4)), lambda: f"20{num(2, 2)}-{num(2, 2)}-{num(2, 2)}", lambda: f"{num(1, 2)}:{num(2, 2)}", lambda: f"${num(1, 4)}.{num(2, 2)}",
        lambda: f"https://{_text(rng, _LOW, 4, 9)}.example.org/{_text(rng, _LOW, 2, 8)}/{num(1, 7)}?page={num(1, 2)}&ref={_text(rng, _LOW, 1, 5)}", lambda: f"v{num(1, 1)}.{num(1, 2)}.{num(1, 2)}",
        lambda: "_".join(_text(rng, _LOW, 2, 9) for _ in range(rng.randint(2, 4))) + rng.choice(("", "()", "=" + num(1, 3), "=true")), lambda: num(1, 12),
        lambda: f"{_word(rng)}: {_word(rng)}", lambda: f"{_text(rng, _UP, 1, 3)}-{num(2, 5)}", lambda: f"{num(3, 3)}-{num(2, 2)}-{num(4, 4)}", lambda: f"{_text(rng, '0123456789abcdef', 8, 8)}-{_text(rng, '0123456789abcdef', 4, 4)}-4{num(3, 3)}-a{num(3, 3)}-{_text(rng, '0123456789abcdef', 12, 12)}",
        lambda: f"/{_text(rng, _LOW, 2, 7)}/{_text(rng, _LOW, 3, 9)}_{num(1, 3)}.{rng.choice(('txt', 'html', 'py'))}", lambda: f"{_word(rng)}={_word(rng)}", lambda: f"{rng.choice(('password', 'token', 'secret'))}: {rng.choice(('none', 'required', 'optional', 'see below', '<redacted>', '****'))}",
        lambda: _text(rng, _LOW, 12, 24), lambda: "-".join(_text(rng, _LOW, 2, 9) for _ in range(rng.randint(2, 5))), lambda: _word(rng).capitalize() + "".join(_text(rng, _LOW, 3, 8).capitalize() for _ in range(2)), lambda: _text(rng, _UP, 12, 16), lambda: f"{_text(rng, _LOW, 3, 9)}@{_text(rng, _LOW, 3, 8)}.example.com",
        lambda: " ".join(_word(rng) + rng.choice(("!!", "###", "$$$", "%%%", "&&&", "***", "...")) for _ in range(rng.randint(1, 4))), lambda: f"{num(1, 3)}%", lambda: f"{_word(rng)}%20{_word(rng)}%2C", lambda: _text(rng, _UP, 2, 9) + "!!",
        lambda: _text(rng, _LOW, 12, 30) + ":", lambda: f"{num(1, 3)}{_text(rng, _LOW, 1, 3)}", lambda: f"{_word(rng)}{num(1, 4)}",
    ))()


def generated(count: int, seed: int) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines of words with secrets, whose places are given, and look-alikes."""
    rng, out = random.Random(seed), []
    names = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "client_secret", "AccountKey", "auth_token", "PRIVATE_KEY", "credential", "Authorization: Bearer", "aws_secret_access_key", "signature")
    for _ in range(count):
        text, spans = "", []
        for _ in range(rng.randint(2, 6)):
            text += " ".join(_word(rng) for _ in range(rng.randint(1, 6))) + rng.choice((" ", " ", ", ", "\n"))
            if rng.random() < 0.6:
                text += _lookalike(rng)
            else:
                named = rng.random() < 0.75
                if named:
                    q = rng.choice(("", "", '"', "'"))
                    name = rng.choice(names)
                    text += (name + rng.choice((" ", ": ")) if "Bearer" in name else rng.choice(("", q)) + name + rng.choice(("=", " = ", ": ", ":", " ", " is ", '": "' if q == '"' else ":"))) + q
                else:
                    q = ""
                k = rng.random()
                s = _phrase(rng) if named and k < 0.15 else _escaped(rng) if named and k < 0.25 else _secret(rng)
                spans.append((len(text), len(text) + len(s)))
                text += s + q
            text += rng.choice((" ", " ", ". ", "\n", ", "))
        out.append((text, spans))
    return out


def _sequences(lines: list[tuple[str, list[tuple[int, int]]]]) -> list[tuple[list[list[str]], list[int]]]:
    out = []
    for text, spans in lines:
        tokens, labels = [], []
        for t in TOKEN.finditer(text):
            a = next((a for a, b in spans if t.start() < b and a < t.end()), -1)
            tokens.append(t[0])
            labels.append(O if a < 0 else B if t.start() <= a or not labels or labels[-1] == O else I)
        out.append((token_features(tokens, file_features(text)), labels))
    return out


@lru_cache(2)
def train(count: int = 1200, seed: int = 7, rounds: int = 60, rate: float = 0.4, decay: float = 1e-3) -> Field:
    """Maximum likelihood by full-batch gradient steps with adaptive rates."""
    data = _sequences(generated(count, seed))
    names: dict[str, int] = {}
    most = max(len(y) for _, y in data)
    flat, where, gold = [], [], np.full((len(data), most), -1)
    for s, (features, labels) in enumerate(data):
        gold[s, : len(labels)] = labels
        for t, f in enumerate(features):
            flat += [names.setdefault(x, len(names)) for x in f]
            where += [s * most + t] * len(f)
    flat, where, valid = np.array(flat), np.array(where), gold >= 0
    w, moves = np.zeros((len(names), 3)), np.zeros((3, 3))
    gw, gm = np.full_like(w, 1e-6), np.full_like(moves, 1e-6)
    onehot = np.zeros((*gold.shape, 3))
    onehot[valid] = np.eye(3)[gold[valid]]
    pairs = np.einsum("sti,stj->ij", onehot[:, :-1], onehot[:, 1:])
    starts = onehot[:, 0].sum(axis=0)
    lengths = valid.sum(axis=1)
    ends = onehot[np.arange(len(data)), lengths - 1].sum(axis=0)
    for _ in range(rounds):
        e = np.zeros((gold.size, 3))
        for y in range(3):
            e[:, y] = np.bincount(where, w[flat, y], gold.size)
        e = e.reshape(*gold.shape, 3)
        a = np.zeros_like(e)
        a[:, 0] = e[:, 0] + moves[O]
        for t in range(1, most):
            z = a[:, t - 1, :, None] + moves[None]
            top = z.max(axis=1)
            a[:, t] = np.log(np.exp(z - top[:, None]).sum(axis=1)) + top + e[:, t]
        b = np.zeros_like(e)
        for t in range(most - 1, -1, -1):
            inner = np.zeros((len(data), 3))
            if t + 1 < most:
                z = moves[None] + (e[:, t + 1] + b[:, t + 1])[:, None]
                top = z.max(axis=2)
                inner = np.log(np.exp(z - top[:, :, None]).sum(axis=2)) + top
            b[:, t] = np.where((lengths == t + 1)[:, None], moves[:, O][None], inner)
        total = a[np.arange(len(data)), lengths - 1] + moves[:, O]
        top = total.max(axis=1)
        logz = np.log(np.exp(total - top[:, None]).sum(axis=1)) + top
        p = np.where(valid[:, :, None], np.exp(a + b - logz[:, None, None]), 0)
        both = np.zeros((3, 3))
        for t in range(1, most):
            on = valid[:, t]
            both += np.exp(a[on, t - 1, :, None] + moves[None] + (e[on, t] + b[on, t])[:, None] - logz[on, None, None]).sum(axis=0)
        dm = pairs - both
        dm[O] += starts - p[:, 0].sum(axis=0)
        dm[:, O] += ends - p[np.arange(len(data)), lengths - 1].sum(axis=0)
        diff = (onehot - p).reshape(-1, 3)
        dw = np.stack([np.bincount(flat, diff[where, y], len(names)) for y in range(3)], axis=1) - decay * len(data) * w / 10
        dm -= decay * len(data) * moves / 10
        gw += dw * dw
        gm += dm * dm
        w += rate * dw / np.sqrt(gw)
        moves += rate * dm / np.sqrt(gm)
    return Field({x: w[i] for x, i in names.items()}, moves)


def all_spans(text: str, field: Field) -> tuple[list, list]:
    """Base spans, and these with the field's spans that touch none of them."""
    base = base_spans(text)
    more, at, reach = [], 0, 0
    for a, b in field.spans(text):
        while at < len(base) and base[at][0] < b:
            reach = max(reach, base[at][1])
            at += 1
        if reach <= a:
            more.append((a, b, "crf"))
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))


def find_secrets(docs: DataFrame, mark: str | None = None, replace: bool = False) -> DataFrame:
    """Adds to ``docs(doc_id, text, ...)``: n_assign, n_access, n_hex, base_sha256, spans (and redacted).

    Spans are ``kind:start:end`` in code points, end exclusive, over the whole text,
    however long it is. With ``mark`` the column ``redacted`` has the text with each run
    of overlapping spans replaced by it; with ``replace`` too it is what ``text`` has, and no
    other copy of a text leaves the task. A null or empty text has no spans (and stays as
    it is). Spans of one start are in the order of the kinds. One row per row; null ids
    and repeated rows are rows like others, and an empty table gives no rows. Columns of
    docs named like one of the new ones are replaced by it.
    """
    if replace and mark is None:
        raise ValueError("replace: a mark")
    docs = docs.drop(*({"n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"} & set(docs.columns)))
    kept = docs.columns
    field = train()
    apart = mark is not None and not replace
    more = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + (", redacted string" if apart else "")
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(more).fields])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.int64()] * 3 + [pa.string()] * (2 if mark is None else 3)
        names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"]
        place = kept.index("text")
        for batch in batches:
            texts, at = batch.column(place), 0
            while at < len(texts):
                first, size, rows = at, 0, []
                while at < len(texts) and size < PART:
                    text = texts[at].as_py()
                    base, spans = all_spans(text or "", field)
                    found = [k for _, _, k in base]
                    row = [found.count("assign"), found.count("access"), found.count("hex"), hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(spans)]
                    rows.append(row if mark is None else [*row, redact(text, spans, mark)])
                    at, size = at + 1, size + len(text or "") + 256
                old = batch.slice(first, at - first).columns
                new = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                if replace:
                    old[place] = new.pop().cast(old[place].type)
                yield pa.RecordBatch.from_arrays([*old, *new], [*kept, *names[: len(new)]])

    return docs.mapInArrow(run, schema)


def redact(text: str | None, spans: list[tuple[int, int, str]], mark: str) -> str | None:
    if not text or not spans:
        return text
    parts, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def digest(docs: DataFrame) -> DataFrame:
    return find_secrets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).drop("text")
