"""Secret scans: fixed patterns plus a linear-chain conditional random field decoded by Viterbi.

The field tags every token of a text (runs of word characters and + / -) as secret begin, inside or outside, from its
shape, the words beside it and the marks between them, and features of the whole text. These come in few kinds, so scores are sums
of small tables, looked up for whole texts at once. Decoding is exact: a token whose outside score leads by more than
any path could win back is outside on the best path, and Viterbi runs over the chains of all other tokens.

Weights are learned here, by gradient ascent on the penalised likelihood, from a bounded sample of texts. Their labels are the patterns'
matches and secrets of many shapes planted among their words, with and without a keyword before them: so
the field does not learn the patterns alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import hash_sample, text_of

# The patterns of the contract, and the least lengths of what they must hold.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "crf")
# Words that name a secret, and words that may stand between one and its secret.
KEYWORDS = frozenset("password passwd passphrase pwd pass secret secrets token tokens apikey api_key key keys bearer auth authorization credential credentials pin".split())
BETWEEN = frozenset("is are was the my our your new id value basic".split())

#: Texts that the field is fitted on, about (four times as many at most), by hash; tokens of a chain; chains at most.
TRAIN_ROWS, CHAIN, TRAIN_CHAINS = 800, 32, 6_000
#: What the outside label is ahead by, so that a doubtful token stays text.
CAUTION = 0.5

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A token: word characters, then + / - among them, and the padding of a long encoding at its end.
_CUT = re.compile(r"([\w+](?:[\w+/-]*[\w+/])?(?:(?<=[\w+/-]{15})={1,2}(?![\w\"']))?)")
_PREFIX = re.compile(r"[A-Za-z]{2,8}[_-](?:[a-z]{2,6}[_-])?(?=[A-Za-z0-9])")
_CHANGE = re.compile(r"[a-z][A-Z]")
_TURN = re.compile(r"[A-Za-z][0-9]|[0-9][A-Za-z]")
O, B, I = 0, 1, 2  # noqa: E741


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the patterns' matches, in order of start and then of kind."""
    found = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def shape(token: str) -> tuple[str, ...]:
    """Features of a token alone. Plain words have few shapes."""
    n = len(token)
    if token.isalpha() and (token.islower() or token[1:].islower()) and n < 40:
        return ("word", f"wordlen={min(n // 3, 6)}", f"title={token[0].isupper()}", f"ascii={token.isascii()}")
    digits, upper, lower = sum(map(str.isdigit, token)), sum(map(str.isupper, token)), sum(map(str.islower, token))
    if digits + sum(map(token.count, "+-/=_")) == n:
        return ("number", f"numlen={min(n // 3, 6)}")
    vowels = sum(map(token.lower().count, "aeiou"))
    changes, turns = len(_CHANGE.findall(token)), len(_TURN.findall(token))
    mixed = f"{digits > 0:d}{upper > 0:d}{lower > 0:d}"
    return (
        "odd", f"len={min(n // 4, 10)}", f"mixed={mixed}", f"mixedlen={mixed}:{min(n // 8, 4)}", f"digits={digits * 4 // n}", f"upper={upper * 4 // n}", f"changes={min(changes, 4)}",
        f"turns={min(turns, 4)}", f"distinct={min(len(set(token)), 24) // 4}", f"vowels={vowels * 6 // n}", f"prefixed={bool(_PREFIX.match(token))}", f"marks={min(sum(map(token.count, '_-')), 3)}",
        f"slash={'/' in token}", f"pad={token.endswith('=')}", f"ascii={token.isascii()}", f"hex={n >= 12 and all(c in '0123456789abcdef' for c in token)}",
    )


def role(token: str) -> int:
    """0 for most tokens, 1 for words that name secrets, 2 for words that may stand between."""
    low = token.lower().strip("_-=+/")
    return 1 if low in KEYWORDS or (("_" in low or "-" in low) and re.split("[_-]", low)[-1] in KEYWORDS and low.isascii() and not any(map(str.isdigit, low))) else 2 if low in BETWEEN else 0


# Classes of the marks between two tokens.
GAPS = ("", " ", "line", "=", ":", "quote", "://", "@", ".", ",", "bracket", "wide", "other")


def gap_class(gap: str) -> int:
    bare = gap.strip()
    if not gap or not bare:
        name = "" if not gap else "line" if "\n" in gap else " "
    elif bare in GAPS:
        name = bare if not (bare in ".," and gap != bare) else ","
    elif set(bare) <= set("=:\"'>"):
        name = "=" if "=" in bare else ":" if ":" in bare else "quote"
    elif set(bare) <= set("()[]{}<>"):
        name = "bracket"
    else:
        name = "wide" if len(bare) > 2 else "other"
    return GAPS.index(name)


def text_kind(text: str, tokens: int) -> int:
    """Features of the whole text: its size, and whether it looks like settings or code."""
    marks = text.count("=") + text.count("{") + text.count(";")
    return min(tokens.bit_length() // 3, 4) * 2 + (marks * 20 > tokens)


G, KINDS_OF_TEXT = len(GAPS), 10


class _Shapes(dict):
    """Shape and role numbers of tokens; forgets tokens when it holds too many."""

    def __init__(self, frozen: dict[tuple[str, ...], int] | None = None):
        super().__init__()
        self.numbers: dict[tuple[str, ...], int] = dict(frozen or {})

    def __missing__(self, token: str) -> int:
        """Four times the number of the shape, plus the role."""
        if len(self) > 300_000:
            self.clear()
        out = self[token] = self.numbers.setdefault(shape(token), len(self.numbers)) * 4 + role(token)
        return out


class _Gaps(dict):
    def __missing__(self, gap: str) -> int:
        if len(self) > 50_000:
            self.clear()
        out = self[gap] = gap_class(gap)
        return out


class Tokens:
    """A text's pieces (mark, token, mark, ..., mark) and the numbers of what the field sees of each token."""

    def __init__(self, text: str, shapes: _Shapes, gaps: _Gaps):
        self.pieces = _CUT.split(text)
        n = self.number = len(self.pieces) // 2
        told = np.fromiter(map(shapes.__getitem__, self.pieces[1::2]), np.int32, n)
        marks = np.fromiter(map(gaps.__getitem__, self.pieces[::2]), np.int32, n + 1)
        roles = np.zeros(n + 4, np.int32)
        roles[2:-2] = told & 3
        self.shape = told >> 2
        before, far, after = roles[1:-3], roles[:-4], roles[3:-1]
        # What stands before: the word's role with its mark; a keyword one word further back counts where a filler is between.
        self.before = before * G + marks[:n]
        self.far = far * 3 + before
        self.after = after * G + marks[1 : n + 1]
        self.kind = text_kind(text, n)

    def starts(self) -> np.ndarray:
        """Where each token starts and, in the next row, ends."""
        ends = np.cumsum([len(p) for p in self.pieces])
        return np.stack([ends[:-1:2], ends[1::2]]) if self.number else np.zeros((2, 0), np.int64)


def _roles_named(tokens: Tokens) -> np.ndarray:
    """Tokens that a keyword names outside the patterns: what they are is not known when learning."""
    b, f = tokens.before // G, tokens.far
    mark = tokens.before % G
    return ((b == 1) & np.isin(mark, [GAPS.index("="), GAPS.index(":")])) | ((b == 2) & (f // 3 == 1))


class Field:
    """Weights of shape features and of the other small tables, one row of three labels each; outside never leads to inside."""

    def __init__(self, shapes: dict[str, list[float]], tables: dict[str, np.ndarray], moves: np.ndarray, caution: float = CAUTION):
        self.shapes = {k: np.asarray(v, float) for k, v in shapes.items()}
        self.tables = {k: np.asarray(v, float) for k, v in tables.items()}
        self.moves, self.caution = np.asarray(moves, float), caution
        finite = self.moves[self.moves > -1e8]
        self.reach = 3 * float(finite.max() - finite.min())
        self.forget()

    def forget(self) -> None:
        """Drops the scores of numbered shapes, for use with new numbers."""
        self.known, self.number = np.zeros((64, 3)), 0

    def of_shapes(self, numbers: dict[tuple[str, ...], int]) -> np.ndarray:
        """The scores of all shapes numbered so far; those that come new are added."""
        if len(numbers) > self.number:
            while len(numbers) > len(self.known):
                self.known = np.concatenate([self.known, np.zeros_like(self.known)])
            none = np.zeros(3)
            for i, key in enumerate(islice(numbers, self.number, None), self.number):
                self.known[i] = sum((self.shapes.get(f, none) for f in key), none)
            self.number = len(numbers)
        return self.known

    def scores(self, t: Tokens, numbers: dict) -> np.ndarray:
        e = self.of_shapes(numbers)[t.shape] + self.tables["before"][t.before] + self.tables["far"][t.far] + self.tables["after"][t.after] + self.tables["kind"][t.kind]
        e[:, O] += self.caution
        return e

    def viterbi(self, e: np.ndarray, first: bool = True, closed: bool = False) -> list[int]:
        """The best labels for a chain of scores; first: nothing stands before it, else an outside token. closed: an outside token follows."""
        m = self.moves.tolist()
        rows = e.tolist()
        best = [rows[0][y] + (-1e9 * (y == I) if first else m[O][y]) for y in (O, B, I)]
        back = []
        for row in rows[1:]:
            step, here = [], []
            for y in (O, B, I):
                x = max((O, B, I), key=lambda z, y=y: best[z] + m[z][y])
                step.append(x)
                here.append(best[x] + m[x][y] + row[y])
            back.append(step)
            best = here
        if closed:
            best = [best[y] + m[y][O] for y in (O, B, I)]
        path = [max((O, B, I), key=lambda y: best[y])]
        for step in reversed(back):
            path.append(step[path[-1]])
        return path[::-1]

    def tags(self, t: Tokens, numbers: dict) -> list[tuple[int, int]]:
        """(first, last) token of each secret on the best path through the whole text."""
        if not t.number:
            return []
        e = self.scores(t, numbers)
        ahead = np.append(np.maximum(0, e[1:, I] - e[1:, B]), 0)
        free = np.flatnonzero(e[:, O] - e[:, 1:].max(1) <= self.reach + ahead)
        out = []
        for run in np.split(free, np.flatnonzero(np.diff(free) > 1) + 1):
            if len(run):
                at, last = int(run[0]), int(run[-1])
                labels = self.viterbi(e[at : last + 1], at == 0, last + 1 < t.number)
                for i, y in enumerate(labels, at):
                    if y == B:
                        out.append((i, i))
                    elif y == I:
                        out[-1] = (out[-1][0], i)
        return out


LETTERS = "abcdefghijklmnopqrstuvwxyz"
_SETS = {"mixed": LETTERS + LETTERS.upper() + "0123456789", "lower": LETTERS + "0123456789", "upper": LETTERS.upper() + "0123456789", "hex": "0123456789abcdef", "letters": LETTERS + LETTERS.upper(), "url": LETTERS + LETTERS.upper() + "0123456789-_", "b64": LETTERS + LETTERS.upper() + "0123456789+/"}


def plant(rng: np.random.Generator) -> tuple[str, str, str]:
    """(text before, secret, text after) of one invented secret in one of many shapes and settings."""
    draw = lambda kind, low, high: "".join(rng.choice(list(_SETS[kind]), int(rng.integers(low, high + 1))))
    any_of = lambda *names: names[int(rng.integers(0, len(names)))]
    lead = any_of("", "", any_of("the ", "my ", "old "))
    key = any_of("pwd", "password", "pass", "secret", "api key", "access_token", "client_secret", "auth", "key", "credential", "token")
    if rng.random() < 0.5:
        key = key.capitalize() if rng.random() < 0.5 else key.upper()
    ask = any_of(f"{key}: ", f"{key}=", f"{key} = ", f'"{key}": "', f"{key} is ", f"{lead}{key} is ")
    bearer = any_of("Authorization: Bearer ", "Bearer ", "authorization: Basic ")
    head = any_of(ask, ask, "", "use ", "with ", "run --with ", "as ")
    shape = int(rng.integers(0, 7))
    if shape == 0:
        return head, draw("letters", 1, 1) + draw("lower", 1, 5) + any_of("_", "-") + any_of("", "live_", "test_", "prod-") + draw("mixed", 16, 44), ""
    if shape == 1:
        return any_of(bearer, ask, "cookie "), "eyJ" + draw("url", 12, 40) + "." + draw("url", 20, 90) + "." + draw("url", 20, 50), ""
    if shape == 2:
        return any_of("postgres", "mysql", "amqp", "ftp") + "://" + draw("lower", 3, 8) + ":", draw(any_of("mixed", "letters", "lower"), 8, 24), "@" + draw("lower", 4, 9) + ".example.com"
    if shape == 3:
        return head, draw(any_of("b64", "mixed", "upper"), 24, 60) + any_of("", "", "=", "=="), ""
    if shape == 4:
        return ask, draw(any_of("mixed", "mixed", "letters", "lower"), 6, 20), ""
    if shape == 5:
        return bearer, draw(any_of("mixed", "url", "letters"), 14, 60), ""
    return head, draw(any_of("mixed", "letters"), 18, 40), ""


def decoy(rng: np.random.Generator) -> str:
    """Invented text that looks a little like a secret and is none."""
    draw = lambda kind, low, high: "".join(rng.choice(list(_SETS[kind]), int(rng.integers(low, high + 1))))
    word = lambda: draw("letters", 3, 9).lower()
    made = [
        lambda: f"{rng.integers(1990, 2040)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", lambda: f"+{rng.integers(1, 99)}-{rng.integers(100, 999)}-{rng.integers(1000000, 9999999)}", lambda: f"{word()}.{word()}{rng.integers(0, 99)}@{word()}.com",
        lambda: f"https://www.{word()}.com/{word()}/{word()}-{word()}-{rng.integers(0, 9999)}?id={rng.integers(0, 99999)}", lambda: word() + word().capitalize() + word().capitalize(), lambda: f"/{word()}/{word()}/{word()}_{rng.integers(0, 99)}.txt", lambda: f"{word()}_{word()}_{word()}",
        lambda: f"{rng.integers(10**8, 10**16)}", lambda: word().upper() + "-" + str(rng.integers(100, 99999)), lambda: f"the token of {word()} is a {word()}", lambda: f"key {word()} and {word()}-{word()}", lambda: f"v{rng.integers(0, 9)}.{rng.integers(0, 99)}.{rng.integers(0, 99)}-{word()}",
        lambda: f"https://{word()}.com/{draw('letters', 3, 8)}{rng.integers(10, 999)}{draw('letters', 3, 8)}{rng.integers(10, 999)}{draw('letters', 3, 8)}",
        lambda: "".join(f"{draw('letters', 2, 2).upper()}{rng.integers(10, 99)}" for _ in range(int(rng.integers(2, 4)))), lambda: word() + "".join(word().capitalize() for _ in range(int(rng.integers(3, 7)))) + str(rng.integers(1, 10)),
        lambda: f"the bearer of {word()} {word()}", lambda: f"{word()}{rng.integers(1, 999)}", lambda: word() * 4, lambda: f"pass the {word()} to {word()}",
    ]
    return made[int(rng.integers(0, len(made)))]()


def _labelled(text: str, shapes: _Shapes, gaps: _Gaps, planted: list[tuple[int, int]] = ()) -> tuple[Tokens, np.ndarray, np.ndarray]:
    """Tokens, labels and which tokens teach nothing. Values under a pattern's match and planted spans are secret."""
    t = Tokens(text, shapes, gaps)
    starts, ends = t.starts()
    labels = np.full(t.number, O)
    base = [(m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    base += [(s, e) for s, k, e in base_spans(text) if k != "assign"]
    for s, e in sorted([*base, *planted]):
        inside = np.flatnonzero((starts < e) & (ends > s))
        labels[inside] = I
        labels[inside[:1]] = B
    return t, labels, _roles_named(t) & (labels == O)


def examples_of(texts: list[str], seed: int = 20240229) -> tuple[list[np.ndarray], _Shapes]:
    """Chains of at most CHAIN tokens, those of the texts as they are and with planted secrets and decoys: rows shape, before, far, after, kind, label.

    Only these numbers are held, not the texts.
    """
    rng, shapes, gaps, out = np.random.default_rng(seed), _Shapes(), _Gaps(), []
    for text in texts:
        words = text.split(" ")
        at = int(rng.integers(0, len(words)))
        near, spans = " ".join(words[max(0, at - 40) : at])[-400:], []
        for _ in range(2):
            before, secret, after = plant(rng)
            near = f"{near}{' ' if rng.random() < 0.8 else chr(10)}{decoy(rng)} {before}"
            spans.append((len(near), len(near) + len(secret)))
            near = f"{near}{secret}{after} {decoy(rng)}"
        near = f"{near} {' '.join(words[at : at + 12])[:200]}"
        for whole, planted in ((text, ()), (near, spans)):
            t, labels, unsure = _labelled(whole, shapes, gaps, list(planted))
            for s in range(0, t.number, CHAIN):
                part = slice(s, min(t.number, s + CHAIN))
                # Chains without a secret are many and alike: one in eight of them teaches.
                if (planted or labels[part].any() or rng.random() < 0.125) and not unsure[part].any():
                    out.append(np.stack([t.shape[part], t.before[part], t.far[part], t.after[part], np.full(part.stop - part.start, t.kind), labels[part]]).astype(np.int32))
    if len(out) > TRAIN_CHAINS:
        out = [out[i] for i in np.sort(rng.permutation(len(out))[:TRAIN_CHAINS])]
    return out, shapes


#: Chains whose slopes are worked out together.
_BATCH = 512


def _slopes(e: np.ndarray, m: np.ndarray, live: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the log-likelihood of a batch of chains by the scores of its live tokens, and by the moves (forward-backward)."""
    c, n = e.shape[:2]
    e[:, 0, I] -= 1e9
    fwd, bwd = np.zeros((c, n, 3)), np.zeros((c, n, 3))
    fwd[:, 0] = e[:, 0]
    for i in range(1, n):
        x = fwd[:, i - 1, :, None] + m
        top = x.max(1)
        fwd[:, i] = np.where(live[:, i, None], top + np.log(np.exp(x - top[:, None]).sum(1)) + e[:, i], fwd[:, i - 1])
    for i in range(n - 2, -1, -1):
        x = m + (e[:, i + 1] + bwd[:, i + 1])[:, None, :]
        top = x.max(2)
        bwd[:, i] = np.where(live[:, i + 1, None], top + np.log(np.exp(x - top[:, :, None]).sum(2)), 0)
    z = fwd[:, -1].max(1)
    z = z + np.log(np.exp(fwd[:, -1] - z[:, None]).sum(1))
    g = -np.exp(np.minimum(0, fwd + bwd - z[:, None, None]))
    np.put_along_axis(g, y[:, :, None], np.take_along_axis(g, y[:, :, None], 2) + 1, 2)
    pair = live[:, 1:]
    p = fwd[:, :-1, :, None] + m + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]
    moves = -np.exp(np.minimum(0, p[pair])).sum(0)
    np.add.at(moves, (y[:, :-1][pair], y[:, 1:][pair]), 1)
    return g[live], moves


def fit(examples: list[np.ndarray], shapes: _Shapes, rounds: int = 60, rate: float = 0.4, penalty: float = 2e-5) -> Field:
    """Penalised maximum likelihood by full gradients (forward-backward over all chains at once) with Adagrad steps."""
    sizes = {"before": 3 * G, "far": 9, "after": 3 * G, "kind": KINDS_OF_TEXT}
    keys = list(shapes.numbers)
    names = {f: i for i, f in enumerate(sorted({f for k in keys for f in k}))}
    holds = np.zeros((len(keys), max(1, len(names))))
    for i, k in enumerate(keys):
        holds[i, [names[f] for f in k]] = 1
    c = len(examples)
    width = np.array([x.shape[1] for x in examples], int)
    packed = np.zeros((6, c, CHAIN), np.int32)
    for i, x in enumerate(examples):
        packed[:, i, : x.shape[1]] = x
    column = dict(zip(("shape", "before", "far", "after", "kind"), packed, strict=False))
    y, live = packed[5].astype(np.int64), np.arange(CHAIN)[None, :] < width[:, None]
    y[:, 0][y[:, 0] == I] = B  # a chain cut inside a secret begins with it
    w = {name: np.zeros((n, 3)) for name, n in (*sizes.items(), ("shape", holds.shape[1]))}
    t = np.zeros((3, 3))
    wall = np.zeros((3, 3))
    wall[O, I] = -1e9
    seen = {name: np.full_like(v, 1e-8) for name, v in w.items()}
    seen_t = np.full_like(t, 1e-8)
    total = max(1, int(live.sum()))
    for _ in range(rounds if c else 0):
        score = {name: (holds @ v if name == "shape" else v) for name, v in w.items()}
        sums = {name: np.zeros((len(holds) if name == "shape" else len(v), 3)) for name, v in w.items()}
        dt, m = -penalty * t * total, t + wall
        for at in range(0, c, _BATCH):  # a batch of chains at a time: the work space stays small
            part = slice(at, at + _BATCH)
            g, moves = _slopes(sum(score[name][column[name][part]] for name in w), m, live[part], y[part])
            dt += moves
            for name in w:
                where = column[name][part][live[part]]
                sums[name] += np.stack([np.bincount(where, g[:, k], len(sums[name])) for k in (O, B, I)], 1)
        for name, v in w.items():
            d = (holds.T @ sums[name] if name == "shape" else sums[name]) / total - penalty * v
            seen[name] += d**2
            v += rate * d / np.sqrt(seen[name])
        dt /= total
        seen_t += dt**2
        t += rate * dt / np.sqrt(seen_t)
    shape_weights = {f: w["shape"][i].tolist() for f, i in names.items()}
    return Field(shape_weights, {name: w[name] for name in sizes}, t + wall)


def fit_field(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> Field:
    """Fits the field on about train_rows texts of any length, by hash, and those of three times as many that hold a pattern, a keyword or a number.

    Null and empty texts teach nothing; repeated rows count each. An empty table gives the field of the planted secrets alone.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    number = df.count()
    shown = F.col("text").contains("AKIA") | F.col("text").rlike(r"[0-9a-f]{24}") | F.col("text").rlike(r"(?i)(token|secret|passw(or)?d|api_?key)[\"']?\x20*[:=]") | F.col("text").rlike("[0-9]{8}")
    some = hash_sample(rows, ["id", "text"], train_rows, number).unionByName(hash_sample(rows, ["text", "id"], 3 * train_rows, number).where(shown))
    some = some.where("text <> ''").select("text").distinct()
    texts = sorted((r.text for r in some.toLocalIterator()), key=lambda t: hashlib.md5(t.encode("utf-8", "surrogatepass")).digest())
    return fit(*examples_of(texts or ["a text without any secret"] * 50))


class Scanner:
    """Finds spans with a field; keeps what it knows of tokens from text to text."""

    def __init__(self, field: Field):
        self.field, self.shapes, self.gaps = field, _Shapes(), _Gaps()
        field.forget()

    def spans(self, text: str) -> tuple[list, list]:
        """(pattern spans, all spans): the second adds what the field tags outside the patterns' spans."""
        base = base_spans(text)
        t = Tokens(text, self.shapes, self.gaps)
        found = self.field.tags(t, self.shapes.numbers)
        if not found:
            return base, base
        starts, ends = t.starts()
        out = list(base)
        for first, last in found:
            s, e = int(starts[first]), int(ends[last])
            if not any(a < e and s < z for a, _, z in base):
                out.append((s, "crf", e))
        return base, sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def spans_of(text: str, field: Field) -> tuple[list, list]:
    return Scanner(field).spans(text)


def scan_secrets(df: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """Adds secrets: array<struct<kind, start, end>> by start and then kind, in code points, ends exclusive.

    Null and empty texts have no spans; repeated rows are scanned each. Every other column is kept; one named secrets is replaced.
    """
    kind = "array<struct<kind:string,start:bigint,end:bigint>>"

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(field)
        for batch in batches:
            yield pd.Series([[{"kind": k, "start": s, "end": e} for s, k, e in scanner.spans(t)[1]] for t in batch])

    return df.withColumn("secrets", run(text_of(text_col)))


def digest(spans) -> object:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def secret_report(df: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: counts by pattern, the hash of the pattern spans, and all spans. Null texts count as empty; repeated rows stay."""
    field = field or fit_field(df, id_col, text_col)
    found = scan_secrets(df.select(F.col(id_col), F.col(text_col)), field, text_col).select(id_col, "secrets")
    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select(
        id_col, count("assign"), count("access"), count("hex"), F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("secrets")).alias("spans"), count("crf")
    )


def redact_secrets(df: DataFrame, field: Field, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """The same rows and columns; each union of overlapping spans becomes the mark. Null texts stay null, repeated rows stay."""
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(field)
        for batch in batches:
            out = []
            for t in batch:
                if t is None:
                    out.append(None)
                    continue
                parts, at = [], 0
                for s, _, e in scanner.spans(t)[1]:
                    if e <= at:
                        continue
                    if s >= at:
                        parts += [t[at:s], mark]
                    at = e
                out.append("".join(parts) + t[at:] if parts else t)
            yield pd.Series(out, dtype=object)

    return df.withColumn(text_col, run(F.col(text_col)))
