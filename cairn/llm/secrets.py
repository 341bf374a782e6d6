"""Secrets in texts: fixed patterns, and a linear-chain conditional random field for what they miss.

The field tags each token as the beginning of a secret, inside one, or outside. Its features
are a token's shape (classes of characters, length, alphabet, changes of class, entropy),
the two tokens before it, the token behind it, the word before its quotes and signs, and
features of the file (how much of it is punctuation, how long its tokens are). It is trained
by maximum likelihood on lines made up from public formats of credentials and of what looks
like them (hashes of commits, identifiers, numbers, placeholders), and on windows of at most
``SAMPLE`` documents of the corpus, labelled by the patterns; it is decoded by Viterbi.

All features but the file's belong to one token of a place, so a token's share of a score is
worked out once and looked up wherever it stands. A token that is outside by more than
transitions could change is outside on every best path; it cuts the text, and only what lies
between such tokens is decoded step by step. The result is that of decoding the whole.

Base spans are whole matches of the patterns, in code points, per kind leftmost and not
overlapping; matches that are too short are dropped, not shortened. All of them stay. A
tagged span is added, as kind ``crf``, unless it lies within a base span.

Null and empty texts have no spans. A null id is an id. Repeated rows get equal results.
Extra columns are ignored unless carried; a carried column called ``spans`` is refused.
An empty table gives no rows, and a field trained on made-up lines alone.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from cairn.llm.batches import map_texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run shorter than that has no longer one within it
KINDS = ["assign", "access", "hex", "crf"]
#: Documents whose windows are looked at for training, windows of a document, and tokens of a window.
SAMPLE, WINDOWS, WIDTH = 2_000, 6, 48
BUCKETS = 1 << 16
OUT, BEGIN, IN = 0, 1, 2

TOKEN = re.compile(r"[\w+/~-]+(?:[.][\w+/~-]+)*(?:={1,2}(?!\w))?|\S")
_SPACE = re.compile(r"\s")
_CUT = 1 << 20
_KNOWN = 300_000


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of all matches of the patterns that are long enough."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# ---- features


def _steps(x: float, *bounds: float) -> int:
    return sum(x >= b for b in bounds)


def _class(c: str) -> str:
    return "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c if c in "+/=._-~" else "?"


def shape(token: str) -> str:
    """Classes of characters, each run as one, of the first eight runs."""
    out = ""
    for c in token:
        k = _class(c)
        if not out or out[-1] != k:
            if len(out) == 8:
                return out + ">"
            out += k
    return out


def _word(token: str) -> str:
    """How a token is known to its neighbours: short words by themselves, others by shape."""
    low = token.lower().strip("=-_.")
    return low if len(token) <= 16 and (low.isalpha() or "_" in low or "-" in low) else token if len(token) == 1 else "~" + shape(token)


def is_plain(token: str) -> bool:
    return len(token) <= 15 and token.isalpha() and (token.islower() or token.istitle())


def token_features(token: str) -> list[str]:
    """What speaks for a token itself, if it isn't a plain word."""
    n, classes = len(token), [_class(c) for c in token]
    counts = Counter(token)
    kinds = Counter(classes)
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    changes = sum(a != b for a, b in zip(classes, classes[1:], strict=False))
    letters = kinds["a"] + kinds["A"]
    long = _steps(n, 4, 8, 12, 16, 20, 32, 40, 64, 100)
    alphabet = "num" if kinds["0"] == n else "hex" if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", token) else "alnum" if kinds["0"] + letters == n else "b64" if re.fullmatch(r"[\w+/=-]+", token, re.A) else "other"
    vowels = sum(c in "aeiouAEIOU" for c in token) / max(1, letters)
    out = [f"shape={shape(token)}", f"long={long}", f"alphabet={alphabet}", f"alphabet={alphabet},{long}", f"entropy={_steps(entropy, 2, 2.5, 3, 3.5, 4, 4.5, 5)}"]
    out += [f"changes={_steps(changes / n, 0.1, 0.2, 0.3, 0.4, 0.5)},{long > 3}", f"vowels={_steps(vowels, 0.1, 0.2, 0.3, 0.5)},{letters > 7}", f"mixed={kinds['a'] > 0}{kinds['A'] > 0}{kinds['0'] > 0},{long}"]
    out += [f"begins={token[:4]}", f"dots={min(token.count('.'), 3)}", f"name={bool(re.fullmatch(r'[a-z0-9-]+([.][a-z0-9-]+)*[.][a-z]{2,6}', token))}", f"slashes={min(token.count('/'), 3)}"]
    return out + [f"same={max(counts.values()) > n / 2}", f"uuid={bool(re.fullmatch(r'[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}', token))}", f"words={bool(re.fullmatch(r'[A-Za-z]+([_.-][A-Za-z]+)*[0-9]{0,2}', token))}"]


def _crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def _bucket(feature: str) -> int:
    return 1 + _crc(feature) % (BUCKETS - 1)


#: What a token says about its own place, and about those it is a neighbour of; a name's hash is turned by an odd number for each.
ROLES = ("own", "next", "after", "word", "before")
_TURNS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint64)
_PLAIN_STEPS = (3, 6, 10)
_PLAIN_BUCKETS = np.array([_bucket(f"plain={n}") for n in range(len(_PLAIN_STEPS) + 1)])


def own_buckets(token: str) -> list[int]:
    """Of what speaks for a token, but for its name."""
    return [int(_PLAIN_BUCKETS[_steps(len(token), *_PLAIN_STEPS)])] if is_plain(token) else sorted({_bucket(f) for f in token_features(token)})


def name_buckets(names: list[int]) -> np.ndarray:
    """Of names by their hashes, in each role: one row a name."""
    turned = (np.array(names, np.uint64)[:, None] * _TURNS[None, :]) & np.uint64(0xFFFFFFFF)
    return (1 + ((turned * np.uint64(BUCKETS - 1)) >> np.uint64(32))).astype(np.int64)


def name_of(token: str) -> int:
    return _crc(token.lower() if is_plain(token) else _word(token))


def file_features(n_tokens: int, n_signs: int, n_chars: int) -> list[int]:
    """Of the file, whose tokens are of so many characters together."""
    share, mean = n_signs / max(1, n_tokens), n_chars / max(1, n_tokens)
    return [_bucket(f"signs={_steps(share, 0.05, 0.15, 0.3)}"), _bucket(f"mean={_steps(mean, 3, 5, 8, 14)}"), _bucket("file")]


def neighbours(signs: np.ndarray) -> dict[str, np.ndarray]:
    """For each role but the own, which token plays it at each place; -1 where none does. signs: tokens without a letter or digit."""
    n = len(signs)
    at = np.arange(n)
    last = np.maximum.accumulate(np.where(signs, -1, at)) if n else at
    word = np.concatenate([[-1], last[:-1]])[:n] if n else at
    word = np.where(at - word <= 5, word, -1)
    return {"next": at - 1, "after": np.where(at >= 2, at - 2, -1), "word": word, "before": np.where(at + 1 < n, at + 1, -1)}


def is_sign(token: str) -> bool:
    return len(token) == 1 and not token.isalnum()


# ---- the field


@dataclass
class Field:
    """weights: by bucket and tag (bucket 0 is none); moves: from a tag to the next one; ends: of the first and the last tag."""

    weights: np.ndarray
    moves: np.ndarray
    ends: np.ndarray

    @property
    def reach(self) -> float:
        """What one tag's moves can change at most."""
        every = np.concatenate([self.moves.ravel(), self.ends.ravel()])
        return 2 * float(every.max() - every.min())

    @property
    def calm(self) -> float:
        """What each move to, from or inside a secret loses at least against staying outside, as does beginning or ending in one; negative if one gains."""
        moves = self.moves[OUT, OUT] - np.delete(self.moves.ravel(), OUT).max()
        ends = (self.ends[:, :1] - self.ends[:, 1:]).min()
        return float(min(moves, ends))


def viterbi(scores: np.ndarray, moves: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[int]:
    """The best tags; of equal ones, those with the lower tag at the end."""
    best, back = (scores[0] + first).tolist(), []
    m, tags = moves.tolist(), range(scores.shape[1])
    for row in scores[1:].tolist():
        came = [max(tags, key=lambda a: best[a] + m[a][b]) for b in tags]
        best, _ = [best[came[b]] + m[came[b]][b] + row[b] for b in tags], back.append(came)
    at = max(tags, key=lambda b: best[b] + last[b])
    out = [at]
    for came in reversed(back):
        at = came[at]
        out.append(at)
    return out[::-1]


def decode(scores: np.ndarray, field: Field) -> np.ndarray:
    """The best tags of a whole text: tokens that are outside on every best path cut it.

    If staying outside is the best of all moves by ``calm``, a secret of k tokens loses k + 1 times as
    much by its moves: a stretch in which no run of tokens gains that by its scores is outside, too.
    """
    tags = np.zeros(len(scores), np.int8)
    gain = scores[:, 1:].max(1) - scores[:, OUT] if len(scores) else np.zeros(0)
    open_ = np.flatnonzero(gain >= -field.reach)
    if not len(open_):
        return tags
    starts = np.flatnonzero(np.diff(open_, prepend=-2) > 1)
    busy, calm = np.ones(len(starts), bool), field.calm
    if calm >= 0:
        total = np.cumsum(gain - calm)
        least = np.minimum.accumulate(np.concatenate([[0.0], total[:-1]]))
        busy = np.maximum.reduceat((total - least)[open_], starts) > calm - 1e-6  # more than sums are off
    stops = np.append(starts[1:], len(open_))
    for i in np.flatnonzero(busy).tolist():
        a, b = int(open_[starts[i]]), int(open_[stops[i] - 1]) + 1
        first = field.ends[0] if a == 0 else field.moves[OUT]
        last = field.ends[1] if b == len(scores) else field.moves[:, OUT]
        tags[a:b] = viterbi(scores[a:b], field.moves, first, last)
    return tags


class Tagger:
    """Tags texts by a field; what it knows of tokens it keeps."""

    def __init__(self, field: Field):
        self.field = field
        self._forget()

    def _forget(self):
        self.known: dict[str, int] = {}
        self.shares, self.signs = [np.zeros((1024, 3)) for _ in ROLES], np.zeros(1024, bool)

    def _learn(self, tokens: list[str]) -> None:
        """The shares of tokens not known yet."""
        w, at, n = self.field.weights, len(self.known), len(tokens)
        while at + n > len(self.signs):
            self.shares, self.signs = [np.concatenate([x, np.zeros_like(x)]) for x in self.shares], np.concatenate([self.signs, np.zeros_like(self.signs)])
        plain = list(map(is_plain, tokens))
        names = name_buckets([_crc(t.lower() if p else _word(t)) for t, p in zip(tokens, plain, strict=True)])
        for r in range(len(ROLES)):
            self.shares[r][at : at + n] = w[names[:, r]]
        sizes = np.fromiter(map(len, tokens), np.int64, n)
        own = w[_PLAIN_BUCKETS[np.searchsorted(_PLAIN_STEPS, sizes, side="right")]]
        for i in [i for i, p in enumerate(plain) if not p]:
            own[i] = w[own_buckets(tokens[i])].sum(0)
            self.signs[at + i] = is_sign(tokens[i])
        self.shares[0][at : at + n] += own
        self.known.update(zip(tokens, range(at, at + n), strict=True))

    def scores(self, text: str) -> np.ndarray:
        """By token and tag."""
        if len(self.known) > _KNOWN:
            self._forget()
        parts, n_chars, at = [], 0, 0
        while at < len(text):  # tokens of a very long text are never strings all at once
            end = len(text)
            if end - at > _CUT:
                gap = _SPACE.search(text, at + _CUT)
                end = gap.start() if gap else end
            tokens = TOKEN.findall(text, at, end)
            new = [t for t in dict.fromkeys(tokens) if t not in self.known]
            if new:
                self._learn(new)
            parts.append(np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens)))
            n_chars += sum(map(len, tokens))
            at = end
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        signs = self.signs[ids]
        own, next_, after, word, before = self.shares
        out = own.take(ids, 0) + self.field.weights[file_features(len(ids), int(signs.sum()), n_chars)].sum(0)
        out[1:] += next_.take(ids[:-1], 0)
        out[2:] += after.take(ids[:-2], 0)
        out[:-1] += before.take(ids[1:], 0)
        place = neighbours(signs)["word"]
        there = np.flatnonzero(place >= 0)
        out[there] += word.take(ids[place[there]], 0)
        return out

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Of secrets as tagged."""
        tags = decode(self.scores(text), self.field)
        if not tags.any():
            return []
        out, at = [], -2
        hits = set(np.flatnonzero(tags).tolist())
        for k, m in enumerate(TOKEN.finditer(text)):
            if k in hits:
                if tags[k] == IN and at == k - 1:
                    out[-1] = (out[-1][0], m.end())
                else:
                    out.append((m.start(), m.end()))
                at = k
        return out


def all_spans(text: str, tagger: Tagger) -> list[tuple[str, int, int]]:
    """The base's spans, and those tagged that don't lie within one of them."""
    base = base_spans(text)
    added = [("crf", a, b) for a, b in tagger.spans(text) if not any(s <= a and b <= e for _, s, e in base)]
    return in_order(base + added)


# ---- training


def _likelihood(scores: np.ndarray, size: np.ndarray, field: Field) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of tags by place, expected moves, and expected ends, of a batch of padded sequences."""
    n, width, k = scores.shape
    rows = np.arange(n)
    inside = np.arange(width)[None, :] < size[:, None]
    fwd, bwd = np.zeros_like(scores), np.zeros_like(scores)
    sums = lambda x, axis: np.log(np.exp(x - (top := x.max(axis, keepdims=True))).sum(axis)) + top.squeeze(axis)
    fwd[:, 0] = scores[:, 0] + field.ends[0]
    for t in range(1, width):
        fwd[:, t] = np.where(inside[:, t, None], sums(fwd[:, t - 1, :, None] + field.moves[None], 1) + scores[:, t], fwd[:, t - 1])
    bwd[rows, size - 1] = field.ends[1]
    for t in range(width - 2, -1, -1):
        went = sums(field.moves[None] + (scores[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
        bwd[:, t] = np.where((t < size - 1)[:, None], went, bwd[:, t])
    total = sums(fwd[rows, size - 1] + field.ends[1], 1)
    prob = np.exp(fwd + bwd - total[:, None, None]) * inside[:, :, None]
    pairs = fwd[:, :-1, :, None] + field.moves + (scores + bwd)[:, 1:, None, :] - total[:, None, None, None]
    pairs = np.where(inside[:, 1:, None, None], pairs, -np.inf)
    return prob, np.exp(pairs).sum((0, 1)), np.stack([prob[:, 0].sum(0), prob[rows, size - 1].sum(0)])


def fit(examples: list[tuple[list[list[int]], list[int]]], epochs: int = 10, batch: int = 256, rate: float = 0.25, decay: float = 2e-5, seed: int = 7) -> Field:
    """A field from ``(buckets by token, tags)``, by AdaGrad on the likelihood."""
    rng = np.random.default_rng(seed)
    field = Field(np.zeros((BUCKETS, 3)), np.zeros((3, 3)), np.zeros((2, 3)))
    power = [np.full_like(x, 1e-6) for x in (field.weights, field.moves, field.ends)]
    examples = sorted((e for e in examples if e[1]), key=lambda e: len(e[1]))
    lots = [examples[i : i + batch] for i in range(0, len(examples), batch)]
    packed = []
    for lot in lots:
        width, most = len(lot[-1][1]), max(len(f) for e in lot for f in e[0])
        ids, tags, size = np.zeros((len(lot), width, most), np.int64), np.zeros((len(lot), width), np.int64), np.array([len(e[1]) for e in lot])
        for r, (feats, want) in enumerate(lot):
            tags[r, : len(want)] = want
            for t, f in enumerate(feats):
                ids[r, t, : len(f)] = f
        packed.append((ids, tags, size))
    for _ in range(epochs):
        for k in rng.permutation(len(packed)):
            ids, tags, size = packed[k]
            n, width, most = ids.shape
            prob, pairs, ends = _likelihood(field.weights[ids].sum(2), size, field)
            inside = np.arange(width)[None, :] < size[:, None]
            one = np.eye(3)[tags] * inside[:, :, None]
            seen = np.zeros((3, 3))
            np.add.at(seen, (tags[:, :-1][inside[:, 1:]], tags[:, 1:][inside[:, 1:]]), 1)
            gap = np.repeat((one - prob).reshape(-1, 3), most, 0)
            grad = np.stack([np.bincount(ids.ravel(), gap[:, c], BUCKETS) for c in range(3)], 1) / n - decay * field.weights
            grad[0] = 0
            own_ends = np.stack([one[:, 0].sum(0), one[np.arange(n), size - 1].sum(0)])
            for x, g, p in zip((field.weights, field.moves, field.ends), (grad, (seen - pairs) / n - decay * field.moves, (own_ends - ends) / n - decay * field.ends), power, strict=True):
                p += g * g
                x += rate * g / np.sqrt(p)
    return field


def example(text: str, secrets: list[tuple[int, int]], about: list[int] | None = None) -> tuple[list[list[int]], list[int]]:
    """Features and tags of a text's tokens. about: the features of the file it is from, if it is a part of one."""
    found = list(TOKEN.finditer(text))
    tokens = [m.group() for m in found]
    if about is None:
        about = file_features(len(tokens), sum(map(is_sign, tokens)), sum(map(len, tokens)))
    names = name_buckets([name_of(t) for t in tokens]).tolist()
    own = {t: own_buckets(t) for t in set(tokens)}
    near = neighbours(np.array([is_sign(t) for t in tokens], bool))
    feats, tags, owner = [], [], None
    for i, m in enumerate(found):
        mine = own[tokens[i]] + names[i][:1] + about
        for r, role in enumerate(ROLES[1:], 1):
            j = int(near[role][i])
            if j >= 0:
                mine = mine + [names[j][r]]
        feats.append(mine)
        inside = next((s for s in secrets if s[0] <= m.start() and m.end() <= s[1]), None)
        tags.append(OUT if inside is None else IN if inside == owner else BEGIN)
        owner = inside
    return feats, tags


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ALNUM = _LOWER + _UPPER + _DIGITS


def _secret(r: random.Random) -> str:
    """A made-up credential in one of the public formats."""
    some = lambda letters, a, b=None: "".join(r.choice(letters) for _ in range(r.randint(a, b or a)))
    hexes = r.choice(["0123456789abcdef", "0123456789ABCDEF"])
    return r.choice([
        lambda: r.choice(["AKIA", "ASIA"]) + some(_UPPER + _DIGITS, 16), lambda: some(_ALNUM + "+/", 40), lambda: r.choice(["ghp_", "gho_", "ghs_"]) + some(_ALNUM, 36), lambda: "xoxb-" + some(_DIGITS, 11) + "-" + some(_ALNUM, 24),
        lambda: "AIza" + some(_ALNUM + "_-", 35), lambda: r.choice(["sk_live_", "rk_live_", "sk-"]) + some(_ALNUM, 24, 48), lambda: "eyJ" + some(_ALNUM, 20, 40) + "." + "eyJ" + some(_ALNUM, 30, 80) + "." + some(_ALNUM + "_-", 43),
        lambda: some(hexes, r.choice([32, 40, 64])), lambda: some(hexes, r.choice([32, 40, 64])), lambda: some(_ALNUM, 16, 40), lambda: some(_ALNUM, 20, 60) + "==", lambda: some(_ALNUM, 6, 10) + r.choice("!@#$%^&*") + some(_ALNUM, 3, 8), lambda: r.choice(["glpat-", "npm_", "SG.", "pypi-"]) + some(_ALNUM + "_-", 20, 50),
    ])()


def _harmless(r: random.Random) -> str:
    """What only looks like a credential."""
    some = lambda letters, a, b=None: "".join(r.choice(letters) for _ in range(r.randint(a, b or a)))
    hexes = "0123456789abcdef"
    word = lambda: some("aeiou" + "bcdfghlmnprst", 3, 9)
    h = lambda n: some(hexes, n)
    return r.choice([
        lambda: f"{r.choice(['commit', 'Merge', 'revision', 'Reverts', 'tree', 'parent'])} {h(r.choice([7, 12, 40]))}", lambda: f"{r.choice(['md5', 'sha1', 'sha256', 'checksum', 'digest', 'ETag', 'integrity'])}{r.choice([': ', '=', ' '])}{h(r.choice([32, 40, 64]))}",
        lambda: f"{r.choice(['id', 'uuid', 'request', 'trace'])}{r.choice(['=', ': ', ' '])}{h(8)}-{h(4)}-{h(4)}-{h(4)}-{h(12)}", lambda: some(_DIGITS, 16), lambda: f"{some(_DIGITS, 1, 3)}.{some(_DIGITS, 1, 3)}.{some(_DIGITS, 1, 3)}.{some(_DIGITS, 1, 3)}",
        lambda: f"{word()}@{word()}{some(_DIGITS, 0, 2)}.example.com", lambda: f"https://{word()}.example.org/{word()}/{word()}-{some(_DIGITS, 3, 8)}?{word()}={some(_DIGITS, 2, 6)}", lambda: f"{r.choice('vV')}{some(_DIGITS, 1)}.{some(_DIGITS, 1, 2)}.{some(_DIGITS, 1, 3)}",
        lambda: f"{r.choice(['password', 'token', 'secret', 'api_key'])} {r.choice(['=', ':'])} {r.choice(['os.environ', 'get_token()', 'None', 'null', '<your-key>', 'self._token', 'config.secret', 'changeme', '********', 'xxxxxxxx', 'str', 'input()', '${TOKEN}', 'required'])}",
        lambda: f"{word()}{word().title()}{word().title()}", lambda: f"{word()}_{word()}_{word()}({word()})", lambda: f"data:image/png;base64,iVBORw0KGgo{some(_ALNUM + '+/', 40, 120)}", lambda: f"{word()} {r.choice(['was', 'forgot the', 'reset your', 'a new', 'the'])} {r.choice(['password', 'token', 'secret'])} {word()}",
        lambda: f"+{some(_DIGITS, 2)} {some(_DIGITS, 3)} {some(_DIGITS, 7)}", lambda: f"{some(_DIGITS, 4)}-{some(_DIGITS, 2)}-{some(_DIGITS, 2)}T{some(_DIGITS, 2)}:{some(_DIGITS, 2)}:{some(_DIGITS, 2)}Z", lambda: some(_UPPER, 12, 24), lambda: f"{some(_UPPER, 2)}{some(_DIGITS, 20)}", lambda: f"{word()}.{some(_DIGITS, 2)}", lambda: " ".join([some(_UPPER, 1, 2) + some(_LOWER, 2, 5)] * r.randint(2, 9)),
    ])()


def made_up(n: int = 3_000, seed: int = 11) -> list[tuple[list[list[int]], list[int]]]:
    """Lines of code, settings and prose, some with a secret and all with things that aren't one."""
    r, out = random.Random(seed), []
    word = lambda: "".join(r.choice("aeiou" + "bcdfghlmnprstéüñß") for _ in range(r.randint(2, 9)))
    prose = lambda: " ".join(word() for _ in range(r.randint(0, 6)))
    keys = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "auth_token", "access_token", "client_secret", "secret_key", "private_key", "credential", "AWS_SECRET_ACCESS_KEY", "DB_PASSWORD", "Passwort", "contraseña", "clave", "mot de passe", "jeton"]
    for _ in range(n):
        parts, secrets, at = [], [], 0
        for _ in range(r.randint(1, 4)):
            before, after = prose(), prose()
            if r.random() < 0.5:
                lead, value, end = "", _harmless(r), ""
                marked = False
            else:
                quote, key, value = r.choice(['"', "'", ""]), r.choice(keys), _secret(r)
                key = r.choice([key, key.upper(), key + "_" + r.choice(["prod", "id"])])
                lead, end = r.choice([(f"{key} = {quote}", quote), (f"{key}={quote}", quote), (f"{quote}{key}{quote}: {quote}", quote), (f"export {key}={quote}", quote), ("Authorization: Bearer ", ""), (f"--{key} ", ""), (f"postgres://{word()}:", f"@{word()}.example.com/{word()}"), (f"{key}: ", ""), (f"{word()} {key} {r.choice(['is', 'ist', 'es', 'est'])} ", ".")])
                marked = True
            text = " ".join(x for x in [before, lead + value + end, after] if x) + r.choice(["\n", " ", "; "])
            if marked:
                s = at + (len(before) + 1 if before else 0) + len(lead)
                secrets.append((s, s + len(value)))
            parts.append(text)
            at += len(text)
        out.append(example("".join(parts), secrets))
    return out


@dataclass
class Window:
    """A part of a document, where its secrets are, and the features of the whole document."""

    text: str
    secrets: list[tuple[int, int]]
    about: list[int]


def windows(text: str, most: int = WINDOWS, width: int = WIDTH) -> list[Window]:
    """Parts of a document with what the patterns find; those with a hexadecimal run that isn't all digits and has no key are left out, as nothing says what it is."""
    base = base_spans(text)
    sure = [(s, e) for k, s, e in base if k != "hex"]
    values = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12] + [(s, e) for k, s, e in base if k == "access"]
    doubt = [(s, e) for k, s, e in base if k == "hex" and not text[s:e].isdigit() and not any(a <= s and e <= b for a, b in sure)]
    found = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    about = file_features(len(found), sum(b - a == 1 and is_sign(text[a]) for a, b in found), sum(b - a for a, b in found))
    parts = [(found[k][0], found[min(k + width, len(found)) - 1][1]) for k in range(0, len(found), width)]
    with_secret = [p for p in parts if any(p[0] <= s < p[1] for s, _ in values)]
    rest = sorted(set(parts) - set(with_secret))
    picked = with_secret[: most // 2] + rest[:: max(1, len(rest) // max(1, most // 2))][: most - most // 2]
    return [Window(text[a:b], [(s - a, e - a) for s, e in values if a <= s and e <= b], about) for a, b in picked if not any(a < e and s < b for s, e in doubt)]


_WINDOWS = "windows array<struct<text:string,secrets:array<array<int>>,about:array<int>>>"


def train(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """A field from made-up lines and windows of at most ``sample`` documents, which their texts' hashes choose; repeated texts count once."""
    count = docs.count()
    at = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    chosen = docs.where("text <> ''").select("text", at.alias("at")).where(F.col("at") < min(1.0, 1.5 * sample / max(1, count)) * (1 << 30))
    as_rows = lambda texts: [[[{"text": w.text, "secrets": w.secrets, "about": w.about} for w in windows(t)] for t in texts]]
    rows = map_texts(chosen, "text", ["at"], _WINDOWS, lambda: as_rows).dropDuplicates(["at"]).orderBy("at").limit(sample).collect() if count else []
    return fit(made_up() + [example(w["text"], [tuple(s) for s in w["secrets"]], w["about"]) for r in rows for w in r["windows"]])


def find_secrets(docs: DataFrame, field: Field, carry: list[str], text: str = "text") -> DataFrame:
    """``carry`` and ``spans array<struct<kind, start, end>>``, in order of start and kind."""
    if "spans" in carry:
        raise ValueError("a carried column is called spans")
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def make():
        # a worker's later tasks know the tokens of its earlier ones
        tagger = sent.value.__dict__.setdefault("tagger", None) or Tagger(sent.value)
        sent.value.__dict__["tagger"] = tagger
        of = lambda t: [{"kind": k, "start": a, "end": b} for k, a, b in all_spans(t, tagger)]
        return lambda texts: [[of(t or "") for t in texts]]

    return map_texts(docs, text, carry, "spans array<struct<kind:string,start:int,end:int>>", make)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base's kinds, the digest of its spans, and all spans as text."""
    said = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def secret_scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` of all ``documents``."""
    return digest(find_secrets(docs, train(docs.select("text")), ["doc_id"]))
