"""Toxicity by a support vector machine with a subsequence string kernel and Nystroem landmarks.

The kernel of two words sums, over all common subsequences of ``order`` characters, a decay
to the power of the lengths they span in either word (Lodhi et al., "Text Classification
using String Kernels", 2002), and is normalised to 1 for equal words. Words with inserted
or missing characters, or with other endings, thus stay close to each other. A word is
described by its kernel with a fixed number of landmark words, whitened by the inverse
root of the landmarks' own kernel matrix (Nystroem); a linear machine with squared hinge
loss works on that.

Labels are for documents, and an insult makes a document toxic: the machine learns from words. Its first positive examples are words that together account for the toxic documents
and are rare in clean ones, words whose share of toxic documents is beyond chance, and, for the
documents that plain insults don't account for, words with a beginning of which that is true; its negative examples are words of clean documents; in each round of training, the worst words of
toxic documents and the clean words that it takes for insults join them. A document's score
comes from its worst words: one plain insult, or several doubtful ones; words that are
common in clean documents, and not more so in toxic ones, don't count. Logistic calibration
on the training documents makes it a probability.

Words are runs of non-space characters, in lower case, without ASCII digits and signs; three or
more one-letter words in a row are one word. A word with digits or signs that stand for letters
is also read with those letters. A word of one letter has the mark for a beginning on either
side, so that it has a subsequence too. A word of over
``WIDTH`` letters is read in overlapping windows of that width. Whole texts are read.

Training uses at most ``sample`` labelled documents, taken by hashed id, and of their texts at
most about ``sample_chars`` characters: beyond that the sample is taken smaller. The model is of
fixed size (landmarks and their weights) and goes to the tasks, which remember the scores
of words they have met. Its subsequences are a table of at most landmarks times 680 entries,
whatever the number of letters.

Null and empty texts, and texts without a letter, get the score of the least toxic word.
With no labels of one of the two kinds, every score is 0. Documents with several labels
are toxic if one says so; null labels teach nothing. Repeated rows get equal results.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush, nlargest
from itertools import combinations
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from cairn.llm.batches import map_texts

WIDTH = 16
#: Stands before a word's first letter, so that subsequences tell a beginning from the rest of a word.
START = "^"
#: Deleted from texts: ASCII other than letters and white space. The kernel bridges any other sign inside a word.
_DELETE = bytes(i for i in range(128) if not chr(i).isalpha() and not chr(i).isspace())
_DISGUISED = re.compile(r"(?<!\S)(?=\S*[^\W\d_])\S*[013457@$]\S*")
_SPELLED = re.compile(r"(?<!\S)\w(?:\s+\w){2,}(?!\S)")
#: A document is judged by so many of its worst words: one plain insult is enough, and so are several doubtful ones.
WORST = 3
_REMEMBER = 1 << 19
_SLICE = 500


#: Digits and signs that are written for letters.
_LEET = str.maketrans("013457@$", "oieastas")


def units(text: str | None) -> set[str]:
    """The distinct words of a text that the kernel compares, each after a mark for its beginning."""
    if not text:
        return set()
    lower = text.lower()
    low = lower.encode("utf-8", "surrogatepass").translate(None, _DELETE).decode("utf-8", "surrogatepass")
    found = set(low.split())
    if sum(len(w) == 1 for w in found) > 1:
        found.update("".join(m[0].split()) for m in _SPELLED.finditer(low))
    for w in set(_DISGUISED.findall(lower)):
        found.add(w.translate(_LEET).encode("utf-8", "surrogatepass").translate(None, _DELETE).decode("utf-8", "surrogatepass"))
    found.discard("")
    long = [w for w in found if len(w) > WIDTH]
    found.difference_update(long)
    marked = {START + w if len(w) > 1 else START + w + START for w in found}
    for w in long:
        marked.add(START + w[:WIDTH])
        marked.update(w[i : i + WIDTH] for i in range(WIDTH // 2, len(w) - WIDTH // 2, WIDTH // 2))
    return marked


def _codes(words: list[str], width: int) -> np.ndarray:
    """Characters as numbers, 0 beyond a word's end."""
    flat = "".join(w.ljust(width, "\0") for w in words)
    return np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), width)


def raw_kernel(a: list[str], b: list[str], order: int = 3, decay: float = 0.6) -> np.ndarray:
    """The gap-weighted subsequence kernel of all words of a with all of b, by dynamic programming over positions of a."""
    wa, wb = max(map(len, a), default=1), max(map(len, b), default=1)
    x, y = _codes(a, wa), _codes(b, wb)
    # run[j, k]: what a position j of b passes on to a later position k, by the decay of the gap
    gap = np.arange(wb)[None, :] - np.arange(wb)[:, None]
    run = np.where(gap >= 0, decay ** np.maximum(gap, 0), 0.0).astype(np.float32)
    square = np.float32(decay * decay)
    total = np.zeros((len(a), len(b)), np.float32)
    # level[q][u, v, j]: weight of common subsequences of length q + 1 that end before this position of a, and at or before j of b
    level = [np.zeros((len(a), len(b), wb), np.float32) for _ in range(order - 1)]
    for i in range(wa):
        same = (x[:, i][:, None, None] == y[None]) & (x[:, i] != 0)[:, None, None]
        same = same.astype(np.float32) * square
        # longest first, so that a level still has what ends before this position
        grown = []
        for q in range(order):
            if q == 0:
                ends = same
            else:
                before = np.zeros_like(same)
                before[:, :, 1:] = level[q - 1][:, :, :-1]
                ends = same * before
            grown.append(ends)
        total += grown[-1].sum(2)
        for q in range(order - 1):
            level[q] *= np.float32(decay)
            level[q] += grown[q] @ run
    return total


def _own(words: list[str], order: int, decay: float) -> np.ndarray:
    out = np.zeros(len(words), np.float32)
    for i, w in enumerate(words):
        out[i] = raw_kernel([w], [w], order, decay)[0, 0]
    return out


class Machine:
    """Landmarks, their weights and the calibration: scores words and texts."""

    def __init__(self, landmarks: list[str], order: int = 3, decay: float = 0.6):
        self.landmarks, self.order, self.decay = landmarks, order, decay
        self.root = np.sqrt(_own(landmarks, order, decay)) if landmarks else np.zeros(0, np.float32)
        if landmarks:
            k = self.kernel(landmarks)
            values, vectors = np.linalg.eigh(k.astype(np.float64))
            keep = values > 1e-4
            self.white = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
        self.weights, self.bias, self.scale, self.shift = np.zeros(len(landmarks), np.float32), np.float32(-1), np.ones(WORST) / WORST, 0.0
        self.common: frozenset[str] = frozenset()
        self._known: dict[str, float] = {}

    def kernel(self, words: list[str]) -> np.ndarray:
        """The normalised kernel with each landmark."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for idx in by_length.values():
            for at in range(0, len(idx), 512):
                some = idx[at : at + 512]
                own = [words[i] for i in some]
                out[some] = raw_kernel(own, self.landmarks, self.order, self.decay) / self._norms(own)[:, None] / self.root[None]
        return out

    def _norms(self, words: list[str]) -> np.ndarray:
        """Root of each word's kernel with itself; the words are of one length."""
        n = len(words[0])
        x = _codes(words, n)
        gap = np.arange(n)[None, :] - np.arange(n)[:, None]
        run = np.where(gap >= 0, self.decay ** np.maximum(gap, 0), 0.0).astype(np.float32)
        total = np.zeros(len(words), np.float32)
        level = [np.zeros((len(words), n), np.float32) for _ in range(self.order - 1)]
        for i in range(n):
            same = (x[:, i][:, None] == x).astype(np.float32) * np.float32(self.decay**2)
            grown = [same]
            for q in range(1, self.order):
                before = np.zeros_like(same)
                before[:, 1:] = level[q - 1][:, :-1]
                grown.append(same * before)
            total += grown[-1].sum(1)
            for q in range(self.order - 1):
                level[q] = level[q] * np.float32(self.decay) + grown[q] @ run
        return np.sqrt(total)

    def fold(self) -> None:
        """The decision as one weight per subsequence.

        A decision is linear in the kernels with the landmarks, and a kernel is the dot product of
        two words' weighted subsequences; so all landmarks together are one weight for each
        subsequence that one of them has, and a word needs a sum over its own subsequences only.
        """
        letters = sorted({ord(c) for c in "".join(self.landmarks)})
        self.letters = np.array(letters, np.uint32)
        base = len(letters) + 1
        number = {c: i + 1 for i, c in enumerate(letters)}
        table: dict[int, float] = {}
        for word, weight, root in zip(self.landmarks, self.weights, self.root, strict=True):
            x = [number[ord(c)] for c in word]
            for places in combinations(range(len(x)), self.order):
                at = 0
                for i in places:
                    at = at * base + x[i]
                table[at] = table.get(at, 0.0) + weight / root * self.decay ** (places[-1] - places[0] + 1)
        self.base, self.places = base, np.array(sorted(table), np.int64)
        self.values = np.array([table[at] for at in self.places.tolist()], np.float32)
        self.spans = {n: np.array(list(combinations(range(n), self.order))).T for n in range(self.order, WIDTH + 2)}
        self.spans = {n: (at, (self.decay ** (at[-1] - at[0] + 1)).astype(np.float32)) for n, at in self.spans.items()}
        # few letters: the table is laid out in full, which is faster to read; the entries are the same
        self.full = None
        if base**self.order <= 1 << 20:
            self.full = np.zeros(base**self.order, np.float32)
            self.full[self.places] = self.values
        self._known = {}

    def _numbers(self, codes: np.ndarray) -> np.ndarray:
        """Letters by their number among those of the landmarks; 0 for all others, of any plane."""
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[at] == codes, at + 1, 0)

    def _weights_at(self, places: np.ndarray) -> np.ndarray:
        if self.full is not None:
            return self.full[places]
        at = np.minimum(np.searchsorted(self.places, places), len(self.places) - 1)
        return np.where(self.places[at] == places, self.values[at], np.float32(0))

    def decide(self, words: list[str]) -> np.ndarray:
        """The machine's decision on each word: above 0 is toxic."""
        out = np.full(len(words), self.bias, np.float32)
        if not len(self.places):
            return out
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        for n, idx in by_length.items():
            if n < self.order:
                continue
            at, weight = self.spans[n]
            for cut in range(0, len(idx), 2048):
                some = idx[cut : cut + 2048]
                own = [words[i] for i in some]
                x = self._numbers(_codes(own, n))
                place = x[:, at[0]]
                for level in at[1:]:
                    place = place * self.base + x[:, level]
                out[some] += self._weights_at(place) @ weight / self._norms(own)
        return out

    def judge(self, words: list[str]) -> np.ndarray:
        """``decide``, but for words that clean documents commonly have: these are like no landmark."""
        out = self.decide(words)
        out[[i for i, w in enumerate(words) if w in self.common]] = min(self.bias, np.float32(-1))
        return out

    def fit(self, kernels: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> None:
        """Squared hinge loss with an L2 penalty, both classes weighing the same, by Newton's method."""
        z = np.hstack([kernels @ self.white, np.ones((len(kernels), 1), np.float32)]).astype(np.float64)
        sign = np.where(y, 1.0, -1.0)
        share = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum()))
        w = np.zeros(z.shape[1])
        penalty = ridge * np.eye(len(w))
        penalty[-1, -1] = 1e-9
        for _ in range(rounds):
            active = sign * (z @ w) < 1
            za = z[active] * share[active][:, None]
            new = np.linalg.solve(za.T @ z[active] + penalty, za.T @ sign[active])
            if np.allclose(new, w, atol=1e-9):
                break
            w = new
        self.weights, self.bias = (self.white @ w[:-1]).astype(np.float32), np.float32(w[-1])
        self.fold()

    def calibrate(self, worst: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling of documents' ``WORST`` highest decisions, with smoothed targets; a higher decision never lowers a score."""
        hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((~y).sum() + 2)
        target = np.where(y, hi, lo)
        free = list(range(WORST))
        while True:
            x = np.column_stack([worst[:, free], np.ones(len(worst))]).astype(np.float64)
            w, ridge = np.append(np.ones(len(free)), 0.0), 1e-2 * np.eye(len(free) + 1)
            for _ in range(60):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                w = w - np.clip(np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - target) + ridge @ w), -2, 2)
            kept = [f for f, v in zip(free, w, strict=False) if v > 0]
            if len(kept) == len(free) or not kept:
                break
            free = kept
        self.scale = np.zeros(WORST)
        self.scale[free] = np.maximum(w[:-1], 1e-3)
        self.shift = float(w[-1])

    def highest(self, decisions: list[float]) -> list[float]:
        """The ``WORST`` highest decisions on a text's words; where there are fewer, that on a word unlike all landmarks."""
        return nlargest(WORST, [*decisions, *[float(self.bias)] * WORST])

    def worst(self, texts: list) -> np.ndarray:
        """``highest`` for each text."""
        out = np.zeros((len(texts), WORST))
        for at in range(0, len(texts), _SLICE):
            sets = [units(t) for t in texts[at : at + _SLICE]]
            new = list(set().union(*sets) - self._known.keys())
            if len(self._known) + len(new) > _REMEMBER:
                self._known, new = {}, list(set().union(*sets))
            self._known.update(zip(new, self.judge(new).tolist(), strict=True))
            known = self._known
            out[at : at + len(sets)] = [self.highest(list(map(known.__getitem__, s))) for s in sets]
        return out

    def score(self, texts: list) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.worst(texts) @ self.scale + self.shift, -30, 30)))


#: A word whose log odds of standing in a toxic document are above this may be an insult.
TELLING = 1.5


#: A word with log odds above this, in this share of the toxic documents, is an insult whatever else accounts for them.
CERTAIN, COMMON = 3.0, 0.05


#: So is a word whose share of toxic documents differs from the sample's with a log-likelihood ratio above this; chance alone does this for one word in 50,000.
BEYOND_CHANCE = 18.0


#: At most so many words of clean documents are known for what they are, whatever landmarks they look like.
KNOWN = 4096


def _surprise(k: int, other: int, base: float) -> float:
    """The log-likelihood ratio (G squared) of a word with k toxic and ``other`` clean documents against the share ``base``."""
    n = k + other
    return 2 * (k * np.log(k / n / base) + (other * np.log(other / n / (1 - base)) if other else 0.0))


def _sketch(words: set[str]) -> tuple[int, ...]:
    """Equal for copies and most near copies: the two least hashes of the words."""
    return tuple(sorted(crc32(w.encode("utf-8", "surrogatepass")) for w in words)[:2])


def _apart(docs: list[set[str]]) -> list[set[str]]:
    """The documents without copies and near copies of those before."""
    return list({_sketch(w): w for w in reversed(docs)}.values())


def _counts(docs: list[set[str]]) -> dict[str, int]:
    out: dict[str, int] = {}
    for words in docs:
        for w in words:
            out[w] = out.get(w, 0) + 1
    return out


def _cover(docs: list[set[str]], odds: dict[str, float], least: int = 2) -> list[str]:
    """Words that account for the documents: again and again the one in most documents that none before is in, while that is ``least`` or more."""
    left = [{w for w in words if odds[w] > TELLING} for words in docs]
    where: dict[str, set[int]] = {}
    for i, words in enumerate(left):
        for w in words:
            where.setdefault(w, set()).add(i)
    heap = [(-len(at), w) for w, at in where.items()]
    heapify(heap)
    chosen, done = [], set()
    while heap:
        size, w = heappop(heap)
        new = where[w] - done
        if len(new) < -size:  # some were accounted for meanwhile
            if len(new) >= least:
                heappush(heap, (-len(new), w))
            continue
        if len(new) < least:
            break
        chosen.append(w)
        done |= new
    return chosen


#: Letters of a word's beginning that may tell a family of insults, and how many words of a family are examples.
STEM, KIN = range(4, 9), 16


def _stems(words: set[str]) -> set[str]:
    """The beginnings, mark and all, of the words."""
    return {w[: k + 1] for w in words if w[0] == START for k in STEM if len(w) > k}


def _families(toxic_docs: list[set[str]], clean_docs: list[set[str]]) -> list[str]:
    """Beginnings that account for toxic documents beyond chance: insults that are seldom twice the same word."""
    toxic, clean = [_stems(t) for t in toxic_docs], [_stems(t) for t in clean_docs]
    hits, misses = _counts(toxic), _counts(clean)
    base = len(toxic) / max(1, len(toxic) + len(clean))
    odds = {w: float(np.log((k + 0.5) / (len(toxic) + 2)) - np.log((misses.get(w, 0) + 0.5) / (len(clean) + 2))) for w, k in hits.items()}
    sure = {w: v for w, v in odds.items() if v > TELLING and _surprise(hits[w], misses.get(w, 0), base) > BEYOND_CHANCE}
    return _cover([t & sure.keys() for t in toxic], sure)


def _variants(words: list[str], rng: np.random.Generator, each: int = 6) -> list[str]:
    """Words of five letters or more with a letter put in between, or one left out."""
    letters = sorted(set("".join(words)) - {START})
    out = []
    for w in words:
        for k in range(each if len(w) >= 6 else 0):
            at = int(rng.integers(2, len(w) - 1))
            out.append(w[:at] + w[at + 1 :] if k == 0 and len(w) > 6 else w[:at] + letters[rng.integers(len(letters))] + w[at:])
    return [w[: WIDTH + 1] for w in dict.fromkeys(out) if w not in words]


#: Positive landmarks are less alike than this.
ALIKE = 0.45


def _landmarks(positive: list[str], negative: list[str], count: int) -> list[str]:
    """Distinct landmarks: half of them positive words, the first that are unlike each other, the others negative words."""
    ranked = positive[: 20 * count]
    chosen: list[str] = []
    if ranked:
        probe = Machine(ranked)
        alike = probe.kernel(ranked)
        near = np.zeros(len(ranked), np.float32)
        for i in range(len(ranked)):
            if near[i] < ALIKE:
                chosen.append(ranked[i])
                near = np.maximum(near, alike[:, i])
            if len(chosen) >= count // 2:
                break
    rest = [w for w in dict.fromkeys(negative) if w not in chosen]
    return chosen + rest[: count - len(chosen)]


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, sample_chars: int = 100_000_000, landmarks: int = 128, rounds: int = 3, examples: int = 3000) -> Machine | None:
    """A machine from at most about ``sample`` labelled documents and ``sample_chars`` characters, half of each kind if there are as many."""
    marked = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}  # two rows
    if not sizes.get(0) or not sizes.get(1):
        return None
    share = {t: min(1.0, sample / 2 / n) for t, n in sizes.items()}
    cut = F.when(F.col("toxic") == 1, int(share[1] * (1 << 30))).otherwise(int(share[0] * (1 << 30)))
    # the sampled ids are few by the bound, and go to the documents; no text is shuffled to meet them
    chosen = F.broadcast(marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < cut).limit(2 * sample))
    found = docs.where("text is not null").select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", "toxic")
    chars = found.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > sample_chars:
        found = found.where(F.pmod(F.xxhash64("doc_id", F.lit("fewer")), F.lit(1 << 30)) < int(sample_chars / chars * (1 << 30)))
    rows = found.orderBy("doc_id", "text").limit(2 * sample).collect()  # bounded in rows and characters
    return learn([r["text"] for r in rows], np.array([r["toxic"] == 1 for r in rows], bool), landmarks, rounds, examples)


def learn(docs: list[str], y: np.ndarray, landmarks: int = 128, rounds: int = 3, examples: int = 3000) -> Machine | None:
    """A machine from the texts of the sample and whether each is toxic."""
    if not y.any() or y.all():
        return None
    texts = [units(t) for t in docs]
    rng = np.random.default_rng(3)
    toxic_docs = _apart([t for t, toxic in zip(texts, y, strict=True) if toxic])
    clean_docs = _apart([t for t, toxic in zip(texts, y, strict=True) if not toxic])
    hits, misses = _counts(toxic_docs), _counts(clean_docs)
    odds = {w: float(np.log((k + 0.5) / (len(toxic_docs) + 2)) - np.log((misses.get(w, 0) + 0.5) / (len(clean_docs) + 2))) for w, k in hits.items()}
    told = {w for w, k in hits.items() if odds[w] > CERTAIN and k >= COMMON * len(toxic_docs)} | set(_cover(toxic_docs, odds))
    base = len(toxic_docs) / (len(toxic_docs) + len(clean_docs))
    told |= {w for w, k in hits.items() if odds[w] > TELLING and _surprise(k, misses.get(w, 0), base) > BEYOND_CHANCE}
    plain = {w for w in told if odds[w] > CERTAIN and hits[w] >= COMMON * len(toxic_docs)}
    for stem in _families([t for t in toxic_docs if not t & plain], clean_docs):
        told.update(sorted((w for w in hits if w.startswith(stem) and odds[w] > 0), key=lambda w: (-hits[w], w))[:KIN])
    told = sorted(told, key=lambda w: (-hits[w], w))[:examples]
    insult = {w for w, v in odds.items() if v > TELLING}
    clean = sorted(misses.keys() - insult)
    negative = [clean[i] for i in rng.permutation(len(clean))[:examples]]
    if not told:
        return None
    machine = Machine(_landmarks(told, negative, landmarks))
    # misspelt insults are insults, unless clean documents have them
    variants = [w for w in _variants(told[: landmarks // 4], rng) if w not in misses]
    every = sorted(set().union(variants, *texts))
    place = {w: i for i, w in enumerate(every)}
    idx = [np.array([place[w] for w in sorted(t)], np.int64) for t in texts]
    clean_at = np.array([place[w] for w in clean], np.int64)
    hard = {place[w] for w in negative}
    pos = sorted(place[w] for w in [*told, *variants])
    for _ in range(rounds):
        at = np.array([*pos, *sorted(hard)], np.int64)
        machine.fit(machine.kernel([every[i] for i in at]), np.arange(len(at)) < len(pos))
        f = machine.decide(every)
        # the worst word of each toxic document joins the examples, if it may be an insult
        worst = {int(i[np.argmax(f[i])]) for i, t in zip(idx, y, strict=True) if t and len(i)}
        pos = sorted(set(pos) | {i for i in worst if every[i] in insult and f[i] > 0})
        wrong = clean_at[f[clean_at] > -0.5]
        hard |= set(wrong[np.argsort(-f[wrong], kind="stable")][:examples].tolist())
    known = sorted((w for w, k in misses.items() if k >= 3 and odds.get(w, -1.0) <= 0), key=lambda w: (-misses[w], w))
    machine.common = frozenset(known[:KNOWN])
    f = machine.judge(every)
    machine.calibrate(np.array([machine.highest(f[i].tolist()) for i in idx]), y)
    return machine


def score_documents(docs: DataFrame, machine: Machine | None, carry: list[str] | None = None) -> DataFrame:
    """The columns of ``carry`` (default: doc_id) and ``score``, from 0 to 1."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # landmarks, weights and at most 87,040 subsequences: under 6 MB

    def make():
        return lambda texts: [sent.value.score(texts) if sent.value is not None else np.zeros(len(texts))]

    return map_texts(docs, "text", carry or ["doc_id"], "score double", make)


def held_out(doc_id: Column) -> Column:
    """The documents whose labels the registered query doesn't learn from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0
