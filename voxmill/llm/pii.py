"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds to them.

The network reads windows of 64 characters at a stride of 32. The emissions of windows that overlap are averaged, each
weighed by the character's distance from the window's edge, and one Viterbi pass with the CRF's transitions then decodes the
whole text. A window without a digit or "@" is outside every span by definition, since each of the four kinds has one in
it, so there the tags are fixed and the network is not run. The tags' spans count as they are, under three conditions that are no
patterns: the path through the span is better by `LEAST_MARGIN` than the one that stays outside, the kind's arithmetic holds (parts of an
address at most 255, a card's check digit, the number of digits), and the span does not overlap one that a pattern accepted.
It may overlap what a pattern matched and then dropped. Spans of the patterns always stay.

Training is in numpy, by back-propagation through both directions and the CRF likelihood, on spans that a generator
writes into invented prose with its labels: e-mail addresses, IP addresses, card and phone numbers in many layouts, alone and
side by side, and look-alikes (versions, dates, hexadecimal tokens, order numbers, words) that are none. The fitted weights are a
file beside this module, written by `python -m voxmill.llm.pii`; `trained(fresh=True)` fits them anew.

Defined results: a null text counts as empty; a text without spans has an empty list. Each row has its own result, so
repeated rows have equal ones. Spans are code points, end exclusive, by start and then by kind as listed in KINDS.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.common import chunks, clean_documents

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 64, 32

# ---- patterns

TRIGGER = re.compile("[0-9@]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def good_ip(s: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in s.split("."))


def good_card(s: str) -> bool:
    d = digits_of(s)
    return 14 <= len(d) <= 19 and luhn(d)


def good_phone(s: str) -> bool:
    return 10 <= len(digits_of(s)) <= 15


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, stop) of the patterns: leftmost, non-overlapping within a kind, failing matches dropped without a retry."""
    out, end = [], 0
    for m in DOMAIN.finditer(text):  # equal to the whole pattern: its local part is the run of such characters before the @
        a = m.start()
        while a > end and text[a - 1] in LOCAL:
            a -= 1
        if a < m.start():
            out.append((a, 0, m.end()))
            end = m.end()
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if good_ip(m[0])]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if good_card(m[0])]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if good_phone(m[0])]
    return sorted(out)


# ---- checks of added spans

#: What the path through a span has to be better by (log likelihood) than one outside it.
LEAST_MARGIN = 4.0


def plausible(kind: int, s: str) -> bool:
    """The arithmetic of a kind: no layout is asked for."""
    n = len(digits_of(s))
    if kind == 1:
        parts = [digits_of(x) for x in s.split(".")]
        return len(parts) == 4 and all(p and int(p) <= 255 for p in parts if len(p) < 5) and all(0 < len(p) < 4 for p in parts)
    return (s.count("@") == 1, True, 13 <= n <= 19 and luhn(digits_of(s)), 7 <= n <= 15)[kind]


# ---- the network

SYMBOLS = "0123456789@.-+() _%/:,;|#*\n"
PAD, LOWER, UPPER, OTHER_LETTER, OTHER = range(len(SYMBOLS), len(SYMBOLS) + 5)
N_SYMBOLS = len(SYMBOLS) + 5
N_TAGS = 1 + 2 * len(KINDS)  # outside; first and further character of each kind
ASCII = np.full(128, OTHER, np.uint8)
ASCII[ord("a") : ord("z") + 1], ASCII[ord("A") : ord("Z") + 1] = LOWER, UPPER
for _i, _c in enumerate(SYMBOLS):
    ASCII[ord(_c)] = _i


#: Tags that may not follow each other: a further character of a kind needs the kind's first or further one before it.
BARRED = np.zeros((N_TAGS, N_TAGS))
for _k in range(len(KINDS)):
    BARRED[[t for t in range(N_TAGS) if t not in (1 + 2 * _k, 2 + 2 * _k)], 2 + 2 * _k] = -1e4
WEIGHTS = os.path.join(os.path.dirname(__file__), "pii_weights.npz")


def symbols(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(code < 128, ASCII[np.minimum(code, 127)], np.where(code == 0xA0, ASCII[32], OTHER_LETTER)).astype(np.uint8)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def lstm(x, w, u, b):
    """x: time, batch, input. Hidden states and what the way back needs."""
    hidden = u.shape[0]
    h = c = np.zeros((x.shape[1], hidden))
    hs, kept = [], []
    pre = x @ w + b
    for t in range(len(x)):
        z = pre[t] + h @ u
        g = sigmoid(z[:, : 3 * hidden])
        i, f, o, n = g[:, :hidden], g[:, hidden : 2 * hidden], g[:, 2 * hidden :], np.tanh(z[:, 3 * hidden :])
        before, c = c, f * c + i * n
        tc = np.tanh(c)
        kept.append((i, f, o, n, before, tc, h))
        h = o * tc
        hs.append(h)
    return np.stack(hs), kept


def lstm_back(dh_all, kept, x, w, u):
    dw, du, db, dx = np.zeros_like(w), np.zeros_like(u), np.zeros(w.shape[1]), np.zeros_like(x)
    dh, dc = np.zeros_like(dh_all[0]), np.zeros_like(dh_all[0])
    for t in range(len(x) - 1, -1, -1):
        i, f, o, n, before, tc, h = kept[t]
        dh = dh + dh_all[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * n * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - n * n)], axis=1)
        dw += x[t].T @ dz
        du += h.T @ dz
        db += dz.sum(0)
        dx[t] = dz @ w.T
        dh, dc = dz @ u.T, dc * f
    return dw, du, db, dx


def logsum(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Embedding, two LSTMs, a linear layer and CRF transitions."""

    def __init__(self, embed: int = 12, hidden: int = 28, seed: int = 7):
        r = np.random.default_rng(seed)
        s = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.p = {"e": r.normal(0, 0.5, (N_SYMBOLS, embed)), "out": s(2 * hidden, N_TAGS), "ob": np.zeros(N_TAGS), "tr": np.zeros((N_TAGS, N_TAGS)), "first": np.zeros(N_TAGS)}
        for d in "fb":
            self.p |= {d + "w": s(embed, 4 * hidden), d + "u": s(hidden, 4 * hidden), d + "b": np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]}

    def emissions(self, ids: np.ndarray):
        """ids: batch, time."""
        p, x = self.p, self.p["e"][ids.T]
        hf, kf = lstm(x, p["fw"], p["fu"], p["fb"])
        hb, kb = lstm(x[::-1], p["bw"], p["bu"], p["bb"])
        h = np.concatenate([hf, hb[::-1]], axis=2)
        return h @ p["out"] + p["ob"], (x, h, kf, kb)

    def gradient(self, ids: np.ndarray, tags: np.ndarray):
        """Negative log likelihood of the CRF and its gradient, both a window."""
        p = self.p
        tr = p["tr"] + BARRED
        e, (x, h, kf, kb) = self.emissions(ids)
        time, batch, _ = e.shape
        y, at = tags.T, np.arange(batch)
        alpha = [p["first"] + e[0]]
        for t in range(1, time):
            alpha.append(logsum(alpha[-1][:, :, None] + tr, 1) + e[t])
        beta = [np.zeros((batch, N_TAGS))]
        for t in range(time - 1, 0, -1):
            beta.append(logsum(tr[None] + (e[t] + beta[-1])[:, None, :], 2))
        beta, logz = beta[::-1], logsum(alpha[-1], 1)
        de = np.exp(np.stack(alpha) + np.stack(beta) - logz[None, :, None])
        g = {"first": de[0].sum(0), "tr": np.zeros_like(p["tr"])}
        gold = p["first"][y[0]] + e[0][at, y[0]]
        np.subtract.at(g["first"], y[0], 1)
        for t in range(1, time):
            g["tr"] += np.exp(alpha[t - 1][:, :, None] + tr + (e[t] + beta[t])[:, None, :] - logz[:, None, None]).sum(0)
            np.subtract.at(g["tr"], (y[t - 1], y[t]), 1)
            gold = gold + tr[y[t - 1], y[t]] + e[t][at, y[t]]
        de[np.arange(time)[:, None], at[None, :], y] -= 1
        g["out"], g["ob"] = np.tensordot(h, de, ([0, 1], [0, 1])), de.sum((0, 1))
        dh = de @ p["out"].T
        k = h.shape[2] // 2
        g["fw"], g["fu"], g["fb"], dx = lstm_back(dh[:, :, :k], kf, x, p["fw"], p["fu"])
        g["bw"], g["bu"], g["bb"], dxb = lstm_back(dh[::-1, :, k:], kb, x[::-1], p["bw"], p["bu"])
        g["e"] = np.zeros_like(p["e"])
        np.add.at(g["e"], ids.T, dx + dxb[::-1])
        return (logz - gold).sum() / batch, {n: v / batch for n, v in g.items()}

    def best_paths(self, e: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Viterbi tags (batch, time) of stretches of texts; e: time, batch, tag; begins: whether a stretch begins its text.

        What lies before and after a stretch is outside, unless it begins its text. Tags beyond a stretch's size are 0.
        """
        tr = (self.p["tr"] + BARRED).astype(np.float32)
        start = np.where(begins[:, None], self.p["first"] + BARRED[0], tr[0]).astype(np.float32)
        best, back, at = start + e[0], [], np.arange(e.shape[1])
        for t in range(1, len(e)):
            s = best[:, :, None] + tr
            step = s.argmax(1)
            on = (t < sizes)[:, None]
            back.append(np.where(on, step, np.arange(N_TAGS)).astype(np.int8))
            best = np.where(on, s.max(1) + e[t], best)
        tags = [(best + tr[:, 0]).argmax(1)]
        for b in reversed(back):
            tags.append(b[at, tags[-1]].astype(np.int64))
        return np.where(np.arange(len(e)) < sizes[:, None], np.stack(tags[::-1], axis=1), 0)

    def margin(self, e: np.ndarray, tags: np.ndarray, before: int, after: int) -> float:
        """By how much the path through a span beats that of tags 0; e and tags: of the span; before, after: the tags around it."""
        tr = self.p["tr"]
        path, plain = [before, *tags.tolist(), after], [before, *[0] * len(tags), after]
        steps = sum(float(tr[a, b]) for a, b in zip(path[:-1], path[1:], strict=True)) - sum(float(tr[a, b]) for a, b in zip(plain[:-1], plain[1:], strict=True))
        return steps + float(e[np.arange(len(tags)), tags].sum() - e[:, 0].sum())


# ---- labelled spans


def sample(r: np.random.Generator) -> tuple[str, np.ndarray]:
    """A text with its tags."""
    letters = "etaoinshrdlucmfwypvbgkéäüößñóíçêè"
    pick = lambda *x: x[r.integers(len(x))]
    num = lambda n: "".join(map(str, r.integers(0, 10, n)))
    word = lambda lo=1, hi=9: "".join(letters[min(int(r.exponential(7)), len(letters) - 1)] for _ in range(r.integers(lo, hi)))
    name = lambda: "".join("etaoinshrdlucmfwyp"[k] for k in r.integers(0, 18, r.integers(2, 9)))

    def email():
        return name() + pick("", "." + name(), "_" + name(), num(2), "." + num(2), "+" + name()) + "@" + pick(name(), "mail" + num(1), name() + "-" + name()) + "." + pick("com", "org", "net", "example.com", "co.uk", "de", "example.org")

    def ip():
        return ".".join(str(k) for k in r.integers(0, 256, 4))

    def card():
        d = num(int(r.integers(13, 18)))
        d += str(next(k for k in range(10) if luhn(d + str(k))))
        gap = pick("", "", " ", "-", ".", " ")
        return gap.join(d[k : k + 4] for k in range(0, len(d), 4)) if gap else d

    def phone():
        gap = pick(" ", "-", ".", " ")
        own = pick(f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}{gap}{num(3)}{gap}{num(4)}", f"({num(3)}) {num(3)} {num(4)}", f"{num(2)}{gap}{num(4)}{gap}{num(4)}")
        return pick(f"+{r.integers(1, 99)} ", f"+{r.integers(1, 99)}{gap}", "", f"+{r.integers(1, 999)} ", "+1 ") + own

    def none():
        hexes = "".join(pick("0123456789abcdef", "0123456789ABCDEF")[k] for k in r.integers(0, 16, r.integers(8, 44)))
        return pick(
            f"{r.integers(1, 9)}.{r.integers(0, 20)}", f"v{r.integers(1, 9)}.{r.integers(0, 9)}.{r.integers(0, 9)}", f"20{num(2)}-{r.integers(10, 13)}-{r.integers(10, 29)}",
            num(int(r.integers(1, 9))), num(int(r.integers(20, 26))), f'token = "{hexes}"', f'TOKEN = "{hexes}"', hexes, f"{num(2)}:{num(2)}", f"{num(3)}.{num(2)}", f"@{name()}", f"{r.integers(1, 99)}/{r.integers(1, 99)}",
            f"{r.integers(1, 9)}.{r.integers(0, 9)}.{r.integers(0, 9)}.{r.integers(300, 999)}", f"{num(3)}-{num(4)}", f"{num(4)} {num(2)}", f"{r.integers(1, 20)}", f"version {r.integers(1, 9)}.", f"CC BY-NC {r.integers(1, 9)}.0.", f"19{num(2)}", f"20{num(2)}",
            f"{name()}@", "@ " + num(2), f"${num(2)},{num(3)}", f"{num(2)} %", f"{name()}{num(2)}", f"{num(1)} {num(1)} {num(2)}",
        )

    text, tags = "", []

    def put(s, kind=-1):
        nonlocal text
        text += s
        tags.extend([0] * len(s) if kind < 0 else [1 + 2 * kind, *[2 + 2 * kind] * (len(s) - 1)])

    mark = pick("", "", "", "***", "!!", "&&&", " |", "###", "%%%", "$$$")
    case = pick(str, str, str, str.upper)
    for _ in range(r.integers(2, 5)):
        for _ in range(r.integers(1, 6)):
            w = case(word())
            put(pick(w, w, w, w.capitalize(), w.upper()) + pick("", "", "", ",", ".") + mark + pick(" ", " ", " ", "\n"))
        kind = int(r.integers(-3, 4))
        if kind >= 0:
            put((email, ip, card, phone)[kind](), kind)
            while r.random() < 0.25:  # another one beside it
                put(pick(" ", " ", "\n", ", "))
                kind = int(r.integers(0, 4))
                put((email, ip, card, phone)[kind](), kind)
        else:
            put(none())
        put(pick("", "", "", ".", ",", ";", ")") + mark + pick(" ", " ", "\n"))
    return text, np.array(tags, np.int64)


@lru_cache(maxsize=2)
def trained(fresh: bool = False) -> Tagger:
    """The fitted network, from its file or, if fresh, fitted anew."""
    if fresh:
        return fit()
    model = Tagger()
    with np.load(WEIGHTS) as f:
        model.p = {k: f[k] for k in model.p}
    return model


def fit(samples: int = 12000, epochs: int = 9, batch: int = 64, rate: float = 0.01, seed: int = 11) -> Tagger:
    r = np.random.default_rng(seed)
    ids, tags = [], []
    for _ in range(samples):
        text, t = sample(r)
        s = symbols(text)
        at = int(r.integers(0, max(1, len(s) - WINDOW + 1)))
        s, t = s[at : at + WINDOW], t[at : at + WINDOW]
        ids.append(np.pad(s, (0, WINDOW - len(s)), constant_values=PAD))
        tags.append(np.pad(t, (0, WINDOW - len(t))))
    ids, tags = np.stack(ids), np.stack(tags)
    model = Tagger(seed=seed)
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    step, steps = 0, epochs * (samples // batch)
    for _ in range(epochs):
        order = r.permutation(samples)
        for k in range(samples // batch):
            own = order[k * batch : (k + 1) * batch]
            _, g = model.gradient(ids[own], tags[own])
            norm = np.sqrt(sum((x * x).sum() for x in g.values()))
            step += 1
            lr = rate * (1 - step / (steps + 1))
            for n, x in g.items():
                x = x * min(1, 5 / (norm + 1e-9))
                m[n] = 0.9 * m[n] + 0.1 * x
                v[n] = 0.99 * v[n] + 0.01 * x * x
                model.p[n] = model.p[n] - lr * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-8)
    model.p = {k: x.astype(np.float32) for k, x in model.p.items()}
    return model


# ---- whole texts


def windows_of(text: str) -> list[int]:
    """Starts of the windows with a digit or @."""
    last = max(0, (len(text) - WINDOW + STRIDE - 1) // STRIDE)  # the last window reaches the end
    out: dict[int, None] = {}
    for m in TRIGGER.finditer(text):
        k = m.start() // STRIDE
        out[min(k, last)] = None
        if k:
            out[min(k - 1, last)] = None
    return sorted(k * STRIDE for k in out)


def spans_of_tags(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, stop) of each run of one kind; a first-character tag begins a new one."""
    out, begun = [], None
    at = np.flatnonzero(tags)
    before = -2
    for i in at.tolist():
        kind, first = (int(tags[i]) - 1) // 2, int(tags[i]) % 2 == 1
        if begun and (i != before + 1 or first or begun[1] != kind):
            out.append((*begun, before + 1))
            begun = None
        if not begun:
            begun = (i, kind)
        before = i
    if begun:
        out.append((*begun, before + 1))
    return out


def stretches(texts: list[str], busy: list[int]) -> list[tuple[int, int, int]]:
    """(text, start, stop) of each longest run of windows that are read."""
    out: list[tuple[int, int, int]] = []
    for k in busy:
        for s in windows_of(texts[k]):
            if out and out[-1][0] == k and s < out[-1][2]:
                out[-1] = (k, out[-1][1], s + WINDOW)
            else:
                out.append((k, s, s + WINDOW))
    return [(k, a, min(b, len(texts[k]))) for k, a, b in out]


def merged_emissions(coded: dict[int, np.ndarray], parts: list[tuple[int, int, int]], model: Tagger, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """The averaged emissions of all stretches, one after another, and where each begins."""
    sizes = np.array([b - a for _, a, b in parts], np.int64)
    begin = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    out, weight = np.zeros((total + WINDOW, N_TAGS), np.float32), np.zeros(total + WINDOW, np.float32)
    depth = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]).astype(np.float32) + 1
    where = [(n, s) for n, (_, a, b) in enumerate(parts) for s in range(a, max(b - STRIDE, a + 1), STRIDE)]
    for lo in range(0, len(where), batch):
        part = where[lo : lo + batch]
        ids = np.full((len(part), WINDOW), PAD, np.uint8)
        place = np.full((len(part), WINDOW), total, np.int64)
        for row, at, (n, s) in zip(ids, place, part, strict=True):
            k, a, b = parts[n]
            own = coded[k][s : min(s + WINDOW, b)]
            row[: len(own)] = own
            at[: len(own)] = begin[n] + s - a + np.arange(len(own))
        found = model.emissions(ids)[0].transpose(1, 0, 2).astype(np.float32)
        parity = np.array([(s // STRIDE) % 2 for _, s in part])
        for p in (0, 1):  # windows of one parity share no character, but for what is padded
            own = parity == p
            out[place[own]] += found[own] * depth[:, None]
            weight[place[own]] += depth
    return out[:total] / np.maximum(weight[:total, None], 1e-9), begin


def decoded(e: np.ndarray, begin: np.ndarray, parts: list[tuple[int, int, int]], model: Tagger, cells: int = 1 << 15) -> list[np.ndarray]:
    """The tags of each stretch, by Viterbi over its whole length; stretches of like sizes go together."""
    sizes = np.array([b - a for _, a, b in parts], np.int64)
    tags: list[np.ndarray] = [np.zeros(0, np.int64)] * len(parts)
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        n = 1
        while at + n < len(order) and (n + 1) * sizes[order[at + n]] <= cells:
            n += 1
        own = order[at : at + n]
        high = int(sizes[own].max())
        block = np.zeros((high, n, N_TAGS), np.float32)
        for j, k in enumerate(own):
            block[: sizes[k], j] = e[begin[k] : begin[k] + sizes[k]]
        found = model.best_paths(block, np.array([parts[k][1] == 0 for k in own]), sizes[own])
        for j, k in enumerate(own):
            tags[k] = found[j, : sizes[k]]
        at += n
    return tags


def find(texts: list[str], model: Tagger) -> list[list[tuple[int, int, int, bool]]]:
    """(start, kind, stop, of a pattern) of each text, in order. Memory: some 60 bytes for each character that is read."""
    out: list[list] = [[] for _ in texts]
    busy = [k for k, t in enumerate(texts) if TRIGGER.search(t)]
    for k in busy:
        out[k] = [(s, kind, e, True) for s, kind, e in base_spans(texts[k])]
    parts = stretches(texts, busy)
    if not parts:
        return out
    coded = {k: symbols(texts[k]) for k in busy}
    taken = {k: np.zeros(len(coded[k]), bool) for k in busy}
    for k in busy:
        for s, _, stop, _ in out[k]:
            taken[k][s:stop] = True
    e, begin = merged_emissions(coded, parts, model)
    for (k, a, _), tags, at in zip(parts, decoded(e, begin, parts, model), begin, strict=True):
        for s, kind, stop in spans_of_tags(tags):
            if taken[k][a + s : a + stop].any() or not plausible(kind, texts[k][a + s : a + stop]):
                continue
            before, after = (int(tags[s - 1]) if s else 0), (int(tags[stop]) if stop < len(tags) else 0)
            if model.margin(e[at + s : at + stop], tags[s:stop], before, 0 if after % 2 == 0 else after) >= LEAST_MARGIN:
                out[k].append((a + s, kind, a + stop, False))
    return [sorted(x) for x in out]


SPAN = "array<struct<kind:string,start:long,stop:long,base:boolean>>"


def find_personal_data(df: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, stop, base: found by a pattern); one row for each row of df."""
    model = df.sparkSession.sparkContext.broadcast(trained().p)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger()
        tagger.p = model.value
        for batch in batches:
            for part in chunks(batch, "text", 2 << 20):
                found = find(part.column("text").to_pylist(), tagger)
                rows = [[{"kind": KINDS[k], "start": s, "stop": e, "base": b} for s, k, e, b in x] for x in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    return clean_documents(df).mapInArrow(run, f"doc_id long, spans {SPAN}")


def masked(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """text with each span replaced by its kind in brackets; spans that overlap go as one, under the first one's kind."""
    out, at = [], 0
    joined: list[list[int]] = []
    for s, k, e, _ in spans:
        if joined and s < joined[-1][2]:
            joined[-1][2] = max(joined[-1][2], e)
        else:
            joined.append([s, k, e])
    for s, k, e in joined:
        out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def mask_personal_data(df: DataFrame) -> DataFrame:
    """df with its texts masked (null texts stay null); n_chars, if there, is that of the new text."""
    model = df.sparkSession.sparkContext.broadcast(trained().p)
    schema, names = df.schema, df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger()
        tagger.p = model.value
        at = names.index("text")
        for batch in batches:
            for part in chunks(batch, "text", 2 << 20):
                texts = part.column(at).to_pylist()
                found = find([t or "" for t in texts], tagger)
                cols = list(part.columns)
                cols[at] = pa.array([t and masked(t, s) for t, s in zip(texts, found, strict=True)], part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)

    out = df.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out


if __name__ == "__main__":
    np.savez(WEIGHTS, **fit().p)
