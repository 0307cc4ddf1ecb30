"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds to them.

The patterns label spans; the network learns from a bounded sample of labelled windows how such data look in their
surroundings and finds what a pattern loses, such as a number whose greedy match ran into its neighbour.  It is
written and trained in numpy.  A text is read in windows that overlap by half; each window is decoded by itself and
the spans of all windows of a text are reconciled together: the set of disjoint spans with the highest total score.

Every kind holds a digit or ``@``, so only windows with such a character are decoded; no other can hold a span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48
#: Windows that training sees at most.
SAMPLE = 2048
#: Least mean probability of the characters of an added span.
SURE = 0.9

TRIGGER = re.compile(r"[0-9@]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches; only the run of allowed characters before an ``@`` is looked at, so time is linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def valid(kind: int, text: str) -> bool:
    """What a match must also satisfy."""
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    if kind == 2:
        digits = _digits(text)
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:
        return 9 <= len(_digits(text)) <= 15
    return True


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the fixed patterns, in this order; failing matches are dropped without another try."""
    if not TRIGGER.search(text):
        return []
    found = [(a, 0, b) for a, b in _emails(text)]
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if valid(kind, m[0])]
    return sorted(found)


# --- the network -------------------------------------------------------------------------------------------------

#: Character classes: the ten digits, marks that structure such data, and kinds of letters and spaces.
MARKS = "@.+-()_%:/=\"' ,\n"
N_CLASSES = 10 + len(MARKS) + 5
TAGS = 1 + 2 * len(KINDS)
EMBED, HIDDEN = 12, 24


def _classes() -> np.ndarray:
    table = np.full(256, 10 + len(MARKS) + 4, np.int8)
    for i in range(256):
        c = chr(i)
        table[i] = 10 + len(MARKS) + (0 if c.islower() else 1 if c.isupper() else 2 if c.isspace() else 3)
    for i in range(10):
        table[ord("0") + i] = i
    for i, c in enumerate(MARKS):
        table[ord(c)] = 10 + i
    return table


CLASS_OF = _classes()


def encode(windows: list[str]) -> np.ndarray:
    """Class numbers, one row per window, padded with -1."""
    out = np.full((len(windows), WINDOW), -1, np.int8)
    for i, w in enumerate(windows):
        codes = np.frombuffer(w.encode("utf-32-le"), np.uint32)
        out[i, : len(codes)] = np.where(codes < 256, CLASS_OF[np.minimum(codes, 255)], 10 + len(MARKS) + 4)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def allowed() -> np.ndarray:
    """0 where a tag may follow another (last row: start of a window), a large penalty elsewhere.

    A window may begin inside a span that its neighbour sees whole.
    """
    ban = np.zeros((TAGS + 1, TAGS))
    for k in range(len(KINDS)):
        for before in range(TAGS):
            if before not in (1 + 2 * k, 2 + 2 * k):
                ban[before, 2 + 2 * k] = -1e4
    return ban


BAN = allowed()


@dataclass
class Network:
    """Parameters of the bidirectional LSTM, the emission layer and the CRF transitions."""

    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        w: dict[str, np.ndarray] = {"embed": rng.normal(0, 0.3, (N_CLASSES + 1, EMBED))}
        for side in ("f", "b"):
            w[f"{side}_w"] = rng.normal(0, (EMBED + HIDDEN) ** -0.5, (EMBED + HIDDEN, 4 * HIDDEN))
            w[f"{side}_b"] = np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)
        w["out_w"] = rng.normal(0, HIDDEN**-0.5, (2 * HIDDEN, TAGS))
        w["out_b"] = np.zeros(TAGS)
        w["move"] = np.zeros((TAGS + 1, TAGS))
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def _run(self, x: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """Hidden states over time (time first); ``keep`` gets what the backward pass needs."""
        w, b = self.weights[f"{side}_w"], self.weights[f"{side}_b"]
        n = x.shape[1]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        drive = x @ w[:EMBED] + b
        out = np.empty((len(x), n, HIDDEN), np.float32)
        for t in range(len(x)) if side == "f" else reversed(range(len(x))):
            z = drive[t] + h @ w[EMBED:]
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before = (h, c)
            c = f * c + i * g
            s = np.tanh(c)
            h = o * s
            out[t] = h
            if keep is not None:
                keep.append((t, before, i, f, o, g, s))
        return out

    def emissions(self, codes: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Scores of the tags, time first."""
        x = self.weights["embed"][codes.T.astype(np.int64)]
        kf, kb = ([], []) if keep is not None else (None, None)
        both = np.concatenate([self._run(x, "f", kf), self._run(x, "b", kb)], axis=2)
        if keep is not None:
            keep.update(x=x, f=kf, b=kb, both=both)
        return both @ self.weights["out_w"] + self.weights["out_b"]

    def _moves(self) -> np.ndarray:
        return self.weights["move"] + BAN

    def marginals(self, score: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log normaliser, tag probabilities and summed pair probabilities (CRF forward and backward passes)."""
        move = self._moves()
        time, n, _ = score.shape
        alpha, beta = np.empty((time, n, TAGS)), np.zeros((time, n, TAGS))
        alpha[0] = score[0] + move[-1]
        for t in range(1, time):
            step = _logsum(alpha[t - 1][:, :, None] + move[None, :-1], 1) + score[t]
            alpha[t] = np.where(real[t][:, None], step, alpha[t - 1])
        total = _logsum(alpha[-1], 1)
        pairs = np.zeros((TAGS + 1, TAGS))
        for t in reversed(range(1, time)):
            ahead = score[t] + beta[t]
            back = _logsum(move[None, :-1] + ahead[:, None, :], 2)
            joint = alpha[t - 1][:, :, None] + move[None, :-1] + ahead[:, None, :] - total[:, None, None]
            pairs[:-1] += (np.exp(joint) * real[t][:, None, None]).sum(0)
            beta[t - 1] = np.where(real[t][:, None], back, beta[t])
        chance = np.exp(alpha + beta - total[None, :, None]) * real[:, :, None]
        pairs[-1] = chance[0].sum(0)
        return total, chance, pairs

    def loss(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood per window and its gradients."""
        keep: dict = {}
        score = self.emissions(codes, keep).astype(np.float64)
        real, gold = (codes.T >= 0), tags.T
        total, chance, pairs = self.marginals(score, real)
        n = codes.shape[0]
        one = np.eye(TAGS)[gold] * real[:, :, None]
        before = np.concatenate([np.full((1, n), TAGS), gold[:-1]])
        held = np.zeros_like(pairs)
        np.add.at(held, (before[real], gold[real]), 1.0)
        truth = (score * one).sum() + (held * self._moves()).sum()
        d_score = ((chance - one) / n).astype(np.float32)
        grads = {"move": ((pairs - held) / n).astype(np.float32)}
        both = keep["both"]
        grads["out_w"] = np.einsum("tnh,tnk->hk", both, d_score)
        grads["out_b"] = d_score.sum((0, 1))
        d_both = d_score @ self.weights["out_w"].T
        d_x = np.zeros_like(keep["x"])
        for side, part in (("f", d_both[:, :, :HIDDEN]), ("b", d_both[:, :, HIDDEN:])):
            self._back(keep["x"], keep[side], part, side, grads, d_x)
        grads["embed"] = np.zeros_like(self.weights["embed"])
        np.add.at(grads["embed"], codes.T.astype(np.int64), d_x)
        return float((total.sum() - truth) / n), grads

    def _back(self, x: np.ndarray, kept: list, d_out: np.ndarray, side: str, grads: dict, d_x: np.ndarray) -> None:
        w = self.weights[f"{side}_w"]
        d_w, d_b = np.zeros_like(w), np.zeros(4 * HIDDEN, np.float32)
        d_h, d_c = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
        for t, (h, c), i, f, o, g, s in reversed(kept):
            d_h = d_h + d_out[t]
            d_c = d_c + d_h * o * (1 - s * s)
            d_z = np.concatenate([d_c * g * i * (1 - i), d_c * c * f * (1 - f), d_h * s * o * (1 - o), d_c * i * (1 - g * g)], 1)
            d_w[:EMBED] += x[t].T @ d_z
            d_w[EMBED:] += h.T @ d_z
            d_b += d_z.sum(0)
            d_x[t] += d_z @ w[:EMBED].T
            d_h, d_c = d_z @ w[EMBED:].T, d_c * f
        grads[f"{side}_w"], grads[f"{side}_b"] = d_w, d_b

    def decode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of each window and their probabilities, window first."""
        score = self.emissions(codes).astype(np.float64)
        real, move = codes.T >= 0, self._moves()
        time, n, _ = score.shape
        best, back = score[0] + move[-1], np.zeros((time, n, TAGS), np.int8)
        for t in range(1, time):
            paths = best[:, :, None] + move[None, :-1]
            back[t] = np.where(real[t][:, None], paths.argmax(1), np.arange(TAGS)[None])
            best = np.where(real[t][:, None], paths.max(1) + score[t], best)
        tags = np.zeros((time, n), np.int64)
        tags[-1] = best.argmax(1)
        for t in reversed(range(1, time)):
            tags[t - 1] = back[t][np.arange(n), tags[t]]
        _, chance, _ = self.marginals(score, real)
        sure = np.take_along_axis(chance, tags[:, :, None], 2)[:, :, 0]
        return np.where(real, tags, 0).T, sure.T


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)


def train(windows: list[str], spans: list[list[Span]], rounds: int = 240, batch: int = 64, seed: int = 7) -> Network:
    """Adam on shuffled batches.  Without windows the network is untrained and ``decode`` results are not used."""
    net = Network.fresh(seed)
    codes, tags = encode(windows), np.zeros((len(windows), WINDOW), np.int64)
    for row, found in zip(tags, spans):
        for a, kind, b in found:
            row[a:b] = 2 + 2 * kind
            row[a] = 1 + 2 * kind
    rng, first, second = np.random.default_rng(seed), {}, {}
    order = np.empty(0, np.int64)
    for step in range(1, (rounds if windows else 0) + 1):
        if len(order) < min(batch, len(windows)):
            order = rng.permutation(len(windows))
        pick, order = order[:batch], order[batch:]
        _, grads = net.loss(codes[pick], tags[pick])
        size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = 0.02 * min(1.0, 3.0 * (1 - (step - 1) / rounds))
        for k, g in grads.items():
            g = g * min(1.0, 5.0 / (size + 1e-9))
            first[k] = 0.9 * first.get(k, 0) + 0.1 * g
            second[k] = 0.99 * second.get(k, 0) + 0.01 * g * g
            move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
            net.weights[k] = (net.weights[k] - rate * move).astype(np.float32)
    return net


# --- windows and texts -------------------------------------------------------------------------------------------


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a digit or ``@``; each character lies in two, but for the first half window."""
    out: list[int] = []
    match = TRIGGER.search(text)
    while match:
        block = match.start() // STRIDE
        for k in (block - 1, block):
            if k >= 0 and (not out or out[-1] < k * STRIDE):
                out.append(k * STRIDE)
        match = TRIGGER.search(text, (block + 1) * STRIDE)
    return out


def window_spans(tags: np.ndarray, sure: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, mean probability) of the spans of one decoded window."""
    out, start = [], -1
    for t, tag in enumerate([*tags.tolist(), 0]):
        if start >= 0 and not (tag and tag % 2 == 0):
            out.append((start, (int(tags[start]) - 1) // 2, t, float(sure[start:t].mean())))
            start = -1
        if tag % 2 == 1:
            start = t
    return out


def reconcile(found: list[tuple[int, int, int, float]]) -> list[Span]:
    """Disjoint spans with the highest summed score, from the proposals of all windows of a text."""
    votes: dict[Span, float] = {}
    for a, kind, b, p in found:
        votes[a, kind, b] = votes.get((a, kind, b), 0.0) + p
    order = sorted(votes, key=lambda s: (s[2], s[0], s[1]))
    ends, best, choice = [s[2] for s in order], [0.0], []
    for i, s in enumerate(order):
        fits = int(np.searchsorted(ends[:i], s[0], "right"))
        take = best[fits] + votes[s] * (s[2] - s[0])
        choice.append((take > best[-1], fits))
        best.append(max(best[-1], take))
    out, i = [], len(order)
    while i:
        used, fits = choice[i - 1]
        if used:
            out.append(order[i - 1])
        i = fits if used else i - 1
    return out[::-1]


def added_spans(text: str, base: list[Span], found: list[tuple[int, int, int, float]]) -> list[Span]:
    """Reconciled spans that are sure, valid for their kind, and touch no base span."""
    out = []
    for a, kind, b in reconcile([f for f in found if f[3] >= SURE]):
        body = text[a:b]
        if kind == 0:
            good = bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", body))
        elif kind == 1:
            good = bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", body)) and valid(1, body)
        else:
            good = valid(kind, body) and body[-1].isdigit()
        if good and not any(x < b and a < y for x, _, y in base):
            out.append((a, kind, b))
    return out


def find(texts: list[str | None], net: Network, batch: int = 256) -> list[list[tuple[int, int, int, bool]]]:
    """(start, kind, end, base) of all spans of each text, in order."""
    windows: list[tuple[int, int]] = []
    base = []
    for i, text in enumerate(texts):
        base.append(base_spans(text or ""))
        windows += [(i, s) for s in window_starts(text or "")]
    proposals: dict[int, list] = {}
    for low in range(0, len(windows), batch):
        part = windows[low : low + batch]
        tags, sure = net.decode(encode([(texts[i] or "")[s : s + WINDOW] for i, s in part]))
        for (i, s), tag, p in zip(part, tags, sure):
            size = len(texts[i] or "")
            for a, kind, b, chance in window_spans(tag, p):
                # A span at a window's inner edge may go on outside; the neighbour sees it whole.
                if (a > 0 or s == 0) and (b < WINDOW or s + b >= size):
                    proposals.setdefault(i, []).append((s + a, kind, s + b, chance))
    out = []
    for i, text in enumerate(texts):
        more = added_spans(text or "", base[i], proposals.get(i, []))
        out.append(sorted([(*s, True) for s in base[i]] + [(*s, False) for s in more]))
    return out


# --- tables ------------------------------------------------------------------------------------------------------


def labelled_windows(df: DataFrame, text: str = "text", limit: int = SAMPLE) -> DataFrame:
    """A bounded sample of windows with digits or ``@`` and their base spans: those with the lowest content hash."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for body in batch["text"]:
                base = base_spans(body)
                for s in window_starts(body):
                    inside = [(a - s, kind, b - s) for a, kind, b in base if a >= s and b <= s + WINDOW]
                    if not any(a < s < b or a < s + WINDOW < b for a, _, b in base):
                        rows.append((body[s : s + WINDOW], ",".join(f"{a}:{k}:{b}" for a, k, b in inside)))
            yield pd.DataFrame(rows, columns=["window", "spans"])

    some = df.select(F.col(text).alias("text")).where(F.col("text").rlike("[0-9@]"))
    cuts = some.mapInPandas(cut, "window string, spans string")
    return cuts.orderBy(F.xxhash64("window"), "window").limit(limit)


def learn(df: DataFrame, text: str = "text", limit: int = SAMPLE) -> Network:
    """Train on the labelled sample of at most ``limit`` windows, in one task; only the weights reach the driver."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows, spans = [], []
        for batch in batches:
            for window, said in zip(batch["window"], batch["spans"]):
                parsed, last = [], 0
                for a, kind, b in (map(int, s.split(":")) for s in said.split(",") if s):
                    if a >= last:  # tags cannot overlap: the first span counts
                        parsed.append((a, kind, b))
                        last = b
                windows.append(window)
                spans.append(parsed)
        net = train(windows, spans)
        yield pd.DataFrame({"name": list(net.weights), "data": [w.tobytes() for w in net.weights.values()]})

    fitted = labelled_windows(df, text, limit).coalesce(1).mapInPandas(fit, "name string, data binary").collect()
    shapes = Network.fresh().weights
    return Network({r["name"]: np.frombuffer(bytes(r["data"]), np.float32).reshape(shapes[r["name"]].shape) for r in fitted})


SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


def with_spans(df: DataFrame, text: str = "text", name: str = "pii", net: Network | None = None) -> DataFrame:
    """Add all spans of personal data, by start, then kind; offsets are code points, ends exclusive.

    A null text has no spans.  Without a network one is learned from the table first.
    """
    net = net or learn(df, text)

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = find([t if isinstance(t, str) else None for t in batch], net)
            yield pd.Series([[{"kind": KINDS[k], "start": a, "end": b, "base": o} for a, k, b, o in f] for f in found])

    return df.withColumn(name, F.pandas_udf(each, SPANS)(F.col(text)))


def _mask(body: str, spans: list[tuple[str, int, int]]) -> str:
    """A text with each ``(kind, start, end)``, or run of overlapping ones, replaced by the kind of the first in brackets."""
    parts, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            parts += [body[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*parts, body[done:]])


def masked(df: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """Replace each span, or run of overlapping spans, by the kind of its first in brackets."""

    def each(texts: pd.Series, found: pd.Series) -> pd.Series:
        pairs = zip(texts, found)
        said = lambda some: [(s["kind"], s["start"], s["end"]) for s in some]
        return pd.Series([_mask(t, said(f)) if isinstance(t, str) and f is not None else t for t, f in pairs], dtype=object)

    return df.withColumn(text, F.pandas_udf(each, "string")(F.col(text), F.col(spans)))


def hidden(df: DataFrame, text: str = "text", net: Network | None = None) -> DataFrame:
    """``masked`` of ``with_spans`` in one pass over the texts, without the spans; null texts, equal rows and others stay."""
    net = net or learn(df, text)

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch]
            found = [[(KINDS[k], a, b) for a, k, b, _ in some] for some in find(texts, net)]
            yield pd.Series([t if t is None else _mask(t, f) for t, f in zip(texts, found)], dtype=object)

    return df.withColumn(text, F.pandas_udf(each, "string")(F.col(text)))
