"""Personal data by base patterns and a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy from labelled spans: made-up items of each kind, written in several styles into
windows of a bounded sample, beside the base spans there and lookalikes that are no personal data. Windows that overlap
cover every text whole; each is decoded by Viterbi, and a text's windows are reconciled globally: each character
takes the label of the window in which it lies deepest, then runs of a label over the whole text are spans. The
network's score decides; after it only numbers are verified (Luhn, parts to 255, how many digits). Spans
that touch a base span are left. Besides the four base kinds the network names secrets.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.session import small
from corpusloom.sources.tables import table

KINDS = ("email", "ip", "card", "phone", "secret")  # no base pattern finds a secret
BASE = 4
TAGS = 1 + len(KINDS)
#: Steps from tag to tag: a span ends before another begins.
ALLOWED = (np.arange(TAGS)[:, None] == np.arange(TAGS)) | (np.arange(TAGS)[:, None] == 0) | (np.arange(TAGS) == 0)
CHARS = 130  # ASCII, any other letter, anything else

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


@dataclass(frozen=True)
class Fit:
    """rows: texts of the sample, and windows to train on. lesson: characters of these. window, overlap: characters in
    decoding. calm: added to the score of no span."""

    rows: int = 2400
    lesson: int = 176
    window: int = 320
    overlap: int = 48
    hidden: int = 8
    epochs: int = 11
    batch: int = 60
    rate: float = 0.02
    calm: float = 0.5
    seed: int = 5


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) by the patterns, leftmost and non-overlapping per kind, in order."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            out.append((start, last, 0))
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


#: Styles of made-up items by kind. The styles after the bar are never trained on: they measure what the network finds by itself.
STYLES = {
    "email": "u@h.t u@h.t u@h.t u_[at]_h_[dot]_t u_(at)_h.t u[at]h[dot]t u_AT_h_DOT_t u@h_[dot]_t | u<at>h<dot>t u_{at}_h.t u(at)h(dot)t",
    "ip": "i.i.i.i i.i.i.i i[.]i[.]i[.]i i_._i_._i_._i | i(.)i(.)i(.)i i.i.i[.]i",
    "card": "c c c.c.c.c c_._c | c/c/c/c c_/_c",
    "phone": "+x_(a)_b-d +y_a_b_d +y-a-b-d (a)_b-d a-b-d +xabd 00y_a_b_d a/b/d | a.b.d +y.a.b.d (a)b.d",
    "secret": "token_=_'s' api_key:_'s' key='s' secret_=_s password:_s token=s Bearer_s | access_token_=_'s' auth:_'s' client_secret='s'",
}


def example(rng: random.Random, held: bool = False) -> tuple[str, int, int, int]:
    """A made-up item, where the personal data in it begins and ends, and its kind."""
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    low, num = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    kind = rng.randrange(len(KINDS))
    style = rng.choice(STYLES[KINDS[kind]].split(" | ")[held].split(" "))
    number = pick(num, 15)
    number += next(c for c in num if luhn(number + c))
    secret = pick(rng.choice([num + "abcdef", low + num, low + low.upper() + num, low.upper() + num]), rng.randint(20, 44))
    quads, quote = [number[k : k + 4] for k in range(0, 16, 4)], rng.choice("\"'")
    parts = {
        "u": lambda: pick(low, rng.randint(2, 9)) + rng.choice(["", "." + pick(low, rng.randint(2, 8)), "_" + pick(low, 4), pick(num, 2), "+" + pick(low, 3)]),
        "h": lambda: pick(low, rng.randint(3, 9)) + rng.choice(["", "-" + pick(low, 3), "." + pick(low, 4)]), "t": lambda: rng.choice(["com", "org", "net", "edu", "de", "io"]),
        "i": lambda: str(rng.randrange(256)), "c": lambda: quads.pop(0) if "/" in style or "." in style else number,
        "x": lambda: rng.choice("17"), "y": lambda: rng.choice(num[1:]) + pick(num, 1), "a": lambda: pick(num, 3), "b": lambda: pick(num, 3), "d": lambda: pick(num, 4), "s": lambda: secret, "'": lambda: quote, "_": lambda: " ",
    }
    if kind == 2 and "_" in style:  # digits in fours with another separator on both sides of the spaces
        return (item := style[1:-1].replace("_", " ").join(quads)), 0, len(item), kind
    words = {"at", "dot", "AT", "DOT", "token", "api_key", "key", "secret", "password", "Bearer", "access_token", "auth", "client_secret", "00"}
    out, begin, end = "", None, 0
    for piece in re.findall("|".join(sorted(words, key=len, reverse=True)) + "|.", style):
        made = piece if piece in words else parts.get(piece, lambda piece=piece: piece)()
        if kind != 4 or piece == "s":
            begin = len(out) if begin is None else begin
            end = len(out) + len(made)
        out += made
    return out, begin, end, kind


def lookalike(rng: random.Random) -> str:
    """Something that is no personal data."""
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    num = "0123456789"
    bad = pick(num, 15)
    bad += next(c for c in num if not luhn(bad + c))
    return rng.choice([
        bad, pick(num, 6), pick(num, 9), f"{pick(num, 4)}-{pick(num, 2)}-{pick(num, 2)}", f"{pick(num, 2)}:{pick(num, 2)}:{pick(num, 2)}", f"{pick(num, 1)}.{pick(num, 2)}.{pick(num, 1)}", f"{pick(num, 2)}.{pick(num, 3)},{pick(num, 2)}",
        f"({pick(num, 4)})", f"{300 + int(pick(num, 2))}.{pick(num, 3)}.{pick(num, 1)}.{pick(num, 1)}", f"@{pick('abcdefgh', 6)}", "the key = value", "at [1] (at home)", "#" * rng.randint(2, 9), "$$$", f"https://{pick('abcdefgh', 7)}.org/{pick('abcdefgh', 5)}?id={pick(num, 4)}", f"Copyright {pick(num, 4)}", "internationalisation", "token of thanks", f"{pick(num, 3)}/{pick(num, 3)}",
    ])


def codes(text: str) -> np.ndarray:
    """Character classes of a text."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(cp < 128, cp, np.where((cp >= 0xC0) & (cp < 0x2000), 128, 129)).astype(np.uint8)


#: Secrets that stand in sample texts as they are; only for labels.
_KEYED = re.compile(r"(?:token|key|secret|password)\s*[=:]\s*[\"']?([A-Za-z0-9+/_-]{16,})")


def write_in(piece: str, rng: random.Random, size: int, held: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Character classes and labels of a window, with up to three items or lookalikes written in."""
    label = np.zeros(len(piece), np.uint8)
    for m in _KEYED.finditer(piece):
        label[m.start(1) : m.end(1)] = 5
    for s, e, k in base_spans(piece):
        label[s:e] = k + 1
    for _ in range(rng.choice([0, 1, 1, 2, 3])):
        gaps = [m.start() for m in re.finditer(r"\s", piece) if not label[max(0, m.start() - 1) : m.start() + 2].any()]
        gap, own = rng.choice(gaps) if gaps else len(piece), None
        if rng.random() < 0.3:
            item = lookalike(rng)
            own = np.zeros(len(item), np.uint8)
        else:
            item, begin, end, kind = example(rng, held)
            own = np.zeros(len(item), np.uint8)
            own[begin:end] = kind + 1
        before, after = rng.choice(["", "", "", "(", ": ", "\n"]), rng.choice(["", "", "", ",", ".", ")", "###", ";"])
        pad = np.zeros(len(before) + 1, np.uint8), np.zeros(len(after), np.uint8)
        piece = piece[:gap] + " " + before + item + after + piece[gap:]
        label = np.concatenate([label[:gap], pad[0], own, pad[1], label[gap:]])
    first = max(0, int(np.flatnonzero(label)[0]) - rng.randrange(size // 2)) if label.any() and len(piece) > size else 0
    piece, label = piece[first : first + size], label[first : first + size]
    return np.pad(codes(piece), (0, size - len(piece))), np.pad(label, (0, size - len(piece)))


def lesson(pieces: list[str], fit: Fit, held: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """``fit.rows`` windows of characters and their labels; pieces are used again, with other items, where there are fewer."""
    rng = random.Random(fit.seed + held)
    made = [write_in(pieces[k % len(pieces)], rng, fit.lesson, held) for k in range(fit.rows if pieces else 0)]
    return np.array([c for c, _ in made], np.uint8).reshape(-1, fit.lesson), np.array([t for _, t in made], np.uint8).reshape(-1, fit.lesson)


def _run(table: np.ndarray, chars: np.ndarray, inner: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """One direction: hidden states (time, window, hidden) of characters (time, window).

    Gates are input, forget, output and candidate; the first three are hard sigmoids, x / 4 + 1 / 2 cut to 0 and 1.
    """
    steps, n = chars.shape
    hid = inner.shape[0]
    scale = np.ones(4 * hid, table.dtype)
    scale[: 3 * hid] = 0.25
    shift = np.where(scale < 1, 0.5, 0).astype(table.dtype)
    inputs, inner = table * scale + shift, (inner * scale).astype(table.dtype)
    h, c, out, past = np.zeros((n, hid), table.dtype), np.zeros((n, hid), table.dtype), np.empty((steps, n, hid), table.dtype), []
    a, add = np.empty((n, 4 * hid), table.dtype), np.empty((n, 4 * hid), table.dtype)
    for t in range(steps):
        if keep:
            a = np.empty_like(a)
        np.take(inputs, chars[t], 0, out=a, mode="clip")
        np.matmul(h, inner, out=add)
        a += add
        s, g = a[:, : 3 * hid], a[:, 3 * hid :]
        np.clip(s, 0, 1, out=s)
        np.tanh(g, out=g)
        before, hb = c, h
        c = s[:, hid : 2 * hid] * c + s[:, :hid] * g
        tc = np.tanh(c)
        h = np.multiply(s[:, 2 * hid :], tc, out=out[t])
        if keep:
            past.append((s, g, before, tc, hb))
    return out, past


def _back(dout: np.ndarray, past: list, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of gate inputs and of the inner weights."""
    steps, n, hid = dout.shape
    dh, dc, dg, dw = np.zeros((n, hid), np.float32), np.zeros((n, hid), np.float32), np.empty((steps, n, 4 * hid), np.float32), np.zeros_like(inner)
    for t in range(steps - 1, -1, -1):
        s, g, before, tc, hb = past[t]
        i, f, o = s[:, :hid], s[:, hid : 2 * hid], s[:, 2 * hid :]
        dh = dh + dout[t]
        dc = dc + dh * o * (1 - tc**2)
        open_ = 0.25 * ((s > 0) & (s < 1))
        dg[t] = np.concatenate([dc * g, dc * before, dh * tc, dc * i * (1 - g**2)], 1)
        dg[t, :, : 3 * hid] *= open_
        dw += hb.T @ dg[t]
        dh, dc = dg[t] @ inner.T, dc * f
    return dg, dw


@dataclass
class Tagger:
    """Per direction a table of gate inputs by character and inner weights; emissions; CRF steps."""

    fit: Fit
    table: list[np.ndarray]
    inner: list[np.ndarray]
    emit: np.ndarray
    bias: np.ndarray
    step: np.ndarray

    @staticmethod
    def fresh(fit: Fit) -> Tagger:
        rng, hid = np.random.Generator(np.random.PCG64(fit.seed)), fit.hidden
        real = lambda s, *shape: rng.normal(0, s, shape).astype(np.float32)
        tables = [real(0.3, CHARS, 4 * hid) for _ in range(2)]
        for x in tables:
            x[:, hid : 2 * hid] += 1  # remember at first
        return Tagger(fit, tables, [real(0.2, hid, 4 * hid) for _ in range(2)], real(0.2, 2 * hid, TAGS), np.zeros(TAGS, np.float32), np.where(ALLOWED, 0, -50).astype(np.float32))

    def emissions(self, chars: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """(time, window, tag) scores of windows of characters (time, window)."""
        ahead, p0 = _run(self.table[0], chars, self.inner[0], keep)
        back, p1 = _run(self.table[1], chars[::-1], self.inner[1], keep)
        back, hid = back[::-1], self.fit.hidden
        return ahead @ self.emit[:hid] + back @ self.emit[hid:] + self.bias, (np.concatenate([ahead, back], 2) if keep else None, p0, p1)

    def decode(self, chars: np.ndarray) -> np.ndarray:
        """Best tags (time, window)."""
        e, _ = self.emissions(chars)
        e[:, :, 0] += self.fit.calm
        steps, n = chars.shape
        best, links = e[0], np.empty((steps, n, TAGS), np.int8)
        stay, enter, leave = np.diag(self.step).copy(), self.step[0], self.step[:, 0]
        own = np.arange(TAGS, dtype=np.int8)
        for t in range(1, steps):  # a span follows itself or no span: ALLOWED
            on, in_, off = best + stay, best[:, :1] + enter, best + leave
            np.multiply(on >= in_, own, out=links[t])
            none, via = off[:, 0], np.zeros(n, np.int8)
            for j in range(1, TAGS):
                better = off[:, j] > none
                none = np.maximum(none, off[:, j])
                np.copyto(via, own[j], where=better)
            links[t, :, 0] = via
            best = np.maximum(on, in_)
            best[:, 0] = none
            best += e[t]
        out = np.empty((steps, n), np.int8)
        out[-1] = best.argmax(1)
        every = np.arange(n)
        for t in range(steps - 1, 0, -1):
            out[t - 1] = links[t][every, out[t]]
        return out

    def gradients(self, chars: np.ndarray, tags: np.ndarray) -> list[np.ndarray]:
        """Of the mean negative log likelihood, in the order of ``parameters``."""
        e, (h, p0, p1) = self.emissions(chars, keep=True)
        steps, n, _ = e.shape
        fwd, bwd = np.empty_like(e), np.zeros_like(e)
        fwd[0] = e[0]
        for t in range(1, steps):
            fwd[t] = e[t] + np.logaddexp.reduce(fwd[t - 1][:, :, None] + self.step, 1)
        for t in range(steps - 2, -1, -1):
            bwd[t] = np.logaddexp.reduce(self.step + (e[t + 1] + bwd[t + 1])[:, None, :], 2)
        total = np.logaddexp.reduce(fwd[-1], 1)
        de = np.exp(fwd + bwd - total[:, None])
        pair = np.exp(fwd[:-1, :, :, None] + self.step + (e[1:] + bwd[1:])[:, :, None, :] - total[:, None, None])
        dstep = pair.sum((0, 1))
        np.subtract.at(dstep, (tags[:-1], tags[1:]), 1)
        de[np.arange(steps)[:, None], np.arange(n), tags] -= 1
        de, dstep = (de / n).astype(np.float32), dstep / n
        demit = np.einsum("tnh,tnk->hk", h, de)
        dh, hid = de @ self.emit.T, self.fit.hidden
        g0, w0 = _back(dh[:, :, :hid], p0, self.inner[0])
        g1, w1 = _back(dh[::-1, :, hid:], p1, self.inner[1])
        tables = []
        for g, c in ((g0, chars), (g1, chars[::-1])):
            flat, at = g.reshape(-1, g.shape[2]), c.ravel()
            tables.append(np.stack([np.bincount(at, flat[:, k], CHARS) for k in range(flat.shape[1])], 1))
        return [*tables, w0, w1, demit, de.sum((0, 1)), np.where(ALLOWED, dstep, 0)]

    def parameters(self) -> list[np.ndarray]:
        return [*self.table, *self.inner, self.emit, self.bias, self.step]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Spans of the network in each text, over the whole of it."""
        fit = self.fit
        data = [codes(t) for t in texts]
        size = np.array([len(x) for x in data], np.int64)
        offsets = np.concatenate([[0], np.cumsum(size)])
        flat = np.concatenate(data) if data else np.zeros(0, np.uint8)
        hop = fit.window - fit.overlap
        n = np.where(size > 0, np.maximum(1, -(-(size - fit.overlap) // hop)), 0)
        row = np.repeat(np.arange(len(size)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        starts = offsets[row] + k * hop
        out = np.zeros(len(flat), np.int8)
        for a in range(0, len(row), 512):
            b = min(a + 512, len(row))
            at = starts[a:b] + np.arange(fit.window)[:, None]
            inside = at < offsets[row[a:b] + 1]
            tags = self.decode(np.where(inside, flat[np.minimum(at, len(flat) - 1)], 0))
            place = np.arange(fit.window)[:, None]
            deep = inside & ((place >= fit.overlap // 2) | (k[a:b] == 0)) & ((place < fit.window - fit.overlap // 2) | (k[a:b] == n[row[a:b]] - 1))
            out[at[deep]] = tags[deep]
        edge = np.ones(len(out) + 1, bool)
        edge[1:-1] = out[1:] != out[:-1]
        edge[offsets] = True
        cuts = np.flatnonzero(edge)
        kinds = out[cuts[:-1]] if len(out) else out
        own = np.flatnonzero(kinds > 0)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for s, e, kind in zip(cuts[own].tolist(), cuts[own + 1].tolist(), kinds[own].tolist()):
            r = int(np.searchsorted(offsets, s, "right")) - 1
            found[r].append((s - int(offsets[r]), e - int(offsets[r]), kind - 1))
        return found


def train(pieces: list[str], fit: Fit) -> Tagger:
    """Adam over the windows of the lesson."""
    net = Tagger.fresh(fit)
    chars, tags = lesson(pieces, fit)
    rng = np.random.Generator(np.random.PCG64(fit.seed))
    p = net.parameters()
    m, s, t = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    for epoch in range(fit.epochs):
        order = rng.permutation(len(chars))
        rate = fit.rate * (1 - epoch / fit.epochs)
        for k in range(0, len(order), fit.batch):
            part = order[k : k + fit.batch]
            grads = net.gradients(chars[part].T, tags[part].T.astype(np.int64))
            norm = float(np.sqrt(sum((g**2).sum() for g in grads)))
            t += 1
            for i, g in enumerate(grads):
                g = g * min(1.0, 5 / max(norm, 1e-6))
                m[i] = 0.9 * m[i] + 0.1 * g
                s[i] = 0.999 * s[i] + 0.001 * g**2
                p[i] -= (rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def learn(docs: DataFrame, fit: Fit = Fit()) -> Tagger | None:
    """Train on one window from anywhere in each of the ``fit.rows`` texts whose hash is least; None for a table without texts.

    Only the windows of these rows come to the driver.
    """
    key = F.xxhash64("doc_id", "text")
    place = F.pmod(F.xxhash64(key, F.lit(fit.seed)), F.greatest(F.lit(1), F.length("text") - fit.lesson)) + 1
    texts = docs.where(F.col("text") != "").select(key.alias("key"), F.substring("text", place.cast("int"), F.lit(fit.lesson)).alias("piece"))
    got = texts.orderBy("key", "piece").limit(fit.rows).collect()
    return train([r["piece"] for r in got], fit) if got else None


_AT, _DOT = r"(?:@|[\[({<]?\bat\b[\])}>]?)", r"(?:\.|\s?[\[({<]?\bdot\b[\])}>]?\s?)"
_ADDRESS = re.compile(rf"[\w.%+-]+\s?{_AT}\s?[\w-]+(?:{_DOT}[\w-]+)+", re.I)
#: Characters of an address at most, with some for what is spelled out.
ADDRESS = 280


def verified(own: str, kind: int) -> bool:
    """Whether the numbers and signs in a span of the network can be what it says.

    An address is two names with one at sign, or a spelled one, between them, the second with a dot or a spelled one inside.
    """
    numbers = re.findall(r"[0-9]+", own)
    digits = "".join(numbers)
    if kind == 1:
        return len(numbers) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in numbers)
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:
        return 10 <= len(digits) <= 15
    if kind == 0:
        return len(own) <= ADDRESS and "\n" not in own and bool(_ADDRESS.fullmatch(own.strip()))
    return len(own) >= 16 and not re.search(r"\s", own)


def all_spans(texts: list[str], net: Tagger | None) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; spans the network adds do not touch base spans."""
    learnt = net.spans(texts) if net else [[] for _ in texts]
    out = []
    for text, more in zip(texts, learnt):
        base = base_spans(text)
        taken = np.array([b[:2] for b in base], np.int64).reshape(-1, 2)
        added = [s for s in more if verified(text[s[0] : s[1]], s[2]) and not ((s[0] < taken[:, 1]) & (s[1] > taken[:, 0])).any()]
        out.append((base, sorted(base + added, key=lambda s: (s[0], s[2]))))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def _groups(texts: list[str], chars: int = 1 << 18) -> Iterator[tuple[int, int]]:
    i = n = 0
    for k, t in enumerate(texts):
        n += len(t)
        if n >= chars:
            yield i, k + 1
            i, n = k + 1, 0
    if i < len(texts):
        yield i, len(texts)


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def find(docs: DataFrame, net: Tagger | None) -> DataFrame:
    """Counts and digest of base spans, and the list and number of all spans of each row of ``docs`` (doc_id, text).

    Texts are searched whole, null as the empty text. Offsets are code points, ends exclusive. Equal
    rows stay rows of their own; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(net)  # tens of KB

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(parts):
            ids, texts = batch.column("doc_id"), [t or "" for t in batch.column("text").to_pylist()]
            for i, j in _groups(texts):
                found = all_spans(texts[i:j], held.value)
                counts = [[sum(s[2] == k for s in base) for base, _ in found] for k in range(BASE)]
                digest = [hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found]
                cols = [ids.slice(i, j - i), *(pa.array(c, pa.int64()) for c in counts), pa.array(digest, pa.string()), pa.array([listed(x) for _, x in found], pa.string()), pa.array([len(x) for _, x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in OUT.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, OUT)


def redacted(docs: DataFrame, net: Tagger | None) -> DataFrame:
    """``docs`` with each span of its text replaced by its kind in angle brackets; spans that touch become one.

    A null text stays null; all other columns stay as they are.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(net)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(parts):
            place = batch.schema.get_field_index("text")
            texts = batch.column(place).to_pylist()
            out: list[str | None] = []
            for i, j in _groups([t or "" for t in texts]):
                own = texts[i:j]
                for text, (_, spans) in zip(own, all_spans([t or "" for t in own], held.value)):
                    parts_, at = [], 0
                    for s, e, k in spans:
                        if s >= at:
                            parts_ += [text[at:s], f"<{KINDS[k]}>"]
                        at = max(at, e)
                    out.append(None if text is None else "".join(parts_) + text[at:])
            yield batch.set_column(place, batch.schema.field(place), pa.array(out, batch.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)


def op7_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: base patterns, and what the network adds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, learn(docs))
