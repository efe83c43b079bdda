"""Personal data and secrets, found by a character-level bidirectional LSTM with CRF transitions, in numpy.

All arrays are (features, windows), both directions run in one loop, and gates and cells are bent by x / (1 + |x|), which
takes a division where tanh takes an exponential: every character of every text is decoded, and that is nearly all the
time that this operator takes. Transitions to the outside or to a span's begin are sums of a number for either tag, so
that Viterbi's step takes one maximum for all of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from reachlight.llm import frame

KINDS = ("email", "phone", "ip", "card", "secret", "id")
#: Tag 0 is outside; 1 + 2 k begins kind k, 2 + 2 k goes on with it.
TAGS = 1 + 2 * len(KINDS)
#: Units of each direction, numbers that stand for a character; characters of a window, from one window to the next, and
#: of what a shorter window is filled up to a multiple of.
UNITS, CODE, WINDOW, STRIDE, FILL = 16, 8, 512, 448, 64
#: Windows that are decoded at once.
AT_ONCE = 512
#: Documents whose texts the training windows are cut from at most; windows in a step, their length, steps, first rate.
SAMPLE, BATCH, LENGTH, STEPS, RATE = 400, 64, 112, 360, 0.015
#: After so large a share of the steps the texts themselves are decoded, and so large a share of later windows is cut where spans were found that aren't there.
MINE, HARD = 0.55, 0.35
#: What nearly all spans hold. Words of the training texts that hold one are left out, since they may be unlabelled spans; decoding doesn't look at it.
MARK = re.compile("[0-9@]")
#: What a window costs that begins inside a span.
INSIDE = 3.0

ALPHABET = 128 + 5


def char_ids(codes: np.ndarray) -> np.ndarray:
    """A symbol for each code point: ASCII as it is, other white space, Latin letters, other letters and the rest in classes."""
    out = np.where(codes < 128, codes, 131).astype(np.int64)
    out[(codes >= 0xC0) & (codes < 0x250)] = 128
    out[(codes >= 0x250) & (codes < 0x2000)] = 129
    out[(codes >= 0x2000) & (codes < 0x2070)] = 130
    out[codes >= 0x2E80] = 132
    out[(out < 33) | (codes == 0xA0)] = 32
    return out


def _allowed() -> np.ndarray:
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[1 + 2 * k, 2 + 2 * k] = ok[2 + 2 * k, 2 + 2 * k] = True
    return ok


ALLOWED = _allowed()
OPENS, BEGINS, ONS = np.r_[0, np.arange(1, TAGS, 2)], np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)


def new_model(rng: np.random.Generator) -> dict[str, np.ndarray]:
    h, k = UNITS, UNITS + CODE + 1
    w = rng.normal(0, 1, (2, 4 * h, k)) * np.r_[np.full(h, 1.5 / np.sqrt(h)), np.full(CODE, 1.0), 0.0]
    w[:, h : 2 * h, -1] = 1.0  # forget gates begin open
    m = {"code": rng.normal(0, 1, (ALPHABET, CODE)), "w": w, "leave": np.zeros(TAGS), "enter": np.zeros(TAGS), "within": np.zeros((2, len(KINDS))), "out": rng.normal(0, 0.2, (2, TAGS, h)), "out_b": np.zeros(TAGS)}
    m["out_b"][0] = 1.0
    return {k: v.astype(np.float32) for k, v in m.items()}


def _bent(x: np.ndarray, room: np.ndarray, out: np.ndarray) -> np.ndarray:
    np.abs(x, out=room)
    room += 1
    return np.divide(x, room, out=out)


def emissions(m: dict, ids: np.ndarray, saved: list | None = None) -> np.ndarray:
    """Scores (time, tags, windows) of ids (time, windows); saved gets what backward() needs."""
    h, (steps, n) = UNITS, ids.shape
    codes = np.ascontiguousarray(m["code"][ids].transpose(0, 2, 1))
    # twice the state is kept, so that nothing need be halved
    w, out = m["w"].copy(), 0.5 * m["out"]
    w[:, :, :h] *= 0.5
    x = np.zeros((2, h + CODE + 1, n), np.float32)
    x[:, -1] = 1
    cell, z, room = np.zeros((2, h, n), np.float32), np.empty((2, 4 * h, n), np.float32), np.empty((2, 4 * h, n), np.float32)
    part = np.empty((2, TAGS, n), np.float32)
    emit = np.empty((steps, TAGS, n), np.float32)
    emit[:] = m["out_b"][:, None]
    state, small = x[:, :h], room[:, :h]
    i, f, o, g = (z[:, k * h : (k + 1) * h] for k in range(4))
    for t in range(steps):
        x[0, h : h + CODE], x[1, h : h + CODE] = codes[t], codes[-1 - t]
        np.matmul(w, x, out=z)
        _bent(z, room, z)
        if saved is not None:
            saved.append((x.copy(), z.copy(), cell.copy()))
        z[:, : 3 * h] += 1
        cell *= f
        i *= g
        cell += i
        cell *= 0.5
        _bent(cell, small, state)
        state *= o
        np.matmul(out, state, out=part)
        emit[t] += part[0]
        emit[-1 - t] += part[1]
    return emit


def backward(m: dict, ids: np.ndarray, saved: list, grad: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the weights from those of the emissions."""
    h, steps = UNITS, len(ids)
    grads = {"w": np.zeros_like(m["w"]), "out": np.zeros_like(m["out"]), "out_b": grad.sum(axis=(0, 2))}
    ds, dc = np.zeros((2, h, ids.shape[1]), np.float32), np.zeros((2, h, ids.shape[1]), np.float32)
    codes = np.zeros((steps, CODE, ids.shape[1]), np.float32)
    back_out, back = m["out"].transpose(0, 2, 1), m["w"].transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        x, y, before = saved[t]
        x[:, :h] *= 0.5
        slope = (1 - np.abs(y)) ** 2
        i, f, o, g = 0.5 * y[:, :h] + 0.5, 0.5 * y[:, h : 2 * h] + 0.5, 0.5 * y[:, 2 * h : 3 * h] + 0.5, y[:, 3 * h :]
        cell = f * before + i * g
        bent = cell / (1 + np.abs(cell))
        d = np.stack([grad[t], grad[-1 - t]])
        grads["out"] += d @ (o * bent).transpose(0, 2, 1)
        ds += back_out @ d
        dc += ds * o * (1 - np.abs(bent)) ** 2
        dz = np.concatenate([0.5 * dc * g, 0.5 * dc * before, 0.5 * ds * bent, dc * i], axis=1) * slope
        grads["w"] += dz @ x.transpose(0, 2, 1)
        dx = back @ dz
        ds, dc = dx[:, :h], dc * f
        codes[t] += dx[0, h : h + CODE]
        codes[-1 - t] += dx[1, h : h + CODE]
    grads["code"] = np.zeros_like(m["code"])
    np.add.at(grads["code"], ids.ravel(), codes.transpose(0, 2, 1).reshape(-1, CODE))
    return grads


def crf(emit: np.ndarray, moves: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood over windows, and its gradients by emissions (time, windows, tags) and moves."""
    steps, n, _ = emit.shape
    shift = moves[ALLOWED].max()
    trans = np.where(ALLOWED, np.exp(moves - shift), 0.0)
    top = emit.max(axis=2, keepdims=True)
    e = np.exp(emit - top)
    a, b, scale = np.empty_like(e), np.empty_like(e), np.empty((steps, n, 1))
    first = np.ones(TAGS)
    first[2::2] = 0
    for t in range(steps):
        now = e[0] * first if t == 0 else (a[t - 1] @ trans) * e[t]
        scale[t] = now.sum(axis=1, keepdims=True)
        a[t] = now / scale[t]
    b[-1] = 1
    grad_moves = np.zeros_like(moves)
    for t in range(steps - 2, -1, -1):
        ahead = e[t + 1] * b[t + 1] / scale[t + 1]
        b[t] = ahead @ trans.T
        grad_moves += trans * (a[t].T @ ahead)
    grad = a * b
    z = (np.log(scale) + top).sum(axis=(0, 2)) + (steps - 1) * shift
    rows = np.arange(n)
    score = emit[np.arange(steps)[:, None], rows, gold].sum(axis=0) + moves[gold[:-1], gold[1:]].sum(axis=0)
    grad[np.arange(steps)[:, None], rows, gold] -= 1
    np.add.at(grad_moves, (gold[:-1].ravel(), gold[1:].ravel()), -1)
    return float((z - score).mean()), grad / n, grad_moves / n


def moves_of(m: dict) -> np.ndarray:
    """What each move from a tag to another scores: to the outside or a span's begin what leaving the one and entering the other score; within a kind a number of its own."""
    moves = m["leave"][:, None] + m["enter"]
    moves[BEGINS, ONS], moves[ONS, ONS] = m["within"]
    return moves


def viterbi(emit: np.ndarray, m: dict) -> np.ndarray:
    """The best tags (time, windows) for emissions (time, tags, windows). Of equal scores the lowest tag is taken."""
    steps, _, n = emit.shape
    leave, enter = m["leave"][:, None], m["enter"][OPENS][:, None]
    first, then = m["within"][0][:, None], m["within"][1][:, None]
    score, most = np.empty_like(emit), np.empty((steps, n), emit.dtype)
    score[0] = emit[0]
    score[0, ONS] -= INSIDE  # a window may begin inside a span, at some cost
    source, on = np.empty((TAGS, n), emit.dtype), np.empty((len(KINDS), n), emit.dtype)
    for t in range(1, steps):
        before, now = score[t - 1], score[t]
        np.add(before, leave, out=source)
        np.max(source, axis=0, out=most[t])
        np.add(before[1::2], first, out=now[2::2])
        np.add(before[2::2], then, out=on)
        np.maximum(now[2::2], on, out=now[2::2])
        now[0], now[1::2] = most[t] + enter[0], most[t] + enter[1:]
        now += emit[t]
    tags = np.zeros((steps, n), np.int64)
    tags[-1] = score[-1].argmax(axis=0)
    for t in range(steps - 1, 0, -1):
        # nearly everywhere the outside follows the outside
        odd = np.flatnonzero((tags[t] != 0) | (score[t - 1, 0] + leave[0] < most[t]))
        if not len(odd):
            continue
        now, before = tags[t, odd], score[t - 1][:, odd]
        best = (before + leave).argmax(axis=0)
        inner = np.flatnonzero((now > 0) & (now % 2 == 0))
        kind = now[inner] // 2 - 1
        stays = before[now[inner], inner] + then[kind, 0] > before[now[inner] - 1, inner] + first[kind, 0]
        best[inner] = now[inner] - 1 + stays
        tags[t - 1, odd] = best
    return tags


class Maker:
    """Personal data and look-alikes, invented."""

    def __init__(self, rng: np.random.Generator):
        self.rng, self.words = rng, []

    def pick(self, *options):
        return options[int(self.rng.integers(len(options)))]

    def digits(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def some(self, alphabet: str, n: int) -> str:
        return "".join(alphabet[i] for i in self.rng.integers(0, len(alphabet), n))

    def name(self) -> str:
        if self.words and self.rng.random() < 0.5:
            return self.words[int(self.rng.integers(len(self.words)))]
        return self.some("etaoinshrdlucmfwypvbgkjqxz"[: int(self.rng.integers(8, 27))], int(self.rng.integers(2, 13)))

    def email(self):
        user = self.name() + self.pick("", "", f".{self.digits(2)}", f".{self.name()}", f"_{self.name()}", self.digits(int(self.rng.integers(1, 5))), f"+{self.name()}", f"-{self.name()}")
        if self.rng.random() < 0.15:
            user = self.pick("é", "ß", "ñ", "ö") + user
        host = self.pick("", "", f"{self.name()}.", f"mail{self.digits(1)}.") + self.pick(self.name(), "example", f"{self.name()}-{self.name()}")
        return "", f"{user}@{host}.{self.pick('com', 'org', 'net', 'de', 'fr', 'es', 'io', 'co.uk')}", ""

    def phone(self):
        d = self.digits
        return "", self.pick(f"+{self.pick('1', '1', d(1), '4' + d(1), '3' + d(1))} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(2)} {d(7)}", f"+{d(2)} {d(3)} {d(3)} {d(3)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{d(2)}-{d(3)}-{d(7)}", f"0{d(2)} {d(4)} {d(4)}", f"+{d(11)}", f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}"), ""

    def ip(self):
        if self.rng.random() < 0.12:
            return "", ":".join(self.some("0123456789abcdef", 4) for _ in range(8)), ""
        return "", ".".join(str(int(x)) for x in self.rng.integers(0, 256, 4)), ""

    def card(self):
        d = self.digits
        return "", self.pick(d(16), d(16), d(16), " ".join(d(4) for _ in range(4)), "-".join(d(4) for _ in range(4)), f"{d(4)} {d(6)} {d(5)}", d(15)), ""

    def secret(self):
        if self.rng.random() < 0.1:
            return f"{self.pick('password', 'passwd', 'secret', 'passphrase')}{self.pick(' = ', '=', ': ')}{(q := self.pick(chr(34), chr(39)))}", self.some("abcdefghijklmnopqrstuvwxyz", int(self.rng.integers(10, 25))), q
        alphabet = self.pick("0123456789abcdef", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
        n = int(self.rng.integers(16, 65)) if self.rng.random() < 0.5 else self.pick(32, 40, 40)
        value = self.pick("", "", "", "sk-", "ghp_", "AKIA") + self.some(alphabet, n)
        key, quote = self.pick("token", "token", "api_key", "secret", "password", "key", "access_key", "auth_token"), self.pick('"', '"', "'", "")
        return f"{key}{self.pick(' = ', ' = ', '=', ': ', ':')}{quote}" if self.rng.random() < 0.85 else quote, value, quote

    def id(self):
        d = self.digits
        return "", self.pick(f"{d(3)}-{d(2)}-{d(4)}", f"{self.pick('DE', 'FR', 'ES', 'GB')}{d(20)}", f"{self.pick('DE', 'FR', 'ES', 'GB')}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}"), ""

    def harmless(self) -> str:
        d = self.digits
        return self.pick(d(1), d(2), d(4), f"{d(1)}.{d(1)}", f"{d(2)},{d(2)}", f"{d(1)},{d(3)},{d(3)}", f"20{d(2)}-0{d(1)}-1{d(1)}", f"{d(1)}{d(1)}/{d(2)}/20{d(2)}", f"{d(2)}:{d(2)}", f"v{d(1)}.{d(1)}.{d(1)}", f"${d(3)}", f"{d(2)}%", f"({d(4)})", f"{d(3)}", f"@{self.name()}", f"{d(5)}", f"{self.name()}{d(2)}", f"{d(6)}", f"{self.name()} {d(1)}.{d(1)}.", f"{self.name()}-{self.name()} {d(1)}.{d(1)}", f"version {d(1)}.{d(1)}.{d(1)}", f"page {d(3)}", f"{self.name()}={d(1)}")


def examples(texts: list[str], rng: np.random.Generator, n: int, length: int, hard: list[tuple[int, int]] = []) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """(ids, tags), (length, n) each: windows of the texts into which labelled spans are set between words.

    hard: (text, place) of what was wrongly taken for a span; a share HARD of the windows is cut there.
    """
    make = Maker(rng)
    all_ids, all_tags = [], []
    while len(all_ids) < n:
        text = texts[int(rng.integers(len(texts)))] if texts else " ".join(make.name() for _ in range(60))
        begin = int(rng.integers(max(1, len(text) - length)))
        if hard and rng.random() < HARD:
            which, at = hard[int(rng.integers(len(hard)))]
            text, begin = texts[which], max(0, at - int(rng.integers(8, length - 24)))
        words = re.split(r"( +)", text[begin : begin + length])
        make.words = [w.lower() for w in words if w.isalpha()]
        places = {int(rng.integers(0, len(words))) for _ in range(int(rng.integers(0, 4)))}
        junk = make.pick(*[[""]] * 5, ["***", "%%%", "&&&", "$$$", "###"], ["!!"], [" |"])
        out, tags = [], []

        def put(s: str, kind: int | None = None) -> None:
            out.append(s)
            if s:
                tags.extend([0] * len(s) if kind is None else [1 + 2 * kind] + [2 + 2 * kind] * (len(s) - 1))

        for i, w in enumerate(words):
            if i in places:
                if rng.random() < 0.3:
                    put(make.harmless())
                else:
                    kind = int(rng.integers(len(KINDS)))
                    before, value, after = getattr(make, KINDS[kind])()
                    put(before)
                    put(value, kind)
                    put(after)
                put(make.pick("", "", "", ".", ",", ";", ")", "!", "\n") + junk[i % len(junk)] + " ")
            elif w and not MARK.search(w):
                put(w + (junk[i % len(junk)] if w.strip() else ""))
        s = "".join(out)
        if rng.random() < 0.08 and len(s.upper()) == len(s):
            s = s.upper()
        at = int(rng.integers(max(1, len(s) - length + 1)))
        s, tags = (s[at : at + length]).ljust(length), tags[at : at + length]
        if tags and tags[0] and tags[0] % 2 == 0:  # the window begins inside a span
            tags[0] -= 1
        all_ids.append(char_ids(np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32)))
        all_tags.append(tags + [0] * (length - len(tags)))
    return np.array(all_ids).T, np.array(all_tags).T


def fit(texts: list[str], seed: int = 11, steps: int = STEPS) -> dict[str, np.ndarray]:
    """A model trained by Adam on spans set into the texts; without texts, into invented words.

    Words of the texts that hold a mark are taken out. On the way the model decodes the texts: all that it finds there is
    wrong, and later windows are cut at such places more often.
    """
    rng = np.random.default_rng(seed)
    texts = [t for t in (" ".join(w for w in text.split(" ") if not MARK.search(w)) for text in texts) if t.strip()]
    m = new_model(rng)
    first, second = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}
    hard: list[tuple[int, int]] = []
    for step in range(1, steps + 1):
        if step == int(MINE * steps) and texts:
            hard = [(i, b) for i, spans in enumerate(find(texts, m)) for b, _, _ in spans]
        ids, gold = examples(texts, rng, BATCH, LENGTH, hard)
        saved: list = []
        emit = emissions(m, ids, saved)
        _, grad, grad_moves = crf(emit.transpose(0, 2, 1).astype(np.float64), moves_of(m).astype(np.float64), gold)
        grads = backward(m, ids, saved, np.ascontiguousarray(grad.transpose(0, 2, 1).astype(np.float32)))
        grads["within"] = np.stack([grad_moves[BEGINS, ONS], grad_moves[ONS, ONS]])
        grad_moves[:, ONS] = 0
        grads["leave"], grads["enter"] = grad_moves.sum(axis=1), grad_moves.sum(axis=0)
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
        scale = min(1.0, 5.0 / max(norm, 1e-9))
        rate = RATE * min(1.0, step / 20) * (1 - 0.95 * step / steps)
        for k, g in grads.items():
            g = g * scale
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            m[k] = (m[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return m


def decode(m: dict, ids: np.ndarray) -> np.ndarray:
    """The tags (time, windows) of ids (time, windows)."""
    return viterbi(emissions(m, ids), m)


def window_spans(tags: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(window, begin, end, kind) of the spans in tags (windows, time)."""
    flat = np.pad(tags, ((0, 0), (1, 1)))
    kind = (flat + 1) // 2
    starts = (kind != 0) & ((kind != np.roll(kind, 1, axis=1)) | (flat % 2 == 1))
    out = []
    for w, b in zip(*np.nonzero(starts)):
        e = b + 1
        while kind[w, e] == kind[w, b] and not starts[w, e]:
            e += 1
        out.append((int(w), int(b) - 1, int(e) - 1, int(kind[w, b]) - 1))
    return out


def reconcile(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int]]:
    """Disjoint (begin, end, kind) from the spans of overlapping windows: (begin, end, kind, window's begin, window's end).

    A span that its window's edge cuts is joined with spans of the same kind that it overlaps or touches. Of spans that
    still overlap, those disjoint ones are chosen whose weights have the greatest sum: a span weighs its length times
    how far its window's nearer edge is from it, so the window that sees more around it has its say. Of choices that
    weigh the same, the one without the span that ends last (of spans that end alike: begins last) is taken.
    """
    spans = sorted({(b, e, k, min(b - wb, we - e), (b == wb and b > 0), e == we) for b, e, k, wb, we in found})
    joined: list[list] = []
    reach: list[list] = []  # those that end at b or after it
    for b, e, k, room, cut_b, cut_e in spans:
        reach = [s for s in reach if s[1] >= b]
        for s in reversed(reach):
            if s[2] == k and (cut_b or s[5] or s[4] and s[0] == b):
                s[0], s[1], s[3], s[5] = min(s[0], b), max(s[1], e), max(s[3], room), cut_e if e >= s[1] else s[5]
                break
        else:
            joined.append([b, e, k, room, cut_b, cut_e])
            reach.append(joined[-1])
    joined.sort(key=lambda s: (s[1], s[0], s[2]))
    best: list[tuple[float, tuple]] = [(0.0, ())]
    ends = [0]
    for b, e, k, room, _, _ in joined:
        at = int(np.searchsorted(ends, b, "right")) - 1
        score = best[at][0] + (e - b) * (1 + room)
        if score > best[-1][0]:
            best.append((score, (at, b, e, k)))
        else:
            best.append((best[-1][0], (len(best) - 1, None, None, None)))
        ends.append(e)
    out, at = [], len(best) - 1
    while at:
        before, b, e, k = best[at][1]
        if b is not None:
            out.append((b, e, k))
        at = before
    return out[::-1]


#: What a span of each kind grows over to its left and right: it doesn't end within a word or number of its own.
GROWS = {"email": (r"[\w.+-]", r"[\w-]|\.(?=\w)"), "secret": (r"[A-Za-z0-9_-]", r"[A-Za-z0-9_-]")}
DIGIT = re.compile("[0-9]")


def grown(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Disjoint spans, each to the edges of its word or number, though not into the next."""
    out, at = [], 0
    for i, (b, e, k) in enumerate(spans):
        left, right = _edges(KINDS[k])
        stop = spans[i + 1][0] if i + 1 < len(spans) else len(text)
        while b > at and left.match(text, b - 1):
            b -= 1
        while e < stop and right.match(text, e):
            e += 1
        out.append((b, e, k))
        at = e
    return out


def _edges(kind: str) -> tuple[re.Pattern, re.Pattern]:
    left, right = GROWS.get(kind, (DIGIT, DIGIT))
    return re.compile(left), re.compile(right)


def find(texts: list[str | None], m: dict) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (begin, end, kind) in characters: every window of every text is decoded."""
    windows: dict[int, list[tuple[int, int, int, np.ndarray]]] = {}
    for i, text in enumerate(texts):
        if not text:
            continue
        ids = char_ids(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)).astype(np.int16)
        for at in range(0, max(1, len(ids) - (WINDOW - STRIDE)), STRIDE):
            part = ids[at : at + WINDOW]
            windows.setdefault(-(-len(part) // FILL) * FILL, []).append((i, at, len(ids), part))
    found: list[list] = [[] for _ in texts]
    for length, own in windows.items():
        for b in range(0, len(own), AT_ONCE):
            some = own[b : b + AT_ONCE]
            ids = np.full((length, len(some)), 32, np.int16)
            for j, (_, _, _, part) in enumerate(some):
                ids[: len(part), j] = part
            tags = decode(m, ids)
            hold = np.flatnonzero(tags.any(axis=0))
            for w, begin, end, kind in window_spans(np.ascontiguousarray(tags[:, hold].T)):
                i, at, n, _ = some[hold[w]]
                if (end := min(at + end, n)) > at + begin:
                    found[i].append((at + begin, end, kind, at, at + WINDOW if at + WINDOW < n else n + WINDOW))
    return [grown(texts[i], reconcile(f)) if f else [] for i, f in enumerate(found)]


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for b, e, k in spans:
        out += [text[at:b], f"[{KINDS[k].upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def train(docs: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """A model whose training windows are cut from at most ``sample`` texts, chosen by a hash; labelled spans are set into them.

    Rows alike in doc_id and text count once. Without texts the windows are of invented words.
    """
    rows = frame.plain(docs, doc_id="long", text="string").where("text IS NOT NULL AND text != ''")
    few = frame.sampled(rows, "doc_id", sample).toPandas().sort_values(["doc_id", "text"])
    return fit(few["text"].tolist())


def redacted(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """All rows and columns of docs; in the text each span is replaced by its kind, as [EMAIL]. Other columns keep their values.

    Null texts stay null and empty ones empty; the whole text is searched, whatever its length; repeated rows are
    redacted alike.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at, bare = frame.position(docs, text), frame.unnamed(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in frame.steps(batch, at):
                texts = part.column(at).to_pylist()
                new = [t if not s else redact(t, s) for t, s in zip(texts, find(texts, sent.value))]
                yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    return bare.mapInArrow(frame.trimmed(run), bare.schema).toDF(*docs.columns)


def searched(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, text, spans): each document with its redacted text and the spans (begin, end, kind) in its own text.

    Null texts have null spans; texts without personal data have none. Repeated rows give repeated rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in frame.steps(batch, 1):
                texts = part.column(1).to_pylist()
                found = find(texts, sent.value)
                new = pa.array([t if not s else redact(t, s) for t, s in zip(texts, found)], pa.string())
                spans = pa.array([None if t is None else [{"begin": b, "end": e, "kind": KINDS[k]} for b, e, k in s] for t, s in zip(texts, found)], kind)
                yield pa.record_batch([part.column(0), new, spans], ["doc_id", "text", "spans"])

    return frame.plain(docs, doc_id="long", text="string").mapInArrow(frame.trimmed(run), "doc_id long, text string, spans array<struct<begin int, end int, kind string>>")


def query(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with their personal data replaced."""
    docs = frame.read(spark, folder, "documents")
    return searched(docs, train(docs))
