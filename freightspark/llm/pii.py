"""Personal data: exact base patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The network reads overlapping windows of the stretches around triggers: digits, at signs, and the word "at" before
something that can be a host. A span that it adds must have the shape of its kind (`fits`), and every such shape holds
a trigger, so what is not read could not be added; a test embeds every rewritten form in plain letters. A stretch is
reconciled as a whole: each character's emissions are averaged over its windows, less at a window's edges, and one
Viterbi path goes through the stretch. Spans on the path are added if they touch no base span and are sure enough.

Training is numpy on the driver: windows from a bounded sample of documents (SAMPLE_DOCS, least hash of doc_id).
Labels are the base spans, numbers grouped like a card's whose check digit is wrong (a mistyped number is personal
data still), and secrets, values of 16 characters and more that are assigned to a token, key or password. Labelled
spans are rewritten besides in ways that the patterns miss ("name (at) host dot org", "10[.]0[.]0[.]1",
"(555) 010-0199", dotted card numbers). Secrets have columns of their own; `spans` has the four kinds.

Defined cases: null and empty texts have no spans; offsets are code points, ends exclusive; repeated rows give
repeated rows; very long texts are read whole, a long stretch in many windows; a sample without windows gives no
network and base spans only. Only doc_id and text are read, so other columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightspark.llm.common import blocks, lean

#: The first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL, IP, CARD, PHONE, SECRET = range(5)
BASE_KINDS = 4
SAMPLE_DOCS, TRAIN_WINDOWS = 4000, 3000
#: Code points of a window, its step in a long stretch, and what is read on each side of a trigger.
WINDOW, STEP, MARGIN = 96, 64, 40
#: SURE: least geometric mean of the probabilities of an added span's labels.
EMBED, HIDDEN, STEPS, BATCH, SURE = 12, 16, 600, 48, 0.8
#: Rewritten copies of a labelled span.
REWRITES = 2

_AT_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can only begin where a run of digits begins, so the look-behind changes nothing but the time on long runs.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+(?<=[0-9])")
#: Between the parts of a host, written out or in brackets.
_DOT = r"(?:[\[(]?\.[\])]?|\W{1,2}dot\W{1,2})"
_TRIGGER = re.compile(r"[0-9@]+|(?<=\W)at\W{1,2}[a-z0-9-]+" + _DOT + "[a-z0-9]", re.I)
_SHAPE = re.compile(r"[a-z0-9._%+-]+(?:\s?@\s?|\W{1,2}at\W{1,2})[a-z0-9-]+(?:" + _DOT + "[a-z0-9-]+)+", re.I)
_GROUPS = re.compile(r"(?<![0-9])(?:[0-9]{4}[ .-]?){3}[0-9]{4,7}(?![0-9])")
_SECRET = re.compile(r"(?:token|secret|password|passwd|key)\W{1,4}([a-z0-9+/_-]{16,})", re.I)
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the fixed patterns: leftmost, not overlapping within a kind; matches that fail their test are dropped."""
    out: list[Span] = []
    if "@" in text:
        last = 0
        for m in _AT_HOST.finditer(text):
            # what stands before the sign: the longest run of allowed characters, after the match before
            a = m.start()
            while a > last and text[a - 1] in _LOCAL:
                a -= 1
            if a < m.start():
                out.append((EMAIL, a, m.end()))
                last = m.end()
    if not _DIGIT.search(text):
        return out
    out.extend((IP, m.start(), m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m[0].split(".")))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((CARD, m.start(), m.end()))
    if "+" in text:
        out.extend((PHONE, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15)
    return out


def labelled_spans(text: str) -> list[Span]:
    """What the network learns from: the base spans, card-like numbers whatever their check digit, and assigned secrets."""
    out = base_spans(text)
    for kind, found in ((CARD, ((m.start(), m.end()) for m in _GROUPS.finditer(text))), (SECRET, (m.span(1) for m in _SECRET.finditer(text)))):
        out += [(kind, a, b) for a, b in found if all(e <= a or s >= b for _, s, e in out)]
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """(start, end) of the parts that the network reads: triggers with their margins, those that touch made one."""
    merged: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def windows(a: int, b: int) -> list[tuple[int, int]]:
    """Overlapping windows of a stretch."""
    out = []
    while b - a > WINDOW:
        out.append((a, a + WINDOW))
        a += STEP
    return [*out, (a, b)]


_CLASSES = 100


def char_classes(s: str) -> np.ndarray:
    """1: a digit; 2: another letter; 3: white space; 4: anything else beyond ASCII; from 5: ASCII, case folded. 0 pads."""
    code = np.frombuffer(s.lower().encode("utf-32-le", "surrogatepass"), np.uint32) if s.isascii() else np.array([ord(c.lower()[0]) for c in s], np.uint32)
    out = np.where((code > 32) & (code < 127), code - 32 + 4, 4).astype(np.int16)
    out[(code >= 48) & (code < 58)] = 1
    out[code >= 0xC0] = 2
    out[(code <= 32) | (code == 0xA0)] = 3
    return out


def padded(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in parts])
    x = np.zeros((len(parts), int(lengths.max())), np.int16)
    for i, p in enumerate(parts):
        x[i, : len(p)] = char_classes(p)
    return x, lengths


TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind


def tags_of(spans: list[Span], a: int, b: int) -> np.ndarray:
    y = np.zeros(b - a, np.int8)
    for kind, s, e in spans:
        if s < b and e > a:
            y[max(s, a) - a : min(e, b) - a] = 2 + 2 * kind
            if s >= a:
                y[s - a] = 1 + 2 * kind
    return y


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


@dataclass
class Network:
    """Weights: embedding, two LSTMs (input, recurrent, bias), output, CRF transitions."""

    w: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        u = lambda *n: (r.standard_normal(n) / np.sqrt(n[0])).astype(np.float32)
        w = {"embed": 0.3 * r.standard_normal((_CLASSES, EMBED)).astype(np.float32), "out": u(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            b = np.zeros(4 * HIDDEN, np.float32)
            b[HIDDEN : 2 * HIDDEN] = 1  # forget gates start open
            w |= {f"x{d}": u(EMBED, 4 * HIDDEN), f"h{d}": u(HIDDEN, 4 * HIDDEN), f"b{d}": b}
        return cls(w)

    def _lstm(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states of one direction; padded places keep the state unchanged."""
        n, length = x.shape
        w, table = self.w, self.w["embed"] @ self.w[f"x{d}"] + self.w[f"b{d}"]
        h = c = np.zeros((n, HIDDEN), np.float32)
        out, tape = np.zeros((n, length, HIDDEN), np.float32), []
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            z = table[x[:, t]] + h @ w[f"h{d}"]
            i, f, o = _sigmoid(z[:, :HIDDEN]), _sigmoid(z[:, HIDDEN : 2 * HIDDEN]), _sigmoid(z[:, 2 * HIDDEN : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, t, None]
            c2 = np.where(m, f * c + i * g, c)
            tc = np.tanh(c2)
            h2 = np.where(m, o * tc, h)
            if keep:
                tape.append((t, i, f, o, g, c, tc, h, m))
            h, c = h2, c2
            out[:, t] = h
        return out, tape

    def emissions(self, x: np.ndarray, mask: np.ndarray, keep: bool = False):
        hf, tf = self._lstm(x, mask, "f", keep)
        hb, tb = self._lstm(x, mask, "b", keep)
        h = np.concatenate((hf, hb), 2)
        return h @ self.w["out"] + self.w["out_b"], h, tf, tb

    def chain(self, e: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """log partition, marginals, forward and backward scores of the CRF."""
        trans, length = self.w["trans"], e.shape[1]
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for t in range(1, length):
            step = _logsumexp(alpha[:, t - 1, :, None] + trans, 1) + e[:, t]
            alpha[:, t] = np.where(mask[:, t, None], step, alpha[:, t - 1])
        for t in range(length - 2, -1, -1):
            step = _logsumexp(trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], step, beta[:, t + 1])
        z = _logsumexp(alpha[:, -1], 1)
        return z, np.exp(np.clip(alpha + beta - z[:, None, None], -60, 0)), alpha, beta

    def emit(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return self.emissions(x, np.arange(x.shape[1]) < lengths[:, None])[0]

    def best(self, e: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best labels (Viterbi) of padded emissions, and the marginal probability of each label."""
        mask = np.arange(e.shape[1]) < lengths[:, None]
        _, marginal, *_ = self.chain(e, mask)
        trans, length, n = self.w["trans"], e.shape[1], len(e)
        score, back = e[:, 0], np.zeros(e.shape, np.int8)
        for t in range(1, length):
            step = score[:, :, None] + trans
            back[:, t] = np.where(mask[:, t, None], step.argmax(1), np.arange(TAGS))
            score = np.where(mask[:, t, None], step.max(1) + e[:, t], score)
        y = np.zeros((n, length), np.int8)
        y[:, -1] = score.argmax(1)
        for t in range(length - 1, 0, -1):
            y[:, t - 1] = back[np.arange(n), t, y[:, t]]
        return y, np.take_along_axis(marginal, y[:, :, None].astype(np.int64), 2)[:, :, 0]

    def gradients(self, x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the labels, and its gradient."""
        w, (n, length) = self.w, x.shape
        mask = np.arange(length) < lengths[:, None]
        e, h, tf, tb = self.emissions(x, mask, keep=True)
        z, marginal, alpha, beta = self.chain(e, mask)
        rows, trans = np.arange(n), w["trans"]
        gold = (np.take_along_axis(e, y[:, :, None].astype(np.int64), 2)[:, :, 0] * mask).sum(1)
        de = marginal * mask[:, :, None]
        np.subtract.at(de, (rows[:, None], np.arange(length)[None, :], y), mask)
        dtrans = np.zeros_like(trans)
        for t in range(1, length):
            on = mask[:, t]
            pair = np.exp(np.clip(alpha[on, t - 1, :, None] + trans + (e[on, t] + beta[on, t])[:, None, :] - z[on, None, None], -60, 0))
            dtrans += pair.sum(0)
            np.subtract.at(dtrans, (y[on, t - 1], y[on, t]), 1)
            gold[on] += trans[y[on, t - 1], y[on, t]]
        g = {"trans": dtrans, "out": np.einsum("bth,btk->hk", h, de), "out_b": de.sum((0, 1)), "embed": np.zeros_like(w["embed"])}
        dh_all = de @ w["out"].T
        for d, tape, own in (("f", tf, dh_all[:, :, :HIDDEN]), ("b", tb, dh_all[:, :, HIDDEN:])):
            dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
            dwh, dtable = np.zeros_like(w[f"h{d}"]), np.zeros((_CLASSES, 4 * HIDDEN), np.float32)
            for t, i, f, o, gg, c, tc, h0, m in reversed(tape):
                dh = dh + own[:, t]
                on = np.where(m, dh, 0)
                dct = np.where(m, dc, 0) + on * o * (1 - tc * tc)
                dz = np.concatenate((dct * gg * i * (1 - i), dct * c * f * (1 - f), on * tc * o * (1 - o), dct * i * (1 - gg * gg)), 1)
                dwh += h0.T @ dz
                np.add.at(dtable, x[:, t], dz)
                dh = np.where(m, 0, dh) + dz @ w[f"h{d}"].T
                dc = np.where(m, dct * f, dc)
            g[f"h{d}"], g[f"b{d}"], g[f"x{d}"] = dwh, dtable.sum(0), w["embed"].T @ dtable
            g["embed"] += dtable @ w[f"x{d}"].T
        return float((z - gold).mean()), {k: v / n for k, v in g.items()}


def train(examples: list[tuple[str, np.ndarray]], steps: int = STEPS, seed: int = 7) -> Network:
    """Adam over the labelled windows; examples of like length share a batch."""
    net, r = Network.fresh(seed), np.random.default_rng(seed)
    m, v, step = {k: np.zeros_like(x) for k, x in net.w.items()}, {k: np.zeros_like(x) for k, x in net.w.items()}, 0
    order = sorted(range(len(examples)), key=lambda i: (len(examples[i][0]), examples[i][0]))
    batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
    while step < steps:
        for k in r.permutation(len(batches))[: steps - step]:
            own = [examples[i] for i in batches[k]]
            x, lengths = padded([s for s, _ in own])
            y = np.zeros(x.shape, np.int8)
            for i, (_, t) in enumerate(own):
                y[i, : len(t)] = t
            _, g = net.gradients(x, y, lengths)
            step += 1
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            rate = 0.02 * (1 - step / (steps + 1)) + 0.0005
            for name, a in g.items():
                a = a * min(1.0, 5.0 / max(norm, 1e-9))
                m[name] = 0.9 * m[name] + 0.1 * a
                v[name] = 0.999 * v[name] + 0.001 * a * a
                net.w[name] = (net.w[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def rewritten(kind: int, span: str, r: np.random.Generator) -> str:
    """The span in a form that the patterns miss."""
    digits = _digits(span)
    if kind == EMAIL:
        local, _, host = span.partition("@")
        return local + str(r.choice([" at ", " (at) ", "[at]", " [at] "])) + host.replace(".", str(r.choice([".", ".", " dot ", "[.]"])))
    if kind == IP:
        return span.replace(".", str(r.choice(["[.]", "(.)", " . "])))
    if kind == CARD:
        return str(r.choice([".", "  ", "/", " - "])).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == SECRET:
        return span[: r.integers(16, len(span) + 1)]
    tail = digits[-10:]
    return str(r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "({}){}.{}"])).format(tail[:3], tail[3:6], tail[6:])


def examples_of(text: str, seed: int) -> Iterator[tuple[str, list[int], bool]]:
    """(window, tags, has a span): windows as they stand, and those with a rewritten span."""
    r, spans = np.random.default_rng(seed), labelled_spans(text)
    for a, b in (w for s in stretches(text) for w in windows(*s)):
        own = [s for s in spans if s[1] < b and s[2] > a]
        yield text[a:b], tags_of(own, a, b).tolist(), bool(own)
        whole = [s for s in own if s[1] >= a and s[2] <= b]
        if len(own) == len(whole) == 1:
            kind, s, e = whole[0]
            for _ in range(REWRITES):
                new = rewritten(kind, text[s:e], r)
                part = text[a:s] + new + text[e:b]
                yield part, tags_of([(kind, s - a, s - a + len(new))], 0, len(part)).tolist(), True


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, n_windows: int = TRAIN_WINDOWS, steps: int = STEPS) -> Network | None:
    """Train on windows of a bounded sample: at most `n_windows` with and half as many without a span."""
    ids = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                key = hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=7).digest()
                seed = int.from_bytes(key, "little")
                rows += [(hash_of(part, seed), part, tags, has) for part, tags, has in examples_of(text or "", seed)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.list_(pa.int8()), pa.bool_()), strict=True)], names=["at", "part", "tags", "has"])

    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    found = sample.mapInArrow(lean(cut_out), "at long, part string, tags array<byte>, has boolean").distinct()
    rows = [r for has, n in ((True, n_windows), (False, n_windows // 2)) for r in found.where(F.col("has") == has).orderBy("at", "part").limit(n).collect()]
    return train([(r.part, np.array(r.tags, np.int8)) for r in rows], steps) if rows else None


def hash_of(part: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(part.encode("utf-8", "surrogatepass"), digest_size=7, key=seed.to_bytes(7, "little")).digest(), "little")


def fits(kind: int, s: str) -> bool:
    """A span that the network adds has what its kind must have."""
    digits = _digits(s)
    if kind == EMAIL:
        return bool(_SHAPE.fullmatch(s))
    if kind == IP:
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == CARD:
        return 13 <= len(digits) <= 19
    if kind == SECRET:
        return len(s) >= 16 and not re.search(r"\s", s) and 0 < len(digits) < len(s)
    return 8 <= len(digits) <= 15


def spans_of(y: np.ndarray, p: np.ndarray, start: int) -> Iterator[tuple[int, int, int, float]]:
    """(kind, start, end, geometric mean of the probabilities) of the spans on a path."""
    begins = np.flatnonzero((y > 0) & ((y % 2 == 1) | np.concatenate(([True], (y[:-1] + 1) // 2 != (y[1:] + 1) // 2))))
    inside = np.concatenate(((y > 0), [False]))
    for a in begins.tolist():
        b = a + 1
        while inside[b] and y[b] == 2 + (int(y[a]) - 1) // 2 * 2:
            b += 1
        yield (int(y[a]) - 1) // 2, start + a, start + b, float(np.exp(np.log(np.maximum(p[a:b], 1e-9)).mean()))


def _batches(sizes: list[int], cells: int = 256 * WINDOW) -> Iterator[list[int]]:
    """Numbers of things of like size, as many as fill about `cells` when padded."""
    order = sorted(range(len(sizes)), key=sizes.__getitem__)
    own: list[int] = []
    for i in order:
        if own and (len(own) + 1) * sizes[i] > cells:
            yield own
            own = []
        own.append(i)
    if own:
        yield own


def find(texts: list[str], net: Network | None) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text."""
    base = [base_spans(t) for t in texts]
    added: list[list[Span]] = [[] for _ in texts]
    read = [(i, a, b) for i, t in enumerate(texts) for a, b in stretches(t)] if net else []
    total = [np.zeros((b - a, TAGS), np.float32) for _, a, b in read]
    share = [np.zeros((b - a, 1), np.float32) for _, a, b in read]
    parts = [(k, a, b) for k, (_, s, e) in enumerate(read) for a, b in windows(s, e)]
    for own in _batches([b - a for _, a, b in parts]):
        x, lengths = padded([texts[read[parts[j][0]][0]][parts[j][1] : parts[j][2]] for j in own])
        for j, n, e in zip(own, lengths.tolist(), net.emit(x, lengths), strict=True):
            k, a, _ = parts[j]
            at = slice(a - read[k][1], a - read[k][1] + n)
            weight = (1 + np.minimum(np.arange(n), np.arange(n)[::-1]))[:, None].astype(np.float32)
            total[k][at] += weight * e[:n]
            share[k][at] += weight
    for own in _batches([len(t) for t in total]):
        lengths = np.array([len(total[k]) for k in own])
        e = np.zeros((len(own), int(lengths.max()), TAGS), np.float32)
        for j, k in enumerate(own):
            e[j, : lengths[j]] = total[k] / share[k]
        for k, n, y, p in zip(own, lengths.tolist(), *net.best(e, lengths), strict=True):
            i, start, _ = read[k]
            for kind, a, b, sure in spans_of(y[:n], p[:n], start):
                if sure >= SURE and all(e <= a or s >= b for _, s, e in base[i]) and fits(kind, texts[i][a:b]):
                    added[i].append((kind, a, b))
    return list(zip(base, added, strict=True))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


_FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_secret long, secrets string, n_spans long"


def detect(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone of base spans, base_sha256, spans, n_added, n_secret, secrets, n_spans) of every document.

    n_added: spans of the four kinds that the network adds; n_spans: all spans, secrets too.
    """
    known = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, limit=1 << 18):
            rows = []
            for doc_id, (base, added) in zip(batch.column("doc_id").to_pylist(), find([t or "" for t in batch.column("text").to_pylist()], known.value), strict=True):
                counts = [sum(s[0] == k for s in base) for k in range(BASE_KINDS)]
                personal, secrets = [s for s in added if s[0] != SECRET], [s for s in added if s[0] == SECRET]
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                rows.append((doc_id, *counts, digest, written(base + personal), len(personal), len(secrets), written(secrets), len(base) + len(added)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _FOUND.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(lean(run), _FOUND)
