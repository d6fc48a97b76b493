"""Personal data: fixed patterns plus a character-level bidirectional LSTM with a CRF, trained in numpy.

The patterns find the plain forms. The network adds written-around forms (jane (at) mail.example, 988-555-2485,
4984.2504.8966.9609, 10[.]0[.]0[.]7). It is trained from labelled spans; by default from a seeded generator of such
spans, so the model is the same everywhere and needs no data. Texts are covered by overlapping windows around each
trigger (a digit, an at sign or a bracketed "at") that no pattern has claimed: a span without one can't be added,
so other text needs no network. Windows are decoded by Viterbi and reconciled over the whole text: a span that
a window's edge cuts gives way to the one a neighbour sees whole. An added span must have its kind's make-up (digits,
parts, check sum) and may not overlap a pattern's span.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm.common import prepare

KINDS = ("email", "ip", "card", "phone")
#: The plain forms.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
Span = tuple[str, int, int]

#: Window and stride, in characters: a span of up to their difference, 96, lies whole in some window wherever it is.
WINDOW, STRIDE = 160, 64
EMBED, HIDDEN = 10, 20
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
_TRIGGER = re.compile(r"[0-9@]|[\[({<]\x20?[aA][tT]\x20?[\])}>]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _byte(digits: str) -> bool:
    """Whether a run of digits, however long, is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def _valid(kind: str, text: str) -> bool:
    digits = re.sub(r"[^0-9]", "", text)
    if kind == "ip":
        return all(map(_byte, text.split(".")))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


# The same languages as PATTERNS, searched in time that grows with the text's length alone: nothing is tried again inside a
# run that has failed.
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LINEAR = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": PATTERNS["phone"],
}
_USER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign back over the user's name, as far as the match or the at sign before, and on over the host."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _USER:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
        done = host.end() if host else at + 1
        at = text.find("@", done)


def plain_spans(text: str) -> list[Span]:
    """Leftmost matches that don't overlap, for each kind on its own; failing matches are dropped without a retry."""
    # A text without what every match of a kind holds needs no search.
    digits = bool(_DIGIT.search(text))
    may = {"ip": digits and "." in text, "card": digits, "phone": digits and "+" in text}
    found = [("email", a, b) for a, b in _emails(text)]
    return found + [(kind, m.start(), m.end()) for kind, pattern in _LINEAR.items() if may[kind] for m in pattern.finditer(text) if _valid(kind, m[0])]


_DIGIT = re.compile("[0-9]")

_PUNCTUATION = " \n@.+-()[]{}<>_%:/,;#=*&|'\"!?"
_IDS = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz" + _PUNCTUATION)} | {str(d): 60 for d in range(10)}
ALPHABET = 64


def encode(text: str) -> list[int]:
    """Character classes: letters without case, digits as one, known punctuation, other letters, anything else."""
    return [_IDS.get(c) or _IDS.get(c.lower()) or (61 if c.isalpha() else 62) for c in text]


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """Bidirectional LSTM over embedded characters, a linear layer, and CRF transitions between tags."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        n = len(TAGS)
        self.p = {
            "embed": rng.normal(0, 0.3, (ALPHABET, EMBED)), "out": rng.normal(0, 0.1, (2 * HIDDEN, n)), "bias": np.zeros(n),
            "trans": rng.normal(0, 0.05, (n, n)),
        }
        for side in "fb":
            self.p["w" + side] = rng.normal(0, 1 / np.sqrt(EMBED + HIDDEN), (EMBED + HIDDEN, 4 * HIDDEN))
            self.p["c" + side] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        #: Tags that may not follow: an inside tag after anything but its own kind.
        self.banned = np.array([[b[0] == "I" and a[2:] != b[2:] for b in TAGS] for a in TAGS])
        self.no_start = np.array([t[0] == "I" for t in TAGS])

    def _run(self, x: np.ndarray, side: str, keep: bool):
        """x: (steps, batch, EMBED) in the direction's order."""
        w, c = self.p["w" + side], self.p["c" + side]
        steps, batch, _ = x.shape
        h, cell = np.zeros((batch, HIDDEN)), np.zeros((batch, HIDDEN))
        out, tape = np.zeros((steps, batch, HIDDEN)), []
        for t in range(steps):
            joint = np.concatenate([x[t], h], 1)
            z = joint @ w + c
            g = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, u = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            before = cell
            cell = f * cell + i * u
            squashed = np.tanh(cell)
            h = o * squashed
            out[t] = h
            if keep:
                tape.append((joint, i, f, o, u, before, squashed))
        return out, tape

    def _back(self, grad: np.ndarray, tape, side: str):
        w = self.p["w" + side]
        gw, gc, gx = np.zeros_like(w), np.zeros(4 * HIDDEN), np.zeros((len(tape), grad.shape[1], EMBED))
        dh, dc = np.zeros(grad.shape[1:]), np.zeros(grad.shape[1:])
        for t in range(len(tape) - 1, -1, -1):
            joint, i, f, o, u, before, squashed = tape[t]
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - squashed**2)
            dz = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - u**2)], 1)
            gw += joint.T @ dz
            gc += dz.sum(0)
            back = dz @ w.T
            gx[t], dh, dc = back[:, :EMBED], back[:, EMBED:], dc * f
        return gw, gc, gx

    def emissions(self, ids: np.ndarray, keep: bool = False):
        x = self.p["embed"][ids].transpose(1, 0, 2)
        ahead, tape_f = self._run(x, "f", keep)
        behind, tape_b = self._run(x[::-1], "b", keep)
        both = np.concatenate([ahead, behind[::-1]], 2)
        return both @ self.p["out"] + self.p["bias"], (both, tape_f, tape_b)

    def step(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of a batch and its gradients."""
        e, (both, tape_f, tape_b) = self.emissions(ids, True)
        trans, (steps, batch, n) = self.p["trans"], e.shape
        a = np.zeros_like(e)
        a[0] = e[0]
        for t in range(1, steps):
            a[t] = _logsum(a[t - 1][:, :, None] + trans, 1) + e[t]
        z = _logsum(a[-1], 1)
        b = np.zeros_like(e)
        gt = np.zeros_like(trans)
        for t in range(steps - 2, -1, -1):
            onward = trans + (e[t + 1] + b[t + 1])[:, None, :]
            b[t] = _logsum(onward, 2)
            gt += np.exp(a[t][:, :, None] + onward - z[:, None, None]).sum(0)
        ge = np.exp(a + b - z[None, :, None])
        y, rows = tags.T, np.arange(batch)
        gold = e[np.arange(steps)[:, None], rows[None, :], y].sum(0) + trans[y[:-1], y[1:]].sum(0)
        ge[np.arange(steps)[:, None], rows[None, :], y] -= 1
        np.add.at(gt, (y[:-1].ravel(), y[1:].ravel()), -1)
        ge /= batch
        g = {"trans": gt / batch, "out": np.einsum("tbh,tbn->hn", both, ge), "bias": ge.sum((0, 1))}
        gb = ge @ self.p["out"].T
        g["wf"], g["cf"], gx = self._back(gb[:, :, :HIDDEN], tape_f, "f")
        g["wb"], g["cb"], gy = self._back(gb[::-1, :, HIDDEN:], tape_b, "b")
        g["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(g["embed"], ids.T, gx + gy[::-1])
        return float((z - gold).mean()), g

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The best tags of each window, by Viterbi."""
        e, _ = self.emissions(ids)
        trans = np.where(self.banned, -1e9, self.p["trans"])
        best, back = e[0] - 1e9 * self.no_start, np.zeros(e.shape, np.int64)
        for t in range(1, len(e)):
            moves = best[:, :, None] + trans
            back[t] = moves.argmax(1)
            best = moves.max(1) + e[t]
        out = np.zeros((ids.shape[0], len(e)), np.int64)
        out[:, -1] = best.argmax(1)
        for t in range(len(e) - 1, 0, -1):
            out[:, t - 1] = back[t][np.arange(len(out)), out[:, t]]
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def fit(rows: Sequence[tuple[str, Sequence[Span]]], steps: int = 320, batch: int = 48, rate: float = 0.02, length: int = 72, seed: int = 3) -> Tagger:
    """Train from texts with labelled spans; each step draws windows of `length` characters that hold or lack spans."""
    rng, model = random.Random(seed), Tagger(seed)
    coded = []
    for text, spans in rows:
        tags = [0] * len(text)
        for kind, start, end in spans:
            k = 1 + 2 * KINDS.index(kind)
            tags[start:end] = [k] + [k + 1] * (end - start - 1)
        pad = max(0, length - len(text))
        coded.append((encode(text) + [_IDS["\n"]] * pad, tags + [0] * pad))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    for t in range(1, steps + 1):
        picks = []
        for x, y in rng.choices(coded, k=batch):
            at = rng.randrange(len(x) - length + 1)
            while at and TAGS[y[at]][0] == "I":  # a cut span has no begin tag
                at -= 1
            picks.append((x[at : at + length], y[at : at + length]))
        _, grads = model.step(np.array([p[0] for p in picks]), np.array([p[1] for p in picks]))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        speed = rate * min(1.0, 2 * (1 - t / (steps + 1)))
        for k, g in grads.items():
            m, v = moment[k]
            g = g * min(1.0, 5.0 / (norm + 1e-12))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            model.p[k] -= speed * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return model


def example(rng: random.Random) -> tuple[str, list[Span]]:
    """A labelled text: invented words with personal data in plain and written-around forms, and look-alikes."""
    letters = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéüñ") if rng.random() < 0.97 else "ß" for _ in range(rng.randint(a, b)))
    name = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card() -> list[str]:
        body = rng.choice("3456") + num(14)
        digits = body + next(d for d in "0123456789" if luhn(body + d))
        return [digits[i : i + 4] for i in range(0, 16, 4)]

    def email() -> str:
        user = rng.choice([name(2, 9), f"{name(2, 7)}.{num(2)}", f"{name(2, 6)}_{name(2, 6)}", f"{name(1, 5)}.{name(2, 8)}", f"{name(3, 6)}{num(2)}"])
        host = rng.choice([f"{name(3, 8)}.com", f"mail{num(1)}.example.com", f"{name(2, 6)}.{name(3, 6)}.org", f"{name(3, 8)}.de", f"{name(3, 7)}-{name(2, 5)}.net"])
        at = rng.choice(["@", "@", " @ ", "(at)", " (at) ", "[at]", " [at] ", " {at} ", " <at> "])
        dot = "." if at == "@" and rng.random() < 0.7 else rng.choice([".", " . ", " [dot] ", " (dot) ", "[.]"])
        return user + at + host.replace(".", dot)

    def ip() -> str:
        return rng.choice([".", ".", "[.]", "(.)", " . ", "[dot]", ","]).join(str(rng.randint(0, 255)) for _ in range(4))

    def phone() -> str:
        a, b, c = str(rng.randint(200, 999)), num(3), num(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"00{num(2)} {num(2)} {num(7)}", f"+{num(2)} {num(3)} {num(6)}", f"{a} {b} {c}", f"({a}) {b} {c}", f"+1/{a}/{b}/{c}", f"({a}){b}-{c}", f"+{num(2)}-{num(2)}-{num(4)}-{num(4)}"])

    def other() -> str:
        hexa = "".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(8, 32)))
        return rng.choice([hexa, f'token = "{hexa}"', f"password={hexa}", f"AKIA{name(4, 8).upper()}{num(3)}{name(3, 6).upper()}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}", f"{num(1)}.{num(1)}.{num(1)}", f"${num(3)}.{num(2)}", num(rng.randint(1, 8)), f"#{num(6)}", f"v{num(1)}.{num(2)}", f"({num(4)})", f"{num(1)},{num(3)},{num(3)}", f"{num(3)} {name(2, 5)}", f"@{name(3, 9)}", f"{name(3, 6)}[{num(1)}]", f"https://{name(3, 7)}.com/{num(4)}", f"version {num(1)}", f"{num(2)}%"])

    parts, spans, at = [], [], 0
    for _ in range(rng.randint(8, 18)):
        draw = rng.random()
        kind = None
        if draw < 0.12:
            kind = rng.choice(KINDS)
            text = {"email": email, "ip": ip, "phone": phone, "card": lambda: rng.choice(["", " ", "-", ".", "_", "/", "  "]).join(card())}[kind]()
        elif draw < 0.2:
            text = other()
        else:
            text = letters(1, 10)
            text = text.capitalize() if rng.random() < 0.15 else text
        if kind:
            spans.append((kind, at, at + len(text)))
        text += rng.choice([" ", " ", " ", " ", ", ", ". ", ".\n", "\n"]) if not kind or rng.random() < 0.8 else rng.choice([", ", ". ", ") ", "; "])
        parts.append(text)
        at += len(text)
    return "".join(parts), spans


@lru_cache(maxsize=1)
def default_tagger() -> Tagger:
    rng = random.Random(11)
    return fit([example(rng) for _ in range(4000)])


def _make_up(kind: str, text: str) -> bool:
    """What any span of the kind has, however it is written."""
    digits = re.sub(r"[^0-9]", "", text)
    if kind == "email":
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+\s?(?:@|[\[({<]\s?at\s?[\])}>])\s?[A-Za-z0-9-]+(?:\s?[\[({]?\s?(?:\.|dot)\s?[\])}]?\s?[A-Za-z0-9-]+)+", text, re.I))
    if kind == "ip":
        numbers = re.findall("[0-9]+", text)
        return len(numbers) == 4 and all(map(_byte, numbers)) and len(set(re.sub("[0-9]+", " ", text).split())) == 1
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and not re.search("[A-Za-z]", text)
    return 9 <= len(digits) <= 15 and not re.search("[^0-9 ()+./-]", text)


def added_spans(text: str, claimed: Sequence[Span], model: Tagger, batch: int = 256) -> list[Span]:
    """Spans the network finds outside the claimed ones, over the whole text."""
    taken = sorted((a, b) for _, a, b in claimed)
    free, j = [], 0
    for m in _TRIGGER.finditer(text):
        while j < len(taken) and taken[j][1] <= m.start():
            j += 1
        if j == len(taken) or m.start() < taken[j][0]:
            free.append(m.start())
    if not free:
        return []
    starts: list[int] = []
    for at in free:  # windows on a fixed grid, each that has the trigger
        for g in range(max(0, (at - WINDOW) // STRIDE + 1), at // STRIDE + 1):
            if not starts or g * STRIDE > starts[-1]:
                starts.append(g * STRIDE)
    found: dict[Span, int] = {}
    for low in range(0, len(starts), batch):
        part = starts[low : low + batch]
        ids = np.full((len(part), WINDOW), _IDS["\n"])
        for i, s in enumerate(part):
            x = encode(text[s : s + WINDOW])
            ids[i, : len(x)] = x
        for s, tags in zip(part, model.decode(ids)):
            size, t = min(WINDOW, len(text) - s), 0
            while t < size:
                if tags[t] == 0:
                    t += 1
                    continue
                end = t + 1
                while end < size and tags[end] and TAGS[tags[end]][0] == "I":
                    end += 1
                kind = TAGS[tags[t]][2:]
                left = t if s else WINDOW
                right = size - end if s + size < len(text) else WINDOW
                span = (kind, s + t, s + end)
                if min(left, right) > 0:
                    found[span] = max(found.get(span, 0), min(left, right))
                t = end
    # Accepted spans and merged claimed ones, none of which overlap, by their starts: a new one need only be held against its neighbours.
    out: list[Span] = []
    placed: list[tuple[int, int]] = []
    for a, b in taken:
        if placed and a < placed[-1][1]:
            placed[-1] = (placed[-1][0], max(placed[-1][1], b))
        else:
            placed.append((a, b))
    for span in sorted(found, key=lambda x: (-found[x], x[1] - x[2], x[1], x[0])):
        kind, a, b = span
        body = text[a:b]
        a, b = a + len(body) - len(body.lstrip(" \n.,;:")), b - len(body) + len(body.rstrip(" \n.,;:"))
        if a >= b or not _make_up(kind, text[a:b]):
            continue
        at = bisect.bisect_left(placed, (a, b))
        if (at and placed[at - 1][1] > a) or (at < len(placed) and placed[at][0] < b):
            continue
        placed.insert(at, (a, b))
        out.append((kind, a, b))
    return out


def ordered(spans: Sequence[Span]) -> list[Span]:
    return sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def redact(text: str, spans: Sequence[Span]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one mark of the first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


FOUND = "id long, base array<struct<kind:string,start:int,end:int>>, added array<struct<kind:string,start:int,end:int>>, redacted string"


def find_pii(docs: DataFrame, model: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False) -> DataFrame:
    """One row per input row: id, the patterns' spans, the network's added spans (code points, end exclusive), and the
    redacted text if asked for.

    Null and empty texts have no spans; an empty table gives an empty result. Whole texts are read, however long, in time
    that grows with their length. Patterns of different kinds may overlap, added
    spans overlap none. Repeated rows and null ids are treated as any row; other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast((model or default_tagger()).p)  # a few thousand numbers
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger()
        tagger.p = shared.value
        for batch in batches:
            base, added, clean = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                plain = ordered(plain_spans(text))
                more = ordered(added_spans(text, plain, tagger))
                base.append([dict(zip(("kind", "start", "end"), x)) for x in plain])
                added.append([dict(zip(("kind", "start", "end"), x)) for x in more])
                clean.append(redact(text, plain + more) if redacted else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(added, span), pa.array(clean, pa.string())], names=["id", "base", "added", "redacted"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, FOUND).withColumnRenamed("id", id_col)


def listed(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered(spans))


def digest(spans: Sequence[Span]) -> str:
    return hashlib.sha256(listed(spans).encode()).hexdigest()
