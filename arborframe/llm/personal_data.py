"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field reads white-space tokens and tags
them O, or begin/inside of email, ip, card or phone, so it finds what patterns
miss: kinds that run into each other, separators the patterns don't know,
national phone numbers, version 6 addresses, international mail addresses. Its
features are a token's word shape (runs of letters collapsed, runs of digits
with their length), counts in it, and the shapes of its neighbours. Weights are
trained in numpy by gradient ascent on the exact log-likelihood (forward and
backward sums) from a small labelled table, one that rules below write out, or
one that is given. Only tokens with a digit or an at sign may be other than O, so the
Viterbi decoding of a text is exact on each run of such tokens by itself; runs
are decoded in padded numpy batches. A found span must also be plausible (a
card passes Luhn, a phone has 10 to 15 digits, and so on) and touch no base span.

Texts go through map tasks once; nothing is shuffled.

Defined cases: a null or empty text has no spans; repeated rows are tagged
alike; very long texts and tokens are read whole (all patterns run in linear
time); an empty table gives an empty result; other columns of the table,
whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices
from .textscan import utf8

KINDS = ("email", "ip", "card", "phone")
STATES = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
MAX_LABELLED = 5_000
_N = len(STATES)

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_HINT = re.compile(r"[0-9@]")
_HINTS = np.zeros(256, bool)
_HINTS[[0x40, *range(0x30, 0x3A)]] = True


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def is_ip4(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign decides at most one match: the run of local characters before it, the domain after it."""
    free, last, at = 0, 0, text.find("@")
    while at >= 0:
        start = at
        while start > max(free, last) and (text[start - 1] in "._%+-" or (text[start - 1].isascii() and text[start - 1].isalnum())):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        last = at + 1
        at = text.find("@", max(last, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if is_ip4(m[0])]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


# --- word shapes and features ---

_CLASS_RUNS = re.compile(r"[A-Z]+|[a-z]+|[0-9]+|[^\x00-\x7f]+|[\x00-\x7f]")


def shape(token: str) -> str:
    """Letters' runs as X, x or u, digits' runs as their length, signs as they are; a sign at the end is left out."""
    token = token.rstrip(".,;:!?\"'")
    parts = []
    for m in _CLASS_RUNS.finditer(token):
        c = m[0][0]
        parts.append("X" if "A" <= c <= "Z" else "x" if "a" <= c <= "z" else f"<{min(len(m[0]), 21)}>" if "0" <= c <= "9" else "u" if c > "\x7f" else c)
    return "".join(parts)


def features(s: str) -> list[str]:
    """Names of a shape's features."""
    n = sum(map(int, re.findall(r"<(\d+)>", s)))
    plain = re.sub(r"<\d+>", "9", s)
    size = "0" if n == 0 else str(n) if n <= 4 else "5-6" if n <= 6 else "7-9" if n <= 9 else "10-13" if n <= 13 else "14-19" if n <= 19 else "20+"
    return [
        f"shape {s}", f"plain {plain}", f"digits {size}", f"first {plain[:1]}", f"last {plain[-1:]}", f"at {min(s.count('@'), 2)}",
        f"dots {min(s.count('.'), 4)}", f"dashes {min(s.count('-'), 4)}", f"colons {min(s.count(':'), 3)}", f"letters {bool(re.search('[Xxu]', s))}",
        f"mixed {bool(re.search('[Xxu]', s)) and n > 0 and '@' not in s}", f"equals {'=' in s}", "bias",
    ]


def near_features(s: str, side: str) -> list[str]:
    return [f"{side} {x}" for x in features(s) if x.split()[0] in ("digits", "plain", "first")] if s else [f"{side} word"]


def runs_of(text: str) -> list[list[tuple[int, int]]]:
    """Maximal runs of consecutive tokens with a digit or an at sign; spans of the tokens."""
    out, run = [], []
    for m in _TOKEN.finditer(text):
        if _HINT.search(text, m.start(), m.end()):
            run.append(m.span())
        elif run:
            out.append(run)
            run = []
    return [*out, run] if run else out


# --- the labelled table ---


def labelled_table(rows: int = 600, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """A small labelled table, written out by rules: tokens of a run and their tags."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda a=2, b=9: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(a, b)))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))

    def phone() -> list[str]:
        return r.choice([
            ["+1", f"({d(3)})", f"{d(3)}-{d(4)}"], [f"({d(3)})", f"{d(3)}-{d(4)}"], [f"{d(3)}-{d(3)}-{d(4)}"], [f"+{d(2)}", d(2), d(4), d(4)],
            [f"+{d(2)}-{d(3)}-{d(4)}-{d(3)}"], [f"+{d(12)}"], [f"({d(3)}){d(3)}-{d(4)}"], [f"1-{d(3)}-{d(3)}-{d(4)}"], [f"+{d(2)}", f"({d(1)}){d(2)}", d(4), d(4)],
        ])

    def card() -> list[str]:
        n = r.choice([16, 16, 16, 15, 14, 19])
        x = r.choice("3456") + d(n - 1)
        return r.choice([[x], [x[:4], x[4:8], x[8:12], x[12:]] if n == 16 else [x], ["-".join((x[:4], x[4:8], x[8:12], x[12:]))], [".".join((x[:4], x[4:8], x[8:12], x[12:]))]])

    def mail() -> list[str]:
        name = r.choice([f"{w()}.{d(2)}", f"{w()}.{w()}", w(), f"{w()}_{w()}", f"{w()}+{w()}", f"{w()}{d(2)}", f"jü{w()}", f"{w()}ñ{w()}"])
        return [f"{name}@{r.choice([f'mail{d(1)}.{w()}', w(), f'{w()}-{w()}', f'bü{w()}'])}.{r.choice(['com', 'org', 'net', 'co.uk', 'de', 'example.com'])}"]

    def address() -> list[str]:
        four = ".".join(str(r.randint(0, 255)) for _ in range(4))
        six = r.choice([":".join(hexa(4) for _ in range(8)), f"{hexa(4)}:{hexa(3)}::{hexa(2)}", f"fe80::{hexa(4)}:{hexa(4)}:{hexa(4)}:{hexa(4)}"])
        return [r.choice([four, four, six])]

    def other() -> list[str]:
        return r.choice([
            [d(1)], [d(2)], [f"{d(1)}.{d(1)}"], [f"{d(1)}.{d(1)}.{d(2)}"], [f"20{d(2)}"], [f"20{d(2)}-{d(2)}-{d(2)}"], [f"{d(2)}:{d(2)}"], [f"{d(1)},{d(3)}.{d(2)}"], [f"#{d(6)}"], [d(5)], [d(8)], [d(10)], [d(12)], [d(24)],
            ["AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))], [f"password={hexa(18)}"], [f'"{hexa(40)}"'], [hexa(32)], [f"{w()}{d(2)}"], [f"{w().upper()}{d(3)}"],
            [f"https://{w()}.com/{d(4)}"], [f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}"], [f"@{w()}"], [f"{w()}@{w()}"], [f"{d(2)}%"], [f"${d(3)}"], [f"{d(3)}", f"{d(3)}"], [f"{d(1)}-{d(1)}"], [f"p.{d(3)}"], [f"{d(4)}/{d(2)}/{d(2)}"],
        ])

    makers = [("phone", phone), ("card", card), ("email", mail), ("ip", address), ("", other), ("", other), ("", other)]
    table = []
    for _ in range(rows):
        tokens, tags = [], []
        for _ in range(r.choice([1, 1, 1, 2, 2, 3])):
            kind, make = r.choice(makers)
            got = make()
            tags += [f"{'I' if i else 'B'}-{kind}" if kind else "O" for i in range(len(got))]
            got[-1] += r.choice(["", "", "", ".", ",", ";", ":"])
            tokens += got
        table.append((tokens, tags))
    return table


# --- the field ---


class Field:
    """Weights of the features' states and of transitions; runs start after and end before O."""

    def __init__(self, table: list[tuple[list[str], list[str]]], steps: int = 120, l2: float = 0.5):
        ids: dict[str, int] = {}
        named = [self._names([shape(t) for t in tokens]) for tokens, _ in table]
        for run in named:
            for names in run:
                for x in names:
                    ids.setdefault(x, len(ids))
        self.ids = ids
        longest = max((len(t) for t, _ in table), default=1)
        width = max((len(x) for run in named for x in run), default=1)
        f = np.full((len(table), longest, width), len(ids))
        y = np.zeros((len(table), longest), np.int64)
        n = np.array([len(t) for t, _ in table])
        for i, (run, (_, tags)) in enumerate(zip(named, table, strict=True)):
            for t, names in enumerate(run):
                f[i, t, : len(names)] = [ids[x] for x in names]
                y[i, t] = STATES.index(tags[t])
        self.w, self.trans = np.zeros((len(ids) + 1, _N)), np.zeros((_N, _N))
        m = [np.zeros_like(self.w), np.zeros_like(self.trans)]
        v = [np.zeros_like(self.w), np.zeros_like(self.trans)]
        for step in range(1, steps + 1):
            for j, (p, g) in enumerate(zip((self.w, self.trans), self._gradient(f, y, n), strict=True)):
                g = g / len(table) - l2 * p / len(table)
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.99 * v[j] + 0.01 * g * g
                p += 0.1 * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.99**step)) + 1e-8)
        self.w[-1] = 0
        self.cache: dict[tuple[str, str], np.ndarray] = {}

    @staticmethod
    def _names(shapes: list[str]) -> list[list[str]]:
        around = ["", *shapes, ""]
        return [features(s) + near_features(around[i], "before") + near_features(around[i + 2], "after") for i, s in enumerate(shapes)]

    def _gradient(self, f: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the log-likelihood of the tags y, from the forward and backward sums."""
        rows, longest = y.shape
        self.w[-1] = 0
        e = self.w[f].sum(2)
        a, b = np.zeros((longest, rows, _N)), np.zeros((longest, rows, _N))
        a[0] = e[:, 0] + self.trans[0]
        for t in range(1, longest):
            a[t] = _logsum(a[t - 1][:, :, None] + self.trans[None], 1) + e[:, t]
        at = np.arange(rows)
        for t in range(longest - 1, -1, -1):
            end = n - 1 == t
            if t + 1 < longest:
                b[t] = _logsum(self.trans[None] + (e[:, t + 1] + b[t + 1])[:, None, :], 2)
            b[t][end] = self.trans[:, 0]
        z = _logsum(a[n - 1, at] + self.trans[:, 0], 1)
        gw, gt = np.zeros_like(self.w), np.zeros_like(self.trans)
        for t in range(longest):
            on = n > t
            p = np.exp(a[t] + b[t] - z[:, None]) * on[:, None]
            d = -p
            d[at[on], y[on, t]] += 1
            np.add.at(gw, f[:, t].ravel(), np.repeat(d, f.shape[2], axis=0))
            last = n - 1 == t
            gt[:, 0] += d[last].sum(0)
            if t == 0:
                gt[0] += d.sum(0)
            else:
                pair = np.exp(a[t - 1][:, :, None] + self.trans[None] + (e[:, t] + b[t])[:, None, :] - z[:, None, None])[on].sum(0)
                gt -= pair
                np.add.at(gt, (y[on, t - 1], y[on, t]), 1)
        gw[-1] = 0
        return gw, gt

    def emission(self, s: str, side: str) -> np.ndarray:
        got = self.cache.get((s, side))
        if got is None:
            names = features(s) if side == "own" else near_features(s, side)
            got = self.w[[self.ids.get(x, -1) for x in names]].sum(0)
            if len(s) <= 200:  # long shapes hardly come again
                if len(self.cache) > 200_000:
                    self.cache.clear()
                self.cache[s, side] = got
        return got

    def decode(self, runs: list[list[str]]) -> list[np.ndarray]:
        """Viterbi over a batch of runs of tokens, in groups of like length."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(runs)
        order = sorted(range(len(runs)), key=lambda i: len(runs[i]))
        i = 0
        while i < len(order):
            size = len(runs[order[i]])
            j = i
            while j < len(order) and len(runs[order[j]]) == size and (j - i) * size < 200_000:
                j += 1
            group = order[i:j]
            e = np.empty((len(group), size, _N))
            for g, k in enumerate(group):
                shapes = ["", *map(shape, runs[k]), ""]
                for t in range(size):
                    e[g, t] = self.emission(shapes[t + 1], "own") + self.emission(shapes[t], "before") + self.emission(shapes[t + 2], "after")
            score = e[:, 0] + self.trans[0]
            back = np.zeros((size, len(group), _N), np.int8)
            for t in range(1, size):
                way = score[:, :, None] + self.trans[None]
                back[t] = way.argmax(1)
                score = way.max(1) + e[:, t]
            state = (score + self.trans[:, 0]).argmax(1)
            path = np.empty((len(group), size), np.int64)
            for t in range(size - 1, -1, -1):
                path[:, t] = state
                state = back[t][np.arange(len(group)), state]
            for g, k in enumerate(group):
                out[k] = path[g]
            i = j
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


_IP6 = re.compile(r"(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}")
_MAIL = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+")


def plausible(kind: str, s: str) -> bool:
    """What a span of the field must fulfil besides."""
    digits = digits_of(s)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 .\-]", s)
    if kind == "phone":
        return 10 <= len(digits) <= 15 and not re.search(r"[^0-9 +().\-/]", s)
    if kind == "ip":
        return bool(_IP6.fullmatch(s)) and len(s) >= 6 or s.count(".") == 3 and not re.search(r"[^0-9.]", s) and all(s.split(".")) and is_ip4(s)
    return bool(_MAIL.fullmatch(s))


def field_spans(text: str, run: list[tuple[int, int]], path: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of a decoded run."""
    t = 0
    while t < len(run):
        if path[t] == 0:
            t += 1
            continue
        kind = (int(path[t]) - 1) // 2
        u = t + 1
        while u < len(run) and path[u] == 2 * kind + 2:
            u += 1
        start, end = run[t][0], run[u - 1][1]
        while start < end and not (text[start].isalnum() or text[start] == "+" or (text[start] == "(" and kind == 3) or (text[start] == ":" and kind == 1)):
            start += 1
        while end > start and not (text[end - 1].isalnum() or (text[end - 1] == ":" and kind == 1)):
            end -= 1
        if plausible(KINDS[kind], text[start:end]):
            yield start, kind, end
        t = u


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """Per row: key, n_email, n_ip, n_card, n_phone (base), base_sha256, spans.

    labelled: (tokens array<string>, tags array<string>), MAX_LABELLED rows of it at most.
    """
    table = labelled_table() if labelled is None else [(list(r[0]), list(r[1])) for r in labelled.select("tokens", "tags").limit(MAX_LABELLED).collect()]
    shared = docs.sparkSession.sparkContext.broadcast(Field(table))
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for whole in batches:
            for batch in slices(whole, text):
                data, offsets = utf8(batch.column(text))
                hints = np.concatenate([[0], np.cumsum(_HINTS[data])])[offsets]
                some = np.flatnonzero(np.diff(hints) > 0)
                n = batch.num_rows
                counts, sha, spans = np.zeros((4, n), np.int64), [nothing] * n, [""] * n
                texts = batch.column(text).take(pa.array(some)).to_pylist()
                runs = [runs_of(t) for t in texts]
                flat = [[t[a:b] for a, b in r] for t, own in zip(texts, runs, strict=True) for r in own]
                paths = iter(field.decode(flat))
                for i, t, own in zip(some, texts, runs, strict=True):
                    base = base_spans(t)
                    taken = sorted((a, b) for a, _, b in base)
                    starts, tops = [a for a, _ in taken], np.maximum.accumulate([b for _, b in taken]) if taken else []
                    more = []
                    for r in own:
                        for a, k, b in field_spans(t, r, next(paths)):
                            before = int(np.searchsorted(starts, b))
                            if not before or tops[before - 1] <= a:
                                more.append((a, k, b))
                    for _, k, _ in base:
                        counts[k, i] += 1
                    if base:
                        sha[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                    spans[i] = joined(sorted(base + more))
                yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(c) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string())], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def op7_personal_data(spark, sf_dir: str) -> DataFrame:
    return find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
