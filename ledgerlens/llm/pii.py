"""Personal data: base patterns, and a character-level BiLSTM-CRF beside them.

The base kinds are the leftmost non-overlapping matches of four patterns; a
match that fails its check is dropped and not retried.  They always stay.

The tagger is trained in numpy from labelled spans: the base spans of a bounded
sample of texts, and generated ones in forms that the patterns don't cover
(phone numbers without a plus, cards with dots, addresses with a port).  It
reads overlapping windows wherever a text has a digit or an at sign; without one
there is no personal data of these kinds.  Scores of overlapping windows are
reconciled globally: every character takes those of the window in which it
stands most centrally, and the best tag path is sought over the whole stretch
of windows.  A tagged span that overlaps no base span and holds enough digits
(or a host after its at sign) for its kind is added.

Defined results: a null text counts as empty and has no spans; texts of any
length are read whole; repeated rows are read each; a sample without spans
trains on the generated ones alone; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import bounded_batches, hashed_sample
from .tagger import PAD, Tagger, symbols_of

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48
#: Rows that the labelled spans come from, and windows that training takes.
SAMPLE_ROWS = 400
SAMPLE_WINDOWS = 800
SAMPLE_CHARS = 20_000
#: Windows that are decoded together.
BATCH = 512

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A start inside a run of digits fares as the run's first, so it needs no try.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans, by kind as listed, then start."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        host = DOMAIN.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            found.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(p) < 4 and int(p) < 256 for p in (q.lstrip("0") or "0" for q in m.group().split("."))):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37:
            d = _digits(m.group())
            if 16 <= len(d) <= 19 and luhn(d):
                found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            found.append(("phone", *m.span()))
    return found


def tags_of(spans: list[tuple[str, int, int]], n: int) -> np.ndarray:
    """0 outside; 1 + 2 k begins kind k, 2 + 2 k goes on."""
    y = np.zeros(n, np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        y[a:b] = 2 + 2 * k
        y[a] = 1 + 2 * k
    return y


def generated(count: int, words: list[str], seed: int = 88) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts with labelled spans, made from the given words."""
    rng = np.random.default_rng(seed)
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda options: options[int(rng.integers(len(options)))]
    words = words or ["the", "and", "of", "in", "with"]

    def card() -> str:
        body = pick("3456") + d(14)
        body += next(str(k) for k in range(10) if luhn(body + str(k)))
        return pick(["", "", " ", "-", "."]).join(body[k : k + 4] for k in range(0, 16, 4))

    octets = lambda: ".".join(str(rng.integers(0, 256)) for _ in range(4))
    forms = {
        "email": lambda: f"{pick(words).lower()}{pick(['.', '_', '', '-'])}{d(int(rng.integers(0, 3)))}@{pick(['mail', 'post', pick(words).lower()])}{d(int(rng.integers(0, 2)))}.{pick(['example.com', 'example.org', 'test.net', 'co.uk', 'de'])}",
        "ip": octets,
        "card": card,
        "phone": lambda: pick([f"+{rng.integers(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{rng.integers(1, 99)} {d(3)} {d(3)} {d(3)}", f"+{d(11)}", f"{d(3)}.{d(3)}.{d(4)}"]),
    }
    # what looks similar and isn't: years, versions, prices, tokens, order numbers
    others = (lambda: d(4), lambda: f"{rng.integers(0, 20)}.{rng.integers(0, 20)}", lambda: f"version {rng.integers(1, 9)}.{rng.integers(0, 9)}.{rng.integers(0, 9)}", lambda: f"${d(2)}.{d(2)}", lambda: f'token = "{rng.bytes(20).hex()}"', lambda: f"{rng.bytes(20).hex().upper()}", lambda: d(int(rng.integers(1, 7))), lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{d(2)}:{d(2)}", lambda: f"@{pick(words)}")
    out = []
    for _ in range(count):
        text, spans = "", []
        while len(text) < WINDOW:
            roll = rng.random()
            if roll < 0.08:
                kind = pick(KINDS)
                part = forms[kind]()
                spans.append((kind, len(text), len(text) + len(part)))
            elif roll < 0.2:
                part = pick(others)()
            else:
                part = pick(words)
            text += part + pick([" ", " ", " ", " ", ". ", ", ", "\n"])
        shift = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
        text = text[shift : shift + WINDOW]
        spans = [(k, max(0, a - shift), min(WINDOW, b - shift)) for k, a, b in spans if b > shift and a < shift + WINDOW]
        out.append((text, spans))
    return out


def labelled_windows(texts: list[str], count: int = SAMPLE_WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags: half from the texts' base spans, half generated."""
    rng = np.random.default_rng(80)
    x, y = np.full((count, WINDOW), PAD, np.int64), np.zeros((count, WINDOW), np.int64)
    words = sorted({w for t in texts[:100] for w in t[:2000].split() if w.isalpha()})[:2000]
    pool = []
    for t in texts:
        marks = np.array([m.start() for m in TRIGGER.finditer(t)])
        if len(marks):
            spans = base_spans(t)
            tags = np.zeros(len(t), np.int64)
            for kind in KINDS:  # where kinds overlap the last one counts
                for k, a, b in spans:
                    if k == kind:
                        tags[a:b] = tags_of([(k, 0, b - a)], b - a)
            for at in rng.choice(marks, min(3, len(marks)), replace=False):
                a = max(0, int(at) - int(rng.integers(0, WINDOW)))
                pool.append((t[a : a + WINDOW], tags[a : a + WINDOW]))
    pool = [pool[k] for k in rng.permutation(len(pool))[: count // 2]]
    pool += [(t, tags_of(s, len(t))) for t, s in generated(count - len(pool), words)]
    for k, (t, tags) in enumerate(pool):
        x[k, : len(t)], y[k, : len(t)] = symbols_of(t), tags
    return x, y


_models: dict[str, dict[str, np.ndarray]] = {}


def trained(texts: list[str]) -> dict[str, np.ndarray]:
    """Weights from a sample's labelled spans; the same sample trains once."""
    key = hashlib.sha256("\0".join(texts).encode()).hexdigest()
    if key not in _models:
        model = Tagger(1 + 2 * len(KINDS))
        model.train(*labelled_windows(texts), epochs=12)
        _models.clear()
        _models[key] = model.w
    return _models[key]


def _enough(kind: str, text: str) -> bool:
    n = len(_digits(text))
    if kind == "email":
        name, _, host = text.partition("@")
        return bool(name) and "." in host.strip(".")
    if kind == "ip":
        return text.count(".") == 3 and n >= 4
    return 13 <= n <= 19 and luhn(_digits(text)) if kind == "card" else 7 <= n <= 15


def _to_edges(text: str, a: int, b: int) -> tuple[int, int]:
    """The span without marks at its ends, grown to whole runs of digits."""
    while a < b and not text[a].isalnum() and text[a] not in "+(":
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    if b > a:
        while a > 0 and text[a] in "0123456789" and text[a - 1] in "0123456789":
            a -= 1
        while b < len(text) and text[b - 1] in "0123456789" and text[b] in "0123456789":
            b += 1
    return a, b


def stretches(text: str) -> list[tuple[int, int]]:
    """Runs of neighbouring windows (numbers from, to) that hold a trigger."""
    runs: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        last = m.start() // STRIDE
        first = max(0, last - 1)
        if runs and first <= runs[-1][1] + 1:
            runs[-1][1] = max(runs[-1][1], last)
        else:
            runs.append([first, last])
    return [(a, b) for a, b in runs]


def tagged_spans(model: Tagger, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """The tagger's spans of each text."""
    jobs = [(k, a, b) for k, t in enumerate(texts) for a, b in stretches(t)]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    windows = [(j, w) for j, (_, a, b) in enumerate(jobs) for w in range(a, b + 1)]
    central = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k in range(0, len(windows), BATCH):
        now = windows[k : k + BATCH]
        x = np.full((len(now), WINDOW), PAD, np.int64)
        for r, (j, w) in enumerate(now):
            s = symbols_of(texts[jobs[j][0]][w * STRIDE : w * STRIDE + WINDOW])
            x[r, : len(s)] = s
        e = model.emissions(x)
        for r, (j, w) in enumerate(now):
            doc, a, b = jobs[j]
            size = min(len(texts[doc]) - a * STRIDE, (b - a) * STRIDE + WINDOW)
            if j not in held:
                held[j] = (np.zeros((size, model.tags), np.float32), np.full(size, -1))
            scores, depth = held[j]
            at = (w - a) * STRIDE
            n = min(WINDOW, size - at)
            deeper = np.flatnonzero(central[:n] > depth[at : at + n])
            scores[at + deeper], depth[at + deeper] = e[deeper, r], central[deeper]
            if w == b:  # the stretch's last window: decode it whole
                del held[j]
                tags = model.viterbi(scores)
                begins = np.flatnonzero((tags > 0) & ((tags % 2 == 1) | (np.r_[0, (tags[:-1] + 1) // 2] != (tags + 1) // 2)))
                for p in begins.tolist():
                    kind, q = (tags[p] + 1) // 2, p + 1
                    while q < size and tags[q] == 2 * kind:
                        q += 1
                    out[doc].append((KINDS[kind - 1], a * STRIDE + p, a * STRIDE + q))
    return out


def all_spans(model: Tagger, texts: list[str | None]) -> list[tuple[list, list]]:
    """Base spans and added spans of each text."""
    texts = [t or "" for t in texts]
    out = []
    for text, more in zip(texts, tagged_spans(model, texts)):
        base = base_spans(text) if TRIGGER.search(text) else []
        taken = sorted((a, b) for _, a, b in base)
        firsts, reach = [a for a, _ in taken], np.maximum.accumulate([b for _, b in taken]) if taken else []
        added, end = [], 0
        for kind, a, b in more:
            a, b = _to_edges(text, a, b)
            if a < end:  # what grew into the one before
                continue
            k = int(np.searchsorted(firsts, b)) - 1
            if (k < 0 or reach[k] <= a) and _enough(kind, text[a:b]):
                added.append((kind, a, b))
                end = b
        out.append((base, added))
    return out


SPANS = "struct<base:array<struct<kind:string,start:int,end:int>>,added:array<struct<kind:string,start:int,end:int>>>"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``base`` and ``added`` spans (kind, start, end)."""
    bounded_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    # training takes windows of the sampled texts' beginnings; finding reads all
    some = docs.where(text.rlike("[0-9@]")).select(F.col(f"`{id_col}`").alias("i"), F.substring(text, 1, SAMPLE_CHARS).alias("t"))
    weights = trained([r.t for r in hashed_sample(some, SAMPLE_ROWS).collect()])

    @pandas_udf(SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Tagger(1 + 2 * len(KINDS))
        model.w = weights
        for texts in batches:
            found = all_spans(model, texts.tolist())
            each = lambda x: [{"kind": k, "start": a, "end": b} for k, a, b in x]
            yield pd.DataFrame({"base": [each(b) for b, _ in found], "added": [each(m) for _, m in found]})

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), spans(text).alias("s")).select("doc_id", "s.base", "s.added")
