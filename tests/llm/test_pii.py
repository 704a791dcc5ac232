import re

import numpy as np
import pytest

from ledgerlens.llm import pii
from ledgerlens.llm.tagger import Tagger


def brute(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_spans_against_the_patterns(rows):
    rng = np.random.default_rng(0)
    odd = ["a@b@c.com x@a.com.y@b.org @c.d a.@-.- 1.2.3.4.5.6.7.8 01.002.0003.4 256.1.1.1 +1 (234) 555-9999 4111 1111 1111 1111-", "+12 34567+8 (9", "1" * 300 + ".1.1.1", "..@x.y", "4111111111111111 4111111111111111"]
    odd += ["".join(rng.choice(list("0123456789@.+- ()aA_"), int(rng.integers(1, 60)))) for _ in range(3000)]
    for text in odd + [t for _, t in rows if t]:
        assert pii.base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000, "1." * 150_000, "@" * 300_000, "+1 (" * 75_000):
        pii.base_spans(text)


def test_gradients():
    rng = np.random.default_rng(0)
    m = Tagger(3, hidden=3, embed=2)
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    x, y = rng.integers(0, 20, (2, 5)), rng.integers(0, 3, (2, 5))
    _, grads = m.loss(x, y)
    for name, w in m.w.items():
        at = (int(x[0, 0]), 0) if name == "embed" else tuple(int(rng.integers(0, s)) for s in w.shape)
        old, step = w[at], 1e-4
        w[at] = old + step
        up = m.loss(x, y)[0]
        w[at] = old - step
        down = m.loss(x, y)[0]
        w[at] = old
        assert grads[name][at] == pytest.approx((up - down) / (2 * step), abs=1e-3)


def test_viterbi_against_all_paths():
    from itertools import product

    m = Tagger(3)
    rng = np.random.default_rng(2)
    m.w["trans"], m.w["start"] = rng.standard_normal((3, 3)), rng.standard_normal(3)
    e = rng.standard_normal((5, 3))
    score = lambda p: m.w["start"][p[0]] + sum(e[t][p[t]] for t in range(5)) + sum(m.w["trans"][p[t - 1]][p[t]] for t in range(1, 5))
    assert tuple(m.viterbi(e)) == max(product(range(3), repeat=5), key=score)


def test_held_out_accuracy_and_added_spans(spark, rows):
    model = Tagger(1 + 2 * len(pii.KINDS))
    model.w = pii.trained([t for _, t in rows if t and re.search("[0-9@]", t)])
    held = pii.generated(200, ["alpha", "beta", "gamma", "the", "of"], seed=5)
    found = wanted = right = 0
    for text, spans in held:
        ((base, added),) = pii.all_spans(model, [text])
        mine = {(k, a, b) for k, a, b in base + added}
        whole = {s for s in spans if s[1] > 0 and s[2] < len(text)}
        found, wanted, right = found + len(mine), wanted + len(whole), right + len(mine & whole)
    assert right / wanted > 0.7, (right, wanted)
    assert pii.all_spans(model, ["no personal data in 2024, version 1.2.3, page 17"])[0] == ([], [])


def test_windows_agree_with_one_long_stretch(rows):
    text = "x" * 500 + " call +1 (234) 555-9999 now " + "y" * 500 + " 10.0.0.1 "
    runs = pii.stretches(text)
    covered = {p for a, b in runs for p in range(a * pii.STRIDE, b * pii.STRIDE + pii.WINDOW)}
    assert all(m.start() in covered for m in pii.TRIGGER.finditer(text)) and len(runs) == 2


def test_rows_and_empty_table(docs, none, rows):
    assert pii.find(docs).count() == len(rows)
    assert pii.find(none).count() == 0
