"""Personal data: fixed patterns against plain ones, held-out accuracy of the trees, and edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest

from parcelyard.llm import pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
DOCS = "doc_id long, text string, pii string, n_email int, base boolean, spans string, start int"
rng = random.Random(11)


def brute(text):
    out = []
    for kind, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            ok = (True, kind == 1 and all(int(x) <= 255 for x in m.group().split(".")), 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in double) % 10 == 0, 9 <= len(digits) <= 15)[kind]
            out += [(m.start(), kind, m.end())] if ok else []
    return sorted(out)


def joined(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)


WORDS = [" ".join(rng.choice(["the", "éa", "on", "lorem", "ipsum", "dolor", "sit", "amet", "tre", "quatre", "neuf", "42", "at", "3.5", "ÅR", "2024-01-05"]) for _ in range(60)) for _ in range(80)]
EDGES = [None, "", " \n", "a@b.co", "x@y", "a@b.co_x@y.com", "1.2.3.4.5.6.7.8", "1.2.3.256", "+1 (017) 555-7713", "4111 1111 1111 1111", "4111-1111-1111-1112", "😀 joe@mail.example.com 10.0.0.1"]
LONG = ["1" * 40_000, "a" * 40_000 + "@" + "b" * 40_000, "1." * 30_000, "+1" + "(" * 30_000, ("word a@b.co " * 20_000).strip(), "4" * 5000 + ".1.1.1", "1 2 " * 20_000]


@pytest.fixture(scope="module")
def model():
    return pii.fit(WORDS)


def test_fixed_patterns_equal_plain_ones():
    for _ in range(20_000):
        text = "".join(rng.choice("a1.@_-+ (9)%4é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute(text)
    for text in EDGES[1:]:
        assert pii.base_spans(text) == brute(text)


def test_long_texts_end_soon(model):
    for text in LONG:
        base = pii.base_spans(text)
        pii._added(model, [text], [base])
    assert len(pii.base_spans(LONG[4])) == 20_000 and len(pii.base_spans(LONG[2])) == 7500


def test_the_model_finds_planted_data_and_leaves_the_rest(model):
    own = random.Random(99)
    found = planted = wrong = plain = 0
    for _ in range(600):
        phrase, thing, kind = pii._planted(own)
        before = own.choice(WORDS)[:80].rsplit(" ", 1)[0] + " " + phrase
        text = before + thing + " " + own.choice(WORDS)[:60]
        base = pii.base_spans(text)
        added = [s for s, _ in pii._added(model, [text], [base])[0]]
        want = pii.Span(len(before), kind, len(before) + len(thing))
        planted += kind >= 0
        found += want in added
        wrong += sum(s != want for s in added)
        plain += kind < 0
    assert found >= 0.8 * planted and wrong <= 0.02 * (planted + plain) and plain > 100


def test_trees_learn_what_needs_two_features():
    x = np.random.default_rng(1).integers(0, 2, (600, 3)).astype(float)
    y = (x[:, 0] != x[:, 1]).astype(float)
    assert ((pii.Trees(x[:400], y[:400]).scores(x[400:]) > 0) == y[400:]).mean() > 0.98
    assert pii.Trees(np.zeros((0, 3)), np.zeros(0)).scores(np.zeros((2, 3))).tolist() == [0, 0]


def test_digests_and_redaction(spark, model):
    texts = EDGES + WORDS[:10] + [f"{WORDS[3]} write to joe (at) site (dot) org now", "a@b.co a@b.co", "a@b.co a@b.co"] + LONG[4:5]
    docs = spark.createDataFrame([(i if i != 5 else None, t, "x", 1, True, "s", 2) for i, t in enumerate(texts)], DOCS).repartition(3)
    rows = pii.digests(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[5 if r.doc_id is None else r.doc_id] or ""
        want = brute(text)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)]
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert set(joined(want).split(",")) <= set(r.spans.split(",")) and (r.n_added > 0 or r.spans == joined(want))
        starts = [int(s.split(":")[1]) for s in r.spans.split(",") if s]
        assert starts == sorted(starts)
    hidden = {r.doc_id: r.text for r in pii.redacted(pii.find(docs, model)).collect()}
    assert hidden[0] is None and hidden[1] == "" and hidden[3] == "[EMAIL]" and hidden[11] == "😀 [EMAIL] [IP]" and hidden[9] == "[CARD]"
    assert hidden[len(EDGES) + 10].endswith("write to [EMAIL] now")
    assert pii.digests(docs.limit(0)).count() == 0
