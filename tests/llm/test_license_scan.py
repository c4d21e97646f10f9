import random
import re

from tests.llm import data
from tremor.llm import license_scan as op

AUTOMATON = op.automaton(op.TEMPLATES, op.PHRASES)


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_base(words):
    out = []
    for label, phrase in op.PHRASES:
        p = phrase.split()
        out += [(k, label) for k in range(len(words)) if words[k : k + len(p)] == p]
    return out


def test_base_against_brute_force(spark):
    rng = random.Random(8)
    bits = ["gnu general public license", "GNU General", "Apache License", "apache-license", "cc by", "CC BY-NC", "mit license", "MIT", "license", "software is provided", "é", "x9", "\n", "of this software and associated documentation files", "cc cc by by"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(300)] + [r[1] for r in data.rows()]
    rows = [(k, t, None, None, None, 1, 0.0, 1, 1) for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in op.scan(data.documents(spark, rows)).collect()}
    for k, t in enumerate(texts):
        words = brute_words(t)
        base, r = brute_base(words), got[k]
        starts = [i for i, _ in base]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(base), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in base}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert op.scan(data.documents(spark, [])).count() == 0


def test_matching_statistics_against_brute_force():
    rng = random.Random(4)
    known = [op.split(t.encode()) for _, t in (*op.TEMPLATES, *op.PHRASES)]
    text = []
    for _ in range(60):
        s = rng.choice(known)
        a = rng.randrange(len(s))
        text += s[a : a + rng.randint(1, 12)] + [b"zzz"] * rng.randint(0, 1)
    _, segments = AUTOMATON.stream(AUTOMATON.numbers(b" ".join(text)))
    longest = []
    for i in range(len(text)):
        n = 0
        while n <= i and any(text[i - n : i + 1] == s[j : j + n + 1] for s in known for j in range(len(s) - n)):
            n += 1
        longest.append(n)
    ends = [(i, n) for i, n in enumerate(longest) if n >= op.SEGMENT and (i + 1 == len(longest) or longest[i + 1] != n + 1)]
    assert [(e, n) for e, n, _ in segments] == ends


def test_templates_give_labels_and_spans():
    for label, t in op.TEMPLATES:
        if len(t.split()) < op.COVER_WORDS:
            continue
        words = t.split()
        words[len(words) // 2] = "changedword"  # one word differs: two segments, one chain
        got = op.scan_text(("some prose before it " + " ".join(words) + " and after").encode(), AUTOMATON, op.PHRASES)
        assert label in got["labels"].split(",") and got["score"] > 0.5
        best = max((s for s in got["spans"] if s["label"] == label), key=lambda s: s["covered"])
        assert best["covered"] >= len(op.split(t.encode())) - 6
    assert op.scan_text(b"the rights of the author and the use of this are plain in all copies of it", AUTOMATON, op.PHRASES)["labels"] == ""


def test_slices(monkeypatch):
    text = " ".join(t for _, t in op.TEMPLATES).encode() + b" " + b"y" * 100
    want = AUTOMATON.numbers(text).tolist()
    monkeypatch.setattr(op, "SLICE", 37)
    assert AUTOMATON.numbers(text).tolist() == want


def brute_cover(words, template):
    """Most template words that a chain of segments covers, by trying every chain of what any two places share."""
    segs = []
    for i in range(len(words)):
        for a in range(len(template)):
            n = 0
            while i + n < len(words) and a + n < len(template) and words[i + n] == template[a + n]:
                n += 1
            if n >= op.SEGMENT and not (i and a and words[i - 1] == template[a - 1]):
                segs.append((i, a, n))
    best = 0

    def go(last, covered):
        nonlocal best
        best = max(best, covered)
        for d, a, n in segs:
            if last is None:
                go((d, a, n), n)
                continue
            e, b, m = last
            over = max(0, b + m - a, e + m - d)
            if e < d and b < a and over < n and d - (e + m) <= op.JUMP:
                go((d, a, n), covered + n - over)

    go(None, 0)
    return best


def test_spans_against_every_chain():
    """Texts whose words are one template's alone, so that its segments are those of any two places."""
    rng = random.Random(12)
    template = [f"t{k}" for k in range(30)]
    a = op.Automaton((("one", " ".join(template)),), ())
    for _ in range(120):
        text = []
        for _ in range(rng.randint(1, 5)):
            at = rng.randrange(27)
            text += template[at : at + rng.randint(2, 12)] + ["gap"] * rng.choice((0, 1, 3, 70))
        _, segments = a.stream(a.numbers(" ".join(text).encode()))
        got = a.spans(segments)
        want = brute_cover(text, template)
        assert (got[0][3] if got else 0) == want
        if got:
            label, first, last, covered, share = got[0]
            assert label == "one" and 0 <= first <= last < len(text) and covered <= last - first + 1 and share == covered / len(template)


def test_very_long_text(spark):
    """A text of millions of characters whose licence stands at its end, and one that repeats a licence many times."""
    mit = op.TEMPLATES[0][1]
    texts = ["word and more of it " * 150_000 + mit + " MIT License", (mit + " zzz ") * 400]
    rows = [(k, t, None, None, None, 1, 0.0, 1, 1) for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in op.scan(data.documents(spark, rows)).collect()}
    assert got[0].n_words == 750_000 + len(brute_words(mit)) + 2 and "mit" in got[0].labels and got[0].first_word == got[0].n_words - 2
    assert max(s.share for s in got[1].spans if s.label == "mit") > 0.95 and got[1].score <= 1
