import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.llm import data
from tremor.llm import packing as op


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(op.default_tokenizer())


def test_ids_equal_the_tokenizers(tokenizer):
    rng = random.Random(3)
    alphabet = [" ", "  ", "\n", "\t", " ", "\x1c", "　", "a", "B", "9", "'s", "é", "漢", "☃", ".", "<|endoftext|>", "-", "\r\n", "😀"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [r[1] or "" for r in data.rows()]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    encode = op.Encoder(op.default_tokenizer())
    for k in range(0, len(texts), 100):
        got = [np.frombuffer(b, dtype="<u4").tolist() for b in encode(texts[k : k + 100])]
        assert got == want[k : k + 100]


def test_plain_texts_equal_the_tokenizers(tokenizer):
    rng = random.Random(6)
    alphabet = [*map(chr, range(0x20, 0x7F)), *" " * 30, *"\n\r\t", *"éèßÄñ", "'s", "'re", "   ", "\n\n"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    encode = op.Encoder(op.default_tokenizer())
    assert encode.direct
    assert [np.frombuffer(b, dtype="<u4").tolist() for b in encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_whole_operator(spark, tokenizer):
    rows = [r for r in data.rows() if r[0] is not None and r[0] != 10004]
    ids = {r[0]: [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in op.pack(data.documents(spark, rows).repartition(3)).collect():
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for d, p in pieces.items():
        assert sum(x for _, x in p) == len(ids[d]) and all(a + n == b for (a, n), (b, _) in zip(sorted(p), sorted(p)[1:], strict=False))
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and sum(n for _, n in s) <= 2048
    assert op.pack(data.documents(spark, [])).count() == 0


def test_best_cuts_are_best():
    rng = random.Random(5)
    for _ in range(60):
        pos = sorted(rng.sample(range(1, 400), rng.randint(1, 12)))
        length = 64
        pos = sorted({*pos, *(x for a, b in zip([0, *pos], pos, strict=False) for x in range(a + length, b, length))})
        pen = [rng.choice((0, 2, 16)) for _ in pos]
        cuts, least = op.best_cuts(np.array(pos), np.array(pen), length)
        p, f = [0, *pos], [0]
        for i in range(1, len(p)):
            best = None
            for j in range(i):
                d = p[i] - p[j]
                m = -(-d // length) - 1
                if m <= op.RUNS:
                    best = min(x for x in (best, f[j] + m * op.HARD + (m + 1) * length - d) if x is not None)
                if d in op.POWERS and d <= length:
                    best = min(best, f[j])
            f.append(best + pen[i - 1])
        assert least == f[-1]
        assert cuts[-1] == pos[-1] and all(0 < b - a <= length for a, b in zip([0, *cuts], cuts, strict=False))


def test_little_padding_and_blocks(monkeypatch):
    monkeypatch.setattr(op, "BLOCK_TOKENS", 20_000)
    rng = np.random.default_rng(0)
    ends = rng.random(100) < 0.05
    packer, total, seen = op.Packer(ends, 0), 0, []
    for k in range(400):
        ids = rng.integers(0, 100, int(rng.integers(1, 3000)), dtype=np.uint32)
        total += len(ids)
        for b in packer.add(k, ids.tobytes()):
            seen += b.to_pylist()
    seen += packer.flush(True).to_pylist()
    assert sum(r["length"] for r in seen) == total
    used = defaultdict(int)
    for r in seen:
        used[r["sequence_id"]] += r["length"]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in used.values())
    assert padding < 0.005 * total


def test_every_sentence_end_is_a_cut_point(tokenizer):
    encode = op.Encoder(op.default_tokenizer())
    latin = "One. Two three? Four five six! Seven.\n" * 20
    ids = np.array(tokenizer.encode(latin, add_special_tokens=False).ids, dtype="<u4")
    pos, penalty = op.cut_points(ids, np.array([len(ids)]), encode.sentence_end, encode.tails)
    ends = {k + 1 for k, i in enumerate(ids) if tokenizer.id_to_token(int(i))[-1] in ".?!Ċ"}
    assert len(ends) >= 80 and ends <= set(pos[penalty <= op.SENTENCE].tolist())
    for stop in op.STOPS:
        text = f"漢字{stop}कखग {stop}é字 " * 8
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        pos, penalty = op.cut_points(ids, np.array([len(ids)]), encode.sentence_end, encode.tails)
        want = {k + 1 for k in range(len(ids)) if tokenizer.decode(ids[: k + 1].tolist()).endswith(stop)} | {len(ids)}
        assert len(want) == 17 and set(pos[penalty <= op.SENTENCE].tolist()) == want
