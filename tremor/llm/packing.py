"""Order-preserving packing by dynamic programming over cut points.

Documents of a partition follow each other in order as one stream of token ids. Cut points are document ends (free),
sentence ends (a small penalty; every one is a cut point, in any script) and, where neither is near, single forced points (a larger one); besides, a window may
run full and be cut anywhere at that larger penalty, up to RUNS times before the next cut point. With f(i) the least
padding plus penalties of all windows up to cut point i,

    f(i) = min over j, m of  f(j) + m * HARD + (m + 1) * L - (pos_i - pos_j) + penalty_i,   m * L < pos_i - pos_j <= (m + 1) * L

so for each m it is a sliding-window minimum of f(j) + pos_j, kept in a monotone queue: every cut point enters and
leaves each queue once. Windows as long as a power of two need no padding and are further transitions. The stream is
worked off in blocks of BLOCK_TOKENS; what stands after a block's last window goes on to the next block.

Defined results: null text is empty, and an empty text is its end id alone; texts of any length are encoded whole, in
parts cut where the tokenizer cuts too; null and repeated doc_ids are carried as they are; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.session import ship, table

LENGTH, END_ID = 2048, 1
#: Penalties in padding tokens, full windows in a row, tokens between forced cut points, and the stream's block.
SENTENCE, HARD, RUNS, FORCED, BLOCK_TOKENS = 1, 6, 2, 64, 1 << 19
#: Sentence ends beyond ASCII. Their bytes may lie in more than one token.
STOPS = "。．！？｡։؟۔܀।॥།༎။።፧፨។៕᠃᠉‼⁇⁈⁉"
#: Windows of these lengths are not padded, inside a stream; its end may use every power of two.
POWERS = (128, 256, 512, 1024)
#: Chunks of text whose ids a worker remembers, and characters encoded at a time.
CACHE, BATCH_CHARS = 250_000, 1_000_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_FIELDS = [pa.field(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Latin letters, digits and some marks, which every reading of the splitting pattern classes alike.
_PLAIN = re.compile(r"[0-9A-Za-zÀ-ÖØ-öø-ÿ.,;:!?-]+").fullmatch


_WHOLE = re.compile(r"[ \n\r\t!-~À-ÖØ-öø-ÿ]*").fullmatch


def _direct(spec: dict):
    """A quicker way to the same ids for plain chunks: byte pairs by rank, where ids are in the order of the merges."""
    import tiktoken
    from tokenizers.pre_tokenizers import ByteLevel

    merges, vocabulary = spec["model"].get("merges", []), spec["model"].get("vocab", {})
    ids = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" "))) for m in merges]
    letters = sorted(ByteLevel.alphabet())
    if any(i is None for i in ids) or any(a >= b for a, b in zip(ids, ids[1:], strict=False)) or any(c not in vocabulary or vocabulary[c] >= ids[0] for c in letters):
        return None
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
    others = [b for b in range(256) if b not in kept]
    byte_of = {chr(b): b for b in kept} | {chr(0x100 + k): b for k, b in enumerate(others)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocabulary.items() if i <= ids[-1] and all(c in byte_of for c in token)}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary


def _tails(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(last bytes as a number, how many they are: 3 at most) of each byte-level token."""
    from tokenizers.pre_tokenizers import ByteLevel

    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves
    byte_of = {chr(b): b for b in kept} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in kept)}
    assert byte_of.keys() == set(ByteLevel.alphabet())
    last = [bytes(byte_of.get(c, 0) for c in t[-3:]) for t in tokens]
    return np.array([int.from_bytes(b, "big") for b in last], np.uint32), np.array([len(b) for b in last], np.uint32)


def stop_ends(ids: np.ndarray, tails: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether each token ends with one of STOPS, whose first bytes may stand in the tokens before."""
    at = np.minimum(ids, len(tails[0]) - 1)
    own, size = tails[0][at], tails[1][at]
    value, have = own.copy(), size.copy()
    for k in (1, 2):
        value[k:] |= np.where(have[k:] < 3, own[:-k] << (8 * np.minimum(have[k:], 3)), 0)
        have[k:] += size[:-k]
    stops = [s.encode() for s in STOPS]
    found = np.zeros(len(ids), bool)
    for n in (2, 3):
        found |= np.isin(value & np.uint32((1 << 8 * n) - 1), np.array([int.from_bytes(s, "big") for s in stops if len(s) == n], np.uint32))
    return found


class Encoder:
    """Ids of whole texts. A byte-level tokenizer never joins a space to what stands before it, so texts are cut
    before single spaces and the ids of each chunk are remembered; texts and chunks of plain characters take the quicker way."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.chunked = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.known: dict[str, bytes] = {}  # chunks after a space
        self.bare: dict[str, bytes] = {}  # chunks after none
        self.direct = _direct(spec) if self.chunked else None
        self.line_feed = self.direct("\n")[0] if self.direct else None
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        size = self.tokenizer.get_vocab_size()
        ends = re.compile(r"[.!?Ċ][\"')\]]*$")
        self.sentence_end = np.array([bool(ends.search(self.tokenizer.id_to_token(i) or "")) for i in range(size)])
        self.tails = _tails([self.tokenizer.id_to_token(i) or "" for i in range(size)]) if pre.get("type") == "ByteLevel" else None

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: set[str], known: dict[str, bytes], lead: str) -> set[str]:
        """Ids of lead and each chunk. Plain chunks go in one text, between line feeds, which are ids of their own there.

        What is white, and after a lead would be part of a longer run, is left out and returned.
        """
        rest = chunks
        if self.direct:
            plain = [c for c in chunks if (c.isascii() and c.isalnum()) or _PLAIN(c)]
            if plain:
                ids = np.array(self.direct(lead + f"\n{lead}".join(plain)), dtype="<u4")
                marks = np.flatnonzero(ids == self.line_feed)
                data, starts, ends = ids.tobytes(), [0, *(4 * (marks + 1)).tolist()], [*(4 * marks).tolist(), 4 * len(ids)]
                known.update(zip(plain, map(data.__getitem__, map(slice, starts, ends)), strict=True))
                rest = chunks.difference(plain)
            lines = [(c, c.split("\n")) for c in rest if "\n" in c]
            lines = [(c, p) for c, p in lines if all(map(_PLAIN, p))]  # single line feeds between plain chunks stand alone
            if lines:
                self._learn({p[0] for _, p in lines} - known.keys(), known, lead)
                self._learn({x for _, p in lines for x in p[1:]} - self.bare.keys(), self.bare, "")
                feed = array("I", [self.line_feed]).tobytes()
                known.update((c, feed.join([known[p[0]], *(self.bare[x] for x in p[1:])])) for c, p in lines)
                rest = rest.difference(c for c, _ in lines)
        odd = {c for c in rest if not c or c.isspace()} if lead else set()
        rest = list(rest - odd)
        for k in range(0, len(rest), 20_000):
            known.update(zip(rest[k : k + 20_000], self._plain([lead + c for c in rest[k : k + 20_000]]), strict=True))
        return odd

    def _uneven(self, text: str) -> bytes:
        """Ids of a text with runs of white space: it is cut only between two visible characters."""
        parts = re.split(r"(?<=\S)(?= \S)", text)
        new = [k for k, p in enumerate(parts) if p[:1] != " " or p[1:] not in self.known]
        fresh = dict(zip(new, self._plain([parts[k] for k in new]), strict=True))
        return b"".join(fresh[k] if k in fresh else self.known[p[1:]] for k, p in enumerate(parts))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.chunked:
            return self._plain(texts)
        out = [array("I", self.direct(t)).tobytes() if self.direct and _WHOLE(t) and not any(x in t for x in self.special) else None for t in texts]
        rest = [k for k, ids in enumerate(out) if ids is None]
        if rest:
            for k, ids in zip(rest, self._by_chunks([texts[k] for k in rest]), strict=True):
                out[k] = ids
        return out

    def _by_chunks(self, texts: list[str]) -> list[bytes]:
        parts = [text.split(" ") for text in texts]
        heads, tails = [p[0] for p in parts], [p[1:] for p in parts]
        now = set().union(*tails)
        new = now - self.known.keys()
        if len(self.known) + len(self.bare) + len(new) > CACHE:
            self.known.clear()
            self.bare.clear()
            new = now
        odd = self._learn(new, self.known, " ")
        self._learn({h for h in heads if h and h not in self.bare}, self.bare, "")
        get, first = self.known.__getitem__, self.bare
        return [(first[h] if h else b"") + b"".join(map(get, t)) if not odd or odd.isdisjoint(t) else self._uneven(text) for text, h, t in zip(texts, heads, tails, strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    path = path or default_tokenizer()
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, tails: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (ascending, without 0, the last is the end) and the penalty of a cut at each."""
    n = len(ids)
    ends = sentence_end[np.minimum(ids, len(sentence_end) - 1)]
    at = np.flatnonzero(ends if tails is None else ends | stop_ends(ids, tails)) + 1
    pos = np.union1d(at, np.append(doc_ends, n))
    pos = pos[pos > 0]
    gaps = np.diff(np.concatenate(([0], pos)))
    wide = np.flatnonzero(gaps > FORCED)
    forced = [np.arange(pos[k] - gaps[k] + FORCED, pos[k], FORCED) for k in wide]
    if forced:
        pos = np.union1d(pos, np.concatenate(forced))
    penalty = np.full(len(pos), HARD, dtype=np.int64)
    penalty[np.isin(pos, at)] = SENTENCE
    penalty[np.isin(pos, doc_ends)] = 0
    penalty[-1] = 0
    return pos, penalty


def best_cuts(pos: np.ndarray, penalty: np.ndarray, length: int = LENGTH, whole: bool = True) -> tuple[list[int], int]:
    """Ends of the windows with the least padding plus penalties for the cut points of one stream, and that least sum.

    If the stream goes on (not whole), the windows end at the cheapest cut point within the last length instead.
    """
    p, pen = [0, *pos.tolist()], [0, *penalty.tolist()]
    n = len(p)
    f, back, key = [0] * n, [(0, 0)] * n, [0] * n
    queues = [deque() for _ in range(RUNS + 1)]
    enter = [0] * (RUNS + 1)
    index, powers = {0: 0}, [w for w in POWERS if w <= length]
    for i in range(1, n):
        at, least, how = p[i], None, (0, 0)
        for m in range(RUNS + 1):
            q, j, low, high = queues[m], enter[m], at - length * (m + 1), at - length * m
            while j < i and p[j] < high:
                k = key[j]
                while q and key[q[-1]] >= k:
                    q.pop()
                q.append(j)
                j += 1
            enter[m] = j
            while q and p[q[0]] < low:
                q.popleft()
            if q:
                c = key[q[0]] + m * HARD - low
                if least is None or c < least:
                    least, how = c, (q[0], m)
            if low < 0:
                break
        for w in powers:
            j = index.get(at - w)
            if j is not None and f[j] < least:
                least, how = f[j], (j, 0)
        f[i], back[i], index[at] = least + pen[i], how, i
        key[i] = f[i] + at
    cuts, end = [], n - 1
    if not whole:
        end = max((k for k in range(n - 1) if p[k] > p[-1] - length), key=lambda k: (-f[k], k), default=0)
    i = end
    while i:
        j, m = back[i]
        cuts.append(p[i])
        cuts.extend(p[j] + length * k for k in range(m, 0, -1))
        i = j
    return cuts[::-1], f[end]


class Packer:
    """Takes documents in order and gives pieces; sequence numbers begin at first."""

    def __init__(self, sentence_end: np.ndarray, first: int, tails: tuple[np.ndarray, np.ndarray] | None = None):
        self.sentence_end, self.sequence, self.tails = sentence_end, first, tails
        self.docs: list[tuple] = []  # doc_id, tokens of the whole document, start of what is here, ids as bytes
        self.tokens = 0

    def add(self, doc_id, ids: bytes) -> Iterator[pa.RecordBatch]:
        self.docs.append((doc_id, len(ids) // 4, 0, ids))
        self.tokens += len(ids) // 4
        if self.tokens >= BLOCK_TOKENS:
            yield self.flush(False)

    def flush(self, last: bool) -> pa.RecordBatch:
        data = b"".join(d[3] for d in self.docs)
        ids = np.frombuffer(data, dtype="<u4")
        sizes = np.array([len(d[3]) // 4 for d in self.docs], dtype=np.int64)
        ends = np.cumsum(sizes)
        cuts, _ = best_cuts(*cut_points(ids, ends, self.sentence_end, self.tails), whole=last) if len(ids) else ([], 0)
        if last and cuts:
            rest = cuts[-1] - (begin := cuts[-2] if len(cuts) > 1 else 0)
            bits = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
            if (len(bits) - 1) * HARD < LENGTH - rest:
                cuts[-1:] = (begin + np.cumsum(bits)).tolist()
        done = cuts[-1] if cuts else 0
        marks = np.union1d(np.array(cuts, dtype=np.int64), ends[ends < done])
        begins = np.concatenate(([0], marks[:-1])) if len(marks) else np.zeros(0, np.int64)
        doc = np.searchsorted(ends, begins, side="right")
        window = np.searchsorted(cuts, begins, side="right")
        opened = np.concatenate(([0], cuts))[window]
        doc_begin = ends - sizes
        here = np.array([d[2] for d in self.docs], dtype=np.int64)
        total = np.array([d[1] for d in self.docs], dtype=np.int64)
        crc = np.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), marks.tolist(), strict=True)], dtype=np.int64)
        out = [pa.array([self.docs[d][0] for d in doc], type=pa.int64()), here[doc] + begins - doc_begin[doc], marks - begins, crc, total[doc], self.sequence + window, begins - opened]
        self.sequence += len(cuts)
        keep = int(np.searchsorted(ends, done, side="right"))
        left = []
        for k in range(keep, len(self.docs)):
            skip = max(0, done - int(doc_begin[k]))
            d = self.docs[k]
            left.append((d[0], d[1], d[2] + skip, d[3][4 * skip :]))
        self.docs, self.tokens = left, len(ids) - done
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(np.asarray(x, dtype=np.int64)) for x in out], schema=pa.schema(_FIELDS))


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    No shuffle: each partition of docs is one stream, and its number is the high part of sequence_id.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        packer = Packer(encode.sentence_end, TaskContext.get().partitionId() << 36, encode.tails)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            doc_ids, texts, k = batch.column(0).to_pylist(), batch.column(1), 0
            while k < batch.num_rows:
                some, chars = [], 0
                while k + len(some) < batch.num_rows and chars < BATCH_CHARS:
                    some.append(texts[k + len(some)].as_py() or "")
                    chars += len(some[-1])
                for doc_id, ids in zip(doc_ids[k : k + len(some)], encode(some), strict=True):
                    yield from packer.add(doc_id, ids + end)
                k += len(some)
        yield packer.flush(True)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
