"""Order-preserving packing of documents into sequences by dynamic programming.

Documents are tokenised whole and laid end to end in the order in which the
input has them.  Sequences of at most ``WINDOW`` tokens are cut where the sum
of padding and truncation penalties is smallest: a cut at a document's end is
free, one at a sentence end inside a document costs ``SENTENCE`` tokens, one
elsewhere (offered only where no sentence ends for ``GAP`` tokens) ``HARD``.
A sequence is padded to ``WINDOW`` unless its length is a power of two.

With f(j) the least cost up to cut j, padding is linear, so the best earlier
cut is the minimum of f(i) + position(i) over a sliding window: a monotone
queue gives it in constant time.  Cuts at a distance of a power of two are the
remaining transitions.  The program runs over blocks of about ``BLOCK`` tokens
of one partition, so memory is bounded by a block and the longest document.

Defined results: a null text counts as empty and still has its closing token;
rows with equal or null ids are packed like any other; extra columns are
ignored; an empty table has no pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
SENTENCE, HARD = 8, 96
GAP, STRIDE = 256, 64
BLOCK = 1 << 19
CLOSING = 1                       # id that closes a document
CACHED_WORDS = 800_000
SENTENCE_ENDS = (".", "!", "?")
_TAIL = ".,;:!?|#$%&*"

_PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, "
           "sequence_id long, offset long, sequence_tokens long")


class WordIds:
    """Token ids of words, remembered.

    The vocabulary never joins words across white space, so a text's ids are
    those of its words in turn.  A word of letters followed by marks is two
    pre-tokens; its letters are looked up without the marks.  Two generations
    of ``remembered`` words bound the memory; a worker keeps them for its tasks.
    """

    def __init__(self, tokenizer, remembered: int = CACHED_WORDS):
        self.tokenizer, self.remembered = tokenizer, remembered
        vocab = tokenizer.get_vocab()
        size = max(vocab.values()) + 1
        self.ends = np.zeros(size, bool)          # tokens that close a pre-token
        self.sentence = np.zeros(size + 1, bool)  # tokens that close a sentence
        for t, i in vocab.items():
            self.ends[i] = t.endswith("</w>")
            self.sentence[i] = t.endswith(tuple(c + "</w>" for c in SENTENCE_ENDS))
        self.now: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encode(self, words: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in done]

    def _stems(self, stems: list[str]) -> list[bytes]:
        """Ids of words of letters: encoded as one text and cut at pre-token ends, when those agree."""
        out = []
        for at in range(0, len(stems), 4096):
            part = stems[at:at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part) and (len(cuts) == 0 or cuts[-1] == len(ids)):
                raw, begin = ids.tobytes(), 0
                for c in (cuts * 4).tolist():
                    out.append(raw[begin:c])
                    begin = c
            else:
                out.extend(self._encode(part))
        return out

    def learn(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """A lookup that holds every one of ``words``."""
        now, old = self.now, self.old
        new = []
        for w in words:
            if w not in now:
                ids = old.get(w)
                if ids is None:
                    new.append(w)
                else:
                    now[w] = ids
        stems, tails, whole = {}, {}, []
        split = []
        for w in new:
            s = w.decode("utf-8", "replace")
            core = s.rstrip(_TAIL)
            if core.isalpha():
                tail = s[len(core):]
                stems[core] = b""
                tails[tail] = b""
                split.append((w, core, tail))
            else:
                whole.append((w, s))
        stems = dict(zip(stems, self._stems(list(stems)), strict=True))
        tails = dict(zip(tails, self._encode(list(tails)), strict=True))
        for w, core, tail in split:
            now[w] = stems[core] + tails[tail]
        for (w, _), ids in zip(whole, self._encode([s for _, s in whole]), strict=True):
            now[w] = ids
        lookup = now
        if len(now) > self.remembered:
            self.old, self.now = now, {}
        return lookup


def _process_words(tokenizer_json: str, remembered: int) -> WordIds:
    """The words that this Python worker has learnt; its later tasks find them again.

    They hang on the tokenizer library, because functions that travel by value have no lasting module of their own.
    """
    import tokenizers

    kept = vars(tokenizers).setdefault("_learnt_words", {})
    key = hashlib.sha256(tokenizer_json.encode()).digest(), remembered
    if key not in kept:
        kept.clear()
        kept[key] = WordIds(tokenizers.Tokenizer.from_str(tokenizer_json), remembered)
    return kept[key]


def candidates(ids: np.ndarray, sentence: np.ndarray, doc_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions (0 and the end included) and their penalties."""
    cost = np.full(len(ids) + 1, -1, np.int64)
    cost[np.flatnonzero(sentence[ids]) + 1] = SENTENCE
    cost[doc_ends] = 0
    cost[0] = 0
    at = np.flatnonzero(cost >= 0)
    wide = np.flatnonzero(np.diff(at) > GAP)
    if len(wide):
        extra = np.concatenate([np.arange(at[k] + STRIDE, at[k + 1], STRIDE) for k in wide.tolist()])
        cost[extra] = HARD
        at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def cut(at: np.ndarray, penalty: np.ndarray, window: int = WINDOW) -> list[int]:
    """Indexes of the cuts (first and last included) of least total cost."""
    m = len(at)
    exact: dict[int, list[int]] = {}
    q = 1
    while q < window:
        i = np.searchsorted(at, at - q)
        hit = np.flatnonzero(at[np.minimum(i, m - 1)] == at - q)
        for j, k in zip(hit.tolist(), i[hit].tolist(), strict=True):
            exact.setdefault(j, []).append(k)
        q *= 2
    pos, pen = at.tolist(), penalty.tolist()
    f, back = [0] * m, [0] * m
    value, index, head = [], [], 0      # monotone queue: increasing f + position
    for j in range(1, m):
        g = f[j - 1] + pos[j - 1]
        while len(value) > head and value[-1] >= g:
            value.pop()
            index.pop()
        value.append(g)
        index.append(j - 1)
        p = pos[j]
        while pos[index[head]] < p - window:
            head += 1
        i = index[head]
        best = value[head] + window - p
        for k in exact.get(j, ()):
            if f[k] < best:
                best, i = f[k], k
        f[j] = best + pen[j]
        back[j] = i
    path = [m - 1]
    while path[-1]:
        path.append(back[path[-1]])
    return path[::-1]


def pieces(ids: np.ndarray, doc_ends: np.ndarray, seq_ends: np.ndarray) -> dict[str, np.ndarray]:
    """Pieces of a block: where documents and sequences overlap."""
    ends = np.union1d(doc_ends, seq_ends)
    starts = np.concatenate(([0], ends[:-1]))
    doc, seq = np.searchsorted(doc_ends, starts, "right"), np.searchsorted(seq_ends, starts, "right")
    doc_start = np.concatenate(([0], doc_ends))[doc]
    seq_start = np.concatenate(([0], seq_ends))[seq]
    return {"doc": doc, "begin": starts, "end": ends, "start": starts - doc_start, "seq": seq,
            "doc_tokens": doc_ends[doc] - doc_start, "offset": starts - seq_start,
            "sequence_tokens": seq_ends[seq] - seq_start}


def _packer(tokenizer_json: str, remembered: int):
    def run(batches):
        words_ids = _process_words(tokenizer_json, remembered)
        closing = np.array([CLOSING], "<u4").tobytes()
        base, n_seq = TaskContext.get().partitionId() << 40, 0
        doc_ids, parts, tokens = [], [], 0

        def flush():
            nonlocal n_seq
            ids = np.frombuffer(b"".join(parts), "<u4")
            doc_ends = np.cumsum([len(p) // 4 for p in parts])
            at, penalty = candidates(ids, words_ids.sentence, doc_ends)
            p = pieces(ids, doc_ends, at[cut(at, penalty)[1:]])
            raw = ids.tobytes()
            spans = zip((p["begin"] * 4).tolist(), (p["end"] * 4).tolist(), strict=True)
            out = pa.RecordBatch.from_arrays([
                pa.array([doc_ids[d] for d in p["doc"].tolist()], pa.int64()), pa.array(p["start"], pa.int64()),
                pa.array(p["end"] - p["begin"], pa.int64()), pa.array([raw[b:e] for b, e in spans], pa.binary()),
                pa.array(p["doc_tokens"], pa.int64()), pa.array(base + n_seq + p["seq"], pa.int64()),
                pa.array(p["offset"], pa.int64()), pa.array(p["sequence_tokens"], pa.int64())],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_tokens"])
            n_seq += int(p["seq"][-1]) + 1
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                texts = [(t or b"").split() for t in rows.column(1).cast(pa.large_binary()).to_pylist()]
                lookup = words_ids.learn(set().union(*texts))
                for doc_id, ws in zip(rows.column(0).to_pylist(), texts, strict=True):
                    ids = b"".join(map(lookup.__getitem__, ws)) + closing
                    doc_ids.append(doc_id)
                    parts.append(ids)
                    tokens += len(ids) // 4
                    if tokens >= BLOCK:
                        yield flush()
                        doc_ids, parts, tokens = [], [], 0
        if parts:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text",
         order_by: str | None = None, remembered: int = CACHED_WORDS) -> DataFrame:
    """Pieces: (doc_id, start, length, ids, doc_tokens, sequence_id, offset, sequence_tokens).

    ``ids`` are little-endian unsigned 32-bit.  Documents keep the order of the
    input partitions; ``order_by`` first range-partitions and sorts by a
    column.  ``sequence_id`` is unique: partition, then sequence within it.
    The vocabulary file is read on the driver and travels with the job.
    ``remembered`` words are a generation of a worker's memory: fewer take less
    memory and more time.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
                       *([F.col(order_by).alias("place")] if order_by else []))
    if order_by:
        n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.repartitionByRange(n, "place").sortWithinPartitions("place").drop("place")
    return rows.mapInArrow(_packer(tokenizer_json, remembered), _PIECES)


def padded(sequence_tokens: int, window: int = WINDOW) -> int:
    """Length of a sequence after padding."""
    return sequence_tokens if sequence_tokens & (sequence_tokens - 1) == 0 else window


