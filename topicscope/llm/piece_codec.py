"""Encoding to piece ids by streaming Viterbi, and decoding back.

A text is cut into pieces of a given vocabulary so that the sum of their scores
is largest (ties: the longer last piece).  The search keeps only a window: a
head is a boundary from which a coming piece may still start, and those lie
within the longest piece's length.  Whenever the backpointer paths of all heads
meet in one boundary, everything before it is certain and its ids are committed.

Where no piece of the vocabulary can straddle two kinds of characters, all
paths meet between them; these stretches (mostly words) are solved once per
worker and remembered, in two generations of bounded size.

As the vocabulary's own rules ask, a space is put before the text and spaces are
written as U+2581.  Characters without a piece (a literal U+2581 too) become
byte pieces, so decoding returns every text exactly.  Null and empty texts have
no ids; repeated rows are encoded alike; extra columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MEMO = 300_000
LONG = 64

# spaces before a run of letters, one digit, a run of other signs, or a line end
_STRETCH = re.compile(r" *(?:[^\W\d_²]+|\d|(?:[^\w \n]|[_²])+|\n)| +")


@dataclass
class Vocabulary:
    """Pieces (spaces as spaces) with id and score, and the 256 byte ids."""

    pieces: dict[str, tuple[int, float]]
    byte_ids: list[int]
    longest: int = field(init=False)
    starts: set[str] = field(init=False)
    byte_score: float = field(init=False)

    def __post_init__(self) -> None:
        self.longest = max(map(len, self.pieces), default=1)
        self.starts = {p[:n] for p in self.pieces for n in range(1, len(p))}
        # below any piece, so bytes are used only where no piece fits
        self.byte_score = min((s for _, s in self.pieces.values() if s > -1e8), default=0.0) - 10.0

    @property
    def stretches(self) -> bool:
        """Whether every piece lies inside one stretch."""
        return all(_STRETCH.fullmatch(p) for p in self.pieces)

    def decoder(self) -> list[bytes]:
        table = [b""] * (max([i for i, _ in self.pieces.values()] + self.byte_ids) + 1)
        for p, (i, _) in self.pieces.items():
            table[i] = p.encode()
        for b, i in enumerate(self.byte_ids):
            table[i] = bytes([b])
        return table


def load_vocabulary(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, byte_ids = {}, [0] * 256
    for i in range(model.vocab_size()):
        p = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(p[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[p.replace(MARK, " ")] = (i, model.get_score(i))
    return Vocabulary(pieces, byte_ids)


def stream(vocab: Vocabulary, chars: Iterable[str], commit_every: int | None = None) -> Iterator[list[int]]:
    """Committed ids, list by list, of a text that arrives in parts of any size."""
    pieces, starts, longest = vocab.pieces, vocab.starts, vocab.longest
    every = commit_every or 4 * longest
    # boundary 0 is the last committed one; score, backpointer and ids of the rest
    window, score, back, ids = "", [0.0], [0], [()]
    open_to = 0  # boundaries below this have sent out all their pieces

    def send(i: int) -> None:
        """All pieces that start at boundary i."""
        here, end = score[i], min(len(window), i + longest)
        for j in range(i + 1, end + 1):
            piece = window[i:j]
            hit = pieces.get(piece)
            if hit is not None and here + hit[1] > score[j]:
                score[j], back[j], ids[j] = here + hit[1], i, (hit[0],)
            if piece not in starts:
                break
        if back[i + 1] < 0:
            raw = window[i].encode()
            score[i + 1], back[i + 1], ids[i + 1] = here + vocab.byte_score * len(raw), i, tuple(vocab.byte_ids[b] for b in raw)

    def path(lo: int, hi: int) -> list[int]:
        parts = []
        while hi > lo:
            parts.append(ids[hi])
            hi = back[hi]
        return [x for part in reversed(parts) for x in part]

    def commit() -> list[int]:
        """Ids up to the boundary where the paths of all heads meet."""
        nonlocal window, score, back, ids, open_to
        heads = {j for j in range(open_to, min(len(score), open_to + longest)) if back[j] >= 0}
        while len(heads) > 1:
            top = max(heads)
            heads.remove(top)
            heads.add(back[top])
        at = heads.pop()
        out = path(0, at)
        if at:
            window, score, ids = window[at:], score[at:], ids[at:]
            back = [0, *(b - at if b >= 0 else -1 for b in back[at + 1 :])]
            open_to -= at
        return out

    for part in chars:
        for k in range(0, len(part), every):
            bit = part[k : k + every]
            window += bit
            score += [-np.inf] * len(bit)
            back += [-1] * len(bit)
            ids += [()] * len(bit)
            # a boundary whose longest piece might not have arrived yet waits
            while open_to + longest <= len(window):
                send(open_to)
                open_to += 1
            if out := commit():
                yield out
    while open_to < len(window):
        send(open_to)
        open_to += 1
    if out := path(0, len(window)):
        yield out


def within_window(vocab: Vocabulary, text: str) -> list[int]:
    """The same search for a text no longer than the window, which needs no
    commits before its end."""
    n, starts, find = len(text), vocab.starts, vocab.pieces.get
    score, back, ids = [-np.inf] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
    score[0] = 0.0
    for i in range(n):
        here = score[i]
        for j in range(i + 1, n + 1):
            piece = text[i:j]
            hit = find(piece)
            if hit is not None and here + hit[1] > score[j]:
                score[j], back[j], ids[j] = here + hit[1], i, hit[0]
            if piece not in starts:
                break
        if back[i + 1] < 0:
            raw = text[i].encode()
            score[i + 1], back[i + 1], ids[i + 1] = here + vocab.byte_score * len(raw), i, -1
    out = []
    while n:
        i = back[n]
        if ids[n] < 0:
            out += [vocab.byte_ids[b] for b in reversed(text[i:n].encode())]
        else:
            out.append(ids[n])
        n = i
    return out[::-1]


class Encoder:
    """Texts to ids, remembering the stretches it has solved."""

    def __init__(self, vocab: Vocabulary, memo: int = MEMO):
        self.vocab, self.size = vocab, memo
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cut = vocab.stretches

    def _solve(self, stretch: str) -> bytes:
        got = self.young.get(stretch) or self.old.get(stretch)
        if got is None:
            small = len(stretch) <= self.vocab.longest
            ids = within_window(self.vocab, stretch) if small else [x for out in stream(self.vocab, (stretch,)) for x in out]
            got = array("i", ids).tobytes()
        if len(stretch) <= LONG:
            if len(self.young) >= self.size:
                self.old, self.young = self.young, {}
            self.young[stretch] = got
        return got

    def encode(self, text: str) -> bytes:
        """The ids as packed int32."""
        if not text:
            return b""
        if not self.cut:
            return self._solve(" " + text)
        parts = _STRETCH.findall(" " + text)
        known = list(map(self.young.get, parts))
        if None in known:
            known = [self._solve(s) if k is None else k for s, k in zip(parts, known, strict=True)]
        return b"".join(known)


def decode(table: list[bytes], ids: list[int]) -> str:
    return b"".join([table[i] for i in ids]).decode()[1:]


_WORKER: dict[int, Encoder] = {}


def encoded(docs: DataFrame, vocab: Vocabulary | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_ids, ids of every row, and whether decoding gave the text back."""
    vocab = vocab or load_vocabulary()
    table, key = vocab.decoder(), hash((len(vocab.pieces), vocab.longest, tuple(sorted(vocab.pieces.items()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _WORKER.setdefault(key, Encoder(vocab))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                packed, exact = [], []
                for t in batch.column("text"):
                    t = t.as_py() or ""
                    ids = encoder.encode(t)
                    packed.append(ids)
                    exact.append(decode(table, np.frombuffer(ids, np.int32).tolist()) == t)
                counts = np.array([len(x) // 4 for x in packed], np.int32)
                values = pa.array(np.frombuffer(b"".join(packed), np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.append(np.int32(0), np.cumsum(counts, dtype=np.int32))), values)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts.astype(np.int64)), lists, pa.array(exact)], names=["doc_id", "n_ids", "ids", "exact"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_ids long, ids array<int>, exact boolean")


def decoded(rows: DataFrame, vocab: Vocabulary | None = None, ids: str = "ids") -> DataFrame:
    """``rows`` with the column ``text`` decoded from ``ids``."""
    table = (vocab or load_vocabulary()).decoder()
    schema = rows.select("*", F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode(table, x or []) for x in batch.column(ids).to_pylist()]
            yield batch.append_column("text", pa.array(texts, pa.string()))

    return rows.mapInArrow(run, schema)
