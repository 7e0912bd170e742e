"""SentencePiece encoding and decoding by weighted transduction (op 6).

A model file is compiled into three parts: the normaliser (dummy prefix,
white-space escape, optional white-space folding), the piece lexicon - a
letter automaton whose final states carry piece ids and weights - and byte
fallback for characters outside it. A text is composed with them lazily,
segment by segment, and the path of least weight in the tropical semiring
(min, +) is its encoding:

* unigram models weigh a piece by its negative log probability;
* BPE models weigh pieces 0 and pairs of neighbouring pieces by a pair
  acceptor: 0 if merging their joined text by rank leaves exactly the two,
  infinite otherwise. A sequence is the merge result if and only if all
  its neighbours pass, so exactly one path has finite weight, and the least
  path is the library's encoding without replaying merges on the text.
  Pairs are judged once and remembered.

No piece spans a cut between a non-space and a space, so segments are
composed one at a time; those that recur are looked up. Both memories are
bounded in bytes for each worker and last as long as it does. Rows are handled
in place, without any shuffle.

Cases: null texts count as empty and have no ids; texts of any length are
encoded whole (time and memory in proportion); repeated rows are encoded
alike; an empty table gives an empty result; other columns stay as they are,
whatever their names, but for one that has the output's name, which is replaced.
Models with a compiled character map (NFKC and the like) are refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
#: Segments up to this long are remembered.
SHORT = 48
#: Bytes that each of a worker's two memories may take, by the estimates below.
MEMORY = 40 << 20
#: Bytes of a pair's entry and of a segment's, without its letters and ids.
_PAIR, _ENTRY = 110, 190
UNKNOWN_PENALTY = 10.0
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6
_BPE, _UNIGRAM = 2, 1


class Transducer:
    """Compiled model: ``encode(text) -> ids`` and ``decode(ids) -> text``."""

    def __init__(self, pieces: list[tuple[str, float, int]], bpe: bool, dummy_prefix: bool = True, fold_spaces: bool = False):
        self.bpe, self.dummy_prefix, self.fold_spaces = bpe, dummy_prefix, fold_spaces
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == _NORMAL}
        self.score = [s for _, s, _ in pieces]
        self.unknown = next(i for i, p in enumerate(pieces) if p[2] == _UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == _BYTE}
        self.surface = [bytes([int(p[3:5], 16)]) if kind == _BYTE else p.replace(SPACE, " ").encode() if kind == _NORMAL else
                        " ⁇ ".encode() if kind == _UNKNOWN else b"" for p, _, kind in pieces]
        self.text = [p for p, _, _ in pieces]
        self.least = min((self.score[i] for i in self.ids.values()), default=0.0)
        spanning = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        line = "" if any("\n" in p for p in self.ids) else "\n"
        self.cut = None if spanning else re.compile(f"{SPACE}*[^{SPACE}{line}]+|{SPACE}+" + (f"|{line}" if line else ""))
        # states of the letter automaton: {letter: (next state, id or None)}
        self.lexicon: dict = {}
        for piece, i in self.ids.items():
            if bpe and self._merged(piece) != [piece]:
                continue  # merging never yields it
            node = self.lexicon
            for ch in piece[:-1]:
                node = node.setdefault(ch, ({}, None))[0]
            below = node.get(piece[-1], ({}, None))[0]
            node[piece[-1]] = (below, i)
        self.forget()

    def forget(self) -> None:
        """Empty the memories of pairs and segments: of each a young and an old
        half; when the young one is full it becomes the old, and what is found
        in the old returns to the young."""
        self._pair: dict[int, bool] = {}
        self._old_pair: dict[int, bool] = {}
        self._seen: dict[str, bytes] = {}
        self._old_seen: dict[str, bytes] = {}
        self._held = 0

    # normaliser
    def normalise(self, text: str) -> str:
        if self.fold_spaces:
            text = re.sub(" +", " ", text.strip(" "))
        if text and self.dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE)

    # pair acceptor of merge models
    def _merged(self, text: str) -> list[str]:
        """Merge by rank: the best-scored neighbours, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if best is None:
                return parts
            parts[at: at + 2] = [parts[at] + parts[at + 1]]

    def _allowed(self, left: int, right: int) -> bool:
        """Is the weight of the pair of pieces 0?"""
        key = left * len(self.text) + right
        ok = self._old_pair.get(key)
        if ok is None:
            a, b = self.text[left], self.text[right]
            ok = self._merged(a + b) == [a, b]
        if len(self._pair) * _PAIR > MEMORY // 2:
            self._pair, self._old_pair = {}, self._pair
        self._pair[key] = ok
        return ok

    # shortest path
    def _arcs(self, text: str, s: int) -> list[tuple[int, int]]:
        """(end, id) of the lexicon's arcs from position s, short to long; id
        -1 is byte fallback for a character that is no piece."""
        node, out = self.lexicon, []
        for e in range(s, len(text)):
            hit = node.get(text[e])
            if hit is None:
                break
            node, k = hit
            if k is not None:
                out.append((e + 1, k))
        if not out or out[0][0] != s + 1:
            out.insert(0, (s + 1, -1))
        return out

    def _path_of_pairs(self, text: str) -> tuple[int, ...]:
        """Merge models: weights are 0 or infinite, so the first complete path
        that is found is the shortest. Depth first, long arcs first; a position
        that leads nowhere is dead, as only one path of weight 0 reaches it."""
        n, size = len(text), len(self.text)
        path: list[int] = []
        at, left, open_, dead = [0], -1, [self._arcs(text, 0)], set()
        while at[-1] < n:
            arcs = open_[-1]
            while arcs:
                e, k = arcs.pop()
                if e in dead:
                    continue
                if k >= 0 and left >= 0:
                    ok = self._pair.get(left * size + k)
                    if not (self._allowed(left, k) if ok is None else ok):
                        continue
                path.append(k)
                at.append(e)
                left = k
                if e < n:
                    open_.append(self._arcs(text, e))
                break
            else:
                dead.add(at.pop())
                open_.pop()
                path.pop()
                left = path[-1] if path else -1
        return tuple(path) if -1 not in path else tuple(chain.from_iterable((k,) if k >= 0 else self._fallback(text[s]) for k, s in zip(path, at)))

    def _path(self, text: str) -> tuple[int, ...]:
        """Unigram models: the lightest path, position by position."""
        n = len(text)
        weight = [0.0] + [float("inf")] * n
        last, back = [-1] * (n + 1), [0] * (n + 1)
        unknown = UNKNOWN_PENALTY - self.least
        for s in range(n):
            for e, k in self._arcs(text, s):
                w = weight[s] + (unknown if k < 0 else -self.score[k])
                if w < weight[e]:
                    weight[e], last[e], back[e] = w, k, s
        out: list[tuple[int, ...]] = []
        e = n
        while e > 0:
            out.append((last[e],) if last[e] >= 0 else self._fallback(text[back[e]: e]))
            e = back[e]
        return tuple(chain.from_iterable(reversed(out)))

    def _fallback(self, ch: str) -> tuple[int, ...]:
        if len(self.bytes) == 256:
            return tuple(self.bytes[b] for b in ch.encode())
        return (self.unknown,)

    def _segment(self, text: str) -> bytes:
        """A segment's ids, as the bytes of 32-bit numbers."""
        found = self._seen.get(text)
        if found is None:
            found = self._old_seen.get(text)
            if found is None:
                found = np.array(self._path_of_pairs(text) if self.bpe else self._path(text), np.int32).tobytes()
            if len(text) <= SHORT:
                self._held += _ENTRY + 2 * len(text) + len(found)
                if self._held > MEMORY // 2:
                    self._seen, self._old_seen, self._held = {}, self._seen, 0
                self._seen[text] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        norm = self.normalise(text)
        parts = self.cut.findall(norm) if self.cut else [norm]
        seen, segment = self._seen.get, self._segment
        return np.frombuffer(b"".join([seen(p) or segment(p) for p in parts]), np.int32)

    def decode(self, ids) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids))
        if self.dummy_prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def compile_model(path: str) -> Transducer:
    """Compile a ``.model`` file."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    if model.normalizer_spec.precompiled_charsmap:
        raise ValueError("models with a compiled character map are not supported")
    if model.trainer_spec.model_type not in (_BPE, _UNIGRAM):
        raise ValueError("only BPE and unigram models are supported")
    return Transducer([(p.piece, p.score, p.type) for p in model.pieces], model.trainer_spec.model_type == _BPE,
                      model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces)


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The compiled model of a file, once per Python worker."""
    if path not in _compiled:
        _compiled[path] = compile_model(path)
    return _compiled[path]


def default_model() -> str:
    """The public model installed with the tokenizer files."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def _lists(ids: list[np.ndarray]) -> pa.Array:
    off = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))


def _slices(batches: Iterator[pa.RecordBatch], size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about ``size`` bytes, so that what a batch yields is bounded too."""
    for batch in batches:
        per = max(1, int(size * batch.num_rows / max(1, batch.nbytes)))
        for a in range(0, batch.num_rows, per):
            yield batch.slice(a, per)


def encode(docs: DataFrame, model: str | None = None, text_col: str = "text", out_col: str = "ids", same_col: str | None = None) -> DataFrame:
    """``docs`` with the column ``out_col``, the ids of the text, and if it is
    named ``same_col``: decoding gave the text back (null counts as empty)."""
    path = model or default_model()
    added = [out_col] + ([same_col] if same_col else [])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(path)
        for batch in _slices(batches):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            ids = [fst.encode(t) for t in texts]
            new = [_lists(ids)]
            if same_col:
                new.append(pa.array([fst.decode(i.tolist()) == t for i, t in zip(ids, texts)], pa.bool_()))
            yield pa.record_batch([*batch.columns, *new], [f"c{i}" for i in range(batch.num_columns + len(new))])

    kept = [(i, f) for i, f in enumerate(docs.schema) if f.name not in added]
    return _by_place(docs, run, [T.ArrayType(T.IntegerType()), T.BooleanType()][: len(added)], added, kept)


def _by_place(rows: DataFrame, run, types: list[T.DataType], names: list[str], kept: list) -> DataFrame:
    """``rows`` through ``run``, which adds columns of ``types``: inside, columns
    have names by place, so that no name of theirs meets another; of the
    own ones those in ``kept`` come back under their names, then the new ones."""
    n = len(rows.columns)
    inner = rows.toDF(*[f"c{i}" for i in range(n)])
    schema = T.StructType([*inner.schema, *[T.StructField(f"c{n + i}", t) for i, t in enumerate(types)]])
    out = inner.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(f.name) for i, f in kept], *[F.col(f"c{n + i}").alias(c) for i, c in enumerate(names)])


def decode(rows: DataFrame, model: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``rows`` with the column ``out_col``, the text of the ids; null ids are none."""
    path = model or default_model()

    at = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(path)
        for batch in _slices(batches):
            texts = pa.array([fst.decode(i or ()) for i in batch.column(at).to_pylist()], pa.string())
            yield pa.record_batch([*batch.columns, texts], [f"c{i}" for i in range(batch.num_columns + 1)])

    kept = [(i, f) for i, f in enumerate(rows.schema) if f.name != out_col]
    return _by_place(rows, run, [T.StringType()], [out_col], kept)


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids, n_ids, decoded_sha256 (lowercase hex of the decoded text),
    same (decoding gave the text back; null counts as empty)."""
    path = model or default_model()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(path)
        for batch in _slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = [fst.encode(t) for t in texts]
            back = [fst.decode(i.tolist()) for i in ids]
            yield pa.record_batch([batch.column("doc_id"), _lists(ids), pa.array([len(i) for i in ids], pa.int64()),
                                   pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]), pa.array([a == b for a, b in zip(texts, back)])],
                                  ["doc_id", "ids", "n_ids", "decoded_sha256", "same"])

    return rows.mapInArrow(run, "doc_id long, ids array<int>, n_ids long, decoded_sha256 string, same boolean")
