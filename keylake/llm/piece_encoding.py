"""SentencePiece encoding and decoding of merge-type (BPE) models.

Spark deals the texts out; in a task each text is cut into chunks that no piece of the vocabulary can
cross (a run of word marks with what follows it), and each distinct chunk is encoded once. A chunk is
encoded by backtracking: Aho-Corasick finds all pieces in it, the longest at a place is tried first,
a piece is accepted only if it and its predecessor stay two pieces when their joined text is merged
again, and a bit field marks places from which no encoding went on, so that the work is linear in
the chunk. That gives exactly what merging by rank gives, as each text has one encoding all of whose
neighbours are compatible. Chunks with runs of spaces, or whose pieces have equal ranks, are merged
directly, since the argument needs distinct ranks.

Defined cases: a null or empty text has no ids and decodes to ""; repeated rows are encoded each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylake.llm.common import batch_of, shared_file, text_or_empty

MARK = "▁"
CACHED = 800_000


class PieceModel:
    """Pieces and ranks of a SentencePiece BPE model with byte fallback and no normalisation."""

    def __init__(self, raw: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto.FromString(raw)
        if model.trainer_spec.model_type != 2 or model.normalizer_spec.precompiled_charsmap or not model.trainer_spec.byte_fallback or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only BPE models with byte fallback and identity normalisation are handled")
        self.dummy_prefix = model.normalizer_spec.add_dummy_prefix
        kinds = type(model.pieces[0])
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces aren't handled")
        self.pieces = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        by_name = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.byte_ids = [by_name[f"<0x{b:02X}>"] for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.silent = {i for i, p in enumerate(model.pieces) if p.type in (kinds.CONTROL,)}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a word mark inside; chunks would not be independent")
        seen, self.tied = set(), set()
        for p, s in self.scores.items():
            (self.tied if s in seen else seen).add(s)
        self.tied = {p for p, s in self.scores.items() if s in self.tied}
        #: Finds a tied piece anywhere in a chunk, whether or not its encoding would use it.
        self.ties = re.compile("|".join(map(re.escape, self.tied)) or r"(?!)")
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if self.merge(p) == [p]:  # only pieces that merging can end with
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self._pairs: dict[tuple[str, str], bool] = {}

    def merge(self, chunk: str) -> list[str]:
        """The definition: again and again join the neighbours with the best score, the leftmost of equals."""
        parts: list[str | None] = list(chunk)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (joined := parts[i] + parts[j]) in self.scores:
                heapq.heappush(heap, (-self.scores[joined], i, joined))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= len(parts) or parts[j] is None or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the joined text gives the two pieces again."""
        known = self._pairs.get((a, b))
        if known is None:
            known = self.merge(a + b) == [a, b]
            if len(self._pairs) < CACHED:
                self._pairs[a, b] = known
        return known

    def backtrack(self, chunk: str) -> list[str]:
        """The encoding of a chunk without ties, all of whose characters are in the vocabulary or stand alone."""
        n = len(chunk)
        ends: list[list[int]] = [[] for _ in range(n)]
        for last, piece in self.automaton.iter(chunk):
            ends[last + 1 - len(piece)].append(last + 1)
        for at in ends:
            at.reverse()  # the longest first
        failed = bytearray(n // 8 + 1)
        out: list[tuple[int, int]] = []  # start, and which of the start's ends is in use
        at, choice = 0, 0
        while at < n:
            options = ends[at] or [at + 1]
            found = -1
            for k in range(choice, len(options)):
                end = options[k]
                if failed[end >> 3] >> (end & 7) & 1:
                    continue
                if not out or self._fits(chunk, out[-1][0], at, end):
                    found = k
                    break
            if found >= 0:
                out.append((at, found))
                at, choice = options[found], 0
            else:
                if not out:
                    return self.merge(chunk)
                failed[at >> 3] |= 1 << (at & 7)
                at, k = out.pop()
                choice = k + 1
        starts = [s for s, _ in out] + [n]
        return [chunk[a:b] for a, b in zip(starts, starts[1:])]

    def _fits(self, chunk: str, start: int, mid: int, end: int) -> bool:
        a, b = chunk[start:mid], chunk[mid:end]
        return a not in self.ids or b not in self.ids or self.compatible(a, b)

    def chunk_ids(self, chunk: str) -> list[int]:
        parts = self.merge(chunk) if chunk[:2] == MARK * 2 or self.ties.search(chunk) else self.backtrack(chunk)
        out: list[int] = []
        for p in parts:
            if p in self.ids:
                out.append(self.ids[p])
            else:
                out += [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")]
        return out

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        marked = text.replace(" ", MARK)
        return _CHUNK.findall(MARK + marked if self.dummy_prefix else marked)

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks(text) for i in self.chunk_ids(c)]

    def joined(self, ids: list[int]) -> str:
        """Pieces joined, marks as spaces, byte pieces as UTF-8 with U+FFFD for each stray byte."""
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_utf8(raw))
                raw.clear()
            if i not in self.silent:
                out.append(self.pieces[i])
        if raw:
            out.append(_utf8(raw))
        return "".join(out).replace(MARK, " ")

    def unprefixed(self, text: str) -> str:
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def decode(self, ids: list[int]) -> str:
        return self.unprefixed(self.joined(ids))


_CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def _utf8(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):  # one replacement for each byte that starts no character
            for n in (1, 2, 3, 4):
                try:
                    out.append(bytes(raw[i : i + n]).decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


class _Coded(dict):
    """chunk -> (ids as text, how many, their text), each chunk encoded once while it stays."""

    def __init__(self, model: PieceModel):
        self.model = model

    def __missing__(self, chunk: str):
        ids = self.model.chunk_ids(chunk)
        value = (",".join(map(str, ids)), len(ids), self.model.joined(ids))
        if len(chunk) <= 64 and len(self) < CACHED:
            self[chunk] = value
        return value


_models: dict[str, tuple[PieceModel, _Coded]] = {}


def _model(name: str, file) -> tuple[PieceModel, _Coded]:
    """The model of this worker; file: its broadcast bytes."""
    if name not in _models:
        model = PieceModel(file.value)
        _models[name] = model, _Coded(model)
    return _models[name]


def encoded(documents: DataFrame, model_path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array of int, or null without with_ids), ids_sha256 and decoded_sha256 of each text."""

    file, name = shared_file(documents.sparkSession, model_path)

    def rows(it):
        model, coded = _model(name, file)
        for b in it:
            n, ids, ids_sha, out_sha = [], [], [], []
            for text in b.column("text").to_pylist():
                parts = [coded[c] for c in model.chunks(text)]
                joined = ",".join([p[0] for p in parts])
                decoded = model.unprefixed("".join([p[2] for p in parts]))
                n.append(sum([p[1] for p in parts]))
                if with_ids:
                    ids.append([int(x) for x in joined.split(",")] if joined else [])
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                out_sha.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
            yield batch_of({"doc_id": (b.column("doc_id"), None), "n_tokens": (n, pa.int64()), "ids": (ids if with_ids else [None] * len(n), pa.list_(pa.int32())), "ids_sha256": (ids_sha, pa.string()), "decoded_sha256": (out_sha, pa.string())})

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return source.mapInArrow(rows, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def op6(spark: SparkSession, documents: DataFrame, model_path: str) -> DataFrame:
    return encoded(documents, model_path, with_ids=False).drop("ids")
