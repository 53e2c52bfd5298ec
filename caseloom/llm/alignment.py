"""Cross-tokenizer alignment with a dictionary of groups.

Two tokenizers, A (byte-level BPE) and B (pieces with byte fallback), cut the same
bytes. Byte offsets where tokens of both end cut them into groups, and tokens of a
group whose byte ranges overlap are linked.

Texts repeat few groups many times, so groups are interned: a group's key is its
A ids and B ids, and everything that depends on the ids alone is worked out once a
distinct group. Each task reads its documents in chunks of bounded size and
writes, for each chunk, the distinct groups it holds (the chunk's dictionary), the
numbers and frequencies of each document's groups in that dictionary, and for each
linked id pair the number of documents that hold it. Then

1. pairs are summed over the chunks: documents corpus-wide, and the best of an A id;
2. the distinct groups of all dictionaries are expanded into links once, and joined
   with the pairs: what one occurrence of a group is worth;
3. these values are joined back to the dictionaries by group key, and each chunk
   multiplies them by its documents' frequencies.

What is shuffled are dictionaries and numbers, not tokens.

Tokens are found by segment: both tokenizers always cut before a single space, and
before a single line feed, between other characters (the piece vocabulary is
checked for that; texts go whole where it does not hold). So segments are encoded by
themselves and remembered, up to a fixed number.

Nulls and odd input: a text that is null or empty, or whose bytes the tokens of A or
B do not give back, has no tokens, zeros and an empty digest; strings of special
tokens are plain text; a null or repeated id is kept, each row being a document of
its own; very long texts are a chunk of their own, encoded whole; an empty table
gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, map_batches, scratch_path, stash

SPACE = "▁"
#: Characters of text that share a dictionary, unless one text is longer.
CHUNK_CHARS = 16 << 20
#: Segments (of each of two generations) and groups that a worker remembers, and the longest segment among them.
_SEGMENTS, _GROUPS, _SEGMENT_CHARS = 400_000, 600_000, 48
#: From a cut to the next: a single space or line feed between other characters is one.
_SEGMENT = re.compile(r"\s*\S+(?:(?![ \n]\S)\s+\S+)*(?:\s+\Z)?|\s+")


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def links(a: tuple[int, ...], b: tuple[int, ...], a_sizes: list[int], b_sizes: list[int]) -> list[tuple[int, int]]:
    """Id pairs of a group whose byte ranges overlap, one for each pair of occurrences."""
    found, i, j, a_end, b_end = [], 0, 0, a_sizes[a[0]], b_sizes[b[0]]
    while i < len(a) and j < len(b):
        found.append((a[i], b[j]))
        ends_a, ends_b = a_end <= b_end, b_end <= a_end
        if ends_a:
            i += 1
            a_end += a_sizes[a[i]] if i < len(a) else 0
        if ends_b:
            j += 1
            b_end += b_sizes[b[j]] if j < len(b) else 0
    return found


class Aligner:
    """Groups of texts by number, with what is known of each group; one in each Python worker."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = _byte_of_char()
        special = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        entries = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [special[i] if i in special else bytes(byte[c] for c in entries.get(i, "")) for i in range(max(entries) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = ([len(x) for x in side] for side in (self.a_bytes, self.b_bytes))
        plain = [p for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        self.by_segment = not any("\n" in p or SPACE in p.lstrip(SPACE) for p in plain)
        self.mark = self.b.piece_to_id(SPACE)
        self.sizes = [np.array(side, np.int64) for side in (self.a_sizes, self.b_sizes)]
        self.forget()

    def forget(self) -> None:
        self.segments: dict[str, bytes] = {}  # group numbers as 32-bit integers
        self.older: dict[str, bytes] = {}
        self.numbers: dict[int | tuple, int] = {}
        self.keys: list[str] = []
        self.facts: list[tuple[int, int, int]] = []  # A tokens, B tokens, links
        self.pairs: list[np.ndarray] = []  # distinct linked pairs, A id above B id

    def tidy(self) -> None:
        """Between chunks: segments not met since the last time are forgotten, and everything if there are too many groups."""
        if len(self.keys) > _GROUPS:
            self.forget()
        elif len(self.segments) > _SEGMENTS:
            self.segments, self.older = {}, self.segments

    def _new_number(self, known: int | tuple, a: tuple[int, ...], b: tuple[int, ...]) -> int:
        number = self.numbers[known] = len(self.keys)
        linked = links(a, b, self.a_sizes, self.b_sizes)
        self.keys.append(f"{','.join(map(str, a))}|{','.join(map(str, b))}")
        self.facts.append((len(a), len(b), len(linked)))
        self.pairs.append(np.array(sorted({x << 32 | y for x, y in linked}), np.int64))
        return number

    def _encoded(self, part: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Group numbers of a part of a text that starts at a cut, and the bytes where they end; None if its bytes are not given back."""
        b = self.b.encode(part[1:] if part[0] == " " else part)
        if part[0] != " ":  # the library has put a space before it
            if not b or b[0] != self.mark:
                return None
            b = b[1:]
        data = part.encode()
        if b"".join(map(self.b_bytes.__getitem__, b)) != data:
            return None
        a = self.a.encode(part, add_special_tokens=False).ids
        if b"".join(map(self.a_bytes.__getitem__, a)) != data:
            return None
        a_ends, b_ends = (np.cumsum(size[side]) for size, side in zip(self.sizes, (a, b), strict=True))
        at = np.searchsorted(b_ends, a_ends)
        both = b_ends[at] == a_ends
        known, numbers, i, j = self.numbers, [], 0, 0
        for k, m in zip((np.flatnonzero(both) + 1).tolist(), (at[both] + 1).tolist(), strict=True):
            key = a[i] << 32 | b[j] if k - i == m - j == 1 else (*a[i:k], -1, *b[j:m])
            number = known.get(key)
            numbers.append(self._new_number(key, tuple(a[i:k]), tuple(b[j:m])) if number is None else number)
            i, j = k, m
        return np.array(numbers, np.int32), a_ends[both]

    def _learn(self, wanted: list[str]) -> dict[str, bytes] | None:
        """Group numbers of segments: those that begin and end at plain cuts are encoded as one text."""
        found: dict[str, bytes] = {}
        plain = [k for k in wanted if k[0] != " " and not k[-1].isspace()]
        plain.sort(key=lambda k: k[0] == "\n")
        parts = [_full(k) for k in plain]
        made = self._encoded("".join(parts)) if parts else None
        if made is not None:
            numbers, ends = made
            cuts = np.searchsorted(ends, np.cumsum([len(x.encode()) for x in parts])) + 1
            low = 0
            for k, high in zip(plain, cuts.tolist(), strict=True):
                found[k] = numbers[low:high].tobytes()
                low = high
        for k in wanted:
            if k not in found:
                if (made := self._encoded(_full(k))) is None:
                    return None
                found[k] = made[0].tobytes()
        for k, numbers in found.items():
            if len(k) <= _SEGMENT_CHARS:
                self.segments[k] = numbers
        return found

    def _by_segment(self, text: str) -> np.ndarray | None:
        keys = segment_keys(text)
        held = list(map(self.segments.get, keys))
        if None in held:
            new = {}
            for k in dict.fromkeys(k for k, h in zip(keys, held, strict=True) if h is None):
                if (old := self.older.get(k)) is None:
                    new[k] = None
                else:
                    self.segments[k] = old
            if new and (new := self._learn(list(new))) is None:
                return None
            held = [h if h is not None else new[k] if k in new else self.segments[k] for k, h in zip(keys, held, strict=True)]
        return np.frombuffer(b"".join(held), np.int32)

    def groups(self, text: str | None) -> tuple[np.ndarray, str]:
        """Group numbers of a text in order, and the digest of their keys."""
        if not text:
            return np.empty(0, np.int32), ""
        numbers = self._by_segment(text) if self.by_segment else None
        if numbers is None:
            made = self._encoded(" " + text)
            if made is None:
                return np.empty(0, np.int32), ""
            numbers = made[0]
        return numbers, hashlib.sha256(";".join(map(self.keys.__getitem__, numbers.tolist())).encode()).hexdigest()


def segment_keys(text: str) -> list[str]:
    """The segments of a space and the text, each without the single space that most start with."""
    words = text.split()
    if len(text) == sum(map(len, words)) + len(words) - 1 and text.count(" ") + text.count("\n") == len(words) - 1:
        if "\n" not in text:
            return words
        keys: list[str] = []
        for nth, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if nth:
                words[0] = "\n" + words[0]
            keys += words
        return keys
    return [x[1:] if x[0] == " " and len(x) > 1 and not x[1].isspace() else x for x in _SEGMENT.findall(" " + text)]


def _full(key: str) -> str:
    """The segment of a key."""
    return key if key[0] in " \n" else " " + key


@lru_cache(maxsize=1)
def load_aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


class _Chunk:
    """Documents that share a dictionary, until they are written."""

    def __init__(self, number: int):
        self.number, self.chars = number, 0
        self.ids: list = []
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.digests: list[str] = []

    def add(self, aligner: Aligner, doc_id, text: str | None) -> None:
        numbers, digest = aligner.groups(text)
        self.ids.append(doc_id)
        self.held.append(np.unique(numbers, return_counts=True))
        self.digests.append(digest)
        self.chars += len(text or "")

    def rows(self, aligner: Aligner, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        def batch(kind: str, size: int, /, **columns) -> pa.RecordBatch:
            columns |= {"kind": pa.array([kind] * size, pa.string()), "chunk": pa.array([self.number] * size, pa.int64())}
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

        dictionary = np.unique(np.concatenate([n for n, _ in self.held]))
        facts = np.array([aligner.facts[n] for n in dictionary.tolist()], np.int64).reshape(-1, 3)
        for at in range(0, len(dictionary), 1 << 14):
            part = dictionary[at : at + (1 << 14)].tolist()
            yield batch("group", len(part), nth=pa.array(range(at, at + len(part)), pa.int32()), group=pa.array([aligner.keys[n] for n in part]))
        pairs = [np.unique(np.concatenate([aligner.pairs[n] for n in numbers.tolist()])) for numbers, _ in self.held if len(numbers)]
        if pairs:
            pair, n_docs = np.unique(np.concatenate(pairs), return_counts=True)
            for at in range(0, len(pair), 1 << 14):
                part = pair[at : at + (1 << 14)]
                yield batch("pair", len(part), a=pa.array(part >> 32, pa.int32()), b=pa.array(part & 0xFFFFFFFF, pa.int32()), n=pa.array(n_docs[at : at + (1 << 14)], pa.int64()))
        for at in range(0, len(self.ids), SLICE_ROWS):
            held = [(np.searchsorted(dictionary, n), times) for n, times in self.held[at : at + SLICE_ROWS]]
            sums = np.array([[*(times @ facts[nth]), times.sum()] for nth, times in held], np.int64).reshape(-1, 4)
            columns = dict(zip(["n_a", "n_b", "n_links", "n_groups"], (pa.array(c) for c in sums.T), strict=True))
            steps = [np.diff(nth, prepend=0).astype("<i4").tobytes() for nth, _ in held]  # small numbers, which pack well
            yield batch(
                "doc", len(held), id=pa.array(self.ids[at : at + SLICE_ROWS], schema.field("id").type), groups_sha256=pa.array(self.digests[at : at + SLICE_ROWS]),
                steps=pa.array(steps, pa.binary()), times=pa.array([t.astype("<i4").tobytes() for _, t in held], pa.binary()), **columns,
            )


def _encode_function(a_path: str, b_path: str, id_type: pa.DataType, chunk_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("kind", pa.string()), ("chunk", pa.int64()), ("nth", pa.int32()), ("group", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()), ("id", id_type),
            *((c, pa.int64()) for c in _NUMBERS), ("groups_sha256", pa.string()), ("steps", pa.binary()), ("times", pa.binary()),
        ])
        aligner, number = load_aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        chunk = _Chunk(number)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                for doc_id, text in zip(part.column("id"), part.column("text"), strict=True):
                    chunk.add(aligner, doc_id.as_py(), text.as_py())
                    if chunk.chars >= chunk_chars:
                        yield from chunk.rows(aligner, schema)
                        aligner.tidy()
                        number += 1
                        chunk = _Chunk(number)
        if chunk.ids:
            yield from chunk.rows(aligner, schema)
            aligner.tidy()

    return run


def encoded(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, chunk_chars: int) -> dict[str, DataFrame]:
    """By kind: every chunk's dictionary (kind ``group``), pair counts (``pair``) and documents (``doc``), written to the shared folder."""
    from pyspark.sql.pandas.types import to_arrow_type

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = narrow.schema["id"].dataType
    numbers = ", ".join(f"{c} long" for c in _NUMBERS)
    schema = f"kind string, chunk long, nth int, group string, a int, b int, n long, id {id_type.simpleString()}, {numbers}, groups_sha256 string, steps binary, times binary"
    made = map_batches(narrow, _encode_function(a_path, b_path, to_arrow_type(id_type), chunk_chars), schema)
    path = scratch_path(docs.sparkSession, "encoded")
    made.write.partitionBy("kind").parquet(path)
    return {kind: docs.sparkSession.read.schema(made.schema).parquet(path).where(F.col("kind") == kind) for kind in ("group", "pair", "doc")}


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, n_docs, best): documents that hold a pair linked, and whether no pair of its A id is held by more."""
    summed = stash(pairs.groupBy("a", "b").agg(F.sum("n").alias("n_docs")), "pairs")
    most = summed.groupBy("a").agg(F.max("n_docs").alias("most"))
    return summed.join(most, "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def _expand_function(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = load_aligner(a_path, b_path)
        for batch in batches:
            where, found = [], []
            for nth, key in enumerate(batch.column("group").to_pylist()):
                a, b = (tuple(map(int, side.split(","))) for side in key.split("|"))
                for link in links(a, b, aligner.a_sizes, aligner.b_sizes):
                    where.append(nth)
                    found.append(link)
            table = np.array(found, np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("group").take(pa.array(where, pa.int64())), pa.array(table[:, 0]), pa.array(table[:, 1])], ["group", "a", "b"])

    return run


def group_values(groups: DataFrame, pairs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(group, n_best, count_sum): what one occurrence of each distinct group adds, by its links."""
    distinct = groups.select("group").distinct()
    expanded = map_batches(distinct, _expand_function(a_path, b_path), "group string, a int, b int")
    valued = expanded.join(pair_counts(pairs), ["a", "b"])
    return valued.groupBy("group").agg(F.count_if("best").alias("n_best"), F.sum("n_docs").alias("count_sum"))


def _multiplied(docs: pa.Table, values: pa.Table) -> pa.Table:
    """A chunk's documents with the values of their groups times the frequencies."""
    worth = np.zeros((values.num_rows, 2), np.int64)
    worth[values.column("nth").to_numpy()] = np.column_stack([values.column("n_best").to_numpy(), values.column("count_sum").to_numpy()])
    sums = np.zeros((docs.num_rows, 2), np.int64)
    for nth, (steps, times) in enumerate(zip(docs.column("steps"), docs.column("times"), strict=True)):
        held = np.cumsum(np.frombuffer(steps.as_py(), "<i4"))
        sums[nth] = np.frombuffer(times.as_py(), "<i4").astype(np.int64) @ worth[held]
    kept = docs.select(["id", *_NUMBERS])
    return kept.append_column("n_best", pa.array(sums[:, 0])).append_column("count_sum", pa.array(sums[:, 1])).append_column("groups_sha256", docs.column("groups_sha256"))


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. The tokenizer files must lie at their paths on every worker."""
    coded = encoded(docs, a_path, b_path, id_col, text_col, chunk_chars)
    values = stash(group_values(coded["group"], coded["pair"], a_path, b_path), "values")
    known = coded["group"].select("chunk", "nth", "group").join(values, "group").select("chunk", "nth", "n_best", "count_sum")
    held = coded["doc"].select("chunk", "id", *_NUMBERS, "groups_sha256", "steps", "times")
    kind = held.schema["id"].dataType.simpleString()
    numbers = ", ".join(f"{c} long" for c in (*_NUMBERS, "n_best", "count_sum"))
    made = held.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_multiplied, f"id {kind}, {numbers}, groups_sha256 string")
    return made.withColumnRenamed("id", id_col)
