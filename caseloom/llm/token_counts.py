"""Token counts by a compiled finite-state tokenizer.

A subword vocabulary with ranked merges is compiled into a deterministic
transducer. Its state after a prefix of a word says, for every suffix that a
piece may still cover, which piece ends where that suffix begins and how the
count there compares with the count now; reading a character leads to one next
state and emits the change of the token count. That is finite because pieces are
short. It rests on this property of ranked merging: a sequence of pieces is the
tokenization of its text exactly if every two neighbours are the tokenization of
theirs, so the piece that ends a prefix is the longest one that fits its left
neighbour. States and transitions are built when first met.

Texts are cut into chunks. A chunk becomes a state map: what it does to the open
word it is entered with, the tokens of its closed words, and the open word it
leaves behind. Maps compose associatively and are combined as a balanced prefix
scan, so the cuts do not matter and a very long text needs no long pass.

Nulls and odd input: null and empty texts have no bytes and no tokens; repeated
rows count alike; an empty table gives an empty result; columns other than id and
text are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, map_batches

SPACE = "▁"
CHUNK_CHARS = 65_536
_CACHED_WORDS = 400_000
_CACHED_WORD_CHARS = 64
_STATES = 400_000
#: A word starts at a run of spaces that follows something else.
_WORD_START = regex.compile(f"(?<=[^{SPACE}]){SPACE}")


class Vocabulary:
    """Pieces with their scores, and where each may begin."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.prefixes = {p[:i] for p in scores for i in range(len(p))}
        self.alphabet = {p for p in scores if len(p) == 1}
        self._fits: dict[tuple[str, str], bool] = {}

    def merge(self, text: str) -> list[str]:
        """Ranked merging itself: the best-scored, then leftmost, pair first."""
        symbols = list(text)
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(symbols) and (score := self.scores.get(both := symbols[i] + symbols[after[i]])) is not None:
                heapq.heappush(heap, (-score, i, both))

        for i in range(len(symbols)):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            if symbols[i] and after[i] < len(symbols) and symbols[i] + symbols[after[i]] == both:
                j = after[i]
                symbols[i], symbols[j], after[i] = both, "", after[j]
                if after[j] < len(symbols):
                    before[after[j]] = i
                offer(before[i])
                offer(i)
        return [s for s in symbols if s]

    def fits(self, left: str, right: str) -> bool:
        """Whether ``right`` can follow ``left`` (nothing, if empty) in a tokenization."""
        key = (left, right)
        if (known := self._fits.get(key)) is None:
            if len(self._fits) >= _STATES:
                self._fits.clear()
            known = self._fits[key] = self.merge(left + right) == [x for x in key if x]
        return known


class Transducer:
    """The lazily built deterministic automaton over the characters of one word.

    A state is a tuple of (open suffix, piece before it, count there - count now).
    ``step`` returns the next state and the change of the token count.
    """

    START = (("", "", 0),)

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.transitions: dict[tuple, dict[str, tuple[tuple, int]]] = {}

    def step(self, state: tuple, char: str) -> tuple[tuple, int]:
        row = self.transitions.get(state)
        if row is None:
            if len(self.transitions) >= _STATES:
                self.transitions.clear()
            row = self.transitions[state] = {}
        if char not in row:
            row[char] = self._build(state, char)
        return row[char]

    def _build(self, state: tuple, char: str) -> tuple[tuple, int]:
        v = self.vocabulary
        if char not in v.alphabet:  # spelled in bytes, which never merge
            return self.START, len(char.encode("utf-8", "surrogatepass"))
        for suffix, left, count in state:  # longest suffix first
            piece = suffix + char
            if piece in v.scores and v.fits(left, piece):
                break
        change = count + 1
        open_ends = [(s + char, p, c - change) for s, p, c in state if s + char in v.prefixes]
        return (*open_ends, ("", piece, 0)), change

    def count(self, word: str) -> int:
        state, total = self.START, 0
        for char in word:
            state, change = self.step(state, char)
            total += change
        return total


class Counter(dict):
    """Tokens per word (without its leading space mark), remembered up to a fixed number of words.

    A word's entry is what the transducer emits from the start state over the
    space mark and the word: its composed transition.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        runs = {p for p in vocabulary.scores if len(p) > 1 and not p.strip(SPACE)}
        self.words = Transducer(Vocabulary({p: s for p, s in vocabulary.scores.items() if p not in runs}))
        self.spaces = Vocabulary({p: s for p, s in vocabulary.scores.items() if p in runs or p == SPACE})

    def __missing__(self, word: str) -> int:
        total = self.words.count(SPACE + word)
        if len(word) <= _CACHED_WORD_CHARS:
            if len(self) >= _CACHED_WORDS:
                self.clear()
            self[word] = total
        return total

    def count_unit(self, unit: str) -> int:
        """Tokens of a run of spaces and the word behind it. Runs of spaces merge after everything else."""
        word = unit.lstrip(SPACE)
        spaces = len(unit) - len(word)
        if not word:
            return len(run_of_spaces(self, spaces))
        if spaces == 0:
            return self.words.count(word)
        if spaces == 1:
            return self[word]
        alone = self.words.vocabulary.merge(SPACE + word)[0] == SPACE  # then the last space joins the run
        return len(run_of_spaces(self, spaces if alone else spaces - 1)) + self[word] - alone


def run_of_spaces(counter: Counter, n: int) -> list[str]:
    return counter.spaces.merge(SPACE * n)


StateMap = tuple[str, int | None, str]


def chunk_map(chunk: str, counter: Counter) -> StateMap:
    """(characters that belong to the open word on entry, tokens of the words closed inside, open word on exit).

    A chunk in which no word starts only lengthens the open word: its count is None.
    """
    starts = _WORD_START.search(chunk)
    if starts is None:
        return chunk, None, ""
    first, last = starts.start(), max(m.start() for m in _WORD_START.finditer(chunk))
    return chunk[:first], count_words(chunk[first:last], counter), chunk[last:]


def compose(a: StateMap, b: StateMap, counter: Counter) -> StateMap:
    """The map of two chunks in a row; associative."""
    if a[1] is None and b[1] is None:
        return a[0] + b[0], None, ""
    if a[1] is None:
        return a[0] + b[0], b[1], b[2]
    if b[1] is None:
        return a[0], a[1], a[2] + b[0]
    return a[0], a[1] + count_words(a[2] + b[0], counter) + b[1], b[2]


def scan(maps: list[StateMap], counter: Counter) -> StateMap:
    while len(maps) > 1:
        maps = [compose(maps[i], maps[i + 1], counter) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def count_words(text: str, counter: Counter) -> int:
    """Tokens of a text of whole words that starts with a space mark."""
    words = text[1:].split(SPACE)
    if "" not in words:
        return sum(map(counter.__getitem__, words))
    return sum(map(counter.count_unit, _units(text)))


def _units(text: str) -> list[str]:
    cuts = [0, *(m.start() for m in _WORD_START.finditer(text)), len(text)]
    return [text[i:j] for i, j in zip(cuts, cuts[1:], strict=False) if i < j]


def count_tokens(text: str | None, counter: Counter, chunk_chars: int = CHUNK_CHARS) -> int:
    if not text:
        return 0
    text = SPACE + text.replace(" ", SPACE)
    if len(text) <= chunk_chars:
        return count_words(text, counter)
    cuts = range(0, len(text), chunk_chars)
    # look-behind must see the character before a cut, so cuts never fall just before a space mark
    bounds = [0]
    for cut in cuts[1:]:
        while cut < len(text) and text[cut] == SPACE:
            cut += 1
        if cut > bounds[-1]:
            bounds.append(cut)
    bounds.append(len(text))
    head, inside, tail = scan([chunk_map(text[i:j], counter) for i, j in zip(bounds, bounds[1:], strict=False) if i < j], counter)
    if inside is None:
        return count_words(head, counter)
    return count_words(head, counter) + inside + count_words(tail, counter)


@lru_cache(maxsize=2)
def load_counter(model_path: str) -> Counter:
    """Read a piece model's vocabulary, once in each Python worker."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    normal = (i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)))
    return Counter(Vocabulary({model.id_to_piece(i): model.get_score(i) for i in normal}))


def tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_bytes, n_tokens, over_limit. The model file must lie at ``model_path`` on every worker."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load_counter(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                found = [count_tokens(t, counter) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("n_bytes"), pa.array(found, pa.int64())], ["id", "n_bytes", "n_tokens"])

    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    counted = map_batches(narrow, run, f"id {id_type}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
