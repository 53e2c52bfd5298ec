"""Language identification by compression.

For each language a zstandard raw-content dictionary is made of sample texts. A
text is encoded whole, in pieces, with each dictionary; the language whose dictionary leaves
the fewest bytes is chosen, and the choice is rejected when the second best comes
too close. Lower case is compressed, since capitals only hide repeats.

The sample is bounded: for each language at most ``SAMPLE_TEXTS`` texts and
``DICTIONARY_BYTES`` in all, in the order of a digest of the id. Of a text longer
than ``SAMPLE_TEXT_BYTES`` a piece of a quarter of that length (in code points)
from its middle is taken, so that a language of long texts is learned too.
Equal sizes go to the language first in the alphabet.

Nulls and odd input: a null text or one without a letter is ``und`` with score 0;
rows with a null language teach nothing; without any labelled text every
prediction is ``und``; repeated rows are predicted alike; columns other than id,
text and language are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import SLICE_ROWS, map_batches

SAMPLE_TEXTS = 200
SAMPLE_TEXT_BYTES = 16_384
DICTIONARY_BYTES = 112_640
LEVEL = 6
#: A text is compressed in pieces, since one that runs on is soon its own best dictionary.
PIECE_BYTES = 8192
#: A choice whose bytes are not below the second best's by this share is rejected.
LEAST_MARGIN = 0.01
UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")


def sample(labelled: DataFrame) -> list[tuple[str, str]]:
    """A bounded sample of (lang, text): documents under a hash threshold set from each language's count, then ranked."""
    piece = F.substr("text", (F.length("text") / 2).cast("int"), F.lit(SAMPLE_TEXT_BYTES // 4))
    usable = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    usable = usable.withColumn("text", F.when(F.octet_length("text") > SAMPLE_TEXT_BYTES, piece).otherwise(F.col("text"))).withColumn("order", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    totals = usable.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a number per language, of which every worker holds a dictionary anyway
    if not totals:
        return []
    share = F.element_at(F.create_map(*[F.lit(x) for r in totals for x in (r["lang"], 4.0 * SAMPLE_TEXTS / r["n"])]), F.col("lang"))
    likely = usable.where(F.col("order") < share)
    first = likely.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id", "text"))).where(F.col("nth") <= SAMPLE_TEXTS)
    return [(r["lang"], r["text"]) for r in first.orderBy("lang", "nth").select("lang", "text").collect()]


def dictionaries(texts: list[tuple[str, str]]) -> dict[str, bytes]:
    """Raw dictionary content per language; the first texts stand last, nearest to what is compressed."""
    parts: dict[str, list[bytes]] = {}
    for lang, text in texts:
        own, data = parts.setdefault(lang, []), text.lower().encode()
        if sum(map(len, own)) + len(data) <= DICTIONARY_BYTES:
            own.append(data)
    return {lang: b"\n".join(reversed(own)).rjust(8) for lang, own in sorted(parts.items()) if own}


def _compressors(content: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    made = []
    for lang, data in content.items():
        own = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=LEVEL)
        made.append((lang, zstandard.ZstdCompressor(dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False)))
    return made


def classify(text: str | None, compressors: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float, bool]:
    """(language, score, accepted): score is the share of bytes saved against the second best, scaled to 0 to 1."""
    if text is None or not compressors or not _LETTER.search(text):
        return UNDETERMINED, 0.0, False
    data = text.lower().encode()
    pieces = [data[at : at + PIECE_BYTES] for at in range(0, len(data), PIECE_BYTES)]
    sizes = sorted((sum(len(c.compress(piece)) for piece in pieces), lang) for lang, c in compressors)
    if len(sizes) == 1:
        return sizes[0][1], 1.0, True
    margin = 1 - sizes[0][0] / sizes[1][0]
    return sizes[0][1], min(1.0, max(0.0, margin)), margin >= LEAST_MARGIN


def predict(docs: DataFrame, content: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """``docs`` (id, ..., text) without its text, with lang_pred, score and accepted."""
    kept = [f for f in docs.schema.fields if f.name != text_col]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string", "score double", "accepted boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(content)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                found = [classify(t, compressors) for t in part.column(text_col).to_pylist()]
                lang, score, accepted = zip(*found, strict=True)
                columns = [part.column(f.name) for f in kept] + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), "lang_pred", "score", "accepted"])

    return map_batches(docs, run, schema)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, predict every row: doc_id, held_out, lang_pred, score, accepted."""
    content = dictionaries(sample(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), content)
