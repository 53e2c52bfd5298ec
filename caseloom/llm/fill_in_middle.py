"""Fill-in-the-middle transformation in Spark expressions alone.

A text is cut into units (runs of ASCII letters, and every other character by
itself) by one ``regexp_extract_all``. The digest of seed and id gives four
32-bit numbers: two cuts among the units, and the choices of form. The pieces are
slices of the unit array, joined and arranged between sentinels:

* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
* ``plain``: the text as it is

A text that holds a sentinel stays plain, so the sentinels of an arranged output
are its only ones and the text is rebuilt by splitting at them.

Every row is made by itself: nothing is shuffled, and a lost task costs its rows.

Nulls and odd input: a null text is an empty one, and an empty text is plain with
no units; a null id is hashed as ``null``; equal ids are cut by equal numbers, so
repeated rows give repeated rows; very long texts are cut whole; an empty table
gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SENTINEL = "<[PSM]>"
#: Of a hundred rows, those that are transformed, and of those the ones with the suffix first.
FIM_PERCENT, SPM_PERCENT = 90, 20


def row_number_of(key: Column, nth: int, seed: int = 1) -> Column:
    """The nth (from 0) 32-bit number of the digest of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    return F.conv(F.substring(digest, 8 * nth + 1, 8), 16, 10).cast("long")


def transformed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """(id, text, n, form, prefix, middle, suffix, output): n units; the pieces are null in plain rows."""
    numbered = [row_number_of(F.col(id_col), k, seed).alias(f"h{k + 1}") for k in range(4)]
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)).alias("units"), *numbered)
    n = F.size("units")
    plain = (F.col("text") == "") | F.col("text").rlike(_SENTINEL) | (F.col("h3") % 100 >= fim_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    one, other = F.col("h1") % (n + 1), F.col("h2") % (n + 1)
    placed = cut.select("id", "text", "units", n.cast("long").alias("n"), form.alias("form"), F.least(one, other).cast("int").alias("low"), F.greatest(one, other).cast("int").alias("high"))
    piece = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", start, length), ""))
    pieces = placed.select(
        "id", "text", "n", "form",
        piece(F.lit(1), F.col("low")).alias("prefix"),
        piece(F.col("low") + 1, F.col("high") - F.col("low")).alias("middle"),
        piece(F.col("high") + 1, F.col("n").cast("int") - F.col("high")).alias("suffix"),
    )
    return pieces.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n", "form", "prefix", "middle", "suffix", arranged("form", "text", "prefix", "middle", "suffix").alias("output"))


def arranged(form: str, text: str, prefix: str, middle: str, suffix: str) -> Column:
    """The output of a row's pieces (column names)."""
    psm = F.concat(F.lit(PREFIX), F.col(prefix), F.lit(SUFFIX), F.col(suffix), F.lit(MIDDLE), F.col(middle))
    spm = F.concat(F.lit(SUFFIX), F.col(suffix), F.lit(PREFIX), F.col(prefix), F.lit(MIDDLE), F.col(middle))
    return F.when(F.col(form) == "plain", F.col(text)).when(F.col(form) == "psm", psm).otherwise(spm)


def restored(output: Column, form: Column) -> Column:
    """The exact text, from output and form alone.

    The parts between the sentinels are put back in the order of the form; what
    stands before the first sentinel is empty.
    """
    parts = F.split(output, _SENTINEL, -1)
    second, third, fourth = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(second, fourth, third)).otherwise(F.concat(third, fourth, second))


def digests(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of transformed rows; the text is rebuilt from output and form."""
    chars = lambda c: F.char_length(c).cast("long")
    back = restored(F.col("output"), F.col("form"))
    return made.select(F.col(id_col), "n", "form", chars("prefix").alias("prefix_chars"), chars("middle").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
