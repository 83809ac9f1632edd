"""Fill-in-middle: texts cut at token boundaries and put together again in another order.

A document is cut at two boundaries that digests of its id choose, and written as prefix, suffix, middle (psm) or suffix, prefix,
middle (spm), each part behind its mark; the rest stays plain. The cuts are ranks of tokens; the learned index of ``rankindex``
predicts each rank's offset and corrects it by the stored rest, so no token list is ever built. Only the cuts (three numbers a
document) come back from the Arrow tasks; texts are put together by built-in functions, row by row, without a shuffle.

Defined results: null text counts as empty and is plain, with 0 tokens. Texts that hold a mark stay plain, so that every output can
be read back (:func:`restored`). A null doc_id has the digest of an empty id. Repeated rows are formatted each. Columns named n, form,
prefix_chars, middle_chars or output are replaced, others stay. Memory is a chunk of texts (about 4 MB, or one longer text) a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hunkwise.functions.steps import computed_once
from hunkwise.llm.rankindex import boundaries, fit
from hunkwise.llm.shingles import chunks

SEED = 42
#: In hundredths: documents that are cut, and of those the ones in the order suffix, prefix, middle.
RATE, SPM = 50, 80
#: The marks.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def _cut_chunk(texts: list[bytes | None], one: np.ndarray, two: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """(tokens, first cut, second cut) a text, cuts in code points; 0 for plain texts."""
    found = boundaries(texts)
    out = np.zeros((len(texts), 3), np.int64)
    out[:, 0] = n = found.tokens
    cut = np.flatnonzero(~plain)
    if len(cut):
        own = [texts[i] or b"" for i in cut]
        mine = found if len(cut) == len(texts) else boundaries(own)
        index = fit(mine)
        ranks = np.sort(np.column_stack((one[cut] % (n[cut] + 1), two[cut] % (n[cut] + 1))), axis=1)
        begins = np.cumsum([0] + [len(t) for t in own])
        chars = np.concatenate(([0], np.cumsum((np.frombuffer(b"".join(own), np.uint8) & 0xC0) != 0x80)))
        for k in (0, 1):
            offset = index.offset(mine.first[:-1] + ranks[:, k])
            out[cut, 1 + k] = chars[begins[:-1] + offset] - chars[begins[:-1]]
    return out


@F.arrow_udf(T.StructType([T.StructField(name, T.LongType()) for name in ("n", "lo", "hi")]))
def _cuts(text: pa.Array, one: pa.Array, two: pa.Array, plain: pa.Array) -> pa.Array:
    texts = text.cast(pa.large_binary()).to_pylist()
    one, two, plain = (a.to_numpy(zero_copy_only=False) for a in (one, two, plain))
    parts = [_cut_chunk(part, one[at : at + len(part)], two[at : at + len(part)], plain[at : at + len(part)]) for at, part in chunks(texts)]
    found = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
    return pa.StructArray.from_arrays([pa.array(found[:, k], pa.int64()) for k in range(3)], names=["n", "lo", "hi"])


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``docs`` with n (tokens), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output."""
    base = docs.drop(*_ADDED)
    names = [f"c{i}" for i in range(len(base.columns))]
    doc_id, body = (F.col(names[base.columns.index(c)]) for c in ("doc_id", "text"))
    rows = computed_once(base.toDF(*names), "h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256))
    numbers = [F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    text = F.coalesce(body, F.lit(""))
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    rows = rows.withColumns({"plain": (text == "") | marked | (numbers[2] % 100 >= rate), "one": numbers[0], "two": numbers[1], "late": numbers[3] % 100 < spm})
    rows = rows.withColumn("cut", _cuts(text, F.col("one"), F.col("two"), F.col("plain")))
    lo, hi = F.col("cut.lo").cast("int"), F.col("cut.hi").cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), lo), F.substring(text, lo + 1, hi - lo), F.substring(text, hi + 1, F.length(text))
    output = (F.when(F.col("plain"), text).when(F.col("late"), F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
              .otherwise(F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)))
    return rows.select(
        *(F.col(n).alias(c) for n, c in zip(names, base.columns)), F.col("cut.n").alias("n"),
        F.when(F.col("plain"), "plain").when(F.col("late"), "spm").otherwise("psm").alias("form"),
        F.when(~F.col("plain"), F.col("cut.lo")).alias("prefix_chars"), F.when(~F.col("plain"), F.col("cut.hi") - F.col("cut.lo")).alias("middle_chars"),
        output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A mark cannot arise where parts meet: its first character stands nowhere else in it."""
    parts = F.split(output, "<[PSM]>", -1)
    return (F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1])))
