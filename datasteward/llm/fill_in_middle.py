"""Fill-in-the-middle by piece tables.

A document is a list of descriptors (buffer, start, length) over two immutable buffers: its own text, and the sentinels.
Cutting splits a descriptor, an arrangement permutes the list, the inverse permutation restores it, and a digest streams the
described pieces one after the other; no intermediate text is built for it. Units are code points."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = PREFIX + SUFFIX + MIDDLE  # the buffer of sentinels
TEXT_BUFFER, MARK_BUFFER = 0, 1
PIECES = "array<struct<buffer:int,start:int,length:int>>"
# Places in the list (prefix, middle, suffix, <P>, <S>, <M>) in the order of the output.
ORDERS = {"plain": [0], "psm": [3, 0, 4, 2, 5, 1], "spm": [4, 2, 3, 0, 5, 1]}


def piece(buffer, start, length) -> F.Column:
    return F.struct(F.lit(buffer).cast("int").alias("buffer"), F.lit(start).cast("int").alias("start"),
                    F.lit(length).cast("int").alias("length"))


def cut(pieces: list, place: int, at) -> list:
    """The list with descriptor number ``place`` split after ``at`` units; either part may be empty. A descriptor is the
    triple (buffer, start, length) of numbers or columns."""
    buffer, start, length = pieces[place]
    return [*pieces[:place], (buffer, start, at), (buffer, start + at, length - at), *pieces[place + 1:]]


def arranged(pieces: list, order: list[int]) -> list:
    """Descriptor number order[k] of the list at place k."""
    return [pieces[k] for k in order]


def inverse(order: list[int]) -> list[int]:
    """The permutation that undoes ``arranged(..., order)``."""
    return [order.index(k) for k in range(len(order))]


def by_form(form, lists: dict[str, list]) -> F.Column:
    """The array of descriptors of the row's form; that of plain for any other value."""
    out = F.array(*[piece(*p) for p in lists["plain"]])
    for name, pieces in lists.items():
        if name != "plain":
            out = F.when(form == name, F.array(*[piece(*p) for p in pieces])).otherwise(out)
    return out.cast(PIECES)


def read_pieces(pieces, text) -> F.Column:
    """The text that a list of descriptors describes."""
    return F.array_join(F.transform(pieces, lambda p: F.substring(
        F.when(p["buffer"] == TEXT_BUFFER, text).otherwise(F.lit(MARKS)), p["start"] + 1, p["length"])), "")


def _hash_texts(texts: pa.Array, pieces: pa.Array) -> pa.Array:
    offsets, data = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:], texts.buffers()[2]
    data = memoryview(data) if data is not None else memoryview(b"")
    ends, parts = pieces.offsets.to_numpy(), pieces.values.flatten()
    buffer, start, length = (c.to_numpy(zero_copy_only=False) for c in parts)
    out = []
    for row in range(len(texts)):
        if not texts[row].is_valid or not pieces[row].is_valid:
            out.append(None)
            continue
        raw = data[offsets[row]:offsets[row + 1]]
        first = None
        if pc.utf8_length(texts[row]).as_py() != len(raw):  # bytes at which code points begin
            first = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))
        digest = hashlib.sha256()
        for k in range(ends[row], ends[row + 1]):
            a, b = int(start[k]), int(start[k] + length[k])
            if buffer[k] == MARK_BUFFER:
                digest.update(MARKS[a:b].encode())
            else:
                digest.update(raw[a:b] if first is None else raw[first[a]:first[b]])
        out.append(digest.hexdigest())
    return pa.array(out, pa.string())


def pieces_sha256(text, pieces) -> F.Column:
    """SHA-256 of the described text in UTF-8, as lowercase hex: the pieces are fed to the digest in turn."""
    def run(texts: pa.Array, pieces: pa.Array) -> pa.Array:
        return _hash_texts(texts.cast(pa.string()), pieces)
    # not deterministic to the optimizer, which else copies the texts' expressions into every filter on the digest
    return F.arrow_udf(run, "string").asNondeterministic()(text, pieces)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1",
                   percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """(doc_id, text, n, form, prefix_chars, middle_chars, pieces, output) for every row of ``docs``.

    h1 to h4 are the first 32-bit groups of sha256(seed:id). A text of n code points is cut after h1 and h2 modulo n + 1,
    in ascending order, into prefix, middle and suffix. ``percent`` of the ids are arranged, ``spm_percent`` of those with
    the suffix first; the others are plain, and so is a text that is empty or holds a sentinel, as its output could not be
    read back. Null texts count as empty. A null id hashes as an empty one, so all such rows share their draws; repeated
    rows get equal results. An empty table gives no rows; extra columns of ``docs`` are ignored, whatever their names."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    hexes = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(F.col("hex"), 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    n, text = F.col("n"), F.col("text")
    holds = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = (F.when((n == 0) | (F.col("h")[2] % 100 >= percent) | holds, "plain")
            .when(F.col("h")[3] % 100 < spm_percent, "spm").otherwise("psm"))
    rows = rows.select("doc_id", "text", F.char_length(text).cast("long").alias("n"), hexes.alias("hex"))
    rows = rows.select("doc_id", "text", "n", F.array(*h).alias("h"))
    ends = F.array_sort(F.array(F.col("h")[0] % (n + 1), F.col("h")[1] % (n + 1)))
    rows = rows.select("doc_id", "text", "n", form.alias("form"), ends.alias("ends"))
    a, b = F.col("ends")[0], F.col("ends")[1]
    whole = [(TEXT_BUFFER, F.lit(0), n)]
    marks = [(MARK_BUFFER, MARKS.index(m), len(m)) for m in (PREFIX, SUFFIX, MIDDLE)]
    parts = cut(cut(whole, 0, a), 1, b - a) + marks
    lists = {name: arranged(whole if name == "plain" else parts, order) for name, order in ORDERS.items()}
    rows = rows.select("doc_id", "text", "n", "form", F.when(F.col("form") != "plain", a).alias("prefix_chars"),
                       F.when(F.col("form") != "plain", b - a).alias("middle_chars"), by_form(F.col("form"), lists).alias("pieces"))
    return rows.withColumn("output", read_pieces(F.col("pieces"), text))


def with_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with back: descriptors over its column output alone that describe the text it was made from. The
    sentinels are found again, the output is cut at them, and the inverse permutation of the form puts prefix, middle and
    suffix back. An output of form plain, or of no known form, describes itself; a null output gives null."""
    output, form, size = F.col("output"), F.col("form"), len(PREFIX)
    second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    found = F.array(F.position(second, output) - 1, F.position(F.lit(MIDDLE), output) - 1, F.char_length(output))
    at, last, n = (F.col("found_")[k] for k in range(3))
    whole = [(TEXT_BUFFER, F.lit(0), n)]
    parts = whole
    for place, length in enumerate((size, at - size, F.lit(size), last - at - size, F.lit(size))):
        parts = cut(parts, place, length)
    lists = {name: whole if name == "plain" else arranged(parts, inverse(order))[:3] for name, order in ORDERS.items()}
    return formatted.withColumn("found_", found).withColumn("back", F.when(output.isNotNull(), by_form(form, lists))).drop("found_")


def restore(formatted: DataFrame) -> DataFrame:
    """``formatted`` with restored: the exact text again, from the columns output and form alone. A null output gives null."""
    return with_back(formatted).withColumn("restored", read_pieces(F.col("back"), F.col("output"))).drop("back")


def digests(formatted: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of ``fill_in_middle``'s rows, any of
    which may repeat; no rows give none. The output's digest streams the descriptors over the text, the restored one those
    over the output."""
    return with_back(formatted).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", pieces_sha256(F.col("text"), F.col("pieces")).alias("output_sha256"),
        pieces_sha256(F.col("output"), F.col("back")).alias("restored_sha256"))
