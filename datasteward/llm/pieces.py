"""Sampled segmentation of texts into the pieces of a SentencePiece model, and lossless decoding.

Forward filtering sums the weights of all segmentations up to every place of a word; backward sampling then draws one
segmentation from the end. Words that occur often share one forward pass, and all draws of a step are one NumPy operation."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datasteward.llm.common import mix

MARK = 0xFF  # stands for the word mark of the model; no UTF-8 text holds this byte
CHUNK_BYTES = 300_000  # text per NumPy round
KEPT_EDGES = 2_000_000  # lattice edges that a task keeps for words it may meet again

DRAW_BITS = 30  # of a random number and of the bounds it is held against


def model_tables(path: str, alpha: float) -> dict:
    """What encoding and decoding need of a model: the trie of its pieces, their log weights, the bytes of every id.

    The weight of a piece falls with its rank as in Zipf's law, to the power ``alpha``: small values spread the draws, large
    ones prefer frequent pieces. Pieces that hold the word mark elsewhere than at their start are left out, so a word's
    pieces stay inside the word; characters without a piece fall back to byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    spelt, byte_ids = [b""] * n, np.zeros(256, np.int32)
    logp = np.zeros(n)
    edges: dict[int, int] = {}
    ends: dict[int, int] = {}
    nodes = 1
    for i in range(n):
        piece = sp.id_to_piece(i)
        logp[i] = -alpha * np.log(2.0 + i)
        if sp.is_byte(i):
            spelt[i] = bytes([int(piece[3:5], 16)])
            byte_ids[spelt[i][0]] = i
            logp[i] = -alpha * np.log(2.0 + n)
            continue
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            continue
        raw = piece[1:].encode() if piece.startswith("▁") else piece.encode()
        raw = (bytes([MARK]) if piece.startswith("▁") else b"") + raw
        if "▁" in piece[1:]:
            continue
        spelt[i] = raw.replace(bytes([MARK]), b" ")
        at = 0
        for b in raw:
            to = edges.get(at << 8 | b)
            if to is None:
                to = edges[at << 8 | b] = nodes
                nodes += 1
            at = to
        ends[at] = i
    keys = np.fromiter(edges.keys(), np.int64, len(edges))
    order = np.argsort(keys)
    piece_at = np.full(nodes, -1, np.int32)
    piece_at[np.fromiter(ends.keys(), np.int64, len(ends))] = np.fromiter(ends.values(), np.int32, len(ends))
    return {"keys": keys[order], "to": np.fromiter(edges.values(), np.int32, len(edges))[order], "piece_at": piece_at,
            "logp": logp, "byte_ids": byte_ids, "spelt": spelt}


class _Words(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class Segmenter:
    """Draws segmentations; holds the lattices of the words met so far, up to a bound."""

    def __init__(self, tables: dict) -> None:
        self.t = tables
        self.reset()

    def reset(self) -> None:
        self.words = _Words()
        self.length = np.empty(0, np.int64)  # bytes of each word, the mark included
        self.base = np.empty(0, np.int64)  # its first node
        self.first = np.empty(0, np.int64)  # first edge that ends in a node
        self.source = np.empty(0, np.int32)  # of each edge
        self.piece = np.empty(0, np.int32)
        self.upto = np.empty(0, np.int32)  # cumulative probability among the edges of a node, times 2 ** DRAW_BITS

    def _edges(self, buf: np.ndarray, room: np.ndarray):
        """(start, length, piece) of all pieces in the words; bytes where a character has no piece."""
        t, wide = self.t, np.ones(256, np.int64)
        wide[0xC0:0xE0], wide[0xE0:0xF0], wide[0xF0:0xFF] = 2, 3, 4
        heads = np.flatnonzero((buf & 0xC0) != 0x80)
        known = np.zeros(len(buf), bool)
        at, state, found, depth = heads, np.zeros(len(heads), np.int64), [], 0
        while len(at):
            key = state << 8 | buf[at + depth]
            k = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
            hit = t["keys"][k] == key
            at, state = at[hit], t["to"][k[hit]].astype(np.int64)
            depth += 1
            piece = t["piece_at"][state]
            own = piece >= 0
            found.append((at[own], np.full(int(own.sum()), depth), piece[own]))
            known[at[own][wide[buf[at[own]]] == depth]] = True
            on = room[at] > depth
            at, state = at[on], state[on]
        lost = heads[~known[heads]]
        for k in range(4):
            b = lost[wide[buf[lost]] > k] + k
            found.append((b, np.ones(len(b), np.int64), t["byte_ids"][buf[b]]))
        return [np.concatenate(x) for x in zip(*found, strict=True)]

    def _learn(self, new: list[bytes]) -> None:
        """Forward filtering of words not met before."""
        length = np.fromiter(map(len, new), np.int64, len(new)) + 1
        buf = np.frombuffer(b"".join([b"\xff" + w for w in new]), np.uint8)
        begin = np.cumsum(length) - length
        inside = np.arange(len(buf)) - np.repeat(begin, length)
        start, size, piece = self._edges(buf, np.repeat(length, length) - inside)
        word = np.repeat(np.arange(len(new)), length)
        src = start + word[start]  # a word of n bytes has n + 1 nodes
        dst = src + size
        offset = inside[start] + size
        order = np.argsort(offset * (len(buf) + len(new)) + dst, kind="stable")
        src, dst, piece, offset = src[order], dst[order], piece[order], offset[order]
        logp = self.t["logp"][piece]
        n = len(buf) + len(new)
        alpha = np.full(n, -np.inf)
        alpha[begin + np.arange(len(new))] = 0.0
        heads = np.flatnonzero(np.diff(dst, prepend=-1))  # the first edge into each node
        levels = np.append(np.flatnonzero(np.diff(offset[heads], prepend=-1)), len(heads))
        bounds = np.append(heads, len(dst))
        for a, b in zip(levels[:-1], levels[1:], strict=True):
            lo, hi = bounds[a], bounds[b]
            own = heads[a:b] - lo
            x = alpha[src[lo:hi]] + logp[lo:hi]
            top = np.maximum.reduceat(x, own)
            total = np.add.reduceat(np.exp(x - np.repeat(top, np.diff(np.append(own, hi - lo)))), own)
            alpha[dst[heads[a:b]]] = top + np.log(total)
        share = np.exp(alpha[src] + logp - alpha[dst])
        into = np.diff(bounds)  # edges of a node stand together
        first = np.zeros(n, np.int64)
        first[dst[heads]] = heads
        part = np.rint(share * (1 << DRAW_BITS)).astype(np.int64)  # whole, so a bound does not hang on what stands before it
        total = np.cumsum(part)
        upto = total - np.repeat(total[heads] - part[heads], into)
        upto[bounds[1:] - 1] = 1 << DRAW_BITS  # the last edge of a node takes what is left
        nodes, edges = len(self.first), len(self.source)
        self.base = np.concatenate([self.base, begin + np.arange(len(new)) + nodes])
        self.length = np.concatenate([self.length, length])
        self.first = np.concatenate([self.first, first + edges])
        self.source = np.concatenate([self.source, (src + nodes).astype(np.int32)])
        self.piece = np.concatenate([self.piece, piece])
        self.upto = np.concatenate([self.upto, upto.astype(np.int32)])

    def encode(self, texts: list[bytes], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids per text); the key of a text and the place in it give every random number."""
        parts = [t.split(b" ") if t else [] for t in texts]
        n_words = np.fromiter(map(len, parts), np.int64, len(parts))
        if len(self.source) > KEPT_EDGES:
            self.reset()
        seen = len(self.words)
        word = np.fromiter(map(self.words.__getitem__, chain.from_iterable(parts)), np.int64, int(n_words.sum()))
        if len(self.words) > seen:
            new = list(self.words)[seen:]
            self._learn(new)
        length = self.length[word]
        begin = np.cumsum(length) - length
        firsts = np.cumsum(n_words) - n_words
        text = np.repeat(np.arange(len(texts)), n_words)
        has = n_words > 0
        origin = np.zeros(len(texts), np.int64)
        origin[has] = begin[firsts[has]]
        place = begin - origin[text]
        key, base = keys[text], self.base[word]
        node = base + length
        live, steps = np.arange(len(word)), []
        while len(live):
            at = node[live]
            u = mix(key[live] + (place[live] + at - base[live]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            u = (u >> np.uint64(64 - DRAW_BITS)).astype(np.int32)
            edge = self.first[at]
            more = np.flatnonzero(u >= self.upto[edge])
            while len(more):
                edge[more] += 1
                more = more[u[more] >= self.upto[edge[more]]]
            steps.append((live, self.piece[edge]))
            node[live] = to = self.source[edge]
            live = live[to > base[live]]
        count = np.zeros(len(word), np.int64)
        for own, _ in steps:
            count[own] += 1
        last = np.cumsum(count) - 1
        out = np.empty(int(count.sum()), np.int32)
        for k, (own, piece) in enumerate(steps):
            out[last[own] - k] = piece
        return out, np.bincount(text, count, len(texts)).astype(np.int64)


def _chunks(texts: pa.Array):
    """(first, bytes of the texts from there on), so many at a time that a round stays small."""
    first, chunk, size = 0, [], 0
    for k, t in enumerate(texts):
        chunk.append((t.as_py() or "").encode())
        size += len(chunk[-1])
        if size >= CHUNK_BYTES or k == len(texts) - 1:
            yield first, chunk
            first, chunk, size = k + 1, [], 0


def _id_lists(ids: np.ndarray, counts: np.ndarray, valid: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], counts]).cumsum()
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(~valid))


def decoded(ids: np.ndarray, spelt: list[bytes]) -> bytes:
    """The bytes of the pieces, without the word mark in front of the first word."""
    return b"".join(map(spelt.__getitem__, ids.tolist()))[1:]


def _encoder(shared):
    def run(texts: pa.Array, keys: pa.Array) -> pa.Array:
        segmenter = Segmenter(shared.value)
        seeds = keys.to_numpy(zero_copy_only=False).view(np.uint64)
        parts = [segmenter.encode(chunk, seeds[first:first + len(chunk)]) for first, chunk in _chunks(texts)]
        if not parts:
            return pa.array([], pa.list_(pa.int32()))
        ids, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        return _id_lists(ids, counts, texts.is_valid().to_numpy(zero_copy_only=False))
    return run


def encode_pieces(docs: DataFrame, model_path: str, text_col: str = "text", key_col: str = "doc_id", out: str = "ids",
                  alpha: float = 1.0, seed: int = 7) -> DataFrame:
    """``docs`` with the ids of one sampled segmentation per row in column ``out``.

    The same key, seed and text give the same ids wherever the row is computed; repeated rows get equal ids. Null text gives
    null, empty text no ids. A null key is a key like any other."""
    shared = docs.sparkSession.sparkContext.broadcast(model_tables(model_path, alpha))  # as large as the vocabulary
    key = F.xxhash64(F.lit(seed), F.col(key_col))
    return docs.withColumn(out, F.arrow_udf(_encoder(shared), "array<int>")(F.col(text_col), key))


def decode_pieces(docs: DataFrame, model_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of the ids in column ``out``: exactly the text that was encoded; null for null."""
    spelt = model_tables(model_path, 1.0)["spelt"]
    shared = docs.sparkSession.sparkContext.broadcast(spelt)

    def run(ids: pa.Array) -> pa.Array:
        values, bounds = ids.values.to_numpy(), ids.offsets.to_pylist()
        return pa.array((decoded(values[a:b], shared.value).decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)),
                        pa.string())
    text = F.arrow_udf(run, "string")(F.col(ids_col))
    return docs.withColumn(out, F.when(F.col(ids_col).isNotNull(), text))


def sampled_pieces(docs: DataFrame, model_path: str, keep: tuple[str, ...] = (), alpha: float = 1.0, seed: int = 7) -> DataFrame:
    """(doc_id, the columns of ``keep``, n_pieces, ids, lossless) for every row: ``encode_pieces``, and whether decoding the
    ids gives the text again, in one pass over small chunks. Null text has null ids and counts as lossless."""
    shared = docs.sparkSession.sparkContext.broadcast(model_tables(model_path, alpha))  # as large as the vocabulary
    rows = docs.select("doc_id", *keep, F.col("text").alias("text_"), F.xxhash64(F.lit(seed), "doc_id").alias("key_"))
    names = ["doc_id", *keep, "n_pieces", "ids", "lossless"]

    def run(batches):
        segmenter = Segmenter(shared.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 2)
            seeds = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).view(np.uint64)
            for first, chunk in _chunks(texts):
                n = len(chunk)
                ids, counts = segmenter.encode(chunk, seeds[first:first + n])
                ends = np.concatenate([[0], counts]).cumsum()
                same = [decoded(ids[ends[k]:ends[k + 1]], shared.value["spelt"]) == chunk[k] for k in range(n)]
                valid = texts.slice(first, n).is_valid().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(first, n) for c in batch.columns[:-2]], pa.array(counts, pa.int64()),
                     _id_lists(ids, counts, valid), pa.array(same, pa.bool_())], names=names)
            del batch, texts
            pa.default_memory_pool().release_unused()  # a worker lives on; it need not keep the largest batch's memory
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *keep)) + ", n_pieces long, ids array<int>, lossless boolean"
    return rows.mapInArrow(run, schema)
