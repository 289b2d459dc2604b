"""The prefix trie, fill-in-the-middle and licence scans against plain versions and on odd rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from datasteward.llm import fill_in_middle, licenses, prefix_trie
from datasteward.sources.shared import shared_dir

TURNS = "conv_id long, turn long, role string, text string, pos long, h long, k1 string, base string"
DOCS = "doc_id long, text string, form string, n string, h string, pieces string, found string"


@pytest.fixture(scope="module", autouse=True)
def shared(spark):
    assert shared_dir(spark)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- prefix trie --------------------------------------------------------------------------------

def plain_rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", sha(text or ""), text or ""))
    own = {c: [(r, t) for *_, r, _, t in sorted(v)] for c, v in own.items()}

    def built(c):
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(c - 5 * int(c / 5))
        return own.get(base, [])[:h] + own[c][h:]
    return {c: built(c) for c in own}


def plain_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if p in kids else 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -10**9, len(m), len(kids.get(p, [])), leaves[p], saved[p],
                   sha(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)))) for p, m in members.items())


def got_trie(df):
    return sorted((r["conv_id"], r["depth"], -10**9 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"],
                   r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], TURNS)


@pytest.fixture(scope="module")
def mixed_rows():
    """Shared first turns, ties, equal rows, nulls, absent bases, one long conversation and many copies of another."""
    rng = random.Random(4)
    rows = []
    for c in [*range(40), -1, -5, -7, 1003, 1007]:
        for t in range(rng.randint(1, 11)):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é\U0001F600", None, ""])))
    rows += [(c, t, "user", f"same {t}") for c in range(100, 160) for t in range(3)]
    rows += [(200, t // 2, "user", f"long {t % 7}") for t in range(400)] + [(8, 1, "user", "a")] * 3 + [(None, 0, "user", "a")]
    return rows


def test_trie(spark, mixed_rows):
    built = prefix_trie.rebuilt(prefix_trie.turn_rows(conversations(spark, mixed_rows)))
    want = plain_trie(plain_rebuilt(mixed_rows))
    assert got_trie(prefix_trie.prefix_trie(built)) == want


def test_trie_empty(spark):
    none = conversations(spark, [(None, 0, "user", "a")])
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turn_rows(none))).count() == 0
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turn_rows(none.limit(0)))).count() == 0


def test_list_ranks_beyond_a_chunk(spark):
    """More elements than a chunk holds, in an order that tells nothing about the list: rounds of random mates."""
    order = list(range(120))
    random.Random(2).shuffle(order)
    arcs = spark.createDataFrame([(a, b, a) for a, b in zip(order, order[1:] + [-1])], "arc long, next long, near long")
    got = prefix_trie.list_ranks(arcs, ["near"], chunk=40)
    assert {r["arc"]: r["rank"] for r in got.collect()} == {a: k for k, a in enumerate(order)}


def test_ends_in_pieces():
    import pyarrow as pa
    ids = list(range(95, 140))
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 44 + [2]), pa.array([7] * 45), pa.array(ids)], names=["k1", "k2", "conv_id"])
    pieces = list(prefix_trie._chunks_of_ids(most=100)(iter([batch.slice(0, 13), batch.slice(13)])))
    assert len(pieces) == 10
    found = [r for b in prefix_trie._hash_pieces(iter(pieces)) for r in b.to_pylist()]
    assert found == [{"k1": 1, "k2": 7, "ends_sha256": sha(",".join(map(str, ids[:-1])))}, {"k1": 2, "k2": 7, "ends_sha256": sha("139")}]


# --- fill-in-the-middle -------------------------------------------------------------------------

def plain_fim(doc_id, text):
    text = text or ""
    x = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(x[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle(spark):
    texts = ["", None, "a", "é", "\U0001F600x\U0001F600é", "<P", "a<S>b", "<M>", "S><", "\n\x00\t", "ab<<P" * 9, "long é\U0001F600 " * 30_000]
    rows = [(i, t) for i in range(14) for t in texts] + [(None, "null id"), (None, None), (3, "twice"), (3, "twice"), (-4, "minus")]
    df = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], DOCS)
    done = fill_in_middle.fill_in_middle(df)
    got = fill_in_middle.restore(done).select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()
    want = [(i, t or "", len(t or ""), *plain_fim(i, t), t or "") for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    digests = {(r["doc_id"], r["n"], r["form"], r["output_sha256"], r["restored_sha256"]) for r in fill_in_middle.digests(done).collect()}
    assert digests == {(i, n, form, sha(out), sha(t)) for i, t, n, form, _, _, out, _ in want}
    assert fill_in_middle.digests(fill_in_middle.fill_in_middle(df.limit(0))).count() == 0
    odd = spark.createDataFrame([(None, "psm"), ("x<P>", None), ("y", "other")], "output string, form string")
    assert [r["restored"] for r in fill_in_middle.restore(odd).collect()] == [None, "x<P>", "y"]


def test_filters_on_digests(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    got = fill_in_middle.digests(fill_in_middle.fill_in_middle(df)).join(df, "doc_id").filter(F.sha2("text", 256) == F.col("restored_sha256"))
    assert got.count() == 20


def test_piece_table():
    pieces = fill_in_middle.cut([(0, 0, 9), (1, 3, 3)], 0, 4)
    assert pieces == [(0, 0, 4), (0, 4, 5), (1, 3, 3)]
    assert fill_in_middle.cut(pieces, 2, 0) == [(0, 0, 4), (0, 4, 5), (1, 3, 0), (1, 3, 3)]
    for order in fill_in_middle.ORDERS.values():
        assert fill_in_middle.arranged(fill_in_middle.arranged(list("abcdef"), order), fill_in_middle.inverse(order)) == list("abcdef")[:len(order)]


# --- licences -----------------------------------------------------------------------------------

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def plain_licenses(text):
    words = licenses.WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    base = sorted((k, label) for phrase, label in licenses.BASE for k in range(len(words)) if words[k:k + len(phrase.split())] == phrase.split())
    close = []  # (label, first word, last word, share of edits) of every run of words close enough to a notice
    for phrase, label in licenses.NOTICES:
        k, n = licenses.errors_allowed(phrase), len(phrase.split())
        for i in range(len(words)):
            for j in range(i + max(1, n - k), min(len(words), i + n + k) + 1):
                if abs(len(" ".join(words[i:j])) - len(phrase)) <= k and (d := distance(" ".join(words[i:j]), phrase)) <= k:
                    close.append((label, i, j, d / len(phrase)))
    return len(words), base, close


def licence_texts():
    rng = random.Random(9)
    fill = "one License of the un rights der mit by cc public 4 all version".split()
    out = ["", None, "...", "Under the MIT-License", "under the MIT LICENSE under the mit license", "cc-by-nc-sa 4.0; CC BY NC", "é under thé mit license",
           "Undre the MIT licence", "GNU General Public License, version 3", "GNU GENERAL PUBLIC LICENCE Version 2", "xunder the mit license",
           "gnu lesser general public licens", "all rihgts reserved", "all right reserved", "under the mit license", "cc by n c", "cc by ncx",
           "Permission is hereby granted, fre of charge, to any person obtainin a copy of this sofware", "under the mit license" * 3]
    for _ in range(150):
        phrase = list(rng.choice(licenses.NOTICES)[0])
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(phrase))
            rng.choice([lambda: phrase.__setitem__(at, rng.choice("abe t")), lambda: phrase.insert(at, rng.choice("abe ")), lambda: phrase.pop(at)])()
        out.append(" ".join(rng.choices(fill, k=rng.randint(0, 9))) + rng.choice([" ", ", ", " -- ", "x"]) + "".join(phrase).upper()
                   + rng.choice([" ", ".", "é"]) + " ".join(rng.choices(fill, k=rng.randint(0, 9))))
    return out


def test_license_scan(spark):
    texts = licence_texts()
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, base string, spans string")
    scanned = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    for k, t in enumerate(texts):
        n, base, close = plain_licenses(t)
        r = scanned[k]
        assert (r["n_words"], [(b["word"], b["label"]) for b in r["base"]]) == (n, base), t
        spans = [(s["label"], len(licenses.WORD.findall(t[:s["start"]])), len(licenses.WORD.findall(t[:s["end"]])), 1 - s["likeness"]) for s in r["spans"]]
        for label, a, b, share in spans:  # every span is one that the plain search finds, and they stand apart
            assert any(c[:3] == (label, a, b) and abs(c[3] - share) < 1e-9 for c in close), (t, label)
        assert all(x[2] <= y[1] for x, y in zip(spans, spans[1:])), t
        for _, a, b, share in close:  # and nothing close is lost but to a span at least as close that overlaps it
            assert any(x[1] < b and a < x[2] and x[3] <= share + 1e-9 for x in spans), (t, a, b)


def test_license_labels(spark):
    texts = licence_texts()[:19]
    df = spark.createDataFrame([(None if k == 3 else k, t) for k, t in enumerate(texts)] * 2, "doc_id long, text string")
    rows = licenses.labelled(licenses.scan_licenses(df)).collect()
    assert len(rows) == 38
    by = {r["doc_id"]: r.asDict() for r in rows}
    for k in (0, 1, 2):
        assert by[k] == {"doc_id": k, "n_words": 0, "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0}
    assert by[None]["base_labels"] == by[None]["labels"] == "mit" and by[None]["score"] == 1.0
    assert (by[4]["n_base"], by[4]["first_word"], by[4]["last_word"]) == (2, 0, 4)
    assert (by[5]["base_labels"], by[5]["labels"]) == ("cc-by-nc", "cc-by-nc,cc-by-nc-sa")
    assert by[7]["base_labels"] == "" and by[7]["labels"] in ("", "mit") and by[9]["labels"] == "gpl-2" and by[17]["labels"] == "mit"
    assert by[10]["n_base"] == 0 and by[16]["labels"] == ""
    assert licenses.labelled(licenses.scan_licenses(df.limit(0))).count() == 0
    long = spark.createDataFrame([(1, "w " * 300_000 + "Under the MIT License " + "z" * 300_000)], "doc_id long, text string")
    assert licenses.labelled(licenses.scan_licenses(long)).first()["first_word"] == 300_000
