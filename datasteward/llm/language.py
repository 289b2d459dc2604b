"""Language identification in two steps: the family, then one-versus-one linear support vector machines inside it."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = 2048  # hashed cells each for pairs and triples of bytes
UNKNOWN = "und"

# Language codes by family. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi", "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk", "baltic": "lt lv", "uralic": "fi et hu", "turkic": "tr az kk uz ky tk",
    "indic": "hi ur bn mr pa gu ne or as si", "iranian": "fa ps ku tg", "semitic": "ar he mt am", "sinitic": "zh yue",
    "malayic": "id ms jv su", "dravidian": "ta te kn ml", "celtic": "ga cy br gd",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang.split("-")[0].lower(), lang)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Square roots of the counts of hashed byte pairs and triples of the whole lower-case text, scaled to length 1."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:]
    bits = np.uint32(32 - CELLS.bit_length() + 1)
    cells = [np.bincount((x * np.uint32(2654435761)) >> bits, minlength=CELLS) for x in (two, three)]
    v = np.sqrt(np.concatenate(cells).astype(np.float32))
    return v / np.linalg.norm(v)


def train_softmax(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 300, rate: float = 30.0) -> np.ndarray:
    """Weights (classes, features) of a logistic regression in which every class weighs the same."""
    w = np.zeros((classes, x.shape[1]))
    weight = 1.0 / np.bincount(y, minlength=classes)[y] / classes
    truth = np.eye(classes)[y]
    for _ in range(steps):
        z = x @ w.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= rate * (((p - truth) * weight[:, None]).T @ x + 1e-5 * w)
    return w


def train_svm(x: np.ndarray, sign: np.ndarray, cost: float = 4.0, epochs: int = 20, seed: int = 3) -> np.ndarray:
    """A linear support vector machine with squared hinge loss by dual coordinate descent; x has a constant column."""
    rng = np.random.default_rng(seed)
    c = cost * len(sign) / (2 * np.where(sign > 0, (sign > 0).sum(), (sign < 0).sum()))  # both sides weigh the same
    a, w = np.zeros(len(sign)), np.zeros(x.shape[1])
    norm = (x * x).sum(axis=1) + 0.5 / c
    for _ in range(epochs):
        for i in rng.permutation(len(sign)):
            g = sign[i] * (x[i] @ w) - 1 + a[i] * 0.5 / c[i]
            new = max(a[i] - g / norm[i], 0.0)
            w += (new - a[i]) * sign[i] * x[i]
            a[i] = new
    return w


def _smallest(each: int):
    """(lang, hash): the ``each`` smallest different hashes of every language among the rows of a task."""
    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            codes, hashes = names.indices.to_numpy(), batch.column(1).to_numpy()
            for code, lang in enumerate(names.dictionary.to_pylist()):
                own = hashes[codes == code]
                held[lang] = np.unique(np.concatenate([held[lang], own]) if lang in held else own)[:each]
        for lang, own in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own)], names=["lang", "hash"])
    return run


def _vectors(batches):
    for batch in batches:
        rows = [(lang, features(t)) for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if has_letter(t)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                          pa.array([r[1].tobytes() for r in rows], pa.binary())], names=["lang", "vector"])


def _sample(docs: DataFrame, most_rows: int, most_langs: int) -> tuple[list[str], np.ndarray]:
    """Labels and features of at most ``most_rows`` different texts, equally many of each of the ``most_langs`` most frequent
    languages: those with the smallest hashes, so ids play no part, and a copied text counts once."""
    docs = docs.filter("lang is not null").filter(F.col("text").rlike(r"\p{L}"))
    langs = [r["lang"] for r in docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()]
    if not langs:
        return [], np.empty((0, 2 * CELLS))
    each = max(1, most_rows // len(langs))
    rows = docs.filter(F.col("lang").isin(langs)).select("lang", F.xxhash64("text", F.lit(17)).alias("hash"), "text")
    order = Window.partitionBy("lang").orderBy("hash")
    chosen = (rows.select("lang", "hash").mapInArrow(_smallest(each), "lang string, hash long").distinct()
              .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= each).select("lang", "hash").collect())
    chosen = docs.sparkSession.createDataFrame(chosen, "lang string, hash long")
    found = (rows.join(F.broadcast(chosen), ["lang", "hash"]).groupBy("lang", "hash").agg(F.min("text").alias("text"))
             .select("lang", "text").mapInArrow(_vectors, "lang string, vector binary").collect())
    found.sort(key=lambda r: (r["lang"], bytes(r["vector"])))
    return [r["lang"] for r in found], np.array([np.frombuffer(r["vector"], np.float32) for r in found]).reshape(len(found), -1)


def train(docs: DataFrame, most_rows: int = 2400, most_langs: int = 200) -> dict:
    """A model from (text, lang) rows. ``most_rows`` bounds the sample that is fitted on, ``most_langs`` the languages that
    are learned, the most frequent ones (ties by name). Rows with null lang, or whose text is null or has no letter, teach
    nothing; without any other row the model knows no language. Extra columns are ignored."""
    labels, x = _sample(docs, most_rows, most_langs)
    langs = sorted(set(labels))
    if not langs:
        return {"langs": []}
    x = np.hstack([x, np.full((len(x), 1), 0.3, np.float32)]).astype(np.float64)
    families = sorted({family_of(a) for a in langs})
    of = np.array([families.index(family_of(a)) for a in labels])
    y = np.array([langs.index(a) for a in labels])
    members = [[k for k, a in enumerate(langs) if family_of(a) == f] for f in families]
    pairs = [(i, j) for group in members for i, j in combinations(group, 2)]
    machines = [train_svm(x[(y == i) | (y == j)], np.where(y[(y == i) | (y == j)] == i, 1.0, -1.0)) for i, j in pairs]
    return {"langs": langs, "members": members, "pairs": pairs, "machines": np.array(machines).reshape(len(pairs), x.shape[1]),
            "families": train_softmax(x, of, len(families))}


def predict(model: dict, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """Language and score of texts that hold a letter."""
    x = np.array([features(t) for t in texts])
    x = np.hstack([x, np.full((len(x), 1), 0.3, np.float32)])
    z = x @ model["families"].T
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    margin = x @ model["machines"].T
    family = p.argmax(axis=1)
    wins = np.zeros((len(x), len(model["langs"])))
    sums = np.zeros_like(wins)
    rivals = np.zeros(len(model["langs"]))
    for k, (i, j) in enumerate(model["pairs"]):
        wins[:, i] += margin[:, k] > 0
        wins[:, j] += margin[:, k] <= 0
        sums[:, i] += margin[:, k]
        sums[:, j] -= margin[:, k]
        rivals[[i, j]] += 1
    names, scores = [], np.empty(len(x))
    for r in range(len(x)):
        group = model["members"][family[r]]
        best = max(group, key=lambda a: (wins[r, a], sums[r, a], -a))
        sure = 1 / (1 + np.exp(-3 * sums[r, best] / rivals[best])) if rivals[best] else 1.0
        names.append(model["langs"][best])
        scores[r] = p[r, family[r]] * sure
    return names, scores


def identify(text, model: dict, spark) -> F.Column:
    """struct<lang, score> of a text column: ``und`` and 0 for null, for a text without a letter, and without a model."""
    shared = spark.sparkContext.broadcast(model)  # a few vectors per pair of related languages

    def run(texts: pa.Array) -> pa.Array:
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for a in range(0, len(texts), 256):
            part = texts[a:a + 256].to_pylist()
            own = [k for k, t in enumerate(part) if has_letter(t)] if shared.value["langs"] else []
            if own:
                names, s = predict(shared.value, [part[k] for k in own])
                for k, name, v in zip(own, names, s, strict=True):
                    langs[a + k], scores[a + k] = name, v
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], names=["lang", "score"])
    return F.arrow_udf(run, "struct<lang:string,score:double>")(text)


def language_id(docs: DataFrame, most_rows: int = 2400, most_langs: int = 200) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row. Documents whose crc32(doc_id) leaves 2 modulo 4 are held out of
    training, and so are null langs; a null doc_id is not held out. The text alone decides a prediction. Repeated rows get equal predictions; without any
    labelled text all are ``und``. Extra columns are ignored."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = train(docs.filter(~held & F.col("lang").isNotNull()).select("text", "lang"), most_rows, most_langs)
    return (docs.select("doc_id", held.alias("held_out"), identify(F.col("text"), model, docs.sparkSession).alias("p"))
            .select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score")))
