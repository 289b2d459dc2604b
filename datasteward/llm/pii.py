"""Personal data: base patterns, and further candidates judged by labelers whose reliabilities are learnt."""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datasteward.llm.common import write_table

KINDS = ["email", "ip", "card", "phone", "id", "secret"]
VOTES = ["valid", "canonical", "gazetteer", "context", "edges", "variety"]
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,pattern:string>>"

# The base patterns.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Patterns of further candidates.
LOCAL_PHONE = re.compile(r"\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])")
ID_SHAPE = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
PHONE_SHAPE = re.compile(r"[0-9]{3}[ -][0-9]{3}[ -][0-9]{4}")
KEY_PREFIX = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,}")
VALUE = re.compile(r"[ ]?[=:][ ]?[\"']?([0-9A-Za-z_+/-]{8,})")

# Gazetteers and cues of the labelers.
TOP_DOMAINS = set("com org net edu gov io info biz de fr es it uk eu us ca ch at nl be pt pl se no dk fi jp cn in br ru au".split())
SECRET_WORDS = set("password passwd pwd token secret apikey api_key access_key auth key".split())
CUES = {"email": "mail email e-mail contact correo courriel write", "ip": "ip host address server addr adresse",
        "card": "card visa mastercard amex credit tarjeta carte karte pay", "phone": "phone tel call fax mobile telefon telefono",
        "id": "ssn social id passport dni steuer", "secret": "password passwd token secret key api auth login"}
CUES = {k: set(v.split()) for k, v in CUES.items()}
OTHER_CUES = set("version v release license licence section page figure table item order isbn doi build chapter".split())


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping e-mail matches, in time linear in the text also for very long words."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        tail = DOMAIN.match(text, at + 1) if start < at else None
        if tail:
            yield start, tail.end()
            done = tail.end()
            at = text.find("@", done)
        else:
            done = at + 1
            at = text.find("@", at + 1)


def octets_fit(match: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))


def base_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """The spans of the base patterns per kind; matches that fail their test are dropped without another try."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS[:4]}
    if not text:
        return out
    if "@" in text:
        out["email"] = list(emails(text))
    out["ip"] = [m.span() for m in IP.finditer(text) if octets_fit(m.group())]
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def names_secret(before: str) -> bool:
    """Whether the identifier at the end of ``before``, in quotes or not, ends in a word for a secret: password, DB_PASSWORD,
    aws_secret_access_key, "api-key", userToken."""
    name = re.search(r"[A-Za-z0-9_.-]+$", before.rstrip("\"'"))
    parts = [x.lower() for x in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", name.group())] if name else []
    return any(joint.join(parts[-n:]) in SECRET_WORDS for n in (1, 2) for joint in ("", "_"))


def further_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates beyond the base patterns, in the order of their priority."""
    out = []
    for m in DIGITS.finditer(text):
        n = m.end() - m.start()
        if n >= 11:
            d = re.sub("[^0-9]", "", m.group())
            if ID_SHAPE.fullmatch(m.group()):
                out.append(("id", *m.span()))
            elif PHONE_SHAPE.fullmatch(m.group()):
                out.append(("phone", *m.span()))
            elif 13 <= len(d) <= 19 and not luhn(d):
                out.append(("card", *m.span()))
    if "(" in text:
        out += [("phone", *m.span()) for m in LOCAL_PHONE.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if not octets_fit(m.group())]
    out += [("secret", *m.span()) for m in KEY_PREFIX.finditer(text)]
    for sign in "=:":
        at = text.find(sign)
        while at >= 0:
            left = at - 1 if at and text[at - 1] == " " else at
            value = VALUE.match(text, left)
            if value and names_secret(text[max(0, left - 80):left]):
                out.append(("secret", *value.span(1)))
            at = text.find(sign, at + 1)
    return out


def votes_on(text: str, kind: str, start: int, end: int) -> list[int]:
    """One vote of 1 (personal), -1 (not) or 0 (no opinion) per labeler."""
    s = text[start:end]
    digits = re.sub("[^0-9]", "", s)
    if kind == "email":
        host = s.rpartition("@")[2]
        valid = 1 if re.search(r"\.[A-Za-z]{2,}$", host) else -1
        canonical = 1 if re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9][A-Za-z0-9.-]*", s) else -1
        listed = 1 if host.rpartition(".")[2].lower() in TOP_DOMAINS else 0
    elif kind == "ip":
        valid = 1 if octets_fit(s) else -1
        canonical = 1 if re.fullmatch(r"(?:[1-9][0-9]{0,2}|0)(?:\.(?:[1-9][0-9]{0,2}|0)){3}", s) else -1
        listed = -1 if s.startswith(("0.", "127.", "255.")) else 0
    elif kind == "card":
        valid = 1 if luhn(digits) else -1
        canonical = 1 if len(digits) in (15, 16) and re.fullmatch(r"[0-9]+|[0-9]{4}(?:[ -][0-9]{2,6})+", s) else -1
        listed = 1 if digits[0] in "3456" else -1
    elif kind == "phone":
        valid = 1 if 9 <= len(digits) <= 15 else -1
        canonical = 1 if re.search(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$", s) else 0
        listed = 1 if s.startswith("+") else 0
    elif kind == "id":
        valid = -1 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" else 1
        canonical, listed = 1, 0
    else:
        valid = 1 if len(s) >= 12 and re.search("[0-9]", s) and re.search("[A-Za-z]", s) else -1
        canonical = 1 if KEY_PREFIX.fullmatch(s) or re.fullmatch("[0-9a-f]{16,}", s) else 0
        listed = 1 if s.startswith(("AKIA", "ASIA", "ghp_", "sk-")) else 0
    near = set(re.findall(r"[a-z_-]+", text[max(0, start - 40):start].lower()))
    context = 1 if near & CUES[kind] else -1 if near & OTHER_CUES else 0
    glued = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    kinds_of = len(set(digits if kind in ("card", "phone", "ip", "id") else s))
    return [valid, canonical, listed, context, -1 if glued else 1, -1 if kinds_of <= 2 else 1]


def pattern_of(text: str, kind: str, start: int, end: int) -> str:
    """The votes, and what the final classifier sees: length and share of digits in steps, separators, first character."""
    s = text[start:end]
    n = len(s)
    share = sum(c.isdigit() for c in s) * 4 // max(1, n)
    first = "d" if s[0].isdigit() else "u" if s[0].isupper() else "l" if s[0].isalpha() else "o"
    votes = "".join("-0+"[v + 1] for v in votes_on(text, kind, start, end))
    return f"{kind}|{votes}|n{min(n // 6, 8)}|d{share}|s{min(sum(c in ' -.()' for c in s), 4)}|{first}"


def candidates(text: str | None) -> list[dict]:
    """All base spans, and those further candidates that overlap none of them and no earlier one."""
    if not text:
        return []
    found = [(k, a, b, True) for k, spans in base_spans(text).items() for a, b in spans]
    taken: list[tuple[int, int]] = []  # disjoint and sorted
    for a, b in sorted((a, b) for _, a, b, _ in found):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    for k, a, b in further_spans(text):
        at = bisect.bisect_left(taken, (b, b))  # the first that starts at b or later
        if at == 0 or taken[at - 1][1] <= a:
            found.append((k, a, b, False))
            taken.insert(at, (a, b))
    found.sort(key=lambda x: (KINDS.index(x[0]), x[1]))
    return [{"kind": k, "start": a, "end": b, "base": base, "pattern": pattern_of(text, k, a, b)} for k, a, b, base in found]


_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()),
                                 ("pattern", pa.string())]))


def _candidates(texts: pa.Array) -> pa.Array:
    return pa.array([candidates(t.as_py()) for t in texts], _SPAN_TYPE)


def candidate_spans(text) -> F.Column:
    return F.arrow_udf(_candidates, SPANS)(text)


def estimate_reliabilities(patterns: list[tuple[str, float]], rounds: int = 60) -> dict[str, float]:
    """Expectation-maximisation on counted patterns: the probability that a candidate with these votes is personal data.

    Per kind, a labeler's votes are independent given the truth. It starts from the majority of the votes."""
    out: dict[str, float] = {}
    for kind in KINDS:
        rows = [(p, n) for p, n in patterns if p.split("|")[0] == kind]
        if not rows:
            continue
        votes = np.array([["-0+".index(c) for c in p.split("|")[1]] for p, _ in rows])
        n = np.array([c for _, c in rows], float)
        q = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(axis=1)))
        for _ in range(rounds):
            share = np.clip((n * q).sum() / n.sum(), 0.02, 0.98)
            odds = np.full(len(rows), np.log(share / (1 - share)))
            for j in range(len(VOTES)):
                yes = np.bincount(votes[:, j], n * q, 3) + np.array([0.5, 1.0, 1.5])
                no = np.bincount(votes[:, j], n * (1 - q), 3) + np.array([1.5, 1.0, 0.5])
                odds += (np.log(yes / yes.sum()) - np.log(no / no.sum()))[votes[:, j]]
            q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        out.update({p: float(x) for (p, _), x in zip(rows, q, strict=True)})
    return out


def train_classifier(patterns: list[tuple[str, float]], truth: dict[str, float], steps: int = 400) -> dict[str, float]:
    """Logistic regression on the form of the span and the votes, with the estimated probabilities as labels; one weight
    per feature value. Returns the probability of every pattern."""
    if not patterns:
        return {}

    def features(p: str) -> list[str]:
        kind, votes, *form = p.split("|")
        return ["", kind, *[f"{kind}{x}" for x in form], *[f"{VOTES[j]}{c}" for j, c in enumerate(votes)]]
    index: dict[str, int] = {}
    rows = [[index.setdefault(f, len(index)) for f in features(p)] for p, _ in patterns]
    x = np.zeros((len(rows), len(index)))
    for k, r in enumerate(rows):
        x[k, r] = 1
    n = np.log1p(np.array([c for _, c in patterns], float))
    n, y, w = n / n.sum(), np.array([truth[p] for p, _ in patterns]), np.zeros(len(index))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 4.0 * (x.T @ (n * (p - y)) + 1e-4 * w)
    return {p: float(v) for (p, _), v in zip(patterns, 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), strict=True)}


def accepted_patterns(spans: DataFrame, column: str = "spans", least: float = 0.5) -> list[str]:
    """Learn from the candidates of all documents. Only counted patterns reach the driver: their number is bounded by the
    kinds, votes and forms there are, whatever the number of documents."""
    counted = [(r[0], float(r[1])) for r in spans.select(F.explode(F.transform(column, lambda s: s["pattern"])).alias("p"))
               .groupBy("p").agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()]
    score = train_classifier(counted, estimate_reliabilities(counted))
    return sorted(p for p, v in score.items() if v >= least)


def final_spans(spans, accepted: list[str]) -> F.Column:
    """Base spans, and the candidates that the classifier accepts."""
    known = F.array(*[F.lit(p) for p in accepted]) if accepted else F.array().cast("array<string>")
    return F.filter(spans, lambda s: s["base"] | F.array_contains(known, s["pattern"]))


def _joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row: the final spans by kind and start, in code points, end exclusive.

    Null and empty texts have none. Repeated rows get the same spans each. Extra columns are ignored."""
    found = write_table(docs.select("doc_id", candidate_spans("text").alias("spans")))
    return found.select("doc_id", final_spans("spans", accepted_patterns(found)).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """The counts and digests of ``find_personal_data``'s rows, any of which may repeat; an empty list of spans counts none."""
    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(_joined(base), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"))


def redact(text: str | None, spans: list[dict]) -> str | None:
    """Replace each span by its kind in angle brackets; overlapping spans become one, named by the first."""
    if not text or not spans:
        return text
    out, done = [], 0
    merged: list[list] = []
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if merged and s["start"] < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s["end"])
        else:
            merged.append([s["start"], s["end"], s["kind"]])
    for a, b, kind in merged:
        out += [text[done:a], f"<{kind}>"]
        done = b
    return "".join([*out, text[done:]])


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and ``n_chars`` as the new text has; other columns unchanged."""
    accepted = accepted_patterns(docs.select(candidate_spans("text").alias("spans")))
    keep = set(accepted)

    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            t = t.as_py()
            out.append(redact(t, [s for s in candidates(t) if s["base"] or s["pattern"] in keep]))
        return pa.array(out, pa.string())
    new = docs.withColumn("text", F.arrow_udf(clean, "string")("text"))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.char_length("text").cast("long"))
    return new.select(docs.columns)
