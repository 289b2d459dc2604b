"""Chat formatting: a fingerprint of a record's nested field paths selects the mapping to canonical turns.

DataFrame functions only. A record is a JSON text, a variant, or a struct; records of one table may differ in layout."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"
START, END = "<|im_start|>", "<|im_end|>"
#: Scalar fields that carry no turns; they may be present or absent in any layout.
IGNORED = ("id", "conv_id", "source", "lang", "url", "created", "model")


@dataclass(frozen=True)
class Mapping:
    """One layout. ``paths``: its schema with every scalar written as V, fields in alphabetical order.

    Either ``items`` is the path of an array whose elements hold a role and a text, or ``fields`` lists (role, paths of the
    texts that make up its turn, parts joined by a blank line; absent or null parts fall away)."""
    name: str
    paths: str
    items: str | None = None
    role: str = "role"
    text: str = "content"
    roles: tuple[tuple[str, str], ...] = ()
    fields: tuple[tuple[str, tuple[str, ...], bool], ...] = ()  # (role, paths, whether the turn is there even if all are null)


MAPPINGS = (
    Mapping("messages", "OBJECT<messages: ARRAY<OBJECT<content: V, role: V>>>", "$.messages"),
    Mapping("no_messages", "OBJECT<messages: ARRAY<V>>", "$.messages"),
    Mapping("from_value", "OBJECT<conversations: ARRAY<OBJECT<from: V, value: V>>>", "$.conversations", "from", "value",
            (("human", "user"), ("gpt", "assistant"))),
    Mapping("speaker_text", "OBJECT<dialog: ARRAY<OBJECT<speaker: V, text: V>>>", "$.dialog", "speaker", "text",
            (("bot", "assistant"), ("customer", "user"))),
    Mapping("prompt", "OBJECT<completion: V, prompt: V>",
            fields=(("user", ("$.prompt",), True), ("assistant", ("$.completion",), True))),
    Mapping("prompt_response", "OBJECT<prompt: V, response: V>",
            fields=(("user", ("$.prompt",), True), ("assistant", ("$.response",), True))),
    Mapping("question", "OBJECT<answer: V, question: V>",
            fields=(("user", ("$.question",), True), ("assistant", ("$.answer",), True))),
    Mapping("instruction", "OBJECT<input: V, instruction: V, output: V>",
            fields=(("user", ("$.instruction", "$.input"), True), ("assistant", ("$.output",), True))),
    Mapping("instruction_only", "OBJECT<instruction: V, output: V>",
            fields=(("user", ("$.instruction",), True), ("assistant", ("$.output",), True))),
    Mapping("system_instruction", "OBJECT<input: V, instruction: V, output: V, system: V>",
            fields=(("system", ("$.system",), False), ("user", ("$.instruction", "$.input"), True),
                    ("assistant", ("$.output",), True))),
)


def fingerprint_of(paths: str) -> str:
    return hashlib.sha256(paths.encode()).hexdigest()


def record_paths(record: Column, ignored=IGNORED) -> Column:
    """The nested field paths of a variant as one text: field names with V for every scalar, whatever its type or value."""
    scalar = r"(?<=[:<] ?)(?:STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DATE|TIMESTAMP(?:_NTZ)?|BINARY|DECIMAL\(\d+,\s?\d+\))(?=[,>])"
    flat = F.regexp_replace(F.schema_of_variant(record), scalar, "V")
    names = "|".join(ignored)
    if not names:
        return flat
    less = F.regexp_replace(flat, rf"(?<=[<] ?)(?:{names}): V, |, (?:{names}): V(?=[,>])", "")
    return F.regexp_replace(less, rf"(?<=[<] ?)(?:{names}): V, |, (?:{names}): V(?=[,>])", "")


def as_variant(record: Column, kind: str) -> Column:
    return F.try_parse_json(record) if kind == "string" else record if kind == "variant" else F.to_variant_object(record)


def _turns(m: Mapping, record: Column) -> Column:
    if m.items:
        def role(x):
            out = F.coalesce(x[m.role], F.lit(""))
            for a, b in m.roles:
                out = F.when(x[m.role] == a, F.lit(b)).otherwise(out)
            return out
        items = F.variant_get(record, m.items, f"array<struct<`{m.role}`:string,`{m.text}`:string>>")
        return F.transform(items, lambda x: F.struct(role(x).alias("role"), F.coalesce(x[m.text], F.lit("")).alias("text")))
    parts = []
    for role, paths, always in m.fields:
        texts = [F.try_variant_get(record, p, "string") for p in paths]
        turn = F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *texts).alias("text"))
        parts.append(turn if always else F.when(F.coalesce(*texts).isNotNull(), turn))
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def canonical_turns(df: DataFrame, record_col: str = "record", mappings=MAPPINGS, ignored=IGNORED) -> DataFrame:
    """``df`` with fingerprint, mapping (null if no layout fits) and turns (role, text).

    No record is dropped: an unknown layout, a null record or a text that is no JSON has a null mapping and no turns. Null
    roles and texts are empty. Other columns stay as they are."""
    kind = dict(df.dtypes)[record_col]
    out = df.withColumn("variant_", as_variant(F.col(record_col), kind))
    out = out.withColumn("fingerprint", F.sha2(record_paths(F.col("variant_"), ignored), 256))
    chosen, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for m in mappings:
        fits = F.col("fingerprint") == fingerprint_of(m.paths)
        chosen = F.when(fits, m.name).otherwise(chosen)
        turns = F.when(fits, _turns(m, F.col("variant_"))).otherwise(turns)
    return out.withColumns({"mapping": chosen, "turns": turns}).drop("variant_")


def escape_text(text: Column) -> Column:
    r"""``<``, any number of backslashes, ``|`` gets one backslash more: no control string is left, and it is reversible."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("|"), F.lit("\\p"))


def unescape_role(role: Column) -> Column:
    parts = F.split(role, r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\p"), F.lit("|"))),
                        "\\")


def format_turns(df: DataFrame, turns_col: str = "turns") -> DataFrame:
    """``df`` with ``formatted`` and ``loss_spans``.

    Each turn is written as start mark, role, line end, text, end mark, line end. loss_spans: (turn, start, length) in code
    points inside the segment of that turn, over each assistant text; relative places keep the work linear in the length."""
    def segment(t):
        return F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape_text(t["text"]), F.lit(END + "\n"))

    def span(t, k):
        return F.when(t["role"] == "assistant", F.struct(
            k.alias("turn"), (F.char_length(escape_role(t["role"])) + len(START) + 2).alias("start"),
            F.char_length(escape_text(t["text"])).alias("length")))
    turns = F.col(turns_col)
    return df.withColumns({"formatted": F.array_join(F.transform(turns, segment), ""),
                           "loss_spans": F.filter(F.transform(turns, span), lambda s: s.isNotNull())})


def read_back(df: DataFrame) -> DataFrame:
    """``df`` with ``turns_read`` and ``loss_text``, both from ``formatted`` (and ``loss_spans``) alone."""
    segments = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda s: s != "")
    head = len(START)

    def turn(s):
        body = F.substring(s, F.lit(head + 1), F.char_length(s))
        cut = F.instr(body, "\n")
        return F.struct(unescape_role(F.substring(body, F.lit(1), cut - 1)).alias("role"),
                        unescape_text(F.substring(body, cut + 1, F.char_length(body))).alias("text"))
    out = df.withColumn("segments_", segments)
    masked = F.transform("loss_spans", lambda x: unescape_text(F.substring(F.get("segments_", x["turn"]), x["start"], x["length"])))
    return out.withColumns({"turns_read": F.transform("segments_", turn), "loss_text": F.array_join(masked, "")}).drop("segments_")


def records_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, record) from rows by turn, each conversation in the layout that suits it: a question with its answer as
    prompt and completion, one with a system text as instruction, all others as a list of messages.

    Turns are ordered by turn, role and text; repeated rows count each. Rows with a null conv_id form one conversation."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    grouped = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    roles = F.array_join("rows.role", ",")
    text = [F.get("rows.content", F.lit(k)) for k in range(3)]
    messages = F.struct(F.transform("rows", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
    pair = F.struct(text[0].alias("prompt"), text[1].alias("completion"))
    told = F.struct(text[0].alias("system"), text[1].alias("instruction"), F.lit(None).cast("string").alias("input"),
                    text[2].alias("output"))
    record = (F.when(roles == "user,assistant", F.to_variant_object(pair))
              .when(roles == "system,user,assistant", F.to_variant_object(told)).otherwise(F.to_variant_object(messages)))
    return grouped.select("conv_id", record.alias("record"))


def conversation_digests(conversations: DataFrame) -> DataFrame:
    done = read_back(format_turns(canonical_turns(records_of(conversations))))
    said = F.array_join(F.transform("turns_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select("conv_id", F.size("turns_read").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.char_length("loss_text").cast("long").alias("loss_chars"),
                       F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))
