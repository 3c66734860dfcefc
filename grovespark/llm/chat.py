r"""Chat formatting by schema fingerprints, in DataFrame functions alone.

A record may be laid out as a prompt with a completion, an instruction with input
and output, a list of messages or a row a turn.  Which of the known nested field
paths it has is hashed into a fingerprint; the fingerprint selects a declarative
mapping, and the mapping says which paths make which turns.  Turns of a conversation
are then written in one template:

    ### <role>:\n<text></turn>\n

Inside roles and texts ``\`` becomes ``\b``, ``<`` becomes ``\l`` and ``#`` becomes
``\h``, so no control string can come from a text and each is read back exactly.
The loss mask has three numbers a turn: characters before, under and after it;
assistant texts are under it.

Turns are mapped and escaped where their rows lie; one shuffle by conversation
follows, with partial lists made before it.  A single conversation has to meet in
one row, since its result is one string.

Defined results: null text and null role count as empty; turns come in order of
turn number (null first), place within the record, role, text; repeated rows are
repeated turns; a null conversation id is a conversation of its own; a record whose
fingerprint no mapping has, or whose list is empty, gives no turns, and its conversation
comes out with the turns of its other records, perhaps with none, and the number of
records without; fields of no known path don't matter, nor do other columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovespark.llm.common import fresh

END = "</turn>\n"
OPEN, CLOSE = "### ", ":\n"
#: What stands for each character that control strings are made of; the first is undone last.
ESCAPES = {"\\": "\\b", "<": "\\l", "#": "\\h"}
ROLE_ESCAPES = ESCAPES | {"\n": "\\n"}
TRAINED_ROLE = "assistant"


@dataclass(frozen=True)
class Layout:
    """``parts``: (role, paths of the texts that make the turn); or ``items``: (list, role field, text field)."""

    name: str
    paths: tuple[str, ...]
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    items: tuple[str, str, str] | None = None


#: The layouts that are known, by the nested paths that they have.
LAYOUTS = (
    Layout("turn rows", ("role", "text")),
    Layout("prompt and completion", ("prompt", "completion"), (("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt and response", ("prompt", "response"), (("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("system, prompt and response", ("prompt", "response", "system"), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question and answer", ("answer", "question"), (("user", ("question",)), ("assistant", ("answer",)))),
    Layout("instruction", ("instruction", "output"), (("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction with input", ("input", "instruction", "output"), (("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("nested prompt", ("prompt.text", "response.text"), (("user", ("prompt.text",)), ("assistant", ("response.text",)))),
    Layout("messages", ("messages[].content", "messages[].role"), items=("messages", "role", "content")),
    Layout("speakers", ("conversations[].from", "conversations[].value"), items=("conversations", "from", "value")),
)
#: Names that other layouts use for the same roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
PATHS = sorted({p for x in LAYOUTS for p in x.paths})


def has(record: Column, path: str) -> Column:
    """True where the path leads to a value that is not an object, be it null."""
    at = "$." + path.replace("[]", "[0]")
    found = F.try_variant_get(record, at, "variant")
    return found.isNotNull() & ~F.schema_of_variant(found).startswith("OBJECT")


def fingerprint(record: Column) -> Column:
    present = F.array_compact(F.array(*[F.when(has(record, p), F.lit(p)) for p in PATHS]))
    return F.xxhash64(F.array_join(present, ","))


def text_at(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, "$." + path, "string"), F.lit(""))


def one_turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def turns_of(record: Column, layout: Layout) -> Column:
    if layout.items:
        name, role, text = layout.items
        as_rows = F.try_variant_get(record, f"$.{name}", f"array<struct<`{role}`: string, `{text}`: string>>")
        roles = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
        return F.transform(as_rows, lambda x: one_turn(F.coalesce(roles[x[role]], x[role]), x[text]))
    if not layout.parts:
        return F.array(one_turn(text_at(record, "role"), text_at(record, "text")))
    joined = [(role, [text_at(record, p) for p in paths]) for role, paths in layout.parts]
    return F.array(*[one_turn(F.lit(role), F.array_join(F.filter(F.array(*texts), lambda t: t != ""), "\n\n")) for role, texts in joined])


def canonical_turns(records: DataFrame, record: str = "record", key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, order, place, role, text: a row a turn of every record, a variant column; a record without turns has one row, of null place."""
    mapped = None
    known, turn = fresh([record, key, order], "print", "given")
    for layout in LAYOUTS:
        mine = F.col(known) == F.xxhash64(F.lit(",".join(sorted(layout.paths))))
        turns = turns_of(F.col(record), layout)
        mapped = F.when(mine, turns) if mapped is None else mapped.when(mine, turns)
    return (
        records.select(key, order, record, fingerprint(F.col(record)).alias(known))
        .select(F.col(key), F.col(order), F.posexplode_outer(mapped).alias("place", turn))
        .select(F.col(key), F.col(order), "place", f"{turn}.role", f"{turn}.text")
    )


def escape(value: Column, escapes: dict[str, str] = ESCAPES) -> Column:
    for char, code in escapes.items():
        value = F.replace(value, F.lit(char), F.lit(code))
    return value


def unescape(value: Column, escapes: dict[str, str] = ROLE_ESCAPES) -> Column:
    for char, code in reversed(escapes.items()):
        value = F.replace(value, F.lit(code), F.lit(char))
    return value


def render(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """key, formatted, loss_mask (before, under, after: characters of each turn), n_without: records that gave no turns."""
    head = F.concat(F.lit(OPEN), escape(F.col("role"), ROLE_ESCAPES), F.lit(CLOSE))
    body = escape(F.col("text"))
    trained = F.col("role") == TRAINED_ROLE
    under = F.when(trained, F.length(body)).otherwise(0)
    before = F.length(head) + F.when(trained, 0).otherwise(F.length(body))
    row = F.struct(F.col(order), "place", "role", "text", F.concat(head, body, F.lit(END)).alias("piece"), F.struct(before.alias("before"), under.alias("under"), F.lit(len(END)).alias("after")).alias("mask"))
    return (
        turns.groupBy(key)
        .agg(F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), row))).alias("rows"), F.count_if(F.col("place").isNull()).alias("n_without"))
        .select(key, F.array_join(F.col("rows.piece"), "").alias("formatted"), F.col("rows.mask").alias("loss_mask"), "n_without")
    )


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, formatted, turns (role, text) and the text under the loss mask, both from the formatted string."""
    pieces = F.split("formatted", END)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        at = F.locate(CLOSE, piece)
        role = F.substring(piece, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        text = F.substring(piece, at + len(CLOSE), F.length(piece))
        return F.struct(unescape(role).alias("role"), unescape(text, ESCAPES).alias("text"))

    under = F.transform(F.arrays_zip(F.col("pieces"), F.col("loss_mask")), lambda x: F.substring(x["pieces"], x["loss_mask"]["before"] + 1, x["loss_mask"]["under"]))
    return formatted.withColumn("pieces", pieces).select(key, "formatted", F.transform("pieces", turn).alias("turns"), unescape(F.array_join(under, ""), ESCAPES).alias("loss_text"))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def summary(read: DataFrame, key: str = "conv_id") -> DataFrame:
    """n_turns, lengths and digests of what ``read_back`` gives."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        key,
        F.size("turns").cast("long").alias("n_turns"),
        digest(lines).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        digest(F.col("loss_text")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: ``summary`` of the conversations table and conversation -7 in DuckDB.
SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(role) + length(text) + 14
    + length(role || text) * 2 - length(replace(replace(role || text, '\', ''), '<', '')) - length(replace(role || text, '#', ''))
    + length(role) - length(replace(role, chr(10), '')) AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
