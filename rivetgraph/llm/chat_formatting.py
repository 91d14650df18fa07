"""Chat formatting with Spark expressions only: conversations as one training text each.

The turns of a conversation are collected as structs and sorted; neighbours of one role are
merged by array functions into a block; blocks become segments, whose texts joined are the
formatted text and whose ``trained`` flags are the loss mask. Only what assistants say is
trained.

Template (control strings in ``CONTROL``): a user's block is ``[INST]…[/INST]``, a system's
``<<SYS>>…<</SYS>>``, an assistant's ``<s>…</s>``, any other role's
``[ROLE]role[TEXT]…[/ROLE]``; ``[NEXT]`` stands between the merged turns of a block. A control
string inside a text gets a backslash after its first character, and a backslash is doubled,
so no text can close its block, and ``plain`` gives every text back as it was.

All steps are linear in the length of a conversation. One conversation is one row, since it
becomes one text.

Defined cases: null texts and roles are empty ones; turns with one number are ordered by role,
then text, a null number comes first; repeated rows are turns of their own; rows without
conv_id form one conversation; further columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: the template
BLOCKS = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
NEXT = "[NEXT]"
TRAINED_ROLE = "assistant"
CONTROL = r"([<\[])(/?s>|</?SYS>>|/?INST\]|/?ROLE\]|TEXT\]|NEXT\])"
CLOSERS = r"\[/INST\]|<</SYS>>|</s>|\[/ROLE\]"


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1\\$2")


def plain(text: Column) -> Column:
    """What ``escaped`` was made from."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _by_role(role: Column, known: dict[str, str], other: Column) -> Column:
    out = other
    for name, value in known.items():
        out = F.when(role == name, F.lit(value)).otherwise(out)
    return out


def _segment(text: Column, trained: Column | bool = False) -> Column:
    return F.struct(text.alias("text"), (F.lit(trained) if isinstance(trained, bool) else trained).alias("trained"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, segments (array of text, trained) and their joined text ``formatted`` of
    every conversation in ``turns`` (conv_id, turn, role, text)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = F.struct("turn", text("role").alias("role"), text("text").alias("text"))
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))

    said = F.col("turns")
    opens = F.transform(
        said, lambda t, i: F.when((i == 0) | (F.get(said, i - 1)["role"] != t["role"]), i)
    )
    marked = sorted_turns.withColumn("opens", F.filter(opens, lambda i: i.isNotNull()))
    merged = F.transform(
        F.col("opens"),
        lambda at, n: F.struct(
            F.get(said, at)["role"].alias("role"),
            F.slice(said, at + 1, F.coalesce(F.get(F.col("opens"), n + 1), F.size(said)) - at)["text"].alias("texts"),
        ),
    )
    blocks = marked.select("conv_id", merged.alias("blocks"))

    def block_segments(b: Column) -> Column:
        role = b["role"]
        head = _by_role(
            role, {r: o for r, (o, _) in BLOCKS.items()}, F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1]))
        )
        tail = _by_role(role, {r: c for r, (_, c) in BLOCKS.items()}, F.lit(OTHER[2]))
        said = F.transform(
            b["texts"],
            lambda t, i: F.array(
                _segment(F.when(i > 0, F.lit(NEXT)).otherwise("")), _segment(escaped(t), role == TRAINED_ROLE)
            ),
        )
        return F.concat(F.array(_segment(head)), F.flatten(said), F.array(_segment(tail)))

    segments = F.filter(F.flatten(F.transform("blocks", block_segments)), lambda s: s["text"] != "")
    return blocks.select("conv_id", segments.alias("segments")).select(
        "conv_id", "segments", F.array_join(F.col("segments.text"), "").alias("formatted")
    )


def turns_read(formatted: Column) -> Column:
    """The turns (array of role, text) that a formatted text was made from."""
    blocks = F.filter(F.split(formatted, CLOSERS, -1), lambda b: b != "")

    def of_block(b: Column) -> Column:
        rest = F.when(b.startswith(OTHER[0]), F.substring_index(b, OTHER[1], -1)).otherwise(F.lit(None))
        role = plain(F.substr(F.substring_index(b, OTHER[1], 1), F.lit(len(OTHER[0]) + 1)))
        for name, (head, _) in BLOCKS.items():
            here = b.startswith(head)
            rest = F.when(here, F.substr(b, F.lit(len(head) + 1))).otherwise(rest)
            role = F.when(here, F.lit(name)).otherwise(role)
        return F.transform(
            F.split(rest, r"\[NEXT\]", -1), lambda t: F.struct(role.alias("role"), plain(t).alias("text"))
        )

    return F.flatten(F.transform(blocks, of_block))


def trained_text(segments: Column) -> Column:
    """The texts under the loss mask, one after the other, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["trained"]), lambda s: plain(s["text"])), "")


def chat_report(turns: DataFrame) -> DataFrame:
    """Digests of every formatted conversation, read back from what ``format_chats`` made."""
    read = format_chats(turns).select(
        "conv_id", "formatted", turns_read(F.col("formatted")).alias("read"), trained_text(F.col("segments")).alias("loss")
    )
    listed = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("read").cast("bigint").alias("n_turns"),
        F.sha2(listed, 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


def with_probe(turns: DataFrame) -> DataFrame:
    """``turns`` and one conversation whose texts consist of control strings."""
    probe = turns.sparkSession.createDataFrame(
        [(PROBE_ID, i, role, PROBE_TEXT) for i, role in enumerate(("user", "assistant"))],
        "conv_id bigint, turn bigint, role string, text string",
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)


_ESC = r"regexp_replace(replace({}, '\', '\\'), '([<\[])(/?s>|</?SYS>>|/?INST\]|/?ROLE\]|TEXT\]|NEXT\])', '\1\\\2', 'g')"

# the marks of a role's block, and one ``[NEXT]`` for every turn that follows one of its role
ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) = role, false) AS follows FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_ESC.format("text")}) + CASE WHEN follows THEN 6
           WHEN role = 'user' THEN 13 WHEN role = 'system' THEN 15 WHEN role = 'assistant' THEN 7
           ELSE 19 + length({_ESC.format("role")}) END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id"""
