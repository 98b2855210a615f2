r"""Chat formatting from a declarative template, on DataFrame functions alone.

A template lists, for a turn, its pieces of text and whether each counts for the loss. Control strings
begin with ``<|``; inside roles and texts a backslash escapes that opening (``<\|``) and itself, and a
role's line feed becomes ``\n``, so what stands in a text never ends a turn and can be read back exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """pieces: (text, when it counts for the loss); {role} and {text} are filled in, loss roles are learnt.
    rules: the state machine as (state, role) -> state; a missing entry leads to ``invalid`` and stays there."""

    open: str = "<|im_start|>"
    head_end: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accepting: tuple[str, ...] = ("answered",)
    rules: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "briefed", ("start", "user"): "asked", ("briefed", "user"): "asked",
            ("asked", "assistant"): "answered", ("answered", "user"): "asked",
        }
    )


CHAT = Template()


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescaped(text: Column, role: bool = False) -> Column:
    def part(x: Column) -> Column:
        x = F.replace(x, F.lit("\\|"), F.lit("|"))
        return F.replace(x, F.lit("\\n"), F.lit("\n")) if role else x

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), part), "\\")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = CHAT) -> DataFrame:
    """One row per conversation: conv_id, segments (text, loss), n_turns, state, valid, bad_turn.

    Turns go by turn, ties by role and text, repeated rows each count; a null turn comes first, a null
    role or text is empty, rows without a conv_id form one conversation. The machine runs over the roles:
    valid says that it ends in an accepting state, bad_turn is the position of the first role it has no
    rule for (else null). Invalid conversations are formatted too. Other columns are ignored.
    """
    none = F.lit("")
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), none).alias("role"), F.coalesce(F.col(text_col), none).alias("text"))
    convs = turns.select(F.col(conv_col).alias("conv_id"), row.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    def move(state: Column, x: Column) -> Column:
        after = F.lit("invalid")
        for (was, role), then in template.rules.items():
            after = F.when((state["state"] == was) & (x["role"] == role), then).otherwise(after)
        good = (after != "invalid") & (state["state"] != "invalid")
        return F.struct(after.alias("state"), (state["ok"] + good.cast("int")).alias("ok"))

    def pieces(x: Column) -> Column:
        loss = x["role"].isin(*template.loss_roles)
        parts = [
            (F.concat(F.lit(template.open), escaped(x["role"], role=True), F.lit(template.head_end)), F.lit(False)),
            (escaped(x["text"]), loss),
            (F.lit(template.close), F.lit(False)),
        ]
        return F.array(*(F.struct(t.alias("text"), on.alias("loss")) for t, on in parts))

    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("ok"))
    out = convs.select(
        "conv_id", F.flatten(F.transform("rows", pieces)).alias("segments"), F.size("rows").cast("bigint").alias("n_turns"), F.aggregate("rows", begin, move).alias("end")
    )
    return out.select(
        "conv_id", "segments", "n_turns", F.col("end.state").alias("state"), F.col("end.state").isin(*template.accepting).alias("valid"),
        F.when(F.col("end.state") == "invalid", F.col("end.ok")).alias("bad_turn"),
    )


def read_chats(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """conv_id, formatted (the whole text), turns (role, text) parsed from it, loss_text (unescaped)."""
    quoted = "".join(f"\\{c}" if not c.isalnum() and c != "\n" and c != "_" else c for c in template.close)
    whole = F.array_join(F.col("segments.text"), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    df = formatted.select("conv_id", whole.alias("formatted"), loss.alias("loss_text"))

    def turn(x: Column) -> Column:
        head = F.substring_index(x, template.head_end, 1)
        role = F.substring(head, F.lit(len(template.open) + 1), F.length(head))
        text = F.substring(x, F.length(head) + len(template.head_end) + 1, F.length(x))
        return F.struct(unescaped(role, role=True).alias("role"), unescaped(text).alias("text"))

    parts = F.split("formatted", quoted, -1)
    return df.withColumn("turns", F.transform(F.slice(parts, 1, F.size(parts) - 1), turn))
