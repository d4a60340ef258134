"""Chat formatting with a grammar round trip.

A conversation is rendered turn by turn as

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

and the rendered text is parsed again by a deterministic parser that allows
no control string inside a role or a text.  Turns that do not come back
identical are escaped and rendered again: one ``~`` goes into every string of
the form ``<~*|im_start|>``, ``<~*|im_end|>`` or ``<~*|nl|>`` and a newline in
a role becomes ``<|nl|>``.  The parser always undoes that step, so escaping
is reversible, and an escaped turn holds no control string, so the second
reading is identical.  Turns without conflict are rendered as they are.

The loss mask is a list of runs ``(chars, loss)`` over the formatted text in
code points, three for each turn (header, text, tail); assistant texts carry
loss.

DataFrame functions only.  Rendering, the trial parse and the escaping work
on single turns before the one shuffle; a conversation is one output string,
so its turns must fit one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_ANY = r"<(~*)\|(im_start|im_end|nl)\|>"
_GUARDED = r"<~(~*)\|(im_start|im_end|nl)\|>"
_CONTROL = r"<\|im_(start|end)\|>"


def _escape(text: Column) -> Column:
    return F.regexp_replace(text, _ANY, r"<~$1|$2|>")


def _unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("<~")), F.regexp_replace(text, _GUARDED, r"<$1|$2|>")).otherwise(text)


def escape_role(role: Column) -> Column:
    return F.replace(_escape(role), F.lit("\n"), F.lit("<|nl|>"))


def unescape_role(role: Column) -> Column:
    return _unescape(F.replace(role, F.lit("<|nl|>"), F.lit("\n")))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def _segment(seg: Column) -> Column:
    """(role, text) as written in one segment, and whether it follows the grammar."""
    body = F.substr(seg, F.lit(len(START) + 1))
    cut = F.instr(body, "\n")
    role, text = F.substr(body, F.lit(1), F.greatest(cut - 1, F.lit(0))), F.substr(body, cut + 1)
    ok = F.startswith(seg, F.lit(START)) & (cut > 0) & ~F.rlike(body, F.lit(_CONTROL))
    return F.struct(role.alias("role"), text.alias("text"), ok.alias("ok"))


def parse(formatted: Column) -> Column:
    """Turns of a formatted text, as written: array of (role, text, ok).  What
    follows the last end mark comes back as a turn with ``ok`` false."""
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)
    tail = F.element_at(parts, -1)
    turns = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), _segment)
    bad = F.array(F.struct(F.lit("").alias("role"), tail.alias("text"), F.lit(False).alias("ok")))
    return F.when(tail == "", turns).otherwise(F.concat(turns, bad))


def _read(turns: Column) -> Column:
    """Source turns behind parsed ones."""
    return F.transform(turns, lambda t: F.struct(unescape_role(t["role"]).alias("role"), _unescape(t["text"]).alias("text")))


def _same(parsed: Column, source: Column) -> Column:
    return F.forall(parsed, lambda t: t["ok"]) & (_read(parsed) == source)


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``loss_runs``
    (array of chars, loss), ``round_trip`` (true when the reparse is identical).

    Turns are ordered by turn, then role, then text, so rows repeated with one
    turn number have a fixed order and each is kept.  A null role or text is
    empty; null turn numbers come first; rows with a null conversation id form
    one conversation with a null id.  An empty table gives no rows.  Other
    columns are ignored.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("_turn"),
                        role.alias("_role"), text.alias("_text"))
    # trial: render the turn alone, read it back, escape it if it differs
    trial = rows.withColumn("_parsed", parse(render(F.col("_role"), F.col("_text"))))
    source = F.array(F.struct(F.col("_role").alias("role"), F.col("_text").alias("text")))
    tried = trial.withColumn("_clash", ~_same(F.col("_parsed"), source)).drop("_parsed")
    shown = tried.select("conv_id", F.struct(
        "_turn", "_role", "_text", F.when(F.col("_clash"), escape_role(F.col("_role"))).alias("_erole"),
        F.when(F.col("_clash"), _escape(F.col("_text"))).alias("_etext")).alias("_t"))
    convs = shown.groupBy("conv_id").agg(F.sort_array(F.collect_list("_t")).alias("_ts"))

    def written(t: Column) -> Column:
        return F.struct(F.coalesce(t["_erole"], t["_role"]).alias("role"),
                        F.coalesce(t["_etext"], t["_text"]).alias("text"), (t["_role"] == loss_role).alias("loss"))

    def forced(t: Column) -> Column:
        return F.struct(escape_role(t["_role"]).alias("role"), _escape(t["_text"]).alias("text"),
                        (t["_role"] == loss_role).alias("loss"))

    def joined(ts: Column) -> Column:
        return F.array_join(F.transform(ts, lambda t: render(t["role"], t["text"])), "")

    source = F.transform("_ts", lambda t: F.struct(t["_role"].alias("role"), t["_text"].alias("text")))
    once = convs.withColumn("_w", F.transform("_ts", written)).withColumn("_f", joined(F.col("_w")))
    checked = once.withColumn("_ok", _same(parse(F.col("_f")), source))
    # a whole text that still differs is escaped in every turn
    settled = (checked.withColumn("_w", F.when(F.col("_ok"), F.col("_w")).otherwise(F.transform("_ts", forced)))
               .withColumn("formatted", F.when(F.col("_ok"), F.col("_f")).otherwise(joined(F.col("_w")))))
    head, tail = len(START) + 1, len(END) + 1

    def run(chars: Column, loss: Column) -> Column:
        return F.struct(chars.cast("int").alias("chars"), loss.alias("loss"))

    runs = F.flatten(F.transform("_w", lambda t: F.array(
        run(F.length(t["role"]) + head, F.lit(False)), run(F.length(t["text"]), t["loss"]),
        run(F.lit(tail), F.lit(False)))))
    final = settled.withColumn("loss_runs", runs).withColumn(
        "round_trip", F.when(F.col("_ok"), F.lit(True)).otherwise(_same(parse(F.col("formatted")), source)))
    return final.select("conv_id", "formatted", "loss_runs", "round_trip")


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse ``formatted`` and its loss mask: ``conv_id``, ``turns`` (array of
    role, text as in the source), ``loss_text`` (the text under the mask,
    unescaped) and ``formatted_chars``.

    A mask whose runs do not match the parsed turns is an error."""
    parsed = formatted.withColumn("_p", parse(F.col("formatted")))
    head, tail = len(START) + 1, len(END) + 1
    lengths = F.flatten(F.transform("_p", lambda t: F.array(
        F.length(t["role"]) + head, F.length(t["text"]), F.lit(tail))))
    fits = lengths == F.transform("loss_runs", lambda r: r["chars"])
    masked = F.filter("_p", lambda t, i: F.element_at(F.col("loss_runs"), i * 3 + 2)["loss"])
    return parsed.select(
        "conv_id", _read(F.col("_p")).alias("turns"),
        F.when(fits, F.array_join(F.transform(masked, lambda t: _unescape(t["text"])), "")).otherwise(
            F.raise_error(F.lit("the loss mask does not fit the formatted text")).cast("string")).alias("loss_text"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))
