"""Chat formatting with a grammar round trip, with DataFrame functions only.

A turn is rendered as  <|im_start|>role NEWLINE text <|im_end|> NEWLINE. The parser is fixed: it cuts at
every <|im_end|> and its NEWLINE, takes the role up to the first line end, admits no further <| in the turn,
and undoes the escapes of the text: a backslash stands for itself doubled, and <\\| stands for <|. A text is first rendered as it is and parsed
again; only where the recovered turn differs from the source (the text holds a control string or a
backslash) the conflicting content is escaped, and the result is parsed and compared once more.
One escape is enough for any text: it doubles every backslash and puts one into every <|, so an escaped text has no
"<|", and taking the backslashes away gives back what was there. The finished conversation is parsed once more
as a whole and compared with its source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def render(role: Column, text: Column) -> Column:
    """role and text as they shall stand between the marks."""
    return F.concat(F.lit(OPEN), F.url_encode(role), F.lit("\n"), text, F.lit(CLOSE + "\n"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, raw, text); raw is still escaped.

    text is null where the grammar does not admit the turn.
    """
    pieces = F.split(formatted, "<\\|im_end\\|>\n?", -1)
    opened = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        at = F.locate("\n", piece)
        raw = piece.substr(at + 1, F.length(piece))
        role = F.url_decode(piece.substr(F.lit(len(OPEN) + 1), at - len(OPEN) - 1))
        return F.struct(role.alias("role"), raw.alias("raw"), F.when(~raw.contains("<|"), unescape(raw)).alias("text"))

    return F.transform(opened, turn)


def _is_turn(turns: Column, role: Column, text: Column) -> Column:
    """Whether the parsed turns are just the one of this role and text."""
    first = F.get(turns, 0)
    return (F.size(turns) == 1) & (first["role"] == role) & F.equal_null(first["text"], text)


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, `formatted`, `n_turns`, `escaped` (turns that needed escapes), `loss_spans` and `error`.

    rows: conv_id, turn, role, text and any other columns, which are not used. Turns stand in the order
    of turn (null first), then role and text; repeated rows are turns of their own. Null text and null
    role are empty; a null conv_id is a conversation. loss_spans: start (from 0) and length, in
    characters, of each assistant text inside formatted. error: null, or that the parser does not give the source back. A
    very long text is one turn as any other. An empty table gives an empty result.
    The escaping happens row by row before rows meet; only the finished turns of one conversation,
    which are one value of the result, come together.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    plain = parse(render(F.col("role"), F.col("text")))
    kept = _is_turn(plain, F.col("role"), F.col("text"))
    shown = F.when(kept, F.col("text")).otherwise(escape(F.col("text")))
    turns = turns.withColumn("kept", kept).withColumn("shown", shown)
    turns = turns.withColumn("piece", render(F.col("role"), F.col("shown")))
    item = F.struct("turn", "role", "text", "piece", "kept", F.length("shown").alias("n"))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + F.length(x["piece"])
        span = F.struct((end - len(CLOSE) - 1 - x["n"]).alias("start"), x["n"].alias("length"))
        return F.struct(end.alias("at"), F.when(x["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    back = F.transform(parse(F.col("formatted")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    source = F.transform("items", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return grouped.withColumn("formatted", F.array_join(F.transform("items", lambda x: x["piece"]), "")).select(
        "conv_id",
        "formatted",
        F.size("items").cast("long").alias("n_turns"),
        F.size(F.filter("items", lambda x: ~x["kept"])).cast("long").alias("escaped"),
        F.aggregate("items", start, step, lambda acc: acc["spans"]).alias("loss_spans"),
        F.when(~F.equal_null(back, source), "the parser does not give the source back").alias("error"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what stands in the formatted conversations: the turns by the parser, the loss by its spans.

    One row for each row of formatted (conv_id, formatted, loss_spans), null ids, repeated rows and very long ones too; null
    in formatted gives nulls. A turn that the grammar does not admit counts in n_turns and leaves its hash out.
    """
    turns = parse(F.col("formatted"))
    under = F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["length"])))
    return formatted.select("*", turns.alias("_turns"), F.array_join(under, "").alias("_loss")).select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
