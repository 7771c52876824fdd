r"""Chat formatting with a grammar round trip (operator 7, DataFrame functions only).

Template, turns in order, with nothing between them::

    user       [INST] text [/INST]
    system     <<SYS>> text <</SYS>>
    assistant  (blank) text </s>
    others     [ROLE] role [/ROLE] text [/TURN]

The parser is deterministic: it cuts the string after each closing mark
(``[/INST]``, ``<</SYS>>``, ``</s>``, ``[/TURN]``) that no backslash precedes;
each piece must have the shape of one turn and hold no other mark. A mark with
backslashes before it is text, and reading it drops one backslash.

A conversation is first rendered as it is and parsed again. If the recovered
turns differ from the source, it is rendered anew with one more backslash before
each mark (and its backslashes) in roles and texts, which the parser takes away
again. Marks cannot overlap, and a blank stands between text and closing mark,
so this second rendering always reads back; the job fails if one should not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the template's marks, and per role (opening, closing)
MARKS = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "</s>", "[ROLE]", "[/ROLE]", "[/TURN]")
TURNS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>> ", " <</SYS>>"),
         "assistant": (" ", " </s>")}
OTHER = ("[ROLE] ", " [/ROLE] ", " [/TURN]")

ANY = r"(?:\[/?INST\]|<</?SYS>>|</s>|\[/?ROLE\]|\[/TURN\])"
CLOSING = r"(?:\[/INST\]|<</SYS>>|</s>|\[/TURN\])"
#: cut points: behind a closing mark that has no backslash before it
CUT = r"(?<=(?<!\\)\[/INST\])|(?<=(?<!\\)<</SYS>>)|(?<=(?<!\\)</s>)|(?<=(?<!\\)\[/TURN\])"


def escape(text: Column) -> Column:
    """One more backslash before each mark, linear also in long runs of them."""
    return F.regexp_replace(text, "(" + ANY + ")", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(" + ANY + ")", "$1")


def render_turn(role: Column, text: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), role, F.lit(OTHER[1]), text, F.lit(OTHER[2]))
    for name, (head, tail) in TURNS.items():
        out = F.when(role == name, F.concat(F.lit(head), text, F.lit(tail))).otherwise(out)
    return out


def parse_piece(piece: Column) -> Column:
    """Struct (role, text, inner start, inner length) of one piece; role NULL if malformed."""
    def inner(head: str, tail: str) -> Column:
        body = F.substring(piece, F.lit(len(head) + 1), F.length(piece) - len(head) - len(tail))
        return body

    def shape(head: str, tail: str) -> Column:
        return (piece.startswith(head) & piece.endswith(tail)
                & (F.length(piece) >= len(head) + len(tail)))

    def clean(body: Column) -> Column:
        return ~body.rlike(r"(?<!\\)" + ANY)

    def found(role: Column, body: Column, head: Column) -> Column:
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"),
                        head.cast("int").alias("skip"), F.length(body).alias("size"))

    none = F.lit(None).cast("struct<role:string,text:string,skip:int,size:int>")
    # the role ends at the first unescaped [/ROLE]
    body = inner(OTHER[0], OTHER[2])
    parts = F.split(body, r" (?<!\\)\[/ROLE\] ", 2)
    role, text = parts[0], parts[1]
    out = F.when(shape(OTHER[0], OTHER[2]) & (F.size(parts) == 2) & clean(role) & clean(text),
                 found(role, text, F.length(role) + len(OTHER[0]) + len(OTHER[1]))).otherwise(none)
    for name, (head, tail) in TURNS.items():
        body = inner(head, tail)
        out = F.when(shape(head, tail) & clean(body),
                     found(F.lit(name), body, F.lit(len(head)))).otherwise(out)
    return out


def pieces(formatted: Column) -> Column:
    return F.filter(F.split(formatted, CUT), lambda p: p != "")


def _parsed(formatted: Column) -> Column:
    return F.transform(pieces(formatted), lambda p: F.struct(parse_piece(p).alias("turn"),
                                                  F.length(p).alias("width")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, escaped, turns, loss_runs.

    ``turns`` has conv_id, turn, role and text (other columns are ignored). Rows
    go by turn (NULL first), then role and text; repeated rows are turns of
    their own. A NULL role or text reads as empty, rows without a conv_id form
    one conversation, an empty table gives none. ``turns`` holds the (role,
    text) pairs read back from ``formatted``. ``loss_runs`` is the loss mask, one
    (before, length, after) per turn: characters passed over, under the mask (the
    assistant texts) and passed over again; together they cover the string.
    """
    ordered = (turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"),
                 F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                 F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
        .groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("source")))

    def rendered(edit) -> Column:
        return F.array_join(F.transform("source", lambda t: render_turn(
            edit(t["role"]), edit(t["text"]))), "")

    def recovered(column: str) -> Column:
        return F.transform(_parsed(F.col(column)), lambda p: F.struct(
            p["turn"]["role"].alias("role"), p["turn"]["text"].alias("text")))

    wanted = F.transform("source", lambda t: F.struct(t["role"].alias("role"),
                                                      t["text"].alias("text")))
    plain = (ordered.withColumn("plain", rendered(lambda c: c))
             .withColumn("escaped", ~recovered("plain").eqNullSafe(wanted)))
    marked = plain.withColumn("formatted", F.when(F.col("escaped"), rendered(escape))
                              .otherwise(F.col("plain")))
    parsed = marked.select("conv_id", "formatted", "escaped", wanted.alias("wanted"),
                           _parsed(F.col("formatted")).alias("parsed"))
    read = F.transform("parsed", lambda p: F.struct(p["turn"]["role"].alias("role"),
                                                    p["turn"]["text"].alias("text")))
    def run(p: Column) -> Column:
        loss = p["turn"]["role"] == "assistant"
        before = F.when(loss, p["turn"]["skip"]).otherwise(p["width"])
        length = F.when(loss, p["turn"]["size"]).otherwise(0)
        return F.struct(before.alias("before"), length.alias("length"),
                        (p["width"] - before - length).alias("after"))

    runs = F.transform("parsed", run)
    same = read.eqNullSafe(F.col("wanted"))
    checked = F.when(same, F.col("formatted")).otherwise(F.raise_error(F.concat(
        F.lit("conversation does not read back: "),
        F.coalesce(F.col("conv_id").cast("string"), F.lit("NULL")))).cast("string"))
    return parsed.select("conv_id", checked.alias("formatted"), "escaped", read.alias("turns"),
                         runs.alias("loss_runs"))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Digests of ``format_conversations`` rows, all read back from the formatted string."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.zip_with(pieces(F.col("formatted")), "loss_runs", lambda p, r: unescape(
        F.substring(p, r["before"] + 1, r["length"]))), "")
    return (formatted.withColumn("loss", loss)
            .select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                    F.sha2(said, 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"),
                    F.sha2("loss", 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars")))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 7: all ``conversations`` and conversation -7."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat_digests(format_conversations(rows.unionByName(hard)))


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(text, '(\\*(?:\[/?INST\]|<</?SYS>>|</s>|\[/?ROLE\]|\[/TURN\]))', '\\\1', 'g') AS et,
         regexp_replace(role, '(\\*(?:\[/?INST\]|<</?SYS>>|</s>|\[/?ROLE\]|\[/TURN\]))', '\\\1', 'g') AS er
  FROM t
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(et) + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 17 WHEN 'assistant' THEN 6
                             ELSE length(er) + 24 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
