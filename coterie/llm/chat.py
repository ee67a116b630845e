"""Chat formatting from an event log, in DataFrame functions only.

A conversation is a log of events in sequence: ``message`` opens a message of a
role, ``delta`` appends streamed text to the turn's last message, ``edit`` puts
new text in its place and ``regenerate`` empties it for what follows. The log is
partitioned by conversation and turn, sorted by sequence and folded into final
messages; a conversation's messages, in turn order, are rendered with

    <|start|>role<|text|>text<|end|>

Control strings of common templates inside roles and texts get a tilde after
their first character, and one more if they have some already, so ``unescaped``
restores every text exactly and no text can close its turn. ``parsed`` reads
turns and the loss mask (the texts of assistant messages) back from the output.

A null text is empty, a null role is the empty role, a null kind is a message, a
null turn or sequence comes first. Events of one sequence number are taken in
the order of kind, role, text. A delta, edit or regeneration without a message
before it in its turn opens one of its own role. Rows with null conv_id are one
conversation. Extra columns are ignored; an empty log gives no rows.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.llm.common import read

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
# What opens a control string, after its first character.
ANGLE, SQUARE = r"(\||/?s>|/?SYS>)", r"(/?INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"<(~*){ANGLE}", "<~$1$2"), rf"\[(~*){SQUARE}", "[~$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"<~(~*){ANGLE}", "<$1$2"), rf"\[~(~*){SQUARE}", "[$1$2")


def _folded(events: Column) -> Column:
    """The messages of one turn from its sorted events."""
    messages = "array<struct<role:string,text:string>>"

    def message(role: Column, text: Column) -> Column:
        return F.array(F.struct(role.alias("role"), text.alias("text"))).cast(messages)

    def put(done: Column, e: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        role = F.coalesce(last["role"], e["role"])
        text = F.when(e["kind"] == "delta", F.concat(F.coalesce(last["text"], F.lit("")), e["text"])).when(e["kind"] == "edit", e["text"]).otherwise(F.lit(""))
        changed = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), message(role, text))
        return F.when(e["kind"] == "message", F.concat(done, message(e["role"], e["text"]))).otherwise(changed).cast(messages)

    return F.aggregate(events, F.array().cast(messages), put)


def final_messages(log: DataFrame) -> DataFrame:
    """(conv_id, turn, messages) from events (conv_id, turn, seq, kind, role, text)."""
    event = F.struct("seq", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return log.groupBy("conv_id", "turn").agg(_folded(F.sort_array(F.collect_list(event))).alias("messages"))


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted): one text per conversation."""
    whole = turns.groupBy("conv_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("turn", "messages"))), lambda t: t["messages"])).alias("messages"))
    shown = F.transform("messages", lambda m: F.concat(F.lit(START), escaped(m["role"]), F.lit(TEXT), escaped(m["text"]), F.lit(END)))
    return whole.select("conv_id", F.array_join(shown, "").alias("formatted"))


def parsed(formatted: Column) -> Column:
    """The (role, text, loss) of each turn, read from a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"<\|start\|>"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        role = unescaped(F.substring_index(piece, TEXT, 1))
        text = unescaped(F.substring_index(F.substring_index(piece, TEXT, -1), END, 1))
        return F.struct(role.alias("role"), text.alias("text"), (role == "assistant").alias("loss"))

    return F.transform(pieces, turn)


def format_log(log: DataFrame) -> DataFrame:
    """(conv_id, formatted) of every conversation of an event log."""
    return render(final_messages(log))


def log_of_rows(conversations: DataFrame) -> DataFrame:
    """A table with one finished message per row (conv_id, turn, role, text) as an event log."""
    return conversations.select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    turns = format_log(log_of_rows(rows)).withColumn("turns", parsed(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    read_back = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), digest(read_back).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), digest(loss).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
shown AS (SELECT *, length('<|start|>' || '<|text|>' || '<|end|>') + length(role) + length(text)
    + len(regexp_extract_all(role || ' ' || text, '<~*(\||/?s>|/?SYS>)')) + len(regexp_extract_all(role || ' ' || text, '\[~*/?INST\]')) AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""
