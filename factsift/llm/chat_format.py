r"""Chat formatting with a grammar round trip (operator 12, DataFrame functions only).

Grammar of a formatted conversation::

    conversation = turn*
    turn         = "<s>" role "[INST]" text "[/INST]</s>"

The four control strings ``<s>``, ``</s>``, ``[INST]`` and ``[/INST]`` may not
stand inside a role or a text. Method:

1. every turn is rendered as it is and reparsed by a deterministic parser;
2. a turn whose recovered role and text are not the source's, or that the
   grammar refuses, is rendered anew with its content escaped, and reparsed;
   a turn that still differed would stop the job, as would a conversation whose
   joined turns do not reparse to its source;
3. escaping puts one backslash behind the first character of each control
   string, or of one that already has backslashes there, so unescaping (one
   backslash less) is its exact inverse: ``</s>`` is written ``<\/s>`` and a
   literal ``<\/s>`` is written ``<\\/s>``.

The loss mask of a conversation is the list of byte spans of its assistant
texts in the UTF-8 of ``formatted``.

Null or empty roles and texts are empty strings. Turns are ordered by ``turn``
(null first), equal turns by role, then text; repeated rows are repeated turns.
Rows without a conv_id are one conversation of their own. Texts may be of any
length and all of a text is used; a formatted conversation is one value, so one
conversation (not a group of them) must fit a row. An empty table gives no
rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factsift.llm import common

# fixed values: the control strings of the template
BEGIN, TEXT, END_TEXT, END = "<s>", "[INST]", "[/INST]", "</s>"
_TURN_END = r"\[/INST\]</s>"
_CONTROL = r"</?s>|\[/?INST\]"
# what escaping changes: a control string with any number of backslashes inside
_ESCAPES = ((r"<(\\*/?s>)", r"<\\$1"), (r"\[(\\*/?INST\])", r"[\\$1"))
_UNESCAPES = ((r"<\\(\\*/?s>)", "<$1"), (r"\[\\(\\*/?INST\])", "[$1"))
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    for pattern, put in _ESCAPES:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(put))
    return text


def unescape(text: Column) -> Column:
    for pattern, put in _UNESCAPES:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(put))
    return text


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(BEGIN), role, F.lit(TEXT), text, F.lit(END_TEXT + END))


def parse(formatted: Column) -> Column:
    """Turns ``(role, text)`` of a formatted string; null if it is not of the grammar.

    The string is cut at turn ends; each piece must begin with ``<s>`` and hold
    one ``[INST]``, with no control string before, between or behind.
    """
    pieces = F.split(formatted, _TURN_END, -1)

    def turn(piece: Column) -> Column:
        halves = F.split(F.substring(piece, len(BEGIN) + 1, 2_147_483_647), r"\[INST\]", 2)
        role, text = F.get(halves, 0), F.get(halves, 1)
        good = (piece.startswith(BEGIN) & text.isNotNull() & ~role.rlike(_CONTROL) & ~text.rlike(_CONTROL))
        return F.when(good, F.struct(unescape(role).alias("role"), unescape(text).alias("text")))

    turns = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)
    whole = (F.element_at(pieces, -1) == "") & ~F.exists(turns, lambda t: t.isNull())
    return F.when(whole, turns)


def _recovers(formatted: Column, role: Column, text: Column) -> Column:
    turns = parse(formatted)
    first = F.get(turns, 0)
    return F.coalesce((F.size(turns) == 1) & (first["role"] == role) & (first["text"] == text), F.lit(False))


def settled(role: Column, text: Column) -> Column:
    """A turn ``(role, text)`` as written: as it is where that reparses to the
    source, else escaped; the job stops should that not reparse either."""
    plain, escaped = (role, text), (escape(role), escape(text))
    return (F.when(_recovers(render_turn(*plain), role, text), F.struct(plain[0].alias("role"), plain[1].alias("text")))
            .when(_recovers(render_turn(*escaped), role, text), F.struct(escaped[0].alias("role"), escaped[1].alias("text")))
            .otherwise(F.raise_error(F.lit("a turn does not survive the grammar round trip"))))


def turn_digest(role: Column, text: Column) -> Column:
    return F.sha2(F.concat(role, F.lit("\n"), text), 256)


def format_chats(conversations: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans`` for every conversation.

    ``loss_spans`` are ``(start, length)`` in bytes of the UTF-8 of
    ``formatted``, in order. One shuffle by conv_id moves each row once; offsets
    come from a running sum over the sorted rows, which keeps no group in memory.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).repartition("conv_id")
    written = rows.withColumn("w", settled(F.col("role"), F.col("text"))).withColumn(
        "rendered", render_turn(F.col("w.role"), F.col("w.text")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.octet_length("rendered")).over(before), F.lit(0))
    head = F.octet_length(F.concat(F.lit(BEGIN), F.col("w.role"), F.lit(TEXT)))
    placed = written.select(
        "conv_id", F.row_number().over(order).alias("pos"), "rendered",
        F.when(F.col("role") == LOSS_ROLE, F.struct((at + head).cast("int").alias("start"),
                                                    F.octet_length("w.text").cast("int").alias("length"))).alias("span"),
        turn_digest(F.col("role"), F.col("text")).alias("digest"))
    grouped = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "rendered", "span", "digest"))).alias("t"))
    joined = grouped.select(
        "conv_id", F.array_join(F.transform("t", lambda x: x["rendered"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.transform("t", lambda x: x["digest"]).alias("digests"))
    recovered = F.transform(parse(F.col("formatted")), lambda t: turn_digest(t["role"], t["text"]))
    checked = F.when(recovered == F.col("digests"), F.col("formatted")).otherwise(
        F.raise_error(F.lit("a conversation does not survive the grammar round trip")))
    return joined.select("conv_id", checked.alias("formatted"), "loss_spans")


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped span by span, with nothing between."""
    def cut(data: Column) -> Column:
        return F.transform(spans, lambda s: unescape(F.substring(data, s["start"] + 1, s["length"]).cast("string")))

    # the bytes are made once and handed to every span
    return F.array_join(F.get(F.transform(F.array(formatted.cast("binary")), cut), 0), "")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what a reader recovers from ``conv_id, formatted, loss_spans``."""
    turns = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"),
                             loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


# fixed value: what both turns of conversation -1 say
CONFLICT = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all conversations and conversation -1, formatted and read back."""
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"), F.lit(CONFLICT).alias("text"))
    table = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_chats(table.unionByName(extra)))


def _sql_escape(c: str) -> str:
    return (rf"regexp_replace(regexp_replace({c}, '<(\\*/?s>)', '<\\\1', 'g'), "
            rf"'\[(\\*/?INST\])', '[\\\1', 'g')")


SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONFLICT}' UNION ALL SELECT -1, 1, '{LOSS_ROLE}', '{CONFLICT}'
), e AS (
  SELECT *, length('{BEGIN}{TEXT}{END_TEXT}{END}') + length({_sql_escape('role')}) + length({_sql_escape('text')}) AS n
  FROM c
), g AS (
  SELECT conv_id, count(*) AS n_turns, CAST(sum(n) AS BIGINT) AS formatted_chars,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LOSS_ROLE}'), '') AS loss
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
