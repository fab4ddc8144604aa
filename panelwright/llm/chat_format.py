"""Chat formatting by sorted, collected turns; Spark expressions only.

Turns of a conversation are sorted by turn, role and text, and collected as
structs. A turn that follows one of the same role joins that turn's block. A text
cannot hold a control string: between ``<`` and ``|`` one backslash is put, one
more where there are some already, so that the change can be undone.

Defined cases: a null or empty text is an empty turn; a null role is the empty
role; a null turn sorts first; equal turn numbers sort by role and text, and
repeated rows are kept; a null conv_id is a conversation like any other; an
empty table gives no row; very long texts and conversations of very many turns
are formatted whole, in time that grows with their length. Columns other than
the four are ignored. The rows of one conversation meet in one task, as they do
in its one formatted string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's control strings.
START = "<|im_start|>"
END = "<|im_end|>\n"
NEXT = "<|im_next|>"
ROLE_BREAK = "<|im_line|>"
#: Code points of a formatted string that are looked at together when spans are cut out of it.
RUN = 4096


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _quoted(mark: str) -> str:
    return mark.replace("|", r"\|")


def format_chats(df: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted and loss_spans: (start, length) in code points of what is trained on."""
    role = F.replace(escape(F.coalesce(F.col("role"), F.lit(""))), F.lit("\n"), F.lit(ROLE_BREAK))
    turns = df.select("conv_id", "turn", role.alias("role"), escape(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    head = F.concat(F.lit(START), F.col("role"), F.lit("\n"))
    mark = F.when(F.col("i") == 1, head).when(F.col("before") == F.col("role"), F.lit(NEXT)).otherwise(F.concat(F.lit(END), head))
    marked = turns.withColumns({"i": F.row_number().over(order), "before": F.lag("role").over(order)}).withColumn("mark", mark)
    # Where a text ends, by a running sum over the sorted turns: one pass, however many there are.
    end = F.sum(F.length("mark") + F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    span = F.when(
        F.col("role") == trained_role, F.struct((end - F.length("text")).cast("int").alias("start"), F.length("text").alias("length"))
    )
    pieces = marked.select("conv_id", F.struct("i", F.concat("mark", "text").alias("said"), span.alias("span")).alias("piece"))
    chats = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    body = F.array_join(F.transform("pieces", lambda p: p["said"]), "")
    spans = F.filter(F.transform("pieces", lambda p: p["span"]), lambda x: x.isNotNull())
    return chats.select("conv_id", F.concat(body, F.lit(END)).alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The (role, text) structs that a formatted string holds."""
    blocks = F.filter(F.split(formatted, _quoted(START)), lambda _, i: i > 0)

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        at = F.length(role) + 2
        body = F.substring(block, at, F.length(block) - F.length(role) - 1 - len(END))
        name = unescape(F.replace(role, F.lit(ROLE_BREAK), F.lit("\n")))
        return F.transform(
            F.split(body, _quoted(NEXT)),
            lambda x: F.struct(name.alias("role"), unescape(x).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped. The string is cut into runs of RUN code points first, as a substring is counted from its start."""

    def span(runs: Column, s: Column) -> Column:
        end = s["start"] + s["length"]
        low, high = (lambda c: F.greatest(s["start"], c * RUN)), (lambda c: F.least(end, (c + 1) * RUN))
        part = lambda c: F.substring(F.get(runs, c), low(c) - c * RUN + 1, high(c) - low(c))
        at = F.when(s["length"] > 0, F.sequence(F.floor(s["start"] / RUN).cast("int"), F.floor((end - 1) / RUN).cast("int")))
        return unescape(F.array_join(F.transform(F.coalesce(at, F.expr("cast(array() as array<int>)")), part), ""))

    runs = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{RUN}}}"), F.lit(0))
    return F.element_at(F.transform(F.array(runs), lambda r: F.array_join(F.transform(spans, lambda s: span(r, s)), "")), 1)
